"""PySpark-native text analytics: Turkish preprocessing operators on DataFrames."""
