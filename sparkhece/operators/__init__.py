"""Operators on DataFrames of documents, tokens and lexicons."""
