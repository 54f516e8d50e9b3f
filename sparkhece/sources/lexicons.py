"""Readers and writers. Every lexicon is a DataFrame made from a path that Spark can open."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkhece.functions import rules


def lines(spark: SparkSession, path: str, missing_ok: bool = False, column: str = "word") -> DataFrame:
    """One row per line of a UTF-8 text file; a missing file is no rows where ``missing_ok``."""
    try:
        return spark.read.text(path).withColumnRenamed("value", column)
    except AnalysisException:
        if not missing_ok:
            raise
        return spark.createDataFrame([], f"{column} string")


def phrases(spark: SparkSession, path: str) -> DataFrame:
    """Multi-word expressions, longest first."""
    words = lines(spark, path, True, "mwe").select(F.trim("mwe").alias("mwe")).where("mwe <> ''")
    return words.orderBy(F.desc(F.length("mwe")), "mwe")


def lexicon(spark: SparkSession, path: str, missing_ok: bool = False) -> DataFrame:
    """Distinct lower-cased words. ``missing_ok`` gives none (stemmer); see ``lexicon_or_corrections``."""
    return lines(spark, path, missing_ok).select(F.lower(F.trim("word")).alias("word")).where("word <> ''").distinct()


def lexicon_or_corrections(spark: SparkSession, path: str) -> DataFrame:
    """The lexicon, or the values of the built-in corrections where the file is missing."""
    try:
        return lexicon(spark, path)
    except AnalysisException:
        return spark.createDataFrame([(v,) for v in sorted(set(rules.CORRECTIONS.values()))], "word string")


def frequency_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """``(word, freq)``: case counts, repeats are frequencies."""
    return lines(spark, path).select(F.trim("word").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("freq"))


def stopwords(spark: SparkSession, path: str, distinct: bool = False) -> DataFrame:
    words = lines(spark, path, True).select(F.lower(F.trim("word")).alias("word"))
    return words.distinct() if distinct else words


def _clean_suffix(x: Column) -> Column:
    return F.regexp_replace(F.trim(x), "^-|-$", "")


def suffixes(spark: SparkSession, path: str) -> DataFrame:
    """``(suffix, category)`` of a CSV ``word,category``, distinct and longest first.

    An unknown category is inflectional; where a suffix has several, the first in the order
    derivational, inflectional, functional holds.
    """
    rows = spark.read.option("header", True).csv(path)
    kind = F.upper(F.trim("category"))
    kind = F.when(kind.isin("DERIVATIONAL", "FUNCTIONAL"), kind).otherwise("INFLECTIONAL")
    rows = rows.select(_clean_suffix(F.col("word")).alias("suffix"), kind.alias("category")).where("suffix <> ''")
    return longest_first(rows.groupBy("suffix").agg(F.min_by("category", F.array_position(F.array(*map(F.lit, ("DERIVATIONAL", "INFLECTIONAL", "FUNCTIONAL"))), F.col("category"))).alias("category")))


def longest_first(rows: DataFrame) -> DataFrame:
    return rows.orderBy(F.desc(F.length("suffix")), "suffix")


def with_extra_suffixes(known: DataFrame, extra: DataFrame) -> DataFrame:
    """Further suffixes ``(word)`` as inflectional, where they are not known yet."""
    more = extra.select(_clean_suffix(F.lower("word")).alias("suffix")).where("suffix <> ''").distinct()
    return longest_first(known.union(more.join(known, "suffix", "left_anti").withColumn("category", F.lit("INFLECTIONAL"))))


def abbreviations(spark: SparkSession, path: str) -> DataFrame:
    """``(abbr, full_form)`` of lines ``abbr: full form``, cut at the first colon; the last of equal ones holds."""
    return abbreviation_rows(lines(spark, path, True, "value").withColumn("line_no", F.monotonically_increasing_id()))


def abbreviation_rows(rows: DataFrame) -> DataFrame:
    """The same from rows ``(line_no, value)``."""
    cut = F.split("value", ":", 2)
    rows = rows.where(F.col("value").contains(":")).select("line_no", F.lower(F.trim(cut[0])).alias("abbr"), F.trim(cut[1]).alias("full_form"))
    return rows.where("abbr <> '' AND full_form <> ''").groupBy("abbr").agg(F.max_by("full_form", "line_no").alias("full_form"))


def write_words(words: DataFrame, path: str, column: str = "word") -> None:
    """Sorted, one per line, as one file: a stop-word list is a small result."""
    words.select(column).orderBy(column).coalesce(1).write.mode("overwrite").text(path)


def sentences(spark: SparkSession, path: str) -> DataFrame:
    """``(line_no, sentence)`` of non-blank trimmed lines; numbers follow the file."""
    rows = lines(spark, path, column="s").select(F.monotonically_increasing_id().alias("line_no"), F.trim("s").alias("sentence"))
    return rows.where("sentence <> ''")


def save_model(tables: dict[str, DataFrame], path: str) -> None:
    """Model tables as parquet below one folder."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def load_model(spark: SparkSession, path: str, names: list[str]) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{path}/{n}") for n in names}


def save_pipeline(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_pipeline(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def annotated(rows: DataFrame, column: str = "value") -> DataFrame:
    """``(text, tokens)`` of lines ``sentence, ['t1', 't2']``: cut at the first ``, [``; quoted items are the tokens."""
    cut = F.split(F.col(column), r", \[", 2)
    items = F.regexp_extract_all(cut[1], F.lit(r"""('(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")"""), F.lit(1))
    plain = F.transform(items, lambda s: F.regexp_replace(s.substr(F.lit(2), F.length(s) - 2), r"\\(.)", "$1"))
    return rows.where(F.col(column).contains(", [")).select(F.trim(cut[0]).alias("text"), plain.alias("tokens"))


def test_pairs(spark: SparkSession, path: str) -> DataFrame:
    """``(test_number, input, expected)`` of a CSV ``erroneous,correct``, trimmed."""
    rows = spark.read.option("header", True).csv(path).withColumn("_n", F.monotonically_increasing_id())
    number = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("_n"))  # a test file is one small sequence
    return rows.select(number.alias("test_number"), F.trim("erroneous").alias("input"), F.trim("correct").alias("expected"))


def write_results(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).csv(path)


def tokenize_file(spark: SparkSession, source: str, sink: str, tokens) -> None:
    """Non-blank lines of ``source`` as tokens joined by blanks; ``tokens`` maps a text column to an array column."""
    rows = lines(spark, source, column="s").where(F.trim("s") != "")
    rows.select(F.array_join(tokens(F.trim("s")), " ").alias("value")).write.mode("overwrite").text(sink)


def morph_rows(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``(key, word, analysis)`` of analyser output.

    A line without a leading tab starts a word and tabbed lines are its analyses; blank lines and lines
    of dashes are skipped; a word that comes again starts anew.
    """
    rows = docs.select(key, F.posexplode(F.split(text, "\n")).alias("_p", "_l")).where((F.trim("_l") != "") & ~F.col("_l").startswith("-" * 50))
    tab = F.col("_l").startswith("\t")
    w = Window.partitionBy(key).orderBy("_p")
    rows = rows.withColumn("word", F.last(F.when(~tab, F.trim("_l")), ignorenulls=True).over(w)).withColumn("_g", F.sum((~tab).cast("int")).over(w))
    rows = rows.withColumn("_last", F.max("_g").over(Window.partitionBy(key, "word")))
    return rows.where(tab & (F.col("_g") == F.col("_last")) & F.col("word").isNotNull()).select(key, "word", F.regexp_replace("_l", r"^\s+|\s+$", "").alias("analysis"))


def analyses_from(docs: DataFrame, analyse, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Ask an analyser for each text and parse its answers.

    ``analyse`` is a Python callable from text to text (an HTTP client, say); it runs in batches
    on the executors. Where answers exist as a table, use ``morph_rows`` alone.
    """

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda t: analyse(t) if t else "")

    return morph_rows(docs.select(key, F.pandas_udf(run, "string")(F.col(text)).alias("_a")), "_a", key)
