"""Stop words and TF / DF / IDF / TF-IDF over a corpus, as relational plans.

``terms`` is the one scan: everything else aggregates it. Counting goes document by word
first, which is small per document and combines on the map side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkhece.functions.text import corpus_tokens
from sparkhece.sources.shared import stored


MOST_WORDS = 5_000  # of a list that is put into expressions


def terms(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``(key, word, cnt, tf)``; the length of a document comes with its tokens, so there is no second shuffle for it."""
    tok = docs.select(key, corpus_tokens(text).alias("_w"))
    rows = tok.select(key, F.size("_w").alias("_n"), F.explode("_w").alias("word"))
    out = rows.groupBy(key, "word").agg(F.count(F.lit(1)).alias("cnt"), F.first("_n").alias("_n"))
    return out.select(key, "word", "cnt", (F.col("cnt") / F.col("_n")).alias("tf"))


def frequencies(docs: DataFrame, text: str = "text", key: str = "doc_id", counted: DataFrame | None = None) -> DataFrame:
    """``(word, df, idf, avg_tf, avg_tfidf)`` in one aggregation; N counts every document, blank ones too.

    avg(tf x idf) over a word's documents is avg(tf) x idf, because idf is the word's own.
    ``counted`` is ``terms`` of the same documents, where the caller has it.
    """
    n = docs.agg(F.count(F.lit(1)).alias("_docs"))
    per = (terms(docs, text, key) if counted is None else counted).groupBy("word").agg(F.count(F.lit(1)).alias("df"), F.avg("tf").alias("avg_tf"))
    idf = F.log(F.col("_docs") / F.col("df"))
    per = per.crossJoin(F.broadcast(n)).withColumn("idf", idf)  # the count is one row
    return per.select("word", "df", "idf", "avg_tf", (F.col("avg_tf") * F.col("idf")).alias("avg_tfidf"), (F.col("df") / F.col("_docs")).alias("df_share"))


def tfidf(docs: DataFrame, text: str = "text", key: str = "doc_id", hot: int = 20_000) -> DataFrame:
    """``(key, word, tf, idf, tfidf)``.

    Terms are counted once and stored. The ``hot`` words of most documents, which hold most
    rows, are joined by broadcast, so none of them meets in one task; the others by shuffle.
    """
    counted = stored(terms(docs, text, key).select(key, "word", "tf"), "terms")
    per_word = stored(frequencies(docs, text, key, counted).select("word", "df", "idf"), "idf")
    top = per_word.orderBy(F.desc("df"), "word").limit(hot).select(F.col("word").alias("_w"), F.col("idf").alias("_i"))
    if per_word.count() > hot:
        first = counted.join(F.broadcast(top), F.col("word") == F.col("_w"), "left")  # at most ``hot`` rows are broadcast
        rest = first.where("_w IS NULL").select(key, "word", "tf").join(per_word.select("word", "idf"), "word")
        joined = first.where("_w IS NOT NULL").select(key, "word", "tf", F.col("_i").alias("idf")).unionByName(rest.select(key, "word", "tf", "idf"))
    else:
        joined = counted.join(F.broadcast(top), F.col("word") == F.col("_w")).select(key, "word", "tf", F.col("_i").alias("idf"))
    return joined.select(key, "word", "tf", "idf", (F.col("tf") * F.col("idf")).alias("tfidf"))


def by_idf(freq: DataFrame, threshold: float = 0.5) -> DataFrame:
    return freq.where(F.col("idf") < threshold).orderBy("idf", "word")


def by_df(freq: DataFrame, threshold: float = 0.5) -> DataFrame:
    return freq.where(F.col("df_share") > threshold).orderBy("df_share", "word")


def by_tf(freq: DataFrame, threshold: float = 0.01) -> DataFrame:
    return freq.where(F.col("avg_tf") < threshold).orderBy(F.desc("avg_tf"), "word")


def by_tfidf(freq: DataFrame, threshold: float = 0.1) -> DataFrame:
    return freq.where(F.col("avg_tfidf") < threshold).orderBy("avg_tfidf", "word")


def combined(freq: DataFrame, idf: float = 0.5, df: float = 0.5) -> DataFrame:
    """Words that both the IDF and the DF rule name."""
    return by_idf(freq, idf).select("word").intersect(by_df(freq, df).select("word"))


def extremes(freq: DataFrame, n: int = 50, lowest: bool = True) -> DataFrame:
    """The ``n`` words of lowest or highest IDF, with the share of documents that hold them."""
    order = F.asc("idf") if lowest else F.desc("idf")
    return freq.orderBy(order, "word").limit(n).select("word", "df", "idf", (F.col("df_share") * 100).alias("pct"))


def word_array(stopwords: DataFrame, column: str = "word") -> list[str]:
    """A stop-word list for use inside expressions; lists are lexicons of bounded size (checked)."""
    rows = stopwords.select(column).distinct().limit(MOST_WORDS + 1).collect()
    if len(rows) > MOST_WORDS:
        raise ValueError(f"not a stop-word list: more than {MOST_WORDS} words; use remove_by_join")
    return sorted(r[0] for r in rows if r[0] is not None)


def keep(tokens: Column, stop: list[str]) -> Column:
    """Tokens that are not stop words, repeats kept (``array_except`` would drop them)."""
    return F.filter(tokens, lambda t: ~t.isin(*stop)) if stop else tokens


def remove_stopwords(text: Column | str, stop: list[str]) -> Column:
    """Corpus tokens without stop words joined by blanks; with an empty list the text as it is."""
    text = F.col(text) if isinstance(text, str) else text
    return F.array_join(keep(corpus_tokens(text), stop), " ") if stop else text


def remove_by_join(tokens: DataFrame, stopwords: DataFrame, column: str = "token") -> DataFrame:
    """The same on token rows as an anti join, for lists of any size."""
    return tokens.join(stopwords.select(F.col("word").alias(column)).distinct(), column, "left_anti")


def service_columns(tokens: Column, stop: list[str]) -> list[Column]:
    """What the removal service reports: alphabetic tokens kept, distinct, removed, and counts."""
    words = F.filter(tokens, lambda t: t.rlike(r"^\p{L}+$"))
    hit = lambda t: F.lower(t).isin(*stop) if stop else F.lit(False)
    kept, gone = F.filter(words, lambda t: ~hit(t)), F.filter(words, hit)
    return [
        kept.alias("filtered_tokens"), F.array_distinct(kept).alias("unique_tokens"), gone.alias("removed_stopwords"),
        F.size(words).alias("original_count"), F.size(kept).alias("filtered_count"), F.size(gone).alias("removed_count"),
    ]
