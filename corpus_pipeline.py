"""The corpus pipeline: five stages over ``documents``, each by one operator of ``sparkhece.llm``.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is written as Parquet
and read again as the next one's ``docs``. All but the last return the columns of documents.

Defined results of all stages: an empty table gives an empty one. Extra columns may have any
name and are returned as they are. Null and empty texts are scored, compared and counted as
empty; null keys are keys of their own. Texts are read whole, whatever their length. Rows that
agree in key and text are scored alike and are copies to the near-dedup stage; rows that agree
in the key alone are different documents. Ties are stated by each operator.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkhece.llm import decontam, mixing, paragraphs, quality, simhash
from sparkhece.llm.common import fold, materialize, plain, restored, table
from sparkhece.llm.queries import MIX_TARGETS


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality classifier: documents that score below the threshold go; a score equal to it stays."""
    labels = table(spark, sf_dir, "labels").where(fold(F.col("doc_id"), 5) != 0)
    model = quality.train(docs, labels)
    own, names = plain(docs)
    scored = quality.score(own, model, text=names["text"], out="_score")
    return restored(scored.where(F.col("_score") >= quality.THRESHOLD), names)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SimHash near-dedup on 5-word shingles, links verified by Jaccard 0.8: the document of least id of each group stays.

    Empty and null texts are copies of each other; repeated rows are copies too; a null id is
    the least; of equal ids the text of least hash stays.
    """
    return simhash.keep_first(docs)


def drop_repeated_paragraphs(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Substring dedup: paragraphs and passages that repeat elsewhere go; a document that loses all of its text goes too.

    Rows of null text stay. ``n_chars`` follows the text where some was removed.
    """
    own, names = plain(docs)
    out = paragraphs.dedup_paragraphs(own, names["doc_id"], names["text"])
    body, cut = F.col(names["text"]), F.col("dedup.n_removed") > 0
    kept = out.where(~cut | (F.trim(body) != ""))
    if "n_chars" not in names:
        return restored(kept, names)
    return restored(kept, names, n_chars=F.when(cut, F.length(body).cast("long")).otherwise(F.col(names["n_chars"])))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination: documents with any hit go; those of null text stay."""
    bench = table(spark, sf_dir, "benchmark").select("item_id", "text")
    own, names = plain(docs)
    return restored(decontam.decontaminate(own, bench, names["text"]).where("hits.n_hit = 0"), names)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing to target weights: every row with its rate and copies; the domains are learned from a quarter of them by their language."""
    labelled = docs.where(fold(F.col("doc_id"), 4) == 0).select("doc_id", F.col("lang").alias("domain"))
    return mixing.mix(docs.select("doc_id", "text"), labelled, MIX_TARGETS)


STAGES = [
    ("quality", keep_quality),
    ("simhash", drop_near_duplicates),
    ("paragraphs", drop_repeated_paragraphs),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
]

#: The quality scores, fingerprints, MinHash and fitted rates are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
