"""The thin queries of the training-data operators, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkhece.llm import decontam, html_wrapper, langid, media_ogg, mixing, paragraphs, quality, simhash, suffix_dedup, toxicity
from sparkhece.llm.common import fold, table

#: Shares of the expected tokens that the mixing query aims at (parameters of the query).
MIX_TARGETS = {"en": 0.45, "fr": 0.25, "de": 0.20, "es": 0.10}


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = suffix_dedup.dedup_substrings(docs)
    return out.select("doc_id", "dedup.n_bytes", "dedup.n_removed", F.size("dedup.spans").cast("long").alias("n_spans"), "dedup.kept_sha256")


def op2_paragraph_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = paragraphs.dedup_paragraphs(docs)
    return out.select("doc_id", "text", "dedup.n_removed", "dedup.n_lines", "dedup.n_spans")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    model = quality.train(docs, labels.where(fold(F.col("doc_id"), 5) != 0))
    scored = quality.score(docs, model, out="score")
    return scored.select(
        "doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted")
    )


def op4_media_ogg(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    m = media_ogg.media_digest(docs).select("doc_id", "media.*")
    return m.drop("error")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    labelled = docs.where(fold(F.col("doc_id"), 4) == 0).select("doc_id", F.col("lang").alias("domain"))  # a quarter; the others are predicted unseen
    return mixing.mix(docs, labelled, MIX_TARGETS)


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = fold(F.col("doc_id"), 4) == 2
    model = langid.train(docs.where(~held))
    return langid.identify(docs.select("doc_id", "text"), model).select("doc_id", held.alias("held_out"), "lang_id.lang_pred", "lang_id.score")


def op7_html_wrapper(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    out = html_wrapper.extract(pages)
    return out.select("page_id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("long").alias("n_chars"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = simhash.near_duplicates(docs)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    held = fold(F.col("doc_id"), 3) == 1
    model = toxicity.train(docs, labels.where(~held))
    scored = toxicity.score(docs, model, out="score")
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = decontam.decontaminate(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))
    return out.select(
        "doc_id", "hits.n_words", "hits.n_hit", "hits.n_items", F.sha2(F.array_join("hits.items", ","), 256).alias("items_sha256"), (F.col("hits.n_hit") > 0).alias("contaminated")
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_paragraph_dedup": op2_paragraph_dedup,
    "op3_quality": op3_quality,
    "op4_media_ogg": op4_media_ogg,
    "op5_mixing": op5_mixing,
    "op6_langid": op6_langid,
    "op7_html_wrapper": op7_html_wrapper,
    "op8_simhash": op8_simhash,
    "op9_toxicity": op9_toxicity,
    "op10_decontamination": op10_decontamination,
}

_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_OP10_WORDS = rf"regexp_extract_all(translate(text, {_AZ}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

SQL: dict[str, str] = {
    "op1_suffix_dedup": """
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
 w AS (SELECT doc_id, s, md5(b[s:s + 199]) AS h
       FROM (SELECT doc_id, b, unnest(range(1, octet_length(b) - 198)) AS s FROM d)),
 dup AS (SELECT h FROM w GROUP BY h HAVING count(*) > 1),
 hit AS (SELECT doc_id, s FROM w WHERE h IN (SELECT h FROM dup)),
 step AS (SELECT doc_id, s, CASE WHEN s <= lag(s) OVER (PARTITION BY doc_id ORDER BY s) + 200 THEN 0 ELSE 1 END AS fresh FROM hit),
 run AS (SELECT doc_id, s, sum(fresh) OVER (PARTITION BY doc_id ORDER BY s) AS r FROM step),
 span AS (SELECT doc_id, r, min(s) AS a, max(s) + 200 AS z FROM run GROUP BY doc_id, r),
 piece AS (SELECT doc_id, a, z, lag(z, 1, 1) OVER (PARTITION BY doc_id ORDER BY a) AS prev FROM span),
 cut AS (SELECT p.doc_id, sum(z - a) AS n_removed, count(*) AS n_spans, max(z) AS z,
                string_agg(hex(d.b[prev:a - 1]), '' ORDER BY a) AS kept
         FROM piece p JOIN d ON d.doc_id = p.doc_id GROUP BY p.doc_id)
SELECT d.doc_id, octet_length(b)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
       CASE WHEN cut.doc_id IS NULL THEN sha256(b) ELSE sha256(unhex(kept || hex(b[z:]))) END AS kept_sha256
FROM d LEFT JOIN cut ON d.doc_id = cut.doc_id""",
    "op10_decontamination": f"""
WITH d AS (SELECT doc_id, coalesce({_OP10_WORDS}, []) AS w FROM documents),
 b AS (SELECT item_id, {_OP10_WORDS} AS w FROM benchmark WHERE text IS NOT NULL),
 bw AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS t
        FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
 dw AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS t
        FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw))),
 hit AS (SELECT doc_id, i, n, item_id FROM dw JOIN bw USING (n, t)),
 word AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
 item AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items
          FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN word USING (doc_id) LEFT JOIN item USING (doc_id)""",
}
