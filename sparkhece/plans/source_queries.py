"""Queries of the readers and writers: each writes a file from the tables to the shared folder and reads it by a loader."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkhece.functions import rules, text
from sparkhece.operators import mltok, sentences, tokenize
from sparkhece.plans import samples
from sparkhece.plans.samples import values
from sparkhece.sources import lexicons
from sparkhece.sources.shared import shared_path

_CATEGORIES = [*samples.SUFFIXES[:20], ("-lık-", " derivational "), ("-ki", "functional"), ("ler", "Functional"), ("-", "INFLECTIONAL"), ("xyz", "unknown"), *samples.SUFFIXES[24:]]
_EXTRA = ["-ceğiz", "LER", "-", "acak-", "acak"]
_ABBREV = ["Dr.: doktor", "prof: profesör: ünvan", "no colon", ": empty", "empty:  ", "dr.: Doktor"]


def _pieces(spark: SparkSession, sf: str, name: str = "benchmark") -> DataFrame:
    """One piece between blanks a row, as lines of a file."""
    return spark.read.parquet(f"{sf}/{name}.parquet").select(F.explode(text.spaced_tokens("text")).alias("value"))


def _written(spark: SparkSession, lines: DataFrame, name: str) -> str:
    path = shared_path(spark, name)
    lines.write.text(path)
    return path


def _rows(spark: SparkSession, rows: list[str]) -> DataFrame:
    return spark.createDataFrame([(r,) for r in rows], "value string").coalesce(1)


def phrases(spark, sf):
    lines = spark.read.parquet(f"{sf}/benchmark.parquet").select(F.concat(F.lit("  "), F.array_join(F.slice(text.spaced_tokens("text"), 1, 3), " "), F.lit(" ")).alias("value"))
    return lexicons.phrases(spark, _written(spark, lines.union(_rows(spark, ["", "  "])), "phrases"))


def lexicon(spark, sf):
    return lexicons.lexicon(spark, _written(spark, _pieces(spark, sf), "lexicon"))


def frequency_lexicon(spark, sf):
    return lexicons.frequency_lexicon(spark, _written(spark, _pieces(spark, sf, "conversations"), "frequencies"))


def lexicon_missing(spark, sf):
    return lexicons.lexicon_or_corrections(spark, shared_path(spark, "missing"))


def stopwords(spark, sf):
    return lexicons.stopwords(spark, _written(spark, _pieces(spark, sf), "stopwords"), distinct=True)


def stopword_sink(spark, sf):
    path = shared_path(spark, "words")
    lexicons.write_words(_pieces(spark, sf).distinct().withColumnRenamed("value", "word"), path)
    return lexicons.lines(spark, path)


def suffixes(spark, sf):
    path = shared_path(spark, "suffixes")
    samples.frame(spark, _CATEGORIES, "word string, category string").coalesce(1).write.option("header", True).csv(path)
    return lexicons.suffixes(spark, path)


def extra_suffixes(spark, sf):
    return lexicons.with_extra_suffixes(suffixes(spark, sf), samples.frame(spark, _EXTRA, "word string"))


def abbreviations(spark, sf):
    return lexicons.abbreviations(spark, _written(spark, _rows(spark, _ABBREV), "abbreviations"))


def corpus_sentences(spark, sf):
    lines = spark.read.parquet(f"{sf}/benchmark.parquet").select(F.explode(sentences.rule_sentences("text", "clean")).alias("value"))
    return lexicons.sentences(spark, _written(spark, lines, "sentences")).select("sentence")


def annotated(spark, sf):
    flat = F.replace("text", F.lit("\n"), F.lit(" "))
    tokens = F.transform(tokenize.rule_tokens(flat), lambda t: F.concat(F.lit("'"), F.regexp_replace(t, r"(['\\])", r"\\$1"), F.lit("'")))
    lines = spark.read.parquet(f"{sf}/benchmark.parquet").select(F.concat(flat, F.lit(", ["), F.array_join(tokens, ", "), F.lit("]")).alias("value"))
    path = _written(spark, lines, "annotated")
    return lexicons.annotated(lexicons.lines(spark, path, column="value")).select("text", F.array_join("tokens", "␟").alias("tokens"))


def test_pairs(spark, sf):
    path = shared_path(spark, "pairs")
    samples.frame(spark, samples.ACCURACY, "erroneous string, correct string").coalesce(1).write.option("header", True).csv(path)
    return lexicons.test_pairs(spark, path).select("input", "expected")


def result_sink(spark, sf):
    path = shared_path(spark, "results")
    lexicons.write_results(spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality"), path)
    return spark.read.option("header", True).schema("doc_id long, quality int").csv(path)


def file_to_file(spark, sf):
    source, sink = _written(spark, _pieces(spark, sf), "source"), shared_path(spark, "sink")
    lexicons.tokenize_file(spark, source, sink, lambda c: tokenize.rule_tokens(c))
    return lexicons.lines(spark, sink, column="line")


def bayes_model(spark, sf):
    from sparkhece.plans.queries import nb_model

    path = shared_path(spark, "bayes")
    lexicons.save_model({"features": nb_model(spark, sf)}, path)
    return lexicons.load_model(spark, path, ["features"])["features"]


def boundary_model(spark, sf):
    """Boundaries predicted by a stored and loaded model; the training is iterative and has no SQL twin."""
    gold = spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text", tokenize.rule_tokens("text").alias("tokens"))
    path = shared_path(spark, "boundaries")
    lexicons.save_pipeline(mltok.train(mltok.labelled(gold, keys=["item_id"]), iterations=30), path)
    return mltok.tokenize(gold, lexicons.load_pipeline(path), keys=["item_id"]).select("item_id", F.array_join("tokens", "␟").alias("tokens"))


def analyser(spark, sf):
    """Every word of a text answered with one analysis, by a stand-in for the analyser's client."""
    words = spark.read.parquet(f"{sf}/benchmark.parquet").select(F.col("item_id").alias("doc_id"), "text")
    told = lexicons.analyses_from(words, lambda t: "\n".join(f"{w}\n\t{w}+Noun" for w in t.split()))
    return told.distinct()


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "source_phrases": phrases, "source_lexicon": lexicon, "source_frequency_lexicon": frequency_lexicon, "source_lexicon_missing": lexicon_missing, "source_stopwords": stopwords,
    "source_stopword_sink": stopword_sink, "source_suffixes": suffixes, "source_extra_suffixes": extra_suffixes, "source_abbreviations": abbreviations, "source_sentences": corpus_sentences,
    "source_annotated": annotated, "source_test_pairs": test_pairs, "source_result_sink": result_sink, "source_file_to_file": file_to_file, "source_bayes_model": bayes_model,
    "source_boundary_model": boundary_model, "source_analyser": analyser,
}


def queries_sql(parts: dict, own: dict[str, str]) -> dict[str, str]:
    """The SQL twins; ``own`` are those of the other queries."""
    pieces = lambda table: f"SELECT unnest(regexp_extract_all(text, '{parts['pieces']}')) AS x FROM {table}"
    bench = parts["sentences"].replace("documents", "benchmark").replace("doc_id", "item_id")
    kind = "CASE WHEN upper(trim(category)) IN ('DERIVATIONAL', 'FUNCTIONAL') THEN upper(trim(category)) ELSE 'INFLECTIONAL' END"
    rank = "CASE category WHEN 'DERIVATIONAL' THEN 1 WHEN 'INFLECTIONAL' THEN 2 ELSE 3 END"
    clean = "regexp_replace(trim({}), '^-|-$', '', 'g')"
    known = f"sx AS (SELECT suffix, arg_min(category, {rank}) AS category FROM (SELECT {clean.format('word')} AS suffix, {kind} AS category FROM {values(_CATEGORIES, 'word, category')}) WHERE suffix <> '' GROUP BY suffix)"
    rows = f"r AS (SELECT row_number() OVER () AS k, v FROM {values(_ABBREV, 'v')})"
    tokens = f"({parts['rule_tokens']('(SELECT replace(text, chr(10), chr(32)) AS text FROM benchmark)', 'text', False)})"
    fixes = values(sorted(set(rules.CORRECTIONS.values())), "word")
    return {
        "source_phrases": f"SELECT array_to_string(w[1:3], ' ') AS mwe FROM (SELECT regexp_extract_all(text, '{parts['pieces']}') AS w FROM benchmark) WHERE len(w) > 0",
        "source_lexicon": f"SELECT DISTINCT lower(x) AS word FROM ({pieces('benchmark')})",
        "source_frequency_lexicon": f"SELECT x AS word, count(*) AS freq FROM ({pieces('conversations')}) GROUP BY x",
        "source_lexicon_missing": f"SELECT word FROM {fixes}",
        "source_stopwords": f"SELECT DISTINCT lower(x) AS word FROM ({pieces('benchmark')})",
        "source_stopword_sink": f"SELECT DISTINCT x AS word FROM ({pieces('benchmark')})",
        "source_suffixes": f"WITH {known} SELECT suffix, category FROM sx",
        "source_extra_suffixes": f"WITH {known} SELECT suffix, category FROM sx UNION ALL SELECT suffix, 'INFLECTIONAL' FROM (SELECT DISTINCT {clean.format('lower(word)')} AS suffix FROM {values(_EXTRA, 'word')}) WHERE suffix <> '' AND suffix NOT IN (SELECT suffix FROM sx)",
        "source_abbreviations": f"WITH {rows}, c AS (SELECT k, lower(trim(split_part(v, ':', 1))) AS abbr, trim(substr(v, strpos(v, ':') + 1)) AS f FROM r WHERE contains(v, ':')) SELECT abbr, arg_max(f, k) AS full_form FROM c WHERE abbr <> '' AND f <> '' GROUP BY abbr",
        "source_sentences": f"WITH {bench} SELECT trim(sentence) AS sentence FROM numbered",
        "source_annotated": f"SELECT trim(text) AS text, array_to_string(w, '␟') AS tokens FROM {tokens}",
        "source_test_pairs": f"SELECT trim(input) AS input, trim(expected) AS expected FROM {values(samples.ACCURACY, 'input, expected')}",
        "source_result_sink": "SELECT doc_id, quality::INT AS quality FROM labels",
        "source_file_to_file": f"SELECT array_to_string(w, ' ') AS line FROM ({parts['rule_tokens'](f"({pieces('benchmark')}) AS p(text)", 'text', False)})",
        "source_bayes_model": own["nb_model"],
        "source_analyser": f"SELECT DISTINCT item_id AS doc_id, x AS word, x || '+Noun' AS analysis FROM (SELECT item_id, unnest(regexp_extract_all(text, '{parts['pieces']}')) AS x FROM benchmark)",
    }
