"""The registered queries against their SQL twins on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "documents pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not there")
NAMES = [
    "corpus_tokens", "tfidf", "stopwords_by_idf", "stopword_filter", "stopword_service", "stopword_evaluation", "case_transform", "tokenize_clean", "tokenize_unique",
    "entities", "abbrev_text", "accent_full", "diacritics", "vowels", "sentences_clean", "nb_features", "char_features", "token_macro", "morph_parse", "streaming_df", "sql_functions",
    "stems", "stem_details", "service_stem", "spelling", "spelling_corpus", "nb_model", "sentences_nb", "service_normalize", "normalize_text", "normalize_status", "accent_words",
    "diacritics_text", "proper_nouns", "sql_sentences", "source_suffixes", "source_extra_suffixes", "source_abbreviations", "source_annotated", "source_analyser", "source_file_to_file",
]


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(tuple(round(v, 6) if isinstance(v, float) else str(v) for v in r) for r in frame.itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, duck, name):
    assert rows(entry.queries()[name](spark, SF).toPandas()) == rows(duck.execute(entry.oracle_sql()[name]).fetchdf())


def test_entry_and_names(spark):
    assert entry.entry(spark).count() == 50
    assert set(entry.oracle_sql()) <= set(entry.queries())
