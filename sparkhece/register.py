"""SQL names for the functions of this package."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from sparkhece.operators.sentences import split_text
from sparkhece.operators.stem import Stemmer
from sparkhece.operators.tokenize import tokens_of


def register(spark: SparkSession, stemmer: Stemmer | None = None, phrases: list[str] | None = None) -> None:
    """Publish ``tr_*`` functions in the session.

    Scalar SQL functions are SQL expressions and stay in Catalyst; ``tr_tokens_rule``, ``tr_stem`` and
    ``tr_accent_text`` run in Arrow batches; ``tr_sentences`` is a table function.
    """
    for name, body in {
        "tr_lower": "lower(translate(s, 'Iİ', 'ıi'))",
        "tr_upper": "upper(translate(s, 'ıi', 'Iİ'))",
        "tr_capitalize": "concat(upper(translate(substring(s, 1, 1), 'ıi', 'Iİ')), lower(translate(substring(s, 2), 'Iİ', 'ıi')))",
        "tr_fold": "translate(s, 'şçğüöıî', 'scguoii')",
        "tr_consonants": "regexp_replace(lower(s), '[aeıioöuü]', '')",
    }.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(s STRING) RETURNS STRING RETURN {body}")
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION tr_tokens(s STRING) RETURNS ARRAY<STRING> RETURN "
        "filter(regexp_extract_all(lower(translate(s, 'Iİ', 'ıi')), '([\\\\p{L}\\\\p{N}_]+)', 1), t -> t rlike '^[a-zçğıöşü]+$')"
    )

    def tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda t: tokens_of(t, phrases))

    def sentences(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(split_text)

    spark.udf.register("tr_tokens_rule", F.pandas_udf(tokens, "array<string>"))
    spark.udf.register("tr_sentence_array", F.pandas_udf(sentences, "array<string>"))
    if stemmer is not None:

        def stems(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for s in batches:
                yield s.map(stemmer.stem)

        spark.udf.register("tr_stem", F.pandas_udf(stems, "string"))
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION tr_sentences(s STRING) RETURNS TABLE (sent_no INT, sentence STRING) RETURN "
        "SELECT p.pos, p.col FROM (SELECT posexplode(tr_sentence_array(s))) p"
    )
