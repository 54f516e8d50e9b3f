"""Quality evaluation as aggregations."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def _f1(p: Column, r: Column) -> Column:
    return F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0))


def token_scores(predicted: Column, gold: Column, distinct: bool = False) -> Column:
    """Struct ``(exact, precision, recall, f1)``.

    Hits are distinct common tokens; the denominators are list lengths, or set sizes with
    ``distinct``.
    """
    hits = F.size(F.array_intersect(predicted, gold))
    size = (lambda a: F.size(F.array_distinct(a))) if distinct else F.size
    p, r = _ratio(hits, size(predicted)), _ratio(hits, size(gold))
    return F.struct((predicted == gold).alias("exact"), p.alias("precision"), r.alias("recall"), _f1(p, r).alias("f1"))


def macro(df: DataFrame, scores: str = "scores") -> DataFrame:
    """Means over samples, accuracy as the share of exact matches, and counts."""
    s = lambda k: F.col(f"{scores}.{k}")
    return df.agg(
        F.count(F.lit(1)).alias("n"), F.avg(s("exact").cast("double")).alias("accuracy"), F.avg(s("precision")).alias("precision"),
        F.avg(s("recall")).alias("recall"), F.avg(s("f1")).alias("f1"), F.sum((~s("exact")).cast("long")).alias("errors"),
    )


def first_errors(df: DataFrame, order: str, scores: str = "scores", n: int = 20) -> DataFrame:
    return df.where(~F.col(f"{scores}.exact")).orderBy(order).limit(n)


def report(means: DataFrame) -> DataFrame:
    """The lines ``(line_no, line)`` of a metric block, from a ``macro`` table."""
    shown = [("Samples", F.col("n").cast("string")), ("Errors", F.col("errors").cast("string"))]
    shown += [(k.capitalize(), F.format_string("%.4f", k)) for k in ("accuracy", "precision", "recall", "f1")]
    lines = F.array(*[F.concat(F.lit(f"{name}: "), value) for name, value in shown])
    return means.select(F.posexplode(lines).alias("line_no", "line"))


def attempt(work: Callable[[str], str], value: Column | str) -> Column:
    """``work`` of every value in batches; a value on which it raises gives null, which ``status`` reports as ERROR."""

    def one(x: str | None) -> str | None:
        try:
            return work(x)
        except Exception:  # whatever the rule raises: the row is the error
            return None

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([one(x) for x in s], dtype=object)

    return F.pandas_udf(run, "string")(F.col(value) if isinstance(value, str) else value)


def compare(a: DataFrame, b: DataFrame, names: tuple[str, str]) -> DataFrame:
    """Per metric the two values and the winner, or ``Tie``; inputs are ``macro`` tables."""
    metrics = ["accuracy", "precision", "recall", "f1"]
    long = lambda d, v: d.select(F.stack(F.lit(4), *[x for m in metrics for x in (F.lit(m), F.col(m))]).alias("metric", v))
    both = long(a, "first").join(long(b, "second"), "metric")
    win = F.when(F.col("first") > F.col("second"), names[0]).when(F.col("first") < F.col("second"), names[1]).otherwise("Tie")
    return both.withColumn("winner", win)


def accuracy(pairs: DataFrame, output: str = "output", expected: str = "expected") -> DataFrame:
    """``(total, passed, errors, accuracy_pct, ok)``; values are trimmed, null output is an error, ok above 80 percent."""
    same = F.trim(output) == F.trim(expected)
    rate = _ratio(F.sum(F.coalesce(same, F.lit(False)).cast("int")) * 100.0, F.count(F.lit(1)))
    return pairs.agg(
        F.count(F.lit(1)).alias("total"), F.sum(F.coalesce(same, F.lit(False)).cast("long")).alias("passed"),
        F.sum(F.col(output).isNull().cast("long")).alias("errors"), rate.alias("accuracy_pct"), (rate > 80).alias("ok"),
    )


def status(output: Column, expected: Column) -> Column:
    return F.when(output.isNull(), "ERROR").when(F.trim(output) == F.trim(expected), "PASS").otherwise("FAIL")


def ablation(results: DataFrame, config: str = "config", baseline: str = "full") -> DataFrame:
    """``(config, accuracy_pct, impact, importance)`` of rows ``(config, output, expected)`` against the baseline."""
    ok = F.coalesce(F.trim("output") == F.trim("expected"), F.lit(False)).cast("double")
    per = results.groupBy(config).agg((F.avg(ok) * 100).alias("accuracy_pct"))
    base = per.where(F.col(config) == baseline).select(F.col("accuracy_pct").alias("_b"))
    out = per.crossJoin(F.broadcast(base)).withColumn("impact", F.col("accuracy_pct") - F.col("_b"))
    label = F.when(F.col("impact") < -5, "CRITICAL").when(F.col("impact") < -2, "HIGH").when(F.col("impact") < -0.5, "MEDIUM").otherwise("LOW")
    return out.select(config, "accuracy_pct", "impact", label.alias("importance"))


def vocabulary(tokens: DataFrame, column: str = "token") -> DataFrame:
    return tokens.agg(F.countDistinct(column).alias("vocabulary"))


def reduction(before: Column, after: Column) -> Column:
    """Percent by which ``after`` is less than ``before``."""
    return _ratio((before - after) * 100.0, before)


def coverage(tokens: Column, stop: list[str]) -> tuple[Column, Column]:
    """Aggregates: how many tokens are stop words, and their percentage."""
    hit = F.sum(F.size(F.filter(tokens, lambda t: t.isin(*stop))) if stop else F.lit(0))
    return hit.alias("stop_tokens"), _ratio(hit * 100.0, F.sum(F.size(tokens))).alias("coverage_pct")


def difference_size(a: DataFrame, b: DataFrame) -> DataFrame:
    """How many distinct rows of ``a`` are not in ``b``."""
    return a.subtract(b).agg(F.count(F.lit(1)).alias("n"))
