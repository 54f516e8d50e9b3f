"""Mixing sources to target weights by soft membership, with DataFrame functions only.

A classifier learned from a labelled table gives each document posterior probabilities of the
domains: multinomial naive Bayes over counts of character sequences. The sequences are learned:
of all runs of 1 to 3 characters in a sample of labelled texts those that tell most about the
domain (mutual information) are taken; their odds are counted in the whole text of all
labelled rows. Document rates ``r >= 0`` (expected copies) then minimise the squared distance
between the expected token totals ``sum_i r_i t_i p_i`` and the targets by projected gradient
steps. The distance is weighted by the inverse of the domains' curvature ``G = sum_i t_i p_i p_i'``
and the step is scaled per document by its tokens, which gives the whole problem the curvature
1: the step is 1, and one round is enough where no rate reaches zero:

    r_i <- max(0, r_i - p_i' G^-1 residual)

Each round is one aggregate of as many sums as there are domains. Rates are a fold over the
residuals so far, written out every ``cut`` rounds to keep expressions short; nothing else is
collected. Rounds end when the targets are met, or when the distance no longer falls (no
nonnegative rates meet them); at ``rounds`` rounds the fit gives up, and says so
(``converged``). ``copies`` rounds the rate up or down by a hash of the document.

Bounds: the sequences are learned from ``SAMPLE`` labelled rows at most (those of least key
hash), all else covers all rows; ``N_FEATURES`` rows of counts and at most ``MAX_DOMAINS``
domains reach the driver.

Defined results: null text has no tokens and the posteriors of the prior; documents whose
text is null or empty keep rate 1 unless their posterior says otherwise; null labels and null
keys are not learned from, and of conflicting labels of one key the least counts; repeated
rows are counted and rated each; without labels there is one domain ``all``; targets of
unknown domains are ignored and the others are scaled to 1; more than ``max_domains`` domains
are an error; equal posteriors name the domain that sorts last; an empty table gives an empty
table. Only the named columns are read, so others may have any name.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkhece.llm.common import discard, materialize

N_FEATURES, SAMPLE, MAX_DOMAINS = 32, 2_000, 64
ROUNDS, TOLERANCE, CUT, STALLED = 200, 1e-5, 15, 1e-7


def _low(text: Column) -> Column:
    return F.lower(F.coalesce(text, F.lit("")))


def counts(text: Column, features: list[str]) -> list[Column]:
    """Occurrences of each sequence in the lower-cased text."""
    low = _low(text)
    return [
        ((F.octet_length(low) - F.octet_length(F.replace(low, F.lit(f), F.lit("")))) / F.lit(len(f.encode()))).cast("long").alias(f"f{i}")
        for i, f in enumerate(features)
    ]


def tokens(text: Column) -> Column:
    """Words: runs without white space."""
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")).cast("long")


def _sum(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)


def learn_features(texts: DataFrame, domains: list[str], n: int = N_FEATURES) -> list[str]:
    """The ``n`` runs of 1 to 3 letters of ``texts (_d, _t)`` that tell most about the domain; ties by the run itself."""
    chars = texts.select("_d", F.split(_low(F.col("_t")), "").alias("c"))
    runs = lambda k: F.when(F.size("c") >= k, F.transform(F.sequence(F.lit(0), F.size("c") - k), lambda i: F.concat(*[F.get("c", i + j) for j in range(k)])))
    every = F.concat(*[F.coalesce(runs(k), F.array().cast("array<string>")) for k in (1, 2, 3)])
    grams = chars.select("_d", F.explode(every).alias("g")).where(r"g rlike '^\\p{L}+$'")
    grams = materialize(grams.groupBy("g").agg(*[F.count(F.when(F.col("_d") == d, True)).alias(f"n{i}") for i, d in enumerate(domains)]), "mix-grams")
    k = range(len(domains))
    totals = grams.agg(*[F.coalesce(F.sum(f"n{i}"), F.lit(0)).alias(f"n{i}") for i in k]).first()
    whole = sum(totals) or 1
    share = [max(1, t) / whole for t in totals]
    seen = _sum([F.col(f"n{i}") for i in k])
    told = _sum([F.when(F.col(f"n{i}") > 0, F.col(f"n{i}") * F.log(F.col(f"n{i}") / (seen * share[i]))).otherwise(0.0) for i in k])
    top = [r["g"] for r in grams.orderBy(F.desc(F.round(told, 6)), "g").limit(n).collect()]
    discard(grams)
    return sorted(top)


def posteriors(docs: DataFrame, labelled: DataFrame, key: str = "doc_id", text: str = "text", domain: str = "domain", n_features: int = N_FEATURES, sample: int = SAMPLE, max_domains: int = MAX_DOMAINS) -> tuple[DataFrame, list[str]]:
    """``(key, _t, p0, p1, ...)`` for every document, and the domains in order.

    ``labelled`` has ``key`` and ``domain``.
    """
    own, body = F.col(f"`{key}`"), F.col(f"`{text}`")
    told = labelled.where(F.col(f"`{domain}`").isNotNull() & F.col(f"`{key}`").isNotNull()).groupBy(F.col(f"`{key}`").alias("_k")).agg(F.min(F.col(f"`{domain}`").cast("string")).alias("_d"))
    told = materialize(told, "mix-labels")
    names = sorted(r[0] for r in told.select("_d").distinct().limit(max_domains + 1).collect())
    if len(names) > max_domains:
        raise ValueError(f"more than {max_domains} domains")
    if not names:
        return docs.select(own.alias(key), tokens(body).alias("_t"), F.lit(1.0).alias("p0")), ["all"]
    drawn = F.broadcast(told.orderBy(F.xxhash64(F.col("_k").cast("string"), F.lit(11)), "_k").limit(sample))
    features = learn_features(docs.select(own.alias("_key"), body.alias("_t")).join(drawn, F.col("_key") == F.col("_k")), names, n_features) or ["e"]
    n = len(features)
    marked = docs.select(own.alias(key), tokens(body).alias("_t"), *counts(body, features))
    marked = materialize(marked, "mix-counts")
    learned = marked.join(told, marked[key] == F.col("_k")).groupBy("_d").agg(F.sum("_t").alias("_t"), *[F.sum(f"f{i}").alias(f"f{i}") for i in range(n)])
    rows = sorted(learned.collect(), key=lambda r: r["_d"])
    discard(told)
    domains = [r["_d"] for r in rows] or ["all"]
    if not rows:
        return marked.select(key, "_t", F.lit(1.0).alias("p0")), domains
    total = sum(r["_t"] + 1 for r in rows)
    logits = []
    for r in rows:
        seen = sum(r[f"f{i}"] for i in range(n)) + n
        logits.append(math.log((r["_t"] + 1) / total) + _sum([F.col(f"f{i}") * math.log((r[f"f{i}"] + 1) / seen) for i in range(n)]))
    scored = marked.select(key, "_t", *[x.alias(f"z{d}") for d, x in enumerate(logits)])
    top = F.greatest(*[F.col(f"z{d}") for d in range(len(rows))]) if len(rows) > 1 else F.col("z0")
    scored = scored.select(key, "_t", *[F.exp(F.col(f"z{d}") - top).alias(f"e{d}") for d in range(len(rows))])
    norm = _sum([F.col(f"e{d}") for d in range(len(rows))])
    return scored.select(key, "_t", *[(F.col(f"e{d}") / norm).alias(f"p{d}") for d in range(len(rows))]), domains


def fit_rates(soft: DataFrame, weights: list[float], rounds: int = ROUNDS, tolerance: float = TOLERANCE, cut: int = CUT) -> tuple[DataFrame, list[float], list[float], bool]:
    """Add ``_rate`` to ``soft(_t, p0, ...)``; also the targets, the totals reached, and whether the fit ended by itself."""
    d = range(len(weights))
    pairs = [(a, b) for a in d for b in d if a <= b]
    first = soft.agg(F.coalesce(F.sum("_t"), F.lit(0)).alias("t"), *[F.coalesce(F.sum(F.col("_t") * F.col(f"p{a}") * F.col(f"p{b}")), F.lit(0.0)).alias(f"g{a}_{b}") for a, b in pairs]).first()
    targets = [w * first["t"] for w in weights]
    gram = [[float(first[f"g{min(a, b)}_{max(a, b)}"]) for b in d] for a in d]
    g = np.array(gram)
    inverse = np.linalg.inv(g + np.eye(len(weights)) * max(1e-9 * np.trace(g), 1e-9))
    cur, rate, since = soft.withColumn("_r", F.lit(1.0)), F.col("_r"), 0
    before = math.inf
    while True:
        got = cur.agg(*[F.coalesce(F.sum(F.col("_t") * F.col(f"p{a}") * rate), F.lit(0.0)).alias(f"a{a}") for a in d]).first()
        reached = [float(got[f"a{a}"]) for a in d]
        residual = [reached[a] - targets[a] for a in d]
        shift = inverse @ np.array(residual)
        distance = float(np.array(residual) @ shift)
        done = max(map(abs, residual)) <= tolerance * max(first["t"], 1) or distance >= before * (1 - STALLED)
        if done or rounds == 0:
            return cur.withColumn("_rate", rate).drop("_r"), targets, reached, done
        before = distance
        rate = F.greatest(F.lit(0.0), rate - _sum([F.col(f"p{a}") * float(shift[a]) for a in d]))
        rounds, since = rounds - 1, since + 1
        if since == cut:
            cur, rate, since = materialize(cur.withColumn("_r", rate), "mix-rates"), F.col("_r"), 0


def mix(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], key: str = "doc_id", text: str = "text", domain: str = "domain", rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> DataFrame:
    """``(key, tokens, domain, posterior, rate, copies, target_share, reached_share, converged)`` for every row of ``docs``.

    ``domain`` is the likeliest one; the shares are that domain's part of all expected tokens,
    as asked for and as fitted.
    """
    soft, domains = posteriors(docs, labelled, key, text, domain)
    weights = [max(0.0, float(targets.get(x, 0.0))) for x in domains]
    weights = [w / sum(weights) for w in weights] if sum(weights) > 0 else [1 / len(domains)] * len(domains)
    soft = materialize(soft, "mix-posteriors")
    rated, _, reached, converged = fit_rates(soft, weights, rounds, tolerance)
    whole = sum(reached) or 1.0
    best = F.array_max(F.array(*[F.struct(F.col(f"p{d}").alias("p"), F.lit(x).alias("d"), F.lit(weights[d]).alias("w"), F.lit(reached[d] / whole).alias("r")) for d, x in enumerate(domains)]))
    toss = F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit(5)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    rate = F.round("_rate", 9)
    return rated.select(
        F.col(key), F.col("_t").alias("tokens"), best["d"].alias("domain"), F.round(best["p"], 9).alias("posterior"), rate.alias("rate"), F.floor(rate + toss).cast("long").alias("copies"),
        F.round(best["w"], 9).alias("target_share"), F.round(best["r"], 9).alias("reached_share"), F.lit(converged).alias("converged"),
    )
