"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are the distinct hashed words, adjacent pairs and pairs that skip one
word, of the whole lower-cased text. Training runs on the driver over at most
``max_train`` labelled rows (those with the least key hash, so the choice does not depend
on partitions); per-coordinate rates and the L1 term leave few non-zero weights, which are
broadcast as sorted arrays. Scoring covers every whole text.

Defined results: null and empty texts score the intercept's probability; rows with null
label or null text are not learned from; a key with several labels or texts is learned from
once for each, in the order of the hashes of key and text and then of the label; without
training rows every score is 0.5; an empty table gives an empty table. Extra columns may have
any name, but for the one named ``out``, which is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkhece.llm.common import labelled_sample, materialize

BITS = 20
MAX_TRAIN = 12_000
MIN_ROWS = 4  # a feature of fewer training rows keeps weight 0 under the L1 term; it is left out beforehand
_PUNCT = bytes(32 if (c < 48 or 57 < c < 65 or 90 < c < 97 or 122 < c < 128) else c + 32 * (65 <= c <= 90) for c in range(256))


def hashed(text: str | None, bits: int = BITS) -> np.ndarray:
    """Sorted distinct feature numbers of a text (below ``2**bits``)."""
    words = (text or "").lower().encode("utf-8", "surrogatepass").translate(_PUNCT).split()
    h = np.fromiter(map(crc32, words, repeat(0)), dtype=np.uint32, count=len(words))
    pairs = h[:-1] * np.uint32(0x9E3779B1) + h[1:] + np.uint32(1)
    skips = h[:-2] * np.uint32(0x85EBCA6B) + h[2:] + np.uint32(2)
    all_ = np.concatenate([h, pairs, skips])
    all_ = (all_ ^ (all_ >> np.uint32(16))) * np.uint32(0xC2B2AE35)
    return np.unique(all_ >> np.uint32(32 - bits))


@dataclass
class Model:
    """Non-zero weights by sorted feature number, and the intercept."""

    index: np.ndarray
    weight: np.ndarray
    bias: float
    bits: int = BITS


def fit(rows: list[np.ndarray], labels: list[int], bits: int = BITS, epochs: int = 4, alpha: float = 2.0, beta: float = 1.0, l1: float = 10.0, l2: float = 0.0) -> Model:
    """FTRL-proximal in row order. The intercept is a coordinate without L1."""
    size = 1 << bits
    z, n = np.zeros(size + 1), np.zeros(size + 1)
    seen = np.zeros(size, dtype=np.int32)
    for x in rows:
        seen[x] += 1
    rows = [x[seen[x] >= MIN_ROWS] for x in rows]
    for _ in range(epochs):
        for x, y in zip(rows, labels, strict=True):
            at = np.append(x, size)
            zi, ni = z[at], n[at]
            lasso = np.full(len(at), l1)
            lasso[-1] = 0.0
            wi = np.where(np.abs(zi) <= lasso, 0.0, -(zi - np.sign(zi) * lasso) / ((beta + np.sqrt(ni)) / alpha + l2))
            p = 1.0 / (1.0 + np.exp(-np.clip(wi.sum(), -35, 35)))
            g = p - y
            sigma = (np.sqrt(ni + g * g) - np.sqrt(ni)) / alpha
            z[at] = zi + g - sigma * wi
            n[at] = ni + g * g
    lasso = np.full(size + 1, l1)
    lasso[-1] = 0.0
    w = np.where(np.abs(z) <= lasso, 0.0, -(z - np.sign(z) * lasso) / ((beta + np.sqrt(n)) / alpha + l2))
    index = np.flatnonzero(w[:-1])
    return Model(index.astype(np.uint32), w[index], float(w[-1]), bits)


def _features(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in texts:
        yield s.map(lambda t: hashed(t).astype(np.int32))


def train(docs: DataFrame, labels: DataFrame, text: str = "text", label: str = "toxic", key: str = "doc_id", max_train: int = MAX_TRAIN, **params) -> Model:
    """Fit on the texts of at most ``max_train`` rows of ``labels(key, label)``."""
    rows = labelled_sample(docs, labels, key, text, label, max_train, salt=9)
    rows = materialize(rows.select("k", "k2", "y", F.pandas_udf(_features, "array<int>")("t").alias("x")), "toxic-rows")
    often = rows.select(F.explode("x").alias("f")).groupBy("f").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= MIN_ROWS)
    bits = often.groupBy(F.shiftright("f", 5).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, f & 31)")).alias("bits"))
    masks = np.zeros((1 << BITS) >> 5, dtype="<u4")
    for r in bits.collect():  # at most 2**BITS / 32 rows
        masks[r["at"]] = r["bits"]
    kept = np.unpackbits(masks.view(np.uint8), bitorder="little").astype(bool)
    kept = docs.sparkSession.sparkContext.broadcast(kept)

    def packed(lists: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in lists:
            yield s.map(lambda x: x[kept.value[x]].astype(np.uint32).tobytes())

    got = rows.select("k", "k2", "y", F.pandas_udf(packed, "binary")("x").alias("x")).orderBy("k", "k2", "y").limit(max_train).collect()
    if not got:
        return Model(np.zeros(0, np.uint32), np.zeros(0), 0.0)
    return fit([np.frombuffer(r["x"], dtype=np.uint32) for r in got], [r["y"] for r in got], **params)


def score_texts(texts: list[str | None], model: Model) -> np.ndarray:
    out = np.empty(len(texts))
    table = np.zeros(1 << model.bits)
    table[model.index] = model.weight
    for i, t in enumerate(texts):
        out[i] = model.bias + table[hashed(t, model.bits)].sum()
    return 1.0 / (1.0 + np.exp(-np.clip(out, -35, 35)))


def score(df: DataFrame, model: Model, text: str = "text", out: str = "toxicity") -> DataFrame:
    """Add the probability of the toxic label for every whole text."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series(score_texts(s.tolist(), shared.value))

    return df.withColumn(out, F.pandas_udf(run, "double")(text))
