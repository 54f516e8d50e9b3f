"""Quality classifier: Bradley-Terry ranking of documents by preference pairs.

A document has strength ``w . x`` with ``x`` its standardised features. Every pair of a
preferred (label 1) and a rejected (label 0) document gives one logistic loss on the
feature difference; the loss is minimised by gradient descent with momentum. The strength
that cuts off the rejected share of the training rows (a score quantile) is mapped to the
decision threshold, so ``sigmoid(strength - cut + logit(threshold)) >= threshold`` exactly
where the strength reaches the quantile.

Features use only the whole text. Training takes at most ``max_train`` labelled rows (least
key hash) and ``max_pairs`` pairs of them. Defined results: null text has the features of
the empty text; rows with null label are not learned from; a key with several labels or texts
is learned from once for each, in the order of the hashes of key and text and then of the
label; with one label only (or none) all weights are 0 and every document scores 0.5; equal
scores are kept or rejected together. An empty table gives an empty table; texts may be of any
length. Extra columns may have any name, but for the one named ``out``, which is replaced.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkhece.llm.common import labelled_sample

THRESHOLD = 0.3
MAX_TRAIN = 20_000
MAX_PAIRS = 200_000
NAMES = (
    "words", "word_len", "symbols", "upper", "digits", "bars", "runs", "shout", "distinct_words", "distinct_lines",
    "dup_line_chars", "deflate", "stops", "line_len", "top_word", "distinct_trigrams", "not_letters", "short",
)
_SYMBOL = b"*#$%&|<>{}[]=~^@\\_+"
_UPPER = bytes(range(65, 91))
_DIGIT = b"0123456789"
_RUN = re.compile(r"[*#$%&!@^~]{2,}")


def features(text: str | None) -> list[float]:
    """The feature vector (``NAMES``) of a whole text."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    n = max(1, len(raw))
    words = text.split()
    m = max(1, len(words))
    lines = [x for x in text.split("\n") if x.strip()]
    seen = set(lines)
    dup = len(text) - sum(map(len, seen)) - max(0, len(lines) - 1) if len(lines) > len(seen) else 0
    lower = [w.lower() for w in words]
    triples = set(zip(lower, lower[1:], lower[2:]))
    counts: dict[str, int] = {}
    for w in lower:
        counts[w] = counts.get(w, 0) + 1

    def share(chars: bytes) -> float:
        return (len(raw) - len(raw.translate(None, chars))) / n

    upper = share(_UPPER)
    return [
        math.log1p(len(words)), min(20.0, len(text) / m), share(_SYMBOL), upper, share(_DIGIT), share(b"|") * n / m,
        len(_RUN.findall(text)) / m, text.count("!!") / m, len(counts) / m, len(seen) / max(1, len(lines)),
        dup / n, len(zlib.compress(raw, 1)) / (n + 20), share(b".,;") * n / m, math.log1p(n / max(1, len(lines))),
        max(counts.values(), default=0) / m, len(triples) / max(1, len(words) - 2),
        1 - sum(map(str.isalpha, lower)) / m, float(len(words) < 5),
    ]


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    shift: float  # added to the strength before the sigmoid

    def score(self, x: np.ndarray) -> np.ndarray:
        s = _expand((x - self.mean) / self.scale) @ self.weight + self.shift
        return 1.0 / (1.0 + np.exp(-np.clip(s, -35, 35)))


def _expand(x: np.ndarray) -> np.ndarray:
    """Standardised features, clipped, and their squares (a feature may be best in the middle)."""
    x = np.clip(x, -6.0, 6.0)
    return np.concatenate([x, x * x], axis=1)


def fit(x: np.ndarray, y: np.ndarray, threshold: float = THRESHOLD, max_pairs: int = MAX_PAIRS, steps: int = 400, l2: float = 1e-4, seed: int = 7) -> Model:
    """Bradley-Terry weights from the preference pairs of labelled feature rows."""
    mean = x.mean(axis=0) if len(x) else np.zeros(len(NAMES))
    scale = x.std(axis=0) if len(x) else np.ones(len(NAMES))
    scale = np.where(scale > 1e-9, scale, 1.0)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    weight = np.zeros(2 * len(NAMES))
    if not len(good) or not len(bad):
        return Model(mean, scale, weight, 0.0)
    z = _expand((x - mean) / scale)
    rng = np.random.default_rng(seed)
    each = max(1, min(64, max_pairs // len(bad)))
    lose = np.repeat(bad, each)[:max_pairs]
    win = rng.choice(good, size=len(lose))
    diff = z[win] - z[lose]
    velocity = np.zeros_like(weight)
    rate = 4.0 / (np.square(diff).sum(axis=1).mean() + 1e-9)
    for _ in range(steps):
        p = 1.0 / (1.0 + np.exp(np.clip(diff @ weight, -35, 35)))
        velocity = 0.9 * velocity + rate * (diff.T @ p / len(diff) - l2 * weight)
        weight = weight + velocity
    strength = z @ weight
    cut = float(np.quantile(strength, len(bad) / len(y)))
    return Model(mean, scale, weight, math.log(threshold / (1 - threshold)) - cut)


def _features(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in texts:
        yield s.map(features)


def with_features(df: DataFrame, text: str = "text", out: str = "x") -> DataFrame:
    return df.withColumn(out, F.pandas_udf(_features, "array<double>")(F.col(text)))


def train(docs: DataFrame, labels: DataFrame, text: str = "text", label: str = "quality", key: str = "doc_id", max_train: int = MAX_TRAIN, **params) -> Model:
    """Fit on the texts of at most ``max_train`` rows of ``labels(key, label)``."""
    rows = labelled_sample(docs, labels, key, text, label, max_train, salt=3)
    got = with_features(rows, "t").select("k", "k2", "y", "x").orderBy("k", "k2", "y").limit(max_train).collect()
    return fit(np.array([r["x"] for r in got]).reshape(-1, len(NAMES)), np.array([r["y"] for r in got]), **params)


def score(df: DataFrame, model: Model, text: str = "text", out: str = "quality_score") -> DataFrame:
    """Add the probability-like score of every whole text."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            x = np.array([features(t) for t in s]).reshape(-1, len(NAMES))
            yield pd.Series(shared.value.score(x))

    return df.withColumn(out, F.pandas_udf(run, "double")(F.col(text)))
