"""Language ID: multinomial naive Bayes over hashed character n-grams.

Training counts n-grams of 1 to ``orders`` characters in all training rows, in Spark: each
task yields one row per language and non-empty bucket, and the sums are collected as a matrix
of ``languages x buckets`` (bounded by the model's size, not by the data; more than
``MAX_LANGS`` languages are an error). The matrix of log probabilities is broadcast and whole
texts are scored in batches in numpy, a long text piece by piece.

Defined results: null text or a text without any letter (Unicode category L) gives ``und``
and score 0; rows with null text or null language are not learned from; repeated rows count
as often as they occur, and so do rows that give one text several languages; ties go to the
language that sorts first; without any training row every text is ``und``; an empty table
gives an empty table. Texts may be of any length. Extra columns may have any name, but for
the one named ``out``, which is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 14
ORDERS = 3
MAX_LANGS = 512
PIECE = 1 << 18  # characters whose n-grams are hashed at once
_GOLD = np.uint32(2654435761)


def pieces(texts: list[str], orders: int = ORDERS, most: int = PIECE) -> Iterator[list[tuple[int, str, int]]]:
    """Batches of ``(text number, characters, how many of them n-grams start at)`` of about ``most`` characters.

    Texts are lower-cased and followed by blanks, so every character starts an n-gram of each
    order, and none reaches into another text.
    """
    run, size = [], 0
    for i, t in enumerate(texts):
        t = t.lower()
        for at in range(0, len(t), most):
            n = min(most, len(t) - at)
            run.append((i, t[at : at + n + orders - 1].ljust(n + orders - 1), n))
            size += n
            if size >= most:
                yield run
                run, size = [], 0
    if run:
        yield run


def ngrams(batch: list[tuple[int, str, int]], buckets: int = BUCKETS, orders: int = ORDERS) -> list[np.ndarray]:
    """For each order, the bucket of every n-gram of the pieces, in order."""
    codes = np.frombuffer("".join(p for _, p, _ in batch).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    tail = orders - 1
    ends = np.cumsum([n + tail for _, _, n in batch])
    starts = np.ones(len(codes), dtype=bool)
    for k in range(1, orders):
        starts[ends - k] = False  # what follows a piece is only read
    out, h = [], np.zeros(len(codes), dtype=np.uint32)
    for n in range(orders):
        keep = len(codes) - n
        h = (h[:keep] * np.uint32(16777619)) ^ (codes[n:] + np.uint32(n * 97 + 1))
        own = h[: len(codes) - tail][starts[: len(codes) - tail]] if tail else h
        mixed = (own ^ (own >> np.uint32(15))) * _GOLD
        out.append((mixed >> np.uint32(8)) % np.uint32(buckets))
    return out


@dataclass
class Model:
    """Languages in order and log probabilities, prior in the last column."""

    langs: list[str]
    logp: np.ndarray  # (buckets, languages)
    prior: np.ndarray


def train(df: DataFrame, text: str = "text", lang: str = "lang", buckets: int = BUCKETS, orders: int = ORDERS) -> Model:
    """Counts over all rows of ``df`` that have text and language, with add-half smoothing."""
    df = df.select(F.col(text).alias("t"), F.col(lang).cast("string").alias("l")).where("t IS NOT NULL AND l IS NOT NULL")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        rows: dict[str, int] = {}
        for batch in batches:
            for label, part in batch.groupby("l")["t"]:
                mine = sums.setdefault(label, np.zeros(buckets, dtype=np.int64))
                rows[label] = rows.get(label, 0) + len(part)
                for some in pieces(part.tolist(), orders):
                    for h in ngrams(some, buckets, orders):
                        mine += np.bincount(h, minlength=buckets)
        for label, mine in sums.items():
            at = np.append(np.flatnonzero(mine), buckets)
            yield pd.DataFrame({"l": label, "bucket": at, "n": np.append(mine[at[:-1]], rows[label])})

    if df.select("l").distinct().limit(MAX_LANGS + 1).count() > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages")
    got = df.mapInPandas(count, "l string, bucket int, n long").groupBy("l", "bucket").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(got["l"].unique())
    counts, prior = np.zeros((buckets, len(langs))), np.ones(len(langs))
    for k, label in enumerate(langs):
        own = got[got["l"] == label]
        is_prior = own["bucket"] == buckets
        prior[k] = own.loc[is_prior, "n"].sum()
        counts[own.loc[~is_prior, "bucket"], k] = own.loc[~is_prior, "n"]
    logp = np.log(counts + 0.5) - np.log(counts.sum(axis=0) + 0.5 * buckets)
    return Model(langs, logp, np.log(prior / prior.sum()) if langs else prior)


def predict(texts: list[str | None], model: Model, orders: int = ORDERS) -> tuple[list[str], np.ndarray]:
    """Language and posterior probability of each text."""
    n, k = len(texts), len(model.langs)
    known = np.array([bool(t) and any(map(str.isalpha, t)) for t in texts], dtype=bool)
    if not k or not known.any():
        return ["und"] * n, np.zeros(n)
    rows = [t for t, ok in zip(texts, known, strict=True) if ok]
    total = np.tile(model.prior, (len(rows), 1))
    for some in pieces(rows, orders):
        starts = np.concatenate([[0], np.cumsum([m for _, _, m in some])[:-1]])
        of = np.array([i for i, _, _ in some])
        for h in ngrams(some, len(model.logp), orders):
            np.add.at(total, of, np.add.reduceat(model.logp[h], starts, axis=0))
    best = total.argmax(axis=1)
    post = 1.0 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
    langs, score = np.full(n, "und", dtype=object), np.zeros(n)
    langs[known] = np.array(model.langs, dtype=object)[best]
    score[known] = post
    return langs.tolist(), score


def identify(df: DataFrame, model: Model, text: Column | str = "text", out: str = "lang_id") -> DataFrame:
    """Add a struct ``(lang_pred, score)`` for every whole text."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            langs, score = predict(s.tolist(), shared.value)
            yield pd.DataFrame({"lang_pred": langs, "score": score})

    return df.withColumn(out, F.pandas_udf(run, "lang_pred string, score double")(text))
