"""Sentence splitters: the rule state machine (with or without its quote stack) and relational naive Bayes."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkhece.functions import rules
from sparkhece.sources.shared import stored

_MARK = ".!?"
_CLOSERS = {'"': '"', "'": "'", "«": "»", ",": " "}  # a comma opens what the next blank closes
_KNOWN = frozenset(rules.ABBREVIATIONS)
_BLANK = "".join(chr(c) for c in (*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))  # Unicode white space


def _abbreviated(text: str, i: int) -> bool:
    a = i
    while a > 0 and (text[a - 1].isalnum() or text[a - 1] == "."):
        a -= 1
    word = text[a:i].lower()
    plain = word.replace(".", "")
    return plain in _KNOWN or (len(plain) == 1 and plain.isalpha()) or ("." in word and len(plain) <= 4)


def _next(text: str, i: int) -> int:
    """The place of the first character behind ``i`` that is no blank, or the text's length."""
    i += 1
    while i < len(text) and text[i].isspace():
        i += 1
    return i


def _ends(text: str, i: int) -> bool:
    """Whether the mark at ``i`` ends a sentence outside quotes."""
    c, after = text[i], text[i + 1 : i + 2]
    if c == "." and text[max(0, i - 2) : i + 1] == "..." and after != ".":
        return True
    if c == "." and (_abbreviated(text, i) or (i > 0 and text[i - 1].isdigit() and after.isdigit())):
        return False
    if after and after in _MARK:
        return False
    k = _next(text, i)
    if text[k : k + 1] == '"':
        k = _next(text, k)
        behind = text[k : k + 1]
        if behind and not (behind.isupper() or behind in _CLOSERS):
            return False
    return True


def split_text(text: str | None, quotes: bool = True) -> list[str]:
    """Sentences of a text. ``quotes=False`` drops the quote stack (the stateless rule)."""
    if not text:
        return []
    text = " ".join(text.split())
    out, stack, start = [], [], 0
    for i, c in enumerate(text):
        cut = False
        if quotes and c in _CLOSERS:
            stack.append(_CLOSERS[c])
        elif quotes and stack and c == stack[-1]:
            stack.pop()
            k = _next(text, i)
            nxt = text[k : k + 1]
            cut = i > 0 and text[i - 1] in _MARK and (not nxt or (nxt.isupper() or nxt in _CLOSERS) and nxt not in _MARK)
        elif c in _MARK and not stack:
            cut = _ends(text, i)
        if cut:
            piece = text[start : i + 1].strip()
            start = i + 1
            if piece:
                out.append(piece)
    if rest := text[start:].strip():
        out.append(rest)
    return out


def rule_sentences(text: Column | str, mode: str = "compat") -> Column:
    """Sentences as ``array<string>``; ``mode="clean"`` leaves out the quote stack, which straight quotes and apostrophes never close."""
    text = F.col(text) if isinstance(text, str) else text

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda t: split_text(t, mode != "clean"))

    return F.pandas_udf(run, "array<string>")(text)


# ---- naive Bayes -------------------------------------------------------------------------

def _kind(c: str, marks: bool) -> str:
    if c.isspace():
        return "SPACE"
    if c.isupper():
        return "UPPER"
    if c.islower():
        return "LOWER"
    if c.isdigit():
        return "DIGIT"
    if c in "\"'":
        return "QUOTE"
    return "PUNCT" if marks and c in _MARK else "OTHER"


def _word_kind(word: str) -> str:
    if word.replace(",", "").replace(".", "").isdigit():
        return "NUMBER"
    if len(word) <= 3 and word.isupper():
        return "ABBREV"
    if word.islower():
        return "LOWER"
    return "CAPITAL" if word[0].isupper() else "OTHER"


def mark_features(text: str, i: int) -> list[str]:
    """What naive Bayes sees of the mark at ``i``; neighbours are read locally, so a text costs linear time."""
    nxt, behind = text[i + 1 : i + 2], text[i + 2 : i + 3]
    out = [f"curr_char={text[i]}", f"next_char={_kind(nxt, True) if nxt else 'END'}"]
    if nxt.isspace() and behind:
        kind = _kind(behind, True)
        out.append(f"after_space={kind if kind in ('UPPER', 'LOWER', 'DIGIT', 'PUNCT') else 'OTHER'}")
    out.append(f"prev_char={_kind(text[i - 1], False) if i else 'START'}")
    k = i + 1
    while k < len(text) and text[k].isspace():
        k += 1
    out.append(f"next_word_capital={text[k : k + 1].isupper()}")
    b = i
    while b and text[b - 1].isspace():
        b -= 1
    a = b
    while a and not text[a - 1].isspace():
        a -= 1
    if a < b:
        out.append(f"prev_word={_word_kind(text[a:b])}")
    return out


_SPOTS = "array<struct<pos:int,features:array<string>>>"


def nb_features(df: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """Rows ``(keys, pos, feature)``: the features of every ``. ! ?`` (``pos`` counts from 0)."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda t: [{"pos": i, "features": mark_features(t, i)} for i, c in enumerate(t or "") if c in _MARK])

    spots = df.select(*keys, F.explode(F.pandas_udf(run, _SPOTS)(F.col(text))).alias("_s"))
    return spots.select(*keys, F.col("_s.pos").alias("pos"), F.explode("_s.features").alias("feature"))


def _with_next(rows: DataFrame) -> DataFrame:
    """``(s, ex)`` with the next sentence ``n`` in the order of the whole table, without one task for all of it.

    Rows are dealt out by ranges of the order and stored; the last of a range is followed by
    the first of the next range that has any.
    """
    dealt = stored(rows.repartitionByRange("ex").withColumn("_p", F.spark_partition_id()), "ordered")
    heads = dealt.groupBy("_p").agg(F.min_by("s", "ex").alias("_s"))
    heads = heads.select("_p", F.lead("_s").over(Window.orderBy("_p")).alias("_after"))  # a row for each range
    last = F.lead("ex").over(Window.partitionBy("_p").orderBy("ex")).isNull()
    inner = dealt.select("s", "ex", "_p", F.lead("s").over(Window.partitionBy("_p").orderBy("ex")).alias("n"), last.alias("_last"))
    return inner.join(F.broadcast(heads), "_p").select("s", "ex", F.when(F.col("_last"), F.col("_after")).otherwise(F.col("n")).alias("n"))


def nb_examples(sentences: DataFrame, sentence: str = "sentence", order: str = "line_no", group: str | None = None) -> DataFrame:
    """Training marks ``(ex, class, _t, _i)`` of a table of sentences in order.

    In each sentence the last mark is a boundary and those before it are not. Each pair of
    neighbours, written together without and with a blank, gives a boundary where the first ends in
    a mark. ``group`` keeps neighbours within documents; without it the order is one of the
    whole table.
    """
    s = sentences.select(F.trim(F.col(sentence)).alias("s"), F.col(order).alias("ex"), *([F.col(group).alias("_g")] if group else []))
    s = s.withColumn("n", F.lead("s").over(Window.partitionBy("_g").orderBy("ex"))) if group else _with_next(s)
    marks = F.expr("filter(sequence(1, greatest(length(s), 1)), i -> substring(s, i, 1) IN ('.', '!', '?'))")
    inner = s.select("ex", F.col("s").alias("_t"), F.explode(marks).alias("_i"), F.array_max(marks).alias("_last"))
    inner = inner.select("ex", F.when(F.col("_i") == F.col("_last"), "boundary").otherwise("non_boundary").alias("class"), "_t", "_i")
    pairs = s.where(F.col("n").isNotNull() & F.col("s").rlike("[.!?]$"))
    pairs = pairs.select("ex", F.lit("boundary").alias("class"), F.explode(F.array(F.concat("s", "n"), F.concat_ws(" ", "s", "n"))).alias("_t"), F.length("s").alias("_i"))
    return inner.union(pairs)


def nb_train(examples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Model tables ``(class, feature, n)`` and ``(class, n)``."""

    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, places in batches:
            yield pd.Series([mark_features(t, i - 1) for t, i in zip(texts, places, strict=True)])

    told = examples.select("class", F.explode(F.pandas_udf(run, "array<string>")("_t", "_i")).alias("feature"))
    features = told.groupBy("class", "feature").agg(F.count(F.lit(1)).alias("n"))
    return features, examples.groupBy("class").agg(F.count(F.lit(1)).alias("n"))


def nb_weights(features: DataFrame, classes: DataFrame) -> tuple[DataFrame, float]:
    """Per feature the log odds of a boundary, with the odds of unseen features and the prior folded in.

    Collects two class counts and the vocabulary's size; the weights stay a table (bounded by the
    features' kinds).
    """
    n = {r["class"]: r["n"] for r in classes.collect()}
    total = {r["class"]: r["n"] for r in features.groupBy("class").agg(F.sum("n").alias("n")).collect()}
    vocab = features.select("feature").distinct().count()
    if not vocab:
        raise ValueError("no training examples")
    def prior(c: str) -> float:
        return math.log(n[c] / sum(n.values())) if n.get(c) else -1000.0

    unseen = {c: math.log(1.0 / (total.get(c, 0) + vocab)) for c in ("boundary", "non_boundary")}
    odds = lambda c: F.log((F.coalesce(F.sum(F.when(F.col("class") == c, F.col("n"))), F.lit(0)) + 1) / F.lit(float(total.get(c, 0) + vocab)))
    table = features.groupBy("feature").agg((odds("boundary") - odds("non_boundary")).alias("w"))
    return table, prior("boundary") - prior("non_boundary"), unseen["boundary"] - unseen["non_boundary"]


def nb_predict(marks: DataFrame, model: tuple, keys: list[str]) -> DataFrame:
    """``(keys, pos, boundary)`` for feature rows ``(keys, pos, feature)``; a tie is no boundary."""
    table, prior, unseen = model
    scored = marks.join(F.broadcast(table), "feature", "left").groupBy(*keys, "pos").agg(F.sum(F.coalesce("w", F.lit(unseen))).alias("s"))
    return scored.select(*keys, "pos", (F.round(F.col("s") + prior, 9) > 0).alias("boundary"))


def nb_sentences(text: Column | str, model: tuple) -> Column:
    """Sentences as ``array<string>``: the text cut behind boundary marks; blank pieces are dropped.

    Marks are scored within the row. The weights travel with the function: one for each of the
    feature strings that ``mark_features`` can give, a few dozen whatever the corpus.
    """
    table, prior, unseen = model
    weight = {r["feature"]: r["w"] for r in table.collect()}

    def cut(t: str | None) -> list[str]:
        out, start = [], 0
        for i, c in enumerate(t or ""):
            if c in _MARK and round(sum(weight.get(f, unseen) for f in mark_features(t, i)) + prior, 9) > 0:
                out.append(t[start : i + 1])
                start = i + 1
        return [p for p in (x.strip(_BLANK) for x in [*out, (t or "")[start:]]) if p]

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(cut)

    return F.pandas_udf(run, "array<string>")(F.col(text) if isinstance(text, str) else text)


def nb_split(df: DataFrame, text: str, keys: list[str], model: tuple) -> DataFrame:
    """Rows ``(keys, sent_no, sentence)`` of ``nb_sentences``."""
    return df.select(*keys, F.posexplode(nb_sentences(text, model)).alias("sent_no", "sentence"))
