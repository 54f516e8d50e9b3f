"""Suffix-stripping stemmer: breadth-first search over removals, on distinct tokens."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkhece.functions.rules import VOWELS

_BACK, _FRONT = frozenset("aıou"), frozenset("eiöü")
_HARD = {"b": "p", "c": "ç", "d": "t", "ğ": "k", "g": "k"}
_TENTHS = {"FUNCTIONAL": 3, "INFLECTIONAL": 1, "DERIVATIONAL": -1}


@dataclass
class Stemmer:
    """Suffixes with categories, and the lexicon of valid stems (both bounded lists, broadcast with the UDF).

    Suffixes are tried longest first, then in alphabetical order; forms of equal score go by
    the order in which the search met them, and the shortest fallback by (length, text).
    """

    suffixes: dict[str, str]
    lexicon: frozenset[str] = frozenset()
    least: int = 2
    depth: int = 10
    order: list[str] = field(init=False)

    def __post_init__(self) -> None:
        self.order = sorted(self.suffixes, key=lambda s: (-len(s), s))

    @staticmethod
    def variants(stem: str, suffix: str) -> list[str]:
        """A stem and the forms it may have had before the suffix changed it."""
        if not stem:
            return [stem]
        out, last, before = [stem], stem[-1], stem[-2:-1]
        if last in _HARD:
            out.append(stem[:-1] + _HARD[last])
        if before and last not in VOWELS and before not in VOWELS:
            out += [stem[:-1] + v + last for v in "ıiuü"]
        if before == last and last in "kpçtfsşh":
            out.append(stem[:-1])
        if len(stem) > 2 and (last == "n" and suffix[:1] in tuple(VOWELS) or last == "y" and before in VOWELS):
            out.append(stem[:-1])
        if stem[-2:] in ("su", "sü"):
            out += [stem[:-1] + "yu", stem[:-1] + "yü"]
        return list(dict.fromkeys(out))

    @staticmethod
    def harmony(stem: str, suffix: str) -> bool:
        """The last vowel of the stem and the first of the suffix are both front or both back; without vowels any pair fits."""
        a = next((c for c in reversed(stem) if c in VOWELS), None)
        b = next((c for c in suffix if c in VOWELS), None)
        return a is None or b is None or (a in _BACK) == (b in _BACK)

    def tenths(self, stem: str, removed: list[str]) -> int:
        """Score of a valid stem in tenths."""
        own = sum(_TENTHS.get(self.suffixes.get(s, "INFLECTIONAL"), 1) for s in removed)
        return 120 - 5 * abs(len(stem) - 5) + own - 50 * (len(stem) < 3)

    def search(self, word: str) -> tuple[list[tuple[int, str, list[str]]], list[str], int]:
        """Valid stems best first, all forms met, and how many were examined."""
        queue, met, valid, examined = deque([(word, [], 0)]), {word: None}, [], 0
        while queue:
            form, removed, depth = queue.popleft()
            if depth >= self.depth:
                continue
            examined += 1
            if form in self.lexicon and len(form) >= self.least:
                valid.append((self.tenths(form, removed), form, removed))
            for suffix in self.order:
                base = form[: -len(suffix)]
                if not form.endswith(suffix) or len(base) < self.least or not self.harmony(base, suffix):
                    continue
                for v in self.variants(base, suffix):
                    if v not in met and len(v) >= self.least:
                        met[v] = None
                        queue.append((v, [*removed, suffix], depth + 1))
        valid.sort(key=lambda x: -x[0])
        return valid, list(met), examined

    def stem(self, word: str | None) -> str | None:
        if not word:
            return word
        low = word.lower()
        valid, met, _ = self.search(low)
        if valid:
            return valid[0][1]
        short = min(met, key=lambda f: (len(f), f))
        return short if len(short) < len(low) else low

    def details(self, word: str | None) -> dict:
        if not word:
            return {"original": word, "stem": word, "removed_suffixes": [], "suffix_categories": [], "score": 0.0, "valid": False, "alternative_stems": [], "total_paths_explored": 0}
        valid, met, examined = self.search(word.lower())
        if not valid:
            short = min(met, key=lambda f: (len(f), f))
            return {"original": word, "stem": short, "removed_suffixes": [], "suffix_categories": [], "score": 0.0, "valid": short in self.lexicon, "alternative_stems": [], "total_paths_explored": examined}
        told = [{"stem": s, "removed_suffixes": r, "suffix_categories": [self.suffixes.get(x, "INFLECTIONAL") for x in r], "score": t / 10} for t, s, r in valid[:3]]
        return {"original": word, **told[0], "valid": True, "alternative_stems": told[1:], "total_paths_explored": examined}


_ONE = "stem string, removed_suffixes array<string>, suffix_categories array<string>, score double"
DETAILS = f"original string, {_ONE}, valid boolean, alternative_stems array<struct<{_ONE.replace(' string', ':string').replace(' array', ':array').replace(' double', ':double')}>>, total_paths_explored int"


def stem_column(token: Column | str, stemmer: Stemmer) -> Column:
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(stemmer.stem)

    return F.pandas_udf(run, "string")(F.col(token) if isinstance(token, str) else token)


def details_column(token: Column | str, stemmer: Stemmer) -> Column:
    """The best stem with its analysis, as a struct."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        names = ["original", "stem", "removed_suffixes", "suffix_categories", "score", "valid", "alternative_stems", "total_paths_explored"]
        for s in batches:
            yield pd.DataFrame([stemmer.details(w) for w in s], columns=names)

    return F.pandas_udf(run, DETAILS)(F.col(token) if isinstance(token, str) else token)


def category_statistics(suffixes: DataFrame) -> DataFrame:
    """``(category, n, percentage, examples)`` of a suffix table; examples in the order of removal."""
    n = suffixes.agg(F.count(F.lit(1)).alias("_n"))
    rows = suffixes.withColumn("_k", F.struct(-F.length("suffix"), "suffix"))
    per = rows.groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.slice(F.array_sort(F.collect_list("_k")), 1, 5).alias("_e"))
    return per.crossJoin(F.broadcast(n)).select("category", "n", (F.col("n") * 100 / F.col("_n")).alias("percentage"), F.col("_e.suffix").alias("examples"))
