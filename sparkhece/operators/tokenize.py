"""Rule tokenizers: the compatible one (Arrow UDF) and helpers on token tables."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkhece.functions import rules
from sparkhece.functions.text import clean_tokens

_ENTITIES = [(n, re.compile(p)) for n, p in (("URL", rules.URL), ("EMAIL", rules.EMAIL), ("HASHTAG", rules.HASHTAG), ("MENTION", rules.MENTION))]
_HELD = re.compile(r"URL|EMAIL|HASHTAG|MENTION")


def _stand_in(text: str) -> tuple[str, list[tuple[str, str]]]:
    """Entities replaced by numbered stand-ins, one kind after the other."""
    swaps: list[tuple[str, str]] = []
    for kind, pattern in _ENTITIES:
        for entity in [m.group() for m in pattern.finditer(text)]:
            swaps.append((f"___{kind}_{len(swaps)}___", entity))
            text = text.replace(entity, swaps[-1][0], 1)
    return text, swaps


def _join_phrases(text: str, phrases: list[str]) -> str:
    """Spaces of known phrases become ``_``; a phrase must stand free of alphanumerics."""
    for phrase in phrases:
        small, low, at = phrase.lower(), text.lower(), 0
        while (at := low.find(small, at)) >= 0:
            end = at + len(small)
            if (at == 0 or not text[at - 1 : at].isalnum()) and not text[end : end + 1].isalnum():
                text = text[:at] + text[at:end].replace(" ", "_") + text[end:]
                low = text.lower()
            at = end
    return text


def tokens_of(text: str | None, phrases: list[str] | None = None) -> list[str]:
    """Tokens of a text, with the stand-in order that lets an entity inside another one leak its stand-in."""
    if not text:
        return []
    text, swaps = _stand_in(text)
    if phrases:
        text = _join_phrases(text, phrases)
    out: list[str] = []
    for piece in text.split():
        if "___" in piece and _HELD.search(piece):
            out.append(piece)
            continue
        a, b = 0, len(piece)
        while a < b and not (piece[a].isalnum() or piece[a] == "_"):
            a += 1
        while b > a and not (piece[b - 1].isalnum() or piece[b - 1] == "_"):
            b -= 1
        out += piece[:a]
        if a < b:
            out.append(piece[a:b])
        out += piece[b:]
    for held, entity in swaps:
        out = [t.replace(held, entity) for t in out]
    return out


def rule_tokens(text: Column | str, phrases: list[str] | None = None, mode: str = "compat") -> Column:
    """Tokens as ``array<string>``; ``mode="clean"`` stays native and never leaks stand-ins."""
    text = F.col(text) if isinstance(text, str) else text
    if mode == "clean":
        if phrases:
            raise ValueError("phrases need the compatible mode")
        return clean_tokens(text)
    ordered = sorted(phrases or [], key=lambda p: (-len(p), p))

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda t: tokens_of(t, ordered))

    return F.pandas_udf(run, "array<string>")(text)


def explode_tokens(df: DataFrame, tokens: Column, keys: list[str]) -> DataFrame:
    """Rows ``(keys, pos, token)``; documents without tokens give none."""
    return df.select(*keys, F.posexplode(tokens).alias("pos", "token"))


def on_distinct(tokens: DataFrame, column: str, work, *outs: str) -> DataFrame:
    """Apply ``work(distinct)`` to the distinct values of a token column and join its columns back.

    ``work`` gets a one-column frame and returns it with the columns ``outs``. Corpora repeat
    their words, so a search or a Python call per distinct word is a fraction of one per token.
    """
    done = work(tokens.select(F.col(column).alias("_v")).where("_v IS NOT NULL").distinct())
    return tokens.join(done, F.col(column) == F.col("_v"), "left").select(*tokens.columns, *outs)
