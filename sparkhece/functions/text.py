"""Words, tokens, rewriting rules and skeletons as Catalyst expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkhece.functions import rules
from sparkhece.functions.case import tr_lower

WORD = r"[\p{L}\p{N}_]"
_EMPTY = F.array


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _array(x: Column) -> Column:
    return F.coalesce(x, F.array().cast("array<string>"))


def corpus_tokens(text: Column | str) -> Column:
    """Lower-cased words made of Turkish letters only; other word runs give no token. Null gives none."""
    whole = rf"(?<!{WORD})([a-zçğıöşü]++)(?!{WORD})"  # a word run of these letters alone
    return _array(F.regexp_extract_all(tr_lower(_col(text)), F.lit(whole), F.lit(1)))


def words_and_gaps(text: Column | str) -> Column:
    """The text cut into alternating word runs and everything between them; joined they give the text."""
    return _array(F.regexp_extract_all(_col(text), F.lit(rf"({WORD}+|[^\p{{L}}\p{{N}}_]+)"), F.lit(1)))


def spaced_tokens(text: Column | str) -> Column:
    """Pieces between runs of Unicode white space."""
    return _array(F.filter(F.split(_col(text), r"(?U)\s+"), lambda t: t != ""))


def clean_tokens(text: Column | str) -> Column:
    """Rule tokens by one expression: entities are kept whole, of other pieces the edges are peeled off, mark by mark.

    An entity must be the whole of a piece between white space; text without entities gives the
    same tokens as the compatible tokenizer.
    """
    entity = rf"(?<!(?U:\S))(?:{rules.URL}|[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{{2,}}|[#@]{WORD}+)(?!(?U:\S))"
    core = rf"{WORD}(?:(?U:\S)*{WORD})?"
    return _array(F.regexp_extract_all(_col(text), F.lit(rf"({entity}|{core}|(?U:\S))"), F.lit(1)))


def text_id(text: Column | str) -> Column:
    """A 128-bit name of a text. Results that depend on the text alone are grouped by it, so repeated and null keys do no harm."""
    t = _col(text)
    return F.struct(F.xxhash64(t).alias("a"), F.xxhash64(F.lit(1), t).alias("b"))


def unique(tokens: Column | str) -> Column:
    """Distinct tokens in order of first occurrence."""
    return F.array_distinct(_col(tokens))


def _rewrite(x: Column, pattern: str, to: str) -> Column:
    body = pattern.replace(r"\w", WORD)
    # a rule's ending stands at a word's end, and its greedy word part begins at a word's start
    return F.regexp_replace(x, rf"(?<!{WORD}){body}(?!{WORD})", to)


def accent(text: Column | str, groups: list[str] | None = None) -> Column:
    """Colloquial verb forms to standard ones: the rule groups in order, each rule on the result of the one before.

    Unknown group names are ignored. Values without any ending that a rule knows pass unchanged
    through one test.
    """
    x = _col(text)
    names = ["negative", "future", "present", "question", "other"] if groups is None else groups
    chain = [r for g in names for r in rules.ACCENT.get(g, [])]
    changed = reduce(lambda c, r: _rewrite(c, *r), chain, x)
    return F.when(x.rlike(rules.ACCENT_GUARD), changed).otherwise(x)


def consonants(word: Column | str) -> Column:
    """The lower-cased word without its vowels."""
    return F.regexp_replace(F.lower(_col(word)), f"[{rules.VOWELS}]", "")


def segments(word: Column | str) -> Column:
    """Runs of one consonant and the vowels behind it; leading vowels are a run of their own."""
    return _array(F.regexp_extract_all(F.lower(_col(word)), F.lit(rf"(^[{rules.VOWELS}]+|[^{rules.VOWELS}][{rules.VOWELS}]*)"), F.lit(1)))


def vowel_additions(word: Column | str, candidate: Column | str) -> Column:
    """Vowels that the candidate has more than the word."""
    vowels = lambda c: F.length(F.regexp_replace(F.lower(_col(c)), f"[^{rules.VOWELS}]", ""))
    return vowels(candidate) - vowels(word)


def vowel_pattern(word: Column | str) -> Column:
    """A regular expression for words that add at most one vowel before each consonant but the first.

    A word that starts with a vowel and has a consonant matches nothing; so does the empty word.
    """
    w = F.lower(_col(word))
    head, rest = F.substring(w, 1, 1), F.substring(w, 2, 1 << 30)
    rest = F.regexp_replace(rest, rf"([^{rules.VOWELS}])", rf"[{rules.VOWELS}]?\\Q$1\\E")
    starts_bad = head.rlike(f"^[{rules.VOWELS}]$") & (consonants(w) != "")
    return F.when((w == "") | starts_bad, F.lit("(?!)")).otherwise(F.concat(F.lit(r"^\Q"), head, F.lit(r"\E"), rest, F.lit("$")))


def fold(word: Column | str) -> Column:
    """Turkish letters to their ASCII look-alikes."""
    return F.translate(_col(word), rules.FOLD_FROM, rules.FOLD_TO)


def turkish_letters(word: Column | str) -> Column:
    """How many letters that only Turkish has."""
    w = _col(word)
    return F.length(w) - F.length(F.translate(w, rules.TURKISH, ""))


def candidate_score(word: Column | str, known: Column) -> Column:
    """10 for a known word, 2 for a common ending, 0.5 for each Turkish letter."""
    w = _col(word)
    return F.when(known, 10.0).otherwise(0.0) + F.when(F.lower(w).rlike("(yor|miş|muş|mış)$"), 2.0).otherwise(0.0) + 0.5 * turkish_letters(w)
