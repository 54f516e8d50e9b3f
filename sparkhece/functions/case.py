"""Turkish-aware letter case as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def tr_lower(x: Column | str) -> Column:
    """Lower case with I -> ı and İ -> i."""
    return F.lower(F.translate(_col(x), "Iİ", "ıi"))


def tr_upper(x: Column | str) -> Column:
    """Upper case with ı -> I and i -> İ."""
    return F.upper(F.translate(_col(x), "ıi", "Iİ"))


def tr_capitalize(x: Column | str) -> Column:
    """First letter up, the rest down; the empty string stays."""
    x = _col(x)
    return F.concat(tr_upper(F.substring(x, 1, 1)), tr_lower(F.substring(x, 2, 1 << 30)))


def is_lower(x: Column | str) -> Column:
    x = _col(x)
    return x == tr_lower(x)


def is_upper(x: Column | str) -> Column:
    x = _col(x)
    return x == tr_upper(x)


def is_proper(x: Column | str) -> Column:
    """First letter is upper case and the rest is lower case; false for the empty string."""
    x = _col(x)
    first, rest = F.substring(x, 1, 1), F.substring(x, 2, 1 << 30)
    return (x != "") & (first == tr_upper(first)) & (rest == tr_lower(rest))


def case_transform(x: Column | str) -> Column:
    """Case normalisation of a token.

    A capitalised token with an apostrophe stays; other tokens with an apostrophe or a full stop
    are capitalised unless they are proper already; what remains is lower-cased.
    """
    x = _col(x)
    quote, marked = x.contains("'"), x.contains("'") | x.contains(".")
    return (
        F.when(x == "", x)
        .when(is_proper(x) & quote, x)
        .when(is_lower(x), F.when(marked, tr_capitalize(x)).otherwise(x))
        .when(is_proper(x), tr_lower(x))
        .when(marked, tr_capitalize(x))
        .otherwise(tr_lower(x))
    )


def match_case(corrected: Column | str, original: Column | str) -> Column:
    """The case pattern of ``original`` given to ``corrected``, by plain (not Turkish) rules."""
    c, o = _col(corrected), _col(original)
    has_case = F.upper(o) != F.lower(o)
    first = F.substring(o, 1, 1)
    first_up = (first == F.upper(first)) & (first != F.lower(first))
    title = F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substring(c, 2, 1 << 30)))
    return F.when(has_case & (o == F.upper(o)), F.upper(c)).when(first_up & (F.length(o) > 1), title).otherwise(F.lower(c))
