"""Token normalisation: abbreviations, case, diacritics, vowels, spelling, colloquial forms.

Lexicons are DataFrames. Lookups are joins on distinct tokens: on the ASCII fold for
diacritics, on the consonant skeleton for vowels. Spark picks a broadcast by the lexicon's
measured size and shuffles both sides on the key otherwise.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkhece.functions import rules
from sparkhece.functions.case import case_transform, match_case, tr_capitalize
from sparkhece.functions.text import accent, consonants, fold, spaced_tokens, text_id, turkish_letters, vowel_additions, vowel_pattern, words_and_gaps

MODULES = ("abbreviation", "case", "diacritics", "vowels", "spelling", "accent", "proper")


def corrections(spark: SparkSession) -> DataFrame:
    """The built-in word corrections as ``(wrong, right)``."""
    return spark.createDataFrame(list(rules.CORRECTIONS.items()), "wrong string, right string")


def expand_abbreviations(tokens: DataFrame, abbrev: DataFrame, column: str = "token", out: str = "expanded") -> DataFrame:
    """Whole tokens by their lower-cased form; others stay."""
    table = abbrev.select(F.col("abbr").alias("_a"), F.col("full_form").alias("_f"))
    return tokens.join(table, F.lower(column) == F.col("_a"), "left").select(*tokens.columns, F.coalesce("_f", column).alias(out))


def expand_text(docs: DataFrame, abbrev: DataFrame, text: str = "text", key: str = "doc_id", out: str = "expanded") -> DataFrame:
    """Abbreviations inside texts; separators stay as they are. Only alphabetic words are looked up."""
    return rewrite_words(docs, text, key, lambda t: expand_abbreviations(t, abbrev, "token", "_new"), r"^\p{L}+$", out)


def rewrite_words(docs: DataFrame, text: str, key: str, work, which: str, out: str) -> DataFrame:
    """Replace words in place: ``work`` maps distinct words ``(token)`` to ``(token, _new)``. Null text stays null.

    Pieces are gathered by text, not by ``key``, which may be null or repeat; pieces of equal
    texts fall together.
    """
    named = docs.withColumn("_id", text_id(text))
    pieces = named.select("_id", F.posexplode(words_and_gaps(text)).alias("_p", "token"))
    new = work(pieces.where(F.col("token").rlike(which)).select("token").distinct()).select(F.col("token").alias("_t"), "_new")
    joined = pieces.join(new, F.col("token") == F.col("_t"), "left")
    ordered = F.array_sort(F.collect_set(F.struct("_p", F.coalesce("_new", "token").alias("_w"))))
    whole = joined.groupBy("_id").agg(F.array_join(ordered["_w"], "").alias("_whole"))
    done = named.join(whole, "_id", "left").select(*docs.columns, F.when(F.col(text).isNotNull(), F.coalesce("_whole", text)).alias("_out"))
    return done.select(*[c for c in docs.columns if c != out], F.col("_out").alias(out))


def restore_diacritics(words: DataFrame, lexicon: DataFrame, column: str = "token", out: str = "restored") -> DataFrame:
    """``words`` with diacritics restored.

    Words with Turkish letters and single characters stay; then whole-word corrections; then
    known words stay; then of the lexicon words with the same fold the one with most Turkish
    letters, ties by the order in which variants are generated (plain before marked, left to right).
    """
    spark, low = words.sparkSession, F.lower(column)
    lex = lexicon.select(F.lower(F.trim("word")).alias("_w")).distinct()
    best = lex.select(fold("_w").alias("_fold"), "_w", turkish_letters("_w").alias("_n"))
    rank = F.translate("_w", "sşcçgğuüoöiıî", "0101010101012")
    first = Window.partitionBy("_fold").orderBy(F.desc("_n"), rank)
    best = best.withColumn("_k", F.row_number().over(first)).where("_k = 1").select("_fold", F.col("_w").alias("_best"))
    fixes = corrections(spark)
    joined = words.join(F.broadcast(fixes), low == F.col("wrong"), "left")
    joined = joined.join(lex.withColumnRenamed("_w", "_known"), low == F.col("_known"), "left").join(best, low == F.col("_fold"), "left")
    kept = F.when(F.col(column).rlike(f"[{rules.TURKISH}]") | (F.length(column) <= 1), F.col(column))
    new = kept.when(F.col("right").isNotNull(), match_case(F.col("right"), F.col(column)))
    new = new.when(F.col("_known").isNotNull(), F.col(column)).when(F.col("_best").isNotNull(), _cased(F.col("_best"), F.col(column)))
    return joined.select(*words.columns, new.otherwise(F.col(column)).alias(out))


def _cased(best: Column, original: Column) -> Column:
    """Letters of ``best`` in the case of ``original``, letter by letter with plain upper case."""
    pairs = F.zip_with(F.split(best, ""), F.split(original, ""), lambda b, o: F.when((o == F.upper(o)) & (o != F.lower(o)), F.upper(b)).otherwise(F.when(b == fold(F.lower(o)), o).otherwise(b)))
    return F.array_join(pairs, "")


def correct_by_list(words: DataFrame, column: str = "token", out: str = "corrected") -> DataFrame:
    """Whole-word corrections alone, in the case of the original."""
    joined = words.join(F.broadcast(corrections(words.sparkSession)), F.lower(column) == F.col("wrong"), "left")
    new = F.when(F.col("right").isNotNull(), match_case(F.col("right"), F.col(column))).otherwise(F.col(column))
    return joined.select(*words.columns, new.alias(out))


def diacritic_variants(word: str | None, most: int = 200) -> list[str]:
    """All spellings of a word with marked letters in place of plain ones, left to right; ``most`` after each letter."""
    if not word:
        return [] if word is None else [word]
    forms = [""]
    for c in word:
        low = c.lower()
        marked = {"i": "ıî"}.get(low, rules.DIACRITIC_PAIRS.get(low, ""))
        if not marked:
            forms = [f + c for f in forms]
            continue
        options = [o.upper() if c.isupper() else o for o in low + marked]
        forms = [f + o for f in forms for o in options][:most]
    return forms


def variants_column(token: Column | str, most: int = 200) -> Column:
    """``diacritic_variants`` as ``array<string>``. The join on folds in ``restore_diacritics`` needs no such list."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda w: diacritic_variants(w, most))

    return F.pandas_udf(run, "array<string>")(F.col(token) if isinstance(token, str) else token)


def restore_vowels(words: DataFrame, lexicon: DataFrame, column: str = "token", out: str = "restored") -> DataFrame:
    """Known words stay; else the lexicon word that adds the fewest vowels, ties alphabetically; else the word.

    The scan of the whole lexicon per word becomes an equi-join on the consonant skeleton.
    """
    lex = lexicon.select(F.lower(F.trim("word")).alias("_lw")).distinct()
    base = words.select(F.col(column).alias("_vw")).distinct()
    open_ = base.join(lex, F.lower("_vw") == F.col("_lw"), "left_anti").select("_vw", consonants("_vw").alias("_s"), vowel_pattern("_vw").alias("_r"))
    pairs = open_.join(lex.select("_lw", consonants("_lw").alias("_s")), "_s").where(F.expr("_lw rlike _r"))
    best = pairs.groupBy("_vw").agg(F.min(F.struct(vowel_additions("_vw", "_lw").alias("n"), F.col("_lw"))).alias("_b")).select("_vw", F.col("_b._lw").alias("_best"))
    return words.join(best, F.col(column) == F.col("_vw"), "left").select(*words.columns, F.coalesce("_best", column).alias(out))


# ---- spelling ----------------------------------------------------------------------------

def one_edit(word: str) -> Iterator[tuple[str, float]]:
    """Strings one edit away with their costs, in order: deletions, insertions, substitutions, transpositions."""
    n = len(word)
    for i in range(n):
        yield word[:i] + word[i + 1 :], 1.0
    for i in range(n + 1):
        for c in rules.ALPHABET:
            yield word[:i] + c + word[i:], 1.0
    for i in range(n):
        soft = rules.DIACRITIC_PAIRS.get(word[i].lower())
        for c in rules.ALPHABET:
            if c != word[i]:
                cheap = soft is not None and c in (soft, word[i].lower())
                yield word[:i] + c + word[i + 1 :], 0.3 if cheap else 1.0
    for i in range(n - 1):
        yield word[:i] + word[i + 1] + word[i] + word[i + 2 :], 1.0


def correct(word: str | None, prob: dict[str, float], distance: int = 2) -> str | None:
    """The lexicon word within ``distance`` edits of greatest P(w) / (1 + cost).

    A string keeps the cost at which it first comes up; ties go to the one that comes up first.
    Known words (case counts) and words without candidates stay.
    """
    if not word or word in prob:
        return word
    best, chosen, seen = -1.0, word, set()
    first = list(one_edit(word))

    def offer(c: str, cost: float) -> None:
        nonlocal best, chosen
        if c in prob and c not in seen:
            seen.add(c)
            if (score := prob[c] / (1 + cost)) > best:
                best, chosen = score, c

    for c, cost in first:
        offer(c, cost)
    if distance > 1:
        met: set[str] = set()
        for base, cost in first:
            for c, more in one_edit(base):
                if c not in met:
                    met.add(c)
                    offer(c, cost + more)
    return chosen


def word_probabilities(lexicon: DataFrame, word: str = "word", most: int = 5_000_000) -> dict[str, float]:
    """Relative frequencies of a frequency lexicon, for broadcast with the spelling UDF.

    ``lexicon`` has a row per occurrence or a ``freq`` column. A lexicon of more than ``most``
    words is refused rather than collected.
    """
    freq = F.sum("freq") if "freq" in lexicon.columns else F.count(F.lit(1))
    rows = lexicon.where(F.col(word).isNotNull()).groupBy(word).agg(freq.alias("n")).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"lexicon has more than {most} words")
    total = sum(r["n"] for r in rows)
    return {r[word]: r["n"] / total for r in rows}


def correct_spelling(words: DataFrame, lexicon: DataFrame, column: str = "token", out: str = "corrected", distance: int = 2) -> DataFrame:
    """Spelling correction of distinct unknown words; known ones never reach Python."""
    prob = words.sparkSession.sparkContext.broadcast(word_probabilities(lexicon))

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda w: correct(w, prob.value, distance))

    known = lexicon.select(F.col("word").alias("_k")).distinct()
    open_ = words.select(F.col(column).alias("_sp")).distinct().join(known, F.col("_sp") == F.col("_k"), "left_anti")
    done = open_.select("_sp", F.pandas_udf(run, "string")("_sp").alias("_fixed"))
    return words.join(done, F.col(column) == F.col("_sp"), "left").select(*words.columns, F.coalesce("_fixed", column).alias(out))


def edit_script(wrong: str, right: str) -> list[str]:
    """Edit operations of a shortest alignment, read from the end: match, substitute, delete, insert in that preference."""
    m, n = len(wrong), len(right)
    d = [[i + j if not i or not j else 0 for j in range(n + 1)] for i in range(m + 1)]
    for i in range(1, m + 1):
        for j in range(1, n + 1):
            d[i][j] = d[i - 1][j - 1] if wrong[i - 1] == right[j - 1] else 1 + min(d[i - 1][j], d[i][j - 1], d[i - 1][j - 1])
    out, i, j = [], m, n
    while i or j:
        if i and j and wrong[i - 1] == right[j - 1]:
            i, j = i - 1, j - 1
        elif i and j and d[i][j] == d[i - 1][j - 1] + 1:
            out.append(f"sub:{wrong[i - 1]}:{right[j - 1]}")
            i, j = i - 1, j - 1
        elif i and d[i][j] == d[i - 1][j] + 1:
            out.append(f"del:{wrong[i - 1]}")
            i -= 1
        else:
            out.append(f"ins:{right[j - 1]}")
            j -= 1
    return out


def error_model(pairs: DataFrame) -> DataFrame:
    """``(pattern, n, cost)`` of a table ``(wrong, correct)``; cost is 1 - share."""

    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for wrong, right in batches:
            yield pd.Series([edit_script(a or "", b or "") for a, b in zip(wrong, right, strict=True)])

    ops = pairs.select(F.explode(F.pandas_udf(run, "array<string>")("wrong", "correct")).alias("pattern")).groupBy("pattern").agg(F.count(F.lit(1)).alias("n"))
    total = ops.agg(F.sum("n").alias("_t"))
    return ops.crossJoin(F.broadcast(total)).select("pattern", "n", (1 - F.col("n") / F.col("_t")).alias("cost"))


# ---- pipeline ----------------------------------------------------------------------------

def normalize_words(words: DataFrame, lexicon: DataFrame, abbrev: DataFrame | None = None, column: str = "token", out: str = "normalized", disabled: tuple[str, ...] = ()) -> DataFrame:
    """The whole token pipeline on distinct words; empty tokens and those without a letter stay.

    Order: abbreviation, case, diacritics, vowels, spelling, accent. ``disabled`` leaves stages out.
    """
    base = words.select(F.col(column).alias("_v")).where("_v IS NOT NULL").distinct()
    cur = base.where(F.col("_v").rlike(r"\p{L}")).withColumn("_n", F.col("_v"))
    if abbrev is not None and "abbreviation" not in disabled:
        cur = expand_abbreviations(cur, abbrev, "_n", "_m").select("_v", F.col("_m").alias("_n"))
    if "case" not in disabled:
        cur = cur.withColumn("_n", case_transform("_n"))
    if "diacritics" not in disabled:
        cur = restore_diacritics(cur, lexicon, "_n", "_m").select("_v", F.col("_m").alias("_n"))
    if "vowels" not in disabled:
        cur = restore_vowels(cur, lexicon, "_n", "_x").select("_v", F.col("_x").alias("_n"))
    if "spelling" not in disabled:
        cur = correct_spelling(cur, lexicon, "_n", "_m").select("_v", F.col("_m").alias("_n"))
    if "accent" not in disabled:
        cur = cur.withColumn("_n", accent("_n"))
    done = cur.select(F.col("_v").alias("_key"), F.col("_n").alias("_new"))
    return words.join(done, F.col(column) == F.col("_key"), "left").select(*words.columns, F.coalesce("_new", column).alias(out))


def capitalize_proper(words: DataFrame, analyses: DataFrame, column: str = "token", value: str = "normalized") -> DataFrame:
    """Tokens that have an analysis with ``[Prop]`` get a capital; ``analyses`` is ``(word, analysis)``."""
    proper = analyses.where(F.col("analysis").contains("[Prop]")).select(F.col("word").alias("_p")).distinct()
    joined = words.join(proper, F.col(column) == F.col("_p"), "left")
    new = F.when(F.col("_p").isNotNull(), tr_capitalize(value)).otherwise(F.col(value))
    return joined.select(*[c for c in words.columns if c != value], new.alias(value))


def normalize_sequences(docs: DataFrame, tokens: Column, lexicon: DataFrame, abbrev: DataFrame | None = None, analyses: DataFrame | None = None, key: str = "doc_id", disabled: tuple[str, ...] = ()) -> DataFrame:
    """``(key, normalized array<string>)`` of token sequences in their order, one row per row of ``docs``.

    Tokens are gathered by sequence, not by ``key``, which may be null or repeat. Null tokens
    are left out; a null or empty sequence gives an empty one.
    """
    named = docs.select(F.col(key), tokens.alias("_seq")).withColumn("_id", text_id("_seq"))
    rows = named.select("_id", F.posexplode("_seq").alias("pos", "token")).where("token IS NOT NULL")
    done = normalize_words(rows.select("token").distinct(), lexicon, abbrev, disabled=disabled)
    if analyses is not None and "proper" not in disabled:
        done = capitalize_proper(done, analyses)
    joined = rows.join(done.withColumnRenamed("token", "_t"), F.col("token") == F.col("_t"), "left")
    ordered = F.array_sort(F.collect_set(F.struct("pos", F.coalesce("normalized", "token").alias("w"))))
    whole = joined.groupBy("_id").agg(ordered["w"].alias("normalized"))
    return named.select(key, "_id").join(whole, "_id", "left").select(key, F.coalesce("normalized", F.array().cast("array<string>")).alias("normalized"))


def normalize_text(docs: DataFrame, lexicon: DataFrame, abbrev: DataFrame | None = None, analyses: DataFrame | None = None, text: str = "text", key: str = "doc_id", disabled: tuple[str, ...] = ()) -> DataFrame:
    """``(key, normalized string)``: pieces between white space normalized and joined by one blank; null text is empty."""
    out = normalize_sequences(docs, spaced_tokens(text), lexicon, abbrev, analyses, key, disabled)
    return out.select(key, F.array_join("normalized", " ").alias("normalized"))
