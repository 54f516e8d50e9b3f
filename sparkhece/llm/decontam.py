"""Benchmark decontamination by winnowing, with DataFrame functions only.

Words are maximal runs of ASCII letters, digits and non-ASCII characters, compared with A-Z
lower-cased. A benchmark window is ``window`` consecutive words of an item (a shorter item is
one window). A window of ``window`` words holds ``window - k + 1`` k-gram hashes, and the
least of them is its fingerprint. A document's fingerprints are the least hash of each
sliding run of as many k-gram hashes, so a document that holds a window shares its
fingerprint: every shared span of ``window`` words or more is found. Texts that share one are
then read again: each k-gram occurrence that equals a window's fingerprint is extended to the
whole window and compared word by word, by a 128-bit digest of its exact words.

Scale: documents are matched by the sha256 of their text, so copies are worked on once. The
join of fingerprints is a map-side join while the benchmark's windows are within the byte
limit of ``common.sized``, and a shuffled join on the hash otherwise. No text is shuffled but
those of candidate documents, which are dealt out over tasks by size. Of an occurrence only
its place and the window's digest are kept; a k-gram that many windows share costs a row for
each of its occurrences and windows, which are filtered where they arise, never gathered.

Defined results: null or wordless text has no words and no hits; null benchmark texts have
no windows; an item with null id marks words but is not counted or listed; repeated items or
documents count as often as they occur; with an empty benchmark nothing is hit, and an empty
table gives an empty table. Texts may be of any length. Extra columns may have any name, but
for the one named ``hits``, which is replaced.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkhece.llm.common import discard, materialize, plain, restored, sized

WINDOW, K = 10, 5
_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_AZ = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def exact_words(text: Column) -> Column:
    """The words of a text with A-Z lower-cased and all else as it is."""
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), _AZ, _AZ.lower()), _BREAK), lambda w: w != "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _longs(long_enough: Column, value: Column) -> Column:
    return F.when(long_enough, value).otherwise(F.array().cast("array<bigint>"))


def grams(words: Column, n: int) -> Column:
    """Hashes of all n-grams of an array of words; none if it is shorter."""

    def hashes(h: Column) -> Column:
        return _longs(F.size(h) >= n, F.transform(F.sequence(F.lit(0), F.size(h) - n), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(n)])))

    return let(F.transform(words, lambda w: F.xxhash64(w)), hashes)


def least_of(hashes: Column, run: int) -> Column:
    """The least hash of every sliding run of ``run`` hashes, each once: minima of 1, 2, 4, ... hashes, widened to ``run``."""

    def widen(level: Column, width: int, size: Column) -> Column:
        if width == run:
            return F.array_distinct(level)
        by = min(width, run - width)
        n = size - (width + by - 1)
        wider = F.zip_with(F.slice(level, F.lit(1), n), F.slice(level, F.lit(by + 1), n), lambda a, b: F.least(a, b))
        return let(wider, lambda x: widen(x, width + by, size))

    return let(hashes, lambda h: _longs(F.size(h) >= run, widen(h, 1, F.size(h))))


def short_grams(words: Column, n: int) -> Column:
    """Hashes of all runs of ``n`` words, with ``n`` in the hash: those of items shorter than a window."""
    return _longs(F.size(words) >= n, F.transform(F.sequence(F.lit(1), F.size(words) - (n - 1)), lambda i: F.xxhash64(F.concat_ws(" ", F.slice(words, i, n)), F.lit(n))))


def _digest(words: Column) -> Column:
    return F.unhex(F.md5(F.concat_ws(" ", words)))


def bench_windows(bench: DataFrame, text: str, item: str, window: int, k: int) -> DataFrame:
    """One row per distinct window: its digest, length, fingerprint, the offset of that, and its items."""
    b = bench.select(F.col(f"`{item}`").cast("string").alias("item"), exact_words(F.col(f"`{text}`")).alias("w"))
    cut = F.expr(
        f"CASE WHEN size(w) >= {window} THEN transform(sequence(1, size(w) - {window - 1}), i -> slice(w, i, {window})) WHEN size(w) > 0 THEN array(w) ELSE array() END"
    )
    w = b.select("item", F.explode(cut.cast("array<array<string>>")).alias("w"))
    w = w.groupBy("w").agg(F.array_sort(F.collect_set("item")).alias("items"))
    w = w.withColumn("len", F.size("w")).withColumn("g", grams(F.col("w"), k))
    whole = F.xxhash64(F.concat_ws(" ", "w"), F.col("len"))
    return w.select(
        _digest(F.col("w")).alias("wid"),
        "len",
        "items",
        F.when(F.col("len") == window, F.array_min("g")).otherwise(whole).alias("fp"),
        F.when(F.col("len") == window, F.array_position("g", F.array_min("g")) - 1).otherwise(0).cast("int").alias("off"),
    )


def decontaminate(docs: DataFrame, bench: DataFrame, text: str = "text", item: str = "item_id", bench_text: str = "text", window: int = WINDOW, k: int = K) -> DataFrame:
    """Add struct ``hits(n_words, n_hit, n_items, items)`` to every row of ``docs``."""
    windows = materialize(bench_windows(bench, bench_text, item, window, k), "windows")
    n_windows, short = windows.agg(F.count(F.lit(1)), F.collect_set(F.when(F.col("len") < window, F.col("len")))).first()
    short = sorted(short)  # at most window - 1 numbers
    body = F.col(f"`{text}`")
    keyed = docs.select(F.sha2(body, 256).alias("key"), body.alias("t"))

    # candidates: texts that share a fingerprint with some window
    every = let(exact_words(F.col("t")), lambda w: F.concat(least_of(grams(w, k), window - k + 1), *[short_grams(w, n) for n in short]))
    marks = sized(windows.select(F.col("fp").alias("mark")).distinct(), n_windows, 16)
    found = keyed.select("key", F.explode(every).alias("fp")).join(marks, F.col("fp") == F.col("mark"), "left_semi")
    found = materialize(found.select("key").distinct(), "found")
    n_found = found.count()
    cand = keyed.join(sized(found, n_found, 96), "key", "left_semi").groupBy("key").agg(F.first("t").alias("t"))
    cand = materialize(cand, "candidates")  # cut before it is dealt out again: texts that share much take longer than others
    parts = max(4 * docs.sparkSession.sparkContext.defaultParallelism, n_found // 1000)
    words = materialize(cand.repartition(parts, "key").select("key", exact_words(F.col("t")).alias("w")), "words")

    # seeds: every occurrence of a window's fingerprint, and where a window would start
    spot = lambda n: lambda h, i: F.struct(F.lit(n).alias("n"), i.alias("p"), h.alias("h"))
    spots = F.concat(F.transform(grams(F.col("w"), k), spot(window)), *[F.transform(short_grams(F.col("w"), n), spot(n)) for n in short])
    spots = words.select("key", F.explode(spots).alias("s")).select("key", "s.n", "s.p", "s.h")
    starts = windows.select("fp", "off", "len").distinct()  # windows of one fingerprint start at few offsets, however many they are
    seeds = spots.join(sized(starts, n_windows, 24), (F.col("h") == F.col("fp")) & (F.col("n") == F.col("len")))
    seeds = seeds.select("key", (F.col("p") - F.col("off")).alias("s"), "len").where("s >= 0")
    seeds = materialize(seeds.groupBy("key").agg(F.collect_set(F.struct("s", "len")).alias("seeds")), "seeds")

    # extension: the whole window, word by word
    spans = words.join(seeds, "key").select("key", F.explode(let(F.struct("w", "seeds"), lambda x: F.transform(x["seeds"], lambda y: F.struct(y["s"].alias("s"), y["len"].alias("len"), _digest(F.slice(x["w"], y["s"] + 1, y["len"])).alias("wid"))))).alias("x"))
    spans = spans.select("key", "x.s", "x.len", "x.wid").join(sized(windows.select("wid"), n_windows, 24), "wid", "left_semi")
    held = materialize(spans.groupBy("key").agg(F.array_sort(F.collect_set(F.struct("s", "len"))).alias("at"), F.collect_set("wid").alias("wids")), "hits")
    covered = F.expr("aggregate(at, named_struct('end', 0, 'n', 0), (a, x) -> named_struct('end', greatest(a.end, x.s + x.len), 'n', a.n + greatest(0, x.s + x.len - greatest(a.end, x.s)))).n")
    items = held.select("key", F.explode("wids").alias("wid")).join(sized(windows.select("wid", "items"), n_windows, 128), "wid")
    items = items.select("key", F.explode("items").alias("item")).groupBy("key").agg(F.array_sort(F.collect_set("item")).alias("items"))
    told = held.select(F.col("key").alias("_held"), covered.alias("n_hit")).join(items, F.col("_held") == F.col("key"), "left")
    told = materialize(told.select(F.struct(F.col("_held").alias("key"), "n_hit", "items").alias("_hits")), "told")
    discard(windows, found, cand, words, seeds, held)

    out, names = plain(docs)
    own = F.col(names[text])
    out = out.join(sized(told, n_found, 256), F.sha2(own, 256) == F.col("_hits.key"), "left")
    none = F.array().cast("array<string>")
    hits = F.struct(
        F.size(exact_words(own)).cast("long").alias("n_words"),
        F.coalesce(F.col("_hits.n_hit"), F.lit(0)).cast("long").alias("n_hit"),
        F.size(F.coalesce(F.col("_hits.items"), none)).cast("long").alias("n_items"),
        F.coalesce(F.col("_hits.items"), none).alias("items"),
    )
    return restored(out, names, hits=hits)
