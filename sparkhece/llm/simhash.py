"""SimHash near-duplicates by deletion-variant signatures.

Fingerprints: 64 majority bits over the XXH64 (seed 42) of 3-word shingles. Two fingerprints
with at most 2 differing bits are cut into 2 segments of 32 bits, of which one differs in at
most one bit. Index keys of a segment are its value, and its 32 variants with one bit left
out (wildcard); the fingerprints of a pair meet on an equal key and are then verified:

* equal segments meet on the value, and the other segment may differ in 2 bits;
* segments that differ in bit j meet on the variant without bit j, one with bit j set and one
  without, and the other segment may differ in 1 bit.

Only distinct fingerprints take part, so exact copies cost nothing. Keys of one fingerprint
(or, for a variant, with bit j on one side only) are dropped after counting. In groups of at
most ``pair_limit`` fingerprints all pairs are verified (linear in the group by the constant
limit). Larger groups use a second level that needs no pairs: members also leave out bits of
the other segment (2 of 32 for equal segments, 1 of 32 for variants), and all that agree then
differ in 2 bits at most, so linking each to the least of them keeps every component whole.

``keep_first`` drops near copies (5-word shingles, Jaccard 0.8 or more) of whole texts. At
Jaccard 0.8 two 64-bit fingerprints are expected to differ in 10 bits, far beyond what deletion
variants reach, so the pairs that the fingerprints link are completed by those that meet in a
MinHash band; all of them are verified by exact Jaccard before anything is dropped.

Defined results: null and wordless text has fingerprint 0 and is linked like any other;
fewer words than a shingle are one shingle; a component's id is its least non-null doc_id.
Repeated rows each get the row of their text. Only the key and the text are read, so extra
columns may have any name; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkhece.llm import paragraphs
from sparkhece.llm.common import components, discard, materialize, plain, restored, sized

SHINGLE, SEED, PAIR_LIMIT = 3, 42, 48
_LOWER = bytes(c + 32 * (65 <= c <= 90) for c in range(256))
_SPACE = bytes(32 if c in (9, 10, 11, 12, 13) else c for c in _LOWER)


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Unsigned 64-bit SimHash of a whole text."""
    raw = (text or "").encode("utf-8", "surrogatepass").translate(_SPACE)
    words = [w for w in raw.split(b" ") if w]  # bytes.split() would take other breaks than the six
    if not words:
        return 0
    line = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        hashes = [digest(line, seed)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
        starts = np.concatenate([[0], ends[: len(words) - shingle] + 1]).tolist()
        hashes = [digest(line[a:b], seed) for a, b in zip(starts, ends[shingle - 1 :].tolist(), strict=True)]
    bits = np.unpackbits(np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    over = bits.sum(axis=0, dtype=np.int64) * 2 > len(hashes)
    return int(np.packbits(over, bitorder="little").view("<u8")[0])


def _fingerprints(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in texts:
        yield pd.Series(np.array([fingerprint(t) for t in s], dtype=np.uint64).view(np.int64))


def with_fingerprint(df: DataFrame, text: str = "text", out: str = "fp") -> DataFrame:
    """Add the fingerprint as a signed long."""
    return df.withColumn(out, F.pandas_udf(_fingerprints, "long")(F.col(text)))


def _segment(k: int) -> Column:
    return F.shiftrightunsigned("fp", 32).bitwiseAND(0xFFFFFFFF) if k else F.col("fp").bitwiseAND(0xFFFFFFFF)


def _variants(width: int = 32) -> Column:
    """Wildcard numbers of the first level: 32 stands for none."""
    return F.explode(F.array(*[F.lit(j) for j in range(width + 1)]))


def similar(fps: DataFrame, pair_limit: int = PAIR_LIMIT) -> DataFrame:
    """Edges ``(a, b)`` between distinct fingerprints ``fps(fp)`` that give all components.

    Every pair with at most 2 differing bits is linked, directly or (in large groups) by way
    of fingerprints that differ from each other in at most 2 bits.
    """
    keys = None
    for k in (0, 1):
        part = fps.select("fp", F.lit(k).alias("seg"), _segment(k).alias("v"), _segment(1 - k).alias("o"), _variants().alias("j"))
        keys = part if keys is None else keys.union(part)
    bit = F.expr("CASE WHEN j = 32 THEN 0 ELSE CAST(shiftright(v, j) & 1 AS INT) END")
    masked = F.expr("CASE WHEN j = 32 THEN v ELSE v & ~shiftleft(1L, j) END")
    keys = keys.select("fp", "o", "j", bit.alias("bit"), F.expr("shiftleft(CAST(seg AS BIGINT), 62)").bitwiseOR(F.expr("shiftleft(CAST(j AS BIGINT), 40)")).bitwiseOR(masked).alias("key"))
    live = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("bit").alias("lo"), F.max("bit").alias("hi"), F.min("j").alias("jj"))
    live = materialize(live.where("n > 1 AND (jj = 32 OR lo < hi)").select("key", "n"), "live")
    held = materialize(keys.join(live, "key"), "held")

    small = held.where(F.col("n") <= pair_limit)
    left = small.select("key", F.col("fp").alias("a"), F.col("bit").alias("abit"), "j")
    right = small.select("key", F.col("fp").alias("b"), F.col("bit").alias("bbit"))
    meets = F.expr("(j = 32 AND a < b) OR abit < bbit")
    pairs = left.join(right, "key").where(meets & (F.expr("bit_count(a ^ b)") <= 2)).select("a", "b")

    big = held.where(F.col("n") > pair_limit)
    one = F.expr("transform(sequence(0, 31), x -> shiftleft(1L, x))")
    two = F.expr("flatten(transform(sequence(0, 30), x -> transform(sequence(x + 1, 31), y -> shiftleft(1L, x) | shiftleft(1L, y))))")
    out = big.select("fp", "key", "o", F.explode(F.when(F.col("j") == 32, two).otherwise(one)).alias("m"))
    out = out.select("fp", "key", "m", F.expr("o & ~m").alias("rest"))
    heads = materialize(out.groupBy("key", "m", "rest").agg(F.min("fp").alias("a"), F.count(F.lit(1)).alias("c")).where("c > 1").drop("c"), "heads")
    stars = out.join(heads, ["key", "m", "rest"]).where("a <> fp").select("a", F.col("fp").alias("b"))
    edges = materialize(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).union(stars).distinct(), "similar")
    discard(live, held, heads)
    return edges


def near_duplicates(df: DataFrame, text: str = "text", key: str = "doc_id", pair_limit: int = PAIR_LIMIT) -> DataFrame:
    """One row per document: ``key``, ``fp`` (signed long) and ``component_id``."""
    marked = materialize(with_fingerprint(df.select(key, text), text).select(key, "fp"), "fps")
    least = materialize(marked.groupBy("fp").agg(F.min(key).alias("least")), "distinct")
    comp = components(similar(least.select("fp"), pair_limit), "simhash").select(F.col("node").alias("fp"), "comp")
    named = least.join(comp, "fp", "left").withColumn("comp", F.coalesce("comp", "fp"))
    named = materialize(named, "named")
    ids = named.groupBy("comp").agg(F.min("least").alias("component_id"))
    ids = materialize(named.join(ids, "comp").select("fp", "component_id"), "ids")
    return marked.join(ids, "fp", "left").select(key, "fp", "component_id")


def _signatures(shingle: int):
    """Of whole texts: digest of the words, fingerprint (majority bits of shingle hashes) and MinHash band keys."""

    def run(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in texts:
            out, units = [], []
            for t in s:
                words = paragraphs.paragraph_words(t)
                units.append(paragraphs.word_hashes(words))
                h = paragraphs.shingle_hashes(units[-1:], shingle)[0]
                bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                over = bits.sum(axis=0, dtype=np.int64) * 2 > len(h)
                fp = int(np.packbits(over, bitorder="little").view("<i8")[0]) if words else 0
                out.append((paragraphs.digest(words), fp))
            sizes, at, keys = np.cumsum([len(u) for u in units]) // paragraphs.GROUP_WORDS, 0, []
            for n in np.unique(sizes, return_counts=True)[1].tolist():
                keys += list(paragraphs.band_keys(units[at : at + n], shingle=shingle))
                at += n
            yield pd.DataFrame({"pid": [x[0] for x in out], "fp": [x[1] for x in out], "keys": keys})

    return run


def _shingle_sets(shingle: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pids, sets, held = [], [], 0
        for batch in batches:
            for pid, t in zip(batch["pid"], batch["t"], strict=True):
                pids.append(pid)
                sets.append(np.unique(paragraphs.shingle_hashes([paragraphs.word_hashes(paragraphs.paragraph_words(t))], shingle)[0]).view(np.int64))
                held += len(sets[-1])
                if held >= paragraphs.GROUP_WORDS:
                    yield pd.DataFrame({"pid": pids, "s": sets})
                    pids, sets, held = [], [], 0
        if pids:
            yield pd.DataFrame({"pid": pids, "s": sets})

    return run


def keep_first(docs: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = 5, jaccard: float = 0.8, pair_limit: int = PAIR_LIMIT) -> DataFrame:
    """``docs`` without near copies: of each group the row of least key (then text hash) stays.

    A group is a component of pairs of texts whose shingle sets (lower-cased words) have at
    least the given Jaccard. Rows that agree in key and text are copies too: one stays. Null
    text counts as empty, and texts without words are equal; a null key sorts first.
    """
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = docs.select(F.col(f"`{key}`").alias("k"), F.xxhash64(body).alias("x"), body.alias("t"))
    sign = F.pandas_udf(_signatures(shingle), "pid binary, fp long, keys array<bigint>")
    marked = materialize(rows.select("k", "x", sign("t").alias("s")).select("k", "x", "s.*"), "signatures")
    units = marked.groupBy("pid").agg(F.min(F.struct("k", "x")).alias("place"), F.count(F.lit(1)).alias("n"), F.first("keys").alias("keys"), F.first("fp").alias("fp"))
    units = materialize(units, "texts")

    def sets_of(ids: DataFrame) -> DataFrame:
        asked = materialize(units.select("pid", "place").join(sized(ids, ids.count(), 24), "pid").select("pid", F.col("place.k").alias("k2"), F.col("place.x").alias("x2")), "asked")
        same = F.col("k").eqNullSafe(F.col("k2")) & (F.col("x") == F.col("x2"))
        once = rows.join(sized(asked, asked.count(), 64), same).dropDuplicates(["pid"]).select("pid", "t")
        return once.mapInPandas(_shingle_sets(shingle), "pid binary, s array<bigint>")

    # what the fingerprints link: the texts of one fingerprint, and the first texts of similar ones
    heads = materialize(units.groupBy("fp").agg(F.min("pid").alias("head"), F.count(F.lit(1)).alias("n")), "fingerprints")
    near = similar(heads.select("fp"), pair_limit)
    n_heads = heads.count()
    links = near.join(sized(heads.select(F.col("fp").alias("a"), F.col("head").alias("ha")), n_heads, 24), "a")
    links = links.join(sized(heads.select(F.col("fp").alias("b"), F.col("head").alias("hb")), n_heads, 24), "b")
    links = links.select(F.least("ha", "hb").alias("a"), F.greatest("ha", "hb").alias("b"))
    held = heads.where("n > 1").select("fp", "head")
    links = links.union(units.select("fp", "pid").join(held, "fp").where("pid <> head").select(F.col("head").alias("a"), F.col("pid").alias("b")))
    comp = paragraphs.clusters(units.select("pid", "keys"), sets_of, jaccard, paragraphs.PAIR_LIMIT, links)

    named = units.select("pid", "place", "n").join(comp, "pid", "left").where("n > 1 OR comp IS NOT NULL")
    named = materialize(named.select("pid", "place", F.coalesce("comp", "pid").alias("comp")), "named")
    leads = materialize(named.join(named.groupBy("comp").agg(F.min("place").alias("lead")), "comp").select("pid", "lead"), "leads")
    held = marked.select("k", "x", "pid").join(sized(leads, leads.count(), 48), "pid")
    places = held.groupBy("k", "x").agg(F.first("lead").alias("lead"), F.count(F.lit(1)).alias("n"))
    places = places.select("k", "x", "n", F.struct("k", "x").eqNullSafe(F.col("lead")).alias("first")).where("n > 1 OR NOT first")
    places = materialize(places.select(F.struct("k", "x", "n", "first").alias("_copy")), "copies")
    discard(marked, units, heads, near, named, leads)

    own, names = plain(docs)
    same = F.col(names[key]).eqNullSafe(F.col("_copy.k")) & (F.xxhash64(F.coalesce(F.col(names[text]), F.lit(""))) == F.col("_copy.x"))
    n_places = places.count()
    kept = own.join(sized(places, n_places, 64), same, "left_anti")
    twice = places.where("_copy.first")
    n_twice = twice.count()
    if n_twice:  # rows that agree in key and text: one of them
        again = own.join(sized(twice, n_twice, 64), same).groupBy("_copy.k", "_copy.x").agg(F.first(F.struct(*names.values())).alias("_row"))
        kept = kept.union(again.select("_row.*"))
    return restored(kept, names)
