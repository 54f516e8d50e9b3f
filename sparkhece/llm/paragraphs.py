"""Substring dedup by paragraph MinHash banding.

A paragraph is a line of at least ``min_words`` words. Its signature holds the least value of
``bands x rows`` hash functions over its 5-word shingles (lower-cased words); paragraphs that
agree on all rows of a band collide. With 16 bands of 4 rows a pair of Jaccard 0.8 collides in
some band with probability 0.9998. Colliding pairs are verified by the exact Jaccard of their
shingle sets (64-bit shingle hashes), and clusters are connected components. The first
occurrence of a cluster (least document, then position) stays, the others go.

Equal paragraphs (by a 128-bit digest) are one row before banding, so a line that a third of
all documents share costs one signature. In a bucket of at most ``pair_limit`` distinct
paragraphs all pairs are verified (linear by the constant limit). In a larger bucket each
member is verified against the head, the member that meets the most others; members that no
verified pair has joined to the head's component are then compared with the whole bucket
exactly, in blocks dealt over tasks. Components are thus those of all colliding pairs.

Passages of ``PASSAGE`` words or more that repeat inside other lines go as well, in a second
step over what the first one leaves. Hashes of 25 words are winnowed in windows of 26, so
every run of 50 words holds one (an anchor). Around anchors that occur twice all runs of 50
words are compared by 128-bit digests, and each that occurred before (least document, then
position) goes. Runs of 50 equal words are all found, whatever surrounds them and however
they are broken into lines; reworded ones are found only where their lines are alike.

Scale: a text is read three times at most: for signatures and anchors, for the shingle sets of
colliding paragraphs, and to cut it. Only ids, hashes and positions are shuffled, and texts
where what is joined to them is too large to broadcast (``common.sized``).

Defined results: null text stays null and has no paragraphs; shorter lines and blank lines
are removed only as part of a passage; paragraphs of fewer words than a shingle count as one
shingle. A row is known by its key and text, so rows that agree in both (repeated rows) count
as one document; a null key is a key of its own and sorts first. Extra columns are returned
as they are, whatever their names, but for one named ``dedup``, which is replaced. An empty
table gives an empty table.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkhece.llm.common import components, discard, materialize, plain, restored, sized

BANDS, ROWS, SHINGLE, JACCARD, MIN_WORDS, PAIR_LIMIT, BLOCK = 16, 4, 5, 0.8, 25, 32, 256
PASSAGE, GRAM, WINDOW = 50, 25, 26  # words; GRAM + WINDOW - 1 = PASSAGE
GROUP_WORDS = 1 << 16  # words whose signatures are computed at once
_ODD = np.array([pow(0x9E3779B97F4A7C15, 2 * k + 1, 1 << 64) | 1 for k in range(256)], dtype=np.uint64)


def word_hashes(words: list[str]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words))


def _mix(a: np.ndarray, b: np.ndarray, odd: int) -> np.ndarray:
    h = (a * _ODD[odd] ^ b) * _ODD[odd + 1]
    return h ^ (h >> np.uint64(29))


def gram_hashes(words: np.ndarray, n: int, odd: int = 0) -> np.ndarray:
    """Hashes of all runs of ``n`` word hashes, from those of 1, 2, 4, ... words; ``odd`` picks another function."""
    if len(words) < n:
        return np.zeros(0, dtype=np.uint64)
    level, out, size, done = words, None, 1, 0
    while size <= n:
        if n & size:
            m = len(words) - done - size + 1
            out = level if out is None else _mix(out[:m], level[done : done + m], odd + 64)
            done += size
        level = _mix(level[:-size], level[size:], odd) if 2 * size <= n else level
        size *= 2
    return out


def shingle_hashes(units: list[np.ndarray], n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of all units, one after the other, and how many each unit has (1 at least)."""
    padded = [u if len(u) >= n else np.pad(u, (0, n - len(u))) for u in units]
    sizes = np.array([len(u) - n + 1 for u in padded], dtype=np.int64)
    if not units:
        return np.zeros(0, dtype=np.uint64), sizes
    flat = gram_hashes(np.concatenate(padded), n)
    keep = np.ones(len(flat) + n - 1, dtype=bool)
    ends = np.cumsum(sizes + n - 1)
    for k in range(1, n):
        keep[ends - k] = False  # those that reach into the next unit
    return flat[keep[: len(flat)]], sizes


def band_keys(units: list[np.ndarray], bands: int = BANDS, rows: int = ROWS, shingle: int = SHINGLE) -> np.ndarray:
    """For each unit, given as word hashes, its key in every band, as signed longs."""
    h, sizes = shingle_hashes(units, shingle)
    if not len(sizes):
        return np.zeros((0, bands), dtype=np.int64)
    h = (h >> np.uint64(32)).astype(np.uint32)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    keys = np.zeros((len(units), bands), dtype=np.uint64)
    for b in range(bands):
        key = np.full(len(units), b + 1, dtype=np.uint64)
        for r in range(rows):
            at = b * rows + r + 8
            v = (h ^ np.uint32(_ODD[at] >> np.uint64(32))) * (np.uint32(_ODD[at] & np.uint64(0xFFFFFFFF)))
            v ^= v >> np.uint32(16)
            v *= np.uint32(0x85EBCA6B)
            key = (key ^ np.minimum.reduceat(v, starts)) * _ODD[3]
            key ^= key >> np.uint64(31)
        keys[:, b] = key
    return keys.view(np.int64)


def anchors(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word positions and hashes of the winnowed grams: any run of ``PASSAGE`` words holds one."""
    if len(words) < PASSAGE:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    h = gram_hashes(words, GRAM)
    least = h
    for step in (1, 2, 4, 8, WINDOW - 16):  # minima of 2, 4, 8, 16 and WINDOW hashes
        least = np.minimum(least[: len(least) - step], least[step:])
    hit = np.zeros(len(h), dtype=bool)
    for k in range(WINDOW):
        hit[k : k + len(least)] |= h[k : k + len(least)] == least
    at = np.flatnonzero(hit)
    return at, h[at].view(np.int64)


def paragraph_words(line: str) -> list[str]:
    return line.lower().split()


def digest(words: list[str]) -> bytes:
    return hashlib.md5(" ".join(words).encode("utf-8", "surrogatepass")).digest()


def _lists(sizes: list[int], values: np.ndarray | list, kind: pa.DataType) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, type=kind))


def _read(bands: int, min_words: int, inner: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of every text its paragraphs (position, digest, band keys) and, if ``inner``, its anchors with the lines they lie in."""

    def group(rows: list[tuple]) -> pa.RecordBatch:
        keys = band_keys([u for r in rows for u in r[4]], bands).reshape(-1)
        n, m = [len(r[2]) for r in rows], [len(r[5]) for r in rows]
        flat = lambda i: np.concatenate([r[i] for r in rows])
        return pa.RecordBatch.from_arrays(
            [
                pa.concat_arrays([r[0] for r in rows]), pa.concat_arrays([r[1] for r in rows]),
                _lists(n, [p for r in rows for p in r[2]], pa.int32()), _lists(n, [d for r in rows for d in r[3]], pa.binary()), _lists([x * bands for x in n], keys, pa.int64()),
                _lists(m, flat(5), pa.int32()), _lists(m, flat(6), pa.int64()), _lists(m, flat(7), pa.int32()), _lists(m, flat(8), pa.int32()),
            ],
            names=["k", "x", "at", "pid", "keys", "pos", "h", "first", "last"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, held = [], 0
            texts, k, x = batch.column(batch.schema.get_field_index("t")), batch.column(batch.schema.get_field_index("k")), batch.column(batch.schema.get_field_index("x"))
            for i, text in enumerate(texts):
                lines = [paragraph_words(line) for line in text.as_py().split("\n")]
                sizes = np.array([len(w) for w in lines], dtype=np.int64)
                words = word_hashes([w for line in lines for w in line])
                at = np.flatnonzero(sizes >= min_words)
                ends = np.cumsum(sizes)
                units = [words[ends[j] - sizes[j] : ends[j]] for j in at]
                pos, h = anchors(words) if inner else (np.zeros(0, dtype=np.int64),) * 2
                rows.append((k.slice(i, 1), x.slice(i, 1), at.tolist(), [digest(lines[j]) for j in at], units, pos, h, np.searchsorted(ends, pos, "right"), np.searchsorted(ends, pos + GRAM - 1, "right")))
                held += len(words)
                if held >= GROUP_WORDS:
                    yield group(rows)
                    rows, held = [], 0
            if rows:
                yield group(rows)

    return run


def _meet(units: DataFrame, pair_limit: int) -> tuple[DataFrame, DataFrame]:
    """Pairs ``(a, b)`` to verify, and the members ``(key, pid, head)`` of large buckets.

    The head of a large bucket is the member whose buckets hold the most paragraphs in all.
    """
    members = units.select("pid", F.explode("keys").alias("key"))
    groups = materialize(members.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "buckets")
    held = materialize(members.join(sized(groups, groups.count(), 16), "key"), "members")
    small = held.where(F.col("n") <= pair_limit)
    pairs = small.select("key", F.col("pid").alias("a")).join(small.select("key", F.col("pid").alias("b")), "key").where("a < b").select("a", "b")
    large = held.where(F.col("n") > pair_limit).select("key", "pid")
    met = held.groupBy("pid").agg(F.sum("n").alias("met"))
    large = materialize(large.join(met, "pid"), "large")
    heads = large.groupBy("key").agg(F.max(F.struct("met", "pid"))["pid"].alias("head"))
    heads = materialize(heads, "heads")
    large = materialize(large.select("key", "pid").join(sized(heads, heads.count(), 24), "key"), "large-heads")
    stars = large.where("pid <> head").select(F.least("head", "pid").alias("a"), F.greatest("head", "pid").alias("b"))
    pairs = materialize(pairs.union(stars).distinct(), "pairs")
    discard(groups, held, heads)
    return pairs, large


def near_pairs(x: list[np.ndarray], y: list[np.ndarray], jaccard: float) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all pairs of two lists of shingle sets with at least the given Jaccard."""
    sizes_x, sizes_y = np.array([len(s) for s in x]), np.array([len(s) for s in y])
    flat_x, flat_y = np.concatenate(x), np.concatenate(y)
    shared = np.intersect1d(flat_x, flat_y)
    common = np.zeros((len(x), len(y)), dtype=np.float32)
    of_x, of_y = np.repeat(np.arange(len(x)), sizes_x), np.repeat(np.arange(len(y)), sizes_y)
    for at in range(0, len(shared), 4096):
        part = shared[at : at + 4096]
        dense = []
        for flat, of, n in ((flat_x, of_x, len(x)), (flat_y, of_y, len(y))):
            k = np.minimum(np.searchsorted(part, flat), len(part) - 1)
            hit = part[k] == flat
            m = np.zeros((n, len(part)), dtype=np.float32)
            m[of[hit], k[hit]] = 1
            dense.append(m)
        common += dense[0] @ dense[1].T
    return np.nonzero(common >= jaccard * (sizes_x[:, None] + sizes_y[None, :] - common) - 1e-3)


def _unlinked(large: DataFrame, sets: DataFrame, comp: DataFrame, jaccard: float, block: int = BLOCK) -> DataFrame:
    """Edges between members of large buckets that no edge has joined yet: exact, block by block.

    Members linked to the head of their bucket need no comparison with each other. Every
    other member is compared with all of its bucket; both sides are dealt out in blocks, and
    each pair of blocks is one group, so a bucket of any size spreads over many tasks.
    """
    comp = materialize(comp, "linked")
    lead = comp.select(F.col("pid").alias("head"), F.col("comp").alias("lead"))
    own = large.join(comp, "pid", "left").join(lead, "head", "left")
    own = own.select("key", "pid", F.coalesce("comp", "pid").alias("comp"), F.coalesce("lead", "head").alias("lead"))
    own = materialize(own.select("key", "pid", "comp", (F.col("comp") != F.col("lead")).alias("open")), "unlinked")
    counts = own.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("open").cast("long")).alias("o")).where("o > 0")
    counts = materialize(counts.select("key", F.ceil(F.col("n") / block).alias("nb"), F.ceil(F.col("o") / block).alias("ob")), "blocks")
    n = counts.count()
    own = own.join(sized(counts, n, 24), "key")
    at = F.xxhash64("pid", "key")
    every = own.select("key", "pid", "comp", F.pmod(at, F.col("nb")).alias("j"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("ob") - 1)).alias("i"))
    some = own.where("open").select("key", "pid", "comp", F.pmod(at, F.col("ob")).alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("nb") - 1)).alias("j"))
    kind = dict(sets.dtypes)["pid"]

    def compare(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"a": pd.Series(dtype=object), "b": pd.Series(dtype=object)})
        i, j = near_pairs(left["s"].tolist(), right["s"].tolist(), jaccard)
        a, b, ca, cb = (left["pid"].tolist(), right["pid"].tolist(), left["comp"].tolist(), right["comp"].tolist())
        found = [(min(a[x], b[y]), max(a[x], b[y])) for x, y in zip(i.tolist(), j.tolist(), strict=True) if ca[x] != cb[y]]
        return pd.DataFrame(found, columns=["a", "b"])

    if not n:
        return sets.select(F.col("pid").alias("a"), F.col("pid").alias("b")).limit(0)
    side = [df.join(sets, "pid").select(*[F.col(c).alias(c) for c in ("key", "i", "j", "pid", "comp", "s")]) for df in (some, every)]  # aliases, as both are of one table
    left, right = (df.groupBy("key", "i", "j") for df in side)
    return left.cogroup(right).applyInPandas(compare, f"a {kind}, b {kind}").distinct()


def clusters(units: DataFrame, sets_of: Callable[[DataFrame], DataFrame], jaccard: float = JACCARD, pair_limit: int = PAIR_LIMIT, links: DataFrame | None = None) -> DataFrame:
    """Cluster ``(pid, comp)`` of each distinct unit ``(pid, keys)`` that is near another.

    ``sets_of`` gives the shingle sets ``(pid, s)`` of the ids ``(pid)`` asked for. ``links``
    are further pairs ``(a, b)`` to verify, found in another way.
    """
    pairs, large = _meet(units, pair_limit)
    if links is not None:
        pairs = materialize(pairs.union(links.select("a", "b")).distinct(), "pairs")
    ids = materialize(pairs.select(F.col("a").alias("pid")).union(pairs.select("b")).distinct(), "ids")
    sets = materialize(sets_of(ids), "shingles")
    both = pairs.join(sets.select(F.col("pid").alias("a"), F.col("s").alias("x")), "a").join(sets.select(F.col("pid").alias("b"), F.col("s").alias("y")), "b")
    common = F.size(F.array_intersect("x", "y"))
    edges = materialize(both.where(common >= jaccard * (F.size("x") + F.size("y") - common) - 1e-9).select("a", "b"), "edges")
    comp = components(edges, "paragraphs").select(F.col("node").alias("pid"), "comp")
    if not large.isEmpty():
        more = materialize(_unlinked(large, sets, comp, jaccard), "more")
        if not more.isEmpty():
            comp = components(edges.union(more), "paragraphs").select(F.col("node").alias("pid"), "comp")
        discard(more)
    discard(pairs, large, ids, sets, edges)  # the components are tables of their own
    return comp


def _sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The shingle sets of the paragraphs asked for (``want``: position and id)."""
    pids, sets, held = [], [], 0
    for batch in batches:
        for text, want in zip(batch["t"], batch["want"], strict=True):
            lines = text.split("\n")
            for w in want:
                pids.append(w["pid"])
                sets.append(np.unique(shingle_hashes([word_hashes(paragraph_words(lines[w["at"]]))])[0]).view(np.int64))
                held += len(sets[-1])
            if held >= GROUP_WORDS:
                yield pd.DataFrame({"pid": pids, "s": sets})
                pids, sets, held = [], [], 0
    if pids:
        yield pd.DataFrame({"pid": pids, "s": sets})


def _runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Digests of all runs of ``PASSAGE`` words that hold one of the anchors ``places`` and touch no removed line."""
    found, held = [], 0

    def told() -> pd.DataFrame:
        n = [len(f[2]) for f in found]
        keys = pd.Series([f[0] for f in found]).repeat(n).reset_index(drop=True)
        return pd.DataFrame({"k": keys, "x": np.repeat(np.array([f[1] for f in found]), n), **{c: np.concatenate([f[i] for f in found]) for i, c in ((2, "pos"), (3, "hi"), (4, "lo"))}})

    for batch in batches:
        for k, x, text, removed, places in zip(batch["k"], batch["x"], batch["t"], batch["removed"], batch["places"], strict=True):
            lines = [paragraph_words(line) for line in text.split("\n")]
            words = word_hashes([w for line in lines for w in line])
            ends = np.cumsum([len(w) for w in lines])
            starts = np.zeros(len(words) + 1, dtype=bool)
            for p in places.tolist():
                starts[max(0, p + GRAM - PASSAGE) : p + 1] = True
            for i in [] if removed is None else removed.tolist():
                starts[max(0, ends[i] - len(lines[i]) - PASSAGE + 1) : ends[i]] = False
            at = np.flatnonzero(starts[: max(0, len(words) - PASSAGE + 1)])
            if len(at):
                found.append((k, x, at.astype(np.int32), gram_hashes(words, PASSAGE)[at].view(np.int64), gram_hashes(words, PASSAGE, 100)[at].view(np.int64)))
                held += len(at)
            if held >= GROUP_WORDS:
                yield told()
                found, held = [], 0
    if found:
        yield told()


def cut(text: str, removed: list[int], spans: np.ndarray) -> tuple[str, int]:
    """``text`` without the removed lines and the words of ``spans (start, end)``, and the words removed; lines that lose all words go."""
    gone, lines, at = set(removed), [], 0
    drop = np.zeros(1, dtype=bool)
    if len(spans):
        drop = np.zeros(int(spans[:, 1].max()) + 1, dtype=bool)
        for a, b in spans.tolist():
            drop[a:b] = True
    n = 0
    for i, line in enumerate(text.split("\n")):
        size = len(line.split())
        mine = drop[at : at + size]
        at += size
        if i in gone:
            n += size
            continue
        if mine.any():
            n += int(mine.sum())
            mine = np.pad(mine, (0, size - len(mine)))
            if mine.all():
                continue
            words = list(re.finditer(r"\S+", line))
            kept = [line[w.start() : words[j + 1].start() if j + 1 < size else len(line)] for j, w in enumerate(words) if not mine[j]]
            line = line[: words[0].start()] + "".join(kept).rstrip()
        lines.append(line)
    return "\n".join(lines), n


def merged(starts: np.ndarray) -> np.ndarray:
    """Maximal ``(start, end)`` runs of words that windows of ``PASSAGE`` words at ``starts`` cover."""
    if not len(starts):
        return np.zeros((0, 2), dtype=np.int64)
    starts = np.sort(starts).astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], np.diff(starts) > PASSAGE]))
    return np.stack([starts[new], starts[np.concatenate([new[1:], [len(starts)]]) - 1] + PASSAGE], axis=1)


def _cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for texts, removed, starts in batches:
        rows = []
        for t, r, s in zip(texts, removed, starts, strict=True):
            if t is None:
                rows.append((None, 0, 0))
                continue
            spans = merged(np.zeros(0) if s is None else s)
            kept, n = cut(t, [] if r is None else r.tolist(), spans)
            rows.append((kept, n, len(spans)))
        yield pd.DataFrame(rows, columns=["text", "n_removed", "n_spans"])


def passages(texts: DataFrame, found: DataFrame, gone: DataFrame) -> DataFrame:
    """``(k2, x2, starts)``: where runs of ``PASSAGE`` words in ``texts (k, x, t)`` start that occurred before.

    Lines already removed (``gone``) neither go again nor count as an earlier place. The first
    of all places stays.
    """
    n_gone = gone.count()
    kind = dict(texts.dtypes)["k"]
    each = found.select("k", "x", F.explode(F.arrays_zip("pos", "h", "first", "last")).alias("a")).select("k", "x", "a.*")
    same = F.col("k").eqNullSafe(F.col("k2")) & (F.col("x") == F.col("x2"))
    each = each.join(sized(gone, n_gone, 64), same, "left").where("removed IS NULL OR NOT exists(removed, i -> i BETWEEN first AND last)")
    each = each.select("k", "x", "pos", "h")
    twice = materialize(each.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h"), "twice")
    held = each.join(sized(twice, twice.count(), 8), "h").groupBy("k", "x").agg(F.collect_list("pos").alias("places"))
    held = held.join(sized(gone, n_gone, 64), same, "left").select(F.col("k").alias("k2"), F.col("x").alias("x2"), "places", "removed")
    held = materialize(held, "places")
    inner = texts.join(sized(held, held.count(), 128), same).select("k", "x", "t", "removed", "places")
    runs = materialize(inner.mapInPandas(_runs, f"k {kind}, x long, pos int, hi long, lo long"), "runs")
    firsts = runs.groupBy("hi", "lo").agg(F.min(F.struct("k", "x", "pos")).alias("f"), F.count(F.lit(1)).alias("n")).where("n > 1")
    firsts = materialize(firsts.select("hi", "lo", "f"), "firsts")
    later = runs.join(sized(firsts, firsts.count(), 48), ["hi", "lo"]).where(~F.struct("k", "x", "pos").eqNullSafe(F.col("f")))
    later = later.groupBy("k", "x").agg(F.collect_set("pos").alias("starts")).select(F.col("k").alias("k2"), F.col("x").alias("x2"), "starts")
    later = materialize(later, "starts")
    discard(twice, held, runs, firsts)
    return later


def dedup_paragraphs(docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS, jaccard: float = JACCARD, pair_limit: int = PAIR_LIMIT) -> DataFrame:
    """Rows of ``docs`` with ``text`` cleaned and a struct ``dedup(n_removed, n_lines, n_spans, lines)``.

    ``n_removed`` counts the words removed, ``lines`` lists the positions of whole lines that
    went as paragraphs (``n_lines`` of them), ``n_spans`` counts the passages cut elsewhere.
    """
    texts = docs.where(F.col(text).isNotNull()).select(F.col(key).alias("k"), F.xxhash64(text).alias("x"), F.col(text).alias("t"))
    kind = dict(texts.dtypes)["k"]
    same = F.col("k").eqNullSafe(F.col("k2")) & (F.col("x") == F.col("x2"))
    schema = f"k {kind}, x long, at array<int>, pid array<binary>, keys array<bigint>, pos array<int>, h array<bigint>, first array<int>, last array<int>"
    found = materialize(texts.mapInArrow(_read(BANDS, min_words, True), schema), "signatures")

    # distinct paragraphs, each with its keys and first place
    lines = found.select("k", "x", F.posexplode(F.arrays_zip("at", "pid")).alias("i", "l"), "keys")
    lines = lines.select(F.struct("k", "x", "l.at").alias("place"), F.col("l.pid").alias("pid"), F.slice("keys", F.col("i") * BANDS + 1, F.lit(BANDS)).alias("keys"))
    units = lines.groupBy("pid").agg(F.min("place").alias("place"), F.count(F.lit(1)).alias("n"), F.first("keys").alias("keys"))
    units = materialize(units, "paragraphs")

    def sets_of(ids: DataFrame) -> DataFrame:
        asked = units.select("pid", "place").join(sized(ids, ids.count(), 24), "pid")
        asked = asked.groupBy(F.col("place.k").alias("k2"), F.col("place.x").alias("x2")).agg(F.collect_list(F.struct("place.at", "pid")).alias("want"))
        asked = materialize(asked, "asked")
        once = texts.join(sized(asked, asked.count(), 128), same).dropDuplicates(["k", "x"]).select("t", "want")
        return once.mapInPandas(_sets, "pid binary, s array<bigint>")

    named = clusters(units.select("pid", "keys"), sets_of, jaccard, pair_limit)
    named = units.select("pid", "place", "n").join(named, "pid", "left")
    named = materialize(named.where("n > 1 OR comp IS NOT NULL").select("pid", "place", F.coalesce("comp", "pid").alias("comp")), "repeated")
    lead = named.groupBy("comp").agg(F.min("place").alias("lead"))
    leads = materialize(named.join(lead, "comp").select("pid", "lead"), "leads")
    discard(named)
    gone = lines.select("pid", "place").join(sized(leads, leads.count(), 64), "pid").where(~F.col("place").eqNullSafe(F.col("lead")))
    gone = gone.groupBy(F.col("place.k").alias("k2"), F.col("place.x").alias("x2")).agg(F.sort_array(F.collect_set("place.at")).alias("removed"))
    gone = materialize(gone, "removed")
    spans = passages(texts, found.select("k", "x", "pos", "h", "first", "last"), gone)

    marks = gone.select("k2", "x2", "removed").join(spans.select(F.col("k2").alias("k3"), F.col("x2").alias("x3"), "starts"), F.col("k2").eqNullSafe(F.col("k3")) & (F.col("x2") == F.col("x3")), "full_outer")
    # x2 is null where only spans are; keys may be null themselves
    either = lambda a, b: F.when(F.col("x2").isNull(), F.col(b)).otherwise(F.col(a))
    marks = materialize(marks.select(F.struct(either("k2", "k3").alias("k"), either("x2", "x3").alias("x"), "removed", "starts").alias("_mark")), "marks")
    discard(found, units, leads, gone, spans)
    out, names = plain(docs)
    own, body, mark = F.col(names[key]), F.col(names[text]), F.col("_mark")
    out = out.join(sized(marks, marks.count(), 256), own.eqNullSafe(mark["k"]) & (F.xxhash64(body) == mark["x"]), "left")
    cutter = F.pandas_udf(_cut, "text string, n_removed long, n_spans int").asNondeterministic()  # else a filter on the result cuts every text twice
    done = cutter(F.when(mark.isNotNull(), body), mark["removed"], mark["starts"])
    out = out.withColumn("_cut", done)
    told = F.struct(
        F.col("_cut.n_removed").alias("n_removed"),
        F.coalesce(F.size(mark["removed"]), F.lit(0)).alias("n_lines"),
        F.col("_cut.n_spans").alias("n_spans"),
        F.coalesce(mark["removed"], F.array().cast("array<int>")).alias("lines"),
    )
    return restored(out, names, **{text: F.when(mark.isNotNull(), F.col("_cut.text")).otherwise(body), "dedup": told})
