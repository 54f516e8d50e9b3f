"""Exact substring dedup by a common-prefix-aware distributed merge sort of suffixes.

Every byte that a string of ``length`` bytes covers is removed where that string starts
elsewhere too. Steps:

1. Equal texts are one row. A text of two or more copies is covered whole, and stays as a
   partner of others.
2. Sparse suffixes. Of each string of ``length`` bytes the start of the least hashed 16-gram
   among its first ``length / 2`` starts is an anchor. The choice depends on the string alone,
   so equal strings have anchors at equal offsets, and an anchor is followed by ``reach`` bytes of
   each of its strings. Suffixes at anchors whose first ``reach`` bytes occur once (by a
   64-bit hash, which can only keep too many) need not be sorted: prefix doubling as in
   published string sorters.
3. The remaining suffixes, cut to ``length`` bytes and followed by the reversed bytes before
   them, are sorted per task, front-coded (shared prefix length, rest) and exchanged; suffixes
   with equal first ``reach`` bytes meet in one partition. There an LCP loser tree merges the
   runs; it knows each run's common prefix with the last output and compares only what lies
   behind it. Where the merged order shares ``reach`` bytes or more, suffixes form a group.
4. In a group the common prefixes (to the right) and the common reversed left parts tell which
   strings around an anchor occur twice. That settles each string at exactly one anchor.

Texts are written once, bucketed by their digest, and no later join shuffles them. Groups of more
than ``hot`` suffixes (a line that a third of all documents share) never come together:
their strings are counted one by one with partial aggregation instead.

Partitions: ``part_bytes`` of suffixes, and ``TEXT_BYTES`` of texts or as many as the session's
shuffle partitions, whichever is more. Tables are dropped as soon as nothing reads them.

Defined results: null is the empty text; texts shorter than ``length`` bytes stay whole;
overlapping occurrences count; repeated rows cover each other. Extra columns may have any
name, but for the one named ``dedup``, which is replaced; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkhece.llm.common import discard, materialize, plain, restored, shared_dir

LENGTH, GRAM, HOT = 200, 16, 50_000
PART_BYTES, RUN_BYTES, TEXT_BYTES = 8 << 20, 64 << 20, 64 << 20
_M = (1 << 64) - 1
_BASE = 0xD1342543DE82EF95
_INVERSE = pow(_BASE, -1, 1 << 64)
_TABLE = np.array([int.from_bytes(hashlib.sha256(bytes([b])).digest()[:8], "little") | 1 for b in range(256)], dtype=np.uint64)
_powers: list[np.ndarray] = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in ((0, _BASE), (1, _INVERSE)):
            x = np.full(n, base, dtype=np.uint64)
            x[0] = 1
            _powers[k] = np.cumprod(x, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


def anchors(texts: list[bytes], length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of a batch: text number, position, least and greatest offset of its strings, prefix hash.

    The strings of an anchor at ``p`` start at ``p - offset``.
    """
    block = length // 2
    reach = length - block + 1
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    n = len(data)
    sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    begin = np.cumsum(sizes) - sizes
    mark = np.zeros(n + 1, dtype=np.int32)
    long = sizes >= length
    np.add.at(mark, begin[long], 1)
    np.add.at(mark, (begin + sizes - length + 1)[long], -1)
    starts = np.flatnonzero(np.cumsum(mark)[:n] > 0)
    if not len(starts):
        none = np.zeros(0, dtype=np.int64)
        return none, none, none, none, none
    power, inverse = _power(n + 1)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_TABLE[data] * power[:n], out=sums[1:])
    least = (sums[GRAM:] - sums[:-GRAM]) * inverse[: n - GRAM + 1]
    least ^= least >> np.uint64(32)
    least *= np.uint64(0x9E3779B97F4A7C15)
    least &= np.uint64(0xFFFFFFFF00000000)
    least |= np.arange(len(least), dtype=np.uint64)
    width = 1
    while width * 2 <= block:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < block:
        least = np.minimum(least[: -(block - width)], least[block - width :])
    pos = (least[starts] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], pos[1:] != pos[:-1]]))
    last = np.concatenate([first[1:], [len(pos)]]) - 1
    p = pos[first]
    h = (sums[p + reach] - sums[p]) * inverse[p]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xD6E8FEB86659FD93)
    owner = np.searchsorted(begin, p, side="right") - 1
    return owner, p - begin[owner], p - starts[last], p - starts[first], h.view(np.int64)


def _batches(frames: Iterator[pd.DataFrame], most: int = 1 << 18) -> Iterator[pd.DataFrame]:
    for frame in frames:
        cut = np.cumsum(frame["t"].map(len).to_numpy()) // most
        for _, part in frame.groupby(cut, sort=False):
            yield part


def _anchor_rows(length: int):
    """Anchors of a task's texts, as rows ``(k, x, tid, w, known)`` with ``h = k ^ x``.

    Of the anchors of a task that share a hash one goes out under the hash (``k = h``); it
    stands for the others, which are known to be repeated and are spread evenly by a ``k`` of
    their own. So a passage that very many texts hold sends one row a task to one partition.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept = []
        for part in _batches(frames):
            owner, p, lo, hi, h = anchors(part["t"].tolist(), length)
            kept.append((h, part["tid"].to_numpy()[owner], (p << 16) | (hi << 8) | lo))
        if not kept:
            return
        h, tid, w = (np.concatenate(x) for x in zip(*kept, strict=True))
        _, first, back, count = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
        other = np.ones(len(h), dtype=bool)
        other[first] = False
        k = h.copy()
        k[other] = (tid[other] * 0x9E3779B1 + w[other]) * 0x2545F4914F6CDD1D
        for at in range(0, len(h), 1 << 16):
            cut = slice(at, at + (1 << 16))
            yield pd.DataFrame({"k": k[cut], "x": k[cut] ^ h[cut], "tid": tid[cut], "w": w[cut], "known": count[back[cut]] > 1})

    return run


def _repeated(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of rows sorted by ``k``, those that are known or whose ``k`` occurs again. Holds one row over batches."""
    held: pd.DataFrame | None = None  # the last row, while nothing says yet that it is repeated
    last: int | None = None
    for frame in frames:
        if not len(frame):
            continue
        k = frame["k"].to_numpy()
        again = last is not None and k[0] == last
        if held is not None and again:
            yield held
        same = k[1:] == k[:-1]
        keep = frame["known"].to_numpy() | np.concatenate([[again], same]) | np.concatenate([same, [False]])
        held, last = None if keep[-1] else frame.iloc[[-1]], k[-1]
        if keep.any():
            yield frame[keep]


def common(a: bytes, b: bytes, at: int = 0) -> int:
    """Length of the common prefix, of which ``at`` bytes are known."""
    n = min(len(a), len(b))
    if a[at:n] == b[at:n]:
        return n
    step = 16
    while a[at : at + step] == b[at : at + step]:
        at += step
        step *= 2
    end = min(n, at + step)
    while end - at > 1:
        mid = (at + end) // 2
        if a[at:mid] == b[at:mid]:
            at = mid
        else:
            end = mid
    return at


_HEAD = struct.Struct("<I")


def encode(rows: list[tuple[bytes, int, int, int]]) -> bytes:
    """A sorted run ``(key, right, tid, w)`` as one front-coded block."""
    shared, rest, before = [], [], b""
    for key, *_ in rows:
        k = common(before, key)
        shared.append(k)
        rest.append(key[k:])
        before = key
    small = np.array([shared, list(map(len, rest)), [r[1] for r in rows]], dtype="<u2")
    wide = np.array([[r[2] for r in rows], [r[3] for r in rows]], dtype="<i8")
    return _HEAD.pack(len(rows)) + small.tobytes() + wide.tobytes() + b"".join(rest)


def decode(block: bytes) -> Iterator[tuple[int, bytes, int, int, int]]:
    """The rows of a block, each with its common prefix with the one before."""
    (n,) = _HEAD.unpack_from(block)
    small = np.frombuffer(block, dtype="<u2", count=3 * n, offset=4).reshape(3, n).tolist()
    wide = np.frombuffer(block, dtype="<i8", count=2 * n, offset=4 + 6 * n).reshape(2, n).tolist()
    at, key = 4 + 22 * n, b""
    for k, size, right, tid, w in zip(*small, *wide, strict=True):
        key = key[:k] + block[at : at + size]
        at += size
        yield k, key, right, tid, w


def merge(runs: list[Iterator[tuple[int, bytes, int, int, int]]]) -> Iterator[tuple[int, bytes, int, int, int]]:
    """Merge sorted runs with an LCP loser tree.

    ``lcp[i]`` is the common prefix of run i's head with the last output, or with the head
    that beat it. Of two heads the one that shares more with the last output is smaller
    without any comparison; with equal lengths they are compared from there on.
    """
    size = 1
    while size < len(runs):
        size *= 2
    heads: list = [next(r, None) for r in runs] + [None] * (size - len(runs))
    lcp = [0] * size
    tree = [-1] * size

    def beats(i: int, j: int) -> bool:
        a, b = heads[i], heads[j]
        if a is None or b is None:
            return b is None
        if lcp[i] != lcp[j]:
            return lcp[i] > lcp[j]
        x, y = a[1], b[1]
        k = common(x, y, lcp[i])
        wins = x[k : k + 1] < y[k : k + 1] or (k == len(x) == len(y) and i < j)
        if wins:
            lcp[j] = k
        else:
            lcp[i] = k
        return wins

    def play(node: int) -> int:
        if node >= size:
            return node - size
        i, j = play(2 * node), play(2 * node + 1)
        if beats(i, j):
            tree[node] = j
            return i
        tree[node] = i
        return j

    top = play(1) if size > 1 else 0
    while heads[top] is not None:
        _, key, right, tid, w = heads[top]
        yield lcp[top], key, right, tid, w
        heads[top] = head = next(runs[top], None)
        lcp[top] = head[0] if head else -1
        node = (top + size) >> 1
        while node:
            j = tree[node]
            if not beats(top, j):
                tree[node], top = top, j
            node >>= 1


def settle(group: list[tuple[int, bytes, int, int, int]], length: int, pairs: int = 24) -> list[tuple[int, int, int]]:
    """Covered byte ranges ``(tid, start, end)`` that a group of merged suffixes shows.

    ``group`` is in merged order, each with its common prefix with the one before.
    """
    out: list[tuple[int, int, int]] = []
    distinct: list[tuple[int, bytes, int, list[tuple[int, int]]]] = []  # common prefix, key, right, (tid, w)
    for k, key, right, tid, w in group:
        if distinct and k == len(key) == len(distinct[-1][1]) and right == distinct[-1][2]:
            distinct[-1][3].append((tid, w))
        else:
            distinct.append((k, key, right, [(tid, w)]))

    def cover(tid: int, w: int, lo: int, hi: int) -> None:
        p = w >> 16
        out.append((tid, p - hi, p - lo + length))

    singles = []
    for i, (_, _, _, where) in enumerate(distinct):
        if len(where) > 1:
            for tid, w in where:
                cover(tid, w, w & 255, (w >> 8) & 255)
        else:
            singles.append(i)
    if len(distinct) == 1 or not singles:
        return out
    if len(distinct) <= pairs:
        lefts = [key[right:] for _, key, right, _ in distinct]
        for i in singles:
            tid, w = distinct[i][3][0]
            lo, hi = w & 255, (w >> 8) & 255
            for step in (-1, 1):
                shared, j = length, i
                while 0 <= j + step < len(distinct):
                    shared = min(shared, distinct[j if step < 0 else j + 1][0])
                    j += step
                    a = max(lo, length - min(shared, distinct[i][2], distinct[j][2]))
                    if a > hi:
                        break  # farther ones share no more to the right
                    b = min(hi, common(lefts[i], lefts[j]))
                    if a <= b:
                        cover(tid, w, a, b)
        return out
    spans = [((where[0][1]) & 255, (where[0][1] >> 8) & 255) for _, _, _, where in distinct]
    for off in range(min(spans[i][0] for i in singles), max(spans[i][1] for i in singles) + 1):
        seen: dict[bytes, int] = {}
        held: dict[int, bytes] = {}
        for i, (_, key, right, where) in enumerate(distinct):
            if right >= length - off and len(key) - right >= off:
                s = key[: length - off] + b"|" + key[right : right + off]
                seen[s] = seen.get(s, 0) + len(where)
                held[i] = s
        for i in singles:
            if spans[i][0] <= off <= spans[i][1] and seen.get(held.get(i, b""), 0) > 1:
                cover(*distinct[i][3][0], off, off)
    return out


def _suffixes(text: bytes, ws: np.ndarray, length: int) -> Iterator[tuple[bytes, int]]:
    for p in (ws >> 16).tolist():
        right = text[p : p + length]
        yield right + text[max(0, p - length // 2) : p][::-1], len(right)


def _runs(length: int, parts: int):
    """Sorted front-coded runs, one block for each partition."""

    def flush(buffer: list[tuple[int, bytes, int, int, int]]) -> pd.DataFrame:
        buffer.sort()
        blocks, names, at = [], [], 0
        while at < len(buffer):
            end = at
            while end < len(buffer) and buffer[end][0] == buffer[at][0]:
                end += 1
            blocks.append(encode([x[1:] for x in buffer[at:end]]))
            names.append(buffer[at][0])
            at = end
        return pd.DataFrame({"part": names, "block": blocks})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        buffer: list[tuple[int, bytes, int, int, int]] = []
        held = 0
        for frame in frames:
            for tid, text, ws, hs in zip(frame["tid"].tolist(), frame["t"], frame["ws"], frame["hs"], strict=True):
                for (key, right), w, h in zip(_suffixes(text, ws, length), ws.tolist(), hs.tolist(), strict=True):
                    buffer.append(((h & _M) % parts, key, right, tid, w))
                    held += len(key) + 120
                if held > RUN_BYTES:
                    yield flush(buffer)
                    buffer, held = [], 0
        if buffer:
            yield flush(buffer)

    return run


def _merged(length: int):
    reach = length - length // 2 + 1

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int, int]] = []
        group: list[tuple[int, bytes, int, int, int]] = []
        for row in merge([decode(b) for b in frame["block"]]):
            if row[0] < reach and group:
                if len(group) > 1:
                    out += settle(group, length)
                group = []
            group.append(row)
        if len(group) > 1:
            out += settle(group, length)
        a = np.array(out, dtype=np.int64).reshape(-1, 3)
        return pd.DataFrame({"tid": a[:, 0], "a": a[:, 1].astype(np.int32), "b": a[:, 2].astype(np.int32)})

    return run


def _strings(length: int):
    """Every string of the anchors of hot groups, by its digest."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for tid, text, ws in zip(frame["tid"].tolist(), frame["t"], frame["ws"], strict=True):
                at = sorted({(w >> 16) - off for w in ws.tolist() for off in range(length // 2) if 0 <= (w >> 16) - off <= len(text) - length})
                yield pd.DataFrame({"tid": tid, "a": np.array(at, dtype=np.int32), "d": [hashlib.md5(text[s : s + length]).digest() for s in at]})

    return run


def union(spans: np.ndarray) -> np.ndarray:
    """Maximal runs of sorted or unsorted ranges; ranges that touch become one."""
    spans = spans[np.lexsort((spans[:, 1], spans[:, 0]))]
    top = np.maximum.accumulate(spans[:, 1])
    new = np.concatenate([[True], spans[1:, 0] > top[:-1]])
    first = np.flatnonzero(new)
    return np.stack([spans[first, 0], top[np.concatenate([first[1:], [len(spans)]]) - 1]], axis=1)


def _cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        rows = []
        for key, text, a, b in zip(frame["key"], frame["t"], frame["a"], frame["b"], strict=True):
            runs = union(np.stack([a, b], axis=1).astype(np.int64))
            kept, at = [], 0
            for x, y in runs.tolist():
                kept.append(text[at:x])
                at = y
            kept.append(text[at:])
            rows.append((key, int((runs[:, 1] - runs[:, 0]).sum()), hashlib.sha256(b"".join(kept)).hexdigest(), [{"a": x, "b": y} for x, y in runs.tolist()]))
        yield pd.DataFrame(rows, columns=["key", "n_removed", "kept_sha256", "spans"])


def _text_table(docs: DataFrame, text: str, length: int, parts: int) -> DataFrame:
    """Distinct texts ``(tid, key, copied, t)``, bucketed by ``key`` in the shared folder.

    Later joins on ``key`` then shuffle only what is joined to the texts, never the texts. The
    caller drops the table.
    """
    spark = docs.sparkSession
    rows = docs.select(F.sha2(text, 256).alias("key"), F.col(text).alias("s")).where(F.octet_length("s") >= length)
    rows = rows.groupBy("key").agg(F.first("s").alias("s"), F.count(F.lit(1)).alias("copies"))
    rows = rows.select(F.monotonically_increasing_id().alias("tid"), "key", (F.col("copies") > 1).alias("copied"), F.col("s").cast("binary").alias("t"))
    name = f"suffix_texts_{uuid.uuid4().hex}"
    writer = rows.write.option("compression", "zstd").option("path", f"{shared_dir(spark)}/{name}")
    writer.bucketBy(parts, "key").saveAsTable(name)
    out = spark.table(name)
    out.stored_at, out.named = f"{shared_dir(spark)}/{name}", name
    return out


def dedup_substrings(docs: DataFrame, text: str = "text", length: int = LENGTH, hot: int = HOT, part_bytes: int = PART_BYTES) -> DataFrame:
    """Add struct ``dedup(n_bytes, n_removed, kept_sha256, spans)``; ``spans`` are the removed byte ranges."""
    if length < 2 * GRAM + 2 or length > 500:
        raise ValueError("length must be 34 to 500 bytes")
    spark = docs.sparkSession
    n_bytes = docs.agg(F.coalesce(F.sum(F.octet_length(F.col(f"`{text}`"))), F.lit(0))).first()[0]
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), n_bytes // TEXT_BYTES)
    texts = _text_table(docs, text, length, parts)
    names = texts.select("tid", "key")

    found = texts.select("tid", "t").mapInPandas(_anchor_rows(length), "k long, x long, tid long, w long, known boolean")
    found = found.repartition(parts, "k").sortWithinPartitions("k").mapInPandas(_repeated, "k long, x long, tid long, w long, known boolean")
    again = materialize(found.select(F.col("k").bitwiseXOR(F.col("x")).alias("h"), "tid", "w"), "suffixes")
    groups = again.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot).select("h")
    groups = materialize(groups, "hot")
    any_hot = groups.count()
    cold = again.join(F.broadcast(groups) if any_hot < 1_000_000 else groups, "h", "left_anti") if any_hot else again

    def by_key(df: DataFrame) -> DataFrame:
        """Anchors of each text; their number is bounded by the text's length."""
        packed = df.groupBy("tid").agg(F.collect_list(F.struct("w", "h")).alias("x")).select("tid", F.col("x.w").alias("ws"), F.col("x.h").alias("hs"))
        return names.join(packed.hint("merge"), "tid").select("key", "ws", "hs")

    n_parts = max(1, -(-cold.count() * (length + length // 2) // part_bytes))
    runs = texts.select("key", "tid", "t").join(by_key(cold).hint("merge"), "key").mapInPandas(_runs(length, n_parts), "part long, block binary")
    ranges = runs.groupBy("part").applyInPandas(_merged(length), "tid long, a int, b int")
    if any_hot:
        every = texts.select("key", "tid", "t").join(by_key(again.join(groups, "h", "left_semi")).hint("merge"), "key")
        every = materialize(every.mapInPandas(_strings(length), "tid long, a int, d binary"), "strings")
        twice = every.groupBy("d").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("d")
        ranges = ranges.union(every.join(materialize(twice, "twice"), "d", "left_semi").select("tid", "a", (F.col("a") + length).alias("b")))
    ranges = ranges.groupBy("tid").agg(F.collect_list(F.struct("a", "b")).alias("x")).select("tid", F.col("x.a").alias("a"), F.col("x.b").alias("b"))
    ranges = names.join(ranges.hint("merge"), "tid").select("key", "a", "b")
    touched = texts.where("NOT copied").select("key", "t").join(ranges.hint("merge"), "key")
    spans = "array<struct<a:int,b:int>>"
    done = touched.mapInPandas(_cut, f"key string, n_removed long, kept_sha256 string, spans {spans}")
    whole = texts.where("copied").select(
        "key", F.octet_length("t").cast("long").alias("n_removed"), F.sha2(F.lit(b""), 256).alias("kept_sha256"), F.array(F.struct(F.lit(0).alias("a"), F.octet_length("t").alias("b"))).alias("spans")
    )
    done = materialize(done.union(whole).select(F.struct("key", "n_removed", "kept_sha256", "spans").alias("_cut")), "cut")
    spark.sql(f"DROP TABLE {texts.named}")
    discard(texts, again, groups)
    out, names = plain(docs)
    body = F.coalesce(F.col(names[text]), F.lit(""))
    out = out.withColumn("_key", F.sha2(body, 256)).join(done, F.col("_key") == F.col("_cut.key"), "left")
    told = F.struct(
        F.octet_length(body).cast("long").alias("n_bytes"),
        F.coalesce("_cut.n_removed", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("_cut.kept_sha256", "_key").alias("kept_sha256"),
        F.coalesce("_cut.spans", F.array().cast(spans)).alias("spans"),
    )
    return restored(out, names, dedup=told)
