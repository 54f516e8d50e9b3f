"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` below ``sf_dir`` (any path that Spark can open)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_own: dict[str, str] = {}  # by application: the folder of sessions that name none
MAX_BROADCAST = 32 << 20  # bytes of rows, as estimated from a count and the width of a row


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is the session's ``spark.checkpoint.dir``. Only where that is unset in a local session
    (driver and executors are one process, as in tests) a temporary folder is made, once for
    the application; a cluster without the setting is refused. Tables that were written there
    may be removed when the job has ended.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="sparkhece-")
    return _own[app]


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    This cuts the lineage and survives the loss of executors, and the size of what was
    written is known to the planner afterwards.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(*frames: DataFrame) -> None:
    """Remove tables of ``materialize`` that nothing reads any more."""
    for df in frames:
        path = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(df.stored_at)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def sized(df: DataFrame, rows: int, width: int, most: int = MAX_BROADCAST) -> DataFrame:
    """``df`` for a broadcast if ``rows`` rows of ``width`` bytes are within ``most``, else as it is (the join is shuffled)."""
    return F.broadcast(df) if rows * width <= most else df


def plain(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with its columns named ``_c0, _c1, ...`` and those names by the own ones, so that no own name clashes with a joined one."""
    names = {c: f"_c{i}" for i, c in enumerate(df.columns)}
    return df.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()]), names


def restored(df: DataFrame, names: dict[str, str], **results: Column) -> DataFrame:
    """The columns of ``names`` under their own names, with ``results`` in their place or behind them."""
    made = {c: f"_r{i}" for i, c in enumerate(results)}
    df = df.select(*names.values(), *[x.alias(made[c]) for c, x in results.items()])  # names are given back last, as a select may refer to its own
    return df.select(*[F.col(made.get(c, n)).alias(c) for c, n in names.items()], *[F.col(n).alias(c) for c, n in made.items() if c not in names])


def fold(key: Column, mod: int) -> Column:
    """crc32 of the key as text, modulo ``mod``; a null key counts as the empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % mod


def labelled_sample(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, most: int, salt: int) -> DataFrame:
    """Rows ``(k, k2, y, t)`` of at most ``most`` labelled keys, those of least key hash.

    The sample is drawn from the label table alone, so what is broadcast is bounded by
    ``most`` at every size and no text is shuffled. ``(k, k2, y)`` orders the rows.
    """
    chosen = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull())
    chosen = chosen.select(F.xxhash64(F.col(key).cast("string"), F.lit(salt)).alias("k"), F.col(key).alias("_id"), F.col(label).cast("int").alias("y"))
    chosen = F.broadcast(chosen.orderBy("k", "_id", "y").limit(most))
    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("t")).where(F.col("t").isNotNull())
    return rows.join(chosen, F.col("_key") == F.col("_id")).select("k", F.xxhash64("t").alias("k2"), "y", "t")


def components(edges: DataFrame, name: str = "cc") -> DataFrame:
    """Connected components of an edge table ``(a, b)``: ``(node, comp)``, comp = least node.

    Alternating large-star and small-star rounds. Each round is two joins on node keys whose
    minima were aggregated first (partial aggregation on the map side), so a node with very
    many neighbours costs one row per neighbour and the join may be split by AQE. Rounds are
    written to the shared folder; they are logarithmic in the longest path, and end when every
    component is a star around its least node. Self loops are kept as single nodes; null ends
    are dropped.
    """
    edges = edges.where("a IS NOT NULL AND b IS NOT NULL")
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    cur = materialize(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
        name,
    )
    nodes = materialize(nodes, name + "-nodes")
    while True:
        old = cur
        # large star: every neighbour above u is linked to the least node around u
        both = cur.select("a", "b").union(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        large = materialize(
            both.where("b > a").join(least, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(),
            name,
        )
        # small star: u and its lower neighbours are linked to the least of them
        lower = materialize(large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), "m"), name)
        hung = large.join(lower, F.col("a") == F.col("u")).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        cur = materialize(hung.union(lower.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct(), name)
        discard(old, large, lower)
        # done when all are stars: nothing hangs on a node that hangs itself, and nothing hangs twice
        ends = cur.select(F.col("a").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(cur.select(F.col("b"), F.lit(0), F.lit(1)))
        ends = ends.groupBy("x").agg(F.sum("up").alias("up"), F.sum("down").alias("down"))
        if ends.where("up > 1 OR (up > 0 AND down > 0)").isEmpty():
            break
    return nodes.join(cur, F.col("node") == F.col("a"), "left").select("node", F.coalesce("b", "node").alias("comp"))
