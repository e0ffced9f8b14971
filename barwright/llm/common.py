"""Shared folder, checkpoints and connected components for the corpus operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir); unset, it must be one machine's local mode, as in tests."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="barwright-"))
    return context.getCheckpointDir()


#: Texts go to Python in Arrow batches of at most so many bytes; Spark's own limit lets a task hold several times 64 MB.
BATCH_BYTES = 1 << 20


def small_batches(df: DataFrame) -> DataFrame:
    """df, after its session's limit on the bytes of an Arrow batch is lowered to BATCH_BYTES; it stays so, as plans run later."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int("".join(filter(str.isdigit, df.sparkSession.conf.get(name)))) > BATCH_BYTES:
        df.sparkSession.conf.set(name, str(BATCH_BYTES))
    return df


def keep(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint: for small tables that several jobs read."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Rows of a few numbers that are worth a task.
ROWS_A_TASK = 200_000


def packed(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Kept, in as few partitions as its rows (or at most so many) ask for: a shuffle writes files for each of them, however small."""
    df = keep(df)
    return df.coalesce(max(1, -(-(df.count() if rows is None else rows) // ROWS_A_TASK)))


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write to Parquet in the shared folder and read it back: for wide tables that several jobs read."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path)


def small(df: DataFrame, most: int = 100_000) -> DataFrame:
    """Kept, and sent to all tasks if it has at most so many rows (of a few numbers); else joined by a shuffle."""
    df = keep(df)
    return F.broadcast(df) if df.count() <= most else df


#: join_by_key sends the keys of more rows than this, and than one in HEAVY_SHARE, to all tasks.
HEAVY_ROWS, HEAVY_SHARE = 200, 20_000


def join_by_key(rows: DataFrame, by_key: DataFrame, key: str, size: str, n: int | None = None) -> DataFrame:
    """rows joined to by_key, which has one row a key and the number of `rows` with that key in column `size`.

    A shuffled join would put all rows of a key into one task. So frequent keys are broadcast, at most HEAVY_SHARE or
    one in HEAVY_ROWS of n rows, and only the others are shuffled. rows and by_key should be kept: both are read twice.
    n: how many rows there are, if known. Rows without a match are left out.
    """
    least = max(HEAVY_ROWS, (rows.count() if n is None else n) // HEAVY_SHARE)
    heavy = by_key.where(F.col(size) > least)
    columns = [*rows.columns, *[c for c in by_key.columns if c != key]]
    some = rows.join(F.broadcast(heavy), key).select(columns)
    rest = rows.join(F.broadcast(heavy.select(key)), key, "left_anti").join(by_key.where(F.col(size) <= least), key).select(columns)
    return some.unionByName(rest)


def components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """Connected components of edges(a, b) of longs: (node, root), root the smallest node reachable, for every node of an edge.

    Alternating large-star and small-star rounds. A round is a group-by with map-side combining and a join on the node
    in which nodes of high degree are broadcast; no neighbourhood is ever gathered in one row or one task.
    The fixed point is a star per component. Self-loops and repeated edges are allowed; an empty input gives no rows.
    """
    both = lambda e: e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    star = keep(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    seen = None
    for _ in range(max_rounds):
        mark = star.agg(F.count("*"), F.coalesce(F.expr("bit_xor(xxhash64(u, v))"), F.lit(0))).first()
        if mark == seen or mark[0] == 0:
            break
        seen = mark
        star = star.coalesce(max(1, -(-mark[0] // ROWS_A_TASK)))
        sides = both(star)
        least = sides.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("d")).select("u", F.least("u", "m").alias("m"), "d")
        large = join_by_key(sides, least, "u", "d", 2 * mark[0]).where("v > u")
        large = packed(large.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), 2 * mark[0])
        below = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("d"))
        joined = join_by_key(large, below, "u", "d", 2 * mark[0]).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        star = keep(joined.unionByName(below.select("u", F.col("m").alias("v"))).distinct())
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return star.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(star.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
