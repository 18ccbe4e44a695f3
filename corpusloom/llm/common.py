"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import math
import tempfile

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: ASCII white space, the complement of the word characters used by every word rule here.
WHITE = r"\x20\x09-\x0D"
WORD = rf"[^{WHITE}]+"

_BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 4 << 20
EACH = 100_000  # rows of a few numbers, for a partition of a small result


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset a fresh local
    one is made in local mode, as in tests; a cluster must name one."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage by a reliable checkpoint, so that a lost executor costs no recomputation and
    Python stages run once though several plans read them."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def packed(df: DataFrame, rows: int, each: int = EACH) -> DataFrame:
    """``df``, of about ``rows`` rows at most, in partitions of about ``each``, and in as many as the cluster has cores at least; as it is, if
    the session's shuffles have no more. A job of many stages over a small result would have a task for each of the
    session's shuffle partitions in all of them, and the driver keeps a record of each task."""
    spark = df.sparkSession
    wanted = max(spark.sparkContext.defaultParallelism, -(-rows // each))
    return df.coalesce(wanted) if wanted < int(spark.conf.get("spark.sql.shuffle.partitions")) else df


def sorted_side(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join whose sides are shuffled anyway: they are merged. Adaptive execution would broadcast a small one, and
    each broadcast within a minute takes a thread of its own in the driver, with its stack and its memory pool."""
    return df.hint("merge")


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, whose rows will go to Python workers in Arrow batches of about BATCH_BYTES: by rows alone a batch of long texts
    would be many MB, held several times over. The session's setting is changed unless the user has one."""
    if df.sparkSession.conf.get(_BATCH_CONF, None) is None:
        df.sparkSession.conf.set(_BATCH_CONF, str(BATCH_BYTES))
    return df


def give_back() -> None:
    """Return what a Python worker has freed to the system: workers are kept for later stages, whose JVM shares the limit."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL(None).malloc_trim(0)


def fold(doc_id: Column | str, modulus: int) -> Column:
    """crc32 of the id as text, modulo: the rule that keeps rows out of training."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string").cast("binary")), F.lit(0)) % modulus


def hash_below(df: DataFrame, rank: str, limit: int) -> int | None:
    """The ``limit``-th smallest value of the column ``rank`` (distinct hashes, evenly spread over the longs),
    or null if there are no more. Only about ``limit`` values are sorted, however many there are."""
    n = df.count()
    if n <= limit:
        return None
    guess = -(1 << 63) + int((1 << 64) * min(1.0, (1.2 * limit + 100) / n))
    low = df if guess >= 1 << 63 else df.where(F.col(rank) < guess)
    return low.orderBy(rank).limit(limit).agg(F.max(rank)).first()[0]


def labelled_sample(rows: DataFrame, limit: int) -> DataFrame:
    """At most ``limit`` labelled rows: those whose ids have the smallest hashes. ``rows`` must hold distinct ids
    and labels only, so what is sorted and later broadcast is bounded by ``limit``."""
    ranked = rows.withColumn("_rank", F.xxhash64("doc_id"))
    most = hash_below(ranked, "_rank", limit)
    return (ranked if most is None else ranked.where(F.col("_rank") <= most)).orderBy("_rank", "doc_id").limit(limit).drop("_rank")


def gapless_rank(df: DataFrame, group: list[str], order: list[str], name: str, cells: int | None = None, rows: int | None = None) -> DataFrame:
    """Add a 0-based rank without gaps inside each ``group``, though a group may hold any share of the rows.

    A group is split by a hash of ``order`` into about sqrt(rows) cells. Cells are counted (map-side
    combined), running sums over the counts give each cell's first rank, and a window inside one cell
    gives the rest. No task sorts more than a cell or a group's list of cells. ``df`` is read twice, so
    give a checkpointed one. Rows equal in ``order`` are interchangeable and share a cell, so ``order`` should hold
    what tells rows apart; ranks then don't depend on how rows lie in partitions.
    """
    if cells is None:
        cells = max(1, math.isqrt(rows if rows is not None else df.count()))
    df = df.withColumn("_cell", F.pmod(F.xxhash64(*order), F.lit(cells)))
    keys = [*group, "_cell"]
    before = Window.partitionBy(*group).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).select(*keys, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    inside = Window.partitionBy(*keys).orderBy(*order)
    return df.join(offsets, keys).withColumn(name, F.col("_first") + F.row_number().over(inside) - 1).drop("_cell", "_first")


def join_hot(many: DataFrame, one: DataFrame, key: str, count: str, rows: int, how: str = "inner", most: int = 500) -> DataFrame:
    """``many`` joined to ``one`` on ``key``, which is distinct there, though one key may hold any share of ``many``.

    ``count`` is a column of ``one``: how many rows of ``many`` have the key; ``rows`` is their sum. Keys with
    more than a ``most``-th of it, so fewer than ``most`` of them, are broadcast; the others are shuffled. Both
    sides are read twice, so give checkpointed ones. ``how``: inner or left_semi.
    """
    least = rows // most + 1
    hot, cold = F.broadcast(one.where(F.col(count) >= least)), one.where(F.col(count) < least)
    return many.join(hot, key, how).unionByName(many.join(hot.select(key), key, "left_anti").join(cold, key, how))


def if_small(df: DataFrame, rows: int, most: int = 500_000) -> DataFrame:
    """``df``, to be broadcast if its ``rows`` (of a few numbers each, some MB in all) are at most ``most``; beyond
    that a join shuffles."""
    return F.broadcast(df) if rows <= most else df
