"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Every shard owns ``vnodes`` points of a ring. A key belongs to the first point clockwise of its hash
(the point's *arc*). A shard takes keys of its own arcs, in ring order, up to its capacity; keys that
find it full continue clockwise to the next point whose shard has room. Keys of one arc have the same
walk, so the whole placement follows from the number of keys in each arc: at most shards * vnodes
counts reach the driver, however many rows there are. Which rows of an arc stay and which move on is
settled by their rank in the arc.
"""

from __future__ import annotations

import bisect
import hashlib
import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, gapless_rank

SPACE = 63  # bits of a ring position
CELL_BITS = 12


def ring(shards: int, vnodes: int) -> list[tuple[int, int]]:
    """The points (position, shard) in ring order. A shard's points depend on its number alone, so one
    more shard leaves the others' points where they are."""
    def place(s: int, v: int) -> int:
        return int.from_bytes(hashlib.blake2b(f"{s}/{v}".encode(), digest_size=8).digest(), "big") >> 1

    return sorted((place(s, v), s) for s in range(shards) for v in range(vnodes))


def capacities(rows: int, shards: int, epsilon: float) -> list[int]:
    """epsilon 0: quotas that differ by one at most and sum to ``rows``. Else ceil((1 + epsilon) * mean)."""
    if epsilon > 0:
        return [math.ceil((1 + epsilon) * rows / shards)] * shards
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def place_arcs(points: list[tuple[int, int]], counts: dict[int, int], room: list[int]) -> list[tuple[int, int, int, int, int]]:
    """Pieces (arc, first rank, end rank, shard, first slot): arc ``a``'s keys of those ranks go to that shard."""
    room, used, pieces, left = list(room), [0] * len(room), [], {}

    def take(arc: int, first: int, shard: int, n: int) -> None:
        if n:
            pieces.append((arc, first, first + n, shard, used[shard]))
            used[shard] += n
            room[shard] -= n

    for arc, (_, shard) in enumerate(points):
        n = counts.get(arc, 0)
        own = min(n, room[shard])
        take(arc, 0, shard, own)
        left[arc] = (own, n)
    for arc, (first, n) in left.items():
        step = arc
        while first < n:
            step += 1
            shard = points[step % len(points)][1]
            more = min(n - first, room[shard])
            take(arc, first, shard, more)
            first += more
    return pieces


def assign_shards(df: DataFrame, key: str = "doc_id", tie: tuple[str, ...] = (), shards: int = 16, vnodes: int = 64, epsilon: float = 0.0) -> DataFrame:
    """Add ``shard`` and ``slot`` (gapless from 0 within the shard) to the rows of ``df``.

    Keys are hashed with XXH64; ``tie`` names further columns that order rows of one key. A null key is a
    key like any other; repeated rows are placed one by one; an empty table gives no rows. Columns of
    ``df`` called ``shard`` or ``slot`` are replaced. With epsilon 0 the shards' row counts differ by one
    at most; with a larger one fewer keys move when shards come or go, and none exceeds (1 + epsilon)
    times the mean. ``df`` should be narrow: it is checkpointed and shuffled once.
    """
    spark = df.sparkSession
    points = ring(shards, vnodes)
    places = [p for p, _ in points]
    # The ring as closed intervals, cut at cell borders so that an equi-join on the cell finds them.
    width = SPACE - CELL_BITS
    edges = sorted({0, 1 << SPACE} | {c << width for c in range(1 << CELL_BITS)} | {p + 1 for p in places})
    spans = [(lo >> width, lo, hi - 1, bisect.bisect_left(places, lo) % len(points)) for lo, hi in zip(edges, edges[1:])]
    arcs = spark.createDataFrame(spans, "_cell int, _lo long, _hi long, _arc int")  # 2^12 cells + shards * vnodes rows

    base = df.drop("shard", "slot").withColumn("_pos", F.shiftrightunsigned(F.xxhash64(key), 1))
    base = base.withColumn("_cell", F.shiftright("_pos", width).cast("int"))
    base = cut(base.join(F.broadcast(arcs), (base._cell == arcs._cell) & F.col("_pos").between(F.col("_lo"), F.col("_hi"))).drop("_cell", "_lo", "_hi"))
    counts = {r._arc: r.n for r in base.groupBy("_arc").agg(F.count(F.lit(1)).alias("n")).collect()}
    rows = sum(counts.values())
    pieces = place_arcs(points, counts, capacities(rows, shards, epsilon))
    table = spark.createDataFrame(pieces, "_arc int, _from long, _to long, shard int, _slot long")  # at most arcs + steps over full shards
    ranked = gapless_rank(base, ["_arc"], ["_pos", key, *tie], "_rank", cells=max(1, math.isqrt(rows // len(points) + 1)))
    inside = (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to"))
    out = ranked.join(F.broadcast(table), "_arc").where(inside)
    return out.withColumn("slot", F.col("_slot") + F.col("_rank") - F.col("_from")).select(*[c for c in df.columns if c not in ("shard", "slot")], "shard", "slot")


def sharded_documents(docs: DataFrame, shards: int = 16) -> DataFrame:
    """The digest of ``assign_shards`` that op4 returns: law ``rows``."""
    data = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    narrow = docs.select("doc_id", (F.octet_length(data) + 1).cast("long").alias("size"), F.crc32(data).alias("text_crc32"))
    placed = assign_shards(narrow, "doc_id", ("text_crc32", "size"), shards)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
