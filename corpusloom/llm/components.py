"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, packed, sorted_side


def _state(edges: DataFrame) -> tuple:
    r = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x"), F.sum(F.xxhash64("v", "u").cast("decimal(20,0)")).alias("s")).first()
    return r.n, r.x, r.s


def components(edges: DataFrame, rows: int | None = None) -> DataFrame:
    """(node, root): the smallest node reachable, for every node with an edge. ``edges``: (u, v), any order,
    repeats and loops allowed; ``rows``, if known, about how many at most.

    Each round is two aggregations of minima (combined map-side) and two equi-joins whose skewed sides
    adaptive execution may split; none is broadcast; neighbour lists are never collected. Each join is read once, and its rows give both edges.
    Rounds grow with the logarithm of the nodes. Three numbers a round reach the driver. A round's stages have as many tasks as
    its edges need: the joins' results lie in few partitions, so only their readers follow the session's number.
    """
    tidy = lambda e: e.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now = cut(tidy(edges) if rows is None else packed(tidy(edges), rows))
    state = _state(now)
    while state[0]:
        few = lambda e, n=2 * state[0]: packed(e, n)
        both = now.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.u", "e.v")
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = few(tidy(few(both.where("v > u").join(sorted_side(low), "u").select(F.col("v").alias("u"), F.col("m").alias("v")))))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        ends = F.explode(F.array("u", "v")).alias("u")  # the edge of v and m, where they are equal, is a loop that goes
        now = cut(few(tidy(few(large.join(sorted_side(low), "u").select(ends, F.col("m").alias("v"))))))
        before, state = state, _state(now)
        if state == before:
            break
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(packed(roots, state[0]))
