"""Documents linked by the Jaccard similarity of their word shingles.

Equal shingle sets are one node. Candidates share one of BANDS keys of ROWS min-hashes each; a pair at
similarity 0.8 shares none with a chance of (1 - 0.8**4)**20, about 3 in 100,000, and a closer pair with
less. Every candidate is compared by its whole shingle sets, and none is capped.

Comparing all pairs of a bucket would grow with the square of its size. So in each of STARS rounds only one
document of a bucket, the one that shares most buckets with others, is compared with the rest; a bucket
is done once its documents are in one component. The documents of what is left are joined by prefix filtering,
which is exact: a set's shingles are put in one order, rare ones first, and two sets at the least similarity
share one of the first few, early enough in both. Unlinked copies of one text meet only there, not in the
buckets, and their first shingles are those in which they differ.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, give_back, if_small, join_hot, packed, small_batches, sorted_side
from .components import components

BANDS, ROWS = 20, 4
STARS = 2
SMALL = 1_000_000  # hashes, 8 MB: the sets of one side of the candidate pairs up to this size are broadcast
PAIRS = 25_000  # candidates, whose sets are compared, for a partition
HASHES = 500_000  # of whole sets, 4 MB, for a partition
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_MIX = np.random.default_rng(5).integers(0, 1 << 63, (2, BANDS * ROWS, 1), np.uint64) * np.uint64(2) + np.uint64(1)
_BLOCK, _BITS = 1 << 12, 1 << 18


def words(data: bytes) -> list[bytes]:
    """Runs of non-white-space, lower-cased in A-Z."""
    return data.translate(_LOWER).split()


def grams(found: list[bytes], shingle: int) -> np.ndarray:
    """The distinct hashes of all runs of ``shingle`` words, sorted; a shorter text is one run."""
    n = len(found) - shingle + 1
    runs = zip(*(found[i:] for i in range(shingle))) if n > 0 else [found] if found else []
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(b" ".join(r)) for r in runs), np.uint64))


def least_hashes(h: np.ndarray) -> np.ndarray:
    """BANDS * ROWS min-hashes of a shingle set; none of an empty one."""
    if not len(h):
        return np.zeros(0, np.uint64)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for first in range(0, len(h), _BLOCK):
        np.minimum(least, (h[None, first : first + _BLOCK] * _MIX[0] + _MIX[1]).min(1), out=least)
    return least


def bands(least: np.ndarray, tag: int = 0) -> list[int]:
    """A hash of each band of min-hashes; none without a shingle."""
    made = [xxhash.xxh64_intdigest(least[k : k + ROWS].tobytes(), tag * BANDS * ROWS + k) for k in range(0, len(least), ROWS)]
    return np.array(made, "u8").view("i8").tolist()


def majority(h: np.ndarray) -> int:
    """Signed SimHash of distinct shingle hashes; 0 without one."""
    total = np.zeros(64, np.int64)
    for first in range(0, len(h), _BITS):
        part = h[first : first + _BITS].astype("<u8")
        total += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > len(h), bitorder="little").view("<i8")[0])


def _sketches(docs: DataFrame, shingle: int, whole: bool) -> DataFrame:
    """(doc_id, text_hash, node, n, fp, list): the shingle set's name, size and SimHash, and its keys or the
    ``whole`` set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 500):
                part = batch.slice(first, 500)
                sets = [grams(words(t.as_py() or b""), shingle) for t in part.column("text")]
                node = np.array([xxhash.xxh64_intdigest(h.tobytes()) for h in sets], "u8").view("i8")
                made = sets if whole else [np.array(bands(least_hashes(h)), "i8") for h in sets]
                size = [len(h) for h in made]
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(size)], pa.int32()), pa.array(np.concatenate(made).view("i8")))
                fp = np.array([0 if whole else majority(h) for h in sets], "i8")
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text_hash"), pa.array(node), pa.array([len(h) for h in sets], pa.int32()), pa.array(fp), lists], ["doc_id", "text_hash", "node", "n", "fp", "list"])
        give_back()

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = small_batches(docs).select("doc_id", F.xxhash64("text").alias("text_hash"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, text_hash long, node long, n int, fp long, list array<long>")


def _prefix_pairs(rest: DataFrame, percent: int) -> DataFrame:
    """(a, m, b, n): all pairs of sets (node, n, root, list) of different roots that may reach ``percent``, m and n
    their sizes. Each of the two has a shingle of the other among its first n - ceil(percent * n / 100) + 1, and the
    first that they share leaves enough shingles behind it in both. ``rest`` is read several times."""
    hashes = rest.agg(F.sum("n")).first()[0] or 0
    each = rest.select("node", "n", "root", F.explode("list").alias("t"))
    often = each.groupBy("t").agg(F.count(F.lit(1)).alias("rows"))
    order = packed(each.join(sorted_side(often), "t"), hashes).groupBy("node", "n", "root").agg(F.array_sort(F.collect_list(F.struct("rows", "t"))).alias("found"))
    first = order.select("node", "n", "root", F.posexplode(F.expr(f"slice(found, 1, n - cast(ceil({percent} * n / 100) AS int) + 1)")).alias("at", "x"))
    keys = cut(packed(first.where("x.rows > 1").select("node", "n", "root", "at", F.col("x.t").alias("t")), hashes))
    other = keys.selectExpr("t", "node AS a", "n AS m", "root AS _root", "at AS _at")
    enough = f"{100 + percent} * least(m - _at, n - at) >= {percent} * (m + n)"
    return keys.withColumnRenamed("node", "b").join(other, "t").where(f"a < b AND root <> _root AND {enough}").select("a", "m", "b", "n")


def groups(docs: DataFrame, shingle: int = 5, percent: int = 80, more_keys: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(doc_id, text_hash, component, component_id) of every row: linked are texts whose shingle sets have a Jaccard
    similarity of ``percent`` or more; component is a number, component_id the smallest doc_id reachable.

    ``more_keys`` gives further bucket keys (node, n, key) for the distinct sets (node, n, fp, ...). Texts without a word,
    null ones too, have equal sets; a shorter text is one shingle; repeated rows and equal sets are one node,
    however many there are; an empty table gives no rows; further columns are ignored. A similarity of exactly
    ``percent`` links. A null doc_id never names a component unless it holds no other.
    """
    docs = docs.select("doc_id", "text")
    prints = cut(_sketches(docs, shingle, False))
    total = prints.count()
    made = prints.groupBy("node").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("list").alias("keys"), F.count(F.lit(1)).alias("rows"))
    classes = cut(packed(made, total))
    spread = classes.select("node", "n", F.explode("keys").alias("key"))
    if more_keys is not None:
        spread = spread.union(more_keys(classes).select("node", "n", "key"))
    sizes = spread.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    met = cut(packed(spread.join(sorted_side(sizes), "key"), total * (BANDS + 1)))
    rows = met.count()
    degree = cut(packed(met.groupBy("node").agg(F.sum("size").alias("degree")), min(rows, total)))
    members = packed(met.join(sorted_side(degree), "node").select("key", "node", "n", "degree", F.col("node").alias("root")), rows)
    wanted = cut(packed(classes.join(degree, "node", "left_semi").select(F.col("rep").alias("_rep"), "n"), total))
    reps, hashes = wanted.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    sets = _sketches(docs.join(if_small(wanted.select("_rep").distinct(), reps), docs.doc_id.eqNullSafe(F.col("_rep")), "left_semi"), shingle, True)
    sets = cut(packed(sets.join(degree, "node", "left_semi").select("node", "n", "list").dropDuplicates(["node"]), hashes, HASHES))

    def linked(pairs: DataFrame, rows: int | None) -> DataFrame:
        """The pairs, ``rows`` at most if that is known, that reach ``percent``. Sets go to the pairs by a shuffle, those of b
        first, as few centres serve many pairs; a side whose sets are small in all is broadcast."""
        pairs = pairs.where(f"100 * least(m, n) >= {percent} * greatest(m, n)").select("a", "m", "b", "n")
        if rows is None:
            pairs = cut(pairs.distinct())
            rows = pairs.count()
            pairs = packed(pairs, rows, PAIRS)
        else:
            pairs = cut(packed(packed(pairs, rows).distinct(), rows, PAIRS))
        ends = F.explode(F.array(*(F.struct(F.lit(side).alias("side"), F.col(side).alias("node"), F.col(size).alias("n")) for side, size in (("a", "m"), ("b", "n")))))
        used = packed(pairs.select(ends.alias("x")).select("x.*").distinct(), 2 * rows)
        hashes = used.agg(*(F.coalesce(F.sum(F.when(F.col("side") == side, F.col("n"))), F.lit(0)).alias(side) for side in "ab")).first()
        most = max(rows, (hashes["a"] + hashes["b"]) * PAIRS // HASHES)  # a task reads the sets of its pairs, few of them if they are long
        both = pairs = pairs.select("a", "b")
        for side in ("b", "a"):
            these = sets
            if hashes[side] <= SMALL:
                these = F.broadcast(packed(sets.join(pairs.select(F.col(side).alias("node")).distinct(), "node", "left_semi"), hashes[side], HASHES))
            both = both.join(these.selectExpr(f"node AS {side}", f"n AS n{side}", f"list AS l{side}"), side)
        both = both.withColumn("both", F.size(F.array_intersect("la", "lb")))
        return cut(packed(both.where(f"100 * both >= {percent} * (na + nb - both)").selectExpr("least(a, b) AS u", "greatest(a, b) AS v"), most, PAIRS))

    edges, tree, most = None, None, 0
    for k in range(STARS + 1):
        if k:
            roots = members.join(sorted_side(tree.withColumnRenamed("root", "_root")), "node", "left").withColumn("root", F.coalesce("_root", "node")).drop("_root")
            roots = packed(roots, rows)
            mixed = roots.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi")
            members = cut(packed(roots.join(sorted_side(mixed.select("key")), "key", "left_semi"), rows))
            rows = members.count()
            if not rows:
                break
        if k < STARS:
            centre = members.groupBy("key").agg(F.max(F.struct("degree", "node", "n", "root")).alias("c"))
            with_centre = members.join(sorted_side(centre), "key")
            pairs, n = with_centre.where("c.root <> root").selectExpr("c.node AS a", "c.n AS m", "node AS b", "n"), rows
            members = packed(with_centre.where("c.node <> node").select(members.columns), rows)
        else:
            rest = cut(packed(members.select("node", "root").distinct().join(sorted_side(sets), "node"), hashes, HASHES))
            pairs, n = _prefix_pairs(rest, percent), None
        found = linked(pairs, n)
        edges = found if edges is None else edges.union(found)
        most += found.count()
        tree = cut(packed(components(edges, most), 2 * most))
    member = tree.join(classes, "node").select("node", "root", "rep")
    least = member.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = member.join(least, "root").select("node", "root", "component_id")
    component = classes.join(named, "node", "left").select("node", "rows", F.coalesce("root", "node").alias("component"), F.coalesce("component_id", "rep").alias("component_id"))
    component = cut(packed(component, total))
    return join_hot(prints.select("doc_id", "text_hash", "node"), component, "node", "rows", total).select("doc_id", "text_hash", "component", "component_id")
