"""Ranked lexical search for a table of queries, by norm buckets of impact vectors.

A document's vector holds an integer impact for each term that some query of the block has. Vectors are ordered by
length: ranges of the norm are dealt to tasks, and every batch of a task is a bucket with a longest vector. For a query
with a score to beat, a bucket goes if the product of both lengths is too small (Cauchy-Schwarz). Inside a bucket only
documents that hold one of the query's heaviest coordinates can pass, those whose rest is too short to make up for the
others; the product of what they hold there and the bound of their rest filters them again. Survivors are scored
whole, in 64-bit integers. The score to beat starts from the longest vectors and an even part of the others, and rises
in each task. Bounds are doubles with some room; they only decide what is scored, never a score.

Queries go in blocks of a bounded size, so what a task holds of them doesn't grow with their table.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, shared_dir, small_batches

BEST = 20
BLOCK = 1 << 20  # bytes of query texts searched for at once
LONGEST = 2048  # about so many vectors give the first scores to beat, with one of PART others
PART = 64
PIECE = 1 << 20  # bytes of a text split into terms at once
ROOM = 1 + 1e-9

#: Bytes between terms, and A-Z in lower case. All bytes from 0x80 on, so all further characters, belong to terms.
_BETWEEN = bytes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
_UPPER = bytes(range(0x41, 0x5B))
_TABLE = bytes.maketrans(_BETWEEN + _UPPER, b" " * len(_BETWEEN) + _UPPER.lower())


def terms(data: bytes) -> Counter[bytes]:
    """A text's terms and how often it has each. Long texts are split piece by piece, at the spaces between terms."""
    text, found, at = data.translate(_TABLE), Counter(), 0
    while at < len(text):
        end = len(text) if len(text) - at <= PIECE else text.find(b" ", at + PIECE)
        end = len(text) if end < 0 else end
        found.update(text[at:end].split())
        at = end
    return found


class Queries:
    """A block of queries: their terms as numbers, and once the corpus is counted their weights."""

    def __init__(self, rows: list[tuple]):
        counts = [terms(text or b"") for _, text in rows]
        self.ids = [i for i, _ in rows]
        self.vocabulary = {t: k for k, t in enumerate(sorted(set().union(*counts)))}
        self.counts = [{self.vocabulary[t]: n for t, n in c.items()} for c in counts]

    def weigh(self, documents: int, df: dict[int, int]) -> None:
        """Each query as coordinates, the heaviest first, with the length of what follows each."""
        weight = {t: math.floor(1000 * math.log((2 * documents + 2) / (2 * df.get(t, 0) + 1))) for t in self.vocabulary.values()}
        self.vectors = []
        for c in self.counts:
            own = sorted(((n * weight[t], t) for t, n in c.items()), reverse=True)
            value, at = np.array([w for w, _ in own], np.int64), np.array([t for _, t in own], np.int64)
            rest = np.sqrt(np.r_[np.cumsum((value.astype(float) ** 2)[::-1])[::-1], 0.0])
            self.vectors.append((at, value, rest))


def vectors(docs: DataFrame, queries: Queries) -> DataFrame:
    """(doc_id, n, terms, tf) of every document with a term: n counts all its terms, the arrays those of the queries."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    known = docs.sparkSession.sparkContext.broadcast(queries.vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = known.value
        for b in batches:
            keep, size, found, times = [], [], [], []
            for k, text in enumerate(b.column("text")):
                counts = terms(text.as_py() or b"")
                if counts:
                    mine = words.keys() & counts.keys()
                    keep.append(k)
                    size.append(counts.total())
                    found.append([words[t] for t in mine])
                    times.append([counts[t] for t in mine])
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(keep, pa.int64())), pa.array(size, pa.int64()), pa.array(found, pa.list_(pa.int32())), pa.array(times, pa.list_(pa.int64()))], ["doc_id", "n", "terms", "tf"])

    return small_batches(docs.select("doc_id", F.col("text").cast("binary").alias("text"))).mapInArrow(run, f"doc_id {kind}, n long, terms array<int>, tf array<long>")


def impacts(found: DataFrame, documents: int, length: int) -> DataFrame:
    """(doc_id, terms, impacts, norm) of the vectors that hold a query's term."""
    m = F.expr(f"75 + (25 * n * {documents}L) div {length}L")
    rows = found.where(F.size("terms") > 0).select("doc_id", "terms", "tf", m.alias("m"))
    rows = rows.select("doc_id", "terms", F.expr("transform(tf, x -> (1000000000L * x) div (1000 * x + 12 * m))").alias("impacts"))
    return rows.withColumn("norm", F.sqrt(F.aggregate("impacts", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))))


class Bucket:
    """A batch of vectors, by row and by coordinate."""

    def __init__(self, b: pa.RecordBatch):
        lists = b.column("terms")
        size = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        self.first = np.cumsum(size) - size
        self.size = size
        self.terms = lists.flatten().to_numpy(zero_copy_only=False)
        self.impacts = b.column("impacts").flatten().to_numpy(zero_copy_only=False)
        self.norm = b.column("norm").to_numpy(zero_copy_only=False)
        self.longest = float(self.norm.max())
        order = np.argsort(self.terms, kind="stable")
        self.rows = np.repeat(np.arange(len(size)), size)[order]
        self.values = self.impacts[order]
        names, at = np.unique(self.terms[order], return_index=True)
        self.places = dict(zip(names.tolist(), zip(at.tolist(), np.r_[at[1:], len(order)].tolist())))

    def candidates(self, at: np.ndarray, value: np.ndarray, rest: np.ndarray, least: int) -> np.ndarray:
        """The rows that may reach ``least``."""
        if rest[0] * self.longest * ROOM < least:
            return np.zeros(0, np.int64)
        # Behind the first so many coordinates even the longest vector can't reach it alone.
        heavy = int(np.argmax(rest * self.longest * ROOM < least)) if rest[-1] * self.longest * ROOM < least else len(at)
        partial, square = np.zeros(len(self.norm)), np.zeros(len(self.norm))
        for t, w in zip(at[:heavy].tolist(), value[:heavy].tolist()):
            if t in self.places:
                a, z = self.places[t]
                rows, x = self.rows[a:z], self.values[a:z].astype(float)
                partial[rows] += w * x
                square[rows] += x * x
        seen = np.flatnonzero(square)
        tail = np.sqrt(np.maximum(self.norm[seen] ** 2 * ROOM - square[seen], 0.0))
        return seen[(partial[seen] + rest[heavy] * tail) * ROOM >= least]

    def scores(self, rows: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """The exact scores of these rows; ``weights`` has a place for each term."""
        size = self.size[rows]
        ends = np.cumsum(size)
        flat = np.repeat(self.first[rows] - ends + size, size) + np.arange(int(ends[-1]))
        return np.add.reduceat(weights[self.terms[flat]] * self.impacts[flat], ends - size)


def _matches(found: DataFrame, queries, least: dict[int, int], best: int, item_kind: str, id_kind: str) -> DataFrame:
    """(no, item_id, doc_id, score): of each partition the best rows of each query that reach its ``least``."""
    schema = f"no int, item_id {item_kind}, doc_id {id_kind}, score long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, to_beat = queries.value, dict(least)
        held: dict[int, list] = {}
        weights = np.zeros(len(block.vocabulary), np.int64)
        kinds = None
        for b in batches:
            if not b.num_rows:
                continue
            kinds = b.schema.field("doc_id").type
            bucket, ids = Bucket(b), b.column("doc_id")
            for no, (at, value, rest) in enumerate(block.vectors):
                if not len(at):
                    continue
                theta = to_beat.get(no, 1)
                rows = bucket.candidates(at, value, rest, theta)
                if not len(rows):
                    continue
                weights[at] = value
                scores = bucket.scores(rows, weights)
                weights[at] = 0
                good = scores >= theta
                if good.any():
                    mine = held.setdefault(no, [])
                    mine += [(-s, i is not None, i) for s, i in zip(scores[good].tolist(), (ids[k].as_py() for k in rows[good].tolist()))]
                    mine.sort(key=lambda x: (x[0], x[1], x[2]) if x[1] else (x[0], False))
                    del mine[best:]
                    if len(mine) == best:
                        to_beat[no] = max(theta, -mine[-1][0])
        if held:
            rows = [(no, block.ids[no], i, -s) for no, mine in held.items() for s, _, i in mine]
            no, item, doc, score = zip(*rows)
            item_type = pa.int64() if item_kind in ("bigint", "int") else None
            yield pa.RecordBatch.from_arrays([pa.array(no, pa.int32()), pa.array(item, item_type), pa.array(doc, kinds), pa.array(score, pa.int64())], ["no", "item_id", "doc_id", "score"])

    return small_batches(found).mapInArrow(run, schema)


def _ranked(rows: DataFrame, best: int) -> DataFrame:
    place = Window.partitionBy("no").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
    return rows.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= best)


def _block(docs: DataFrame, rows: list[tuple], best: int, item_kind: str) -> DataFrame:
    spark, id_kind = docs.sparkSession, docs.schema["doc_id"].dataType.simpleString()
    block = Queries(rows)
    folder = f"{shared_dir(spark)}/vectors-{uuid.uuid4().hex}"
    vectors(docs, block).write.parquet(f"{folder}/counts")
    counts = spark.read.parquet(f"{folder}/counts")
    documents, length = counts.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = counts.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("n"))  # at most the block's terms
    block.weigh(documents, {r.t: r.n for r in df.collect()})
    told = spark.sparkContext.broadcast(block)
    # Rows equal in norm and id may be many; a number of each keeps ranges even.
    made = impacts(counts, documents, max(length, 1)).withColumn("_row", F.monotonically_increasing_id())
    made.repartitionByRange(F.desc("norm"), F.xxhash64("_row")).sortWithinPartitions(F.desc("norm")).drop("_row").write.parquet(f"{folder}/impacts")
    ordered = spark.read.parquet(f"{folder}/impacts")
    size = ordered.count()
    edge = ordered.agg(F.percentile_approx("norm", 1 - LONGEST / size, 10_000)).first()[0] if size > LONGEST else 0.0
    longest = ordered.where(F.col("norm") >= edge)
    even = ordered.where(F.pmod(F.xxhash64("doc_id", "norm"), F.lit(PART)) == 0)
    # A row may be in both, and would count twice.
    first = [_ranked(_matches(part, told, {}, best, item_kind, id_kind), best).groupBy("no").agg(F.min("score").alias("score"), F.count(F.lit(1)).alias("n")).where(F.col("n") == best) for part in (longest, even)]
    least: dict[int, int] = {}
    for r in first[0].unionByName(first[1]).collect():  # two numbers a query
        least[r.no] = max(r.score, least.get(r.no, 1))
    return _ranked(_matches(ordered, told, least, best, item_kind, id_kind), best).select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, best: int = BEST, block: int = BLOCK) -> DataFrame:
    """(item_id, rank, doc_id, score): for every row of ``items`` (item_id, text) the ``best`` rows of ``docs`` (doc_id,
    text) by score, above 0, then by ascending doc_id, null first.

    A null or empty text has no terms: such a document isn't found or counted, such an item finds nothing. Repeated rows of
    ``docs`` are found each, those of ``items`` get a list each. Empty tables give no rows; other columns are ignored;
    texts of any length are read whole. Items go in blocks of about ``block`` bytes, dealt by a hash of their number.
    """
    kind = items.schema["item_id"].dataType.simpleString()
    rows = cut(items.select("item_id", F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text")).withColumn("_no", F.monotonically_increasing_id()))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text") + 16), F.lit(0))).first()[0]
    blocks = max(1, -(-size // block))
    found = None
    for k in range(blocks):
        own = [(r.item_id, bytes(r.text)) for r in rows.where(F.pmod(F.xxhash64("_no"), F.lit(blocks)) == k).orderBy("_no").collect()]
        part = _block(docs, own, best, kind)
        found = part if found is None else found.unionByName(part)
    return found


ORACLE = r"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents),
c AS (SELECT r, doc_id, len(t) AS n FROM d WHERE len(t) > 0), s AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS total FROM c),
f AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(t) AS term FROM d) x GROUP BY r, term), df AS (SELECT term, count(*) AS df FROM f GROUP BY term),
q AS (SELECT k, item_id, term, count(*) AS times FROM (SELECT row_number() OVER () AS k, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) x GROUP BY k, item_id, term),
w AS (SELECT k, item_id, q.term, times * CAST(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) AS BIGINT) AS w FROM q JOIN df ON df.term = q.term, s),
m AS (SELECT r, doc_id, 75 + (25 * n * docs) // total AS m FROM c, s),
g AS (SELECT k, item_id, doc_id, m.r, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score FROM w JOIN f ON f.term = w.term JOIN m ON m.r = f.r GROUP BY k, item_id, doc_id, m.r)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY score DESC, doc_id NULLS FIRST) AS rank FROM g WHERE score > 0) x WHERE rank <= 20"""
