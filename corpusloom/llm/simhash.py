"""SimHash near-duplicates with pigeonring filtering.

A 64-bit fingerprint is cut into M segments on a ring. If two fingerprints differ in at most TAU bits,
some segment starts a chain in which every prefix of l segments differs in at most floor(l * TAU / M)
bits (the pigeonring principle). With five segments and two bits those budgets are 0, 0, 1, 1, 2: two
consecutive segments are equal, which is the key of the index, and the longer prefixes prune the
candidates before the full Hamming check.

Buckets of up to BUCKET distinct fingerprints are paired off. Fuller ones would give pairs with the
square of their size, so their keys grow along the ring: the third segment has one error at most, so of its
four parts three are equal, which makes four longer keys; of what is still full, the third and fourth
segments have one error together, and seven of their eight parts are equal. Only buckets that stay full
after that, thousands of fingerprints within a few bits of each other, list every fingerprint's neighbours
at one bit, of which two fingerprints within two bits share one. No link is lost on the way.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from . import shingles
from .common import cut, if_small, join_hot, packed, small_batches, sorted_side
from .components import components

WIDTHS = (13, 13, 13, 13, 12)
TAU = 2
BUCKET = 16
PARTS = (4, 8)  # of the segments that have one error together, all parts but one are equal
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_BLOCK = 1 << 18


def fingerprint(data: bytes, shingle: int = 3, seed: int = 42) -> int:
    """Unsigned SimHash of the words of ``data``; 0 without a word."""
    words = data.translate(_LOWER).split()
    if not words:
        return 0
    if len(words) < shingle:
        grams: Iterator[tuple] = iter([words])
        n = 1
    else:
        grams, n = zip(*(words[i:] for i in range(shingle))), len(words) - shingle + 1
    digest, join, total = xxhash.xxh64_intdigest, b" ".join, np.zeros(64, np.int64)
    for first in range(0, n, _BLOCK):
        size = min(_BLOCK, n - first)
        h = np.fromiter((digest(join(g), seed) for g, _ in zip(grams, range(size))), "<u8", size)
        total += np.unpackbits(h.view(np.uint8).reshape(size, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint's 64 bits as a signed long. A null text has no words."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            fp = np.array([fingerprint(t or b"", shingle, seed) for t in b["text"]], "u8").view("i8")
            yield pd.DataFrame({"doc_id": b["doc_id"], "fp": fp})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return small_batches(docs).select("doc_id", F.col("text").cast("binary").alias("text")).mapInPandas(run, f"doc_id {kind}, fp long")


def _starts() -> list[tuple[int, int, list[tuple[int, int]]]]:
    """For each start: its offset, the bits of the exact prefix, and (bits, budget) of each longer prefix."""
    out, m = [], len(WIDTHS)
    for i in range(m):
        bits, exact, longer = 0, 0, []
        for l in range(1, m + 1):
            bits += WIDTHS[(i + l - 1) % m]
            budget = l * TAU // m
            if budget == 0:
                exact = bits
            elif bits < 64:
                longer.append((bits, budget))
        out.append((sum(WIDTHS[:i]), exact, longer))
    return out


def _turned(x: str, off: int) -> str:
    return x if off == 0 else f"(shiftrightunsigned({x}, {off}) | shiftleft({x}, {64 - off}))"


def _grown(level: int) -> str:
    """SQL: the longer keys of ``fp`` in ``start``, one for each part that is left out."""
    cases = []
    for i, (off, exact, longer) in enumerate(_starts()):
        span, parts = longer[level][0] - exact, PARTS[level]
        edges = [exact + span * k // parts for k in range(parts + 1)]
        keep = [(1 << edges[-1]) - 1 & ~((1 << hi) - (1 << lo)) for lo, hi in zip(edges, edges[1:])]
        signed = lambda m: m - (1 << 64) if m >> 63 else m
        cases.append(f"WHEN {i} THEN array({', '.join(f'xxhash64({_turned("fp", off)} & {signed(m)}L, {i}, {k}, {level})' for k, m in enumerate(keep))})")
    return f"CASE start {' '.join(cases)} END"


def links(prints: DataFrame, shares: dict[str, int] | None = None) -> DataFrame:
    """Edges (u, v) between distinct fingerprints within TAU bits, enough to connect all that are linked.

    ``prints``: (fp), distinct. Pairs of thin buckets come one by one, those of buckets that stay full as stars.
    ``shares``, if given, gets the number of rows that each kind of key had to hold.
    """
    return _links(prints, shares)[0]


def _links(prints: DataFrame, shares: dict[str, int] | None = None) -> tuple[DataFrame, int]:
    """``links``, and about how many rows they have at most."""
    starts = _starts()
    chain = " ".join(
        f"WHEN {i} THEN " + " AND ".join(f"bit_count({_turned('(a ^ b)', off)} & {(1 << bits) - 1}L) <= {budget}" for bits, budget in longer)
        for i, (off, _, longer) in enumerate(starts)
    )
    near = f"(CASE start {chain} END) AND bit_count(a ^ b) <= {TAU}"
    keys = ", ".join(f"{_turned('fp', off)} & {(1 << exact) - 1}L" for off, exact, _ in starts)
    prints = cut(prints)
    n = prints.count() * len(starts)
    rows = prints.select("fp", F.posexplode(F.expr(f"array({keys})")).alias("start", "bucket"))
    found, most = [], 0
    for level in range(len(PARTS) + 1):
        sizes = rows.groupBy("start", "bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        members = cut(packed(rows.join(sorted_side(sizes), ["start", "bucket"]), n))
        held = members.count()
        if shares is not None:
            shares[f"keys {level}"] = held
        thin = members.where(F.col("n") <= BUCKET).groupBy("start", "bucket").agg(F.collect_list("fp").alias("fps"))
        pairs = F.expr(f"flatten(transform(fps, (a, k) -> transform(filter(slice(fps, k + 2, {BUCKET}), b -> {near}), b -> struct(a AS u, b AS v))))")
        found.append(packed(thin.select(F.explode(pairs).alias("e")).select("e.u", "e.v"), held * BUCKET // 2))
        most += held * BUCKET // 2
        full = cut(packed(members.where(F.col("n") > BUCKET).select("fp", "start").distinct(), held))
        n = full.count()
        if not n:
            break
        if level < len(PARTS):
            rows = full.select("fp", "start", F.explode(F.expr(_grown(level))).alias("bucket"))
            n *= PARTS[level]
        else:
            flips = ", ".join(str(1 << k) + "L" for k in range(63))
            around = full.select("fp").distinct().select("fp", F.explode(F.expr(f"transform(array(0L, {flips}, shiftleft(1L, 63)), m -> fp ^ m)")).alias("near"))
            n *= 65
            if shares is not None:
                shares["neighbours"] = around.count()
            stars = packed(around, n).groupBy("near").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)
            found.append(packed(stars.select(F.array_min("fps").alias("u"), F.explode("fps").alias("v")).where("u <> v"), n))
            most += n
    return packed(functools.reduce(DataFrame.union, found).distinct(), most), most


def _components(fps: DataFrame) -> DataFrame:
    """(fp, root) of every fingerprint that has a link."""
    return components(*_links(fps)).select(F.col("node").alias("fp"), "root")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every document.

    Texts are lower-cased in A-Z, words are runs of non-white-space, shingles are three words; documents
    link when fingerprints differ in at most two bits, and component_id is the smallest doc_id reachable.
    Null and empty texts have fingerprint zero and link like any other; shorter texts have one shingle;
    repeated rows and equal texts share a fingerprint, which is treated once, however many share it; an empty
    table gives no rows; further columns are ignored. A fingerprint bit set in exactly half the shingles is 0.
    A null doc_id never names a component unless it holds no other.
    """
    prints = cut(fingerprints(docs))
    classes = cut(packed(prints.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n")), prints.count()))
    tree = cut(_components(classes.select("fp")))
    member = tree.join(classes, "fp").select("fp", "root", "rep")
    least = member.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = member.join(least, "root").select("fp", "component_id")
    component = cut(classes.join(named, "fp", "left").select("fp", "n", F.coalesce("component_id", "rep").alias("component_id")))
    rows = component.agg(F.sum("n")).first()[0] or 0
    return join_hot(prints, component, "fp", "n", rows).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def similar_documents(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, text_hash, component) of every row: the documents linked at a Jaccard similarity of ``percent`` or
    more over word shingles, whole sets compared; ``component`` is any number.

    Candidates come from the pigeonring links of SimHash fingerprints over the same shingles, and, because pairs
    at 0.8 lie 5 to 10 bits apart, from banded min-hashes as well (``shingles.groups``). Nulls, ties and repeated
    rows are as there.
    """

    def keys(classes: DataFrame) -> DataFrame:
        tree = cut(_components(packed(classes.select("fp").distinct(), classes.count())))
        root = classes.select("node", "n", "fp").join(tree, "fp", "left")
        return root.select("node", "n", F.xxhash64(F.coalesce("root", "fp"), F.lit("simhash")).alias("key"))

    return shingles.groups(docs, shingle, percent, more_keys=keys)


def one_of_each(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` with one document of each group of ``similar_documents``: the row with the smallest
    doc_id, and of several texts with that id the one with the smallest hash; nulls come last. Of rows that repeat id
    and text one stays, the one whose columns have the smallest hash together; ids may be numbers or strings. Columns of any name are kept; an empty table stays empty."""
    kind = docs.schema["doc_id"].dataType
    zero = F.lit("" if isinstance(kind, StringType) else 0).cast(kind)  # stands for a null id, told apart by _null
    own = [F.col("doc_id").isNull().alias("_null"), F.coalesce("doc_id", zero).alias("_id")]
    keys = ["_null", "_id", "_hash"]  # in the order of the choice
    linked = similar_documents(docs, shingle, percent).select(*own, F.col("text_hash").alias("_hash"), "component")
    n = docs.count()
    texts = cut(packed(linked.groupBy("component", *keys).agg(F.count(F.lit(1)).alias("n")), n))
    first = texts.groupBy("component").agg(F.min(F.struct(*keys)).alias("first"))
    rated = texts.join(sorted_side(first), "component").select(*keys, "n", (F.struct(*keys) == F.col("first")).alias("stays"))
    moved = cut(packed(rated.where("NOT stays OR n > 1"), n))  # all other rows stay as they are
    moved = if_small(moved, moved.count())
    rows = docs.select(F.struct(*docs.columns).alias("_row"), F.xxhash64(*docs.columns).alias("_whole"), *own, F.xxhash64("text").alias("_hash"))
    alone = rows.join(moved, keys, "left_anti").select("_row.*")
    repeated = rows.join(moved.where("stays"), keys, "left_semi").groupBy(*keys).agg(F.min_by("_row", "_whole").alias("_row")).select("_row.*")
    return alone.unionByName(repeated)
