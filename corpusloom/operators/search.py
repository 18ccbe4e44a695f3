"""Ranked keyword search and prefix lookup."""

from __future__ import annotations

import re
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import written
from .ordered import by_value, running_sum

EXACT, PREFIX, INSIDE = 5, 2, 1
BLOCK_PAIRS = 20_000  # query words of a block
KNOWN_TOKENS = 200_000  # tokens whose words a task remembers
CELLS = 1 << 20  # what is scored at a time
STEP = 1 << 14


def query_tokens(query: str) -> list[str]:
    """Distinct word tokens of a query, lower-cased, longer than two."""
    return sorted({t for t in re.findall(r"\w+", query.lower()) if len(t) > 2})


def token_weight(token: Column, wanted: list[str]) -> Column:
    """What an index token adds for all query tokens together: exact 5, prefix 2, inside 1."""
    total = F.lit(0)
    for q in wanted:
        total = total + F.when(token == q, EXACT).when(F.startswith(token, F.lit(q)), PREFIX).when(F.contains(token, F.lit(q)), INSIDE).otherwise(0)
    return total.cast("long")


def scores(table: DataFrame, tokens: str, query: str) -> DataFrame:
    """Rows of ``table`` that match, with ``score``. The query is a handful of literals, so a row is scored from
    its own token array: no join, no shuffle. ``tokens`` may repeat tokens; they count once."""
    wanted = query_tokens(query)
    own = F.filter(F.array_distinct(tokens), lambda t: F.length(t) > 2)
    total = F.aggregate(own, F.lit(0).cast("long"), lambda s, t: s + token_weight(t, wanted)) if wanted else F.lit(0).cast("long")
    return table.withColumn("score", total).where("score > 0")


def search(table: DataFrame, tokens: str, query: str, key: str = "element_id", where: Column | None = None, max_results: int = 100) -> DataFrame:
    """The best rows by score, then key. ``where`` is tested after scoring and before the limit."""
    if max_results < 0:
        raise ValueError("max_results must not be negative")
    found = scores(table, tokens, query)
    if where is not None:
        found = found.where(where)
    return found.orderBy(F.desc("score"), key).limit(max_results)


def search_postings(postings: DataFrame, query: str, max_results: int = 100) -> DataFrame:
    """(element_id, score) from a table of postings: weights first, then one aggregation."""
    wanted = query_tokens(query)
    if max_results < 0:
        raise ValueError("max_results must not be negative")
    weighed = postings.distinct().where(F.length("token") > 2).withColumn("_w", token_weight(F.col("token"), wanted)).where("_w > 0")
    return weighed.groupBy("element_id").agg(F.sum("_w").alias("score")).orderBy(F.desc("score"), "element_id").limit(max_results)


def query_words(queries: DataFrame, key: str, text: str) -> DataFrame:
    """(key, word): the distinct word tokens of each query, lower-cased, longer than two; ``query_tokens`` for a table."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    return queries.select(key, F.explode(F.array_distinct(F.filter(words, lambda w: F.length(w) > 2))).alias("word"))


def _containments(words: dict[str, int], lengths: list[int], token: str) -> list[tuple[int, int]]:
    """(word, weight) of each of ``words`` that the token holds: its pieces of their lengths are looked up."""
    held = {i for n in lengths for at in range(len(token) - n + 1) if (i := words.get(token[at : at + n])) is not None}
    exact, start = words.get(token), {words.get(token[:n]) for n in lengths}
    return [(i, EXACT if i == exact else PREFIX if i in start else INSIDE) for i in held]


class _Block:
    """A block of queries and the best rows so far for each, of rows that come by ascending id."""

    def __init__(self, queries: pd.DataFrame, max_results: int):
        found = Counter(zip(queries["query"], queries["word"]))
        self.queries, self.most = sorted({q for q, _ in found}), max_results
        at, self.words = {q: k for k, q in enumerate(self.queries)}, {}
        has: list[list[int]] = []
        for q, w in found:
            if w not in self.words:
                self.words[w] = len(has)
                has.append([])
            has[self.words[w]].append(at[q])
        self.lengths = sorted({len(w) for w in self.words})
        self.count = np.array([len(x) for x in has], dtype=np.int64)  # queries of each word, one after another
        self.first, self.own = np.cumsum(self.count) - self.count, np.array([q for x in has for q in x], dtype=np.int64)
        self.table = None  # words by queries, unless that is too large
        if len(has) * len(self.queries) <= 4 * CELLS:
            self.table = np.zeros((len(has), len(self.queries)))
            self.table[np.repeat(np.arange(len(has)), self.count), self.own] = 1
        self.seen: dict[str, array] = {}
        self.least = np.zeros(len(self.queries))
        self.best = [(np.empty(0, np.int64), np.empty(0), np.empty(0, object))]
        self.held = 0

    def weights(self, token: str) -> array:
        """8 * word + weight of each word that the token holds."""
        known = array("q", (8 * w + x for w, x in _containments(self.words, self.lengths, token)))
        if len(token) <= 64:
            if len(self.seen) >= KNOWN_TOKENS:
                self.seen.clear()
            self.seen[token] = known
        return known

    def add(self, ids: list, tokens: list[list[str]]) -> None:
        """Score some rows and keep what can be among the best. A later row of an equal score comes after them."""
        held, ends, since, wide = array("q"), [], 0, max(len(self.queries), len(self.words) if self.table is not None else 0)
        for k, own in enumerate(tokens):
            for t in own:
                known = self.seen.get(t)
                held += self.weights(t) if known is None else known
            ends.append(len(held))
            if k + 1 == len(tokens) or len(held) >= CELLS or len(ends) * wide >= CELLS:
                both = np.array(held, np.int64)
                row = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
                self._score(ids[since : k + 1], row, both >> 3, (both & 7).astype(np.float64))
                held, ends, since = array("q"), [], k + 1

    def _score(self, ids: list, row: np.ndarray, word: np.ndarray, weight: np.ndarray) -> None:
        if not len(row):
            return
        # A row's weight of each word first, then what its queries sum up; whole numbers below 2 ** 53.
        cell = row * len(self.words) + word
        if self.table is not None:
            scores = np.bincount(cell, weight, len(ids) * len(self.words)).reshape(len(ids), -1) @ self.table
        else:
            scores = self._spread(*np.unique(cell, return_inverse=True), weight, len(ids))
        r, q = np.nonzero(scores > self.least)
        if len(r):
            self.best.append((q, scores[r, q], np.array(ids + [None], object)[r]))
            self.held += len(r)
            if self.held > 4 * self.most * len(self.queries) + CELLS // 8:
                self._prune()

    def _spread(self, cell: np.ndarray, at: np.ndarray, weight: np.ndarray, rows: int) -> np.ndarray:
        """The scores by the queries of each word, a step at a time."""
        weight = np.bincount(at, weight)
        row, word, total = cell // len(self.words), cell % len(self.words), np.zeros(rows * len(self.queries))
        for a in range(0, len(cell), STEP):
            r, w, x = row[a : a + STEP], word[a : a + STEP], weight[a : a + STEP]
            n = self.count[w]
            query = self.own[np.repeat(self.first[w] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
            total += np.bincount(np.repeat(r, n) * len(self.queries) + query, np.repeat(x, n), len(total))
        return total.reshape(rows, -1)

    def _prune(self) -> None:
        q, s, i = (np.concatenate(x) for x in zip(*self.best))
        order = np.lexsort((-s, q))  # stable: equal scores stay by ascending id
        q, s, i = q[order], s[order], i[order]
        start = np.searchsorted(q, q)
        kept = np.arange(len(q)) - start < self.most
        last = np.arange(len(q)) - start == self.most - 1
        self.least[q[last]] = s[last]
        self.best, self.held = [(q[kept], s[kept], i[kept])], int(kept.sum())

    def rows(self) -> Iterator[tuple[str, object, int]]:
        self._prune()
        q, s, i = self.best[0]
        yield from ((self.queries[a], c, int(b)) for a, b, c in zip(q.tolist(), s.tolist(), i.tolist()))


def search_tables(rows: DataFrame, queries: DataFrame, key: str, text: str, max_results: int = 100) -> DataFrame:
    """(key, element_id, score, rank): for each query (key, distinct; text) the best of ``rows`` (element_id, tokens), equal
    ids taken together. A row meets each block of queries once: its tokens are looked up in the block's words, and
    scores are summed in the task, which holds the best of each query, so that no row is made for a pair of a query and a row.

    Blocks and rows are dealt to parts and come to a task in order: of each part block after block, the queries of a
    block before the rows. Whatever the number of queries, a task holds one block of about BLOCK_PAIRS query words."""
    if max_results < 0:
        raise ValueError("max_results must not be negative")
    spark = rows.sparkSession
    parts = 4 * spark.sparkContext.defaultParallelism
    own = F.filter(F.array_distinct("tokens"), lambda t: F.length(t) > 2)
    each = rows.select("element_id", own.alias("tokens")).where(F.size("tokens") > 0)
    each = each.groupBy("element_id").agg(F.array_distinct(F.flatten(F.collect_list("tokens"))).alias("tokens"))
    # Keys travel as JSON, since pandas has no whole numbers beside nulls.
    packed = lambda c: F.to_json(F.struct(F.col(c).alias("k")))
    unpacked = lambda c, df, of: F.from_json(c, f"k {dict(df.dtypes)[of]}")["k"]
    wanted = written(query_words(queries, key, text).select(packed(key).alias("query"), "word").distinct(), "words")
    blocks = max(1, -(-wanted.count() // BLOCK_PAIRS))
    block = F.pmod(F.xxhash64("query"), F.lit(blocks)).cast("int")
    none = lambda t: F.lit(None).cast(t)
    asked = wanted.select(F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), block.alias("block"), none(dict(rows.dtypes)["element_id"]).alias("element_id"), none("array<string>").alias("tokens"), "query", "word")
    told = each.select(
        F.pmod(F.xxhash64("element_id"), F.lit(parts)).cast("int").alias("part"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "element_id", "tokens", none("string").alias("query"), none("string").alias("word")
    )
    dealt = asked.unionByName(told).repartition(parts, "part").sortWithinPartitions("part", "block", F.col("query").isNull(), "element_id").select("part", "block", packed("element_id").alias("id"), "tokens", "query", "word")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, held, asked_, names = None, None, [], ["query", "id", "score"]
        for b in batches:
            for at, g in b.groupby(["part", "block"], sort=False):
                if at != now:
                    if held is not None:
                        yield pd.DataFrame(list(held.rows()), columns=names).astype({"score": "int64"})
                    now, held, asked_ = at, None, []
                q = g[g["query"].notna()]
                if len(q):
                    asked_.append(q[["query", "word"]])
                r = g[g["query"].isna()]
                if len(r) and asked_:
                    if held is None:
                        held = _Block(pd.concat(asked_), max_results)
                    held.add(r["id"].tolist(), r["tokens"].tolist())
        if held is not None:
            yield pd.DataFrame(list(held.rows()), columns=names).astype({"score": "int64"})

    scored = dealt.mapInPandas(run, "query string, id string, score long").select("query", unpacked("id", rows, "element_id").alias("element_id"), "score")
    best = Window.partitionBy("query").orderBy(F.desc("score"), "element_id")
    found = scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= max_results)
    return found.select(unpacked("query", queries, key).alias(key), "element_id", "score", "rank")


def search_many(postings: DataFrame, queries: DataFrame, key: str, text: str, max_results: int = 100) -> DataFrame:
    """(key, element_id, score, rank): for each query (key, distinct; text) what ``search_postings`` finds for it. Where the
    rows' own token arrays are at hand, ``search_tables`` needs no postings."""
    return search_tables(postings.select("element_id", F.array("token").alias("tokens")), queries, key, text, max_results)


def prefix(elements: DataFrame, start: str, max_results: int | None = None) -> DataFrame:
    """Distinct (name, element_id) whose name starts so, in that order; a limit is strict."""
    found = elements.where(F.col("name").startswith(start)).select("name", "element_id").distinct()
    return found if max_results is None else found.orderBy("name", "element_id").limit(max_results)


def prefix_many(elements: DataFrame, starts: DataFrame, start: str = "prefix") -> DataFrame:
    """(prefix, name, element_id), distinct, for each distinct prefix of ``starts``. The names with a prefix are a range in
    name order; names lie in ordered buckets, and a prefix meets those that its range touches, one for a long one and all of
    them, side by side, for an empty one. Names with U+10FFFF, which is no character, may be missed."""
    names = elements.where(F.col("name").isNotNull()).select("name", "element_id").distinct()
    bucket = by_value("name", names)
    ends = starts.where(F.col(start).isNotNull()).select(F.col(start).alias("prefix")).distinct()
    first = ends.select("prefix", F.col("prefix").alias("name")).select("prefix", bucket.alias("lo"))
    last = ends.select("prefix", F.concat("prefix", F.lit("\U0010ffff")).alias("name")).select("prefix", bucket.alias("hi"))
    touched = first.join(last, "prefix").select("prefix", F.explode(F.sequence("lo", "hi")).alias("_bucket"))
    return names.withColumn("_bucket", bucket).join(touched, "_bucket").where(F.startswith("name", F.col("prefix"))).select("prefix", "name", "element_id")


def prefix_names(elements: DataFrame, start: str, max_results: int) -> DataFrame:
    """(name, n): the names that a walk in name order visits before it has ``max_results`` ids. Names come
    whole, so the ids may be more. With no more than 0 asked for, only the prefix itself is seen."""
    own = elements.where(F.col("name").startswith(start)).groupBy("name").agg(F.countDistinct("element_id").alias("n"))
    if max_results <= 0:
        return own.where(F.col("name") == start)
    return running_sum(own, by_value("name", own), ["name"], F.col("n"), "_before", through=False).where(F.col("_before") < max_results).select("name", "n")


def prefix_page(elements: DataFrame, start: str, after: str | None, size: int) -> DataFrame:
    """(name, n): the next ``size`` names with the prefix in name order, after a given one; n counts their ids."""
    own = elements.where(F.col("name").startswith(start))
    if after is not None:
        own = own.where(F.col("name") > after)
    return own.groupBy("name").agg(F.countDistinct("element_id").alias("n")).orderBy("name").limit(size)


def prefix_fanout(elements: DataFrame, depth: int = 3) -> DataFrame:
    """(prefix, names): how many distinct names lie below each prefix of up to ``depth`` characters. Names are counted by
    their longest prefix first, so the rows of the shorter ones come from few."""
    cut = elements.select("name").distinct().groupBy(F.substring("name", 1, depth).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    each = cut.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("p")), lambda k: F.substring(F.col("p"), F.lit(1), k))).alias("prefix"), "n")
    return each.groupBy("prefix").agg(F.sum("n").alias("names"))
