"""Ranked search against every document scored by the formula."""

import math
import random
import re
from collections import Counter

import pytest

from corpusloom.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split(text):
    return TERM.findall((text or "").translate(LOWER))


def plain(docs, items, best=20):
    counted = [(i, Counter(split(t))) for i, t in docs]
    counted = [(i, c, c.total()) for i, c in counted if c]
    n, total = len(counted), sum(x for _, _, x in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    found = []
    for item, text in items:
        own = Counter(split(text))
        rows = []
        for i, c, size in counted:
            m = 75 + (25 * size * n) // total
            score = sum(k * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 12 * m)) for t, k in own.items() if t in c)
            rows += [(-score, i is not None, i or 0, i)] if score > 0 else []
        found += [(item, rank, r[3], -r[0]) for rank, r in enumerate(sorted(rows)[:best], 1)]
    return sorted(found, key=repr)


def searched(docs, items, **options):
    return sorted((tuple(r) for r in lexical.search(docs, items, **options).select("item_id", "rank", "doc_id", "score").collect()), key=repr)


def test_terms():
    text = "AbC-Été_x9 ÀB\x00İ漢字​ \x7f{}~ 日本"
    assert lexical.terms(text.encode()) == Counter(w.encode() for w in split(text)) and lexical.terms(b"") == Counter()
    long = "ab cd " * 500_000 + "x" * 3_000_000 + " end"
    assert lexical.terms(long.encode()) == Counter(w.encode() for w in split(long))


@pytest.mark.parametrize("options", [{}, {"block": 400}, {"best": 3}])
def test_random_texts(spark, monkeypatch, options):
    """Rare and frequent words, a third of the rows one text, ties, nulls, words of no document."""
    monkeypatch.setattr(lexical, "LONGEST", 10)
    rng = random.Random(5)
    words = [f"w{k}" for k in range(300)]
    text = lambda n: " ".join(words[min(int(rng.paretovariate(0.6)), 300) - 1] for _ in range(n))
    docs = [(k, text(rng.randint(1, 120))) for k in range(400)] + [(1000 + k, "w5 w250 w251 w1") for k in range(200)]
    docs += [(None, "w7 w8 w250"), (None, None), (5000, None), (5001, ""), (5002, "?!"), (5003, "w9"), (5003, "w9")]
    items = [(k, text(rng.randint(1, 40))) for k in range(25)] + [(90, None), (91, ""), (92, "zzz unseen"), (93, "w5 W5 w5 w250"), (93, "w5 W5 w5 w250"), (None, "w299 w1 w7")]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    assert searched(frame, spark.createDataFrame(items, "item_id long, text string"), **options) == plain(docs, items, options.get("best", 20))


def test_bounds_never_lose_a_row():
    """Whatever is to be beaten, the rows that reach it are candidates."""
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(1)
    rows = [np.unique(rng.integers(0, 50, rng.integers(1, 20))) for _ in range(300)]
    values = [rng.integers(1, 999_999, len(r)) for r in rows]
    norm = [math.sqrt(float((v.astype(float) ** 2).sum())) for v in values]
    batch = pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.int64())), pa.array(norm)], ["terms", "impacts", "norm"])
    bucket, pruned = lexical.Bucket(batch), 0
    for _ in range(40):
        at = rng.choice(50, rng.integers(1, 15), replace=False)
        value = np.sort(rng.integers(0, 9000, len(at)))[::-1].copy()
        rest = np.sqrt(np.r_[np.cumsum((value.astype(float) ** 2)[::-1])[::-1], 0.0])
        weights = np.zeros(50, np.int64)
        weights[at] = value
        exact = bucket.scores(np.arange(300), weights)
        assert exact.tolist() == [int((weights[r] * v).sum()) for r, v in zip(rows, values)]
        for least in (1, *np.quantile(exact, [0.5, 0.9, 0.99]).astype(int).tolist(), int(exact.max()) + 1):
            found = bucket.candidates(at, value, rest, max(1, least))
            assert set(np.flatnonzero(exact >= max(1, least)).tolist()) <= set(found.tolist())
            pruned += 300 - len(found)
    assert pruned > 20_000


def test_edges(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "a " * 400_000)], "doc_id long, text string")
    items = spark.createDataFrame([(7, "a b c")], "item_id long, text string")
    rows = [(1, "a b"), (2, "a " * 400_000)]
    assert searched(docs, items) == plain(rows, [(7, "a b c")])
    assert searched(docs.where("false"), items) == [] and searched(docs, items.where("false")) == []
    clash = docs.selectExpr("*", "text AS terms", "doc_id AS n", "1 AS norm", "text AS impacts")
    assert searched(clash, items.selectExpr("*", "1 AS _no", "text AS title")) == plain(rows, [(7, "a b c")])
    named = lexical.search(docs.selectExpr("CAST(doc_id AS STRING) AS doc_id", "text"), items.selectExpr("CAST(item_id AS STRING) AS item_id", "text"))
    assert {(r.item_id, r.doc_id) for r in named.collect()} == {("7", "1"), ("7", "2")}
