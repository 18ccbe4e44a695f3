"""Held-out quality of the trained models, and the parts they are made of."""

import random

import numpy as np

from corpusloom.llm import langid, toxicity

MIDDLE = "/root/testdata/sf0.01"


def brute_segments(scores):
    """All maximal segments by the definition: peel off the best one, then go left and right."""
    out = []

    def go(lo, hi):
        best, where = 0.0, None
        for a in range(lo, hi):
            total = 0.0
            for b in range(a, hi):
                total += scores[b]
                if total > best + 1e-9:
                    best, where = total, (a, b + 1)
        if where:
            out.append((*where, best))
            go(lo, where[0])
            go(where[1], hi)

    go(0, len(scores))
    return sorted(out)


def test_segments_are_all_maximal():
    rng = random.Random(2)
    for _ in range(400):
        n = rng.randint(0, 25)
        places = sorted(rng.sample(range(n), rng.randint(0, n)))
        given = [(p, rng.uniform(-2, 3)) for p in places]
        dense = [-0.13] * n
        for p, s in given:
            dense[p] += s
        got = toxicity.segments(given, 0.13)
        want = brute_segments(dense)
        assert len(got) == len(want)
        for a, b in zip(sorted(got), want):
            assert a[:2] == b[:2] and abs(a[2] - b[2]) < 1e-6


def test_toxicity(spark):
    docs, labels = (spark.read.parquet(f"{MIDDLE}/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.judged_documents(docs, labels).join(labels, "doc_id").where("held_out").toPandas()
    hit = ((got.predicted == 1) & (got.toxic == 1)).sum()
    assert got.score.between(0, 1).all() and hit >= 0.5 * got.toxic.sum() and hit >= 0.75 * got.predicted.sum()


def test_no_labels(spark, docs, labels):
    got = toxicity.judged_documents(docs, labels.where("toxic = 0")).collect()
    assert {r.predicted for r in got} == {0}


def test_languages(spark):
    docs = spark.read.parquet(f"{MIDDLE}/documents.parquet")
    got = langid.identified_documents(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (got.lang == got.lang_pred).mean() > 0.97 and got.score.between(0, 1).all()


def test_machines_separate():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(m, 0.3, (40, 3)) for m in (-1, 0, 1)])
    y = np.repeat(["a", "b", "c"], 40)
    m = langid.Machines(["a", "b", "c"], np.hstack([x, np.ones((120, 1))]), y)
    assert np.mean([m.classes[m.chances(np.append(v, 1.0)).argmax()] == w for v, w in zip(x, y)]) > 0.9
