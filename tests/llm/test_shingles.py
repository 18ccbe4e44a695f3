"""Documents linked at a Jaccard similarity, against all pairs."""

import itertools
import random

import pytest

import corpus_pipeline as pipeline
from corpusloom.llm import shingles, simhash

SF = "/root/testdata/sf0.01"


def plain(rows, size=5):
    """The component of each row, by comparing all pairs."""
    sets = []
    for _, t in rows:
        w = (t or "").translate({c: c + 32 for c in range(65, 91)}).encode().split()
        sets.append({tuple(w[k : k + size]) for k in range(len(w) - size + 1)} or ({tuple(w)} if w else set()))
    root, pairs = list(range(len(rows))), 0
    for a, b in itertools.combinations(range(len(rows)), 2):
        both, n = len(sets[a] & sets[b]), len(sets[a]) + len(sets[b])
        if 100 * both >= 80 * (n - both):
            pairs += 1
            old, new = max(root[a], root[b]), min(root[a], root[b])
            root = [new if r == old else r for r in root]
    return {rows[k][0]: rows[r][0] for k, r in enumerate(root)}, pairs


def test_stage_against_all_pairs(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want, pairs = plain(sorted((r.doc_id, r.text) for r in docs.collect()))
    assert pairs > 90
    assert {r.doc_id: r.component_id for r in shingles.groups(docs).collect()} == want
    stay = pipeline.drop_near_duplicates(spark, docs, SF)
    assert stay.columns == docs.columns and {r.doc_id for r in stay.collect()} == set(want.values())


@pytest.mark.parametrize("small", [0, shingles.SMALL])
def test_large_groups(spark, monkeypatch, small):
    """Copies around one text and a chain of texts, in buckets of far more than a pair, and unrelated texts; with
    sets shuffled to the pairs, and broadcast."""
    monkeypatch.setattr(shingles, "SMALL", small)
    rng = random.Random(4)
    text = lambda: [f"w{rng.randrange(5000)}" for _ in range(200)]
    made, centre, walk = [], text(), text()
    for _ in range(60):
        near = list(centre)
        for p in rng.sample(range(200), rng.randint(1, 6)):
            near[p] = f"x{rng.random()}"
        made.append(near)
        walk[rng.randrange(200)] = f"y{rng.random()}"
        walk[rng.randrange(200)] = f"y{rng.random()}"
        made += [list(walk), text()]
    rows = [(k, " ".join(w)) for k, w in enumerate(made)]
    got = shingles.groups(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id: r.component_id for r in got.collect()} == plain(rows)[0]


def test_unlinked_copies(spark, monkeypatch):
    """Copies too far from one text and from each other to link, though they meet in its buckets, and copies of these
    at about 0.8: what the stars leave is joined by prefix filtering, and few of its pairs are listed."""
    rng, calls, join = random.Random(9), [], shingles._prefix_pairs
    centre, made = [f"w{k}" for k in range(300)], []
    for _ in range(120):
        far = list(centre)
        for p in rng.sample(range(300), 10):
            far[p] = f"x{rng.random()}"
        made.append(far)
        near = list(far)
        for p in rng.sample(range(300), rng.randint(4, 8)):
            near[p] = f"y{rng.random()}"
        made.append(near)
    rows = [(k, " ".join(w)) for k, w in enumerate(made)]

    def counted(rest, percent):
        pairs = join(rest, percent)
        calls.append((rest.count(), pairs.distinct().count()))
        return pairs

    monkeypatch.setattr(shingles, "_prefix_pairs", counted)
    got = shingles.groups(spark.createDataFrame(rows, "doc_id long, text string"))
    want, pairs = plain(rows)
    assert {r.doc_id: r.component_id for r in got.collect()} == want and 20 < pairs < 120
    assert calls and calls[0][0] > 50 and calls[0][1] < calls[0][0] ** 2 / 20


def test_edges(spark, edge, nothing):
    got = {(r.doc_id, r.component_id) for r in shingles.groups(edge).collect()}
    assert {(1, 1), (2, 1), (3, 3), (4, 3), (5, 3), (None, 3)} <= got
    assert shingles.groups(nothing).count() == 0


def test_rounds_of_components_have_few_tasks(spark, monkeypatch):
    """A round's result lies in as many partitions as its edges need, however many the session's shuffles have."""
    from corpusloom.llm import components as C

    sizes = []
    monkeypatch.setattr(C, "cut", lambda df, cut=C.cut: sizes.append((made := cut(df)).rdd.getNumPartitions()) or made)
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "40")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        edges = spark.range(1, 60).selectExpr("id AS u", "id - 1 AS v").union(spark.createDataFrame([(100, 101), (101, 100), (7, 7)], "u long, v long"))
        assert {tuple(r) for r in C.components(edges).collect()} == {(k, 0) for k in range(60)} | {(100, 100), (101, 100)}
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert len(sizes) > 2 and max(sizes[1:]) <= spark.sparkContext.defaultParallelism


def test_small_groups_have_few_tasks(spark):
    """Links among few documents don't have a task for each of the session's shuffle partitions in every stage, and only
    sets and ids that are meant to be broadcast are."""
    words = [f"w{k}" for k in range(60)]
    rows = [(k, " ".join([*words[k % 7 :], f"x{k // 2}"])) for k in range(40)]
    docs, old = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "60")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        spark.sparkContext.setJobGroup("few", "")
        got = simhash.similar_documents(docs)
        spark.sparkContext.setJobGroup("read", "")
        component = {r.doc_id: r.component for r in got.collect()}
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        for k, v in old.items():
            spark.conf.set(k, v)
    want = plain(rows)[0]
    assert all((component[a] == component[b]) == (want[a] == want[b]) for a in want for b in want)
    status = spark.sparkContext.statusTracker()
    stages = {s for j in status.getJobIdsForGroup("few") for s in status.getJobInfo(j).stageIds}
    tasks = sum(info.numCompletedTasks for s in stages if (info := status.getStageInfo(s)))
    assert stages and tasks < 12 * len(stages)
