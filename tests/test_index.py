import random
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.operators import index, search, store
from corpusloom.streaming.ingest import ingest

SCHEMA = "seq long, element_id string, name string, element_type string, file_path string, module_path string, parent_id string"


def made(spark, rows):
    return spark.createDataFrame([(k, i, n, t, "f", "m", p) for k, (i, n, t, p) in enumerate(rows)], SCHEMA)


def test_duplicates(spark):
    e = made(spark, [("a.f", "f", "FUNCTION", None)] * 3 + [("b.f", "f", "METHOD", "b.C")])
    assert {r.element_id: r.seq for r in index.first_wins(e).collect()} == {"a.f": 0, "b.f": 3}
    assert {r.element_id: r.seq for r in index.second_wins(e).collect()} == {"a.f": 1, "b.f": 3}
    assert index.stats(e).first().total_elements == 2
    assert index.get_by_name(e, "f", "FUNCTION").count() == 0
    assert index.get_by_name(e, "f", "METHOD").first().element_id == "b.f"
    assert index.get_by_name(e, "f", "IMPORT").count() == 0
    assert index.children(e, "b.C").count() == 1 and index.children(e, "none").count() == 0


def test_search_golden(spark):
    rows = [("m.parse_file", ["parse_file", "parse", "file."]), ("m.parser", ["parser", "safe", "m"]), ("m.reparse", ["reparse", "reparse"])]
    df = spark.createDataFrame(rows, "element_id string, search_tokens array<string>")
    found = lambda q: [(r.element_id, r.score) for r in search.search(df, "search_tokens", q).collect()]
    assert found("parse") == found("PARSE parse") == [("m.parse_file", 7), ("m.parser", 2), ("m.reparse", 1)]
    assert found("file") == [("m.parse_file", 3)] and found("a m") == [] and found("parse_file") == [("m.parse_file", 5)]
    assert [tuple(r) for r in search.search_postings(index.postings(df), "parse").collect()] == found("parse")
    with pytest.raises(ValueError):
        search.search(df, "search_tokens", "x", max_results=-1)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.text("abé_1", min_size=1, max_size=5), max_size=6), min_size=1, max_size=8), st.text("abé_1 .", max_size=12))
def test_search_model(spark, tokens, query):
    df = spark.createDataFrame([(f"e{k}", t) for k, t in enumerate(tokens)], "element_id string, search_tokens array<string>")
    wanted = {t for t in re.findall(r"\w+", query.lower()) if len(t) > 2}
    weight = lambda t: sum(5 if t == q else 2 if t.startswith(q) else 1 if q in t else 0 for q in wanted)
    want = {f"e{k}": s for k, t in enumerate(tokens) if (s := sum(weight(x) for x in set(t) if len(x) > 2))}
    assert {r.element_id: r.score for r in search.search(df, "search_tokens", query).collect()} == want


def test_prefix(spark):
    e = made(spark, [("1.bar", "bar", "CLASS", None), ("1.ba", "ba", "CLASS", None), ("1.baz", "baz", "CLASS", None), ("2.baz", "baz", "CLASS", None), ("1.qux", "qux", "CLASS", None)])
    walk = lambda start, n: sorted((r.name, r.n) for r in search.prefix_names(e, start, n).collect())
    assert walk("ba", 100) == walk("ba", 3) == [("ba", 1), ("bar", 1), ("baz", 2)]
    assert walk("ba", 1) == walk("ba", 0) == [("ba", 1)] and walk("BA", 9) == [] and len(walk("", 100)) == 4
    assert search.prefix(e, "", None).count() == 5 and search.prefix(e, "ba", 2).count() == 2
    assert [r.name for r in search.prefix_page(e, "ba", "ba", 5).collect()] == ["bar", "baz"]
    assert {r.prefix: r.names for r in search.prefix_fanout(e, 2).collect()} == {"b": 3, "ba": 3, "q": 1, "qu": 1}


def test_store(spark, tmp_path):
    df = spark.createDataFrame([("a.x", "x", "f.py", ["xxx", "yy"]), ("a.y", "y", "f.py", ["yyy"])], "element_id string, name string, file_path string, search_tokens array<string>")
    store.save(df, str(tmp_path / "i"))
    assert sorted(store.load(spark, str(tmp_path / "i")).collect()) == sorted(df.collect())
    assert store.load(spark, str(tmp_path / "i"), "postings").count() == 2
    assert store.load(spark, str(tmp_path / "i"), "stats").first().total_elements == 2
    plan = index.get_element(store.load(spark, str(tmp_path / "i")).withColumn("seq", __import__("pyspark.sql.functions", fromlist=["lit"]).lit(1)), "a.x")._jdf.queryExecution().toString()
    assert "EqualTo(element_id,a.x)" in plan


def test_stream(spark, tmp_path):
    e = made(spark, [("a.f", "f", "FUNCTION", None), ("a.g", "g", "FUNCTION", None), ("a.f", "f", "METHOD", None)])
    for part in (e.where("seq < 2"), e.where("seq >= 1")):
        part.write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(e.schema).parquet(str(tmp_path / "in"))
        ingest(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted((r.element_id, r.seq) for r in got) == [("a.f", 0), ("a.g", 1)]


def test_prefix_names_model(spark):
    """Names of one stem and of many, against a plain walk in name order."""
    rng = random.Random(9)
    names = sorted({"stem_" * 3 + "".join(rng.choices("ab", k=rng.randint(1, 6))) for _ in range(60)} | {"".join(rng.choices("abc", k=3)) for _ in range(20)})
    rows = [(f"{j}.{n}", n, "CLASS", None) for n in names for j in range(rng.randint(1, 3))]
    e = made(spark, rows)
    for start, most in (("stem_", 30), ("", 25), ("a", 3), ("zz", 4)):
        want, total = [], 0
        for n in names:
            if n.startswith(start) and total < most:
                k = sum(r[1] == n for r in rows)
                want.append((n, k))
                total += k
        assert sorted((r.name, r.n) for r in search.prefix_names(e, start, most).collect()) == want


def test_build_index(spark, tmp_path):
    from corpusloom.plans.build import build_index

    for path, code in (("pkg/__init__.py", "class K:\n    def run(self): pass\n"), ("pkg/m.py", "import os\ndef run(): pass\n"), ("bad.py", ")(\n")):
        (tmp_path / path).parent.mkdir(exist_ok=True)
        (tmp_path / path).write_text(code)
    elements, errors = build_index(spark, str(tmp_path))
    got = {r.element_id: r.element_kind for r in elements.collect()}
    assert got["pkg.run"] == "METHOD" and got["pkg.pkg"] == "PACKAGE" and got["m.run"] == "FUNCTION" and got["bad.bad"] == "MODULE"
    assert [r.error_type for r in errors.collect()] == ["MultipleFallbackFailure"]
    held = {r.module_path: r for r in index.modules(elements).collect()}
    assert held["pkg"].is_package and held["pkg"].classes == ["K"] and held["m"].imports == ["os"] and held["m"].functions == ["run"]


def test_search_many_is_the_scan_for_each(spark):
    import random

    rng = random.Random(4)
    made = lambda: "".join(rng.choices("abcé_1", k=rng.randint(1, 7)))
    rows = [(f"e{k}", [made() for _ in range(rng.randint(0, 12))] + ["common"] * 2) for k in range(80)] + [("none", None), ("empty", [])]
    table = spark.createDataFrame(rows, "element_id string, tokens array<string>")
    queries = [(k, " ".join(made() for _ in range(rng.randint(0, 6)))) for k in range(25)] + [(90, None), (91, "ab"), (92, "Common comm MMO zzzz"), (93, "common, common!")]
    got = search.search_many(index.postings(table, "tokens"), spark.createDataFrame(queries, "q long, text string"), "q", "text", 7)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    found = {}
    for r in got.orderBy("q", "rank").collect():
        found.setdefault(r.q, []).append((r.element_id, r.score))
    for q, text in queries:
        want = search.search_postings(index.postings(table, "tokens"), text or "", 7).collect() if q % 5 == 0 or q > 80 else None
        if want is not None:
            assert found.get(q, []) == [(r.element_id, r.score) for r in want], text


def test_search_tables_in_blocks(spark, monkeypatch):
    """Many blocks and parts, ids beyond doubles, ids that come twice, a null id: the same as one search for each query;
    and the rows that leave Python are bounded by queries and parts, not by pairs of a query and a row."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(search, "BLOCK_PAIRS", 3)
    monkeypatch.setattr(search, "CELLS", 7)
    big = 1 << 60
    rows = [(big + k % 150, [f"w{k % 7}", "common", f"xcommon{k % 3}", "é" * (k % 5)]) for k in range(200)] + [(None, ["common"]), (3, None)]
    table = spark.createDataFrame(rows, "element_id long, tokens array<string>")
    queries = [(k, f"common w{k} COMMON ééé") for k in range(9)] + [(50, None)]
    got = search.search_tables(table, spark.createDataFrame(queries, "q long, text string"), "q", "text", 4)
    found = {}
    for r in got.orderBy("q", "rank").collect():
        found.setdefault(r.q, []).append((r.element_id, r.score))
    merged = table.select("element_id", F.explode("tokens").alias("token"))
    for q, text in queries:
        want = search.search_postings(merged, text or "", 4).collect()
        assert found.get(q, []) == [(r.element_id, r.score) for r in want], text
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "MapInPandas" in plan and "Join" not in plan


def test_prefix_many_is_every_prefix(spark):
    import random

    rng = random.Random(5)
    made = lambda n: "".join(rng.choices("abé漢\U0001f600z", k=rng.randint(0, n)))
    names = [(made(6), f"i{k % 50}") for k in range(300)] + [(None, "x")]
    starts = [made(3) for _ in range(40)] + ["", "abc" * 9, "퟿", None]
    got = search.prefix_many(spark.createDataFrame(names, "name string, element_id string"), spark.createDataFrame([(s,) for s in starts], "prefix string"))
    want = {(s, n, i) for s in starts if s is not None for n, i in names if n is not None and n.startswith(s)}
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_ancestors_and_cycles(spark):
    import random

    rng = random.Random(6)
    edges = [(k, rng.randrange(k)) for k in range(1, 60)] + [(k, rng.randrange(k)) for k in range(1, 20)] + [(100 + k, 100 + k + 1) for k in range(70)] + [(201, 202), (202, 203), (203, 201), (204, 203), (5, None), (300, 300)]
    got = {(r.node, r.ancestor): r.depth for r in index.ancestors(spark.createDataFrame(edges, "node long, parent long")).collect()}
    up, want = {}, {}
    for a, b in edges:
        if b is not None:
            up.setdefault(a, set()).add(b)
    for a in up:
        level, depth, seen = up[a], 1, {}
        while level - seen.keys():
            seen |= {b: depth for b in level if b not in seen}
            level, depth = {c for b in level for c in up.get(b, ()) if c not in seen}, depth + 1
        want |= {(a, b): d for b, d in seen.items()}
    assert got == want and {a for a, b in got if a == b} == {201, 202, 203, 300}
    assert index.ancestors(spark.createDataFrame([], "node long, parent long")).count() == 0


def test_descendants(spark):
    rows = [(1, "m.A", None), (2, "m.B", "m.A"), (3, "m.f", "m.B"), (4, "m.g", "m.X"), (5, "m.f", "m.B")]
    e = spark.createDataFrame(rows, "seq long, element_id string, parent_id string")
    assert {(r.element_id, r.seq, r.depth) for r in index.descendants(e, "m.A").collect()} == {("m.B", 2, 1), ("m.f", 3, 2)}


def test_a_failed_save_leaves_the_old_index(spark, tmp_path, monkeypatch):
    folder = str(tmp_path / "i")
    made_ = lambda *ids: spark.createDataFrame([(i, i, "f.py") for i in ids], "element_id string, name string, file_path string")
    with pytest.raises(ValueError, match="no index"):
        store.load(spark, folder)
    assert store.save(made_("a"), folder) == 1
    with pytest.raises(ValueError, match="there is an index"):
        store.save(made_("b"), folder)
    with monkeypatch.context() as m:
        m.setattr(store, "stats", lambda e: 1 / 0)  # killed when half of it is written
        with pytest.raises(ZeroDivisionError):
            store.save(made_("b"), folder, "overwrite")
    ids = lambda **v: sorted(r.element_id for r in store.load(spark, folder, **v).collect())
    assert ids() == ["a"] and store.load(spark, folder, "stats").first().total_elements == 1
    assert store.save(made_("c", "d"), folder, "overwrite") == 2
    assert ids() == ["c", "d"] and ids(version=1) == ["a"] and store.load(spark, folder, "stats").first().total_elements == 2
    with pytest.raises(ValueError, match="version 7"):
        store.load(spark, folder, version=7)


def test_ingest_reads_the_buckets_of_a_batch_only(spark, tmp_path):
    from corpusloom.streaming.ingest import BUCKETS, add_new, known_ids

    folder = str(tmp_path / "out")
    many = spark.range(3000).selectExpr("id AS seq", "concat('m.f', id) AS element_id")
    add_new(many, folder)
    few = many.where("seq IN (5, 17)").unionByName(spark.createDataFrame([(9000, "m.new")], many.schema))
    known = known_ids(few, folder)
    assert known.count() < 3000 * 4 // BUCKETS * 2
    plan = known._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan
    files = spark.read.parquet(folder).select(F.input_file_name().alias("f")).distinct().count()
    assert files == BUCKETS and known.select(F.input_file_name().alias("f")).distinct().count() <= 3
    add_new(few, folder)
    got = spark.read.parquet(folder)
    assert got.count() == 3001 and got.select("element_id").distinct().count() == 3001


def test_ancestors_are_written_once(spark, monkeypatch):
    """Rounds write what is new only: all tables together have as many rows as the result."""
    sizes, own = [], index.written
    monkeypatch.setattr(index, "written", lambda df, name="table": (t := own(df, name), sizes.append(t.count()))[0])
    got = index.ancestors(spark.createDataFrame([(k, k // 2) for k in range(2, 64)], "node long, parent long"))
    assert got.count() == sum(sizes) == sum(k.bit_length() - 1 for k in range(2, 64))


def test_build_of_some_columns(spark, tmp_path):
    """The same rows are chosen, and what isn't wanted stays out of the shuffle."""
    from corpusloom.plans.build import build_index

    for folder in ("a", "b"):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "m.py").write_text(f"class {folder.upper()}: pass\ndef f(): pass\n")
    whole, some = build_index(spark, str(tmp_path))[0], build_index(spark, str(tmp_path), columns=("element_type",))[0]
    assert some.columns == ["element_id", "file_path", "line_start", "element_type", "seq"]
    key = lambda e: sorted(tuple(r) for r in e.select("element_id", "file_path", "line_start", "element_type").collect())
    assert key(some) == key(whole) and len(key(some)) == 4
