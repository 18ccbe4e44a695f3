import os

import pytest
from pyspark.sql import functions as F

from corpusloom.model import FILES
from corpusloom.operators import files
from corpusloom.sources.pytree import follow_tree, read_tree
from corpusloom.streaming.ingest import ingest_tree


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")

    def put(path, content=b"x = 1\n"):
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_bytes(content)

    for path in ("real.py", "__init__.py", "_priv.py", "B.PY", "pkg/m.py", ".hid.py", ".venv/v.py", "__pycache__/c.py", "build/b.py", ".hidden/h.py", "pkg/dist/d.py", "a.txt", ".py", "mine/x.py"):
        put(path)
    put("edge.py", b"#" * 10_485_760)
    put("over.py", b"#" * 10_485_761)
    put("late.py", b"#" * 8192 + b"\xff")
    put("early.py", b"#" * 8191 + b"\xff")
    os.symlink(root / "real.py", root / "symlink.py")
    os.symlink(root, root / "pkg/loop")
    return root


def names(df, root):
    return sorted(os.path.relpath(r.path, root) for r in df.select("path").collect())


KEPT = [".hid.py", "B.PY", "__init__.py", "_priv.py", "edge.py", "mine/x.py", "pkg/m.py", "real.py"]


def test_rules(spark, tree):
    assert names(read_tree(spark, str(tree)), tree) == sorted(KEPT)
    assert names(read_tree(spark, str(tree), excludedDirs="mine"), tree) == sorted(set(KEPT) - {"mine/x.py"})
    assert names(read_tree(spark, str(tree), utf8="probe"), tree) == sorted([*KEPT, "late.py"])
    skipped = {os.path.basename(r.path): r.skipped for r in read_tree(spark, str(tree), emit="skipped").collect()}
    assert skipped["over.py"] == "size" and skipped["symlink.py"] == "symlink" and skipped["early.py"] == skipped["late.py"] == "encoding"


def test_links_and_roots(spark, tree):
    followed = names(read_tree(spark, str(tree), followSymlinks="true"), tree)
    assert "symlink.py" in followed and len(followed) < 60
    twice = read_tree(spark, str(tree / "pkg"), str(tree / "pkg"))
    assert names(twice, tree) == ["pkg/m.py", "pkg/m.py"]
    with pytest.raises(Exception, match="nowhere"):
        read_tree(spark, str(tree / "nowhere")).collect()
    with pytest.raises(Exception, match="NotADirectory|real.py"):
        read_tree(spark, str(tree / "real.py")).collect()


def test_batches_and_budget(spark):
    df = spark.range(0, 1000, 3).withColumnRenamed("id", "seq")
    got = files.in_batches(df, "seq", 100).groupBy("batch_id").count().orderBy("batch_id").collect()
    assert [r["count"] for r in got] == [100, 100, 100, 34]
    warned = files.memory_budget(df, "seq", F.lit(10), 1000).where("NOT memory_warning").count()
    assert warned == 100
    assert files.in_batches(df.where("seq < 0"), "seq").count() == 0


@pytest.mark.parametrize("key", ["xxhash64(id)", "id * id * id", "IF(id = 7, 9000000000000000000, id)", "CAST(id AS string)", "concat('stem', CAST(id AS string))"])
def test_order_of_any_key(spark, key):
    """Hashed, skewed, far-out and string keys: numbers without gaps in the key's order."""
    df = spark.range(0, 3000).selectExpr(f"{key} AS seq")
    got = files.in_batches(df, "seq", 100).orderBy("seq").collect()
    assert [r.batch_id for r in got] == [k // 100 for k in range(3000)]


def _rows(df):
    return sorted((r.path, r.name, r.size, r.is_symlink, bytes(r.content) if r.content is not None else None, r.skipped) for r in df.collect())


@pytest.mark.parametrize("follow", ["false", "true"])
def test_levels_find_what_the_source_finds(spark, tmp_path, follow):
    """Deep and flat folders, pruned ones, links in a circle, files of every skipped kind."""
    from corpusloom.sources.pytree import crawl, read_tree

    for p, content in {"a.py": b"1", "x/b.py": b"22", "x/y/z/c.PY": b"", "x/.h/d.py": b"3", "build/e.py": b"4", "x/bad.py": b"\xff", "x/big.py": b"#" * 3000, "x/no.txt": b"5"}.items():
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_bytes(content)
    for k in range(30):
        (tmp_path / "x" / f"f{k}.py").write_bytes(b"x" * k)
    (tmp_path / "x" / "y" / "back").symlink_to(tmp_path / "x")
    (tmp_path / "link.py").symlink_to(tmp_path / "a.py")
    options = {"followSymlinks": follow, "emit": "all", "maxFileSizeMb": "0.002"}
    got, want = _rows(crawl(spark, str(tmp_path), part_bytes=100, **options)), _rows(read_tree(spark, str(tmp_path), **options))
    if follow == "true":  # which of two names of a folder is entered may differ
        real = lambda rows: sorted({(os.path.realpath(r[0]), *r[2:]) for r in rows if not r[3]})
        assert real(got) == real(want)
    else:
        assert got == want and {r[5] for r in got} == {None, "encoding", "size", "symlink"}


def test_a_flat_folder_is_many_tasks(spark, tmp_path, monkeypatch):
    from corpusloom.sources import pytree

    for k in range(400):
        (tmp_path / f"f{k}.py").write_bytes(b"x")
    monkeypatch.setattr(pytree, "SLICE", 50)
    reader = pytree.TreeReader({"path": str(tmp_path)})
    parts = reader.partitions()
    each = [sorted(r[1] for r in reader.read(p)) for p in parts]
    assert len(parts) == 8 and all(each) and sorted(sum(each, [])) == sorted(f"f{k}.py" for k in range(400))
    assert pytree.crawl(spark, str(tmp_path), part_bytes=50).select(F.spark_partition_id()).distinct().count() >= 4


def test_filters_reach_the_walk(spark, tmp_path, monkeypatch):
    """What a filter turns down is never opened, folders beside a path are never entered, and rows are the same."""
    from pyspark.sql import datasource as ds

    from corpusloom.sources import pytree

    for p in ("a/x.py", "a/long.py", "b/x.py", "b/c/y.py"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_bytes(b"#" * (100 if "long" in p else 1))
    reader = pytree.TreeReader({"path": str(tmp_path)})
    kept = list(reader.pushFilters([ds.LessThan(("size",), 50), ds.EqualTo(("name",), "x.py"), ds.StringStartsWith(("path",), f"{tmp_path}/a"), ds.IsNotNull(("size",))]))
    assert [type(f) for f in kept] == [ds.StringStartsWith, ds.IsNotNull]
    opened, entered, scan = [], [], os.scandir
    monkeypatch.setattr("builtins.open", lambda p, *a, _open=open: (opened.append(os.path.relpath(p, tmp_path)), _open(p, *a))[1])
    monkeypatch.setattr(os, "scandir", lambda p: (entered.append(os.path.relpath(p, tmp_path)), scan(p))[1])
    rows = [r[0] for p in reader.partitions() for r in reader.read(p)]
    monkeypatch.undo()
    assert rows == [f"{tmp_path}/a/x.py"] and opened == ["a/x.py"] and set(entered) == {".", "a"}
    tree = pytree.read_tree(spark, str(tmp_path))
    where = f"size < 50 AND name LIKE 'x%' AND path LIKE '{tmp_path}/b%'"
    assert [r.path for r in tree.where(where).select("path").collect()] == [f"{tmp_path}/b/x.py"]
    plan = tree.where("size < 50")._jdf.queryExecution().executedPlan().toString()
    assert "Filter (size" not in plan


def test_trees_need_a_mounted_folder(spark):
    from corpusloom.operators.files import write_tree

    with pytest.raises(ValueError, match="no mounted folder"):
        write_tree(spark.createDataFrame([("a.py", b"")], "path string, content binary"), "hdfs://host/shared/x")


def followed(spark, root, folder, **options):
    """One run of a stream whose rows are written to ``folder``: all rows so far, by path."""
    stream = follow_tree(spark, str(root), **{"settleSeconds": "0", **options})
    stream.writeStream.format("parquet").option("path", str(folder / "out")).option("checkpointLocation", str(folder / "state")).trigger(availableNow=True).start().awaitTermination()
    return names(spark.read.schema(FILES).parquet(str(folder / "out")), root)


def test_stream_repeats_and_loses_nothing(spark, tmp_path):
    root, old = tmp_path / "tree", tmp_path / "old.py"
    (root / "pkg").mkdir(parents=True)
    old.write_bytes(b"o = 1\n")
    os.utime(old, (1, 1))  # a modification time long before all offsets
    for k in range(1203):  # more than one part
        (root / f"m{k}.py").write_bytes(b"x = 1\n")
    first = sorted(f"m{k}.py" for k in range(1203))
    assert followed(spark, root, tmp_path) == first
    assert followed(spark, root, tmp_path) == first  # nothing came
    os.rename(old, root / "pkg/old.py")
    (root / "m7.py").write_bytes(b"x = 2\n")
    (root / "pkg/bad.py").write_bytes(b"\xff")
    (root / "m8.py").unlink()
    assert followed(spark, root, tmp_path) == sorted([*first, "pkg/old.py", "m7.py"])


def test_stream_runs_a_failed_batch_again(spark, tmp_path):
    """The batch that failed holds its files when it is run again, and what came meanwhile is in a later one."""
    root, seen = tmp_path / "tree", []
    root.mkdir()
    (root / "a.py").write_bytes(b"x = 1\n")

    def run(fail):
        def add(batch, n):
            if fail:
                raise RuntimeError("lost")
            seen.extend((n, r.name) for r in batch.select("name").collect())

        stream = follow_tree(spark, str(root), settleSeconds="0")
        stream.writeStream.foreachBatch(add).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()

    with pytest.raises(Exception, match="lost"):
        run(True)
    (root / "b.py").write_bytes(b"x = 2\n")
    run(False)
    run(False)
    assert seen == [(0, "a.py"), (1, "b.py")]


def test_stream_waits_for_files_to_settle(spark, tmp_path):
    (tmp_path / "tree").mkdir()
    (tmp_path / "tree/new.py").write_bytes(b"x = 1\n")
    assert followed(spark, tmp_path / "tree", tmp_path, settleSeconds="3600") == []
    assert followed(spark, tmp_path / "tree", tmp_path) == ["new.py"]


def test_tree_into_an_index(spark, tmp_path):
    root = tmp_path / "tree"
    root.mkdir()
    ids = lambda: sorted(r.element_id for r in spark.read.parquet(str(tmp_path / "index")).where("element_type = 'FUNCTION'").collect())
    for k in (1, 2):
        (root / f"m{k}.py").write_bytes(f"def f{k}():\n    pass\n".encode())
        ingest_tree(spark, str(tmp_path / "index"), str(tmp_path / "state"), str(root), settleSeconds="0").awaitTermination()
        assert ids() == [f"m{j}.f{j}" for j in range(1, k + 1)]


def test_a_large_folder_is_listed_a_bounded_number_of_times(tmp_path, monkeypatch):
    from corpusloom.sources import pytree

    monkeypatch.setattr(pytree, "SLICE", 1)
    for k in range(100):
        (tmp_path / f"m{k}.py").write_text("")
    tree = pytree.TreeReader({"path": str(tmp_path)})
    parts = tree.partitions()
    assert len(parts) == pytree.SLICES and len({r[0] for p in parts for r in tree.read(p)}) == 100
