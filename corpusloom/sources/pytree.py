"""A data source that crawls folder trees for Python files: ``spark.read.format("pytree")``.

Options: ``path`` (or ``paths``, separated by line feeds; overlapping roots give rows twice),
``followSymlinks`` (false), ``excludedDirs`` (comma-separated, added to the standard ones),
``maxFileSizeMb`` (10), ``utf8`` (``full``, ``probe`` for the first 8192 bytes only, ``none``) and
``emit`` (``files``, ``skipped`` or ``all``). Folders are pruned before they are entered; files that a rule
turns down have its name in ``skipped`` and no content. Filters on ``size``, ``name`` and the start of ``path`` reach the
walk, before a file is opened or a folder entered.

The source plans its parts from names alone: the upper levels are listed until there are PARTS folders, and the files
of a large folder are dealt to several parts by a hash of their names. ``crawl`` lists every level in tasks instead,
and reads contents in parts of about equal bytes: for trees too large to be listed on the driver.

As a stream (``follow_tree``) the source gives what changed since the batch before.
"""

from __future__ import annotations

import codecs
import os
import time
import zlib
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from ..model import FILES
from ..shared import written

#: Folders that are never entered.
EXCLUDED = (".venv", "venv", "__pycache__", ".git", "node_modules", ".tox", ".eggs", "build", "dist")
PROBE = 8192
PARTS = 64  # folders from which the levels below are left to tasks
SLICE = 500  # files of one folder for a part
SLICES = 64  # parts of one folder at most: each of them lists the folder, so that more would cost the square of its files
CHUNK = 10_000  # rows of a listing that a task holds
PART_BYTES = 64 << 20


def is_python_name(name: str) -> bool:
    """Whether the suffix is .py in any case; a name that is all suffix has none."""
    return os.path.splitext(name)[1].lower() == ".py"


def decodes(content: bytes, rule: str) -> bool:
    if rule == "none":
        return True
    try:
        codecs.getincrementaldecoder("utf-8")().decode(content[:PROBE] if rule == "probe" else content, final=rule != "probe" or len(content) <= PROBE)
    except UnicodeDecodeError:
        return False
    return True


class TreePart(InputPartition):
    """A folder and whether to go below it; or every ``of``-th of its own files by a hash of their names. With ``times``
    only what changed after the first and up to the second of them, in nanoseconds."""

    def __init__(self, folder: str, deep: bool, k: int = 0, of: int = 1, times: tuple[int, int] | None = None):
        self.folder, self.deep, self.k, self.of, self.times = folder, deep, k, of, times

    def holds(self, path: str) -> bool:
        return self.times is None or self.times[0] < changed(path) <= self.times[1]


def changed(path: str) -> int:
    """When a file or the link to it last changed, came or was renamed, in nanoseconds; 0 if it is gone. Modification
    times won't do: a file moved or unpacked into a tree keeps an old one."""
    times = [0]
    for stat in (os.lstat, os.stat):  # a broken link has the first only
        try:
            times.append(stat(path).st_ctime_ns)
        except OSError:
            break
    return max(times)


#: What a filter on a column asks of a value that isn't null.
_TESTS: dict[type, Callable] = {
    ds.EqualTo: lambda x, v: x == v, ds.In: lambda x, v: x in v, ds.GreaterThan: lambda x, v: x > v, ds.GreaterThanOrEqual: lambda x, v: x >= v, ds.LessThan: lambda x, v: x < v,
    ds.LessThanOrEqual: lambda x, v: x <= v, ds.StringStartsWith: str.startswith, ds.StringEndsWith: str.endswith, ds.StringContains: lambda x, v: v in x,
}


class TreeReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        roots = options.get("paths") or options.get("path") or ""
        self.roots = [os.path.realpath(p) for p in roots.split("\n") if p]
        if not self.roots:
            raise ValueError("pytree needs a path")
        self.follow = options.get("followsymlinks", options.get("followSymlinks", "false")).lower() == "true"
        more = options.get("excludeddirs", options.get("excludedDirs", ""))
        self.excluded = frozenset(EXCLUDED) | {x.strip() for x in more.split(",") if x.strip()}
        self.limit = float(options.get("maxfilesizemb", options.get("maxFileSizeMb", "10"))) * 1024 * 1024
        self.utf8, self.emit = options.get("utf8", "full"), options.get("emit", "files")
        self.tests: dict[str, list[Callable[[object], bool]]] = {"name": [], "size": []}
        self.below: list[str] = []
        for root in self.roots:
            if not os.path.exists(root):
                raise FileNotFoundError(root)
            if not os.path.isdir(root):
                raise NotADirectoryError(root)

    def pushFilters(self, filters: list[ds.Filter]) -> Iterable[ds.Filter]:
        """Take what the walk can test; Spark keeps the rest, and the start of a path as well."""
        for f in filters:
            test, column = _TESTS.get(type(f)), getattr(f, "attribute", None)
            if test and column in (("name",), ("size",)):
                self.tests[column[0]].append(lambda x, test=test, v=f.value: x is not None and test(x, v))
                continue
            if isinstance(f, ds.StringStartsWith) and column == ("path",):
                self.below.append(f.value)
            yield f

    def _wanted(self, column: str, value: object) -> bool:
        return all(test(value) for test in self.tests[column])

    def _enters(self, entry: os.DirEntry) -> bool:
        near = all(entry.path.startswith(p) or p.startswith(entry.path + "/") for p in self.below)
        return near and not entry.name.startswith(".") and entry.name not in self.excluded and (self.follow or not entry.is_symlink())

    def partitions(self) -> list[TreePart]:
        """The upper levels by names, until there are enough folders."""
        todo, parts, seen = [(r, 0, k) for k, r in enumerate(self.roots)], [], set()
        while todo:
            folder, level, root = todo.pop(0)
            real = (os.path.realpath(folder), root)  # overlapping roots give rows twice
            if real in seen:
                continue
            seen.add(real)
            try:
                files, below = 0, []
                with os.scandir(folder) as found:
                    for e in found:
                        if not e.is_dir():
                            files += 1
                        elif self._enters(e):
                            below.append(e.path)
            except OSError:
                parts.append(TreePart(folder, False))
                continue
            of = min(SLICES, max(1, -(-files // SLICE)))
            parts += [TreePart(folder, False, k, of) for k in range(of)]
            below.sort()
            if len(todo) + len(parts) + len(below) < PARTS or level == 0:
                todo += [(p, level + 1, root) for p in below]
            else:
                parts += [TreePart(p, True) for p in below]
        return parts

    def listed(self, folder: str) -> tuple[list[os.DirEntry], str | None]:
        """The entries of a folder by name, or why it can't be read."""
        try:
            with os.scandir(folder) as found:
                return sorted(found, key=lambda e: e.name), None
        except OSError as e:
            return [], f"unreadable folder: {e.strerror}"

    def read(self, part: TreePart) -> Iterator[tuple]:
        seen: set[str] = set()  # real folders above and beside, against cycles of links
        todo = [part.folder]
        while todo:
            folder = todo.pop()
            real = os.path.realpath(folder)
            if real in seen:
                continue
            seen.add(real)
            entries, reason = self.listed(folder)
            if reason and part.holds(folder) and self.shown(folder, os.path.basename(folder), None, reason):
                yield folder, os.path.basename(folder), None, False, None, reason
            for e in entries:
                if e.is_dir():
                    todo += [e.path] if part.deep and self._enters(e) else []
                elif (part.of == 1 or zlib.crc32(e.name.encode("utf-8", "surrogateescape")) % part.of == part.k) and part.holds(e.path):
                    row = self.row(e.path, e.name, e.is_symlink())
                    if row:
                        yield row

    def shown(self, path: str, name: str, size: int | None, skipped: str | None) -> bool:
        """Whether a row is asked for."""
        return (self.emit == "all" or (skipped is None) == (self.emit == "files")) and self._wanted("name", name) and self._wanted("size", size)

    def head(self, path: str, name: str, link: bool) -> tuple[int | None, str | None] | None:
        """(size, why it is skipped) without its content; nothing for what is no Python file."""
        if link and not self.follow:
            return None, "symlink"
        if not is_python_name(name):
            return None
        try:
            size = os.stat(path).st_size
        except OSError as e:
            return None, f"unreadable: {e.strerror}"
        return size, "size" if size > self.limit else None

    def row(self, path: str, name: str, link: bool) -> tuple | None:
        """A row of FILES, if it is asked for."""
        head = self.head(path, name, link) if self._wanted("name", name) else None
        if head is None or not self._wanted("size", head[0]):
            return None
        size, skipped = head
        content = None
        if skipped is None:
            try:
                with open(path, "rb") as f:
                    content = f.read()
            except OSError as e:
                size, skipped = None, f"unreadable: {e.strerror}"
            else:
                if not decodes(content, self.utf8):
                    content, skipped = None, "encoding"
        return (path, name, size, link, content, skipped) if self.shown(path, name, size, skipped) else None


class TreeStream(DataSourceStreamReader):
    """The files of a tree as they come or change. An offset is a time, so it costs no listing and stays as small however
    many files there are; a batch holds what changed after its start and up to its end, in the parts of ``TreeReader``.

    A batch that is run again after a failure finds the same files, but for those that have changed since: they belong to a
    later batch. Nothing is lost as long as a change shows in the listing ``settleSeconds`` (2) after its time at most,
    clocks of file servers included. A clock set back gives files again. A folder moved into the tree as a whole keeps
    the times of its files, which are then too old for the next batch; a deleted file is no event.
    """

    def __init__(self, options: dict[str, str]):
        self.tree = TreeReader(options)
        self.settle = int(float(options.get("settleseconds", options.get("settleSeconds", "2"))) * 1e9)
        self.until = 0

    def initialOffset(self) -> dict:
        return {"until": 0}

    def latestOffset(self) -> dict:
        self.until = max(self.until, time.time_ns() - self.settle)
        return {"until": self.until}

    def partitions(self, start: dict, end: dict) -> list[TreePart]:
        return [TreePart(p.folder, p.deep, p.k, p.of, (start["until"], end["until"])) for p in self.tree.partitions()]

    def read(self, part: TreePart) -> Iterator[tuple]:
        return self.tree.read(part)

    def commit(self, end: dict) -> None:
        """Offsets are in the query's own log; nothing is kept here."""


class PyTree(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pytree"

    def schema(self) -> str:
        return FILES

    def reader(self, schema) -> TreeReader:
        return TreeReader(dict(self.options))

    def streamReader(self, schema) -> TreeStream:
        return TreeStream(dict(self.options))


def read_tree(spark: SparkSession, *roots: str, **options: str) -> DataFrame:
    """The Python files below ``roots``; options as above. Turns on Spark's push-down of filters to Python sources."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PyTree)
    return spark.read.format("pytree").option("paths", "\n".join(roots)).options(**options).load()


def follow_tree(spark: SparkSession, *roots: str, **options: str) -> DataFrame:
    """A stream of the Python files below ``roots``: all at first, then what comes or changes; options as above, and those
    of ``TreeStream``. A file that changes comes again."""
    spark.dataSource.register(PyTree)
    return spark.readStream.format("pytree").option("paths", "\n".join(roots)).options(**options).load()


def crawl(spark: SparkSession, *roots: str, part_bytes: int = PART_BYTES, **options: str) -> DataFrame:
    """The same rows as ``read_tree``, planned by Spark jobs: each level of folders is listed in tasks and written, then
    contents are read in parts of about ``part_bytes``, dealt by a hash of the path. The driver sees numbers only."""
    tree = TreeReader({"paths": "\n".join(roots), **options})
    cores = spark.sparkContext.defaultParallelism
    schema = "root int, path string, name string, real string, folder boolean, size long, is_symlink boolean, skipped string"
    columns = [x.split()[0] for x in schema.split(", ")]

    def table(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=columns).astype({"size": "Int64"})

    def level(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The names in some folders. A folder of any size is listed as it is read, and its files are looked at later."""
        for b in batches:
            for root, folder in zip(b["root"], b["path"]):
                rows = []
                try:
                    with os.scandir(folder) as found:
                        for e in found:
                            if not e.is_dir():
                                rows.append((root, e.path, e.name, None, False, None, e.is_symlink(), None))
                            elif tree._enters(e):
                                rows.append((root, e.path, e.name, os.path.realpath(e.path), True, None, False, None))
                            if len(rows) >= CHUNK:
                                yield table(rows)
                                rows = []
                except OSError as e:
                    rows.append((root, folder, os.path.basename(folder), None, False, None, False, f"unreadable folder: {e.strerror}"))
                if rows:
                    yield table(rows)

    def heads(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The sizes of files, and why some are skipped; folders that can't be read are told already."""
        for b in batches:
            rows = []
            for root, path, name, link, skipped in zip(b["root"], b["path"], b["name"], b["is_symlink"], b["skipped"]):
                head = (None, skipped) if skipped else tree.head(path, name, link)
                if head:
                    rows.append((root, path, name, None, False, head[0], link, head[1]))
            if rows:
                yield table(rows)

    now = spark.createDataFrame([(k, r, r) for k, r in enumerate(tree.roots)], "root int, path string, real string")
    known, found, n = now.select("root", "real"), [], len(tree.roots)
    while n:
        listed = written(now.repartition(min(n, 4 * cores), "path").mapInPandas(level, schema), "listing")
        found.append(listed.where("NOT folder"))
        now = listed.where("folder").select("root", "path", "real")
        if tree.follow:  # a real folder is entered once below a root
            now = now.groupBy("root", "real").agg(F.min("path").alias("path")).join(known, ["root", "real"], "left_anti")
            now = written(now.select("root", "path", "real"), "listing")
            known = known.unionByName(now.select("root", "real"))
        n = now.count()
    files = found[0]
    for f in found[1:]:
        files = files.unionByName(f)
    files = written(files.repartition(4 * cores, "path").mapInPandas(heads, schema), "heads")
    # What is skipped needs no reading; the others are read where their bytes are dealt to.
    told = files.where("skipped IS NOT NULL").select("path", "name", "size", "is_symlink", F.lit(None).cast("binary").alias("content"), "skipped")
    good = files.where("skipped IS NULL").select("path", "name", "is_symlink", "size")
    count, total = good.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    parts = max(1, min(count, max(cores, -(-total // part_bytes))))

    def contents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["path", "name", "size", "is_symlink", "content", "skipped"]
        for b in batches:
            rows, held = [], 0
            for path, name, link in zip(b["path"], b["name"], b["is_symlink"]):
                row = tree.row(path, name, link)
                if row:
                    rows.append(row)
                    held += row[2] or 0
                if held >= 4 << 20:
                    yield pd.DataFrame(rows, columns=names).astype({"size": "Int64"})
                    rows, held = [], 0
            if rows:
                yield pd.DataFrame(rows, columns=names).astype({"size": "Int64"})

    read = good.repartition(parts, "path").mapInPandas(contents, FILES)
    return read if tree.emit == "files" else read.unionByName(told)
