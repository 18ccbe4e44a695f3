"""Rules over file tables: crawl filters, several roots, batches, a memory budget."""

from __future__ import annotations

import os
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..sources.pytree import EXCLUDED
from ..shared import mounted
from .ordered import by_value, row_numbers, running_sum


def crawl_filter(files: DataFrame, max_bytes: int = 10 * 1024 * 1024, excluded: tuple[str, ...] = (), follow_symlinks: bool = False) -> DataFrame:
    """The rows (path relative to the root, name, size, is_symlink) that a crawl keeps. Cheap tests come first."""
    keep = C.is_python(F.col("name")) & (F.col("size") <= max_bytes) & C.enters(F.col("path"), [*EXCLUDED, *excluded])
    return files.where(keep if follow_symlinks else keep & ~F.col("is_symlink"))


def union_roots(*roots: DataFrame) -> DataFrame:
    """All rows of all roots; overlapping roots give rows twice."""
    return reduce(DataFrame.unionByName, roots)


def in_batches(files: DataFrame, order: str, size: int = 1000) -> DataFrame:
    """Add ``batch_id``: batches of ``size`` in the order of a numeric, unique column; the last may be short."""
    numbered = row_numbers(files, by_value(order, files), [order], "_rn")
    return numbered.withColumn("batch_id", F.floor((F.col("_rn") - 1) / size)).drop("_rn")


def memory_budget(files: DataFrame, order: str, estimate, budget: int) -> DataFrame:
    """Add ``memory_warning``: whether the estimates up to and with this row exceed the budget. No row goes."""
    summed = running_sum(files, by_value(order, files), [order], estimate, "_total")
    return summed.withColumn("memory_warning", F.col("_total") > budget).drop("_total")


def write_tree(files: DataFrame, root: str) -> None:
    """Write each row (path relative to ``root``, content) as a file, in the tasks. ``root`` is a folder that all of
    them mount; a store that only Spark reads is refused. A repeated task writes the same bytes again."""
    root = mounted(root)

    def put(rows) -> None:
        made: set[str] = set()
        for r in rows:
            path = os.path.join(root, r.path)
            folder = os.path.dirname(path)
            if folder not in made:
                os.makedirs(folder, exist_ok=True)
                made.add(folder)
            with open(path, "wb") as f:
                f.write(bytes(r.content or b""))

    # Files cost the same however few bytes they have, so rows are dealt to all cores.
    files.select("path", "content").repartition(files.sparkSession.sparkContext.defaultParallelism).foreachPartition(put)
