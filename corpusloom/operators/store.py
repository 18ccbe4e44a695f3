"""Saving and loading an index: versions of Parquet tables sorted for the lookups, and a manifest that is written last.

A version's tables lie in a folder of their own. What makes it the index is a manifest, a table of one row that Spark's
committer makes visible whole or not at all. A save that fails on the way leaves the version before as it is.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .index import postings, stats

_MANIFEST = "version long, data string"


def versions(spark: SparkSession, folder: str) -> DataFrame | None:
    """(version, data): the saves that were finished; none where there is no index."""
    try:
        return spark.read.schema(_MANIFEST).option("recursiveFileLookup", "true").parquet(f"{folder}/manifest")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def _latest(spark: SparkSession, folder: str):
    found = versions(spark, folder)
    return None if found is None else found.agg(F.max(F.struct("version", "data")).alias("m")).first().m


def save(elements: DataFrame, folder: str, mode: str = "error") -> int:
    """Write ``elements`` (ranges of element_id, so that row groups can be skipped), ``postings`` (by token) if
    there are search tokens, and ``stats``; then the manifest. ``mode`` is ``error``, or ``overwrite`` for a further
    version; the number of the version is returned. Older ones stay, and can be loaded by number."""
    spark = elements.sparkSession
    before = _latest(spark, folder)
    if before is not None and mode != "overwrite":
        raise ValueError(f"there is an index at {folder}")
    data = f"data/{uuid.uuid4().hex}"
    elements.repartitionByRange("element_id").sortWithinPartitions("element_id").write.parquet(f"{folder}/{data}/elements")
    if "search_tokens" in elements.columns:
        postings(elements).repartitionByRange("token").sortWithinPartitions("token").write.parquet(f"{folder}/{data}/postings")
    stats(elements).write.parquet(f"{folder}/{data}/stats")
    version = 1 if before is None else before.version + 1
    # Two saves at once take the same number, and the second one's table exists already.
    spark.createDataFrame([(version, data)], _MANIFEST).coalesce(1).write.parquet(f"{folder}/manifest/{version:09d}")
    return version


def load(spark: SparkSession, folder: str, table: str = "elements", version: int | None = None) -> DataFrame:
    """A table of the latest finished save, or of an earlier one."""
    found = versions(spark, folder)
    row = None if found is None else found.where(F.lit(True) if version is None else F.col("version") == version).orderBy(F.desc("version")).first()
    if row is None:
        raise ValueError(f"no index at {folder}" + ("" if version is None else f" with version {version}"))
    return spark.read.parquet(f"{folder}/{row.data}/{table}")
