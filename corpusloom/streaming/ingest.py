"""Incremental ingest, an extension: new elements are appended as they come, known ids are ignored."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import IntegerType, StructField, StructType

from ..operators import parse
from ..operators.index import first_wins
from ..shared import written
from ..sources.pytree import follow_tree

BUCKETS = 256


def bucketed(elements: DataFrame) -> DataFrame:
    """``elements`` with the bucket that an id belongs to."""
    return elements.withColumn("bucket", F.pmod(F.xxhash64("element_id"), F.lit(BUCKETS)).cast("int"))


def known_ids(batch: DataFrame, folder: str) -> DataFrame | None:
    """(element_id) that the index at ``folder`` holds in the buckets of ``batch``, which are the only ones read."""
    spark = batch.sparkSession
    try:
        held = spark.read.schema(StructType([*batch.schema.fields, StructField("bucket", IntegerType())])).parquet(folder)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    buckets = [r.bucket for r in bucketed(batch).select("bucket").distinct().collect()]  # at most BUCKETS numbers
    return held.where(F.col("bucket").isin(buckets)).select("element_id")


def add_new(batch: DataFrame, folder: str) -> None:
    """Append the first row of every id of ``batch`` that the index at ``folder`` doesn't hold yet. Files are Parquet in a
    folder for each bucket, with a Bloom filter over the ids, so that a look-up of an id opens few of them."""
    fresh = first_wins(batch)
    known = known_ids(batch, folder)
    if known is not None:
        fresh = fresh.join(known, "element_id", "left_anti").select(*batch.columns)
    rows = bucketed(fresh).repartition("bucket").sortWithinPartitions("bucket", "element_id")
    rows.write.mode("append").option("parquet.bloom.filter.enabled#element_id", "true").option("parquet.bloom.filter.adaptive.enabled", "true").partitionBy("bucket").parquet(folder)


def ingest(stream: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Feed the index at ``folder`` from a stream of elements. A batch that is repeated after a failure adds
    nothing twice, because its ids are known by then."""
    return stream.writeStream.foreachBatch(lambda batch, _: add_new(batch, folder)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingest_tree(spark: SparkSession, folder: str, checkpoint: str, *roots: str, **options: str) -> StreamingQuery:
    """Feed the index at ``folder`` from the files that come below ``roots``; options of ``follow_tree``. Files are parsed
    with fallbacks, once each. What a changed file adds is added; its known ids stay as they are."""

    def add(batch: DataFrame, _: int) -> None:
        parsed = written(parse.parse_files(batch, fallbacks=True), "parsed")
        add_new(parse.elements(parsed).withColumn("seq", F.xxhash64("file_path", "line_start")), folder)

    stream = follow_tree(spark, *roots, **options)
    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
