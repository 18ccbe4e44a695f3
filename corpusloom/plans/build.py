"""The whole way from folders to an index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import parse
from ..shared import written
from ..sources.pytree import crawl


def first_of_id(elements: DataFrame) -> DataFrame:
    """The first row of each element_id by path and line, combined before the shuffle, since ids are
    made of file stems and many files share some."""
    columns = elements.columns
    return elements.groupBy("element_id").agg(F.min_by(F.struct(*columns), F.struct("file_path", "line_start")).alias("_e")).select("_e.*").select(*columns, F.lit(1).cast("long").alias("seq"))


def build_index(spark: SparkSession, *roots: str, fallbacks: bool = True, columns: tuple[str, ...] | None = None, **options: str) -> tuple[DataFrame, DataFrame]:
    """(elements, parse errors) of all Python files below ``roots``: crawled, parsed once, one row for each id. With ``columns``
    the elements have only these, and those that choose the row (element_id, file_path, line_start): what is chosen goes
    through a shuffle whole, so that Spark can't leave out what nobody reads later."""
    files = crawl(spark, *roots, **options)
    parsed = written(parse.parse_files(files, fallbacks), "parsed")
    elements = parse.elements(parsed)
    if columns is not None:
        elements = elements.select(*dict.fromkeys(("element_id", "file_path", "line_start", *columns)))
    return first_of_id(elements), parse.parse_errors(parsed)
