"""Files to elements and parse errors. One Python step per file; all else is columns."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from ..functions import columns as C
from ..functions.pysource import parse_safely, parse_with_fallbacks
from ..model import PARSED_WITH, RAW_ELEMENT, STUB, STUB_CODE, STUB_COLUMN, STUB_LINE

ROWS = 500  # files whose rows are made at a time


def parse_files(files: DataFrame, fallbacks: bool = False, partitions: int | None = None, element: str = RAW_ELEMENT) -> DataFrame:
    """A row of PARSED for each file (path, content); with ``fallbacks`` through the whole chain. A null
    content is an empty file; a file that can't be parsed is a row with an error, never a failure. A small table in few
    partitions is dealt out to ``partitions``, since parsing costs more than moving it. ``element`` is the type of an element: a struct of
    the fields that are wanted, because Spark can't tell Python which of them are read."""
    parse = parse_with_fallbacks if fallbacks else parse_safely

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # Trees and rows hardly have cycles: looking for them again and again while they grow takes a third of the time.
        gc.disable()
        try:
            for b in batches:
                for at in range(0, len(b), ROWS):  # rows of elements are far larger than files
                    some = b.iloc[at : at + ROWS]
                    yield pd.DataFrame([parse(p or "", c or b"") for p, c in zip(some["path"], some["content"])])
                    gc.collect(0)
        finally:
            gc.enable()

    if partitions:
        files = files.repartition(partitions)
    return files.select("path", F.col("content").cast("binary").alias("content")).mapInPandas(run, PARSED_WITH.format(element=element))


def _last_of_name(rows: Column) -> Column:
    """Of the callables of one name in a file's elements the last. The array is sorted by name and place, so that it is
    the one before another name: no shuffle, and the file is parsed once."""
    callable_ = lambda e: e["element_type"].isin("FUNCTION", "METHOD")
    ordered = F.array_sort(F.transform(F.filter(rows, callable_), lambda e: F.struct(e["name"].alias("name"), e["line_start"].alias("line"), e["line_end"].alias("end"), e.alias("e"))))
    last = C.bound(ordered, lambda o: F.transform(F.filter(o, lambda x, i: F.get(o, i + 1).isNull() | (F.get(o, i + 1)["name"] != x["name"])), lambda x: x["e"]))
    return F.concat(F.filter(rows, lambda e: ~callable_(e)), last)


def elements(parsed: DataFrame, nested: bool = False) -> DataFrame:
    """The ``elements`` table. Functions defined in functions are left out unless ``nested``; of functions of
    one name in a file the last one stays; seq follows path and line."""
    rows = F.col("elements") if nested else F.filter("elements", lambda e: e["depth_in_functions"] == 0)
    e = parsed.select("file_path", F.explode(_last_of_name(rows)).alias("e")).select("file_path", "e.*")
    e = e.withColumns({"attributes": F.map_from_entries("attributes"), "import_aliases": F.map_from_entries("import_aliases")})
    callable_ = F.col("element_type").isin("FUNCTION", "METHOD")
    e = e.withColumns({
        "element_id": C.element_id(F.col("module_path"), F.col("name")),
        "parent_id": F.when(F.col("parent_name").isNotNull(), C.element_id(F.col("module_path"), F.col("parent_name"))),
        "element_kind": F.when(callable_, C.kind(F.col("parent_name"), F.col("decorators"), F.col("name")))
        .when(F.col("element_type") == "IMPORT", F.when(F.col("is_from_import"), "FROM_IMPORT").otherwise("IMPORT"))
        .when(F.col("element_type") == "CLASS", C.class_kind(F.col("bases"), F.col("decorators")))
        .when(F.col("element_type") == "MODULE", F.when(F.substring_index("file_path", "/", -1) == "__init__.py", "PACKAGE").otherwise("MODULE")),
        "qualified_name": F.concat_ws(".", "module_path", "parent_name", "name"),
    })
    return e.withColumn("search_tokens", C.search_tokens())


def compat_elements(parsed: DataFrame) -> DataFrame:
    """The narrow view: functions outside functions only, all of type FUNCTION, without module and parent,
    the last of one name in a file on the line of the last, in the order of the first."""
    e = parsed.select("file_path", F.explode("elements").alias("e")).select("file_path", "e.*")
    e = e.where(F.col("element_type").isin("FUNCTION", "METHOD") & (F.col("depth_in_functions") == 0))
    kept = e.groupBy("file_path", "name").agg(F.max_by(F.struct("line_start", "line_end", F.col("signature.is_async").alias("is_async"), "docstring"), "line_start").alias("e"), F.min("line_start").alias("first_line"))
    return kept.select("file_path", C.element_id(F.lit(None), F.col("name")).alias("element_id"), "name", F.lit("FUNCTION").alias("element_type"), "e.*", "first_line")


def parse_errors(parsed: DataFrame) -> DataFrame:
    e = parsed.where("error IS NOT NULL")
    return e.select(F.col("file_path").alias("file"), "error.error_type", "error.message", "error.line", "error.column", "error.traceback", "error.code_snippet", "fallback_level", "issues_found")


def first_errors(errors: DataFrame) -> DataFrame:
    """The error of the lowest line of each file; one without a line comes last."""
    columns = errors.columns
    place = F.struct(F.col("line").isNull(), F.col("line"), F.col("error_type"), F.col("message"))
    return errors.groupBy("file").agg(F.min_by(F.struct(*columns), place).alias("_e")).select("_e.*").select(*columns)


def for_each_error(errors: DataFrame, handle: Callable[[dict], None]) -> None:
    """Call ``handle`` with every error as a dictionary, in the tasks."""
    errors.foreach(lambda row: handle(row.asDict(recursive=True)))


def parse_outcomes(files: DataFrame, parsed: DataFrame) -> DataFrame:
    """Every file with whether it could be parsed; files without a result have none."""
    done = parsed.select(F.col("file_path").alias("path"), F.col("elements").isNotNull().alias("parsed"), "fallback_level")
    return files.select("path").join(done, "path", "left")


def stub_modules(errors: DataFrame) -> DataFrame:
    """A MODULE element for each parse error, with the error as its docstring."""
    path = F.col("file")
    stem = F.regexp_replace(F.substring_index(path, "/", -1), r"(?<=.)\.[^.]*$", "")
    module = F.when(stem == "__init__", F.substring_index(F.substring_index(path, "/", -2), "/", 1)).otherwise(stem)
    place = F.when(F.col("line") > 0, F.concat(F.lit(STUB_LINE), F.col("line"), F.coalesce(F.when(F.col("column") > 0, F.concat(F.lit(STUB_COLUMN), F.col("column"))), F.lit("")), F.lit("\n")))
    code = F.concat(F.lit(STUB_CODE), F.col("code_snippet"), F.lit("\n"))
    head = F.replace(F.replace(F.lit(STUB), F.lit("{error_type}"), F.col("error_type")), F.lit("{message}"), F.col("message"))
    text = F.concat(head, F.coalesce(place, F.lit("")), F.coalesce(code, F.lit("")))
    return errors.select(F.concat(F.lit("stub:"), path).alias("element_id"), module.alias("name"), F.lit("MODULE").alias("element_type"), path.alias("file_path"), F.lit(1).alias("line_start"), F.lit(1).alias("line_end"), module.alias("module_path"), text.alias("docstring"), "error_type")


def fallback_levels(parsed: DataFrame) -> DataFrame:
    return parsed.groupBy("fallback_level").agg(F.count(F.lit(1)).alias("files"))


@udtf(returnType="name string, element_type string, line_start int, line_end int, parent_name string, docstring string, is_async boolean, depth_in_functions int, error_type string")
class ParseDefs:
    """``LATERAL parse_defs(code)``: the elements of a source string, or one row with the error."""

    def eval(self, code: str):
        row = parse_safely("", (code or "").encode("utf-8", "surrogatepass"))
        if row["elements"] is None:
            yield None, None, row["error"]["line"], None, None, row["error"]["message"], None, None, row["error"]["error_type"]
            return
        for e in row["elements"]:
            yield e["name"], e["element_type"], e["line_start"], e["line_end"], e["parent_name"], e["docstring"], (e["signature"] or {}).get("is_async"), e["depth_in_functions"], None


def register_parse(spark: SparkSession, name: str = "parse_defs") -> None:
    spark.udtf.register(name, ParseDefs)
