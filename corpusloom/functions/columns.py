"""Column expressions over source text and elements: sanitising, snippets, tokens, kinds, parameters, JSON."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

TAB = "    "
CONTROL = r"[\x00-\x08\x0B\x0C\x0E-\x1F]"


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of ``value``, which is computed once: what a lambda reads is otherwise computed again for every element."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


# --- source text -------------------------------------------------------------------------------------


def without_bom(code: Column) -> Column:
    return F.regexp_replace(code, "^\\uFEFF", "")


def mixes_tabs(line: Column) -> Column:
    """A tab somewhere, and a space after the leading tabs."""
    return F.contains(line, F.lit("\t")) & F.contains(F.ltrim(line, F.lit("\t")), F.lit(" "))


def untabbed(line: Column) -> Column:
    return F.when(mixes_tabs(line), F.replace(line, F.lit("\t"), F.lit(TAB))).otherwise(line)


def uncontrolled(code: Column) -> Column:
    """Control characters as spaces; tabs and line ends stay."""
    return F.regexp_replace(code, CONTROL, " ")


def even_indents(lines: Column) -> Column:
    """Lines with indents of a multiple of four. Units are the divisors of each indent from the second line on
    that go into it ten times at most; with more than one of them, the smallest is a level. Lines of white
    space only count for nothing and stay as they are."""
    units = indent_units(lines)
    level = lambda x: F.floor(_width(x) / F.array_min(units)).cast("int")
    return F.when(F.size(units) > 1, F.transform(lines, lambda x: F.when(_width(x) > 0, F.concat(F.repeat(F.lit(TAB), level(x)), _bare(x))).otherwise(x))).otherwise(lines)


def _bare(line: Column) -> Column:
    return F.regexp_replace(line, r"^\s+", "")


def _width(line: Column) -> Column:
    return F.when(_bare(line) != "", F.length(line) - F.length(_bare(line))).otherwise(0)


def indent_units(lines: Column) -> Column:
    own = F.array_distinct(F.filter(F.transform(F.slice(lines, 2, F.greatest(F.size(lines), F.lit(1))), _width), lambda w: w > 0))
    return F.array_distinct(F.flatten(F.transform(own, lambda w: F.filter(F.sequence(F.lit(1), w), lambda j: (w % j == 0) & (w / j <= 10)))))


def sanitizing(code: Column) -> Column:
    """What sanitising does to a source: struct of ``bom_removed``, ``tabs_fixed``, ``control_chars_removed``,
    ``indentation_fixed``, ``sanitized_lines`` (lines that differ in the end) and ``details`` (a line for each)."""
    whole = bound(F.split(without_bom(code), "\n"), lambda lines: bound(F.transform(lines, lambda x: uncontrolled(untabbed(x))), lambda clean: bound(
        F.struct(lines.alias("lines"), clean.alias("clean"), even_indents(clean).alias("even"), F.size(indent_units(clean)).alias("units")), lambda s: F.struct(
            code.startswith("\ufeff").alias("bom"), F.size(F.filter(s["lines"], mixes_tabs)).alias("tabs"), F.size(F.filter(s["lines"], lambda x: x.rlike(CONTROL))).alias("control"),
            F.when(s["units"] > 1, F.size(F.filter(F.arrays_zip(s["clean"], s["even"]), lambda z: z["clean"] != z["even"]))).otherwise(0).alias("indents"),
            F.size(F.filter(F.arrays_zip(s["lines"], s["even"]), lambda z: z["lines"] != z["even"])).alias("changed")))))
    told = lambda n, what: F.when(n > 0, F.concat(n.cast("string"), F.lit(f" lines: {what}")))
    return bound(whole, lambda s: F.struct(
        s["bom"].alias("bom_removed"), (s["tabs"] > 0).alias("tabs_fixed"), (s["control"] > 0).alias("control_chars_removed"), (s["indents"] > 0).alias("indentation_fixed"), s["changed"].alias("sanitized_lines"),
        F.array_compact(F.array(F.when(s["bom"], "byte order mark"), told(s["tabs"], "tabs"), told(s["control"], "control characters"), told(s["indents"], "indents"))).alias("details"),
    ))


def snippet(code: Column, line: Column) -> Column:
    """The given line (from 1) and two on either side, numbered, the line itself marked; null without a line."""
    lines = F.split(code, "\n")
    first, last = F.greatest(F.lit(1), line - 2), F.least(F.size(lines), line + 2)
    mark = lambda n: F.concat(F.when(n == line, F.lit(">>> ")).otherwise(F.lit(TAB)), n.cast("string"), F.lit(": "), F.get(lines, n - 1))
    return F.when(line.isNotNull() & (first <= last), F.array_join(F.transform(F.sequence(first, last), mark), "\n"))


def utf8_valid(content: Column) -> Column:
    """Whether bytes, or a string, are valid UTF-8 as a whole."""
    return F.is_valid_utf8(content.cast("string"))


# --- files -------------------------------------------------------------------------------------------


def is_python(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"^.+(\.[^.]+)$", 1)) == ".py"


def enters(path: Column, excluded: list[str]) -> Column:
    """Whether no folder of a relative path is hidden or excluded; the last segment is the file."""
    folders = F.slice(F.split(path, "/"), 1, F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0)))
    return ~F.exists(folders, lambda x: x.startswith(".") | x.isin(excluded))


def budget_bytes(path: Column, size: Column) -> Column:
    """What a crawl is thought to need for a file: 10240 stands for an unknown size."""
    return F.length(path) * 2 + 100 + F.coalesce(size * 2, F.lit(10240))


# --- elements ----------------------------------------------------------------------------------------


def element_id(module: Column, name: Column) -> Column:
    return F.concat(F.coalesce(module, F.lit("None")), F.lit("."), name)


def kind(parent: Column, decorators: Column, name: Column) -> Column:
    has = lambda d: F.array_contains(decorators, d)
    inner = F.when(name == "__init__", "CONSTRUCTOR").when(has("staticmethod"), "STATICMETHOD").when(has("classmethod"), "CLASSMETHOD").when(has("property"), "PROPERTY").otherwise("METHOD")
    return F.when(parent.isNull(), "FUNCTION").otherwise(inner)


def class_kind(bases: Column, decorators: Column) -> Column:
    """What a class is, by its decorators and the last part of its bases' names."""
    last = F.transform(bases, lambda b: F.substring_index(b, ".", -1))
    has = lambda *names: F.arrays_overlap(last, F.array(*map(F.lit, names)))
    marked = F.exists(decorators, lambda d: F.regexp_extract(d, r"^(?:.*\.)?(\w+)(?:\(.*)?$", 1) == "dataclass")
    return (
        F.when(marked, "DATACLASS").when(has("Enum", "IntEnum", "StrEnum", "Flag", "IntFlag"), "ENUM").when(has("NamedTuple"), "NAMEDTUPLE")
        .when(F.exists(last, lambda b: b.isin("BaseException", "Exception") | b.endswith("Error")), "EXCEPTION").otherwise("CLASS")
    )


def required(parameters: Column) -> Column:
    return F.size(F.filter(parameters, lambda p: p["default_value"].isNull() & ~p["is_variadic"]))


def variadic(parameters: Column) -> Column:
    return F.exists(parameters, lambda p: p["is_variadic"])


def location(path: Column, first: Column, last: Column, first_column: Column, last_column: Column) -> Column:
    full = F.concat(path, F.lit(":"), first, F.lit(":"), first_column, F.lit("-"), last, F.lit(":"), last_column)
    return F.when(first_column.isNotNull() & last_column.isNotNull(), full).otherwise(F.concat(path, F.lit(":"), first, F.lit("-"), last))


def _words(*parts: Column) -> Column:
    none = F.array().cast("array<string>")
    return F.array_distinct(F.filter(F.concat(*(F.coalesce(p, none) for p in parts)), lambda x: x.isNotNull()))


def _lower(strings: Column) -> Column:
    return F.transform(strings, F.lower)


def base_tokens(name: Column, docstring: Column, module: Column) -> Column:
    """The name; words of the docstring longer than two, punctuation kept; parts of the module path."""
    words = F.filter(F.split(F.lower(docstring), r"\s+"), lambda x: F.length(x) > 2)
    parts = F.when(module != "", F.split(F.lower(module), r"\."))
    return _words(F.array(F.lower(name)), words, parts)


def function_tokens(base: Column, parameters: Column, returns: Column, decorators: Column) -> Column:
    some = lambda x: F.filter(x, lambda y: y.isNotNull() & (y != ""))
    return _words(base, F.transform(parameters, lambda p: F.lower(p["name"])), some(F.transform(parameters, lambda p: F.lower(p["type_annotation"]))), some(F.array(F.lower(returns))), _lower(decorators))


def class_tokens(base: Column, bases: Column, methods: Column, attributes: Column) -> Column:
    return _words(base, _lower(bases), _lower(methods), _lower(F.map_keys(attributes)), F.filter(_lower(F.map_values(attributes)), lambda x: x != ""))


def import_tokens(base: Column, source: Column, names: Column, aliases: Column) -> Column:
    return _words(base, F.split(F.lower(source), r"\."), _lower(names), _lower(F.map_values(aliases)))


def search_tokens() -> Column:
    """The tokens of a row of ``elements``, by its type."""
    base = base_tokens(F.col("name"), F.col("docstring"), F.col("module_path"))
    return (
        F.when(F.col("element_type").isin("FUNCTION", "METHOD"), function_tokens(base, F.col("signature.parameters"), F.col("signature.return_type"), F.col("decorators")))
        .when(F.col("element_type") == "CLASS", class_tokens(base, F.col("bases"), F.col("methods"), F.col("attributes")))
        .when(F.col("element_type") == "IMPORT", import_tokens(base, F.col("source_module"), F.col("import_names"), F.col("import_aliases")))
        .otherwise(base)
    )


def flat_function_json() -> Column:
    """A function or method as JSON with its parameters at the top; what kind of method it is appears in methods only."""
    c = F.col
    common = [c("name"), c("element_type").alias("type"), c("file_path"), F.array("line_start", "line_end").alias("line_range"), c("docstring"), c("decorators"), c("module_path")]
    own = [F.transform("signature.parameters", lambda p: p["name"]).alias("parameters"), c("signature.return_type").alias("return_type"), c("signature.is_async").alias("is_async")]
    of_method = [(c("element_kind") == k).alias(f"is_{name}") for k, name in (("STATICMETHOD", "static"), ("CLASSMETHOD", "class_method"), ("PROPERTY", "property"))]
    written = lambda *columns: F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
    return F.when(c("element_type") == "METHOD", written(*common, *own, *of_method)).when(c("element_type") == "FUNCTION", written(*common, *own))


def element_json(links: bool = False) -> Column:
    """A row of ``elements`` as JSON, with the keys of its type. Nulls stay, but ``parent`` appears only if set. Calls and
    overrides are those of ``links.with_links`` if ``links``, and empty otherwise."""
    c = F.col
    common = [c("name"), c("element_type").alias("type"), c("file_path"), F.array("line_start", "line_end").alias("line_range"), c("docstring"), c("decorators"), c("module_path")]
    kinds = c("element_kind")
    parameter = lambda p: F.struct(p["name"].alias("name"), p["type_annotation"].alias("type"), p["default_value"].alias("default"), *(p[x].alias(x) for x in ("is_keyword_only", "is_positional_only", "is_variadic", "description")))
    signature = F.struct(F.transform("signature.parameters", parameter).alias("parameters"), *(c(f"signature.{x}").alias(x) for x in ("return_type", "is_async", "is_generator", "is_abstract")))
    nothing = F.array().cast("array<string>")
    over = [c(x) if links else F.lit(False).alias(x) for x in ("is_overridden", "is_override")]
    calls = [c(x) if links else nothing.alias(x) for x in ("calls", "called_by")]
    function = [
        signature.alias("signature"), (c("element_type") == "METHOD").alias("is_method"), (kinds == "STATICMETHOD").alias("is_static"), (kinds == "CLASSMETHOD").alias("is_class_method"),
        (kinds == "PROPERTY").alias("is_property"), (kinds == "CONSTRUCTOR").alias("is_constructor"), *over, *calls,
    ]
    of_class = [c("bases"), c("methods"), c("attributes")]
    of_import = [c("source_module").alias("source"), c("import_names").alias("imports"), c("import_aliases").alias("aliases"), c("is_from_import")]
    parent = F.when(c("parent_name").isNotNull() & (c("parent_name") != ""), F.to_json(F.struct(c("parent_name").alias("parent"))))

    def written(columns: list[Column]) -> Column:
        text = F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
        return F.when(parent.isNull(), text).otherwise(F.concat(F.substring(text, F.lit(1), F.length(text) - 1), F.lit(","), F.substring(parent, F.lit(2), F.length(parent))))

    return (
        F.when(c("element_type").isin("FUNCTION", "METHOD"), written(common + function))
        .when(c("element_type") == "CLASS", written(common + of_class))
        .when(c("element_type") == "IMPORT", written(common + of_import))
        .otherwise(written(common))
    )
