import pytest
from pyspark.sql import functions as F

from corpusloom.functions import columns as C
from corpusloom.functions import pysource
from corpusloom.operators import parse

SOURCE = b'''"""mod doc"""
import os
@deco
def top(a, b=1):
    """Doc."""
    def inner():
        pass
class C(Base):
    def run(self):
        pass
    async def run(self):
        pass
if True:
    def cond(): pass
'''


def table(spark, *contents, path="src/mod.py"):
    return spark.createDataFrame([(path if len(contents) == 1 else f"src/m{k}.py", bytearray(c)) for k, c in enumerate(contents)], "path string, content binary")


def test_elements(spark):
    parsed = parse.parse_files(table(spark, SOURCE))
    got = {(r.name, r.element_type): r for r in parse.elements(parsed).collect()}
    spans = {k: (r.line_start, r.line_end) for k, r in got.items()}
    assert spans == {("mod", "MODULE"): (1, 14), ("os", "IMPORT"): (2, 2), ("top", "FUNCTION"): (4, 7), ("C", "CLASS"): (8, 12), ("run", "METHOD"): (11, 12), ("cond", "FUNCTION"): (14, 14)}
    top, cls, run = got["top", "FUNCTION"], got["C", "CLASS"], got["run", "METHOD"]
    assert top.decorators == ["deco"] and top.docstring == "Doc." and top.element_id == "mod.top"
    assert [(p.name, p.default_value) for p in top.signature.parameters] == [("a", None), ("b", "1")]
    assert cls.bases == ["Base"] and cls.methods == ["run"] and run.parent_id == "mod.C" and run.signature.is_async
    assert {"top", "doc.", "mod", "a", "b", "deco"} == set(top.search_tokens)
    nested = {r.name: r.depth_in_functions for r in parse.elements(parsed, nested=True).collect()}
    assert nested["inner"] == 1
    counts = parse.elements(parsed).where("name = 'top'").select(C.required(F.col("signature.parameters")).alias("n"), C.variadic(F.col("signature.parameters")).alias("v")).first()
    assert (counts.n, counts.v) == (1, False)


def test_compat_view(spark):
    got = parse.compat_elements(parse.parse_files(table(spark, SOURCE))).orderBy("first_line").collect()
    assert [(r.name, r.line_start, r.line_end, r.is_async, r.docstring) for r in got] == [("top", 4, 7, False, "Doc."), ("run", 11, 12, True, None), ("cond", 14, 14, False, None)]
    assert got[0].element_id == "None.top" and {r.element_type for r in got} == {"FUNCTION"}


CASES = [
    (b"x = 1\n", None, 0, []),
    (b"x = 'caf\xe9'\n", "UnicodeDecodeError", 1, []),
    (b"x = 1\x07\ny = 2\n", "SyntaxError", 2, []),
    (b"\xef\xbb\xbfx=1\n", "SyntaxError", 2, []),
    (b"def good_func():\n    pass\n\xed\xa0\x80", "UnicodeDecodeError", 3, ["good_func"]),
    (b"def g():\n    pass\nclass B(:\n", "SyntaxError", 3, ["g", "B"]),
    (b")(\n", "SyntaxError", 4, []),
    (b"class K:\n    def a(self): pass\n    def b(self):\n        def c(): pass\ndef d(): pass\nx = (\n", "SyntaxError", 3, ["K", "a", "b", "c", "d"]),
]


def test_errors_and_fallbacks(spark):
    files = table(spark, *(c for c, *_ in CASES))
    plain = {r.file: r for r in parse.parse_errors(parse.parse_files(files)).collect()}
    chain = {r.file_path: r for r in parse.parse_files(files, fallbacks=True).collect()}
    for k, (_, error, level, salvaged) in enumerate(CASES):
        path = f"src/m{k}.py"
        assert (plain[path].error_type if path in plain else None) == error
        assert chain[path].fallback_level == level
        if level == 3:
            assert [e.name for e in chain[path].elements] == salvaged and all(e.is_mock for e in chain[path].elements)
    assert plain["src/m5.py"].line == 3 and chain["src/m6.py"].error.error_type == "MultipleFallbackFailure"
    kinds = {e.name: (e.element_type, e.parent_name, e.depth_in_functions) for e in chain["src/m7.py"].elements}
    assert kinds == {"K": ("CLASS", None, 0), "a": ("METHOD", "K", 0), "b": ("METHOD", "K", 0), "c": ("FUNCTION", None, 1), "d": ("FUNCTION", None, 0)}
    outcome = {r.path: r.parsed for r in parse.parse_outcomes(files, parse.parse_files(files)).collect()}
    assert outcome["src/m0.py"] and not outcome["src/m6.py"] and len(outcome) == len(CASES)


def test_stubs(spark):
    errors = parse.parse_errors(parse.parse_files(table(spark, b")(\n", path="pkg/__init__.py")))
    row = parse.stub_modules(errors).first()
    error = errors.first()
    made = pysource.stub("pkg/__init__.py", {"error_type": error.error_type, "message": error.message, "line": error.line, "column": error.column, "code_snippet": error.code_snippet})
    assert row.name == made["name"] == "pkg" and row.docstring == made["docstring"] and row.element_id == "stub:pkg/__init__.py"


@pytest.mark.parametrize("line, want", [(2, "    1: a\n>>> 2: b\n    3: c\n    4: d"), (6, "    4: d\n    5: e\n>>> 6: f")])
def test_snippet(spark, line, want):
    assert pysource.snippet("a\nb\nc\nd\ne\nf", line) == want
    assert spark.range(1).select(C.snippet(F.lit("a\nb\nc\nd\ne\nf"), F.lit(line)).alias("s")).first().s == want


def test_sanitizing_columns_and_helper_agree(spark):
    texts = ["﻿x=1", "\t x\n\ty", "a\x07b\n\x1fc", "if 1:\n  a\n     b\n", "\t\tno spaces\nx", "", "a\n    b"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    lines = F.transform(F.split(C.uncontrolled(C.without_bom(F.col("t"))), "\n"), C.untabbed)
    got = [r.s for r in df.select(F.array_join(C.even_indents(lines), "\n").alias("s")).collect()]
    assert got == [pysource.sanitize(t)[0] for t in texts]


def test_deep_source_is_a_row(spark):
    got = parse.parse_files(table(spark, b"x = " + b"(" * 5000 + b")" * 5000, b"ok = 1\n")).collect()
    assert [r.error is None for r in sorted(got, key=lambda r: r.file_path)] == [False, True]


def test_udtf(spark):
    parse.register_parse(spark)
    got = spark.sql("SELECT d.* FROM VALUES ('def f(): pass'), ('class C:\\n  def m(self): pass'), ('(') AS t(code), LATERAL parse_defs(code) d").collect()
    assert sorted(r.name for r in got if r.element_type in ("FUNCTION", "METHOD")) == ["f", "m"]
    assert sum(r.error_type == "SyntaxError" for r in got) == 1


@pytest.mark.parametrize(
    "parent, decorators, name, want",
    [(None, ["staticmethod"], "f", "FUNCTION"), ("C", ["staticmethod", "property"], "f", "STATICMETHOD"), ("C", ["classmethod"], "f", "CLASSMETHOD"), ("C", ["property"], "f", "PROPERTY"), ("C", ["staticmethod"], "__init__", "CONSTRUCTOR"), ("C", [], "f", "METHOD")],
)
def test_kinds(spark, parent, decorators, name, want):
    df = spark.createDataFrame([(parent, decorators, name)], "p string, d array<string>, n string")
    assert df.select(C.kind(F.col("p"), F.col("d"), F.col("n")).alias("k")).first().k == want


def test_json(spark):
    import json

    e = parse.elements(parse.parse_files(table(spark, SOURCE)))
    rows = {r.name: json.loads(r.j) for r in e.select("name", C.element_json().alias("j")).collect()}
    assert rows["run"]["parent"] == "C" and rows["run"]["is_method"] and rows["run"]["docstring"] is None
    assert "parent" not in rows["top"] and rows["top"]["line_range"] == [4, 7]
    assert rows["C"]["methods"] == ["run"] and rows["os"]["source"] == "os"


def test_blank_lines_keep_out_of_indents(spark):
    """In the helper of the parse tasks and as columns: lines of white space don't make units and stay as they are."""
    from corpusloom.functions import columns, pysource

    for lines in (["if x:", "   a", "  ", "      b", ""], ["if x:", "   a", " ", "   b"], ["x", "", "y"], ["if x:", "\ta", "\t\tb", "\t"]):
        fixed = pysource.sanitize("\n".join(lines))[0].split("\n")
        assert [f for x, f in zip(lines, fixed) if not x.strip()] == [x for x in lines if not x.strip()]
        got = spark.createDataFrame([(lines,)], "l array<string>").select(columns.even_indents(F.col("l"))).first()[0]
        assert got == fixed


def test_salvaged_constructor_has_self():
    from corpusloom.functions import pysource

    found = {e["name"]: e for e in pysource.salvage("class A:\n    def __init__(self, x):\n        pass\n    def f(self):\n        pass\nclass B(:\n", "m.py")}
    assert [p["name"] for p in found["__init__"]["signature"]["parameters"]] == ["self"] and found["f"]["signature"]["parameters"] == []


def test_first_error_of_each_file(spark):
    from corpusloom.operators import parse

    rows = [("a", "SyntaxError", "late", 9), ("a", "SyntaxError", "early", 2), ("a", "RecursionError", "none", None), ("b", "UnicodeDecodeError", "none", None)]
    got = parse.first_errors(spark.createDataFrame(rows, "file string, error_type string, message string, line int")).collect()
    assert {(r.file, r.message) for r in got} == {("a", "early"), ("b", "none")}


def test_handler_sees_every_error(spark, tmp_path):
    from corpusloom.operators import parse

    def handle(error):
        (tmp_path / error["file"]).write_text(error["message"])

    parse.for_each_error(spark.createDataFrame([("a", "one"), ("b", "two")], "file string, message string"), handle)
    assert sorted((p.name, p.read_text()) for p in tmp_path.iterdir()) == [("a", "one"), ("b", "two")]


def test_salvage_starts_again():
    """Definitions behind brackets and strings that are never closed are found, where they are and in what they are in."""
    code = (
        "def a(x:\n    y = [1,\n\ndef b():\n    pass\n\nclass C:\n    def one(self):\n        z = foo(1, {\n    def two(self):\n        def deep():\n            return ')'\n    async def three(self): pass\n"
        "def d():\n    t = \"\"\"open\n\nclass E(:\n    def four(self):\n        x = )]}\n        def five(): pass\n    def six(self): 1\n"
    )
    found = {e["name"]: (e["element_type"], e["line_start"], e["parent_name"], e["depth_in_functions"], e["scope"]) for e in pysource.salvage(code, "m.py")}
    assert found == {
        "a": ("FUNCTION", 1, None, 0, ""), "b": ("FUNCTION", 4, None, 0, ""), "C": ("CLASS", 7, None, 0, ""), "one": ("METHOD", 8, "C", 0, "C"), "two": ("METHOD", 10, "C", 0, "C"),
        "deep": ("FUNCTION", 11, None, 1, "C.two.<locals>"), "three": ("METHOD", 13, "C", 0, "C"), "d": ("FUNCTION", 14, None, 0, ""), "E": ("CLASS", 17, None, 0, ""), "four": ("METHOD", 18, "E", 0, "E"),
        "five": ("FUNCTION", 20, None, 1, "E.four.<locals>"), "six": ("METHOD", 21, "E", 0, "E"),
    }


def test_parsed_once(spark):
    """The plan of ``elements`` holds one Python step and no shuffle."""
    files = spark.createDataFrame([("a.py", b"def f(): pass\ndef f(x): pass\nclass C: pass\n")], "path string, content binary")
    e = parse.elements(parse.parse_files(files))
    plan = e._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInPandas") == 1 and "Exchange" not in plan
    assert [(r.name, r.line_start) for r in e.orderBy("name").collect()] == [("C", 3), ("a", 1), ("f", 2)]


def test_copies_of_a_deep_text_are_parsed_once(monkeypatch):
    """What is too deep takes longest to parse; its error depends on the text alone."""
    seen, own = [], pysource.ast.parse
    monkeypatch.setattr(pysource, "_FAILED", {})
    monkeypatch.setattr(pysource.ast, "parse", lambda code, *a, **k: seen.append(code) or own(code, *a, **k))
    for text in (b"x" + b".a" * 20_000, b"-" * 20_000 + b"1"):
        a, b = (pysource.parse_safely(p, text) for p in ("a.py", "b.py"))
        assert a["error"]["error_type"] in ("RecursionError", "MemoryError") and a["error"] == b["error"] and b["file_path"] == "b.py"
        assert seen.count(text.decode()) == 1
    for k in range(3 * pysource.KEPT):
        pysource.parse_safely("a.py", b"x%d" % k + b".a" * 20_000)
    assert len(pysource._FAILED) == pysource.KEPT


def test_walk_keeps_to_statements(monkeypatch):
    """A definition costs no walk over the expressions of its file; blocks of every kind are entered."""
    code = "def f():\n    return [" + "g(1), " * 200 + "]\ntry: pass\nexcept E:\n    def a(): pass\nelse:\n    def b(): pass\nfinally:\n    def c(): pass\nmatch x:\n    case 1:\n        def d(): (yield)\nwhile y:\n    def e(): pass\n"
    entered, own = [], pysource.ast.iter_child_nodes
    monkeypatch.setattr(pysource.ast, "iter_child_nodes", lambda n: entered.append(n) or own(n))
    found = pysource.parse_safely("m.py", code.encode())["elements"]
    assert [e["name"] for e in found] == ["m", "f", "a", "b", "c", "d", "e"] and found[5]["signature"]["is_generator"] and len(found[1]["calls"]) == 200
    assert len(entered) < 200


def test_small_tables_are_dealt_out(spark):
    from corpusloom.plans import queries

    for name in ("q55_parse_udtf", "q70_encodings"):
        assert "RoundRobinPartitioning" in queries.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString(), name


def test_no_search_for_cycles_while_rows_are_made(spark, monkeypatch):
    """Python's collector is off while a batch is parsed and made into Arrow, and on behind it; rows don't share what one holds."""
    import gc

    from corpusloom.functions import pysource

    row = pysource.parse_safely("a.py", b"def f(): pass\nclass A(B): x = 1\n")
    assert [len(e["bases"]) for e in row["elements"]] == [0, 0, 1] and pysource._NONE == []

    class Files:
        """Takes the place of a table, to run in this process what tasks run."""

        def select(self, *_):
            return self

        def mapInPandas(self, run, schema):
            return run

    import pandas as pd

    run = parse.parse_files(Files())
    on = [gc.isenabled() for _ in run(iter([pd.DataFrame({"path": ["a.py", None], "content": [b"x = 1\n", None]})] * 2))]
    assert on == [False, False] and gc.isenabled()


def test_wanted_fields_only(spark):
    """A parse gives the fields that are asked for, and the narrow view over them is the one over all."""
    from corpusloom.model import COMPAT_ELEMENT

    narrow, whole = parse.parse_files(table(spark, SOURCE), element=COMPAT_ELEMENT), parse.parse_files(table(spark, SOURCE))
    assert "decorators" not in narrow.schema["elements"].dataType.elementType.names
    rows = [sorted(map(repr, parse.compat_elements(p).collect())) for p in (narrow, whole)]
    assert rows[0] == rows[1] and rows[0]
