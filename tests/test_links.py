"""Calls and overrides: against Python's own classes, and by hand for names."""

import random

import pytest

from corpusloom.operators import links, parse
from corpusloom.shared import written


def defs_of(spark, files: dict[str, str]):
    rows = [(p, c.encode()) for p, c in files.items()]
    return links.definitions(written(parse.parse_files(spark.createDataFrame(rows, "path string, content binary")), "parsed"))


def orders_of(defs):
    return {r["class"]: (r.order, r.problem) for r in links.resolution_orders(defs, links.class_bases(defs)).collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_orders_and_flags_as_python_has_them(spark, seed):
    """Random hierarchies over several files, diamonds and contradictions among them, against real classes."""
    rng = random.Random(seed)
    classes, bases, methods = 24, {}, {}
    for k in range(classes):
        bases[k] = rng.sample(range(k), min(k, rng.choice([0, 1, 1, 2, 3])))
        methods[k] = rng.sample(["a", "b", "c", "d"], rng.randint(0, 3))
    files = {f"p/f{n}.py": "" for n in range(4)}
    for n in range(4):
        needed = sorted({b for k in range(n, classes, 4) for b in bases[k] if b % 4 != n})
        files[f"p/f{n}.py"] += "".join(f"from .f{b % 4} import K{b}\n" for b in needed)
    for k in range(classes):
        body = "".join(f"    def {m}(self): pass\n" for m in methods[k]) or "    pass\n"
        files[f"p/f{k % 4}.py"] += f"class K{k}({', '.join(f'K{b}' for b in bases[k])}):\n{body}"
    made, broken = {}, set()
    for k in range(classes):
        if broken & set(bases[k]):
            broken.add(k)
            continue
        try:
            made[k] = type(f"K{k}", tuple(made[b] for b in bases[k]), dict.fromkeys(methods[k]))
        except TypeError:
            broken.add(k)
    defs = defs_of(spark, files)
    name = lambda k: f"p/f{k % 4}.py::K{k}"
    got = orders_of(defs)
    assert {n for n, (order, _) in got.items() if order is None} == {name(k) for k in broken}
    assert all(got[name(k)][0] == [name(int(c.__name__[1:])) for c in made[k].__mro__[:-1]] for k in made)
    flags = {(r.qualname): (r.is_override, r.is_overridden) for r in links.overrides(links.targets(defs), links.resolution_orders(defs, links.class_bases(defs))).collect()}
    for k in range(classes):
        up = [int(c.__name__[1:]) for c in made[k].__mro__[1:-1]] if k in made else []
        for m in methods[k]:
            below = any(m in methods[j] and made[k] in made[j].__mro__[1:] for j in made) if k in made else False
            assert flags[f"K{k}.{m}"] == (any(m in methods[a] for a in up), below), (k, m)


def test_cycles_and_outside_bases(spark):
    defs = defs_of(spark, {"m.py": "class A(B): pass\nclass B(C): pass\nclass C(A): pass\nclass D(A): pass\nclass E(dict, Generic[T]): pass\nclass F(E, ValueError): pass\nclass G: pass\n"})
    got = orders_of(defs)
    assert {k[6:]: p for k, (_, p) in got.items()} == {"A": "cycle", "B": "cycle", "C": "cycle", "D": "base", "E": None, "F": None, "G": None}
    assert got["m.py::F"][0] == ["m.py::F", "m.py::E", "?dict", "?Generic[T]", "?ValueError"]
    assert orders_of(defs_of(spark, {"x.py": "y = 1\n"})) == {}


NAMES = {
    "src/app/main.py": """import os, app.tools.text as tt
import app.tools.files
from . import extra
from .tools import text
from .tools.text import clean as wash, Box
from ..shared.base import *

def clean():
    pass

def run(x):
    clean()
    wash()
    tt.clean()
    text.clean()
    app.tools.files.load()
    extra.more()
    Box()
    Box.make()
    starred()
    x.method().other()
    os.path.join()
    def clean():
        inner()
    def inner():
        clean()
        run()
    clean()

class Job(Box):
    limit = clean()
    def go(self):
        self.stop()
        self.close()
        super().close()
        clean()
    def stop(self):
        go()
    def close(self):
        pass
""",
    "src/app/extra.py": "def more(): pass\n",
    "src/app/tools/__init__.py": "",
    "src/app/tools/text.py": "def clean(): pass\nclass Box:\n    def make(): pass\n    def close(self): pass\n    def shut(self): self.close()\n",
    "src/app/tools/files.py": "def load(): pass\n",
    "src/shared/base.py": "def starred(): pass\n",
    "other/app/tools/text.py": "def clean(): pass\n",
    "other/main.py": "from app.tools.text import clean\nclean()\n",
}


def test_names(spark):
    defs = defs_of(spark, NAMES)
    graph = links.call_graph(defs, links.resolution_orders(defs, links.class_bases(defs)))
    got = {(r.file_path, r.qualname, r.name): (r.target_file, r.target) if r.target else None for r in graph.collect()}
    main, text = "src/app/main.py", "src/app/tools/text.py"
    run = "run.<locals>."
    assert {k[2]: v for k, v in got.items() if k[:2] == (main, "run")} == {
        "clean": (main, run + "clean"), "wash": (text, "clean"), "tt.clean": (text, "clean"), "text.clean": (text, "clean"), "app.tools.files.load": ("src/app/tools/files.py", "load"),
        "extra.more": ("src/app/extra.py", "more"), "Box": (text, "Box"), "Box.make": (text, "Box.make"), "starred": ("src/shared/base.py", "starred"), "?.other": None, "x.method": None, "os.path.join": None,
    }
    assert got[main, run + "clean", "inner"] == (main, run + "inner") and got[main, run + "inner", "clean"] == (main, run + "clean") and got[main, run + "inner", "run"] == (main, "run")
    assert got[main, "Job", "clean"] == (main, "clean") == got[main, "Job.go", "clean"]
    assert got[main, "Job.go", "self.stop"] == (main, "Job.stop") and got[main, "Job.go", "self.close"] == (main, "Job.close") and got[main, "Job.go", "super().close"] == (text, "Box.close")
    assert got[main, "Job.stop", "go"] is None and got[text, "Box.shut", "self.close"] == (text, "Box.close")
    assert got["other/main.py", "main", "clean"] == ("other/app/tools/text.py", "clean")
    assert {r.name: r.times for r in links.unresolved(graph).collect()} == {"?.other": 1, "x.method": 1, "os.path.join": 1, "go": 1, "super": 1}
    assert {r.qualname: r.times for r in graph.where("name = 'clean' AND file_path LIKE '%main.py'").collect()}["run"] == 2


def test_filled_arrays(spark):
    defs = defs_of(spark, {"m.py": "def a(): b(); c()\ndef b(): c()\ndef c(): pass\n"})
    empty = spark.createDataFrame([], "file_path string, qualname string, is_override boolean, is_overridden boolean")
    got = {r.name: (r.calls, r.called_by, r.is_override) for r in links.with_links(defs, links.call_graph(defs), empty).where("element_type = 'FUNCTION'").collect()}
    assert got == {"a": (["m.b", "m.c"], [], False), "b": (["m.c"], ["m.a"], False), "c": ([], ["m.a", "m.b"], False)}


def test_rounds_stay_small(spark, monkeypatch):
    """A later round of orders plans no more shuffles and broadcasts than an early one, and the nearest definition counts."""
    plans = []

    def kept(df, name="table"):
        plans.append(df._jdf.queryExecution().executedPlan().toString().count("Exchange"))
        return written(df, name)

    depth = 12
    code = "class K0:\n    def a(self): pass\n    def b(self): pass\n" + "".join(f"class K{k}(K{k - 1}):\n    def {'ab'[k % 2]}(self): super().a()\n" for k in range(1, depth))
    defs = defs_of(spark, {"x::y/m.py": code, "n.py": "class P: pass\nclass Q(P): pass\nclass R(Q, P): pass\nclass S(P, Q): pass\nclass T(S, Q): pass\n"})
    bases = links.class_bases(defs)
    monkeypatch.setattr(links, "written", kept)
    orders = written(links.resolution_orders(defs, bases), "orders")
    assert len(plans) > depth and max(plans) <= 12
    got = {r["class"]: (r.order, r.problem) for r in orders.collect()}
    assert got[f"x::y/m.py::K{depth - 1}"][0] == [f"x::y/m.py::K{k}" for k in reversed(range(depth))]
    assert got["n.py::R"] == (["n.py::R", "n.py::Q", "n.py::P"], None) and got["n.py::S"] == (None, "conflict") and got["n.py::T"] == (None, "base")
    graph = {r.qualname: r.target for r in links.call_graph(defs, orders).where("name = 'super().a'").collect()}
    assert graph == {f"K{k}.{'ab'[k % 2]}": f"K{(k - 1) // 2 * 2}.a" for k in range(1, depth)}
