"""Who calls whom, and which methods override which: names found while parsing, resolved by joins.

A name is looked up as Python would: in the scopes of functions around it, innermost first, then in the module, class
bodies left out. What it finds there is a definition or an import. An import leads to files: a relative one to one folder,
an absolute one to the nearest folder above the importing file that holds the module. All of these are keys of equi-joins,
a few for each name, so no step compares files or definitions with each other.

Bases of classes are names too. Their method resolution orders are merged level by level: a class is ready once all its
bases are, and each level is one join. Classes in a cycle never are, and are told.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from ..functions import columns as C
from ..shared import written

LOCALS = "<locals>"
RESOLVED = ["file_path", "qualname", "name"]


def _path(*parts: Column) -> Column:
    """Parts that aren't empty, joined by dots."""
    return F.array_join(F.filter(F.array(*parts), lambda x: x != ""), ".")


def definitions(parsed: DataFrame) -> DataFrame:
    """Every element of ``parsed``, nested ones and those that later ones hide included, with its qualified name in the
    file. What it returns is read several times, so give a ``parsed`` that is a table."""
    e = parsed.select("file_path", F.explode("elements").alias("e")).select("file_path", "e.*")
    return e.withColumns({"qualname": _path(F.col("scope"), F.col("name")), "element_id": C.element_id(F.col("module_path"), F.col("name"))})


def targets(defs: DataFrame) -> DataFrame:
    """(file_path, qualname, element_type, element_id): what a name can mean, the last of equal ones in a file."""
    own = defs.where(F.col("element_type").isin("FUNCTION", "METHOD", "CLASS"))
    last = F.max_by(F.struct("element_type", "element_id"), F.struct("line_start", "line_end")).alias("t")
    return own.groupBy("file_path", "qualname").agg(last).select("file_path", "qualname", "t.*")


def bindings(defs: DataFrame) -> DataFrame:
    """(file_path, scope, bound, module, level, member): the names that imports bind. ``level`` counts the dots of a relative
    import; ``member`` is null where the module itself is bound; ``*`` is bound to every member."""
    own = defs.where("element_type = 'IMPORT'").select("file_path", "scope", "is_from_import", "source_module", "import_aliases", F.explode("import_names").alias("name"))
    alias = F.get(F.filter("import_aliases", lambda p: p["key"] == F.col("name")), F.lit(0))["value"]
    level = F.when(F.col("is_from_import"), F.length(F.regexp_extract("source_module", r"^\.*", 0))).otherwise(0)
    return own.select(
        "file_path", "scope", F.coalesce(alias, F.col("name")).alias("bound"), F.regexp_replace("source_module", r"^\.+", "").alias("module"),
        level.alias("level"), F.when(F.col("is_from_import"), F.col("name")).alias("member"),
    ).distinct()


def scopes(of: Column, inside: Column) -> Column:
    """The scopes in which a name is looked up, innermost first: ``of`` is a qualified name, and its own names count if
    it is a function (``inside``)."""
    parts = F.split(F.when(inside, F.concat(of, F.lit(f".{LOCALS}"))).otherwise(of), r"\.")
    ends = F.filter(F.reverse(F.sequence(F.lit(1), F.size(parts))), lambda i: F.get(parts, i - 1) == LOCALS)
    return F.concat(F.transform(ends, lambda i: F.array_join(F.slice(parts, F.lit(1), i), ".")), F.array(F.lit("")))


def _folders(file: Column) -> Column:
    """The folders above a file, the nearest first, each with its slash."""
    parts = F.split(file, "/")
    return F.transform(F.reverse(F.sequence(F.lit(0), F.size(parts) - 1)), lambda n: F.when(n == 0, "").otherwise(F.concat(F.array_join(F.slice(parts, F.lit(1), n), "/"), F.lit("/"))))


def resolve(sites: DataFrame, known: DataFrame, bound: DataFrame, more: DataFrame | None = None) -> DataFrame:
    """(file_path, qualname, name, target_file, target, target_type, target_id) for each of ``sites`` (file_path, qualname,
    name; distinct; ``scopes``); target columns are null where nothing is found. ``more`` gives further keys (those columns,
    key_file, key, rank)."""
    first = [*RESOLVED, F.posexplode("scopes").alias("depth", "scope")]
    looked = sites.select(*first)
    nothing = F.lit(0)
    keys = looked.select(*RESOLVED, F.col("file_path").alias("key_file"), _path(F.col("scope"), F.col("name")).alias("key"), F.struct(F.col("depth").alias("a"), nothing.alias("b"), nothing.alias("c")).alias("rank"))
    # Of a dotted name any prefix may be what an import binds; a star binds the first part.
    parts = F.split("name", r"\.")
    prefix = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.struct(F.array_join(F.slice(parts, F.lit(1), n), ".").alias("bound"), F.array_join(F.slice(parts, n + 1, F.size(parts)), ".").alias("rest")))
    prefix = F.concat(prefix, F.array(F.struct(F.lit("*").alias("bound"), F.col("name").alias("rest"))))
    by_import = looked.withColumn("p", F.explode(prefix)).select(*RESOLVED, "depth", "scope", "p.*").join(bound, ["file_path", "scope", "bound"])
    above = _folders(F.col("file_path"))
    places = F.when(F.col("level") == 0, above).otherwise(F.slice(above, F.greatest(F.col("level"), F.lit(1)), F.lit(1)))
    by_import = by_import.select(*RESOLVED, "depth", "module", "member", "rest", F.posexplode(places).alias("away", "folder"))
    star = F.col("member") == "*"
    inner = F.when(F.col("member").isNull() | star, F.col("rest")).otherwise(_path(F.col("member"), F.col("rest")))
    module = F.replace("module", F.lit("."), F.lit("/"))
    sub = F.array_join(F.filter(F.array(module, F.col("member")), lambda x: x != ""), "/")
    place = lambda m, end: F.concat("folder", m, F.lit(end))
    found = [F.struct(place(module, ".py").alias("key_file"), inner.alias("key"), F.lit(1).alias("b")), F.struct(F.concat("folder", F.when(module == "", "").otherwise(F.concat(module, F.lit("/"))), F.lit("__init__.py")).alias("key_file"), inner.alias("key"), F.lit(2).alias("b"))]
    found += [F.when(F.col("member").isNotNull() & ~star, F.struct(place(sub, end).alias("key_file"), F.col("rest").alias("key"), F.lit(k).alias("b"))) for k, end in ((3, ".py"), (4, "/__init__.py"))]
    imported = by_import.select(*RESOLVED, "depth", "away", F.explode(F.array(*found)).alias("k")).where("k IS NOT NULL AND k.key <> ''")
    keys = keys.unionByName(imported.select(*RESOLVED, "k.key_file", "k.key", F.struct(F.col("depth").alias("a"), (F.col("away") + 1).alias("b"), F.col("k.b").alias("c")).alias("rank")))
    if more is not None:
        keys = keys.unionByName(more.select(*RESOLVED, "key_file", "key", F.struct(F.lit(-1).alias("a"), F.col("rank").cast("int").alias("b"), nothing.alias("c")).alias("rank")))
    own = known.select(F.col("file_path").alias("key_file"), F.col("qualname").alias("key"), F.struct(F.col("file_path").alias("target_file"), F.col("qualname").alias("target"), F.col("element_type").alias("target_type"), F.col("element_id").alias("target_id")).alias("t"))
    best = keys.join(own, ["key_file", "key"]).groupBy(*RESOLVED).agg(F.min_by("t", "rank").alias("t"))
    return sites.drop("scopes").join(best, RESOLVED, "left").select(*[c for c in sites.columns if c != "scopes"], "t.target_file", "t.target", "t.target_type", "t.target_id")


# --- classes -----------------------------------------------------------------------------------------


def class_bases(defs: DataFrame, known: DataFrame | None = None, bound: DataFrame | None = None) -> DataFrame:
    """(file_path, qualname, at, base, base_file, base_class): the bases of each class in order; the last two are null for
    classes that no file defines."""
    own = defs.where("element_type = 'CLASS'").groupBy("file_path", "qualname").agg(F.max_by("bases", "line_start").alias("bases"))
    each = own.select("file_path", "qualname", F.posexplode("bases").alias("at", "base")).withColumn("name", F.regexp_replace("base", r"\[.*$", ""))
    sites = each.select(*RESOLVED).distinct().withColumn("scopes", scopes(F.col("qualname"), F.lit(False)))
    known = targets(defs) if known is None else known
    found = resolve(sites, known.where("element_type = 'CLASS'"), bindings(defs) if bound is None else bound)
    return each.join(found, RESOLVED).select("file_path", "qualname", "at", "base", F.col("target_file").alias("base_file"), F.col("target").alias("base_class"))


def merge(lists: list[list[str]]) -> list[str] | None:
    """The C3 merge of the orders of the bases and the list of bases; null if they contradict each other."""
    todo, out = [list(x) for x in lists if len(x)], []
    while todo:
        tails = {y for x in todo for y in x[1:]}
        head = next((x[0] for x in todo if x[0] not in tails), None)
        if head is None:
            return None
        out.append(head)
        todo = [rest for x in todo if (rest := x[1:] if x[0] == head else x)]
    return out


@F.pandas_udf(ArrayType(StringType()))
def _merged(orders: pd.Series, bases: pd.Series) -> pd.Series:
    return pd.Series([merge([*o, b]) for o, b in zip(orders, bases)], dtype=object)


def _class(file: str, name: str) -> Column:
    return F.concat(file, F.lit("::"), name)


def resolution_orders(defs: DataFrame, bases: DataFrame) -> DataFrame:
    """(class, order, problem): the method resolution order of each class, itself first. Classes are named
    ``file::qualname``, and bases that no file defines by their text behind a question mark. ``problem``: null, ``conflict``
    where C3 has no order, ``cycle`` where bases lead back, or ``base`` where one of the bases has a problem.

    There are as many rounds as levels of inheritance; each writes its classes, and reads only what the round before settled
    and the bases. A class with one base is ready when that is; only those with several wait for the others.
    """
    classes = defs.where("element_type = 'CLASS'").select(_class("file_path", "qualname").alias("class")).distinct()
    named = bases.select(_class("file_path", "qualname").alias("class"), "at", F.when(F.col("base_class").isNull(), F.concat(F.lit("?"), "base")).otherwise(_class("base_file", "base_class")).alias("base"), F.col("base_class").isNull().alias("outer"))
    each = written(named.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("class"))), "bases")
    no = F.lit(None).cast("string")
    done = classes.join(each, "class", "left_anti").select("class", F.array("class").alias("order"), no.alias("problem"))
    inner = each.where("NOT outer").drop("outer")
    met = each.where("outer").select("class", "at", "base", "n", F.array("base").alias("order"), no.alias("problem"))
    single = F.concat(F.array("class"), "order").alias("order")
    latest = written(done.unionByName(met.where("n = 1").select("class", single, "problem")), "orders")
    parts, met = [latest], met.where("n > 1")
    several = not each.where("n > 1").isEmpty()
    while True:
        # Only what the last round settled can make further classes ready.
        fresh = inner.join(latest.select(F.col("class").alias("base"), "order", "problem"), "base").select("class", "at", "base", "n", "order", "problem")
        ready = fresh.where("n = 1").select("class", single, F.when(F.col("problem").isNotNull(), "base").alias("problem"))  # a null order stays null
        if several:
            groups = met.unionByName(fresh.where("n > 1")).groupBy("class", "n").agg(F.array_sort(F.collect_list(F.struct("at", "base", "order", "problem"))).alias("all"))
            groups = written(groups.withColumn("bad", F.exists("all", lambda x: x["problem"].isNotNull())), "met")
            met = groups.where("size(all) < n").select("class", "n", F.explode("all").alias("x")).select("class", "x.at", "x.base", "n", "x.order", "x.problem")
            whole = groups.where("size(all) = n")
            merged = _merged(F.transform("all", lambda x: x["order"]), F.transform("all", lambda x: x["base"]))
            sound = whole.where("NOT bad").select("class", merged.alias("m")).select("class", F.concat(F.array("class"), "m").alias("order"), F.when(F.col("m").isNull(), "conflict").alias("problem"))
            broken = whole.where("bad").select("class", F.lit(None).cast("array<string>").alias("order"), F.lit("base").alias("problem"))
            ready = ready.unionByName(sound).unionByName(broken)
        latest = written(ready, "orders")
        if latest.isEmpty():
            break
        parts.append(latest)
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    waiting = written(each.select("class").distinct().join(found.select("class"), "class", "left_anti"), "waiting")
    return found if waiting.isEmpty() else found.unionByName(_stuck(each, waiting))


def _stuck(each: DataFrame, waiting: DataFrame) -> DataFrame:
    """Classes that were never ready: those that no waiting class derives from are peeled off until only cycles, and what
    lies between them, are left."""
    edges = written(each.join(waiting, "class", "left_semi").join(waiting.select(F.col("class").alias("base")), "base", "left_semi").select("class", "base"), "edges")
    core = edges
    while True:
        less = written(core.join(core.select(F.col("base").alias("class")).distinct(), "class", "left_semi"), "edges")
        if less.count() == core.count():
            break
        core = less
    cyclic = core.select("class").distinct().withColumn("problem", F.lit("cycle"))
    return waiting.select("class").join(cyclic, "class", "left").select("class", F.lit(None).cast("array<string>").alias("order"), F.coalesce("problem", F.lit("base")).alias("problem"))


def lineage(orders: DataFrame, *more: str) -> DataFrame:
    """(class, at, ancestor), at from 1: what each class inherits from, the nearest first; with ``more`` columns."""
    return orders.select("class", *more, F.posexplode("order").alias("at", "ancestor")).where("at > 0")


def _met(orders: DataFrame, wanted: DataFrame, members: DataFrame) -> DataFrame:
    """(class, at, ancestor, names): those of a class's ``wanted`` names (class, name) that an ancestor has among its
    ``members`` (class, name), for all that has any. A class and an ancestor meet once, whatever the number of names."""
    want = wanted.groupBy("class").agg(F.collect_set("name").alias("wanted"))
    have = members.groupBy(F.col("class").alias("ancestor")).agg(F.collect_set("name").alias("have"))
    up = lineage(orders.join(want, "class"), "wanted").join(have, "ancestor")
    return up.select("class", "at", "ancestor", F.array_intersect("wanted", "have").alias("names")).where(F.size("names") > 0)


def _members(known: DataFrame) -> DataFrame:
    """(class, name) of targets that stand in something; what is no class is nobody's ancestor."""
    name = F.substring_index("qualname", ".", -1)
    return known.where(F.contains("qualname", F.lit("."))).select(_class("file_path", F.substring("qualname", F.lit(1), F.length("qualname") - F.length(name) - 1)).alias("class"), name.alias("name"))


def overrides(known: DataFrame, orders: DataFrame) -> DataFrame:
    """(file_path, qualname, is_override, is_overridden) of every method. ``known``: targets."""
    own = known.where("element_type = 'METHOD'")
    name = F.substring_index("qualname", ".", -1)
    methods = own.select("file_path", "qualname", _class("file_path", F.substring("qualname", F.lit(1), F.length("qualname") - F.length(name) - 1)).alias("class"), name.alias("name"))
    pairs = methods.select("class", "name")
    both = _met(orders, pairs, pairs).select("class", "ancestor", F.explode("names").alias("name"))
    ends = F.explode(F.array(*(F.struct(F.col(c).alias("class"), F.lit(c == "class").alias("over"), F.lit(c != "class").alias("under")) for c in ("class", "ancestor")))).alias("x")
    flags = both.select("name", ends).groupBy("x.class", "name").agg(F.max("x.over").alias("is_override"), F.max("x.under").alias("is_overridden"))
    flagged = methods.join(flags, ["class", "name"], "left")
    return flagged.select("file_path", "qualname", *(F.coalesce(c, F.lit(False)).alias(c) for c in ("is_override", "is_overridden")))


# --- calls -------------------------------------------------------------------------------------------


def call_graph(defs: DataFrame, orders: DataFrame | None = None) -> DataFrame:
    """(file_path, qualname, element_id, name, line, times, target_file, target, target_type, target_id): every name that
    an element calls, with the first line, how often, and what it is; targets are null for names that no file defines.
    With ``orders``, methods called on ``self``, ``cls`` or ``super()`` are looked up along the bases too."""
    known, bound = targets(defs), bindings(defs)
    each = defs.select("file_path", "qualname", "element_id", "element_type", "scope", F.explode("calls").alias("c"))
    sites = each.groupBy("file_path", "qualname", F.col("c.name").alias("name")).agg(F.min("c.line").alias("line"), F.count(F.lit(1)).alias("times"), F.first("element_id").alias("element_id"), F.first("element_type").alias("element_type"), F.first("scope").alias("scope"))
    sites = written(sites, "sites")
    inside = F.col("element_type").isin("FUNCTION", "METHOD")
    bare = F.when(F.col("element_type") == "MODULE", "").otherwise(F.col("qualname"))
    own = sites.where((F.col("element_type") == "METHOD") & F.col("name").rlike(r"^(self|cls|super\(\))\.[^.]+$"))
    own = own.select(*RESOLVED, "scope", F.substring_index("name", ".", -1).alias("member"), F.col("name").startswith("super").alias("above"))
    more = own.where("NOT above").select(*RESOLVED, F.col("file_path").alias("key_file"), F.concat("scope", F.lit("."), "member").alias("key"), F.lit(0).alias("rank"))
    if orders is not None:
        up = own.withColumn("class", _class("file_path", "scope"))
        near = _met(orders, up.select("class", F.col("member").alias("name")), _members(known)).select("class", "at", "ancestor", F.explode("names").alias("member"))
        near = near.groupBy("class", "member").agg(F.min(F.struct("at", "ancestor")).alias("x"))  # what lies behind the nearest is never looked at
        holder = F.substring_index("ancestor", "::", -1)
        up = up.join(near, ["class", "member"]).select(*RESOLVED, "member", "x.at", "x.ancestor")
        more = more.unionByName(up.select(*RESOLVED, F.substring("ancestor", F.lit(1), F.length("ancestor") - F.length(holder) - 2).alias("key_file"), F.concat(holder, F.lit("."), "member").alias("key"), F.col("at").alias("rank")))
    found = resolve(sites.select(*RESOLVED, scopes(bare, inside).alias("scopes")), known, bound, more)
    return sites.drop("element_type", "scope").join(found, RESOLVED).select("file_path", "qualname", "element_id", "name", "line", "times", "target_file", "target", "target_type", "target_id")


def unresolved(graph: DataFrame) -> DataFrame:
    """(name, callers, times): the called names that nothing was found for."""
    return graph.where("target IS NULL").groupBy("name").agg(F.count(F.lit(1)).alias("callers"), F.sum("times").alias("times"))


def with_links(elements: DataFrame, graph: DataFrame, flags: DataFrame) -> DataFrame:
    """``elements`` (rows of ``definitions``, or of ``parse.elements`` with scope) with the arrays ``calls`` and ``called_by``
    of ids and the two flags, as their JSON has them. An id that very many call has as long an array: ask for this on rows
    that are shown, and use the tables otherwise."""
    named = elements.withColumn("qualname", _path(F.col("scope"), F.col("name")))
    known = graph.where("target IS NOT NULL")
    calls = known.groupBy("file_path", "qualname").agg(F.sort_array(F.collect_set("target_id")).alias("calls"))
    called = known.groupBy(F.col("target_file").alias("file_path"), F.col("target").alias("qualname")).agg(F.sort_array(F.collect_set("element_id")).alias("called_by"))
    key, none = ["file_path", "qualname"], F.array().cast("array<string>")
    joined = named.drop("calls", "called_by").join(calls, key, "left").join(called, key, "left").join(flags, key, "left")
    filled = {c: F.coalesce(c, none) for c in ("calls", "called_by")} | {c: F.coalesce(c, F.lit(False)) for c in ("is_override", "is_overridden")}
    return joined.withColumns(filled)
