"""The index over elements: duplicate rules, maps, postings, counts, lookups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shared import written


def first_wins(elements: DataFrame) -> DataFrame:
    """One row for each element_id, the first by seq."""
    columns = elements.columns
    return elements.groupBy("element_id").agg(F.min_by(F.struct(*columns), "seq").alias("_e")).select("_e.*").select(*columns)


def second_wins(elements: DataFrame) -> DataFrame:
    """The duplicate rule of an index that holds references first: the second row replaces the first, later
    ones are ignored. Only the two lowest seq of an id are kept while counting."""
    columns = elements.columns
    two = Window.partitionBy("element_id").orderBy("seq")
    kept = elements.withColumn("_rn", F.row_number().over(two)).where("_rn <= 2")  # Spark limits the groups before the shuffle
    return kept.groupBy("element_id").agg(F.max_by(F.struct(*columns), "seq").alias("_e")).select("_e.*").select(*columns)


def last_by_name(elements: DataFrame) -> DataFrame:
    """(name, seq): the last row of each bare name, over all files."""
    return elements.groupBy("name").agg(F.max("seq").alias("seq"))


def stats(elements: DataFrame) -> DataFrame:
    """(total_elements, files): distinct ids, and distinct files."""
    count = lambda c: elements.select(c).distinct().agg(F.count(c).alias("n"))
    both = count("element_id").select(F.col("n").alias("a"), F.lit(None).cast("long").alias("b")).union(count("file_path").select(F.lit(None).cast("long"), "n"))
    return both.agg(F.max("a").alias("total_elements"), F.max("b").alias("files"))


def ids_by(elements: DataFrame, key: str) -> DataFrame:
    """(key, element_ids): module, file and parent index; empty and null keys have no entry."""
    return elements.where((F.col(key).isNotNull()) & (F.col(key) != "")).groupBy(key).agg(F.sort_array(F.collect_set("element_id")).alias("element_ids"))


def count_by(elements: DataFrame, key: str, name: str) -> DataFrame:
    return elements.where(F.col(key).isNotNull() & (F.col(key) != "")).groupBy(key).agg(F.countDistinct("element_id").alias(name))


def class_map(elements: DataFrame) -> DataFrame:
    """(name, element_id): the last class of each name."""
    return elements.where("element_type = 'CLASS'").groupBy("name").agg(F.max_by("element_id", "seq").alias("element_id"))


def function_map(elements: DataFrame) -> DataFrame:
    """(name, element_id, element_type): the last function or method of each name; they share one map."""
    winner = F.max_by(F.struct("element_id", "element_type"), "seq").alias("_w")
    return elements.where("element_type IN ('FUNCTION', 'METHOD')").groupBy("name").agg(winner).select("name", "_w.*")


def method_map(elements: DataFrame) -> DataFrame:
    """(parent_id, name, element_id): the last method of each name in each class."""
    return elements.where("element_type = 'METHOD' AND parent_id IS NOT NULL").groupBy("parent_id", "name").agg(F.max_by("element_id", "seq").alias("element_id"))


def modules(elements: DataFrame) -> DataFrame:
    """(module_path, imports, classes, functions, is_package): what each module holds, names sorted."""
    names = lambda *types: F.sort_array(F.collect_set(F.when(F.col("element_type").isin(*types), F.col("name"))))
    package = F.max(F.substring_index("file_path", "/", -1) == "__init__.py")
    return elements.groupBy("module_path").agg(names("IMPORT").alias("imports"), names("CLASS").alias("classes"), names("FUNCTION").alias("functions"), package.alias("is_package"))


def postings(elements: DataFrame, tokens: str = "search_tokens") -> DataFrame:
    """(token, element_id), distinct, tokens longer than two only."""
    return elements.select("element_id", F.explode(F.array_distinct(tokens)).alias("token")).where(F.length("token") > 2).select("token", "element_id").distinct()


def token_counts(postings_: DataFrame) -> DataFrame:
    return postings_.groupBy("token").agg(F.countDistinct("element_id").alias("n"))


def references(elements: DataFrame) -> DataFrame:
    return elements.select("element_id", "element_type", "name", "module_path", "file_path")


def get_element(elements: DataFrame, element_id: str) -> DataFrame:
    return first_wins(elements.where(F.col("element_id") == element_id))


def get_by_name(elements: DataFrame, name: str | None = None, element_type: str | None = None) -> DataFrame:
    """(name, element_id, element_type, rank): what a name means, for one name or for all. The type is tested
    after the winner is chosen, so a later method hides a function. Types without a map find nothing;
    without a type the class comes first."""
    own = elements if name is None else elements.where(F.col("name") == name)
    classes = class_map(own).select("name", "element_id", F.lit("CLASS").alias("element_type"), F.lit(0).alias("rank"))
    functions = function_map(own).select("name", "element_id", "element_type", F.lit(1).alias("rank"))
    both = classes.union(functions)
    return both if element_type is None else both.where(F.col("element_type") == element_type)


def children(elements: DataFrame, element_id: str) -> DataFrame:
    return first_wins(elements.where(F.col("parent_id") == element_id))


def ancestors(edges: DataFrame) -> DataFrame:
    """(node, ancestor, depth): what lies above each node at any depth, for ``edges`` (node, parent), with the least depth.
    Paths double in each round, so there are about as many joins as the depth has binary digits. A node in a cycle has
    itself as an ancestor."""
    paths = written(edges.where("node IS NOT NULL AND parent IS NOT NULL").select("node", F.col("parent").alias("ancestor"), F.lit(1).cast("long").alias("depth")).distinct(), "reach")
    found, reach = [paths], 1  # tables of paths, and the depth that all of them together have
    while True:
        # What goes on from a path of full depth is new unless a shorter way was found; nothing found is written again.
        known = reduce(DataFrame.unionByName, found)
        last = known.where(F.col("depth") == reach).select("node", F.col("ancestor").alias("via"))
        up = known.select(F.col("node").alias("via"), "ancestor", (F.col("depth") + reach).alias("depth"))
        longer = last.join(up, "via").groupBy("node", "ancestor").agg(F.min("depth").alias("depth"))
        fresh = written(longer.join(known.select("node", "ancestor"), ["node", "ancestor"], "left_anti"), "reach")
        if fresh.isEmpty():
            return known
        found.append(fresh)
        reach *= 2


def descendants(elements: DataFrame, element_id: str) -> DataFrame:
    """The elements at any depth below one, with their least depth; ``children`` gives the first level only."""
    below = ancestors(elements.select(F.col("element_id").alias("node"), F.col("parent_id").alias("parent")).distinct()).where(F.col("ancestor") == element_id)
    return first_wins(elements).join(below.select(F.col("node").alias("element_id"), "depth"), "element_id")


def in_file(elements: DataFrame, path: str) -> DataFrame:
    return first_wins(elements.where(F.col("file_path") == path))


def in_module(elements: DataFrame, module: str) -> DataFrame:
    return first_wins(elements.where(F.col("module_path") == module))

