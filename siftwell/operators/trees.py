"""Operators over a category tree held as (id, parent_id, ...): all of them start from its closure."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.stored import stored

#: A category has at most so many levels.
LEVELS = 5


def closure(nodes: DataFrame, levels: int = LEVELS) -> DataFrame:
    """(ancestor, descendant, distance), each node being its own ancestor at distance 0. ``levels`` bounds the joins, so a cycle ends too.

    Categories are made to have at most LEVELS levels (fits_below guards it). For a deeper tree give its depth; one step more than that is
    taken, and a node found there fails the query instead of being cut off.
    """
    edges = nodes.where(F.col("parent_id").isNotNull()).select(F.col("id").alias("child"), F.col("parent_id").alias("parent"))
    now = nodes.select(F.col("id").alias("ancestor"), F.col("id").alias("descendant"), F.lit(0).alias("distance"))
    out = now
    for step in range(levels):
        now = now.join(edges, now.ancestor == edges.child).select(F.col("parent").alias("ancestor"), "descendant", (F.col("distance") + 1).alias("distance"))
        if step == levels - 1:
            # the condition needs both sides of the join, so it's asked of joined rows only
            both = F.concat(F.col("ancestor").cast("string"), F.lit("/"), F.col("descendant").cast("string"))
            now = now.where(F.when(both != "", F.raise_error(F.lit(f"a tree of more than {levels} levels")).cast("boolean")).otherwise(F.lit(True)))
        out = out.union(now)
    return out


def deep_closure(nodes: DataFrame, levels: int = 64) -> DataFrame:
    """(ancestor, descendant, distance, cycle) of trees of any depth up to ``levels``, a join and a stored table for each level that is found:
    no plan grows with the depth, and no limit of Spark's bounds the rows, as it does for recursion in SQL.

    Where an ancestor comes back on the way up, its row is marked as the end of a cycle and isn't followed further. A way of more than
    ``levels`` steps fails the query. Runs jobs while it is called.
    """
    edges = stored(nodes.where(F.col("id").isNotNull() & F.col("parent_id").isNotNull()).select(F.col("id").alias("ancestor"), F.col("parent_id").alias("parent")))
    now = nodes.select(F.col("id").alias("ancestor"), F.col("id").alias("descendant"), F.lit(0).alias("distance"), F.array("id").alias("way"), F.lit(False).alias("cycle"))
    found = [now := stored(now)]
    while True:
        back = F.array_contains("way", F.col("parent"))
        up = now.where(~F.col("cycle")).join(edges, "ancestor").select(F.col("parent").alias("ancestor"), "descendant", (F.col("distance") + 1).alias("distance"), F.array_append("way", F.col("parent")).alias("way"), back.alias("cycle"))
        now = stored(up)
        if now.isEmpty():
            break
        if len(found) > levels:
            raise RuntimeError(f"RECURSION_LEVEL_LIMIT_EXCEEDED: a way of more than {levels} steps")
        found.append(now)
    return reduce(DataFrame.unionByName, [x.select("ancestor", "descendant", "distance", "cycle") for x in found])


def rollup_all(nodes: DataFrame, counts: DataFrame) -> DataFrame:
    """(id, total): own count and those of all descendants. ``counts`` holds (id, n)."""
    tree = closure(nodes)
    return tree.join(counts, tree.descendant == counts.id, "left").groupBy(F.col("ancestor").alias("id")).agg(F.sum(F.coalesce("n", F.lit(0))).cast("long").alias("total"))


def rollup_leaves(nodes: DataFrame, counts: DataFrame) -> DataFrame:
    """(id, total): a leaf's own count, of an inner node the sum over its leaves, its own count not among them."""
    inner = nodes.where(F.col("parent_id").isNotNull()).select(F.col("parent_id").alias("id")).distinct()
    leaves = nodes.select("id").join(inner, "id", "left_anti").select(F.col("id").alias("leaf"))
    tree = closure(nodes)
    of_leaves = tree.join(leaves, tree.descendant == leaves.leaf).join(counts, F.col("leaf") == counts.id, "left")
    return of_leaves.groupBy(F.col("ancestor").alias("id")).agg(F.sum(F.coalesce("n", F.lit(0))).cast("long").alias("total"))


def paths(nodes: DataFrame, separator: str = " / ") -> DataFrame:
    """(id, depth, path): names from the root to each node."""
    names = nodes.select(F.col("id").alias("ancestor"), "name")
    steps = closure(nodes).join(names, "ancestor").groupBy(F.col("descendant").alias("id"))
    return steps.agg(F.max("distance").alias("depth"), F.array_sort(F.collect_list(F.struct((-F.col("distance")).alias("d"), "name"))).alias("s")).select("id", "depth", F.array_join("s.name", separator).alias("path"))


def subtree(nodes: DataFrame, root) -> DataFrame:
    """Ids of a node and all below it."""
    return closure(nodes).where(F.col("ancestor") == root).select(F.col("descendant").alias("id"))


def would_cycle(nodes: DataFrame, node, new_parent) -> bool:
    """Would the node become its own ancestor under the new parent?"""
    return not closure(nodes).where((F.col("ancestor") == node) & (F.col("descendant") == new_parent)).isEmpty()


def fits_below(nodes: DataFrame, node, new_parent, levels: int = LEVELS) -> bool:
    """Does the node's subtree still have at most ``levels`` levels under the new parent?"""
    tree = closure(nodes, levels + 1)
    above = tree.where(F.col("descendant") == new_parent).agg(F.max("distance")).first()[0] or 0
    below = tree.where(F.col("ancestor") == node).agg(F.max("distance")).first()[0] or 0
    return above + 1 + below < levels


def may_hold_articles(nodes: DataFrame, chosen: DataFrame) -> DataFrame:
    """(id, allowed) of chosen ids: only leaves may hold articles; unknown ids may not."""
    inner = nodes.where(F.col("parent_id").isNotNull()).select(F.col("parent_id").alias("id")).distinct().withColumn("_inner", F.lit(True))
    known = nodes.select("id").withColumn("_known", F.lit(True))
    return chosen.join(known, "id", "left").join(inner, "id", "left").select("id", (F.col("_known").isNotNull() & F.col("_inner").isNull()).alias("allowed"))


def nested_tree(nodes: DataFrame, levels: int = LEVELS) -> DataFrame:
    """(id, name, tree) of the roots: JSON of all levels below, children in order of sort, those without one last."""
    rows = nodes.select("id", "name", "parent_id", "sort", F.lit(None).cast("string").alias("tree"))
    for _ in range(levels - 1):
        kids = rows.where(F.col("parent_id").isNotNull()).groupBy(F.col("parent_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct(F.col("sort").isNull().alias("late"), "sort", F.col("id").alias("k"), "name", "tree"))).alias("s"))
        child = lambda x: F.concat(F.lit('{"id":'), x["k"].cast("string"), F.lit(',"name":'), F.to_json(F.array(x["name"])), F.lit(',"children":'), F.coalesce(x["tree"], F.lit("[]")), F.lit("}"))
        listed = kids.select("id", F.concat(F.lit("["), F.array_join(F.transform("s", child), ","), F.lit("]")).alias("t"))
        rows = rows.join(listed, "id", "left").select("id", "name", "parent_id", "sort", F.coalesce("t", "tree").alias("tree"))
    return rows.where(F.col("parent_id").isNull()).select("id", "name", F.coalesce("tree", F.lit("[]")).alias("tree"))


def nested(nodes: DataFrame) -> DataFrame:
    """(id, name, children): direct children in order of sort, those without one last."""
    kids = nodes.where(F.col("parent_id").isNotNull()).groupBy(F.col("parent_id").alias("id")).agg(
        F.array_sort(F.collect_list(F.struct(F.col("sort").isNull().alias("late"), "sort", F.col("id").alias("child"), "name"))).alias("k")
    )
    return nodes.join(kids, "id", "left").select("id", "name", F.coalesce(F.transform("k", lambda k: F.struct(k["child"].alias("id"), k["name"].alias("name"))), F.array()).alias("children"))


def drift(stored: DataFrame, counts: DataFrame) -> DataFrame:
    """Nodes whose stored count differs from the actual one. ``stored`` holds (id, article_count)."""
    joined = stored.join(counts, "id", "left").withColumn("actual", F.coalesce("n", F.lit(0)))
    return joined.where(F.col("article_count") != F.col("actual")).select("id", "article_count", "actual", (F.col("actual") - F.col("article_count")).alias("difference"))
