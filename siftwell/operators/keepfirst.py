"""Ordered keep-first over a whole table: a row stays unless a row that stayed before it has its address, a near text or a like title.

What stays depends on what stayed before, which is a fold over all rows in order. The fold's result is the lexicographically first maximal
independent set of the graph of conflicts, and that set can be found in rounds by joins: a row stays as soon as no open row before it is in
conflict with it, and then all open rows in conflict with it go. Each round settles every row that waits for none, so there are as many
rounds as the longest chain of rows that wait for each other; on orders unrelated to the texts that grows with the logarithm.

Rows of equal addresses, fingerprints or titles are a class. Conflicts inside a class are never expanded: a class is represented by its
least open row, and links run between classes.

Links and members grow with the table, and names of classes are stored in far fewer bytes than they take in memory, so a join of
them has a hint that it sorts and merges: Spark would take them for small and broadcast them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.stored import stored

#: Why a row goes, in the order in which reasons are looked for, by the letter that begins the name of a class.
REASONS = {"u": "url", "h": "content", "t": "title"}


def classes(nodes: DataFrame) -> DataFrame:
    """(g, c, n, r) of nodes (g, n, r, u, h, t): a row for each class that a node is in. c tells what is equal: a letter and the value."""
    named = F.array(*(F.when(F.col(k).isNotNull(), F.concat(F.lit(k), F.col(k).cast("string"))) for k in REASONS))
    return nodes.select("g", "n", "r", F.explode(F.array_compact(named)).alias("c"))


def reached(members: DataFrame, links: DataFrame) -> DataFrame:
    """(g, c, m): the least rank among the members of each class and of the classes linked to it."""
    least = members.groupBy("g", "c").agg(F.min("r").alias("m"))
    near = links.hint("merge").join(least, ["g", "c"]).select("g", F.col("other").alias("c"), "m")
    return least.unionByName(near).groupBy("g", "c").agg(F.min("m").alias("m"))


def first_independent(members: DataFrame, links: DataFrame) -> DataFrame:
    """(n) of the rows that stay, given members (g, c, n, r) and symmetric links (g, c, other) between different classes.

    Runs its rounds while it is called, and stores what is open after each; a round reads open rows only.
    """
    kept, left = [], stored(members)
    while not left.isEmpty():
        blocked = left.hint("merge").join(reached(left, links), ["g", "c"]).groupBy("n").agg(F.min("m").alias("m"), F.first("r").alias("r"))
        now = stored(blocked.where(F.col("m") == F.col("r")).select("n"))
        chosen = left.hint("merge").join(now, "n", "left_semi").select("g", "c").distinct()
        hit = chosen.unionByName(links.hint("merge").join(chosen, ["g", "c"], "left_semi").select("g", F.col("other").alias("c"))).distinct()
        gone = left.hint("merge").join(hit, ["g", "c"], "left_semi").select("n").distinct()
        kept.append(now)
        left = stored(left.hint("merge").join(gone, "n", "left_anti"))
    out = members.select("n").limit(0)
    for part in kept:
        out = out.unionByName(part)
    return out


def settle(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(n, reason) of nodes (g, n, r, u, h, t, own): null for rows that stay, else the first of url, content and title for which a row that
    stayed before it speaks, else ``own``. Rows with a reason of their own never stay and block none."""
    members = stored(classes(nodes.where(F.col("own").isNull())))
    bare = nodes.where("own IS NULL AND u IS NULL AND h IS NULL AND t IS NULL").select("n")  # in no class: in conflict with none
    kept = stored(first_independent(members, links).unionByName(bare))
    found = reached(members.hint("merge").join(kept, "n", "left_semi"), links)
    hits = classes(nodes.hint("merge").join(kept, "n", "left_anti")).hint("merge").join(found, ["g", "c"]).where(F.col("m") < F.col("r"))
    rank = F.array_position(F.array(*map(F.lit, REASONS)), F.substring("c", 1, 1))
    why = hits.groupBy("n").agg(F.min(rank).alias("k"))
    reason = F.element_at(F.array(*map(F.lit, REASONS.values())), F.col("k").cast("int"))
    told = nodes.select("n", "own").hint("merge").join(kept.withColumn("stays", F.lit(True)), "n", "left").hint("merge").join(why, "n", "left")
    return told.select("n", F.when(F.col("stays"), F.lit(None)).when(F.col("k").isNotNull(), reason).otherwise(F.col("own")).alias("reason"))


def ranked(df: DataFrame, group: Sequence[str], order: Sequence[str]) -> DataFrame:
    """df, stored, with _group, _node (a number of its own) and _rank (its place in the order, ties by _node)."""
    numbered = stored(df.withColumn("_node", F.monotonically_increasing_id()))
    place: list[Column | str] = [F.col(o).alias(f"o{i}") for i, o in enumerate(order)]
    both = F.struct(F.lit(0).alias("all"), *(F.col(x).alias(f"g{i}") for i, x in enumerate(group)))
    return numbered.withColumn("_group", both).withColumn("_rank", F.struct(*place, "_node"))
