"""Connected components of an edge table, by hooking and pointer jumping or by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphloom.session import by_shuffle, cut_lineage


def connected_components(nodes: DataFrame, edges: DataFrame, within: list[str]) -> DataFrame:
    """``nodes`` with ``component``: the least node number reachable over ``edges(src, dst)``.

    Node numbers are longs, unique per ``within`` (a page); edges stay inside it.
    Every node points at another node of its component. In a round each node looks at
    its neighbours' pointers two steps on; the least of them moves the node itself
    and also the node it points at, so whole trees are joined at their roots. Rounds
    grow with the logarithm of a component's size, and every step is a partial
    aggregation or an equi-join. Nodes without edges take no part.
    """

    undirected = cut_lineage(
        edges.select(*within, "src", "dst")
        .unionByName(edges.select(*within, F.col("dst").alias("src"), F.col("src").alias("dst")))
        .filter("src <> dst")
    )
    pointers = cut_lineage(
        undirected.groupBy(*within, F.col("src").alias("node")).agg(F.least(F.min("dst"), F.col("src")).alias("at"))
    )
    while True:
        next_step = pointers.select(*within, F.col("node").alias("at"), F.col("at").alias("further"))
        two_steps = pointers.join(next_step, [*within, "at"])
        seen = (
            undirected.join(two_steps.select(*within, F.col("node").alias("dst"), "further"), [*within, "dst"])
            .groupBy(*within, F.col("src").alias("node"))
            .agg(F.min("further").alias("least_seen"))
        )
        looked = two_steps.join(seen, [*within, "node"])
        hooks = looked.groupBy(*within, F.col("at").alias("node")).agg(F.min("least_seen").alias("hook"))
        moved = cut_lineage(
            looked.join(hooks, [*within, "node"], "left").select(
                *within, "node", F.col("at").alias("was"),
                F.least("at", "further", "least_seen", F.coalesce("hook", "at")).alias("at"),
            )
        )
        if moved.filter("at < was").isEmpty():
            break
        pointers = moved.select(*within, "node", "at")
    found = moved.select(*within, "node", F.col("at").alias("component"))
    return nodes.join(found, [*within, "node"], "left").withColumn("component", F.coalesce("component", "node"))


def contracted_components(edges: DataFrame, within: list[str]) -> DataFrame:
    """(within, node, component) for every node of ``edges(src, dst)``: the least node number of its component.

    Each round every node goes over to the neighbour, or stays at itself, that is least by a hash
    of the round, and two steps on from there. Edges are rewritten to where their ends went; those
    inside one place and repeated ones go, so the table shrinks by a share each round and not just
    the distance to the root. Only the rounds' own nodes are rewritten, and the maps are joined
    up once at the end, smallest first.
    """

    live = cut_lineage(_ordered_edges(edges.select(*within, "src", "dst")))
    maps: list[DataFrame] = []
    while not live.isEmpty():
        rank = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(len(maps))).alias("h"), F.col(c).alias("node"))
        both = live.unionByName(live.select(*within, F.col("dst").alias("src"), F.col("src").alias("dst")))
        best = both.groupBy(*within, F.col("src").alias("node")).agg(F.min(rank("dst")).alias("m"))
        step = cut_lineage(best.select(*within, "node", F.least(rank("node"), F.col("m"))["node"].alias("at")))
        further = step.select(*within, F.col("node").alias("at"), F.col("at").alias("next"))
        moved = cut_lineage(step.join(by_shuffle(further), [*within, "at"]).select(*within, "node", F.col("next").alias("at")))
        maps.append(moved)
        for end in ("src", "dst"):
            live = live.join(by_shuffle(moved.select(*within, F.col("node").alias(end), "at")), [*within, end]).drop(end).withColumnRenamed("at", end)
        live = cut_lineage(_ordered_edges(live))
    if not maps:
        return live.select(*within, F.col("src").alias("node"), F.col("dst").alias("component"))
    found = maps[-1]
    for earlier in reversed(maps[:-1]):
        later = found.select(*within, F.col("node").alias("at"), F.col("at").alias("root"))
        found = earlier.join(by_shuffle(later), [*within, "at"], "left").select(*within, "node", F.coalesce("root", "at").alias("at"))
    found = cut_lineage(found)
    least = found.groupBy(*within, "at").agg(F.min("node").alias("component"))
    return found.join(by_shuffle(least), [*within, "at"]).select(*within, "node", "component")


def _ordered_edges(edges: DataFrame) -> DataFrame:
    ends = {"src": F.least("src", "dst"), "dst": F.greatest("src", "dst")}
    return edges.filter("src <> dst").withColumns(ends).distinct()
