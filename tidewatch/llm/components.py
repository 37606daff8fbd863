"""Connected components of a graph too large for one machine, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def components(edges: DataFrame) -> DataFrame:
    """node and root for every node of edges (a, b): nodes share a root if a path joins them.

    Each round every node hooks to its least neighbour, if that is less than itself, follows hooks twice, and the edges
    are drawn anew between what the nodes hooked to; they halve at least until none is left. Rounds are written to the
    shared folder. The root is some node of the component, not always the least. Loops and null ends are passed over;
    without edges there are no rows.
    """
    e = common.saved(_drawn(edges.select("a", "b")), "edges")
    roots = None
    while not e.isEmpty():
        both = e.select(F.col("a").alias("node"), F.col("b").alias("near")).unionByName(e.select(F.col("b").alias("node"), F.col("a").alias("near")))
        hooks = common.saved(both.groupBy("node").agg(F.min("near").alias("least")).select("node", F.least("node", "least").alias("root")), "hooks")
        for _ in range(2):
            above = hooks.select(F.col("node").alias("root"), F.col("root").alias("over"))
            hooks = hooks.join(above, "root").select("node", F.col("over").alias("root"))
        hooks = common.saved(hooks, "hooks")
        if roots is None:
            roots = hooks
        else:
            above = hooks.select(F.col("node").alias("root"), F.col("root").alias("over"))
            roots = common.saved(roots.join(above, "root", "left").select("node", F.coalesce("over", "root").alias("root")), "roots")
        ends = hooks.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        e = e.join(ends, "a").join(ends.select(F.col("a").alias("b"), F.col("ra").alias("rb")), "b")
        e = common.saved(_drawn(e.select(F.col("ra").alias("a"), F.col("rb").alias("b"))), "edges")
    return roots if roots is not None else e.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _drawn(edges: DataFrame) -> DataFrame:
    return edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
