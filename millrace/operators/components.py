"""Connected components and k-cores by rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import shared_dir, stored
from .relational import hot_join, small_side


def components(edges: DataFrame) -> DataFrame:
    """node, label: the least node of each connected component of edges(a, b); a node without an edge isn't there.

    Rounds of random contraction: each round orders the nodes left by a hash of its own, renames every node to the first
    one among itself and its neighbours, and drops edges that become loops. Whatever the numbering, about half of the
    nodes or fewer stay each time, so a chain of n nodes takes some log2(n) rounds. The renamings, each a table half the
    size of the one before, are then put together from the last to the first. Neighbours are only ever aggregated.
    """
    left = stored(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct(), "component-edges")
    empty = left.select(F.col("a").alias("node"), F.col("a").alias("label"))
    steps: list[DataFrame] = []
    while not left.isEmpty():
        # a text as salt, since a number would be compiled into new code every round
        place = lambda c, n=len(steps): F.struct(F.xxhash64(F.lit(f"round {n}"), F.col(c)).alias("h"), F.col(c).alias("node"))
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        first = both.groupBy("a").agg(F.min(place("b")).alias("first"))
        step = stored(first.select(F.col("a").alias("node"), F.least("first", place("a"))["node"].alias("to")), "component-names")
        steps.append(step)
        half = left.join(step, F.col("a") == F.col("node")).select(F.col("to").alias("a"), "b")
        renamed = half.join(step, F.col("b") == F.col("node")).select(F.least("a", "to").alias("a"), F.greatest("a", "to").alias("b"))
        left = stored(renamed.filter("a <> b").distinct(), "component-edges")
    if not steps:
        return empty
    known = steps.pop().select("node", F.col("to").alias("root"))
    while steps:
        later = small_side(known.select(F.col("node").alias("at"), "root"), 200_000)
        known = stored(steps.pop().join(later, F.col("to") == F.col("at"), "left").select("node", F.coalesce("root", "to").alias("root")), "component-roots")
    least = known.groupBy("root").agg(F.min("node").alias("label"), F.count("*").alias("n")).checkpoint()
    return hot_join(known, least, ["root"], "n").select("node", "label")


def k_core(edges: DataFrame, least: int) -> DataFrame:
    """The edges (a, b) that are left when nodes with fewer than ``least`` neighbours go, again and again.

    Every round takes nodes away or is the last, so it ends by itself: a chain goes from both ends.
    """
    shared_dir(edges.sparkSession)
    left = edges.select("a", "b").filter("a <> b").distinct().checkpoint()
    while True:
        ends = left.select(F.explode(F.array("a", "b")).alias("node"))
        weak = ends.groupBy("node").agg(F.count("*").alias("degree")).filter(F.col("degree") < least).select("node").checkpoint()
        if weak.isEmpty():
            return left
        left = left.join(weak, left["a"] == weak["node"], "left_anti").join(weak, F.col("b") == weak["node"], "left_anti").checkpoint()
