"""Connected components by repeated contraction, as DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import materialize, release


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b); a component's id is its smallest node.

    In each round every node points to its smallest neighbour or itself, pointers are
    followed to their ends by doubling, and the edges are rewritten to these ends; edges
    within one node disappear.  A chain of n nodes with rising ids so takes one round of
    log2(n) steps, a star two rounds.  Joins have one row for each node on one side, so the
    rows of a node with many edges can be split between tasks.
    """
    edges = materialize(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "cc-edges")
    maps = []
    while edges.limit(1).count():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        to = materialize(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("to")), "cc-to")
        to = _closed(to)
        maps.append(to)
        left = to.select(F.col("node").alias("a"), F.col("to").alias("ta"))
        right = to.select(F.col("node").alias("b"), F.col("to").alias("tb"))
        moved = edges.join(left, "a").select("b", "ta").join(right, "b").select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b"))
        old, edges = edges, materialize(moved.where("a < b").distinct(), "cc-edges")
        release(old)
    if not maps:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    # a node's component is that of the node it points to, from the last round back
    found = maps[-1].select("node", F.col("to").alias("component"))
    for to in reversed(maps[:-1]):
        later = found.select(F.col("node").alias("to"), "component")
        found = materialize(to.join(later, "to", "left").select("node", F.coalesce("component", "to").alias("component")), "cc-found")
    return found


def _closed(to: DataFrame) -> DataFrame:
    """Follow the pointers (node, to) of a table to their ends, twice as far each time; the table goes."""
    while True:
        further = to.select(F.col("node").alias("to"), F.col("to").alias("further"))
        moved = to.join(further, "to", "left").select("node", F.coalesce("further", "to").alias("next"), (F.col("further") < F.col("to")).alias("changed"))
        moved = materialize(moved, "cc-closed")
        closed = not moved.where("changed").limit(1).count()
        release(to)
        to = moved.select("node", F.col("next").alias("to"))
        if closed:
            return to
