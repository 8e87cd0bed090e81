"""Roots and depths of parent forests, by pointer doubling over written tables.

Each round doubles how far every row looks, so a chain of n parents takes about log2 n rounds of a join. Nodes on a cycle, or that lead into
one, never settle, but end up looking at a node of the cycle. Cycles get their least node and length by doubling again, and what leads into
them becomes a forest whose roots are the nodes of cycles, so a cycle of n nodes takes log2 n rounds as well.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from usagemill.functions.tables import written


def roots(nodes: DataFrame, node: str = "node", parent: str = "parent", stop_before_seen: bool = True, max_rounds: int = 48) -> DataFrame:
    """(node, root, depth). A parent that is no node itself ends a chain as its root.

    On a cycle: with stop_before_seen the walk stops at the last node before one that it has seen, else at the seen one; depth counts hops.
    """
    own = nodes.select(F.col(node).alias("node"), F.col(parent).alias("to"))
    state = written(own.groupBy("node").agg(F.min("to").alias("to")).select("node", F.coalesce("to", "node").alias("to"), F.when(F.col("to").isNull() | (F.col("to") == F.col("node")), 0).otherwise(1).cast("long").alias("depth")))
    for _ in range(max_rounds):
        up = state.select(F.col("node").alias("to"), F.col("to").alias("up"), F.col("depth").alias("more"))
        grown = state.join(up, "to", "left")
        moved = F.col("up").isNotNull() & (F.col("up") != F.col("to"))
        new = written(grown.select("node", F.when(moved, F.col("up")).otherwise(F.col("to")).alias("to"), F.when(moved, F.col("depth") + F.col("more")).otherwise(F.col("depth")).alias("depth"), moved.alias("moved")))
        count, rows, deepest = new.agg(F.count(F.when(F.col("moved"), 1)), F.count(F.lit(1)), F.max("depth")).first()
        state = new.drop("moved")
        if not count or deepest > 2 * max(rows, 1):
            break
    return _settled(state, own, stop_before_seen)


def _settled(state: DataFrame, own: DataFrame, stop_before_seen: bool) -> DataFrame:
    """Nodes whose chain ended keep its end as root; those on a cycle, or that lead into one, get the node where their walk meets one that it has seen, or the one before."""
    parents = written(own.groupBy("node").agg(F.min("to").alias("up")))
    ends = state.join(parents.select(F.col("node").alias("to"), F.col("up").alias("beyond")), "to", "left")
    settled = F.col("beyond").isNull() | (F.col("beyond") == F.col("to"))
    done = written(ends.where(settled).select("node", F.col("to").alias("root"), "depth"))
    lost = written(ends.where(~settled).select("node", "to"))
    if not lost.limit(1).count():
        return done
    ring = written(parents.join(lost.select(F.col("to").alias("node")).distinct(), "node", "left_semi"))  # all nodes of cycles
    around = written(ring.select("node", F.col("up").alias("to"), F.least("node", "up").alias("least")))
    steps, nodes = 1, ring.count()
    while steps < nodes:
        far = around.select(F.col("node").alias("to"), F.col("to").alias("up"), F.col("least").alias("other"))
        around, steps = written(around.join(far, "to").select("node", F.col("up").alias("to"), F.least("least", "other").alias("least"))), 2 * steps
    length = around.groupBy("least").agg(F.count(F.lit(1)).alias("length"))
    before = ring.select(F.col("up").alias("entry"), F.col("node").alias("last"))
    cycles = written(around.select(F.col("node").alias("entry"), "least").join(length, "least").join(before, "entry").select("entry", "length", "last"))
    inward = lost.select("node").join(parents, "node").join(ring.select("node"), "node", "left_anti").unionByName(ring.select("node", F.lit(None).cast(ring.schema["up"].dataType).alias("up")))
    entered = roots(inward, "node", "up").select("node", F.col("root").alias("entry"), "depth").join(cycles, "entry")
    last, hops = (F.col("last"), F.col("length") - 1) if stop_before_seen else (F.col("entry"), F.col("length"))
    return done.unionByName(entered.select("node", last.alias("root"), (F.col("depth") + hops).alias("depth")))
