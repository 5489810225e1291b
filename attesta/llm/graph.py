"""Connected components of an edge table, by hooking and contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.llm._shared import shared_dir, stage


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of the edges (a, b); label is the least node of its component.

    In each round every node hooks to its least neighbour, chains of hooks are
    halved, and the edges are contracted to edges between the hooks' ends. Rounds
    grow with the logarithm of the longest path. All state is in written tables.
    Self-loops, repeated edges and an empty table are allowed; null ends are dropped.
    """
    folder = shared_dir(edges.sparkSession)
    live = stage(edges.select("a", "b").dropna(), "edges-0", folder)
    both = live.select(F.col("a").alias("node"), "b").unionByName(live.select(F.col("b").alias("node"), F.col("a").alias("b")))
    labels = stage(both.groupBy("node").agg(F.min("b").alias("b")).select("node", F.least("node", "b").alias("label")), "labels-0", folder)
    hooks, turn = labels, 0
    while True:
        turn += 1
        short = hooks.select(F.col("node").alias("mid"), F.col("label").alias("end"))
        hooks = stage(hooks.join(short, hooks.label == short.mid, "left").select("node", F.coalesce("end", "label").alias("label")), f"hooks-{turn}", folder)
        to = hooks.select(F.col("node").alias("via"), F.col("label").alias("end"))
        if turn > 1:
            labels = stage(labels.join(to, labels.label == to.via, "left").select("node", F.coalesce("end", "label").alias("label")), f"labels-{turn}", folder)
        else:
            labels = hooks
        ends = live.join(to.toDF("a", "x"), "a").join(to.toDF("b", "y"), "b").filter("x <> y")
        live = stage(ends.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), f"edges-{turn}", folder)
        if live.isEmpty():
            return settled(labels, folder)
        both = live.select(F.col("a").alias("node"), "b").unionByName(live.select(F.col("b").alias("node"), F.col("a").alias("b")))
        hooks = both.groupBy("node").agg(F.min("b").alias("b")).select("node", F.least("node", "b").alias("label"))
        hooks = stage(hooks, f"mins-{turn}", folder)


def settled(labels: DataFrame, folder: str) -> DataFrame:
    """Follow labels that are nodes with another label, until none is left."""
    turn = 0
    while True:
        to = labels.select(F.col("node").alias("via"), F.col("label").alias("end")).filter("via <> end")
        moved = labels.join(to, labels.label == to.via, "left")
        if moved.filter(F.col("end").isNotNull()).isEmpty():
            return labels
        turn += 1
        labels = stage(moved.select("node", F.coalesce("end", "label").alias("label")), f"settled-{turn}", folder)
