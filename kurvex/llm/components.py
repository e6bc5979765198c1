"""Connected components by min-neighbour hooking and contraction; nothing is collected to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import drop, store


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of ``edges`` (a, b): label is the smallest node reachable.

    Each round maps every node to the least of itself and its neighbours and contracts the
    edges under that map; stars end after one round, other graphs after about log(diameter).
    Aggregates are plain minima, so a node with very many edges is pre-aggregated before the shuffle.
    """
    edges = store(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    labels = None
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a")).toDF("node", "near")
        hook = store(both.groupBy("node").agg(F.least("node", F.min("near")).alias("to")), "hook")
        if labels is None:
            new = hook.toDF("node", "label")
        else:
            new = labels.join(hook.toDF("label", "to"), "label", "left").select("node", F.coalesce("to", "label").alias("label"))
        new = store(new, "labels")
        left = edges.join(hook.toDF("a", "x"), "a").join(hook.toDF("b", "y"), "b").where("x <> y")
        left = store(left.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
        for t in (edges, hook, labels):
            if t is not None:
                drop(t)
        edges, labels = left, new
    return labels if labels is not None else edges.toDF("node", "label")
