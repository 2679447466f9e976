"""Connected components of a graph given as edges, by hooking and pointer jumping.

Every round keeps, for each node, the smallest label among its own and its neighbours', hangs the
label it gave up under the one it took, and shortens the chains. The tables are stored after each
round. Edges inside a component vanish, so that later rounds work on what is left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.session import durable


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` of every node of ``edges (a, b)``; the root is the component's smallest node.

    Loops and repeated edges do no harm; NULL ends are left out. Nodes without edges are not listed.
    Each round contracts every node with a smaller neighbour into its smallest neighbour: hubs are
    only ever counted by pre-aggregated minima, never gathered in a list.
    """
    edges = edges.where("a IS NOT NULL AND b IS NOT NULL")
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    # Smallest neighbour of each node, itself included: a forest of falling pointers.
    labels = durable(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("root")))
    left = durable(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct())
    while True:
        labels = _shorten(labels)
        # Edges between the trees, written as edges between their roots.
        left = durable(_relabel(left, labels).where("a < b").distinct())
        if left.isEmpty():
            return labels
        # Each larger root takes its smallest neighbouring root; the trees follow.
        hooks = left.groupBy(F.col("b").alias("old")).agg(F.min("a").alias("new"))
        labels = durable(_follow(labels, hooks))


def _follow(labels: DataFrame, hooks: DataFrame) -> DataFrame:
    """Replaces roots that have a hook."""
    return labels.join(hooks, labels["root"] == hooks["old"], "left").select("node", F.coalesce("new", "root").alias("root"))


def _shorten(labels: DataFrame) -> DataFrame:
    """Pointer jumping until every pointer ends at a root."""
    while True:
        up = labels.where("node <> root").select(F.col("node").alias("old"), F.col("root").alias("new"))
        stored = durable(
            labels.join(up, labels["root"] == up["old"], "left")
            .select("node", F.coalesce("new", "root").alias("root"), F.col("new").isNotNull().alias("moved"))
        )
        labels = stored.select("node", "root")
        if stored.where("moved").isEmpty():
            return labels


def _relabel(edges: DataFrame, labels: DataFrame) -> DataFrame:
    for end in ("a", "b"):
        other = "b" if end == "a" else "a"
        named = labels.select(F.col("node").alias(end), F.col("root").alias("__root"))
        edges = edges.join(named, end).select(other, F.col("__root").alias(end))
    return edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
