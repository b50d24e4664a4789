"""Connected components of an edge table, on Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigris.llm import common

#: How often parents are followed within a round.
_JUMPS = 3


def _contracted(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Edges between the components of their ends."""
    a, b = labels.select(F.col("node").alias("a"), F.col("component").alias("ca")), labels.select(F.col("node").alias("b"), F.col("component").alias("cb"))
    ends = edges.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    return ends.filter("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def connected_components(edges: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """edges: a, b. Returns node, component (the smallest node reachable) of every node that has an edge.

    known: the components of other edges, which are taken in.

    Each round hooks every node to its least neighbour, follows parents a few times and contracts the
    edges to what is still between different trees, so they shrink quickly. Rounds are written to the shared folder.
    """
    labels, done = known, []
    if known is not None:
        edges = _contracted(edges, known)
    while True:
        now = common.materialize(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
        for old in done:  # what the edges were worked out from
            common.discard(old)
        if not now.limit(1).count() and labels is not None:
            return labels
        both = now.select("a", "b").union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parents = both.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("node"), F.least("a", "least").alias("component"))
        jumps = []
        for _ in range(_JUMPS):
            up = parents.select(F.col("node").alias("component"), F.col("component").alias("up"))
            parents = common.materialize(parents.join(up, "component", "left").select("node", F.coalesce("up", "component").alias("component")), "parents")
            jumps.append(parents)
        done = [now, *jumps[:-1]]
        if labels is None:
            labels = parents
        else:
            done.append(parents)
            if labels is not known:
                done.append(labels)
            moved = parents.select(F.col("node").alias("component"), F.col("component").alias("to"))
            old = labels.join(moved, "component", "left").select("node", F.coalesce("to", "component").alias("component"))
            labels = common.materialize(old.unionByName(parents.join(labels.select("node"), "node", "left_anti")), "labels")
        edges = _contracted(now, parents)
