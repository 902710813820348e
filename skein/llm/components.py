"""Connected components of a distributed edge table by alternating star contractions.

First every partition contracts its own edges to stars (union-find over a
bounded number of edges), which leaves only what crosses partitions. Edges
never leave the executors: each round is two grouped minima joined back
on the vertex (so Spark's skew join can split a hub), and every round is cut
by a checkpoint, which makes a lost executor cost one round at most.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint

#: Far above the logarithmic number of rounds that any input needs.
MAX_ROUNDS = 60
#: Edges that one partition contracts on its own, about; some 100 MB.
LOCAL_EDGES = 300_000


def _contracted(edges: DataFrame) -> DataFrame:
    """The stars of each partition's own components: (node, least node)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict = {}

        def root(x):
            while parent[x] != x:
                parent[x] = x = parent[parent[x]]
            return x

        kind = None
        for batch in batches:
            kind = batch.schema
            for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                parent.setdefault(u, u)
                parent.setdefault(v, v)
                a, b = root(u), root(v)
                if a != b:
                    parent[max(a, b)] = min(a, b)
        nodes = [x for x in parent if root(x) != x]
        for at in range(0, len(nodes), 50_000):
            part = nodes[at : at + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, kind.field(0).type), pa.array([root(x) for x in part], kind.field(1).type)], names=["u", "v"])

    return edges.mapInArrow(run, edges.schema)


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    joined = edges.join(least, "u")
    links = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    own = least.select("u", F.col("m").alias("v"))
    return links.unionByName(own).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """edges (u, v) of any orderable type -> (node, root): every node that has an
    edge to another node, with the least node of its component.

    Self loops, repeats and rows with a null end are ignored; an empty input
    gives an empty result.
    """
    now = checkpoint(
        edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    )
    now = checkpoint(_contracted(now.coalesce(max(1, math.ceil(now.count() / LOCAL_EDGES)))))
    for _ in range(MAX_ROUNDS):
        # done when each node has one edge and no root has an edge of its own
        out = now.groupBy("u").agg(F.count("*").alias("n"))
        roots = now.select(F.col("v").alias("u")).distinct()
        open_nodes = out.where("n > 1").select("u").unionByName(out.join(roots, "u", "left_semi").select("u"))
        if open_nodes.isEmpty():
            break
        now = checkpoint(_small_star(_large_star(now)))
    else:
        raise RuntimeError("component rounds did not settle")
    grown = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return grown.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
