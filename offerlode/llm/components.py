"""Connected components: forests within tasks, then large-star and small-star rounds."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerlode.llm.common import durable, forget

#: Edges that one task joins in memory. Tables of more edges are cut into so many per task.
FOREST_EDGES = 200_000


def _forests(edges: DataFrame, tasks: int) -> DataFrame:
    """Each task's edges as stars: every node but the smallest of its tree, and that one."""

    def run(batches):
        parent: dict = {}

        def root(node):
            while parent.setdefault(node, node) != node:
                parent[node] = parent[parent[node]]
                node = parent[node]
            return node

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                a, b = root(a), root(b)
                if a != b:
                    parent[max(a, b)] = min(a, b)
        nodes = [node for node in parent if root(node) != node]
        yield pa.RecordBatch.from_arrays(
            [pa.array(nodes, types[0]), pa.array([root(node) for node in nodes], types[1])], ["a", "b"]
        )

    types = [pa.string() if kind == "string" else pa.int64() for _, kind in edges.dtypes]
    return edges.repartition(tasks).mapInArrow(run, edges.schema)


def _large_star(edges: DataFrame) -> DataFrame:
    """Larger neighbours of a node move to the smallest node around it."""
    both = edges.union(edges.select(F.col("b"), F.col("a")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return (
        both.join(least, "a").where("b > a and b != m")
        .select(F.col("b").alias("a"), F.col("m").alias("b"))
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """Smaller neighbours of a node, and the node itself, move to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return least.select("a", F.col("m").alias("b")).union(moved).distinct()


def _state(edges: DataFrame):
    return edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()


def components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """Every linked node with the smallest node it can reach: (node, root).

    Nodes are longs or strings. Edges may repeat, run either way or join a node to itself. Nulls
    link nothing. An empty table gives an empty result. Tasks first reduce their edges to
    forests. Where there is one task that is the result; more are joined in rounds, each
    written to the shared folder while the one before is deleted. The driver sees a count and a
    checksum of the edges only. The number of rounds grows with the logarithm of the size.
    """
    ordered = durable(
        edges.select(F.greatest(left, right).alias("a"), F.least(left, right).alias("b")).where("a != b").distinct(),
        "edges",
    )
    tasks = max(1, -(-ordered.count() // FOREST_EDGES))
    edges = durable(_forests(ordered, tasks), "edges")
    forget(ordered)
    if tasks > 1:
        state = _state(edges)
        while True:
            stars = durable(_small_star(_large_star(edges)), "edges")
            before, state = state, _state(stars)
            forget(edges)
            edges = stars
            if state == before:
                break
    nodes = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return nodes.union(edges.select(F.col("b"), F.col("b")).distinct())
