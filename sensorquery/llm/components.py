"""Connected components of a large edge table by alternating stars, with written tables in between.

Each round points the larger neighbours of a node to its smallest neighbour, then the smaller ones;
both halves are an aggregation and a join, so nothing but single edges travels. Rounds are few (the
logarithm of the longest path, about). Each round is written to the shared folder and read again:
that cuts the lineage and survives lost executors. Once no more than LOCAL_EDGES edges are there (16
MB), one task finishes them by union-find instead of further rounds; the result is the same.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorquery.session import scratch_path, ship_functions

LOCAL_EDGES = 1 << 20


def written(df: DataFrame, label: str) -> DataFrame:
    """The rows as a Parquet table in the shared folder."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every edge has a > b here."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def _joined(batches):
    """(node, label) of all nodes of the edges of a task, by union-find."""
    import pyarrow as pa

    parent: dict[int, int] = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    nodes = list(parent)
    yield pa.RecordBatch.from_arrays(
        [pa.array(nodes, pa.int64()), pa.array([root(x) for x in nodes], pa.int64())], ["node", "label"])


def components(edges: DataFrame, local_edges: int | None = None) -> DataFrame:
    """(node, label) for every node of the edges (a, b): the smallest node that it reaches.

    Nulls are no nodes; loops and repeated edges do no harm; no edges, no rows. A node with a third
    of all edges is split by the skew handling of the joins and pre-aggregated in the groupings.
    """
    found = edges.where("a is not null and b is not null")
    loops = found.where("a = b").select(F.col("a").alias("node"))
    now = written(found.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state, few = None, LOCAL_EDGES if local_edges is None else local_edges
    lone = loops.select("node", F.col("node").alias("label"))
    while True:
        fresh = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if fresh[0] <= few:
            ends = now.repartition(1).mapInArrow(_joined, "node long, label long")
            return ends.unionByName(lone).groupBy("node").agg(F.min("label").alias("label"))
        if fresh == state:
            break
        state = fresh
        now = written(_small_star(_large_star(now)), "edges")
    labels = now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("label"))
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct()
    every = labels.unionByName(roots).unionByName(lone)
    return every.groupBy("node").agg(F.min("label").alias("label"))


ship_functions(__name__)
