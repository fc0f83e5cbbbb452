"""Connected components of an edge table by smallest labels and label doubling.

Each task first joins the edges it happens to hold and passes on a star for each group, which shortens chains.
Edges, labels and components stay in tables; each round is written to the shared folder, so lineage stays
short and a lost executor costs a re-read. A node with very many edges is met on one side of a join only
(adaptive execution splits it) and its minimum is combined before the shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.llm.ship import shipped, tidy
from riskweave.session import cut_lineage


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of one task as (node, smallest node of its group here)."""
    parent: dict = {}
    kind = None
    for batch in batches:
        kind = batch.schema
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            for x in (a, b):
                parent.setdefault(x, x)
            while parent[a] != a:
                parent[a] = a = parent[parent[a]]
            while parent[b] != b:
                parent[b] = b = parent[parent[b]]
            if a != b:
                parent[max(a, b)] = min(a, b)
    if not parent:
        return
    nodes, roots = [], []
    for x in parent:
        root = x
        while parent[root] != root:
            root = parent[root]
        parent[x] = root
        nodes.append(x)
        roots.append(root)
    for at in range(0, len(nodes), 10_000):
        columns = [pa.array(c[at : at + 10_000], kind.field(0).type) for c in (nodes, roots)]
        yield pa.RecordBatch.from_arrays(columns, ["a", "b"])


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): every node on an edge with the smallest node it is connected with.

    Null ends are ignored, repeated edges and loops do no harm, an empty table gives an empty table.
    """
    pairs = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a IS NOT NULL AND b IS NOT NULL")
    kind = pairs.schema["a"].dataType.simpleString()
    pairs = shipped(pairs).mapInArrow(tidy(_stars), f"a {kind}, b {kind}")
    both = cut_lineage(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut_lineage(both.groupBy("a").agg(F.least(F.min("b"), F.min("a")).alias("label")).withColumnRenamed("a", "node"))
    while True:
        nearest = (
            both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("_near")).withColumnRenamed("a", "node")
        )
        lower = labels.join(nearest, "node", "left").select(
            "node", F.col("label").alias("_old"), F.least("label", "_near").alias("_new")
        )
        lower = cut_lineage(lower)
        if lower.filter("_new <> _old").isEmpty():
            return lower.select("node", F.col("_new").alias("component"))
        jump = lower.select(F.col("node").alias("_new"), F.col("_new").alias("_far"))
        labels = cut_lineage(lower.join(jump, "_new", "left").select("node", F.coalesce("_far", "_new").alias("label")))
