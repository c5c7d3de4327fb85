"""Connected components by contraction.

In each round a node joins the one that comes first among itself and its neighbours, in an order drawn anew
for the round, and edges move to the nodes that are left. The order is random, so a round takes away a
share of the nodes of any graph, chains and stars alike. What is left, once it is at
most ``small`` edges, is finished in one task. Labels then go back through the rounds.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.lineage import drop, written


def _finish(group: pa.Table) -> pa.Table:
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in zip(group["a"].to_pylist(), group["b"].to_pylist()):
        x, y = find(a), find(b)
        if x != y:
            root[max(x, y)] = min(x, y)
    return pa.table({"node": pa.array(list(root), pa.int64()), "label": pa.array([find(x) for x in root], pa.int64())})


def components(edges: DataFrame, small: int = 1_000_000) -> DataFrame:
    """(node, label) of every node of edges (a, b), longs: nodes have one label where edges connect them. Loops and repeated edges do no harm; nodes of loops alone are left out."""
    spark, steps, paths = edges.sparkSession, [], []
    pair = (F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    now, path = written(edges.filter("a <> b").select(*pair).distinct(), "edges")
    while now.count() > small:
        seed = len(steps)
        place = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(seed)).alias("h"), F.col(c).alias("node"))  # noqa: B023, E731
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        to, to_path = written(both.groupBy("a").agg(F.least(F.min(place("b")), F.min(place("a")))["node"].alias("to")), "contracted")
        a, b = to.withColumnsRenamed({"a": "a", "to": "x"}), to.withColumnsRenamed({"a": "b", "to": "y"})
        left = now.join(a, "a").join(b, "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).filter("a <> b").distinct()
        done = path
        now, path = written(left, "edges")
        drop(spark, done)
        steps.append(to)
        paths.append(to_path)
    labels = now.withColumn("_all", F.lit(0)).groupBy("_all").applyInArrow(_finish, "node long, label long")
    for to in reversed(steps):
        labels = to.join(labels, F.col("to") == F.col("node"), "left").select(F.col("a").alias("node"), F.coalesce("label", "to").alias("label"))
    labels, _ = written(labels, "components")
    for p in (path, *paths):
        drop(spark, p)
    return labels
