"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import drop, salted, written


SALTS = 16


def _with_least(edges: DataFrame) -> DataFrame:
    """edges (a, b) with m, the smallest of a and its neighbours. Minima are reduced before the shuffle and come back over salted keys, so a node may have any share of the edges."""
    least = salted(edges.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m")), SALTS)
    return edges.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int")).join(least, ["a", "salt"]).drop("salt")


def components(edges: DataFrame, rounds: int | None = None) -> DataFrame:
    """(node, label) for every node of edges (a, b): label is the smallest node of its component.

    Each round links every node's neighbours to its smallest one, first those above it, then
    those below; the number of rounds grows with the logarithm of a component's diameter and the
    number of edges never does. Rounds go on until one changes nothing; where ``rounds`` are
    not enough for that it is an error. Only counts and sums of hashes reach the driver.
    """
    low, high = F.least("a", "b"), F.greatest("a", "b")
    now, path = written(edges.filter("a <> b").select(low.alias("b"), high.alias("a")).distinct())
    before = None
    for n in itertools.count():
        if n == rounds:
            raise RuntimeError(f"labels have not settled after {rounds} rounds")
        both = now.select("a", "b").unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _with_least(both).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        # Every b is below its a now, so m is the smallest neighbour.
        small = _with_least(large)
        small = small.select("a", F.col("m").alias("b")).unionByName(small.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))).distinct()
        done = path
        now, path = written(small)
        drop(edges.sparkSession, done)
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    return now.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
