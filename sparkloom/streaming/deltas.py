"""Incremental builds by signed facts.

What a document adds to a graph are facts: rows that depend on that document alone. A build keeps the facts of each document
with the hash of its text, and for each distinct fact in how many places it stands. When documents come,
change or go, their old facts count -1 each and their new ones +1; the sums over these,
and nothing else, change the totals. Aggregates that can be added (weights of pairs, numbers of documents)
are sums of totals; others (the best entity of a name, the statements of an entity) are made
again for just the keys that a delta touches. So an update reads the texts of changed documents only, and
builds in steps equal a build of all at once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.sources.sinks import Snapshots

Facts = Callable[[DataFrame], DataFrame]


def signed(before: DataFrame, gone: DataFrame, added: DataFrame) -> DataFrame:
    """The facts of documents that are gone or changed with n = -1, and the new facts with n = 1; before: facts by doc_id, gone: doc_id, added: facts by doc_id."""
    off = before.join(gone.select("doc_id").distinct(), "doc_id", "left_semi").withColumn("n", F.lit(-1).cast("long"))
    return off.unionByName(added.withColumn("n", F.lit(1).cast("long")))


def fold(totals: DataFrame, delta: DataFrame, columns: list[str]) -> DataFrame:
    """Totals (columns, n) with a delta's; what comes to nothing is left out. Null is a value like others."""
    both = totals.select(*columns, "n").unionByName(delta.select(*columns, "n"))
    return both.groupBy(*columns).agg(F.sum("n").alias("n")).filter("n <> 0")


def touched_keys(delta: DataFrame, keys: list[str]) -> DataFrame:
    return delta.select(*keys).distinct()


def refreshed(view: DataFrame, totals: DataFrame, touched: DataFrame, keys: list[str], make: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """A view of totals, made again for the keys that a delta touches."""
    # Shuffled on both sides: repeated words make small files of it, by which Spark would send it whole through the driver.
    touched = touched.select(*(F.col(k).alias(f"_{k}") for k in keys)).hint("merge")
    same = _all(F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys)
    return view.join(touched, same, "left_anti").unionByName(make(totals.join(touched, same, "left_semi")))


def _all(conditions) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


class IncrementalBuild:
    """Facts, totals and views of documents (doc_id, text, ...) under a path. An update is one commit: all of it is seen, or none.

    ``facts`` makes the facts of documents: doc_id and ``columns``. A view is (keys, make): make gives it from totals
    (columns, n), and rows of one key come from totals of that key alone. doc_id is unique among documents.
    """

    def __init__(self, spark: SparkSession, path: str, facts: Facts, columns: list[str], views: dict[str, tuple[list[str], Facts]]):
        self.spark, self.log, self.facts, self.columns, self.views = spark, Snapshots(spark, path), facts, columns, views

    def update(self, build_id: str, docs: DataFrame) -> str:
        """Brings everything to the state of docs. Only documents whose hash is new are read for facts."""
        now = docs.select("doc_id", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("hash"))
        known = set(self.log.names())
        w = self.log.begin(build_id, keep=True)

        def last(name: str, empty: Callable[[], DataFrame]) -> DataFrame:
            return self.log.read(name) if name in known else empty().limit(0)

        held = last("manifest", lambda: now).select(F.col("doc_id").alias("_id"), F.col("hash").alias("_old"))
        before = last("facts", lambda: self.facts(docs).select("doc_id", *self.columns))
        totals = last("totals", lambda: before.select(*self.columns).withColumn("n", F.lit(0).cast("long")))
        state = now.join(held, F.col("doc_id") == F.col("_id"), "full_outer").filter(~F.col("hash").eqNullSafe(F.col("_old")))
        state = w.write("changed", state.select("doc_id", F.col("_id").alias("old_id")))
        gone = state.filter("old_id is not null").select(F.col("old_id").alias("doc_id"))
        todo = docs.join(state.filter("doc_id is not null").select("doc_id"), "doc_id", "left_semi")
        # Written once: totals and views read this and the texts no more.
        delta = w.write("delta", signed(before, gone, self.facts(todo).select("doc_id", *self.columns)))
        w.write("facts", before.join(gone, "doc_id", "left_anti").unionByName(delta.filter("n > 0").select(*before.columns)))
        new = w.write("totals", fold(totals, delta, self.columns))
        touched: dict[tuple, tuple[str, DataFrame]] = {}
        for name, (keys, make) in self.views.items():
            if name not in known and "totals" not in known:
                # All totals are of this delta, so it touches every key.
                w.write(name, make(new))
                continue
            # Views by the same keys share one pass over the delta.
            if tuple(keys) not in touched:
                made = f"touched_{len(touched)}"
                touched[tuple(keys)] = made, w.write(made, touched_keys(delta, keys))
            w.write(name, refreshed(last(name, lambda: make(totals)), new, touched[tuple(keys)][1], keys, make))  # noqa: B023
        w.write("manifest", now)
        w.leave_out("changed", "delta", *(made for made, _ in touched.values()))
        return w.commit()

    def read(self, name: str) -> DataFrame:
        return self.log.read(name)
