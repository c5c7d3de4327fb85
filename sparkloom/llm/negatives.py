"""Exact searches by inner product over one-dimensional distance keys, and hard negatives from them.

A vector x gets one more component, the root of M^2 - |x|^2, where M is the greatest norm; a query
gets a zero. Distances then fall as inner products rise: |q - x|^2 = M^2 + |q|^2 - 2 q.x. Every
vector goes to its nearest pivot (pivots are fitted on a bounded sample), and all are stored
sorted by (pivot, distance to the pivot), in segments of consecutive keys. For a query at the distance d from
a pivot, the triangle inequality bounds what a segment of keys [lo, hi] can hold: distances from
max(d - hi, lo - d, 0) to d + hi, so scores between two numbers.

A search scans key intervals that widen from round to round: first the segment with the best
bound, then the next few, then all whose bound still reaches the k-th best score found so far. A
query with no such segment left is certified and takes no part in further rounds. A query may have several
windows of scores [low, high], each with a top-k of its own, and looks at its own label only or at all others.

A round sends a segment's vectors once for each ``QUERIES`` queries that want it, and a query once
to each segment it wants. A task reads a segment's vectors, then its queries as they come, so
it holds one segment and one batch of queries. Scores are exact integers; ties go to the smaller id.

Rows with a null id or label, or whose vector is null or holds a null or non-finite component,
take no part. Shorter vectors count as zero beyond their end. Repeated rows are candidates each, but never of a query with their own id.
An empty table gives an empty result; extra columns are left alone. Sums beyond 64 bits are taken in
integers of any size, and a score beyond a long counts as the nearest long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.llm.common import drop, table, written
from sparkloom.llm.topk import integers

SAMPLE, PIVOTS, SEGMENT, QUERIES = 4096, 64, 2048, 65_536
#: Segments that a query has scanned after each round, in order of their bounds; then all that the bound admits.
ROUNDS = (1, 8)
MOST = 2**63 - 1


def _rows(column, dims: int) -> np.ndarray:
    """Lists as a matrix of doubles, zero beyond their ends, at least ``dims`` wide."""
    lists = [np.asarray(x) for x in column.to_numpy(zero_copy_only=False)]
    out = np.zeros((len(lists), max([dims, *map(len, lists)])))
    for i, x in enumerate(lists):
        out[i, : len(x)] = x
    return out


def augmented(v: np.ndarray, most2: float, dims: int) -> np.ndarray:
    """The vectors, filled to so many components, with the one that brings every norm to the greatest."""
    rest = np.sqrt(np.maximum(most2 - np.einsum("ij,ij->i", v, v), 0))
    return np.concatenate([v, np.zeros((len(v), max(0, dims - v.shape[1]))), rest[:, None]], 1)


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances of vectors (last component: the augmented one) to pivots of no more components."""
    p = np.zeros((len(pivots), x.shape[1]))
    p[:, : pivots.shape[1] - 1], p[:, -1] = pivots[:, :-1], pivots[:, -1]
    with np.errstate(over="ignore", invalid="ignore"):
        return np.stack([np.sqrt(((x - y) ** 2).sum(1)) for y in p], 1)


def fit_pivots(sample: np.ndarray, n: int = PIVOTS, rounds: int = 5, seed: int = 5) -> np.ndarray:
    """Centres of a bounded sample."""
    draw = np.random.default_rng(seed)
    centres = sample[draw.choice(len(sample), min(n, len(sample)), replace=False)]
    for _ in range(rounds):
        nearest = distances(sample, centres).argmin(1)
        centres = np.stack([sample[nearest == k].mean(0) if (nearest == k).any() else centres[k] for k in range(len(centres))])
    return centres


class DistanceIndex:
    """vectors (vec_id, label, v) stored by (pivot, distance), with a directory of segments. ``close`` deletes both."""

    def __init__(self, vectors: DataFrame, segment: int = SEGMENT, pivots: int = PIVOTS, sample: int = SAMPLE):
        spark = vectors.sparkSession
        vectors, self._source = written(vectors, "integers")
        norm2 = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
        self.most2 = float(vectors.agg(F.max(norm2)).first()[0] or 0.0)
        drawn = vectors.select("v", F.xxhash64("vec_id", "v").alias("_h")).orderBy("_h").limit(sample).toPandas()  # bounded
        seen = _rows(pa.array(drawn["v"], pa.list_(pa.float64())), 1) if len(drawn) else np.zeros((1, 1))
        most2, centres = self.most2, fit_pivots(augmented(seen, self.most2, 1), pivots)
        self.pivots = centres

        def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                far = distances(augmented(_rows(b["v"], 1), most2, centres.shape[1] - 1), centres)
                nearest = np.nan_to_num(far, nan=np.inf).argmin(1)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(nearest.astype(np.int32)), pa.array(far[np.arange(len(far)), nearest])], [*b.schema.names, "pivot", "distance"])

        rows = vectors.select("vec_id", "label", "v")
        kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
        rows = rows.mapInArrow(keyed, f"{kinds}, pivot int, distance double")
        rows = rows.repartitionByRange("pivot", "distance", "vec_id").sortWithinPartitions("pivot", "distance", "vec_id")
        # The place in the order: partitions of a range sort are in order themselves. A segment is of one pivot and one partition.
        at = F.monotonically_increasing_id()
        self.rows, self._rows_path = written(rows.withColumn("segment", at - F.pmod(at, F.lit(segment))), "index")
        keys = self.rows.groupBy("pivot", "segment").agg(F.min("distance").alias("lo"), F.max("distance").alias("hi"))
        self.segments, self._segments_path = written(keys, "segments")
        self.spark = spark

    def close(self) -> None:
        for path in (self._source, self._rows_path, self._segments_path):
            drop(self.spark, path)

    def bounds(self, asked: DataFrame) -> DataFrame:
        """query_id, pivot, segment and the least and most that a vector of the segment can score."""
        most2, pivots = self.most2, self.pivots

        def far(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                v = _rows(b["v"], pivots.shape[1] - 1)
                yield pa.RecordBatch.from_arrays([b["query_id"], pa.array(np.einsum("ij,ij->i", v, v)), pa.array(list(distances(np.concatenate([v, np.zeros((len(v), 1))], 1), pivots)), pa.list_(pa.float64()))], ["query_id", "norm2", "far"])

        rows = asked.select("query_id", "v").mapInArrow(far, "query_id bigint, norm2 double, far array<double>")
        rows = rows.select("query_id", "norm2", F.posexplode("far").alias("pivot", "d")).join(self.segments, "pivot")
        near = F.greatest(F.lit(0.0), F.col("d") - F.col("hi"), F.col("lo") - F.col("d"))
        total = F.lit(most2) + F.col("norm2")
        slack = 1e-6 + 1e-9 * total
        clear = lambda c, other: F.when(F.isnan(c), F.lit(other)).otherwise(c)
        top = clear((total - near * near) / 2 + slack, float("inf"))
        low = clear((total - (F.col("d") + F.col("hi")) * (F.col("d") + F.col("hi"))) / 2 - slack, float("-inf"))
        return rows.select("query_id", "pivot", "segment", F.least(low, F.lit(float(MOST))).alias("least"), top.alias("most"))

    def search(self, asked: DataFrame, k: int, own_label: bool, rounds: tuple[int, ...] = ROUNDS) -> DataFrame:
        """query_id, window, rank, vec_id, score. asked: query_id (unique), label, v and windows, an array of struct<low, high> of longs, null where open."""
        spark = self.spark
        asked, asked_path = written(asked.select("query_id", "label", "v", F.transform("windows", lambda w: F.struct(w["low"].cast("long").alias("low"), w["high"].cast("long").alias("high"))).alias("windows")), "asked")
        parts = max(1, -(-asked.count() // QUERIES))
        plan = self.bounds(asked).withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("most").desc(), "segment")))
        plan, plan_path = written(plan, "plan")
        best, best_path, wanted_path, before = None, None, None, 0
        self.scanned = []
        for upto in (*rounds, None):
            windows = asked.select("query_id", F.posexplode("windows").alias("window", "w")).select("query_id", "window", "w.*")
            if best is not None:
                # The k-th best so far, where there are k, is the least that still counts.
                kth = best.groupBy("query_id", "window").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("kth"))
                windows = windows.join(kth, ["query_id", "window"], "left").withColumn("low", F.greatest("low", "kth")).drop("kth")
            open_ = windows.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("window", "low", "high"))).alias("windows"))
            here = (F.col("place") > before) & (F.col("place") <= upto) if upto else F.col("place") > before
            reaches = F.exists("windows", lambda w: (w["low"].isNull() | (F.col("most") >= w["low"])) & (w["high"].isNull() | (F.col("least") <= w["high"])))
            wanted, wanted_path = written(plan.filter(here).join(open_, "query_id").filter(reaches).select("query_id", "pivot", "segment", "windows"), "wanted")
            n = wanted.count()
            self.scanned.append(n)
            if n:
                found = self._scan(wanted, asked, k, own_label, parts)
                found = found if best is None else best.select(*found.columns).unionByName(found)
                order = Window.partitionBy("query_id", "window").orderBy(F.col("score").desc(), "vec_id")
                done = best_path
                best, best_path = written(found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k), "best")
                drop(spark, done)
            drop(spark, wanted_path)
            before = upto
        drop(spark, plan_path)
        drop(spark, asked_path)
        if best is None:
            return spark.createDataFrame([], "query_id long, window int, rank int, vec_id long, score long")
        return best.select("query_id", "window", "rank", "vec_id", "score")

    def _scan(self, wanted: DataFrame, asked: DataFrame, k: int, own_label: bool, parts: int) -> DataFrame:
        """The k best of each wanted segment for each query and window."""
        part = F.pmod(F.xxhash64("query_id"), F.lit(parts)).cast("int").alias("part")
        queries = wanted.join(asked.select("query_id", "label", "v"), "query_id").select("pivot", "segment", part, F.lit(1).alias("kind"), F.col("query_id").alias("id"), "label", "v", "windows")
        held = queries.select("pivot", "segment", "part").distinct()
        vectors = self.rows.join(held, ["pivot", "segment"]).select("pivot", "segment", "part", F.lit(0).alias("kind"), F.col("vec_id").alias("id"), "label", "v", F.lit(None).cast(queries.schema["windows"].dataType).alias("windows"))
        keys = ["pivot", "segment", "part"]
        stream = vectors.unionByName(queries).repartition(*keys).sortWithinPartitions(*keys, "kind")

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, waiting, segment = None, [], None
            for b in batches:
                names = list(zip(b["pivot"].to_pylist(), b["segment"].to_pylist(), b["part"].to_pylist(), b["kind"].to_pylist()))
                cuts = [i for i, x in enumerate(names) if i == 0 or x != names[i - 1]] + [len(names)]
                for s, e in zip(cuts, cuts[1:]):
                    key, kind, rows = names[s][:3], names[s][3], b.slice(s, e - s)
                    if key != now:
                        now, waiting, segment = key, [], None
                    if kind == 0:
                        waiting.append(rows.select(["id", "label", "v"]))
                    else:
                        if segment is None:
                            held = pa.Table.from_batches(waiting)
                            segment, waiting = (held["id"].to_numpy(), held["label"].to_numpy(), _rows(held["v"], 1)), []
                        yield best_of(segment, rows, k, own_label)

        return stream.mapInArrow(scan, "query_id bigint, window int, vec_id bigint, score bigint")


def best_of(segment: tuple[np.ndarray, np.ndarray, np.ndarray], queries: pa.RecordBatch, k: int, own_label: bool, chunk: int = 512) -> pa.RecordBatch:
    """The k best vectors of a segment for each query and window."""
    ids, labels, v = segment
    out: tuple[list, list, list, list] = ([], [], [], [])
    for at in range(0, queries.num_rows, chunk):
        own = queries.slice(at, chunk)
        q = _rows(own["v"], v.shape[1])
        x = v if v.shape[1] == q.shape[1] else np.pad(v, ((0, 0), (0, q.shape[1] - v.shape[1])))
        if not x.size or not q.size or float(np.abs(x).max()) * float(np.abs(q).max()) * x.shape[1] < 2.0**53:
            scores = (q @ x.T).astype(np.int64)
        else:  # sums that a double may not hold
            big = [[int(y) for y in r] for r in x.tolist()]
            scores = np.array([[max(-MOST - 1, min(MOST, sum(a * int(b) for a, b in zip(r, y)))) for r in big] for y in q.tolist()], np.int64).reshape(len(q), len(x))
        for n, (own_id, label, windows) in enumerate(zip(own["id"].to_pylist(), own["label"].to_pylist(), own["windows"].to_pylist())):
            allowed = ((labels == label) == own_label) & (ids != own_id)
            for w in windows:
                fits = allowed
                if w["low"] is not None:
                    fits = fits & (scores[n] >= w["low"])
                if w["high"] is not None:
                    fits = fits & (scores[n] <= w["high"])
                rows = np.flatnonzero(fits)
                if len(rows) > k:
                    rows = rows[scores[n][rows] >= np.partition(scores[n][rows], -k)[-k]]
                rows = rows[np.lexsort((ids[rows], -scores[n][rows]))[:k]]
                for c, x_ in zip(out, ([own_id] * len(rows), [w["window"]] * len(rows), ids[rows].tolist(), scores[n][rows].tolist())):
                    c.extend(x_)
    return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.int64())], ["query_id", "window", "vec_id", "score"])


def hard_negatives(vectors: DataFrame, anchors: Column, positives: int = 5, k: int = 5, segment: int = SEGMENT, pivots: int = PIVOTS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score. vectors: vec_id, label and v; anchors: which of them are asked for.

    For each anchor (rows of one id are one anchor, the first by label and vector) and each of its best rows of the same label, the best rows of other labels that score from four fifths of the positive's score to all of it.
    """
    index = DistanceIndex(vectors.filter(F.col("label").isNotNull()), segment, pivots)
    first = index.rows.filter(anchors).groupBy(F.col("vec_id").alias("query_id")).agg(F.min(F.struct("label", "v")).alias("_row")).select("query_id", "_row.*")
    near = index.search(first.withColumn("windows", F.array(F.struct(F.lit(None).cast("long").alias("low"), F.lit(None).cast("long").alias("high")))), positives, True)
    near, near_path = written(near.select("query_id", F.col("rank").alias("place"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    # 80 p <= 100 n is n >= p - floor(p / 5); below zero no number is that large and no larger than p.
    p = F.col("positive_score")
    window = F.struct("place", (p - F.expr("(positive_score - pmod(positive_score, 5)) div 5")).alias("low"), p.alias("high"))
    windows = near.filter(p >= 0).groupBy("query_id").agg(F.sort_array(F.collect_list(window)).alias("windows"))  # at most ``positives`` each
    windows, windows_path = written(windows, "windows")
    found = index.search(first.join(windows, "query_id"), k, False)
    places = windows.select("query_id", F.posexplode("windows").alias("window", "w")).select("query_id", "window", F.col("w.place").alias("place"))
    out = found.join(places, ["query_id", "window"]).join(near, ["query_id", "place"])
    out, _ = written(out.select(F.col("query_id").alias("anchor_id"), "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")), "negatives")
    index.close()
    drop(vectors.sparkSession, near_path)
    drop(vectors.sparkSession, windows_path)
    return out


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label")
    return hard_negatives(integers(table(spark, sf_dir, "embeddings"), keep=(moved,)), F.col("vec_id") % 100 == 0)
