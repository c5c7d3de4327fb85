"""Exact top-k by inner product over an impact-ordered index, score at a time.

Vectors are dealt into blocks by a hash of their id. Each block has its own index: for each
dimension, postings of the vectors' components quantised into levels, so a segment is the list
of vectors with one level in one dimension. A query counts what a vector has beyond the least
possible score (for a negative weight the smallest components come first), so impacts are whole
multiples of a unit, and works through the segments of all dimensions by falling impact. A
vector's score then lies between what it has got so far and that plus what is left: for each
dimension the impact of the next segment, or one level where none is left. Processing stops
only once that proves that no more than a few vectors can still be among the k best; those are
scored exactly from their integers. Ties go
to the smaller id. Blocks give k candidates for each query, and the k best of those are exact.

Every query first meets one block, which gives it a k-th best score; the other blocks then leave
out at once what can't reach that. A task reads a block's vectors, then its queries as they come, so it holds one block and one
batch of queries, and vectors are sent once for each ``QUERIES`` queries. Blocks are of vectors of about one length, so a long
one widens no others than those like it. Rows without an id and vectors that are null or hold a null or non-finite
component take no part; shorter vectors count as zero beyond their end; empty vectors score 0;
repeated rows are candidates each, but never of a query with their own id; an empty table gives
an empty result; extra columns are left alone. Where sums could pass 64 bits they are taken in
integers of any size; a score beyond a long counts as the nearest long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.llm.common import table, written

BLOCK, QUERIES, LEVELS, K = 8192, 65_536, 64, 5
#: Shares of the segments after which the proof is tried.
SHARES = (0.65, 0.8, 0.9, 1.0)


class ImpactIndex:
    """The postings of a block. Dimension d has levels of one width; its postings are sorted by level, so segment (d, j), the vectors with level j, is docs[d, first[d, j] : first[d, j + 1]]."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, levels: int = LEVELS):
        self.ids, self.vectors, self.levels = ids, vectors, levels
        n, dims = vectors.shape
        self.low = vectors.min(0).astype(np.float64)
        self.width = np.maximum(vectors.max(0) - self.low, 1.0) / levels
        level = np.minimum(((vectors - self.low) / self.width).astype(np.int64), levels - 1).T
        self.docs = np.argsort(level, 1, kind="stable")
        self.level = np.take_along_axis(level, self.docs, 1).astype(np.float64)
        self.first = np.stack([np.searchsorted(x, np.arange(levels + 1)) for x in self.level])

    def search(self, own: int, query: np.ndarray, k: int, floor: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The rows of the k best vectors with another id and a score of at least ``floor``, and their scores. ``segments`` counts what was read of the last query."""
        n, levels = len(self.ids), self.levels
        unit = np.abs(query) * self.width  # what one level of a dimension is worth
        used = np.flatnonzero(unit)
        # The greatest impact of a segment is its level (from the top for negative weights) plus one, times the unit.
        greatest = np.sort((unit[used][:, None] * np.arange(1, levels + 1)).ravel())[::-1]
        allowed = self.ids != own
        members, few = np.flatnonzero(allowed), max(8 * k, n // 32)
        got, done = np.zeros(n), np.full(len(unit), levels)
        # What the least possible vector scores: what a vector has got is beyond that.
        base = float((self.low * query).sum() + np.minimum(query * self.width * levels, 0).sum())
        self.segments = 0
        for share in SHARES if len(members) > few and len(used) else ():
            impact = greatest[min(int(share * len(greatest)), len(greatest) - 1)] if share < 1 else 0.0
            docs, impacts = [], []
            for d in used:
                # Segments of levels [to, done) have a greatest impact above that and come now.
                to = min(int(impact / unit[d]), done[d])
                self.segments += int(done[d] - to)
                a, b = (self.first[d, to], self.first[d, done[d]]) if query[d] > 0 else (self.first[d, levels - done[d]], self.first[d, levels - to])
                docs.append(self.docs[d, a:b])
                impacts.append((self.level[d, a:b] if query[d] > 0 else levels - 1 - self.level[d, a:b]) * unit[d])
                done[d] = to
            got += np.bincount(np.concatenate(docs), np.concatenate(impacts), n)
            # What a vector may have beyond this: the next segment of a dimension that it has not been met in, and no more than a level where it has.
            left = (np.maximum(done, 1) * unit).sum() * (1 + 1e-9)
            least = np.partition(got[members], -k)[-k]
            if floor is not None:
                least = max(least, (floor - base) * (1 - 1e-9) - 1e-6 * abs(base) - 1)
            members = members[got[members] + left >= least]
            if len(members) <= few:
                break
        scores = self.vectors[members] @ query
        if floor is not None:
            members, scores = members[scores >= floor], scores[scores >= floor]
        best = np.lexsort((self.ids[members], -scores))[:k]
        return members[best], scores[best]


def integers(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256, keep: tuple[Column, ...] = ()) -> DataFrame:
    """vec_id, v, the floors of scale (a power of two) times the components as doubles that hold them exactly, and what else is kept, of vectors that are whole and finite. Rows without an id take no part."""
    big = lambda x: F.abs(x.cast("double")) < F.lit(float("inf"))
    sound = F.col(vector_col).isNotNull() & F.forall(vector_col, lambda x: x.isNotNull() & big(x))
    # From 2 ** 53 on a double is an integer already; in between, floor gives a long.
    whole = lambda y: F.when(F.abs(y) < 2.0**53, F.floor(y).cast("double")).otherwise(y)
    return vectors.filter(sound & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(vector_col, lambda x: whole(scale * x.cast("double"))).alias("v"), *keep)


def _matrix(lists: list, dims: int) -> np.ndarray:
    """Integers of 64 bits, or of any size where 64 bits would not do for all sums of products."""
    out = np.zeros((len(lists), dims))
    for i, x in enumerate(lists):
        out[i, : len(x)] = x
    if not len(out) or not dims or np.abs(out).max() ** 2 * dims < 2.0**62:
        return out.astype(np.int64)
    return np.array([[int(y) for y in x] for x in out.tolist()], object).reshape(out.shape)


class Block:
    """The vectors of a block, with their index once a query asks for it."""

    def __init__(self, ids: np.ndarray, lists: list):
        # What a query holds beyond the longest vector meets zeros.
        self.ids, self.dims = ids, max(1, *map(len, lists))
        self.vectors = _matrix(lists, self.dims)
        self.most = float(np.abs(self.vectors).max())
        self.index: ImpactIndex | None = None

    def search(self, own: int, query: list, k: int, floor: int | None) -> tuple[list, list]:
        """Ids and scores of the k best."""
        q = _matrix([query[: self.dims]], self.dims)[0]
        if object in (self.vectors.dtype, q.dtype) or self.most * float(np.abs(q).max(initial=0)) * self.dims >= 2.0**62:
            exact = self.vectors.astype(object) @ q.astype(object)
            scores = [max(-(2**63), min(2**63 - 1, int(x))) for x in exact]
            rows = sorted(np.flatnonzero(self.ids != own).tolist(), key=lambda i: (-scores[i], self.ids[i]))[:k]
            return self.ids[rows].tolist(), [scores[i] for i in rows]
        self.index = self.index or ImpactIndex(self.ids, self.vectors)
        rows, scores = self.index.search(own, q, k, floor)
        return self.ids[rows].tolist(), scores.tolist()


def _scan(vectors: DataFrame, asked: DataFrame, k: int, tasks: int) -> DataFrame:
    """query_id, vec_id, score of the k best of each block for each query. vectors: block, part, vec_id, v; asked: also floor, a score that results must reach."""
    both = vectors.select("block", "part", F.lit(0).alias("kind"), "vec_id", "v", F.lit(None).cast("long").alias("floor"))
    both = both.unionByName(asked.select("block", "part", F.lit(1).alias("kind"), "vec_id", "v", "floor"))
    stream = both.repartition(tasks, "block", "part").sortWithinPartitions("block", "part", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, waiting, block = None, [], None
        for b in batches:
            keys = list(zip(b["block"].to_pylist(), b["part"].to_pylist(), b["kind"].to_pylist()))
            cuts = [i for i, x in enumerate(keys) if i == 0 or x != keys[i - 1]] + [len(keys)]
            out: tuple[list, list, list] = ([], [], [])
            for s, e in zip(cuts, cuts[1:]):
                key, kind, rows = keys[s][:2], keys[s][2], b.slice(s, e - s)
                if key != now:
                    now, waiting, block = key, [], None
                if kind == 0:
                    waiting.append(rows.select(["vec_id", "v"]))
                    continue
                if waiting:
                    held = pa.Table.from_batches(waiting)
                    block, waiting = Block(held["vec_id"].to_numpy(), held["v"].to_pylist()), []
                for own, v, floor in zip(rows["vec_id"].to_pylist(), rows["v"].to_pylist(), rows["floor"].to_pylist()) if block else ():
                    ids, scores = block.search(own, v, k, floor)
                    for c, x in zip(out, ([own] * len(ids), ids, scores)):
                        c.extend(x)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["query_id", "vec_id", "score"])

    return stream.mapInArrow(run, "query_id long, vec_id long, score long")


def exact_top_k(vectors: DataFrame, queries: DataFrame, k: int = K, block: int = BLOCK, stats: dict | None = None) -> DataFrame:
    """query_id, rank, vec_id, score. Both frames have vec_id and v; a query's id is its own. ``stats`` gets the rows sent."""
    # Blocks of one width, from one power of two to the next: their numbers, a row for each width.
    width = F.ceil(F.log2(F.size("v") + F.lit(1))).cast("int")
    sizes = {r["width"]: r["count"] for r in vectors.groupBy(width.alias("width")).count().collect()}
    parts, blocks, of = max(1, -(-queries.count() // QUERIES)), 0, F.lit(0)
    for w, n in sorted(sizes.items()):
        own = -(-n // block)
        of = F.when(width == w, F.lit(blocks) + F.pmod(F.xxhash64("vec_id", "v"), F.lit(own))).otherwise(of)
        blocks += own
    blocks = max(1, blocks)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    rows = vectors.withColumn("block", of.cast("int")).withColumn("part", every(parts))
    asked = queries.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(parts)).cast("int")).withColumn("first", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(blocks)).cast("int"))
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    top = lambda df: df.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    first = _scan(rows, asked.select("vec_id", "v", "part", F.col("first").alias("block"), F.lit(None).cast("long").alias("floor")), k, blocks * parts)
    if blocks == 1:
        return top(first).select("query_id", "rank", "vec_id", "score")
    first, _ = written(top(first).drop("rank"), "first")
    # Rows of one id ask alike, so a floor is the k-th of all their candidates only where there is one of them.
    kth = first.groupBy("query_id").agg(F.when(F.count(F.lit(1)) == k, F.min("score")).alias("floor"))
    rest = asked.join(kth, F.col("vec_id") == F.col("query_id"), "left").withColumn("block", every(blocks)).filter(F.col("block") != F.col("first"))
    if stats is not None:
        stats |= {"vectors": rows.count(), "queries": asked.count() + rest.count()}
    found = first.unionByName(_scan(rows, rest, k, blocks * parts))
    return top(found).select("query_id", "rank", "vec_id", "score")


def op4_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = integers(table(spark, sf_dir, "embeddings"))
    return exact_top_k(vectors, vectors.filter(F.col("vec_id") % 50 == 0))
