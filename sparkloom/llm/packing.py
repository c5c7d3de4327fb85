"""Bulk-synchronous best-fit packing of tokenised documents.

Every document becomes pieces of at most ``limit`` tokens. The pieces are range-sorted by
length, longest first, which gives each one its rank among those of its length. Supersteps
then match lengths with gaps: a sweep in falling order looks up, for each run of equal pieces,
its successor among the gaps, the smallest one that holds it; where several pieces meet one
class of gaps, rank decides which piece gets which gap; the gaps shrink and the sweep goes on
until the run is placed, in new sequences where no gap is left. Pieces of one length and gaps
of one size are interchangeable, so both sorted lists are held run-length encoded: at most
``limit`` runs of pieces, and of gaps as classes of consecutive sequence numbers. A sweep costs
the driver the same for any number of documents, and what it yields are intervals (length,
ranks) -> (sequence numbers, offset), which the executors apply to their sorted pieces. No
document, piece or sequence is ever collected.

Null texts are empty and have the end token alone; repeated rows are packed one by one; an
empty table gives an empty result; extra columns are left alone.
"""

from __future__ import annotations

import bisect
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.llm.common import cut, drop, table, written
from sparkloom.llm.tokens import encode_whole, encoder

LIMIT, END_ID = 2048, 0


def pieces(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT, end_id: int = END_ID, added_tokens: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of all documents; only those over the limit are cut, the short piece first. With ``added_tokens`` those of the vocabulary are found in texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = (lambda text: encode_whole(vocabulary, text)) if added_tokens else encoder(vocabulary).encode_ordinary
        for b in batches:
            rows, piece, start, length, crc = [], [], [], [], []
            for i, text in enumerate(b.column(1).to_pylist()):
                ids = np.array([*encode(text or ""), end_id], "<u4")
                first = (len(ids) - 1) % limit + 1
                cuts = [0, *range(first, len(ids) + 1, limit)]
                for k, (s, e) in enumerate(zip(cuts, cuts[1:])):
                    rows.append(i)
                    piece.append(k)
                    start.append(s)
                    length.append(e - s)
                    crc.append(zlib.crc32(ids[s:e].tobytes()))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))], ["doc_id", "piece", "start", "length", "ids_crc32"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, piece int, start bigint, length bigint, ids_crc32 bigint")


class Gaps:
    """Classes of sequences by the room left in them, each a list of ranges of sequence numbers."""

    def __init__(self, limit: int):
        self.limit, self.ranges, self.sizes, self.next = limit, defaultdict(list), [], 0

    def successor(self, length: int) -> int | None:
        """The smallest size of gap that holds the length."""
        i = bisect.bisect_left(self.sizes, length)
        return self.sizes[i] if i < len(self.sizes) else None

    def add(self, size: int, first: int, n: int) -> None:
        if size:
            if not self.ranges[size]:
                bisect.insort(self.sizes, size)
            self.ranges[size].append((first, n))

    def take(self, size: int, most: int) -> tuple[int, int]:
        """A range of at most that many sequences of the class."""
        first, n = self.ranges[size].pop()
        if n > most:
            self.ranges[size].append((first, n - most))
            first, n = first + n - most, most
        if not self.ranges[size]:
            self.sizes.remove(size)
        return first, n

    def open(self, n: int) -> int:
        first, self.next = self.next, self.next + n
        return first


def sweeps(counts: dict[int, int], limit: int = LIMIT) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, number, first sequence, offset, times): ``number`` pieces from that rank on go to sequences in order, ``times`` to each, one behind the other.

    Just what best-fit does with pieces in falling order, one by one: equal pieces fill the smallest gap that
    holds one until it holds no more, for it stays the smallest, and then the next.
    """
    gaps, out = Gaps(limit), []
    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            size = gaps.successor(length)
            times = min(left, (limit if size is None else size) // length)
            most = left // times
            first, n = (gaps.open(most), most) if size is None else gaps.take(size, most)
            size = limit if size is None else size
            out.append((length, rank, n * times, first, limit - size, times))
            gaps.add(size - times * length, first, n)
            rank, left = rank + n * times, left - n * times
    return out


def pack(cut_pieces: DataFrame, limit: int = LIMIT) -> DataFrame:
    """The pieces (doc_id, piece, length, ...) with sequence_id and offset."""
    keys = [F.col("length").desc(), F.col("doc_id"), F.col("piece")]
    # Finding the ranges samples the pieces; they are written first, so that no text is encoded twice.
    cut_pieces = cut(cut_pieces)
    # The order within a partition is part of what is written, so ranks hold whichever executor reads it again.
    ranked = cut(cut_pieces.repartitionByRange(*keys).sortWithinPartitions(*keys))
    ranked = ranked.withColumn("_part", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))
    # Partitions hold consecutive lengths, so there are at most limit + partitions of these runs.
    runs = sorted(ranked.groupBy("_part", "length").agg(F.count(F.lit(1)).alias("n"), F.min("_row").alias("row")).collect(), key=lambda r: r["_part"])
    counts: dict[int, int] = defaultdict(int)
    before: dict[tuple[int, int], int] = {}
    for r in runs:
        before[r["_part"], r["length"]] = counts[r["length"]] - r["row"]
        counts[r["length"]] += r["n"]
    plan: dict[int, list[np.ndarray]] = {}
    for length, rank, _, first, offset, times in sweeps(counts, limit):
        plan.setdefault(length, []).append((rank, first, offset, times))
    plan = {k: np.array(v, np.int64) for k, v in plan.items()}
    names = cut_pieces.columns

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, part, row = (b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("length", "_part", "_row"))
            sequence, offset = np.empty(len(row), np.int64), np.empty(len(row), np.int64)
            for size in np.unique(length):
                own = np.flatnonzero(length == size)
                rank = row[own] + before[int(part[own[0]]), int(size)]
                steps = plan[int(size)]
                at = np.searchsorted(steps[:, 0], rank, "right") - 1
                nth = rank - steps[at, 0]
                sequence[own] = steps[at, 1] + nth // steps[at, 3]
                offset[own] = steps[at, 2] + nth % steps[at, 3] * size
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in names), pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut_pieces.schema)
    return ranked.mapInArrow(place, f"{kinds}, sequence_id bigint, offset bigint")


def best_fit(docs: DataFrame, vocabulary: str | None = None, added_tokens: bool = False) -> DataFrame:
    return pack(pieces(docs, vocabulary or public_tokenizers.path("byte_bpe_50k.json"), added_tokens=added_tokens))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit(table(spark, sf_dir, "documents"), added_tokens=True)


def sweep(pieces: DataFrame, gaps: DataFrame) -> DataFrame:
    """(piece_id, sequence_id): each gap with the largest piece that it holds and no smaller gap has taken, each piece once. pieces: piece_id, length; gaps: sequence_id, room.

    Both are range-sorted by size in one table, where a piece opens and a gap closes a bracket: brackets that belong
    together have one depth and nothing of that depth between them. Depths are running sums, of which one number a
    partition goes to the driver; conflicts for a gap are settled by rank within a depth.
    """
    both = pieces.select("length", F.lit(0).alias("kind"), F.col("piece_id").alias("id")).unionByName(gaps.select(F.col("room").alias("length"), F.lit(1).alias("kind"), F.col("sequence_id").alias("id")))
    keys = ["length", "kind", "id"]
    rows = both.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("at", F.monotonically_increasing_id())
    rows, path = written(rows.withColumn("part", F.shiftright("at", 33)), "brackets")
    sums = {r["part"]: r["d"] for r in rows.groupBy("part").agg(F.sum(F.when(F.col("kind") == 0, 1).otherwise(-1)).alias("d")).collect()}
    before, total = [], 0
    for k in range(max(sums, default=0) + 1):
        before.append(total)
        total += sums.get(k, 0)
    step = F.when(F.col("kind") == 0, 1).otherwise(-1)
    depth = F.sum(step).over(Window.partitionBy("part").orderBy("at")) + F.get(F.lit(before), F.col("part").cast("int")) - F.when(F.col("kind") == 0, 1).otherwise(0)
    same = Window.partitionBy("depth").orderBy("at")
    rows = rows.withColumn("depth", depth).withColumn("next", F.lead(F.struct("kind", "id")).over(same))
    found, _ = written(rows.filter((F.col("kind") == 0) & (F.col("next.kind") == 1)).select(F.col("id").alias("piece_id"), F.col("next.id").alias("sequence_id")), "matched")
    drop(pieces.sparkSession, path)
    return found


def pack_by_sweeps(pieces: DataFrame, limit: int = LIMIT, stats: dict | None = None, most: int | None = None) -> DataFrame:
    """(piece_id, sequence_id, offset) of pieces (piece_id, length) by sweeps over tables of pieces and of gaps: sizes from one half of the limit to the next at a time, the largest first; where no gap holds a piece that is left, as many sequences are opened as the rest would fill. ``most`` bounds the sweeps, for measuring.

    README has what this costs beside ``pack``: a gap takes one piece a sweep, so small pieces take many.
    """
    spark = pieces.sparkSession
    pieces = cut(pieces.select("piece_id", "length"))
    gaps, opened, done, sweeps_made = spark.createDataFrame([], "sequence_id long, room long"), 0, None, 0
    high = limit
    while high:
        low = high // 2
        rest = pieces.filter((F.col("length") > low) & (F.col("length") <= high))
        while (left := rest.agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("s")).first())["n"]:
            if most is not None and sweeps_made >= most:
                high = 0
                break
            sweeps_made += 1
            found = sweep(rest, gaps.filter(F.col("room") > low))
            n = found.count()
            if not n:
                more = -(-left["s"] // limit)
                new = spark.range(opened, opened + more).select(F.col("id").alias("sequence_id"), F.lit(limit).cast("long").alias("room"))
                gaps, opened = cut(gaps.unionByName(new)), opened + more
                continue
            placed = rest.join(found, "piece_id").join(gaps, "sequence_id").select("piece_id", "sequence_id", "length", (F.lit(limit) - F.col("room")).alias("offset"))
            placed = cut(placed)
            done = placed if done is None else done.unionByName(placed)
            gaps = cut(gaps.join(placed.select("sequence_id", "length"), "sequence_id", "left").select("sequence_id", (F.col("room") - F.coalesce("length", F.lit(0))).alias("room")))
            rest = cut(rest.join(found, "piece_id", "left_anti"))
        high = low if high else 0
    if stats is not None:
        stats |= {"sweeps": sweeps_made, "sequences": opened}
    return done.select("piece_id", "sequence_id", "offset") if done is not None else spark.createDataFrame([], "piece_id long, sequence_id long, offset long")
