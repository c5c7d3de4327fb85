"""Near-duplicate join on word n-grams: MinHash bands for candidates, full sets for proof.

Texts of the same words are one text: a fingerprint of the words groups copies, each group has a
number, and only one row of it goes on. Its MinHash signature is cut into bands whose number and
rows are chosen for a target recall at the threshold. Texts are shuffled on their band hashes;
each bucket is held together by links to its smallest member, so a bucket of any size gives as
many links as members, and components of these links are the groups within which all candidate
pairs lie.

Groups are then verified on full n-gram sets. A group of at most ``BLOCK`` texts is verified
whole, several to a task. A larger one is cut into the buckets that hold it together, so texts
that only a chain of others connects never meet, and a pair counts in the first band that it
agrees in (of buckets with the same texts only the first is sent); or it is taken whole where that sends fewer rows, as in a group of near copies that
meet in every band. What has more than ``BLOCK`` texts is dealt to blocks, each pair of blocks
by itself, so no task holds more than two blocks. Tasks return the number of links of each text
and the components of the links they found, never pairs. A class is a component of proven links.

Words are runs of anything but ASCII white space, in their own case; a text of fewer than n
words has all its words as its only n-gram. Texts without words (and nulls) resemble nothing:
each is its own class without links. Rows count, not ids: repeated rows are copies like any
others, and rows of one id and different texts are different documents, each with its own class
and links. An empty table gives an empty result; extra columns are left alone. Rows without an
id count as copies and have the class of the rest.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.llm.common import cut, salted, spread, table
from sparkloom.llm.components import components

N, THRESHOLD, RECALL, MOST_HASHES = 5, 0.8, 0.9999, 128
BLOCK, SALTS, SHARES, WHOLE, NO_BAND = 1024, 8, 64, 2, -1
MIX = np.uint64(0x9E3779B97F4A7C15)


def bands_for(threshold: float = THRESHOLD, recall: float = RECALL, most: int = MOST_HASHES) -> tuple[int, int]:
    """(bands, rows): the most rows with which that many hashes find a pair at the threshold with the target recall."""
    best = None
    for rows in range(1, 33):
        bands = math.ceil(math.log(1 - recall) / math.log1p(-(threshold**rows)))
        if bands * rows <= most:
            best = (bands, rows)
    if best is None:
        raise ValueError("no bands reach this recall with so few hashes")
    return best


class WordHashes(dict):
    """Hashes of words, kept while there are not too many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def shingles(words: list[bytes], hashes: WordHashes, n: int = N) -> np.ndarray:
    """The sorted distinct hashes of the n-grams."""
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    if not len(h):
        return h
    width = min(n, len(h))
    out = np.zeros(len(h) - width + 1, np.uint64)
    for k in range(width):
        out = (out ^ h[k : k + len(out)]) * MIX
        out ^= out >> np.uint64(29)
    return np.unique(out)


class Signer:
    """MinHash signatures in bands."""

    def __init__(self, bands: int, rows: int, seed: int = 7):
        draw = np.random.default_rng(seed)
        k = bands * rows
        self.a = draw.integers(1, 2**63, k, np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = draw.integers(0, 2**63, k, np.uint64)
        self.shape = (bands, rows)
        self.mix = draw.integers(1, 2**63, (1, rows), np.uint64) * np.uint64(2) + np.uint64(1)
        self.own = draw.integers(0, 2**63, bands, np.uint64)

    def bands(self, s: np.ndarray) -> np.ndarray:
        least = np.full(len(self.a), np.iinfo(np.uint64).max, np.uint64)
        for i in range(0, len(s), 1024):
            least = np.minimum(least, (self.a[:, None] * s[None, i : i + 1024] + self.b[:, None]).min(1))
        least ^= least >> np.uint64(31)
        out = ((least.reshape(self.shape) * self.mix).sum(1, dtype=np.uint64) ^ self.own) * MIX
        return (out ^ (out >> np.uint64(32))).view(np.int64)


def signatures(docs: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """doc_id, text_hash, key (fingerprint of the words, null if there are none), bands."""
    kind = docs.schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, signer, seen = WordHashes(), Signer(bands, rows), {}
        for b in batches:
            keys, out = [], []
            for text in b.column(1).to_pylist():
                words = (text or "").encode().split()
                key = hashlib.blake2b(b" ".join(words), digest_size=16).digest() if words else None
                if words and key not in seen:
                    if len(seen) > 20_000:
                        seen.clear()
                    seen[key] = signer.bands(shingles(words, hashes, n))
                keys.append(key)
                out.append(seen[key] if words else None)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(keys, pa.binary()), pa.array(out, pa.list_(pa.int64()))], ["doc_id", "text_hash", "key", "bands"])

    return docs.select("doc_id", "text", "text_hash").mapInArrow(run, f"doc_id {kind.simpleString()}, text_hash bigint, key binary, bands array<bigint>")


def bucket_links(rows: DataFrame) -> DataFrame:
    """Links (a, b) that hold the members of each bucket (bucket, node) together: to the smallest of their share of the bucket, and from there to the smallest of all. No task needs a whole bucket."""
    share = Window.partitionBy("bucket", "salt")
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SHARES)))
    first = rows.withColumn("hub", F.min("node").over(share))
    hubs = rows.groupBy("bucket", "salt").agg(F.min("node").alias("node"))
    second = hubs.withColumn("hub", F.min("node").over(Window.partitionBy("bucket")))
    links = first.filter("node <> hub").select("node", "hub").unionByName(second.filter("node <> hub").select("node", "hub"))
    return links.select(F.col("node").alias("a"), F.col("hub").alias("b"))


def linked(copies: np.ndarray, sets: list[np.ndarray], side: np.ndarray, threshold: float, bands: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """For each text the documents it is linked to (copies counted), and the first text of its component. side: 0 or 1 where only pairs of different sides count, WHOLE where all do. bands: hashes in which a pair must not agree, for it counts elsewhere."""
    n = len(sets)
    both = bool(n) and side[0] != WHOLE
    if both and (side.all() or not side.any()):
        return np.zeros(n, np.int64), np.arange(n)  # one of the two blocks is empty
    size = np.array([len(s) for s in sets])
    left = np.flatnonzero(side == 0) if both else np.arange(n)
    owner = np.repeat(left, size[left])
    grams = np.concatenate([sets[i] for i in left])
    order = np.argsort(grams, kind="stable")
    grams, owner = grams[order], owner[order]
    links, root = np.zeros(n, np.int64), np.arange(n)

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for j in np.flatnonzero(side == 1) if both else range(n):
        lo, hi = np.searchsorted(grams, sets[j], "left"), np.searchsorted(grams, sets[j], "right")
        count = hi - lo
        total = int(count.sum())
        if not total:
            continue
        at = np.repeat(lo - (np.cumsum(count) - count), count) + np.arange(total)
        shared = np.bincount(owner[at], minlength=n)
        with np.errstate(divide="ignore", invalid="ignore"):
            near = np.flatnonzero((shared > 0) & (shared >= threshold * (size + size[j] - shared) - 1e-9))
        near = near[near != j] if both else near[near < j]
        if bands is not None and len(near):
            near = near[(bands[near] != bands[j]).all(1)]
        links[j] += copies[near].sum()
        links[near] += copies[j]
        for i in near.tolist():
            x, y = find(i), find(int(j))
            if x != y:
                root[max(x, y)] = min(x, y)
    return links, np.array([find(i) for i in range(n)])


def _salted(df: DataFrame) -> DataFrame:
    """df once for each salt, for rows of one key that are dealt to so many shares."""
    return salted(df, SALTS)


def _salt(*cols: str):
    return F.pmod(F.xxhash64(*cols), F.lit(SALTS)).cast("int")


def _blocks(size: str):
    return F.ceil(F.col(size) / BLOCK).cast("int")


def _members(col: str) -> list:
    """What tells sets of numbers apart: their ends and the exact sums of two hashes of each."""
    sums = (F.sum(F.xxhash64(col, F.lit(k)).cast("decimal(38,0)")).alias(a) for k, a in enumerate("xy"))
    return [F.min(col).alias("least"), F.max(col).alias("most"), *sums]


def slots(members: DataFrame) -> DataFrame:
    """members (node, comp, bands, ...) with the groups in which each text is verified: an array of (group, its size, the band of a bucket or NO_BAND)."""
    kind = "array<struct<group:bigint,size:bigint,band:int>>"
    sizes = cut(members.groupBy("comp").agg(F.count(F.lit(1)).alias("size")))
    whole = F.array(F.struct(F.xxhash64("comp").alias("group"), "size", F.lit(NO_BAND).alias("band"))).cast(kind).alias("slots")
    members = members.withColumn("salt", _salt("node"))
    large = sizes.filter(F.col("size") > BLOCK)
    if not large.limit(1).count():
        return members.join(_salted(sizes), ["comp", "salt"]).select(*(c for c in members.columns if c != "salt"), whole)
    # What the buckets of a large group would send, against what the group as a whole does.
    of_large = members.join(large.select("comp"), "comp", "left_semi").select("comp", "node", F.posexplode("bands").alias("band", "bucket"))
    buckets = of_large.groupBy("comp", "band", "bucket").agg(F.count(F.lit(1)).alias("size"), *_members("node")).filter("size > 1")
    # Buckets of the same texts find the same pairs: the first one does.
    buckets = buckets.groupBy("comp", "size", "least", "most", "x", "y").agg(F.min(F.struct("band", "bucket")).alias("first")).select("comp", "first.*", "size")
    cost = buckets.groupBy("comp").agg(F.sum(F.col("size") * _blocks("size")).alias("cost"))
    plan = cut(sizes.join(cost, "comp", "left").select("comp", "size", (F.coalesce("cost", F.lit(0)) < F.col("size") * _blocks("size")).alias("parted")).withColumn("parted", F.col("parted") & (F.col("size") > BLOCK)))
    # Sizes come back over salted keys, as one group or bucket may hold most of the rows.
    planned = members.join(_salted(plan), ["comp", "salt"])
    own = planned.filter("parted").select("node", "comp", "salt", F.posexplode("bands").alias("band", "bucket")).join(_salted(buckets), ["comp", "band", "bucket", "salt"])
    own = own.groupBy("node").agg(F.collect_list(F.struct(F.xxhash64("comp", "band", "bucket").alias("group"), "size", "band")).cast(kind).alias("slots"))
    names = [c for c in members.columns if c != "salt"]
    return planned.filter(~F.col("parted")).select(*names, whole).unionByName(planned.filter("parted").select(*names).join(spread(own), "node"))


def dealt(rows: DataFrame, bins: int) -> DataFrame:
    """rows (node, slots, ...) to the tasks that they take part in: task, group, band and side."""
    rows = rows.withColumn("slot", F.explode("slots")).select("*", "slot.group", "slot.size", "slot.band").drop("slots", "slot")
    rows = rows.withColumn("blocks", _blocks("size")).withColumn("own", F.pmod(F.xxhash64("node", F.lit(1)), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    low, high, single = F.least("own", "other"), F.greatest("own", "other"), F.col("blocks") == 1
    task = F.when(single, F.struct(F.pmod(F.col("group"), F.lit(bins)).alias("x"), F.lit(-1).alias("i"), F.lit(-1).alias("j"))).otherwise(F.struct(F.col("group").alias("x"), low.alias("i"), high.alias("j")))
    return rows.withColumn("task", task).withColumn("side", F.when(single | (low == high), WHOLE).otherwise((F.col("own") == high).cast("int"))).drop("blocks", "own", "other", "size")


def verify(members: DataFrame, texts: DataFrame, n: int, threshold: float, n_members: int) -> DataFrame:
    """(node, n_links, root) of each text and task: members (node, rep, rep_hash, copies, comp, bands), texts (doc_id, text_hash, text)."""
    rows = spread(slots(members)).join(texts, (F.col("rep") == F.col("doc_id")) & (F.col("rep_hash") == F.col("text_hash"))).select("node", "copies", "bands", "slots", "text")
    names = ["node", "copies", "bands", "slots"]

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, seen = WordHashes(), set()
        for b in batches:
            # Repeated rows have one node: one of them is enough.
            once = [i for i, x in enumerate(b.column(0).to_pylist()) if not (x in seen or seen.add(x))]
            own = b.take(pa.array(once, pa.int64()))
            sets = [shingles((t or "").encode().split(), hashes, n).tobytes() for t in own.column(4).to_pylist()]
            yield pa.RecordBatch.from_arrays([*own.columns[:4], pa.array(sets, pa.binary())], [*names, "grams"])

    rows = rows.mapInArrow(grams, "node bigint, copies bigint, bands array<bigint>, slots array<struct<group:bigint,size:bigint,band:int>>, grams binary")
    rows = dealt(rows, max(1, -(-n_members // BLOCK))).withColumn("bands", F.when(F.col("band") > 0, F.col("bands")))

    def check(group: pa.Table) -> pa.Table:
        node, copies, of, side, band = (group[c].to_numpy() for c in ("node", "copies", "group", "side", "band"))
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in group["grams"]]
        hashes = group["bands"].combine_chunks()
        order = np.lexsort((node, of))
        order = order[np.append(True, (np.diff(node[order]) != 0) | (np.diff(of[order]) != 0))]  # repeated rows that other tasks read
        cuts = np.flatnonzero(np.append(True, np.append(np.diff(of[order]) != 0, True)))
        out: list[tuple] = []
        for s, e in zip(cuts, cuts[1:]):
            own = order[s:e]
            before = int(band[own[0]])
            agreed = hashes.take(pa.array(own)).flatten().to_numpy().reshape(len(own), -1)[:, :before] if before > 0 else None
            links, root = linked(copies[own], [sets[i] for i in own], side[own], threshold, agreed)
            out.append((node[own], links, node[own][root]))
        return pa.table({k: pa.array(np.concatenate([o[i] for o in out])) for i, k in enumerate(("node", "n_links", "root"))})

    return rows.groupBy("task").applyInArrow(check, "node bigint, n_links bigint, root bigint")


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """doc_id, text_hash (xxhash64 of the text), class_id (the smallest doc_id of the class), n_links (documents at or above the threshold, copies included), first (whether the row has the id and the text that stand for its class)."""
    bands, rows = bands_for(threshold, recall)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).withColumn("text_hash", F.xxhash64(F.coalesce("text", F.lit(""))))
    signed = cut(signatures(texts, n, bands, rows))
    least = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "text_hash")))
    reps = signed.filter(F.col("key").isNotNull()).groupBy("key").agg(least.alias("least"), F.count(F.lit(1)).alias("copies"), F.min_by("bands", "doc_id").alias("bands"))
    reps = cut(reps.filter(F.col("least").isNotNull()).select("key", F.col("least.doc_id").alias("rep"), F.col("least.text_hash").alias("rep_hash"), "copies", "bands"))
    # Numbers of distinct texts: places in what is written, so they are the same whenever it is read.
    reps = reps.withColumn("node", F.monotonically_increasing_id())
    groups = cut(components(bucket_links(reps.select("node", F.explode("bands").alias("bucket")))))
    members = groups.withColumnRenamed("label", "comp").join(spread(reps.drop("key")), "node")
    found = cut(verify(members, texts, n, threshold, groups.count()))
    links = found.groupBy("node").agg(F.sum("n_links").alias("n"))
    classes = components(found.filter("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")))
    known = reps.drop("bands").join(spread(links), "node", "left").join(spread(classes), "node", "left").withColumn("label", F.coalesce("label", "node"))
    firsts = known.groupBy("label").agg(F.min(F.struct("rep", "rep_hash")).alias("least"))
    known = known.withColumn("salt", _salt("node")).join(_salted(firsts), ["label", "salt"]).select("key", "least", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    # A text may have any number of copies: its class meets them over salted keys.
    out = signed.select("doc_id", "text_hash", "key", _salt("doc_id").alias("salt")).join(_salted(known), ["key", "salt"], "left")
    # Without words, a row stands for itself.
    first = F.coalesce((F.col("doc_id") == F.col("least.rep")) & (F.col("text_hash") == F.col("least.rep_hash")), F.col("least").isNull())
    return out.select("doc_id", "text_hash", F.coalesce("least.rep", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), first.alias("first"))


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")
