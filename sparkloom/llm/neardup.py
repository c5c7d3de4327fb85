"""Near-duplicate embeddings by randomised-rotation binary codes with correction factors.

Equal vectors of one label are one vector with a number of copies. A unit vector is turned by a
random rotation; its code is the signs of the turned components, and its correction factor is
the inner product of the vector with the corner of the cube that the code names. The inner product
of a code's corner with another turned vector, divided by the factor, estimates the cosine without bias,
and its error has a standard deviation of sqrt((1 - f^2) / f^2 / (width - 1)). A pair is
recomputed in double precision only where the estimate plus ``SIGMAS`` of these reaches the threshold; all
others are out. At 6 such deviations the bound fails for about one pair in 10^9.

Vectors meet within buckets. A label whose vectors fit one block is one bucket. A larger one is
dealt by bands of further random signs: as many bits as it takes to bring a bucket down to a block
(their number grows with the logarithm of the label's size), in as many bands as find a pair at
the threshold with the target recall. So the work grows as n log n, save for what really is
alike. A pair counts in the first band it agrees in. A bucket of more than a block, as one of thousands
of near copies, is dealt to blocks, each pair of blocks a task. Tasks return the number of links of
each vector and the components of the links they found, never pairs.

Only vectors of one label and one length are compared. Vectors that are null, zero or hold a null
or non-finite component, and those without a label, link with nothing and are their own component.
Rows count, not ids: repeated rows are links of each other. Rows without an id count as links, have
the component of the rest and are never kept. An empty table gives an empty result; extra columns are left alone.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.common import drop, salt, salted, table, written
from sparkloom.llm.components import components

THRESHOLD, RECALL, SIGMAS = 0.98, 0.9999, 6.0
#: Components in a block of vectors: 8,192 vectors of 64.
BLOCK = 1 << 19
CHUNK = 256


class Rotation:
    """A random rotation of vectors of one length, padded to a power of two: signs and Hadamard transforms in turn."""

    def __init__(self, dims: int, seed: int = 11):
        self.width = max(64, 1 << max(dims - 1, 0).bit_length())
        self.signs = np.random.default_rng(seed).integers(0, 2, (3, self.width)) * 2.0 - 1.0

    def __call__(self, units: np.ndarray) -> np.ndarray:
        x = np.zeros((len(units), self.width))
        x[:, : units.shape[1]] = units
        for signs in self.signs:
            x *= signs
            half = 1
            while half < self.width:
                y = x.reshape(len(x), -1, 2, half)
                x = np.stack((y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]), 2).reshape(len(x), -1)
                half *= 2
            x /= math.sqrt(self.width)
        return x


def code(turned: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed signs and the correction factor of each turned unit vector."""
    return np.packbits(turned >= 0, axis=1), np.abs(turned).sum(1) / math.sqrt(turned.shape[1])


def estimates(turned: np.ndarray, codes: np.ndarray, factors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Estimates of the cosines of turned vectors (rows) with coded ones (columns), and the standard deviation for each of the latter. The signs are unpacked for one product in single precision, which costs numpy less than counting the bits of planes."""
    width = turned.shape[1]
    signs = np.unpackbits(codes, axis=1, count=width).astype(np.float32) * 2 - 1
    found = turned.astype(np.float32) @ signs.T
    found *= (1 / (math.sqrt(width) * factors)).astype(np.float32)
    return found, np.sqrt(np.maximum(1 - factors**2, 0) / factors**2 / (width - 1))


def bands_for(bits: int, threshold: float, recall: float) -> int:
    """Bands of so many sign bits that find a pair at the threshold with the target recall."""
    agree = (1 - math.acos(threshold) / math.pi) ** bits
    return 1 if bits == 0 else max(1, math.ceil(math.log(1 - recall) / math.log1p(-agree)))


def band_hashes(units: np.ndarray, bits: int, threshold: float, recall: float, seed: int = 13) -> np.ndarray:
    """A hash of each band of sign bits, for each vector."""
    n = bands_for(bits, threshold, recall)
    if not bits:
        return np.zeros((len(units), 1), np.int64)
    draw = np.random.default_rng(seed)
    out = np.empty((len(units), n), np.int64)
    for k in range(n):
        out[:, k] = (units @ draw.standard_normal((units.shape[1], bits)) >= 0) @ (1 << np.arange(bits, dtype=np.int64))
    return out


def unit(vectors: np.ndarray) -> np.ndarray:
    """Unit vectors in double precision, of components of any finite size."""
    x = vectors.astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _matrix(column: pa.ChunkedArray | pa.Array, dims: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def linked(vectors: np.ndarray, codes: np.ndarray, factors: np.ndarray, copies: np.ndarray, second: np.ndarray, bands: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, int]:
    """For each vector the rows it is linked to, copies counted, and the first vector of its component; and how many pairs were recomputed. second: None where all pairs count, or which vectors are in the second block, where only pairs of both do. bands: hashes of the bands before this one, in which a pair must not agree."""
    n, units = len(vectors), unit(vectors)
    links, root, exact = np.zeros(n, np.int64), np.arange(n), 0
    if n < 2:
        return links, root, exact
    turned = Rotation(units.shape[1])(units)
    asked = np.arange(n) if second is None else np.flatnonzero(~second)
    others = np.arange(n) if second is None else np.flatnonzero(second)
    for at in range(0, len(asked), CHUNK):
        own = asked[at : at + CHUNK]
        cols = others[at + 1 :] if second is None else others  # of a block with itself, only those further on
        if not len(cols):
            continue
        found, deviation = estimates(turned[own], codes[cols], factors[cols])
        i, j = np.nonzero(found >= (threshold - SIGMAS * deviation - 1e-5).astype(np.float32))
        i, j = own[i], cols[j]
        if second is None:
            i, j = i[i < j], j[i < j]
        if bands.shape[1] and len(i):
            new = np.concatenate([(bands[i[s : s + CHUNK**2]] != bands[j[s : s + CHUNK**2]]).all(1) for s in range(0, len(i), CHUNK**2)])
            i, j = i[new], j[new]
        exact += len(i)
        near = [np.einsum("ij,ij->i", units[i[s : s + 4 * CHUNK]], units[j[s : s + 4 * CHUNK]]) >= threshold for s in range(0, len(i), 4 * CHUNK)]
        near = np.concatenate(near) if near else np.zeros(0, bool)
        i, j = i[near], j[near]
        links += np.bincount(i, copies[j], n).astype(np.int64) + np.bincount(j, copies[i], n).astype(np.int64)
        cuts = np.flatnonzero(np.append(True, i[1:] != i[:-1])) if len(i) else []
        for s, e in zip(cuts, [*cuts[1:], len(i)]):
            labels = np.unique(np.append(root[j[s:e]], root[i[s]]))
            if len(labels) > 1:
                root[np.isin(root, labels[1:])] = labels[0]
    return links, root, exact


def encoded(members: DataFrame, threshold: float, recall: float) -> DataFrame:
    """members (.., vector, dims, bits) with code, factor and bands."""
    names = [c for c in members.columns if c != "bits"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turns: dict[int, Rotation] = {}
        for whole in batches:
            shapes = list(zip(whole["dims"].to_pylist(), whole["bits"].to_pylist()))
            for dims, bits in sorted(set(shapes)):
                b = whole.take(pa.array([k for k, s in enumerate(shapes) if s == (dims, bits)], pa.int64()))
                units = unit(_matrix(b["vector"], dims))
                codes, factors = code(turns.setdefault(dims, Rotation(dims))(units))
                hashes = band_hashes(units, bits, threshold, recall)
                yield pa.RecordBatch.from_arrays([*(b[c] for c in names), pa.array([x.tobytes() for x in codes], pa.binary()), pa.array(factors), pa.array(list(hashes), pa.list_(pa.int64()))], [*names, "code", "factor", "bands"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in members.schema if f.name in names)
    return members.mapInArrow(run, f"{kinds}, code binary, factor double, bands array<bigint>")


def links(coded: DataFrame, threshold: float) -> DataFrame:
    """node, n_links, root of each vector and task that found a link."""
    keys = ["label", "dims", "band", "bucket"]
    rows = coded.select("*", F.posexplode("bands").alias("band", "bucket")).withColumn("bands", F.when(F.col("band") > 0, F.slice("bands", F.lit(1), F.col("band"))))
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    rows = rows.withColumn("salt", salt("node")).join(salted(sizes), [*keys, "salt"]).drop("salt")
    blocks = F.ceil(F.col("size") / F.col("block")).cast("int")
    rows = rows.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("node", F.lit(1)), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other"))
    rows = rows.withColumn("second", F.when(F.col("i") != F.col("j"), F.col("own") == F.col("j")))

    def check(group: pa.Table) -> pa.Table:
        node, copies, factors = (group[c].to_numpy() for c in ("node", "copies", "factor"))
        dims, band = group["dims"][0].as_py(), group["band"][0].as_py()
        # Rows of one node that another attempt has sent again count once.
        once = np.unique(node, return_index=True)[1]
        group, node, copies, factors = group.take(pa.array(once)), node[once], copies[once], factors[once]
        codes = np.frombuffer(b"".join(group["code"].to_pylist()), np.uint8).reshape(len(node), -1)
        second = None if group["second"][0].as_py() is None else group["second"].to_numpy().astype(bool)
        before = _matrix(group["bands"], band) if band else np.zeros((len(node), 0), np.int64)
        n, root, _ = linked(_matrix(group["vector"], dims), codes, factors, copies, second, before, threshold)
        some = np.flatnonzero((n > 0) | (root != np.arange(len(node))))
        return pa.table({"node": node[some], "n_links": n[some], "root": node[root[some]]})

    tasks = ["label", "dims", "band", "bucket", "i", "j"]
    return rows.select(*tasks, "node", "copies", "vector", "code", "factor", "bands", "second").groupBy(*tasks).applyInArrow(check, "node bigint, n_links bigint, root bigint")


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id and kept of each row of vectors."""
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    sound = F.col("label").isNotNull() & F.col("vector").isNotNull() & finite & F.exists("vector", lambda x: x != 0)
    # Two chained hashes tell vectors apart; those that differ only by the sign of a zero stay two vectors and are linked.
    keyed = rows.withColumn("key", F.when(F.coalesce(sound, F.lit(False)), F.struct(F.xxhash64("label", "vector").alias("x"), F.xxhash64(F.lit(2), "vector", "label").alias("y"))))
    reps = keyed.filter(F.col("key").isNotNull()).groupBy("key").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("copies"), F.first("label").alias("label"), F.first("vector").alias("vector"))
    # Numbers of distinct vectors: places in what is written, so they are the same whenever it is read.
    reps, reps_path = written(reps.select("*", F.size("vector").alias("dims"), F.monotonically_increasing_id().alias("node")), "vectors")
    sizes = reps.groupBy("label", "dims").agg(F.count(F.lit(1)).alias("n")).withColumn("block", F.greatest(F.lit(16), F.floor(F.lit(block) / F.col("dims")).cast("int")))
    sizes = sizes.withColumn("bits", F.greatest(F.lit(0), F.ceil(F.log2(F.col("n") / F.col("block"))).cast("int"))).drop("n")
    members = reps.select("node", "copies", "label", "dims", "vector", salt("node").alias("salt")).join(salted(sizes), ["label", "dims", "salt"]).drop("salt")
    coded, coded_path = written(encoded(members, threshold, recall), "codes")
    found, found_path = written(links(coded, threshold), "links")
    classes = components(found.filter("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")))
    counts = found.groupBy("node").agg(F.sum("n_links").alias("n"))
    known = reps.select("key", "node", "least", "copies").join(counts, "node", "left").join(classes, "node", "left").withColumn("label", F.coalesce("label", "node"))
    firsts = known.groupBy("label").agg(F.min("least").alias("first"))
    known = known.withColumn("salt", salt("node")).join(salted(firsts), ["label", "salt"]).select("key", "first", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = keyed.select("vec_id", "key", salt("vec_id").alias("salt")).join(salted(known), ["key", "salt"], "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("first", "vec_id").alias("component_id"))
    out, _ = written(out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False))), "near")
    for path in (reps_path, coded_path, found_path):
        drop(vectors.sparkSession, path)
    return out


def op11_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))
