"""Byte-level BPE: ranked merges folded over the byte arrays of distinct words.

Texts are split by the vocabulary's pattern in batches; each batch keeps its distinct words
once, as arrays of bytes, and its texts as places in that list. The merges are a fold: at each
step the pair of lowest rank in a word, the leftmost of these, is replaced by its merged token,
until no pair has a rank. Ranks come from a literal map of pairs of ids: a hash table in which
each pair has one of two places, so a lookup is two array reads whatever the vocabulary.
Decoding concatenates the binary pieces of the ids.

There are two forms of the fold with the same results. ``encode_word`` and ``decode_ids`` are
Spark's higher-order functions over one word; ``fold`` takes the same steps for all distinct
words of a batch at once, and is what ``bpe`` uses, for the reason given in the README. Nothing
is shuffled and batches are bounded in bytes, so memory is as well; a single text is never split.

Null texts count as empty and have no ids; repeated rows are encoded one by one; an empty table
gives an empty result; extra columns are left alone.
"""

from __future__ import annotations

import base64
import functools
import heapq
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.common import table

#: Entries of the pair table, a prime, and the factors of its two hash functions.
SLOTS, FACTORS = 786_433, ((40_503, 31), (7_919, 64_007))
NONE = 65_536
#: A free place: no pair's entry, and far above any.
FREE = 1 << 60
#: Bytes beyond which a word is folded by itself.
LONG = 200
BATCH_CHARS = 12_000_000


@functools.cache
def ranks_of(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@functools.cache
def pair_table(path: str) -> np.ndarray:
    """The pairs of tokens that join to a token, as a hash table in which each pair has one of two places: pair * 65536 + merged id."""
    ranks = ranks_of(path)
    slots: list[int] = [FREE] * SLOTS
    pairs = [(ranks[t[:i]], ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]

    def places(entry: int) -> list[int]:
        a, b = entry >> 32, entry >> 16 & 0xFFFF
        return [(a * p + b * q) % SLOTS for p, q in FACTORS]

    for a, b, r in pairs:
        entry, at = a << 32 | b << 16 | r, -1
        for _ in range(500):
            one, two = places(entry)
            at = one if slots[one] == FREE else two if slots[two] == FREE else one if at != one else two
            slots[at], entry = entry, slots[at]
            if entry == FREE:
                break
        else:
            raise ValueError("the pair table is too small for this vocabulary")
    return np.array(slots, np.int64)


def ranks_of_pairs(slots: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The id that each pair merges to, or a number of 65536 or more."""
    pair = (a << 32) | (b << 16)
    one, two = (slots[(a * p + b * q) % SLOTS] ^ pair for p, q in FACTORS)
    return np.minimum(np.minimum(one, two), NONE)


def fold(words: list[bytes], path: str) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all words one behind the other, and where each word's ids begin (and the last's end)."""
    ranks, slots = ranks_of(path), pair_table(path)
    first = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
    long = {k: fold_long(w, path) for k, w in enumerate(words) if len(w) > LONG}
    own = np.array([k for k, w in enumerate(words) if 0 < len(w) <= LONG], np.int64)
    sizes = np.array([len(words[k]) for k in own.tolist()], np.int64)
    ids = first[np.frombuffer(b"".join([words[k] for k in own.tolist()]), np.uint8)]
    lengths, parts, owners = np.zeros(len(words), np.int64), [], []
    rank = np.full(len(ids), NONE, np.int64)
    rank[:-1] = ranks_of_pairs(slots, ids[:-1], ids[1:])
    starts = np.cumsum(sizes) - sizes
    rank[starts + sizes - 1] = NONE  # a word's last id has no pair
    while len(own):
        least = np.minimum.reduceat(rank, starts)
        open_ = least < NONE
        if not open_.all():
            # Words without a ranked pair are done and leave the arrays.
            shut = ~open_
            member = np.repeat(shut, sizes)
            parts.append(ids[member])
            owners.append(own[shut])
            lengths[own[shut]] = sizes[shut]
            ids, rank, own, sizes, least = ids[~member], rank[~member], own[open_], sizes[open_], least[open_]
            if not len(own):
                break
            starts = np.cumsum(sizes) - sizes
        hit = np.flatnonzero(rank == np.repeat(least, sizes))
        word = np.searchsorted(starts, hit, "right") - 1
        at = hit[np.concatenate([[True], word[1:] != word[:-1]])]  # the leftmost in each word
        ids[at] = least
        keep = np.ones(len(ids), bool)
        keep[at + 1] = False
        ends = starts + sizes - 1
        last = at + 1 == ends
        after = np.minimum(at + 2, len(ids) - 1)
        rank[at] = np.where(last, NONE, ranks_of_pairs(slots, least, ids[after]))
        before = at > starts
        rank[at[before] - 1] = ranks_of_pairs(slots, ids[at[before] - 1], least[before])
        ids, rank, sizes = ids[keep], rank[keep], sizes - 1
        starts = np.cumsum(sizes) - sizes
    for k, x in long.items():
        lengths[k] = len(x)
        parts.append(np.array(x, np.int64))
        owners.append(np.array([k], np.int64))
    # Words left the arrays in groups; put their ids back in the order of the words.
    begin = np.concatenate([[0], np.cumsum(lengths)])
    flat = np.empty(begin[-1], np.int64)
    if parts:
        owner = np.concatenate(owners)
        size = lengths[owner]
        to = np.repeat(begin[owner] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        flat[to] = np.concatenate(parts)
    return flat, begin


def fold_long(word: bytes, path: str) -> list[int]:
    """The same fold for one long word, with a heap of its pairs."""
    ranks = ranks_of(path)
    piece: list[bytes | None] = [word[i : i + 1] for i in range(len(word))]
    after, before = [*range(1, len(word)), -1], [*range(-1, len(word) - 1)]
    heap = [(r, i, 2) for i in range(len(word) - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, size = heapq.heappop(heap)
        j = after[i] if piece[i] is not None else -1
        if j < 0 or len(piece[i]) + len(piece[j]) != size or i + size > len(word):
            continue
        piece[i] += piece[j]
        piece[j] = None
        after[i] = after[j]
        if after[i] >= 0:
            before[after[i]] = i
        for k in (before[i], i):
            if k >= 0 and after[k] >= 0 and (r := ranks.get(piece[k] + piece[after[k]])) is not None:
                heapq.heappush(heap, (r, k, len(piece[k]) + len(piece[after[k]])))
    return [ranks[x] for x in piece if x is not None]


def bind(value: Column, use) -> Column:
    """use(value), which is computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def encode_word(word: Column, path: str) -> Column:
    """The ids of an array of bytes."""
    ranks = ranks_of(path)
    first = F.split(F.lit(",".join(str(ranks[bytes([b])]) for b in range(256))), ",").cast("array<bigint>")
    slots = F.split(F.lit(",".join(map(str, pair_table(path).tolist()))), ",").cast("array<bigint>")

    def rank(a: Column, b: Column) -> Column:
        # An entry and its own pair differ in the 16 bits of the id only; any other entry differs above them.
        pair = a * (1 << 32) + b * NONE
        one, two = (F.get(slots, ((a * p + b * q) % SLOTS).cast("int")).bitwiseXOR(pair) for p, q in FACTORS)
        return F.least(one, two)

    def ranks_in(ids: Column) -> Column:
        return F.transform(F.slice(ids, 1, F.greatest(F.size(ids) - 1, F.lit(0))), lambda a, i: rank(a, F.get(ids, i + 1)))

    def state(ids: Column) -> Column:
        return F.struct(ids.alias("ids"), ranks_in(ids).alias("ranks"))

    def merge(acc: Column, _) -> Column:
        low = F.coalesce(F.array_min(acc["ranks"]), F.lit(NONE).cast("bigint"))
        at = F.array_position(acc["ranks"], F.array_min(acc["ranks"])).cast("int")
        joined = lambda p: F.concat(F.slice(acc["ids"], F.lit(1), p - 1), F.array(F.array_min(acc["ranks"])), F.slice(acc["ids"], p + 2, F.size(acc["ids"])))
        return F.when(low >= NONE, acc).otherwise(bind(bind(at, joined), state))

    start = bind(F.transform(word, lambda b: F.get(first, b.cast("int"))), state)
    return F.aggregate(F.slice(word, 2, F.size(word)), start, merge, lambda acc: acc["ids"])


def decode_ids(ids: Column, path: str) -> Column:
    """The bytes of an array of ids."""
    ranks = ranks_of(path)
    by_id = {i: t.hex() for t, i in ranks.items()}
    pieces = F.split(F.lit(",".join(by_id.get(i, "") for i in range(max(by_id) + 1))), ",")
    return F.aggregate(ids, F.lit(b""), lambda acc, i: F.concat(acc, F.unhex(F.get(pieces, i.cast("int")))))


def _batches(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[pa.Array, list[str]]]:
    """Keys and texts, in batches of about that many characters."""
    for b in batches:
        texts, first, size = [x or "" for x in b.column(1).to_pylist()], 0, 0
        for i, text in enumerate(texts):
            size += len(text)
            if size >= most or i + 1 == len(texts):
                yield b.column(0).slice(first, i + 1 - first), texts[first : i + 1]
                first, size = i + 1, 0


def bpe(docs: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids and decoded: the ids of each text and the bytes that they decode to."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        find = regex.compile(pattern).findall
        by_id = {i: t for t, i in ranks_of(path).items()}
        for keys, texts in _batches(batches, BATCH_CHARS):
            seen: dict[str, int] = {}
            places = [np.array([seen.setdefault(w, len(seen)) for w in find(text)], np.int64) for text in texts]
            flat, begin = fold([w.encode() for w in seen], path)
            size, pieces = np.diff(begin), [by_id[i] for i in flat.tolist()]
            bounds = begin.tolist()
            raw = [b"".join(pieces[s:e]) for s, e in zip(bounds, bounds[1:])]
            for s in range(0, len(texts), 500):
                ids, ends, decoded = [], [0], []
                for own in places[s : s + 500]:
                    n = size[own]
                    ids.append(flat[np.repeat(begin[own] - (np.cumsum(n) - n), n) + np.arange(n.sum())])
                    ends.append(ends[-1] + len(ids[-1]))
                    decoded.append(b"".join([raw[k] for k in own.tolist()]))
                listed = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(ids).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([keys.slice(s, 500), listed, pa.array(decoded, pa.binary())], ["doc_id", "ids", "decoded"])

    return rows.mapInArrow(run, f"doc_id {kind}, ids array<int>, decoded binary")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.transform("ids", lambda i: i.cast("string")), " ").cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
