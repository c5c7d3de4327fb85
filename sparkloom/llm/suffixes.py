"""Suffix-array dedup: logarithmic families of sparse suffix arrays.

A byte is removed where a string of ``span`` bytes that covers it also starts in a document
with a smaller id. To find these strings without an array over every suffix of the corpus,
suffixes are sampled by content: of the ``span - GRAM + 1`` hashes of GRAM bytes in a string,
the smallest names its anchor, so equal strings have equal anchors wherever they stand, and
neighbouring strings mostly share theirs. A run of strings with one anchor is a *section*, and
the suffix that starts there stands for all its strings.

Documents are dealt to blocks by a hash; what blocks find out about their texts goes to buckets,
and buckets reply with bits in the order in which they were asked:

1. Blocks list their anchors. Buckets reply which of them two documents share, and which are
   hot, with very many sections; all strings without a shared anchor are unique and done with.
2. Blocks send the sections of shared anchors as fingerprints, each distinct one once with its
   smallest document, to the bucket of the anchor or, for hot anchors, of the fingerprint. A
   bucket takes them in order of documents, in batches: a batch is sorted, merge-scanned against
   every existing level for sections that an earlier document has, and what no level has becomes
   a level itself; levels of about equal size merge, so there are never more than a logarithm of
   them.
3. Where sections of one anchor differ, strings must be looked at one by one: of each distinct
   section the first document's block sends the bytes. The same family, over the suffixes of all
   their strings (first bytes, then a fingerprint, equal ones compared byte by byte), finds those
   that an earlier document has. For hot anchors, whose sections would all meet in one bucket,
   each distinct string goes to the bucket of its own fingerprint instead.
4. Blocks mark the bytes of strings that were found and cut them out.

Fingerprints that decide are 128 bits wide (XXH3) under a key drawn anew for each run, so texts
can't be made to collide; anchors, which only sample, come from a rolling hash. Texts are
shuffled once, to their blocks. A passage that any number of documents share travels as one
fingerprint a block and as bytes at most once. Each exchange has a row for each pair of block
and bucket; blocks grow with the square root of the input beyond ``block_bytes``, so a row
stands for ``ROW_BYTES`` of text at least and their number grows with the input, not with its
square. Blocks and buckets are bounded in bytes by their number (4 MB each up to 30 GB of
text, 230 MB at 100 TB), arrays within a block by slices.

Null texts are empty; documents shorter than ``span`` lose nothing; rows with one id never cut
one another, and each repeated row is cut alike; rows without an id count as the largest one; an
empty table gives an empty result; extra columns travel along. A very long text is one document
in one block.
"""

from __future__ import annotations

import math
import os
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.llm.common import table, whole_text

SPAN, GRAM = 50, 20
BLOCK_BYTES, ROW_BYTES = 4 << 20, 512
#: Sections in a batch of a family (strings: four times as many), far below what a bucket holds.
BATCH = 1 << 12
#: Sections beyond which an anchor is hot.
HOT = 1 << 14
NO_ID = np.iinfo(np.int64).max
U64 = np.uint64


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> U64(32))
    h *= U64(0xD6E8FEB86659FD93)
    h ^= h >> U64(32)
    return h


class Rolling:
    """Fingerprints of any substring of a buffer: differences of prefix sums of byte codes times powers of an odd number, modulo 2 ** 64."""

    def __init__(self, data: np.ndarray, seed: int):
        draw = np.random.default_rng(seed)
        codes = draw.integers(0, 2**63, 256, U64) * U64(2) + U64(1)
        base = int(draw.integers(0, 2**62)) * 8 + 5
        n = len(data)
        self.inverse = _powers(pow(base, -1, 2**64), n)
        self.sums = np.zeros(n + 1, U64)
        np.cumsum(codes[data] * _powers(base, n), out=self.sums[1:])

    def all(self, size: int) -> np.ndarray:
        n = len(self.sums) - size
        return _mix((self.sums[size:] - self.sums[:-size]) * self.inverse[:n]) if n > 0 else np.zeros(0, U64)


def strong(data: np.ndarray, first: np.ndarray, end: np.ndarray, key: int) -> np.ndarray:
    """Keyed fingerprints of substrings, 128 bits as two columns."""
    view, digest = memoryview(data), xxhash.xxh3_128_digest
    return np.frombuffer(b"".join([digest(view[s:e], key) for s, e in zip(first.tolist(), end.tolist())]), U64).reshape(-1, 2)


def _expand(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first, first + 1, ... for each of the sizes, one behind the other."""
    return np.repeat(first - (np.cumsum(size) - size), size) + np.arange(size.sum())


_kept: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    have = _kept.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 20), base, U64)
        have[0] = 1
        np.cumprod(have, out=have)
        _kept.clear() if len(_kept) > 8 else None
        _kept[base] = have
    return have[:n]


def _least(h: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each ``width`` neighbours."""
    n, have = len(h) - width + 1, 1
    while have * 2 <= width:
        h = np.minimum(h[:-have], h[have:])
        have *= 2
    return np.minimum(h[:n], h[width - have : width - have + n]) if have < width else h[:n]


class Sections:
    """The sections of some documents: document (its row), first string, number of strings, and anchor."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray):
        parts = []
        # In slices, so that temporary arrays stay small however long the documents are.
        for lo, hi, d0, d1 in _slices(bounds):
            piece = data[lo:hi]
            if len(piece) < SPAN:
                continue
            roll = Rolling(piece, 1)
            anchor = _least(roll.all(GRAM), SPAN - GRAM + 1)
            n = len(anchor)
            ends = bounds[d0 + 1 : d1 + 1] - lo
            doc = np.repeat(np.arange(d0, d1), np.diff(bounds[d0 : d1 + 1]))[:n]
            whole = np.arange(n) + SPAN <= ends[doc - d0]
            new = np.ones(n, bool)
            new[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1]) | (whole[1:] != whole[:-1])
            first = np.flatnonzero(new)
            size = np.diff(np.append(first, n))
            ok = whole[first]
            first, size = first[ok], size[ok]
            # The smallest of many hashes is small; mixed again, anchors spread evenly.
            parts.append((doc[first], first + lo, size, _mix(anchor[first] * U64(0x9E3779B97F4A7C15))))
        empty = (np.zeros(0, np.int64),) * 3 + (np.zeros(0, U64),)
        self.doc, self.first, self.size, self.anchor = (np.concatenate(x) for x in zip(*parts or [empty]))


def _slices(bounds: np.ndarray, most: int = 1 << 19):
    """Ranges of whole documents of about that many bytes: first byte, last, first document, last."""
    d, n = 0, len(bounds) - 1
    while d < n:
        e = max(d + 1, int(np.searchsorted(bounds, bounds[d] + most, "right")) - 1)
        yield int(bounds[d]), int(bounds[e]), d, e
        d = e


def _buffer(col: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and bounds of a column of binary values without nulls."""
    col = pa.chunked_array([col]) if isinstance(col, pa.Array) else col
    chunks = [c for c in col.chunks if len(c)]
    if not chunks:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    datas, sizes = [], []
    for c in chunks:
        wide = np.int64 if pa.types.is_large_binary(c.type) else np.int32
        off = np.frombuffer(c.buffers()[1], wide)[c.offset : c.offset + len(c) + 1].astype(np.int64)
        datas.append(np.frombuffer(c.buffers()[2], np.uint8)[off[0] : off[-1]] if c.buffers()[2] else np.zeros(0, np.uint8))
        sizes.append(np.diff(off))
    return np.concatenate(datas), np.concatenate([[0], np.cumsum(np.concatenate(sizes))])


def _ids(col: pa.ChunkedArray) -> np.ndarray:
    return col.combine_chunks().fill_null(NO_ID).to_numpy(zero_copy_only=False).astype(np.int64)


def _by_bucket(anchor: np.ndarray, buckets: int):
    """Buckets, which are ranges of anchors, and the part of the sorted anchors that falls in each."""
    bucket = ((anchor >> U64(32)) * U64(buckets) >> U64(32)).astype(np.int64)
    cuts = np.flatnonzero(np.diff(bucket, prepend=-1, append=-1)) if len(bucket) else []
    for s, e in zip(cuts, cuts[1:]):
        yield int(bucket[s]), slice(s, e)


class Level:
    """A suffix array: keys in order, where each suffix stands, and the smallest document that has it."""

    def __init__(self, key: np.ndarray, at: np.ndarray, doc: np.ndarray):
        self.key, self.at, self.doc = key, at, doc

    def __len__(self) -> int:
        return len(self.key)


class SuffixFamily:
    """Levels whose sizes at least double from one to the next; no key stands in two of them. ``content`` gives what tells suffixes of equal keys apart, a row for each place."""

    def __init__(self, content: Callable[[np.ndarray], np.ndarray]):
        self.content, self.levels, self.others = content, [], {}
        self.scanned = self.merged = 0

    def take(self, key: np.ndarray, at: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """For each suffix of a batch, batches coming in order of documents, whether a document before its own has it; what is new becomes a level."""
        order = np.lexsort((doc, key))
        key, at, doc = key[order], at[order], doc[order]
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        lead, group = np.flatnonzero(new), np.cumsum(new) - 1
        # The one suffix that stands for each key: that of a level, or the batch's first.
        own_key, own_at, own_doc, known = key[lead], at[lead], doc[lead], np.zeros(len(lead), bool)
        for level in self.levels:
            self.scanned += 1
            i = np.minimum(np.searchsorted(level.key, own_key), len(level) - 1)
            hit = level.key[i] == own_key
            own_at[hit], own_doc[hit] = level.at[i[hit]], level.doc[i[hit]]
            known |= hit
        same = np.ones(len(key), bool)
        other = np.flatnonzero(at != own_at[group])
        same[other] = (self.content(at[other]) == self.content(own_at[group[other]])).all(1)
        hits = same & (own_doc[group] < doc)
        for i in np.flatnonzero(~same).tolist():  # of equal key, but not the same; as good as never
            hits[i] = self.others.setdefault((key[i], self.content(at[i : i + 1]).tobytes()), doc[i]) < doc[i]
        self._add(Level(own_key[~known], own_at[~known], own_doc[~known]))
        found = np.empty(len(key), bool)
        found[order] = hits
        return found

    def _add(self, level: Level) -> None:
        if len(level):
            self.levels.append(level)
        while len(self.levels) > 1 and 2 * len(self.levels[-1]) >= len(self.levels[-2]):
            self.merged += 1
            b, a = self.levels.pop(), self.levels.pop()
            to = np.searchsorted(a.key, b.key) + np.arange(len(b))
            rest = np.ones(len(a) + len(b), bool)
            rest[to] = False
            joined = []
            for x, y in ((a.key, b.key), (a.at, b.at), (a.doc, b.doc)):
                z = np.empty(len(rest), x.dtype)
                z[to], z[rest] = y, x
                joined.append(z)
            self.levels.append(Level(*joined))


def find_sections(mark: np.ndarray, anchor: np.ndarray, doc: np.ndarray, batch: int = BATCH) -> tuple[np.ndarray, np.ndarray, SuffixFamily]:
    """For sections (two columns of marks) in order of documents: whether an earlier document has the same one; whether its anchor has several and no earlier document has this one; the family that told."""
    family, found = SuffixFamily(lambda at: mark[at, 1:]), np.zeros(len(doc), bool)
    for s in range(0, len(doc), batch):
        own = np.arange(s, min(s + batch, len(doc)))
        found[own] = family.take(mark[own, 0], own, doc[own])
    distinct = [level.at for level in family.levels]
    kinds, n = np.unique(anchor[np.concatenate(distinct)] if distinct else anchor[:0], return_counts=True)
    several = np.isin(anchor, kinds[n > 1])
    if family.others:
        several[:] = True  # sections outside the levels: all are looked at
    return found, several & ~found, family


def find_strings(text: np.ndarray, doc: np.ndarray, size: np.ndarray, batch: int = 4 * BATCH) -> tuple[np.ndarray, SuffixFamily]:
    """For all strings of sections (``size`` strings each, one section's bytes behind the other's in text, in order of documents) whether an earlier document has them; the family that told."""
    windows = np.lib.stride_tricks.sliding_window_view(text, SPAN) if len(text) >= SPAN else np.zeros((0, SPAN), np.uint8)
    family, out = SuffixFamily(lambda at: windows[at]), []
    length = size + SPAN - 1
    begin, ends = np.cumsum(length) - length, np.cumsum(size)
    s = 0
    while s < len(size):
        e = max(int(np.searchsorted(ends, (ends[s - 1] if s else 0) + batch, "right")), s + 1)
        at = _expand(begin[s:e], size[s:e])
        lo, hi = int(begin[s]), int(begin[e - 1] + length[e - 1])
        mark = Rolling(text[lo:hi], 3).all(SPAN)[at - lo]
        head = (text[at].astype(U64) << U64(16)) | (text[at + 1].astype(U64) << U64(8)) | text[at + 2]
        out.append(family.take((head << U64(40)) | (mark >> U64(24)), at, np.repeat(doc[s:e], size[s:e])))
        s = e
    return (np.concatenate(out) if out else np.zeros(0, bool)), family


def _bytes(*arrays: np.ndarray) -> bytes:
    """Arrays one behind the other, each with its length before it."""
    return b"".join(len(x).to_bytes(8, "little") + x.tobytes() for x in arrays)


def _arrays(blob: pa.BinaryScalar, *kinds) -> list[np.ndarray]:
    data, at, out = blob.as_buffer(), 0, []
    for k in kinds:
        n = int.from_bytes(data[at : at + 8].to_pybytes(), "little")
        out.append(np.frombuffer(data, k, n, at + 8))
        at += 8 + n * np.dtype(k).itemsize
    return out


def _bits(flags: np.ndarray) -> np.ndarray:
    return np.packbits(flags)


def _flags(bits: np.ndarray, n: int) -> np.ndarray:
    return np.unpackbits(bits, count=n).astype(bool)


ASKED = "bucket int, block int, data binary"
REPLIED = "block int, bucket int, data binary"


def _asked(block: int, found: list[tuple[int, bytes]]) -> pa.Table:
    return pa.table({"bucket": pa.array([b for b, _ in found], pa.int32()), "block": pa.array([block] * len(found), pa.int32()), "data": pa.array([d for _, d in found], pa.binary())})


def _replied(group: pa.Table, replies: list[bytes]) -> pa.Table:
    return pa.table({"block": group["block"].cast(pa.int32()), "bucket": group["bucket"].cast(pa.int32()), "data": pa.array(replies, pa.binary())})


class Entries:
    """The distinct sections of shared anchors in a block, each in its smallest document, by the key that names their bucket; and for every section of the block which of these it is, or -1."""

    def __init__(self, one: np.ndarray, key: np.ndarray, mark: np.ndarray, hot: np.ndarray, which: np.ndarray):
        self.one, self.key, self.mark, self.hot, self.which = one, key, mark, hot, which


class Block:
    """A block's sections, and what the buckets have replied about them so far."""

    def __init__(self, group: pa.Table, replies: pa.Table | None, buckets: int, key: int):
        self.block = group["block"][0].as_py()
        self.data, self.bounds = _buffer(group["text"])
        self.ids = _ids(group["doc_id"])
        self.sections = Sections(self.data, self.bounds)
        self.buckets, self.key, self.replies = buckets, key, {}
        if replies is not None:
            for bucket, data in zip(replies["bucket"].to_pylist(), replies["data"].combine_chunks()):
                self.replies[bucket] = data

    def reply(self, bucket: int, k: int) -> np.ndarray:
        """The k-th bits of a bucket's reply: shared anchors, hot anchors, found sections, open sections, found strings of sections, found strings of hot anchors."""
        return _arrays(self.replies[bucket], *[np.uint8] * (k + 1))[k] if bucket in self.replies else np.zeros(0, np.uint8)

    def replied(self, key: np.ndarray, *which: int) -> list[np.ndarray]:
        """These bits of the replies about sorted keys, put together."""
        out = [np.zeros(len(key), bool) for _ in which]
        for bucket, own in _by_bucket(key, self.buckets):
            for o, k in zip(out, which):
                o[own] = _flags(self.reply(bucket, k), own.stop - own.start)
        return out

    def asks(self, carried: int, *parts) -> pa.Table:
        """A question for each bucket: for each part, sorted keys and what makes bytes of a range of them; then the bits that its next reply carries along."""
        by = [dict(_by_bucket(key, self.buckets)) for key, _ in parts]
        none = slice(0, 0)
        buckets = sorted(set(self.replies).union(*by))
        return _asked(self.block, [(k, b"".join(content(own.get(k, none)) for own, (_, content) in zip(by, parts)) + _bytes(*(self.reply(k, i) for i in range(carried)))) for k in buckets])

    def anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The sections in order of anchors, where each distinct anchor begins in it, and the distinct anchors."""
        order = np.argsort(self.sections.anchor)
        anchor = self.sections.anchor[order]
        new = np.ones(len(order), bool)
        new[1:] = anchor[1:] != anchor[:-1]
        first = np.flatnonzero(new)
        return order, first, anchor[first]

    def entries(self) -> Entries:
        s, (order, first, anchor) = self.sections, self.anchors()
        shared, hot = (np.repeat(x, np.diff(np.append(first, len(order)))) for x in self.replied(anchor, 0, 1))
        some, hot = order[shared], hot[shared]
        mark = strong(self.data, s.first[some], s.first[some] + s.size[some] + SPAN - 1, self.key)
        key = np.where(hot, mark[:, 0], s.anchor[some])
        by = np.lexsort((self.ids[s.doc[some]], mark[:, 0], key))
        some, key, mark, hot = some[by], key[by], mark[by], hot[by]
        new = np.ones(len(some), bool)
        new[1:] = (key[1:] != key[:-1]) | (mark[1:] != mark[:-1]).any(1)
        which = np.full(len(order), -1)
        which[some] = np.cumsum(new) - 1
        return Entries(some[new], key[new], mark[new], hot[new], which)

    def judged(self, e: Entries) -> tuple[np.ndarray, np.ndarray]:
        """Of the distinct sections which an earlier document has as a whole, and which are to be looked at string by string."""
        found, open_ = self.replied(e.key, 2, 3)
        return found, open_ | (e.hot & ~found)

    def strings(self, one: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of the strings of these sections, in order of their fingerprints: the distinct ones' fingerprints and smallest documents; and for all strings which of these they are, and where they stand."""
        s = self.sections
        at = _expand(s.first[one], s.size[one])
        doc = np.repeat(self.ids[s.doc[one]], s.size[one])
        mark = strong(self.data, at, at + SPAN, self.key)
        by = np.lexsort((doc, mark[:, 1], mark[:, 0]))
        new = np.ones(len(by), bool)
        new[1:] = (mark[by[1:]] != mark[by[:-1]]).any(1)
        which = np.empty(len(by), np.int64)
        which[by] = np.cumsum(new) - 1
        return mark[by[new]], doc[by[new]], which, at


def _ask_anchors(buckets: int, key: int):
    def run(group: pa.Table) -> pa.Table:
        b = Block(group, None, buckets, key)
        order, first, anchor = b.anchors()
        doc = b.ids[b.sections.doc[order]]
        several = np.minimum.reduceat(doc, first) < np.maximum.reduceat(doc, first) if len(first) else np.zeros(0, bool)
        n = np.minimum(np.diff(np.append(first, len(order))), 255).astype(np.uint8)
        return _asked(b.block, [(k, _bytes(anchor[own], _bits(several[own]), n[own])) for k, own in _by_bucket(anchor, buckets)])

    return run


def _reply_anchors(group: pa.Table) -> pa.Table:
    parts = [_arrays(x, U64, np.uint8, np.uint8) for x in group["data"].combine_chunks()]
    sizes = [len(p[0]) for p in parts]
    _, which, n = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True, return_counts=True)
    many = n > 1
    many[which[np.concatenate([_flags(p[1], k) for p, k in zip(parts, sizes)])]] = True
    hot = np.bincount(which, np.concatenate([p[2] for p in parts]), len(n)) > HOT
    cuts = np.cumsum([0, *sizes])
    return _replied(group, [_bytes(_bits(many[which[s:e]]), _bits(hot[which[s:e]])) for s, e in zip(cuts, cuts[1:])])


def _ask_sections(buckets: int, key: int):
    def run(group: pa.Table, replies: pa.Table) -> pa.Table:
        if not group.num_rows or not replies.num_rows:
            return _asked(0, [])
        b = Block(group, replies, buckets, key)
        e = b.entries()
        doc = b.ids[b.sections.doc[e.one]]
        return b.asks(2, (e.key, lambda own: _bytes(e.key[own].astype(np.uint32), e.mark[own].ravel(), doc[own])))

    return run


def _in_order(doc: np.ndarray, judge) -> list[np.ndarray]:
    """What judge says of rows in order of documents, put back."""
    order = np.argsort(doc, kind="stable")
    out = []
    for x in judge(order):
        back = np.empty(len(doc), bool)
        back[order] = x
        out.append(back)
    return out


def _reply_sections(group: pa.Table) -> pa.Table:
    parts = [_arrays(x, np.uint32, U64, np.int64, *[np.uint8] * 2) for x in group["data"].combine_chunks()]
    anchor, mark, doc = (np.concatenate([p[i] for p in parts]) for i in range(3))
    mark = mark.reshape(-1, 2)
    found, open_ = _in_order(doc, lambda order: find_sections(mark[order], anchor[order], doc[order])[:2])
    cuts = np.cumsum([0, *(len(p[0]) for p in parts)])
    return _replied(group, [_bytes(*p[3:], _bits(found[s:e]), _bits(open_[s:e])) for p, s, e in zip(parts, cuts, cuts[1:])])


def _ask_strings(buckets: int, key: int):
    def run(group: pa.Table, replies: pa.Table) -> pa.Table:
        if not group.num_rows or not replies.num_rows:
            return _asked(0, [])
        b = Block(group, replies, buckets, key)
        e, s = b.entries(), b.sections
        open_ = b.judged(e)[1]
        one = e.one[open_ & ~e.hot]
        mark, doc, _, _ = b.strings(e.one[open_ & e.hot])

        def content(own: slice) -> bytes:
            i = one[own]
            return _bytes(b.ids[s.doc[i]], s.size[i].astype(np.int32), b.data[_expand(s.first[i], s.size[i] + SPAN - 1)])

        return b.asks(4, (e.key[open_ & ~e.hot], content), (mark[:, 0], lambda own: _bytes(mark[own].ravel(), doc[own])))

    return run


def _reply_strings(group: pa.Table) -> pa.Table:
    parts = [_arrays(x, np.int64, np.int32, np.uint8, U64, np.int64, *[np.uint8] * 4) for x in group["data"].combine_chunks()]
    doc, size, text, mark, hot_doc = (np.concatenate([p[i] for p in parts]) for i in range(5))
    size = size.astype(np.int64)
    length = size + SPAN - 1
    order = np.argsort(doc, kind="stable")
    text = text[_expand((np.cumsum(length) - length)[order], length[order])]
    found = np.empty(int(size.sum()), bool)
    found[_expand((np.cumsum(size) - size)[order], size[order])] = find_strings(text, doc[order], size[order])[0]
    mark = mark.reshape(-1, 2)
    (hot,) = _in_order(hot_doc, lambda o: find_sections(mark[o], np.zeros(len(o), np.uint32), hot_doc[o])[:1])
    cuts, hot_cuts = np.cumsum([0, *(int(p[1].sum()) for p in parts)]), np.cumsum([0, *(len(p[4]) for p in parts)])
    return _replied(group, [_bytes(*p[5:], _bits(found[s:e]), _bits(hot[hs:he])) for p, s, e, hs, he in zip(parts, cuts, cuts[1:], hot_cuts, hot_cuts[1:])])


def _cut(buckets: int, key: int, whole_chars: bool):
    return lambda group, replies: _cut_block(group, replies, buckets, key, whole_chars)


def _whole_chars(data: np.ndarray, gone: np.ndarray) -> np.ndarray:
    """gone, without characters of which only some bytes are gone."""
    if not len(data):
        return gone
    first = np.flatnonzero((data & 0xC0) != 0x80)
    return np.repeat(np.minimum.reduceat(gone, first), np.diff(np.append(first, len(data))))


def _marked(b: Block) -> np.ndarray:
    """+1 where a run of removed bytes begins and -1 behind its end."""
    s, starts = b.sections, np.zeros(len(b.data) + 1, np.int32)

    def mark(first: np.ndarray, end: np.ndarray) -> None:
        np.add.at(starts, first, 1)
        np.add.at(starts, end, -1)

    if not b.replies:
        return starts
    e = b.entries()
    which, (found, open_) = e.which, b.judged(e)
    known = which >= 0
    # Sections that a document before has as a whole, in another block or in this one.
    whole = np.zeros(len(which), bool)
    whole[known] = found[which[known]] | (b.ids[s.doc[known]] > b.ids[s.doc[e.one]][which[known]])
    mark(s.first[whole], s.first[whole] + s.size[whole] + SPAN - 1)
    # Single strings of the rest: where the flags of each open section begin, and the flags.
    at, flags = np.full(len(e.one), -1), [np.zeros(0, bool)]
    plain, hot = np.flatnonzero(open_ & ~e.hot), np.flatnonzero(open_ & e.hot)
    size = s.size[e.one[plain]]
    at[plain] = np.cumsum(size) - size
    n = int(size.sum())
    for bucket, own in _by_bucket(e.key[plain], b.buckets):
        flags.append(_flags(b.reply(bucket, 4), int(size[own].sum())))
    if len(hot):
        size = s.size[e.one[hot]]
        at[hot] = n + np.cumsum(size) - size
        n += int(size.sum())
        marks, first_doc, own, place = b.strings(e.one[hot])
        # In another block, or in a section of this block's that stands in a document before.
        flags.append(b.replied(marks[:, 0], 5)[0][own] | (first_doc[own] < np.repeat(b.ids[s.doc[e.one[hot]]], size)))
    if n:
        flags = np.concatenate(flags)
        own = np.flatnonzero(known & ~whole)
        own = own[at[which[own]] >= 0]
        size, first = s.size[own], at[which[own]]
        step = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        hit = (np.repeat(s.first[own], size) + step)[flags[np.repeat(first, size) + step]]
        mark(hit, hit + SPAN)
    return starts


def _cut_block(group: pa.Table, replies: pa.Table, buckets: int, key: int, whole_chars: bool) -> pa.Table:
    b = Block(group, replies, buckets, key)
    data, bounds, starts = b.data, b.bounds, _marked(b)
    gone = np.cumsum(starts[:-1], dtype=np.int32) > 0
    if whole_chars:
        gone = _whole_chars(data, gone)
    edge = np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8))
    # A run that reaches the end of one document and one at the start of the next are two.
    begins, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    inner = bounds[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    both = np.unique(inner[gone[inner - 1] & gone[inner]]) if len(inner) else inner
    begins, ends = np.sort(np.concatenate([begins, both])), np.sort(np.concatenate([ends, both]))
    cut = np.searchsorted(begins, bounds)
    spans = [[{"start": int(begins[k] - bounds[d]), "end": int(ends[k] - bounds[d])} for k in range(cut[d], cut[d + 1])] for d in range(len(bounds) - 1)]
    left = ~gone
    kept = [data[s:e][left[s:e]].tobytes() for s, e in zip(bounds, bounds[1:])]
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    return pa.table({"doc_id": group["doc_id"], "rest": group["rest"], "n_bytes": pa.array(np.diff(bounds)), "spans": pa.array(spans, span), "kept": pa.array(kept, pa.binary())})


def n_blocks(size: int, block_bytes: int = BLOCK_BYTES) -> int:
    """As many blocks, and as many buckets, as size bytes need; few enough for a row of an exchange to stand for ROW_BYTES."""
    return max(1, -(-size // max(block_bytes, math.isqrt(size * ROW_BYTES))))


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, whole_chars: bool = False) -> DataFrame:
    """doc_id, rest (a struct of all other columns), n_bytes, spans (removed runs of bytes, end exclusive) and kept (the bytes that stay); with whole_chars a character of which only some bytes would go stays."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in (id_col, text_col)] or [F.lit(None).cast("string").alias("none")]
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).cast("binary").alias("text"), F.struct(*rest).alias("rest"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = n_blocks(size, block_bytes)
    key = int.from_bytes(os.urandom(8))
    # One exchange deals texts to their blocks; all passes over the texts read its files.
    by_block = texts.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int")).groupBy("block")
    replies = by_block.applyInArrow(_ask_anchors(blocks, key), ASKED).groupBy("bucket").applyInArrow(_reply_anchors, REPLIED)
    for ask, reply in ((_ask_sections, _reply_sections), (_ask_strings, _reply_strings)):
        replies = by_block.cogroup(replies.groupBy("block")).applyInArrow(ask(blocks, key), ASKED).groupBy("bucket").applyInArrow(reply, REPLIED)
    span = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    # As a schema, for columns of the rest may be declared free of nulls, which a string of types can't say.
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("rest", texts.schema["rest"].dataType), T.StructField("n_bytes", T.LongType()), T.StructField("spans", span), T.StructField("kept", T.BinaryType())])
    return by_block.cogroup(replies.groupBy("block")).applyInArrow(_cut(blocks, key, whole_chars), schema)


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup(table(spark, sf_dir, "documents"))
    removed = F.aggregate(F.transform("spans", lambda s: s["end"] - s["start"]), F.lit(0).cast("long"), lambda a, x: a + x)
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
