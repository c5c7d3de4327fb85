"""Which of many strings stand within which of many texts, without comparing each with each.

A dictionary of strings becomes an automaton that reads a text once, whatever the number of
strings. Up to ``SENT`` characters of it are sent to all tasks, which is checked first, and texts
stream past without a shuffle. A larger one is dealt to parts of about that size and the texts
to shares; each pair of part and share is a task of its own.

``holding`` gives every pair, and so does ``holding_words`` with dictionaries that have many parts, for which it looks at words
before it looks at texts. ``first_held`` gives each text the first string in it, and ``first_holder`` each string the
first text that has it: tasks keep the first only, so one row a text or string leaves a task, however
many pairs there are.

Texts are read in pieces of a few MB and pairs are handed on in such pieces, so a task's memory does not depend on how many strings
a text holds. A text that is asked for comes once with each pair; ``keep`` names the columns that are needed.
"""

from __future__ import annotations

from array import array
from collections.abc import Callable, Iterator
from itertools import groupby

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.lineage import written

#: Characters of a dictionary that one task holds, and texts that meet a part of it in one task.
SENT, SHARE = 8 << 20, 20_000
#: Bytes of texts that a task reads at a time, characters of them at most in one group, and pairs and characters in them that are handed on at once.
PIECE, SHARE_CHARS, PAIRS, PAIR_CHARS = 4 << 20, 16 << 20, 20_000, 8 << 20
#: In ``holding_words``: characters of a dictionary that meet words in one task, and of texts' distinct words that meet what stands in them.
PART_CHARS, WORDS_CHARS = 2 << 20, 4 << 20


class Finder:
    """The strings of a list that a text holds, as their places in the list. The automaton stores numbers, no objects: equal strings are a run of ``places``, which begins where it says and stops before ``ends`` there."""

    def __init__(self, strings: list[str]):
        order = sorted((i for i, x in enumerate(strings) if x), key=strings.__getitem__)
        self.places, self.ends = array("q", order), array("q", bytes(8 * len(order)))
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        k = 0
        for x, own in groupby(order, key=strings.__getitem__):
            self.automaton.add_word(x, k)
            self.ends[k] = k = k + sum(1 for _ in own)
        if order:
            self.automaton.make_automaton()

    def runs(self, text: str) -> set[int]:
        """Where the runs of the strings in the text begin."""
        return {k for _, k in self.automaton.iter(text)} if self.places else set()

    def run(self, k: int) -> array:
        return self.places[k : self.ends[k]]

    def find(self, text: str) -> list[int]:
        return sorted(i for k in self.runs(text) for i in self.run(k))

    def sort(self, key: Callable[[int], object]) -> None:
        """Puts each run in order."""
        k = 0
        while k < len(self.places):
            end = self.ends[k]
            if end - k > 1:
                self.places[k:end] = array("q", sorted(self.places[k:end], key=key))
            k = end


def pieces(batch: pa.RecordBatch | pa.Table, size: int = PIECE) -> Iterator[pa.Table]:
    """Its rows in order, a few MB at a time."""
    step = max(1, batch.num_rows * size // max(1, batch.nbytes))
    for i in range(0, batch.num_rows, step):
        own = batch.slice(i, step)
        yield own if isinstance(own, pa.Table) else pa.Table.from_batches([own])


def size_of(df: DataFrame, column: str) -> int:
    """Characters of a column."""
    return df.agg(F.sum(F.length(column).cast("long"))).first()[0] or 0


def _meet(texts: DataFrame, text: str, strings: DataFrame, string: str, sent: int, share: int, pairs, keep: list[str] | None = None, by: str | None = None) -> DataFrame:
    """Rows of both where ``pairs`` says so: a function of the batches of texts of a task (tables), the strings (a table) and a Finder of them, that yields places in the first and the second for each batch, or tables. ``keep``: the columns that come out, else all. ``by``: a column of both, of which equal values meet; else all do."""
    texts, strings = texts.filter(F.col(text).isNotNull()), strings.filter(F.length(string) > 0)
    size = 0 if by else size_of(strings, string)
    names, more = ([c for c in df.columns if c != by] for df in (texts, strings))
    mine, theirs = ([c for c in x if keep is None or c in keep] for x in (names, more))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in (*texts.select(*mine).schema, *strings.select(*theirs).schema))
    there = more.index(string)

    def joined(batches: Iterator[pa.Table], right: pa.Table) -> Iterator[pa.Table]:
        for left, rows, found in pairs(batches, right, Finder(right.column(there).to_pylist())):
            a, b = left.select(mine).take(pa.array(rows, pa.int64())), right.select(theirs).take(pa.array(found, pa.int64()))
            yield pa.table([*a.columns, *b.columns], names=[*mine, *theirs])

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        a, b = a.select(names), b.select(more)
        found = list(joined(pieces(a), b))
        return pa.concat_tables(found) if found else pa.table([*a.select(mine).slice(0, 0).columns, *b.select(theirs).slice(0, 0).columns], names=[*mine, *theirs])

    if by:
        return texts.groupBy(by).cogroup(strings.groupBy(by)).applyInArrow(meet, kinds)
    if size <= sent:
        right = strings.toArrow()

        def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for t in joined((t for b in batches for t in pieces(b)), right):
                yield from t.to_batches()

        return texts.mapInArrow(stream, kinds)
    n, total = texts.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length(text).cast("long")), F.lit(0))).first()
    parts, shares = -(-size // sent), max(1, -(-n // share), -(-total // SHARE_CHARS))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = texts.withColumns({"_share": F.pmod(F.xxhash64(*names), F.lit(shares)).cast("int")}).withColumn("_part", every(parts))
    right = strings.withColumns({"_part": F.pmod(F.xxhash64(string), F.lit(parts)).cast("int")}).withColumn("_share", every(shares))
    return left.groupBy("_part", "_share").cogroup(right.groupBy("_part", "_share")).applyInArrow(meet, kinds)


def _every(here: int, whole: bool):
    """All pairs, for ``_meet``: of texts in column ``here``, which come out with each pair or not."""

    def every(batches, right: pa.Table, finder: Finder):
        for left in batches:
            rows, found, chars = [], [], 0
            for i, x in enumerate(left.column(here).to_pylist()):
                own = finder.find(x)
                rows += [i] * len(own)
                found += own
                chars += len(x) * len(own) if whole else 0
                if len(rows) >= PAIRS or chars >= PAIR_CHARS:
                    yield left, rows, found
                    rows, found, chars = [], [], 0
            yield left, rows, found

    return every


def holding(texts: DataFrame, text: str, strings: DataFrame, string: str, sent: int = SENT, share: int = SHARE, keep: list[str] | None = None) -> DataFrame:
    """texts joined with strings wherever text contains string; both frames' columns have different names, and those of ``keep`` come out, all where it is not given. Null and empty strings stand nowhere, null texts hold nothing."""
    return _meet(texts, text, strings, string, sent, share, _every(texts.columns.index(text), keep is None or text in keep), keep)


def _spread(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """As many numbers as each size says, from each first one on."""
    return np.repeat(first - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


def _near(words: DataFrame, strings: DataFrame, string: str) -> DataFrame:
    """(_share, columns of strings) of the strings of words (_word, _block, _bits: 64 shares, _part), once a share; words and strings of one _part meet."""
    kept = [c for c in strings.columns if c != "_part"]
    kinds = ", ".join(["_share int", *(f"`{f.name}` {f.dataType.simpleString()}" for f in strings.select(*kept).schema)])

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        finder, n, codes = Finder(right.column(string).to_pylist()), right.num_rows + 1, np.array([], np.int64)
        places, ends = np.array(finder.places, np.int64), np.array(finder.ends, np.int64)
        for own in pieces(left):
            bits = own.column("_bits").to_numpy().astype("<i8").view(np.uint8).reshape(-1, 8)
            row, bit = np.nonzero(np.unpackbits(bits, axis=1, bitorder="little"))
            shares, each = own.column("_block").to_numpy()[row] * np.int64(64) + bit, np.bincount(row, minlength=own.num_rows)
            held = [finder.runs(x) for x in own.column("_word").to_pylist()]
            many = np.array([len(x) for x in held])
            sizes = np.repeat(each, many)
            runs = np.repeat(np.array([k for x in held for k in x], np.int64), sizes)
            codes = np.union1d(codes, shares[_spread(np.repeat(np.cumsum(each) - each, many), sizes)] * n + runs)
        share, run = np.divmod(codes, n)
        sizes = ends[run] - run
        rows = right.select(kept).take(pa.array(places[_spread(run, sizes)]))
        return pa.table([pa.array(np.repeat(share, sizes), pa.int32()), *rows.columns], names=["_share", *kept])

    return words.groupBy("_part").cogroup(strings.groupBy("_part")).applyInArrow(meet, kinds)


def holding_words(texts: DataFrame, text: str, strings: DataFrame, string: str, keep: list[str]) -> DataFrame:
    """The same for large dictionaries, by work that grows with texts and strings and not with their product; ``keep`` without the text.

    A string without white space stands within a word. Texts, as their distinct words, are dealt to shares. The distinct words of all
    meet strings by the letters that these begin with, which tells what stands in a share's words, and a share's texts meet these
    strings only. Strings with white space are looked for in whole texts.
    """
    texts, strings = texts.filter(F.col(text).isNotNull()), strings.filter(F.length(string) > 0)
    spaced = F.col(string).rlike(r"\s")
    several, least, size = strings.agg(F.count_if(spaced), F.min(F.when(~spaced, F.length(string))), F.sum(F.when(~spaced, F.length(string).cast("long")))).first()
    out = holding(texts, text, strings.filter(spaced), string, keep=keep) if several or not size else None
    if not size:
        return out
    words = F.array_distinct(F.filter(F.split(text, r"\s+"), lambda w: F.length(w) >= least))
    texts, _ = written(texts.select(*(c for c in texts.columns if c in keep), F.array_join(words, " ").alias(text)).filter(F.length(text) > 0), "words")
    shares, parts, k = max(1, -(-size_of(texts, text) // WORDS_CHARS)), -(-size // PART_CHARS), min(least, 4)
    texts = texts.withColumn("_share", F.pmod(F.xxhash64(*texts.columns), F.lit(shares)).cast("int"))
    part = lambda c: F.pmod(F.xxhash64(c), F.lit(parts)).cast("int")
    parts_of = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("_word") - k + 1), lambda i: part(F.substr("_word", i, F.lit(k)))))
    # The shares that have a word are bits of numbers, 64 in each.
    own = texts.select((F.col("_share") / 64).cast("int").alias("_block"), F.expr("shiftleft(1L, _share % 64)").alias("_bit"), F.explode(F.split(text, " ")).alias("_word"))
    own = own.groupBy("_word", "_block").agg(F.bit_or("_bit").alias("_bits"))
    near = _near(own.withColumn("_part", F.explode(parts_of)), strings.filter(~spaced).withColumn("_part", part(F.substring(string, 1, k))), string)
    found = _meet(texts, text, near, string, 0, 0, _every(texts.columns.index(text), False), keep, "_share")
    return found if out is None else out.unionByName(found)


def _places(column: pa.ChunkedArray) -> list:
    """Values that compare as Spark orders them; structs as tuples."""
    return [tuple(x.values()) if isinstance(x, dict) else x for x in column.to_pylist()]


def first_held(texts: DataFrame, text: str, strings: DataFrame, string: str, order: str, sent: int = SENT, share: int = SHARE) -> DataFrame:
    """Each text with a string that stands in it, the first by strings' ``order``. A dictionary of several parts gives one row for each part that has one."""
    here, at = texts.columns.index(text), strings.columns.index(order)

    def first(batches, right: pa.Table, finder: Finder):
        place = _places(right.column(at))
        # The places of equal strings in order, so that a node's first is the first of all that it stands for.
        finder.sort(place.__getitem__)
        for left in batches:
            rows, found = [], []
            for i, x in enumerate(left.column(here).to_pylist()):
                own = [finder.places[k] for k in finder.runs(x)]
                if own:
                    rows.append(i)
                    found.append(min(own, key=lambda j: place[j]))
            yield left, rows, found

    return _meet(texts, text, strings, string, sent, share, first)


def first_holder(texts: DataFrame, text: str, strings: DataFrame, string: str, order: str, sent: int = SENT, share: int = SHARE) -> DataFrame:
    """Each string with a text that holds it, the first of its task by texts' ``order``; the first of all is the first of these."""
    here, at = texts.columns.index(text), texts.columns.index(order)

    def first(batches, right: pa.Table, finder: Finder):
        best: dict[int, tuple] = {}  # place and values of a text, one at most for each run of equal strings
        shape = None
        for left in batches:
            shape = left.schema
            place, new = _places(left.column(at)), {}
            for i, x in enumerate(left.column(here).to_pylist()):
                for j in finder.runs(x):
                    if j not in best or place[i] < best[j][0]:
                        best[j] = (place[i], None)
                        new[j] = i
            values = left.take(pa.array(list(new.values()), pa.int64())).to_pylist()
            for j, row in zip(new, values):
                best[j] = (best[j][0], row)
        if best:
            rows = [n for n, j in enumerate(best) for _ in finder.run(j)]
            yield pa.Table.from_pylist([row for _, row in best.values()], shape), rows, [i for j in best for i in finder.run(j)]

    return _meet(texts, text, strings, string, sent, share, first)
