"""Cheapest repair of conversation structure by lazy weighted determinisation.

A weighted automaton accepts the role initials ``(s?(ua)+)?`` and reads a row as Keep, Rerole or Delete,
with Insert between rows. Read from the last row to the first, what is known at a place is a vector: the cost from
each of its four states to the end. Taken less its smallest cost, a vector is one state of a
deterministic automaton; only a few of them ever occur. States and transitions are made when a row first asks
for them and kept in a table, so a scan of a conversation is one lookup a row, and the
weights on its way sum to the cost. The audit is read from the first row on, against the direction of
the scan, along arcs that are tight (their cost is just what the vectors differ by); where several are,
the letter that is least in ASCII goes first, so the audit is the least of all cheapest ones.

Conversations of up to ``LONG`` rows and ``LONG_CHARS`` characters are streamed whole from sorted
partitions. A longer one, which may hold any share of all rows, is cut into segments of
``SEGMENT`` rows. Each segment is scanned for the four vectors at its end and gives a matrix of
costs; a conversation's matrices are put together from its end; each segment then traces its arcs from
all four states, and the conversation picks those that follow each other. Only the digest of a long
conversation's repaired text, which is sequential by nature, is one task's work, in bounded memory.

Rows are taken by turn, nulls first, and rows of one turn by role and text. Nulls in role and text are one space; a null conv_id is one
conversation. Rows of no conversation left after damage give zeros, an empty audit and the digest of nothing. An empty
table gives an empty result; repeated rows are rows; extra columns are left alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.common import drop, salt, salted, table, written

LONG, LONG_CHARS, SEGMENT = 4096, 16_000_000, 1024
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
SPACE = " \t\n\x0b\x0c\r"
INF = float("inf")

#: The automaton of (s?(ua)+)?: what each state reads of s, u and a. 0: nothing read, 1: after s, 2: after u, 3: after a.
NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
FINAL = (0, 3)
#: What Rerole and Insert write in each state, and where that leads.
WRITES = ("u", "u", "a", "u")
ROLES = {"u": "user", "a": "assistant"}
CLEAN, GONE, CUT = range(3)


def closed(v: list[float]) -> tuple[float, ...]:
    """With inserts before the place."""
    for _ in range(4):
        v = [min(x, INSERT + v[NEXT[s][WRITES[s]]]) for s, x in enumerate(v)]
    return tuple(v)


END = closed([0.0 if s in FINAL else INF for s in range(4)])


def arcs(state: int, initial: str, fault: int) -> list[tuple[str, float, int]]:
    """(letter, cost, next state) of what may be done with a row, in the order of letters."""
    out = [("D", DELETE, state)]
    if fault != GONE:
        extra = TRUNCATED if fault == CUT else 0
        if initial in NEXT[state]:
            out.append(("K", KEEP + extra, NEXT[state][initial]))
        out.append(("R", REROLE + extra, NEXT[state][WRITES[state]]))
    return out


class Automaton:
    """The deterministic automaton as far as it has been asked for."""

    def __init__(self):
        self.vectors: list[tuple[float, ...]] = []
        self.ids: dict[tuple[float, ...], int] = {}
        self.table: dict[tuple[int, str, int], tuple[int, float]] = {}
        self.tight: dict[tuple[int, str, int, int], tuple[str, int]] = {}

    def state(self, vector: Iterable[float]) -> tuple[int, float]:
        """The state of a vector, and what was taken off to normalise it."""
        vector = tuple(vector)
        least = min(vector)
        norm = tuple(x - least for x in vector)
        if norm not in self.ids:
            self.ids[norm] = len(self.vectors)
            self.vectors.append(norm)
        return self.ids[norm], least

    def step(self, after: int, initial: str, fault: int) -> tuple[int, float]:
        """The state before a row, given that after it, and the weight of the transition."""
        key = (after, initial, fault)
        if key not in self.table:
            v = self.vectors[after]
            self.table[key] = self.state(closed([min(cost + v[to] for _, cost, to in arcs(s, initial, fault)) for s in range(4)]))
        return self.table[key]

    def scan(self, symbols: list[tuple[str, int]], end: Iterable[float] = END) -> tuple[list[int], float]:
        """The states at all places, and what all weights come to."""
        state, total = self.state(end)
        states = [state]
        for initial, fault in reversed(symbols):
            state, weight = self.step(state, initial, fault)
            states.append(state)
            total += weight
        return states[::-1], total

    def moves(self, after: int, initial: str, fault: int, state: int) -> tuple[str, int]:
        """The letters of the tight arcs from a state before a row to that after it, least first."""
        key = (after, initial, fault, state)
        if key not in self.tight:
            before, weight = self.step(after, initial, fault)
            here, there, letters = self.vectors[before], self.vectors[after], ""
            while True:
                options = [("I", INSERT + here[NEXT[state][WRITES[state]]], NEXT[state][WRITES[state]], True)]
                options += [(x, cost + there[to] - weight, to, False) for x, cost, to in arcs(state, initial, fault)]
                letter, _, state, more = min(o for o in options if o[1] == here[state])
                letters += letter
                if not more:
                    break
            self.tight[key] = (letters, state)
        return self.tight[key]

    def trace(self, states: list[int], symbols: list[tuple[str, int]], state: int = 0) -> tuple[list[str], int]:
        """The letters up to and with each row, and the state after the last."""
        out = []
        for k, (initial, fault) in enumerate(symbols):
            letters, state = self.moves(states[k + 1], initial, fault, state)
            out.append(letters)
        return out, state

    @staticmethod
    def tail(state: int) -> str:
        """Inserts at the end."""
        letters = ""
        while state not in FINAL:
            letters, state = letters + "I", NEXT[state][WRITES[state]]
        return letters


def repaired(letters: str, role: str, text: str, state: int) -> tuple[list[str], int]:
    """The lines that the letters write for a row (Insert needs none), and the state after them."""
    lines = []
    for letter in letters:
        if letter in "IR":
            lines.append(f"{ROLES[WRITES[state]]}:{text if letter == 'R' else ''}")
            state = NEXT[state][WRITES[state]]
        elif letter == "K":
            lines.append(f"{role}:{text}")
            state = NEXT[state][role[0]]
    return lines, state


def _or_space(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(" "))


def damaged(rows: DataFrame) -> DataFrame:
    """rows (conv_id, turn, role, text) with the damage of the exercise, ``n`` rows each (0: dropped), by the checksum of ``conv_id:turn``."""
    h = F.pmod(F.crc32(F.concat(_or_space("conv_id"), F.lit(":"), _or_space("turn")).cast("binary")), F.lit(20))
    role, text = _or_space("role"), _or_space("text")
    return rows.select(
        "conv_id", "turn", F.when(h == 4, F.lit("user")).otherwise(role).alias("role"),
        F.when(h == 1, F.lit("")).when(h == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.when(h == 0, 0).when(h == 3, 2).otherwise(1).alias("n"),
    )


def judged(rows: DataFrame) -> DataFrame:
    """rows with key, initial and the faults that a row shows by itself: blank and truncated."""
    last = F.right(F.trim(F.col("text"), F.lit(SPACE)), F.lit(1))
    out = rows.select("conv_id", _or_space("conv_id").alias("key"), "turn", "role", "text", "n", F.left("role", F.lit(1)).alias("initial"), last.alias("last"))
    return out.withColumn("blank", F.col("last") == "").withColumn("truncated", ~F.col("blank") & ~F.col("last").isin(".", "!", "?")).drop("last")


RESULT = "conv_id {0}, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"
LEGAL = ("su", "ua", "au")


def _gaps(turns: Iterable[int | None]) -> int:
    known = {t for t in turns if t is not None}
    return max(known) - min(known) + 1 - len(known) if known else 0


def repair(automaton: Automaton, rows: list[tuple]) -> tuple:
    """Figures of a whole conversation: rows (turn, role, text, initial, blank, truncated) in order."""
    seen, symbols, counts = set(), [], [0, 0, 0]
    for _, role, text, initial, blank, truncated in rows:
        twice = (role, text) in seen
        seen.add((role, text))
        fault = 0 if blank else 1 if twice else 2 if truncated else None
        if fault is not None:
            counts[fault] += 1
        symbols.append((initial, CLEAN if fault is None else CUT if fault == 2 else GONE))
    states, total = automaton.scan(symbols)
    letters, last = automaton.trace(states, symbols)
    lines, state = [], 0
    for (_, role, text, *_), x in zip(rows, letters):
        more, state = repaired(x, role, text, state)
        lines += more
    tail = automaton.tail(last)
    lines += repaired(tail, "", "", last)[0]
    illegal = sum(a[0] + b[0] not in LEGAL for a, b in zip(symbols, symbols[1:]))
    return (_gaps(r[0] for r in rows), *counts, illegal, int(total + automaton.vectors[states[0]][0]), "".join(letters) + tail, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def _short(rows: DataFrame) -> DataFrame:
    """Whole conversations, streamed in order of key and row."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    rows = rows.repartition("key").sortWithinPartitions("key", F.col("turn").asc_nulls_first(), "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, key, conv, held, out = Automaton(), None, None, [], []

        def close() -> None:
            if key is not None:
                out.append((conv, *repair(automaton, held)))

        def table_() -> pa.RecordBatch:
            columns = list(zip(*out)) if out else [()] * 9
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(columns[0], ids), *(pa.array(c, pa.int64()) for c in columns[1:7]), *(pa.array(c, pa.string()) for c in columns[7:])], ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"])

        for b in batches:
            ids = b["conv_id"].type
            for c, k, turn, role, text, n, *signs in zip(*(x.to_pylist() for x in b.columns)):
                if k != key:
                    close()
                    key, conv, held = k, c, []
                held += [(turn, role, text, *signs)] * n
            if out:
                yield table_()
        close()
        if out:
            yield table_()

    return rows.select("conv_id", "key", "turn", "role", "text", "n", "initial", "blank", "truncated").mapInArrow(run, RESULT.format(kind))


def _long(rows: DataFrame, segment: int) -> DataFrame:
    """Conversations by segments, whatever their length."""
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    place = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    firsts = rows.filter("n > 0").groupBy("key", "role", "text").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("_same"))
    rows = rows.filter("n > 0").withColumn("place", place).join(firsts, ["key", "role", "text"])
    # Among equal rows of the first turn one is the first; the others, and those of later turns, come again.
    rows = rows.groupBy("key", "turn", "role", "text").agg(*(F.first(c).alias(c) for c in ("conv_id", "initial", "blank", "truncated")), F.sum("n").alias("n"), (F.first("place") == F.first("first")).alias("new"))
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n").cast("int")))).withColumn("again", ~(F.col("new") & (F.col("copy") == 1)))
    fault = F.when(F.col("blank"), 0).when(F.col("again"), 1).when(F.col("truncated"), 2).otherwise(3).alias("fault")
    rows = rows.select("key", "conv_id", "turn", "role", "text", "initial", fault).repartitionByRange("key", *order).sortWithinPartitions("key", *order)
    at = F.monotonically_increasing_id()
    rows, rows_path = written(rows.withColumn("at", at).withColumn("segment", at - F.pmod(at, F.lit(segment))), "turns")
    signs = rows.select("key", "segment", "at", "initial", "fault")

    def symbols_of(group: pa.Table) -> list[tuple[str, int]]:
        of = np.argsort(group["at"].to_numpy())
        initials, faults = group["initial"].to_pylist(), group["fault"].to_pylist()
        return [(initials[i], (GONE, GONE, CUT, CLEAN)[faults[i]]) for i in of]

    def matrix(group: pa.Table) -> pa.Table:
        automaton, symbols = Automaton(), symbols_of(group)
        costs = []
        for end in range(4):
            states, total = automaton.scan(symbols, [0.0 if s == end else INF for s in range(4)])
            costs += [x + total for x in automaton.vectors[states[0]]]
        illegal = sum(a[0] + b[0] not in LEGAL for a, b in zip(symbols, symbols[1:]))
        return pa.table({"key": group["key"][:1], "segment": group["segment"][:1], "costs": pa.array([costs], pa.list_(pa.float64())), "illegal": pa.array([illegal], pa.int64()), "ends": [symbols[0][0] + "\n" + symbols[-1][0]]})

    matrices = signs.groupBy("key", "segment").applyInArrow(matrix, "key string, segment bigint, costs array<double>, illegal bigint, ends string")

    def ends(group: pa.Table) -> pa.Table:
        """The vector at each segment's end, from the last one on."""
        of = np.argsort(group["segment"].to_numpy())
        costs, found, now = group["costs"].to_pylist(), {}, list(END)
        edges = [group["ends"][int(i)].as_py().split("\n") for i in of]
        illegal = sum(group["illegal"].to_pylist()) + sum(a[1] + b[0] not in LEGAL for a, b in zip(edges, edges[1:]))
        for i in reversed(of.tolist()):
            found[i] = now
            now = list(closed([min(costs[i][4 * end + s] + now[end] for end in range(4)) for s in range(4)]))
        n = len(of)
        return pa.table({"key": group["key"], "segment": group["segment"], "end": pa.array([found[i] for i in range(n)], pa.list_(pa.float64())), "cost": pa.array([int(now[0])] * n, pa.int64()), "illegal": pa.array([illegal] * n, pa.int64())})

    known, known_path = written(matrices.groupBy("key").applyInArrow(ends, "key string, segment bigint, end array<double>, cost bigint, illegal bigint"), "ends")

    def traced(group: pa.Table) -> pa.Table:
        automaton, symbols = Automaton(), symbols_of(group)
        states, _ = automaton.scan(symbols, group["end"][0].as_py())
        paths = [automaton.trace(states, symbols, s) for s in range(4)]
        return pa.table({"key": group["key"][:1], "segment": group["segment"][:1], "at": group["at"].to_numpy()[[group["at"].to_numpy().argmin()]], "letters": pa.array([["\n".join(p[0]) for p in paths]], pa.list_(pa.string())), "after": pa.array([[p[1] for p in paths]], pa.list_(pa.int32()))})

    paths = signs.join(known.select("key", "segment", "end"), ["key", "segment"]).groupBy("key", "segment").applyInArrow(traced, "key string, segment bigint, at bigint, letters array<string>, after array<int>")

    def chained(group: pa.Table) -> pa.Table:
        """The path of each segment that begins where the one before it ended."""
        of, state, picked = np.argsort(group["segment"].to_numpy()).tolist(), 0, {}
        letters, after = group["letters"].to_pylist(), group["after"].to_pylist()
        for i in of:
            picked[i], state = (state, letters[i][state]), after[i][state]
        n = len(of)
        tail = [Automaton.tail(state) if i == of[-1] else "" for i in range(n)]
        return pa.table({"key": group["key"], "segment": group["segment"], "at": group["at"], "state": pa.array([picked[i][0] for i in range(n)], pa.int32()), "letters": [picked[i][1] for i in range(n)], "tail": tail})

    picked, picked_path = written(paths.groupBy("key").applyInArrow(chained, "key string, segment bigint, at bigint, state int, letters string, tail string"), "paths")
    audits = picked.groupBy("key").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("segment", F.concat(F.replace("letters", F.lit("\n"), F.lit("")), "tail").alias("x")))), lambda s: s["x"]), "").alias("audit"))
    lines = picked.select("key", "at", F.lit(0).alias("kind"), "letters", "state", "tail", F.lit("").alias("role"), F.lit("").alias("text"))
    lines = lines.unionByName(rows.select("key", "at", F.lit(1).alias("kind"), F.lit("").alias("letters"), F.lit(0).alias("state"), F.lit("").alias("tail"), "role", "text"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sha, first, state, todo, tail, out = None, None, True, 0, iter(()), "", []

        def put(more: list[str]) -> None:
            nonlocal first
            for line in more:
                sha.update(line.encode() if first else b"\n" + line.encode())
                first = False

        for b in batches:
            for k, _, kind, letters, start, end, role, text in zip(*(c.to_pylist() for c in b.columns)):
                if k != key:
                    if key is not None:
                        put(repaired(tail, "", "", state)[0])
                        out.append((key, sha.hexdigest()))
                    key, sha, first = k, hashlib.sha256(), True
                if kind == 0:
                    todo, state, tail = iter(letters.split("\n")), start, end
                else:
                    more, state = repaired(next(todo), role, text, state)
                    put(more)
        if key is not None:
            put(repaired(tail, "", "", state)[0])
            out.append((key, sha.hexdigest()))
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.string()) for i in range(2)], ["key", "repaired_sha256"])

    digests = lines.repartition("key").sortWithinPartitions("key", "at", "kind").mapInArrow(digest, "key string, repaired_sha256 string")
    count = lambda k: F.count(F.when(F.col("fault") == k, 1))
    turns = F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn")
    figures = rows.groupBy("key").agg(F.first("conv_id").alias("conv_id"), F.coalesce(turns, F.lit(0)).cast("long").alias("gaps"), count(0).alias("blank"), count(1).alias("duplicate"), count(2).alias("truncated"))
    costs = known.groupBy("key").agg(F.first("illegal").alias("illegal"), F.first("cost").alias("cost"))
    out = figures.join(costs, "key").join(audits, "key").join(digests, "key")
    out, _ = written(out.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"), "repaired")
    for path in (rows_path, known_path, picked_path):
        drop(rows.sparkSession, path)
    return out


def repair_conversations(rows: DataFrame, long: int = LONG, long_chars: int = LONG_CHARS, segment: int = SEGMENT) -> DataFrame:
    """A row for each conversation of rows (conv_id, turn, role, text, n): gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256."""
    rows = judged(rows)
    sizes = rows.groupBy("key").agg(F.sum("n").alias("n"), F.sum(F.length("text").cast("long") * F.col("n")).alias("chars"))
    large, large_path = written(sizes.filter((F.col("n") > long) | ((F.col("chars") > long_chars) & (F.col("n") > 0))).select("key"), "long")
    if not large.limit(1).count():
        drop(rows.sparkSession, large_path)
        return _short(rows)
    # Long conversations are few, at most one in ``long`` rows; a long one meets its row over salted keys.
    rows = rows.withColumn("salt", salt("turn", "text"))
    marked = salted(large)
    short = _short(rows.join(marked, ["key", "salt"], "left_anti").drop("salt"))
    return short.unionByName(_long(rows.join(marked, ["key", "salt"], "left_semi").drop("salt"), segment))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return repair_conversations(damaged(rows.select("conv_id", "turn", "role", "text")))
