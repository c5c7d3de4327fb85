"""Near-duplicate embeddings, conversation repair, hard negatives: against brute force."""

import hashlib
import heapq
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import neardup, negatives, repair, topk

VECTORS = "vec_id long, embedding array<float>, label int"


def save(df, folder, name):
    df.write.parquet(str(folder / f"{name}.parquet"))
    return str(folder)


# near duplicates


def alike(draw, n, dims=12):
    base = draw.standard_normal((n // 3 + 1, dims))
    return (base[draw.integers(0, len(base), n)] + 0.06 * draw.standard_normal((n, dims))).astype(np.float32)


def spec_near(rows, threshold=0.98):
    def sound(v, label):
        return label is not None and v is not None and None not in v and np.isfinite(v).all() and any(v)

    n, links = len(rows), [set() for _ in rows]
    for a in range(n):
        for b in range(a):
            (_, x, k), (_, y, m) = rows[a], rows[b]
            if sound(x, k) and sound(y, m) and k == m and len(x) == len(y):
                x, y = (np.asarray(v, float) / np.abs(v).max() for v in (x, y))
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= threshold:
                    links[a].add(b)
                    links[b].add(a)
    out = []
    for a in range(n):
        reach, todo = {a}, [a]
        while todo:
            todo += (more := links[todo.pop()] - reach)
            reach |= more
        first = min((rows[b][0] for b in reach if rows[b][0] is not None), default=None)
        out.append((rows[a][0], len(links[a]), first, rows[a][0] is not None and rows[a][0] == first))
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [neardup.BLOCK, 16 * 12])
def test_near_duplicates(spark, block):
    draw = np.random.default_rng(2)
    rows = [(i, v.tolist(), int(i % 3 > 0)) for i, v in enumerate(alike(draw, 240))]
    rows += [(300, None, 1), (301, [0.0] * 12, 1), (302, [float("nan")] * 12, 1), (303, [1.0] * 12, None), (304, [1.0] * 11 + [None], 1), (305, [], 1), (306, [1e38] * 12, 1), (307, [1e-30] * 12, 1)]
    rows += [(308, [1.0] * 11, 1), (1, rows[1][1], 1), (None, rows[2][1], 1), (309, rows[4][1], 1), (310, rows[4][1], 1)]
    df = spark.createDataFrame(rows, VECTORS).withColumn("label_", F.lit(1)).withColumn("node", F.lit(2)).repartition(3)
    got = sorted((tuple(r) for r in neardup.near_duplicates(df, block=block, recall=0.999999).collect()), key=str)
    assert got == spec_near(rows)


def test_near_duplicates_query(spark, tmp_path):
    rows = [(i, v.tolist(), int(i % 2)) for i, v in enumerate(alike(np.random.default_rng(4), 60))]
    got = neardup.op11_embedding_near_dedup(spark, save(spark.createDataFrame(rows, VECTORS), tmp_path, "embeddings"))
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"] and sorted((tuple(r) for r in got.collect()), key=str) == spec_near(rows)
    assert neardup.near_duplicates(spark.createDataFrame([], VECTORS)).count() == 0


def test_near_copies_fill_blocks_and_count_once(spark):
    """A bucket of many blocks: every pair once, whatever the band and block it is found in."""
    draw = np.random.default_rng(9)
    v = (draw.standard_normal(16) + 0.01 * draw.standard_normal((200, 16))).astype(np.float32)
    rows = [(i, x.tolist(), 0) for i, x in enumerate(v)]
    got = neardup.near_duplicates(spark.createDataFrame(rows, VECTORS), block=16 * 20).collect()
    assert {(r.n_links, r.component_id) for r in got} == {(199, 0)} and [r.vec_id for r in got if r.kept] == [0]


def test_estimates_are_unbiased_and_bounded():
    draw = np.random.default_rng(3)
    x, y = neardup.unit(draw.standard_normal((400, 64))), neardup.unit(draw.standard_normal((400, 64)))
    y = neardup.unit(x * 0.7 + y * 0.5)
    errors = []
    for seed in range(20):
        turn = neardup.Rotation(64, seed)
        assert np.allclose(turn(x) @ turn(y).T, x @ y.T)
        found, deviation = neardup.estimates(turn(x), *neardup.code(turn(y)))
        errors.append(np.diag(found) - (x * y).sum(1))
        assert (np.abs(found - x @ y.T) <= neardup.SIGMAS * deviation).all()
    assert abs(np.mean(errors)) < 0.01


def test_few_pairs_are_recomputed():
    x = np.random.default_rng(3).standard_normal((1000, 64))
    codes, factors = neardup.code(neardup.Rotation(64)(neardup.unit(x)))
    links, root, exact = neardup.linked(x, codes, factors, np.ones(1000, np.int64), None, np.zeros((1000, 0), np.int64), 0.98)
    assert exact < 500_000 / 50 and not links.any() and (root == np.arange(1000)).all()


def test_bands_reach_the_recall():
    draw = np.random.default_rng(8)
    x = neardup.unit(draw.standard_normal((3000, 64)))
    z = neardup.unit(draw.standard_normal((3000, 64)))
    z = neardup.unit(z - (z * x).sum(1, keepdims=True) * x)
    y = 0.98 * x + np.sqrt(1 - 0.98**2) * z
    a, b = (neardup.band_hashes(v, 12, 0.98, 0.999) for v in (x, y))
    assert (a == b).any(1).mean() >= 0.996 and (a[:1500] == a[1500:]).any(1).mean() < 0.02


# hard negatives


def floors(v):
    return [int(np.floor(256 * float(x))) for x in v]


def spec_negatives(rows):
    rows = [(i, floors(v), (k + 1) % 10 if i % 7 == 0 else k) for i, v, k in rows if i is not None and k is not None and v is not None and None not in v and np.isfinite(v).all()]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for a, v, k in {r[0]: r for r in sorted(rows, key=lambda r: (r[2], r[1]), reverse=True)}.values():
        if a % 100:
            continue
        scored = sorted((-dot(v, w), i, m) for i, w, m in rows if i != a)
        for p, pid, _ in [s for s in scored if s[2] == k][:5]:
            fits = [s for s in scored if s[2] != k and 80 * -p <= 100 * -s[0] <= 100 * -p][:5]
            out += [(a, pid, n + 1, i, -p, -s) for n, (s, i, _) in enumerate(fits)]
    return sorted(out)


def mined(df):
    return sorted(tuple(r) for r in df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


def test_hard_negatives(spark, tmp_path):
    draw = np.random.default_rng(1)
    rows = [(i * 5, v.tolist(), int(draw.integers(0, 4))) for i, v in enumerate(0.5 * alike(draw, 300, 6))]
    rows += [(None, rows[0][1], 1), (3, None, 1), (4, [float("inf")] * 6, 1), (6, rows[0][1], None), (700, [], 2), (800, [0.5] * 9, 1), rows[5], rows[20], (1000, [0.0] * 6, 3), (2**53 + 1, rows[20][1], 3), (-100, rows[0][1], 0)]
    df = spark.createDataFrame(rows, VECTORS).withColumn("score", F.lit(1)).repartition(3)
    want = spec_negatives(rows)
    assert len(want) > 20 and mined(negatives.op13_hard_negatives(spark, save(df, tmp_path, "embeddings"))) == want
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label")
    small = negatives.hard_negatives(topk.integers(df, keep=(moved,)), F.col("vec_id") % 100 == 0, segment=8, pivots=6)
    assert mined(small) == want
    none = topk.integers(spark.createDataFrame([], VECTORS), keep=(F.col("label"),))
    assert negatives.hard_negatives(none, F.col("vec_id") % 100 == 0).count() == 0


def test_scans_stop_on_proof(spark):
    """Clustered vectors: the bounds leave most segments unread, and the result is that of a full scan."""
    draw = np.random.default_rng(6)
    centres = 40 * draw.standard_normal((8, 8))
    v = np.floor(centres[draw.integers(0, 8, 800)] + 2 * draw.standard_normal((800, 8)))
    rows = [(i, x.tolist(), i % 2) for i, x in enumerate(v)]
    df = spark.createDataFrame(rows, "vec_id long, v array<double>, label int")
    index = negatives.DistanceIndex(df, segment=16, pivots=8)
    n = index.segments.count()
    asked = index.rows.filter("vec_id % 40 = 0").select(F.col("vec_id").alias("query_id"), "label", "v", F.array(F.struct(F.lit(None).cast("long").alias("low"), F.lit(None).cast("long").alias("high"))).alias("windows"))
    got = sorted(tuple(r) for r in index.search(asked, 3, True).select("query_id", "rank", "vec_id", "score").collect())
    want = []
    for q in range(0, 800, 40):
        best = sorted((-int(v[q] @ v[i]), i) for i in range(800) if i != q and i % 2 == q % 2)[:3]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert got == sorted(want) and sum(index.scanned) < 0.7 * n * 20
    index.close()


def test_negatives_of_wide_scores(spark):
    rows = [(0, [2.0**40, 1.0], 1), (1, [2.0**40, 3.0], 1), (2, [2.0**40, 2.0], 2), (3, [2.0**20, 0.0], 2)]
    got = negatives.hard_negatives(spark.createDataFrame(rows, "vec_id long, v array<double>, label int"), F.col("vec_id") == 0)
    assert mined(got) == [(0, 1, 1, 2, 2**63 - 1, 2**63 - 1)]


# conversation repair


def spec_damage(rows):
    out = {}
    for conv, turn, role, text in rows:
        s = lambda x: " " if x is None else str(x)
        h, role, text = zlib.crc32(f"{s(conv)}:{s(turn)}".encode()) % 20, s(role), s(text)
        own = out.setdefault(conv, [])
        row = (turn, "user" if h == 4 else role, "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text)
        own += [row] * (0 if h == 0 else 2 if h == 3 else 1)
    return {k: sorted(v, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])) for k, v in out.items()}


def spec_repair(rows):
    """Dijkstra over (place, text of roles so far as a state), the cheapest and then least audit."""
    faults, seen = [], set()
    for _, role, text in rows:
        body = re.sub("[ \t-\r]", "", text)
        faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    steps = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    heap, done = [(0, "", 0, "", ())], set()
    while True:
        cost, audit, i, state, lines = heapq.heappop(heap)
        if i == len(rows) and state in ("", "a"):
            break
        if (i, state) in done:
            continue
        done.add((i, state))
        for r in "ua":
            if r in steps[state]:
                full = {"u": "user", "a": "assistant"}[r]
                heapq.heappush(heap, (cost + 5, audit + "I", i, steps[state][r], (*lines, f"{full}:")))
                if i < len(rows) and faults[i] in ("", "truncated"):
                    heapq.heappush(heap, (cost + 1 + 5 * (faults[i] != ""), audit + "R", i + 1, steps[state][r], (*lines, f"{full}:{rows[i][2]}")))
        if i < len(rows):
            heapq.heappush(heap, (cost + 2, audit + "D", i + 1, state, lines))
            to = steps[state].get(rows[i][1][:1])
            if to and faults[i] in ("", "truncated"):
                heapq.heappush(heap, (cost + 5 * (faults[i] != ""), audit + "K", i + 1, to, (*lines, f"{rows[i][1]}:{rows[i][2]}")))
    turns = {r[0] for r in rows} - {None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def conversations():
    draw, rows = random.Random(5), []
    texts = ["Yes.", "No!", "half a", " \t\n", "", None, "What?  ", "é… \x0b", "　", "a.b", "Sure."]
    for conv in [*range(60), None]:
        for t in range(draw.choice([1, 2, 3, 5, 9, 14, 30])):
            role = draw.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "umpire"]) if draw.random() < 0.4 else ["user", "assistant"][t % 2]
            turn = None if draw.random() < 0.05 else t + (draw.random() < 0.1)
            rows.append((conv, turn, role, draw.choice(texts) if draw.random() < 0.5 else f"Text {draw.randint(0, 9)}."))
    rows += [(1000 + k, 0, "user", "x") for k in range(40)]  # some lose their only row
    return rows + rows[:3]


CONVERSATIONS = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("long, segment", [(repair.LONG, repair.SEGMENT), (4, 3), (0, 1), (0, 1024)])
def test_repair(spark, long, segment):
    rows = conversations()
    df = spark.createDataFrame(rows, CONVERSATIONS).withColumn("key", F.lit("clash")).withColumn("n", F.lit(3)).repartition(3)
    got = {r.conv_id: tuple(r)[1:] for r in repair.repair_conversations(repair.damaged(df), long=long, segment=segment).collect()}
    want = {k: spec_repair(v) for k, v in spec_damage(rows).items()}
    assert any(not v for v in spec_damage(rows).values()) and set(got) == set(want)
    for k in want:
        assert got[k] == want[k], (k, spec_damage(rows)[k])


def test_repair_query(spark, tmp_path):
    rows = conversations()[:80]
    got = repair.op12_conversation_repair(spark, save(spark.createDataFrame(rows, CONVERSATIONS), tmp_path, "conversations"))
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert {r.conv_id: tuple(r)[1:] for r in got.collect()} == {k: spec_repair(v) for k, v in spec_damage(rows).items()}
    assert repair.repair_conversations(repair.damaged(spark.createDataFrame([], CONVERSATIONS))).count() == 0


def test_repair_of_very_long_texts(spark):
    rows = [(1, 0, "user", "word " * 300_000 + "."), (1, 1, "assistant", " " * 500_000 + "x?"), (1, 2, "user", "y" + "\t" * 500_000)]
    got = repair.repair_conversations(repair.damaged(spark.createDataFrame(rows, CONVERSATIONS)), long_chars=10_000).first()
    assert tuple(got)[1:] == spec_repair(spec_damage(rows)[1])


def test_few_states():
    """However long the conversations, the vectors that occur are few, and rows after the first ask the table only."""
    draw, automaton = random.Random(2), repair.Automaton()
    for n in (10, 1000, 100_000):
        automaton.scan([(draw.choice("suax"), draw.choice([0, 0, 1, 2])) for _ in range(n)])
    assert len(automaton.vectors) < 100 and len(automaton.table) < 12 * 100
