"""Resolution and deduplication against slow specifications in plain Python."""

import difflib
import functools
import random
import re

from pyspark.sql import functions as F

from sparkloom.functions.text import NAME_MARKS
from sparkloom.operators import components, dedup, occur, ratio, resolve

MARKS = re.compile("[\\s" + re.escape(NAME_MARKS) + "]")


def norm(s):
    return MARKS.sub("", s).lower()


def spec_match(q, names):
    """names in order -> (name, penalty)"""
    if q in names:
        return q, 0.0
    n = norm(q)
    for e in names:
        if norm(e) == n:
            return e, 0.05
    scored = [(difflib.SequenceMatcher(None, n, norm(e)).ratio(), e) for e in names]
    top = max(r for r, _ in scored)
    if top > 0.85:
        return next(e for r, e in scored if r == top), 0.10
    for e in names:
        if min(len(q), len(e)) >= 2 and (q.lower() in e.lower() or e.lower() in q.lower()):
            return e, 0.15
    if 0 < len(n) <= 15:
        for e in names:
            m = norm(e)
            if 0 < len(m) <= 15 and len(set(n) & set(m)) / max(len(set(n)), len(set(m))) >= 0.7:
                return e, 0.20
    return None, 0.0


def test_waterfall_micro(spark):
    e = spark.createDataFrame([(i, n, "T") for i, n in enumerate(["Acme Corp", "Alice", "赵铁蛋", "New York City"])], "seq long, name string, type string")
    cases = {"Acme Corp": ("Acme Corp", 0.0), "acme, corp!": ("Acme Corp", 0.05), "New York Citi": ("New York City", 0.1), "York": ("New York City", 0.15), "ecilA": ("Alice", 0.2), "zzz": (None, 0.0)}
    got = {r.query: (r.ename, r.penalty) for r in resolve.waterfall(spark.createDataFrame([(q,) for q in cases], ["query"]), e).collect()}
    assert got == cases


def test_waterfall_random(spark):
    draw = random.Random(5)
    words = ["alpha", "beta", "gamma", "delta", "Omega", "pi-x", "A.B"]
    names = list(dict.fromkeys(" ".join(draw.choices(words, k=draw.randint(1, 3))) for _ in range(40)))
    queries = []
    for _ in range(120):
        q = list(draw.choice(names))
        for _ in range(draw.randint(0, 4)):
            i = draw.randrange(len(q))
            q[i : i + draw.randint(0, 1)] = draw.choice(["", "x", " ", "A"])
        if x := "".join(q).strip():
            queries.append(x)
    e = spark.createDataFrame([(i, n, "T") for i, n in enumerate(names)], "seq long, name string, type string")
    got = {r.query: (r.ename, r.penalty) for r in resolve.waterfall(spark.createDataFrame([(q,) for q in queries], ["query"]), e).collect()}
    for q in set(queries):
        assert got[q] == spec_match(q, names), q


def spec_fuzzy(rows):
    out, gone = [], set()
    for i, best in enumerate(rows):
        if i in gone:
            continue
        for j in range(i + 1, len(rows)):
            if j not in gone and difflib.SequenceMatcher(None, norm(best[0]), norm(rows[j][0])).ratio() > 0.85:
                if rows[j][1] > best[1]:
                    best = rows[j]
                gone.add(j)
        out.append(best)
    return out


def test_greedy_merge(spark):
    draw = random.Random(2)
    rows = []
    for i in range(150):
        w = list(draw.choice(["international", "nation", "company limited", "abc"]))
        for _ in range(draw.randint(0, 3)):
            w[draw.randrange(len(w))] = draw.choice("xyz")
        rows.append((i, "".join(w), draw.choice("AB"), draw.randint(0, 9) / 10, {"k": str(i)}))
    df = spark.createDataFrame(rows, "seq long, name string, type string, confidence double, attributes map<string,string>")
    got = sorted((r.type, r.name, r.confidence) for r in dedup.entities_fuzzy(df).collect())
    want = sorted((t, n, c) for t in "AB" for n, c in spec_fuzzy([(n, c) for _, n, k, c, _ in rows if k == t]))
    assert got == want


def bent(draw, words, n, most=4):
    out = []
    for _ in range(n):
        w = list(" ".join(draw.choices(words, k=draw.randint(1, 4))))
        for _ in range(draw.randint(0, most)):
            i = draw.randrange(len(w) or 1)
            w[i : i + draw.randint(0, 2)] = draw.choice(["", "x", "aa", "é", "zq"])
        out.append("".join(w))
    return out


def test_ratio_join_loses_nothing(spark):
    """All pairs above the threshold, in few candidates, for bigrams and for letters."""
    draw = random.Random(11)
    words = ["aaaaaa", "ab", "q", "新しい山", *("".join(draw.choices("eeeetttaaooiinnsshhrrdlucmfwypvbgk", k=draw.randint(3, 9))) for _ in range(60))]
    names = sorted({"", "a", "ab", "aba", "abab", *(n for x in bent(draw, words, 130) for n in {norm(x), norm(x)[:-1], norm(x) + "s"})})
    left = spark.createDataFrame([(x,) for x in names], "x string").repartition(3)
    right = spark.createDataFrame([(x,) for x in names], "y string")
    for threshold, share in ((0.85, 0.03), (0.95, 0.01), (0.5, 0.7)):
        if threshold == 0.5:  # most pairs of letters meet
            names = names[::6]
            left, right = left.filter(F.col("x").isin(names)), right.filter(F.col("y").isin(names))
        want = {(a, b) for a in names for b in names if difflib.SequenceMatcher(None, a, b).ratio() > threshold}
        some = [(r.x, r.y) for r in ratio.candidates(left, "x", right, "y", threshold).collect()]
        assert len(some) == len(set(some)) and len(some) <= share * len(names) ** 2, (threshold, len(some))
        got = {(r.x, r.y): r.ratio for r in ratio.ratio_join(left, "x", right, "y", threshold).collect()}
        assert set(got) == want and all(v == difflib.SequenceMatcher(None, *k).ratio() for k, v in got.items())


def test_shared_grams_bound():
    """The bound on shared grams holds for difflib's own blocks."""
    draw = random.Random(3)
    for _ in range(3000):
        a = "".join(draw.choices("abc", k=draw.randint(1, 14)))
        b = list(a)
        for _ in range(draw.randint(0, 3)):
            i = draw.randrange(len(b) + 1)
            b[i : i + draw.randint(0, 1)] = draw.choice("abcd")
        b = "".join(b)
        for t in (0.82, 0.85, 0.9):
            if difflib.SequenceMatcher(None, a, b).ratio() > t and len(a) > 1:
                q = ratio.gram_size(t)
                shared = len(set(ratio.tokens(a, q)) & set(ratio.tokens(b, q)))
                assert q == 2 and shared >= ratio.least_shared(len(a), t, q), (a, b)


def test_first_holders(spark, monkeypatch):
    """One row a query leaves a task, whatever stands in what; the same when the dictionary is dealt to parts."""
    draw = random.Random(4)
    names = list(dict.fromkeys("".join(draw.choices("abAB ", k=draw.randint(2, 9))) for _ in range(150)))
    e = resolve.dictionary(spark.createDataFrame([(i, n, "T") for i, n in enumerate(names)], "seq long, name string, type string").repartition(3))
    known = [r.ename for r in e.orderBy("eseq").collect()]
    queries = sorted({"".join(draw.choices("abAB", k=draw.randint(1, 8))) for _ in range(60)})
    q = spark.createDataFrame([(x,) for x in queries], "query string")
    want = {x: n for x in queries if len(x) > 1 and (n := next((n for n in known if len(n) > 1 and (n.lower() in x.lower() or x.lower() in n.lower())), None))}
    assert {r.query: r.ename for r in resolve.substring(q, e).collect()} == want
    held = occur.first_holder(e.coalesce(1), "ename", q, "query", "eseq").count()
    assert held <= len(queries) < occur.holding(e, "ename", q, "query").count()
    for name in ("first_held", "first_holder"):
        monkeypatch.setattr(resolve, name, functools.partial(getattr(occur, name), sent=40, share=7))
    assert {r.query: r.ename for r in resolve.substring(q, e).collect()} == want


def test_letter_sets(spark):
    """Names of one set of letters are one row of the join, and few sets meet."""
    draw = random.Random(6)
    names = ["".join(draw.choices("etaoinshrdlucmzq", k=draw.randint(1, 15))) for _ in range(300)]
    names += ["".join(draw.sample(n, len(n))) for n in names]
    e = resolve.dictionary(spark.createDataFrame([(i, n, "T") for i, n in enumerate(names)], "seq long, name string, type string"))
    known = [r.ename for r in e.orderBy("eseq").collect()]
    queries = sorted({"".join(draw.choices("etaoinshrdlucmzq", k=draw.randint(1, 15))) for _ in range(80)})
    q = spark.createDataFrame([(x,) for x in queries], "query string")
    near = lambda a, b: len(set(a) & set(b)) / max(len(set(a)), len(set(b))) >= 0.7
    want = {x: n for x in queries if (n := next((n for n in known if near(norm(x), norm(n))), None))}
    assert {r.query: r.ename for r in resolve.char_overlap(q, e).collect()} == want
    asked, sets = resolve.letter_sets(q, e)
    met = resolve.set_pairs(asked.select("_q").distinct(), sets).select("_q", "_e").distinct().count()
    assert sets.count() <= 300 and met < 0.35 * len(queries) * sets.count()


def test_waterfall_stops(spark, monkeypatch):
    """Levels after the one that leaves nothing are not run."""
    ran = []
    monkeypatch.setattr(resolve, "LEVELS", {k: lambda q, e, *t, k=k, f=f: (ran.append(k), f(q, e, *t))[1] for k, f in resolve.LEVELS.items()})
    e = spark.createDataFrame([(0, "Acme Corp", "T")], "seq long, name string, type string")
    got = resolve.waterfall(spark.createDataFrame([("Acme Corp",), ("acme corp!",)], ["query"]), e).collect()
    assert ran == ["exact", "normalized"] and {r.method for r in got} == {"exact", "normalized"}


def test_greedy_merge_of_any_size(spark):
    """Components are folded by themselves: the same as a fold of all, types without a name and lone rows included."""
    draw = random.Random(21)
    rows = [(i, x, draw.choice(["A", "B", None]), draw.randint(0, 5) / 5, {"k": str(i)} if draw.random() < 0.7 else None) for i, x in enumerate(bent(draw, ["mountain", "river", "harbour", "ab"], 220, 2))]
    df = spark.createDataFrame(rows, "seq long, name string, type string, confidence double, attributes map<string,string>").repartition(3)
    got = sorted(((r.type or "", r.name, r.confidence) for r in dedup.entities_fuzzy(df).collect()))
    want = sorted((t or "", n, c) for t in ("A", "B", None) for n, c in spec_fuzzy([(n, c) for _, n, k, c, _ in rows if k == t]))
    assert got == want and len(got) < len(rows)


def test_components(spark):
    """Chains, stars and grids, in rounds and at once."""
    draw = random.Random(9)
    edges = [(i, i + 1) for i in range(100, 160)] + [(500, i) for i in range(501, 540)] + [(900 + i, 900 + i + d) for i in range(20) for d in (1, 5)] + [(7, 7), (100, 101)]
    draw.shuffle(edges)
    df = spark.createDataFrame(edges, "a long, b long")
    whole = [set(range(100, 161)), set(range(500, 540)), set(range(900, 925))]
    for small in (1_000_000, 10):
        found = {}
        for r in components.components(df, small).collect():
            found.setdefault(r.label, set()).add(r.node)
        assert sorted(map(sorted, found.values())) == sorted(map(sorted, whole))
    assert components.components(df.filter("a < 0")).count() == 0


def test_exact_dedup(spark):
    df = spark.createDataFrame([(0, "A", "T", 0.9), (1, "A", "T", 0.5), (2, "B", "T", 0.1), (3, "A ", "T", 0.95), (4, "B", "T", 0.1)], "seq long, name string, type string, confidence double")
    assert sorted((r.seq, r.name) for r in dedup.entities_exact(df).collect()) == [(0, "A"), (2, "B"), (3, "A ")]
    assert sorted((r.seq, r.name) for r in dedup.entities_final(df).collect()) == [(2, "B"), (3, "A ")]
    assert dedup.entities_exact(df.filter("seq < 0")).count() == 0


def test_same_at_any_partitioning(spark):
    rows = [(i, f"n{i % 7}", "T", (i * 37 % 11) / 10) for i in range(500)]
    df = spark.createDataFrame(rows, "seq long, name string, type string, confidence double")
    a, b = (sorted(map(tuple, dedup.entities_exact(df.repartition(n)).collect())) for n in (1, 13))
    assert a == b


def test_gleaning(spark):
    a = spark.createDataFrame([(0, "Alice", "P", "short", 0.9)], "seq long, name string, type string, description string, confidence double")
    b = spark.createDataFrame([(10, "Alice", "P", "a longer one", 0.7), (11, "Bob", "P", "", 0.6)], a.schema)
    got = {r["name"]: (r.description, r.confidence) for r in dedup.gleaning_merge(a, b).collect()}
    assert got == {"Alice": ("a longer one", 0.9), "Bob": ("", 0.6)}


def test_entity_match(spark):
    pairs = [("Acme", "acme!", True), ("New York", "York", True), ("kitten", "sittin", True), ("abcdefgh", "zyxwvuts", False), ("", "a", False)]
    df = spark.createDataFrame(pairs, "a string, b string, y boolean")
    assert df.filter(resolve.entity_match(F.col("a"), F.col("b")) != F.col("y")).count() == 0


def test_match_pairs_without_a_product(spark):
    """All pairs that entity_match holds for, by joins on what such names share."""
    draw = random.Random(8)
    names = sorted({"", "a", "ab", "abc", "abcd", "A B", "x" * 25, "x" * 26, *bent(draw, ["kitten", "mountain", "ab", "é", "stonework hall"], 90)})
    df = spark.createDataFrame([(n,) for n in names], "name string")
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    both = spark.createDataFrame(pairs, "a string, b string")
    want = {tuple(r) for r in both.filter(resolve.entity_match(F.col("a"), F.col("b"))).collect()}
    out = resolve.match_pairs(df)
    got = [tuple(r) for r in out.collect()]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert len(got) == len(set(got)) and set(got) == want and "Cartesian" not in plan and "NestedLoop" not in plan


def test_no_level_is_a_product(spark):
    """Without broadcasts, no level compares all names with all, nor do mentions and prefilters."""
    from sparkloom.operators import graph

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        queries = spark.createDataFrame([("New York",), ("abc def",)], "query string")
        names = resolve.dictionary(spark.createDataFrame([(1, "York", "City"), (2, "abcd ef", "X")], "seq long, name string, type string"))
        texts = spark.createDataFrame([(1, 0, "New York is a town")], "doc_id long, para int, text string")
        own = names.select(F.col("ename").alias("name"), F.col("etype").alias("type"), F.col("eseq").alias("ord"))
        groups = texts.select(F.col("doc_id").alias("grp"), "text")
        plans = [resolve.exact(queries, names), resolve.normalized(queries, names), resolve.fuzzy(queries, names), resolve.substring(queries, names), resolve.char_overlap(queries, names), graph.mentions(texts, own), graph.entity_prefilter(groups, own)]
        for df in plans:
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert "Cartesian" not in plan and "NestedLoop" not in plan, plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
