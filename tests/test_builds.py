"""Snapshots, incremental builds, running accounts, gleaning by chunk, type hierarchies."""

import datetime as dt
import random
from decimal import Decimal

import pandas as pd
import pytest
from pyspark.sql import functions as F

from sparkloom.operators import graph, ontology, ops
from sparkloom.plans import backends, pipeline
from sparkloom.sources import sinks
from sparkloom.streaming import deltas
from sparkloom.streaming import events as stream


def ids(spark, *n):
    return spark.createDataFrame([(i,) for i in n], "x long")


def held(df):
    return sorted(r.x for r in df.collect())


def test_snapshots_upsert_and_history(spark, tmp_path):
    s = sinks.Snapshots(spark, str(tmp_path / "s"))
    assert s.last() == 0 and s.names() == [] and s.history().count() == 0
    s.commit("b1", "first", entities=ids(spark, 1), triples=ids(spark, 2))
    s.upsert("b2", "again", triples=ids(spark, 3, 4))
    assert s.names() == ["entities", "triples"] and held(s.read("entities")) == [1] and held(s.read("triples")) == [3, 4] and held(s.read("triples", "b1")) == [2]
    s.commit("b3", triples=ids(spark))
    assert s.names() == ["triples"] and s.current() == "b3"
    s.rollback("b2")
    assert s.current() == "b2" and held(s.read("entities")) == [1]
    assert [(r.number, r.build_id) for r in s.history(3).collect()] == [(4, "b2"), (3, "b3"), (2, "b2")]
    with pytest.raises(KeyError):
        s.read("triples", "none")


def test_of_two_writers_one_loses(spark, tmp_path):
    """Both began at one commit: the second to commit is refused, and nothing of it is seen."""
    a, b = (sinks.Snapshots(spark, str(tmp_path / "s")) for _ in range(2))
    a.commit("b0", x=ids(spark, 0))
    one, two = a.begin("one", keep=True), b.begin("two")
    one.write("y", ids(spark, 1))
    two.write("y", ids(spark, 2))
    assert a.names() == ["x"]
    one.commit()
    with pytest.raises(sinks.Conflict):
        two.commit()
    assert b.current() == "one" and held(b.read("y")) == [1] and held(b.read("x")) == [0] and b.last() == 2
    assert not [p for p in (tmp_path / "s" / "_log").iterdir() if p.name.endswith(".json") and p.stat().st_size == 0]


def words(docs):
    return docs.select("doc_id", F.explode(F.split("text", " ")).alias("word"), F.col("doc_id").alias("at")).filter("word <> ''")


def test_incremental_build_equals_a_full_one(spark, tmp_path):
    draw = random.Random(7)
    seen = []

    def facts(docs):
        seen.append(docs)
        return words(docs)

    views = {"first": (["word"], lambda t: t.groupBy("word").agg(F.min("at").alias("at"), F.sum("n").alias("n")))}
    build = deltas.IncrementalBuild(spark, str(tmp_path / "b"), facts, ["word", "at"], views)
    docs = {}
    for step in range(4):
        for i in range(12):
            if draw.random() < 0.4:
                docs[i] = " ".join(draw.choices("a b c d e f".split(), k=draw.randint(0, 4)))
            elif draw.random() < 0.2:
                docs.pop(i, None)
        now = spark.createDataFrame([*docs.items()], "doc_id long, text string")
        build.update(f"u{step}", now)
        whole = views["first"][1](words(now).withColumn("n", F.lit(1)))
        assert sorted(map(tuple, build.read("first").collect())) == sorted(map(tuple, whole.collect())), step
        assert sorted(map(tuple, build.read("facts").collect())) == sorted(map(tuple, words(now).collect()))
    # An update without a change makes facts of no document, and one with a single change of that one.
    before = build.log.last()
    build.update("same", now)
    assert seen[-1].count() == 0 and build.log.last() == before + 1
    changed = now.withColumn("text", F.when(F.col("doc_id") == min(docs), F.concat("text", F.lit(" z"))).otherwise(F.col("text")))
    build.update("one", changed)
    assert sorted(r.at for r in build.read("first").filter("word = 'z'").collect()) == [min(docs)]
    build.update("none", changed.limit(0))
    assert build.read("first").count() == 0 and build.read("totals").count() == 0


def test_running_tokens_in_any_order(spark, tmp_path):
    """Rows that come a batch late count where they belong: the same accounts as over the whole table."""
    draw = random.Random(3)
    start = dt.datetime(2024, 1, 1)
    rows = [(draw.choice("abc"), start + dt.timedelta(seconds=i * 7), i, draw.randint(0, 50)) for i in range(120)]
    usage = spark.createDataFrame(rows, "agent string, ts timestamp, id long, counter long")
    want = {r.agent: r.tokens for r in ops.token_usage(usage.select("agent", F.struct("ts", "id").alias("at"), "counter")).collect()}
    late = sorted(rows, key=lambda r: r[2] + draw.uniform(0, 25))

    def put(k, some):
        pd.DataFrame(some, columns=usage.columns).astype({"ts": "datetime64[us]"}).to_parquet(tmp_path / "in" / f"{k}.parquet")

    (tmp_path / "in").mkdir()
    put(0, late[:40])
    src = spark.readStream.schema(usage.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    before = spark.conf.get(stream.STORE)
    try:
        q = stream.running_tokens(src, "5 minutes").writeStream.format("memory").queryName("accounts").outputMode("update").option("checkpointLocation", str(tmp_path / "ck")).start()
        for k, some in ((1, late[40:80]), (2, late[80:]), (3, [("z", start + dt.timedelta(days=1), 999, 0)])):
            q.processAllAvailable()
            put(k, some)
        q.processAllAvailable()
        q.stop()
    finally:
        spark.conf.set(stream.STORE, before)
    got = {r.agent: r.t for r in spark.sql("select agent, max(tokens) t from accounts group by agent").collect()}
    assert {k: v for k, v in got.items() if k != "z"} == want


def second():
    class Second(pipeline.Backend):
        """Gleans the words in capitals that it is not told."""

        def glean(self, text, known, guide=""):
            told = sorted(x["name"] for x in known)
            return [{"name": w, "type": "T", "confidence": 0.7, "description": ",".join(told)} for w in text.split() if w.isupper() and w not in told]

    return Second


def test_gleaning_looks_at_every_chunk(spark):
    """Each chunk is asked once, with the known entities that stand in it, in order; what it adds is merged."""
    docs = spark.createDataFrame([(1, "AB cd KNOWN"), (2, "x EF later"), (3, None), (4, "EF ab AB")], "doc_id long, text string")
    known = spark.createDataFrame([("KNOWN", "T", "KNOWN", "old", 0.9, None, Decimal(1)), ("AB", "T", None, "", 0.5, None, Decimal(2)), ("cd", "T", None, "", 0.5, None, Decimal(3))], f"{pipeline.ENTITY}, seq decimal(38,0)")
    out = pipeline.gleaned(known, docs, second(), "", pipeline.Config())
    got = {(r["name"], r["type"]): (r.description, r.confidence) for r in out.collect()}
    assert got == {("KNOWN", "T"): ("old", 0.9), ("AB", "T"): ("", 0.5), ("cd", "T"): ("", 0.5), ("EF", "T"): ("", 0.7)} and out.columns == known.columns
    calls = pipeline.glean_calls(pipeline.chunks(docs, pipeline.Config()), known, 2).collect()
    assert {r["at"]: [x["name"] for x in r["names"] or []] for r in calls} == {1: ["KNOWN", "AB"], 2: [], 3: [], 4: ["AB"]}
    head = pipeline.gleaned(known, docs, second(), "", pipeline.Config(glean_head=True))
    assert {r["name"] for r in head.collect()} == {"KNOWN", "AB", "cd", "EF"}
    assert pipeline.gleaned(known.limit(0), docs, second(), "", pipeline.Config(glean_head=True)).count() == 0


def test_hierarchy_and_subtypes(spark):
    """A type below a domain satisfies it, the nearest one; circles and unknown parents do no harm."""
    types = spark.createDataFrame([("City", "Place"), ("Place", None), ("Town", "City"), ("X", "Y"), ("Y", "X"), ("Z", "Gone"), ("Z", "Gone")], "name string, parent string")
    above = ontology.hierarchy(types)
    assert {(r.type, r.ancestor, r.depth) for r in above.collect()} == {("City", "City", 0), ("City", "Place", 1), ("Place", "Place", 0), ("Town", "Town", 0), ("Town", "City", 1), ("Town", "Place", 2), ("X", "X", 0), ("X", "Y", 1), ("Y", "Y", 0), ("Y", "X", 1), ("Z", "Z", 0), ("Z", "Gone", 1)}
    e = spark.createDataFrame([(0, "Bath", "Thing"), (1, "Bath", "Town"), (2, "Bath", "City"), (3, "Ann", "Person")], "seq long, name string, type string")
    r = spark.createDataFrame([(0, "Ann", "lives_in", "Bath", 0.9, ""), (1, "Bath", "near", "Bath", 0.8, "")], "seq long, subject string, predicate string, object string, confidence double, evidence string")
    kinds = spark.createDataFrame([(0, "lives_in", None, "Place"), (1, "near", "Town", "Nowhere")], "ord long, name string, domain string, range string")
    got = {(t.subj_type, t.predicate, t.obj_type) for t in graph.triples(r, e, kinds, ancestors=above).collect()}
    assert got == {("Person", "lives_in", "City"), ("Town", "near", "Thing")}
    assert {t.obj_type for t in graph.triples(r, e, kinds).collect()} == {"Thing"}


def test_relation_types_without_a_product(spark):
    """The same as comparing each text with each type, for more types than any list could be broadcast with, and no cross join."""
    draw = random.Random(5)
    words = ["alpha", "beta", "gamma", "delta", "kappa", "of", "in"]
    types = [(i, "_".join(draw.choices(words, k=2)) + f"_{i % 7}", draw.choice(["T0", "T1", None]), draw.choice(["T1", None])) for i in range(60)]
    texts = [(g, " ".join(draw.choices([*words, "other"], k=draw.randint(0, 3)))) for g in range(12)]
    frame = spark.createDataFrame(types, "ord long, name string, domain string, range string")
    for seen, most in ((("T0",), 9), ((), 9), (("T1", "T0"), 30)):
        got = graph.relation_type_filter(spark.createDataFrame(texts, "grp long, text string"), frame, spark.createDataFrame([(t,) for t in seen], "type string"), most)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "Cartesian" not in plan and "NestedLoop" not in plan
        want = set()
        for g, text in texts:
            matched = lambda t: (t[2] in seen) or (t[3] in seen) or any(len(w) > 3 and w in text for w in t[1].split("_"))  # noqa: B023, E731
            want |= {(g, t[0], matched(t)) for t in sorted(types, key=lambda t: (not matched(t), t[0]))[:most]}
        assert {(r.grp, r.ord, r.matched) for r in got.collect()} == want


def test_a_ledger_asks_once(spark, tmp_path):
    """A second run over the same chunks asks nothing; half-written answers count as none; a bound on calls is a bound on tasks."""
    asked = tmp_path / "asked"
    asked.mkdir()

    def ask(prompt, folder=str(asked)):
        import uuid

        open(f"{folder}/{uuid.uuid4().hex}", "w").close()
        return '[{"name": "A", "type": "T"}]'

    parts = spark.createDataFrame([(i, 0, f"text {i % 7}") for i in range(20)], "at long, chunk_idx int, text string").repartition(1)
    make = lambda: pipeline.ModelBackend(backends.Ledger(ask, f"file://{tmp_path}/ledger", "m1"))
    assert pipeline.extract_entities(parts, make).count() == 20 and len(list(asked.iterdir())) == 7
    assert pipeline.extract_entities(parts.repartition(4), make).count() == 20 and len(list(asked.iterdir())) == 7
    next((tmp_path / "ledger").glob("*/*.json")).write_text('{"ans')
    assert pipeline.extract_entities(parts, make, calls=3).rdd.getNumPartitions() == 3
    assert pipeline.extract_entities(parts, make).count() == 20 and len(list(asked.iterdir())) == 8


def test_views_of_a_first_build_are_made_once(spark, tmp_path, monkeypatch):
    """A first build makes its views from all totals without asking which keys it touches; a later one asks once for views by the same keys."""
    asked, made = [], deltas.refreshed
    monkeypatch.setattr(deltas, "refreshed", lambda view, totals, touched, keys, make: asked.append(touched.columns) or made(view, totals, touched, keys, make))
    facts = lambda docs: docs.select("doc_id", F.explode(F.split("text", " ")).alias("w"))
    count = lambda totals: totals.groupBy("w").agg(F.sum("n").alias("c"))
    build = deltas.IncrementalBuild(spark, str(tmp_path / "b"), facts, ["w"], {"one": (["w"], count), "two": (["w"], count)})
    frame = lambda *rows: spark.createDataFrame(list(rows), "doc_id long, text string")
    build.update("1", frame((1, "a b b"), (2, "b c")))
    assert asked == []
    assert {tuple(r) for r in build.read("one").collect()} == {("a", 1), ("b", 3), ("c", 1)}
    build.update("2", frame((1, "a b b"), (3, "d")))
    assert asked == [["w"], ["w"]]
    for name in ("one", "two"):
        assert {tuple(r) for r in build.read(name).collect()} == {("a", 1), ("b", 2), ("d", 1)}
    assert not any(n.startswith("touched") for n in build.log.names())
