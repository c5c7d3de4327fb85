"""Graph building on small hand-made inputs."""


from pyspark.sql import functions as F

from sparkloom.operators import graph, ontology
from sparkloom.operators.structured import Mapped, structured_entities, structured_relations
from sparkloom.sources import sinks


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


NAMES = "name string, type string, ord int"


def test_mentions(spark):
    text = "alice met bob. in New York they ate with Alice. and again, padded to length"
    docs = frame(spark, [(1, text), (2, "short alice")], "doc_id long, text string")
    names = frame(spark, [("Alice", "P", 0), ("bob", "P", 1), ("new york", "C", 2), ("ate", "V", 3)], NAMES)
    got = {(r.doc_id, r.name) for r in graph.mentions(graph.paragraphs(docs), names).collect()}
    assert got == {(1, "Alice"), (1, "new york"), (1, "ate")}  # bob. keeps its point and is no word of the text


def test_next_nine(spark):
    found = frame(spark, [(1, 0, f"n{i:02}", "T", i) for i in range(12)], "doc_id long, para int, name string, type string, ord int")
    pairs = {(r.e1_name, r.e2_name) for r in graph.cooccurrence(found).collect()}
    assert pairs == {(f"n{i:02}", f"n{j:02}") for i in range(12) for j in range(i + 1, min(12, i + 10))}


def test_upgrade_swaps(spark):
    pairs = frame(spark, [("a", "P", "b", "C", 2, 1, ["x"]), ("c", "C", "d", "P", 1, 4, ["x", "y", "z"]), ("e", "Z", "f", "Z", 1, 1, ["x"])], "e1_name string, e1_type string, e2_name string, e2_type string, cnt long, n_sources long, first_sources array<string>")
    rt = frame(spark, [(0, "lives_in", "P", "C"), (1, "later", "P", "C")], "ord int, name string, domain string, range string")
    got = {(r.subject, r.predicate, r.object): (round(r.confidence, 6), r.evidence) for r in graph.upgraded(graph.weighted(pairs), rt).collect()}
    assert got == {("a", "lives_in", "b"): (0.9, "Co-occurred 2x in: x"), ("d", "lives_in", "c"): (0.6, "Co-occurred 1x in: x, y, z and 1 more docs"), ("e", "co_occur", "f"): (0.6, "Co-occurred 1x in: x")}


REL = "seq long, subject string, predicate string, object string, confidence double, evidence string"


def test_domain_range_and_placeholders(spark):
    e = frame(spark, [(0, "Paris", "Person"), (1, "Paris", "City"), (2, "Ann", "Person")], "seq long, name string, type string")
    r = frame(spark, [(0, "Ann", "lives_in", "Paris", 0.9, "x"), (1, "Ann", "knows", "Paris", 0.8, ""), (2, "Ann", "knows", "Qwxyzzz-unknown", 0.9, ""), (3, " ", "knows", "Ann", 0.9, "")], REL)
    rt = frame(spark, [(0, "lives_in", "Person", "City")], "ord int, name string, domain string, range string")
    got = {(t.subj_name, t.subj_type, t.predicate, t.obj_name, t.obj_type): t.confidence for t in graph.triples(r, e, rt).collect()}
    assert got == {("Ann", "Person", "lives_in", "Paris", "City"): 0.9, ("Ann", "Person", "knows", "Paris", "Person"): 0.8, ("Ann", "Person", "knows", "Qwxyzzz-unknown", "Entity"): 0.35}
    assert graph.triples(r, e, rt, placeholders=False).count() == 2


def test_quality(spark):
    e = frame(spark, [(0, "A", "T", 0.9), (1, "B", "T", 0.9), (2, "C", "T", 0.9)], "seq long, name string, type string, confidence double")
    rejected, fixed = frame(spark, [("A", "T")], "name string, type string"), frame(spark, [("B", "T", "U")], "name string, type string, new_type string")
    assert {(r.name, r.type) for r in graph.qc_entities(e, rejected, fixed).collect()} == {("B", "U"), ("C", "T")}
    t = frame(spark, [(0, "A", "T", "p", "C", "T"), (1, "B", "T", "p", "C", "T"), (2, "C", "T", "q", "B", "T")], "seq long, subj_name string, subj_type string, predicate string, obj_name string, obj_type string")
    bad = frame(spark, [("C", "q", "B")], "subject string, predicate string, object string")
    assert [(r.subj_name, r.subj_type) for r in graph.qc_triples(t, rejected, bad, fixed).collect()] == [("B", "U")]


def test_structured(spark):
    rows = frame(spark, [(0, "Ann", "red，blue,", "x"), (1, "Bob", None, "x"), (2, "", "red", "x")], "seq long, person string, likes string, _source string")
    m = [Mapped("person", "id", "Person"), Mapped("likes", "reference", "Colour", "likes", True)]
    assert sorted((r.name, r.type, r.confidence) for r in structured_entities(rows, m).collect()) == [("Ann", "Person", 0.95), ("Bob", "Person", 0.95), ("blue", "Colour", 0.9), ("red", "Colour", 0.9)]
    assert sorted((r.subject, r.object, r.evidence) for r in structured_relations(rows, m).collect()) == [("Ann", "blue", "Row from x"), ("Ann", "red", "Row from x")]


def test_doc_groups(spark):
    docs = frame(spark, [(i * 3, f"text {i}") for i in range(20)], "doc_id long, text string")
    got = {r.grp: r.text for r in graph.doc_groups(docs, 8).collect()}
    assert sorted(got) == [0, 1, 2] and got[2] == "\n\n".join(f"[Doc {i}] text {i}" for i in range(16, 20))
    assert graph.doc_groups(docs.filter("doc_id < 0")).count() == 0


def test_groups_are_read_whole_and_keep_all_names(spark, tmp_path):
    """A name that stands beyond a document's first 4000 characters is found, and a group keeps more than thirty names, as in the query's SQL."""
    import duckdb

    from sparkloom.plans import catalog

    late, words = "word " * 1000, [f"name{i:02d}" for i in range(35)]
    docs = frame(spark, [(1, late + "overdue"), (2, " ".join(words)), (3, None)] + [(k, f"Text{k} overdue " + " ".join(words)) for k in range(4, 12)], "doc_id long, text string")
    assert graph.doc_groups(docs, 1).filter(F.contains("text", F.lit("overdue"))).count() == 9
    assert graph.doc_groups(docs, 1, chars=4000).filter(F.contains("text", F.lit("overdue"))).count() == 8
    docs.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    got = [tuple(r) for r in catalog.queries()["entity_prefilter"](spark, str(tmp_path)).collect()]
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(got) == sorted(con.sql(catalog.oracle_sql()["entity_prefilter"]).fetchall())
    assert {(0, x) for x in ("word", "overdue", *words)} <= {(g, x) for g, x, _ in got}


def test_large_dictionaries_meet_words(spark, monkeypatch):
    """Each text with each string in it, as from holding, where strings meet words first: several parts and shares, strings within words, with spaces, equal ones, long words."""
    import random

    from sparkloom.operators import occur

    rng = random.Random(7)
    word = lambda n: "".join(rng.choice("abé") for _ in range(n))
    texts = [(i, rng.choice(" \n\t\x0b").join(word(rng.randint(1, 9)) for _ in range(30))) for i in range(60)] + [(60, None), (61, ""), (62, word(3000)), (62, "ab ab"), (62, "ab ab")]
    strings = sorted({word(rng.randint(2, 7)) for _ in range(400)} | {"a b", "é\na", word(40), "nowhere"})
    names = frame(spark, [(x, i) for i, x in enumerate([*strings, strings[3], strings[9], "", None])], "name string, ord int")
    df = frame(spark, texts, "id long, low string")
    want = sorted((i, n) for i, t in texts for n, x in enumerate([*strings, strings[3], strings[9]]) if t and x in t)
    monkeypatch.setattr(occur, "PART_CHARS", 300)
    monkeypatch.setattr(occur, "WORDS_CHARS", 60)  # more than 64 shares
    assert sorted(map(tuple, occur.holding_words(df, "low", names, "name", ["id", "ord"]).collect())) == want
    for some in ("name rlike ' '", "name = 'nowhere'", "name = ''"):
        few = names.filter(some)
        assert sorted(map(tuple, occur.holding_words(df, "low", few, "name", ["id", "ord"]).collect())) == sorted(map(tuple, occur.holding(df, "low", few, "name", keep=["id", "ord"]).collect()))
    monkeypatch.setattr(graph, "SENT", 100)
    groups, typed = df.filter("low is not null").select(F.col("id").alias("grp"), F.col("low").alias("text")), names.withColumn("type", F.lit("T"))
    assert sorted((r.grp, r.ord) for r in graph.entity_prefilter(groups, typed).collect()) == want


def test_backfill(spark):
    few, extra = frame(spark, [(i,) for i in range(3)], "a int"), frame(spark, [(9,)], "a int")
    assert graph.backfill(few, extra).count() == 4
    assert graph.backfill(few.union(few).union(few).union(few), extra).count() == 12


def test_sinks(spark, tmp_path):
    e = frame(spark, [(0, "a b", "T", {"k": "v", "n": None}), (1, "a b", "T", None)], "seq long, name string, type string, attributes map<string,string>")
    t = frame(spark, [(0, "a b", "T", "p q", "c", "U", 0.5, 'said "x"')], "seq long, subj_name string, subj_type string, predicate string, obj_name string, obj_type string, confidence double, evidence string")
    lines = sorted(r.line for r in sinks.nt_lines(e, t).collect())
    assert len(lines) == 4 and "<T/a%20b> <p%20q> <U/c> ." in lines
    assert [r.value for r in sinks.jsonl_lines(t).collect()] == ['{"data": "said \\"x\\"", "triple": [[{"a b":"T"}, "p q", {"c":"U"}]]}']
    sinks.write_nt(e, t, str(tmp_path / "nt"))
    assert spark.read.text(str(tmp_path / "nt")).count() == 4
    s = sinks.Snapshots(spark, str(tmp_path / "s"))
    s.commit("b1", "first", triples=t)
    s.commit("b2", "second", triples=t.union(t))
    assert s.read("triples").count() == 2 and s.history(1).first()["build_id"] == "b2"
    s.rollback("b1")
    assert s.read("triples").count() == 1


def test_ontology_changes():
    o = ontology.Ontology("o", "", (ontology.EntityType("A", "a"), ontology.EntityType("B")), (ontology.RelationType("r", domain="A"),))
    c = ontology.Change
    new = o.apply([c("add", "entity_type", "C", "new", parent="A"), c("remove", "entity_type", "B"), c("modify", "entity_type", "A", "changed"), c("modify", "relation_type", "r", range="C"), c("modify", "relation_type", "none", "x"), c("add", "other", "y")])
    assert [(e.name, e.description, e.parent) for e in new.entity_types] == [("A", "changed", None), ("C", "new", "A")]
    assert new.relation_types[0].range == "C" and "**C** (subtype of: A): new" in new.raw
    assert o.entity_types[0].description == "a" and new.is_structured and "from `A` to `C`" in new.guide()


def test_parents(spark):
    t = frame(spark, [(0, "Cancer", None), (1, "Lung Cancer", None), (2, "Small Lung Cancer", "missing"), (3, "Cat", "cancer")], "ord long, name string, parent string")
    assert {r.name: r.parent for r in ontology.parents(t).collect()} == {"Cancer": None, "Lung Cancer": "Cancer", "Small Lung Cancer": "Lung Cancer", "Cat": "Cancer"}


def test_validation(spark):
    e = frame(spark, [(0, "x", "InvalidType"), (1, "y", "人物"), (2, "z", "")], "seq long, name string, type string")
    assert [r["name"] for r in ontology.invalid_entities(e, frame(spark, [("人物",)], "name string")).collect()] == ["x"]


def test_inverse(spark):
    t = frame(spark, [(0, "a", "A", "p", "b", "B", 0.5)], "seq long, subj_name string, subj_type string, predicate string, obj_name string, obj_type string, confidence double")
    rt = frame(spark, [("p", "q")], "name string, inverse string")
    assert {(r.subj_name, r.predicate, r.obj_name) for r in graph.with_inverses(t, rt).collect()} == {("a", "p", "b"), ("b", "q", "a")}


def test_canonical(spark):
    r = frame(spark, [("x", "is_in")], "subject string, predicate string")
    out = graph.canonicalize(r, frame(spark, [("is_in", "located_in")], "predicate string, canonical string")).first()
    assert (out.predicate, out.original_predicate) == ("located_in", "is_in")


def test_pairs_leave_without_their_texts(spark, monkeypatch):
    """A text is not sent back with each name that it holds, and pairs leave in pieces, all of them."""
    from sparkloom.operators import occur

    made = []
    monkeypatch.setattr(graph, "holding", lambda *a, **k: made.append(occur.holding(*a, **k)) or made[-1])
    names = spark.createDataFrame([(f"name{i:03d}", "T", i) for i in range(50)], "name string, type string, ord int")
    groups = spark.createDataFrame([(i, " ".join(f"Name{k:03d}" for k in range(i, 50))) for i in range(50)], "grp long, text string")
    got = {tuple(r) for r in graph.entity_prefilter(groups, names, 100).select("grp", "ord").collect()}
    assert got == {(i, k) for i in range(50) for k in range(i, 50)}
    types = graph.relation_type_filter(groups, names.drop("type").withColumns({"domain": F.lit(None).cast("string"), "range": F.lit(None).cast("string")}), names.select("type"), 60)
    assert types.filter("matched").count() == len(got)
    assert len(made) == 2 and not any("low" in x.columns for x in made)
    texts, held = groups.select("grp", F.lower("text").alias("low")), names.select("name", "ord")
    for sent in (occur.SENT, 100):
        for k, n in {"PAIRS": 7, "PAIR_CHARS": 1000, "PIECE": 1, "SHARE_CHARS": 500}.items():
            monkeypatch.setattr(occur, k, n)
        assert {tuple(r) for r in occur.holding(texts, "low", held, "name", sent=sent).select("grp", "ord").collect()} == got


def test_what_a_backend_says_leaves_in_pieces():
    """A long text with any number of relations does not gather them all in its task."""
    import pandas as pd

    from sparkloom.plans import pipeline

    class Parts:
        def mapInPandas(self, run, kind):  # noqa: N802  Spark's name
            return list(run(iter([pd.DataFrame({"at": [7, 8], "chunk_idx": [0, 0], "text": ["a", "b"]})])))

    n = 3 * pipeline.SAID
    out = pipeline._spoken(Parts(), lambda: None, lambda _, row: ((row["text"],) if k % 2 else None for k in range(n)), "x string", ["x"])
    assert max(map(len, out)) <= pipeline.SAID
    assert [tuple(r) for b in out for r in b.itertuples(index=False)] == [(at, 0, k, x) for at, x in ((7, "a"), (8, "b")) for k in range(1, n, 2)]


def test_gleaning_gets_names_without_texts(spark, monkeypatch):
    """The pairs of chunks and known names hold no chunk's text."""
    from sparkloom.plans import pipeline

    made, holding = [], pipeline.occur.holding
    monkeypatch.setattr(pipeline.occur, "holding", lambda *a, **k: made.append(holding(*a, **k)) or made[-1])
    parts = frame(spark, [(1, 0, "Ann met Bob"), (2, 0, "nobody")], "at long, chunk_idx int, text string")
    known = frame(spark, [("Ann", "P", 1), ("Bob", "P", 2)], "name string, type string, seq long")
    got = {r.at: [x.name for x in r.names or []] for r in pipeline.glean_calls(parts, known, 9).collect()}
    assert got == {1: ["Ann", "Bob"], 2: []} and "low" not in made[0].columns


def test_names_reach_a_backend_compact(spark, monkeypatch):
    """Known names come to a task as one string a row, not as objects for each, and to a backend as they were."""
    from sparkloom.plans import pipeline

    class Told(pipeline.Backend):
        def glean(self, text, known, guide=""):
            return [{"name": f"{text}:{x['name']}", "type": x["type"]} for x in known]

        def relations(self, text, known, guide=""):
            return [{"subject": x["name"], "predicate": str(x["type"]), "object": text} for x in known]

    kinds, spoken = [], pipeline._spoken
    monkeypatch.setattr(pipeline, "_spoken", lambda parts, *a: kinds.append(dict(parts.dtypes)["names"]) or spoken(parts, *a))
    names = "array<struct<name:string,type:string>>"
    calls = frame(spark, [(1, 0, "a", [("Zoë \"x\"\n\\", "P"), ("b", None)], None), (2, 0, "c", None, None), (3, 0, "d", [], None)], f"at long, chunk_idx int, text string, names {names}, types array<string>")
    assert {(r.name, r.type) for r in pipeline.extract_gleaned(calls, Told).collect()} == {("a:Zoë \"x\"\n\\", "P"), ("a:b", "")}
    assert {(r.subject, r.predicate, r.object) for r in pipeline.extract_relations(calls, Told, ontology.Ontology("o", "", (), ())).collect()} == {("Zoë \"x\"\n\\", "P", "a"), ("b", "None", "a")}
    assert kinds == ["string", "string"]


def test_a_dictionary_holds_numbers():
    """No list and no string of Python stands for each name in a task; equal names are found as before."""
    import ahocorasick

    from sparkloom.operators.occur import Finder

    names = ["bc", "", "abc", "bc", "c", "x", "c", "c"]
    finder = Finder(names)
    assert finder.automaton.store == ahocorasick.STORE_INTS and not any(isinstance(x, dict) for x in vars(finder).values())
    for text in ("abc", "bc", "", "zzx", "ccc", "ab"):
        assert finder.find(text) == [i for i, x in enumerate(names) if x and x in text]
    finder.sort(lambda i: -i)
    assert sorted(list(finder.run(k)) for k in finder.runs("abcx")) == [[2], [3, 0], [5], [7, 6, 4]]
    assert Finder([]).find("a") == Finder(["", ""]).find("a") == []
