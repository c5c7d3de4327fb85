"""Operational operators, readers, streams, the pipeline and the catalogue."""

import json
import zipfile

import pandas as pd
import pytest
from pyspark.sql import functions as F

from sparkloom.operators import cluster, ops
from sparkloom.operators.ontology import EntityType, Ontology, RelationType
from sparkloom.plans import catalog, pipeline
from sparkloom.sources import readers
from sparkloom.streaming import events as stream


def test_manifest(spark):
    m = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1"), ("n", None)], "path string, content_hash string")
    c = spark.createDataFrame([("a", "1"), ("b", "2"), ("d", "1"), ("n", None)], "path string, content_hash string")
    assert {r.path: r.state for r in ops.manifest_diff(m, c).collect()} == {"a": "unchanged", "b": "modified", "c": "deleted", "d": "added", "n": "unchanged"}
    todo, gone = stream.changed_only(c, m)
    assert sorted(r.path for r in todo.collect()) == ["b", "d"] and [r.path for r in gone.collect()] == ["c"]


def test_files_are_pruned_before_they_are_opened(spark, tmp_path):
    """Excluded and unknown files are never opened, broken ones appear with their error, equal ones are two documents."""
    for name, text in {"a.txt": "same", "sub/b.txt": "same", "sub/c d+e.md": "x", "sub/skip/d.txt": "no", "old/e.txt": "no", "f.bin": "unknown", "g.xlsx": "broken", "node_modules/x/y.txt": "no", "h.TXT": "upper"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    exclude = ("skip/*", "old/**", "node_modules/*")
    files = readers.document_files(spark, str(tmp_path), exclude=exclude)
    files.select(F.max(F.length("content"))).collect()
    scan = files.select("path")
    scan.collect()
    plan = scan._jdf.queryExecution().executedPlan()
    opened = next(p.metrics().apply("numFiles").value() for p in _nodes(plan) if p.metrics().contains("numFiles"))
    assert opened == files.count() == 5
    assert "content" not in plan.toString().split("ReadSchema")[-1]
    docs = {r.filename: r for r in readers.read_documents(spark, str(tmp_path), exclude=exclude).collect()}
    assert set(docs) == {"a.txt", "b.txt", "c d+e.md", "g.xlsx", "h.TXT"}
    assert docs["g.xlsx"].text == "broken" and "BadZipFile" in docs["g.xlsx"].error and docs["a.txt"].error is None
    assert docs["a.txt"].content_hash == docs["b.txt"].content_hash and docs["a.txt"].doc_id != docs["b.txt"].doc_id
    named = readers.read_documents(spark, [str(tmp_path / "f.bin"), str(tmp_path / "sub")], exclude=exclude).collect()
    assert {r.filename for r in named} == {"f.bin", "b.txt", "c d+e.md"}
    assert {r.filename for r in readers.read_documents(spark, str(tmp_path), exclude=exclude, unknown_as_text=True).collect()} == {*docs, "f.bin"}
    assert {r.filename for r in readers.read_documents(spark, str(tmp_path), recursive=False).collect()} == {"a.txt", "g.xlsx", "h.TXT"}


def test_workbooks_as_rows(spark, tmp_path):
    """Rows of workbooks stream by; memory does not grow with a sheet, and a broken one shows its error."""
    import tracemalloc

    _xlsx(tmp_path / "big.xlsx", [["id", "name"], *([i, f"n{i}"] for i in range(25_000))])
    _xlsx(tmp_path / "gap.xlsx", [["a", "b", "c"], [1, None, "x"]])
    (tmp_path / "bad.xlsx").write_bytes(b"PK no zip")
    (tmp_path / "a.txt").write_text("text")
    got = readers.read_workbooks(spark, str(tmp_path)).collect()
    of = lambda n: sorted((r.row, r.cells) for r in got if r.source.endswith(n) and r.error is None)
    assert of("gap.xlsx") == [(0, ["a", "b", "c"]), (1, ["1", "", "x"])] and of("big.xlsx")[-1] == (25_000, ["24999", "n24999"]) and len(of("big.xlsx")) == 25_001
    assert [r.sheet for r in got if r.source.endswith("bad.xlsx")] == [None] and "BadZipFile" in next(r.error for r in got if r.error)
    text, meta, tabular = readers.load_xlsx((tmp_path / "big.xlsx").read_bytes())
    assert tabular and meta == {"sheets": "1", "rows": "25000"} and text.count("\n") < 220 and text.endswith("... (24800 more rows)")
    data = (tmp_path / "big.xlsx").read_bytes()
    tracemalloc.start()
    for _, rows in readers.sheets(data):
        assert sum(1 for _ in rows) == 25_001
    assert tracemalloc.get_traced_memory()[1] < 4_000_000
    tracemalloc.stop()


def _nodes(plan):
    out, todo = [], [plan]
    while todo:
        p = todo.pop()
        out.append(p)
        todo += [p.children().apply(i) for i in range(p.children().size())]
    return out


def test_strategy(spark):
    def pick(n, chars, tabular=0):
        rows = [("x" * chars, i < tabular, "txt") for i in range(n)]
        return ops.strategy(ops.corpus_stats(spark.createDataFrame(rows, "text string, is_tabular boolean, ext string"))).first()["strategy"]

    assert [pick(3, 1999), pick(3, 2000), pick(20, 499), pick(21, 499), pick(4, 100, 3), pick(2, 0)] == ["fast", "standard", "fast", "standard", "code", "standard"]


def test_breaker(spark):
    runs = {"a": "ffsff", "b": "fsfff", "c": "fffff", "d": ""}
    rows = [(k, i, x == "f") for k, v in runs.items() for i, x in enumerate(v)]
    df = spark.createDataFrame(rows, "agent string, at int, failed boolean")
    assert {r.agent: r["at"] for r in ops.circuit_breaker(df).collect()} == {"b": 4, "c": 2}


def test_tokens(spark):
    rows = [("a", i, c) for i, c in enumerate([10, 15, 5, 8])] + [("b", 0, 3)]
    df = spark.createDataFrame(rows, "agent string, at int, counter long")
    assert {r.agent: r.tokens for r in ops.token_usage(df).collect()} == {"a": 18, "b": 3}


def test_compaction(spark):
    rows = [("a", 0, "system", "be good")] + [("a", i, "user" if i % 2 else "assistant", f"m{i}") for i in range(1, 61)] + [("b", 0, "user", "hi")]
    got = ops.compact(spark.createDataFrame(rows, "agent string, seq int, role string, content string"), 20).collect()
    a = [r for r in got if r.agent == "a"]
    assert len(a) == 20 and len(got) == 21
    assert next(r for r in a if r.seq is None).content.endswith("\n\n[42 total earlier messages summarized]")
    assert sorted(r.seq for r in a if r.seq) == list(range(43, 61))


def test_classify(spark):
    rows = [(True, 10, ".txt", "programmatic"), (False, 499, ".bin", "llm"), (False, 5000, ".pdf", "llm"), (False, 5000, ".bin", "programmatic"), (None, None, None, "llm")]
    df = spark.createDataFrame(rows, "is_tabular boolean, size long, ext string, want string")
    assert ops.classify(df).filter("route <> want").count() == 0


def _xlsx(path, rows):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    cells = "".join("<row>" + "".join(f'<c r="{chr(65 + j)}{i + 1}" t="inlineStr"><is><t>{v}</t></is></c>' if isinstance(v, str) else f'<c r="{chr(65 + j)}{i + 1}"><v>{v}</v></c>' for j, v in enumerate(r) if v is not None) + "</row>" for i, r in enumerate(rows))
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="S" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {ns}><sheetData>{cells}</sheetData></worksheet>")


def test_readers(spark, tmp_path):
    (tmp_path / "a.txt").write_text("hello", encoding="utf-8")
    (tmp_path / "b.csv").write_bytes("﻿姓名,age\n赵,3\nx,\n".encode())
    (tmp_path / "big.csv").write_text("id,name\n" + "\n".join(f"{i},n{i}" for i in range(600)))
    (tmp_path / "only.tsv").write_text("c1\tc2\n")
    (tmp_path / "c.jsonl").write_text('{"text": "one", "x": 1}\n\nnot json\n{"data": "two", "text": "no"}\n{"y": 1}\n')
    (tmp_path / "d.html").write_text("<p>keep</p><script>drop</script>")
    (tmp_path / "junk.docx").write_bytes(bytes([0, 1, 2, 3, 4]))
    (tmp_path / "skip.bin").write_bytes(b"x")
    (tmp_path / ".git").mkdir()
    (tmp_path / ".git" / "config.txt").write_text("no")
    with zipfile.ZipFile(tmp_path / "e.docx", "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:p><w:t>one </w:t><w:t>line</w:t></w:p><w:p/><w:p><w:t>two</w:t></w:p></w:document>')
    _xlsx(tmp_path / "f.xlsx", [["id", "name"], [1, "Ann"], [2, None]])
    docs = {r.filename: r for r in readers.read_documents(spark, str(tmp_path), exclude=(".git/*",)).collect()}
    assert set(docs) == {"a.txt", "b.csv", "big.csv", "only.tsv", "c.jsonl", "d.html", "junk.docx", "e.docx", "f.xlsx"}
    assert docs["b.csv"].text == "Columns: 姓名, age\nTotal rows: 2\n\n姓名: 赵 | age: 3\n姓名: x" and docs["b.csv"].is_tabular
    assert docs["big.csv"].text.endswith("... (100 more rows)") and docs["only.tsv"].metadata["rows"] == "0"
    assert docs["c.jsonl"].text == "one\nnot json\ntwo" and docs["c.jsonl"].metadata["lines"] == "3"
    assert docs["d.html"].text == "keep" and docs["e.docx"].text == "one line\ntwo" and docs["junk.docx"].metadata == {"fallback": "true"}
    assert "id: 1 | name: Ann\nid: 2" in docs["f.xlsx"].text
    lines = readers.read_jsonl(spark, str(tmp_path / "c.jsonl")).first()
    assert (lines.text, lines.lines) == ("one\nnot json\ntwo", 3)
    kinds = {r.path.rsplit("/", 1)[-1]: r.suggested_loader for r in readers.sniff(spark, str(tmp_path)).collect()}
    assert kinds["b.csv"] == "csv" and kinds["c.jsonl"] == "json" and kinds["e.docx"] == "docx"
    assert readers.read_tables(spark, [str(tmp_path / "big.csv")]).count() == 600
    assert all("/.git/" not in r.path for r in readers.data_files(spark, str(tmp_path)).collect())
    assert readers.get_loader(".TXT") and readers.get_loader(".nope") is None and ".md" in readers.supported_extensions()
    assert [r.source for r in readers.read_texts(spark, ["a", "b"]).collect()] == ["input_0", "input_1"]


def test_clusters(spark):
    names = ["red apple", "green apple", "sour apple", "fast car", "slow car", "old car"]
    got = cluster.noun_clusters(spark.createDataFrame([(n,) for n in names], ["noun"])).collect()
    assert sorted(sorted(r.members) for r in got) == [["fast car", "old car", "slow car"], ["green apple", "red apple", "sour apple"]]
    with pytest.raises(ValueError):
        cluster.noun_clusters(spark.createDataFrame([(n,) for n in names], ["noun"]), most=3)


def test_pipeline(spark):
    docs = spark.createDataFrame([(0, "Ann lives in Paris. Bob knows Ann."), (1, "Paris is big.")], "doc_id long, text string")
    onto = Ontology("o", "", (EntityType("Person"), EntityType("City")), (RelationType("near", domain="Person", range="City"),))
    docs = docs.withColumn("doc_id", docs["doc_id"].cast("string"))
    out = pipeline.run(spark, docs, onto, lambda: pipeline.GazetteerBackend({"Ann": "Person", "Bob": "Person", "Paris": "City"}, "near"))
    assert {(r["name"], r.type) for r in out.entities.collect()} == {("Ann", "Person"), ("Bob", "Person"), ("Paris", "City")}
    assert {(t.subj_name, t.predicate, t.obj_name) for t in out.triples.collect()} == {("Ann", "near", "Paris"), ("Bob", "near", "Ann")}


def test_answers_are_read_in_spark(spark):
    answer = json.dumps({"entities": [{"name": "Ann", "entity_type": "P"}], "relations": [{"subject": "Ann", "relation": "r", "object": "Bob"}]})
    parts = pipeline.chunks(spark.createDataFrame([(0, "x"), (93_000_000_000_000, "y")], "doc_id long, text string"), pipeline.Config())
    ask = lambda: lambda prompt: f"Here:\n```json\n{answer}\n```" if prompt.endswith("x") else "garbage {"
    answers = pipeline.model_answers(parts, ask, lambda text: "Read: " + text)
    assert [(r["name"], r.type) for r in pipeline.answers_to_entities(answers).collect()] == [("Ann", "P")]
    assert [r.predicate for r in pipeline.answers_to_relations(answers).collect()] == ["r"]


PEOPLE = Ontology("o", "people", (EntityType("Person"), EntityType("City")), (RelationType("lives_in", "where", "Person", "City"), RelationType("knows", "who", "Person", "Person")))


def scripted(log=None):
    """A model that answers by the shape that a prompt asks for."""

    def ask(prompt):
        if log is not None:
            log.append(prompt)
        say = lambda x: "Sure:\n```json\n" + json.dumps(x) + "\n```"
        if prompt.startswith("This was to be JSON"):
            return say({"entities": [{"name": "Zed", "type": "Person"}]})
        if "broken" in prompt and '"entities"' in prompt and '"relations"' not in prompt and "found already" not in prompt:
            return "entities: Zed"
        if prompt.startswith("These entities were found"):
            return say({"entities": [{"name": "Ann", "type": "Person", "description": "a person who lives in Paris"}, {"name": "Rome", "type": "City"}]})
        if "every entity of the schema in the text and every relation" in prompt:
            return say({"entities": [{"name": "Ann", "type": "Person"}], "relations": [{"subject": "Ann", "predicate": "knows", "object": "Ghost"}]})
        if prompt.startswith("Find every entity"):
            return say({"entities": [{"name": n, "entity_type": t} for n, t in (("Ann", "Person"), ("Bob", "Person"), ("Paris", "City"), ("Spam", "City")) if n in prompt.split("## Text")[-1]]})
        if prompt.startswith("Find every relation"):
            names = prompt.split("## Entities\n")[1].split("\n")[0]
            assert {"name": "Ann", "type": "Person"} in json.loads(names) and all(x["name"] != "Rome" for x in json.loads(names))
            return say({"relations": [{"subject": "Ann", "relation": "dwells in", "object": "Paris", "evidence": "e"}, {"subject": "Bob", "predicate": "knows", "object": "Ann"}, {"subject": "Spam", "predicate": "knows", "object": "Ann"}]})
        if prompt.startswith("For each predicate"):
            return say({"mappings": {"dwells in": "A", "unheard": "B", "knows": "NONE"}})
        if prompt.startswith("Check these"):
            return say({"rejected_entities": [{"name": "Spam", "type": "City"}], "rejected_relations": [{"subject": "Spam", "predicate": "knows", "object": "Ann"}], "corrections": [{"name": "Bob", "type": "Person", "new_type": "City"}], "quality_score": 0.8})
        if prompt.startswith("Say what each column"):
            return say({"columns": [{"column": "who", "role": "id", "entity_type": "Person"}, {"column": "town", "role": "reference", "entity_type": "City", "relation": "lives_in"}, {"column": "no", "role": "id"}]})
        raise RuntimeError("unknown prompt")

    return ask


def test_model_pipeline(spark):
    """A model behind every call: entities, gleaning, relations with candidates, canonical predicates, judgements, mappings."""
    docs = spark.createDataFrame([("a", "Ann lives in Paris. Bob knows Ann."), ("b", "Spam is spam."), ("c", "broken")], "doc_id string, text string")
    rows = spark.createDataFrame([("Cid", "Oslo"), ("Dan", "Oslo")], "who string, town string")
    heard, ask = [], scripted()
    out = pipeline.run(spark, docs, PEOPLE, lambda: pipeline.ModelBackend(ask), pipeline.Config(cooccurrence=False), tables={"towns": rows}, listen=lambda e, d: heard.append((e, d.get("phase"))))
    entities = {(r["name"], r.type): r for r in out.entities.collect()}
    assert set(entities) == {("Ann", "Person"), ("Bob", "City"), ("Paris", "City"), ("Rome", "City"), ("Zed", "Person"), ("Cid", "Person"), ("Dan", "Person"), ("Oslo", "City")}
    assert entities["Ann", "Person"].description == "a person who lives in Paris" and entities["Rome", "City"].confidence == 0.7
    assert {(r.subject, r.predicate, r.object) for r in out.relations.collect()} == {("Ann", "lives_in", "Paris"), ("Bob", "knows", "Ann"), ("Cid", "lives_in", "Oslo"), ("Dan", "lives_in", "Oslo")}
    assert {(t.subj_name, t.subj_type, t.predicate, t.obj_name) for t in out.triples.collect()} == {("Ann", "Person", "lives_in", "Paris"), ("Bob", "City", "knows", "Ann"), ("Cid", "Person", "lives_in", "Oslo"), ("Dan", "Person", "lives_in", "Oslo")}
    assert out.metadata["quality_score"] == 0.8 and heard[0][0] == "workflow_start" and ("phase_complete", "triples") in heard and heard[-1][0] == "workflow_complete"


def test_strategies(spark):
    docs = spark.createDataFrame([(1, "Ann lives in Paris."), (2, None)], "doc_id long, text string")
    ask = scripted()
    make = lambda: pipeline.ModelBackend(ask)
    out = pipeline.run(spark, docs, PEOPLE, make, pipeline.Config(strategy="auto"))  # few and short: fast
    assert out.metadata["strategy"] == "fast" and [(t.subj_name, t.predicate, t.obj_name, t.obj_type) for t in out.triples.collect()] == [("Ann", "knows", "Ghost", "Entity")]
    rows = spark.createDataFrame([(f"P{i}", f"T{i}") for i in range(12)], "who string, town string")
    out = pipeline.run(spark, docs.filter("doc_id = 1").withColumn("is_tabular", docs["doc_id"] > 0), PEOPLE, make, pipeline.Config(strategy="auto", cooccurrence=False), tables={"t": rows})
    assert out.metadata == {"strategy": "code", "stages": pipeline.Config().stages, "quality_score": 0.8, "texts_skipped": True} and out.triples.count() == 12
    with pytest.raises(ValueError):
        pipeline.run(spark, docs, PEOPLE, make, pipeline.Config(strategy="none"))


def test_backend_repairs_and_retries():
    asked = []
    answers = iter([None, "no json", "still none", "x", '[{"name": "A"}]'])

    def ask(prompt):
        asked.append(prompt)
        a = next(answers)
        if a is None:
            raise OSError("down")
        return a

    b = pipeline.ModelBackend(ask, tries=3)
    assert b.entities("t") == [{"name": "A"}] and b.calls == 5 and asked[2].startswith("This was to be JSON")
    assert pipeline.parse_answer('a {"x": 1} b') == {"x": 1} and pipeline.parse_answer("[1]") == [1] and pipeline.parse_answer("7") is None and pipeline.parse_answer(None) is None


def test_config(tmp_path):
    (tmp_path / "c.json").write_text('{"chunk_size": 1234, "gleaning": false, "stages": ["entities"]}')
    c = pipeline.Config.load(str(tmp_path / "c.json"), {"SPARKLOOM_CHUNK_SIZE": "99", "SPARKLOOM_COOCCURRENCE": "no"})
    assert (c.chunk_size, c.gleaning, c.stages, c.cooccurrence, c.chunk_overlap) == (99, False, ("entities",), False, 300)


def test_holding_in_parts(spark):
    """A dictionary that is dealt to parts finds what one that is sent finds."""
    texts = spark.createDataFrame([(i, f"alpha beta{i} gamma" if i % 3 else None) for i in range(40)], "id long, text string")
    names = spark.createDataFrame([(k, x) for k, x in enumerate(["alpha", "beta1", "a", "", None, "zeta", "eta2", "alpha"])], "k long, name string")
    from sparkloom.operators.occur import holding

    words = names.collect()
    want = sorted((r.id, n.k) for r in texts.collect() for n in words if r.text and n.name and n.name in r.text)
    for options in ({}, {"sent": 8, "share": 7}):
        assert sorted((r.id, r.k) for r in holding(texts, "text", names, "name", **options).collect()) == want


def test_regex_backend():
    b = pipeline.RegexBackend({"Year": r"\b\d{4}\b"}, {"born": r"(?P<subject>\w+) was born in (?P<object>\d{4})"})
    assert [e["name"] for e in b.entities("1999 and 2000, 1999")] == ["1999", "2000"]
    assert b.relations("Ann was born in 1999", [])[0]["object"] == "1999"


def test_windows_on_a_stream(spark, tmp_path):
    rows = spark.sql("SELECT timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,id * 10) AS ts, 'x' AS event_type FROM range(30)")
    rows.write.parquet(str(tmp_path / "in"))
    src = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = stream.windowed(src, "1 hour").writeStream.format("memory").queryName("win").outputMode("complete").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.n for r in spark.sql("select * from win").collect()) == [6] * 5


def test_catalogue():
    q, o = catalog.queries(), catalog.oracle_sql()
    assert len(q) > 70 and set(o) <= set(q)


def test_presets(spark):
    from sparkloom.plans import presets

    lines = spark.createDataFrame([('{"relations": [{"predicate": {"surfaceform": "born in"}}, {"predicate": {"surfaceform": "born in"}}, {"predicate": {"surfaceform": ""}}]}',), ("broken {",), ('{"relations": [{"predicate": {"surfaceform": "a"}}]}',)], ["value"])
    o = presets.from_predicates(presets.nested_predicates(lines), "p")
    assert [(r.name, r.description) for r in o.relation_types] == [("a", "P: a (appears 1 times, 33.3%)"), ("born in", "P: born in (appears 2 times, 66.7%)")]
    presets.register(presets.Preset("p", "P", relation_types=o.relation_types))
    assert "p" in presets.list_presets() and presets.build_ontology("p").relation_types == o.relation_types and presets.get_preset("q") is None and presets.build_ontology("q") is None


def test_built_in_presets(spark, tmp_path):
    from sparkloom.plans import presets

    assert {"kochet", "nyt", "nyt_star", "rebel", "sredfm", "webnlg", "webnlg_repo", "webnlg_star", "wiki_nre"} <= set(presets.list_presets())
    o = presets.build_ontology("kochet")
    assert len(o.entity_types) == 12 and len(o.relation_types) == 14 and o.is_structured and o.relation_types[0].domain == "Entity"
    assert len(presets.build_ontology("sredfm").entity_types) == 13 and presets.build_ontology("nyt").relation_types == ()
    (tmp_path / "s.csv").write_text('birthPlace,"Where, in short, one was born"\n,none\nx,\n')
    assert [(r.name, r.description) for r in presets.build_ontology("webnlg", spark, str(tmp_path / "s.csv")).relation_types] == [("birthPlace", "Where, in short, one was born")]
    (tmp_path / "r.json").write_text(json.dumps([{"0": "x"}, {"/people/b": 1, "/people/a": 0}]))
    assert [(r.name, r.description) for r in presets.build_ontology("nyt", spark, str(tmp_path / "r.json")).relation_types] == [("/people/a", "NYT: a (/people/a)"), ("/people/b", "NYT: b (/people/b)")]
    assert [r.description for r in presets.build_ontology("webnlg_star", spark, str(tmp_path / "r.json")).relation_types][0] == "Relation: /people/a"


def build_result(spark):
    e = spark.createDataFrame([(i, f"n{i}", "P" if i % 3 else "Q", i / 30) for i in range(30)], "seq long, name string, type string, confidence double")
    r = spark.createDataFrame([(1, "n1", "knows", "n2", 0.5), (2, "n2", "knows", "n3", 0.9)], "seq long, subject string, predicate string, object string, confidence double")
    return pipeline.Result(e, r, r.select("seq"))


def test_refinement(spark):
    from sparkloom.plans import refine
    from sparkloom.operators.ontology import Change

    docs = spark.createDataFrame([("abc", ".txt"), (None, ".md")], "text string, ext string")
    facts = refine.facts(build_result(spark), docs, "standard", 0.7)
    assert facts["entity_types"] == [["P", 20], ["Q", 10]] and facts["relations"] == 2 and facts["doc_count"] == 2 and facts["total_chars"] == 3
    assert len(facts["unsure_entities"]) == 10 and facts["unsure_entities"][0]["name"] == "n0" and [x["subject"] for x in facts["unsure_relations"]] == ["n1"]
    seen = []
    answer = {"rationale": "r", "ontology_changes": [{"action": "add", "target": "entity_type", "name": "Z", "reason": "x"}, "bad", {"action": "remove"}], "suggested_strategy": "fast", "enable_gleaning": False, "enable_co_occurrence": None, "suggested_chunk_size": 900, "prompt_additions": ["more"]}
    plan = refine.analyze(pipeline.ModelBackend(lambda p: seen.append(p) or json.dumps(answer)), build_result(spark), PEOPLE, docs, "names are missing")
    assert plan.changes == (Change("add", "entity_type", "Z"),) and "names are missing" in seen[0]
    onto, config, done = refine.apply(plan, PEOPLE, pipeline.Config())
    assert [e.name for e in onto.entity_types] == ["Person", "City", "Z"] and (config.strategy, config.gleaning, config.cooccurrence, config.chunk_size) == ("fast", False, True, 900)
    assert done == {"ontology_updated": True, "strategy_changed": True, "gleaning_toggled": True, "co_occurrence_toggled": False, "chunk_size_changed": True, "tips_added": True}
    assert refine.analyze(pipeline.ModelBackend(lambda p: "x"), build_result(spark), PEOPLE, docs, "  ") == refine.Plan()
    assert refine.apply(refine.Plan(strategy="nonsense"), PEOPLE, pipeline.Config())[1] == pipeline.Config()


SCHEMA = {"entity_types": [{"name": "person", "description": "d"}, {"name": "famous person"}, {"name": " 1. city "}, {"name": "person"}], "relation_types": [{"name": "lives_in", "domain": "Person", "range": "City"}, {"name": ""}]}


@pytest.mark.parametrize("mode", ["text-to-ontology", "relation-to-ontology", "ht-relation-to-ontology", "dense-ontology", "auto", "unknown"])
def test_induction(spark, mode):
    from sparkloom.plans import induce

    docs = spark.createDataFrame([("a", "Ann lives in Paris."), ("b", None)], "doc_id string, text string")
    o = induce.induce(docs, pipeline.ModelBackend(lambda p: json.dumps(SCHEMA)), mode)
    assert [(e.name, e.parent) for e in o.entity_types] == [("Person", None), ("Famous Person", "Person"), ("City", None)]
    assert [(r.name, r.domain, r.range) for r in o.relation_types] == [("lives_in", "Person", "City")]
    assert induce.induce(docs, pipeline.ModelBackend(lambda p: "nothing"), mode) is None
    assert induce.induce(docs.filter("doc_id = 'z'"), pipeline.ModelBackend(lambda p: json.dumps(SCHEMA)), mode) is None


def test_induction_by_clusters(spark):
    from sparkloom.plans import induce

    words = ["Red Apple", "Green Apple", "Sour Apple", "Sweet Apple", "Fast Car", "Slow Car", "Old Car", "New Car"]
    docs = spark.createDataFrame([(str(i), f"The {w} is here. We saw the {w}.") for i, w in enumerate(words)], "doc_id string, text string")

    class Namer(pipeline.Backend):
        def name_clusters(self, groups, samples):
            return [{"name": "kind " + "abcdefgh"[i], "description": g[0]} for i, g in enumerate(groups)]

        def merge_clusters(self, pairs):
            return [{"keep": pairs[0]["a"], "remove": pairs[0]["b"]}] if len(pairs) > 3 else []

    o = induce.induce(docs, Namer(), "affinity-clustering")
    assert len(o.entity_types) >= 2 and {r.name for r in o.relation_types} == {"related_to"}
    pairs = induce.candidates([{"name": str(i), "members": [str(i)]} for i in range(8)])
    assert len(pairs) == 10 and all(int(p["a"]) < int(p["b"]) < int(p["a"]) + 5 for p in pairs)


def test_phases_together(spark):
    out = build_result(spark)
    more = spark.createDataFrame([(0, " n1 ", "P", 0.99), (1, "new", "P", 0.1), (2, "n2", "P", 2 / 30)], "seq long, name string, type string, confidence double")
    got = {(r["name"].strip(), r.type): r.confidence for r in out.all_entities(more).collect()}
    assert len(got) == 31 and got["n1", "P"] == 0.99 and got["new", "P"] == 0.1
    t = spark.createDataFrame([(5, "a", "A", "p", "b", "B", 0.5)], "seq long, subj_name string, subj_type string, predicate string, obj_name string, obj_type string, confidence double")
    assert pipeline.Result(out.entities, out.relations, t).all_triples(t, t.withColumn("predicate", F.lit("q"))).count() == 2


def test_manifest_and_missing_paths(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one")
    kept = str(tmp_path / "kept")
    assert readers.load_manifest(spark, kept).count() == 0
    readers.save_manifest(readers.data_files(spark, str(tmp_path / "a.txt")), kept)
    assert ops.manifest_diff(readers.load_manifest(spark, kept), readers.data_files(spark, str(tmp_path / "a.txt"))).first().state == "unchanged"
    assert [r.text for r in readers.read_documents(spark, [str(tmp_path / "a.txt"), str(tmp_path / "none")]).collect()] == ["one"]
    assert readers.read_documents(spark, str(tmp_path / "none")).count() == 0
    lines = ['{"data": null, "text": "x"}', '{"data": "d", "text": "x"}', '{"text": "t"}', '{"data": 0}', "plain", '{"a": 1}']
    by_row = readers.jsonl_text(spark.createDataFrame([(1, i, x) for i, x in enumerate(lines)], "k long, at long, line string"), "k").first().text
    assert by_row == readers.load_jsonl("\n".join(lines).encode())[0] == "d\nt\nplain"


def test_registry(spark, tmp_path):
    from sparkloom.plans import registry

    assert {"search_in_text", "parse_json", "validate_against_ontology", "deduplicate_entities", "read_file", "write_file", "list_files", "analyze_file_format", "check_code"} <= {t.name for t in registry.tools()}
    path = str(tmp_path / "a.txt")
    assert registry.execute("write_file", {"path": path, "content": "one\ntwo\nthree"}).data == {"path": path, "chars": 13}
    assert registry.execute("read_file", {"path": path, "max_lines": 2}).data == "one\ntwo\n... (1 more lines)"
    assert registry.execute("read_file", {"file": path}).data == "one\ntwo\nthree"  # one argument by another name
    assert registry.execute("list_files", {"path": str(tmp_path), "pattern": "*.txt"}).data == [path]
    assert registry.execute("search_in_text", {"text": "abcabc", "query": "bc", "context": 1}).data == [{"position": 1, "context": "abca"}, {"position": 4, "context": "abc"}]
    assert registry.execute("parse_json", {"text": "```json\n{\"a\": 1}\n```"}).data == {"a": 1}
    assert not registry.execute("nothing", {}).success and not registry.execute("read_file", {"path": path + "x"}).success
    assert registry.execute("validate_against_ontology", {"entities": [{"name": "a", "type": "Z"}, {"name": "b", "type": "P"}], "types": ["P"]}).data == [{"name": "a", "type": "Z"}]
    assert registry.execute("deduplicate_entities", {"entities": [{"name": "a", "type": "P", "confidence": 0.5}, {"name": "a", "type": "P", "confidence": 0.9}]}).data == [{"name": "a", "type": "P", "confidence": 0.9}]
    assert registry.execute("check_code", {"code": "import os"}).data == ["import os"] and registry.execute("analyze_file_format", {"path": path}).data["extension"] == ".txt"

    @registry.skill(registry.SkillMeta("shout", "louder"))
    class Shout(registry.Skill):
        def system_prompt(self):
            return "SHOUT"

        def post_process(self, out, context):
            return {k: v.upper() for k, v in out.items()}

    assert registry.get_skill("shout").post_process({"a": "x"}, {}) == {"a": "X"} and registry.get_skill("none") is None
    assert registry.default_skills() == ["ontology_analyzer", "entity_extractor", "relation_extractor", "quality_checker", "triple_constructor"]
    (tmp_path / "own.py").write_text("from sparkloom.plans import registry\n@registry.skill(registry.SkillMeta('own', 'd'))\nclass Own(registry.Skill):\n    def system_prompt(self):\n        return 'o'\n")
    (tmp_path / "broken.py").write_text("raise ValueError")
    assert registry.discover(str(tmp_path)) == ["broken.py"] and registry.get_skill("own").system_prompt() == "o"
    events = registry.Events()
    heard = []
    events.on(lambda e, d: heard.append(e))
    events.on(lambda e, d: 1 / 0)  # one that fails holds up no other
    events.on(lambda e, d: heard.append(d["x"]))
    events("start", {"x": 5})
    assert heard == ["start", 5] and events.log[0][0] == "start"


def test_ontology_export(spark, tmp_path):
    from sparkloom.sources import sinks

    sinks.write_ontology(spark, Ontology("o", "", (EntityType("A"),)), str(tmp_path / "o"))
    assert json.loads(spark.read.text(str(tmp_path / "o" / "json")).first().value)["entity_types"][0]["name"] == "A"
    assert "  - **A**: " in [r.value for r in spark.read.text(str(tmp_path / "o" / "markdown")).collect()]


@pytest.mark.parametrize(
    "snippet, fine",
    [
        ("x = 1", True), ("", True), ("# only a comment", True), ("import json\nimport re", True), ("from collections import Counter", True), ("s = 'import os; eval(1)'", True),
        ("import os", False), ("import json, os", False), ("import os.path as p", False), ("from urllib.request import urlopen", False), ("import posix", False), ("import fcntl", False), ("import pwd", False),
        ("eval('1')", False), ("x.eval('1')", False), ("io.open('x')", False), ("open('x')", False), ("__import__('os')", False), ("breakpoint()", False),
        ("getattr(o, 'name')", True), ("vars(o)", True), ("dir(o)", True), ("getattr(__builtins__, 'eval')", False), ("vars(__builtins__['x'])", False), ("setattr(globals, 'x', 1)", False),
        ("globals()", False), ("locals()['x']", False), ("__builtins__['eval']", False), ("__builtins__.__dict__['eval']", False), ("sys.modules['os']", False), ("sys['x']", False), ("os.system('x')", False), ("a.os.b()", False),
        ("().__class__", False), ("().__class__.__bases__", False), ("().__closure__", False), ("f.__globals__", False), ("self.__class__", True), ("cls.__dict__", True), ("x.__mro__", False), ("def f(:", False), ("x = (", False),
    ],
)
def test_code_rules(snippet, fine):
    from sparkloom.functions.code import findings

    assert (not findings(snippet)) == fine, findings(snippet)
