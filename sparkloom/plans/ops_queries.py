"""Queries of schema changes, change detection, accounts and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.lineage import fresh
from sparkloom.operators import dedup, graph, ontology, ops
from sparkloom.plans.base import Queries, table
from sparkloom.sources import sinks
from sparkloom.streaming import deltas
from sparkloom.streaming import events as stream

Q = Queries()

DIFF_SQL = """
WITH m AS (SELECT doc_id AS path, md5(coalesce(text, '') || CASE WHEN doc_id % 7 = 0 THEN 'x' ELSE '' END) AS h FROM documents WHERE doc_id % 10 <> 0), c AS (SELECT doc_id AS path, md5(coalesce(text, '')) AS h FROM documents WHERE doc_id % 11 <> 0)
SELECT coalesce(m.path, c.path) AS path, CASE WHEN m.path IS NULL THEN 'added' WHEN c.path IS NULL THEN 'deleted' WHEN m.h = c.h THEN 'unchanged' ELSE 'modified' END AS state FROM m FULL OUTER JOIN c ON m.path = c.path
"""


@Q.add(DIFF_SQL)
def manifest_diff(spark, d):
    docs = table(spark, d, "documents").withColumn("text", F.coalesce("text", F.lit("")))
    old = docs.filter("doc_id % 10 <> 0").withColumn("text", F.concat("text", F.when(F.col("doc_id") % 7 == 0, "x").otherwise("")))
    hashed = lambda x: ops.doc_hash(x).withColumnRenamed("doc_id", "path")
    return ops.manifest_diff(hashed(old), hashed(docs.filter("doc_id % 11 <> 0")))


USAGE_SQL = """
WITH e AS (SELECT user_id AS agent, CAST(floor(abs(value) * 100) AS BIGINT) AS counter, lag(CAST(floor(abs(value) * 100) AS BIGINT)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events)
SELECT agent, CAST(sum(greatest(0, counter - coalesce(before, 0))) AS BIGINT) AS tokens FROM e GROUP BY agent
"""


@Q.add(USAGE_SQL)
def token_usage(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("agent"), F.struct("ts", "event_id").alias("at"), F.floor(F.abs("value") * 100).cast("long").alias("counter"))
    return ops.token_usage(e)


BREAK_SQL = """
WITH e AS (SELECT user_id AS agent, ts, event_id, event_type = 'error' AS failed, sum(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM events),
     f AS (SELECT *, row_number() OVER (PARTITION BY agent, run ORDER BY ts, event_id) AS nth FROM e WHERE failed)
SELECT agent, event_id FROM f WHERE nth = 3 QUALIFY row_number() OVER (PARTITION BY agent ORDER BY ts, event_id) = 1
"""


@Q.add(BREAK_SQL)
def circuit_breaker(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("agent"), F.struct("ts", "event_id").alias("at"), (F.col("event_type") == "error").alias("failed"))
    return ops.circuit_breaker(e).select("agent", F.col("at.event_id").alias("event_id"))


COMPACT_SQL = """
WITH m AS (SELECT conv_id AS agent, turn AS seq, role, text AS content, count(*) OVER (PARTITION BY conv_id) AS n, count(*) FILTER (role = 'system') OVER (PARTITION BY conv_id) AS s, row_number() OVER (PARTITION BY conv_id, role = 'system' ORDER BY turn DESC) AS back FROM conversations),
     k AS (SELECT *, n <= 4 OR role = 'system' OR back <= greatest(1, 4 - s - 1) AS kept FROM m),
     x AS (SELECT *, row_number() OVER (PARTITION BY agent ORDER BY seq) AS nth FROM k WHERE NOT kept),
     z AS (SELECT agent, NULL AS seq, 'system' AS role, '[Context Summary - earlier conversation]' || chr(10) || chr(10) || coalesce(string_agg('- [' || role || '] ' || replace(substr(content, 1, 200), chr(10), ' ') || '...', chr(10) ORDER BY seq) FILTER (nth <= 10 AND role IN ('user', 'assistant')), '') || chr(10) || chr(10) || '[' || count(*) || ' total earlier messages summarized]' AS content FROM x GROUP BY agent)
SELECT agent, seq, role, content FROM k WHERE kept UNION ALL SELECT * FROM z
"""


@Q.add(COMPACT_SQL)
def message_compaction(spark, d):
    m = table(spark, d, "conversations").select(F.col("conv_id").alias("agent"), F.col("turn").alias("seq"), "role", F.col("text").alias("content"))
    return ops.compact(m, 4)


@Q.add("WITH p AS (SELECT min(event_id) AS ord, event_type AS phase, count(*)::DOUBLE AS weight FROM events GROUP BY event_type) SELECT ord, phase, least(98.0, 100.0 * sum(weight) OVER (ORDER BY ord) / sum(weight) OVER ())::DOUBLE AS done_share FROM p")
def phase_progress(spark, d):
    """Kinds of events as phases, in order of their first event, weighted by how many there are."""
    e = table(spark, d, "events").groupBy(F.col("event_type").alias("phase")).agg(F.min("event_id").alias("ord"), F.count(F.lit(1)).cast("double").alias("weight"))
    return ops.phase_progress(e)


@Q.add("""
WITH b AS (SELECT row_number() OVER (ORDER BY r_regionkey) AS number, r_name AS build_id, count(n_nationkey) AS n_rows FROM region LEFT JOIN nation ON n_regionkey = r_regionkey GROUP BY r_regionkey, r_name)
SELECT number, build_id, 'build ' || number AS summary, n_rows FROM b ORDER BY number DESC LIMIT 3
""")
def build_history(spark, d):
    """A build for each region under a commit log, the last three of its history, and what each version holds."""
    log, nations = sinks.Snapshots(spark, fresh(spark, "history")), table(spark, d, "nation")
    regions = table(spark, d, "region").orderBy("r_regionkey").limit(100).collect()  # one commit each
    for i, r in enumerate(regions, 1):
        log.commit(r["r_name"], f"build {i}", nations=nations.filter(F.col("n_regionkey") == r["r_regionkey"]))
    sizes = None
    for r in regions:
        own = log.read("nations", r["r_name"]).agg(F.count(F.lit(1)).alias("n_rows")).withColumn("build_id", F.lit(r["r_name"]))
        sizes = own if sizes is None else sizes.unionByName(own)
    return log.history(3).join(sizes, "build_id").select("number", "build_id", "summary", "n_rows")


PARENT_SQL = """
WITH n AS (SELECT DISTINCT p_name AS name FROM part UNION SELECT DISTINCT string_split(p_name, ' ')[-1] FROM part UNION SELECT DISTINCT string_split(p_name, ' ')[1] FROM part),
     t AS (SELECT name, CASE WHEN length(name) % 5 = 0 THEN upper(string_split(name, ' ')[1]) END AS given FROM n)
SELECT t.name, coalesce(g.name, (SELECT max_by(o.name, length(o.name)) FROM n o WHERE ends_with(lower(t.name), ' ' || lower(o.name)))) AS parent FROM t LEFT JOIN n g ON lower(g.name) = lower(t.given)
"""


@Q.add(PARENT_SQL)
def parent_inference(spark, d):
    w = F.split("p_name", " ")
    n = table(spark, d, "part").select(F.explode(F.array("p_name", F.element_at(w, -1), w[0])).alias("name")).distinct()
    given = F.when(F.length("name") % 5 == 0, F.upper(F.split("name", " ")[0]))
    return ontology.parents(n.select(F.xxhash64("name").alias("ord"), "name", given.alias("parent"))).select("name", "parent")


def _types(spark, d):
    return table(spark, d, "nation").select(F.col("n_nationkey").alias("ord"), F.col("n_name").alias("name"), F.concat(F.lit("in region "), F.col("n_regionkey").cast("string")).alias("description"), F.when(F.col("n_nationkey") % 2 == 0, "Nation").alias("parent"))


@Q.add("SELECT 'related_to' AS name, a.n_name AS domain, b.n_name AS range, 'Relation between ' || a.n_name || ' and ' || b.n_name AS description FROM nation a JOIN nation b ON b.n_nationkey > a.n_nationkey AND b.n_nationkey <= a.n_nationkey + 3")
def default_related_to(spark, d):
    return ontology.default_relations(_types(spark, d))


CHANGES = "SELECT * FROM VALUES (0, 'remove', '{0}', '', cast(null AS string)), (1, 'modify', '{1}', 'changed', cast(null AS string)), (2, 'modify', '{2}', '', 'Other'), (3, 'add', 'Atlantis', 'new', 'Nation') AS t(ord, action, name, description, parent)"


@Q.add("""
WITH c AS (SELECT n_nationkey AS ord, n_name AS name, 'in region ' || n_regionkey AS description, CASE WHEN n_nationkey % 2 = 0 THEN 'Nation' END AS parent FROM nation)
SELECT CAST(ord AS BIGINT) AS ord, name, CASE WHEN ord = 1 THEN 'changed' ELSE description END AS description, CASE WHEN ord = 2 THEN 'Other' ELSE parent END AS parent FROM c WHERE ord <> 0
UNION ALL SELECT (SELECT max(ord) FROM c) + 4, 'Atlantis', 'new', 'Nation'
""")
def ontology_apply_changes(spark, d):
    t = _types(spark, d)
    names = [r["name"] for r in t.filter("ord < 3").orderBy("ord").collect()]
    return ontology.apply_changes(t, spark.sql(CHANGES.format(*names))).withColumn("ord", F.col("ord").cast("long"))


@Q.add("SELECT n_name AS line, 'added' AS change FROM nation WHERE n_nationkey >= 20 UNION ALL SELECT n_name, 'removed' FROM nation WHERE n_nationkey < 5")
def ontology_diff(spark, d):
    n = table(spark, d, "nation")
    return ontology.text_diff(n.filter("n_nationkey < 20").select(F.col("n_name").alias("line")), n.filter("n_nationkey >= 5").select(F.concat(F.lit("  "), "n_name").alias("line")))


@Q.add("""
SELECT 'Entity Types' AS section, n_nationkey AS ord, '  - **' || n_name || '**' || CASE WHEN n_nationkey % 2 = 0 THEN ' (subtype of: Nation)' ELSE '' END || ': in region ' || n_regionkey AS line FROM nation
UNION ALL SELECT 'Relation Types', r_regionkey, '  - **' || r_name || '** from `Region`' || CASE WHEN r_regionkey % 2 = 1 THEN ' to `Nation`' ELSE '' END || ': ' FROM region
""")
def ontology_guide(spark, d):
    r = table(spark, d, "region").select(F.col("r_regionkey").alias("ord"), F.col("r_name").alias("name"), F.lit(None).cast("string").alias("description"), F.lit("Region").alias("domain"), F.when(F.col("r_regionkey") % 2 == 1, "Nation").alias("range"))
    return ontology.guide_lines(_types(spark, d), r)


@Q.add("SELECT p_name AS predicate, count(*) AS n, count(*) / (SELECT count(*) FROM part) AS share FROM part GROUP BY p_name ORDER BY n DESC, p_name LIMIT 20")
def preset_top_relations(spark, d):
    return ontology.top_relations(table(spark, d, "part").select(F.col("p_name").alias("predicate")), 20)


@Q.add("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def event_windows(spark, d):
    """An extension: hourly windows, the same transformation in batch as on the stream."""
    return stream.windowed(table(spark, d, "events"), "1 hour").select(F.col("window.start").alias("start"), "event_type", "n")


#: Words of ten letters or more as entities, and each with the next one of its document as a pair, over the documents that are left.
FACTS_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z]{10,}') AS w FROM documents WHERE doc_id % 7 <> 3),
     e AS (SELECT DISTINCT doc_id, unnest(w) AS name FROM d),
     p AS (SELECT doc_id, unnest(range(1, len(w))) AS i, w FROM d)
"""


def _facts(docs):
    words = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit("[a-z]{10,}"), 0)
    own = docs.select("doc_id", words.alias("w"))
    entity = F.transform(F.array_distinct("w"), lambda x: F.struct(F.lit("entity").alias("kind"), x.alias("a"), F.concat(F.lit("W"), (F.length(x) % 3).cast("string")).alias("b"), (F.col("doc_id") % 10 / 10.0).alias("confidence"), F.col("doc_id").alias("seq")))
    null = lambda kind: F.lit(None).cast(kind)
    pair = F.transform(F.slice("w", F.lit(1), F.greatest(F.size("w") - 1, F.lit(0))), lambda x, i: F.struct(F.lit("pair").alias("kind"), x.alias("a"), F.get("w", i + 1).alias("b"), null("double").alias("confidence"), null("long").alias("seq")))
    return own.select("doc_id", F.explode(F.concat(entity, pair)).alias("f")).select("doc_id", "f.*")


def _best(totals):
    own = totals.filter("kind = 'entity'").select(F.col("a").alias("name"), F.col("b").alias("type"), "confidence", "seq", "n")
    docs = own.groupBy("name", "type").agg(F.sum("n").alias("docs"))
    return dedup.best_of(own, name=F.col("name"), type=F.col("type")).drop("n").join(docs, ["name", "type"]).withColumnsRenamed({"name": "a", "type": "b"})


def _incremental(spark, d):
    """A build of three quarters of the documents, some with another text; then all texts as they are, more documents, and every seventh gone."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    first = docs.filter("doc_id % 4 <> 1").withColumn("text", F.when(F.col("doc_id") % 10 == 0, F.reverse("text")).otherwise(F.col("text")))
    columns = ["kind", "a", "b", "confidence", "seq"]
    pairs = lambda totals: totals.filter("kind = 'pair'").groupBy("a", "b").agg(F.sum("n").alias("cnt"))
    build = deltas.IncrementalBuild(spark, fresh(spark, "build"), _facts, columns, {"entities": (["a", "b"], _best), "pairs": (["a", "b"], pairs)})
    build.update("first", first)
    build.update("second", docs.filter("doc_id % 7 <> 3"))
    return build


@Q.add(FACTS_SQL + """, f AS (SELECT name, 'W' || (length(name) % 3) AS type, doc_id % 10 / 10.0::DOUBLE AS confidence, doc_id AS seq, count(*) OVER (PARTITION BY name) AS docs FROM e)
SELECT name, type, confidence, seq, docs FROM f QUALIFY row_number() OVER (PARTITION BY name, type ORDER BY confidence DESC, seq) = 1""")
def incremental_entities(spark, d):
    """The best entity of each name, kept through an update that adds, changes and removes documents."""
    return _incremental(spark, d).read("entities").select(F.col("a").alias("name"), F.col("b").alias("type"), "confidence", "seq", "docs")


@Q.add(FACTS_SQL + "SELECT w[i] AS a, w[i + 1] AS b, count(*) AS cnt FROM p GROUP BY 1, 2")
def incremental_pairs(spark, d):
    """Weights of pairs, kept through the same update."""
    return _incremental(spark, d).read("pairs").select("a", "b", "cnt")


@Q.add("""
WITH RECURSIVE t AS (SELECT DISTINCT p_type || ' ' || p_brand AS type, p_type AS parent FROM part UNION SELECT DISTINCT p_type, 'Part' FROM part UNION SELECT 'Part', NULL),
     up AS (SELECT type, type AS ancestor, 0 AS depth FROM t UNION SELECT u.type, t.parent, u.depth + 1 FROM up u JOIN t ON t.type = u.ancestor WHERE t.parent IS NOT NULL)
SELECT type, ancestor, min(depth) AS depth FROM up GROUP BY type, ancestor
""")
def type_hierarchy(spark, d):
    """Brands below kinds of parts below parts: each type with all types above it."""
    return ontology.hierarchy(_part_types(spark, d)).select("type", "ancestor", "depth")


def _part_types(spark, d):
    p = table(spark, d, "part").select("p_type", "p_brand").distinct()
    own = p.select(F.concat_ws(" ", "p_type", "p_brand").alias("name"), F.col("p_type").alias("parent"))
    return own.union(p.select("p_type", F.lit("Part")).distinct()).union(spark.sql("SELECT 'Part', cast(null AS string)"))


@Q.add("""
SELECT DISTINCT p_name AS subj_name, min(p_type || ' ' || p_brand) OVER (PARTITION BY p_name, p_type) AS subj_type, 'of_' || lower(p_type) AS predicate, p_brand AS obj_name, 'Brand' AS obj_type, 0.9::DOUBLE AS confidence FROM part
""")
def triples_subtypes(spark, d):
    """Domains that name a kind of part, which brands of that kind satisfy as types below it."""
    p = table(spark, d, "part").select(F.col("p_partkey").cast("long").alias("seq"), "p_name", "p_type", "p_brand")
    brands = p.groupBy("p_brand").agg(F.min("seq").alias("seq")).select((F.col("seq") + 10**9).alias("seq"), F.col("p_brand").alias("name"), F.lit("Brand").alias("type"))
    entities = p.select("seq", F.col("p_name").alias("name"), F.concat_ws(" ", "p_type", "p_brand").alias("type")).unionByName(brands)
    predicate = F.concat(F.lit("of_"), F.lower("p_type"))
    relations = p.select("seq", F.col("p_name").alias("subject"), predicate.alias("predicate"), F.col("p_brand").alias("object"), F.lit(0.9).alias("confidence"), F.lit("").alias("evidence"))
    kinds = p.select(predicate.alias("name"), F.col("p_type").alias("domain")).distinct().select(F.xxhash64("name").alias("ord"), "name", "domain", F.lit(None).cast("string").alias("range"))
    out = graph.triples(relations, entities, kinds, ancestors=ontology.hierarchy(_part_types(spark, d)))
    return out.select("subj_name", "subj_type", "predicate", "obj_name", "obj_type", "confidence")
