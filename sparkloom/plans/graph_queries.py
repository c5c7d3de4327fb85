"""Queries of extraction, resolution and graph building."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions import rdf
from sparkloom.lineage import cut
from sparkloom.operators import dedup, graph, ontology, resolve
from sparkloom.operators.structured import Mapped, structured_entities as entities_of, structured_relations as relations_of
from sparkloom.plans.base import Queries, table
from sparkloom.sources import sinks

Q = Queries()
MILLION = 1_000_000


def _rows(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    nations = n.select(F.col("n_nationkey").cast("long").alias("seq"), "n_name", "r_name", F.lit("nation").alias("_source"))
    c = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return nations, c.select((F.col("c_custkey") + MILLION).alias("seq"), "c_name", "n_name", F.lit("customer").alias("_source"))


NATION = [Mapped("n_name", "id", "Nation"), Mapped("r_name", "reference", "Region", "in_region")]
CUSTOMER = [Mapped("c_name", "id", "Customer"), Mapped("n_name", "reference", "Nation", "from_nation")]


def star(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Entities and relations of customers, nations and regions."""
    nations, customers = _rows(spark, d)
    e = entities_of(nations, NATION).unionByName(entities_of(customers, CUSTOMER))
    r = relations_of(nations, NATION).unionByName(relations_of(customers, CUSTOMER))
    return dedup.first_of(e, name=F.col("name"), type=F.col("type")), dedup.relations_first(r)


#: The same in SQL, by the rank that seq gives: table, row, column.
STAR = """
WITH e0 AS (SELECT 0 AS o, n_nationkey AS k, 0 AS p, n_name AS name, 'Nation' AS type, 0.95::DOUBLE AS confidence FROM nation
            UNION ALL SELECT 0, n_nationkey, 1, r_name, 'Region', 0.9 FROM nation JOIN region ON n_regionkey = r_regionkey
            UNION ALL SELECT 1, c_custkey, 0, c_name, 'Customer', 0.95 FROM customer JOIN nation ON c_nationkey = n_nationkey
            UNION ALL SELECT 1, c_custkey, 1, n_name, 'Nation', 0.9 FROM customer JOIN nation ON c_nationkey = n_nationkey),
     e AS (SELECT * FROM e0 QUALIFY row_number() OVER (PARTITION BY name, type ORDER BY o, k, p) = 1),
     r0 AS (SELECT 0 AS o, n_nationkey AS k, n_name AS subject, 'in_region' AS predicate, r_name AS object, 'Row from nation' AS evidence FROM nation JOIN region ON n_regionkey = r_regionkey
            UNION ALL SELECT 1, c_custkey, c_name, 'from_nation', n_name, 'Row from customer' FROM customer JOIN nation ON c_nationkey = n_nationkey),
     r AS (SELECT *, 0.9::DOUBLE AS confidence FROM r0 WHERE subject <> object QUALIFY row_number() OVER (PARTITION BY subject, predicate, object ORDER BY o, k) = 1)
"""


@Q.add(STAR + "SELECT name, type, confidence FROM e")
def structured_entities(spark, d):
    return star(spark, d)[0].select("name", "type", "confidence")


@Q.add(STAR + "SELECT subject, predicate, object, confidence, evidence FROM r")
def structured_relations(spark, d):
    return star(spark, d)[1].select("subject", "predicate", "object", "confidence", "evidence")


MULTI_SQL = """
WITH r AS (SELECT p_partkey, p_brand AS id, p_type || '， ' || replace(p_name, ' ', ',') || ',, ' AS tags FROM part),
     v AS (SELECT id, trim(unnest(string_split(replace(tags, '，', ','), ','))) AS name FROM r)
SELECT DISTINCT id AS subject, 'tagged' AS predicate, name AS object FROM v WHERE name <> '' AND name <> id
"""


@Q.add(MULTI_SQL)
def structured_multivalue(spark, d):
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("seq"), F.col("p_brand").alias("id"), F.concat("p_type", F.lit("， "), F.replace("p_name", F.lit(" "), F.lit(",")), F.lit(",, ")).alias("tags"))
    return relations_of(rows, [Mapped("id", "id", "Brand"), Mapped("tags", "reference", "Tag", "tagged", True)]).select("subject", "predicate", "object")


RELATION_TYPES = "SELECT * FROM VALUES (0, 'in_region', 'Nation', 'Region', 'region_of'), (1, 'from_nation', 'Customer', 'Nation', cast(null AS string)) AS t(ord, name, domain, range, inverse)"


def _twice(spark, d):
    """Entities in which every nation first appears as a place, relations, exact matches of ends."""
    e, r = star(spark, d)
    places = table(spark, d, "nation").select((F.col("n_nationkey").cast("long") - 1000).alias("seq"), F.col("n_name").alias("name"), F.lit("Place").alias("type"), F.lit(0.5).alias("confidence"))
    e = e.unionByName(places)
    queries = r.select(F.col("subject").alias("query")).union(r.select("object")).distinct()
    found = resolve.exact(queries, resolve.dictionary(e)).select("query", "ename", "etype", F.lit(0.0).alias("penalty"))
    return e, r, found


def _triples(spark, d):
    e, r, found = _twice(spark, d)
    return graph.triples(r, e, spark.sql(RELATION_TYPES), found)


TRIPLES = STAR + """, t AS (SELECT subject AS subj_name, CASE predicate WHEN 'in_region' THEN 'Nation' ELSE 'Customer' END AS subj_type, predicate, object AS obj_name, CASE predicate WHEN 'in_region' THEN 'Region' ELSE 'Nation' END AS obj_type, confidence, evidence FROM r)
"""


@Q.add(TRIPLES + "SELECT * FROM t")
def triples_domain_range(spark, d):
    return _triples(spark, d).drop("seq")


@Q.add(STAR + "SELECT subject AS subj_name, CASE WHEN predicate = 'in_region' THEN 'Place' ELSE 'Customer' END AS subj_type, predicate, object AS obj_name, CASE WHEN predicate = 'in_region' THEN 'Region' ELSE 'Place' END AS obj_type FROM r")
def triples_exact(spark, d):
    """Without a schema the first entity of a name stands for it."""
    e, r, found = _twice(spark, d)
    return graph.triples(r, e, None, found).select("subj_name", "subj_type", "predicate", "obj_name", "obj_type")


@Q.add(TRIPLES + "SELECT subj_name, subj_type, predicate, obj_name, obj_type FROM t UNION ALL SELECT obj_name, obj_type, 'region_of', subj_name, subj_type FROM t WHERE predicate = 'in_region'")
def triples_inverse(spark, d):
    return graph.with_inverses(_triples(spark, d), spark.sql(RELATION_TYPES)).select("subj_name", "subj_type", "predicate", "obj_name", "obj_type")


URI = "url_encode({0})"
NT_SQL = TRIPLES + f""", n AS (SELECT '<' || {URI.format('type')} || '/' || {URI.format('name')} || '>' AS node, {URI.format('type')} AS type, name, confidence FROM e)
SELECT node || ' <{rdf.RDF_TYPE}> <' || type || '> .' AS line FROM n
UNION ALL SELECT node || ' <{rdf.NAME}> "' || replace(replace(name, chr(92), chr(92) || chr(92)), '"', chr(92) || '"') || '"^^<{rdf.XSD_STRING}> .' FROM n
UNION ALL SELECT node || ' <confidence> "' || confidence || '"^^<{rdf.XSD_STRING}> .' FROM n
UNION ALL SELECT '<' || {URI.format('subj_type')} || '/' || {URI.format('subj_name')} || '> <' || {URI.format('predicate')} || '> <' || {URI.format('obj_type')} || '/' || {URI.format('obj_name')} || '> .' FROM t
"""


@Q.add(NT_SQL)
def nt_lines(spark, d):
    e, _ = star(spark, d)
    e = e.withColumn("attributes", F.create_map(F.lit("confidence"), F.col("confidence").cast("string"), F.lit("none"), F.lit(None).cast("string")))
    return sinks.nt_lines(e, _triples(spark, d))


@Q.add(STAR + "SELECT to_json({'name': name, 'type': type, 'confidence': confidence})::VARCHAR AS value FROM e UNION ALL SELECT to_json({'subject': subject, 'predicate': predicate, 'object': object, 'confidence': confidence, 'evidence': evidence})::VARCHAR FROM r")
def export_json(spark, d):
    e, r = star(spark, d)
    return sinks.entity_json(e).unionByName(sinks.relation_json(r))


@Q.add(TRIPLES + """SELECT '{"data": "' || evidence || '", "triple": [[{"' || subj_name || '":"' || subj_type || '"}, "' || predicate || '", {"' || obj_name || '":"' || obj_type || '"}]]}' AS value FROM t""")
def export_jsonl(spark, d):
    return sinks.jsonl_lines(_triples(spark, d))


#: Raw mentions from events: names by type and user, confidence from the value.
RAW = "SELECT event_id AS seq, CASE WHEN event_id % 2 = 1 THEN ' ' ELSE '' END || event_type || '_' || (user_id % 40) AS name, 'T' || (user_id % 3) AS type, CASE WHEN event_id % 7 = 0 THEN NULL ELSE round(value % 1, 1) END AS confidence FROM events"


def _raw(spark, d):
    e = table(spark, d, "events")
    name = F.concat(F.when(F.col("event_id") % 2 == 1, " ").otherwise(""), "event_type", F.lit("_"), (F.col("user_id") % 40).cast("string"))
    return e.select(F.col("event_id").alias("seq"), name.alias("name"), F.concat(F.lit("T"), (F.col("user_id") % 3).cast("string")).alias("type"), F.when(F.col("event_id") % 7 != 0, F.round(F.col("value") % 1, 1)).alias("confidence"))


def _best(key: str) -> str:
    return f"WITH raw AS ({RAW}) SELECT seq, name, type, confidence FROM raw WHERE confidence IS NOT NULL QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY confidence DESC, seq) = 1"


@Q.add(_best("name, type"))
def entity_dedup(spark, d):
    return dedup.entities_exact(_raw(spark, d).filter("confidence is not null"))


@Q.add(_best("trim(name), type"))
def final_entities(spark, d):
    return dedup.entities_final(_raw(spark, d).filter("confidence is not null"))


TOOL_SQL = f"""
WITH raw AS ({RAW}), k AS (SELECT *, trim(name) || '|' || type AS k, row_number() OVER (PARTITION BY trim(name) || '|' || type ORDER BY seq) AS nth FROM raw)
SELECT seq, name, type, confidence FROM k QUALIFY row_number() OVER (PARTITION BY k ORDER BY coalesce(confidence, CASE WHEN nth = 1 THEN 0.0 ELSE 1.0 END) DESC, seq) = 1
"""


@Q.add(TOOL_SQL)
def entity_dedup_tool(spark, d):
    return dedup.entities_by_tool(_raw(spark, d))


@Q.add()
def entity_dedup_fuzzy(spark, d):
    p = table(spark, d, "part").groupBy(F.col("p_name").alias("name")).agg(F.min("p_partkey").alias("seq"), F.min_by("p_brand", "p_partkey").alias("brand"))
    rows = p.select("seq", "name", F.element_at(F.split("name", " "), -1).alias("type"), (F.col("seq") % 10 / 10.0).alias("confidence"), F.create_map(F.lit("brand"), F.col("brand")).alias("attributes"))
    return dedup.entities_fuzzy(rows).select("seq", "name", "type", "confidence")


GLEAN_SQL = """
WITH a AS (SELECT s_suppkey AS seq, s_name AS name, 'Supplier' AS type, 'in ' || s_nationkey AS description, 0.5 + s_suppkey % 5 / 10.0 AS confidence FROM supplier WHERE s_suppkey % 3 <> 0),
     b AS (SELECT s_suppkey + 100000 AS seq, s_name AS name, 'Supplier' AS type, CASE WHEN s_suppkey % 2 = 0 THEN 'a longer description' ELSE '' END AS description, 0.7::DOUBLE AS confidence FROM supplier WHERE s_suppkey % 3 <> 1)
SELECT coalesce(a.name, b.name) AS name, coalesce(a.type, b.type) AS type, CASE WHEN length(coalesce(b.description, '')) > length(coalesce(a.description, '')) THEN b.description ELSE coalesce(a.description, b.description) END AS description,
       CASE WHEN a.confidence IS NULL THEN b.confidence WHEN b.confidence IS NULL THEN a.confidence ELSE greatest(a.confidence, b.confidence) END AS confidence, coalesce(a.seq, b.seq) AS seq
FROM a FULL OUTER JOIN b ON a.name = b.name AND a.type = b.type
"""


@Q.add(GLEAN_SQL)
def gleaning_merge(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("seq"), F.col("s_name").alias("name"), F.lit("Supplier").alias("type"), "s_nationkey")
    a = s.filter("seq % 3 <> 0").select("seq", "name", "type", F.concat(F.lit("in "), F.col("s_nationkey").cast("string")).alias("description"), (0.5 + F.col("seq") % 5 / 10.0).alias("confidence"))
    b = s.filter("seq % 3 <> 1").select((F.col("seq") + 100000).alias("seq"), "name", "type", F.when(F.col("seq") % 2 == 0, "a longer description").otherwise("").alias("description"), F.lit(0.7).alias("confidence"))
    return dedup.gleaning_merge(a, b)


SHIPS = "SELECT (l_orderkey * 10 + l_linenumber) * 100 + CAST(round(l_discount * 100) AS BIGINT) AS seq, 'S' || l_suppkey AS subject, 'ships' AS predicate, 'P' || (l_partkey % 50) AS object, 1 - l_discount AS confidence FROM lineitem"


def _ships(spark, d):
    l = table(spark, d, "lineitem")  # noqa: E741
    return l.select(((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 100 + F.round(F.col("l_discount") * 100).cast("long")).alias("seq"), F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("subject"), F.lit("ships").alias("predicate"), F.concat(F.lit("P"), (F.col("l_partkey") % 50).cast("string")).alias("object"), (1 - F.col("l_discount")).alias("confidence"))


@Q.add(f"WITH r AS ({SHIPS}) SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY subject, predicate, object ORDER BY confidence DESC, seq) = 1")
def relation_dedup(spark, d):
    return dedup.relations_best(_ships(spark, d))


@Q.add(f"WITH r AS ({SHIPS}) SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY subject, predicate, object ORDER BY seq) = 1")
def relation_dedup_first(spark, d):
    return dedup.relations_first(_ships(spark, d))


#: Names of parts as a dictionary, and names bent in several ways that are to be found in it.
NAMES = """
WITH dict AS (SELECT p_name AS ename, min(p_partkey) AS eseq FROM part WHERE p_partkey % 2 = 0 GROUP BY 1),
     q AS (SELECT DISTINCT p_name AS query FROM part UNION SELECT DISTINCT upper(p_name) || '!' FROM part UNION SELECT DISTINCT p_name[1:5] FROM part UNION SELECT DISTINCT reverse(p_name) FROM part UNION SELECT DISTINCT p_name || 's' FROM part)
"""


def _bent(spark, d):
    p = table(spark, d, "part")
    e = p.filter("p_partkey % 2 = 0").select(F.col("p_partkey").alias("seq"), F.col("p_name").alias("name"), F.lit("Part").alias("type"))
    n = F.col("p_name")
    q = p.select(F.explode(F.array(n, F.concat(F.upper(n), F.lit("!")), F.substring(n, 1, 5), F.reverse(n), F.concat(n, F.lit("s")))).alias("query")).distinct()
    return q, e


@Q.add(NAMES + "SELECT query, ename FROM q JOIN dict ON query = ename")
def fuzzy_match_exact(spark, d):
    q, e = _bent(spark, d)
    return resolve.exact(q, resolve.dictionary(e)).select("query", "ename")


_N = r"lower(regexp_replace({0}, '[\s\p{{Z}}，,。．.、；;：:！!？?\"\[\]()<>]', '', 'g'))"


@Q.add(NAMES + f"SELECT query, min_by(ename, eseq) AS ename FROM q JOIN dict ON {_N.format('query')} = {_N.format('ename')} GROUP BY query")
def fuzzy_match_normalized(spark, d):
    q, e = _bent(spark, d)
    return resolve.normalized(q, resolve.dictionary(e)).select("query", "ename")


@Q.add(NAMES + "SELECT query, min_by(ename, eseq) AS ename FROM q JOIN dict ON length(query) >= 2 AND length(ename) >= 2 AND (contains(lower(query), lower(ename)) OR contains(lower(ename), lower(query))) GROUP BY query")
def fuzzy_match_substring(spark, d):
    q, e = _bent(spark, d)
    return resolve.substring(q, resolve.dictionary(e)).select("query", "ename")


_L = "list_distinct(string_split({0}, ''))"


@Q.add(NAMES + f"""
, a AS (SELECT query, {_N.format('query')} AS n FROM q), b AS (SELECT ename, eseq, {_N.format('ename')} AS n FROM dict)
SELECT query, min_by(ename, eseq) AS ename FROM a JOIN b ON length(a.n) BETWEEN 1 AND 15 AND length(b.n) BETWEEN 1 AND 15
  AND len(list_intersect({_L.format('a.n')}, {_L.format('b.n')})) / greatest(len({_L.format('a.n')}), len({_L.format('b.n')})) >= 0.7 GROUP BY query
""")
def fuzzy_match_char_overlap(spark, d):
    q, e = _bent(spark, d)
    return resolve.char_overlap(q, resolve.dictionary(e)).select("query", "ename")


@Q.add()
def fuzzy_match_ratio(spark, d):
    q, e = _bent(spark, d)
    return resolve.fuzzy(q, resolve.dictionary(e)).select("query", "ename", "ratio")


@Q.add()
def fuzzy_match_full(spark, d):
    q, e = _bent(spark, d)
    return resolve.waterfall(q, e)


MATCH_SQL = f"""
WITH n AS (SELECT DISTINCT p_brand AS name FROM part UNION SELECT n_name FROM nation UNION SELECT lower(n_name) || 's' FROM nation), m AS (SELECT name, {_N.format('name')} AS n FROM n)
SELECT a.name AS a, b.name AS b FROM m a JOIN m b ON a.name < b.name WHERE a.n <> '' AND b.n <> '' AND (a.n = b.n OR (length(a.n) >= 2 AND contains(b.n, a.n)) OR (length(b.n) >= 2 AND contains(a.n, b.n)) OR (length(a.n) <= 20 AND length(b.n) <= 20 AND levenshtein(a.n, b.n) <= 3))
"""


@Q.add(MATCH_SQL)
def entity_match_pairs(spark, d):
    n = table(spark, d, "nation").select("n_name")
    names = table(spark, d, "part").select(F.col("p_brand").alias("name")).union(n).union(n.select(F.concat(F.lower("n_name"), F.lit("s")))).distinct()
    return resolve.match_pairs(names)


PLACE_SQL = """
WITH c AS (SELECT c_custkey, c_name FROM customer WHERE c_custkey % 3 <> 0),
     r AS (SELECT o_orderkey, 'O' || o_orderkey AS subject, c_name AS object, CASE WHEN o_orderkey % 2 = 0 THEN 0.9::DOUBLE ELSE 0.2::DOUBLE END AS confidence, k.c_custkey FROM orders JOIN customer k ON o_custkey = k.c_custkey)
SELECT subject AS subj_name, 'Order' AS subj_type, 'placed_by' AS predicate, object AS obj_name, CASE WHEN c_custkey % 3 = 0 THEN 'Entity' ELSE 'Customer' END AS obj_type,
       CASE WHEN c_custkey % 3 = 0 THEN least(confidence, 0.35::DOUBLE) ELSE confidence END AS confidence FROM r
"""


@Q.add(PLACE_SQL)
def triples_placeholder(spark, d):
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    r = o.join(c, F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("seq"), F.concat(F.lit("O"), F.col("o_orderkey").cast("string")).alias("subject"), F.lit("placed_by").alias("predicate"), F.col("c_name").alias("object"), F.when(F.col("o_orderkey") % 2 == 0, 0.9).otherwise(0.2).alias("confidence"), F.lit("").alias("evidence"))
    e = c.filter("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("seq"), F.col("c_name").alias("name"), F.lit("Customer").alias("type")).unionByName(r.select((F.col("seq") + 10 * MILLION).alias("seq"), F.col("subject").alias("name"), F.lit("Order").alias("type")))
    queries = r.select(F.col("subject").alias("query")).union(r.select("object")).distinct()
    found = resolve.exact(queries, resolve.dictionary(e)).withColumn("penalty", F.lit(0.0))
    return graph.triples(r, e, None, found).drop("seq", "evidence")


@Q.add(STAR + "SELECT subject AS subj_name, CASE WHEN predicate = 'in_region' THEN 'Nation' ELSE 'Entity' END AS subj_type, predicate, object AS obj_name, CASE WHEN predicate = 'in_region' THEN 'Region' ELSE 'Nation' END AS obj_type, confidence FROM r")
def fast_triples(spark, d):
    e, r = star(spark, d)
    return graph.fast_triples(r, e.filter("type <> 'Customer'")).drop("seq")


#: The forty most frequent words of documents as a gazetteer of three types.
GAZETTEER = r"""
WITH w AS (SELECT DISTINCT doc_id, unnest(string_split_regex(trim(lower(text), E' \t\n\x0b\x0c\r'), '\s+')) AS name FROM documents),
     g AS (SELECT name, 'T' || ((row_number() OVER (ORDER BY count(*) DESC, name) - 1) % 3) AS type, row_number() OVER (ORDER BY count(*) DESC, name) - 1 AS ord FROM w WHERE length(name) >= 4 GROUP BY name QUALIFY ord < 40),
     p0 AS (SELECT doc_id, string_split(text, chr(10)) AS ps FROM documents),
     p AS (SELECT doc_id, unnest(range(0, len(ps))) AS para, unnest(ps) AS text FROM p0),
     m AS (SELECT DISTINCT p.doc_id, p.para, g.name, g.type, g.ord FROM (SELECT doc_id, para, unnest(string_split_regex(trim(lower(text), E' \t\n\x0b\x0c\r'), '\s+')) AS word FROM p WHERE length(text) >= 50) p JOIN g ON word = name)
"""


def gazetteer(spark, d, most: int | None = 40):
    """(name, type, ord) of the most frequent words of documents, or of all words."""
    words = table(spark, d, "documents").select("doc_id", F.explode(F.array_distinct(F.split(F.trim(F.lower("text"), F.lit(" \t\n\x0b\x0c\r")), r"\s+"))).alias("name"))
    counted = words.filter(F.length("name") >= 4).groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    kind = F.concat(F.lit("T"), (F.col("ord") % 3).cast("string")).alias("type")
    if most is None:
        return graph.numbered(counted, F.col("n").desc(), "name").select("name", F.col("place").alias("ord")).select("name", kind, "ord")
    # Written, as every use would read all texts again.
    top = cut(counted.orderBy(F.col("n").desc(), "name").limit(most))
    # The few top rows are numbered by how many stand before each.
    other = top.select(F.col("name").alias("_m"), F.col("n").alias("_n"))
    before = top.join(F.broadcast(other), (F.col("_n") > F.col("n")) | ((F.col("_n") == F.col("n")) & (F.col("_m") < F.col("name"))), "left")
    named = before.groupBy("name").agg(F.count("_m").cast("int").alias("ord"))
    return named.select("name", kind, "ord")


def _mentions(spark, d):
    return graph.mentions(graph.paragraphs(table(spark, d, "documents"), "\n"), gazetteer(spark, d))


@Q.add(GAZETTEER + "SELECT doc_id, para, name, type FROM m")
def paragraph_mentions(spark, d):
    return _mentions(spark, d).select("doc_id", F.col("para").cast("long").alias("para"), "name", "type")


PAIRS = GAZETTEER + """, x AS (SELECT *, row_number() OVER (PARTITION BY doc_id, para ORDER BY ord) AS i FROM m),
     c0 AS (SELECT a.doc_id, least(a.name, b.name) AS e1_name, CASE WHEN a.name < b.name THEN a.type ELSE b.type END AS e1_type, greatest(a.name, b.name) AS e2_name, CASE WHEN a.name < b.name THEN b.type ELSE a.type END AS e2_type
            FROM x a JOIN x b ON a.doc_id = b.doc_id AND a.para = b.para AND b.i > a.i AND b.i < a.i + 10),
     c AS (SELECT e1_name, e1_type, e2_name, e2_type, CAST(count(*) AS BIGINT) AS cnt, CAST(count(DISTINCT doc_id) AS BIGINT) AS n_sources, array_to_string(list_sort(list(DISTINCT CAST(doc_id AS VARCHAR)))[1:3], ', ') AS srcs FROM c0 GROUP BY ALL),
     k AS (SELECT *, 0.3 + 0.6 * (cnt / max(cnt) OVER ()) AS confidence, 'Co-occurred ' || cnt || 'x in: ' || srcs || CASE WHEN n_sources > 3 THEN ' and ' || (n_sources - 3) || ' more docs' ELSE '' END AS evidence FROM c)
"""


def _cooccurrence(spark, d):
    return graph.weighted(graph.cooccurrence(_mentions(spark, d)))


@Q.add(PAIRS + "SELECT e1_name, e1_type, e2_name, e2_type, cnt, n_sources, confidence, evidence FROM k")
def cooccurrence(spark, d):
    return _cooccurrence(spark, d).select("e1_name", "e1_type", "e2_name", "e2_type", "cnt", "n_sources", "confidence", "evidence")


UPGRADE = "SELECT * FROM VALUES (0, 'a_b', 'T0', 'T1'), (1, 'a_b_again', 'T0', 'T1'), (2, 'c_a', 'T2', 'T0'), (3, 'open', 'T1', cast(null AS string)) AS t(ord, name, domain, range)"
UP_SQL = PAIRS + """, u AS (SELECT CASE WHEN (e1_type, e2_type) IN (('T0', 'T1'), ('T2', 'T0')) THEN e1_name WHEN (e2_type, e1_type) IN (('T0', 'T1'), ('T2', 'T0')) THEN e2_name ELSE e1_name END AS subject,
       CASE WHEN (e1_type, e2_type) IN (('T0', 'T1'), ('T1', 'T0')) THEN 'a_b' WHEN (e1_type, e2_type) IN (('T2', 'T0'), ('T0', 'T2')) THEN 'c_a' ELSE 'co_occur' END AS predicate,
       CASE WHEN (e1_type, e2_type) IN (('T0', 'T1'), ('T2', 'T0')) THEN e2_name WHEN (e2_type, e1_type) IN (('T0', 'T1'), ('T2', 'T0')) THEN e1_name ELSE e2_name END AS object, confidence FROM k)
"""


@Q.add(UP_SQL + "SELECT * FROM u")
def cooccurrence_upgrade(spark, d):
    return graph.upgraded(_cooccurrence(spark, d), spark.sql(UPGRADE)).select("subject", "predicate", "object", "confidence")


@Q.add(UP_SQL + "SELECT * FROM u ORDER BY confidence DESC, subject, predicate, object LIMIT 100")
def cooccurrence_topk(spark, d):
    return graph.top_pairs(graph.upgraded(_cooccurrence(spark, d), spark.sql(UPGRADE)).select("subject", "predicate", "object", "confidence"), 100)


@Q.add(UP_SQL + "SELECT n_name AS subject, 'in' AS predicate, 'world' AS object, 1.0::DOUBLE AS confidence FROM nation WHERE n_nationkey < 9 UNION ALL SELECT * FROM u")
def cooccurrence_backfill(spark, d):
    few = table(spark, d, "nation").filter("n_nationkey < 9").select(F.col("n_name").alias("subject"), F.lit("in").alias("predicate"), F.lit("world").alias("object"), F.lit(1.0).alias("confidence"))
    return graph.backfill(few, graph.upgraded(_cooccurrence(spark, d), spark.sql(UPGRADE)).select("subject", "predicate", "object", "confidence"))


GROUPS = """, gt AS (SELECT CAST(floor((row_number() OVER (ORDER BY doc_id) - 1) / 8) AS BIGINT) AS grp, '[Doc ' || (row_number() OVER (ORDER BY doc_id) - 1) || '] ' || substr(coalesce(text, ''), 1, 4000) AS t FROM documents),
     gr AS (SELECT grp, lower(string_agg(t, chr(10) || chr(10))) AS text FROM gt GROUP BY grp)
"""


#: All words of documents as a gazetteer, and groups of whole texts. A name has no white space, so it stands within a word of a text: one of the word's substrings.
PREFILTER = r"""
WITH w AS (SELECT DISTINCT doc_id, unnest(string_split_regex(trim(lower(text), E' \t\n\x0b\x0c\r'), '\s+')) AS name FROM documents),
     g AS (SELECT name, 'T' || ((row_number() OVER (ORDER BY count(*) DESC, name) - 1) % 3) AS type FROM w WHERE length(name) >= 4 GROUP BY name),
     gt AS (SELECT CAST(floor((row_number() OVER (ORDER BY doc_id) - 1) / 8) AS BIGINT) AS grp, '[Doc ' || (row_number() OVER (ORDER BY doc_id) - 1) || '] ' || coalesce(text, '') AS t FROM documents),
     gw AS (SELECT DISTINCT grp, unnest(string_split_regex(lower(t), '\s+')) AS word FROM gt),
     s AS (SELECT word, unnest(range(1, length(word) - 2)) AS i FROM (SELECT DISTINCT word FROM gw WHERE length(word) >= 4)),
     part AS (SELECT word, substr(word, i, n) AS name FROM (SELECT word, i, unnest(range(4, length(word) - i + 2)) AS n FROM s)),
     held AS (SELECT DISTINCT word, name, type FROM part JOIN g USING (name))
SELECT DISTINCT grp, name, type FROM gw JOIN held USING (word)
"""


@Q.add(PREFILTER)
def entity_prefilter(spark, d):
    """Every name that a group's whole texts hold, of a gazetteer of all words."""
    return graph.entity_prefilter(graph.doc_groups(table(spark, d, "documents")), gazetteer(spark, d, None)).select("grp", "name", "type")


@Q.add(GAZETTEER + GROUPS + """, rt AS (SELECT ord, 'rel_' || name || 'x' AS name, CASE WHEN ord % 4 = 0 THEN 'T0' END AS domain FROM g UNION ALL SELECT ord + 40, 'has_' || name, NULL FROM g UNION ALL SELECT ord + 80, 'of_' || name, 'T9' FROM g)
SELECT grp, CAST(ord AS BIGINT) AS ord, name FROM (SELECT grp, ord, rt.name, domain = 'T0' OR len(list_filter(string_split(rt.name, '_'), lambda w: length(w) > 3 AND contains(gr.text, w))) > 0 AS m FROM gr, rt)
QUALIFY row_number() OVER (PARTITION BY grp ORDER BY coalesce(m, false) DESC, ord) <= 80""")
def relation_type_filter(spark, d):
    g = gazetteer(spark, d)
    kind = lambda before, after, k, domain: g.select((F.col("ord") + k).alias("ord"), F.concat(F.lit(before), "name", F.lit(after)).alias("name"), domain.alias("domain"), F.lit(None).cast("string").alias("range"))
    none = F.lit(None).cast("string")
    types = kind("rel_", "x", 0, F.when(F.col("ord") % 4 == 0, "T0")).union(kind("has_", "", 40, none)).union(kind("of_", "", 80, F.lit("T9")))
    out = graph.relation_type_filter(graph.doc_groups(table(spark, d, "documents"), chars=4000), types, spark.sql("SELECT 'T0' AS type"), 80)
    return out.select("grp", F.col("ord").cast("long").alias("ord"), "name")


EVENT_TYPES = "SELECT * FROM VALUES ('click', 'interacts'), ('view', 'interacts'), ('purchase', 'buys') AS t(predicate, canonical)"


@Q.add("SELECT event_id, event_type AS original_predicate, CASE event_type WHEN 'click' THEN 'interacts' WHEN 'view' THEN 'interacts' WHEN 'purchase' THEN 'buys' ELSE event_type END AS predicate FROM events")
def canonicalize_predicates(spark, d):
    r = table(spark, d, "events").select("event_id", F.col("event_type").alias("predicate"))
    return graph.canonicalize(r, spark.sql(EVENT_TYPES)).select("event_id", "original_predicate", "predicate")


@Q.add("SELECT DISTINCT event_type AS predicate FROM events WHERE event_type NOT IN ('click', 'view')")
def unmatched_predicates(spark, d):
    r = table(spark, d, "events").select(F.col("event_type").alias("predicate"))
    return graph.unmatched_predicates(r, spark.sql("SELECT explode(array('click', 'view')) AS name"))


@Q.add("SELECT seq, type FROM (SELECT event_id AS seq, event_type AS type FROM events ORDER BY event_id LIMIT 500) WHERE type NOT IN ('click', 'view') ORDER BY seq LIMIT 100")
def ontology_validate(spark, d):
    e = table(spark, d, "events").select(F.col("event_id").alias("seq"), F.col("event_type").alias("type"))
    return ontology.invalid_entities(e, spark.sql("SELECT explode(array('click', 'view')) AS name")).select("seq", "type")


QC = """
WITH e AS (SELECT d.doc_id AS seq, 'doc ' || d.doc_id AS name, d.lang AS type, 0.8::DOUBLE AS confidence, quality, toxic FROM documents d LEFT JOIN labels l USING (doc_id)),
     k AS (SELECT seq, name, CASE WHEN toxic = 1 THEN 'toxic_' || type ELSE type END AS type, confidence FROM e WHERE quality IS NULL OR quality <> 0)
"""


def _qc(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("seq"), F.concat(F.lit("doc "), F.col("doc_id").cast("string")).alias("name"), F.col("lang").alias("type"), F.lit(0.8).alias("confidence"))
    l = docs.join(table(spark, d, "labels"), F.col("seq") == F.col("doc_id"))  # noqa: E741
    return docs, l.filter("quality = 0").select("name", "type"), l.filter("toxic = 1").select("name", "type", F.concat(F.lit("toxic_"), "type").alias("new_type"))


@Q.add(QC + "SELECT * FROM k")
def qc_apply(spark, d):
    return graph.qc_entities(*_qc(spark, d))


@Q.add(QC + ", f AS (SELECT seq, name, type, confidence, 0 AS p FROM k UNION ALL SELECT seq, name, type, CASE WHEN seq % 2 = 0 THEN 0.9::DOUBLE ELSE 0.8 END, 1 FROM k WHERE seq % 3 = 0) SELECT name, type, confidence FROM f QUALIFY row_number() OVER (PARTITION BY trim(name), type ORDER BY confidence DESC, p, seq) = 1")
def final_aggregate(spark, d):
    docs, rejected, corrections = _qc(spark, d)
    again = docs.filter("seq % 3 = 0").withColumn("confidence", F.when(F.col("seq") % 2 == 0, 0.9).otherwise(0.8))
    return graph.final_aggregate([docs, again], "entities", rejected, corrections).select("name", "type", "confidence")


@Q.add(STAR + ", t AS (SELECT subject, predicate, object FROM r) SELECT * FROM t WHERE NOT (predicate = 'from_nation' AND object = 'NATION_3') AND object NOT LIKE '%1'")
def qc_relations(spark, d):
    _, r = star(spark, d)
    bad = r.filter("object LIKE '%1' OR (predicate = 'from_nation' AND object = 'NATION_3')").select(F.concat(F.lit(" "), "subject").alias("subject"), "predicate", "object")
    return graph.qc_relations(r, bad.withColumn("subject", F.trim("subject"))).select("subject", "predicate", "object")


@Q.add("SELECT p_type, count(*) AS n FROM part GROUP BY p_type ORDER BY n DESC, p_type LIMIT 20")
def type_distribution(spark, d):
    return graph.type_distribution(table(spark, d, "part"), "p_type")


@Q.add(f"WITH raw AS ({RAW}) SELECT seq, name, confidence FROM raw WHERE confidence < 0.8 ORDER BY confidence, seq LIMIT 10")
def low_confidence(spark, d):
    return graph.low_confidence(_raw(spark, d)).select("seq", "name", "confidence")


@Q.add("SELECT count(*) AS n_entities, CAST(count(*) FILTER (event_id % 3 <> 0) AS BIGINT) AS n_with, CAST(sum(CASE event_id % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END) AS BIGINT) AS n_attributes FROM events")
def attribute_stats(spark, d):
    k = F.col("event_id") % 3
    a = F.when(k == 1, F.create_map(F.lit("a"), F.col("event_type"))).when(k == 2, F.create_map(F.lit("a"), F.col("event_type"), F.lit("b"), F.lit("x")))
    return graph.attribute_stats(table(spark, d, "events").select(a.alias("attributes")))
