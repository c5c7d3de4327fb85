"""Queries of text functions, readers and the text side of operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.functions import text as X
from sparkloom.functions.code import is_safe
from sparkloom.operators import cluster, graph, ontology, ops
from sparkloom.plans import prompts
from sparkloom.plans.base import Queries, table
from sparkloom.sources.readers import jsonl_text, row_text

Q = Queries()
NORM = r"""lower(regexp_replace(coalesce({0}, ''), '[\s\p{{Z}}，,。．.、；;：:！!？?"''「」『』【】（）()\[\]{{}}《》<>]', '', 'g'))"""


@Q.add(f"SELECT p_partkey, {NORM.format("concat(p_name, '， (', p_brand, ') 「', p_type, '」!')")} AS norm FROM part")
def normalize_name(spark, d):
    p = table(spark, d, "part")
    return p.select("p_partkey", X.normalize_name(F.concat("p_name", F.lit("， ("), "p_brand", F.lit(") 「"), "p_type", F.lit("」!"))).alias("norm"))


TYPE_SQL = """
WITH s AS (SELECT DISTINCT p_type AS given FROM part UNION SELECT DISTINCT '  12. ' || lower(p_name) || ' ** ' FROM part
           UNION SELECT DISTINCT '- ' || p_name || '   of  things' FROM part UNION SELECT '  3. '),
     b AS (SELECT given, trim(regexp_replace(regexp_replace(regexp_replace(trim(given), '^[\\d\\s.\\-*#]+', ''), '[\\d\\s.\\-*#]+$', ''), '\\s+', ' ', 'g')) AS b FROM s),
     t AS (SELECT given, CASE WHEN b = lower(b) AND len(string_split(b, ' ')) <= 3 THEN array_to_string(list_transform(string_split(b, ' '), lambda w: upper(w[1:1]) || w[2:]), ' ') ELSE b END AS n FROM b)
SELECT given, CASE WHEN n = '' THEN 'Unknown' ELSE n END AS name FROM t
"""


@Q.add(TYPE_SQL)
def type_name_normalize(spark, d):
    p = table(spark, d, "part")
    given = p.select(F.col("p_type").alias("given")).union(p.select(F.concat(F.lit("  12. "), F.lower("p_name"), F.lit(" ** ")))).union(p.select(F.concat(F.lit("- "), "p_name", F.lit("   of  things")))).union(p.limit(1).select(F.lit("  3. "))).distinct()
    return given.select("given", X.normalize_type_name(F.col("given")).alias("name"))


JSONL_SQL = """
WITH v AS (SELECT conv_id, turn, CASE turn % 3 WHEN 2 THEN 'no json: ' || role ELSE text END AS value FROM conversations)
SELECT conv_id, string_agg(value, chr(10) ORDER BY turn) AS text, count(*) AS lines FROM v WHERE value <> '' GROUP BY conv_id
"""


@Q.add(JSONL_SQL)
def load_jsonl(spark, d):
    c = table(spark, d, "conversations")
    line = F.when(F.col("turn") % 3 == 0, F.to_json(F.struct(F.col("text").alias("data"), F.lit("x").alias("text")))).when(F.col("turn") % 3 == 1, F.to_json(F.struct("role", "text"))).otherwise(F.concat(F.lit("no json: "), "role"))
    return jsonl_text(c.select("conv_id", F.col("turn").alias("at"), line.alias("line")), "conv_id")


@Q.add("SELECT n_nationkey, concat_ws(' | ', 'n_nationkey: ' || n_nationkey, CASE WHEN n_nationkey % 3 <> 0 THEN 'n_name: ' || n_name END, 'n_regionkey: ' || n_regionkey) AS line FROM nation")
def tabular_to_text(spark, d):
    n = table(spark, d, "nation").withColumn("n_name", F.when(F.col("n_nationkey") % 3 != 0, F.col("n_name")).otherwise(""))
    return n.select("n_nationkey", row_text("n_nationkey", "n_name", "n_regionkey").alias("line"))


@Q.add()
def html_text(spark, d):
    return table(spark, d, "pages").select("page_id", X.html_text("html").alias("text"))


CHUNK_SQL = """
WITH t AS (SELECT doc_id, replace(text, chr(10), ' ') AS text FROM documents),
     s AS (SELECT doc_id, text, unnest(CASE WHEN length(text) <= 1000 THEN [0] ELSE range(0, length(text), 900) END) AS start FROM t)
SELECT doc_id, CAST(start / 900 AS BIGINT) AS chunk_idx, CAST(start AS BIGINT) AS start, substr(text, CAST(start AS INTEGER) + 1, 1000) AS text FROM s
"""


@Q.add(CHUNK_SQL)
def chunk_window(spark, d):
    t = table(spark, d, "documents").select("doc_id", F.replace("text", F.lit("\n"), F.lit(" ")).alias("text"))
    c = t.select("doc_id", F.explode(X.window_chunks(F.col("text"), 1000, 900)).alias("c"))
    return c.select("doc_id", F.col("c.chunk_idx").cast("long").alias("chunk_idx"), F.col("c.start").cast("long").alias("start"), "c.text")


@Q.add()
def chunk_paragraph(spark, d):
    """Whole texts, those of one line included."""
    t = table(spark, d, "documents").select("doc_id", F.regexp_replace("text", r"\.\n", ".\n\n").alias("text"))
    return t.select("doc_id", F.posexplode(X.paragraph_chunks()("text")).alias("chunk_idx", "text"))


GROUP_SQL = """
WITH p AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS place, substr(coalesce(text, ''), 1, 4000) AS text FROM documents)
SELECT CAST(floor(place / 8) AS BIGINT) AS grp, string_agg('[Doc ' || place || '] ' || text, chr(10) || chr(10) ORDER BY place) AS text FROM p GROUP BY 1
"""


@Q.add(GROUP_SQL)
def doc_groups(spark, d):
    return graph.doc_groups(table(spark, d, "documents"), chars=4000).select(F.col("grp").cast("long").alias("grp"), "text")


@Q.add("SELECT doc_id, least(10, (length(text) - length(replace(text, 'tion', ''))) // 4) AS n, position('tion' IN text) - 1 AS first_position, substr(text, greatest(1, CAST(position('tion' IN text) AS INTEGER) - 20), CAST(position('tion' IN text) AS INTEGER) + 3 + 20 - greatest(1, CAST(position('tion' IN text) AS INTEGER) - 20) + 1) AS first_context FROM documents WHERE contains(text, 'tion')")
def search_in_text(spark, d):
    found = table(spark, d, "documents").select("doc_id", X.occurrences(F.col("text"), "tion", 20, 10).alias("o")).filter(F.size("o") > 0)
    return found.select("doc_id", F.size("o").cast("long").alias("n"), F.col("o")[0]["position"].cast("long").alias("first_position"), F.col("o")[0]["context"].alias("first_context"))


@Q.add("SELECT doc_id, array_to_string(regexp_extract_all(text, '(?ms)^[A-Z][a-z]{4,}')[1:50], '|') AS segments FROM documents")
def extract_segments(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(X.segments(F.col("text"), "^[A-Z][a-z]{4,}"), "|").alias("segments"))


@Q.add("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def parse_json(spark, d):
    e = table(spark, d, "events").select("event_id", F.concat(F.lit("```json\n"), "props", F.lit("\n```")).alias("raw"))
    return e.select("event_id", F.get_json_object(X.unfenced(F.col("raw")), "$.k").cast("long").alias("k"))


@Q.add("SELECT event_id, CASE WHEN event_id % 5 = 4 THEN NULL ELSE CAST(json_extract(props, '$.k') AS BIGINT) END AS k FROM events")
def parse_llm_json(spark, d):
    e = table(spark, d, "events")
    k = F.col("event_id") % 5
    raw = F.when(k == 0, F.col("props")).when(k == 1, F.concat(F.lit("```json\n"), "props", F.lit("\n```"))).when(k == 2, F.concat(F.lit("Here it is: "), "props", F.lit(" done."))).when(k == 3, F.concat(F.lit("\n"), "props")).otherwise(F.substring("props", 1, 4))
    return e.select("event_id", F.get_json_object(X.json_ladder(raw), "$.k").cast("long").alias("k"))


#: RE2 has no look-around, so each word gets a mark before and one behind it first; a text's own marks are neither word nor space.
NOUN_SQL = r"""
WITH t AS (SELECT doc_id, regexp_replace(regexp_replace(text, '[\x01\x02]', '|', 'g'), '([\p{L}\p{N}_]+)', chr(1) || '\1' || chr(2), 'g') AS text FROM documents),
     m AS (SELECT doc_id, unnest(list_concat(regexp_extract_all(text, '\x01([A-Z][a-z]+(?:\x02[\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+\x01[A-Z][a-z]+)*)\x02', 1), regexp_extract_all(text, '\x01([a-z]{3,})\x02', 1))) AS w FROM t)
SELECT lower(regexp_replace(w, '[\x01\x02]', '', 'g')) AS noun, count(DISTINCT doc_id) AS n_docs FROM m GROUP BY 1
"""


@Q.add(NOUN_SQL)
def noun_candidates(spark, d):
    """Of all documents, whatever their language and letters."""
    words = table(spark, d, "documents").select("doc_id", F.explode(F.array_distinct(F.transform(X.noun_matches(F.col("text")), F.lower))).alias("noun"))
    return words.groupBy("noun").agg(F.count(F.lit(1)).alias("n_docs"))


TRI_SQL = """
WITH n AS (SELECT DISTINCT concat_ws(' ', p_brand, p_type) AS name FROM part),
     t AS (SELECT name, list_distinct(list_transform(range(1, len('  ' || lower(name) || '  ') - 1), lambda i: substr('  ' || lower(name) || '  ', CAST(i AS INTEGER), 3))) AS g FROM n),
     e AS (SELECT name, len(g) AS n, unnest(g) AS gram FROM t)
SELECT a.name AS a, b.name AS b, count(*) / (a.n + b.n - count(*)) AS similarity FROM e a JOIN e b ON a.gram = b.gram AND a.name < b.name GROUP BY a.name, b.name, a.n, b.n
"""


@Q.add(TRI_SQL)
def trigram_similarity(spark, d):
    """All pairs of distinct names that share a trigram, over the whole table; that of any other pair is 0."""
    names = table(spark, d, "part").select(F.concat_ws(" ", "p_brand", "p_type").alias("name")).distinct()
    return X.similar_by_trigrams(names, "name")


@Q.add()
def noun_clusters(spark, d):
    names = table(spark, d, "part").select(F.col("p_name").alias("noun")).distinct()
    return cluster.noun_clusters(names)


STATS = """
WITH t AS (SELECT text, CASE WHEN source IN ('src1', 'src2') THEN 'csv' ELSE 'txt' END AS ext, source IN ('src1', 'src2') AS is_tabular, length(trim(text, E' \\t\\n\\x0b\\x0c\\r')) > 0 AS ok FROM documents),
     s AS (SELECT count(*) AS n_docs, count(*) FILTER (ok) AS n_text, CAST(coalesce(sum(length(text)) FILTER (ok), 0) AS BIGINT) AS total_chars, coalesce(sum(length(text)) FILTER (ok) / count(*) FILTER (ok), 0.0) AS avg_chars,
                  count(*) FILTER (ok AND is_tabular) AS n_tabular, array_to_string(list_sort(list(DISTINCT ext)), ', ') AS formats FROM t)
"""


def _stats(spark, d):
    t = table(spark, d, "documents").withColumn("is_tabular", F.col("source").isin("src1", "src2"))
    return ops.corpus_stats(t.withColumn("ext", F.when(F.col("is_tabular"), "csv").otherwise("txt")))


@Q.add(STATS + "SELECT * FROM s")
def corpus_stats(spark, d):
    return _stats(spark, d)


@Q.add(STATS + "SELECT *, CASE WHEN n_text = 0 THEN 'standard' WHEN n_tabular > 0.5 * n_docs THEN 'code' WHEN n_docs <= 5 AND avg_chars < 2000 THEN 'fast' WHEN avg_chars < 500 AND n_docs <= 20 THEN 'fast' ELSE 'standard' END AS strategy FROM s")
def strategy_auto(spark, d):
    return ops.strategy(_stats(spark, d))


@Q.add(STATS + ", nn AS (SELECT count(*) AS nouns FROM (" + NOUN_SQL + ")) SELECT s.*, CASE WHEN n_text = 0 OR (n_text = 1 AND avg_chars < 5000) THEN 'text-to-ontology' WHEN nouns / greatest(1, total_chars / 100) > 5 AND n_text >= 3 THEN 'affinity-clustering' WHEN avg_chars > 10000 AND n_text <= 3 THEN 'ht-relation-to-ontology' WHEN avg_chars > 3000 THEN 'relation-to-ontology' ELSE 'text-to-ontology' END AS mode FROM s, nn")
def ontology_mode_auto(spark, d):
    """By number and length of documents and the nouns that they hold."""
    return ops.ontology_mode(_stats(spark, d), noun_candidates(spark, d).agg(F.count(F.lit(1)).alias("n")))


@Q.add("SELECT doc_id, CAST(floor(length(coalesce(text, '')) / 4) AS BIGINT) AS tokens FROM documents")
def token_estimate(spark, d):
    return table(spark, d, "documents").select("doc_id", X.token_estimate(F.col("text")).alias("tokens"))


@Q.add("SELECT doc_id, md5(coalesce(text, '')) AS content_hash, octet_length(encode(coalesce(text, ''))) AS size FROM documents")
def doc_hash(spark, d):
    return ops.doc_hash(table(spark, d, "documents"))


@Q.add("SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'programmatic' WHEN n_chars < 500 THEN 'llm' WHEN doc_id % 4 IN (1, 2) THEN 'llm' ELSE 'programmatic' END AS route FROM documents")
def classify_documents(spark, d):
    t = table(spark, d, "documents").select("doc_id", (F.col("doc_id") % 4 == 0).alias("is_tabular"), F.col("n_chars").alias("size"), F.when(F.col("doc_id") % 4 == 1, ".txt").when(F.col("doc_id") % 4 == 2, ".html").otherwise(".bin").alias("ext"))
    return ops.classify(t).select("doc_id", "route")


@Q.add("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def unload_documents(spark, d):
    return ops.unload(table(spark, d, "documents").select("doc_id", "source"), table(spark, d, "labels").filter("toxic = 1"))


@Q.add(r"SELECT doc_id, regexp_matches(substr(text, 1, 2000), '(?:^|\n)\s*-\s+\S+') OR (len(string_split(text, chr(10))) - 1 > 20 AND length(string_split(text, chr(10))[1]) < 100) AS is_list FROM documents")
def type_list_detect(spark, d):
    return table(spark, d, "documents").select("doc_id", ontology.is_type_list(F.col("text")).alias("is_list"))


#: Snippets of code and whether they may run.
SNIPPETS = {"import json\nprint(json.dumps({}))": True, "import os": False, "from subprocess import run": False, "eval('1')": False, "().__class__.__bases__": False, "x = [i * 2 for i in range(3)]": True, "__builtins__['open']": False, "def f(:": False, "getattr(o, 'name')": True, "io.open('x')": False, "import json, posix": False}
SNIPPET_ROWS = ", ".join("({}, '{}', {})".format(i, code.replace("'", "''"), fine) for i, (code, fine) in enumerate(SNIPPETS.items()))


@Q.add(f"SELECT event_id, code, safe FROM events JOIN (VALUES {SNIPPET_ROWS}) AS s(i, code, safe) ON event_id % {len(SNIPPETS)} = i")
def code_safety(spark, d):
    """Snippets of code, some of which reach for what they must not."""
    rows = table(spark, d, "events").select("event_id", F.get(F.array(*map(F.lit, SNIPPETS)), (F.col("event_id") % len(SNIPPETS)).cast("int")).alias("code"))
    return rows.select("event_id", "code", is_safe("code").alias("safe"))


@Q.add("SELECT doc_id, 'Types: Nation, Region' || chr(10) || 'Text:' || chr(10) || substr(coalesce(text, ''), 1, 2000) AS prompt FROM documents")
def build_prompts(spark, d):
    return prompts.extraction_prompts(table(spark, d, "documents"), ["Nation", "Region"], 2000)
