"""Queries that run the whole pipeline, by each of its strategies."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from sparkloom.lineage import cut
from sparkloom.operators.ontology import EntityType, Ontology, RelationType
from sparkloom.operators.structured import Mapped
from sparkloom.plans import pipeline
from sparkloom.plans.base import Queries, table

Q = Queries()
#: A small gazetteer of the most common English words of documents, as two types.
NAMES = {"that": "A", "this": "B", "with": "A", "from": "B", "they": "A"}
ONTOLOGY = Ontology("words", "two kinds of words", (EntityType("A"), EntityType("B")), (RelationType("meets", domain="A", range="B"),))
WHOLE = 1 << 30


def _triples(out: pipeline.Result):
    return out.triples.select("subj_name", "subj_type", "predicate", "obj_name", "obj_type", F.col("confidence"))


#: Sentences end where white space follows a full stop or its like; each name counts where its first word of a sentence stands.
SENTENCES = r"""
     s AS (SELECT unnest(string_split(regexp_replace(text, '([.!?。！？])[\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+', '\1' || chr(1), 'g'), chr(1))) AS sentence FROM t WHERE text IS NOT NULL),
     w AS (SELECT row_number() OVER () AS id, regexp_extract_all(sentence, '[\p{L}\p{N}_]+') AS words FROM s),
     p AS (SELECT id, name, type, list_position(words, name) AS place FROM w, n WHERE list_contains(words, name)),
     x AS (SELECT name AS subj_name, type AS subj_type, lead(name) OVER (PARTITION BY id ORDER BY place) AS obj_name, lead(type) OVER (PARTITION BY id ORDER BY place) AS obj_type FROM p)
SELECT DISTINCT subj_name, subj_type, 'near' AS predicate, obj_name, obj_type, 1.0::DOUBLE AS confidence FROM x WHERE obj_name IS NOT NULL
"""
#: The forty words of four letters or more that most documents hold, as three types; documents in groups of eight.
PIPELINE_SQL = r"""
WITH v AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z]{4,}')) AS name FROM documents),
     n AS (SELECT name, 'T' || ((row_number() OVER (ORDER BY count(*) DESC, name) - 1) % 3) AS type FROM v GROUP BY name ORDER BY count(*) DESC, name LIMIT 40),
     d AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS place, coalesce(text, '') AS text FROM documents),
     t AS (SELECT string_agg('[Doc ' || place || '] ' || text, chr(10) || chr(10) ORDER BY place) AS text FROM d GROUP BY place // 8),
""" + SENTENCES


@Q.add(PIPELINE_SQL)
def kg_pipeline(spark, d):
    """The standard strategy over whole documents and a gazetteer from them: entities, groups with candidates, relations, canonical predicates, co-occurrences, triples."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    words = docs.select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit("[a-z]{4,}"), 0))).alias("name"))
    top = words.groupBy("name").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "name").limit(40).collect()
    names = {r["name"]: f"T{i % 3}" for i, r in enumerate(top)}
    schema = Ontology("words", "three kinds of words", tuple(EntityType(f"T{i}") for i in range(3)), (RelationType("meets", domain="T0", range="T1"),))
    config = pipeline.Config(paragraph_separator="\n", chars_per_doc=WHOLE, max_chunks=WHOLE)
    return _triples(pipeline.run(spark, docs, schema, lambda: pipeline.GazetteerBackend(names, "near"), config))


class LongWords(pipeline.Backend):
    """Says that words of twelve letters or more are entities, unless it is told that they are known."""

    def glean(self, text, known, guide=""):
        told = {x["name"] for x in known}
        words = dict.fromkeys(re.findall("[a-z]{12,}", text.lower()))
        return [{"name": w, "type": "Word", "confidence": 0.7, "description": w[:3]} for w in words if not any(w == k or k in w for k in told)]


@Q.add(r"""
WITH w AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[a-z]{12,}'))) AS name FROM documents),
     k AS (SELECT name FROM (SELECT name, count(*) AS n FROM w GROUP BY name) WHERE n >= 3),
     g AS (SELECT DISTINCT name FROM w WHERE NOT EXISTS (SELECT 1 FROM k WHERE contains(w.name, k.name)))
SELECT name, 'Word' AS type, 0.7::DOUBLE AS confidence, substr(name, 1, 3) AS description FROM g UNION ALL SELECT name, 'Known', 0.5::DOUBLE, '' FROM k
""")
def gleaning_chunks(spark, d):
    """A second look at every chunk of all documents, told which known entities stand in it, merged with these. Known are long words of three documents or more."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    words = docs.select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit("[a-z]{12,}"), 0))).alias("name"))
    known = words.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first")).filter("n >= 3")
    entities = known.select("name", F.lit("Known").alias("type"), F.lit(None).cast("string").alias("mention"), F.lit("").alias("description"), F.lit(0.5).alias("confidence"), F.lit(None).cast("map<string,string>").alias("attributes"), F.xxhash64("name").cast(pipeline.NUMBER).alias("seq"))
    # A document is one chunk here, so that no long word is cut in two.
    config = pipeline.Config(text_strategy="truncate", truncate_chars=WHOLE, glean_known=WHOLE)
    return pipeline.gleaned(cut(entities), docs, LongWords, "", config).select("name", "type", "confidence", "description")


FAST_SQL = r"""
WITH t AS (SELECT text FROM documents), n AS (SELECT * FROM (VALUES ('that', 'A'), ('this', 'B'), ('with', 'A'), ('from', 'B'), ('they', 'A')) AS t(name, type)),
""" + SENTENCES


@Q.add(FAST_SQL)
def kg_fast(spark, d):
    """The fast strategy: entities and relations of each whole document in one call, triples by name."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    return _triples(pipeline.run(spark, docs, ONTOLOGY, lambda: pipeline.GazetteerBackend(NAMES, "near"), pipeline.Config(strategy="fast", fast_chars=WHOLE)))


class TableBackend(pipeline.Backend):
    """Says what the columns of the query's tables hold."""

    COLUMNS = {"c_name": Mapped("c_name", "id", "Customer"), "s_name": Mapped("s_name", "id", "Supplier"), "n_name": Mapped("n_name", "reference", "Nation", "located_in")}

    def mapping(self, columns, rows, guide=""):
        return [self.COLUMNS[c] for c in columns if c in self.COLUMNS]


@Q.add("""
SELECT c_name AS subj_name, 'Customer' AS subj_type, 'located_in' AS predicate, n_name AS obj_name, 'Nation' AS obj_type, 0.9::DOUBLE AS confidence FROM customer JOIN nation ON c_nationkey = n_nationkey
UNION SELECT s_name, 'Supplier', 'located_in', n_name, 'Nation', 0.9 FROM supplier JOIN nation ON s_nationkey = n_nationkey
""")
def kg_structured(spark, d):
    """The code strategy: tables under the mapping that a backend gives for their columns; they say enough, so texts are not asked."""
    nations = table(spark, d, "nation").select(F.col("n_nationkey").alias("key"), "n_name")
    tables = {"customer": table(spark, d, "customer").join(nations, F.col("c_nationkey") == F.col("key")).select("c_name", "n_name"), "supplier": table(spark, d, "supplier").join(nations, F.col("s_nationkey") == F.col("key")).select("s_name", "n_name")}
    schema = Ontology("places", "", (EntityType("Customer"), EntityType("Supplier"), EntityType("Nation")), (RelationType("located_in", range="Nation"),))
    docs = table(spark, d, "documents").select("doc_id", "text")
    return _triples(pipeline.run(spark, docs, schema, TableBackend, pipeline.Config(strategy="code", cooccurrence=False), tables=tables))
