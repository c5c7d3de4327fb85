"""Schemas from documents: by texts, by relations, by a hierarchy of relations, densely, or by clusters of nouns.

A backend proposes types from samples of bounded size; what follows is the same for all ways:
names are normalised, the first of equal ones stays, parents are checked or inferred from the
endings of names, and a schema without relations links each type with the next few.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions.text import noun_matches
from sparkloom.operators import cluster, ops
from sparkloom.operators.ontology import EntityType, Ontology, RelationType, default_relations, normalized_types, parents
from sparkloom.plans.backends import Backend

SAMPLES, SAMPLE_CHARS, NOUNS, CLUSTERS, MERGE_ROUNDS, NEAR, PAIRS = 5, 3000, 2000, 30, 3, 5, 10
#: Texts and characters of each from which the choice of a way counts nouns.
COUNTED_TEXTS, COUNTED_CHARS = 3, 5000
#: What each way asks for, call by call: each sees what the one before it proposed.
WAYS = {
    "text-to-ontology": ("Types of things that the texts name, then relations between them.",),
    "relation-to-ontology": ("Relations that the texts state, with the types of their ends.", "Types of the ends of these relations, joined where they mean the same."),
    "ht-relation-to-ontology": ("General types and relations first.", "Subtypes below these types, with their parents.", "Relations between the subtypes."),
    "dense-ontology": ("Every type, however rare.", "Every relation between these types, however rare."),
}


def samples(docs: DataFrame) -> str:
    """The heads of the first documents."""
    rows = docs.filter(F.length("text") > 0).orderBy("doc_id").limit(SAMPLES).select(F.substring("text", 1, SAMPLE_CHARS).alias("t")).collect()
    return "\n\n".join(r["t"] for r in rows)


def choose(docs: DataFrame) -> str:
    """The way that fits the number and length of documents and the density of nouns in the first of them."""
    for c, kind in (("is_tabular", "boolean"), ("ext", "string")):
        if c not in docs.columns:
            docs = docs.withColumn(c, F.lit(None).cast(kind))
    first = docs.filter(F.length("text") > 0).orderBy("doc_id").limit(COUNTED_TEXTS)
    nouns = first.select(F.explode(noun_matches(F.substring("text", 1, COUNTED_CHARS))).alias("noun")).agg(F.count_distinct("noun").alias("n"))
    return ops.ontology_mode(ops.corpus_stats(docs), nouns).first()["mode"]


def _schema(spark: SparkSession, name: str, said: dict) -> Ontology | None:
    """A proposal as a schema: names normalised, first of equal ones, parents checked."""
    some = lambda key: [x for x in said.get(key) or [] if isinstance(x, dict) and str(x.get("name") or "").strip()]
    types = some("entity_types")
    if not types:
        return None
    rows = [(i, str(x["name"]), str(x.get("description") or ""), x.get("parent")) for i, x in enumerate(types)]
    frame = normalized_types(spark.createDataFrame(rows, "ord int, name string, description string, parent string"))
    known = {r["ord"]: r["parent"] for r in parents(frame).collect()}
    kept = sorted(frame.collect(), key=lambda r: r["ord"])
    entity_types = tuple(EntityType(r["name"], r["description"], known.get(r["ord"]) if known.get(r["ord"]) != r["name"] else None) for r in kept)
    relations = tuple(RelationType(str(x["name"]).strip(), str(x.get("description") or ""), x.get("domain"), x.get("range"), x.get("inverse")) for x in some("relation_types"))
    return Ontology(name, "", entity_types, relations or linked(spark, entity_types))


def linked(spark: SparkSession, types: Iterable[EntityType]) -> tuple[RelationType, ...]:
    """related_to between each type and the next few."""
    frame = spark.createDataFrame([(i, t.name) for i, t in enumerate(types)], "ord int, name string")
    return tuple(RelationType(r["name"], r["description"], r["domain"], r["range"]) for r in default_relations(frame).orderBy("domain", "range").collect())


def candidates(named: list[dict]) -> list[dict]:
    """Pairs of neighbouring types, each with the next four, that may mean the same."""
    pairs = [(x, y) for i, x in enumerate(named) for y in named[i + 1 : i + NEAR]]
    return [{"a": x["name"], "b": y["name"], "members_a": x["members"][:10], "members_b": y["members"][:10]} for x, y in pairs[:PAIRS]]


def merged(named: list[dict], backend: Backend) -> list[dict]:
    """Types joined where the backend says that they mean the same, in a few rounds."""
    for _ in range(MERGE_ROUNDS):
        if len(named) <= 2:
            break
        by = {x["name"]: x for x in named}
        gone = set()
        for m in backend.merge_clusters(candidates(named)):
            keep, remove = m.get("keep"), m.get("remove")
            if keep in by and remove in by and keep != remove and not gone & {keep, remove}:
                by[keep]["members"] = by[keep]["members"] + by[remove]["members"]
                gone.add(remove)
        if not gone:
            break
        named = [x for x in named if x["name"] not in gone]
    return named


def by_clusters(docs: DataFrame, backend: Backend) -> dict:
    """A proposal from clusters of the most frequent nouns; an empty one where there are too few."""
    nouns = docs.select(F.explode(noun_matches(F.coalesce("text", F.lit("")))).alias("noun")).groupBy("noun").count()
    nouns = nouns.orderBy(F.col("count").desc(), "noun").limit(NOUNS)
    n = nouns.count()
    if n < 10:
        return {}
    groups = [r["members"] for r in cluster.noun_clusters(nouns, "noun", max(2, n // 100)).orderBy("cluster").limit(CLUSTERS).collect()]
    if len(groups) < 2:
        return {}
    named = [x | {"members": list(g)} for x, g in zip(backend.name_clusters(groups, samples(docs)), groups) if x.get("name")]
    return {"entity_types": merged(named, backend)}


def induce(docs: DataFrame, backend: Backend, mode: str = "auto") -> Ontology | None:
    """A schema of docs (doc_id, text); None where there are no texts or nothing is proposed. An unknown way is text-to-ontology, as is clustering where nouns are too few."""
    spark, shown = docs.sparkSession, samples(docs)
    if not shown:
        return None
    if mode == "auto":
        mode = choose(docs)
    said: dict = {}
    if mode == "affinity-clustering":
        said = by_clusters(docs, backend)
    if not said:
        mode = mode if mode in WAYS else "text-to-ontology"
        for way in WAYS[mode]:
            more = backend.schema(shown, _listed(said), way)
            said = {k: [*(said.get(k) or []), *(more.get(k) or [])] if k == "entity_types" else (more.get(k) or said.get(k) or []) for k in ("entity_types", "relation_types")}
    return _schema(spark, mode, said)


def _listed(said: dict) -> str:
    return "\n".join(str(x.get("name")) for k in ("entity_types", "relation_types") for x in said.get(k) or [] if isinstance(x, dict))
