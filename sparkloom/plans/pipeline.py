"""From documents and tables to a graph: stages over DataFrames, with a backend for what a model says.

Strategies are ``standard`` (entities from chunks, relations from groups of documents with the
entities and relation types that fit them), ``fast`` (both in one call for each document),
``code`` (tables under a column mapping; texts only where too little is known) and ``auto``, by
number, length and kind of documents. What a backend says is written before it is used, so a
retry never asks twice. Gleaning looks at every chunk again, with the entities that stand in it. Calls that concern the whole build (mappings, canonical
predicates, quality) see bounded samples, whose sizes are fields of ``Config``.
"""

from __future__ import annotations

import dataclasses
import json
import os
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from decimal import Decimal

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.functions import text as X
from sparkloom.lineage import cut
from sparkloom.operators import dedup, graph, occur, ops, structured
from sparkloom.operators.ontology import Ontology
from sparkloom.plans.backends import Backend, GazetteerBackend, ModelBackend, RegexBackend, guide_of, parse_answer  # noqa: F401

ENTITY = "name string, type string, mention string, description string, confidence double, attributes map<string,string>"
RELATION = "subject string, predicate string, object string, confidence double, evidence string"
NUMBER = "decimal(38,0)"
#: Rows of what a backend says that leave a task at once.
SAID = 5000
#: Where the numbers of rows begin that come after those of texts: gleaned ones, tables, co-occurrences.
GLEANED, OF_TABLES, NEAR = (k * 10**37 for k in (1, 2, 3))


@dataclass(frozen=True)
class Config:
    strategy: str = "standard"
    stages: tuple[str, ...] = ("entities", "relations", "cooccurrence", "quality", "triples")
    chunk_size: int = 4000
    chunk_overlap: int = 300
    max_chunks: int = 200
    #: What a backend sees of a document: chunks, or its head.
    text_strategy: str = "chunks"
    truncate_chars: int = 8000
    gleaning: bool = True
    #: One look at the head of the corpus instead of one at each chunk.
    glean_head: bool = False
    glean_chars: int = 12_000
    glean_known: int = 300
    guide_chars: int = 2000
    docs_per_group: int = 8
    chars_per_doc: int = 4000
    candidates: int = 100
    relation_types: int = 80
    fuzzy_threshold: float = 0.85
    cooccurrence: bool = True
    cooccurrence_least: int = 10
    paragraph_separator: str = r"\n\s*\n"
    canonical_most: int = 20
    canonical_choices: int = 12
    qc_entities: int = 500
    qc_relations: int = 500
    qc_doc_chars: int = 500
    qc_text_chars: int = 30_000
    fast_chars: int = 8000
    #: Entities that make text extraction needless where tables are the main matter.
    enough: int = 10
    mapping_rows: int = 5
    #: Calls of a model in flight at most, each in a task of its own; 0 is no bound.
    calls: int = 0

    @classmethod
    def load(cls, path: str | None = None, env: dict[str, str] | None = None, prefix: str = "SPARKLOOM_") -> Config:
        """The defaults, under what a JSON or YAML file says, under variables of the environment such as SPARKLOOM_CHUNK_SIZE."""
        given: dict = {}
        if path:
            with open(path, encoding="utf-8") as f:
                if path.endswith((".yml", ".yaml")):
                    import yaml

                    given = yaml.safe_load(f) or {}
                else:
                    given = json.load(f)
        env = os.environ if env is None else env
        out = {}
        for x in dataclasses.fields(cls):
            value = env.get(prefix + x.name.upper(), given.get(x.name))
            if value is None:
                continue
            kind = type(x.default)
            if kind is bool and isinstance(value, str):
                value = value.strip().lower() in ("1", "true", "yes", "on")
            elif kind is tuple:
                value = tuple(value.split(",") if isinstance(value, str) else value)
            out[x.name] = kind(value)
        return cls(**out)


@dataclass
class Result:
    entities: DataFrame
    relations: DataFrame
    triples: DataFrame
    metadata: dict = field(default_factory=dict)

    def all_entities(self, *more: DataFrame) -> DataFrame:
        """The entities with those that other phases (a chat, an earlier build) have found: one for each name and type, the most confident; of equal ones this build's."""
        total = self.entities.withColumn("seq", F.struct(F.lit(0).alias("phase"), F.col("seq").cast(NUMBER).alias("at")))
        for i, e in enumerate(more, 1):
            total = total.unionByName(e.withColumn("seq", F.struct(F.lit(i).alias("phase"), F.col("seq").cast(NUMBER).alias("at"))), allowMissingColumns=True)
        return dedup.entities_final(total).withColumn("seq", F.col("seq.at"))

    def all_triples(self, *more: DataFrame) -> DataFrame:
        """The triples with those of other phases, the first of equal ones."""
        total = self.triples.withColumn("seq", F.struct(F.lit(0).alias("phase"), F.col("seq").cast(NUMBER).alias("at")))
        for i, t in enumerate(more, 1):
            total = total.unionByName(t.withColumn("seq", F.struct(F.lit(i).alias("phase"), F.col("seq").cast(NUMBER).alias("at"))), allowMissingColumns=True)
        return dedup.triples_first(total).withColumn("seq", F.col("seq.at"))


def _ordered(docs: DataFrame) -> DataFrame:
    """docs with ``at``, a number that orders them: their own ids where these are numbers, else places by id."""
    if isinstance(docs.schema["doc_id"].dataType, T.IntegralType):
        return docs.withColumn("at", F.col("doc_id").cast("long"))
    return graph.numbered(docs, "doc_id").withColumnRenamed("place", "at")


def chunks(docs: DataFrame, c: Config) -> DataFrame:
    """(doc_id, at, chunk_idx, text): what a backend sees of documents."""
    whole, docs = F.coalesce("text", F.lit("")), _ordered(docs)
    if c.text_strategy == "truncate":
        return docs.select("doc_id", "at", F.lit(0).alias("chunk_idx"), F.substring(whole, 1, c.truncate_chars).alias("text"))
    if c.text_strategy != "chunks":
        raise ValueError(f"text strategy {c.text_strategy!r}")
    return docs.select("doc_id", "at", F.posexplode(X.paragraph_chunks(c.chunk_size, c.chunk_overlap, c.max_chunks)(whole)).alias("chunk_idx", "text"))


def _seq(*places: str):
    """One number that orders as these columns do, the first of which may be any long."""
    n = F.col(places[0]).cast(NUMBER)
    for p, width in zip(places[1:], (9, 9)):
        n = (n * F.lit(10**width).cast("decimal(10,0)")).cast(NUMBER) + F.col(p).cast("decimal(10,0)")
    return n.cast(NUMBER)


def _number(start: int, c) -> object:
    return (F.lit(Decimal(start)).cast(NUMBER) + c.cast("decimal(20,0)")).cast(NUMBER)


def _text(x) -> str:
    return x.strip() if isinstance(x, str) else "" if x is None else str(x).strip()


def _sure(x, default: float = 1.0) -> float:
    try:
        return float(default if x is None else x)
    except (TypeError, ValueError):
        return default


def _entity(e: dict) -> tuple | None:
    """An entity as a backend gives it, in columns; None without a name."""
    extra = e.get("attributes")
    row = (_text(e.get("name")), _text(e.get("type") or e.get("entity_type")), e.get("mention"), e.get("description") or "", _sure(e.get("confidence")), {str(k): str(v) for k, v in extra.items()} if isinstance(extra, dict) else None)
    return row if row[0] else None


def _relation(r: dict) -> tuple | None:
    row = (_text(r.get("subject")), _text(r.get("predicate") or r.get("relation")), _text(r.get("object")), _sure(r.get("confidence")), r.get("evidence"))
    return row if all(row[:3]) else None


ENTITY_COLUMNS, RELATION_COLUMNS = ([c.split()[0] for c in s.split(", ")] for s in (ENTITY, RELATION))


def _spoken(parts: DataFrame, make: Callable[[], Backend], say: Callable[[Backend, dict], Iterable[tuple | None]], kind: str, names: list[str], calls: int = 0) -> DataFrame:
    """(at, chunk_idx, pos, columns): what the backend says of each row of parts, which are given as dictionaries; in ``calls`` tasks at most where that is given."""
    if calls:
        parts = parts.repartition(calls)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        backend = make()
        for b in batches:
            out = []
            for values in b.itertuples(index=False, name=None):
                row = dict(zip(b.columns, values))
                for p, said in enumerate(say(backend, row)):
                    if said is not None:
                        out.append((row["at"], row["chunk_idx"], p, *said))
                    # A long text says any number of things, each with its evidence: they leave before a batch of texts is through.
                    if len(out) >= SAID:
                        yield pd.DataFrame(out, columns=["at", "chunk_idx", "pos", *names])
                        out = []
            yield pd.DataFrame(out, columns=["at", "chunk_idx", "pos", *names])

    return parts.mapInPandas(run, f"at bigint, chunk_idx int, pos int, {kind}")


def _placed(found: DataFrame) -> DataFrame:
    return found.withColumn("seq", _seq("at", "chunk_idx", "pos")).drop("at", "chunk_idx", "pos")


def _compact(calls: DataFrame) -> DataFrame:
    """With ``names`` as one string a row: a batch of texts has many thousands of them, which as objects take many times their size in Python."""
    return calls.withColumn("names", F.to_json("names", {"ignoreNullFields": "false"}))


def _known(row: dict) -> list[dict]:
    """The names of a row of ``_compact``."""
    names = json.loads(row["names"]) if isinstance(row["names"], str) else []
    return [{"name": x["name"], "type": x["type"]} for x in names]


def extract_entities(parts: DataFrame, make: Callable[[], Backend], guide: str = "", calls: int = 0) -> DataFrame:
    """(seq, entity columns) of all chunks."""
    return _placed(_spoken(parts, make, lambda backend, row: map(_entity, backend.entities(row["text"], guide)), ENTITY, ENTITY_COLUMNS, calls))


def relation_calls(groups: DataFrame, entities: DataFrame, ontology: Ontology, config: Config) -> DataFrame:
    """(at, chunk_idx, text, names, types): for each group of documents (grp, text) the first entities that stand in it and, for large schemas, the relation types that fit it."""
    spark = groups.sparkSession
    order = lambda c: F.transform(F.array_sort(F.collect_list(c)), lambda x: F.struct(x["name"].alias("name"), x["type"].alias("type")))
    names = graph.entity_prefilter(groups, entities.select("name", "type", F.col("seq").alias("ord")), config.candidates)
    out = groups.join(names.groupBy("grp").agg(order(F.struct("ord", "name", "type")).alias("names")), "grp", "left")
    if len(ontology.relation_types) > config.relation_types:
        some = graph.relation_type_filter(groups, ontology.relation_frame(spark), entities.select("type"), config.relation_types)
        own = some.groupBy("grp").agg(F.transform(F.array_sort(F.collect_list(F.struct((~F.col("matched")).alias("no"), "ord", "name"))), lambda x: x["name"]).alias("types"))
        out = out.join(own, "grp", "left")
    else:
        out = out.withColumn("types", F.lit(None).cast("array<string>"))
    return out.select(F.col("grp").cast("long").alias("at"), F.lit(0).alias("chunk_idx"), "text", "names", "types")


def extract_relations(calls: DataFrame, make: Callable[[], Backend], ontology: Ontology, most: int = 0) -> DataFrame:
    """(seq, relation columns) of all groups."""

    def say(backend: Backend, row: dict):
        return map(_relation, backend.relations(row["text"], _known(row), guide_of(ontology, row["types"])))

    return _placed(_spoken(_compact(calls), make, say, RELATION, RELATION_COLUMNS, most))


def _head(docs: DataFrame, each: int, total: int) -> str:
    """The heads of the first documents, up to a number of characters."""
    shown, n = [], 0
    for r in docs.select("doc_id", F.substring(F.coalesce("text", F.lit("")), 1, each).alias("text")).filter("text <> ''").orderBy("doc_id").limit(max(1, min(1000, total))).toLocalIterator():
        shown.append(f"[Doc {r['doc_id']}] {r['text']}")
        n += len(shown[-1])
        if n >= total:
            break
    return "\n\n".join(shown)[:total]


def glean_calls(parts: DataFrame, entities: DataFrame, most: int) -> DataFrame:
    """parts (at, chunk_idx, text) with ``names``, the first entities that stand in each, as a model is told what is known already."""
    known = entities.filter(F.length("name") >= 2).select("name", "type", F.col("seq").alias("ord"), F.lower("name").alias("low_name"))
    keys = parts.select("at", "chunk_idx", F.lower("text").alias("low"))
    held = occur.holding(keys, "low", known, "low_name", keep=["at", "chunk_idx", "name", "type", "ord"])
    # A rank below the exchange keeps a chunk's first names in each task.
    first = held.withColumn("r", F.row_number().over(Window.partitionBy("at", "chunk_idx").orderBy("ord", "name", "type"))).filter(F.col("r") <= most)
    names = first.groupBy("at", "chunk_idx").agg(F.array_sort(F.collect_list(F.struct("r", "name", "type"))).alias("names"))
    return parts.join(names, ["at", "chunk_idx"], "left")


def extract_gleaned(calls: DataFrame, make: Callable[[], Backend], guide: str = "", most: int = 0) -> DataFrame:
    """(seq, entity columns) of what a second look at every chunk finds beside what is known there."""

    def say(backend: Backend, row: dict):
        return map(_entity, backend.glean(row["text"], _known(row), guide))

    found = _placed(_spoken(_compact(calls), make, say, ENTITY, ENTITY_COLUMNS, most))
    return found.withColumn("seq", (F.lit(Decimal(GLEANED)).cast(NUMBER) + F.col("seq")).cast(NUMBER))


def gleaned(entities: DataFrame, docs: DataFrame, make: Callable[[], Backend], guide: str, config: Config) -> DataFrame:
    """entities, with what a second look at every chunk adds; with ``glean_head`` only the head of the first documents is looked at, in one call."""
    parts = chunks(docs, config)
    if config.glean_head:
        head = _head(docs, config.glean_chars, config.glean_chars)
        parts = entities.sparkSession.createDataFrame([(0, 0, head)], "at long, chunk_idx int, text string")
        first = entities.orderBy("seq").limit(config.glean_known).select("name", "type", "seq")
        names = first.agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "name", "type"))), lambda x: F.struct(x["name"].alias("name"), x["type"].alias("type"))).alias("names"))
        calls = parts.join(F.broadcast(names)).filter(F.size("names") > 0)  # one row each
    else:
        calls = glean_calls(parts, entities, config.glean_known)
    more = dedup.best_of(cut(extract_gleaned(calls, make, guide[: config.guide_chars], config.calls)), name=F.col("name"), type=F.col("type"))
    both = dedup.gleaning_merge(entities, more)
    rest = dedup.first_of(entities.unionByName(more), name=F.col("name"), type=F.col("type")).select("name", "type", "mention", "attributes")
    return both.join(rest, ["name", "type"]).select(*entities.columns)


def mapped(rows: DataFrame, backend: Backend, guide: str, config: Config, name: str = "") -> tuple[DataFrame, DataFrame]:
    """Entities and relations of a table, by the mapping that the backend gives for its first rows."""
    columns = [c for c in rows.columns if c not in ("seq", "_source")]
    mapping = backend.mapping(columns, [r.asDict() for r in rows.select(*columns).limit(config.mapping_rows).collect()], guide)
    if "_source" not in rows.columns:
        rows = rows.withColumn("_source", F.lit(name))
    if "seq" not in rows.columns:
        rows = rows.withColumn("seq", F.monotonically_increasing_id())
    spark = rows.sparkSession
    if not any(m.role == "id" for m in mapping):
        return spark.createDataFrame([], f"{ENTITY}, seq {NUMBER}"), spark.createDataFrame([], f"{RELATION}, seq {NUMBER}")
    place = (F.lit(Decimal(OF_TABLES)).cast(NUMBER) + F.col("seq")).cast(NUMBER)
    entities = structured.structured_entities(rows, mapping).withColumn("seq", place)
    entities = entities.select("name", "type", F.col("name").alias("mention"), F.lit("").alias("description"), "confidence", F.lit(None).cast("map<string,string>").alias("attributes"), "seq")
    if not any(m.role == "reference" and m.relation for m in mapping):
        return entities, spark.createDataFrame([], f"{RELATION}, seq {NUMBER}")
    relations = structured.structured_relations(rows, mapping).withColumn("seq", place)
    return entities, relations.select(*RELATION_COLUMNS, "seq")


def judged(backend: Backend, entities: DataFrame, relations: DataFrame, docs: DataFrame, guide: str, config: Config) -> tuple[dict[str, DataFrame], float | None]:
    """rejected_entities, corrections and rejected_relations as tables, and a score, of a backend that sees the first entities and relations."""
    spark = entities.sparkSession
    some = lambda df, n, *c: [r.asDict() for r in df.orderBy("seq").limit(n).select(*c).collect()]
    found = backend.quality(some(entities, config.qc_entities, "name", "type", "confidence"), some(relations, config.qc_relations, "subject", "predicate", "object", "confidence"), _head(docs, config.qc_doc_chars, config.qc_text_chars), guide) or {}
    tables = {}
    for key, names in (("rejected_entities", ("name", "type")), ("corrections", ("name", "type", "new_type")), ("rejected_relations", ("subject", "predicate", "object"))):
        rows = {tuple(_text(x.get(n)) for n in names): None for x in found.get(key) or [] if isinstance(x, dict) and all(x.get(n) for n in names)}
        # Of several corrections of one entity the first holds.
        first = {r[:2]: r for r in reversed(list(rows))} if key == "corrections" else {r: r for r in rows}
        tables[key] = spark.createDataFrame(list(first.values()), ", ".join(f"{n} string" for n in names))
    score = found.get("quality_score")
    return tables, _sure(score) if score is not None else None


def _strategy(docs: DataFrame, config: Config) -> str:
    if config.strategy != "auto":
        return config.strategy
    for c, kind in (("is_tabular", "boolean"), ("ext", "string")):
        if c not in docs.columns:
            docs = docs.withColumn(c, F.lit(None).cast(kind))
    return ops.strategy(ops.corpus_stats(docs)).first()["strategy"]


def run_fast(docs: DataFrame, make: Callable[[], Backend], guide: str, config: Config, write: Callable[[str, DataFrame], DataFrame]) -> Result:
    """Entities and relations of each document in one call; triples by name alone."""
    heads = chunks(docs, dataclasses.replace(config, text_strategy="truncate", truncate_chars=config.fast_chars))

    def say(backend: Backend, row: dict):
        entities, relations = backend.combined(row["text"], guide)
        for e in filter(None, map(_entity, entities)):
            yield (*e, *[None] * len(RELATION_COLUMNS))
        for r in filter(None, map(_relation, relations)):
            yield (*[None] * len(ENTITY_COLUMNS), *r)

    own = lambda c: c.replace("confidence", "sure")
    said = write("combined", _placed(_spoken(heads, make, say, f"{ENTITY}, {own(RELATION)}", [*ENTITY_COLUMNS, *map(own, RELATION_COLUMNS)], config.calls)))
    entities = dedup.entities_exact(said.filter("name is not null").select(*ENTITY_COLUMNS, "seq"))
    relations = said.filter("subject is not null").withColumn("confidence", F.col("sure")).select(*RELATION_COLUMNS, "seq")
    relations = dedup.best_of(relations, **{c: F.col(c) for c in ("subject", "predicate", "object")})
    return Result(entities, relations, graph.fast_triples(relations, entities), {"strategy": "fast"})


def run(
    spark: SparkSession, docs: DataFrame, ontology: Ontology, make: Callable[[], Backend], config: Config = Config(), tables: dict[str, DataFrame] | None = None, known: DataFrame | None = None,
    canonical: DataFrame | None = None, rejected: DataFrame | None = None, corrections: DataFrame | None = None, rejected_relations: DataFrame | None = None,
    write: Callable[[str, DataFrame], DataFrame] = lambda _, df: cut(df), listen: Callable[[str, dict], None] = lambda event, data: None,
) -> Result:
    """The graph of docs (doc_id, text; is_tabular and ext where known) and tables. Judgements that are given as tables take the place of the backend's own. ``listen`` hears of the start and the end of each stage."""
    kind, guide, here = _strategy(docs, config), guide_of(ontology), make()
    listen("workflow_start", {"strategy": kind, "stages": config.stages})
    if kind not in ("standard", "fast", "code"):
        raise ValueError(f"strategy {kind!r}")
    if kind == "fast":
        out = run_fast(docs, make, guide[: config.guide_chars], config, write)
        listen("workflow_complete", out.metadata)
        return out

    def stage(name: str, make_it: Callable[[], DataFrame]) -> DataFrame:
        listen("phase_start", {"phase": name})
        out = write(name, make_it())
        listen("phase_complete", {"phase": name})
        return out

    none_e, none_r = spark.createDataFrame([], f"{ENTITY}, seq {NUMBER}"), spark.createDataFrame([], f"{RELATION}, seq {NUMBER}")
    of_tables = [mapped(rows, here, guide, config, name) for name, rows in (tables or {}).items()]
    table_entities, table_relations = none_e, none_r
    for e, r in of_tables:
        table_entities, table_relations = table_entities.unionByName(e), table_relations.unionByName(r)
    if known is not None:
        table_entities = table_entities.unionByName(known, allowMissingColumns=True)
    # Where tables are the main matter and say enough, texts are not asked.
    skip = kind == "code" and table_entities.limit(config.enough + 1).count() > config.enough
    found = none_e if skip or "entities" not in config.stages else extract_entities(chunks(docs, config), make, guide, config.calls)
    entities = stage("entities", lambda: dedup.entities_exact(found.unionByName(table_entities)))
    if config.gleaning and not skip and "entities" in config.stages:
        entities = stage("gleaning", lambda: gleaned(entities, docs, make, guide, config))
    spoken = none_r
    if "relations" in config.stages and not skip:
        groups = write("groups", graph.doc_groups(docs, config.docs_per_group, config.chars_per_doc))
        spoken = extract_relations(relation_calls(groups, entities, ontology, config), make, ontology, config.calls)
    relations = stage("relations", lambda: dedup.relations_first(spoken.unionByName(table_relations)))
    types = ontology.relation_frame(spark)
    if canonical is None and ontology.relation_types:
        open_ = [r["predicate"] for r in graph.unmatched_predicates(relations, types).orderBy("predicate").limit(config.canonical_most).collect()]
        said = here.canonical(open_, [(r.name, r.description) for r in ontology.relation_types[: config.canonical_choices]]) if open_ else {}
        canonical = spark.createDataFrame(list(said.items()), "predicate string, canonical string")
    if canonical is not None:
        relations = graph.canonicalize(relations, canonical).drop("original_predicate")
    if config.cooccurrence and "cooccurrence" in config.stages:
        named = entities.filter(F.length("name") >= 2).select("name", "type", F.col("seq").alias("ord"))
        pairs = graph.weighted(graph.cooccurrence(graph.mentions(graph.paragraphs(docs, config.paragraph_separator), named)))
        near = graph.top_pairs(graph.upgraded(pairs, types).select("subject", "predicate", "object", "confidence", "evidence"))
        near = near.withColumn("seq", _number(NEAR, F.monotonically_increasing_id()))
        relations = stage("all_relations", lambda: graph.backfill(relations, near, config.cooccurrence_least))
    triples = stage("triples", lambda: graph.triples(relations, entities, types, threshold=config.fuzzy_threshold))
    score = None
    if "quality" in config.stages:
        if rejected is None and corrections is None and rejected_relations is None:
            own, score = judged(here, entities, relations, docs, guide, config)
            rejected, corrections, rejected_relations = own["rejected_entities"], own["corrections"], own["rejected_relations"]
        rejected = rejected if rejected is not None else spark.createDataFrame([], "name string, type string")
        corrections = corrections if corrections is not None else spark.createDataFrame([], "name string, type string, new_type string")
        rejected_relations = rejected_relations if rejected_relations is not None else spark.createDataFrame([], "subject string, predicate string, object string")
        entities, relations = graph.qc_entities(entities, rejected, corrections), graph.qc_relations(relations, rejected_relations)
        triples = graph.qc_triples(triples, rejected, rejected_relations, corrections)
    out = Result(dedup.entities_final(entities), dedup.relations_best(relations), triples, {"strategy": kind, "stages": config.stages, "quality_score": score, "texts_skipped": skip})
    listen("workflow_complete", out.metadata)
    return out


def model_answers(parts: DataFrame, ask: Callable[[], Callable[[str], str]], prompt: Callable[[str], str]) -> DataFrame:
    """(at, chunk_idx, answer): a model's own words for each chunk, to be read in Spark."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        say = ask()
        for b in batches:
            yield pd.DataFrame({"at": b["at"], "chunk_idx": b["chunk_idx"], "answer": [say(prompt(t)) for t in b["text"]]})

    return parts.mapInPandas(run, "at bigint, chunk_idx int, answer string")


def answers_to_entities(answers: DataFrame) -> DataFrame:
    return _placed(answers.select("at", "chunk_idx", F.posexplode(X.llm_entities(F.col("answer"))).alias("pos", "e")).select("at", "chunk_idx", "pos", "e.*"))


def answers_to_relations(answers: DataFrame) -> DataFrame:
    return _placed(answers.select("at", "chunk_idx", F.posexplode(X.llm_relations(F.col("answer"))).alias("pos", "r")).select("at", "chunk_idx", "pos", "r.*"))
