"""From a reader's feedback to a better build: facts of the last one, a plan, and the plan applied."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, fields, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.operators import graph, ops
from sparkloom.operators.ontology import Change, Ontology
from sparkloom.plans.backends import Backend, guide_of
from sparkloom.plans.pipeline import Config, Result

STRATEGIES = ("auto", "fast", "standard", "code")


@dataclass(frozen=True)
class Plan:
    """What to change; what is empty or None stays as it is."""

    rationale: str = ""
    changes: tuple[Change, ...] = ()
    ontology_raw: str = ""
    strategy: str = ""
    tips: str = ""
    additions: tuple[str, ...] = ()
    removals: tuple[str, ...] = ()
    gleaning: bool | None = None
    cooccurrence: bool | None = None
    chunk_size: int = 0


def facts(result: Result, docs: DataFrame, strategy: str = "standard", quality: float | None = None) -> dict:
    """What the last build looks like: counts, the 20 most frequent types and predicates, the 10 least sure entities and relations, the documents. Aggregates on Spark; a bounded number of rows reaches the driver."""
    pairs = lambda df, c: [[r[c], r["n"]] for r in graph.type_distribution(df, c).collect()]
    unsure = lambda df, *c: [r.asDict() for r in graph.low_confidence(df).select(*c, "confidence").collect()]
    for c, kind in (("is_tabular", "boolean"), ("ext", "string")):
        if c not in docs.columns:
            docs = docs.withColumn(c, F.lit(None).cast(kind))
    of_docs = ops.corpus_stats(docs).first()
    return {
        "strategy": strategy, "quality": quality, "entities": result.entities.count(), "relations": result.relations.count(), "triples": result.triples.count(),
        "entity_types": pairs(result.entities, "type"), "predicates": pairs(result.relations, "predicate"),
        "unsure_entities": unsure(result.entities, "name", "type"), "unsure_relations": unsure(result.relations, "subject", "predicate", "object"),
        "doc_count": of_docs["n_docs"], "total_chars": of_docs["total_chars"], "formats": of_docs["formats"],
    }


def _changes(said: Iterable) -> tuple[Change, ...]:
    known = {f.name for f in fields(Change)}
    sound = (x for x in said or () if isinstance(x, dict) and x.get("action") and x.get("target") and x.get("name"))
    return tuple(Change(**{k: v for k, v in x.items() if k in known and v is not None}) for x in sound)


def analyze(backend: Backend, result: Result, ontology: Ontology, docs: DataFrame, feedback: str, strategy: str = "standard", quality: float | None = None) -> Plan:
    """The plan that the backend makes of the feedback and the facts; an empty one where there is no feedback or no answer."""
    if not feedback.strip():
        return Plan()
    said = backend.refine(feedback, facts(result, docs, strategy, quality), guide_of(ontology))
    return Plan(
        said.get("rationale") or "", _changes(said.get("ontology_changes")), said.get("updated_ontology_raw") or "", said.get("suggested_strategy") or "", said.get("extraction_tips") or "",
        tuple(said.get("prompt_additions") or ()), tuple(said.get("prompt_removals") or ()), said.get("enable_gleaning"), said.get("enable_co_occurrence"), int(said.get("suggested_chunk_size") or 0),
    )


def apply(plan: Plan, ontology: Ontology, config: Config) -> tuple[Ontology, Config, dict[str, bool]]:
    """The schema and the configuration under the plan, and what of it took effect. Changes go before a schema given as text; unknown strategies are left out."""
    done = {
        "ontology_updated": bool(plan.changes or plan.ontology_raw), "strategy_changed": plan.strategy in STRATEGIES and plan.strategy != config.strategy,
        "gleaning_toggled": plan.gleaning is not None, "co_occurrence_toggled": plan.cooccurrence is not None, "chunk_size_changed": plan.chunk_size > 0, "tips_added": bool(plan.tips or plan.additions or plan.removals),
    }
    if plan.changes:
        ontology = ontology.apply(plan.changes)
    elif plan.ontology_raw:
        ontology = replace(ontology, raw=plan.ontology_raw)
    new = {"strategy": plan.strategy if done["strategy_changed"] else None, "gleaning": plan.gleaning, "cooccurrence": plan.cooccurrence, "chunk_size": plan.chunk_size or None}
    return ontology, replace(config, **{k: v for k, v in new.items() if v is not None}), done
