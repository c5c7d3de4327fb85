"""Prompts: what goes to a model, as columns for many texts and as strings for one."""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.operators.ontology import Ontology

JSON_ONLY = "Answer with one JSON object and nothing else."
ENTITY_SHAPE = '{"entities": [{"name": "...", "type": "...", "mention": "...", "description": "...", "confidence": 0.9}]}'
RELATION_SHAPE = '{"relations": [{"subject": "...", "predicate": "...", "object": "...", "confidence": 0.9, "evidence": "..."}]}'


def extraction_prompts(docs: DataFrame, types: list[str], chars: int) -> DataFrame:
    """(doc_id, prompt) with the types and the head of the text."""
    head = F.lit("Types: " + ", ".join(types) + "\nText:\n")
    return docs.select("doc_id", F.concat(head, F.substring(F.coalesce("text", F.lit("")), 1, chars)).alias("prompt"))


def _sections(task: str, **parts: str) -> str:
    """The task, then each part under its name; empty parts are left out."""
    named = [f"## {k.replace('_', ' ').capitalize()}\n{v}" for k, v in parts.items() if v]
    return "\n\n".join([task, *named, JSON_ONLY])


def examples(ontology: Ontology | None) -> str:
    """One made-up answer for each of the first relation types with both ends, as a model is shown what is meant."""
    typed = [r for r in (ontology.relation_types if ontology else ()) if r.domain and r.range][:3]
    return "\n".join(json.dumps({"subject": f"<{r.domain}>", "predicate": r.name, "object": f"<{r.range}>"}) for r in typed)


def entities(guide: str, text: str) -> str:
    return _sections("Find every entity of the schema that the text names.", schema=guide, answer=ENTITY_SHAPE, text=text)


def relations(guide: str, known: list[dict], text: str, few: str = "") -> str:
    return _sections("Find every relation of the schema between these entities that the text states.", schema=guide, entities=json.dumps(known, ensure_ascii=False), examples=few, answer=RELATION_SHAPE, text=text)


def glean(guide: str, known: list[dict], text: str) -> str:
    return _sections("These entities were found already. Name those that were missed, cut short or misspelt.", schema=guide, found=json.dumps(known, ensure_ascii=False), answer=ENTITY_SHAPE, text=text)


def combined(guide: str, text: str) -> str:
    shape = ENTITY_SHAPE[:-1] + ", " + RELATION_SHAPE[1:]
    return _sections("Find every entity of the schema in the text and every relation between them.", schema=guide, answer=shape, text=text)


def mapping(guide: str, columns: list[str], rows: list[dict]) -> str:
    shape = '{"columns": [{"column": "...", "role": "id|reference|attribute", "entity_type": "...", "relation": "...", "is_multi": false}]}'
    return _sections("Say what each column of this table holds.", schema=guide, columns=", ".join(columns), rows=json.dumps(rows, ensure_ascii=False, default=str), answer=shape)


def quality(guide: str, summary: str, text: str) -> str:
    shape = '{"rejected_entities": [{"name": "...", "type": "..."}], "corrections": [{"name": "...", "type": "...", "new_type": "..."}], "rejected_relations": [{"subject": "...", "predicate": "...", "object": "..."}], "quality_score": 0.9}'
    return _sections("Check these entities and relations against the texts and the schema.", schema=guide, found=summary, texts=text, answer=shape)


def canonical(predicates: list[str], choices: list[tuple[str, str]]) -> str:
    listed = "\n".join(f"{chr(65 + i)}. {name}: {said}" for i, (name, said) in enumerate(choices))
    return _sections("For each predicate name the letter of the schema's relation that means the same, or NONE.", relations=listed, predicates="\n".join(predicates), answer='{"mappings": {"predicate": "A"}}')


def schema(samples: str, so_far: str = "", way: str = "") -> str:
    shape = '{"entity_types": [{"name": "...", "description": "...", "parent": null}], "relation_types": [{"name": "...", "description": "...", "domain": "...", "range": "..."}]}'
    return _sections("Propose a schema for a graph of what these texts tell.", way=way, so_far=so_far, answer=shape, texts=samples)


def clusters(groups: Iterable[list[str]], samples: str) -> str:
    listed = "\n".join(f"{i}. {', '.join(g[:20])}" for i, g in enumerate(groups))
    return _sections("Give each group of words a type that covers it.", groups=listed, answer='{"clusters": [{"cluster_id": 0, "name": "...", "description": "..."}]}', texts=samples)


def merges(pairs: list[dict]) -> str:
    return _sections("Which of these pairs of types mean the same?", pairs=json.dumps(pairs, ensure_ascii=False), answer='{"merges": [{"keep": "...", "remove": "..."}]}')


def refinement(feedback: str, facts: dict, guide: str) -> str:
    shape = '{"rationale": "...", "ontology_changes": [{"action": "add|remove|modify", "target": "entity_type|relation_type", "name": "..."}], "updated_ontology_raw": "", "suggested_strategy": "", "extraction_tips": "", "prompt_additions": [], "prompt_removals": [], "enable_gleaning": null, "enable_co_occurrence": null, "suggested_chunk_size": 0}'
    return _sections("Plan how to build this graph better, by what its reader says.", feedback=feedback, schema=guide, last_build=json.dumps(facts, ensure_ascii=False, default=str), answer=shape)


def repair(answer: str) -> str:
    return _sections("This was to be JSON and is not. Write it as valid JSON without adding anything.", answer=answer)
