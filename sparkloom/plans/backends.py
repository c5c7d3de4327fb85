"""What stands for a language model: functions of texts to entities, relations, mappings, judgements.

A backend is made anew in each task by a factory, so it may hold what can't be sent. Gazetteer and
patterns are deterministic. ``ModelBackend`` asks any function of a prompt and reads its answers:
the whole as JSON, a fenced block, from the first brace to the last, from the first bracket to the
last; an answer that is none of these is sent back once to be mended, a call that fails or stays
unreadable is tried again.
"""

from __future__ import annotations

import difflib
import hashlib
import json
import re
import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from sparkloom.operators.ontology import Ontology
from sparkloom.operators.structured import Mapped
from sparkloom.plans import prompts


def parse_answer(text: str | None) -> dict | list | None:
    """The first reading of a model's answer that is a JSON object or list."""
    text = text or ""
    fenced = re.search(r"```(?:json)?\s*(.*?)\s*```", text, re.S)
    spans = [text[text.find(a) : text.rfind(b) + 1] for a, b in ("{}", "[]") if 0 <= text.find(a) < text.rfind(b)]
    for reading in (text, fenced[1] if fenced else "", *spans):
        try:
            found = json.loads(reading)
        except ValueError:
            continue
        if isinstance(found, dict | list):
            return found
    return None


def _rows(found, key: str) -> list[dict]:
    """The objects under a key, or of a bare list; what is no object is left out."""
    some = found.get(key, []) if isinstance(found, dict) else found
    return [x for x in some or [] if isinstance(x, dict)] if isinstance(some, list) else []


class Backend:
    """What a model does; each method has an answer that changes nothing."""

    def entities(self, text: str, guide: str = "") -> list[dict]:
        return []

    def relations(self, text: str, names: list[dict], guide: str = "") -> list[dict]:
        return []

    def combined(self, text: str, guide: str = "") -> tuple[list[dict], list[dict]]:
        """Entities and relations of a text in one call."""
        found = self.entities(text, guide)
        return found, self.relations(text, found, guide)

    def glean(self, text: str, known: list[dict], guide: str = "") -> list[dict]:
        """Entities that a first pass missed."""
        return []

    def mapping(self, columns: list[str], rows: list[dict], guide: str = "") -> list[Mapped]:
        """What the columns of a table hold, from its first rows."""
        return []

    def quality(self, entities: list[dict], relations: list[dict], text: str, guide: str = "") -> dict:
        """rejected_entities, corrections, rejected_relations, quality_score."""
        return {}

    def canonical(self, predicates: list[str], choices: list[tuple[str, str]]) -> dict[str, str]:
        """The choice that each predicate means, by the ratio of their words."""
        words = lambda x: re.sub(r"[\W_]+", " ", x).strip().lower()
        out = {}
        for p in predicates:
            score, name = max(((difflib.SequenceMatcher(None, words(p), words(n)).ratio(), n) for n, _ in choices), default=(0.0, ""))
            if score >= 0.6:
                out[p] = name
        return out

    def schema(self, samples: str, so_far: str = "", way: str = "") -> dict:
        """entity_types and relation_types for texts."""
        return {}

    def name_clusters(self, groups: list[list[str]], samples: str) -> list[dict]:
        """(name, description) of each group, in order."""
        return [{"name": min(g, key=len), "description": ", ".join(g[:5])} for g in groups]

    def merge_clusters(self, pairs: list[dict]) -> list[dict]:
        """(keep, remove) of types that mean the same."""
        return []

    def refine(self, feedback: str, facts: dict, guide: str) -> dict:
        """A plan for a better build."""
        return {}


class GazetteerBackend(Backend):
    """Names that are given, found as whole words; relations between neighbours in a sentence."""

    def __init__(self, names: dict[str, str], predicate: str = "related_to"):
        self.names, self.predicate = names, predicate
        self.pattern = re.compile("|".join(rf"\b{re.escape(n)}\b" for n in sorted(names, key=len, reverse=True)) or r"(?!)")

    def entities(self, text: str, guide: str = "") -> list[dict]:
        found = dict.fromkeys(m[0] for m in self.pattern.finditer(text))
        return [{"name": n, "type": self.names[n], "mention": n} for n in found]

    def relations(self, text: str, names: Iterable = (), guide: str = "") -> list[dict]:
        out = []
        for sentence in re.split(r"(?<=[.!?。！？])\s+", text):
            own = list(dict.fromkeys(m[0] for m in self.pattern.finditer(sentence)))
            out += [{"subject": a, "predicate": self.predicate, "object": b, "evidence": sentence[:200]} for a, b in zip(own, own[1:])]
        return out


class RegexBackend(Backend):
    """Patterns by type; relations by patterns with groups subject and object."""

    def __init__(self, types: dict[str, str], predicates: dict[str, str] | None = None):
        self.types, self.predicates = types, predicates or {}

    def entities(self, text: str, guide: str = "") -> list[dict]:
        return [{"name": n, "type": t, "mention": n} for t, p in self.types.items() for n in dict.fromkeys(m[0] for m in re.finditer(p, text))]

    def relations(self, text: str, names: Iterable = (), guide: str = "") -> list[dict]:
        return [{"subject": m["subject"], "predicate": k, "object": m["object"], "evidence": m[0]} for k, p in self.predicates.items() for m in re.finditer(p, text)]


@dataclass
class ModelBackend(Backend):
    """A model behind a function of a prompt. ``calls`` counts what was asked."""

    ask: Callable[[str], str]
    tries: int = 2
    few_shots: str = ""
    calls: int = field(default=0, init=False)

    def _said(self, prompt: str) -> str | None:
        self.calls += 1
        try:
            return self.ask(prompt)
        except Exception:  # whatever a client raises is a call without an answer
            return None

    def structured(self, prompt: str) -> dict | list | None:
        for _ in range(self.tries):
            answer = self._said(prompt)
            found = parse_answer(answer)
            if found is None and (answer or "").strip():
                found = parse_answer(self._said(prompts.repair(answer)))
            if found is not None:
                return found
        return None

    def entities(self, text: str, guide: str = "") -> list[dict]:
        return _rows(self.structured(prompts.entities(guide, text)), "entities")

    def relations(self, text: str, names: list[dict], guide: str = "") -> list[dict]:
        return _rows(self.structured(prompts.relations(guide, list(names), text, self.few_shots)), "relations")

    def combined(self, text: str, guide: str = "") -> tuple[list[dict], list[dict]]:
        found = self.structured(prompts.combined(guide, text))
        found = found if isinstance(found, dict) else {}
        return [{"confidence": 0.9} | e for e in _rows(found, "entities")], [{"confidence": 0.85} | r for r in _rows(found, "relations")]

    def glean(self, text: str, known: list[dict], guide: str = "") -> list[dict]:
        return [{"confidence": 0.7} | e for e in _rows(self.structured(prompts.glean(guide, known, text)), "entities")]

    def mapping(self, columns: list[str], rows: list[dict], guide: str = "") -> list[Mapped]:
        some = _rows(self.structured(prompts.mapping(guide, columns, rows)), "columns")
        return [Mapped(c["column"], c.get("role") or "attribute", c.get("entity_type") or "Entity", c.get("relation") or "", bool(c.get("is_multi"))) for c in some if c.get("column") in columns]

    def quality(self, entities: list[dict], relations: list[dict], text: str, guide: str = "", most: int = 60_000) -> dict:
        summary = json.dumps({"entities": entities, "relations": relations}, ensure_ascii=False)[:most]
        found = self.structured(prompts.quality(guide, summary, text))
        return found if isinstance(found, dict) else {"corrections": _rows(found, "")} if found else {}

    def canonical(self, predicates: list[str], choices: list[tuple[str, str]]) -> dict[str, str]:
        found = self.structured(prompts.canonical(predicates, choices)) if predicates and choices else None
        said = found.get("mappings", {}) if isinstance(found, dict) else {}
        letter = lambda x: ord(x[0]) - ord("A") if (x := str(x).strip().upper()) and x != "NONE" else -1
        return {p: choices[letter(x)][0] for p, x in said.items() if p in predicates and 0 <= letter(x) < len(choices)}

    def schema(self, samples: str, so_far: str = "", way: str = "") -> dict:
        found = self.structured(prompts.schema(samples, so_far, way))
        return found if isinstance(found, dict) else {}

    def name_clusters(self, groups: list[list[str]], samples: str) -> list[dict]:
        out = super().name_clusters(groups, samples)
        for c in _rows(self.structured(prompts.clusters(groups, samples)), "clusters"):
            if isinstance(c.get("cluster_id"), int) and 0 <= c["cluster_id"] < len(out) and c.get("name"):
                out[c["cluster_id"]] = {"name": c["name"], "description": c.get("description") or ""}
        return out

    def merge_clusters(self, pairs: list[dict]) -> list[dict]:
        return _rows(self.structured(prompts.merges(pairs)), "merges")

    def refine(self, feedback: str, facts: dict, guide: str) -> dict:
        found = self.structured(prompts.refinement(feedback, facts, guide))
        return found if isinstance(found, dict) else {}


class Ledger:
    """A model's answers by prompt under a folder that all executors share: what has been asked once, by whichever task, is read and not asked again.

    A task that is lost and comes again pays only for prompts that had no answer yet. An answer is one file, named by a hash
    of ``version`` and the prompt, so another model or setting has answers of its own; a file that was not written to its end counts as none. The path
    has a scheme unless it is local.
    """

    def __init__(self, ask: Callable[[str], str], path: str, version: str = ""):
        self.ask, self.path, self.version = ask, path.rstrip("/"), version

    def __call__(self, prompt: str) -> str:
        import pyarrow.fs

        key = hashlib.sha256(f"{self.version}\n{prompt}".encode()).hexdigest()
        fs, root = pyarrow.fs.FileSystem.from_uri(self.path) if "://" in self.path else (pyarrow.fs.LocalFileSystem(), self.path)
        folder, name = f"{root}/{key[:2]}", f"{key}.json"
        if fs.get_file_info(f"{folder}/{name}").type == pyarrow.fs.FileType.File:
            with fs.open_input_stream(f"{folder}/{name}") as f:
                try:
                    return json.loads(f.read())["answer"]
                except (ValueError, KeyError):
                    pass
        answer = self.ask(prompt)
        fs.create_dir(folder, recursive=True)
        draft = f"{folder}/.{uuid.uuid4().hex}"
        with fs.open_output_stream(draft) as f:
            f.write(json.dumps({"answer": answer}, ensure_ascii=False).encode())
        fs.move(draft, f"{folder}/{name}")
        return answer


def guide_of(ontology: Ontology | None, names: Iterable[str] | None = None, most: int | None = None) -> str:
    """The schema as text, with only the relation types that are named where they are."""
    if ontology is None:
        return ""
    if names is not None:
        from dataclasses import replace

        by = {r.name: r for r in ontology.relation_types}
        ontology = replace(ontology, relation_types=tuple(by[n] for n in names if n in by))
    return ontology.guide()[:most]
