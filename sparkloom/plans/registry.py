"""What a host may call and plug in: tools by name, skills by name, listeners to events. All of it runs on the driver, on single values."""

from __future__ import annotations

import glob
import importlib.util
import inspect
import itertools
import os
import time
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from sparkloom.functions.code import findings
from sparkloom.plans.backends import parse_answer


@dataclass(frozen=True)
class ToolResult:
    success: bool
    data: Any = None
    error: str = ""


@dataclass(frozen=True)
class Tool:
    name: str
    description: str
    run: Callable[..., Any]

    @property
    def parameters(self) -> list[str]:
        return list(inspect.signature(self.run).parameters)


_tools: dict[str, Tool] = {}


def tool(name: str, description: str):
    def put(f: Callable) -> Callable:
        _tools[name] = Tool(name, description, f)
        return f

    return put


def tools(names: list[str] | None = None) -> list[Tool]:
    return [t for n, t in _tools.items() if names is None or n in names]


def execute(name: str, arguments: dict[str, Any]) -> ToolResult:
    """The tool's result or what went wrong. A single argument under a wrong name is taken for the first parameter."""
    found = _tools.get(name)
    if found is None:
        return ToolResult(False, error=f"unknown tool {name}")
    known = found.parameters
    if len(arguments) == 1 and not set(arguments) & set(known):
        arguments = {known[0]: next(iter(arguments.values()))}
    try:
        return ToolResult(True, found.run(**arguments))
    except Exception as e:  # a tool's failure is an answer, whatever it is
        return ToolResult(False, error=f"{type(e).__name__}: {e}")


@tool("read_file", "The first lines of a text file.")
def read_file(path: str, max_lines: int = 500) -> str:
    with open(path, encoding="utf-8", errors="replace") as f:
        head = list(itertools.islice(f, max_lines))
        more = sum(1 for _ in f)
    return "".join(head) + (f"... ({more} more lines)" if more else "")


@tool("write_file", "Writes a text file.")
def write_file(path: str, content: str) -> dict:
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        return {"path": path, "chars": f.write(content)}


@tool("list_files", "Files below a folder that match a pattern.")
def list_files(path: str = ".", pattern: str = "*") -> list[str]:
    return sorted(x for x in glob.glob(os.path.join(path, pattern), recursive=True) if os.path.isfile(x))


@tool("analyze_file_format", "What the first bytes of a file say of its format.")
def analyze_file_format(path: str) -> dict:
    from pyspark.sql import SparkSession

    from sparkloom.sources import readers

    return readers.sniff(SparkSession.getActiveSession(), path).first().asDict()


@tool("search_in_text", "Places of a string in a text, with what stands around them.")
def search_in_text(text: str, query: str, context: int = 100, most: int = 10) -> list[dict]:
    found, at = [], text.find(query) if query else -1
    while at >= 0 and len(found) < most:
        found.append({"position": at, "context": text[max(0, at - context) : at + len(query) + context]})
        at = text.find(query, at + len(query))
    return found


@tool("parse_json", "JSON in a text, with or without a fence around it.")
def parse_json(text: str) -> Any:
    found = parse_answer(text)
    if found is None:
        raise ValueError("no JSON")
    return found


@tool("validate_against_ontology", "The entities whose type the schema does not have.")
def validate_against_ontology(entities: list[dict], types: list[str]) -> list[dict]:
    return [e for e in entities[:500] if e.get("type") and e["type"] not in types][:100]


@tool("deduplicate_entities", "One entity for each name and type, the most confident.")
def deduplicate_entities(entities: list[dict]) -> list[dict]:
    best: dict[tuple, dict] = {}
    for e in entities:
        key = (str(e.get("name") or "").strip(), e.get("type"))
        if key not in best or (e.get("confidence") or 0.0) > (best[key].get("confidence") or 0.0):
            best[key] = e
    return list(best.values())


@tool("check_code", "What speaks against running a piece of code.")
def check_code(code: str) -> list[str]:
    return findings(code)


@dataclass(frozen=True)
class SkillMeta:
    name: str
    description: str
    version: str = "0.1.0"
    author: str = ""
    tags: tuple[str, ...] = ()
    requires_ontology: bool = True
    produces: tuple[str, ...] = ()


class Skill:
    """A task for a model: its prompt, its tools, and what happens before and after the call."""

    meta: SkillMeta

    def __init__(self, backend=None):
        self.backend = backend

    def system_prompt(self) -> str:
        raise NotImplementedError

    def tool_names(self) -> list[str]:
        return []

    def pre_process(self, context: dict) -> dict:
        return context

    def post_process(self, out: dict, context: dict) -> dict:
        return out

    def input_schema(self) -> dict:
        return {}

    def output_schema(self) -> dict:
        return {}


_skills: dict[str, type[Skill]] = {}


def skill(meta: SkillMeta):
    def put(cls: type[Skill]) -> type[Skill]:
        cls.meta = meta
        _skills[meta.name] = cls
        return cls

    return put


def get_skill(name: str, backend=None) -> Skill | None:
    cls = _skills.get(name)
    return cls(backend) if cls else None


def skills() -> list[SkillMeta]:
    return [c.meta for c in _skills.values()]


def default_skills() -> list[str]:
    """The skills of a whole build, in order."""
    return list(BUILT_IN)


def discover(folder: str) -> list[str]:
    """Loads the Python files of a folder, which register what they hold; gives those that failed."""
    failed = []
    for path in sorted(glob.glob(os.path.join(folder, "*.py"))):
        name = os.path.basename(path)
        if name.startswith("_"):
            continue
        spec = importlib.util.spec_from_file_location(f"sparkloom_own_{name[:-3]}", path)
        try:
            spec.loader.exec_module(importlib.util.module_from_spec(spec))
        except Exception:  # one bad file keeps no other from loading
            failed.append(name)
    return failed


#: The built-in skills: what each is asked, the tools it has, the keys of its answer, the stages of a build it stands for.
BUILT_IN = {
    "ontology_analyzer": ("Read samples and propose a schema.", ("search_in_text", "parse_json"), ("entity_types", "relation_types"), ()),
    "entity_extractor": ("Find the entities of the schema in texts.", ("search_in_text", "parse_json"), ("entities",), ("entities",)),
    "relation_extractor": ("Find relations between known entities in texts.", ("search_in_text", "parse_json"), ("relations",), ("relations", "cooccurrence")),
    "quality_checker": ("Check what was found against texts and schema.", ("validate_against_ontology", "deduplicate_entities"), ("rejected_entities", "corrections", "rejected_relations", "quality_score"), ("quality",)),
    "triple_constructor": ("Make triples of relations and entities.", ("deduplicate_entities",), ("triples",), ("triples",)),
}


def stages(names: list[str]) -> tuple[str, ...]:
    """The stages of a build that these skills stand for."""
    return tuple(s for n in names if n in BUILT_IN for s in BUILT_IN[n][3])


def _built_in(name: str, said: str, own: tuple[str, ...], keys: tuple[str, ...]) -> None:
    body = {"system_prompt": lambda self: said, "tool_names": lambda self: list(own), "output_schema": lambda self: {"type": "object", "properties": {k: {} for k in keys}}}
    skill(SkillMeta(name, said, produces=keys, requires_ontology=name != "ontology_analyzer"))(type(name, (Skill,), body))


for _name, (_said, _own, _keys, _) in BUILT_IN.items():
    _built_in(_name, _said, _own, _keys)


@dataclass
class Events:
    """Listeners to a build: give it to ``pipeline.run`` as ``listen``. What is heard is kept with its time."""

    listeners: list[Callable[[str, dict], None]] = field(default_factory=list)
    log: list[tuple[str, float, dict]] = field(default_factory=list)

    def on(self, listener: Callable[[str, dict], None]) -> None:
        self.listeners.append(listener)

    def __call__(self, event: str, data: dict) -> None:
        self.log.append((event, time.time(), data))
        for f in self.listeners:
            try:
                f(event, data)
            except Exception:  # a listener's failure is its own
                continue
