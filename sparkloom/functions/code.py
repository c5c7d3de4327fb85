"""A guard for code that users supply: a syntax-tree check. It is no sandbox and promises no isolation."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Modules that supplied code must not import or call into.
MODULES = frozenset("os subprocess socket requests urllib shutil ctypes multiprocessing signal pty fcntl posix grp pwd crypt importlib sys builtins".split())
#: Calls that are refused by their last name, whatever they are called on.
CALLS = frozenset("eval exec compile __import__ breakpoint open".split())
#: Names that hold the built-ins, and calls that are refused only with one of these as argument.
BUILTINS = frozenset("__builtins__ __builtin__ globals locals".split())
REFLECTION = frozenset("vars getattr setattr delattr dir".split())
#: Attributes by which objects lead to their classes and frames; allowed on self and cls.
ATTRIBUTES = frozenset("__class__ __bases__ __mro__ __subclasses__ __globals__ __code__ __closure__ __dict__".split())


def _dotted(node: ast.AST) -> list[str]:
    """The names of an attribute chain, outermost object first; an object that is no name leaves none."""
    if isinstance(node, ast.Attribute):
        return [*_dotted(node.value), node.attr]
    return [node.id] if isinstance(node, ast.Name) else []


def _of_import(n: ast.AST) -> Iterator[str]:
    # All names of an import, also those behind a comma.
    names = [a.name for a in n.names] if isinstance(n, ast.Import) else [n.module or ""]
    yield from (f"import {m}" for m in names if m.split(".")[0] in MODULES)


def _of_call(n: ast.Call) -> Iterator[str]:
    path = _dotted(n.func)
    if not path:
        return
    said = ".".join(path)
    if path[-1] in CALLS:
        yield f"call {said}"
    if path[-1] in REFLECTION:
        for a in n.args:
            named = a.value if isinstance(a, ast.Subscript) else a
            if isinstance(named, ast.Name) and named.id in BUILTINS:
                yield f"call {said} on {named.id}"
    if BUILTINS.intersection(path):
        yield f"built-ins {said}"
    if MODULES.intersection(path):
        yield f"module {said}"


def _of_subscript(n: ast.Subscript) -> Iterator[str]:
    path = _dotted(n.value)
    if (BUILTINS | MODULES).intersection(path):
        yield f"item of {'.'.join(path)}"


def _of_attribute(n: ast.Attribute) -> Iterator[str]:
    if n.attr in ATTRIBUTES and _dotted(n)[0] not in ("self", "cls"):
        yield f"attribute {n.attr}"


RULES = {ast.Import: _of_import, ast.ImportFrom: _of_import, ast.Call: _of_call, ast.Subscript: _of_subscript, ast.Attribute: _of_attribute}


def findings(code: str) -> list[str]:
    """What speaks against the code; nothing if it may run."""
    try:
        tree = ast.parse(code)
    except (SyntaxError, ValueError) as e:
        return [f"syntax: {e}"]
    return [x for n in ast.walk(tree) if type(n) in RULES for x in RULES[type(n)](n)]


@F.pandas_udf(T.BooleanType())
def is_safe(code: pd.Series) -> pd.Series:
    return code.map(lambda c: c is not None and not findings(c))
