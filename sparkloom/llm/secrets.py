"""Secret scans with inferred grammars.

From labelled credentials, one prefix tree for each kind is built and statistically
compatible states are merged (ALERGIA: Hoeffding's test on the frequencies of ends and
symbols, applied to the states below as well, blue states in order against red ones, the
latest first), which leaves a probabilistic automaton for each kind and some of ordinary
strings. One kind is generic: random characters of no published format, for credentials that nobody has labelled. Every candidate token of every text is then scored: the mean log-likelihood of its
characters under the automaton that explains it best, and how much better that is than under
those of ordinary strings. Bounds for both come from labelled credentials that were
held out; neither length nor the characters a token holds rule it out beforehand. A candidate
is a run of 16 or more characters of tokens; where the whole run is none, its parts are scored
(see ``Grammars.parts``). The base patterns are searched beside this and always reported.

The automata have a few dozen states, as the labelled set is a bounded parameter, and travel
with the task; texts stream through ``mapInArrow`` and nothing is shuffled.

Null texts count as empty; empty texts have no spans; repeated rows are scanned one by one;
an empty table gives an empty result; extra columns are left alone.
"""

from __future__ import annotations

import bisect
import itertools
import math
import os
import random
import re
import string
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.common import table

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
#: Every match of ASSIGN holds one of these.
ASSIGN_HINTS = ("passw", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")  # a greedy run of 16 or more
HEX = re.compile(r"[0-9a-f]{32,}")
SHORTEST = 16
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{16,}")
SEPARATOR = re.compile(r"[+/_.=-]")
SOFT = re.compile(r"[A-Za-z0-9+/=]{16,}")

ALNUM, UPNUM, HEXES = string.ascii_letters + string.digits, string.ascii_uppercase + string.digits, "0123456789abcdef"
URL64 = ALNUM + "_-"
#: Published token formats: kind, then literals and (alphabet, shortest, longest) in order. A kind may have several.
FORMATS = (
    ("aws", "AKIA", (UPNUM, 16, 16)),
    ("aws-session", "ASIA", (UPNUM, 16, 16)),
    ("github", "ghp_", (ALNUM, 36, 36)),
    ("github-app", "ghs_", (ALNUM, 36, 36)),
    ("gitlab", "glpat-", (URL64, 20, 20)),
    ("slack", "xoxb-", (string.digits, 10, 13), "-", (string.digits, 10, 13), "-", (ALNUM, 24, 24)),
    ("slack", "xoxb-", (string.digits, 11, 11)),
    ("stripe", "sk_live_", (ALNUM, 24, 24)),
    ("google", "AIza", (URL64, 35, 35)),
    ("sendgrid", "SG.", (URL64, 22, 22), ".", (URL64, 43, 43)),
    ("sendgrid", "SG.", (URL64, 22, 22)),
    ("npm", "npm_", (ALNUM, 36, 36)),
    ("digest", (HEXES, 40, 40)),
    # No published format: what tokens of formats that nobody has labelled look like, with a short name before them or none.
    ("generic", (string.ascii_lowercase, 2, 6), "_", (ALNUM, 24, 48)),
    ("generic", (string.ascii_lowercase, 2, 6), "-", (URL64, 20, 48)),
    ("generic", (ALNUM, 24, 64)),
    *(("jwt", "eyJ", (URL64, 17, 120), ".eyJ", (URL64, 20, 600), ".", (URL64, n, n)) for n in (43, 64, 86, 342)),
)
LABELLED, HELD_OUT, SEED = 120, 40, 11
#: Ordinary strings of one make have an automaton of their own, and the best of these stands against a credential.
MAKES = (re.compile(r"[0-9]+"), re.compile(r"[A-Z-]+"), re.compile(r"[A-Za-z]+"), re.compile(r"[A-Za-z-]+"))
GENERIC = "generic"


def labelled_credentials(each: int = LABELLED + HELD_OUT, seed: int = SEED) -> list[tuple[str, str]]:
    """(kind, credential) pairs drawn from FORMATS, the same at every call, and ordinary strings as kind ''."""
    draw = random.Random(seed)
    fill = lambda x: x if isinstance(x, str) else "".join(draw.choices(x[0], k=draw.randint(*x[1:])))
    found = []
    for kind in dict.fromkeys(f[0] for f in FORMATS):
        forms = [f[1:] for f in FORMATS if f[0] == kind]
        found += [(kind, "".join(map(fill, forms[i % len(forms)]))) for i in range(each)]
    words = ["the", "and", "tion", "er", "con", "de", "re", "in", "ment", "www", "http", "index", "page", "item", "version", "chapter", "figure", "file", "data", "image"]
    for _ in range(6 * each):
        parts = ["".join(draw.choices(words, k=draw.randint(1, 4))) + (str(draw.randint(0, 2100)) if draw.random() < 0.4 else "") for _ in range(draw.randint(1, 4))]
        found.append(("", draw.choice("-_./=").join(parts)))
    # Words of any language that has these letters: long ones are as ordinary as short ones.
    letters = "".join(c * n for c, n in zip("etaoinshrdlucmfwypvbgkjqxz", (12, 9, 8, 8, 7, 7, 6, 6, 6, 4, 4, 3, 3, 3, 2, 2, 2, 2, 1, 2, 2, 1, 1, 1, 1, 1)))
    for _ in range(6 * each):
        word = "-".join("".join(draw.choices(letters, k=draw.randint(6, 24))) for _ in range(draw.choice((1, 1, 1, 2, 3))))
        found.append(("", draw.choice((word, word, word, word.capitalize(), word.upper()))))
    found += [("", fill((string.digits, 16, 24))) for _ in range(4 * each)]  # numbers of records, times
    return found


class Automaton:
    """A probabilistic automaton from strings, by merging compatible states of their prefix tree."""

    def __init__(self, strings: Iterable[str], alpha: float = 0.05):
        self.next: list[dict[str, int]] = [{}]
        self.took: list[dict[str, int]] = [{}]
        self.ends = [0]
        self.seen = [0]
        for x in strings:
            at = 0
            self.seen[0] += 1
            for c in x:
                self.took[at][c] = self.took[at].get(c, 0) + 1
                if c not in self.next[at]:
                    self.next[at][c] = len(self.next)
                    self.next.append({})
                    self.took.append({})
                    self.ends.append(0)
                    self.seen.append(0)
                at = self.next[at][c]
                self.seen[at] += 1
            self.ends[at] += 1
        self._width = math.sqrt(0.5 * math.log(2 / alpha))
        self._merge_all()
        self.logs = []
        for s in range(len(self.next)):
            total = self.seen[s] + 1
            self.logs.append(({c: math.log(n / total) for c, n in self.took[s].items()}, math.log((self.ends[s] + 0.5) / total)))

    def _differ(self, a: int, b: int) -> bool:
        na, nb = self.seen[a], self.seen[b]
        bound = self._width * (1 / math.sqrt(na) + 1 / math.sqrt(nb))
        pairs = [(self.ends[a], self.ends[b])] + [(self.took[a].get(c, 0), self.took[b].get(c, 0)) for c in self.took[a].keys() | self.took[b].keys()]
        return any(abs(x / na - y / nb) > bound for x, y in pairs)

    def _compatible(self, a: int, b: int) -> bool:
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            if self._differ(a, b):
                return False
            todo += [(self.next[a][c], self.next[b][c]) for c in self.next[a].keys() & self.next[b].keys() if self.next[a][c] != self.next[b][c]]
        return True

    def _fold(self, a: int, b: int) -> None:
        """b and the tree below it go into a."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            self.seen[a] += self.seen[b]
            self.ends[a] += self.ends[b]
            for c, n in self.took[b].items():
                self.took[a][c] = self.took[a].get(c, 0) + n
                if c in self.next[a]:
                    todo.append((self.next[a][c], self.next[b][c]))
                else:
                    self.next[a][c] = self.next[b][c]

    def _merge_all(self) -> None:
        red = [0]
        known = {0}
        # What every string begins with stands once, at the beginning: a state seen once or twice deep in the tree is compatible with anything, and merged into one of these it would let strings go on without the beginning.
        head, at = set(), 0
        while len(self.next[at]) == 1 and not self.ends[at]:
            head.add(at)
            (at,) = self.next[at].values()
        while True:
            blue = min(((self.next[r][c], r, c) for r in red for c in self.next[r] if self.next[r][c] not in known), default=None)
            if blue is None:
                break
            state, parent, symbol = blue
            for r in reversed(red):
                if r not in head and self._compatible(r, state):
                    self.next[parent][symbol] = r
                    self._fold(r, state)
                    break
            else:
                red.append(state)
                known.add(state)
        place = {s: i for i, s in enumerate(red)}
        self.next, self.took, self.ends, self.seen = [{c: place[t] for c, t in self.next[s].items()} for s in red], [self.took[s] for s in red], [self.ends[s] for s in red], [self.seen[s] for s in red]

    def score(self, x: str, unseen: float = -12.0, least: float = -math.inf) -> float:
        """Mean log-likelihood of the characters and the end; a character that the state has not met costs as much as ``unseen``. Minus infinity as soon as the mean cannot reach ``least`` any more, since no term is above 0."""
        at, total, floor = 0, 0.0, least * (len(x) + 1)
        for c in x:
            logs = self.logs[at][0]
            if c in logs:
                total += logs[c]
                at = self.next[at][c]
            else:
                total += unseen
            if total < floor:
                return -math.inf
        return (total + self.logs[at][1]) / (len(x) + 1)


class Grammars:
    """An automaton for each kind and the bounds that its held-out credentials reach."""

    def __init__(self, labelled: list[tuple[str, str]], held_out: int = HELD_OUT):
        by: dict[str, list[str]] = {}
        for kind, x in labelled:
            by.setdefault(kind, []).append(x)
        ordinary: dict[int, list[str]] = {}
        for x in by.pop("", ["a"]):
            ordinary.setdefault(next((i for i, m in enumerate(MAKES) if m.fullmatch(x)), -1), []).append(x)
        self.ordinary = [Automaton(xs) for xs in ordinary.values()]
        # A kind's beginning tells it from words, even where no digit does: it stands against strings of several parts and numbers.
        self.mixed = Automaton([x for i, xs in ordinary.items() if i <= 0 for x in xs] or ["a"])
        self.kinds = {}
        for kind, xs in by.items():
            model, rest = Automaton(xs[held_out:]), xs[:held_out]
            # A kind that begins as nothing else does may be told from ordinary strings by half of what held-out ones are; one without such a beginning has only that.
            headed = len(os.path.commonprefix(xs)) >= 2
            plain = self.mixed.score if headed else self.plain
            self.kinds[kind] = (model, plain, min(map(model.score, rest)) - 0.15, min(model.score(x) - plain(x) for x in rest) * (0.5 if headed else 0.6))
        xs = [x for kind, own in by.items() for x in own]
        held = set("".join(xs))
        # What a run may hold and no labelled credential does ends a part for certain; dots do unless the formats have them.
        self.hard = re.compile("[" + re.escape("".join(c for c in "=/+.-_" if c not in held)) + "]+") if not set("=/+.-_") <= held else None
        self.fields = max((x.count(".") for x in xs), default=0) + 1
        heads = {os.path.commonprefix(own) for own in by.values()}
        heads = sorted((h for h in heads if len(h) >= 3), key=len, reverse=True)
        self.heads = re.compile("(?<=[-_])(?:" + "|".join(map(re.escape, heads)) + ")") if heads else None

    def plain(self, x: str) -> float:
        """How well x goes as an ordinary string."""
        return max(m.score(x) for m in self.ordinary)

    def kind_of(self, x: str, generic: bool | None = None) -> str | None:
        """The kind that explains x best among those whose bounds x reaches: a published one (False), the generic one (True), or that where there is no other."""
        if generic is None:
            return self.kind_of(x, False) or self.kind_of(x, True)
        best = None
        for kind, (model, plain, least, gain) in self.kinds.items():
            if (kind == GENERIC) != generic:
                continue
            if (s := model.score(x, least=least)) >= least:
                if s - plain(x) >= max(gain, 0.5) and (best is None or s > best[0]):
                    best = (s, kind)
        return best and best[1]

    def parts(self, run: str) -> Iterator[tuple[int, int]]:
        """Parts of a run as (start, end), those that may hold others first: what stands between separators that no credential holds; so many neighbouring fields between dots as credentials have, then fewer; what stands behind '-' or '_' and begins as credentials of a kind do; what stands between '-' and '_'."""
        at = 0
        for m in [*(self.hard.finditer(run) if self.hard else ()), None]:
            end = m.start() if m else len(run)
            if end - at >= SHORTEST:
                yield at, end
                yield from self._within(run, at, end)
            at = m.end() if m else end

    def _within(self, run: str, at: int, end: int) -> Iterator[tuple[int, int]]:
        cuts = [at - 1, *(m.start() for m in re.compile(r"\.").finditer(run, at, end)), end]
        for n in range(min(self.fields, len(cuts) - 1), 0, -1):
            for a, b in zip(cuts, cuts[n:]):
                if b - a > SHORTEST:
                    yield a + 1, b
                    if self.heads:
                        # Of several in one field each reaches to the next, the last to the end.
                        starts = [m.start() for m in self.heads.finditer(run, a + 1, b if n == 1 else run.find(".", a + 1) + 1)]
                        yield from zip(starts, [*(s - 1 for s in starts[1:]), b])
        for a, b in zip(cuts, cuts[1:]):
            yield from ((m.start(), m.end()) for m in SOFT.finditer(run, a + 1, b))


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, number of the kind, end) of the base patterns, sorted."""
    found = []
    low = text.lower() if not text.islower() else text
    if any(h in low for h in ASSIGN_HINTS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def scan(text: str, grammars: Grammars) -> tuple[list[tuple[int, int, str]], list[tuple[int, str, int]]]:
    """Base spans, and all spans as (start, kind, end)."""
    base = base_spans(text)
    spans = [(s, KINDS[k], e) for s, k, e in base]
    order = {k: i for i, k in enumerate((*KINDS, *grammars.kinds))}
    # Base spans by their starts, and how far those up to each one reach.
    starts, reach = [s for s, _, _ in base], list(itertools.accumulate((e for _, _, e in base), max))
    for m in CANDIDATE.finditer(text):
        run, whole = m[0], m[0].strip(".=-")
        found: list[tuple[int, int]] = []  # disjoint, sorted
        parts = [(0, len(run)), *grammars.parts(run)] if SEPARATOR.search(run) else [(0, len(run))]
        # What is of no published format is looked for where none was found, and only between separators that no credential holds.
        pieces = parts[1:] if grammars.hard and grammars.hard.search(run) else parts
        for generic, some in ((False, parts), (True, pieces if GENERIC in grammars.kinds else ())):
            for a, b in some:
                a, b = a + len(run[a:b]) - len(run[a:b].lstrip(".=-")), a + len(run[a:b].rstrip(".=-"))
                start, end = m.start() + a, m.start() + b
                i, k = bisect.bisect_right(starts, start), bisect.bisect_left(found, (end, 0))
                if b - a < SHORTEST or (i and reach[i - 1] >= end) or (k and found[k - 1][1] > start):
                    continue
                if kind := grammars.kind_of(run[a:b], generic):
                    spans.append((start, kind, end))
                    found.insert(k, (start, end))
                    if b - a == len(whole):
                        break
            if found and found[0][1] - found[0][0] == len(whole):
                break
    spans.sort(key=lambda x: (x[0], order[x[1]], x[2]))
    return base, spans


def joined(spans: Iterable[tuple[int, str, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, k, e in spans)


def secret_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", labelled: list[tuple[str, str]] | None = None) -> DataFrame:
    """doc_id, text, n_assign, n_access, n_hex, base_spans and spans as arrays of (kind, start, end), code points."""
    grammars = Grammars(labelled or labelled_credentials())
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    counts = ("n_assign", "n_access", "n_hex")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            found = [scan(t or "", grammars) for t in texts]
            arrays = [b.column(0), b.column(1), *(pa.array([sum(k == i for _, k, _ in base) for base, _ in found], pa.int64()) for i in range(3))]
            arrays += [pa.array([[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in base] for base, _ in found], span), pa.array([[{"kind": k, "start": s, "end": e} for s, k, e in spans] for _, spans in found], span)]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "text", *counts, "base_spans", "spans"])

    spans = "array<struct<kind:string,start:bigint,end:bigint>>"
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, text string, n_assign bigint, n_access bigint, n_hex bigint, base_spans {spans}, spans {spans}")


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mask: str = "[secret]") -> DataFrame:
    """docs with each run of overlapping spans replaced by the mask."""
    grammars = Grammars(labelled_credentials())
    at = docs.columns.index(text_col)

    def clean(text: str | None) -> str | None:
        if not text:
            return text
        out, done = [], 0
        for s, _, e in scan(text, grammars)[1]:
            if s >= done:
                out += [text[done:s], mask]
            done = max(done, e)
        return "".join([*out, text[done:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(list(map(clean, c.to_pylist())), pa.string()) if i == at else c for i, c in enumerate(b.columns)], b.schema.names)

    return docs.mapInArrow(run, docs.schema)


def _digest(spans: str):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(_digest("base_spans").cast("binary"), 256).alias("base_sha256"), _digest("spans").alias("spans"))
