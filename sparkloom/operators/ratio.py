"""Lossless join of names on difflib's ratio, by an inverted index of rare n-grams.

A ratio above t of strings of n and k letters means more than t (n + k) / 2 matched letters, in
blocks that stand in both. What is not matched, u letters in all, separates at most u + 1
blocks, so the strings share at least m - (u + 1) (q - 1) of their q-grams, m being the matched
letters. Bigrams are taken where that leaves one at least for all lengths (thresholds from about 0.75
on), single letters elsewhere. The n-th occurrence of a gram is a token of its own. With tokens in one order, strings of g grams that share s of
them have r of their first g - s + r in common: names meet by combinations of ``TOGETHER`` such tokens, of fewer where they must share no more. Rare tokens
come first: the ``COMMON`` most frequent ones are ranked by a count over all names, all others come before them.

A pair that shares several combinations counts at the first of them, lengths and letters are
compared before difflib is asked. Nothing is held for a whole key, so a common one is split like any skewed key of a join.
"""

from __future__ import annotations

import difflib
import functools
import itertools
import math
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COMMON, TOGETHER = 4096, 2


def least_matched(n: int, k: int, threshold: float) -> int:
    """Letters that strings of n and k letters match at least for a ratio above the threshold."""
    return math.floor(threshold * (n + k) / 2 - 1e-9) + 1


def partners(n: int, threshold: float) -> range:
    """Lengths that a string of n letters can have such a ratio with."""
    low = math.ceil(n * threshold / (2 - threshold) - 1e-9)
    return range(low, math.floor(n * (2 - threshold) / threshold + 1e-9) + 1) if threshold > 0 else range(0, 4 * n + 1)


def shared_by(n: int, k: int, threshold: float, q: int) -> int | None:
    """q-grams that strings of n and k letters share at least for such a ratio; None where they can't have it."""
    m = least_matched(n, k, threshold)
    return m - (n + k - 2 * m + 1) * (q - 1) if m <= min(n, k) else None


@functools.lru_cache(100_000)
def least_shared(n: int, threshold: float, q: int) -> int:
    """q-grams that a string of n letters shares at least with any string that it has such a ratio with."""
    return min((s for k in partners(n, threshold) if (s := shared_by(n, k, threshold, q)) is not None), default=n + 1)


@functools.lru_cache(100_000)
def arities(n: int, threshold: float, q: int, together: int) -> tuple[tuple[int, int], ...]:
    """(r, s): by how many tokens together a string of n letters meets others, and how many it shares at least with those that it meets so. Both sides of a pair come to one r."""
    out: dict[int, int] = {}
    for k in partners(n, threshold):
        s = shared_by(n, k, threshold, q)
        if s is not None and k:
            r = max(1, min(together, least_shared(n, threshold, q), least_shared(k, threshold, q)))
            out[r] = min(out.get(r, s), s)
    return tuple(out.items())


@functools.lru_cache(100)
def gram_size(threshold: float) -> int:
    """2 where two letters always share a bigram, else 1. From 64 letters on the bound only grows."""
    return 2 if 1.5 * threshold - 1 > 0.04 and all(least_shared(n, threshold, 2) >= 1 for n in range(2, 64)) else 1


def tokens(norm: str, q: int) -> list[str]:
    """Grams with the number of times that they have come before; a string that is too short is its own."""
    seen: Counter = Counter()
    out = []
    for i in range(max(1, len(norm) - q + 1)):
        g = norm[i : i + q]
        out.append(f"{g}{seen[g] or ''}")
        seen[g] += 1
    return out


def keys(norm: str, threshold: float, q: int, common: dict[str, int], together: int = TOGETHER) -> list[str]:
    """The combinations of tokens by which a string is found."""
    own = sorted(tokens(norm, q), key=lambda x: (common.get(x, -1), x))
    if len(norm) < q:
        return own  # such a string only has the ratio with itself
    out = []
    for r, s in arities(len(norm), threshold, q, together):
        out += ["\n".join(c) for c in itertools.combinations(own[: max(r, len(own) - max(r, s) + r)], r)]
    return out


def _common(names: DataFrame, norm: str, q: int) -> dict[str, int]:
    """Places of the most frequent tokens, the rarest of them first."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            c = Counter(t for x in b[norm] for t in tokens(x, q))
            yield pd.DataFrame({"token": list(c), "n": list(c.values())})

    top = names.select(norm).mapInPandas(count, "token string, n long").groupBy("token").agg(F.sum("n").alias("n")).orderBy(F.col("n").desc(), "token").limit(COMMON)
    found = top.collect()
    return {r["token"]: len(found) - i for i, r in enumerate(found)}


def candidates(left: DataFrame, lnorm: str, right: DataFrame, rnorm: str, threshold: float, on: tuple[str, ...] = ()) -> DataFrame:
    """left joined with right (columns of different names but for ``on``, which are equal) wherever the ratio may exceed the threshold; each pair once for each pair of rows."""
    q = gram_size(threshold)
    common = _common(right, rnorm, q)

    def indexed(df: DataFrame, norm: str, own: str) -> DataFrame:
        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                yield b.assign(**{own: [keys(x, threshold, q, common) for x in b[norm]]})

        return df.mapInPandas(run, f"{kinds}, {own} array<string>").withColumn("_token", F.explode(own))

    n, k = F.length(lnorm), F.length(rnorm)
    near = (2.0 * F.least(n, k) > threshold * (n + k) - 1e-9) | ((n == 0) & (k == 0))
    first = F.array_min(F.array_intersect("_left", "_right")) == F.col("_token")
    both = indexed(left, lnorm, "_left").join(indexed(right, rnorm, "_right"), [*on, "_token"])
    return both.filter(near & first).drop("_left", "_right", "_token")


def ratio(matcher: difflib.SequenceMatcher, a: str, b: str, threshold: float) -> float:
    """difflib's ratio, or 0 where a bound shows that it does not exceed the threshold."""
    total = len(a) + len(b)
    if not total:
        return 1.0
    if 2.0 * sum((Counter(a) & Counter(b)).values()) <= threshold * total:
        return 0.0
    matcher.set_seq1(a)
    matcher.set_seq2(b)
    return matcher.ratio()


def ratio_join(left: DataFrame, lnorm: str, right: DataFrame, rnorm: str, threshold: float, on: tuple[str, ...] = (), either: bool = False) -> DataFrame:
    """candidates with ``ratio``, where it exceeds the threshold: that of left's string with right's, or with ``either`` the greater of both orders."""
    found = candidates(left, lnorm, right, rnorm, threshold, on)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in found.schema)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = difflib.SequenceMatcher(None, "", "")
        for b in batches:
            r = [ratio(m, x, y, threshold) for x, y in zip(b[lnorm], b[rnorm])]
            if either:
                r = [max(z, ratio(m, y, x, threshold)) if z <= threshold else z for z, x, y in zip(r, b[lnorm], b[rnorm])]
            yield b.assign(ratio=r)[[z > threshold for z in r]]

    return found.mapInPandas(score, f"{kinds}, ratio double")
