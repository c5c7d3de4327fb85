"""Deduplication by key, and the greedy fuzzy merge of names within a type.

Order matters in all of these, so every input has a ``seq`` column that orders its rows: a number,
or a struct where no number is wide enough.
"""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.text import normalize_name, strip
from sparkloom.lineage import cut
from sparkloom.operators.components import components
from sparkloom.operators.ratio import ratio, ratio_join


def _best(df: DataFrame, keys: dict[str, Column], by: Column) -> DataFrame:
    keyed = df.select("*", *(c.alias(f"_k{i}") for i, c in enumerate(keys.values())))
    own = F.struct(*(F.col(f"`{c}`") for c in df.columns))
    return keyed.groupBy(*(f"_k{i}" for i in range(len(keys)))).agg(F.min_by(own, by).alias("_row")).select("_row.*")


def _falling(c: Column) -> Column:
    """An order from the greatest to the smallest; null comes last."""
    return F.struct(c.isNull(), -c)


def first_of(df: DataFrame, **keys: Column) -> DataFrame:
    """Of the rows with equal keys the first by seq. Partial aggregation keeps one row a key and task."""
    return _best(df, keys, F.col("seq"))


def best_of(df: DataFrame, **keys: Column) -> DataFrame:
    """Of the rows with equal keys the one with the highest confidence, then the first."""
    return _best(df, keys, F.struct(_falling(F.col("confidence")), F.col("seq")))


def entities_exact(df: DataFrame) -> DataFrame:
    """One entity for each (name, type) as written."""
    return best_of(df, name=F.col("name"), type=F.col("type"))


def entities_final(df: DataFrame) -> DataFrame:
    """One entity for each (name, type), names without white space at their ends."""
    return best_of(df, name=strip(F.col("name")), type=F.col("type"))


def entities_by_tool(df: DataFrame) -> DataFrame:
    """One entity for each name|type; a missing confidence counts as 0 in the row that stands and as 1 in one that comes."""
    # The first row stands with 0 and loses to any later one above that, and those among themselves by what they hold.
    first = F.row_number().over(_order(F.concat_ws("|", strip(F.col("name")), F.col("type")))) == 1
    ranked = df.withColumn("_c", F.when(first, F.coalesce("confidence", F.lit(0.0))).otherwise(F.coalesce("confidence", F.lit(1.0))))
    return _best(ranked, {"k": F.concat_ws("|", strip(F.col("name")), F.col("type"))}, F.struct(_falling(F.col("_c")), F.col("seq"))).drop("_c")


def _order(key: Column):
    from pyspark.sql import Window

    return Window.partitionBy(key).orderBy("seq")


def _spo() -> dict[str, Column]:
    return {c: strip(F.col(c)) for c in ("subject", "predicate", "object")}


def relations_first(df: DataFrame) -> DataFrame:
    return first_of(df, **_spo())


def relations_best(df: DataFrame) -> DataFrame:
    return best_of(df, **_spo())


def triples_first(df: DataFrame) -> DataFrame:
    return first_of(df, **{c: F.col(c) for c in ("subj_name", "subj_type", "predicate", "obj_name", "obj_type")})


def ratio_above(a: str, b: str, threshold: float) -> bool:
    """Whether difflib's ratio of a and b exceeds the threshold, with its upper bounds first."""
    return ratio(difflib.SequenceMatcher(None, "", ""), a, b, threshold) > threshold


def merge_names(rows: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """The greedy merge: each row that is left takes in the later ones whose names are close to the best of its group so far; a more confident one becomes the best. Attributes of the rest fill gaps."""
    rows = rows.sort_values("seq")
    records = rows.to_dict("records")
    gone, out = set(), []
    for i, best in enumerate(records):
        if i in gone:
            continue
        for j in range(i + 1, len(records)):
            other = records[j]
            if j not in gone and ratio_above(best["norm"], other["norm"], threshold):
                if other["confidence"] > best["confidence"]:
                    best = other
                if other["attributes"] is not None:
                    best = best | {"attributes": {**dict(other["attributes"]), **dict(best["attributes"] if best["attributes"] is not None else {})}}
                gone.add(j)
        out.append(best)
    return pd.DataFrame(out, columns=rows.columns)


def entities_fuzzy(df: DataFrame, threshold: float = 0.85) -> DataFrame:
    """Merges close names within each type (seq, name, type, confidence, attributes).

    The merge is a fold over a type's rows in order. A row is only ever taken in by one that it is
    close to, so all of a group lies in one component of the graph of close names; the fold of a type is
    that of its components, each by itself, in order. Close names are found by a join
    without loss; rows that resemble none other are not touched. A component is one task's work, so exact copies should be merged before,
    as the dedup by key does.
    """
    rows = df.select("seq", "name", "type", F.coalesce("confidence", F.lit(1.0)).alias("confidence"), "attributes", normalize_name(F.col("name")).alias("norm"))
    rows = rows.withColumn("node", F.xxhash64("type", "norm"))
    names = cut(rows.select("type", "norm", "node").distinct())
    # A null type is one of its own; for the join it has a name that no type can have.
    left = names.select(F.coalesce(F.concat(F.lit("t"), "type"), F.lit("")).alias("of"), F.col("norm").alias("x"), F.col("node").alias("a"))
    right = left.select("of", F.col("x").alias("y"), F.col("a").alias("b"))
    close = ratio_join(left, "x", right, "y", threshold, on=("of",), either=True).filter("a < b").select("a", "b")
    labels = components(close)
    rows = rows.join(labels, "node", "left").withColumn("group", F.coalesce("label", "node")).drop("label", "node")
    sizes = rows.groupBy("type", "group").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select(F.col("type").alias("_type"), F.col("group").alias("_group"), "_n")
    sized = rows.join(sizes, F.col("type").eqNullSafe(F.col("_type")) & (F.col("group") == F.col("_group")), "left").drop("_type", "_group")
    alone, several = sized.filter("_n is null").drop("_n"), sized.filter("_n is not null").drop("_n")
    merged = several.groupBy("type", "group").applyInPandas(lambda g: merge_names(g, threshold), several.schema)
    return alone.unionByName(merged).drop("norm", "group")


def gleaning_merge(existing: DataFrame, gleaned: DataFrame) -> DataFrame:
    """Existing entities with the longer description and the greater confidence of gleaned ones, and new ones appended (name, type, description, confidence, seq)."""
    b = first_of(gleaned, name=F.col("name"), type=F.col("type")).select("name", "type", F.col("description").alias("_d"), F.col("confidence").alias("_c"), F.col("seq").alias("_s"))
    both = existing.join(b, ["name", "type"], "full_outer")
    longer = F.length(F.coalesce("_d", F.lit(""))) > F.length(F.coalesce("description", F.lit("")))
    return both.select("name", "type", F.when(longer, F.col("_d")).otherwise(F.coalesce("description", "_d")).alias("description"), F.greatest("confidence", "_c").alias("confidence"), F.coalesce("seq", "_s").alias("seq"))
