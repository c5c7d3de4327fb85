"""Entities and relations of tables under a column mapping: no shuffle but that of the dedup."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.text import strip
from sparkloom.operators.dedup import first_of

#: Fixed values.
ID_CONFIDENCE, REFERENCE_CONFIDENCE = 0.95, 0.9


@dataclass(frozen=True)
class Mapped:
    """What a column says: role id, reference or attribute."""

    column: str
    role: str
    entity_type: str = "Entity"
    relation: str = ""
    is_multi: bool = False


def numbered(first: str, *places: str) -> Column:
    """One number of 38 digits that orders as these columns do: the first may be any long, the others are below 10 ** 6 (by any number of them up to three)."""
    n = F.col(first).cast("decimal(38,0)")
    for p in places:
        n = (n * F.lit(10**6).cast("decimal(7,0)")).cast("decimal(38,0)") + F.col(p).cast("decimal(10,0)")
    return n.cast("decimal(38,0)")


def _values(m: Mapped) -> Column:
    v = strip(F.coalesce(F.col(m.column).cast("string"), F.lit("")))
    parts = F.transform(F.split(F.replace(v, F.lit("，"), F.lit(",")), ","), strip) if m.is_multi else F.array(v)
    return F.filter(parts, lambda x: x != "")


def _entities(m: Mapped, k: int, confidence: float) -> Column:
    return F.transform(_values(m), lambda v, i: F.struct(v.alias("name"), F.lit(m.entity_type).alias("type"), F.lit(confidence).alias("confidence"), F.lit(k).alias("col"), i.alias("at")))


def _objects(m: Mapped, k: int) -> Column:
    return F.transform(_values(m), lambda v, i: F.struct(v.alias("object"), F.lit(m.relation).alias("predicate"), F.lit(k).alias("col"), i.alias("at")))


def structured_entities(rows: DataFrame, mapping: list[Mapped]) -> DataFrame:
    """(seq, name, type, confidence) of id and reference columns, the first of equal (name, type). rows has a seq column; ids come before references in a row. seq of the result orders by the row's, the column and the place in the cell."""
    ids, refs = ([m for m in mapping if m.role == r] for r in ("id", "reference"))
    all_ = [(m, ID_CONFIDENCE) for m in ids] + [(m, REFERENCE_CONFIDENCE) for m in refs]
    found = F.flatten(F.array(*(_entities(m, k, c) for k, (m, c) in enumerate(all_))))
    flat = rows.select("seq", F.explode(found).alias("e")).select(numbered("seq", "e.col", "e.at").alias("seq"), "e.name", "e.type", "e.confidence")
    return first_of(flat, name=F.col("name"), type=F.col("type"))


def structured_relations(rows: DataFrame, mapping: list[Mapped]) -> DataFrame:
    """(seq, subject, predicate, object, confidence, evidence) of each id with each reference of its row, the first of equal ones."""
    ids, refs = ([m for m in mapping if m.role == r] for r in ("id", "reference"))
    subjects = F.flatten(F.array(*map(_values, ids)))
    objects = F.flatten(F.array(*(_objects(m, k) for k, m in enumerate(refs) if m.relation)))
    source = F.col("_source") if "_source" in rows.columns else F.lit("")
    flat = rows.select("seq", source.alias("source"), subjects.alias("subjects"), F.explode(objects).alias("o")).select("seq", "source", F.posexplode("subjects").alias("s", "subject"), "o.*")
    flat = flat.filter("subject <> object")
    out = flat.select(numbered("seq", "col", "at", "s").alias("seq"), "subject", "predicate", "object", F.lit(REFERENCE_CONFIDENCE).alias("confidence"), F.concat(F.lit("Row from "), F.coalesce("source", F.lit(""))).alias("evidence"))
    return first_of(out, subject=F.col("subject"), predicate=F.col("predicate"), object=F.col("object"))
