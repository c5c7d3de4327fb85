"""The schema of a graph as data: two small tables of entity and relation types, their checks and changes.

A schema is bounded and small; it is a driver-side value that becomes a DataFrame where rows meet it.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions.text import normalize_type_name


@dataclass(frozen=True)
class EntityType:
    name: str
    description: str = ""
    parent: str | None = None


@dataclass(frozen=True)
class RelationType:
    name: str
    description: str = ""
    domain: str | None = None
    range: str | None = None
    inverse: str | None = None


@dataclass(frozen=True)
class Change:
    """add, remove or modify an entity_type or relation_type."""

    action: str
    target: str
    name: str
    description: str = ""
    domain: str | None = None
    range: str | None = None
    parent: str | None = None


@dataclass(frozen=True)
class Ontology:
    name: str = ""
    description: str = ""
    entity_types: tuple[EntityType, ...] = ()
    relation_types: tuple[RelationType, ...] = ()
    raw: str = field(default="", compare=False)

    @property
    def is_structured(self) -> bool:
        return bool(self.entity_types)

    def entity_frame(self, spark: SparkSession) -> DataFrame:
        rows = [(i, e.name, e.description, e.parent) for i, e in enumerate(self.entity_types)]
        return spark.createDataFrame(rows, "ord int, name string, description string, parent string")

    def relation_frame(self, spark: SparkSession) -> DataFrame:
        rows = [(i, r.name, r.description, r.domain, r.range, r.inverse) for i, r in enumerate(self.relation_types)]
        return spark.createDataFrame(rows, "ord int, name string, description string, domain string, range string, inverse string")

    def guide(self) -> str:
        """The schema as text for a model."""
        return "\n".join([f"# Ontology: {self.name}", self.description, "", *self._lists()])

    def _lists(self) -> list[str]:
        types = [f"  - **{e.name}**" + (f" (subtype of: {e.parent})" if e.parent else "") + f": {e.description}" for e in self.entity_types]
        relations = [f"  - **{r.name}**" + (f" from `{r.domain}`" if r.domain else "") + (f" to `{r.range}`" if r.range else "") + f": {r.description}" for r in self.relation_types]
        return ["## Entity Types", *types, "", "## Relation Types", *relations]

    def apply(self, changes: Iterable[Change]) -> Ontology:
        """With the changes in order. A modification takes the first type of that name and keeps what it does not give."""
        lists = {"entity_type": list(self.entity_types), "relation_type": list(self.relation_types)}
        fields = {"entity_type": ("parent",), "relation_type": ("domain", "range")}
        kinds = {"entity_type": EntityType, "relation_type": RelationType}
        for c in changes:
            if c.target not in lists:
                continue
            own = lists[c.target]
            given = {f: getattr(c, f) for f in fields[c.target]}
            if c.action == "add":
                own.append(kinds[c.target](c.name, c.description, **given))
            elif c.action == "remove":
                own[:] = [x for x in own if x.name != c.name]
            elif c.action == "modify" and (at := next((i for i, x in enumerate(own) if x.name == c.name), None)) is not None:
                new = {k: v for k, v in given.items() if v is not None} | ({"description": c.description} if c.description else {})
                own[at] = replace(own[at], **new)
        out = replace(self, name=self.name or "refined", entity_types=tuple(lists["entity_type"]), relation_types=tuple(lists["relation_type"]))
        return replace(out, raw="\n".join([f"# Ontology: {out.name}", "", *out._lists()]))


def hierarchy(entity_types: DataFrame) -> DataFrame:
    """(type, ancestor, depth) of every type (name, parent) with itself and all types above it, by a recursive query. Parents that are no types count; a type on a circle has each of its circle once, at the least depth."""
    spark = entity_types.sparkSession
    name = f"types_{uuid.uuid4().hex}"
    edges = entity_types.select(F.col("name").alias("type"), "parent").filter("type is not null").distinct()
    edges.createOrReplaceTempView(name)
    try:
        # The path stops a walk at a type that it has met, so circles end.
        found = spark.sql(f"""
            WITH RECURSIVE up (type, ancestor, depth, path) AS (
                SELECT DISTINCT type, type, 0, array(type) FROM {name}
                UNION ALL
                SELECT u.type, e.parent, u.depth + 1, array_append(u.path, e.parent) FROM up u JOIN {name} e ON e.type = u.ancestor WHERE e.parent IS NOT NULL AND e.parent <> '' AND NOT array_contains(u.path, e.parent)
            ) SELECT type, ancestor, min(depth) AS depth FROM up GROUP BY type, ancestor""")
        found.schema  # resolved while the view is there
    finally:
        spark.catalog.dropTempView(name)
    return found


def guide_lines(entity_types: DataFrame, relation_types: DataFrame) -> DataFrame:
    """(section, ord, line) of a schema that is held as DataFrames."""
    opt = lambda before, c, after: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.concat(F.lit(before), F.col(c), F.lit(after))).otherwise(F.lit(""))
    line = lambda *extra: F.concat(F.lit("  - **"), F.col("name"), F.lit("**"), *extra, F.lit(": "), F.coalesce("description", F.lit("")))
    e = entity_types.select(F.lit("Entity Types").alias("section"), "ord", line(opt(" (subtype of: ", "parent", ")")).alias("line"))
    r = relation_types.select(F.lit("Relation Types").alias("section"), "ord", line(opt(" from `", "domain", "`"), opt(" to `", "range", "`")).alias("line"))
    return e.unionByName(r)


def apply_changes(types: DataFrame, changes: DataFrame) -> DataFrame:
    """Changes to a table of types (ord, name, description, parent) as joins; changes (ord, action, name, description, parent) with one change a name: removed names go, modified fields override, new ones come last."""
    c = changes.select("action", "name", F.col("description").alias("_d"), F.col("parent").alias("_p"))
    kept = types.join(c.filter("action = 'remove'").select("name"), "name", "left_anti")
    m = c.filter("action = 'modify'").drop("action")
    out = kept.join(m, "name", "left").select("ord", "name", F.when(F.coalesce("_d", F.lit("")) != "", F.col("_d")).otherwise(F.col("description")).alias("description"), F.coalesce("_p", "parent").alias("parent"))
    most = types.agg(F.max("ord").alias("m"))
    new = changes.filter("action = 'add'").join(F.broadcast(most)).select((F.coalesce("m", F.lit(-1)) + 1 + F.col("ord")).alias("ord"), "name", "description", "parent")
    return out.unionByName(new)


def invalid_entities(entities: DataFrame, entity_types: DataFrame, checked: int = 500, most: int = 100) -> DataFrame:
    """Of the first entities those whose type the schema lacks; empty types pass."""
    head = entities.orderBy("seq").limit(checked)
    return head.filter("type <> ''").join(entity_types.select(F.col("name").alias("type")).distinct(), "type", "left_anti").orderBy("seq").limit(most)


def invalid_relations(relations: DataFrame, relation_types: DataFrame, checked: int = 500, most: int = 100) -> DataFrame:
    head = relations.orderBy("seq").limit(checked)
    return head.filter("predicate <> ''").join(relation_types.select(F.col("name").alias("predicate")).distinct(), "predicate", "left_anti").orderBy("seq").limit(most)


def normalized_types(types: DataFrame) -> DataFrame:
    """Types (ord, name, ...) with normal names, the first of equal ones."""
    from sparkloom.operators.dedup import first_of

    return first_of(types.withColumn("name", normalize_type_name(F.col("name"))).withColumn("seq", F.col("ord")), n=F.col("name")).drop("seq")


def parents(types: DataFrame) -> DataFrame:
    """Types (ord, name, parent) with checked parents: one that exists, or exists in other case, stays; else the longest type that ends the name after a space is its parent.

    Every possible ending of a name is looked up in an equi-join, instead of comparing all names.
    """
    low = types.groupBy(F.lower("name").alias("_low")).agg(F.min_by("name", "ord").alias("_name"))
    exact = types.select(F.col("name").alias("_own")).distinct()
    out = types.join(exact, F.col("parent") == F.col("_own"), "left").join(low, F.lower("parent") == F.col("_low"), "left").withColumn("given", F.coalesce("_own", "_name")).drop("_own", "_low", "_name")
    words = F.split(F.lower("name"), " ")
    endings = F.transform(F.sequence(F.lit(2), F.size(words)), lambda i: F.array_join(F.slice(words, i, F.size(words)), " "))
    cut = out.filter("given is null").select("ord", F.explode(F.when(F.size(words) > 1, endings)).alias("ending"))
    found = cut.join(low, F.col("ending") == F.col("_low")).groupBy("ord").agg(F.max_by("_name", F.length("ending")).alias("inferred"))
    return out.join(found, "ord", "left").select("ord", "name", F.coalesce("given", "inferred").alias("parent"))


def default_relations(types: DataFrame, reach: int = 3) -> DataFrame:
    """related_to between each type and the next few, for a schema without relations."""
    other = types.select(F.col("ord").alias("o2"), F.col("name").alias("range"))
    steps = types.select(F.col("ord").alias("o1"), F.col("name").alias("domain"), F.explode(F.sequence(F.lit(1), F.lit(reach))).alias("k"))
    pairs = steps.join(other, F.col("o1") + F.col("k") == F.col("o2"))
    return pairs.select(F.lit("related_to").alias("name"), "domain", "range", F.concat(F.lit("Relation between "), F.col("domain"), F.lit(" and "), F.col("range")).alias("description"))


def top_relations(predicates: DataFrame, most: int = 200) -> DataFrame:
    """The most frequent predicates with count and share of all."""
    counts = predicates.filter("predicate <> ''").groupBy("predicate").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.orderBy(F.col("n").desc(), "predicate").limit(most).join(F.broadcast(total)).select("predicate", "n", (F.col("n") / F.col("total")).alias("share"))


def text_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(line, change) of lines that only one of two texts has; both: line."""
    lines = lambda d: d.select(F.trim("line").alias("line")).filter("line <> ''").distinct()
    a, b = lines(old), lines(new)
    return b.subtract(a).withColumn("change", F.lit("added")).unionByName(a.subtract(b).withColumn("change", F.lit("removed")))


def is_type_list(text):
    """Whether a definition reads as a list of types: a dash list near its start, or many lines after a short first one."""
    head = F.substring(text, 1, 2000)
    lines = F.split(text, "\n")
    return F.rlike(head, F.lit(r"(?:^|\n)\s*-\s+\S+")) | ((F.size(lines) - 1 > 20) & (F.length(lines[0]) < 100))
