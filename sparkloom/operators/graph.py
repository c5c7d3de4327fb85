"""From mentions to triples: co-occurrence, prefilters, canonical predicates, triples, quality checks, the final union."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions.text import strip
from sparkloom.lineage import cut
from sparkloom.operators.dedup import entities_final, first_of, relations_best, triples_first
from sparkloom.operators.occur import SENT, holding, holding_words, size_of
from sparkloom.operators.resolve import RATIO, waterfall

#: Neighbours of a mention, shortest paragraph, most co-occurrences kept.
NEIGHBOURS, PARAGRAPH, TOP = 9, 50, 5000


def paragraphs(docs: DataFrame, separator: str = r"\n\s*\n", least: int = PARAGRAPH) -> DataFrame:
    """(doc_id, para, text) of the paragraphs that are long enough."""
    return docs.select("doc_id", F.posexplode(F.split("text", separator)).alias("para", "text")).filter(F.length("text") >= least)


def mentions(paras: DataFrame, names: DataFrame) -> DataFrame:
    """(doc_id, para, name, type, ord) of the names (name, type, ord) that a paragraph holds.

    A name of one word must be one of the paragraph's words; these meet in an equi-join on words.
    Names with a space may stand anywhere in a text, within words as well; texts are read once
    for all of them (``occur.holding``).
    """
    one = names.filter(~F.contains("name", F.lit(" "))).withColumn("word", F.lower("name"))
    words = paras.select("doc_id", "para", F.explode(F.array_distinct(F.split(F.trim(F.lower("text"), F.lit(" \t\n\x0b\x0c\r")), r"\s+"))).alias("word"))
    single = words.join(one, "word").select("doc_id", "para", "name", "type", "ord")
    several = names.filter(F.contains("name", F.lit(" "))).select("name", "type", "ord", F.lower("name").alias("low_name"))
    kept = ["doc_id", "para", "name", "type", "ord"]
    whole = holding(paras.select("doc_id", "para", F.lower("text").alias("low")), "low", several, "low_name", keep=kept).select(*kept)
    return single.unionByName(whole)


def neighbour_pairs(found: DataFrame, most: int = NEIGHBOURS) -> DataFrame:
    """Pairs of a mention and each of the next few of its paragraph, in the order of names: a window's frame instead of a self-join."""
    w = Window.partitionBy("doc_id", "para").orderBy("ord").rowsBetween(1, most)
    pairs = found.withColumn("next", F.collect_list(F.struct(F.col("name").alias("name2"), F.col("type").alias("type2"))).over(w))
    return pairs.select("doc_id", "para", F.col("name").alias("name1"), F.col("type").alias("type1"), F.explode("next").alias("n")).select("*", "n.*").drop("n")


def cooccurrence(found: DataFrame, source: str = "doc_id") -> DataFrame:
    """(e1_name, e1_type, e2_name, e2_type, cnt, n_sources, first_sources) of unordered pairs."""
    pairs = neighbour_pairs(found).filter("name1 <> name2")
    swap = F.col("name1") > F.col("name2")
    either = lambda a, b: F.when(swap, F.col(b)).otherwise(F.col(a))
    keyed = pairs.select(either("name1", "name2").alias("e1_name"), either("type1", "type2").alias("e1_type"), either("name2", "name1").alias("e2_name"), either("type2", "type1").alias("e2_type"), F.col(source).cast("string").alias("source"))
    # Sources are counted first, so that no set of them is held in memory.
    keys = ["e1_name", "e1_type", "e2_name", "e2_type"]
    by_source = keyed.groupBy(*keys, "source").agg(F.count(F.lit(1)).alias("n"))
    # A limit on ranks goes below the exchange, so a pair of any number of sources sends three rows a task.
    ranked = by_source.withColumn("r", F.row_number().over(Window.partitionBy(*keys).orderBy("source"))).filter(F.col("r") <= 3)
    first = ranked.groupBy(*keys).agg(F.array_sort(F.collect_list("source")).alias("first_sources"))
    return by_source.groupBy(*keys).agg(F.sum("n").alias("cnt"), F.count(F.lit(1)).alias("n_sources")).join(first, keys)


def weighted(pairs: DataFrame) -> DataFrame:
    """With weight cnt / max(cnt), confidence 0.3 + 0.6 * weight and an evidence text."""
    # The maximum comes from an aggregate, not from a window over all rows in one task.
    most = pairs.agg(F.max("cnt").alias("max_cnt"))
    out = pairs.join(F.broadcast(most)).withColumn("weight", F.col("cnt") / F.col("max_cnt")).drop("max_cnt")
    more = F.when(F.col("n_sources") > 3, F.concat(F.lit(" and "), (F.col("n_sources") - 3).cast("string"), F.lit(" more docs"))).otherwise(F.lit(""))
    evidence = F.concat(F.lit("Co-occurred "), F.col("cnt").cast("string"), F.lit("x in: "), F.array_join("first_sources", ", "), more)
    return out.withColumn("confidence", 0.3 + 0.6 * F.col("weight")).withColumn("evidence", evidence)


def upgraded(pairs: DataFrame, relation_types: DataFrame) -> DataFrame:
    """With the first relation type from one end's type to the other's as predicate, ends swapped if it runs the other way; co_occur if there is none. relation_types: ord, name, domain, range."""
    first = first_of(relation_types.filter("domain is not null and range is not null").withColumn("seq", F.col("ord")), d=F.col("domain"), r=F.col("range")).select("domain", "range", F.col("name").alias("predicate"))
    direct = first.select(F.col("domain").alias("e1_type"), F.col("range").alias("e2_type"), F.col("predicate").alias("p1"))
    back = first.select(F.col("range").alias("e1_type"), F.col("domain").alias("e2_type"), F.col("predicate").alias("p2"))
    out = pairs.join(direct, ["e1_type", "e2_type"], "left").join(back, ["e1_type", "e2_type"], "left")
    swap = F.col("p1").isNull() & F.col("p2").isNotNull()
    either = lambda a, b: F.when(swap, F.col(b)).otherwise(F.col(a))
    rest = [c for c in pairs.columns if c not in ("e1_name", "e1_type", "e2_name", "e2_type")]
    return out.select(either("e1_name", "e2_name").alias("subject"), either("e1_type", "e2_type").alias("subj_type"), F.coalesce("p1", "p2", F.lit("co_occur")).alias("predicate"), either("e2_name", "e1_name").alias("object"), either("e2_type", "e1_type").alias("obj_type"), *rest)


def top_pairs(relations: DataFrame, most: int = TOP) -> DataFrame:
    """The most confident ones; ties by names."""
    return relations.orderBy(F.col("confidence").desc(), *(c for c in ("subject", "predicate", "object", "e1_name", "e1_type", "e2_name", "e2_type") if c in relations.columns)).limit(most)


def backfill(relations: DataFrame, extra: DataFrame, least: int = 10) -> DataFrame:
    """relations, with extra appended only if there are fewer than ``least`` of them; ten rows are counted at most."""
    few = relations.limit(least).count() < least
    return relations.unionByName(extra, allowMissingColumns=True) if few else relations


def doc_groups(docs: DataFrame, size: int = 8, chars: int | None = None) -> DataFrame:
    """(grp, text): every ``size`` documents in order of doc_id, whole or, where that is given, cut to ``chars``, and tagged with their places.

    Places come from a range sort whose partitions are counted, so no window holds all rows.
    """
    text = F.coalesce("text", F.lit(""))
    placed = numbered(docs.select("doc_id", (text if chars is None else F.substring(text, 1, chars)).alias("text")), "doc_id")
    tagged = placed.withColumn("tag", F.concat(F.lit("[Doc "), F.col("place").cast("string"), F.lit("] "), F.col("text")))
    grouped = tagged.groupBy(F.floor(F.col("place") / size).alias("grp")).agg(F.array_sort(F.collect_list(F.struct("place", "tag"))).alias("own"))
    return grouped.select("grp", F.array_join(F.transform("own", lambda x: x["tag"]), "\n\n").alias("text"))


def numbered(df: DataFrame, *order: str | Column) -> DataFrame:
    """With ``place`` from 0 in the given order, without a window over all rows: a range sort is written, the rows of its partitions are counted (one number a partition reaches the driver), and each row adds those of the partitions before its own."""
    ranged = cut(df.repartitionByRange(*order).sortWithinPartitions(*order))
    ranged = ranged.withColumn("_part", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))
    before, total = [], 0
    counts = {r["_part"]: r["count"] for r in ranged.groupBy("_part").count().collect()}
    for k in range(max(counts, default=0) + 1):
        before.append(total)
        total += counts.get(k, 0)
    return ranged.withColumn("place", F.col("_row") + F.get(F.lit(before), F.col("_part"))).drop("_part", "_row")


def entity_prefilter(groups: DataFrame, names: DataFrame, most: int | None = None) -> DataFrame:
    """(grp, name, type, ord) of all names that a group's text holds, or of the first ``most`` of them; names: name, type, ord."""
    some = names.filter(F.length("name") >= 2).select("name", "type", "ord", F.lower("name").alias("low_name"))
    # Without the texts: one would come back with each name in it.
    meet = holding if size_of(some, "low_name") <= SENT else holding_words
    found = meet(groups.select("grp", F.lower("text").alias("low")), "low", some, "low_name", keep=["grp", "name", "type", "ord"])
    if most is None:
        return found.select("grp", "name", "type", "ord")
    return found.withColumn("r", F.row_number().over(Window.partitionBy("grp").orderBy("ord"))).filter(F.col("r") <= most).select("grp", "name", "type", "ord")


def relation_type_filter(groups: DataFrame, relation_types: DataFrame, seen_types: DataFrame, most: int = 80) -> DataFrame:
    """(grp, ord, name) of the relation types that go to each group: those with a word of more than three letters in the text, or whose domain or range is a type seen in any group; then the others, ``most`` in all."""
    words = F.filter(F.split(F.replace(F.lower("name"), F.lit("_"), F.lit(" ")), r"\s+"), lambda w: F.length(w) > 3)
    seen = seen_types.select(F.col("type")).distinct()
    typed = relation_types.withColumn("words", words)
    typed = typed.join(seen.select(F.col("type").alias("domain"), F.lit(True).alias("d")), "domain", "left").join(seen.select(F.col("type").alias("range"), F.lit(True).alias("g")), "range", "left")
    typed = cut(typed.select("ord", "name", "words", (F.coalesce("d", F.lit(False)) | F.coalesce("g", F.lit(False))).alias("typed")))
    # Texts are read once for all keywords; a type counts once for a group, however many of its words stand there.
    keywords = typed.filter(~F.col("typed")).select("ord", "name", F.explode(F.array_distinct("words")).alias("word"))
    held = holding(groups.select("grp", F.lower("text").alias("low")), "low", keywords, "word", keep=["grp", "ord", "name"]).distinct()
    held = held.withColumn("r", F.row_number().over(Window.partitionBy("grp").orderBy("ord", "name"))).filter(F.col("r") <= most).drop("r")
    # Beside these a group gets the same rows as all others: of those with a seen type the first ``most``, and of the rest
    # twice as many, for a text that matches fewer than ``most`` of them leaves as many. They are few, so they are a constant.
    first = lambda df, n: df.select("ord", "name").orderBy("ord", "name").limit(n)
    fixed = first(typed.filter("typed"), most).withColumn("m", F.lit(True)).unionByName(first(typed.filter(~F.col("typed")), 2 * most).withColumn("m", F.lit(False)))
    shown = json.dumps([r.asDict() for r in fixed.collect()], ensure_ascii=False)
    kind = f"array<struct<ord:{typed.schema['ord'].dataType.simpleString()},name:string,m:boolean>>"
    every = groups.select("grp", F.explode(F.from_json(F.lit(shown), kind)).alias("t")).select("grp", "t.*")
    # What a keyword matches may be among the rest as well: a match wins.
    both = held.withColumn("m", F.lit(True)).unionByName(every)
    ranked = both.groupBy("grp", "ord", "name").agg(F.max("m").alias("m")).withColumn("r", F.row_number().over(Window.partitionBy("grp").orderBy(F.col("m").desc(), "ord", "name")))
    return ranked.filter(F.col("r") <= most).select("grp", "ord", "name", F.col("m").alias("matched"))


def canonicalize(relations: DataFrame, mapping: DataFrame) -> DataFrame:
    """With predicates replaced by their canonical ones (predicate, canonical) and the open one kept as original_predicate."""
    m = mapping.select(F.col("predicate").alias("_p"), "canonical")
    out = relations.join(m, F.col("predicate") == F.col("_p"), "left").withColumn("original_predicate", F.col("predicate"))
    return out.withColumn("predicate", F.coalesce("canonical", "predicate")).drop("_p", "canonical")


def unmatched_predicates(relations: DataFrame, relation_types: DataFrame) -> DataFrame:
    """Distinct predicates that the schema does not have."""
    return relations.select("predicate").filter("predicate <> ''").distinct().join(relation_types.select(F.col("name").alias("predicate")), "predicate", "left_anti")


def triples(relations: DataFrame, entities: DataFrame, relation_types: DataFrame | None = None, matches: DataFrame | None = None, placeholders: bool = True, threshold: float = RATIO, ancestors: DataFrame | None = None) -> DataFrame:
    """Triples of relations (seq, subject, predicate, object, confidence, evidence) over entities (seq, name, type).

    Ends resolve by the waterfall. Where the predicate's domain (range) is defined and the end's
    own name exists with that type, that entity is taken instead; with ``ancestors`` (type, ancestor, depth: ``ontology.hierarchy``) a
    type below it will do, the nearest one, and stays what it is. Relations with an end that
    nothing matches get a placeholder of type Entity and a confidence of 0.35 at most.
    """
    r = relations.select("seq", strip(F.col("subject")).alias("subject"), "predicate", strip(F.col("object")).alias("object"), "confidence", "evidence").filter("subject <> '' and object <> '' and predicate <> ''")
    if matches is None:
        matches = waterfall(r.select(F.col("subject").alias("query")).unionByName(r.select(F.col("object").alias("query"))), entities, threshold)
    end = lambda p: matches.select(F.col("query").alias(f"{p}_query"), F.col("ename").alias(f"{p}_name"), F.col("etype").alias(f"{p}_type"), F.col("penalty").alias(f"{p}_pen"))
    out = r.join(end("subj"), F.col("subject") == F.col("subj_query"), "left").join(end("obj"), F.col("object") == F.col("obj_query"), "left")
    if relation_types is not None:
        rt = first_of(relation_types.withColumn("seq", F.col("ord")), n=F.col("name")).select(F.col("name").alias("_rt"), "domain", "range")
        own = entities.select(strip(F.col("name")).alias("_n"), F.col("type").alias("_t")).distinct()
        out = out.join(rt, F.col("predicate") == F.col("_rt"), "left")
        own = own.withColumn("_a", F.col("_t"))
        if ancestors is not None:
            above = ancestors.select(F.col("type").alias("_t"), F.col("ancestor").alias("_a"), "depth")
            reached = own.drop("_a").join(above, "_t").unionByName(own.select("_n", "_t", "_a", F.lit(0).alias("depth")))
            own = reached.groupBy("_n", "_a").agg(F.min_by("_t", F.struct("depth", "_t")).alias("_t"))
        out = out.join(own.select(F.col("_n").alias("_sn"), F.col("_t").alias("_st"), F.col("_a").alias("_sa")), (F.col("subject") == F.col("_sn")) & (F.col("domain") == F.col("_sa")), "left")
        out = out.join(own.select(F.col("_n").alias("_on"), F.col("_t").alias("_ot"), F.col("_a").alias("_oa")), (F.col("object") == F.col("_on")) & (F.col("range") == F.col("_oa")), "left")
        both = F.col("subj_name").isNotNull() & F.col("obj_name").isNotNull()
        out = out.withColumn("subj_name", F.when(both, F.coalesce("_sn", "subj_name")).otherwise(F.col("subj_name"))).withColumn("subj_type", F.when(both, F.coalesce("_st", "subj_type")).otherwise(F.col("subj_type")))
        out = out.withColumn("obj_name", F.when(both, F.coalesce("_on", "obj_name")).otherwise(F.col("obj_name"))).withColumn("obj_type", F.when(both, F.coalesce("_ot", "obj_type")).otherwise(F.col("obj_type")))
    matched = F.col("subj_name").isNotNull() & F.col("obj_name").isNotNull()
    if not placeholders:
        out = out.filter(matched)
    held = F.greatest(F.lit(0.0), F.col("confidence") - F.col("subj_pen") - F.col("obj_pen"))
    out = out.select(
        # Placeholders come after all matched triples, so those win where both make one key.
        F.struct((~matched).alias("late"), F.col("seq").alias("at")).alias("seq"),
        F.coalesce("subj_name", "subject").alias("subj_name"), F.when(F.col("subj_name").isNull(), F.lit("Entity")).otherwise(F.col("subj_type")).alias("subj_type"),
        "predicate", F.coalesce("obj_name", "object").alias("obj_name"), F.when(F.col("obj_name").isNull(), F.lit("Entity")).otherwise(F.col("obj_type")).alias("obj_type"),
        F.when(matched, held).otherwise(F.least("confidence", F.lit(0.35))).alias("confidence"), "evidence",
    )
    return triples_first(out).withColumn("seq", F.col("seq.at"))


def fast_triples(relations: DataFrame, entities: DataFrame) -> DataFrame:
    """Triples by name alone: the last entity of a name, type Entity where there is none."""
    last = entities.groupBy("name").agg(F.max_by("type", "seq").alias("type"))
    s, o = (last.select(F.col("name").alias(f"_{p}"), F.col("type").alias(f"{p}_type")) for p in ("subj", "obj"))
    out = relations.join(s, F.col("subject") == F.col("_subj"), "left").join(o, F.col("object") == F.col("_obj"), "left")
    kind = lambda p: F.coalesce(f"{p}_type", F.lit("Entity")).alias(f"{p}_type")
    return out.select("seq", F.col("subject").alias("subj_name"), kind("subj"), "predicate", F.col("object").alias("obj_name"), kind("obj"), "confidence")


def qc_entities(entities: DataFrame, rejected: DataFrame, corrections: DataFrame) -> DataFrame:
    """Without rejected (name, type), types replaced by corrections (name, type, new_type)."""
    kept = entities.join(rejected.select("name", "type").distinct(), ["name", "type"], "left_anti")
    out = kept.join(corrections.select("name", "type", "new_type"), ["name", "type"], "left")
    return out.withColumn("type", F.coalesce("new_type", "type")).drop("new_type").select(*entities.columns)


def qc_relations(relations: DataFrame, rejected: DataFrame) -> DataFrame:
    """Without rejected (subject, predicate, object), compared without white space at the ends."""
    keys = [F.col(c).alias(f"_{c}") for c in ("subject", "predicate", "object")]
    r = rejected.select(*keys).distinct()
    on = [strip(F.col(c)) == F.col(f"_{c}") for c in ("subject", "predicate", "object")]
    return relations.join(r, on, "left_anti")


def qc_triples(found: DataFrame, rejected_entities: DataFrame, rejected_relations: DataFrame, corrections: DataFrame) -> DataFrame:
    """The same for triples: those with a rejected end or relation go, types of ends are corrected."""
    out = found
    for p in ("subj", "obj"):
        bad = rejected_entities.select(F.col("name").alias(f"{p}_name"), F.col("type").alias(f"{p}_type")).distinct()
        fix = corrections.select(F.col("name").alias(f"{p}_name"), F.col("type").alias(f"{p}_type"), F.col("new_type").alias("_new"))
        out = out.join(bad, [f"{p}_name", f"{p}_type"], "left_anti").join(fix, [f"{p}_name", f"{p}_type"], "left").withColumn(f"{p}_type", F.coalesce("_new", f"{p}_type")).drop("_new")
    bad = rejected_relations.select(F.col("subject").alias("subj_name"), "predicate", F.col("object").alias("obj_name")).distinct()
    return out.join(bad, ["subj_name", "predicate", "obj_name"], "left_anti").select(*found.columns)


def final_aggregate(phases: list[DataFrame], kind: str, rejected: DataFrame | None = None, corrections: DataFrame | None = None) -> DataFrame:
    """All phases' entities or relations as one, quality-checked and deduplicated by confidence; earlier phases come first."""
    total = None
    for i, p in enumerate(phases):
        own = p.withColumn("seq", F.col("seq").cast("decimal(38,0)") + F.lit(i).cast("decimal(38,0)") * F.lit(1 << 62).cast("decimal(38,0)"))
        total = own if total is None else total.unionByName(own, allowMissingColumns=True)
    if kind == "entities":
        return entities_final(qc_entities(total, rejected, corrections) if rejected is not None else total)
    return relations_best(qc_relations(total, rejected) if rejected is not None else total)


def with_inverses(found: DataFrame, relation_types: DataFrame) -> DataFrame:
    """An extension: triples and, for predicates with an inverse, the same the other way round."""
    inv = relation_types.filter("inverse is not null").select(F.col("name").alias("predicate"), "inverse")
    back = found.join(inv, "predicate").select("seq", F.col("obj_name").alias("subj_name"), F.col("obj_type").alias("subj_type"), F.col("inverse").alias("predicate"), F.col("subj_name").alias("obj_name"), F.col("subj_type").alias("obj_type"), *(c for c in found.columns if c not in ("seq", "subj_name", "subj_type", "predicate", "obj_name", "obj_type")))
    return found.unionByName(back)


def type_distribution(df: DataFrame, column: str, most: int = 20) -> DataFrame:
    """The most frequent values; ties by value."""
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), column).limit(most)


def low_confidence(df: DataFrame, below: float = 0.8, most: int = 10, order: tuple[str, ...] = ("seq",)) -> DataFrame:
    """The least confident rows below the bound."""
    return df.filter(F.col("confidence") < below).orderBy("confidence", *order).limit(most)


def attribute_stats(df: DataFrame) -> DataFrame:
    """Rows, rows with attributes and attributes in all."""
    n = F.coalesce(F.size(F.map_keys("attributes")), F.lit(0))
    return df.agg(F.count(F.lit(1)).alias("n_entities"), F.sum((n > 0).cast("long")).alias("n_with"), F.sum(n.cast("long")).alias("n_attributes"))


def predicate(c: Column) -> Column:
    """A predicate's words joined by underscores."""
    return F.lower(F.regexp_replace(strip(c), r"(?U)\s+", "_"))
