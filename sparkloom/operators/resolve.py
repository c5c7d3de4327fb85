"""Entity resolution: a waterfall of joins from exact names to overlapping letters.

Names that a level finds leave before the next, so the costly levels see only what is left, and
only distinct names at that. Levels 1 and 2 are equi-joins. Level 3 meets by rare bigrams of which close
names share one; level 4 reads each string once for all that may stand in it and keeps the first;
level 6 joins distinct sets of letters on their rarest ones. No level is a product of all names. Each level is written before the
next, so the plan stays as long as one level and a lost executor costs that at most; levels after the one that
leaves nothing are not run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.text import normalize_name, strip
from sparkloom.lineage import cut
from sparkloom.operators.dedup import first_of
from sparkloom.operators.occur import first_held, first_holder, holding
from sparkloom.operators.ratio import ratio_join

#: Penalty and bounds of each level.
PENALTY = {"exact": 0.0, "normalized": 0.05, "fuzzy": 0.10, "substring": 0.15, "char_overlap": 0.20}
RATIO, SHORT, OVERLAP = 0.85, 15, 0.7
#: Letters of a key by which sets of letters meet.
TOGETHER = 3


def dictionary(entities: DataFrame) -> DataFrame:
    """Distinct names in order of first appearance: ename, etype, eseq, enorm."""
    names = entities.select(strip(F.col("name")).alias("name"), "type", "seq").filter("name <> ''")
    return first_of(names, name=F.col("name")).select(F.col("name").alias("ename"), F.col("type").alias("etype"), F.col("seq").alias("eseq"), normalize_name(F.col("name")).alias("enorm"))


def exact(queries: DataFrame, names: DataFrame) -> DataFrame:
    """(query, ename) of equal names."""
    return queries.join(names, F.col("query") == F.col("ename")).select("query", "ename", "etype")


def normalized(queries: DataFrame, names: DataFrame) -> DataFrame:
    """(query, ename) of names that are equal once normalised, the first of these."""
    first = first_of(names.withColumn("seq", F.col("eseq")), n=F.col("enorm")).drop("seq")
    return queries.join(first, normalize_name(F.col("query")) == F.col("enorm")).select("query", "ename", "etype")


def _first(found: DataFrame) -> DataFrame:
    best = F.min_by(F.struct("ename", "etype"), "eseq").alias("b")
    return found.groupBy("query").agg(best).select("query", "b.*")


def substring(queries: DataFrame, names: DataFrame) -> DataFrame:
    """(query, ename) where either holds the other, in lower case and of two letters at least; the first name. A task keeps the first name of each query, so what leaves it grows with the queries and not with all that they stand in."""
    q = queries.filter(F.length("query") >= 2).select("query", F.lower("query").alias("low_query"))
    e = names.filter(F.length("ename") >= 2).select("ename", "etype", "eseq", F.lower("ename").alias("low_ename"))
    columns = ["query", "ename", "etype", "eseq"]
    within = first_held(q, "low_query", e, "low_ename", "eseq").select(*columns)
    return _first(within.unionByName(first_holder(e, "low_ename", q, "low_query", "eseq").select(*columns)))


#: Letters of English from rare to common. Any order gives the same names; this one makes few of them meet.
RARE_FIRST = "zqxjkvbpygfwmucldrhsnioate"


def _letters(norm: Column) -> Column:
    """The distinct letters of a name, rare ones first (under other names, the same for all)."""
    renamed = F.translate(norm, RARE_FIRST, "abcdefghijklmnopqrstuvwxyz")
    return F.array_sort(F.array_distinct(F.filter(F.split(renamed, ""), lambda c: c != "")))


def _share(n: Column, m: Column) -> Column:
    """Letters that sets of n and m share at least."""
    return F.ceil(OVERLAP * F.greatest(n, m) - 1e-9).cast("int")


def _keys(letters: Column, shared: Column) -> Column:
    """All combinations of r = min(shared, TOGETHER) letters from the first n - shared + r ones: sets that share so many have one of these in common."""
    r = F.least(shared, F.lit(TOGETHER))
    first = F.slice(letters, F.lit(1), F.size(letters) - shared + r)
    rest = lambda i: F.slice(first, i + 2, F.size(first))
    pairs = F.flatten(F.transform(first, lambda x, i: F.transform(rest(i), lambda y: F.concat(x, y))))
    after = lambda p: F.filter(first, lambda z: z > F.substring(p, -1, 1))
    triples = F.flatten(F.transform(pairs, lambda p: F.transform(after(p), lambda z: F.concat(p, z))))
    return F.when(r == 1, first).when(r == 2, pairs).otherwise(triples)


def letter_sets(queries: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct sets of letters of short queries (_q, asked: the queries), and of short names with the first that has it (_e, b)."""
    short = lambda c: (F.length(c) <= SHORT) & (F.length(c) > 0)
    q = queries.withColumn("_n", normalize_name(F.col("query"))).filter(short("_n")).select("query", _letters(F.col("_n")).alias("_q"))
    e = names.filter(short("enorm")).withColumn("_e", _letters(F.col("enorm")))
    return q, e.groupBy("_e").agg(F.min_by(F.struct("ename", "etype", "eseq"), "eseq").alias("b"))


def set_pairs(q: DataFrame, e: DataFrame) -> DataFrame:
    """Distinct sets _q and _e that meet, once or more."""
    n, m = F.size("_q"), F.size("_e")
    sizes = F.sequence(F.ceil(OVERLAP * n - 1e-9).cast("int"), F.floor(n / OVERLAP + 1e-9).cast("int"))
    # The key has both sizes, so either side cuts its prefix for just what that pair of sizes must share.
    q = q.select("_q", n.alias("_n"), F.explode(sizes).alias("_m")).filter("_m > 0")
    q = q.withColumn("_key", F.explode(_keys(F.col("_q"), _share(F.col("_n"), F.col("_m")))))
    sizes = F.sequence(F.ceil(OVERLAP * m - 1e-9).cast("int"), F.floor(m / OVERLAP + 1e-9).cast("int"))
    e = e.select("_e", "b", m.alias("_m"), F.explode(sizes).alias("_n")).filter("_n > 0")
    e = e.withColumn("_key", F.explode(_keys(F.col("_e"), _share(F.col("_n"), F.col("_m")))))
    return q.join(e, ["_key", "_n", "_m"])


def char_overlap(queries: DataFrame, names: DataFrame) -> DataFrame:
    """(query, ename) of short names that share 0.7 of the letters of the one with more; the first name.

    Names are collapsed to distinct sets of letters with the first name of each, so the work grows with the
    sets and not with the names. Sets of n and m letters that share t of them have r of their first n - t + r and
    m - t + r in common, and t is 0.7 of the larger at least: sets meet by three such letters and both sizes.
    """
    q, e = letter_sets(queries, names)
    shared = F.size(F.array_intersect("_q", "_e"))
    found = set_pairs(q.select("_q").distinct(), e).filter(shared / F.greatest("_n", "_m") >= OVERLAP)
    best = found.groupBy("_q").agg(F.min_by("b", "b.eseq").alias("b"))
    return q.join(best, "_q").select("query", "b.ename", "b.etype")


def fuzzy(queries: DataFrame, names: DataFrame, threshold: float = RATIO) -> DataFrame:
    """(query, ename) with difflib's greatest ratio above the threshold, the first of equals."""
    q = queries.select("query", normalize_name(F.col("query")).alias("qnorm"))
    found = ratio_join(q, "qnorm", names.select("eseq", "ename", "etype", "enorm"), "enorm", threshold)
    best = F.min_by(F.struct("ename", "etype", "ratio"), F.struct(-F.col("ratio"), F.col("eseq"))).alias("b")
    return found.groupBy("query").agg(best).select("query", "b.*")


LEVELS = {"exact": exact, "normalized": normalized, "fuzzy": fuzzy, "substring": substring, "char_overlap": char_overlap}


def waterfall(queries: DataFrame, entities: DataFrame, threshold: float = RATIO) -> DataFrame:
    """For each distinct query the entity name it resolves to, by the first level that finds one: query, ename, etype, penalty, method; null where none does."""
    # Each level's rest is the next one's input, twice; without a cut the plan doubles from level to level.
    names = cut(dictionary(entities))
    left = queries.select(strip(F.col("query")).alias("query")).filter("query <> ''").distinct()
    found = None
    for method, level in LEVELS.items():
        hits = level(left, names, threshold) if level is fuzzy else level(left, names)
        hit = cut(hits.select("query", "ename", "etype", F.lit(PENALTY[method]).alias("penalty"), F.lit(method).alias("method")))
        found = hit if found is None else found.unionByName(hit)
        left = cut(left.join(hit, "query", "left_anti"))
        if not left.limit(1).count():
            return found
    none = left.select("query", F.lit(None).cast("string").alias("ename"), F.lit(None).cast("string").alias("etype"), F.lit(0.0).alias("penalty"), F.lit("no_match").alias("method"))
    return found.unionByName(none)


def entity_match(a: Column, b: Column) -> Column:
    """Whether two names are close: equal once normalised, one in the other, or three edits apart at most when short."""
    na, nb = normalize_name(a), normalize_name(b)
    inside = ((F.length(na) >= 2) & F.contains(nb, na)) | ((F.length(nb) >= 2) & F.contains(na, nb))
    near = (F.length(na) <= 20) & (F.length(nb) <= 20) & (F.levenshtein(na, nb, 3) >= 0)
    return (na != "") & (nb != "") & ((na == nb) | inside | near)


#: Names up to so many letters are close within so many edits.
CLOSE, EDITS = 20, 3


def within_edits(norms: DataFrame) -> DataFrame:
    """(x, y) of different strings n of at most ``CLOSE`` letters that are ``EDITS`` edits apart at most, in both orders.

    A string cut into EDITS + 1 pieces keeps one of them whole under so many edits, shifted by no more than these; so
    strings meet by length, number and letters of a piece, and no two are compared that share none.
    """
    short = norms.filter(F.length("n") <= CLOSE).select("n", F.length("n").alias("size"))
    pieces = EDITS + 1
    start = lambda size, i: F.floor(i * size / pieces).cast("int")
    cuts = short.select(F.col("n").alias("y"), "size", F.explode(F.sequence(F.lit(0), F.lit(EDITS))).alias("i"))
    cuts = cuts.select("y", "size", "i", F.substring(F.col("y"), start(F.col("size"), F.col("i")) + 1, start(F.col("size"), F.col("i") + 1) - start(F.col("size"), F.col("i"))).alias("piece"))
    asked = short.select(F.col("n").alias("x"), F.col("size").alias("own"), F.explode(F.sequence(F.greatest(F.lit(1), F.col("size") - EDITS), F.col("size") + EDITS)).alias("size"))
    asked = asked.select("x", "own", "size", F.explode(F.sequence(F.lit(0), F.lit(EDITS))).alias("i"))
    at, n = start(F.col("size"), F.col("i")), start(F.col("size"), F.col("i") + 1) - start(F.col("size"), F.col("i"))
    asked = asked.select("x", "own", "size", "i", n.alias("n"), F.explode(F.sequence(at - EDITS, at + EDITS)).alias("at")).filter("at >= 0 AND at + n <= own")
    asked = asked.select("x", "size", "i", F.substring(F.col("x"), F.col("at") + 1, F.col("n")).alias("piece")).distinct()
    return asked.join(cuts, ["size", "i", "piece"]).filter((F.col("x") != F.col("y")) & (F.levenshtein("x", "y", EDITS) >= 0)).select("x", "y").distinct()


def match_pairs(names: DataFrame) -> DataFrame:
    """(a, b) of all names (name) that ``entity_match`` holds for, a before b: by equal normalised names, by containment and by edits, each a join on what such names share."""
    own = names.select("name").distinct().select("name", normalize_name(F.col("name")).alias("n")).filter("n <> ''")
    norms = cut(own.select("n").distinct())
    inside = holding(norms.select(F.col("n").alias("x")), "x", norms.filter(F.length("n") >= 2).select(F.col("n").alias("y")), "y")
    pairs = inside.unionByName(inside.select(F.col("y").alias("x"), F.col("x").alias("y"))).unionByName(within_edits(norms)).unionByName(norms.select(F.col("n").alias("x"), F.col("n").alias("y"))).distinct()
    a, b = own.select(F.col("name").alias("a"), F.col("n").alias("x")), own.select(F.col("name").alias("b"), F.col("n").alias("y"))
    return pairs.join(a, "x").join(b, "y").filter("a < b").select("a", "b")
