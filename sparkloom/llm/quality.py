"""Quality rules whose thresholds adapt to each language and source [native].

One pass over the texts makes a small row of features for each document, which is written to
the shared folder. Mergeable quantile sketches (``approx_percentile``: partial sketches on the map side, merged after
the shuffle) over those rows give the quartiles of each feature for each (lang, source),
each lang and the whole table. A document fails where a feature lies beyond the Tukey
fence of its own group; groups of fewer than ``min_group`` documents take the fence of
their language, then that of the table. Only feature rows are shuffled, never texts.

Null texts count as empty, null lang or source are groups of their own, an empty table
gives an empty result, extra columns are left alone, repeated rows are judged one by one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.common import salt, salted, table, whole_text, written

SPACE = r"[\x20\x09-\x0D]+"
SPACES = (" ", "\t", "\n", "\x0b", "\x0c", "\r")
SYMBOLS = "#*$%&|<>"

#: Feature: share beyond which a group's fence may lie at the lowest. A fence that adapts to a
#: group of spotless documents would otherwise reject the first one with any symbol in it.
FLOORS = {"symbol_share": 0.10, "dup_line_share": 0.50, "repeat_share": 0.30}
FEATURES = (*FLOORS, "word_length")
#: Bounds of the group's fence for the mean word length: never narrower than these.
WORD_LENGTH = (2.0, 15.0)
ACCURACY = 1000
#: Pairs of language and source whose fences are sent to all tasks; more are joined over salted keys.
GROUPS = 100_000


def _length_without(text: Column, chars) -> Column:
    for c in chars:
        text = F.replace(text, F.lit(c), F.lit(""))
    return F.length(text).cast("long")


def features(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed and _n_lines, the lines with a word (0 for a text of one line); texts themselves are not needed further."""
    text = whole_text(text_col)
    out = docs.withColumn("_text", text).withColumn("_words", F.filter(F.split("_text", SPACE), lambda w: w != ""))
    out = out.withColumn("n_words", F.size("_words").cast("long"))
    out = out.withColumn("word_chars", _length_without(F.col("_text"), SPACES))
    out = out.withColumn("n_symbols", F.length("_text").cast("long") - _length_without(F.col("_text"), SYMBOLS))
    lines = F.filter(F.split("_text", "\n"), lambda x: F.length(F.trim(x, F.lit("".join(SPACES)))) > 0)
    out = out.withColumn("_lines", F.when(F.contains("_text", F.lit("\n")), lines).otherwise(F.array().cast("array<string>")))
    out = out.withColumn("_n_lines", F.size("_lines").cast("long"))
    out = out.withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
    # Windows are hashes; words are compared where hashes are equal.
    ids = F.transform(F.sequence(F.lit(0), (F.col("n_words") - 3).cast("int")), lambda i: F.xxhash64(F.get("_words", i), F.get("_words", i + 1), F.get("_words", i + 2)))
    out = out.withColumn("_ids", F.when(F.col("n_words") < 4, F.array().cast("array<bigint>")).otherwise(ids))
    out = out.withColumn("_any", F.size("_ids") > F.size(F.array_distinct("_ids")))
    # In order of their hashes, then places: an equal neighbour makes a window repeated.
    empty = F.array().cast("array<struct<h:bigint,i:int>>")
    out = out.withColumn("_sorted", F.when(F.col("_any"), F.sort_array(F.transform("_ids", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).otherwise(empty))
    word = lambda s, k: F.get("_words", s["i"] + k)
    equal = lambda s, t: F.coalesce((s["h"] == t["h"]) & (word(s, 0) == word(t, 0)) & (word(s, 1) == word(t, 1)) & (word(s, 2) == word(t, 2)), F.lit(False))
    out = out.withColumn("_places", F.sort_array(F.transform(F.filter("_sorted", lambda s, i: equal(s, F.get("_sorted", i + 1)) | equal(s, F.get("_sorted", i - 1))), lambda s: s["i"])))
    # Each place covers three words, less those that the next place covers as well.
    covered = F.aggregate(F.transform("_places", lambda p, i: F.least(F.lit(3), F.coalesce(F.get("_places", i + 1) - p, F.lit(3)))), F.lit(0).cast("long"), lambda a, x: a + x)
    out = out.withColumn("n_repeat_words", covered)
    out = out.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    return out.drop("_text", "_words", "_lines", "_ids", "_any", "_sorted", "_places")


def _measured(df: DataFrame) -> DataFrame:
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b)), F.lit(0.0))
    return (
        df.withColumn("symbol_share", share("n_symbols", "word_chars"))
        .withColumn("dup_line_share", share("n_dup_lines", "_n_lines"))
        .withColumn("repeat_share", share("n_repeat_words", "n_words"))
        .withColumn("word_length", share("word_chars", "n_words"))
    )


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", min_group: int = 30, reach: float = 3.0, rest: bool = False) -> DataFrame:
    """A row for each row of docs: id, the features, base_failed, the group's fences and kept; with ``rest`` also all columns of docs, as a struct. What one pass over the texts has found is written, and the sketches read features alone, so no text is shuffled or read twice."""
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("rest")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("_lang"), F.col(source_col).alias("_source"), *([whole] if rest else []))
    rows, _ = written(_measured(features(rows).drop("text")), "quality")
    limits = fences(rows, min_group, reach)
    keys = ["_lang", "_source"]
    limits = limits.withColumnsRenamed({k: "_of" + k for k in keys})
    same = F.col("_lang").eqNullSafe(F.col("_of_lang")) & F.col("_source").eqNullSafe(F.col("_of_source"))
    if limits.limit(GROUPS + 1).count() <= GROUPS:
        # A row of a few hundred bytes for each (lang, source), counted before it is sent to all tasks: no text moves.
        out = rows.join(F.broadcast(limits), same, "left")
    else:
        out = rows.withColumn("salt", salt("doc_id", "n_words", "word_chars")).join(salted(limits).withColumnRenamed("salt", "_salt"), same & (F.col("salt") == F.col("_salt")), "left").drop("salt")
    ok = F.col("word_length") >= F.col("_min_word_length")
    for f in FEATURES:
        ok = ok & (F.col(f) <= F.col(f"max_{f}"))
    out = out.withColumn("kept", ~F.col("base_failed") & F.coalesce(ok, F.lit(True)))
    return out.drop(*(c for c in out.columns if c.startswith("_")))


def fences(rows: DataFrame, min_group: int, reach: float) -> DataFrame:
    """_lang, _source, max_ of each feature and _min_word_length for every (lang, source) of rows: by its own quartiles, those of its language where it has fewer than ``min_group`` sound documents, those of the table where the language has."""
    # Documents that the base rules reject would widen the fences of the rest.
    sound = lambda f: F.when(~F.col("base_failed"), F.col(f))
    quartiles = lambda f: F.percentile_approx(sound(f), F.array(F.lit(0.25), F.lit(0.75)), ACCURACY)

    def sketched(prefix: str, *keys: str) -> DataFrame:
        groups = rows.groupBy(*keys).agg(F.count(sound("n_words")).alias("_n"), *(quartiles(f).alias(f"{prefix}_{f}") for f in FEATURES))
        return groups.select(*keys, *(F.when(F.col("_n") >= min_group, F.col(f"{prefix}_{f}")).alias(f"{prefix}_{f}") for f in FEATURES))

    groups = sketched("_own", "_lang", "_source")
    tongues = sketched("_tongue", "_lang").withColumnRenamed("_lang", "_of_lang")
    at_all = rows.agg(*(quartiles(f).alias(f) for f in FEATURES)).first()  # one row
    out = groups.join(tongues, F.col("_lang").eqNullSafe(F.col("_of_lang")), "left")
    limits = []
    for f in FEATURES:
        q = F.coalesce(F.col(f"_own_{f}"), F.col(f"_tongue_{f}"), F.array(*map(F.lit, at_all[f] or [0.0, 0.0])))
        spread = q[1] - q[0]
        limits.append(F.greatest(F.lit(FLOORS.get(f, WORD_LENGTH[1])), q[1] + reach * spread).alias(f"max_{f}"))
        if f not in FLOORS:
            limits.append(F.least(F.lit(WORD_LENGTH[0]), q[0] - reach * spread).alias(f"_min_{f}"))
    return out.select("_lang", "_source", *limits)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))
