"""Around the graph: change detection, strategy choice, token accounts, breakers, compaction, progress, history."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Extensions of narrative formats.
NARRATIVE = (".txt", ".md", ".docx", ".pdf", ".html", ".htm")


def manifest_diff(manifest: DataFrame, current: DataFrame) -> DataFrame:
    """(path, state): unchanged, added, modified or deleted, by content_hash."""
    m = manifest.select("path", F.col("content_hash").alias("_old"), F.lit(True).alias("_m"))
    c = current.select("path", F.col("content_hash").alias("_new"), F.lit(True).alias("_c"))
    state = F.when(F.col("_m").isNull(), "added").when(F.col("_c").isNull(), "deleted").when(F.col("_old").eqNullSafe(F.col("_new")), "unchanged").otherwise("modified")
    return m.join(c, "path", "full_outer").select("path", state.alias("state"))


def doc_hash(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, content_hash, size): MD5 and length of the bytes."""
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    return docs.select("doc_id", F.md5(body).alias("content_hash"), F.octet_length(body).cast("long").alias("size"))


def unload(docs: DataFrame, gone: DataFrame, key: str = "doc_id") -> DataFrame:
    return docs.join(gone.select(key).distinct(), key, "left_anti")


def classify(docs: DataFrame) -> DataFrame:
    """docs (is_tabular, size, ext) with route: llm or programmatic."""
    llm = F.when(F.coalesce("is_tabular", F.lit(False)), False).when(F.coalesce("size", F.lit(0)) < 500, True).otherwise(F.coalesce("ext", F.lit("")).isin(*NARRATIVE))
    return docs.withColumn("route", F.when(llm, "llm").otherwise("programmatic"))


def corpus_stats(docs: DataFrame) -> DataFrame:
    """One row: documents, documents with text, characters, mean, share of tables, formats; docs: text, is_tabular, ext."""
    some = F.length(F.trim(F.coalesce("text", F.lit("")), F.lit(" \t\n\x0b\x0c\r"))) > 0
    chars = F.when(some, F.length("text").cast("long"))
    return docs.agg(
        F.count(F.lit(1)).alias("n_docs"), F.count(chars).alias("n_text"), F.coalesce(F.sum(chars), F.lit(0)).alias("total_chars"),
        F.coalesce(F.sum(chars) / F.count(chars), F.lit(0.0)).alias("avg_chars"), F.count(F.when(some & F.coalesce("is_tabular", F.lit(False)), 1)).alias("n_tabular"),
        F.array_join(F.array_sort(F.collect_set("ext")), ", ").alias("formats"),
    )


def strategy(stats: DataFrame) -> DataFrame:
    """stats with strategy: code, fast or standard."""
    kind = (
        F.when(F.col("n_text") == 0, "standard").when(F.col("n_tabular") > 0.5 * F.col("n_docs"), "code")
        .when((F.col("n_docs") <= 5) & (F.col("avg_chars") < 2000), "fast").when((F.col("avg_chars") < 500) & (F.col("n_docs") <= 20), "fast").otherwise("standard")
    )
    return stats.withColumn("strategy", kind)


def ontology_mode(stats: DataFrame, n_nouns: DataFrame | None = None) -> DataFrame:
    """stats with mode, by number and length of documents and nouns (n_nouns: one row, n)."""
    out = stats.join(F.broadcast(n_nouns.select(F.col("n").alias("_nouns")))) if n_nouns is not None else stats.withColumn("_nouns", F.lit(0))
    density = F.col("_nouns") / F.greatest(F.lit(1.0), F.col("total_chars") / 100)
    mode = (
        F.when((F.col("n_text") == 0) | ((F.col("n_text") == 1) & (F.col("avg_chars") < 5000)), "text-to-ontology")
        .when((density > 5) & (F.col("n_text") >= 3), "affinity-clustering").when((F.col("avg_chars") > 10000) & (F.col("n_text") <= 3), "ht-relation-to-ontology")
        .when(F.col("avg_chars") > 3000, "relation-to-ontology").otherwise("text-to-ontology")
    )
    return out.withColumn("mode", mode).drop("_nouns")


def token_usage(events: DataFrame) -> DataFrame:
    """(agent, tokens): sum of rises of each agent's counter; events: agent, at, counter."""
    w = Window.partitionBy("agent").orderBy("at")
    rise = F.greatest(F.lit(0), F.col("counter") - F.coalesce(F.lag("counter").over(w), F.lit(0)))
    return events.withColumn("rise", rise).groupBy("agent").agg(F.sum("rise").alias("tokens"))


def circuit_breaker(calls: DataFrame, most: int = 3) -> DataFrame:
    """(agent, at) of each agent's first call that is the ``most``-th failure in a row; calls: agent, at, failed. Gaps and islands: successes number the runs."""
    w = Window.partitionBy("agent").orderBy("at")
    runs = calls.withColumn("run", F.sum(F.when(F.col("failed"), 0).otherwise(1)).over(w))
    nth = F.row_number().over(Window.partitionBy("agent", "run").orderBy("at"))
    return runs.filter("failed").withColumn("nth", nth).filter(F.col("nth") == most).groupBy("agent").agg(F.min("at").alias("at"))


def compact(messages: DataFrame, most: int = 50) -> DataFrame:
    """messages (agent, seq, role, content) of which long conversations keep their system messages, a summary and the last ones, ``most`` in all.

    The summary is a row of role system with null seq: the first ten that were dropped, and how many.
    """
    own = Window.partitionBy("agent")
    m = messages.withColumn("n", F.count(F.lit(1)).over(own)).withColumn("n_system", F.count(F.when(F.col("role") == "system", 1)).over(own))
    back = F.row_number().over(Window.partitionBy("agent", F.col("role") == "system").orderBy(F.col("seq").desc()))
    m = m.withColumn("back", back).withColumn("keep", F.greatest(F.lit(1), F.lit(most) - F.col("n_system") - 1))
    kept = (F.col("n") <= most) | (F.col("role") == "system") | (F.col("back") <= F.col("keep"))
    dropped = m.filter(~kept).withColumn("first", F.row_number().over(Window.partitionBy("agent").orderBy("seq")))
    line = F.concat(F.lit("- ["), F.col("role"), F.lit("] "), F.replace(F.substring("content", 1, 200), F.lit("\n"), F.lit(" ")), F.lit("..."))
    shown = F.when((F.col("first") <= 10) & F.col("role").isin("user", "assistant"), F.struct("seq", line.alias("line")))
    text = F.concat_ws("\n", F.lit("[Context Summary - earlier conversation]"), F.lit(""), F.array_join(F.transform(F.array_sort(F.collect_list(shown)), lambda x: x["line"]), "\n"), F.concat(F.lit("\n["), F.count(F.lit(1)).cast("string"), F.lit(" total earlier messages summarized]")))
    summary = dropped.groupBy("agent").agg(text.alias("content")).select("agent", F.lit(None).cast(messages.schema["seq"].dataType).alias("seq"), F.lit("system").alias("role"), "content")
    return m.filter(kept).select("agent", "seq", "role", "content").unionByName(summary)


def phase_progress(phases: DataFrame, cap: float = 98.0) -> DataFrame:
    """(ord, phase, done_share): running share of the weights in percent, capped; phases: ord, phase, weight. A workflow has a handful of phases."""
    w = Window.partitionBy(F.lit(0)).orderBy("ord")
    share = 100.0 * F.sum("weight").over(w) / F.sum("weight").over(Window.partitionBy(F.lit(0)))
    return phases.select("ord", "phase", F.least(share, F.lit(cap)).alias("done_share"))


def eta(elapsed, done):
    """Seconds left, from those gone and the share done."""
    return F.when(done > 0, elapsed / done * (1 - done))


def history(builds: DataFrame, n: int = 10) -> DataFrame:
    """The latest builds (build_id, at, ...)."""
    return builds.orderBy(F.col("at").desc(), F.col("build_id").desc()).limit(n)
