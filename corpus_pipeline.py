"""From documents to packed training sequences: five stages, each an operator of sparkloom.llm.

Each stage takes all rows that the one before it kept and returns the columns of documents, the
last one pieces of sequences. Between stages rows are written as Parquet in the shared folder
and read again, so a lost executor costs a stage's own work at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.common import drop, fresh, spread, table
from sparkloom.llm.jaccard import jaccard_join
from sparkloom.llm.packing import best_fit
from sparkloom.llm.quality import quality_rules
from sparkloom.llm.secrets import redact
from sparkloom.llm.suffixes import suffix_dedup


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the quality rules reject; each row is judged by itself."""
    return quality_rules(docs, rest=True).filter("kept").select("rest.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class, that with the smallest doc_id; of rows that repeat its id and text the smallest one. Rows of one id and different texts are different documents. Rows without an id are not compared and stay."""
    own = F.xxhash64(F.coalesce("text", F.lit("")))
    first = jaccard_join(docs.filter(F.col("doc_id").isNotNull())).filter("first").groupBy(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).agg(F.count(F.lit(1)).alias("_rows"))
    kept = docs.join(spread(first), (F.col("doc_id") == F.col("_id")) & (own == F.col("_hash")))
    once, again = kept.filter("_rows = 1").select(*docs.columns), kept.filter("_rows > 1")
    row = F.struct(*docs.columns)
    again = again.groupBy("_id", "_hash").agg(F.min_by(row, F.to_json(row)).alias("_row")).select("_row.*")
    return once.unionByName(again).unionByName(docs.filter(F.col("doc_id").isNull()))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that an earlier document has; characters stay whole."""
    found = suffix_dedup(docs, whole_chars=True).withColumn("text", F.decode("kept", "utf-8"))
    rest = [F.col("rest")[c].alias(c) for c in docs.columns if c not in ("doc_id", "text", "n_chars")]
    return found.select("doc_id", "text", F.length("text").cast("long").alias("n_chars"), *rest).select(*docs.columns)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with secrets masked."""
    return redact(docs).withColumn("n_chars", F.length("text").cast("long"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequences."""
    return best_fit(docs, added_tokens=True)


STAGES = [
    ("quality rules", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("secret scans", secrets),
    ("best-fit packing", packing),
]

#: Quantile sketches, MinHash, inferred grammars and tokens are beyond SQL; tests hold stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. What a stage has read is deleted once it is written."""
    docs, path = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs, done, path = stage(spark, docs, sf_dir), path, fresh(spark, "stage-" + name.replace(" ", "-"))
        docs.write.parquet(path)
        drop(spark, done)
        docs = spark.read.parquet(path)
    return docs
