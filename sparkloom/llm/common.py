"""What the operators of this subpackage share: the shared folder, cut lineage, document columns."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a local one if all runs on this machine (tests), else an error."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="sparkloom-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(found)
    return found


def cut(df: DataFrame) -> DataFrame:
    """The rows of df, written to the shared folder, so that later stages start from there and no lost executor takes them along."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its scheme, as Spark reads it: without one it lies in the default file system, which on a cluster is none of one machine."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = place.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(place).toString()
    return re.sub("^file:/(?=[^/])", "file:///", found)


def fresh(spark: SparkSession, kind: str) -> str:
    """A new path below the shared folder, with its scheme."""
    return qualified(spark, f"{shared_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}")


def written(df: DataFrame, kind: str = "rows") -> tuple[DataFrame, str]:
    """The rows of df as a table in the shared folder, and its path. In loops, this and not ``cut``: a checkpoint keeps the size that was estimated for its plan, and the estimate of a join is a product, so it squares with each round."""
    path = fresh(df.sparkSession, kind)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def drop(spark: SparkSession, path: str | None) -> None:
    """Deletes what was written to a path that nothing reads any more."""
    if path:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(col: str | Column = "text") -> Column:
    """The text; null counts as empty."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


SALTS = 8


def salt(*cols: str) -> Column:
    """The share of its key that a row belongs to."""
    return F.pmod(F.xxhash64(*cols), F.lit(SALTS)).cast("int")


def spread(df: DataFrame) -> DataFrame:
    """df as a side of a join that is shuffled and sorted, never sent whole through the driver. Spark takes an exploded side for as small as what it was exploded from, and Parquet for as small as its files, so either was broadcast at many times the threshold."""
    return df.hint("merge")


def salted(df: DataFrame, salts: int = SALTS) -> DataFrame:
    """df once for each salt, to meet rows whose key may hold any share of all rows."""
    return spread(df.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))))
