"""Registration of queries with their SQL, and tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Queries(dict):
    """name -> (query, SQL or None)."""

    def add(self, sql: str | None = None):
        def register(f: Query) -> Query:
            self[f.__name__] = (f, sql)
            return f

        return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
