"""Where the queries over the driver tables are registered, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from folioworks.session import bound_batches

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


class Tables:
    """The driver's tables as attributes. What Spark sends to Python at once is bounded from then on."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        bound_batches(spark)
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


def query(sql: str | None = None):
    """Registers a function of Tables under its name."""

    def register(make: Callable[[Tables], DataFrame]):
        QUERIES[make.__name__] = lambda spark, sf_dir: make(Tables(spark, sf_dir))
        if sql:
            ORACLE_SQL[make.__name__] = sql
        return make

    return register
