"""The registry of reports and access to the tables they read."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


class Tables:
    """The tables of one folder as attributes, read when asked for."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


@dataclass(frozen=True)
class Report:
    build: Callable[[Tables], DataFrame]
    sql: str | None = None

    def __call__(self, spark: SparkSession, folder: str) -> DataFrame:
        return self.build(Tables(spark, folder))


REPORTS: dict[str, Report] = {}


def report(sql: str | None = None, name: str | None = None):
    """Registers a function of :class:`Tables`, by default under its own name."""
    def register(build: Callable[[Tables], DataFrame]):
        REPORTS[name or build.__name__] = Report(build, sql)
        return build
    return register


def rounded(df: DataFrame, *columns: str, digits: int = 2) -> DataFrame:
    """Doubles are added up in no fixed order, so results are compared rounded."""
    return df.withColumns({c: F.round(c, digits) for c in columns})


def nulled(df: DataFrame, column: str, value, into: str | None = None) -> DataFrame:
    """The tables hold few nulls; this makes one value of a column null."""
    return df.withColumn(into or column, F.nullif(F.col(column), F.lit(value)))
