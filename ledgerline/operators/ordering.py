"""Row order: text order of groups (O1, X5), first rows (O3), headers (O4), positions (M3)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions import values as V
from ledgerline.session import write_down


def group_keys(df: DataFrame, group: str, typed: bool = False) -> list[Column]:
    """Groups sort by their text, null as ``null``; the value itself keeps groups together."""
    return [F.col(group)] if typed else [V.null_text(df, group), F.col(group)]


def tie_break(df: DataFrame, columns: Sequence[str]) -> list[Column]:
    """A last sort key for orders that may have ties: a hash of the row.

    Equal sort keys fall into one range and so into one task; with the hash, the rows of a hot
    group spread over many, and come out in the same order every time.
    """
    hashable = [c for c in columns if "map<" not in df.schema[c].dataType.simpleString()]
    return [F.xxhash64(*hashable)] if hashable else []


def distinct_first(df: DataFrame, keys: Sequence[str], order_by: Sequence[str | Column]) -> DataFrame:
    """O3: the first row of every key tuple; null is a key value of its own.

    Filtering on the first row number lets Spark keep one row per key in every task before the
    shuffle, so a hot key does not gather its rows anywhere.
    """
    order = Window.partitionBy(*keys).orderBy(*order_by)
    return df.withColumn("__first", F.row_number().over(order)).filter("__first = 1").drop("__first")


def header_values(df: DataFrame, column: str) -> DataFrame:
    """Distinct values in typed order, null first."""
    return df.select(column).distinct().orderBy(F.col(column).asc_nulls_first())


def preview(df: DataFrame, order_by: Sequence[str | Column], limit: int = 20) -> DataFrame:
    """The first rows under an explicit order."""
    return df.orderBy(*order_by).limit(limit)


def number_rows(df: DataFrame, order_by: Sequence[str | Column], name: str = "row_no") -> DataFrame:
    """M3: dense positions from 0 in sort order, without gathering the rows in one task.

    Rows are sorted by range and written once; a row's position is the count of all earlier
    parts, one number per part, plus its place within its own part. The write pins the parts:
    recomputed ones could cut the ranges elsewhere.
    """
    pinned = write_down(
        df.orderBy(*order_by, *tie_break(df, df.columns)).select("*", F.spark_partition_id().alias("__part"),
                                     F.monotonically_increasing_id().alias("__at")))
    in_part = F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = {r["__part"]: r["n"] for r in pinned.groupBy("__part").agg(F.count(F.lit(1)).alias("n")).collect()}
    offsets, seen = [], 0
    for part in sorted(sizes):
        offsets.append((part, seen))
        seen += sizes[part]
    # One row per part: bounded by the number of tasks, not by the data.
    starts = df.sparkSession.createDataFrame(offsets, "__part int, __start bigint")
    return (pinned.join(starts, "__part").withColumn(name, F.col("__start") + in_part)
            .drop("__part", "__at", "__start"))
