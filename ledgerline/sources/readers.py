"""Readers by source type (S1-S4, S8) behind an open registry."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from typing import Any
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.functions.values import trimmed
from ledgerline.sources.schema import Field, typed_projection
from ledgerline.sources.workbook import workbook_rows


def _texts(df: DataFrame) -> DataFrame:
    """Cells trimmed, empty ones null, header names trimmed."""
    return df.select(*[F.nullif(trimmed(F.col(f"`{c}`")), F.lit("")).alias(c.strip()) for c in df.columns])


def _by_header(spark: SparkSession, path: str | list[str]) -> list[list[str]]:
    """The files under ``path`` grouped by their first lines that are not blank, which are read by tasks."""
    lines = spark.read.text(path).select(trimmed(F.col("value")).alias("value"), F.col("_metadata.file_path").alias("file"),
                                         F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("no"))
    lines = lines.where("at = 0 and value != ''")
    first = lines.groupBy("file").agg(F.min_by("value", "no").alias("header"))
    found = first.groupBy("header").agg(F.sort_array(F.collect_list("file")).alias("files")).orderBy("header").collect()
    return [[unquote(f) for f in r["files"]] for r in found]


def scan_csv(spark: SparkSession, path: str | list[str], fields: Sequence[Field] | None = None,
             quote: str = '"', on_error: str = "raise") -> DataFrame:
    """Columns by header name, short lines and empty cells null, unreadable numbers fail.

    Blank lines do not count. Files with unlike headers are read apart and put together by name; a column that a
    file lacks is null there, and a file whose header is not that of its group fails. ``quote=""`` takes quote characters as part of the text. Without ``fields`` every column is text.
    """
    reader = spark.read.option("header", True).option("quote", quote).option("mode", "PERMISSIVE").option("enforceSchema", False)
    groups = _by_header(spark, path)
    parts = [_texts(reader.csv(files)) for files in groups] if len(groups) > 1 else [_texts(reader.csv(path))]
    raw = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return raw if fields is None else typed_projection(raw, fields, on_error)


def scan_jdbc(spark: SparkSession, url: str, table: str, fields: Sequence[Field] | None = None,
              options: Mapping[str, Any] | None = None, partition: tuple | None = None,
              on_error: str = "raise") -> DataFrame:
    """A table, or a text starting with SELECT, of a database.

    ``partition`` is ``(column, parts)`` or ``(column, parts, lower, upper)``: that many tasks read
    a range each. Bounds that are not given are asked from the database, which is one row. Without
    it a single task reads everything, which only suits small tables.
    """
    source = f"({table}) q" if table.lstrip().lower().startswith("select") else table

    def reader(dbtable: str):
        base = spark.read.format("jdbc").option("url", url).options(**(options or {}))
        return base.option("dbtable", dbtable)

    scan = reader(source)
    if partition:
        column, parts, *bounds = partition
        if not bounds:
            ends = reader(f"(SELECT MIN({column}) AS low, MAX({column}) AS high FROM {source}) b").load()
            bounds = list(ends.first())
        if None not in bounds:
            scan = (scan.option("partitionColumn", column).option("numPartitions", str(parts))
                    .option("lowerBound", str(bounds[0])).option("upperBound", str(bounds[1])))
    df = scan.load()
    if fields is None:
        return df
    by_lower = {c.lower(): c for c in df.columns}
    named = df.select(*[F.col(by_lower[f.name.lower()]).alias(f.name) for f in fields if f.name.lower() in by_lower])
    return typed_projection(named, fields, on_error)


def sql_dataset(spark: SparkSession, text: str, tables: Mapping[str, DataFrame],
                params: Mapping[str, Any] | None = None) -> DataFrame:
    """S3: a SELECT over the given frames; parameters are bound by name, never pasted in."""
    if not text.lstrip().lower().startswith("select"):
        raise ValueError("a dataset text starts with SELECT")
    views = {name: f"v_{uuid.uuid4().hex}" for name in tables}
    for name, view in views.items():
        tables[name].createOrReplaceTempView(view)
    try:  # the plan holds the frames, so the caller's views of these names stay as they are
        named = ", ".join(f"`{name}` AS (SELECT * FROM {view})" for name, view in views.items())
        return spark.sql(f"WITH {named} {text}" if named else text, args=dict(params or {}))
    finally:
        for view in views.values():
            spark.catalog.dropTempView(view)


def scan_workbooks(spark: SparkSession, path: str, fields: Sequence[Field], sheet_index: int = 0,
                   header_row: int = 0, on_error: str = "raise", keep_origin: bool = False) -> DataFrame:
    """The rows of every workbook in a folder, typed as declared."""
    raw = workbook_rows(spark, path, [f.name for f in fields], sheet_index, header_row)
    typed = list(fields)
    if keep_origin:
        typed = [Field("file"), Field("row_ord", "NUMBER"), *fields]
    return typed_projection(raw, typed, on_error)


def _read_csv(spark, options, fields):
    return scan_csv(spark, fields=fields, **options)


def _read_jdbc(spark, options, fields):
    return scan_jdbc(spark, fields=fields, **options)


def _read_workbooks(spark, options, fields):
    return scan_workbooks(spark, fields=fields, **options)


def _read_files(file_format: str):
    def read(spark, options, fields):
        rest = dict(options)
        df = spark.read.format(file_format).options(**rest.pop("options", {})).load(rest.pop("path"))
        return typed_projection(df, fields) if fields else df
    return read


SOURCES: dict[str, Callable[[SparkSession, Mapping[str, Any], Sequence[Field]], DataFrame]] = {
    "CSV": _read_csv, "DB": _read_jdbc, "EXCEL": _read_workbooks,
    "PARQUET": _read_files("parquet"), "ORC": _read_files("orc"), "JSON": _read_files("json"),
}


def register_source(kind: str, read: Callable[[SparkSession, Mapping[str, Any], Sequence[Field]], DataFrame]) -> None:
    SOURCES[kind] = read


def read_source(spark: SparkSession, kind: str, options: Mapping[str, Any], fields: Sequence[Field]) -> DataFrame:
    if kind not in SOURCES:
        raise ValueError(f"no reader for source type {kind!r}; known: {sorted(SOURCES)}")
    return SOURCES[kind](spark, options, fields)
