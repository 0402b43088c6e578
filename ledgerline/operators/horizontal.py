"""Horizontal bands (M4-M6): one record per output column, the transpose of a band."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions import values as V
from ledgerline.sources.sinks import cells_of
from ledgerline.operators.ordering import number_rows


def _placed(rows: DataFrame, fields: Sequence[str], order_by: Sequence[str | Column] | None,
            position: str) -> DataFrame:
    """Records with their positions; only what is shown or sorted by is written down."""
    if order_by is None:
        return rows
    if all(isinstance(c, str) for c in order_by):
        rows = rows.select(*dict.fromkeys([*fields, *order_by]))
    return number_rows(rows, order_by, position)


def transpose(rows: DataFrame, fields: Sequence[str], order_by: Sequence[str | Column] | None = None,
              position: str = "position") -> DataFrame:
    """M4: long cells ``(field, position, num, text, flag)`` of the records in order.

    Subtotals and totals (M5) and merge spans (M6) are columns or rows of ``rows`` already, so
    they move along. Without ``order_by``, ``rows`` already carry ``position``.
    """
    return cells_of(_placed(rows, fields, order_by, position), [position], fields, column="field")


def transpose_wide(rows: DataFrame, fields: Sequence[str], width: int,
                   order_by: Sequence[str | Column] | None = None,
                   position: str = "position") -> DataFrame:
    """M4 with one output column per record; more than ``width`` records fail rather than drop."""
    placed = _placed(rows, fields, order_by, position)
    checked = F.when(F.col(position) < width, F.col(position)).otherwise(
        F.raise_error(F.lit(f"more than {width} records: use transpose")).cast("bigint"))
    shown = F.inline(F.array(*[
        F.struct(F.lit(i).alias("__no"), F.lit(f).alias("field"),
                 V.display_text(placed, f).alias("__shown")) for i, f in enumerate(fields)]))
    cells = placed.select(checked.alias("__at"), shown)
    wide = cells.groupBy("__no", "field").pivot("__at", list(range(width))).agg(F.max("__shown"))
    return wide.orderBy("__no").select("field", *[F.col(f"`{p}`").alias(f"c{p}") for p in range(width)])
