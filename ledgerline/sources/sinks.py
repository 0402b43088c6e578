"""Long cell tables (K1): rendered rows as typed cells, ready for any file sink."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions import values as V


def _cell(df: DataFrame, name: str, label: str) -> Column:
    column = F.col(name)
    found = V.kind(df, name)
    return F.struct(
        F.lit(name).alias(label),
        (column.cast("double") if found == V.NUMBER else F.lit(None).cast("double")).alias("num"),
        (column.cast("string") if found not in (V.NUMBER, V.BOOLEAN) else F.lit(None).cast("string")).alias("text"),
        (column if found == V.BOOLEAN else F.lit(None).cast("boolean")).alias("flag"))


def cells_of(df: DataFrame, row_key: Sequence[str], columns: Sequence[str], column: str = "column") -> DataFrame:
    """One row per cell: the row key, the column name and the value as number, text or flag."""
    return df.select(*row_key, F.inline(F.array(*[_cell(df, c, column) for c in columns])))


def write_cells(df: DataFrame, path: str, row_key: Sequence[str], columns: Sequence[str],
                file_format: str = "parquet", mode: str = "errorifexists") -> None:
    cells_of(df, row_key, columns).write.format(file_format).mode(mode).save(path)
