"""Dictionary mapping (F6): the label of a code, or the code itself where there is none."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.functions import values as V


def dictionary(df: DataFrame, entries: Sequence[tuple]) -> DataFrame:
    """A dictionary of ``(code, label)`` or ``(code, label, parent)``; later duplicates win."""
    last = {str(e[0]): (str(e[0]), e[1], e[2] if len(e) > 2 else None) for e in entries}
    return df.sparkSession.createDataFrame(list(last.values()), "code string, label string, parent string")


def map_codes(df: DataFrame, column: str, codes: DataFrame | Sequence[tuple] | Mapping | None,
              into: str, latest: str | None = None) -> DataFrame:
    """adds ``into`` with the label of ``column``'s code, else its text; null stays null.

    Of a frame's rows with one code, that of the greatest ``latest`` column counts (without one, of the
    greatest label). The frame is joined from the left, so Spark broadcasts it
    where its measured size allows and splits hot codes where not. An unknown dictionary (None)
    leaves every value.
    """
    raw = F.col(column)
    shown = F.when(raw.isNotNull(), V.display_text(df, column))
    if codes is None:
        return df.withColumn(into, shown)
    if isinstance(codes, Mapping):
        codes = list(codes.items())
    if not isinstance(codes, DataFrame):
        codes = dictionary(df, codes)
    codes = codes.groupBy(F.col("code").cast("string").alias("__code")).agg(
        F.max_by("label", latest or "label").alias("__label"))
    if V.kind(df, column) == V.NUMBER:
        # A number finds its own spelling (1.0) before the whole one (1); both are one number.
        value = F.col("__code").try_cast("double")
        whole = F.when(value == F.rint(value), value.try_cast("bigint").cast("string"))
        spelled = F.when(value.cast("string") == F.col("__code"), 0).when(whole == F.col("__code"), 1)
        codes = codes.select(value.alias("__code"), "__label", spelled.alias("__rank")).filter("__rank is not null")
        codes = codes.groupBy("__code").agg(F.min_by("__label", "__rank").alias("__label"))
        key = raw.cast("double")
    else:
        key = V.plain_text(df, column)
    joined = df.withColumn("__key", key).join(codes, F.col("__key") == F.col("__code"), "left")
    return joined.withColumn(into, F.coalesce(F.col("__label"), shown)).drop("__key", "__code", "__label")
