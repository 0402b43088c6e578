"""Drill-through (D1-D3): the rows behind a figure, found again by its group keys."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.aggregates import Measure
from ledgerline.functions.predicates import Condition, filter_all
from ledgerline.functions.values import COMPARE, all_of, any_of
from ledgerline.operators.blocks import correlate
from ledgerline.operators.ordering import distinct_first


def drill_rows(df: DataFrame, cells: DataFrame | Sequence[Mapping], keys: Sequence[str]) -> DataFrame:
    """The rows of ``df`` that make up the chosen cells; no keys means a grand total.

    A list of cells becomes one filter of typed, null-safe literals, however long it is, and reaches
    the scan. A frame of cells, of any size, is joined; Spark broadcasts it where its measured size
    allows and splits hot keys where not.
    """
    if not keys:
        return df
    if not isinstance(cells, DataFrame):
        return df.filter(_any_cell(df, [tuple(c[k] for k in keys) for c in cells], keys))
    side = cells.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)])
    match = all_of(F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys))
    return df.join(side, match, "left_semi")


def drill_threshold(recs: DataFrame, other: DataFrame, on: Sequence[tuple[str, str]], threshold: tuple[str, str, str],
                    where: Sequence[Condition] = ()) -> DataFrame:
    """D1 for a correlated figure with an inequality: the rows of ``other`` that make up the figure of any
    of the chosen records. ``on`` pairs record fields with fields of ``other``; ``threshold`` is
    ``(other field, op, record field)``. Of a key's bounds only the widest matters, of two unlike ones for NE
    either, so a row meets one pair of bounds however many records there are."""
    field, op, bound = threshold
    rows = filter_all(other, *where)
    place = F.struct(F.col(bound).isNull(), F.col(bound).alias("at"))  # as in the figure, a missing value is the greatest
    keys = [F.col(mine).alias(f"__k{i}") for i, (mine, _) in enumerate(on)]
    side = recs.groupBy(*keys).agg(F.min(place).alias("__low"), F.max(place).alias("__high"), F.count("*").alias("__n")).where("__n > 0")
    joined = all_of(F.col(theirs).eqNullSafe(F.col(f"__k{i}")) for i, (_, theirs) in enumerate(on))

    def beyond(b: Column) -> Column:
        a = F.col(field)
        missing = {"LT": a.isNotNull() & b.isNull(), "LE": b.isNull(), "GT": a.isNull() & b.isNotNull(), "GE": a.isNull(),
                   "NE": a.isNull() != b.isNull()}[op]
        return F.coalesce(COMPARE[op](a, b), F.lit(False)) | missing

    low, high = F.col("__low")["at"], F.col("__high")["at"]
    hit = beyond(low) | beyond(high) if op == "NE" else beyond(high if op in ("LT", "LE") else low)
    return rows.join(side, joined & hit, "left_semi")


def drill_interval(recs: DataFrame, other: DataFrame, on: Sequence[tuple[str, str]], field: str, low: str, high: str,
                   where: Sequence[Condition] = ()) -> DataFrame:
    """D1 for a figure over an interval: the rows of ``other`` whose ``field`` lies in the interval, both bounds
    included, of any of the chosen records. A row lies in one if more intervals of its key have begun by then
    than have ended before, which running totals count without pairs."""
    spans = recs.select(*[F.col(mine).alias(f"__k{i}") for i, (mine, _) in enumerate(on)], F.col(low).alias("__low"), F.col(high).alias("__high"))
    empty = F.coalesce(F.col("__low") > F.col("__high"), F.col("__low").isNull() & F.col("__high").isNotNull())
    spans = spans.where(~empty)
    back = [(theirs, f"__k{i}") for i, (_, theirs) in enumerate(on)]
    rows = filter_all(other, *where)
    begun = correlate(rows, spans, back, [Measure("__begun", "COUNT")], threshold=("__low", "LE", field))
    both = correlate(begun, spans, back, [Measure("__ended", "COUNT")], threshold=("__high", "LT", field))
    return both.where("__begun > __ended").select(*other.columns)


def _any_cell(df: DataFrame, cells: list[tuple], keys: Sequence[str]) -> Column:
    """Whether a row is in one of the cells: those that differ in the last key only share a list of it."""
    *before, last = keys
    kind = df.schema[last].dataType
    shared: dict[tuple, list] = {}
    for *head, value in cells:
        shared.setdefault(tuple(head), []).append(value)
    hits = []
    for head, values in shared.items():
        known = [F.lit(v).cast(kind) for v in values if v is not None]
        at = any_of([*([F.col(last).isNotNull() & F.col(last).isin(known)] if known else []),
                     *([F.col(last).isNull()] if len(known) < len(values) else [])])
        hits.append(all_of([*[F.col(k).eqNullSafe(F.lit(v).cast(df.schema[k].dataType)) for k, v in zip(before, head, strict=True)], at]))
    while len(hits) > 1:  # in pairs, so that the expression stays flat
        hits = [any_of(hits[i:i + 2]) for i in range(0, len(hits), 2)]
    return hits[0] if hits else F.lit(False)


def drill_view(rows: DataFrame, fields: Sequence[str], primary_key: Sequence[str] = (),
               order_by: Sequence[str | Column] = ()) -> DataFrame:
    """One dataset's fields of the drilled rows, the first row per primary key.

    Rows whose key is wholly null are all kept, as there is nothing to tell them apart by.
    """
    if not primary_key:
        return rows.select(*fields)
    keyed = any_of(F.col(k).isNotNull() for k in primary_key)
    first = distinct_first(rows.filter(keyed), primary_key, order_by or primary_key)
    return first.select(*fields).unionByName(rows.filter(~keyed).select(*fields))
