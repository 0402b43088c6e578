"""Aggregates A1-A6, described as rules so that they can be computed in one step or in two.

A rule that has parts is merged from partial results: rows are reduced to their finest groups
once, and every coarser level is built from that much smaller frame. COUNT_DISTINCT is merged by
keeping its value in the finest groups, or approximately from sketches. Central moments and exact
quantiles have ways of their own over several levels. A rule with none of these is computed directly.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions import values as V


# How partial results of one kind are put together, by the name of the part.
COMBINE: dict[str, Callable[[Column], Column]] = {
    "total": F.sum, "n": F.sum, "low": F.min, "high": F.max, "sketch": F.hll_union_agg,
}


def _added(a: Column, b: Column) -> Column:
    return F.coalesce(a + b, a, b)


# How two partial results are put together; a missing one leaves the other.
COMBINE_TWO: dict[str, Callable[[Column, Column], Column]] = {
    "total": _added, "n": _added, "low": F.least, "high": F.greatest,
    "sketch": lambda a, b: F.coalesce(F.hll_union(a, b), a, b),
}


@dataclass(frozen=True)
class Rule:
    """``direct`` is the aggregate over rows. ``parts`` and ``finish`` merge it from partial results;
    ``moments`` makes it of the columns n, mean and sum of squared deviations; ``quantile`` is a share of
    the rows, whose value is chosen by rank."""

    direct: Callable[[Column], Column]
    parts: Callable[[Column], dict[str, Column]] | None = None
    finish: Callable[[dict[str, Column]], Column] | None = None
    numeric: bool = True
    distinct: bool = False
    moments: Callable[[Column, Column, Column], Column] | None = None
    quantile: float | None = None

    @property
    def mergeable(self) -> bool:
        return self.parts is not None or self.distinct

    def merge(self, parts: dict[str, Column]) -> Column:
        return self.finish({name: COMBINE[name](column) for name, column in parts.items()})


def _nothing(_) -> Column:
    return F.lit(None).cast("double")


def _count_values(value: Column) -> Column:
    # The struct is never null, so a null value counts as one more value.
    return F.count_distinct(F.struct(value))


AGGREGATES: dict[str, Rule] = {
    # Doubles are added, so that sums of integers cannot overflow.
    "SUM": Rule(lambda v: F.sum(v.cast("double")), lambda v: {"total": F.sum(v.cast("double"))}, lambda p: p["total"]),
    "AVG": Rule(lambda v: F.avg(v.cast("double")), lambda v: {"total": F.sum(v.cast("double")), "n": F.count(v)},
                lambda p: F.try_divide(p["total"], p["n"])),
    "MIN": Rule(F.min, lambda v: {"low": F.min(v)}, lambda p: p["low"]),
    "MAX": Rule(F.max, lambda v: {"high": F.max(v)}, lambda p: p["high"]),
    "COUNT": Rule(lambda v: F.count(F.lit(1)), lambda v: {"n": F.count(F.lit(1))},
                  lambda p: p["n"], numeric=False),
    "COUNT_DISTINCT": Rule(_count_values, numeric=False, distinct=True),
    "NONE": Rule(_nothing, lambda v: {}, _nothing, numeric=False),
}

# A sketch counts no nulls; they are one more value if there was any.
_SKETCHED = {"parts": lambda v: {"sketch": F.hll_sketch_agg(v.cast("string")), "high": F.max(v.isNull().cast("bigint"))},
             "finish": lambda p: F.coalesce(F.hll_sketch_estimate(p["sketch"]), F.lit(0)) + F.coalesce(p["high"], F.lit(0))}
APPROX_DISTINCT = Rule(lambda v: _SKETCHED["finish"](_SKETCHED["parts"](v)), **_SKETCHED, numeric=False)


def register_aggregate(name: str, direct: Callable[[Column], Column], *, numeric: bool = True,
                       parts=None, finish=None, moments=None, quantile: float | None = None) -> None:
    """G1: ``direct`` turns the operand into an aggregate Column of built-in functions.

    With ``parts`` and ``finish`` the aggregate is merged from partial results named as in
    :data:`COMBINE`, which lets subtotals be built from their finest groups. With ``moments`` it is a
    function of the number, the mean and the sum of squared deviations of the values, which are
    merged as such, without the loss of digits that sums of squares have. With ``quantile``, from 0 to 1, it is
    that quantile (interpolated between two values), found by rank without gathering a group.
    """
    AGGREGATES[name] = Rule(direct, parts, finish, numeric, moments=moments, quantile=quantile)


@dataclass(frozen=True)
class Measure:
    """An aggregate of any expression under an output name.

    ``per`` names the group column whose groups it is computed over (A9), the finest groups by
    default. ``typed`` lets MIN and MAX keep dates and text. ``empty`` is the value over no rows.
    """

    name: str
    how: str = "SUM"
    of: str | Column | None = None
    per: str | None = None
    typed: bool = False
    approx: bool = False
    empty: Any = 0

    @property
    def rule(self) -> Rule:
        if self.how not in AGGREGATES:
            raise ValueError(f"unknown aggregate {self.how!r}; known: {sorted(AGGREGATES)}")
        if self.how == "COUNT_DISTINCT" and self.approx:
            return APPROX_DISTINCT
        return AGGREGATES[self.how]

    def operand(self, df: DataFrame) -> Column:
        if self.of is None:
            return F.lit(None).cast("string")
        return V.number(df, self.of) if self.rule.numeric and not self.typed else V.col_of(self.of)

    def filled(self, result: Column) -> Column:
        keeps_null = self.empty is None or self.typed or self.how == "NONE"
        return result if keeps_null else F.coalesce(result, F.lit(self.empty))

    def column(self, df: DataFrame) -> Column:
        """The aggregate over ``df``, for ``agg``."""
        return self.filled(self.rule.direct(self.operand(df))).alias(self.name)


def first_values(df: DataFrame, take: Mapping[str, str | Column], order_by: Sequence[str | Column]) -> DataFrame:
    """Cells without an aggregate, taken from the first row in an order of
    any directions; one row of nulls over no rows."""
    values = F.struct(*[V.col_of(c).alias(name) for name, c in take.items()])
    top = df.orderBy(*order_by).limit(1).select(values.alias("first"))
    first = top.agg(F.first("first").alias("first"))
    return first.select(*[F.col(f"first.{name}").alias(name) for name in take])


def kpi(df: DataFrame, *measures: Measure) -> DataFrame:
    """One row of aggregates over the whole frame, also when it is empty."""
    return df.agg(*[m.column(df) for m in measures])
