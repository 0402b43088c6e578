"""Predicates P1-P13 and filters; new operators are added with :func:`register_predicate`."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions import values as V

Predicate = Callable[[DataFrame, str | Column, Any], Column]


@dataclass(frozen=True)
class Condition:
    """``left op right``; ``left`` is a column name or Column, ``right`` a Column or plain value."""

    left: str | Column
    op: str
    right: Any = None


def _items(right) -> list:
    """The members of a list given as comma text or as a Python collection."""
    if right is None:
        return []
    if isinstance(right, str):
        return [item for item in (part.strip(V.BLANKS) for part in right.split(",")) if item]
    if isinstance(right, (list, tuple, set, frozenset)):
        return list(right)
    return [right]


def _item_array(df: DataFrame, right: Column) -> Column:
    parts = F.split(V.plain_text(df, right), ",")
    return F.filter(F.transform(parts, V.trimmed), lambda item: item != "")


def contains(df: DataFrame, left: str | Column, right) -> Column:
    if right is None:
        return F.lit(False)
    needle = V.plain_text(df, right) if isinstance(right, Column) else F.lit(V.literal_text(right))
    return F.coalesce(F.contains(V.plain_text(df, left), needle), F.lit(False))


def is_in(df: DataFrame, left: str | Column, right) -> Column:
    if isinstance(right, Column):
        # The loose key of text is also the key of the list's members, which are all text.
        key = V.code_text(df, left)
        keys = F.transform(_item_array(df, right), V.text_code)
        return F.coalesce(F.array_contains(keys, key), F.lit(False))
    items = _items(right)
    found, column = V.kind(df, left), V.col_of(left)
    numbers = [n for n in map(V.literal_number, items) if n is not None]
    if found == V.NUMBER:
        return (column.isNotNull() & column.isin(numbers)) if numbers else F.lit(False)
    if found in (V.DATE, V.DATETIME):
        moments = [m for m in map(V.literal_moment, items) if m is not None]
        return (column.isNotNull() & column.isin(moments)) if moments else F.lit(False)
    words = [V.literal_text(item) for item in items if V.literal_number(item) is None]
    text = V.plain_text(df, left)
    hits = [text.isin(words)] if words else []
    if numbers and found == V.TEXT:
        hits.append(F.coalesce(V.number(df, left).isin(numbers), F.lit(False)))
    return (column.isNotNull() & V.any_of(hits)) if hits else F.lit(False)


def between(df: DataFrame, left: str | Column, right) -> Column:
    if isinstance(right, Column):
        bounds = _item_array(df, right)
        low, high = F.get(bounds, 0), F.get(bounds, 1)
        inside = V.compare(df, "GE", left, low) & V.compare(df, "LE", left, high)
        return F.coalesce(V.col_of(left).isNotNull() & (F.size(bounds) >= 2) & inside, F.lit(False))
    bounds = _items(right)
    if len(bounds) < 2:
        return F.lit(False)
    return (V.col_of(left).isNotNull() & V.compare(df, "GE", left, bounds[0])
            & V.compare(df, "LE", left, bounds[1]))


def is_null(df: DataFrame, left: str | Column, right=None) -> Column:
    column = V.col_of(left)
    return (column.isNull() | (column == "")) if V.kind(df, left) == V.TEXT else column.isNull()


def _compares(op: str) -> Predicate:
    return lambda df, left, right: V.compare(df, op, left, right)


def _not(predicate: Predicate) -> Predicate:
    return lambda df, left, right=None: ~predicate(df, left, right)


PREDICATES: dict[str, Predicate] = {
    **{op: _compares(op) for op in V.COMPARE},
    "CONTAINS": contains, "NOT_CONTAINS": _not(contains),
    "IN": is_in, "NOT_IN": _not(is_in),
    "IS_NULL": is_null, "IS_NOT_NULL": _not(is_null),
    "BETWEEN": between,
}

# The same operators with the null rules of SQL, for callers who ask for them.
SQL_PREDICATES: dict[str, Predicate] = {
    **{op: (lambda df, left, right, f=f: f(left, right if isinstance(right, Column) else F.lit(right)))
       for op, f in V.COMPARE.items()},
    "CONTAINS": lambda df, left, right: F.contains(left.cast("string"), F.lit(right)),
    "NOT_CONTAINS": lambda df, left, right: ~F.contains(left.cast("string"), F.lit(right)),
    "IN": lambda df, left, right: F.when(left.isNotNull(), is_in(df, left, right)),
    "NOT_IN": lambda df, left, right: F.when(left.isNotNull(), ~is_in(df, left, right)),
    "IS_NULL": lambda df, left, right=None: left.isNull(),
    "IS_NOT_NULL": lambda df, left, right=None: left.isNotNull(),
    "BETWEEN": lambda df, left, right: F.when(left.isNotNull(), between(df, left, right)),
}


def register_predicate(op: str, predicate: Callable[[DataFrame, Column, Any], Column]) -> None:
    """``predicate`` gets the frame, the left side as a Column and the right side as given."""
    PREDICATES[op] = lambda df, left, right=None: predicate(df, V.col_of(left), right)


def test(df: DataFrame, condition: Condition, sql_nulls: bool = False) -> Column:
    """The condition as a boolean Column over ``df``."""
    known = {**PREDICATES, **SQL_PREDICATES} if sql_nulls else PREDICATES
    if condition.op not in known:
        raise ValueError(f"unknown operator {condition.op!r}; known: {sorted(known)}")
    left = V.col_of(condition.left) if sql_nulls else condition.left
    return known[condition.op](df, left, condition.right)


def filter_all(df: DataFrame, *conditions: Condition, sql_nulls: bool = False) -> DataFrame:
    """Rows for which every condition holds."""
    for condition in conditions:
        df = df.filter(test(df, condition, sql_nulls))
    return df
