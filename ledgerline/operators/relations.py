"""Joins along declared relationships (J1-J8) and unions with column mapping."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions import values as V
from ledgerline.session import write_down

HOT_ROWS = 500_000  # of one key, beyond which an outer join deals its rows to several tasks

JOINS = ("INNER", "LEFT", "RIGHT", "FULL")


@dataclass(frozen=True)
class Relationship:
    """Equality of two fields, each given as ``(dataset, field)``; no join type means INNER."""

    left: tuple[str, str]
    right: tuple[str, str]
    how: str | None = "INNER"

    def touches(self, a: str, b: str) -> bool:
        return {self.left[0], self.right[0]} == {a, b}


def qualified(dataset: str, field: str) -> str:
    return f"{dataset}__{field}"


def qualify(df: DataFrame, dataset: str) -> DataFrame:
    """Every column under its dataset's name, so that joins never collide."""
    return df.select(*[F.col(c).alias(qualified(dataset, c)) for c in df.columns])


def _same_key(left: DataFrame, right: DataFrame, mine: str, theirs: str, null_match: bool) -> Column:
    """Keys are equal as text; keys of one kind are so as they are and need no cast."""
    a, b = F.col(mine), F.col(theirs)
    if V.kind(left, mine) != V.kind(right, theirs):
        a, b = V.plain_text(left, mine), V.plain_text(right, theirs)
    return a.eqNullSafe(b) if null_match else a == b


def join_on(left: DataFrame, right: DataFrame, on: Sequence[tuple[str, str]], how: str | None = "INNER",
            null_match: bool = True, left_unique: bool = False, right_unique: bool = False) -> DataFrame:
    """Join frames with distinct column names; missing sides are null.

    A unique side is one whose key is its primary key: that key is never missing, so a plain
    equality does and table layouts by key stay usable.

    Spark splits a hot key of either side of an inner join, but not of the null-padded side of an
    outer join. Unless that side is declared unique on its key, its keys are counted first (which reads
    the key alone); keys of more than ``HOT_ROWS`` rows are then salted, the others joined as they are.
    """
    how = how or "INNER"
    if how not in JOINS:
        raise ValueError(f"unknown join type {how!r}; known: {JOINS}")
    null_match = null_match and not (len(on) == 1 and (left_unique or right_unique))
    match = V.all_of(_same_key(left, right, a, b, null_match) for a, b in on)
    if how == "INNER":
        return left.join(right, match, "inner")
    padded_unique = {"LEFT": right_unique, "RIGHT": left_unique, "FULL": left_unique and right_unique}[how]
    if padded_unique:
        return left.join(right, match, how.lower())
    mine, theirs = _keys(left, right, on)
    hot_right = _hot(right, theirs, null_match) if how in ("LEFT", "FULL") else None
    hot_left = _hot(left, mine, null_match) if how in ("RIGHT", "FULL") else None
    if hot_right is None and hot_left is None:
        return left.join(right, match, how.lower())
    return _salted(left, right, match, how, mine, theirs, hot_left, hot_right)


def _keys(left: DataFrame, right: DataFrame, on: Sequence[tuple[str, str]]) -> tuple[list[Column], list[Column]]:
    """The keys of both sides as values that are equal exactly when they match."""
    sides: tuple[list[Column], list[Column]] = ([], [])
    for a, b in on:
        unlike = V.kind(left, a) != V.kind(right, b)
        sides[0].append(V.plain_text(left, a) if unlike else F.col(a))
        sides[1].append(V.plain_text(right, b) if unlike else F.col(b))
    return sides


def _hot(df: DataFrame, keys: Sequence[Column], null_match: bool) -> DataFrame | None:
    """``k0, k1, …, parts`` of the keys with too many rows for a task, None if there are none."""
    named = df.select(*[k.alias(f"k{i}") for i, k in enumerate(keys)])
    if not null_match:
        named = named.dropna()
    counted = named.groupBy(*named.columns).agg(F.count("*").alias("n")).where(F.col("n") > HOT_ROWS)
    hot = write_down(counted.select(*named.columns, F.ceil(F.col("n") / HOT_ROWS).cast("int").alias("parts")))
    return None if hot.isEmpty() else hot


def _salted(left: DataFrame, right: DataFrame, match: Column, how: str, mine: Sequence[Column], theirs: Sequence[Column],
            hot_left: DataFrame | None, hot_right: DataFrame | None) -> DataFrame:
    """The outer join with the rows of a hot key dealt to several parts, and the other side's rows of that key
    copied to each of them. A copy that meets nobody in one part is no row without a partner: a hot key
    has rows, so its partners meet somebody in another part."""

    def dealt(df: DataFrame, keys: Sequence[Column], own: DataFrame | None, others: DataFrame | None, side: str) -> DataFrame:
        row = F.xxhash64(*[c for c in df.columns if "map<" not in df.schema[c].dataType.simpleString()])
        for name, hot in (("own", own), ("other", others)):
            count = F.lit(1)
            if hot is not None:
                known = hot.withColumnsRenamed({c: f"__{c}" for c in hot.columns})
                same = V.all_of(k.eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys))
                df = df.join(known, same, "left").drop(*[f"__k{i}" for i in range(len(keys))])
                count = F.coalesce("__parts", F.lit(1))
            df = df.withColumn(f"__{side}_{name}", count).drop("__parts")
        deal = F.pmod(row, F.col(f"__{side}_own")).cast("int").alias(f"__{side}_deal")
        copy = F.explode(F.sequence(F.lit(0), F.col(f"__{side}_other") - 1)).alias(f"__{side}_copy")
        return df.select("*", deal, copy)

    a = dealt(left, mine, hot_left, hot_right, "a")
    b = dealt(right, theirs, hot_right, hot_left, "b")
    part = (F.col("__a_deal") == F.col("__b_copy")) & (F.col("__a_copy") == F.col("__b_deal"))
    joined = a.join(b, match & part, how.lower())
    spurious = (F.col("__b_deal").isNull() & (F.col("__a_other") > 1)) | (F.col("__a_deal").isNull() & (F.col("__b_other") > 1))
    return joined.where(~F.coalesce(spurious, F.lit(False))).select(*left.columns, *right.columns)


def combine(frames: Mapping[str, DataFrame], relationships: Sequence[Relationship],
            datasets: Sequence[str], primary_keys: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """One frame of all ``datasets`` (qualified columns), joined in the order they are reachable.

    From the first dataset on, the first declared relationship to a dataset not yet in decides the
    step; all relationships of that pair become one composite key. A dataset that cannot be
    reached is an error. ``primary_keys`` tells which sides are unique.
    """
    primary_keys = primary_keys or {}
    waiting = list(dict.fromkeys(datasets))
    joined = [waiting.pop(0)]
    result = frames[joined[0]]
    # Uniqueness of the growing side is only known while it is a single dataset.
    while waiting:
        step = next(((ds, rel) for ds in waiting for rel in relationships
                     if any(rel.touches(ds, seen) for seen in joined)), None)
        if step is None:
            raise ValueError(f"no relationship connects {waiting} with {joined}")
        new, first = step
        partner = first.left[0] if first.right[0] == new else first.right[0]
        on = []
        for rel in (r for r in relationships if r.touches(new, partner)):
            mine, theirs = (rel.left, rel.right) if rel.right[0] == new else (rel.right, rel.left)
            on.append((qualified(*mine), qualified(*theirs)))

        def unique(dataset: str, columns: set[str]) -> bool:
            key = {qualified(dataset, k) for k in primary_keys.get(dataset, ())}
            return bool(key) and key <= columns

        result = join_on(result, frames[new], on, first.how,
                         left_unique=len(joined) == 1 and unique(joined[0], {a for a, _ in on}),
                         right_unique=unique(new, {b for _, b in on}))
        joined.append(new)
        waiting.remove(new)
    return result


def components(datasets: Sequence[str], relationships: Sequence[Relationship]) -> list[list[str]]:
    """Datasets that hang together, directly or through others; each set is listed on its own."""
    asked = list(dict.fromkeys(datasets))
    groups = [{d} for d in asked]
    for rel in relationships:
        ends = {rel.left[0], rel.right[0]}
        linked = [g for g in groups if g & ends]
        groups = [g for g in groups if g not in linked] + [ends.union(*linked)]
    named = [[d for d in asked if d in g] for g in groups]
    return sorted((g for g in named if g), key=lambda g: asked.index(g[0]))


def union_mapped(columns: Sequence[str], members: Sequence[tuple[str, DataFrame, Mapping[str, str]]],
                 member_column: str | None = None) -> DataFrame:
    """The members one below the other under common columns; unmapped columns are null.

    Columns that members hold in different types are shown as text. ``member_column`` keeps which
    member a row came from, as a union has no order.
    """
    if not members:
        raise ValueError("a union needs at least one member")
    kinds = {c: {V.kind(df, m[c]) for _, df, m in members if m.get(c)} for c in columns}
    out = None
    for name, df, mapping in members:
        picked = []
        for c in columns:
            source = mapping.get(c)
            value = F.lit(None) if not source else F.col(source)
            if source and len(kinds[c]) > 1:
                value = V.plain_text(df, source)
            picked.append(value.alias(c))
        if member_column:
            picked.append(F.lit(name).alias(member_column))
        part = df.select(*picked)
        out = part if out is None else out.unionByName(part)
    return out
