"""Bands: grouped and detail lists, per-group totals, subtotals, merge spans.

A band is a frame of rows in report order. ``level`` says what a row is: the number of group
columns for a list row, ``d`` for a subtotal of the groups 0..d, -1 for the grand total.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions import values as V
from ledgerline.functions.aggregates import Measure
from ledgerline.functions.predicates import Condition, filter_all
from ledgerline.functions.scalars import text
from ledgerline.operators.levels import SET, attach, level_totals
from ledgerline.operators.ordering import distinct_first, group_keys, number_rows, tie_break
from ledgerline.session import write_down

LEVEL, SUMMARY_NO = "level", "summary_no"


class _Group:
    """Stands for the group value of a summary row inside its label."""


GROUP = _Group()


@dataclass(frozen=True)
class Summary:
    """A subtotal after each group of ``by``, or the grand total when ``by`` is None.

    ``label`` is a sequence of plain text, :data:`GROUP`, Columns over the group columns and
    measures (text with aggregates, E9); ``label_in`` is the output column it goes to.
    """

    by: str | None = None
    measures: tuple[Measure, ...] = ()
    label: tuple = ()
    label_in: str = "label"


def _depth(groups: Sequence[str], name: str | None) -> int:
    if name is None:
        return -1
    if name not in groups:
        raise ValueError(f"{name!r} is not a group column of this band: {list(groups)}")
    return list(groups).index(name)


def _prefix(groups: Sequence[str], measure: Measure) -> tuple[str, ...]:
    return tuple(groups[:_depth(groups, measure.per) + 1]) if measure.per else tuple(groups)


class _Figures:
    """Each distinct aggregate of a band once, under an internal name."""

    def __init__(self):
        self.measures: dict[tuple, Measure] = {}

    def column(self, m: Measure) -> str:
        of = m.of if isinstance(m.of, (str, type(None))) else id(m.of)
        key = (m.how, of, m.typed, m.approx, m.empty)
        if key not in self.measures:
            self.measures[key] = Measure(f"__f{len(self.measures)}", m.how, m.of, None, m.typed, m.approx, m.empty)
        return self.measures[key].name


def _row_struct(which: Column, level: int, summary_no: int | None, cells: dict[str, Column],
                outputs: dict[str, str]) -> Column:
    return F.struct(
        which.alias(SET), F.lit(level).alias(LEVEL), F.lit(summary_no).cast("int").alias(SUMMARY_NO),
        *[cells.get(name, F.lit(None)).cast(kind).alias(name) for name, kind in outputs.items()])


def _rows_of(totals: DataFrame, groups: Sequence[str], structs: Sequence[Column], outputs: dict[str, str]) -> DataFrame:
    """One row per level row and struct of that level."""
    mine = F.filter(F.array(*structs), lambda s: s[SET] == F.col(SET))
    return totals.select(*groups, F.explode(mine).alias("__row")).select(
        *groups, *[F.col(f"__row.{c}").alias(c) for c in (LEVEL, SUMMARY_NO, *outputs)])


def _beside_rows(df: DataFrame, groups: tuple[str, ...], columns: Sequence[str],
                 beside: dict[tuple[str, ...], dict[str, str]], totals: DataFrame | None,
                 sets: Sequence[tuple[str, ...]]) -> DataFrame:
    """List rows with the aggregates of their own and of coarser groups.

    ``beside`` says per prefix of the groups which output column shows which figure of ``totals``.
    Coarser figures are put beside the finest groups first, so that detail rows are joined once.
    """
    rows = df.select(*groups, *[c for c in columns if c not in groups]) if columns else None
    if rows is not None and not beside:
        return rows

    def figures(prefix):
        shown = [F.col(c).alias(name) for name, c in beside.get(prefix, {}).items()]
        return totals.filter(F.col(SET) == sets.index(prefix)).select(*prefix, *shown)

    finest = groups if rows is None else max(beside, key=len)
    held = figures(finest)
    for prefix in sorted(beside, key=len):
        if prefix != finest:
            held = attach(held, figures(prefix), prefix, list(beside[prefix]))
    if rows is None:
        return held
    if len(beside) > 1:
        held = write_down(held)
    return attach(rows, held, finest, [name for names in beside.values() for name in names])


def band_keys(df: DataFrame, groups: Sequence[str], typed: bool = False, summaries: bool = True) -> list[Column]:
    """Ascending sort keys that put every summary right after its group and the grand total last.

    A row of level d is marked at position d+1, so it follows all rows that share its groups
    0..d; inner levels come before outer ones. Rows without summaries need no marks.
    """
    keys = [F.col(LEVEL) < 0] if summaries else []
    for d, group in enumerate(groups):
        keys += group_keys(df, group, typed)
        if summaries:
            keys.append(F.col(LEVEL) < d + 1)
    return [*keys, F.col(SUMMARY_NO)] if summaries else keys


def in_order(rows: DataFrame, groups: Sequence[str], order_by: Sequence[str | Column] = (),
             typed: bool = False, summaries: bool = True, columns: Sequence[str] = ()) -> DataFrame:
    """The rows of a band in report order; rows equal in it are told apart by ``columns``."""
    keys = [*band_keys(rows, groups, typed, summaries), *order_by]
    keys += tie_break(rows, columns) if keys else []
    return rows.orderBy(*keys) if keys else rows


def band_positions(rows: DataFrame, groups: Sequence[str], order_by: Sequence[str | Column] = (),
                   typed: bool = False, name: str = "row_no") -> DataFrame:
    """M3 for a band: dense positions of list rows, subtotals and totals together."""
    return number_rows(rows, [*band_keys(rows, groups, typed), *order_by], name)


def band(df: DataFrame, groups: Sequence[str], columns: Sequence[str] = (),
         measures: Sequence[Measure] = (), summaries: Sequence[Summary] = (),
         order_by: Sequence[str | Column] = (), where: Sequence[Condition] = (),
         typed_sort: bool = False, ordered: bool = True) -> DataFrame:
    """A list with optional groups, aggregates, subtotals and grand totals, in report order.

    Without ``columns`` there is one row per distinct group tuple (A7); with them every source row
    stays (A8) and aggregates are repeated beside it (A9, A10). ``ordered=False`` leaves out the
    final sort, for results that are written or put :func:`in_order` later.

    All aggregates of the list and of every summary come from one pass over the source.
    """
    df = filter_all(df, *where)
    groups, n = tuple(groups), len(groups)
    figures = _Figures()
    beside: dict[tuple[str, ...], dict[str, str]] = {}
    for m in measures:
        beside.setdefault(_prefix(groups, m), {})[m.name] = figures.column(m)
    depth = {no: _depth(groups, s.by) for no, s in enumerate(summaries)}
    cells = {no: {m.name: figures.column(m) for m in s.measures} for no, s in enumerate(summaries)}
    inside = {no: {id(p): figures.column(p) for p in s.label if isinstance(p, Measure)} for no, s in enumerate(summaries)}
    if not columns and not groups:
        presence = figures.column(Measure("rows", "COUNT"))

    sets = list(dict.fromkeys([*([] if columns else [groups]), *beside, *[groups[:d + 1] for d in depth.values()]]))
    totals = level_totals(df, groups, sets, list(figures.measures.values())) if sets else None
    kind = {c: f.dataType.simpleString() for c, f in zip(totals.columns, totals.schema)} if sets else {}
    outputs = {name: kind[c] for cs in (*beside.values(), *cells.values()) for name, c in cs.items()}
    outputs |= {s.label_in: "string" for s in summaries if s.label}
    taken = {*groups, *({m.name for m in measures} & set(columns))}
    if clash := set(outputs) & taken:
        raise ValueError(f"measures and labels need columns of their own, not {sorted(clash)}")

    structs = []
    for no, s in enumerate(summaries):
        own = {name: F.col(c) for name, c in cells[no].items()}
        if s.label:
            group = F.col(s.by) if s.by else F.lit(None).cast("string")
            own[s.label_in] = text(totals, *[
                group if p is GROUP else F.col(inside[no][id(p)]) if isinstance(p, Measure) else p for p in s.label])
        structs.append(_row_struct(F.lit(sets.index(groups[:depth[no] + 1])), depth[no], no, own, outputs))

    coarse = [p for p in beside if p != groups]
    if groups and not columns and not coarse and not summaries:
        out = totals.select(*groups, F.lit(n).alias(LEVEL), F.lit(None).cast("int").alias(SUMMARY_NO),
                            *[F.col(c).alias(name) for name, c in beside.get(groups, {}).items()])
    elif not columns and not coarse:
        own = {name: F.col(c) for name, c in beside.get(groups, {}).items()}
        which = F.lit(sets.index(groups))
        if not groups:
            # No rows, no list row; only totals stand for an empty set.
            which = F.when(F.col(presence) > 0, which)
        out = _rows_of(totals, groups, [_row_struct(which, n, None, own, outputs), *structs], outputs)
    else:
        if beside:
            totals = write_down(totals)
        out = _beside_rows(df, groups, columns, beside, totals, sets)
        out = out.withColumns({LEVEL: F.lit(n), SUMMARY_NO: F.lit(None).cast("int")})
        if structs:
            out = out.unionByName(_rows_of(totals, groups, structs, outputs), allowMissingColumns=True)
    return in_order(out, groups, order_by, typed_sort, bool(summaries), columns) if ordered else out


def group_list(df: DataFrame, groups: Sequence[str], measures: Sequence[Measure] = (),
               where: Sequence[Condition] = (), typed_sort: bool = False) -> DataFrame:
    """One row per distinct group tuple, without the control columns of :func:`band`."""
    return band(df, groups, (), measures, where=where, typed_sort=typed_sort).drop(LEVEL, SUMMARY_NO)


def detail_list(df: DataFrame, groups: Sequence[str], columns: Sequence[str],
                measures: Sequence[Measure] = (), order_by: Sequence[str | Column] = (),
                where: Sequence[Condition] = (), typed_sort: bool = False) -> DataFrame:
    """Every source row, sorted by its groups, aggregates repeated beside it."""
    return band(df, groups, columns, measures, (), order_by, where, typed_sort).drop(LEVEL, SUMMARY_NO)


def merge_spans(rows: DataFrame, groups: Sequence[str], order_by: Sequence[str] = (),
                spans: dict[str, str] | Sequence[str] | None = None,
                deepest_summary: str | None = None, typed_sort: bool = False) -> DataFrame:
    """M1, M2: how many list rows each merged cell covers and which row carries it.

    ``rows`` are list rows, ``order_by`` names the columns that make their order total within a group
    (``-name`` for descending; none for rows that are groups themselves). ``typed_sort`` is that of the
    list. ``spans`` maps an
    output name to the group column whose prefix it repeats over (a coarse aggregate names its
    ``per`` group); by default every group column. ``deepest_summary`` is the innermost group with
    a subtotal, which cuts the runs. Adds ``<name>__span`` and ``<name>__head``.

    A run is always a whole prefix of the groups, so counting and taking the least row of each
    prefix is enough. Rows are reduced to their groups once, which shrinks a hot group where it is
    read; the prefixes are built from that, and the rows are joined to the result once.
    """
    spans = {g: g for g in groups} if spans is None else spans
    spans = spans if isinstance(spans, dict) else {g: g for g in spans}
    cut = _depth(groups, deepest_summary) + 1
    length = {name: max(_depth(groups, group) + 1, cut) for name, group in spans.items()}
    if not order_by and all(n == len(groups) for n in length.values()):
        # Grouped rows at their finest groups: every run is one row.
        return rows.withColumns({c: v for name in spans for c, v in (
            (f"{name}__span", F.lit(1).cast("bigint")), (f"{name}__head", F.lit(True)))})

    def least(columns: Sequence[Column]) -> Column:
        return F.struct(*[c.alias(f"o{i}") for i, c in enumerate(columns)])  # nulls come first in it

    names = [c.removeprefix("-") for c in order_by]
    at = least([F.col(c) for c in names]) if order_by else F.lit(0)
    finest = rows.groupBy(*groups).agg(F.count(F.lit(1)).alias("__n"), F.min(at).alias("__at"))
    if names != list(order_by):
        order = [F.col(n).desc() if c != n else F.col(n).asc() for c, n in zip(order_by, names, strict=True)]
        top = distinct_first(rows.select(*dict.fromkeys([*groups, *names])), groups, order)
        top = top.select(*[F.col(g).alias(f"__k{i}") for i, g in enumerate(groups)], at.alias("__at"))
        match = V.all_of(F.col(g).eqNullSafe(F.col(f"__k{i}")) for i, g in enumerate(groups))
        finest = finest.drop("__at").join(top, match).drop(*[f"__k{i}" for i in range(len(groups))])
    beside = finest
    added = {}
    for n in sorted(set(length.values())):
        added[n] = (f"__n{n}", f"__first{n}")
        if n == len(groups):
            beside = beside.withColumns({f"__n{n}": F.col("__n"), f"__first{n}": F.lit(True)})
            continue
        # The groups below tell all rows of the prefix apart, so the first of them is its first row's.
        place = least([c for g in groups[n:] for c in group_keys(finest, g, typed_sort)])
        runs = finest.groupBy(*groups[:n]).agg(F.sum("__n").alias(f"__n{n}"), F.min(place).alias("__least"))
        runs = runs.select(*[F.col(g).alias(f"__k{i}") for i, g in enumerate(groups[:n])], f"__n{n}", "__least")
        match = V.all_of(F.col(g).eqNullSafe(F.col(f"__k{i}")) for i, g in enumerate(groups[:n]))
        beside = beside.join(runs, match).withColumn(f"__first{n}", place.eqNullSafe(F.col("__least")))
        beside = beside.drop("__least", *[f"__k{i}" for i in range(n)])
    names = ["__n", "__at", *[c for pair in added.values() for c in pair]]
    keyed = attach(rows, write_down(beside), groups, names)
    here = at.eqNullSafe(F.col("__at"))
    cells = {}
    for name, n in length.items():
        count, first = added[n]
        cells |= {f"{name}__span": F.col(count), f"{name}__head": F.col(first) & here}
    return keyed.withColumns(cells).drop(*names)
