"""Aggregates over several prefixes or subsets of the group columns in one pass over the rows."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.aggregates import Measure
from ledgerline.functions.values import all_of
from ledgerline.operators.ranges import positions
from ledgerline.session import write_down

SET = "__set"


def level_totals(df: DataFrame, keys: Sequence[str], sets: Sequence[Sequence[str]],
                 measures: Sequence[Measure]) -> DataFrame:
    """One row per distinct key tuple of each set, with all ``keys``, ``__set`` and the measures.

    ``__set`` is the index into ``sets``; keys outside the set are null. An empty set gives one
    row even over no rows. Rows are first reduced to their finest groups, so a hot group shrinks
    in the tasks that read it and the levels only see one row per finest group. Measures whose
    finest groups differ (unlike distinct operands, moments, quantiles) are totalled apart, each from its
    own, and joined by key and set; their operands are written down first, so the rows are read once.
    """
    sets = [tuple(s) for s in sets]
    ways = _ways(measures, len(sets) > 1)
    if set(ways) != {("merged",)}:
        return _joined(df, keys, sets, measures, ways)
    return _merged(df, keys, sets, measures)


def _merged(df: DataFrame, keys: Sequence[str], sets: Sequence[tuple[str, ...]], measures: Sequence[Measure]) -> DataFrame:
    used = [k for k in keys if any(k in s for s in sets)]
    source = df.select(*keys, *[m.operand(df).alias(f"__v{i}") for i, m in enumerate(measures)])
    types = {k: source.schema[k].dataType for k in keys}

    finest = None
    if len(sets) > 1 and all(m.rule.mergeable for m in measures):
        grain, parts, finals, own = [], [], [], []
        for i, m in enumerate(measures):
            value = F.col(f"__v{i}")
            if m.rule.distinct:
                grain.append(f"__v{i}")
                finals.append(m.rule.direct(value))
                continue
            names = {part: f"__p{i}_{part}" for part in m.rule.parts(value)}
            parts += [c.alias(names[part]) for part, c in m.rule.parts(value).items()]
            finals.append(m.rule.merge({part: F.col(name) for part, name in names.items()}))
            own.append(m.filled(m.rule.finish({part: F.col(name) for part, name in names.items()})).alias(m.name))
        base = source.groupBy(*used, *grain)
        base = base.agg(*parts) if parts else base.agg(F.lit(1).alias("__one"))
        if not grain and tuple(used) in sets:
            # The finest groups are finished as they are and need no second shuffle.
            finest = base.select(*used, *own)
    else:
        base = source
        finals = [m.rule.direct(F.col(f"__v{i}")) for i, m in enumerate(measures)]
    results = [m.filled(f).alias(m.name) for m, f in zip(measures, finals)] or [F.lit(1).alias("__one")]
    names = [m.name for m in measures]

    def shaped(totals: DataFrame, present: Sequence[str], which: Column) -> DataFrame:
        return totals.select(
            *[F.col(k) if k in present else F.lit(None).cast(types[k]).alias(k) for k in keys],
            which.cast("int").alias(SET), *names)

    pieces = []
    if finest is not None:
        pieces.append(shaped(finest, used, F.lit(sets.index(tuple(used)))))
    grouped = [s for s in dict.fromkeys(sets) if s and (finest is None or s != tuple(used))]
    if len(grouped) == 1:
        only = grouped[0]
        totals = base.groupBy(*only).agg(*results)
        pieces.append(shaped(totals, only, F.lit(sets.index(only))))
    elif grouped:
        totals = base.groupingSets([[F.col(k) for k in s] for s in grouped],
                                   *[F.col(k) for k in used]).agg(
            *results, F.grouping_id().alias("__gid"))
        which = F.lit(None)
        for s in grouped:
            gid = sum(1 << (len(used) - 1 - i) for i, k in enumerate(used) if k not in s)
            which = F.when(F.col("__gid") == gid, F.lit(sets.index(s))).otherwise(which)
        pieces.append(shaped(totals, used, which))
    if () in sets:
        # Grouping sets give no row over an empty frame, a plain aggregate does. The finest
        # groups above are the same exchange, so the rows are not read again.
        pieces.append(shaped(base.agg(*results), (), F.lit(sets.index(()))))
    out = pieces[0]
    for piece in pieces[1:]:
        out = out.unionByName(piece)
    return out


def _ways(measures: Sequence[Measure], several: bool) -> dict:
    """The places of the measures by how these are totalled; each further distinct operand is a way of its own."""
    ways, operands = {}, {}
    for i, m in enumerate(measures):
        operand = m.of if isinstance(m.of, str) else i
        if m.rule.quantile is not None:
            way = ("quantile", operand)
        elif several and m.rule.moments:
            way = ("moments",)
        elif several and m.rule.distinct and operands.setdefault(operand, len(operands)):
            way = ("distinct", operand)
        else:
            way = ("merged",)
        ways.setdefault(way, []).append(i)
    return ways or {("merged",): []}


def _joined(df: DataFrame, keys: Sequence[str], sets: Sequence[tuple[str, ...]], measures: Sequence[Measure], ways: dict) -> DataFrame:
    rows = df.select(*keys, *[m.operand(df).alias(f"__o{i}") for i, m in enumerate(measures)])
    if len(ways) > 1:
        rows = write_down(rows)
    out = None
    for way, places in ways.items():
        how = {"moments": _moments, "quantile": _quantiles}.get(way[0], _merged)
        members = [replace(measures[i], of=None if measures[i].of is None else f"__o{i}") for i in places]
        found = how(rows, keys, sets, members)
        if out is None:
            out = found
            continue
        side = found.select(F.col(SET).alias("__setr"), *[F.col(k).alias(f"__kr{i}") for i, k in enumerate(keys)], *[m.name for m in members])
        match = all_of([F.col(SET) == F.col("__setr"), *[F.col(k).eqNullSafe(F.col(f"__kr{i}")) for i, k in enumerate(keys)]])
        out = out.join(side, match, "inner").drop("__setr", *[f"__kr{i}" for i in range(len(keys))])
    return out.select(*keys, SET, *[m.name for m in measures])


def _shaped(found: DataFrame, keys: Sequence[str], types: dict, present: Sequence[str], number: int, names: Sequence[str]) -> DataFrame:
    return found.select(*[F.col(k) if k in present else F.lit(None).cast(types[k]).alias(k) for k in keys],
                        F.lit(number).cast("int").alias(SET), *names)


def _union(pieces: Sequence[DataFrame]) -> DataFrame:
    out = pieces[0]
    for piece in pieces[1:]:
        out = out.unionByName(piece)
    return out


def _moments(df: DataFrame, keys: Sequence[str], sets: Sequence[tuple[str, ...]], measures: Sequence[Measure]) -> DataFrame:
    """Central moments: a set's mean comes from the finest groups' sums; around it, a finest group adds its own
    squared deviations and those of its mean. Nothing is ever subtracted that is large beside the result."""
    values = {i: F.col(m.of).cast("double") for i, m in enumerate(measures)}
    finest = df.groupBy(*keys).agg(*[c.alias(f"{name}{i}") for i, v in values.items() for name, c in (
        ("__n", F.count(v)), ("__m", F.avg(v)), ("__q", F.var_pop(v) * F.count(v)))])
    finest = write_down(finest)
    types = {k: df.schema[k].dataType for k in keys}
    pieces = []
    for number, chosen in enumerate(sets):
        n = {i: F.sum(f"__n{i}") for i in values}
        means = finest.groupBy(*chosen).agg(*[c.alias(f"{name}{i}") for i in values for name, c in (
            ("__nr", n[i]), ("__mr", F.try_divide(F.sum(F.col(f"__n{i}") * F.col(f"__m{i}")), n[i])))])
        placed = attach(finest, write_down(means), chosen, [f"{name}{i}" for i in values for name in ("__nr", "__mr")])
        around = [F.sum(F.col(f"__q{i}") + F.col(f"__n{i}") * F.pow(F.col(f"__m{i}") - F.col(f"__mr{i}"), 2)).alias(f"__q{i}") for i in values]
        found = placed.groupBy(*chosen).agg(*around, *[F.max(f"{name}{i}").alias(f"{name}{i}") for i in values for name in ("__nr", "__mr")])
        finals = [m.filled(m.rule.moments(F.coalesce(f"__nr{i}", F.lit(0)), F.col(f"__mr{i}"), F.col(f"__q{i}"))).alias(m.name) for i, m in enumerate(measures)]
        pieces.append(_shaped(found.select(*chosen, *finals), keys, types, chosen, number, [m.name for m in measures]))
    return _union(pieces)


def _quantiles(df: DataFrame, keys: Sequence[str], sets: Sequence[tuple[str, ...]], measures: Sequence[Measure]) -> DataFrame:
    """Exact quantiles of one operand: its distinct values, with how often they occur, are sorted by range within
    their group and numbered; those at the wanted ranks are picked. No group is gathered in a task."""
    value = measures[0].of
    counts = write_down(df.groupBy(*keys, F.col(value).cast("double").alias("__v")).agg(F.count("*").alias("__weight")))
    types = {k: df.schema[k].dataType for k in keys}
    pieces = []
    for number, chosen in enumerate(sets):
        known = counts.where("__v is not null").groupBy(*chosen, "__v").agg(F.sum("__weight").alias("__weight"))
        placed = positions(known.withColumn("__turn", F.lit(0)), list(chosen), F.col("__v").asc())
        picked = []
        for i, m in enumerate(measures):
            rank = (F.col("__size") - 1) * m.rule.quantile
            at = lambda r: F.max(F.when((F.col("__pos") <= r) & (r < F.col("__pos") + F.col("__weight")), F.col("__v")))
            low, high, share = at(F.floor(rank)), at(F.ceil(rank)), F.max(rank - F.floor(rank))
            picked.append((low + (high - low) * share).alias(m.name))
        found = placed.groupBy(*chosen).agg(*picked)
        if chosen:  # groups without values
            side = found.withColumnsRenamed({k: f"{k}__r" for k in chosen})
            found = counts.select(*chosen).distinct().join(side, all_of(F.col(k).eqNullSafe(F.col(f"{k}__r")) for k in chosen), "left")
        finals = [m.filled(F.col(m.name)).alias(m.name) for m in measures]
        pieces.append(_shaped(found.select(*chosen, *finals), keys, types, chosen, number, [m.name for m in measures]))
    return _union(pieces)


def attach(rows: DataFrame, totals: DataFrame, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    """``rows`` with the columns ``names`` of their group; ``totals`` has one row per key tuple.

    A join rather than a window: a window would bring a whole group into one task. Callers write
    the totals down first, so Spark knows their size: small ones are broadcast and the rows are
    not shuffled at all, large ones are joined by key with hot keys split.
    """
    if not keys:
        value = totals.select(F.struct(*names).alias("v")).scalar()
        rows = rows.withColumn("__all", value)
        return rows.select("*", *[F.col("__all")[n].alias(n) for n in names]).drop("__all")
    side = totals.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], *names)
    match = all_of(F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys))
    return rows.join(side, match, "inner").drop(*[f"__k{i}" for i in range(len(keys))])
