"""Blocks repeated per record (L1-L5): records, correlated lookups and aggregates, block rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions import values as V
from ledgerline.functions.aggregates import COMBINE, COMBINE_TWO, Measure
from ledgerline.functions.predicates import Condition, filter_all
from ledgerline.operators.levels import SET, level_totals
from ledgerline.operators.ordering import distinct_first, number_rows, tie_break
from ledgerline.operators.ranges import BLOCK, blocks_of, in_blocks, positions, prefix_blocks, prefix_blocks_of, range_blocks, with_previous
from ledgerline.session import write_down

Pairs = Sequence[tuple[str, str]]


def records(driving: DataFrame, where: Sequence[Condition] = (), group_by: Sequence[str] = (),
            order_by: Sequence[str | Column] = ()) -> DataFrame:
    """L1, L2: the records a block repeats for; with ``group_by`` the first one per group."""
    found = filter_all(driving, *where)
    if group_by:
        found = distinct_first(found, group_by, order_by or group_by)
    return found.orderBy(*order_by, *tie_break(found, found.columns)) if order_by else found


def _keyed(recs: DataFrame, other: DataFrame, on: Pairs) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both sides with join keys that are equal exactly when the fields are loosely equal."""
    left, right, names = {}, {}, []
    for i, (mine, theirs) in enumerate(on):
        a, b = V.kind(recs, mine), V.kind(other, theirs)
        plain = a == b and a != V.TEXT
        left[f"__e{i}"] = F.col(mine) if plain else V.code_text(recs, mine)
        right[f"__e{i}"] = F.col(theirs) if plain else V.code_text(other, theirs)
        names.append(f"__e{i}")
    return recs.withColumns(left), other.withColumns(right), names


def _match(recs: DataFrame, found: DataFrame, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    if not keys:
        # The same row for every record.
        value = found.select(F.struct(*names).alias("v")).scalar()
        whole = recs.withColumn("__all", value)
        return whole.select("*", *[F.col("__all")[n].alias(n) for n in names]).drop("__all")
    side = found.select(*[F.col(k).alias(f"{k}r") for k in keys], *names)
    on = V.all_of(F.col(k).eqNullSafe(F.col(f"{k}r")) for k in keys)
    return recs.join(side, on, "left").drop(*keys, *[f"{k}r" for k in keys])


def lookup(recs: DataFrame, other: DataFrame, on: Pairs, take: Mapping[str, str | Column],
           order_by: Sequence[str | Column], where: Sequence[Condition] = (),
           threshold: tuple[str, str, str] | None = None) -> DataFrame:
    """L3: values of the first matching row of ``other``, null without a match.

    ``on`` pairs record fields with fields of ``other``; ``where`` are its remaining conditions.
    One row per key is kept before anything is joined. ``threshold`` adds one inequality ``(other
    field, op, record field)``, say the first row not before the record's date; the first row is then
    the running least one in ``order_by``, which takes ascending columns.
    """
    if threshold:
        row = F.struct(*[V.col_of(c).alias(f"o{i}") for i, c in enumerate(order_by)], *[V.col_of(c).alias(name) for name, c in take.items()])
        first = correlate(recs, other, on, [Measure("__first", "MIN", row, typed=True)], where, threshold)
        return first.select(*recs.columns, *[F.col(f"__first.{name}").alias(name) for name in take])
    recs, other, keys = _keyed(recs, filter_all(other, *where), on)
    first = distinct_first(other, keys, order_by) if keys else other.orderBy(*order_by).limit(1)
    found = first.select(*keys, *[V.col_of(c).alias(name) for name, c in take.items()])
    return _match(recs, found, keys, list(take))


def correlate(recs: DataFrame, other: DataFrame, on: Pairs, measures: Sequence[Measure],
              where: Sequence[Condition] = (), threshold: tuple[str, str, str] | None = None) -> DataFrame:
    """L4: aggregates over the matching rows of ``other``, zeros without a match.

    ``threshold`` adds one inequality ``(other field, op, record field)`` with op GT, GE, LT, LE
    or NE. ``other`` is aggregated by its key before it meets the records, so no pairs are formed. For
    COUNT_DISTINCT, each value counts from its first position on, and so once; with NE all values count but
    those whose only place is the record's.
    """
    distinct = [m for m in measures if threshold and m.rule.distinct]
    if distinct:
        rest = [m for m in measures if not m.rule.distinct]
        out = correlate(recs, other, on, rest, where, threshold) if rest else recs
        other = filter_all(other, *where)
        for m in distinct:
            counted = Measure(m.name, "COUNT", empty=m.empty)
            if threshold[1] == "NE":
                out = _distinct_elsewhere(out, other, on, m, threshold)
            else:
                out = correlate(out, _first_places(other, on, m, threshold), on, [counted], (), threshold)
        return out.select(*recs.columns, *[m.name for m in measures])
    recs, other, keys = _keyed(recs, filter_all(other, *where), on)
    names = [m.name for m in measures]
    if threshold:
        return _running(recs, other, keys, measures, *threshold)
    found = level_totals(other, keys, [keys], measures).drop(SET)
    out = _match(recs, found, keys, names)
    return out.withColumns({m.name: m.filled(F.col(m.name)) for m in measures})


def _first_places(other: DataFrame, on: Pairs, measure: Measure, threshold: tuple[str, str, str]) -> DataFrame:
    """A row per key and value, at the place from which on the value counts."""
    field, op, _ = threshold
    place = F.struct(F.col(field).isNull(), F.col(field).alias("at"))  # a missing place is the greatest
    pick = F.min if op in ("LT", "LE") else F.max
    keys = [theirs for _, theirs in on]
    kept = other.groupBy(*[F.col(k) for k in keys if k != field], *([F.col(field).alias("__same")] if field in keys else []),
                         F.struct(measure.operand(other)).alias("__value")).agg(pick(place)["at"].alias(field))
    return kept.select(*keys, *([field] if field not in keys else []))


def _distinct_elsewhere(recs: DataFrame, other: DataFrame, on: Pairs, measure: Measure, threshold: tuple[str, str, str]) -> DataFrame:
    """The distinct values of rows whose field is unequal to the record's bound: all of the key less those
    whose rows all lie at the bound."""
    field, _, bound = threshold
    columns = recs.columns
    mixed = V.kind(other, field) != V.kind(recs, bound) or V.kind(other, field) not in (V.NUMBER, V.DATE, V.DATETIME)
    recs, other, keys = _keyed(recs, other, on)
    place = F.struct(F.col("__at").isNull(), "__at")
    spans = other.withColumn("__at", _comparable(other, field, False, mixed)) \
        .groupBy(*keys, F.struct(measure.operand(other)).alias("__value")).agg(F.min(place).alias("__low"), F.max(place).alias("__high"))
    total = spans.groupBy(*keys).agg(F.count("*").alias("__all_values"))
    only = spans.where(F.col("__low") == F.col("__high")).groupBy(*keys, F.col("__low")["__at"].alias("__bound")) \
        .agg(F.count("*").alias("__only"))
    out = _match(recs.withColumns({f"{k}b": F.col(k) for k in keys}), total, keys, ["__all_values"])
    out = out.withColumnsRenamed({f"{k}b": k for k in keys}).withColumn("__bound", _comparable(recs, bound, False, mixed))
    out = _match(out, only, [*keys, "__bound"], ["__only"])
    count = F.col("__all_values") - F.coalesce("__only", F.lit(0))
    return out.select(*columns, measure.filled(F.when(count > 0, count)).alias(measure.name))


def correlate_between(recs: DataFrame, other: DataFrame, on: Pairs, measures: Sequence[Measure], field: str,
                      low: str, high: str, where: Sequence[Condition] = ()) -> DataFrame:
    """L4 over an interval: aggregates of the matching rows whose ``field`` lies from the record's ``low`` to its
    ``high``, both included.

    COUNT, SUM and AVG are the difference of two running totals, so sums are exact to the rounding of the
    larger running total. Other aggregates that are merged from parts (MIN, MAX) put together the dyadic
    blocks of positions that the interval is made of. For COUNT_DISTINCT a value counts where it occurs
    first within the interval, that is where its position before lies below. No pairs are formed. A missing
    bound is the greatest value, and an interval that ends before it begins is empty.
    """
    apart = [m for m in measures if m.how in ("COUNT", "SUM", "AVG")]
    merged = [m for m in measures if m not in apart and m.rule.parts is not None]
    distinct = [m for m in measures if m.rule.distinct]
    if len(apart) + len(merged) + len(distinct) < len(measures):
        raise ValueError("an interval takes COUNT_DISTINCT and aggregates that are merged from parts")
    out, other = recs, filter_all(other, *where)
    if apart:
        out = _between_totals(out, other, on, apart, field, low, high)
    if merged:
        out = _between_blocks(out, other, on, merged, field, low, high)
    for m in distinct:
        out = _between_distinct(out, other, on, m, field, low, high)
    return out.select(*recs.columns, *[m.name for m in measures])


def _between_totals(recs: DataFrame, other: DataFrame, on: Pairs, measures: Sequence[Measure], field: str, low: str, high: str) -> DataFrame:
    parts = [p for i, m in enumerate(measures) for p in (
        Measure(f"__s{i}", "SUM", m.of), Measure(f"__n{i}", "COUNT", None) if m.how == "COUNT" else
        Measure(f"__n{i}", "SUM", V.number(other, m.of).isNotNull().cast("double")))]
    upto = correlate(recs, other, on, parts, (), (field, "LE", high))
    both = upto.withColumnsRenamed({p.name: f"{p.name}h" for p in parts})
    both = correlate(both, other, on, parts, (), (field, "LT", low))
    empty = F.coalesce(F.col(low) > F.col(high), F.col(low).isNull() & F.col(high).isNotNull())
    apart = lambda name: F.when(empty, 0).otherwise(F.col(f"{name}h") - F.col(name))
    found = {}
    for i, m in enumerate(measures):
        s, n = apart(f"__s{i}"), apart(f"__n{i}")
        found[m.name] = {"COUNT": n, "SUM": m.filled(F.when(n > 0, s)), "AVG": m.filled(F.try_divide(s, n))}[m.how]
    return both.select(*recs.columns, *[c.alias(name) for name, c in found.items()])


def _partial(measures: Sequence[Measure], other: DataFrame) -> dict[str, tuple[str, Column]]:
    return {f"__p{i}_{part}": (part, column) for i, m in enumerate(measures) for part, column in m.rule.parts(m.operand(other)).items()}


def _combined(parts: Mapping[str, tuple[str, Column]]) -> list[Column]:
    return [COMBINE[part](F.col(n)).alias(n) for n, (part, _) in parts.items()]


def _finals(measures: Sequence[Measure], parts: Mapping[str, tuple[str, Column]]) -> list[Column]:
    return [m.filled(m.rule.finish({part: F.col(n) for n, (part, _) in parts.items() if n.startswith(f"__p{i}_")})).alias(m.name)
            for i, m in enumerate(measures)]


def _ordered(recs: DataFrame, other: DataFrame, field: str, *bounds: str) -> None:
    kinds = {V.kind(other, field), *(V.kind(recs, b) for b in bounds)}
    if len(kinds) > 1 or not kinds <= {V.NUMBER, V.DATE, V.DATETIME}:
        raise ValueError(f"a threshold compares two numbers or two moments, not {' and '.join(sorted(kinds))}")


def _interval_positions(recs: DataFrame, rows: DataFrame, keys: list[str], low: str, high: str, *ties: str) -> tuple[DataFrame, DataFrame]:
    """``rows`` with their positions, and for each distinct interval of a key the positions ``__a`` to before ``__b`` that it holds."""
    asked = recs.select(*keys, F.col(low).alias("__low"), F.col(high).alias("__high")).distinct()
    ends = F.explode(F.array(F.struct(F.col("__low").alias("at"), F.lit(-1).alias("turn")), F.struct(F.col("__high").alias("at"), F.lit(1).alias("turn"))))
    ends = asked.withColumn("__end", ends).select(*keys, "__low", "__high", F.col("__end.at").alias("__at"), F.col("__end.turn").alias("__turn"))
    events = rows.withColumn("__turn", F.lit(0)).unionByName(ends, allowMissingColumns=True)
    placed = positions(events, keys, F.col("__at").asc_nulls_last(), *[F.xxhash64(c) for c in ("__low", "__high", *ties)])
    at = lambda turn: F.max(F.when(F.col("__turn") == turn, F.col("__pos")))
    spans = placed.where("__turn != 0").groupBy(*keys, "__low", "__high").agg(at(-1).alias("__a"), at(1).alias("__b"))
    return placed.where("__turn = 0"), spans.where("__a < __b")


def _between_blocks(recs: DataFrame, other: DataFrame, on: Pairs, measures: Sequence[Measure], field: str, low: str, high: str) -> DataFrame:
    _ordered(recs, other, field, low, high)
    columns = recs.columns
    recs, other, keys = _keyed(recs, other, on)
    parts = _partial(measures, other)
    totals = other.groupBy(*keys, F.col(field).alias("__at")).agg(*[column.alias(n) for n, (_, column) in parts.items()])
    rows, spans = _interval_positions(recs, totals, keys, low, high)
    held = in_blocks(rows, blocks_of(F.col("__pos"), F.col("__size")), *keys, *parts).groupBy(*keys, *BLOCK).agg(*_combined(parts))
    asks = in_blocks(spans, range_blocks(F.col("__a"), F.col("__b")), *keys, "__low", "__high")
    found = _by_keys(asks, held, [*keys, *BLOCK]).groupBy(*keys, "__low", "__high").agg(*_combined(parts))
    found = found.select(*keys, "__low", "__high", *_finals(measures, parts))
    out = _match(recs.withColumns({"__low": F.col(low), "__high": F.col(high)}), found, [*keys, "__low", "__high"], [m.name for m in measures])
    return out.select(*columns, *[m.filled(F.col(m.name)).alias(m.name) for m in measures])


def _between_distinct(recs: DataFrame, other: DataFrame, on: Pairs, measure: Measure, field: str, low: str, high: str) -> DataFrame:
    _ordered(recs, other, field, low, high)
    columns = recs.columns
    recs, other, keys = _keyed(recs, other, on)
    values = other.select(*keys, F.col(field).alias("__at"), F.struct(measure.operand(other).alias("v")).alias("__value")).distinct()
    rows, spans = _interval_positions(recs, values, keys, low, high, "__value")
    # Before ``__b`` and with its previous position before ``__a``: all of these before ``__a``, and what is first within.
    rows = with_previous(rows, keys, "__value").select(*keys, "__pos", "__size", F.col("__previous").alias("__at"), F.lit(1).cast("long").alias("__p0_n"))
    parts = {"__p0_n": ("n", F.col("__p0_n"))}
    asks = in_blocks(spans, prefix_blocks(F.col("__b")), *keys, "__low", "__high", "__a").withColumnRenamed("__a", "__at")
    found = _block_totals(rows, asks, keys, parts, "LT", ["__low", "__high"])
    found = found.groupBy(*keys, "__low", "__high").agg((F.sum("__p0_n") - F.first("__bound")).alias(measure.name))
    out = _match(recs.withColumns({"__low": F.col(low), "__high": F.col(high)}), found, [*keys, "__low", "__high"], [measure.name])
    return out.select(*columns, measure.filled(F.col(measure.name)).alias(measure.name))


def correlate_both(recs: DataFrame, other: DataFrame, on: Pairs, measures: Sequence[Measure], first: tuple[str, str, str],
                   second: tuple[str, str, str], where: Sequence[Condition] = ()) -> DataFrame:
    """L4 with two inequalities on fields of their own, each ``(other field, op, record field)`` with op GT, GE,
    LT or LE: aggregates that are merged from parts over the rows that meet both.

    Rows are numbered along the first field, so the rows that meet a record's first inequality are a
    prefix, made of at most one dyadic block a level. Within each block, running totals along the second
    field answer the other. What is sorted and added up grows with n log n, also within one hot key;
    no pairs are formed. A missing value compares as the greatest.
    """
    if any(m.rule.parts is None for m in measures):
        raise ValueError("two thresholds take aggregates that are merged from parts")
    for field, op, bound in (first, second):
        if op not in ("GT", "GE", "LT", "LE"):
            raise ValueError(f"two thresholds take GT, GE, LT or LE, not {op!r}")
        _ordered(recs, other, field, bound)
    columns = recs.columns
    recs, other, keys = _keyed(recs, filter_all(other, *where), on)
    parts = _partial(measures, other)
    rows = other.groupBy(*keys, F.col(first[0]).alias("__at"), F.col(second[0]).alias("__then")) \
        .agg(*[column.alias(n) for n, (_, column) in parts.items()]).withColumn("__turn", F.lit(0))
    recs = recs.withColumns({"__one": F.col(first[2]), "__two": F.col(second[2])})
    asked = recs.select(*keys, "__one", "__two").distinct()
    asks = asked.select("*", F.col("__one").alias("__at"), F.lit(1 if first[1] in ("GE", "LE") else -1).alias("__turn"))
    at = F.col("__at").asc_nulls_last() if first[1] in ("LT", "LE") else F.col("__at").desc_nulls_first()
    placed = positions(rows.unionByName(asks, allowMissingColumns=True), keys, at, F.xxhash64("__then", "__two"))
    rows = placed.where("__turn = 0").select(*keys, "__pos", "__size", F.col("__then").alias("__at"), *parts)
    asks = in_blocks(placed.where("__turn != 0"), prefix_blocks(F.col("__pos")), *keys, "__one", "__two")
    found = _block_totals(rows, asks.withColumn("__at", F.col("__two")), keys, parts, second[1], ["__one", "__two"])
    found = found.groupBy(*keys, "__one", "__two").agg(*_combined(parts)).select(*keys, "__one", "__two", *_finals(measures, parts))
    out = _match(recs, found, [*keys, "__one", "__two"], [m.name for m in measures])
    return out.select(*columns, *[m.filled(F.col(m.name)).alias(m.name) for m in measures])


def _block_totals(rows: DataFrame, asks: DataFrame, keys: list[str], parts: Mapping[str, tuple[str, Column]], op: str,
                  carry: Sequence[str]) -> DataFrame:
    """For each ask of a block, the partial results of the block's rows whose ``__at`` lies beyond the ask's (``__bound``)."""
    dealt = in_blocks(rows, prefix_blocks_of(F.col("__pos"), F.col("__size")), *keys, "__at", *parts)
    totals = dealt.groupBy(*keys, *BLOCK, "__at").agg(*_combined(parts))
    return _running_parts(totals, asks, [*keys, *BLOCK], parts, op, carry)


def _by_keys(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    side = right.withColumnsRenamed({k: f"{k}r" for k in keys})
    return left.join(side, V.all_of(F.col(k).eqNullSafe(F.col(f"{k}r")) for k in keys), "inner").drop(*[f"{k}r" for k in keys])


def correlate_containing(recs: DataFrame, other: DataFrame, on: Pairs, measures: Sequence[Measure], field: str, needle: str,
                         where: Sequence[Condition] = ()) -> DataFrame:
    """L4 with a text search: aggregates, merged from parts, of the matching rows whose ``field`` contains the
    record's ``needle`` (P7: both as text; a missing one is in nothing, an empty one in every text).

    An inverted index of grams finds the rows: a needle is sought by the rarest of its grams of ``GRAM``
    characters, a shorter needle by itself among grams of its length, and ``contains`` verifies. Only
    grams of needles are indexed, and equal texts and equal needles count as one. Rows meet needles by
    an equality of (key, gram), whose hot values Spark splits.
    """
    if any(m.rule.parts is None for m in measures):
        raise ValueError("a text search takes aggregates that are merged from parts")
    columns = recs.columns
    recs, other, keys = _keyed(recs, filter_all(other, *where), on)
    recs = recs.withColumn("__needle", V.plain_text(recs, needle))
    parts = _partial(measures, other)
    texts = other.groupBy(*keys, V.plain_text(other, field).alias("__text")).agg(*[c.alias(n) for n, (_, c) in parts.items()])
    texts = write_down(texts.where("__text is not null").withColumn("__id", F.monotonically_increasing_id()))
    needles = write_down(recs.select(*keys, "__needle").where("__needle is not null").distinct())
    sought = write_down(needles.where("__needle != ''").select(*keys, "__needle", F.explode(_grams(F.col("__needle"))).alias("__gram")))
    known = write_down(sought.select("__gram").distinct())
    made = F.array_distinct(F.flatten(F.array(*[_grams_of(F.col("__text"), n) for n in range(1, GRAM + 1)])))
    index = write_down(texts.select(*keys, "__id", F.explode(made).alias("__gram")).join(known, "__gram", "left_semi"))
    rows = index.groupBy(*keys, "__gram").agg(F.count("*").alias("__rows"))
    # A gram of the needle that no text of the key has leaves nothing to find.
    rarest = _by_keys(sought, rows, [*keys, "__gram"]).groupBy(*keys, "__needle").agg(
        F.min(F.struct("__rows", "__gram")).alias("__rare"), F.count("*").alias("__grams"))
    rarest = rarest.where(F.col("__grams") == F.size(_grams(F.col("__needle")))).select(*keys, "__needle", F.col("__rare.__gram").alias("__gram"))
    # Texts are read once more for what may hold a needle, not carried along with each gram.
    held = _by_keys(index, rarest, [*keys, "__gram"]).select("__id", "__needle").join(texts, "__id").where(F.contains("__text", F.col("__needle")))
    everywhere = texts.groupBy(*keys).agg(*_combined(parts)).withColumn("__needle", F.lit(""))
    found = held.groupBy(*keys, "__needle").agg(*_combined(parts)).unionByName(everywhere)
    found = found.select(*keys, "__needle", *_finals(measures, parts))
    out = _match(recs, found, [*keys, "__needle"], [m.name for m in measures])
    return out.select(*columns, *[m.filled(F.col(m.name)).alias(m.name) for m in measures])


GRAM = 3  # characters


def _grams_of(text: Column, n: int | Column) -> Column:
    """The distinct runs of ``n`` characters of a text, none of a shorter one."""
    last = F.length(text) - n + 1
    return F.when(last >= 1, F.array_distinct(F.transform(F.sequence(F.lit(1), last), lambda i: F.substring(text, i, F.lit(n) if isinstance(n, int) else n)))) \
        .otherwise(F.array().cast("array<string>"))


def _grams(needle: Column) -> Column:
    return _grams_of(needle, F.least(F.lit(GRAM), F.length(needle)))


def _comparable(df: DataFrame, field: str, order_matters: bool, mixed: bool) -> Column:
    """The field as something to sort by; for mere inequality the loose code of text will do."""
    return F.coalesce(V.code_text(df, field), F.lit(V.NULL_TEXT)) if mixed and not order_matters else F.col(field)


def _running(recs: DataFrame, other: DataFrame, keys: list[str], measures: Sequence[Measure],
             field: str, op: str, bound: str) -> DataFrame:
    """Aggregates over the rows beyond each record's bound, as running totals by key and value."""
    if op not in ("GT", "GE", "LT", "LE", "NE"):
        raise ValueError(f"threshold takes GT, GE, LT, LE or NE, not {op!r}")
    if any(m.rule.parts is None for m in measures):
        raise ValueError("a threshold takes aggregates that are merged from parts")
    a, b = V.kind(other, field), V.kind(recs, bound)
    mixed = a != b or a not in (V.NUMBER, V.DATE, V.DATETIME)
    if mixed and op != "NE":
        raise ValueError(f"a threshold compares two numbers or two moments, not {a} and {b}")

    parts = _partial(measures, other)
    at = lambda df, name: _comparable(df, name, op != "NE", mixed).alias("__at")
    totals = other.groupBy(*keys, at(other, field)).agg(*[column.alias(n) for n, (_, column) in parts.items()])
    recs = recs.withColumn("__bound", at(recs, bound))
    bounds = recs.select(*keys, F.col("__bound").alias("__at")).distinct()
    # Unequal is less or greater.
    sides = [_running_parts(totals, bounds, keys, parts, side) for side in (("LT", "GT") if op == "NE" else (op,))]
    found = sides[0] if len(sides) == 1 else sides[0].unionByName(sides[1]).groupBy(*keys, "__bound").agg(*_combined(parts))
    found = found.select(*keys, "__bound", *_finals(measures, parts))
    return _match(recs, found, [*keys, "__bound"], [m.name for m in measures])


def _running_parts(totals: DataFrame, bounds: DataFrame, keys: list[str], parts: Mapping[str, tuple[str, Column]],
                   op: str, carry: Sequence[str] = ()) -> DataFrame:
    """Partial results of all ``totals`` of the key that lie beyond each of the ``bounds``, which keep ``carry``.

    Both sides hold distinct (key, value), with ``carry``, and are sorted by range over the whole cluster, so a hot
    key spreads over many parts. A running total is the one inside the part plus what the key's
    earlier parts hold, of which there is one row per key and part.
    """
    # Rows equal to the bound count for GE and LE: they then sort before it.
    turn = 1 if op in ("GE", "LE") else -1
    events = totals.withColumn("__turn", F.lit(0)).unionByName(
        bounds.withColumn("__turn", F.lit(turn)), allowMissingColumns=True)
    # A missing value compares as the greatest.
    at = F.col("__at").asc_nulls_last() if op in ("LT", "LE") else F.col("__at").desc_nulls_first()
    pinned = write_down(events.orderBy(*keys, at, "__turn", *carry).select("*", F.spark_partition_id().alias("__part")))

    inside = Window.partitionBy("__part", *keys).orderBy(at, "__turn").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    running = pinned.withColumns({n: COMBINE[part](F.col(n)).over(inside) for n, (part, _) in parts.items()})
    running = running.filter(F.col("__turn") != 0)

    earlier = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    held = pinned.groupBy("__part", *keys).agg(
        *[COMBINE[part](F.col(n)).alias(n) for n, (part, _) in parts.items()])
    held = held.select(F.col("__part").alias("__partr"), *[F.col(k).alias(f"{k}h") for k in keys],
                       *[COMBINE[part](F.col(n)).over(earlier).alias(f"{n}h") for n, (part, _) in parts.items()])
    same = V.all_of([F.col("__part") == F.col("__partr"),
                     *[F.col(k).eqNullSafe(F.col(f"{k}h")) for k in keys]])
    both = running.join(held, same, "inner")
    return both.select(*keys, *carry, F.col("__at").alias("__bound"), *[
        COMBINE_TWO[part](F.col(n), F.col(f"{n}h")).alias(n) for n, (part, _) in parts.items()])


def block_rows(recs: DataFrame, block: Sequence[Mapping[str, Column]], order_by: Sequence[str | Column],
               keep: Sequence[str] = ()) -> DataFrame:
    """The block's rows for every record; ``row_no`` is record position times block height."""
    placed = number_rows(recs, order_by, "record_no")
    names = list(dict.fromkeys(name for row in block for name in row))
    structs = F.array(*[F.struct(*[V.display_text(placed, row.get(n, F.lit(None).cast("string"))).alias(n)
                                   for n in names]) for row in block])
    out = placed.select(*keep, "record_no", F.posexplode(structs).alias("block_row", "__cells"))
    return out.select(*keep, "record_no", "block_row",
                      (F.col("record_no") * len(block) + F.col("block_row")).alias("row_no"),
                      *[F.col(f"__cells.{n}").alias(n) for n in names])
