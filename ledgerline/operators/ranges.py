"""Ranges of positions along a field, answered by dyadic blocks instead of pairs of rows.

Rows of a key are numbered along a field. A block holds the 2**level positions from ``block * 2**level``
on; each row lies in one block of every level, and any range of positions is made of few blocks: at most one
a level for a prefix, two a level for any other range. So records meet rows by an equality of (key,
level, block), and what is joined or added up grows with n log n, also within one hot key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions.values import all_of
from ledgerline.session import write_down

BLOCK = ["__level", "__block"]


def _right(a: Column, by: Column) -> Column:
    return F.call_function("shiftright", a, by)


def _left(a: Column, by: Column) -> Column:
    return F.call_function("shiftleft", a, by)


def _bit(a: Column, level: Column) -> Column:
    return _right(a, level).bitwiseAND(F.lit(1).cast("long")) == 1


def _levels(most: Column) -> Column:
    """0 up to the highest bit of ``most``."""
    return F.sequence(F.lit(0), F.length(F.bin(most)) - 1)


def _block(level: Column, block: Column) -> Column:
    return F.struct(level.alias(BLOCK[0]), block.alias(BLOCK[1]))


def prefix_blocks(end: Column) -> Column:
    """The blocks that make up the positions from 0 to before ``end``: one for each of its bits, all even."""
    bits = F.filter(_levels(end), lambda level: _bit(end, level))
    return F.transform(bits, lambda level: _block(level, _right(end, level) - 1))


def prefix_blocks_of(pos: Column, size: Column) -> Column:
    """The blocks of a position that a prefix of ``size`` rows or fewer can be made of."""
    asked = F.filter(_levels(size), lambda level: ~_bit(pos, level) & (_left(_right(pos, level) + 1, level) <= size))
    return F.transform(asked, lambda level: _block(level, _right(pos, level)))


def range_blocks(low: Column, high: Column) -> Column:
    """The blocks that make up the positions from ``low`` to before ``high``, which must be greater: below and
    above the multiple of the greatest power of two between them."""
    top = F.length(F.bin(low.bitwiseXOR(high))) - 1
    middle = _left(_right(high, top), top)
    below, above = middle - low, high - middle
    start = lambda level: middle - _left(_right(below, level), level)
    end = lambda level: middle + _left(_right(above, level), level)
    parts = [F.transform(F.filter(_levels(n), lambda level: _bit(n, level)), made) for n, made in (
        (below, lambda level: _block(level, _right(start(level), level))),
        (above, lambda level: _block(level, _right(end(level), level) - 1)))]
    return F.concat(*parts)


def blocks_of(pos: Column, size: Column) -> Column:
    """The blocks of a position that lie within ``size`` rows."""
    whole = F.filter(_levels(size), lambda level: _left(_right(pos, level) + 1, level) <= size)
    return F.transform(whole, lambda level: _block(level, _right(pos, level)))


def in_blocks(df: DataFrame, blocks: Column, *kept: str) -> DataFrame:
    """A row per block, with the columns ``kept``."""
    return df.select(*kept, F.explode(blocks).alias("__b")).select(*kept, *[F.col(f"__b.{c}").alias(c) for c in BLOCK])


def positions(events: DataFrame, keys: Sequence[str], at: Column, *ties: Column) -> DataFrame:
    """``events`` with ``__pos``, how many rows of the key come before, and ``__size``, how many it has.

    Rows have ``__turn`` 0; asks have another, and stand before (less) or after (more) the rows of an
    equal place. Events are sorted by range over the whole cluster and pinned; a count is the one
    inside the part plus what the key's earlier parts hold, of which there is one row per key and part.
    ``ties`` spread equal places. With a column ``__weight`` a row counts that often.
    """
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    pinned = write_down(events.orderBy(*keys, at, "__turn", *ties).select(
        "*", F.spark_partition_id().alias("__part"), place.alias("__i")))
    one = F.when(F.col("__turn") == 0, F.col("__weight") if "__weight" in events.columns else F.lit(1).cast("long")).otherwise(0)
    inside = Window.partitionBy("__part", *keys).orderBy("__i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = pinned.withColumn("__pos", F.sum(one).over(inside) - one)
    every = Window.partitionBy(*keys)
    earlier = every.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    held = pinned.groupBy("__part", *keys).agg(F.sum(one).alias("__n"))
    held = held.select(F.col("__part").alias("__partr"), *[F.col(k).alias(f"{k}h") for k in keys],
                       F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"), F.sum("__n").over(every).alias("__size"))
    same = all_of([F.col("__part") == F.col("__partr"), *[F.col(k).eqNullSafe(F.col(f"{k}h")) for k in keys]])
    both = counted.join(held, same, "inner").withColumn("__pos", F.col("__pos") + F.col("__before"))
    return both.drop("__i", "__partr", "__before", *[f"{k}h" for k in keys])


def with_previous(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """``rows`` of :func:`positions` with ``__previous``, the position before at which the key has the same
    value, -1 without any. A value with many rows is followed within the parts and from part to part."""
    inside = Window.partitionBy("__part", *keys, value).orderBy("__pos")
    last = rows.groupBy("__part", *keys, value).agg(F.max("__pos").alias("__last"))
    earlier = Window.partitionBy(*keys, value).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    names = ["__part", *keys, value]
    last = last.select(*[F.col(c).alias(f"{c}h") for c in names], F.max("__last").over(earlier).alias("__before"))
    same = all_of(F.col(c).eqNullSafe(F.col(f"{c}h")) for c in names)
    both = rows.withColumn("__previous", F.lag("__pos").over(inside)).join(last, same, "inner")
    found = F.coalesce("__previous", "__before", F.lit(-1)).cast("long")
    return both.withColumn("__previous", found).drop("__before", *[f"{c}h" for c in names])
