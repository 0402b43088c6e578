"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks."""

from __future__ import annotations

import heapq
from collections.abc import Callable, Sequence
from fractions import Fraction

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType
from pyspark.sql.window import Window

from ledgerline.session import write_down

REPEATS = 3             # a document's words are taken at most so many times
SHARDS = 1024           # parts of a large source, each with a quota and an order of its own
SHARD_TOKENS = 1 << 16  # a source smaller than this many times SHARDS has fewer parts
BLOCK_TOKENS = 2048     # the largest block
FINEST = 64             # the least target is at least so many blocks, where it has as many tokens


def capped_targets(sizes: Sequence[int], weights: Sequence[int], total: Fraction, repeats: int = REPEATS) -> list[Fraction]:
    """Shares of ``total`` by weight; none is above ``repeats`` times its size, the excess is shared anew."""
    targets, open_ = [Fraction(0)] * len(sizes), set(range(len(sizes)))
    left = Fraction(total)
    while open_:
        weight = sum(weights[i] for i in open_)
        share = {i: left * weights[i] / weight if weight else Fraction(0) for i in open_}
        above = [i for i in open_ if share[i] > repeats * sizes[i]]
        for i in above or open_:
            targets[i] = Fraction(repeats * sizes[i]) if above else share[i]
        if not above:
            break
        left -= sum(targets[i] for i in above)
        open_ -= set(above)
    return targets


def sainte_lague(votes: Sequence, seats: int, most: Sequence[int]) -> list[int]:
    """Seats by the highest quotients votes / (2 * seats held + 1), never more than ``most``; ties go to
    the earlier party. Seats that every such method gives are dealt at once, so the work is that of a
    few seats a party, however many seats there are."""
    parties, all_votes = range(len(votes)), sum(votes)
    held = [0] * len(votes)
    surely = seats - Fraction(len(votes), 2)
    if all_votes and surely > 0:
        divisor = Fraction(all_votes) / surely
        held = [min(most[i], max(0, int((Fraction(votes[i]) / divisor + Fraction(1, 2)) // 1))) for i in parties]
    queue = [(-Fraction(votes[i]) / (2 * held[i] + 1), i) for i in parties if held[i] < most[i] and votes[i]]
    heapq.heapify(queue)
    for _ in range(seats - sum(held)):
        if not queue:
            break
        _, i = heapq.heappop(queue)
        held[i] += 1
        if held[i] < most[i]:
            heapq.heappush(queue, (-Fraction(votes[i]) / (2 * held[i] + 1), i))
    return held


def cycling(sources: Sequence[str | None]) -> list[int]:
    """Weights 1, 2, 3, repeating."""
    return [1 + i % 3 for i in range(len(sources))]


def mix(docs: DataFrame, weights: Callable[[Sequence[str | None]], Sequence[int]] = cycling, share: Fraction = Fraction(1),
        repeats: int = REPEATS, seed: int = 7, block: int | None = None) -> DataFrame:
    """All rows of ``docs`` reduced to ``doc_id, source, text_key, size, source_size, target, taken``.

    ``size`` counts words (runs without white space; null has none). The sources, ordered by code
    point with null last, get ``weights``; their targets share ``share`` of all words and stop at
    ``repeats`` times a source's words. Blocks of equal size are apportioned to sources by target and,
    within a source, to its shards by words. A shard lays its documents out in an order drawn from
    ``seed`` and takes its quota of blocks from there, going round again when it is through; ``taken``
    is how many of a document's words fall into the blocks, repeats counted.

    What reaches the driver is a row for each source and shard, at most ``SHARDS`` a source: weights
    are given per source, so sources are as few as a mix's settings. No text is shuffled. Null and
    empty texts, and sources without words, take nothing; null doc_ids and repeated rows are rows like
    others (equal rows share out their places in any order); an empty table gives an empty result;
    other columns are ignored.
    """
    spark = docs.sparkSession
    sized = write_down(docs.select(
        "doc_id", "source", F.xxhash64("text").alias("text_key"),
        F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long").alias("size")))
    by_source = {r[0]: r[1] for r in sized.groupBy("source").agg(F.sum("size")).collect()}
    names = sorted((s for s in by_source if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in by_source)
    sizes = [by_source[s] for s in names]
    targets = capped_targets(sizes, weights(names), Fraction(sum(sizes)) * share, repeats)
    if block is None:
        least = min((t for t in targets if t > 0), default=Fraction(1))
        block = 1
        while block < BLOCK_TOKENS and 2 * block * FINEST <= least:
            block *= 2
    blocks = sainte_lague(targets, round(sum(targets) / block), [-(-repeats * s // block) for s in sizes])
    rows = [(i, s, n, float(t), min(SHARDS, max(1, n // SHARD_TOKENS)))
            for i, (s, n, t) in enumerate(zip(names, sizes, targets, strict=True))]
    sources = spark.createDataFrame(rows, "source_no int, source_name string, source_size long, target double, shards long")
    dealt = sized.join(sources, F.col("source").eqNullSafe(F.col("source_name"))) \
        .withColumn("shard", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.col("shards")))
    held: dict[int, list[tuple[int, int]]] = {}
    for i, shard, n in dealt.groupBy("source_no", "shard").agg(F.sum("size").alias("n")).where("n > 0").collect():
        held.setdefault(i, []).append((shard, n))
    quotas = []
    for i, shards in held.items():
        shards.sort()
        most = [-(-repeats * n // block) for _, n in shards]
        for (shard, n), q in zip(shards, sainte_lague([n for _, n in shards], blocks[i], most), strict=True):
            quotas.append((i, shard, n, min(q * block, repeats * n)))
    schema = StructType([StructField("source_no", LongType()), StructField("shard", LongType()),
                         StructField("shard_size", LongType()), StructField("quota", LongType())])
    order = Window.partitionBy("source_no", "shard").orderBy(
        F.md5(F.concat_ws(":", F.lit(seed).cast(StringType()), F.col("doc_id").cast("string"))), "doc_id", "size", "text_key") \
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum("size").over(order)
    laid = dealt.withColumn("start", end - F.col("size")).join(spark.createDataFrame(quotas, schema), ["source_no", "shard"], "left")
    rest = F.expr("quota % shard_size")
    again = F.least(F.greatest(rest - F.col("start"), F.lit(0)), F.col("size"))
    taken = F.when(F.col("size") > 0, F.expr("quota div shard_size") * F.col("size") + again).otherwise(0)
    return laid.select("doc_id", "source", "text_key", "size", "source_size", "target",
                       F.coalesce(taken, F.lit(0)).cast("long").alias("taken"))
