"""What each filter of a chain removes, in every order of the filters, by a walk over their subsets."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.session import write_down

SPACE = r"[\x20\x09-\x0D]+"
# The filters by letter; each bit of a mask is one failure, A the lowest. E needs other texts as well.
FILTERS = "ABCDE"
COPY = 1 << FILTERS.index("E")
WEIGHTS = ("n", "good", "toxic")
ROW = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, " \
    "good_lost long, toxic_lost long, shapley long"


def _text_mask(text: Column, words: Column) -> Column:
    fails = (F.size(words) < 200, 100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
             100 * F.regexp_count(text, F.lit("[A-Z]")) > 3 * F.length(text), text.rlike("[#$%&*|]"))
    return sum((fail.cast("int") * (1 << i) for i, fail in enumerate(fails)), F.lit(0))


def mask_cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``part, mask, n, good, toxic``: the documents of each part that fail exactly the filters of a mask.

    Copies fail what their text fails, and E unless they have its least ``doc_id``; that one is joined
    back by id and text, so a text of any number of copies is spread by their ids.
    """
    text = F.coalesce("text", F.lit(""))
    split = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), text.alias("text"),
                        F.array_remove(F.split(text, SPACE), "").alias("words"))
    rows = write_down(split.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"),
                                   _text_mask(F.col("text"), F.col("words")).alias("mask")))
    named = rows.where("doc_id is not null").groupBy("doc_id", "part", "digest", "mask").agg(F.count("*").alias("n"))
    first = rows.where("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    marks = labels.where("doc_id is not null").groupBy("doc_id").agg(
        F.max((F.col("quality") == 1).cast("long")).alias("good"), F.max((F.col("toxic") == 1).cast("long")).alias("toxic"))
    joined = named.join(first, ["doc_id", "digest"], "left").join(marks, "doc_id", "left")
    mask = F.col("mask") + F.when(F.col("first").isNull(), COPY).otherwise(0)
    weight = lambda c: (F.col("n") * F.coalesce(c, F.lit(0))).alias(c)
    cells = joined.select("part", mask.alias("mask"), "n", weight("good"), weight("toxic"))
    zero = F.lit(0).cast("long")
    nameless = rows.where("doc_id is null").groupBy("part", "mask").agg(F.count("*").alias("n"))
    cells = cells.unionByName(nameless.select("part", "mask", "n", zero.alias("good"), zero.alias("toxic")))
    return cells.groupBy("part", "mask").agg(*[F.sum(w).alias(w) for w in WEIGHTS])


def survivors(masks: np.ndarray, weights: np.ndarray, filters: int) -> np.ndarray:
    """The weights that survive each subset of the filters, a row a subset.

    A reflected Gray code visits all subsets and toggles one filter at a time. Each cell counts its
    active failures; it leaves the running survivors when the first comes and returns when the last goes.
    """
    active = np.zeros(len(masks), np.int64)
    alive = weights.sum(axis=0)
    states = np.zeros((1 << filters, weights.shape[1]), np.int64)
    states[0] = alive
    subset = 0
    for step in range(1, 1 << filters):
        bit = step & -step
        subset ^= bit
        cells = np.flatnonzero(masks & bit)
        if subset & bit:
            alive = alive - weights[cells[active[cells] == 0]].sum(axis=0)
            active[cells] += 1
        else:
            active[cells] -= 1
            alive = alive + weights[cells[active[cells] == 0]].sum(axis=0)
        states[subset] = alive
    return states


def order_rows(states: np.ndarray, filters: str) -> Iterator[tuple]:
    """``filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley`` of every
    order of the filters; each figure is a difference of stored states."""
    full = len(states) - 1
    fails = {f: int(states[0, 0] - states[1 << i, 0]) for i, f in enumerate(filters)}
    alone = {f: int(states[full ^ 1 << i, 0] - states[full, 0]) for i, f in enumerate(filters)}
    found, sums = [], dict.fromkeys(filters, 0)
    for order in permutations(filters):
        subset = 0
        for step, f in enumerate(order, 1):
            following = subset | 1 << filters.index(f)
            removed, good, toxic = (int(x) for x in states[subset] - states[following])
            sums[f] += removed
            found.append((f, "".join(order), step, int(states[following, 0]), removed, fails[f] - removed, alone[f], good, toxic))
            subset = following
    for f, *row in found:
        yield (*row, sums[f])


def audit_filters(cells: DataFrame, filters: str = FILTERS) -> DataFrame:
    """One row per part, order of the filters and step, from ``part, mask, n, good, toxic``.

    A part has at most a cell for each subset of the filters (32 for five), which one task holds;
    parts are walked side by side. Every document of a part passes where a part has no cell
    that fails. The number of orders is the factorial of the number of filters.
    """
    names = [c.split()[0] for c in ROW.split(", ")]

    def walk(part):
        import pandas as pd

        states = survivors(part["mask"].to_numpy(np.int64), part[list(WEIGHTS)].to_numpy(np.int64), len(filters))
        name = part["part"].iloc[0]
        return pd.DataFrame([(name, *row) for row in order_rows(states, filters)], columns=names)

    return cells.groupBy("part").applyInPandas(walk, ROW)


def audit_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """What the filters A to E remove of whole ``docs`` in each of their 120 orders, by language: a row per
    ``part`` (``lang``; null and empty are one), ``filter_order`` and ``step``, zeros included.

    A null text is empty: it fails A alone, and E where a lesser id has an empty or null text. Only
    ids compare for E: a row of null ``doc_id`` is no copy, nor has it copies or labels; repeated rows
    count each, and neither is the other's copy. Of several labels of an id one that says 1 is
    enough; null labels say nothing. An empty table has no parts. Other columns are ignored. A text is
    handled in one row, however long; texts do not leave the tasks that read them.
    """
    return audit_filters(write_down(mask_cells(docs, labels)))


#: The same by plain SQL, for DuckDB.
ORACLE_SQL = r"""
WITH texts AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
firsts AS (SELECT text, min(doc_id) AS first FROM texts GROUP BY text),
marks AS (SELECT doc_id, coalesce(max((quality = 1)::INT), 0) AS good, coalesce(max((toxic = 1)::INT), 0) AS toxic
  FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
failures AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    (len(words) < 200)::INT + 2 * (100 * len(list_distinct(words)) < 50 * len(words))::INT
    + 4 * (100 * len(regexp_extract_all(text, '[A-Z]')) > 3 * length(text))::INT + 8 * regexp_matches(text, '[#$%&*|]')::INT
    + 16 * coalesce(doc_id > first, false)::INT AS mask
  FROM texts LEFT JOIN firsts USING (text) LEFT JOIN marks USING (doc_id)),
cells AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM failures GROUP BY part, mask),
letters AS (SELECT * FROM (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) t(l)),
orders AS (SELECT a.l || b.l || c.l || d.l || e.l AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5),
steps AS (SELECT filter_order, s::INT AS step, substr(filter_order, s, 1) AS f, 1 << (ascii(substr(filter_order, s, 1)) - 65) AS bit,
    coalesce(list_sum(list_transform(range(1, s), lambda i: 1 << (ascii(substr(filter_order, i, 1)) - 65))), 0)::INT AS before
  FROM orders, range(1, 6) r(s)),
found AS (SELECT part, filter_order, step, f,
    sum(n) FILTER (mask & (before | bit) = 0) AS kept, sum(n) FILTER (mask & before = 0 AND mask & bit <> 0) AS removed,
    sum(n) FILTER (mask & before <> 0 AND mask & bit <> 0) AS redundant, sum(n) FILTER (mask = bit) AS unique_fails,
    sum(good) FILTER (mask & before = 0 AND mask & bit <> 0) AS good_lost, sum(toxic) FILTER (mask & before = 0 AND mask & bit <> 0) AS toxic_lost
  FROM cells, steps GROUP BY part, filter_order, step, f)
SELECT part, filter_order, step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed,
  coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails, coalesce(good_lost, 0)::BIGINT AS good_lost,
  coalesce(toxic_lost, 0)::BIGINT AS toxic_lost, (sum(coalesce(removed, 0)) OVER (PARTITION BY part, f))::BIGINT AS shapley
FROM found
"""
