"""Two inequalities, intervals and text search between records and rows, against nested loops with a hot key."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerline.functions.aggregates import Measure
from ledgerline.functions.predicates import Condition
from ledgerline.operators.blocks import correlate, correlate_between, correlate_both, correlate_containing
from ledgerline.operators.ranges import BLOCK, blocks_of, prefix_blocks, prefix_blocks_of, range_blocks

OPS = {"LT": lambda a, b: a < b, "LE": lambda a, b: a <= b, "GT": lambda a, b: a > b, "GE": lambda a, b: a >= b}
MEASURES = [Measure("n", "COUNT"), Measure("s", "SUM", "w"), Measure("hi", "MAX", "w"), Measure("lo", "MIN", "w"), Measure("m", "AVG", "w")]


def rank(v):
    return (v is None, v or 0)


def figures(values):
    numbers = [v for v in values if v is not None]
    return (len(values), sum(numbers), max(numbers, default=0), min(numbers, default=0), sum(numbers) / len(numbers) if numbers else 0)


@pytest.fixture(scope="module")
def sides(spark):
    rng = random.Random(29)
    value = lambda: rng.choice([None, *range(14)])
    key = lambda: rng.choice(["hot"] * 7 + ["cold", None])
    recs = [(i, key(), value(), value()) for i in range(50)] + [(50, "none", 1, 9)]
    other = [(key(), value(), value(), rng.choice([None, 1.0, 2.0, 4.0, 8.0])) for _ in range(230)]
    return (recs, other, spark.createDataFrame(recs, "i int, k string, low int, high int"),
            spark.createDataFrame(other, "ok string, at int, then int, w double"))


def test_blocks_cover_exactly_their_range(spark):
    size = 37
    spans = [(a, b) for a in range(size) for b in range(a + 1, size + 1)]
    covered = lambda blocks: sorted(p for level, block in blocks for p in range(block << level, (block + 1) << level))
    df = spark.createDataFrame(spans, "a long, b long").select("a", "b", range_blocks(F.col("a"), F.col("b")).alias("r"), prefix_blocks(F.col("b")).alias("p"))
    for row in df.collect():
        assert covered(row.r) == list(range(row.a, row.b)) and covered(row.p) == list(range(row.b))
        assert len(row.r) <= 2 * row.b.bit_length() and len(row.p) <= row.b.bit_length()
    held = spark.range(size).select("id", blocks_of(F.col("id"), F.lit(size).cast("long")).alias("all"),
                                    prefix_blocks_of(F.col("id"), F.lit(size).cast("long")).alias("even")).collect()
    for row in held:
        whole = {(level, row.id >> level) for level in range(6) if ((row.id >> level) + 1) << level <= size}
        assert set(map(tuple, row["all"])) == whole and set(map(tuple, row["even"])) == {b for b in whole if b[1] % 2 == 0}
    assert BLOCK == list(held[0]["all"][0].asDict())


@pytest.mark.parametrize("one", OPS)
@pytest.mark.parametrize("two", ["LE", "GT"])
@pytest.mark.parametrize("keyed", [True, False])
def test_two_inequalities_follow_a_nested_loop(sides, many_parts, one, two, keyed):
    recs, other, left, right = sides
    if not keyed and one in ("LT", "GE"):
        pytest.skip("covered with keys")
    out = correlate_both(left, right, [("k", "ok")] if keyed else [], MEASURES, ("at", one, "low"), ("then", two, "high"))
    assert out.columns == ["i", "k", "low", "high", "n", "s", "hi", "lo", "m"]
    got = {r.i: tuple(r)[4:] for r in out.collect()}
    assert got == {i: figures([w for ok, at, then, w in other if (not keyed or ok == k) and OPS[one](rank(at), rank(low)) and OPS[two](rank(then), rank(high))])
                   for i, k, low, high in recs}


@pytest.mark.parametrize("keyed", [True, False])
def test_intervals_follow_a_nested_loop(sides, many_parts, keyed):
    recs, other, left, right = sides
    measures = [*MEASURES, Measure("d", "COUNT_DISTINCT", "w"), Measure("first", "MIN", "then", empty=None)]
    out = correlate_between(left, right, [("k", "ok")] if keyed else [], measures, "at", "low", "high")
    assert out.columns[4:] == ["n", "s", "hi", "lo", "m", "d", "first"]
    for r in out.collect():
        rows = [o for o in other if (not keyed or o[0] == r.k) and rank(r.low) <= rank(o[1]) <= rank(r.high)]
        then = [o[2] for o in rows if o[2] is not None]
        assert tuple(r)[4:] == (*figures([o[3] for o in rows]), len({o[3] for o in rows}), min(then, default=None))


def test_a_hot_key_with_many_rows_and_one_value(spark, many_parts):
    rows = spark.range(3000).select(F.lit("hot").alias("ok"), "id", F.lit(1.0).alias("same"), (F.col("id") % 7).alias("v"))
    recs = spark.createDataFrame([(i, "hot", i * 100, i * 100 + 250) for i in range(30)], "i int, k string, low long, high long")
    got = correlate_between(recs, rows, [("k", "ok")], [Measure("d", "COUNT_DISTINCT", "same"), Measure("e", "COUNT_DISTINCT", "v"),
                                                         Measure("top", "MAX", "id")], "id", "low", "high").collect()
    assert {r.i: (r.d, r.e, r.top) for r in got} == {i: (1, 7, min(2999, i * 100 + 250)) if i * 100 < 3000 else (0, 0, 0) for i in range(30)}
    both = correlate_both(recs, rows, [("k", "ok")], [Measure("n", "COUNT")], ("id", "GE", "low"), ("v", "LT", "i")).collect()
    assert {r.i: r.n for r in both} == {i: sum(x % 7 < i for x in range(i * 100, 3000)) for i in range(30)}


def test_unequal_with_distinct_values(sides, many_parts):
    recs, other, left, right = sides
    for on in ([("k", "ok")], []):
        out = correlate(left, right, on, [Measure("d", "COUNT_DISTINCT", "w"), Measure("n", "COUNT")], [Condition("then", "NE", 3)], threshold=("at", "NE", "low"))
        assert out.columns[4:] == ["d", "n"]
        for r in out.collect():
            rows = [o for o in other if o[2] != 3 and (not on or o[0] == r.k) and o[1] != r.low]
            assert (r.d, r.n) == (len({o[3] for o in rows}), len(rows))


@pytest.mark.parametrize("keyed", [True, False])
def test_text_search_follows_a_nested_loop(spark, many_parts, keyed):
    rng = random.Random(31)
    word = lambda most: "".join(rng.choice("abÉ😀 ") for _ in range(rng.randrange(most)))
    key = lambda: rng.choice(["hot"] * 5 + ["cold", None])
    recs = [(i, key(), rng.choice([None, "", word(3), word(4), word(6), "abab", "%", "zzz"])) for i in range(80)] + [(90, "none", "a")]
    other = [(key(), rng.choice([None, "", word(12), word(30), "ab" * 50]), rng.choice([None, 1.0, 2.0, 4.0])) for _ in range(120)]
    left, right = spark.createDataFrame(recs, "i int, k string, needle string"), spark.createDataFrame(other, "ok string, body string, w double")
    out = correlate_containing(left, right, [("k", "ok")] if keyed else [], MEASURES, "body", "needle")
    for r in out.collect():
        values = [w for ok, body, w in other if (not keyed or ok == r.k) and body is not None and r.needle is not None and r.needle in body]
        assert tuple(r)[3:] == figures(values)


def test_numbers_are_searched_as_text(spark):
    recs = spark.createDataFrame([(1, 2), (2, 12), (3, None)], "i int, digit int")
    rows = spark.createDataFrame([("12.0",), ("x2.0y",), ("2",)], "body string")
    got = correlate_containing(recs, rows, [], [Measure("n", "COUNT")], "body", "digit").orderBy("i").collect()
    assert [r.n for r in got] == [2, 1, 0]


def test_empty_sides(spark, sides):
    _, _, left, right = sides
    none = right.where("false")
    two = (("at", "LT", "low"), ("then", "GT", "high"))
    for out in (correlate_both(left, none, [("k", "ok")], MEASURES, *two), correlate_between(left, none, [("k", "ok")], [*MEASURES, Measure("d", "COUNT_DISTINCT", "w")], "at", "low", "high"),
                correlate_containing(left.withColumn("q", F.lit("a")), none, [("k", "ok")], MEASURES, "ok", "q")):
        assert {r.n for r in out.collect()} == {0} and out.count() == 51
    assert correlate_both(left.where("false"), right, [("k", "ok")], MEASURES, *two).collect() == []
    assert correlate_between(left.where("false"), right, [("k", "ok")], [Measure("hi", "MAX", "w")], "at", "low", "high").collect() == []
