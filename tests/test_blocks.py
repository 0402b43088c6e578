import random

import pytest
from pyspark.sql import functions as F

from ledgerline.functions.aggregates import AGGREGATES, Measure, Rule
from ledgerline.functions.predicates import Condition
from ledgerline.operators.blocks import block_rows, correlate, correlate_between, correlate_both, correlate_containing, lookup, records
from ledgerline.operators.drill import drill_threshold

STAFF = [(1, "Ann", "active"), (2, "Bob", "left"), (3, "Cy", "active"), (4, "Di", None)]
PAY = [("1", 100.0, 10.0, 1), ("3", 300.0, 30.0, 2), ("1.0", 50.0, 5.0, 0), ("x", 1.0, 1.0, 3)]


@pytest.fixture(scope="module")
def staff(spark):
    return spark.createDataFrame(STAFF, "id int, name string, status string")


@pytest.fixture(scope="module")
def pay(spark):
    return spark.createDataFrame(PAY, "emp_id string, base double, bonus double, o int")


def test_records(staff, rows):
    active = records(staff, [Condition("status", "EQ", "active")], order_by=["id"])
    assert rows(active, "name") == [("Ann",), ("Cy",)]
    assert sorted(rows(records(staff, group_by=["status"], order_by=["id"]), "id")) == [(1,), (2,), (4,)]


def test_lookup_takes_the_first_matching_row(staff, pay, rows):
    # "1" and "1.0" are one number, so both belong to record 1; the first by order counts.
    out = lookup(staff, pay, [("id", "emp_id")], {"base": "base"}, ["o"]).orderBy("id")
    assert rows(out, "id", "base") == [(1, 50.0), (2, None), (3, 300.0), (4, None)]
    out = lookup(staff, pay, [("id", "emp_id")], {"base": "base"}, ["o"], [Condition("base", "GE", 100)]).orderBy("id")
    assert rows(out, "base") == [(100.0,), (None,), (300.0,), (None,)]
    assert rows(lookup(staff, pay, [], {"any": "base"}, ["o"]), "any") == [(50.0,)] * 4


def test_correlated_aggregates(staff, pay, rows):
    measures = [Measure("n", "COUNT"), Measure("sum", "SUM", "base"), Measure("top", "MAX", "bonus")]
    out = correlate(staff, pay, [("id", "emp_id")], measures).orderBy("id")
    assert rows(out, "id", "n", "sum", "top") == [(1, 2, 150.0, 10.0), (2, 0, 0.0, 0.0), (3, 1, 300.0, 30.0), (4, 0, 0.0, 0.0)]
    assert rows(correlate(staff, pay, [], measures), "n", "sum") == [(4, 451.0)] * 4
    none = correlate(staff, pay.filter("false"), [], measures)
    assert rows(none, "n", "sum", "top") == [(0, 0.0, 0.0)] * 4


@pytest.mark.parametrize("op", ["GT", "GE", "LT", "LE", "NE"])
@pytest.mark.parametrize("keyed", [True, False])
def test_thresholds_follow_a_nested_loop(spark, many_parts, op, keyed):
    rng = random.Random(op)
    value = lambda: rng.choice([None, *range(12)])
    # One key holds most rows, so that its running totals cross several parts.
    key = lambda: rng.choice(["hot"] * 6 + ["cold", None])
    recs = [(i, key(), value()) for i in range(60)]
    other = [(key(), value(), rng.choice([None, 1.0, 2.0, 8.0])) for _ in range(120)]
    rank = lambda v: (v is None, v or 0)
    holds = {"GT": lambda a, b: rank(a) > rank(b), "GE": lambda a, b: rank(a) >= rank(b),
             "LT": lambda a, b: rank(a) < rank(b), "LE": lambda a, b: rank(a) <= rank(b),
             "NE": lambda a, b: rank(a) != rank(b)}[op]
    expected = []
    for i, k, bound in recs:
        mine = [w for kk, v, w in other if (not keyed or kk == k) and holds(v, bound)]
        numbers = [w for w in mine if w is not None]
        expected.append((i, len(mine), sum(numbers), max(numbers, default=0.0), min(numbers, default=0.0),
                         sum(numbers) / len(numbers) if numbers else 0.0))
    out = correlate(spark.createDataFrame(recs, "i int, k string, bound int"),
                    spark.createDataFrame(other, "kk string, v int, w double"), [("k", "kk")] if keyed else [],
                    [Measure("n", "COUNT"), Measure("s", "SUM", "w"), Measure("hi", "MAX", "w"), Measure("lo", "MIN", "w"),
                     Measure("m", "AVG", "w")], threshold=("v", op, "bound"))
    assert [tuple(r) for r in out.select("i", "n", "s", "hi", "lo", "m").orderBy("i").collect()] == expected


def test_what_a_threshold_cannot_take(staff, pay, monkeypatch):
    with pytest.raises(ValueError, match="GT, GE, LT, LE or NE"):
        correlate(staff, pay, [], [Measure("n", "COUNT")], threshold=("base", "CONTAINS", "id"))
    with pytest.raises(ValueError, match="two numbers or two moments"):
        correlate(staff, pay, [], [Measure("n", "COUNT")], threshold=("emp_id", "LT", "name"))
    monkeypatch.setitem(AGGREGATES, "MIDDLE", Rule(F.median))
    middle = [Measure("n", "MIDDLE", "o")]
    with pytest.raises(ValueError, match="merged from parts"):
        correlate(staff, pay, [], middle, threshold=("base", "LT", "id"))
    with pytest.raises(ValueError, match="merged from parts"):
        correlate_between(staff, pay, [], middle, "base", "id", "id")
    with pytest.raises(ValueError, match="merged from parts"):
        correlate_both(staff, pay, [], middle, ("base", "LT", "id"), ("bonus", "LT", "id"))
    with pytest.raises(ValueError, match="merged from parts"):
        correlate_containing(staff, pay, [], middle, "emp_id", "name")
    with pytest.raises(ValueError, match="two numbers or two moments|moments"):
        correlate_both(staff, pay, [], [Measure("n", "COUNT")], ("base", "LT", "id"), ("emp_id", "LT", "id"))
    with pytest.raises(ValueError, match="GT, GE, LT or LE"):
        correlate_both(staff, pay, [], [Measure("n", "COUNT")], ("base", "NE", "id"), ("bonus", "LT", "id"))


def test_unequal_texts_are_loosely_unequal(staff, pay, rows):
    # "1" and "1.0" are equal to the number 1, "x" is unequal to every number.
    out = correlate(staff, pay, [], [Measure("n", "COUNT")], threshold=("emp_id", "NE", "id")).orderBy("id")
    assert rows(out, "n") == [(2,), (4,), (3,), (4,)]


def test_block_rows(staff, rows):
    active = records(staff, [Condition("status", "EQ", "active")])
    block = [{"a": F.lit("name"), "b": F.lit("id")}, {"a": F.col("name"), "b": F.col("id")}, {}, {}]
    out = block_rows(active, block, ["id"]).orderBy("row_no")
    assert rows(out, "row_no", "a", "b")[:2] == [(0, "name", "id"), (1, "Ann", "1")]
    assert rows(out, "row_no", "a", "b")[4:6] == [(4, "name", "id"), (5, "Cy", "3")] and out.count() == 8

def test_intervals_distinct_counts_and_lookups_follow_a_nested_loop(spark, many_parts):
    rng = random.Random(17)
    recs = [(i, rng.choice(["a", "hot", None]), rng.choice([None, *range(9)]), rng.choice([None, *range(9)])) for i in range(25)]
    other = [(rng.choice(["a", "hot", "hot", "hot", None, "z"]), rng.choice([None, *range(9)]), rng.choice([None, 1.0, 2.0, 4.0]), n) for n in range(120)]
    left = spark.createDataFrame(recs, "i int, k string, low int, high int")
    right = spark.createDataFrame(other, "ok string, at int, v double, n int")
    great = lambda x: (x is None, x or 0)
    ops = {"LT": lambda a, b: a < b, "LE": lambda a, b: a <= b, "GT": lambda a, b: a > b, "GE": lambda a, b: a >= b}
    for op, holds in ops.items():
        out = correlate(left, right, [("k", "ok")], [Measure("d", "COUNT_DISTINCT", "v"), Measure("c", "COUNT")], threshold=("at", op, "low"))
        first = lookup(left, right, [("k", "ok")], {"n": "n"}, ["n"], threshold=("at", op, "low"))
        hits = {r[0]: [o for o in other if o[0] == r[1] and holds(great(o[1]), great(r[2]))] for r in recs}
        assert {r.i: (r.d, r.c) for r in out.collect()} == {i: (len({o[2] for o in h}), len(h)) for i, h in hits.items()}
        assert {r.i: r.n for r in first.collect()} == {i: min((o[3] for o in h), default=None) for i, h in hits.items()}
        behind = drill_threshold(left.where("i < 4"), right, [("k", "ok")], ("at", op, "low")).collect()
        assert sorted(r.n for r in behind) == sorted({o[3] for i in range(4) for o in hits[i]})
    inside = correlate_between(left, right, [("k", "ok")], [Measure("c", "COUNT"), Measure("s", "SUM", "v"), Measure("m", "AVG", "v")], "at", "low", "high")
    for r in inside.collect():
        found = [o for o in other if o[0] == r.k and great(r.low) <= great(o[1]) <= great(r.high)]
        values = [o[2] for o in found if o[2] is not None]
        assert (r.c, r.s, r.m) == (len(found), sum(values), sum(values) / len(values) if values else 0)
