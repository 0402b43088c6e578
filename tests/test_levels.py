"""Totals over several levels whose finest groups differ, against plain models, and their plans."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

import ledgerline.reports  # noqa: F401  registers the aggregates
from ledgerline.functions.aggregates import Measure
from ledgerline.operators.bands import group_list
from ledgerline.operators.blocks import correlate
from ledgerline.operators.levels import SET, level_totals
from tests.test_plans import count, plan

SETS = [("g", "h"), ("g",), ()]


def quantile(values, p):
    values = sorted(values)
    if not values:
        return 0
    at = (len(values) - 1) * p
    low, high = values[int(at)], values[min(int(at) + (at % 1 > 0), len(values) - 1)]
    return low + (high - low) * (at % 1)


@pytest.fixture(scope="module")
def data(spark):
    rng = random.Random(41)
    value = lambda: rng.choice([None, 1e9 + rng.randrange(3), -5.0, 2.5, 7.0])
    rows = [(rng.choice(["hot"] * 6 + ["cold", None]), rng.choice(["x", "y", None]), rng.choice([None, *range(9)]), rng.choice("abc"), value()) for _ in range(300)]
    rows += [("none", "x", None, None, None)] * 2
    return rows, spark.createDataFrame(rows, "g string, h string, u int, v string, w double")


def test_unlike_measures_follow_a_plain_model(data, many_parts):
    rows, df = data
    measures = [Measure("n", "COUNT"), Measure("du", "COUNT_DISTINCT", "u"), Measure("dv", "COUNT_DISTINCT", F.col("v")), Measure("du2", "COUNT_DISTINCT", "u"),
                Measure("s", "SUM", "u"), Measure("a", "COUNT_DISTINCT", "u", approx=True), Measure("var", "VARIANCE", "w"), Measure("dev", "DEVIATION", "w", empty=None),
                Measure("mid", "MEDIAN", "w"), Measure("up", "UPPER_TENTH", "w"), Measure("mid_u", "MEDIAN", "u", empty=None)]
    got = level_totals(df, ["g", "h"], SETS, measures).collect()
    expected = {}
    for number, keys in enumerate(SETS):
        for g, h, *rest in rows:
            at = (number, g if "g" in keys else None, h if "h" in keys else None)
            expected.setdefault(at, []).append(rest)
    assert len(got) == len(expected)
    for r in got:
        us, vs, ws = zip(*expected[r[SET], r.g, r.h])
        numbers, w = [u for u in us if u is not None], [x for x in ws if x is not None]
        assert (r.n, r.du, r.dv, r.du2, r.s, r.a) == (len(us), len(set(us)), len(set(vs)), len(set(us)), sum(numbers), len(set(us)))
        assert r["var"] == pytest.approx(statistics.pvariance(w) if w else 0, rel=1e-9) and r.mid == quantile(w, 0.5) and r.up == pytest.approx(quantile(w, 0.9))
        assert r.dev == (pytest.approx(statistics.stdev(w), rel=1e-9) if len(w) > 1 else None)
        assert r.mid_u == (quantile(numbers, 0.5) if numbers else None)


def test_deviations_keep_their_digits(spark):
    """Groups far apart whose own values are close: sums of squares would lose all digits."""
    rows = [(f"g{g}", "x", 1e9 * g + d) for g in range(5) for d in (-0.5, 0.0, 0.5)]
    df = spark.createDataFrame(rows, "g string, h string, w double")
    got = level_totals(df, ["g", "h"], [("g",), ()], [Measure("var", "VARIANCE", "w")])
    for r in got.collect():
        assert r["var"] == pytest.approx(statistics.pvariance([w for g, _, w in rows if r.g in (g, None)]), rel=1e-12)


def test_no_rows(spark, data):
    none = data[1].where("false")
    measures = [Measure("du", "COUNT_DISTINCT", "u"), Measure("dv", "COUNT_DISTINCT", "v"), Measure("a", "COUNT_DISTINCT", "u", approx=True),
                Measure("dev", "DEVIATION", "w"), Measure("mid", "MEDIAN", "w")]
    assert [tuple(r) for r in level_totals(none, ["g", "h"], SETS, measures).collect()] == [(None, None, 2, 0, 0, 0, 0.0, 0.0)]


def test_a_quantile_of_one_level(data):
    rows, df = data
    got = {r.g: r.mid for r in group_list(df, ["g"], [Measure("mid", "MEDIAN", "w")]).collect()}
    assert got == {g: quantile([w for gg, _, _, _, w in rows if gg == g and w is not None], 0.5) for g in {r[0] for r in rows}}


def test_sketches_meet_thresholds(spark):
    recs = spark.createDataFrame([(i, i * 10) for i in range(6)], "i int, most int")
    other = spark.range(60).select("id", (F.col("id") % 4).alias("v"))
    out = correlate(recs, other, [], [Measure("a", "COUNT_DISTINCT", "v", approx=True)], threshold=("id", "LT", "most"))
    assert {r.i: r.a for r in out.collect()} == {i: min(4, i * 10) for i in range(6)}


@pytest.mark.parametrize("measures", [
    [Measure("du", "COUNT_DISTINCT", "u"), Measure("dv", "COUNT_DISTINCT", "v"), Measure("s", "SUM", "w")],
    [Measure("a", "COUNT_DISTINCT", "u", approx=True), Measure("s", "SUM", "w")], [Measure("dev", "DEVIATION", "w"), Measure("s", "SUM", "w")]])
def test_rows_are_read_once_and_never_expanded(spark, tmp_path, data, measures, monkeypatch):
    data[1].write.parquet(str(tmp_path / "t"))
    df, written = spark.read.parquet(str(tmp_path / "t")), []
    from ledgerline.operators import levels
    keep = levels.write_down
    monkeypatch.setattr(levels, "write_down", lambda x: (written.append(plan(x, run=False)), keep(x))[1])
    text = plan(level_totals(df, ["g", "h"], [("g", "h"), ("g",)], measures))
    source = str(tmp_path / "t")
    assert sum(t.count(source) > 0 for t in [*written, text]) == 1
    assert all("Expand" not in t for t in [*written, text] if source in t)
    assert count("CartesianProduct", text) + count("BroadcastNestedLoopJoin", text) == 0
