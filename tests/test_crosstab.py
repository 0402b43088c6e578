import random

import pytest
from pyspark.sql import functions as F

from ledgerline.functions.aggregates import Measure
from ledgerline.operators.crosstab import crosstab_cells, crosstab_totals, crosstab_wide

# Litres that wells gave in three months, one of them dry in one.
WATER = [("fern", "apr", 12.5), ("fern", "may", 8.0), ("fern", "jun", 0.5), ("moss", "apr", 31.0), ("moss", "jun", 7.25), ("moss", "jun", 2.0)]
LITRES = Measure("litres", "SUM", "litres")


def litres(well=None, month=None):
    return sum(w[2] for w in WATER if well in (None, w[0]) and month in (None, w[1]))


@pytest.fixture(scope="module")
def water(spark):
    return spark.createDataFrame(WATER, "well string, month string, litres double")


def test_grid(water, rows):
    months = ("apr", "jun", "may")
    assert rows(crosstab_cells(water, ["well"], "month", [LITRES])) == [(w, m, litres(w, m)) for w in ("fern", "moss") for m in months]
    assert rows(crosstab_wide(water, ["well"], "month", LITRES, ["may", "apr", "jun"])) == [
        (w, *[litres(w, m) for m in ("may", "apr", "jun")]) for w in ("fern", "moss")]
    with pytest.raises(Exception, match="no column is given for this value of month: jun"):
        crosstab_wide(water, ["well"], "month", LITRES, ["may", "apr"]).collect()


def test_margins(water, rows):
    expected = []
    for w in ("fern", "moss"):
        expected += [(w, m, "cell", litres(w, m)) for m in ("apr", "jun", "may")] + [(w, None, "row_total", litres(w))]
    expected += [(None, m, "column_total", litres(None, m)) for m in ("apr", "jun", "may")] + [(None, None, "grand_total", litres())]
    assert rows(crosstab_totals(water, "well", "month", LITRES)) == expected


def test_margins_have_aggregates_of_their_own(water, rows):
    out = crosstab_totals(water, "well", "month", LITRES, Measure("n", "COUNT"), Measure("top", "MAX", "litres"),
                          Measure("kinds", "COUNT_DISTINCT", "month"), dense=False)
    assert [r[3] for r in rows(out.filter("margin <> 'cell'"))] == [3.0, 3.0, 31.0, 7.25, 8.0, 3.0]


def test_margins_of_another_type_are_text(water, rows):
    out = crosstab_totals(water, "well", "month", Measure("m", "MAX", "month", typed=True), Measure("n", "COUNT"))
    assert [r[3] for r in rows(out.filter("well = 'moss'"))] == ["apr", "jun", None, "3"]


def test_margins_with_row_attributes(water, rows):
    df = water.withColumn("depth", F.length("well") * 10)
    out = rows(crosstab_totals(df, ["well", "depth"], "month", LITRES))
    assert out[3] == ("fern", 40, None, "row_total", 21.0) and out[-1] == (None, None, None, "grand_total", litres()) and len(out) == 12


@pytest.mark.parametrize("seed", range(3))
def test_random_grid_with_missing_headers(spark, seed):
    rng = random.Random(seed)
    table = [(rng.choice([None, "a", "b", "c"]), rng.choice([None, 1, 2, 3]), rng.choice([None, 1.0, 2.0, 4.0]))
             for _ in range(rng.randint(1, 12))]
    df = spark.createDataFrame(table, "r string, c int, v double")
    measures = [Measure("s", "SUM", "v"), Measure("n", "COUNT"), Measure("d", "COUNT_DISTINCT", "v"), Measure("m", "AVG", "v")]
    expected = set()
    for r in {t[0] for t in table}:
        for c in {t[1] for t in table}:
            vs = [t[2] for t in table if t[0] == r and t[1] == c]
            numbers = [v for v in vs if v is not None]
            expected.add((r, c, sum(numbers), len(vs), len(set(vs)), sum(numbers) / len(numbers) if numbers else 0.0))
    assert set(map(tuple, crosstab_cells(df, ["r"], "c", measures).collect())) == expected
    wide = crosstab_wide(df, ["r"], "c", measures[1])
    cells = {(row["r"], None if name == "null" else int(name), row[name]) for row in wide.collect() for name in wide.columns[1:]}
    assert cells == {(r, c, n) for r, c, _, n, _, _ in expected}


def test_a_dense_grid_takes_any_number_of_headers(spark, monkeypatch):
    monkeypatch.setattr("ledgerline.operators.crosstab.CHUNK", 7)
    df = spark.range(40).select((F.col("id") % 3).alias("r"), F.when(F.col("id") != 5, F.col("id")).alias("c"))
    cells = crosstab_cells(df, ["r"], "c", [Measure("n", "COUNT")]).collect()
    assert len(cells) == 3 * 40 and sum(c.n for c in cells) == 40 and cells[0].c is None
    assert crosstab_cells(df, ["r"], "c", [Measure("n", "COUNT")], dense=False).count() == 40


def test_too_wide_a_table_fails_instead_of_being_cut(spark):
    df = spark.range(20).select(F.lit("r").alias("r"), F.col("id").alias("c"))
    with pytest.raises(ValueError, match="more than 5 values of c"):
        crosstab_wide(df, ["r"], "c", Measure("n", "COUNT"), max_columns=5)


def test_row_attributes(spark, rows):
    df = spark.createDataFrame([("oak", 7, "north", 2.5), ("yew", 3, "south", 4.0)], "tree string, age int, side string, height double")
    assert rows(crosstab_cells(df, ["tree", "age"], "side", [Measure("height", "SUM", "height")])) == [
        ("oak", 7, "north", 2.5), ("oak", 7, "south", 0.0), ("yew", 3, "north", 0.0), ("yew", 3, "south", 4.0)]


def test_empty(spark):
    df = spark.createDataFrame([], "r string, c string, v double")
    assert crosstab_cells(df, ["r"], "c", [Measure("s", "SUM", "v")]).count() == 0
    totals = crosstab_totals(df, "r", "c", Measure("s", "SUM", "v")).collect()
    assert [tuple(r) for r in totals] == [(None, None, "grand_total", 0.0)]
