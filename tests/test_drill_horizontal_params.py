import pytest
from pyspark.sql import functions as F

from ledgerline.functions import params as P
from ledgerline.functions.aggregates import Measure, kpi
from ledgerline.functions.scalars import text
from ledgerline.operators.bands import Summary, band, band_positions, merge_spans
from ledgerline.operators.dictionaries import map_codes
from ledgerline.operators.drill import drill_rows, drill_view
from ledgerline.operators.horizontal import transpose, transpose_wide
from ledgerline.operators.ordering import number_rows
from ledgerline.sources.sinks import cells_of, write_cells


@pytest.fixture(scope="module")
def lines(spark):
    return spark.createDataFrame([(1, "a", None), (1, "a", "x"), (2, "b", "x"), (None, "c", "x"), (None, "c", "y")],
                                 "id int, name string, kind string")


def test_drill_by_chosen_cells(lines, rows):
    assert drill_rows(lines, [{"kind": None}, {"kind": "y"}], ["kind"]).count() == 2
    assert drill_rows(lines, lines.filter("name = 'a'").select("kind").distinct(), ["kind"]).count() == 4
    assert drill_rows(lines, [], []).count() == 5 and drill_rows(lines, [], ["kind"]).count() == 0
    many = [{"kind": "x", "id": i} for i in range(200)]
    assert drill_rows(lines, many, ["kind", "id"]).count() == 2


@pytest.mark.parametrize("cast", ["int", "double", "date", "string"])
def test_drill_is_alike_for_few_and_many_cells(spark, cast):
    df = spark.range(600).select(F.when(F.col("id") != 3, F.col("id")).alias("n"))
    df = df.select((F.date_add(F.lit("2024-01-01"), F.col("n").cast("int")) if cast == "date" else F.col("n").cast(cast)).alias("v"), (F.col("n") % 2).alias("w"))
    values = [r.v for r in df.orderBy("v").collect()]
    for some in (values[:1], values[:5], values[:500]):
        assert sorted(map(str, (r.v for r in drill_rows(df, [{"v": v} for v in some], ["v"]).collect()))) == sorted(map(str, some))
    assert drill_rows(df, [{"v": v, "w": None} for v in values], ["v", "w"]).count() == 1
    if cast == "double":
        assert drill_rows(df, [{"v": 1}] * 101, ["v"]).count() == 1


def test_drill_view_keeps_one_row_per_key_and_all_without(lines, rows):
    view = drill_view(lines, ["id", "name"], ["id"], ["kind"])
    assert sorted(rows(view), key=str) == [(1, "a"), (2, "b"), (None, "c"), (None, "c")]
    assert drill_view(lines, ["name"]).count() == 5


LAPS = [("kite", 61.5, 0), ("lark", 58.25, 1), ("mole", 73.0, 2), ("newt", 66.0, 3)]


@pytest.fixture(scope="module")
def laps(spark):
    return spark.createDataFrame(LAPS, "runner string, secs double, o int")


def test_records_across_with_total(laps, rows):
    out = band(laps, [], ["runner", "secs", "o"], summaries=[Summary(None, (Measure("secs", "SUM", "secs"),))], order_by=["o"])
    cells = transpose(band_positions(out, [], ["o"], name="position"), ["runner", "secs"]).orderBy("field", "position")
    assert rows(cells, "field", "position", "num", "text") == [
        *[("runner", o, None, r) for r, _, o in LAPS], ("runner", 4, None, None),
        *[("secs", o, s, None) for _, s, o in LAPS], ("secs", 4, sum(s for _, s, _ in LAPS), None)]


def test_wide_records_fail_rather_than_drop(laps, rows):
    assert rows(transpose_wide(laps, ["runner", "secs"], 5, ["o"])) == [
        ("runner", "kite", "lark", "mole", "newt", None), ("secs", "61.5", "58.25", "73", "66", None)]
    with pytest.raises(Exception, match="more than 2 records"):
        transpose_wide(laps, ["runner"], 2, ["o"]).collect()


def test_groups_merge_across(spark, rows):
    df = spark.createDataFrame([("food", "a"), ("food", "b"), ("toys", "c")], "category string, product string")
    spans = merge_spans(df, ["category"], ["product"])
    placed = number_rows(spans, ["category", "product"], "position").orderBy("position")
    assert rows(placed, "position", "category__span", "category__head") == [(0, 2, True), (1, 2, False), (2, 1, True)]


def test_cells_and_sink(spark, rows, tmp_path):
    df = spark.sql("select 1 id, 2.5d n, 'x' t, true b, date'2024-01-02' d")
    expected = [(1, "n", 2.5, None, None), (1, "t", None, "x", None), (1, "b", None, None, True), (1, "d", None, "2024-01-02", None)]
    assert rows(cells_of(df, ["id"], ["n", "t", "b", "d"])) == expected
    write_cells(df, str(tmp_path / "cells"), ["id"], ["n", "t", "b", "d"])
    assert sorted(rows(spark.read.parquet(str(tmp_path / "cells"))), key=str) == sorted(expected, key=str)


def test_parameters(spark):
    declared = [P.Parameter("a", 1), P.Parameter("b"), P.Parameter("c", required=True)]
    assert P.with_defaults(declared, {"c": 3}) == {"a": 1, "b": None, "c": 3}
    assert P.with_defaults(declared, {"a": 2, "c": 0})["a"] == 2
    with pytest.raises(ValueError, match="'c' is required"):
        P.with_defaults(declared, {"c": ""})
    df = spark.sql("select 'r' rec")
    shown = df.select(text(df, "p", P.parameter({}, "missing")).alias("none"),
                      P.resolve("rec", {"rec": "outer"}, records=df).alias("rec"),
                      P.resolve("x", {"x": "outer"}, {"group": F.lit("g")}, df).alias("x"),
                      P.resolve("group", {"group": "outer"}, {"group": F.lit("g")}).alias("g")).first()
    assert tuple(shown) == ("p", "r", "outer", "g")
    top = P.from_result(spark.range(5).agg(F.max("id")))
    assert spark.range(10).filter(F.col("id") > top).count() == 5


def test_dictionary(spark, rows):
    df = spark.createDataFrame([("1", 1.0, 1), ("0", 0.0, 2), ("9", 2.5, 3), (None, None, 4)], "t string, n double, i int")
    genders = [("1", "male"), ("0", "x"), ("0", "female"), ("2.5", "half")]
    out = map_codes(map_codes(df, "t", genders, "by_text"), "n", genders, "by_number").orderBy("i")
    assert rows(out, "by_text", "by_number") == [("male", "male"), ("female", "female"), ("9", "half"), (None, None)]
    both = map_codes(df, "n", [("1", "whole"), ("1.0", "spelled")], "l").orderBy("i")
    assert rows(both, "l")[:2] == [("spelled",), ("0",)]
    assert rows(map_codes(df, "n", None, "l").orderBy("i"), "l") == [("1",), ("0",), ("2.5",), (None,)]
    twice = spark.createDataFrame([("1", "new", 2), ("1", "old", 1)], "code string, label string, at int")
    for column in ("t", "n"):
        assert rows(map_codes(df, column, twice, "l", latest="at").orderBy("i"), "l") == [("new",), ("0",), ("9" if column == "t" else "2.5",), (None,)]


def test_text_with_aggregates(spark):
    df = spark.createDataFrame([(1.0,), (2.5,)], "v double")
    figures = kpi(df, Measure("n", "COUNT"), Measure("s", "SUM", "v"), Measure("d", "SUM", F.col("v") * 2))
    assert figures.select(text(figures, F.col("n"), " rows, sum ", F.col("s"), ", twice ", F.col("d"))).first()[0] == \
        "2 rows, sum 3.5, twice 7"
