"""What the plans must look like for the library to hold at scale."""

import contextlib
import io
import os
import re

import pytest
from pyspark.sql import functions as F

from ledgerline.functions.aggregates import Measure
from ledgerline.functions.predicates import Condition, filter_all
from ledgerline.operators.bands import GROUP, Summary, band, detail_list, group_list
from ledgerline.operators.blocks import correlate
from ledgerline.operators.drill import drill_rows
from ledgerline.operators.ordering import distinct_first, number_rows, preview
from ledgerline.operators import relations
from ledgerline.operators.relations import join_on
from ledgerline.reports import REPORTS

DATA = "/root/testdata/sf0.001"


def plan(df, run=True):
    if run:
        df.collect()
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    text = out.getvalue()
    # After a run the adaptive plan shows its final form first and the initial one below.
    return re.sub(r"\+- == Initial Plan ==.*?(?=\n\n\n)", "", text, flags=re.S)


def count(node, text):
    """How often a node occurs in the tree part of a formatted plan."""
    return len(re.findall(rf"^[ :+\-*]*{node} .*\(\d+\)$", text.split("\n\n\n")[0], flags=re.M))


@pytest.fixture(scope="module")
def facts(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("facts") / "t")
    spark.range(2000).select(
        "id", (F.col("id") % 7).alias("k"), F.concat(F.lit("g"), (F.col("id") % 3)).alias("g"),
        (F.col("id") * 1.5).alias("v"), F.lit("wide").alias("unused")).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture
def large(spark):
    """Nothing is small enough to broadcast."""
    names = ["spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"]
    for name in names:
        spark.conf.set(name, "-1")
    yield
    for name in names:
        spark.conf.unset(name)


@pytest.mark.parametrize("op,right,pushed", [
    ("EQ", "g1", "EqualTo(g,g1)"), ("NE", "g1", "Not(EqualTo(g,g1))"), ("IN", "g1,g2", "In(g, [g1,g2])"),
    ("GE", "a", "GreaterThanOrEqual(g,a)")])
def test_text_filters_reach_the_scan(facts, op, right, pushed):
    assert pushed in plan(filter_all(facts, Condition("g", op, right)), run=False)


@pytest.mark.parametrize("op,right,pushed", [
    ("EQ", "3", "EqualTo(v,3.0)"), ("GT", 3.0, "GreaterThan(v,3.0)"), ("BETWEEN", "1,9", "LessThanOrEqual(v,9.0)"),
    ("IS_NOT_NULL", None, "IsNotNull(v)"), ("IN", [1.0, 2.0], "In(v, [1.0,2.0])")])
def test_number_filters_reach_the_scan(facts, op, right, pushed):
    assert pushed in plan(filter_all(facts, Condition("v", op, right)), run=False)


def test_few_drilled_cells_become_a_filter(facts):
    text = plan(drill_rows(facts, [{"g": "g1"}], ["g"]), run=False)
    assert "EqualTo(g,g1)" in text and "Join" not in text


def test_only_used_columns_are_read(facts):
    text = plan(group_list(facts, ["g"], [Measure("s", "SUM", "v")]), run=False)
    assert "ReadSchema: struct<g:string,v:double>" in text


def test_a_band_reads_its_source_once(facts):
    plain = (Measure("s", "SUM", "v"), Measure("m", "AVG", "v"))
    out = band(facts, ["g", "k"], measures=plain, summaries=[Summary("g", plain, (GROUP,)), Summary(None, plain, ("all",))])
    text = plan(out)
    assert count("Scan parquet", text) == 1 and text.split("\n\n\n")[0].count("ReusedExchange") == 2
    totals = (Measure("s", "SUM", "v"), Measure("n", "COUNT"), Measure("d", "COUNT_DISTINCT", "id"))
    out = band(facts, ["g", "k"], measures=totals, summaries=[Summary("g", totals, (GROUP,)), Summary(None, totals, ("all",))])
    text = plan(out)
    assert count("Scan parquet", text) == 1 and "ReusedExchange" in text


def test_group_totals_need_no_window_and_no_shuffle_of_rows_when_small(facts):
    out = band(facts, ["g"], ["id"], [Measure("s", "SUM", "v")], ordered=False)
    text = plan(out)
    assert "Window" not in text and count("BroadcastHashJoin", text) == 1 and count("Exchange", text) == 0


def test_group_totals_are_joined_by_key_when_large(facts, large):
    text = plan(detail_list(facts, ["g"], ["id"], [Measure("s", "SUM", "v")], ["id"]))
    assert count("SortMergeJoin", text) == 1 and "Window" not in text


def test_first_rows_are_picked_before_the_shuffle(facts):
    text = plan(distinct_first(facts, ["g"], ["id"]), run=False)
    assert re.search(r"WindowGroupLimit\nInput.*\nArguments: .*Partial", text)


def test_preview_takes_the_top_rows_of_each_part(facts):
    assert count("TakeOrderedAndProject", plan(preview(facts, ["v"], 5), run=False)) == 1


def test_correlated_rows_are_aggregated_before_the_join(facts, large):
    text = plan(correlate(facts, facts.select(F.col("k").alias("j"), "v"), [("k", "j")], [Measure("s", "SUM", "v")]))
    tree = text.split("\n\n\n")[0]
    assert tree.index("SortMergeJoin LeftOuter") < tree.index("HashAggregate")


def test_unique_sides_join_by_the_plain_key(facts, large):
    side = facts.select(F.col("id").alias("j"), F.col("v").alias("w"))
    assert "coalesce" not in plan(join_on(facts, side, [("k", "j")], right_unique=True), run=False)
    # Keys are counted ahead of an undeclared one; the join itself reads each side once.
    loose = plan(join_on(facts, side, [("k", "j")], "LEFT"), run=False)
    assert count("Scan parquet", loose) == 2 and count("SortMergeJoin LeftOuter", loose) == 1


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the test tables are not here")
@pytest.mark.parametrize("name", sorted(REPORTS))
def test_no_report_pairs_rows_or_leaves_the_engine(spark, name):
    text = plan(REPORTS[name](spark, DATA), run=False)
    for node in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython"):
        assert node not in text
    # No window over all rows, which would be one task.
    for window in re.findall(r"\) Window\nInput.*\nArguments: (.*)", text):
        assert "], [], [" not in window


@pytest.fixture
def tiny_skew(spark, large, many_parts):
    """Skew handling that already acts on test-sized partitions."""
    names = {"spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "2000",
             "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
             "spark.sql.adaptive.advisoryPartitionSizeInBytes": "2000", "spark.sql.shuffle.partitions": "16"}
    for name, value in names.items():
        spark.conf.set(name, value)
    yield
    for name in list(names)[:3]:
        spark.conf.unset(name)
    spark.conf.set("spark.sql.shuffle.partitions", "4")


@pytest.fixture
def hot(spark, tmp_path):
    """A third of all rows belong to one key; several files, so that a hot partition can be split."""
    df = spark.range(0, 30_000, 1, 8).select(
        "id", F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id") % 500).alias("k"), F.rand(7).alias("v"))
    df.write.parquet(str(tmp_path / "hot"))
    return spark.read.parquet(str(tmp_path / "hot")).repartition(8, "id")


def test_hot_groups_of_a_detail_list_are_split(hot, tiny_skew):
    out = band(hot, ["k"], ["id"], [Measure("s", "SUM", "v")], ordered=False)
    assert "SortMergeJoin(skew=true)" in plan(out) and out.count() == 30_000


@pytest.mark.parametrize("how", ["LEFT", "FULL"])
def test_hot_keys_of_the_padded_side_are_split(spark, hot, tiny_skew, how, monkeypatch):
    monkeypatch.setattr(relations, "HOT_ROWS", 1000)
    few = spark.range(400).select(F.col("id").alias("j"))
    out = join_on(few, hot, [("j", "k")], how)
    text = plan(out)
    assert text.count("/hot]") == 1 and count("Range", text) == 1
    parts = [r["count"] for r in out.where("k = 1").groupBy(F.spark_partition_id()).count().collect()]
    assert len(parts) > 5 and max(parts) < 5000
    matched = hot.filter("k < 400").count()
    missing = few.join(hot, F.col("j") == F.col("k"), "left_anti").count()
    assert out.count() == matched + missing + (30_000 - matched if how == "FULL" else 0)


def test_a_hot_group_is_sorted_in_many_parts(hot, tiny_skew):
    out = detail_list(hot, ["k"], ["id"])
    parts = out.withColumn("p", F.spark_partition_id()).filter("k = 1").groupBy("p").count().collect()
    assert len(parts) > 3 and sum(r["count"] for r in parts) == hot.filter("k = 1").count()


def test_positions_are_the_same_every_time(hot, many_parts):
    tied = hot.withColumn("m", F.map_from_arrays(F.array("k"), F.array("v"))).drop("v")
    first, second = (number_rows(tied, ["k"]).select("id", "row_no").orderBy("id").collect() for _ in range(2))
    assert first == second and sorted(r.row_no for r in first) == list(range(30_000))
