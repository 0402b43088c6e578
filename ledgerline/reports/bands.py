"""Lists with groups, totals, subtotals, merge spans and positions."""

from pyspark.sql import functions as F

from ledgerline.functions.aggregates import Measure
from ledgerline.functions.predicates import Condition
from ledgerline.operators.bands import (
    GROUP, Summary, band, band_positions, detail_list, group_list, merge_spans,
)
from ledgerline.operators.ordering import number_rows
from ledgerline.reports.catalogue import nulled, report, rounded
from ledgerline.reports.joins import model

SALES_SQL = """
    WITH s AS (SELECT r_name AS region, n_name AS nation, o_totalprice AS price
               FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
               JOIN region ON n_regionkey = r_regionkey WHERE o_orderstatus <> 'P'),
    rows AS (
        SELECT region, nation, round(SUM(price), 2) AS amount, COUNT(*) AS n_orders, CAST(NULL AS VARCHAR) AS label,
               2 AS level, CAST(NULL AS INT) AS summary_no FROM s GROUP BY region, nation
        UNION ALL
        SELECT region, NULL, round(SUM(price), 2), COUNT(*), region || ' subtotal', 0, 0 FROM s GROUP BY region
        UNION ALL
        SELECT NULL, NULL, round(SUM(price), 2), COUNT(*), 'Grand total', -1, 1 FROM s)
"""


def sales(t):
    joined = model(t, "orders", "customer", "nation", "region").combined("orders", "customer", "nation", "region")
    return joined.select(F.col("region__r_name").alias("region"), F.col("nation__n_name").alias("nation"),
                         F.col("orders__o_totalprice").alias("price"),
                         F.col("orders__o_orderstatus").alias("status"))


def sales_band(t, ordered=True):
    totals = (Measure("amount", "SUM", "price"), Measure("n_orders", "COUNT"))
    out = band(sales(t), ["region", "nation"], measures=totals,
               summaries=[Summary("region", totals, (GROUP, " subtotal")), Summary(None, totals, ("Grand total",))],
               where=[Condition("status", "NE", "P")], ordered=ordered)
    return rounded(out, "amount")


@report(SALES_SQL + "SELECT * FROM rows")
def subtotals(t):
    """Order value by region and nation, with region subtotals and a grand total."""
    return sales_band(t)


@report(SALES_SQL + """
    SELECT *, ROW_NUMBER() OVER (ORDER BY level < 0, region, level < 1, nation, level < 2) - 1 AS row_no FROM rows
""")
def row_positions(t):
    return band_positions(sales_band(t, ordered=False), ["region", "nation"])


@report("""
    SELECT p_partkey, p_name, p_retailprice, CAST(NULL AS VARCHAR) AS label, 0 AS level, CAST(NULL AS INT) AS summary_no
    FROM part
    UNION ALL
    SELECT NULL, NULL, round(SUM(p_retailprice), 2), 'Total', -1, 0 FROM part
""")
def grand_total(t):
    out = band(t.part, [], ["p_partkey", "p_name", "p_retailprice"], order_by=["p_partkey"],
               summaries=[Summary(None, (Measure("p_retailprice", "SUM", "p_retailprice"),), ("Total",))])
    return rounded(out, "p_retailprice")


@report("""
    WITH d AS (SELECT c_mktsegment AS segment, c_nationkey AS nation, c_acctbal AS balance FROM customer)
    SELECT segment, nation, COUNT(*) AS n, CAST(NULL AS VARCHAR) AS label, CAST(NULL AS DOUBLE) AS mean,
           2 AS level, CAST(NULL AS INT) AS summary_no FROM d GROUP BY segment, nation
    UNION ALL
    SELECT segment, NULL, COUNT(*), segment || ': ' || CAST(COUNT(*) AS VARCHAR) || ' customers', NULL, 0, 0
    FROM d GROUP BY segment
    UNION ALL
    SELECT segment, NULL, NULL, 'mean of ' || segment, round(AVG(balance), 6), 0, 1 FROM d GROUP BY segment
    UNION ALL
    SELECT NULL, NULL, COUNT(*), 'All ', round(AVG(balance), 6), -1, 2 FROM d
""")
def subtotal_label(t):
    # Two subtotals at one level keep their declared order; a label may hold figures.
    df = t.customer.select(F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("nation"),
                           F.col("c_acctbal").alias("balance"))
    n, mean = Measure("n", "COUNT"), Measure("mean", "AVG", "balance")
    out = band(df, ["segment", "nation"], measures=[n], summaries=[
        Summary("segment", (n,), (GROUP, ": ", n, " customers")),
        Summary("segment", (mean,), ("mean of ", GROUP)),
        Summary(None, (n, mean), ("All ", GROUP))])
    return rounded(out, "mean", digits=6)


@report("""
    WITH d AS (SELECT l_returnflag, l_linestatus, l_suppkey, l_quantity FROM lineitem)
    SELECT l_returnflag, l_linestatus, COUNT(DISTINCT l_suppkey) AS n_suppliers, SUM(l_quantity) AS quantity,
           CAST(NULL AS VARCHAR) AS label, 2 AS level, CAST(NULL AS INT) AS summary_no
    FROM d GROUP BY l_returnflag, l_linestatus
    UNION ALL
    SELECT l_returnflag, NULL, COUNT(DISTINCT l_suppkey), SUM(l_quantity), l_returnflag, 0, 0
    FROM d GROUP BY l_returnflag
    UNION ALL
    SELECT NULL, NULL, COUNT(DISTINCT l_suppkey), SUM(l_quantity), 'all', -1, 1 FROM d
""")
def subtotals_distinct(t):
    # Distinct values are counted anew at every level, never added up.
    totals = (Measure("n_suppliers", "COUNT_DISTINCT", "l_suppkey"), Measure("quantity", "SUM", "l_quantity"))
    return band(t.lineitem, ["l_returnflag", "l_linestatus"], measures=totals,
                summaries=[Summary("l_returnflag", totals, (GROUP,)), Summary(None, totals, ("all",))])


def levels_sql(cells: str, source: str) -> str:
    """Subtotals by flag and status, by flag, and of all, as the band below lists them."""
    return f"""
    WITH d AS ({source})
    SELECT l_returnflag, l_linestatus, {cells}, CAST(NULL AS VARCHAR) AS label, 2 AS level, CAST(NULL AS INT) AS summary_no
    FROM d GROUP BY l_returnflag, l_linestatus
    UNION ALL SELECT l_returnflag, NULL, {cells}, l_returnflag, 0, 0 FROM d GROUP BY l_returnflag
    UNION ALL SELECT NULL, NULL, {cells}, 'all', -1, 1 FROM d"""


def levels_band(t, *totals: Measure):
    return band(t.lineitem, ["l_returnflag", "l_linestatus"], measures=totals,
                summaries=[Summary("l_returnflag", totals, (GROUP,)), Summary(None, totals, ("all",))])


@report(levels_sql("COUNT(DISTINCT l_suppkey) AS n_suppliers, COUNT(DISTINCT l_partkey) AS n_parts, SUM(l_quantity) AS quantity",
                   "SELECT l_returnflag, l_linestatus, l_suppkey, l_partkey, l_quantity FROM lineitem"))
def subtotals_two_distinct(t):
    # Each operand has finest groups of its own, so neither is counted on the rows.
    return levels_band(t, Measure("n_suppliers", "COUNT_DISTINCT", "l_suppkey"), Measure("n_parts", "COUNT_DISTINCT", "l_partkey"),
                       Measure("quantity", "SUM", "l_quantity"))


@report(levels_sql("COUNT(DISTINCT l_partkey) AS n_parts, true AS near, COUNT(*) AS n", "SELECT l_returnflag, l_linestatus, l_partkey FROM lineitem"))
def subtotals_approx(t):
    # Sketches are merged from level to level; they are near the exact figures beside them.
    out = levels_band(t, Measure("n_parts", "COUNT_DISTINCT", "l_partkey"), Measure("about", "COUNT_DISTINCT", "l_partkey", approx=True), Measure("n", "COUNT"))
    near = F.abs(F.col("about") - F.col("n_parts")) <= F.greatest(F.lit(2), F.col("n_parts") * 0.08)
    return out.withColumn("near", near).drop("about")


@report(levels_sql("round(var_pop(l_extendedprice) / 1e6, 4) AS spread, round(stddev_samp(l_discount), 9) AS deviation, COUNT(*) AS n",
                   "SELECT l_returnflag, l_linestatus, l_extendedprice, l_discount FROM lineitem"))
def subtotals_deviation(t):
    out = levels_band(t, Measure("spread", "VARIANCE", "l_extendedprice"), Measure("deviation", "DEVIATION", "l_discount"), Measure("n", "COUNT"))
    return rounded(out.withColumn("spread", F.round(F.col("spread") / 1e6, 4)), "deviation", digits=9)


@report(levels_sql("median(l_extendedprice) AS middle, round(quantile_cont(l_quantity, 0.9), 6) AS upper, SUM(l_quantity) AS quantity",
                   "SELECT l_returnflag, l_linestatus, l_extendedprice, l_quantity FROM lineitem"))
def subtotals_median(t):
    return rounded(levels_band(t, Measure("middle", "MEDIAN", "l_extendedprice"), Measure("upper", "UPPER_TENTH", "l_quantity"),
                               Measure("quantity", "SUM", "l_quantity")), "upper", digits=6)


@report("""
    SELECT p_type, p_brand, p_partkey, p_name FROM part ORDER BY p_type, p_brand, p_partkey
""")
def merged_list(t):
    return detail_list(t.part, ["p_type", "p_brand"], ["p_partkey", "p_name"], order_by=["p_partkey"])


@report("""
    SELECT p_type, p_brand, COUNT(*) AS n_brand, SUM(COUNT(*)) OVER (PARTITION BY p_type)::BIGINT AS n_type,
           round(SUM(SUM(p_retailprice)) OVER (PARTITION BY p_type), 2) AS type_amount,
           any_value(z.n_names) AS type_names
    FROM part JOIN (SELECT p_type AS k, COUNT(DISTINCT p_name) AS n_names FROM part GROUP BY p_type) z ON p_type = z.k
    GROUP BY p_type, p_brand
""")
def parent_total(t):
    out = group_list(t.part, ["p_type", "p_brand"], [
        Measure("n_brand", "COUNT"), Measure("n_type", "COUNT", per="p_type"),
        Measure("type_amount", "SUM", "p_retailprice", per="p_type"),
        Measure("type_names", "COUNT_DISTINCT", "p_name", per="p_type")])
    return rounded(out, "type_amount")


@report("""
    SELECT o_custkey, o_orderkey, o_totalprice,
           round(SUM(o_totalprice) OVER (PARTITION BY o_custkey), 2) AS customer_total,
           COUNT(*) OVER (PARTITION BY o_custkey) AS n_orders
    FROM orders
""")
def detail_with_group_total(t):
    out = detail_list(t.orders, ["o_custkey"], ["o_orderkey", "o_totalprice"], [
        Measure("customer_total", "SUM", "o_totalprice"), Measure("n_orders", "COUNT")], ["o_orderkey"])
    return rounded(out, "customer_total")


@report("""
    SELECT p_type, p_brand, p_partkey, COUNT(*) OVER (PARTITION BY p_type) AS p_type__span,
           ROW_NUMBER() OVER (PARTITION BY p_type ORDER BY p_brand, p_partkey) = 1 AS p_type__head,
           COUNT(*) OVER (PARTITION BY p_type, p_brand) AS p_brand__span,
           ROW_NUMBER() OVER (PARTITION BY p_type, p_brand ORDER BY p_partkey) = 1 AS p_brand__head
    FROM part
""", name="merge_spans")
def merged_cells(t):
    # A subtotal after every type cuts no run that the types do not cut already.
    return merge_spans(t.part.select("p_type", "p_brand", "p_partkey"), ["p_type", "p_brand"], ["p_partkey"],
                       deepest_summary="p_type")


@report("""
    SELECT p_size, p_brand, p_partkey, COUNT(*) OVER (PARTITION BY p_size) AS p_size__span,
           ROW_NUMBER() OVER (PARTITION BY p_size ORDER BY p_brand, p_partkey DESC) = 1 AS p_size__head,
           COUNT(*) OVER (PARTITION BY p_size, p_brand) AS p_brand__span,
           ROW_NUMBER() OVER (PARTITION BY p_size, p_brand ORDER BY p_partkey DESC) = 1 AS p_brand__head
    FROM (SELECT nullif(p_size, 10) AS p_size, p_brand, p_partkey FROM part)
""")
def spans_typed(t):
    # Sizes sort as numbers, the parts of a brand from the last to the first.
    return merge_spans(nulled(t.part, "p_size", 10).select("p_size", "p_brand", "p_partkey"), ["p_size", "p_brand"], ["-p_partkey"],
                       typed_sort=True)


@report("""
    WITH g AS (SELECT p_type, p_brand, COUNT(*) AS n FROM part GROUP BY p_type, p_brand)
    SELECT p_type, p_brand, SUM(n) OVER (PARTITION BY p_type)::BIGINT AS n_type,
           COUNT(*) OVER (PARTITION BY p_type) AS n_type__span,
           ROW_NUMBER() OVER (PARTITION BY p_type ORDER BY p_brand) = 1 AS n_type__head,
           CAST(1 AS BIGINT) AS p_type__span, true AS p_type__head
    FROM g
""")
def merge_spans_agg(t):
    rows = group_list(t.part, ["p_type", "p_brand"], [Measure("n_type", "COUNT", per="p_type")])
    spans = merge_spans(rows, ["p_type", "p_brand"], spans={"n_type": "p_type"})
    # With a subtotal after every brand, each row of the type's column stands alone.
    return merge_spans(spans, ["p_type", "p_brand"], spans=["p_type"], deepest_summary="p_brand")


@report("""
    SELECT 'urgent' AS list, ROW_NUMBER() OVER (ORDER BY o_orderkey) - 1 AS row_no, o_orderkey
    FROM orders WHERE o_orderpriority = '1-URGENT'
    UNION ALL
    SELECT 'large', ROW_NUMBER() OVER (ORDER BY o_totalprice DESC, o_orderkey) - 1, o_orderkey
    FROM orders WHERE o_totalprice > 400000
""")
def independent_column(t):
    # Each column is filtered, sorted and positioned on its own.
    urgent = detail_list(t.orders, [], ["o_orderkey"], where=[Condition("o_orderpriority", "EQ", "1-URGENT")])
    large = detail_list(t.orders, [], ["o_orderkey", "o_totalprice"], where=[Condition("o_totalprice", "GT", 400000)])
    urgent = number_rows(urgent, ["o_orderkey"]).withColumn("list", F.lit("urgent"))
    large = number_rows(large, [F.desc("o_totalprice"), F.asc("o_orderkey")]).withColumn("list", F.lit("large"))
    return urgent.select("list", "row_no", "o_orderkey").unionByName(large.select("list", "row_no", "o_orderkey"))
