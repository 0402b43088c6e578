"""Drill-through from figures to the rows behind them."""

from pyspark.sql import functions as F

from ledgerline.functions.aggregates import Measure
from ledgerline.functions.predicates import Condition, filter_all
from ledgerline.operators.bands import group_list
from ledgerline.operators.blocks import records
from ledgerline.operators.crosstab import crosstab_cells
from ledgerline.operators.drill import drill_interval, drill_rows, drill_threshold, drill_view
from ledgerline.operators.relations import join_on
from ledgerline.reports.catalogue import nulled, report


@report("""
    SELECT o_orderkey, nullif(o_orderstatus, 'P') AS o_orderstatus, o_orderpriority FROM orders
    WHERE (o_orderstatus = 'P' AND o_orderpriority = '1-URGENT') OR (o_orderstatus = 'F' AND o_orderpriority = '5-LOW')
""", name="drill_rows")
def drill_cells(t):
    df = nulled(t.orders, "o_orderstatus", "P").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    cells = [{"o_orderstatus": None, "o_orderpriority": "1-URGENT"}, {"o_orderstatus": "F", "o_orderpriority": "5-LOW"}]
    return drill_rows(df, cells, ["o_orderstatus", "o_orderpriority"])


@report("""
    SELECT l_orderkey, l_linenumber, l_suppkey, l_quantity FROM lineitem
    WHERE l_suppkey IN (SELECT l_suppkey FROM lineitem GROUP BY l_suppkey HAVING SUM(l_quantity) > 15000)
""")
def drill_figures(t):
    # Every figure above a limit, drilled at once; the figures carry their own keys.
    figures = group_list(t.lineitem, ["l_suppkey"], [Measure("quantity", "SUM", "l_quantity")]).filter("quantity > 15000")
    return drill_rows(t.lineitem, figures, ["l_suppkey"]).select("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity")


@report("""
    SELECT o_orderkey, o_custkey, o_totalprice FROM orders
    WHERE o_orderstatus = 'F' AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 9000)
""")
def drill_blocks(t):
    # The rows behind the correlated figures of the chosen records.
    chosen = records(t.customer, [Condition("c_acctbal", "GT", 9000)]).select(F.col("c_custkey").alias("o_custkey"))
    counted = filter_all(t.orders, Condition("o_orderstatus", "EQ", "F"))
    return drill_rows(counted, chosen, ["o_custkey"]).select("o_orderkey", "o_custkey", "o_totalprice")


@report("""
    SELECT DISTINCT s_suppkey, s_name, s_acctbal FROM supplier JOIN customer ON s_nationkey = c_nationkey AND s_acctbal <= c_acctbal
    WHERE c_custkey < 20
""", name="drill_threshold")
def drill_correlated(t):
    # The suppliers behind the correlated figures of some customers.
    chosen = records(t.customer, [Condition("c_custkey", "LT", 20)])
    found = drill_threshold(chosen, t.supplier, [("c_nationkey", "s_nationkey")], ("s_acctbal", "LE", "c_acctbal"))
    return found.select("s_suppkey", "s_name", "s_acctbal")


@report("""
    SELECT o_orderkey, o_custkey, o_totalprice FROM orders
    WHERE EXISTS (SELECT 1 FROM customer WHERE c_nationkey < 5 AND o_totalprice BETWEEN c_acctbal * 10 AND c_acctbal * 10 + 50 AND c_acctbal > 5000)
""", name="drill_interval")
def drill_ranges(t):
    # The orders behind the figures of some customers' price ranges, which overlap.
    chosen = records(t.customer, [Condition("c_nationkey", "LT", 5), Condition("c_acctbal", "GT", 5000)]) \
        .withColumn("low", F.col("c_acctbal") * 10).withColumn("high", F.col("c_acctbal") * 10 + 50)
    return drill_interval(chosen, t.orders, [], "o_totalprice", "low", "high").select("o_orderkey", "o_custkey", "o_totalprice")


@report("""
    SELECT p_partkey, p_brand, nullif(p_size, 10) AS p_size FROM part
    WHERE p_brand IN (SELECT p_brand FROM part WHERE p_size = 10 GROUP BY p_brand HAVING COUNT(*) >= 2) AND p_size = 10
""")
def drill_crosstab(t):
    # Cells of a cross-tab under its missing header that hold two rows or more.
    df = nulled(t.part, "p_size", 10)
    cells = crosstab_cells(df, ["p_brand"], "p_size", [Measure("n", "COUNT")], dense=False)
    return drill_rows(df, cells.filter("p_size IS NULL AND n >= 2"), ["p_brand", "p_size"]).select(
        "p_partkey", "p_brand", "p_size")


@report("""
    SELECT DISTINCT c_custkey, c_name, c_mktsegment FROM customer JOIN orders ON c_custkey = o_custkey
    WHERE o_orderpriority = '2-HIGH'
""", name="drill_view")
def drill_customers(t):
    # The join repeats customers per order; the view shows each of them once.
    joined = join_on(t.orders, t.customer, [("o_custkey", "c_custkey")], right_unique=True)
    behind = drill_rows(joined, [{"o_orderpriority": "2-HIGH"}], ["o_orderpriority"])
    return drill_view(behind, ["c_custkey", "c_name", "c_mktsegment"], ["c_custkey"], [F.asc("o_orderkey")])
