"""Aggregates, single figures and first rows."""

from pyspark.sql import functions as F

from ledgerline.functions.aggregates import Measure, first_values, kpi
from ledgerline.functions.predicates import Condition, filter_all
from ledgerline.functions.scalars import text
from ledgerline.operators.bands import group_list
from ledgerline.operators.ordering import distinct_first, header_values
from ledgerline.reports.catalogue import nulled, report, rounded


@report("""
    SELECT l_returnflag, l_linestatus, round(SUM(l_extendedprice), 2) AS total, round(AVG(l_quantity), 6) AS mean,
           MIN(l_tax) AS low, MAX(l_quantity) AS high, COUNT(*) AS n, COUNT(DISTINCT l_suppkey) AS n_suppliers,
           MIN(CAST(l_shipdate AS DATE)) AS first_day, CAST(0 AS DOUBLE) AS no_numbers
    FROM lineitem GROUP BY l_returnflag, l_linestatus
""")
def agg_all(t):
    out = group_list(t.lineitem, ["l_returnflag", "l_linestatus"], [
        Measure("total", "SUM", "l_extendedprice"), Measure("mean", "AVG", "l_quantity"),
        Measure("low", "MIN", "l_tax"), Measure("high", "MAX", "l_quantity"), Measure("n", "COUNT", "l_tax"),
        Measure("n_suppliers", "COUNT_DISTINCT", "l_suppkey"),
        Measure("first_day", "MIN", F.col("l_shipdate").cast("date"), typed=True),
        # Text without numbers adds up to zero.
        Measure("no_numbers", "SUM", "l_linestatus")])
    return rounded(rounded(out, "total"), "mean", digits=6)


@report("""
    SELECT p_type, round(SUM(CASE WHEN p_size > 25 THEN CAST(p_size AS DOUBLE) END), 2) AS total,
           coalesce(MAX(CASE WHEN p_size > 25 THEN CAST(p_size AS DOUBLE) END), 0.0) AS high, COUNT(*) AS n
    FROM part GROUP BY p_type
""")
def agg_loose_text(t):
    # Numeric text counts as numbers, other text is skipped.
    text = F.when(F.col("p_size") > 25, F.col("p_size").cast("string")).otherwise("small")
    return group_list(t.part, ["p_type"], [
        Measure("total", "SUM", text), Measure("high", "MAX", text), Measure("n", "COUNT", text)])


@report("""
    SELECT l_returnflag, COUNT(DISTINCT l_linenumber) FILTER (WHERE l_linenumber <> 3)
           + MAX(CASE WHEN l_linenumber = 3 THEN 1 ELSE 0 END) AS n_numbers,
           COUNT(DISTINCT l_partkey) AS n_parts
    FROM lineitem GROUP BY l_returnflag
""")
def agg_count_distinct(t):
    df = nulled(t.lineitem, "l_linenumber", 3)
    return group_list(df, ["l_returnflag"], [
        Measure("n_numbers", "COUNT_DISTINCT", "l_linenumber"), Measure("n_parts", "COUNT_DISTINCT", "l_partkey")])


@report("""
    SELECT c_mktsegment, COUNT(*) AS n, round(AVG(c_acctbal), 6) AS mean, MAX(c_acctbal) AS top
    FROM customer GROUP BY c_mktsegment
""")
def group_stats(t):
    out = group_list(t.customer, ["c_mktsegment"], [
        Measure("n", "COUNT"), Measure("mean", "AVG", "c_acctbal"), Measure("top", "MAX", "c_acctbal")])
    return rounded(out, "mean", digits=6)


@report("""
    SELECT event_type, nullif(user_id % 10, 3) AS bucket, COUNT(*) AS n, round(SUM(value), 2) AS total
    FROM events GROUP BY event_type, nullif(user_id % 10, 3)
""")
def group_null_keys(t):
    # A missing group is a group; groups sort by their text.
    df = t.events.withColumn("bucket", F.nullif(F.col("user_id") % 10, F.lit(3)))
    return rounded(group_list(df, ["event_type", "bucket"], [Measure("n", "COUNT"), Measure("total", "SUM", "value")]), "total")


@report("""
    SELECT COUNT(*) AS n, round(SUM(o_totalprice), 2) AS total, round(AVG(o_totalprice), 6) AS mean,
           COUNT(DISTINCT o_custkey) AS n_customers
    FROM orders WHERE o_orderstatus = 'F'
""")
def kpi_cells(t):
    found = filter_all(t.orders, Condition("o_orderstatus", "EQ", "F"))
    out = kpi(found, Measure("n", "COUNT"), Measure("total", "SUM", "o_totalprice"),
              Measure("mean", "AVG", "o_totalprice"), Measure("n_customers", "COUNT_DISTINCT", "o_custkey"))
    return rounded(rounded(out, "total"), "mean", digits=6)


@report("""
    SELECT o_orderkey AS first_order, 'by ' || CAST(o_custkey AS VARCHAR) AS buyer
    FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderdate, o_orderkey LIMIT 1
""")
def kpi_first_row(t):
    found = filter_all(t.orders, Condition("o_orderstatus", "EQ", "F"))
    return first_values(found, {"first_order": "o_orderkey", "buyer": text(found, "by ", F.col("o_custkey"))},
                        ["o_orderdate", "o_orderkey"])


@report("""
    SELECT o_orderkey AS last_order, o_totalprice AS price
    FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1
""")
def kpi_last_row(t):
    found = filter_all(t.orders, Condition("o_orderstatus", "EQ", "F"))
    return first_values(found, {"last_order": "o_orderkey", "price": "o_totalprice"}, [F.desc("o_orderdate"), F.desc("o_orderkey")])


@report("""
    SELECT o_orderstatus, round(SUM(CAST(o_orderkey + 4611686018427387904 AS DOUBLE)) / 1e18, 3) AS total
    FROM orders GROUP BY o_orderstatus
""")
def sum_large_integers(t):
    # Integers in the upper half of their range: two of them leave it when they are added.
    large = t.orders.select("o_orderstatus", (F.col("o_orderkey") + F.lit(1 << 62)).alias("large"))
    out = group_list(large, ["o_orderstatus"], [Measure("total", "SUM", "large")])
    return out.withColumn("total", F.round(F.col("total") / 1e18, 3))


@report("""
    SELECT CAST(0 AS BIGINT) AS n, CAST(0 AS DOUBLE) AS total, CAST(0 AS DOUBLE) AS mean,
           CAST(0 AS DOUBLE) AS low, CAST(0 AS BIGINT) AS n_customers
    FROM (SELECT COUNT(*) AS c FROM orders WHERE o_totalprice < 0) z WHERE c = 0
""")
def kpi_empty(t):
    # Over no rows every figure is zero.
    found = filter_all(t.orders, Condition("o_totalprice", "LT", 0))
    return kpi(found, Measure("n", "COUNT"), Measure("total", "SUM", "o_totalprice"),
               Measure("mean", "AVG", "o_totalprice"), Measure("low", "MIN", "o_totalprice"),
               Measure("n_customers", "COUNT_DISTINCT", "o_custkey"))


@report("""
    SELECT o_custkey, o_orderkey, o_orderdate, o_totalprice FROM (
        SELECT *, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders)
    WHERE rn = 1
""", name="distinct_first")
def first_orders(t):
    out = distinct_first(t.orders, ["o_custkey"], ["o_orderdate", "o_orderkey"])
    return out.select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice")


@report("""
    SELECT DISTINCT nullif(p_type, 'PROMO') AS p_type FROM part
""", name="header_values")
def type_headers(t):
    return header_values(nulled(t.part, "p_type", "PROMO"), "p_type")
