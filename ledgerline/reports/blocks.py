"""Blocks repeated per record, with correlated cells of other datasets."""

from pyspark.sql import functions as F

from ledgerline.functions.aggregates import Measure
from ledgerline.functions.predicates import Condition
from ledgerline.operators.blocks import block_rows, correlate, correlate_between, correlate_both, correlate_containing, lookup, records
from ledgerline.reports.catalogue import nulled, report, rounded


def rich(t):
    return records(t.customer.select("c_custkey", "c_name", "c_nationkey", "c_acctbal"),
                   [Condition("c_acctbal", "GT", 5000)])


@report("""
    SELECT c_custkey, c_name, c_acctbal FROM customer
    WHERE nullif(c_mktsegment, 'BUILDING') IS DISTINCT FROM 'MACHINERY' AND c_acctbal > 5000
""")
def loop_records(t):
    # The inequality keeps records whose segment is missing.
    df = nulled(t.customer, "c_mktsegment", "BUILDING")
    found = records(df, [Condition("c_mktsegment", "NE", "MACHINERY"), Condition("c_acctbal", "GT", 5000)],
                    order_by=["c_custkey"])
    return found.select("c_custkey", "c_name", "c_acctbal")


@report("""
    SELECT c_mktsegment, c_nationkey, c_custkey, c_name FROM (
        SELECT *, ROW_NUMBER() OVER (PARTITION BY c_mktsegment, c_nationkey ORDER BY c_custkey) AS rn
        FROM customer WHERE c_acctbal > 0) WHERE rn = 1
""")
def loop_groups(t):
    found = records(t.customer, [Condition("c_acctbal", "GT", 0)], ["c_mktsegment", "c_nationkey"], ["c_custkey"])
    return found.select("c_mktsegment", "c_nationkey", "c_custkey", "c_name")


@report("""
    SELECT c_custkey, c_name, o_orderkey AS first_order, o_totalprice AS first_price
    FROM customer LEFT JOIN (
        SELECT *, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn
        FROM orders WHERE o_orderstatus = 'F') o ON c_custkey = o_custkey AND rn = 1
    WHERE c_acctbal > 5000
""")
def loop_lookup(t):
    out = lookup(rich(t), t.orders, [("c_custkey", "o_custkey")],
                 {"first_order": "o_orderkey", "first_price": "o_totalprice"}, ["o_orderdate", "o_orderkey"],
                 [Condition("o_orderstatus", "EQ", "F")])
    return out.select("c_custkey", "c_name", "first_order", "first_price")


@report("""
    SELECT c_custkey, c_name, COUNT(o_orderkey) AS n_orders, coalesce(round(SUM(o_totalprice), 2), 0.0) AS total,
           COUNT(DISTINCT o_orderpriority) AS n_priorities
    FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus <> 'P'
    WHERE c_acctbal > 5000 GROUP BY c_custkey, c_name
""")
def loop_aggregate(t):
    out = correlate(rich(t), t.orders, [("c_custkey", "o_custkey")], [
        Measure("n_orders", "COUNT"), Measure("total", "SUM", "o_totalprice"),
        Measure("n_priorities", "COUNT_DISTINCT", "o_orderpriority")], [Condition("o_orderstatus", "NE", "P")])
    return rounded(out.select("c_custkey", "c_name", "n_orders", "total", "n_priorities"), "total")


@report("""
    SELECT c_custkey, c_nationkey, COUNT(s_suppkey) AS n, coalesce(round(SUM(s_acctbal), 2), 0.0) AS total,
           coalesce(MAX(s_acctbal), 0.0) AS top, coalesce(MIN(s_acctbal), 0.0) AS low
    FROM customer LEFT JOIN supplier ON c_nationkey = s_nationkey AND s_acctbal <= c_acctbal
    WHERE c_acctbal > 5000 GROUP BY c_custkey, c_nationkey
""")
def loop_threshold(t):
    # Suppliers of the record's nation whose balance does not exceed the record's.
    out = correlate(rich(t), t.supplier, [("c_nationkey", "s_nationkey")], [
        Measure("n", "COUNT"), Measure("total", "SUM", "s_acctbal"), Measure("top", "MAX", "s_acctbal"),
        Measure("low", "MIN", "s_acctbal")], threshold=("s_acctbal", "LE", "c_acctbal"))
    return rounded(out.select("c_custkey", "c_nationkey", "n", "total", "top", "low"), "total")


@report("""
    SELECT c_custkey, COUNT(DISTINCT o_orderpriority) AS n_kinds, COUNT(o_orderkey) AS n
    FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice >= c_acctbal * 20
    WHERE c_acctbal > 5000 GROUP BY c_custkey
""")
def loop_threshold_distinct(t):
    recs = rich(t).withColumn("floor", F.col("c_acctbal") * 20)
    out = correlate(recs, t.orders, [("c_custkey", "o_custkey")], [
        Measure("n_kinds", "COUNT_DISTINCT", "o_orderpriority"), Measure("n", "COUNT")], threshold=("o_totalprice", "GE", "floor"))
    return out.select("c_custkey", "n_kinds", "n")


@report("""
    SELECT c_custkey, COUNT(o_orderkey) AS n, coalesce(round(SUM(o_totalprice), 2), 0.0) AS total
    FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice BETWEEN c_acctbal * 10 AND c_acctbal * 30
    WHERE c_acctbal > 5000 GROUP BY c_custkey
""")
def loop_interval(t):
    recs = rich(t).withColumn("low", F.col("c_acctbal") * 10).withColumn("high", F.col("c_acctbal") * 30)
    out = correlate_between(recs, t.orders, [("c_custkey", "o_custkey")], [
        Measure("n", "COUNT"), Measure("total", "SUM", "o_totalprice")], "o_totalprice", "low", "high")
    return rounded(out.select("c_custkey", F.col("n").cast("long").alias("n"), "total"), "total")


@report("""
    SELECT c_custkey, (SELECT o_orderkey FROM orders WHERE o_custkey = c_custkey AND o_totalprice >= c_acctbal * 20
      ORDER BY o_totalprice, o_orderkey LIMIT 1) AS next_order
    FROM customer WHERE c_acctbal > 5000
""")
def lookup_as_of(t):
    # The customer's cheapest order that is not below a price.
    recs = rich(t).withColumn("floor", F.col("c_acctbal") * 20)
    return lookup(recs, t.orders, [("c_custkey", "o_custkey")], {"next_order": "o_orderkey"}, ["o_totalprice", "o_orderkey"],
                  threshold=("o_totalprice", "GE", "floor")).select("c_custkey", "next_order")


@report("""
    SELECT a.o_orderkey, COUNT(b.o_orderkey) AS n_later, coalesce(round(SUM(b.o_totalprice), 2), 0.0) AS later_total
    FROM orders a LEFT JOIN orders b ON a.o_custkey = b.o_custkey AND b.o_orderdate > a.o_orderdate
    GROUP BY a.o_orderkey
""")
def loop_later_rows(t):
    # What the customer ordered after each order; a self-join of pairs would grow with their square.
    orders = t.orders.select("o_orderkey", "o_custkey", "o_orderdate")
    later = t.orders.select(F.col("o_custkey").alias("k"), F.col("o_orderdate").alias("day"), "o_totalprice")
    out = correlate(orders, later, [("o_custkey", "k")], [
        Measure("n_later", "COUNT"), Measure("later_total", "SUM", "o_totalprice")], threshold=("day", "GT", "o_orderdate"))
    return rounded(out.select("o_orderkey", "n_later", "later_total"), "later_total")


@report("""
    SELECT s_suppkey, COUNT(c_custkey) AS n_others, coalesce(MAX(c_acctbal), 0.0) AS top
    FROM supplier LEFT JOIN (SELECT *, nullif(c_mktsegment, 'BUILDING') AS segment FROM customer) c
      ON s_nationkey = c_nationkey
      AND segment IS DISTINCT FROM CASE WHEN s_acctbal > 5000 THEN 'MACHINERY' END
    GROUP BY s_suppkey
""")
def loop_unequal(t):
    # Customers of the supplier's nation in any other segment, a missing segment being one as well.
    suppliers = t.supplier.withColumn("segment", F.when(F.col("s_acctbal") > 5000, "MACHINERY"))
    customers = nulled(t.customer, "c_mktsegment", "BUILDING")
    out = correlate(suppliers, customers, [("s_nationkey", "c_nationkey")], [
        Measure("n_others", "COUNT"), Measure("top", "MAX", "c_acctbal")], threshold=("c_mktsegment", "NE", "segment"))
    return out.select("s_suppkey", "n_others", "top")


@report("""
    SELECT a.o_orderkey, COUNT(b.o_orderkey) AS n, coalesce(round(SUM(b.o_totalprice), 2), 0.0) AS total,
           coalesce(round(AVG(b.o_totalprice), 6), 0.0) AS mean
    FROM orders a LEFT JOIN orders b ON a.o_custkey = b.o_custkey AND b.o_orderdate <= a.o_orderdate AND b.o_totalprice >= a.o_totalprice
    GROUP BY a.o_orderkey
""")
def loop_two_bounds(t):
    # What the customer had ordered by then for as much or more, the order itself included.
    orders = t.orders.select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")
    before = t.orders.select(F.col("o_custkey").alias("k"), F.col("o_orderdate").alias("day"), F.col("o_totalprice").alias("price"))
    out = correlate_both(orders, before, [("o_custkey", "k")], [
        Measure("n", "COUNT"), Measure("total", "SUM", "price"), Measure("mean", "AVG", "price")],
        ("day", "LE", "o_orderdate"), ("price", "GE", "o_totalprice"))
    return rounded(rounded(out.select("o_orderkey", "n", "total", "mean"), "total"), "mean", digits=6)


def priced(t):
    return rich(t).withColumn("low", F.col("c_acctbal") * 10).withColumn("high", F.col("c_acctbal") * 30)


@report("""
    SELECT c_custkey, coalesce(MIN(o_totalprice), 0.0) AS least, coalesce(MAX(o_totalprice), 0.0) AS most, MAX(o_orderdate) AS latest
    FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice BETWEEN c_acctbal * 10 AND c_acctbal * 30
    WHERE c_acctbal > 5000 GROUP BY c_custkey
""")
def loop_interval_extremes(t):
    out = correlate_between(priced(t), t.orders, [("c_custkey", "o_custkey")], [
        Measure("least", "MIN", "o_totalprice"), Measure("most", "MAX", "o_totalprice"),
        Measure("latest", "MAX", "o_orderdate", typed=True)], "o_totalprice", "low", "high")
    return out.select("c_custkey", "least", "most", "latest")


@report("""
    SELECT c_custkey, COUNT(DISTINCT o_orderpriority) AS n_kinds
    FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice BETWEEN c_acctbal * 10 AND c_acctbal * 30
    WHERE c_acctbal > 5000 GROUP BY c_custkey
""")
def loop_interval_distinct(t):
    out = correlate_between(priced(t), t.orders, [("c_custkey", "o_custkey")], [
        Measure("n_kinds", "COUNT_DISTINCT", "o_orderpriority")], "o_totalprice", "low", "high")
    return out.select("c_custkey", "n_kinds")


@report("""
    SELECT s_suppkey, COUNT(DISTINCT c_mktsegment) AS n_segments
    FROM supplier LEFT JOIN customer ON s_nationkey = c_nationkey AND c_mktsegment <> CASE WHEN s_acctbal > 5000 THEN 'MACHINERY' ELSE 'BUILDING' END
    GROUP BY s_suppkey
""")
def loop_unequal_distinct(t):
    suppliers = t.supplier.withColumn("segment", F.when(F.col("s_acctbal") > 5000, "MACHINERY").otherwise("BUILDING"))
    out = correlate(suppliers, t.customer, [("s_nationkey", "c_nationkey")], [
        Measure("n_segments", "COUNT_DISTINCT", "c_mktsegment")], threshold=("c_mktsegment", "NE", "segment"))
    return out.select("s_suppkey", "n_segments")


@report("""
    WITH found AS (
        SELECT needle, COUNT(*) AS n, round(SUM(value), 2) AS total
        FROM (SELECT DISTINCT 'k": ' || p_size AS needle FROM part) JOIN events ON contains(props, needle) GROUP BY needle)
    SELECT p_partkey, coalesce(n, 0) AS n, coalesce(total, 0.0) AS total FROM part LEFT JOIN found ON needle = 'k": ' || p_size
""")
def loop_contains(t):
    # Events whose properties mention the part's size, or a number that begins with it.
    parts = t.part.select("p_partkey", F.concat(F.lit('k": '), "p_size").alias("needle"))
    out = correlate_containing(parts, t.events, [], [Measure("n", "COUNT"), Measure("total", "SUM", "value")], "props", "needle")
    return rounded(out.select("p_partkey", "n", "total"), "total")


@report("""
    WITH r AS (SELECT *, ROW_NUMBER() OVER (ORDER BY c_custkey) - 1 AS record_no FROM customer WHERE c_acctbal > 5000)
    SELECT c_custkey, record_no, 0 AS block_row, record_no * 3 AS row_no, 'Name' AS a, 'Nation' AS b FROM r
    UNION ALL SELECT c_custkey, record_no, 1, record_no * 3 + 1, c_name, CAST(c_nationkey AS VARCHAR) FROM r
    UNION ALL SELECT c_custkey, record_no, 2, record_no * 3 + 2, '', '' FROM r
""", name="block_rows")
def customer_blocks(t):
    block = [{"a": F.lit("Name"), "b": F.lit("Nation")}, {"a": F.col("c_name"), "b": F.col("c_nationkey")}, {}]
    return block_rows(rich(t), block, ["c_custkey"], keep=["c_custkey"])
