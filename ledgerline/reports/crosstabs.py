"""Cross-tabs with headers from the data, empty cells and margins."""

from pyspark.sql import functions as F

from ledgerline.functions.aggregates import Measure
from ledgerline.operators.crosstab import crosstab_cells, crosstab_totals, crosstab_wide
from ledgerline.operators.relations import join_on
from ledgerline.reports.catalogue import nulled, report, rounded

GRID_SQL = """
    WITH d AS (SELECT p_brand, nullif(p_size, 10) AS p_size, p_retailprice FROM part),
    grid AS (SELECT * FROM (SELECT DISTINCT p_brand FROM d) CROSS JOIN (SELECT DISTINCT p_size FROM d))
"""


@report(GRID_SQL + """
    SELECT g.p_brand, g.p_size, coalesce(round(SUM(p_retailprice), 2), 0.0) AS amount, COUNT(p_retailprice) AS n,
           coalesce(MIN(p_retailprice), 0.0) AS low
    FROM grid g LEFT JOIN d ON g.p_brand = d.p_brand AND g.p_size IS NOT DISTINCT FROM d.p_size
    GROUP BY g.p_brand, g.p_size
""")
def crosstab(t):
    df = nulled(t.part, "p_size", 10)
    out = crosstab_cells(df, ["p_brand"], "p_size", [
        Measure("amount", "SUM", "p_retailprice"), Measure("n", "COUNT"), Measure("low", "MIN", "p_retailprice")])
    return rounded(out, "amount")


@report("""
    SELECT p_brand, nullif(p_size, 10) AS p_size, COUNT(DISTINCT p_name) AS n_names
    FROM part GROUP BY p_brand, nullif(p_size, 10)
""")
def crosstab_sparse(t):
    return crosstab_cells(nulled(t.part, "p_size", 10), ["p_brand"], "p_size",
                          [Measure("n_names", "COUNT_DISTINCT", "p_name")], dense=False)


@report("""
    SELECT c_nationkey, COUNT(*) FILTER (WHERE c_mktsegment = 'BUILDING') AS "null",
           COUNT(*) FILTER (WHERE c_mktsegment = 'AUTOMOBILE') AS AUTOMOBILE,
           COUNT(*) FILTER (WHERE c_mktsegment = 'FURNITURE') AS FURNITURE,
           COUNT(*) FILTER (WHERE c_mktsegment = 'HOUSEHOLD') AS HOUSEHOLD,
           COUNT(*) FILTER (WHERE c_mktsegment = 'MACHINERY') AS MACHINERY
    FROM customer GROUP BY c_nationkey
""", name="crosstab_wide")
def segments_wide(t):
    return crosstab_wide(nulled(t.customer, "c_mktsegment", "BUILDING"), ["c_nationkey"], "c_mktsegment",
                         Measure("n", "COUNT"))


@report("""
    WITH d AS (SELECT nullif(l_returnflag, 'N') AS flag, l_linestatus AS status, l_quantity AS q FROM lineitem),
    grid AS (SELECT * FROM (SELECT DISTINCT flag FROM d) CROSS JOIN (SELECT DISTINCT status FROM d))
    SELECT g.flag, g.status, 'cell' AS margin, coalesce(SUM(q), 0.0) AS value
    FROM grid g LEFT JOIN d ON g.flag IS NOT DISTINCT FROM d.flag AND g.status = d.status GROUP BY g.flag, g.status
    UNION ALL
    SELECT flag, NULL, 'row_total', CAST(COUNT(*) AS DOUBLE) FROM d GROUP BY flag
    UNION ALL
    SELECT NULL, status, 'column_total', SUM(q) FROM d GROUP BY status
    UNION ALL
    SELECT NULL, NULL, 'grand_total', round(AVG(q), 6) FROM d
""", name="crosstab_totals")
def flags_with_totals(t):
    df = t.lineitem.select(F.nullif(F.col("l_returnflag"), F.lit("N")).alias("flag"),
                           F.col("l_linestatus").alias("status"), F.col("l_quantity").alias("q"))
    out = crosstab_totals(df, "flag", "status", Measure("cell", "SUM", "q"), row_total=Measure("rows", "COUNT"),
                          grand_total=Measure("mean", "AVG", "q"))
    return rounded(out, "value", digits=6)


@report("""
    WITH grid AS (SELECT * FROM (SELECT DISTINCT o_orderstatus FROM orders) CROSS JOIN (SELECT o_orderkey FROM orders))
    SELECT g.o_orderstatus, g.o_orderkey, coalesce(o_totalprice, 0.0) AS price
    FROM grid g LEFT JOIN orders o ON g.o_orderstatus = o.o_orderstatus AND g.o_orderkey = o.o_orderkey
""")
def crosstab_dense_many(t):
    # A header for each order: the grid has no limit.
    return crosstab_cells(t.orders, ["o_orderstatus"], "o_orderkey", [Measure("price", "SUM", "o_totalprice")])


@report("""
    WITH d AS (SELECT n_name, n_regionkey, c_mktsegment, c_acctbal FROM customer JOIN nation ON c_nationkey = n_nationkey),
    grid AS (SELECT * FROM (SELECT DISTINCT n_name, n_regionkey FROM d) CROSS JOIN (SELECT DISTINCT c_mktsegment FROM d))
    SELECT g.n_name, g.n_regionkey, g.c_mktsegment, 'cell' AS margin, coalesce(round(SUM(c_acctbal), 2), 0.0) AS value
    FROM grid g LEFT JOIN d ON g.n_name = d.n_name AND g.c_mktsegment = d.c_mktsegment
    GROUP BY g.n_name, g.n_regionkey, g.c_mktsegment
    UNION ALL
    SELECT n_name, n_regionkey, NULL, 'row_total', CAST(COUNT(*) AS DOUBLE) FROM d GROUP BY n_name, n_regionkey
    UNION ALL
    SELECT NULL, NULL, c_mktsegment, 'column_total', round(SUM(c_acctbal), 2) FROM d GROUP BY c_mktsegment
    UNION ALL
    SELECT NULL, NULL, NULL, 'grand_total', round(SUM(c_acctbal), 2) FROM d
""")
def crosstab_attr_totals(t):
    df = join_on(t.customer, t.nation, [("c_nationkey", "n_nationkey")], right_unique=True)
    out = crosstab_totals(df, ["n_name", "n_regionkey"], "c_mktsegment", Measure("balance", "SUM", "c_acctbal"),
                          row_total=Measure("n", "COUNT"))
    return rounded(out, "value")


@report("""
    WITH d AS (SELECT n_name, n_regionkey, c_mktsegment, c_acctbal FROM customer JOIN nation ON c_nationkey = n_nationkey),
    grid AS (SELECT * FROM (SELECT DISTINCT n_name, n_regionkey FROM d) CROSS JOIN (SELECT DISTINCT c_mktsegment FROM d))
    SELECT g.n_name, g.n_regionkey, g.c_mktsegment, coalesce(round(SUM(c_acctbal), 2), 0.0) AS balance
    FROM grid g LEFT JOIN d ON g.n_name = d.n_name AND g.c_mktsegment = d.c_mktsegment
    GROUP BY g.n_name, g.n_regionkey, g.c_mktsegment
""")
def crosstab_row_attr(t):
    df = join_on(t.customer, t.nation, [("c_nationkey", "n_nationkey")])
    out = crosstab_cells(df, ["n_name", "n_regionkey"], "c_mktsegment", [Measure("balance", "SUM", "c_acctbal")])
    return rounded(out, "balance")
