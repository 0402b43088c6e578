"""Text interpolation, scalar functions, dictionaries and the open registries."""

from pyspark.sql import functions as F

from ledgerline.functions import aggregates as A
from ledgerline.functions import predicates as C
from ledgerline.functions import scalars as S
from ledgerline.functions.aggregates import Measure, kpi
from ledgerline.functions.predicates import Condition
from ledgerline.operators.bands import group_list
from ledgerline.operators.dictionaries import map_codes
from ledgerline.reports.catalogue import nulled, report, rounded


A.register_aggregate("SPREAD", lambda v: F.max(v) - F.min(v),
                     parts=lambda v: {"low": F.min(v), "high": F.max(v)}, finish=lambda p: p["high"] - p["low"])
A.register_aggregate("TRUE_COUNT", F.count_if, numeric=False, parts=lambda v: {"n": F.count_if(v)}, finish=lambda p: p["n"])
A.register_aggregate("VARIANCE", F.var_pop, moments=lambda n, mean, squares: F.when(n > 0, squares / n))
A.register_aggregate("DEVIATION", F.stddev_samp, moments=lambda n, mean, squares: F.when(n > 1, F.sqrt(squares / (n - 1))))
A.register_aggregate("MEDIAN", F.median, quantile=0.5)
A.register_aggregate("UPPER_TENTH", lambda v: F.percentile(v, 0.9), quantile=0.9)
C.register_predicate("MATCHES", lambda df, left, right: F.coalesce(left.rlike(right), F.lit(False)))
S.register_function("mask", lambda df, value, keep: F.concat(
    F.substring(value, 1, keep), F.regexp_replace(F.substr(value, F.lit(keep + 1)), "[0-9]", "*")))


@report("""
    SELECT c_custkey,
           'No. ' || CAST(c_custkey AS VARCHAR) || ' (' || coalesce(nullif(c_mktsegment, 'BUILDING'), '') || '): '
           || CASE WHEN c_acctbal = floor(c_acctbal) THEN CAST(CAST(c_acctbal AS BIGINT) AS VARCHAR)
                   ELSE CAST(c_acctbal AS VARCHAR) END AS line
    FROM customer
""")
def text_template(t):
    df = nulled(t.customer, "c_mktsegment", "BUILDING")
    line = S.text(df, "No. ", F.col("c_custkey"), " (", F.col("c_mktsegment"), "): ", F.col("c_acctbal"))
    return df.select("c_custkey", line.alias("line"))


@report("""
    SELECT 'Orders: ' || CAST(COUNT(*) AS VARCHAR) || ', average ' ||
           CASE WHEN round(AVG(o_totalprice), 2) = floor(round(AVG(o_totalprice), 2))
                THEN CAST(CAST(round(AVG(o_totalprice), 2) AS BIGINT) AS VARCHAR)
                ELSE CAST(round(AVG(o_totalprice), 2) AS VARCHAR) END AS line
    FROM orders
""")
def kpi_text(t):
    figures = kpi(t.orders, Measure("n", "COUNT"), Measure("mean", "AVG", "o_totalprice"))
    return figures.select(S.text(
        figures, "Orders: ", F.col("n"), ", average ", F.round("mean", 2)).alias("line"))


@report("""
    SELECT o_orderkey,
           coalesce(format('{:,.2f}', o_totalprice), '') AS amount,
           strftime(o_orderdate, '%Y/%m/%d') AS day,
           strftime(o_orderdate, '%d.%m.%Y') AS day_from_text,
           o_orderpriority AS not_a_day,
           round(o_totalprice, 0) AS whole,
           CAST(CAST(o_orderkey AS DOUBLE) AS VARCHAR) || '/' || coalesce(nullif(o_orderstatus, 'P'), '') AS tag
    FROM orders
""")
def scalar_functions(t):
    df = nulled(t.orders, "o_orderstatus", "P").withColumn("day", F.date_format("o_orderdate", "yyyy-MM-dd"))
    return df.select(
        "o_orderkey",
        S.call(df, "format", F.col("o_totalprice"), "#,##0.00").alias("amount"),
        S.call(df, "date", F.col("o_orderdate"), "yyyy/MM/dd").alias("day"),
        S.call(df, "date", F.col("day"), "dd.MM.yyyy").alias("day_from_text"),
        S.call(df, "date", F.col("o_orderpriority"), "yyyy").alias("not_a_day"),
        S.call(df, "round", F.col("o_totalprice"), 0).alias("whole"),
        S.call(df, "concat", F.col("o_orderkey"), "/", F.col("o_orderstatus")).alias("tag"))


@report("""
    SELECT p_partkey,
           CASE WHEN p_size <> 10 THEN 'other' ELSE 'ten' END AS by_number,
           CASE WHEN substr(p_brand, 7) = '1' OR substr(p_brand, 7) IS NULL THEN 'first' ELSE 'later' END AS by_text,
           CASE WHEN p_name <> 'red widget' THEN p_name ELSE 'none' END AS by_null,
           CASE WHEN p_retailprice > 950 THEN p_retailprice ELSE 0.0 END AS by_flag
    FROM part
""")
def scalar_if(t):
    df = t.part.withColumns({
        "number": F.col("p_size") - 10,
        # Numeric text that is zero counts as false.
        "number_text": (F.substr("p_brand", F.lit(7)).cast("int") - 1).cast("string"),
        "name": F.nullif(F.col("p_name"), F.lit("red widget"))})
    return df.select(
        "p_partkey",
        S.call(df, "if", F.col("number"), "other", "ten").alias("by_number"),
        S.call(df, "if", F.col("number_text"), "later", "first").alias("by_text"),
        S.call(df, "if", F.col("name"), F.col("name"), "none").alias("by_null"),
        S.call(df, "if", F.col("p_retailprice") > 950, F.col("p_retailprice"), 0.0).alias("by_flag"))


@report("""
    SELECT o_orderkey,
           CASE o_orderstatus WHEN 'F' THEN 'finished' WHEN 'O' THEN 'open' ELSE o_orderstatus END AS status,
           CASE CAST(substr(o_orderpriority, 1, 1) AS INT)
                WHEN 1 THEN 'now' WHEN 2 THEN 'soon' ELSE substr(o_orderpriority, 1, 1) END AS priority,
           o_orderstatus AS unmapped
    FROM orders
""")
def map_dictionary(t):
    df = t.orders.withColumn("rank", F.substring("o_orderpriority", 1, 1).cast("double"))
    df = map_codes(df, "o_orderstatus", [("F", "old"), ("F", "finished"), ("O", "open"), ("X", "unused")], "status")
    df = map_codes(df, "rank", [("1", "now"), ("2", "soon"), ("urgent", "unused")], "priority")
    df = map_codes(df, "o_orderstatus", None, "unmapped")
    return df.select("o_orderkey", "status", "priority", "unmapped")


@report("""
    SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'finished' WHEN 'O' THEN 'open' ELSE o_orderstatus END AS status
    FROM orders
""")
def map_dictionary_frame(t):
    # Codes given twice: the later entry counts, and no row is repeated.
    codes = t.orders.sparkSession.createDataFrame(
        [("F", "old", 1), ("F", "finished", 2), ("O", "open", 5), ("O", "waiting", 4)], "code string, label string, entered int")
    return map_codes(t.orders, "o_orderstatus", codes, "status", latest="entered").select("o_orderkey", "status")


@report("""
    SELECT l_orderkey, l_linenumber, l_partkey, format('{:,.2f}', l_extendedprice) AS price,
           format('{:.0f}', l_discount * 100) || '%' AS discount,
           CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) AS quantity
    FROM lineitem
""")
def display_format(t):
    df = t.lineitem
    return df.select("l_orderkey", "l_linenumber", "l_partkey",
                     S.display_format(df, F.col("l_extendedprice"), "#,##0.00").alias("price"),
                     S.display_format(df, F.col("l_discount"), "0%").alias("discount"),
                     S.display_format(df, F.col("l_quantity"), None).alias("quantity"))


@report("""
    SELECT l_returnflag, round(SUM(l_extendedprice * (1 - l_discount)), 1) AS revenue,
           round(AVG(l_quantity * l_tax), 6) AS mean_tax
    FROM lineitem GROUP BY l_returnflag
""")
def agg_expression(t):
    out = group_list(t.lineitem, ["l_returnflag"], [
        Measure("revenue", "SUM", F.col("l_extendedprice") * (1 - F.col("l_discount"))),
        Measure("mean_tax", "AVG", F.col("l_quantity") * F.col("l_tax"))])
    return rounded(rounded(out, "revenue", digits=1), "mean_tax", digits=6)


@report("""
    SELECT c_mktsegment, round(MAX(c_acctbal) - MIN(c_acctbal), 2) AS spread,
           COUNT(*) FILTER (WHERE c_acctbal > 5000) AS rich, round(stddev_samp(c_acctbal), 4) AS deviation
    FROM customer GROUP BY c_mktsegment
""")
def custom_aggregate(t):
    out = group_list(t.customer, ["c_mktsegment"], [
        Measure("spread", "SPREAD", "c_acctbal"), Measure("rich", "TRUE_COUNT", F.col("c_acctbal") > 5000),
        Measure("deviation", "DEVIATION", "c_acctbal")])
    return rounded(rounded(out, "spread"), "deviation", digits=4)


@report("""
    SELECT c_custkey, c_name FROM customer WHERE regexp_matches(c_name, '0[0-4]$')
""")
def custom_predicate(t):
    return C.filter_all(t.customer, Condition("c_name", "MATCHES", "0[0-4]$")).select("c_custkey", "c_name")


@report("""
    SELECT s_suppkey, substr(s_name, 1, 9) || regexp_replace(substr(s_name, 10), '[0-9]', '*', 'g') AS masked
    FROM supplier
""")
def custom_function(t):
    df = t.supplier
    return df.select("s_suppkey", S.call(df, "mask", F.col("s_name"), 9).alias("masked"))
