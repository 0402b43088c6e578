"""Every predicate, on typed, mixed and missing values."""

from pyspark.sql import functions as F

from ledgerline.functions.predicates import Condition, filter_all, test
from ledgerline.operators.bands import group_list
from ledgerline.functions.aggregates import Measure
from ledgerline.reports.catalogue import nulled, report


def flags(df, keys, **conditions):
    return df.select(*keys, *[test(df, c).alias(name) for name, c in conditions.items()])


@report("""
    WITH d AS (SELECT o_orderkey, nullif(o_orderstatus, 'P') AS status, nullif(o_orderstatus, 'O') AS other,
                      substr(o_orderpriority, 1, 1) AS rank FROM orders)
    SELECT o_orderkey,
           status IS NOT DISTINCT FROM 'F' AS eq_text, status IS DISTINCT FROM 'F' AS ne_text,
           status IS NULL AS eq_missing, status IS NOT NULL AS ne_missing,
           CAST(rank AS DOUBLE) = 3 AS eq_loose, CAST(rank AS DOUBLE) <> 3 AS ne_loose,
           status IS NOT DISTINCT FROM other AS eq_columns, status IS DISTINCT FROM other AS ne_columns
    FROM d
""")
def pred_eq_ne(t):
    df = nulled(nulled(t.orders, "o_orderstatus", "P", "status"), "o_orderstatus", "O", "other")
    df = df.withColumn("rank", F.substring("o_orderpriority", 1, 1))
    return flags(
        df, ["o_orderkey"],
        eq_text=Condition("status", "EQ", "F"), ne_text=Condition("status", "NE", "F"),
        eq_missing=Condition("status", "EQ", None), ne_missing=Condition("status", "NE", None),
        eq_loose=Condition("rank", "EQ", "3.0"), ne_loose=Condition("rank", "NE", 3),
        eq_columns=Condition("status", "EQ", F.col("other")), ne_columns=Condition("status", "NE", F.col("other")))


@report("""
    WITH d AS (SELECT c_custkey, c_custkey % 3 AS k, substr(c_name, 15) AS tail FROM customer)
    SELECT c_custkey, k = 0 OR (k = 1 AND tail > '0100') AS gt_literal, k > 0 AS lt_literal, k = 0 AS gt_column, k > 0 AS le_column FROM d
""")
def pred_order_wide_text(t):
    # By 16-bit units an emoji stands before a full-width tilde, though its code point is the greater one.
    k = F.col("c_custkey") % 3
    lead = F.when(k == 0, "\uff5e").when(k == 1, "\U0001f600").otherwise("A")
    df = t.customer.withColumns({"name": F.concat(lead, F.substr("c_name", F.lit(15))), "low": F.lit("\U0001f600\uffff"), "high": F.lit("\U0001f600zzzz")})
    return flags(df, ["c_custkey"], gt_literal=Condition("name", "GT", "\U0001f6000100"), lt_literal=Condition("name", "LT", "\uff5e"),
                 gt_column=Condition("name", "GT", F.col("low")), le_column=Condition("name", "LE", F.col("high")))


@report("""
    WITH d AS (SELECT p_partkey, nullif(p_size, 10) AS size, substr(p_brand, 7) AS brand_no, p_brand,
                      nullif(p_type, 'PROMO') AS kind FROM part)
    SELECT p_partkey,
           size > 25 OR size IS NULL AS gt_number, size >= 25 OR size IS NULL AS ge_number,
           coalesce(size < 25, false) AS lt_number, coalesce(size <= 25, false) AS le_number,
           CAST(brand_no AS DOUBLE) > 7 AS gt_loose, CAST(brand_no AS DOUBLE) <= 7 AS le_loose,
           p_brand >= 'Brand#2' AS ge_text, p_brand < 'Brand#2' AS lt_text,
           coalesce(kind, 'null') > 'MEDIUM' AS gt_missing,
           coalesce(size > CAST(brand_no AS DOUBLE), true) AS gt_mixed,
           coalesce(kind, 'null') <= p_brand AS le_columns
    FROM d
""")
def pred_order(t):
    df = nulled(nulled(t.part, "p_size", 10, "size"), "p_type", "PROMO", "kind")
    df = df.withColumn("brand_no", F.substr("p_brand", F.lit(7)))
    return flags(
        df, ["p_partkey"],
        gt_number=Condition("size", "GT", "25"), ge_number=Condition("size", "GE", 25),
        lt_number=Condition("size", "LT", 25), le_number=Condition("size", "LE", 25.0),
        gt_loose=Condition("brand_no", "GT", 7), le_loose=Condition("brand_no", "LE", "7"),
        ge_text=Condition("p_brand", "GE", "Brand#2"), lt_text=Condition("p_brand", "LT", "Brand#2"),
        gt_missing=Condition("kind", "GT", "MEDIUM"),
        gt_mixed=Condition("size", "GT", F.col("brand_no")),
        le_columns=Condition("kind", "LE", F.col("p_brand")))


@report("""
    WITH d AS (SELECT doc_id, nullif(lang, 'de') AS lang, text, source FROM documents)
    SELECT doc_id, contains(text, 'the') AS has_word, NOT contains(text, 'the') AS lacks_word,
           coalesce(contains(lang, 'e'), false) AS has_letter, NOT coalesce(contains(lang, 'e'), false) AS lacks_letter,
           coalesce(contains(text, lang), false) AS has_column, contains(CAST(CAST(doc_id AS DOUBLE) AS VARCHAR), '7.0') AS has_digits
    FROM d
""")
def pred_contains(t):
    df = nulled(t.documents, "lang", "de")
    return flags(
        df, ["doc_id"],
        has_word=Condition("text", "CONTAINS", "the"), lacks_word=Condition("text", "NOT_CONTAINS", "the"),
        has_letter=Condition("lang", "CONTAINS", "e"), lacks_letter=Condition("lang", "NOT_CONTAINS", "e"),
        has_column=Condition("text", "CONTAINS", F.col("lang")), has_digits=Condition("doc_id", "CONTAINS", "7.0"))


@report("""
    WITH d AS (SELECT p_partkey, nullif(p_size, 10) AS size, substr(p_brand, 7) AS brand_no, p_type FROM part)
    SELECT p_partkey,
           coalesce(size IN (1, 10, 25), false) AS in_numbers, NOT coalesce(size IN (1, 10, 25), false) AS not_in_numbers,
           CAST(brand_no AS DOUBLE) IN (3, 7) AS in_loose, p_type IN ('PROMO', 'SMALL') AS in_text,
           p_type NOT IN ('PROMO', 'SMALL') AS not_in_text, false AS in_nothing, true AS not_in_nothing,
           coalesce(size IN (5, CAST(brand_no AS DOUBLE)), false) AS in_column
    FROM d
""")
def pred_in(t):
    df = nulled(t.part, "p_size", 10, "size").withColumn("brand_no", F.substr("p_brand", F.lit(7)))
    return flags(
        df, ["p_partkey"],
        in_numbers=Condition("size", "IN", "1, 10 ,25,"), not_in_numbers=Condition("size", "NOT_IN", [1, 10, 25]),
        in_loose=Condition("brand_no", "IN", "3.0,7"), in_text=Condition("p_type", "IN", " PROMO , SMALL "),
        not_in_text=Condition("p_type", "NOT_IN", "PROMO,SMALL"), in_nothing=Condition("p_type", "IN", ""),
        not_in_nothing=Condition("p_type", "NOT_IN", None),
        in_column=Condition("size", "IN", F.concat(F.lit("5, "), F.col("brand_no"))))


@report("""
    WITH d AS (SELECT o_orderkey, nullif(o_orderstatus, 'P') AS status,
                      CASE WHEN o_orderstatus = 'O' THEN '' ELSE o_orderstatus END AS blank,
                      CASE WHEN o_orderstatus = 'O' THEN o_totalprice END AS amount FROM orders)
    SELECT o_orderkey, status IS NULL AS null_text, coalesce(blank, '') = '' AS blank_text,
           amount IS NULL AS null_number, amount IS NOT NULL AS some_number, coalesce(blank, '') <> '' AS some_text
    FROM d
""")
def pred_null(t):
    df = nulled(t.orders, "o_orderstatus", "P", "status").withColumns({
        "blank": F.when(F.col("o_orderstatus") == "O", "").otherwise(F.col("o_orderstatus")),
        "amount": F.when(F.col("o_orderstatus") == "O", F.col("o_totalprice"))})
    return flags(
        df, ["o_orderkey"],
        null_text=Condition("status", "IS_NULL"), blank_text=Condition("blank", "IS_NULL"),
        null_number=Condition("amount", "IS_NULL"), some_number=Condition("amount", "IS_NOT_NULL"),
        some_text=Condition("blank", "IS_NOT_NULL"))


@report("""
    WITH d AS (SELECT p_partkey, nullif(p_size, 10) AS size, substr(p_brand, 7) AS brand_no FROM part)
    SELECT p_partkey, coalesce(size BETWEEN 5 AND 15, false) AS number_between,
           CAST(brand_no AS DOUBLE) BETWEEN 9 AND 11 AS loose_between, false AS one_bound,
           coalesce(size BETWEEN 1 AND CAST(brand_no AS DOUBLE), false) AS column_between
    FROM d
""")
def pred_between(t):
    df = nulled(t.part, "p_size", 10, "size").withColumn("brand_no", F.substr("p_brand", F.lit(7)))
    return flags(
        df, ["p_partkey"],
        number_between=Condition("size", "BETWEEN", "5, 15"), loose_between=Condition("brand_no", "BETWEEN", (9, 11)),
        one_bound=Condition("size", "BETWEEN", "5"),
        column_between=Condition("size", "BETWEEN", F.concat(F.lit("1,"), F.col("brand_no"))))


@report("""
    SELECT o_orderpriority, COUNT(*) AS n, MAX(o_totalprice) AS top FROM orders
    WHERE o_orderdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1998-12-31'
      AND o_orderstatus <> 'P' AND o_totalprice > 1000
    GROUP BY o_orderpriority
""")
def band_conditions(t):
    # Conditions of any cell of a band hold for the whole band.
    return group_list(t.orders, ["o_orderpriority"], [Measure("n", "COUNT"), Measure("top", "MAX", "o_totalprice")],
                      where=[Condition("o_orderdate", "BETWEEN", "1996-01-01,1998-12-31"),
                             Condition("o_orderstatus", "NOT_IN", "P"), Condition("o_totalprice", "GT", 1000)])


@report("""
    SELECT o_orderkey FROM orders WHERE nullif(o_orderstatus, 'P') <> 'F' AND o_totalprice < 100000
""")
def pred_sql_nulls(t):
    df = nulled(t.orders, "o_orderstatus", "P")
    return filter_all(df, Condition("o_orderstatus", "NE", "F"), Condition("o_totalprice", "LT", 100000),
                      sql_nulls=True).select("o_orderkey")
