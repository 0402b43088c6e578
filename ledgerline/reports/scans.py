"""Reads, lists and the cell table."""

import math

from pyspark.sql import functions as F

from ledgerline.functions import params as P
from ledgerline.functions.predicates import Condition, filter_all
from ledgerline.operators.bands import detail_list
from ledgerline.operators.ordering import preview
from ledgerline.operators.relations import Relationship, qualify
from ledgerline.plans.model import DataModel, TableDataset
from ledgerline.reports.catalogue import nulled, report, rounded
from ledgerline.session import new_path
from ledgerline.sources.pieces import parquet_pieces, read_pieces, read_row_group
from ledgerline.sources.readers import scan_csv, sql_dataset
from ledgerline.sources.schema import Field, typed_projection
from ledgerline.sources.sinks import cells_of, write_cells


@report("""
    SELECT p_partkey, p_name, p_retailprice FROM part ORDER BY p_partkey
""")
def simple_list(t):
    return detail_list(t.part, [], ["p_partkey", "p_name", "p_retailprice"], order_by=["p_partkey"])


@report("""
    SELECT CAST(p_partkey AS BIGINT) AS p_partkey,
           CAST(substr(p_brand, 7) AS DOUBLE) AS brand_no,
           CAST(CAST(p_size AS DOUBLE) AS VARCHAR) AS p_size,
           p_size > 25 AS big,
           CAST(NULL AS DOUBLE) AS p_name,
           CAST(NULL AS VARCHAR) AS p_comment
    FROM part
""", name="typed_projection")
def typed_projection_on_read(t):
    loose = t.part.select(
        "p_partkey", F.substr("p_brand", F.lit(7)).alias("brand_no"), "p_size",
        F.when(F.col("p_size") > 25, "TRUE").otherwise("no").alias("big"), "p_name")
    return typed_projection(loose, [
        Field("p_partkey", "NUMBER", primary_key=True), Field("brand_no", "NUMBER"), Field("p_size", "STRING"),
        Field("big", "BOOLEAN"), Field("p_name", "NUMBER"), Field("p_comment", "STRING")], on_error="null")


@report("""
    SELECT s_suppkey AS supplier__s_suppkey, s_name AS supplier__s_name,
           s_nationkey AS supplier__s_nationkey, s_acctbal AS supplier__s_acctbal
    FROM supplier
""")
def qualified_columns(t):
    return qualify(t.supplier, "supplier")


@report("""
    SELECT o_orderkey, o_custkey, o_totalprice, o_orderpriority
    FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20
""")
def preview_limit(t):
    df = t.orders.select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority")
    return preview(df, [F.desc("o_totalprice"), F.asc("o_orderkey")])


@report("""
    SELECT c_mktsegment, n_name, COUNT(*) AS n_customers
    FROM customer JOIN nation ON c_nationkey = n_nationkey
    WHERE c_acctbal >= 1000
    GROUP BY c_mktsegment, n_name
""", name="sql_dataset")
def sql_dataset_text(t):
    text = """SELECT c_mktsegment, n_name, COUNT(*) AS n_customers
              FROM customer_in JOIN nation_in ON c_nationkey = n_nationkey
              WHERE c_acctbal >= :floor GROUP BY c_mktsegment, n_name"""
    return sql_dataset(t.spark, text, {"customer_in": t.customer, "nation_in": t.nation}, {"floor": 1000})


@report("""
    SELECT p_partkey, 'p_name' AS "column", CAST(NULL AS DOUBLE) AS num, p_name AS text, CAST(NULL AS BOOLEAN) AS flag
    FROM part
    UNION ALL
    SELECT p_partkey, 'p_size', CAST(p_size AS DOUBLE), NULL, NULL FROM part
    UNION ALL
    SELECT p_partkey, 'big', NULL, NULL, p_size > 25 FROM part
""")
def cell_table(t):
    df = t.part.withColumn("big", F.col("p_size") > 25)
    return cells_of(df, ["p_partkey"], ["p_name", "p_size", "big"])


@report("""
    SELECT p_partkey, 'p_name' AS "column", CAST(NULL AS DOUBLE) AS num, p_name AS text, CAST(NULL AS BOOLEAN) AS flag
    FROM part
    UNION ALL
    SELECT p_partkey, 'p_retailprice', p_retailprice, NULL, NULL FROM part
""")
def cell_sink(t):
    # Cells written as files and read again.
    path = new_path(t.spark)
    write_cells(t.part, path, ["p_partkey"], ["p_name", "p_retailprice"], "json")
    return t.spark.read.schema("p_partkey long, column string, num double, text string, flag boolean").json(path)


@report("""
    SELECT CAST(c_custkey AS DOUBLE) AS c_custkey, c_name, c_acctbal, nullif(c_mktsegment, 'BUILDING') AS c_mktsegment,
           CAST(NULL AS VARCHAR) AS c_comment
    FROM customer
""", name="csv_scan")
def csv_customers(t):
    # The customers as text files with a header, read back by column name.
    path = new_path(t.spark)
    nulled(t.customer, "c_mktsegment", "BUILDING").write.option("header", True).csv(path)
    return scan_csv(t.spark, path, [Field("c_custkey", "NUMBER", primary_key=True), Field("c_name"),
                                    Field("c_acctbal", "NUMBER"), Field("c_mktsegment"), Field("c_comment")])


@report("""
    SELECT CAST(c_custkey AS DOUBLE) AS c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_name END AS c_name, c_acctbal FROM customer
""")
def csv_many_headers(t):
    # Files with their columns in another order, one without the names, read as one.
    path = new_path(t.spark)
    t.customer.where("c_custkey % 2 = 0").select("c_name", "c_custkey", "c_acctbal").write.option("header", True).csv(f"{path}/even")
    t.customer.where("c_custkey % 2 = 1").select("c_acctbal", "c_custkey").write.option("header", True).csv(f"{path}/odd")
    return scan_csv(t.spark, [f"{path}/even", f"{path}/odd"], [Field("c_custkey", "NUMBER", primary_key=True), Field("c_name"), Field("c_acctbal", "NUMBER")])


@report("""
    SELECT event_type, COUNT(*) AS n, round(SUM(value), 2) AS total FROM events
    WHERE event_id >= (SELECT MAX(event_id) FROM events) / 2 GROUP BY event_type
""")
def source_partitioned(t):
    # A source of one's own: tasks read the row groups of files, of which bounds leave out those that cannot match.
    path = new_path(t.spark)
    t.events.select("event_id", "event_type", "value").repartitionByRange(8, "event_id").write.parquet(path)
    files = t.spark.read.parquet(path)
    middle = (t.events.agg(F.max("event_id")).first()[0] or 0) / 2
    events = read_pieces(t.spark, "row_groups", files.schema, parquet_pieces("event_id"), read_row_group, {"files": "\n".join(files.inputFiles())}, used_once=True)
    found = events.where(F.col("event_id") >= math.ceil(middle)).groupBy("event_type")
    return rounded(found.agg(F.count("*").alias("n"), F.sum("value").alias("total")), "total")


@report("""
    SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders
    WHERE o_totalprice >= 200000 AND o_orderstatus = 'F'
""")
def param_filter(t):
    given = {"floor": "200000", "status": "F"}
    found = filter_all(
        t.orders, Condition("o_totalprice", "GE", given.get("floor")),
        Condition("o_orderstatus", "EQ", given.get("status")),
        Condition("o_orderpriority", "NE", given.get("priority")))
    return found.select("o_orderkey", "o_orderstatus", "o_totalprice")


@report("""
    SELECT c_custkey, 'FURNITURE' AS segment, CAST(NULL AS VARCHAR) AS remark
    FROM customer WHERE c_mktsegment = 'FURNITURE' AND c_acctbal > 5000
""")
def param_default(t):
    declared = [P.Parameter("segment", "FURNITURE"), P.Parameter("floor", required=True), P.Parameter("remark")]
    given = P.with_defaults(declared, {"floor": 5000})
    df = t.customer.filter((F.col("c_mktsegment") == P.parameter(given, "segment"))
                           & (F.col("c_acctbal") > P.parameter(given, "floor")))
    return df.select("c_custkey", P.resolve("segment", given).alias("segment"),
                     P.resolve("remark", given).cast("string").alias("remark"))


@report("""
    SELECT o_orderkey, o_totalprice FROM orders
    WHERE o_totalprice > (SELECT AVG(c_acctbal) * 100 FROM customer)
""")
def param_from_result(t):
    limit = P.from_result(t.customer.agg((F.avg("c_acctbal") * 100).alias("limit")))
    return t.orders.filter(F.col("o_totalprice") > limit).select("o_orderkey", "o_totalprice")


@report("""
    SELECT c_custkey AS customer__c_custkey, c_name AS customer__c_name,
           n_name AS nation__n_name, r_name AS region__r_name
    FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
""")
def model_sources(t):
    at = lambda name, *fields: TableDataset("PARQUET", {"path": f"{t.folder}/{name}.parquet"}, fields)
    model = DataModel(t.spark, {
        "customer": at("customer", Field("c_custkey", "NUMBER", primary_key=True), Field("c_name"),
                       Field("c_nationkey", "NUMBER")),
        "nation": at("nation", Field("n_nationkey", "NUMBER", primary_key=True), Field("n_name"),
                     Field("n_regionkey", "NUMBER")),
        "region": at("region", Field("r_regionkey", "NUMBER", primary_key=True), Field("r_name")),
    }, [Relationship(("customer", "c_nationkey"), ("nation", "n_nationkey")),
        Relationship(("nation", "n_regionkey"), ("region", "r_regionkey"))])
    return model.combined("customer", "nation", "region").select(
        "customer__c_custkey", "customer__c_name", "nation__n_name", "region__r_name")
