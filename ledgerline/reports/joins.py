"""Joins along relationships, independent sets and unions."""

from pyspark.sql import functions as F

from ledgerline.functions.aggregates import Measure
from ledgerline.operators.bands import Summary, band, detail_list, group_list, merge_spans
from ledgerline.operators.relations import Relationship, join_on, union_mapped
from ledgerline.plans.model import DataModel, UnionDataset
from ledgerline.reports.catalogue import nulled, report, rounded
from ledgerline.session import write_down
from ledgerline.sources.schema import Field

LINKS = [
    Relationship(("orders", "o_custkey"), ("customer", "c_custkey")),
    Relationship(("customer", "c_nationkey"), ("nation", "n_nationkey")),
    Relationship(("nation", "n_regionkey"), ("region", "r_regionkey")),
    Relationship(("lineitem", "l_orderkey"), ("orders", "o_orderkey")),
]
KEYS = {"orders": ["o_orderkey"], "customer": ["c_custkey"], "nation": ["n_nationkey"],
        "region": ["r_regionkey"], "part": ["p_partkey"]}


def model(t, *names):
    return DataModel(t.spark, {n: getattr(t, n) for n in names}, LINKS, primary_keys=KEYS)


@report("""
    SELECT s_suppkey, s_name, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey
""")
def join_inner(t):
    return join_on(t.supplier, t.nation, [("s_nationkey", "n_nationkey")], None).select("s_suppkey", "s_name", "n_name")


@report("""
    SELECT d.doc_id, d.lang, l.quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
""")
def join_left(t):
    labels = t.labels.withColumnRenamed("doc_id", "label_doc")
    return join_on(t.documents, labels, [("doc_id", "label_doc")], "LEFT", right_unique=True).select("doc_id", "lang", "quality")


@report("""
    SELECT l.quality, d.doc_id, d.source FROM labels l RIGHT JOIN documents d ON d.doc_id = l.doc_id
""")
def join_right(t):
    labels = t.labels.withColumnRenamed("doc_id", "label_doc")
    return join_on(labels, t.documents, [("label_doc", "doc_id")], "RIGHT", left_unique=True).select("quality", "doc_id", "source")


@report("""
    SELECT d.doc_id, l.doc_id AS label_doc, d.n_chars, l.toxic
    FROM (SELECT * FROM documents WHERE lang = 'en') d
    FULL JOIN (SELECT * FROM labels WHERE quality = 1) l ON d.doc_id = l.doc_id
""")
def join_full(t):
    docs = t.documents.filter("lang = 'en'")
    labels = t.labels.filter("quality = 1").withColumnRenamed("doc_id", "label_doc")
    return join_on(docs, labels, [("doc_id", "label_doc")], "FULL", left_unique=True, right_unique=True).select("doc_id", "label_doc", "n_chars", "toxic")


@report("""
    SELECT o_orderkey, o_orderstatus, l_linenumber, l_quantity FROM orders
    LEFT JOIN lineitem ON o_orderkey = l_orderkey AND l_quantity > 45
""")
def join_left_many(t):
    # Neither key is declared unique; an order may have many lines or none.
    lines = t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity").where("l_quantity > 45")
    orders = t.orders.select("o_orderkey", "o_orderstatus")
    return join_on(orders, lines, [("o_orderkey", "l_orderkey")], "LEFT", null_match=False) \
        .select("o_orderkey", "o_orderstatus", "l_linenumber", "l_quantity")


@report("""
    SELECT c_custkey, n_name FROM customer JOIN nation
      ON nullif(c_nationkey, 3) IS NOT DISTINCT FROM nullif(n_nationkey, 3)
""")
def join_null_keys(t):
    # A missing key matches a missing key; keys of two numeric types are compared as numbers.
    left = nulled(t.customer, "c_nationkey", 3).withColumn("c_nationkey", F.col("c_nationkey").cast("double"))
    return join_on(left, nulled(t.nation, "n_nationkey", 3), [("c_nationkey", "n_nationkey")]).select("c_custkey", "n_name")


@report("""
    SELECT p_partkey, s_name FROM part LEFT JOIN supplier
      ON substr(p_brand, 7) = CAST(CAST(s_suppkey AS DOUBLE) AS VARCHAR)
""")
def join_text_keys(t):
    # Text and numbers are compared as text, where a number is written with its decimals.
    left = t.part.withColumn("brand_no", F.substr("p_brand", F.lit(7)))
    return join_on(left, t.supplier, [("brand_no", "s_suppkey")], "LEFT", null_match=False,
                   right_unique=True).select("p_partkey", "s_name")


@report("""
    SELECT r_name, n_name, COUNT(*) AS n_lines, round(SUM(l_extendedprice), 2) AS amount
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
    JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
    GROUP BY r_name, n_name
""")
def join_chain(t):
    names = ("lineitem", "orders", "customer", "nation", "region")
    joined = model(t, *names).combined(*names)
    out = group_list(joined, ["region__r_name", "nation__n_name"],
                     [Measure("n_lines", "COUNT"), Measure("amount", "SUM", "lineitem__l_extendedprice")])
    return rounded(out.withColumnsRenamed({"region__r_name": "r_name", "nation__n_name": "n_name"}), "amount")


@report("""
    SELECT c_custkey, c_name, o_orderkey, o_totalprice,
           COUNT(*) OVER (PARTITION BY c_custkey) AS c_name__span,
           ROW_NUMBER() OVER (PARTITION BY c_custkey ORDER BY o_orderkey) = 1 AS c_name__head
    FROM customer JOIN orders ON c_custkey = o_custkey
""")
def master_detail(t):
    joined = join_on(t.customer, t.orders, [("c_custkey", "o_custkey")], left_unique=True)
    rows = write_down(joined.select("c_custkey", "c_name", "o_orderkey", "o_totalprice"))  # read for the spans and for the rows
    spans = merge_spans(rows, ["c_custkey"], ["o_orderkey"], {"c_name": "c_custkey"})
    return detail_list(spans, ["c_custkey"], ["c_name", "o_orderkey", "o_totalprice", "c_name__span", "c_name__head"],
                       order_by=["o_orderkey"])


@report("""
    SELECT 'customers' AS band, n_name AS name, COUNT(*) AS n, round(SUM(c_acctbal), 2) AS amount
    FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name
    UNION ALL
    SELECT 'customers', 'total', COUNT(*), round(SUM(c_acctbal), 2) FROM customer JOIN nation ON c_nationkey = n_nationkey
    UNION ALL
    SELECT 'parts', p_brand, COUNT(*), round(SUM(p_retailprice), 2) FROM part GROUP BY p_brand
    UNION ALL
    SELECT 'parts', 'total', COUNT(*), round(SUM(p_retailprice), 2) FROM part
""")
def independent_bands(t):
    m = model(t, "customer", "part", "nation")
    group = {"customer": "nation__n_name", "part": "part__p_brand"}
    value = {"customer": "customer__c_acctbal", "part": "part__p_retailprice"}
    out = None
    for members in m.sets("customer", "part", "nation"):
        first = members[0]
        totals = (Measure("n", "COUNT"), Measure("amount", "SUM", value[first]))
        rows = band(m.combined(*members), [group[first]], measures=totals,
                    summaries=[Summary(None, totals, ("total",))])
        part = rows.select(F.lit(f"{first}s").alias("band"),
                           F.coalesce("label", group[first]).alias("name"), "n", "amount")
        out = part if out is None else out.unionByName(part)
    return rounded(out, "amount")


@report("""
    SELECT c_name AS name, c_nationkey AS nation, c_acctbal AS balance, c_mktsegment AS segment, 'customer' AS member
    FROM customer
    UNION ALL
    SELECT s_name, s_nationkey, s_acctbal, NULL, 'supplier' FROM supplier
""", name="union_mapped")
def union_mapped_columns(t):
    return union_mapped(["name", "nation", "balance", "segment"], [
        ("customer", t.customer, {"name": "c_name", "nation": "c_nationkey", "balance": "c_acctbal",
                                  "segment": "c_mktsegment"}),
        ("supplier", t.supplier, {"name": "s_name", "nation": "s_nationkey", "balance": "s_acctbal"})], "member")


@report("""
    SELECT n_name, COUNT(*) AS n_parties, round(SUM(balance), 2) AS balance FROM (
        SELECT c_nationkey AS k, c_acctbal AS balance FROM customer
        UNION ALL SELECT s_nationkey, s_acctbal FROM supplier
        UNION ALL SELECT s_nationkey, s_acctbal FROM supplier) u
    JOIN nation ON k = n_nationkey GROUP BY n_name
""")
def union_joined(t):
    # A union of unions, joined like any other dataset.
    fields = [Field("k", "NUMBER"), Field("balance", "NUMBER")]
    m = DataModel(t.spark, {
        "customer": t.customer, "supplier": t.supplier, "nation": t.nation,
        "both": UnionDataset(fields, [("customer", {"k": "c_nationkey", "balance": "c_acctbal"}),
                                      ("supplier", {"k": "s_nationkey", "balance": "s_acctbal"})]),
        "party": UnionDataset(fields, [("both", {"k": "k", "balance": "balance"}),
                                       ("supplier", {"k": "s_nationkey", "balance": "s_acctbal"})]),
    }, [Relationship(("party", "k"), ("nation", "n_nationkey"))], primary_keys=KEYS)
    out = group_list(m.combined("party", "nation"), ["nation__n_name"],
                     [Measure("n_parties", "COUNT"), Measure("balance", "SUM", "party__balance")])
    return rounded(out.withColumnRenamed("nation__n_name", "n_name"), "balance")
