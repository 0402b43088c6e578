"""Loose numbers, equality and order, checked against a plain model over many value pairs."""

import re

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.functions import scalars as S
from ledgerline.functions import values as V
from ledgerline.functions.predicates import PREDICATES, Condition, filter_all, register_predicate, test as check

TEXTS = [None, "", "null", "abc", "5", "5.0", " 5 ", "10", "9", "-3", "1e1", "zz", "inf", "nan", "A", "2026-01-02", "0"]
NUMBERS = [None, 5.0, 10.0, 9.0, -3.0, 0.0, 2.5]


def as_number(v):
    if isinstance(v, bool) or v is None:
        return None
    if isinstance(v, (int, float)):
        return float(v)
    return float(v) if re.match(r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$", v) else None


def as_text(v):
    return "null" if v is None else str(v)


def model(op, a, b):
    x, y = as_number(a), as_number(b)
    p, q = (x, y) if x is not None and y is not None else (as_text(a), as_text(b))
    if op in ("EQ", "NE", "GT", "GE", "LT", "LE"):
        return {"EQ": p == q, "NE": p != q, "GT": p > q, "GE": p >= q, "LT": p < q, "LE": p <= q}[op]
    items = [i for i in (s.strip() for s in as_text(b).split(",")) if i] if b is not None else []
    if op == "CONTAINS":
        return a is not None and b is not None and as_text(b) in as_text(a)
    if op == "IN":
        return a is not None and any(model("EQ", a, i) for i in items)
    if op == "BETWEEN":
        return a is not None and len(items) >= 2 and model("GE", a, items[0]) and model("LE", a, items[1])
    if op == "IS_NULL":
        return a is None or a == ""
    return not model({"NOT_CONTAINS": "CONTAINS", "NOT_IN": "IN", "IS_NOT_NULL": "IS_NULL"}[op], a, b)


OPS = ["EQ", "NE", "GT", "GE", "LT", "LE", "CONTAINS", "NOT_CONTAINS", "IN", "NOT_IN", "BETWEEN", "IS_NULL", "IS_NOT_NULL"]


def frame(spark, lefts, rights, left_type, right_type):
    schema = T.StructType([T.StructField("l", left_type), T.StructField("r", right_type)])
    return spark.createDataFrame([(a, b) for a in lefts for b in rights], schema)


@pytest.mark.parametrize("left,right", [("t", "t"), ("t", "n"), ("n", "t"), ("n", "n")])
def test_predicates_on_columns_follow_the_model(spark, left, right):
    pools = {"t": (TEXTS + ["5,10", "1, 9 ,"], T.StringType()), "n": (NUMBERS, T.DoubleType())}
    df = frame(spark, pools[left][0], pools[right][0], pools[left][1], pools[right][1])
    got = df.select("l", "r", *[check(df, Condition("l", op, F.col("r"))).alias(op) for op in OPS]).collect()
    wrong = [(op, r.l, r.r, r[op]) for r in got for op in OPS if r[op] is not model(op, r.l, r.r)]
    assert wrong == []


@pytest.mark.parametrize("left", ["t", "n"])
def test_predicates_on_literals_follow_the_model(spark, left):
    lefts, kind = {"t": (TEXTS, T.StringType()), "n": (NUMBERS, T.DoubleType())}[left]
    df = spark.createDataFrame([(v,) for v in lefts], T.StructType([T.StructField("l", kind)]))
    literals = TEXTS + NUMBERS[1:] + ["5,10", "1, 9 ,", "abc,zz", "-3,abc", "null"]
    names = {f"c{i}_{op}": (op, v) for i, v in enumerate(literals) for op in OPS}
    got = df.select("l", *[check(df, Condition("l", op, v)).alias(n) for n, (op, v) in names.items()]).collect()
    wrong = [(op, r.l, v, r[n]) for r in got for n, (op, v) in names.items() if r[n] is not model(op, r.l, v)]
    assert wrong == []


def test_dates_compare_as_dates_and_missing_ones_are_greatest(spark):
    df = spark.sql("select * from values (date'2024-01-01'), (date'2024-06-01'), (null) as t(d)")
    keep = lambda op, v: [str(r.d) for r in filter_all(df, Condition("d", op, v)).orderBy("d").collect()]
    assert keep("GE", "2024-06-01") == ["None", "2024-06-01"]
    assert keep("LT", "2024-06-01") == ["2024-01-01"]
    assert keep("BETWEEN", "2024-01-01,2024-03-01") == ["2024-01-01"]
    assert keep("IN", "2024-01-01, 2030-01-01") == ["2024-01-01"]
    assert keep("EQ", None) == ["None"]
    assert keep("NE", "2024-01-01") == ["None", "2024-06-01"]
    stamps = spark.sql("select * from values (timestamp_ntz'2024-01-01 10:00:00'), (null) as t(d)")
    assert filter_all(stamps, Condition("d", "GT", "2024-01-01")).count() == 2
    assert filter_all(stamps, Condition("d", "LE", "2024-01-01T10:00:00")).count() == 1


def test_booleans(spark):
    df = spark.sql("select * from values (true), (false), (null) as t(b)")
    keep = lambda op, v: filter_all(df, Condition("b", op, v)).count()
    assert keep("EQ", True) == 1 and keep("NE", True) == 2 and keep("EQ", "true") == 1
    assert keep("GT", False) == 2  # true and null, as texts


def test_loose_numbers(spark):
    df = spark.createDataFrame([(t,) for t in [" 3.0 ", "1d", "", "inf", "Infinity", "NaN", "nan", "x", None, "1e999"]], "t string")
    got = [r[0] for r in df.select(V.number(df, F.col("t"))).collect()]
    assert got[:4] == [3.0, 1.0, None, None] and got[4] == float("inf") and got[5] != got[5]
    assert got[6:9] == [None, None, None] and got[9] == float("inf")


def test_display_text(spark):
    df = spark.sql("select 8000.0d a, 2.5d b, cast(null as double) c, 7 d, true e, 1e20d f, cast(5.00 as decimal(9,2)) g")
    got = df.select(*[S.text(df, "v=", F.col(c)).alias(c) for c in "abcdefg"]).first()
    assert tuple(got) == ("v=8000", "v=2.5", "v=", "v=7", "v=true", "v=9223372036854775807", "v=5")


def test_functions(spark):
    df = spark.sql("""select 1234.5d n, '1234.5' t, 'x' w, cast(null as double) z, '2026-06-15' d,
                             '2026-06-15T10:30:00' dt, '2026' y, '2026-13-45' bad, 0.125d h, 3.14159d pi, 4.5d m, 'false' f""")
    one = lambda c: df.select(c.alias("v")).first().v
    assert one(S.call(df, "format", F.col("n"), "#,##0.00")) == "1,234.50"
    assert one(S.call(df, "format", F.col("t"), "#,##0.00")) == "1,234.50"
    assert one(S.call(df, "format", F.col("w"), "0")) == "x" and one(S.call(df, "format", F.col("z"), "0")) == ""
    assert one(S.call(df, "format", F.col("h"), "0.00")) == "0.12"
    assert one(S.call(df, "date", F.col("d"), "yyyy/MM/dd")) == "2026/06/15"
    assert one(S.call(df, "date", F.col("dt"), "yyyy/MM/dd HH:mm")) == "2026/06/15 10:30"
    assert one(S.call(df, "date", F.col("d"), "HH:mm")) == "2026-06-15"
    assert one(S.call(df, "date", F.col("y"), "yyyy/MM")) == "2026" and one(S.call(df, "date", F.col("bad"), "yyyy")) == "2026-13-45"
    assert one(S.call(df, "date", F.col("z"), "yyyy")) == ""
    assert one(S.call(df, "round", F.col("pi"), 2)) == 3.14 and one(S.call(df, "round", F.col("m"))) == 5.0
    assert one(S.call(df, "round", F.col("w"), 1)) == "x" and one(S.call(df, "round", F.col("z"))) is None
    assert one(S.call(df, "concat", F.col("n"), F.col("z"), "-", F.col("w"))) == "1234.5-x"
    assert one(S.call(df, "if", F.col("f"), "yes", "no")) == "no" and one(S.call(df, "if", F.col("w"), "yes", "no")) == "yes"
    assert one(S.call(df, "if", F.col("z"), 1, "no")) == "no" and one(S.call(df, "if", F.col("w"), 1)) is None
    assert one(S.display_format(df, F.col("n"), "#,##0.0%")) == "123,450.0%"
    with pytest.raises(ValueError, match="unknown function"):
        S.call(df, "Format", F.col("n"), "0")


def test_unknown_and_added_operators(spark):
    df = spark.createDataFrame([("ab",), ("cd",)], "t string")
    with pytest.raises(ValueError, match="unknown operator"):
        filter_all(df, Condition("t", "LIKE", "a%"))
    register_predicate("STARTS", lambda df, left, right: F.startswith(left, F.lit(right)))
    assert filter_all(df, Condition("t", "STARTS", "a")).count() == 1
    del PREDICATES["STARTS"]


def test_sql_nulls_on_request(spark):
    df = spark.createDataFrame([(1.0,), (None,), (5.0,)], "n double")
    assert filter_all(df, Condition("n", "NE", 1)).count() == 2
    assert filter_all(df, Condition("n", "NE", 1), sql_nulls=True).count() == 1
