"""A source of one's own: pieces, pruning by bounds, and the rows that come of it."""

import datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, GreaterThanOrEqual, In, LessThan, LessThanOrEqual

from ledgerline.sources.pieces import Piece, parquet_pieces, read_pieces, read_row_group


@pytest.mark.parametrize("wanted,held", [
    (EqualTo(("a",), 5), True), (EqualTo(("a",), 21), False), (EqualTo(("a",), None), False), (EqualTo(("b",), 99), True),
    (GreaterThan(("a",), 20), False), (GreaterThanOrEqual(("a",), 20), True), (LessThan(("a",), 5), False), (LessThanOrEqual(("a",), 5), True),
    (In(("a",), (1, 7)), True), (In(("a",), (1, 2, None)), False), (EqualTo(("a",), "x"), True), (LessThan(("a",), datetime.date(2000, 1, 1)), True)])
def test_bounds(wanted, held):
    assert Piece("t", {"a": (5, 20), "b": (None, None)}).may_hold(wanted) == held


def test_rows_of_a_made_source(spark):
    def pieces(options):
        return [Piece(i, {"n": (i * 10, i * 10 + 9)}) for i in range(int(options["parts"]))]

    def read(token):
        import pyarrow as pa

        yield pa.RecordBatch.from_pydict({"n": pa.array(range(token * 10, token * 10 + 10), pa.int64()), "t": [None, "é"] * 5})

    df = read_pieces(spark, "made", "n long, t string", pieces, read, {"parts": "7"})
    assert sorted(r.n for r in df.collect()) == list(range(70)) and df.rdd.getNumPartitions() == 7
    assert sorted(r.n for r in df.where("n > 57 and n <= 61").collect()) == [58, 59, 60, 61]
    assert df.where("n > 500").collect() == [] and read_pieces(spark, "none", "n long, t string", pieces, read, {"parts": "0"}).count() == 0


def test_pruned_pieces_are_not_read(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(0, 1000, 1, 4).select("id", (F.col("id") % 7).alias("v")).repartitionByRange(10, "id").write.option("parquet.block.size", "1").parquet(path)
    files, log = spark.read.parquet(path), str(tmp_path / "log")

    def read(token):
        with open(log, "a") as f:
            f.write(f"{token[0]}\n")
        yield from read_row_group(token)

    make = lambda once: read_pieces(spark, "logged", files.schema, parquet_pieces("id"), read, {"files": "\n".join(files.inputFiles())}, once)
    got = make(True).where((F.col("id") >= 400) & (F.col("id") < 450)).groupBy("v").count().collect()
    assert sum(r["count"] for r in got) == 50
    with open(log) as f:
        assert 1 <= len(set(f)) <= 2
    df = make(False)  # for any number of uses
    assert df.where("id < 10").union(df.where("id >= 990")).count() == 20 and df.count() == 1000
    with open(log) as f:
        assert len(set(f)) == 10
