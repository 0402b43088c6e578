import datetime
import zipfile

import pytest
from pyspark.sql import functions as F

from ledgerline.sources import readers as R
from ledgerline.sources.schema import Field, business_type, describe, describe_tables, typed_projection
from ledgerline.sources.workbook import workbook_header

FIELDS = [Field("id", "NUMBER", primary_key=True), Field("name", alias="Name"), Field("price", "NUMBER"),
          Field("active", "BOOLEAN"), Field("note")]


def test_files_with_unlike_headers_are_read_by_name(spark, tmp_path):
    (tmp_path / "a b.csv").write_text("no,bird\n1,wren\n2,teal\n")
    (tmp_path / "c.csv").write_text("bird,no\nknot,3\n")
    (tmp_path / "d.csv").write_text("no,wing\n4,short\n")
    got = R.scan_csv(spark, str(tmp_path), [Field("no", "NUMBER"), Field("bird"), Field("wing")]).collect()
    assert sorted((r.no, r.bird, r.wing) for r in got) == [(1.0, "wren", None), (2.0, "teal", None), (3.0, "knot", None), (4.0, None, "short")]


def test_sql_datasets_leave_the_callers_views_alone(spark):
    spark.range(3).createOrReplaceTempView("kept")
    assert R.sql_dataset(spark, "SELECT id + :by AS id FROM kept", {"kept": spark.range(5)}, {"by": 1}).count() == 5
    assert spark.table("kept").count() == 3
    spark.catalog.dropTempView("kept")


def test_csv_by_header_name(spark, rows, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text(' name , id ,price,active\nAnn , 1, 2.5 ,TRUE\n\n"Bob, Jr",2\nCy,3,,no\n')
    df = R.scan_csv(spark, str(path), FIELDS)
    assert rows(df) == [(1.0, "Ann", 2.5, True, None), (2.0, "Bob, Jr", None, None, None), (3.0, "Cy", None, False, None)]
    assert [f.metadata["primary_key"] for f in df.schema] == [True, False, False, False, False]
    plain = R.scan_csv(spark, str(path), quote="")
    assert plain.filter(F.col("name") == '"Bob').count() == 1
    assert [f.type for f in describe(plain)] == ["STRING"] * 4


def test_unreadable_numbers_fail_or_become_null(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text("id\n1\nx\n")
    with pytest.raises(Exception, match="field id is no NUMBER: x"):
        R.scan_csv(spark, str(path), FIELDS[:1]).collect()
    assert [r.id for r in R.scan_csv(spark, str(path), FIELDS[:1], on_error="null").collect()] == [1.0, None]


def test_typed_projection(spark):
    df = spark.sql("select 7L id, 2.5 price, 3 name, 'True' active, date'2024-01-02' day, '2024-01-02' text_day, '2024' odd")
    fields = [Field("id", "NUMBER"), Field("price", "NUMBER"), Field("name"), Field("active", "BOOLEAN"), Field("day", "DATE"),
              Field("text_day", "DATE"), Field("gone", "DATETIME")]
    out = typed_projection(df, fields)
    assert [t for _, t in out.dtypes] == ["bigint", "decimal(2,1)", "string", "boolean", "date", "string", "string"]
    assert out.first().name == "3.0"
    dated = typed_projection(df, fields, parse_dates=True)
    assert dated.first().text_day == datetime.date(2024, 1, 2) and dict(dated.dtypes)["gone"] == "timestamp_ntz"


def test_introspection(spark):
    df = spark.sql("select 1 i, 1.5 d, 'x' s, true b, date'2024-01-01' day, timestamp_ntz'2024-01-01 00:00:00' at")
    assert [(f.name, f.type, f.primary_key) for f in describe(df, ["i"])] == [
        ("i", "NUMBER", True), ("d", "NUMBER", False), ("s", "STRING", False), ("b", "BOOLEAN", False),
        ("day", "DATE", False), ("at", "DATETIME", False)]
    assert list(describe_tables({"Orders": df, "parts": df}, ["ORDERS"])) == ["Orders"]
    assert [business_type(t) for t in ("bigint", "VARCHAR(20)", "datetime", "jsonb", "bool", "REAL", None)] == [
        "NUMBER", "STRING", "DATETIME", "JSON", "BOOLEAN", "NUMBER", "STRING"]


def test_sql_dataset(spark, rows):
    df = spark.range(10)
    out = R.sql_dataset(spark, "SELECT count(*) AS n FROM numbers WHERE id >= :low", {"numbers": df}, {"low": 4})
    assert rows(out) == [(6,)]
    with pytest.raises(ValueError, match="starts with SELECT"):
        R.sql_dataset(spark, "DROP TABLE numbers", {})


def workbook(path, *sheets):
    """A workbook written by hand: shared and inline texts, numbers, flags, gaps."""
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    shared = []

    def cell(ref, v):
        if v is None:
            return ""
        if isinstance(v, bool):
            return f'<c r="{ref}" t="b"><v>{int(v)}</v></c>'
        if isinstance(v, (int, float)):
            return f'<c r="{ref}"><v>{v}</v></c>'
        if v.startswith("="):
            return f'<c r="{ref}" t="inlineStr"><is><t>{v[1:]}</t></is></c>'
        shared.append(v)
        return f'<c r="{ref}" t="s"><v>{len(shared) - 1}</v></c>'

    with zipfile.ZipFile(path, "w") as z:
        for i, table in enumerate(sheets):
            body = "".join(f'<row r="{r + 1}">' + "".join(cell(f"{chr(65 + c)}{r + 1}", v) for c, v in enumerate(row)) + "</row>"
                           for r, row in enumerate(table))
            z.writestr(f"xl/worksheets/s{i}.xml", f"<worksheet {ns}><sheetData>{body}</sheetData></worksheet>")
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}>" + "".join(f"<si><r><t>{s[:1]}</t></r><r><t>{s[1:]}</t></r></si>" for s in shared) + "</sst>")
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="{rel}"><sheets>' + "".join(
            f'<sheet name="S{i}" sheetId="{i + 1}" r:id="rId{i}"/>' for i in range(len(sheets))) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships xmlns=\"http://schemas.openxmlformats.org/package/2006/relationships\">" + "".join(
            f'<Relationship Id="rId{i}" Target="{"/xl/" if i else ""}worksheets/s{i}.xml"/>' for i in range(len(sheets))) + "</Relationships>")


def test_workbook_folder(spark, rows, tmp_path):
    head = ["id", " name ", "price", "active", "other"]
    workbook(tmp_path / "a.xlsx", [["skip"], ["x"]], [head, [1, "Ann", 2.5, True, "z"], [2, "=Bob", None, False]])
    workbook(tmp_path / "b.xlsx", [["skip"]], [head[:2], [3, 7]])
    (tmp_path / "c.txt").write_text("no workbook")
    out = R.scan_workbooks(spark, str(tmp_path), FIELDS, sheet_index=1, keep_origin=True)
    got = sorted(rows(out, "id", "name", "price", "active", "note", "row_ord"))
    assert got == [(1.0, "Ann", 2.5, True, None, 1), (2.0, "Bob", None, False, None, 2), (3.0, "7.0", None, None, None, 1)]
    header = workbook_header(spark, str(tmp_path), 1)
    assert sorted(rows(header, "col", "name"))[:3] == [(0, "id"), (0, "id"), (1, "name")]
    with pytest.raises(Exception, match="sheet index 5"):
        R.scan_workbooks(spark, str(tmp_path), FIELDS, sheet_index=5).collect()


def test_workbook_header_row(spark, rows, tmp_path):
    workbook(tmp_path / "a.xlsx", [["title"], ["id", "name"], [5, "Eve"]])
    assert rows(R.scan_workbooks(spark, str(tmp_path), FIELDS[:2], header_row=1)) == [(5.0, "Eve")]


def test_source_registry(spark, rows, tmp_path):
    (tmp_path / "a.csv").write_text("id\n4\n")
    assert rows(R.read_source(spark, "CSV", {"path": str(tmp_path / "a.csv")}, FIELDS[:1])) == [(4.0,)]
    R.register_source("RANGE", lambda spark, options, fields: spark.range(options["n"]))
    assert R.read_source(spark, "RANGE", {"n": 3}, []).count() == 3
    del R.SOURCES["RANGE"]
    with pytest.raises(ValueError, match="no reader"):
        R.read_source(spark, "API", {}, [])


class Recorder:
    """Stands in for a session whose reader notes its options, since no database runs here."""

    def __init__(self, frames):
        self.frames, self.scans = frames, []

    @property
    def read(self):
        recorder, noted = self, {}

        class Reader:
            def format(self, name):
                return self.option("format", name)

            def option(self, key, value):
                noted[key] = value
                return self

            def options(self, **more):
                noted.update(more)
                return self

            def load(self):
                recorder.scans.append(noted)
                return recorder.frames["bounds" if "MIN(" in noted["dbtable"] else "table"]

        return Reader()


def test_jdbc_options(spark, rows):
    database = Recorder({"table": spark.createDataFrame([(1, "a")], "ID bigint, NAME string"),
                         "bounds": spark.createDataFrame([(3, 90)], "low bigint, high bigint")})
    df = R.scan_jdbc(database, "jdbc:x", "people", [Field("id", "NUMBER"), Field("name"), Field("gone")],
                     {"user": "u"}, ("ID", 4, 0, 100))
    assert rows(df) == [(1, "a", None)]
    assert database.scans == [{
        "format": "jdbc", "url": "jdbc:x", "user": "u", "dbtable": "people", "partitionColumn": "ID",
        "lowerBound": "0", "upperBound": "100", "numPartitions": "4"}]
    R.scan_jdbc(database, "jdbc:x", " select ID from t", partition=("ID", 8))
    bounds, scan = database.scans[1:]
    assert bounds["dbtable"] == "(SELECT MIN(ID) AS low, MAX(ID) AS high FROM ( select ID from t) q) b"
    assert (scan["dbtable"], scan["lowerBound"], scan["upperBound"]) == ("( select ID from t) q", "3", "90")
    database.frames["bounds"] = spark.createDataFrame([(None, None)], "low bigint, high bigint")
    R.scan_jdbc(database, "jdbc:x", "empty", partition=("ID", 8))
    assert "partitionColumn" not in database.scans[-1]


def test_blank_first_lines_are_no_headers(spark, tmp_path):
    for name, text in {"a": "\nid,name\n1,Ann\n", "b": "  \n\nname,id\nCy,3\n", "c": '\n"id","name"\n4,"Di, D"\n'}.items():
        (tmp_path / f"{name}.csv").write_text(text)
    got = R.scan_csv(spark, str(tmp_path)).select("id", "name").collect()
    assert sorted(map(tuple, got)) == [("1", "Ann"), ("3", "Cy"), ("4", "Di, D")]
