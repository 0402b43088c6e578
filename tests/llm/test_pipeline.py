"""The registered queries against their SQL, and the pipeline stage by stage on the small tables."""

import os

import pytest

import __spark_entry__ as E
import corpus_pipeline
from ledgerline.llm.decontamination import contamination
from ledgerline.llm.ngram_join import jaccard_groups
from ledgerline.llm.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"
duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the test tables are not here")


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_agrees_with_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "labels", "embeddings", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = QUERIES[name](spark, DATA)
    cursor = con.execute(ORACLE_SQL[name])
    at = [[d[0] for d in cursor.description].index(c) for c in df.columns]
    assert sorted(repr(tuple(r)) for r in df.collect()) == sorted(repr(tuple(r[i] for i in at)) for r in cursor.fetchall())


def test_every_number_has_one_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert set(QUERIES) | {"pipeline"} <= set(E.queries())


def test_stages_keep_what_they_should(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    odd = spark.createDataFrame([(90_001, None, "en", None, None), (90_002, "12 34", "en", "s", 5), (90_003, "", None, "s", 0)], docs.schema)
    docs = docs.unionByName(odd)
    kept = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, DATA).write.parquet(out := f"{tmp_path}/{k}")
        before, docs = docs, spark.read.parquet(out)
        ids = {r.doc_id for r in docs.select("doc_id").collect()}
        kept.append(ids)
        if k < 4:
            assert tuple(docs.columns) == corpus_pipeline.COLUMNS
        if k == 2:
            groups = jaccard_groups(before).collect()
            assert ids == {g.component_id for g in groups} and docs.count() == len(ids)
        if k == 3:
            goes = {r.doc_id for r in contamination(before, spark.read.parquet(f"{DATA}/benchmark.parquet")).where("contaminated").collect()}
            assert goes and ids == {r.doc_id for r in before.collect()} - goes
    all_ids = {r.doc_id for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id").collect()}
    assert kept[0] == all_ids == kept[1]
    assert kept[4] <= kept[3] and all(r.taken > 0 and r.taken <= 3 * r["size"] for r in docs.collect())
    run = corpus_pipeline.run(spark, DATA)
    assert sorted(map(repr, run.drop("taken", "size").collect())) == sorted(map(repr, docs.where("doc_id < 90001").drop("taken", "size").collect()))


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_take_an_empty_table(spark, name, stage):
    out = stage(spark, spark.createDataFrame([], SCHEMA), DATA)
    assert out.collect() == [] and tuple(out.columns[:5]) == corpus_pipeline.COLUMNS


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES[1:])
def test_stages_take_null_ids_and_repeated_rows(spark, name, stage):
    """Unlike texts stay, each once or as often as it came; none is lost for its id."""
    (item,) = spark.read.parquet(f"{DATA}/benchmark.parquet").where("length(text) > 200").limit(1).collect()
    text = lambda i: " ".join(f"own{i}word{k}" for k in range(30))
    rows = [(None, text(i), None, None, None) for i in range(4)] + [(7, text(7), "en", "s", 1)] * 3 + [(7, text(8), "en", "s", 1), (None, text(9), "en", "s", 1), (None, text(9), "en", "s", 1)]
    got = [r.text for r in stage(spark, spark.createDataFrame([*rows, (None, item.text, "en", "s", 1), (7, item.text, "en", "s", 1)], SCHEMA), DATA).collect()]
    if name == "benchmark decontamination":
        assert item.text not in got and sorted(got) == sorted(r[1] for r in rows)
    elif name.startswith("mixing"):  # which documents the blocks fall on is drawn; each comes once
        assert got and len(got) == len(set(got)) and set(got) <= {r[1] for r in rows} | {item.text}
    else:
        assert set(got) >= {r[1] for r in rows}
    if name == "n-gram Jaccard join":
        assert len(got) == len(set(got))
