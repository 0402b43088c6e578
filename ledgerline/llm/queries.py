"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm.decontamination import contamination
from ledgerline.llm.filter_audit import ORACLE_SQL as AUDIT_SQL
from ledgerline.llm.filter_audit import audit_documents
from ledgerline.llm.host_reputation import ORACLE_SQL as URL_SQL
from ledgerline.llm.host_reputation import Rule, judge_urls
from ledgerline.llm.language import identify
from ledgerline.llm.line_templates import ORACLE_SQL as LINE_SQL
from ledgerline.llm.line_templates import drop_recurring_lines
from ledgerline.llm.manifest import ORACLE_SQL as MANIFEST_SQL
from ledgerline.llm.manifest import dataset_manifest
from ledgerline.llm.mixing import mix
from ledgerline.llm.multi_index import nearest
from ledgerline.llm.ngram_join import jaccard_groups
from ledgerline.llm.passages import repeated_passages
from ledgerline.llm.personal_data import find_personal_data, listed_spans
from ledgerline.llm.quality_rules import ORACLE_SQL as QUALITY_SQL
from ledgerline.llm.quality_rules import judge_quality
from ledgerline.llm.warc import ORACLE_SQL as WARC_SQL
from ledgerline.llm.warc import round_trip

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None):
    """Registers a function of (spark, sf_dir) under its own name, with its SQL if there is any."""
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f
    return register


@query()
def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(_table(spark, sf_dir, "documents")).drop("text_key")


@query()
def op2_inverted_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(_table(spark, sf_dir, "embeddings"))


@query()
def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listed_spans(find_personal_data(_table(spark, sf_dir, "documents")))


@query()
def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_groups(_table(spark, sf_dir, "documents")).drop("text_key")


@query()
def op5_paragraph_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(_table(spark, sf_dir, "documents"))


@query()
def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    ids = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(ids, 256).alias("items_sha256"), "contaminated")


@query(WARC_SQL)
def op7_warc_zstd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(_table(spark, sf_dir, "pages")).drop("url")


URL_RULES = (Rule("allow", "org", "/"), Rule("block", "example.org", "/es/"), Rule("block", "example.org", "/en/1"),
             Rule("allow", "com", "/fr/"), Rule("block", "com", "/de/"))


@query(URL_SQL)
def op8_host_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's outcome is bad if the label of its number says toxic or of low quality."""
    labels = _table(spark, sf_dir, "labels").where("toxic is not null or quality is not null")
    bad = ((F.coalesce("toxic", F.lit(0)) == 1) | (F.coalesce("quality", F.lit(1)) == 0)).cast("int")
    outcomes = labels.select(F.col("doc_id").alias("page_id"), bad.alias("bad"))
    return judge_urls(_table(spark, sf_dir, "pages"), outcomes, URL_RULES).drop("rate")


@query()
def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(_table(spark, sf_dir, "documents"))


@query(LINE_SQL)
def op10_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_recurring_lines(_table(spark, sf_dir, "documents"), spare_copies=False).select("doc_id", "n_lines", "n_dropped", "text")


@query(QUALITY_SQL)
def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")).drop("n_lines", "rules")


@query(MANIFEST_SQL)
def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dataset_manifest(_table(spark, sf_dir, "documents")).drop("source", "path")


@query(AUDIT_SQL)
def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
