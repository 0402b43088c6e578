"""A training corpus from raw documents, in stages that each work on all that the stage before kept.

Each stage is a function of (spark, docs, sf_dir); its result is written as Parquet and read again as
the next one's ``docs``. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm.decontamination import contamination
from ledgerline.llm.language import NONE, held_out, predict, train
from ledgerline.llm.line_templates import drop_recurring_lines
from ledgerline.llm.mixing import mix
from ledgerline.llm.ngram_join import rooted_groups
from ledgerline.session import new_path, scratch, write_down

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
LEAST_SCORE = 0.5  # of the predicted language


def _keyed(docs: DataFrame) -> DataFrame:
    """With keys that tell documents apart by plain equality: rows of equal id and text are one document."""
    return docs.withColumn("id", F.coalesce("doc_id", F.lit(-1 << 63))).withColumn("text_key", F.xxhash64("text"))


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters go, and those of which no language is likelier than all others; the latter
    stay if no row has a language to learn from."""
    model = train(docs.where(~held_out() & F.col("doc_id").isNotNull()).select("doc_id", "text", "lang"))
    if not model.languages:
        return docs.where(F.col("text").rlike(r"\p{L}")).select(*COLUMNS)
    judged = predict(docs.withColumn("whole", F.col("text")), model, "doc_id", "whole", "lang", "source", "n_chars")
    return judged.where((F.col("lang_pred") != NONE) & (F.col("score") >= LEAST_SCORE)) \
        .withColumnRenamed("whole", "text").select(*COLUMNS)


def without_recurring_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines whose template recurs go from the texts; every document stays."""
    less = drop_recurring_lines(docs.select(*COLUMNS))
    n_chars = F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return less.withColumn("n_chars", n_chars).select(*COLUMNS)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links of Jaccard 0.8 on five-word shingles join, that of least doc_id stays, once:
    null ids come last, and of equal ids the text's hash decides. Documents without words stay."""
    groups = rooted_groups(docs)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_key")).alias("first")
    stays = groups.where("root is not null").groupBy("root").agg(first).select("first.doc_id", "first.text_key") \
        .unionByName(groups.where("root is null").select("doc_id", "text_key"))
    return _keyed(docs).join(_keyed_ids(stays), ["id", "text_key"], "left_semi") \
        .dropDuplicates(["id", "text_key"]).select(*COLUMNS)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which windows of benchmark items cover a twentieth of the words go."""
    found = contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).where("contaminated")
    return _keyed(docs).join(_keyed_ids(found), ["id", "text_key"], "left_anti").select(*COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix of sources takes words of, with how many, repeats counted."""
    taken = mix(docs).where("taken > 0").withColumn("id", F.coalesce("doc_id", F.lit(-1 << 63))) \
        .groupBy("id", "text_key").agg(F.first("size").alias("size"), F.sum("taken").alias("taken"))
    return _keyed(docs).join(taken, ["id", "text_key"]).dropDuplicates(["id", "text_key"]).select(*COLUMNS, "size", "taken")


def _keyed_ids(found: DataFrame) -> DataFrame:
    return found.select(F.coalesce("doc_id", F.lit(-1 << 63)).alias("id"), "text_key").distinct()


STAGES = [
    ("language ID", known_language),
    ("line dedup", without_recurring_lines),
    ("n-gram Jaccard join", one_of_each_group),
    ("benchmark decontamination", without_benchmark),
    ("mixing sources to target weights", mixed),
]

#: The first stage is a trained model, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, from ``documents`` of ``sf_dir``; what a stage writes down in between goes with it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        path = new_path(spark)
        with scratch(spark):
            docs = write_down(stage(spark, docs, sf_dir), path)
    return docs
