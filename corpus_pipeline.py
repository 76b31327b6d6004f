"""The corpus pipeline: quality, toxicity and near-duplicate filters, then packing.

Each stage takes (spark, docs, sf_dir) and works on all documents that its predecessor kept. The
classifiers are fitted on a bounded sample of the labelled documents of sf_dir.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sedge.llm import common, neardup, packing, quality, toxicity

#: Near duplicates share so many of their shingles (in percent) of so many words.
NEAR_WORDS, NEAR_PERCENT = 5, 80
TOKENIZER = "byte_bpe_50k.json"


def judged(docs: DataFrame, score, model, wanted: int) -> DataFrame:
    """Rows of docs that the classifier predicts to be so; their columns may have any names."""
    plain = docs.select(*[F.col(f"`{c}`").alias("text" if c == "text" else f"_{i}") for i, c in enumerate(docs.columns)])
    return score(plain, model).filter(F.col("predicted") == wanted).select(*plain.columns).toDF(*docs.columns)


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of good quality; a null or empty text is scored like any other."""
    model = quality.fitted(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))
    return judged(docs, quality.score, model, 1)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that are not toxic."""
    model = toxicity.fitted(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))
    return judged(docs, toxicity.score, model, 0)


def keep_one_of_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group, that of the smallest doc_id. Of rows that repeat doc_id and text one
    stays; rows that repeat a doc_id with another text are documents of their own, later than all
    others. Rows without doc_id have no group and all stay, as do empty texts."""
    named, unnamed = docs.filter(F.col("doc_id").isNotNull()), docs.filter(F.col("doc_id").isNull())
    repeated = common.stash(named.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id"), "repeated-ids")
    row = "_near_row"
    if repeated.isEmpty():
        rows = named.withColumn(row, F.col("doc_id").cast("long"))
    else:
        many = named.join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
        many = common.stash(many.withColumn(row, F.row_number().over(Window.partitionBy("doc_id").orderBy("text")).cast("long")), "repeated-rows")
        last = named.agg(F.max("doc_id")).first()[0]
        later = many.filter(F.col(row) > 1).repartitionByRange("doc_id", row).sortWithinPartitions("doc_id", row)
        later = later.withColumn(row, F.lit(last + 1).cast("long") + F.monotonically_increasing_id())
        alone = named.join(repeated, "doc_id", "left_anti").unionByName(many.filter(F.col(row) == 1).drop(row)).withColumn(row, F.col("doc_id").cast("long"))
        rows = common.stash(alone.select(*docs.columns, row).unionByName(later.select(*docs.columns, row)), "named-rows")
    found = neardup.groups(rows.select(F.col(row).alias("doc_id"), "text"), NEAR_WORDS, NEAR_PERCENT).filter("kept").select(F.col("doc_id").alias(row))
    return rows.join(found, row, "left_semi").select(*docs.columns).unionByName(unnamed)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packed(docs, public_tokenizers.path(TOKENIZER))


STAGES = [("quality", keep_good), ("toxicity", drop_toxic), ("near_dedup", keep_one_of_near), ("packing", pack)]

#: SQL cannot express the classifiers or the tokenizer; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.stash(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
