"""From raw documents to packed training sequences, in five stages.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that the one before kept; all but the last return the columns
of ``documents``. ``run`` writes each stage's result to the shared folder and reads it back for the next.

Defined results, in every stage: a row travels as one struct, so extra columns of any name come through; a null text counts
as empty; repeated rows are judged one by one until near-duplicates go; an empty table gives no rows.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from relevanta.llm import langid, mixing, near_dup, packing, quality
from relevanta.llm.common import held_out, staged

#: Below these a document is rejected: the probability of good quality, and the margin of its language.
GOOD, SURE = 0.5, 0.3


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier finds good, learned from the labels outside its hold-out. Null ids have no
    label, but are scored; empty texts go where short texts without words of their own go."""
    model = quality.fit(docs, quality.training_labels(spark.read.parquet(f"{sf_dir}/labels.parquet")))
    rows = quality.add_quality(docs.select(F.struct("*").alias("row")), model, text_col="row.text")
    return rows.filter(F.col("score") >= GOOD).select("row.*")


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the identifier knows, learned from documents outside its hold-out. Texts that are null
    or without a letter go; a null ``lang`` is not learned from."""
    known = docs.select("doc_id", "text", "lang").filter(~held_out("doc_id", 3, 1))
    rows = langid.add_language(docs.select(F.struct("*").alias("row")), langid.fit(known), text_col="row.text")
    return rows.filter((F.col("lang_pred") != "und") & (F.col("score") >= SURE)).select("row.*")


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates, the one with the smallest id. A document without an id stands under
    a digest of its text, above the ids in use, so that it stays only where no document with an id is in its class. Rows
    with one id are one document: the row with the smallest text, source and language stays."""
    digest = F.xxhash64(F.lit("text"), F.coalesce("text", F.lit(""))).bitwiseAND(F.lit((1 << 62) - 1)).bitwiseOR(F.lit(1 << 62))
    named = docs.select(F.struct("*").alias("row"), F.coalesce(F.col("doc_id").cast("long"), digest).alias("id"), "text")
    kept = near_dup.near_duplicates(named, id_col="id").filter("kept").select(F.col("doc_id").alias("id")).distinct()
    once = named.select("id", "row").join(kept, "id", "left_semi").groupBy("id").agg(F.min_by("row", F.struct("row.text", "row.source", "row.lang")).alias("row"))
    return once.select("row.*")


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it, range-sorted by training position. Rows without an id are mixed one by
    one, under their text and a number; rows alike in id (the stage before leaves one) share what is taken of them evenly.
    A null source is a source of its own; texts without words are never taken."""
    text = F.md5(F.coalesce("text", F.lit("")))
    alike = Window.partitionBy(text).orderBy("source", "lang")
    rows = docs.select(F.struct("*").alias("row"), "doc_id", "text", "source", "lang")
    named = rows.filter("doc_id is not null").withColumn("key", F.col("doc_id").cast("string"))
    keyed = named.unionByName(rows.filter("doc_id is null").withColumn("key", F.concat_ws(" ", F.lit("text"), text, F.row_number().over(alike))))
    mixed = mixing.mix(keyed, id_col="key").groupBy(F.col("doc_id").alias("key")).agg(F.flatten(F.collect_list("positions")).alias("all"), F.count("*").cast("int").alias("rows"))
    taken = mixed.select("key", F.slice("all", F.lit(1), F.floor(F.size("all") / F.col("rows")).cast("int")).alias("positions"))
    placed = keyed.select("key", "row").join(taken, "key").withColumn("position", F.explode("positions"))
    return placed.repartitionByRange("position", "key").sortWithinPartitions("position", "key").select("row.*")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their place in sequences of 2048 tokens; a null text is its end alone. The token cache
    is smaller than an operator of its own would have it, as other stages share the workers' memory."""
    return packing.packing_report(docs, cache_entries=200_000)


#: Texts that cross to a Python worker at once. A batch is held by the executor and by the worker, so Spark's 10,000 texts
#: of some thousand letters cost twice their size for each core.
TEXTS = 2000


def _few_at_once(stage):
    """The stage in a session that hands texts to Python workers in small batches."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        most = int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))  # 0 or less: no limit
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", most if 0 < most < TEXTS else TEXTS)
        return stage(spark, docs, sf_dir)

    return run


STAGES = [
    ("quality classifier", _few_at_once(quality_stage)),
    ("language identification", _few_at_once(language_stage)),
    ("near-duplicates", _few_at_once(near_duplicate_stage)),
    ("mixing", _few_at_once(mixing_stage)),
    ("packing", _few_at_once(packing_stage)),
]

#: SQL cannot express the classifiers, the sketches or the tokenizer; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
