"""A training corpus from raw documents: quality classifier, exact dedup, near dedup, secret redaction, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is written as Parquet and read again as the
next stage's ``docs``. All but the last keep the columns of ``documents``. Decisions are made and applied by row, so that
null and repeated ids are documents like any other. In all stages an empty table gives an empty result, further columns
are kept (but for the last), whatever their names, and texts of any length are read whole.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import common, exact_dedup, near_dedup, packing, quality, secrets

#: What the stages write on their way; each stage deletes what the ones before it wrote, as their results have been written.
SCRATCH = common.Scratch()


def _stage(f):
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        SCRATCH.release(spark)
        with SCRATCH:
            return f(spark, docs, sf_dir)

    run_stage.__doc__, run_stage.__name__ = f.__doc__, f.__name__
    return run_stage


@_stage
def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the classifier rejects, learnt from the labels of this corpus.

    A null text is scored as an empty one. Rows that repeat a text are judged alike; a label of an id counts for all rows
    with that id. Without labels nothing is dropped.
    """
    rows = common.keyed(docs)
    rejected = quality.score_documents(rows, common.table(spark, sf_dir, "labels"), row_col=common.ROW).where("predicted = 0")
    return rows.join(rejected.select(F.col("row").alias(common.ROW)), common.ROW, "left_anti").select(*docs.columns)


@_stage
def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of texts that are equal but for white space.

    Null and empty texts are one group. The longest original stays, of these the one of least id (null ids last), of rows
    that repeat an id the first.
    """
    return exact_dedup.dedup(docs).select(*docs.columns)


@_stage
def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates: five words, similarity 0.8.

    The one of least id stays (null ids last), of rows that repeat an id the first. Null and empty texts have no near
    duplicates and stay, all of them.
    """
    rows = common.keyed(docs)
    found = near_dedup.near_duplicates(rows, words=5, threshold=(80, 100), id_col=common.ROW).select(F.col("doc_id").alias(common.ROW), "component_id")
    first = F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col(common.ROW).alias("row")))
    stays = rows.select("doc_id", common.ROW).join(found, common.ROW).groupBy("component_id").agg(first.alias("first")).select(F.col("first.row").alias(common.ROW))
    return rows.join(stays, common.ROW, "left_semi").select(*docs.columns)


@_stage
def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces live-looking secrets and counts characters anew; every document stays, a null text as it is.

    Each row's own secrets are replaced; rows that repeat an id are one owner.
    """
    return secrets.redact(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


@_stage
def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences; a null text has its final token only, and each row is packed once."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


STAGES = [
    ("quality classifier", quality_stage),
    ("exact dedup", exact_dedup_stage),
    ("near dedup", near_dedup_stage),
    ("secret scan", secrets_stage),
    ("packing", packing_stage),
]

#: SQL can't train the classifier or encode tokens.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again; only the last one's table is left."""
    docs = common.table(spark, sf_dir, "documents")
    base = f"{common.shared_dir(spark)}/tessera-pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        path = f"{base}/{k}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if k:
            common.delete(spark, f"{base}/{k - 1}")
    SCRATCH.release(spark)
    return docs
