"""A corpus pipeline of five stages over documents; each is written as Parquet and read again.

Quality classifier (rejected documents go), quality rules (rejected documents go), MinHash near-duplicates
(one document of each group stays), benchmark decontamination (documents that hold a benchmark item go),
SentencePiece encoding (token ids of what is left, decoded again for proof).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import byte_cnn, decontaminate, near_dup, quality_rules, sentencepiece_fst
from millrace.llm.common import materialize, table


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it learns from the labelled documents of the table as it was."""
    model = byte_cnn.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return byte_cnn.keep_good(docs, model)


#: Names a row of documents, whether its doc_id is null, repeated or neither.
ROW = "__row"


def _told_apart(docs: DataFrame, *columns: str) -> Column:
    """A 64-bit key of a row's columns; rows that agree in all of them get one verdict."""
    return F.xxhash64(*(x for c in columns for x in (F.col(c), F.col(c).isNull())))


def _kept(docs: DataFrame, verdict: DataFrame) -> DataFrame:
    """The rows of docs that the verdict (whose doc_id is ROW) rejects nowhere."""
    rejected = verdict.where("NOT kept").select(F.col("doc_id").alias(ROW)).distinct()
    return docs.join(rejected, ROW, "left_anti").drop(ROW)


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are no outliers of their language and source; every row is judged by its own text."""
    named = docs.withColumn(ROW, _told_apart(docs, "doc_id", "text", "lang", "source"))
    return _kept(named, quality_rules.judge(named.withColumn("doc_id", F.col(ROW))))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, the one of the least doc_id.

    Rows without a doc_id and rows that share one are told apart by their texts and come after all others; of those that share doc_id and text, one stays.
    """
    later = F.lit(1 << 62) + F.shiftrightunsigned(_told_apart(docs, "doc_id", "text"), 2)
    often = docs.groupBy("doc_id").count().where("count > 1")
    if often.limit(1).count() == 0:
        named = docs.withColumn(ROW, F.coalesce(F.col("doc_id").cast("long"), later))
    else:
        often = materialize(often.select(F.col("doc_id").alias("__often"), F.lit(True).alias("__shared")), "shared")
        shared = F.coalesce(F.col("__shared"), F.lit(False)) | F.col("doc_id").isNull()
        named = docs.join(often, F.col("doc_id").eqNullSafe(F.col("__often")), "left").withColumn(ROW, F.when(shared, later).otherwise(F.col("doc_id").cast("long")))
        named = materialize(named.drop("__often", "__shared").dropDuplicates([ROW]), "named")
    return _kept(named, near_dup.near_duplicates(named.withColumn("doc_id", F.col(ROW))))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item."""
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, token_ids, n_tokens and round_trip."""
    return sentencepiece_fst.encode_documents(docs, id_columns=("doc_id", "lang", "source"))


STAGES = [
    ("quality classifier", classify),
    ("quality rules", rules),
    ("MinHash near-dedup", deduplicate),
    ("benchmark decontamination", decontaminated),
    ("SentencePiece encoding and decoding", encode),
]
ORACLE_SQL = None  # none of the stages can be put as SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.split()[0].lower())
    return STAGES[-1][1](spark, docs, sf_dir)
