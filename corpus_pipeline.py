"""The corpus pipeline: its stages, each written as Parquet and read again as the next one's documents."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm import near, packing, secrets, session, substrings, toxicity


#: What the stages read and write; other columns go through them untouched, whatever their names.
OWN = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is below the threshold of their language; a score depends on the text alone.

    Null and empty texts have the score of no words, a null language has the general threshold, a score that equals its threshold goes,
    repeated rows stay or go together, and an empty table stays empty.
    """
    session.bound_batches(spark)
    own = session.neutral(docs, *OWN)
    net = toxicity.fit(own, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score_documents(own, net).where("NOT is_toxic").select(*own.columns).toDF(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (similarity 0.8 or more of their shingles of five words) the row with the least doc_id.

    Of rows with one doc_id but different texts each counts for itself; if several are in a group, the text with the least hash stays. Of rows with one
    doc_id and text one stays. Texts without words, null and empty ones too, are copies of each other. Rows without an id stand behind all others, in the
    order of their texts' hashes: one stays if its group has no row with an id.
    """
    own = session.neutral(docs, *OWN)
    behind = F.lit(1 << 62) + F.xxhash64("text").bitwiseAND(F.lit((1 << 62) - 1))
    own = own.withColumn("__named", F.col("doc_id").isNotNull()).withColumn("doc_id", F.coalesce(F.col("doc_id").cast("long"), behind))
    groups = near.near_groups(own)
    ids = groups.groupBy("group").agg(F.min(F.struct("doc_id", "k")).alias("at")).select("at.*").distinct().withColumnRenamed("k", "__k")
    rest = [c for c in own.columns if c not in ("doc_id", "text")]
    first = F.row_number().over(Window.partitionBy("doc_id", "__k").orderBy(F.xxhash64(*(F.col(c).cast("string") for c in rest))))
    kept = own.withColumn("__k", F.xxhash64("text")).join(ids, ["doc_id", "__k"], "left_semi").withColumn("__n", first).where("__n = 1")
    named = F.when(F.col("__named"), F.col("doc_id")).cast(docs.schema["doc_id"].dataType).alias("doc_id")
    return kept.select(*(named if c == "doc_id" else F.col(c) for c in own.columns if c != "__named")).toDF(*docs.columns)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without passages of over 50 words that also stand elsewhere, n_chars counted anew; one of which nothing is left goes.

    Null, empty and blank texts stay. A repeated row stands elsewhere too: both lose everything and go.
    """
    own = session.neutral(docs, *OWN)
    left = substrings.remove_repeated_words(own)
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text"))
    left = left.where((F.col("n_removed") == 0) | (F.trim("kept") != "")).withColumn("text", text)
    if "n_chars" in own.columns:
        left = left.withColumn("n_chars", F.length("text").cast(own.schema["n_chars"].dataType))
    return left.select(*own.columns).toDF(*docs.columns)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with every secret replaced by a mask, n_chars counted anew. Null and empty texts and repeated rows stay as they are; secrets that touch or overlap get one mask."""
    session.bound_batches(spark)
    return secrets.redact_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 ids. Null and empty texts are just the end's id, repeated rows are packed each for itself, an empty table gives none."""
    session.bound_batches(spark)
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_copies),
    ("suffix_array_dedup", cut_repeats),
    ("secret_scans", mask_secrets),
    ("packing", pack),
]
#: SQL can't express the stages; tests hold each against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    session.ensure_checkpoints(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = session.documents(spark, sf_dir)
    for number, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(path := f"{folder}/{number}-{name}")
        docs = spark.read.parquet(path)
    return docs
