"""What the operators need to know of the Spark session."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Rows of an Arrow batch: as one may hold texts of 100 KB and more, Spark's 10,000 would be too many for an executor's memory.
BATCH_ROWS = 1024


def bound_batches(spark: SparkSession) -> None:
    """Have Arrow batches of few rows, unless the session names a number of its own."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def ensure_checkpoints(spark: SparkSession) -> None:
    """Make checkpoint() usable: the shared folder that the cluster names, else the warehouse; a temporary one only if all runs in one local process, as in tests."""
    bound_batches(spark)
    context = spark.sparkContext
    if context.getCheckpointDir():
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and re.fullmatch(r"local(\[[^-]*\])?", context.master):
        folder = tempfile.mkdtemp(prefix="checkpoints-")
    context.setCheckpointDir(folder or f"{spark.conf.get('spark.sql.warehouse.dir')}/checkpoints")


def cut(frame: DataFrame) -> DataFrame:
    """The same rows with their lineage cut, in the shared checkpoint folder."""
    ensure_checkpoints(frame.sparkSession)
    return frame.checkpoint()


def stored(frame: DataFrame) -> DataFrame:
    """The same rows read from a Parquet table in the shared checkpoint folder: like cut, but compressed and read by column."""
    spark = frame.sparkSession
    ensure_checkpoints(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def neutral(docs: DataFrame, *own: str) -> DataFrame:
    """docs with every column but its own ones named __0, __1 and so on by place, so that no name an operator adds or joins by can clash."""
    return docs.toDF(*(c if c in own else f"__{i}" for i, c in enumerate(docs.columns)))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
