"""Bars and flags of a stream of quotes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import MINUTE
from ..operators.bars import combine_partials, merge_partials, partial_bars
from ..sources import tables


def bars_stream(quotes: DataFrame, length: str = "1 minute", late: str = "1 hour") -> DataFrame:
    """Bars of quotes whose column at is a timestamp; quotes later than `late` are dropped. keep_bars takes them in, however late."""
    order = F.struct("at", "seq")
    cells = []
    for side in ("bid", "ask"):
        cells += [F.min_by(side, order).alias(f"{side}_open"), F.max(side).alias(f"{side}_high"), F.min(side).alias(f"{side}_low"), F.max_by(side, order).alias(f"{side}_close")]
    rows = quotes.withWatermark("at", late).groupBy(F.window("at", length).alias("w"), "instrument", "source").agg(*cells, F.count("*").alias("tick_count"))
    return rows.select("instrument", "source", F.unix_micros("w.start").alias("minute"), *[c for c in rows.columns if c not in ("w", "instrument", "source")])


def keep_bars(quotes: DataFrame, folder: str, checkpoint: str, length: int = MINUTE, **trigger) -> StreamingQuery:
    """Start a query that keeps partial bars of a stream of quotes in the folder's table bar_part.

    A micro-batch adds one partial bar for each minute that it has quotes of, whatever these minutes are, so a quote counts however late it comes; no
    state is held between batches. Partials are stored under the batch's number: a batch that is run again after a failure overwrites its own.
    """
    path = f"{folder}/bar_part"

    def add(batch: DataFrame, number: int) -> None:
        parts = tables.with_month(tables.shaped(partial_bars(batch, length).withColumn("batch", F.lit(number).cast("long")), "bar_part"), "bar_part")
        by = ["batch", "instrument", "month"]
        parts.hint("rebalance", *by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)

    return quotes.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def kept_bars(spark: SparkSession, folder: str, start: int | None = None, end: int | None = None) -> DataFrame:
    """Bars of all quotes that have come in so far; with both ends only the months of [start, end) are opened."""
    return merge_partials(tables.read(spark, folder, "bar_part", start, end))


def compact_bars(spark: SparkSession, folder: str, instruments: list[str], start: int, end: int) -> tables.Replaced | None:
    """Make one partial bar of each minute's in the months of [start, end), of all batches but the last, which may yet be run again. Bars stay the same; None if there is nothing to do."""
    here = tables.read(spark, folder, "bar_part", start, end).where(F.col("instrument").isin(instruments))
    numbers = sorted(r.batch for r in tables.read(spark, folder, "bar_part").select("batch").distinct().collect())[:-1]
    if len(numbers) < 2:
        return None
    old = here.where(F.col("batch").isin(numbers))
    merged = combine_partials(old).withColumn("batch", F.lit(numbers[-1]).cast("long"))
    return tables.replace(spark, folder, "bar_part", merged, F.lit(True), [(str(n), i) for n in numbers for i in instruments], start, end)
