"""Queries of streams and of runs between silences, and the same in SQL. The streams are real ones: the events in files, a micro-batch for each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import DAY, HOUR, MINUTE
from ..operators import silence
from ..sources import tables, ticks
from ..streaming import compact_bars, keep_bars, kept_bars
from ..streaming.detect import flags_stream
from . import pit
from .pit import FLAG, FROM_US, TO_US, bar_sql, coarse, query

FILES = 4


def streamed(spark: SparkSession, quotes: DataFrame, part: str, last: DataFrame | None = None) -> DataFrame:
    """A stream of the quotes with a timestamp at: FILES folders by `part`, which is 0 to FILES - 1, in this order, and those of `last` after them."""
    folder = tables.scratch(spark, "stream")
    held = quotes.withColumn("at", F.timestamp_micros("ts"))
    for number in range(FILES):
        held.where(f"{part} = {number}").coalesce(1).write.parquet(f"{folder}/{number}")
    if last is not None:
        last.withColumn("at", F.timestamp_micros("ts")).select(*held.columns).coalesce(1).write.parquet(f"{folder}/{FILES}")
    return spark.readStream.schema(held.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(folder)


def heartbeat(quotes: DataFrame) -> DataFrame:
    """One row a year after the last quote, of an instrument of its own: the watermark passes all quotes with it."""
    end = quotes.agg((F.max("ts") + 366 * DAY).alias("ts"))
    return end.select(F.lit("heartbeat").alias("instrument"), "ts", F.lit(0.0).alias("bid"), F.lit(0.0).alias("ask"), F.lit("none").alias("source"), F.lit(-1).cast("long").alias("seq"))


def all_of(spark: SparkSession, stream: DataFrame) -> DataFrame:
    """What the stream gives, once all its files are read."""
    folder = tables.scratch(spark, "found")
    stream.writeStream.format("parquet").option("checkpointLocation", f"{folder}/check").option("path", f"{folder}/out").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


@query("bars_kept_by_stream", f"WITH {bar_sql(HOUR)} SELECT * FROM bar")
def _(spark, d):
    folder, t = tables.scratch(spark, "bars"), ticks(spark, d)
    # every batch has quotes of all times, so most come weeks late
    keep_bars(streamed(spark, t, f"seq % {FILES}"), folder, f"{folder}/check", HOUR, availableNow=True).awaitTermination()
    names = sorted(r.instrument for r in t.select("instrument").distinct().collect())
    assert compact_bars(spark, folder, names, FROM_US, TO_US) is not None
    return kept_bars(spark, folder)


@query("flags_streamed", f"{pit.STALE} UNION ALL {FLAG['session_gap']}")
def _(spark, d):
    t = coarse(spark, d)
    late = f"least({FILES - 1}, greatest(0, (ts - {FROM_US}) div {9 * DAY}))"
    return all_of(spark, flags_stream(streamed(spark, t, late, heartbeat(t)))).drop("detail")


RUNS = """l AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY instrument ORDER BY ts, seq) < {0} THEN 0 ELSE 1 END AS new FROM tick),
r AS (SELECT *, sum(new) OVER (PARTITION BY instrument ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS run FROM l),
u AS (SELECT instrument, min(ts) AS run_start, max(ts) AS run_end, count(*) AS ticks FROM r GROUP BY instrument, run)"""


@query("active_runs", f"WITH {RUNS.format(silence.SILENCE_MINUTES * MINUTE)} SELECT *, CAST((lead(run_start) OVER (PARTITION BY instrument ORDER BY run_start) - run_end) // {MINUTE} AS BIGINT) AS silent_minutes FROM u")
def _(spark, d):
    return silence.active_runs(ticks(spark, d))


@query("active_runs_streamed", f"WITH {RUNS.format(silence.SILENCE_MINUTES * MINUTE)} SELECT * FROM u")
def _(spark, d):
    t = ticks(spark, d)
    late = f"least({FILES - 1}, greatest(0, (ts - {FROM_US}) div {9 * DAY}))"
    return all_of(spark, silence.active_runs_stream(streamed(spark, t, late, heartbeat(t)))).where("instrument <> 'heartbeat'")
