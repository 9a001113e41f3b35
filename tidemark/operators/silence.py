"""Runs of quotes between silences."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import DAY, MINUTE

SILENCE_MINUTES = 120


def active_runs(ticks: DataFrame, minutes: int = SILENCE_MINUTES) -> DataFrame:
    """(instrument, run_start, run_end, ticks, silent_minutes): runs of quotes with less than so many minutes between two, and the silence after each, null after the last.

    Runs are made of session windows within a day of an instrument, so that no instrument's history is one task's work; what goes on over midnight is joined
    by windows over these runs, of which a day has few.
    """
    at = F.timestamp_micros("ts")
    daily = ticks.groupBy("instrument", F.expr(f"ts div {DAY}").alias("day"), F.session_window(at, f"{minutes} minutes").alias("w")).agg(F.min("ts").alias("a"), F.max("ts").alias("z"), F.count("*").alias("n"))
    by = Window.partitionBy("instrument").orderBy("a")
    new = F.coalesce(F.col("a") - F.lag("z").over(by) >= minutes * MINUTE, F.lit(True)).cast("int")
    runs = daily.withColumn("new", new).withColumn("run", F.sum("new").over(by)).groupBy("instrument", "run")
    joined = runs.agg(F.min("a").alias("run_start"), F.max("z").alias("run_end"), F.sum("n").alias("ticks"))
    silent = (F.lead("run_start").over(Window.partitionBy("instrument").orderBy("run_start")) - F.col("run_end")) / MINUTE
    return joined.select("instrument", "run_start", "run_end", "ticks", F.floor(silent).alias("silent_minutes"))


def active_runs_stream(quotes: DataFrame, minutes: int = SILENCE_MINUTES, late: str = "1 hour") -> DataFrame:
    """The same runs, without the silences, of a stream of quotes whose column at is a timestamp: each is given once the watermark has passed the silence after it."""
    rows = quotes.withWatermark("at", late).groupBy("instrument", F.session_window("at", f"{minutes} minutes").alias("w"))
    return rows.agg(F.min(F.unix_micros("at")).alias("run_start"), F.max(F.unix_micros("at")).alias("run_end"), F.count("*").alias("ticks")).drop("w")
