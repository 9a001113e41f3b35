"""The ledger of fetched hours: one row for each (instrument, hour, source), claimed before a fetch and settled after it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import HOUR, day_of, floor_to
from .macro import upsert

SETTLED = ("ok", "empty", "missing")
KEYS = ["instrument", "hour", "source"]


def to_do(requested: DataFrame, ledger: DataFrame) -> DataFrame:
    """Requested hours without a settled row."""
    return requested.join(ledger.where(F.col("status").isin(*SETTLED)).select(*KEYS), KEYS, "left_anti")


def claim(ledger: DataFrame, hours: DataFrame, now: int) -> DataFrame:
    """The ledger with these hours in progress, one attempt more each, and not completed."""
    known = hours.select(*KEYS).distinct().join(ledger.select(*KEYS, F.col("attempts").alias("a")), KEYS, "left")
    rows = known.select(*KEYS, F.lit("in_progress").alias("status"), F.lit(None).cast("long").alias("tick_count"), F.lit(None).cast("long").alias("byte_count"), (F.coalesce("a", F.lit(0)) + 1).cast("int").alias("attempts"), F.lit(None).cast("string").alias("detail"), F.lit(now).cast("long").alias("claimed_at"), F.lit(None).cast("long").alias("completed_at"))
    return upsert(ledger, rows, KEYS)


def settle(ledger: DataFrame, results: DataFrame, now: int) -> DataFrame:
    """The ledger with the status, counts and detail of results (keys, status, tick_count, byte_count, detail)."""
    kept = ledger.select(*KEYS, "attempts", "claimed_at")
    rows = results.join(kept, KEYS).select(*KEYS, "status", "tick_count", "byte_count", "attempts", "detail", "claimed_at", F.lit(now).cast("long").alias("completed_at"))
    return upsert(ledger, rows, KEYS)


def reset_stale(ledger: DataFrame, source: str) -> tuple[DataFrame, DataFrame]:
    """(claims of a source that never settled, the ledger without them)."""
    stuck = (F.col("status") == "in_progress") & (F.col("source") == source)
    return ledger.where(stuck), ledger.where(~F.coalesce(stuck, F.lit(False)))


def summary(ledger: DataFrame) -> DataFrame:
    counts = [F.count_if(F.col("status") == s).alias(f"n_{s}") for s in ("ok", "empty", "missing", "error", "in_progress")]
    return ledger.groupBy("instrument").agg(*counts, F.coalesce(F.sum("tick_count"), F.lit(0)).alias("ticks"))


def monthly(ledger: DataFrame) -> DataFrame:
    month = F.date_format(day_of("hour"), "yyyy-MM").alias("month")
    return ledger.groupBy("instrument", month).agg(F.count("*").alias("hours"), F.count_if(F.col("status").isin(*SETTLED)).alias("settled"), F.coalesce(F.sum("tick_count"), F.lit(0)).alias("ticks"))


def rows_by_instrument(ticks: DataFrame) -> DataFrame:
    return ticks.groupBy("instrument").agg(F.count("*").alias("ticks"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count_if(F.col("bid") > F.col("ask")).alias("crossed"), F.round(F.avg(F.col("ask") - F.col("bid")), 7).alias("mean_spread"))


def rows_by_hour(ticks: DataFrame) -> DataFrame:
    return ticks.groupBy("instrument", "source", floor_to("ts", HOUR).alias("hour")).agg(F.count("*").alias("ticks"))


def count_hour(ticks: DataFrame, instrument: str, hour: int, source: str) -> DataFrame:
    """One row: the number of quotes of one instrument's hour from one source."""
    return ticks.where((F.col("instrument") == instrument) & (F.col("source") == source) & (F.col("ts") >= hour) & (F.col("ts") < hour + HOUR)).agg(F.count("*").alias("ticks"))


def total_rows(ticks: DataFrame) -> DataFrame:
    return ticks.agg(F.count("*").alias("ticks"))
