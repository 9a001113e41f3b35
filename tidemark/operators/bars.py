"""Bars with bid and ask kept apart, and feeds too."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import MINUTE, floor_to

SIDES = ("bid", "ask")


def bars_from_ticks(ticks: DataFrame, length: int = MINUTE) -> DataFrame:
    """Open, high, low and close of bid and ask and the number of ticks of each (instrument, source, minute)."""
    order = F.struct("ts", "seq")
    cells = []
    for side in SIDES:
        cells += [F.min_by(side, order).alias(f"{side}_open"), F.max(side).alias(f"{side}_high"), F.min(side).alias(f"{side}_low"), F.max_by(side, order).alias(f"{side}_close")]
    return ticks.groupBy("instrument", "source", floor_to("ts", length).alias("minute")).agg(*cells, F.count("*").alias("tick_count"))


def partial_bars(ticks: DataFrame, length: int = MINUTE) -> DataFrame:
    """Bars that can be merged with others of the same minute: opens and closes keep the place they come from."""
    order = F.struct("ts", "seq")
    cells = []
    for side in SIDES:
        held = F.struct("ts", "seq", side)
        cells += [F.min_by(held, order).alias(f"{side}_open"), F.max(side).alias(f"{side}_high"), F.min(side).alias(f"{side}_low"), F.max_by(held, order).alias(f"{side}_close")]
    return ticks.groupBy("instrument", "source", floor_to("ts", length).alias("minute")).agg(*cells, F.count("*").alias("tick_count"))


def combine_partials(parts: DataFrame) -> DataFrame:
    """One partial bar for each minute of many, which can be merged with more."""
    cells = []
    for side in SIDES:
        opens, closes = f"{side}_open", f"{side}_close"
        cells += [F.min(opens).alias(opens), F.max(f"{side}_high").alias(f"{side}_high"), F.min(f"{side}_low").alias(f"{side}_low"), F.max(closes).alias(closes)]
    return parts.groupBy("instrument", "source", "minute").agg(*cells, F.sum("tick_count").alias("tick_count"))


def merge_partials(parts: DataFrame) -> DataFrame:
    cells = []
    for side in SIDES:
        opens, closes = f"{side}_open", f"{side}_close"
        cells += [F.min_by(f"{opens}.{side}", opens).alias(opens), F.max(f"{side}_high").alias(f"{side}_high"), F.min(f"{side}_low").alias(f"{side}_low"), F.max_by(f"{closes}.{side}", closes).alias(closes)]
    return parts.groupBy("instrument", "source", "minute").agg(*cells, F.sum("tick_count").alias("tick_count"))


def coverage(bars: DataFrame) -> DataFrame:
    return bars.groupBy("instrument", "source").agg(F.count("*").alias("bars"), F.sum("tick_count").alias("ticks"), F.min("minute").alias("first_minute"), F.max("minute").alias("last_minute"))


def sample(bars: DataFrame, instrument: str, limit: int = 12) -> DataFrame:
    """The first bars of an instrument, with the spread of their closes."""
    return bars.where(F.col("instrument") == instrument).withColumn("close_spread", F.round(F.col("ask_close") - F.col("bid_close"), 7)).orderBy("minute", "source").limit(limit)


def reconcile_all(bars: DataFrame, ticks: DataFrame) -> DataFrame:
    """One row: all ticks stored, all ticks in bars and whether they agree; two one-row aggregates side by side."""
    held = bars.agg(F.coalesce(F.sum("tick_count"), F.lit(0)).alias("ticks_in_bars"))
    return ticks.agg(F.count("*").alias("ticks")).join(held).withColumn("agree", F.col("ticks") == F.col("ticks_in_bars"))


def reconcile(bars: DataFrame, ticks: DataFrame) -> DataFrame:
    """Of each instrument the ticks stored and the ticks in bars."""
    held = bars.groupBy("instrument").agg(F.sum("tick_count").alias("in_bars"))
    return ticks.groupBy("instrument").agg(F.count("*").alias("stored")).join(held, "instrument", "left").withColumn("missing", F.col("stored") - F.coalesce("in_bars", F.lit(0)))


def cross_feed(bars: DataFrame, first: str, second: str, tolerance: float) -> DataFrame:
    """Every bar of either feed: agree, disagree (a close differs by more than the tolerance) or gap (one feed has none)."""
    sides = [bars.where(F.col("source") == s).select("instrument", "minute", F.col("bid_close").alias(f"{n}_bid"), F.col("ask_close").alias(f"{n}_ask")) for s, n in ((first, "a"), (second, "b"))]
    both = sides[0].join(sides[1], ["instrument", "minute"], "full")
    differs = (F.abs(F.col("a_bid") - F.col("b_bid")) > tolerance) | (F.abs(F.col("a_ask") - F.col("b_ask")) > tolerance)
    return both.withColumn("verdict", F.when(F.col("a_bid").isNull() | F.col("b_bid").isNull(), "gap").when(differs, "disagree").otherwise("agree"))
