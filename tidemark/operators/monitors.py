"""Monitors: drift against an independent fix, spreads and tick rates by hour of the day."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import DAY, HOUR, MINUTE, exact_quantile, floor_to
from .asof import clean

#: Pairs that a reference rate in euros names directly, with the rate's currency.
DIRECT_ANCHORS = {"EURUSD": "USD"}
HOUR_OF_DAY = f"cast(pmod(ts, {DAY}) div {HOUR} AS int)"


def drift_anchor(fixes: DataFrame, ticks: DataFrame, pip: float, half_window: int = MINUTE, alert: float = 2.0, digits: int = 4) -> DataFrame:
    """Of each fix (instrument, fix_at, rate): the mean mid of clean quotes within the window, both ends in, and its difference in pips.

    Fixes and quotes meet on buckets as wide as half the window; a fix looks into three of them.
    """
    wide = fixes.select("*", F.explode(F.expr(f"sequence(fix_at div {half_window} - 1, fix_at div {half_window} + 1)")).alias("bucket"))
    side = clean(ticks).select("instrument", F.expr(f"ts div {half_window}").alias("bucket"), "ts", F.expr("(bid + ask) / 2").alias("mid"))
    met = wide.join(side, ["instrument", "bucket"]).where(F.col("ts").between(F.col("fix_at") - half_window, F.col("fix_at") + half_window))
    rows = met.groupBy("instrument", "fix_at", "rate").agg(F.avg("mid").alias("mean_mid"), F.count("*").alias("ticks"))
    return rows.withColumn("diff_pips", F.round((F.col("mean_mid") - F.col("rate")) / pip, digits)).withColumn("alert", F.abs("diff_pips") > alert)


def anchor_currency(instrument: str) -> str:
    """The currency whose reference rate a pair compares with one to one; of other pairs a cross would have the errors of both legs."""
    if instrument not in DIRECT_ANCHORS:
        raise ValueError(f"{instrument} has no reference rate of its own")
    return DIRECT_ANCHORS[instrument]


def drift_summary(fixes: DataFrame, observed: DataFrame) -> DataFrame:
    """One row: fixes compared, fixes without quotes, alerts, the mean and the greatest absolute difference in pips. observed comes from drift_anchor."""
    asked = fixes.agg(F.count("*").alias("fixes"))
    said = observed.agg(F.count("*").alias("compared"), F.count_if("alert").alias("alerts"), F.round(F.avg("diff_pips"), 4).alias("mean_pips"), F.round(F.max(F.abs("diff_pips")), 4).alias("max_abs_pips"))
    return asked.join(said).select("compared", (F.col("fixes") - F.col("compared")).alias("skipped_no_ticks"), "alerts", "mean_pips", "max_abs_pips")


def latest_drift(observed: DataFrame, limit: int = 60) -> DataFrame:
    return observed.orderBy(F.col("fix_at").desc(), "instrument").limit(limit)


def spread_by_hour(ticks: DataFrame) -> DataFrame:
    """Exact median and 95th percentile need an hour of day's spreads together, so they are found by rank over counts of distinct spreads."""
    spreads = clean(ticks).select("instrument", F.expr(HOUR_OF_DAY).alias("hour_of_day"), F.expr("ask - bid").alias("spread"))
    counts = spreads.groupBy("instrument", "hour_of_day", "spread").agg(F.count("*").alias("n"))
    by = Window.partitionBy("instrument", "hour_of_day")
    ranked = counts.withColumn("upto", F.sum("n").over(by.orderBy("spread"))).withColumn("total", F.sum("n").over(by))
    at = lambda q: F.min(F.when(F.col("upto") > F.least(F.col("total") - 1, F.floor(F.lit(q) * F.col("total"))), F.col("spread")))
    return ranked.groupBy("instrument", "hour_of_day").agg(F.sum("n").alias("ticks"), at(0.5).alias("median"), at(0.95).alias("p95"), F.max("spread").alias("widest"))


def tick_rate_by_hour(ticks: DataFrame) -> DataFrame:
    """Quotes of each hour against the instrument's median hour."""
    hourly = ticks.groupBy("instrument", floor_to("ts", HOUR).alias("hour")).agg(F.count("*").alias("ticks"))
    usual = hourly.groupBy("instrument").agg(exact_quantile("ticks", 0.5).alias("median"))
    return hourly.join(usual, "instrument").withColumn("ratio", F.round(F.col("ticks") / F.col("median"), 4))


def quietest_hours(ticks: DataFrame, limit: int = 40) -> DataFrame:
    """The hours with the fewest quotes against their instrument's median hour."""
    return tick_rate_by_hour(ticks).orderBy("ratio", "instrument", "hour").limit(limit)


def rate_totals(rates: DataFrame) -> DataFrame:
    return rates.agg(F.count("*").alias("rates"), F.count_distinct("currency").alias("currencies"), F.count_distinct("fix_date").alias("days"), F.min("fix_date").alias("first_date"), F.max("fix_date").alias("last_date"))


def rate_coverage(rates: DataFrame) -> DataFrame:
    return rates.groupBy("currency").agg(F.count("*").alias("days"), F.min("fix_date").alias("first_date"), F.max("fix_date").alias("last_date"))
