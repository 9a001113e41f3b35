"""Trading sessions, the market's week, the rollover hour and what an instant falls into, from time-zone rules."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import DAY, HOUR, day_of, days_between, local_instant

#: Sessions with their zones and local hours; pairs with their currencies; the country whose holidays a currency has.
SESSIONS = (("sydney", "Australia/Sydney", 7, 16), ("tokyo", "Asia/Tokyo", 9, 18), ("london", "Europe/London", 8, 17), ("new_york", "America/New_York", 8, 17))
PAIR_LEGS = {"EURUSD": ("EUR", "USD"), "GBPUSD": ("GBP", "USD"), "USDJPY": ("USD", "JPY"), "USDCHF": ("USD", "CHF"), "AUDUSD": ("AUD", "USD"), "USDCAD": ("USD", "CAD"), "NZDUSD": ("NZD", "USD"), "EURJPY": ("EUR", "JPY"), "GBPJPY": ("GBP", "JPY")}
CURRENCY_COUNTRY = {"USD": "US", "EUR": "DE", "GBP": "GB", "JPY": "JP", "CHF": "CH", "AUD": "AU", "CAD": "CA", "NZD": "NZ"}


def session_windows(spark: SparkSession, start: date, end: date) -> DataFrame:
    """Every session of every calendar day from start until before end; weekends too."""
    days, out = days_between(spark, start, end), None
    for name, zone, opens, closes in SESSIONS:
        rows = days.select(F.lit(name).alias("session"), "day", local_instant("day", opens, zone).alias("span_start"), local_instant("day", closes, zone).alias("span_end"))
        out = rows if out is None else out.unionByName(rows)
    return out.where("span_end > span_start")


def market_windows(spark: SparkSession, start: date, end: date) -> DataFrame:
    """Weeks from Sunday 17:00 to Friday 17:00 New York that overlap [start, end) in UTC."""
    days = days_between(spark, start - timedelta(days=7), end).where("weekday(day) = 6").withColumn("friday", F.date_add("day", 5))
    rows = days.select(local_instant("day", 17, "America/New_York").alias("span_start"), local_instant("friday", 17, "America/New_York").alias("span_end"))
    low, high = ((d - date(1970, 1, 1)).days * DAY for d in (start, end))
    return rows.where((F.col("span_start") < high) & (F.col("span_end") > low))


def rollover_windows(spark: SparkSession, start: date, end: date) -> DataFrame:
    days = days_between(spark, start, end).where("weekday(day) < 5")
    return days.select("day", local_instant("day", 17, "America/New_York").alias("span_start"), local_instant("day", 18, "America/New_York").alias("span_end"))


def london_ny_overlap(spark: SparkSession, start: date, end: date) -> DataFrame:
    """Of each day the hours that London and New York are both open."""
    instants = [local_instant("day", h, z) for h, z in ((8, "Europe/London"), (8, "America/New_York"), (17, "Europe/London"), (17, "America/New_York"))]
    opens, closes = F.greatest(*instants[:2]), F.least(*instants[2:])
    return days_between(spark, start, end).select("day", opens.alias("span_start"), closes.alias("span_end"), (F.greatest(F.lit(0), closes - opens) / HOUR).alias("hours"))


def dst_offset_weeks(spark: SparkSession, year: int) -> DataFrame:
    """Runs of weekdays on which the overlap isn't the year's usual one: their ends, number of days, hours and the difference."""
    days = london_ny_overlap(spark, date(year, 1, 1), date(year + 1, 1, 1)).where("weekday(day) < 5")
    # a year's weekdays are at most 262 rows
    usual = days.groupBy("hours").agg(F.count("*").alias("n"), F.min("day").alias("d")).agg(F.max_by("hours", F.struct("n", F.datediff(F.lit(date(2400, 1, 1)), "d"))).alias("usual"))
    rows = days.withColumn("k", F.row_number().over(Window.orderBy("day"))).join(usual).where("hours <> usual")
    rows = rows.withColumn("island", F.col("k") - F.row_number().over(Window.orderBy("day")))
    runs = rows.groupBy("island").agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.count("*").alias("days"), F.min_by("hours", "day").alias("hours"), F.first("usual").alias("usual"))
    return runs.select("first_day", "last_day", "days", "hours", (F.col("hours") - F.col("usual")).alias("difference"))


def calendar_hours(spark: SparkSession, start: date, end: date) -> DataFrame:
    """Every hour from the first market open to the last close in the range, with whether the market is open and whether it is a rollover hour."""
    markets, rolls = market_windows(spark, start, end), rollover_windows(spark, start - timedelta(days=7), end + timedelta(days=7))
    bounds = markets.agg(F.min("span_start").alias("a"), F.max("span_end").alias("b"))
    hours = bounds.select(F.explode(F.expr(f"sequence(a - pmod(a, {HOUR}), b, {HOUR}L)")).alias("hour"))
    open_ = markets.select(F.explode(F.expr(f"sequence(span_start, span_end - {HOUR}, {HOUR}L)")).alias("hour"), F.lit(True).alias("o"))
    roll = rolls.select(F.col("span_start").alias("hour"), F.lit(True).alias("r"))
    return hours.join(open_, "hour", "left").join(roll, "hour", "left").select("hour", F.coalesce("o", F.lit(False)).alias("market_open"), F.coalesce("r", F.lit(False)).alias("rollover"))


def pair_legs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(p, c) for p, legs in PAIR_LEGS.items() for c in legs], "instrument string, currency string")


def currency_countries(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(CURRENCY_COUNTRY.items()), "currency string, country string")


def describe(instants: DataFrame, sessions: DataFrame, markets: DataFrame, rollovers: DataFrame) -> DataFrame:
    """Of each instant (ts): its open sessions, whether more than one is, the market and rollover. Windows are cut to hours, so all joins are by equality."""
    per_hour = lambda w, *c: w.select(*c, F.explode(F.expr(f"sequence(span_start - pmod(span_start, {HOUR}), span_end - 1, {HOUR}L)")).alias("hr"), "span_start", "span_end")
    base = instants.select("ts").distinct().withColumn("hr", F.expr(f"ts - pmod(ts, {HOUR})"))
    held = (F.col("ts") >= F.col("span_start")) & (F.col("ts") < F.col("span_end"))
    named = base.join(per_hour(sessions, "session"), "hr").where(held).groupBy("ts").agg(F.array_sort(F.collect_set("session")).alias("s"))
    market = base.join(per_hour(markets), "hr").where(held).select("ts", F.lit(True).alias("m")).distinct()
    roll = base.join(per_hour(rollovers), "hr").where(held).select("ts", F.lit(True).alias("r")).distinct()
    rows = base.join(named, "ts", "left").join(market, "ts", "left").join(roll, "ts", "left")
    return rows.select("ts", F.coalesce(F.array_join("s", ","), F.lit("")).alias("sessions"), F.coalesce(F.size("s") > 1, F.lit(False)).alias("in_overlap"), F.coalesce("m", F.lit(False)).alias("market_open"), F.coalesce("r", F.lit(False)).alias("is_rollover"))


def holidays_of(instants: DataFrame, legs: DataFrame, holidays: DataFrame) -> DataFrame:
    """instants (with instrument and ts) with the currencies of the instrument's legs that have a holiday on the UTC date, joined by commas; empty if none.

    legs (instrument, currency) meet holidays (currency, holiday_date) first, so each instant finds one row at most and instants are joined once.
    """
    closed = legs.join(holidays, "currency").groupBy("instrument", "holiday_date").agg(F.array_join(F.array_sort(F.collect_set("currency")), ",").alias("closed"))
    rows = instants.withColumn("holiday_date", day_of("ts")).join(closed, ["instrument", "holiday_date"], "left")
    return rows.select(*instants.columns, F.coalesce("closed", F.lit("")).alias("holidays"))


def holidays_by_currency(holidays: DataFrame) -> DataFrame:
    return holidays.groupBy("currency").agg(F.countDistinct("holiday_date").alias("holidays"), F.min("holiday_date").alias("first_day"), F.max("holiday_date").alias("last_day"))


def overlapping(windows: DataFrame, keys: list[str]) -> DataFrame:
    """Windows that begin before any of those before them, by keys, has ended: none in a proper table."""
    by = Window.partitionBy(*keys).orderBy("span_start", "span_end").rowsBetween(Window.unboundedPreceding, -1)
    return windows.withColumn("before", F.max("span_end").over(by)).where("before > span_start")


def rebuilt(stored: DataFrame, fresh: DataFrame, start: int, end: int) -> DataFrame:
    """stored windows with all that overlap [start, end) replaced by the fresh ones."""
    return stored.where((F.col("span_end") <= start) | (F.col("span_start") >= end)).unionByName(fresh.select(*stored.columns))
