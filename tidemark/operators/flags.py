"""Detectors of suspect quotes. Each takes quotes and gives (instrument, ts, seq, flag, detail); nothing is removed from the quotes."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import DAY, HOUR, MINUTE, day_of, floor_to, quantile_by_rank
from ..sources import tables
from .asof import backward_by_day

STALE_RUN, OUTLIER_MULTIPLE, GAP_MINUTES, FEED_TOLERANCE = 4, 5.0, 120, 0.00005


@dataclass(frozen=True)
class Detector:
    name: str
    description: str
    find: Callable[..., DataFrame]
    calendar: bool = False


def _flag(rows: DataFrame, name: str, detail: str) -> DataFrame:
    """detail: an expression that tells what was found."""
    return rows.select("instrument", "ts", "seq", F.lit(name).alias("flag"), F.expr(detail).alias("detail"))


def crossed(ticks: DataFrame) -> DataFrame:
    return _flag(ticks.where("bid > ask"), "crossed", "format_string('bid=%.5f ask=%.5f spread=%.5f', bid, ask, ask - bid)")


def zero_spread(ticks: DataFrame) -> DataFrame:
    return _flag(ticks.where("bid = ask"), "zero_spread", "format_string('price=%.5f', bid)")


def stale_runs(ticks: DataFrame) -> DataFrame:
    """ticks with run: the number of quotes so far in the run of equal (bid, ask) that each ends, by instrument in order of (ts, seq).

    Windows span one day of an instrument; what a run brings over from the days before comes from a table with a row for each day.
    """
    rows = backward_by_day(ticks, ["instrument"], ["ts", "seq"], ["bid", "ask"])
    same = F.coalesce((F.col("bid") == F.col("prev_bid")) & (F.col("ask") == F.col("prev_ask")), F.lit(False))
    within = Window.partitionBy("instrument", "__day").orderBy("ts", "seq")
    rows = rows.withColumn("__same", same).withColumn("__island", F.sum(F.when(F.col("__same"), 0).otherwise(1)).over(within.rowsBetween(Window.unboundedPreceding, 0)))
    island = Window.partitionBy("instrument", "__day", "__island").orderBy("ts", "seq")
    rows = rows.withColumn("__run", F.row_number().over(island))
    days = rows.groupBy("instrument", "__day").agg(F.max_by(F.struct("__run", "__island"), F.struct("ts", "seq")).alias("e"))
    by_day = Window.partitionBy("instrument").orderBy("__day")
    # island 0 is what goes on from the day before; a day that is island 0 throughout hands the run on
    chain = F.sum(F.when(F.col("e.__island") == 0, 0).otherwise(1)).over(by_day)
    days = days.select("instrument", "__day", F.col("e.__run").alias("tail"), chain.alias("chain"))
    so_far = F.sum("tail").over(Window.partitionBy("instrument", "chain").orderBy("__day"))
    carry = days.withColumn("sum", so_far).select("instrument", "__day", F.lag("sum").over(by_day).alias("__carry"))
    rows = rows.join(carry, ["instrument", "__day"], "left")
    run = F.col("__run") + F.when(F.col("__island") == 0, F.coalesce("__carry", F.lit(0))).otherwise(0)
    return rows.withColumn("run", run).select(*ticks.columns, "run")


def stale(ticks: DataFrame, length: int = STALE_RUN) -> DataFrame:
    return _flag(stale_runs(ticks).where(F.col("run") >= length), "stale", "format_string('bid=%.5f ask=%.5f repeat_index=%d', bid, ask, run)")


def spread_outlier(ticks: DataFrame, multiple: float = OUTLIER_MULTIPLE) -> DataFrame:
    """Spreads over a multiple of the exact median of their instrument's hour; the median is of uncrossed quotes and positive."""
    rows = ticks.where("ask >= bid").withColumn("hr", floor_to("ts", HOUR))
    hourly = quantile_by_rank(rows, ["instrument", "hr"], F.expr("ask - bid"), 0.5, "median").where("median > 0")
    met = ticks.withColumn("hr", floor_to("ts", HOUR)).join(hourly, ["instrument", "hr"])
    return _flag(met.where(F.expr("ask - bid") > multiple * F.col("median")), "spread_outlier", "format_string('spread=%.5f median=%.5f ratio=%.2f', ask - bid, median, (ask - bid) / median)")


def session_gap(ticks: DataFrame, minutes: int = GAP_MINUTES) -> DataFrame:
    rows = backward_by_day(ticks, ["instrument"], ["ts", "seq"], ["ts"])
    return _flag(rows.where(F.expr(f"(ts - prev_ts) >= {minutes * MINUTE}")), "session_gap", f"format_string('minutes=%d previous=%d', (ts - prev_ts) div {MINUTE}, prev_ts)")


def rollover_window(ticks: DataFrame, hours: DataFrame) -> DataFrame:
    marked = hours.where("rollover").select(F.col("hour").alias("hr"))
    return _flag(ticks.withColumn("hr", floor_to("ts", HOUR)).join(marked, "hr"), "rollover_window", f"format_string('rollover_hour_utc=%d', pmod(hr, {DAY}) div {HOUR})")


def weekend_gap(ticks: DataFrame, hours: DataFrame) -> DataFrame:
    closed = hours.where("NOT market_open").select(F.col("hour").alias("hr"))
    return _flag(ticks.withColumn("hr", floor_to("ts", HOUR)).join(closed, "hr"), "weekend_gap", f"format_string('market_closed weekday=%d', pmod(ts div {DAY} + 3, 7) + 1)")


def holiday_thin(ticks: DataFrame, legs: DataFrame, holidays: DataFrame) -> DataFrame:
    """One row for each leg whose currency has a holiday on the quote's UTC date. legs and holidays are small by nature: pairs, and days of a year."""
    return _flag(ticks.withColumn("holiday_date", day_of("ts")).join(F.broadcast(legs), "instrument").join(F.broadcast(holidays), ["currency", "holiday_date"]), "holiday_thin", "concat(currency, ': ', cast(holiday_date AS string))")


DETECTORS = [
    Detector("crossed", "bid above ask", crossed),
    Detector("zero_spread", "bid equals ask", zero_spread),
    Detector("stale", "the fourth and later quote of a run of equal ones", stale),
    Detector("spread_outlier", "spread over five times the hour's median", spread_outlier),
    Detector("session_gap", "first quote after two hours of silence", session_gap),
    Detector("rollover_window", "in the hour after 17:00 New York", rollover_window, True),
    Detector("weekend_gap", "while the market is closed", weekend_gap, True),
    Detector("holiday_thin", "on a holiday of either currency", holiday_thin, True),
]


def _scope(instruments: list[str] | None, start: int | None, end: int | None) -> Column:
    inside = F.lit(True) if instruments is None else F.col("instrument").isin(instruments)
    inside = inside if start is None else inside & (F.col("ts") >= start)
    return inside if end is None else inside & (F.col("ts") < end)


def _found(d: Detector, ticks: DataFrame, hours: DataFrame, legs: DataFrame, holidays: DataFrame) -> DataFrame:
    return d.find(ticks, legs, holidays) if d.name == "holiday_thin" else d.find(ticks, hours) if d.calendar else d.find(ticks)


def scan(ticks: DataFrame, hours: DataFrame, legs: DataFrame, holidays: DataFrame, only: list[str] | None = None, instruments: list[str] | None = None, start: int | None = None, end: int | None = None) -> DataFrame:
    """All detectors' flags in one frame, of these instruments and of [start, end) if given; quotes before start still tell runs and gaps."""
    ticks, found = ticks.where(_scope(instruments, None, end)), None
    for d in DETECTORS:
        if only is None or d.name in only:
            rows = _found(d, ticks, hours, legs, holidays)
            found = rows if found is None else found.unionByName(rows)
    return found.where(_scope(instruments, start, end))


@dataclass
class ScanReport:
    """What a scan of stored quotes did: flags written by detector, taken from the write's own pass, flags of the same scope that they replaced, errors by detector."""

    written: dict[str, int] = field(default_factory=dict)
    deleted: dict[str, int] = field(default_factory=dict)
    errors: dict[str, str] = field(default_factory=dict)

    @property
    def total(self) -> int:
        return sum(self.written.values())


def rescan(spark: SparkSession, folder: str, hours: DataFrame | None, legs: DataFrame | None, holidays: DataFrame | None, instruments: list[str], start: int, end: int, only: list[str] | None = None) -> ScanReport:
    """Find the flags of stored quotes in the scope anew and store them: each detector replaces its own flags of the instruments in [start, end) and no others.

    A detector runs once, in the job that writes its flags, which counts them too. One that fails leaves its stored flags as they were and doesn't stop the
    rest. Quotes before start still tell runs and gaps.
    """
    report, scope = ScanReport(), _scope(instruments, start, end)
    # all months to the end: what runs into the scope may have begun long before
    ticks = tables.read(spark, folder, "tick_raw").where(_scope(instruments, None, end))
    for d in DETECTORS:
        if only is None or d.name in only:
            try:
                rows = _found(d, ticks, hours, legs, holidays).where(scope)
                before = tables.read(spark, folder, "tick_flag", start, end).where(scope & (F.col("flag") == d.name)).count()
                done = tables.replace(spark, folder, "tick_flag", rows, scope & (F.col("flag") == d.name), [(d.name, i) for i in instruments], start, end)
                report.written[d.name], report.deleted[d.name] = done.written, before
            except Exception as error:  # noqa: BLE001  whatever it is, it is told
                report.errors[d.name] = str(error)
    return report


def totals(flags: DataFrame, ticks: DataFrame) -> DataFrame:
    """Flags by instrument and kind, and their percentage of the instrument's quotes."""
    counts = ticks.groupBy("instrument").agg(F.count("*").alias("ticks"))
    per = flags.groupBy("instrument", "flag").agg(F.count("*").alias("flags")).join(counts, "instrument")
    return per.withColumn("pct", F.round(F.lit(100.0) * F.col("flags") / F.col("ticks"), 4))


def by_hour(flags: DataFrame) -> DataFrame:
    return flags.groupBy("flag", F.expr(f"cast(pmod(ts, {DAY}) div {HOUR} AS int)").alias("hour_of_day")).agg(F.count("*").alias("flags"))


def flagged_share(flags: DataFrame, ticks: DataFrame) -> DataFrame:
    """Distinct flagged (instrument, ts) against all quotes; two one-row aggregates side by side. Of no quotes the share is null."""
    marked = flags.select("instrument", "ts").distinct().agg(F.count("*").alias("flagged"))
    return marked.join(ticks.agg(F.count("*").alias("ticks"))).withColumn("share", F.round(F.try_divide("flagged", "ticks"), 6))


def explain_day(flags: DataFrame, ticks: DataFrame, instrument: str, start: int) -> DataFrame:
    """One row for each flagged instant of a day: its kinds and their details, place by place, and the lowest bid and ask quoted then."""
    marked = flags.where((F.col("instrument") == instrument) & (F.col("ts") >= start) & (F.col("ts") < start + DAY)).groupBy("ts").agg(F.array_sort(F.collect_set(F.struct("flag", "detail"))).alias("f")).select("ts", F.col("f.flag").alias("flags"), F.col("f.detail").alias("details"))
    quotes = ticks.where((F.col("instrument") == instrument) & (F.col("ts") >= start) & (F.col("ts") < start + DAY)).groupBy("ts").agg(F.min("bid").alias("bid"), F.min("ask").alias("ask"))
    return marked.join(quotes, "ts", "left")
