"""Stored quotes, bars, flags and calendars: hours are appended whole, hours of a failed fetch taken back, ranges of bars and windows made anew, and a session reads no more than its scope."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import DAY, HOUR, MINUTE, floor_to
from ..operators.bars import bars_from_ticks
from ..operators.macro import upsert
from . import tables
from .schemas import SCHEMAS

MACRO, QUOTES = ("macro_series", "macro_observation", "macro_release"), {"tick_raw": "ts", "bar_1m": "minute"}


def append_hours(ticks: DataFrame, folder: str) -> None:
    """Add quotes to tick_raw in the folder, unchanged: neither sorted nor filtered, repeats and all. A job that fails adds none."""
    tables.append(ticks, folder, "tick_raw")


def without_hours(ticks: DataFrame, hours: DataFrame) -> DataFrame:
    """ticks of which no (instrument, source, hour) is among these hours, as a frame; take_back does it to the stored table."""
    keys = ["instrument", "source", "__hour"]
    return ticks.withColumn("__hour", floor_to("ts", HOUR)).join(hours.select("instrument", "source", F.col("hour").alias("__hour")), keys, "left_anti").select(*ticks.columns)


def take_back(spark: SparkSession, folder: str, hours: DataFrame) -> int:
    """Remove the stored quotes of these (instrument, source, hour): of claims that never settled. Gives how many partitions were swapped.

    One replacement for each instrument, over the months of its hours; these are few, as claims that never settled are those of runs that died.
    """
    swapped = 0
    spans = hours.groupBy("instrument").agg(F.min("hour").alias("first"), F.max("hour").alias("last")).collect()
    for span in spans:
        start, end = span.first, span.last + HOUR
        here = tables.read(spark, folder, "tick_raw", start, end).where(F.col("instrument") == span.instrument)
        kept = without_hours(here, hours)
        # all rows of the partitions are dropped, and the kept ones written as new
        swapped += tables.replace(spark, folder, "tick_raw", kept, F.lit(True), [(span.instrument,)], start, end).partitions
    return swapped


def backfill_bars(bars: DataFrame, ticks: DataFrame, instruments: list[str], start: int, end: int) -> DataFrame:
    """bars with those of the instruments whose minute is in [start, end) made anew from ticks; a second time changes nothing. Both ends are whole minutes."""
    inside = _bars_inside(instruments, start, end)
    return bars.where(~inside("minute")).unionByName(bars_from_ticks(ticks.where(inside("ts"))).select(*bars.columns))


def _bars_inside(instruments: list[str], start: int, end: int):
    if start % MINUTE or end % MINUTE:
        raise ValueError("a range of bars begins and ends at whole minutes")
    return lambda at: F.col("instrument").isin(instruments) & (F.col(at) >= start) & (F.col(at) < end)


def store_bars(spark: SparkSession, folder: str, ticks: DataFrame, instruments: list[str], start: int, end: int) -> tables.Replaced:
    """backfill_bars in the stored table bar_1m: bars of the range are replaced by those of the quotes, others keep their rows, and other partitions their files."""
    inside = _bars_inside(instruments, start, end)
    return tables.replace(spark, folder, "bar_1m", bars_from_ticks(ticks.where(inside("ts"))), inside("minute"), [(i,) for i in instruments], start, end)


def store_windows(spark: SparkSession, folder: str, name: str, fresh: DataFrame, start: int, end: int, longest: int) -> tables.Replaced:
    """Replace the stored windows that overlap [start, end) by the fresh ones, which all overlap it. `longest` bounds how long before start a window that overlaps may begin."""
    overlap = (F.col("span_end") > start) & (F.col("span_start") < end)
    return tables.replace(spark, folder, name, fresh.where(overlap), overlap, [()], start - longest, end)


def upsert_stored(spark: SparkSession, folder: str, name: str, incoming: DataFrame, keys: list[str]) -> tables.Replaced:
    """macro.upsert into a stored table that is laid out by dates: of equal keys the incoming row stays. Only months from the first incoming date to the last, and only partitions that incoming rows are in, are read and swapped."""
    at, by = tables.LAYOUT[name]
    ends = incoming.agg(F.min(F.unix_date(at)).alias("first"), F.max(F.unix_date(at)).alias("last")).first()
    if ends.first is None:
        return tables.Replaced(0, 0, 0)
    start, end = ends.first * DAY, (ends.last + 1) * DAY
    # instruments, or nothing: few
    values = [tuple(r) for r in incoming.select(*by).distinct().collect()] if by else [()]
    held = tables.read(spark, folder, name, start, end)
    for k, column in enumerate(by):
        held = held.where(F.col(column).isin(sorted({v[k] for v in values})))
    return tables.replace(spark, folder, name, upsert(held, tables.shaped(incoming, name), keys), F.lit(True), values, start, end)


def scoped(relations: dict[str, DataFrame], series: list[str] | None = None, instruments: list[str] | None = None, start: int | None = None, end: int | None = None) -> dict[str, DataFrame]:
    """The relations of one session. Macro relations are whole unless series are named; quotes and bars have no rows unless instruments and both ends of [start, end) are given."""
    out, bounded = dict(relations), bool(instruments) and start is not None and end is not None
    for name in MACRO:
        if series is not None and name in out:
            out[name] = out[name].where(F.col("series_id").isin(series))
    for name, at in QUOTES.items():
        if name in out:
            out[name] = out[name].where(F.col("instrument").isin(instruments) & (F.col(at) >= start) & (F.col(at) < end)) if bounded else out[name].limit(0)
    return out


def open_session(spark: SparkSession, folder: str, series: list[str] | None = None, instruments: list[str] | None = None, start: int | None = None, end: int | None = None) -> dict[str, DataFrame]:
    """scoped over the stored tables of a folder; one that was never written is empty, not missing. Of quotes and bars only the partitions of the instruments and months in scope are opened."""
    found = {name: tables.read(spark, folder, name, *((start, end) if name in QUOTES else ())) for name in SCHEMAS}
    return scoped(found, series, instruments, start, end)


def kept_releases(spark: SparkSession, path: str, built: DataFrame, start: int, end: int, refresh: bool = False) -> DataFrame:
    """Releases of [start, end) by released_at, read from the path; built and written there only if nothing is there yet or a refresh is asked for."""
    held = None
    if not refresh:
        try:
            held = spark.read.parquet(path)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
    if held is None:
        built.write.mode("overwrite").parquet(path)
        held = spark.read.parquet(path)
    return held.where((F.col("released_at") >= start) & (F.col("released_at") < end)).orderBy("released_at", "series_id")


def file_digests(files: DataFrame, digits: int = 16) -> DataFrame:
    """(name, digest) from (name, content): the first hex digits of each content's SHA-256, by which a result tells what rules it was made under; MISSING without content."""
    return files.select("name", F.coalesce(F.substring(F.sha2("content", 256), 1, digits), F.lit("MISSING")).alias("digest"))
