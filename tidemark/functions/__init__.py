"""Column helpers. An instant is a long: microseconds since 1970-01-01 in UTC, so no session's time zone can shift it."""

from __future__ import annotations

from datetime import date, datetime, timezone

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SECOND = 1_000_000
MINUTE, HOUR, DAY = 60 * SECOND, 3600 * SECOND, 86400 * SECOND
EPOCH = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def instant(t: datetime) -> int:
    """The instant of an aware datetime. A date or a naive datetime doesn't name one."""
    if not isinstance(t, datetime):
        raise TypeError(f"an instant is a datetime with a time zone, not {type(t).__name__}")
    if t.tzinfo is None:
        raise TypeError("a datetime without a time zone doesn't name an instant")
    delta = t.astimezone(timezone.utc) - datetime(1970, 1, 1, tzinfo=timezone.utc)
    return (delta.days * 86400 + delta.seconds) * SECOND + delta.microseconds


def micros(column: str) -> Column:
    """The instant of a column of timestamps without zone that are meant in UTC."""
    return F.expr(f"timestampdiff(MICROSECOND, {EPOCH}, cast({column} AS timestamp_ntz))")


def floor_to(column: Column | str, unit: int) -> Column:
    column = F.col(column) if isinstance(column, str) else column
    return column - F.pmod(column, F.lit(unit))


def day_of(column: str) -> Column:
    return F.expr(f"date_from_unix_date(cast(({column} - pmod({column}, {DAY})) div {DAY} AS int))")


def local_instant(day: str, hour: int, zone: str, minute: int = 0) -> Column:
    """The instant at which clocks of the zone show this time on the day; in a gap or fold, as the zone's rules say first."""
    wall = f"cast({day} AS timestamp_ntz) + make_dt_interval(0, {hour}, {minute}, 0)"
    return F.expr(f"timestampdiff(MICROSECOND, {EPOCH}, convert_timezone('{zone}', 'UTC', {wall}))")


def exact_quantile(column: Column | str, q: float) -> Column:
    """The element at index floor(q * n) of the sorted values, without interpolation; of a bounded group such as an hour."""
    values = F.sort_array(F.collect_list(column))
    return F.element_at(values, F.least(F.size(values), F.floor(F.lit(q) * F.size(values)).cast("int") + 1))


def quantile_by_rank(rows: DataFrame, by: list[str], value: Column, q: float, name: str) -> DataFrame:
    """exact_quantile of each group, found by rank over the counts of its distinct values, so that no group is held together."""
    counts = rows.groupBy(*by, value.alias("__value")).agg(F.count("*").alias("__n"))
    group = Window.partitionBy(*by)
    ranked = counts.withColumn("__upto", F.sum("__n").over(group.orderBy("__value"))).withColumn("__all", F.sum("__n").over(group))
    return ranked.where(F.col("__upto") > F.least(F.col("__all") - 1, F.floor(F.lit(q) * F.col("__all")))).groupBy(*by).agg(F.min("__value").alias(name))


def pip_size(pair: str) -> float:
    return 0.01 if pair.endswith("JPY") else 0.0001


def days_between(spark, start: date, end: date):
    """One row for each day from start until before end."""
    return spark.range((end - start).days).select(F.expr(f"date_add(DATE'{start}', cast(id AS int))").alias("day"))
