"""Public holidays from rules: fixed days, the nth weekday of a month, days from Easter, and days observed in place of those on a weekend."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RULE = "currency string, name string, month int, day int, weekday int, nth int, easter int, since int, moved string"
#: Nationwide holidays by law, of the country whose holidays a currency has. Of a rule with a weekday (0 is Monday) the nth one of the month counts, from its end if
#: negative; easter is days after Easter Sunday. moved: what is also observed if the day is a Saturday or a Sunday: the nearest weekday, the Monday after, or the day two later.
RULES = (
    ("USD", "New Year's Day", 1, 1, None, None, None, None, "nearest"),
    ("USD", "Birthday of Martin Luther King, Jr.", 1, None, 0, 3, None, 1986, None),
    ("USD", "Washington's Birthday", 2, None, 0, 3, None, 1971, None),
    ("USD", "Memorial Day", 5, None, 0, -1, None, 1971, None),
    ("USD", "Juneteenth", 6, 19, None, None, None, 2021, "nearest"),
    ("USD", "Independence Day", 7, 4, None, None, None, None, "nearest"),
    ("USD", "Labor Day", 9, None, 0, 1, None, None, None),
    ("USD", "Columbus Day", 10, None, 0, 2, None, 1971, None),
    ("USD", "Veterans Day", 11, 11, None, None, None, 1978, "nearest"),
    ("USD", "Thanksgiving Day", 11, None, 3, 4, None, 1942, None),
    ("USD", "Christmas Day", 12, 25, None, None, None, None, "nearest"),
    ("EUR", "New Year's Day", 1, 1, None, None, None, None, None),
    ("EUR", "Good Friday", None, None, None, None, -2, None, None),
    ("EUR", "Easter Monday", None, None, None, None, 1, None, None),
    ("EUR", "Labour Day", 5, 1, None, None, None, None, None),
    ("EUR", "Ascension Day", None, None, None, None, 39, None, None),
    ("EUR", "Whit Monday", None, None, None, None, 50, None, None),
    ("EUR", "German Unity Day", 10, 3, None, None, None, 1990, None),
    ("EUR", "Christmas Day", 12, 25, None, None, None, None, None),
    ("EUR", "Second Day of Christmas", 12, 26, None, None, None, None, None),
    ("GBP", "New Year's Day", 1, 1, None, None, None, 1974, "monday"),
    ("GBP", "Good Friday", None, None, None, None, -2, None, None),
    ("GBP", "Easter Monday", None, None, None, None, 1, None, None),
    ("GBP", "Early May bank holiday", 5, None, 0, 1, None, 1978, None),
    ("GBP", "Spring bank holiday", 5, None, 0, -1, None, 1971, None),
    ("GBP", "Summer bank holiday", 8, None, 0, -1, None, 1971, None),
    ("GBP", "Christmas Day", 12, 25, None, None, None, None, "later"),
    ("GBP", "Boxing Day", 12, 26, None, None, None, None, "later"),
    ("CHF", "New Year's Day", 1, 1, None, None, None, None, None),
    ("CHF", "Ascension Day", None, None, None, None, 39, None, None),
    ("CHF", "National Day", 8, 1, None, None, None, 1994, None),
    ("CHF", "Christmas Day", 12, 25, None, None, None, None, None),
)


def years_with_easter(spark: SparkSession, first: int, last: int) -> DataFrame:
    """(year, easter) of each year from first to last: Easter Sunday of the Gregorian calendar, from the golden number, the century's corrections and the Sunday after the full moon."""
    years = spark.range(first, last + 1).select(F.col("id").cast("int").alias("year")).withColumns({"golden": F.expr("year % 19"), "century": F.expr("year div 100"), "rest": F.expr("year % 100")})
    # days from 21 March to the full moon, with the leap days that centuries leave out and the moon's drift
    moon = F.expr("cast((19 * golden + century - century div 4 - (century - (century + 8) div 25 + 1) div 3 + 15) % 30 AS int)")
    sunday = F.expr("cast((32 + 2 * (century % 4) + 2 * (rest div 4) - moon - rest % 4) % 7 AS int)")
    late = F.expr("cast((golden + 11 * moon + 22 * sunday) div 451 AS int)")
    placed = years.withColumn("moon", moon).withColumn("sunday", sunday).withColumn("late", late)
    return placed.select("year", F.expr("date_add(make_date(year, 3, 22), moon + sunday - 7 * late)").alias("easter"))


def holidays_by_rule(spark: SparkSession, first: int, last: int, rules: Iterable[tuple] = RULES) -> DataFrame:
    """(currency, holiday_date, name) of the years from first to last, both in; a day observed in place of another has its name with "(observed)", and both are there.

    A currency without rules has none (JPY, AUD, CAD and NZD here); days set by a single year's decree aren't rules. Rows of both come from the caller. A day that a year
    doesn't have, such as 29 February, is none. An observed day counts with its own year, also when the day itself is the next year's.
    """
    # a few dozen rules, a row for each year
    named = spark.createDataFrame(list(rules), RULE).withColumnRenamed("easter", "after")
    days = years_with_easter(spark, first - 1, last + 1).join(named, F.expr("since IS NULL OR year >= since"))
    opening, closing = F.expr("make_date(year, month, 1)"), F.expr("last_day(make_date(year, month, 1))")
    forward = F.date_add(opening, F.pmod(F.col("weekday") - F.weekday(opening), F.lit(7)) + 7 * (F.col("nth") - 1))
    backward = F.date_sub(closing, F.pmod(F.weekday(closing) - F.col("weekday"), F.lit(7)) - 7 * (F.col("nth") + 1))
    fixed = F.expr("try_cast(format_string('%04d-%02d-%02d', year, month, day) AS date)")
    on = F.when(F.col("after").isNotNull(), F.date_add("easter", F.col("after"))).when(F.col("nth") > 0, forward).when(F.col("nth") < 0, backward).otherwise(fixed)
    moves = "CASE weekday(holiday_date) WHEN 5 THEN CASE moved WHEN 'nearest' THEN -1 WHEN 'monday' THEN 2 WHEN 'later' THEN 2 END WHEN 6 THEN CASE moved WHEN 'later' THEN 2 ELSE 1 END END"
    dated = days.withColumn("holiday_date", on).where("holiday_date IS NOT NULL").withColumn("by", F.when(F.col("moved").isNotNull(), F.expr(moves)))
    observed = dated.where("by IS NOT NULL").select("currency", F.expr("date_add(holiday_date, by)").alias("holiday_date"), F.concat("name", F.lit(" (observed)")).alias("name"))
    return dated.select("currency", "holiday_date", "name").unionByName(observed).where(F.year("holiday_date").between(first, last))
