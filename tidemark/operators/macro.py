"""Revised series: numbering of vintages, revisions, and archives in which every column is a vintage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import DAY
from .asof import validity


def number_vintages(observations: DataFrame) -> DataFrame:
    by = Window.partitionBy("series_id", "ref_period").orderBy("known_at", "vintage_seq")
    return observations.withColumn("vintage", F.row_number().over(by))


def upsert(stored: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of both; of equal keys the incoming one. Of repeated incoming keys one stays, the greatest."""
    both = stored.withColumn("__new", F.lit(0)).unionByName(incoming.withColumn("__new", F.lit(1)))
    rest = [c for c in stored.columns if c not in keys]
    return both.groupBy(*keys).agg(F.max(F.struct("__new", *rest)).alias("v")).select(*keys, *(f"v.{c}" for c in rest))


def summary(observations: DataFrame) -> DataFrame:
    return observations.agg(F.count("*").alias("observations"), F.count_distinct("series_id").alias("series"), F.count_distinct("series_id", "ref_period").alias("periods"), F.count_if(F.col("value").isNull()).alias("missing"), F.min("known_at").alias("first_known"), F.max("known_at").alias("last_known"))


def revisions(observations: DataFrame) -> DataFrame:
    """First and second vintage of each period where both have a value and they differ; pct is against the first one's absolute value, null if that is 0."""
    by = Window.partitionBy("series_id", "ref_period").orderBy("known_at", "vintage_seq")
    every = Window.partitionBy("series_id", "ref_period")
    rows = observations.withColumn("vintage", F.row_number().over(by)).withColumn("second", F.lead("value").over(by)).withColumn("vintages", F.count("*").over(every))
    rows = rows.where("vintage = 1 AND value IS NOT NULL AND second IS NOT NULL AND value <> second")
    revision = F.col("second") - F.col("value")
    return rows.select("series_id", "ref_period", F.col("value").alias("first"), "second", F.round(revision, 2).alias("revision"), F.round(F.try_divide(100 * revision, F.abs("value")), 4).alias("pct"), "vintages")


def load_report(observations: DataFrame) -> DataFrame:
    """Of each series its observations, periods, vintages and the ends of these."""
    return observations.groupBy("series_id").agg(F.count("*").alias("observations"), F.count_distinct("ref_period").alias("periods"), F.count_distinct("known_at").alias("vintages"), F.min("known_at").alias("first_known"), F.max("known_at").alias("last_known"))


def insert_absent(stored: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """stored and the incoming rows whose keys it lacks; what it has stays as it is. Of repeated incoming keys one stays, the greatest."""
    rest = [c for c in stored.columns if c not in keys]
    new = incoming.join(stored.select(*keys), keys, "left_anti").groupBy(*keys).agg(F.max(F.struct(*rest)).alias("v"))
    return stored.unionByName(new.select(*keys, *(f"v.{c}" for c in rest)))


def rebases(observations: DataFrame, fewest: int = 3, least: float = 0.01, tolerance: float = 0.001) -> DataFrame:
    """(series_id, known_at, periods, ratio): vintages that change a series' units: all periods which they publish anew differ from before by one ratio.

    A vintage is what becomes known at one instant; a period's value before is its last one known earlier. At least `fewest` periods must have a value in
    both, their ratios may differ by `tolerance` of the mean, for rounding, and the mean must be off 1 by more than `least`. A missing value or a 0 before
    tells nothing. The ratio is that of the sums, so that large values, which are rounded the least, count most.
    """
    by = Window.partitionBy("series_id", "ref_period").orderBy("known_at", "vintage_seq")
    # of vintages of one instant the last one holds
    held = observations.groupBy("series_id", "ref_period", "known_at").agg(F.max_by(F.struct("value", "vintage_seq"), "vintage_seq").alias("v")).select("series_id", "ref_period", "known_at", "v.*")
    steps = held.withColumn("before", F.lag("value").over(by)).withColumn("r", F.try_divide("value", "before")).where("r IS NOT NULL")
    found = steps.groupBy("series_id", "known_at").agg(F.count("*").alias("periods"), F.min("r").alias("low"), F.max("r").alias("high"), F.try_divide(F.sum("value"), F.sum("before")).alias("ratio"))
    same = (F.col("high") - F.col("low") <= tolerance * F.abs("ratio")) & (F.abs(F.col("ratio") - 1) > least)
    return found.where((F.col("periods") >= fewest) & same).select("series_id", "known_at", "periods", "ratio")


def units(observations: DataFrame, **limits: float) -> DataFrame:
    """(series_id, ref_period, known_at, vintage_seq, value, factor, level): factor is what all rebases of the series after a vintage multiply values by, level the value in the last vintage's units."""
    changes = rebases(observations, **limits).select("series_id", F.col("known_at").alias("at"), "ratio")
    # a series has few rebases: an array of them beside its rows
    listed = changes.groupBy("series_id").agg(F.collect_list(F.struct("at", "ratio")).alias("changes"))
    factor = F.aggregate(F.filter("changes", lambda c: c["at"] > F.col("known_at")), F.lit(1.0), lambda x, c: x * c["ratio"])
    rows = observations.join(listed, "series_id", "left").withColumn("factor", F.coalesce(factor, F.lit(1.0)))
    return rows.select("series_id", "ref_period", "known_at", "vintage_seq", "value", "factor", (F.col("value") * F.col("factor")).alias("level"))


def top_revisions(observations: DataFrame, limit: int, stable: list[str] | None = None, **limits: float) -> DataFrame:
    """The largest first revisions of series whose units stay the same: those named, else those without a rebase that is found. In other series levels of two vintages don't compare."""
    if stable is not None:
        observations = observations.where(F.col("series_id").isin(stable))
    else:
        observations = observations.join(rebases(observations, **limits).select("series_id").distinct(), "series_id", "left_anti")
    return revisions(observations).orderBy(F.abs("revision").desc(), "series_id", "ref_period").limit(limit)


def revised_periods(observations: DataFrame) -> DataFrame:
    """Of each series the periods, and those whose last value isn't the first one; a value that went missing differs."""
    order = F.struct("known_at", "vintage_seq")
    ends = observations.groupBy("series_id", "ref_period").agg(F.min_by(F.struct("value"), order).alias("a"), F.max_by(F.struct("value"), order).alias("b"))
    return ends.groupBy("series_id").agg(F.count("*").alias("periods"), F.count_if(~F.col("a.value").eqNullSafe(F.col("b.value"))).alias("revised"))


def month_end(year: Column, month: Column) -> Column:
    """The last microsecond of a month: when a vintage dated by month alone counts as known."""
    first = F.add_months(F.make_date(year, month, F.lit(1)), 1)
    return F.datediff(first, F.lit("1970-01-01").cast("date")).cast("long") * DAY - 1


def of_year(month: Column) -> Column:
    """The month, or null if no year has it."""
    return F.when(month.between(1, 12), month)


def vintage_header(header: Column) -> Column:
    """(series, known_at) of a column's title like ABC65M11 or ABC65Q4: years below 64 are of this century, a quarter is known at its last month's end."""
    # fixed value: the form of a title
    part = lambda k: F.regexp_extract(F.trim(header), r"(?i)^([A-Z]+)(\d{2})(?:M(\d{1,2})|Q(\d))$", k)
    short = part(2).try_cast("int")
    year = F.when(short >= 64, 1900 + short).otherwise(2000 + short)
    month = F.coalesce(part(3).try_cast("int"), part(4).try_cast("int") * 3)
    return F.struct(part(1).alias("series"), month_end(year, of_year(month)).alias("known_at"))


def ref_period(text: Column) -> Column:
    """The first day of a period like 1970:03 or 1970:Q2; null for other texts and for months and quarters that no year has."""
    part = lambda k: F.regexp_extract(F.trim(text), r"(?i)^(\d{4}):(?:(\d{1,2})|Q(\d))$", k)
    month = F.coalesce(part(2).try_cast("int"), part(3).try_cast("int") * 3 - 2)
    return F.make_date(part(1).try_cast("int"), of_year(month), F.lit(1))


def unpivot_archive(cells: DataFrame) -> DataFrame:
    """From (name, row, col, text) of a grid: an observation for each cell that is a number, its period from the first column, its vintage from the first row."""
    heads = cells.where("row = 1 AND col > 1").select("name", "col", vintage_header(F.col("text")).alias("v"))
    periods = cells.where("col = 1 AND row > 1").select("name", "row", ref_period(F.col("text")).alias("ref_period"))
    body = cells.where("row > 1 AND col > 1").withColumn("value", F.expr("try_cast(text AS double)")).where("value IS NOT NULL AND NOT isnan(value)")
    rows = body.join(heads, ["name", "col"]).join(periods, ["name", "row"]).where("ref_period IS NOT NULL AND v.known_at IS NOT NULL")
    return rows.select(F.col("v.series").alias("series_id"), "ref_period", F.col("v.known_at").alias("known_at"), "value")


def surprises(first_prints: DataFrame, past: int = 12) -> DataFrame:
    """The change of each period less the mean of the `past` changes before it, which must all be there."""
    by = Window.partitionBy("series_id").orderBy("ref_period")
    rows = first_prints.withColumn("change", F.col("value") - F.lag("value").over(by))
    before = by.rowsBetween(-past, -1)
    rows = rows.withColumn("mean", F.avg("change").over(before)).withColumn("n", F.count("change").over(before))
    return rows.where((F.col("n") == past) & F.col("change").isNotNull()).withColumn("surprise", F.col("change") - F.col("mean"))


def release_events(observations: DataFrame, start: int, end: int, past: int = 12, years: int = 5) -> DataFrame:
    """Each release in [start, end) with its first print and final value, and the surprise by the values as they were published then and by the final ones.

    A surprise is the period's change less the mean of the `past` changes before it; all must be known. Published values are looked for in the
    period's year and the `years` before it, so releases and vintages meet on (series, year) and none meets a series' whole history.
    """
    found = releases(observations).where((F.col("known_at") >= start) & (F.col("known_at") < end)).select("series_id", F.col("known_at").alias("released_at"), F.col("ref_period").alias("period"))
    asked = found.select("*", F.explode(F.expr(f"sequence(year(period) - {years}, year(period))")).alias("y"))
    # a vintage holds until the next one of its period, so a release meets one of each period and needn't look for the newest
    held = validity(observations.select("series_id", "ref_period", "known_at", "vintage_seq", "value")).withColumn("y", F.year("ref_period"))
    met = asked.join(held, ["series_id", "y"]).where("known_at <= released_at AND (until IS NULL OR until > released_at) AND ref_period <= period")
    keys = ["series_id", "released_at", "period"]
    published = met.where("value IS NOT NULL").select(*keys, "ref_period", "value")
    last = Window.partitionBy(*keys).orderBy(F.col("ref_period").desc())
    # of one release the periods of a few years; newest first
    rows = published.withColumn("k", F.row_number().over(last)).where(F.col("k") <= past + 2)
    rows = rows.groupBy(*keys).agg(F.expr("transform(array_sort(collect_list(struct(k, ref_period, value))), x -> struct(x.ref_period, x.value))").alias("s"))
    rows = rows.where((F.size("s") == past + 2) & (F.col("s")[0]["ref_period"] == F.col("period")))
    # the changes before it add up to the difference of their ends
    change, before = F.col("s")[0]["value"] - F.col("s")[1]["value"], F.col("s")[1]["value"] - F.col("s")[past + 1]["value"]
    first = rows.select(*keys, F.col("s")[0]["value"].alias("first_print"), (change - before / past).alias("surprise_first"))
    final = held.where("until IS NULL AND value IS NOT NULL").select("series_id", "ref_period", "value")
    last_known = surprises(final, past).select("series_id", F.col("ref_period").alias("period"), F.col("value").alias("final_value"), F.col("surprise").alias("surprise_final"))
    return first.join(last_known, ["series_id", "period"]).withColumnRenamed("period", "ref_period")


def releases(observations: DataFrame) -> DataFrame:
    """Vintages that bring a period later than any known before in their series; revisions of old periods aren't releases."""
    per = observations.groupBy("series_id", "known_at").agg(F.max("ref_period").alias("ref_period"))
    before = F.max("ref_period").over(Window.partitionBy("series_id").orderBy("known_at").rowsBetween(Window.unboundedPreceding, -1))
    return per.withColumn("before", before).where("before IS NULL OR ref_period > before").drop("before")


