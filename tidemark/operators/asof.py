"""Reads as of an instant: what was known then, and nothing that came later."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import DAY, MINUTE, instant

Instant = datetime | int


def at(t: Instant) -> int:
    return t if isinstance(t, int) and not isinstance(t, bool) else instant(t)


def macro_as_of(observations: DataFrame, t: Instant, series_id: str | None = None, ref_period: str | None = None, in_order: bool = False) -> DataFrame:
    """The latest vintage of each (series, period) known at t, inclusive; one published as missing counts. The filter lies below the aggregate. In order: by series and period."""
    known = observations.where(F.col("known_at") <= at(t))
    if series_id is not None:
        known = known.where(F.col("series_id") == series_id)
    if ref_period is not None:
        known = known.where(F.col("ref_period") == F.lit(ref_period).cast("date"))
    newest = F.max_by(F.struct("known_at", "value", "vintage_seq"), F.struct("known_at", "vintage_seq"))
    found = known.groupBy("series_id", "ref_period").agg(newest.alias("v")).select("series_id", "ref_period", "v.*")
    return found.orderBy("series_id", "ref_period") if in_order else found


def first_print(observations: DataFrame) -> DataFrame:
    oldest = F.min_by(F.struct("known_at", "value", "vintage_seq"), F.struct("known_at", "vintage_seq"))
    return observations.groupBy("series_id", "ref_period").agg(oldest.alias("v")).select("series_id", "ref_period", "v.*")


def validity(observations: DataFrame) -> DataFrame:
    """Every vintage with until, the instant from which the next one holds (null for the last); of those with one instant the last."""
    by = Window.partitionBy("series_id", "ref_period").orderBy("known_at", "vintage_seq")
    return observations.withColumn("until", F.lead("known_at").over(by)).where("until IS NULL OR until > known_at")


def numbered_asks(asks: DataFrame, instants: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((ask_at, n) of the distinct asks in order, (at, before) of the distinct instants with the number of asks before each).

    Windows span a day; what the days before hold comes from a table with a row for each day.
    """
    both = asks.select(F.col("ask_at").alias("at"), F.lit(1).alias("asked")).unionByName(instants.select("at", F.lit(0).alias("asked"))).distinct().withColumn("day", F.expr(f"at div {DAY}"))
    days = both.groupBy("day").agg(F.sum("asked").alias("count"))
    earlier = days.select("day", (F.sum("count").over(Window.orderBy("day")) - F.col("count")).alias("earlier"))
    # an instant comes before the ask of the same instant, so that one isn't among those before it
    so_far = F.sum("asked").over(Window.partitionBy("day").orderBy("at", "asked")) - F.col("asked")
    rows = both.withColumn("so_far", so_far).join(earlier, "day").withColumn("n", F.col("so_far") + F.col("earlier"))
    return rows.where("asked = 1").select(F.col("at").alias("ask_at"), "n"), rows.where("asked = 0").select("at", F.col("n").alias("before"))


def macro_as_of_many(observations: DataFrame, asks: DataFrame, few: int = 64) -> DataFrame:
    """macro_as_of at every distinct instant of asks (ask_at): a row for each that a vintage holds at, and none is made that isn't a result.

    Up to `few` asks are an array in the plan. More are numbered in order: a vintage holds for a run of numbers, by which it meets the asks.
    """
    held = validity(observations)
    out = ["ask_at", "series_id", "ref_period", "known_at", "value", "vintage_seq"]
    known = [r.ask_at for r in asks.select("ask_at").distinct().limit(few + 1).collect() if r.ask_at is not None]
    if len(known) <= few:
        listed = F.array(*map(F.lit, sorted(known))).cast("array<bigint>")
        return held.withColumn("ask_at", F.explode(F.filter(listed, lambda a: (a >= F.col("known_at")) & (F.col("until").isNull() | (a < F.col("until")))))).select(*out)
    asks = asks.where("ask_at IS NOT NULL").select("ask_at").distinct()
    numbers, instants = numbered_asks(asks, observations.select(F.col("known_at").alias("at")))
    begin, end = (instants.select(F.col("at").alias(c), F.col("before").alias(n)) for c, n in (("known_at", "low"), ("until", "high")))
    runs = held.join(begin, "known_at").join(end, "until", "left").withColumn("high", F.coalesce("high", F.lit(asks.count()))).where("low < high")
    return runs.withColumn("n", F.explode(F.expr("sequence(low, high - 1)"))).join(numbers, "n").select(*out)


def clean(ticks: DataFrame) -> DataFrame:
    return ticks.where("bid <= ask")


def dedupe(ticks: DataFrame) -> DataFrame:
    """One quote of each (instrument, ts, source): the lowest bid, then the lowest ask, then the earliest."""
    names = [c for c in ticks.columns if c not in ("instrument", "ts", "source")]
    least = F.min_by(F.struct(*names), F.struct("bid", "ask", "seq"))
    return ticks.groupBy("instrument", "ts", "source").agg(least.alias("v")).select("instrument", "ts", "source", "v.*")


def ticks_as_of(ticks: DataFrame, t: Instant, instrument: str, start: Instant | None = None, end: Instant | None = None, in_order: bool = False) -> DataFrame:
    """Quotes printed by t, crossed ones never, in [start, end) if given, without repeated keys. In order: by time and feed."""
    found = ticks.where((F.col("ts") <= at(t)) & (F.col("instrument") == instrument))
    found = found if start is None else found.where(F.col("ts") >= at(start))
    found = found if end is None else found.where(F.col("ts") < at(end))
    found = dedupe(clean(found))
    return found.orderBy("ts", "source") if in_order else found


def bars_as_of(bars: DataFrame, t: Instant, instrument: str, source: str, start: Instant | None = None, end: Instant | None = None, mode: str = "start", length: int = MINUTE, in_order: bool = False) -> DataFrame:
    """Bars of one feed that have begun by t or, in mode closed, ended. A bar that has only begun still shows its later close. In order: by minute."""
    limit = F.col("minute") <= at(t) if mode == "start" else F.col("minute") + length <= at(t)
    found = bars.where(limit & (F.col("instrument") == instrument) & (F.col("source") == source))
    found = found if start is None else found.where(F.col("minute") >= at(start))
    found = found if end is None else found.where(F.col("minute") < at(end))
    return found.orderBy("minute") if in_order else found


def forward_asof(asks: DataFrame, ticks: DataFrame, tolerance: int, strict: bool = False) -> DataFrame:
    """For each row of asks (ask_id, instrument, ask_at): the first clean tick in [ask_at, ask_at + tolerance], nulls if there is none.

    Asks and ticks lie in time buckets as wide as the tolerance, so no instrument is one task's work. Read backwards, a bucket's last tick before an ask is the
    one that follows it; if there is none, it is the first of the next bucket. Ticks that an ask doesn't get are never paired with it, however many its bucket has.
    """
    bucket, tick = F.expr(f"__at div {tolerance}"), F.struct("ts", "seq", "bid", "ask")
    side = clean(ticks).where("instrument IS NOT NULL").select("instrument", F.col("ts").alias("__at"), tick.alias("__tick")).withColumn("__bucket", bucket)
    asked = asks.withColumn("__at", F.col("ask_at")).withColumn("__bucket", bucket).withColumn("__asks", F.lit(True))
    # a tick of an ask's own instant follows it unless strict
    own = F.col("__asks").asc_nulls_last() if strict else F.col("__asks").asc_nulls_first()
    back = Window.partitionBy("instrument", "__bucket").orderBy(F.col("__at").desc(), own, F.col("__tick.seq").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = asked.unionByName(side, allowMissingColumns=True).withColumn("__seen", F.last("__tick", ignorenulls=True).over(back)).where("__asks")
    ahead = side.groupBy("instrument", "__bucket").agg(F.min_by("__tick", F.struct("__tick.ts", "__tick.seq")).alias("__ahead")).withColumn("__bucket", F.col("__bucket") - 1)
    found = seen.join(ahead, ["instrument", "__bucket"], "left").withColumn("__v", F.coalesce("__seen", "__ahead"))
    within = F.when(F.col("__v.ts") <= F.col("ask_at") + tolerance, F.col("__v"))
    return found.withColumn("__v", within).select("ask_id", *(c for c in asks.columns if c != "ask_id"), "__v.*")


def backward_by_day(rows: DataFrame, keys: list[str], order: list[str], columns: list[str], time: str = "ts") -> DataFrame:
    """prev_<column> of the row before, by keys and order. Windows span a day of a key; the first row of a day is joined with the last one of the latest day before."""
    day = F.expr(f"{time} div {DAY}")
    rows = rows.withColumn("__day", day)
    within = Window.partitionBy(*keys, "__day").orderBy(*order)
    rows = rows.withColumn("__n", F.row_number().over(within)).withColumns({f"__p_{c}": F.lag(c).over(within) for c in columns})
    last = rows.groupBy(*keys, "__day").agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("__end"))
    days = Window.partitionBy(*keys).orderBy("__day")  # a row for each day
    last = last.select(*keys, "__day", F.lag("__end").over(days).alias("__end"))
    joined = rows.join(last, [*keys, "__day"], "left")
    return joined.withColumns({f"prev_{c}": F.when(F.col("__n") == 1, F.col(f"__end.{c}")).otherwise(F.col(f"__p_{c}")) for c in columns}).drop("__n", "__end", *(f"__p_{c}" for c in columns))
