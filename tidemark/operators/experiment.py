"""An event study that tells how much of a result comes from revised values, coarse times or mid prices."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import DAY, HOUR, MINUTE
from .asof import forward_asof

#: The four arms. A is honest; each next one has one advantage more: final values, entry at the day's open, mid prices.
ARMS = (("A", False, False, False), ("B", True, False, False), ("C", True, True, False), ("D", True, True, True))
HOLD, TOLERANCE, PER_YEAR, FEWEST = 30 * MINUTE, 5 * MINUTE, 24, 20
#: What each arm adds to the one before it.
CHANNELS = ("revisions", "coarse times", "mid prices")


def orders(events: DataFrame, hold: int = HOLD) -> DataFrame:
    """From events (event_id, instrument, release_at, surprise_first, surprise_final): each arm's direction, entry and exit instants. A positive surprise sells."""
    names = ("arm", "use_revised", "date_only", "use_mid")
    each = F.array(*(F.struct(*(F.lit(value).alias(name) for name, value in zip(names, arm, strict=True))) for arm in ARMS))
    wide = events.withColumn("__arm", F.explode(each)).select(*events.columns, "__arm.*")
    surprise = F.when(F.col("use_revised"), F.col("surprise_final")).otherwise(F.col("surprise_first"))
    entry = F.when(F.col("date_only"), F.expr(f"release_at - pmod(release_at, {DAY})")).otherwise(F.col("release_at"))
    rows = wide.withColumn("direction", F.when(surprise > 0, -1).when(surprise < 0, 1).otherwise(0)).withColumn("entry_at", entry)
    return rows.withColumn("exit_at", F.col("entry_at") + hold)


def hours_needed(events: DataFrame, hold: int = HOLD, tolerance: int = TOLERANCE) -> DataFrame:
    """The (instrument, hour) pairs whose ticks are needed to price every arm of every event, each once."""
    asks = orders(events, hold).select("instrument", F.explode(F.array("entry_at", "exit_at")).alias("a"))
    hours = F.expr(f"sequence(a - pmod(a, {HOUR}), a + {tolerance}, {HOUR}L)")
    return asks.select("instrument", F.explode(hours).alias("hour")).distinct()


def trades(events: DataFrame, ticks: DataFrame, tolerance: int = TOLERANCE, hold: int = HOLD) -> DataFrame:
    """Trades of the events whose quotes every arm has, with their return in basis points; an arm whose surprise is zero or unknown doesn't trade. Of an entry at a price of 0 the return is null."""
    # what is known of an order goes along with its two asks, so that events are made once for each side of the as-of join and not again
    leg = lambda name: F.struct(F.lit(name).alias("leg"), F.col(f"{name}_at").alias("ask_at"))
    order = ["event_id", "arm", "direction", "use_mid"]
    asks = orders(events, hold).select(*order, "instrument", F.explode(F.array(leg("entry"), leg("exit"))).alias("l")).select(*order, "instrument", "l.*")
    priced = forward_asof(asks.withColumn("ask_id", F.concat_ws("|", "event_id", "arm", "leg")), ticks, tolerance)
    rows = priced.groupBy(*order).agg(*(F.max(F.when(F.col("leg") == leg, F.col(side))).alias(f"{leg}_{side}") for leg in ("entry", "exit") for side in ("bid", "ask")))
    buys = F.col("direction") > 0
    mid = lambda leg: (F.col(f"{leg}_bid") + F.col(f"{leg}_ask")) / 2
    entry = F.when(F.col("use_mid"), mid("entry")).when(buys, F.col("entry_ask")).otherwise(F.col("entry_bid"))
    exit_ = F.when(F.col("use_mid"), mid("exit")).when(buys, F.col("exit_bid")).otherwise(F.col("exit_ask"))
    rows = rows.withColumn("entry", entry).withColumn("exit", exit_)
    quoted = F.count_if(F.col("entry_bid").isNotNull() & F.col("exit_bid").isNotNull()).over(Window.partitionBy("event_id"))  # four rows
    rows = rows.withColumn("n", quoted).where((F.col("n") == len(ARMS)) & (F.col("direction") != 0))
    return rows.select("event_id", "arm", "direction", "entry", "exit", (F.try_divide(F.col("direction") * (F.col("exit") - F.col("entry")), "entry") * 10000).alias("return_bps"))


def metrics(found: DataFrame) -> DataFrame:
    deviation = F.coalesce(F.stddev_samp("return_bps"), F.lit(0.0))
    rows = found.groupBy("arm").agg(F.count("*").alias("n"), F.avg("return_bps").alias("mean"), deviation.alias("std"), F.avg(F.when(F.col("return_bps") > 0, 1.0).otherwise(0.0)).alias("hit_rate"), F.sum("return_bps").alias("total"))
    sharpe = F.when((F.col("n") < 2) | (F.col("std") == 0), 0.0).otherwise(F.col("mean") / F.col("std") * (PER_YEAR**0.5))
    return rows.withColumn("sharpe", sharpe)


def gaps(found: DataFrame) -> DataFrame:
    """How much each arm's next one adds to its mean return and Sharpe ratio."""
    by = Window.orderBy("arm")  # four rows
    ahead = lambda c: F.lead(c).over(by) - F.col(c)
    return metrics(found).select("arm", F.lead("arm").over(by).alias("next_arm"), ahead("mean").alias("gap_bps"), ahead("sharpe").alias("sharpe_delta")).where("next_arm IS NOT NULL")


def notes(found: DataFrame, fewest: int = FEWEST) -> DataFrame:
    """One row: the honest arm's trades, whether they are too few to tell, whether Sharpe ratios rise from A to D, and the channel that adds most to them.

    An arm without trades has a ratio of 0; of channels that add the same the first is named.
    """
    ratios = [F.coalesce(F.max(F.when(F.col("arm") == a[0], F.col("sharpe"))), F.lit(0.0)).alias(a[0]) for a in ARMS]
    row = metrics(found).agg(F.coalesce(F.max(F.when(F.col("arm") == "A", F.col("n"))), F.lit(0)).alias("events"), *ratios)
    steps = [(F.col(b[0]) - F.col(a[0]), name) for a, b, name in zip(ARMS, ARMS[1:], CHANNELS, strict=False)]
    most = F.greatest(*(d for d, _ in steps))
    source = F.coalesce(*(F.when(d == most, F.lit(name)) for d, name in steps))
    rises = (F.col("A") < F.col("B")) & (F.col("B") < F.col("C")) & (F.col("C") < F.col("D"))
    return row.select("events", (F.col("events") < fewest).alias("underpowered"), rises.alias("ordering_holds"), source.alias("largest_source"))


def paired(found: DataFrame) -> DataFrame:
    """Differences of each arm's return from the arm before, event by event: mean, standard error, t, whether |t| is over 2, the 95 % interval, and
    the events in which the two arms trade in opposite directions."""
    wide = found.groupBy("event_id").pivot("arm", [a[0] for a in ARMS]).agg(F.first(F.struct("return_bps", "direction")))
    pairs = [("A", "B"), ("B", "C"), ("C", "D"), ("A", "D")]
    long = wide.select(F.explode(F.array(*(F.struct(F.lit(f"{a}-{b}").alias("pair"), (F.col(f"{b}.return_bps") - F.col(f"{a}.return_bps")).alias("d"), (F.col(f"{b}.direction") != F.col(f"{a}.direction")).alias("flip")) for a, b in pairs))).alias("p")).select("p.*").where("d IS NOT NULL")
    rows = long.groupBy("pair").agg(F.count("*").alias("n"), F.avg("d").alias("mean"), F.stddev_samp("d").alias("sd"), F.count_if("flip").alias("flips"))
    rows = rows.withColumn("se", F.col("sd") / F.sqrt("n")).withColumn("t", F.when(F.col("se") > 0, F.col("mean") / F.col("se")))
    rows = rows.withColumn("resolved", F.coalesce(F.abs("t") > 2, F.lit(False)))
    return rows.withColumn("low", F.col("mean") - 1.96 * F.col("se")).withColumn("high", F.col("mean") + 1.96 * F.col("se"))


def power(found: DataFrame, effects: tuple[float, ...] = (10.0, 5.0, 2.0)) -> DataFrame:
    """How many events, and years of them, would tell an effect of so many basis points from nothing."""
    sd = paired(found).where("pair = 'A-D'").select("sd")
    rows = sd.select("sd", F.explode(F.array(*map(F.lit, effects))).alias("effect_bps"))
    return rows.withColumn("events", F.ceil(F.pow(2 * F.col("sd") / F.col("effect_bps"), F.lit(2)))).withColumn("years", F.round(F.col("events") / PER_YEAR, 2))
