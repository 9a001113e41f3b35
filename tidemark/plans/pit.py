"""Queries over revised series and quotes, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import DAY, HOUR, MINUTE, day_of, floor_to, instant, local_instant
from ..operators import asof, bars, experiment, flags, ledger, macro, monitors, sessions
from ..sources import hour_url, hours_between, reference_rates_wide, store, tables, ticks, unpivot_rates, vintages

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

AS_OF = instant(datetime(1998, 6, 30, tzinfo=timezone.utc))
NOW = instant(datetime(2024, 1, 20, 12, 0, 30, tzinfo=timezone.utc))
START, END = date(2024, 1, 1), date(2024, 2, 1)
#: The days that the events span, from the first until before the day after the last.
FIRST_DAY, NEXT_DAY = "(SELECT CAST(min(ts) AS DATE) FROM events)", "(SELECT CAST(max(ts) AS DATE) + 1 FROM events)"


def span(spark: SparkSession, d: str) -> tuple[date, date]:
    """FIRST_DAY and NEXT_DAY."""
    at = F.col("ts").cast("timestamp_ntz").cast("date")
    return tuple(spark.read.parquet(f"{d}/events.parquet").agg(F.min(at), F.date_add(F.max(at), 1)).first())


TICK = """tick AS (SELECT event_type AS instrument, epoch_us(ts) AS ts, value AS bid, value + ((event_id % 23) - 1) / CAST(100 AS DOUBLE) AS ask,
  CASE WHEN user_id % 2 = 0 THEN 'feed_a' ELSE 'feed_b' END AS source, event_id AS seq FROM events)"""
VINTAGE = """vintage AS (SELECT 'S' || (o_custkey % 10) AS series_id, CAST(date_trunc('month', o_orderdate) AS DATE) AS ref_period, epoch_us(o_orderdate) AS known_at,
  CASE WHEN o_orderkey % 17 <> 0 THEN o_totalprice END AS value, o_orderkey AS vintage_seq FROM orders)"""
LATEST = "row_number() OVER (PARTITION BY series_id, ref_period ORDER BY known_at DESC, vintage_seq DESC)"
EARLIEST = "row_number() OVER (PARTITION BY series_id, ref_period ORDER BY known_at, vintage_seq)"


def period():
    return F.col("ref_period").cast("string").alias("ref_period")


def query(name: str, sql: str | None):
    """Register a query under a name, with SQL that starts from the tables or from tick and vintage."""

    def kept(f):
        QUERIES[name] = f
        if sql is not None:
            parts = [TICK] * ("tick" in sql and TICK not in sql) + [VINTAGE] * ("vintage " in sql or "vintage)" in sql or "FROM vintage" in sql)
            head = ", ".join(parts)
            body = sql.strip()
            ORACLE_SQL[name] = (f"WITH {head}" + (", " + body[5:] if body.startswith("WITH ") else " " + body)) if parts else body
        return f

    return kept


MACRO_OUT = "series_id, CAST(ref_period AS VARCHAR) AS ref_period, known_at, value, vintage_seq"


@query("asof_macro_latest", f"SELECT {MACRO_OUT} FROM (SELECT *, {LATEST} AS k FROM vintage WHERE known_at <= {AS_OF}) WHERE k = 1")
def _(spark, d):
    return asof.macro_as_of(vintages(spark, d), AS_OF).withColumn("ref_period", period())


@query("asof_macro_one_series", f"SELECT {MACRO_OUT} FROM (SELECT *, {LATEST} AS k FROM vintage WHERE known_at <= {AS_OF} AND series_id = 'S3') WHERE k = 1")
def _(spark, d):
    return asof.macro_as_of(vintages(spark, d), AS_OF, "S3").withColumn("ref_period", period())


@query("asof_macro_first_print", f"SELECT {MACRO_OUT} FROM (SELECT *, {EARLIEST} AS k FROM vintage) WHERE k = 1")
def _(spark, d):
    return asof.first_print(vintages(spark, d)).withColumn("ref_period", period())


@query("asof_macro_null_vintage", f"SELECT {MACRO_OUT} FROM (SELECT *, {LATEST} AS k FROM vintage WHERE known_at <= {AS_OF}) WHERE k = 1 AND value IS NULL")
def _(spark, d):
    return asof.macro_as_of(vintages(spark, d), AS_OF).where("value IS NULL").withColumn("ref_period", period())


ASKS = [instant(datetime(y, m, 15, tzinfo=timezone.utc)) for y, m in ((1995, 3), (1996, 7), (1998, 6), (2001, 1))]


@query("asof_macro_walkthrough", f"""WITH asks AS (SELECT unnest({ASKS}) AS ask_at),
r AS (SELECT ask_at, v.*, row_number() OVER (PARTITION BY ask_at, series_id, ref_period ORDER BY known_at DESC, vintage_seq DESC) AS k FROM asks JOIN vintage v ON v.known_at <= ask_at)
SELECT ask_at, {MACRO_OUT} FROM r WHERE k = 1""")
def _(spark, d):
    asks = spark.createDataFrame([(a,) for a in ASKS], "ask_at long")
    return asof.macro_as_of_many(vintages(spark, d), asks).withColumn("ref_period", period())


@query("vintage_seq", f"SELECT series_id, CAST(ref_period AS VARCHAR) AS ref_period, known_at, vintage_seq, {EARLIEST} AS vintage FROM vintage")
def _(spark, d):
    return macro.number_vintages(vintages(spark, d)).select("series_id", period(), "known_at", "vintage_seq", F.col("vintage").cast("long").alias("vintage"))


@query("vintage_known_at_month_end", "SELECT DISTINCT CAST(ref_period AS VARCHAR) AS ref_period, epoch_us(CAST(ref_period AS TIMESTAMP) + INTERVAL 1 MONTH) - 1 AS known_at FROM vintage")
def _(spark, d):
    months = vintages(spark, d).select("ref_period").distinct()
    return months.select(period(), macro.month_end(F.year("ref_period"), F.month("ref_period")).alias("known_at"))


@query("macro_summary", "SELECT count(*) AS observations, count(DISTINCT series_id) AS series, count(DISTINCT (series_id, ref_period)) AS periods, count(*) FILTER (WHERE value IS NULL) AS missing, min(known_at) AS first_known, max(known_at) AS last_known FROM vintage")
def _(spark, d):
    return macro.summary(vintages(spark, d))


REVISED = """WITH r AS (SELECT *, row_number() OVER w AS k, lead(value) OVER w AS second, count(*) OVER (PARTITION BY series_id, ref_period) AS vintages FROM vintage
  WINDOW w AS (PARTITION BY series_id, ref_period ORDER BY known_at, vintage_seq)),
x AS (SELECT series_id, CAST(ref_period AS VARCHAR) AS ref_period, value AS first, second, round(second - value, 2) AS revision, round(100 * (second - value) / nullif(abs(value), 0), 4) AS pct, vintages FROM r WHERE k = 1 AND value <> second)
SELECT * FROM x"""


@query("revisions", REVISED)
def _(spark, d):
    return macro.revisions(vintages(spark, d)).withColumn("ref_period", period())


@query("revision_top_k", REVISED + " ORDER BY abs(revision) DESC, series_id, ref_period LIMIT 20")
def _(spark, d):
    return macro.top_revisions(vintages(spark, d), 20, [f"S{k}" for k in range(10)]).withColumn("ref_period", period())


def archive(spark, d):
    """The first three vintages of each period, known together in three instants; from the second on S2 and S5 are in units of their own."""
    numbered = macro.number_vintages(vintages(spark, d)).where("vintage <= 3")
    factor = F.when((F.col("series_id") == "S2") & (F.col("vintage") >= 2), 1.6).when((F.col("series_id") == "S5") & (F.col("vintage") >= 3), 0.25).otherwise(1.0)
    revised = F.col("series_id").isin("S2", "S5")
    first = F.first("value").over(Window.partitionBy("series_id", "ref_period").orderBy("vintage"))
    return numbered.select("series_id", "ref_period", F.col("vintage").cast("long").alias("known_at"), "vintage_seq", F.round(F.when(revised, first * factor).otherwise(F.col("value")), 2).alias("value"))


ARCHIVE = f"""nu AS (SELECT *, {EARLIEST} AS k FROM vintage), ar AS (SELECT series_id, ref_period, k AS known_at, vintage_seq,
round(CASE WHEN series_id IN ('S2', 'S5') THEN first(value) OVER (PARTITION BY series_id, ref_period ORDER BY k) * CASE WHEN series_id = 'S2' AND k >= 2 THEN 1.6::DOUBLE WHEN series_id = 'S5' AND k >= 3 THEN 0.25::DOUBLE ELSE 1::DOUBLE END ELSE value END, 2) AS value FROM nu WHERE k <= 3),
st AS (SELECT *, lag(value) OVER (PARTITION BY series_id, ref_period ORDER BY known_at) AS before FROM ar),
rb AS (SELECT series_id, known_at, count(*) AS periods, sum(value) / sum(before) AS ratio FROM st WHERE value IS NOT NULL AND before <> 0 GROUP BY 1, 2 HAVING count(*) >= 3 AND max(value / before) - min(value / before) <= 0.001 * abs(sum(value) / sum(before)) AND abs(sum(value) / sum(before) - 1) > 0.01)"""


@query("rebases_found", f"WITH {ARCHIVE} SELECT series_id, known_at, periods, round(ratio, 6) AS ratio FROM rb")
def _(spark, d):
    return macro.rebases(archive(spark, d)).withColumn("ratio", F.round("ratio", 6))


@query("levels_in_last_units", f"WITH {ARCHIVE} SELECT series_id, CAST(ref_period AS VARCHAR) AS ref_period, known_at, vintage_seq, value, round(coalesce((SELECT product(ratio) FROM rb WHERE rb.series_id = ar.series_id AND rb.known_at > ar.known_at), 1), 6) AS factor, round(value * coalesce((SELECT product(ratio) FROM rb WHERE rb.series_id = ar.series_id AND rb.known_at > ar.known_at), 1), 3) AS level FROM ar")
def _(spark, d):
    rows = macro.units(archive(spark, d))
    return rows.withColumns({"ref_period": period(), "factor": F.round("factor", 6), "level": F.round("level", 3)})


@query("revision_top_k_without_rebases", f"""WITH {ARCHIVE}, r AS (SELECT *, lead(value) OVER w AS second, row_number() OVER w AS n, count(*) OVER (PARTITION BY series_id, ref_period) AS vintages FROM ar WINDOW w AS (PARTITION BY series_id, ref_period ORDER BY known_at))
SELECT series_id, CAST(ref_period AS VARCHAR) AS ref_period, value AS first, second, round(second - value, 2) AS revision, round(100 * (second - value) / nullif(abs(value), 0), 4) AS pct, vintages FROM r
WHERE n = 1 AND value <> second AND series_id NOT IN (SELECT series_id FROM rb) ORDER BY abs(round(second - value, 2)) DESC, series_id, ref_period LIMIT 20""")
def _(spark, d):
    return macro.top_revisions(archive(spark, d), 20).withColumn("ref_period", period())


@query("revised_period_count", f"""WITH r AS (SELECT *, {EARLIEST} AS a, {LATEST} AS z FROM vintage),
e AS (SELECT series_id, ref_period, max(value) FILTER (WHERE a = 1) AS first, max(value) FILTER (WHERE z = 1) AS last FROM r GROUP BY 1, 2)
SELECT series_id, count(*) AS periods, count(*) FILTER (WHERE first IS DISTINCT FROM last) AS revised FROM e GROUP BY 1""")
def _(spark, d):
    return macro.revised_periods(vintages(spark, d))


DEDUPED = "row_number() OVER (PARTITION BY instrument, ts, source ORDER BY bid, ask, seq)"


@query("ticks_as_of", f"SELECT instrument, ts, source, bid, ask, seq FROM (SELECT *, {DEDUPED} AS k FROM tick WHERE ts <= {NOW} AND instrument = 'purchase' AND bid <= ask) WHERE k = 1")
def _(spark, d):
    return asof.ticks_as_of(ticks(spark, d), NOW, "purchase")


def doubled(spark, d):
    t = ticks(spark, d)
    return t.unionByName(t.where("seq % 50 = 0").withColumn("bid", F.col("bid") + 0.5).withColumn("ask", F.col("ask") + 0.5).withColumn("seq", F.col("seq") + 10_000_000))


@query("ticks_dedupe", f"""WITH two AS (SELECT * FROM tick UNION ALL SELECT instrument, ts, bid + CAST(0.5 AS DOUBLE), ask + CAST(0.5 AS DOUBLE), source, seq + 10000000 FROM tick WHERE seq % 50 = 0)
SELECT instrument, ts, source, bid, ask, seq FROM (SELECT *, {DEDUPED} AS k FROM two WHERE bid <= ask) WHERE k = 1""")
def _(spark, d):
    return asof.dedupe(asof.clean(doubled(spark, d)))


def bar_sql(length: int) -> str:
    cells = ", ".join(f"arg_min({s}, (ts, seq)) AS {s}_open, max({s}) AS {s}_high, min({s}) AS {s}_low, arg_max({s}, (ts, seq)) AS {s}_close" for s in ("bid", "ask"))
    return f"bar AS (SELECT instrument, source, ts - ts % {length} AS minute, {cells}, count(*) AS tick_count FROM tick GROUP BY 1, 2, 3)"


@query("bars_1m", f"WITH {bar_sql(MINUTE)} SELECT * FROM bar")
def _(spark, d):
    return bars.bars_from_ticks(ticks(spark, d))


@query("bars_1h", f"WITH {bar_sql(HOUR)} SELECT * FROM bar")
def _(spark, d):
    return bars.bars_from_ticks(ticks(spark, d), HOUR)


@query("bars_1h_from_partials", f"WITH {bar_sql(HOUR)} SELECT * FROM bar")
def _(spark, d):
    t = ticks(spark, d)
    return bars.merge_partials(bars.partial_bars(t.where("seq % 2 = 0"), HOUR).unionByName(bars.partial_bars(t.where("seq % 2 = 1"), HOUR)))


@query("bars_as_of_start", f"WITH {bar_sql(HOUR)} SELECT * FROM bar WHERE instrument = 'view' AND source = 'feed_a' AND minute <= {NOW}")
def _(spark, d):
    return asof.bars_as_of(bars.bars_from_ticks(ticks(spark, d), HOUR), NOW, "view", "feed_a", length=HOUR)


@query("bars_as_of_closed", f"WITH {bar_sql(HOUR)} SELECT * FROM bar WHERE instrument = 'view' AND source = 'feed_a' AND minute + {HOUR} <= {NOW}")
def _(spark, d):
    return asof.bars_as_of(bars.bars_from_ticks(ticks(spark, d), HOUR), NOW, "view", "feed_a", mode="closed", length=HOUR)


@query("bar_coverage", f"WITH {bar_sql(MINUTE)} SELECT instrument, source, count(*) AS bars, CAST(sum(tick_count) AS BIGINT) AS ticks, min(minute) AS first_minute, max(minute) AS last_minute FROM bar GROUP BY 1, 2")
def _(spark, d):
    return bars.coverage(bars.bars_from_ticks(ticks(spark, d)))


@query("bars_reconcile", f"WITH {bar_sql(MINUTE)}, h AS (SELECT instrument, CAST(sum(tick_count) AS BIGINT) AS in_bars FROM bar GROUP BY 1) SELECT instrument, count(*) AS stored, any_value(in_bars) AS in_bars, count(*) - any_value(in_bars) AS missing FROM tick JOIN h USING (instrument) GROUP BY 1")
def _(spark, d):
    t = ticks(spark, d)
    return bars.reconcile(bars.bars_from_ticks(t), t)


@query("flag_feed_disagreement", f"""WITH {bar_sql(HOUR)}, a AS (SELECT * FROM bar WHERE source = 'feed_a'), b AS (SELECT * FROM bar WHERE source = 'feed_b')
SELECT coalesce(a.instrument, b.instrument) AS instrument, coalesce(a.minute, b.minute) AS minute, a.bid_close AS a_bid, a.ask_close AS a_ask, b.bid_close AS b_bid, b.ask_close AS b_ask,
CASE WHEN a.minute IS NULL OR b.minute IS NULL THEN 'gap' WHEN abs(a.bid_close - b.bid_close) > 50 OR abs(a.ask_close - b.ask_close) > 50 THEN 'disagree' ELSE 'agree' END AS verdict
FROM a FULL JOIN b ON a.instrument = b.instrument AND a.minute = b.minute""")
def _(spark, d):
    return bars.cross_feed(bars.bars_from_ticks(ticks(spark, d), HOUR), "feed_a", "feed_b", 50.0).select("instrument", "minute", "a_bid", "a_ask", "b_bid", "b_ask", "verdict")


def coarse(spark, d):
    """Quotes in steps of 25, which makes runs of equal ones."""
    return ticks(spark, d).withColumn("bid", F.floor(F.col("bid") / 25).cast("double")).withColumn("ask", F.col("bid"))


FLAG = {
    "crossed": "SELECT instrument, ts, seq, 'crossed' AS flag FROM tick WHERE bid > ask",
    "zero_spread": "SELECT instrument, ts, seq, 'zero_spread' AS flag FROM tick WHERE bid = ask",
    "spread_outlier": f"""SELECT t.instrument, t.ts, t.seq, 'spread_outlier' AS flag FROM tick t JOIN (SELECT instrument, ts - ts % {HOUR} AS hr, list_sort(list(ask - bid))[least(count(*), floor(0.5 * count(*))::INT + 1)] AS median FROM tick WHERE ask >= bid GROUP BY 1, 2) h
      ON t.instrument = h.instrument AND t.ts - t.ts % {HOUR} = h.hr WHERE h.median > 0 AND t.ask - t.bid > 5.0 * h.median""",
    "session_gap": f"SELECT instrument, ts, seq, 'session_gap' AS flag FROM (SELECT *, lag(ts) OVER (PARTITION BY instrument ORDER BY ts, seq) AS p FROM tick) WHERE ts - p >= {120 * MINUTE}",
}


def _detector(name, find):
    @query(f"flag_{name}", FLAG[name])
    def _(spark, d):
        return find(ticks(spark, d)).drop("detail")


for _name, _find in (("crossed", flags.crossed), ("zero_spread", flags.zero_spread), ("spread_outlier", flags.spread_outlier), ("session_gap", flags.session_gap)):
    _detector(_name, _find)


STALE = """WITH c AS (SELECT instrument, ts, seq, floor(bid / 25) AS q FROM tick),
l AS (SELECT *, CASE WHEN q = lag(q) OVER (PARTITION BY instrument ORDER BY ts, seq) THEN 0 ELSE 1 END AS changed FROM c),
g AS (SELECT *, sum(changed) OVER (PARTITION BY instrument ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS island FROM l),
n AS (SELECT *, row_number() OVER (PARTITION BY instrument, island ORDER BY ts, seq) AS run FROM g)
SELECT instrument, ts, seq, 'stale' AS flag FROM n WHERE run >= 4"""


@query("flag_stale", STALE)
def _(spark, d):
    return flags.stale(coarse(spark, d)).drop("detail")


NY = "epoch_us(timezone('America/New_York', {}))"
DAYS = f"SELECT CAST(unnest(generate_series({FIRST_DAY}, {NEXT_DAY} - 1, INTERVAL 1 DAY)) AS DATE) AS day"
MARKET = f"""market AS (SELECT {NY.format("day + INTERVAL 17 HOUR")} AS span_start, {NY.format("day + INTERVAL 5 DAY + INTERVAL 17 HOUR")} AS span_end
  FROM (SELECT CAST(unnest(generate_series({FIRST_DAY} - 7, {NEXT_DAY} - 1, INTERVAL 1 DAY)) AS DATE) AS day) WHERE isodow(day) = 7)"""
MARKET_HELD = f"SELECT * FROM market WHERE span_start < epoch_us(CAST({NEXT_DAY} AS TIMESTAMP)) AND span_end > epoch_us(CAST({FIRST_DAY} AS TIMESTAMP))"
ROLL = f"""roll AS (SELECT day, {NY.format("day + INTERVAL 17 HOUR")} AS span_start, {NY.format("day + INTERVAL 18 HOUR")} AS span_end
  FROM (SELECT CAST(unnest(generate_series({FIRST_DAY} - 7, {NEXT_DAY} + 6, INTERVAL 1 DAY)) AS DATE) AS day) WHERE isodow(day) < 6)"""
CALENDAR = f"""{MARKET}, held AS ({MARKET_HELD}), {ROLL},
cal AS (SELECT h AS hour, EXISTS (SELECT 1 FROM held m WHERE h >= m.span_start AND h < m.span_end) AS market_open, EXISTS (SELECT 1 FROM roll r WHERE h >= r.span_start AND h < r.span_end) AS rollover
  FROM (SELECT unnest(range((SELECT min(span_start) FROM held), (SELECT max(span_end) FROM held) + 1, {HOUR})) AS h))"""


@query("session_windows", "WITH s AS (SELECT * FROM (VALUES ('sydney','Australia/Sydney',7,16),('tokyo','Asia/Tokyo',9,18),('london','Europe/London',8,17),('new_york','America/New_York',8,17)) AS v(session, zone, a, b))"
       f" SELECT session, CAST(day AS VARCHAR) AS day, epoch_us(timezone(zone, day + a * INTERVAL 1 HOUR)) AS span_start, epoch_us(timezone(zone, day + b * INTERVAL 1 HOUR)) AS span_end FROM s, ({DAYS})")
def _(spark, d):
    return sessions.session_windows(spark, *span(spark, d)).withColumn("day", F.col("day").cast("string"))


@query("market_windows", f"WITH {MARKET} {MARKET_HELD}")
def _(spark, d):
    return sessions.market_windows(spark, *span(spark, d))


@query("rollover_windows", f"WITH {ROLL} SELECT CAST(day AS VARCHAR) AS day, span_start, span_end FROM roll WHERE day >= {FIRST_DAY} AND day < {NEXT_DAY}")
def _(spark, d):
    return sessions.rollover_windows(spark, *span(spark, d)).withColumn("day", F.col("day").cast("string"))


OVERLAP = f"""SELECT day, greatest(epoch_us(timezone('Europe/London', day + INTERVAL 8 HOUR)), epoch_us(timezone('America/New_York', day + INTERVAL 8 HOUR))) AS span_start,
least(epoch_us(timezone('Europe/London', day + INTERVAL 17 HOUR)), epoch_us(timezone('America/New_York', day + INTERVAL 17 HOUR))) AS span_end
FROM (SELECT CAST(unnest(generate_series(make_date(year({FIRST_DAY}), 1, 1), make_date(year({FIRST_DAY}), 12, 31), INTERVAL 1 DAY)) AS DATE) AS day)"""


@query("london_ny_overlap", f"SELECT CAST(day AS VARCHAR) AS day, span_start, span_end, greatest(0, span_end - span_start) / CAST({HOUR} AS DOUBLE) AS hours FROM ({OVERLAP})")
def _(spark, d):
    year = span(spark, d)[0].year
    return sessions.london_ny_overlap(spark, date(year, 1, 1), date(year + 1, 1, 1)).withColumn("day", F.col("day").cast("string"))


@query("dst_offset_weeks", f"""WITH o AS (SELECT day, greatest(0, span_end - span_start) / CAST({HOUR} AS DOUBLE) AS hours, row_number() OVER (ORDER BY day) AS k FROM ({OVERLAP}) WHERE isodow(day) < 6),
u AS (SELECT hours AS usual FROM o GROUP BY 1 ORDER BY count(*) DESC, min(day) LIMIT 1),
i AS (SELECT *, k - row_number() OVER (ORDER BY day) AS island FROM o, u WHERE hours <> usual)
SELECT CAST(min(day) AS VARCHAR) AS first_day, CAST(max(day) AS VARCHAR) AS last_day, count(*) AS days, arg_min(hours, day) AS hours, arg_min(hours, day) - any_value(usual) AS difference FROM i GROUP BY island""")
def _(spark, d):
    return sessions.dst_offset_weeks(spark, span(spark, d)[0].year).withColumns({c: F.col(c).cast("string") for c in ("first_day", "last_day")})


@query("calendar_hour", f"WITH {CALENDAR} SELECT * FROM cal")
def _(spark, d):
    return sessions.calendar_hours(spark, *span(spark, d))


@query("flag_rollover", f"WITH {CALENDAR} SELECT instrument, ts, seq, 'rollover_window' AS flag FROM tick JOIN cal ON ts - ts % {HOUR} = hour WHERE rollover")
def _(spark, d):
    return flags.rollover_window(ticks(spark, d), sessions.calendar_hours(spark, *span(spark, d))).drop("detail")


@query("flag_weekend", f"WITH {CALENDAR} SELECT instrument, ts, seq, 'weekend_gap' AS flag FROM tick JOIN cal ON ts - ts % {HOUR} = hour WHERE NOT market_open")
def _(spark, d):
    return flags.weekend_gap(ticks(spark, d), sessions.calendar_hours(spark, *span(spark, d))).drop("detail")


LEGS = [("click", "EUR"), ("click", "USD"), ("view", "USD"), ("view", "JPY"), ("error", "GBP"), ("error", "USD")]
#: A currency's holidays, for want of others: the three days with the fewest quotes of its instruments, of equal ones the earlier.
HOL_SQL = f"""legs AS (SELECT * FROM (VALUES {', '.join(map(str, LEGS))}) AS v(instrument, currency)),
dq AS (SELECT currency, CAST(make_timestamp(ts) AS DATE) AS d, count(*) AS n FROM tick JOIN legs USING (instrument) GROUP BY 1, 2),
hol AS (SELECT currency, d FROM (SELECT *, row_number() OVER (PARTITION BY currency ORDER BY n, d) AS k FROM dq) WHERE k <= 3)"""


@query("flag_holiday_thin", f"WITH {HOL_SQL} SELECT t.instrument, t.ts, t.seq, 'holiday_thin' AS flag FROM tick t JOIN legs USING (instrument) JOIN hol ON hol.currency = legs.currency AND CAST(make_timestamp(t.ts) AS DATE) = hol.d")
def _(spark, d):
    return flags.holiday_thin(ticks(spark, d), *calendar_tables(spark, d)).drop("detail")


def calendar_tables(spark, d):
    legs = spark.createDataFrame(LEGS, "instrument string, currency string")
    daily = ticks(spark, d).groupBy("instrument", day_of("ts").alias("holiday_date")).agg(F.count("*").alias("n"))
    per = daily.join(legs, "instrument").groupBy("currency", "holiday_date").agg(F.sum("n").alias("n"))  # a row for each day
    thinnest = F.row_number().over(Window.partitionBy("currency").orderBy("n", "holiday_date"))
    return legs, per.withColumn("k", thinnest).where("k <= 3").select("currency", "holiday_date")


@query("describe_holidays", f"""WITH {HOL_SQL}, c AS (SELECT instrument, d, string_agg(DISTINCT currency, ',' ORDER BY currency) AS holidays FROM legs JOIN hol USING (currency) GROUP BY 1, 2)
SELECT t.instrument, t.ts, t.seq, coalesce(holidays, '') AS holidays FROM tick t LEFT JOIN c ON c.instrument = t.instrument AND c.d = CAST(make_timestamp(t.ts) AS DATE)""")
def _(spark, d):
    return sessions.holidays_of(ticks(spark, d).select("instrument", "ts", "seq"), *calendar_tables(spark, d))


@query("holidays_by_currency", f"WITH {HOL_SQL} SELECT currency, count(DISTINCT d) AS holidays, CAST(min(d) AS VARCHAR) AS first_day, CAST(max(d) AS VARCHAR) AS last_day FROM hol GROUP BY 1")
def _(spark, d):
    rows = sessions.holidays_by_currency(calendar_tables(spark, d)[1])
    return rows.select("currency", "holidays", F.col("first_day").cast("string").alias("first_day"), F.col("last_day").cast("string").alias("last_day"))


PURE = " UNION ALL ".join(f"({FLAG[k]})" for k in ("crossed", "zero_spread", "spread_outlier", "session_gap"))


def stored_ticks(spark, d, name):
    """A new folder whose tick_raw has the quotes."""
    folder = tables.scratch(spark, name)
    store.append_hours(ticks(spark, d), folder)
    return folder


def pure_flags(spark, d):
    return flags.scan(ticks(spark, d), None, None, None, ["crossed", "zero_spread", "spread_outlier", "session_gap"])


@query("flag_totals", f"WITH f AS ({PURE}), n AS (SELECT instrument, count(*) AS ticks FROM tick GROUP BY 1) SELECT f.instrument, flag, count(*) AS flags, any_value(ticks) AS ticks, round(CAST(100.0 AS DOUBLE) * count(*) / any_value(ticks), 4) AS pct FROM f JOIN n USING (instrument) GROUP BY 1, 2")
def _(spark, d):
    return flags.totals(pure_flags(spark, d), ticks(spark, d))


@query("flags_by_hour", f"WITH f AS ({PURE}) SELECT flag, CAST((ts % {DAY}) // {HOUR} AS INT) AS hour_of_day, count(*) AS flags FROM f GROUP BY 1, 2")
def _(spark, d):
    return flags.by_hour(pure_flags(spark, d))


@query("flagged_share", f"WITH f AS ({PURE}) SELECT (SELECT count(*) FROM (SELECT DISTINCT instrument, ts FROM f)) AS flagged, (SELECT count(*) FROM tick) AS ticks, round((SELECT count(*) FROM (SELECT DISTINCT instrument, ts FROM f)) / CAST(nullif((SELECT count(*) FROM tick), 0) AS DOUBLE), 6) AS share")
def _(spark, d):
    return flags.flagged_share(pure_flags(spark, d), ticks(spark, d))


DAY_ASKED = instant(datetime(2024, 1, 9, tzinfo=timezone.utc))


DETAIL = f"""f AS (SELECT instrument, ts, 'crossed' AS flag, printf('bid=%.5f ask=%.5f spread=%.5f', bid, ask, ask - bid) AS detail FROM tick WHERE bid > ask
UNION ALL SELECT instrument, ts, 'zero_spread', printf('price=%.5f', bid) FROM tick WHERE bid = ask
UNION ALL SELECT t.instrument, t.ts, 'spread_outlier', printf('spread=%.5f median=%.5f ratio=%.2f', ask - bid, median, (ask - bid) / median) FROM tick t JOIN (SELECT instrument, ts - ts % {HOUR} AS hr, list_sort(list(ask - bid))[least(count(*), floor(0.5 * count(*))::INT + 1)] AS median FROM tick WHERE ask >= bid GROUP BY 1, 2) h
  ON t.instrument = h.instrument AND t.ts - t.ts % {HOUR} = h.hr WHERE h.median > 0 AND t.ask - t.bid > 5.0 * h.median
UNION ALL SELECT instrument, ts, 'session_gap', printf('minutes=%d previous=%d', (ts - p) // {MINUTE}, p) FROM (SELECT *, lag(ts) OVER (PARTITION BY instrument ORDER BY ts, seq) AS p FROM tick) WHERE ts - p >= {120 * MINUTE})"""


@query("explain_day", f"""WITH {DETAIL}, u AS (SELECT DISTINCT ts, flag, detail FROM f WHERE instrument = 'click' AND ts >= {DAY_ASKED} AND ts < {DAY_ASKED + DAY}),
m AS (SELECT ts, string_agg(flag, ',' ORDER BY flag, detail) AS flags, string_agg(detail, '; ' ORDER BY flag, detail) AS details FROM u GROUP BY 1),
q AS (SELECT ts, min(bid) AS bid, min(ask) AS ask FROM tick WHERE instrument = 'click' GROUP BY 1) SELECT m.ts, flags, details, bid, ask FROM m LEFT JOIN q USING (ts)""")
def _(spark, d):
    rows = flags.explain_day(pure_flags(spark, d), ticks(spark, d), "click", DAY_ASKED)
    return rows.withColumns({"flags": F.array_join("flags", ","), "details": F.array_join("details", "; ")})


@query("flags_rescanned", f"""WITH {DETAIL} SELECT instrument, flag, count(*) AS flags, count(*) FILTER (WHERE detail = 'old') AS old FROM (
  SELECT instrument, ts, flag, CASE WHEN flag IN ('crossed', 'session_gap') AND instrument IN ('click', 'view') AND ts >= {DAY_ASKED} AND ts < {DAY_ASKED + DAY} THEN 'new' ELSE 'old' END AS detail FROM f) GROUP BY 1, 2""")
def _(spark, d):
    folder = stored_ticks(spark, d, "flags")
    tables.append(pure_flags(spark, d).withColumn("detail", F.lit("old")), folder, "tick_flag")
    report = flags.rescan(spark, folder, None, None, None, ["click", "view"], DAY_ASKED, DAY_ASKED + DAY, ["crossed", "session_gap"])
    assert not report.errors and report.written == report.deleted, report
    return tables.read(spark, folder, "tick_flag").groupBy("instrument", "flag").agg(F.count("*").alias("flags"), F.count_if(F.col("detail") == "old").alias("old"))


SESSION_SQL = f"""s AS (SELECT session, epoch_us(timezone(zone, day + a * INTERVAL 1 HOUR)) AS span_start, epoch_us(timezone(zone, day + b * INTERVAL 1 HOUR)) AS span_end
  FROM (VALUES ('sydney','Australia/Sydney',7,16),('tokyo','Asia/Tokyo',9,18),('london','Europe/London',8,17),('new_york','America/New_York',8,17)) AS v(session, zone, a, b), ({DAYS}))"""


@query("describe_instants", f"""WITH {SESSION_SQL}, {MARKET}, held AS ({MARKET_HELD}), {ROLL}, i AS (SELECT DISTINCT ts FROM tick),
n AS (SELECT i.ts, string_agg(DISTINCT session, ',' ORDER BY session) AS sessions, count(DISTINCT session) AS k FROM i JOIN s ON i.ts >= span_start AND i.ts < span_end GROUP BY 1)
SELECT i.ts, coalesce(sessions, '') AS sessions, coalesce(k > 1, false) AS in_overlap, EXISTS (SELECT 1 FROM held m WHERE i.ts >= m.span_start AND i.ts < m.span_end) AS market_open,
EXISTS (SELECT 1 FROM roll r WHERE r.day >= {FIRST_DAY} AND r.day < {NEXT_DAY} AND i.ts >= r.span_start AND i.ts < r.span_end) AS is_rollover FROM i LEFT JOIN n USING (ts)""")
def _(spark, d):
    return sessions.describe(ticks(spark, d), sessions.session_windows(spark, *span(spark, d)), sessions.market_windows(spark, *span(spark, d)), sessions.rollover_windows(spark, *span(spark, d)))


@query("session_coverage", f"WITH {SESSION_SQL} SELECT session, count(*) AS windows, min(span_start) AS first_start, max(span_end) AS last_end, CAST(sum(span_end - span_start) AS BIGINT) // {HOUR} AS hours FROM s GROUP BY 1")
def _(spark, d):
    rows = sessions.session_windows(spark, *span(spark, d)).groupBy("session")
    return rows.agg(F.count("*").alias("windows"), F.min("span_start").alias("first_start"), F.max("span_end").alias("last_end"), F.expr(f"sum(span_end - span_start) div {HOUR}").alias("hours"))


def ledger_of(spark, d):
    """A ledger of the hours that have quotes: of every 7th the fetch failed, of every 11th it is under way."""
    hourly = ticks(spark, d).groupBy("instrument", floor_to("ts", HOUR).alias("hour"), "source").agg(F.count("*").alias("n"))
    k = F.expr(f"hour div {HOUR}")
    status = F.when(k % 11 == 0, "in_progress").when(k % 7 == 0, "error").when(k % 13 == 0, "empty").otherwise("ok")
    return hourly.select("instrument", "hour", "source", status.alias("status"), F.when(status == "ok", F.col("n")).alias("tick_count"), F.lit(None).cast("long").alias("byte_count"), F.lit(1).alias("attempts"), F.lit(None).cast("string").alias("detail"), F.col("hour").alias("claimed_at"), F.when(status != "in_progress", F.col("hour")).alias("completed_at"))


LEDGER = f"""led AS (SELECT instrument, hour, source, status, CASE WHEN status = 'ok' THEN n END AS tick_count FROM (SELECT *, CASE WHEN (hour // {HOUR}) % 11 = 0 THEN 'in_progress' WHEN (hour // {HOUR}) % 7 = 0 THEN 'error' WHEN (hour // {HOUR}) % 13 = 0 THEN 'empty' ELSE 'ok' END AS status
  FROM (SELECT instrument, ts - ts % {HOUR} AS hour, source, count(*) AS n FROM tick GROUP BY 1, 2, 3)))"""
FROM_US, TO_US = (int((x - date(1970, 1, 1)).days) * DAY for x in (START, END))


@query("settled_antijoin", f"WITH {LEDGER}, want AS (SELECT i.instrument, h.hour, 'feed_a' AS source FROM (SELECT DISTINCT instrument FROM tick) i, (SELECT unnest(range({FROM_US}, {TO_US}, {HOUR})) AS hour) h) SELECT w.* FROM want w WHERE NOT EXISTS (SELECT 1 FROM led l WHERE l.instrument = w.instrument AND l.hour = w.hour AND l.source = w.source AND status IN ('ok', 'empty', 'missing'))")
def _(spark, d):
    names = ticks(spark, d).select("instrument").distinct()
    wanted = names.select("instrument", F.explode(F.expr(f"sequence({FROM_US}L, {TO_US - HOUR}L, {HOUR}L)")).alias("hour"), F.lit("feed_a").alias("source"))
    return ledger.to_do(wanted, ledger_of(spark, d))


@query("ledger_summary", f"WITH {LEDGER} SELECT instrument, " + ", ".join(f"count(*) FILTER (WHERE status = '{s}') AS n_{s}" for s in ("ok", "empty", "missing", "error", "in_progress")) + ", CAST(coalesce(sum(tick_count), 0) AS BIGINT) AS ticks FROM led GROUP BY 1")
def _(spark, d):
    return ledger.summary(ledger_of(spark, d))


@query("ledger_monthly", f"WITH {LEDGER} SELECT instrument, strftime(make_timestamp(hour), '%Y-%m') AS month, count(*) AS hours, count(*) FILTER (WHERE status IN ('ok', 'empty', 'missing')) AS settled, CAST(coalesce(sum(tick_count), 0) AS BIGINT) AS ticks FROM led GROUP BY 1, 2")
def _(spark, d):
    return ledger.monthly(ledger_of(spark, d))


@query("ledger_claim_settle", f"WITH {LEDGER} SELECT instrument, hour, source, CASE WHEN status = 'error' THEN 'ok' ELSE status END AS status, CASE WHEN status = 'error' THEN 0 ELSE tick_count END AS tick_count, CASE WHEN status = 'error' THEN 2 ELSE 1 END AS attempts FROM led")
def _(spark, d):
    held = ledger_of(spark, d)
    failed = held.where("status = 'error'")
    results = failed.select("instrument", "hour", "source", F.lit("ok").alias("status"), F.lit(0).cast("long").alias("tick_count"), F.lit(0).cast("long").alias("byte_count"), F.lit("again").alias("detail"))
    return ledger.settle(ledger.claim(held, failed, NOW), results, NOW).select("instrument", "hour", "source", "status", "tick_count", "attempts")


@query("rows_by_instrument", "SELECT instrument, count(*) AS ticks, min(ts) AS first_ts, max(ts) AS last_ts, count(*) FILTER (WHERE bid > ask) AS crossed, round(avg(ask - bid), 7) AS mean_spread FROM tick GROUP BY 1")
def _(spark, d):
    return ledger.rows_by_instrument(ticks(spark, d))


@query("rows_by_hour", f"SELECT instrument, source, ts - ts % {HOUR} AS hour, count(*) AS ticks FROM tick GROUP BY 1, 2, 3")
def _(spark, d):
    return ledger.rows_by_hour(ticks(spark, d))


def fixes_of(t):
    """Each day's mean bid of each instrument as its fix of 14:15 in Berlin."""
    daily = t.groupBy("instrument", F.expr(f"date_from_unix_date(cast(ts div {DAY} AS int))").alias("day")).agg(F.round(F.avg("bid"), 9).alias("rate"))
    return daily.select("instrument", local_instant("day", 14, "Europe/Berlin", 15).alias("fix_at"), "rate")


@query("drift_anchor", f"""WITH fixes AS (SELECT instrument, epoch_us(timezone('Europe/Berlin', CAST(make_timestamp(dy * {DAY}) AS DATE) + INTERVAL 14 HOUR + INTERVAL 15 MINUTE)) AS fix_at, round(avg(bid), 9) AS rate FROM (SELECT *, ts // {DAY} AS dy FROM tick) GROUP BY instrument, dy)
SELECT f.instrument, fix_at, rate, round(avg((bid + ask) / 2), 9) AS mean_mid, count(*) AS ticks, round((avg((bid + ask) / 2) - rate) / 0.01::DOUBLE, 6) AS diff_pips FROM fixes f JOIN tick t ON t.instrument = f.instrument AND t.ts BETWEEN fix_at - {HOUR} AND fix_at + {HOUR} WHERE bid <= ask GROUP BY 1, 2, 3""")
def _(spark, d):
    t = ticks(spark, d)
    rows = monitors.drift_anchor(fixes_of(t), t, 0.01, HOUR, digits=6)
    return rows.select("instrument", "fix_at", "rate", F.round("mean_mid", 9).alias("mean_mid"), "ticks", "diff_pips")


@query("drift_summary", ORACLE_SQL["drift_anchor"].replace("SELECT f.instrument, fix_at, rate,", ", o AS (SELECT f.instrument, fix_at, rate,") + ") SELECT count(*) AS compared, (SELECT count(*) FROM fixes) - count(*) AS skipped_no_ticks, count(*) FILTER (WHERE abs(diff_pips) > 2) AS alerts, round(avg(diff_pips), 4) AS mean_pips, round(max(abs(diff_pips)), 4) AS max_abs_pips FROM o")
def _(spark, d):
    t = ticks(spark, d)
    fixes = fixes_of(t)
    return monitors.drift_summary(fixes, monitors.drift_anchor(fixes, t, 0.01, HOUR, digits=6))


@query("spread_by_hour", f"""WITH c AS (SELECT instrument, CAST((ts % {DAY}) // {HOUR} AS INT) AS hour_of_day, ask - bid AS spread FROM tick WHERE bid <= ask)
SELECT instrument, hour_of_day, count(*) AS ticks, list_sort(list(spread))[least(count(*), floor(0.5 * count(*))::INT + 1)] AS median, list_sort(list(spread))[least(count(*), floor(0.95 * count(*))::INT + 1)] AS p95, max(spread) AS widest FROM c GROUP BY 1, 2""")
def _(spark, d):
    return monitors.spread_by_hour(ticks(spark, d))


@query("tick_rate_by_hour", f"""WITH h AS (SELECT instrument, ts - ts % {HOUR} AS hour, count(*) AS ticks FROM tick GROUP BY 1, 2), m AS (SELECT instrument, list_sort(list(ticks))[least(count(*), floor(0.5 * count(*))::INT + 1)] AS median FROM h GROUP BY 1)
SELECT instrument, hour, ticks, median, round(ticks / CAST(median AS DOUBLE), 4) AS ratio FROM h JOIN m USING (instrument)""")
def _(spark, d):
    return monitors.tick_rate_by_hour(ticks(spark, d))


RATES = f"rates AS (SELECT CAST(CAST(make_timestamp(dy * {DAY}) AS DATE) AS VARCHAR) AS fix_date, instrument AS currency, round(avg(bid), 9) AS rate FROM (SELECT *, ts // {DAY} AS dy FROM tick) WHERE dy % 7 <> 0 GROUP BY dy, instrument)"


@query("ecb_unpivot", f"WITH {RATES} SELECT * FROM rates")
def _(spark, d):
    return unpivot_rates(reference_rates_wide(spark, d)).withColumn("fix_date", F.col("fix_date").cast("string"))


@query("ecb_coverage", f"WITH {RATES} SELECT currency, count(*) AS days, min(fix_date) AS first_date, max(fix_date) AS last_date FROM rates GROUP BY 1")
def _(spark, d):
    return monitors.rate_coverage(unpivot_rates(reference_rates_wide(spark, d))).withColumns({c: F.col(c).cast("string") for c in ("first_date", "last_date")})


MONTHLY = "mo AS (SELECT series_id, ref_period, round(avg(value), 8) AS value FROM vintage WHERE value IS NOT NULL GROUP BY 1, 2)"
SURPRISE = f"""{MONTHLY}, ch AS (SELECT *, value - lag(value) OVER (PARTITION BY series_id ORDER BY ref_period) AS change FROM mo),
mn AS (SELECT *, avg(change) OVER w AS mean, count(change) OVER w AS n FROM ch WINDOW w AS (PARTITION BY series_id ORDER BY ref_period ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING))"""


def monthly_means(spark, d):
    return vintages(spark, d).where("value IS NOT NULL").groupBy("series_id", "ref_period").agg(F.round(F.avg("value"), 8).alias("value"))


@query("surprise_12", f"WITH {SURPRISE} SELECT series_id, CAST(ref_period AS VARCHAR) AS ref_period, round(change, 7) AS change, round(change - mean, 7) AS surprise FROM mn WHERE n = 12 AND change IS NOT NULL")
def _(spark, d):
    return macro.surprises(monthly_means(spark, d)).select("series_id", period(), F.round("change", 7).alias("change"), F.round("surprise", 7).alias("surprise"))


@query("release_filter", "WITH p AS (SELECT series_id, known_at, max(ref_period) AS ref_period FROM vintage GROUP BY 1, 2), b AS (SELECT *, max(ref_period) OVER (PARTITION BY series_id ORDER BY known_at ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM p) SELECT series_id, known_at, CAST(ref_period AS VARCHAR) AS ref_period FROM b WHERE before IS NULL OR ref_period > before")
def _(spark, d):
    return macro.releases(vintages(spark, d)).select("series_id", "known_at", period())


@query("price_forward_asof", f"""WITH ask AS (SELECT seq AS ask_id, instrument, ts + 1 AS ask_at FROM tick)
SELECT ask_id, a.instrument, ask_at, t.ts, t.seq, t.bid, t.ask FROM ask a LEFT JOIN LATERAL (SELECT * FROM tick t WHERE t.instrument = a.instrument AND t.ts >= a.ask_at AND t.ts <= a.ask_at + {30 * MINUTE} AND bid <= ask ORDER BY ts, seq LIMIT 1) t ON true""")
def _(spark, d):
    t = ticks(spark, d)
    asks = t.select(F.col("seq").alias("ask_id"), "instrument", (F.col("ts") + 1).alias("ask_at"))
    return asof.forward_asof(asks, t, 30 * MINUTE)


RELEASES_FROM, RELEASES_TO = (instant(datetime(y, 1, 1, tzinfo=timezone.utc)) for y in (1997, 2001))
RELEASES = f"""p AS (SELECT series_id, known_at, max(ref_period) AS ref_period FROM vintage GROUP BY 1, 2),
b AS (SELECT *, max(ref_period) OVER (PARTITION BY series_id ORDER BY known_at ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM p),
rel AS (SELECT series_id, known_at AS released_at, ref_period AS period FROM b WHERE (before IS NULL OR ref_period > before) AND known_at >= {RELEASES_FROM} AND known_at < {RELEASES_TO}),
pub AS (SELECT series_id, released_at, period, ref_period, value FROM (SELECT r.*, v.ref_period, v.value, row_number() OVER (PARTITION BY r.series_id, r.released_at, v.ref_period ORDER BY v.known_at DESC, v.vintage_seq DESC) AS k FROM rel r JOIN vintage v ON v.series_id = r.series_id AND v.known_at <= r.released_at) WHERE k = 1 AND value IS NOT NULL),
c1 AS (SELECT *, value - lag(value) OVER (PARTITION BY series_id, released_at ORDER BY ref_period) AS change FROM pub),
f1 AS (SELECT *, avg(change) OVER w AS mean, count(change) OVER w AS n FROM c1 WINDOW w AS (PARTITION BY series_id, released_at ORDER BY ref_period ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING)),
las AS (SELECT series_id, ref_period, value FROM (SELECT *, {LATEST} AS k FROM vintage) WHERE k = 1 AND value IS NOT NULL),
c2 AS (SELECT *, value - lag(value) OVER (PARTITION BY series_id ORDER BY ref_period) AS change FROM las),
f2 AS (SELECT *, avg(change) OVER w AS mean, count(change) OVER w AS n FROM c2 WINDOW w AS (PARTITION BY series_id ORDER BY ref_period ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING)),
re AS (SELECT f1.series_id, released_at, CAST(f1.ref_period AS VARCHAR) AS ref_period, f1.value AS first_print, f2.value AS final_value, round(f1.change - f1.mean, 5) AS surprise_first, round(f2.change - f2.mean, 5) AS surprise_final
FROM f1 JOIN f2 ON f2.series_id = f1.series_id AND f2.ref_period = f1.ref_period WHERE f1.ref_period = period AND f1.n = 12 AND f1.change IS NOT NULL AND f2.n = 12 AND f2.change IS NOT NULL)"""


@query("release_events", f"WITH {RELEASES} SELECT * FROM re")
def _(spark, d):
    rows = macro.release_events(vintages(spark, d), RELEASES_FROM, RELEASES_TO)
    return rows.select("series_id", "released_at", period(), "first_print", "final_value", F.round("surprise_first", 5).alias("surprise_first"), F.round("surprise_final", 5).alias("surprise_final"))


#: Which instrument a series' releases move; the quotes are of January 2024, so a release is moved there, to the same time of its run of 29 days.
MOVED = ("click", "error", "purchase", "signup", "view")


def events_of(spark, d):
    """The releases of the vintages with both surprises, each on its series' instrument."""
    found = macro.release_events(vintages(spark, d), RELEASES_FROM, RELEASES_TO)
    k = F.substring("series_id", 2, 1).cast("int")
    names = F.array(*map(F.lit, MOVED))
    at = F.lit(FROM_US + 8 * HOUR) + F.pmod(F.col("released_at") - RELEASES_FROM, F.lit(29 * DAY)) + HOUR * (k % 3)
    return found.select(F.concat_ws("-", "series_id", "released_at").alias("event_id"), names[k % 5].alias("instrument"), at.alias("release_at"), F.round("surprise_first", 5).alias("surprise_first"), F.round("surprise_final", 5).alias("surprise_final"))


TRADES = RELEASES + f""",
ev AS (SELECT series_id || '-' || released_at AS event_id, {list(MOVED)}[CAST(series_id[2:] AS INT) % 5 + 1] AS instrument, {FROM_US + 8 * HOUR} + (released_at - {RELEASES_FROM}) % {29 * DAY} + {HOUR} * (CAST(series_id[2:] AS INT) % 3) AS release_at, surprise_first, surprise_final FROM re),
arm AS (SELECT * FROM (VALUES ('A', false, false, false), ('B', true, false, false), ('C', true, true, false), ('D', true, true, true)) AS v(arm, use_revised, date_only, use_mid)),
o AS (SELECT *, CAST(-sign(CASE WHEN use_revised THEN surprise_final ELSE surprise_first END) AS INT) AS direction, CASE WHEN date_only THEN release_at - release_at % {DAY} ELSE release_at END AS entry_at FROM ev, arm),
cl AS (SELECT * FROM tick WHERE bid <= ask),
pr AS (SELECT o.*, e.bid AS eb, e.ask AS ea, x.bid AS xb, x.ask AS xa FROM o
  LEFT JOIN LATERAL (SELECT bid, ask FROM cl WHERE cl.instrument = o.instrument AND ts >= entry_at AND ts <= entry_at + {3 * HOUR} ORDER BY ts, seq LIMIT 1) e ON true
  LEFT JOIN LATERAL (SELECT bid, ask FROM cl WHERE cl.instrument = o.instrument AND ts >= entry_at + {6 * HOUR} AND ts <= entry_at + {9 * HOUR} ORDER BY ts, seq LIMIT 1) x ON true),
pe AS (SELECT *, CASE WHEN use_mid THEN (eb + ea) / 2 WHEN direction > 0 THEN ea ELSE eb END AS entry, CASE WHEN use_mid THEN (xb + xa) / 2 WHEN direction > 0 THEN xb ELSE xa END AS exit FROM pr),
us AS (SELECT *, count(*) FILTER (WHERE eb IS NOT NULL AND xb IS NOT NULL) OVER (PARTITION BY event_id) AS n FROM pe),
tr AS (SELECT event_id, arm, direction, entry, exit, direction * (exit - entry) / entry * 10000 AS return_bps FROM us WHERE n = 4 AND direction <> 0)"""


def trades_of(spark, d):
    return experiment.trades(events_of(spark, d), ticks(spark, d), 3 * HOUR, 6 * HOUR)


@query("release_hours_needed", f"""WITH {TRADES}, a AS (SELECT instrument, unnest([entry_at, entry_at + {6 * HOUR}]) AS a FROM o)
SELECT DISTINCT instrument, unnest(range(a - a % {HOUR}, a + {3 * HOUR} + 1, {HOUR})) AS hour FROM a""")
def _(spark, d):
    return experiment.hours_needed(events_of(spark, d), 6 * HOUR, 3 * HOUR)


@query("experiment_trades", f"WITH {TRADES} SELECT event_id, arm, direction, round(entry, 6) AS entry, round(exit, 6) AS exit, round(return_bps, 4) AS return_bps FROM tr")
def _(spark, d):
    return trades_of(spark, d).select("event_id", "arm", "direction", F.round("entry", 6).alias("entry"), F.round("exit", 6).alias("exit"), F.round("return_bps", 4).alias("return_bps"))


METRICS = """me AS (SELECT arm, count(*) AS n, avg(return_bps) AS mean, coalesce(stddev_samp(return_bps), 0) AS std, avg(CASE WHEN return_bps > 0 THEN 1.0 ELSE 0.0 END) AS hit_rate, sum(return_bps) AS total FROM tr GROUP BY 1)"""


@query("experiment_metrics", f"WITH {TRADES}, {METRICS} SELECT arm, n, round(mean, 3) AS mean, round(std, 3) AS std, round(hit_rate, 6) AS hit_rate, round(total, 2) AS total, round(CASE WHEN n < 2 OR std = 0 THEN 0 ELSE mean / std * sqrt(24) END, 6) AS sharpe FROM me")
def _(spark, d):
    rows = experiment.metrics(trades_of(spark, d))
    return rows.select("arm", "n", F.round("mean", 3).alias("mean"), F.round("std", 3).alias("std"), F.round("hit_rate", 6).alias("hit_rate"), F.round("total", 2).alias("total"), F.round("sharpe", 6).alias("sharpe"))


RATIO = "sh AS (SELECT *, CASE WHEN n < 2 OR std = 0 THEN 0 ELSE mean / std * sqrt(24) END AS sharpe FROM me)"


@query("experiment_gaps", f"WITH {TRADES}, {METRICS}, {RATIO}, g AS (SELECT arm, lead(arm) OVER (ORDER BY arm) AS next_arm, lead(mean) OVER (ORDER BY arm) - mean AS gap, lead(sharpe) OVER (ORDER BY arm) - sharpe AS d FROM sh) SELECT arm, next_arm, round(gap, 3) AS gap_bps, round(d, 6) AS sharpe_delta FROM g WHERE next_arm IS NOT NULL")
def _(spark, d):
    return experiment.gaps(trades_of(spark, d)).withColumn("gap_bps", F.round("gap_bps", 3)).withColumn("sharpe_delta", F.round("sharpe_delta", 6))


@query("experiment_notes", f"""WITH {TRADES}, {METRICS}, {RATIO}, w AS (SELECT coalesce(max(n) FILTER (WHERE arm = 'A'), 0) AS events, {", ".join(f"coalesce(max(sharpe) FILTER (WHERE arm = '{x}'), 0) AS {x.lower()}" for x in "ABCD")} FROM sh)
SELECT events, events < 20 AS underpowered, a < b AND b < c AND c < d AS ordering_holds, CASE greatest(b - a, c - b, d - c) WHEN b - a THEN 'revisions' WHEN c - b THEN 'coarse times' ELSE 'mid prices' END AS largest_source FROM w""")
def _(spark, d):
    return experiment.notes(trades_of(spark, d))


PAIRED = """wi AS (SELECT event_id, max(return_bps) FILTER (WHERE arm = 'A') AS a, max(return_bps) FILTER (WHERE arm = 'B') AS b, max(return_bps) FILTER (WHERE arm = 'C') AS c, max(return_bps) FILTER (WHERE arm = 'D') AS d FROM tr GROUP BY 1),
di AS (SELECT event_id, max(direction) FILTER (WHERE arm = 'A') AS a, max(direction) FILTER (WHERE arm = 'B') AS b, max(direction) FILTER (WHERE arm = 'C') AS c, max(direction) FILTER (WHERE arm = 'D') AS d FROM tr GROUP BY 1),
lo AS (SELECT pair, y - x AS d, q <> p AS flip FROM (SELECT unnest([{'pair': 'A-B', 'x': wi.a, 'y': wi.b, 'p': di.a, 'q': di.b}, {'pair': 'B-C', 'x': wi.b, 'y': wi.c, 'p': di.b, 'q': di.c}, {'pair': 'C-D', 'x': wi.c, 'y': wi.d, 'p': di.c, 'q': di.d}, {'pair': 'A-D', 'x': wi.a, 'y': wi.d, 'p': di.a, 'q': di.d}], recursive := true) FROM wi JOIN di USING (event_id)) WHERE y IS NOT NULL AND x IS NOT NULL),
pa AS (SELECT pair, count(*) AS n, avg(d) AS mean, stddev_samp(d) AS sd, stddev_samp(d) / sqrt(count(*)) AS se, count(*) FILTER (WHERE flip) AS flips FROM lo GROUP BY 1)"""


@query("paired_differences", f"WITH {TRADES}, {PAIRED} SELECT pair, n, round(mean, 3) AS mean, round(se, 3) AS se, round(CASE WHEN se > 0 THEN mean / se END, 3) AS t, coalesce(se > 0 AND abs(mean / se) > 2, false) AS resolved, round(mean - 1.96::DOUBLE * se, 3) AS low, round(mean + 1.96::DOUBLE * se, 3) AS high, flips FROM pa")
def _(spark, d):
    rows = experiment.paired(trades_of(spark, d))
    return rows.select("pair", "n", F.round("mean", 3).alias("mean"), F.round("se", 3).alias("se"), F.round("t", 3).alias("t"), "resolved", F.round("low", 3).alias("low"), F.round("high", 3).alias("high"), "flips")


@query("power_table", f"WITH {TRADES}, {PAIRED} SELECT round(sd, 3) AS sd, e AS effect_bps, CAST(ceil(pow(2 * sd / e, 2)) AS BIGINT) AS events, round(ceil(pow(2 * sd / e, 2)) / 24, 2) AS years FROM pa, (SELECT CAST(unnest([10, 5, 2]) AS DOUBLE) AS e) WHERE pair = 'A-D'")
def _(spark, d):
    return experiment.power(trades_of(spark, d)).withColumn("sd", F.round("sd", 3))


#: Instruments of the events as pairs of the feed, with what their prices are scaled by.
PAIRS = {"click": "EURUSD", "error": "USDJPY", "purchase": "GBPUSD", "signup": "GBPJPY", "view": "USDCAD"}
PAIR_SQL = "CASE instrument " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in PAIRS.items()) + " END"
FACTOR_SQL = "CASE WHEN instrument IN ('error', 'signup') THEN 1000 ELSE 100000 END"


def forms(spark, d):
    """Quotes of each hour packed as the feed's files are, and read again. The files have no place for a negative price."""
    import lzma

    import numpy as np
    import pandas as pd

    from ..sources import decimal_factor, decode_bi5

    def packed(frame):
        frame = frame.sort_values(["ts", "seq"])
        factor = decimal_factor(frame.instrument.iloc[0])
        raw = np.zeros(len(frame), [("ms", ">u4"), ("ask", ">u4"), ("bid", ">u4"), ("volumes", ">f4", 2)])
        raw["ms"], raw["ask"], raw["bid"] = (frame.ts - frame.hour) // 1000, np.rint(frame.ask * factor), np.rint(frame.bid * factor)
        return pd.DataFrame({"instrument": [frame.instrument.iloc[0]], "hour": [frame.hour.iloc[0]], "content": [lzma.compress(raw.tobytes(), lzma.FORMAT_ALONE, preset=0)]})

    names = F.create_map(*(F.lit(x) for pair in PAIRS.items() for x in pair))
    rows = ticks(spark, d).where("bid >= 0 AND ask >= 0").withColumns({"instrument": names[F.col("instrument")], "hour": floor_to("ts", HOUR)})
    return decode_bi5(rows.repartition(spark.sparkContext.defaultParallelism, "instrument", "hour").groupBy("instrument", "hour").applyInPandas(packed, "instrument string, hour long, content binary")).drop("bid_volume", "ask_volume")


@query("bi5_decode", f"SELECT {PAIR_SQL} AS instrument, ts - ts % 1000 AS ts, round(bid * {FACTOR_SQL}) / {FACTOR_SQL} AS bid, round(ask * {FACTOR_SQL}) / {FACTOR_SQL} AS ask, row_number() OVER (PARTITION BY instrument, ts - ts % {HOUR} ORDER BY ts, seq) - 1 AS seq FROM tick WHERE bid >= 0 AND ask >= 0")
def _(spark, d):
    return forms(spark, d)


@query("hour_urls", f"SELECT DISTINCT {PAIR_SQL} AS instrument, ts - ts % {HOUR} AS hour, 'feed/' || {PAIR_SQL} || printf('/%04d/%02d/%02d/%02dh_ticks.bi5', year(make_timestamp(ts)), month(make_timestamp(ts)) - 1, day(make_timestamp(ts)), hour(make_timestamp(ts))) AS url FROM tick")
def _(spark, d):
    names = F.create_map(*(F.lit(x) for pair in PAIRS.items() for x in pair))
    hours = ticks(spark, d).select(names[F.col("instrument")].alias("instrument"), floor_to("ts", HOUR).alias("hour")).distinct()
    return hours.withColumn("url", hour_url("feed"))


LEG_COUNTRIES = "('EURUSD', 'EUR', 'DE'), ('EURUSD', 'USD', 'US'), ('USDJPY', 'USD', 'US'), ('USDJPY', 'JPY', 'JP'), ('GBPUSD', 'GBP', 'GB'), ('GBPUSD', 'USD', 'US'), ('GBPJPY', 'GBP', 'GB'), ('GBPJPY', 'JPY', 'JP'), ('USDCAD', 'USD', 'US'), ('USDCAD', 'CAD', 'CA')"


@query("pair_countries", f"WITH n AS (SELECT {PAIR_SQL} AS instrument, count(*) AS ticks FROM tick GROUP BY 1) SELECT n.instrument, currency, country, ticks FROM n JOIN (VALUES {LEG_COUNTRIES}) AS v(instrument, currency, country) USING (instrument)")
def _(spark, d):
    names = F.create_map(*(F.lit(x) for pair in PAIRS.items() for x in pair))
    quoted = ticks(spark, d).groupBy(names[F.col("instrument")].alias("instrument")).agg(F.count("*").alias("ticks"))
    return quoted.join(sessions.pair_legs(spark), "instrument").join(sessions.currency_countries(spark), "currency").select("instrument", "currency", "country", "ticks")


@query("asof_macro_many", f"""WITH asks AS (SELECT DISTINCT known_at - known_at % {30 * DAY} AS ask_at FROM vintage),
r AS (SELECT ask_at, v.*, row_number() OVER (PARTITION BY ask_at, series_id, ref_period ORDER BY known_at DESC, vintage_seq DESC) AS k FROM asks JOIN vintage v ON v.known_at <= ask_at)
SELECT ask_at, {MACRO_OUT} FROM r WHERE k = 1""")
def _(spark, d):
    held = vintages(spark, d)
    return asof.macro_as_of_many(held, held.select(F.expr(f"known_at - pmod(known_at, {30 * DAY})").alias("ask_at"))).withColumn("ref_period", period())


STREAMED = "WITH " + bar_sql(HOUR).replace("FROM tick", "FROM (SELECT instrument, source, ts, seq, bid, bid AS ask FROM tick)") + " SELECT * FROM bar"


@query("bars_stream", STREAMED)
def _(spark, d):
    from ..streaming import bars_stream

    source = spark.read.parquet(f"{d}/events.parquet")
    at = F.col("ts").cast("timestamp")
    quotes = source.select("event_type", at.alias("at"), F.col("event_type").alias("instrument"), F.col("value").alias("bid"), F.col("value").alias("ask"), F.when(F.col("user_id") % 2 == 0, "feed_a").otherwise("feed_b").alias("source"), F.col("event_id").alias("seq"))
    return bars_stream(quotes, "1 hour", "1 day")


@query("bar_sample", f"WITH {bar_sql(MINUTE)} SELECT *, round(ask_close - bid_close, 7) AS close_spread FROM bar WHERE instrument = 'view' ORDER BY minute, source LIMIT 12")
def _(spark, d):
    return bars.sample(bars.bars_from_ticks(ticks(spark, d)), "view")


@query("bars_reconcile_all", f"WITH {bar_sql(MINUTE)} SELECT (SELECT count(*) FROM tick) AS ticks, CAST(sum(tick_count) AS BIGINT) AS ticks_in_bars, (SELECT count(*) FROM tick) = sum(tick_count) AS agree FROM bar")
def _(spark, d):
    t = ticks(spark, d)
    return bars.reconcile_all(bars.bars_from_ticks(t), t)


@query("bars_backfilled", f"WITH {bar_sql(HOUR)}, one AS (SELECT * FROM ({bar_sql(MINUTE)[8:-1]})) SELECT * FROM one WHERE instrument IN ('click', 'view') AND minute >= {FROM_US + 5 * DAY} AND minute < {FROM_US + 9 * DAY} UNION ALL SELECT * FROM bar WHERE NOT (instrument IN ('click', 'view') AND minute >= {FROM_US + 5 * DAY} AND minute < {FROM_US + 9 * DAY})")
def _(spark, d):
    t = ticks(spark, d)
    return store.backfill_bars(bars.bars_from_ticks(t, HOUR), t, ["click", "view"], FROM_US + 5 * DAY, FROM_US + 9 * DAY)


@query("bars_stored", f"WITH {bar_sql(MINUTE)} SELECT *, CASE WHEN instrument IN ('click', 'view') AND minute >= {FROM_US + 5 * DAY} AND minute < {FROM_US + 9 * DAY} THEN 'anew' ELSE 'stored' END AS made FROM bar")
def _(spark, d):
    folder, t = tables.scratch(spark, "bars"), ticks(spark, d)
    # what is stored is off by one in its counts, and the part made anew isn't
    tables.append(bars.bars_from_ticks(t).withColumn("tick_count", F.col("tick_count") + 1), folder, "bar_1m")
    for _ in range(2):
        store.store_bars(spark, folder, t, ["click", "view"], FROM_US + 5 * DAY, FROM_US + 9 * DAY)
    n = bars.bars_from_ticks(t).select("instrument", "source", "minute", F.col("tick_count").alias("n"))
    rows = tables.read(spark, folder, "bar_1m").join(n, ["instrument", "source", "minute"])
    return rows.withColumn("made", F.when(F.col("tick_count") == F.col("n"), "anew").otherwise("stored")).withColumn("tick_count", F.col("n")).drop("n")


@query("ticks_taken_back", f"WITH {LEDGER} SELECT t.instrument, t.ts, t.bid, t.ask, t.source, t.seq FROM tick t WHERE NOT EXISTS (SELECT 1 FROM led l WHERE l.status = 'in_progress' AND l.source = 'feed_a' AND l.source = t.source AND l.instrument = t.instrument AND l.hour = t.ts - t.ts % {HOUR})")
def _(spark, d):
    folder = stored_ticks(spark, d, "ticks")
    store.take_back(spark, folder, ledger.reset_stale(ledger_of(spark, d), "feed_a")[0])
    return tables.read(spark, folder, "tick_raw").select("instrument", "ts", "bid", "ask", "source", "seq")


@query("ticks_without_stale_claims", f"WITH {LEDGER} SELECT t.instrument, t.ts, t.bid, t.ask, t.source, t.seq FROM tick t WHERE NOT EXISTS (SELECT 1 FROM led l WHERE l.status = 'in_progress' AND l.source = 'feed_a' AND l.source = t.source AND l.instrument = t.instrument AND l.hour = t.ts - t.ts % {HOUR})")
def _(spark, d):
    return store.without_hours(ticks(spark, d), ledger.reset_stale(ledger_of(spark, d), "feed_a")[0])


@query("scoped_session", f"""SELECT 'macro_observation' AS relation, count(*) AS "rows" FROM vintage WHERE series_id IN ('S1', 'S4') UNION ALL
SELECT 'tick_raw', count(*) FROM tick WHERE instrument IN ('click', 'view') AND ts >= {FROM_US} AND ts < {TO_US} UNION ALL SELECT 'tick_raw without a start', 0""")
def _(spark, d):
    held = {"macro_observation": vintages(spark, d), "tick_raw": ticks(spark, d)}
    inside = store.scoped(held, ["S1", "S4"], ["click", "view"], FROM_US, TO_US)
    open_ = store.scoped(held, instruments=["click", "view"], end=TO_US)["tick_raw"]
    out = None
    for name, rows in (*inside.items(), ("tick_raw without a start", open_)):
        counted = rows.agg(F.count("*").alias("rows")).select(F.lit(name).alias("relation"), "rows")
        out = counted if out is None else out.unionByName(counted)
    return out


@query("count_hour", f"SELECT count(*) AS ticks FROM tick WHERE instrument = 'view' AND source = 'feed_b' AND ts >= {FROM_US + 12 * HOUR} AND ts < {FROM_US + 13 * HOUR}")
def _(spark, d):
    return ledger.count_hour(ticks(spark, d), "view", FROM_US + 12 * HOUR, "feed_b")


@query("macro_load_report", "SELECT series_id, count(*) AS observations, count(DISTINCT ref_period) AS periods, count(DISTINCT known_at) AS vintages, min(known_at) AS first_known, max(known_at) AS last_known FROM vintage GROUP BY 1")
def _(spark, d):
    return macro.load_report(vintages(spark, d))


@query("revision_top_k_stable", REVISED + " WHERE series_id IN ('S2', 'S7') ORDER BY abs(revision) DESC, series_id, ref_period LIMIT 12")
def _(spark, d):
    return macro.top_revisions(vintages(spark, d), 12, ["S2", "S7"]).withColumn("ref_period", period())


@query("quietest_hours", ORACLE_SQL["tick_rate_by_hour"] + " ORDER BY ratio, instrument, hour LIMIT 40")
def _(spark, d):
    return monitors.quietest_hours(ticks(spark, d))


@query("rate_totals", f"WITH {RATES} SELECT count(*) AS rates, count(DISTINCT currency) AS currencies, count(DISTINCT fix_date) AS days, min(fix_date) AS first_date, max(fix_date) AS last_date FROM rates")
def _(spark, d):
    return monitors.rate_totals(unpivot_rates(reference_rates_wide(spark, d))).withColumns({c: F.col(c).cast("string") for c in ("first_date", "last_date")})


@query("series_inserted_if_absent", "WITH n AS (SELECT series_id, count(*) AS held FROM vintage GROUP BY 1) SELECT series_id, CASE WHEN series_id IN ('S1', 'S2', 'S3') THEN 'old' ELSE 'new' END AS title, held FROM n")
def _(spark, d):
    counts = vintages(spark, d).groupBy("series_id").agg(F.count("*").alias("held"))
    old = counts.where("series_id IN ('S1', 'S2', 'S3')").select("series_id", F.lit("old").alias("title"), "held")
    return macro.insert_absent(old, counts.select("series_id", F.lit("new").alias("title"), "held"), ["series_id"])


@query("market_windows_rebuilt", f"WITH {MARKET}, held AS ({MARKET_HELD}) SELECT span_start, span_end, CASE WHEN span_start < epoch_us(CAST({FIRST_DAY} + 14 AS TIMESTAMP)) AND span_end > epoch_us(CAST({FIRST_DAY} + 7 AS TIMESTAMP)) THEN 'fresh' ELSE 'stored' END AS made FROM held")
def _(spark, d):
    first, after = span(spark, d)
    low, high = first + timedelta(days=7), first + timedelta(days=14)
    stored = sessions.market_windows(spark, first, after).withColumn("made", F.lit("stored"))
    fresh = sessions.market_windows(spark, low, high).withColumn("made", F.lit("fresh"))
    return sessions.rebuilt(stored, fresh, *((x - date(1970, 1, 1)).days * DAY for x in (low, high)))


@query("market_windows_stored", f"WITH {MARKET}, held AS ({MARKET_HELD}) SELECT span_start, span_end FROM held")
def _(spark, d):
    first, after = span(spark, d)
    folder, at = tables.scratch(spark, "calendar"), lambda x: (x - date(1970, 1, 1)).days * DAY
    keep = lambda a, b: store.store_windows(spark, folder, "market_window", sessions.market_windows(spark, a, b), at(a), at(b), 7 * DAY)
    keep(first, after)
    keep(first + timedelta(days=7), first + timedelta(days=14))
    return tables.read(spark, folder, "market_window")


def fed(spark, d):
    """A feed's folder with a file for each hour of quotes: every 11th is no file of the feed, every 13th empty."""
    import lzma

    import numpy as np
    import pandas as pd

    from ..sources import RECORD, decimal_factor, feeds

    folder = tables.scratch(spark, "feed")

    def put(frame):
        frame = frame.sort_values(["ts", "seq"])
        pair, hour, factor = frame.instrument.iloc[0], int(frame.hour.iloc[0]), decimal_factor(frame.instrument.iloc[0])
        raw = np.zeros(len(frame), RECORD)
        raw["ms"], raw["ask"], raw["bid"] = (frame.ts - hour) // 1000, np.rint(frame.ask * factor), np.rint(frame.bid * factor)
        content = lzma.compress(raw.tobytes(), lzma.FORMAT_ALONE, preset=0)
        content = b"nonsense" if hour // HOUR % 11 == 0 else b"" if hour // HOUR % 13 == 0 else content
        store_, top = feeds.open_folder(folder)
        path = f"{top}/{feeds.place_of(pair, hour)}"
        store_.create_dir(path.rpartition("/")[0])
        with store_.open_output_stream(path, compression=None) as out:
            out.write(content)
        return pd.DataFrame({"n": [len(frame)]})

    names = F.create_map(*(F.lit(x) for pair in PAIRS.items() for x in pair))
    rows = ticks(spark, d).where("bid >= 0 AND ask >= 0").withColumns({"instrument": names[F.col("instrument")], "hour": floor_to("ts", HOUR)})
    rows.repartition(spark.sparkContext.defaultParallelism, "instrument", "hour").groupBy("instrument", "hour").applyInPandas(put, "n long").agg(F.sum("n")).collect()
    return folder


FED = f"""f AS (SELECT {PAIR_SQL} AS instrument, ts - ts % {HOUR} AS hour, count(*) AS n FROM tick WHERE bid >= 0 AND ask >= 0 GROUP BY 1, 2),
want AS (SELECT i.instrument, h.hour FROM (SELECT unnest({sorted(PAIRS.values())}) AS instrument) i, (SELECT unnest(range({FROM_US}, {TO_US}, {HOUR})) AS hour) h),
st AS (SELECT w.*, n, CASE WHEN n IS NULL THEN 'missing' WHEN hour // {HOUR} % 11 = 0 THEN 'error' WHEN hour // {HOUR} % 13 = 0 THEN 'empty' ELSE 'ok' END AS status FROM want w LEFT JOIN f USING (instrument, hour))"""


@query("ingest_run", f"WITH {FED} SELECT instrument, hour, status, CASE WHEN status = 'ok' THEN n ELSE 0 END AS tick_count, CASE WHEN status = 'error' THEN 2 ELSE 1 END AS attempts, CASE WHEN status = 'ok' THEN n ELSE 0 END AS stored FROM st")
def _(spark, d):
    from ..sources import ingest

    feed, folder = fed(spark, d), tables.scratch(spark, "tables")
    bring = lambda now: ingest.ingest(spark, folder, feed, sorted(PAIRS.values()), FROM_US, TO_US, "feed", now)
    first, second = bring(NOW), bring(NOW + 1)
    assert second.rows_inserted == 0 and second.fetched == second.errors == first.errors, (first, second)
    held = ledger.rows_by_hour(tables.read(spark, folder, "tick_raw")).select("instrument", "hour", F.col("ticks").alias("stored"))
    book = tables.read(spark, folder, "ingest_ledger").select("instrument", "hour", "status", "tick_count", F.col("attempts").cast("int").alias("attempts"))
    return book.join(held, ["instrument", "hour"], "left").withColumn("stored", F.coalesce("stored", F.lit(0)))


@query("hour_files_read", f"WITH {FED} SELECT {PAIR_SQL} AS instrument, ts - ts % 1000 AS ts, round(bid * {FACTOR_SQL}) / {FACTOR_SQL} AS bid, round(ask * {FACTOR_SQL}) / {FACTOR_SQL} AS ask FROM tick WHERE bid >= 0 AND ask >= 0 AND {PAIR_SQL} IN ('EURUSD', 'USDJPY') AND ts >= {FROM_US + 6 * HOUR} AND ts < {FROM_US + 9 * HOUR} AND (ts // {HOUR}) % 13 <> 0")
def _(spark, d):
    from ..sources import feeds

    # of the hours asked for none is broken; the files of others aren't opened
    rows = feeds.hour_files(spark, fed(spark, d), ["EURUSD", "USDJPY"], FROM_US + 6 * HOUR, FROM_US + 9 * HOUR)
    return rows.select("instrument", "ts", "bid", "ask")
