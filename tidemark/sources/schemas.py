"""Schemas of the stored relations; a relation that was never loaded is empty, not missing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SCHEMAS = {
    "macro_series": "series_id string, title string, frequency string, units string, seasonally_adjusted boolean",
    "macro_observation": "series_id string, ref_period date, known_at long, value double, vintage_seq long, known_at_precision string, source string",
    "macro_release": "release_id long, series_id string, ref_period date, released_at long, consensus double",
    "ingest_ledger": "instrument string, hour long, source string, status string, tick_count long, byte_count long, attempts int, detail string, claimed_at long, completed_at long",
    "session_window": "session string, span_start long, span_end long",
    "market_window": "span_start long, span_end long",
    "rollover_window": "span_start long, span_end long",
    "currency_holiday": "currency string, holiday_date date, name string",
    "reference_rate": "fix_date date, currency string, rate double",
    "drift_observation": "fix_date date, instrument string, fix double, mean_mid double, ticks long, diff_pips double",
    "tick_raw": "instrument string, ts long, bid double, ask double, bid_volume float, ask_volume float, source string, seq long",
    "tick_flag": "instrument string, ts long, flag string, detail string",
    "bar_1m": "instrument string, source string, minute long, bid_open double, bid_high double, bid_low double, bid_close double, ask_open double, ask_high double, ask_low double, ask_close double, tick_count long",
    "bar_part": "batch long, instrument string, source string, minute long, bid_open struct<ts:bigint,seq:bigint,bid:double>, bid_high double, bid_low double, bid_close struct<ts:bigint,seq:bigint,bid:double>, ask_open struct<ts:bigint,seq:bigint,ask:double>, ask_high double, ask_low double, ask_close struct<ts:bigint,seq:bigint,ask:double>, tick_count long",
    "calendar_hour": "hour long, market_open boolean, rollover boolean",
    "calendar_holiday": "currency string, holiday_date date",
    "calendar_pair_leg": "instrument string, currency string",
}


def empty(spark: SparkSession, relation: str) -> DataFrame:
    return spark.createDataFrame([], SCHEMAS[relation])
