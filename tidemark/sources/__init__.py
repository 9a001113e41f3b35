"""Readers: the driver's tables as quotes and vintages, and files of feeds and archives."""

from __future__ import annotations

import csv
import io
import lzma
import zipfile
from collections.abc import Iterator
from datetime import date
from xml.etree import ElementTree

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import DAY, HOUR, micros
from .schemas import SCHEMAS, empty

__all__ = ["SCHEMAS", "decode_bi5", "decimal_factor", "empty", "fixture_csv", "hour_url", "hours_between", "rates_from_zip", "reference_rates_wide", "ticks", "unpivot_rates", "vintages", "xlsx_cells"]

#: By how much prices of an instrument are scaled in the feed's files.
DECIMAL_FACTORS = {"EURUSD": 1e5, "GBPUSD": 1e5, "AUDUSD": 1e5, "NZDUSD": 1e5, "USDCHF": 1e5, "USDCAD": 1e5, "USDJPY": 1e3, "EURJPY": 1e3, "GBPJPY": 1e3}


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as quotes of five instruments from two feeds; seq keeps their order."""
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(
        F.col("event_type").alias("instrument"),
        micros("ts").alias("ts"),
        F.col("value").alias("bid"),
        (F.col("value") + (F.col("event_id") % 23 - 1) / 100.0).alias("ask"),
        F.when(F.col("user_id") % 2 == 0, "feed_a").otherwise("feed_b").alias("source"),
        F.col("event_id").alias("seq"),
    )


def vintages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as vintages of ten monthly series: known on the order's date, missing for every 17th."""
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        F.concat(F.lit("S"), F.col("o_custkey") % 10).alias("series_id"),
        F.trunc(F.col("o_orderdate").cast("date"), "MM").alias("ref_period"),
        micros("o_orderdate").alias("known_at"),
        F.when(F.col("o_orderkey") % 17 != 0, F.col("o_totalprice")).alias("value"),
        F.col("o_orderkey").alias("vintage_seq"),
    )


def fixture_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV file with a header, comment lines that begin with # and blanks for nulls."""
    return spark.read.option("comment", "#").option("header", True).option("nullValue", "").schema(schema).csv(path)


def decimal_factor(instrument: str) -> float:
    if instrument not in DECIMAL_FACTORS:
        raise KeyError(f"no decimal factor is known for {instrument}")
    return DECIMAL_FACTORS[instrument]


def hours_between(spark: SparkSession, start: int, end: int, only_hours: list[int] | None = None) -> DataFrame:
    """Every hour that begins in [start, end), as instants; weekends too."""
    first = start - start % HOUR
    hours = spark.range(max(0, -(-(end - first) // HOUR))).select((F.col("id") * HOUR + first).alias("hour")).where(f"hour >= {start}")
    return hours if only_hours is None else hours.where(F.expr(f"pmod(hour, {DAY}) div {HOUR}").isin(only_hours))


def hour_url(base: str, instrument: str = "instrument", hour: str = "hour") -> Column:
    """Where the feed has an hour's file. Months are counted from 0 in it."""
    at = F.expr(f"TIMESTAMP_NTZ'1970-01-01 00:00:00' + make_dt_interval(0, 0, 0, {hour} div 1000000)")
    place = F.format_string("%04d/%02d/%02d/%02dh_ticks.bi5", F.year(at), F.month(at) - 1, F.day(at), F.hour(at))
    return F.concat_ws("/", F.lit(base), F.col(instrument), place)


#: A record of the feed's files, big-endian.
RECORD = np.dtype([("ms", ">u4"), ("ask", ">u4"), ("bid", ">u4"), ("ask_volume", ">f4"), ("bid_volume", ">f4")])


def hour_ticks(instrument: str, hour: int, content: bytes | None) -> pd.DataFrame:
    """The ticks of one compressed hour in their order; an empty content has none. A payload that isn't whole records is an error, as is an instrument without a known factor."""
    raw = lzma.decompress(content) if content else b""
    if len(raw) % RECORD.itemsize:
        raise ValueError(f"{len(raw)} bytes aren't whole records of {RECORD.itemsize}")
    got, factor = np.frombuffer(raw, RECORD), decimal_factor(instrument)
    return pd.DataFrame({"instrument": instrument, "ts": hour + got["ms"].astype("int64") * 1000, "bid": got["bid"] / factor, "ask": got["ask"] / factor, "bid_volume": got["bid_volume"].astype("float32"), "ask_volume": got["ask_volume"].astype("float32"), "seq": np.arange(len(got))})


def decode_bi5(files: DataFrame) -> DataFrame:
    """hour_ticks of each (instrument, hour, content)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples():
                yield hour_ticks(row.instrument, row.hour, row.content)

    return files.mapInPandas(run, "instrument string, ts long, bid double, ask double, bid_volume float, ask_volume float, seq long")


def _text_of(node: ElementTree.Element) -> str:
    return "".join(t.text or "" for t in node.iterfind(".//{*}t"))


def workbook_cells(content: bytes) -> Iterator[tuple[int, int, str]]:
    """(row, col, text) of the first sheet's cells; shared and inline strings are resolved, and one that names no shared string is left out."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        names, shared = book.namelist(), []
        if "xl/sharedStrings.xml" in names:
            shared = [_text_of(item) for item in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).iterfind("{*}si")]
        sheet = ElementTree.fromstring(book.read(min(n for n in names if n.startswith("xl/worksheets/") and n.endswith(".xml"))))
    for node in sheet.iterfind(".//{*}c"):
        place, value = node.get("r", ""), node.findtext("{*}v")
        letters = place.rstrip("0123456789")
        if not letters or letters == place:
            continue
        if node.get("t") == "inlineStr":
            value = _text_of(node)
        elif node.get("t") == "s" and value is not None:
            value = shared[int(value)] if value.isdigit() and int(value) < len(shared) else None
        if value:
            column = 0
            for letter in letters:
                column = column * 26 + ord(letter) - 64
            yield int(place[len(letters) :]), column, value


def xlsx_cells(files: DataFrame) -> DataFrame:
    """(name, row, col, text) of workbook_cells from (name, content) of workbooks."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples():
                yield pd.DataFrame([(row.name, *c) for c in workbook_cells(row.content)], columns=["name", "row", "col", "text"])

    return files.mapInPandas(run, "name string, row int, col int, text string")


def reference_rates_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily mean of each instrument as a wide table of rates in text, N/A where there is none or on every 7th day."""
    day = F.expr(f"ts div {DAY}")
    means = ticks(spark, sf_dir).groupBy(day.alias("d"), "instrument").agg(F.round(F.avg("bid"), 9).alias("rate"))
    names = ["click", "error", "purchase", "signup", "view"]
    wide = means.groupBy("d").pivot("instrument", names).agg(F.first("rate"))
    shown = [F.when((F.col("d") % 7 == 0) | F.col(n).isNull(), "N/A").otherwise(F.col(n).cast("string")).alias(n) for n in names]
    return wide.select(F.expr("date_from_unix_date(cast(d AS int))").alias("fix_date"), *shown)


def rates_from_zip(files: DataFrame) -> DataFrame:
    """From (name, content) of zipped CSV files whose first column is a day and whose others are currencies: (name, fix_date, currency, rate).

    Rows without a day and cells that aren't numbers are left out, never zero. A payload that isn't a zip archive with a CSV file is an error.
    """

    def rows(name: str, content: bytes) -> Iterator[tuple]:
        if not zipfile.is_zipfile(io.BytesIO(content)):
            raise ValueError(f"{name} isn't a zip archive")
        with zipfile.ZipFile(io.BytesIO(content)) as archive:
            inside = [n for n in archive.namelist() if n.lower().endswith(".csv")]
            if not inside:
                raise ValueError(f"{name} has no CSV file")
            head, *body = csv.reader(io.StringIO(archive.read(inside[0]).decode("utf-8", "replace"))) or [[]]
        for line in body:
            try:
                day = date.fromisoformat(line[0].strip()) if line else None
            except ValueError:
                continue
            for currency, cell in zip(head[1:], line[1:], strict=False):
                number = pd.to_numeric(cell.strip(), errors="coerce")
                if day is not None and currency.strip() and np.isfinite(number):
                    yield name, day, currency.strip(), float(number)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, content in zip(frame["name"], frame["content"], strict=True):
                yield pd.DataFrame(list(rows(name, content)), columns=["name", "fix_date", "currency", "rate"])

    return files.mapInPandas(run, "name string, fix_date date, currency string, rate double")


def unpivot_rates(wide: DataFrame) -> DataFrame:
    """(fix_date, currency, rate) of a wide table of text; cells that aren't numbers are left out, never zero."""
    names = [c for c in wide.columns if c != "fix_date"]
    long = wide.unpivot("fix_date", names, "currency", "raw")
    return long.select("fix_date", "currency", F.expr("try_cast(raw AS double)").alias("rate")).where("rate IS NOT NULL AND fix_date IS NOT NULL")


