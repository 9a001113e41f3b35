"""Feed files by a data source that opens what is asked for, and runs that bring them into stored tables."""

import io
import lzma
import struct
import zipfile
from datetime import datetime, timezone
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tidemark.functions import HOUR, instant
from tidemark.operators import macro
from tidemark.sources import feeds, ingest, store, tables

START = instant(datetime(2024, 1, 31, 20, tzinfo=timezone.utc))
END = START + 8 * HOUR


def packed(ticks):
    return lzma.compress(b"".join(struct.pack(">IIIff", *t) for t in ticks), lzma.FORMAT_ALONE)


def put(feed, instrument, hour, content):
    path = Path(feed) / feeds.place_of(instrument, hour)
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(content)


@pytest.fixture
def feed(tmp_path):
    """Eight hours of two pairs: the third is empty, the fourth missing and, of one pair, the sixth cut short."""
    top = tmp_path / "feed"
    for pair in ("EURUSD", "USDJPY"):
        for k in range(8):
            if k != 3:
                put(top, pair, START + k * HOUR, b"" if k == 2 else packed([(n * 1000, 110010 + n, 110000 + n, 1.5, 2.5) for n in range(k + 1)]))
    put(top, "USDJPY", START + 5 * HOUR, b"not a file of the feed")
    return str(top)


def state(spark, folder):
    book = {(r.instrument, (r.hour - START) // HOUR): (r.status, r.tick_count, r.attempts) for r in tables.read(spark, folder, "ingest_ledger").collect()}
    ticks = {}
    for r in tables.read(spark, folder, "tick_raw").collect():
        key = r.instrument, (r.ts - START) // HOUR
        ticks[key] = ticks.get(key, 0) + 1
    return book, ticks


def run(spark, folder, feed, now, **more):
    return ingest.ingest(spark, folder, feed, ["EURUSD", "USDJPY"], START, END, "feed", now, **more)


def test_a_run_and_the_next_one(spark, feed, tmp_path):
    folder = str(tmp_path / "tables")
    dry = run(spark, folder, feed, 1, dry_run=True)
    assert (dry.requested, dry.skipped_settled, dry.fetched) == (16, 0, 0) and state(spark, folder) == ({}, {})
    first = run(spark, folder, feed, 1)
    assert first.by_status == {"ok": 11, "empty": 2, "missing": 2, "error": 1} and first.fetched == 16 and not first.is_noop
    assert first.errors == 1 and "USDJPY" in first.examples[0]
    book, ticks = state(spark, folder)
    assert ticks == {(p, k): k + 1 for p in ("EURUSD", "USDJPY") for k in (0, 1, 4, 5, 6, 7) if (p, k) != ("USDJPY", 5)}
    assert first.rows_inserted == sum(ticks.values())
    assert book["USDJPY", 5] == ("error", 0, 1) and book["EURUSD", 3] == ("missing", 0, 1) and book["EURUSD", 7] == ("ok", 8, 1)
    # the failed hour is tried again, and only it
    put(feed, "USDJPY", START + 5 * HOUR, packed([(0, 110010, 110000, 1, 1)]))
    second = run(spark, folder, feed, 2)
    assert (second.skipped_settled, second.fetched, second.rows_inserted, second.errors) == (15, 1, 1, 0)
    files = sorted(p.stat().st_mtime_ns for p in Path(folder).rglob("*.parquet"))
    third = run(spark, folder, feed, 3)
    assert third.is_noop and third.skipped_settled == 16
    assert sorted(p.stat().st_mtime_ns for p in Path(folder).rglob("*.parquet")) == files
    assert state(spark, folder)[0]["USDJPY", 5] == ("ok", 1, 2)


def test_a_run_that_died_is_taken_back(spark, feed, tmp_path, monkeypatch):
    folder = str(tmp_path / "tables")

    class Died(BaseException):
        pass

    def dies(*_):
        raise Died

    # quotes are appended, and then the run dies before it settles
    settle = ingest.ledger.settle
    monkeypatch.setattr(ingest.ledger, "settle", dies)
    with pytest.raises(Died):
        run(spark, folder, feed, 1)
    monkeypatch.setattr(ingest.ledger, "settle", settle)
    book, ticks = state(spark, folder)
    assert {s for s, *_ in book.values()} == {"in_progress"} and len(ticks) == 11
    again = run(spark, folder, feed, 2)
    assert again.stale_recovered == 16 and again.fetched == 16
    assert state(spark, folder)[1] == ticks


def test_an_append_that_fails_leaves_no_quotes(spark, feed, tmp_path, monkeypatch):
    folder, append = str(tmp_path / "tables"), store.append_hours

    def half(rows, where):
        append(rows.where("seq = 0"), where)
        raise OSError("disk full")

    monkeypatch.setattr(store, "append_hours", half)
    first = run(spark, folder, feed, 1)
    assert first.by_status == {"error": 16} and first.rows_inserted == 0 and "disk full" in first.examples[0]
    assert state(spark, folder)[1] == {}
    monkeypatch.setattr(store, "append_hours", append)
    assert run(spark, folder, feed, 2).by_status["ok"] == 11


def test_other_sources_and_hours_stay(spark, feed, tmp_path):
    folder = str(tmp_path / "tables")
    store.append_hours(spark.createDataFrame([("EURUSD", START + 1, 1.0, 2.0, "other", 0)], "instrument string, ts long, bid double, ask double, source string, seq long"), folder)
    report = run(spark, folder, feed, 1, only_hours=[20, 21])
    assert report.requested == 4 and report.rows_inserted == 6
    kept = tables.read(spark, folder, "tick_raw")
    assert {r.source: r.n for r in kept.groupBy("source").agg(F.count("*").alias("n")).collect()} == {"other": 1, "feed": 6}


def test_a_read_opens_only_the_files_asked_for(spark, feed):
    for path in Path(feed).rglob("*.bi5"):
        if "USDJPY" in str(path) or feeds.place_of("EURUSD", START + 6 * HOUR) in str(path):
            path.write_bytes(b"nobody opens this")
    rows = feeds.hour_files(spark, feed, ["EURUSD", "absent"], START + HOUR, START + 6 * HOUR)
    assert {(r.hour - START) // HOUR: r.n for r in rows.groupBy("hour").agg(F.count("*").alias("n")).collect()} == {1: 2, 4: 5, 5: 6}
    assert rows.rdd.getNumPartitions() == 4 and feeds.hour_files(spark, feed, ["EURUSD"], START + HOUR, START + 6 * HOUR, files=3).rdd.getNumPartitions() == 2
    # a second question to the same frame has all its rows
    assert rows.where(F.col("ts") == START + 4 * HOUR + 1_000_000).select("bid", "ask", "seq").collect() == [(1.10001, 1.10011, 1)]
    assert rows.count() == 13
    with pytest.raises(Exception, match="(?i)lzma|format"):
        feeds.hour_files(spark, feed).collect()


def test_workbooks_by_name(spark, tmp_path):
    for name, title in (("a.xlsx", "GDP65M11"), ("b.xlsx", "CPI65Q4")):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as book:
            book.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="urn:x"><sheetData><row><c r="A1" t="inlineStr"><is><t>DATE</t></is></c><c r="B1" t="inlineStr"><is><t>{title}</t></is></c></row><row><c r="A2" t="inlineStr"><is><t>1965:09</t></is></c><c r="B2"><v>3.5</v></c></row></sheetData></worksheet>')
        (tmp_path / name).write_bytes(out.getvalue())
    (tmp_path / "c.xlsx").write_bytes(b"no workbook")
    cells = feeds.workbooks(spark, str(tmp_path), ["a.xlsx", "b.xlsx"])
    found = macro.unpivot_archive(cells).select("series_id", "value").collect()
    assert sorted(map(tuple, found)) == [("CPI", 3.5), ("GDP", 3.5)]
