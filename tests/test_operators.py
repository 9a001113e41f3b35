import hashlib
import io
import zipfile
from datetime import date, datetime, timezone

import pytest
from pyspark.sql import functions as F

from tidemark.functions import DAY, HOUR, MINUTE, instant
from tidemark.operators import asof, bars, experiment, flags, ledger, macro, monitors, sessions
from tidemark.sources import SCHEMAS, decimal_factor, decode_bi5, empty, fixture_csv, hour_url, hours_between, rates_from_zip, store, tables, xlsx_cells
from tidemark.streaming import bars_stream

TICK = "instrument string, ts long, bid double, ask double, source string, seq long"


def at(*parts):
    return instant(datetime(*parts, tzinfo=timezone.utc))


def test_instants_need_a_zone():
    assert instant(datetime(1970, 1, 2, tzinfo=timezone.utc)) == DAY
    for bad in (date(2024, 1, 1), datetime(2024, 1, 1)):
        with pytest.raises(TypeError):
            instant(bad)


def test_empty_relations_give_no_rows(spark):
    assert all(empty(spark, name).count() == 0 for name in SCHEMAS)
    assert asof.macro_as_of(empty(spark, "macro_observation"), 0).count() == 0
    assert flags.stale(empty(spark, "tick_raw")).count() == 0
    assert bars.bars_from_ticks(empty(spark, "tick_raw")).count() == 0


def observations(spark):
    rows = [("P", date(2024, 1, 1), at(2024, 2, 2, 13, 30), 100.0, 1), ("P", date(2024, 1, 1), at(2024, 3, 8, 13, 30), 110.0, 2), ("P", date(2024, 2, 1), at(2024, 3, 8, 13, 30), None, 3), ("P", date(2024, 2, 1), at(2024, 3, 8, 19, 15), 120.0, 4)]
    return spark.createDataFrame(rows, "series_id string, ref_period date, known_at long, value double, vintage_seq long")


def test_nothing_later_is_read(spark):
    seen = lambda t: {(r.ref_period.month, r.value) for r in asof.macro_as_of(observations(spark), t, "P").collect()}
    assert seen(at(2024, 2, 2, 13, 29)) == set()
    assert seen(at(2024, 2, 2, 13, 30)) == {(1, 100.0)}
    assert seen(at(2024, 3, 8, 14, 0)) == {(1, 110.0), (2, None)}
    assert seen(at(2024, 3, 8, 20, 0)) == {(1, 110.0), (2, 120.0)}


def test_bars_in_closed_mode_hide_the_running_minute(spark):
    t = at(2024, 1, 9, 10, 0)
    quotes = spark.createDataFrame([("E", t, 1.0, 1.1, "a", 1), ("E", t + 59_000_000, 2.0, 2.1, "a", 2)], TICK)
    made = bars.bars_from_ticks(quotes)
    assert asof.bars_as_of(made, t + 30_000_000, "E", "a").first().bid_close == 2.0
    assert asof.bars_as_of(made, t + 30_000_000, "E", "a", mode="closed").count() == 0
    assert asof.bars_as_of(made, t + MINUTE, "E", "a", mode="closed").count() == 1


def test_stale_runs_go_over_midnight(spark):
    start = at(2024, 1, 1, 23, 58)
    rows = [("E", start + k * MINUTE, 1.0, 1.1, "a", k) for k in range(2)] + [("E", start + DAY + k * MINUTE, 1.0, 1.1, "a", 10 + k) for k in range(1)]
    rows += [("E", start + 2 * DAY + k * MINUTE, 1.0, 1.1, "a", 20 + k) for k in range(2)] + [("E", start + 3 * DAY, 2.0, 2.1, "a", 30)]
    runs = flags.stale_runs(spark.createDataFrame(rows, TICK)).orderBy("seq").collect()
    assert [r.run for r in runs] == [1, 2, 3, 4, 5, 1]


def test_cross_feed_verdicts(spark):
    t = at(2024, 1, 9, 10, 0)
    rows = [("E", t + k * MINUTE, 1.0 + d, 1.1 + d, s, k) for k, d, s in ((0, 0, "a"), (0, 0.00002, "b"), (1, 0, "a"), (1, 0.0002, "b"), (2, 0, "a"))]
    found = bars.cross_feed(bars.bars_from_ticks(spark.createDataFrame(rows, TICK)), "a", "b", 0.00005)
    assert [r.verdict for r in found.orderBy("minute").collect()] == ["agree", "disagree", "gap"]


def test_calendar_follows_daylight_saving(spark):
    rows = sessions.london_ny_overlap(spark, date(2024, 3, 8), date(2024, 3, 12)).collect()
    assert {r.day.isoformat(): r.hours for r in rows} == {"2024-03-08": 4.0, "2024-03-09": 4.0, "2024-03-10": 5.0, "2024-03-11": 5.0}
    runs = sessions.dst_offset_weeks(spark, 2024).orderBy("first_day").collect()
    assert [(str(r.first_day), r.days, r.difference) for r in runs] == [("2024-03-11", 15, 1.0), ("2024-10-28", 5, 1.0)]
    assert sessions.overlapping(sessions.session_windows(spark, date(2024, 1, 1), date(2025, 1, 1)), ["session"]).count() == 0
    assert sessions.overlapping(sessions.market_windows(spark, date(2024, 1, 1), date(2025, 1, 1)), []).count() == 0


def test_archive_grid(spark, tmp_path):
    strings = ["DATE", "ABC65M11", "ABC23Q4", "1965:01", "1965:Q4", "#N/A"]
    cell = lambda r, c, v, s=True: f'<c r="{c}{r}"' + (' t="s"' if s else "") + f"><v>{v}</v></c>"
    sheet = "<sheetData>" + cell(1, "A", 0) + cell(1, "B", 1) + cell(1, "C", 2) + cell(2, "A", 3) + cell(2, "B", 1.5, False) + cell(2, "C", 5) + cell(3, "A", 4) + cell(3, "C", 2.5, False) + "</sheetData>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as book:
        book.writestr("xl/sharedStrings.xml", "<sst>" + "".join(f"<si><t>{s}</t></si>" for s in strings) + "</sst>")
        book.writestr("xl/worksheets/sheet1.xml", sheet)
    cells = xlsx_cells(spark.createDataFrame([("x", out.getvalue())], "name string, content binary"))
    rows = {(r.series_id, str(r.ref_period), r.known_at, r.value) for r in macro.unpivot_archive(cells).collect()}
    assert rows == {("ABC", "1965-01-01", at(1965, 12, 1) - 1, 1.5), ("ABC", "1965-10-01", at(2024, 1, 1) - 1, 2.5)}


def test_feed_files(spark):
    import lzma
    import struct

    raw = struct.pack(">IIIff", 1500, 110001, 110000, 1.0, 2.0) + struct.pack(">IIIff", 1400, 110003, 110002, 1.0, 2.0)
    files = lambda b, name="EURUSD": spark.createDataFrame([(name, 7 * HOUR, lzma.compress(b, lzma.FORMAT_ALONE))], "instrument string, hour long, content binary")
    got = decode_bi5(files(raw)).orderBy("seq").collect()
    assert [(r.ts, r.bid, r.ask) for r in got] == [(7 * HOUR + 1_500_000, 1.1, 1.10001), (7 * HOUR + 1_400_000, 1.10002, 1.10003)]
    with pytest.raises(Exception, match="whole records"):
        decode_bi5(files(raw[:-1])).collect()
    with pytest.raises(KeyError):
        decimal_factor("XXXYYY")
    assert hours_between(spark, 0, DAY, [3, 4]).count() == 2


def test_fixture_csv(spark, tmp_path):
    path = tmp_path / "x.csv"
    path.write_text("# a comment\nseries_id,value\nA,1.5\nB,\n")
    assert [tuple(r) for r in fixture_csv(spark, str(path), "series_id string, value double").collect()] == [("A", 1.5), ("B", None)]


def test_ledger_lifecycle(spark):
    book = empty(spark, "ingest_ledger")
    hours = spark.createDataFrame([("E", 0, "f"), ("E", HOUR, "f")], "instrument string, hour long, source string")
    assert ledger.to_do(hours, book).count() == 2
    book = ledger.claim(book, hours, 1)
    stuck, _ = ledger.reset_stale(book, "f")
    assert stuck.count() == 2
    results = hours.select("*", F.lit("ok").alias("status"), F.lit(5).cast("long").alias("tick_count"), F.lit(9).cast("long").alias("byte_count"), F.lit(None).cast("string").alias("detail"))
    book = ledger.settle(book, results, 2)
    assert ledger.to_do(hours, book).count() == 0
    assert [(r.status, r.attempts) for r in book.collect()] == [("ok", 1), ("ok", 1)]


def test_stream_equals_batch(spark, tmp_path):
    rows = [("E", datetime(2024, 1, 1, 0, 0, k % 60), float(k % 7), float(k % 7) + 1, "a", k) for k in range(100)] + [("E", datetime(2024, 1, 3), 1.0, 2.0, "a", 1000)]
    frame = spark.createDataFrame(rows, "instrument string, at timestamp, bid double, ask double, source string, seq long")
    frame.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(frame.schema).parquet(str(tmp_path / "in"))
    run = bars_stream(stream, late="1 minute").writeStream.format("memory").queryName("bars").outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination()
    quotes = frame.where("seq < 1000").withColumn("ts", F.unix_micros("at"))
    batch = bars.bars_from_ticks(quotes).select(spark.table("bars").columns)
    assert sorted(map(tuple, spark.table("bars").collect())) == sorted(map(tuple, batch.collect()))


def test_periods_that_no_year_has_are_null(spark):
    titles = [(x,) for x in ("ABC65M13", "ABC65M0", "ABC65Q7", " abc65m11 ", "ABC65", None)]
    heads = spark.createDataFrame(titles, "t string").select(macro.vintage_header(F.col("t")).alias("v")).select("v.*").collect()
    assert [r.known_at for r in heads] == [None, None, None, at(1965, 12, 1) - 1, None, None]
    periods = spark.createDataFrame([(x,) for x in ("1970:13", "1970:Q9", "1970:q2", " 1970:03", "x", None)], "t string").select(macro.ref_period(F.col("t")).alias("p")).collect()
    assert [str(r.p) for r in periods] == ["None", "None", "1970-04-01", "1970-03-01", "None", "None"]


def test_workbook_strings_are_unescaped(spark):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as book:
        book.writestr("xl/sharedStrings.xml", '<sst xmlns="urn:x"><si><r><t>A &amp; </t></r><r><t>B</t></r></si></sst>')
        book.writestr("xl/worksheets/sheet1.xml", '<worksheet xmlns="urn:x"><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>9</v></c><c r="AA2" t="inlineStr"><is><t>x&lt;y</t></is></c><c r="B2"/></row></sheetData></worksheet>')
    found = xlsx_cells(spark.createDataFrame([("x", out.getvalue())], "name string, content binary")).collect()
    assert [(r.row, r.col, r.text) for r in found] == [(1, 1, "A & B"), (2, 27, "x<y")]


def test_zipped_rates(spark):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as archive:
        archive.writestr("rates.csv", "Date, USD, JPY, \n2024-01-02,1.1,N/A,\nnonsense,1,2,\n2024-01-03,,160.5,\n\n")
    files = lambda b: spark.createDataFrame([("x", b)], "name string, content binary")
    assert sorted((str(r.fix_date), r.currency, r.rate) for r in rates_from_zip(files(out.getvalue())).collect()) == [("2024-01-02", "USD", 1.1), ("2024-01-03", "JPY", 160.5)]
    with pytest.raises(Exception, match="zip archive"):
        rates_from_zip(files(b"<html>")).collect()


def test_months_of_an_hours_place_count_from_zero(spark):
    row = spark.createDataFrame([("EURUSD", at(2024, 1, 9, 10))], "instrument string, hour long").select(hour_url("b").alias("u")).first()
    assert row.u == "b/EURUSD/2024/00/09/10h_ticks.bi5"


def test_many_instants_equal_each_by_itself(spark):
    held = observations(spark)
    asks = [at(2024, 2, 2, 13, 29), at(2024, 2, 2, 13, 30), at(2024, 3, 8, 14, 0), at(2024, 3, 8, 20, 0), at(2025, 1, 1), at(2024, 3, 8, 14, 0)]
    frame = spark.createDataFrame([(a,) for a in asks] + [(None,)], "ask_at long")
    wanted = sorted((a, *r) for a in set(asks) for r in map(tuple, asof.macro_as_of(held, a).collect()))
    for few in (64, 0):
        assert sorted(map(tuple, asof.macro_as_of_many(held, frame, few).collect()), key=str) == sorted(wanted, key=str)
    assert asof.macro_as_of_many(held, frame.where("ask_at < 0"), 0).count() == 0


def test_an_arm_without_a_signal_does_not_trade_and_the_others_do(spark):
    t = at(2024, 1, 9, 12)
    quotes = spark.createDataFrame([("E", t + k * 60 * MINUTE // 2, 1.0 + k / 100, 1.001 + k / 100, "a", k) for k in range(-26, 4)], TICK)
    events = spark.createDataFrame([("e", "E", t, 0.0, 1.0), ("f", "E", t, 1.0, -1.0), ("g", "E", t + 9 * DAY, 1.0, 1.0)], "event_id string, instrument string, release_at long, surprise_first double, surprise_final double")
    found = {(r.event_id, r.arm): r for r in experiment.trades(events, quotes).collect()}
    assert sorted(found) == [("e", "B"), ("e", "C"), ("e", "D"), ("f", "A"), ("f", "B"), ("f", "C"), ("f", "D")]
    honest = found["f", "A"]
    assert honest.direction == -1 and honest.entry == 1.0 and abs(honest.exit - 1.011) < 1e-9
    assert found["f", "B"].direction == 1 and found["f", "B"].entry == 1.001
    assert abs(found["f", "C"].entry - 0.761) < 1e-9 and abs(found["f", "D"].entry - 0.7605) < 1e-9
    flips = {r.pair: (r.n, r.flips) for r in experiment.paired(experiment.trades(events, quotes)).collect()}
    assert flips["A-B"] == (1, 1) and flips["B-C"] == (2, 0)


def test_a_failing_detector_leaves_its_flags_and_the_others_run(spark, tmp_path):
    t, folder = at(2024, 1, 9, 12), str(tmp_path)
    store.append_hours(spark.createDataFrame([("E", t, 2.0, 1.0, "a", 1), ("E", t + DAY, 2.0, 1.0, "a", 2), ("F", t, 1.0, 1.0, "a", 3)], TICK), folder)
    stored = spark.createDataFrame([("E", t + 5, "crossed", "old"), ("E", t + DAY, "crossed", "old"), ("E", t, "weekend_gap", "old")], "instrument string, ts long, flag string, detail string")
    tables.append(stored, folder, "tick_flag")
    report = flags.rescan(spark, folder, None, None, None, ["E"], t, t + DAY, ["crossed", "zero_spread", "weekend_gap"])
    assert report.written == {"crossed": 1, "zero_spread": 0} and set(report.errors) == {"weekend_gap"}
    found = tables.read(spark, folder, "tick_flag")
    assert sorted(map(tuple, found.collect())) == [("E", t, "crossed", "bid=2.00000 ask=1.00000 spread=-1.00000"), ("E", t, "weekend_gap", "old"), ("E", t + DAY, "crossed", "old")]


def test_stored_hours_and_scopes(spark, tmp_path):
    hour = at(2024, 1, 31, 23)
    quotes = spark.createDataFrame([("E", hour + k, 1.0, 1.1, "a", k) for k in range(3)] + [("E", hour + HOUR, 2.0, 2.1, "a", 9), ("G", hour, 3.0, 3.1, "b", 4)], TICK)
    folder = f"{tmp_path}/tables"
    store.append_hours(quotes.where("instrument = 'E'"), folder)
    store.append_hours(quotes.where("instrument = 'G'"), folder)
    inside = store.open_session(spark, folder, instruments=["E"], start=hour, end=hour + HOUR)
    assert sorted(r.seq for r in inside["tick_raw"].collect()) == [0, 1, 2]
    assert inside["macro_observation"].count() == inside["bar_1m"].count() == 0
    for lacking in ({"instruments": ["E"], "start": hour}, {"start": hour, "end": hour + HOUR}, {"instruments": ["E"], "end": hour}):
        assert store.open_session(spark, folder, **lacking)["tick_raw"].count() == 0
    stuck = spark.createDataFrame([("E", "a", hour)], "instrument string, source string, hour long")
    assert sorted(r.seq for r in store.without_hours(quotes, stuck).collect()) == [4, 9]
    assert store.without_hours(quotes, stuck.limit(0)).count() == 5


def test_backfilled_bars_are_made_once(spark):
    start = at(2024, 1, 9, 10)
    quotes = spark.createDataFrame([("E", start + k * MINUTE, 1.0 + k, 1.1 + k, "a", k) for k in range(4)], TICK)
    old = bars.bars_from_ticks(quotes.where("seq < 1"))
    made = old
    for _ in range(2):
        made = store.backfill_bars(made, quotes, ["E"], start, start + 3 * MINUTE)
    assert sorted((r.minute, r.tick_count) for r in made.collect()) == [(start + k * MINUTE, 1) for k in range(3)]
    with pytest.raises(ValueError):
        store.backfill_bars(old, quotes, ["E"], start + 1, start + MINUTE)


def test_releases_are_kept_until_refreshed(spark, tmp_path):
    rows = lambda v: spark.createDataFrame([("S", 10, v), ("S", 30, v)], "series_id string, released_at long, first_print double")
    path = f"{tmp_path}/releases"
    assert [r.first_print for r in store.kept_releases(spark, path, rows(1.0), 0, 20).collect()] == [1.0]
    assert [r.released_at for r in store.kept_releases(spark, path, rows(2.0), 0, 40).collect()] == [10, 30]
    assert store.kept_releases(spark, path, rows(2.0), 0, 20).first().first_print == 1.0
    assert store.kept_releases(spark, path, rows(2.0), 0, 20, refresh=True).first().first_print == 2.0


def test_digests_and_anchors(spark):
    files = spark.createDataFrame([("a", bytearray(b"rules")), ("b", None)], "name string, content binary")
    assert {r.name: r.digest for r in store.file_digests(files).collect()} == {"a": hashlib.sha256(b"rules").hexdigest()[:16], "b": "MISSING"}
    assert monitors.anchor_currency("EURUSD") == "USD"
    with pytest.raises(ValueError):
        monitors.anchor_currency("GBPUSD")


def test_notes_of_a_study_without_trades(spark):
    none = spark.createDataFrame([], "event_id string, arm string, direction int, entry double, exit double, return_bps double")
    row = experiment.notes(none).first()
    assert (row.events, row.underpowered, row.ordering_holds) == (0, True, False)
    rows = [(str(e), arm, 1, 1.0, 1.0, base + e % 2) for e in range(20) for arm, base in (("A", 0.0), ("B", 1.0), ("C", 5.0), ("D", 6.0))]
    row = experiment.notes(spark.createDataFrame(rows, none.schema)).first()
    assert (row.events, row.underpowered, row.ordering_holds, row.largest_source) == (20, False, True, "coarse times")


OBSERVATION = "series_id string, ref_period date, known_at long, value double, vintage_seq long"


def test_revisions_of_zero_and_negative_first_prints(spark):
    rows = [("A", date(2024, 1, 1), 1, -4.0, 1), ("A", date(2024, 1, 1), 2, 5.0, 2), ("A", date(2024, 2, 1), 1, 0.0, 3), ("A", date(2024, 2, 1), 2, 3.0, 4), ("A", date(2024, 3, 1), 1, None, 5), ("A", date(2024, 3, 1), 2, 3.0, 6), ("A", date(2024, 4, 1), 1, 2.0, 7), ("A", date(2024, 4, 1), 2, 2.0, 8)]
    found = macro.revisions(spark.createDataFrame(rows, OBSERVATION)).orderBy("ref_period").collect()
    assert [(r.first, r.second, r.revision, r.pct, r.vintages) for r in found] == [(-4.0, 5.0, 9.0, 225.0, 2), (0.0, 3.0, 3.0, None, 2)]
    assert macro.revisions(spark.createDataFrame([], OBSERVATION)).count() == 0


def archive(spark):
    """Three vintages of eight periods: R is rebased twice, N revised by news, Z publishes all zeros, F has too few periods to tell."""
    rows, seq = [], 0
    for series, steps in (("R", (1.0, 2.5, 0.5)), ("N", (1.0, 1.0, 1.0)), ("Z", (0.0, 0.0, 0.0)), ("F", (1.0, 2.0, 2.0))):
        for k in range(2 if series == "F" else 8):
            value = 100.0 + 7 * k
            for v, step in enumerate(steps):
                value = round(value * step, 1) + (0.3 * (k % 3) if series == "N" and v else 0.0)
                seq += 1
                rows.append((series, date(2020, 1 + k, 1), v + 1, None if series == "R" and k == 7 and v == 1 else value, seq))
    return spark.createDataFrame(rows, OBSERVATION)


def test_rebases_are_found_and_left_out_of_the_ranking(spark):
    held = archive(spark)
    found = {(r.series_id, r.known_at): (r.periods, round(r.ratio, 3)) for r in macro.rebases(held).collect()}
    assert found == {("R", 2): (7, 2.5), ("R", 3): (7, 0.5)}
    assert macro.rebases(held, fewest=2).where("series_id = 'F'").count() == 2
    ranked = macro.top_revisions(held, 50).collect()
    assert {r.series_id for r in ranked} == {"N", "F"}
    assert macro.top_revisions(held, 50, ["R"]).count() == 7
    levels = macro.units(held).where("series_id = 'R' AND ref_period = DATE'2020-01-01'").orderBy("known_at").collect()
    # values are published rounded to a tenth, so factors are known to about a thousandth
    assert [r.factor for r in levels] == pytest.approx([1.25, 0.5, 1.0], rel=1e-3) and [r.level for r in levels] == pytest.approx([125.0] * 3, rel=1e-3)
    # repeated rows of one instant count once, and an empty table has no rebases
    assert macro.rebases(held.unionByName(held)).count() == 2 and macro.rebases(held.limit(0)).count() == 0


def test_no_quotes_have_no_share(spark):
    none, empty_flags = spark.createDataFrame([], TICK), empty(spark, "tick_flag")
    row = flags.flagged_share(empty_flags, none).first()
    assert (row.flagged, row.ticks, row.share) == (0, 0, None)


def test_an_entry_at_zero_has_no_return(spark):
    t = at(2024, 1, 9, 12)
    quotes = spark.createDataFrame([("E", t + k * 60 * MINUTE // 2, 0.0, 0.0, "a", k) for k in range(-26, 4)], TICK)
    events = spark.createDataFrame([("f", "E", t, 1.0, -1.0)], "event_id string, instrument string, release_at long, surprise_first double, surprise_final double")
    assert [r.return_bps for r in experiment.trades(events, quotes).collect()] == [None] * 4


def test_a_window_inside_a_long_one_overlaps_it(spark):
    windows = spark.createDataFrame([("s", 0, 100), ("s", 10, 20), ("s", 30, 40), ("s", 100, 110), ("t", 0, 5)], "session string, span_start long, span_end long")
    assert sorted(r.span_start for r in sessions.overlapping(windows, ["session"]).collect()) == [10, 30]
