"""Stored tables: parts are replaced and the rest keeps its files; what a run leaves behind is finished or undone."""

import json
from datetime import datetime, timezone
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tidemark.functions import DAY, HOUR, MINUTE, instant
from tidemark.operators import bars, flags, sessions
from tidemark.sources import store, tables

TICK = "instrument string, ts long, bid double, ask double, source string, seq long, bid_volume float, ask_volume float"


def at(*parts):
    return instant(datetime(*parts, tzinfo=timezone.utc))


def quotes(spark, rows):
    return spark.createDataFrame([(*r, None, None) for r in rows], TICK)


def files(folder, name):
    top = Path(folder) / name
    return {str(p.relative_to(top)): p.stat().st_mtime_ns for p in top.rglob("*.parquet")}


@pytest.fixture
def folder(spark, tmp_path):
    t = at(2024, 1, 31, 12)
    rows = [("E", t + k * HOUR, 1.0 + k, 1.5 + k, "a", k) for k in range(24)] + [("G/x", t + k * HOUR, 1.0, 1.0, "b", 100 + k) for k in range(3)]
    store.append_hours(quotes(spark, rows), str(tmp_path))
    return str(tmp_path)


def test_taken_back_hours_leave_other_files_alone(spark, folder):
    t = at(2024, 1, 31, 12)
    before = files(folder, "tick_raw")
    stuck = spark.createDataFrame([("E", "a", t), ("E", "b", t + HOUR), ("E", "a", t + 2 * HOUR)], "instrument string, source string, hour long")
    assert store.take_back(spark, folder, stuck) == 1
    left = sorted(r.seq for r in tables.read(spark, folder, "tick_raw").collect())
    assert left == [1, *range(3, 24), 100, 101, 102]
    after = files(folder, "tick_raw")
    moved = {p for p in before if after.get(p) != before[p]}
    assert moved and all(p.startswith("instrument=E/month=2024-01") for p in moved)
    assert store.take_back(spark, folder, stuck.limit(0)) == 0
    every = spark.createDataFrame([("G/x", "b", t + k * HOUR) for k in range(3)], "instrument string, source string, hour long")
    store.take_back(spark, folder, every)
    assert not [p for p in files(folder, "tick_raw") if p.startswith("instrument=G")]
    assert tables.read(spark, folder, "tick_raw").count() == 22


def test_bars_of_a_range_are_stored_anew_and_twice_is_once(spark, folder):
    t = at(2024, 1, 31, 12)
    ticks = tables.read(spark, folder, "tick_raw")
    whole = bars.bars_from_ticks(ticks)
    done = store.store_bars(spark, folder, ticks, ["E", "G/x", "absent"], t, t + DAY)
    assert (done.kept, done.written, done.partitions) == (0, 27, 3)
    order = ["instrument", "source", "minute"]
    read = lambda: sorted(map(tuple, tables.read(spark, folder, "bar_1m").select(*whole.columns).collect()))
    assert read() == sorted(map(tuple, whole.collect()))
    before = files(folder, "bar_1m")
    done = store.store_bars(spark, folder, ticks.where("seq < 5"), ["E"], t + 4 * HOUR, t + 6 * HOUR)
    assert (done.kept, done.written, done.partitions) == (10, 1, 1)
    lost = {(r.instrument, r.minute) for r in whole.select(*order).collect()} - {(r[0], r[2]) for r in read()}
    assert lost == {("E", t + 5 * HOUR)}
    after = files(folder, "bar_1m")
    assert {p for p in before if after.get(p) == before[p]} == {p for p in before if not p.startswith("instrument=E/month=2024-01")}
    with pytest.raises(ValueError):
        store.store_bars(spark, folder, ticks, ["E"], t + 1, t + MINUTE)


def test_rows_out_of_scope_change_nothing(spark, folder):
    before = files(folder, "tick_raw")
    strange = tables.read(spark, folder, "tick_raw").withColumn("instrument", F.lit("Z"))
    with pytest.raises(ValueError, match="outside"):
        tables.replace(spark, folder, "tick_raw", strange, F.lit(True), [("E",)], at(2024, 1, 1), at(2024, 3, 1))
    assert files(folder, "tick_raw") == before


def test_a_run_that_died_is_finished_or_undone(spark, folder):
    top = Path(folder) / "tick_raw"
    rows = spark.createDataFrame(tables.read(spark, folder, "tick_raw").collect(), tables.SCHEMAS["tick_raw"])
    staged = top / "_staged" / "one" / "new"
    tables.with_month(rows.where("instrument = 'E' AND seq < 3"), "tick_raw").write.partitionBy("instrument", "month").parquet(str(staged))
    assert tables.read(spark, folder, "tick_raw").count() == 27
    assert tables.recover(spark, folder, "tick_raw") == 1 and not staged.exists()
    assert tables.read(spark, folder, "tick_raw").count() == 27
    for done in range(3):
        tables.with_month(rows.where("instrument = 'E' AND seq < 3"), "tick_raw").write.partitionBy("instrument", "month").parquet(str(staged))
        places = ["instrument=E/month=2024-01", "instrument=E/month=2024-02"]
        (staged.parent / "_ready").write_text(json.dumps({"places": places, "staged": places[:1]}))
        if done:  # it died after the first move, or after the second
            (staged.parent / "old" / "instrument=E").mkdir(parents=True)
            (top / places[0]).rename(staged.parent / "old" / places[0])
        if done == 2:
            (staged / places[0]).rename(top / places[0])
        assert tables.recover(spark, folder, "tick_raw") == 1
        assert sorted(r.seq for r in tables.read(spark, folder, "tick_raw").collect()) == [0, 1, 2, 100, 101, 102]
    assert tables.recover(spark, folder, "tick_raw") == 0


def test_flags_are_found_once_and_counted_as_they_are_written(spark, folder):
    t = at(2024, 1, 31, 12)
    old = spark.createDataFrame([("E", t, "crossed", "old"), ("G/x", t, "zero_spread", "old"), ("G/x", t + DAY, "zero_spread", "old")], "instrument string, ts long, flag string, detail string")
    tables.append(old, folder, "tick_flag")
    for _ in range(2):
        report = flags.rescan(spark, folder, None, None, None, ["E", "G/x"], t, t + DAY, ["crossed", "zero_spread", "weekend_gap", "stale"])
        assert report.written == {"crossed": 0, "zero_spread": 3, "stale": 0} and set(report.errors) == {"weekend_gap"} and report.total == 3
    assert report.deleted == {"crossed": 0, "zero_spread": 3, "stale": 0}
    found = sorted((r.instrument, r.ts, r.flag, r.detail) for r in tables.read(spark, folder, "tick_flag").collect())
    assert found == [("G/x", t + k * HOUR, "zero_spread", "price=1.00000") for k in range(3)] + [("G/x", t + DAY, "zero_spread", "old")]


def test_a_detector_runs_once(spark, folder, monkeypatch):
    t, calls = at(2024, 1, 31, 12), spark.sparkContext.accumulator(0)

    def counting(ticks):
        def touch(frames):
            for f in frames:
                calls.add(len(f))
                yield f

        return flags._flag(ticks.mapInPandas(touch, ticks.schema), "crossed", "'x'")

    monkeypatch.setattr(flags, "DETECTORS", [flags.Detector("crossed", "", counting)])
    report = flags.rescan(spark, folder, None, None, None, ["E", "G/x"], t, t + DAY)
    assert report.written == {"crossed": 27} and calls.value == 27


def test_calendar_windows_are_stored_anew(spark, tmp_path):
    made = lambda a, b: sessions.market_windows(spark, a.date(), b.date())
    start, end = datetime(2024, 1, 1, tzinfo=timezone.utc), datetime(2024, 4, 1, tzinfo=timezone.utc)
    whole = sorted(map(tuple, made(start, end).collect()))
    store.store_windows(spark, str(tmp_path), "market_window", made(start, end), instant(start), instant(end), 7 * DAY)
    before = files(tmp_path, "market_window")
    a, b = datetime(2024, 2, 12, tzinfo=timezone.utc), datetime(2024, 2, 16, tzinfo=timezone.utc)
    done = store.store_windows(spark, str(tmp_path), "market_window", made(a, b), instant(a), instant(b), 7 * DAY)
    assert (done.written, done.partitions) == (1, 1)
    assert sorted(map(tuple, tables.read(spark, str(tmp_path), "market_window").collect())) == whole
    after = files(tmp_path, "market_window")
    assert all(p.startswith("month=2024-02") for p in before if after.get(p) != before[p])


def test_a_session_opens_only_its_months(spark, folder):
    inside = store.open_session(spark, folder, instruments=["E"], start=at(2024, 2, 1), end=at(2024, 2, 1, 6))["tick_raw"]
    assert sorted(r.seq for r in inside.collect()) == list(range(12, 18))
    plan = inside._jdf.queryExecution().executedPlan().toString()
    line = next(x for x in plan.splitlines() if "PartitionFilters" in x)
    head = line[line.index("PartitionFilters") : line.index("PushedFilters")]
    assert "month" in head and "instrument" in head
    for path in Path(folder).rglob("*.parquet"):
        if "instrument=E/month=2024-02" not in str(path):
            path.write_bytes(b"nobody reads this")
            path.with_name(f".{path.name}.crc").unlink(missing_ok=True)
    assert store.open_session(spark, folder, instruments=["E"], start=at(2024, 2, 1), end=at(2024, 2, 1, 6))["tick_raw"].count() == 6


def test_a_damaged_table_is_not_an_empty_one(spark, tmp_path):
    (tmp_path / "macro_series").mkdir()
    (tmp_path / "macro_series" / "part-0.parquet").write_bytes(b"not parquet")
    with pytest.raises(Exception):  # noqa: B017
        tables.read(spark, str(tmp_path), "macro_series").count()
    with pytest.raises(Exception):  # noqa: B017
        store.kept_releases(spark, f"{tmp_path}/macro_series", None, 0, 1)
    assert tables.read(spark, str(tmp_path), "macro_release").count() == 0


def test_months():
    assert tables.months(at(2023, 12, 31, 23), at(2024, 2, 1)) == ["2023-12", "2024-01"]
    assert tables.months(at(2023, 12, 1), at(2023, 12, 1)) == [] and tables.months(at(2023, 12, 1), at(2023, 12, 1) + 1) == ["2023-12"]
    assert tables.month_text(at(2024, 2, 29, 23)) == "2024-02"


def test_upserts_by_key_leave_other_months_alone(spark, tmp_path):
    folder, keys = str(tmp_path), ["fix_date", "currency"]
    rates = lambda *rows: spark.createDataFrame([(datetime.fromisoformat(x).date(), c, r) for x, c, r in rows], "fix_date date, currency string, rate double")
    first = rates(("2023-12-29", "USD", 1.0), ("2024-01-02", "USD", 1.1), ("2024-01-02", "JPY", 160.0), ("2024-02-01", "USD", 1.2))
    assert store.upsert_stored(spark, folder, "reference_rate", first, keys).partitions == 3
    before = files(folder, "reference_rate")
    again = rates(("2024-01-02", "JPY", 161.0), ("2024-01-03", "JPY", 162.0), ("2024-01-03", "JPY", 161.5))
    for _ in range(2):
        assert store.upsert_stored(spark, folder, "reference_rate", again, keys).partitions == 1
        # of keys that come twice the greatest rate stays
        assert sorted((str(r.fix_date), r.currency, r.rate) for r in tables.read(spark, folder, "reference_rate").collect()) == [
            ("2023-12-29", "USD", 1.0), ("2024-01-02", "JPY", 161.0), ("2024-01-02", "USD", 1.1), ("2024-01-03", "JPY", 162.0), ("2024-02-01", "USD", 1.2)]
    after = files(folder, "reference_rate")
    assert {p for p in after if "2024-01" not in p} == {p for p in before if "2024-01" not in p} and all(after[p] == t for p, t in before.items() if "2024-01" not in p)
    assert store.upsert_stored(spark, folder, "reference_rate", again.where("false"), keys).partitions == 0
    assert files(folder, "reference_rate") == after


def test_upserts_only_open_the_partitions_they_are_in(spark, tmp_path):
    folder, day = str(tmp_path), datetime(2024, 1, 5).date()
    rows = lambda *names: spark.createDataFrame([(day, n, 1.0, x, 3, 0.0) for n, x in names], "fix_date date, instrument string, fix double, mean_mid double, ticks long, diff_pips double")
    store.upsert_stored(spark, folder, "drift_observation", rows(("E", 1.0), ("G/x", 2.0)), ["fix_date", "instrument"])
    before = files(folder, "drift_observation")
    assert store.upsert_stored(spark, folder, "drift_observation", rows(("G/x", 2.5)), ["fix_date", "instrument"]).partitions == 1
    assert sorted((r.instrument, r.mean_mid) for r in tables.read(spark, folder, "drift_observation").collect()) == [("E", 1.0), ("G/x", 2.5)]
    assert {p: t for p, t in files(folder, "drift_observation").items() if "instrument=E" in p} == {p: t for p, t in before.items() if "instrument=E" in p}
