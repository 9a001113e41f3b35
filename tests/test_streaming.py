"""Streams against the same operators over all rows at once."""

import random
from datetime import datetime, timedelta, timezone

import pandas as pd
import pytest

from tidemark.functions import HOUR, MINUTE, instant
from tidemark.operators import bars, flags, silence
from tidemark.sources import tables
from tidemark.streaming import compact_bars, keep_bars, kept_bars
from tidemark.streaming.detect import flagged, flags_stream

QUOTE = "instrument string, at timestamp, ts long, bid double, ask double, source string, seq long"
T0 = datetime(2024, 1, 9, tzinfo=timezone.utc)


def quotes(seed=3, n=400):
    rng = random.Random(seed)
    at, out = {"E": T0, "G": T0}, []
    for k in range(n):
        name = rng.choice("EEG")
        at[name] += timedelta(seconds=rng.choice([0, 1, 1, 7, 40, 3000, 3600 * 3] if k % 25 == 0 else [0, 1, 7, 40]), microseconds=rng.randint(0, 999))
        bid = float(rng.choice([1, 1, 1, 1, 2]))
        out.append((name, at[name], instant(at[name]), bid, bid + 0.5, "a", k))
    return out


def stream_of(spark, tmp_path, batches):
    for number, rows in enumerate(batches):
        spark.createDataFrame(rows, QUOTE).coalesce(1).write.parquet(f"{tmp_path}/in/{number:03d}")
    return spark.readStream.schema(QUOTE).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")


def run(frame, name):
    query = frame.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return frame.sparkSession.table(name)


def same(a, b):
    return sorted(map(tuple, a.collect()), key=repr) == sorted(map(tuple, b.select(*a.columns).collect()), key=repr)


def test_kept_bars_take_in_quotes_days_late(spark, tmp_path):
    rows = quotes() + [("E", T0 + timedelta(days=3, seconds=k), instant(T0 + timedelta(days=3, seconds=k)), 5.0, 6.0, "a", 1000 + k) for k in range(5)]
    random.Random(1).shuffle(rows)
    cut = [rows[:90], rows[90:91], rows[91:300], rows[300:]]
    folder = f"{tmp_path}/tables"
    stream = stream_of(spark, tmp_path, cut)
    keep_bars(stream, folder, f"{tmp_path}/check", availableNow=True).awaitTermination()
    whole = bars.bars_from_ticks(spark.createDataFrame(rows, QUOTE))
    assert same(kept_bars(spark, folder), whole)
    parts = tables.read(spark, folder, "bar_part").count()
    done = compact_bars(spark, folder, ["E", "G"], instant(T0), instant(T0 + timedelta(days=9)))
    assert done.written < parts and same(kept_bars(spark, folder), whole)
    assert compact_bars(spark, folder, ["E", "G"], instant(T0), instant(T0 + timedelta(days=9))) is None
    # a stream that goes on where its checkpoint is brings quotes of minutes that have been compacted
    late = [("G", T0, instant(T0) - k, 0.5, 9.0, "a", 2000 + k) for k in range(3)]
    spark.createDataFrame(late, QUOTE).coalesce(1).write.parquet(f"{tmp_path}/in/009")
    keep_bars(stream, folder, f"{tmp_path}/check", availableNow=True).awaitTermination()
    assert same(kept_bars(spark, folder), bars.bars_from_ticks(spark.createDataFrame(rows + late, QUOTE)))


def test_a_batch_that_runs_again_is_kept_once(spark, tmp_path):
    rows, folder = quotes(5, 60), f"{tmp_path}/tables"
    for again in range(2):  # the same batch number twice, as after a failure before its commit
        stream = stream_of(spark, tmp_path / str(again), [rows])
        keep_bars(stream, folder, f"{tmp_path}/check{again}", availableNow=True).awaitTermination()
    assert same(kept_bars(spark, folder), bars.bars_from_ticks(spark.createDataFrame(rows, QUOTE)))


@pytest.mark.parametrize("cut", [[400], [1, 2, 60, 61, 200], list(range(0, 400, 45))])
def test_streamed_flags_are_those_of_all_quotes(spark, tmp_path, cut):
    rows = sorted(quotes(), key=lambda r: (r[2], r[6]))
    ends = [0, *cut, len(rows)]
    batches = [rows[a:b] for a, b in zip(ends, ends[1:], strict=False) if a < b]
    for batch in batches:  # out of order within a batch
        random.Random(2).shuffle(batch)
    end = T0 + timedelta(days=400)
    batches.append([("heartbeat", end, instant(end), 0.0, 0.0, "a", -1)])
    found = run(flags_stream(stream_of(spark, tmp_path, batches), "1 minute"), f"flags{len(cut)}")
    ticks = spark.createDataFrame(rows, QUOTE)
    wanted = flags.stale(ticks).unionByName(flags.session_gap(ticks))
    assert wanted.count() > 50 and same(found, wanted)


def test_flags_of_rows_in_parts():
    rows = pd.DataFrame([(r[2], r[6], r[3], r[4]) for r in sorted((r for r in quotes() if r[0] == "E"), key=lambda r: (r[2], r[6]))], columns=["ts", "seq", "bid", "ask"])
    whole, end = flagged(rows, None, 4, 30)
    last, parts = None, []
    for k in range(0, len(rows), 7):
        found, last = flagged(rows[k : k + 7], last, 4, 30)
        parts.append(found)
    assert last == end and sorted(map(tuple, pd.concat(parts).to_numpy())) == sorted(map(tuple, whole.to_numpy()))


def test_runs_between_silences(spark, tmp_path):
    rows = quotes(8, 300)
    ticks = spark.createDataFrame(rows, QUOTE)
    minutes = 50
    wanted = []
    for name in "EG":
        times = sorted(r[2] for r in rows if r[0] == name)
        parts = [[times[0]]]
        for t in times[1:]:
            parts.append([t]) if t - parts[-1][-1] >= minutes * MINUTE else parts[-1].append(t)
        wanted += [(name, p[0], p[-1], len(p), (q[0] - p[-1]) // MINUTE if q else None) for p, q in zip(parts, [*parts[1:], None], strict=True)]
    assert len(wanted) > 4
    assert sorted(map(tuple, silence.active_runs(ticks, minutes).collect())) == sorted(wanted)
    assert silence.active_runs(ticks.limit(0)).count() == 0
    end = T0 + timedelta(days=400)
    ordered = sorted(rows, key=lambda r: r[2])
    stream = stream_of(spark, tmp_path, [ordered[:100], ordered[100:], [("heartbeat", end, instant(end), 0.0, 0.0, "a", -1)]])
    found = run(silence.active_runs_stream(stream, minutes, "1 second"), "runs")
    assert sorted(map(tuple, found.where("instrument <> 'heartbeat'").collect())) == sorted(w[:4] for w in wanted)


def test_a_run_over_midnight_is_one(spark):
    t = instant(T0) - HOUR
    rows = [("E", None, t + k * 30 * MINUTE, 1.0, 1.0, "a", k) for k in range(6)] + [("E", None, t + 5 * HOUR, 1.0, 1.0, "a", 9)]
    found = silence.active_runs(spark.createDataFrame(rows, QUOTE)).orderBy("run_start").collect()
    assert [(r.run_start, r.run_end, r.ticks, r.silent_minutes) for r in found] == [(t, t + 150 * MINUTE, 6, 150), (t + 5 * HOUR, t + 5 * HOUR, 1, None)]
