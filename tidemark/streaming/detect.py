"""Detectors that need the quote before, on a stream: quotes wait until the watermark has passed them, and are then looked at in their order."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import HOUR, MINUTE
from ..operators.flags import GAP_MINUTES, STALE_RUN

FLAGS = "instrument string, ts long, seq long, flag string, detail string"
QUOTE = ["ts", "seq", "bid", "ask"]
#: Quotes in the state are packed rows of an hour. So many are held at most before they are put there, and looked at in one go.
PACKED, SLICE, HELD = np.dtype([("ts", "<i8"), ("seq", "<i8"), ("bid", "<f8"), ("ask", "<f8")]), HOUR, 100_000
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def flagged(rows: pd.DataFrame, last: tuple | None, length: int, minutes: int) -> tuple[pd.DataFrame, tuple | None]:
    """(ts, seq, flag, detail of the rows that are stale or come after a gap, the last row's (ts, bid, ask, run)) of rows in order after one with `last`.

    A quote's run is its number among equal ones without another between. The first quote of all is neither stale nor after a gap.
    """
    if rows.empty:
        return pd.DataFrame(columns=["ts", "seq", "flag", "detail"]), last
    ts, seq, bid, ask = (rows[c].to_numpy() for c in QUOTE)
    before = last or (ts[0], np.nan, np.nan, 0)
    same = (bid == np.append(before[1], bid[:-1])) & (ask == np.append(before[2], ask[:-1]))
    place = np.arange(len(rows))
    begun = np.maximum.accumulate(np.where(same, -1, place))
    run = np.where(begun < 0, before[3] + place + 1, place - begun + 1)
    previous = np.append(before[0], ts[:-1])
    gap = (ts - previous >= minutes * MINUTE) & ((place > 0) | (last is not None))
    stale = run >= length
    out = [(ts[k], seq[k], "stale", f"bid={bid[k]:.5f} ask={ask[k]:.5f} repeat_index={run[k]}") for k in np.flatnonzero(stale)]
    out += [(ts[k], seq[k], "session_gap", f"minutes={(ts[k] - previous[k]) // MINUTE} previous={previous[k]}") for k in np.flatnonzero(gap)]
    return pd.DataFrame(out, columns=["ts", "seq", "flag", "detail"]), (int(ts[-1]), float(bid[-1]), float(ask[-1]), int(run[-1]))


def packed(frame: pd.DataFrame) -> np.ndarray:
    rows = np.empty(len(frame), PACKED)
    for c in QUOTE:
        rows[c] = frame[c].astype(PACKED[c])
    return rows


class InOrder(StatefulProcessor):
    """One instrument's quotes: those that the watermark hasn't passed are in the state by hours, and of those before it one row is.

    What comes in is packed, at most HELD rows and a frame at a time; what the watermark passes is read hour by hour. So memory holds an hour's quotes, however many wait.
    """

    def __init__(self, length: int, minutes: int) -> None:
        self.length, self.minutes = length, minutes

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getMapState("slices", "slice long, part long", "rows binary")
        self.parts = handle.getValueState("parts", "next long")
        self.last = handle.getValueState("last", "ts long, bid double, ask double, run long")

    def keep(self, held: list[np.ndarray]) -> None:
        rows = np.concatenate(held)
        rows = rows[np.argsort(rows["ts"] // SLICE, kind="stable")]
        slices, starts = np.unique(rows["ts"] // SLICE, return_index=True)
        part = self.parts.get()[0] if self.parts.exists() else 0
        for number, own in zip(slices.tolist(), np.split(rows, starts[1:]), strict=True):
            self.pending.updateValue((number, part), (own.tobytes(),))
        self.parts.update((part + 1,))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  names are Spark's
        latest, held, count = 0, [], 0
        for frame in rows:
            held.append(packed(frame))
            count += len(frame)
            latest = max(latest, int(frame.ts.max()))
            if count >= HELD:
                self.keep(held)
                held, count = [], 0
        if held:
            self.keep(held)
        self.handle.registerTimer(-(-latest // 1000))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        parts: dict[int, list[int]] = {}
        for number, part in self.pending.keys():
            if number * SLICE <= passed:
                parts.setdefault(number, []).append(part)
        last = self.last.get() if self.last.exists() else None
        for number in sorted(parts):
            rows = np.frombuffer(b"".join(bytes(self.pending.getValue((number, part))[0]) for part in parts[number]), PACKED)
            done, wait = rows[rows["ts"] <= passed], rows[rows["ts"] > passed]
            for part in parts[number]:
                self.pending.removeKey((number, part))
            if len(wait):
                self.pending.updateValue((number, parts[number][0]), (wait.tobytes(),))
            done = done[np.lexsort((done["seq"], done["ts"]))]
            for k in range(0, len(done), HELD):
                found, last = flagged(pd.DataFrame(done[k : k + HELD]), last, self.length, self.minutes)
                if len(found):
                    found.insert(0, "instrument", key[0])
                    yield found
        if last is not None:
            self.last.update(last)

    def close(self) -> None:
        pass


def flags_stream(quotes: DataFrame, late: str = "1 hour", length: int = STALE_RUN, minutes: int = GAP_MINUTES) -> DataFrame:
    """FLAGS rows of stale runs and session gaps of a stream of quotes with a timestamp at: what flags.stale and flags.session_gap find in all of them, in whatever batches they come.

    A quote that comes later than `late` is dropped. The state of an instrument is its quotes of that time, packed by hours, and one row. Quotes wait for the watermark, which
    any instrument's later quote moves; so the last ones of a stream that ends wait for ever, unless a row of an instrument of its own is sent after them.
    The state is kept in RocksDB, which the session's state store provider is set to.
    """
    quotes.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    rows = quotes.withColumn("ts", F.unix_micros("at")).withWatermark("at", late).select("instrument", "at", *QUOTE)
    return rows.groupBy("instrument").transformWithStateInPandas(InOrder(length, minutes), FLAGS, "append", "eventtime")
