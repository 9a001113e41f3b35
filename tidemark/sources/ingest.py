"""A run that brings a feed's hours into the stored quotes: claim, append, settle, in this order, so that whatever a run leaves behind the next one can tell.

A claim that never settled is of a run that died: its quotes are taken back before anything else, so that fetching the hour again adds none twice. Hours
that are settled are never fetched again; a second run over a range fetches nothing, adds nothing and has no errors.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import HOUR
from ..operators import ledger
from . import hour_ticks, hours_between, store, tables
from .feeds import content_of, open_folder, place_of

EXAMPLES = 20
FETCHED = "instrument string, hour long, status string, detail string, byte_count long, ts long, bid double, ask double, bid_volume float, ask_volume float, seq long"


@dataclass
class RunReport:
    """Hours asked for, settled before, and fetched; quotes added; hours by status; how many failed, with a few examples; claims of dead runs that were taken back."""

    requested: int = 0
    skipped_settled: int = 0
    fetched: int = 0
    rows_inserted: int = 0
    by_status: dict[str, int] = field(default_factory=dict)
    errors: int = 0
    examples: list[str] = field(default_factory=list)
    stale_recovered: int = 0

    @property
    def is_noop(self) -> bool:
        """Whether the run changed nothing."""
        return not (self.fetched or self.rows_inserted or self.errors or self.stale_recovered)


def fetch(hours: DataFrame, feed: str) -> DataFrame:
    """FETCHED rows of (instrument, hour): a row for each tick of an ok hour, and one row without a ts for an hour that is empty, missing or an error.

    What is wrong with one file is its own hour's status and no other's.
    """

    def hour_of(reader, instrument: str, hour: int) -> pd.DataFrame:
        said = {"instrument": [instrument], "hour": [hour], "detail": [None], "byte_count": [0]}
        try:
            content = content_of(reader[0], f"{reader[1]}/{place_of(instrument, hour)}")
            if content is None:
                return pd.DataFrame(said | {"status": ["missing"]})
            said["byte_count"] = [len(content)]
            found = hour_ticks(instrument, hour, content)
        except Exception as error:  # noqa: BLE001  kept as the hour's status
            return pd.DataFrame(said | {"status": ["error"], "detail": [f"{type(error).__name__}: {error}"[:500]]})
        if not len(found):
            return pd.DataFrame(said | {"status": ["empty"]})
        return found.assign(hour=hour, status="ok", detail=None, byte_count=len(content))

    names = [c.split()[0] for c in FETCHED.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = open_folder(feed)
        for frame in frames:
            for instrument, hour in zip(frame.instrument, frame.hour, strict=True):
                rows = hour_of(reader, instrument, int(hour)).reindex(columns=names)
                yield rows.astype({"ts": "Int64", "seq": "Int64", "byte_count": "Int64", "detail": object})

    return hours.select("instrument", "hour").mapInPandas(run, FETCHED)


def _write_ledger(spark: SparkSession, folder: str, book: DataFrame, instruments: list[str], start: int, end: int) -> None:
    inside = F.col("instrument").isin(instruments) & (F.col("hour") >= start) & (F.col("hour") < end)
    tables.replace(spark, folder, "ingest_ledger", book.where(inside), inside, [(i,) for i in instruments], start, end)


def recover(spark: SparkSession, folder: str, source: str) -> int:
    """Take back the stored quotes of a source's claims that never settled, then the claims; how many these were. After a crash in between it can run again."""
    stuck, rest = ledger.reset_stale(tables.read(spark, folder, "ingest_ledger"), source)
    ends = stuck.agg(F.count("*").alias("n"), F.min("hour").alias("a"), F.max("hour").alias("z"), F.collect_set("instrument").alias("names")).first()
    if ends.n:
        store.take_back(spark, folder, stuck)
        _write_ledger(spark, folder, rest, sorted(ends.names), ends.a, ends.z + HOUR)
    return ends.n


def ingest(spark: SparkSession, folder: str, feed: str, instruments: list[str], start: int, end: int, source: str, now: int, only_hours: list[int] | None = None, dry_run: bool = False, tasks: int | None = None) -> RunReport:
    """Bring the feed's hours that begin in [start, end) into the folder's tables; `now` is the instant that claims are dated with. One run at a time for a folder.

    Files are opened in at most `tasks` tasks at once, so that a feed isn't asked for more than it gives; the default is what the cluster runs.
    An append that fails has its quotes taken back and its hours settled as errors, which a later run tries again.
    """
    if start % HOUR:
        start += HOUR - start % HOUR
    for name in ("tick_raw", "ingest_ledger"):
        tables.recover(spark, folder, name)
    report = RunReport() if dry_run else RunReport(stale_recovered=recover(spark, folder, source))
    hours = hours_between(spark, start, end, only_hours)
    wanted = hours.select(F.explode(F.array(*map(F.lit, instruments))).alias("instrument"), "hour", F.lit(source).alias("source"))
    book = tables.read(spark, folder, "ingest_ledger", start, end)
    todo = ledger.to_do(wanted, book)
    report.requested, left = wanted.count(), todo.count()
    report.skipped_settled = report.requested - left
    if dry_run or not left:
        return report
    _write_ledger(spark, folder, ledger.claim(book, todo, now), instruments, start, end)
    book = tables.read(spark, folder, "ingest_ledger", start, end)
    mine = book.where((F.col("status") == "in_progress") & (F.col("source") == source) & (F.col("claimed_at") == now) & F.col("instrument").isin(instruments))
    run = f"{folder}/_runs/{uuid.uuid4().hex}"
    fetch(mine.repartition(tasks or spark.sparkContext.defaultParallelism, "instrument", "hour"), feed).write.parquet(run)
    got = spark.read.schema(FETCHED).parquet(run)
    per_hour = got.groupBy("instrument", "hour").agg(F.min("status").alias("status"), F.count("ts").alias("tick_count"), F.max("byte_count").alias("byte_count"), F.min("detail").alias("detail"))
    results = per_hour.withColumn("source", F.lit(source))
    try:
        store.append_hours(got.where("ts IS NOT NULL").withColumn("source", F.lit(source)), folder)
    except Exception as error:  # noqa: BLE001  it is told in the ledger and the report
        store.take_back(spark, folder, mine)
        results = results.withColumns({"status": F.lit("error"), "tick_count": F.lit(0).cast("long"), "detail": F.lit(f"append: {error}"[:500])})
    _write_ledger(spark, folder, ledger.settle(book, results, now), instruments, start, end)
    for row in results.groupBy("status").agg(F.count("*").alias("n"), F.sum("tick_count").alias("ticks")).collect():
        report.by_status[row.status] = row.n
        report.fetched += row.n
        report.rows_inserted += row.ticks
    report.errors = report.by_status.get("error", 0)
    failed = results.where("status = 'error'").orderBy("instrument", "hour").limit(EXAMPLES).collect()
    report.examples = [f"{r.instrument} {r.hour}: {r.detail}" for r in failed]
    tables.Files(spark, run).delete()
    return report
