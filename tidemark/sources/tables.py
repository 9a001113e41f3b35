"""Stored tables whose parts are replaced: Parquet folders partitioned by named columns and a month, with a staged swap of whole partitions.

A replacement reads what it keeps and what is new, writes both beside the table, and only once that is committed moves partitions into place. Readers of the
table never meet half a partition's rows twice, and a run that dies in between is finished or undone by the next one.
"""

from __future__ import annotations

import json
import re
import tempfile
import uuid
from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone
from itertools import product

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions import day_of
from .schemas import SCHEMAS, empty

#: Of each stored table the column of instants or dates that tells the month, and the columns it is partitioned by before that.
LAYOUT = {
    "tick_raw": ("ts", ("instrument",)),
    "bar_1m": ("minute", ("instrument",)),
    "bar_part": ("minute", ("batch", "instrument")),
    "tick_flag": ("ts", ("flag", "instrument")),
    "ingest_ledger": ("hour", ("instrument",)),
    "session_window": ("span_start", ()),
    "market_window": ("span_start", ()),
    "rollover_window": ("span_start", ()),
    "calendar_hour": ("hour", ()),
    "reference_rate": ("fix_date", ()),
    "drift_observation": ("fix_date", ("instrument",)),
}
STAGED, READY = "_staged", "_ready"


@dataclass(frozen=True)
class Replaced:
    """Rows that a replacement kept and wrote anew, and how many partitions it swapped."""

    kept: int
    written: int
    partitions: int


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder that all executors share: in the cluster's spark.checkpoint.dir, else in the warehouse; a temporary one only if all runs in one local process, as in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and re.fullmatch(r"local(\[[^-]*\])?", spark.sparkContext.master):
        return f"file://{tempfile.mkdtemp(prefix='spark-')}/{name}"
    return f"{folder or spark.conf.get('spark.sql.warehouse.dir') + '/scratch'}/{name}-{uuid.uuid4().hex}"


def month_text(at: int) -> str:
    return (datetime(1970, 1, 1, tzinfo=timezone.utc) + timedelta(microseconds=at)).strftime("%Y-%m")


def months(start: int, end: int) -> list[str]:
    """The months, as text, that [start, end) touches."""
    if start >= end:
        return []
    first, last = (datetime(1970, 1, 1, tzinfo=timezone.utc) + timedelta(microseconds=t) for t in (start, end - 1))
    return [f"{k // 12:04d}-{k % 12 + 1:02d}" for k in range(first.year * 12 + first.month - 1, last.year * 12 + last.month)]


def with_month(rows: DataFrame, name: str) -> DataFrame:
    at = LAYOUT[name][0]
    return rows.withColumn("month", F.date_format(at if kinds_of(name)[at] == "date" else day_of(at), "yyyy-MM"))


def kinds_of(name: str) -> dict[str, str]:
    return dict(c.split() for c in SCHEMAS[name].split(", "))


def columns_of(name: str) -> list[str]:
    return list(kinds_of(name))


def shaped(rows: DataFrame, name: str) -> DataFrame:
    """rows with the table's columns; those that rows lack are null."""
    kinds = kinds_of(name)
    return rows.select(*(F.col(c) if c in rows.columns else F.lit(None).cast(kinds[c]).alias(c) for c in kinds))


def read(spark: SparkSession, folder: str, name: str, start: int | None = None, end: int | None = None) -> DataFrame:
    """The stored table; one that was never written is empty, and any other error is one. With both ends only the months of [start, end) are listed and opened."""
    schema = SCHEMAS[name] + (", month string" if name in LAYOUT else "")
    try:
        rows = spark.read.schema(schema).parquet(f"{folder}/{name}")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return empty(spark, name)
    if name in LAYOUT and start is not None and end is not None:
        rows = rows.where(F.col("month").isin(months(start, end)))
    return rows.select(*columns_of(name))


def append(rows: DataFrame, folder: str, name: str) -> None:
    """Add rows as they are, whole or not at all. A rebalance before the write makes few files of each partition and splits a large one."""
    by = [*LAYOUT[name][1], "month"]
    with_month(shaped(rows, name), name).hint("rebalance", *by).write.mode("append").partitionBy(*by).parquet(f"{folder}/{name}")


class Files:
    """The table's file system, as Spark sees it."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.jvm, self.root = spark._jvm, path
        self.Path = self.jvm.org.apache.hadoop.fs.Path
        self.fs = self.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def at(self, *parts: str):
        return self.Path("/".join([self.root, *(p for p in parts if p)]))

    def exists(self, *parts: str) -> bool:
        return self.fs.exists(self.at(*parts))

    def move(self, source: str, target: str) -> None:
        self.fs.mkdirs(self.at(target).getParent())
        if not self.fs.rename(self.at(source), self.at(target)):
            raise OSError(f"{source} couldn't be moved to {target} in {self.root}")

    def delete(self, *parts: str) -> None:
        self.fs.delete(self.at(*parts), True)

    def names(self, *parts: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self.at(*parts))) if self.exists(*parts) else []

    def put(self, text: str, *parts: str) -> None:
        out = self.fs.create(self.at(*parts), True)
        out.write(bytearray(text.encode()))
        out.close()

    def get(self, *parts: str) -> str:
        source = self.fs.open(self.at(*parts))
        try:
            return bytes(source.readAllBytes()).decode()
        finally:
            source.close()

    def place(self, by: Sequence[str], values: Sequence[str]) -> str:
        escape = self.jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
        return "/".join(f"{c}={escape(v)}" for c, v in zip(by, values, strict=True))

    def leaves(self, depth: int, *parts: str) -> list[str]:
        """Partition folders so many levels below a folder."""
        if depth == 0:
            return [""]
        return [f"{n}/{rest}".rstrip("/") for n in self.names(*parts) if "=" in n for rest in self.leaves(depth - 1, *parts, n)]


def _swap(files: Files, run: str) -> None:
    """Move the run's partitions into place. Every step can be done again: what has been moved isn't there any more."""
    plan = json.loads(files.get(STAGED, run, READY))
    for place in plan["places"]:
        new, old = f"{STAGED}/{run}/new/{place}", f"{STAGED}/{run}/old/{place}"
        staged = place in plan["staged"]
        # the old one leaves while the new one is still staged, or has none to follow it
        if files.exists(place) and (files.exists(new) if staged else not files.exists(old)):
            if files.exists(old):
                files.delete(old)
            files.move(place, old)
        if staged and files.exists(new):
            files.move(new, place)
    files.delete(STAGED, run)


def recover(spark: SparkSession, folder: str, name: str) -> int:
    """Finish replacements that were committed and undo those that weren't; how many there were. Run before writing to a table that another writer may have left."""
    files = Files(spark, f"{folder}/{name}")
    runs = files.names(STAGED)
    for run in runs:
        if files.exists(STAGED, run, READY):
            _swap(files, run)
        else:
            files.delete(STAGED, run)
    return len(runs)


def replace(spark: SparkSession, folder: str, name: str, fresh: DataFrame, drop: Column, values: Iterable[Sequence[str]], start: int, end: int) -> Replaced:
    """Replace the table's rows that meet `drop` by the fresh ones, within the partitions of `values` (for the columns before the month) and the months of [start, end).

    Only these partitions are read, and only they are swapped: others keep their files. `fresh` may come from the table itself, as nothing is moved before
    all is written. A fresh row of another partition is an error, and then nothing changes. One writer at a time. Rows are counted as they are written.
    """
    recover(spark, folder, name)
    by, files = [*LAYOUT[name][1], "month"], Files(spark, f"{folder}/{name}")
    wanted = [files.place(by, [*v, m]) for v, m in product(values, months(start, end))]
    places = set(wanted)
    here = read(spark, folder, name, start, end)
    for column, held in zip(by[:-1], zip(*values, strict=True), strict=True):
        here = here.where(F.col(column).isin(sorted(set(held))))
    kept = here.where(~F.coalesce(drop, F.lit(False)))
    counts, run = Observation(), uuid.uuid4().hex
    both = kept.withColumn("__new", F.lit(False)).unionByName(shaped(fresh, name).withColumn("__new", F.lit(True)))
    both = both.observe(counts, F.count_if(~F.col("__new")).alias("kept"), F.count_if("__new").alias("written")).drop("__new")
    rows = with_month(both, name)
    rows.hint("rebalance", *by).write.partitionBy(*by).parquet(f"{folder}/{name}/{STAGED}/{run}/new")
    staged = files.leaves(len(by), STAGED, run, "new")
    if strange := sorted(set(staged) - places):
        files.delete(STAGED, run)
        raise ValueError(f"rows of {strange[0]} are outside the scope of the replacement of {name}")
    touched = [p for p in dict.fromkeys(wanted) if p in set(staged) or files.exists(p)]
    files.put(json.dumps({"places": touched, "staged": staged}), STAGED, run, READY)
    _swap(files, run)
    spark.catalog.refreshByPath(f"{folder}/{name}")
    # without rows the plan has nothing to observe
    counted = counts.get if staged else {"kept": 0, "written": 0}
    return Replaced(counted["kept"], counted["written"], len(touched))

