"""Files of a feed and workbooks as Spark data sources: a read opens the files it is asked for, and no others.

`hour_files` and `workbooks` read a folder or a part of it; `register(spark)` makes the formats "hour_files" and "workbook_cells" known to `spark.read` too.
A folder is a path or URI that all machines reach and Arrow knows.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timezone

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import HOUR, SECOND
from . import hour_ticks, workbook_cells

#: Fixed value: where a file stands in the feed; its month counts from 0.
PLACE = re.compile(r"([^/]+)/(\d{4})/(\d{2})/(\d{2})/(\d{2})h_ticks\.bi5$")
TICKS = "instrument string, hour long, ts long, bid double, ask double, bid_volume float, ask_volume float, seq long"
CELLS = "name string, row int, col int, text string"


def place_of(instrument: str, hour: int) -> str:
    """hour_url's place of one hour."""
    t = datetime.fromtimestamp(hour // SECOND, timezone.utc)
    return f"{instrument}/{t.year:04d}/{t.month - 1:02d}/{t.day:02d}/{t.hour:02d}h_ticks.bi5"


def open_folder(folder: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", folder) if ":" in folder else f"file://{folder}")


def content_of(store: pyarrow.fs.FileSystem, path: str) -> bytes | None:
    """A file's bytes, None if there is no such file. Files are taken as they are, whatever their names end with."""
    try:
        with store.open_input_stream(path, compression=None) as source:
            return source.read()
    except FileNotFoundError:
        return None


@dataclass
class Files(InputPartition):
    """What a task opens: (path, instrument or name, hour or 0) of each file."""

    files: list[tuple[str, str, int]]


class _Reader(DataSourceReader):
    """Partitions of at most `files` files, one unless the option says more. Options `names` (a JSON list), `start` and `end` leave files out.

    They are options and not pushed-down filters, as Spark 4.1 keeps what one query has pushed down for later queries of the same frame, which then lack rows.
    """

    def __init__(self, options: dict[str, str]) -> None:
        self.folder, self.each = options["path"], int(options.get("files", 1))
        self.named = set(json.loads(options["names"])) if "names" in options else None
        self.low, self.high = int(options.get("start", -(1 << 63))), int(options.get("end", (1 << 63) - 1))

    def found(self) -> list[tuple[str, str, int]]:
        raise NotImplementedError

    def partitions(self) -> list[Files]:
        files = sorted(self.found())
        return [Files(files[k : k + self.each]) for k in range(0, len(files), self.each)]

    def rows(self, content: bytes, name: str, hour: int) -> Iterator[pa.RecordBatch]:
        raise NotImplementedError

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        if partition is None:
            return
        store, _ = open_folder(self.folder)
        for path, name, hour in partition.files:
            content = content_of(store, path)
            if content is None:
                raise FileNotFoundError(f"{path} was listed and is gone")
            yield from self.rows(content, name, hour)


class HourReader(_Reader):
    def found(self) -> list[tuple[str, str, int]]:
        store, top = open_folder(self.folder)
        # only folders of instruments asked for are listed
        tops = [top] if self.named is None else [f"{top}/{n}" for n in sorted(n for n in self.named if n)]
        out = []
        for folder in tops:
            for info in store.get_file_info(pyarrow.fs.FileSelector(folder, allow_not_found=True, recursive=True)):
                if info.is_file and (m := PLACE.search(info.path)):
                    year, month, day, hour = map(int, m.groups()[1:])
                    at = int(datetime(year, month + 1, day, hour, tzinfo=timezone.utc).timestamp()) * SECOND
                    if at < self.high and at + HOUR > self.low:
                        out.append((info.path, m[1], at))
        return out

    def rows(self, content: bytes, name: str, hour: int) -> Iterator[pa.RecordBatch]:
        frame = hour_ticks(name, hour, content)
        frame.insert(1, "hour", hour)
        kinds = {"string": pa.string(), "long": pa.int64(), "double": pa.float64(), "float": pa.float32()}
        yield pa.RecordBatch.from_pandas(frame, pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in TICKS.split(", ")]), preserve_index=False)


class CellReader(_Reader):
    def found(self) -> list[tuple[str, str, int]]:
        store, top = open_folder(self.folder)
        infos = store.get_file_info(pyarrow.fs.FileSelector(top, recursive=True))
        files = [(i.path, i.base_name, 0) for i in infos if i.is_file and i.base_name.lower().endswith(".xlsx")]
        return [f for f in files if self.named is None or f[1] in self.named]

    def rows(self, content: bytes, name: str, hour: int) -> Iterator[pa.RecordBatch]:
        cells = list(workbook_cells(content))
        columns = [[name] * len(cells), *([c[k] for c in cells] for k in range(3))]
        yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int32(), pa.int32(), pa.string()), strict=True)], [x.split()[0] for x in CELLS.split(", ")])


class HourFiles(DataSource):
    """Ticks of a feed's folder; hour_files reads a part of it."""

    @classmethod
    def name(cls) -> str:
        return "hour_files"

    def schema(self) -> str:
        return TICKS

    def reader(self, schema) -> HourReader:
        return HourReader(self.options)


class WorkbookCells(DataSource):
    """Cells of the workbooks of a folder; workbooks reads some of them."""

    @classmethod
    def name(cls) -> str:
        return "workbook_cells"

    def schema(self) -> str:
        return CELLS

    def reader(self, schema) -> CellReader:
        return CellReader(self.options)


def register(spark: SparkSession) -> None:
    for source in (HourFiles, WorkbookCells):
        spark.dataSource.register(source)


def hour_files(spark: SparkSession, folder: str, instruments: list[str] | None = None, start: int | None = None, end: int | None = None, files: int = 1) -> DataFrame:
    """Ticks of the instruments in [start, end), or of all; only files that can have some are opened, `files` of them in a task."""
    register(spark)
    given = {"names": None if instruments is None else json.dumps(instruments), "start": start, "end": end, "files": files}
    rows = spark.read.format("hour_files").options(**{k: v for k, v in given.items() if v is not None}).load(folder)
    rows = rows if start is None else rows.where(F.col("ts") >= start)
    return rows if end is None else rows.where(F.col("ts") < end)


def workbooks(spark: SparkSession, folder: str, names: list[str] | None = None) -> DataFrame:
    """Cells of a folder's workbooks, or of those named; only these are opened."""
    register(spark)
    reader = spark.read.format("workbook_cells")
    return (reader if names is None else reader.option("names", json.dumps(names))).load(folder)
