"""Web archives: one WARC record for each page, compressed record by record with a dictionary that stands in a leading skippable frame of the archive."""

from __future__ import annotations

import hashlib
import io
import struct
import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow.fs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .session import stored

#: Payloads below so many bytes are never revisited; an archive's dictionary is built from its first records, up to so many bytes; an archive ends once it has so many.
LEAST_PAYLOAD, TRAIN_BYTES, ARCHIVE_BYTES = 100, 4 << 20, 1 << 29
#: A digest that more than one of so many rows have is frequent.
FREQUENT = 1000
DICTIONARY_BYTES, SAMPLE_BYTES, LEVEL = 112_640, 1 << 17, 3
#: The magic number of the frame with the dictionary, and the profile of records that only name a payload.
DICTIONARY_MAGIC = 0x184D2A5D
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def with_types(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, html, bytes, digest, refers_to, refers_url): what each page's record says; refers_to is null for a response.

    Of equal payloads of LEAST_PAYLOAD bytes or more the least page_id's is the response, and the others revisit it; rows that repeat this id are responses
    too, and so are all rows if none has an id. A null html is an empty payload. Only the digests that more than one row has are joined back.
    """
    rows = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html"))
    rows = rows.withColumn("bytes", F.octet_length("html").cast("long")).withColumn("digest", F.sha2(F.col("html").cast("binary"), 256))
    large = stored(rows.where(F.col("bytes") >= LEAST_PAYLOAD).select("page_id", "url", "digest"))
    first = large.groupBy("digest").agg(F.count("*").alias("n"), F.min("page_id").alias("first"), F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url"))).alias("f")).where("n > 1")
    table = stored(first.select(F.col("digest").alias("__key"), "n", "first", F.col("f.url").alias("first_url")))
    # fewer than FREQUENT digests are in more than that part of the rows; rows that need no other partner get keys that nothing has
    often = F.col("n") * FREQUENT > large.count()
    hot = F.broadcast(table.where(often).select("__key", F.col("first").alias("hot"), F.col("first_url").alias("hot_url")))
    rows = rows.withColumn("__key", F.when(F.col("bytes") >= LEAST_PAYLOAD, F.col("digest"))).join(hot, "__key", "left")
    alone = (F.col("bytes") < LEAST_PAYLOAD) | F.col("hot").isNotNull()
    rows = rows.withColumn("__key", F.when(alone, F.concat(F.lit("-"), F.monotonically_increasing_id())).otherwise(F.col("digest")))
    joined = rows.join(table.where(~often).drop("n"), "__key", "left")
    joined = joined.withColumns({"first": F.coalesce("hot", "first"), "first_url": F.when(F.col("hot").isNotNull(), F.col("hot_url")).otherwise(F.col("first_url"))})
    again = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("page_id"))
    return joined.select("page_id", "url", "html", "bytes", "digest", F.when(again, F.col("first")).alias("refers_to"), F.when(again, F.col("first_url")).alias("refers_url"))


def record_id(page_id: int | None, digest: str) -> str:
    """The same for a page and payload whenever they are written."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}:{digest}')}>"


def _escaped(url: str) -> str:
    """No line of a header can be broken by a url; nothing else of it changes."""
    return "".join(f"%{ord(c):02X}" if c < " " or c == "\x7f" else c for c in url)


def encode_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, refers_url: str | None) -> bytes:
    """A response with the payload behind HTTP headers, or a revisit with the headers only. Fields X-Page-Id, X-Refers-To-Page and X-Payload-Length are this library's own."""
    again = refers_to is not None
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + (b"" if again else payload)
    fields = [("WARC-Type", "revisit" if again else "response"), ("WARC-Record-ID", record_id(page_id, digest)), ("WARC-Date", DATE)]
    fields += [("WARC-Target-URI", _escaped(url))] if url else []
    fields += [("WARC-Payload-Digest", f"sha256:{digest}"), ("X-Payload-Length", str(len(payload)))]
    fields += [("X-Page-Id", str(page_id))] if page_id is not None else []
    if again:
        fields += [("WARC-Profile", SAME_PAYLOAD), ("WARC-Refers-To", record_id(refers_to, digest)), ("X-Refers-To-Page", str(refers_to))]
        fields += [("WARC-Refers-To-Target-URI", _escaped(refers_url))] if refers_url else []
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return "WARC/1.1\r\n".encode() + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"


def info_record(name: str) -> bytes:
    block = b"software: tidemark\r\nformat: WARC File Format 1.1\r\n"
    head = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>\r\nWARC-Date: {DATE}\r\nWARC-Filename: {name}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(block)}\r\n\r\n"
    return head.encode() + block + b"\r\n\r\n"


def build_dictionary(records: list[bytes]) -> zstandard.ZstdCompressionDict | None:
    """A dictionary of what the records share; None for records too few or too small to build one from."""
    samples = [r[:SAMPLE_BYTES] for r in records]
    size = min(DICTIONARY_BYTES, sum(map(len, samples)) // 8)
    if len(samples) < 8 or size < 1024:
        return None
    try:
        return zstandard.train_dictionary(size, samples)
    except zstandard.ZstdError:
        return None


def write_archive(out: io.RawIOBase, name: str, records: Iterator[bytes]) -> tuple[int, int]:
    """(records, bytes) written until the archive is full or records end. The first TRAIN_BYTES are held to build the dictionary, the others written as they come.

    An archive without a dictionary has no leading frame, as the form has it.
    """
    held, size = [], 0
    for record in records:
        held.append(record)
        size += len(record)
        if size >= TRAIN_BYTES:
            break
    if not held:
        return 0, 0
    known = build_dictionary(held)
    written = 0

    def put(frame: bytes) -> None:
        nonlocal written
        out.write(frame)
        written += len(frame)

    if known is not None:
        body = zstandard.ZstdCompressor(level=19).compress(known.as_bytes())
        put(struct.pack("<II", DICTIONARY_MAGIC, len(body)) + body)
        known.precompute_compress(level=LEVEL)
    press = zstandard.ZstdCompressor(level=LEVEL, dict_data=known, write_checksum=True, write_content_size=True)
    put(press.compress(info_record(name)))
    for record in held:
        put(press.compress(record))
    count = len(held)
    held.clear()
    while written < ARCHIVE_BYTES and (record := next(records, None)) is not None:
        put(press.compress(record))
        count += 1
    return count, written


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """(archive, records, bytes): the archives of with_types' rows in the folder, and the list of them, stored beside them.

    A task writes archives under names of its own, and they count once Spark has committed the list; what an attempt that failed has left isn't on it.
    The folder is one that all machines share, as a path or a URI of a store that Arrow knows.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def encoded() -> Iterator[bytes]:
            number = lambda x: None if x is None else int(x)
            for frame in frames:
                for r in frame.itertuples(index=False):
                    yield encode_record(number(r.page_id), r.url, r.html.encode(), r.digest, number(r.refers_to), r.refers_url)

        store, place = pyarrow.fs.FileSystem.from_uri(folder)
        records, first = encoded(), None
        while (first := next(records, None)) is not None:
            name = f"{uuid.uuid4().hex}.warc.zst"
            with store.open_output_stream(f"{place}/{name}", compression=None) as out:
                count, size = write_archive(out, name, _chained(first, records))
            yield pd.DataFrame({"archive": [name], "records": [count], "bytes": [size]})

    folder = folder if ":" in folder else f"file://{folder}"
    store, place = pyarrow.fs.FileSystem.from_uri(folder)
    store.create_dir(place)
    # ids as text, as pandas has no column of longs with nulls
    whole = pages.selectExpr("string(page_id)", "url", "html", "digest", "string(refers_to)", "refers_url")
    whole.mapInPandas(run, "archive string, records long, bytes long").write.parquet(f"{folder}/list")
    return pages.sparkSession.read.parquet(f"{folder}/list")


def _chained(first: bytes, rest: Iterator[bytes]) -> Iterator[bytes]:
    yield first
    yield from rest


def read_archive(source: io.RawIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields, block) of every record but the archive's own, in order; a record at a time is held."""
    head = source.read(8)
    known = None
    if len(head) == 8 and struct.unpack("<I", head[:4])[0] == DICTIONARY_MAGIC:
        body = source.read(struct.unpack("<I", head[4:])[0])
        if body[:4] == zstandard.FRAME_HEADER:
            body = zstandard.ZstdDecompressor().decompress(body, max_output_size=1 << 24)
        known, head = zstandard.ZstdCompressionDict(body, dict_type=zstandard.DICT_TYPE_FULLDICT), b""
    plain = zstandard.ZstdDecompressor(dict_data=known).stream_reader(_Joined(head, source), read_across_frames=True)
    stream = io.BufferedReader(plain, 1 << 18)
    while line := stream.readline():
        if line.strip() != b"WARC/1.1":
            raise ValueError(f"a record can't begin with {line[:40]!r}")
        fields = {}
        while (line := stream.readline().rstrip(b"\r\n")) != b"":
            key, _, value = line.decode().partition(": ")
            fields[key] = value
        size = int(fields["Content-Length"])
        block, end = stream.read(size), stream.read(4)
        if len(block) != size or end != b"\r\n\r\n":
            raise ValueError(f"record {fields.get('WARC-Record-ID')} is cut short")
        if fields["WARC-Type"] != "warcinfo":
            yield fields, block


class _Joined(io.RawIOBase):
    """What has been read already and then the rest of a stream."""

    def __init__(self, head: bytes, rest: io.RawIOBase) -> None:
        self.head, self.rest = head, rest

    def readable(self) -> bool:
        return True

    def read(self, size: int = -1) -> bytes:
        got, self.head = self.head, b""
        return got or self.rest.read(size)


def read_archives(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """RECORDS of all archives on the folder's list, with html if payloads are asked for (null for a revisit).

    A response's length and digest are taken from the payload as it was read; one that isn't what its header says is an error,
    and so is an archive without all records on its list. A revisit has its header's length and digest.
    """
    folder = folder if ":" in folder else f"file://{folder}"
    names = [x.split()[0] for x in RECORDS.split(", ")] + ["html"] * payloads

    def rows(name: str) -> Iterator[tuple]:
        store, place = pyarrow.fs.FileSystem.from_uri(folder)
        with store.open_input_stream(f"{place}/{name}", compression=None) as source:
            for fields, block in read_archive(source):
                number = lambda k: int(fields[k]) if k in fields else None  # noqa: B023, E731
                payload = block[block.index(b"\r\n\r\n") + 4 :]
                said = fields["WARC-Payload-Digest"].removeprefix("sha256:"), int(fields["X-Payload-Length"])
                if fields["WARC-Type"] == "response" and said != (hashlib.sha256(payload).hexdigest(), len(payload)):
                    raise ValueError(f"payload of {fields['WARC-Record-ID']} isn't what its header says")
                row = number("X-Page-Id"), fields.get("WARC-Target-URI"), said[1], said[0], fields["WARC-Type"], number("X-Refers-To-Page")
                yield (*row, payload.decode() if fields["WARC-Type"] == "response" else None)[: len(names)]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # each column by itself: a frame made of rows would pass longs with nulls through floats
        kind = {"page_id": "Int64", "payload_bytes": "Int64", "refers_to": "Int64"}
        made = lambda held: pd.DataFrame({n: pd.array(c, dtype=kind.get(n, object)) for n, c in zip(names, map(list, zip(*held, strict=True)), strict=True)})
        for frame in frames:
            for name, wanted in zip(frame.archive, frame.records, strict=True):
                held, size, count = [], 0, 0
                for row in rows(name):
                    held.append(row)
                    count += 1
                    size += row[2] if payloads else 64
                    if len(held) == 4096 or size >= TRAIN_BYTES:
                        yield made(held)
                        held, size = [], 0
                if held:
                    yield made(held)
                if count != wanted:
                    raise ValueError(f"{name} has {count} of {wanted} records")

    listed = spark.read.parquet(f"{folder}/list")
    return listed.select("archive", "records").repartition(max(1, spark.sparkContext.defaultParallelism), "archive").mapInPandas(run, RECORDS + ", html string" * payloads)
