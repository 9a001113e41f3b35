"""Image columns: Netpbm and BMP bytes decoded to numpy, resized by area, written as NPY tiles with difference hashes."""

from __future__ import annotations

import hashlib
import io
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import blocks, lean

WIDTH, TILE = 64, 32


def encode_pgm(samples: np.ndarray) -> bytes:
    """A binary greymap of 8-bit samples."""
    rows, columns = samples.shape
    return b"P5\n%d %d\n255\n" % (columns, rows) + samples.tobytes()


def _header(raw: bytes, count: int) -> tuple[list[int], int]:
    """The numbers after the magic, past comments, and the place after the white space that ends the last."""
    numbers, at = [], 2
    while len(numbers) < count:
        while raw[at : at + 1].isspace() or raw[at : at + 1] == b"#":
            at = raw.index(b"\n", at) + 1 if raw[at : at + 1] == b"#" else at + 1
        end = at
        while raw[end : end + 1].isdigit():
            end += 1
        if end == at:
            raise ValueError("a number is missing from the header")
        numbers.append(int(raw[at:end]))
        at = end
    return numbers, at + 1


def decode_netpbm(raw: bytes) -> np.ndarray:
    """P1 to P6 as (rows, columns) or (rows, columns, 3); samples of one byte or two. In bitmaps 1 is black: 0."""
    kind = raw[:2]
    if kind not in (b"P1", b"P2", b"P3", b"P4", b"P5", b"P6"):
        raise ValueError("not a Netpbm image")
    bitmap = kind in (b"P1", b"P4")
    numbers, at = _header(raw, 2 if bitmap else 3)
    columns, rows, most = *numbers[:2], 1 if bitmap else numbers[2]
    shape = (rows, columns, 3) if kind in (b"P3", b"P6") else (rows, columns)
    size = int(np.prod(shape))
    if kind == b"P4":
        stride = -(-columns // 8)
        bits = np.unpackbits(np.frombuffer(raw, np.uint8, stride * rows, at).reshape(rows, stride), axis=1)[:, :columns]
        return (1 - bits) * np.uint8(255)
    if kind == b"P1":
        digits = np.frombuffer(raw[at - 1 :], np.uint8)
        digits = digits[(digits == 48) | (digits == 49)][:size]
        return ((49 - digits) * np.uint8(255)).reshape(shape)
    if kind in (b"P2", b"P3"):
        return np.array(raw[at - 1 :].split()[:size], np.int64).astype(np.uint8 if most < 256 else np.uint16).reshape(shape)
    return np.frombuffer(raw, np.uint8 if most < 256 else ">u2", size, at).reshape(shape)


def decode_bmp(raw: bytes) -> np.ndarray:
    """Uncompressed bitmaps of 8 (by palette), 24 or 32 bits as (rows, columns, 3)."""
    if raw[:2] != b"BM":
        raise ValueError("not a BMP image")
    start, size, columns, rows = struct.unpack_from("<IIii", raw, 10)
    depth, packed = struct.unpack_from("<HI", raw, 28)
    if packed or depth not in (8, 24, 32):
        raise ValueError("only uncompressed bitmaps of 8, 24 or 32 bits are read")
    stride = -(-columns * depth // 32) * 4
    lines = np.frombuffer(raw, np.uint8, stride * abs(rows), start).reshape(abs(rows), stride)
    lines = lines[::-1] if rows > 0 else lines
    if depth == 8:
        colours = struct.unpack_from("<I", raw, 46)[0] or 256
        palette = np.zeros((256, 4), np.uint8)
        palette[:colours] = np.frombuffer(raw, np.uint8, 4 * colours, 14 + size).reshape(-1, 4)
        return palette[lines[:, :columns]][:, :, 2::-1]
    return lines[:, : columns * depth // 8].reshape(abs(rows), columns, depth // 8)[:, :, 2::-1]


def decode(raw: bytes) -> np.ndarray:
    return decode_bmp(raw) if raw[:2] == b"BM" else decode_netpbm(raw)


class Integral:
    """Sums over any rectangle of an image, whose edges may lie between pixels."""

    def __init__(self, image: np.ndarray):
        grey = image if image.ndim == 2 else image.mean(axis=2)
        self.sums = np.zeros((grey.shape[0] + 1, grey.shape[1] + 1))
        np.cumsum(np.cumsum(grey, axis=0, dtype=np.float64), axis=1, out=self.sums[1:, 1:])

    def _along(self, sums: np.ndarray, count: int) -> np.ndarray:
        edges = np.arange(count + 1) * ((len(sums) - 1) / count)
        low = np.minimum(edges.astype(np.int64), len(sums) - 2)
        part = (edges - low)[:, None]
        return sums[low] * (1 - part) + sums[low + 1] * part

    def resized(self, rows: int, columns: int) -> np.ndarray:
        """Each pixel is the mean of the area that it covers, rounded."""
        sums = self._along(self._along(self.sums, rows).T, columns).T
        area = (self.sums.shape[0] - 1) * (self.sums.shape[1] - 1) / (rows * columns)
        return (np.diff(np.diff(sums, axis=0), axis=1) / area + 0.5 + 1e-9).astype(np.uint8)


def difference_hash(integral: Integral) -> str:
    """64 bits: whether each pixel of an 8 by 9 thumbnail is brighter than its right neighbour."""
    small = integral.resized(8, 9)
    return np.packbits(small[:, :-1] > small[:, 1:]).tobytes().hex()


def npy(tile: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.lib.format.write_array(out, np.ascontiguousarray(tile), version=(1, 0))
    return out.getvalue()


def texts_as_media(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): every whole text's UTF-8 bytes, padded by zeros to a positive multiple of 64, as a greymap 64 pixels wide.

    Null and empty texts give one row of zeros. Repeated rows stay; other columns aren't read.
    """
    docs = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(1)):
                stored = []
                for i in range(len(block.offsets) - 1):
                    own = block.data[block.offsets[i] : block.offsets[i + 1]]
                    rows = max(1, -(-len(own) // WIDTH))
                    padded = np.zeros(rows * WIDTH, np.uint8)
                    padded[: len(own)] = own
                    stored.append(encode_pgm(padded.reshape(rows, WIDTH)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(block.first, len(stored)), pa.array(np.diff(block.offsets)), pa.array(stored, pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, media binary")


def media_features(media: DataFrame, column: str = "media", tile: int = TILE) -> DataFrame:
    """The other columns of media, and of each image: its size, a digest of its samples, a tile (NPY bytes) and a difference hash.

    What can't be decoded, nulls too, gives nulls. Columns named like added ones are replaced.
    """
    added = {"media_bytes": "long", "media_sha256": "string", "payload_bytes": "long", "payload_sha256": "string", "tail_crc32": "long", "tile": "binary", "dhash": "string"}
    kept = [c for c in media.columns if c != column and c not in added]
    media = media.select(*(F.col(f"`{c}`") for c in [*kept, column]))

    def features(raw: bytes) -> tuple:
        try:
            image = decode(raw)
        except (ValueError, IndexError, struct.error):
            return (len(raw), hashlib.sha256(raw).hexdigest(), None, None, None, None, None)
        samples, sums = image.tobytes(), Integral(image)
        return (len(raw), hashlib.sha256(raw).hexdigest(), len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-64:]), npy(sums.resized(tile, tile)), difference_hash(sums))

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 1024):
                part = batch.slice(low, 1024)
                raws = part.column(len(kept))
                rows = [features(raws[i].as_buffer().to_pybytes()) if raws[i].is_valid else (None,) * 7 for i in range(part.num_rows)]
                cells = [pa.array([r[k] for r in rows], {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[kind]) for k, kind in enumerate(added.values())]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *cells], [*kept, *added])

    kinds = ", ".join([f"`{c}` {media.schema[c].dataType.simpleString()}" for c in kept] + [f"{k} {v}" for k, v in added.items()])
    return media.mapInArrow(run, kinds)
