"""Secrets in texts: literal patterns, and encoded candidates confirmed by the structure of what they decode to.

A run of base64 or hex is reported only if its bytes parse as a private key: nested DER lengths that fill each other exactly in the shape of
one of the private-key encodings, or the length-prefixed fields of an OpenSSH key. A signed token is reported only if its header is JSON
that names an algorithm and its claims are a JSON object; an encrypted one, whose header names the encryption, with all of its five parts. Texts without a keyword or a long run of such characters aren't searched further.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .blocks import Block, blocks, lean
from .session import neutral

#: Spans of one start are listed in this order.
KINDS = ("assign", "access", "hex", "pem", "openssh", "der", "jwt")
BASE = KINDS[:3]
#: The patterns of the base kinds.
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]+")
KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")

ENCODED = re.compile(rb"[A-Za-z0-9+/_-]{40,}={0,2}")
ANY_HEX = re.compile(rb"(?<![0-9A-Za-z])(?:[0-9A-Fa-f]{2}){32,}(?![0-9A-Za-z])")
TOKEN = re.compile(rb"(?<![A-Za-z0-9_-])([A-Za-z0-9_-]{10,})\.([A-Za-z0-9_-]{2,})\.([A-Za-z0-9_-]*)")
#: An encrypted token has five parts, of which all but the header and what is encrypted may be empty.
SEALED = re.compile(rb"(?<![A-Za-z0-9_-])([A-Za-z0-9_-]{10,})\.[A-Za-z0-9_-]*\.[A-Za-z0-9_-]*\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]*")
ARMOUR = re.compile(rb"-----BEGIN ([A-Z0-9 ]{0,30}?)PRIVATE KEY-----(.*?)-----END \1PRIVATE KEY-----", re.S)
IN_RUN = np.zeros(256, bool)
IN_RUN[[*b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"]] = True
IN_TOKEN = IN_RUN.copy()
IN_TOKEN[[*b"+/"]] = False
SHORTEST_RUN = 30


def elements(raw: bytes) -> list[tuple[int, bytes]] | None:
    """(tag, content) of DER elements that fill raw exactly, or None."""
    found, at = [], 0
    while at < len(raw):
        if at + 2 > len(raw):
            return None
        tag, size = raw[at], raw[at + 1]
        at += 2
        if size == 0x80 or size > 0x84:
            return None
        if size > 0x80:
            wide = size - 0x80
            size = int.from_bytes(raw[at : at + wide])
            at += wide
            if size < 0x80 or size >> 8 * (wide - 1) == 0:
                return None
        if at + size > len(raw):
            return None
        found.append((tag, raw[at : at + size]))
        at += size
    return found


def is_private_der(raw: bytes) -> bool:
    """Whether raw is a private key as PKCS #1, PKCS #8 (plain or encrypted) or SEC 1 writes it."""
    top = elements(raw)
    if not top or len(top) != 1 or top[0][0] != 0x30:
        return False
    parts = elements(top[0][1])
    if not parts:
        return False
    tags = [t for t, _ in parts]
    if tags[:9] == [2] * 9 and all(content for _, content in parts):
        return parts[0][1] in (b"\0", b"\1") and len(parts[1][1]) > 16
    if tags[:3] == [2, 0x30, 4] and parts[0][1] in (b"\0", b"\1"):
        named = elements(parts[1][1])
        return bool(named) and named[0][0] == 6 and len(parts[2][1]) >= 16
    if tags[:2] == [2, 4] and parts[0][1] == b"\1" and 16 <= len(parts[1][1]) <= 80:
        return all(t in (0xA0, 0xA1) and elements(content) for t, content in parts[2:])
    if tags == [0x30, 4]:
        named = elements(parts[0][1])
        return bool(named) and len(named) == 2 and named[0][0] == 6 and named[1][0] == 0x30 and len(parts[1][1]) >= 16
    return False


def is_openssh(raw: bytes) -> bool:
    """Whether raw is an OpenSSH private key: names of cipher and key derivation, options, the number of keys, and that many blobs and the secrets."""
    magic = b"openssh-key-v1\0"
    if not raw.startswith(magic):
        return False
    at, fields = len(magic), []

    def field() -> bytes | None:
        nonlocal at
        size = int.from_bytes(raw[at : at + 4])
        if at + 4 + size > len(raw):
            return None
        at += 4 + size
        return raw[at - size : at]

    for _ in range(3):
        fields.append(field())
    if None in fields or not fields[0] or at + 4 > len(raw):
        return False
    keys = int.from_bytes(raw[at : at + 4])
    at += 4
    return 0 < keys < 16 and all(field() for _ in range(keys + 1)) and at == len(raw)


def unpadded(text: bytes) -> bytes | None:
    """What base64 of either alphabet stands for."""
    text = text.rstrip(b"=").replace(b"-", b"+").replace(b"_", b"/")
    try:
        return base64.b64decode(text + b"=" * (-len(text) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def key_kind(raw: bytes | None) -> str | None:
    if not raw:
        return None
    return "der" if is_private_der(raw) else "openssh" if is_openssh(raw) else None


def _json(text: bytes) -> dict:
    try:
        found = json.loads(unpadded(text) or b"null")
    except (ValueError, RecursionError):
        return {}
    return found if isinstance(found, dict) else {}


def spans(text: bytes) -> list[tuple[int, int, str]]:
    """(start, end, kind) in bytes, base kinds and confirmed ones, in order of start, then of KINDS."""
    found = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text) if len(m[0]) >= 32]
    for m in ARMOUR.finditer(text):
        lines = [line for line in re.split(rb"[\r\n]+|\\n", m[2]) if b":" not in line]
        if key_kind(unpadded(b"".join(b"".join(lines).split()))) or b"ENCRYPTED" in m[2] and unpadded(b"".join(b"".join(lines).split())):
            found.append((m.start(), m.end(), "pem"))
    for m in ENCODED.finditer(text):
        if kind := key_kind(unpadded(m[0])):
            found.append((m.start(), m.end(), kind))
    for m in ANY_HEX.finditer(text):
        if kind := key_kind(bytes.fromhex(m[0].decode())):
            found.append((m.start(), m.end(), kind))
    sealed = set()
    for m in SEALED.finditer(text):
        header = _json(m[1])
        if isinstance(header.get("alg"), str) and "enc" in header:
            found.append((m.start(), m.end(), "jwt"))
            sealed.add(m.start())
    for m in TOKEN.finditer(text):
        header = _json(m[1])
        if m.start() not in sealed and isinstance(header.get("alg"), str) and (_json(m[2]) or "enc" in header):
            found.append((m.start(), m.end(), "jwt"))
    return sorted(set(found), key=lambda x: (x[0], KINDS.index(x[2]), x[1]))


def suspects(block: Block) -> np.ndarray:
    """Rows of the block that hold a keyword, a long run of the characters of encoded bytes or the form of a signed token; no other can have a span."""
    data, raw = block.data, block.data.tobytes()
    if not len(data):
        return np.zeros(0, np.int64)
    # runs end where a text ends
    begins = np.zeros(len(data) + 1, bool)
    begins[block.offsets] = True
    inside = IN_RUN[data]
    starts = np.flatnonzero(inside & (begins[:-1] | ~np.append(False, inside[:-1])))
    stops = np.flatnonzero(inside & (begins[1:] | ~np.append(inside[1:], False))) + 1
    places = [starts[stops - starts >= SHORTEST_RUN]]
    low = raw.lower()
    for word, within in [*((k, low) for k in KEYWORDS), (b"AKIA", raw), (b"PRIVATE KEY-----", raw)]:
        at, seen = within.find(word), []
        while at >= 0:
            seen.append(at)
            at = within.find(word, at + 1)
        places.append(np.array(seen, np.int64))
    # a token's header may begin with any JSON white space, so its two dots are looked for, and what must stand before and between them
    dots = np.flatnonzero(data == ord("."))
    strange = np.append(0, np.cumsum(~IN_TOKEN[data]))
    one, two = dots[:-1], dots[1:]
    form = (one >= 10) & (two - one > 2) & (strange[two] == strange[one + 1]) & (strange[one] == strange[np.maximum(one - 10, 0)])
    places.append(one[form])
    # with an empty key two dots touch; what is encrypted stands between two later ones, and the characters of a nonce before it
    if len(dots) > 3:
        one, two, three, four = dots[:-3], dots[1:-2], dots[2:-1], dots[3:]
        form = (one >= 10) & (strange[four] - strange[one + 1] == 2) & (four - three > 1) & (strange[one] == strange[np.maximum(one - 10, 0)])
        places.append(one[form])
    return np.unique(np.searchsorted(block.offsets, np.concatenate(places), "right") - 1)


def all_spans(block: Block) -> dict[int, list[tuple[int, int, str]]]:
    return {i: s for i in suspects(block).tolist() if (s := spans(block.text(i)))}


def scan_documents(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, spans): of every whole text, an array of (kind, start, end) in code points, end exclusive. Null and empty texts have no spans.

    Repeated rows are scanned each for itself; other columns aren't read.
    """
    docs = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(1)):
                rows: list[list] = [[] for _ in range(len(block.offsets) - 1)]
                for i, found in all_spans(block).items():
                    own = block.data[block.offsets[i] : block.offsets[i + 1]]
                    point = np.append(0, np.cumsum((own & 0xC0) != 0x80))
                    rows[i] = [{"kind": k, "start": int(point[a]), "end": int(point[b])} for a, b, k in found]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(block.first, len(rows)), pa.array(rows, kind)], ["doc_id", "spans"])

    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, spans array<struct<kind:string,start:bigint,end:bigint>>")


def redact_documents(docs: DataFrame, text: str = "text", length: str = "n_chars", mask: str = "[secret]") -> DataFrame:
    """The same rows and columns, with every span's characters replaced by the mask; spans that touch or overlap get one mask."""
    names = docs.columns
    docs = neutral(docs, text, length)
    place = docs.columns.index(text)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(place)):
                part = batch.slice(block.first, block.last - block.first)
                hits = all_spans(block)
                if hits:
                    texts = part.column(place).to_pylist()
                    for i, found in hits.items():
                        own, out, at = block.text(i), [], 0
                        end = -1
                        for a, b, _ in found:
                            if a > end:
                                out += [own[at:a], mask.encode()]
                            end = max(end, b)
                            at = end
                        texts[i] = b"".join([*out, own[at:]]).decode()
                    columns = list(part.columns)
                    columns[place] = pa.array(texts, part.column(place).type)
                    part = pa.RecordBatch.from_arrays(columns, part.schema.names)
                yield part

    out = docs.mapInArrow(run, StructType([*docs.schema.fields]))
    out = out.withColumn(length, F.length(text).cast(docs.schema[length].dataType)) if length in names else out
    return out.toDF(*names)

