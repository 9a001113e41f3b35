"""Web archives, hard negatives and ranked search: against SQL on the smallest tables and against plain versions on odd rows."""

import collections
import hashlib
import io
import math
import pathlib
import random
import re
import struct
from array import array

import duckdb
import numpy as np
import pandas as pd
import pytest
import zstandard
from pyspark.sql import functions as F

from tidemark.llm import negatives, queries, ranked, warc

SMALLEST = "/root/testdata/sf0.001"
NAMES = ["op11_warc", "op12_negatives", "op13_ranked"]


def table(frame):
    columns = sorted(frame.columns)
    return collections.Counter(tuple(r[c] for c in columns) for r in frame.collect())


@pytest.mark.parametrize("name", NAMES)
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALLEST}/{t}.parquet'")
    frame = queries.QUERIES[name](spark, SMALLEST)
    wanted = con.execute(queries.ORACLE_SQL[name])
    names = [c[0] for c in wanted.description]
    assert sorted(names) == sorted(frame.columns)
    assert table(frame) == collections.Counter(tuple(r[names.index(c)] for c in sorted(names)) for r in wanted.fetchall())


PAGES = [(1, "http://a/x", "<p>é</p>" * 40), (7, "http://a/7", "same " * 40), (3, None, "same " * 40), (3, None, "same " * 40), (9, "http://b/\r\nWARC-Type: x", "same " * 40)]
PAGES += [(4, "u", "short"), (5, "u", "short"), (6, "u", None), (8, "u", ""), (None, "u", "same " * 40), (None, None, "only without an id " * 9), (None, "v", "only without an id " * 9)]
PAGES += [(20 + k, f"http://c/{k}", f"<html>{k} " + "word and word " * (k % 9 + 30)) for k in range(60)] + [((1 << 60) + k, "big", "big " * 30) for k in (1, 2)]


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(k, u, h, 1, "x", 2) for k, u, h in PAGES]
    return spark.createDataFrame(rows, "page_id long, url string, html string, bytes int, digest string, first int").coalesce(1)


def test_archives_are_read_as_written(spark, pages, tmp_path):
    folder = f"{tmp_path}/archives"
    listed = warc.write_archives(warc.with_types(pages), folder).collect()
    assert sum(r.records for r in listed) == len(PAGES)
    found = warc.read_archives(spark, folder).collect()
    least = {}
    for k, _, h in PAGES:
        if k is not None and len((h or "").encode()) >= 100:
            least[h] = min(k, least.get(h, k))
    wanted = collections.Counter()
    for k, u, h in PAGES:
        payload = (h or "").encode()
        again = h in least and least[h] != k
        url = u and u.replace("\r", "%0D").replace("\n", "%0A")
        wanted[k, url, len(payload), hashlib.sha256(payload).hexdigest(), "revisit" if again else "response", least[h] if again else None, None if again else h or ""] += 1
    assert collections.Counter(map(tuple, found)) == wanted
    assert warc.read_archives(spark, folder, payloads=False).columns == found[0].__fields__[:-1]
    path = pathlib.Path(folder) / listed[0].archive
    assert path.read_bytes()[:4] == struct.pack("<I", 0x184D2A5D)
    path.write_bytes(path.read_bytes()[:-9])
    with pytest.raises(Exception, match="records"):
        warc.read_archives(spark, folder).collect()


def test_an_empty_table_has_no_archives(spark, pages, tmp_path):
    assert warc.write_archives(warc.with_types(pages.limit(0)), f"{tmp_path}/none").count() == 0
    assert warc.read_archives(spark, f"{tmp_path}/none").count() == 0


def records(n, seed=1):
    rng = random.Random(seed)
    for k in range(n):
        html = ("<div class='item'><a href='/x'>" + " ".join(rng.choices(["alpha", "beta", "gamma", "delta"], k=30)) + "</a></div>").encode()
        yield warc.encode_record(k, f"http://a/{k}", html, hashlib.sha256(html).hexdigest(), None, None)


def test_each_record_is_a_frame_behind_the_dictionary(monkeypatch):
    monkeypatch.setattr(warc, "TRAIN_BYTES", 1 << 14)
    out = io.BytesIO()
    assert warc.write_archive(out, "x", records(300))[0] == 300
    raw = out.getvalue()
    magic, size = struct.unpack("<II", raw[:8])
    assert magic == 0x184D2A5D
    known = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(raw[8 : 8 + size]))
    assert known.dict_id() != 0
    rest, frames = raw[8 + size :], []
    while rest:
        one = zstandard.ZstdDecompressor(dict_data=known).decompressobj()
        frames.append(one.decompress(rest))
        rest = one.unused_data
    assert len(frames) == 301 and frames[1:] == list(records(300)) and b"warcinfo" in frames[0]
    plain = zstandard.ZstdCompressor(level=warc.LEVEL)
    assert len(raw) - 8 - size < 0.8 * sum(len(plain.compress(f)) for f in frames)
    with pytest.raises(zstandard.ZstdError):
        zstandard.ZstdDecompressor().decompress(raw[8 + size :])


def test_full_archives_end_and_cut_ones_are_told(monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 4000)
    monkeypatch.setattr(warc, "TRAIN_BYTES", 3000)
    rest, kept = records(200), []
    while True:
        out = io.BytesIO()
        if not warc.write_archive(out, "x", rest)[0]:
            break
        kept.append(out.getvalue())
    assert len(kept) > 3
    found = [int(f["X-Page-Id"]) for raw in kept for f, _ in warc.read_archive(io.BytesIO(raw))]
    assert found == list(range(200))
    assert len(list(warc.read_archive(io.BytesIO(kept[0][:-9])))) == len(list(warc.read_archive(io.BytesIO(kept[0])))) - 1


def vectors(n, seed, d=16):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(4, d))
    return [(int(k), [float(x) for x in (base[k % 4] + 0.7 * rng.normal(size=d)).astype("float32")], int(rng.integers(0, 3))) for k in range(n)]


def plain_negatives(rows, step=10, positives=3, count=4):
    """rows: (id, label, whole vector); an id is in a list once, at its best score."""
    out = []
    for own in sorted({k for k, _, _ in rows if k % step == 0}):
        label, v = min((y, tuple(w)) for k, y, w in rows if k == own)
        best = [{}, {}]
        for k, y, w in rows:
            if k != own or y != label:
                score = sum(a * b for a, b in zip(v, w, strict=True))
                best[y != label][k] = max(score, best[y != label].get(k, score))
        order = [sorted(b.items(), key=lambda x: (-x[1], x[0])) for b in best]
        for p, ps in order[0][:positives]:
            fits = [(k, s) for k, s in order[1] if 30 * ps <= 100 * s <= 90 * ps][:count]
            out += [(own, p, rank + 1, k, ps, s) for rank, (k, s) in enumerate(fits)]
    return collections.Counter(out)


def test_negatives_of_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(negatives, "ANCHOR_BLOCK", 5)
    monkeypatch.setattr(negatives, "ROW_BLOCK", 5)
    rows = vectors(150, 3)
    good = rows + rows[20:24] + [(20, rows[5][1], 1), (500, rows[3][1], 0), (501, rows[3][1], 0), (510, [0.0] * 16, 1)] + [(600 + k, rows[8][1], 2) for k in range(40)]
    odd = [(None, rows[0][1], 1), (700, None, 1), (710, rows[0][1], None), (720, [math.nan] + [0.0] * 15, 1), (730, [math.inf] * 16, 1), (740, [None] + [0.5] * 15, 1), (750, [], 1), (760, [1.0] * 3, 1), (770, [3e37] * 16, 1)]
    frame = spark.createDataFrame([(*r, 1, "x", 2) for r in good + odd], "vec_id long, embedding array<float>, label int, v int, score string, id int")
    found = negatives.hard_negatives(negatives.whole_vectors(frame), F.col("vec_id") % 10 == 0, 3, 4)
    wanted = plain_negatives([(k, y, [math.floor(256 * x) for x in v]) for k, v, y in good])
    assert collections.Counter(map(tuple, found.collect())) == wanted and len(wanted) > 40
    none = negatives.whole_vectors(frame.limit(0))
    assert negatives.hard_negatives(none, F.col("vec_id") % 10 == 0).count() == 0


def test_pairs_are_discarded_early_and_none_that_counts(monkeypatch):
    monkeypatch.setattr(negatives, "STRIPE", 64)
    rng = np.random.default_rng(5)
    spread = np.diag(0.7 ** np.arange(32)) @ np.linalg.qr(rng.normal(size=(32, 32)))[0]
    rows, anchors = (np.floor(256 * rng.normal(size=(n, 32)) @ spread).astype(np.int64) for n in (900, 20))
    turn = np.linalg.eigh((rows.T @ rows).astype(float))[1][:, ::-1]
    exact = anchors @ rows.T
    low = np.sort(exact, axis=1)[:, -12].astype(float)
    i, j, score = negatives.surviving(anchors, rows, turn, np.ones(exact.shape, bool), lambda: low, None)
    assert (exact[i, j] == score).all() and len(i) < exact.size / 20
    assert set(zip(*np.nonzero(exact >= low[:, None]))) <= set(zip(i, j, strict=True))
    frame = lambda v, first: pd.DataFrame({"vec_id": np.arange(len(v)) + first, "label": np.arange(len(v)) % 3, "v": list(v)})
    found = negatives.best_same(frame(anchors, 5000), frame(rows, 0), turn, 4)
    for a in range(20):
        of = [k for k in range(900) if k % 3 == a % 3]
        wanted = sorted(((-exact[a, k], k) for k in of))[:4]
        assert [(-s, k) for s, k in found[found.anchor_id == 5000 + a][["score", "id"]].to_numpy()] == wanted


def plain_search(docs, items, k=50):
    form = re.compile(ranked.FORM)
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    terms = lambda t: [w.translate(lower) for w in form.findall(t or "")]
    held = [(d, collections.Counter(terms(t))) for d, t in docs]
    n, total = sum(bool(c) for _, c in held), sum(sum(c.values()) for _, c in held)
    df = collections.Counter(t for _, c in held for t in c)
    asked = collections.defaultdict(set)
    for item, text in items:
        asked[item] |= set(terms(text))
    out = []
    for item, words in asked.items():
        scores = []
        for d, c in held:
            m = 50 + 50 * sum(c.values()) * n // max(1, total)
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 20 * m)) for w in words if c[w])
            if score > 0 and d is not None:
                scores.append((-score, d))
        out += [(item, rank + 1, d, -s) for rank, (s, d) in enumerate(sorted(scores)[:k])]
    return collections.Counter(out)


def texts(n, seed):
    rng = random.Random(seed)
    words = ["w%d" % k for k in range(60)] + ["É", "é", "日本", "ẞ", "x1"]
    weights = [1 / (k + 1) for k in range(len(words))]
    return [" ".join(rng.choices(words, weights, k=rng.randint(1, 50))) for _ in range(n)]


def test_search_of_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(ranked, "VOCABULARY_BYTES", 400)  # many blocks of items
    docs = list(enumerate(texts(300, 2)))
    docs += [(900, None), (901, ""), (902, " -- "), (None, "w1 w2 w3"), (5, docs[5][1]), (5, "w50"), (7, docs[6][1]), (903, "W1,w1;É" * 9), (904, "w3 " * 9000)]
    items = list(enumerate(texts(12, 9))) + [(3, "w40 w41"), (20, None), (21, "?!"), (22, "absent"), (None, "w1 日本"), (4, "W1 w1"), (4, "W1 w1")]
    frame = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, n int, term string").repartition(5)
    asked = spark.createDataFrame([(*i, 1) for i in items], "item_id long, text string, score int")
    for k in (50, 3):
        assert collections.Counter(map(tuple, ranked.search(frame, asked, k).collect())) == plain_search(docs, items, k)
    assert ranked.search(frame.limit(0), asked).count() == ranked.search(frame, asked.limit(0)).count() == 0


def test_blocks_below_the_threshold_are_not_decoded():
    rng = random.Random(4)
    n = 6000
    vocabulary = [b"common", b"rare", b"also"]
    found, counts = array("q"), array("q")
    tf = [[rng.randint(1, 3), 0, 0] for _ in range(n)]
    for k in range(100, 140):
        tf[k] = [9, 5, 7]
    for k in range(0, n, 9):
        tf[k][2] += 1
    for row in tf:
        terms = [t for t, c in enumerate(row) for _ in range(c)]
        found.extend(terms)
        counts.append(len(terms))
    ids, sizes = array("q", sorted(rng.sample(range(10 * n), n))), array("q", [sum(r) for r in tf])
    total = n, sum(sizes)
    frame = ranked._shard("s", vocabulary, ids, sizes, found, counts, total).to_pandas()
    shard = ranked.Shard(frame)
    m = 50 + 50 * shard.lengths * total[0] // total[1]
    query = [("common", 3), ("rare", 5000), ("also", 900), ("absent", 7)]
    at, score = ranked.search_shard(shard, m, query, 20)
    weights = np.array([3, 5000, 900])
    scores = []
    for d, row in zip(ids, tf, strict=True):
        c = np.array(row)
        scores.append((-int((weights * (10**9 * c // (1000 * c + 20 * (50 + 50 * sum(row) * total[0] // total[1])))).sum()), d))
    assert [(-s, d) for s, d in zip(score, shard.ids[at], strict=True)] == sorted(scores)[:20]
    assert len(shard.decoded) < len(shard.payload) / 2
    assert frame.n[frame.term.notna()].max() == ranked.BLOCK


def test_packed_numbers_come_back():
    for values in ([], [0, 0, 0], [1], [5, 0, 1 << 40], list(range(128))):
        raw = ranked.pack(np.array(values, np.int64)) + b"rest"
        got, used = ranked.unpack(raw, len(values))
        assert list(got) == values and raw[used:] == b"rest"
