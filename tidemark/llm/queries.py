"""The registered queries of this subpackage: thin uses of its operators over whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, fingerprints, licenses, media, negatives, packing, quality, ranked, secrets, simhash, substrings, toxicity, warc
from .sampling import held_out
from .session import bound_batches, documents, ensure_checkpoints


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fingerprints.fingerprint_documents(documents(spark, sf_dir))
    return found.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = media.media_features(media.texts_as_media(documents(spark, sf_dir)))
    feature = F.concat_ws("-", "dhash", F.lpad(F.hex(F.crc32("tile")), 8, "0")).alias("feature")
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model, scale = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = quality.score_documents(docs, model, scale)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    written = "array_join(transform({}, s -> concat_ws(':', s.kind, s.start, s.end)), ',')"
    kinds = ", ".join(f"'{k}'" for k in secrets.BASE)
    counts = [F.expr(f"size(filter(spans, s -> s.kind = '{k}'))").cast("long").alias(f"n_{k}") for k in secrets.BASE]
    base = F.sha2(F.expr(written.format(f"filter(spans, s -> s.kind IN ({kinds}))")), 256).alias("base_sha256")
    return secrets.scan_documents(documents(spark, sf_dir)).select("doc_id", *counts, base, F.expr(written.format("spans")).alias("spans"))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_documents(documents(spark, sf_dir))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json")).drop("ids")


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode_documents(documents(spark, sf_dir).select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"), decoded=True)
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op8_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = substrings.remove_repeats(documents(spark, sf_dir).select("doc_id", "text"), words=substrings.PASSAGE)
    return left.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), "n_passage_words")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.near_groups(simhash.fingerprints(documents(spark, sf_dir)))
    return groups.select("doc_id", simhash.fingerprint_hex().alias("fingerprint"), "component_id")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "lang", "text")
    scored = toxicity.score_documents(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"), "is_toxic")


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    ensure_checkpoints(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/archives-{uuid.uuid4().hex}"
    warc.write_archives(warc.with_types(spark.read.parquet(f"{sf_dir}/pages.parquet")), folder)
    return warc.read_archives(spark, folder, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op12_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(negatives.whole_vectors(rows.withColumn("label", moved)), F.col("vec_id") % 100 == 0)


def op13_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_fingerprints": op1_fingerprints,
    "op2_media": op2_media,
    "op3_quality": op3_quality,
    "op4_secrets": op4_secrets,
    "op5_licenses": op5_licenses,
    "op6_packing": op6_packing,
    "op7_bpe": op7_bpe,
    "op8_substrings": op8_substrings,
    "op9_simhash": op9_simhash,
    "op10_toxicity": op10_toxicity,
    "op11_warc": op11_warc,
    "op12_negatives": op12_negatives,
    "op13_ranked": op13_ranked,
}

LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
TERMS = "unnest(regexp_extract_all(" + LOWER + r", '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))"
ORACLE_SQL: dict[str, str] = {
    "op11_warc": """WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS least FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND least <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
CASE WHEN payload_bytes >= 100 AND least <> page_id THEN least END AS refers_to FROM f""",
    "op12_negatives": """WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT a.vec_id AS anchor_id, a.label AS own, r.vec_id, r.label, CAST(list_inner_product([CAST(x AS DOUBLE) FOR x IN a.v], [CAST(x AS DOUBLE) FOR x IN r.v]) AS BIGINT) AS score FROM e a JOIN e r ON a.vec_id % 100 = 0 AND a.vec_id <> r.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS k FROM s WHERE label = own) WHERE k <= 5),
n AS (SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, s.vec_id) AS k
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND s.label <> s.own AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score)
SELECT anchor_id, positive_id, CAST(k AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE k <= 10""",
    "op13_ranked": f"""WITH q AS (SELECT DISTINCT item_id, {TERMS.format('text')} AS term FROM benchmark),
t AS (SELECT doc_id, {TERMS.format("coalesce(text, '')")} AS term FROM documents),
d AS (SELECT doc_id, count(*) AS n FROM t GROUP BY 1), g AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM d),
tf AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY 1, 2), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
w AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w FROM df, g),
s AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * docs) // terms)))) AS BIGINT) AS score FROM q JOIN tf USING (term) JOIN w USING (term) JOIN d USING (doc_id), g GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS k FROM s WHERE score > 0)
SELECT item_id, CAST(k AS INTEGER) AS rank, doc_id, score FROM r WHERE k <= 50""",
}
