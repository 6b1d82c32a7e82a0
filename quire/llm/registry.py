"""Queries of this subpackage and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import fingerprint, langid, mixing, neighbours, pii, repeats, sentencepiece_codec, shards, simhash, warc
from quire.llm.common import cut, table

PIECES = "piece_bpe_32k.model"


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.with_next(table(spark, sf_dir, "documents"))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.identify(docs, langid.fit(docs, ~langid.held_out()))
    return found.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shards.by_bytes(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.digests(table(spark, sf_dir, "documents"), public_tokenizers.path(PIECES))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove(table(spark, sf_dir, "documents"))


def op6_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = cut(warc.write(table(spark, sf_dir, "pages")))  # written to the shared folder, then read back
    return warc.read(archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "error")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.classes(table(spark, sf_dir, "documents"), words=4, radius=4, bits=64)
    return found.select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")


#: Shares of the tokens wanted of each domain.
TARGETS = {"good": 0.9, "poor": 0.08, "toxic": 0.02}


def domains(labels: DataFrame) -> DataFrame:
    """doc_id, domain of the labels table."""
    toxic, quality = F.col("toxic"), F.col("quality")
    return labels.select("doc_id", F.when(toxic == 1, "toxic").when(quality == 1, "good").when(quality == 0, "poor").alias("domain"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, mix = mixing.mix(table(spark, sf_dir, "documents"), domains(table(spark, sf_dir, "labels")), TARGETS)
    p = [F.element_at("p", i + 1).alias(f"p_{d}") for i, d in enumerate(mix.classifier.domains)]
    return found.select("doc_id", "n_tokens", *p, "rate", "copies")


#: The CRC by its table, made from the polynomial, over the bytes of each text; then the line of all bytes cut at sixteenths.
OP3_SQL = """WITH t AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crc),
d AS (SELECT doc_id, coalesce(octet_length(encode(text)), 0) + 1 AS size, hex(encode(coalesce(text, ''))) AS h FROM documents),
k AS (SELECT doc_id, size, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(size - 1), lambda i: CAST(('0x' || substr(h, CAST(2 * i + 1 AS BIGINT), 2)) AS BIGINT))),
lambda c, b: xor(c >> 8, crc[CAST((xor(c, b) & 255) + 1 AS BIGINT)])), 4294967295) AS text_crc32 FROM d, t),
r AS (SELECT *, sum(size) OVER o AS ends, sum(size) OVER () AS total FROM k WINDOW o AS (ORDER BY doc_id NULLS FIRST, text_crc32, size ROWS UNBOUNDED PRECEDING)),
s AS (SELECT *, least(15, (2 * ends - size) * 16 // (2 * total))::INT AS shard FROM r)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY ends) - 1 AS slot, CAST(NULL AS INT) AS grown_shard FROM s"""

OP8_SQL = """WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages), d AS (SELECT page_id, octet_length(b) AS n, sha1(b) AS digest FROM p),
h AS (SELECT digest, max(page_id) AS head FROM d WHERE n >= 1000 GROUP BY 1)
SELECT d.page_id, n AS payload_bytes, d.digest AS payload_digest, CASE WHEN n >= 1000 AND page_id <> head THEN 'revisit' ELSE 'response' END AS record_type,
CASE WHEN n >= 1000 AND page_id <> head THEN head END AS refers_to, CAST(NULL AS VARCHAR) AS error FROM d LEFT JOIN h ON d.digest = h.digest"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_fingerprints, op2_language, op3_sharding, op4_sentencepiece, op5_suffix_dedup, op6_neighbours, op7_pii, op8_warc, op9_simhash, op10_mixing)}


def oracle_sql() -> dict[str, str]:
    """The other operators draw hashes, train models or walk what SQL has no words for; tests hold them against brute force."""
    return {"op3_sharding": OP3_SQL, "op8_warc": OP8_SQL}
