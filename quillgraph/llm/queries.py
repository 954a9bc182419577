"""The registered queries of this subpackage, and SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm import ann, licenses, line_dedup, media, mixing, quality, sentencepiece_codec, sharding, simhash, token_count
from quillgraph.llm.common import table
from quillgraph.session import written


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every whole document, and whether they decode to its text."""
    found = sentencepiece_codec.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), columns=["doc_id"])
    return found.select("doc_id", "n_tokens", "parity", "round_trip", "ids")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents whose 3-word SimHashes differ in two bits at most."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), words=3, threshold=2)


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in eight shards of near equal bytes."""
    found = sharding.shard(table(spark, sf_dir, "documents"), shards=8)
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed by source, weights 5, 2, 1 in turn."""
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op4_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest of every fiftieth vector among all."""
    vectors = table(spark, sf_dir, "embeddings")
    return ann.search(vectors, vectors.where("vec_id % 50 = 0"), k=5)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all whole documents, learnt from the labels that aren't held out."""
    return quality.classified(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every licence that a whole document states, with its place and how its wording differs."""
    found = licenses.scan_licenses(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "start", "end", "license", F.round("saving", 4).alias("saving"), "differing", "exact", "differences")


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole document stored as lossless WebP, read back and measured."""
    kept = written(media.stored(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_bytes", "media"), "media")
    found = media.measured(kept)
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")


def op8_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every whole document by the vocabulary with word ends."""
    return token_count.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), limit=2048)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the lines that ten documents or more share."""
    found = line_dedup.dedup_lines(table(spark, sf_dir, "documents"), ["doc_id"], min_docs=10)
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


OP9_SQL = """
WITH lines AS (
  SELECT doc_id, row, line, pos, translate(regexp_replace(line, '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, row, unnest(parts) AS line, generate_subscripts(parts, 1) AS pos
        FROM (SELECT doc_id, row_number() OVER () AS row, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents))),
often AS (SELECT key FROM lines WHERE key <> '' GROUP BY key HAVING count(DISTINCT row) >= 10)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(o.key) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE o.key IS NULL), '')) AS kept_sha256
FROM lines l LEFT JOIN often o ON l.key = o.key GROUP BY row
"""

OP10_SQL = """
WITH docs AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || '|' || coalesce(text, '')), 1, 15))::UBIGINT::BIGINT AS spot
  FROM documents),
totals AS (SELECT source, sum(size)::DOUBLE AS total FROM docs GROUP BY source),
weighed AS (
  SELECT *, 3 * total AS cap, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS w
  FROM totals),
levels AS (
  SELECT *, (sum(total) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level,
         row_number() OVER (ORDER BY cap / w, source NULLS LAST) AS nth
  FROM weighed),
goals AS (
  SELECT l.source, total, least(c.level * w, cap) AS target
  FROM levels l, (SELECT arg_min(level, nth) AS level FROM levels WHERE level * w <= cap) c),
plans AS (SELECT *, CASE WHEN total > 0 THEN least(floor(target / total), 3) ELSE 0 END AS whole FROM goals),
placed AS (
  SELECT d.*, p.total, p.target, p.whole, target - whole * total AS rest,
         sum(size) OVER (PARTITION BY d.source ORDER BY spot, nth ROWS UNBOUNDED PRECEDING) AS upto
  FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY spot) AS nth FROM docs) d JOIN plans p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, total::BIGINT AS source_size, target,
       (size * (whole + CASE WHEN rest > 0 AND (upto <= rest OR (upto - size < rest AND upto - rest < rest - (upto - size))) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM placed
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_sentencepiece": op1_sentencepiece, "op2_simhash": op2_simhash, "op3_sharding": op3_sharding, "op4_ann": op4_ann, "op5_quality": op5_quality, "op6_licenses": op6_licenses, "op7_media": op7_media, "op8_token_count": op8_token_count, "op9_line_dedup": op9_line_dedup, "op10_mixing": op10_mixing}


def oracle_sql() -> dict[str, str]:
    return {"op9_line_dedup": OP9_SQL, "op10_mixing": OP10_SQL}
