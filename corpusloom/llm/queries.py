"""The queries of this subpackage, with production parameters, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.llm.common import documents


def op2_exact_dedup(spark, sf_dir):
    from corpusloom.llm.exact_dedup import duplicate_report

    return duplicate_report(documents(spark, sf_dir))


def op3_secrets(spark, sf_dir):
    from corpusloom.llm.secrets import scan

    return scan(documents(spark, sf_dir))


def op4_bagminhash(spark, sf_dir):
    from corpusloom.llm.near_dedup import near_duplicates

    return near_duplicates(documents(spark, sf_dir))


def op5_kk_sharding(spark, sf_dir):
    from corpusloom.llm.sharding import assign_shards

    return assign_shards(documents(spark, sf_dir), 16).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"),
        "slot", F.lit(None).cast("int").alias("grown_shard"), F.col("digest").alias("group_sha256"), "shard_bytes")


def op6_toxicity(spark, sf_dir):
    from corpusloom.llm.toxicity import score

    return score(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op7_mixing(spark, sf_dir):
    from corpusloom.llm.mixing import schedule

    return schedule(documents(spark, sf_dir), max_repeats=2.0)


def op8_lm(spark, sf_dir):
    import public_tokenizers

    from corpusloom.llm.lm import score

    return score(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op9_packing(spark, sf_dir):
    import public_tokenizers

    from corpusloom.llm.packing import pack

    return pack(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), 2048)


def op1_syncmers(spark, sf_dir):
    from corpusloom.llm.fingerprints import fingerprint_report

    return fingerprint_report(documents(spark, sf_dir))


def op10_warc(spark, sf_dir):
    from corpusloom.llm.warc import round_trip

    return round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet")).drop("archive", "archive_offset")


QUERIES = {
    "op1_syncmers": op1_syncmers,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_secrets": op3_secrets,
    "op4_bagminhash": op4_bagminhash,
    "op5_kk_sharding": op5_kk_sharding,
    "op6_toxicity": op6_toxicity,
    "op7_mixing": op7_mixing,
    "op8_lm": op8_lm,
    "op9_packing": op9_packing,
    "op10_warc": op10_warc,
}

OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS h
  FROM documents),
r AS (
  SELECT doc_id, h,
         first_value(doc_id) OVER w AS keep_id,
         row_number() OVER w AS rn,
         count(*) OVER (PARTITION BY h) AS group_size
  FROM d WINDOW w AS (PARTITION BY h ORDER BY n DESC, doc_id NULLS LAST))
SELECT doc_id, keep_id, group_size, rn = 1 AS kept, h AS text_sha256 FROM r
"""

OP10_SQL = r"""
WITH p AS (
  SELECT page_id, replace(replace(url, chr(13), '%0D'), chr(10), '%0A') AS uri,
         strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest
  FROM pages),
heads AS (
  SELECT payload_digest, max(page_id) AS head FROM p WHERE payload_bytes >= 1000
  GROUP BY 1 HAVING count(*) > 1 AND max(page_id) IS NOT NULL),
r AS (
  SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
         CASE WHEN head IS NOT NULL AND page_id IS DISTINCT FROM head THEN head END AS refers_to,
         coalesce(array_to_string(list_reverse(string_split(lower(
           regexp_extract(uri, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)), '.')), ',') || ')' ||
           regexp_extract(uri, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^#]*)', 1), '') AS url_key,
         strftime(make_timestamp(coalesce(page_id, 0) * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS captured
  FROM p LEFT JOIN heads USING (payload_digest))
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN refers_to IS NULL THEN 'response' ELSE 'revisit' END AS record_type, refers_to, url_key, captured,
       row_number() OVER (ORDER BY url_key, captured, page_id NULLS LAST) - 1 AS capture_rank
FROM r
"""

SQL = {"op2_exact_dedup": OP2_SQL, "op10_warc": OP10_SQL}
