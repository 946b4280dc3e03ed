"""Sharding by rendezvous hashing of record keys over weighted shards.

Each (key, shard) pair hashes to a number u in (0, 1), and a record goes to the shard with the least
-ln(u) / weight: the key and the shards decide, nothing else. A further shard takes records only into
itself, and so many as its weight asks for; a shard that goes gives its records to the others.

Within a shard, rows have gapless slots in the order of a hash of the key, numbered in buckets of that
hash so that neither a shard nor a key is sorted in one task.

Edge cases: a null key is a key of its own. A null text has no bytes: size 1, checksum null. Rows with the
same key share a shard and have a slot each; which of equal rows comes first isn't defined. An empty table
gives an empty result. Further columns of the input are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import ranked_by_hash, table

SHARDS = 16
BUCKET_ROWS = 1_000  #: rows of a shard that are ranked in one task, about


def _score(key: Column, shard: int, weight: float) -> Column:
    """The pair's -ln(u) / weight, with the shard; the least one wins."""
    if not weight > 0:
        raise ValueError("weights must be positive")
    u = (F.conv(F.substring(F.md5(F.concat(key, F.lit(f"/{shard}")).cast("binary")), 1, 13), 16, 10).cast("double") + 0.5) / float(2**52)
    return F.struct((-F.log(u) / F.lit(float(weight))).alias("x"), F.lit(shard).alias("s"))


def rendezvous(key: Column, weights: list[float]) -> Column:
    """The best score of the key, a string: x and s, the shard (an int from 0) that it goes to."""
    return F.array_min(F.array(*[_score(key, s, w) for s, w in enumerate(weights)]))


def shard(docs: DataFrame, weights: list[float] | int = SHARDS, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, for each row."""
    weights = [1.0] * weights if isinstance(weights, int) else list(weights)
    key = F.coalesce(docs[doc].cast("string"), F.lit("null"))
    rows = docs.select(
        docs[doc].alias("doc_id"), (F.coalesce(F.octet_length(docs[text]), F.lit(0)) + 1).cast("long").alias("size"), F.crc32(docs[text]).alias("text_crc32"),
        rendezvous(key, weights).alias("best"), _score(key, len(weights), sum(weights) / len(weights)).alias("further"), F.md5(key.cast("binary")).alias("h"),
    )
    # A further shard takes just the keys that score better with it than with all that there are.
    rows = rows.withColumn("shard", F.col("best.s")).withColumn("grown_shard", F.least("best", "further")["s"]).drop("best", "further")
    out = ranked_by_hash(rows, "shard", "h", "text_crc32", BUCKET_ROWS * len(weights), docs.count())
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", F.col("place").alias("slot"), "grown_shard")


def op5_rendezvous_shards(spark, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"))


def _least(shards: int) -> str:
    u = "((CAST('0x' || substr(md5(doc_id || '/' || {s}), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0)"
    return "list_min([" + ", ".join("{'x': -ln(" + u.replace("{s}", str(s)) + "), 's': " + str(s) + "}" for s in range(shards)) + "]).s"


ORACLE = f"""
WITH RECURSIVE bits AS (
  SELECT i, CAST(i AS BIGINT) AS c, 0 AS step FROM range(256) t(i)
  UNION ALL SELECT i, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, step + 1 FROM bits WHERE step < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE step = 8),
sums AS (
  SELECT doc_id, text, xor(4294967295, list_reduce(
           list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda b: CAST('0x' || b AS BIGINT))),
           lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1]))) AS crc
  FROM documents, crc),
placed AS (
  SELECT doc_id, CAST(coalesce(octet_length(encode(text)), 0) + 1 AS BIGINT) AS size, CAST(crc AS BIGINT) AS text_crc32, 'key' AS law,
         CAST({_least(SHARDS)} AS INT) AS shard, CAST({_least(SHARDS + 1)} AS INT) AS grown_shard
  FROM sums)
SELECT *, CAST(row_number() OVER (PARTITION BY shard ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) - 1 AS BIGINT) AS slot FROM placed
"""
