"""Sharding by extendible hashing, in DataFrame functions only.

A row's key is hashed to 60 bits; the directory is indexed by the leading bits.  A bucket that holds more bytes
than the limit splits on its next bit, and only such buckets do, so shards have
different depths.  All splits are decided on sums of bytes per hash prefix: a round takes
enough bits for nearly all buckets, and what is still too large goes to another round of more bits.
From the finest prefixes sums go up ``SPAN`` levels at a time, and further only from prefixes that fit, so the work is
in proportion to the finest prefixes, which number a few per shard.  The directory is joined by a shuffle, as it grows
with the data.  Only ids, hashes and sizes are moved, never texts.  The rounds run while the query is built.

Keys are hashed with the whole text, so that rows of one id do not pile up; rows equal in id and text are one
unit.  A unit over the limit cannot be split: it becomes a shard of its own, marked ``oversized``.

Defined cases: null id or text counts as an empty string in the key; empty texts weigh nothing.  An empty table gives
no rows.  Other columns are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gantry.llm.common import written

HASH_BITS = 60
SPARE_BITS = 3
SPAN = 6
LIMIT_BYTES = 1 << 20


def key_hash(doc_id: Column, text: Column) -> Column:
    key = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("long")


def prefix(hashed: Column, of: int, bits: Column | int) -> Column:
    """The leading ``bits`` of a prefix of ``of`` bits."""
    drop = F.lit(of) - bits
    return F.call_function("shiftright", hashed, drop.cast("int"))


def leaves_of(fine: DataFrame, low: int, bits: int, limit: int) -> DataFrame:
    """Of prefixes of ``bits`` bits (``fine, bytes``) the shortest prefix, from ``low`` bits on, within the limit; none where they exceed it."""
    top = max(low, bits - SPAN)
    levels = fine.select("fine", "bytes", F.explode(F.sequence(F.lit(top), F.lit(bits))).alias("depth"))
    levels = levels.withColumn("bucket", prefix(F.col("fine"), bits, F.col("depth")))
    sums = written(levels.groupBy("depth", "bucket").agg(F.sum("bytes").alias("shard_bytes")), "sums")
    fits = levels.drop("bytes").join(sums.filter(F.col("shard_bytes") <= limit).hint("merge"), ["depth", "bucket"])
    leaves = fits.groupBy("fine").agg(F.min(F.struct("depth", "bucket", "shard_bytes")).alias("leaf"))
    coarse = sums.filter(F.col("depth") == top).select(F.col("bucket").alias("fine"), F.col("shard_bytes").alias("bytes"))
    if top == low or coarse.filter(F.col("bytes") <= limit).isEmpty():
        return leaves.select("fine", "leaf.*")
    above = leaves_of(coarse, low, top, limit).select(F.col("fine").alias("coarse"), F.struct("depth", "bucket", "shard_bytes").alias("higher"))
    joined = leaves.withColumn("coarse", prefix(F.col("fine"), bits, top)).join(above.hint("merge"), "coarse", "left")
    return joined.select("fine", F.coalesce("higher", "leaf").alias("leaf")).select("fine", "leaf.*")


def assigned(rows: DataFrame, limit: int) -> DataFrame:
    """``rows`` (with ``h`` and ``bytes``) with ``depth, bucket, shard_bytes, oversized``."""
    total = rows.agg(F.sum("bytes")).first()[0] or 0
    low, bits = 0, min(HASH_BITS, max(1, (total // limit)).bit_length() + SPARE_BITS)
    done = []
    while True:
        rows = rows.withColumn("fine", prefix(F.col("h"), HASH_BITS, bits))
        fine = written(
            rows.groupBy("fine").agg(F.sum("bytes").alias("bytes"), (F.min("h") == F.max("h")).alias("unit")), "prefixes"
        )
        leaves = leaves_of(fine.select("fine", "bytes"), low, bits, limit).withColumn("oversized", F.lit(False))
        units = fine.filter((F.col("bytes") > limit) & F.col("unit")).select(
            "fine", F.lit(bits).alias("depth"), F.col("fine").alias("bucket"), F.col("bytes").alias("shard_bytes"), F.lit(True).alias("oversized")
        )
        done.append(rows.join(leaves.unionByName(units).hint("merge"), "fine"))
        rest = fine.filter((F.col("bytes") > limit) & ~F.col("unit")).select("fine")
        if rest.isEmpty():
            break
        rows = written(rows.join(rest, "fine", "left_semi"), "rest")
        low, bits = bits + 1, min(HASH_BITS, bits + 8)
    return reduce(DataFrame.unionByName, done)


def shards(docs: DataFrame, limit: int = LIMIT_BYTES) -> DataFrame:
    """``doc_id, shard, depth, shard_bytes, oversized`` for every row; ``shard`` is the bucket's bits."""
    rows = docs.select(
        F.col("doc_id").cast("long"),
        key_hash(F.col("doc_id").cast("long"), F.col("text")).alias("h"),
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("bytes"),
    )
    return assigned(written(rows, "shard-keys"), limit).select(
        "doc_id",
        F.when(F.col("depth") == 0, F.lit("")).otherwise(F.expr("lpad(bin(bucket), depth, '0')")).alias("shard"),
        F.col("depth").cast("int").alias("depth"),
        "shard_bytes",
        "oversized",
    )


ORACLE_SQL = f"""
WITH r AS (
  SELECT doc_id, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')), 1, 15))::BIGINT AS h,
         coalesce(strlen(text), 0) AS bytes FROM documents),
l AS (SELECT doc_id, h, bytes, d::INT AS depth, h >> (60 - d::INT) AS bucket FROM r, range(0, 41) t(d)),
s AS (SELECT depth, bucket, sum(bytes)::BIGINT AS shard_bytes FROM l GROUP BY ALL HAVING sum(bytes) <= {LIMIT_BYTES}),
f AS (SELECT doc_id, min(depth) AS depth, arg_min(bucket, depth) AS bucket, arg_min(shard_bytes, depth) AS shard_bytes
      FROM l JOIN s USING (depth, bucket) GROUP BY doc_id)
SELECT doc_id, CASE WHEN depth = 0 THEN '' ELSE right(bin(bucket + (1::BIGINT << 60)), depth) END AS shard,
       depth, shard_bytes, false AS oversized FROM f
"""
