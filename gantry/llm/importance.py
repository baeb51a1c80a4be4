"""Resampling documents by their importance for a target distribution, with features named by CRC-32.

A feature is a run of one to ``max_words`` consecutive words joined by single spaces; its bucket is the CRC-32 of its bytes
modulo ``buckets``.  Runs are never put together: a CRC is linear over GF(2), so that of a joined run is the CRC
of its first part, moved by as many zero bytes as its second part is long, plus (exclusive or) the CRC of its
second part.  The move is a 32 by 32 matrix over GF(2), kept for lengths 1, 2, 4, ... as four tables of 256, and applied
to whole arrays, a bit of the length at a time.

1. ``hashed``: one pass over the texts computes every word's CRC once and composes the runs' from them.  The
   buckets are written to the shared folder; the steps after read only these.
2. ``gains``: the occurrences of each bucket are counted in each task, then summed.  At most ``buckets`` counts reach
   the driver, and as many gains go back to the tasks.
3. A document's weight is the mean gain of its features, its score the weight plus Gumbel noise drawn from its id.
4. ``ranked``: a histogram of scores by hundreds tells which rows can be drawn; only these are dealt by ranges of score and id,
   counted by range, and numbered.  Ids break ties, so equal scores are spread too.

Defined cases: a null text has no words and no features, and weighs 0.  A null ``doc_id`` draws its noise like an empty one and
comes last among ties.  Rows repeated are drawn each; rows with one id draw the same noise.  With an empty target table, gains
follow from counts of 0.  Other columns are not read, so their names cannot clash.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gantry.llm.common import partitions_for, written
from gantry.llm.textbytes import slices, lowered_bytes

POLYNOMIAL = 0xEDB88320
IN_STEP = 48  # longer words go one by one
U32 = np.uint32
WORDLIKE = np.ones(256, bool)  # digits, lower-case letters and all that is not ASCII
WORDLIKE[:0x30] = WORDLIKE[0x3A:0x61] = WORDLIKE[0x7B:0x80] = False


@lru_cache(maxsize=1)
def byte_table() -> np.ndarray:
    table = np.arange(256, dtype=U32)
    for _ in range(8):
        table = np.where(table & 1, (table >> U32(1)) ^ U32(POLYNOMIAL), table >> U32(1))
    return table


def word_crcs(text: np.ndarray, first: np.ndarray, after: np.ndarray) -> np.ndarray:
    """CRC-32 of each span of ``text`` (bytes as uint8), all spans a byte further at each step."""
    table, sizes = byte_table(), after - first
    order = np.argsort(-np.minimum(sizes, IN_STEP + 1), kind="stable")
    begins, longest = first[order], np.minimum(sizes[order], IN_STEP)
    state = np.full(len(first), 0xFFFFFFFF, U32)
    active = np.searchsorted(-longest, -np.arange(1, IN_STEP + 1), "right")  # spans of at least 1, 2, ... bytes
    for k in range(IN_STEP):
        n = int(active[k])
        if not n:
            break
        state[:n] = table[(state[:n] ^ text[begins[:n] + k]) & U32(255)] ^ (state[:n] >> U32(8))
    out = np.empty(len(first), U32)
    out[order] = ~state
    for k in np.flatnonzero(sizes > IN_STEP).tolist():
        out[k] = zlib.crc32(text[first[k] : after[k]])
    return out


def _lookups(columns: np.ndarray) -> np.ndarray:
    """The matrix with these columns as four tables, one for each byte of what it is applied to."""
    bits = (np.arange(256)[:, None] >> np.arange(8)) & 1 == 1
    return np.stack([np.bitwise_xor.reduce(np.where(bits, columns[8 * b : 8 * b + 8], U32(0)), axis=1) for b in range(4)])


def _applied(tables: np.ndarray, crcs: np.ndarray) -> np.ndarray:
    out = tables[0][crcs & U32(255)]
    for b in (1, 2, 3):
        out ^= tables[b][(crcs >> U32(8 * b)) & U32(255)]
    return out


@lru_cache(maxsize=64)
def shift_tables(power: int) -> np.ndarray:
    """Moves a CRC by 2^power zero bytes; each matrix is the square of the one before."""
    units = U32(1) << np.arange(32, dtype=U32)
    if power == 0:
        return _lookups(byte_table()[units & U32(255)] ^ (units >> U32(8)))
    half = shift_tables(power - 1)
    return _lookups(_applied(half, _applied(half, units)))


def shifted(crcs: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRCs moved by as many zero bytes as ``lengths`` say."""
    out = crcs.copy()
    for power in range(int(lengths.max()).bit_length() if len(lengths) else 0):
        here = np.flatnonzero((lengths >> power) & 1)
        out[here] = _applied(shift_tables(power), out[here])
    return out


def run_crcs(crcs: np.ndarray, lengths: np.ndarray, text: np.ndarray, max_words: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For runs of 1, 2, ... words: their CRCs, and the text that each lies in.  ``text`` numbers the words' texts, ascending."""
    spaced = shifted(np.full(len(crcs), zlib.crc32(b" "), U32), lengths) ^ crcs if max_words > 1 else crcs
    runs = crcs
    for n in range(1, max_words + 1):
        if n > 1:
            runs = shifted(runs[:-1], lengths[n - 1 :] + 1) ^ spaced[n - 1 :]
        whole = text[: len(runs)] == text[n - 1 :]
        yield runs[whole], text[: len(runs)][whole]
        if len(runs) < 2:
            return


def _hashed(batches: Iterator[pa.RecordBatch], max_words: int, buckets: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            texts = list(lowered_bytes(part.column("text")))
            # A blank after each text keeps its last word from the next one's first.
            flat = np.concatenate([x for t in texts for x in (t, np.full(1, 32, np.uint8))])
            edge = np.flatnonzero(np.diff(WORDLIKE[flat].view(np.int8), prepend=0, append=0))
            first, after = edge[::2], edge[1::2]
            ends = np.cumsum([len(t) + 1 for t in texts])
            text = np.searchsorted(ends, first, "right")
            found = list(run_crcs(word_crcs(flat, first, after), after - first, text, max_words))
            crcs, owner = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.argsort(owner, kind="stable") if max_words > 1 else slice(None)
            sizes = np.bincount(owner, minlength=len(texts))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)), pa.array((crcs % U32(buckets))[order].astype(np.int32)))
            yield pa.RecordBatch.from_pydict(
                {"doc_id": part.column("doc_id"), "n_words": pa.array(np.bincount(text, minlength=len(texts)), pa.int64()), "features": lists}
            )


def hashed(docs: DataFrame, id_column: str | None = "doc_id", max_words: int = 1, buckets: int = 10_000) -> DataFrame:
    """``doc_id, n_words, features`` (buckets, repeats included) of every text."""
    number = F.col(id_column).cast("long") if id_column else F.lit(None).cast("long")
    rows = docs.select(number.alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(lambda batches: _hashed(batches, max_words, buckets), "doc_id long, n_words long, features array<int>")


def bucket_counts(features: DataFrame, buckets: int) -> DataFrame:
    """``bucket, n``: counted in each task, so at most ``buckets`` rows of it are shuffled."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            total += np.bincount(batch.column("features").flatten().to_numpy(zero_copy_only=False), minlength=buckets)
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(there.astype(np.int32)), "n": pa.array(total[there])})

    return features.select("features").mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame, buckets: int = 10_000) -> np.ndarray:
    """Of each bucket, from ``hashed`` tables: thousandths of the log of how much likelier the target makes it, counted or not.

    ``buckets`` bounds what reaches the driver, where the logarithms are taken.
    """
    counts = np.zeros((2, buckets), np.int64)
    for row, features in zip(counts, (source, target), strict=True):
        for bucket, n in bucket_counts(features, buckets).collect():
            row[bucket] = n
    (all_s, all_t), out = counts.sum(1).tolist(), np.zeros(buckets, np.int64)
    for k, (s, t) in enumerate(counts.T.tolist()):
        out[k] = math.floor(1000 * math.log(float(t + 1) * float(all_s + buckets) / (float(s + 1) * float(all_t + buckets))))
    return out


def weighed(features: DataFrame, gain: np.ndarray) -> DataFrame:
    """``doc_id, n_words, n_features, weight``: the floored mean gain of a document's features, 0 without any."""

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("features")
            sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            sums = np.concatenate(([0], np.cumsum(gain[lists.flatten().to_numpy(zero_copy_only=False)])))
            ends = np.cumsum(sizes)
            weight = np.where(sizes > 0, (sums[ends] - sums[ends - sizes]) // np.maximum(sizes, 1), 0)
            yield pa.RecordBatch.from_pydict(
                {"doc_id": batch.column("doc_id"), "n_words": batch.column("n_words"), "n_features": pa.array(sizes), "weight": pa.array(weight)}
            )

    return features.mapInArrow(weigh, "doc_id long, n_words long, n_features long, weight long")


COARSE = 100


def ranked(scored: DataFrame, eligible: str, percent: int) -> DataFrame:
    """Adds ``rank``: 1, 2, ... for the ``percent`` of the eligible rows with the highest scores, ties to the smaller ``doc_id``; null for the others.

    ``scored`` is read several times, so it is to be a written table.
    """
    spark, coarse = scored.sparkSession, F.floor(F.col("score") / COARSE)
    # Scores are bounded by logarithms of counts, so by hundreds there are some thousands at most.
    histogram = sorted(scored.filter(eligible).groupBy(coarse.alias("c")).count().collect(), reverse=True)
    drawn = sum(n for _, n in histogram) * percent // 100
    passed, least = 0, None
    for c, n in histogram:
        if passed >= drawn:
            break
        passed, least = passed + n, c
    none = F.lit(None).cast("long").alias("rank")
    if least is None:
        return scored.select("*", none)
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("n_features")]
    can = F.coalesce(F.expr(eligible) & (coarse >= least), F.lit(False))
    parts = written(scored.filter(can).repartitionByRange(partitions_for(scored), *order).withColumn("part", F.spark_partition_id()), "ranges")
    before, counts = 0, []
    for part, n in sorted(parts.groupBy("part").count().collect()):  # a row for each partition
        counts.append((part, before))
        before += n
    offsets = F.broadcast(spark.createDataFrame(counts, "part int, before long"))
    place = F.col("before") + F.row_number().over(Window.partitionBy("part").orderBy(*order))
    numbered = parts.join(offsets, "part").withColumn("rank", place.cast("long"))
    chosen = numbered.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank"))).select(*scored.columns, "rank")
    return chosen.unionByName(scored.filter(~can).select("*", none))


def resampled(docs: DataFrame, target: DataFrame, max_words: int = 1, buckets: int = 10_000, min_words: int = 20, percent: int = 10, seed: int = 2024) -> DataFrame:
    """``doc_id, n_features, weight, score, rank`` of every row of ``docs``; ``target`` has a column ``text``.

    Drawn are ``percent`` of the documents with at least ``min_words`` words.  Jobs run while this is built.
    """
    features = written(hashed(docs, "doc_id", max_words, buckets), "features")
    gain = gains(features, hashed(target, None, max_words, buckets), buckets)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256)
    drawn = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    noise = F.floor(-1000 * F.log(-F.log((drawn + 0.5) / 4294967296)))
    scored = written(weighed(features, gain).withColumn("score", F.col("weight") + noise), "scored")
    return ranked(scored, f"n_words >= {min_words}", percent).select("doc_id", "n_features", "weight", "score", "rank")


def oracle_sql(buckets: int = 10_000, min_words: int = 20, percent: int = 10, seed: int = 2024) -> str:
    """For single words; the CRC of each distinct word, byte by byte."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

    def words(name: str, columns: str) -> str:
        return rf"SELECT {columns} unnest(regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM {name}"

    return rf"""
WITH RECURSIVE steps(v, c, k) AS (
  SELECT range::BIGINT, range::BIGINT, 0 FROM range(256)
  UNION ALL
  SELECT v, CASE WHEN c & 1 = 1 THEN xor(c >> 1, {POLYNOMIAL}) ELSE c >> 1 END, k + 1 FROM steps WHERE k < 8),
lookup AS (SELECT list(c ORDER BY v) AS l FROM steps WHERE k = 8),
d AS ({words("documents", "doc_id,")}),
b AS ({words("benchmark", "")}),
vocabulary AS (SELECT DISTINCT w FROM (SELECT w FROM d UNION ALL SELECT w FROM b)),
bytes AS (
  SELECT w, [('0x' || substr(hex(encode(w)), 2 * i - 1, 2))::BIGINT FOR i IN range(1, octet_length(encode(w)) + 1)] AS x FROM vocabulary),
coded AS (
  SELECT w, xor(list_reduce(list_prepend(4294967295::BIGINT, x), lambda c, y: xor(c >> 8, l[(xor(c, y) & 255) + 1])), 4294967295) % {buckets} AS bucket
  FROM bytes, lookup),
s AS (SELECT bucket, count(*) AS n FROM d JOIN coded USING (w) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS n FROM b JOIN coded USING (w) GROUP BY bucket),
g AS (
  SELECT bucket, floor(1000 * ln(((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM s) + {buckets})::DOUBLE)
         / ((s.n + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM t) + {buckets})::DOUBLE)))::BIGINT AS gain
  FROM s LEFT JOIN t USING (bucket)),
w AS (SELECT doc_id, count(*) AS n_features, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight FROM d JOIN coded USING (w) JOIN g USING (bucket) GROUP BY doc_id),
r AS (
  SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('{seed}:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM documents LEFT JOIN w USING (doc_id)),
p AS (
  SELECT *, row_number() OVER (PARTITION BY n_features >= {min_words} ORDER BY score DESC, doc_id) AS place,
         count(*) OVER (PARTITION BY n_features >= {min_words}) AS n
  FROM r)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= {min_words} AND place <= {percent} * n // 100 THEN place END AS rank
FROM p
"""
