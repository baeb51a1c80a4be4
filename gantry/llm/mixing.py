"""Mixing sources to target weights by Pfair scheduling, in DataFrame functions only.

Each source's rows, in the order of a hash of id and text, are cut into blocks of ``block_bytes`` by their running bytes: a row belongs to
the block in which it begins, so the bytes of a source's first k blocks differ from k ``block_bytes`` by less than one row's.
Running bytes are summed in three steps (rows within a bin of hashes, bins within a span, spans), none of which
has more than a bounded number of rows in one place.

Weights are whole numbers q out of their sum Q.  Block k of a source (from 0) is released at slot floor(k Q / q) and
due by slot ceil((k + 1) Q / q); at every slot the released block with the earliest deadline runs.  As
the weights sum to one slot per slot, all deadlines are met, and every source's count of blocks stays
within less than one block of its share at all times.  The schedule repeats every Q slots, so it is
made once for Q slots from the weights alone.  When a source's last block has run, a new ``phase`` begins: the sources that are left
share its slots by their weights, from their next blocks on, in the same way.

Weights are a parameter with a name for each source and one for all others (``OTHER``), so their number is
bounded.  All rows get a slot; only a block in which no row begins (inside a long one, or a source's last) leaves its slot empty.  ``in_mix`` is true in the first phase, where all sources have their target shares.

Defined cases: a null or unlisted source is of the class ``OTHER``.  A null id or text counts as empty in the hash; empty
texts weigh nothing.  Rows equal in id and text are one unit and share a block, which they can exceed like a very long
text.  An empty table gives no rows.  Columns of ``docs`` named like those added are replaced; others pass through.
The sums of bytes are made while the query is built.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gantry.llm.common import fresh, named, written
from gantry.llm.sharding import HASH_BITS, key_hash

OTHER = "*"
BLOCK_BYTES = 64 << 10
MAX_SLOTS = 10_000
MAX_PLACES = 200_000  # slots times classes
BIN_BLOCKS = 16
UNIT_BYTES = 64  # what a row weighs at least where bins are sized
SPAN_BITS = 12
ADDED = ("class", "block", "phase", "slot", "in_mix")


def earliest_deadline_first(weights: dict[str, int]) -> list[tuple[str, int]]:
    """The class and block number of each of the sum-of-weights slots of one period."""
    slots = sum(weights.values())
    given = dict.fromkeys(weights, 0)
    order = []
    for now in range(slots):
        # Block k is released once k * Q <= now * q.
        released = [c for c, q in weights.items() if given[c] < q and given[c] * slots <= now * q]
        chosen = min(released, key=lambda c: (-(-(given[c] + 1) * slots // weights[c]), c))
        order.append((chosen, given[chosen]))
        given[chosen] += 1
    return order


@dataclass
class Phase:
    """From slot ``start`` on: the period, the weights in it, and each class's first block."""

    start: int
    order: list[tuple[str, int]]
    weights: dict[str, int]
    first: dict[str, int]


def phases(weights: dict[str, int], blocks: dict[str, int]) -> list[Phase]:
    """One phase after another, each until a class has no block left."""
    found, start, first, left = [], 0, dict.fromkeys(blocks, 0), dict(blocks)
    while left:
        present = {c: weights[c] for c in left}
        order = earliest_deadline_first(present)
        place = {entry: at for at, entry in enumerate(order)}
        found.append(Phase(start, order, present, {c: first[c] for c in left}))
        # Until the slot after the first last block.
        slots = 1 + min((n - 1) // present[c] * len(order) + place[c, (n - 1) % present[c]] for c, n in left.items())
        turns, rest = divmod(slots, len(order))
        for c, q in present.items():
            given = turns * q + sum(x == c for x, _ in order[:rest])
            first[c] += given
            left[c] -= given
        start += slots
        left = {c: n for c, n in left.items() if n}
    return found


def _quoted(name: str) -> str:
    return "'" + name.replace("\\", "\\\\").replace("'", "\\'") + "'"


def class_of(source: Column, weights: dict[str, int]) -> Column:
    names = [c for c in weights if c != OTHER]
    return F.when(source.isin(names), source).otherwise(F.lit(OTHER)) if names else F.lit(OTHER)


def _begins(units: DataFrame, bits: Column) -> DataFrame:
    """``units`` (class, h, bytes) with ``begins``, the bytes of the class before them in the order of h."""
    binned = units.withColumn("bin", F.call_function("shiftright", F.col("h"), (F.lit(HASH_BITS) - bits).cast("int")))
    span = F.call_function("shiftright", F.col("bin"), F.lit(SPAN_BITS)).alias("span")
    bins = binned.groupBy("class", "bin", span).agg(F.sum("bytes").alias("bytes"))
    spans = bins.groupBy("class", "span").agg(F.sum("bytes").alias("bytes"))
    before = lambda order, *keys: F.sum("bytes").over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.select("class", "span", F.coalesce(before("span", "class"), F.lit(0)).alias("span_begins"))
    bins = bins.withColumn("in_span", F.coalesce(before("bin", "class", "span"), F.lit(0)))
    bins = bins.join(spans, ["class", "span"]).select("class", "bin", (F.col("span_begins") + F.col("in_span")).alias("bin_begins"))
    within = binned.withColumn("in_bin", F.coalesce(before("h", "class", "bin"), F.lit(0)))
    return within.join(bins, ["class", "bin"]).select("class", "h", (F.col("bin_begins") + F.col("in_bin")).alias("begins"))


def placed(docs: DataFrame, weights: dict[str, int], block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows and columns of ``docs`` with ``class, block, phase, slot, in_mix`` added."""
    spark = docs.sparkSession
    weights = {OTHER: 1} | weights
    if min(weights.values()) < 1 or sum(weights.values()) > MAX_SLOTS or sum(weights.values()) * len(weights) > MAX_PLACES:
        raise ValueError(f"weights must be whole numbers from 1 on, {MAX_SLOTS} at most in all and {MAX_PLACES} times the classes")
    columns = [c for c in docs.columns if c.lower() not in ADDED]
    key = fresh("h", columns + list(ADDED))
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    keyed = docs.withColumns({"class": class_of(F.col("source"), weights), key: key_hash(F.col("doc_id").cast("long"), F.col("text"))})
    units = keyed.groupBy("class", F.col(key).alias("h")).agg(F.sum(size).alias("bytes"))
    units = written(units, "weighed")
    # One row per class, of which there are no more than weights.
    sizes = units.groupBy("class").agg(F.sum("bytes").alias("bytes"), F.sum(F.greatest("bytes", F.lit(UNIT_BYTES))).alias("weight")).collect()
    blocks = {r["class"]: max(1, -(-r["bytes"] // block_bytes)) for r in sizes}
    bits = F.coalesce(*(F.when(F.col("class") == r["class"], F.lit((r["weight"] // (BIN_BLOCKS * block_bytes)).bit_length())) for r in sizes), F.lit(0))
    last = F.coalesce(*(F.when(F.col("class") == c, F.lit(n - 1)) for c, n in blocks.items()), F.lit(0)).cast("long")
    found = phases(weights, blocks)
    numbered = _begins(units, bits).select("class", "h", F.least(F.expr(f"begins div {block_bytes}"), last).alias("block"))
    # The phases of each class, in turn, and all places of all periods.
    of_class = {c: [(k, p.first[c]) for k, p in enumerate(found) if c in p.first] for c in blocks}
    starts = ", ".join(f"({_quoted(c)}, array({', '.join(f'{f}L' for _, f in own)}))" for c, own in of_class.items()) or "('', array(0L))"
    of_phase = ", ".join(
        f"({_quoted(c)}, {k}, {n}, {at}L, {p.weights[c]}, {p.first[c]}L, {p.start}L, {len(p.order)}L)"
        for k, p in enumerate(found) for at, (c, n) in enumerate(p.order)
    ) or "('', 0, 0, 0L, 1, 0L, 0L, 1L)"
    known = spark.sql(f"SELECT * FROM VALUES {starts} AS t(class, firsts)")
    places = spark.sql(f"SELECT * FROM VALUES {of_phase} AS t(class, phase, nth, at, q, first, start, slots)")
    share = places.groupBy("class", "phase").agg(F.min("q").alias("q"), F.min("first").alias("first"))
    # A class is in all phases up to its last.
    numbered = numbered.join(F.broadcast(known), "class").withColumn("phase", F.size(F.filter("firsts", lambda f: f <= F.col("block"))) - 1)
    numbered = numbered.join(F.broadcast(share), ["class", "phase"]).withColumn("nth", F.expr("cast((block - first) % q AS int)")).drop("q", "first", "firsts")
    slotted = numbered.join(F.broadcast(places), ["class", "phase", "nth"]).select(
        "class", F.col("h").alias(key), "block", "phase", F.expr("start + (block - first) div q * slots + at").alias("slot"), (F.col("phase") == 0).alias("in_mix")
    )
    return keyed.drop(*(c for c in docs.columns if c.lower() in ADDED and c != "class")).join(slotted, ["class", key]).select(*map(named, columns), *ADDED)


def mixed(docs: DataFrame, weights: dict[str, int], block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``doc_id, class, block, phase, slot, in_mix`` for every row of ``docs``."""
    rows = docs.select(F.col("doc_id").cast("long"), "source", "text")
    return placed(rows, weights, block_bytes).drop("source", "text")


def oracle_sql(weights: dict[str, int], block_bytes: int = BLOCK_BYTES) -> str:
    """Slot by slot, for tables in which no source is unlisted and no row is repeated."""
    named_q = ", ".join(f"('{c}', {q})" for c, q in weights.items())
    return f"""
WITH RECURSIVE weights(class, q) AS (VALUES {named_q}),
r AS (SELECT doc_id, source AS class, ('0x' || substr(md5(doc_id::VARCHAR || ':' || text), 1, 15))::BIGINT AS h, strlen(text) AS bytes FROM documents),
b AS (SELECT doc_id, class, bytes, (sum(bytes) OVER (PARTITION BY class ORDER BY h, doc_id ROWS UNBOUNDED PRECEDING) - bytes)::BIGINT AS begins FROM r),
n AS (SELECT class, greatest(1, (sum(bytes) + {block_bytes - 1}) // {block_bytes})::BIGINT AS n FROM r GROUP BY class),
slots AS (
  SELECT -1::BIGINT AS slot, 0::BIGINT AS now, 0 AS phase, NULL::VARCHAR AS class, NULL::BIGINT AS block, 0 AS "of",
         list(class ORDER BY class) AS names, list(n ORDER BY class) AS n, list(n ORDER BY class) AS "left", list(0::BIGINT ORDER BY class) AS given, list(q ORDER BY class) AS q
  FROM n JOIN weights USING (class)
  UNION ALL
  SELECT slot + 1, CASE WHEN "left"[c] = 1 THEN 0 ELSE now + 1 END, CASE WHEN "left"[c] = 1 THEN phase + 1 ELSE phase END, names[c], n[c] - "left"[c], phase, names, n,
         list_transform("left", lambda x, i: CASE WHEN i = c THEN x - 1 ELSE x END),
         list_transform(given, lambda x, i: CASE WHEN "left"[c] = 1 THEN 0 WHEN i = c THEN x + 1 ELSE x END), q
  FROM (
    SELECT *, list_min(list_transform(q, lambda x, i: CASE WHEN "left"[i] > 0 AND given[i] * total <= now * x
                                                 THEN ((given[i] + 1) * total + x - 1) // x * 100000 + i END))::BIGINT % 100000 AS c
    FROM (SELECT *, list_sum(list_transform(q, lambda x, i: CASE WHEN "left"[i] > 0 THEN x ELSE 0 END))::BIGINT AS total FROM slots) WHERE total > 0))
SELECT doc_id, class, b.block, slots."of"::INT AS phase, slot, slots."of" = 0 AS in_mix
FROM (SELECT doc_id, b.class, least(begins // {block_bytes}, n - 1) AS block FROM b JOIN n USING (class)) b JOIN slots USING (class, block)
"""
