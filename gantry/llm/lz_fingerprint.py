"""Document fingerprints by Lempel-Ziv phrases and their smallest hashes.

A text's UTF-8 bytes are parsed into phrases, each the shortest run of bytes that is no phrase yet (so all but its
last byte are one).  Texts that compress well given each other share many phrases.  The fingerprint is the
``size`` smallest hashes of the set of phrases, eight hex digits each; the likeness of two fingerprints is the share that lies in
both among the ``size`` smallest of their union, an estimate of the Jaccard similarity of the sets, and exact
where both are smaller.

``edited`` compares each document with a changed copy of it and with the next one, in descending order of ids.  No
single window orders all rows: ids alone are read for cut points, which are ids of the table; texts are then dealt by the
ranges between them, each with a copy of the row that begins the range after it, sorted, and streamed
one pair at a time.

Defined cases: a null text counts as empty; an empty text has no phrases, the empty fingerprint, and is like another empty one
(1.0) and nothing else (0.0).  A null ``doc_id`` comes last.  Rows with one id follow one another by the hash of their
texts and lie in one range, so ids should tell rows apart; repeated rows are compared each.  A table of one row has itself as next.  Other
columns are not read, so their names cannot clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gantry.llm.common import memory_returned, partitions_for
from gantry.llm.textbytes import mixed, slices

SIZE = 128
PRIME = (1 << 61) - 1
FACTOR = 0x1D8AF066F4D2E3A7 % PRIME
DIGITS = 8


class Phrases:
    """A parse that can be fed in parts, and copied to go on in two ways."""

    def __init__(self) -> None:
        self.next: dict[int, int] = {}  # phrase and byte to the longer phrase
        self.hashes: list[int] = [1]  # of the empty phrase and all others
        self.at = 0

    def copy(self) -> Phrases:
        other = Phrases()
        other.next, other.hashes, other.at = self.next.copy(), self.hashes.copy(), self.at
        return other

    def feed(self, content: bytes) -> Phrases:
        longer, hashes, at = self.next, self.hashes, self.at
        find = longer.get
        for byte in content:
            edge = at << 8 | byte
            at = find(edge, 0)
            if not at:
                longer[edge] = len(hashes)
                hashes.append((hashes[edge >> 8] * FACTOR + byte + 1) % PRIME)
        self.at = at
        return self

    def smallest(self, size: int) -> np.ndarray:
        """The smallest hashes of the phrases, ascending."""
        found = mixed(np.array(self.hashes[1:], np.uint64)) >> np.uint64(32)
        if len(found) > 4 * size:
            found = found[found <= np.partition(found, 2 * size)[2 * size]]
        return np.unique(found)[:size]


def shown(signature: np.ndarray) -> str:
    return signature.astype(">u4").tobytes().hex()


def likeness_of(a: np.ndarray, b: np.ndarray, size: int = SIZE) -> float:
    both = np.concatenate((a, b))
    if not len(both):
        return 1.0
    values, counts = np.unique(both, return_counts=True)
    return float(np.count_nonzero(counts[:size] == 2) / min(size, len(values)))


def likeness(a: Column, b: Column, size: int = SIZE) -> Column:
    """The same for columns of fingerprints, by built-in functions."""

    def hashes(fingerprint: Column) -> Column:
        return F.regexp_extract_all(fingerprint, F.lit(f"([0-9a-f]{{{DIGITS}}})"), 1)

    least = F.slice(F.array_sort(F.array_union(hashes(a), hashes(b))), 1, size)
    shared = F.size(F.array_intersect(least, F.array_intersect(hashes(a), hashes(b))))
    return F.when((a == "") & (b == ""), 1.0).otherwise(shared / F.size(least))


def fingerprints(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """``doc_id, fingerprint`` of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                found = [shown(Phrases().feed((text or "").encode()).smallest(size)) for text in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), "fingerprint": pa.array(found, pa.string())})

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fingerprint string")


def _range(ids: Column, begins: list[int], exact: bool) -> Column:
    """The range that an id lies in, or if ``exact`` the one that it begins; without an id the last one, or none."""
    rising, last = np.array(begins[::-1], np.int64), max(0, len(begins) - 1)

    @F.arrow_udf("int")
    def found(x: pa.Array) -> pa.Array:
        known = pc.is_valid(x).to_numpy(zero_copy_only=False)
        values = pc.fill_null(x, 0).to_numpy(zero_copy_only=False)
        if not len(rising):
            return pa.array(np.zeros(len(x), np.int32))
        at = last - np.minimum(np.searchsorted(rising, values, "left"), last)
        missing = ~(known & (rising[last - at] == values)) if exact else None
        return pa.array(np.where(known, at, last).astype(np.int32), mask=missing)

    return found(ids)


def in_ranges(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """Rows ``range, copied, doc_id, text``, those of a range in one partition and in descending order, with the first row of the next one at its end.

    The range after the last is the first.  Cut points are found by a job over the ids alone, while this is built.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    n = ranges or 2 * partitions_for(docs)
    # Quantiles are ids of the table, so each begins a range; the largest begins the first one.
    shares = [k / n for k in range(1, n)]
    top, cuts = rows.agg(F.max("doc_id"), F.percentile_approx("doc_id", shares or [0.5], 20 * n)).first()
    begins = [] if top is None else sorted({top, *(cuts if shares else [])}, reverse=True)
    number, first = (_range(F.col("doc_id"), begins, exact) for exact in (False, True))
    last = max(0, len(begins) - 1)
    before = F.when(first == 0, last).when(first > 0, first - 1)
    own = F.struct(number.alias("range"), F.lit(False).alias("copied"))
    copy = F.struct(before.alias("range"), F.lit(True).alias("copied"))
    dealt = rows.withColumn("place", F.explode(F.when(before.isNull(), F.array(own)).otherwise(F.array(own, copy)))).select("place.range", "place.copied", "doc_id", "text")
    parts = max(1, min(partitions_for(docs), max(1, len(begins))))
    return dealt.repartition(parts, "range").sortWithinPartitions("range", "copied", F.desc_nulls_last("doc_id"), F.xxhash64("text"), "text")


OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compared(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    before, done = None, False  # the row before, and whether it is the copy that ends its range
    out: list[tuple] = []

    def rows() -> Iterator[tuple]:
        for batch in batches:
            for part in slices(batch):
                yield from zip(*(part.column(c).to_pylist() for c in ("range", "copied", "doc_id", "text")), strict=True)

    def flushed() -> pa.RecordBatch:
        names = [c.split()[0] for c in OUT.split(", ")]
        kinds = [{"long": pa.int64(), "string": pa.string(), "double": pa.float64()}[c.split()[1]] for c in OUT.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    for number, copied, doc_id, text in rows():
        new = before is None or before[0] != number
        if copied and done:
            continue
        keep = (len(text) + 1) // 2
        head = text[:keep].encode()
        half = Phrases().feed(head)
        middle = None if copied else half.copy()  # the state in which the edit takes over
        own = half.feed(text[keep:].encode()).smallest(size)
        if not new:
            _, known, its_text, its_own, its_middle = before
            kept = (len(its_text) + 1) // 2
            put = text[: len(its_text) - kept].encode()
            edited = its_middle.feed(put).smallest(size)
            digest = hashlib.sha256(its_text[:kept].encode() + put).hexdigest()
            out.append((known, len(its_text), digest, shown(its_own), shown(edited), likeness_of(its_own, edited, size), likeness_of(its_own, own, size)))
        before, done = (number, doc_id, text, own, middle), copied
        if len(out) == 500:
            yield flushed()
            out.clear()
    if out:
        yield flushed()


def edited(docs: DataFrame, size: int = SIZE, ranges: int | None = None) -> DataFrame:
    """Of every document its fingerprint and that of its edited text, and the likeness of its own to the edited one's and the next document's.

    Edited, the last floor(n_chars / 2) code points of a text are replaced by as many from the start of the next one, or all it has.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with memory_returned():
            yield from _compared(batches, size)

    return in_ranges(docs, ranges).mapInArrow(run, OUT)
