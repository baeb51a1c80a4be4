"""Exact deduplication by Grace hashing.

Three steps, all spread by Spark:

1. Map side: each task folds its rows into one row per distinct normalised text (largest
   ``doc_id`` and number of rows), so that a text that makes up a third of all rows reaches
   the shuffle once per task, not once per row.  The fold is emptied whenever it holds
   ``memory_bytes``.
2. The folded rows are partitioned by their digest.  Within a task, texts go into an
   open-addressing table that compares complete contents.  If the table outgrows
   ``memory_bytes``, rows are partitioned by the next digest bits to spill files, and each
   file is treated the same way, recursively, until its table fits.  The spill files belong
   to the task attempt alone and are deleted at its end; a lost executor's tasks start anew.
3. Every row, known by its digest, is joined to its group.  Adaptive execution splits that
   join where one digest has very many rows.

Defined cases: a null text counts as empty.  ``doc_id`` null counts as smaller than any
number.  Rows repeated with the very same ``doc_id`` and text are all marked kept, as the
mark is by ``doc_id``.  Other columns are not read, so their names cannot clash.  Two different
texts with one SHA-256 stop the job with an error (none is known).
"""

from __future__ import annotations

import hashlib
import os
import pickle
import shutil
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, VariantType

from gantry.llm.common import ascii_lower, fresh, memory_returned, named, partitions_for
from gantry.llm.textbytes import slices

MEMORY_BYTES = 96 << 20
FAN_OUT_BITS = 4


class ContentTable:
    """Open addressing with linear probing; slots hold entry numbers, entries hold contents."""

    def __init__(self) -> None:
        self.slots = np.full(1 << 10, -1, np.int64)
        self.digests: list[bytes] = []
        self.texts: list[bytes] = []
        self.largest: list[int | None] = []
        self.counts: list[int] = []
        self.times: list[int] = []  # rows with the largest id
        self.bytes = 0

    def _slot(self, digest: bytes, text: bytes | None) -> int:
        mask = len(self.slots) - 1
        at = int.from_bytes(digest[8:16], "little") & mask
        while (entry := self.slots[at]) >= 0:
            if text is not None and self.digests[entry] == digest:
                if self.texts[entry] != text:
                    raise ValueError("two different texts have one SHA-256")
                break
            at = (at + 1) & mask
        return at

    def add(self, digest: bytes, text: bytes, doc_id: int | None, count: int, times: int) -> None:
        at = self._slot(digest, text)
        entry = self.slots[at]
        if entry >= 0:
            best = self.largest[entry]
            if doc_id == best:
                self.times[entry] += times
            elif best is None or (doc_id is not None and doc_id > best):
                self.largest[entry], self.times[entry] = doc_id, times
            self.counts[entry] += count
            return
        self.slots[at] = len(self.digests)
        self.digests.append(digest)
        self.texts.append(text)
        self.largest.append(doc_id)
        self.counts.append(count)
        self.times.append(times)
        self.bytes += len(text) + 300
        if 2 * len(self.digests) > len(self.slots):
            self.slots = np.full(2 * len(self.slots), -1, np.int64)
            for number, known in enumerate(self.digests):
                self.slots[self._slot(known, None)] = number

    def rows(self) -> Iterator[tuple[bytes, bytes, int | None, int, int]]:
        return zip(self.digests, self.texts, self.largest, self.counts, self.times, strict=True)

    def batch(self, with_text: bool) -> Iterator[pa.RecordBatch]:
        step = 2000
        for k in range(0, len(self.digests), step):
            columns = {"digest": pa.array(self.digests[k : k + step], pa.binary())}
            if with_text:
                columns["content"] = pa.array(self.texts[k : k + step], pa.binary())
            columns["keep_id"] = pa.array(self.largest[k : k + step], pa.int64())
            columns["group_size"] = pa.array(self.counts[k : k + step], pa.int64())
            columns["keep_rows"] = pa.array(self.times[k : k + step], pa.int64())
            yield pa.RecordBatch.from_pydict(columns)


def _normalised(batch: pa.RecordBatch) -> list[bytes]:
    """Texts with A-Z in lower case, as UTF-8; null is empty."""
    return pc.ascii_lower(pc.fill_null(batch.column("text"), "")).cast(pa.binary()).to_pylist()


def _fold(memory_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with memory_returned():
            table = ContentTable()
            for batch in batches:
                for part in slices(batch):
                    for doc_id, text in zip(part.column("doc_id").to_pylist(), _normalised(part), strict=True):
                        table.add(hashlib.sha256(text).digest(), text, doc_id, 1, 1)
                        if table.bytes > memory_bytes:
                            yield from table.batch(with_text=True)
                            table = ContentTable()
            yield from table.batch(with_text=True)
            del table

    return run


def _grace(rows, memory_bytes: int, depth: int, folder: str) -> Iterator[pa.RecordBatch]:
    """Groups of ``rows``; goes through spill files where they don't fit one table."""
    table = ContentTable()
    rows = iter(rows)
    for row in rows:
        table.add(*row)
        if table.bytes > memory_bytes and len(table.digests) > 1:
            break
    else:
        yield from table.batch(with_text=False)
        return
    # Bits after the first four bytes: those the shuffle's own hash has not singled out.
    shift = 32 - FAN_OUT_BITS * (depth + 1)
    if shift < 0:
        raise MemoryError("texts cannot be told apart by further digest bits")
    paths = [os.path.join(folder, f"{depth}-{k}") for k in range(1 << FAN_OUT_BITS)]
    files = [open(path, "wb", buffering=1 << 16) for path in paths]
    try:
        for source in (table.rows(), rows):
            for row in source:
                part = (int.from_bytes(row[0][:4], "big") >> shift) % len(files)
                pickle.dump(row, files[part], protocol=pickle.HIGHEST_PROTOCOL)
    finally:
        for file in files:
            file.close()
    del table
    for k, path in enumerate(paths):
        below = os.path.join(folder, f"{depth}-{k}-below")
        os.mkdir(below)
        yield from _grace(_spilled(path), memory_bytes, depth + 1, below)
        os.unlink(path)
        shutil.rmtree(below)


def _spilled(path: str):
    with open(path, "rb", buffering=1 << 18) as file:
        while True:
            try:
                yield pickle.load(file)
            except EOFError:
                return


def _groups(memory_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folder = tempfile.mkdtemp(prefix="grace-")
        rows = (
            row
            for batch in batches
            for k in range(0, batch.num_rows, 500)
            for row in zip(*(batch.slice(k, 500).column(c).to_pylist() for c in ("digest", "content", "keep_id", "group_size", "keep_rows")), strict=True)
        )
        try:
            with memory_returned():
                yield from _grace(rows, memory_bytes, 0, folder)
        finally:
            shutil.rmtree(folder, ignore_errors=True)

    return run


def digest_of(text: Column) -> Column:
    """SHA-256 of the normalised text."""
    return F.unhex(F.sha2(ascii_lower(F.coalesce(text, F.lit(""))).cast("binary"), 256))


def groups(docs: DataFrame, memory_bytes: int = MEMORY_BYTES) -> DataFrame:
    """One row per distinct text: ``digest``, ``keep_id``, ``group_size``, and ``keep_rows``, how many rows with this text have that id."""
    folded = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        _fold(memory_bytes // 2), "digest binary, content binary, keep_id long, group_size long, keep_rows long"
    )
    return folded.repartition(partitions_for(docs), "digest").mapInArrow(
        _groups(memory_bytes), "digest binary, keep_id long, group_size long, keep_rows long"
    )


def exact_dedup(docs: DataFrame, memory_bytes: int = MEMORY_BYTES) -> DataFrame:
    """A row per row of ``docs``: ``doc_id, keep_id, group_size, kept, text_sha256``."""
    rows = docs.select(F.col("doc_id").cast("long"), digest_of(F.col("text")).alias("digest"))
    return rows.join(groups(docs, memory_bytes), "digest").select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def deduplicated(docs: DataFrame, memory_bytes: int = MEMORY_BYTES) -> DataFrame:
    """The rows of ``docs``, all their columns: of equal texts one row, of those with the largest ``doc_id`` the least one.

    Rows are matched by their text's digest, so ids need not be a key.
    """
    columns = docs.columns
    digest, found = fresh("digest", columns), fresh("found", columns)
    kept = groups(docs, memory_bytes).select(F.col("digest").alias(digest), F.struct("keep_id", "keep_rows").alias(found))
    rows = docs.withColumn(digest, digest_of(F.col("text"))).join(kept, digest)
    rows = rows.filter(F.col("doc_id").cast("long").eqNullSafe(F.col(found)["keep_id"]))
    once = rows.filter(F.col(found)["keep_rows"] == 1).select(*map(named, columns))
    orderable = [named(f.name) for f in docs.schema.fields if not isinstance(f.dataType, (MapType, VariantType))]
    again = rows.filter(F.col(found)["keep_rows"] > 1).groupBy(digest)
    again = again.agg(F.min_by(F.struct(*map(named, columns)), F.struct(*orderable)).alias(found)).select(f"{found}.*")
    return once.unionByName(again)


ORACLE_SQL = """
WITH t AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept, text_sha256
FROM t WINDOW w AS (PARTITION BY text_sha256)
"""
