"""Small helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
import gc
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gantry.columns import fresh, named  # noqa: F401  as the operators' other helpers
from gantry.scratch import deleted, run_dir

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# While tables are written: batches for Python of bounded bytes, and shuffle files that go at the end of a job.
BOUNDED = {"spark.sql.execution.arrow.maxBytesPerBatch": "8m", "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
_bounding = threading.Lock()
_inside: dict[str, int] = {}  # by session, how many threads are within ``bounded``
_before: dict[str, dict[str, str]] = {}


@contextmanager
def bounded(spark: SparkSession) -> Iterator[None]:
    """Jobs that run within have the settings ``BOUNDED``; those of before hold again once no thread of the session is within."""
    session = str(spark._jsparkSession.hashCode())
    with _bounding:
        if not _inside.get(session):
            _before[session] = {name: spark.conf.get(name) for name in BOUNDED}
            for name, value in BOUNDED.items():
                spark.conf.set(name, value)
        _inside[session] = _inside.get(session, 0) + 1
    try:
        yield
    finally:
        with _bounding:
            _inside[session] -= 1
            if not _inside[session]:
                for name, value in _before.pop(session).items():
                    spark.conf.set(name, value)


ROW_GROUP_BYTES = 16 << 20  # what a writing task holds in memory

_owner: ContextVar[list[str] | None] = ContextVar("owner", default=None)


@contextmanager
def owned(spark: SparkSession) -> Iterator[None]:
    """Tables that ``written`` makes within are deleted at the end, so what is to last is written outside of it or ``kept``."""
    paths: list[str] = []
    token = _owner.set(paths)
    try:
        yield
    finally:
        _owner.reset(token)
        for path in paths:
            deleted(spark, path)


def written(df: DataFrame, name: str, kept: bool = False) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it again.

    Cuts lineage, survives the loss of executors, and is computed once however often it is read.  The shuffle
    files of the computation go once it is written.  The table goes with its owner (``owned``), if it has one and is not ``kept``, by ``discarded``, or when Python ends.
    """
    spark = df.sparkSession
    path = f"{run_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if not kept and (paths := _owner.get()) is not None:
        paths.append(path)
    with bounded(spark):
        df.write.option("compression", "zstd").option("parquet.block.size", ROW_GROUP_BYTES).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discarded(*tables: DataFrame) -> None:
    """Delete tables that ``written`` made and nothing reads any more."""
    for table in tables:
        for folder in {file.rsplit("/", 1)[0] for file in table.inputFiles()}:
            deleted(table.sparkSession, folder)


def ascii_lower(text: Column) -> Column:
    return F.translate(text, ASCII_UPPER, ASCII_LOWER)


def partitions_for(df: DataFrame, at_least: int = 1) -> int:
    return max(at_least, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


M_MMAP_THRESHOLD, MAPPED_BYTES = -3, 1 << 20


@contextmanager
def memory_returned() -> Iterator[None]:
    """Around a task's Python work: arrays beyond ``MAPPED_BYTES`` go back to the system as they are freed, and the rest at the end, as the worker lives on."""
    try:
        libc = ctypes.CDLL(None)
        libc.mallopt(M_MMAP_THRESHOLD, MAPPED_BYTES)
    except (AttributeError, OSError):  # not this C library
        libc = None
    try:
        yield
    finally:
        gc.collect()
        pa.default_memory_pool().release_unused()
        if libc is not None:
            libc.malloc_trim(0)
