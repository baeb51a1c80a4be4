"""Small state machines that take a row at a time, for tables and for streams alike.

A step has the state it starts with, a function from state and inputs to the next state and the outputs, and the types of both.
``over_table`` runs it along the ordered rows of each key, ``streaming.stepped`` along a stream; both call the same function.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any, ClassVar, Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class RowStep(Protocol):
    state: str  # the state's fields, as DDL
    outputs: str

    def start(self) -> tuple: ...

    def step(self, state: tuple, *inputs: Any) -> tuple[tuple, tuple]: ...


def read(x: float | None) -> bool:
    return x is not None and not math.isnan(x)


@dataclass(frozen=True)
class Stall:
    """The target moved by ``moved`` or more but the actual value by less than ``still``: a ``hit``; ``hits`` of them in a row have ``fired``, and are counted anew.

    A row without target or actual value (null or NaN) is a read that failed: it is passed over.
    """

    moved: float = 0.15
    still: float = 0.02
    hits: int = 3
    state: ClassVar[str] = "target DOUBLE, actual DOUBLE, run INT"
    outputs: ClassVar[str] = "hit BOOLEAN, fired BOOLEAN"

    def start(self) -> tuple:
        return None, None, 0

    def step(self, state: tuple, target: float | None, actual: float | None) -> tuple[tuple, tuple]:
        if not read(target) or not read(actual):
            return state, (False, False)
        before, was, run = state
        hit = before is not None and abs(target - before) >= self.moved and abs(actual - was) < self.still
        run = run + 1 if hit else 0
        fired = run >= self.hits
        return (target, actual, 0 if fired else run), (hit, fired)


@dataclass(frozen=True)
class Latch:
    """Strictly above the threshold opens, strictly below its negative closes, else (and on null or NaN) the state holds."""

    threshold: float
    seed: bool = False
    state: ClassVar[str] = "open BOOLEAN"
    outputs: ClassVar[str] = "open BOOLEAN"

    def start(self) -> tuple:
        return (self.seed,)

    def step(self, state: tuple, value: float | None) -> tuple[tuple, tuple]:
        (now,) = state
        if read(value):
            now = True if value > self.threshold else False if value < -self.threshold else now
        return (now,), (now,)


def output_names(step: RowStep) -> list[str]:
    return [field.split()[0] for field in step.outputs.split(", ")]


def over_table(df: DataFrame, keys: list[str], order: list[str], inputs: list[str], step: RowStep) -> DataFrame:
    """Adds the step's outputs, which replace columns of their names; each key's rows stream through one task, in order."""
    kept = df.drop(*output_names(step))
    columns = kept.columns
    empty = df.sparkSession.createDataFrame([], step.outputs)
    schema = StructType([*kept.schema.fields, *empty.schema.fields])
    kinds, names = empty.toArrow().schema.types, [*columns, *empty.columns]
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, state = None, None
        for batch in batches:
            out = []
            of_keys = [batch.column(c).to_pylist() for c in keys]
            of_inputs = [batch.column(c).to_pylist() for c in inputs]
            for key, row in zip(zip(*of_keys, strict=True), zip(*of_inputs, strict=True), strict=True):
                if state is None or key != before:
                    before, state = key, step.start()
                state, outputs = step.step(state, *row)
                out.append(outputs)
            added = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)] if out else [pa.array([], t) for t in kinds]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=names)

    return kept.repartition(n, *keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def recoveries(watched: DataFrame, keys: list[str], at: str) -> DataFrame:
    """What a watchdog asks for: ``event`` (recover) for each key and time at which it has fired."""
    return watched.filter("fired").select(*keys, at, F.lit("recover").alias("event"))
