"""Recurrences over ordered rows, which no window function expresses.

Rows are dealt by key and sorted, and each task streams through its rows with one small state per key at
a time, so a key's rows are never held together, however many there are.  ``scans`` spreads a key over many tasks.

A target or value that is null, NaN or infinite holds: no step is made, and the state goes on unharmed.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from gantry.columns import fresh
from gantry.functions.scalars import is_gripper

Step = Callable[..., float | None]


def usable(x: float | None) -> bool:
    return x is not None and math.isfinite(x)


def towards(at: float, target: float, limit: float) -> float:
    return at + max(-limit, min(limit, target - at))


@dataclass(frozen=True)
class Ema:
    """Exponential smoothing from 0, so that the first result is ``alpha`` times the first value."""

    alpha: float

    def start(self) -> float:
        return 0.0

    def step(self, at: float, value: float | None) -> tuple[float, float]:
        if usable(value):
            at = self.alpha * value + (1 - self.alpha) * at
        return at, at


@dataclass(frozen=True)
class Slew:
    """Follows its target by at most the row's limit, or ``limit`` where the row has none; starts on the first target."""

    limit: float | None = None

    def start(self) -> float | None:
        return None

    def step(self, at: float | None, target: float | None, limit: float | None = None) -> tuple[float | None, float | None]:
        limit = self.limit if limit is None else limit
        if usable(target):
            at = target if at is None or limit is None else towards(at, target, limit)
        return at, at


@dataclass(frozen=True)
class TimedSlew:
    """Follows its target by at most a speed times the seconds since the last command, ``shortest`` at least.

    A row without a usable target sends no command.  After a gap above ``stale`` the last command has been sent again all along,
    so only ``shortest`` has passed since; a gap above ``timeout`` ends the run, and the last command stays.
    A row without a time counts as sent at the last one's.
    """

    shortest: float
    stale: float | None = None
    timeout: float | None = None

    def start(self) -> tuple[float | None, float | None, bool]:
        return None, None, False

    def limit(self, sent: float | None, time: float | None, speed: float) -> float | None:
        """The most that this row may move; None where its gap ends the run."""
        gap = 0.0 if sent is None or time is None else time - sent
        if self.timeout is not None and gap > self.timeout:
            return None
        return speed * (self.shortest if self.stale is not None and gap > self.stale else max(gap, self.shortest))

    def step(self, state: tuple, target: float | None, time: float | None, speed: float) -> tuple[tuple, float | None]:
        at, sent, halted = state
        if not usable(target) or halted:
            return state, at
        limit = self.limit(sent, time, speed)
        if limit is None:
            return (at, sent, True), at
        at = target if at is None else towards(at, target, limit)
        return (at, sent if time is None else time, False), at


def running(recurrence: Any) -> Callable[[], Step]:
    """The recurrence as functions that keep their own state."""

    def start() -> Step:
        state = recurrence.start()

        def step(*row: float | None) -> float | None:
            nonlocal state
            state, out = recurrence.step(state, *row)
            return out

        return step

    return start


def slew(limit: float) -> Callable[[], Step]:
    return running(Slew(limit))


def slew_by(default: float | None = None) -> Callable[[], Step]:
    """As ``slew``, with each row's own limit."""
    return running(Slew(default))


def smooth(alpha: float) -> Callable[[], Step]:
    return running(Ema(alpha))


def slew_timed(shortest: float, stale: float | None = None, timeout: float | None = None) -> Callable[[], Step]:
    return running(TimedSlew(shortest, stale, timeout))


def fold(df: DataFrame, keys: list[str], order: list[str], inputs: list[str], output: str, start: Callable[[], Step]) -> DataFrame:
    """Adds ``output``: per key, in order, what the function made by ``start`` returns for each row's ``inputs``.

    ``output`` replaces a column of that name.  Nulls in keys are a key of their own.
    """
    kept = df.drop(output)
    schema = StructType([*kept.schema.fields, StructField(output, DoubleType())])
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, step = None, None
        for batch in batches:
            out = []
            columns = [batch.column(c).to_pylist() for c in keys]
            values = [batch.column(c).to_pylist() for c in inputs]
            for key, row in zip(zip(*columns, strict=True), zip(*values, strict=True), strict=True):
                if step is None or key != before:
                    before, step = key, start()
                out.append(step(*row))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.float64())], names=[*batch.schema.names, output])

    dealt = kept.repartition(n, *keys).sortWithinPartitions(*keys, *order)
    return dealt.mapInArrow(run, schema)


def by_channel(value: float, gripper: float | None, channel: str) -> Column:
    return F.lit(float(value)) if gripper is None else F.when(is_gripper(F.col(channel)), float(gripper)).otherwise(float(value))


def slew_limit(
    df: DataFrame, keys: list[str], order: list[str], target: str, limit: float, output: str = "commanded", gripper_limit: float | None = None, channel: str = "channel"
) -> DataFrame:
    """With ``gripper_limit``, which grippers go by, ``channel`` names each row's channel (and belongs to ``keys``)."""
    if gripper_limit is None:
        return fold(df, keys, order, [target], output, slew(limit))
    own = fresh("step_limit", [*df.columns, output])
    return fold(df.withColumn(own, by_channel(limit, gripper_limit, channel)), keys, order, [target, own], output, slew_by()).drop(own)


def slew_limit_timed(
    df: DataFrame, keys: list[str], order: list[str], target: str, time: str, speed: float, shortest: float, output: str = "commanded",
    stale: float | None = None, timeout: float | None = None, gripper_speed: float | None = None, channel: str = "channel",
) -> DataFrame:
    """``speed`` a second; see ``TimedSlew``.  Times are in seconds."""
    own = fresh("step_speed", [*df.columns, output])
    limited = df.withColumn(own, by_channel(speed, gripper_speed, channel))
    return fold(limited, keys, order, [target, time, own], output, slew_timed(shortest, stale, timeout)).drop(own)


def ema(df: DataFrame, keys: list[str], order: list[str], value: str, alpha: float, output: str = "smoothed") -> DataFrame:
    return fold(df, keys, order, [value], output, smooth(alpha))
