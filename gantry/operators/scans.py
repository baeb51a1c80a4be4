"""Recurrences whose steps compose, so that a hot key's rows are folded by many tasks at once.

A key with more than its share of rows is cut into bins of its order (``bins``).  Three passes:

1. Each bin is summed up by a few maps from the state before it to the state after it: affine ones for smoothing, monotone
   piecewise-linear ones for slew limits, whose pieces rise by one or not at all.
2. A hot key's maps, a few rows each bin, are applied one after the other; that gives each bin the state it begins with.
3. All rows are folded, each bin from its state.  A key that is not hot is one bin, and takes part in this pass only.

Results are those of ``folds`` up to rounding.  A slew map has at most as many pieces as rows, and as the range of the key's targets over
twice the limit; maps of more than ``KNOTS`` knots are closed and followed by another, so memory is bounded.

Defined cases: as in ``folds``.  Rows that tie in all of ``order`` are taken in any order.  Two jobs run while this is built, over the keys and their order alone.
"""

from __future__ import annotations

import pickle
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from gantry.columns import fresh, named, same_keys
from gantry.operators.bins import binned
from gantry.operators.folds import Ema, Slew, TimedSlew, by_channel, usable

KNOTS = 2048
Op = tuple


class SlewMap:
    """The state after some slew steps as a function of the state before: knots (x, y), with slope 1 outside and 0 or 1 between.

    Without knots nothing changes.
    """

    def __init__(self, x: list[float] = (), y: list[float] = ()) -> None:
        self.x, self.y = list(x), list(y)

    def __call__(self, at: float) -> float:
        x, y = self.x, self.y
        if not x:
            return at
        k = bisect_right(x, at)
        if k == 0:
            return y[0] + (at - x[0])
        if k == len(x):
            return y[-1] + (at - x[-1])
        return y[k - 1] if y[k] == y[k - 1] else y[k - 1] + (at - x[k - 1])

    def then(self, target: float, limit: float) -> None:
        """Followed by one step: what lies within ``limit`` of the target falls on it, the rest moves towards it."""
        x, y, low, high = self.x, self.y, target - limit, target + limit
        if not x:
            self.x, self.y = [low, high], [target, target]
            return
        i, j = bisect_left(y, low), bisect_right(y, high)
        # Where the map takes the values low and high; between knots of different values its slope is 1.
        first = x[0] - (y[0] - low) if i == 0 else x[i - 1] + (low - y[i - 1])
        last = x[j - 1] + (high - y[j - 1]) if j else x[0] - (y[0] - high)
        if i < len(y) and y[i] == low:
            first = x[i]
        self.x = [*x[:i], first, last, *x[j:]]
        self.y = [*(v + limit for v in y[:i]), target, target, *(v - limit for v in y[j:])]


class Summary:
    """Collects a bin's rows into operations on the state."""

    def __init__(self, recurrence: Any) -> None:
        self.recurrence = recurrence
        self.done: list[Op] = []
        self.map: Any = None

    def closed(self) -> Iterator[Op]:
        """The operations so far, and anew."""
        self._close()
        done, self.done = self.done or [("keep",)], []
        yield from done

    def _close(self) -> None:
        pass


class EmaSummary(Summary):
    def _close(self) -> None:
        if self.map is not None:
            self.done.append(("affine", *self.map))
            self.map = None

    def feed(self, value: float | None) -> None:
        if usable(value):
            a, b = self.map or (1.0, 0.0)
            keep = 1 - self.recurrence.alpha
            self.map = a * keep, self.recurrence.alpha * value + keep * b


class SlewSummary(Summary):
    first: float | None = None

    def _close(self) -> None:
        if self.map is not None:
            self.done.append(("slew", self.first, self.map.x, self.map.y))
            self.map = self.first = None

    def move(self, target: float, limit: float | None) -> None:
        if limit is None:
            self.map = self.first = None
            self.done[:] = [op for op in self.done if op[0] != "slew"]
            self.done.append(("set", target))
            return
        if self.map is None:
            self.map, self.first = SlewMap(), target
        self.map.then(target, limit)
        if len(self.map.x) > KNOTS:
            self._close()

    def feed(self, target: float | None, limit: float | None = None) -> None:
        if usable(target):
            self.move(target, self.recurrence.limit if limit is None else limit)


class TimedSummary(SlewSummary):
    """Only a bin's first row with a time depends on when the last command before it was sent."""

    sent: float | None = None
    timed = halted = False

    def feed(self, target: float | None, time: float | None, speed: float) -> None:
        if not usable(target) or self.halted:
            return
        if time is not None and not self.timed:
            self._close()
            self.done.append(("row", target, time, speed))
            self.timed, self.sent = True, time
            return
        limit = self.recurrence.limit(self.sent, time, speed)
        if limit is None:
            self._close()
            self.done += [("sent", self.sent), ("halt",)]
            self.halted = True
            return
        self.move(target, limit)
        self.sent = self.sent if time is None else time

    def closed(self) -> Iterator[Op]:
        self._close()
        if self.timed and not self.halted:
            self.done.append(("sent", self.sent))
        yield from super().closed()


def slewed(at: float | None, op: Op) -> float | None:
    """The state after a closed map; the first target ever is where a state begins."""
    if op[0] == "set":
        return op[1]
    _, first, x, y = op
    return SlewMap(x, y)(first if at is None else at)


def applied(recurrence: Any, state: Any, op: Op) -> Any:
    kind = op[0]
    if kind == "keep":
        return state
    if kind == "affine":
        return op[1] * state + op[2]
    if not isinstance(recurrence, TimedSlew):
        return slewed(state, op)
    at, sent, halted = state
    if halted:
        return state
    if kind == "row":
        return recurrence.step(state, *op[1:])[0]
    if kind == "sent":
        return at, op[1], False
    if kind == "halt":
        return at, sent, True
    return slewed(at, op), sent, False


SUMMARIES = {Ema: EmaSummary, Slew: SlewSummary, TimedSlew: TimedSummary}


def rows_of(batch: pa.RecordBatch, keys: list[str], columns: list[str]) -> Iterator[tuple[tuple, tuple]]:
    of_keys = zip(*(batch.column(c).to_pylist() for c in keys), strict=True)
    return zip(of_keys, zip(*(batch.column(c).to_pylist() for c in columns), strict=True), strict=True)


FLUSH = 1 << 14


def scan(df: DataFrame, keys: list[str], order: list[str], inputs: list[str], output: str, recurrence: Any, bins: int | None = None) -> DataFrame:
    """Adds ``output`` as ``folds.fold`` does.  ``bins`` (four for each shuffle partition) says what share of all rows makes a key hot.

    The first of ``order`` cuts hot keys, so it has to be a number or a time.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kept = df.drop(output)
    columns = kept.columns
    rows, number, hot = binned(kept, keys, order[0], bins or 4 * n, [output])
    state = fresh("state", [*rows.columns, output])
    nth = fresh("nth", [*rows.columns, output, state])
    dealt_by = [*keys, number]
    small = ", ".join(f"`{c}` {kept.schema[c].dataType.simpleString()}" for c in keys) + f"{', ' if keys else ''}`{number}` int, `{nth}` int, `{state}` binary"

    def batch_of(out: list[tuple], like: pa.RecordBatch) -> pa.RecordBatch:
        kinds = [*(like.schema.field(c).type for c in dealt_by), pa.int32(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=[*dealt_by, nth, state])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The operations that each bin comes to."""
        before, summary, batch, out = None, None, None, []

        def close() -> None:
            out.extend((*before, k, pickle.dumps(op)) for k, op in enumerate(summary.closed()))

        for batch in batches:
            for key, row in rows_of(batch, dealt_by, inputs):
                if key != before:
                    if summary is not None:
                        close()
                    before, summary = key, SUMMARIES[type(recurrence)](recurrence)
                summary.feed(*row)
            if len(out) > FLUSH:
                yield batch_of(out, batch)
                out.clear()
        if summary is not None:
            close()
            yield batch_of(out, batch)

    def carried(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The state that each bin begins with."""
        before, now = None, None
        for batch in batches:
            out = []
            for key, (op,) in rows_of(batch, dealt_by, [state]):
                if before is None or key[:-1] != before[:-1]:
                    now = recurrence.start()
                if key != before:
                    out.append((*key, 0, pickle.dumps(now)))
                before, now = key, applied(recurrence, now, pickle.loads(op))
            if out:
                yield batch_of(out, batch)

    def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, now = None, None
        for batch in batches:
            out, begins = [], batch.column(state)
            for (key, row), begin in zip(rows_of(batch, dealt_by, inputs), begins.to_pylist(), strict=True):
                if key != before:
                    before, now = key, recurrence.start()
                if begin is not None:
                    now = pickle.loads(begin)
                    continue
                now, value = recurrence.step(now, *row)
                out.append(value)
            whole = batch.filter(begins.is_null()).select(columns)
            yield pa.RecordBatch.from_arrays([*whole.columns, pa.array(out, pa.float64())], names=[*columns, output])

    by = [*map(named, keys), F.col(number)]
    all_rows = rows.withColumn(state, F.lit(None).cast("binary"))
    if hot is not None:
        lean = rows.select(*map(named, dict.fromkeys([*keys, number, *order, *inputs])))
        of_hot = lean.join(F.broadcast(hot), same_keys(lean, hot, keys), "left_semi") if keys else lean
        sums = of_hot.repartition(n, *by).sortWithinPartitions(*by, *map(named, order)).mapInArrow(summed, small)
        begins = sums.repartition(n, *by[:-1] or [F.lit(0)]).sortWithinPartitions(*by, nth).mapInArrow(carried, small)
        all_rows = all_rows.unionByName(begins.drop(nth), allowMissingColumns=True)
    dealt = all_rows.repartition(n, *by).sortWithinPartitions(*by, F.col(state).isNull(), *map(named, order))
    return dealt.mapInArrow(folded, StructType([*kept.schema.fields, StructField(output, DoubleType())]))


def ema(df: DataFrame, keys: list[str], order: list[str], value: str, alpha: float, output: str = "smoothed", bins: int | None = None) -> DataFrame:
    """As ``folds.ema``, with hot keys spread."""
    return scan(df, keys, order, [value], output, Ema(alpha), bins)


def slew_limit(
    df: DataFrame, keys: list[str], order: list[str], target: str, limit: float, output: str = "commanded", gripper_limit: float | None = None,
    channel: str = "channel", bins: int | None = None,
) -> DataFrame:
    """As ``folds.slew_limit``, with hot keys spread."""
    if gripper_limit is None:
        return scan(df, keys, order, [target], output, Slew(limit), bins)
    own = fresh("step_limit", [*df.columns, output])
    return scan(df.withColumn(own, by_channel(limit, gripper_limit, channel)), keys, order, [target, own], output, Slew(), bins).drop(own)


def slew_limit_timed(
    df: DataFrame, keys: list[str], order: list[str], target: str, time: str, speed: float, shortest: float, output: str = "commanded",
    stale: float | None = None, timeout: float | None = None, gripper_speed: float | None = None, channel: str = "channel", bins: int | None = None,
) -> DataFrame:
    """As ``folds.slew_limit_timed``, with hot keys spread."""
    own = fresh("step_speed", [*df.columns, output])
    limited = df.withColumn(own, by_channel(speed, gripper_speed, channel))
    return scan(limited, keys, order, [target, time, own], output, TimedSlew(shortest, stale, timeout), bins).drop(own)
