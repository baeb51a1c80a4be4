"""Steps of ``operators.steps`` along streams: the stall watchdog and the gripper latch while mirroring runs."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from gantry.operators.steps import Latch, RowStep, Stall, output_names, recoveries


class Stepper(StatefulProcessor):
    """Keeps a step's state by key, and hands every row on with the step's outputs."""

    def __init__(self, step: RowStep, columns: list[str], order: list[str], inputs: list[str]) -> None:
        self.step, self.columns, self.order, self.inputs = step, columns, order, inputs

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.now = handle.getValueState("now", self.step.state)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows), ignore_index=True).sort_values(self.order, kind="stable")  # a key's rows of one batch
        state = tuple(self.now.get()) if self.now.exists() else self.step.start()
        out = []
        for row in zip(*(batch[c].tolist() for c in self.inputs), strict=True):
            state, outputs = self.step.step(state, *row)
            out.append(outputs)
        self.now.update(state)
        batch = batch[self.columns].reset_index(drop=True)
        for name, values in zip(output_names(self.step), zip(*out, strict=True), strict=True):
            batch[name] = list(values)
        yield batch

    def close(self) -> None:
        pass


def stepped(stream: DataFrame, keys: list[str], order: list[str], inputs: list[str], step: RowStep) -> DataFrame:
    """The stream's rows with the step's outputs, which replace columns of their names.

    A batch's rows are taken in their order, batches as they come.  Needs the RocksDB state store.
    """
    kept = stream.drop(*output_names(step))
    schema = StructType([*kept.schema.fields, *stream.sparkSession.createDataFrame([], step.outputs).schema.fields])
    return kept.groupBy(*keys).transformWithStateInPandas(
        statefulProcessor=Stepper(step, kept.columns, order, inputs), outputStructType=schema, outputMode="append", timeMode="none"
    )


def watched(stream: DataFrame, keys: list[str], at: str, target: str, actual: str, moved: float = 0.15, still: float = 0.02, hits: int = 3) -> DataFrame:
    """Recovery events of a stream of commands and what was read back, as ``series.stalls`` finds them in a table."""
    return recoveries(stepped(stream, keys, [at], [target, actual], Stall(moved, still, hits)), keys, at)


def latched(stream: DataFrame, keys: list[str], order: list[str], value: str, threshold: float, seed: bool = False) -> DataFrame:
    """``series.hysteresis`` along a stream."""
    return stepped(stream, keys, order, [value], Latch(threshold, seed))
