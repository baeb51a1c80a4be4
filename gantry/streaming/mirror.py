"""Live mirroring as a structured stream: newest packet per robot, change detection, staleness, slew.

State is a few values per key.  Processing-time timers tell stale streams without new packets.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from gantry.functions.packets import feedback, parse_packets
from gantry.functions.scalars import GRIPPER

STALE_MS, TIMEOUT_MS = 150, 1000
OUT = "robot STRING, seq BIGINT, state STRING, commanded STRING"


def packets(stream: DataFrame, value: str = "value") -> DataFrame:
    """Parsed packets; malformed ones are dropped."""
    return parse_packets(stream, value)


@dataclass
class Latest(StatefulProcessor):
    """Of each batch's packets per robot only the newest counts; it is taken if its ``seq`` differs from the last one taken.

    ``strict`` takes only larger numbers.  Commands move by ``speed`` times the seconds since the last command, grippers by
    ``gripper_speed`` if that is given.  While packets are stale the last command is sent again all along, so after a
    gap above ``stale_ms`` only ``shortest`` seconds have passed since.  A gap above ``timeout_ms``, told by a timer or by the next packet, ends
    the robot's run: its packets are dropped from then on.
    """

    speed: float = 1.0
    gripper_speed: float | None = None
    shortest: float = 0.02
    strict: bool = False
    stale_ms: int = STALE_MS
    timeout_ms: int = TIMEOUT_MS

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "seq BIGINT, received DOUBLE, commanded STRING, state STRING")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        newest = None
        for batch in rows:
            top = batch.sort_values(["received", "seq"], kind="stable").iloc[-1]
            if newest is None or (top["received"], top["seq"]) >= (newest["received"], newest["seq"]):
                newest = top
        if newest is None:
            return
        known = self.last.get() if self.last.exists() else None
        seq, received = int(newest["seq"]), float(newest["received"])
        if known is not None and (known[3] == "halt" or (seq <= known[0] if self.strict else seq == known[0])):
            return
        gap = received - known[1] if known else 0.0
        if gap * 1000 > self.timeout_ms:
            yield from self._to("halt", key, known)
            return
        target = json.loads(newest["joints"])
        before = json.loads(known[2]) if known else {}
        passed = self.shortest if gap * 1000 > self.stale_ms else max(gap, self.shortest)
        commanded = {}
        for name, value in target.items():
            limit = passed * (self.gripper_speed if self.gripper_speed is not None and name.endswith(f"{GRIPPER}.pos") else self.speed)
            commanded[name] = value if name not in before else before[name] + max(-limit, min(limit, value - before[name]))
        text = json.dumps(commanded, sort_keys=True)
        self.last.update((seq, received, text, "track"))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        now = timerValues.getCurrentProcessingTimeInMs()
        self.handle.registerTimer(now + self.stale_ms + 1)
        self.handle.registerTimer(now + self.timeout_ms + 1)
        yield pd.DataFrame({"robot": [key[0]], "seq": [seq], "state": ["track"], "commanded": [text]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.last.exists():
            return
        known = self.last.get()
        following = {"track": "hold", "hold": "halt"}.get(known[3])
        if following is not None:
            yield from self._to(following, key, known)

    def _to(self, state: str, key, known) -> Iterator[pd.DataFrame]:
        self.last.update((*known[:3], state))
        yield pd.DataFrame({"robot": [key[0]], "seq": [known[0]], "state": [state], "commanded": [known[2]]})

    def close(self) -> None:
        pass


def mirror(parsed: DataFrame, processor: Latest | None = None) -> DataFrame:
    """Commands and state changes; ``parsed`` has ``robot, seq, joints`` and the time ``received`` in seconds.

    Needs the RocksDB state store (``spark.sql.streaming.stateStore.providerClass``).
    """
    rows = parsed.select("robot", "seq", F.col("received").cast("double"), F.to_json("joints").alias("joints"))
    return rows.groupBy("robot").transformWithStateInPandas(
        statefulProcessor=processor or Latest(), outputStructType=OUT, outputMode="append", timeMode="processingTime"
    )


def throttled(stream: DataFrame, time: str, keys: list[str], value: str, every: str = "500 milliseconds", late: str = "2 seconds", order: list[str] | None = None) -> DataFrame:
    """The last value of each tumbling window; windows begin at whole multiples of their length.  Values of one time go by ``order``.

    A table is throttled like a stream.
    """
    seen = stream.withColumn(time, F.col(time).cast("timestamp"))
    seen = seen.withWatermark(time, late) if stream.isStreaming else seen
    return seen.groupBy(F.window(time, every), *keys).agg(F.max_by(value, F.struct(time, *order or [])).alias(value))


def feedback_sink(stream: DataFrame, send, checkpoint: str):
    """Sends each row as JSON; ``send`` gets a partition's strings and is to swallow its own transport errors."""

    def each(batch: DataFrame, _: int) -> None:
        batch.select(feedback(F.col("t"), F.col("joints")).alias("value")).foreachPartition(lambda rows: send(r["value"] for r in rows))

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
