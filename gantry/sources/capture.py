"""Capture files of a bus: socket frames of 16 (classic) or 72 bytes (FD), one after another without a separator.

A file is cut into byte ranges, each a task.  Where a frame begins depends on all frames before it, but only through one of nine
places: frames begin at multiples of 8 bytes and none is longer than 72.  So a first pass finds, for each range and each of the nine places its first
frame may begin at, where the first frame of the next range begins; these small tables are composed in order on the driver (a row for
each range), and a second pass decodes every range from its own beginning.  Any cut of the file gives the same frames.

A frame is an FD one if the FD flag is set in its sixth byte, or its length is above 8 (drivers that do not set the flag still mark long frames this way).  A length above 64 is no frame: reading goes on 8 bytes later,
and so finds its way back after damage.  A frame that the end of the file cuts off is left out.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from gantry.sources.dataset import opened
from gantry.sources.robot import CLASSIC_BYTES, FD_BYTES

SLOT = 8
PLACES = FD_BYTES // SLOT  # where in a range its first frame may begin, in slots
FD_FLAG = 0x04
CLASSIC_DATA, FD_DATA = 8, 64
RANGE_BYTES = 16 << 20
FRAMES = "at long, raw binary"
EXITS = "range long, exits array<int>"
BATCH_FRAMES = 1 << 14


def steps(content: np.ndarray) -> np.ndarray:
    """For each slot of 8 bytes how many slots on the next frame begins, were one to begin here."""
    head = content[: len(content) // SLOT * SLOT].reshape(-1, SLOT)
    length = head[:, 4]
    long = (length > CLASSIC_DATA) | ((head[:, 5] & FD_FLAG) != 0)
    return np.where(length > FD_DATA, 1, np.where(long, FD_BYTES // SLOT, CLASSIC_BYTES // SLOT))


def exits(step: np.ndarray) -> list[int]:
    """For each place of a range's first frame, how many slots into the next range that range's first frame begins."""
    slots, after = len(step), step.tolist()
    end = [-1] * slots  # of slots on a path walked before, where it leaves
    found = []
    for place in range(PLACES):
        path, at = [], place
        while at < slots and end[at] < 0:
            path.append(at)
            at += after[at]
        left = at - slots if at >= slots else end[at]
        for k in path:
            end[k] = left
        found.append(left)
    return found


def begins(step: np.ndarray, place: int) -> list[int]:
    """Slots at which frames begin, from the first one's place on; not those of damaged bytes."""
    after, at, out = step.tolist(), place, []
    while at < len(after):
        if after[at] > 1:
            out.append(at)
        at += after[at]
    return out


class Bytes(InputPartition):
    def __init__(self, number: int, first: int, after: int, place: int) -> None:
        self.number, self.first, self.after, self.place = number, first, after, place


class CaptureReader(DataSourceReader):
    def __init__(self, path: str, range_bytes: int, places: list[int] | None) -> None:
        self.path, self.range_bytes, self.places = path, max(FD_BYTES, range_bytes // SLOT * SLOT), places

    def partitions(self) -> list[InputPartition]:
        files, path = opened(self.path)
        info = files.get_file_info(path)
        if info.type != fs.FileType.File:
            raise FileNotFoundError(self.path)
        size = info.size
        firsts = range(0, size, self.range_bytes) if size else [0]
        return [Bytes(k, a, min(a + self.range_bytes, size), self.places[k] if self.places else 0) for k, a in enumerate(firsts)]

    def read(self, partition: Bytes) -> Iterator[pa.RecordBatch]:
        files, path = opened(self.path)
        more = FD_BYTES if self.places else 0  # the last frame's bytes lie in the next range
        with files.open_input_file(path) as file:
            content = file.read_at(partition.after - partition.first + more, partition.first)
        whole = np.frombuffer(content, np.uint8)
        step = steps(whole[: partition.after - partition.first])
        if self.places is None:
            yield pa.RecordBatch.from_pydict({"range": pa.array([partition.number], pa.int64()), "exits": pa.array([exits(step)], pa.list_(pa.int32()))})
            return
        frames = begins(step, partition.place)
        for k in range(0, len(frames), BATCH_FRAMES):
            at, raw = [], []
            for slot in frames[k : k + BATCH_FRAMES]:
                first, after = slot * SLOT, (slot + int(step[slot])) * SLOT
                if after <= len(content):
                    at.append(partition.first + first)
                    raw.append(content[first:after])
            yield pa.RecordBatch.from_pydict({"at": pa.array(at, pa.int64()), "raw": pa.array(raw, pa.binary())})


class Capture(DataSource):
    """``at`` (byte in the file) and ``raw``.  Options: ``path``, ``range_bytes``, ``places`` (of each range's first frame; without them each range's exits are given)."""

    @classmethod
    def name(cls) -> str:
        return "bus_capture"

    def schema(self) -> str:
        return FRAMES if "places" in self.options else EXITS

    def reader(self, schema: StructType) -> DataSourceReader:
        places = self.options.get("places")
        return CaptureReader(self.options["path"], int(self.options.get("range_bytes", RANGE_BYTES)), None if places is None else json.loads(places))


def composed(tables: list[list[int]]) -> list[int]:
    """Of each range the place of its first frame; the file's first one is at its beginning."""
    places, at = [], 0
    for exits_of in tables:
        places.append(at)
        at = exits_of[at]
    return places


def read_capture(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """``at, raw`` of a capture file's frames; ``robot.split_frames`` takes them apart.  One job runs while this is built."""
    spark.dataSource.register(Capture)
    source = spark.read.format("bus_capture").option("path", path).option("range_bytes", range_bytes)
    tables = [r["exits"] for r in sorted(source.load().collect())]
    return source.option("places", json.dumps(composed(tables))).load()
