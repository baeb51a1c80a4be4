"""Episode datasets, trajectories and their sinks."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructField, StructType

from gantry.functions.frames import named
from gantry.sources import dataset


def read_episodes(spark: SparkSession, root: str, episodes: list[int] | None = None) -> DataFrame:
    """A dataset written by ``commit_episodes`` or ``commit_stream``; files and row groups without these episodes are not opened."""
    return dataset.read(spark, root, episodes)


def feature_schema(spark: SparkSession, path: str) -> DataFrame:
    """``name, dtype, shape, names`` from a dataset's metadata alone (a JSON object of features)."""
    features = "MAP<STRING, STRUCT<dtype: STRING, shape: ARRAY<INT>, names: ARRAY<STRING>>>"
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json(F.get_json_object("value", "$.features"), features)).alias("name", "f")).select("name", "f.*")


def hub_trajectory(df: DataFrame, features: DataFrame, expected: list[str], gripper: str = "left_gripper") -> DataFrame:
    """``episode_index, step, joints, gripper_cmd``; state names must be exactly the expected ones, and the gripper among the action's."""
    names = {r["name"]: list(r["names"] or []) for r in features.filter(F.col("name").isin("observation.state", "action")).collect()}
    if names.get("observation.state") != expected:
        raise ValueError(f"state names are {names.get('observation.state')}, not {expected}")
    if gripper not in names.get("action", []):
        raise ValueError(f"no {gripper} in the action's names")
    joints = F.slice(F.col("`observation.state`"), 1, 7).cast("array<double>")
    of_action = F.array(*(F.lit(n) for n in names["action"]))
    return df.select("episode_index", F.col("frame_index").alias("step"), joints.alias("joints"), named(F.col("action"), of_action, gripper).cast("double").alias("gripper_cmd"))


def commit_episodes(df: DataFrame, root: str) -> None:
    """Writes the episodes as one version, and replaces only the episodes that ``df`` has.

    A file is a range of episodes and steps, not an episode, so that the number of files follows the rows, however many episodes they are.
    """
    dataset.write(df, root, "replace", _order(df))


def _order(df: DataFrame) -> str:
    return next((c for c in (dataset.STEP, "step") if c in df.columns), dataset.STEP)


def without_discarded(df: DataFrame, discarded: DataFrame, key: str = "episode_index") -> DataFrame:
    return df.join(discarded.select(key).distinct(), key, "left_anti")


def commit_stream(stream: DataFrame, root: str, checkpoint: str):
    """A streaming sink: every batch is added to its episodes as a version, once even if the batch is run again.

    Batches are told apart by the checkpoint's path and their number.
    """

    def add(batch: DataFrame, number: int) -> None:
        dataset.write(batch, root, "append", _order(batch), (checkpoint, number))

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)


def write_tracking_log(df: DataFrame, path: str, channels: list[str]) -> None:
    """One CSV row per step, in order, missing values blank.

    A short log is one file.  A long one is several, each a range of steps under a header of its own; in the order of their names they are the log.
    """
    columns = ["step", "t", *(f"{c}_{kind}" for kind in ("target", "commanded", "actual") for c in channels)]
    chosen = df.select(*(F.col(f"`{c}`") for c in columns)).repartitionByRange("step").sortWithinPartitions("step")
    chosen.write.mode("overwrite").option("header", True).option("nullValue", "").option("emptyValue", "").csv(path)


def preview(df: DataFrame, order: list[str], n: int = 5) -> DataFrame:
    return df.orderBy(*order).limit(n)


BLOCK_STEPS = 4096
RANGE_STEPS = 1 << 18


class Hdf5Trajectory(DataSource):
    """``episode, step, q`` from an HDF5 file; needs ``h5py``.  Options: ``path``, ``key``, ``episode``, ``range_steps``.

    A partition is a range of an episode's steps, read as hyperslabs of ``BLOCK_STEPS`` and handed on as Arrow batches, so
    a long episode is the work of many tasks, none of which holds more than a block.
    """

    @classmethod
    def name(cls) -> str:
        return "hdf5_trajectory"

    def schema(self) -> StructType:
        return StructType([StructField("episode", StringType()), StructField("step", IntegerType()), StructField("q", ArrayType(DoubleType()))])

    def reader(self, schema: StructType) -> DataSourceReader:
        return Hdf5Reader(
            self.options["path"], self.options.get("key", "states/articulation/robot/joint_position"), self.options.get("episode"),
            int(self.options.get("range_steps", RANGE_STEPS)),
        )


class Steps(InputPartition):
    def __init__(self, episode: str, first: int, after: int) -> None:
        self.episode, self.first, self.after = episode, first, after


class Hdf5Reader(DataSourceReader):
    def __init__(self, path: str, key: str, episode: str | None, range_steps: int = RANGE_STEPS) -> None:
        self.path, self.key, self.episode, self.range_steps = path, key, episode, range_steps

    def _file(self):
        try:
            import h5py
        except ImportError as missing:
            raise ImportError("reading HDF5 trajectories needs h5py") from missing
        return h5py.File(self.path, "r")

    def partitions(self) -> list[InputPartition]:
        """Of the file only names and shapes are read here.  An episode without steps has no partition."""
        with self._file() as file:
            episodes = sorted(file["data"])
            if self.episode is not None and self.episode not in episodes:
                raise KeyError(f"no episode {self.episode}; there are {', '.join(episodes)}")
            chosen = episodes if self.episode is None else [self.episode]
            steps = {e: file["data"][e][self.key].shape[0] for e in chosen}
        parts = [Steps(e, a, min(a + self.range_steps, n)) for e, n in steps.items() for a in range(0, n, self.range_steps)]
        return parts or [Steps("", 0, 0)]

    def read(self, partition: Steps) -> Iterator[pa.RecordBatch]:
        if partition.first >= partition.after:
            return
        with self._file() as file:
            q = file["data"][partition.episode][self.key]
            for first in range(partition.first, partition.after, BLOCK_STEPS):
                block = np.asarray(q[first : min(first + BLOCK_STEPS, partition.after)], np.float64)
                rows, flat = len(block), block[:, 0] if block.ndim == 3 else block.reshape(len(block), -1)  # one robot of an environment
                values = pa.ListArray.from_arrays(pa.array(np.arange(rows + 1) * flat.shape[1], pa.int32()), pa.array(flat.reshape(-1)))
                yield pa.RecordBatch.from_pydict(
                    {"episode": pa.array([partition.episode] * rows, pa.string()), "step": pa.array(np.arange(first, first + rows), pa.int32()), "q": values}
                )


def named_trajectory(df: DataFrame, joint_order: list[str]) -> DataFrame:
    """Adds ``joints``, a map by name; a width other than the order's is an error."""
    return df.withColumn("joints", F.map_from_arrays(F.array(*(F.lit(j) for j in joint_order)), "q"))


def read_joint_order(spark: SparkSession, path: str) -> list[str]:
    """A JSON list of joint names, or an object that has one as ``joint_order``."""
    found = json.loads(spark.read.text(path, wholetext=True).first()[0])
    return found["joint_order"] if isinstance(found, dict) else found
