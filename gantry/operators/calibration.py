"""Mapping between simulated and robot joint values through a calibration table.

The table has one row per side and joint 1 to 7 (``sign``, ``offset_rad``) and the side's gripper ends
(``open_raw``, ``closed_raw``).  Spark broadcasts it by its size.  A side and joint there twice is a defect, and an error for the frames it concerns.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gantry.columns import fresh
from gantry.functions import scalars

SIDE_OF = {"L": "left", "R": "right"}


def violations(joints: DataFrame, grippers: DataFrame) -> DataFrame:
    """One row per defect: joints need a sign of 1 or -1 and an offset, grippers two different ends, and each of them one row (``repeated``)."""
    bad_sign = joints.filter(F.col("sign").isNull() | ~F.col("sign").isin(1, -1)).select("side", F.lit("sign").alias("what"))
    bad_offset = joints.filter("offset_rad IS NULL").select("side", F.lit("offset_rad").alias("what"))
    ends = F.col("open_raw").isNull() | F.col("closed_raw").isNull() | (F.col("open_raw") == F.col("closed_raw"))
    bad_ends = grippers.filter(ends).select("side", F.lit("gripper").alias("what"))
    twice = [df.groupBy(*keys).count().filter("count > 1").select("side", F.lit("repeated").alias("what")) for df, keys in ((joints, ["side", "joint"]), (grippers, ["side"]))]
    return reduce(DataFrame.unionByName, [bad_sign, bad_offset, bad_ends, *twice])


def _once(df: DataFrame, keys: list[str], columns: list[str], count: str) -> DataFrame:
    """A row for each key, and how many there are of it."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(count), *(F.first(c).alias(c) for c in columns))


def require_valid(joints: DataFrame, grippers: DataFrame) -> None:
    found = violations(joints, grippers).limit(20).collect()
    if found:
        raise ValueError("calibration: " + ", ".join(sorted(f"{r['side']} {r['what']}" for r in found)))


def _joined(frames: DataFrame, joints: DataFrame, grippers: DataFrame) -> DataFrame:
    """Frames (long, with ``side`` and ``joint``) with their calibration; a row that finds none is an error."""
    n_arm, n_ends = (fresh(name, frames.columns) for name in ("arm_rows", "end_rows"))
    arms = _once(joints, ["side", "joint"], ["sign", "offset_rad"], n_arm)
    both = frames.join(arms, ["side", "joint"], "left").join(_once(grippers, ["side"], ["open_raw", "closed_raw"], n_ends), "side", "left")
    gripper = F.col("joint") == scalars.GRIPPER
    missing = F.when(gripper, F.col("open_raw").isNull()).otherwise(F.col("sign").isNull())
    twice = F.when(gripper, F.col(n_ends) > 1).otherwise(F.col(n_arm) > 1)
    error = lambda what: F.raise_error(F.format_string(f"{what} for side %s joint %s", F.col("side"), F.col("joint").cast("string")))
    return both.withColumn("side", F.when(missing, error("no calibration")).when(twice, error("more than one calibration")).otherwise(F.col("side")))


def to_robot(frames: DataFrame, joints: DataFrame, grippers: DataFrame, gripper_unit: str = "sim") -> DataFrame:
    """Adds ``robot_value``; joint 8 is the gripper, in ``sim`` radians or as a ``command``."""
    ends = F.col("open_raw"), F.col("closed_raw")
    convert = {"sim": scalars.gripper_sim_to_raw, "command": scalars.gripper_command_to_raw}[gripper_unit]
    value = F.when(F.col("joint") == scalars.GRIPPER, convert(F.col("value"), *ends)).otherwise(
        scalars.joint_to_robot(F.col("value"), F.col("sign"), F.col("offset_rad"))
    )
    return _joined(frames, joints, grippers).select(*frames.columns, value.alias("robot_value"))


def from_robot(frames: DataFrame, joints: DataFrame, grippers: DataFrame, fingers: int = 2) -> DataFrame:
    """Adds ``sim_value`` and ``finger``: a gripper becomes one row per finger, other joints keep one (null)."""
    ends = F.col("open_raw"), F.col("closed_raw")
    gripper = F.col("joint") == scalars.GRIPPER
    value = F.when(gripper, scalars.gripper_raw_to_sim(F.col("value"), *ends)).otherwise(
        scalars.joint_from_robot(F.col("value"), F.col("sign"), F.col("offset_rad"))
    )
    rows = _joined(frames, joints, grippers).select(*frames.columns, value.alias("sim_value"))
    of_row = F.when(gripper, F.sequence(F.lit(1), F.lit(fingers))).otherwise(F.array(F.lit(None).cast("int")))
    return rows.withColumn("finger", F.explode(of_row))


def rest_pose(joints: DataFrame, grippers: DataFrame) -> DataFrame:
    """Each channel at simulated zero, grippers open."""
    arms = joints.select("side", "joint", F.col("offset_rad").alias("value"))
    return arms.unionByName(grippers.select("side", F.lit(scalars.GRIPPER).alias("joint"), F.col("open_raw").alias("value")))


def left_with_hold(frames: DataFrame, joints: DataFrame, grippers: DataFrame, held: DataFrame, gripper_unit: str = "command") -> DataFrame:
    """The left side mapped; the right side's held values (side, joint, value; a row per joint, no more) on every frame."""
    kept = held.limit(scalars.GRIPPER + 1).collect()
    if len(kept) > scalars.GRIPPER:
        raise ValueError(f"more than {scalars.GRIPPER} held values")
    mapped = to_robot(frames.filter("side = 'left'"), joints.filter("side = 'left'"), grippers.filter("side = 'left'"), gripper_unit)
    mapped = mapped.select("episode", "step", "side", "joint", F.col("robot_value").alias("value"))
    steps = mapped.select("episode", "step").distinct()
    right = F.array(*(F.struct(F.lit(r["side"]).alias("side"), F.lit(r["joint"]).alias("joint"), F.lit(r["value"]).alias("value")) for r in kept))
    return mapped.unionByName(steps.withColumn("h", F.explode(right)).select("episode", "step", "h.side", "h.joint", "h.value"))


def channel_of(side: Column, joint: Column) -> Column:
    return scalars.channel_name(F.upper(F.substring(side, 1, 1)), joint)
