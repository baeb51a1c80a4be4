"""Plausibility, bus and table checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gantry.functions.scalars import is_gripper

# The largest angle taken to be real, and socket CAN's flag and masks.
PLAUSIBLE_RAD = 3.2
EXTENDED_FLAG = 0x80000000
EXTENDED_MASK = 0x1FFFFFFF
STANDARD_MASK = 0x7FF


def plausible(channel: Column, value: Column, include_gripper: bool = True, limit: float = PLAUSIBLE_RAD) -> Column:
    """NaN and null are not plausible.  With ``include_gripper`` false, grippers always are."""
    good = F.coalesce(F.abs(value) <= limit, F.lit(False)) & ~F.isnan(value)
    return good if include_gripper else is_gripper(channel) | good


def plausible_frames(df: DataFrame, keys: list[str], include_gripper: bool = True) -> DataFrame:
    """Per frame whether all channels are plausible, and the first that is not by name."""
    good = plausible(F.col("channel"), F.col("value"), include_gripper)
    return df.groupBy(*keys).agg(F.bool_and(good).alias("plausible"), F.min(F.when(~good, F.col("channel"))).alias("first_bad"))


def can_id(raw: Column) -> Column:
    return raw.bitwiseAND(F.when(raw.bitwiseAND(F.lit(EXTENDED_FLAG)) != 0, EXTENDED_MASK).otherwise(STANDARD_MASK))


def answers(df: DataFrame, ids: list[int]) -> DataFrame:
    """Frames of the given ids with at least three bytes."""
    return df.withColumn("can_id", can_id(F.col("can_id").cast("long"))).filter(F.col("can_id").isin(ids) & (F.col("dlc") >= 3))


def column_state(df: DataFrame, column: str) -> str:
    """``missing``, ``null`` (in some row) or ``ok``."""
    if column not in df.columns:
        return "missing"
    return "ok" if df.filter(F.col(column).isNull()).isEmpty() else "null"


def replace_value(df: DataFrame, column: str, old: str, new: str) -> DataFrame:
    return df.withColumn(column, F.when(F.col(column) == old, F.lit(new)).otherwise(F.col(column)))
