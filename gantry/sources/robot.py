"""Calibration files, robot descriptions and bus captures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gantry.functions.scalars import can_byte, can_position, can_word

NUMBERS = "STRUCT<" + ", ".join(f"joint{k}: DOUBLE" for k in range(1, 8)) + ">"
SIDE = f"STRUCT<sign: {NUMBERS}, offset_rad: {NUMBERS}, gripper: STRUCT<open_raw: DOUBLE, closed_raw: DOUBLE>>"


def read_calibration(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Joint rows (side, joint, sign, offset_rad) and gripper rows (side, open_raw, closed_raw).

    Both sides and all seven joints get a row: what is absent or no number (a number in quotes is none) stays null, for the
    check to find.  Without an offset section the side's offsets are 0.
    """
    text = spark.read.text(path, wholetext=True)
    parsed = text.select(F.from_json("value", f"STRUCT<left: {SIDE}, right: {SIDE}>").alias("c"))
    sides = parsed.select(F.explode(F.create_map(F.lit("left"), "c.left", F.lit("right"), "c.right")).alias("side", "s"))
    each = [F.struct(F.lit(k).alias("joint"), F.col(f"s.sign.joint{k}").alias("sign"), F.when(F.col("s.offset_rad").isNull(), 0.0).otherwise(F.col(f"s.offset_rad.joint{k}")).alias("offset_rad")) for k in range(1, 8)]
    joints = sides.select("side", F.explode(F.array(*each)).alias("j")).select("side", "j.*")
    return joints, sides.select("side", "s.gripper.open_raw", "s.gripper.closed_raw")


URDF_JOINT = """
_name STRING, _type STRING, parent STRUCT<_link: STRING>, child STRUCT<_link: STRING>,
origin STRUCT<_rpy: STRING, _xyz: STRING>, axis STRUCT<_xyz: STRING>,
limit STRUCT<_lower: DOUBLE, _upper: DOUBLE, _effort: DOUBLE, _velocity: DOUBLE>, mimic STRUCT<_joint: STRING, _multiplier: DOUBLE, _offset: DOUBLE>
"""


def read_joints(spark: SparkSession, path: str) -> DataFrame:
    """The joints of a URDF file; commented-out ones do not count, as the file is parsed."""
    raw = spark.read.format("xml").option("rowTag", "joint").schema(URDF_JOINT).load(path)
    triple = lambda c: F.transform(F.split(F.trim(c), r"\s+"), lambda x: x.cast("double"))
    return raw.select(
        F.col("_name").alias("name"), F.col("_type").alias("type"), F.col("parent._link").alias("parent"), F.col("child._link").alias("child"),
        triple(F.col("origin._rpy")).alias("rpy"), triple(F.col("origin._xyz")).alias("xyz"), triple(F.col("axis._xyz")).alias("axis"),
        F.col("limit._lower").alias("lower"), F.col("limit._upper").alias("upper"), F.col("limit._effort").alias("effort"),
        F.col("limit._velocity").alias("velocity"), F.col("mimic._joint").alias("mimic"), F.col("mimic._multiplier").alias("multiplier"), F.col("mimic._offset").alias("offset"),
    ).filter("child IS NOT NULL")


URDF_LINK = "_name STRING, inertial STRUCT<mass: STRUCT<_value: DOUBLE>, origin: STRUCT<_xyz: STRING>>"


def read_links(spark: SparkSession, path: str) -> DataFrame:
    """``name, mass, centre`` of the links of a URDF file; null where the description has none."""
    raw = spark.read.format("xml").option("rowTag", "link").schema(URDF_LINK).load(path)
    centre = F.transform(F.split(F.trim(F.col("inertial.origin._xyz")), r"\s+"), lambda x: x.cast("double"))
    return raw.select(F.col("_name").alias("name"), F.col("inertial.mass._value").alias("mass"), centre.alias("centre")).filter("name IS NOT NULL")


def require_joints(joints: DataFrame, names: list[str]) -> None:
    """An error that lists the names the description lacks."""
    found = {r["name"] for r in joints.filter(F.col("name").isin(names)).select("name").collect()}
    if missing := sorted(set(names) - found):
        raise KeyError(f"the description has no joints {', '.join(missing)}")


def decode_can(df: DataFrame, data: str = "data") -> DataFrame:
    """Adds ``motor`` (low) and ``error`` (high half of the first byte), ``code`` and ``position``."""
    first = can_byte(F.col(data), 1)
    decoded = df.withColumns({"error": F.expr(f"conv(hex(substring({data}, 1, 1)), 16, 10) div 16").cast("int"), "motor": first.bitwiseAND(F.lit(15)), "code": can_word(F.col(data), 2)})
    return decoded.withColumn("position", can_position(F.col("code")))


CLASSIC_BYTES, FD_BYTES = 16, 72


def split_frames(df: DataFrame, raw: str = "raw") -> DataFrame:
    """``can_id, dlc, data`` from socket frames: little-endian id, length, data from byte 9; other sizes are dropped."""
    sized = df.filter(F.length(raw).isin(CLASSIC_BYTES, FD_BYTES))
    parts = [F.conv(F.hex(F.substring(raw, k, 1)), 16, 10).cast("long") for k in range(1, 5)]
    identifier = parts[0] + parts[1] * 256 + parts[2] * 65536 + parts[3] * 16777216
    dlc = can_byte(F.col(raw), 5)
    return sized.withColumns({"can_id": identifier, "dlc": dlc}).withColumn("data", F.expr(f"substring({raw}, 9, dlc)"))
