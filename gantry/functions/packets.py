"""Stream packets in JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PACKET = "seq BIGINT, t DOUBLE, joints MAP<STRING, DOUBLE>"


def parse_packets(df: DataFrame, value: str = "value") -> DataFrame:
    """Adds ``seq`` and ``joints``; drops rows that are no such packet, whether malformed or incomplete."""
    parsed = df.withColumn("packet", F.from_json(F.col(value), PACKET))
    rows = parsed.filter(F.col("packet.seq").isNotNull() & F.col("packet.joints").isNotNull())
    return rows.withColumns({"seq": F.col("packet.seq"), "joints": F.col("packet.joints")}).drop("packet", value)


def feedback(t: Column, joints: Column) -> Column:
    """What is sent back: a JSON object of time and joints."""
    return F.to_json(F.struct(t.alias("t"), joints.alias("joints")))
