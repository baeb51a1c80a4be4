"""Aggregates over frames and bus captures, and the joins they need."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gantry.columns import fresh, named
from gantry.functions.scalars import is_gripper
from gantry.operators.bins import binned

JOINT_TOLERANCE = 0.1
GRIPPER_TOLERANCE = 0.005
HANDSHAKE_GRIPPER_TOLERANCE = 1.3


def paired(target: DataFrame, actual: DataFrame, keys: list[str], strict: bool = True) -> DataFrame:
    """Targets with actual values by key and channel; ``strict`` makes a missing actual value an error, else it stays out."""
    on = [*keys, "channel"]
    both = target.withColumnRenamed("value", "target").join(actual.withColumnRenamed("value", "actual"), on, "left" if strict else "inner")
    if not strict:
        return both.filter("actual IS NOT NULL AND target IS NOT NULL")
    error = F.raise_error(F.concat(F.lit("no actual value for "), F.col("channel")))
    return both.withColumn("actual", F.when(F.col("actual").isNull(), error.cast("double")).otherwise(F.col("actual")))


def tracking_summary(df: DataFrame, by: list[str], target: str, actual: str) -> DataFrame:
    error = F.abs(F.col(actual) - F.col(target))
    return df.groupBy(*by).agg(F.count(error).alias("n"), F.avg(error).alias("mean_err"), F.max(error).alias("max_err"))


def tolerance(channel: Column, joint: float, gripper: float) -> Column:
    return F.when(is_gripper(channel), gripper).otherwise(joint)


def handshake(df: DataFrame, keys: list[str], order: str, allowed: Column) -> DataFrame:
    """Per key the channel farthest from its target in tolerances (ties: the first in order), and whether it passes."""
    ratio = F.abs(F.col("target") - F.col("actual")) / allowed
    worst = F.max_by(F.struct("channel", ratio.alias("ratio")), F.struct(ratio, -F.col(order)))
    return df.groupBy(*keys).agg(worst.alias("w")).select(*keys, F.col("w.channel").alias("channel"), F.col("w.ratio").alias("ratio"), (F.col("w.ratio") <= 1.0).alias("passed"))


def axis_range(df: DataFrame, by: list[str], value: str, smallest: Column) -> DataFrame:
    """Plot range: centre and 1.1 half ranges, ``smallest`` at least."""
    ends = df.groupBy(*by).agg(F.min(value).alias("low"), F.max(value).alias("high"))
    half = F.greatest((F.col("high") - F.col("low")) / 2 * 1.1, smallest)
    return ends.withColumn("centre", (F.col("low") + F.col("high")) / 2).withColumn("half", half)


def latest_per_key(df: DataFrame, key: str, order: Column, value: str) -> DataFrame:
    return df.groupBy(key).agg(F.max_by(value, order).alias(value), F.count("*").alias("n"))


def unmatched_ids(df: DataFrame, key: str, known: list) -> DataFrame:
    """One row per id that is not known, sorted."""
    return df.filter(~F.col(key).isin(known)).select(key).distinct().orderBy(key)


def with_silent(ids: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    """All ids of the (small, fixed) id table, those without frames with nulls."""
    return ids.join(seen, key, "left").withColumn("responded", F.col("n").isNotNull())


def as_of(times: DataFrame, values: DataFrame, keys: list[str], time: str, value: str) -> DataFrame:
    """For each row of ``times`` the newest value at or before it, through one ordered union of both.

    Of values at one time the largest counts, null being the least; a null time finds nothing and is found by nothing.  ``as_of_bucketed`` spreads hot keys.
    """
    both, flag, newest = _tagged(times, values, time, value)
    w = Window.partitionBy(*map(named, keys)).orderBy(named(time), flag, newest).rowsBetween(Window.unboundedPreceding, 0)
    return _answered(both, F.last(newest, ignorenulls=True).over(w), times, time, value, flag)


def _tagged(times: DataFrame, values: DataFrame, time: str, value: str) -> tuple[DataFrame, str, str]:
    """Rows of both, values before times of the same moment, and the names of the columns that tell (1 a time) and hold the value in a struct."""
    flag, newest = (fresh(name, [*times.columns, *values.columns]) for name in ("is_time", "newest"))
    rows = times.drop(value).withColumn(flag, F.lit(1))
    known = values.filter(named(time).isNotNull()).withColumn(newest, F.struct(named(value).alias("v"))).drop(value).withColumn(flag, F.lit(0))
    known = known.select(*(named(c) for c in known.columns if c in times.columns or c in (flag, newest)))
    return known.unionByName(rows, allowMissingColumns=True), flag, newest


def _answered(both: DataFrame, newest: Column, times: DataFrame, time: str, value: str, flag: str) -> DataFrame:
    found = both.withColumn(value, F.when(named(time).isNotNull(), newest["v"])).filter(F.col(flag) == 1)
    return found.select(*(named(c) for c in times.columns if c != value), named(value))


def as_of_bucketed(times: DataFrame, values: DataFrame, keys: list[str], time: str, value: str, bins: int | None = None) -> DataFrame:
    """As ``as_of``, with keys that hold more than a ``bins``-th of all rows (four for each shuffle partition) cut into buckets of time.

    The last value of each bucket is found by a plain aggregation, and carried to the buckets after it, by a window over buckets; each bucket
    then answers for itself, beginning with what is carried in.  Two jobs run while this is built, over keys and times alone.
    """
    n = int(times.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tagged, flag, newest = _tagged(times, values, time, value)
    both, bucket, hot = binned(tagged, keys, time, bins or 4 * n)
    by = [*map(named, keys), F.col(bucket)]
    if hot is not None:
        last = both.filter((F.col(flag) == 0) | (F.col(bucket) > 0)).groupBy(*by).agg(F.max_by(newest, F.when(F.col(flag) == 0, F.struct(named(time), F.col(newest)))).alias(newest))
        before = Window.partitionBy(*by[:-1]).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
        carried = last.withColumn(newest, F.last(newest, ignorenulls=True).over(before)).filter(F.col(newest).isNotNull())
        both = both.unionByName(carried.withColumn(flag, F.lit(-1)), allowMissingColumns=True)
    w = Window.partitionBy(*by).orderBy(F.col(flag) >= 0, named(time), flag, newest).rowsBetween(Window.unboundedPreceding, 0)
    return _answered(both, F.last(newest, ignorenulls=True).over(w), times, time, value, flag)


def any_null(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.coalesce(F.bool_or(F.col(column).isNull()), F.lit(False)).alias("any_null"))


def accuracy(df: DataFrame, label: str, predicted: str) -> DataFrame:
    return df.agg(F.avg((F.col(label) == F.col(predicted)).cast("int")).alias("accuracy"))
