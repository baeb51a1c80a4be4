"""Ordered operators that windows and generators express."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gantry.columns import fresh
from gantry.functions.scalars import clip_keep_nan, lerp


def step_clamp(measured: Column, target: Column, limit: float) -> Column:
    """One step from the measured value towards the target; NaN stays NaN."""
    return measured + clip_keep_nan(target - measured, -limit, limit)


def hysteresis(df: DataFrame, keys: list[str], order: list[str], value: str, threshold: float, seed: bool, output: str = "open") -> DataFrame:
    """Strictly above the threshold opens, strictly below its negative closes, else the state holds."""
    so_far = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    switched = F.when(F.col(value) > threshold, True).when(F.col(value) < -threshold, False)
    return df.withColumn(output, F.coalesce(F.last(switched, ignorenulls=True).over(so_far), F.lit(seed)))


def stalls(df: DataFrame, keys: list[str], order: list[str], target: str, actual: str, moved: float = 0.15, still: float = 0.02, hits: int = 3) -> DataFrame:
    """Adds ``hit`` and ``fired``: the target moved but the actual value did not, ``hits`` times in a row, then anew.

    A row without target or actual value (null or NaN) is a read that failed: it is passed over.  ``steps.Stall`` is the same a row at a time.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    read = F.coalesce(~F.isnan(target) & ~F.isnan(actual) & F.col(target).isNotNull() & F.col(actual).isNotNull(), F.lit(False))
    before = lambda c: F.last(F.when(read, F.col(c)), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    hit = read & F.coalesce((F.abs(F.col(target) - before(target)) >= moved) & (F.abs(F.col(actual) - before(actual)) < still), F.lit(False))
    run = fresh("run", [*df.columns, "hit", "fired"])
    runs = df.withColumn("hit", hit).withColumn(run, F.sum((read & ~F.col("hit")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    within = Window.partitionBy(*keys, run).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    place = F.sum(F.col("hit").cast("int")).over(within)
    return runs.withColumn("fired", F.col("hit") & (place % hits == 0)).drop(run)


MAX_ATTEMPTS = 8


def _first_attempts(df: DataFrame, keys: list[str], attempt: str, max_attempts: int | None) -> DataFrame:
    if max_attempts is None:
        return df
    nth = fresh("nth", df.columns)
    return df.withColumn(nth, place(keys, [attempt])).filter(F.col(nth) <= max_attempts).drop(nth)


def _refused(found: Column, keys: list[str], max_attempts: int | None, raising: bool) -> Column:
    """``found``, or an error that names the key if there must be one."""
    if not raising:
        return found
    text = F.concat(F.lit(f"no trustworthy read within {max_attempts or 'all'} attempts: "), F.to_json(F.struct(*keys)) if keys else F.lit(""))
    return F.when(found.isNull(), F.raise_error(text)).otherwise(found)


def first_plausible(df: DataFrame, keys: list[str], attempt: str, plausible: Column, frame: str, max_attempts: int | None = None, raising: bool = False) -> DataFrame:
    """Of each key's attempts (the first ``max_attempts``) the first plausible one's frame; null where none is, or an error if ``raising``."""
    ordered = F.min_by(F.when(plausible, F.col(frame)), F.when(plausible, F.col(attempt)))
    found = _first_attempts(df, keys, attempt, max_attempts).groupBy(*keys).agg(ordered.alias(frame), F.min(F.when(plausible, F.col(attempt))).alias(attempt))
    return found.withColumn(attempt, _refused(F.col(attempt), keys, max_attempts, raising))


def first_stable(
    df: DataFrame, keys: list[str], attempt: str, channels: list[str], tolerance: float = 0.01, plausible: Column | None = None,
    max_attempts: int | None = None, raising: bool = False,
) -> DataFrame:
    """The first attempt (of the first ``max_attempts``) within ``tolerance`` of the one before on all channels, and plausible; the one before need not be.

    A read that lacks a channel, or has a NaN, agrees with none.  Null where no attempt is stable, or an error if ``raising``.
    """
    w = Window.partitionBy(*keys).orderBy(attempt)
    each = [F.abs(F.col(c) - F.lag(c).over(w)) for c in channels]
    all_there = F.lit(True)
    for e in each:
        all_there = all_there & e.isNotNull()
    apart = fresh("apart", df.columns)
    compared = _first_attempts(df, keys, attempt, max_attempts).withColumn(apart, F.when(all_there, F.greatest(*each, F.lit(0.0))))
    good = (F.col(apart) <= tolerance) & (F.lit(True) if plausible is None else plausible)
    found = compared.groupBy(*keys).agg(F.min(F.when(good, F.col(attempt))).alias(attempt), F.max(apart).alias("worst"))
    return found.withColumn(attempt, _refused(F.col(attempt), keys, max_attempts, raising))


def ramp_steps(duration: Column, hz: Column) -> Column:
    return F.greatest(F.lit(1), (duration * hz).cast("int"))


def ramp(df: DataFrame, start: str, end: str, steps: Column, output: str = "value") -> DataFrame:
    """Each row becomes its ramp from just after ``start`` to ``end``: ``i`` from 1 on, ``alpha`` and the value."""
    stepped = df.withColumn("steps", steps).withColumn("i", F.explode(F.sequence(F.lit(1), F.col("steps"))))
    stepped = stepped.withColumn("alpha", F.col("i") / F.col("steps"))
    return stepped.withColumn(output, lerp(F.col(start), F.col(end), F.col("alpha")))


def upsample(df: DataFrame, measured: str, target: str, n: int = 10, output: str = "value") -> DataFrame:
    """``n`` steps between what was measured and the target."""
    return ramp(df, measured, target, F.lit(n), output)


def gain_ramp(df: DataFrame, gains: list[str], target: str, start: str, steps: Column) -> DataFrame:
    """Gains rise from 0 with the position's ramp."""
    ramped = ramp(df, start, target, steps)
    return ramped.withColumns({g: F.col(g) * F.col("alpha") for g in gains})


def place(keys: list[str], order: list[str]) -> Column:
    return F.row_number().over(Window.partitionBy(*keys).orderBy(*order))


def skip_warm_up(df: DataFrame, keys: list[str], order: list[str], n: int = 1) -> DataFrame:
    nth = fresh("nth", df.columns)
    return df.withColumn(nth, place(keys, order)).filter(F.col(nth) > n).drop(nth)


def head(df: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    """The first ``n`` frames; a negative ``n`` is refused, as it would mean another thing."""
    if n < 0:
        raise ValueError("n must not be negative")
    nth = fresh("nth", df.columns)
    return df.withColumn(nth, place(keys, order)).filter(F.col(nth) <= n).drop(nth)


def hold(df: DataFrame, constants: dict[str, float]) -> DataFrame:
    """Fixed values on every frame."""
    return df.withColumns({name: F.lit(value) for name, value in constants.items()})


def executed(df: DataFrame, model_time: str = "model_time", budget: float = 0.027) -> DataFrame:
    """Frames are stored before the overrun check, so those over budget were stored but never sent."""
    return df.withColumn("executed", F.coalesce(F.col(model_time) <= budget, F.lit(False)))


def within_time(df: DataFrame, keys: list[str], time: str, seconds: float) -> DataFrame:
    """Rows less than ``seconds`` after their episode's first."""
    first = fresh("first", df.columns)
    return df.withColumn(first, F.min(time).over(Window.partitionBy(*keys))).filter(F.col(time) - F.col(first) < seconds).drop(first)


def staleness(df: DataFrame, keys: list[str], received: str, stale_ms: int = 150, timeout_ms: int = 1000, order: list[str] | None = None) -> DataFrame:
    """Adds ``gap_ms`` and ``state``: what the gap before each packet had led to.  Both bounds are strict, the longer goes first.

    Packets received at the same time go by ``order``.
    """
    w = Window.partitionBy(*keys).orderBy(received, *order or [])
    micros = F.unix_micros(F.col(received).cast("timestamp"))
    gap = (micros - F.lag(micros).over(w)) / 1000
    state = F.when(F.col("gap_ms") > timeout_ms, "halt").when(F.col("gap_ms") > stale_ms, "hold").otherwise("track")
    return df.withColumn("gap_ms", gap).withColumn("state", state)


def overruns(df: DataFrame, keys: list[str], order: list[str], time: str, period: float, factor: float = 3.0) -> DataFrame:
    """Rows that come more than ``factor`` periods after the one before."""
    gap = F.col(time) - F.lag(time).over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("gap", gap).filter(F.col("gap") > factor * period)
