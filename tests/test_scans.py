"""Spread scans and as-of joins against the plain ones."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gantry.operators import bins, folds, scans, summaries

NUMBER = st.one_of(st.none(), st.floats(-50, 50), st.sampled_from([float("nan"), float("inf"), 0.0, 5.0, -5.0]))


def close(a, b):
    return a is None and b is None or a == pytest.approx(b, abs=1e-9)


def summed(recurrence, rows, cut):
    """The rows after ``cut``, from the state that the operations of those before lead to."""
    summary = scans.SUMMARIES[type(recurrence)](recurrence)
    for row in rows[:cut]:
        summary.feed(*row)
    state = recurrence.start()
    for op in summary.closed():
        state = scans.applied(recurrence, state, op)
    return state


@given(st.lists(st.tuples(NUMBER), max_size=40), st.floats(0.05, 20), st.integers(0, 40), st.floats(0, 1))
@settings(deadline=None, max_examples=200)
def test_operations_lead_to_the_same_state(rows, limit, cut, alpha):
    for recurrence in (folds.Slew(limit), folds.Ema(alpha)):
        state = recurrence.start()
        for row in rows[:cut]:
            state, _ = recurrence.step(state, *row)
        assert close(summed(recurrence, rows, cut), state)


@given(st.lists(st.tuples(NUMBER, st.one_of(st.none(), st.floats(0, 10)), st.floats(0.1, 3)), max_size=30), st.integers(0, 30), st.integers(0, 30))
@settings(deadline=None, max_examples=200)
def test_timed_operations(rows, first, second):
    recurrence = folds.TimedSlew(0.5, 4.0, 8.0)
    first, second = sorted((first, second))
    state, composed = recurrence.start(), recurrence.start()
    for part in (rows[:first], rows[first:second], rows[second:]):
        summary = scans.TimedSummary(recurrence)
        for row in part:
            state, _ = recurrence.step(state, *row)
            summary.feed(*row)
        for op in summary.closed():
            composed = scans.applied(recurrence, composed, op)
        assert close(composed[0], state[0]) and composed[2] == state[2]
        assert state[2] or composed[1] == state[1]


def test_maps_are_closed_when_they_grow(monkeypatch):
    monkeypatch.setattr(scans, "KNOTS", 8)
    r = random.Random(7)
    rows = [(r.uniform(-100, 100),) for _ in range(500)]
    state, recurrence = None, folds.Slew(0.01)
    for row in rows:
        state, _ = recurrence.step(state, *row)
    assert summed(recurrence, rows, 500) == pytest.approx(state, abs=1e-9)


def hot_table(spark, n=4000, seed=3):
    """One key with most of the rows, some small ones, a null key, ties in nothing, extra columns with awkward names."""
    r = random.Random(seed)
    rows = []
    for i in range(n):
        key = "hot" if r.random() < 0.7 else r.choice(["a", "b", None, "8.pos"])
        rows.append((key, i, r.choice([None, float("nan"), r.uniform(0, 100), r.uniform(0, 100), r.uniform(0, 100)]), i * 0.1 + (60 if i > 3500 else 0), i, "x", i, 0, 1.0))
    r.shuffle(rows)
    return spark.createDataFrame(rows, "channel string, i long, v double, t double, bin long, state string, hot long, nth int, step_limit double").repartition(5)


SCANS = {
    "ema": lambda of, df, **k: of.ema(df, ["channel"], ["i"], "v", 0.2, **k),
    "slew": lambda of, df, **k: of.slew_limit(df, ["channel"], ["i"], "v", 3.0, **k),
    "gripper": lambda of, df, **k: of.slew_limit(df, ["channel"], ["i"], "v", 3.0, gripper_limit=9.0, **k),
    "timed": lambda of, df, **k: of.slew_limit_timed(df, ["channel"], ["i"], "v", "t", 5.0, 0.2, stale=1.0, timeout=50.0, **k),
    "by time": lambda of, df, **k: of.ema(df.withColumn("i", F.timestamp_millis("i")), ["channel"], ["i"], "v", 0.2, **k),
    "no key": lambda of, df, **k: of.ema(df, [], ["i"], "v", 0.2, **k) if k else of.ema(df.withColumn("one", F.lit(1)), ["one"], ["i"], "v", 0.2).drop("one"),
}


@pytest.mark.parametrize("name", SCANS)
@pytest.mark.parametrize("split", [1, 30])
def test_scan_is_the_fold(spark, name, split):
    df = hot_table(spark)
    want, found = (sorted(x.collect(), key=lambda r: r["nth"] * 0 + r["bin"]) for x in (SCANS[name](folds, df), SCANS[name](scans, df, bins=split)))
    assert len(want) == len(found) == 4000 and found[0].asDict().keys() == want[0].asDict().keys()
    for a, b in zip(want, found, strict=True):
        assert a[:2] == b[:2] and a["hot"] == b["hot"] and close(a[-1], b[-1])


def test_scan_of_nothing(spark):
    assert scans.ema(hot_table(spark).limit(0), ["channel"], ["i"], "v", 0.2).collect() == []


def test_a_hot_key_is_spread(spark):
    df, name, hot = bins.binned(hot_table(spark), ["channel"], "i", 30)
    sizes = df.filter("channel = 'hot'").groupBy(name).count().collect()
    assert len(sizes) >= 20 and max(r["count"] for r in sizes) < 2 * 4000 / 30
    assert {r["channel"] for r in hot.collect()} >= {"hot"}
    edges = df.filter("channel = 'hot'").groupBy(name).agg(F.min("i").alias("low"), F.max("i").alias("high")).orderBy(name).collect()
    assert all(a["high"] < b["low"] for a, b in zip(edges, edges[1:]))


def test_ten_million_rows_of_one_episode(spark):
    """Every task has its share of one episode; values are checked against closed forms in NumPy."""
    n = 10_000_000
    df = spark.range(n).select((F.col("id") * 0 + 7).alias("e"), F.col("id").alias("i"), (F.col("id") % 1000).cast("double").alias("v"))
    found = scans.slew_limit(df, ["e"], ["i"], "v", 2.0).filter("i >= 9999000").select("i", "commanded").collect()
    got = {r["i"]: r["commanded"] for r in found}
    at = 0.0
    for _ in range(5):  # the sawtooth's cycle is reached at once
        for t in range(1000):
            at = at + max(-2.0, min(2.0, t - at))
            want = got.get(9_999_000 + t)
    for t in range(1000):
        at = at + max(-2.0, min(2.0, t - at))
        want = got[9_999_000 + t]
        assert want == pytest.approx(at, abs=1e-9)
    _, _, hot = bins.binned(df, ["e"], "i", 16)
    assert hot.count() == 1


def plain_as_of(times, values):
    """Newest value at or before, of equal times the largest value."""
    out = []
    for key, t, tag in times:
        known = [(vt, v is not None, v) for k, vt, v in values if k == key and vt is not None and t is not None and vt <= t]
        out.append((tag, max(known, key=lambda x: (x[0], x[1], x[2] if x[1] else 0))[2] if known else None))
    return sorted(out)


@pytest.mark.parametrize("split", [1, 20])
def test_as_of_by_buckets(spark, split):
    r = random.Random(5)
    pick = lambda: r.choice(["hot"] * 6 + ["a", "b", None])
    values = [(pick(), r.choice([None, r.randrange(300), r.randrange(300)]), r.choice([None, 1.0, 2.0, float(k)])) for k in range(600)]
    times = [(pick(), r.choice([None, r.randrange(320), r.randrange(320)]), k) for k in range(700)]
    v = spark.createDataFrame(values, "k string, t long, value double").repartition(3)
    t = spark.createDataFrame([(k, x, tag, 0, "c") for k, x, tag in times], "k string, t long, tag int, bin int, is_time string").repartition(3)
    found = summaries.as_of_bucketed(t, v, ["k"], "t", "value", bins=split)
    assert found.columns == ["k", "t", "tag", "bin", "is_time", "value"]
    key = lambda x: (x[0], x[1] is not None, x[1] or 0)
    assert sorted(((r["tag"], r["value"]) for r in found.collect()), key=key) == sorted(plain_as_of(times, values), key=key)


def test_as_of_by_buckets_of_nothing(spark):
    v = spark.createDataFrame([("a", 1, 2.0)], "k string, t long, value double")
    t = v.select("k", "t")
    assert summaries.as_of_bucketed(t.limit(0), v, ["k"], "t", "value").collect() == []
    assert summaries.as_of_bucketed(t, v.limit(0), ["k"], "t", "value").first()["value"] is None


def test_as_of_by_buckets_spreads_a_hot_key(spark):
    """No task of the plan's last window has more than a few hundredths of a key that holds all rows."""
    n = 40_000
    rows = spark.range(n).select(F.lit("k").alias("k"), "id", (F.col("id") % 7).cast("double").alias("value"))
    found = summaries.as_of_bucketed(rows.filter("id % 2 = 1").select("k", "id"), rows.filter("id % 10 = 0"), ["k"], "id", "value", bins=40)
    assert found.filter("value IS DISTINCT FROM CAST(id DIV 10 * 10 % 7 AS DOUBLE)").isEmpty()
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        sizes = found.groupBy(F.spark_partition_id().alias("p")).count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert np.max([r["count"] for r in sizes]) < n / 2 * 0.6
