"""Nulls, NaN, repeated rows, clashing names and bounded attempts; steps in streams; trees of joints."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gantry.operators import calibration, folds, kinematics, series, steps, summaries
from gantry.streaming import stepped


def test_values_that_are_not_finite_hold(spark):
    nan, inf = float("nan"), float("inf")
    step = folds.slew(1.0)()
    assert [step(v) for v in (nan, 0.0, nan, 2.0, inf, None, 3.0)] == [None, 0.0, 0.0, 1.0, 1.0, 1.0, 2.0]
    step = folds.smooth(0.5)()
    assert [step(v) for v in (4.0, nan, 4.0, -inf)] == [2.0, 2.0, 3.0, 3.0]
    step = folds.slew_timed(0.1)()
    assert [step(*r) for r in ((nan, 0.0, 1.0), (1.0, 1.0, 1.0), (nan, 2.0, 1.0), (9.0, 3.0, 1.0))] == [None, 1.0, 1.0, 3.0]
    rows = spark.createDataFrame([(1, i, v) for i, v in enumerate((0.0, nan, 2.0))], "e int, i int, v double")
    assert [r["commanded"] for r in folds.slew_limit(rows, ["e"], ["i"], "v", 1.0).orderBy("i").collect()] == [0.0, 0.0, 1.0]


def test_columns_of_the_caller_stay(spark):
    names = ["step_limit", "step_speed", "run", "nth", "first", "apart", "rows", "bin", "hot", "state"]
    df = spark.createDataFrame([("LJ1.pos", i, float(i), float(i), 0.0, *range(len(names))) for i in range(4)], "channel string, i int, v double, t double, a double, " + ", ".join(f"`{n}` int" for n in names))
    k, o = ["channel"], ["i"]
    for out in (
        folds.slew_limit(df, k, o, "v", 1.0, gripper_limit=2.0), folds.slew_limit_timed(df, k, o, "v", "t", 1.0, 0.1), series.stalls(df, k, o, "v", "a"), series.skip_warm_up(df, k, o),
        series.head(df, k, o, 2), series.within_time(df, k, "t", 2.0), steps.over_table(df, k, o, ["v", "a"], steps.Stall()),
    ):
        for r in out.collect():
            assert [r[n] for n in names] == list(range(len(names)))


def test_a_missing_reading_is_not_stable(spark):
    rows = [(1, k, v, w) for k, (v, w) in enumerate(((1.0, 1.0), (None, 1.0), (1.0, 1.0), (1.0, float("nan")), (1.0, 1.0), (1.001, 1.0)))]
    df = spark.createDataFrame(rows, "k int, attempt int, a double, b double")
    found = series.first_stable(df, ["k"], "attempt", ["a", "b"]).first()
    assert found["attempt"] == 5
    assert series.first_stable(df.filter("attempt < 4"), ["k"], "attempt", ["a", "b"]).first()["attempt"] is None


def test_attempts_are_bounded(spark):
    rows = [(k, i, 9.0 if i < (3 if k == 1 else 8) else 1.0) for k in (1, 2) for i in range(12)]
    df = spark.createDataFrame(rows, "k int, attempt int, v double")
    good = F.col("v") <= 3.2
    found = {r["k"]: r["attempt"] for r in series.first_plausible(df, ["k"], "attempt", good, "v", max_attempts=8).collect()}
    assert found == {1: 3, 2: None}
    assert {r["k"]: r["attempt"] for r in series.first_plausible(df, ["k"], "attempt", good, "v", max_attempts=9, raising=True).collect()} == {1: 3, 2: 8}
    with pytest.raises(Exception, match='no trustworthy read within 8 attempts.*"k":2'):
        series.first_plausible(df, ["k"], "attempt", good, "v", max_attempts=8, raising=True).collect()
    with pytest.raises(Exception, match="no trustworthy read"):
        series.first_stable(df, ["k"], "attempt", ["v"], plausible=good, max_attempts=8, raising=True).collect()
    assert {r["k"]: r["attempt"] for r in series.first_stable(df, ["k"], "attempt", ["v"], plausible=good, max_attempts=10, raising=True).collect()} == {1: 4, 2: 9}


def test_repeated_calibration_rows(spark):
    joints = spark.createDataFrame([("left", 1, 1, 0.5), ("left", 1, 1, 0.7), ("left", 2, 1, 0.0)], "side string, joint int, sign int, offset_rad double")
    grippers = spark.createDataFrame([("left", -1.0, 0.0), ("right", -1.0, 0.0), ("right", -2.0, 0.0)], "side string, open_raw double, closed_raw double")
    assert sorted(tuple(r) for r in calibration.violations(joints, grippers).collect()) == [("left", "repeated"), ("right", "repeated")]
    with pytest.raises(ValueError, match="left repeated, right repeated"):
        calibration.require_valid(joints, grippers)
    frame = lambda joint: spark.createDataFrame([("left", joint, 0.25)], "side string, joint int, value double")
    assert [r["robot_value"] for r in calibration.to_robot(frame(2), joints, grippers).collect()] == [0.25]
    with pytest.raises(Exception, match="more than one calibration for side left joint 1"):
        calibration.to_robot(frame(1), joints, grippers).collect()


def test_vectors_that_do_not_fit_give_null(spark):
    rows = [([1.0] * 42, [1.0] * 6), (None, [1.0] * 6), ([1.0] * 41, [1.0] * 6), ([1.0] * 42, None), ([None] + [1.0] * 41, [1.0] * 6)]
    df = spark.createDataFrame(rows, "jacobian array<double>, delta array<double>")
    found = [r["dq"] for r in kinematics.dls(df, 6, 7, 0.05).collect()]
    assert len(found[0]) == 7 and found[1:] == [None] * 4
    assert [r["dq"] for r in kinematics.dls(df.filter("jacobian IS NULL"), 6, 7, 0.05).collect()] == [None]


def test_failed_reads_are_passed_over(spark):
    """Neither counted nor a reset: three hits with a failed read in between fire."""
    rows = [(1, 0, 0.0, 0.0), (1, 1, 1.0, 0.0), (1, 2, 2.0, None), (1, 3, 2.0, 0.0), (1, 4, None, 0.0), (1, 5, float("nan"), 0.0), (1, 6, 3.0, 0.0), (1, 7, 4.0, 9.0)]
    df = spark.createDataFrame(rows, "e int, i int, t double, a double")
    found = series.stalls(df, ["e"], ["i"], "t", "a").orderBy("i").collect()
    assert [r["i"] for r in found if r["hit"]] == [1, 3, 6] and [r["i"] for r in found if r["fired"]] == [6]
    again = steps.over_table(df, ["e"], ["i"], ["t", "a"], steps.Stall()).orderBy("i").collect()
    assert [(r["hit"], r["fired"]) for r in again] == [(r["hit"], r["fired"]) for r in found]


def noisy(spark, n=600, seed=2):
    r = random.Random(seed)
    rows = [(r.choice("abc"), i, r.choice([None, r.uniform(-1, 1), r.uniform(-1, 1)]), r.choice([0.0, 0.0, 0.01, 0.5, None]), i) for i in range(n)]
    return spark.createDataFrame(rows, "robot string, i long, target double, actual double, hit long")


def test_steps_are_the_windows(spark):
    df = noisy(spark)
    key = lambda r: r["i"]
    plain = sorted(series.stalls(df, ["robot"], ["i"], "target", "actual").collect(), key=key)
    found = sorted(steps.over_table(df, ["robot"], ["i"], ["target", "actual"], steps.Stall()).collect(), key=key)
    assert [(r["hit"], r["fired"]) for r in plain] == [(r["hit"], r["fired"]) for r in found] and any(r["fired"] for r in found)
    plain = sorted(series.hysteresis(df, ["robot"], ["i"], "target", 0.3, True).collect(), key=key)
    found = sorted(steps.over_table(df, ["robot"], ["i"], ["target"], steps.Latch(0.3, True)).collect(), key=key)
    assert [r["open"] for r in plain] == [r["open"] for r in found]


@pytest.mark.parametrize("cuts", [(1500,), (3, 40, 41, 700, 1500), tuple(range(250, 1501, 250))])
def test_streams_agree_with_tables(spark, sf_dir, tmp_path, cuts):
    """The events, replayed in batches of any size, with a restart after the first."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "event_id", "value", (F.col("event_id") % 7).cast("double").alias("actual"))
    folder = tmp_path / "in"
    folder.mkdir()
    whole, first = rows.orderBy("event_id").toPandas(), 0
    schema = rows.schema

    def deliver(number, after):
        nonlocal first
        part = f"{tmp_path}/{number}.parquet"
        whole[first:after].to_parquet(part, index=False)
        os.utime(part, (1e9 + number, 1e9 + number))
        os.rename(part, folder / f"{number}.parquet")
        first = after

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))
    watched = stepped.watched(stream, ["user_id"], "event_id", "value", "actual", 5.0, 4.0)
    latched = stepped.latched(stream.withColumn("gripper", F.col("value") - 250), ["user_id"], ["event_id"], "gripper", 100.0)

    def run():
        for name, df in (("w", watched), ("l", latched)):
            df.writeStream.format("parquet").option("path", f"{tmp_path}/{name}").option("checkpointLocation", f"{tmp_path}/c{name}").trigger(availableNow=True).start().awaitTermination(300)

    deliver(0, cuts[0])
    run()
    for number, after in enumerate(cuts[1:], 1):
        deliver(number, after)
    run()
    taken = rows.filter(F.col("event_id").isin([int(x) for x in whole["event_id"][: cuts[-1]]]))
    want = steps.recoveries(series.stalls(taken, ["user_id"], ["event_id"], "value", "actual", 5.0, 4.0), ["user_id"], "event_id")
    read = lambda name: spark.read.parquet(f"{tmp_path}/{name}")
    assert sorted(map(tuple, read("w").collect())) == sorted(map(tuple, want.collect())) != []
    want = series.hysteresis(taken.withColumn("gripper", F.col("value") - 250), ["user_id"], ["event_id"], "gripper", 100.0, False)
    assert sorted(map(tuple, read("l").select("event_id", "open").collect())) == sorted(map(tuple, want.select("event_id", "open").collect()))


JOINTS = "name string, type string, parent string, child string, rpy array<double>, xyz array<double>, axis array<double>, mimic string, multiplier double, offset double"
BRANCHES = [
    ("shoulder", "revolute", "base", "upper", [0.2, 0.1, 0.3], [0.1, 0.0, 0.4], [0.0, 1.0, 0.0], None, None, None),
    ("mount", "fixed", "upper", "plate", [0.0, 0.4, 0.0], [0.2, 0.1, 0.0], None, None, None, None),
    ("elbow", "continuous", "plate", "fore", [0.5, 0.0, 0.2], [0.3, 0.0, 0.1], [1.0, 1.0, 0.5], None, None, None),
    ("finger1", "prismatic", "fore", "left", [0.0, 0.3, 0.1], [0.0, -0.1, 0.2], [0.0, -2.0, 0.0], None, None, None),
    ("finger2", "prismatic", "fore", "right", [0.7, 0.0, 0.0], [0.0, 0.1, 0.2], [0.0, 1.0, 1.0], "finger1", None, None),
    ("follower", "revolute", "upper", "cam", [0.0, 0.0, 1.0], [0.0, 0.2, 0.0], [0.3, 0.0, 1.0], "finger2", -1.5, 0.25),
    ("lift", "prismatic", "base", "cart", None, [1.0, 0.0, 0.0], [0.2, 0.0, 1.0], None, None, None),
]
BODIES = [("upper", 1.5, [0.1, 0.2, 0.0]), ("plate", 0.5, [0.0, 0.1, 0.1]), ("fore", 2.0, [0.3, 0.0, -0.1]), ("left", 0.2, [0.05, 0.0, 0.1]), ("right", 0.3, [0.0, 0.04, 0.2]), ("cam", 0.7, [0.2, 0.1, 0.3]), ("cart", 3.0, None), ("base", 9.0, [0.0, 0.0, 0.0])]


def tree(spark):
    return kinematics.Tree.from_joints(spark.createDataFrame(BRANCHES, JOINTS), "base", spark.createDataFrame(BODIES, "name string, mass double, centre array<double>"))


def energy(q):
    """The links' potential at complex coordinates, link by link from the root, written down without the library."""

    def turn(axis, angle):
        x, y, z = np.array(axis, float) / np.linalg.norm(axis)
        k = np.array([[0, -z, y], [z, 0, -x], [-y, x, 0]])
        return np.eye(3) + np.sin(angle) * k + (1 - np.cos(angle)) * (k @ k)

    q = dict(zip(("shoulder", "elbow", "finger1", "lift"), q, strict=True))
    q["finger2"] = q["finger1"]
    q["follower"] = -1.5 * q["finger2"] + 0.25
    rows = {child: (name, kind, parent, rpy or [0] * 3, xyz or [0] * 3, axis) for name, kind, parent, child, rpy, xyz, axis, *_ in BRANCHES}

    def pose(link):
        if link == "base":
            return np.eye(3, dtype=complex), np.zeros(3, complex)
        name, kind, parent, (r, p, y), xyz, axis = rows[link]
        turned, at = pose(parent)
        at = at + turned @ np.array(xyz, float)
        turned = turned @ turn((0, 0, 1), y) @ turn((0, 1, 0), p) @ turn((1, 0, 0), r)
        if kind == "prismatic":
            at = at + turned @ (np.array(axis) / np.linalg.norm(axis) * q[name])
        elif kind != "fixed":
            turned = turned @ turn(axis, q[name])
        return turned, at

    total = 0
    for link, mass, centre in BODIES:
        turned, at = pose(link)
        total = total + mass * kinematics.GRAVITY * (at + turned @ np.array(centre or [0.0] * 3))[2]
    return total


def test_gravity_of_a_tree(spark):
    """Equal to the potential's derivative (by complex steps) for turning, sliding and mimic joints on several branches."""
    t = tree(spark)
    order = ["shoulder", "lift", "elbow", "finger1"]
    assert sorted(t.coordinates) == sorted(order)
    r = np.random.default_rng(4)
    q = r.uniform(-2, 2, (20, 4))
    found = t.gravity(q)
    for row, torque in zip(q, found, strict=True):
        named = dict(zip(t.coordinates, row, strict=True))
        for k, name in enumerate(t.coordinates):
            at = [complex(named[c], 1e-30 * (c == name)) for c in ("shoulder", "elbow", "finger1", "lift")]
            assert torque[k] == pytest.approx(energy(at).imag / 1e-30, abs=1e-9)


def test_tree_in_a_table(spark):
    t = tree(spark)
    q = [0.3, -0.4, 0.5, 0.1]
    df = spark.createDataFrame([(q,), (None,), ([0.1],)], "q array<double>")
    found = [r["tau"] for r in kinematics.gravity_torques(df, t).collect()]
    assert found[0] == pytest.approx(t.gravity(np.array([q]))[0].tolist()) and found[1:] == [None, None]


def test_a_chain_to_a_finger_slides(spark):
    """The Jacobian of a path with a mimic joint whose master lies on another branch, by complex-free differences."""
    c = kinematics.Chain.from_joints(spark.createDataFrame(BRANCHES, JOINTS), "base", "right")
    assert c.coordinates == ["shoulder", "elbow", "finger1"] and c.names[-1] == "finger2"
    q, h = np.array([[0.3, -0.4, 0.5]]), 1e-6
    for k in range(3):
        step = np.eye(3)[[k]] * h
        up, down = c.poses(q + step)[0][0], c.poses(q - step)[0][0]
        assert c.jacobian(q)[0, :3, k] == pytest.approx((up[:3, 3] - down[:3, 3]) / (2 * h), abs=1e-6)
    assert c.jacobian(q)[0, 3:, 2] == pytest.approx([0, 0, 0])


def test_faulty_descriptions(spark):
    make = lambda rows: kinematics.Tree.from_joints(spark.createDataFrame(rows, JOINTS), "base")
    with pytest.raises(ValueError, match="there twice"):
        make([*BRANCHES, ("again", "fixed", "base", "left", None, None, None, None, None, None)])
    with pytest.raises(KeyError, match="mimics none"):
        make([("a", "revolute", "base", "x", None, None, None, "none", None, None)])
    with pytest.raises(ValueError, match="mimic each other"):
        make([("a", "revolute", "base", "x", None, None, None, "b", None, None), ("b", "revolute", "base", "y", None, None, None, "a", None, None)])
    with pytest.raises(ValueError, match="floating"):
        make([("a", "floating", "base", "x", None, None, None, None, None, None)])
    assert make([]).gravity is not None and make([]).coordinates == []


def test_as_of_takes_the_largest_of_equal_times(spark):
    values = spark.createDataFrame([("k", 1, 5.0), ("k", 1, 7.0), ("k", None, 9.0)], "k string, t int, value double")
    times = spark.createDataFrame([("k", 1, "x"), ("k", None, "y")], "k string, t int, is_time string")
    found = {r["is_time"]: r["value"] for r in summaries.as_of(times, values, ["k"], "t", "value").collect()}
    assert found == {"x": 7.0, "y": None}
