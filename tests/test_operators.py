import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gantry.operators import calibration, filters, folds, kinematics, series, summaries


def frame_table(spark, values, schema="e int, i int, v double"):
    return spark.createDataFrame(values, schema)


def test_golden_folds(spark):
    rows = [(1, i, v) for i, v in enumerate((0.0, 3.0, 3.0, -5.0))] + [(2, 0, 7.0)]
    random.Random(1).shuffle(rows)
    found = folds.slew_limit(frame_table(spark, rows), ["e"], ["i"], "v", 1.0).orderBy("e", "i").collect()
    assert [r["commanded"] for r in found] == [0.0, 1.0, 2.0, 1.0, 7.0]
    found = folds.ema(frame_table(spark, [(1, 0, 10.0), (1, 1, 10.0)]), ["e"], ["i"], "v", 0.3).orderBy("i").collect()
    assert [r["smoothed"] for r in found] == pytest.approx([3.0, 5.1])


def test_fold_nulls(spark):
    rows = [(None, 0, 1.0), (None, 1, None), (1, 0, None), (1, 1, 4.0)]
    found = folds.slew_limit(frame_table(spark, rows), ["e"], ["i"], "v", 1.0).orderBy("e", "i").collect()
    assert [r["commanded"] for r in found] == [1.0, 1.0, None, 4.0]
    assert folds.ema(frame_table(spark, []), ["e"], ["i"], "v", 0.3).count() == 0


@given(st.lists(st.floats(-100, 100), min_size=1), st.floats(0.1, 10))
@settings(deadline=None, max_examples=50)
def test_slew_bound(targets, limit):
    step = folds.slew(limit)()
    out = [step(t) for t in targets]
    assert out[0] == targets[0]
    assert all(abs(b - a) <= limit * (1 + 1e-9) for a, b in zip(out, out[1:]))


@given(st.lists(st.floats(-100, 100), min_size=1), st.floats(0, 1))
@settings(deadline=None, max_examples=50)
def test_ema_hull(values, alpha):
    step = folds.smooth(alpha)()
    assert all(min(*values, 0) - 1e-9 <= step(v) <= max(*values, 0) + 1e-9 for v in values)


def test_stalls_fire_every_third_hit(spark):
    rows = [(1, i, float(i), 0.0) for i in range(9)]
    found = series.stalls(spark.createDataFrame(rows, "e int, i int, t double, a double"), ["e"], ["i"], "t", "a").orderBy("i").collect()
    assert [r["i"] for r in found if r["fired"]] == [3, 6]


def test_hysteresis_is_strict(spark):
    rows = [(1, i, v) for i, v in enumerate((0.3, 0.31, 0.0, -0.3, -0.31))]
    found = series.hysteresis(frame_table(spark, rows), ["e"], ["i"], "v", 0.3, False).orderBy("i").collect()
    assert [r["open"] for r in found] == [False, True, True, True, False]


def test_ramps(spark):
    df = spark.createDataFrame([(0.0, 1.0)], "a double, b double")
    assert series.ramp(df, "a", "b", series.ramp_steps(F.lit(2.0), F.lit(50))).count() == 100
    assert series.ramp(df, "a", "b", series.ramp_steps(F.lit(0.0), F.lit(50))).first()["value"] == 1.0
    with pytest.raises(ValueError):
        series.head(df, ["a"], ["b"], -1)


def test_staleness_bounds(spark):
    ms = [0, 149, 300, 1301, 1451]
    rows = spark.createDataFrame([(1, m) for m in ms], "k int, m long").withColumn("r", F.timestamp_millis("m"))
    found = series.staleness(rows, ["k"], "r").orderBy("m").collect()
    assert [r["state"] for r in found] == ["track", "track", "hold", "halt", "track"]
    assert [r["gap_ms"] for r in found][1:] == [149, 151, 1001, 150]


def test_staleness_of_equal_times(spark):
    rows = spark.createDataFrame([(1, s, m) for s, m in ((1, 0), (2, 500), (3, 500))], "k int, seq int, m long").withColumn("r", F.timestamp_millis("m"))
    found = {r["seq"]: r["state"] for r in series.staleness(rows, ["k"], "r", order=["seq"]).collect()}
    assert found == {1: "track", 2: "hold", 3: "track"}
    found = {r["seq"]: r["state"] for r in series.staleness(rows, ["k"], "r", order=["seq"]).repartition(5).collect()}
    assert found == {1: "track", 2: "hold", 3: "track"}


def test_timed_slew_by_the_last_command(spark):
    """A null target sends nothing; a stale gap leaves the shortest step; a long one ends the run; grippers have a speed of their own."""
    rows = [("LJ1.pos", 0, 0.0, 0.0), ("LJ1.pos", 1, 1.0, None), ("LJ1.pos", 2, 3.0, 9.0), ("LJ1.pos", 3, 9.0, 9.0), ("LJ1.pos", 4, 9.5, 9.0), ("LJ1.pos", 5, 99.0, 9.0), ("LJ1.pos", 6, 99.1, 0.0), ("LJ8.pos", 0, 0.0, 0.0), ("LJ8.pos", 1, 1.0, 9.0)]
    df = spark.createDataFrame(rows, "channel string, i int, t double, v double")
    found = folds.slew_limit_timed(df, ["channel"], ["i"], "v", "t", 1.0, 0.1, stale=5.0, timeout=50.0, gripper_speed=4.0)
    got = {(r["channel"], r["i"]): r["commanded"] for r in found.collect()}
    assert [got["LJ1.pos", i] for i in range(7)] == pytest.approx([0.0, 0.0, 3.0, 3.1, 3.6, 3.6, 3.6]) and got["LJ8.pos", 1] == 4.0
    both = folds.slew_limit(df.filter("v IS NOT NULL"), ["channel"], ["i"], "v", 1.0, gripper_limit=2.0)
    assert {(r["channel"], r["i"]): r["commanded"] for r in both.collect()}["LJ8.pos", 1] == 2.0


CALIBRATION = ([("left", 1, 1, 0.5), ("left", 2, -1, 0.0)], [("left", -1.0, 0.0)])


def calibrated(spark, joints=CALIBRATION[0], grippers=CALIBRATION[1]):
    return (
        spark.createDataFrame(joints, "side string, joint int, sign int, offset_rad double"),
        spark.createDataFrame(grippers, "side string, open_raw double, closed_raw double"),
    )


def test_calibration_round_trip(spark):
    frames = spark.createDataFrame([("left", 1, 0.25), ("left", 2, 0.5), ("left", 8, 0.022)], "side string, joint int, value double")
    there = calibration.to_robot(frames, *calibrated(spark)).orderBy("joint")
    assert [r["robot_value"] for r in there.collect()] == pytest.approx([0.75, -0.5, -0.5])
    back = calibration.from_robot(there.select("side", "joint", F.col("robot_value").alias("value")), *calibrated(spark)).orderBy("joint", "finger")
    assert [(r["joint"], r["finger"], r["sim_value"]) for r in back.collect()] == [(1, None, 0.25), (2, None, 0.5), (8, 1, 0.022), (8, 2, 0.022)]


def test_missing_calibration_is_an_error(spark):
    frames = spark.createDataFrame([("left", 3, 0.25)], "side string, joint int, value double")
    with pytest.raises(Exception, match="no calibration"):
        calibration.to_robot(frames, *calibrated(spark)).collect()
    with pytest.raises(ValueError, match="left sign"):
        calibration.require_valid(*calibrated(spark, [("left", 1, None, 0.0)]))
    with pytest.raises(ValueError, match="left gripper"):
        calibration.require_valid(*calibrated(spark, grippers=[("left", 1.0, 1.0)]))
    calibration.require_valid(*calibrated(spark))


def test_left_with_hold(spark):
    frames = spark.createDataFrame([(1, s, "left", 1, 0.0) for s in range(3)], "episode int, step int, side string, joint int, value double")
    held = spark.createDataFrame([("right", 1, 9.0)], "side string, joint int, value double")
    found = calibration.left_with_hold(frames, *calibrated(spark), held).groupBy("side").agg(F.count("*"), F.max("value")).orderBy("side").collect()
    assert [tuple(r) for r in found] == [("left", 3, 0.5), ("right", 3, 9.0)]


def test_too_many_held_values(spark):
    frames = spark.createDataFrame([(1, 0, "left", 1, 0.0)], "episode int, step int, side string, joint int, value double")
    held = spark.createDataFrame([("right", k, 9.0) for k in range(11)], "side string, joint int, value double")
    with pytest.raises(ValueError, match="more than 8"):
        calibration.left_with_hold(frames, *calibrated(spark), held)


def test_joint_tree_takes_any_root(spark):
    joints = spark.createDataFrame([("a", "it's", "l1"), ("b", "l1", "l2")], "name string, parent string, child string")
    assert {(r["joint"], r["depth"]) for r in kinematics.joint_tree(spark, joints, "it's").collect()} == {("a", 1), ("b", 2)}


def test_handshake_ties_and_edge(spark):
    rows = [(1, 0, "a", 1.0, 0.0), (1, 1, "b", 2.0, 1.0), (2, 0, "a", 1.5, 0.0)]
    df = spark.createDataFrame(rows, "k int, ord int, channel string, target double, actual double")
    found = summaries.handshake(df, ["k"], "ord", F.lit(1.0)).orderBy("k").collect()
    assert [(r["channel"], r["passed"]) for r in found] == [("a", True), ("a", False)]


def test_paired(spark):
    target = spark.createDataFrame([(1, "a", 1.0), (1, "b", 2.0)], "k int, channel string, value double")
    actual = spark.createDataFrame([(1, "a", 0.5)], "k int, channel string, value double")
    assert summaries.paired(target, actual, ["k"], strict=False).count() == 1
    with pytest.raises(Exception, match="no actual value for b"):
        summaries.paired(target, actual, ["k"]).collect()


def test_can_answers(spark):
    df = spark.createDataFrame([(0x80000011, 3), (0x11, 2), (0x12, 8)], "can_id long, dlc int")
    assert filters.answers(df, [0x11]).count() == 1
    assert filters.column_state(df, "x") == "missing" and filters.column_state(df, "dlc") == "ok"


JOINTS = [
    ("a", "revolute", "l0", "l1", None, [0.0, 0.0, 0.1], [0.0, 0.0, 1.0]),
    ("f", "fixed", "l1", "l2", [0.1, 0.2, 0.3], [0.2, 0.0, 0.0], None),
    ("b", "revolute", "l2", "l3", None, [0.0, 0.1, 0.3], [0.0, 1.0, 0.0]),
    ("c", "revolute", "l3", "l4", [0.0, 0.5, 0.0], [0.3, 0.0, 0.0], [1.0, 0.0, 0.0]),
]
SCHEMA = "name string, type string, parent string, child string, rpy array<double>, xyz array<double>, axis array<double>"


def chain(spark):
    return kinematics.Chain.from_joints(spark.createDataFrame(JOINTS, SCHEMA), "l0", "l4")


def test_jacobian_by_differences(spark):
    c, q, h = chain(spark), np.array([[0.3, -0.4, 0.5]]), 1e-6
    jacobian = c.jacobian(q)[0]
    for k in range(3):
        step = np.zeros((1, 3))
        step[0, k] = h
        up, down = c.poses(q + step)[0][0], c.poses(q - step)[0][0]
        assert jacobian[:3, k] == pytest.approx((up[:3, 3] - down[:3, 3]) / (2 * h), abs=1e-6)
        turn = (up[:3, :3] - down[:3, :3]) / (2 * h) @ c.poses(q)[0][0][:3, :3].T
        assert jacobian[3:, k] == pytest.approx([turn[2, 1], turn[0, 2], turn[1, 0]], abs=1e-6)


def test_gravity_by_differences(spark):
    c, q, h = chain(spark), np.array([[0.3, -0.4, 0.5]]), 1e-6
    c.masses, c.centres = np.array([1.0, 0.5, 2.0, 0.7]), np.array([[0.1, 0, 0], [0, 0.1, 0], [0, 0, 0.2], [0.1, 0.1, 0]])

    def energy(q):
        total = 0.0
        for k in range(4):
            part = kinematics.Chain(c.names[: k + 1], c.before[: k + 1], c.axes[: k + 1], c.moving[: k + 1])
            tip = part.poses(q[:, : part.moving.sum()])[0][0] if part.moving.any() else None
            total += c.masses[k] * kinematics.GRAVITY * (tip[:3, 3] + tip[:3, :3] @ c.centres[k])[2]
        return total

    for k in range(3):
        step = np.zeros((1, 3))
        step[0, k] = h
        assert c.gravity(q)[0, k] == pytest.approx((energy(q + step) - energy(q - step)) / (2 * h), abs=1e-5)


def test_gravity_torques(spark):
    c = chain(spark)
    df = spark.createDataFrame([(1, [0.3, -0.4, 0.5])], "k int, q array<double>")
    with pytest.raises(Exception, match="no masses"):
        kinematics.gravity_torques(df, c).collect()
    c.masses, c.centres = np.array([1.0, 0.5, 2.0, 0.7]), np.zeros((4, 3))
    assert kinematics.gravity_torques(df, c).first()["tau"] == pytest.approx(c.gravity(np.array([[0.3, -0.4, 0.5]]))[0].tolist())


def test_ik_step_moves_the_tip(spark):
    c = chain(spark)
    df = spark.createDataFrame([([0.3, -0.4, 0.5], [0.001, 0.0, 0.0, 0.0, 0.0, 0.0])], "q array<double>, delta array<double>")
    q = np.array([kinematics.ik_step(df, c, damping=1e-4).first()["q_next"]])
    want, _ = np.linalg.lstsq(c.jacobian(np.array([[0.3, -0.4, 0.5]]))[0], np.array([0.001, 0, 0, 0, 0, 0]), rcond=None)[:2]
    assert q[0] - [0.3, -0.4, 0.5] == pytest.approx(want, abs=1e-6)
    with pytest.raises(KeyError):
        kinematics.Chain.from_joints(spark.createDataFrame(JOINTS, SCHEMA), "l0", "nowhere")
