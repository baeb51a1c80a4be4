import json
import os
import socket
import sys
import time
import types

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gantry.operators import calibration, kinematics
from gantry.sources import datagrams, dataset, episodes, robot
from gantry.streaming import mirror

URDF = """<robot name="r"><link name="l0"/>
  <link name="l1"><inertial><origin xyz="0.5 0 -0.25"/><mass value="2.5"/></inertial></link><link name="l2"/>
  <joint name="a" type="revolute"><origin rpy="0 0 0" xyz="0.25 0.0 0.75"/><parent link="l0"/><child link="l1"/>
    <axis xyz="0 0 1"/><limit effort="11" lower="-0.7" upper="2.2" velocity="5.5"/></joint>
  <joint name="b" type="prismatic"><origin rpy="0 0.5 0" xyz="1 0 0"/><parent link="l1"/><child link="l2"/><mimic joint="a"/></joint>
  <!-- <joint name="c" type="fixed"><parent link="l2"/><child link="l3"/></joint> -->
</robot>"""


def test_urdf(spark, tmp_path):
    path = tmp_path / "r.urdf"
    path.write_text(URDF)
    joints = robot.read_joints(spark, str(path))
    a, b = joints.orderBy("name").collect()
    assert (a["lower"], a["upper"], a["xyz"], a["parent"], b["mimic"], b["rpy"]) == (-0.7, 2.2, [0.25, 0.0, 0.75], "l0", "a", [0.0, 0.5, 0.0])
    with pytest.raises(KeyError, match="c"):
        robot.require_joints(joints, ["a", "c"])
    links = robot.read_links(spark, str(path))
    assert {r["name"]: (r["mass"], r["centre"]) for r in links.collect()} == {"l0": (None, None), "l1": (2.5, [0.5, 0.0, -0.25]), "l2": (None, None)}
    chain = kinematics.Chain.from_joints(joints, "l0", "l2", links)
    assert chain.masses.tolist() == [2.5, 0.0] and chain.centres.tolist() == [[0.5, 0.0, -0.25], [0.0, 0.0, 0.0]]
    assert chain.gravity(np.array([[0.3]]))[0] == pytest.approx([0.0])  # about an upright axis


def write(path, content):
    path.write_text(json.dumps(content))
    return str(path)


def side(**changes):
    return {"sign": {"_comment": "x"} | {f"joint{k}": 1 for k in range(1, 8)}, "gripper": {"open_raw": -1.0, "closed_raw": 0.0}} | changes


def test_calibration_files(spark, tmp_path):
    joints, grippers = robot.read_calibration(spark, write(tmp_path / "a.json", {"_comment": "x", "left": side(), "right": side()}))
    calibration.require_valid(joints, grippers)
    assert joints.count() == 14 and joints.agg(F.sum("offset_rad")).first()[0] == 0.0
    partial = side(offset_rad={"joint1": 0.1})
    joints, grippers = robot.read_calibration(spark, write(tmp_path / "b.json", {"left": partial, "right": side(sign={"joint1": None})}))
    with pytest.raises(ValueError, match="left offset_rad.*right sign"):
        calibration.require_valid(joints, grippers)


def test_defective_calibration_files(spark, tmp_path):
    """A side that is absent, and numbers in quotes, are found."""
    with pytest.raises(ValueError, match="right gripper, right sign"):
        calibration.require_valid(*robot.read_calibration(spark, write(tmp_path / "c.json", {"left": side()})))
    quoted = side(sign={f"joint{k}": "1" for k in range(1, 8)})
    with pytest.raises(ValueError, match="left sign"):
        calibration.require_valid(*robot.read_calibration(spark, write(tmp_path / "d.json", {"left": quoted, "right": side()})))


def test_can_capture(spark):
    classic = bytes([0x11, 0, 0, 0, 3, 0, 0, 0]) + bytes([0x21, 0x00, 0x55, 0, 0, 0, 0, 0])
    rows = spark.createDataFrame([(bytearray(classic),), (bytearray(b"short"),)], "raw binary")
    (found,) = robot.decode_can(robot.split_frames(rows)).collect()
    assert (found["can_id"], found["dlc"], found["motor"], found["error"], found["code"]) == (0x11, 3, 1, 2, 85)
    assert found["position"] == pytest.approx(-12.467574578)


def test_episode_commit_replaces_only_its_episodes(spark, tmp_path):
    root = str(tmp_path / "d")
    rows = lambda e, v: spark.createDataFrame([(e, 0, v)], "episode_index int, frame_index int, v int")
    episodes.commit_episodes(rows(1, 1).union(rows(2, 2)), root)
    episodes.commit_episodes(rows(2, 9), root)
    assert {(r["episode_index"], r["v"]) for r in episodes.read_episodes(spark, root).collect()} == {(1, 1), (2, 9)}
    assert episodes.read_episodes(spark, root, [2]).count() == 1
    left = episodes.without_discarded(episodes.read_episodes(spark, root), spark.createDataFrame([(1,)], "episode_index int"))
    assert [r["v"] for r in left.collect()] == [9]


def test_files_follow_rows_not_episodes(spark, tmp_path):
    """Many short episodes lie in few files, also once some are committed anew, and batches of a stream."""
    root = str(tmp_path / "d")
    rows = spark.range(0, 2000, 1, 4).select((F.col("id") % 400).cast("int").alias("episode_index"), F.col("id").alias("step"), F.lit(1).alias("v"))
    episodes.commit_episodes(rows, root)
    episodes.commit_episodes(rows.filter("episode_index % 4 = 0").withColumn("v", F.lit(9)), root)
    found = episodes.read_episodes(spark, root).groupBy("episode_index").agg(F.count("*"), F.min("v"), F.max("v")).collect()
    assert {tuple(r) for r in found} == {(e, 5, v, v) for e in range(400) for v in [1 if e % 4 else 9]}
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    episodes.commit_stream(stream, str(tmp_path / "s"), str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert episodes.read_episodes(spark, str(tmp_path / "s"), [3, 399]).count() == 10
    for folder in ("d", "s"):
        assert len(list((tmp_path / folder).rglob("*.parquet"))) <= 16


def test_null_episodes_are_replaced_as_one(spark, tmp_path):
    root, schema = str(tmp_path / "d"), "episode_index int, frame_index int, v int"
    episodes.commit_episodes(spark.createDataFrame([(None, 0, 1), (None, 1, 1), (1, 0, 1)], schema), root)
    episodes.commit_episodes(spark.createDataFrame([(None, 0, 9), (2, 0, 9)], schema), root)
    assert {tuple(r) for r in episodes.read_episodes(spark, root).collect()} == {(None, 0, 9), (1, 0, 1), (2, 0, 9)}


def test_batch_of_a_stream_run_again_adds_nothing(spark, tmp_path):
    root, rows = str(tmp_path / "d"), spark.createDataFrame([(1, 0, 1), (2, 0, 2)], "episode_index int, frame_index int, v int")
    for number in (0, 0, 1):
        dataset.write(rows, root, batch=("q", number))
    assert dataset.read(spark, root).count() == 4 and dataset.Dataset(root).numbers() == [1, 2]
    assert len(list((tmp_path / "d" / "data").iterdir())) == 2  # nothing is left of the one that was dropped


def test_hub_trajectory(spark, tmp_path):
    names = [f"j{k}" for k in range(7)]
    meta = {"features": {"observation.state": {"dtype": "float32", "shape": [7], "names": names}, "action": {"dtype": "float32", "shape": [2], "names": ["x", "left_gripper"]}}}
    features = episodes.feature_schema(spark, write(tmp_path / "info.json", meta))
    df = spark.createDataFrame([(1, 0, [0.5] * 7, [0.0, -1.0])], "episode_index int, frame_index int, `observation.state` array<float>, action array<float>")
    found = episodes.hub_trajectory(df, features, names).first()
    assert (found["joints"], found["gripper_cmd"]) == ([0.5] * 7, -1.0)
    with pytest.raises(ValueError):
        episodes.hub_trajectory(df, features, names[::-1])


def test_tracking_log(spark, tmp_path):
    path = str(tmp_path / "log")
    rows = [(step, step / 30, 1.0, 0.5, None) for step in (2, 0, 1)]
    episodes.write_tracking_log(spark.createDataFrame(rows, "step int, t double, `a.pos_target` double, `a.pos_commanded` double, `a.pos_actual` double"), path, ["a.pos"])
    (part,) = (tmp_path / "log").glob("part-*.csv")
    lines = part.read_text().splitlines()
    assert lines[0] == "step,t,a.pos_target,a.pos_commanded,a.pos_actual" and lines[1] == "0,0.0,1.0,0.5," and len(lines) == 4


def test_long_tracking_log(spark, tmp_path):
    """Ranges of steps are tasks of their own, and their files, in order of names, the whole log."""
    rows = spark.range(0, 3000, 1, 3).select((2999 - F.col("id")).alias("step"), F.lit(0.5).alias("t"), *(F.lit(1.0).alias(f"a_{kind}") for kind in ("target", "commanded", "actual")))
    name = "spark.sql.adaptive.coalescePartitions.enabled"  # else a log of this size is one file
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        episodes.write_tracking_log(rows, str(tmp_path / "log"), ["a"])
    finally:
        spark.conf.set(name, before)
    parts = [p.read_text().splitlines() for p in sorted((tmp_path / "log").glob("part-*.csv"))]
    assert len(parts) == 4 and max(map(len, parts)) < 1500
    assert {p[0] for p in parts} == {"step,t,a_target,a_commanded,a_actual"}
    assert [line for p in parts for line in p[1:]] == [f"{step},0.5,1.0,1.0,1.0" for step in range(3000)]


def test_tracking_log_without_steps(spark, tmp_path):
    rows = spark.createDataFrame([], "step int, t double, a_target double, a_commanded double, a_actual double")
    episodes.write_tracking_log(rows, str(tmp_path / "log"), ["a"])
    assert [p.read_text() for p in (tmp_path / "log").glob("part-*.csv")] == ["step,t,a_target,a_commanded,a_actual\n"]


def test_named_trajectory(spark, tmp_path):
    order = episodes.read_joint_order(spark, write(tmp_path / "o.json", {"joint_order": ["a", "b"]}))
    df = spark.createDataFrame([("e", 0, [1.0, 2.0])], "episode string, step int, q array<double>")
    assert episodes.named_trajectory(df, order).first()["joints"] == {"a": 1.0, "b": 2.0}
    with pytest.raises(Exception, match="same length"):
        episodes.named_trajectory(df, ["a"]).collect()


def test_hdf5_needs_its_library(spark):
    try:
        import h5py  # noqa: F401
    except ImportError:
        with pytest.raises(ImportError, match="h5py"):
            episodes.Hdf5Trajectory({"path": "x.h5"}).reader(None).partitions()


def test_hdf5_by_a_stub(monkeypatch):
    """Ranges of steps, the missing episode and blocks as Arrow batches, with arrays in place of a file."""
    steps = np.arange(2 * 5000, dtype=float).reshape(5000, 1, 2)
    key = "states/articulation/robot/joint_position"
    read = []

    class Slab:
        def __init__(self, values):
            self.values, self.shape = values, values.shape

        def __getitem__(self, where):
            read.append(where.stop - where.start)
            return self.values[where]

    data = {"demo_1": {key: Slab(steps)}, "demo_0": {key: Slab(steps[:3, 0])}, "empty": {key: Slab(steps[:0])}}

    class File(dict):
        __enter__ = lambda self: self
        __exit__ = lambda self, *_: None

    monkeypatch.setitem(sys.modules, "h5py", types.SimpleNamespace(File=lambda path, mode: File(data=data)))
    monkeypatch.setattr(episodes, "BLOCK_STEPS", 1000)
    rows = lambda reader, p: [tuple(r.values()) for b in reader.read(p) for r in b.to_pylist()]
    for split, parts in ((1 << 18, 1), (1700, 3), (1000, 5)):  # an episode whole, in three and in five
        reader = episodes.Hdf5Trajectory({"path": "x.h5", "range_steps": str(split)}).reader(None)
        found = reader.partitions()
        assert [p.episode for p in found] == ["demo_0"] + ["demo_1"] * parts
        assert rows(reader, found[0]) == [("demo_0", k, [2.0 * k, 2.0 * k + 1]) for k in range(3)]
        assert [r for p in found[1:] for r in rows(reader, p)] == [("demo_1", k, [2.0 * k, 2.0 * k + 1]) for k in range(5000)]
    assert max(read) == 1000  # no more than a block at a time
    assert [p.episode for p in episodes.Hdf5Trajectory({"path": "x.h5", "episode": "demo_1"}).reader(None).partitions()] == ["demo_1"]
    with pytest.raises(KeyError, match="demo_0, demo_1"):
        episodes.Hdf5Trajectory({"path": "x.h5", "episode": "none"}).reader(None).partitions()
    nothing = episodes.Hdf5Trajectory({"path": "x.h5", "episode": "empty"}).reader(None)
    assert [rows(nothing, p) for p in nothing.partitions()] == [[]]


def test_datagrams():
    """Packets are handed out once, again on request until they are committed, and not after that."""
    with socket.socket(socket.AF_INET, socket.SOCK_DGRAM) as free:
        free.bind(("127.0.0.1", 0))
        port = free.getsockname()[1]
    reader = datagrams.Datagrams({"port": str(port)}).simpleStreamReader(None)
    start = reader.initialOffset()
    assert list(reader.read(start)[0]) == []
    with socket.socket(socket.AF_INET, socket.SOCK_DGRAM) as sender:
        for k in range(3):
            sender.sendto(f"p{k}".encode(), ("127.0.0.1", port))
    rows, end = reader.read(start)
    assert [v for v, _ in rows] == ["p0", "p1", "p2"] and end == {"packet": 3}
    assert [v for v, _ in reader.readBetweenOffsets({"packet": 1}, end)] == ["p1", "p2"]
    reader.commit({"packet": 2})
    assert [v for v, _ in reader.read({"packet": 2})[0]] == ["p2"]
    reader.commit(end)
    assert reader.held == [] and reader.read({"packet": 7})[1] == {"packet": 7}
    reader.socket.close()


class Handle:
    """State and timers of one key, as a plain object."""

    def __init__(self):
        self.value, self.timers = None, []

    def getValueState(self, name, schema):
        return self

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def listTimers(self):
        return list(self.timers)

    def deleteTimer(self, timer):
        self.timers.remove(timer)

    def registerTimer(self, timer):
        self.timers.append(timer)


class Clock:
    def getCurrentProcessingTimeInMs(self):
        return 10_000


def driven(processor):
    processor.init(handle := Handle())

    def take(seq, received, **joints):
        rows = pd.DataFrame({"seq": [seq], "received": [received], "joints": [json.dumps({k.replace("_", "."): v for k, v in joints.items()})]})
        out = [r for df in processor.handleInputRows(("r",), iter([rows]), Clock()) for r in df.to_dict("records")]
        return (out[0]["state"], json.loads(out[0]["commanded"])) if out else None

    def expire():
        return [r["state"] for df in processor.handleExpiredTimer(("r",), Clock(), None) for r in df.to_dict("records")]

    return handle, take, expire


def test_mirror_limits_by_the_last_command():
    _, take, _ = driven(mirror.Latest(speed=1.0, gripper_speed=10.0, shortest=0.02))
    assert take(1, 100.0, LJ1_pos=0.0, LJ8_pos=0.0) == ("track", {"LJ1.pos": 0.0, "LJ8.pos": 0.0})
    assert take(2, 100.1, LJ1_pos=5.0, LJ8_pos=5.0)[1] == pytest.approx({"LJ1.pos": 0.1, "LJ8.pos": 1.0})
    # After 0.9 s the last command has been held and sent again, so only the shortest step is due.
    assert take(3, 101.0, LJ1_pos=5.0, LJ8_pos=5.0)[1] == pytest.approx({"LJ1.pos": 0.12, "LJ8.pos": 1.2})
    assert take(3, 101.1, LJ1_pos=9.0) is None


def test_mirror_timers_hold_then_halt_for_good():
    handle, take, expire = driven(mirror.Latest())
    take(1, 100.0, a=1.0)
    assert handle.timers == [10_151, 11_001]
    assert [expire(), expire(), expire()] == [["hold"], ["halt"], []]
    assert take(2, 100.1, a=2.0) is None and handle.value[3] == "halt"


def test_mirror_held_robot_takes_up_again():
    _, take, expire = driven(mirror.Latest())
    take(1, 100.0, a=1.0)
    assert expire() == ["hold"] and take(2, 100.5, a=2.0) == ("track", {"a": pytest.approx(1.02)})


def test_mirror_long_gap_halts_without_a_timer():
    _, take, _ = driven(mirror.Latest())
    take(1, 100.0, a=1.0)
    assert take(2, 101.5, a=2.0) == ("halt", {"a": 1.0}) and take(3, 101.6, a=2.0) is None


def test_feedback_sink(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text(json.dumps({"t": 1.5, "joints": {"a": 2.0}}))
    out = str(tmp_path / "sent")

    def send(strings):
        with open(out, "a") as file:
            file.writelines(s + "\n" for s in strings)

    stream = spark.readStream.schema("t double, joints map<string, double>").json(str(tmp_path / "in"))
    mirror.feedback_sink(stream, send, str(tmp_path / "checkpoint")).trigger(availableNow=True).start().awaitTermination(60)
    with open(out) as file:
        assert [json.loads(line) for line in file] == [{"t": 1.5, "joints": {"a": 2.0}}]


def packet(seq, **joints):
    return json.dumps({"seq": seq, "t": 0.0, "joints": joints})


def test_mirror_stream(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    stream = spark.readStream.schema("robot string, received double, value string").option("maxFilesPerTrigger", 1).json(str(source))
    batches = [[("r", 0.0, packet(1, a=0.0)), ("r", 0.0, "{")], [("r", 0.1, packet(2, a=9.0)), ("r", 0.2, packet(3, a=9.0))], [("r", 0.3, packet(3, a=5.0))]]
    for k, rows in enumerate(batches):
        (source / f"{k}.json").write_text("\n".join(json.dumps(dict(zip(("robot", "received", "value"), r, strict=True))) for r in rows))
        os.utime(source / f"{k}.json", (1e9 + k, 1e9 + k))  # files come in order of their times
    query = mirror.mirror(mirror.packets(stream), mirror.Latest(speed=1.0, stale_ms=10**7, timeout_ms=10**8)).writeStream.format("memory").queryName("mirrored")
    query = query.option("checkpointLocation", str(tmp_path / "c")).start()  # timers keep a query alive, so it is stopped
    try:
        for _ in range(120):
            if query.exception() or spark.table("mirrored").count() >= 2:
                break
            time.sleep(0.5)
    finally:
        query.stop()
    found = [(r["seq"], json.loads(r["commanded"])["a"]) for r in spark.table("mirrored").orderBy("seq").collect()]
    assert found == [(1, 0.0), (3, pytest.approx(0.2))]


def test_commit_stream_and_throttle(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    rows = [{"episode_index": e, "t": f"2024-01-01T00:00:0{s}.{m}00", "v": 10 * s + m} for e, s, m in ((1, 0, 1), (1, 0, 3), (1, 0, 7), (2, 1, 2), (2, 9, 0))]
    (source / "0.json").write_text("\n".join(map(json.dumps, rows)))
    stream = spark.readStream.schema("episode_index int, t timestamp, v int").json(str(source))
    episodes.commit_stream(stream, str(tmp_path / "d"), str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert episodes.read_episodes(spark, str(tmp_path / "d")).count() == 5
    out = mirror.throttled(stream, "t", ["episode_index"], "v").writeStream.format("memory").queryName("slow").outputMode("append")
    out.option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start().awaitTermination()
    assert {(r["episode_index"], r["v"]) for r in spark.table("slow").collect()} >= {(1, 3), (1, 7), (2, 12)}
