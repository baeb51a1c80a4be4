"""Versioned datasets, captures cut anywhere, and the episode buffer."""

import glob
import json
import os
import random
import struct

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from gantry.sources import capture, dataset, robot
from gantry.streaming import buffer

SCHEMA = "episode_index long, frame_index long, v double, task string"


def frames(spark, episodes, n=40, v=1.0, task="old"):
    return spark.createDataFrame([(e, k, v, task if e != 3 else "other") for e in episodes for k in range(n)], SCHEMA)


def counted(df):
    return {r["episode_index"]: r["count"] for r in df.groupBy("episode_index").count().collect()}


def data_files(root):
    return set(glob.glob(f"{root}/data/*/*.parquet"))


def test_versions(spark, tmp_path):
    root = str(tmp_path / "d")
    dataset.write(frames(spark, range(4)), root)
    first = dataset.Dataset(root).version()
    dataset.write(frames(spark, [4, 5], v=2.0), root)
    assert counted(dataset.read(spark, root)) == dict.fromkeys(range(6), 40)
    assert counted(dataset.read(spark, root, version=1)) == dict.fromkeys(range(4), 40)
    dataset.write(frames(spark, [1, 4], n=10, v=9.0), root, mode="replace")
    found = dataset.read(spark, root)
    assert counted(found) == {0: 40, 1: 10, 2: 40, 3: 40, 4: 10, 5: 40}
    assert {r["episode_index"] for r in found.filter("v = 9").collect()} == {1, 4}
    assert dataset.Dataset(root).numbers() == [1, 2, 3] and dataset.Dataset(root).version(1) == first
    dataset.write(frames(spark, [8]), root, mode="overwrite")
    assert counted(dataset.read(spark, root)) == {8: 40}
    assert dataset.read(spark, root, columns=["task", "episode_index"]).columns == ["task", "episode_index"]
    dataset.write(frames(spark, [8]).limit(0), root)
    assert counted(dataset.read(spark, root)) == {8: 40}
    with pytest.raises(PySparkException, match="columns"):
        dataset.write(frames(spark, [9]).withColumn("more", F.lit(1)), root)
    with pytest.raises(PySparkException, match="give a schema"):
        dataset.read(spark, str(tmp_path / "none")).collect()


def test_a_task_that_dies_leaves_the_dataset_as_it_was(spark, tmp_path):
    root = str(tmp_path / "d")
    dataset.write(frames(spark, range(3)), root)
    before = data_files(root), dataset.Dataset(root).numbers()
    for how in (F.raise_error(F.lit("dead")).cast("double"), None):
        bad = frames(spark, range(20, 60), n=5)
        if how is None:
            bad = bad.mapInArrow(lambda batches: (b if b.column(0)[0].as_py() < 40 else os._exit(1) for b in batches), SCHEMA)  # the worker itself dies
        else:
            bad = bad.withColumn("v", F.when(F.col("episode_index") > 50, how).otherwise(F.col("v")))
        with pytest.raises(Exception, match="dead|exited"):
            bad.write.format("episodes").option("path", root).mode("append").save()
        assert (data_files(root), dataset.Dataset(root).numbers()) == before
        assert counted(dataset.read(spark, root)) == dict.fromkeys(range(3), 40)


def test_only_chosen_files_are_opened(spark, tmp_path):
    """Files that hold none of the episodes are gone from disk, and nobody notices."""
    root = str(tmp_path / "d")
    for k in range(6):
        dataset.write(frames(spark, range(10 * k, 10 * k + 10)).coalesce(1), root)
    files = dataset.Dataset(root).version().files
    assert len(files) == 6
    for f in files:
        if f["groups"][0][0] != 20:
            os.unlink(f"{root}/{f['path']}")
    assert counted(dataset.read(spark, root, episodes=[23, 27])) == {23: 40, 27: 40}
    for condition in ("episode_index = 25", "episode_index > 24 AND episode_index <= 25", "episode_index IN (25)", "25 = episode_index AND v > 0"):
        assert counted(dataset.read(spark, root).filter(condition)) == {25: 40}, condition
    assert counted(dataset.read(spark, root).filter("episode_index = 99")) == {}
    with pytest.raises(PySparkException):
        dataset.read(spark, root).count()
    reader = dataset.Episodes({"path": root}).reader(dataset.Episodes({"path": root}).schema())
    assert len(reader.partitions()) == 6
    list(reader.pushFilters([dataset.In(("episode_index",), (3, 45)), dataset.GreaterThan(("v",), 99)]))
    assert len(reader.partitions()) == 2


def test_row_groups_are_chosen(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(dataset, "GROUP_ROWS", 40)
    staging = dataset.Staging(str(tmp_path / "d"), frames(spark, []).schema, {})
    table = frames(spark, range(8)).orderBy("episode_index", "frame_index").coalesce(1).toArrow()
    staging.publish([staging.stage(iter(table.combine_chunks().to_batches()))])
    (file,) = dataset.Dataset(str(tmp_path / "d")).version().files
    assert [g[:2] for g in file["groups"]] == [[e, e] for e in range(8)]
    reader = dataset.Episodes({"path": str(tmp_path / "d"), "groups": "1"}).reader(frames(spark, []).schema)
    list(reader.pushFilters([dataset.GreaterThanOrEqual(("episode_index",), 6)]))
    assert [p.groups for p in reader.partitions()] == [[6], [7]]
    assert sum(b.num_rows for p in reader.partitions() for b in reader.read(p)) == 80


def test_long_episode_in_many_files_and_odd_rows(spark, tmp_path):
    root = str(tmp_path / "d")
    rows = frames(spark, [1], n=5000).unionByName(spark.createDataFrame([(None, 0, 1.0, None), (2, None, None, "x"), (2, None, None, "x")], SCHEMA))
    dataset.write(rows, root)
    assert counted(dataset.read(spark, root)) == {1: 5000, None: 1, 2: 2}
    assert dataset.read(spark, root).filter("episode_index IS NULL").count() == 1
    assert dataset.read(spark, root).filter("episode_index <=> 2").count() == 2
    dataset.write(frames(spark, [1], n=3), root, mode="replace")
    assert counted(dataset.read(spark, root)) == {1: 3, None: 1, 2: 2}


def test_values_are_replaced_in_place(spark, tmp_path):
    root = str(tmp_path / "d")
    dataset.write(frames(spark, range(3)).coalesce(1), root)
    dataset.write(frames(spark, [3]).coalesce(1), root)
    untouched = {f["path"] for f in dataset.Dataset(root).version().files if f["groups"][0][0] == 3}
    during = dataset.read(spark, root)  # planned before, read after
    assert dataset.replace_value(spark, root, "task", "old", "new") == 1
    assert {r["task"] for r in dataset.read(spark, root).collect()} == {"new", "other"}
    assert {r["task"] for r in dataset.read(spark, root, version=2).collect()} == {"old", "other"}
    assert {r["task"] for r in during.collect()} in ({"old", "other"}, {"new", "other"})
    assert untouched <= {f["path"] for f in dataset.Dataset(root).version().files}
    assert dataset.replace_value(spark, root, "task", "absent", "new") == 0 and dataset.Dataset(root).numbers() == [1, 2, 3]
    with pytest.raises(KeyError, match="none"):
        dataset.replace_value(spark, root, "none", "a", "b")
    assert dataset.replace_value(spark, str(tmp_path / "none"), "task", "a", "b") == 0


def test_two_writers(spark, tmp_path):
    """Appends find their turn; replacements planned on an old version are refused and leave nothing."""
    root, schema = str(tmp_path / "d"), frames(spark, []).schema
    dataset.write(frames(spark, range(2)), root)
    batches = lambda e: iter(frames(spark, [e]).toArrow().combine_chunks().to_batches())
    one, two = (dataset.Staging(root, schema, {}) for _ in range(2))
    staged = one.stage(batches(5)), two.stage(batches(6))
    two.publish([staged[1]])
    one.publish([staged[0]])
    assert counted(dataset.read(spark, root)) == {0: 40, 1: 40, 5: 40, 6: 40}
    late = dataset.Staging(root, schema, {"mode": "replace"})
    message = late.stage(batches(0))
    dataset.write(frames(spark, [7]), root)
    files = data_files(root)
    with pytest.raises(dataset.Conflict, match="planned on version"):
        late.publish([message])
    assert data_files(root) < files and counted(dataset.read(spark, root)) == {0: 40, 1: 40, 5: 40, 6: 40, 7: 40}
    taken = dataset.Dataset(root)
    with pytest.raises(dataset.Conflict, match="by another"):
        taken.publish(taken.version())
    assert not [f for f in os.listdir(f"{root}/manifests") if f.startswith(".")]


def test_repeated_batches_of_a_stream(spark, tmp_path):
    root, schema = str(tmp_path / "d"), frames(spark, []).schema
    for number in (0, 1, 1, 0, 2):
        writer = dataset.StreamWriter(dataset.Staging(root, schema, {"query": "q"}))
        writer.commit([writer.write(iter(frames(spark, [number]).toArrow().combine_chunks().to_batches()))], number)
    assert counted(dataset.read(spark, root)) == {0: 40, 1: 40, 2: 40}
    writer = dataset.StreamWriter(dataset.Staging(root, schema, {"query": "q"}))
    before = data_files(root)
    writer.abort([writer.write(iter(frames(spark, [9]).toArrow().combine_chunks().to_batches())), None], 3)
    assert data_files(root) == before


def feed(folder, name, rows):
    with open(folder / f"{name}.tmp", "w") as file:
        file.writelines(json.dumps(dict(zip(("recorder", "seq", "kind", "payload"), r, strict=True))) + "\n" for r in rows)
    os.utime(folder / f"{name}.tmp", (1e9 + int(name), 1e9 + int(name)))  # files are taken in order of time
    os.rename(folder / f"{name}.tmp", folder / f"{name}.json")


def recorded(spark, folder, root, checkpoint, **options):
    events = spark.readStream.schema("recorder string, seq long, kind string, payload string").option("maxFilesPerTrigger", 1).json(str(folder))
    query = dataset.write_stream(buffer.buffered(events, **options), root, checkpoint, "recorder").trigger(availableNow=True).start()
    query.awaitTermination(300)


def test_buffer_in_a_stream(spark, tmp_path):
    """Frames of saved episodes arrive once, over batches and a restart; those of discarded ones never."""
    folder, root, checkpoint = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "c")
    folder.mkdir()
    feed(folder, "0", [("a", 1, "frame", "a0"), ("a", 2, "frame", "a1"), ("b", 1, "frame", "b-bad"), ("b", 2, "discard", None), ("c", 1, "save", None)])
    feed(folder, "1", [("a", 4, "save", None), ("a", 3, "frame", "a2"), ("a", 5, "frame", "a-bad"), ("b", 3, "frame", "b0"), ("a", 1, "frame", "a0"), (None, None, "frame", "x")])
    recorded(spark, folder, root, checkpoint)
    feed(folder, "2", [("a", 6, "discard", None), ("a", 7, "frame", "a3"), ("b", 4, "save", None), ("a", 8, "pause", None), ("c", 2, "frame", "c-never")])
    recorded(spark, folder, root, checkpoint)  # a new query on the checkpoint
    feed(folder, "3", [("a", 9, "save", None), ("b", 5, "save", None), ("a", 10, "save", None)])
    recorded(spark, folder, root, checkpoint)
    found = sorted(tuple(r) for r in dataset.read(spark, root).collect())
    assert found == [("a", 0, 0, 1, "a0"), ("a", 0, 1, 2, "a1"), ("a", 0, 2, 3, "a2"), ("a", 1, 0, 7, "a3"), ("b", 0, 0, 3, "b0")]


def test_restart_after_a_lost_commit(spark, tmp_path):
    """The sink has a batch that the checkpoint does not know of: it is run again, and dropped."""
    folder, root, checkpoint = tmp_path / "in", str(tmp_path / "out"), tmp_path / "c"
    folder.mkdir()
    feed(folder, "0", [("a", k, "frame", f"f{k}") for k in range(5)])
    feed(folder, "1", [("a", 5, "save", None), ("b", 0, "frame", "g0"), ("b", 1, "save", None)])
    recorded(spark, folder, root, str(checkpoint))
    want = sorted(tuple(r) for r in dataset.read(spark, root).collect())
    versions = dataset.Dataset(root).numbers()
    last = max(int(p) for p in os.listdir(checkpoint / "commits") if p.isdigit())
    os.unlink(checkpoint / "commits" / str(last))
    for crc in glob.glob(f"{checkpoint}/commits/.{last}.crc"):
        os.unlink(crc)
    recorded(spark, folder, root, str(checkpoint))
    assert sorted(tuple(r) for r in dataset.read(spark, root).collect()) == want and len(want) == 6
    assert dataset.Dataset(root).numbers() == versions


class Store:
    """A handle whose states are Python values."""

    def __init__(self):
        self.list, self.value, self.timers = [], None, []

    def getListState(self, *_, **__):
        store = self

        class ListState:
            exists = lambda self: bool(store.list)
            get = lambda self: iter(list(store.list))
            appendList = lambda self, rows: store.list.extend(rows)
            clear = lambda self: store.list.clear()

        return ListState()

    def getValueState(self, *_, **__):
        store = self

        class ValueState:
            exists = lambda self: store.value is not None
            get = lambda self: store.value
            update = lambda self, v: setattr(store, "value", v)

        return ValueState()

    listTimers = lambda self: list(self.timers)
    registerTimer = lambda self, t: self.timers.append(t)
    deleteTimer = lambda self, t: self.timers.remove(t)


def plain_buffer(rows):
    out, held, episode, seen = [], [], 0, None
    for seq, kind, payload in rows:
        if seen is not None and seq <= seen:
            continue
        seen = seq
        if kind == "frame":
            held.append((seq, payload))
        elif kind == "save" and held:
            out += [(episode, k, s, p) for k, (s, p) in enumerate(held)]
            held, episode = [], episode + 1
        elif kind == "discard":
            held = []
    return out


@pytest.mark.parametrize("seed", range(4))
def test_buffer_against_plain_python(seed, monkeypatch):
    import types

    import pandas as pd

    monkeypatch.setattr(buffer, "BLOCK_FRAMES", 3)
    r = random.Random(seed)
    rows = [(k, r.choices(["frame", "save", "discard", "?"], [8, 1, 1, 1])[0], f"p{k}") for k in range(200)]
    processor, store, found, clock = buffer.EpisodeBuffer(1000), Store(), [], types.SimpleNamespace(getCurrentProcessingTimeInMs=lambda: 5)
    processor.init(store)
    at = 0
    while at < len(rows):
        step = r.randrange(1, 30)
        part = rows[max(0, at - r.randrange(4)) : at + step]  # some of the batch before once more
        batch = [pd.DataFrame(part[:1], columns=["seq", "kind", "payload"]), pd.DataFrame(part[1:], columns=["seq", "kind", "payload"])]
        found += [tuple(x)[1:] for b in processor.handleInputRows(("a",), iter(batch), clock) for x in b.itertuples(index=False)]
        assert len(store.timers) == bool(store.list)
        at += step
    assert found == plain_buffer(rows)
    store.list.append((0, "x"))
    assert list(processor.handleExpiredTimer(("a",), clock, None)) == [] and not store.list


def test_buffer_calls_do_not_follow_episodes():
    """Calls to the state and tables handed on stay few, however many episodes a recorder's batch has."""
    import pandas as pd

    calls, store = [], Store()

    class Counted:
        def __init__(self, state):
            self.state = state

        def __getattr__(self, name):
            calls.append(name)
            return getattr(self.state, name)

    lists, values = store.getListState, store.getValueState
    store.getListState, store.getValueState = lambda *a: Counted(lists(*a)), lambda *a: Counted(values(*a))
    processor = buffer.EpisodeBuffer()
    processor.init(store)
    rows = [(k, ("frame", "frame", "save", "frame", "discard")[k % 5], f"p{k}") for k in range(501)]
    found = []
    for part in (rows[:251], rows[251:]):  # the first frame of the second part's first episode is in the store
        calls.clear()
        tables = list(processor.handleInputRows(("a",), iter([pd.DataFrame(part, columns=["seq", "kind", "payload"])]), None))
        assert len(tables) == 1 and len(calls) <= 6, calls
        found += [tuple(x)[1:] for x in tables[0].itertuples(index=False)]
    assert found == plain_buffer(rows) and len(found) == 200


def bus(seed, n):
    """Frames of both kinds, with lengths and contents that look like frames themselves; damage between some."""
    r = random.Random(seed)
    content, want = b"", []
    for k in range(n):
        if r.random() < 0.05:  # damage: eight bytes whose length is impossible
            content += struct.pack("<IB3x", r.getrandbits(32), r.randrange(65, 256))
            continue
        fd = r.random() < 0.4
        size = r.choice((8, 64, 3, 0)) if fd else r.randrange(9)
        size = min(size, 64 if fd else 8)
        data = bytes(r.choice((0, 0, 4, 8, 255)) for _ in range(64 if fd else 8))
        frame = struct.pack("<IBBBB", r.getrandbits(29) | 0x80000000, size, 0x04 if fd else 0, 0, 0) + data
        want.append((len(content), frame))
        content += frame
    return content, want


@pytest.mark.parametrize("range_bytes", [72, 80, 200, 1000, 1 << 20])
def test_capture_cut_anywhere(spark, tmp_path, range_bytes):
    content, want = bus(range_bytes, 400)
    path = tmp_path / "bus.bin"
    path.write_bytes(content + content[:0] + struct.pack("<IBBBB", 1, 64, 4, 0, 0) + b"cut off")
    found = capture.read_capture(spark, str(path), range_bytes)
    assert sorted((r["at"], bytes(r["raw"])) for r in found.collect()) == want
    split = robot.split_frames(found).collect()
    assert len(split) == len(want) and all(len(r["data"]) <= 64 for r in split)


def test_capture_edge_cases(spark, tmp_path):
    path = tmp_path / "bus.bin"
    path.write_bytes(b"")
    assert capture.read_capture(spark, str(path)).collect() == []
    path.write_bytes(struct.pack("<IBBBB8s", 7, 2, 0, 0, 0, b"ab"))
    (row,) = robot.split_frames(capture.read_capture(spark, str(path), 72)).collect()
    assert (row["can_id"], bytes(row["data"])) == (7, b"ab")
    with pytest.raises(PySparkException, match="none.bin"):
        capture.read_capture(spark, str(tmp_path / "none.bin"))
    zeros = np.zeros(16 * 1000, np.uint8)  # every place looks like a frame
    path.write_bytes(zeros.tobytes())
    assert capture.read_capture(spark, str(path), 88).count() == 1000
