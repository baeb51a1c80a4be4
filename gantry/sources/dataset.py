"""Versioned episode datasets: data files that never change, and manifests that say which of them count.

``ROOT/data/JOB/`` holds what one write job has staged, ``ROOT/manifests/NUMBER.json`` a version: its schema, its files, and of each
file the row groups with the episodes they span.  A reader takes one manifest when its query is planned and follows only that, so
it sees a version whole while others write.  A write becomes a version by creating the next manifest, which only one writer can:

- a job that fails, or is aborted, leaves no manifest; its files are deleted;
- ``append`` is tried again upon the version that came first;
- ``replace`` (of the episodes written) and a replaced file are given up with ``Conflict`` if the version they were planned on is no longer the last;
- a stream's batch that was committed before its checkpoint was is told by its number, and dropped.

Filters on the episode column, as pushed by Spark (``spark.sql.python.filterPushdown.enabled``), choose files and row groups from the
manifest alone; other files are not opened.  Replaced episodes stay in their files and are left out by the reader.

Manifests are created exclusively by a hard link on local and mounted folders and by a rename that does not overwrite elsewhere; a store that has neither (plain object
stores) needs its writers to take turns.

Defined cases: a dataset without a version has no rows and needs a schema; an episode may lie in many files; null episodes are kept, are replaced as one, and match no
filter but IS NULL; a write without rows is a version too.
"""

from __future__ import annotations

import json
import os
import uuid
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace
from typing import Any

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamArrowWriter, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual,
    In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, WriterCommitMessage,
)
from pyspark.sql.types import StructType

from gantry.columns import named

EPISODE, STEP = "episode_index", "frame_index"
GROUP_ROWS = 1 << 16
TRIES = 20


class Conflict(RuntimeError):
    """Another writer has made a version meanwhile."""


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    if "://" not in path:
        return fs.LocalFileSystem(), os.path.abspath(path)
    return fs.FileSystem.from_uri(path)


@dataclass(frozen=True)
class Version:
    """``files``: path below the root, row groups as (least episode, largest, rows; null without one), and episodes that no longer count."""

    number: int
    schema: str | None
    files: tuple[dict, ...]
    batches: dict[str, int]

    def text(self) -> str:
        return json.dumps({"number": self.number, "schema": self.schema, "files": self.files, "batches": self.batches})


class Dataset:
    def __init__(self, root: str) -> None:
        self.fs, self.root = opened(root)

    def _manifest(self, number: int) -> str:
        return f"{self.root}/manifests/{number:020d}.json"

    def numbers(self) -> list[int]:
        found = self.fs.get_file_info(fs.FileSelector(f"{self.root}/manifests", allow_not_found=True))
        return sorted(int(i.base_name[:-5]) for i in found if i.base_name.endswith(".json") and i.base_name[:-5].isdigit())

    def version(self, number: int | None = None) -> Version:
        """The version of that number, else the last one; number 0 is empty."""
        if number is None:
            number = max(self.numbers(), default=0)
        if number == 0:
            return Version(0, None, (), {})
        with self.fs.open_input_stream(self._manifest(number)) as file:
            found = json.loads(file.read())
        return Version(found["number"], found["schema"], tuple(found["files"]), found["batches"])

    def publish(self, version: Version) -> None:
        """Create the version's manifest, if no other writer has."""
        staged, final = f"{self.root}/manifests/.{uuid.uuid4().hex}", self._manifest(version.number)
        self.fs.create_dir(f"{self.root}/manifests")
        with self.fs.open_output_stream(staged) as file:
            file.write(version.text().encode())
        try:
            if isinstance(self.fs, fs.LocalFileSystem):
                os.link(staged, final)
            else:
                if self.fs.get_file_info(final).type != fs.FileType.NotFound:
                    raise FileExistsError(final)
                self.fs.move(staged, final)
                return
        except FileExistsError as taken:
            raise Conflict(f"version {version.number} of {self.root} has been written by another") from taken
        finally:
            if self.fs.get_file_info(staged).type != fs.FileType.NotFound:
                self.fs.delete_file(staged)

    def drop_job(self, job: str) -> None:
        folder = f"{self.root}/data/{job}"
        if self.fs.get_file_info(folder).type == fs.FileType.Directory:
            self.fs.delete_dir(folder)


    def drop_strays(self, job: str, kept: set[str]) -> None:
        """Files of attempts that did not count; all of the folder where none did."""
        if not kept:
            self.drop_job(job)
        for info in self.fs.get_file_info(fs.FileSelector(f"{self.root}/data/{job}", allow_not_found=True)):
            if f"data/{job}/{info.base_name}" not in kept:
                self.fs.delete_file(info.path)


@dataclass
class Written(WriterCommitMessage):
    """A task's file, and, where it replaces episodes, which."""

    file: dict | None
    episodes: list


class Staging:
    """Writes a task's batches to a file of its own, and makes versions of what tasks have written."""

    def __init__(self, root: str, schema: StructType, options: dict) -> None:
        self.root, self.schema, self.episode = root, schema.json(), options.get("episode", EPISODE)
        self.job = uuid.uuid4().hex
        data = Dataset(root)
        self.base = int(options.get("base", data.version().number))
        self.mode = options.get("mode", "append")  # append, overwrite, or replace
        self.replaced = set(json.loads(options.get("files", "[]")))
        self.query, self.batch = options.get("query"), options.get("batch")
        if self.mode not in ("append", "overwrite", "replace"):
            raise ValueError(f"mode {self.mode}: append, overwrite and replace are known")
        data.fs.create_dir(f"{data.root}/data/{self.job}")  # here alone: a task that outlives its aborted job finds no place

    def stage(self, batches: Iterator[pa.RecordBatch]) -> Written:
        data, context = Dataset(self.root), TaskContext.get()
        attempt = f"{context.partitionId()}-{context.taskAttemptId()}" if context else uuid.uuid4().hex
        path = f"data/{self.job}/{attempt}-{uuid.uuid4().hex[:8]}.parquet"
        writer, groups, episodes = None, [], set()
        try:
            for batch in self._groups(batches):
                if writer is None:
                    writer = pq.ParquetWriter(f"{data.root}/{path}", batch.schema, compression="zstd", filesystem=data.fs)
                writer.write_table(batch, row_group_size=max(1, batch.num_rows))
                ends = pc.min_max(batch.column(self.episode)) if self.episode in batch.schema.names else {"min": pa.scalar(None), "max": pa.scalar(None)}
                groups.append([ends["min"].as_py(), ends["max"].as_py(), batch.num_rows])
                if self.mode == "replace" and not self.replaced:
                    episodes |= set(pc.unique(batch.column(self.episode)).to_pylist())
        except BaseException:
            if writer is not None:
                writer.close()
                if data.fs.get_file_info(f"{data.root}/{path}").type == fs.FileType.File:
                    data.fs.delete_file(f"{data.root}/{path}")
            raise
        if writer is None:
            return Written(None, [])
        writer.close()
        return Written({"path": path, "groups": groups, "without": []}, list(episodes))

    def _groups(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        held, rows = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, GROUP_ROWS):
                part = batch.slice(at, GROUP_ROWS)
                if held and rows + part.num_rows > GROUP_ROWS:
                    yield pa.Table.from_batches(held)
                    held, rows = [], 0
                held.append(part)
                rows += part.num_rows
        if held:
            yield pa.Table.from_batches(held)

    def publish(self, messages: Iterable[Written | None], batch: int | None = None, alone: bool = True) -> None:
        """``alone``: the job's folder is of this write only, not of a stream's other batches as well."""
        data = Dataset(self.root)
        written = [m for m in messages if m is not None and m.file is not None]
        new, episodes = [m.file for m in written], {e for m in written for e in m.episodes}
        for _ in range(TRIES):
            now = data.version()
            if self.mode != "append" and now.number != self.base:
                data.drop_job(self.job)
                raise Conflict(f"{self.root}: planned on version {self.base}, but the last is {now.number}")
            if batch is not None and now.batches.get(self.query or "", -1) >= batch:
                data.drop_job(self.job) if alone else self.forget(new)  # committed before
                return
            try:
                data.publish(self._next(data, now, new, episodes, batch))
                if alone:
                    data.drop_strays(self.job, {f["path"] for f in new})
                return
            except Conflict:
                if self.mode != "append":
                    data.drop_job(self.job)
                    raise
        data.drop_job(self.job)
        raise Conflict(f"{self.root}: {TRIES} times another writer came first")

    def _next(self, data: Dataset, now: Version, new: list[dict], episodes: set, batch: int | None) -> Version:
        old = [] if self.mode == "overwrite" else [f for f in now.files if f["path"] not in self.replaced]
        if now.schema is not None and self.mode != "overwrite" and _fields(now.schema) != _fields(self.schema):
            data.drop_job(self.job)
            raise ValueError(f"{self.root} has columns {_fields(now.schema)}, not {_fields(self.schema)}")
        if self.mode == "replace" and not self.replaced:
            known = sorted(episodes - {None})
            old = [_without(f, known, None in episodes) for f in old]
        batches = now.batches if batch is None else now.batches | {self.query or "": batch}
        return Version(now.number + 1, self.schema, tuple([f for f in old if f["groups"]] + new), batches)

    def drop(self) -> None:
        Dataset(self.root).drop_job(self.job)

    def forget(self, files: list[dict]) -> None:
        """Delete files of one batch; a query's others lie in the same folder."""
        data = Dataset(self.root)
        for file in files:
            if data.fs.get_file_info(f"{data.root}/{file['path']}").type == fs.FileType.File:
                data.fs.delete_file(f"{data.root}/{file['path']}")


def _fields(schema: str) -> list[tuple[str, str]]:
    return [(f.name, f.dataType.simpleString()) for f in StructType.fromJson(json.loads(schema)).fields]


def _without(file: dict, episodes: list, nulls: bool) -> dict:
    """The file without these episodes (sorted), and without null ones, as far as its row groups can have them."""
    spans = [(low, high) for low, high, _ in file["groups"] if low is not None]
    touched = {e for low, high in spans for e in episodes[bisect_left(episodes, low) : bisect_right(episodes, high)]}
    gone = set(file["without"]) | touched | ({None} if nulls else set())
    whole = [g for g in file["groups"] if not (g[0] == g[1] and g[0] in gone)]
    if not whole:
        return file | {"groups": [], "without": []}
    return file | {"without": sorted(gone - {None}) + [None] * (None in gone)}


class BatchWriter(DataSourceArrowWriter):
    def __init__(self, staging: Staging) -> None:
        self.staging = staging

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        return self.staging.stage(iterator)

    def commit(self, messages: list) -> None:
        self.staging.publish(messages, None if self.staging.batch is None else int(self.staging.batch))

    def abort(self, messages: list) -> None:
        self.staging.drop()


class StreamWriter(DataSourceStreamArrowWriter):
    """A batch's files are staged under its number, so one that is run again is told apart from one that is new."""

    def __init__(self, staging: Staging) -> None:
        self.staging = staging

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        return self.staging.stage(iterator)

    def commit(self, messages: list, batchId: int) -> None:
        self.staging.publish(messages, batchId, alone=False)

    def abort(self, messages: list, batchId: int) -> None:
        self.staging.forget([m.file for m in messages if m is not None and m.file is not None])


@dataclass
class Part(InputPartition):
    path: str
    groups: list[int]
    without: list


@dataclass(frozen=True)
class Range:
    """What filters leave of the episodes: from ``low`` to ``high``, of ``among`` if that is given."""

    low: Any = None
    high: Any = None
    among: frozenset | None = None

    def meets(self, low: Any, high: Any) -> bool:
        if low is None:  # without episodes a filter on them finds nothing
            return self == Range()
        if self.low is not None and high < self.low or self.high is not None and low > self.high:
            return False
        return self.among is None or any(low <= e <= high for e in self.among)


class Reader(DataSourceReader):
    def __init__(self, root: str, columns: list[str], episode: str, number: int | None, groups: int) -> None:
        self.root, self.columns, self.episode, self.number, self.per_part = root, columns, episode, number, groups
        self.range = Range()

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Filters on the episode choose files and row groups; Spark still applies all of them to the rows."""
        for f in filters:
            of = getattr(f, "attribute", None)
            if of == (self.episode,):
                self.range = _narrowed(self.range, f)
            yield f

    def partitions(self) -> list[InputPartition]:
        parts = []
        for file in Dataset(self.root).version(self.number).files:
            chosen = [k for k, (low, high, _) in enumerate(file["groups"]) if self.range.meets(low, high)]
            for at in range(0, len(chosen), self.per_part):
                parts.append(Part(file["path"], chosen[at : at + self.per_part], file["without"]))
        return parts or [Part("", [], [])]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        data = Dataset(self.root)
        columns = [*self.columns, *({self.episode} - set(self.columns) if partition.without else ())]
        with data.fs.open_input_file(f"{data.root}/{partition.path}") as file:
            for batch in pq.ParquetFile(file).iter_batches(row_groups=partition.groups, columns=columns):
                if partition.without:
                    episodes = batch.column(self.episode)
                    gone = pc.is_in(episodes, value_set=pa.array(partition.without, episodes.type))
                    batch = batch.filter(pc.invert(gone))
                yield batch.select(self.columns)


def _narrowed(old: Range, f: Filter) -> Range:
    later = lambda a, b: b if a is None else max(a, b)
    sooner = lambda a, b: b if a is None else min(a, b)
    if isinstance(f, In):
        values = frozenset(v for v in f.value if v is not None)
        return replace(old, among=values if old.among is None else old.among & values)
    if isinstance(f, (EqualTo, EqualNullSafe)) and f.value is not None:
        return replace(old, low=later(old.low, f.value), high=sooner(old.high, f.value))
    if isinstance(f, (GreaterThan, GreaterThanOrEqual)):
        return replace(old, low=later(old.low, f.value))
    if isinstance(f, (LessThan, LessThanOrEqual)):
        return replace(old, high=sooner(old.high, f.value))
    return old


class Episodes(DataSource):
    """Options: ``path``; ``episode`` (its column); for reads ``version``, ``columns`` (JSON) and ``groups`` (row groups a task);
    for writes ``mode``, ``base`` and ``files`` (JSON: replaced ones), for streams ``query``, a name that stays over restarts,
    and where a stream's batches are written as tables ``batch``, their number."""

    @classmethod
    def name(cls) -> str:
        return "episodes"

    def schema(self) -> StructType:
        number = self.options.get("version")
        found = Dataset(self.options["path"]).version(None if number is None else int(number)).schema
        if found is None:
            raise ValueError(f"no dataset at {self.options['path']}: give a schema")
        whole = StructType.fromJson(json.loads(found))
        columns = self.options.get("columns")
        return whole if columns is None else StructType([whole[c] for c in json.loads(columns)])

    def reader(self, schema: StructType) -> DataSourceReader:
        number = self.options.get("version")
        number = Dataset(self.options["path"]).version().number if number is None else int(number)  # one version for the whole query
        return Reader(self.options["path"], schema.names, self.options.get("episode", EPISODE), number, int(self.options.get("groups", 16)))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        options = dict(self.options)
        return BatchWriter(Staging(options["path"], schema, options | ({"mode": "overwrite"} if overwrite else {})))

    def streamWriter(self, schema: StructType, overwrite: bool) -> DataSourceStreamArrowWriter:
        if not self.options.get("query"):
            raise ValueError("a stream needs a name of its own: option query")
        return StreamWriter(Staging(self.options["path"], schema, dict(self.options)))


def registered(spark: SparkSession) -> SparkSession:
    """The session, with the format ``episodes`` and pushed filters."""
    spark.dataSource.register(Episodes)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark


def read(spark: SparkSession, root: str, episodes: list[int] | None = None, columns: list[str] | None = None, version: int | None = None) -> DataFrame:
    """The rows of a version (the last), of the given episodes and columns; files and row groups without these episodes are not opened."""
    source = registered(spark).read.format("episodes").option("path", root)
    if columns is not None:
        source = source.option("columns", json.dumps(columns))
    if version is not None:
        source = source.option("version", version)
    df = source.load()
    return df if episodes is None else df.filter(F.col(EPISODE).isin(episodes))


def write(df: DataFrame, root: str, mode: str = "append", order: str = STEP, batch: tuple[str, int] | None = None) -> None:
    """Frames dealt by ranges of episode and step, so that a file holds few episodes and a long one is many tasks' work.

    ``replace`` takes the place of the episodes that ``df`` has.  ``batch``, a stream's name and the batch's number, is written once.
    """
    registered(df.sparkSession)
    by = [EPISODE, *([order] if order in df.columns else [])]
    dealt = df.repartitionByRange(*by).sortWithinPartitions(*by)
    out = dealt.write.format("episodes").option("path", root).option("mode", mode)
    if batch is not None:
        out = out.option("query", batch[0]).option("batch", batch[1])
    out.mode("overwrite" if mode == "overwrite" else "append").save()


def write_stream(stream: DataFrame, root: str, checkpoint: str, query: str):
    """Each batch becomes one version, once however often it is run."""
    registered(stream.sparkSession)
    return stream.writeStream.format("episodes").option("path", root).option("query", query).option("checkpointLocation", checkpoint)


def replace_value(spark: SparkSession, root: str, column: str, old: str, new: str) -> int:
    """Replace a value in place, and tell how many files that took; only files that hold it are written anew.

    Readers see the version before or the one after.  ``Conflict`` if another writer has come first; nothing is changed then.
    """
    base = Dataset(root).version()
    files = {f["path"]: f for f in base.files}
    if not files:
        return 0
    rows = registered(spark).read.format("episodes").option("path", root).option("version", base.number).load()
    schema, names = rows.schema, rows.columns
    if column not in names:
        raise KeyError(f"no column {column}")

    def holding(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of the files those that have the value."""
        data = Dataset(root)
        for batch in batches:
            found = []
            for path in batch.column(0).to_pylist():
                with data.fs.open_input_file(f"{data.root}/{path}") as file:
                    if any(pc.any(pc.equal(b.column(0), old)).as_py() for b in pq.ParquetFile(file).iter_batches(columns=[column])):
                        found.append(path)
            yield pa.RecordBatch.from_pydict({"path": pa.array(found, pa.string())})

    def contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(root, names, EPISODE, None, 1)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                yield from reader.read(Part(path, list(range(len(files[path]["groups"]))), files[path]["without"]))

    of_paths = lambda paths: spark.createDataFrame([(p,) for p in paths], "path string").repartition(len(paths), "path")
    touched = sorted(r["path"] for r in of_paths(sorted(files)).mapInArrow(holding, "path string").collect())  # names of files
    if touched:
        changed = of_paths(touched).mapInArrow(contents, schema).withColumn(column, F.when(named(column) == old, F.lit(new)).otherwise(named(column)))
        out = changed.write.format("episodes").option("path", root).option("mode", "replace").option("base", base.number)
        out.option("files", json.dumps(touched)).mode("append").save()
    return len(touched)
