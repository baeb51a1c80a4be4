"""Queries that go through sinks and streams: events are written or replayed in the shared folder, and what arrives is read back."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gantry.functions import scalars
from gantry.operators import kinematics
from gantry.plans.queries import events, query, table
from gantry.scratch import run_dir
from gantry.sources import dataset, episodes
from gantry.streaming import buffer, stepped

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def place(spark: SparkSession, name: str) -> str:
    return f"{run_dir(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """Keyed state needs the RocksDB store; the session's own holds again after."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def stream_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream of files; a pattern, as the table may be one file or a folder."""
    return spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parquet*")


def replayed(spark: SparkSession, sf_dir: str, run: Callable[[DataFrame], DataFrame], name: str) -> DataFrame:
    """Events as a stream through ``run`` into files, until all have arrived."""
    root = place(spark, name)
    with state_store(spark):
        out = run(stream_of(spark, sf_dir))
        sink = out.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/state")
        sink.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{root}/out")


@query("""WITH b AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS g FROM events WHERE event_type IN ('purchase', 'error')),
f AS (SELECT user_id, event_id, value, sum((event_type IN ('purchase', 'error'))::INT) OVER (PARTITION BY user_id ORDER BY event_id) AS g, event_type FROM events),
s AS (SELECT f.user_id, f.g, f.event_id, f.value FROM f JOIN b ON b.user_id = f.user_id AND b.g = f.g AND b.event_type = 'purchase' WHERE f.event_type NOT IN ('purchase', 'error'))
SELECT user_id::VARCHAR AS recorder, dense_rank() OVER (PARTITION BY user_id ORDER BY g) - 1 AS episode_index,
  row_number() OVER (PARTITION BY user_id, g ORDER BY event_id) - 1 AS frame_index, event_id AS seq, round(value, 6) AS value FROM s""")
def buffer_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A recorder's frames, saved by purchases and discarded by errors, through the episode buffer into a versioned dataset."""
    root, state = place(spark, "buffered"), place(spark, "buffered-state")
    kind = F.when(F.col("event_type") == "purchase", buffer.SAVE).when(F.col("event_type") == "error", buffer.DISCARD).otherwise(buffer.FRAME_KIND)
    with state_store(spark):
        rows = stream_of(spark, sf_dir).select(F.col("user_id").cast("string").alias("recorder"), F.col("event_id").alias("seq"), kind.alias("kind"), F.col("value").cast("string").alias("payload"))
        saved = buffer.buffered(rows)
        dataset.write_stream(saved, root, state, "recorder").trigger(availableNow=True).start().awaitTermination()
    return dataset.read(spark, root).select("recorder", "episode_index", "frame_index", "seq", F.round(F.col("payload").cast("double"), 6).alias("value"))


@query("""WITH h AS (SELECT user_id, event_id,
  coalesce(abs(value - lag(value) OVER w) >= 5 AND abs(event_id % 7 - lag(event_id % 7) OVER w) < 4, false) AS hit FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
r AS (SELECT *, sum((NOT hit)::INT) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS run FROM h),
p AS (SELECT *, sum(hit::INT) OVER (PARTITION BY user_id, run ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS place FROM r)
SELECT user_id, event_id, 'recover' AS event FROM p WHERE hit AND place % 3 = 0""")
def stall_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The watchdog's recovery events, from a stream."""
    actual = (F.col("event_id") % 7).cast("double").alias("actual")
    return replayed(spark, sf_dir, lambda s: stepped.watched(s.select("user_id", "event_id", "value", actual), ["user_id"], "event_id", "value", "actual", 5.0, 4.0), "stalls")


@query("""SELECT user_id, event_id, coalesce(last_value(CASE WHEN value - 250 > 100 THEN true WHEN value - 250 < -100 THEN false END IGNORE NULLS)
  OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING), true) AS open FROM events""")
def latch_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gripper latch, from a stream; open at first."""
    gripper = (F.col("value") - 250).alias("gripper")
    found = replayed(spark, sf_dir, lambda s: stepped.latched(s.select("user_id", "event_id", gripper), ["user_id"], ["event_id"], "gripper", 100.0, True), "latch")
    return found.select("user_id", "event_id", "open")


@query("""SELECT user_id AS episode_index, event_id AS step, round(CASE WHEN user_id % 4 = 0 THEN -value ELSE value END, 6) AS value FROM events WHERE user_id IN (3, 4, 8, 11, 12)""")
def episode_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Episodes committed, some committed anew, and five of them scanned."""
    root = place(spark, "episodes")
    rows = events(spark, sf_dir, F.col("user_id").alias("episode_index"), F.col("event_id").alias("step"), "value")
    episodes.commit_episodes(rows, root)
    episodes.commit_episodes(rows.filter("episode_index % 4 = 0").withColumn("value", -F.col("value")), root)
    found = episodes.read_episodes(spark, root, [3, 4, 8, 11, 12])
    return found.select(F.col("episode_index").cast("long").alias("episode_index"), "step", F.round("value", 6).alias("value"))


@query("""SELECT event_id AS step, round(value, 6) AS target, CASE WHEN event_id % 4 > 0 THEN round(value / 2, 6) END AS actual FROM events""")
def tracking_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tracking log written as text, missing values blank, and read back."""
    path = place(spark, "log")
    actual = F.when(F.col("event_id") % 4 > 0, F.col("value") / 2)
    rows = events(spark, sf_dir, F.col("event_id").alias("step"), F.lit(0.0).alias("t"), F.col("value").alias("a.pos_target"), F.col("value").alias("a.pos_commanded"), actual.alias("a.pos_actual"))
    episodes.write_tracking_log(rows, path, ["a.pos"])
    found = spark.read.csv(path, header=True, schema="step LONG, t DOUBLE, target DOUBLE, commanded DOUBLE, actual DOUBLE")
    return found.select("step", F.round("target", 6).alias("target"), F.round("actual", 6).alias("actual"))


@query("""WITH p AS (SELECT event_id, (event_id % 2)::DOUBLE AS y, 1 / (1 + exp(-(value - 250) / 100)) AS p FROM events)
SELECT event_id, round(p, 9) AS p, round(-(CASE WHEN y = 1 THEN ln(p) ELSE ln(1 - p) END), 6) AS loss FROM p""")
def classifier_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probability and log loss of each event."""
    rows = events(spark, sf_dir, "event_id", scalars.sigmoid((F.col("value") - 250) / 100).alias("p"))
    loss = scalars.log_loss((F.col("event_id") % 2).cast("double"), F.col("p"))
    return rows.select("event_id", F.round("p", 9).alias("p"), F.round(loss, 6).alias("loss"))


@query("""WITH q AS (SELECT vec_id, pair::INT AS pair, embedding[2 * pair + 1]::DOUBLE AS a, embedding[2 * pair + 2]::DOUBLE AS b FROM embeddings, range(32) t(pair))
SELECT vec_id, pair, round(cos(a) + 0.5 * cos(a + b), 6) + 0.0 AS x, round(sin(a) + 0.5 * sin(a + b), 6) + 0.0 AS y,
  round(-sin(a) - 0.5 * sin(a + b), 6) + 0.0 AS dx, round(0.5 * cos(a + b), 6) + 0.0 AS dy FROM q""")
def forward_kinematics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tip of an arm of two links in a plane, how it moves in x with the first joint, and in y with the second."""
    joints = spark.createDataFrame(
        [
            ("shoulder", "revolute", "base", "upper", None, None, [0.0, 0.0, 1.0]),
            ("elbow", "continuous", "upper", "fore", None, [1.0, 0.0, 0.0], [0.0, 0.0, 1.0]),
            ("hand", "fixed", "fore", "tip", None, [0.5, 0.0, 0.0], None),
        ],
        "name string, type string, parent string, child string, rpy array<double>, xyz array<double>, axis array<double>",
    )
    chain = kinematics.Chain.from_joints(joints, "base", "tip")
    pairs = table(spark, sf_dir, "embeddings").select("vec_id", F.explode(F.sequence(F.lit(0), F.lit(31))).alias("pair"), "embedding")
    q = F.array(*(F.get("embedding", 2 * F.col("pair") + k).cast("double") for k in (0, 1)))
    found = kinematics.tips(pairs.select("vec_id", "pair", q.alias("q")), chain)
    at = lambda c, k: (F.round(F.get(c, F.lit(k)), 6) + 0.0)
    return found.select("vec_id", "pair", at("tip", 0).alias("x"), at("tip", 1).alias("y"), at("jacobian", 0).alias("dx"), at("jacobian", 3).alias("dy"))
