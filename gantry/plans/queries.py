"""The telemetry queries over the test tables, each with the SQL that gives the same rows.

Proxies: ``events.user_id`` is an episode, ``event_id`` the step, ``value`` the target, ``event_type`` the
channel; ``embeddings.embedding`` is a state vector; ``labels`` marks episodes to discard.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gantry.functions import frames, packets, scalars
from gantry.operators import calibration, filters, folds, kinematics, scans, series, steps, summaries
from gantry.scratch import run_dir
from gantry.sources import dataset, episodes, robot
from gantry.streaming import mirror

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
LIMIT, ALPHA, THRESHOLD = 5.0, 0.3, 250.0
# A calibration for the proxies: side, joint, sign, offset and gripper ends.
JOINT_ROWS = "VALUES ('left', 1, 1, 0.1D), ('left', 2, -1, 0.2D), ('right', 1, 1, -0.3D), ('right', 2, -1, 0.0D) AS t(side, joint, sign, offset_rad)"
GRIPPER_ROWS = "VALUES ('left', -1.1755D, 0.0093D), ('right', -1.2D, 0.01D) AS t(side, open_raw, closed_raw)"
DUCK_JOINTS = "j(side, joint, sign, offset_rad) AS (VALUES ('left', 1, 1, 0.1::DOUBLE), ('left', 2, -1, 0.2::DOUBLE), ('right', 1, 1, -0.3::DOUBLE), ('right', 2, -1, 0.0::DOUBLE))"
DUCK_GRIPPERS = "g(side, open_raw, closed_raw) AS (VALUES ('left', -1.1755::DOUBLE, 0.0093::DOUBLE), ('right', -1.2::DOUBLE, 0.01::DOUBLE))"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(*columns)


def calibrated(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    return spark.sql(f"SELECT * FROM {JOINT_ROWS}"), spark.sql(f"SELECT * FROM {GRIPPER_ROWS}")


ORDERED = "o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events)"
SLEW = f"""WITH RECURSIVE {ORDERED},
f AS (SELECT user_id, event_id, event_type, rn, value, value AS commanded FROM o WHERE rn = 1
      UNION ALL
      SELECT o.user_id, o.event_id, o.event_type, o.rn, o.value, f.commanded + greatest(-{LIMIT}, least({LIMIT}, o.value - f.commanded))
      FROM f JOIN o ON o.user_id = f.user_id AND o.rn = f.rn + 1)"""


def slewed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.slew_limit(events(spark, sf_dir, "user_id", "event_id", "event_type", "value"), ["user_id"], ["event_id"], "value", LIMIT)


@query(f"{SLEW} SELECT event_type, count(*) AS n, round(avg(abs(value - commanded)), 6) AS mean_err, round(max(abs(value - commanded)), 6) AS max_err FROM f GROUP BY event_type")
def tracking_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = summaries.tracking_summary(slewed(spark, sf_dir), ["event_type"], "value", "commanded")
    return found.withColumns({"mean_err": F.round("mean_err", 6), "max_err": F.round("max_err", 6)})


@query(f"{SLEW} SELECT user_id, event_id, round(commanded, 6) AS commanded FROM f")
def slew_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return slewed(spark, sf_dir).select("user_id", "event_id", F.round("commanded", 6).alias("commanded"))


TIMED = """WITH RECURSIVE o AS (SELECT *, row_number() OVER w AS rn, epoch_us(ts) / 1000000.0::DOUBLE AS t,
  epoch_us(ts) / 1000000.0::DOUBLE - lag(epoch_us(ts) / 1000000.0::DOUBLE) OVER w AS dt FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
f AS (SELECT user_id, event_id, rn, value AS commanded FROM o WHERE rn = 1
      UNION ALL
      SELECT o.user_id, o.event_id, o.rn, f.commanded + greatest(-0.01 * greatest(o.dt, 0.02), least(0.01 * greatest(o.dt, 0.02), o.value - f.commanded))
      FROM f JOIN o ON o.user_id = f.user_id AND o.rn = f.rn + 1)
SELECT user_id, event_id, round(commanded, 4) AS commanded FROM f"""


@query(TIMED)
def slew_limit_timed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir, "user_id", "event_id", "ts", "value").withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    return folds.slew_limit_timed(rows, ["user_id"], ["event_id"], "value", "t", 0.01, 0.02).select("user_id", "event_id", F.round("commanded", 4).alias("commanded"))


@query(f"""WITH RECURSIVE {ORDERED},
f AS (SELECT user_id, event_id, rn, {ALPHA} * value AS smoothed FROM o WHERE rn = 1
      UNION ALL SELECT o.user_id, o.event_id, o.rn, {ALPHA} * o.value + (1 - {ALPHA}) * f.smoothed FROM f JOIN o ON o.user_id = f.user_id AND o.rn = f.rn + 1)
SELECT user_id, event_id, round(smoothed, 6) AS smoothed FROM f""")
def ema(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir, "user_id", "event_id", "value")
    return folds.ema(rows, ["user_id"], ["event_id"], "value", ALPHA).select("user_id", "event_id", F.round("smoothed", 6).alias("smoothed"))


@query(f"""SELECT user_id, event_id, coalesce(last_value(CASE WHEN value - {THRESHOLD} > 100 THEN true WHEN value - {THRESHOLD} < -100 THEN false END IGNORE NULLS)
  OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING), false) AS open FROM events""")
def hysteresis_latch(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir, "user_id", "event_id", (F.col("value") - THRESHOLD).alias("gripper"))
    return series.hysteresis(rows, ["user_id"], ["event_id"], "gripper", 100.0, False).select("user_id", "event_id", "open")


@query("""WITH h AS (SELECT user_id, event_id, value, event_id % 7 AS actual,
  coalesce(abs(value - lag(value) OVER w) >= 5 AND abs(event_id % 7 - lag(event_id % 7) OVER w) < 4, false) AS hit FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
r AS (SELECT *, sum((NOT hit)::INT) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS run FROM h)
SELECT user_id, event_id, hit, hit AND sum(hit::INT) OVER (PARTITION BY user_id, run ORDER BY event_id ROWS UNBOUNDED PRECEDING) % 3 = 0 AS fired FROM r""")
def stall_watchdog(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir, "user_id", "event_id", "value").withColumn("actual", F.col("event_id") % 7)
    return series.stalls(rows, ["user_id"], ["event_id"], "value", "actual", 5.0, 4.0).select("user_id", "event_id", "hit", "fired")


@query("SELECT event_id, round(100 + greatest(-5, least(5, value - 100)), 6) AS commanded FROM events")
def step_clamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir, "event_id", F.round(series.step_clamp(F.lit(100.0), F.col("value"), LIMIT), 6).alias("commanded"))


@query("""SELECT event_id, i::INT AS i, round(i / s, 9) AS alpha, round(value + i / s * (2 * value - value), 6) AS value
FROM (SELECT *, greatest(1, trunc(value / 100 * 3)::INT) AS s FROM events), LATERAL (SELECT unnest(range(1, s + 1)) AS i)""")
def ramp_generate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir, "event_id", F.col("value").alias("start"), (2 * F.col("value")).alias("end"))
    stepped = series.ramp(rows, "start", "end", series.ramp_steps(F.col("start") / 100, F.lit(3)))
    return stepped.select("event_id", "i", F.round("alpha", 9).alias("alpha"), F.round("value", 6).alias("value"))


@query("SELECT event_id, i::INT AS i, round(100 + i / 10 * (value - 100), 6) AS value FROM events, range(1, 11) t(i)")
def ramp_upsample(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir, "event_id", F.lit(100.0).alias("measured"), F.col("value").alias("target"))
    return series.upsample(rows, "measured", "target").select("event_id", "i", F.round("value", 6).alias("value"))


@query("SELECT event_id, i::INT AS i, round(40 * i / 4, 6) AS kp, round(2 * i / 4, 6) AS kd, round(i / 4 * value, 6) AS value FROM events, range(1, 5) t(i)")
def gain_ramp(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir, "event_id", F.lit(0.0).alias("start"), F.col("value").alias("target"), F.lit(40.0).alias("kp"), F.lit(2.0).alias("kd"))
    return series.gain_ramp(rows, ["kp", "kd"], "target", "start", F.lit(4)).select("event_id", "i", *(F.round(c, 6).alias(c) for c in ("kp", "kd", "value")))


@query("""SELECT event_id, round(0.0093 + greatest(0, least(1, value / 10000 / 0.044)) * (-1.1755 - 0.0093), 9) AS from_sim,
  round(0.0093 + greatest(0, least(1, (value / 245 - 1 + 1) / 2)) * (-1.1755 - 0.0093), 9) AS from_command,
  round(greatest(0, least(1, (-value / 300 - 0.0093) / (-1.1755 - 0.0093))) * 0.044, 9) AS to_sim, round(value * 2000, 6) AS width_mm FROM events""")
def gripper_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    ends = F.lit(-1.1755), F.lit(0.0093)
    v = F.col("value")
    return events(
        spark, sf_dir, "event_id",
        F.round(scalars.gripper_sim_to_raw(v / 10000, *ends), 9).alias("from_sim"),
        F.round(scalars.gripper_command_to_raw(v / 245 - 1, *ends), 9).alias("from_command"),
        F.round(scalars.gripper_raw_to_sim(-v / 300, *ends), 9).alias("to_sim"),
        F.round(scalars.gripper_width_mm(v), 6).alias("width_mm"),
    )


def sided(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as frames of two joints and a gripper on two sides."""
    joint = F.when(F.col("event_id") % 3 == 2, 8).otherwise(F.col("event_id") % 3 + 1).cast("int")
    side = F.when(F.col("user_id") % 2 == 0, "left").otherwise("right")
    return events(spark, sf_dir, "event_id", side.alias("side"), joint.alias("joint"), (F.col("value") / 12000).alias("value"))


SIDED = """e AS (SELECT event_id, CASE WHEN user_id % 2 = 0 THEN 'left' ELSE 'right' END AS side,
  (CASE WHEN event_id % 3 = 2 THEN 8 ELSE event_id % 3 + 1 END)::INT AS joint, value / 12000 AS value FROM events)"""


@query(f"""WITH {SIDED}, {DUCK_JOINTS}, {DUCK_GRIPPERS}
SELECT event_id, side, e.joint, round(CASE WHEN e.joint = 8 THEN closed_raw + greatest(0, least(1, value / 0.044)) * (open_raw - closed_raw) ELSE sign * value + offset_rad END, 9) AS robot_value
FROM e LEFT JOIN j USING (side, joint) JOIN g USING (side)""")
def joint_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    mapped = calibration.to_robot(sided(spark, sf_dir), *calibrated(spark))
    return mapped.select("event_id", "side", "joint", F.round("robot_value", 9).alias("robot_value"))


@query(f"""WITH {SIDED} SELECT event_id, side, joint, coalesce(f.finger, 0)::INT AS finger, round(least(value, CASE WHEN joint = 8 THEN 0.044 ELSE 99 END), 9) AS sim_value
FROM e, LATERAL (SELECT unnest(CASE WHEN joint = 8 THEN [1, 2] ELSE [NULL] END) AS finger) f""")
def joint_map_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Back from the robot: values inside the range return, grippers on both fingers."""
    there = calibration.to_robot(sided(spark, sf_dir), *calibrated(spark)).select("event_id", "side", "joint", F.col("robot_value").alias("value"))
    back = calibration.from_robot(there, *calibrated(spark))
    return back.select("event_id", "side", "joint", F.coalesce("finger", F.lit(0)).alias("finger"), F.round("sim_value", 9).alias("sim_value"))


@query("""SELECT c_mktsegment AS side, c_custkey AS joint, c_acctbal AS value FROM customer
UNION ALL SELECT s_name, 8, s_acctbal FROM supplier""")
def rest_pose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers stand for joints with offsets, suppliers for sides with grippers."""
    joints = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("side"), F.col("c_custkey").alias("joint"), F.lit(1).alias("sign"), F.col("c_acctbal").alias("offset_rad"))
    grippers = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("side"), F.col("s_acctbal").alias("open_raw"), F.lit(0.0).alias("closed_raw"))
    return calibration.rest_pose(joints, grippers)


@query("""SELECT user_id, bool_and(value <= 480) AS plausible, min(CASE WHEN value > 480 THEN event_type END) AS first_bad FROM events GROUP BY user_id""")
def plausible_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir, "user_id", F.col("event_type").alias("channel"), (F.col("value") / 150).alias("value"))
    return filters.plausible_frames(rows, ["user_id"])


@query("""SELECT user_id, min(CASE WHEN value <= 320 THEN event_id END) AS event_id, arg_min(value, event_id) FILTER (WHERE value <= 320) AS value FROM events GROUP BY user_id""")
def retry_until_plausible(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.first_plausible(events(spark, sf_dir, "user_id", "event_id", "value"), ["user_id"], "event_id", F.col("value") <= 320, "value")


@query("""WITH d AS (SELECT user_id, event_id, abs(value - lag(value) OVER (PARTITION BY user_id ORDER BY event_id)) AS apart FROM events)
SELECT user_id, coalesce(min(CASE WHEN apart <= 3 THEN event_id END), -1) AS event_id, round(max(apart), 6) AS worst FROM d GROUP BY user_id""")
def retry_until_stable(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = series.first_stable(events(spark, sf_dir, "user_id", "event_id", "value"), ["user_id"], "event_id", ["value"], 3.0)
    return found.withColumns({"worst": F.round("worst", 6), "event_id": F.coalesce("event_id", F.lit(-1).cast("long"))})


@query("""WITH r AS (SELECT user_id, event_type AS channel, event_id, abs(value - 250) / 200 AS ratio FROM events),
w AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ratio DESC, event_id) AS rn FROM r)
SELECT user_id, channel, round(ratio, 9) AS ratio, ratio <= 1 AS passed FROM w WHERE rn = 1""")
def handshake_worst(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir, "user_id", "event_id", F.col("event_type").alias("channel"), F.col("value").alias("target"), F.lit(250.0).alias("actual"))
    return summaries.handshake(rows, ["user_id"], "event_id", F.lit(200.0)).withColumn("ratio", F.round("ratio", 9))


@query("""SELECT event_type, min(value) AS low, max(value) AS high, round((min(value) + max(value)) / 2, 6) AS centre,
  round(greatest((max(value) - min(value)) / 2 * 1.1, 0.1), 6) AS half FROM events GROUP BY event_type""")
def axis_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = summaries.axis_range(events(spark, sf_dir, "event_type", "value"), ["event_type"], "value", F.lit(summaries.JOINT_TOLERANCE))
    return found.withColumns({"centre": F.round("centre", 6), "half": F.round("half", 6)})


@query("SELECT event_type, arg_max(value, event_id) AS value, count(*) AS n FROM events GROUP BY event_type")
def latest_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.latest_per_key(events(spark, sf_dir, "event_type", "event_id", "value"), "event_type", F.col("event_id"), "value")


@query("SELECT DISTINCT n_regionkey FROM nation WHERE n_regionkey NOT IN (1, 2) ORDER BY 1")
def unmatched_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.unmatched_ids(table(spark, sf_dir, "nation"), "n_regionkey", [1, 2])


@query("""WITH s AS (SELECT s_nationkey AS n_nationkey, count(*) AS n FROM supplier WHERE s_acctbal > 5000 GROUP BY 1)
SELECT n_nationkey, n_name, coalesce(n, 0) AS n, n IS NOT NULL AS responded FROM nation LEFT JOIN s USING (n_nationkey)""")
def id_left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = table(spark, sf_dir, "supplier").filter("s_acctbal > 5000").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count("*").alias("n"))
    return summaries.with_silent(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), seen, "n_nationkey").na.fill(0, ["n"])


@query("""SELECT e.user_id, e.event_id, (SELECT max_by(v.value, v.event_id) FROM events v WHERE v.user_id = e.user_id AND v.event_type = 'click' AND v.event_id <= e.event_id) AS value
FROM events e WHERE e.event_type <> 'click'""")
def as_of_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir, "user_id", "event_id", "event_type", "value")
    clicks = rows.filter("event_type = 'click'").select("user_id", "event_id", "value")
    return summaries.as_of(rows.filter("event_type <> 'click'").select("user_id", "event_id"), clicks, ["user_id"], "event_id", "value")


PAIRED = "a AS (SELECT user_id, event_type AS channel, max(value) AS target, min(value) AS actual FROM events GROUP BY ALL)"


@query(f"WITH {PAIRED} SELECT channel, count(*) AS n, round(avg(abs(actual - target)), 6) AS mean_err, round(max(abs(actual - target)), 6) AS max_err FROM a GROUP BY channel")
def paired_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = events(spark, sf_dir, "user_id", F.col("event_type").alias("channel"), "value").groupBy("user_id", "channel")
    both = summaries.paired(by.agg(F.max("value").alias("value")), by.agg(F.min("value").alias("value")), ["user_id"])
    found = summaries.tracking_summary(both, ["channel"], "target", "actual")
    return found.withColumns({"mean_err": F.round("mean_err", 6), "max_err": F.round("max_err", 6)})


@query("SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events) WHERE rn > 1")
def warmup_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.skip_warm_up(events(spark, sf_dir, "user_id", "event_id"), ["user_id"], ["event_id"])


@query("SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events) WHERE rn <= 20")
def head_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.head(events(spark, sf_dir, "user_id", "event_id"), ["user_id"], ["event_id"], 20)


@query("SELECT user_id, event_id, value, 0.5::DOUBLE AS \"RJ1.pos\", -1.2::DOUBLE AS \"RJ8.pos\" FROM events")
def constant_hold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.hold(events(spark, sf_dir, "user_id", "event_id", "value"), {"RJ1.pos": 0.5, "RJ8.pos": -1.2})


@query("SELECT event_id, value / 10000 <= 0.027 AS executed FROM events")
def executed_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.executed(events(spark, sf_dir, "event_id", (F.col("value") / 10000).alias("model_time"))).select("event_id", "executed")


@query("""WITH g AS (SELECT event_id, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id)) / 1000 AS gap_ms FROM events)
SELECT event_id, CASE WHEN gap_ms > 3600000 THEN 'halt' WHEN gap_ms > 600000 THEN 'hold' ELSE 'track' END AS state FROM g""")
def gap_staleness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.staleness(events(spark, sf_dir, "user_id", "event_id", "ts"), ["user_id"], "ts", 600_000, 3_600_000).select("event_id", "state")


@query("""WITH g AS (SELECT user_id, event_id, epoch_us(ts) / 1000000 - lag(epoch_us(ts) / 1000000) OVER (PARTITION BY user_id ORDER BY event_id) AS gap FROM events)
SELECT user_id, event_id, round(gap, 3) AS gap FROM g WHERE gap > 3 * 1000""")
def loop_overruns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir, "user_id", "event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"))
    return series.overruns(rows, ["user_id"], ["event_id"], "t", 1000.0).select("user_id", "event_id", F.round("gap", 3).alias("gap"))


@query("""SELECT user_id, event_id FROM (SELECT *, epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id) AS since FROM events) WHERE since < 100000 * 1000000::BIGINT""")
def bounded_episode(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir, "user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    return series.within_time(rows, ["user_id"], "t", 100_000 * 1_000_000).select("user_id", "event_id")


@query("""SELECT user_id, epoch_us(time_bucket(INTERVAL '1 hour', ts, TIMESTAMP '1970-01-01')) AS start_us, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY ALL""")
def throttle_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir, "user_id", "event_id", "ts", "value")
    found = mirror.throttled(rows, "ts", ["user_id"], "value", every="1 hour", order=["event_id"])
    return found.select("user_id", F.unix_micros("window.start").alias("start_us"), "value")


@query("SELECT event_id, (props->>'k')::BIGINT AS seq, value AS joint FROM events WHERE props->>'k' IS NOT NULL")
def packet_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    seq = F.get_json_object("props", "$.k")
    value = F.concat(F.lit('{"seq":'), seq, F.lit(',"t":0.0,"joints":{"a":'), F.col("value").cast("string"), F.lit("}}"))
    parsed = packets.parse_packets(events(spark, sf_dir, "event_id", value.alias("value")))
    return parsed.select("event_id", "seq", F.col("joints")["a"].alias("joint"))


@query("""SELECT vec_id, embedding[3] AS third, CASE WHEN vec_id % 2 = 0 THEN embedding[64] ELSE embedding[1] END AS named FROM embeddings""")
def vector_named_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = [f"c{k}" for k in range(64)]
    of = F.array(*(F.lit(n) for n in names))
    vector = F.col("embedding")
    chosen = F.when(F.col("vec_id") % 2 == 0, frames.named(vector, of, "c63")).otherwise(frames.named(vector, of, "c0"))
    return table(spark, sf_dir, "embeddings").select("vec_id", frames.vector_to_fields(vector, names)[2].alias("third"), chosen.alias("named"))


@query("SELECT user_id, count(*) FILTER (WHERE event_type = 'click') AS click, count(*) FILTER (WHERE event_type = 'view') AS \"view\" FROM events GROUP BY user_id")
def pivot_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = events(spark, sf_dir, "user_id", F.col("event_type").alias("channel"), F.lit(1).alias("value"))
    return counted.groupBy("user_id").pivot("channel", ["click", "view"]).agg(F.count("value")).na.fill(0)


@query("SELECT c_custkey, channel, value FROM (SELECT c_custkey, c_acctbal AS balance, c_nationkey::DOUBLE AS nation FROM customer) UNPIVOT (value FOR channel IN (balance, nation))")
def wide_to_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_acctbal").alias("balance"), F.col("c_nationkey").alias("nation"))
    return frames.wide_to_long(rows, ["c_custkey"], ["balance", "nation"])


@query("""SELECT c_custkey, c_acctbal AS first_a, 7.0::DOUBLE AS merged FROM customer""")
def map_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames as maps: prefix filter, first match, and a merge in which the right side wins."""
    frame = F.create_map(F.lit("LJ1.pos"), "c_acctbal", F.lit("RJ1.pos"), F.lit(1.0), F.lit("t"), F.lit(2.0))
    rows = table(spark, sf_dir, "customer").select("c_custkey", frames.keep_suffix(frame, ".pos").alias("frame"))
    merged = frames.merge(F.col("frame"), F.create_map(F.lit("RJ1.pos"), F.lit(7.0)))
    return rows.select("c_custkey", frames.first_with_prefix(F.col("frame"), "L").alias("first_a"), frames.keep_prefix(merged, "R")["RJ1.pos"].alias("merged"))


@query("SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)")
def episode_commit_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = episodes.without_discarded(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").filter("quality = 0"), "doc_id")
    return kept.select("doc_id", "lang")


@query("SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' THEN 'urgent' ELSE o_orderpriority END AS o_orderpriority FROM orders")
def task_rename(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.replace_value(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority", "1-URGENT", "urgent")


@query("SELECT bool_or(o_orderpriority IS NULL) AS any_null FROM orders")
def null_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.any_null(table(spark, sf_dir, "orders"), "o_orderpriority")


@query("SELECT avg((quality = 1 - toxic)::INT) AS accuracy FROM labels")
def accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.accuracy(table(spark, sf_dir, "labels").withColumn("predicted", 1 - F.col("toxic")), "quality", "predicted")


@query("SELECT event_id, user_id, NULL::VARCHAR AS absent FROM events ORDER BY event_id LIMIT 5")
def tolerant_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.select_tolerant(episodes.preview(table(spark, sf_dir, "events"), ["event_id"]), ["event_id", "user_id", "absent"])


@query("""SELECT event_id, (event_id * 97 % 65536)::INT AS code, round((event_id * 97 % 65536) / 65535 * 25 - 12.5, 9) AS position,
  (event_id % 16)::INT AS error, (user_id % 16)::INT AS motor FROM events""")
def can_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    hexed = F.format_string("%02X%04X00", (F.col("event_id") % 16) * 16 + F.col("user_id") % 16, F.col("event_id") * 97 % 65536)
    found = robot.decode_can(events(spark, sf_dir, "event_id", F.unhex(hexed).alias("data")))
    return found.select("event_id", "code", F.round("position", 9).alias("position"), "error", "motor")


TREE_LINKS = """SELECT 'r' || r_regionkey AS name, 'world' AS parent, r_name AS child FROM region
UNION ALL SELECT 'n' || n_nationkey, r_name, n_name FROM nation JOIN region ON n_regionkey = r_regionkey
UNION ALL SELECT 'c' || c_custkey, n_name, c_name FROM customer JOIN nation ON c_nationkey = n_nationkey"""


@query(f"""WITH RECURSIVE j AS ({TREE_LINKS}),
t AS (SELECT NULL::VARCHAR AS joint, 'world' AS link, 0 AS depth, 'world' AS path
      UNION ALL SELECT j.name, j.child, depth + 1, path || '/' || j.child FROM t JOIN j ON j.parent = t.link)
SELECT joint, link, depth, path FROM t WHERE joint IS NOT NULL""")
def urdf_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions, nations and customers stand for a branching description."""
    region, nation, customer = (table(spark, sf_dir, t) for t in ("region", "nation", "customer"))
    joint = lambda df, letter, key, parent, child: df.select(F.concat(F.lit(letter), F.col(key).cast("string")).alias("name"), parent.alias("parent"), F.col(child).alias("child"))
    links = joint(region, "r", "r_regionkey", F.lit("world"), "r_name")
    links = links.unionByName(joint(nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")), "n", "n_nationkey", F.col("r_name"), "n_name"))
    links = links.unionByName(joint(customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")), "c", "c_custkey", F.col("n_name"), "c_name"))
    return kinematics.joint_tree(spark, links, "world")


@query("SELECT event_id, event_type AS channel, value FROM events WHERE (event_type = 'click' AND (value < 50 OR value > 100)) OR (event_type = 'view' AND (value < 0 OR value > 300))")
def joint_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    limits = spark.sql("SELECT * FROM VALUES ('click', 50.0D, 100.0D), ('view', 0.0D, 300.0D) AS t(name, lower, upper)")
    rows = events(spark, sf_dir, "event_id", F.col("event_type").alias("channel"), "value")
    return kinematics.limit_violations(rows, limits).select("event_id", "channel", "value")


@query("""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings)
SELECT vec_id, k::INT AS joint, round(e[k + 1] * e[64] / (list_sum(list_transform(e[1:63], lambda y: y * y)) + 0.0001), 6) + 0.0 AS dq FROM v, range(63) t(k)""")
def ik_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The damped step for a Jacobian of one row, where it is the row times d / (row squared + damping squared)."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.slice(v, 1, 63).alias("jacobian"), F.slice(v, 64, 1).alias("delta"))
    found = kinematics.dls(rows, 1, 63, 0.01)
    return found.select("vec_id", F.posexplode("dq").alias("joint", "dq")).withColumn("dq", F.round("dq", 6))


@query("""WITH RECURSIVE c AS (SELECT *, CASE WHEN event_type IN ('click', 'view') THEN 'LJ8.pos' ELSE 'LJ1.pos' END AS channel FROM events),
o AS (SELECT *, row_number() OVER (PARTITION BY user_id, channel ORDER BY event_id) AS rn FROM c),
f AS (SELECT user_id, channel, event_id, rn, value AS commanded FROM o WHERE rn = 1
      UNION ALL
      SELECT o.user_id, o.channel, o.event_id, o.rn, f.commanded + greatest(-l, least(l, o.value - f.commanded))
      FROM f JOIN (SELECT *, CASE WHEN channel = 'LJ8.pos' THEN 80.0::DOUBLE ELSE 5.0::DOUBLE END AS l FROM o) o ON o.user_id = f.user_id AND o.channel = f.channel AND o.rn = f.rn + 1)
SELECT event_id, channel, round(commanded, 6) AS commanded FROM f""")
def slew_limit_gripper(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grippers follow by a limit of their own."""
    channel = F.when(F.col("event_type").isin("click", "view"), "LJ8.pos").otherwise("LJ1.pos").alias("channel")
    rows = events(spark, sf_dir, "user_id", "event_id", channel, "value")
    found = folds.slew_limit(rows, ["user_id", "channel"], ["event_id"], "value", LIMIT, gripper_limit=80.0)
    return found.select("event_id", "channel", F.round("commanded", 6).alias("commanded"))


@query("""WITH RECURSIVE o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn, epoch_us(ts) / 1000000.0::DOUBLE AS t FROM events),
f AS (SELECT user_id, event_id, rn, t, value AS commanded, false AS halted FROM o WHERE rn = 1
      UNION ALL
      SELECT user_id, event_id, rn, t, CASE WHEN stop THEN was ELSE was + greatest(-l, least(l, value - was)) END, stop
      FROM (SELECT o.user_id, o.event_id, o.rn, o.t, o.value, f.commanded AS was, f.halted OR o.t - f.t > 150000 AS stop,
              0.001::DOUBLE * CASE WHEN o.t - f.t > 20000 THEN 1000.0::DOUBLE ELSE greatest(o.t - f.t, 1000.0::DOUBLE) END AS l
            FROM f JOIN o ON o.user_id = f.user_id AND o.rn = f.rn + 1))
SELECT user_id, event_id, round(commanded, 4) AS commanded FROM f""")
def slew_limit_held(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held commands restart the clock after a stale gap, and a long one ends the run."""
    rows = events(spark, sf_dir, "user_id", "event_id", "ts", "value").withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    found = folds.slew_limit_timed(rows, ["user_id"], ["event_id"], "value", "t", 0.001, 1000.0, stale=20000.0, timeout=150000.0)
    return found.select("user_id", "event_id", F.round("commanded", 4).alias("commanded"))


@query("""WITH c AS (SELECT user_id, 'LJ' || (event_id % 8 + 1) || '.pos' AS channel, value / 50 - 4 AS v FROM events)
SELECT user_id, bool_and(channel = 'LJ8.pos' OR abs(v) <= 3.2) AS plausible, min(channel) FILTER (WHERE channel <> 'LJ8.pos' AND abs(v) > 3.2) AS first_bad FROM c GROUP BY user_id""")
def plausible_arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of either sign; grippers are let through."""
    rows = events(spark, sf_dir, "user_id", scalars.channel_name(F.lit("L"), F.col("event_id") % 8 + 1).alias("channel"), (F.col("value") / 50 - 4).alias("value"))
    return filters.plausible_frames(rows, ["user_id"], include_gripper=False)


@query("""SELECT c_name AS side, 'sign' AS what FROM customer WHERE c_custkey % 3 = 1
UNION ALL SELECT c_name, 'offset_rad' FROM customer WHERE c_custkey % 5 = 0
UNION ALL SELECT c_name, 'gripper' FROM customer WHERE c_custkey % 4 = c_custkey % 2
UNION ALL SELECT c_mktsegment, 'repeated' FROM customer GROUP BY c_mktsegment, c_nationkey HAVING count(*) > 1 AND c_nationkey < 5""")
def calibration_defects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A side for each customer, and sides (segments) with a joint for each nation, some there more than once."""
    c = table(spark, sf_dir, "customer")
    key = F.col("c_custkey")
    joints = c.select(F.col("c_name").alias("side"), F.lit(1).cast("long").alias("joint"), (key % 3 - 1).alias("sign"), F.when(key % 5 != 0, 0.5).alias("offset_rad"))
    several = c.filter("c_nationkey < 5").select(F.col("c_mktsegment").alias("side"), F.col("c_nationkey").cast("long").alias("joint"), F.lit(1).cast("long").alias("sign"), F.lit(0.5).alias("offset_rad"))
    return calibration.violations(joints.unionByName(several), c.select(F.col("c_name").alias("side"), (key % 4).alias("open_raw"), (key % 2).alias("closed_raw")))


@query("""SELECT event_id, CASE WHEN event_id % 2 = 0 THEN event_id & 536870911 ELSE event_id & 2047 END AS can_id FROM events
WHERE event_id % 9 >= 3 AND CASE WHEN event_id % 2 = 0 THEN event_id & 536870911 ELSE event_id & 2047 END BETWEEN 16 AND 31""")
def can_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extended ids (with the flag set) keep 29 bits, standard ones 11."""
    raw = F.col("event_id") + F.when(F.col("event_id") % 2 == 0, F.lit(filters.EXTENDED_FLAG)).otherwise(0)
    return filters.answers(events(spark, sf_dir, "event_id", raw.alias("can_id"), (F.col("event_id") % 9).alias("dlc")), list(range(16, 32))).select("event_id", "can_id")


@query("""SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'L' ELSE 'R' END || 'J' || (event_id % 10) || '.pos' AS channel,
  CASE WHEN event_id % 10 BETWEEN 1 AND 8 THEN CASE WHEN event_id % 2 = 0 THEN 'L' ELSE 'R' END END AS side, CASE WHEN event_id % 10 BETWEEN 1 AND 8 THEN (event_id % 10)::INT END AS joint FROM events""")
def channel_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir, "event_id", scalars.channel_name(F.when(F.col("event_id") % 2 == 0, "L").otherwise("R"), F.col("event_id") % 10).alias("channel"))
    return rows.withColumns({"side": scalars.channel_side(F.col("channel")), "joint": scalars.channel_joint(F.col("channel"))})


@query("SELECT event_id, round(value / -25, 9) AS gripper, round(value * 0.87 * CASE WHEN event_id % 7 = 6 THEN 0.5 ELSE 1 END, 9) AS torque FROM events")
def leader_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    torque = scalars.leader_gravity(F.col("value"), F.col("event_id") % 7 + 1)
    return events(spark, sf_dir, "event_id", F.round(scalars.leader_gripper(F.col("value")), 9).alias("gripper"), F.round(torque, 9).alias("torque"))


@query(f"""WITH {DUCK_JOINTS}, h(joint, value) AS (VALUES (1, 0.25::DOUBLE), (8, -1.0::DOUBLE)),
e AS (SELECT user_id AS episode, event_id AS step, 1 + event_id % 2 AS joint, value FROM events WHERE event_type IN ('click', 'view'))
SELECT episode, step, 'left' AS side, e.joint::INT AS joint, round(sign * e.value + offset_rad, 6) AS value FROM e JOIN j ON j.side = 'left' AND j.joint = e.joint
UNION ALL SELECT episode, step, 'right', h.joint, h.value FROM e, h""")
def left_with_hold(spark: SparkSession, sf_dir: str) -> DataFrame:
    joints, grippers = calibrated(spark)
    rows = events(spark, sf_dir, F.col("user_id").alias("episode"), F.col("event_id").alias("step"), F.lit("left").alias("side"), (1 + F.col("event_id") % 2).cast("int").alias("joint"), "value", "event_type")
    held = spark.sql("SELECT * FROM VALUES ('right', 1, 0.25D), ('right', 8, -1.0D) AS t(side, joint, value)")
    return calibration.left_with_hold(rows.filter(F.col("event_type").isin("click", "view")).drop("event_type"), joints, grippers, held).withColumn("value", F.round("value", 6))


@query("SELECT event_id, event_type AS channel, value AS target, value / 2 AS actual FROM events WHERE event_id % 3 <> 0 AND event_id % 4 <> 0")
def paired_tolerant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets without an actual value, or with a null one, stay out."""
    rows = events(spark, sf_dir, "event_id", F.col("event_type").alias("channel"), "value")
    actual = rows.filter("event_id % 3 <> 0").withColumn("value", F.when(F.col("event_id") % 4 != 0, F.col("value") / 2))
    return summaries.paired(rows, actual, ["event_id"], strict=False)


@query("SELECT vec_id, embedding[6] AS sixth, 64 AS n FROM embeddings")
def joint_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    zipped = episodes.named_trajectory(table(spark, sf_dir, "embeddings").withColumnRenamed("embedding", "q"), [f"j{k}" for k in range(1, 65)])
    return zipped.select("vec_id", F.col("joints")["j6"].alias("sixth"), F.size("joints").alias("n"))


@query("SELECT c_custkey, c_nationkey::FLOAT AS one, c_acctbal::FLOAT AS two FROM customer")
def ordered_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    vector = frames.fields_to_vector(["c_nationkey", "c_acctbal"])
    return table(spark, sf_dir, "customer").select("c_custkey", vector.alias("v")).select("c_custkey", *frames.vector_to_fields(F.col("v"), ["one", "two"]))


@query("SELECT c_custkey AS camera1, c_name AS camera2 FROM customer")
def renamed_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.renamed(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), {"c_custkey": "camera1", "c_name": "camera2"})


@query()
def ik_step_arm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Damped steps for Jacobians of 6 by 7, from the vectors' first 42 entries, and pose steps, from the next 6."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.slice(v, 1, 42).alias("jacobian"), F.slice(v, 43, 6).alias("delta"))
    return kinematics.dls(rows, 6, 7, 0.05).select("vec_id", F.transform("dq", lambda x: F.round(x, 6)).alias("dq"))


def of_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with their type as the channel: a handful of keys that hold all rows, each far too many for one task at scale."""
    return events(spark, sf_dir, "event_type", "event_id", "ts", "value")


BY_TYPE = "o AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS rn FROM events)"


@query(f"""WITH RECURSIVE {BY_TYPE},
f AS (SELECT event_type, event_id, rn, value AS commanded FROM o WHERE rn = 1
      UNION ALL
      SELECT o.event_type, o.event_id, o.rn, f.commanded + greatest(-{LIMIT}, least({LIMIT}, o.value - f.commanded)) FROM f JOIN o ON o.event_type = f.event_type AND o.rn = f.rn + 1)
SELECT event_type, event_id, round(commanded, 6) AS commanded FROM f""")
def slew_limit_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slew limits of keys too long for one task."""
    found = scans.slew_limit(of_type(spark, sf_dir), ["event_type"], ["event_id"], "value", LIMIT)
    return found.select("event_type", "event_id", F.round("commanded", 6).alias("commanded"))


@query(f"""WITH RECURSIVE {BY_TYPE},
f AS (SELECT event_type, event_id, rn, {ALPHA} * value AS smoothed FROM o WHERE rn = 1
      UNION ALL SELECT o.event_type, o.event_id, o.rn, {ALPHA} * o.value + (1 - {ALPHA}) * f.smoothed FROM f JOIN o ON o.event_type = f.event_type AND o.rn = f.rn + 1)
SELECT event_type, event_id, round(smoothed, 6) AS smoothed FROM f""")
def ema_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Smoothing of keys too long for one task."""
    found = scans.ema(of_type(spark, sf_dir), ["event_type"], ["event_id"], "value", ALPHA)
    return found.select("event_type", "event_id", F.round("smoothed", 6).alias("smoothed"))


@query("""WITH RECURSIVE o AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS rn, epoch_us(ts) / 1000000.0::DOUBLE AS t FROM events),
f AS (SELECT event_type, event_id, rn, t, value AS commanded, false AS halted FROM o WHERE rn = 1
      UNION ALL
      SELECT event_type, event_id, rn, t, CASE WHEN stop THEN was ELSE was + greatest(-l, least(l, value - was)) END, stop
      FROM (SELECT o.event_type, o.event_id, o.rn, o.t, o.value, f.commanded AS was, f.halted OR o.t - f.t > 150000 AS stop,
              0.001::DOUBLE * CASE WHEN o.t - f.t > 2000 THEN 100.0::DOUBLE ELSE greatest(o.t - f.t, 100.0::DOUBLE) END AS l
            FROM f JOIN o ON o.event_type = f.event_type AND o.rn = f.rn + 1))
SELECT event_type, event_id, round(commanded, 4) AS commanded FROM f""")
def slew_limit_timed_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slew limits by time, with stale gaps and an end, of keys too long for one task."""
    rows = of_type(spark, sf_dir).withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    found = scans.slew_limit_timed(rows, ["event_type"], ["event_id"], "value", "t", 0.001, 100.0, stale=2000.0, timeout=150000.0)
    return found.select("event_type", "event_id", F.round("commanded", 4).alias("commanded"))


@query("""SELECT e.user_id % 3 AS shard, e.event_id, v.value AS value
FROM (SELECT *, user_id % 3 AS shard FROM events WHERE event_type <> 'click') e
ASOF LEFT JOIN (SELECT user_id % 3 AS shard, event_id, value FROM events WHERE event_type = 'click') v ON v.shard = e.shard AND e.event_id >= v.event_id""")
def as_of_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest click at or before each other event, in three keys with a third of all rows each."""
    rows = events(spark, sf_dir, (F.col("user_id") % 3).alias("shard"), "event_id", "event_type", "value")
    clicks = rows.filter("event_type = 'click'").select("shard", "event_id", "value")
    return summaries.as_of_bucketed(rows.filter("event_type <> 'click'").select("shard", "event_id"), clicks, ["shard"], "event_id", "value")


@query("""WITH h AS (SELECT user_id, event_id, value, event_id % 7 AS actual,
  coalesce(abs(value - lag(value) OVER w) >= 5 AND abs(event_id % 7 - lag(event_id % 7) OVER w) < 4, false) AS hit
  FROM events WHERE event_id % 11 <> 0 WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
r AS (SELECT *, sum((NOT hit)::INT) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS run FROM h),
p AS (SELECT *, sum(hit::INT) OVER (PARTITION BY user_id, run ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS place FROM r)
SELECT user_id, event_id, 'recover' AS event FROM p WHERE hit AND place % 3 = 0""")
def stall_recoveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the watchdog asks for, by the step that also runs in streams; reads that failed (every eleventh) are passed over."""
    actual = F.when(F.col("event_id") % 11 != 0, (F.col("event_id") % 7).cast("double"))
    rows = events(spark, sf_dir, "user_id", "event_id", "value").withColumn("actual", actual)
    watched = steps.over_table(rows, ["user_id"], ["event_id"], ["value", "actual"], steps.Stall(5.0, 4.0))
    return steps.recoveries(watched, ["user_id"], "event_id")


@query("""WITH a AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS attempt FROM events)
SELECT user_id, min(event_id) FILTER (WHERE value <= 100) AS event_id, arg_min(value, event_id) FILTER (WHERE value <= 100) AS value FROM a WHERE attempt <= 8 GROUP BY user_id""")
def retry_bounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight attempts and no more; null where none is plausible."""
    rows = events(spark, sf_dir, "user_id", "event_id", "value")
    return series.first_plausible(rows, ["user_id"], "event_id", F.col("value") <= 100, "value", max_attempts=series.MAX_ATTEMPTS)


@query("""WITH p AS (SELECT vec_id, unnest(range(0, 32)) AS pair, embedding AS e FROM embeddings),
q AS (SELECT vec_id, pair::INT AS pair, e[2 * pair + 1]::DOUBLE AS a, e[2 * pair + 2]::DOUBLE AS d FROM p)
SELECT vec_id, pair, round(-9.81 * cos(a) * (2.0 * 0.5 + 1.5 * (1.0 + d) + 0.25 * (1.2 + 3 * d)), 6) AS turning, round(-9.81 * sin(a) * (1.5 + 0.25 * 3), 6) AS sliding FROM q""")
def gravity_arm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Holding torque and force of an arm that turns about y and slides out, with a mimic joint that slides on by twice as much."""
    at = lambda x: [x, 0.0, 0.0]
    joints = spark.createDataFrame(
        [
            ("turn", "revolute", "base", "arm", None, None, [0.0, 1.0, 0.0], None, None, None),
            ("slide", "prismatic", "arm", "rod", None, at(1.0), at(1.0), None, None, None),
            ("more", "prismatic", "rod", "tip", None, at(0.2), at(1.0), "slide", 2.0, None),
        ],
        "name string, type string, parent string, child string, rpy array<double>, xyz array<double>, axis array<double>, mimic string, multiplier double, offset double",
    )
    links = spark.createDataFrame([("arm", 2.0, at(0.5)), ("rod", 1.5, at(0.0)), ("tip", 0.25, at(0.0))], "name string, mass double, centre array<double>")
    tree = kinematics.Tree.from_joints(joints, "base", links)
    pairs = table(spark, sf_dir, "embeddings").select("vec_id", F.explode(F.sequence(F.lit(0), F.lit(31))).alias("pair"), "embedding")
    q = F.array(*(F.get("embedding", 2 * F.col("pair") + k).cast("double") for k in (0, 1)))
    found = kinematics.gravity_torques(pairs.select("vec_id", "pair", q.alias("q")), tree)
    return found.select("vec_id", "pair", F.round(F.col("tau")[0], 6).alias("turning"), F.round(F.col("tau")[1], 6).alias("sliding"))


@query("""SELECT user_id AS episode_index, event_id AS frame_index, CASE WHEN user_id % 10 = 0 THEN value * 2 ELSE value END AS value,
  CASE WHEN event_type = 'click' THEN 'tap' ELSE event_type END AS task FROM events WHERE user_id < 70 AND user_id % 10 <> 5""")
def dataset_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a versioned episode dataset: written, some episodes replaced, a value replaced in place, and read by a pushed filter."""
    root = f"{run_dir(spark)}/episodes-{uuid.uuid4().hex}"
    rows = events(spark, sf_dir, F.col("user_id").alias("episode_index"), F.col("event_id").alias("frame_index"), "value", F.col("event_type").alias("task"))
    dataset.write(rows, root)
    dataset.write(rows.filter("episode_index % 10 = 0").withColumn("value", 2 * F.col("value")), root, mode="replace")
    dataset.replace_value(spark, root, "task", "click", "tap")
    return dataset.read(spark, root).filter("episode_index < 70 AND episode_index % 10 <> 5")


@query("""SELECT event_id, (user_id % 2048)::BIGINT AS can_id, CASE WHEN event_id % 4 = 0 THEN 12 ELSE event_id % 9 END::INT AS dlc,
  CASE WHEN event_id % 4 = 0 THEN 12 ELSE event_id % 9 END::BIGINT AS bytes, lpad(hex(event_id % 256), 2, '0') AS first
FROM events WHERE event_id % 5 <> 0 AND (event_id % 4 = 0 OR event_id % 9 > 0)""")
def capture_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Socket frames of 16 and 72 bytes, made from events, taken apart; frames of other sizes (every fifth) drop out."""
    key, long = F.col("event_id"), F.col("event_id") % 4 == 0
    dlc = F.when(long, 12).otherwise(key % 9).cast("int")
    head = F.concat(F.format_string("%02X%02X0000", F.col("user_id") % 256, (F.col("user_id") % 2048 / 256).cast("int")), F.format_string("%02X", dlc), F.when(long, "04").otherwise("00"), F.lit("0000"))
    data = F.rpad(F.format_string("%02X", key % 256), F.when(long, 128).otherwise(16).cast("int"), F.lit("AB"))
    raw = F.unhex(F.concat(head, data, F.when(key % 5 == 0, "00").otherwise("")))
    found = robot.split_frames(events(spark, sf_dir, "event_id", raw.alias("raw"))).filter("dlc > 0")
    return found.select("event_id", "can_id", "dlc", F.length("data").cast("long").alias("bytes"), F.hex(F.substring("data", 1, 1)).alias("first"))
