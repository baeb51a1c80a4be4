import math

import pytest
from pyspark.sql import functions as F

from gantry.functions import frames, packets, scalars
from gantry.operators import filters


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def ends():
    return F.lit(-1.1755), F.lit(0.0093)



@pytest.mark.parametrize("sim, raw", [(0.044, -1.1755), (0.0, 0.0093), (0.022, -0.5831), (1.0, -1.1755), (-1.0, 0.0093)])
def test_gripper_from_sim(spark, sim, raw):
    assert one(spark, scalars.gripper_sim_to_raw(F.lit(sim), *ends())) == pytest.approx(raw)


@pytest.mark.parametrize("command, raw", [(1.0, -1.1755), (-1.0, 0.0093), (0.0, -0.5831), (1.7, -1.1755)])
def test_gripper_from_command(spark, command, raw):
    assert one(spark, scalars.gripper_command_to_raw(F.lit(command), *ends())) == pytest.approx(raw)


def test_nulls_and_nan(spark):
    null = F.lit(None).cast("double")
    assert one(spark, scalars.clip(null, -1, 1)) is None
    assert one(spark, scalars.clip(F.lit(float("nan")), -1.0, 1.0)) == 1.0
    assert math.isnan(one(spark, scalars.clip_keep_nan(F.lit(float("nan")), -1.0, 1.0)))
    assert one(spark, filters.plausible(F.lit("LJ1.pos"), F.lit(float("nan")))) is False
    assert one(spark, filters.plausible(F.lit("LJ1.pos"), F.lit(3.2))) is True
    assert one(spark, filters.plausible(F.lit("LJ8.pos"), F.lit(9.0), include_gripper=False)) is True
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO"):
        one(spark, scalars.gripper_raw_to_sim(F.lit(1.0), F.lit(1.0), F.lit(1.0)))


def test_channels(spark):
    assert one(spark, scalars.channel_name(F.lit("L"), F.lit(3))) == "LJ3.pos"
    assert (one(spark, scalars.channel_side(F.lit("RJ8.pos"))), one(spark, scalars.channel_joint(F.lit("RJ8.pos")))) == ("R", 8)
    assert one(spark, scalars.channel_joint(F.lit("RJ9.pos"))) is None


def test_can(spark):
    assert one(spark, scalars.can_position(F.lit(85))) == pytest.approx(-12.467574578)
    assert one(spark, filters.can_id(F.lit(0x80000123))) == 0x123
    assert one(spark, filters.can_id(F.lit(0xF123))) == 0x123


def test_leader_and_toys(spark):
    assert one(spark, scalars.leader_gripper(F.lit(5.0))) == -0.2
    assert one(spark, scalars.leader_gravity(F.lit(1.0), F.lit(7))) == pytest.approx(0.435)
    assert one(spark, scalars.sigmoid(F.lit(0.0))) == 0.5
    assert one(spark, scalars.log_loss(F.lit(1), F.lit(1.0))) == 0.0


def test_packets(spark):
    good = '{"seq": 4, "t": 1.5, "joints": {"a": 0.25}}'
    rows = [(v,) for v in (good, "{", "[1]", "null", '{"seq": 1}', '{"joints": {"a": 1}}', None, "")]
    found = packets.parse_packets(spark.createDataFrame(rows, "value string")).collect()
    assert [(r["seq"], r["joints"]) for r in found] == [(4, {"a": 0.25})]
    assert one(spark, packets.feedback(F.lit(1.5), F.create_map(F.lit("a"), F.lit(2.0)))) == '{"t":1.5,"joints":{"a":2.0}}'


def test_forms(spark):
    wide = spark.createDataFrame([(1, 0, 0.5, None)], "episode int, step int, `LJ1.pos` double, `RJ8.pos` double")
    long = frames.wide_to_long(wide, ["episode", "step"])
    assert {(r["channel"], r["value"]) for r in long.collect()} == {("LJ1.pos", 0.5), ("RJ8.pos", None)}
    back = frames.long_to_wide(long, ["episode", "step"]).first()
    assert (back["LJ1.pos"], back["RJ8.pos"], back["LJ2.pos"]) == (0.5, None, None)
    assert frames.long_to_map(long, ["episode"]).first()["frame"] == {"LJ1.pos": 0.5, "RJ8.pos": None}
    assert frames.map_to_long(frames.long_to_map(long, ["episode"])).count() == 2
    assert frames.select_tolerant(wide, ["LJ1.pos", "none"]).first() == (0.5, None)
    assert wide.select(frames.fields_to_vector(["RJ8.pos", "LJ1.pos"])).first()[0] == [None, 0.5]


def test_maps(spark):
    m = F.create_map(F.lit("b"), F.lit(1.0), F.lit("a1"), F.lit(2.0), F.lit("a2"), F.lit(3.0))
    assert one(spark, frames.first_with_prefix(m, "a")) == 2.0
    assert one(spark, frames.first_with_prefix(m, "z", 0.0)) == 0.0
    assert one(spark, frames.merge(m, F.create_map(F.lit("b"), F.lit(9.0)))) == {"a1": 2.0, "a2": 3.0, "b": 9.0}
    with pytest.raises(Exception, match="no key begins"):
        one(spark, frames.first_with_prefix(m, "z"))
    with pytest.raises(Exception, match="same length"):
        one(spark, frames.vector_to_map(F.array(F.lit(1.0)), F.array(F.lit("a"), F.lit("b"))))
    assert one(spark, frames.named(F.array(F.lit(1.0)), F.array(F.lit("a")), "b")) is None


def test_renamed(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    assert frames.renamed(df, {"a": "x"}).columns == ["x", "b"]
    assert frames.renamed(df, {"a": "b", "b": "a"}).columns == ["b", "a"]
    with pytest.raises(ValueError, match="named b"):
        frames.renamed(df, {"a": "b"})
    with pytest.raises(KeyError, match="z"):
        frames.renamed(df, {"z": "y"})


def test_image_features(spark):
    df = spark.range(1).select(*(F.lit(1).alias(n, metadata={"dtype": d}) for n, d in (("a", "image"), ("b", "float32"), ("c", "video"))))
    assert frames.image_features(df) == ["a", "c"]
