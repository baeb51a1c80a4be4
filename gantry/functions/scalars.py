"""Scalar functions on robot values, as Column expressions.

Null in, null out everywhere: ``least`` and ``greatest`` skip nulls, so each clip is guarded.  NaN
stays NaN in ``clip_keep_nan``; in ``clip`` it becomes the upper bound, as with nested min and max.
All angles are radians; gripper values carry one of three units: raw motor units, simulated finger
radians (0 closed to 0.044 open), or a command from -1 (closed) to +1 (open).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the robot and its bus.
GRIPPER_SIM_OPEN = 0.044
CAN_POSITION_LIMIT = 12.5
CAN_POSITION_STEPS = 65535
MM_PER_FINGER_RADIAN = 2000.0
LEADER_GRIPPER_RATIO = -25.0
LEADER_GRAVITY_SCALE = 0.87
LEADER_WRIST_SCALE = 0.5
JOINTS = range(1, 8)
GRIPPER = 8
SIDES = ("L", "R")


def clip(x: Column, low: Column | float, high: Column | float) -> Column:
    low, high = _column(low), _column(high)
    return F.when(x.isNotNull(), F.greatest(low, F.least(high, x)))


def clip_keep_nan(x: Column, low: Column | float, high: Column | float) -> Column:
    return F.when(F.isnan(x), x).otherwise(clip(x, low, high))


def _column(x: Column | float) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def lerp(a: Column, b: Column, alpha: Column) -> Column:
    return a + alpha * (b - a)


def gripper_sim_to_raw(sim: Column, open_raw: Column, closed_raw: Column) -> Column:
    return lerp(closed_raw, open_raw, clip(sim / GRIPPER_SIM_OPEN, 0.0, 1.0))


def gripper_command_to_raw(command: Column, open_raw: Column, closed_raw: Column) -> Column:
    return lerp(closed_raw, open_raw, clip((command + 1) / 2, 0.0, 1.0))


def gripper_raw_to_sim(raw: Column, open_raw: Column, closed_raw: Column) -> Column:
    """An error, as any division by zero, where open and closed are the same."""
    return clip((raw - closed_raw) / (open_raw - closed_raw), 0.0, 1.0) * GRIPPER_SIM_OPEN


def joint_to_robot(q: Column, sign: Column, offset: Column) -> Column:
    return sign * q + offset


def joint_from_robot(q: Column, sign: Column, offset: Column) -> Column:
    return (q - offset) / sign


def gripper_width_mm(sim: Column) -> Column:
    return sim * MM_PER_FINGER_RADIAN


def leader_gripper(raw: Column) -> Column:
    return raw / LEADER_GRIPPER_RATIO


def leader_gravity(torque: Column, joint: Column) -> Column:
    """The leader's share of the gravity torque; its last wrist joint gets half of that."""
    return torque * LEADER_GRAVITY_SCALE * F.when(joint == 7, LEADER_WRIST_SCALE).otherwise(1.0)


def channel_name(side: Column, joint: Column) -> Column:
    return F.format_string("%sJ%d.pos", side, joint)


def channel_side(channel: Column) -> Column:
    return F.nullif(F.regexp_extract(channel, r"^([LR])J([1-8])\.pos$", 1), F.lit(""))


def channel_joint(channel: Column) -> Column:
    return F.nullif(F.regexp_extract(channel, r"^([LR])J([1-8])\.pos$", 2), F.lit("")).cast("int")


def is_gripper(channel: Column) -> Column:
    return channel.endswith(f"{GRIPPER}.pos")


def can_word(data: Column, first: int) -> Column:
    """Two bytes from position ``first`` (1 the first) as a big-endian number."""
    return F.conv(F.hex(F.substring(data, first, 2)), 16, 10).cast("int")


def can_byte(data: Column, at: int) -> Column:
    return F.conv(F.hex(F.substring(data, at, 1)), 16, 10).cast("int")


def can_position(code: Column) -> Column:
    return code / CAN_POSITION_STEPS * (2 * CAN_POSITION_LIMIT) - CAN_POSITION_LIMIT


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def log_loss(label: Column, p: Column) -> Column:
    """Infinite where the label's class has probability 0; a class without weight adds nothing."""

    def term(weight: Column, q: Column) -> Column:
        return F.when(weight == 0, 0.0).when(q == 0, float("-inf")).otherwise(weight * F.log(q))

    return -(term(label, p) + term(1 - label, 1 - p))
