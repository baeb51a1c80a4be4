"""Kinematics over a robot description: joint tree, limits, damped steps and gravity.

The description is a small fixed table, read once to the driver as a ``Tree`` or ``Chain``; frames stay distributed and
go through Arrow batches, whole batches at a time.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GRAVITY = 9.81


def joint_tree(spark, joints: DataFrame, root: str) -> DataFrame:
    """``joint, link, depth, path`` of everything below the root link."""
    start = spark.createDataFrame([(root,)], "link string")
    return spark.sql(
        """
        WITH RECURSIVE tree(joint, link, depth, path) AS (
          SELECT CAST(NULL AS STRING), link, 0, link FROM {start}
          UNION ALL
          SELECT j.name, j.child, depth + 1, concat(path, '/', j.child) FROM tree JOIN {joints} j ON j.parent = tree.link)
        SELECT joint, link, depth, path FROM tree WHERE joint IS NOT NULL""",
        start=start,
        joints=joints,
    )


def limit_violations(frames: DataFrame, joints: DataFrame) -> DataFrame:
    """Frames (long) outside the limits of their joint."""
    limits = joints.filter("lower IS NOT NULL").select(F.col("name").alias("channel"), "lower", "upper")
    return frames.join(limits, "channel").filter((F.col("value") < F.col("lower")) | (F.col("value") > F.col("upper")))


TURNING, SLIDING, RIGID = ("revolute", "continuous"), "prismatic", "fixed"
MAX_JOINTS = 10_000


@dataclass
class Tree:
    """Joints, each after the one it hangs on: fixed transforms before each, axes, and what moves them.

    Coordinates are the joints that move by themselves, in this order.  A mimic joint moves by ``ratio`` times the coordinate of another plus ``offset``;
    if that joint lies elsewhere in the description its coordinate comes after the others.
    """

    names: list[str]
    before: np.ndarray  # (joints, 4, 4)
    axes: np.ndarray  # (joints, 3)
    moving: np.ndarray  # bool
    masses: np.ndarray | None = None  # of the link after each joint
    centres: np.ndarray | None = None
    parents: list[int] | None = None  # the joint each hangs on, -1 for the root; by default the one before
    sliding: np.ndarray | None = None  # bool
    source: np.ndarray | None = None  # the coordinate of each that moves
    ratio: np.ndarray | None = None
    offset: np.ndarray | None = None
    coordinates: list[str] | None = None

    def __post_init__(self) -> None:
        n = len(self.names)
        self.moving = np.asarray(self.moving, bool)
        self.parents = list(range(-1, n - 1)) if self.parents is None else self.parents
        self.sliding = np.zeros(n, bool) if self.sliding is None else self.sliding
        self.source = np.cumsum(self.moving) - 1 if self.source is None else self.source
        self.ratio = np.ones(n) if self.ratio is None else self.ratio
        self.offset = np.zeros(n) if self.offset is None else self.offset
        if self.coordinates is None:
            self.coordinates = [name for name, moves in zip(self.names, self.moving, strict=True) if moves]

    @classmethod
    def _of(cls, rows: list, known: dict, links: DataFrame | None) -> Tree:
        """From joint rows, each after the one it hangs on; ``known`` has all joints of the description by name."""
        at = {r["child"]: k for k, r in enumerate(rows)}
        names = [r["name"] for r in rows]
        moves = np.array([r["type"] in TURNING or r["type"] == SLIDING for r in rows], bool)
        if odd := sorted({r["type"] for r in rows} - {*TURNING, SLIDING, RIGID}):
            raise ValueError(f"joints of type {', '.join(map(str, odd))} are not known")
        followed = [_followed(r, known) if m else (None, 1.0, 0.0) for r, m in zip(rows, moves, strict=True)]
        own = [name for name, (master, _, _) in zip(names, followed, strict=True) if master == name]
        coordinates = own + sorted({master for master, _, _ in followed if master is not None and master not in own})
        tree = cls(
            names, np.stack([transform(r["rpy"] or [0.0] * 3, r["xyz"] or [0.0] * 3) for r in rows]) if rows else np.zeros((0, 4, 4)),
            np.array([r["axis"] or [1.0, 0.0, 0.0] for r in rows], float).reshape(-1, 3), moves,
            parents=[at.get(r["parent"], -1) for r in rows], sliding=np.array([r["type"] == SLIDING for r in rows], bool),
            source=np.array([coordinates.index(m) if m is not None else -1 for m, _, _ in followed], int),
            ratio=np.array([x for _, x, _ in followed]), offset=np.array([x for _, _, x in followed]), coordinates=coordinates,
        )
        if links is not None:
            bodies = {r["name"]: r for r in links.filter(F.col("mass").isNotNull()).limit(MAX_JOINTS + 1).collect()}
            of = [bodies.get(r["child"]) for r in rows]
            tree.masses = np.array([0.0 if b is None else b["mass"] for b in of])
            tree.centres = np.array([[0.0] * 3 if b is None else b["centre"] or [0.0] * 3 for b in of]).reshape(-1, 3)
        return tree

    @classmethod
    def from_joints(cls, joints: DataFrame, root: str, links: DataFrame | None = None) -> Tree:
        """All that hangs on the link ``root``; an error where a link hangs on two joints.

        ``links`` (``name, mass, centre``, as ``robot.read_links`` gives) has the masses; a link without one weighs nothing.
        """
        below: dict[str, list] = {}
        known = _collected(joints)
        for r in known.values():
            below.setdefault(r["parent"], []).append(r)
        rows, waiting = [], [root]
        while waiting:
            for r in sorted(below.get(waiting.pop(0), []), key=lambda r: r["name"]):
                rows.append(r)
                waiting.append(r["child"])
        return cls._of(rows, known, links)

    def placed(self, q: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        """For frames of coordinates (n, m), one pass from the root outwards: transforms after each joint; origins and axes (n, joints, 3) in the base frame."""
        after: list[np.ndarray] = []
        origins, axes = np.empty((len(q), len(self.names), 3)), np.empty((len(q), len(self.names), 3))
        base = np.broadcast_to(np.eye(4), (len(q), 4, 4))
        for k, (up, fixed, axis) in enumerate(zip(self.parents, self.before, self.axes, strict=True)):
            now = (after[up] if up >= 0 else base) @ fixed
            axis = axis / np.linalg.norm(axis)
            origins[:, k], axes[:, k] = now[:, :3, 3], now[:, :3, :3] @ axis
            if self.moving[k]:
                value = self.ratio[k] * q[:, self.source[k]] + self.offset[k]
                move = np.broadcast_to(np.eye(4), (len(q), 4, 4)).copy()
                if self.sliding[k]:
                    move[:, :3, 3] = value[:, None] * axis
                else:
                    move[:, :3, :3] = rotation(axis, value)
                now = now @ move
            after.append(now)
        return after, origins, axes

    def gravity(self, q: np.ndarray) -> np.ndarray:
        """(n, m): forces and torques of the coordinates that hold the links' masses still.

        Recursive Newton-Euler at rest: a pass outwards places the links, a pass inwards hands each joint's force and moment (about the base's
        origin) to the one it hangs on.
        """
        if self.masses is None:
            raise ValueError("the chain has no masses" if isinstance(self, Chain) else "the tree has no masses")
        after, origins, axes = self.placed(q)
        up = np.array([0.0, 0.0, GRAVITY])
        force = np.array(self.masses)[:, None] * up  # of each subtree, which is the same in all frames
        moment = np.empty((len(self.names), len(q), 3))
        for k, (pose, mass, centre) in enumerate(zip(after, self.masses, self.centres, strict=True)):
            moment[k] = np.cross(pose[:, :3, 3] + pose[:, :3, :3] @ centre, mass * up)
        total = np.zeros((len(q), len(self.coordinates)))
        for k in range(len(self.names) - 1, -1, -1):
            if self.moving[k]:
                if self.sliding[k]:
                    own = axes[:, k] @ force[k]
                else:
                    own = ((moment[k] - np.cross(origins[:, k], force[k])) * axes[:, k]).sum(1)
                total[:, self.source[k]] += self.ratio[k] * own
            if self.parents[k] >= 0:
                force[self.parents[k]] += force[k]
                moment[self.parents[k]] += moment[k]
        return total


def _collected(joints: DataFrame) -> dict[str, dict]:
    """Joints by name; a description has some dozens, and no more than ``MAX_JOINTS``."""
    rows = [r.asDict() for r in joints.limit(MAX_JOINTS + 1).collect()]
    if len(rows) > MAX_JOINTS:
        raise ValueError(f"more than {MAX_JOINTS} joints")
    for what in ("name", "child"):
        each = [r[what] for r in rows]
        if twice := sorted({x for x in each if each.count(x) > 1}):
            raise ValueError(f"{what} {', '.join(twice)} is there twice")
    return {r["name"]: r for r in rows}


def _followed(row: dict, known: dict) -> tuple[str, float, float]:
    """The joint whose coordinate moves this one, with ratio and offset; mimics of mimics are followed up."""
    ratio, offset, seen = 1.0, 0.0, [row["name"]]
    while row.get("mimic") is not None:
        own = 1.0 if row.get("multiplier") is None else row["multiplier"]
        ratio, offset = ratio * own, offset + ratio * (row.get("offset") or 0.0)
        if row["mimic"] not in known:
            raise KeyError(f"joint {row['name']} mimics {row['mimic']}, which is not there")
        row = known[row["mimic"]]
        if row["name"] in seen:
            raise ValueError(f"joints {', '.join(seen)} mimic each other")
        seen.append(row["name"])
    return row["name"], ratio, offset


class Chain(Tree):
    """The joints from a base to a tip."""

    @classmethod
    def from_joints(cls, joints: DataFrame, base: str, tip: str, links: DataFrame | None = None) -> Chain:
        """The path from ``base`` to ``tip``; an error where a link is missing."""
        known = _collected(joints)
        rows = {r["child"]: r for r in known.values()}
        path, link = [], tip
        while link != base:
            if link not in rows or len(path) > len(rows):
                raise KeyError(f"no joint leads to link {link}")
            path.append(rows[link])
            link = rows[link]["parent"]
        return cls._of(path[::-1], known, links)

    def poses(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Tip transforms, and of the joints that move their origins and axes in the base frame."""
        after, origins, axes = self.placed(q)
        tip = after[-1] if after else np.broadcast_to(np.eye(4), (len(q), 4, 4))
        return tip, origins[:, self.moving], axes[:, self.moving]

    def jacobian(self, q: np.ndarray) -> np.ndarray:
        """(n, 6, m): linear over angular velocity of the tip by coordinate, along the base's axes."""
        tip, origins, axes = self.poses(q)
        slides = self.sliding[self.moving][None, :, None]
        linear = np.where(slides, axes, np.cross(axes, tip[:, None, :3, 3] - origins))
        each = np.concatenate([linear, np.where(slides, 0.0, axes)], 2) * self.ratio[self.moving][None, :, None]
        out = np.zeros((len(q), 6, len(self.coordinates)))
        for k, column in enumerate(self.source[self.moving]):
            out[:, :, column] += each[:, k]
        return out


def transform(rpy, xyz) -> np.ndarray:
    r, p, y = rpy
    out = np.eye(4)
    turns = (rotation(np.array(a, float), np.array([v]))[0] for a, v in (((0, 0, 1), y), ((0, 1, 0), p), ((1, 0, 0), r)))
    out[:3, :3] = np.linalg.multi_dot(list(turns))
    out[:3, 3] = xyz
    return out


def rotation(axis: np.ndarray, angle: np.ndarray) -> np.ndarray:
    """Rotations about one axis by many angles (Rodrigues)."""
    x, y, z = axis / np.linalg.norm(axis)
    cross = np.array([[0, -z, y], [z, 0, -x], [-y, x, 0]])
    s, c = np.sin(angle)[:, None, None], np.cos(angle)[:, None, None]
    return np.eye(3) + s * cross + (1 - c) * (cross @ cross)


def damped_step(jacobian: np.ndarray, delta: np.ndarray, damping: float) -> np.ndarray:
    """Least-squares joint steps for pose steps, (n, 6, m) and (n, 6), damped near singular poses."""
    square = jacobian @ jacobian.transpose(0, 2, 1) + damping**2 * np.eye(jacobian.shape[1])
    return (jacobian.transpose(0, 2, 1) @ np.linalg.solve(square, delta[..., None]))[..., 0]


def _rows(*columns: pd.Series, sizes: list[int]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Which rows have arrays of these sizes, all of them numbers (a null in an array arrives as NaN), and their values."""
    fits = lambda x, size: x is not None and len(x) == size and np.isfinite(np.asarray(x, float)).all()
    good = np.array([all(fits(x, size) for x, size in zip(row, sizes, strict=True)) for row in zip(*columns, strict=True)], bool)
    return good, [np.stack(c[good].to_numpy()).astype(float) if good.any() else np.zeros((0, size)) for c, size in zip(columns, sizes, strict=True)]


def _spread(good: np.ndarray, values: np.ndarray) -> pd.Series:
    """Values of the good rows; null for the others."""
    out = np.full(len(good), None, object)
    for k, value in zip(np.flatnonzero(good), values, strict=True):
        out[k] = value
    return pd.Series(out)


def ik_step(df: DataFrame, chain: Chain, q: str = "q", delta: str = "delta", damping: float = 0.01, output: str = "q_next") -> DataFrame:
    """Adds the coordinates after one damped step; ``q`` and ``delta`` are arrays of doubles.  Null where one is null, has a null or NaN, or is of the wrong length."""

    @F.pandas_udf("array<double>")
    def step(q: pd.Series, delta: pd.Series) -> pd.Series:
        good, (at, by) = _rows(q, delta, sizes=[len(chain.coordinates), 6])
        return _spread(good, at + damped_step(chain.jacobian(at), by, damping))

    return df.withColumn(output, step(q, delta))


def dls(df: DataFrame, rows: int, columns: int, damping: float, output: str = "dq") -> DataFrame:
    """Adds the damped step for given Jacobians: ``jacobian`` flattened by rows, ``delta``.  Null where one is null, has a null or NaN, or is of the wrong length."""

    @F.pandas_udf("array<double>")
    def step(jacobian: pd.Series, delta: pd.Series) -> pd.Series:
        good, (flat, by) = _rows(jacobian, delta, sizes=[rows * columns, rows])
        return _spread(good, damped_step(flat.reshape(-1, rows, columns), by, damping))

    return df.withColumn(output, step("jacobian", "delta"))


def tips(df: DataFrame, chain: Chain, q: str = "q") -> DataFrame:
    """Adds ``tip`` (x, y, z) and ``jacobian`` (6 rows, flattened), both null where ``q`` is null, has a null or NaN, or is of the wrong length."""

    def found(value) -> Column:
        @F.pandas_udf("array<double>")
        def each(q: pd.Series) -> pd.Series:
            good, (at,) = _rows(q, sizes=[len(chain.coordinates)])
            return _spread(good, value(at))

        return each(q)

    return df.withColumns({"tip": found(lambda at: chain.poses(at)[0][:, :3, 3]), "jacobian": found(lambda at: chain.jacobian(at).reshape(len(at), -1))})


def gravity_torques(df: DataFrame, tree: Tree, q: str = "q", output: str = "tau") -> DataFrame:
    """Adds what holds the links still, by coordinate.  Null where ``q`` is null, has a null or NaN, or is of the wrong length."""

    @F.pandas_udf("array<double>")
    def torques(q: pd.Series) -> pd.Series:
        good, (at,) = _rows(q, sizes=[len(tree.coordinates)])
        return _spread(good, tree.gravity(at))

    return df.withColumn(output, torques(q))
