"""Forms of a frame: long (one row per channel, the canonical form), wide, map and vector."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gantry.functions.scalars import SIDES

CHANNELS = [f"{side}J{joint}.pos" for side in SIDES for joint in range(1, 9)]


def wide_to_long(df: DataFrame, keys: list[str], channels: list[str] | None = None) -> DataFrame:
    channels = [c for c in channels or CHANNELS if c in df.columns]
    return df.unpivot([F.col(k) for k in keys], [F.col(f"`{c}`").cast("double").alias(c) for c in channels], "channel", "value")


def long_to_wide(df: DataFrame, keys: list[str], channels: list[str] | None = None) -> DataFrame:
    """The channels are given, so no job has to find them."""
    return df.groupBy(*keys).pivot("channel", channels or CHANNELS).agg(F.first("value"))


def long_to_map(df: DataFrame, keys: list[str]) -> DataFrame:
    """A frame has a fixed number of channels, so a group is small."""
    entries = F.sort_array(F.collect_list(F.struct("channel", "value")))
    return df.groupBy(*keys).agg(F.map_from_entries(entries).alias("frame"))


def map_to_long(df: DataFrame, frame: str = "frame") -> DataFrame:
    return df.select(*(c for c in df.columns if c != frame), F.explode(frame).alias("channel", "value"))


def select_tolerant(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns that ``df`` lacks come out null."""
    return df.select(*(F.col(f"`{c}`").alias(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in columns))


def renamed(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Columns by their new names; an error where one is missing or two would have the same name."""
    if missing := sorted(set(names) - set(df.columns)):
        raise KeyError(f"no columns {', '.join(missing)}")
    after = [names.get(c, c) for c in df.columns]
    if twice := sorted({c for c in after if after.count(c) > 1}):
        raise ValueError(f"two columns would be named {', '.join(twice)}")
    return df.toDF(*after)


def vector_to_fields(vector: Column, names: list[str]) -> list[Column]:
    return [F.get(vector, F.lit(k)).alias(name) for k, name in enumerate(names)]


def vector_to_map(vector: Column, names: Column) -> Column:
    """An error where the lengths differ."""
    return F.map_from_arrays(names, vector)


def fields_to_vector(names: list[str]) -> Column:
    """In the given order, in single precision as episode datasets store it."""
    return F.array(*(F.col(f"`{n}`") for n in names)).cast("array<float>")


def named(vector: Column, names: Column, name: str) -> Column:
    """The vector's entry at the name's place; null where there is no such name."""
    return F.when(F.array_contains(names, name), F.element_at(vector, F.array_position(names, F.lit(name)).cast("int")))


def keep_suffix(frame: Column, suffix: str) -> Column:
    return F.map_filter(frame, lambda k, _: k.endswith(suffix))


def keep_prefix(frame: Column, prefix: str) -> Column:
    return F.map_filter(frame, lambda k, _: k.startswith(prefix))


def first_with_prefix(frame: Column, prefix: str, default: float | None = None) -> Column:
    """The first entry with the prefix in the map's own order; without one the default, or an error if that is None."""
    found = F.filter(F.map_entries(frame), lambda e: e["key"].startswith(prefix))
    missing = F.raise_error(F.lit(f"no key begins with {prefix}")).cast("double") if default is None else F.lit(default)
    return F.when(F.size(found) > 0, F.get(found, F.lit(0))["value"]).otherwise(missing)


def merge(left: Column, right: Column) -> Column:
    """Both maps' entries; the right one's where both have a key."""
    only_left = F.map_filter(left, lambda k, _: ~F.map_contains_key(right, k))
    return F.map_concat(only_left, right)


def image_features(df: DataFrame) -> list[str]:
    """Names of columns whose metadata calls them images or videos."""
    return [f.name for f in df.schema.fields if f.metadata.get("dtype") in ("image", "video")]
