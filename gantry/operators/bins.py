"""Hot keys cut into bins of their order, so that one key's rows are spread over many tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gantry.columns import fresh, named, same_keys


def place(at: str) -> Column:
    """Values of an order as numbers; their order stays, though values beyond 2^53 may fall together."""
    return named(at).cast("double")


def cuts(df: DataFrame, keys: list[str], at: str, bins: int) -> list[tuple[tuple, list[float]]]:
    """Of each key with more than a ``bins``-th of all rows, the places where its order is cut; at most ``2 * bins`` in all.

    Two jobs: rows by key, and quantiles of the hot keys alone, of which there are fewer than ``bins``.
    """
    count = fresh("rows", keys)
    by_key = df.groupBy(*map(named, keys)).agg(F.count(F.lit(1)).alias(count))
    total = df.count()
    hot = by_key.filter(F.col(count) > total / bins)
    held = hot.collect()
    if not held:
        return []
    parts = {tuple(r[:-1]): int(np.ceil(r[-1] * bins / total)) for r in held}
    finest = max(parts.values())
    shares = [k / finest for k in range(1, finest)]
    small = df.sparkSession.createDataFrame(held, hot.schema).drop(count)
    chosen = df.join(F.broadcast(small), same_keys(df, small, keys), "left_semi") if keys else df
    found = chosen.groupBy(*map(named, keys)).agg(F.percentile_approx(place(at), shares, 100 * finest).alias(fresh("cuts", keys))).collect()
    out = []
    for row in found:
        key, all_cuts = tuple(row[:-1]), row[-1] or []
        own = parts[key]
        chosen_cuts = sorted({all_cuts[min(len(all_cuts) - 1, round(k * finest / own) - 1)] for k in range(1, own)}) if all_cuts else []
        out.append((key, chosen_cuts))
    return out


def binned(df: DataFrame, keys: list[str], at: str, bins: int, taken: list[str] = ()) -> tuple[DataFrame, str, DataFrame | None]:
    """``df`` with a column that numbers the bin each row lies in (0 for keys that are not hot), its name, and the hot keys, fewer than ``bins``.

    Bins follow the order of ``at``, a number or time, nulls before all; rows of one ``at`` share a bin.
    """
    name = fresh("bin", [*df.columns, *taken])
    found = [(key, own) for key, own in cuts(df, keys, at, bins) if own]
    if not found:
        return df.withColumn(name, F.lit(0)), name, None
    hot = fresh("hot", [*df.columns, name])
    schema = df.select(*map(named, keys)).schema.add(hot, "integer")
    numbered = df.sparkSession.createDataFrame([(*key, k) for k, (key, _) in enumerate(found)], schema)
    of_hot = [np.array(own, float) for _, own in found]

    @F.arrow_udf("int")
    def number(which: pa.Array, x: pa.Array) -> pa.Array:
        key = pc.fill_null(which, -1).to_numpy(zero_copy_only=False)
        known = pc.is_valid(x).to_numpy(zero_copy_only=False)
        values = pc.fill_null(x, 0.0).to_numpy(zero_copy_only=False)
        out = np.zeros(len(key), np.int32)
        for k in np.unique(key[key >= 0]).tolist():
            here = np.flatnonzero((key == k) & known)
            out[here] = np.searchsorted(of_hot[k], values[here], "left")  # a cut ends its bin; NaN is beyond all
        return pa.array(out)

    if keys:
        joined = df.join(F.broadcast(numbered), same_keys(df, numbered, keys), "left").select(*(df[f"`{c}`"] for c in df.columns), F.col(hot))
    else:
        joined = df.withColumn(hot, F.lit(0))
    return joined.withColumn(name, number(F.col(hot), place(at))).drop(hot), name, numbered.drop(hot)
