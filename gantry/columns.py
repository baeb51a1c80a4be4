"""Names of columns, and tables of bounded size."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fresh(name: str, taken: Iterable[str]) -> str:
    """A column name like ``name`` that none of ``taken`` has, whatever its case."""
    lowered = {t.lower() for t in taken}
    while name.lower() in lowered:
        name += "_"
    return name


def named(column: str) -> Column:
    """The column of just this name, dots and all."""
    return F.col("`" + column.replace("`", "``") + "`")


def same_keys(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    """Equal keys, nulls too."""
    out = F.lit(True)
    for k in keys:
        out = out & left[f"`{k}`"].eqNullSafe(right[f"`{k}`"])
    return out


def small(df: DataFrame, rows: int, what: str) -> DataFrame:
    """``df`` marked for broadcasting, as it has at most ``rows`` rows; more are an error.  One job, while this is built."""
    if len(df.limit(rows + 1).take(rows + 1)) > rows:
        raise ValueError(f"{what}: more than {rows} rows")
    return F.broadcast(df)
