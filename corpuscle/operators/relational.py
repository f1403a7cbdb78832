"""As-of and range joins as compositions of built-in operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scan import running


def asof(left: DataFrame, right: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """Each left row with `before_<value>`: of the key's last right row strictly before it, null without one.

    Both sides go in one order by key and time, right rows after left ones of the same time, and the last right value is
    carried forward by a prefix scan, so one key may hold any share of the rows.
    """
    both = left.select(key, at, value, F.lit(0).alias("__side")).unionByName(right.select(key, at, value, F.lit(1).alias("__side")))
    carried = running(both, [key], [at, "__side", value], lasts={f"before_{value}": F.when(F.col("__side") == 1, F.col(value))})
    return carried.filter("__side = 0").drop("__side")


def range_join(df: DataFrame, point: str, ranges: DataFrame, low: str, high: str, width: float) -> DataFrame:
    """Rows whose point is in [low, high): an equi-join on buckets of `width`, then the exact test."""
    buckets = F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width))
    spread = ranges.withColumn("__b", F.explode(buckets))
    rows = df.withColumn("__b", F.floor(F.col(point) / width))
    return rows.join(spread, "__b").filter((F.col(point) >= F.col(low)) & (F.col(point) < F.col(high))).drop("__b")
