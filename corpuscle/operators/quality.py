"""Constraints, profiles, histograms and samples over any stage's rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def issues(rules: list[tuple[str, Column]]) -> Column:
    """Messages of the rules that a row breaks, in order; a rule whose condition is null is broken."""
    return F.filter(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), message) for message, ok in rules)), lambda m: m.isNotNull())


def profile(df: DataFrame, *by: str, text: str = "text", levels: str = "group") -> DataFrame:
    """Rows, characters (total, average of non-empty, least, most) and estimated tokens.

    levels: 'group' for one row a group, 'rollup' for subtotals and a grand total as well.
    """
    n = F.length(text)
    grouped = df.rollup(*by) if levels == "rollup" else df.groupBy(*by)
    return grouped.agg(
        F.count("*").alias("n_rows"), F.sum(n).alias("total_chars"), F.round(F.avg(F.when(n > 0, n)), 6).alias("avg_chars"),
        F.min(n).cast("long").alias("min_chars"), F.max(n).cast("long").alias("max_chars"), F.round(F.sum(n) / 4, 2).alias("est_tokens"),
    )


def upper_median(df: DataFrame, value: Column) -> DataFrame:
    """One row, median: of n sorted values the one at n div 2."""
    # A counted map of the distinct values, merged before the shuffle; of descending values the middle of n is the upper one.
    return df.select(value.alias("v")).agg(F.expr("percentile_disc(0.5) within group (order by v desc)").cast("long").alias("median"))


def histogram(df: DataFrame, value: Column, edges: list[int]) -> DataFrame:
    """(bucket, n) of half-open ranges between the edges; from the last edge on is one bucket."""
    bucket = F.lit(0)
    for k, e in enumerate(edges[1:], 1):
        bucket = F.when(value >= e, k).otherwise(bucket)
    return df.select(bucket.cast("long").alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n"))


def most_common(df: DataFrame, value: str, n: int) -> DataFrame:
    return df.groupBy(value).agg(F.count("*").alias("n")).orderBy(F.desc("n"), value).limit(n)


def sample(df: DataFrame, n: int, order: Column, key: str) -> DataFrame:
    """n rows without replacement, by a fixed pseudo-random order: a heap of n a task."""
    return df.orderBy(order, key).limit(n)


def stratified(df: DataFrame, stratum: str, key: str, n: int, order: Column) -> DataFrame:
    """n rows of each stratum, by a fixed pseudo-random order; groups are cut before they are sorted."""
    w = Window.partitionBy(stratum).orderBy(order, key)
    return df.withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= n).drop("__n")


def sequential(df: DataFrame, key: str, number: str) -> DataFrame:
    """By key: how many numbers, whether they are 1..n, and whether some repeat."""
    return df.groupBy(key).agg(
        F.count("*").alias("n"), ((F.min(number) == 1) & (F.max(number) == F.count("*")) & (F.count_distinct(number) == F.count("*"))).alias("sequential"),
        (F.count_distinct(number) < F.count("*")).alias("repeats"),
    )
