"""Sinks: columnar tables for stages, JSON for export, partitioned logs and metric tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..durable import forget, written


def table(df: DataFrame, path: str, *by: str) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def one_document(df: DataFrame, key: str) -> DataFrame:
    """One row, document: a JSON object by key, for exports that fit one value."""
    rest = F.struct(*(c for c in df.columns if c != key))
    return df.agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(key), rest))))).alias("document"))


def later_wins(first: DataFrame, second: DataFrame, key: str, overwrite: bool = True) -> DataFrame:
    """Two folders copied into one: on a shared key the second replaces the first, or not."""
    keep, over = (second, first) if overwrite else (first, second)
    return keep.unionByName(over.join(keep.select(key), key, "left_anti"))


def merged_folder(first: str, second: DataFrame, key: str, by: str, overwrite: bool = True) -> list:
    """Copy `second` into the folder `first`, which is partitioned by the column `by`; returns the partitions that were written.

    Only partitions that `second` has rows of are read and replaced, so the others keep their files. `by` follows from the key (a
    range or a hash of it), so a key is in one partition. The number of touched partitions reaches the driver. overwrite: as in :func:`later_wins`.
    """
    spark = second.sparkSession
    touched = sorted(r[0] for r in second.select(by).distinct().collect())
    old = spark.read.parquet(first).filter(F.col(by).isin(touched)) if touched else second.limit(0)
    merged = written(later_wins(old.select(*second.columns), second, key, overwrite))  # what is read is replaced below
    if touched:
        merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(first)
    forget(merged)
    return touched


def quarantine(df: DataFrame, ok: Column) -> tuple[DataFrame, DataFrame]:
    """(good, bad) rows; null conditions are bad."""
    good = F.coalesce(ok, F.lit(False))
    return df.filter(good), df.filter(~good)


def error_log(bad: DataFrame, by: str, message: str, samples: int = 10) -> DataFrame:
    """(type, message, n, sample keys): quarantined rows by page type and what is wrong, for a partitioned log."""
    first = F.slice(F.array_sort(F.collect_set("key")), 1, samples)
    rows = bad.withColumn("__n", F.row_number().over(Window.partitionBy(by, message).orderBy("key")))
    few = rows.filter(F.col("__n") <= samples).groupBy(by, message).agg(first.alias("samples"))
    return bad.groupBy(by, message).agg(F.count("*").alias("n")).join(few, [by, message])


def sorted_by_key(df: DataFrame, key: str) -> DataFrame:
    """In code-point order of the key, which is the order of UTF-8 bytes."""
    return df.orderBy(key)


def metrics_table(df: DataFrame, name: str, metric: str, value: str, metrics: list[str] | None = None) -> DataFrame:
    """One row a name, one column a metric; without a list, the sorted union of the metrics' names."""
    metrics = metrics if metrics is not None else sorted(r[0] for r in df.select(metric).distinct().collect())
    return df.groupBy(name).pivot(metric, metrics).agg(F.first(value))


def stub(term: Column, definition: Column, cats: Column) -> Column:
    """A page for a glossary term that has none."""
    return F.concat(F.lit("# "), term, F.lit("\n\n<!-- Categories: "), F.array_join(cats, ", "), F.lit(" -->\n\n## Definition\n\n"), F.coalesce(definition, F.lit("")))
