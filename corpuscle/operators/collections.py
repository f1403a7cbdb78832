"""Vector collections: unions with prefixed ids, flat metadata, counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def union(parts: dict[str, DataFrame], key: str) -> DataFrame:
    """All rows of all parts, ids prefixed by the part's name, so that they can't collide."""
    named = [df.withColumn(key, F.concat(F.lit(f"{name}_"), F.col(key).cast("string"))) for name, df in parts.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), named)


def flat(c: str, kind: str) -> Column:
    """A metadata value as text: lists joined by commas, null as 'null'."""
    value = F.array_join(c, ",", "None") if kind.startswith("array") else F.initcap(F.col(c).cast("string")) if kind == "boolean" else F.col(c).cast("string")
    return F.coalesce(value, F.lit("null"))


def flatten_metadata(df: DataFrame, *keep: str) -> DataFrame:
    """Every other column as text by :func:`flat`; the kept ones as they are."""
    return df.select(*keep, *(flat(c, kind).alias(c) for c, kind in df.dtypes if c not in keep))


def with_mentions(df: DataFrame, mentions: str) -> DataFrame:
    return df.filter(F.size(mentions) > 0)


def filtered_union(parts: dict[str, DataFrame], key: str, keep: Column, exclude: tuple[str, ...] = ()) -> DataFrame:
    """The union of the parts that aren't excluded, with the rows that the condition keeps; it is pushed below the union."""
    return union({name: df for name, df in parts.items() if name not in exclude}, key).filter(keep)


def with_metadata(df: DataFrame, text: str = "text", *keep: str) -> DataFrame:
    """The kept columns, the text, and all others as one struct, metadata."""
    rest = [c for c in df.columns if c != text and c not in keep]
    return df.select(*keep, text, F.struct(*rest).alias("metadata"))


def write(df: DataFrame, path: str, collection: str = "collection", key: str | None = None) -> dict[str, int]:
    """One folder a collection; readers prune to the ones they name. Returns the written rows by collection.

    key: ids that must be unique in a collection; a repeated one is an error, before anything is written.
    """
    if key and (twice := df.groupBy(collection, key).count().filter("count > 1").first()):
        raise ValueError(f"id {twice[1]!r} repeats in {twice[0]!r}")
    df.write.mode("overwrite").partitionBy(collection).parquet(path)
    return reopened(df.sparkSession, path, collection)


def reopened(spark: SparkSession, path: str, collection: str = "collection") -> dict[str, int]:
    """Rows by collection of what is stored, read anew."""
    return {r[0]: r[1] for r in spark.read.parquet(path).groupBy(collection).count().collect()}


def count_report(df: DataFrame, expected: DataFrame) -> DataFrame:
    """(collection, n, expected, ok) against (collection, expected); expected null: any number."""
    have = df.groupBy("collection").agg(F.count("*").alias("n"))
    out = expected.join(have, "collection", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return out.select("collection", "n", "expected", F.coalesce(F.col("n") == F.col("expected"), F.col("n") > 0).alias("ok"))
