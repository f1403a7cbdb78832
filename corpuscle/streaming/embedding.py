"""Embedding of arriving files that can break off anywhere and go on.

Each batch of the stream writes its vectors into a folder of its own and then, as its commit, a row a file
into the progress table. Both are overwritten when Spark runs a batch again, and vectors count only with a
commit, so a row is there once whatever broke off in between.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.embed import embed, hash_embedder


def run(spark: SparkSession, source: str, schema: str, key: str, text: str, to: str, embedder: Callable[[list[str]], np.ndarray] = hash_embedder, files: int = 100, batch: int = 100, after_write: Callable[[int], None] | None = None) -> None:
    """Embed the Parquet files of `source` that no run has yet, `files` a batch, and stop.

    In `to`: vectors (key, file, embedding), progress (file, n_rows, n_vectors, seconds), and Spark's checkpoint. Null texts are
    embedded as empty ones. after_write is called with the batch's number between its vectors and its commit.
    """
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(source)
    rows = stream.select(key, text, F.col("_metadata.file_name").alias("file"))

    def commit(df: DataFrame, number: int) -> None:
        session, vectors = df.sparkSession, f"{to}/vectors/batch={number}"
        began = session.sql("SELECT unix_millis(current_timestamp())").first()[0]
        embed(df, key, text, embedder, batch, ("file",)).write.mode("overwrite").parquet(vectors)
        if after_write:
            after_write(number)
        took = (F.unix_millis(F.current_timestamp()) - began) / 1000
        done = session.read.parquet(vectors).groupBy("file").agg(F.count("*").alias("n_rows"), F.count_if(F.size("embedding") > 0).alias("n_vectors"))
        done.withColumn("seconds", took).coalesce(1).write.mode("overwrite").parquet(f"{to}/progress/batch={number}")

    rows.writeStream.option("checkpointLocation", f"{to}/checkpoint").trigger(availableNow=True).foreachBatch(commit).start().awaitTermination()


def progress(spark: SparkSession, to: str) -> DataFrame:
    """(file, n_rows, n_vectors, seconds, batch): the completed files."""
    return spark.read.parquet(f"{to}/progress")


def vectors(spark: SparkSession, to: str) -> DataFrame:
    """The vectors of committed batches."""
    done = progress(spark, to).select("batch").distinct()
    return spark.read.parquet(f"{to}/vectors").join(F.broadcast(done), "batch", "left_semi").drop("batch")  # a number a batch
