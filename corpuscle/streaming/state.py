"""First and last wins over streams: keyed state with timers, and a table of updates that a restart writes once.

State is one row a key, the best so far. A row that betters it is emitted, so after any batch the newest update of a
key is what a batch query over all rows so far would give, in whatever order they came. A timer
drops a key's state once the watermark has passed its last event by the allowed lateness; rows later than
the watermark can't change what was dropped, and Spark leaves them out.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from ..durable import written

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Winner(StatefulProcessor):
    """Keeps the row with the least (`first`) or greatest values in its columns `order`; __at: event time in ms."""

    def __init__(self, schema: StructType, order: list[str], first: bool, keep_ms: int) -> None:
        self.names, self.first, self.keep_ms = schema.names, first, keep_ms
        self.schema, self.places = schema, [schema.names.index(c) for c in order]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.best = handle.getValueState("best", self.schema)
        self.until = handle.getValueState("until", "ms long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        held = tuple(self.best.get()) if self.best.exists() else None
        new, latest = held, 0
        for row in rows:
            latest = max(latest, row["__at"])
            one = tuple(row[c] for c in self.names)
            if new is None or (self.order(one) < self.order(new) if self.first else self.order(one) > self.order(new)):
                new = one
        expires = latest + self.keep_ms
        due = self.until.get()[0] if self.until.exists() else None
        if due is None or expires > due:
            if due is not None:
                self.handle.deleteTimer(due)
            self.handle.registerTimer(expires)
            self.until.update((expires,))
        if new is not held:
            self.best.update(new)
            yield Row(*self.names)(*new)

    def order(self, row: tuple) -> tuple:
        return tuple(row[i] for i in self.places)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        self.best.clear()
        self.until.clear()
        yield from ()

    def close(self) -> None:
        pass


def winners(stream: DataFrame, key: str, at: str, order: list[str], values: list[str], first: bool, late: str) -> DataFrame:
    """Updates (key, order, values) of a stream: each row that is the first, or last, of its key so far.

    at: the event-time column. order: integer or text columns without nulls that order a key's rows, by what comes first. late: how far
    behind the latest event a row may come, an interval; state is kept as long after a key's last event.
    """
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    keep = spark.sql(f"SELECT unix_millis(timestamp_millis(0) + INTERVAL {late})").first()[0]
    rows = stream.withColumn("__ts", F.col(at).cast("timestamp")).withWatermark("__ts", late)
    rows = rows.select(key, *order, *values, F.unix_millis("__ts").alias("__at"), "__ts")
    schema = rows.select(key, *order, *values).schema
    return rows.groupBy(key).transformWithState(Winner(schema, order, first, keep), schema, "Update", "EventTime")


def upsert(updates: DataFrame, to: str, checkpoint: str) -> None:
    """Append each batch's updates to the table in `to` until what has arrived is done.

    A batch has its folder, which is overwritten, so a batch that broke off and runs again is written once.
    """

    def commit(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{to}/batch={batch}")

    updates.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(commit).start().awaitTermination()


def current(spark: SparkSession, to: str, key: str) -> DataFrame:
    """The newest update of each key."""
    rows = spark.read.parquet(to)
    rest = F.struct(*(c for c in rows.columns if c not in (key, "batch")))
    newest = rows.groupBy(key).agg(F.max_by(rest, "batch").alias("r"))
    return newest.select(key, "r.*")


def replayed(df: DataFrame, by: str, files: int) -> DataFrame:
    """The rows as a stream of `files` files, dealt by a hash of the column `by`: out of order, two files a batch."""
    spark = df.sparkSession
    stored = written(df.repartition(files, by))
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", max(1, files // 2)).parquet(stored._written_to)
