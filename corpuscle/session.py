"""Session construction and the table reader that every query shares."""

from __future__ import annotations

import functools
import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Settings that hold at any scale. Sizes (shuffle partitions, memory) belong to the cluster.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def get_session(app: str = "corpuscle", master: str | None = None, **conf: str) -> SparkSession:
    """Return the active session or build one; keyword settings override DEFAULTS."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    return builder.config(map=DEFAULTS | conf).getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table. The path may be a file or a folder, on any filesystem Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Make this package importable for Python workers, wherever the driver found it.

    Nothing to do when PYTHONPATH names its folder; else Spark deals out an archive, once a context.
    """
    root, sc = Path(__file__).resolve().parent.parent, spark.sparkContext
    on_path = {os.path.realpath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p}
    if str(root) in on_path or getattr(sc, "_corpuscle_shipped", False):
        return
    base = os.path.join(os.path.realpath(tempfile.mkdtemp()), "corpuscle")
    sc.addPyFile(shutil.make_archive(base, "zip", root, "corpuscle"))
    sc._corpuscle_shipped = True


def shipped(query):
    """A query (spark, ...) that ships the package first."""

    @functools.wraps(query)
    def run(spark: SparkSession, *args) -> DataFrame:
        ship(spark)
        return query(spark, *args)

    return run


#: Spark cuts what it sends to Python by rows first, and by bytes only from 64 MB on. Each task holds such a batch several
#: times, outside the heap too, so it is cut sooner.
BATCH_BYTES = ("spark.sql.execution.arrow.maxBytesPerBatch", "4m")


def bounded(query):
    """A query (spark, ...) whose session sends Python batches of few bytes, unless the session has a bound of its own."""

    @functools.wraps(query)
    def run(spark: SparkSession, *args) -> DataFrame:
        key, most = BATCH_BYTES
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, most)
        return query(spark, *args)

    return run
