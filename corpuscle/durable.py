"""Tables written to the shared folder: they cut lineage and outlive the executors that wrote them."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: While a table is written, Spark deletes that plan's shuffle files at its end; nothing reads them again.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a local session without one gets a temporary one, a cluster must name it."""
    sc = spark.sparkContext
    if not (path := sc.getCheckpointDir()):
        path = spark.conf.get("spark.checkpoint.dir", None)
        if not path:
            if not re.match(r"local($|\[)", sc.master):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            path = tempfile.mkdtemp(prefix="corpuscle")
        sc.setCheckpointDir(path)
        path = sc.getCheckpointDir()
    return path


def written(df: DataFrame) -> DataFrame:
    """Write `df` to the shared folder once and return the table; see :func:`forget`."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/w-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path  # type: ignore[attr-defined]
    return out


def forget(*tables: DataFrame | None) -> None:
    """Delete tables of :func:`written` that no later plan reads."""
    for df in tables:
        if path := getattr(df, "_written_to", None):
            spark = df.sparkSession
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
