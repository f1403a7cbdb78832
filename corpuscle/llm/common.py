"""What the operators share: durable intermediate tables, text cells and Arrow plumbing."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Internal columns start with this, so that a caller's extra columns can't clash.
OWN = "__cc_"


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder. A local session (tests) gets a temporary one where none is set; a cluster must set it."""
    sc = spark.sparkContext
    if not (path := sc.getCheckpointDir()):
        path = spark.conf.get("spark.checkpoint.dir", None)
        if not path and not re.match(r"local($|\[)", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not path:
            import tempfile

            path = tempfile.mkdtemp(prefix="corpuscle")
        sc.setCheckpointDir(path)
        path = sc.getCheckpointDir()
    return path


def materialize(df: DataFrame) -> DataFrame:
    """Cut lineage: write to the shared folder, read back.

    Unlike ``DataFrame.checkpoint`` this computes the last stage once, and unlike a cache
    or a local checkpoint it outlives the executors that wrote it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/t-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._corpuscle_path = path  # type: ignore[attr-defined]
    return out


def discard(df: DataFrame | None) -> None:
    """Delete a table of :func:`materialize` that no later plan reads."""
    if path := getattr(df, "_corpuscle_path", None):
        jvm = df.sparkSession._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


def shuffled(df: DataFrame) -> DataFrame:
    """For a join that both sides travel for. Spark takes what a map in Python returns for as small as its input, and would
    broadcast through the driver what is many times larger; tables that grow with the input are never sent that way."""
    return df.hint("merge")


def raw_text(column: str | Column = "text") -> Column:
    """The text as UTF-8 bytes, null as empty: Python then never has to decode or fail."""
    c = F.col(column) if isinstance(column, str) else column
    return F.coalesce(c.cast("string"), F.lit("")).cast("binary")


_SPACE = re.compile(rb"[\x20\x09-\x0d]")


def text_runs(text: bytes, size: int = 1 << 20) -> Iterator[bytes]:
    """The whole text in parts of about `size` bytes, cut at ASCII white space only."""
    start, n = 0, len(text)
    while start < n:
        end = start + size
        if end < n:
            cut = _SPACE.search(text, end)
            end = cut.start() if cut else n
        yield text[start:end]
        start = end


def word_runs(text: bytes, size: int = 1 << 20) -> Iterator[list[bytes]]:
    """Words between ASCII white space, A-Z lower-cased, in lists from about `size` bytes each.

    Every text comes whole; only the lists are bounded, so one huge document doesn't
    become one huge list of objects.
    """
    for part in text_runs(text, size):
        yield part.lower().split()


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that `column` holds about `most` bytes in each; one long value stays whole."""
    for batch in batches:
        n, start, held = batch.num_rows, 0, 0
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        for i, size in enumerate(lengths):
            if held and held + size > most:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += size
        if start < n:
            yield batch.slice(start)


def tidy(run):
    """A function of record batches that hands unused memory back when its partition ends.

    Workers stay for later stages; what they no longer need should not count against those.
    """

    @functools.wraps(run)
    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # not the GNU library
                ctypes.CDLL(None).malloc_trim(0)

    return own


def tie(*columns: str) -> Column:
    """A 64-bit content key: orders rows that share an id the same way in every run."""
    return F.xxhash64(*columns)
