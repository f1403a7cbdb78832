"""Paginated listings as a Python data source: the fetcher is a parameter, so tests need no network.

A fetcher takes (start token or None) and returns (rows, next token or None). A failed page
ends the listing with what was read; a listing without any row raises.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader

Fetcher = Callable[[str | None], tuple[list[tuple], str | None]]


def pages(fetch: Fetcher, delay: float = 0.0) -> Iterator[tuple]:
    token, first, any_row = None, True, False
    while first or token:
        if not first and delay:
            time.sleep(delay)
        first = False
        try:
            rows, token = fetch(token)
        except OSError:
            break
        any_row = any_row or bool(rows)
        yield from rows
    if not any_row:
        raise ValueError("the listing is empty")


def register(spark: SparkSession, name: str, schema_: str, fetch: Fetcher, delay: float = 0.0) -> None:
    """Make ``spark.read.format(name).load()`` read the listing."""

    class Reader(DataSourceReader):
        def read(self, partition):
            return pages(fetch, delay)

    class Listing(DataSource):
        @classmethod
        def name(cls):
            return name

        def schema(self):
            return schema_

        def reader(self, schema):
            return Reader()

    spark.dataSource.register(Listing)


def fetch_pages(titles: DataFrame, title: str, fetch: Callable[[str], tuple[str, str] | None], delay: float = 0.0) -> DataFrame:
    """(title, html, wikitext, error) of each title: a missing page has none of the texts, a failed one the error.

    The fetcher takes a title and returns (rendered, source) or None. Calls of a task follow each other with the delay.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for name in batch.column(title).to_pylist():
                if delay:
                    time.sleep(delay)
                try:
                    out.append((*(fetch(name) or (None, None)), None))
                except Exception as e:  # one page must not end the run
                    out.append((None, None, f"{type(e).__name__}: {e}"))
            yield pa.RecordBatch.from_arrays([batch.column(title), *(pa.array([r[c] for r in out], pa.string()) for c in range(3))], names=[title, "html", "wikitext", "error"])

    return titles.select(title).mapInArrow(run, f"{title} string, html string, wikitext string, error string")


def scrape(titles: DataFrame, title: str, existing: DataFrame, fetch: Callable, blocked: list[str], cats_of: Callable, delay: float = 0.0) -> DataFrame:
    """(title, html, wikitext, file_name, status): saved, exists, blocked, missing or error.

    existing: (file_name). Titles with a file aren't fetched. Names that differ only in case get a number.
    """
    from corpuscle.functions.text import safe_filename
    from corpuscle.operators.classify import has_any
    from corpuscle.operators.resolve import collision_names

    named = titles.select(title).distinct().withColumn("__name", safe_filename(title))
    there = existing.select(F.regexp_replace("file_name", r"\.txt$", "").alias("__name")).distinct()
    done = named.join(there, "__name", "left_semi")
    found = fetch_pages(named.join(there, "__name", "left_anti"), title, fetch, delay)
    status = F.when(F.col("error").isNotNull(), "error").when(F.col("html").isNull(), "missing").when(has_any(cats_of("wikitext"), blocked), "blocked").otherwise("saved")
    found = found.withColumn("status", status).withColumn("__name", safe_filename(title))
    saved = collision_names(found.filter("status = 'saved'"), "__name", title).select(title, "html", "wikitext", F.concat("file_name", F.lit(".txt")).alias("file_name"), "status")
    rest = found.filter("status <> 'saved'").select(title, "html", "wikitext", F.lit(None).cast("string").alias("file_name"), "status")
    old = done.select(title, *(F.lit(None).cast("string").alias(c) for c in ("html", "wikitext")), F.concat("__name", F.lit(".txt")).alias("file_name"), F.lit("exists").alias("status"))
    return saved.unionByName(rest).unionByName(old)
