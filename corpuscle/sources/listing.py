"""Listings by key prefix: read in one partition a prefix, or as a stream whose offset is the continuation tokens.

A fetcher takes (prefix, token or None) and returns (rows, next token or None), a page; the fetcher is a parameter, so that tests need
no network. A page that fails is tried again; when it fails to the end it becomes a row with its error and ends its
prefix, while the other prefixes are read. The next run of a stream goes on with that page.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

Fetcher = Callable[[str, str | None], tuple[list[tuple], str | None]]
DONE, FAILED = "\x00done", "\x00failed"


@dataclass
class Prefix(InputPartition):
    prefix: str


def page(fetch: Fetcher, prefix: str, token: str | None, tries: int, delay: float) -> tuple[list[tuple], str | None, str | None]:
    """(rows, next token, error) of one page after at most `tries` calls, each `delay` seconds after the one before."""
    error = None
    for n in range(tries):
        if delay and (n or token):
            time.sleep(delay)
        try:
            return (*fetch(prefix, token), None)
        except Exception as e:  # whatever the fetcher raises is the page's error
            error = f"{type(e).__name__}: {e}"
    return [], token, error


def listed(fetch: Fetcher, prefix: str, width: int, tries: int = 3, delay: float = 0.0) -> Iterator[tuple]:
    """All rows of a prefix as (prefix, columns, null), and a row (prefix, nulls, error) where a page failed."""
    token, first = None, True
    while first or token:
        first = False
        rows, token, error = page(fetch, prefix, token, tries, delay)
        yield from ((prefix, *r, None) for r in rows)
        if error:
            yield (prefix, *[None] * width, error)
            return


def register(spark: SparkSession, name: str, columns: str, fetch: Fetcher, prefixes: list[str], tries: int = 3, delay: float = 0.0) -> None:
    """Make ``spark.read.format(name)`` and ``spark.readStream.format(name)`` read (prefix, columns, error).

    delay: seconds between the calls of one prefix, which follow each other in one task. A stream's batch is a page of each prefix.
    """
    width = columns.count(",") + 1 if columns.strip() else 0

    class Reader(DataSourceReader):
        def partitions(self) -> list[Prefix]:
            return [Prefix(p) for p in prefixes]

        def read(self, partition: Prefix) -> Iterator[tuple]:
            return listed(fetch, partition.prefix, width, tries, delay)

    class Stream(SimpleDataSourceStreamReader):
        """The offset has each prefix's next token, null at its start and DONE after its last page, and how many pages have failed."""

        def initialOffset(self) -> dict:  # noqa: N802
            return dict.fromkeys(prefixes) | {FAILED: 0}

        def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
            out, end = [], dict(start)
            for p, token in start.items():
                if p != FAILED and token != DONE:
                    rows, after, error = page(fetch, p, token, tries, delay)
                    out += [(p, *r, None) for r in rows]
                    if error:
                        out.append((p, *[None] * width, error))
                        end[FAILED] += 1
                    else:
                        end[p] = after or DONE
            return iter(out), end

        def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:  # noqa: N802
            """The same pages again, after a failure."""
            for p, token in start.items():
                if p != FAILED and token != end.get(p):
                    rows, _, error = page(fetch, p, token, tries, delay)
                    if error:
                        raise OSError(f"{p}: {error}")
                    yield from ((p, *r, None) for r in rows)

        def commit(self, end: dict) -> None:
            pass

    class Listing(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return f"prefix string, {columns}, error string" if width else "prefix string, error string"

        def reader(self, schema) -> Reader:
            return Reader()

        def simpleStreamReader(self, schema) -> Stream:  # noqa: N802
            return Stream()

    spark.dataSource.register(Listing)
