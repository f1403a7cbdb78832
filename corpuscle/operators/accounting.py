"""Counters taken in the pass that writes, and rows that fail kept by file."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..durable import written


def written_with(df: DataFrame, **counters: Column) -> tuple[DataFrame, dict[str, object]]:
    """Write `df` once and return the table with the counters, aggregates that Spark takes in the same pass.

    A task that runs again counts once. An empty table gives the aggregates of no rows.
    """
    seen = Observation()
    out = written(df.observe(seen, *(c.alias(n) for n, c in counters.items())))
    return out, dict(seen.get)


def mention_totals(names: list[str]) -> dict[str, Column]:
    """By dictionary: rows with a mention and mentions, over the arrays of `mentions.enrich`."""
    out = {"n_rows": F.count(F.lit(1))}
    for n in names:
        out |= {f"{n}_rows": F.count_if(F.size(f"{n}_mentions") > 0), f"{n}_mentions": F.coalesce(F.sum(F.size(f"{n}_mentions")), F.lit(0))}
    return out


def guarded(df: DataFrame, file: str, column: str, parse: Callable[[str], list[tuple]], columns: str) -> DataFrame:
    """(file, pos, the columns, skipped, error): what `parse` makes of each text, one row a tuple.

    A text of which `parse` raises gives one row with the error and nulls, a null text or no tuples one row that is skipped; so each
    file is accounted for, and the others go on. columns: SQL types by name, as `parse` returns them.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    kind = df.schema[file].dataType.simpleString()
    schema = f"`{file}` {kind}, pos int, {columns}, skipped boolean, error string"
    arrow = to_arrow_schema(df.sparkSession.createDataFrame([], schema).schema)
    names = arrow.names[2:-2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for f, text in zip(batch.column(file).to_pylist(), batch.column("__text").to_pylist(), strict=True):
                rows, error = [], None
                try:
                    rows = parse(text) if text is not None else []
                except Exception as e:  # the file's own failure
                    rows, error = [], f"{type(e).__name__}: {e}"
                out += [(f, i, *r, False, None) for i, r in enumerate(rows)] or [(f, None, *[None] * len(names), error is None, error)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(arrow.types)], names=arrow.names)

    return df.select(file, F.col(column).cast("string").alias("__text")).mapInArrow(run, schema)


def outcome(rows: DataFrame, file: str) -> DataFrame:
    """(file, status, n_rows, error) of :func:`guarded`: ok, skipped or error, one row a file."""
    status = F.when(F.max("error").isNotNull(), "error").when(F.bool_or("skipped"), "skipped").otherwise("ok")
    return rows.groupBy(file).agg(status.alias("status"), F.count("pos").alias("n_rows"), F.max("error").alias("error"))
