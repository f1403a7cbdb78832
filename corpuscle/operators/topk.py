"""The k nearest rows of every question of a table, in one scan of the collection.

Questions go out in blocks of bounded size. A task compares its rows with a block by matrix products and keeps a heap of k a question;
what a product lets through is measured exactly. The heaps of all tasks are merged by question.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import query_terms
from .retrieval import term_hits

#: Numbers in a block of questions: 32 MB.
BLOCK = 1 << 22


def matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of one length as rows, and which rows they are: those that are null or hold a null or non-finite entry are left out."""
    v = column.cast(pa.list_(pa.float64()))
    lengths = v.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    values = v.flatten().to_numpy(zero_copy_only=False)
    owner = np.repeat(np.arange(len(lengths)), lengths)
    bad = np.bincount(owner[~np.isfinite(values)], minlength=len(lengths)) > 0
    rows = np.flatnonzero((lengths > 0) & ~bad)
    if len(rows) and len(set(lengths[rows].tolist())) > 1:
        raise ValueError("vectors of different lengths")
    starts = (np.cumsum(lengths) - lengths)[rows]
    return (values[starts[:, None] + np.arange(lengths[rows][0])] if len(rows) else np.zeros((0, 0))), rows


class Heaps:
    """The k least (distance, key) of each of n questions; distances rounded to 6 places."""

    def __init__(self, questions: np.ndarray, k: int) -> None:
        self.q, self.k = questions, k
        self.norms = (questions**2).sum(1)
        self.found: list[list[tuple[float, object]]] = [[] for _ in questions]
        self.worst = np.full(len(questions), np.inf)

    def add(self, x: np.ndarray, keys: list, some: np.ndarray | None = None) -> None:
        """Rows x met by the questions `some`, all by default."""
        some = np.arange(len(self.q)) if some is None else some
        near = (x**2).sum(1)[None, :] - 2 * self.q[some] @ x.T + self.norms[some][:, None]
        slack = 1e-5 + 1e-9 * np.abs(near).max(initial=0)  # rounding of the product and of 6 places
        if near.shape[1] > self.k:
            limit = np.minimum(np.partition(near, self.k - 1, axis=1)[:, self.k - 1], self.worst[some])
        else:
            limit = self.worst[some]
        for at in np.flatnonzero((near <= limit[:, None] + slack).any(axis=1)):
            i, rows = some[at], np.flatnonzero(near[at] <= limit[at] + slack)
            exact = np.round(((x[rows] - self.q[i]) ** 2).sum(1), 6)
            own = self.found[i] + [(d, keys[r]) for d, r in zip(exact.tolist(), rows.tolist(), strict=True)]
            self.found[i] = sorted(own)[: self.k]
            if len(self.found[i]) == self.k:
                self.worst[i] = self.found[i][-1][0]


def _nearest(block: np.ndarray, ids: list, k: int, key: str, embedding: str, kinds: list[pa.DataType]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps = Heaps(block, k)
        for batch in batches:
            for part in (batch.slice(s, 2048) for s in range(0, batch.num_rows, 2048)):
                x, rows = matrix(part.column(embedding))
                if len(rows):
                    keys = part.column(key).to_pylist()
                    heaps.add(x, [keys[r] for r in rows.tolist()])
        out = [(ids[i], key_, d) for i, own in enumerate(heaps.found) for d, key_ in own]
        for s in range(0, len(out), 10_000):
            columns = zip(*out[s : s + 10_000], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [*kinds, pa.float64()], strict=True)], names=["query", key, "distance"])

    return run


def _nearest_by_cell(block: np.ndarray, ids: list, k: int, key: str, embedding: str, kinds: list[pa.DataType], cells: tuple[np.ndarray, int]):
    centres, probes = cells

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps = Heaps(block, k)
        near = np.argsort((centres**2).sum(1) - 2 * block @ centres.T, axis=1, kind="stable")[:, :probes]
        asks = np.zeros((len(centres), len(block)), bool)
        asks[near.ravel(), np.repeat(np.arange(len(block)), near.shape[1])] = True
        for batch in batches:
            of = batch.column("cell").to_numpy()
            cuts = [0, *(np.flatnonzero(of[1:] != of[:-1]) + 1).tolist(), len(of)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a < b and len(some := np.flatnonzero(asks[of[a]])):
                    for part in (batch.slice(s, min(2048, b - s)) for s in range(a, b, 2048)):
                        x, rows = matrix(part.column(embedding))
                        if len(rows):
                            keys = part.column(key).to_pylist()
                            heaps.add(x, [keys[r] for r in rows.tolist()], some)
        out = [(ids[i], key_, d) for i, own in enumerate(heaps.found) for d, key_ in own]
        for s in range(0, len(out), 10_000):
            columns = zip(*out[s : s + 10_000], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [*kinds, pa.float64()], strict=True)], names=["query", key, "distance"])

    return run


def top_k(rows: DataFrame, k: int, by: str, *order) -> DataFrame:
    """The first k rows of each group; tasks cut theirs before the shuffle."""
    w = Window.partitionBy(by).orderBy(*order)
    return rows.withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= k).drop("__n")


def nearest(collection: DataFrame, questions: DataFrame, k: int, key: str, question: str = "query", embedding: str = "embedding", cells: tuple[np.ndarray, int] | None = None) -> DataFrame:
    """(query, key, distance): the k nearest rows of each question by squared L2 in double, rounded to 6 places, ties by key.

    Questions that are null, or whose vector is null or not finite, get no rows; keys are not null. Blocks of
    questions have `BLOCK` numbers at most, and each block is one scan. Vectors of one length only. cells: centres and how many
    of them a question looks into; the collection then has each row's cell, and equal cells together.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    spark = collection.sparkSession
    kinds = [to_arrow_type(questions.schema[question].dataType), to_arrow_type(collection.schema[key].dataType)]
    schema = f"query {questions.schema[question].dataType.simpleString()}, {key} {collection.schema[key].dataType.simpleString()}, distance double"
    usable = F.col(question).isNotNull() & F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    parts, ids, vectors = [], [], []

    def flush() -> None:
        block = np.array(vectors, np.float64)
        if cells:
            run = _nearest_by_cell(block, list(ids), k, key, embedding, kinds, cells)
        else:
            run = _nearest(block, list(ids), k, key, embedding, kinds)
        parts.append(collection.select(key, embedding, *(["cell"] if cells else [])).mapInArrow(run, schema))
        ids.clear()
        vectors.clear()

    for row in questions.filter(usable).select(question, F.col(embedding).cast("array<double>").alias("v")).toLocalIterator():
        if row.v:
            ids.append(row[0])
            vectors.append(row.v)
            if len(vectors) * len(row.v) >= BLOCK:
                flush()
    if vectors:
        flush()
    if not parts:
        return spark.createDataFrame([], schema)
    return top_k(reduce(DataFrame.union, parts), k, "query", "distance", key)


def search_all(questions: DataFrame, collections: dict[str, DataFrame], route: Column, k: int, key: str, question: str = "query", text: str = "text", embedding: str = "embedding") -> DataFrame:
    """(query, collection, key, distance, boosted_score): each question routed, and searched there by vector and terms.

    questions: (question, text, embedding); route: a name for each. In a question's collection the nearest 5k are re-ranked by
    ``1 / (1 + distance) + 0.1 * terms found``, terms over two characters. A route that is no collection finds nothing.
    """
    asked = questions.select(F.col(question).alias("query"), text, embedding, route.alias("collection"))
    parts = []
    for name, rows in collections.items():
        own = asked.filter(F.col("collection") == name)
        near = nearest(rows, own, 5 * k, key, "query", embedding)
        terms = own.select("query", "collection", query_terms(text, 2).alias("__terms"))
        parts.append(near.join(rows.select(key, text), key).join(terms, "query"))
    boosted = F.round(1 / (1 + F.col("distance")) + 0.1 * term_hits(F.col(text), F.col("__terms")), 6)
    scored = reduce(DataFrame.unionByName, parts).select("query", "collection", key, "distance", boosted.alias("boosted_score"))
    return top_k(scored, k, "query", F.desc("boosted_score"), "distance", key)
