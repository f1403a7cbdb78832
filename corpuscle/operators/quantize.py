"""Nearest neighbours by product quantisation: cells, codes, and exact distances for the few that codes retain.

Rows are dealt to cells, as many as the root of their number, and what a cell's centre leaves of a vector is
coded by parts, a byte each. A question looks into its nearest cells, ranks their rows by tables of its distances to the
codes, and the best `refine` are measured exactly. So exact comparisons a question don't grow with the rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .topk import matrix, top_k


@dataclass(frozen=True)
class Codebook:
    """centres: of the cells; codes: (parts, codewords, dimensions of a part)."""

    centres: np.ndarray
    codes: np.ndarray

    def assign(self, x: np.ndarray, cells: int = 1) -> np.ndarray:
        near = (self.centres**2).sum(1) - 2 * x @ self.centres.T
        return np.argsort(near, axis=1, kind="stable")[:, :cells]

    def encode(self, x: np.ndarray, cell: np.ndarray) -> np.ndarray:
        rest = (x - self.centres[cell]).reshape(len(x), len(self.codes), -1)
        return np.stack([((c**2).sum(1) - 2 * rest[:, p] @ c.T).argmin(1) for p, c in enumerate(self.codes)], axis=1).astype(np.uint8)

    def tables(self, q: np.ndarray, cell: int) -> np.ndarray:
        """(parts, codewords): squared distances of what the cell's centre leaves of q to each codeword."""
        rest = (q - self.centres[cell]).reshape(len(self.codes), 1, -1)
        return ((rest - self.codes) ** 2).sum(2)


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 3) -> np.ndarray:
    """Centres of at most k clusters; empty ones keep their place."""
    centres = x[np.random.default_rng(seed).permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        near = ((centres**2).sum(1) - 2 * x @ centres.T).argmin(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=len(centres))
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


def fit(collection: DataFrame, embedding: str = "embedding", parts: int = 16, sample: int = 20_000) -> Codebook | None:
    """A codebook from at most about `sample` distinct vectors, chosen by a hash; cells: the root of the rows' number, 16,384 at most.

    Null vectors and those with null or non-finite entries are not used; parts divides the dimensions (or fewer parts are taken).
    None without usable rows.
    """
    v = F.col(embedding).cast("array<double>")
    usable = collection.select(v.alias("v")).filter("size(v) > 0 AND forall(v, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity'))")
    n = usable.count()
    unit = F.pmod(F.xxhash64("v"), F.lit(1 << 60)) / float(1 << 60)
    rows = usable.filter(unit < min(1.0, sample / max(n, 1))).distinct().limit(2 * sample).collect()
    x = np.array(sorted(r.v for r in rows))
    if not len(x):
        return None
    parts = max(p for p in range(1, parts + 1) if x.shape[1] % p == 0)
    centres = kmeans(x, min(math.isqrt(n) + 1, 16_384, len(x)))
    rest = (x - centres[((centres**2).sum(1) - 2 * x @ centres.T).argmin(1)]).reshape(len(x), parts, -1)
    codes = [kmeans(np.ascontiguousarray(rest[:, p]), 256) for p in range(parts)]
    return Codebook(centres, np.stack(codes))


def index(collection: DataFrame, book: Codebook, key: str, embedding: str = "embedding") -> DataFrame:
    """(key, embedding, cell, code) of every usable row; write it partitioned or sorted by cell."""
    shared = collection.sparkSession.sparkContext.broadcast(book)  # bounded: 16,384 centres and 256 codewords a part
    kind = collection.schema[embedding].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            x, rows = matrix(batch.column(embedding))
            if len(rows):
                cell = own.assign(x)[:, 0]
                take = pa.array(rows)
                codes = pa.array([c.tobytes() for c in own.encode(x, cell)], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(key).take(take), batch.column(embedding).take(take), pa.array(cell, pa.int32()), codes], names=[key, embedding, "cell", "code"])

    return collection.select(key, embedding).mapInArrow(run, f"{key} {collection.schema[key].dataType.simpleString()}, {embedding} {kind}, cell int, code binary")


def search(indexed: DataFrame, questions: DataFrame, book: Codebook, k: int, key: str, question: str = "query", embedding: str = "embedding", probes: int | None = None, refine: int = 100, most: int = 1 << 20) -> DataFrame:
    """(query, key, distance): about the k nearest rows of each question, ties by key; distances are exact, rounded to 6 places.

    probes: cells a question looks into, half of them by default. The questions go out whole: a stated set of at most
    100,000. Each task ranks its rows by their codes and sends keys, `refine` a question, in turns of `most`; only the vectors of
    the best over all tasks are joined. Keys are unique and not null.
    """
    spark = indexed.sparkSession
    asked = questions.filter(F.col(question).isNotNull() & (F.size(embedding) > 0) & F.forall(embedding, lambda x: x.isNotNull())).select(question, F.col(embedding).cast("array<double>").alias("v")).limit(100_001).collect()
    if len(asked) > 100_000:
        raise ValueError("more than 100,000 questions; search them in parts")
    schema = f"query {questions.schema[question].dataType.simpleString()}, {key} {indexed.schema[key].dataType.simpleString()}, rough double"
    if not asked:
        return spark.createDataFrame([], schema).select("query", key, F.col("rough").alias("distance"))
    ids, q = [r[0] for r in asked], np.array([r.v for r in asked])
    probes = min(probes or len(book.centres) // 2 + 1, len(book.centres))
    shared = spark.sparkContext.broadcast((book, ids, q, book.assign(q, probes).astype(np.int32)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, names, points, cells = shared.value
        held: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in names]  # (rough, key), as arrays
        size, total = np.zeros(len(names), np.int64), 0
        order = np.argsort(cells, axis=None, kind="stable")
        first = np.searchsorted(cells.ravel()[order], np.arange(len(own.centres) + 1))
        who = (order // cells.shape[1]).astype(np.int32)  # the questions of each cell, cell after cell

        def cut(i: int) -> None:
            nonlocal total
            rough, keys = (np.concatenate(x) for x in zip(*held[i], strict=True))
            best = np.lexsort((keys, rough))[:refine]
            held[i] = [(rough[best], keys[best])]
            total += len(best) - size[i]
            size[i] = len(best)

        def out() -> Iterator[pa.RecordBatch]:
            """What is held, cut; the merge over tasks also merges what a task sends in turns."""
            nonlocal total
            some = [i for i, found in enumerate(held) if found]
            for i in some:
                cut(i)
            for s in range(0, len(some), 1024):
                at = some[s : s + 1024]
                rough, keys = (np.concatenate([held[i][0][k] for i in at]) for k in (0, 1))
                query = pa.array([names[i] for i in at], arrow.field("query").type).take(pa.array(np.repeat(np.arange(len(at)), size[at])))
                yield pa.RecordBatch.from_arrays([query, pa.array(keys, arrow.field(key).type), pa.array(rough)], schema=arrow)
            for i in some:
                held[i] = []
            size[:], total = 0, 0

        tables: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            at = batch.column("cell").to_numpy()
            for c in np.unique(at).tolist():
                rows = np.flatnonzero(at == c)
                codes = np.frombuffer(b"".join(batch.column("code").take(pa.array(rows)).to_pylist()), np.uint8).reshape(len(rows), -1)
                keys = batch.column(key).take(pa.array(rows)).to_numpy(zero_copy_only=False)
                for i in who[first[c] : first[c + 1]].tolist():
                    if (i, c) not in tables:
                        if len(tables) > 1024:
                            tables.clear()
                        tables[i, c] = own.tables(points[i], c)
                    rough = tables[i, c][np.arange(codes.shape[1]), codes].sum(1)
                    best = np.lexsort((keys, rough))[:refine] if len(rough) > refine else slice(None)
                    held[i].append((rough[best], keys[best]))
                    n = len(held[i][-1][0])
                    size[i], total = size[i] + n, total + n
                    if size[i] > 4 * refine or len(held[i]) > 64:
                        cut(i)
                if total > most:
                    yield from out()
        yield from out()

    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(spark.createDataFrame([], schema).schema)
    coded = indexed.select(key, "cell", "code").mapInArrow(run, schema)
    few = top_k(coded, refine, "query", "rough", key).join(indexed.select(key, embedding), key)
    own = questions.select(F.col(question).alias("query"), F.col(embedding).cast("array<double>").alias("__q"))
    squares = F.zip_with(F.col(embedding).cast("array<double>"), "__q", lambda a, b: (a - b) * (a - b))
    exact = few.join(own, "query").select("query", key, F.round(F.aggregate(squares, F.lit(0.0), lambda s, x: s + x), 6).alias("distance"))
    return top_k(exact, k, "query", "distance", key)
