"""Exact nearest neighbours, keyword and hybrid search, order-bounded search, routing."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuscle.functions import vector
from corpuscle.functions.text import STOP_WORDS, query_terms


def knn(collection: DataFrame, query: list[float], k: int, key: str, embedding: str = "embedding") -> DataFrame:
    """The k nearest by squared L2, ties by key: one scan and a per-task heap of k."""
    d = F.round(vector.squared_l2(embedding, vector.literal(query)), 6)
    return collection.withColumn("distance", d).orderBy("distance", key).limit(k)


def bounded(order: str, most: int) -> Column:
    """Nothing later than `most`; rows without an order always pass."""
    return F.col(order).isNull() | (F.col(order) <= most)


def knn_bounded(collection: DataFrame, query: list[float], k: int, key: str, order: str, most: int, mode: str = "pre") -> DataFrame:
    """'pre' filters before the top k. 'post' takes 3k first, so it may return fewer than k rows."""
    if mode == "pre":
        return knn(collection.filter(bounded(order, most)), query, k, key)
    return knn(collection, query, 3 * k, key).filter(bounded(order, most)).orderBy("distance", key).limit(k)


def term_hits(text: Column, terms: Column) -> Column:
    """How many of the terms the lower-cased text contains; a repeated term counts again."""
    return F.aggregate(terms, F.lit(0).cast("long"), lambda a, t: a + F.contains(F.lower(text), t).cast("long"))


def keyword_search(collection: DataFrame, query: str, k: int, key: str, text: str = "text") -> DataFrame:
    scored = collection.withColumn("score", term_hits(F.col(text), query_terms(F.lit(query))))
    return scored.filter("score > 0").orderBy(F.desc("score"), key).limit(k)


def hybrid(collection: DataFrame, query: str, query_vector: list[float], k: int, key: str, text: str = "text", order: str | None = None, most: int | None = None) -> DataFrame:
    """The nearest 5k re-ranked by ``1 / (1 + distance) + 0.1 * terms found`` (terms over two characters)."""
    near = knn(collection, query_vector, 5 * k, key) if order is None else knn_bounded(collection, query_vector, 5 * k, key, order, most, "post")
    boosted = F.round(1 / (1 + F.col("distance")) + 0.1 * term_hits(F.col(text), query_terms(F.lit(query), 2)), 6)
    return near.withColumn("boosted_score", boosted).orderBy(F.desc("boosted_score"), "distance", key).limit(k)


def route(text: Column, rules: list[tuple[str, tuple[str, ...]]], default: str) -> Column:
    """The first rule of which the text contains a term."""
    low, out = F.lower(text), None
    for name, words in rules:
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(low, F.lit(w.lower()))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return F.lit(default) if out is None else out.otherwise(default)


def classify(text: Column, types: list[tuple[str, tuple[str, ...]]], default: str) -> Column:
    """The type with most terms in the text, the earlier of equals; the default without any."""
    scores = F.array(
        *(F.struct(term_hits(text, F.array(*(F.lit(w.lower()) for w in words))).alias("score"), F.lit(-i).alias("at"), F.lit(name).alias("name")) for i, (name, words) in enumerate(types))
    )
    best = F.array_max(scores)
    return F.when(best["score"] > 0, best["name"]).otherwise(default)


def auto(collections: dict[str, DataFrame], rules: list[tuple[str, tuple[str, ...]]], default: str, query: str, embedder: Callable, k: int, key: str, **options) -> DataFrame:
    """The question's route, then hybrid search there: the question without stop words is embedded, its own terms boost."""
    low = query.lower()
    name = next((n for n, words in rules if any(w.lower() in low for w in words)), default)
    kept = " ".join(t for t in low.split() if t not in STOP_WORDS) or query
    question = [float(x) for x in embedder([kept])[0]]
    return hybrid(collections[name], query, question, k, key, **options).withColumn("collection", F.lit(name))


#: Parts that a cell's rows are dealt into.
SPREAD = 16


def ivf_fit(collection: DataFrame, embedding: str = "embedding", cells: int = 64, sample: int = 20_000, rounds: int = 12) -> np.ndarray:
    """Centroids of an inverted file: k-means in numpy on at most about `sample` rows, chosen by a hash of the vector.

    Vectors that are null or hold a null are not used; all have one length. No usable row: no centroid.
    """
    usable = collection.filter(F.forall(embedding, lambda x: x.isNotNull())).select(F.col(embedding).cast("array<double>").alias("v"))
    n = usable.count()
    unit = F.pmod(F.xxhash64("v"), F.lit(1 << 20)) / float(1 << 20)
    rows = usable.filter(unit < min(1.0, sample / max(n, 1))).distinct().limit(2 * sample).collect()
    x = np.array(sorted(r.v for r in rows))
    if not len(x):
        return np.zeros((0, 0))
    cells = min(cells, len(x))
    centres = x[np.random.default_rng(3).permutation(len(x))[:cells]]
    for _ in range(rounds):
        near = (-2 * x @ centres.T + (centres**2).sum(1)).argmin(1)
        for c in range(cells):
            if (near == c).any():
                centres[c] = x[near == c].mean(0)
    return centres


def ivf_assign(df: DataFrame, centres: np.ndarray, key: str, embedding: str = "embedding", probes: int = 1) -> DataFrame:
    """(key, embedding, cell): each row in its nearest cells; rows without a vector are left out. Write it partitioned by cell."""
    kind = df.schema[embedding].dataType.simpleString()
    shared = df.sparkSession.sparkContext.broadcast(centres)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            if batch.num_rows and len(own):
                x = np.array(batch.column(embedding).to_pylist(), np.float64)
                near = np.argsort(-2 * x @ own.T + (own**2).sum(1), axis=1, kind="stable")[:, :probes]
                each = pa.array(np.repeat(np.arange(len(x)), near.shape[1]))
                yield pa.RecordBatch.from_arrays([batch.column(key).take(each), batch.column(embedding).take(each), pa.array(near.ravel().astype(np.int32))], names=[key, embedding, "cell"])

    rows = df.filter(F.forall(embedding, lambda x: x.isNotNull())).select(key, embedding)
    return rows.mapInArrow(run, f"{key} {df.schema[key].dataType.simpleString()}, {embedding} {kind}, cell int")


def ivf_search(index: DataFrame, queries: DataFrame, centres: np.ndarray, k: int, key: str, embedding: str = "embedding", probes: int = 16) -> DataFrame:
    """(query, key, distance): the k nearest rows of each query among those of its nearest cells, ties by key.

    index: rows of :func:`ivf_assign`; queries: rows like the collection's. Rows are sorted by cell, a cell of any size over
    several tasks, and a run of a cell's rows meets the questions of that cell in matrix products (see :mod:`topk`).
    """
    from corpuscle.operators import topk

    if not len(centres):
        return index.limit(0).select(F.col(key).alias("query"), key, F.lit(0.0).alias("distance"))
    asked = queries.select(F.col(key).alias("query"), embedding)
    rows = index.repartition("cell", F.pmod(F.xxhash64(key), F.lit(SPREAD))).sortWithinPartitions("cell")
    return topk.nearest(rows, asked, k, key, embedding=embedding, cells=(centres, probes))
