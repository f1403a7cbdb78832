"""Keyword search through posting lists of character q-grams.

A text contains a term only if it has all the term's q-grams, so the lists retrieve the few texts that can, and
containment decides on those. The index is runs sorted by gram: a search reads the pages of its own grams.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..durable import written
from .batches import parts
from .retrieval import term_hits

Q = 3


#: Entries that a task sorts at once.
RUN = 1 << 21


def grams(low: str, q: int = Q) -> np.ndarray:
    """The distinct q-grams of a lower-cased text, as an array of texts; a shorter text is one gram, an empty one none."""
    codes = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), np.uint32)
    if len(codes) < q:
        return np.array([low] if low else [], f"<U{q}")
    held = np.lib.stride_tricks.sliding_window_view(codes, q)
    if int(codes.max()) << 1 >> (64 // q):  # numbers of q characters don't fit
        return np.unique(np.ascontiguousarray(held).view(f"<U{q}").ravel())
    wide, packed = 64 // q, np.zeros(len(held), np.uint64)
    for k in range(q):
        packed = packed << np.uint64(wide) | held[:, k].astype(np.uint64)
    packed = np.unique(packed)
    mask = np.uint64((1 << wide) - 1)
    back = np.stack([(packed >> np.uint64(wide * (q - 1 - k))) & mask for k in range(q)], axis=1).astype(np.uint32)
    return np.ascontiguousarray(back).view(f"<U{q}").ravel()


def _listed(key: str, q: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, keys, size = [], [], 0

        def out() -> Iterator[pa.RecordBatch]:
            names, at = np.unique(np.concatenate(found), return_inverse=True)
            owner = np.repeat(np.arange(len(found)), [len(f) for f in found])
            order = np.argsort(at, kind="stable")
            texts, own = pa.array(names.tolist(), pa.string()), pa.array(keys, kind).take(pa.array(owner[order]))
            first = np.searchsorted(at[order], np.arange(len(names) + 1)).astype(np.int32)
            rows = pa.RecordBatch.from_arrays([texts, pa.ListArray.from_arrays(pa.array(first), own)], names=["gram", "keys"])
            yield from parts(iter([rows]))
            found.clear()
            keys.clear()

        for batch in parts(batches):
            kind = batch.schema.field(key).type
            for k, low in zip(batch.column(key).to_pylist(), batch.column("__low").to_pylist(), strict=True):
                own = grams(low.decode("utf-8", "replace"), q)
                if len(own):
                    found.append(own)
                    keys.append(k)
                    size += len(own)
                if size >= RUN:
                    yield from out()
                    size = 0
        if found:
            yield from out()

    return run


def index(df: DataFrame, key: str, text: str = "text", q: int = Q) -> DataFrame:
    """(gram, keys) of every text, written where the text is, in runs sorted by gram: nothing is shuffled, and a filter on grams reads
    a few pages of each run. A gram has a list in each run, of the run's texts at most. Null texts have none."""
    rows = df.select(key, F.lower(F.coalesce(text, F.lit(""))).cast("binary").alias("__low"))
    return written(rows.mapInArrow(_listed(key, q), f"gram string, keys array<{df.schema[key].dataType.simpleString()}>"))


def candidates(postings: DataFrame, terms: list[str], key: str, q: int = Q) -> DataFrame:
    """(term, key): texts that have all grams of a term; of a term shorter than q those with a gram that holds it."""
    low = sorted({t.lower() for t in terms if t})
    own = {t: sorted({t[i : i + q] for i in range(len(t) - q + 1)}) for t in low if len(t) >= q}
    short = [t for t in low if len(t) < q]
    lists = []
    if own:
        wanted = postings.sparkSession.createDataFrame([(t, g, len(gs)) for t, gs in own.items() for g in gs], "term string, gram string, needs int")
        some = postings.filter(F.col("gram").isin(sorted({g for gs in own.values() for g in gs})))
        have = some.join(F.broadcast(wanted), "gram").select("term", "gram", "needs", F.explode("keys").alias(key)).groupBy("term", key).agg(F.count_distinct("gram").alias("n"), F.first("needs").alias("needs"))  # wanted: the question's grams
        lists.append(have.filter("n = needs").select("term", key))
    for t in short:
        lists.append(postings.filter(F.contains("gram", F.lit(t))).select(F.lit(t).alias("term"), F.explode("keys").alias(key)).distinct())
    out = postings.limit(0).select(F.col("gram").alias("term"), F.explode("keys").alias(key))
    for p in lists:
        out = out.unionByName(p)
    return out


def search(collection: DataFrame, postings: DataFrame, query: str, k: int, key: str, text: str = "text", q: int = Q) -> DataFrame:
    """The rows of the keyword search by a full scan: the k with most terms of the question, ties by key; only candidates' texts are read.

    A term that the question repeats counts again, as in the scan. No term: no rows.
    """
    terms = query.strip().lower().split()
    found = candidates(postings, terms, key, q).select(key).distinct()
    scored = collection.join(found, key, "left_semi").withColumn("score", term_hits(F.col(text), F.array(*map(F.lit, terms)).cast("array<string>")))
    return scored.filter("score > 0").orderBy(F.desc("score"), key).limit(k)
