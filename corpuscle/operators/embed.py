"""Embedding text in Arrow batches, with the embedder as a parameter."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hash_embedder(texts: list[str], dim: int = 64) -> np.ndarray:
    """A deterministic stand-in for a model server: signed counts of hashed words, unit length."""
    out = np.zeros((len(texts), dim), np.float32)
    for i, text in enumerate(texts):
        for w in text.lower().split():
            h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
            out[i, h % dim] += 1 if h >> 63 else -1
        n = float(np.linalg.norm(out[i]))
        out[i] = out[i] / n if n else out[i]
    return out


def embed(df: DataFrame, key: str, text: str, embedder: Callable[[list[str]], np.ndarray] = hash_embedder, batch: int = 100, keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, the kept columns, embedding): the vector comes back on its own row, so no positional join is needed."""
    own = [key, *keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in range(0, b.num_rows, batch):
                part = b.slice(s, batch)
                vectors = embedder([t or "" for t in part.column(text).to_pylist()])
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in own), pa.array(list(vectors), pa.list_(pa.float32()))], names=[*own, "embedding"])

    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in own)
    return df.select(*own, *([text] if text not in own else [])).mapInArrow(run, f"{kinds}, embedding array<float>")


def embed_missing(df: DataFrame, done: DataFrame, key: str, text: str, **options) -> DataFrame:
    """Resume: embed only the keys that have no vector yet."""
    return embed(df.join(done.select(key), key, "left_anti"), key, text, **options)


def probe(embedder: Callable[[list[str]], np.ndarray], seconds: float = 10.0) -> tuple[bool, str]:
    """Whether the embedder answers a test text within the time with one vector; and what it said instead."""
    start = time.monotonic()
    try:
        found = embedder(["test"])
    except Exception as e:  # a probe reports whatever is wrong
        return False, f"{type(e).__name__}: {e}"
    took = time.monotonic() - start
    if len(found) != 1 or not len(found[0]):
        return False, "no vector came back"
    return took <= seconds, f"{took:.1f} s"


def batch_metrics(df: DataFrame, key: str, text: str, batch: int = 100) -> DataFrame:
    """(batch, n, avg_tokens) of the batches that ids fall into: what a run over them records."""
    rows = df.select(F.floor(F.col(key) / batch).alias("batch"), F.floor(F.length(F.coalesce(text, F.lit(""))) / 4).alias("t"))
    return rows.groupBy("batch").agg(F.count("*").alias("n"), F.avg("t").alias("avg_tokens"))
