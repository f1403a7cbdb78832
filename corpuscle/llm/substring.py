"""Passages that repeat across documents, found by fixed-block anchors.

Each text is cut into non-overlapping blocks of 25 words (for windows of 50: any window holds a whole block),
and these reference blocks are the index. Every rolling window of 25 words of every text probes it. Where a probe meets a block of
another text, both are anchors of a possible repeat. Anchors are extended to both sides by up to 25 words:
every window of 50 words that holds an anchor is compared, by 96 bits of digest, with those of the other texts, and the
union of the windows that a document with a smaller id has as well are the maximal exact repeats of 50 words or more.

What is compared are texts, not rows: copies share one key (128 bits of digest), the smallest id of a text stands for it, and a
copy with a larger id goes whole. No pair of documents becomes a row: a group of any size is one sorted run of
digests. A task sends hashes packed by bucket, a window that many of its texts share only once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..durable import forget, written
from .common import OWN, raw_text, slices, text_runs, tidy

WINDOW = 50
#: Words that a task takes at once, and hashes that a bucket holds at most on average.
WORDS, HASHES = 1 << 20, 1 << 21
#: Texts of one slice with one window that send it each; more send it once and are anchors without asking.
MANY = 8
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_ALL = (1 << 64) - 1
_LOW = np.uint64((1 << 47) - 1)
_BLOBS = "bucket int, done boolean, runs binary, counts binary, low binary, high binary"


def word_hashes(text: bytes) -> np.ndarray:
    """A 64-bit hash of each word between ASCII white space."""
    parts = []
    for part in text_runs(text):
        words = part.split()
        parts.append(np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)))
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64)


def rolling(words: np.ndarray, n: int, base: int = _BASES[0]) -> np.ndarray:
    """The hash of every n consecutive words, put together from runs of 1, 2, 4, ... words."""
    count = len(words) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    run, step, power = words * np.uint64(0xD6E8FEB86659FD93) ^ np.uint64(base), 1, base  # power: base ** step
    out, done, shift = np.zeros(count, np.uint64), 0, 1  # shift: base ** done
    while done < n:
        if n & step:
            out += run[done : done + count] * np.uint64(shift)
            done, shift = done + step, shift * power & _ALL
        if done < n:
            run = run[:-step] + run[step:] * np.uint64(power)
            step, power = step * 2, power * power & _ALL
    out = (out ^ (out >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    out = (out ^ (out >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return out ^ (out >> np.uint64(33))


def _groups(*keys: np.ndarray) -> np.ndarray:
    """Where a new group begins in sorted columns."""
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _pack(bucket: np.ndarray, d: np.ndarray, low: np.ndarray, high: np.ndarray, runs: np.ndarray, done: bool = False) -> pa.RecordBatch:
    """A row a bucket: its texts' identities (rows d of `runs`), how many hashes each has, and these in two columns."""
    order = np.argsort(bucket * len(runs) + d, kind="stable")
    bucket, d, low, high = bucket[order], d[order], low[order], high[order]
    first = _groups(bucket, d)
    counts = np.diff(np.append(first, len(d))).astype(np.uint32)
    own = np.ascontiguousarray(runs[d[first]])
    cut = _groups(bucket)
    ends = np.append(cut[1:], len(d))
    columns: list[list[bytes]] = [[], [], [], []]
    for a, b, ra, rb in zip(cut, ends, np.searchsorted(first, cut), np.searchsorted(first, ends), strict=True):
        for column, x in zip(columns, (own[ra:rb], counts[ra:rb], low[a:b], high[a:b]), strict=True):
            column.append(x.tobytes())
    n = len(cut)
    return pa.RecordBatch.from_arrays([pa.array(bucket[cut], pa.int32()), pa.array([done] * n, pa.bool_()), *(pa.array(c, pa.binary()) for c in columns)], names=["bucket", "done", "runs", "counts", "low", "high"])


def _slices(batches: Iterator[pa.RecordBatch], key: list[str], more: list[str], least: int) -> Iterator[tuple[list[np.ndarray], list[tuple]]]:
    """Word hashes and the named columns of the texts with `least` words, about `WORDS` at once, each key once."""
    words: list[np.ndarray] = []
    rows: list[tuple] = []
    seen: set = set()
    held = 0
    for batch in slices(batches, "text"):
        for text, *row in zip(*(batch.column(c).to_pylist() for c in ("text", *key, *more)), strict=True):
            own = tuple(row[: len(key)])
            if own in seen or len(text) < 2 * least - 1:
                continue
            seen.add(own)
            w = word_hashes(text)
            if len(w) >= least:
                words.append(w)
                rows.append(tuple(row))
                held += len(w)
            if held >= WORDS:
                yield words, rows
                words, rows, seen, held = [], [], set(), 0
    if rows:
        yield words, rows


def _places(words: list[np.ndarray], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All words in one array, each one's text, each text's start, and where runs of n words lie within a text."""
    lengths = np.array([len(w) for w in words])
    doc = np.repeat(np.arange(len(words)), lengths)
    return np.concatenate(words), doc, np.cumsum(lengths) - lengths, np.flatnonzero(doc[: len(doc) - n + 1] == doc[n - 1 :])


def _probes(window: int, buckets: int):
    """Every rolling window's hash, with a bit for reference blocks; what a slice can tell by itself is done."""
    block = (window + 1) // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words, rows in _slices(batches, ["k1"], [], window):
            runs = np.array(rows, np.int64)
            w, doc, starts, at = _places(words, block)
            h, d = rolling(w, block)[at], doc[at]
            ref = (at - starts[d]) % block == 0
            order = np.argsort(h, kind="stable")  # texts stay in order within a hash
            h, d, ref = h[order], d[order], ref[order]
            first = _groups(h, d)
            ref, h, d = np.logical_or.reduceat(ref, first), h[first], d[first]
            first = _groups(h)
            size = np.diff(np.append(first, len(h)))
            found = (size > 1) & (np.logical_or.reduceat(ref, first) | (size > MANY))
            each = np.repeat(found, size)
            send = ~each
            send[first[found]] = True
            ref |= each
            value = ((h & _LOW) << np.uint64(1)) | ref
            low, high = (value & np.uint64(0xFFFFFFFF)).astype(np.uint32), (value >> np.uint64(32)).astype(np.uint16)
            yield _pack(_bucket(h[send], buckets), d[send], low[send], high[send], runs)
            if each.any():  # by text and hash: many texts with one hash part, one text in many slices meets itself
                own = _mixed(h[each] ^ runs[d[each], 0].view(np.uint64))
                yield _pack(_bucket(own, buckets), d[each], low[each], high[each], runs, True)

    return tidy(run)


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bool, list[dict]]]:
    """The rows of each bucket, which come together; those that are done by themselves."""
    now, held = None, []
    for batch in batches:
        for i in range(batch.num_rows):
            row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
            if held and (row["bucket"], row["done"]) != now:
                yield now[1], held
                held = []
            now = row["bucket"], row["done"]
            held.append(row)
    if held:
        yield now[1], held


def _met(parts: DataFrame, run, kinds: str) -> DataFrame:
    """`run` over the buckets of packed rows, one bucket at a time."""
    return parts.repartition("bucket").sortWithinPartitions("bucket", "done").mapInArrow(tidy(run), kinds)


def _column(rows: list[dict], name: str, kind) -> np.ndarray:
    return np.concatenate([np.frombuffer(r[name], kind) for r in rows])


def _texts(rows: list[dict], width: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct identities in packed rows, and each hash's."""
    keys, at = np.unique(_column(rows, "runs", np.int64).reshape(-1, width), axis=0, return_inverse=True)
    return keys, np.repeat(at.ravel(), _column(rows, "counts", np.uint32))


def _by_text(keys: np.ndarray, text: np.ndarray, h: np.ndarray, buckets: int) -> pa.RecordBatch:
    """Distinct hashes of each text, packed for the buckets of the texts' keys (the first column)."""
    order = np.lexsort((h, text))
    text, h = text[order], h[order]
    first = _groups(text, h)
    text, h = text[first], h[first]
    return _pack(_bucket(_mixed(keys[text, 0].view(np.uint64)), buckets), text, h, np.zeros(len(h), "V0"), keys)


def _anchors(buckets: int):
    """Of each text, the rolling windows that meet a reference block of another text (or are one that is met)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for done, rows in _by_bucket(batches):
            keys, text = _texts(rows, 1)
            value = _column(rows, "low", np.uint32).astype(np.uint64) | (_column(rows, "high", np.uint16).astype(np.uint64) << np.uint64(32))
            h, ref = value >> np.uint64(1), (value & np.uint64(1)).astype(bool)
            if not done:
                order = np.argsort(h, kind="stable")
                h, ref, text = h[order], ref[order], text[order]
                first = _groups(h)
                met = (np.minimum.reduceat(text, first) != np.maximum.reduceat(text, first)) & np.logical_or.reduceat(ref, first)
                met = np.repeat(met, np.diff(np.append(first, len(h))))
                h, text = h[met], text[met]
            if len(h):
                yield _by_text(keys, text, h, buckets)

    return run


def _gathered(names: list[str]):
    """(names, hashes): one row a text, its distinct hashes as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _by_bucket(batches):
            keys, text = _texts(rows, len(names))
            h = _column(rows, "low", np.uint64)
            order = np.lexsort((h, text))
            text, h = text[order], h[order]
            first = _groups(text, h)
            text, h = text[first], np.ascontiguousarray(h[first])
            ends = np.append(_groups(text), len(h)) * 8
            data = h.tobytes()
            lists = [data[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*(pa.array(keys[:, j]) for j in range(len(names))), pa.array(lists, pa.binary())], names=[*names, "hashes"])

    return run


def _windows(window: int, buckets: int):
    """The windows around anchors, 96 bits each. A window's smallest text in the slice asks for it, the others are done."""
    block = (window + 1) // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words, rows in _slices(batches, ["k1", "k2"], ["m", "hashes"], window):
            runs = np.array([(m, a, b) for a, b, m, _ in rows], np.int64)
            w, doc, _, whole = _places(words, window)
            anchor = np.zeros(len(w) + 1, np.int64)
            h, at = rolling(w, block) & _LOW, 0
            for own, (*_, known) in zip(words, rows, strict=True):
                end = at + len(own) - block + 1
                anchor[at:end] = np.isin(h[at:end], np.frombuffer(known, np.uint64))
                at += len(own)
            upto = np.concatenate([[0], np.cumsum(anchor)])
            whole = whole[upto[whole + window - block + 1] > upto[whole]]  # an anchor lies inside
            if not len(whole):
                continue
            a, b, d = rolling(w, window)[whole], (rolling(w, window, _BASES[1])[whole] >> np.uint64(32)).astype(np.uint32), doc[whole]
            m = runs[d, 0]
            order = np.lexsort((d, m, b, a))
            a, b, d, m = a[order], b[order], d[order], m[order]
            first = _groups(a, b, d)
            a, b, d, m = a[first], b[first], d[first], m[first]
            first = _groups(a, b)
            later = m > np.repeat(m[first], np.diff(np.append(first, len(a))))
            yield _pack(_bucket(a[~later], buckets), d[~later], a[~later], b[~later], runs)
            if later.any():
                own = _mixed(a[later] ^ runs[d[later], 1].view(np.uint64))
                yield _pack(_bucket(own, buckets), d[later], a[later], b[later], runs, True)

    return tidy(run)


def _repeats(buckets: int):
    """Of each text, the windows that a text with a smaller id has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for done, rows in _by_bucket(batches):
            keys, text = _texts(rows, 3)
            a, b = _column(rows, "low", np.uint64), _column(rows, "high", np.uint32)
            if not done:
                order = np.lexsort((keys[text, 0], b, a))
                a, b, text = a[order], b[order], text[order]
                first, m = _groups(a, b), keys[text, 0]
                later = m > np.repeat(m[first], np.diff(np.append(first, len(a))))
                a, text = a[later], text[later]
            if len(a):
                yield _by_text(np.ascontiguousarray(keys[:, 1:]), text, a, buckets)

    return run


def _buckets(docs: DataFrame) -> int:
    """So many that a bucket's hashes fit a task, and at least one a shuffle partition."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(int(size / 6 / HASHES) + 1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(k1, k2, m, copied, hashes) of every text of which something goes; docs: doc_id, text (binary), k1, k2.

    hashes: of the windows that a document with an id smaller than m, the text's smallest one, has. copied: there
    are larger ids with this text, of which every window goes.
    """
    known = docs.filter("doc_id IS NOT NULL")
    buckets = _buckets(known)
    key = ["k1", "k2"]
    texts = written(known.groupBy(*key).agg(F.min("doc_id").alias("m"), F.max("doc_id").alias("most")))
    probes = known.select("k1", "text").mapInArrow(_probes(window, buckets), _BLOBS)
    anchors = written(_met(_met(probes, _anchors(buckets), _BLOBS), _gathered(["k1"]), "k1 long, hashes binary"))
    asked = known.join(texts.join(anchors, "k1").select(*key, "m", "hashes"), key).filter("doc_id = m").select("text", *key, "m", "hashes")
    windows = asked.mapInArrow(_windows(window, buckets), _BLOBS)
    later = written(_met(_met(windows, _repeats(buckets), _BLOBS), _gathered(key), "k1 long, k2 long, hashes binary"))
    forget(anchors)
    return texts.join(later, key, "left").select(*key, "m", (F.col("most") > F.col("m")).alias("copied"), "hashes").filter("copied OR hashes IS NOT NULL")


def covered(words: np.ndarray, hashes: np.ndarray, window: int) -> np.ndarray:
    """Which words lie in a window whose hash is listed."""
    hit = np.isin(rolling(words, window), hashes)
    edge = np.zeros(len(words) + 1, np.int64)
    edge[: len(hit)] += hit
    edge[window : window + len(hit)] -= hit
    return np.cumsum(edge)[:-1] > 0


def _remove(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            texts, ids, ms, lists = (batch.column(c).to_pylist() for c in ("text", "id", "m", "hashes"))
            kept, counts, removed = [], [], []
            for text, i, m, own in zip(texts, ids, ms, lists, strict=True):
                words = text.split()
                counts.append(len(words))
                if len(words) >= window and m is not None and i is not None and (i > m or own):
                    if i > m:
                        words = []
                    else:
                        gone = covered(word_hashes(text), np.frombuffer(own, np.uint64), window)
                        words = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                kept.append(b" ".join(words))
                removed.append(counts[-1] - len(words))
            columns = {c: batch.column(c) for c in batch.schema.names if c not in ("text", "id", "m", "hashes")}
            columns |= {f"{OWN}kept": pa.array(kept, pa.binary()).cast(pa.string()), f"{OWN}words": pa.array(counts, pa.int64()), f"{OWN}removed": pa.array(removed, pa.int64())}
            yield pa.RecordBatch.from_pydict(columns)

    return tidy(run)


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """All rows and columns, with ``__cc_kept`` (the kept words, one space between), ``__cc_words`` and ``__cc_removed`` (counts).

    A word goes if a window of `window` words over it also starts in a document with a smaller doc_id (an integer). Windows are
    judged on the input. Null and empty texts have no words. Rows without doc_id are neither smaller nor larger than others: they stay
    whole and take nothing away. Rows with one id don't take from each other. Texts are compared whole, whatever their length; a
    passage may be in any number of documents. An empty table returns no rows; columns of any name pass.
    """
    if window < 2:
        raise ValueError("a window has two words or more")
    text, i = raw_text(), F.col("doc_id").cast("long")
    keys = [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2")]
    found = repeats(docs.select(i.alias("doc_id"), text.alias("text"), *keys), window)
    rows = docs.select(*(F.col(f"`{c}`").alias(f"c{n}") for n, c in enumerate(docs.columns)), text.alias("text"), i.alias("id"), *keys)
    joined = rows.join(found, ["k1", "k2"], "left").drop("k1", "k2", "copied")
    kinds = ", ".join(f"c{n} {f.dataType.simpleString()}" for n, f in enumerate(docs.schema.fields))
    out = joined.mapInArrow(_remove(window), f"{kinds}, {OWN}kept string, {OWN}words long, {OWN}removed long")
    return out.select(*(F.col(f"c{n}").alias(c) for n, c in enumerate(docs.columns)), f"{OWN}kept", f"{OWN}words", f"{OWN}removed")


def op13(spark, sf_dir: str) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256 (of the kept words joined by one space)."""
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = remove_repeats(rows.select("doc_id", "text"))
    return out.select("doc_id", F.col(f"{OWN}words").alias("n_words"), F.col(f"{OWN}removed").alias("n_removed"), F.sha2(f"{OWN}kept", 256).alias("kept_sha256"))
