"""Language-model scores from a log-bilinear neural model trained with noise-contrastive estimation.

The model predicts a token's class from the two classes before it. The most frequent words
and the end of a document are classes of their own; the other words fall into a fixed number
of groups by the CRC of their last three bytes. With input vectors r, output vectors q,
biases b and one diagonal matrix c for each context position, the score of class w is
``(c1*r[x1] + c2*r[x2]) . q[w] + b[w]``. A word of a group then has probability
``(count+1) / (N_group + V_group + 1)`` inside it, one share of which is for an unseen word, so
the token probabilities are normalised over the training vocabulary and one unseen word a group.

Training counts every word of every training document, then every training token takes part
in NCE against noise from the class unigram, in numpy. Texts go as class numbers, two bytes a
token, in pieces to shards that follow from their content and from the number of all tokens;
within a shard a hash orders them, so the same rows in other files give the same model. Equal
pieces are counted before they move, and their copies spread evenly over the shards. The
shards' parameters are averaged by their tokens in a tree. The normaliser of all pairs of
context classes is one matrix product, so a token costs three table reads.

The most frequent words' counts are broadcast (a fixed number of words of bounded length). The other words of a document
join the count table by word, and only their sums return to the document.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, raw_text, slices, tidy, word_runs


@dataclass(frozen=True)
class Params:
    """Sizes of the model; none depends on the corpus."""

    frequent: int = 767  # words with a class of their own
    groups: int = 256  # classes of all other words
    known: int = 262_144  # words whose counts are broadcast, about
    longest: int = 128  # bytes of a word that is broadcast or has a class of its own
    dim: int = 24
    noise: int = 64  # noise classes that each batch shares
    batch: int = 4096
    rate: float = 0.15
    fan_in: int = 64  # shards averaged at once
    shard: int = 1 << 22  # training tokens a shard, on average
    distinct: int = 500_000  # words a counting task holds before it hands them on

    @property
    def classes(self) -> int:
        return self.frequent + self.groups + 1

    @property
    def end(self) -> int:
        return self.frequent + self.groups


def group_of(word: bytes, groups: int) -> int:
    return zlib.crc32(word[-3:]) % groups


class Codes(dict):
    """word -> index of a known word, or -1 - group for the others."""

    def __init__(self, words: list[bytes], groups: int):
        super().__init__((w, i) for i, w in enumerate(words))
        self.groups = groups

    def __missing__(self, word: bytes) -> int:
        return -1 - group_of(word, self.groups)


def _count(distinct: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, docs, heavy = Counter(), 0, 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

        for batch in slices(batches, "text"):
            for text in batch.column("text").to_pylist():
                docs += 1
                for run_ in word_runs(text):
                    held.update(run_)
                    if run_ and max(map(len, run_)) > Params.longest:
                        heavy += sum(map(len, run_))
                    if len(held) >= distinct or heavy > 64 << 20:
                        yield out()
                        held, heavy = Counter(), 0
        if held:
            yield out()
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.binary()), pa.array([docs], pa.int64())], names=["word", "n"])

    return run


def count_words(texts: DataFrame, distinct: int = Params.distinct) -> DataFrame:
    """(word binary, n) over all rows of `texts` (column text, binary); word null: documents."""
    return texts.mapInArrow(_count(distinct), "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequency() -> Column:
    """Steps of a sixteenth of a doubling of the count."""
    return F.floor(F.log2("n") * 16)


@dataclass
class Vocabulary:
    """What scoring needs of the counts; arrays are by known word or by class."""

    p: Params
    words: list[bytes]
    counts: np.ndarray
    tokens: int  # N, ends included
    distinct: int  # V, the end included
    class_count: np.ndarray
    group_size: np.ndarray  # log10 of N_group + V_group + 1
    known: Column  # whether a row of counts is one of the words

    @classmethod
    def of(cls, counts: DataFrame, p: Params) -> Vocabulary:
        words = counts.filter("word is not null")
        docs = counts.filter("word is null").agg(F.sum("n")).first()[0] or 0
        groups = words.groupBy((F.crc32(F.substring("word", -3, 3)) % p.groups).alias("g")).agg(F.sum("n"), F.count("*"))
        n_group, v_group = np.zeros(p.groups, np.int64), np.zeros(p.groups, np.int64)
        for g, n, v in groups.collect():  # at most p.groups rows
            n_group[g], v_group[g] = n, v
        tokens, distinct = int(n_group.sum()) + docs, int(v_group.sum()) + (docs > 0)
        # The steps of a log scale, a bounded number, tell which words are the most frequent; of the step at
        # the bound a share by hash is known. Words with classes of their own are, whatever their step.
        short = words.filter(F.length("word") <= p.longest)
        first = [(r.n, bytes(r.word)) for r in short.orderBy(F.desc("n"), "word").limit(p.frequent).collect()]
        steps = sorted(map(tuple, short.groupBy(frequency().alias("step")).count().collect()), reverse=True)
        cut, share, room = 1 << 20, 0, p.known
        for step, k in steps:
            cut, share = step, min(1 << 60, (room << 60) // k)
            if k > room:
                break
            room -= k
        known = (frequency() > cut) | (frequency() == cut) & (F.pmod(F.xxhash64("word"), F.lit(1 << 60)) < share)
        known = (F.length("word") <= p.longest) & (known | F.col("word").isin([w for _, w in first]))
        top = sorted(((r.n, bytes(r.word)) for r in words.filter(known).collect()), key=lambda r: (-r[0], r[1]))
        own = [w for _, w in top]
        count = np.array([n for n, _ in top], np.int64)
        for w, n in zip(own[: p.frequent], count[: p.frequent].tolist(), strict=True):
            n_group[group_of(w, p.groups)] -= n
            v_group[group_of(w, p.groups)] -= 1
        first = np.zeros(p.frequent, np.int64)
        first[: min(p.frequent, len(count))] = count[: p.frequent]
        return cls(p, own, count, tokens, distinct, np.concatenate([first, n_group, [docs]]), np.log10(n_group + v_group + 1.0), known)

    def classes(self) -> np.ndarray:
        """Class of each known word."""
        return np.array([i if i < self.p.frequent else self.p.frequent + group_of(w, self.p.groups) for i, w in enumerate(self.words)], np.int32)

    def unigram(self) -> np.ndarray:
        c = self.class_count + 0.5
        return c / c.sum()


def initial(v: Vocabulary) -> dict[str, np.ndarray]:
    """Parameters at which the model is the class unigram; the seed is fixed."""
    r, p = np.random.default_rng(7), v.p
    return {
        "r": r.normal(0, 0.3, (p.classes, p.dim)).astype(np.float32),
        "q": r.normal(0, 0.02, (p.classes, p.dim)).astype(np.float32),
        "b": np.log(v.unigram()).astype(np.float32),
        "c": np.ones((2, p.dim), np.float32),
    }


def _scatter(index: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Sum of the rows of each index."""
    order = np.argsort(index, kind="stable")
    own, starts = np.unique(index[order], return_index=True)
    out = np.zeros((n, rows.shape[1]), np.float32)
    out[own] = np.add.reduceat(rows[order], starts, axis=0)
    return out


class Trainer:
    """Noise-contrastive estimation with AdaGrad over batches of (class, context 1, context 2)."""

    def __init__(self, params: dict[str, np.ndarray], noise: np.ndarray, p: Params, seed: int):
        self.w = {k: x.copy() for k, x in params.items()}
        self.g = {k: np.full_like(x, 1e-6) for k, x in params.items()}
        self.p, self.n, self.random = p, 0, np.random.default_rng(seed)
        self.cdf = np.cumsum(noise)
        self.log_kn = np.log(noise * p.noise).astype(np.float32)

    def step(self, y: np.ndarray, x1: np.ndarray, x2: np.ndarray) -> None:
        w, p = self.w, self.p
        z = np.minimum(np.searchsorted(self.cdf, self.random.random(p.noise)), p.classes - 1)
        r1, r2, qy, qz = w["r"][x1], w["r"][x2], w["q"][y], w["q"][z]
        h = w["c"][0] * r1 + w["c"][1] * r2
        sy = np.einsum("ij,ij->i", h, qy) + w["b"][y] - self.log_kn[y]
        sz = h @ qz.T + (w["b"][z] - self.log_kn[z])
        ey = (-1 / (1 + np.exp(np.clip(sy, -30, 30)))).astype(np.float32)  # d loss / d score
        ez = 1 / (1 + np.exp(np.clip(-sz, -30, 30)))
        dh = ey[:, None] * qy + ez @ qz
        dq = _scatter(y, ey[:, None] * h, p.classes)
        db = np.bincount(y, ey, p.classes)
        np.add.at(dq, z, ez.T @ h)
        np.add.at(db, z, ez.sum(0))
        dr = _scatter(np.concatenate([x1, x2]), np.concatenate([w["c"][0] * dh, w["c"][1] * dh]), p.classes)
        dc = np.stack([(r1 * dh).sum(0), (r2 * dh).sum(0)])
        for k, d in (("q", dq), ("b", db), ("r", dr), ("c", dc)):
            d = (d / len(y)).astype(np.float32)
            self.g[k] += d * d
            w[k] -= p.rate * (0.1 if k == "c" else 1) * d / np.sqrt(self.g[k])
        self.n += len(y)


def contexts(codes: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The classes one and two before each; a document starts after an end."""
    x1 = np.concatenate([[end], codes[:-1]]).astype(codes.dtype)
    x2 = np.concatenate([[end], x1[:-1]]).astype(codes.dtype)
    x2[x1 == end] = end
    return x1, x2


def _pack(w: dict[str, np.ndarray]) -> bytes:
    return b"".join(w[k].astype("<f4").tobytes() for k in sorted(w))


def _unpack(data: bytes, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    flat, out, at = np.frombuffer(data, "<f4"), {}, 0
    for k in sorted(like):
        out[k] = flat[at : at + like[k].size].reshape(like[k].shape)
        at += like[k].size
    return out


def _encode(words, p: Params):
    """Pieces of class numbers, one for each run of words; each begins with the two classes before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, of = words.value
        codes = Codes(own, p.groups)
        start = np.full(2, p.end, "<i2")

        def pieces(text: bytes) -> Iterator[bytes]:
            piece, empty = start, True
            for run_ in word_runs(text):
                if not run_:
                    continue
                if not empty:
                    yield piece.tobytes()
                c = np.fromiter(map(codes.__getitem__, run_), np.int32, len(run_))
                piece, empty = np.concatenate([piece[-2:], np.where(c >= 0, of[c], p.frequent - 1 - c).astype("<i2")]), False
            yield np.append(piece, start[:1]).tobytes()

        for batch in slices(batches, "text"):
            texts = zip(batch.column("k1").to_pylist(), batch.column("k2").to_pylist(), batch.column("text").to_pylist(), strict=True)
            rows = [(k1, k2, part, data) for k1, k2, text in texts for part, data in enumerate(pieces(text))]
            kinds = {"k1": pa.int64(), "k2": pa.int64(), "part": pa.int32(), "codes": pa.binary()}
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds.values())], names=list(kinds))

    return tidy(run)


def sharded(texts: DataFrame, words, shards: int, p: Params) -> DataFrame:
    """(shard, codes): the pieces of all texts, each shard in one partition and in its own order.

    Both follow from the rows alone, however they lie in files. c equal pieces give c rows: they are
    counted before the shuffle, then c divided by the shards goes to each, and there they are repeated.
    """
    keyed = texts.select(F.xxhash64("text").alias("k1"), F.xxhash64(F.lit(1), "text").alias("k2"), "text")
    rows = keyed.mapInArrow(_encode(words, p), "k1 long, k2 long, part int, codes binary")
    rows = rows.groupBy("k1", "k2", "part").agg(F.first("codes").alias("codes"), F.count("*").alias("c"))
    n, j = F.lit(shards).cast("long"), F.col("j")
    rows = rows.withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.least("c", n) - 1)))
    rows = rows.select(
        F.pmod(F.pmod("k1", n) + F.col("part") + j, n).alias("shard"),
        F.when(j < F.pmod("c", n), 1).otherwise(0).alias("more"),
        *("k1", "k2", "part", "c", "codes"),
    ).repartition(shards, "shard")
    times = F.floor(F.col("c") / n).cast("long") + F.col("more")
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), times)))
    rows = rows.withColumn("h", F.xxhash64("k1", "k2", "part", "copy"))
    return rows.sortWithinPartitions("shard", "h", "k1", "k2", "part", "copy").select("shard", "codes")


_PARAMS = "shard long, n long, params binary"


def _params_batch(shard: int, n: int, data: bytes) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip((shard, n, data), kinds, strict=True)], names=["shard", "n", "params"])


def _train(start, noise, p: Params):
    """Parameters of each shard; its number is the seed of its noise."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, shard = None, None
        rest: list[np.ndarray] = []
        held = 0

        def learn() -> None:
            nonlocal rest, held
            y, x1, x2 = (np.concatenate([c[i : len(c) - 2 + i] for c in rest]) for i in (2, 1, 0))
            for i in range(0, len(y), p.batch):
                t.step(y[i : i + p.batch], x1[i : i + p.batch], x2[i : i + p.batch])
            rest, held = [], 0

        for batch in batches:
            for own, data in zip(batch.column("shard").to_pylist(), batch.column("codes").to_pylist(), strict=True):
                if own != shard:
                    if held:
                        learn()
                    if t:
                        yield _params_batch(shard, t.n, _pack(t.w))
                    t, shard = Trainer(start.value, noise, p, own), own
                rest.append(np.frombuffer(data, "<i2"))
                held += len(rest[-1]) - 2
                if held >= 64 * p.batch:
                    learn()
        if held:
            learn()
        if t:
            yield _params_batch(shard, t.n, _pack(t.w))

    return tidy(run)


def _mean(rows: list[tuple[int, int, bytes]]) -> tuple[int, bytes]:
    """Tokens and mean parameters by tokens, added up in the order of the shards."""
    n = sum(k for _, k, _ in rows)
    total = sum(np.frombuffer(bytes(data), "<f4").astype(np.float64) * k for _, k, data in sorted(rows))
    return n, (total / n).astype("<f4").tobytes()


def _average(fan_in: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, rows = None, []
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("shard", "n", "params")), strict=True):
                if rows and row[0] // fan_in != group:
                    yield _params_batch(group, *_mean(rows))
                    rows = []
                group = row[0] // fan_in
                rows.append(row)
        if rows:
            yield _params_batch(group, *_mean(rows))

    return run


def train(texts: DataFrame, v: Vocabulary) -> dict[str, np.ndarray]:
    """One pass of NCE over every token of `texts`; the shards' parameters averaged by their tokens."""
    sc, p = texts.sparkSession.sparkContext, v.p
    start = initial(v)
    of = v.classes() if len(v.words) else np.zeros(1, np.int32)
    shards = max(1, math.ceil(v.tokens / p.shard))
    rows = sharded(texts, sc.broadcast((v.words, of)), shards, p)
    found = rows.mapInArrow(_train(sc.broadcast(start), v.unigram(), p), _PARAMS)
    while shards > p.fan_in:
        shards = math.ceil(shards / p.fan_in)
        group = F.floor(F.col("shard") / p.fan_in)
        found = found.repartition(shards, group).sortWithinPartitions("shard").mapInArrow(_average(p.fan_in), _PARAMS)
    own = found.collect()  # at most fan_in rows of a fixed size
    return _unpack(_mean([(r.shard, r.n, r.params) for r in own])[1], start) if own else start


class Tables:
    """log10 P(class | context classes) = one[x1, w] + two[x2, w] - norm[x1, x2]."""

    def __init__(self, w: dict[str, np.ndarray]):
        x = {k: a.astype(np.float64) for k, a in w.items()}
        one, two = (x["c"][0] * x["r"]) @ x["q"].T + x["b"], (x["c"][1] * x["r"]) @ x["q"].T
        top = one.max(1, keepdims=True), two.max(1, keepdims=True)
        norm = np.log(np.exp(one - top[0]) @ np.exp(two - top[1]).T) + top[0] + top[1].T
        self.one, self.two, self.norm = (a.astype(np.float32) / np.float32(math.log(10)) for a in (one, two, norm))

    def score(self, y: np.ndarray, x1: np.ndarray, x2: np.ndarray) -> np.ndarray:
        return (self.one[x1, y] + self.two[x2, y] - self.norm[x1, x2]).astype(np.float64)


def _score(shared, p: Params):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, of, log_count, group_size, tables, base_of_all, end_count = shared.value
        codes, uid = Codes(own, p.groups), TaskContext.get().partitionId() << 40
        names = ["uid", "doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "rare", "times"]
        for batch in slices(batches, "text"):
            out: list[list] = [[] for _ in range(7)]
            for text in batch.column("text").to_pylist():
                n = known = 0
                base = score = 0.0
                x1 = x2 = p.end
                rare: Counter = Counter()
                for run_ in chain(word_runs(text), (None,)):
                    if run_ is None:
                        y, inner = np.array([p.end]), 0.0
                        logs, known = math.log10(end_count + 1), known + (end_count > 0)
                    else:
                        if not run_:
                            continue
                        c = np.fromiter(map(codes.__getitem__, run_), np.int32, len(run_))
                        seen = c >= 0
                        y = np.where(seen, of[c], p.frequent - 1 - c)
                        logs = float(log_count[c[seen]].sum())
                        # Within its class, a word of a group has (count+1) / size; frequent words are alone.
                        grouped = y >= p.frequent
                        inner = float(log_count[c[seen & grouped]].sum()) - float(group_size[y[grouped] - p.frequent].sum())
                        known += int(seen.sum())
                        rare.update([run_[i] for i in np.flatnonzero(~seen)])
                    a = np.concatenate([[x1], y[:-1]]).astype(np.int32)
                    b = np.concatenate([[x2, x1], y[:-2]]).astype(np.int32)[: len(y)]
                    score += float(tables.score(y, a, b).sum()) + inner
                    base += logs - len(y) * base_of_all
                    x2, x1 = int(a[-1]), int(y[-1])
                    n += len(y)
                for k, value in enumerate((uid, n, known, base, score, list(rare), list(rare.values()))):
                    out[k].append(value)
                uid += 1
            i64, f64 = pa.int64(), pa.float64()
            columns = [pa.array(out[0], i64), batch.column("doc_id"), batch.column("held_out"), pa.array(out[1], i64), pa.array(out[2], i64), pa.array(out[3], f64), pa.array(out[4], f64), pa.array(out[5], pa.list_(pa.binary())), pa.array(out[6], pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def held_out(column: str = "doc_id", modulus: int = 7, remainder: int = 2) -> Column:
    """crc32 of the id as text leaves the remainder; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def score_documents(docs: DataFrame, p: Params = Params()) -> DataFrame:  # noqa: B008
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learns from the rows that :func:`held_out` leaves. Null and empty texts are one end.
    Repeated rows each return. The same rows in other files give the same scores, but for the
    rounding of sums of rare words. Without training rows every probability is that of an unseen
    word; an empty table returns no rows. Extra columns are not read.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", held_out().alias("held_out"), raw_text().alias("text"))
    texts = rows.filter(~F.col("held_out")).select("text")
    counts = materialize(count_words(texts, p.distinct))
    v = Vocabulary.of(counts, p)
    tables = Tables(train(texts, v))
    of = v.classes() if len(v.words) else np.zeros(1, np.int32)
    log_count = np.log10(v.counts + 1.0) if len(v.words) else np.zeros(1)
    shared = docs.sparkSession.sparkContext.broadcast(
        (v.words, of, log_count, v.group_size, tables, math.log10(v.tokens + v.distinct + 1), int(v.class_count[-1]))
    )
    schema = f"uid long, doc_id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double, rare array<binary>, times array<int>"
    found = materialize(rows.mapInArrow(_score(shared, p), schema))
    pairs = found.select("uid", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("uid", F.col("x.rare").alias("word"), F.col("x.times").alias("times"))
    rest = counts.filter(F.col("word").isNotNull() & ~v.known)
    sums = pairs.join(rest, "word").groupBy("uid").agg(F.sum("times").alias("k"), F.sum(F.col("times") * F.log10(F.col("n") + F.lit(1.0))).alias("logs"))
    more = F.coalesce("logs", F.lit(0.0))
    return found.join(sums, "uid", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("k", F.lit(0))).alias("n_known"),
        F.lit(v.tokens).cast("long").alias("train_tokens"),
        (F.col("base_score") + more).alias("base_score"),
        (F.col("score") + more).alias("score"),
    )


def op3(spark, sf_dir: str) -> DataFrame:
    """Contract query: one row per document with the model's and the base's log10 probability."""
    return score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
