"""Language identification in two steps: the family, then one-versus-one machines within it.

A text is its lower-cased letters; its features are hashed byte bigrams and trigrams, square
roots of their shares, so texts of any length weigh alike. One-versus-one linear support
vector machines choose among the families, then among the languages of the chosen family only.
All are fitted in numpy from a bounded sample of labelled rows, each machine by a task.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import raw_text, slices, tidy
from .linear import sigmoid
from .lm import held_out

#: Families of language codes (fixed values); any other code is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af", "lb", "fy"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl", "oc"),
    "slavic": ("ru", "pl", "cs", "sk", "uk", "bg", "sr", "hr", "sl", "mk", "be", "bs"),
    "uralic": ("fi", "et", "hu"),
}
UNKNOWN = "und"


@dataclass(frozen=True)
class Params:
    sample: int = 3000  # labelled rows the machines are fitted on, shared out evenly over the languages
    least: int = 30  # rows of each language however many there are; all rows of one that has fewer
    bits: int = 12  # hashed features: 2**bits for trigrams, a quarter for bigrams
    ridge: float = 1e-4
    steps: int = 300  # of a machine's descent
    slope: float = 3.0  # of the sigmoid that turns a margin into a score


_LETTER = regex.compile(r"\p{L}")
_BREAK = bytes(b if chr(b).isalpha() or b >= 0x80 else 0x20 for b in range(256))


def family_of(lang: str) -> str:
    return next((f for f, own in FAMILIES.items() if lang in own), lang)


def features(text: str, bits: int) -> np.ndarray:
    """Unit vector of the text's letters; every n-gram of the whole text counts."""
    data = re.sub(rb" +", b" ", b" " + text.lower().encode("utf-8", "replace").translate(_BREAK) + b" ")
    size, small = 1 << bits, 1 << (bits - 2)
    out = np.zeros(size + small)
    for at in range(0, len(data), 1 << 20):
        a = np.frombuffer(data[at : at + (1 << 20) + 2], np.uint8).astype(np.uint32)
        two = (a[:-1] << np.uint32(8)) | a[1:]
        three = (two[:-1] << np.uint32(8)) | a[2:]
        more = len(data) > at + (1 << 20) + 2
        out[:size] += np.bincount(three * np.uint32(2654435761) >> np.uint32(32 - bits), minlength=size)
        two = two[: 1 << 20] if more else two
        out[size:] += np.bincount(two * np.uint32(2654435761) >> np.uint32(34 - bits), minlength=small)
    out = np.sqrt(out)
    norm = np.linalg.norm(out)
    return (out / norm if norm else out).astype(np.float32)


def fit_pair(x: np.ndarray, sign: np.ndarray, p: Params) -> tuple[np.ndarray, float]:
    """(coefficients of the rows, bias) of a squared-hinge machine; sign is -1 or 1 and both sides weigh alike.

    The weights are the rows' sum by their coefficients, so the steps need the rows' products only.
    """
    each = np.where(sign > 0, 1 / max(1, (sign > 0).sum()), 1 / max(1, (sign < 0).sum()))
    each /= each.sum()
    gram = x @ x.T
    v, root, top = np.ones(len(x)), np.sqrt(each), 1.0
    for _ in range(20):  # the largest curvature, by power iteration
        u = root * v
        v = root * (gram @ u.astype(gram.dtype) + u.sum())
        top = float(np.linalg.norm(v)) or 1.0
        v = v / top
    rate = 1 / (2.2 * top + p.ridge)
    own, ahead, bias, bias_ahead, t = np.zeros(len(x)), np.zeros(len(x)), 0.0, 0.0, 1.0
    for _ in range(p.steps):
        z = gram @ ahead.astype(gram.dtype) + bias_ahead
        g = each * (-2 * sign * np.maximum(0, 1 - sign * z))
        new, new_bias = ahead - rate * (g + p.ridge * ahead), bias_ahead - rate * g.sum()
        after = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead, bias_ahead = new + (t - 1) / after * (new - own), new_bias + (t - 1) / after * (new_bias - bias)
        own, bias, t = new, new_bias, after
    return own, float(bias)


class OneVersusOne:
    """A machine for each pair of classes; votes decide, then mean chances.

    Machines are kept as coefficients of the sample's rows: those of class a in the machine of (a, b) are column b
    of its matrix. Where there are fewer machines than rows their weights are summed up, which gives the same margins.
    """

    def __init__(self, x: np.ndarray, y: list[str], p: Params):
        self.x, self.p, self.classes = x, p, sorted(set(y))
        label, k = np.array(y), len(self.classes)
        self.rows = [np.flatnonzero(label == c) for c in self.classes]
        self.pairs = list(combinations(range(k), 2))
        self.coefficients = [np.zeros((len(r), k), np.float32) for r in self.rows]
        self.bias = np.zeros((k, k))
        self.weights = None

    def solve(self, a: int, b: int) -> tuple[np.ndarray, float]:
        """The machine of a pair: coefficients of the rows of a, then of b; and its bias."""
        own = np.concatenate([self.rows[a], self.rows[b]])
        sign = np.repeat([1.0, -1.0], [len(self.rows[a]), len(self.rows[b])])
        return fit_pair(self.x[own].astype(np.float32), sign, self.p)

    def take(self, a: int, b: int, own: np.ndarray, bias: float) -> None:
        n = len(self.rows[a])
        self.coefficients[a][:, b], self.coefficients[b][:, a], self.bias[a, b] = own[:n], own[n:], bias

    def ready(self) -> None:
        """After all machines are in."""
        if len(self.pairs) <= len(self.x):
            self.weights = np.zeros((len(self.pairs), self.x.shape[1]), np.float32)
            for m, (a, b) in enumerate(self.pairs):
                for c, other in ((a, b), (b, a)):
                    self.weights[m] += self.coefficients[c][:, other] @ self.x[self.rows[c]].astype(np.float32)
            self.x = self.coefficients = None

    def margins(self, x: np.ndarray) -> np.ndarray:
        """By row, a and b: how far the row is on the side of a."""
        k = len(self.classes)
        out = np.zeros((len(x), k, k))
        if self.weights is not None:
            found = x @ self.weights.T
            for m, (a, b) in enumerate(self.pairs):
                out[:, a, b] = found[:, m] + self.bias[a, b]
        else:
            for a, rows in enumerate(self.rows):
                part = (x @ self.x[rows].astype(np.float32).T) @ self.coefficients[a]
                out[:, a, a + 1 :] += part[:, a + 1 :]
                out[:, :a, a] += part[:, :a]
            out += np.triu(self.bias, 1)
        return out - out.transpose(0, 2, 1)

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Class position and score of each row: the mean chance against the other classes."""
        k = len(self.classes)
        if k == 1:
            return np.zeros(len(x), int), np.ones(len(x))
        best, score = np.zeros(len(x), int), np.zeros(len(x))
        step = max(1, (4 << 20) // (k * k))
        off, upper = ~np.eye(k, dtype=bool), np.triu(np.ones((k, k), bool), 1)
        for at in range(0, len(x), step):
            m = self.margins(x[at : at + step])
            votes = ((m > 0) | (m == 0) & upper).sum(2)
            chance = (sigmoid(self.p.slope * m) * off).sum(2) / (k - 1)
            own = (votes + chance / 2).argmax(1)
            best[at : at + step], score[at : at + step] = own, chance[np.arange(len(own)), own]
        return best, score


def _solved(shared):
    """The machines of numbered jobs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        jobs = model.jobs()
        for batch in batches:
            for i in batch.column("id").to_pylist():
                f, a, b = jobs[i]
                own, bias = model.level(f).solve(a, b)
                data = pa.array([own.astype("<f4").tobytes()], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), data, pa.array([bias], pa.float64())], names=["id", "own", "bias"])

    return tidy(run)


class Model:
    """The family's machines and each family's own."""

    def __init__(self, x: np.ndarray, langs: list[str], p: Params):
        self.p = p
        family = [family_of(lang) for lang in langs]
        self.top = OneVersusOne(x, family, p) if langs else None
        self.within = {}
        for f in sorted(set(family)):
            own = [i for i, g in enumerate(family) if g == f]
            self.within[f] = OneVersusOne(x[own], [langs[i] for i in own], p)

    def level(self, family: str | None) -> OneVersusOne:
        return self.top if family is None else self.within[family]

    def jobs(self) -> list[tuple[str | None, int, int]]:
        """(family, or none for the families' own level, a, b) of every machine; the largest first."""
        levels = [None, *self.within] if self.top else []
        return [(f, a, b) for f in levels for a, b in self.level(f).pairs]

    def fit(self, spark) -> Model:
        """Every machine is a row of a job; few share a task."""
        if jobs := self.jobs():
            shared = spark.sparkContext.broadcast(self)
            tasks = min(len(jobs), 4 * spark.sparkContext.defaultParallelism)
            for r in spark.range(0, len(jobs), 1, tasks).mapInArrow(_solved(shared), "id long, own binary, bias double").toLocalIterator():
                f, a, b = jobs[r["id"]]
                self.level(f).take(a, b, np.frombuffer(bytes(r["own"]), "<f4"), r["bias"])
            shared.unpersist()
        for level in [self.top, *self.within.values()]:
            if level:
                level.ready()
        return self

    def predict(self, x: np.ndarray) -> list[tuple[str, float]]:
        """(language, score) of each row; the score is the family's times the language's in it."""
        if self.top is None:
            return [(UNKNOWN, 0.0)] * len(x)
        family, sure = self.top.predict(x)
        out: list[tuple[str, float]] = [(UNKNOWN, 0.0)] * len(x)
        for k in set(family.tolist()):
            own = np.flatnonzero(family == k)
            machines = self.within[self.top.classes[k]]
            best, chance = machines.predict(x[own])
            for i, b, c in zip(own.tolist(), best.tolist(), chance.tolist(), strict=True):
                out[i] = (machines.classes[b], float(sure[i] * c))
        return out


def _featurize(p: Params):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            texts = [t.decode("utf-8", "replace") for t in batch.column("text").to_pylist()]
            keep = [i for i, t in enumerate(texts) if _LETTER.search(t)]
            packed = [features(texts[i], p.bits).astype("<f2").tobytes() for i in keep]
            lang = batch.column("lang").take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([lang, pa.array(packed, pa.binary())], names=["lang", "x"])

    return run


def learn(labelled: DataFrame, p: Params = Params()) -> Model:  # noqa: B008
    """Fit on a bounded sample of `labelled` (text, lang): about `sample` rows, by a hash of both.

    Every language gives the same number of different texts, or all that it has: rows that repeat
    count once, so neither a repeated id nor a repeated text makes the sample larger.
    """
    rows = labelled.filter("lang is not null").select("lang", raw_text().alias("text"))
    key = F.xxhash64("lang", "text")
    sizes = rows.groupBy("lang").agg(F.approx_count_distinct(key).alias("n")).collect()
    if not sizes:
        return Model(np.zeros((0, 1)), [], p).fit(labelled.sparkSession)
    each = max(p.least, p.sample / len(sizes))
    shares = [(r["lang"], min(1.0, each / max(1, r["n"]))) for r in sizes]
    share = F.broadcast(labelled.sparkSession.createDataFrame(shares, "lang string, share double"))
    unit = F.pmod(key, F.lit(1 << 60)) / float(1 << 60)
    sample = rows.join(share, "lang").filter(unit < F.col("share")).groupBy(key.alias("key")).agg(F.first("lang").alias("lang"), F.first("text").alias("text"))
    found = sample.select("lang", "text").mapInArrow(_featurize(p), "lang string, x binary").collect()
    found.sort(key=lambda r: (r["lang"], r["x"]))
    x = np.array([np.frombuffer(r["x"], "<f2") for r in found], np.float16)
    return Model(x, [r["lang"] for r in found], p).fit(labelled.sparkSession)


def _predict(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in slices(batches, "text", 2 << 20):
            texts = [t.decode("utf-8", "replace") for t in batch.column("text").to_pylist()]
            found: list[tuple[str, float]] = [(UNKNOWN, 0.0)] * len(texts)
            keep = [i for i, t in enumerate(texts) if _LETTER.search(t)]
            for s in range(0, len(keep), 512):
                part = keep[s : s + 512]
                for i, r in zip(part, m.predict(np.array([features(texts[i], m.p.bits) for i in part])), strict=True):
                    found[i] = r
            columns = [batch.column("doc_id"), batch.column("held_out"), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "lang_pred", "score"])

    return run


def identify(docs: DataFrame, p: Params = Params()) -> DataFrame:  # noqa: B008
    """One row per document: doc_id, held_out, lang_pred, score.

    Learns from the rows that are not held out (crc32 of the id as text, mod 4, is 2) and have
    a lang; predicts from the text alone. Texts that are null or have no letter are `und` with
    score 0, and so is every text when there is nothing to learn from. Repeated rows each
    return; very long texts count whole; an empty table returns no rows; extra columns are not read.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", held_out(modulus=4).alias("held_out"), "text", F.col("lang").cast("string").alias("lang"))
    model = learn(rows.filter(~F.col("held_out")), p)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    texts = rows.select("doc_id", "held_out", raw_text().alias("text"))
    return texts.mapInArrow(_predict(shared), f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def op8(spark, sf_dir: str) -> DataFrame:
    """Contract query: one row per document with the predicted language."""
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet"))
