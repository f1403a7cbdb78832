"""Toxicity by a classifier chain: categories are predicted in order, each from the text and the
chances of the categories before it.

Terms are words and word beginnings. Their document counts by category over the labelled sample
choose a fixed number of terms; each gives two features, that it occurs and how often. Each
link of the chain is a logistic regression. A later link sees, when it is fitted, what the
earlier ones say of rows they were not fitted on (out-of-fold), as it will when it predicts;
each fold chooses its terms without its own rows too. The folds of a link are fitted as tasks.

The labelled sample is written once, so documents are read twice: for the sample, to predict.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import OWN, discard, materialize, raw_text, slices, text_runs, tidy
from .linear import Sparse, fit, sigmoid

#: Words of letters and digits; a zero byte stands between texts.
_WORD = re.compile(r"[^\W_]+")
_WORD_OR_END = re.compile(r"[^\W_]+|\0")


@dataclass(frozen=True)
class Params:
    categories: tuple[str, ...] = ("quality", "toxic")  # 0/1 columns of the labels, in the chain's order
    decides: str = "toxic"
    sample: int = 10_000  # labelled rows the chain is fitted on
    terms: int = 400  # that speak for a category, each
    against: int = 100  # that speak against it
    least_docs: int = 3  # a term has to be in so many sample rows
    starts: tuple[int, ...] = (4, 5, 6, 7)  # lengths of word beginnings
    folds: int = 4
    ridge: float = 1e-5
    steps: int = 300
    remembered: int = 60_000  # words whose terms a worker remembers


def terms_of(word: str, starts: tuple[int, ...]) -> list[str]:
    return [word, *(word[:k] + "*" for k in starts if len(word) > k)]


def tokens(text: bytes) -> Iterator[str]:
    """Words of letters and digits, in lower case; a huge text never becomes one list."""
    for part in text_runs(text):
        yield from _WORD.findall(part.decode("utf-8", "replace").lower())


class Terms:
    """Counts terms in texts. Words are looked up by number, the different ones of many texts at once."""

    def __init__(self, terms: list[str], p: Params):
        self.at, self.p = {t: i for i, t in enumerate(terms)}, p
        self.known: dict[str, tuple[int, ...]] = {}

    def _of(self, word: str) -> tuple[int, ...]:
        found = self.known[word] = tuple(self.at[t] for t in terms_of(word, self.p.starts) if t in self.at)
        return found

    def _part(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Words of each text; and (text, term, times)."""
        # A zero byte in a text is no word; it must not pass for an end.
        joined = "\0".join([t.decode("utf-8", "replace").lower().replace("\0", " ") for t in texts])
        coded = pa.array(_WORD_OR_END.findall(joined), pa.string()).dictionary_encode()
        words, at = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        known = self.known
        found = [() if w == "\0" else known.get(w) or (known[w] if w in known else self._of(w)) for w in words]
        if len(known) > self.p.remembered:
            known.clear()
        end = words.index("\0") if "\0" in words else -1
        text = np.cumsum(at == end)
        n = np.bincount(text[at != end], minlength=len(texts))
        size = np.array([len(x) for x in found], np.int64)
        starts, flat = np.cumsum(size) - size, np.array([t for x in found for t in x], np.int64)
        own = np.flatnonzero(size[at] > 0) if len(at) else at
        at, text = at[own], text[own]
        each = size[at]
        term = flat[np.arange(each.sum()) + np.repeat(starts[at] - (np.cumsum(each) - each), each)]
        key, times = np.unique(np.repeat(text, each) * len(self.at) + term, return_counts=True)
        return n, key // max(1, len(self.at)), key % max(1, len(self.at)), times

    def count(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Words of each whole text; and (text, term, times), by text, then term. Texts go in runs of bounded size."""
        total, found = np.zeros(len(texts), np.int64), []
        which: list[int] = []
        parts: list[bytes] = []
        held = 0

        def flush() -> None:
            nonlocal held
            if parts:
                n, text, term, times = self._part(parts)
                own = np.array(which)
                np.add.at(total, own, n)
                found.append((own[text], term, times))
                which.clear()
                parts.clear()
                held = 0

        for i, text in enumerate(texts):
            for part in text_runs(text):
                which.append(i)
                parts.append(part)
                held += len(part)
                if held > 1 << 20:
                    flush()
        flush()
        text, term, times = (np.concatenate([*(f[k] for f in found), np.zeros(0, np.int64)]) for k in range(3))
        key, back = np.unique(text * max(1, len(self.at)) + term, return_inverse=True)
        return total, key // max(1, len(self.at)), key % max(1, len(self.at)), np.bincount(back, times, len(key)).astype(np.int64)


def rows_of(words: np.ndarray, text: np.ndarray, term: np.ndarray, times: np.ndarray, n_terms: int) -> Sparse:
    """Features: whether a term occurs, and its share of the words on a log scale."""
    out = Sparse([], [], 2 * n_terms, np.zeros((len(words), 0)))
    share = np.log1p(1000.0 * times / np.maximum(1, words[text])) / 4
    text, term = text.astype(np.int32), term.astype(np.int32)
    out.rows, out.columns = np.concatenate([text, text]), np.concatenate([term, n_terms + term])
    out.values, out.n = np.concatenate([np.ones(len(text), np.float32), share.astype(np.float32)]), len(words)
    return out


@dataclass
class Sample:
    """The labelled rows as counts of terms; features are made of them where they are needed."""

    words: np.ndarray
    text: np.ndarray  # row, term and times of each term in a row
    term: np.ndarray
    times: np.ndarray
    fold: np.ndarray
    allowed: list[np.ndarray]  # by fold, and last for all rows, the terms it may use
    dense: np.ndarray  # out-of-fold chances of the links before

    @property
    def width(self) -> int:
        return 2 * len(self.allowed[-1]) + self.dense.shape[1]

    def features(self, rows: np.ndarray, terms: np.ndarray) -> Sparse:
        """Of the rows where `rows` is true, with the terms where `terms` is."""
        keep, place = rows[self.text] & terms[self.term], np.cumsum(rows) - 1
        out = rows_of(self.words[rows], place[self.text[keep]], self.term[keep], self.times[keep], len(terms))
        out.dense = self.dense[rows]
        return out


def _fits(shared, p: Params):
    """One row a fold in: the weights fitted without the fold (of the last number: with all rows)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sample, sign = shared.value
        for batch in batches:
            for f in batch.column("id").to_pylist():
                own = sample.fold != f
                w = fit(sample.features(own, sample.allowed[f]), sign[own], "logistic", p.ridge, p.steps) if own.any() else np.zeros(sample.width + 1)
                yield pa.RecordBatch.from_arrays([pa.array([f], pa.int64()), pa.array([w.tobytes()], pa.binary())], names=["fold", "w"])

    return run


class Chain:
    """The fitted links, in order."""

    def __init__(self, terms: list[str], weights: list[np.ndarray], p: Params):
        self.terms, self.weights, self.p = terms, weights, p
        self.cuts: list[float] = []

    @classmethod
    def fit(cls, spark, terms: list[str], sample: Sample, y: np.ndarray, p: Params) -> Chain:
        """y: 0/1 by row and category."""
        weights, cuts = [], []
        for c in range(y.shape[1]):
            sign = np.where(y[:, c] > 0, 1.0, -1.0)
            shared = spark.sparkContext.broadcast((sample, sign))
            fitted = spark.range(0, p.folds + 1, 1, p.folds + 1).mapInArrow(tidy(_fits(shared, p)), "fold long, w binary").collect()
            shared.unpersist()
            by = {r.fold: np.frombuffer(bytes(r.w)) for r in fitted}
            weights.append(by[p.folds])
            apart = np.zeros(len(sign))
            for f in range(p.folds):
                own = sample.fold == f
                apart[own] = sigmoid(sample.features(own, sample.allowed[f]) @ by[f][:-1] + by[f][-1])
            cuts.append(best_cut(apart, sign > 0))
            sample = replace(sample, dense=np.hstack([sample.dense, apart[:, None]]))
        out = cls(terms, weights, p)
        out.out_of_fold, out.cuts = sample.dense, cuts
        return out

    def trimmed(self, n: int) -> Chain:
        """Without the terms from the n-th on, which only folds used."""
        m = len(self.terms)
        self.weights = [np.concatenate([w[:n], w[m : m + n], w[2 * m :]]) for w in self.weights]
        self.terms = self.terms[:n]
        return self

    def cut(self, category: str) -> float:
        """The chance from which a row is in the category: near the best F1 on the out-of-fold chances."""
        at = self.p.categories.index(category)
        return self.cuts[at] if self.cuts else 2.0

    def predict(self, x: Sparse) -> np.ndarray:
        """Chances by row and category, along the chain; 0 where nothing was learned."""
        if not self.weights:
            return np.zeros((x.n, len(self.p.categories)))
        for w in self.weights:
            x = x.beside(sigmoid(x @ w[:-1] + w[-1]))
        return x.dense


def best_cut(chance: np.ndarray, true: np.ndarray) -> float:
    """Of the cuts 0.2, 0.25, ... 0.8 whose F1 is within 0.005 of the best, the lowest."""
    cuts = [c / 100 for c in range(20, 81, 5)]
    f1 = [2 * ((chance >= c) & true).sum() / max(1, (chance >= c).sum() + true.sum()) for c in cuts]
    return next(c for c, f in zip(cuts, f1, strict=True) if f >= max(f1) - 0.005)


def _term_counts(p: Params):
    """(term, then by fold the rows that have it and those of each category)."""
    k = len(p.categories) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[int]] = {}

        def out() -> pa.RecordBatch:
            columns = [pa.array(list(held), pa.string()), *(pa.array([v[c] for v in held.values()], pa.int64()) for c in range(k * p.folds))]
            return pa.RecordBatch.from_arrays(columns, names=["term", *(f"n{f}_{c}" for f in range(p.folds) for c in range(k))])

        for batch in slices(batches, "text"):
            labels = [batch.column(f"y{c}").to_pylist() for c in range(k - 1)]
            for i, (text, f) in enumerate(zip(batch.column("text").to_pylist(), batch.column("fold").to_pylist(), strict=True)):
                own = [k * f, *(k * f + 1 + c for c in range(k - 1) if labels[c][i])]
                for t in {t for w in set(tokens(text)) for t in terms_of(w, p.starts)}:
                    if (v := held.get(t)) is None:
                        v = held[t] = [0] * (k * p.folds)
                    for c in own:
                        v[c] += 1
                if len(held) > 100_000:
                    yield out()
                    held.clear()
        if held:
            yield out()

    return run


def _sample_rows(shared, p: Params):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = Terms(shared.value, p)
        for batch in slices(batches, "text"):
            words, text, term, times = terms.count(batch.column("text").to_pylist())
            cuts = np.searchsorted(text, np.arange(len(words) + 1))
            lists = [pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(x, pa.int32())) for x in (term, times)]
            columns = {c: batch.column(c) for c in batch.schema.names if c != "text"}
            yield pa.RecordBatch.from_pydict(columns | {"words": pa.array(words), "at": lists[0], "times": lists[1]})

    return run


def _unit(*columns: str | Column) -> Column:
    """A number from 0 to 1 by the hash."""
    return F.pmod(F.xxhash64(*columns), F.lit(1 << 20)) / float(1 << 20)


def labelled_sample(docs: DataFrame, labels: DataFrame, p: Params) -> DataFrame:
    """At most about `sample` rows (key, text, y0, y1, ..., fold) of labelled documents, written once.

    Labels of one id count together, as 1 if any says so; rows alike in id and text count once.
    """
    cats = [F.max(F.col(c).cast("int")).alias(f"y{i}") for i, c in enumerate(p.categories)]
    usable = labels.select("doc_id", *p.categories).dropna().groupBy("doc_id").agg(*cats)
    share = min(1.0, p.sample / max(usable.count(), 1))
    # Distinct ids: bounded by p.sample, whatever the tables, so the text side doesn't move.
    chosen = F.broadcast(usable.filter(_unit("doc_id", F.lit("sample")) < share))
    rows = docs.select("doc_id", raw_text().alias("text")).join(chosen, "doc_id").withColumn("key", F.xxhash64("doc_id", "text"))
    ys = [F.first(f"y{c}").alias(f"y{c}") for c in range(len(p.categories))]
    rows = materialize(rows.groupBy("key").agg(F.first("text").alias("text"), *ys))
    share = min(1.0, p.sample / max(rows.count(), 1))  # an id may be that of many documents
    return rows.filter(_unit("key", F.lit("row")) < share).withColumn("fold", F.pmod(F.xxhash64("key", F.lit("fold")), F.lit(p.folds)).cast("int"))


def choose_terms(counts: DataFrame, totals: np.ndarray, p: Params) -> list[list[str]]:
    """By fold, without its rows, and last of all rows: the terms that speak most for or against a category.

    totals: rows by fold, of which by category.
    """
    out = []
    for f in range(p.folds + 1):
        others = [g for g in range(p.folds) if g != f]
        total, terms = totals[others].sum(0), {}
        n = sum((F.col(f"n{g}_0") for g in others), F.lit(0))
        for c in range(1, totals.shape[1]):
            if not 0 < total[c] < total[0]:
                continue
            rate = float(total[c] / total[0])
            z = (sum((F.col(f"n{g}_{c}") for g in others), F.lit(0)) - n * rate) / F.sqrt(n * rate * (1 - rate))
            own = counts.filter(n >= p.least_docs).select("term", z.alias("z"))
            for order, most in ((F.desc("z"), p.terms), (F.asc("z"), p.against)):
                terms |= dict.fromkeys(r.term for r in own.orderBy(order, "term").limit(most).collect()) if most else {}
        out.append(sorted(terms))
    return out


def learn(docs: DataFrame, labels: DataFrame, p: Params = Params()) -> Chain:  # noqa: B008
    """Fit the chain on :func:`labelled_sample`.

    Labels with a null id or category are not used. Without any usable row nothing is learned.
    """
    spark, rows = docs.sparkSession, labelled_sample(docs, labels, p)
    k = range(len(p.categories))
    names = [f"n{f}_{c}" for f in range(p.folds) for c in range(len(k) + 1)]
    sums = "".join(f", {c} long" for c in names)
    counts = rows.mapInArrow(tidy(_term_counts(p)), f"term string{sums}").groupBy("term").agg(*(F.sum(c).alias(c) for c in names))
    counts = materialize(counts.filter(sum((F.col(f"n{f}_0") for f in range(p.folds)), F.lit(0)) >= p.least_docs))
    totals = np.zeros((p.folds, len(k) + 1), np.int64)
    for r in rows.groupBy("fold").agg(F.count("*").alias("n"), *(F.sum(f"y{c}").alias(f"y{c}") for c in k)).collect():
        totals[r.fold] = [r.n, *(r[f"y{c}"] for c in k)]
    chosen = choose_terms(counts, totals, p)
    discard(counts)
    if not chosen[-1]:
        return Chain([], [], p)
    own = [*chosen[-1], *sorted({t for terms in chosen for t in terms} - set(chosen[-1]))]
    shared = spark.sparkContext.broadcast(own)
    kinds = "".join(f", y{c} int" for c in k)
    found = rows.mapInArrow(tidy(_sample_rows(shared, p)), f"key long{kinds}, fold int, words long, at array<int>, times array<int>").toArrow().sort_by("key")
    at = found.column("at").combine_chunks()
    sizes = np.diff(at.offsets.to_numpy())
    lists = {c: found.column(c).combine_chunks().flatten().to_numpy().astype(np.int32) for c in ("at", "times")}
    column = lambda c: found.column(c).to_numpy()
    dense = np.zeros((found.num_rows, 0))
    sample = Sample(column("words"), np.repeat(np.arange(found.num_rows, dtype=np.int32), sizes), lists["at"], lists["times"], column("fold"), [np.isin(own, terms) for terms in chosen], dense)
    chain = Chain.fit(spark, own, sample, np.stack([column(f"y{c}") for c in k], axis=1), p)
    return chain.trimmed(len(chosen[-1]))


def _predict(shared, column: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain: Chain = shared.value
        terms = Terms(chain.terms, chain.p)
        names = [f"{OWN}{c}" for c in chain.p.categories]
        for batch in slices(batches, column, 2 << 20):
            texts = pc.fill_null(batch.column(column).cast(pa.binary()), b"")
            chances = chain.predict(rows_of(*terms.count(texts.to_pylist()), len(chain.terms)))
            columns = {c: batch.column(c) for c in batch.schema.names if c != f"{OWN}text"}
            columns |= {c: pa.array(chances[:, i]) for i, c in enumerate(names)}
            yield pa.RecordBatch.from_pydict(columns)

    return run


def predict(docs: DataFrame, chain: Chain) -> DataFrame:
    """All rows and columns, and ``__cc_<category>``: the chance of each category.

    Null and empty texts have no term, so they get what the chain says of no evidence.
    Very long texts are read whole, in runs. Repeated rows each return; an empty table returns no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(chain)
    plain = docs.schema["text"].dataType.simpleString() == "string"  # then the text goes to Python once
    rows = docs if plain else docs.withColumn(f"{OWN}text", raw_text())
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return rows.mapInArrow(tidy(_predict(shared, "text" if plain else f"{OWN}text")), kinds + "".join(f", {OWN}{c} double" for c in chain.p.categories))


def keep_clean(docs: DataFrame, labels: DataFrame, p: Params = Params()) -> DataFrame:  # noqa: B008
    """The documents, with all their columns, that the deciding category doesn't reject.

    Null and empty texts have no term: they stay unless the chain rejects what has no evidence. Each of
    rows alike gets the same decision. Very long texts are read whole, in runs. Without usable labels
    everything stays; an empty table returns no rows. Extra columns stay, whatever their names.
    """
    chain = learn(docs, labels, p)
    return predict(docs, chain).filter(F.col(f"{OWN}{p.decides}") < chain.cut(p.decides)).select(*docs.columns)


def op10(spark, sf_dir: str) -> DataFrame:
    """One row per document: doc_id, p_quality, p_toxic, toxic (the chain rejects it)."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    p = Params()
    chain = learn(docs, labels, p)
    found = predict(docs.select("doc_id", "text"), chain)
    return found.select(
        "doc_id", *(F.col(f"{OWN}{c}").alias(f"p_{c}") for c in p.categories), (F.col(f"{OWN}{p.decides}") >= chain.cut(p.decides)).alias("toxic")
    )
