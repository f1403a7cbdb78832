"""Near-duplicate vectors: cross-polytope hashing after fast Hadamard rotations, with multiprobe.

Each table rotates the unit vector by sign flips and fast Walsh-Hadamard transforms, three
rounds a hash, and takes the closest signed axis; several hashes make a bucket. A vector also
enters its next-best buckets. Vectors that share a bucket of any table are candidates; every
candidate pair is verified by cosine in double precision, in blocks of matrix products, so
pairs never become rows. Inside a block a verified pair counts only in the first bucket that
it shares, which makes the sums over buckets exact; the links of a block leave it as one
count and one spanning edge a vector.

The number of hashes follows from the dimension and from a fixed number of vectors a label that it is made for
(`Params.rows`), never from the input, so whether a pair meets depends on its two vectors alone. Up to that number the
foreign vectors that a vector meets stay at a few hundred; beyond it they grow with the label's share. Each hash more
doubles the probes, and tables follow from the dimension, so recall stays.

Equal vectors collapse before hashing. Buckets over a bound are dealt into cells: members
fall into parts and each pair of parts is a task's work, so a bucket of any size is compared
whole and in bounded memory.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import OWN, materialize
from .components import components


@dataclass(frozen=True)
class Params:
    """At a cosine of 0.93 a pair shares a bucket with chance 0.995 or more (see the tests), at 0.95 nearly always."""

    threshold: float = 0.93
    tables: int = 0  # 0: by the dimension
    hashes: int = 0  # 0: by the dimension and `rows`
    probes: int = 0  # 0: two to the power of hashes
    rows: int = 1 << 17  # vectors of a label that the hashes are made for, whatever the input's size
    meets: int = 256  # foreign vectors that a vector may be expected to meet
    seed: int = 11
    part: int = 1024  # members of one part of a large bucket

    def of(self, dim: int) -> Params:
        """With tables, hashes and probes for vectors of a dimension."""
        width = 1 << max(0, dim - 1).bit_length()
        tables = self.tables or (4 if width <= 64 else 6 if width <= 512 else 8)
        axes, hashes = 2 * width, self.hashes or 2
        most = min(5, max(2, 58 // max(1, axes.bit_length() - 1)))  # a code has 58 bits, and probes double with each hash
        while not self.hashes and hashes < most and 2 * tables * 4**hashes * self.rows > self.meets * axes**hashes and axes > 4:
            hashes += 1
        return replace(self, tables=tables, hashes=hashes, probes=self.probes or 1 << hashes)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled first, so that no square over- or underflows."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of each row, orthonormal; the width is a power of two."""
    n, width = x.shape
    h = 1
    while h < width:
        y = x.reshape(n, width // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(n, width)
        h *= 2
    return x / np.sqrt(width)


def rotations(rows: np.ndarray, p: Params) -> np.ndarray:
    """(tables * hashes, n, width): pseudo-random rotations of the rows, padded to a power of two."""
    n, dim = rows.shape
    width = 1 << max(0, dim - 1).bit_length()
    signs = np.random.default_rng([p.seed, width]).choice([-1.0, 1.0], (p.tables * p.hashes, 3, width))
    out = np.zeros((p.tables * p.hashes, n, width))
    for k, flips in enumerate(signs):
        x = np.zeros((n, width))
        x[:, :dim] = rows
        for s in flips:
            x = hadamard(x * s)
        out[k] = x
    return out


def buckets(rows: np.ndarray, p: Params) -> np.ndarray:
    """(n, tables * probes) codes; those of a table are distinct, and tables don't share codes."""
    n, p = len(rows), p.of(rows.shape[1])
    turned = rotations(rows, p)
    width = turned.shape[2]
    axes = 2 * width
    deep = min(p.probes, axes)
    both = np.concatenate([turned, -turned], axis=2)  # a signed axis each
    best = np.argpartition(-both, deep - 1, axis=2)[:, :, :deep]
    gain = np.take_along_axis(both, best, axis=2)
    order = np.argsort(-gain, axis=2, kind="stable")
    best, gain = np.take_along_axis(best, order, axis=2), np.take_along_axis(gain, order, axis=2)
    loss = (gain[:, :, :1] - gain) ** 2  # the farther an axis is from the best, the less likely
    out = []
    for t in range(p.tables):
        code, cost = np.zeros((n, 1), np.int64), np.zeros((n, 1))
        for k in range(t * p.hashes, (t + 1) * p.hashes):
            code = (code[:, :, None] * axes + best[k][:, None, :]).reshape(n, -1)
            cost = (cost[:, :, None] + loss[k][:, None, :]).reshape(n, -1)
            pick = np.argsort(cost, axis=1, kind="stable")[:, : p.probes]  # the best go on from the best
            code, cost = np.take_along_axis(code, pick, axis=1), np.take_along_axis(cost, pick, axis=1)
        out.append(code * p.tables + t)
    return np.concatenate(out, axis=1)


def _entries(p: Params):
    """One row for each bucket of each vector; key: the bucket within label and dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels, rows = batch.column("label_key").to_numpy(), batch.column("embedding").to_pylist()
            sizes = np.array([len(r) for r in rows])
            for dim in np.unique(sizes):
                own = np.flatnonzero(sizes == dim)
                for start in range(0, len(own), 512):
                    at = own[start : start + 512]
                    codes = buckets(unit(np.array([rows[i] for i in at], np.float64)), p)
                    each = np.repeat(at, codes.shape[1])
                    take = pa.array(each)
                    columns = {"label_key": labels[each], "dim": np.full(len(each), dim, np.int32), "bucket": codes.ravel()}
                    yield pa.RecordBatch.from_pydict(columns | {c: batch.column(c).take(take) for c in ("rep", "vkey")})

    return run


def _owned(bucket: np.ndarray, one: np.ndarray, two: np.ndarray, tables: int) -> np.ndarray:
    """Whether `bucket` is the first that each pair of code rows shares: by table, then by code."""
    none = np.iinfo(np.int64).max
    width, shared = one.shape[1] // tables, np.full(len(one), none)
    for t in range(tables):
        left, right = one[:, t * width : (t + 1) * width], two[:, t * width : (t + 1) * width]
        hit = np.where((left[:, :, None] == right[:, None, :]).any(2), left, none).min(1)
        shared = np.where(shared == none, hit, shared)
    return shared == bucket


class _Cells:
    """Whole cells of one dimension, as arrays: x holds unit vectors, rows of a cell are together."""

    SMALL = 48  # cells up to this size are compared many at once

    def __init__(self, x: np.ndarray, rep: np.ndarray, mult: np.ndarray, name: np.ndarray, p: Params):
        self.x, self.rep, self.mult, self.name, self.p = x, rep, mult, name, p.of(x.shape[1])
        self.found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def _near(self, i: np.ndarray, j: np.ndarray, bucket: np.ndarray) -> None:
        """Keep the pairs of rows that no earlier bucket has. Codes aren't shipped but made again, for verified pairs only."""
        for s in range(0, len(i), 1 << 16):
            a, b, at = i[s : s + (1 << 16)], j[s : s + (1 << 16)], bucket[s : s + (1 << 16)]
            own, back = np.unique(np.concatenate([a, b]), return_inverse=True)
            codes = np.concatenate([buckets(self.x[own[k : k + 2048]], self.p) for k in range(0, len(own), 2048)])
            keep = np.concatenate([_owned(at[k : k + 4096], codes[back[k : min(k + 4096, len(a))]], codes[back[len(a) + k : len(a) + min(k + 4096, len(a))]], self.p.tables) for k in range(0, len(a), 4096)])
            keep &= self.name[a] == self.name[b]  # labels whose keys fall together
            self.found.append((a[keep], b[keep], at[keep]))

    def small(self, starts: np.ndarray, sizes: np.ndarray, bucket: np.ndarray) -> None:
        """Cells whose rows all pair, by size: one product for all pairs of many cells."""
        for size in np.unique(sizes):
            own = sizes == size
            first, at = starts[own], bucket[own]
            a, b = np.triu_indices(size, 1)
            step = max(1, (1 << 16) // len(a))
            for s in range(0, len(first), step):
                i = (first[s : s + step, None] + a).ravel()
                j = (first[s : s + step, None] + b).ravel()
                near = np.einsum("ij,ij->i", self.x[i], self.x[j]) >= self.p.threshold
                if near.any():
                    self._near(i[near], j[near], np.repeat(at[s : s + step], len(a))[near])

    def block(self, rows: np.ndarray, others: np.ndarray, bucket: int, same: bool) -> None:
        """All pairs of two lists of rows, or within one, in bounded products."""
        for s in range(0, len(rows), 1024):
            part = rows[s : s + 1024]
            near = self.x[part] @ self.x[others].T >= self.p.threshold
            i, j = np.nonzero(near)
            if same:
                later = i + s < j
                i, j = i[later], j[later]
            if len(i):
                self._near(part[i], others[j], np.full(len(i), bucket))

    def flush(self) -> pa.RecordBatch | None:
        """By member: copies linked, and the smallest member in reach over these pairs."""
        if not self.found:
            return None
        i, j = (np.concatenate([f[k] for f in self.found]) for k in (0, 1))
        if not len(i):
            return None
        ids, back = np.unique(np.concatenate([self.rep[i], self.rep[j]]), return_inverse=True)
        n = np.bincount(back, np.concatenate([self.mult[j], self.mult[i]])).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(n), pa.array(_roots(ids, back[: len(i)], back[len(i) :]))], names=["rep", "n", "root"])


def _roots(ids: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest id that each can reach over the pairs (a, b) of positions."""
    up = np.arange(len(ids))
    while True:
        low = up.copy()
        np.minimum.at(low, a, up[b])
        np.minimum.at(low, b, up[a])
        low = low[low]
        if (low == up).all():
            return ids[up]
        up = low


_CELL = ["label_key", "dim", "bucket", "low", "high"]


def _compare(rows: pa.Table, p: Params) -> Iterator[pa.RecordBatch]:
    """rows: whole cells, sorted."""
    key = [rows.column(c).to_numpy() for c in _CELL]
    new = np.concatenate([[True], np.any([k[1:] != k[:-1] for k in key], axis=0)])
    starts = np.flatnonzero(new)
    sizes = np.diff(np.append(starts, len(new)))
    use = sizes > 1
    starts, sizes = starts[use], sizes[use]
    dim, bucket, low, high = (k[starts] for k in key[1:])
    side, rep, mult = (rows.column(c).to_numpy() for c in ("side", "rep", "mult"))
    name = rows.column("name").to_numpy()
    vectors = rows.column("vector").combine_chunks()
    for d in np.unique(dim):
        own = dim == d
        member = np.concatenate([np.arange(s, s + n) for s, n in zip(starts[own].tolist(), sizes[own].tolist(), strict=True)])
        place = np.zeros(len(new), np.int64)
        place[member] = np.arange(len(member))
        x = vectors.take(pa.array(member)).flatten().to_numpy().reshape(len(member), -1).astype(np.float64)
        cells = _Cells(unit(x), rep[member], mult[member], name[member], p)
        plain = own & (low == high) & (sizes <= _Cells.SMALL)
        cells.small(place[starts[plain]], sizes[plain], bucket[plain])
        for c in np.flatnonzero(own & ~plain).tolist():
            at = np.arange(starts[c], starts[c] + sizes[c])
            a, b = at[side[at] == low[c]], at[side[at] == high[c]]
            cells.block(place[a], place[b], int(bucket[c]), bool(low[c] == high[c]))
        if out := cells.flush():
            yield out


def _verify(p: Params):
    """Rows come sorted by cell; cells are compared when their last row has come."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            last = [batch.column(c)[batch.num_rows - 1].as_py() for c in _CELL]
            open_ = np.all([batch.column(c).to_numpy() == v for c, v in zip(_CELL, last, strict=True)], axis=0)
            cut = int(np.argmax(open_))  # where the last cell begins, which may go on
            if held and [held[-1].column(c)[held[-1].num_rows - 1].as_py() for c in _CELL] == last:
                held.append(batch)
                continue
            yield from _compare(pa.Table.from_batches([*held, batch.slice(0, cut)]), p) if held or cut else ()
            held = [batch.slice(cut)]
        if held:
            yield from _compare(pa.Table.from_batches(held), p)

    return run


def meetings(distinct: DataFrame, p: Params) -> DataFrame:
    """The rows that cells compare, with their vectors: label_key, dim, bucket, low, high, side, rep, mult, name, vector.

    Each vector is hashed once. Entries that are alone in their bucket go while they are a few numbers, and
    the vectors are joined to what is left. A large bucket is dealt into parts, and a cell compares two of them.
    """
    key = ["label_key", "dim", "bucket"]
    entries = materialize(distinct.select("label_key", "embedding", "rep", "vkey").mapInArrow(_entries(p), "label_key long, dim int, bucket long, rep long, vkey long"))
    parts = F.when(F.col("size") > 2 * p.part, F.ceil(F.col("size") / p.part).cast("int")).otherwise(1)
    sizes = entries.groupBy(key).agg(F.count("*").alias("size")).filter("size > 1").select(*key, parts.alias("parts"))
    dealt = (
        entries.join(sizes, key)
        .withColumn("side", F.pmod(F.xxhash64("rep", "vkey"), "parts").cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select(*key, F.least("side", "other").alias("low"), F.greatest("side", "other").alias("high"), "side", "rep", "vkey")
    )
    return dealt.join(distinct.select("rep", "vkey", "mult", "name", "vector"), ["rep", "vkey"]).drop("vkey")


def near_duplicates(vectors: DataFrame, p: Params = Params()) -> DataFrame:  # noqa: B008
    """One row per input row: vec_id, n_links, component_id (smallest vec_id in reach), kept.

    Rows link if their labels are equal and not null and their cosine reaches the threshold;
    n_links counts all linked rows, copies of the row included. Vectors that are null, zero
    or have null or non-finite components, and rows with a null id, link with nothing and are
    kept. Vectors of different lengths don't link. Rows that repeat an id count as rows of
    their own; they link by their vectors, and all that have the smallest id are kept.
    An empty table returns no rows. Extra columns are not read.
    """
    finite = F.coalesce(
        F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0), F.lit(False)
    )
    rows = vectors.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("embedding"))
    valid = finite & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    number = vectors.schema["label"].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint")
    label_key = F.col("label").cast("long") if number else F.xxhash64("label")
    rows = rows.select("vec_id", valid.alias("valid"), label_key.alias("label_key"), "label", "embedding")
    # sent as they were given: floats stay floats
    stored = "array<float>" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "array<double>"
    good = rows.filter("valid")
    distinct = materialize(good.groupBy("label_key", "label", "embedding").agg(F.min("vec_id").cast("long").alias("rep"), F.count("*").alias("mult")))
    # Integer labels are their own key; others come along, since a key is a hash.
    name = (F.lit(None) if number else F.col("label")).cast("string")
    least = distinct.select("rep", "mult", "label_key", "embedding", F.coalesce(name, F.lit("")).alias("name"), F.xxhash64("label", "embedding").alias("vkey"), F.col("embedding").cast(stored).alias("vector"))
    ordered = meetings(least, p).repartition(*_CELL).sortWithinPartitions(*_CELL)
    found = materialize(ordered.mapInArrow(_verify(p), "rep long, n long, root long"))
    counts = found.groupBy("rep").agg(F.sum("n").alias("linked"))
    groups = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    label = (
        distinct.join(counts, "rep", "left")
        .join(groups, F.col("rep") == F.col("node"), "left")
        .select("label", "embedding", (F.coalesce("linked", F.lit(0)) + F.col("mult") - 1).alias("links"), F.coalesce("component", "rep").alias("component"))
    )
    label = label.select(*(F.col(c).alias(f"{OWN}{c}") for c in label.columns))
    same = rows["valid"] & (rows["label"] == label[f"{OWN}label"]) & (rows["embedding"] == label[f"{OWN}embedding"])
    # The key of a join must not gather the rows that can't link, so they take their own way.
    linked = good.join(label, same).select("vec_id", F.col(f"{OWN}links").alias("n_links"), F.col(f"{OWN}component").alias("component_id"))
    alone = rows.filter("not valid").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").cast("long").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op1(spark, sf_dir: str) -> DataFrame:
    """Contract query: vec_id, n_links, component_id, kept."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
