"""Whitening of vectors by LOBPCG (Knyazev, 2001): the largest eigenpairs of the covariance, block by block.

The covariance is never formed. Each iteration is one pass over the rows, in which every task multiplies its centred rows
with a block of directions and back, C'(C B), and the tasks' products are added up by dimension. The block is the iterate and its
residuals; together with the previous directions, whose products follow from earlier ones, they span the space of a Rayleigh-Ritz step. The iterate's product is computed anew in every pass, so the residuals that
end the iteration are those of the data, not of carried sums. Only when each wanted pair's residual is
below a bound relative to the largest eigenvalue are the rows whitened.

Entries are fixed-point numbers (:func:`fixed`), so sums, means and deviations are exact integers in whatever order rows come.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import OWN, tidy

#: Entries are kept between these, so that sums of a batch are exact.
BOUND = 1 << 40


@dataclass(frozen=True)
class Params:
    """`components`: how many are wanted; `guard`: more columns in the block, which speed up the last ones;
    `residual`: ends the iteration, relative to the largest eigenvalue; `accept`: what may pass where rounding stops it earlier;
    `passes`: at most so many."""

    components: int = 8
    guard: int = 8
    residual: float = 1e-13
    accept: float = 1e-10
    passes: int = 500
    scale: int = 1024
    shift: int = 100_000


@dataclass
class Whitening:
    """What was fitted on the n vectors of one length: columns of `basis` are components by falling eigenvalue."""

    n: int
    sums: list[int]
    trace: float = 0.0
    values: np.ndarray = field(default_factory=lambda: np.zeros(0))
    basis: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    residuals: np.ndarray = field(default_factory=lambda: np.zeros(0))
    passes: int = 0
    identity_error: float | None = None

    @property
    def explained(self) -> np.ndarray:
        return self.values / self.trace if self.trace else self.values


def usable(batch: pa.RecordBatch) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Of a batch's vectors: which are usable (not null, no null or non-finite entry, not empty), the lengths, the flat entries."""
    v = batch.column("v").cast(pa.list_(pa.float64()))
    lengths = v.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = v.flatten()
    values = flat.to_numpy(zero_copy_only=False)  # null entries become nan
    owner = np.repeat(np.arange(len(lengths)), lengths)
    bad = np.bincount(owner[~np.isfinite(values)], minlength=len(lengths)) > 0
    return (lengths > 0) & ~bad, lengths, values


def fixed(values: np.ndarray, p: Params) -> np.ndarray:
    """floor(scale * entry) + shift, as int64; beyond ±2^40 held there."""
    return np.floor(np.clip(values * p.scale, -BOUND, BOUND)).astype(np.int64) + p.shift


def _matrices(batches: Iterator[pa.RecordBatch], p: Params) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, x) for the usable vectors of each length in each batch."""
    for batch in batches:
        ok, lengths, values = usable(batch)
        starts = np.cumsum(lengths) - lengths
        for d in np.unique(lengths[ok]):
            rows = np.flatnonzero(ok & (lengths == d))
            yield rows, fixed(values[starts[rows][:, None] + np.arange(d)], p)


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S, exact: int64 where that holds, Python's integers otherwise."""
    most = max(int(np.abs(x).max(initial=0)), *(abs(s) // n + 1 for s in sums)) * n
    if most < 1 << 62:
        return x * n - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, object)


def _sums(p: Params):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, list] = {}
        for _, x in _matrices(batches, p):
            own = total.setdefault(x.shape[1], [0, [0] * x.shape[1]])
            own[0] += len(x)
            own[1] = [a + b for a, b in zip(own[1], x.sum(axis=0).tolist(), strict=True)]
        rows = [(d, i, n, str(s)) for d, (n, sums) in total.items() for i, s in enumerate(sums)]
        kinds = (("d", pa.int32()), ("i", pa.int32()), ("n", pa.int64()), ("s", pa.string()))
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, (_, t) in enumerate(kinds)], names=[n for n, _ in kinds])

    return tidy(run)


def moments(vectors: DataFrame, p: Params) -> dict[int, Whitening]:
    """The number and the exact sums of the vectors of each length."""
    rows = vectors.mapInArrow(_sums(p), "d int, i int, n long, s string")
    out: dict[int, Whitening] = {}
    for r in rows.groupBy("d", "i").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).orderBy("d", "i").collect():
        out.setdefault(r.d, Whitening(r.n, [])).sums.append(int(r.s))
    return out


def _product(n: int, sums: list[int], block: np.ndarray, p: Params):
    """C'(C B) of a task's rows, and their squares, one row a dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d, m = block.shape
        total, squares = np.zeros((d, m)), np.zeros(d)
        for _, x in _matrices(batches, p):
            if x.shape[1] == d:
                for part in np.array_split(x, -(-len(x) // 4096)):
                    c = centred(part, n, sums).astype(np.float64) / n
                    total += c.T @ (c @ block)
                    squares += np.einsum("ij,ij->j", c, c)
        columns = [pa.array(np.arange(d), pa.int32()), *(pa.array(total[:, j]) for j in range(m)), pa.array(squares)]
        yield pa.RecordBatch.from_arrays(columns, names=["i", *(f"b{j}" for j in range(m)), "sq"])

    return tidy(run)


def multiplier(vectors: DataFrame, fit: Whitening, p: Params) -> Callable[[np.ndarray], np.ndarray]:
    """V B over all rows. A task sends a row a dimension, and so does the sum over tasks."""

    def product(block: np.ndarray) -> np.ndarray:
        names = [*(f"b{j}" for j in range(block.shape[1])), "sq"]
        parts = vectors.mapInArrow(_product(fit.n, fit.sums, block, p), "i int, " + ", ".join(f"{c} double" for c in names))
        rows = parts.groupBy("i").agg(*(F.sum(c).alias(c) for c in names)).collect()
        out = np.array([r[1:] for r in sorted(rows)]) / fit.n
        fit.trace = float(out[:, -1].sum())
        return out[:, :-1]

    return product


def _orthonormal(block: np.ndarray, *against: np.ndarray) -> np.ndarray:
    """An orthonormal basis of what `block` adds to the orthonormal `against`; directions lost to rounding go."""
    norms = np.linalg.norm(block, axis=0)
    out = block[:, norms > 0] / norms[norms > 0]
    for _ in range(2):
        for a in against:
            out = out - a @ (a.T @ out)
        u, s, _ = np.linalg.svd(out, full_matrices=False)
        out = u[:, s > 1e-10 * max(1.0, s.max(initial=0))]
    return out


def lobpcg(product: Callable[[np.ndarray], np.ndarray], d: int, p: Params) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(values, vectors, residual norms, passes) of the largest `components` eigenpairs of the d x d operator `product`.

    Raises if the residuals don't come below `accept`; eigenvalues that are equal have any basis of their space.
    """
    k, m = min(p.components, d), min(p.components + p.guard, d)
    x = np.linalg.qr(np.random.default_rng(11).standard_normal((d, m)))[0]
    w = old = old_v = np.zeros((d, 0))
    best, stale = np.inf, 0
    for passes in range(1, p.passes + 1):
        fresh = product(np.hstack([x, w]))
        basis, image = np.hstack([x, w, old]), np.hstack([fresh, old_v])
        h = basis.T @ image
        values, c = np.linalg.eigh((h + h.T) / 2)
        c = c[:, np.argsort(-values)[:m]]
        new, new_v = basis @ c, image @ c
        # the directions of this step: what the new iterate takes from outside the old one, with the product that follows
        step, step_v = basis[:, m:] @ c[m:], image[:, m:] @ c[m:]
        theta = np.einsum("ij,ij->j", x, fresh[:, :m])
        top = np.argsort(-theta)[:k]
        residuals = np.linalg.norm(fresh[:, top] - x[:, top] * theta[top], axis=0)  # of the iterate that was multiplied just now
        scale = max(float(theta.max(initial=0)), np.finfo(float).tiny)
        worst = float(residuals.max(initial=0)) / scale
        stale = 0 if worst < best / 2 else stale + 1
        best = min(best, worst)
        if passes > 1 and (worst <= p.residual or (stale >= 5 and worst <= p.accept)):
            return theta[top], x[:, top], residuals, passes
        x, tri = np.linalg.qr(new)
        inverse = np.linalg.inv(tri)
        x_v = new_v @ inverse
        # previous directions, orthonormal to the iterate, their products by the same combinations
        part = step - x @ (x.T @ step)
        part_v = step_v - x_v @ (x.T @ step)
        if part.shape[1]:
            u, s, vt = np.linalg.svd(part, full_matrices=False)
            good = s > 1e-8 * max(1.0, s.max(initial=0))
            old, old_v = u[:, good], part_v @ vt[good].T / s[good]
        else:
            old, old_v = part, part_v
        r = x_v - x * np.einsum("ij,ij->j", x, x_v)
        w = _orthonormal(r, x, old) if np.linalg.norm(r) > 0 else np.zeros((d, 0))
    raise RuntimeError(f"residuals of {best:.3g} of the largest eigenvalue after {p.passes} passes")


def _spread(fit: Whitening, p: Params):
    """Sums and products of a task's whitened rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d, k = fit.basis.shape
        total = np.zeros((k + 1, k))
        for _, x in _matrices(batches, p):
            if x.shape[1] == d:
                y = whitened(centred(x, fit.n, fit.sums), fit)
                total += np.vstack([y.T @ y, y.sum(axis=0)])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k + 1), pa.int32()), *(pa.array(total[:, j]) for j in range(k))], names=["i", *(f"b{j}" for j in range(k))])

    return tidy(run)


def whitened(c: np.ndarray, fit: Whitening) -> np.ndarray:
    """Rows n * x - S projected on the components, in units of their standard deviations."""
    return (c.astype(np.float64) / fit.n) @ fit.basis / np.sqrt(fit.values)


def fit(vectors: DataFrame, p: Params | None = None) -> dict[int, Whitening]:
    """By length of vector: what whitens the column `v`, fitted on all usable vectors.

    The table is read once a pass, so it should be a written one. Components without variance (fewer vectors than components, constant
    entries) are left out. No usable vectors: an empty dictionary. The driver holds a few blocks of length x (components + guard).
    """
    p = p or Params()
    out = moments(vectors, p)
    for d, own in out.items():
        product = multiplier(vectors, own, p)
        values, basis, residuals, own.passes = lobpcg(product, d, p)
        rank = (values > 1e-9 * max(values.max(initial=0), 0)) & (values > 0)
        own.values, own.basis, own.residuals = values[rank], basis[:, rank], residuals[rank]
        k = int(rank.sum())
        if k:
            names = [f"b{j}" for j in range(k)]
            parts = vectors.mapInArrow(_spread(own, p), "i int, " + ", ".join(f"{c} double" for c in names))
            rows = sorted(parts.groupBy("i").agg(*(F.sum(c).alias(c) for c in names)).collect())
            both = np.array([r[1:] for r in rows]) / own.n
            mean = both[k]
            own.identity_error = float(np.abs(both[:k] - np.outer(mean, mean) - np.eye(k)).max())
    return out


def _transform(fits: dict[int, Whitening], p: Params):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list = [None] * batch.num_rows
            deviation: list = [None] * batch.num_rows
            source = batch.select(["v"])
            for rows, x in _matrices(iter([source]), p):
                own = fits[x.shape[1]]
                c = centred(x, own.n, own.sums)
                for r, y in zip(rows.tolist(), whitened(c, own).tolist(), strict=True):
                    out[r] = y
                most = int(np.abs(c).max(initial=0))
                c = c if most * most * x.shape[1] < 1 << 63 else c.astype(object)
                for r, s in zip(rows.tolist(), (c * c).sum(axis=1).tolist(), strict=True):
                    deviation[r] = s if s < 1 << 63 else None
            columns = {n: batch.column(n) for n in batch.schema.names if n != "v"}
            columns |= {f"{OWN}whitened": pa.array(out, pa.list_(pa.float64())), f"{OWN}deviation": pa.array(deviation, pa.int64())}
            yield pa.RecordBatch.from_pydict(columns)

    return tidy(run)


def whiten(df: DataFrame, column: str = "embedding", p: Params | None = None) -> tuple[DataFrame, dict[int, Whitening]]:
    """All rows and columns, with ``__cc_whitened`` (one number a component) and ``__cc_deviation``, and what was fitted.

    Vectors that are null, empty or hold null or non-finite entries get null in both and have no part in the fit. Vectors of each
    length are a fit of their own. ``__cc_deviation`` is the sum over dimensions of (n * x - S)^2, exact, null where it doesn't fit a long.
    Rows that repeat count as often as they come; columns of any name pass. An empty table returns no rows.
    """
    p = p or Params()
    fits = fit(df.select(F.col(column).cast("array<double>").alias("v")), p)
    # columns go by number inside, so that any name may stand
    rows = df.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(df.columns)), F.col(column).cast("array<double>").alias("v"))
    kinds = ", ".join(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(df.schema.fields))
    out = rows.mapInArrow(_transform(fits, p), f"{kinds}, {OWN}whitened array<double>, {OWN}deviation long")
    return out.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(df.columns)), f"{OWN}whitened", f"{OWN}deviation"), fits


def op11(spark, sf_dir: str) -> DataFrame:
    """Per usable vector and component: its whitened value, and what the fit says of n, deviations, shares and the identity."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    rows, fits = whiten(vectors)
    facts = [(d, j + 1, f.n, float(f.explained[j]), f.identity_error) for d, f in fits.items() for j in range(len(f.values))]
    facts = spark.createDataFrame(facts, "d int, component int, n long, explained double, identity_error double")
    each = rows.filter(f"{OWN}whitened IS NOT NULL").select("vec_id", F.size("embedding").alias("d"), F.col(f"{OWN}deviation").alias("deviation"), F.posexplode(f"{OWN}whitened").alias("at", "whitened"))
    each = each.withColumn("component", F.col("at") + 1)
    return each.join(F.broadcast(facts), ["d", "component"]).select("vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error")
