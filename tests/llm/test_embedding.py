import numpy as np
from corpuscle.llm import embedding as e


def brute(rows, threshold=0.93):
    """rows: (vec_id, vector, label); n_links and component_id of each row, by position."""
    n = len(rows)
    x = [np.array(v, float) if v and label is not None and i is not None and None not in v else None for i, v, label in rows]
    x = [None if v is None or not np.isfinite(v).all() or not v.any() else v / np.linalg.norm(v) for v in x]
    near = [[j for j in range(n) if i != j and x[i] is not None and x[j] is not None and rows[i][2] == rows[j][2] and len(x[i]) == len(x[j]) and x[i] @ x[j] >= threshold] for i in range(n)]
    low = [r[0] for r in rows]
    changed = True
    while changed:
        changed = False
        for i in range(n):
            for j in near[i]:
                if low[j] < low[i]:
                    low[i], changed = low[j], True
    return sorted(((rows[i][0], len(near[i]), low[i]) for i in range(n)), key=str)


def got(df, p=None):
    out = e.near_duplicates(df, p) if p else e.near_duplicates(df)
    rows = out.collect()
    assert all(r.kept == (r.vec_id == r.component_id or r.vec_id is None) for r in rows)
    return sorted(((r.vec_id, r.n_links, r.component_id) for r in rows), key=str)


def clusters(seed=0, dim=64, n=40, size=6):
    r = np.random.default_rng(seed)
    rows = []
    for c in range(n):
        x = r.normal(size=dim)
        for _ in range(size):
            y = x + r.normal(size=dim) * r.choice([0.05, 0.15, 0.2, 0.35])
            rows.append((len(rows) * 3 + 1, [float(v) for v in (y if r.random() < 0.8 else x)], int(c % 3)))
    return rows


SCHEMA = "vec_id long, embedding array<double>, label int"


def test_hadamard_is_orthonormal():
    h = e.hadamard(np.eye(16))
    assert np.allclose(h @ h.T, np.eye(16)) and np.allclose(np.abs(h), 0.25)


def pairs_at(cosine, n, dim, seed=1):
    r = np.random.default_rng(seed)
    x, z = e.unit(r.normal(size=(n, dim))), r.normal(size=(n, dim))
    return x, cosine * x + np.sqrt(1 - cosine**2) * e.unit(z - (z * x).sum(1, keepdims=True) * x)


def test_recall_at_the_threshold():
    for dim, rows, n in ((16, 1000, 2000), (64, 1000, 3000), (64, 50_000, 3000), (64, 2_000_000, 1000), (128, 100_000, 2000), (384, 1000, 1000), (384, 1_000_000, 600), (768, 100_000, 600)):
        x, y = pairs_at(0.93, n, dim)
        p = e.Params(rows=rows)
        step = 200
        met = [(e.buckets(x[s : s + step], p)[:, :, None] == e.buckets(y[s : s + step], p)[:, None, :]).any((1, 2)) for s in range(0, n, step)]
        assert np.concatenate(met).mean() >= 0.99, (dim, rows, p.of(dim))


def test_links_of_rows_do_not_depend_on_other_rows(spark, monkeypatch):
    rows = [(k, [float(x) for x in v], 1) for k, v in enumerate(np.random.default_rng(5).normal(size=(400, 16)))]
    used = []
    monkeypatch.setattr(e, "_entries", lambda p, f=e._entries: used.append(p.of(16)) or f(p))
    for n in (20, 400):
        e.near_duplicates(spark.createDataFrame(rows[:n], SCHEMA), e.Params(meets=1)).count()
    assert used[0] == used[1]


def test_foreign_vectors_met_stay_bounded_as_rows_grow():
    met = []
    for n in (4000, 16_000, 64_000):
        x = e.unit(np.random.default_rng(n).normal(size=(n, 64)))
        codes = np.concatenate([e.buckets(x[s : s + 1000], e.Params(rows=n)) for s in range(0, n, 1000)])
        _, size = np.unique(codes.ravel(), return_counts=True)
        met.append((size * (size - 1)).sum() / n)
    assert max(met) <= 3 * e.Params().meets


def test_extreme_lengths_and_labels_that_share_a_key(spark):
    v = [0.3, -0.2, 0.9, 0.1]
    rows = [(1, [x * 1e200 for x in v], 1), (2, [x * 1e-170 for x in v], 1), (3, v, 1), (4, [x * 1.0001 for x in v], 2), (5, v, 2)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert [r[1:] for r in got(df)] == [(2, 1), (2, 1), (2, 1), (1, 4), (1, 4)]
    named = df.withColumn("label", df.label.cast("string"))
    assert got(named) == got(df)
    cells = e._Cells(e.unit(np.array([v, v, v])), np.arange(3), np.ones(3, int), np.array(["a", "b", "a"]), e.Params())
    cells.small(np.array([0]), np.array([3]), e.buckets(cells.x, cells.p)[0, : cells.p.probes].min(keepdims=True))
    out = cells.flush()
    assert out.column("rep").to_pylist() == [0, 2]


def test_against_brute_force(spark):
    rows = clusters()
    assert got(spark.createDataFrame(rows, SCHEMA)) == brute(rows)


def test_large_buckets_in_cells(spark):
    rows = clusters(seed=3, n=8, size=60)
    assert got(spark.createDataFrame(rows, SCHEMA), e.Params(part=7)) == brute(rows)


def test_query(spark, sf):
    rows = [(r.vec_id, list(r.embedding), r.label) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    out = e.op1(spark, sf)
    assert out.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert sorted(((r.vec_id, r.n_links, r.component_id) for r in out.collect()), key=str) == brute(rows)


def test_edge_rows(spark):
    v = [1.0, 2.0, 3.0]
    rows = [(1, v, 1), (1, v, 1), (2, [2.0, 4.0, 6.0], 1), (3, v, 2), (4, v, None), (5, None, 1), (6, [0.0, 0.0, 0.0], 1), (7, [1.0, None, 3.0], 1), (8, [1.0, float("nan"), 3.0], 1), (9, [1.0, float("inf"), 3.0], 1), (10, [1.0, 2.0], 1), (None, v, 1), (11, [1.0, 2.0], 1), (12, [-5.0], 1), (13, [-1.0], 1), (14, [], 1)]
    df = spark.createDataFrame([(*r, 5, "x") for r in rows], SCHEMA + ", n_links long, rep string")
    assert got(df) == brute(rows)
    assert e.near_duplicates(df.limit(0)).count() == 0


def test_few_copies_of_a_vector_are_shuffled(spark):
    """Entries that meet nobody are dropped before vectors move."""
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").dropDuplicates(["label", "embedding"])
    from pyspark.sql import functions as F

    distinct = rows.select(F.col("vec_id").alias("rep"), F.lit(1).cast("long").alias("mult"), F.col("label").cast("long").alias("label_key"), F.col("embedding").cast("array<double>").alias("embedding"), F.lit("").alias("name"), F.xxhash64("embedding").alias("vkey"), F.col("embedding").alias("vector"))
    p = e.Params(rows=300)
    n, entries = distinct.count(), p.of(64).tables * p.of(64).probes
    assert e.meetings(distinct, p).count() < 3 * n < entries * n / 4
