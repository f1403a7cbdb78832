import hashlib
import random

import numpy as np
from corpuscle.llm import substring as s


def brute(rows, window):
    """doc_id -> kept words. rows: (doc_id, text); ids may repeat."""
    docs = [(i, (t or "").encode().split()) for i, t in rows]
    first = {}
    for i, ws in docs:
        for a in range(len(ws) - window + 1):
            if i is not None:
                k = tuple(ws[a : a + window])
                first[k] = min(first.get(k, i), i)
    out = []
    for i, ws in docs:
        gone = set()
        for a in range(len(ws) - window + 1):
            if i is not None and first[tuple(ws[a : a + window])] < i:
                gone |= set(range(a, a + window))
        out.append((i, len(ws), len(gone), b" ".join(w for k, w in enumerate(ws) if k not in gone).decode()))
    return sorted(out, key=str)


def found(df):
    return sorted(((r.doc_id, r[f"{s.OWN}words"], r[f"{s.OWN}removed"], r[f"{s.OWN}kept"]) for r in df.collect()), key=str)


def test_rolling_hashes_are_of_the_words_alone():
    r = np.random.default_rng(1)
    w = r.integers(0, 50, 400).astype(np.uint64)
    for n in (1, 2, 25, 50, 51):
        h = s.rolling(w, n)
        assert len(h) == 400 - n + 1 and all(s.rolling(w[a : a + n], n)[0] == h[a] for a in (0, 7, 400 - n))
        assert len(set(h.tolist())) == len({tuple(w[a : a + n].tolist()) for a in range(400 - n + 1)})
    assert len(s.rolling(w[:3], 4)) == 0


def passages(seed, n=60):
    """Documents put together from shared passages of all lengths at all offsets, some periodic, some copies."""
    r = random.Random(seed)
    shared = [[f"p{k}w{j}" for j in range(r.randint(5, 40))] for k in range(8)] + [["la"] * 30, ["a", "b"] * 15]
    rows = []
    for i in range(n):
        words = []
        for _ in range(r.randint(0, 6)):
            if r.random() < 0.6:
                p = r.choice(shared)
                a = r.randint(0, len(p) - 1)
                words += p[a : a + r.randint(1, len(p))]
            else:
                words += [f"u{r.randint(0, 400)}" for _ in range(r.randint(0, 12))]
        rows.append((r.randint(0, 10**6), r.choice([" ", "\n", " \t "]).join(words)))
    rows += [(i + 7, t) for i, t in rows[::9]] + [(i - 9, t.replace(" ", "\n")) for i, t in rows[::11]]
    return rows


def test_against_brute_force(spark):
    for seed, window in ((0, 10), (1, 3), (2, 2), (3, 17), (4, 50)):
        rows = passages(seed)
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
        assert found(s.remove_repeats(df, window)) == brute(rows, window), (seed, window)


def test_query_against_brute_force(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = [(i, n, m, hashlib.sha256(t.encode()).hexdigest()) for i, n, m, t in brute(rows, 50)]
    got = sorted((tuple(r) for r in s.op13(spark, sf).collect()), key=str)
    assert got == sorted(want, key=str) and any(m for _, _, m, _ in got)


def test_a_passage_of_many_documents_is_sent_once_a_slice(spark, monkeypatch):
    monkeypatch.setattr(s, "WORDS", 4000)
    r = random.Random(1)
    header = " ".join(f"h{k}" for k in range(70))
    rows = [(i, header + " " + " ".join(f"x{r.random()}" for _ in range(30))) for i in range(400)]
    assert found(s.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows, 50)
    from pyspark.sql import functions as F

    docs = spark.createDataFrame(rows, "k1 long, text string").select("k1", F.col("text").cast("binary").alias("text")).coalesce(1)
    sent = docs.mapInArrow(s._probes(50, 4), s._BLOBS).filter("NOT done").agg(F.sum(F.octet_length("low") / 4)).first()[0]
    assert sent < 400 * (100 - 25 + 1 - 40)  # of 46 shared windows a document one or two are left, not all


def test_edge_rows(spark):
    p = " ".join(f"w{k}" for k in range(60))
    long = " ".join(f"v{k % 9973}" for k in range(300_000))
    rows = [(5, p), (5, p), (5, "x " + p), (7, p), (None, p), (None, p + " y"), (3, None), (2, ""), (-4, " \n"), (9, "a " + p + " é"), (11, long), (12, long + " end"), (8, " ".join(p.split()[:49])), (20, "la " * 200), (21, "la " * 60)]
    df = spark.createDataFrame([(*x, 1, b"k") for x in rows], "doc_id long, text string, k1 int, c0 binary")
    out = s.remove_repeats(df)
    assert out.columns[:4] == df.columns
    got = {(r.doc_id, r.text): (r[f"{s.OWN}words"], r[f"{s.OWN}removed"]) for r in out.collect()}
    assert len(out.collect()) == len(rows)
    assert got[5, p] == (60, 0) and got[5, "x " + p] == (61, 0) and got[7, p] == (60, 60) and got[None, p] == (60, 0) and got[3, None] == (0, 0) and got[2, ""] == (0, 0)
    assert got[9, "a " + p + " é"] == (62, 60) and got[12, long + " end"] == (300_001, 300_000) and got[8, " ".join(p.split()[:49])] == (49, 0)
    assert got[11, long] == (300_000, 0) and got[20, "la " * 200] == (200, 0) and got[21, "la " * 60] == (60, 60)
    assert s.remove_repeats(df.limit(0)).count() == 0
