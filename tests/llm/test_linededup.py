import random

import numpy as np
from corpuscle.llm import linededup as d


def brute(rows, least):
    """rows: (doc_id, text), ids distinct. Deletes every line in a run that came before and has enough words."""
    docs = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    seqs = [[(k, line.strip()) for k, line in enumerate((t or "").split("\n")) if line.strip()] for _, t in docs]
    seen, drop = set(), [set() for _ in docs]
    for n, seq in enumerate(seqs):
        for a in range(len(seq)):
            words = 0
            for b in range(a, len(seq)):
                words += len(seq[b][1].split())
                run = tuple(s for _, s in seq[a : b + 1])
                if words >= least:
                    if run in seen:
                        drop[n] |= {k for k, _ in seq[a : b + 1]}
                    seen.add(run)
    out = {}
    for (i, t), gone in zip(docs, drop, strict=True):
        out[i] = "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone) if gone else t
    return out


def test_spans():
    assert d.line_spans(np.array([3, 1, 5, 2]), 6) == [[3], [2], [2], []]
    assert d.line_spans(np.array([5, 1, 1]), 5) == [[1, 2, 3], [], []]


def random_docs(seed, n=25):
    r = random.Random(seed)
    lines = [" ".join(r.choice("abcdef") for _ in range(r.choice([1, 2, 3, 8]))) for _ in range(9)]
    docs = []
    for i in range(n):
        own = [r.choice([*lines, "", f"only {i} {r.random()}"]) for _ in range(r.randint(0, 14))]
        if docs and r.random() < 0.6:
            old = docs[r.randrange(len(docs))][1].split("\n")
            a = r.randrange(len(old))
            own[len(own) // 2 : len(own) // 2] = old[a : a + r.randint(1, 12)]
        docs.append((i * 2, "\n".join(own)))
    return docs


def test_against_brute_force(spark):
    for seed, least in ((0, 10), (1, 5), (2, 17), (3, 1)):
        docs = random_docs(seed)
        df = spark.createDataFrame(docs, "doc_id long, text string")
        got = {r.doc_id: r.text for r in d.delete_repeats(df, least).collect()}
        assert got == brute(docs, least), (seed, least)


def test_query_against_brute_force(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = brute(docs, 50)
    rows = d.op9(spark, sf).collect()
    assert {r.doc_id: r.text for r in rows} == want and len(rows) == len(docs)
    assert any(r.n_deleted for r in rows) and all((r.n_deleted == 0) == (r.text == dict(docs)[r.doc_id]) for r in rows)


def test_edge_rows(spark):
    passage = "\n".join(f"line {k} of a passage with quite a few words in it" for k in range(6))
    long = "\n".join(f"row {k}" for k in range(60_000))
    rows = [(3, passage), (3, passage), (1, None), (2, ""), (None, "x\n" + passage + "\ny"), (9, "start\r\n" + passage.replace("\n", "\r\n") + "\nend"), (10, passage), (11, long), (12, "\n\n")]
    df = spark.createDataFrame([(a, b, [1], "z") for a, b in rows], "doc_id long, text string, n array<int>, pos string")
    got = d.delete_repeats(df).collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r.text)
        assert r.n == [1] and r.pos == "z"
    assert by == {3: ["", ""], 1: [None], 2: [""], None: ["x\n" + passage + "\ny"], 9: ["start\r\nend"], 10: [""], 11: [long], 12: ["\n\n"]}
    left = d.keep_remaining(df)
    assert left.columns == df.columns and sorted((r.doc_id or -1) for r in left.collect()) == [-1, 1, 2, 9, 11, 12]
    assert d.keep_remaining(df.limit(0)).count() == 0


def test_ranks_start_no_python_tasks_of_the_rdd_kind(spark):
    groups = spark.createDataFrame([(b"a", 2), (b"b", 3), (b"c", 4)], "line binary, n long")
    got = d.ranked(groups, ["line"])
    assert {bytes(r.line): r.rank for r in got.collect()} == {b"a": 0, b"b": 2, b"c": 5}
    assert "ExistingRDD" not in got._jdf.queryExecution().executedPlan().toString()
