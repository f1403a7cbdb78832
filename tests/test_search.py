import random

import numpy as np
from pyspark.sql import functions as F

from corpuscle.operators import postings, quantize, retrieval, topk

BIG = "/root/testdata/sf0.1"


def test_postings_find_what_the_scan_finds(spark):
    r = random.Random(2)
    rows = [(i, r.choice([None, "", "ab", "Ab\ncd"]) if i % 9 == 0 else "".join(r.choice("abcd \n") for _ in range(r.randint(1, 60)))) for i in range(300)]
    rows += [(400 + i, "the same text abc") for i in range(30)]
    docs = spark.createDataFrame(rows, "k int, text string")
    index = postings.index(docs, "k")
    for question in ("abc dabc", "a", "ab ab zz", "c\td bcdabc abcdabcd", "  ", "ABC", "xyz"):
        want = retrieval.keyword_search(docs, question, 40, "k").select("k", "score") if question.strip() else docs.limit(0).select("k", F.lit(0))
        got = postings.search(docs, index, question, 40, "k").select("k", "score")
        assert [tuple(x) for x in got.collect()] == [tuple(x) for x in want.collect()], question


def test_few_texts_are_read_for_a_rare_term(spark):
    docs = spark.read.parquet(f"{BIG}/documents.parquet").select("doc_id", "text")
    index = postings.index(docs, "doc_id")
    n, read = docs.count(), postings.candidates(index, ["apache"], "doc_id").count()
    have = docs.filter(F.contains(F.lower("text"), F.lit("apache"))).count()
    assert have <= read < n / 20
    plan = index.filter(F.col("gram").isin("apa", "che"))._jdf.queryExecution().toString()
    assert "PushedFilters: [In(gram" in plan


def test_blocks_of_questions_and_heaps_of_tasks_merge(spark, monkeypatch):
    r = np.random.default_rng(3)
    v = r.standard_normal((500, 6)).round(1)
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(900, None), (901, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (902, [float("nan")] * 6), (903, v[0].tolist())]
    df = spark.createDataFrame(rows, "k long, embedding array<double>").repartition(7)
    questions = df.filter("k % 10 = 0 OR k > 899").withColumnRenamed("k", "query")
    want = []
    good = {**dict(rows[:500]), 903: v[0].tolist()}
    for q in [i for i in good if i % 10 == 0 or i > 899]:
        near = sorted((round(float(((np.array(x) - np.array(good[q])) ** 2).sum()), 6), k) for k, x in good.items())[:4]
        want += [(q, k, d) for d, k in near]
    for block in (1 << 22, 60):
        monkeypatch.setattr(topk, "BLOCK", block)
        assert sorted(map(tuple, topk.nearest(df, questions, 4, "k").collect())) == sorted(want)
    assert topk.nearest(df, questions.limit(0), 4, "k").count() == 0 and topk.nearest(df.limit(0), questions, 4, "k").count() == 0


def test_quantised_search_reaches_recall_with_few_comparisons(spark):
    from corpuscle.plans import all_queries

    exact = {(r.query, r.vec_id) for r in all_queries()["nearest_of_many"](spark, BIG).collect()}
    rows = all_queries()["quantized_neighbours"](spark, BIG).collect()
    got = {(r.query, r.vec_id) for r in rows}
    n = spark.read.parquet(f"{BIG}/embeddings.parquet").count()
    assert len(got) == len(rows) == len(exact) and len(got & exact) >= 0.9 * len(exact)
    assert 100 / n < 0.1  # exact comparisons a question
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert quantize.fit(empty) is None


def test_postings_are_written_without_a_shuffle(spark, monkeypatch):
    rows = [(i, t) for i, t in enumerate(["aXbX", "\U0001d518\U0001d518\U0001d518b", "", None, "ab", "İstanbul", "xyzxyz"])]
    docs = spark.createDataFrame(rows, "k int, text string")
    plans = []
    monkeypatch.setattr(postings, "written", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or df)
    got = {(r.gram, k) for r in postings.index(docs, "k").collect() for k in r["keys"]}
    low = {r.k: r.t for r in docs.select("k", F.lower("text").alias("t")).collect() if r.t}
    assert got == {(t[i : i + 3], k) for k, t in low.items() for i in range(max(1, len(t) - 2))}
    assert "Exchange" not in plans[0]


def test_tasks_send_keys_in_turns(spark):
    r = np.random.default_rng(8)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(r.standard_normal((600, 8)))], "k long, embedding array<double>").repartition(3)
    book, asked = quantize.fit(df), df.filter("k % 20 = 0").withColumnRenamed("k", "query")
    runs = [quantize.search(quantize.index(df, book, "k"), asked, book, 5, "k", probes=20, refine=30, most=m) for m in (1 << 20, 50)]
    one, two = (sorted(map(tuple, x.collect())) for x in runs)
    assert one == two and len(one) == 150
    plan = runs[0]._jdf.queryExecution().analyzed().toString()
    assert all("embedding" not in x.split("),")[-1].split("[", 1)[1] for x in plan.splitlines() if "MapInArrow run" in x and "rough" in x)


def test_a_cell_meets_its_questions_in_products(spark):
    r = np.random.default_rng(9)
    rows = [(i, x.tolist()) for i, x in enumerate(r.standard_normal((400, 6)))]
    df = spark.createDataFrame(rows, "k long, embedding array<double>")
    centres = retrieval.ivf_fit(df, cells=9)
    found = retrieval.ivf_search(retrieval.ivf_assign(df, centres, "k"), df.filter("k < 40"), centres, 4, "k", probes=3)
    x = np.array([v for _, v in rows])
    cell = lambda v, n: np.argsort(-2 * v @ centres.T + (centres**2).sum(1), kind="stable")[:n].tolist()
    own = [cell(v, 1)[0] for v in x]
    want = [(i, k, d) for i in range(40) for d, k in sorted((round(float(((x[k] - x[i]) ** 2).sum()), 6), k) for k in range(400) if own[k] in cell(x[i], 3))[:4]]
    assert sorted(map(tuple, found.collect())) == sorted(want)
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
