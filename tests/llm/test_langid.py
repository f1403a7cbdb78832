import random
import zlib

import numpy as np
from corpuscle.llm import langid

COMMON = {"en": "the of and to in is that for was on", "de": "der die und das ist nicht ein mit auf den", "fr": "le la les des une dans pour que est sur", "es": "el los las una por con para del que muy"}


def corpus(n=160):
    r = random.Random(5)
    langs = list(COMMON)
    return [(i, " ".join(r.choice(COMMON[langs[i % 4]].split()) for _ in range(r.randint(4, 60))), langs[i % 4]) for i in range(n)]


def test_accuracy_on_held_out_rows(spark):
    rows = corpus()
    got = {r.doc_id: r for r in langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert len(got) == len(rows)
    for i, _, lang in rows:
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2)
        assert got[i].lang_pred == lang and 0 <= got[i].score <= 1


def test_query(spark, sf):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = langid.op8(spark, sf).collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == len(docs) and sum(r.lang_pred == docs[r.doc_id].lang for r in held) >= 0.85 * len(held)  # 150 rows to learn from


def test_families_come_first(spark):
    rows = corpus()
    model = langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.top.classes == ["germanic", "romance"]
    assert {f: m.classes for f, m in model.within.items()} == {"germanic": ["de", "en"], "romance": ["es", "fr"]}


def test_features_of_long_texts_are_whole():
    text = "abc déf " * 200_000
    whole = langid.features(text, 10)
    assert np.isclose(np.linalg.norm(whole), 1) and np.allclose(whole, langid.features("abc déf " * 1000, 10), atol=2e-3)


def test_edge_rows(spark):
    rows = [*corpus(60), (1000, None, "en"), (1001, "", None), (1002, "123 !?", "de"), (1005, "\u00b2 \u00bd 1\u00b2 \u2167", "de"), (1003, "the and of", None), (1003, "the and of", None), (None, "der die das und", "de"), (1004, "le la les " * 100_000, "fr")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string, score string")
    got = langid.identify(df).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(rows) and [by[i].lang_pred for i in (1000, 1001, 1002, 1005)] == ["und"] * 4
    assert by[1003].lang_pred == "en" and by[None].lang_pred == "de" and by[1004].lang_pred == "fr"
    assert langid.identify(df.limit(0)).count() == 0
    none = df.withColumn("lang", df.lang.substr(1, 0)).filter("false").union(df.select("doc_id", "text", df.score.substr(9, 1).alias("lang"), "score").replace("", None))
    assert {r.score for r in langid.identify(none).collect() if r.lang_pred == "und"} == {0.0}


def test_every_language_gives_its_even_share(spark):
    r = random.Random(8)
    small = {f"x{k}": [f"{chr(97 + k)}{chr(98 + k)}{c}{chr(97 + k)}" for c in "aeiou"] for k in range(20)}
    rows = [(i, " ".join(r.choice(w) for _ in range(20)), lang) for i, (lang, w) in enumerate((lang, w) for lang, w in small.items() for _ in range(400 if lang == "x0" else 15))]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    seen = {}
    first, langid.Model.__init__ = langid.Model.__init__, lambda self, x, langs, p: (seen.update({g: langs.count(g) for g in langs}), first(self, x, langs, p))[1]
    try:
        model = langid.learn(df)
    finally:
        langid.Model.__init__ = first
    assert all(seen[g] == 15 for g in small if g != "x0") and 110 <= seen["x0"] <= 190
    x = np.array([langid.features(" ".join(w), model.p.bits) for w in small.values()])
    assert [g for g, _ in model.predict(x)] == list(small)


def test_machines_are_one_versus_one_at_every_size():
    """Coefficients of rows give the margins of the summed weights; each is a descent on the weights themselves."""
    from corpuscle.llm.linear import fit

    r, p = np.random.default_rng(4), langid.Params()
    langs = [f"x{k:03d}" for k in range(230) for _ in range(2)]
    centre = r.normal(0, 1, (230, 40))
    x = (np.repeat(centre, 2, 0) + r.normal(0, 0.1, (460, 40))).astype(np.float16)
    m = langid.OneVersusOne(x, langs, p)
    for a, b in m.pairs[:300]:
        m.take(a, b, *m.solve(a, b))
    weights = {(a, b): m.coefficients[a][:, b] @ x[m.rows[a]].astype(np.float32) + m.coefficients[b][:, a] @ x[m.rows[b]].astype(np.float32) for a, b in m.pairs[:300]}
    m.ready()
    assert m.weights is None and len(m.pairs) == 230 * 229 // 2
    probe = r.normal(0, 1, (5, 40)).astype(np.float32)
    got = m.margins(probe)
    for (a, b), w in weights.items():
        assert np.allclose(got[:, a, b], probe @ w + m.bias[a, b], atol=1e-3) and np.allclose(got[:, a, b], -got[:, b, a])
        if a == 0 and b < 9:
            own = np.concatenate([m.rows[a], m.rows[b]])
            plain = fit(x[own].astype(np.float32), np.repeat([1.0, -1.0], 2), "hinge", p.ridge)
            assert np.allclose(probe @ plain[:-1] + plain[-1], got[:, a, b], atol=0.05)
    small = langid.OneVersusOne(x[:8], langs[:8], p)
    for a, b in small.pairs:
        small.take(a, b, *small.solve(a, b))
    by_rows = small.margins(probe)
    small.ready()
    assert small.weights is not None and np.allclose(small.margins(probe), by_rows, atol=1e-3)


def test_repeats_leave_the_sample_bounded(spark):
    rows = [*corpus(200), *((7, "der die das und ist", "de") for _ in range(3000)), *((None, f"the of and {i}", "en") for i in range(3000))]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    seen = []
    first, langid.Model.__init__ = langid.Model.__init__, lambda self, x, langs, p: (seen.extend(langs), first(self, x, langs, p))[1]
    try:
        langid.learn(df, langid.Params(sample=400))
    finally:
        langid.Model.__init__ = first
    assert len(seen) <= 400 * 1.3 and seen.count("de") <= 60 and seen.count("fr") == seen.count("es") == 50


def test_accuracy_at_scale(spark, sf):
    docs = spark.read.parquet(f"{sf.replace('sf0.001', 'sf0.01')}/documents.parquet")
    lang = {r.doc_id: r.lang for r in docs.collect()}
    held = [r for r in langid.identify(docs).collect() if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.95 * len(held) > 200
