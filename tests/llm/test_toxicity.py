import random

import numpy as np
from corpuscle.llm import linear, toxicity

P = toxicity.Params(terms=60, against=20, least_docs=3)
BAD = ("rotten", "vileness", "vilest")


def corpus(n=300):
    r = random.Random(6)
    plain = "stone river cloud green walk paper seven table light winter vine villa".split()
    docs, labels = [], []
    for i in range(n):
        toxic = i % 5 == 0
        words = [r.choice(plain) for _ in range(r.randint(5, 60))]
        if toxic:
            for _ in range(2):
                words.insert(r.randrange(len(words)), r.choice(BAD).upper())
        docs.append((i, " ".join(words), "x"))
        if i % 2:
            labels.append((i, int(r.random() < 0.8), int(toxic)))
    return docs, labels


def frames(spark, docs, labels):
    return spark.createDataFrame(docs, "doc_id long, text string, y0 string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_unlabelled_rows(spark):
    docs, labels = corpus()
    df, lab = frames(spark, docs, labels)
    kept = {r.doc_id for r in toxicity.keep_clean(df, lab, P).collect()}
    assert kept == {i for i, _, _ in docs if i % 5}


def test_later_links_are_fitted_on_out_of_fold_chances(spark):
    df, lab = frames(spark, *corpus())
    chain = toxicity.learn(df, lab, P)
    assert [len(w) for w in chain.weights] == [2 * len(chain.terms) + 1, 2 * len(chain.terms) + 2]
    assert chain.out_of_fold.shape[1] == 2 and 140 < len(chain.out_of_fold) <= 150 and set(BAD) <= set(chain.terms)


def test_query(spark, sf):
    rows = toxicity.op10(spark, sf).collect()
    docs = spark.read.parquet(f"{sf}/documents.parquet").count()
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    seen = [(labels[r.doc_id], r.toxic) for r in rows if r.doc_id in labels]
    assert len(rows) == docs and sum(a == b for a, b in seen) > 0.95 * len(seen)


def test_edge_rows(spark):
    docs, labels = corpus()
    docs += [(900, None, "x"), (901, "", "x"), (902, "...", None), (903, "rotten vilest", "x"), (903, "rotten vilest", "x"), (None, "rotten vilest", "x"), (904, "stone river " * 200_000 + "x" * 100_000, "x")]
    labels += [(None, 1, 1), (7, None, 1), (8, 1, None), (5, 1, 1), (5, 1, 1), (5000, 0, 1)]
    df, lab = frames(spark, docs, labels)
    kept = toxicity.keep_clean(df, lab, P)
    rows = kept.collect()
    assert kept.columns == df.columns and {900, 901, 902, 904} <= {r.doc_id for r in rows} and not {903, None} & {r.doc_id for r in rows}
    assert toxicity.keep_clean(df.limit(0), lab, P).count() == 0
    assert toxicity.keep_clean(df, lab.limit(0), P).count() == len(docs)


def test_sparse_products():
    r = np.random.default_rng(0)
    x = (r.random((20, 9)) < 0.3) * r.random((20, 9))
    at = [np.flatnonzero(row).tolist() for row in x]
    s = linear.Sparse(at, [row[a].tolist() for row, a in zip(x, at, strict=True)], 9).beside(np.arange(20.0))
    full, w, g = np.hstack([x, np.arange(20.0)[:, None]]), r.random(10), r.random(20)
    assert np.allclose(s @ w, full @ w) and np.allclose(s.back(g), full.T @ g)
    keep = r.random(20) < 0.5
    assert np.allclose(s.take(keep) @ w, full[keep] @ w)
    y = np.where(full[:, 0] > 0, 1.0, -1.0)
    assert (np.sign(linear.fit(s, y, "logistic", 1e-6, 2000)[:10] @ full.T) == y).mean() > 0.5


def brute_counts(text, terms, starts):
    import re

    words = re.findall(r"[^\W_]+", text.lower())
    own = [t for w in words for t in [w, *(w[:k] + "*" for k in starts if len(w) > k)] if t in terms]
    return len(words), {t: own.count(t) for t in set(own)}


def test_counts_of_terms_against_brute_force():
    r = random.Random(3)
    vocabulary = ["".join(r.choice("abcdé1_-") for _ in range(r.randint(1, 9))) for _ in range(80)]
    texts = [" ".join(r.choice(vocabulary) for _ in range(r.randint(0, 200))) for _ in range(40)] + ["", "\0a\0", "B" * 3_000_000 + " abc"]
    terms = sorted({v.lower() for v in vocabulary[:30]} | {v[:4].lower() + "*" for v in vocabulary} | {"a", "bbbb*"})
    p = toxicity.Params(remembered=20)
    words, text, term, times = toxicity.Terms(terms, p).count([t.encode() for t in texts])
    for i, t in enumerate(texts):
        got = {terms[k]: n for at, k, n in zip(text.tolist(), term.tolist(), times.tolist(), strict=True) if at == i}
        assert (int(words[i]), got) == brute_counts(t, set(terms), p.starts)


def test_rows_held_out(spark, sf):
    """Fitted on two thirds of the labels, held to the rest."""
    at = sf.replace("sf0.001", "sf0.1")
    docs, labels = (spark.read.parquet(f"{at}/{t}.parquet") for t in ("documents", "labels"))
    chain = toxicity.learn(docs, labels.filter("crc32(cast(cast(doc_id as string) as binary)) % 3 <> 0"))
    rest = labels.filter("crc32(cast(cast(doc_id as string) as binary)) % 3 = 0").select("doc_id", "toxic")
    found = toxicity.predict(docs.join(rest, "doc_id"), chain).select("toxic", "__cc_toxic").collect()
    said = [(r.toxic, r["__cc_toxic"] >= chain.cut("toxic")) for r in found]
    hit = sum(a and b for a, b in said)
    assert len(said) > 1000 and hit >= 0.9 * sum(a for a, _ in said) and hit >= 0.9 * sum(b for _, b in said)


def test_repeated_ids_keep_the_sample_bounded(spark):
    docs, labels = corpus()
    more = [(1, f"stone river {i}", "x") for i in range(2000)] + [(3, "stone", "x")] * 500
    df, lab = frames(spark, docs + more, labels * 3)
    rows = toxicity.labelled_sample(df, lab, toxicity.Params(sample=200))
    assert 100 < rows.count() < 300
