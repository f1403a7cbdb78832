import collections
import math
import zlib

import numpy as np
from corpuscle.llm import lm


def base(docs):
    c = collections.Counter()
    for i, t in docs:
        if zlib.crc32(str(i).encode()) % 7 != 2 or i is None:
            c.update((t or "").encode().lower().split())
            c[None] += 1
    n, v, out = sum(c.values()), len(c), []
    for i, t in docs:
        w = [*(t or "").encode().lower().split(), None]
        held = i is not None and zlib.crc32(str(i).encode()) % 7 == 2
        out.append((i, held, len(w), sum(c[x] > 0 for x in w), n, round(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), 6)))
    return out


def key(rows):
    return sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in rows), key=str)


def test_base_and_gain(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    rows = lm.op3(spark, sf).collect()
    assert key(rows) == sorted(base(docs), key=str)
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held) and all(r.score < 0 for r in rows)


def test_rare_words_by_join_give_the_same_sums(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet").limit(60)
    docs = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    few = lm.score_documents(df, lm.Params(frequent=20, groups=8, known=40, distinct=500)).collect()
    all_ = lm.score_documents(df, lm.Params(frequent=20, groups=8)).collect()
    assert key(few) == sorted(base(docs), key=str)
    assert np.allclose(sorted(r.score for r in few), sorted(r.score for r in all_), atol=1e-6)


def test_classes_are_normalised():
    p = lm.Params(frequent=30, groups=9, dim=6)
    r = np.random.default_rng(0)
    w = {"r": r.normal(size=(p.classes, 6)), "q": r.normal(size=(p.classes, 6)), "b": r.normal(size=p.classes), "c": r.normal(size=(2, 6))}
    t = lm.Tables(w)
    y = np.arange(p.classes)
    for a, b in ((0, 1), (p.end, p.end), (5, 38)):
        assert abs((10 ** t.score(y, np.full(p.classes, a), np.full(p.classes, b))).sum() - 1) < 1e-4


def test_group_in_sql_is_group_in_python(spark):
    from pyspark.sql import functions as F

    words = [b"", b"a", b"ab", b"abc", "été".encode(), b"longer-word", b"\xff\xfe\xfd\xfc"]
    df = spark.createDataFrame([(bytearray(w),) for w in words], "word binary")
    for r in df.select("word", (F.crc32(F.substring("word", -3, 3)) % 256).alias("g")).collect():
        assert r.g == lm.group_of(bytes(r.word), 256)


def test_nce_learns_a_transition():
    p = lm.Params(frequent=6, groups=1, dim=4, noise=16, batch=64)
    v = lm.Vocabulary(p, [], np.array([]), 0, 0, np.full(p.classes, 100), np.zeros(1), None)
    t = lm.Trainer(lm.initial(v), v.unigram(), p, 0)
    seq = np.tile(np.arange(6), 3000).astype(np.int16)
    x1, x2 = lm.contexts(seq, p.end)
    for i in range(0, len(seq), 64):
        t.step(seq[i : i + 64], x1[i : i + 64], x2[i : i + 64])
    score = lm.Tables(t.w).score(np.array([3]), np.array([2]), np.array([1]))
    assert 10 ** score[0] > 0.6


def test_edge_rows(spark):
    rows = [(1, None, "x", 1), (2, "", "x", 1), (2, "", "x", 1), (None, "A a", None, None), (5, "long " * 300_000, "x", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, uid string, n_tokens int")
    assert key(lm.score_documents(df).collect()) == sorted(base([r[:2] for r in rows]), key=str)
    assert lm.score_documents(df.limit(0)).count() == 0


TINY = lm.Params(frequent=12, groups=4, known=30, dim=5, noise=8, batch=32, shard=400, fan_in=3)


def tiny(spark):
    r = np.random.default_rng(3)
    words = "a the cat dog sat ran on mat and barked é zebra quagga ibis lynx stoat".split()
    docs = [(i, " ".join(words[k] for k in np.minimum(r.geometric(0.2, r.integers(0, 40)) - 1, 15))) for i in range(120)]
    docs += [(200 + i, "the hot copy sat on the mat") for i in range(150)]
    return docs, spark.createDataFrame(docs, "doc_id long, text string")


def test_score_against_brute_force(spark):
    docs, df = tiny(spark)
    texts = df.filter(~lm.held_out()).select(lm.raw_text().alias("text"))
    v = lm.Vocabulary.of(lm.count_words(texts), TINY)
    w = {k: x.astype(np.float64) for k, x in lm.train(texts, v).items()}
    count = collections.Counter(x for i, t in docs if zlib.crc32(str(i).encode()) % 7 != 2 for x in [*t.encode().split(), None])
    own = {x: i for i, x in enumerate(sorted((x for x in count if x), key=lambda x: (-count[x], x))[: TINY.frequent])}

    def class_of(x):
        return TINY.end if x is None else own.get(x, TINY.frequent + lm.group_of(x, TINY.groups))

    def log_p(x, x1, x2):
        s = (w["c"][0] * w["r"][x1] + w["c"][1] * w["r"][x2]) @ w["q"].T + w["b"]
        y = class_of(x)
        inner = 0.0
        if x is not None and x not in own:
            members = [c for m, c in count.items() if m and m not in own and class_of(m) == y]
            inner = math.log10((count[x] + 1) / (sum(members) + len(members) + 1))
        return (s[y] - np.log(np.exp(s).sum())) / math.log(10) + inner

    want = {}
    for i, t in docs:
        x1 = x2 = TINY.end
        want[i] = 0.0
        for x in [*t.encode().split(), None]:
            want[i] += log_p(x, x1, x2)
            x2, x1 = x1, class_of(x)
    got = {r.doc_id: r.score for r in lm.score_documents(df, TINY).collect()}
    assert got.keys() == want.keys() and max(abs(got[i] - want[i]) for i in got) < 1e-3


def test_same_rows_in_other_files_give_the_same_scores(spark):
    _, df = tiny(spark)
    scores = [{r.doc_id: r.score for r in lm.score_documents(d, TINY).collect()} for d in (df.repartition(1), df.repartition(7), df.orderBy("text"))]
    assert all(max(abs(scores[0][i] - s[i]) for i in s) < 1e-9 for s in scores[1:])


def test_every_token_is_trained_on_and_hot_copies_spread(spark):
    docs, df = tiny(spark)
    texts = df.select(lm.raw_text().alias("text"))
    v = lm.Vocabulary.of(lm.count_words(texts), TINY)
    rows = lm.sharded(texts, spark.sparkContext.broadcast((v.words, v.classes())), 5, TINY).collect()
    codes = [np.frombuffer(bytes(r.codes), "<i2") for r in rows]
    assert len(rows) == len(docs) and sum(len(c) - 2 for c in codes) == v.tokens
    hot = collections.Counter(bytes(r.codes) for r in rows).most_common(1)[0]
    assert hot[1] == 150 and collections.Counter(r.shard for r in rows if bytes(r.codes) == hot[0]) == {k: 30 for k in range(5)}


def test_long_texts_go_in_pieces_that_know_what_came_before(spark, monkeypatch):
    monkeypatch.setattr(lm, "word_runs", lambda text: (text.lower().split()[i : i + 3] for i in range(0, len(text.split()), 3)))
    words = [b"a", b"b", b"c"]

    class Shared:
        value = (words, np.arange(3, dtype=np.int32))

    import pyarrow as pa

    p = lm.Params(frequent=3, groups=1)
    batch = pa.RecordBatch.from_pydict({"k1": [1, 2], "k2": [1, 2], "text": [b"a b c a c b a", b""]})
    out = pa.Table.from_batches(lm._encode(Shared, p)(iter([batch]))).to_pylist()
    got = [(r["k1"], r["part"], np.frombuffer(r["codes"], "<i2").tolist()) for r in out]
    e = p.end
    assert got == [(1, 0, [e, e, 0, 1, 2]), (1, 1, [1, 2, 0, 2, 1]), (1, 2, [2, 1, 0, e]), (2, 0, [e, e, e])]


def test_vocabulary_is_filled_to_its_bound(spark):
    """Neither many words of one count nor very long ones leave the classes empty, and no result depends on the bound."""
    even = [(i, f"w{i:03d} x{i:03d} w{i:03d} x{i:03d}") for i in range(100)]
    for docs in (even, [*even, (500, "two " * 9 + "more " * 8)], [*even, (600, "z" * (1 << 20))]):
        df = spark.createDataFrame(docs, "doc_id long, text string")
        v = lm.Vocabulary.of(lm.count_words(df.select(lm.raw_text().alias("text"))), TINY)
        assert 12 <= len(v.words) <= 70 and (v.class_count[: TINY.frequent] > 0).all() and max(map(len, v.words)) <= TINY.longest
        if len(docs) == 101 and docs[-1][0] == 500:
            assert v.words[:2] == [b"two", b"more"]
        assert key(lm.score_documents(df, TINY).collect()) == sorted(base(docs), key=str)
