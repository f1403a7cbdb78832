import random

import numpy as np
import xxhash
from corpuscle.llm import simhash
from corpuscle.llm.components import components

SCHEMA = "doc_id long, text string, lang string, fp string, component_id string"


def plain(text):
    w = (text or "").encode().lower().split()
    grams = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def classes(ids, pairs):
    up = {i: i for i in ids}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in pairs:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return {i: top(i) for i in ids}


def test_every_pair_within_two_bits_meets_at_a_home():
    r = random.Random(1)
    xs, ys = [], []
    for _ in range(400):
        x = y = r.getrandbits(64)
        for b in r.sample(range(64), r.randint(0, 2)):
            y ^= 1 << b
        xs.append(x)
        ys.append(y)
    for blocks in (1, 2, 3):
        home = simhash.homes(np.array(xs, np.uint64), blocks)
        row, anchor = simhash.replicas(np.array(ys, np.uint64), blocks)
        reach = set(zip(row.tolist(), anchor.tolist(), strict=True))
        assert len(reach) == len(row) and all((k, h) in reach for k, h in enumerate(home.tolist()))


def test_codewords_are_perfect_codes():
    y = np.random.default_rng(0).integers(0, 2**63, 300, dtype=np.uint64)
    home, at = simhash.homes(y, 3), 0
    for b, (poly, length, radius) in enumerate(simhash.CODES):
        patterns, begin = simhash.cosets(b)[0]
        assert len(patterns) == 1 << poly.bit_length() - 1 and (np.diff(begin) == 1).all()
        word, own = (home >> at) & (2**length - 1), (y.astype(np.int64) >> at) & (2**length - 1)
        assert (simhash.syndrome(word, b) == 0).all() and np.bitwise_count(word ^ own).max() <= radius
        at += length


def test_comparisons_stay_bounded_as_fingerprints_grow():
    for blocks, n, most in ((2, 4096, 80), (3, 4096, 200)):
        row, _ = simhash.replicas(np.random.default_rng(n).integers(0, 2**63, n, dtype=np.uint64), blocks)
        assert len(row) <= most * n  # replicas a fingerprint
    # Of 16 times the fingerprints at which the third block sets in, each meets few at the anchors.
    assert simhash.MANY * 80 / 2**24 <= 80 and 16 * simhash.MANY * 200 / 2**35 <= 2


def test_long_and_short_bit_counts_agree():
    h = np.random.default_rng(0).integers(0, 2**63, 5000, dtype=np.uint64)
    assert (simhash.bit_counts(h) == sum(simhash.bit_counts(h[i : i + 1000]) for i in range(0, 5000, 1000))).all()


def test_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    want = {r.doc_id: plain(r.text) for r in docs}
    ids = sorted(want)
    pairs = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if (want[a] ^ want[b]).bit_count() <= 2]
    groups = classes(ids, pairs)
    got = simhash.op6(spark, sf).collect()
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in got} == {(i, f"{want[i]:016x}", groups[i]) for i in ids}
    assert len(got) == len(ids) and pairs


def test_edge_rows(spark):
    long = " ".join(f"w{i}" for i in range(250_000))
    rows = [(5, None, "x", "a", "b"), (3, "", None, None, None), (7, "One two", "x", "a", "b"), (8, "one TWO", "", "", ""), (8, "one TWO", "", "", ""), (9, long, "", "", ""), (None, "other words here now", "", "", "")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = simhash.near_duplicates(df)
    by = {}
    for r in got.collect():
        by.setdefault(r.doc_id, []).append(r)
    assert by[5][0].fp == 0 and by[3][0].component_id == by[5][0].component_id == 3
    assert len(by[8]) == 2 and {r.component_id for r in by[8] + by[7]} == {7}
    assert by[9][0].fp & (2**64 - 1) == plain(long) and by[None][0].component_id is None
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns and sorted((r.doc_id or -1) for r in kept.collect()) == [-1, 3, 7, 9]
    empty = df.limit(0)
    assert simhash.near_duplicates(empty).count() == 0 and simhash.keep_one(empty).count() == 0


def test_components_of_long_chains_and_stars(spark):
    r = random.Random(2)
    pairs = [(i, i + 1) for i in range(300)] + [(1000, 1001 + i) for i in range(200)] + [(r.randrange(2000, 2400), r.randrange(2000, 2400)) for _ in range(150)]
    got = components(spark.createDataFrame(pairs, "x long, y long"))
    want = classes({i for p in pairs for i in p}, pairs)
    rows = got.collect()
    assert {(x.node, x.component) for x in rows} == {(i, c) for i, c in want.items() if any(i in p and p[0] != p[1] for p in pairs)}
    assert len(rows) == len({x.node for x in rows})


def test_similar_texts_link_by_their_shingle_sets(spark):
    r = random.Random(6)
    vocabulary = [f"w{i}" for i in range(3000)]
    rows = []
    for k in range(60):
        words = [r.choice(vocabulary) for _ in range(r.randint(60, 400))]
        rows.append((len(rows), " ".join(words)))
        for changes in (1, 3, 8):
            other = list(words)
            for i in r.sample(range(len(words)), changes):
                other[i] = r.choice(vocabulary)
            rows.append((len(rows), " ".join(other)))
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, t in rows for w in [t.split()]}
    prints = {i: simhash.fingerprint(t.encode(), 5) for i, t in rows}
    close = [(a, b) for a, _ in rows for b in range(a + 1, len(rows)) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    bits = [(a, b) for a, _ in rows for b in range(a + 1, len(rows)) if (prints[a] ^ prints[b]).bit_count() <= 2]
    want = classes(sets, close + bits)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.doc_id: x.component_id for x in simhash.near_duplicates(df, 5, similarity=0.8).collect()}
    assert got == want and len(close) > 60 and want != classes(sets, bits)
    assert {x.doc_id for x in simhash.keep_one(df, 5, similarity=0.8).collect()} == set(want.values())


def test_rows_alike_leave_one_by_a_fixed_rule(spark):
    rows = [(1, "same words here", x, i) for i, x in enumerate("cabd")] + [(2, "same words here", "z", 9), (None, None, "q", 1), (None, None, "q", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n string, tie int")
    got = [sorted(map(str, simhash.keep_one(df.repartition(k)).collect())) for k in (1, 3, 7)]
    assert got[0] == got[1] == got[2] and len(got[0]) == 2


def test_what_grows_is_not_broadcast(spark):
    """A map's result counts as small as its input, so replicas and other tables of all rows would go through the driver."""
    prints = spark.range(2000).selectExpr("xxhash64(id) AS fp")
    docs = spark.createDataFrame([(i, f"a b c {i % 7}") for i in range(50)], "doc_id long, text string")
    for df in (simhash.links(prints, 2), simhash.near_duplicates(docs), simhash.keep_one(docs, 2, similarity=0.8), components(spark.range(1, 9).selectExpr("id AS a", "id - 1 AS b"))):
        df.collect()
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
