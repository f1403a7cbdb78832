import random

import numpy as np
from corpuscle.llm import decontaminate as d

P = d.Params()


def distance_in(pattern, text):
    """Least edits from the pattern to any stretch of the text."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(pattern, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != t), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def edited(text, n, r):
    s = list(text)
    for _ in range(n):
        k = r.randrange(len(s))
        kind = r.randrange(3)
        if kind == 0:
            s[k] = r.choice("abcxyz")
        elif kind == 1:
            del s[k]
        else:
            s.insert(k, r.choice("abcxyz"))
    return "".join(s)


def prose(r, n):
    return " ".join("".join(r.choice(("the", "re", "on", "st", "ing", "ble", "ti", "and")) for _ in range(r.randint(1, 3))) for _ in range(n))


def plain(text):
    return " ".join("".join(c if c.isalnum() and ord(c) < 0x30000 else " " for c in text or "").split()).lower()


def brute(docs, items):
    """Every stretch of 96 characters of an item, or the whole of a shorter one, within a tenth of edits of some stretch."""
    out = set()
    for i, text in docs:
        own = plain(text)
        for item, passage in items:
            x = plain(passage)
            if len(x) >= 8 and any(y in own or distance_in(y, own) <= min(len(y) // 10, len(y) // 8 - 1) for y in (x[s : s + 96] for s in range(max(1, len(x) - 95)))):
                out.add((i, item))
    return out


def test_folding():
    for text in ("", " ", " !\n ", "  A  b-C!! ", "x", "É  ß ", " ٣", "\U00030001 a"):
        want = " ".join("".join(c if c.isalnum() and ord(c) < 0x30000 else " " for c in text).split()).lower()
        assert "".join(map(chr, d.fold(text))) == want
        at = d.places(text)
        assert len(at) == len(want) and all(text[k].lower() == w or w == " " for k, w in zip(at, want, strict=True))


def test_lemma_bound_is_positive():
    for m in range(P.q, P.pattern + 1):
        assert P.edits(m) >= 0 and P.bound(m) >= 1


def test_against_brute_force():
    r = random.Random(3)
    items = [(k, prose(r, r.choice((3, 12, 25, 40)))) for k in range(10)]
    docs = []
    for i in range(50):
        text = prose(r, r.randint(0, 40))
        if i % 2:
            passage = r.choice(items)[1]
            text += " " + edited(passage, int(len(passage) * r.choice((0, 0.05, 0.09, 0.12, 0.2))), r).upper() + " " + prose(r, 20)
        docs.append((i, text))
    index = d.Index(items, P)
    got = {(i, m[0]) for (i, _), own in zip(docs, index.search([t for _, t in docs]), strict=True) for m in own}
    assert got == brute(docs, items) and len(got) > 12


def test_offsets_and_small_segments():
    r = random.Random(4)
    item = prose(r, 40)
    text = prose(r, 300) + "\n\n" + item.replace(" ", "  ") + "!\n" + prose(r, 300)
    for p in (P, d.Params(segment=500, hits=60)):
        ((found, n, edits, begin, end),) = d.Index([(7, item)], p).search(["", text, prose(r, 50)])[1]
        assert found == 7 and edits == 0 and text[begin:end].split() == item.split()
    assert d.Index([], P).search(["x"]) == [[]]


def test_grams_are_equal_only_for_equal_text():
    a = np.array([ord(c) for c in "abcdefghabcdefgh"], np.uint32)
    for q in (1, 5, 8):
        h = d.grams(a, q)
        assert len(h) == 17 - q and h[0] == h[8] and len(set(h.tolist())) == min(8, len(h))


def test_query_finds_every_contained_item(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    items = {r.item_id: r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    got = {(r.doc_id, r.item_id) for r in d.op7(spark, sf).collect()}
    inside = {(i, k) for i, t in docs.items() for k, x in items.items() if x in t}
    assert inside and inside <= got
    kept = d.keep_clean(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet"))
    assert {r.doc_id for r in kept.select("doc_id").collect()} == set(docs) - {i for i, _ in got}


def test_edge_rows(spark):
    item = "This exact benchmark passage, with its own words, must not be in any training text at all."
    docs = [(1, None), (2, ""), (3, item.upper()), (3, item.upper()), (None, "x " + item), (4, "word " * 300_000 + item + " word" * 1000), (5, "clean text " * 20)]
    df = spark.createDataFrame([(*r, "a", 1) for r in docs], "doc_id long, text string, item_id string, begin int")
    bench = spark.createDataFrame([(1, item, "x"), (1, item, "x"), (2, None, "x"), (3, "", "x"), (4, "short", "x"), (None, "clean", "x")], "item_id long, text string, edits string")
    got = d.matches(df, bench).collect()
    assert sorted((r.doc_id or -1) for r in got) == [-1, 3, 3, 4] and {r.item_id for r in got} == {1}
    kept = d.keep_clean(df, bench)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2, 5]
    assert d.keep_clean(df, bench, d.Params(block_chars=100)).count() == 3
    assert d.matches(df.limit(0), bench).count() == 0 and d.matches(df, bench.limit(0)).count() == 0


def test_excerpts_of_a_pattern_from_every_place():
    r = random.Random(7)
    item = prose(r, 60)
    own = "".join(map(chr, d.fold(item)))
    index = d.Index([(1, item)], P)
    for s in range(0, len(own) - P.pattern + 1):
        exact = own[s : s + P.pattern].strip()
        if len(exact) == P.pattern:
            assert index.search([f"zq {exact} xv"])[0], s
    texts = [f"zq {edited(own[s : s + 110], 9, r)} xv" for s in range(0, len(own) - 110, 3)]
    for text, found in zip(texts, index.search(texts), strict=True):
        want = any(distance_in(own[s : s + P.pattern], text) <= 9 for s in range(len(own) - P.pattern + 1))
        assert bool(found) == want


def test_dense_texts_and_thousands_of_equal_items():
    r = random.Random(11)
    shared = prose(r, 40)
    items = [(k, shared) for k in range(3000)] + [(3000 + k, shared[:110] + " " + prose(r, 25)) for k in range(300)]
    near = edited(shared, 12, r)
    texts = [prose(r, 50) + " " + near + " " + prose(r, 50), "na " * 4000 + near + " na" * 4000, prose(r, 400)]
    p = d.Params(hits=5000)
    index, want = d.Index([items[0]], P), d.Index([(0, "na " * 60)], P)
    assert len(d.Index(items[:3000], p).groups) == len(index.groups)
    got = d.Index(items, p).search(texts)
    for found, alone in zip(got, index.search(texts), strict=True):
        assert bool(alone) == ({x[0] for x in found} >= set(range(3000)))
    assert got[0] and got[1] and not got[2]
    dense = d.Index([(0, "na " * 60)], d.Params(hits=100))
    assert dense.search(texts) == want.search(texts) and dense.search(texts)[1]


def test_long_texts_go_in_runs():
    r, run = random.Random(12), d.RUN
    item = prose(r, 40)
    try:
        d.RUN = 3000
        for k in range(0, 3200, 97):
            text = ("zu " * 3000)[: 2000 + k] + item + " zu" * 3000 + "  " * 9000 + item.upper() + "!"
            ((_, n, edits, begin, end),) = d.Index([(5, item)], P).search(["x", text])[1]
            assert edits == 0 and text[begin:].lower().startswith(item) and end == len(text) - 1
    finally:
        d.RUN = run


def test_no_passage_spans_two_documents():
    r = random.Random(13)
    item = prose(r, 40)
    own = "".join(map(chr, d.fold(item)))
    index = d.Index([(1, own[:96])], P)
    assert index.search([own[:96]])[0]
    for cut in (20, 48, 70):
        assert index.search([own[:cut], own[cut:96], "x"]) == [[], [], []]


def test_the_text_goes_to_python_once(spark):
    from corpuscle.llm import decontaminate

    docs = spark.createDataFrame([(1, "some words"), (2, None)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a passage of the benchmark that is long enough")], "item_id long, text string")
    out = decontaminate.keep_clean(docs, items)
    assert sorted(map(tuple, out.collect())) == [(1, "some words"), (2, None)]
    assert "__cc_text" not in out._jdf.queryExecution().optimizedPlan().toString()
