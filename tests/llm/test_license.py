import random

from corpuscle.llm import license as lic

P = lic.Params()


def brute(text):
    """Templates of which some run as long as their windows has enough shingles, on words."""
    words, out = lic.words_of(text.encode()), set()
    index = lic.Index(lic.TEMPLATES, P)
    own = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    for _, t, shingles, twords in index.templates:
        n = len(twords) - 4
        for i in range(len(own)):
            if len(shingles & set(own[i : i + n])) >= P.containment * len(shingles):
                out.add(t)
    return out


def prose(r, n):
    return " ".join(r.choice("stone river cloud green walk paper seven table light winter the of and".split()) for _ in range(n))


def test_against_brute_force():
    r = random.Random(1)
    texts = [""]
    for _ in range(150):
        notice = r.choice(lic.TEMPLATES)[1].split()
        for _ in range(r.choice((0, 0, 1, 2, len(notice) // 4))):
            notice[r.randrange(len(notice))] = "other"
        texts.append(prose(r, r.randint(0, 90)) + "\n" + " ".join(notice) + "\n" + prose(r, r.randint(0, 90)))
    got = lic.Index(lic.TEMPLATES, P).scan([t.encode() for t in texts])
    want = [brute(t) for t in texts]
    assert all(w <= {x[1] for x in g} for w, g in zip(want, got, strict=True)) and sum(map(len, want)) > 60
    # Windows are up to twice as long as a template, so they may find a little more than runs of its length.
    assert sum(len(g) for g in got) <= sum(map(len, want)) * 1.05


def test_place_and_containment():
    (((name, _, share, first, n),),) = lic.Index([("X", "one two three four five six")], P).scan([b"a b c One, two! three four five six. d"])
    assert (name, share, first, n) == ("X", 1.0, 3, 6)


def test_every_template_is_retrieved_at_any_offset():
    index = lic.Index(lic.TEMPLATES, P)
    r = random.Random(2)
    for k in range(40):
        t = k % len(lic.TEMPLATES)
        text = prose(r, 30 + k) + " " + lic.TEMPLATES[t][1] + " " + prose(r, 77 - k)
        assert t in {x[1] for x in index.scan([text.encode()])[0]}


def test_query(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = lic.op4(spark, sf).collect()
    notice = "Licensed under the Apache License, Version 2.0."
    assert {i for i, t in docs.items() if notice in t} == {r.doc_id for r in rows if lic.TEMPLATES[r.template][1] == notice}
    got = {i: set() for i in docs}
    for r in rows:
        got[r.doc_id].add(r.template)
    for i, t in docs.items():
        assert brute(t) <= got[i]


def test_edge_rows(spark):
    notice = "Released under the MIT License."
    rows = [(1, None), (2, ""), (3, notice), (3, notice), (None, "x " + notice), (4, "word " * 200_000 + notice + " word" * 1000), (5, "Released under the MIT"), (6, "License. " + notice[:-9])]
    df = spark.createDataFrame([(*r, "a") for r in rows], "doc_id long, text string, license string")
    got = lic.scan(df).collect()
    assert sorted((r.doc_id or -1) for r in got) == [-1, 3, 3, 4] and {r.license for r in got} == {"MIT"}
    assert [r.first_word for r in got if r.doc_id == 4] == [200_000]
    assert lic.scan(df.limit(0)).count() == 0 and lic.scan(df, []).count() == 0


def test_huge_texts_go_in_runs(monkeypatch):
    r = random.Random(9)
    index = lic.Index(lic.TEMPLATES, P)
    text = (prose(r, 3000) + "\n" + lic.TEMPLATES[0][1] + "\n" + prose(r, 3000) + "\nReleased under the MIT License. " + prose(r, 100)).encode()
    want = index.scan([text])
    monkeypatch.setattr(lic, "_LONG", 1000)
    for size in (700, 5000):
        monkeypatch.setattr(lic, "text_runs", lambda t, size=size: __import__("corpuscle.llm.common", fromlist=["x"]).text_runs(t, size))
        assert index.scan([text]) == want and len(want[0]) == 2


def test_neighbours_do_not_matter():
    """A notice with words inserted is found, or not, alike behind any number of words and texts."""
    r = random.Random(4)
    index = lic.Index(lic.TEMPLATES, P)
    seen = 0
    for k in range(len(lic.TEMPLATES)):
        notice = lic.TEMPLATES[k][1].split()
        if len(notice) > 12:
            notice[len(notice) // 2 : len(notice) // 2] = ["inserted"] * r.randint(1, 3)
        text = (prose(r, 40) + " " + " ".join(notice) + " " + prose(r, 40)).encode()
        alone = index.scan([text])[0]
        seen += any(t == k for _, t, *_ in alone)
        for n in (1, 2, 3, 5, 9, 17, 33):
            assert index.scan([prose(r, n).encode(), text, b"the"])[1] == alone, (k, n)
    assert seen > len(lic.TEMPLATES) // 2
