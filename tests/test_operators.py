import json

import pytest
from pyspark.sql import functions as F

from corpuscle.operators import classify, collections, embed, mentions, parsing, quality, relational, resolve, retrieval
from corpuscle.sources import files, rest, sinks
from corpuscle.streaming import jobs

BOOK = """before
PROLOGUE
**Dawn**

It began.
CHAPTER
1
One

Text one.

more
CHAPTER
x
Odd
Text.
EPILOGUE\\
After
The end.
GLOSSARY
> **Term:** (ter-m) first
line
> **Other**: described
"""


def test_books(spark):
    df = spark.createDataFrame([("00-A.txt", BOOK), ("01-B.txt", "no marker")], "file_name string, text string")
    rows = parsing.parse_books(df).orderBy("section").collect()
    assert [(r.chapter_type, r.chapter_number, r.chapter_title) for r in rows] == [("prologue", 0, "Dawn"), ("chapter", 1, "One"), ("chapter", 0, "Odd"), ("epilogue", 2, "After")]
    assert [r.content for r in rows] == ["It began.", "Text one.\n\nmore", "Text.", "The end."]
    entries = parsing.parse_glossary(df).orderBy("entry").collect()
    assert [(r.term, r.pronunciation, r.description) for r in entries] == [("Term", "ter-m", "first line"), ("Other", None, "described")]


def test_markdown(spark):
    text = "# T\nlost\n### lost too\n<!-- c -->\n## A\na1\n---\n#### deep\n### B\nb\n## C\n"
    rows = parsing.parse_markdown(spark.createDataFrame([(1, text)], "k long, text string"), "k", "text")
    got = sorted(map(tuple, rows.collect()))
    assert got == [(1, 1, 0, "A", "a1\n#### deep"), (1, 1, 1, "B", "b"), (1, 2, 0, "C", "")]
    tree = parsing.section_tree(rows, "k").first().sections
    assert [(s.title, [x.title for x in s.subsections]) for s in tree] == [("A", ["B"]), ("C", [])]
    books = spark.createDataFrame([("A ", 3)], "book_title string, book_number int")
    assert {(r.title, r.type, r.temporal_order) for r in parsing.split_temporal(rows, books).collect()} == {("A", "temporal", 3), ("C", "non_temporal", None)}


def test_html(spark):
    page = "<div class='infobox'><p>hidden</p></div><p>Intro [x]</p><h2>One</h2><p>a&amp;b</p><ul><li>i</li></ul><h2>References</h2><p>still</p><h3>Sub</h3><dl><dt>t</dt></dl><script>var p='<p>no</p>'</script><p>x</p>"
    rows = parsing.parse_html(spark.createDataFrame([(1, page), (2, None), (3, "")], "k long, html string"), "k", "html").collect()
    assert {(r.k, r.title, r.content) for r in rows} == {(1, "Overview", "Intro"), (1, "One", "a&b\n\n- i\n\nstill\n\n### Sub\n\n**t**")}
    label = spark.createDataFrame([("Date of birth",), ("Hair color",), ("First appeared",), ("Weave",)], "l string").select(parsing.infobox_group("l").alias("g"))
    assert [r.g for r in label.collect()] == ["chronological", "physical", "chronological", "other"]


def test_mentions(spark):
    d = spark.createDataFrame([("c", "Sam Neil", ["Sam"], 0), ("c", "Other", ["sam"], 1), ("m", "o'x", None, 2), ("m", "a  b", [""], 3)], "dict_name string, canonical string, aliases array<string>, ord int")
    texts = [(1, "sam, Sam"), (2, "the sam neil is"), (3, "O'X a  b"), (4, None), (5, "\nsam\n"), (6, "")]
    df = spark.createDataFrame(texts, "k long, t string")
    want = {(1, "c", ("Other",)), (2, "c", ("Other", "Sam Neil")), (3, "m", ("a  b", "o'x"))}
    for options in ({}, {"mode": "ngram"}, {"mode": "contains"}, {"most": 0}):
        assert {(r.k, r.dict_name, tuple(r.mentions)) for r in mentions.tag(df, "k", "t", d, **options).collect()} == want
    words = mentions.tag(df, "k", "t", d, mode="regex").collect()
    assert {(r.k, tuple(r.mentions)) for r in words if r.dict_name == "c"} == {(1, ("Other",)), (2, ("Other", "Sam Neil")), (5, ("Other",))}
    topics = spark.createDataFrame([(1, "SAM NEIL"), (4, "none")], "k long, topic string")
    got = mentions.with_topic(mentions.tag(df, "k", "t", d), topics, "k", d).filter("k = 1").first()
    assert got.mentions == ["Other", "SAM NEIL"]


def test_candidates(spark):
    def names(term):
        return spark.range(1).select(resolve.glossary_candidates(F.lit(term)).alias("n")).first().n

    assert names("Creator, the")[:2] == ["The_Creator.txt", "Creator.txt"]
    assert names("Anna of House Marsh")[0] == "Anna.txt"
    assert names("o’Neil, Sam")[0] == "Sam_o'Neil.txt" and "Neil.txt" not in names("o’Neil, Sam")
    assert names("deep water") == ["deep_water.txt", "Deep_Water.txt", "deep water.txt"]
    terms = spark.createDataFrame([("deep water",), ("none",)], "t string")
    known = spark.createDataFrame([("Deep_Water.txt",), ("deep water.txt",)], "f string")
    found = resolve.first_match(terms, "t", resolve.glossary_candidates("t"), known, "f")
    assert {tuple(r) for r in found.collect()} == {("deep water", "Deep_Water.txt"), ("none", None)}


def test_resolution(spark):
    rows = spark.createDataFrame([("a", 1, 10), ("A", 2, 30), ("b", 3, 5)], "n string, o int, s int")
    assert {(r.n, r.file_name) for r in resolve.collision_names(rows, "n", "o").collect()} == {("a", "a"), ("A", "A_DUPLICATE_1"), ("b", "b")}
    names = ["a", "A", "a_DUPLICATE_1", "A", "b_DUPLICATE_2", "B", "b", "b", "b", "a_duplicate_03", "A", "B_DUPLICATE_2", "b_DUPLICATE_2_DUPLICATE_1"]
    clashing = spark.createDataFrame(list(enumerate(names)), "o int, n string")
    got = {r.o: r.file_name for r in resolve.collision_names(clashing, "n", "o").collect()}
    assert len({x.lower() for x in got.values()}) == len(names) and [got[i] for i in (1, 3, 10)] == ["A_DUPLICATE_2", "A_DUPLICATE_3", "A_DUPLICATE_4"]
    assert [got[i] for i in (6, 7, 8, 11)] == ["b_DUPLICATE_1", "b_DUPLICATE_3", "b_DUPLICATE_4", "B_DUPLICATE_2_DUPLICATE_2"]
    assert {r.n for r in resolve.keep_largest(rows, F.lower("n"), F.col("s"), "o").collect()} == {"A", "b"}
    one, two = (spark.createDataFrame([(k, v) for k in ks], "k string, v int") for ks, v in (("ab", 1), ("bc", 2)))
    assert {tuple(r) for r in sinks.later_wins(one, two, "k").collect()} == {("a", 1), ("b", 2), ("c", 2)}
    assert {tuple(r) for r in sinks.later_wins(one, two, "k", overwrite=False).collect()} == {("a", 1), ("b", 1), ("c", 2)}


def test_classification(spark):
    df = spark.createDataFrame([(1, []), (2, ["Men"]), (3, ["x", "BLOCKED"]), (4, ["Men", "prophecies"]), (5, ["x"])], "k long, c array<string>")
    kind = classify.page_type(F.col("c"), [("PROPHECY", ["Prophecies"]), ("CHARACTER", ["men", "women"])], ["blocked"])
    assert [r.t for r in df.select(kind.alias("t")).collect()] == ["SKIP", "CHARACTER", "SKIP", "PROPHECY", "CONCEPT"]
    tax = spark.createDataFrame([("place", "cities_of", 1), ("item", "men", 2)], "group string, category string, group_priority int")
    cats = spark.createDataFrame([(1, ["Cities of X", "Women"]), (2, ["Men"]), (3, ["Men", "Stub"]), (4, ["y"])], "k long, c array<string>")
    found = classify.by_taxonomy(cats, "k", F.col("c"), tax, exclude=["STUB"])
    assert {tuple(r) for r in found.collect()} == {(1, "place"), (2, "item"), (3, None), (4, None)}
    assert cats.select(classify.attributes(F.col("c"), {"Men": "male", "Women": "female"}).alias("a")).first().a == ["female"]


def test_retrieval_modes_agree_when_the_bound_does_not_bind(spark):
    df = spark.createDataFrame([(i, [float(i), 1.0], i % 5 if i else None) for i in range(60)], "k long, embedding array<double>, o int")
    a, b = (retrieval.knn_bounded(df, [9.2, 1.0], 7, "k", "o", 99, m).select("k").collect() for m in ("pre", "post"))
    assert a == b and [r.k for r in a][:3] == [9, 10, 8]
    few = retrieval.knn_bounded(df, [9.2, 1.0], 7, "k", "o", 0, "post").count()
    assert few < 7 == retrieval.knn_bounded(df, [9.2, 1.0], 7, "k", "o", 0).count()
    docs = spark.createDataFrame([(1, "the Cat sat"), (2, "cat cat"), (3, "dog")], "k long, text string")
    assert [(r.k, r.score) for r in retrieval.keyword_search(docs, "cat CAT the", 5, "k").collect()] == [(1, 3), (2, 2)]


def test_quality(spark):
    df = spark.createDataFrame([(v,) for v in (5, 1, 9, 7)], "v int")
    assert quality.upper_median(df, F.col("v")).first().median == 7
    assert {tuple(r) for r in quality.histogram(df, F.col("v"), [0, 5, 9]).collect()} == {(0, 1), (1, 2), (2, 1)}
    seq = spark.createDataFrame([(1, 1), (1, 2), (2, 2), (3, 1), (3, 1)], "k int, n int")
    assert {tuple(r) for r in quality.sequential(seq, "k", "n").collect()} == {(1, 2, True, False), (2, 1, False, False), (3, 2, False, True)}
    bad = spark.createDataFrame([(None,), (3,)], "v int").select(quality.issues([("null", F.col("v") > 0)]).alias("i"))
    assert [r.i for r in bad.collect()] == [["null"], []]


def test_collections(spark, tmp_path):
    df = spark.createDataFrame([(1, ["a", None], True, None)], "id long, l array<string>, b boolean, n int")
    assert tuple(collections.flatten_metadata(df, "id").first()) == (1, "a,None", "True", "null")
    both = collections.union({"a": df.select("id"), "b": df.select("id", "n")}, "id")
    assert {tuple(r) for r in both.collect()} == {("a_1", None), ("b_1", None)}
    collections.write(both.withColumn("collection", F.lit("c")), str(tmp_path / "c"))
    assert spark.read.parquet(str(tmp_path / "c")).filter("collection = 'c'").count() == 2


def test_embedding_and_resume(spark):
    df = spark.createDataFrame([(i, f"text {i % 2}") for i in range(7)] + [(9, None)], "k long, t string")
    rows = {r.k: r.embedding for r in embed.embed(df, "k", "t", batch=2).collect()}
    assert len(rows) == 8 and rows[0] == rows[2] != rows[1] and len(rows[0]) == 64 and not any(rows[9])
    assert embed.embed_missing(df, df.filter("k < 5"), "k", "t").count() == 3


def test_joins(spark):
    left = spark.createDataFrame([(1, "a", 5), (2, "a", 7), (3, "b", 1)], "id int, k string, at int")
    right = spark.createDataFrame([(10, "a", 5), (11, "a", 6)], "id int, k string, at int")
    assert {(r.id, r.before_id) for r in relational.asof(left, right, "k", "at", "id").collect()} == {(1, None), (2, 11), (3, None)}


def test_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name, text in (("07-A.txt", "x\ny"), ("7-B.txt", "z"), ("sub/8-C.txt", "é"), ("n.json", json.dumps({"p": {"v": 1}, "q": {"v": 2}}))):
        (tmp_path / name).write_text(text, encoding="utf-8")
    (tmp_path / "l.jsonl").write_text('{"a": 1}\nbroken\n')
    path = str(tmp_path)
    books = files.whole_texts(spark, path)
    assert {tuple(r) for r in books.collect()} == {("07-A.txt", "x\ny"), ("7-B.txt", "z")}
    assert files.whole_texts(spark, path, recursive=True).count() == 3 and files.book_by_number(books, 7).first().file_name == "07-A.txt"
    assert {(r.file_name, r.size) for r in files.listing(spark, path, "*.txt").collect()} == {("07-A.txt", 3), ("7-B.txt", 1)}
    assert {(r.key, r.value.v) for r in files.json_map(spark, path, "struct<v:int>").collect()} == {("p", 1), ("q", 2)}
    assert {(r.a, r._corrupt) for r in files.json_lines(spark, str(tmp_path / "l.jsonl"), "a int").collect()} == {(1, None), (None, "broken")}
    assert files.json_document(spark, str(tmp_path / "n.json"), "p struct<v:int>").first().p.v == 1


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("b", 1, None), ("a", 2, "é")], "k string, v int, s string")
    sinks.json_lines(df, str(tmp_path / "j"))
    sinks.table(df, str(tmp_path / "t"), "k")
    assert spark.read.schema(df.schema).json(str(tmp_path / "j")).count() == 2 and spark.read.parquet(str(tmp_path / "t")).filter("k = 'a'").count() == 1
    assert json.loads(sinks.one_document(df, "k").first().document)["a"] == {"v": 2, "s": "é"}
    good, bad = sinks.quarantine(df, F.col("s") == "é")
    assert good.count() == 1 == bad.count()
    assert tuple(sinks.metrics_table(df, "k", "s", "v", ["é"]).orderBy("k").first()) == ("a", 2)
    assert "# T" in spark.range(1).select(sinks.stub(F.lit("T"), F.lit(None).cast("string"), F.array(F.lit("x"))).alias("s")).first().s


def test_listings(spark):
    def fetch(token):
        start = int(token or 0)
        return [(start, f"p{start}"), (start + 1, f"p{start + 1}")], str(start + 2) if start < 4 else None

    rest.register(spark, "titles", "id int, title string", fetch)
    assert sorted(r.id for r in spark.read.format("titles").load().collect()) == list(range(6))

    def failing(token):
        if token:
            raise OSError
        return [(1,)], "next"

    assert list(rest.pages(failing)) == [(1,)]
    with pytest.raises(ValueError):
        list(rest.pages(lambda _: ([], None)))


def test_streams_resume(spark, tmp_path):
    source, out, state = (str(tmp_path / d) for d in ("in", "out", "state"))
    upper = lambda df: df.select("k", F.upper("t").alias("t"))
    for k in (1, 2):
        spark.createDataFrame([(k, f"a{k}")], "k int, t string").write.mode("append").parquet(source)
        jobs.resumable(spark, source, "k int, t string", upper, out, state)
        assert spark.read.parquet(out).count() == k


def test_windows_over_a_stream(spark, tmp_path):
    path = str(tmp_path / "e")
    rows = spark.sql("SELECT timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,id * 10,0) AS ts, id % 2 AS user_id, 'x' AS event_type, 1.0D AS value FROM range(30)")
    rows.write.parquet(path)
    stream = jobs.tumbling(spark.readStream.schema(rows.schema).parquet(path), "1 hour")
    q = stream.writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("w").agg(F.sum("n")).first()[0] == 30 and jobs.tumbling(rows, "1 hour").count() == spark.table("w").count()
    assert jobs.sessions(rows, "15 minutes").count() == 30 and jobs.sessions(rows, "25 minutes").count() == 2


def test_redirects_and_keywords(spark):
    df = spark.createDataFrame([(1, []), (2, ["Moved"]), (3, ["a_b c", None]), (4, None), (5, ["x", ""])], "k int, c array<string>")
    got = df.select("k", classify.is_redirect(F.col("c"), ["MOVED"]).alias("r"), classify.page_type(F.col("c"), [("T", ["x"])], [], redirects=["moved"]).alias("t")).collect()
    assert [(r.k, r.r, r.t) for r in got] == [(1, True, "SKIP"), (2, True, "SKIP"), (3, False, "CONCEPT"), (4, True, "SKIP"), (5, False, "T")]
    tax = spark.createDataFrame([("one", "B C", 3), ("two", "x", 2), ("all", "", 9), ("short", "b ", 1)], "group string, category string, group_priority int")
    rows = {r.k: r.group for r in classify.by_taxonomy(df, "k", F.col("c"), tax).collect()}
    assert rows == {1: None, 2: "all", 3: "short", 4: None, 5: "two"}


def test_taxonomy_decides_each_category_once(spark):
    """Rows of equal categories share the work: the parts of a category are listed before rows join."""
    df = spark.range(3000).select(F.col("id").alias("k"), F.array(F.concat(F.lit("Gold_"), (F.col("id") % 3).cast("string"))).alias("c"))
    tax = spark.createDataFrame([("metal", "gold", 2), ("one", "1", 1)], "group string, category string, group_priority int")
    out = classify.by_taxonomy(df, "k", F.col("c"), tax)
    assert {r.group: r["count"] for r in out.groupBy("group").count().collect()} == {"metal": 2000, "one": 1000}
    lines = out._jdf.queryExecution().optimizedPlan().toString().splitlines()
    listed = next(k for k, x in enumerate(lines) if "Generate explode(array_distinct" in x)
    assert any("Aggregate [__cat" in x for x in lines[listed:])
