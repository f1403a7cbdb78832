import pytest
from pyspark.sql import functions as F

import numpy as np
from corpuscle.operators import chunking, collections, embed, indexes, reports, retrieval
from corpuscle.plans import all_queries
from corpuscle.sources import rest


def test_inverted_file_recall(spark, sf):
    at = sf.replace("sf0.001", "sf0.1")
    rows = {r.vec_id: np.array(r.embedding, float) for r in spark.read.parquet(f"{at}/embeddings.parquet").collect()}
    got = {}
    for r in all_queries()["ann_neighbours"](spark, at).collect():
        got.setdefault(r["query"], set()).add(r.vec_id)
    ids = sorted(rows)
    x = np.array([rows[i] for i in ids])
    want = {i: {ids[k] for k in np.lexsort((ids, np.round(((x - rows[i]) ** 2).sum(1), 6)))[:10]} for i in ids if i % 100 == 0}
    assert set(got) == set(want) and all(len(v) == 10 for v in got.values())
    assert sum(len(got[i] & want[i]) for i in want) >= 0.9 * 10 * len(want)


def test_inverted_file_without_rows(spark):
    df = spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>")
    centres = retrieval.ivf_fit(df)
    assert centres.size == 0 and retrieval.ivf_search(retrieval.ivf_assign(df, centres, "vec_id"), df, centres, 3, "vec_id").count() == 0


def test_auto_search_goes_to_the_route(spark, sf):
    rows = all_queries()["auto_search"](spark, sf).collect()
    assert 0 < len(rows) <= 5 and {r.collection for r in rows} == {"de"}
    assert [r.boosted_score for r in rows] == sorted((r.boosted_score for r in rows), reverse=True)


def test_collections_refuse_repeated_ids_and_reopen(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "collection string, id int")
    assert collections.write(df, str(tmp_path / "c"), key="id") == {"a": 2, "b": 1} == collections.reopened(spark, str(tmp_path / "c"))
    with pytest.raises(ValueError, match="repeats"):
        collections.write(df.union(df.limit(1)), str(tmp_path / "d"), key="id")
    assert collections.with_metadata(df.withColumn("text", F.lit("t")), "text", "id").columns == ["id", "text", "metadata"]


def test_strict_statistics(spark):
    df = spark.createDataFrame([("x" * 9,), ("y",)], "text string")
    assert chunking.chunk_statistics(df, limit=9, strict=True).first().max_chars == 9
    with pytest.raises(Exception, match="over 8"):
        chunking.chunk_statistics(df, limit=8, strict=True).collect()


def test_probe():
    assert embed.probe(embed.hash_embedder)[0]
    assert embed.probe(lambda texts: [])[0] is False

    def broken(texts):
        raise OSError("no server")

    assert embed.probe(broken) == (False, "OSError: no server")


def test_scrape_accounts_for_every_title(spark):
    def fetch(title):
        if title == "Gone":
            return None
        if title == "Bad":
            raise OSError("down")
        return f"<p>{title}</p>", f"<!-- Categories: {'Actor' if title == 'No' else 'Men'} -->"

    from corpuscle.functions.text import categories

    titles = spark.createDataFrame([(t,) for t in ("A", "a", "Gone", "Bad", "No", "Old one", "A")], "title string")
    existing = spark.createDataFrame([("Old_one.txt",)], "file_name string")
    got = {r.title: (r.file_name, r.status) for r in rest.scrape(titles, "title", existing, fetch, ["actor"], categories).collect()}
    assert got == {"A": ("A.txt", "saved"), "a": ("a_DUPLICATE_1.txt", "saved"), "Gone": (None, "missing"), "Bad": (None, "error"), "No": (None, "blocked"), "Old one": ("Old_one.txt", "exists")}


def test_stubs_say_what_is_left_out(spark):
    terms = spark.createDataFrame([("a b",), ("c",), ("d",)], "term string")
    glossary = spark.createDataFrame([("a b", "x"), ("c", "y")], "term string, definition string")
    pages, left = indexes.stubs(terms, glossary, spark.createDataFrame([("c.txt",)], "file_name string"), ["g"])
    assert [r.file_name for r in pages.collect()] == ["a_b.txt"] and {tuple(r) for r in left.collect()} == {("c", "file exists"), ("d", "not in glossary")}
    several = spark.createDataFrame([("d", "late", 3), ("d", "early", 1), ("d", None, 0)], "term string, definition string, book int")
    pages, _ = indexes.stubs(terms.filter("term = 'd'"), several, spark.createDataFrame([], "file_name string"), ["g"], ("book",))
    assert [r.text.rsplit("\n", 1)[1] for r in pages.collect()] == ["early"]


def test_reports(spark):
    df = spark.createDataFrame([("b", 2), ("a", None)], "k string, n int")
    assert reports.render(df, "Title") == "Title\n=====\nk: a  n: -\nk: b  n: 2\n"
    with pytest.raises(ValueError, match="at most"):
        reports.render(df, "Title", 1)
