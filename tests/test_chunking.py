import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpuscle.config import Config
from corpuscle.functions import text as T
from corpuscle.operators import chunking


def packed(spark, text, limit):
    return spark.createDataFrame([(text,)], "text string").select(chunking.pack_text("text", limit).alias("c")).first().c


def test_budget_edges(spark):
    assert packed(spark, "", 10) == []
    assert packed(spark, "  \n ", 10) == [""]
    assert packed(spark, "x" * 10, 10) == ["x" * 10]
    assert packed(spark, "aaaa\n\nbbbb\n\ncc", 10) == ["aaaa\n\nbbbb", "cc"]
    assert packed(spark, "aa\n \n\nbb" + " " * 10, 10) == ["aa\n\nbb"]


def test_long_paragraphs_go_by_sentences_and_cuts(spark):
    assert packed(spark, "One. Two. Three is long.\n\nEnd", 12) == ["One. Two.", "Three is lon", "g.", "End"]
    assert packed(spark, "é" * 25, 10) == ["é" * 10, "é" * 10, "é" * 5]


@settings(max_examples=200, deadline=None)
@given(st.text("ab. !?\n", max_size=400), st.integers(5, 60))
def test_overlapping_windows_end_and_lose_nothing(text, target):
    out = chunking.split_overlapping(text, target, target + 20, target // 4)
    assert all(len(c) <= max(target + 200, target + 20) for c in out)
    assert all("".join(out).count(c) >= text.count(c) for c in "ab.!?")


def test_overlap_appears(spark):
    text = " ".join(f"Sentence number {i} here." for i in range(60))
    df = spark.createDataFrame([(1, text), (2, None), (3, "")], "k long, text string")
    rows = chunking.overlap_chunks(df, "k", "text", Config(chunk_target=200, chunk_max=260, chunk_overlap=50)).orderBy("k", "chunk_index").collect()
    own = [r.text for r in rows if r.k == 1]
    assert len(own) >= 5 and any(a[-20:] in b for a, b in zip(own, own[1:])) and [r.text for r in rows if r.k > 1] == ["", ""]


def test_sections_keep_titles(spark):
    s = "array<struct<title:string,text:string>>"
    df = spark.createDataFrame([([("A", "aaaa"), ("B", "bbb"), ("C", "c. " * 9), ("D", "d")],)], f"s {s}")
    got = df.select(chunking.pack_sections(F.col("s"), 10).alias("c")).first().c
    assert [(r.titles, r.text) for r in got][0] == ("A, B", "aaaa\n\nbbb") and got[-1].titles == "D" and {r.titles for r in got[1:-1]} == {"C"}


def test_numbering(spark):
    df = spark.createDataFrame([(1, ["a", "b"]), (2, []), (3, None)], "k long, c array<string>")
    assert sorted(map(tuple, chunking.number_chunks(df, F.col("c"), "k").collect())) == [(1, 1, 2, "a"), (1, 2, 2, "b")]


@pytest.mark.parametrize(
    ("f", "given_", "want"),
    [
        (T.strip, " \t x y\n", "x y"), (T.word_count, "  a  b\n", 2), (T.word_count, "", 0), (T.token_estimate, "abcdefghi", 2),
        (T.straight_apostrophes, "a’b‘c`d", "a'b'c'd"), (T.safe_filename, 'a b/c<>:"|?*', "a_b_c"), (T.book_number, "07-Title.txt", 7),
        (T.book_title, "07-The txt.txt", "The txt"), (T.first_h1, "x\n## no\n# Yes \n", "Yes"), (T.first_h1, "none", None),
        (T.page_id, "<!-- Page ID: 42 -->", 42), (T.page_id, "no", None), (T.categories, "<!-- Categories: b, a,, b -->", ["a", "b"]),
        (T.categories, "none", []), (T.chapter_number, "x_chapter_12.txt", 12), (T.clean_markup, "'''a''' [[b|c]] {{t}} <i>d</i> [[e]]", "a c <i>d</i> e"),
        (T.clean_citations, "a[1] [citation needed] b .", "a b."), (T.clean_citations, "[1]a", None),
        (T.without_stop_words, "What is the deep Water", "deep water"), (T.without_stop_words, "what is", "what is"), (T.paragraphs, "a\n\n \nb", ["a", "b"]),
        (T.sentences, "A b. C! D", ["A b.", "C!", "D"]),
    ],
)
def test_scalars(spark, f, given_, want):
    assert spark.createDataFrame([(given_,)], "x string").select(f("x").alias("y")).first().y == want


def test_more_scalars(spark):
    row = spark.createDataFrame([("ab.cd.txt",)], "x string").select(
        T.strip_suffix("x", ".txt").alias("a"), T.last_before(F.col("x"), ".").alias("b"), T.pieces("x", 4).alias("c"),
        T.chunk_id(F.lit(1), F.lit(2), F.lit(3)).alias("d"), T.query_terms("x", 20).alias("e"), T.page_name(F.col("x"), F.col("x")).alias("f"),
    ).first()
    assert tuple(row) == ("ab.cd", 6, ["ab.c", "d.tx", "t"], "book_01_ch_02_chunk_003", [], "ab.cd")


def test_config():
    assert Config.from_env({"CHUNK_TARGET": "9"}).chunk_target == 9 and Config.from_env({}) == Config()


def test_long_turns_are_packed_too(spark, tmp_path):
    from corpuscle.plans import all_queries

    long = " ".join(f"Sentence {i} of a long turn." for i in range(120))
    rows = [(1, 0, "user", "short"), (1, 1, "bot", long), (1, 2, "user", "end"), (2, 0, "bot", long)]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = sorted(map(tuple, all_queries()["section_pack"](spark, str(tmp_path)).collect()))
    assert all(len(text) <= 1200 for *_, text in got) and [c for c, *_ in got].count(2) > 2
    own = {c: [(titles, text) for k, _, titles, text in got if k == c] for c in (1, 2)}
    assert own[1][0] == ("user", "short") and own[1][-1] == ("user", "end")
    assert " ".join(t for _, t in own[1][1:-1]) == " ".join(t for _, t in own[2]) == long and {t for t, _ in own[2]} == {"bot"}


def test_batches_are_halved_to_bounded_bytes():
    import pyarrow as pa

    from corpuscle.operators import batches

    batch = pa.RecordBatch.from_pydict({"k": list(range(40)), "t": ["x" * (5000 if k == 7 else 50) for k in range(40)], "c": [["y" * 9] * 3 for _ in range(40)]})
    found = list(batches.parts(iter([batch, batch.slice(0, 0)]), 1000))
    assert pa.Table.from_batches(found).to_pylist() == batch.to_pylist()
    assert all(p.num_rows == 1 or p.nbytes <= 1000 for p in found) and len(found) > 5
