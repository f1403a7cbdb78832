from pyspark.sql import functions as F

from corpuscle import schemas
from corpuscle.operators import pages, parsing

S = [
    (2, "Overview", "short", [(3, "Sub", "under")]),
    (2, "History", "long " * 20, []),
    (2, "Only parts", " ", [(3, "P", "part"), (3, "Q", "")]),
    (2, "Categories", "x", []),
]


def frame(spark):
    return spark.createDataFrame([(1, S), (2, [])], f"k long, sections {schemas.SECTIONS}")


def test_section_chunks(spark):
    rows = pages.chunk_sections(frame(spark), "k", limit=60).collect()
    assert [r.section_title for r in rows] == ["Overview", "History", "History", "Only parts"] or rows[0].section_title == "Overview"
    assert rows[0].text == "## Overview\nshort\n\n### Sub\nunder" and rows[-1].text == "## Only parts\n\n### P\npart\n\n### Q"
    assert all(len(r.text) <= 60 for r in rows) and {r.total_chunks for r in rows} == {len(rows)}
    whole = pages.chunk_sections(frame(spark), "k").collect()
    assert [(r.section_title, r.chunk_index, r.total_chunks) for r in whole] == [("Overview, History, Only parts", 1, 1)]


def test_other_page_types(spark):
    (row,) = pages.chunk_characters(frame(spark), "k").collect()
    assert "**P**\npart" in row.text and "under" not in row.text
    (row,) = pages.chunk_summaries(frame(spark), "k").collect()
    assert row.text.startswith("**Overview**\nshort\n\n**History**") and row.chunk_index == 1
    sections = parsing.parse_markdown(spark.createDataFrame([(1, "## A\nx\n## B\n\n## C\ny")], "k long, t string"), "k", "t")
    timed = parsing.split_temporal(sections, spark.createDataFrame([("C", 4)], "book_title string, book_number int"))
    assert {(r.title, r.temporal_order, r.text) for r in pages.chunk_chronology(timed, "k").collect()} == {("A", None, "x"), ("C", 4, "y")}
    chapters = spark.createDataFrame([(1, 2, "a\n\nb"), (1, 3, "")], "book_number int, chapter_number int, content string")
    assert [(r.chunk_id, r.text) for r in pages.chunk_chapters(chapters).collect()] == [("book_01_ch_02_chunk_001", "a\n\nb")]


def test_attributes(spark):
    df = frame(spark).select("k", pages.overview("sections").alias("o"), pages.dependent(F.col("k") == 1, F.lit("m"), {"m": "one"}).alias("d"))
    assert sorted(map(tuple, df.collect())) == [(1, "short", "one"), (2, "", None)]
    books = spark.createDataFrame([("The Eye", 1, ["Eye"]), ("Hunt", 2, [])], "book_title string, book_number int, variants array<string>")
    cats = spark.createDataFrame([(1, ["the_eye chapter summaries", "Hunt Chapter Summaries"]), (2, ["x"])], "k long, c array<string>")
    assert {tuple(r) for r in pages.book_by_category(cats, "k", "c", books).collect()} == {(1, 2), (2, None)}
    titles = spark.createDataFrame([("The Eye",), ("Eye",), ("EYE",), ("none",)], "t string")
    assert {tuple(r) for r in pages.book_by_title(titles, "t", books).collect()} == {("The Eye", 1), ("Eye", 1), ("EYE", 1), ("none", -1)}
    text = spark.createDataFrame([("## In The Eye\nx\n## Out\n## In Hunt ",)], "t string").select(pages.temporal_titles("t").alias("x")).first().x
    assert text == ["The Eye", "Hunt"]
    assert [pages.format_metric(*a) for a in ((12.34, "percent"), (3661, "seconds"), (61, "seconds"), (2048, "bytes"), (1234, "n"))] == ["12.3%", "1h 1m 1s", "1m 1.0s", "2.0 KB", "1,234"]


def test_paragraphs_are_whole(spark):
    html = '<p>One <b>two</b> three</p><p class="x"><i>four</i> &amp; &#39;five&#39; &#x41;&lt;b&gt;</p><pre>no</pre><P>six<p> </p><p>seven<!-- <p>no --> &amp;lt;'
    (row,) = spark.createDataFrame([(html,)], "h string").select(parsing.paragraphs_of_html("h").alias("p")).collect()
    assert row.p == ["One two three", "four & 'five' A<b>", "six", "seven &lt;"]


def test_sections_are_children_of_the_root(spark):
    pages_ = [
        (1, "<h2>A</h2><p>one</p><img class='infobox-image'><p>two</p>"),
        (2, "<div class='navbox'><div>in</div><p>hidden</p></div><p>shown</p><div><p>no child</p></div>"),
        (3, "<table class='wikitable'><tr><td><p>cell<table></table></table><h2>B</h2><ul><li>a<br>b<ul><li>c</li></ul>d</li><p>x</p></ul>"),
        (4, "<body><nav><p>x</p></nav><p>word<b>bold</b> x<p>y</p></p><h2>References</h2><p>[1] kept [ note ] .</p></body>"),
        (5, None),
        (6, "<body>x<div class='a mw-parser-output'><h2><span class='mw-headline'>T</span><span>edit</span></h2><h3>Sub</h3><dl><dt>t<dd>d</dd></dt><dd></dd></dl><script>s</script><p>ab</p></div></body>"),
        (7, "<h2>A</h2><p>first</p><h2>B</h2><p>bbb</p><h2>A</h2><p>later</p><h2>A</h2>"),
        (8, "<p>in <style>p{}</style>a<!-- no --> &amp; b</p></div><p>" + "<i>" * 3000 + "deep"),
    ]
    df = spark.createDataFrame(pages_, "k int, html string")
    got = sorted(map(tuple, parsing.parse_html(df, "k", "html").collect()))
    assert got == [
        (1, "A", "one\n\ntwo"), (2, "Overview", "shown"), (3, "B", "- a b c d"), (4, "Overview", "word bold x y\n\nkept."),
        (6, "T edit", "### Sub\n\n**t d**"), (7, "A", "later"), (7, "B", "bbb"), (8, "Overview", "in a & b\n\ndeep"),
    ]
    strict = sorted(map(tuple, parsing.parse_html(df.filter("k in (1, 6)"), "k", "html", "mw-headline").collect()))
    assert strict == [(1, "Overview", "one\n\ntwo"), (6, "T", "**t d**")]


def test_infobox_of_a_table_and_of_nothing(spark):
    table = "<table class='infobox'><tr><td><div class='pi-data'><h3 class='pi-data-label'> Hair </h3><div class='pi-data-value'>red<br>long</div></div></td></tr></table>"
    rows = [(1, table), (2, "<p>none</p>"), (3, None), (4, "<aside class='portable-infobox'><div class='pi-data'><h3 class='pi-data-label'>Rank</h3><div class='pi-data-value'>one</div>")]
    got = sorted(map(tuple, parsing.infobox(spark.createDataFrame(rows, "k int, html string"), "k", "html").collect()))
    assert got == [(1, "physical", "Hair", "red long")]


def test_markdown_with_an_infobox(spark):
    df = spark.createDataFrame([(1,)], "k int")
    box = F.array(F.struct(F.lit("physical").alias("label_group"), F.lit("Hair").alias("label"), F.lit("red").alias("value")))
    sub = F.array(F.struct(F.lit("T").alias("title"), F.lit("t").alias("content")))
    sections = F.array(F.struct(F.lit("S").alias("title"), F.lit("s").alias("content"), sub.alias("subsections")))
    text = df.select(parsing.page_markdown(F.lit("N"), F.lit(7), F.array(F.lit("a")), sections, box, nested=True).alias("t")).first().t
    assert text == "# N\n\n<!-- Page ID: 7 -->\n<!-- Categories: a -->\n\n## Physical information\n\n**Hair:** red\n\n## S\n\ns\n\n### T\n\nt"


def test_long_packs_overlap_like_the_plain_loop(spark):
    import random

    from corpuscle.config import Config
    from corpuscle.operators import chunking

    r, cfg = random.Random(2), Config()
    texts = ["", "short", *("\n\n".join(" ".join(r.choice(["word.", "other", "x" * 30]) for _ in range(r.randint(50, 1400))) for _ in range(r.randint(1, 5))) for _ in range(25))]
    df = spark.createDataFrame([(i, 1, t) for i, t in enumerate(texts)], "book_number int, chapter_number int, content string")
    packed = {x.book_number: x.c for x in df.select("book_number", chunking.pack_text("content", cfg.chunk_max).alias("c")).collect()}
    want = {(i, k + 1, t) for i, own in packed.items() for k, t in enumerate([p for c in own for p in chunking.split_overlapping(c, cfg.chunk_target, cfg.chunk_max, cfg.chunk_overlap)])}
    got = pages.chunk_chapters(df).collect()
    assert {(x.book_number, x.chunk_index, x.text) for x in got} == want and any(len(c) > cfg.chunk_target for own in packed.values() for c in own)
    assert all(x.total_chunks == sum(1 for y in got if y.book_number == x.book_number) for x in got)


def test_document_chunks_pass_the_limit(spark, sf):
    from corpuscle.plans import all_queries

    for name in ("document_concepts", "document_characters", "document_summaries", "document_chapters", "document_chronology"):
        assert all_queries()[name](spark, sf).filter("total_chunks > 1 and length(text) > 5000").count() > 0
