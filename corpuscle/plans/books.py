"""Queries over books and typed pages. Raw texts are made of rows of the tables, so SQL knows what parsing must give back."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuscle.operators import books, pages, parsing, reports
from corpuscle.session import table

from .catalog import query

_STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
_BODY = _STRIP.format("text")
_WORDS = f"CASE WHEN {_BODY} = '' THEN 0 ELSE len(regexp_split_to_array({_BODY}, '\\s+')) END"


def book_texts(spark, sf_dir):
    """A book a conversation: its turns as chapters, then a glossary with an entry a turn."""
    order = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    rows = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("book_number")).agg(order.alias("t"))
    chapters = F.transform("t", lambda x: F.concat(F.lit("CHAPTER\n\n"), x["turn"].cast("string"), F.lit("\n"), x["role"], F.lit("\n"), x["text"]))
    entries = F.transform("t", lambda x: F.concat(F.lit("> **"), x["role"], F.lit(" "), x["turn"].cast("string"), F.lit(":** (p"), x["turn"].cast("string"), F.lit(") said in\nturn "), x["turn"].cast("string")))
    return rows.select("book_number", F.concat(F.lit("front matter\n"), F.array_join(chapters, "\n"), F.lit("\nGLOSSARY\n"), F.array_join(entries, "\n")).alias("text"))


def _chapters(spark, sf_dir):
    return parsing.parse_books(book_texts(spark, sf_dir), "book_number")


def _glossary(spark, sf_dir):
    return parsing.parse_glossary(book_texts(spark, sf_dir), "book_number")


def _titles(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("book_number")).distinct().withColumn("book_title", F.concat(F.lit("Book "), F.col("book_number").cast("string")))


@query(f"""SELECT conv_id AS book_number, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS section, 'chapter' AS chapter_type, CAST(turn AS INTEGER) AS chapter_number, role AS chapter_title, {_BODY} AS content FROM conversations""")
def books_parsed(spark, sf_dir):
    """Raw book texts as chapters."""
    return _chapters(spark, sf_dir)


@query("""SELECT conv_id AS book_number, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS entry, role || ' ' || turn AS term, 'p' || turn AS pronunciation, 'said in turn ' || turn AS description FROM conversations""")
def books_glossary(spark, sf_dir):
    """Raw book texts as glossary entries."""
    return _glossary(spark, sf_dir)


@query(f"""SELECT conv_id AS book_number, CAST(turn AS INTEGER) AS chapter_number, 'Book ' || conv_id AS book_title, conv_id AS temporal_order, CAST(length({_BODY}) AS BIGINT) AS content_length, CAST({_WORDS} AS BIGINT) AS word_count FROM conversations""")
def chapter_metadata(spark, sf_dir):
    rows = books.chapter_rows(_chapters(spark, sf_dir), _titles(spark, sf_dir))
    return rows.select("book_number", "chapter_number", "metadata.book_title", "metadata.temporal_order", "metadata.content_length", "metadata.word_count")


@query("""SELECT conv_id AS book_number, role || ' ' || turn AS term, 'Book ' || conv_id AS book_title, 'book_glossary' AS source FROM conversations""")
def glossary_metadata(spark, sf_dir):
    """Entries whose term is a list, normalised."""
    listed = _glossary(spark, sf_dir).withColumn("term", F.split(F.concat("term", F.lit("::")), " "))
    return books.glossary_rows(listed, _titles(spark, sf_dir)).select("book_number", "term", "metadata.book_title", "metadata.source")


def _structured(spark, sf_dir):
    return books.structured(_chapters(spark, sf_dir), _glossary(spark, sf_dir))


@query(f"""SELECT conv_id AS book_number, count(*) AS total_chapters, false AS has_prologue, false AS has_epilogue, count(*) AS glossary_entries, CAST(sum(length({_BODY})) AS BIGINT) AS chars FROM conversations GROUP BY conv_id""")
def books_structured(spark, sf_dir):
    """One row a book, with its chapters and glossary inside."""
    chars = F.aggregate("chapters", F.lit(0).cast("long"), lambda a, c: a + F.length(c["content"]))
    return _structured(spark, sf_dir).select("book_number", "total_chapters", "has_prologue", "has_epilogue", "glossary_entries", chars.alias("chars"))


@query("SELECT conv_id AS book_number, CAST(turn AS INTEGER) AS chapter_number, role AS chapter_title FROM conversations")
def chapters_flat(spark, sf_dir):
    return books.chapters_flat(_structured(spark, sf_dir)).select("book_number", "chapter_number", "chapter_title")


@query("SELECT conv_id AS book_number, role || ' ' || turn AS term, 'p' || turn AS pronunciation FROM conversations")
def glossary_flat(spark, sf_dir):
    return books.glossary_flat(_structured(spark, sf_dir)).select("book_number", "term", "pronunciation")


@query(f"SELECT conv_id AS book_number, CAST(turn AS INTEGER) AS chapter_number, {_BODY} AS content FROM conversations WHERE conv_id = 1 AND turn = 1")
def chapter_lookup(spark, sf_dir):
    """One chapter by book and number: the lookup is the feature."""
    return books.chapter(_structured(spark, sf_dir), 1, 1).select("book_number", "chapter_number", "content")


@query("""SELECT p_brand AS term, arg_min(p_type, p_partkey) AS pronunciation, arg_min(p_name, p_partkey) AS definition, array_to_string(list_sort(list(DISTINCT p_size)), ',') AS sources FROM part GROUP BY p_brand""")
def unified_glossary(spark, sf_dir):
    """First definition wins, all sources are collected."""
    rows = table(spark, sf_dir, "part").select(F.col("p_brand").alias("term"), F.col("p_type").alias("pronunciation"), F.col("p_name").alias("description"), "p_size", "p_partkey")
    out = books.unified_glossary(rows, "p_partkey", "term", "p_size")
    return out.withColumn("sources", F.array_join(F.transform("sources", lambda x: x.cast("string")), ","))


@query("""WITH b AS (SELECT conv_id, count(*) AS n, min(nullif(trim(text), '')) AS a, arg_min(text, turn) AS first FROM conversations GROUP BY conv_id)
SELECT CAST(conv_id AS VARCHAR) AS subject, 'total out of range' AS issue FROM b WHERE n NOT BETWEEN 3 AND 9
UNION ALL SELECT 'all', count(*) || ' books, not 10' FROM b HAVING count(*) <> 10""")
def structure_validation(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("total"), F.min("role").alias("role"))
    return books.structure_issues(rows, "conv_id", "total", 3, 9, ["role"], 10)


_MAPPING = """mapping AS (
  SELECT 'Nation, The ' || n_nationkey AS term, CASE n_nationkey % 5 WHEN 0 THEN 'the ' || n_nationkey || '_nation.txt' WHEN 1 THEN 'Nation,_The ' || n_nationkey || '.txt' WHEN 2 THEN 'The ' || n_nationkey || '_Nation.txt' WHEN 3 THEN 'else.txt' END AS file FROM nation
  UNION ALL SELECT 'Some ' || n_name, CASE n_nationkey % 4 WHEN 0 THEN 'Some_' || n_name || '.txt' WHEN 1 THEN lower('Some_' || n_name || '.txt') WHEN 2 THEN 'Some ' || n_name || '.txt' END FROM nation
)"""


@query(f"""WITH {_MAPPING}, kinds AS (SELECT file, CASE WHEN file IS NULL THEN 'unmatched' WHEN contains(term, ',') THEN
  CASE WHEN file = lower(trim(split_part(term, ',', 2))) || '_' || lower(trim(split_part(term, ',', 1))) || '.txt' THEN 'swap_lowercase'
       WHEN file = trim(split_part(term, ',', 1)) || ',_' || trim(split_part(term, ',', 2)) || '.txt' THEN 'keep_comma_titlecase'
       WHEN file = trim(split_part(term, ',', 2)) || '_' || trim(split_part(term, ',', 1)) || '.txt' THEN 'swap_titlecase' ELSE 'other' END
  ELSE CASE WHEN file = replace(term, ' ', '_') || '.txt' THEN 'underscore_keepcase' WHEN file = lower(replace(term, ' ', '_')) || '.txt' THEN 'underscore_lowercase' WHEN file = term || '.txt' THEN 'exact' ELSE 'other' END END AS strategy FROM mapping)
SELECT strategy, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM mapping), 6) AS pct FROM kinds GROUP BY strategy
UNION ALL SELECT 'matched', count(file), round(100.0 * count(file) / (SELECT count(*) FROM mapping), 6) FROM mapping""")
def match_report(spark, sf_dir):
    """Terms by the rewriting that found their page."""
    n = table(spark, sf_dir, "nation")
    k = F.col("n_nationkey").cast("string")
    one = F.when(F.col("n_nationkey") % 5 == 0, F.concat(F.lit("the "), k, F.lit("_nation.txt"))).when(F.col("n_nationkey") % 5 == 1, F.concat(F.lit("Nation,_The "), k, F.lit(".txt")))
    one = one.when(F.col("n_nationkey") % 5 == 2, F.concat(F.lit("The "), k, F.lit("_Nation.txt"))).when(F.col("n_nationkey") % 5 == 3, "else.txt")
    name, m = F.concat(F.lit("Some "), "n_name"), F.col("n_nationkey") % 4
    two = F.when(m == 0, F.concat(F.lit("Some_"), "n_name", F.lit(".txt"))).when(m == 1, F.lower(F.concat(F.lit("Some_"), "n_name", F.lit(".txt")))).when(m == 2, F.concat(name, F.lit(".txt")))
    mapping = n.select(F.concat(F.lit("Nation, The "), k).alias("term"), one.alias("file")).union(n.select(name, two))
    return books.match_report(mapping, "term", "file")


#: Books that sections of the pages below may be named after.
BOOKS = [(0, "AFRICA"), (1, "AMERICA"), (2, "ASIA")]


def page_texts(spark, sf_dir):
    """A character's page a nation: overview, activities by region and customers' segments, and notes."""
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    rows = n.join(r, n.n_regionkey == r.r_regionkey)
    key = F.col("n_nationkey").cast("string")
    text = F.concat(
        F.lit("# "), "n_name", F.lit("/Chronology\n\n<!-- Page ID: "), key, F.lit(" -->\n<!-- Categories: Men, R"), F.col("n_regionkey").cast("string"), F.lit(" -->\n\nlost\n\n## Overview\n\nOf "), "r_name",
        F.lit(".\n\n---\n## Activities\n\ndropped\n\n### "), "r_name", F.lit("\n\nWent to "), "r_name", F.lit(".\n\n### Event "), key, F.lit("\n\n#### deep\nDid "), key, F.lit(".\n\n## "), "r_name", F.lit("\n\n### Part\n\nOf it "), key, F.lit("\n"),
    )
    return rows.select(F.concat(F.lit("page_"), key, F.lit(".txt")).alias("filename"), "n_nationkey", text.alias("text"))


def _books(spark):
    return spark.createDataFrame(BOOKS, "book_number int, book_title string")


_NATIONS = "n AS (SELECT *, 'page_' || n_nationkey || '.txt' AS filename, CASE r_name WHEN 'AFRICA' THEN 0 WHEN 'AMERICA' THEN 1 WHEN 'ASIA' THEN 2 END AS book FROM nation JOIN region ON n_regionkey = r_regionkey)"
_PARSED = f"""{_NATIONS}, parsed AS (
  SELECT filename, 1 AS h2, 0 AS h3, 'Overview' AS title, 'Of ' || r_name || '.' AS content FROM n
  UNION ALL SELECT filename, 2, 0, 'Activities', 'dropped' FROM n
  UNION ALL SELECT filename, 2, 1, r_name, 'Went to ' || r_name || '.' FROM n
  UNION ALL SELECT filename, 2, 2, 'Event ' || n_nationkey, '#### deep' || chr(10) || 'Did ' || n_nationkey || '.' FROM n
  UNION ALL SELECT filename, 3, 0, r_name, '' FROM n
  UNION ALL SELECT filename, 3, 1, 'Part', 'Of it ' || n_nationkey FROM n)"""


@query(f"WITH {_PARSED} SELECT filename, CAST(h2 AS BIGINT) AS h2, CAST(h3 AS BIGINT) AS h3, title, content FROM parsed")
def markdown_sections(spark, sf_dir):
    """Sections and subsections of markdown pages."""
    return parsing.parse_markdown(page_texts(spark, sf_dir), "filename", "text")


@query(f"WITH {_PARSED} SELECT filename, count(*) FILTER (h3 = 0) AS sections, count(*) FILTER (h3 > 0) AS subsections, string_agg(title, '/' ORDER BY h2, h3) AS titles FROM parsed GROUP BY filename")
def section_tree(spark, sf_dir):
    """Pages as nested section arrays."""
    tree = parsing.section_tree(markdown_sections(spark, sf_dir), "filename")
    subs = F.aggregate("sections", F.lit(0).cast("long"), lambda a, s: a + F.size(s["subsections"]))
    titles = F.flatten(F.transform("sections", lambda s: F.concat(F.array(s["title"]), F.transform(s["subsections"], lambda x: x["title"]))))
    return tree.select("filename", F.size("sections").cast("long").alias("sections"), subs.alias("subsections"), F.array_join(titles, "/").alias("titles"))


_CHARACTER = f"""{_PARSED}, character AS (
  SELECT p.filename, h2, h3, CASE WHEN h2 = 2 THEN CASE WHEN h3 = 1 AND book IS NOT NULL THEN 'temporal' ELSE 'event' END ELSE 'non_temporal' END AS type, CASE WHEN h2 = 2 AND h3 = 1 THEN book END AS book_number, title, content
  FROM parsed p JOIN n USING (filename) WHERE NOT (h2 = 2 AND h3 = 0))"""


@query(f"WITH {_CHARACTER} SELECT filename, CAST(h2 AS BIGINT) AS h2, CAST(h3 AS BIGINT) AS h3, type, CAST(book_number AS INTEGER) AS book_number, title, content FROM character")
def character_pages(spark, sf_dir):
    """Character pages: subsections of Activities are in time, other sections are not."""
    return parsing.character_sections(markdown_sections(spark, sf_dir), "filename", _books(spark))


@query(f"""WITH {_PARSED} SELECT filename, CAST(h2 AS BIGINT) AS h2, CASE WHEN book IS NOT NULL AND title = r_name THEN 'temporal' ELSE 'non_temporal' END AS type, CASE WHEN title = r_name THEN CAST(book AS INTEGER) END AS temporal_order, title,
CAST(1 AS BIGINT) AS chunk_index, CAST(1 AS BIGINT) AS total_chunks,
CASE h2 WHEN 1 THEN content WHEN 2 THEN 'dropped' || chr(10) || chr(10) || '**' || r_name || '**' || chr(10) || 'Went to ' || r_name || '.' || chr(10) || chr(10) || '**Event ' || n_nationkey || '**' || chr(10) || '#### deep' || chr(10) || 'Did ' || n_nationkey || '.'
ELSE '**Part**' || chr(10) || 'Of it ' || n_nationkey END AS text FROM parsed JOIN n USING (filename) WHERE h3 = 0 AND NOT (h2 = 3 AND book IS NOT NULL)""")
def chronology_chunks(spark, sf_dir):
    """Sections in time give their content, others their subsections as well."""
    return pages.chunk_chronology(parsing.split_temporal(markdown_sections(spark, sf_dir), _books(spark)), "filename")


@query(f"""WITH {_PARSED} SELECT p.filename, 'CHARACTER' AS page_type, n_name AS page_name, CAST(n_nationkey AS BIGINT) AS page_id, 'Men,R' || n_regionkey AS categories, count(*) AS sections FROM parsed p JOIN n USING (filename) WHERE n_regionkey <> 4 GROUP BY ALL""")
def typed_pages(spark, sf_dir):
    """Files of one type, classified before their content is parsed."""
    from corpuscle.functions.text import categories
    from corpuscle.operators import classify

    kind = classify.page_type(categories("text"), [("CHARACTER", ["men", "women"])], ["r4"])
    rows = parsing.parse_typed(page_texts(spark, sf_dir), "filename", "text", kind, "CHARACTER")
    return rows.groupBy("filename", "page_type", "page_name", "page_id", F.array_join("categories", ",").alias("categories")).agg(F.count("*").alias("sections"))


@query("""SELECT 'page_Chapter_' || n_nationkey || '.txt' AS filename, CASE r_name WHEN 'AFRICA' THEN 0 WHEN 'AMERICA' THEN 1 WHEN 'ASIA' THEN 2 END AS book_number, CAST(n_nationkey AS INTEGER) AS chapter_number, n_name AS chapter_title FROM nation JOIN region ON n_regionkey = r_regionkey""")
def summary_pages(spark, sf_dir):
    """Chapter-summary pages: book by category, number by file name, title by heading."""
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    key = F.col("n_nationkey").cast("string")
    text = F.concat(F.lit("# "), "n_name", F.lit("\n<!-- Categories: x, "), F.lower("r_name"), F.lit("_Chapter_Summaries -->\n"))
    files = n.join(r, n.n_regionkey == r.r_regionkey).select(F.concat(F.lit("page_Chapter_"), key, F.lit(".txt")).alias("filename"), text.alias("text"))
    return parsing.summary_pages(files, "filename", "text", _books(spark))


def _typed(spark, sf_dir):
    """Typed pages with their arrays, one a nation; those of region 4 are concepts with an empty section."""
    rows = character_pages(spark, sf_dir)
    one = F.struct("h2", "h3", "book_number", "title", "content")
    out = rows.groupBy("filename").agg(
        F.array_sort(F.collect_list(F.when(F.col("type") != "non_temporal", one))).alias("temporal_sections"), F.array_sort(F.collect_list(F.when((F.col("type") == "non_temporal") & (F.col("h3") == 0), one))).alias("non_temporal_sections")
    )
    return out.withColumn("sections", F.array().cast(out.schema["temporal_sections"].dataType)).withColumn("page_type", F.when(F.exists("temporal_sections", lambda s: s["book_number"] == 2), "CHRONOLOGY").otherwise("CHARACTER"))


_TYPED = f"{_CHARACTER}, typed AS (SELECT c.*, CASE WHEN n.book = 2 THEN 'CHRONOLOGY' ELSE 'CHARACTER' END AS page_type, type <> 'non_temporal' AS timed FROM character c JOIN n USING (filename) WHERE type <> 'non_temporal' OR h3 = 0)"


@query(f"""WITH {_TYPED}, per AS (SELECT page_type, filename, count(*) FILTER (timed) AS t, count(*) FILTER (NOT timed) AS o, sum(length(content)) AS chars FROM typed GROUP BY ALL)
SELECT page_type, count(*) AS pages, round(avg(t), 6) AS avg_temporal, count(*) FILTER (t > 0) AS with_temporal, round(avg(o), 6) AS avg_non_temporal, CAST(sum(t + o) AS BIGINT) AS sections, CAST(sum(chars) AS BIGINT) AS content_chars, round(sum(chars) / sum(t + o), 6) AS avg_content FROM per GROUP BY page_type""")
def page_statistics(spark, sf_dir):
    return reports.page_statistics(_typed(spark, sf_dir))


@query(f"WITH {_TYPED} SELECT page_type, CAST(book_number AS INTEGER) AS book_number, count(*) AS n FROM typed WHERE timed AND book_number IS NOT NULL GROUP BY ALL")
def book_coverage(spark, sf_dir):
    return reports.book_coverage(_typed(spark, sf_dir))


@query(f"""WITH {_TYPED} SELECT count(DISTINCT filename) AS total_pages, count(DISTINCT CASE WHEN timed THEN filename END) AS pages_with_temporal, count(DISTINCT CASE WHEN NOT timed AND trim(content) <> '' THEN filename END) AS pages_with_content,
count(*) FILTER (timed AND trim(content) = '') AS empty_content_sections, count(*) FILTER (timed AND book_number > 1) AS invalid_book_numbers, count(*) FILTER (timed AND book_number > 1) = 0 AS valid FROM typed""")
def page_validation(spark, sf_dir):
    return reports.page_validation(_typed(spark, sf_dir), (0, 1))


@query("""SELECT n_nationkey, label_group, label, value FROM (
  SELECT n_nationkey, 'biographical' AS label_group, 'Nationality' AS label, n_name || ' (people)' AS value FROM nation
  UNION ALL SELECT n_nationkey, 'physical', 'Eyes', 'k' || n_regionkey FROM nation UNION ALL SELECT n_nationkey, 'biographical', 'Eyes', 'k' || n_regionkey FROM nation
  UNION ALL SELECT n_nationkey, 'other', 'Motto', 'm & n' FROM nation)""")
def infobox_fields(spark, sf_dir):
    """Fields of infoboxes: by their label, and in headed sections by the heading as well."""
    k = F.col("n_regionkey").cast("string")
    html = F.concat(
        F.lit("<p>x</p><aside class='portable-infobox wide'><img class='infobox-image'><section class='pi-item'><h2 class='pi-header'>Biographical <b>information</b></h2><div class='pi-item pi-data'><h3 class='pi-data-label'>Nationality</h3><div class='pi-data-value'><div><a href='#'>"),
        "n_name", F.lit("</a> (people)</div></div></div><div class='pi-item pi-data'><h3 class='pi-data-label'>Eyes</h3><div class='pi-data-value'>k"), k, F.lit("</div></div></section><div class='pi-data'><h3 class='pi-data-label'>Motto</h3><div class='pi-data-value'>m &amp; n</div></div><div class='pi-data'><h3 class='pi-data-label'>None</h3><div class='pi-data-value'> </div></div></aside><aside class='portable-infobox'><div class='pi-data'><h3 class='pi-data-label'>Second</h3><div class='pi-data-value'>x</div></div></aside>"),
    )
    return parsing.infobox(table(spark, sf_dir, "nation").select("n_nationkey", html.alias("html")), "n_nationkey", "html")


@query()
def chapter_chunks(spark, sf_dir):
    """Chapters as numbered chunks; packs over the target overlap."""
    return pages.chunk_chapters(_chapters(spark, sf_dir).select("book_number", "chapter_number", "content"))


@query(f"""SELECT filename, CAST(1 AS BIGINT) AS chunk_index, CAST(1 AS BIGINT) AS total_chunks, text FROM (
  SELECT filename, string_agg('**' || title || '**' || chr(10) || content, chr(10) || chr(10) ORDER BY h2) AS text FROM (WITH {_PARSED} SELECT * FROM parsed WHERE h3 = 0 AND trim(content) <> '') GROUP BY filename)""")
def summary_chunks(spark, sf_dir):
    """Sections of summary pages as one text, chunked."""
    return pages.chunk_summaries(parsing.section_tree(markdown_sections(spark, sf_dir), "filename"), "filename")


@query(f"""SELECT filename, 'Overview, Activities, ' || r_name AS section_title, CAST(1 AS BIGINT) AS chunk_index, CAST(1 AS BIGINT) AS total_chunks,
'## Overview' || chr(10) || 'Of ' || r_name || '.' || chr(10) || chr(10) || '## Activities' || chr(10) || 'dropped' || chr(10) || chr(10) || '### ' || r_name || chr(10) || 'Went to ' || r_name || '.' || chr(10) || chr(10) || '### Event ' || n_nationkey || chr(10) || '#### deep' || chr(10) || 'Did ' || n_nationkey || '.'
|| chr(10) || chr(10) || '## ' || r_name || chr(10) || chr(10) || '### Part' || chr(10) || 'Of it ' || n_nationkey AS text FROM (WITH {_NATIONS} SELECT * FROM n)""")
def concept_chunks(spark, sf_dir):
    """Sections of concept pages, packed with their titles."""
    return pages.chunk_sections(parsing.section_tree(markdown_sections(spark, sf_dir), "filename"), "filename")


@query(f"""SELECT filename, 'Overview, Activities, ' || r_name AS section_title, CAST(1 AS BIGINT) AS chunk_index, CAST(1 AS BIGINT) AS total_chunks,
'Of ' || r_name || '.' || chr(10) || chr(10) || 'dropped' || chr(10) || chr(10) || '**Part**' || chr(10) || 'Of it ' || n_nationkey AS text FROM (WITH {_NATIONS} SELECT * FROM n)""")
def character_chunks(spark, sf_dir):
    """Sections of character pages: the content, or else the parts under bold titles."""
    return pages.chunk_characters(parsing.section_tree(markdown_sections(spark, sf_dir), "filename"), "filename")
