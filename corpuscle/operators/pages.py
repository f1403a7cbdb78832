"""Typed pages: section texts, attributes by category, and the chunk tables of each page type.

Pages are rows with ``sections`` (:data:`corpuscle.schemas.SECTIONS`). Every chunker is one
projection: sections become texts, texts are packed, packs are numbered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuscle.config import Config
from corpuscle.functions.text import chunk_id, col, strip
from corpuscle.operators import chunking


def _filled(c: Column) -> Column:
    return F.when(strip(c) != "", strip(c))


def concept_section(s: Column) -> Column:
    """'## title', content, then '### subtitle' and content of each part; a title alone stays."""
    subs = F.transform(s["subsections"], lambda x: F.concat_ws("\n", F.concat(F.lit("### "), x["title"]), _filled(x["content"])))
    return F.concat_ws("\n\n", F.concat_ws("\n", F.concat(F.lit("## "), s["title"]), _filled(s["content"])), F.array_join(subs, "\n\n"))


def character_section(s: Column) -> Column:
    """The content, or else the parts under bold titles; never both."""
    subs = F.filter(F.transform(s["subsections"], lambda x: F.when(strip(x["content"]) != "", F.concat(F.lit("**"), x["title"], F.lit("**\n"), strip(x["content"])))), lambda t: t.isNotNull())
    return F.coalesce(_filled(s["content"]), F.array_join(subs, "\n\n"))


def summary_section(s: Column) -> Column:
    """Bold title and content; parts are left out."""
    return F.concat(F.lit("**"), s["title"], F.lit("**\n"), F.coalesce(s["content"], F.lit("")))


def not_apparatus(s: Column) -> Column:
    return ~F.lower(strip(s["title"])).isin("categories", "category")


def _texts(sections: Column, text_of, keep=lambda s: F.lit(True)) -> Column:
    rows = F.transform(F.filter(sections, keep), lambda s: F.struct(s["title"].alias("title"), strip(text_of(s)).alias("text")))
    return F.filter(rows, lambda r: r["text"] != "")


def chunk_sections(pages: DataFrame, key: str, text_of=concept_section, keep=not_apparatus, limit: int = Config.chunk_max) -> DataFrame:
    """(key, section_title, chunk_index, total_chunks, text): sections packed up to the limit, titles joined."""
    packed = pages.select(key, chunking.pack_sections(_texts(F.col("sections"), text_of, keep), limit).alias("c"))
    rows = packed.select(key, F.size("c").cast("long").alias("total_chunks"), F.posexplode("c").alias("pos", "x"))
    return rows.select(key, F.col("x.titles").alias("section_title"), (F.col("pos") + 1).cast("long").alias("chunk_index"), "total_chunks", F.col("x.text").alias("text"))


def chunk_characters(pages: DataFrame, key: str, limit: int = Config.chunk_max) -> DataFrame:
    """Only sections without a place in time are chunked."""
    return chunk_sections(pages, key, character_section, lambda s: F.lit(True), limit)


def chunk_summaries(pages: DataFrame, key: str, limit: int = Config.chunk_max) -> DataFrame:
    """All sections of a page as one text, chunked like a chapter; pages without text give none."""
    text = F.array_join(F.transform(F.filter("sections", lambda s: strip(s["content"]) != ""), summary_section), "\n\n")
    rows = pages.select(key, text.alias("__text")).filter("__text <> ''")
    return chunking.number_split(rows, chunking.pack_text("__text", limit), key)


def chronology_text(kind: Column, content: Column, subsections: Column) -> Column:
    """In time the content alone; else, with subsections, the content and each one's under its bold title."""
    content = F.coalesce(content, F.lit(""))
    subs = F.filter(F.transform(subsections, lambda x: F.when(F.coalesce(x["content"], F.lit("")) != "", F.concat(F.lit("**"), x["title"], F.lit("**\n"), x["content"]))), lambda t: t.isNotNull())
    whole = F.array_join(F.concat(F.when(strip(content) != "", F.array(content)).otherwise(F.array().cast("array<string>")), subs), "\n\n")
    return F.when((kind == "temporal") | (whole == ""), content).otherwise(whole)


def chunk_chronology(sections: DataFrame, key: str, limit: int = Config.chunk_max) -> DataFrame:
    """Chunks of each section (rows of ``parsing.split_temporal``) with its temporal_order."""
    rows = sections.withColumn("__x", chronology_text(F.col("type"), F.col("content"), F.col("subsections"))).filter(strip("__x") != "")
    return chunking.number_chunks(rows, chunking.pack_text("__x", limit), key, "h2", "title", "type", "temporal_order")


def chunk_chapters(chapters: DataFrame, limit: int = Config.chunk_max) -> DataFrame:
    """Chunks of (book_number, chapter_number, content), each with its id; packs over the target overlap."""
    rows = chunking.number_split(chapters, chunking.pack_text("content", limit), "book_number", "chapter_number")
    return rows.withColumn("chunk_id", chunk_id(F.col("book_number"), F.col("chapter_number"), F.col("chunk_index")))


def overview(sections: str | Column, least: int = 50) -> Column:
    """Content of the section called overview, else of the first over `least` characters, else ''."""
    s = col(sections)
    named = F.filter(s, lambda x: F.lower(x["title"]).isin("overview", "introduction", "description"))
    long = F.filter(s, lambda x: F.length(x["content"]) > least)
    return F.coalesce(F.try_element_at(named, F.lit(1))["content"], F.try_element_at(long, F.lit(1))["content"], F.lit(""))


def dependent(flag: Column, attribute: Column, values: dict[str, str]) -> Column:
    """A value that follows from another attribute where the flag is set; null elsewhere."""
    of = F.create_map(*(F.lit(x) for kv in values.items() for x in kv))
    return F.when(flag, of[attribute])


def book_by_category(pages: DataFrame, key: str, cats: str, books: DataFrame, suffix: str = " chapter summaries") -> DataFrame:
    """(key, book_number): the last category that is a book's title and the suffix, but for case."""
    rows = pages.select(key, F.posexplode(cats).alias("__pos", "__cat"))
    title = F.regexp_replace(F.lower(F.translate("__cat", "_", " ")), f"{suffix.lower()}$", "")
    hits = rows.withColumn("__t", title).join(books.select(F.lower("book_title").alias("__t"), "book_number"), "__t")
    return pages.select(key).join(hits.groupBy(key).agg(F.max_by("book_number", "__pos").alias("book_number")), key, "left")


def book_by_title(titles: DataFrame, title: str, books: DataFrame) -> DataFrame:
    """Add book_number: exact title, then a variant, then without case; -1 without any.

    books: book_title, book_number, variants (array).
    """
    exact = books.select(F.col("book_title").alias("__k"), "book_number", F.lit(0).alias("tier"))
    variant = books.select(F.explode("variants").alias("__k"), "book_number", F.lit(1).alias("tier"))
    folded = exact.union(variant).select(F.lower("__k").alias("__k"), "book_number", F.lit(2).alias("tier"))
    known = exact.union(variant).union(folded)
    rows = titles.select(title).distinct()
    hit = (F.col("__k") == F.col(title)) & (F.col("tier") < 2) | (F.col("__k") == F.lower(title)) & (F.col("tier") == 2)
    keyed = rows.withColumn("__k", F.explode(F.array_distinct(F.array(F.col(title), F.lower(title)))))
    best = keyed.join(known, "__k").withColumn("__k", F.col("__k")).filter(hit).groupBy(title).agg(F.min_by("book_number", F.struct("tier", "book_number")).alias("book_number"))
    return titles.join(best, title, "left").withColumn("book_number", F.coalesce("book_number", F.lit(-1)))


def temporal_titles(text: str | Column) -> Column:
    """Titles of '## In <Book>' headings, in order."""
    return F.regexp_extract_all(col(text), F.lit(r"(?m)^## In (.+?)\s*$"), F.lit(1))


def format_metric(value: float, kind: str) -> str:
    """A metric as shown to people: bytes, seconds, percent or a plain number."""
    if kind == "percent":
        return f"{value:.1f}%"
    if kind == "seconds":
        minutes, seconds = divmod(value, 60)
        hours, minutes = divmod(int(minutes), 60)
        return f"{hours}h {minutes}m {seconds:.0f}s" if hours else f"{minutes}m {seconds:.1f}s" if minutes else f"{seconds:.2f}s"
    if kind == "bytes":
        for unit in ("B", "KB", "MB", "GB"):
            if value < 1024:
                return f"{value:.1f} {unit}"
            value /= 1024
        return f"{value:.1f} TB"
    return f"{value:,.2f}" if value % 1 else f"{value:,.0f}"
