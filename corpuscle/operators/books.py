"""Books as structured rows: chapter and glossary metadata, roll-ups by book, look-ups and checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuscle.functions.text import col, strip, word_count


def term_text(term: Column, is_list: bool) -> Column:
    """A term that is a string or a list of strings, as one string without colons at its end."""
    return F.regexp_replace(F.array_join(term, " ") if is_list else term, ":+$", "")


def chapter_rows(chapters: DataFrame, books: DataFrame, key: str = "book_number") -> DataFrame:
    """Chapters with a metadata struct: book number and title, place in time, length and words of the content."""
    named = chapters.join(books.select(key, "book_title"), key, "left")
    content = F.coalesce("content", F.lit(""))
    meta = F.struct(
        F.col(key).alias("book_number"), "book_title", F.col(key).alias("temporal_order"), F.length(content).cast("long").alias("content_length"), word_count(content).alias("word_count")
    )
    return named.select(key, "chapter_number", "chapter_type", "chapter_title", content.alias("content"), meta.alias("metadata"))


def glossary_rows(entries: DataFrame, books: DataFrame, key: str = "book_number") -> DataFrame:
    """Glossary entries with a metadata struct: book number, title and source."""
    named = entries.join(books.select(key, "book_title"), key, "left")
    is_list = entries.schema["term"].dataType.simpleString().startswith("array")
    meta = F.struct(F.col(key).alias("book_number"), "book_title", F.lit("book_glossary").alias("source"))
    return named.select(key, term_text(F.col("term"), is_list).alias("term"), F.coalesce("pronunciation", F.lit("")).alias("pronunciation"), "description", meta.alias("metadata"))


def structured(chapters: DataFrame, glossary: DataFrame, key: str = "book_number") -> DataFrame:
    """One row a book: total_chapters, has_prologue, has_epilogue, glossary_entries, chapters and glossary in order.

    A book's chapters and entries are one row's arrays: a book is bounded by what one person reads.
    Books without chapters but with a glossary have a row, and the other way round.
    """
    inner = F.struct("chapter_number", "chapter_type", "chapter_title", "content")
    own = chapters.groupBy(key).agg(
        F.count("*").alias("total_chapters"), F.bool_or(F.col("chapter_type") == "prologue").alias("has_prologue"), F.bool_or(F.col("chapter_type") == "epilogue").alias("has_epilogue"),
        F.array_sort(F.collect_list(inner)).alias("chapters"),
    )
    entries = glossary.groupBy(key).agg(F.count("*").alias("glossary_entries"), F.array_sort(F.collect_list(F.struct("term", "pronunciation", "description"))).alias("glossary"))
    out = own.join(entries, key, "full")
    no = F.lit(False)
    return out.select(
        key, F.coalesce("total_chapters", F.lit(0)).alias("total_chapters"), F.coalesce("has_prologue", no).alias("has_prologue"), F.coalesce("has_epilogue", no).alias("has_epilogue"),
        F.coalesce("glossary_entries", F.lit(0)).alias("glossary_entries"), F.coalesce("chapters", F.array()).alias("chapters"), F.coalesce("glossary", F.array()).alias("glossary"),
    )


def chapters_flat(books: DataFrame, key: str = "book_number") -> DataFrame:
    """The chapters of all structured books."""
    return books.select(key, F.explode("chapters").alias("c")).select(key, "c.*")


def glossary_flat(books: DataFrame, key: str = "book_number") -> DataFrame:
    """The glossary entries of all structured books."""
    return books.select(key, F.explode("glossary").alias("g")).select(key, "g.*")


def chapter(books: DataFrame, book: int, number: int, key: str = "book_number") -> DataFrame:
    """The chapters of one number in one book; a filter, so only that book is read where files are by book."""
    return chapters_flat(books.filter(F.col(key) == book), key).filter(F.col("chapter_number") == number)


def unified_glossary(entries: DataFrame, order: str, term: str = "term", *sources: str) -> DataFrame:
    """By term: pronunciation and definition of the first entry in order, and the distinct sources, sorted."""
    own = F.struct(*sources) if len(sources) > 1 else F.col(sources[0])
    return entries.groupBy(term).agg(F.min_by("pronunciation", order).alias("pronunciation"), F.min_by("description", order).alias("definition"), F.array_sort(F.collect_set(own)).alias("sources"))


def structure_issues(books: DataFrame, key: str, total: str, least: int, most: int, required: list[str], expected: int) -> DataFrame:
    """(subject, issue): books whose total is out of range or that lack a field, and a count of books other than expected."""
    rules = [F.when(~F.coalesce(F.col(total).between(least, most), F.lit(False)), F.lit(f"{total} out of range"))]
    rules += [F.when(F.col(c).isNull() | (strip(F.col(c).cast("string")) == ""), F.lit(f"no {c}")) for c in required]
    own = books.select(F.col(key).cast("string").alias("subject"), F.explode(F.filter(F.array(*rules), lambda x: x.isNotNull())).alias("issue"))
    n = books.agg(F.count("*").alias("n")).filter(F.col("n") != expected)
    return own.union(n.select(F.lit("all").alias("subject"), F.format_string(f"%d books, not {expected}", "n").alias("issue")))


def match_strategy(term: str | Column, file: str | Column) -> Column:
    """How a term's page was named: which rewriting leads from the term to the file; null without a file."""
    t, f = col(term), col(file)
    last, first = strip(F.split_part(t, F.lit(","), F.lit(1))), strip(F.substring(t, F.instr(t, ",") + 1, F.length(t)))
    under = F.translate(strip(F.regexp_replace(t, ", the$", "")), " ", "_")
    named = lambda name: f == F.concat(name, F.lit(".txt"))
    comma = (
        F.when(named(F.concat_ws("_", F.lower(first), F.lower(last))), "swap_lowercase")
        .when(named(F.concat(last, F.lit(",_"), first)), "keep_comma_titlecase")
        .when(named(F.concat_ws("_", first, last)), "swap_titlecase")
        .otherwise("other")
    )
    plain = F.when(named(under), "underscore_keepcase").when(named(F.lower(under)), "underscore_lowercase").when(named(t), "exact").otherwise("other")
    return F.when(f.isNotNull(), F.when(F.contains(t, F.lit(",")), comma).otherwise(plain))


def match_report(mapping: DataFrame, term: str, file: str) -> DataFrame:
    """(strategy, n, pct of all terms): each strategy, terms matched and unmatched."""
    kind = F.coalesce(match_strategy(term, file), F.lit("unmatched"))
    by = mapping.groupBy(kind.alias("strategy")).agg(F.count("*").alias("n"))
    matched = mapping.agg(F.lit("matched").alias("strategy"), F.count(file).alias("n"))
    total = mapping.agg(F.count("*").alias("total"))
    return by.union(matched).crossJoin(F.broadcast(total)).select("strategy", "n", F.round(100.0 * F.col("n") / F.col("total"), 6).alias("pct"))
