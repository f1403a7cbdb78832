"""Scalar text functions as Column expressions; all stay inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: str | Column) -> Column:
    """Without white space at either end (`trim` only knows spaces)."""
    return F.regexp_replace(col(c), r"^\s+|\s+$", "")


def word_count(c: str | Column) -> Column:
    """Words between white space; null for null."""
    s = strip(c)
    return F.when(s == "", 0).otherwise(F.size(F.split(s, r"\s+"))).cast("long")


def token_estimate(c: str | Column) -> Column:
    """Characters over four, rounded down."""
    return F.floor(F.length(col(c)) / 4).cast("long")


def straight_apostrophes(c: str | Column) -> Column:
    """Typographic apostrophes, back-ticks and the turned comma as U+0027."""
    return F.translate(col(c), "‘’`ʻ", "''''")


def safe_filename(c: str | Column) -> Column:
    """Spaces and slashes as underscores; characters that file systems refuse dropped."""
    return F.regexp_replace(F.translate(col(c), " /", "__"), r'[<>:"|?*]', "")


def strip_suffix(c: str | Column, suffix: str) -> Column:
    """Without the suffix, as a suffix and not as a set of characters."""
    c = col(c)
    return F.when(c.endswith(suffix), F.substring(c, F.lit(1), F.length(c) - len(suffix))).otherwise(c)


def book_number(c: str | Column) -> Column:
    """The number of a 'NN-Title.txt' name."""
    return F.regexp_extract(col(c), r"^(\d+)-", 1).try_cast("int")


def book_title(c: str | Column) -> Column:
    return F.regexp_replace(F.regexp_replace(col(c), r"^\d+-", ""), r"\.txt$", "")


def first_h1(c: str | Column) -> Column:
    """Text of the first '# ' line, null without one."""
    return F.nullif(strip(F.regexp_extract(col(c), r"(?m)^\s*# (.+)$", 1)), F.lit(""))


def page_name(content: str | Column, filename: str | Column) -> Column:
    """First heading without '/Chronology'; the file's name where there is none."""
    named = F.regexp_replace(first_h1(content), r"/Chronology$", "")
    return F.coalesce(named, F.translate(F.regexp_replace(col(filename), r"\.txt$", ""), "_", " "))


def page_id(c: str | Column) -> Column:
    """The number of '<!-- Page ID: n -->'; null without one."""
    return F.regexp_extract(col(c), r"(?i)<!--\s*Page ID:\s*(\d+)\s*-->", 1).try_cast("bigint")


def categories(c: str | Column, override: Column | None = None) -> Column:
    """The items of '<!-- Categories: a, b -->', stripped, distinct and sorted; empty without one.

    override: an array that takes their place where it is not null.
    """
    items = F.split(F.regexp_extract(col(c), r"(?i)<!--\s*Categories:\s*(.*?)\s*-->", 1), ",")
    items = items if override is None else F.coalesce(override, items)
    return F.array_sort(F.array_distinct(F.filter(F.transform(items, strip), lambda x: x != "")))


def chapter_number(c: str | Column) -> Column:
    return F.regexp_extract(col(c), r"(?i)Chapter[_\s]+(\d+)", 1).try_cast("int")


#: Steps from wiki markup to plain text, in the order in which they apply.
MARKUP = [
    (r"(?s)<!--.*?-->", ""),
    (r"\[\[([^\]|]+)\|([^\]]+)\]\]", "$2"),
    (r"\[\[([^\]]+)\]\]", "$1"),
    (r"\[http[^\s]+ ([^\]]+)\]", "$1"),
    (r"(?i)\[\[File:.*?\]\]", ""),
    (r"(?i)\[\[Image:.*?\]\]", ""),
    (r"'{2,}", ""),
    (r"\{\{[^\}]*\}\}", ""),
    (r"(?is)<ref[^>]*>.*?</ref>", ""),
    (r"(?i)<ref[^>]*/?>", ""),
    (r"\s+", " "),
]


def clean_markup(c: str | Column) -> Column:
    out = col(c)
    for pattern, to in MARKUP:
        out = F.regexp_replace(out, pattern, to)
    return strip(out)


def clean_citations(c: str | Column) -> Column:
    """Without bracketed references and doubled white space; null when two characters or fewer remain."""
    out = strip(F.regexp_replace(F.regexp_replace(col(c), r"\[\s*[^\]]+\s*\]", ""), r"\s{2,}", " "))
    out = F.regexp_replace(out, r"\s+([.,!?;:])", "$1")
    return F.when(F.length(out) > 2, out)


def chunk_id(book: Column, chapter: Column, index: Column) -> Column:
    return F.format_string("book_%02d_ch_%02d_chunk_%03d", book, chapter, index)


def paragraphs(c: str | Column) -> Column:
    """Stripped, non-empty parts between blank lines."""
    return F.filter(F.transform(F.split(col(c), r"\n\s*\n+"), strip), lambda x: x != "")


def sentences(c: str | Column) -> Column:
    """Stripped, non-empty sentences; the mark stays with the sentence that it ends."""
    return F.filter(F.transform(F.split(col(c), r"(?<=[.!?])\s+"), strip), lambda x: x != "")


def pieces(c: str | Column, size: int) -> Column:
    """Cuts of a fixed width; empty for the empty string."""
    c = col(c)
    last = F.floor((F.length(c) - 1) / size).cast("int")
    return F.when(F.length(c) == 0, F.array().cast("array<string>")).otherwise(
        F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(c, i * size + 1, F.lit(size)))
    )


def last_before(c: Column, pattern: str) -> Column:
    """1-based place of the last occurrence of a literal, 0 without one."""
    at = F.instr(F.reverse(c), F.lit(pattern[::-1]))
    return F.when(at == 0, 0).otherwise(F.length(c) - at - len(pattern) + 2)


#: Words that carry nothing in a question.
STOP_WORDS = ("how", "does", "do", "what", "is", "are", "the", "a", "an")


def query_terms(c: str | Column, least: int = 0) -> Column:
    """Lower-cased terms between white space; `least`: longer than so many characters."""
    return F.filter(F.split(F.lower(strip(c)), r"\s+"), lambda t: F.length(t) > least)


def without_stop_words(c: str | Column) -> Column:
    """The question in lower case without stop words; as it was when nothing would remain."""
    kept = F.array_join(F.filter(query_terms(c), lambda t: ~t.isin(*STOP_WORDS)), " ")
    return F.when(kept == "", col(c)).otherwise(kept)


def normalized(c: str | Column) -> Column:
    """Lower case with a space for each ASCII sign."""
    return F.regexp_replace(F.lower(col(c)), r"\p{Punct}", " ")


def terms_in(c: str | Column, terms: list[str]) -> Column:
    """The terms that the lower-cased text contains, in their order; a repeated term comes again."""
    low = F.lower(col(c))
    return F.filter(F.array(*map(F.lit, terms)).cast("array<string>"), lambda t: F.contains(low, F.lower(t)))


def word_ngrams(tokens: str, most: int) -> Column:
    """All runs of 1 to `most` of a column of tokens, joined by single spaces; needs no shuffle."""
    c, grams = F.col(tokens), [F.col(tokens)]
    for n in range(2, most + 1):
        size = F.greatest(F.size(c) - (n - 1), F.lit(0))
        grams.append(F.zip_with(F.slice(grams[-1], F.lit(1), size), F.slice(c, F.lit(n), size), lambda a, b: F.concat_ws(" ", a, b)))
    return F.flatten(F.array(*grams))
