"""Profiles and checks over chunk and page tables, and reports as text from small aggregates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuscle.functions.text import strip


def chunk_profile(df: DataFrame, by: str, mentions: dict[str, str], order: str, text: str = "text", rollup: bool = False) -> DataFrame:
    """By source (and with `rollup` in total, source null): rows, rows with mentions, mentions, their average over rows
    that have some, text lengths, token estimates, rows with and without a place in time, and the share of the former.

    mentions: array column by name.
    """
    n = F.length(F.coalesce(text, F.lit("")))
    out = [F.count("*").alias("total_chunks")]
    for name, c in mentions.items():
        size = F.greatest(F.size(F.coalesce(c, F.array())), F.lit(0))
        rows, total = F.count_if(size > 0), F.sum(size)
        out += [rows.alias(f"with_{name}"), total.cast("long").alias(f"{name}_mentions"), F.round(F.coalesce(total / F.nullif(rows, F.lit(0)), F.lit(0.0)), 6).alias(f"avg_{name}")]
        out += [F.round(total / F.count("*"), 6).alias(f"{name}_density")]
    out += [F.round(F.avg(n), 6).alias("avg_length"), F.min(n).cast("long").alias("min_length"), F.max(n).cast("long").alias("max_length")]
    out += [F.round(F.avg(n) / 4, 6).alias("avg_tokens"), F.round(F.max(n) / 4, 6).alias("max_tokens")]
    out += [F.count(order).alias("temporal"), F.count_if(F.col(order).isNull()).alias("non_temporal"), F.round(100.0 * F.count(order) / F.count("*"), 6).alias("temporal_pct")]
    return (df.rollup(by) if rollup else df.groupBy(by)).agg(*out)


def size_distribution(df: DataFrame, by: str, text: str = "text", limit: int = 8000) -> DataFrame:
    """By source: rows, least, average and most characters, and rows over the limit."""
    n = F.length(text)
    return df.groupBy(by).agg(F.count("*").alias("n"), F.min(n).cast("long").alias("min_chars"), F.round(F.avg(n), 6).alias("avg_chars"), F.max(n).cast("long").alias("max_chars"), F.count_if(n > limit).alias("oversized"))


def rules_by_source(df: DataFrame, source: str, rules: dict[str, list[tuple[str, Column]]]) -> Column:
    """Messages of the rules that a row breaks, of its source's list; a rule whose condition is null is broken."""
    from corpuscle.operators.quality import issues

    out = F.when(F.lit(False), F.array().cast("array<string>"))
    for name, own in rules.items():
        out = out.when(F.col(source) == name, issues(own))
    return out.otherwise(F.array().cast("array<string>"))


def distinct_issues(df: DataFrame, issues: str) -> DataFrame:
    """(issue, n): every issue once, with its rows."""
    return df.select(F.explode(issues).alias("issue")).groupBy("issue").agg(F.count("*").alias("n"))


def coverage(df: DataFrame, by: str, mentions: dict[str, str], required: list[str]) -> DataFrame:
    """By file and in total (file null): rows, rows with mentions of each kind, their share, and rows that lack a field."""
    some = {name: F.count_if(F.greatest(F.size(c), F.lit(0)) > 0) for name, c in mentions.items()}
    missing = reduce(lambda a, b: a | b, (F.col(c).isNull() | (strip(F.col(c).cast("string")) == "") for c in required), F.lit(False))
    shares = [x for name, k in some.items() for x in (k.alias(f"with_{name}"), F.round(100.0 * k / F.count("*"), 6).alias(f"pct_{name}"))]
    return df.rollup(by).agg(F.count("*").alias("n"), *shares, F.count_if(missing).alias("structure_issues"))


def page_statistics(pages: DataFrame, by: str = "page_type") -> DataFrame:
    """By page type: pages, average sections in and out of time, pages with the former, sections and their characters.

    pages: temporal_sections, non_temporal_sections, sections (arrays of structs with content; null: none).
    """
    size = {c: F.greatest(F.size(c), F.lit(0)) for c in ("temporal_sections", "non_temporal_sections", "sections")}
    chars = sum((F.aggregate(F.coalesce(F.transform(c, lambda s: F.length(F.coalesce(s["content"], F.lit("")))), F.array().cast("array<int>")), F.lit(0).cast("long"), lambda a, x: a + x) for c in size), F.lit(0).cast("long"))
    total = F.sum(sum(size.values(), F.lit(0)))
    return pages.groupBy(by).agg(
        F.count("*").alias("pages"), F.round(F.avg(size["temporal_sections"]), 6).alias("avg_temporal"), F.count_if(size["temporal_sections"] > 0).alias("with_temporal"),
        F.round(F.avg(size["non_temporal_sections"]), 6).alias("avg_non_temporal"), total.cast("long").alias("sections"), F.sum(chars).cast("long").alias("content_chars"),
        F.round(F.coalesce(F.sum(chars) / F.nullif(total, F.lit(0)), F.lit(0.0)), 6).alias("avg_content"),
    )


def book_coverage(pages: DataFrame, by: str = "page_type") -> DataFrame:
    """(page type, book_number, n): sections in time by book."""
    rows = pages.select(by, F.explode("temporal_sections").alias("s")).select(by, F.col("s.book_number").alias("book_number"))
    return rows.filter("book_number is not null").groupBy(by, "book_number").agg(F.count("*").alias("n"))


def page_validation(pages: DataFrame, books: tuple[int, int] = (0, 14)) -> DataFrame:
    """One row: pages, those in time and with content out of time, empty sections and unknown books in time, valid."""
    filled = lambda c: F.coalesce(F.exists(c, lambda s: strip(F.coalesce(s["content"], F.lit(""))) != ""), F.lit(False)).cast("long")
    empty = F.size(F.filter("temporal_sections", lambda s: strip(F.coalesce(s["content"], F.lit(""))) == ""))
    wrong = F.size(F.filter("temporal_sections", lambda s: s["book_number"].isNotNull() & ~s["book_number"].between(*books)))
    at_least = lambda c: F.greatest(c, F.lit(0))
    n_wrong = F.coalesce(F.sum(at_least(wrong)), F.lit(0)).cast("long")
    return pages.agg(
        F.count("*").alias("total_pages"), F.count_if(F.size("temporal_sections") > 0).alias("pages_with_temporal"), F.coalesce(F.sum(filled("non_temporal_sections") + filled("sections")), F.lit(0)).cast("long").alias("pages_with_content"),
        F.coalesce(F.sum(at_least(empty)), F.lit(0)).cast("long").alias("empty_content_sections"), n_wrong.alias("invalid_book_numbers"), (n_wrong == 0).alias("valid"),
    )


def run_metrics(batches: DataFrame, tokens: str = "avg_tokens", seconds: str = "seconds", rows: str = "n") -> DataFrame:
    """One row over the batches of a run: batches, rows, the mean of the batches' means, time, and rows a second."""
    rate = F.sum(rows) / F.nullif(F.sum(seconds), F.lit(0.0))
    return batches.agg(F.count("*").alias("batches"), F.sum(rows).cast("long").alias("n"), F.round(F.avg(tokens), 6).alias("avg_tokens"), F.round(F.sum(seconds), 6).alias("seconds"), F.round(rate, 6).alias("rate"))


def render(df: DataFrame, title: str, most: int = 1000) -> str:
    """A report: the title, then one line a row of a small aggregate, sorted. More rows than `most` are an error."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report has at most {most} rows")
    shown = sorted("  ".join(f"{c}: {'-' if r[c] is None else r[c]}" for c in df.columns) for r in rows)
    return "\n".join([title, "=" * len(title), *shown, ""])
