"""Ordered classification of rows by category sets and taxonomies (which are input frames)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def has_any(cats: Column, wanted: list[str]) -> Column:
    """Whether some category is in the list, but for case."""
    return F.arrays_overlap(F.transform(cats, F.lower), F.array(*(F.lit(w.lower()) for w in wanted)).cast("array<string>"))


def is_redirect(cats: Column, redirects: list[str]) -> Column:
    """Whether a page only points to another: it has no category, or one of the redirect categories, but for case."""
    return F.coalesce(F.size(cats) == 0, F.lit(True)) | F.coalesce(has_any(cats, redirects), F.lit(False))


def page_type(cats: Column, rules: list[tuple[str, list[str]]], blocked: list[str], default: str = "CONCEPT", redirects: list[str] = ()) -> Column:
    """The first rule that a category meets; SKIP without categories or with a blocked or redirect one."""
    out = F.when(has_any(cats, blocked), "SKIP").when(is_redirect(cats, redirects), "SKIP")
    for name, wanted in rules:
        out = out.when(has_any(cats, wanted), name)
    return out.otherwise(default)


def by_taxonomy(df: DataFrame, key: str, cats: Column, taxonomy: DataFrame, exclude: list[str] = ()) -> DataFrame:
    """(key, group): the group of highest priority (least number) of which a keyword is part of a category.

    Case and underscores don't matter. Rows with an excluded keyword or without a hit have none.
    Every distinct category is decided once, by an equi-join on the keywords' first three characters, which a category that
    contains one has somewhere; rows then meet the decided categories.
    """
    low = F.transform(cats, lambda c: F.lower(F.translate(c, "_", " ")))
    rows = df.select(key, low.alias("__cats"))
    if exclude:
        bad = F.exists("__cats", lambda c: F.exists(F.array(*(F.lit(e.lower()) for e in exclude)), lambda e: F.contains(c, e)))
        rows = rows.filter(~F.coalesce(bad, F.lit(False)))
    own = rows.select(key, F.explode("__cats").alias("__cat"))
    each = own.select("__cat").distinct()
    at = F.when(F.length("__cat") > 0, F.sequence(F.lit(1), F.length("__cat"))).otherwise(F.array().cast("array<int>"))
    grams = F.flatten(F.transform(at, lambda i: F.array(*(F.substring("__cat", i, F.lit(n)) for n in (1, 2, 3)))))
    each = each.select("__cat", F.explode(F.array_distinct(F.concat(F.array(F.lit("")), grams))).alias("__gram"))
    word = F.lower(F.translate("category", "_", " "))
    known = taxonomy.select("group", "group_priority", word.alias("__word"), F.substring(word, 1, 3).alias("__gram"))
    hits = each.join(known, "__gram").filter(F.contains("__cat", F.col("__word")))
    first = hits.groupBy("__cat").agg(F.min(F.struct("group_priority", "group")).alias("__first"))
    best = own.join(first, "__cat").groupBy(key).agg(F.min("__first")["group"].alias("group"))
    return df.select(key).join(best, key, "left")


def by_first_category(df: DataFrame, key: str, cats: Column, taxonomy: DataFrame) -> DataFrame:
    """(key, group) of the first category that is in the taxonomy, groups by priority; none without."""
    rows = df.select(key, F.posexplode(cats).alias("__pos", "category"))
    best = rows.join(taxonomy, "category").groupBy(key).agg(F.min_by("group", F.struct("__pos", "group_priority")).alias("group"))
    return df.select(key).join(best, key, "left")


def attributes(cats: Column, values: dict[str, str]) -> Column:
    """Sorted distinct values of the categories that have one."""
    of = F.create_map(*(F.lit(x) for kv in values.items() for x in kv))
    return F.array_sort(F.array_distinct(F.filter(F.transform(cats, lambda c: of[c]), lambda v: v.isNotNull())))
