"""Name resolution: candidate lists, aliases, redirects and precedence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuscle.functions.text import col, straight_apostrophes


def glossary_candidates(term: str | Column) -> Column:
    """File names to try for a term, in order; the first that exists is its page."""
    t = straight_apostrophes(term)
    under = lambda c: F.translate(c, " ", "_")
    comma = F.contains(t, F.lit(", "))
    last, first = F.split(t, ", ", 2)[0], F.coalesce(F.try_element_at(F.split(t, ", ", 2), F.lit(2)), F.lit(""))
    final_word = F.element_at(F.split(first, " "), -1)
    none = F.array().cast("array<string>")
    house = F.when(F.contains(t, F.lit(" of House ")), F.array(F.split(t, " ")[0])).otherwise(none)
    the = F.when(t.endswith(", the"), F.array(F.concat(F.lit("The_"), under(last)), under(last))).otherwise(none)
    upper = F.when(t.endswith(", The"), F.array(F.concat(F.lit("The_"), under(last)))).otherwise(none)
    a = F.when(t.endswith(", A"), F.array(F.concat(F.lit("A_"), under(last)))).otherwise(none)
    swapped = F.array(
        under(F.concat_ws("_", first, last)), under(F.concat_ws("_", F.concat(F.upper(F.substring(first, 1, 1)), F.substring(first, F.lit(2), F.length(first))), last)),
        under(last), F.lower(under(F.concat_ws("_", first, last))), F.concat_ws("_", first, last), under(F.concat_ws("_", final_word, last)),
    )
    plain = F.array(under(t), F.lower(under(t)), under(F.initcap(t)))
    always = F.array(t, under(t), F.lower(under(t)))
    names = F.concat(house, the, upper, a, F.when(comma, swapped).otherwise(plain), always)
    return F.array_distinct(F.transform(names, lambda n: F.concat(n, F.lit(".txt"))))


def first_match(df: DataFrame, key: str, candidates: Column, known: DataFrame, name: str) -> DataFrame:
    """(key, match): the first candidate that `known` has in column `name`; null without one.

    An equi-join on the exploded candidates, so `known` is hashed whatever its size.
    """
    tried = df.select(key, F.posexplode(candidates).alias("__pos", "__name"))
    hits = tried.join(known.select(F.col(name).alias("__name")).distinct(), "__name")
    best = hits.groupBy(key).agg(F.min_by("__name", "__pos").alias("match"))
    return df.select(key).distinct().join(best, key, "left")


def unmatched(df: DataFrame, key: str, known: DataFrame, name: str | None = None) -> DataFrame:
    """The rows whose key isn't known."""
    return df.join(known.select(F.col(name or key).alias(key)), key, "left_anti")


def matched(df: DataFrame, key: str, known: DataFrame, name: str | None = None) -> DataFrame:
    """The rows whose key is known."""
    return df.join(known.select(F.col(name or key).alias(key)), key, "left_semi")


def invert(df: DataFrame, key: str, value: str, out: str = "values") -> DataFrame:
    """By value, its keys, sorted. Meant for lists that are small for each value."""
    return df.groupBy(value).agg(F.array_sort(F.collect_list(key)).alias(out))


def first_wins(df: DataFrame, key: str, order: list[str], *values: str) -> DataFrame:
    return df.groupBy(key).agg(*(F.min_by(v, F.struct(*order)).alias(v) for v in values))


def last_wins(df: DataFrame, key: str, order: list[str], *values: str) -> DataFrame:
    return df.groupBy(key).agg(*(F.max_by(v, F.struct(*order)).alias(v) for v in values))


def keep_largest(df: DataFrame, key: Column, size: Column, *ties: str) -> DataFrame:
    """One row a key: the largest, then the first by `ties`. Spark cuts groups before it sorts them."""
    w = Window.partitionBy("__k").orderBy(F.desc("__s"), *ties)
    rows = df.withColumns({"__k": key, "__s": size})
    return rows.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n", "__k", "__s")


def by_alias(names: DataFrame, name: str, aliases: DataFrame) -> DataFrame:
    """(name, canonical) case-insensitively; aliases: canonical, alias, ord. The first declared wins."""
    first = aliases.groupBy(F.lower("alias").alias("__a")).agg(F.min_by("canonical", F.struct("ord", "canonical")).alias("canonical"))
    return names.join(first, F.lower(col(name)) == F.col("__a"), "left").drop("__a")


def collision_names(df: DataFrame, name: str, *order: str) -> DataFrame:
    """Add file_name: later names that differ only in case get '_DUPLICATE_n', n the next number that no given name has.

    A number is taken where some name is the same base with it, but for case. The i-th taken number t leaves
    t - i free ones before it, so the n-th later name skips those with t - i < n: a running count in the base's window.
    """
    base = F.lower(name)
    w = Window.partitionBy("__base")
    rows = df.withColumn("__base", base).withColumn("__n", F.row_number().over(w.orderBy(*order)).cast("long") - 1)
    pattern = r"(?s)^(.*)_duplicate_([1-9][0-9]{0,17})$"
    taken = df.select(base.alias("__name")).distinct().filter(F.regexp_like("__name", F.lit(pattern)))
    taken = taken.select(F.regexp_extract("__name", pattern, 1).alias("__base"), F.regexp_extract("__name", pattern, 2).cast("long").alias("__t"))
    taken = taken.select("__base", (F.col("__t") - F.row_number().over(w.orderBy("__t")) + 1).alias("__n"))
    both = rows.withColumn("__row", F.lit(1)).unionByName(taken.withColumn("__row", F.lit(0)), allowMissingColumns=True)
    skipped = F.sum(1 - F.col("__row")).over(w.orderBy("__n", "__row").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    number = (F.col("__n") + skipped).cast("string")
    named = both.withColumn("file_name", F.when(F.col("__n") == 0, col(name)).otherwise(F.concat(col(name), F.lit("_DUPLICATE_"), number)))
    return named.filter("__row = 1").drop("__base", "__n", "__row")


def without_existing(df: DataFrame, key: str, done: DataFrame) -> DataFrame:
    """Incremental work: rows whose key has no output yet."""
    return unmatched(df, key, done)
