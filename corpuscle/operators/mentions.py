"""Tagging text with the dictionary entries that it mentions.

A term matches where its tokens stand between single spaces. The plan is an equi-join of a
text's distinct n-grams with the terms, so only keys and n-grams travel; `contains` compares
every pair and is kept as a check and for tiny dictionaries; `regex` has word boundaries.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscle.functions.text import col, strip, word_ngrams
from corpuscle.operators import batches as B


def terms(dictionary: DataFrame) -> DataFrame:
    """(dict_name, term, canonical, n_tokens) of names and aliases; a later entry takes a shared term over."""
    spelled = dictionary.select("dict_name", "canonical", "ord", F.explode(F.concat(F.array("canonical"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("t"))
    spelled = spelled.select("dict_name", F.lower(strip("t")).alias("term"), "canonical", "ord").filter("term <> ''")
    last = spelled.groupBy("dict_name", "term").agg(F.max_by("canonical", F.struct("ord", "canonical")).alias("canonical"))
    return last.withColumn("n_tokens", F.size(F.split("term", " ", -1)))


def _automaton(key: str, found: list[tuple[str, str, str]]):
    """found: (dict_name, term, canonical), sent once with the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        machine, by = ahocorasick.Automaton(), {}
        for name, term, canonical in found:
            by.setdefault(f" {term} ", []).append((name, canonical))
        for pattern, values in by.items():
            machine.add_word(pattern, values)
        if by:
            machine.make_automaton()
        for batch in B.parts(batches):
            at, names, mentions = [], [], []
            for k, t in enumerate(batch.column("__t").to_pylist() if by else ()):
                own: dict[str, set[str]] = {}
                for _, values in machine.iter(t):
                    for name, canonical in values:
                        own.setdefault(name, set()).add(canonical)
                for name, tags in own.items():
                    at.append(k)
                    names.append(name)
                    mentions.append(sorted(tags))
            columns = [batch.column(key).take(pa.array(at, pa.int64())), pa.array(names, pa.string()), pa.array(mentions, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, names=[key, "dict_name", "mentions"])

    return run


def tag(df: DataFrame, key: str, text: str, dictionary: DataFrame, mode: str = "auto", most: int = 100_000) -> DataFrame:
    """(key, dict_name, mentions): sorted distinct canonical names; rows without a mention are left out.

    mode: 'auto' (the automaton up to `most` terms, else n-grams), 'ngram', 'contains' or 'regex'.
    In all but the first, a dictionary of at most `most` terms is broadcast.
    """
    own = terms(dictionary)
    size = own.agg(F.count("*").alias("n"), F.max("n_tokens").alias("longest")).first()
    padded = F.concat(F.lit(" "), F.lower(col(text)), F.lit(" "))
    if mode == "auto" and size.n <= most:
        rows = df.select(key, F.coalesce(padded, F.lit("")).alias("__t"))
        found = rows.mapInArrow(_automaton(key, [tuple(r) for r in own.select("dict_name", "term", "canonical").collect()]), f"{key} {df.schema[key].dataType.simpleString()}, dict_name string, mentions array<string>")
        return found.groupBy(key, "dict_name").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("mentions")))).alias("mentions"))
    mode = "ngram" if mode == "auto" else mode
    own = F.broadcast(own) if size.n <= most else own
    if mode == "ngram":
        # The generator keeps the tokens a column: inlined, they would be split again for each use.
        rows = df.select(key, F.explode(F.array(F.split(F.lower(col(text)), " ", -1))).alias("__tokens"))
        grams = rows.select(key, F.explode(F.array_distinct(word_ngrams("__tokens", size.longest or 1))).alias("term"))
        hits = grams.join(own, "term")
    elif mode == "contains":
        hits = df.select(key, padded.alias("__t")).join(own, F.expr("contains(__t, concat(' ', term, ' '))"))
    else:
        quoted = F.concat(F.lit("(?<![\\p{L}\\p{N}_])\\Q"), "term", F.lit("\\E(?![\\p{L}\\p{N}_])"))
        hits = df.select(key, F.lower(col(text)).alias("__t")).join(own.withColumn("__p", quoted), F.expr("rlike(__t, __p)"))
    return hits.groupBy(key, "dict_name").agg(F.array_sort(F.collect_set("canonical")).alias("mentions"))


def with_topic(mentions: DataFrame, topics: DataFrame, key: str, dictionary: DataFrame) -> DataFrame:
    """Add each row's own topic (key, topic) where some canonical name equals it but for case."""
    known = dictionary.select("dict_name", F.lower("canonical").alias("__c")).distinct()
    own = topics.join(known, F.lower("topic") == F.col("__c")).select(key, "dict_name", F.array("topic").alias("mentions"))
    return mentions.union(own).groupBy(key, "dict_name").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("mentions")))).alias("mentions"))


def counters(tagged: DataFrame, n_rows: DataFrame) -> DataFrame:
    """By dictionary: rows with a mention, mentions, and the share of all rows (one row, column n)."""
    by = tagged.groupBy("dict_name").agg(F.count("*").alias("rows_with"), F.sum(F.size("mentions")).alias("mentions"))
    return by.crossJoin(F.broadcast(n_rows)).select("dict_name", "rows_with", "mentions", F.round(100.0 * F.col("rows_with") / F.col("n"), 6).alias("pct"))


def enrich(df: DataFrame, key: str, text: str, dictionary: DataFrame, names: list[str], mode: str = "auto", topic: str | None = None) -> DataFrame:
    """All rows and columns with one array `<name>_mentions` a dictionary, empty without a mention. Keys are unique.

    topic: a column with what the row is about, which counts as mentioned where it is a canonical name.
    """
    found = tag(df, key, text, dictionary, mode)
    if topic:
        found = with_topic(found, df.select(key, F.col(topic).alias("topic")), key, dictionary)
    found = found.groupBy(key).pivot("dict_name", names).agg(F.first("mentions"))
    empty = F.array().cast("array<string>")
    found = found.select(F.col(key).alias("__key"), *(F.col(n).alias(f"{n}_mentions") for n in names))
    out = df.join(found, F.col(key) == F.col("__key"), "left").drop("__key")
    return out.withColumns({f"{n}_mentions": F.coalesce(f"{n}_mentions", empty) for n in names})
