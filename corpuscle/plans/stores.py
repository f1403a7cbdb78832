"""Queries over what Spark writes from the tables and reads again: ordered files, stores and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from corpuscle.durable import shared_folder
from corpuscle.operators import accounting, mentions
from corpuscle.session import table
from corpuscle.sources import collection, lines, sinks
from corpuscle.streaming import embedding, state

from .catalog import query
from .documents import _TAGGED, WORDS, dictionary


def _folder(spark, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query("""SELECT 'part=' || doc_id // 500 AS part, CAST(row_number() OVER (PARTITION BY doc_id // 500 ORDER BY doc_id) - 1 AS BIGINT) AS ord, doc_id, text FROM documents""")
def json_lines_in_order(spark, sf_dir):
    """Documents written as JSON lines, 500 ids a file, and read back in place over ranges of 256 KB."""
    to = _folder(spark, "lines")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.expr("doc_id DIV 500").alias("part"))
    docs.repartition("part").sortWithinPartitions("part", "doc_id").write.partitionBy("part").json(to)
    rows = lines.json_records(lines.ordered_lines(spark, to, "*.json", 256 << 10), "doc_id long, text string")
    return rows.filter("_corrupt IS NULL").select(F.split_part("file", F.lit("/"), F.lit(1)).alias("part"), "ord", "doc_id", "text")


@query("""SELECT user_id, first_id, first_type, last_id, last_type FROM (SELECT user_id, min(event_id) AS first_id, arg_min(event_type, event_id) AS first_type, max(event_id) AS last_id, arg_max(event_type, event_id) AS last_type FROM events GROUP BY user_id)""")
def stream_winners(spark, sf_dir):
    """First and last event of each user, from a stream of shuffled files."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    out = []
    for name, first in (("first", True), ("last", False)):
        to = _folder(spark, name)
        found = state.winners(state.replayed(events, "event_id", 4), "user_id", "ts", ["event_id"], ["event_type"], first, "60 days")
        state.upsert(found, f"{to}/updates", f"{to}/checkpoint")
        out.append(state.current(spark, f"{to}/updates", "user_id").select("user_id", F.col("event_id").alias(f"{name}_id"), F.col("event_type").alias(f"{name}_type")))
    return out[0].join(out[1], "user_id")


@query("SELECT CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT doc_id) AS BIGINT) AS n_keys, true AS complete FROM documents")
def embed_stream(spark, sf_dir):
    """All documents embedded by a stream over files; the progress table against the vectors."""
    source, to = _folder(spark, "docs"), _folder(spark, "vectors")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    docs.repartition("doc_id").write.parquet(source)  # files of a bounded size, more of them for more documents
    embedding.run(spark, source, "doc_id long, text string", "doc_id", "text", to, files=16)
    done = embedding.progress(spark, to).agg(F.sum("n_vectors").alias("done"))
    have = embedding.vectors(spark, to).agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("n_keys"))
    return have.crossJoin(done).select("n", "n_keys", (F.col("done") == F.col("n")).alias("complete"))  # one row each


@query("SELECT 'label_' || label AS collection, count(*) AS n, count(*) AS committed, CAST(min(vec_id) AS BIGINT) AS first_id, CAST(max(vec_id) AS BIGINT) AS last_id FROM embeddings WHERE label IS NOT NULL GROUP BY label")
def collection_commit(spark, sf_dir):
    """Vectors stored as a collection a label: rows read again beside the counts that the tasks reported."""
    to = _folder(spark, "store")
    rows = table(spark, sf_dir, "embeddings").filter("label IS NOT NULL").withColumn("collection", F.concat(F.lit("label_"), F.col("label").cast("string")))
    committed = spark.createDataFrame(list(collection.put(rows, to, key="vec_id").items()), "collection string, committed long")
    have = collection.opened(spark, to).groupBy("collection").agg(F.count("*").alias("n"), F.min("vec_id").alias("first_id"), F.max("vec_id").alias("last_id"))
    return have.join(committed, "collection", "left").select("collection", "n", "committed", "first_id", "last_id")


@query("""SELECT coalesce(s.doc_id, d.doc_id) AS doc_id, CASE WHEN s.doc_id IS NULL THEN d.n_chars ELSE -s.n_chars END AS n_chars, CASE WHEN coalesce(s.doc_id, d.doc_id) // 100 IN (1, 3) THEN 'merged' ELSE 'kept' END AS state
FROM documents d FULL OUTER JOIN (SELECT doc_id + 50 AS doc_id, n_chars FROM documents WHERE doc_id BETWEEN 100 AND 149 OR doc_id BETWEEN 250 AND 349) s ON s.doc_id = d.doc_id""")
def folder_merge(spark, sf_dir):
    """A second folder copied into one of documents by ranges of ids; ranges that it doesn't touch keep their files."""
    to = _folder(spark, "merge")
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    part = F.expr("doc_id DIV 100").alias("part")
    docs.select("*", part).repartition("part").write.partitionBy("part").parquet(to)
    path = F.col("_metadata.file_path").alias("file")
    before = spark.read.parquet(to).select(path).distinct().collect()  # a file a hundred ids
    own = docs.filter("doc_id BETWEEN 100 AND 149 OR doc_id BETWEEN 250 AND 349").select((F.col("doc_id") + 50).alias("doc_id"), (-F.col("n_chars")).alias("n_chars"))
    sinks.merged_folder(to, own.select("*", part), "doc_id", "part")
    rows = spark.read.parquet(to)
    files = spark.createDataFrame(before, "file string")
    old = rows.select("doc_id", "n_chars", path).join(files.withColumn("state", F.lit("kept")), "file", "left")
    return old.select("doc_id", "n_chars", F.coalesce("state", F.lit("merged")).alias("state"))


@query(f"SELECT dict_name, count(*) AS rows_with, CAST(sum(len(string_split(mentions, ','))) AS BIGINT) AS mentions, CAST((SELECT count(*) FROM documents) AS BIGINT) AS n_rows FROM ({_TAGGED}) GROUP BY dict_name")
def enrichment_counters(spark, sf_dir):
    """Mentions by dictionary, counted while the enriched rows are written."""
    names = sorted({w[0] for w in WORDS})
    rows = mentions.enrich(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text", dictionary(spark), names)
    _, seen = accounting.written_with(rows, **accounting.mention_totals(names))
    found = [(n, seen[f"{n}_rows"], seen[f"{n}_mentions"], seen["n_rows"]) for n in names if seen[f"{n}_rows"]]
    return spark.createDataFrame(found, "dict_name string, rows_with long, mentions long, n_rows long")


@query(r"""SELECT page_id, CASE WHEN strlen(html) % 5 = 0 THEN 'error' WHEN n = 0 THEN 'skipped' ELSE 'ok' END AS status, CASE WHEN strlen(html) % 5 = 0 THEN 0 ELSE n END AS n_rows
FROM (SELECT page_id, html, CAST(len(regexp_extract_all(html, '<h[12][^>]*>')) AS BIGINT) AS n FROM pages)""")
def page_outcomes(spark, sf_dir):
    """Heads of pages by a parser that fails on some: every page is accounted for as ok, skipped or error."""
    import re

    def heads(html: str) -> list[tuple]:
        if len(html.encode()) % 5 == 0:
            raise ValueError("refused")
        return [(h,) for h in re.findall(r"<h[12][^>]*>", html)]

    rows = accounting.guarded(table(spark, sf_dir, "pages"), "page_id", "html", heads, "head string")
    return accounting.outcome(rows, "page_id").select("page_id", "status", "n_rows")
