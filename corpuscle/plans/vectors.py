"""Queries over embeddings, collections and questions."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuscle.functions import text as T
from corpuscle.functions import vector
from corpuscle.operators import collections as C
from corpuscle.operators import embed, mentions
from corpuscle.operators import retrieval as R
from corpuscle.session import table

from .catalog import query
from .documents import _TAGGED, dictionary

#: A query vector of 64 dimensions, the same in both languages.
VECTOR = [round(((i * 37) % 64 - 31.5) / 100, 4) for i in range(64)]
_V = "[" + ", ".join(map(str, VECTOR)) + "]"
_D = f"round(list_sum(list_transform(range(1, 65), lambda i: (CAST(embedding[i] AS DOUBLE) - CAST({_V}[i] AS DOUBLE)) * (CAST(embedding[i] AS DOUBLE) - CAST({_V}[i] AS DOUBLE)))), 6)"
QUESTION = "what is the and of ing"
_TEXTS = "SELECT e.vec_id, e.label, e.embedding, d.text FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id"


def _texts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), "text")
    return table(spark, sf_dir, "embeddings").join(docs, "vec_id")


@query(f"SELECT vec_id, label, {_D} AS distance FROM embeddings ORDER BY distance, vec_id LIMIT 20")
def knn_topk(spark, sf_dir):
    return R.knn(table(spark, sf_dir, "embeddings"), VECTOR, 20, "vec_id").select("vec_id", "label", "distance")


_ORDER = "CASE WHEN label <= 7 THEN label END"


def _ordered(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").withColumn("temporal_order", F.when(F.col("label") <= 7, F.col("label")))


@query(
    f"""SELECT vec_id, temporal_order, distance FROM (SELECT vec_id, {_ORDER} AS temporal_order, {_D} AS distance FROM embeddings ORDER BY distance, vec_id LIMIT 30)
WHERE temporal_order IS NULL OR temporal_order <= 4 ORDER BY distance, vec_id LIMIT 10"""
)
def knn_temporal_post(spark, sf_dir):
    return R.knn_bounded(_ordered(spark, sf_dir), VECTOR, 10, "vec_id", "temporal_order", 4, "post").select("vec_id", "temporal_order", "distance")


@query(f"SELECT vec_id, {_ORDER} AS temporal_order, {_D} AS distance FROM embeddings WHERE {_ORDER} IS NULL OR {_ORDER} <= 4 ORDER BY distance, vec_id LIMIT 10")
def knn_temporal_pre(spark, sf_dir):
    return R.knn_bounded(_ordered(spark, sf_dir), VECTOR, 10, "vec_id", "temporal_order", 4).select("vec_id", "temporal_order", "distance")


_HITS = " + ".join(f"CAST(contains(lower(text), '{t}') AS BIGINT)" for t in QUESTION.split())
_HITS_LONG = " + ".join(f"CAST(contains(lower(text), '{t}') AS BIGINT)" for t in QUESTION.split() if len(t) > 2)


@query(f"SELECT doc_id, {_HITS} AS score FROM documents WHERE {_HITS} > 0 ORDER BY score DESC, doc_id LIMIT 20")
def keyword_search(spark, sf_dir):
    return R.keyword_search(table(spark, sf_dir, "documents"), QUESTION, 20, "doc_id").select("doc_id", "score")


@query(
    f"""SELECT vec_id, distance, round(1 / (1 + distance) + 0.1 * ({_HITS_LONG}), 6) AS boosted_score FROM (SELECT *, {_D} AS distance FROM ({_TEXTS}) ORDER BY distance, vec_id LIMIT 50)
ORDER BY boosted_score DESC, distance, vec_id LIMIT 10"""
)
def hybrid_query(spark, sf_dir):
    return R.hybrid(_texts(spark, sf_dir), QUESTION, VECTOR, 10, "vec_id").select("vec_id", "distance", "boosted_score")


#: Ordered routing rules and typed keywords over the sample's syllables.
RULES = [("magic", ("ing the", "tion of")), ("concepts", ("de la", "der")), ("narrative", ("the ",))]
TYPES = [("character", ("er ", "or")), ("event", ("ing", "ed ")), ("place", ("the", "in "))]
_CASE = "CASE " + " ".join(f"WHEN {' OR '.join(f"contains(lower(text), '{w}')" for w in ws)} THEN '{n}'" for n, ws in RULES) + " ELSE 'all' END"
_SCORE = {n: " + ".join(f"CAST(contains(lower(text), '{w}') AS BIGINT)" for w in ws) for n, ws in TYPES}


@query(f"SELECT item_id, {_CASE} AS collection FROM benchmark")
def auto_route(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", R.route(F.col("text"), RULES, "all").alias("collection"))


@query(
    f"""SELECT item_id, CASE WHEN greatest(a, b, c) = 0 THEN 'general' WHEN a >= b AND a >= c THEN 'character' WHEN b >= c THEN 'event' ELSE 'place' END AS query_type
FROM (SELECT item_id, {_SCORE['character']} AS a, {_SCORE['event']} AS b, {_SCORE['place']} AS c FROM benchmark)"""
)
def classify_query(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", R.classify(F.col("text"), TYPES, "general").alias("query_type"))


@query(
    r"""SELECT item_id, CASE WHEN k = '' THEN text ELSE k END AS preprocessed FROM (SELECT item_id, text, array_to_string(list_filter(regexp_split_to_array(lower(regexp_replace(text, '^\s+|\s+$', '', 'g')), '\s+'),
lambda t: t NOT IN ('how', 'does', 'do', 'what', 'is', 'are', 'the', 'a', 'an')), ' ') AS k FROM benchmark)"""
)
def preprocess_query(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", T.without_stop_words("text").alias("preprocessed"))


@query("SELECT e.vec_id, round(sum(CAST(a AS DOUBLE) * CAST(b AS DOUBLE)) / (sqrt(sum(CAST(a AS DOUBLE) * CAST(a AS DOUBLE))) * sqrt(sum(CAST(b AS DOUBLE) * CAST(b AS DOUBLE)))), 6) AS cosine FROM (SELECT vec_id, unnest(embedding) AS a, unnest(" + _V + ") AS b FROM embeddings) e GROUP BY e.vec_id")
def cosine_check(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(vector.cosine("embedding", vector.literal(VECTOR)), 6).alias("cosine"))


@query("""SELECT 'documents_' || doc_id AS id, length(text) AS chars FROM documents UNION ALL SELECT 'benchmark_' || item_id, length(text) FROM benchmark
UNION ALL SELECT 'conversations_' || conv_id || '-' || turn, length(text) FROM conversations""")
def collections_union(spark, sf_dir):
    """Three sources in one collection, ids prefixed."""
    turns = table(spark, sf_dir, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("id"), "text")
    parts = {"documents": table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"), "benchmark": table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text"), "conversations": turns}
    return C.union(parts, "id").select("id", F.length("text").cast("long").alias("chars"))


@query(f"SELECT doc_id, mentions FROM ({_TAGGED}) WHERE dict_name = 'de' AND len(string_split(mentions, ',')) > 0")
def collection_filter(spark, sf_dir):
    """Documents with at least one mention of one dictionary."""
    tagged = mentions.tag(table(spark, sf_dir, "documents"), "doc_id", "text", dictionary(spark).filter("dict_name = 'de'"))
    return C.with_mentions(tagged, "mentions").select("doc_id", F.array_join("mentions", ",").alias("mentions"))


@query("""SELECT collection, n, expected, coalesce(n = expected, n > 0) AS ok FROM (SELECT 'a' AS collection, (SELECT count(*) FROM embeddings WHERE label < 5) AS n, CAST(NULL AS BIGINT) AS expected
UNION ALL SELECT 'b', (SELECT count(*) FROM embeddings WHERE label >= 5), CAST(7 AS BIGINT) UNION ALL SELECT 'c', 0, CAST(0 AS BIGINT))""")
def collection_counts(spark, sf_dir):
    expected = spark.createDataFrame([("a", None), ("b", 7), ("c", 0)], "collection string, expected long")
    rows = table(spark, sf_dir, "embeddings").select(F.when(F.col("label") < 5, "a").otherwise("b").alias("collection"))
    return C.count_report(rows, expected)


@query("SELECT event_id, coalesce(CAST(user_id AS VARCHAR), 'null') AS user_id, coalesce(event_type, 'null') AS event_type, coalesce(props, 'null') AS props FROM events")
def metadata_flatten(spark, sf_dir):
    return C.flatten_metadata(table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "props"), "event_id")


@query()
def embed_batch(spark, sf_dir):
    return embed.embed(table(spark, sf_dir, "benchmark"), "item_id", "text")


@query()
def embed_resume(spark, sf_dir):
    """Only items that no vector has yet."""
    return embed.embed_missing(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id", "text")
