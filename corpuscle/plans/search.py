"""Queries over indexes and tables of questions."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuscle.operators import postings, quantize, retrieval, topk
from corpuscle.session import table

from .catalog import query
from .vectors import _CASE, RULES

KEYWORDS = "Apache license @example to"
_FOUND = " + ".join(f"CAST(contains(lower(text), '{t}') AS BIGINT)" for t in KEYWORDS.lower().split())


@query(f"SELECT doc_id, {_FOUND} AS score FROM documents WHERE {_FOUND} > 0 ORDER BY score DESC, doc_id LIMIT 50")
def posting_search(spark, sf_dir):
    """Keyword search through posting lists of q-grams; the rows of the full scan."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return postings.search(docs, postings.index(docs, "doc_id"), KEYWORDS, 50, "doc_id").select("doc_id", "score")


_PARTS = {"magic": "label < 4", "concepts": "label BETWEEN 4 AND 6", "narrative": "label > 6", "all": "true"}
_WHERE = " OR ".join(f"(route = '{n}' AND {c})" for n, c in _PARTS.items())


@query(f"""WITH asked AS (SELECT item_id, text, {_CASE} AS route, list_transform(e.embedding, lambda x: CAST(x AS DOUBLE)) AS q FROM benchmark JOIN embeddings e ON e.vec_id = item_id),
rows AS (SELECT e.vec_id, e.label, list_transform(e.embedding, lambda x: CAST(x AS DOUBLE)) AS v, lower(d.text) AS low FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id),
near AS (SELECT item_id, route, text, vec_id, low, round(list_sum(list_transform(range(1, len(q) + 1), lambda i: (q[i] - v[i]) * (q[i] - v[i]))), 6) AS distance FROM asked JOIN rows ON {_WHERE}),
cut AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY distance, vec_id) AS rn FROM near),
scored AS (SELECT item_id, route, vec_id, distance, round(1 / (1 + distance) + 0.1 * list_sum(list_transform(list_filter(regexp_split_to_array(lower(regexp_replace(text, '^\\s+|\\s+$', '', 'g')), '\\s+'), lambda t: length(t) > 2),
  lambda t: CAST(contains(low, t) AS BIGINT))), 6) AS boosted_score FROM cut WHERE rn <= 25)
SELECT item_id, route AS collection, vec_id, distance, boosted_score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY boosted_score DESC, distance, vec_id) AS rn FROM scored) WHERE rn <= 5""")
def question_search(spark, sf_dir):
    """Every benchmark item as a question: routed to a collection and searched there by vector and terms, in one plan."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), "text")
    vectors = table(spark, sf_dir, "embeddings")
    rows = vectors.join(docs, "vec_id").select("vec_id", "label", "embedding", "text")
    asked = table(spark, sf_dir, "benchmark").join(vectors.select(F.col("vec_id").alias("item_id"), "embedding"), "item_id")
    parts = {n: rows.filter(c).drop("label") for n, c in _PARTS.items()}
    found = topk.search_all(asked, parts, retrieval.route(F.col("text"), RULES, "all"), 5, "vec_id", "item_id")
    return found.select(F.col("query").alias("item_id"), "collection", "vec_id", "distance", "boosted_score")


@query("""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
near AS (SELECT q.vec_id AS query, r.vec_id, round(list_sum(list_transform(range(1, 65), lambda i: (q.v[i] - r.v[i]) * (q.v[i] - r.v[i]))), 6) AS distance FROM v q JOIN v r ON q.vec_id % 100 = 0)
SELECT query, vec_id, distance FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY distance, vec_id) AS rn FROM near) WHERE rn <= 10""")
def nearest_of_many(spark, sf_dir):
    """The ten nearest of every vector whose id is divisible by 100, exactly, by merged heaps."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return topk.nearest(vectors, vectors.filter("vec_id % 100 = 0").withColumnRenamed("vec_id", "query"), 10, "vec_id")


@query()
def quantized_neighbours(spark, sf_dir):
    """The same by product quantisation: 100 exact comparisons a question, however many rows."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    book = quantize.fit(vectors)
    questions = vectors.filter("vec_id % 100 = 0").withColumnRenamed("vec_id", "query")
    return quantize.search(quantize.index(vectors, book, "vec_id"), questions, book, 10, "vec_id")
