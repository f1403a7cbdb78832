"""Chunks of typed pages whose texts pass the limit: each document as a page, a chapter or a section in time."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuscle import schemas
from corpuscle.config import Config
from corpuscle.operators import chunking, pages
from corpuscle.session import table

from .catalog import query

_CFG = Config()
_STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
_PAR = "chr(10) || chr(10)"


def _packed(sections: str, limit: int = _CFG.chunk_max) -> str:
    """CTEs up to `chunks` (k, chunk_index, titles, text): the rows (k, o, title, text) of `sections` packed by k in the order of o."""
    fits = f"a.g = f.g AND length(f.cur) + length(a.sep) + length(a.part) <= {limit}"
    return f"""secs AS ({sections}),
paras AS (SELECT k, o, title, i, {_STRIP.format("p[i]")} AS para FROM (SELECT k, o, title, regexp_split_to_array(text, '\\n\\s*\\n+') AS p FROM secs WHERE length(text) > {limit}), unnest(range(1, len(p) + 1)) AS r(i)),
sents AS (SELECT k, o, title, i, j, {_STRIP.format("s[j]")} AS sent FROM (SELECT *, string_split(regexp_replace(para, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)) AS s FROM paras WHERE length(para) > {limit}), unnest(range(1, len(s) + 1)) AS r(j)),
cuts AS (SELECT k, o, title, i, j, c, substr(sent, c * {limit} + 1, {limit}) AS part, length(sent) AS n FROM sents, unnest(range(0, (length(sent) - 1) // {limit} + 1)) AS r(c) WHERE sent <> ''),
atoms AS (SELECT k, row_number() OVER (PARTITION BY k ORDER BY o, i, j, c) AS rn, title, g, sep, part FROM (
  SELECT k, o, 0 AS i, 0 AS j, 0 AS c, title, 'whole' AS g, {_PAR} AS sep, {_STRIP.format("text")} AS part FROM secs WHERE text <> '' AND length(text) <= {limit}
  UNION ALL SELECT k, o, i, 0, 0, title, o || '', {_PAR}, para FROM paras WHERE para <> '' AND length(para) <= {limit}
  UNION ALL SELECT k, o, i, j, c, title, o || ':' || i || CASE WHEN n <= {limit} THEN '' ELSE ':' || j || ':' || c END, ' ', part FROM cuts)),
fold AS (
  SELECT k, rn, g, title AS titles, part AS cur, 1 AS chunk_index FROM atoms WHERE rn = 1
  UNION ALL
  SELECT a.k, a.rn, a.g, CASE WHEN {fits} AND a.g = 'whole' THEN f.titles || ', ' || a.title ELSE a.title END, CASE WHEN {fits} THEN f.cur || a.sep || a.part ELSE a.part END, f.chunk_index + CASE WHEN {fits} THEN 0 ELSE 1 END
  FROM fold f JOIN atoms a ON a.k = f.k AND a.rn = f.rn + 1
),
chunks AS (SELECT k, chunk_index, arg_max(titles, rn) AS titles, arg_max(cur, rn) AS text FROM fold GROUP BY k, chunk_index)"""


def _windows(source: str) -> str:
    """CTEs up to `numbered` (k, chunk_index, total_chunks, text): the rows (k, o, text) of `source`, those over the target cut into overlapping windows."""

    def stop(start: str) -> str:
        n = "length(text)"
        mark = f"length(regexp_extract(substr(text, {start} + 1, least({_CFG.chunk_target + 200}, {n} - {start})), '(?s)^(.*)[.!?] ', 1))"
        space = f"length(regexp_extract(substr(text, {start} + 1, least({_CFG.chunk_max}, {n} - {start})), '(?s)^(.*) ', 1))"
        return f"CASE WHEN {start} + {_CFG.chunk_target} >= {n} THEN NULL WHEN {mark} > 0 THEN {start} + {mark} + 1 WHEN {space} > 0 THEN {start} + {space} ELSE least({start} + {_CFG.chunk_max}, {n}) END"

    return f"""wins AS (
  SELECT k, o, text, 1 AS w, 0 AS start, {stop("0")} AS stop FROM ({source}) WHERE length(text) > {_CFG.chunk_target}
  UNION ALL
  SELECT k, o, text, w + 1, nxt, {stop("nxt")} FROM (SELECT *, CASE WHEN stop - {_CFG.chunk_overlap} > start THEN stop - {_CFG.chunk_overlap} ELSE stop END AS nxt FROM wins WHERE stop IS NOT NULL) WHERE nxt < length(text)
),
numbered AS (SELECT k, CAST(row_number() OVER (PARTITION BY k ORDER BY o, w) AS BIGINT) AS chunk_index, CAST(count(*) OVER (PARTITION BY k) AS BIGINT) AS total_chunks, text FROM (
  SELECT k, o, 0 AS w, text FROM ({source}) WHERE length(text) <= {_CFG.chunk_target}
  UNION ALL SELECT k, o, w, {_STRIP.format("substr(text, start + 1, coalesce(stop, length(text)) - start)")} FROM wins))"""


_NUMBERED = "CAST(chunk_index AS BIGINT) AS chunk_index, CAST(count(*) OVER (PARTITION BY k) AS BIGINT) AS total_chunks, text"


def _pages(spark, sf_dir):
    """Documents as pages: a section of the whole text, one with a part only, and one of categories."""
    none = F.array().cast("array<struct<level:int,title:string,content:string>>")
    part = F.array(F.struct(F.lit(3).alias("level"), F.col("source").alias("title"), F.concat(F.lit("Of "), "lang").alias("content")))
    rows = [("Overview", F.col("text"), none), ("Origin", F.lit(""), part), ("Category", F.lit("x"), none)]
    sections = F.array(*(F.struct(F.lit(2).alias("level"), F.lit(t).alias("title"), c.alias("content"), s.alias("subsections")) for t, c, s in rows))
    return table(spark, sf_dir, "documents").select("doc_id", sections.cast(schemas.SECTIONS).alias("sections"))


_CONCEPT = f"""SELECT doc_id AS k, 0 AS o, 'Overview' AS title, {_STRIP.format(f"'## Overview' || CASE WHEN {_STRIP.format('text')} <> '' THEN chr(10) || {_STRIP.format('text')} ELSE '' END")} AS text FROM documents
UNION ALL SELECT doc_id, 1, 'Origin', '## Origin' || {_PAR} || '### ' || source || chr(10) || 'Of ' || lang FROM documents"""


@query(f"WITH RECURSIVE {_packed(_CONCEPT)} SELECT k AS doc_id, titles AS section_title, {_NUMBERED} FROM chunks")
def document_concepts(spark, sf_dir):
    """Sections of pages packed with their titles; a section over the limit is packed by itself."""
    return pages.chunk_sections(_pages(spark, sf_dir), "doc_id")


_CHARACTER = f"""SELECT doc_id AS k, 0 AS o, 'Overview' AS title, {_STRIP.format("text")} AS text FROM documents
UNION ALL SELECT doc_id, 1, 'Origin', '**' || source || '**' || chr(10) || 'Of ' || lang FROM documents UNION ALL SELECT doc_id, 2, 'Category', 'x' FROM documents"""


@query(f"WITH RECURSIVE {_packed(_CHARACTER)} SELECT k AS doc_id, titles AS section_title, {_NUMBERED} FROM chunks")
def document_characters(spark, sf_dir):
    """Contents of sections, or else of their parts, packed."""
    return pages.chunk_characters(_pages(spark, sf_dir), "doc_id")


_SUMMARY = f"""SELECT doc_id AS k, 0 AS o, '' AS title, CASE WHEN {_STRIP.format("text")} <> '' THEN '**Overview**' || chr(10) || text || {_PAR} ELSE '' END || '**Category**' || chr(10) || 'x' AS text FROM documents"""


@query(f"WITH RECURSIVE {_packed(_SUMMARY)}, {_windows('SELECT k, chunk_index AS o, text FROM chunks')} SELECT k AS doc_id, chunk_index, total_chunks, text FROM numbered")
def document_summaries(spark, sf_dir):
    """All sections of a page as one text, packed; packs over the target overlap."""
    return pages.chunk_summaries(_pages(spark, sf_dir), "doc_id")


_WHOLE = "SELECT doc_id AS k, 0 AS o, '' AS title, coalesce(text, '') AS text FROM documents"


@query(f"WITH RECURSIVE {_packed(_WHOLE)}, {_windows('SELECT k, chunk_index AS o, text FROM chunks')} SELECT k % 15 AS book_number, k AS chapter_number, chunk_index, total_chunks, text FROM numbered")
def document_chapters(spark, sf_dir):
    """Whole documents as chapters; packs over the target overlap."""
    chapters = table(spark, sf_dir, "documents").select((F.col("doc_id") % 15).alias("book_number"), F.col("doc_id").alias("chapter_number"), F.col("text").alias("content"))
    return pages.chunk_chapters(chapters).drop("chunk_id")


_TIMED = f"""SELECT doc_id AS k, 0 AS o, '' AS title, CASE WHEN lang = 'en' THEN text ELSE CASE WHEN {_STRIP.format("text")} <> '' THEN text || {_PAR} ELSE '' END || '**' || source || '**' || chr(10) || 'Of ' || lang END AS text FROM documents"""


@query(f"WITH RECURSIVE {_packed(_TIMED)} SELECT k AS doc_id, CASE WHEN d.lang = 'en' THEN 'temporal' ELSE 'non_temporal' END AS type, CASE WHEN d.lang = 'en' THEN k % 15 END AS temporal_order, {_NUMBERED.replace('text', 'chunks.text')} FROM chunks JOIN documents d ON d.doc_id = k")
def document_chronology(spark, sf_dir):
    """Sections in time by their content, others with their parts, packed."""
    timed = F.col("lang") == "en"
    part = F.array(F.struct(F.lit(3).alias("level"), F.col("source").alias("title"), F.concat(F.lit("Of "), "lang").alias("content")))
    rows = table(spark, sf_dir, "documents").select(
        "doc_id", F.lit(1).alias("h2"), F.lit("Overview").alias("title"), F.col("text").alias("content"), part.alias("subsections"),
        F.when(timed, "temporal").otherwise("non_temporal").alias("type"), F.when(timed, F.col("doc_id") % 15).alias("temporal_order"),
    )
    return pages.chunk_chronology(rows, "doc_id").drop("h2", "title")


@query(f"WITH RECURSIVE {_windows(_WHOLE)} SELECT k AS doc_id, chunk_index, text FROM numbered")
def chunk_overlap(spark, sf_dir):
    return chunking.overlap_chunks(table(spark, sf_dir, "documents"), "doc_id", "text")
