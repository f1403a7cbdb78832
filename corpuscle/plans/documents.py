"""Queries over documents: chunking, mentions, profiles, samples and parsing."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuscle.functions import text as T
from corpuscle.operators import chunking, mentions, parsing, quality, resolve
from corpuscle.session import table

from .catalog import query

LIMIT = 2000
_STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
_LINES = f"""
lines AS (
  SELECT doc_id, i AS line_no, {_STRIP.format("string_split(text, chr(10))[i]")} AS line
  FROM documents, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS r(i)
),
kept AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) - 1 AS i, line FROM lines WHERE line <> '')"""
_ATOMS = f"""
sents AS (
  SELECT doc_id, i, k, {_STRIP.format("s[k]")} AS sent
  FROM (SELECT doc_id, i, string_split(regexp_replace(line, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)) AS s FROM kept WHERE length(line) > {LIMIT}), unnest(range(1, len(s) + 1)) AS r(k)
),
worded AS (SELECT doc_id, i, row_number() OVER (PARTITION BY doc_id, i ORDER BY k) - 1 AS k, sent FROM sents WHERE sent <> ''),
cuts AS (SELECT doc_id, i, k, j, substr(sent, j * {LIMIT} + 1, {LIMIT}) AS part FROM worded, unnest(range(0, (length(sent) - 1) // {LIMIT} + 1)) AS r(j)),
atoms AS (
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i, k, j) AS rn, grp, part FROM (
    SELECT doc_id, i, 0 AS k, 0 AS j, 0 AS grp, line AS part FROM kept WHERE length(line) <= {LIMIT}
    UNION ALL
    SELECT c.doc_id, c.i, c.k, c.j, CASE WHEN length(w.sent) <= {LIMIT} THEN c.i + 1 ELSE -((c.i + 1) * 1000000 + c.k * 1000 + c.j) - 1 END, c.part
    FROM cuts c JOIN worded w ON w.doc_id = c.doc_id AND w.i = c.i AND w.k = c.k
  )
)"""
PACK_SQL = f"""
WITH RECURSIVE {_LINES}, {_ATOMS},
fold AS (
  SELECT doc_id, rn, grp, part AS cur, 1 AS chunk_index FROM atoms WHERE rn = 1
  UNION ALL
  SELECT a.doc_id, a.rn, a.grp,
    CASE WHEN a.grp = f.grp AND length(f.cur) + CASE WHEN a.grp = 0 THEN 2 ELSE 1 END + length(a.part) <= {LIMIT}
      THEN f.cur || CASE WHEN a.grp = 0 THEN chr(10) || chr(10) ELSE ' ' END || a.part ELSE a.part END,
    f.chunk_index + CASE WHEN a.grp = f.grp AND length(f.cur) + CASE WHEN a.grp = 0 THEN 2 ELSE 1 END + length(a.part) <= {LIMIT} THEN 0 ELSE 1 END
  FROM fold f JOIN atoms a ON a.doc_id = f.doc_id AND a.rn = f.rn + 1
),
chunks AS (SELECT doc_id, chunk_index, arg_max(cur, rn) AS text FROM fold GROUP BY doc_id, chunk_index)
SELECT doc_id, CAST(chunk_index AS BIGINT) AS chunk_index, CAST(count(*) OVER (PARTITION BY doc_id) AS BIGINT) AS total_chunks, text FROM chunks"""


def _line_parts():
    return F.filter(F.transform(F.split("text", "\n"), T.strip), lambda x: x != "")


@query(PACK_SQL)
def chunk_pack(spark, sf_dir):
    """Lines packed greedily into chunks, long lines by sentences."""
    return chunking.number_chunks(table(spark, sf_dir, "documents"), chunking.pack(_line_parts(), LIMIT), "doc_id")


@query(
    r"""SELECT doc_id, CAST(len(s) AS BIGINT) AS n_sentences, CAST(list_sum(list_transform(s, lambda x: length(x))) AS BIGINT) AS chars FROM (
SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS s FROM documents)"""
)
def chunk_sentence_split(spark, sf_dir):
    # The generator keeps the sentences a column: inlined, they would be split again for each use.
    rows = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array(T.sentences("text"))).alias("s"))
    total = F.when(F.size("s") > 0, F.aggregate("s", F.lit(0).cast("long"), lambda a, x: a + F.length(x)))
    return rows.select("doc_id", F.size("s").cast("long").alias("n_sentences"), total.alias("chars"))


@query("""SELECT count(text) AS n, CAST(sum(length(text)) AS BIGINT) AS total_chars, round(avg(length(text)), 6) AS avg_chars, CAST(min(length(text)) AS BIGINT) AS min_chars,
CAST(max(length(text)) AS BIGINT) AS max_chars, count(*) FILTER (length(text) > 7680) AS oversized FROM documents""")
def chunk_stats(spark, sf_dir):
    return chunking.chunk_statistics(table(spark, sf_dir, "documents"))


@query("""WITH t AS (SELECT length(text) // 4 AS tok FROM documents), m AS (SELECT CAST(list_sort(list(tok))[count(*) // 2 + 1] AS BIGINT) AS median FROM t)
SELECT CAST(CASE WHEN tok < 256 THEN 0 WHEN tok < 512 THEN 1 WHEN tok < 1024 THEN 2 WHEN tok < 2000 THEN 3 ELSE 4 END AS BIGINT) AS bucket, count(*) AS n,
round(100.0 * count(*) / (SELECT count(*) FROM t), 6) AS pct, any_value(median) AS median FROM t, m GROUP BY 1""")
def chunk_histogram(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    tok = T.token_estimate("text")
    n = docs.agg(F.count("*").alias("all"))
    rows = quality.histogram(docs, tok, [0, 256, 512, 1024, 2000])
    return rows.crossJoin(F.broadcast(n)).crossJoin(F.broadcast(quality.upper_median(docs, tok))).select("bucket", "n", F.round(100.0 * F.col("n") / F.col("all"), 6).alias("pct"), "median")


_TURN = 1200
_GAP = "CASE WHEN a.g = f.g AND length(f.cur) + length(a.sep) + length(a.part) <= 1200"


@query(f"""WITH RECURSIVE kept AS (
  SELECT conv_id, turn, role, i, {_STRIP.format("p[i]")} AS line FROM (SELECT conv_id, turn, role, regexp_split_to_array(text, '\\n\\s*\\n+') AS p FROM conversations WHERE length(text) > {_TURN}), unnest(range(1, len(p) + 1)) AS r(i)
),
sents AS (
  SELECT conv_id, turn, role, i, k, {_STRIP.format("s[k]")} AS sent
  FROM (SELECT *, string_split(regexp_replace(line, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)) AS s FROM kept WHERE length(line) > {_TURN}), unnest(range(1, len(s) + 1)) AS r(k)
),
cuts AS (SELECT conv_id, turn, role, i, k, j, substr(sent, j * {_TURN} + 1, {_TURN}) AS part, length(sent) AS n FROM sents, unnest(range(0, (length(sent) - 1) // {_TURN} + 1)) AS r(j) WHERE sent <> ''),
atoms AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, i, k, j) AS rn, role, g, sep, part FROM (
    SELECT conv_id, turn, role, 0 AS i, 0 AS k, 0 AS j, 'turn' AS g, chr(10) || chr(10) AS sep, text AS part FROM conversations WHERE length(text) <= {_TURN}
    UNION ALL SELECT conv_id, turn, role, i, 0, 0, turn || '', chr(10) || chr(10), line FROM kept WHERE line <> '' AND length(line) <= {_TURN}
    UNION ALL SELECT conv_id, turn, role, i, k, j, turn || ':' || i || CASE WHEN n <= {_TURN} THEN '' ELSE ':' || k || ':' || j END, ' ', part FROM cuts
  )
),
fold AS (
  SELECT conv_id, rn, g, role AS titles, part AS cur, 1 AS chunk_index FROM atoms WHERE rn = 1
  UNION ALL
  SELECT a.conv_id, a.rn, a.g, {_GAP} AND a.g = 'turn' THEN f.titles || ', ' || a.role ELSE a.role END, {_GAP} THEN f.cur || a.sep || a.part ELSE a.part END, f.chunk_index + {_GAP} THEN 0 ELSE 1 END
  FROM fold f JOIN atoms a ON a.conv_id = f.conv_id AND a.rn = f.rn + 1
)
SELECT conv_id, CAST(chunk_index AS BIGINT) AS chunk_index, arg_max(titles, rn) AS titles, arg_max(cur, rn) AS text FROM fold GROUP BY conv_id, chunk_index""")
def section_pack(spark, sf_dir):
    """All turns as sections, packed by conversation; a turn over the limit is packed by itself."""
    return _packed(table(spark, sf_dir, "conversations"))


def _packed(turns):
    order = F.array_sort(F.collect_list(F.struct("turn", F.col("role").alias("title"), "text")))
    rows = turns.groupBy("conv_id").agg(F.transform(order, lambda x: F.struct(x["title"].alias("title"), x["text"].alias("text"))).alias("sections"))
    packed = rows.select("conv_id", F.posexplode(chunking.pack_sections(F.col("sections"), 1200)).alias("pos", "c"))
    return packed.select("conv_id", (F.col("pos") + 1).cast("long").alias("chunk_index"), F.col("c.titles").alias("titles"), F.col("c.text").alias("text"))


#: A dictionary for the sample tables: dict_name, canonical, aliases, ord.
WORDS = [("en", "the", ["of the"], 0), ("en", "and", [], 1), ("de", "der", ["die", "und der"], 2), ("fr", "le", ["la", "de la"], 3), ("es", "el", ["los"], 4)]


def dictionary(spark):
    return spark.createDataFrame(WORDS, "dict_name string, canonical string, aliases array<string>, ord int")


_TERMS = "terms(dict_name, term, canonical) AS (VALUES " + ", ".join(f"('{d}', '{t}', '{c}')" for d, c, a, _ in WORDS for t in [c, *a]) + ")"
_TAGGED = f"""WITH {_TERMS}, hits AS (SELECT DISTINCT doc_id, dict_name, canonical FROM documents, terms WHERE contains(' ' || lower(text) || ' ', ' ' || term || ' '))
SELECT doc_id, dict_name, array_to_string(list_sort(list(canonical)), ',') AS mentions FROM hits GROUP BY doc_id, dict_name"""


def _tag(spark, sf_dir, mode):
    found = mentions.tag(table(spark, sf_dir, "documents"), "doc_id", "text", dictionary(spark), mode=mode)
    return found.withColumn("mentions", F.array_join("mentions", ","))


@query(_TAGGED)
def mention_tag(spark, sf_dir):
    return _tag(spark, sf_dir, "auto")


@query(_TAGGED)
def mention_tag_ngram(spark, sf_dir):
    """The plan for dictionaries beyond the automaton's bound."""
    return _tag(spark, sf_dir, "ngram")


@query(_TAGGED)
def mention_tag_contains(spark, sf_dir):
    return _tag(spark, sf_dir, "contains")


@query(
    f"""WITH {_TERMS}, hits AS (SELECT DISTINCT doc_id, dict_name, canonical FROM documents, terms WHERE regexp_matches(lower(text), '(^|[^\\p{{L}}\\p{{N}}_])' || term || '($|[^\\p{{L}}\\p{{N}}_])'))
SELECT doc_id, dict_name, array_to_string(list_sort(list(canonical)), ',') AS mentions FROM hits GROUP BY doc_id, dict_name"""
)
def mention_tag_regex(spark, sf_dir):
    return _tag(spark, sf_dir, "regex")


@query(
    f"""SELECT dict_name, count(*) AS rows_with, CAST(sum(len(string_split(mentions, ','))) AS BIGINT) AS mentions, round(100.0 * count(*) / (SELECT count(*) FROM documents), 6) AS pct
FROM ({_TAGGED}) GROUP BY dict_name"""
)
def mention_counters(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return mentions.counters(mentions.tag(docs, "doc_id", "text", dictionary(spark)), docs.agg(F.count("*").alias("n")))


@query(r"""WITH lines AS (SELECT doc_id, i - 1 AS pos, string_split(text, chr(10))[i] AS line FROM documents, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS r(i)),
marked AS (SELECT *, sum(CASE WHEN length(line) < 40 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS section FROM lines)
SELECT doc_id, CAST(section AS BIGINT) AS section, count(*) AS n_lines, CAST(min(pos) AS BIGINT) AS first_pos, arg_min(line, pos) AS header FROM marked WHERE section > 0 GROUP BY doc_id, section""")
def line_state_machine(spark, sf_dir):
    """Short lines open sections; every line belongs to the last one opened."""
    rows = parsing.carry_sections(parsing.lines(table(spark, sf_dir, "documents"), "doc_id", "text"), "doc_id", F.length("line") < 40)
    return rows.filter("section > 0").groupBy("doc_id", "section").agg(F.count("*").alias("n_lines"), F.min("pos").cast("long").alias("first_pos"), F.min_by("line", "pos").alias("header"))


@query("""SELECT doc_id, lang, source, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY md5(text) ORDER BY n_chars DESC, doc_id) AS rn FROM documents) WHERE rn = 1""")
def dedupe_keep_largest(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return resolve.keep_largest(docs, F.md5("text"), F.col("n_chars"), "doc_id").select("doc_id", "lang", "source", "n_chars")


_PROFILE = """count(*) AS n_rows, CAST(sum(length(text)) AS BIGINT) AS total_chars, round(avg(CASE WHEN length(text) > 0 THEN length(text) END), 6) AS avg_chars,
CAST(min(length(text)) AS BIGINT) AS min_chars, CAST(max(length(text)) AS BIGINT) AS max_chars, round(sum(length(text)) / 4.0, 2) AS est_tokens"""


@query(f"SELECT source, {_PROFILE} FROM documents GROUP BY source")
def source_profile(spark, sf_dir):
    return quality.profile(table(spark, sf_dir, "documents"), "source")


@query(f"SELECT lang, source, {_PROFILE} FROM documents GROUP BY ROLLUP (lang, source)")
def type_rollup(spark, sf_dir):
    return quality.profile(table(spark, sf_dir, "documents"), "lang", "source", levels="rollup")


@query(r"""SELECT word, count(*) AS n FROM (SELECT unnest(string_split(regexp_replace(lower(text), '[ \n\t]+', ' ', 'g'), ' ')) AS word FROM documents) WHERE word <> '' GROUP BY word ORDER BY n DESC, word LIMIT 50""")
def most_common(spark, sf_dir):
    """The 50 most frequent words."""
    words = table(spark, sf_dir, "documents").select(F.explode(F.split(F.lower("text"), r"[ \n\t]+")).alias("word")).filter("word <> ''")
    return quality.most_common(words, "word", 50)


@query("""SELECT doc_id, array_to_string(list_filter([CASE WHEN NOT (length(text) >= 10) THEN 'short' END, CASE WHEN NOT (n_chars = length(text)) THEN 'length' END,
CASE WHEN NOT coalesce(lang IN ('en', 'de', 'fr', 'es'), false) THEN 'lang' END, CASE WHEN NOT coalesce(quality IN (0, 1), false) THEN 'quality' END], lambda x: x IS NOT NULL), ',') AS issues
FROM documents LEFT JOIN labels USING (doc_id)""")
def constraint_report(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    rules = [("short", F.length("text") >= 10), ("length", F.col("n_chars") == F.length("text")), ("lang", F.col("lang").isin("en", "de", "fr", "es")), ("quality", F.col("quality").isin(0, 1))]
    return docs.join(labels, "doc_id", "left").select("doc_id", F.array_join(quality.issues(rules), ",").alias("issues"))


@query("""SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY (doc_id * 2654435761) % 1000003, doc_id) AS rn FROM documents) WHERE rn <= 10""")
def stratified_sample(spark, sf_dir):
    order = (F.col("doc_id") * 2654435761) % 1000003
    return quality.stratified(table(spark, sf_dir, "documents").select("doc_id", "source"), "source", "doc_id", 10, order)


@query("SELECT doc_id, lang FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def incremental_skip(spark, sf_dir):
    return resolve.without_existing(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id", table(spark, sf_dir, "labels"))


@query(r"""SELECT doc_id, CAST(length(text) // 4 AS BIGINT) AS tokens, CAST(CASE WHEN regexp_replace(text, '^\s+|\s+$', '', 'g') = '' THEN 0 ELSE len(regexp_split_to_array(regexp_replace(text, '^\s+|\s+$', '', 'g'), '\s+')) END AS BIGINT) AS words,
translate(substr(text, 1, 40), ' /', '__') AS name FROM documents""")
def scalar_text(spark, sf_dir):
    """Word counts, token estimates and file names of every document."""
    name = F.translate(F.substring("text", 1, 40), " /", "__")
    return table(spark, sf_dir, "documents").select("doc_id", T.token_estimate("text").alias("tokens"), T.word_count("text").alias("words"), name.alias("name"))


@query(f"SELECT 'book_' || lpad(CAST(doc_id % 15 AS VARCHAR), 2, '0') || '_ch_' || lpad(CAST(doc_id % 97 AS VARCHAR), 2, '0') || '_chunk_' || lpad(CAST(chunk_index AS VARCHAR), 3, '0') AS chunk_id, doc_id, text FROM ({PACK_SQL})")
def chunk_ids(spark, sf_dir):
    """Packed chunks with ids of a fixed format."""
    rows = chunk_pack(spark, sf_dir)
    return rows.select(T.chunk_id(F.col("doc_id") % 15, F.col("doc_id") % 97, F.col("chunk_index")).alias("chunk_id"), "doc_id", "text")


@query("""SELECT lang, count(*) AS n, count(*) FILTER (length(text) > 2048) AS over, round(avg(CASE WHEN length(text) // 4 > 512 THEN 1.0 ELSE 0.0 END), 6) AS share_over,
CAST(sum(length(text)) // count(*) AS BIGINT) AS floor_avg, max(length(text)) > 7680 AS any_oversized FROM documents GROUP BY lang""")
def size_by_type(spark, sf_dir):
    """Conditional counts, floor averages and any() by type."""
    n, docs = F.length("text"), table(spark, sf_dir, "documents")
    over = F.avg((T.token_estimate("text") > 512).cast("double"))
    return docs.groupBy("lang").agg(F.count("*").alias("n"), F.count_if(n > 2048).alias("over"), F.round(over, 6).alias("share_over"), F.floor(F.sum(n) / F.count("*")).cast("long").alias("floor_avg"), F.bool_or(n > 7680).alias("any_oversized"))


@query("""SELECT conv_id, count(*) AS n_turns, array_to_string(list(role ORDER BY turn), ',') AS roles, max(turn) - min(turn) + 1 <> count(*) AS gaps, count(*) FILTER (length(text) < 50) AS short FROM conversations GROUP BY conv_id""")
def chapter_verification(spark, sf_dir):
    """Structure checks by parent: order, gaps, short parts."""
    roles = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"]), ",")
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("n_turns"), roles.alias("roles"), (F.max("turn") - F.min("turn") + 1 != F.count("*")).alias("gaps"), F.count_if(F.length("text") < 50).alias("short"))


@query("SELECT doc_id, n_chars FROM documents ORDER BY doc_id LIMIT 100")
def first_rows(spark, sf_dir):
    """The first hundred rows by position, as a look at a table."""
    return table(spark, sf_dir, "documents").select("doc_id", "n_chars").orderBy("doc_id").limit(100)
