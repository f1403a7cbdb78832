"""Queries of index builders, look-ups with defaults, chunk profiles, collections and searches by index."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuscle.functions import text as T
from corpuscle.operators import collections, embed, indexes, mentions, quality, reports, resolve, retrieval
from corpuscle.session import table
from corpuscle.sources import sinks

from .catalog import query
from .documents import _TAGGED, dictionary

#: Which categories of the sample parts say what.
LISTS = indexes.CharacterLists(
    gender={"small": "female", "red": "male", "metal": "male"}, affiliations=("ring_guild", "bolt"), kinds={"male": "saidin", "female": "saidar"}, ajah={"red": "Red", "blue": "Blue"},
    abilities={"bolt": "dreamer", "gear": "ta_veren", "green": "dreamer"}, organizations=("gear", "economy"), military=("plate",), social=("standard",), military_roles=("promo",), professions=("widget",), dark=("brass",), cultures=("steel",),
)
ABILITIES = {"ta_veren": ("ta_veren",), "dreamers": ("dreamer", "dreamwalker")}
_CATS = "list_concat(string_split(lower(p_name), ' '), string_split(lower(p_type), ' '), [p_brand || '_(people)'])"


def _in(names) -> str:
    return "[" + ", ".join(f"'{n}'" for n in names) + "]"


def _map(values: dict) -> str:
    return "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in values.items()) + "}"


def _members(*names) -> str:
    return f"list_sort(list_transform(list_filter(c, lambda x: list_contains({_in(names)}, x)), lambda x: replace(x, '_', ' ')))"


_INDEX = f"""idx AS (SELECT p_partkey, gender, len(affiliations) > 0 AS can_channel, CASE WHEN len(affiliations) > 0 THEN CASE gender WHEN 'male' THEN 'saidin' WHEN 'female' THEN 'saidar' END END AS channeling_type, affiliations, ajah, special_abilities, nationalities, organizations,
  military_groups, social_roles, professions, alignment, cultural_groups, aliases, books_appeared FROM (
  SELECT p_partkey, list_filter(list_transform(c, lambda x: {_map(LISTS.gender)}[x]), lambda x: x IS NOT NULL)[1] AS gender, {_members(*LISTS.affiliations)} AS affiliations,
    list_filter(list_transform(c, lambda x: {_map(LISTS.ajah)}[x]), lambda x: x IS NOT NULL)[1] AS ajah, list_sort(list_filter(list_transform(c, lambda x: {_map(LISTS.abilities)}[x]), lambda x: x IS NOT NULL)) AS special_abilities,
    list_sort(list_transform(list_filter(c, lambda x: ends_with(x, '(people)')), lambda x: replace(replace(replace(x, '_(people)', ''), '(people)', ''), '_', ' '))) AS nationalities, {_members(*LISTS.organizations)} AS organizations, {_members(*LISTS.military)} AS military_groups,
    {_members(*LISTS.social, *LISTS.military_roles)} AS social_roles, {_members(*LISTS.professions)} AS professions, {_members(*LISTS.dark)} AS alignment, {_members(*LISTS.cultures)} AS cultural_groups,
    CASE WHEN p_size % 3 = 0 THEN [p_name] ELSE [] END AS aliases, CASE WHEN p_size % 2 = 0 THEN [p_size] ELSE [] END AS books_appeared
  FROM (SELECT *, {_CATS} AS c FROM part)))"""
_ARRAYS = ("affiliations", "special_abilities", "nationalities", "organizations", "military_groups", "social_roles", "professions", "alignment", "cultural_groups")


def _cats():
    return F.concat(F.split(F.lower("p_name"), " "), F.split(F.lower("p_type"), " "), F.array(F.concat("p_brand", F.lit("_(people)"))))


def _index(spark, sf_dir):
    rows = table(spark, sf_dir, "part").withColumn("c", _cats())
    none = F.array()
    extra = {"aliases": F.when(F.col("p_size") % 3 == 0, F.array("p_name")).otherwise(none), "books_appeared": F.when(F.col("p_size") % 2 == 0, F.array("p_size")).otherwise(none)}
    return rows.select("p_partkey", *(v.alias(k) for k, v in (indexes.character_attributes("c", LISTS) | extra).items()))


@query(f"WITH {_INDEX} SELECT p_partkey, gender, can_channel, channeling_type, ajah, {', '.join(f'array_to_string({a}, chr(44)) AS {a}' for a in _ARRAYS)} FROM idx")
def character_attributes(spark, sf_dir):
    """Twelve attributes from categories."""
    return _index(spark, sf_dir).drop("aliases", "books_appeared").withColumns({a: F.array_join(a, ",") for a in _ARRAYS})


@query(f"""WITH {_INDEX} SELECT count(*) AS total, count(*) FILTER (len(aliases) > 0) AS with_aliases, count(*) FILTER (len(books_appeared) > 0) AS with_books, count(*) FILTER (can_channel) AS channelers,
count(*) FILTER (channeling_type = 'saidin') AS male_channelers, count(*) FILTER (channeling_type = 'saidar') AS female_channelers, count(ajah) AS with_ajah, count(*) FILTER (len(nationalities) > 0) AS with_nationality,
count(*) FILTER (len(organizations) > 0) AS with_organizations, count(*) FILTER (len(alignment) > 0) AS darkfriends, count(*) FILTER (len(professions) > 0) AS with_professions,
count(*) FILTER (list_contains(special_abilities, 'ta_veren')) AS ta_veren, count(*) FILTER (list_has_any(special_abilities, ['dreamer', 'dreamwalker'])) AS dreamers FROM idx""")
def index_statistics(spark, sf_dir):
    return indexes.index_statistics(_index(spark, sf_dir), abilities=ABILITIES)


RULES = (("Foretelling", "red", "standard"), ("Viewing", "blue", None), ("Prophecy", "green", "promo"))
_KIND = "CASE WHEN contains(lower(p_name), 'red') OR list_contains(c, 'standard') THEN 'Foretelling' WHEN contains(lower(p_name), 'blue') THEN 'Viewing' WHEN contains(lower(p_name), 'green') OR list_contains(c, 'promo') THEN 'Prophecy' ELSE 'Unknown' END"
_OBJECT = "CASE WHEN list_contains(c, 'bolt') THEN 'bolt' WHEN list_contains(c, 'ring') THEN 'ring' END"


def _typed(spark, sf_dir):
    rows = table(spark, sf_dir, "part").withColumn("c", _cats())
    flags = indexes.flags("c", {"power_related": "small", "is_weave": "metal"})
    return rows.select("p_partkey", indexes.ordered_type("p_name", "c", RULES).alias("kind"), indexes.object_type("c", ("bolt", "ring")).alias("object_type"), *(v.alias(k) for k, v in flags.items()))


@query(f"SELECT p_partkey, {_KIND} AS kind, {_OBJECT} AS object_type, list_contains(c, 'small') AS power_related, list_contains(c, 'metal') AS is_weave FROM (SELECT *, {_CATS} AS c FROM part)")
def ordered_types(spark, sf_dir):
    """Types by name or category in order, object types and flags."""
    return _typed(spark, sf_dir)


@query(f"""WITH t AS (SELECT {_KIND} AS kind, {_OBJECT} AS object_type, list_contains(c, 'small') AS p, list_contains(c, 'metal') AS w FROM (SELECT *, {_CATS} AS c FROM part))
SELECT kind, count(*) AS n, count(object_type) AS power_objects, count(*) FILTER (p) AS power_related, count(*) FILTER (w) AS weaves FROM t GROUP BY ROLLUP (kind)""")
def type_counters(spark, sf_dir):
    return indexes.type_counters(_typed(spark, sf_dir), "kind", {"power_objects": F.col("object_type").isNotNull(), "power_related": F.col("power_related"), "weaves": F.col("is_weave")})


@query("""SELECT CASE WHEN p_size > 40 THEN 'excluded' ELSE coalesce(CASE WHEN contains(p_name, 'ring') THEN 'ring' END, 'unclassified') END AS "group", count(*) AS n FROM part GROUP BY 1""")
def classified_counters(spark, sf_dir):
    rows = table(spark, sf_dir, "part").withColumn("g", F.when(F.contains("p_name", F.lit("ring")), "ring"))
    return indexes.classified_counters(rows, "g", F.col("p_size") > 40)


@query("""SELECT n_nationkey, coalesce(array_to_string(list_sort(list(s_name) FILTER (s_acctbal > 3000)), ','), '') AS names FROM nation LEFT JOIN supplier ON n_nationkey = s_nationkey GROUP BY n_nationkey""")
def lookup_or_empty(spark, sf_dir):
    """Categories and aliases by key, the empty list where there are none."""
    s = table(spark, sf_dir, "supplier").filter("s_acctbal > 3000")
    known = resolve.invert(s.withColumnRenamed("s_nationkey", "n_nationkey"), "s_name", "n_nationkey", "names")
    return indexes.lookup_or_empty(table(spark, sf_dir, "nation").select("n_nationkey"), "n_nationkey", known, "names").withColumn("names", F.array_join("names", ","))


@query("""SELECT n_name AS category, CAST(coalesce(n, 0) AS BIGINT) AS n FROM nation LEFT JOIN (SELECT c_nationkey, count(*) AS n FROM customer WHERE c_acctbal > 9000 GROUP BY 1) ON c_nationkey = n_nationkey""")
def category_counts(spark, sf_dir):
    """A taxonomy's categories with their counts, 0 where there is none."""
    n = table(spark, sf_dir, "nation")
    counts = table(spark, sf_dir, "customer").filter("c_acctbal > 9000").join(n, F.col("c_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_name").alias("category")).agg(F.count("*").alias("n"))
    return indexes.counts_with_zero(n.select(F.col("n_name").alias("category")), "category", counts)


@query("""WITH t AS (SELECT s_name, CASE WHEN s_suppkey % 7 = 0 THEN [] ELSE ['N' || s_nationkey, 'B' || s_suppkey % 3] END AS c FROM supplier),
k AS (SELECT s_name, CASE WHEN len(c) > 0 THEN c WHEN s_name IN (SELECT s_name FROM supplier WHERE s_suppkey % 2 = 0) THEN ['unknown_redirection'] ELSE ['unknown_category'] END AS c FROM t)
SELECT category, count(*) AS n, array_to_string(list_sort(list(s_name)), ',') AS names FROM (SELECT s_name, unnest(c) AS category FROM k) GROUP BY category""")
def category_inversion(spark, sf_dir):
    """Files by category, sorted; those without a category in groups of their own."""
    s = table(spark, sf_dir, "supplier")
    cats = F.when(F.col("s_suppkey") % 7 == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("N"), F.col("s_nationkey").cast("string")), F.concat(F.lit("B"), (F.col("s_suppkey") % 3).cast("string"))))
    redirects = s.filter("s_suppkey % 2 = 0").select(F.col("s_name").alias("redirect"))
    return indexes.inverted(s.select("s_name", cats.alias("c")), "c", "s_name", redirects).withColumn("names", F.array_join("names", ","))


@query("""SELECT c_custkey, CASE WHEN c_nationkey < 10 THEN n_name END AS canonical FROM (SELECT c_custkey, c_nationkey FROM customer) LEFT JOIN nation ON n_nationkey = c_nationkey""")
def redirect_target(spark, sf_dir):
    """Where each name redirects to, null for none."""
    known = table(spark, sf_dir, "nation").filter("n_nationkey < 10").select(F.concat(F.lit("p"), F.col("n_nationkey").cast("string")).alias("redirect"), F.col("n_name").alias("canonical"))
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("p"), F.col("c_nationkey").cast("string")).alias("name"))
    return indexes.redirect_target(rows, "name", known).select("c_custkey", "canonical")


_STUB = "'# ' || p_name || chr(10) || chr(10) || '<!-- Categories: glossary -->' || chr(10) || chr(10) || '## Definition' || chr(10) || chr(10) || d"


@query(f"""WITH t AS (SELECT p_name, min(p_type) FILTER (p_size > 10) AS d, bool_or(p_brand = 'Brand#11') AS there FROM part GROUP BY p_name)
SELECT replace(p_name, ' ', '_') || '.txt' AS file_name, {_STUB} AS text FROM t WHERE d IS NOT NULL AND NOT there""")
def stub_pages(spark, sf_dir):
    """Pages for terms that have a definition and no file."""
    p = table(spark, sf_dir, "part")
    glossary = p.filter("p_size > 10").groupBy(F.col("p_name").alias("term")).agg(F.min("p_type").alias("definition"))
    files = p.filter("p_brand = 'Brand#11'").select(F.concat(F.translate("p_name", " ", "_"), F.lit(".txt")).alias("file_name"))
    return indexes.stubs(p.select(F.col("p_name").alias("term")), glossary, files, ["glossary"])[0]


_NAMES = ["en", "de", "fr"]
_ENRICHED = f"""enriched AS (SELECT d.doc_id, d.source, d.text, l.quality, {', '.join(f"coalesce(max(t.mentions) FILTER (t.dict_name = '{n}'), '') AS {n}_mentions" for n in _NAMES)}
  FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id) l USING (doc_id) LEFT JOIN ({_TAGGED}) t ON t.doc_id = d.doc_id GROUP BY ALL)"""


def _enriched(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    return mentions.enrich(docs.join(labels, "doc_id", "left"), "doc_id", "text", dictionary(spark), _NAMES)


@query(f"WITH {_ENRICHED} SELECT doc_id, {', '.join(f'{n}_mentions' for n in _NAMES)} FROM enriched")
def enrich_chunks(spark, sf_dir):
    """Every chunk with one array of mentions a dictionary."""
    return _enriched(spark, sf_dir).select("doc_id", *(F.array_join(f"{n}_mentions", ",").alias(f"{n}_mentions") for n in _NAMES))


_OWN = {"de": "DER", "fr": "Le"}  # what documents of a language are about, as their dictionary may spell it


@query(f"""WITH m AS (SELECT doc_id, dict_name, unnest(string_split(mentions, ',')) AS m FROM ({_TAGGED})
UNION SELECT doc_id, lang, CASE lang {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in _OWN.items())} END FROM documents WHERE lang IN ('de', 'fr'))
SELECT doc_id, {', '.join(f"coalesce(string_agg(m, ',' ORDER BY m) FILTER (dict_name = '{n}'), '') AS {n}_mentions" for n in _NAMES)} FROM documents LEFT JOIN m USING (doc_id) GROUP BY doc_id""")
def enrich_topics(spark, sf_dir):
    """Documents with what they mention and their own topic, where a dictionary has it."""
    topic = F.create_map(*(F.lit(x) for kv in _OWN.items() for x in kv))[F.col("lang")]
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", topic.alias("about"))
    rows = mentions.enrich(docs, "doc_id", "text", dictionary(spark), _NAMES, topic="about")
    return rows.select("doc_id", *(F.array_join(f"{n}_mentions", ",").alias(f"{n}_mentions") for n in _NAMES))


def _profile_sql(n: str) -> str:
    size = f"CASE WHEN {n}_mentions = '' THEN 0 ELSE len(string_split({n}_mentions, ',')) END"
    total, rows = f"sum({size})", f"count(*) FILTER ({n}_mentions <> '')"
    return f"{rows} AS with_{n}, CAST({total} AS BIGINT) AS {n}_mentions, round(coalesce({total} / nullif({rows}, 0), 0), 6) AS avg_{n}, round({total} / count(*), 6) AS {n}_density"


@query(f"""WITH {_ENRICHED} SELECT source, count(*) AS total_chunks, {', '.join(map(_profile_sql, _NAMES))}, round(avg(length(text)), 6) AS avg_length, CAST(min(length(text)) AS BIGINT) AS min_length, CAST(max(length(text)) AS BIGINT) AS max_length,
round(avg(length(text)) / 4, 6) AS avg_tokens, round(max(length(text)) / 4, 6) AS max_tokens, count(quality) AS temporal, count(*) FILTER (quality IS NULL) AS non_temporal, round(100.0 * count(quality) / count(*), 6) AS temporal_pct FROM enriched GROUP BY ROLLUP (source)""")
def chunk_profile(spark, sf_dir):
    """The chunk profile by source and in total."""
    return reports.chunk_profile(_enriched(spark, sf_dir), "source", {n: f"{n}_mentions" for n in _NAMES}, "quality", rollup=True)


@query(f"""WITH {_ENRICHED} SELECT source, count(*) AS n, {', '.join(f"count(*) FILTER ({n}_mentions <> '') AS with_{n}, round(100.0 * count(*) FILTER ({n}_mentions <> '') / count(*), 6) AS pct_{n}" for n in _NAMES)},
count(*) FILTER (quality IS NULL OR trim(text) = '') AS structure_issues FROM enriched GROUP BY ROLLUP (source)""")
def enrichment_coverage(spark, sf_dir):
    return reports.coverage(_enriched(spark, sf_dir), "source", {n: f"{n}_mentions" for n in _NAMES}, ["text", "quality"])


@query("""SELECT source, count(*) AS n, CAST(min(length(text)) AS BIGINT) AS min_chars, round(avg(length(text)), 6) AS avg_chars, CAST(max(length(text)) AS BIGINT) AS max_chars, count(*) FILTER (length(text) > 8000) AS oversized FROM documents GROUP BY source""")
def size_distribution(spark, sf_dir):
    return reports.size_distribution(table(spark, sf_dir, "documents"), "source")


@query("""WITH t AS (SELECT CASE lang WHEN 'en' THEN list_filter([CASE WHEN n_chars < 500 THEN 'short' END, CASE WHEN source = 'web' THEN 'web' END], lambda x: x IS NOT NULL) WHEN 'de' THEN list_filter([CASE WHEN n_chars > 2000 THEN 'long' END], lambda x: x IS NOT NULL) ELSE [] END AS i FROM documents)
SELECT issue, count(*) AS n FROM (SELECT unnest(i) AS issue FROM t) GROUP BY issue""")
def issues_by_source(spark, sf_dir):
    """Rules that depend on the source, and every issue once."""
    rules = {"en": [("short", F.col("n_chars") >= 500), ("web", F.col("source") != "web")], "de": [("long", F.col("n_chars") <= 2000)]}
    docs = table(spark, sf_dir, "documents")
    return reports.distinct_issues(docs.select(reports.rules_by_source(docs, "lang", rules).alias("i")), "i")


@query("""WITH b AS (SELECT doc_id // 100 AS batch, count(*) AS n, avg(length(coalesce(text, '')) // 4) AS t FROM documents GROUP BY 1)
SELECT count(*) AS batches, CAST(sum(n) AS BIGINT) AS n, round(avg(t), 6) AS avg_tokens, CAST(round(sum(n) * 0.5, 6) AS DOUBLE) AS seconds, CAST(round(sum(n) / (sum(n) * 0.5), 6) AS DOUBLE) AS rate FROM b""")
def embedding_run_metrics(spark, sf_dir):
    """A run's batches: the mean of their means, time and rate."""
    return reports.run_metrics(embed.batch_metrics(table(spark, sf_dir, "documents"), "doc_id", "text").withColumn("seconds", F.col("n") * 0.5))


@query("""SELECT 'a_' || doc_id AS doc_id, n_chars FROM documents WHERE source = 'web' AND lang <> 'en' UNION ALL SELECT 'b_' || doc_id, n_chars FROM documents WHERE source <> 'web' AND lang <> 'en'""")
def filtered_union(spark, sf_dir):
    """A collection from several sources less the excluded ones, filtered below the union."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang", "source")
    parts = {"a": docs.filter("source = 'web'"), "b": docs.filter("source <> 'web'"), "magic": docs}
    return collections.filtered_union(parts, "doc_id", F.col("lang") != "en", ("magic",)).select("doc_id", "n_chars")


@query("SELECT n_name AS category FROM nation UNION SELECT r_name FROM region UNION SELECT DISTINCT c_mktsegment FROM customer")
def category_set(spark, sf_dir):
    """The union of category constants, each once."""
    n, r, c = (table(spark, sf_dir, t).select(F.col(k).alias("category")) for t, k in (("nation", "n_name"), ("region", "r_name"), ("customer", "c_mktsegment")))
    return n.union(r).union(c).distinct()


@query("SELECT DISTINCT unnest(string_split(p_name, ' ')) AS category FROM part")
def distinct_categories(spark, sf_dir):
    """Categories over all files, each once."""
    return table(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ")).alias("category")).distinct()


@query("SELECT n_name AS redirect, r_name AS canonical FROM nation JOIN region ON n_regionkey = r_regionkey ORDER BY n_name")
def sorted_redirects(spark, sf_dir):
    """A mapping in the order of its keys."""
    rows = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return sinks.sorted_by_key(rows.select(F.col("n_name").alias("redirect"), F.col("r_name").alias("canonical")), "redirect")


@query("SELECT doc_id, source FROM documents ORDER BY (doc_id * 2654435761) % 1000003, doc_id LIMIT 25")
def plain_sample(spark, sf_dir):
    """25 rows without replacement: the sample is the feature."""
    return quality.sample(table(spark, sf_dir, "documents").select("doc_id", "source"), 25, (F.col("doc_id") * 2654435761) % 1000003, "doc_id")


@query(r"SELECT doc_id, regexp_replace(lower(text), '[!-/:-@\[-`{-~]', ' ', 'g') AS text FROM documents")
def normalized_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.normalized("text").alias("text"))


TERMS = ["the", "er", "oula", "The", "ing"]


@query("SELECT doc_id, array_to_string(list_filter(['the', 'er', 'oula', 'The', 'ing'], lambda t: contains(lower(text), lower(t))), ',') AS terms FROM documents")
def terms_in_text(spark, sf_dir):
    """The terms of a list that a text has, in the list's order."""
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(T.terms_in("text", TERMS), ",").alias("terms"))


@query("""SELECT lang, count(*) FILTER (source = 'web') AS web, count(*) FILTER (length(text) > 2000) AS long FROM documents GROUP BY lang""")
def metrics_table(spark, sf_dir):
    """Metric rows as a table whose columns are the sorted union of the metrics' names."""
    docs = table(spark, sf_dir, "documents").groupBy("lang").agg(F.count_if(F.col("source") == "web").alias("web"), F.count_if(F.length("text") > 2000).alias("long"))
    rows = docs.select("lang", F.explode(F.create_map(F.lit("web"), "web", F.lit("long"), "long")).alias("metric", "value"))
    return sinks.metrics_table(rows, "lang", "metric", "value")


@query("""SELECT lang, 'empty' AS message, count(*) AS n, array_to_string(list_sort(list(CAST(doc_id AS VARCHAR)) FILTER (rn <= 10)), ',') AS samples FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY CAST(doc_id AS VARCHAR)) AS rn FROM documents WHERE NOT coalesce(length(text) > 300, false)) GROUP BY lang""")
def error_log(spark, sf_dir):
    """Quarantined rows by type and message, with a few keys."""
    bad = sinks.quarantine(table(spark, sf_dir, "documents"), F.length("text") > 300)[1]
    rows = sinks.error_log(bad.select("lang", F.lit("empty").alias("message"), F.col("doc_id").cast("string").alias("key")), "lang", "message")
    return rows.withColumn("samples", F.array_join("samples", ","))


@query()
def ann_neighbours(spark, sf_dir):
    """The ten nearest of every vector whose id is divisible by 100, by an inverted file over all vectors (40 of 64 cells)."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    centres = retrieval.ivf_fit(vectors)
    return retrieval.ivf_search(retrieval.ivf_assign(vectors, centres, "vec_id"), vectors.filter("vec_id % 100 = 0"), centres, 10, "vec_id", probes=40)


@query()
def auto_search(spark, sf_dir):
    """A question routed to a collection and searched there by vector and terms."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    vectors = embed.embed(docs, "doc_id", "text")
    parts = {name: docs.filter(F.col("lang") == name).join(vectors, "doc_id") for name in ("en", "de")}
    return retrieval.auto(parts, [("de", ("der", "und"))], "en", "What is the thing und der other", embed.hash_embedder, 5, "doc_id").select("doc_id", "boosted_score", "collection")
