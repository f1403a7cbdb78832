"""Queries over web pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuscle.functions import text as T
from corpuscle.operators import classify, parsing, resolve
from corpuscle.session import table

from .catalog import query

_STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"


_BARE = r"regexp_replace(regexp_replace(regexp_replace(html, '(?is)<!--.*?-->', '', 'g'), '(?is)<script\b.*?</script\s*>', '', 'g'), '(?is)<style\b.*?</style\s*>', '', 'g')"
_PARAGRAPH = r"regexp_replace(regexp_replace(x, '(?is)</p\s*>.*$', ''), '<[^>]*>', '', 'g')"
for _name, _sign in parsing.REFERENCES:
    _PARAGRAPH = f"replace({_PARAGRAPH}, '&{_name};', '{_sign.replace(chr(39), chr(39) * 2)}')"


@query(
    f"""SELECT page_id, CAST(i AS BIGINT) AS pos, p[i] AS paragraph FROM (SELECT page_id, list_filter(list_transform(regexp_split_to_array({_BARE}, '(?i)<p(\\s[^>]*)?>')[2:], lambda x: {_STRIP.format(_PARAGRAPH)}), lambda x: x <> '') AS p FROM pages), unnest(range(1, len(p) + 1)) AS r(i)"""
)
def html_paragraphs(spark, sf_dir):
    """Whole paragraphs: inner tags stripped, character references resolved (the tables' pages have named ones only)."""
    rows = table(spark, sf_dir, "pages").select("page_id", F.posexplode(parsing.paragraphs_of_html("html")).alias("pos", "paragraph"))
    return rows.select("page_id", (F.col("pos") + 1).cast("long").alias("pos"), "paragraph")


_STRIPPED = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
_CITED = r"regexp_replace(regexp_replace(array_to_string(list_filter(list_transform(regexp_split_to_array(body, '<[^>]*>'), lambda x: " + _STRIPPED.format("x") + r"), lambda x: x <> ''), ' '), '\[\s*[^\]]+\s*\]', '', 'g'), '\s{2,}', ' ', 'g')"


@query(rf"""SELECT page_id, 'Overview' AS title, replace(replace(replace(content, '&lt;', '<'), '&gt;', '>'), '&amp;', '&') AS content FROM (SELECT page_id, regexp_replace({_STRIPPED.format(_CITED)}, '\s+([.,!?;:])', '\1', 'g') AS content
FROM (SELECT page_id, regexp_extract(html, '(?s)<article><h1>[^<]*</h1>(.*)</article>', 1) AS body FROM pages)) WHERE length(content) > 2""")
def html_sections(spark, sf_dir):
    """Sections of the pages' articles. None of them has headings, and the first paragraph's open tags hold the others."""
    return parsing.parse_html(table(spark, sf_dir, "pages"), "page_id", "html")


@query("SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract(html, '<h1>([^<]*)</h1>', 1) AS h1 FROM pages")
def html_title_h1(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.regexp_extract("html", "<h1>([^<]*)</h1>", 1).alias("h1"))


@query("SELECT page_id, TRY_CAST(regexp_extract(html, '<!-- ad (\\d+) -->', 1) AS BIGINT) AS ad FROM pages")
def html_comment_meta(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", r"<!-- ad (\d+) -->", 1).try_cast("bigint").alias("ad"))


def _markup_sql(c: str) -> str:
    for pattern, to in T.MARKUP:
        c = f"regexp_replace({c}, '{pattern.replace(chr(39), chr(39) * 2)}', '{to.replace('$', chr(92))}', 'g')"
    return _STRIP.format(c)


@query(f"SELECT page_id, {_markup_sql('html')} AS text FROM pages")
def markup_clean(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.clean_markup("html").alias("text"))


@query("SELECT page_id, regexp_replace(translate(url, ' /', '__'), '[<>:\"|?*]', '', 'g') AS name FROM pages")
def safe_filename(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.safe_filename("url").alias("name"))


@query("SELECT page_id, CASE WHEN n > 1 THEN url || '_DUPLICATE_' || (n - 1) ELSE url END AS file_name FROM (SELECT page_id, split_part(url, '?', 1) AS url, row_number() OVER (PARTITION BY lower(split_part(url, '?', 1)) ORDER BY page_id) AS n FROM pages)")
def name_collisions(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").select("page_id", F.split_part("url", F.lit("?"), F.lit(1)).alias("url"))
    return resolve.collision_names(rows, "url", "page_id").select("page_id", "file_name")


_CATS = "list_distinct(regexp_extract_all(url, '(en|de|fr|es|example|net|com|org)', 1))"
_RULES = [("CHRONOLOGY", ["fr"]), ("CHARACTER", ["de", "es"]), ("CHAPTER", ["NET"])]


@query(
    f"""SELECT page_id, CASE WHEN len(c) = 0 THEN 'SKIP' WHEN list_has_any(c, ['org']) THEN 'SKIP' WHEN list_has_any(c, ['fr']) THEN 'CHRONOLOGY' WHEN list_has_any(c, ['de', 'es']) THEN 'CHARACTER'
WHEN list_has_any(c, ['net']) THEN 'CHAPTER' ELSE 'CONCEPT' END AS page_type FROM (SELECT page_id, {_CATS} AS c FROM pages)"""
)
def page_classify(spark, sf_dir):
    cats = F.array_distinct(F.regexp_extract_all("url", F.lit("(en|de|fr|es|example|net|com|org)"), F.lit(1)))
    return table(spark, sf_dir, "pages").select("page_id", classify.page_type(cats, _RULES, ["ORG"]).alias("page_type"))


@query(f"""SELECT page_id, len(c) = 0 OR list_has_any(c, ['net']) AS is_redirect, CASE WHEN len(c) = 0 OR list_has_any(c, ['net', 'org']) THEN 'SKIP' WHEN list_has_any(c, ['fr']) THEN 'CHRONOLOGY'
WHEN list_has_any(c, ['de', 'es']) THEN 'CHARACTER' ELSE 'CONCEPT' END AS page_type FROM (SELECT page_id, {_CATS} AS c FROM pages)""")
def redirect_pages(spark, sf_dir):
    """Pages that only point to others, and the types of the rest."""
    cats = F.array_distinct(F.regexp_extract_all("url", F.lit("(en|de|fr|es|example|net|com|org)"), F.lit(1)))
    redirects = ["Net"]
    return table(spark, sf_dir, "pages").select("page_id", classify.is_redirect(cats, redirects).alias("is_redirect"), classify.page_type(cats, _RULES, ["ORG"], redirects=redirects).alias("page_type"))


@query("SELECT CASE WHEN contains(url, '#') THEN 'fragment' WHEN contains(url, '?') THEN 'query' ELSE 'plain' END AS redirect_type, count(*) AS n FROM pages GROUP BY 1")
def redirect_types(spark, sf_dir):
    kind = F.when(F.contains("url", F.lit("#")), "fragment").when(F.contains("url", F.lit("?")), "query").otherwise("plain")
    return table(spark, sf_dir, "pages").groupBy(kind.alias("redirect_type")).agg(F.count("*").alias("n"))


_LABEL = "lower(regexp_extract(html, 'href=\"/([^\"]*)\"', 1))"
_GROUP = (
    "CASE "
    + " ".join(f"WHEN {_LABEL} IN ({', '.join(f"'{n}'" for n in names)}) THEN '{name}'" for name, names in parsing.INFOBOX_NAMES.items())
    + " "
    + " ".join(f"WHEN {' OR '.join(f"contains({_LABEL}, '{p}')" for p in parts)} THEN '{name}'" for name, parts in parsing.INFOBOX_PARTS.items())
    + " ELSE 'other' END"
)


@query(f"SELECT page_id, {_LABEL} AS label, {_GROUP} AS label_group FROM pages")
def infobox_group(spark, sf_dir):
    label = F.lower(F.regexp_extract("html", 'href="/([^"]*)"', 1))
    return table(spark, sf_dir, "pages").select("page_id", label.alias("label"), parsing.infobox_group(label).alias("label_group"))


@query("""SELECT page_id, '# ' || page_id || chr(10) || chr(10) || '<!-- Page ID: ' || page_id || ' -->' || chr(10) || '<!-- Categories: x -->' || chr(10) || chr(10) || '## Heading' || chr(10) || chr(10) || regexp_extract(html, '<h1>([^<]*)</h1>', 1) AS markdown,
CAST(page_id AS BIGINT) AS parsed_id, 'Heading' AS title, regexp_replace(regexp_extract(html, '<h1>([^<]*)</h1>', 1), '^\\s+|\\s+$', '', 'g') AS content FROM pages""")
def markdown_round_trip(spark, sf_dir):
    """Pages written as markdown and parsed again."""
    section = F.array(F.struct(F.lit("Heading").alias("title"), F.regexp_extract("html", "<h1>([^<]*)</h1>", 1).alias("content")))
    key = F.col("page_id").cast("string")
    rows = table(spark, sf_dir, "pages").select("page_id", parsing.page_markdown(key, key, F.array(F.lit("x")), section).alias("markdown"))
    sections = parsing.parse_markdown(rows, "page_id", "markdown").select("page_id", "title", "content")
    return rows.withColumn("parsed_id", T.page_id("markdown")).join(sections, "page_id")
