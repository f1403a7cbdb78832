"""Index builders: attributes that follow from categories, ordered types, and the counters over them."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuscle.functions.text import col


def _array(values) -> Column:
    return F.array(*map(F.lit, values)).cast("array<string>")


def _spaced(c: Column) -> Column:
    return F.translate(c, "_", " ")


def first_of(cats: Column, values: dict[str, str]) -> Column:
    """The value of the first category that has one."""
    of = F.create_map(*(F.lit(x) for kv in values.items() for x in kv))
    return F.try_element_at(F.filter(F.transform(cats, lambda c: of[c]), lambda v: v.isNotNull()), F.lit(1))


def all_of(cats: Column, values: dict[str, str]) -> Column:
    """The values of all categories that have one, sorted; repeats stay."""
    of = F.create_map(*(F.lit(x) for kv in values.items() for x in kv))
    return F.array_sort(F.filter(F.transform(cats, lambda c: of[c]), lambda v: v.isNotNull()))


def members(cats: Column, *lists: tuple[str, ...]) -> Column:
    """The categories in any of the lists, with spaces, sorted."""
    return F.array_sort(F.transform(F.filter(cats, lambda c: F.array_contains(_array([x for own in lists for x in own]), c)), _spaced))


def with_suffix(cats: Column, suffix: str) -> Column:
    """The categories that end so, without the suffix and with spaces, sorted."""
    own = F.filter(cats, lambda c: c.endswith(suffix))
    return F.array_sort(F.transform(own, lambda c: _spaced(F.replace(F.replace(c, F.lit(f"_{suffix}"), F.lit("")), F.lit(suffix), F.lit("")))))


@dataclass(frozen=True)
class CharacterLists:
    """Which categories say what; the lists belong to the corpus and are input."""

    gender: dict[str, str]
    affiliations: tuple[str, ...] = ()  # whose members have the power
    kinds: dict[str, str] = field(default_factory=dict)  # kind of power by gender
    ajah: dict[str, str] = field(default_factory=dict)
    abilities: dict[str, str] = field(default_factory=dict)
    people: str = "(people)"
    organizations: tuple[str, ...] = ()
    military: tuple[str, ...] = ()
    social: tuple[str, ...] = ()
    military_roles: tuple[str, ...] = ()
    professions: tuple[str, ...] = ()
    dark: tuple[str, ...] = ()
    cultures: tuple[str, ...] = ()


def character_attributes(cats: str | Column, of: CharacterLists) -> dict[str, Column]:
    """The twelve attributes of a character by name, from its categories."""
    c, none = col(cats), F.lit(None).cast("string")
    gender = first_of(c, of.gender) if of.gender else none
    affiliations = members(c, of.affiliations)
    kind = F.create_map(*(F.lit(x) for kv in of.kinds.items() for x in kv))[gender] if of.kinds else none
    return {
        "gender": gender, "can_channel": F.size(affiliations) > 0, "channeling_type": F.when(F.size(affiliations) > 0, kind), "affiliations": affiliations,
        "ajah": first_of(c, of.ajah) if of.ajah else none, "special_abilities": all_of(c, of.abilities) if of.abilities else _array(()),
        "nationalities": with_suffix(c, of.people), "organizations": members(c, of.organizations), "military_groups": members(c, of.military),
        "social_roles": members(c, of.social, of.military_roles), "professions": members(c, of.professions), "alignment": members(c, of.dark), "cultural_groups": members(c, of.cultures),
    }


def index_statistics(index: DataFrame, kinds: tuple[str, str] = ("saidin", "saidar"), abilities: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """One row of counters over a character index with the columns of :func:`character_attributes`, aliases and books_appeared."""
    some = lambda c: F.count_if(F.size(c) > 0)
    power = F.col("can_channel")
    named = [F.count_if(F.arrays_overlap("special_abilities", _array(values))).alias(name) for name, values in (abilities or {}).items()]
    return index.agg(
        F.count("*").alias("total"), some("aliases").alias("with_aliases"), some("books_appeared").alias("with_books"), F.count_if(power).alias("channelers"),
        F.count_if(power & (F.col("channeling_type") == kinds[0])).alias("male_channelers"), F.count_if(power & (F.col("channeling_type") == kinds[1])).alias("female_channelers"),
        F.count("ajah").alias("with_ajah"), some("nationalities").alias("with_nationality"), some("organizations").alias("with_organizations"), some("alignment").alias("darkfriends"),
        some("professions").alias("with_professions"), *named,
    )


#: Prophecy types in order, by a part of the name or a category.
PROPHECY_TYPES = (("Foretelling", "foretelling", "Foretellings"), ("Viewing", "viewing", None), ("Prophecy", "prophecy", "Prophecies"))
#: Object types in order, and flags, by category.
OBJECT_TYPES = ("Angreal", "Sa'angreal", "Ter'angreal")
MAGIC_FLAGS = {"power_related": "One_Power", "is_weave": "Weaves", "is_talent": "Talents", "is_shadowspawn": "Shadowspawn"}


def ordered_type(name: str | Column, cats: str | Column, rules=PROPHECY_TYPES, default: str = "Unknown") -> Column:
    """The first type of which the name has the part, but for case, or the categories the category."""
    out, low = F.when(F.lit(False), ""), F.lower(col(name))
    for kind, part, category in rules:
        hit = F.contains(low, F.lit(part))
        out = out.when(hit | F.array_contains(col(cats), category) if category else hit, kind)
    return out.otherwise(default)


def object_type(cats: str | Column, types=OBJECT_TYPES) -> Column:
    """The first of the types that is a category; null without."""
    out = F.when(F.lit(False), "")
    for t in types:
        out = out.when(F.array_contains(col(cats), t), t)
    return out


def flags(cats: str | Column, names: dict[str, str] | None = None) -> dict[str, Column]:
    """Whether the categories have each flag's."""
    return {flag: F.array_contains(col(cats), c) for flag, c in (names or MAGIC_FLAGS).items()}


def type_counters(index: DataFrame, by: str, counters: dict[str, Column]) -> DataFrame:
    """By type and in total (type null): rows, and rows of each counter."""
    return index.rollup(by).agg(F.count("*").alias("n"), *(F.count_if(c).alias(name) for name, c in counters.items()))


def classified_counters(df: DataFrame, group: str, excluded: Column) -> DataFrame:
    """(group, n): rows by group; excluded rows and those without a group are groups of their own."""
    kind = F.when(F.coalesce(excluded, F.lit(False)), "excluded").otherwise(F.coalesce(group, F.lit("unclassified")))
    return df.groupBy(kind.alias("group")).agg(F.count("*").alias("n"))


def lookup_or_empty(df: DataFrame, key: str, known: DataFrame, value: str) -> DataFrame:
    """Add the array that `known` (one row a key) has for the key, the empty one where it has none."""
    empty = F.array().cast(known.schema[value].dataType)
    return df.join(known.select(key, value), key, "left").withColumn(value, F.coalesce(value, empty))


def counts_with_zero(wanted: DataFrame, key: str, counts: DataFrame, n: str = "n") -> DataFrame:
    """The wanted keys with their count, 0 where there is none."""
    return wanted.select(key).distinct().join(counts.select(key, n), key, "left").withColumn(n, F.coalesce(n, F.lit(0)))


def inverted(df: DataFrame, cats: str, name: str, redirects: DataFrame) -> DataFrame:
    """(category, n, names): rows by category, names sorted.

    Rows without a category count under unknown_redirection if their name is a redirect, else under
    unknown_category. Meant for names that are few for each category.
    """
    known = redirects.select(F.col("redirect").alias("__r")).distinct()
    rows = df.select(name, cats).join(known, F.col(name) == F.col("__r"), "left")
    none = F.array(F.when(F.col("__r").isNotNull(), "unknown_redirection").otherwise("unknown_category"))
    rows = rows.select(name, F.explode(F.when(F.size(cats) > 0, F.col(cats)).otherwise(none)).alias("category"))
    return rows.groupBy("category").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(name)).alias("names"))


def redirect_target(df: DataFrame, name: str, redirects: DataFrame) -> DataFrame:
    """Add canonical: where the name redirects to; null where it doesn't. Of several targets the least."""
    known = redirects.groupBy(F.col("redirect").alias(name)).agg(F.min("canonical").alias("canonical"))
    return df.join(known, name, "left")


def stubs(terms: DataFrame, glossary: DataFrame, existing: DataFrame, cats: list[str], order: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(pages, skipped): a page (file_name, text) for each term that has a definition and no file yet; the others with why.

    Of a term's definitions the first by `order` (columns of the glossary) counts, without it the least text; null ones are none.
    """
    from corpuscle.functions.text import safe_filename
    from corpuscle.sources.sinks import stub

    first = glossary.filter("definition is not null").groupBy("term").agg(F.min_by("definition", F.struct(*order, "definition")).alias("definition"))
    rows = terms.select("term").distinct().join(first, "term", "left")
    rows = rows.withColumn("file_name", F.concat(safe_filename("term"), F.lit(".txt")))
    there = existing.select("file_name").distinct().withColumn("__there", F.lit(True))
    rows = rows.join(there, "file_name", "left")
    why = F.when(F.col("definition").isNull(), "not in glossary").when(F.col("__there"), "file exists")
    rows = rows.withColumn("why", why)
    pages = rows.filter("why is null").select("file_name", stub(F.col("term"), F.col("definition"), _array(cats)).alias("text"))
    return pages, rows.filter("why is not null").select("term", "why")
