"""Raw text, markdown and HTML as section tables.

Line state machines are windows that carry the open marker forward, partitioned by document.
Only the walk over an HTML tree is Python, in Arrow batches with the standard library's parser.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuscle.functions.text import categories, chapter_number, col, first_h1, page_id, page_name, strip
from corpuscle.operators.scan import running

#: Whole lines that open a part of a book (fixed values).
MARKERS = ("PROLOGUE", "CHAPTER", "EPILOGUE", "GLOSSARY")


def lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, pos, line) in order; pos from 0."""
    return df.select(key, F.posexplode(F.split(col(text), "\n")).alias("pos", "line"))


def carry_sections(numbered: DataFrame, key: str, is_header: Column) -> DataFrame:
    """Add section: how many headers have come up to and with each line, 0 before the first.

    A prefix scan carries the count over segments of a document, however long it is.
    """
    return running(numbered, [key], ["pos"], {"section": is_header.cast("long")})


def _joined(rows: DataFrame, *by: str) -> DataFrame:
    body = F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"])
    return rows.groupBy(*by).agg(strip(F.array_join(body, "\n")).alias("content"))


def parse_books(df: DataFrame, key: str = "file_name", text: str = "text") -> DataFrame:
    """Chapters of raw book text: key, section, chapter_type, chapter_number, chapter_title, content.

    A marker is a whole line. After CHAPTER the next non-blank line is the number (0 when it is
    none) and the one after the title; after PROLOGUE and EPILOGUE the next is the title. The
    prologue is number 0, the epilogue the highest chapter so far plus one. Every marker ends the
    section before it. Text before the first marker and the glossary's are not chapters.
    """
    mark = F.regexp_replace(strip("line"), r"\\+$", "")
    rows = carry_sections(lines(df, key, text).withColumn("mark", mark), key, mark.isin(*MARKERS)).filter("section > 0")
    at = Window.partitionBy(key, "section").orderBy("pos")
    own = at.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumn("kind", F.first("mark").over(own))
    blank = strip("line") == ""
    nth = F.sum((~blank).cast("int")).over(at.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = rows.withColumn("nth", F.when(~blank, nth)).filter("kind <> 'GLOSSARY'")
    heads = F.when(F.col("kind") == "CHAPTER", 3).otherwise(2)
    line_at = lambda n: F.max(F.when(F.col("nth") == n, strip("line")))
    parts = rows.groupBy(key, "section", "kind").agg(line_at(2).alias("second"), line_at(3).alias("third"))
    number = F.when(F.col("kind") == "CHAPTER", F.coalesce(F.col("second").try_cast("int"), F.lit(0))).when(F.col("kind") == "PROLOGUE", 0)
    parts = parts.withColumn("chapter_number", number)
    before = Window.partitionBy(key).orderBy("section").rowsBetween(Window.unboundedPreceding, -1)
    highest = F.coalesce(F.max("chapter_number").over(before), F.lit(0)) + 1
    parts = parts.withColumn("chapter_number", F.coalesce("chapter_number", highest))
    body = _joined(rows.filter(F.col("nth").isNull() | (F.col("nth") > heads)), key, "section")
    title = F.regexp_replace(F.when(F.col("kind") == "CHAPTER", F.col("third")).otherwise(F.col("second")), r"^\*+|\*+$", "")
    return parts.join(body, [key, "section"], "left").select(
        key, "section", F.lower("kind").alias("chapter_type"), "chapter_number", strip(F.coalesce(title, F.lit(""))).alias("chapter_title"),
        F.coalesce("content", F.lit("")).alias("content"),
    )


def parse_glossary(df: DataFrame, key: str = "file_name", text: str = "text") -> DataFrame:
    """Entries of the GLOSSARY part: key, entry, term, pronunciation, description.

    '> ' opens an entry, '**term**' names it, '(...)' right after is its pronunciation, other
    lines continue the description. The last entry counts like any other.
    """
    mark = F.regexp_replace(strip("line"), r"\\+$", "")
    rows = carry_sections(lines(df, key, text).withColumn("mark", mark), key, mark.isin(*MARKERS))
    own = Window.partitionBy(key, "section").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.filter("section > 0").withColumn("kind", F.first("mark").over(own)).filter("kind = 'GLOSSARY' and mark <> 'GLOSSARY'")
    opens = F.col("line").startswith("> ")
    entry = F.sum(opens.cast("long")).over(Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = rows.withColumn("entry", entry).filter("entry > 0").withColumn("line", F.regexp_replace(F.regexp_replace("line", r"^>\s?", ""), r"\\+$", ""))
    text_of = F.regexp_replace(_joined_text(), r"\s+", " ")
    found = rows.groupBy(key, "entry").agg(strip(text_of).alias("body"))
    rest = strip(F.regexp_replace("body", r"^\*\*.*?\*\*:?\s*", ""))
    return found.select(
        key, "entry", strip(F.regexp_replace(F.regexp_extract("body", r"^\*\*(.*?)\*\*", 1), ":+$", "")).alias("term"),
        F.nullif(F.regexp_extract(rest, r"^\(([^)]*)\)", 1), F.lit("")).alias("pronunciation"),
        strip(F.regexp_replace(rest, r"^\([^)]*\):?\s*", "")).alias("description"),
    ).filter("term <> ''")


def _joined_text() -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n")


def parse_markdown(df: DataFrame, key: str, text: str) -> DataFrame:
    """Section tree as rows: key, h2, h3 (0: the section's own content), title, content.

    '## ' opens a section, '### ' a subsection inside one. Comment lines, rules ('---', '***',
    '___') and '# ' lines are skipped; deeper headings are content; what stands before the first
    section is dropped.
    """
    s = strip("line")
    keep = ~(s.startswith("<!--") | s.isin("---", "***", "___") | F.col("line").startswith("# "))
    rows = carry_sections(lines(df, key, text).filter(keep), key, F.col("line").startswith("## ")).withColumnRenamed("section", "h2").filter("h2 > 0")
    inner = Window.partitionBy(key, "h2").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("h3", F.sum(F.col("line").startswith("### ").cast("long")).over(inner))
    head = F.col("line").startswith("## ") | F.col("line").startswith("### ")
    title = F.max(F.when(head, strip(F.regexp_replace("line", r"^#{2,3} ", "")))).alias("title")
    body = strip(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~head, F.struct("pos", "line")))), lambda x: x["line"]), "\n"))
    return rows.groupBy(key, "h2", "h3").agg(title, body.alias("content"))


def section_tree(sections: DataFrame, key: str) -> DataFrame:
    """One row per key with the nested array of :data:`corpuscle.schemas.SECTIONS`."""
    subs = F.transform(
        F.array_sort(F.collect_list(F.when(F.col("h3") > 0, F.struct("h3", "title", "content")))),
        lambda x: F.struct(F.lit(3).alias("level"), x["title"].alias("title"), x["content"].alias("content")),
    )
    by = sections.groupBy(key, "h2").agg(F.max(F.when(F.col("h3") == 0, F.col("title"))).alias("title"), F.max(F.when(F.col("h3") == 0, F.col("content"))).alias("content"), subs.alias("subsections"))
    tree = F.transform(
        F.array_sort(F.collect_list(F.struct("h2", "title", "content", "subsections"))),
        lambda x: F.struct(F.lit(2).alias("level"), x["title"].alias("title"), x["content"].alias("content"), x["subsections"].alias("subsections")),
    )
    return by.groupBy(key).agg(tree.alias("sections"))


#: A list of books up to this size goes to every task.
FEW_BOOKS = 10_000


def _books(books: DataFrame) -> DataFrame:
    """(__t, temporal_order) by stripped title; broadcast if counted to be few."""
    named = books.select(strip("book_title").alias("__t"), F.col("book_number").alias("temporal_order"))
    return F.broadcast(named) if named.count() <= FEW_BOOKS else named


def split_temporal(sections: DataFrame, books: DataFrame) -> DataFrame:
    """Sections (h2 level, with their subsections) whose stripped title is a book's get its number; others stay without.

    Adds temporal_order, type and subsections (array of struct h3, title, content, in order).
    """
    keys = [c for c in sections.columns if c not in ("h3", "title", "content")]
    subs = F.array_sort(F.collect_list(F.when(F.col("h3") > 0, F.struct("h3", "title", "content"))))
    own = sections.groupBy(*keys).agg(*(F.max(F.when(F.col("h3") == 0, F.col(c))).alias(c) for c in ("title", "content")), subs.alias("subsections"))
    out = own.join(_books(books), strip("title") == F.col("__t"), "left").drop("__t")
    return out.withColumn("type", F.when(F.col("temporal_order").isNull(), "non_temporal").otherwise("temporal"))


def character_sections(sections: DataFrame, key: str, books: DataFrame) -> DataFrame:
    """(key, h2, h3, type, book_number, title, content) of character pages, from the rows of :func:`parse_markdown`.

    Under the first section called activities each subsection is in time: 'temporal' if its title is a
    book's, else an 'event'; the section's own content is dropped. Other sections and their subsections
    are 'non_temporal'.
    """
    title = F.lower("title") == "activities"
    acts = sections.filter((F.col("h3") == 0) & title).groupBy(key).agg(F.min("h2").alias("__first"))
    named = sections.filter((F.col("h3") == 0) & title).select(key, F.col("h2"), F.lit(True).alias("__act"))
    rows = sections.join(acts, key, "left").join(named, [key, "h2"], "left")
    rows = rows.join(_books(books), (strip("title") == F.col("__t")) & (F.col("h2") == F.col("__first")) & (F.col("h3") > 0), "left")
    first = F.coalesce(F.col("h2") == F.col("__first"), F.lit(False))
    kind = F.when(first & (F.col("h3") > 0), F.when(F.col("temporal_order").isNotNull(), "temporal").otherwise("event")).when(F.col("__act").isNull(), "non_temporal")
    return rows.withColumn("type", kind).filter("type is not null").select(key, "h2", "h3", "type", F.col("temporal_order").alias("book_number"), "title", "content")


def parse_typed(files: DataFrame, key: str, text: str, page_type: Column, wanted: str) -> DataFrame:
    """Sections of the files of one type, with their page name, id and categories; the type is decided before content is parsed."""
    own = files.withColumn("page_type", page_type).filter(F.col("page_type") == wanted)
    head = own.select(key, "page_type", page_name(text, key).alias("page_name"), page_id(text).alias("page_id"), categories(text).alias("categories"))
    return parse_markdown(own, key, text).join(head, key)


def summary_pages(files: DataFrame, key: str, text: str, books: DataFrame) -> DataFrame:
    """(key, book_number, chapter_number, chapter_title) of chapter-summary pages: by category, file name and first heading."""
    from corpuscle.operators.pages import book_by_category

    rows = files.select(key, chapter_number(key).alias("chapter_number"), first_h1(text).alias("chapter_title"), categories(text).alias("categories"))
    return rows.join(book_by_category(rows, key, "categories", books), key).select(key, "book_number", "chapter_number", "chapter_title")


#: Elements that have no end tag (fixed values of the format).
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}


#: Where a page's content stands, what of it is left out by element and class, headings that open nothing.
ROOTS = (("div", "mw-parser-output"), ("article", ""), ("body", ""))
LEFT_OUT = ({"aside", "div", "table"}, {"portable-infobox", "navbox", "wikitable"})
APPARATUS = {"contents", "references", "notes"}


class Element:
    """An element of a page: its name, classes and children, which are elements and texts."""

    __slots__ = ("name", "classes", "children")

    def __init__(self, name: str, classes: list[str]) -> None:
        self.name, self.classes, self.children = name, classes, []

    def texts(self) -> list[str]:
        """Texts below in order, stripped, without empty ones, scripts and styles."""
        out, todo = [], [self]
        while todo:
            x = todo.pop()
            if isinstance(x, str):
                if t := x.strip():
                    out.append(t)
            elif x is self or x.name not in ("script", "style"):
                todo += reversed(x.children)
        return out

    def text(self) -> str:
        return " ".join(self.texts())

    def first(self, name: str, cls: str = "") -> Element | None:
        """The first element below with a name, and a class if one is asked for."""
        todo = [self]
        while todo:
            x = todo.pop()
            if not isinstance(x, str):
                if x is not self and x.name == name and (not cls or cls in x.classes):
                    return x
                todo += reversed(x.children)
        return None


class _Document(HTMLParser):
    """The tree of a page as it is tagged: only an end tag closes an element, with all that is open in it; one without a start is ignored."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open = [Element("", [])]
        self.names: dict[str, int] = {}

    def handle_starttag(self, tag, attrs):
        new = Element(tag, (dict(attrs).get("class") or "").split())
        self.open[-1].children.append(new)
        if tag not in VOID:
            self.open.append(new)
            self.names[tag] = self.names.get(tag, 0) + 1

    def handle_startendtag(self, tag, attrs):
        """An element that ends at once holds nothing."""
        self.open[-1].children.append(Element(tag, []))

    def handle_endtag(self, tag):
        if self.names.get(tag):
            while (last := self.open.pop()).name != tag:
                self.names[last.name] -= 1
            self.names[tag] -= 1

    def handle_data(self, data):
        self.open[-1].children.append(data)


def _paragraph(text: str) -> str:
    """Without bracketed citations, and no space before a sign."""
    text = re.sub(r"\s{2,}", " ", re.sub(r"\[\s*[^\]]+\s*\]", "", text)).strip()
    return re.sub(r"\s+([.,!?;:])", r"\1", text)


def page_sections(html: str, headline: str | None = None) -> dict[str, str]:
    """Sections of a page by title: parts of its content, each a child of the page's root, joined by an empty line.

    An h2 opens a section (what comes before is 'Overview'), an h3 is a part '### title'; with `headline`, only those that have a span
    of that class, whose text is the title. Apparatus headings are passed over. Paragraphs over two characters, the items of a list
    ('- item' by line) and the terms ('**term**') and descriptions of a definition list are parts; other children are not. A later section with parts replaces one of its title.
    """
    page = _Document()
    page.feed(html)
    page.close()
    document = page.open[0]
    root = next((x for name, cls in ROOTS if (x := document.first(name, cls))), document)
    todo = [root]
    while todo:  # what is left out goes wherever it stands
        x = todo.pop()
        x.children = [c for c in x.children if isinstance(c, str) or not (c.name in LEFT_OUT[0] and LEFT_OUT[1] & set(c.classes))]
        todo += [c for c in x.children if not isinstance(c, str)]
    out: dict[str, str] = {}
    title, parts = "Overview", []
    for e in root.children:
        if isinstance(e, str):
            continue
        if e.name in ("h2", "h3"):
            head = e.first("span", headline) if headline else e
            name = head.text() if head else ""
            known = APPARATUS if e.name == "h2" else APPARATUS - {"contents"}
            if head is None or name.lower() in known:
                continue
            if e.name == "h3":
                parts.append(f"### {name}")
                continue
            if parts:
                out[title] = "\n\n".join(parts)
            title, parts = name, []
        elif e.name == "p":
            if len(text := _paragraph(e.text())) > 2:
                parts.append(text)
        elif e.name in ("ul", "ol"):
            if items := [f"- {t}" for c in e.children if not isinstance(c, str) and c.name == "li" and (t := c.text())]:
                parts.append("\n".join(items))
        elif e.name == "dl":
            if items := [f"**{t}**" if c.name == "dt" else t for c in e.children if not isinstance(c, str) and c.name in ("dt", "dd") and (t := c.text())]:
                parts.append("\n\n".join(items))
    if parts:
        out[title] = "\n\n".join(parts)
    return out


def parse_html(df: DataFrame, key: str, html: str, headline: str | None = None) -> DataFrame:
    """(key, title, content) for each section of a page by :func:`page_sections`, in no order. Null pages have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(k, t, c) for k, page in enumerate(batch.column(html).to_pylist()) for t, c in page_sections(page or "", headline).items()]
            keys, titles, contents = ([r[i] for r in rows] for i in range(3))
            yield pa.RecordBatch.from_arrays([batch.column(key).take(pa.array(keys, pa.int64())), pa.array(titles, pa.string()), pa.array(contents, pa.string())], names=[key, "title", "content"])

    return df.select(key, html).mapInArrow(run, f"{key} {df.schema[key].dataType.simpleString()}, title string, content string")


#: Character references of paragraphs, the ampersand's last.
REFERENCES = (("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'"), ("nbsp", " "), ("amp", "&"))


def paragraphs_of_html(html: str | Column) -> Column:
    """Texts of the <p> elements in order, inner tags stripped and character references resolved; no Python.

    A paragraph ends at </p>, or where the next begins. References are the numeric ones below 65,536 and REFERENCES.
    """
    bare = F.regexp_replace(col(html), r"(?is)<!--.*?-->|<(script|style)\b.*?</\1\s*>", "")
    found = F.regexp_extract_all(bare, F.lit(r"(?is)<p(?:\s[^>]*)?>(.*?)(?=</p\s*>|<p[\s>]|\z)"), F.lit(1))

    def number(x: Column, pattern: str, base: int) -> Column:
        """The text with its numeric references resolved, part by part."""
        parts = F.split(x, f"(?i)(?=&#{pattern};)")

        def own(t: Column) -> Column:
            digits = F.regexp_extract(t, f"(?i)^&#{pattern};", 1)
            code = F.conv(digits, base, 10).cast("int")
            utf16 = F.decode(F.unhex(F.lpad(F.hex(code), 4, "0")), "UTF-16BE")
            fits = (digits != "") & (F.length(digits) <= 5) & code.between(1, 0xFFFF) & ~code.between(0xD800, 0xDFFF)
            return F.when(fits, F.concat(utf16, F.regexp_replace(t, "^&#[^;]*;", ""))).otherwise(t)

        return F.array_join(F.transform(parts, own), "")

    def clean(x: Column) -> Column:
        x = F.regexp_replace(x, "<[^>]*>", "")
        x = number(number(x, "([0-9]+)", 10), "x([0-9a-f]+)", 16)
        for name, sign in REFERENCES:
            x = F.replace(x, F.lit(f"&{name};"), F.lit(sign))
        return strip(x)

    return F.filter(F.transform(found, clean), lambda x: x != "")


#: Infobox labels that have a group by name.
INFOBOX_NAMES = {
    "biographical": ("nationality", "current status", "status", "title", "affiliation"),
    "physical": ("gender", "height", "build"),
    "chronological": ("first appeared", "last appeared", "first appearance", "last appearance"),
}
#: Parts of labels that give all other labels their group, groups in this order.
INFOBOX_PARTS = {
    "biographical": (
        "nationality", "nation", "status", "current status", "title", "rank", "affiliation", "occupation", "family", "spouse",
        "children", "parents", "siblings", "house", "clan", "organization", "allegiance",
    ),
    "physical": ("hair", "eyes", "eye", "height", "build", "complexion", "skin", "appearance", "physical", "gender", "sex", "race", "species"),
    "chronological": (
        "birth", "death", "died", "born", "first", "last", "appearance", "appeared", "mentioned", "pov", "book", "debut", "final",
    ),
}


def infobox_group(label: str | Column) -> Column:
    low, out = F.lower(col(label)), F.when(F.lit(False), "")
    for name, labels in INFOBOX_NAMES.items():
        out = out.when(low.isin(*labels), name)
    for name, parts in INFOBOX_PARTS.items():
        out = out.when(F.exists(F.array(*map(F.lit, parts)), lambda p: F.contains(low, p)), name)
    return out.otherwise("other")


class _Infobox(HTMLParser):
    """Labels and values of the first element that is an infobox, by group.

    A field's group follows from its label; inside a headed section it also stands in the group of the heading.
    """

    GROUPS = (("biographical", ("biographical",)), ("physical", ("physical",)), ("chronological", ("chronological", "political")))

    def __init__(self, tag: str, name: str):
        super().__init__(convert_charrefs=True)
        self.root, self.open, self.done = (tag, name), [], False
        self.texts: dict[int, list[str]] = {}  # of open elements by depth
        self.fields: list[tuple[str, str, str | None]] = []
        self.section: tuple[int, list[str]] | None = None
        self.item: tuple[int, dict[str, str]] | None = None
        self.held: list[tuple[str, str]] = []

    def handle_starttag(self, tag, attrs):
        classes = set((dict(attrs).get("class") or "").split())
        if tag in VOID or self.done or not (self.open or tag == self.root[0] and self.root[1] in classes):
            return
        self.open.append((tag, classes))
        at = len(self.open)
        if tag == "section" and "pi-item" in classes and self.section is None:
            self.section, self.held = (at, []), []
        if tag == "div" and "pi-data" in classes and self.item is None:
            self.item = (at, {})
        if (tag == "h2" and "pi-header" in classes) or self.item and ((tag == "h3" and "pi-data-label" in classes) or (tag == "div" and "pi-data-value" in classes)):
            self.texts[at] = []

    def handle_startendtag(self, tag, attrs):
        """An element that ends at once holds nothing."""

    def handle_data(self, data):
        if self.open and data.strip():
            for own in self.texts.values():
                own.append(data.strip())

    def handle_endtag(self, tag):
        if not any(t == tag for t, _ in self.open):
            return
        while True:
            at, (name, classes) = len(self.open), self.open.pop()
            text = " ".join(self.texts.pop(at, []))
            if name == "h2" and "pi-header" in classes and self.section:
                self.section[1].append(text)
            if self.item and at > self.item[0]:
                kind = "label" if "pi-data-label" in classes and name == "h3" else "value" if "pi-data-value" in classes and name == "div" else ""
                if kind:
                    self.item[1].setdefault(kind, text)
            if self.item and at == self.item[0]:
                own, self.item = self.item[1], None
                if "label" in own and own.get("value"):
                    self.fields.append((own["label"], own["value"], None))
                    self.held.append((own["label"], own["value"]))
            if self.section and at == self.section[0]:
                heads, self.section = self.section[1], None
                low = heads[0].lower() if heads else ""
                group = next((g for g, parts in self.GROUPS if any(p in low for p in parts)), "other")
                self.fields += [(k, v, group) for k, v in self.held]
            if not self.open:
                self.done = True
            if name == tag:
                return


def infobox_fields(page: str) -> list[tuple[str, str, str | None]]:
    """(label, value, group of the section or None) of the page's infobox, in the order in which they are found."""
    for tag, name in (("aside", "portable-infobox"), ("table", "infobox")):
        box = _Infobox(tag, name)
        box.feed(page)
        box.close()
        if box.open or box.done:
            return box.fields
    return []


def infobox(df: DataFrame, key: str, html: str) -> DataFrame:
    """(key, label_group, label, value): the fields of each page's infobox, a label once a group, the last value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(k, i, *f) for k, page in enumerate(batch.column(html).to_pylist()) for i, f in enumerate(infobox_fields(page or ""))]
            columns = [batch.column(key).take(pa.array([r[0] for r in rows], pa.int64())), pa.array([r[1] for r in rows], pa.int32()), *(pa.array([r[c] for r in rows], pa.string()) for c in (2, 3, 4))]
            yield pa.RecordBatch.from_arrays(columns, names=[key, "pos", "label", "value", "section"])

    found = df.select(key, html).mapInArrow(run, f"{key} {df.schema[key].dataType.simpleString()}, pos int, label string, value string, section string")
    # What a section says comes after what the labels say.
    found = found.withColumn("label_group", F.coalesce("section", infobox_group("label")))
    order = F.struct(F.col("section").isNotNull(), "pos")
    return found.groupBy(key, "label_group", "label").agg(F.max_by("value", order).alias("value"))


def _of_group(group: str):
    return lambda x: x["label_group"] == group


def page_markdown(name: Column, page_id: Column, cats: Column, sections: Column, box: Column | None = None, nested: bool = False) -> Column:
    """A page as markdown: H1, metadata comments (at most 20 categories), the infobox, then its sections.

    box: array of struct(label_group, label, value). nested: sections have subsections (array of struct title, content).
    """
    head = F.concat(F.lit("# "), name, F.lit("\n\n<!-- Page ID: "), page_id.cast("string"), F.lit(" -->\n<!-- Categories: "), F.array_join(F.slice(cats, 1, 20), ", "), F.lit(" -->"))
    parts = [head]
    if box is not None:
        for group in ("biographical", "physical", "chronological", "other"):
            own = F.filter(box, _of_group(group))
            lines_ = F.transform(own, lambda x: F.concat(F.lit("**"), x["label"], F.lit(":** "), x["value"]))
            parts.append(F.when(F.size(own) > 0, F.concat(F.lit(f"## {group.capitalize()} information\n\n"), F.array_join(lines_, "\n"))))

    def shown(s: Column) -> Column:
        return F.concat(F.lit("## "), s["title"], F.lit("\n\n"), s["content"])

    def under(s: Column) -> Column:
        return F.array_join(F.transform(s["subsections"], lambda x: F.concat(F.lit("### "), x["title"], F.lit("\n\n"), x["content"])), "\n\n")

    whole = F.transform(sections, lambda s: F.concat_ws("\n\n", shown(s), F.nullif(under(s), F.lit(""))) if nested else shown(s))
    return F.concat_ws("\n\n", *parts, F.array_join(whole, "\n\n"))
