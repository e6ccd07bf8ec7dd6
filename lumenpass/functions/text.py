"""String functions and predicates as column expressions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumenpass import options as O

Text = Column | str


def _c(x: Text) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(value: Column, f) -> Column:
    """f(value) with the value computed once: a lambda would compute it for every element that refers to it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def blank(x: Text) -> Column:
    """Null, empty, or white space only."""
    return F.coalesce(F.trim(F.regexp_replace(_c(x), r"\s+", " ")) == "", F.lit(True))


def term_matches(text: Text) -> Column:
    """Terms in order, repeats included; null gives none."""
    return F.regexp_extract_all(F.lower(F.coalesce(_c(text), F.lit(""))), F.lit(O.TERM), 0)


def terms(text: Text) -> Column:
    return F.array_sort(F.array_distinct(term_matches(text)))


def normalize_whitespace(text: Text) -> Column:
    """Joins hyphenated line ends, makes every stretch of white space one blank, trims; null gives an empty text."""
    joined = F.regexp_replace(F.coalesce(_c(text), F.lit("")), r"(\p{L})-\s+(\p{Ll})", "$1$2")
    return F.trim(F.regexp_replace(joined, r"\s+", " "))


def term_frequencies_of(values: Text) -> Column:
    """All terms of several texts, one after another (an array column of texts)."""
    return F.flatten(F.transform(_c(values), term_matches))


def truncate(text: Text, max_chars: int) -> Column:
    t = _c(text)
    return F.when(t.isNull() | (F.length(t) <= max_chars), t).otherwise(F.concat(F.rtrim(F.substring(t, 1, max(0, max_chars))), F.lit("...")))


def strip_numbering(text: Text) -> Column:
    """Without colons at the end and a leading arabic or roman number (also words of roman letters, whatever case)."""
    t = F.regexp_replace(F.trim(_c(text)), ":+$", "")
    return F.trim(F.regexp_replace(t, r"(?i)^\s*(?:[0-9]+(?:\.[0-9]+)*|[IVXLCDM]+(?:\.[0-9]+)*)\.?\s+", ""))


def normalized_name(text: Text) -> Column:
    return F.lower(normalize_whitespace(strip_numbering(text)))


def format_chunk(heading: Text, chunk: Text) -> Column:
    return F.when(_c(heading).isNotNull(), F.concat(F.lit(O.SECTION_PREFIX + " "), _c(heading), F.lit("\n"), _c(chunk))).otherwise(_c(chunk))


def heading_of(text: Text) -> Column:
    """The heading that ``format_chunk`` put before a chunk, or null."""
    t = F.regexp_replace(_c(text), "\r\n", "\n")
    first = F.substring_index(t, "\n", 1)
    heading = F.trim(F.substring(first, len(O.SECTION_PREFIX) + 1, 1 << 30))
    return F.when(F.lower(F.substring(t, 1, len(O.SECTION_PREFIX))) == O.SECTION_PREFIX.lower(), F.nullif(heading, F.lit("")))


def strip_inline_markup(text: Text) -> Column:
    steps = [r"`([^`]+)`", r"\*\*([^*]+)\*\*", r"__([^_]+)__", r"\*([^*]+)\*", r"_([^_]+)_", r"\[(.*?)\]\([^)]+\)"]
    return normalize_whitespace(reduce(lambda t, p: F.regexp_replace(t, p, "$1"), steps, _c(text)))


def normalize_line(line: Text) -> Column:
    return F.rtrim(F.replace(_c(line), F.lit("\t"), F.lit("    ")))


def numbered_heading_parts(text: Text) -> Column:
    """[1, 2] for "1.2 Title"; null without a number or where a part is no 32-bit integer."""
    number = F.regexp_extract(F.coalesce(_c(text), F.lit("")), r"^\s*(\d+(?:\.\d+)*)\b", 1)
    parts = F.transform(F.split(number, r"\."), lambda p: p.try_cast("int"))
    return F.when((number != "") & ~F.exists(parts, lambda p: p.isNull()), parts)


# Classifiers


def is_likely_heading(text: Text) -> Column:
    heading = strip_numbering(text)
    found = terms(heading)
    letters = F.length(F.regexp_replace(heading, r"[^\p{L}]", ""))
    upper = F.length(F.regexp_replace(heading, r"[^\p{Lu}]", ""))
    ratio = F.when(letters == 0, F.lit(0.0)).otherwise(upper / letters)
    keyword = F.arrays_overlap(found, F.array(*map(F.lit, O.HEADING_TERMS)))
    return (
        F.length(heading).between(4, 100)
        & (F.size(found) <= 8)
        & ~heading.rlike(r"[.!?]\s+\p{Lu}")
        & ((ratio >= 0.65) | (F.coalesce(keyword, F.lit(False)) & (F.size(found) <= 5)))
    )


def section_matches(requested: Text, heading: Text) -> Column:
    """Equal names, or names within 1, 2 or 3 edits by the longer one's length; blank names only equal each other."""
    a, b = normalized_name(requested), normalized_name(heading)
    longer = F.greatest(F.length(a), F.length(b))
    limit = F.when(longer <= 6, 1).when(longer <= 12, 2).otherwise(3)
    return (a == b) | ((a != "") & (b != "") & (F.levenshtein(a, b) <= limit))


def is_checklist(text: Text) -> Column:
    t = F.lower(normalize_whitespace(text))
    return reduce(lambda x, y: x | y, [F.contains(t, F.lit(p)) for p in O.CHECKLIST_PHRASES])


def content_role(section_path: Text, text: Text) -> Column:
    """The role of a passage from its section path (an array) and its text."""
    names = F.transform(F.coalesce(_c(section_path), F.array().cast("array<string>")), normalized_name)

    def begins(*prefixes: str) -> Column:
        return F.exists(names, lambda n: reduce(lambda x, y: x | y, [F.startswith(n, F.lit(p)) for p in prefixes]))

    return (
        F.when(is_checklist(text) | F.arrays_overlap(names, F.array(*map(F.lit, O.CHECKLIST_SECTIONS))), "submission_checklist")
        .when(F.array_contains(names, "abstract"), "abstract")
        .when(begins("references", "bibliography"), "references")
        .when(begins("appendix"), "appendix")
        .when(F.size(names) > 0, "main_body")
        .otherwise("unknown")
    )


def structured_role(section_path: Text, text: Text, label: Text | None = None) -> Column:
    """As ``content_role``, but a title, and whatever stands under a path of one element, is front matter."""
    short = F.size(_c(section_path)) == 1
    front = short if label is None else (_c(label) == "title") | short
    return F.when(front, "front_matter").otherwise(content_role(section_path, text))


def role_display(role: Text) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for k, (d, _) in O.ROLES.items() for x in (k, d)]), _c(role))


def role_of_storage(value: Text) -> Column:
    """A role's storage name from any of its spellings; unknown otherwise."""
    key = F.regexp_replace(F.lower(F.trim(F.coalesce(_c(value), F.lit("")))), "[ _-]", "")
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for k in O.ROLES for x in (k.replace("_", ""), k)]), key), F.lit("unknown"))


def keep_block(text: Text, filter_numeric: bool = True) -> Column:
    return ~blank(text) & ~_c(text).rlike(r"^\d+$") if filter_numeric else ~blank(text)


def is_fence(line: Text) -> Column:
    return _c(line).rlike(r"^\s*(```|~~~)")


def is_list_line(line: Text) -> Column:
    return _c(line).rlike(r"^\s*[-+*]\s+") | _c(line).rlike(r"^\s*\d+[.)]\s+")


def is_table_line(line: Text) -> Column:
    t = F.trim(_c(line))
    return F.startswith(t, F.lit("|")) & F.endswith(t, F.lit("|"))


def markdown_heading(line: Text) -> Column:
    """(level, text) of an ATX heading, or null."""
    t = F.trim(_c(line))
    pattern = r"^(#{1,6})\s+(.+?)\s*#*\s*$"
    text = strip_inline_markup(F.regexp_extract(t, pattern, 2))
    return F.when(t.rlike(pattern) & (text != ""), F.struct(F.length(F.regexp_extract(t, pattern, 1)).alias("level"), text.alias("text")))


# Layout labels


def is_text_like(label: Text) -> Column:
    return _c(label).isin(*O.TEXT_LIKE)


def is_table_like(label: Text) -> Column:
    return _c(label).isin(*O.TABLE_LIKE)


def is_picture_like(label: Text) -> Column:
    return _c(label).isin(*O.PICTURE_LIKE)


def content_layer(label: Text) -> Column:
    return F.when(_c(label).isin("page_header", "page_footer"), "furniture").otherwise("body")


def layout_labels(label: Text) -> Column:
    """[label], but none for plain text, paragraphs, page headers and footers."""
    return F.when(_c(label).isin("text", "paragraph", "page_header", "page_footer"), F.array().cast("array<string>")).otherwise(F.array(_c(label)))


def item_label(label: Text, kind: str) -> Column:
    """The label that an element of a kind (text, table, picture) keeps."""
    c = _c(label)
    if kind == "text":
        return F.when(is_text_like(c), c).otherwise("text")
    return F.when(c == ("document_index" if kind == "table" else "chart"), c).otherwise(kind)


def reading_group(label: Text) -> Column:
    return F.when(_c(label) == "page_header", 0).when(_c(label) == "page_footer", 2).otherwise(1)


# Keywords


def clean_keywords(values: Text, limit: int | None = None) -> Column:
    """White space made plain, blanks dropped, the first spelling of each kept whatever its case, the first ``limit``."""
    tidy = F.filter(F.transform(F.coalesce(_c(values), F.array().cast("array<string>")), normalize_whitespace), lambda x: x != "")

    def first_spellings(p: Column) -> Column:
        each = F.array_distinct(p["l"])
        each = each if limit is None else F.slice(each, 1, max(0, limit))
        return F.transform(each, lambda x: F.element_at(p["t"], F.array_position(p["l"], x).cast("int")))

    return let(tidy, lambda t: let(F.struct(t.alias("t"), F.transform(t, F.lower).alias("l")), first_spellings))


def merge_keywords(existing: Text, generated: Text, limit: int = 16, replace: bool = False) -> Column:
    return clean_keywords(generated if replace else F.concat(_c(existing), _c(generated)), limit)


def label_keywords(label: Text) -> Column:
    c = _c(label)
    none = F.array().cast("array<string>")
    return F.when(c.isin("paragraph", "text"), none).when(c.isin("checkbox_selected", "checkbox_unselected"), F.array(F.lit("checkbox"))).otherwise(F.array(F.replace(c, F.lit("_"), F.lit(" "))))


def weak_keywords(label: Text, figure_classes: Text, explicit: Text) -> Column:
    """Explicit keywords if there are any; else those of the label and the figure classes, surest first."""
    own = clean_keywords(explicit, O.KEYWORD_LIMIT)
    surest = F.transform(F.array_sort(F.transform(_c(figure_classes), lambda c, i: F.struct((-c["confidence"]).alias("k"), i.alias("i"), c["class_name"].alias("n")))), lambda s: s["n"])
    return F.when(F.size(own) > 0, own).otherwise(clean_keywords(F.concat(label_keywords(label), surest), O.KEYWORD_LIMIT))


def role_keywords(role: Text) -> Column:
    return F.element_at(F.create_map(*[x for k, (_, w) in O.ROLES.items() for x in (F.lit(k), F.array(*map(F.lit, w)).cast("array<string>"))]), _c(role))


def block_role_keywords(role: Text) -> Column:
    return F.when(_c(role) == "unknown", F.array().cast("array<string>")).otherwise(F.array(role_display(role), _c(role)))


def deterministic_keywords(passage: dict[str, Text] | None = None) -> Column:
    """Keywords of a passage's section path, labels, captions, role and pages (the unknown role gives its names, too)."""
    p = {k: F.col(k) for k in ("section_path", "layout_labels", "captions", "content_role", "page_numbers")} | (passage or {})
    spaced = F.transform(p["layout_labels"], lambda x: F.replace(x, F.lit("_"), F.lit(" ")))
    role = F.coalesce(p["content_role"], F.lit("unknown"))
    paged = F.when(F.size(p["page_numbers"]) > 0, F.array(F.lit("page"), F.lit("pages"))).otherwise(F.array().cast("array<string>"))
    return clean_keywords(F.concat(p["section_path"], p["layout_labels"], spaced, p["captions"], F.array(role_display(role), role), role_keywords(role), paged))


def contextual_text() -> Column:
    """What is encoded: lines of metadata, a blank line, and the passage's text."""
    captions = clean_keywords(F.col("captions"))
    line = lambda name, value: F.concat(F.lit(name + ": "), value)
    metadata = F.array(
        line("Document", F.coalesce("source_display_name", F.lit(""))),
        F.when(F.col("content_role") != "unknown", line("Role", role_display("content_role"))),
        F.when(F.size("section_path") > 0, line("Section", F.array_join("section_path", " > "))),
        F.when(F.size("page_numbers") > 0, line("Pages", F.array_join(F.col("page_numbers").cast("array<string>"), ", "))),
        F.when(F.size(captions) > 0, line("Captions", F.array_join(captions, " | "))),
    )
    return F.concat(F.array_join(F.array_compact(metadata), "\n"), F.lit("\n\n"), F.col("text"))


def sorted_pages(prov: Text) -> Column:
    return F.array_sort(F.array_distinct(F.filter(F.transform(_c(prov), lambda p: p["page_no"]), lambda n: n > 0)))


def array_of(values: Sequence[str]) -> Column:
    return F.array(*map(F.lit, values)).cast("array<string>")
