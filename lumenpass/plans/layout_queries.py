"""Registered queries on extracted pages, layouts, document JSON and images."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenpass.functions import geometry as G
from lumenpass.functions import images
from lumenpass.functions import text as T
from lumenpass.operators import assembly, markdown
from lumenpass.options import PassageSource
from lumenpass.plans.registry import query, table
from lumenpass.plans.sql import MARKDOWN_SECTIONS, S_ROLE, s_heading, s_name, s_norm, s_packed, s_strip, s_windows
from lumenpass.sources import docjson, documents

# Layouts: eight slots on a page, a line of a document in each, its words as cells

SLOTS = ("text", "page_footer", "title", "page_header", "picture", "section_header", "table", "form")
_NONBLANK = "SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS ls FROM documents"


def _box(left: float, top: float, right: float, bottom: float) -> dict:
    return {"l": left, "t": top, "r": right, "b": bottom, "coord_origin": "TOPLEFT"}


def predict(page_no: int, width: int, height: int, pixels: bytes) -> list[dict]:
    """All slots of every page, the lowest first."""
    return [{"id": 0, "label": label, "confidence": 0.5, "bbox": _box(0.0, 10.0 * j, 1e6, 10.0 * j + 9), "cells": []} for j, label in reversed(list(enumerate(SLOTS)))]


def classify(width: int, height: int, pixels: bytes) -> list[tuple[str, float]]:
    """Sure of a chart if the crop is the picture's slot: ten pixels wide, nine high, all of them 7."""
    return [("photo", 0.25), ("chart", 0.5 if (width, height, set(pixels)) == (10, 9, {7}) else 0.125)]


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page inputs; on even pages the boxes count from the bottom."""
    lines = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    placed = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(lines).alias("i", "line")).withColumn("page_no", F.floor(F.col("i") / 8).cast("int") + 1)
    words = F.filter(F.split("line", " "), lambda x: x != "")
    top, up = (F.col("i") % 8) * 10.0 + 1, F.col("page_no") % 2 == 0

    def cell(x: Column, k: Column) -> Column:
        t = top + (k % 3) * 0.5
        sides = k * 10.0, F.when(up, 80 - t - 5).otherwise(t), k * 10.0 + 8, F.when(up, 80 - t).otherwise(t + 5)
        return F.struct(x.alias("text"), G.box(*sides, F.when(up, "BOTTOMLEFT").otherwise("TOPLEFT")).alias("bbox"), F.lit(1.0).alias("confidence"))

    gathered = placed.select("doc_id", "page_no", "i", F.transform(words, cell).alias("c")).groupBy("doc_id", "page_no").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("i", "c"))), lambda x: F.reverse(x["c"]))).alias("cells"))
    name = F.col("doc_id").cast("string")
    return gathered.select(name.alias("doc"), F.concat(name, F.lit(".pdf")).alias("origin"), "page_no", F.lit(10).alias("width"), F.lit(80).alias("height"), F.unhex(F.repeat(F.lit("07"), 2400)).alias("pixels"), "cells")


def _layout_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assembly.convert(_pages(spark, sf_dir), predict, classify=classify)


_LAYOUT_SQL = f"""held AS ({_NONBLANK}),
  slots AS (SELECT doc_id, p, j, ls[(p - 1) * 8 + j + 1] AS line FROM (SELECT *, unnest(range(1, (len(ls) + 7) // 8 + 1)) AS p FROM held), (SELECT unnest(range(0, 8)) AS j)),
  named AS (SELECT *, CASE j {" ".join(f"WHEN {j} THEN '{x}'" for j, x in enumerate(SLOTS))} END AS own, coalesce({s_norm("line")}, '') AS txt FROM slots),
  items AS (SELECT *, CASE own WHEN 'table' THEN 'tables' WHEN 'picture' THEN 'pictures' ELSE 'texts' END AS kind, CASE own WHEN 'form' THEN 'text' ELSE own END AS label,
    CASE WHEN own IN ('page_header', 'page_footer') THEN 'furniture' ELSE 'body' END AS layer, row_number() OVER (PARTITION BY doc_id ORDER BY p, CASE own WHEN 'page_header' THEN 0 WHEN 'page_footer' THEN 2 ELSE 1 END, j) AS nth
    FROM named WHERE txt <> '' OR own IN ('table', 'picture')),
  told AS (SELECT *, '#/' || kind || '/' || (row_number() OVER (PARTITION BY doc_id, kind ORDER BY nth) - 1) AS ref, row_number() OVER (PARTITION BY doc_id, layer ORDER BY nth) AS place,
    CASE kind WHEN 'texts' THEN txt WHEN 'pictures' THEN '[Picture: chart (0.500), photo (0.250)]' ELSE CASE WHEN line IS NULL THEN '[Table]' ELSE array_to_string(list_filter(string_split(line, ' '), lambda x: x <> ''), chr(10)) END END AS said,
    CASE label WHEN 'text' THEN '' WHEN 'picture' THEN 'picture|chart|photo' ELSE replace(label, '_', ' ') END AS keywords FROM items)"""


@query(f"WITH {_LAYOUT_SQL} SELECT doc_id::VARCHAR AS doc, ref, label, layer, place::INT AS place, p::INT AS page_no, j * 10.0::DOUBLE AS top, said, keywords, CASE kind WHEN 'texts' THEN length(txt) ELSE 0 END::INT AS span, doc_id || '.pdf' AS source FROM told")
def layout_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every item of documents assembled from page layouts: cells to clusters, reading order, tables, classified pictures."""
    d = _layout_documents(spark, sf_dir).where("error is null").select("doc", "document.*")
    said = lambda of, f: F.arrow_udf(lambda x: pa.array([None if i is None else [f(j) for j in i] for i in x.to_pylist()], pa.list_(pa.string())), "array<string>")(of)
    # only the fields that the texts are made of go to a worker
    cells = lambda t: F.transform(t["data"]["table_cells"], lambda c: F.struct(*[c[n].alias(n) for n in ("text", "start_row_offset_idx", "start_col_offset_idx")]))
    table_texts = said(F.transform("tables", lambda t: F.struct(F.struct(t["data"]["num_rows"].alias("num_rows"), cells(t).alias("table_cells")).alias("data"))), assembly.table_text)
    picture_texts = said(F.transform("pictures", lambda p: F.struct(p["classifications"].alias("classifications"))), assembly.picture_text)
    texts = F.transform("texts", lambda t: t["text"])

    def items(kind: str, said: str) -> Column:
        fields = ("self_ref", "label", "content_layer", "keywords", "prov", "source_display_name")
        return F.transform(kind, lambda i, k: F.struct(*[i[c].alias(c) for c in fields], F.get(F.col(said), k).alias("said")))

    d = d.withColumns({"a": texts, "b": table_texts, "c": picture_texts})
    every = d.select("doc", "body_children", "furniture_children", F.inline(F.concat(items("texts", "a"), items("tables", "b"), items("pictures", "c"))))
    place = F.when(F.col("content_layer") == "body", F.array_position("body_children", F.col("self_ref"))).otherwise(F.array_position("furniture_children", F.col("self_ref")))
    p = F.col("prov")[0]
    return every.select("doc", F.col("self_ref").alias("ref"), "label", F.col("content_layer").alias("layer"), place.cast("int").alias("place"), p["page_no"].alias("page_no"), p["bbox"]["t"].alias("top"), "said", F.array_join("keywords", "|").alias("keywords"), p["char_span"]["end"].alias("span"), F.col("source_display_name").alias("source"))


@query(f"WITH {_LAYOUT_SQL} SELECT doc_id::VARCHAR AS doc, count(*)::BIGINT AS n_items, bool_and(regexp_matches(said, '.')) AS said, 'Missing layout predictions for pages: 1.' AS error FROM told GROUP BY doc_id")
def layout_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same documents in numbers, beside what becomes of them where the first page has no prediction."""
    pages = _pages(spark, sf_dir)
    whole = _layout_documents(spark, sf_dir).select("doc", F.size("document.texts").alias("a"), F.size("document.tables").alias("b"), F.size("document.pictures").alias("c"))
    partly = assembly.convert_pages(pages, assembly.predict_layout(pages.where("page_no > 1"), predict))
    joined = whole.join(partly.select("doc", "error"), "doc", "left")
    return joined.select("doc", (F.col("a") + F.col("b") + F.col("c")).cast("long").alias("n_items"), (F.col("a") >= 0).alias("said"), "error")


@query(
    f"""WITH l AS (SELECT doc_id, list_filter(string_split(text, ' '), lambda x: x <> '') AS ws FROM documents)
    SELECT doc_id::VARCHAR AS path, k::INT AS cell_no, w AS text, k * 2.0::DOUBLE AS l, k * 2 + 1.5::DOUBLE AS r, 'BOTTOMLEFT' AS origin FROM (SELECT doc_id, k, {s_norm("ws[k + 1]")} AS w FROM (SELECT *, unnest(range(0, len(ws))) AS k FROM l)) WHERE w <> ''"""
)
def page_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of a page as cells."""
    words = F.filter(F.split("text", " "), lambda x: x != "")
    placed = F.transform(words, lambda x, k: F.struct(x.alias("text"), (k * 2.0).alias("l"), F.lit(0.0).alias("t"), (k * 2 + 1.5).cast("double").alias("r"), F.lit(1.0).alias("b")))
    pages = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), F.lit(1).alias("page_no"), F.lit(10.0).alias("width"), F.lit(10.0).alias("height"), placed.alias("words"))
    return documents.page_cells(pages).select("path", "cell_no", "text", F.col("bbox.l").alias("l"), F.col("bbox.r").alias("r"), F.col("bbox.coord_origin").alias("origin"))


# Extracted pages: four lines of a document are a page, which has as many images as its number leaves by 3


def extract(content: bytes) -> list[dict]:
    lines = content.decode("utf-8").split("\n")
    pages = [lines[a : a + 4] for a in range(0, len(lines), 4)]
    return [{"page_no": n, "blocks": [*p, str(n)], "images": [(n, k) for k in range(n % 3)]} for n, p in reversed(list(enumerate(pages, 1)))]


def _extracted(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return documents.extract_pages(d.select(F.concat(F.lit("/in/"), F.col("doc_id").cast("string")).alias("path"), F.encode("text", "UTF-8").alias("content")), extract)


_NOTE = "list_transform(range(0, n % 3), lambda k: '[PDF image note: page ' || n || ', image ' || (k + 1) || ', ' || n || 'x' || k || ' samples. Embedded image detected during PDF processing.]')"
_EXTRACTED = f"""sheets AS (SELECT doc_id, n, ls[(n - 1) * 4 + 1:(n - 1) * 4 + 4] || [n::VARCHAR] || [array_to_string({_NOTE}, chr(10))] AS bs FROM (SELECT *, unnest(range(1, (len(ls) + 3) // 4 + 1)) AS n FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents))),
  read AS (SELECT * FROM (SELECT doc_id, n, k, {s_norm("bs[k]")} AS t FROM (SELECT *, unnest(range(1, len(bs) + 1)) AS k FROM sheets)) WHERE t <> '' AND NOT regexp_matches(t, '^\\d+$'))"""


@query(f"WITH {_EXTRACTED} SELECT '/in/' || doc_id AS path, n::INT AS page_no, (k - 1)::INT AS block_no, t AS text FROM read")
def extracted_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of extracted pages, tidied, without bare numbers, with notes of the images."""
    return documents.read_blocks(_extracted(spark, sf_dir))


@query(f"WITH {_EXTRACTED} SELECT '/in/' || doc_id AS path, string_agg(t, chr(10) || chr(10) ORDER BY n, k) AS text FROM read GROUP BY doc_id")
def extracted_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole text of extracted documents."""
    return documents.read_text(documents.read_blocks(_extracted(spark, sf_dir)))


@query(
    f"""WITH RECURSIVE {_EXTRACTED}, blocks AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY n, k) AS i, t FROM read),
  placed AS (SELECT *, sum(head::INT) OVER (PARTITION BY doc_id ORDER BY i) AS sec FROM (SELECT *, {s_heading("t", "h")} AS head FROM (SELECT *, {s_strip("t")} AS h FROM blocks))),
  headings AS (SELECT doc_id, sec, max(h) FILTER (head) AS heading FROM placed GROUP BY ALL),
  bodies AS (SELECT doc_id, sec, row_number() OVER (PARTITION BY doc_id, sec ORDER BY i) AS i, t FROM placed WHERE NOT head),
  {s_packed("bodies", "doc_id, sec", 1800, 250)},
  chunks AS (SELECT doc_id, sec, k, heading, CASE WHEN heading IS NULL THEN txt ELSE 'Section: ' || heading || chr(10) || txt END AS txt FROM packed JOIN headings USING (doc_id, sec)),
  bounded AS (SELECT doc_id, sec, k, 0 AS w, heading, txt FROM chunks WHERE length(txt) <= 1800
    UNION ALL SELECT doc_id, sec, k, w.idx, heading, w.txt FROM (SELECT *, {s_norm("txt")} AS whole FROM chunks WHERE length(txt) > 1800) c, LATERAL {s_windows("c.whole")} w WHERE length(w.txt) >= 20)
  SELECT '/in/' || doc_id AS source_id, doc_id::VARCHAR AS name, (row_number() OVER (PARTITION BY doc_id ORDER BY sec, k, w) - 1)::INT AS "index", txt AS text, coalesce(heading, '') AS path FROM bounded"""
)
def extracted_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of extracted documents."""
    return documents.read_passages(_extracted(spark, sf_dir)).select("source_id", F.col("source_display_name").alias("name"), "index", "text", F.array_join("section_path", " > ").alias("path"))


@query(
    f"""SELECT s.*, length(text)::INT AS n, 'PDF: one' AS shown FROM (SELECT doc_id::VARCHAR AS source_id, 'PDF: ' || doc_id AS name, '/' || doc_id AS location, w.idx::INT AS "index", w.txt AS text FROM (SELECT doc_id, {s_norm("text")} AS t FROM documents) d, LATERAL {s_windows("d.t", 900, 100)} w WHERE length(w.txt) >= 20) s"""
)
def pdf_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as PDF sources in shorter windows, beside the columns of one named source."""
    from lumenpass.operators import chunking
    from lumenpass.options import ChunkOptions

    key = F.col("doc_id").cast("string")
    made = documents.as_pdf(documents.table_sources(table(spark, sf_dir, "documents"), "doc_id", "text", location=F.concat(F.lit("/"), key)))
    one = documents.as_pdf(spark.range(1).select(*documents.source_columns(PassageSource("1", "one", "/one")))).first().display_name
    out = chunking.split_passages(made, ChunkOptions(900, 100, 20))
    return out.select("source_id", F.col("source_display_name").alias("name"), F.col("source_location").alias("location"), "index", "text", F.length("text").alias("n"), F.lit(one).alias("shown"))


# PDF files: twelve lines of a document on a page, with a wider gap after each third


def pdf_file(text: str) -> bytes:
    """A PDF of a text: one font, compressed pages, as many images on a page as its number leaves by 3."""
    import zlib

    lines = (text or "").split("\n")
    sheets = [lines[a : a + 12] for a in range(0, len(lines), 12)]
    objects = {1: b"<</Type/Catalog/Pages 2 0 R>>", 3: b"<</Type/Font/Subtype/Type1/BaseFont/Helvetica/Encoding/WinAnsiEncoding>>"}
    for n, sheet in enumerate(sheets, 1):
        page, drawn = 10 * n, b""
        for i, line in enumerate(sheet):
            raw = line.encode("cp1252", "replace")
            for c in (b"\\", b"(", b")"):
                raw = raw.replace(c, b"\\" + c)
            drawn += b"BT /F 10 Tf 1 0 0 1 50 %d Tm (%s) Tj ET\n" % (780 - 14 * i - 20 * (i // 3), raw.replace(b"\r", b"\\r"))
        for k in range(n % 3):
            objects[page + 2 + k] = b"<</Type/XObject/Subtype/Image/Width %d/Height %d/Length 0>>stream\n\nendstream" % (n, k)
            drawn += b"q /I%d Do Q\n" % k
        packed = zlib.compress(drawn, 1)
        images_ = b"".join(b"/I%d %d 0 R" % (k, page + 2 + k) for k in range(n % 3))
        objects[page] = b"<</Type/Page/Parent 2 0 R/Contents %d 0 R/Resources<</Font<</F 3 0 R>>/XObject<<%s>>>>>>" % (page + 1, images_)
        objects[page + 1] = b"<</Filter/FlateDecode/Length %d>>stream\n%s\nendstream" % (len(packed), packed)
    objects[2] = b"<</Type/Pages/MediaBox[0 0 600 800]/Count %d/Kids[%s]>>" % (len(sheets), b" ".join(b"%d 0 R" % (10 * n) for n in range(1, len(sheets) + 1)))
    return b"%PDF-1.7\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % x for x in sorted(objects.items())) + b"trailer<</Root 1 0 R>>\n%%EOF"


def _pdf_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = F.udf(pdf_file, "binary", useArrow=True)
    broken = F.when(F.col("doc_id") % 50 == 7, F.encode(F.lit("no such file"), "UTF-8")).otherwise(made("text"))
    return table(spark, sf_dir, "documents").select(F.concat(F.lit("/in/"), F.col("doc_id").cast("string"), F.lit(".pdf")).alias("path"), broken.alias("content"))


_FILES = f"""rows AS (SELECT doc_id, (i - 1) // 12 + 1 AS n, (i - 1) % 12 AS j, ls[i] AS line FROM (SELECT *, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE doc_id % 50 <> 7))),
  near AS (SELECT *, j - j % 3 <> coalesce(lag(j - j % 3) OVER w, -1) OR coalesce(lag(j) OVER w, -9) <> j - 1 AS begins FROM rows WHERE trim(line) <> '' WINDOW w AS (PARTITION BY doc_id, n ORDER BY j)),
  lumps AS (SELECT *, sum(begins::INT) OVER (PARTITION BY doc_id, n ORDER BY j) - 1 AS k FROM near),
  blocks AS (SELECT doc_id, n, k, {s_norm("string_agg(line, chr(10) ORDER BY j)")} AS t FROM lumps GROUP BY ALL)"""


@query(
    f"""WITH {_FILES} SELECT '/in/' || doc_id || '.pdf' AS path, n::INT AS page_no, t AS text FROM blocks WHERE NOT regexp_matches(t, '^\\d+$')
    UNION ALL SELECT '/in/' || doc_id || '.pdf', n::INT, array_to_string({_NOTE}, ' ') FROM (SELECT DISTINCT doc_id, n FROM rows) WHERE n % 3 > 0
    UNION ALL SELECT '/in/' || doc_id || '.pdf', -1, 'Unable to read PDF ''/in/' || doc_id || '.pdf'': not a PDF file' FROM documents WHERE doc_id % 50 = 7"""
)
def pdf_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks and image notes of PDF files by the package's own reader, and the errors of files that are none."""
    pages = documents.extract_pages(_pdf_files(spark, sf_dir))
    wrong = pages.where("error is not null").select("path", F.lit(-1).alias("page_no"), F.col("error").alias("text"))
    return documents.read_blocks(pages).select("path", "page_no", "text").unionByName(wrong)


@query(
    f"""WITH {_FILES} SELECT '/in/' || doc_id || '.pdf' AS path, n::INT AS page_no, w AS text, round(50 + 5.0 * (pos - 1), 3)::DOUBLE AS l, round(50 + 5.0 * (pos - 1 + length(w)), 3)::DOUBLE AS r, round(778.0 - 14 * j - 20 * (j // 3), 3)::DOUBLE AS low
    FROM (SELECT doc_id, n, j, ws[x] AS w, 1 + (x - 1) + coalesce(list_sum(list_transform(ws[1:x - 1], lambda y: length(y))), 0) AS pos FROM (SELECT doc_id, n, j, string_split(line, ' ') AS ws, unnest(range(1, len(string_split(line, ' ')) + 1)) AS x FROM rows)) WHERE w <> ''"""
)
def pdf_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of PDF files as cells with their boxes."""
    found = documents.page_cells(documents.extract_words(_pdf_files(spark, sf_dir)).where("error is null"))
    return found.select("path", "page_no", "text", F.round("bbox.l", 3).alias("l"), F.round("bbox.r", 3).alias("r"), F.round("bbox.t", 3).alias("low"))


# Markdown passages


_SECTIONS = MARKDOWN_SECTIONS.removesuffix(MARKDOWN_SECTIONS[MARKDOWN_SECTIONS.rindex("SELECT doc_id, (row_number()") :])
_MD = f"""{_SECTIONS}, chunks AS (SELECT doc_id, first, heading, CASE WHEN heading IS NULL THEN body ELSE 'Section: ' || heading || chr(10) || body END AS txt FROM kept),
  bounded AS (SELECT doc_id, first, 0 AS w, heading, txt FROM chunks WHERE length(txt) <= 1800
    UNION ALL SELECT doc_id, first, w.idx, heading, w.txt FROM (SELECT *, {s_norm("txt")} AS whole FROM chunks WHERE length(txt) > 1800) c, LATERAL {s_windows("c.whole")} w WHERE length(w.txt) >= 20),
  pathed AS (SELECT *, list_filter(list_transform(string_split(coalesce(heading, ''), ' > '), lambda x: trim(x)), lambda x: x <> '') AS path FROM bounded)"""


def _markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lumenpass.plans.queries import dressed

    key = F.col("doc_id").cast("string")
    return table(spark, sf_dir, "documents").select(key.alias("id"), key.alias("display_name"), key.alias("location"), dressed().alias("text"))


@query(f"""{_MD} SELECT doc_id::VARCHAR AS source_id, (row_number() OVER (PARTITION BY doc_id ORDER BY first, w) - 1)::INT AS "index", txt AS text, array_to_string(path, ' > ') AS path, {S_ROLE} AS role FROM (SELECT *, lower({s_norm("txt")}) AS t, list_transform(path, lambda p: {s_name("p")}) AS names FROM pathed)""")
def markdown_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of Markdown texts with their section paths and roles."""
    out = markdown.passages(_markdown(spark, sf_dir))
    return out.select("source_id", "index", "text", F.array_join("section_path", " > ").alias("path"), F.col("content_role").alias("role"))


@query(f"{_SECTIONS} SELECT doc_id::VARCHAR AS id, string_agg(CASE WHEN heading IS NULL THEN body ELSE heading || chr(10) || chr(10) || body END, chr(10) || chr(10) ORDER BY first) AS text FROM kept GROUP BY doc_id")
def markdown_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings and blocks of Markdown texts as one text."""
    return _markdown(spark, sf_dir).select("id", markdown.full_text("text").alias("text")).where("text <> ''")


# Document JSON: fields of the right kind, of the wrong kind, and missing, by the document's id


def _json_text() -> Column:
    """A JSON text for each document, put together as text."""
    k = F.col("doc_id")
    pick = lambda n, *values: F.element_at(F.array(*map(F.lit, values)), (k % n + 1).cast("int"))
    text = F.expr("substring(q, 6, length(q) - 6)")
    return F.concat(
        F.lit('{"schema_name": '), pick(7, '"DoclingDocument"', '"DoclingDocument"', '"DoclingDocument"', '"DoclingDocument"', '"DoclingDocument"', '"Other"', "3"), F.lit(', "name": '), pick(3, '"n"', "5", "null"),
        F.lit(', "origin": '), pick(2, '{"filename": "f.pdf", "mimetype": 3}', "[]"), F.lit(', "pages": {"'), (k % 5).cast("string"), F.lit('": {"size": {"width": '), (k % 9).cast("string"), F.lit('.5}}, "x": {}}, "texts": [{"text": '), text,
        F.lit(', "label": '), pick(4, '"title"', '"own_label"', "7", '"text"'), F.lit(', "parent": '), pick(3, '{"$ref": "#/groups/1"}', '"#/p"', '{"ref": 1}'), F.lit(', "content_layer": '), pick(3, '"FURNITURE"', '"elsewhere"', '"notes"'),
        F.lit(', "prov": [{"page_no": '), pick(2, "4", "4.5"), F.lit(', "bbox": {"l": 1, "t": "2", "coord_origin": '), pick(2, '"bottomleft"', '"x"'), F.lit('}, "charspan": '), pick(3, "[1, 2]", "[1]", '["a", 2]'),
        F.lit('}], "meta": {"any": {"keywords": [" K  k ", 3, "k K"], "source_id": "s"}}}, {"orig": "o"}], "tables": [{"self_ref": "#/t", "data": {"num_rows": '), pick(2, "2", '"2"'), F.lit(', "table_cells": [{"text": "c", "row_header": '), pick(2, "true", '"true"'),
        F.lit(', "end_col_offset_idx": 5}, 4]}}], "pictures": [{"annotations": [{"kind": "CLASSIFICATION", "predicted_classes": [{"class_name": "a", "confidence": 0.25}, {"class_name": "b", "confidence": '), pick(2, "0.75", '"x"'), F.lit('}, {"class_name": " "}]}]}], "body": {"children": [{"$ref": "#/t"}, "#/u", {"x": 1}, ""]}}'),
    )


_JSON_SQL = """SELECT doc_id, doc_id % 7 AS s, doc_id % 2 AS d, doc_id % 3 AS e, doc_id % 4 AS f, coalesce(text, '') AS text FROM documents"""


@query(
    f"""SELECT doc_id, CASE s WHEN 5 THEN 'Expected schema_name ''DoclingDocument'', got ''Other''.' WHEN 6 THEN 'The JSON is no document: schema_name is missing.' END AS error,
      CASE WHEN s < 5 THEN CASE e WHEN 0 THEN 'n' ELSE 'document' END END AS name, CASE WHEN s < 5 AND d = 0 THEN 'f.pdf' END AS file, CASE WHEN s < 5 THEN (doc_id % 5) || ':' || (doc_id % 5) || ':' || (doc_id % 9) || '.5:0.0' END AS page,
      CASE WHEN s < 5 THEN text || '|' || text || '|#/texts/0|' || CASE f WHEN 0 THEN 'title' WHEN 1 THEN 'own_label' ELSE 'text' END || '|' || CASE e WHEN 0 THEN '#/groups/1' WHEN 1 THEN '#/p' ELSE '#/body' END || '|' || CASE e WHEN 0 THEN 'furniture' WHEN 1 THEN 'body' ELSE 'notes' END END AS texts,
      CASE WHEN s < 5 THEN '|o|#/texts/1|text|#/body|body' END AS second, CASE WHEN s < 5 THEN 'K k|s' END AS meta,
      CASE WHEN s < 5 THEN CASE d WHEN 0 THEN '4|1.0|0.0|BOTTOMLEFT' ELSE '1|1.0|0.0|TOPLEFT' END || CASE e WHEN 0 THEN '|1-2' ELSE '' END END AS prov,
      CASE WHEN s < 5 THEN '#/t|2|0|2|c|' || CASE d WHEN 0 THEN 'true' ELSE 'false' END || '|5|1|' END AS tables,
      CASE WHEN s < 5 THEN 'a:0.25,b:' || CASE d WHEN 0 THEN '0.75' ELSE '0.0' END || '|' || CASE d WHEN 0 THEN 'picture,b,a' ELSE 'picture,a,b' END END AS pictures, CASE WHEN s < 5 THEN '#/t,#/u' END AS children, CASE WHEN s < 5 THEN 'same' END AS again
    FROM ({_JSON_SQL})"""
)
def document_json_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every kind of field of document JSON, lenient where it must be, and the same again after writing and parsing."""
    quoted = F.to_json(F.struct(F.coalesce("text", F.lit("")).alias("x")))
    raw = table(spark, sf_dir, "documents").withColumn("q", quoted).select("doc_id", docjson.parsed(_json_text()).alias("p"))
    d = raw.select("doc_id", "p.error", F.col("p.document").alias("d"), docjson.parsed(docjson.written("p.document")).alias("twice"))
    t, u, b, i = F.col("d.texts")[0], F.col("d.texts")[1], F.col("d.tables")[0], F.col("d.pictures")[0]
    say = lambda *c: F.concat(*[x if k == 0 else F.concat(F.lit("|"), x) for k, x in enumerate([F.coalesce(y.cast("string"), F.lit("")) for y in c])])
    there = lambda c: F.when(F.col("d").isNotNull(), c)
    item = lambda x: say(x["text"], x["orig"], x["self_ref"], x["label"], x["parent"], x["content_layer"])
    page, prov, cells = F.map_entries("d.pages")[0], t["prov"][0], b["data"]["table_cells"]
    span = F.when(prov["char_span"].isNotNull(), F.concat(F.lit("|"), prov["char_span"]["start"].cast("string"), F.lit("-"), prov["char_span"]["end"].cast("string"))).otherwise("")
    classes = F.array_join(F.transform(i["classifications"], lambda c: F.concat(c["class_name"], F.lit(":"), c["confidence"].cast("string"))), ",")
    # what writing doesn't keep by design (the type of an origin, a text's white space) isn't in these documents
    same = F.col("twice.document").isNotNull() & (F.to_json("d.texts") == F.to_json("twice.document.texts")) & (F.to_json("d.tables") == F.to_json("twice.document.tables")) & (F.to_json("d.pictures") == F.to_json("twice.document.pictures")) & (F.to_json("d.body_children") == F.to_json("twice.document.body_children")) & (F.to_json("d.pages") == F.to_json("twice.document.pages")) & (F.col("d.name") == F.col("twice.document.name"))
    return d.select(
        "doc_id", "error", F.col("d.name").alias("name"), F.col("d.origin_file_name").alias("file"),
        there(F.concat_ws(":", page["key"], page["value"]["page_no"], page["value"]["size"]["width"], page["value"]["size"]["height"])).alias("page"), there(item(t)).alias("texts"), there(item(u)).alias("second"), there(say(F.array_join(t["keywords"], ","), t["source_id"])).alias("meta"),
        there(F.concat(say(prov["page_no"], prov["bbox"]["l"], prov["bbox"]["t"], prov["bbox"]["coord_origin"]), span)).alias("prov"), there(say(b["self_ref"], b["data"]["num_rows"], b["data"]["num_cols"], F.size(cells), cells[0]["text"], cells[0]["row_header"], cells[0]["end_col_offset_idx"], cells[1]["end_row_offset_idx"], cells[1]["text"])).alias("tables"),
        there(say(classes, F.array_join(i["keywords"], ","))).alias("pictures"), there(F.array_join("d.body_children", ",")).alias("children"), there(F.when(same, "same").otherwise("changed")).alias("again"),
    )


# Images: every pixel told by its place and the part's key


def picture(key: int) -> tuple[int, int, bytes]:
    w, h = key % 5 + 3, key % 4 + 3
    return w, h, bytes((x * 37 + y * 59 + c * 101 + key) % 256 for y in range(h) for x in range(w) for c in range(3))


def _pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = F.udf(picture, "struct<width:int,height:int,pixels:binary>", useArrow=True)
    # the table is a small file, but each row is much work
    return documents.spread(table(spark, sf_dir, "part").select("p_partkey"), "p_partkey").select("p_partkey", made("p_partkey").alias("i")).select("p_partkey", "i.*")


_PIXEL = "(({x}) * 37 + ({y}) * 59 + c * 101 + k) % 256"
_TO = (4, 5)
_LOW = lambda m, n, at: f"least({m} - 1, greatest(0, floor(({at} + 0.5) * ({m}::DOUBLE / {n}) - 0.5)))::BIGINT"
_WEIGHT = lambda m, n, at: f"(({at} + 0.5) * ({m}::DOUBLE / {n}) - 0.5 - floor(({at} + 0.5) * ({m}::DOUBLE / {n}) - 0.5))"


@query(
    f"""WITH p AS (SELECT p_partkey AS k, p_partkey % 5 + 3 AS w, p_partkey % 4 + 3 AS h FROM part),
    t AS (SELECT k, w, h, x, y, c, {_LOW("w", _TO[0], "x")} AS x0, {_LOW("h", _TO[1], "y")} AS y0, {_WEIGHT("w", _TO[0], "x")} AS a, {_WEIGHT("h", _TO[1], "y")} AS b FROM p, (SELECT unnest(range(0, {_TO[0]})) AS x), (SELECT unnest(range(0, {_TO[1]})) AS y), (SELECT unnest(range(0, 3)) AS c)),
    e AS (SELECT *, least(w - 1, x0 + 1) AS x1, least(h - 1, y0 + 1) AS y1 FROM t),
    r AS (SELECT k, x, y, c, CASE WHEN w = {_TO[0]} AND h = {_TO[1]} THEN {_PIXEL.format(x="x", y="y")} ELSE round_even(({_PIXEL.format(x="x0", y="y0")} * (1 - a) + {_PIXEL.format(x="x1", y="y0")} * a) * (1 - b) + ({_PIXEL.format(x="x0", y="y1")} * (1 - a) + {_PIXEL.format(x="x1", y="y1")} * a) * b, 0) END::BIGINT AS v FROM e),
    q AS (SELECT k, string_agg(v::VARCHAR, ',' ORDER BY y, x, c) AS resized, round(sum((v / 255.0 - 0.5) / 0.25) FILTER (c = 1), 3) + 0.0 AS green FROM r GROUP BY k),
    u AS (SELECT k, string_agg(({_PIXEL.format(x="x", y="y")})::VARCHAR, ',' ORDER BY y, x, c) AS cropped FROM p, (SELECT unnest(range(1, 3)) AS x), (SELECT unnest(range(1, 3)) AS y), (SELECT unnest(range(0, 3)) AS c) GROUP BY k)
    SELECT k AS p_partkey, k % 6 <> 0 AS valid, w::INT AS width, cropped, resized, green FROM p JOIN q USING (k) JOIN u USING (k)"""
)
def image_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crops, bilinear resizing, model tensors and the check of sizes, pixel by pixel."""
    d = _pictures(spark, sf_dir).withColumn("c", images.crop_column(G.box(F.lit(1.2), F.lit(1), F.lit(2.5), F.lit(3)), "width", "height", "pixels")).withColumn("r", images.resize_column(*_TO, "width", "height", "pixels"))
    config = images.Preprocessor(*_TO, mean=(0.5, 0.5, 0.5), std=(0.25, 0.25, 0.25))
    green = F.udf(lambda w, h, p: float(images.to_nchw(config, w, h, p)[1].astype("float64").sum()), "double", useArrow=True)("width", "height", "pixels")
    numbers = F.udf(lambda p: ",".join(map(str, p)), "string", useArrow=True)
    given = F.when(F.col("p_partkey") % 6 == 0, F.substring("pixels", 2, 1 << 20)).otherwise(F.col("pixels"))
    return d.select("p_partkey", images.valid_column("width", "height", given).alias("valid"), "width", numbers("c.pixels").alias("cropped"), numbers("r.pixels").alias("resized"), (F.round(green, 3) + 0.0).alias("green"))


def detector(x) -> dict:
    """Logits and boxes as a stub: query 0 is a table over the left half if the mean is high, query 1 a caption."""
    import numpy as np

    high = float(x.mean()) >= 0.50013
    logits = np.full((1, 3, 17), -9.0)
    logits[0, 0, 8 if high else 6] = 2.0
    logits[0, 1, 0] = 3.0
    logits[0, 2, 3] = -1.0  # below the threshold
    return {"scores_logits": logits, "pred_boxes": np.array([[[0.25, 0.5, 0.5, 1.0], [1.0, 2.0, 3.0, 4.0], [0.5, 0.5, 0.1, 0.1]]])}


def figures(x) -> dict:
    import numpy as np

    return {"logits": np.array([[0.0, np.log(4.0) if float(x.mean()) >= 0.50013 else np.log(0.25)]])}


_MEAN = "SELECT k, w, h, avg((x * 37 + y * 59 + c * 101 + k) % 256 / 255.0) AS mean FROM (SELECT p_partkey AS k, p_partkey % 5 + 3 AS w, p_partkey % 4 + 3 AS h FROM part), LATERAL (SELECT unnest(range(0, w)) AS x), LATERAL (SELECT unnest(range(0, h)) AS y), (SELECT unnest(range(0, 3)) AS c) GROUP BY ALL"


@query(
    f"""SELECT k AS p_partkey, CASE WHEN mean >= 0.50013 THEN 'table' ELSE 'picture' END || '|caption' AS labels, '0|1' AS ids, round(w * 0.5, 4)::DOUBLE AS right_edge, round(least(h, 4 * h / 6.0), 4)::DOUBLE AS bottom_edge, round(1 / (1 + exp(-2.0)), 6) AS sure,
      CASE WHEN mean >= 0.50013 THEN 'bar:0.8|label_0:0.2' ELSE 'label_0:0.8|bar:0.2' END AS classes FROM ({_MEAN})"""
)
def model_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A layout model and a figure classifier (stubs) around images: tensors, outputs by name, boxes, softmax, labels."""
    plain = images.Preprocessor(6, 6, normalize=False)
    d = _pictures(spark, sf_dir)

    def layout(page_no: int, w: int, h: int, px: bytes) -> list[dict]:
        mean = images.to_nchw(images.Preprocessor(w, h, normalize=False), w, h, bytes(px))
        return assembly.LayoutModel(lambda _: detector(mean), plain)(page_no, w, h, px)

    def figure(w: int, h: int, px: bytes) -> list[tuple[str, float]]:
        return assembly.FigureModel(figures, images.Preprocessor(w, h, normalize=False), {1: "bar"})(w, h, px)

    pages = d.select(F.col("p_partkey").cast("string").alias("doc"), F.lit(None).cast("string").alias("origin"), F.lit(1).alias("page_no"), "width", "height", "pixels")
    found = assembly.predict_layout(pages, layout).select("doc", "clusters")
    named = assembly.classify_figures(d, figure).select(F.col("p_partkey").cast("string").alias("doc"), "classes")
    c = F.col("clusters")
    shown = F.array_join(F.transform("classes", lambda x: F.concat(x["class_name"], F.lit(":"), F.round(x["confidence"], 4).cast("string"))), "|")
    return found.join(named, "doc").select(
        F.col("doc").cast("long").alias("p_partkey"), F.array_join(F.transform(c, lambda x: x["label"]), "|").alias("labels"), F.array_join(F.transform(c, lambda x: x["id"].cast("string")), "|").alias("ids"),
        F.round(c[0]["bbox"]["r"], 4).alias("right_edge"), F.round(c[1]["bbox"]["b"], 4).alias("bottom_edge"), F.round(c[0]["confidence"], 6).alias("sure"), shown.alias("classes"),
    )


@query("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'text' WHEN 1 THEN 'table' WHEN 2 THEN 'picture' ELSE 'none' END AS kind, CASE WHEN doc_id % 8 = 4 THEN 'furniture' ELSE 'body' END AS layer, CASE WHEN doc_id % 8 = 4 THEN 2 ELSE 1 END AS reading FROM documents")
def label_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which labels stand for text, tables and pictures, their layer and reading group."""
    label = F.element_at(F.array(*map(F.lit, ["title", "table", "picture", "form", "page_footer", "document_index", "chart", "key_value_region"])), (F.col("doc_id") % 8 + 1).cast("int"))
    kind = F.when(T.is_text_like(label), "text").when(T.is_table_like(label), "table").when(T.is_picture_like(label), "picture").otherwise("none")
    return table(spark, sf_dir, "documents").select("doc_id", kind.alias("kind"), T.content_layer(label).alias("layer"), T.reading_group(label).alias("reading"))
