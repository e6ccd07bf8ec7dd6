import json

import numpy as np
import pytest
from lumenpass import schemas as S
from lumenpass.functions import geometry as G
from lumenpass.functions import images
from lumenpass.operators import assembly, cells
from lumenpass.options import ChunkOptions, ConversionOptions, PdfOptions
from lumenpass.sources import bundle, catalog, docjson, documents
from pyspark.sql import functions as F


def box(left, t, r, b, origin="TOPLEFT"):
    return {"l": float(left), "t": float(t), "r": float(r), "b": float(b), "coord_origin": origin}


def cell(text, *sides, origin="TOPLEFT"):
    return {"text": text, "bbox": box(*sides, origin), "confidence": 1.0}


def cluster(label, *sides, origin="TOPLEFT"):
    return {"id": 9, "label": label, "confidence": 0.9, "bbox": box(*sides, origin), "cells": []}


def test_geometry(spark):
    row = spark.range(1).select(G.box(F.lit(10), F.lit(10), F.lit(60), F.lit(30), "BOTTOMLEFT").alias("a"), G.box(F.lit(10), F.lit(10), F.lit(30), F.lit(30)).alias("b"), G.box(F.lit(20), F.lit(10), F.lit(40), F.lit(30)).alias("c"))
    x = row.select(G.to_top_left("a", F.lit(100)).alias("up"), G.to_bottom_left(G.to_top_left("a", F.lit(100)), F.lit(100)).alias("down"), G.intersection_over_self("b", "c").alias("share"), G.intersection("b", "c").alias("i"), G.intersection("a", G.box(F.lit(90), F.lit(0), F.lit(95), F.lit(1))).alias("none"), G.area("a").alias("area"), G.horizontally_overlaps("b", "c").alias("beside")).first()
    assert (x.up.t, x.up.b, x.share, x.none, x.area, x.beside) == (70, 90, 0.5, None, 1000, True) and (x.down.t, x.down.b) == (10, 30) and (x.i.l, x.i.r) == (20, 30)
    assert spark.range(1).select(G.softmax(F.array(F.lit(1.0), F.lit(1.0)))).first()[0] == [0.5, 0.5]
    d = spark.range(1).select(G.decode_detection(F.array(*map(F.lit, [0.5, 0.5, 0.2, 0.4])), F.lit(100), F.lit(50), F.lit(10), F.lit(10)).alias("a"), G.decode_detection(F.array(*map(F.lit, [1.0, 2.0, 3.0, 4.0])), F.lit(100), F.lit(50), F.lit(10), F.lit(10)).alias("b")).first()
    assert tuple(d.a)[:4] == pytest.approx((40, 15, 60, 35)) and tuple(d.b)[:4] == pytest.approx((10, 10, 30, 20))


def cell_table(spark, rows):
    return spark.createDataFrame([(1, k, r[0], r[1], None) for k, r in enumerate(rows)], f"page_no int, cell_no int, text string, bbox {S.BBOX}, confidence double")


def test_native_and_recognized_cells(spark):
    native = cell_table(spark, [("Native text", box(10, 60, 50, 80))])
    native = cells.scale_cells(native, (200, 400), (400, 800))
    assert tuple(native.first().bbox)[:4] == (20, 120, 100, 160)
    ocr = cell_table(spark, [("Nativ text", box(20, 120, 100, 160)), ("Other line", box(20, 300, 100, 340)), ("  ", box(20, 500, 30, 510))])
    heights = spark.createDataFrame([(1, 800)], "page_no int, height int")
    assert [x.text for x in cells.merge_prefer_primary(native, ocr, heights, 0.7).collect()] == ["Native text", "Other line"]
    assert [x.text for x in cells.merge_prefer_primary(native, ocr, heights, 0.0).collect()] == ["Native text"]
    assert cells.has_enough_text(ocr, 20).first().enough is True and cells.has_enough_text(ocr, 21).first().enough is False


def test_join_equals_fold(spark):
    clusters = [cluster("text", 0, 0, 50, 50), cluster("text", 40, 0, 90, 50, origin="BOTTOMLEFT"), cluster("table", 0, 60, 90, 90)]
    own = [cell(str(k), *s) for k, s in enumerate([(1, 1, 20, 10), (35, 5, 55, 15), (60, 60, 80, 80), (45, 55, 60, 95), (200, 200, 210, 210)])]
    want = [[c["text"] for c in x["cells"]] for x in assembly.attach({"page_no": 1, "height": 100, "cells": own}, clusters, 0.3)]
    c = spark.createDataFrame([(1, k, x["label"], x["confidence"], x["bbox"]) for k, x in enumerate(clusters)], f"page_no int, id int, label string, confidence double, bbox {S.BBOX}")
    got = cells.attach_cells(c, cell_table(spark, [(x["text"], x["bbox"]) for x in own]), spark.createDataFrame([(1, 100)], "page_no int, height int")).orderBy("id").collect()
    assert [[y.text for y in x.cells] for x in got] == want and any(len(w) > 1 for w in want)


def page(no, own, width=100, height=100):
    return {"page_no": no, "width": width, "height": height, "cells": own, "pixels": bytes(width * height * 3)}


def full_page():
    own = [cell("Header", 10, 2, 40, 6), cell("Hello", 10, 20, 30, 26), cell("world", 32, 20, 50, 26), cell("A", 10, 40, 20, 46), cell("B", 30, 40, 40, 46)]
    clusters = [cluster("picture", 10, 60, 50, 90), cluster("table", 8, 38, 60, 50), cluster("text", 8, 18, 60, 30), cluster("page_header", 5, 0, 60, 8), cluster("text", 80, 80, 90, 90)]
    return page(1, own), {"page_no": 1, "clusters": clusters}


def test_assembly():
    p, guess = full_page()
    d, error = assembly.assemble("doc", None, [p], [guess], classify=lambda w, h, px: [("other", 0.1), ("bar_chart", 0.91)])
    assert error is None and d["body_children"] == ["#/texts/1", "#/tables/0", "#/pictures/0"] and d["furniture_children"] == ["#/texts/0"]
    assert d["texts"][1]["text"] == "Hello world" and d["tables"][0]["data"]["num_rows"] == 2 and d["tables"][0]["keywords"] == ["table"]
    assert d["pictures"][0]["keywords"] == ["picture", "bar_chart", "other"]
    back, error = docjson.parse(docjson.dumps(d))
    assert error is None and back == d | {"origin_mime_type": None}  # there is no origin without a file name
    assert assembly.assemble("d", None, [], [])[1] == "At least one page is required."
    assert assembly.assemble("d", None, [p, page(2, [])], [guess])[1] == "Missing layout predictions for pages: 2."

    def fails(*_):
        raise RuntimeError("no model")

    assert assembly.assemble("d", None, [p], [guess], classify=fails) == (None, "no model")
    native = page(1, [cell("Native", 10, 80, 30, 90, origin="BOTTOMLEFT"), cell("text", 52, 80, 70, 90, origin="BOTTOMLEFT"), cell("PDF", 32, 80, 50, 90, origin="BOTTOMLEFT")])
    d, _ = assembly.assemble("d", "f.pdf", [native], [{"page_no": 1, "clusters": [cluster("text", 5, 5, 90, 25)]}])
    assert [t["text"] for t in d["texts"]] == ["Native PDF text"] and d["texts"][0]["source_display_name"] == "f.pdf"
    empty, _ = assembly.assemble("d", None, [page(1, [])], [{"page_no": 1, "clusters": [cluster("form", 0, 0, 9, 9)]}], ConversionOptions(include_empty_text=True))
    assert empty["texts"][0]["label"] == "text" and empty["texts"][0]["text"] == ""


def test_conversion_tables(spark):
    p, guess = full_page()
    pages = spark.createDataFrame([("doc", "o.pdf", 1, 100, 100, bytearray(p["pixels"]), p["cells"]), ("lone", None, 1, 100, 100, bytearray(p["pixels"]), [])], assembly.PAGE_INPUTS)
    guesses = spark.createDataFrame([("doc", 1, 0, []), ("doc", 1, 1, guess["clusters"])], assembly.PREDICTIONS)
    got = {x.doc: x for x in assembly.convert_pages(pages, guesses).collect()}
    assert got["doc"].document.body_children == ["#/texts/1", "#/tables/0", "#/pictures/0"] and got["lone"].error == "Missing layout predictions for pages: 1."
    clusters = guess["clusters"]
    made = assembly.convert(pages, lambda no, w, h, px: clusters, ocr=lambda no, w, h, px: [cell("Read", 10, 20, 30, 26)])
    assert {x.doc: x.document.texts[0].text for x in made.collect()} == {"doc": "Read", "lone": "Read"}
    column = made.select(docjson.written("document").alias("j")).select(docjson.parsed("j").alias("p"))
    assert all(x.p.error is None and len(x.p.document.tables) == 1 for x in column.collect())


def text_item(k, label, text, pages=(1,), **more):
    return {"self_ref": f"#/texts/{k}", "parent": "#/body", "label": label, "text": text, "orig": text, "content_layer": "body", "prov": [{"page_no": p, "bbox": box(0, 0, 1, 1), "char_span": None} for p in pages], "keywords": [], "source_id": None, "source_display_name": None, **more}


def document(texts, tables=(), pictures=(), order=None):
    refs = [t["self_ref"] for t in texts] + [t["self_ref"] for t in tables] + [p["self_ref"] for p in pictures]
    return {"name": "d", "origin_file_name": None, "origin_mime_type": None, "pages": {1: {"page_no": 1, "size": {"width": 1.0, "height": 1.0}}}, "texts": texts, "tables": list(tables), "pictures": list(pictures), "body_children": order or refs, "furniture_children": []}


def table_item(rows):
    made = [{"text": t, "bbox": None, "start_row_offset_idx": r, "end_row_offset_idx": r + 1, "start_col_offset_idx": c, "end_col_offset_idx": c + 1, "row_header": False, "column_header": False, "row_section": False} for r, row in enumerate(rows) for c, t in enumerate(row)]
    return {**text_item(0, "table", ""), "self_ref": "#/tables/0", "data": {"num_rows": len(rows), "num_cols": 1, "table_cells": made}}


def test_blocks():
    picture = {**text_item(0, "picture", ""), "self_ref": "#/pictures/0", "classifications": [{"class_name": "photograph", "confidence": 0.8}]}
    d = document([text_item(0, "text", "Intro text"), text_item(1, "caption", "Figure 1. Overview")], [table_item([["Alpha"], ["Beta"]])], [picture], ["#/texts/0", "#/texts/1", "#/tables/0", "#/nowhere", "#/pictures/0"])
    got = assembly.blocks_of(d)
    assert [b["text"] for b in got] == ["Intro text", "Figure 1. Overview", "Alpha Beta", "[Picture: photograph (0.800)]"]
    assert got[1]["captions"] == ["Figure 1. Overview"] and got[1]["keywords"][0] == "caption"
    assert assembly.table_text(table_item([])) == "[Table]" and assembly.picture_text({}) == "[Picture]"


def test_section_inheritance():
    texts = [text_item(0, "title", "Paper"), text_item(1, "section_header", "4 Experiment"), text_item(2, "section_header", "4.3 Empirical Results"), text_item(3, "text", "body"), text_item(4, "section_header", "Limitations"), text_item(5, "text", "end")]
    d = document(texts, [table_item([["x"]])], order=["#/texts/0", "#/texts/1", "#/texts/2", "#/texts/3", "#/tables/0", "#/texts/4", "#/texts/5"])
    paths = {b["text"]: b["section_path"] for b in assembly.blocks_of(d)}
    assert paths["body"] == paths["x"] == ["Paper", "4 Experiment", "4.3 Empirical Results"] and paths["end"] == ["Paper", "Limitations"]
    assert assembly.next_sections(["1 INTRODUCTION"], "4.3 Experimental Setup") == ["4.3 Experimental Setup"]
    assert assembly.heading_parts("99999999999 x") is None and assembly.heading_parts("x") is None


def test_roles_and_passages(spark):
    texts = [text_item(0, "title", "Paper", (1,)), text_item(1, "section_header", "Abstract", (1,)), text_item(2, "text", "We study.", (2, 1)), text_item(3, "section_header", "Method"), text_item(4, "text", "Details " * 20, (3,)), text_item(5, "section_header", "References"), text_item(6, "text", "[1] A."), text_item(7, "section_header", "NeurIPS Paper Checklist"), text_item(8, "text", "Question: fine"), text_item(9, "text", " ")]
    d = document(texts)
    got = assembly.chunk_document_blocks(assembly.blocks_of(d), ChunkOptions(60, 10, 1))
    roles = [b["content_role"] for b in got]
    assert roles[0] == "front_matter" and {"abstract", "main_body", "references", "submission_checklist"} <= set(roles)
    assert next(b for b in got if "We study" in b["text"])["page_numbers"] == [1, 2]
    assert all(len(b["text"]) <= 60 for b in got)
    df = spark.createDataFrame([("s", "S", "/s", d)], f"id string, display_name string, location string, document {S.DOCUMENT}")
    rows = assembly.passages(df, ChunkOptions(60, 10, 1)).orderBy("index").collect()
    assert [r.text for r in rows] == [b["text"] for b in got] and [r["index"] for r in rows] == list(range(len(got)))


def test_reading_order():
    a, b, c = (1, cluster("text", 60, 0, 90, 10)), (1, cluster("text", 0, 50, 30, 60)), (1, cluster("page_footer", 0, 0, 9, 9))
    assert cells.sort_clusters([c, a, b, (0, cluster("text", 99, 99, 100, 100))]) == [(0, cluster("text", 99, 99, 100, 100)), b, a, c]
    lines = cells.order_cells([cell("b", 20, 11, 30, 20), cell("a", 0, 10, 10, 20), cell("c", 0, 40, 10, 50)])
    assert [x["text"] for x in lines] == ["a", "b", "c"]


def test_json_leniency(spark):
    raw = {"schema_name": "DoclingDocument", "name": 3, "pages": {"1": {"size": {"width": 5}}, "x": {}}, "texts": [{"text": "t", "label": "weird_label", "prov": [{"charspan": [0, 1.5]}], "parent": "#/p", "meta": {"other": {"keywords": [" K ", 3, "k"], "source_id": "s"}}}, 7], "tables": [{"data": {"table_cells": [{"text": 4, "bbox": {"l": 1, "coord_origin": "bottomleft"}}]}}, {}], "pictures": [{"annotations": [{"kind": "Classification", "predicted_classes": [{"class_name": "x", "confidence": 0.5}, {"class_name": " "}]}]}], "body": {"children": [{"$ref": "#/a"}, "#/b", {"x": 1}, 3]}}
    d, error = docjson.parse(json.dumps(raw))
    assert error is None and d["name"] == "document" and d["pages"] == {1: {"page_no": 1, "size": {"width": 5.0, "height": 0.0}}}
    t = d["texts"][0]
    assert (t["self_ref"], t["parent"], t["orig"], t["keywords"], t["source_id"], t["prov"][0]["page_no"], t["prov"][0]["char_span"]) == ("#/texts/0", "#/p", "t", ["K"], "s", 1, None)
    assert d["texts"][1]["text"] == "" and d["body_children"] == ["#/a", "#/b"]
    assert d["tables"][0]["data"]["num_rows"] == 1 and d["tables"][0]["data"]["table_cells"][0]["bbox"]["coord_origin"] == "BOTTOMLEFT" and d["tables"][1]["data"]["num_rows"] == 0
    assert d["pictures"][0]["classifications"] == [{"class_name": "x", "confidence": 0.5}] and d["pictures"][0]["keywords"] == ["picture", "x"]
    assert "schema_name is missing" in docjson.parse("{}")[1] and "got 'x'" in docjson.parse('{"schema_name": "x"}')[1] and "Unable" in docjson.parse("{")[1]
    with pytest.raises(ValueError):
        docjson.loads("[]")
    bad = document([text_item(0, "text", " ")], order=["#/texts/9"])
    bad["pages"] = {}
    df = spark.createDataFrame([(bad,)], f"d {S.DOCUMENT}")
    assert df.select(docjson.validate("d")).first()[0] == ["At least one page is required.", "Missing referenced child: #/texts/9", "Text item #/texts/0 has empty text."]


def test_extracted_pages(spark):
    files = spark.createDataFrame([("/a.pdf", bytearray(b"ok")), ("/b.pdf", bytearray(b"broken"))], "path string, content binary")

    def extractor(data):
        if data == b"broken":
            raise ValueError("bad file")
        return [{"page_no": 2, "blocks": ["INTRODUCTION", "Second page."]}, {"page_no": 1, "blocks": ["12", " First \n page. ", ""], "images": [(3, 4)]}]

    pages = documents.extract_pages(files, extractor)
    assert [x.error for x in pages.where("path = '/b.pdf'").collect()] == ["Unable to read PDF '/b.pdf': bad file"]
    text = documents.read_text(documents.read_blocks(pages)).first().text
    assert text == "First page.\n\n[PDF image note: page 1, image 1, 3x4 samples. Embedded image detected during PDF processing.]\n\nINTRODUCTION\n\nSecond page."
    assert documents.read_text(documents.read_blocks(pages, PdfOptions(False, False))).first().text == "12\n\nFirst page.\n\nINTRODUCTION\n\nSecond page."
    assert [x.section_path for x in documents.read_passages(pages, chunk=ChunkOptions(1800, 250, 1)).orderBy("index").collect()] == [[], ["INTRODUCTION"]]
    words = spark.createDataFrame([("/a.pdf", 1, 10.0, 10.0, [("w ", 1.0, 2.0, 3.0, 4.0), (" ", 0.0, 0.0, 1.0, 1.0)])], documents.WORDS)
    assert [(x.text, x.bbox.coord_origin, x.confidence) for x in documents.page_cells(words).collect()] == [("w", "BOTTOMLEFT", None)]


def test_images():
    w, h, px = images.solid(4, 2, 1, 2, 3)
    assert images.validate(w, h, px).shape == (2, 4, 3)
    for broken in ((0, 1, b""), (1, 1, b"x")):
        with pytest.raises(ValueError):
            images.validate(*broken)
    g = np.arange(4 * 4 * 3, dtype=np.uint8).reshape(4, 4, 3)
    cw, ch, part = images.crop(box(1, 1, 3, 2), 4, 4, g.tobytes())
    assert (cw, ch) == (2, 1) and np.array_equal(np.frombuffer(part, np.uint8).reshape(1, 2, 3), g[1:2, 1:3])
    assert images.crop(box(9, 9, 9, 9), 4, 4, g.tobytes())[:2] == (1, 1)
    _, _, flipped = images.crop(box(0, 3, 1, 4, "BOTTOMLEFT"), 4, 4, g.tobytes())
    assert flipped == g[0:1, 0:1].tobytes()
    assert images.resize_bilinear(4, 4, 4, 4, g.tobytes())[2] == g.tobytes()
    two = np.array([[[0] * 3, [255] * 3]], np.uint8)
    assert np.frombuffer(images.resize_bilinear(4, 1, 2, 1, two.tobytes())[2], np.uint8)[::3].tolist() == slow_resize(4, [0, 255])
    x = images.to_nchw(images.Preprocessor(2, 2, std=(0.0,)), 4, 2, px)
    assert x.shape == (3, 2, 2) and x[0, 0, 0] == pytest.approx(1 / 255 - 0.485) and x[1, 0, 0] == pytest.approx(2 / 255 - 0.456)


def slow_resize(n, row):
    out = []
    for k in range(n):
        at = (k + 0.5) * len(row) / n - 0.5
        low = min(len(row) - 1, max(0, int(np.floor(at))))
        high = min(len(row) - 1, low + 1)
        w = at - np.floor(at)
        out.append(int(np.rint(row[low] * (1 - w) + row[high] * w)))
    return out


def test_detector_outputs():
    logits, boxes = np.full((1, 2, 3), -9.0), np.array([[[0.5, 0.5, 0.2, 0.2], [10.0, 10.0, 500.0, 20.0]]])
    logits[0, 0, 2] = logits[0, 1, 0] = 4.0
    got = images.detections({"a": boxes, "b": logits}, 100, 50, images.Preprocessor(100, 50), labels={0: "caption"})
    assert [(d["id"], d["label"]) for d in got] == [(0, "label_2"), (1, "caption")] and got[1]["bbox"]["r"] == 100.0 and got[0]["bbox"]["l"] == pytest.approx(40)
    with pytest.raises(ValueError):
        images.detections({"a": boxes}, 1, 1, images.Preprocessor())
    assert images.classes(np.array([1.0, 3.0, 2.0]), {1: "chart"}, 2)[0][0] == "chart" and images.classes(np.array([1.0, 3.0, 2.0]), {}, 0)[0][0] == "label_1"


def test_bundle(spark, tmp_path):
    from test_search import Fixed
    from lumenpass.plans import index_build
    from lumenpass.sources import index_store

    sources = spark.createDataFrame([("a", "A", "/a", "words about a topic of some length", True)], S.SOURCES)
    index_store.save(index_build.from_sources(sources, Fixed(), embedding_dim=2), str(tmp_path / "one"))
    m = bundle.Manifest("b", "1", "model", sources=(bundle.BundleSource("a", "A", None, None, "one"),))
    path = str(tmp_path / "m.json")
    bundle.write_manifest(spark, path, m)
    got, error = bundle.read_manifest(spark, path)
    assert error is None and got == m
    loaded, said = bundle.load_compatible(spark, bundle.Compatibility("model"), path)
    assert said == [] and bundle.all_passages(loaded).first().bundle_source_id == "a"
    loaded, said = bundle.load_compatible(spark, bundle.Compatibility("other"), path)
    assert loaded is None and "model_id" in said[0]
    assert len(bundle.validate(lambda p: False, str(tmp_path), bundle.Compatibility("m", ChunkOptions(1, 1, 1)), bundle.Manifest("", "", "", manifest_version=2, sources=(bundle.BundleSource("", "", None, None, ""), bundle.BundleSource("x", "X", None, None, "gone"))))) == 9
    old, _ = bundle.parse('{"schemaName": "SomeIndexBundle", "modelId": "m", "createdAt": "bad", "sources": [{"id": "q", "displayName": "Q", "indexFile": "f"}, 3]}')
    assert old.model_id == "m" and old.created_at == bundle.NEVER and [s.source_id for s in old.sources] == ["q", "source-1"]
    assert "missing" in bundle.parse("{}")[1] and "does not exist" in bundle.read_manifest(spark, str(tmp_path / "no"))[1] and "Unable" in bundle.parse("{")[1]


def test_catalog(tmp_path):
    m = catalog.ModelManifest("m", (("model.onnx", "u1"), ("config.json", "u2")))
    half, whole = tmp_path / "half", tmp_path / "whole"
    half.mkdir()
    whole.mkdir()
    (half / "model.onnx").write_text("x")
    for n in ("model.onnx", "config.json"):
        (whole / n).write_text("x")
    assert catalog.resolve_local(["", str(half)], m) is None
    assert catalog.resolve_local([str(half), str(whole)], m)["model.onnx"] == str(whole / "model.onnx")

    def never(url):
        raise AssertionError(url)

    assert catalog.ensure_available(never, str(tmp_path / "d"), [str(whole)], m)
    asked = []
    catalog.ensure_downloaded(lambda u: asked.append(u) or b"x", str(half), m)
    assert asked == ["u2"]


def test_spread(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(100).coalesce(1).write.parquet(path)
    df = spark.read.parquet(path)
    assert documents.spread(df, "id").rdd.getNumPartitions() == spark.sparkContext.defaultParallelism and documents.spread(df, "id").count() == 100
    spark.range(100).repartition(8).write.mode("overwrite").parquet(path)
    df = spark.read.parquet(path)
    assert documents.spread(df, "id") is df


def test_failures_are_rows(spark):
    p, guess = full_page()
    rows = [(d, None, 1, 100, 100, bytearray(p["pixels"]), p["cells"]) for d in ("good", "unread", "unseen")] + [("unread", None, 2, 100, 100, bytearray(p["pixels"]), [])]
    pages = spark.createDataFrame([(d, o, n, w, h, x[:-3] + d[:3].encode(), c) for d, o, n, w, h, x, c in rows], assembly.PAGE_INPUTS)
    clusters = guess["clusters"]

    def ocr(no, w, h, px):
        if bytes(px[-3:]) == b"unr" and no == 2:
            raise RuntimeError("can't read")
        return [cell("Read", 10, 20, 30, 26)]

    def layout(no, w, h, px):
        if bytes(px[-3:]) == b"uns":
            raise ValueError
        return clusters

    pages = pages.withColumn("pixels", F.when(F.col("doc") == "unseen", F.concat(F.substring("pixels", 1, 29997), F.lit(b"uns"))).otherwise(F.col("pixels")))
    got = {x.doc: (x.document is not None, x.error) for x in assembly.convert(pages, layout, ocr=ocr).collect()}
    assert got == {"good": (True, None), "unread": (False, "can't read"), "unseen": (False, "ValueError")}
    files = spark.createDataFrame([("/a/x.pdf", bytearray(b"ok")), ("/a/y.pdf", bytearray(b"bad"))], "path string, content binary")

    def render(data):
        if data == b"bad":
            raise ValueError("no page")
        return [{"page_no": 1, "width": 2, "height": 1, "pixels": b"123456"}]

    made = {x.doc: (x.origin, x.page_no, bytes(x.pixels), x.error) for x in assembly.rasterize(files, render).collect()}
    assert made == {"/a/x.pdf": ("x.pdf", 1, b"123456", None), "/a/y.pdf": ("y.pdf", 0, b"", "no page")}


def test_conversion_moves_pages_once(spark):
    pages = spark.createDataFrame([("a", "a", 2, 1, 1, bytes(3), []), ("a", "a", 1, 1, 1, bytes(3), []), ("b", "b", 1, 1, 1, bytes(3), [])], assembly.PAGE_INPUTS)
    out = assembly.convert(pages, lambda n, w, h, p: [{"id": 0, "label": "picture", "confidence": 1.0, "bbox": {"l": 0.0, "t": 0.0, "r": 1.0, "b": 1.0, "coord_origin": "TOPLEFT"}, "cells": []}])
    assert "CoGroup" not in (plan := out._jdf.queryExecution().toString()) and plan.split("Physical Plan")[1].count("Exchange") == 1
    got = {r.doc: [p.prov[0].page_no for p in r.document.pictures] for r in out.collect()}
    assert got == {"a": [1, 2], "b": [1]}


def test_pictures_are_made_on_all_cores(spark):
    from lumenpass.plans import layout_queries

    made = layout_queries._pictures(spark, "/root/testdata/sf0.001")
    assert made.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism and made.count() == 200
