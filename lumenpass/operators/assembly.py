"""Layout predictions to document trees, and document trees to passages. Per-document folds in Arrow workers."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from lumenpass import options as O
from lumenpass import schemas as S
from lumenpass.functions import images, plain
from lumenpass.operators.cells import order_cells, sort_clusters
from lumenpass.options import ChunkOptions, ConversionOptions
from lumenpass.sources.work import small_batches

NUMBER = re.compile(r"^\s*(\d+(?:\.\d+)*)\b")


def _top_left(box: dict, height: float) -> dict:
    if box["coord_origin"] != "BOTTOMLEFT":
        return dict(box)
    return {"l": box["l"], "t": height - box["b"], "r": box["r"], "b": height - box["t"], "coord_origin": "TOPLEFT"}


def attach(page: dict, clusters: list[dict], threshold: float) -> list[dict]:
    """A page's clusters with the cells they take, by top, then left: by a cell's share in it, or because its centre is.

    Ids by position, whatever cells they had before.
    """
    height = float(page["height"])
    cells = [c if c["bbox"]["coord_origin"] != "BOTTOMLEFT" else {**c, "bbox": _top_left(c["bbox"], height)} for c in page["cells"]]
    cells.sort(key=lambda c: (c["bbox"]["t"], c["bbox"]["l"]))
    left, t, r, b = (np.array([c["bbox"][k] for c in cells], np.float64) for k in "ltrb")
    area, x, y = np.maximum(0.0, r - left) * np.maximum(0.0, b - t), (left + r) / 2, (t + b) / 2
    out = []
    for k, cluster in enumerate(clusters):
        box = _top_left(cluster["bbox"], height)
        w, h = np.minimum(r, box["r"]) - np.maximum(left, box["l"]), np.minimum(b, box["b"]) - np.maximum(t, box["t"])
        share = np.divide(w * h, area, out=np.zeros(len(cells)), where=(area > 0) & (w > 0) & (h > 0))
        taken = (share >= threshold) | ((box["l"] <= x) & (x <= box["r"]) & (box["t"] <= y) & (y <= box["b"]))
        out.append({**cluster, "id": k, "bbox": box, "cells": [cells[i] for i in np.flatnonzero(taken).tolist()]})
    return out


def cluster_text(cluster: dict) -> str:
    return plain.normalize_whitespace(" ".join(c["text"] for c in order_cells(cluster["cells"])))


def table_data(cluster: dict) -> dict:
    """One row for each cell in reading order, one column."""
    cells = [
        {"text": plain.normalize_whitespace(c["text"]), "bbox": c["bbox"], "start_row_offset_idx": k, "end_row_offset_idx": k + 1, "start_col_offset_idx": 0, "end_col_offset_idx": 1, "row_header": False, "column_header": False, "row_section": False}
        for k, c in enumerate(order_cells(cluster["cells"]))
    ]
    return {"num_rows": len(cells), "num_cols": 1 if cells else 0, "table_cells": cells}


def assemble(name: str, origin: str | None, pages: list[dict], predictions: list[dict], options: ConversionOptions = ConversionOptions(), classify: Callable | None = None) -> tuple[dict | None, str | None]:
    """(document, None) or (None, error).

    pages: page_no, width, height, cells, pixels; predictions: page_no, clusters. Of several predictions for a page the
    last counts. ``classify`` takes (width, height, RGB bytes) of a picture and gives [(class, confidence)].
    """
    o = options.sane()
    if not pages:
        return None, "At least one page is required."
    by_page = {p["page_no"]: p for p in predictions}
    missing = [str(p["page_no"]) for p in pages if p["page_no"] not in by_page]
    if missing:
        return None, f"Missing layout predictions for pages: {', '.join(missing)}."
    found = []
    for page in pages:
        for cluster in attach(page, by_page[page["page_no"]]["clusters"], o.cell_overlap):
            label = cluster["label"]
            textual = label not in O.TABLE_LIKE and label not in O.PICTURE_LIKE
            cluster["text"] = cluster_text(cluster) if textual else ""
            if not textual or o.include_empty_text or cluster["text"]:
                found.append((page["page_no"], cluster))
    page_of = {p["page_no"]: p for p in pages}
    items: dict[str, list[dict]] = {"texts": [], "tables": [], "pictures": []}
    body, furniture = [], []
    for page_no, cluster in sort_clusters(found):
        label = cluster["label"]
        kind = "tables" if label in O.TABLE_LIKE else "pictures" if label in O.PICTURE_LIKE else "texts"
        ref = f"#/{kind}/{len(items[kind])}"
        layer = "furniture" if label in ("page_header", "page_footer") else "body"
        text, classes, extra = "", [], {}
        if kind == "texts":
            text = cluster["text"]
            label = label if label in O.TEXT_LIKE else "text"
            extra = {"text": text, "orig": text}
        elif kind == "tables":
            label = label if label == "document_index" else "table"
            extra = {"data": table_data(cluster)}
        else:
            label = label if label == "chart" else "picture"
            if classify is not None:
                page = page_of[page_no]
                try:
                    got = classify(*images.crop(cluster["bbox"], page["width"], page["height"], page["pixels"]))
                except Exception as e:  # noqa: BLE001 - a provider's failure is the document's error
                    return None, str(e)
                classes = sorted(got, key=lambda c: -c[1])[: o.max_figure_classes]
            extra = {"classifications": [{"class_name": n, "confidence": float(p)} for n, p in classes]}
        items[kind].append({
            "self_ref": ref, "parent": f"#/{layer}", "label": label, "content_layer": layer,
            "prov": [{"page_no": page_no, "bbox": cluster["bbox"], "char_span": {"start": 0, "end": len(text)}}],
            "keywords": plain.weak_keywords(label, classes, []), "source_id": name, "source_display_name": origin or name, **extra,
        })
        (furniture if layer == "furniture" else body).append(ref)
    sizes = {p["page_no"]: {"page_no": p["page_no"], "size": {"width": float(p["width"]), "height": float(p["height"])}} for p in pages}
    return {"name": name, "origin_file_name": origin, "origin_mime_type": "application/pdf", "pages": sizes, **items, "body_children": body, "furniture_children": furniture}, None


PAGE_INPUTS = f"doc string, origin string, page_no int, width int, height int, pixels binary, cells array<{S.CELL}>"
READ_PAGES = f"{PAGE_INPUTS}, error string"
PREDICTIONS = f"doc string, page_no int, seq long, clusters array<{S.CLUSTER}>"


def _plain(x):
    """Rows, arrays and maps of a pandas frame as dicts and lists."""
    if x is None:
        return None
    if hasattr(x, "asDict"):
        return x.asDict(recursive=True)
    if isinstance(x, dict):
        return {k: _plain(v) for k, v in x.items()}
    if isinstance(x, (list, tuple)) or type(x).__name__ == "ndarray":
        return [_plain(v) for v in x]
    return x


def _cells_of(column: pa.ListArray) -> list[list[dict]]:
    """Each row's cells; as flat columns first, which is many times faster than value by value."""
    flat = column.flatten()
    box = flat.field("bbox")
    if flat.null_count or box.null_count:
        return [c or [] for c in column.to_pylist()]
    boxes = [dict(zip(("l", "t", "r", "b", "coord_origin"), x)) for x in zip(*[box.field(k).to_pylist() for k in ("l", "t", "r", "b", "coord_origin")])]
    cells = [{"text": t, "bbox": x, "confidence": c} for t, x, c in zip(flat.field("text").to_pylist(), boxes, flat.field("confidence").to_pylist())]
    ends = np.cumsum([n or 0 for n in pc.list_value_length(column).to_pylist()])
    return [cells[a:z] for a, z in zip([0, *ends[:-1].tolist()], ends.tolist())]


_ROWS = f"doc string, origin string, page_no int, width int, height int, pixels binary, cells array<{S.CELL}>, error string, guess_no int, seq long, clusters array<{S.CLUSTER}>, guess_error string, is_page boolean, is_guess boolean"


def _folded(rows: DataFrame, options: ConversionOptions, classify: Callable | None) -> DataFrame:
    """(doc, document, error) from rows that are pages, predictions, or both: a fold over each document's rows, which
    lie together; what is held is bounded by the longest document."""
    schema = StructType.fromDDL(f"doc string, document {S.DOCUMENT}, error string")
    target = to_arrow_schema(schema)

    def build(held: list[dict]) -> tuple | None:
        pages = sorted((r for r in held if r["is_page"]), key=lambda r: r["page_no"])
        if not pages:
            return None
        guesses = sorted(({"page_no": r["guess_no"], "clusters": r["clusters"], "seq": r["seq"], "error": r["guess_error"]} for r in held if r["is_guess"]), key=lambda g: g["seq"])
        failed = [r["error"] for r in [*pages, *sorted(guesses, key=lambda g: g["page_no"])] if r["error"]]
        return (pages[0]["doc"], None, failed[0]) if failed else (pages[0]["doc"], *assemble(pages[0]["doc"], pages[0]["origin"], pages, guesses, options, classify))

    def batch(found: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], t.type) for k, t in enumerate(target)], schema=target)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for b in batches:
            out = []
            columns = [_cells_of(c) if n == "cells" else c.to_pylist() for n, c in zip(b.schema.names, b.columns)]
            for values in zip(*columns):
                row = dict(zip(b.schema.names, values))
                if held and row["doc"] != held[0]["doc"]:
                    out.append(build(held))
                    held = []
                held.append(row)
            if out := [x for x in out if x]:
                yield batch(out)
        if held and (last := build(held)):
            yield batch([last])

    small_batches(rows.sparkSession)
    return rows.repartition("doc").sortWithinPartitions("doc").mapInArrow(run, schema)


def _row(df: DataFrame, **given: Column) -> DataFrame:
    """The columns of ``_ROWS``: those given, the table's own, or nulls."""
    names = [f for f in StructType.fromDDL(_ROWS)]
    return df.select(*[(given[f.name] if f.name in given else F.lit(None)).cast(f.dataType).alias(f.name) for f in names])


def _page_columns(pages: DataFrame) -> dict[str, Column]:
    return {c: F.col(c) for c in ("doc", "origin", "page_no", "width", "height", "pixels", "cells", "error") if c in pages.columns}


def convert_pages(pages: DataFrame, predictions: DataFrame, options: ConversionOptions = ConversionOptions(), classify: Callable | None = None) -> DataFrame:
    """(doc, document, error) from page inputs and layout predictions.

    What a recognizer or predictor failed with (column ``error`` of either table, if there is one) is the document's
    error: recognition first, then by page.
    """
    own = _row(pages, **_page_columns(pages), is_page=F.lit(True), is_guess=F.lit(False))
    wrong = {"guess_error": F.col("error")} if "error" in predictions.columns else {}
    guessed = _row(predictions, doc=F.col("doc"), guess_no=F.col("page_no"), seq=F.col("seq"), clusters=F.col("clusters"), **wrong, is_page=F.lit(False), is_guess=F.lit(True))
    return _folded(own.unionByName(guessed), options, classify)


def _tried(call: Callable, args: tuple) -> tuple[list, str | None]:
    try:
        return call(*args), None
    except Exception as e:  # noqa: BLE001 - a provider's failure is its page's error
        return [], str(e) or type(e).__name__


def _predicted(pages: DataFrame, predictor: Callable[[int, int, int, bytes], list[dict]]) -> DataFrame:
    """``pages`` with ``seq``, ``clusters`` and ``guess_error`` of a layout predictor; pages that weren't read aren't asked for."""
    schema = StructType([*pages.schema.fields, *StructType.fromDDL(f"seq long, clusters array<{S.CLUSTER}>, guess_error string")])
    kinds = [f.type for f in to_arrow_schema(schema)][-3:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seq = 0
        for b in batches:
            read = b.column("error").is_null().to_pylist() if "error" in b.schema.names else [True] * b.num_rows
            asked = zip(*[b.column(c).to_pylist() for c in ("page_no", "width", "height", "pixels")])
            got = [_tried(predictor, p) if ok else ([], None) for ok, p in zip(read, asked)]
            made = [range(seq, seq + len(got)), [list(g[0]) for g in got], [g[1] for g in got]]
            seq += len(got)
            yield pa.RecordBatch.from_arrays([*b.columns, *[pa.array(m, k) for m, k in zip(made, kinds)]], names=schema.names)

    small_batches(pages.sparkSession)
    return pages.mapInArrow(run, schema)


def predict_layout(pages: DataFrame, predictor: Callable[[int, int, int, bytes], list[dict]]) -> DataFrame:
    """Layout predictions of page images by a user's model: predictor(page_no, width, height, RGB) gives clusters.

    A page that it fails on has its error; pages that weren't read aren't asked for.
    """
    needed = ["doc", "page_no", "width", "height", "pixels", *(["error"] if "error" in pages.columns else [])]
    found = _predicted(pages.select(*needed), predictor)
    return found.select("doc", "page_no", "seq", "clusters", F.col("guess_error").alias("error"))


def recognize_pages(pages: DataFrame, ocr: Callable[[int, int, int, bytes], list[dict]]) -> DataFrame:
    """Page inputs with the cells that a user's recognizer reads, and its error where it fails."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            got = [_tried(ocr, p) for p in zip(f["page_no"], f["width"], f["height"], f["pixels"])]
            yield f.assign(cells=[g[0] for g in got], error=[g[1] for g in got])

    return pages.select(*[c.split(" ")[0] for c in PAGE_INPUTS.split(", ")[:6]], "cells").mapInPandas(run, READ_PAGES)


def rasterize(files: DataFrame, renderer: Callable[[bytes], list[dict]]) -> DataFrame:
    """Page inputs of binary files (path, content) by a user's renderer, which gives dicts of page_no, width, height, RGB
    ``pixels`` and, if it knows any, ``cells``. A file that it refuses gives one row with the error."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for path, content in zip(f["path"], f["content"]):
                got, error = _tried(renderer, (bytes(content),))
                name = path.rsplit("/", 1)[-1]
                out += [(path, name, p["page_no"], p["width"], p["height"], p["pixels"], p.get("cells", []), None) for p in got]
                if error:
                    out.append((path, name, 0, 0, 0, b"", [], error))
            yield pd.DataFrame(out, columns=["doc", "origin", "page_no", "width", "height", "pixels", "cells", "error"])

    return files.select("path", "content").mapInPandas(run, READ_PAGES)


@dataclass(frozen=True)
class LayoutModel:
    """A layout predictor: ``run`` takes an image tensor (1, 3, height, width) and gives the detector's outputs by name."""

    run: Callable
    config: images.Preprocessor = images.Preprocessor()
    labels: dict | None = None
    threshold: float = 0.3

    def __call__(self, page_no: int, width: int, height: int, pixels: bytes) -> list[dict]:
        x = images.to_nchw(self.config, width, height, bytes(pixels))
        return images.detections(self.run(x[None]), width, height, self.config, self.threshold, self.labels or images.LAYOUT_LABELS)


@dataclass(frozen=True)
class FigureModel:
    """A figure classifier: ``run`` takes an image tensor and gives logits by name."""

    run: Callable
    config: images.Preprocessor = images.Preprocessor()
    labels: dict | None = None
    top: int = 5

    def __call__(self, width: int, height: int, pixels: bytes) -> list[tuple[str, float]]:
        outputs = self.run(images.to_nchw(self.config, width, height, bytes(pixels))[None])
        return images.classes(next(iter(outputs.values())), self.labels or {}, self.top)


@lru_cache(maxsize=4)
def _session(path: str):
    import onnxruntime as ort

    o = ort.SessionOptions()
    o.intra_op_num_threads = o.inter_op_num_threads = 1
    return ort.InferenceSession(path, o)


@dataclass(frozen=True)
class OnnxRun:
    """The ``run`` of a model file that every worker can read; one session in each worker."""

    path: str

    def __call__(self, x):
        session = _session(self.path)
        return dict(zip([o.name for o in session.get_outputs()], session.run(None, {session.get_inputs()[0].name: x})))


def classify_figures(pictures: DataFrame, model: Callable[[int, int, bytes], list[tuple[str, float]]]) -> DataFrame:
    """``pictures`` (width, height, pixels, ...) with ``classes``, surest first, and the model's ``error`` where it fails."""
    schema = StructType([*pictures.schema.fields, *StructType.fromDDL("classes array<struct<class_name:string,confidence:double>>, error string")])
    kinds = [f.type for f in to_arrow_schema(schema)][-2:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [_tried(model, p) for p in zip(*[b.column(c).to_pylist() for c in ("width", "height", "pixels")])]
            classes = pa.array([[{"class_name": n, "confidence": float(p)} for n, p in g[0]] for g in got], kinds[0])
            yield pa.RecordBatch.from_arrays([*b.columns, classes, pa.array([g[1] for g in got], kinds[1])], names=schema.names)

    small_batches(pictures.sparkSession)
    return pictures.mapInArrow(run, schema)


def convert(pages: DataFrame, predictor: Callable, options: ConversionOptions = ConversionOptions(), classify: Callable | None = None, ocr: Callable | None = None) -> DataFrame:
    """Rasterized pages to documents: recognition (if a recognizer is given), layout, assembly. Pages are read and moved once."""
    found = _predicted(recognize_pages(pages, ocr) if ocr else pages, predictor)
    own = {c: F.col(c) for c in ("seq", "clusters", "guess_error")}
    return _folded(_row(found, **_page_columns(found), **own, guess_no=F.col("page_no"), is_page=F.lit(True), is_guess=F.lit(True)), options, classify)


# Documents to passages


def heading_parts(text: str) -> list[int] | None:
    m = NUMBER.match(text or "")
    parts = [int(p) for p in m[1].split(".")] if m else []
    return parts if parts and max(parts) < 2**31 else None


def next_sections(sections: list[str], heading: str) -> list[str]:
    """Section headings after a new one: numbered headings keep parents only if all of their numbers are there."""
    parts = heading_parts(heading)
    if parts is None:
        return [heading]
    parents = sections[: len(parts) - 1]
    kept = [p for p in map(heading_parts, parents) if p is not None]
    whole = bool(parents) and kept == [parts[: k + 1] for k in range(len(parts) - 1)]
    return (parents if whole else []) + [heading]


def table_text(item: dict) -> str:
    cells = item["data"]["table_cells"] if item.get("data") else []
    if not cells or item["data"]["num_rows"] == 0:
        return "[Table]"
    rows: dict[int, list[dict]] = {}
    for c in cells:
        rows.setdefault(c["start_row_offset_idx"], []).append(c)
    lines = (plain.normalize_whitespace(" | ".join(c["text"] for c in sorted(r, key=lambda c: c["start_col_offset_idx"]))) for _, r in sorted(rows.items()))
    return "\n".join(x for x in lines if x)


def picture_text(item: dict) -> str:
    classes = ", ".join(f"{c['class_name']} ({c['confidence']:.3f})" for c in item.get("classifications") or [])
    return f"[Picture: {classes}]" if classes else "[Picture]"


def _tidy(block: dict) -> dict:
    return {
        "text": plain.normalize_whitespace(block["text"]), "section_path": plain.clean_keywords(block["section_path"]), "content_role": block["content_role"],
        "page_numbers": sorted({p for p in block["page_numbers"] if p > 0}), "layout_labels": plain.clean_keywords(block["layout_labels"]),
        "captions": plain.clean_keywords(block["captions"], O.CAPTION_LIMIT), "keywords": plain.clean_keywords(block["keywords"]),
    }


def blocks_of(document: dict) -> list[dict]:
    """Blocks of the body in order, with section path, role, pages, labels, captions and keywords; unknown refs are passed over."""
    kinds = {kind: {i["self_ref"]: i for i in document.get(kind) or []} for kind in ("texts", "tables", "pictures")}
    title, sections, out = None, [], []
    for ref in document.get("body_children") or []:
        kind = next((k for k in kinds if ref in kinds[k]), None)
        if kind is None:
            continue
        item = kinds[kind][ref]
        label, captions, classes = item["label"], [], []
        if kind == "texts":
            text = item["text"]
            heading = plain.normalize_whitespace(text)
            if label == "title" and heading:
                title, sections = heading, []
            elif label == "section_header" and heading:
                sections = next_sections(sections, heading)
            captions = [heading] if label == "caption" and heading else []
        else:
            text = table_text(item) if kind == "tables" else picture_text(item)
            classes = [(c["class_name"], c["confidence"]) for c in item.get("classifications") or []]
        path = ([title] if title is not None else []) + sections
        role = plain.structured_role(path, text, label if kind == "texts" else None)
        labels = plain.layout_labels(label)
        keywords = plain.weak_keywords(label, classes, item.get("keywords")) + [x.replace("_", " ") for x in labels] + captions + plain.clean_keywords(path) + plain.role_names(role)
        block = _tidy({"text": text, "section_path": path, "content_role": role, "page_numbers": [p["page_no"] for p in item.get("prov") or []], "layout_labels": labels, "captions": captions, "keywords": keywords})
        if block["text"]:
            out.append(block)
    return out


def chunk_document_blocks(blocks: list[dict], o: ChunkOptions = ChunkOptions()) -> list[dict]:
    """Greedy packing within a section path and role, without overlap; a long block is cut into windows of its own."""
    size, out = max(1, o.max_chars), []
    held: list[dict] = []
    length = 0

    def flush() -> None:
        nonlocal held, length
        if text := plain.normalize_whitespace("\n\n".join(b["text"] for b in held)):
            gathered = {k: [x for b in held for x in b[k]] for k in ("page_numbers", "layout_labels", "captions", "keywords")}
            out.append(_tidy({"text": text, "section_path": held[0]["section_path"], "content_role": held[0]["content_role"], **gathered}))
        held, length = [], 0

    for block in map(_tidy, blocks):
        if not block["text"]:
            continue
        if held and (block["section_path"], block["content_role"]) != (held[0]["section_path"], held[0]["content_role"]):
            flush()
        if len(block["text"]) > size:
            flush()
            out += [{**block, "text": t} for _, t in plain.chunk_text(block["text"], o.max_chars, o.overlap_chars, o.min_chars)]
            continue
        if held and length + len(block["text"]) + 2 > size:
            flush()
        length += len(block["text"]) + (2 if held else 0)
        held.append(block)
    flush()
    return out


def document_blocks(document: Column | str) -> Column:
    return F.udf(lambda d: blocks_of(_plain(d)) if d is not None else [], f"array<{S.BLOCK}>", useArrow=True)(document)


def document_chunks(document: Column | str, options: ChunkOptions = ChunkOptions()) -> Column:
    return F.udf(lambda d: chunk_document_blocks(blocks_of(_plain(d)), options) if d is not None else [], f"array<{S.BLOCK}>", useArrow=True)(document)


def passages(df: DataFrame, options: ChunkOptions = ChunkOptions(), document_col: str = "document") -> DataFrame:
    """Passages of documents (id, display_name, location, document), numbered without gaps: one fold over Arrow batches."""
    slim = df.select("id", "display_name", "location", F.col(document_col).alias("document"))
    kinds = [slim.schema[c].dataType.simpleString() for c in ("id", "display_name", "location")]
    schema = StructType.fromDDL(f"source_id {kinds[0]}, source_display_name {kinds[1]}, source_location {kinds[2]}, `index` int, text string, section_path array<string>, content_role string, page_numbers array<int>, layout_labels array<string>, captions array<string>, keywords array<string>")
    target = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [chunk_document_blocks(blocks_of(d), options) if d is not None else [] for d in b.column("document").to_pylist()]
            at = pa.array([k for k, f in enumerate(found) for _ in f], pa.int64())
            flat = [c for f in found for c in f]
            number = pa.array([n for f in found for n in range(len(f))], pa.int32())
            columns = [pa.array([c[t.name] for c in flat], t.type) for t in list(target)[4:]]
            yield pa.RecordBatch.from_arrays([*[b.column(k).take(at) for k in range(3)], number, *columns], names=target.names)

    return slim.mapInArrow(run, schema)
