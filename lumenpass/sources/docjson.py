"""Document JSON (schema DoclingDocument 1.10.0): parse to a document column, validate, and write."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumenpass import schemas as S
from lumenpass.functions import plain
from lumenpass.functions import text as T

SCHEMA_NAME, SCHEMA_VERSION = "DoclingDocument", "1.10.0"
META = "lumenpass"
INT_MAX = 2**31 - 1


def _string(e, name: str) -> str | None:
    v = e.get(name) if isinstance(e, dict) else None
    return v if isinstance(v, str) else None


def _int(e, name: str, default: int) -> int:
    v = e.get(name) if isinstance(e, dict) else None
    return v if isinstance(v, int) and not isinstance(v, bool) and -INT_MAX - 1 <= v <= INT_MAX else default


def _float(e, name: str, default: float) -> float:
    v = e.get(name) if isinstance(e, dict) else None
    return float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else default


def _list(e, name: str) -> list:
    v = e.get(name) if isinstance(e, dict) else None
    return v if isinstance(v, list) else []


def _flag(e, name: str) -> bool:
    return isinstance(e, dict) and e.get(name) is True


def _ref(e, default: str) -> str:
    if isinstance(e, str):
        return e
    return _string(e, "$ref") or default if isinstance(e, dict) and _string(e, "$ref") is not None else default


def _box(e) -> dict:
    origin = (_string(e, "coord_origin") or "").upper()
    return {**{k: _float(e, k, 0.0) for k in "ltrb"}, "coord_origin": "BOTTOMLEFT" if origin == "BOTTOMLEFT" else "TOPLEFT"}


def _prov(e) -> dict:
    span = _list(e, "charspan")
    whole = len(span) >= 2 and all(isinstance(x, int) and not isinstance(x, bool) and abs(x) <= INT_MAX for x in span[:2])
    box = e.get("bbox") if isinstance(e, dict) else None
    return {"page_no": _int(e, "page_no", 1), "bbox": _box(box if box is not None else {}), "char_span": {"start": span[0], "end": span[1]} if whole else None}


def _meta(e) -> tuple[list[str], str | None, str | None]:
    """(keywords, source id, source display name) of whichever private namespace carries them."""
    meta = e.get("meta") if isinstance(e, dict) else None
    for own in (meta or {}).values() if isinstance(meta, dict) else []:
        if isinstance(own, dict) and {"keywords", "source_id", "source_display_name"} & own.keys():
            return plain.clean_keywords([k for k in _list(own, "keywords") if isinstance(k, str)]), _string(own, "source_id"), _string(own, "source_display_name")
    return [], None, None


def _classes(e) -> list[dict]:
    out = []
    for a in _list(e, "annotations"):
        if (_string(a, "kind") or "").lower() == "classification":
            out += [{"class_name": _string(c, "class_name") or "", "confidence": _float(c, "confidence", 0.0)} for c in _list(a, "predicted_classes")]
    return [c for c in out if c["class_name"].strip()]


def _item(kind: str, default: str, k: int, e) -> dict:
    label = _string(e, "label")
    label = default if label is None else label
    keywords, source, name = _meta(e)
    layer = (_string(e, "content_layer") or "").lower()
    classes = _classes(e) if kind == "pictures" else []
    ref = _string(e, "self_ref")
    out = {
        "self_ref": f"#/{kind}/{k}" if ref is None else ref, "parent": _ref(e.get("parent"), "#/body") if isinstance(e, dict) else "#/body", "label": label,
        "content_layer": layer if layer in ("furniture", "background", "invisible", "notes") else "body", "prov": [_prov(p) for p in _list(e, "prov")],
        "keywords": plain.weak_keywords(label, [(c["class_name"], c["confidence"]) for c in classes], keywords), "source_id": source, "source_display_name": name,
    }
    if kind == "texts":
        text = _string(e, "text") or ""
        orig = _string(e, "orig")
        out |= {"text": text, "orig": text if orig is None else orig}
    elif kind == "tables":
        data = e.get("data") if isinstance(e, dict) else None
        cells = [
            {
                "text": _string(c, "text") or "", "bbox": _box(c["bbox"]) if isinstance(c, dict) and "bbox" in c else None,
                "start_row_offset_idx": _int(c, "start_row_offset_idx", 0), "end_row_offset_idx": _int(c, "end_row_offset_idx", 1),
                "start_col_offset_idx": _int(c, "start_col_offset_idx", 0), "end_col_offset_idx": _int(c, "end_col_offset_idx", 1),
                "row_header": _flag(c, "row_header"), "column_header": _flag(c, "column_header"), "row_section": _flag(c, "row_section"),
            }
            for c in _list(data, "table_cells")
        ]
        out["data"] = {"num_rows": _int(data, "num_rows", len(cells)) if data is not None else 0, "num_cols": _int(data, "num_cols", 0), "table_cells": cells}
    else:
        out["classifications"] = classes
    return out


def parse(text: str | None) -> tuple[dict | None, str | None]:
    """(document, None) or (None, error). Fields of the wrong kind take their defaults."""
    try:
        root = json.loads(text)
    except (TypeError, ValueError) as e:
        return None, f"Unable to parse document JSON: {e}"
    schema = _string(root, "schema_name")
    if schema is None:
        return None, "The JSON is no document: schema_name is missing."
    if schema != SCHEMA_NAME:
        return None, f"Expected schema_name '{SCHEMA_NAME}', got '{schema}'."
    pages = {}
    for k, p in (root.get("pages") if isinstance(root.get("pages"), dict) else {}).items():
        try:
            n = int(k)
        except ValueError:
            continue
        size = p.get("size") if isinstance(p, dict) else None
        pages[n] = {"page_no": _int(p, "page_no", n), "size": {"width": _float(size, "width", 0.0), "height": _float(size, "height", 0.0)}}
    origin = root.get("origin")
    name = _string(root, "name")

    def refs(group: str) -> list[str]:
        return [r for c in _list(root.get(group), "children") if (r := _ref(c, "")).strip()]

    items = {kind: [_item(kind, default, k, e) for k, e in enumerate(_list(root, kind))] for kind, default in (("texts", "text"), ("tables", "table"), ("pictures", "picture"))}
    return {"name": "document" if name is None else name, "origin_file_name": _string(origin, "filename"), "origin_mime_type": _string(origin, "mimetype"), "pages": pages, **items, "body_children": refs("body"), "furniture_children": refs("furniture")}, None


def loads(text: str) -> dict:
    document, error = parse(text)
    if error:
        raise ValueError(error)
    return document


def parsed(text: Column | str) -> Column:
    """struct<document, error> of a JSON column. The wrong-kind rules are per field, so an Arrow worker does it."""
    return F.udf(lambda t: parse(t), f"struct<document: {S.DOCUMENT}, error: string>", useArrow=True)(text)


def _prov_out(p: dict) -> dict:
    out = {"page_no": p["page_no"], "bbox": p["bbox"]}
    return out | ({"charspan": [p["char_span"]["start"], p["char_span"]["end"]]} if p.get("char_span") else {})


def _item_out(kind: str, i: dict) -> dict:
    keywords = plain.clean_keywords(i.get("keywords"))
    named = {k: plain.normalize_whitespace(i.get(k)) for k in ("source_id", "source_display_name")}
    own = ({"keywords": keywords} if keywords else {}) | {k: v for k, v in named.items() if v}
    out = {
        "self_ref": i["self_ref"], "parent": {"$ref": i["parent"]}, "children": [], "label": i["label"], "content_layer": i["content_layer"],
        "prov": [_prov_out(p) for p in i["prov"] or []], "meta": {META: own} if own else None,
    }
    if kind == "texts":
        out |= {"orig": i["orig"], "text": i["text"]}
    elif kind == "tables":
        cells = [({"text": c["text"]} | ({"bbox": c["bbox"]} if c.get("bbox") else {}) | {k: v for k, v in c.items() if k not in ("text", "bbox")}) for c in i["data"]["table_cells"] or []]
        out["data"] = {"num_rows": i["data"]["num_rows"], "num_cols": i["data"]["num_cols"], "table_cells": cells}
    elif i.get("classifications"):
        out["annotations"] = [{"kind": "classification", "provenance": META, "predicted_classes": [{"class_name": c["class_name"], "confidence": float(c["confidence"])} for c in i["classifications"]]}]
    return out


def dumps(document: dict, indent: int | None = None) -> str:
    d = document
    out: dict = {"schema_name": SCHEMA_NAME, "version": SCHEMA_VERSION, "name": d["name"]}
    if d.get("origin_file_name") is not None:
        out["origin"] = {"filename": d["origin_file_name"], "mimetype": d.get("origin_mime_type") or "application/pdf", "binary_hash": 0}
    out["pages"] = {str(n): {"size": p["size"], "page_no": p["page_no"]} for n, p in sorted((d.get("pages") or {}).items())}
    for kind in ("texts", "tables", "pictures"):
        out[kind] = [_item_out(kind, i) for i in d.get(kind) or []]
    for group in ("body", "furniture"):
        children = [{"$ref": r} for r in d.get(f"{group}_children") or []]
        out[group] = {"self_ref": f"#/{group}", "parent": None, "children": children, "content_layer": group, "meta": None, "name": "_root_", "label": "unspecified"}
    return json.dumps(out, ensure_ascii=False, indent=indent, separators=None if indent else (",", ":"))


def written(document: Column | str) -> Column:
    """A document column as JSON."""
    from lumenpass.operators.assembly import _plain

    return F.udf(lambda d: None if d is None else dumps(_plain(d)), "string", useArrow=True)(document)


def validate(document: Column | str) -> Column:
    """array<string> of what is wrong with a document; all in column expressions."""
    d = F.col(document) if isinstance(document, str) else document
    none = F.array().cast("array<string>")
    refs = F.concat(T.array_of(["#/body", "#/furniture"]), *[F.coalesce(F.transform(d[k], lambda i: i["self_ref"]), none) for k in ("texts", "tables", "pictures")])
    missing = F.transform(F.filter(F.concat(F.coalesce(d["body_children"], none), F.coalesce(d["furniture_children"], none)), lambda r: ~F.array_contains(refs, r)), lambda r: F.concat(F.lit("Missing referenced child: "), r))
    when = lambda bad, said: F.when(bad, F.array(said if isinstance(said, Column) else F.lit(said))).otherwise(none)
    texts = F.flatten(F.transform(d["texts"], lambda i: F.concat(when(T.blank(i["self_ref"]), "Text item self_ref is required."), when(T.blank(i["text"]), F.concat(F.lit("Text item "), i["self_ref"], F.lit(" has empty text."))))))
    tables = F.flatten(F.transform(d["tables"], lambda i: F.concat(when(T.blank(i["self_ref"]), "Table item self_ref is required."), when((i["data"]["num_rows"] < 0) | (i["data"]["num_cols"] < 0), F.concat(F.lit("Table item "), i["self_ref"], F.lit(" has invalid dimensions."))))))
    return F.concat(when(T.blank(d["name"]), "Document name is required."), when(F.size(d["pages"]) <= 0, "At least one page is required."), missing, F.coalesce(texts, none), F.coalesce(tables, none))
