"""RGB images (width, height, bytes) with numpy: crop, bilinear resize, tensors for models."""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def validate(width: int, height: int, pixels: bytes) -> np.ndarray:
    if width <= 0 or height <= 0:
        raise ValueError("Image dimensions must be positive.")
    if len(pixels) != width * height * 3:
        raise ValueError(f"Expected {width * height * 3} RGB bytes, got {len(pixels)}.")
    return np.frombuffer(pixels, np.uint8).reshape(height, width, 3)


def solid(width: int, height: int, red: int, green: int, blue: int) -> tuple[int, int, bytes]:
    return width, height, bytes([red, green, blue]) * (width * height)


def crop(box: dict, width: int, height: int, pixels: bytes) -> tuple[int, int, bytes]:
    """The part under a box, at least one pixel; beyond the edge the edge is repeated."""
    image = validate(width, height, pixels)
    top, bottom = (height - box["b"], height - box["t"]) if box["coord_origin"] == "BOTTOMLEFT" else (box["t"], box["b"])
    inside = lambda v, most: min(float(most), max(0.0, v))
    x0, y0 = math.floor(inside(box["l"], width)), math.floor(inside(top, height))
    w, h = max(1, math.ceil(inside(box["r"], width)) - x0), max(1, math.ceil(inside(bottom, height)) - y0)
    rows, columns = np.clip(np.arange(y0, y0 + h), 0, height - 1), np.clip(np.arange(x0, x0 + w), 0, width - 1)
    return w, h, image[rows][:, columns].tobytes()


def resize_bilinear(to_width: int, to_height: int, width: int, height: int, pixels: bytes) -> tuple[int, int, bytes]:
    """Half-pixel centres; indices are clamped but weights come from the unclamped floor; halves round to even."""
    image = validate(width, height, pixels)
    if to_width <= 0 or to_height <= 0:
        raise ValueError("Target dimensions must be positive.")
    if (to_width, to_height) == (width, height):
        return width, height, pixels

    def place(n: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = (np.arange(n) + 0.5) * (m / n) - 0.5
        low = np.clip(np.floor(at).astype(int), 0, m - 1)
        return low, np.clip(low + 1, 0, m - 1), at - np.floor(at)

    y0, y1, wy = place(to_height, height)
    x0, x1, wx = place(to_width, width)
    f, wx, wy = image.astype(np.float64), wx[None, :, None], wy[:, None, None]
    top = f[y0][:, x0] * (1 - wx) + f[y0][:, x1] * wx
    bottom = f[y1][:, x0] * (1 - wx) + f[y1][:, x1] * wx
    return to_width, to_height, np.clip(np.rint(top * (1 - wy) + bottom * wy), 0, 255).astype(np.uint8).tobytes()


@dataclass(frozen=True)
class Preprocessor:
    width: int = 224
    height: int = 224
    rescale: bool = True
    factor: float = 1 / 255
    normalize: bool = True
    mean: tuple[float, ...] = (0.485, 0.456, 0.406)
    std: tuple[float, ...] = (0.229, 0.224, 0.225)


def _json(path: str) -> dict:
    return json.loads(path) if path.lstrip().startswith("{") else json.load(open(path, encoding="utf-8"))


def load_preprocessor(path: str) -> Preprocessor:
    """From a model's JSON file or its text; what is missing keeps its default."""
    raw, d = _json(path), Preprocessor()
    size = raw.get("size") if isinstance(raw.get("size"), dict) else {}
    return Preprocessor(
        int(size.get("width", d.width)), int(size.get("height", d.height)), bool(raw.get("do_rescale", d.rescale)), float(raw.get("rescale_factor", d.factor)),
        bool(raw.get("do_normalize", d.normalize)), tuple(raw.get("image_mean", d.mean)), tuple(raw.get("image_std", d.std)),
    )


def load_labels(path: str, default: dict[int, str]) -> dict[int, str]:
    """``id2label`` of a model's JSON, or the default."""
    found = _json(path).get("id2label")
    return {int(k): v for k, v in found.items() if str(k).lstrip("-").isdigit()} if isinstance(found, dict) and found else default


def to_nchw(config: Preprocessor, width: int, height: int, pixels: bytes) -> np.ndarray:
    w, h, data = resize_bilinear(config.width, config.height, width, height, pixels)
    x = np.frombuffer(data, np.uint8).reshape(h, w, 3).transpose(2, 0, 1).astype(np.float32)
    if config.rescale:
        x = x * np.float32(config.factor)
    if config.normalize:
        mean = [config.mean[k] if k < len(config.mean) else 0.0 for k in range(3)]
        std = [config.std[k] if k < len(config.std) and config.std[k] else 1.0 for k in range(3)]
        x = (x - np.array(mean, np.float32)[:, None, None]) / np.array(std, np.float32)[:, None, None]
    return x.astype(np.float32)


LAYOUT_LABELS = dict(enumerate("caption footnote formula list_item page_footer page_header picture section_header table text title document_index code checkbox_selected checkbox_unselected form key_value_region".split()))


def pick_outputs(outputs: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(logits, boxes) of a detector: by name, else the three-dimensional ones without and with 4 at the end."""
    rank3 = {n: v for n, v in outputs.items() if v.ndim == 3}
    logits = next((v for n, v in outputs.items() if "logit" in n.lower()), None)
    boxes = next((v for n, v in outputs.items() if "box" in n.lower()), None)
    logits = logits if logits is not None else next((v for v in rank3.values() if v.shape[2] != 4), None)
    boxes = boxes if boxes is not None else next((v for v in rank3.values() if v.shape[2] == 4), None)
    if logits is None or boxes is None:
        raise ValueError("The layout model's outputs lack rank-3 logits or boxes.")
    if logits.shape[0] != 1 or boxes.shape[0] != 1 or logits.shape[1] != boxes.shape[1]:
        raise ValueError("Unexpected batch or query dimensions of the layout model.")
    return logits, boxes


def detections(outputs: dict[str, np.ndarray], width: int, height: int, config: Preprocessor, threshold: float = 0.3, labels: dict[int, str] = LAYOUT_LABELS) -> list[dict]:
    """Layout clusters: the surest label of each query by sigmoid, kept from ``threshold`` on, its box clamped to the page."""
    logits, boxes = pick_outputs(outputs)
    p = 1 / (1 + np.exp(-logits[0].astype(np.float64)))
    best = p.argmax(axis=1)
    out = []
    for q in np.flatnonzero(p[np.arange(len(p)), best] >= threshold):
        a, b, c, d = boxes[0, q].astype(float)
        if max(a, b, c, d) <= 1.5:
            box = ((a - c / 2) * width, (b - d / 2) * height, (a + c / 2) * width, (b + d / 2) * height)
        else:
            x, y = width / config.width, height / config.height
            box = (a * x, b * y, c * x, d * y)
        sides = [min(float(most), max(0.0, v)) for v, most in zip(box, (width, height, width, height))]
        out.append({"id": int(q), "label": labels.get(int(best[q]), f"label_{best[q]}"), "confidence": float(p[q, best[q]]), "bbox": {**dict(zip("ltrb", sides)), "coord_origin": "TOPLEFT"}, "cells": []})
    return out


def classes(logits: np.ndarray, labels: dict[int, str], top: int = 5) -> list[tuple[str, float]]:
    """Figure classes by softmax, surest first."""
    v = logits.ravel().astype(np.float64)
    e = np.exp(v - v.max()) if len(v) else v
    p = e / e.sum() if len(v) and e.sum() else np.zeros(len(v))
    order = np.argsort(-p, kind="stable")[: max(1, top)]
    return [(labels.get(int(k), f"label_{k}"), float(p[k])) for k in order]


def crop_column(box: Column | str, width: Column | str, height: Column | str, pixels: Column | str) -> Column:
    """struct<width, height, pixels> of the part under a box."""
    return F.udf(lambda b, w, h, p: crop(b.asDict() if hasattr(b, "asDict") else b, w, h, p), "struct<width:int,height:int,pixels:binary>", useArrow=True)(box, width, height, pixels)


def resize_column(to_width: int, to_height: int, width: Column | str, height: Column | str, pixels: Column | str) -> Column:
    return F.udf(lambda w, h, p: resize_bilinear(to_width, to_height, w, h, p), "struct<width:int,height:int,pixels:binary>", useArrow=True)(width, height, pixels)


def solid_column(width: Column | str, height: Column | str, rgb: str) -> Column:
    """Bytes of an image of one colour (six hex digits)."""
    w, h = (F.col(x) if isinstance(x, str) else x for x in (width, height))
    return F.unhex(F.repeat(F.lit(rgb), (w * h).cast("int")))


def valid_column(width: Column | str, height: Column | str, pixels: Column | str) -> Column:
    w, h, p = (F.col(x) if isinstance(x, str) else x for x in (width, height, pixels))
    return (w > 0) & (h > 0) & (F.octet_length(p) == w * h * 3)
