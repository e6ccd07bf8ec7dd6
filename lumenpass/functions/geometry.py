"""Boxes (structs of l, t, r, b and coord_origin) as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def box(left, top, right, bottom, origin: Column | str = "TOPLEFT") -> Column:
    made = F.lit(origin) if isinstance(origin, str) else origin
    sides = zip("ltrb", (left, top, right, bottom))
    return F.struct(*[_c(v).cast("double").alias(k) for k, v in sides], made.alias("coord_origin"))


def width(b) -> Column:
    return F.greatest(F.lit(0.0), _c(b)["r"] - _c(b)["l"])


def height(b) -> Column:
    return F.greatest(F.lit(0.0), _c(b)["b"] - _c(b)["t"])


def area(b) -> Column:
    return width(b) * height(b)


def clamp(b, page_width, page_height) -> Column:
    b = _c(b)

    def inside(v: Column, most) -> Column:
        return F.least(_c(most).cast("double"), F.greatest(F.lit(0.0), v))

    return box(inside(b["l"], page_width), inside(b["t"], page_height), inside(b["r"], page_width), inside(b["b"], page_height), b["coord_origin"])


def _flip(b: Column, page_height, origin: str) -> Column:
    h = _c(page_height).cast("double")
    return box(b["l"], h - b["b"], b["r"], h - b["t"], origin)


def to_top_left(b, page_height) -> Column:
    b = _c(b)
    return F.when(b["coord_origin"] == "BOTTOMLEFT", _flip(b, page_height, "TOPLEFT")).otherwise(b)


def to_bottom_left(b, page_height) -> Column:
    b = _c(b)
    return F.when(b["coord_origin"] == "TOPLEFT", _flip(b, page_height, "BOTTOMLEFT")).otherwise(b)


def intersection(a, b) -> Column:
    """The common box, or null where the overlap isn't strictly positive."""
    a, b = _c(a), _c(b)
    left, top, right, bottom = F.greatest(a["l"], b["l"]), F.greatest(a["t"], b["t"]), F.least(a["r"], b["r"]), F.least(a["b"], b["b"])
    return F.when((right > left) & (bottom > top), box(left, top, right, bottom, a["coord_origin"]))


def intersection_area(a, b) -> Column:
    a, b = _c(a), _c(b)
    w, h = F.least(a["r"], b["r"]) - F.greatest(a["l"], b["l"]), F.least(a["b"], b["b"]) - F.greatest(a["t"], b["t"])
    return F.when((w > 0) & (h > 0), w * h).otherwise(0.0)


def intersection_over_self(own, other) -> Column:
    return F.when(area(own) > 0, intersection_area(own, other) / area(own)).otherwise(0.0)


def center(b) -> Column:
    b = _c(b)
    return F.struct(((b["l"] + b["r"]) / 2).alias("x"), ((b["t"] + b["b"]) / 2).alias("y"))


def contains_point(b, x, y) -> Column:
    b, x, y = _c(b), _c(x), _c(y)
    return (x >= b["l"]) & (x <= b["r"]) & (y >= b["t"]) & (y <= b["b"])


def horizontally_overlaps(a, b) -> Column:
    a, b = _c(a), _c(b)
    return F.least(a["r"], b["r"]) > F.greatest(a["l"], b["l"])


def scale(b, source_width, source_height, target_width, target_height) -> Column:
    """Scaled to another size; a source side that isn't positive leaves its direction as it is."""
    b = _c(b)
    x = F.when(_c(source_width) <= 0, 1.0).otherwise(_c(target_width) / _c(source_width))
    y = F.when(_c(source_height) <= 0, 1.0).otherwise(_c(target_height) / _c(source_height))
    return box(b["l"] * x, b["t"] * y, b["r"] * x, b["b"] * y, b["coord_origin"])


def takes_cell(cluster, cell, threshold: float) -> Column:
    """A cluster takes a cell that lies in it by ``threshold`` of its area, or whose centre does."""
    middle = center(cell)
    return (intersection_over_self(cell, cluster) >= threshold) | contains_point(cluster, middle["x"], middle["y"])


def decode_detection(d, image_width, image_height, model_width, model_height) -> Column:
    """A box from a detector's four numbers: centre and size if all are at most 1.5, else corners in model pixels."""
    d, w, h = _c(d), _c(image_width).cast("double"), _c(image_height).cast("double")
    v = [F.element_at(d, k) for k in range(1, 5)]
    x, y = w / _c(model_width), h / _c(model_height)
    relative = box((v[0] - v[2] / 2) * w, (v[1] - v[3] / 2) * h, (v[0] + v[2] / 2) * w, (v[1] + v[3] / 2) * h)
    corners = box(v[0] * x, v[1] * y, v[2] * x, v[3] * y)
    return F.when(F.array_max(d) <= 1.5, relative).otherwise(corners)


def softmax(values) -> Column:
    v = _c(values)
    e = F.transform(v, lambda x: F.exp(x - F.array_max(v)))
    total = F.aggregate(e, F.lit(0.0), lambda a, x: a + x)
    return F.when(total == 0, F.transform(e, lambda x: F.lit(0.0))).otherwise(F.transform(e, lambda x: x / total))


def sigmoid(x) -> Column:
    return 1 / (1 + F.exp(-_c(x)))
