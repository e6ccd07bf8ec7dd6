"""Text cells of pages: assignment to layout clusters, merging of two readings, reading order."""

from __future__ import annotations

from functools import cmp_to_key

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenpass.functions import geometry as G
from lumenpass.functions import text as T


def attach_cells(clusters: DataFrame, cells: DataFrame, page_heights: DataFrame, threshold: float = 0.3, keys: tuple[str, ...] = ("page_no",)) -> DataFrame:
    """(keys, id, label, confidence, bbox, cells): each cluster with the cells that lie in it, by top, then left.

    An equi-join on the page with the overlap as its condition; a cell may go to several clusters; boxes are brought to
    a top-left origin by the page image's height; ids are the clusters' positions on their page.
    """
    k = list(keys)
    up = lambda df: df.join(page_heights.select(*k, F.col("height").alias("__h")), k).withColumn("bbox", G.to_top_left("bbox", "__h")).drop("__h")
    c = up(clusters).alias("c")
    t = up(cells).select(*k, F.col("bbox").alias("cell_box"), F.struct(F.col("bbox.t").alias("t"), F.col("bbox.l").alias("l"), F.col("cell_no").alias("n"), F.struct("text", "bbox", "confidence").alias("cell")).alias("cell")).alias("t")
    on = [F.col(f"c.{x}") == F.col(f"t.{x}") for x in k] + [G.takes_cell(F.col("c.bbox"), F.col("t.cell_box"), threshold)]
    joined = c.join(t, on, "left").select(*[F.col(f"c.{x}") for x in k], "c.id", "c.label", "c.confidence", "c.bbox", "t.cell")
    grouped = joined.groupBy(*k, "id").agg(F.first("label").alias("label"), F.first("confidence").alias("confidence"), F.first("bbox").alias("bbox"), F.array_sort(F.collect_list("cell")).alias("cells"))
    return grouped.withColumn("cells", F.transform("cells", lambda x: x["cell"]))


def merge_prefer_primary(primary: DataFrame, secondary: DataFrame, page_heights: DataFrame, threshold: float = 0.7, keys: tuple[str, ...] = ("page_no",)) -> DataFrame:
    """All primary cells, and the secondary ones with text that overlap none of them by ``threshold`` of either area."""
    k, limit = list(keys), min(1.0, max(0.0, threshold))
    up = lambda df, name: df.join(page_heights.select(*k, F.col("height").alias("__h")), k).withColumn(name, G.to_top_left("bbox", "__h")).drop("__h")
    p = up(primary, "__box").select(*[F.col(x).alias(f"__{x}") for x in k], F.col("__box").alias("__p"))
    s = up(secondary, "__s").where(T.normalize_whitespace("text") != "")
    near = (G.intersection_over_self("__s", "__p") >= limit) | (G.intersection_over_self("__p", "__s") >= limit)
    kept = s.join(p, [F.col(x) == F.col(f"__{x}") for x in k] + [near], "left_anti").drop("__s")
    return primary.unionByName(kept.select(*primary.columns))


def text_length(cells: DataFrame, keys: tuple[str, ...] = ("page_no",)) -> DataFrame:
    return cells.groupBy(*keys).agg(F.sum(F.length(T.normalize_whitespace("text"))).alias("n_chars"))


def has_enough_text(cells: DataFrame, least: int, keys: tuple[str, ...] = ("page_no",)) -> DataFrame:
    return text_length(cells, keys).select(*keys, (F.col("n_chars") >= max(0, least)).alias("enough"))


def scale_cells(cells: DataFrame, source: tuple[float, float], target: tuple[float, float]) -> DataFrame:
    return cells.withColumn("bbox", G.scale("bbox", F.lit(source[0]), F.lit(source[1]), F.lit(target[0]), F.lit(target[1])))


# In workers


def _group(label: str) -> int:
    return {"page_header": 0, "page_footer": 2}.get(label, 1)


def compare_clusters(a: tuple[int, dict], b: tuple[int, dict]) -> int:
    """Page; header, body, footer; then by top and left if they overlap sideways, else by left and top.

    Not transitive, so the order also depends on the stable sort and the order given.
    """
    (pa, x), (pb, y) = a, b
    first, second = (pa, _group(x["label"])), (pb, _group(y["label"]))
    if first == second:
        p, q = x["bbox"], y["bbox"]
        beside = min(p["r"], q["r"]) > max(p["l"], q["l"])
        first, second = ((p["t"], p["l"]), (q["t"], q["l"])) if beside else ((p["l"], p["t"]), (q["l"], q["t"]))
    return (first > second) - (first < second)


def sort_clusters(clusters: list[tuple[int, dict]]) -> list[tuple[int, dict]]:
    return sorted(clusters, key=cmp_to_key(compare_clusters))


def order_cells(cells: list[dict]) -> list[dict]:
    """Cells by line, then left: each cell, from the top, joins the first line whose mean top is near its own."""
    lines: list[list] = []  # [sum of tops, sum of heights, cells]
    for cell in sorted(cells, key=lambda c: c["bbox"]["t"]):
        t, tall = cell["bbox"]["t"], max(1.0, cell["bbox"]["b"] - cell["bbox"]["t"])
        for line in lines:
            n = len(line[2])
            if abs(t - line[0] / n) <= max(3.0, 0.6 * line[1] / n):
                line[0] += t
                line[1] += tall
                line[2].append(cell)
                break
        else:
            lines.append([t, tall, [cell]])
    # of cells with the same left side the one that came last is first
    return [c for line in lines for c in sorted(reversed(line[2]), key=lambda c: c["bbox"]["l"])]
