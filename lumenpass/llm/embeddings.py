"""Embedding near-dedup: spherical k-means cells, blocked cosine products, one representative for each group.

Equal vectors of a label are compared once and counted. A vector's home is the cell of its nearest centroid. Whatever
lies within the angle tau of a vector x of home c and has another home d lies on d's side of the plane between c and
d, so x must be within tau of that plane: x.(c - d) <= sin(tau) |c - d|. A vector is a guest in just those cells, and
every cell compares its home vectors with home vectors and guests. Each ordered pair is so met exactly once (in the
home of the second), none is lost, and the sample that the centroids are fitted on only decides the cost.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenpass.llm.common import components, roots_of, small_batches, written


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; scaled by their largest component first, so that no square over- or underflows."""
    x = x / np.abs(x).max(axis=1, initial=0.0)[:, None]
    return x / np.linalg.norm(x, axis=1)[:, None]


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 5) -> np.ndarray:
    """k unit centroids of unit vectors; a cell that runs empty takes the vector that fits its centroid worst."""
    r = np.random.default_rng(seed)
    c = x[r.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        best = x @ c.T
        own = best.argmax(axis=1)
        fit = best[np.arange(len(x)), own]
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        size = np.linalg.norm(total, axis=1)
        empty = np.flatnonzero(size < 1e-12)
        if len(empty):
            total[empty] = x[np.argsort(fit)[: len(empty)]]
            size = np.linalg.norm(total, axis=1)
        c = total / size[:, None]
    return c


def fit_cells(x: np.ndarray, k: int) -> np.ndarray:
    """k centroids or a few less; beyond 256 in two levels, so that the work grows with the root of k."""
    if k <= 256:
        return spherical_kmeans(x, k)
    top = spherical_kmeans(x, isqrt(k))
    own = np.concatenate([(x[a : a + 8192] @ top.T).argmax(axis=1) for a in range(0, len(x), 8192)])
    order = np.argsort(own, kind="stable")
    parts = np.split(order, np.searchsorted(own[order], np.arange(1, len(top))))
    return np.concatenate([spherical_kmeans(x[p], max(1, round(k * len(p) / len(x)))) for p in parts if len(p)])


def cells(x: np.ndarray, c: np.ndarray, cosine: float, block: int = 1 << 21) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, cell, is home) of unit vectors: the home cell and those where a partner may live."""
    sine = np.sqrt(1 - cosine * cosine) if cosine > 0 else 1.0
    out = []
    for a in range(0, len(x), step := max(1, block // len(c))):
        s = x[a : a + step] @ c.T
        at = np.arange(len(s))
        home = s.argmax(axis=1)
        gap = np.sqrt(np.maximum(0.0, 2 - 2 * np.clip(c[home] @ c.T, -1, 1)))
        near = s[at, home][:, None] - s <= sine * gap + 1e-9
        near[at, home] = True
        row, cell = np.nonzero(near)
        out.append((a + row, cell, home[row] == cell))
    return tuple(np.concatenate(p) for p in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))


def block_links(x: np.ndarray, ids: np.ndarray, is_query: np.ndarray, is_home: np.ndarray, weight: np.ndarray, cosine: float, tile: int = 1024) -> tuple[np.ndarray, np.ndarray]:
    """Weight of the linked home vectors of each query, and for each row the smallest row it is connected with."""
    q, h = np.flatnonzero(is_query), np.flatnonzero(is_home)
    total, root = np.zeros(len(x), np.int64), np.arange(len(x))
    edges = []
    for a in range(0, len(q), tile):
        left = q[a : a + tile]
        for b in range(0, len(h), tile):
            right = h[b : b + tile]
            i, j = np.nonzero((x[left] @ x[right].T >= cosine) & (ids[left][:, None] != ids[right][None, :]))
            if len(i):
                i, j = left[i], right[j]
                total += np.bincount(i, weight[j], len(x)).astype(np.int64)
                edges.append(roots_of(i, j))
    if edges:
        node, low = roots_of(np.concatenate([e[0] for e in edges]), np.concatenate([e[1] for e in edges]))
        root[node] = low
    return total, root


def near_duplicates(df: DataFrame, cosine: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", least_sample: int = 16384, cell_rows: int = 2048, block_rows: int = 2048) -> DataFrame:
    """(id, n_links, component_id, kept) for each row.

    Vectors of equal, non-null label and equal length link when their cosine in double precision reaches ``cosine``.
    Null, empty or zero vectors and those with null or non-finite components link with nothing. Repeated rows are
    further vectors. A row without an id links like any other but never names a component; its ``kept`` is false.
    An empty table gives an empty result; other columns are not read. ``cell_rows`` is the aimed size of a cell within
    the largest label; where that asks for more cells than the root of the label's size (beyond 4 M vectors) there are
    so many, and 8 vectors for each in the sample they are fitted on, so both grow with the label. A cell beyond
    ``block_rows`` (a hot label, a group of thousands) is cut into salted parts, compared pairwise in tasks of their own.
    """
    spark = df.sparkSession
    small_batches(spark)
    rows = df.select(F.col(id_col).cast("long").alias("__id"), F.col(vector_col).cast("array<double>").alias("__v"), F.col(label_col).cast("string").alias("__label"))
    bad = F.exists("__v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    sound = F.col("__label").isNotNull() & F.col("__v").isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.coalesce(F.exists("__v", lambda x: x != 0), F.lit(False))
    rows = written(rows.withColumn("__ok", F.coalesce(sound, F.lit(False))), "vectors")
    copies = written(rows.where("__ok").groupBy("__label", "__v").agg(F.count("*").alias("copies"), F.min("__id").alias("low")).withColumn("rep", F.monotonically_increasing_id()), "vector-groups")

    by_label = copies.groupBy(F.size("__v").alias("dim"), "__label").count()
    sizes = [tuple(r) for r in by_label.groupBy("dim").agg(F.max("count")).collect()]  # a row for each length
    single = df.schema[vector_col].dataType.elementType.typeName() == "float"
    kind = np.float32 if single else np.float64  # floats travel as such and are computed with as doubles
    centroids = {}
    for dim, n in sizes:
        k = max(1, min(n // cell_rows, max(2048, isqrt(n))))
        sample = copies.where(F.size("__v") == dim).orderBy(F.xxhash64("__v")).limit(max(least_sample, 8 * k)).select("__v").toArrow()
        x = unit(np.stack([v.values.to_numpy() for v in sample.column(0)]))
        centroids[dim] = fit_cells(x, min(k, max(1, len(x) // 8)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            label, vectors, weight, rep = b.column(0), b.column(1), b.column(2), b.column(3)
            length = np.diff(vectors.offsets.to_numpy())
            flat = vectors.flatten().to_numpy()
            starts = vectors.offsets.to_numpy() - vectors.offsets.to_numpy()[0]
            for dim in np.unique(length):
                of = np.flatnonzero(length == dim)
                x = flat[starts[of][:, None] + np.arange(dim)]
                row, cell, home = cells(unit(x), centroids[int(dim)], cosine)
                raw = [v.tobytes() for v in x.astype(kind)]
                at = pa.array(of[row])
                yield pa.RecordBatch.from_arrays(
                    [label.take(at), pa.array(np.full(len(row), dim), pa.int32()), pa.array(cell.astype("i4")), pa.array(home), rep.take(at), weight.take(at), pa.array([raw[i] for i in row], pa.binary())],
                    names=["label", "dim", "cell", "home", "rep", "weight", "x"],
                )

    placed = written(copies.select("__label", "__v", "copies", "rep").mapInArrow(place, "label string, dim int, cell int, home boolean, rep long, weight long, x binary"), "cells")
    key = ["label", "dim", "cell"]
    parts = placed.groupBy(*key).agg(F.ceil(F.count("*") / block_rows).cast("int").alias("parts"))
    salted = placed.join(parts, key).withColumn("salt", F.pmod(F.xxhash64("rep", F.lit(3)), F.col("parts")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    # task (q, h) compares the queries of part q with the homes of part h; a row is a query in its row, a home in its column
    as_query = salted.select("*", F.col("salt").alias("q"), every.alias("h"), F.lit(True).alias("query"))
    as_home = salted.where("home").select("*", every.alias("q"), F.col("salt").alias("h"), F.lit(False).alias("query"))
    tasks = as_query.unionByName(as_home).select(*key, "q", "h", "query", "rep", "weight", "x")

    def compare(table: pa.Table) -> pa.Table:
        x = np.frombuffer(b"".join(table["x"].to_pylist()), kind).reshape(table.num_rows, -1)
        x = unit(x.astype(np.float64))
        rep, query, weight = (table[c].to_numpy() for c in ("rep", "query", "weight"))
        # a representative may be here as query and as home: one node for both
        same, node = np.unique(rep, return_inverse=True)
        total, root = block_links(x, rep, query, ~query, weight, cosine)
        near, low = np.zeros(len(same), np.int64), np.arange(len(same))
        np.add.at(near, node, total)
        nodes, lows = roots_of(node, node[root])
        low[nodes] = lows
        # both ends of every link leave with the task's root, so that the tasks' trees together span all links
        linked = np.isin(low, low[low != np.arange(len(same))])
        return pa.table({"rep": same[linked], "near": near[linked], "root": same[low[linked]]})

    found = written(tasks.groupBy(*key, "q", "h").applyInArrow(compare, "rep long, near long, root long"), "vector-links")
    near = found.groupBy("rep").agg(F.sum("near").alias("near"))
    roots = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b"))).select(F.col("node").alias("rep"), "root")
    groups = copies.select("__label", "__v", "copies", "low", "rep").join(near, "rep", "left").join(roots, "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    lowest = groups.groupBy("root").agg(F.min("low").alias("component"))
    groups = groups.join(lowest, "root").select("__label", "__v", (F.col("copies") - 1 + F.coalesce("near", F.lit(0))).alias("links"), "component")
    linked = rows.where("__ok").join(groups, ["__label", "__v"]).select("__id", "links", "component")
    alone = rows.where("not __ok").select("__id", F.lit(0).cast("long").alias("links"), F.col("__id").alias("component"))
    return linked.unionByName(alone).select(F.col("__id").alias(id_col), F.col("links").alias("n_links"), F.col("component").alias("component_id"), F.coalesce(F.col("__id") == F.col("component"), F.lit(False)).alias("kept"))
