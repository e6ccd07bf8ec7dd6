"""Shared pieces of the training-data operators: bounded batches, one pass over texts, connected components."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from lumenpass.sources.documents import spread
from lumenpass.sources.work import small_batches, work_path, written

__all__ = ["components", "documents", "fresh", "local_path", "per_text", "roots_of", "small_batches", "work_path", "written"]


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents; fewer files than cores are spread over the cores (see ``spread``)."""
    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id")


def per_text(df: DataFrame, id_col: str, text_col: str, schema: str, make: Callable[[], Callable]) -> DataFrame:
    """One output row per input row, without a shuffle.

    ``make()`` runs once in each task and returns a function of (list of texts, nulls as "") that gives the output
    columns after the id, in the order of ``schema``, as lists or Arrow arrays.
    """
    small_batches(df.sparkSession)
    slim = df.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    kind = slim.schema["__id"].dataType.simpleString()
    full = f"{id_col} {kind}, {schema}"
    target = to_arrow_schema(StructType.fromDDL(full))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = None
        for batch in batches:
            if not batch.num_rows:
                continue
            work = work or make()
            texts = [t or "" for t in batch.column(1).to_pylist()]
            columns = [batch.column(0), *work(texts)]
            arrays = [(c if isinstance(c, pa.Array) else pa.array(c, type=f.type)).cast(f.type) for c, f in zip(columns, target)]
            yield pa.RecordBatch.from_arrays(arrays, names=target.names)

    return slim.mapInArrow(run, full)


def roots_of(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and the smallest node that each reaches, from the edges (a, b)."""
    nodes, inverse = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = inverse[: len(a)], inverse[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        before = root.copy()
        np.minimum.at(root, root[x], low)
        np.minimum.at(root, root[y], low)
        while True:
            jumped = root[root]
            if np.array_equal(jumped, root):
                break
            root = jumped
        if np.array_equal(before, root):
            return nodes, nodes[root]


def _one_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    got = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
    if got:
        nodes, roots = roots_of(np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got]))
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(roots)], names=["node", "root"])


def components(edges: DataFrame, one_task_edges: int = 1_000_000) -> DataFrame:
    """(node, root): the smallest node reachable from each node of ``edges`` (columns a, b, longs).

    Up to ``one_task_edges`` distinct edges (16 MB) are solved by union-find in one task. Beyond that, large-star and
    small-star rounds of joins and aggregates run until no edge changes; every round is written to the shared folder.
    Both give the same result. Rows with a null end are ignored; a self-loop only makes its node appear.
    """
    edges = written(edges.where("a is not null and b is not null").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    if edges.count() <= one_task_edges:
        return edges.coalesce(1).mapInArrow(_one_task, "node long, root long")
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    now, mark = edges.where("a <> b"), None
    while True:
        both = now.union(now.select(F.col("b"), F.col("a")))
        low = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        now = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = now.groupBy("a").agg(F.min("b").alias("m"))
        hung = now.join(low, "a")
        now = hung.select("a", F.col("m").alias("b")).union(hung.select(F.col("b").alias("a"), F.col("m").alias("b"))).where("a <> b").distinct()
        now = written(now, "stars")
        new = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if new == mark:
            return nodes.join(now.groupBy("a").agg(F.min("b").alias("root")).withColumnRenamed("a", "node"), "node", "left").select("node", F.coalesce("root", "node").alias("root"))
        mark = new


def local_path(folder: str) -> tuple[object, str]:
    """(pyarrow file system, path in it) of a folder of the shared store."""
    from pyarrow import fs

    if "://" not in folder:
        folder = "file://" + os.path.abspath(folder)
    elif folder.startswith("file:/") and not folder.startswith("file://"):
        folder = "file://" + folder[5:]
    return fs.FileSystem.from_uri(folder)


