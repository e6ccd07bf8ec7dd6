"""Hits and sources as text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenpass.functions import text as T

NO_CONTEXT = "No selected PDF context was available."
NO_SOURCES = "No PDF sources are currently selected and ready."


def render_context(hits: DataFrame, max_chars: int, queries: DataFrame | None = None, key: str = "query_id") -> DataFrame:
    """(query_id, context) from hits with rank, source_display_name, index and text; queries without hits get a notice."""
    body = F.concat(F.lit("["), F.col("k").cast("string"), F.lit("] "), F.col("n"), F.lit(" chunk "), F.col("i").cast("string"), F.lit("\n"), F.col("t"))
    numbered = hits.select(key, F.col("rank").alias("k"), F.col("source_display_name").alias("n"), F.col("index").alias("i"), T.truncate("text", max_chars).alias("t")).select(key, "k", body.alias("b"))
    out = numbered.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "b"))), lambda x: x["b"]), "\n\n").alias("context"))
    if queries is None:
        return out
    return queries.select(key).join(out, key, "left").withColumn("context", F.coalesce("context", F.lit(NO_CONTEXT)))


def source_inventory(sources: DataFrame, order: str = "id") -> DataFrame:
    """One row: the enabled sources' names, numbered. What it says is as long as the list of sources."""
    listed = sources.where("enabled").agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("display_name").alias("n")))).alias("s"))
    lines = F.transform("s", lambda x, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), x["n"]))
    return listed.select(F.when(F.size("s") > 0, F.array_join(lines, "\n")).otherwise(NO_SOURCES).alias("inventory"))
