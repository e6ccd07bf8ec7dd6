"""Keyword enrichment of passages."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenpass import schemas as S
from lumenpass.functions import text as T
from lumenpass.options import CONTEXT_KEYWORD_LIMIT, KeywordOptions


def generate(passages: DataFrame, options: KeywordOptions) -> DataFrame:
    """(source_id, passage_index, keywords) from the user's generator, called with ``batch_size`` passages at a time."""
    o = options.sane()

    kinds = [pa.string(), pa.int32(), pa.list_(pa.string())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = b.to_pylist()
            for a in range(0, len(rows), o.batch_size):
                got = list(o.generator(rows[a : a + o.batch_size]))
                yield pa.RecordBatch.from_arrays([pa.array([g[k] for g in got], t) for k, t in enumerate(kinds)], names=["source_id", "passage_index", "keywords"])

    return passages.mapInArrow(run, S.KEYWORD_RESULTS)


def apply_results(passages: DataFrame, results: DataFrame, options: KeywordOptions) -> DataFrame:
    """Generated keywords joined to their passages and merged; passages without any are cleaned all the same."""
    o = options.sane()
    gathered = results.withColumn("__o", F.monotonically_increasing_id()).groupBy("source_id", F.col("passage_index").alias("index"))
    generated = gathered.agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("__o", "keywords"))), lambda x: x["keywords"])).alias("__g"))
    joined = passages.join(generated, ["source_id", "index"], "left")
    merged = F.when(F.col("__g").isNotNull(), T.merge_keywords("keywords", "__g", o.max_keywords, o.replace_existing)).otherwise(T.clean_keywords("keywords", o.max_keywords))
    return joined.withColumn("keywords", merged).select(*passages.columns)


def elaborate(passages: DataFrame, options: KeywordOptions = KeywordOptions()) -> DataFrame:
    """Passages with generated keywords; without a generator they come back untouched."""
    if options.generator is None:
        return passages
    return apply_results(passages, generate(passages, options), options)


def add_context(passages: DataFrame) -> DataFrame:
    """Keywords extended by those of the passage's own context."""
    return passages.withColumn("keywords", T.clean_keywords(F.concat(F.col("keywords"), T.deterministic_keywords()), CONTEXT_KEYWORD_LIMIT))
