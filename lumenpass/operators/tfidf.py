"""Field-weighted TF-IDF: index tables and scoring. Not BM25: the score carries the squared idf."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from lumenpass.functions import text as T
from lumenpass.options import TfidfOptions
from lumenpass.sources.work import small_batches


def _starts(items: Column, same) -> Column:
    """Positions (from 1) in a sorted array where a run of items that are the ``same`` begins."""
    at = F.when(F.size(items) > 0, F.sequence(F.lit(1), F.size(items))).otherwise(F.array().cast("array<int>"))
    return F.filter(at, lambda i: (i == 1) | ~same(F.get(items, i - 1), F.get(items, i - 2)))


def term_counts(tokens: Column) -> Column:
    """array<struct<term, n>> of an array of terms: sorted, and runs counted, within the row."""

    def runs(s: Column) -> Column:
        return T.let(_starts(s, lambda a, b: a == b), lambda p: F.transform(p, lambda i, k: F.struct(F.get(s, i - 1).alias("term"), (F.coalesce(F.get(p, k + 1), F.size(s) + 1) - i).alias("n"))))

    return T.let(F.sort_array(tokens), runs)


def _counted(b: pa.RecordBatch, at: int, weight: float) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """(row, term, tf) of a column of terms: terms as numbers, and pairs of row and number counted."""
    column = b.column(at)
    rows = pc.list_parent_indices(column).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = column.flatten().dictionary_encode()
    width = max(1, len(coded.dictionary))
    pairs, n = np.unique(rows * width + coded.indices.to_numpy(zero_copy_only=False), return_counts=True)
    row, code = np.divmod(pairs, width)
    return row, coded.dictionary.take(pa.array(code)), weight * n / np.bincount(rows, minlength=b.num_rows)[row]


def postings(passages: DataFrame, options: TfidfOptions = TfidfOptions(), key: str = "ordinal") -> DataFrame:
    """(ordinal, term, tf): weighted relative frequencies over raw text and keywords; a field of weight 0 has none.

    All terms of a passage are in its row, so they are counted there: no shuffle.
    """
    o = options.sane()
    fields = []
    if o.text_weight > 0:
        fields.append((F.col("text"), o.text_weight))
    if o.keyword_weight > 0 and "keywords" in passages.columns:
        fields.append((F.array_join("keywords", " "), o.keyword_weight))
    if not fields:
        return passages.select(key, F.lit("").alias("term"), F.lit(0.0).alias("tf")).limit(0)
    weights = [w for _, w in fields]
    schema = StructType([passages.schema[key], *StructType.fromDDL("term string, tf double")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [_counted(b, k, w) for k, w in enumerate(weights, 1)]
            if len(found) == 1:
                row, term, tf = found[0]
            else:  # the terms of both fields: those of one row and term become their sum
                coded = pa.concat_arrays([f[1] for f in found]).dictionary_encode()
                width = max(1, len(coded.dictionary))
                pairs, own = np.unique(np.concatenate([f[0] for f in found]) * width + coded.indices.to_numpy(zero_copy_only=False), return_inverse=True)
                row, code = np.divmod(pairs, width)
                term, tf = coded.dictionary.take(pa.array(code)), np.bincount(own, np.concatenate([f[2] for f in found]), len(pairs))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), term, pa.array(tf)], names=schema.names)

    small_batches(passages.sparkSession)
    return passages.select(key, *[T.term_matches(c).alias(f"__{k}") for k, (c, _) in enumerate(fields)]).mapInArrow(run, schema)


def idf(passage_count: Column, df: Column) -> Column:
    return F.log((1 + passage_count) / (1 + df)) + 1


def terms(postings_df: DataFrame, passage_count: int) -> DataFrame:
    """(term, df, idf)."""
    counted = postings_df.groupBy("term").agg(F.count("*").alias("df"))
    return counted.withColumn("idf", idf(F.lit(float(passage_count)), F.col("df")))


def meta(passages: DataFrame, options: TfidfOptions = TfidfOptions()) -> DataFrame:
    """One row: passage_count and the mean weighted length."""
    o = options.sane()
    length = F.size(T.term_matches("text")) * o.text_weight
    if "keywords" in passages.columns:
        length = length + F.size(T.term_matches(F.array_join("keywords", " "))) * o.keyword_weight
    return passages.agg(F.count("*").alias("passage_count"), F.coalesce(F.avg(length), F.lit(0.0)).alias("avg_len"))


def query_weights(queries: DataFrame, key: str = "query_id", text: str = "query", search_terms: str | None = None) -> DataFrame:
    """(query_id, term, qf): relative frequencies over the query and its search terms together."""
    values = F.array(F.col(text)) if search_terms is None else F.concat(F.array(F.col(text)), F.coalesce(F.col(search_terms), F.array().cast("array<string>")))
    tokens = queries.select(key, T.term_frequencies_of(values).alias("tokens"))
    exploded = tokens.select(key, F.size("tokens").alias("n"), F.explode("tokens").alias("term"))
    return exploded.groupBy(key, "term").agg((F.count("*") / F.first("n")).alias("qf"))


#: Pairs of a passage and a query that are scored at once, and queries that are scored in one pass over the postings.
PAIRS, BLOCK_QUERIES = 1 << 20, 1 << 12


@dataclass
class _Asked:
    """Weights of a block of queries: those of term t are ``begin[t]`` to ``begin[t + 1]``."""

    ids: pa.Array
    terms: pa.Array
    begin: np.ndarray
    query: np.ndarray
    weight: np.ndarray


def _asked(weighted: pa.Table, key: str, kind: pa.DataType, room: int) -> list[_Asked]:
    """Weights (key, term, w) in blocks of queries."""
    coded = weighted.column(key).combine_chunks().cast(kind).dictionary_encode()
    number, out = coded.indices.to_numpy(zero_copy_only=False), []
    for a in range(0, len(coded.dictionary), room):
        own = np.flatnonzero((number >= a) & (number < a + room))
        terms = weighted.column("term").take(pa.array(own)).combine_chunks().dictionary_encode()
        code = terms.indices.to_numpy(zero_copy_only=False)
        order = np.lexsort((number[own], code))
        begin = np.append(0, np.cumsum(np.bincount(code, minlength=len(terms.dictionary))))
        out.append(_Asked(coded.dictionary[a : a + room], terms.dictionary, begin, number[own][order] - a, weighted.column("w").to_numpy()[own][order]))
    return out


def _whole_passages(batches: Iterator[pa.RecordBatch], terms: pa.Array, room: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ordinal, term as number, tf) of the postings whose terms are asked for, some ``room`` at once, passages uncut."""
    held, n = [], 0
    for b in batches:
        code = pc.index_in(b.column(1), value_set=terms)
        own = np.flatnonzero(code.is_valid().to_numpy(zero_copy_only=False))
        if not len(own):
            continue
        held.append((b.column(0).to_numpy(zero_copy_only=False)[own], code.fill_null(0).to_numpy(zero_copy_only=False)[own], b.column(2).to_numpy(zero_copy_only=False)[own]))
        n += len(own)
        if n >= room:
            got = tuple(np.concatenate(x) for x in zip(*held))
            cut = int(np.flatnonzero(got[0] != got[0][-1])[-1]) + 1 if (got[0] != got[0][-1]).any() else 0
            if cut:
                yield tuple(x[:cut] for x in got)
            held, n = [tuple(x[cut:] for x in got)], 0  # what is left is one passage, which may go on
    if held:
        yield tuple(np.concatenate(x) for x in zip(*held))


def _scored(got: tuple[np.ndarray, np.ndarray, np.ndarray], asked: _Asked) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ordinals, scores by passage and query) of whole passages, some ``PAIRS`` at once."""
    ordinals, code, tf = got
    starts = np.flatnonzero(np.append(True, ordinals[1:] != ordinals[:-1]))
    row, count = np.cumsum(np.append(False, ordinals[1:] != ordinals[:-1])), asked.begin[code + 1] - asked.begin[code]
    before = np.append(0, np.cumsum(count))
    ends, width = np.append(starts[1:], len(ordinals)), len(asked.ids)
    a = 0
    while a < len(starts):
        z = min(a + max(1, PAIRS // width), max(a + 1, int(np.searchsorted(before[ends], before[starts[a]] + PAIRS, "right"))))
        own = slice(starts[a], ends[z - 1])
        each = np.repeat(np.arange(own.stop - own.start), count[own])
        at = np.arange(len(each)) + (asked.begin[code[own]] - (before[own] - before[own.start]))[each]
        place = (row[own] - a)[each] * width + asked.query[at]
        yield ordinals[starts[a:z]], np.bincount(place, tf[own][each] * asked.weight[at], (z - a) * width).reshape(z - a, width)
        a = z


def _kept(held: list[tuple], least: np.ndarray, limit: int, slack: float) -> tuple:
    """(query, ordinal, score) of all that is held, cut to what can be among the best ``limit`` of each query; raises
    ``least`` in place. Of equal scores only the first ordinals can."""
    k, ordinals, score = (np.concatenate(x) for x in zip(*held))
    order = np.lexsort((ordinals, -score, k))
    k, ordinals, score = k[order], ordinals[order], score[order]
    starts = np.searchsorted(k, np.arange(len(least) + 1))
    full = np.flatnonzero(np.diff(starts) >= limit)
    least[full] = np.maximum(least[full], score[starts[full] + limit - 1])
    new = np.append(True, (k[1:] != k[:-1]) | (score[1:] != score[:-1]))[: len(k)]
    place = np.arange(len(k)) - np.flatnonzero(new)[np.cumsum(new) - 1] if len(k) else k
    keep = (score >= least[k] - slack) & (place < limit)
    return k[keep], ordinals[keep], score[keep]


def scores(postings_df: DataFrame, terms_df: DataFrame, weights: DataFrame, key: str = "query_id", ordinal: str = "ordinal", limit: int = 0, digits: int | None = None, by_passage: bool = False) -> DataFrame:
    """(query_id, ordinal, lexical): sum of tf * idf * qf * idf; only scores above 0, at least the best ``limit`` of each query.

    The driver holds the weights of the stated queries once. A passage is scored where its postings lie: pairs of a
    query and a passage are neither shuffled nor gathered, whatever the terms' frequencies, and with a ``limit`` a task
    gives only those that can be among the best, ties after rounding to ``digits`` included. ``by_passage`` says that a
    passage's postings are consecutive rows of one partition, as ``postings`` makes them; others are brought together.
    """
    weighted = terms_df.join(weights, "term").select(key, "term", (F.col("qf") * F.col("idf") * F.col("idf")).alias("w"))
    kind, slack = weights.schema[key], 0.0 if digits is None else 2 * 10.0**-digits
    schema = StructType([kind, postings_df.schema[ordinal], *StructType.fromDDL("lexical double")])
    blocks = _asked(weighted.toArrow(), key, to_arrow_type(kind.dataType), BLOCK_QUERIES)
    if not blocks:
        return postings_df.sparkSession.createDataFrame([], schema)

    def run(batches: Iterator[pa.RecordBatch], asked: _Asked) -> Iterator[pa.RecordBatch]:
        row = lambda k, ordinals, score: pa.RecordBatch.from_arrays([asked.ids.take(pa.array(k)), pa.array(ordinals), pa.array(score)], names=schema.names)
        least, held, n = np.zeros(len(asked.ids)), [], 0
        for got in _whole_passages(batches, asked.terms):
            for ordinals, score in _scored(got, asked):
                at, k = np.nonzero((score > 0) & (score >= least - slack))
                if limit <= 0:
                    yield row(k, ordinals[at], score[at, k])
                    continue
                held.append((k, ordinals[at], score[at, k]))
                n += len(k)
                if n > PAIRS:
                    held, n = [_kept(held, least, limit, slack)], 0
        if held:
            k, ordinals, score = _kept(held, least, limit, slack)
            for a in range(0, len(k), PAIRS):
                yield row(k[a : a + PAIRS], ordinals[a : a + PAIRS], score[a : a + PAIRS])

    def asked_for(batches: Iterator[pa.RecordBatch], terms: pa.Array) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pc.is_in(b.column(1), value_set=terms))

    small_batches(postings_df.sparkSession)
    slim, out = postings_df.select(ordinal, "term", "tf"), []
    for b in blocks:
        own = slim if by_passage else slim.mapInArrow(partial(asked_for, terms=b.terms), slim.schema).repartition(ordinal).sortWithinPartitions(ordinal)
        out.append(own.mapInArrow(partial(run, asked=b), schema))
    return reduce(DataFrame.unionByName, out)


def top_candidates(scored: DataFrame, limit: int = 128, key: str = "query_id", ordinal: str = "ordinal", digits: int | None = None) -> DataFrame:
    """The best ``limit`` passages of each query by score, then ordinal; a limit of 0 or less keeps all."""
    from pyspark.sql import Window

    by = F.round("lexical", digits) if digits is not None else F.col("lexical")
    ranked = scored.withColumn("cand_pos", F.row_number().over(Window.partitionBy(key).orderBy(by.desc(), F.col(ordinal))))
    return ranked.where(F.col("cand_pos") <= limit) if limit > 0 else ranked
