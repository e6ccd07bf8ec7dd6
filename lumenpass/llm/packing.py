"""Conflict-constrained best-fit packing of token sequences into bins.

Open bins are kept ordered by what room they have left. Each bin carries bitmaps of the sources and of the duplicate
clusters in it. A piece goes to the bin with the least room that holds it and doesn't conflict: the search starts at
the first bin with room enough and goes on to its successors until one is compatible; if none is, a bin is opened.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from lumenpass.llm.common import small_batches, written

def best_fit(pieces: list[tuple[int, object, object]], capacity: int, per_source: int = 2) -> list[int]:
    """The bin of each (tokens, source, cluster), longest first, none over ``capacity``.

    In a bin no cluster comes twice and no source more than ``per_source`` times; a null source or cluster never
    conflicts. Clusters and sources that come up too seldom in the list to conflict need no bit.
    """
    clusters = {c: 1 << k for k, c in enumerate(c for c, n in Counter(p[2] for p in pieces).items() if n > 1 and c is not None)}
    sources = {s: 1 << k for k, s in enumerate(s for s, n in Counter(p[1] for p in pieces).items() if n > per_source and s is not None)}
    order: list[tuple[int, int]] = []  # (room left, bin)
    held_clusters: list[int] = []
    held_sources: list[list[int]] = []  # bitmap of the sources there at least once, twice, ...
    out = [0] * len(pieces)
    for i in sorted(range(len(pieces)), key=lambda k: -pieces[k][0]):
        size, source, cluster = pieces[i]
        c, s = clusters.get(cluster, 0), sources.get(source, 0)
        at = bisect_left(order, (size, -1))
        while at < len(order):
            room, b = order[at]
            if not (held_clusters[b] & c or held_sources[b][-1] & s):
                del order[at]
                break
            at += 1
        else:
            room, b = capacity, len(held_clusters)
            held_clusters.append(0)
            held_sources.append([0] * per_source)
        out[i] = b
        held_clusters[b] |= c
        for k in range(per_source):
            if not held_sources[b][k] & s:
                held_sources[b][k] |= s
                break
        if room > size:
            insort(order, (room - size, b))
    return out


#: Equal rows are counted, and dealt out again in runs of so many.
RUN = 4096


def numbered(rows: DataFrame, name: str) -> DataFrame:
    """The rows, equal ones numbered from 0: a function of the rows alone, however they are partitioned.

    Equal rows are counted with a partial aggregation, so that any number of them is no task's burden.
    """
    counted = rows.groupBy(*rows.columns).agg(F.count("*").alias(name))
    runs = F.explode(F.sequence(F.lit(0), F.floor((F.col(name) - 1) / RUN)))
    cut = counted.withColumn(f"{name}_run", runs)
    of_run = F.sequence(F.lit(0), F.least(F.lit(RUN), F.col(name) - F.col(f"{name}_run") * RUN).cast("int") - 1)
    return cut.withColumn(f"{name}_in", F.explode(of_run)).select(*rows.columns, (F.col(f"{name}_run") * RUN + F.col(f"{name}_in")).alias(name))


def pack(lengths: DataFrame, capacity: int = 4096, per_source: int = 2, shard_rows: int = 8192, id_col: str = "doc_id") -> DataFrame:
    """Bins of ``lengths`` (id, n_tokens, source, cluster): a row for each piece, with its bin and the bin's fill.

    A sequence over ``capacity`` is cut into full pieces, each a bin of its own, and a rest that is packed; one without
    tokens (or with a null count) gives one empty piece, so every row of the input appears, under its id of whatever
    type. Rows are dealt to shards of about ``shard_rows`` by the hash of the id and of their number among equal rows,
    which also spreads hot sources, clusters and ids; each shard is packed by itself, in an order of its rows' values,
    so the bins depend on the rows alone. Only a shard's last bins stay unfilled. Nulls in source or cluster never
    conflict; repeated rows are packed each; an empty table gives no rows; other columns are not read.
    """
    spark = lengths.sparkSession
    small_batches(spark)
    kind = lengths.schema[id_col].dataType
    slim = written(lengths.select(F.col(id_col).alias("id"), F.coalesce(F.col("n_tokens").cast("long"), F.lit(0)).alias("n"), F.col("source").cast("string").alias("source"), F.col("cluster").cast("long").alias("cluster")), "lengths")
    shards = max(1, -(-slim.count() // shard_rows))
    dealt = numbered(slim, "nth").withColumn("shard", F.pmod(F.xxhash64("id", "nth", F.lit(11)), F.lit(shards)))
    out = StructType([StructField("bin_id", StringType()), StructField(id_col, kind), StructField("piece", IntegerType()), StructField("start", LongType()), StructField("n_tokens", LongType()), StructField("source", StringType()), StructField("bin_tokens", LongType())])
    target = to_arrow_schema(out)

    def run(key: tuple, table: pa.Table) -> pa.Table:
        shard = key[0].as_py()
        order = sorted(zip(*[table[c].to_pylist() for c in ("id", "n", "source", "cluster")]), key=lambda r: [(x is not None, x) if x is not None else (False,) for x in r])
        pieces = [(d, k, k * capacity, min(capacity, n - k * capacity), s, c) for d, n, s, c in order for k in range(max(1, -(-n // capacity)))]
        # full pieces are alone in their bins, so only the rest is searched for
        rest = [p for p in pieces if p[3] < capacity]
        bins = best_fit([(p[3], p[4], p[5]) for p in rest], capacity, per_source)
        used = Counter()
        for p, b in zip(rest, bins):
            used[b] += p[3]
        rows = [(f"{shard}-{b}", *p[:5], used[b]) for p, b in zip(rest, bins)]
        full = [p for p in pieces if p[3] == capacity]
        rows += [(f"{shard}-f{k}", *p[:5], capacity) for k, p in enumerate(full)]
        return pa.table([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(target)], schema=target)

    return dealt.groupBy("shard").applyInArrow(run, out)


def measured(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", fold: bool = True) -> DataFrame:
    """(id, n_tokens, source, cluster) of whole texts, in one pass: token count and the hash of the case-folded text.

    A null text counts as empty, and empty texts are one cluster. The id keeps its type; a table without a source
    column has null sources; other columns are not read; repeated rows each give a row, an empty table none.
    """
    from lumenpass.llm.token_counts import piece_counter

    small_batches(df.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    source = F.col(source_col) if source_col in df.columns else F.lit(None)
    slim = df.select(F.col(id_col).alias(id_col), text.alias("__text"), source.cast("string").alias("source"), F.xxhash64(F.lower(text) if fold else text).alias("cluster"))
    out = StructType([slim.schema[id_col], StructField("n_tokens", LongType()), StructField("source", StringType()), StructField("cluster", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = piece_counter(path)
        for b in batches:
            n = counter.count(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), b.column(2), b.column(3)], names=[id_col, "n_tokens", "source", "cluster"])

    return slim.mapInArrow(run, out)


def pack_documents(df: DataFrame, path: str, capacity: int = 4096, per_source: int = 2, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Pack whole documents by their token counts; copies (texts equal but for case) never share a bin.

    What becomes of nulls, empty and very long texts, repeated rows and empty tables is said by ``measured`` and ``pack``.
    """
    return pack(measured(df, path, id_col, text_col, source_col), capacity, per_source, id_col=id_col)
