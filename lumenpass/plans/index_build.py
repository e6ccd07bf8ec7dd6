"""Index builds: passages, keywords, vectors, postings."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import is_dataclass, replace
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenpass.functions import text as T
from lumenpass.operators import chunking, keywords, tfidf
from lumenpass.operators.search import Index
from lumenpass.options import ChunkOptions, IndexingOptions, KeywordOptions, TfidfOptions
from lumenpass.sources.work import written


def with_ordinals(passages: DataFrame, order: tuple[str, ...] = ("source_id", "index"), store: Callable[[DataFrame, str], DataFrame] = written) -> DataFrame:
    """Passages numbered from 0 without gaps in the given order; equal keys are ordered by the hash of the whole row.

    Rows are range-partitioned, sorted and written once with their place in their partition; the partitions' sizes, one
    number each, are taken from what was written, summed up and joined back, so no task sees all rows and both uses see
    the same partitions.
    """
    plain = [c for c in passages.columns if not passages.schema[c].dataType.simpleString().startswith("map")]
    keyed = passages.withColumn("__h", F.xxhash64(*plain))
    ranged = keyed.repartitionByRange(*order, "__h").sortWithinPartitions(*order, "__h")
    # the partition in the upper bits, the row's number in it in the lower 33
    placed = store(ranged.withColumn("__at", F.monotonically_increasing_id()), "ranged").withColumn("__p", F.shiftright("__at", 33))
    sizes = placed.groupBy("__p").agg(F.count("*").alias("n"))
    before = sizes.select("__p", (F.sum("n").over(Window.orderBy("__p")) - F.col("n")).alias("__before"))  # a row for each partition
    ordinal = F.col("__before") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.join(F.broadcast(before), "__p").withColumn("ordinal", ordinal.cast("long")).drop("__p", "__at", "__h", "__before")


class Cancelled(Exception):
    """The caller asked to stop."""


@contextmanager
def watched(spark: SparkSession, cancelled: Callable[[], bool] | None, tasks: Callable[[int, int], None] | None, every: float = 0.5) -> Iterator[None]:
    """Jobs started inside end when ``cancelled`` says so (with ``Cancelled``); ``tasks`` is told (done, all) of them."""
    if cancelled is None and tasks is None:
        yield
        return
    group, ended, asked = f"lumenpass-{uuid.uuid4().hex}", threading.Event(), threading.Event()
    context = spark.sparkContext

    def look() -> None:
        tracker = context.statusTracker()
        while not ended.wait(every):
            if cancelled and cancelled():
                asked.set()
                context.cancelJobGroup(group)
            elif tasks:
                stages = {s for j in tracker.getJobIdsForGroup(group) if (job := tracker.getJobInfo(j)) for s in job.stageIds}
                known = [i for s in stages if (i := tracker.getStageInfo(s))]
                tasks(sum(i.numCompletedTasks for i in known), sum(i.numTasks for i in known))

    before = context.getLocalProperty("spark.jobGroup.id"), context.getLocalProperty("spark.job.description")
    context.setJobGroup(group, "index build", interruptOnCancel=True)
    watcher = threading.Thread(target=look, daemon=True)
    watcher.start()
    try:
        yield
    except Exception as e:
        if asked.is_set():
            raise Cancelled from e
        raise
    finally:
        ended.set()
        watcher.join()
        context.setLocalProperty("spark.jobGroup.id", before[0])
        context.setLocalProperty("spark.job.description", before[1])


def from_passages(
    passages: DataFrame,
    encoder,
    tfidf_options: TfidfOptions = TfidfOptions(),
    keyword_options: KeywordOptions = KeywordOptions(),
    chunk_options: ChunkOptions = ChunkOptions(),
    embedding_dim: int = 64,
    store: Callable[[DataFrame, str], DataFrame] = written,
    indexing: IndexingOptions | None = None,
    progress: Callable[[int, int, str], None] | None = None,
    cancelled: Callable[[], bool] | None = None,
    tasks: Callable[[int, int], None] | None = None,
) -> Index:
    """Keywords, context keywords, ordinals, vectors of the contextual text, TF-IDF tables.

    ``store`` writes a table under a name and reads it, so that tables used twice aren't computed twice; the default
    writes to the shared folder. ``progress`` is told (stages done, stages, name), ``tasks`` (tasks done, tasks) all the
    while; ``cancelled`` is asked all the while too, and ends running jobs. ``indexing``, if given, says how many texts
    an encoder takes at once (if it has a ``batch_size``) and how many encoding tasks there are; without it there is one
    for each partition of the passages.
    """
    stages = ("keywords", "passages", "vectors", "postings", "terms")

    def step(done: int) -> None:
        if cancelled and cancelled():
            raise Cancelled
        if progress:
            progress(done, len(stages), stages[min(done, len(stages) - 1)])

    with watched(passages.sparkSession, cancelled, tasks):
        step(0)
        enriched = keywords.add_context(keywords.elaborate(passages, keyword_options))
        step(1)
        context = enriched.withColumn("context", T.contextual_text())
        # the ordinals are a join with one row for each partition: cheaper than writing the texts once more
        table = with_ordinals(context.withColumn("terms", T.terms("context")), store=store)
        step(2)
        texts = table
        if indexing:
            o = indexing.sane()
            texts = table.repartition(o.parallelism)
            if is_dataclass(encoder) and hasattr(encoder, "batch_size"):
                encoder = replace(encoder, batch_size=o.batch_size)
        vectors = store(encoder.encode_documents(texts), "vectors")
        step(3)
        posted = store(tfidf.postings(table, tfidf_options), "postings")
        step(4)
        count, average = tfidf.meta(table, tfidf_options).first()
        found = store(tfidf.terms(posted, count), "terms")
    step(5)
    return Index(table, vectors, posted, found, count, average, embedding_dim, chunk_options, tfidf_options, datetime.now(UTC).isoformat())


def from_sources(sources: DataFrame, encoder, chunk_options: ChunkOptions = ChunkOptions(), **rest) -> Index:
    """An index of the enabled sources' texts."""
    return from_passages(chunking.split_passages(sources, chunk_options), encoder, chunk_options=chunk_options, **rest)


def from_prechunked(sources: DataFrame, encoder, **rest) -> Index:
    return from_passages(chunking.passages_from_chunks(sources), encoder, **rest)
