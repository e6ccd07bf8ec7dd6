"""Chunkers: sources, blocks and sections to passages."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from lumenpass import schemas as S
from lumenpass.functions import plain
from lumenpass.functions import text as T
from lumenpass.options import ChunkOptions


def _none(kind: str) -> Column:
    return F.array().cast(f"array<{kind}>")


def chunk_text(text: Column | str, options: ChunkOptions = ChunkOptions()) -> Column:
    """array<struct<index, text>> of sliding windows over the normalized text.

    Windows shorter than ``min_chars`` are left out but keep their number, so numbers may have gaps; a tail inside the
    window before is still given.
    """
    size = max(1, options.max_chars)
    step = max(1, size - min(max(0, options.overlap_chars), size - 1))

    def windows(t: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.floor((F.length(t) - 1) / step).cast("int"))
        pieces = F.transform(numbers, lambda k: F.struct(k.alias("index"), F.trim(F.substring(t, k * step + 1, F.lit(size))).alias("text")))
        return F.when(F.length(t) > 0, F.filter(pieces, lambda p: F.length(p["text"]) >= options.min_chars)).otherwise(_none("struct<index:int,text:string>"))

    return T.let(T.normalize_whitespace(text), windows)


def enforce_bounds(chunk: Column | str, options: ChunkOptions = ChunkOptions()) -> Column:
    """[chunk], or its windows if it is longer than ``max_chars``."""
    c = F.col(chunk) if isinstance(chunk, str) else chunk
    return F.when(F.length(c) > max(1, options.max_chars), F.transform(chunk_text(c, options), lambda p: p["text"])).otherwise(F.array(c))


def _passage(source: dict[str, str], index: Column, text: Column, path: Column | None = None, role: Column | None = None) -> list[Column]:
    return [
        F.col(source["id"]).alias("source_id"), F.col(source["display_name"]).alias("source_display_name"), F.col(source["location"]).alias("source_location"),
        index.cast("int").alias("index"), text.alias("text"), (_none("string") if path is None else path).alias("section_path"),
        (F.lit("unknown") if role is None else role).alias("content_role"), _none("int").alias("page_numbers"),
        _none("string").alias("layout_labels"), _none("string").alias("captions"), _none("string").alias("keywords"),
    ]


SOURCE = {"id": "id", "display_name": "display_name", "location": "location"}


def split_passages(sources: DataFrame, options: ChunkOptions = ChunkOptions()) -> DataFrame:
    """Passages of the enabled sources' texts; no shuffle."""
    enabled = sources.where("enabled").withColumn("__p", F.explode(chunk_text("text", options)))
    return enabled.select(*_passage(SOURCE, F.col("__p.index"), F.col("__p.text")))


def passages_from_chunks(sources: DataFrame) -> DataFrame:
    """One passage for each chunk supplied, as it is; ``enabled`` isn't looked at here."""
    return sources.select("*", F.posexplode("chunks").alias("__k", "__t")).select(*_passage(SOURCE, F.col("__k"), F.col("__t")))


def chunk_blocks(blocks: Column | str, options: ChunkOptions = ChunkOptions()) -> Column:
    """Texts of greedily packed blocks (an array of texts); a sequential fold, so it runs in an Arrow worker."""
    size, overlap = options.max_chars, options.overlap_chars
    return F.udf(lambda b: plain.chunk_blocks(list(b if b is not None else []), size, overlap), "array<string>", useArrow=True)(blocks)


def split_sections(blocks: DataFrame, doc_col: str = "doc_id", order_col: str = "block_no", text_col: str = "text") -> DataFrame:
    """(doc, section_no, heading, blocks) from a table of blocks: a running count of likely headings numbers sections."""
    from pyspark.sql import Window

    marked = blocks.withColumn("__h", T.is_likely_heading(text_col))
    running = Window.partitionBy(doc_col).orderBy(order_col).rowsBetween(Window.unboundedPreceding, 0)
    numbered = marked.withColumn("section_no", F.sum(F.col("__h").cast("int")).over(running))
    grouped = numbered.groupBy(doc_col, "section_no").agg(
        F.max(F.when(F.col("__h"), T.strip_numbering(text_col))).alias("heading"),
        F.array_sort(F.collect_list(F.when(~F.col("__h"), F.struct(F.col(order_col).alias("k"), F.col(text_col).alias("t"))))).alias("__b"),
    )
    return grouped.where(F.size("__b") > 0).select(doc_col, "section_no", "heading", F.transform("__b", lambda b: b["t"]).alias("blocks"))


_CHUNKS = "array<struct<section_path:array<string>,content_role:string,text:string>>"


def section_chunks(sections: Column | str, options: ChunkOptions = ChunkOptions()) -> Column:
    """Chunks (section path, role, text) of an array of struct<heading, blocks>."""
    o = (options.max_chars, options.overlap_chars, options.min_chars)
    return F.udf(lambda s: plain.section_chunks([(x["heading"], list(x["blocks"])) for x in (s if s is not None else [])], *o), _CHUNKS, useArrow=True)(sections)


def block_chunks(blocks: Column | str, options: ChunkOptions = ChunkOptions()) -> Column:
    """Chunks of an array of blocks that may hold headings."""
    o = (options.max_chars, options.overlap_chars, options.min_chars)
    return F.udf(lambda b: plain.section_chunks(plain.split_sections(list(b if b is not None else [])), *o), _CHUNKS, useArrow=True)(blocks)


def folded(df: DataFrame, column: str, chunks: Callable[[list], list[tuple]]) -> DataFrame:
    """Passages of sources whose ``column`` a fold turns into chunks (path, role, text): one pass over Arrow batches."""
    slim = df.select("id", "display_name", "location", F.col(column).alias("held"))
    kinds = [slim.schema[c].dataType.simpleString() for c in ("id", "display_name", "location")]
    rest = S.PASSAGES.split("`index`")[1]
    schema = StructType.fromDDL(f"source_id {kinds[0]}, source_display_name {kinds[1]}, source_location {kinds[2]}, `index`{rest}")
    target = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [chunks(x) if x is not None else [] for x in b.column("held").to_pylist()]
            at = pa.array([k for k, f in enumerate(found) for _ in f], pa.int64())
            flat = [c for f in found for c in f]
            own = {"index": [n for f in found for n in range(len(f))], "text": [c[2] for c in flat], "section_path": [c[0] for c in flat], "content_role": [c[1] for c in flat]}
            columns = [pa.array(own.get(t.name, [[]] * len(flat)), t.type) for t in list(target)[3:]]
            yield pa.RecordBatch.from_arrays([*[b.column(k).take(at) for k in range(3)], *columns], names=target.names)

    return slim.mapInArrow(run, schema)


def passages_from_blocks(df: DataFrame, options: ChunkOptions = ChunkOptions(), blocks_col: str = "blocks") -> DataFrame:
    """Passages of sources (id, display_name, location, blocks), numbered without gaps."""
    o = (options.max_chars, options.overlap_chars, options.min_chars)
    return folded(df, blocks_col, lambda b: plain.section_chunks(plain.split_sections(b), *o))


def passages_from_sections(df: DataFrame, options: ChunkOptions = ChunkOptions(), sections_col: str = "sections") -> DataFrame:
    o = (options.max_chars, options.overlap_chars, options.min_chars)
    return folded(df, sections_col, lambda s: plain.section_chunks([(x["heading"], x["blocks"]) for x in s], *o))


def chunk_sectioned_blocks(blocks: Column | str, options: ChunkOptions = ChunkOptions()) -> Column:
    return F.transform(block_chunks(blocks, options), lambda c: c["text"])


PASSAGE_COLUMNS = S.PASSAGE_COLUMNS
