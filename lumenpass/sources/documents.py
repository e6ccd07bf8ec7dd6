"""Source tables and readers of extracted documents."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from lumenpass import schemas as S
from lumenpass.functions import text as T
from lumenpass.operators import chunking
from lumenpass.options import ChunkOptions, PassageSource, PdfOptions
from lumenpass.sources import pdf
from lumenpass.sources.work import small_batches


def sources(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """(id, display_name, location, text, enabled) from memory."""
    return spark.createDataFrame(rows, S.SOURCES)


def prechunked(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, S.SOURCES_PRECHUNKED)


#: Bytes for each core up to which it is cheaper to deal a table's rows out than to leave cores idle.
SMALL = 128 << 20


def spread(df: DataFrame, key: str) -> DataFrame:
    """Rows of a small table in fewer files than there are cores, dealt out by a key.

    Anything larger stays as it is: its scan is split by files and row groups, and no text is shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores, key) if size < cores * SMALL and len(df.inputFiles()) < cores else df


def as_pdf(df: DataFrame) -> DataFrame:
    """Sources shown as PDFs."""
    return df.withColumn("display_name", F.concat(F.lit("PDF: "), F.col("display_name")))


def source_columns(source: PassageSource) -> list[Column]:
    return [F.lit(source.id).alias("id"), F.lit(source.display_name).alias("display_name"), F.lit(source.location).alias("location")]


def table_sources(df: DataFrame, id_col: str, text_col: str, name: Column | None = None, location: Column | None = None, enabled: Column | None = None) -> DataFrame:
    """Any table of texts as sources."""
    key = F.col(id_col).cast("string")
    return df.select(key.alias("id"), (key if name is None else name).alias("display_name"), (key if location is None else location).alias("location"), F.col(text_col).alias("text"), (F.lit(True) if enabled is None else enabled).alias("enabled"))


def image_notes(images: Column | str, page_no: Column | str) -> Column:
    """A line for each of a page's images (array of struct<width, height>)."""
    images, page_no = (F.col(x) if isinstance(x, str) else x for x in (images, page_no))
    line = lambda x, i: F.format_string("[PDF image note: page %d, image %d, %dx%d samples. Embedded image detected during PDF processing.]", page_no, i + 1, x["width"], x["height"])
    return F.array_join(F.transform(images, line), "\n")


PAGES = "path string, page_no int, blocks array<string>, images array<struct<width:int,height:int>>, error string"


def extract_pages(files: DataFrame, extractor: Callable[[bytes], list[dict]] = pdf.extract) -> DataFrame:
    """Pages of binary files (path, content) by an extractor, which gives dicts of page_no, blocks, images.

    The default is the package's own small PDF reader; any library can take its place. A file that the extractor
    refuses gives one row with the error.
    """

    def rows(path: str, content: bytes) -> list[tuple]:
        return [(path, int(p["page_no"]), list(p["blocks"]), [dict(zip(("width", "height"), i)) if isinstance(i, (list, tuple)) else i for i in p.get("images", [])], None) for p in extractor(content)]

    return _read_files(files, rows, lambda path, said: (path, None, [], [], said), PAGES)


def _read_files(files: DataFrame, rows: Callable[[str, bytes], list[tuple]], failed: Callable[[str, str], tuple], ddl: str, room: int = 1 << 24) -> DataFrame:
    """Rows of binary files (path, content), one file after another; a failure is the file's row. Batches of results end
    once the files they come from have ``room`` bytes."""
    schema = StructType.fromDDL(ddl)
    kinds = list(to_arrow_schema(schema))

    def batch(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], f.type) for k, f in enumerate(kinds)], names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, held = [], 0
            for path, content in zip(b.column("path").to_pylist(), b.column("content")):
                content = content.as_py()
                try:
                    out += rows(path, bytes(content))
                except Exception as e:  # noqa: BLE001 - any failure of a file is its row's error
                    out.append(failed(path, f"Unable to read PDF '{path}': {e}"))
                held += len(content or b"")
                if held > room:
                    yield batch(out)
                    out, held = [], 0
            if out:
                yield batch(out)

    small_batches(files.sparkSession)
    return files.select("path", "content").mapInArrow(run, schema)


def read_blocks(pages: DataFrame, options: PdfOptions = PdfOptions()) -> DataFrame:
    """(path, page_no, block_no, text): normalized blocks in page order, with a note of each page's images at its end."""
    with_notes = F.concat("blocks", F.array(image_notes("images", "page_no"))) if options.include_image_notes else F.col("blocks")
    placed = pages.where("error is null").select("path", "page_no", F.posexplode(with_notes).alias("k", "t"))
    return placed.select("path", "page_no", F.col("k").alias("block_no"), T.normalize_whitespace("t").alias("text")).where(T.keep_block("text", options.filter_numeric_blocks))


def gather_blocks(blocks: DataFrame) -> DataFrame:
    """(path, blocks): a document's blocks in order."""
    return blocks.groupBy("path").agg(F.transform(F.array_sort(F.collect_list(F.struct("page_no", "block_no", "text"))), lambda b: b["text"]).alias("blocks"))


def read_text(blocks: DataFrame) -> DataFrame:
    return gather_blocks(blocks).select("path", F.array_join("blocks", "\n\n").alias("text"))


def read_passages(pages: DataFrame, read: PdfOptions = PdfOptions(), chunk: ChunkOptions = ChunkOptions()) -> DataFrame:
    df = gather_blocks(read_blocks(pages, read))
    return chunking.passages_from_blocks(df.select(F.col("path").alias("id"), F.element_at(F.split("path", "/"), -1).alias("display_name"), F.col("path").alias("location"), "blocks"), chunk)


WORDS = "path string, page_no int, width double, height double, words array<struct<text:string,l:double,t:double,r:double,b:double>>"


def extract_words(files: DataFrame, extractor: Callable[[bytes], list[dict]] = pdf.extract_words) -> DataFrame:
    """Pages with the words of binary files (path, content); a file that the extractor refuses gives a row with the error."""

    def rows(path: str, content: bytes) -> list[tuple]:
        return [(path, int(p["page_no"]), p["width"], p["height"], p["words"], None) for p in extractor(content)]

    return _read_files(files, rows, lambda path, said: (path, None, None, None, [], said), f"{WORDS}, error string")


def page_cells(words: DataFrame) -> DataFrame:
    """(path, page_no, cell_no, text, bbox, confidence): native words as cells with a bottom-left origin; blanks dropped."""
    from lumenpass.functions import geometry as G

    placed = words.select("path", "page_no", F.posexplode("words").alias("cell_no", "w"))
    box = G.box(F.col("w.l"), F.col("w.t"), F.col("w.r"), F.col("w.b"), "BOTTOMLEFT")
    return placed.select("path", "page_no", "cell_no", T.normalize_whitespace("w.text").alias("text"), box.alias("bbox"), F.lit(None).cast("double").alias("confidence")).where("text <> ''")


def binary_files(spark: SparkSession, path: str, glob: str = "*.pdf") -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
