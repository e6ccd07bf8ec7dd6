"""Indexes on disk: a folder of Parquet tables with a JSON file, and an importer of the old binary files (versions 2 to 6)."""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator
from dataclasses import asdict
from datetime import UTC, datetime

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenpass import schemas as S
from lumenpass.operators.search import Index
from lumenpass.options import ROLES, ChunkOptions, TfidfOptions
from lumenpass.sources.work import children, exists, written

TABLES = ("passages", "vectors", "postings", "terms")
FORMAT = 1


def save(index: Index, path: str) -> None:
    """Overwrites a folder. Postings and terms are range-partitioned and sorted by term, so that a query's terms prune by
    the files' own statistics; a frequent term's postings may be in several ranges; vectors are apart from passages, so
    that lexical stages never read them."""
    index.passages.write.mode("overwrite").parquet(f"{path}/passages")
    index.vectors.write.mode("overwrite").parquet(f"{path}/vectors")
    index.postings.repartitionByRange("term", "ordinal").sortWithinPartitions("term", "ordinal").write.mode("overwrite").parquet(f"{path}/postings")
    index.terms.repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/terms")
    facts = {"format": FORMAT, "passage_count": index.passage_count, "avg_len": index.avg_len, "embedding_dim": index.embedding_dim, "chunk_options": asdict(index.chunk_options), "tfidf_options": asdict(index.tfidf_options), "created_at": index.created_at}
    index.passages.sparkSession.createDataFrame([(json.dumps(facts),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")


def load(spark: SparkSession, path: str) -> Index:
    facts = json.loads(spark.read.text(f"{path}/meta").first()[0])
    if facts["format"] != FORMAT:
        raise ValueError(f"Unsupported index format {facts['format']}.")
    return Index(*[spark.read.parquet(f"{path}/{t}") for t in TABLES], facts["passage_count"], facts["avg_len"], facts["embedding_dim"], ChunkOptions(**facts["chunk_options"]), TfidfOptions(**facts["tfidf_options"]), facts["created_at"])


def try_load(spark: SparkSession, path: str) -> tuple[Index | None, str | None]:
    """(index, None), (None, None) where there is none, or (None, error); on any store."""
    if not exists(spark, f"{path}/meta"):
        return None, None
    try:
        return load(spark, path), None
    except Exception as e:  # noqa: BLE001 - reported to the caller
        return None, f"Unable to load index '{path}': {e}"


def load_many(spark: SparkSession, folder: str) -> list[tuple[str, tuple[Index | None, str | None]]]:
    """Every index folder right under a folder of any store; none if it is missing."""
    return [(p, try_load(spark, p)) for p in children(spark, folder) if exists(spark, f"{p}/meta")]


class _Reader:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, kind: str):
        (v,) = struct.unpack_from("<" + kind, self.data, self.at)
        self.at += struct.calcsize("<" + kind)
        return v

    def many(self, kind: str) -> list:
        n = self.take("i")
        v = list(struct.unpack_from(f"<{n}{kind}", self.data, self.at))
        self.at += n * struct.calcsize("<" + kind)
        return v

    def text(self) -> str:
        size = shift = 0
        while True:
            b = self.data[self.at]
            self.at += 1
            size |= (b & 127) << shift
            shift += 7
            if b < 128:
                break
        v = self.data[self.at : self.at + size].decode("utf-8")
        self.at += size
        return v

    def texts(self) -> list[str]:
        return [self.text() for _ in range(self.take("i"))]


def role_of_storage(value: str) -> str:
    key = "".join(c for c in value.strip().lower() if c not in " _-")
    return next((r for r in ROLES if r.replace("_", "") == key), "unknown")


def decode_binary(data: bytes, magic: str | None = None) -> dict:
    """One old index file; ``magic`` is checked if given. Fields that a version lacks take their defaults."""
    r = _Reader(data)
    found = r.text()
    if magic is not None and found != magic:
        raise ValueError("not an index file")
    version = r.take("i")
    if not 2 <= version <= 6:
        raise ValueError(f"Unsupported index version {version}.")
    config = [r.take("i") for _ in range(9)] + [r.take("?"), r.take("?"), r.texts()]
    chunk = ChunkOptions(*[r.take("i") for _ in range(3)])
    tfidf = TfidfOptions(r.take("f"), r.take("f")) if version >= 3 else TfidfOptions()
    created = r.take("q")
    passages = []
    for ordinal in range(r.take("i")):
        p = {"ordinal": ordinal, "source_id": r.text(), "source_display_name": r.text(), "source_location": r.text(), "index": r.take("i"), "text": r.text()}
        p["keywords"] = r.texts() if version >= 3 else []
        p["section_path"] = r.texts() if version >= 4 else []
        p["content_role"] = role_of_storage(r.text()) if version >= 5 else "unknown"
        p["page_numbers"] = r.many("i") if version >= 5 else []
        p["layout_labels"] = r.texts() if version >= 6 else []
        p["captions"] = r.texts() if version >= 6 else []
        p["terms"] = r.texts()
        p["embedding_dim"], p["token_count"] = r.take("i"), r.take("i")
        p["token_ids"], p["vectors"] = r.many("i"), r.many("f")
        passages.append(p)
    count, average = r.take("i"), r.take("f")
    vocabulary = []
    for _ in range(r.take("i")):
        term, df, idf = r.text(), r.take("i"), r.take("f")
        vocabulary.append((term, df, idf, [(r.take("i"), r.take("f")) for _ in range(r.take("i"))]))
    return {"version": version, "config": config, "chunk_options": chunk, "tfidf_options": tfidf, "created_at_ms": created, "passages": passages, "passage_count": count, "avg_len": average, "vocabulary": vocabulary}


def encode_binary(index: dict, magic: str) -> bytes:
    """The layout of version 6."""
    out = bytearray()

    def put(kind: str, *v) -> None:
        out.extend(struct.pack("<" + kind, *v))

    def text(v: str) -> None:
        raw = v.encode("utf-8")
        n = len(raw)
        while n >= 128:
            out.append(n & 127 | 128)
            n >>= 7
        out.append(n)
        out.extend(raw)

    def texts(v: list[str]) -> None:
        put("i", len(v))
        for x in v:
            text(x)

    def many(kind: str, v: list) -> None:
        put(f"i{len(v)}{kind}", len(v), *v)

    text(magic)
    put("i", 6)
    put("9i2?", *index["config"][:11])
    texts(index["config"][11])
    c, t = index["chunk_options"], index["tfidf_options"]
    put("3i2fq", c.max_chars, c.overlap_chars, c.min_chars, t.text_weight, t.keyword_weight, index["created_at_ms"])
    put("i", len(index["passages"]))
    for p in index["passages"]:
        for k in ("source_id", "source_display_name", "source_location"):
            text(p[k])
        put("i", p["index"])
        text(p["text"])
        texts(p["keywords"])
        texts(p["section_path"])
        text(p["content_role"])
        many("i", p["page_numbers"])
        texts(p["layout_labels"])
        texts(p["captions"])
        texts(p["terms"])
        put("2i", p["embedding_dim"], p["token_count"])
        many("i", p["token_ids"])
        many("f", p["vectors"])
    put("ifi", index["passage_count"], index["avg_len"], len(index["vocabulary"]))
    for term, df, idf, posted in sorted(index["vocabulary"]):
        text(term)
        put("ifi", df, idf, len(posted))
        for o, f in posted:
            put("if", o, f)
    return bytes(out)


IMPORTED = f"path string, version int, ordinal long, {S.PASSAGES}, terms array<string>, {S.MULTI_VECTOR}, error string"
FACTS = "passage_count long, avg_len double, created_at_ms long, chunk struct<max_chars:int,overlap_chars:int,min_chars:int>, tfidf struct<text_weight:double,keyword_weight:double>, vocabulary array<struct<term:string,df:long,idf:double,postings:array<struct<ordinal:long,tf:double>>>>"


def import_files(spark: SparkSession, folder: str, glob: str = "*", magic: str | None = None) -> DataFrame:
    """A row for each old binary file right under a folder: its passages, vocabulary and options, or an error."""
    names = [f.split(" ", 1)[0] for f in ("path", "version", "error")]
    passage = f"struct<{IMPORTED.split(', ', 2)[2].rsplit(', ', 1)[0]}>"
    schema = f"path string, version int, error string, passages array<{passage}>, {FACTS}"
    fields = spark.createDataFrame([], IMPORTED).columns[2:-1]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for path, content in zip(f["path"], f["content"]):
                row = dict.fromkeys([*names, "passages", "passage_count", "avg_len", "created_at_ms", "chunk", "tfidf", "vocabulary"])
                row["path"] = path
                try:
                    got = decode_binary(bytes(content), magic)
                    row |= {k: got[k] for k in ("version", "passage_count", "avg_len", "created_at_ms")}
                    row["passages"] = [{k: p.get(k) for k in fields} for p in got["passages"]]
                    row["chunk"], row["tfidf"] = asdict(got["chunk_options"]), asdict(got["tfidf_options"])
                    row["vocabulary"] = [{"term": t, "df": df, "idf": idf, "postings": [{"ordinal": o, "tf": w} for o, w in posted]} for t, df, idf, posted in got["vocabulary"]]
                except (ValueError, struct.error, IndexError) as e:
                    row["error"] = f"Unable to load index '{path}': {e}"
                out.append(row)
            frame = pd.DataFrame(out)
            for c in ("version", "passage_count", "created_at_ms"):
                frame[c] = frame[c].astype("Int64")
            yield frame

    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder)
    return files.select(F.col("path"), "content").mapInPandas(run, schema)


def import_binary(spark: SparkSession, folder: str, glob: str = "*", magic: str | None = None) -> DataFrame:
    """Passages and vectors of the old binary files right under a folder, a row with an error for a broken file."""
    read = import_files(spark, folder, glob, magic).select("path", "version", "error", F.explode_outer("passages").alias("p"))
    return read.select("path", "version", "p.*", "error")


def import_index(spark: SparkSession, path: str, magic: str | None = None) -> Index:
    """One old binary file as an index that can be searched and saved: its own postings, vocabulary and options."""
    read = written(import_files(spark, path, magic=magic), "imported")
    facts = read.drop("passages", "vocabulary").first()  # one row of numbers
    if facts is None or facts.error:
        raise ValueError(facts.error if facts else f"There is no index '{path}'.")
    passages = read.select(F.explode("passages").alias("p")).select("p.*")
    words = read.select(F.explode("vocabulary").alias("v"))
    postings = words.select("v.term", F.explode("v.postings").alias("e")).select("e.ordinal", "term", "e.tf")
    dim = passages.agg(F.max("embedding_dim")).first()[0] or 64
    created = datetime.fromtimestamp(facts.created_at_ms / 1000, UTC).isoformat()
    kept = passages.drop("token_ids", "vectors", "token_count", "embedding_dim")
    return Index(kept, passages.select("ordinal", "vectors"), postings, words.select("v.term", "v.df", "v.idf"), facts.passage_count, facts.avg_len, dim, ChunkOptions(**facts.chunk.asDict()), TfidfOptions(**facts.tfidf.asDict()), created)
