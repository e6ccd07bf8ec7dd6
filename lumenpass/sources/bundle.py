"""Index bundles: a manifest that names index folders and the options that they must have been built with."""

from __future__ import annotations

import json
import os
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import UTC, datetime
from functools import partial

from pyspark.sql import DataFrame, SparkSession

from lumenpass.operators.search import Index
from lumenpass.options import ChunkOptions, TfidfOptions
from lumenpass.sources import index_store, work

SCHEMA_SUFFIX = "IndexBundle"
SCHEMA_NAME, VERSION = "Lumenpass" + SCHEMA_SUFFIX, 1
NEVER = datetime.min.replace(tzinfo=UTC)


@dataclass(frozen=True)
class BundleSource:
    source_id: str
    source_display_name: str
    source_location: str | None
    source_kind: str | None
    index_file: str


@dataclass(frozen=True)
class Manifest:
    bundle_id: str
    bundle_version: str
    model_id: str
    chunk_options: ChunkOptions = ChunkOptions()
    tfidf_options: TfidfOptions = TfidfOptions()
    sources: tuple[BundleSource, ...] = ()
    manifest_version: int = VERSION
    created_at: datetime = field(default_factory=lambda: datetime.now(UTC))


@dataclass(frozen=True)
class Compatibility:
    """What a bundle must have been built with; None doesn't matter."""

    model_id: str
    chunk_options: ChunkOptions | None = ChunkOptions()
    tfidf_options: TfidfOptions | None = TfidfOptions()


def dumps(m: Manifest, indent: int | None = None) -> str:
    c, t = m.chunk_options, m.tfidf_options
    return json.dumps({
        "schema_name": SCHEMA_NAME, "manifest_version": m.manifest_version, "bundle_id": m.bundle_id, "bundle_version": m.bundle_version, "model_id": m.model_id, "created_at": m.created_at.isoformat(),
        "chunk_options": {"max_chars": c.max_chars, "overlap_chars": c.overlap_chars, "min_chars": c.min_chars}, "tfidf_options": {"text_weight": t.text_weight, "keyword_weight": t.keyword_weight},
        "sources": [vars(s) for s in m.sources],
    }, ensure_ascii=False, indent=indent)


def _first(e: dict, *names: str) -> str | None:
    for n in names:
        if n in e:
            return e[n] if isinstance(e[n], str) else None
    return None


def _number(e: dict, name: str, default, whole: bool = False):
    v = e.get(name)
    return v if isinstance(v, int if whole else (int, float)) and not isinstance(v, bool) else default


def parse(text: str) -> tuple[Manifest | None, str | None]:
    """(manifest, None) or (None, error); older spellings of the fields are understood, bad dates become the first one."""
    try:
        root = json.loads(text)
    except (TypeError, ValueError) as e:
        return None, f"Unable to parse index bundle manifest: {e}"
    schema = _first(root, "schema_name", "schemaName") if isinstance(root, dict) else None
    if schema is None:
        return None, "Index bundle manifest schema_name is missing."
    if not schema.endswith(SCHEMA_SUFFIX):
        return None, f"Expected schema_name '{SCHEMA_NAME}', got '{schema}'."
    c = root.get("chunk_options", root.get("chunkOptions"))
    t = root.get("tfidf_options", root.get("tfidfOptions"))
    c, t = c if isinstance(c, dict) else {}, t if isinstance(t, dict) else {}
    dc, dt = ChunkOptions(), TfidfOptions()
    try:
        created = datetime.fromisoformat(_first(root, "created_at", "createdAt") or "")
    except ValueError:
        created = NEVER
    listed = root.get("sources") if isinstance(root.get("sources"), list) else []
    sources = tuple(
        BundleSource(
            s if (s := _first(e, "source_id", "id")) is not None else f"source-{k}", n if (n := _first(e, "source_display_name", "display_name", "displayName")) is not None else f"Source {k}",
            _first(e, "source_location", "location", "document_file", "documentAsset"), _first(e, "source_kind", "kind"), _first(e, "index_file", "indexFile") or "",
        )
        for k, e in enumerate(x if isinstance(x, dict) else {} for x in listed)
    )
    return Manifest(
        _first(root, "bundle_id", "bundleId") or "", _first(root, "bundle_version", "bundleVersion") or "", _first(root, "model_id", "modelId") or "",
        ChunkOptions(_number(c, "max_chars", dc.max_chars, True), _number(c, "overlap_chars", dc.overlap_chars, True), _number(c, "min_chars", dc.min_chars, True)),
        TfidfOptions(_number(t, "text_weight", dt.text_weight), _number(t, "keyword_weight", dt.keyword_weight)), sources, _number(root, "manifest_version", VERSION, True), created,
    ), None


def write_manifest(spark: SparkSession, path: str, m: Manifest) -> None:
    """Overwrites a file on any store; folders on the way are made."""
    work.write_text(spark, path, dumps(m, indent=2))


def read_manifest(spark: SparkSession, path: str) -> tuple[Manifest | None, str | None]:
    text = work.read_text(spark, path)
    return (None, f"Index bundle manifest '{path}' does not exist.") if text is None else parse(text)


def resolve(base: str, file: str) -> str:
    """A blank, rooted or fully named file is itself; any other lies under ``base``."""
    return file if not file.strip() or os.path.isabs(file) or "://" in file else f"{base.rstrip('/')}/{file}"


def validate(exists: Callable[[str], bool], base: str, wanted: Compatibility, m: Manifest) -> list[str]:
    """Everything that is wrong with a manifest; ``exists`` says whether an index is there."""
    said = []
    if m.manifest_version != VERSION:
        said.append(f"Unsupported index bundle manifest version {m.manifest_version}; expected {VERSION}.")
    said += [f"Index bundle manifest {n} is required." for n in ("bundle_id", "model_id") if not getattr(m, n).strip()]
    if m.model_id != wanted.model_id:
        said.append(f"Index bundle model_id '{m.model_id}' does not match expected '{wanted.model_id}'.")
    for n in ("chunk_options", "tfidf_options"):
        if getattr(wanted, n) is not None and getattr(m, n) != getattr(wanted, n):
            said.append(f"Index bundle {n} ({getattr(m, n)}) do not match expected ({getattr(wanted, n)}).")
    if not m.sources:
        said.append("Index bundle manifest must contain at least one source.")
    for s in m.sources:
        if not s.source_id.strip():
            said.append("Index bundle source_id is required.")
        if not s.source_display_name.strip():
            said.append(f"Index bundle source '{s.source_id}' source_display_name is required.")
        if not s.index_file.strip():
            said.append(f"Index bundle source '{s.source_id}' index_file is required.")
        elif not exists(resolve(base, s.index_file)):
            said.append(f"Index bundle source '{s.source_id}' index file '{s.index_file}' was not found.")
    return said


def load_compatible(spark: SparkSession, wanted: Compatibility, path: str) -> tuple[list[tuple[BundleSource, Index]] | None, list[str]]:
    """All of a bundle's indexes, or all that is wrong with it."""
    m, error = read_manifest(spark, path)
    if error:
        return None, [error]
    base = path.rsplit('/', 1)[0] if '/' in path else '.'
    if said := validate(partial(work.exists, spark), base, wanted, m):
        return None, said
    out = []
    for s in m.sources:
        try:
            index = index_store.load(spark, resolve(base, s.index_file))
        except Exception as e:  # noqa: BLE001 - reported with the rest
            said.append(f"Unable to load index '{s.index_file}' for source '{s.source_id}': {e}")
            continue
        said += [f"Index '{s.index_file}' {n} ({getattr(index, n)}) do not match manifest ({getattr(m, n)})." for n in ("chunk_options", "tfidf_options") if getattr(index, n) != getattr(m, n)]
        out.append((s, index))
    return (None, said) if said else (out, [])


def all_passages(loaded: list[tuple[BundleSource, Index]]) -> DataFrame:
    """Passages of all of a bundle's indexes, with the bundle's source ids."""
    from functools import reduce

    from pyspark.sql import functions as F

    return reduce(lambda a, b: a.unionByName(b), [i.passages.withColumn("bundle_source_id", F.lit(s.source_id)) for s, i in loaded])
