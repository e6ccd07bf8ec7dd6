"""Media columns: Netpbm and BMP images as numpy arrays, area-resized, kept as NPY tiles with difference hashes."""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenpass.llm.common import per_text, small_batches, work_path

SIDE = 24
UNIT = SIDE * SIDE


def decode_netpbm(data: bytes) -> np.ndarray:
    """P1 to P6 as (height, width) or (height, width, 3); bitmaps become 0 and 255, wide samples stay 16-bit."""
    kind = data[:2]
    if kind not in (b"P1", b"P2", b"P3", b"P4", b"P5", b"P6"):
        raise ValueError("not a Netpbm image")
    need, at, fields = (2 if kind in (b"P1", b"P4") else 3), 2, []
    token = re.compile(rb"(?:\s|#[^\n\r]*[\n\r])*(\d+)")
    while len(fields) < need:
        m = token.match(data, at)
        if not m:
            raise ValueError("a broken Netpbm header")
        fields.append(int(m[1]))
        at = m.end()
    width, height, most = fields[0], fields[1], fields[2] if need == 3 else 1
    planes = 3 if kind in (b"P3", b"P6") else 1
    n = width * height * planes
    if kind in (b"P1", b"P2", b"P3"):
        body = re.sub(rb"#[^\n\r]*", b"", data[at:])
        values = [c - 48 for c in body if c in b"01"] if kind == b"P1" else list(map(int, body.split()))
        out = np.array(values[:n], np.uint16 if most > 255 else np.uint8)
    elif kind == b"P4":
        row = -(-width // 8)
        bits = np.unpackbits(np.frombuffer(data, np.uint8, row * height, at + 1).reshape(height, row), axis=1)[:, :width]
        out = bits.ravel()
    else:
        out = np.frombuffer(data, ">u2" if most > 255 else np.uint8, n, at + 1)
    if len(out) < n:
        raise ValueError("a short Netpbm image")
    if kind in (b"P1", b"P4"):
        out = (1 - out).astype(np.uint8) * np.uint8(255)
    return out.reshape((height, width, 3) if planes == 3 else (height, width))


def encode_pgm(gray: np.ndarray) -> bytes:
    return b"P5\n%d %d\n255\n" % (gray.shape[1], gray.shape[0]) + np.ascontiguousarray(gray, np.uint8).tobytes()


def decode_bmp(data: bytes) -> np.ndarray:
    """Uncompressed 8-bit (with palette), 24-bit and 32-bit bitmaps as (height, width, 3) RGB."""
    if data[:2] != b"BM":
        raise ValueError("not a BMP image")
    offset, header = struct.unpack_from("<II", data, 10)
    width, height, _, bits, packed = struct.unpack_from("<iiHHI", data, 18)
    if packed not in (0, 3) or bits not in (8, 24, 32):
        raise ValueError(f"a BMP of {bits} bits with compression {packed}")
    rows, stride = abs(height), (width * bits // 8 + 3) // 4 * 4
    raw = np.frombuffer(data, np.uint8, rows * stride, offset).reshape(rows, stride)[:, : width * bits // 8]
    if bits == 8:
        used = struct.unpack_from("<I", data, 46)[0] or 256
        palette = np.zeros((256, 3), np.uint8)
        palette[:used] = np.frombuffer(data, np.uint8, 4 * used, 14 + header).reshape(-1, 4)[:, 2::-1]
        out = palette[raw]
    else:
        out = raw.reshape(rows, width, bits // 8)[:, :, 2::-1]
    return np.ascontiguousarray(out if height < 0 else out[::-1])


def decode_image(data: bytes) -> np.ndarray:
    return decode_bmp(data) if data[:2] == b"BM" else decode_netpbm(data)


def gray(image: np.ndarray) -> np.ndarray:
    return image if image.ndim == 2 else (image.astype(np.uint32) @ np.array([299, 587, 114], np.uint32) + 500) // 1000


def area_resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Means over the target's cells, exact for fractional edges: differences of an interpolated integral image."""
    h, w = image.shape
    total = np.zeros((h + 1, w + 1))
    np.cumsum(np.cumsum(image, axis=0, dtype=np.int64), axis=1, out=total[1:, 1:])

    def at(edge: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        low = np.minimum(edge.astype(np.int64), n - 1)
        return low, edge - low

    y, fy = at(np.arange(height + 1) * h / height, h)
    x, fx = at(np.arange(width + 1) * w / width, w)
    rows = total[y] * (1 - fy)[:, None] + total[y + 1] * fy[:, None]
    full = rows[:, x] * (1 - fx) + rows[:, x + 1] * fx
    return np.diff(np.diff(full, axis=0), axis=1) * (height * width / (h * w))


def difference_hash(image: np.ndarray) -> int:
    """64 bits: is a cell of the 8 x 9 reduction brighter than its left neighbour (beyond rounding)."""
    small = np.round(area_resize(image, 8, 9), 6)
    return int(np.packbits(small[:, 1:] > small[:, :-1]).view(">u8")[0])


def to_npy(tiles: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.lib.format.write_array(out, np.ascontiguousarray(tiles), allow_pickle=False)
    return out.getvalue()


def from_npy(data: bytes) -> np.ndarray:
    return np.lib.format.read_array(io.BytesIO(data), allow_pickle=False)


def payload_of(text: str) -> bytes:
    raw = text.encode("utf-8")
    return raw + b"\xff" * (-len(raw) % UNIT or (UNIT if not raw else 0))


def tiles_of(payload: bytes) -> bytes:
    """The payload as a gray Netpbm image 24 wide, decoded and cut into NPY tiles of 24 x 24."""
    image = decode_netpbm(b"P5\n%d %d\n255\n" % (SIDE, len(payload) // SIDE) + payload)
    return to_npy(image.reshape(-1, SIDE, SIDE))


def image_table(df: DataFrame, id_col: str, image_col: str, tile: int = 64) -> DataFrame:
    """(id, width, height, tile NPY, dhash, error): images of a binary column, each area-resized to ``tile`` squared.

    A null or undecodable image gives nulls and the reason in ``error``; the row stays.
    """
    small_batches(df.sparkSession)
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for data in b.column(1).to_pylist():
                try:
                    if data is None:
                        raise ValueError("no image")
                    g = gray(decode_image(data))
                    small = np.clip(np.rint(area_resize(g, tile, tile)), 0, 65535).astype(np.uint16 if g.dtype.itemsize > 1 and g.max(initial=0) > 255 else np.uint8)
                    out.append((g.shape[1], g.shape[0], to_npy(small), f"{difference_hash(g):016x}", None))
                except (ValueError, struct.error, IndexError) as e:
                    out.append((None, None, None, None, str(e)))
            kinds = [pa.int32(), pa.int32(), pa.binary(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array([o[k] for o in out], t) for k, t in enumerate(kinds)]], names=[id_col, "width", "height", "tile", "dhash", "error"])

    return df.select(id_col, image_col).mapInArrow(run, f"{id_col} {kind}, width int, height int, tile binary, dhash string, error string")


def text_media_table(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature) of whole texts.

    Each text's UTF-8, padded with 255 to a positive multiple of 576, becomes NPY tiles of 24 x 24 that are written to
    a media table in the shared folder. What is returned comes from reading that table back: the payload's digests,
    and as feature the difference hash of the whole image and that of all tiles' mean. Null texts count as empty (one
    tile of 255). Equal texts give equal values; repeated rows each give a row.
    """
    spark = df.sparkSession
    folder = work_path(spark, "media")

    def make():
        def work(texts: list[str]):
            raw = [payload_of(t) for t in texts]
            return [len(t.encode("utf-8")) for t in texts], [tiles_of(p) for p in raw]

        return work

    media = per_text(df, id_col, text_col, "n_bytes long, media binary", make)
    media.write.option("compression", "zstd").parquet(folder)
    kind = media.schema[id_col].dataType.simpleString()
    names = [id_col, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for data in b.column(2).to_pylist():
                tiles = from_npy(data)
                payload = tiles.tobytes()
                whole = difference_hash(tiles.reshape(-1, SIDE))
                mean = difference_hash(tiles.sum(axis=0, dtype=np.int64))
                out.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(data), hashlib.sha256(data).hexdigest(), f"{whole:016x}{mean:016x}"))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *[pa.array([o[k] for o in out], t) for k, t in enumerate(kinds)]], names=names)

    stored = spark.read.schema(media.schema).parquet(folder).select(F.col(id_col), "n_bytes", "media")
    return stored.mapInArrow(features, f"{id_col} {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
