"""Token-ID files of patched frame-of-reference blocks.

A file holds the ids of consecutive documents. Ids are cut into blocks of ``BLOCK``; a block stores its minimum, the
differences packed at the width that ``PERCENTILE`` of them need, and the wider ones in an exception list (position,
full difference). Whole bytes of the width are packed byte by byte, the bits above them plane by plane. An index of block starts makes every block readable by itself.

Layout (little-endian): magic, n_ids u64, n_docs u64, n_blocks u64; block starts u64[n_blocks + 1], minima u32, widths
u8, exception counts u8; document ids i64, document id present u8, token counts i64; then the payload.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenpass.llm.common import local_path, small_batches, work_path, written

MAGIC = b"PFORIDS1"
BLOCK = 128
PERCENTILE = 0.9


def _bit_lengths(x: np.ndarray) -> np.ndarray:
    return np.maximum((x.astype(np.float64).view(np.int64) >> 52) - 1022, 0).astype(np.uint8)  # the exponents of doubles


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, bytes]:
    """(block starts, minima, widths, exception counts, payload) of unsigned 32-bit ids."""
    n_blocks = -(-len(ids) // BLOCK)
    if not n_blocks:
        return np.zeros(1, "<u8"), np.zeros(0, "<u4"), np.zeros(0, "u1"), np.zeros(0, "u1"), b""
    full = np.empty(n_blocks * BLOCK, np.uint32)
    full[: len(ids)] = ids
    full[len(ids) :] = ids[-1]
    full = full.reshape(n_blocks, BLOCK)
    low = full.min(axis=1)
    diff = full - low[:, None]
    bits = _bit_lengths(diff)
    at = int(np.ceil(PERCENTILE * BLOCK)) - 1
    width = np.partition(bits, at, axis=1)[:, at]
    wide = bits > width[:, None]
    n_wide = wide.sum(axis=1)
    size = BLOCK // 8 * width.astype(np.int64) + 5 * n_wide
    start = np.concatenate([[0], np.cumsum(size)])
    out = np.zeros(start[-1], np.uint8)
    row, column = np.nonzero(wide)
    if len(row):
        nth = np.arange(len(row)) - np.repeat(np.cumsum(n_wide) - n_wide, n_wide)
        base = start[row] + BLOCK // 8 * width[row].astype(np.int64)
        out[base + nth] = column
        out[(base + n_wide[row] + 4 * nth)[:, None] + np.arange(4)] = diff[row, column].astype("<u4").view(np.uint8).reshape(-1, 4)
        diff[row, column] = 0
    for w in np.unique(width):
        rows = np.flatnonzero(width == w)
        at, whole = start[rows], int(w) // 8
        if whole:
            octets = diff[rows].astype("<u4").view(np.uint8).reshape(len(rows), BLOCK, 4)[:, :, :whole]
            out[at[:, None] + np.arange(whole * BLOCK)] = octets.reshape(len(rows), -1)
        part = (diff[rows] >> np.uint32(8 * whole)).astype(np.uint8)
        for k in range(int(w) % 8):
            plane = np.packbits(part >> np.uint8(k) & np.uint8(1), axis=1, bitorder="little")
            out[(at + whole * BLOCK + k * (BLOCK // 8))[:, None] + np.arange(BLOCK // 8)] = plane
    return start.astype("<u8"), low.astype("<u4"), width, n_wide.astype("u1"), out.tobytes()


def unpack(n_ids: int, start: np.ndarray, low: np.ndarray, width: np.ndarray, n_wide: np.ndarray, payload: bytes) -> np.ndarray:
    """The ids, from what ``pack`` gives."""
    data, start, n_wide = np.frombuffer(payload, np.uint8), start.astype(np.int64), n_wide.astype(np.int64)
    out = np.zeros((len(low), BLOCK), np.uint32)
    for w in np.unique(width):
        rows = np.flatnonzero(width == w)
        at, whole = start[rows], int(w) // 8
        octets = np.zeros((len(rows), BLOCK, 4), np.uint8)
        if whole:
            octets[:, :, :whole] = data[at[:, None] + np.arange(whole * BLOCK)].reshape(len(rows), BLOCK, whole)
        for k in range(int(w) % 8):
            plane = data[(at + whole * BLOCK + k * (BLOCK // 8))[:, None] + np.arange(BLOCK // 8)]
            octets[:, :, whole] |= np.unpackbits(plane, axis=1, bitorder="little") << np.uint8(k)
        part = octets.view("<u4").reshape(len(rows), BLOCK)
        out[rows] = part
    if n_wide.sum():
        row = np.repeat(np.arange(len(low)), n_wide)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(n_wide) - n_wide, n_wide)
        base = start[row] + BLOCK // 8 * width[row].astype(np.int64)
        value = data[(base + n_wide[row] + 4 * nth)[:, None] + np.arange(4)].copy().view("<u4").ravel()
        out[row, data[base + nth]] = value
    return (out + low[:, None]).ravel()[:n_ids]


def to_bytes(ids: np.ndarray, doc_ids: list, counts: list[int]) -> bytes:
    start, low, width, n_wide, payload = pack(ids)
    head = MAGIC + struct.pack("<QQQ", len(ids), len(doc_ids), len(low))
    known = np.array([d is not None for d in doc_ids], "u1")
    keys = np.array([0 if d is None else d for d in doc_ids], "<i8")
    return b"".join([head, start.tobytes(), low.tobytes(), width.tobytes(), n_wide.tobytes(), keys.tobytes(), known.tobytes(), np.array(counts, "<i8").tobytes(), payload])


class TokenFile:
    """Reader of one file; ``ids()`` gives all ids, ``block(k)`` one block by the index."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not a token file")
        self.n_ids, n_docs, n = struct.unpack_from("<QQQ", data, 8)
        at = 32

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            got = np.frombuffer(data, kind, count, at)
            at += got.nbytes
            return got

        self.start, self.low, self.width, self.n_wide = take("<u8", n + 1), take("<u4", n), take("u1", n), take("u1", n)
        keys, known, self.counts = take("<i8", n_docs), take("u1", n_docs), take("<i8", n_docs)
        self.doc_ids = [int(k) if there else None for k, there in zip(keys, known)]
        self.payload = memoryview(data)[at:]

    def ids(self) -> np.ndarray:
        return unpack(self.n_ids, self.start, self.low, self.width, self.n_wide, self.payload)

    def block(self, k: int) -> np.ndarray:
        a, z = int(self.start[k]), int(self.start[k + 1])
        n = min(BLOCK, self.n_ids - k * BLOCK)
        return unpack(n, np.array([0, z - a]), self.low[k : k + 1], self.width[k : k + 1], self.n_wide[k : k + 1], self.payload[a:z])


class PieceTable:
    """Ids of pieces of up to 32 bytes, looked up for whole arrays: open addressing over the bytes themselves.

    A piece is four little-endian words and its length, compared in full, so no two pieces are ever taken for each
    other. The table is emptied when half full.
    """

    def __init__(self, bits: int = 21):
        self.bits = bits
        self.clear()

    def clear(self) -> None:
        n = 1 << self.bits
        self.number = np.full(n, -1, np.int32)
        self.key = np.zeros((5, n >> 1), np.uint64)
        self.start, self.size = np.zeros(n >> 1, np.int64), np.zeros(n >> 1, np.int64)
        self.ids, self.used, self.count = np.zeros(1 << 20, np.uint32), 0, 0

    @staticmethod
    def mixed(key: np.ndarray) -> np.ndarray:
        h = key[4] * np.uint64(0xFF51AFD7ED558CCD)
        for k, odd in enumerate((0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)):
            h = (h ^ key[k]) * np.uint64(odd)
            h ^= h >> np.uint64(29)
        return h * np.uint64(0x9E3779B97F4A7C15)

    def _slot(self, h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, key: np.ndarray, h: np.ndarray) -> np.ndarray:
        """The number of each piece, -1 where it isn't known."""
        at = self._slot(h)
        out = self.number[at].astype(np.int64)
        live = np.flatnonzero(out >= 0)
        live = live[self._differ(out[live], key, live)]
        while len(live):
            at[live] = (at[live] + 1) & ((1 << self.bits) - 1)
            out[live] = self.number[at[live]]
            live = live[out[live] >= 0]
            live = live[self._differ(out[live], key, live)]
        return out

    def _differ(self, number: np.ndarray, key: np.ndarray, rows: np.ndarray) -> np.ndarray:
        out = self.key[4][number] != key[4][rows]
        for k in range(4):
            out |= self.key[k][number] != key[k][rows]
        return out

    def add(self, key: np.ndarray, h: np.ndarray, ids: list[bytes]) -> None:
        """Distinct new pieces with their ids."""
        first, n = self.count, len(h)
        size = np.fromiter(map(len, ids), np.int64, n) // 4
        total = int(size.sum())
        while self.used + total > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.used : self.used + total] = np.frombuffer(b"".join(ids), "<u4")
        self.key[:, first : first + n], self.size[first : first + n] = key, size
        self.start[first : first + n] = self.used + np.cumsum(size) - size
        self.used, self.count = self.used + total, first + n
        at, todo = self._slot(h), np.arange(n)
        while len(todo):
            free = todo[self.number[at[todo]] < 0]
            _, one = np.unique(at[free], return_index=True)
            put = free[one]
            self.number[at[put]] = first + put
            todo = np.setdiff1d(todo, put)
            at[todo] = (at[todo] + 1) & ((1 << self.bits) - 1)


def byte_class(chars: str) -> np.ndarray:
    table = np.zeros(256, bool)
    table[[ord(c) for c in chars]] = True
    return table


class ByteEncoder:
    """The tokenizers library behind a memory of pieces of text.

    A byte-level vocabulary's own splitting ends a token wherever a run of letters or digits ends, and begins one at a
    run, at the one white space before it, or at the apostrophe between two runs. Cut there, pieces can be encoded
    apart, and equal ones once: cuts and look-ups are array operations over the bytes of a batch, and only pieces not
    met before go to the library (runs after a blank joined into long strings, where the mark of a blank parts their
    tokens again). Texts with a special string or characters beyond Latin letters go to the library whole.
    """

    WORD = byte_class("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")
    WORD[128:] = True
    SPACE = byte_class("\t\n\x0b\x0c\r ")
    MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
    CHUNK = 4 << 20

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        n = self.library.get_vocab_size(True)
        self.begins = np.array([(self.library.id_to_token(i) or "").startswith("Ġ") for i in range(n)])
        special = "".join("|" + re.escape(t.content) for t in self.library.get_added_tokens_decoder().values())
        self.odd = r"[^\x00-\x1b\x20-\x7f\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{24f}]" + special
        self.table = PieceTable()

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, pieces: list[str]) -> list[bytes]:
        out = [b""] * len(pieces)
        runs = [k for k, p in enumerate(pieces) if p[0] == " " and p[1:].isalnum()]
        parts = [runs[k : k + 4000] for k in range(0, len(runs), 4000)]
        for part, got in zip(parts, self.library.encode_batch_fast(["".join([pieces[k] for k in p]) for p in parts], add_special_tokens=False)):
            ids = np.array(got.ids, "<u4")
            cuts = (4 * np.append(np.flatnonzero(self.begins[ids]), len(ids))).tolist()
            if len(cuts) != len(part) + 1:
                raise ValueError("runs can't be told apart")
            raw = ids.tobytes()
            for k, a, z in zip(part, cuts, cuts[1:]):
                out[k] = raw[a:z]
        run = set(runs)
        rest = [k for k in range(len(pieces)) if k not in run]
        for k, raw in zip(rest, self.whole([pieces[k] for k in rest])):
            out[k] = raw
        return out

    def cuts(self, raw: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Where pieces begin in the bytes of texts that begin at ``first`` (all of them not empty)."""
        word, space = self.WORD[raw], self.SPACE[raw]
        begin = np.zeros(len(raw) + 1, bool)
        begin[first] = True
        before = np.append(False, word[:-1])
        runs = np.flatnonzero(word & (~before | begin[:-1]))
        ends = np.flatnonzero(~word & before)
        # a run's piece begins at a contraction's apostrophe and the white space before it, or at one white space
        at = np.where(begin[runs], runs, runs - 1)
        apostrophe = (at < runs) & (raw[at] == 39)
        behind = np.maximum(at - 1, 0)
        odd_space = space[behind] & (raw[behind] != 32)
        joined = apostrophe & (begin[at] | word[behind] | odd_space)
        start = np.where((at < runs) & space[at] & ~apostrophe, at, runs)
        start = np.where(joined, np.where(odd_space & ~begin[at], behind, at), start)
        begin[start] = True
        begin[ends] = True
        return np.flatnonzero(begin[:-1])

    def encode_bytes(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids one after another, how many each text has) of plain texts in ``raw``; offsets begin at 0."""
        length = np.diff(offsets)
        if not len(raw):
            return np.zeros(0, np.uint32), np.zeros(len(length), np.int64)
        full = np.flatnonzero(length)
        start = self.cuts(raw, offsets[full])
        size = np.diff(np.append(start, len(raw)))
        padded = np.concatenate([raw, np.zeros(40, np.uint8)])
        words = np.ndarray((len(raw) + 33,), "<u8", padded, strides=(1,))
        short = np.flatnonzero(size <= 32)
        n_bytes, begin = size[short], start[short]
        key = np.empty((5, len(short)), np.uint64)
        for k in range(4):
            key[k] = words[begin + 8 * k] & self.MASK[np.clip(n_bytes - 8 * k, 0, 8)]
        key[4] = n_bytes
        h = self.table.mixed(key)
        if self.table.count > self.table.key.shape[1] - len(short) - 1:
            self.table.clear()
        number = self.table.find(key, h)
        new = np.flatnonzero(number < 0)
        data = raw.tobytes() if len(new) else b""
        while len(new):  # twice only if two new pieces share a hash
            one = new[np.unique(h[new], return_index=True)[1]]
            self.table.add(key[:, one], h[one], self._learn([data[x : x + y].decode("utf-8") for x, y in zip(begin[one].tolist(), n_bytes[one].tolist())]))
            number[new] = self.table.find(key[:, new], h[new])
            new = new[number[new] < 0]
        from_, each = np.zeros(len(start), np.int64), np.zeros(len(start), np.int64)
        from_[short], each[short] = self.table.start[number], self.table.size[number]
        ids = self.table.ids
        long = np.flatnonzero(size > 32)
        if len(long):
            got = self.whole([raw[a : a + n].tobytes().decode("utf-8") for a, n in zip(start[long].tolist(), size[long].tolist())])
            each[long] = np.fromiter(map(len, got), np.int64, len(got)) // 4
            from_[long] = self.table.used + np.cumsum(each[long]) - each[long]
            ids = np.concatenate([ids[: self.table.used], np.frombuffer(b"".join(got), "<u4")])
        at = np.repeat(from_ - (np.cumsum(each) - each), each) + np.arange(each.sum())
        counts = np.zeros(len(length), np.int64)
        counts[full] = np.add.reduceat(each, np.searchsorted(start, offsets[full]))
        return ids[at], counts

    def encode_batch(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, ``end`` after each; how many each has)."""
        if not len(texts):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        texts = texts.cast(pa.large_string())
        long = pc.greater(pc.binary_length(texts), self.CHUNK)
        odd = pc.or_(pc.match_substring_regex(texts, self.odd), long)
        whole = self.whole([t.as_py() for t in texts.filter(odd)])
        plain = pc.if_else(odd, pa.scalar("", pa.large_string()), texts)
        offsets = np.frombuffer(plain.buffers()[1], np.int64)[plain.offset : plain.offset + len(plain) + 1]
        data = np.frombuffer(plain.buffers()[2], np.uint8) if plain.buffers()[2] is not None else np.zeros(0, np.uint8)
        parts, counts, a = [], [], 0
        while a < len(plain):
            z = max(a + 1, int(np.searchsorted(offsets, offsets[a] + self.CHUNK, "right")) - 1)
            ids, n = self.encode_bytes(data[offsets[a] : offsets[z]], offsets[a : z + 1] - offsets[a])
            parts.append(ids)
            counts.append(n)
            a = z
        flat, sizes = np.concatenate(parts), np.concatenate(counts)
        # the texts that the library took whole, and the ends, go in where they belong
        place = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
        ends = np.cumsum(sizes)
        if len(place):
            each = np.fromiter(map(len, whole), np.int64, len(whole)) // 4
            flat = np.insert(flat, np.repeat(ends[place], each), np.frombuffer(b"".join(whole), "<u4"))
            sizes[place] = each
            ends = np.cumsum(sizes)
        return np.insert(flat, ends, np.uint32(end)), sizes + 1


@lru_cache(maxsize=2)
def byte_encoder(path: str) -> ByteEncoder:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return ByteEncoder(path)


FILES = "part int, seq int, file string, n_docs long, n_ids long"


def write_files(df: DataFrame, path: str, folder: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", ids_in_file: int = 4_000_000) -> DataFrame:
    """Encode every whole text, append ``end_id``, and write files in ascending id order.

    Rows are range-partitioned and sorted by id, so each task writes one run of files; a file is closed at
    ``ids_in_file`` ids. A file's name holds only its place, and it is renamed when whole, so a task that runs again
    after a loss writes the same file. Returns the table of files (part, seq, file, n_docs, n_ids), itself written to
    the shared folder. Null ids come first, null texts are empty, rows with equal ids are ordered by their text's hash;
    ranges may part rows of one id, so no id is one task's burden. Other columns are not read.
    """
    spark = df.sparkSession
    small_batches(spark)
    slim = df.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).alias("__text"), F.xxhash64(F.col(text_col)).alias("__hash")).withColumn("__row", F.monotonically_increasing_id())
    key = [F.col("__id").asc_nulls_first(), F.col("__hash")]
    # as many ranges as spark.sql.shuffle.partitions says; adaptive execution joins small neighbours
    ranged = slim.repartitionByRange(*key, F.col("__row")).sortWithinPartitions(*key).select("__id", "__text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, encoder, done = TaskContext.get().partitionId(), byte_encoder(path), 0
        store, base = local_path(folder)
        docs, counts, held, n_held = [], [], [], 0

        def close():
            nonlocal docs, counts, held, n_held, done
            name = f"part-{part:06d}-{done:05d}.ids"
            store.create_dir(base, recursive=True)
            own = f"{base}/.{name}.{TaskContext.get().taskAttemptId()}"
            with store.open_output_stream(own) as out:
                out.write(to_bytes(np.concatenate(held), docs, counts))
            try:
                store.move(own, f"{base}/{name}")
            except OSError:  # some stores don't move onto a file; another attempt's is the same
                if not store.get_file_info(f"{base}/{name}").is_file:
                    raise
                store.delete_file(own)
            row = pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([done], pa.int32()), pa.array([name]), pa.array([len(docs)], pa.int64()), pa.array([n_held], pa.int64())], names=["part", "seq", "file", "n_docs", "n_ids"])
            docs, counts, held, n_held, done = [], [], [], 0, done + 1
            return row

        for batch in batches:
            if not batch.num_rows:
                continue
            ids, sizes = encoder.encode_batch(pc.fill_null(batch.column(1), ""), end_id)
            keys, ends, a = batch.column(0).to_pylist(), np.cumsum(sizes), 0
            while a < len(keys):
                before = ends[a - 1] if a else 0
                z = max(int(np.searchsorted(ends, before + ids_in_file - n_held, "right")), a)
                if z == a and docs:
                    yield close()
                    continue
                z = max(z, a + 1)
                docs += keys[a:z]
                counts += sizes[a:z].tolist()
                held.append(ids[before : ends[z - 1]])
                n_held += int(ends[z - 1] - before)
                a = z
        if docs:
            yield close()

    return written(ranged.mapInArrow(run, FILES), "token-file-list")


def with_starts(files: DataFrame) -> DataFrame:
    """(file, start): how many ids all files before one hold.

    Sums run within a task's files and over one row for each task, so no task sees all files and the driver none.
    """
    before = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range partition
    parts = parts.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    within = files.withColumn("inner", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))
    return within.join(parts, "part").select("file", (F.col("base") + F.col("inner")).alias("start"))


def read_files(files: DataFrame, folder: str, id_col: str = "doc_id") -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of every document, from the files alone; each task reads many files, one by one."""
    schema = f"{id_col} long, start long, n_tokens long, ids_crc32 long"
    listed = with_starts(files).repartition(4 * files.sparkSession.sparkContext.defaultParallelism, "file")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = local_path(folder)
        for batch in batches:
            for name, start in zip(*[c.to_pylist() for c in batch.columns]):
                with store.open_input_stream(f"{base}/{name}") as f:
                    held = TokenFile(f.read())
                raw = held.ids().astype("<u4").tobytes()
                ends = np.cumsum(held.counts)
                first = ends - held.counts
                crc = [zlib.crc32(raw[4 * a : 4 * z]) for a, z in zip(first.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(held.doc_ids, pa.int64()), pa.array(first + start), pa.array(held.counts), pa.array(crc, pa.int64())], names=[id_col, "start", "n_tokens", "ids_crc32"])

    return listed.mapInArrow(run, schema)


def token_id_table(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Files written to the shared folder and read back: a row for each document (see ``write_files``).

    Repeated rows and rows without an id each have a row; an empty table gives none.
    """
    folder = work_path(df.sparkSession, "token-ids")
    return read_files(write_files(df, path, folder, id_col=id_col, text_col=text_col), folder, id_col)
