import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import sentencepiece
from helpers import ODD, noise, table
from lumenpass.llm import bpe, token_counts, token_files
from tokenizers import Tokenizer

TEXTS = ODD + noise(400)


def test_bpe_equals_the_library():
    library, own = Tokenizer.from_file(P.path("word_bpe_49k.json")), bpe.WordBpe(P.path("word_bpe_49k.json"))
    for t in TEXTS:
        ids = library.encode(t or "", add_special_tokens=False).ids
        got = own.encode(t or "")
        assert np.frombuffer(got, "<u4").tolist() == ids, t
        assert own.decode(got) == library.decode(ids, skip_special_tokens=False)


def test_bpe_long_words_take_the_heap():
    own = bpe.WordBpe(P.path("word_bpe_49k.json"))
    word = "theingation" * 100
    ids = [own.inner[b] for b in word.encode()[:-1]] + [own.last[ord(word[-1])]]
    short, bpe_short = own.merges._long(list(ids)), bpe.SHORT
    try:
        bpe.SHORT = 10**9
        assert own.merges.apply(list(ids)) == short
    finally:
        bpe.SHORT = bpe_short


def test_bpe_tables(spark):
    path = P.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    docs = table(spark, TEXTS)
    want = {}
    for i, t in enumerate(TEXTS):
        ids = library.encode(t or "", add_special_tokens=False).ids
        want[i] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest())
    assert {r[0]: tuple(r[1:]) for r in bpe.digest_table(docs, path).collect()} == want
    ids = bpe.encode_table(docs, path)
    back = {r[0]: r[1] for r in bpe.decode_table(ids, path).collect()}
    assert hashlib.sha256(back[9].encode()).hexdigest() == want[9][2]
    assert bpe.digest_table(docs.limit(0), path).count() == 0
    assert bpe.digest_table(docs.union(docs), path).count() == 2 * len(TEXTS)


def test_counts_equal_the_library(spark):
    path = P.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    got = {r[0]: tuple(r[1:]) for r in token_counts.count_table(table(spark, TEXTS), path, limit=20).collect()}
    for i, t in enumerate(TEXTS):
        n = len(library.encode(t or ""))
        assert got[i] == (len((t or "").encode()), n, n > 20), t
    assert token_counts.count_table(table(spark, TEXTS).limit(0), path).count() == 0


@pytest.mark.parametrize("high", [1, 2, 300, 70_000, 2**32 - 1])
@pytest.mark.parametrize("n", [0, 1, 127, 128, 129, 5000])
def test_blocks_round_trip(n, high):
    r = np.random.default_rng(n + high % 97)
    ids = r.integers(0, high, n).astype(np.uint32)
    ids[:: 17] = min(high, 3)
    raw = token_files.to_bytes(ids, [None, 5], [n, 0])
    held = token_files.TokenFile(raw)
    assert np.array_equal(held.ids(), ids) and held.doc_ids == [None, 5]
    if n:
        assert np.array_equal(np.concatenate([held.block(k) for k in range(-(-n // 128))]), ids)


def test_blocks_use_exceptions():
    ids = np.r_[np.arange(120) % 8, [2**31] * 8].astype(np.uint32)
    start, low, width, n_wide, payload = token_files.pack(ids)
    assert width[0] == 3 and n_wide[0] == 8 and len(payload) == 16 * 3 + 5 * 8


def flat(own, texts):
    ids, n = own.encode_batch(pa.array(texts, pa.string()), 7)
    z = np.cumsum(n)
    return [ids[a:b].tolist() for a, b in zip(z - n, z)]


def test_encoder_equals_the_library():
    path = P.path("byte_bpe_50k.json")
    library, own = Tokenizer.from_file(path), token_files.ByteEncoder(path)
    r = random.Random(9)
    pieces = ["'", "''", "'s", "'t", "_", " ", "  ", "\n", "\n\n", " \n", "\t", "a", "it", "THE", "1", ".", ",", "!!", "é", "ß", "\x85", "\xa0", "\x1c", "²", "<|endoftext|>", "日", "y" * 40]
    texts = [t or "" for t in TEXTS] + ["one two", " one two", "a\n b", "a\n  b", "", ""] + ["".join(r.choice(pieces) for _ in range(r.randint(0, 14))) for _ in range(8000)]
    want = [[*e.ids, 7] for e in library.encode_batch(texts, add_special_tokens=False)]
    assert flat(own, texts) == want and flat(own, texts[::-1]) == want[::-1]
    own.CHUNK = 50
    assert flat(own, texts[:600]) == want[:600]
    assert flat(own, []) == []


def test_piece_table_probes_and_clears():
    table = token_files.PieceTable(bits=8)
    r = np.random.default_rng(1)
    key = np.unique(r.integers(0, 40, (100, 5)), axis=0).T.astype(np.uint64)
    same = np.zeros(key.shape[1], np.uint64)  # all in one slot
    table.add(key, same, [np.full(k % 3, k, "<u4").tobytes() for k in range(key.shape[1])])
    number = table.find(key, same)
    assert np.array_equal(number, np.arange(key.shape[1])) and table.size[5] == 2 and table.ids[table.start[5]] == 5
    assert (table.find(key + np.uint64(100), same) < 0).all()
    table.clear()
    assert (table.find(key, same) < 0).all()


def test_token_files(spark):
    path = P.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    docs = table(spark, TEXTS)
    from lumenpass.llm.common import work_path

    folder = work_path(spark, "t")
    files = token_files.write_files(docs, path, folder, ids_in_file=700)
    assert files.count() > 3
    got = {r[0]: tuple(r[1:]) for r in token_files.read_files(files, folder).collect()}
    start = 0
    for i, t in enumerate(TEXTS):
        ids = library.encode(t or "", add_special_tokens=False).ids + [0]
        assert got[i] == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())), t
        start += len(ids)
    assert token_files.token_id_table(docs.limit(0), path).count() == 0
    null = docs.selectExpr("cast(null as long) doc_id", "text").limit(3)
    assert token_files.token_id_table(null.union(null), path).count() == 6


def test_starts_of_many_files(spark):
    r = np.random.default_rng(2)
    n = 100_000
    part = np.sort(r.integers(0, 300, n))
    seq = np.arange(n) - np.searchsorted(part, part)
    size = r.integers(0, 4_000_000, n)
    files = spark.createDataFrame([(int(p), int(s), f"{p}-{s}", 1, int(k)) for p, s, k in zip(part, seq, size)], token_files.FILES).repartition(5)
    starts = token_files.with_starts(files)
    assert {x.file: x.start for x in starts.collect()} == {f"{p}-{s}": int(a) for p, s, a in zip(part, seq, np.cumsum(size) - size)}
    assert token_files.with_starts(files.limit(0)).count() == 0


def test_rows_of_one_id_may_part(spark):
    docs = spark.range(4000).selectExpr("7L doc_id", "cast(id % 3 as string) text").repartition(4)
    from lumenpass.llm.common import work_path

    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        folder = work_path(spark, "t")
        files = token_files.write_files(docs, P.path("byte_bpe_50k.json"), folder)
        assert files.select("part").distinct().count() > 1
        starts = [x.start for x in token_files.read_files(files, folder).orderBy("start").collect()]
        assert starts == list(range(0, 8000, 2))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
