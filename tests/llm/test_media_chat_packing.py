import hashlib
import random
import struct
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from helpers import ODD, noise, table
from lumenpass.llm import chat, media, packing

TEXTS = ODD + noise(100, size=900)


def bmp(image, bits, down=False):
    h, w = image.shape[:2]
    rows = image if down else image[::-1]
    pad = b"\0" * (-(w * bits // 8) % 4)
    if bits == 8:
        body, palette = b"".join(r.tobytes() + pad for r in rows), b"".join(bytes([k, k, k, 0]) for k in range(256))
    else:
        body, palette = b"".join(r[:, ::-1].tobytes() + pad for r in rows), b""
    offset = 54 + len(palette)
    return b"BM" + struct.pack("<IHHI", offset + len(body), 0, 0, offset) + struct.pack("<IiiHHIIiiII", 40, w, -h if down else h, 1, bits, 0, len(body), 0, 0, 0, 0) + palette + body


def test_decoders():
    r = np.random.default_rng(1)
    rgb, g = r.integers(0, 256, (5, 7, 3)).astype(np.uint8), r.integers(0, 256, (5, 7)).astype(np.uint8)
    for down in (False, True):
        assert np.array_equal(media.decode_bmp(bmp(rgb, 24, down)), rgb)
        assert np.array_equal(media.decode_bmp(bmp(g, 8, down))[:, :, 1], g)
    assert np.array_equal(media.decode_netpbm(media.encode_pgm(g)), g)
    assert np.array_equal(media.decode_netpbm(b"P6 # note\n7 5\n255\n" + rgb.tobytes()), rgb)
    assert np.array_equal(media.decode_netpbm(b"P5 7 5 65535 " + g.astype(">u2").tobytes()), g)
    assert np.array_equal(media.decode_netpbm(b"P3 7 5 255\n" + " ".join(map(str, rgb.ravel())).encode()), rgb)
    assert media.decode_netpbm(b"P1 2 2 1 0 01").tolist() == [[0, 255], [255, 0]]
    assert media.decode_netpbm(b"P4 9 1\n\x80\x80").tolist() == [[0] + [255] * 7 + [0]]
    for broken in (b"P5 7", b"P5 7 5 255\n1", b"GIF89a", b"BM"):
        with pytest.raises((ValueError, struct.error)):
            media.decode_image(broken)


def test_area_resize():
    g = np.random.default_rng(2).integers(0, 256, (24, 36))
    assert np.allclose(media.area_resize(g, 8, 9), g.reshape(8, 3, 9, 4).mean(axis=(1, 3)))
    assert np.allclose(media.area_resize(g, 7, 5).mean(), g.mean())
    fine = np.kron(g, np.ones((7, 5)))  # 168 x 180: cells of 24 x 36
    assert np.allclose(media.area_resize(g, 7, 5), fine.reshape(7, 24, 5, 36).mean(axis=(1, 3)))


def test_text_media(spark):
    got = {x.doc_id: x for x in media.text_media_table(table(spark, TEXTS)).collect()}
    assert len(got) == len(TEXTS)
    for i, t in enumerate(TEXTS):
        raw = (t or "").encode()
        payload = raw + b"\xff" * (-len(raw) % 576) or b"\xff" * 576
        x = got[i]
        assert (x.n_bytes, x.payload_bytes, x.payload_sha256, x.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        npy = media.to_npy(np.frombuffer(payload, np.uint8).reshape(-1, 24, 24))
        assert (x.media_bytes, x.media_sha256) == (len(npy), hashlib.sha256(npy).hexdigest())
        assert len(x.feature) == 32
    assert got[6].feature == got[7].feature
    assert media.text_media_table(table(spark, []).limit(0)).count() == 0


def test_image_table(spark):
    g = np.tile(np.arange(90, dtype=np.uint8), (40, 1))
    rows = [(1, bytearray(media.encode_pgm(g))), (2, None), (3, bytearray(b"junk")), (4, bytearray(bmp(np.stack([g] * 3, axis=2), 24)))]
    got = {x.id: x for x in media.image_table(spark.createDataFrame(rows, "id long, image binary"), "id", "image", tile=8).collect()}
    assert got[1].dhash == got[4].dhash == "f" * 16 and (got[1].width, got[1].height) == (90, 40)
    assert media.from_npy(bytes(got[1].tile)).shape == (8, 8)
    assert got[2].error == "no image" and got[3].tile is None and "Netpbm" in got[3].error


CONVERSATIONS = [
    (1, 1, "assistant", "b\\<|x"), (1, 0, "user", "a"), (2, 0, "assistant", "bad start"), (3, 0, "system", None), (3, 1, "user", ""), (3, 2, "assistant", "<|im_end|>\n<|im_start|>user\n"),
    (4, 0, "user", "q"), (4, 0, "user", "q"), (5, 0, None, "x"), (None, 0, "user", "u"), (None, 1, "assistant", "v"), (6, None, "we\nird<|", "\\|"), (7, 0, "user", "x" * 100_000), (7, 1, "assistant", "é😀" * 50_000),
]


def test_chat(spark):
    df = spark.createDataFrame([(*r, 1) for r in CONVERSATIONS], "conv_id long, turn long, role string, text string, loss int")
    got = {x.conv_id: x for x in chat.digest_conversations(df).collect()}
    groups = {}
    for c, t, r, x in CONVERSATIONS:
        groups.setdefault(c, []).append((-1 if t is None else t, r or "", x or ""))
    follow = chat.CHATML.follows
    assert got.keys() == groups.keys()
    for c, turns in groups.items():
        turns.sort()
        said = "".join(x for _, r, x in turns if r == "assistant")
        states = ["", *[r for _, r, _ in turns]]
        want = (len(turns), hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest())
        x = got[c]
        assert (x.n_turns, x.turns_sha256, x.loss_chars, x.loss_sha256) == want
        assert x.valid == (all(b in follow.get(a, ()) for a, b in zip(states, states[1:])) and states[-1] == "assistant")
        whole = "".join(s for _, r, t in turns for s, _ in chat.CHATML.segments(r, t))
        assert x.formatted_chars == len(whole) and chat.CHATML.parse(whole) == [(r, t) for _, r, t in turns]
    assert chat.digest_conversations(df.limit(0)).count() == 0


def slow_best_fit(pieces, capacity, per_source):
    bins, out = [], [0] * len(pieces)
    for i in sorted(range(len(pieces)), key=lambda k: -pieces[k][0]):
        size, source, cluster = pieces[i]
        fits = [(capacity - sum(p[0] for p in b), k) for k, b in enumerate(bins) if sum(p[0] for p in b) + size <= capacity and (capacity > sum(p[0] for p in b)) and not (cluster is not None and any(p[2] == cluster for p in b)) and not (source is not None and sum(p[1] == source for p in b) >= per_source)]
        k = min(fits)[1] if fits else len(bins)
        if k == len(bins):
            bins.append([])
        bins[k].append(pieces[i])
        out[i] = k
    return out


@pytest.mark.parametrize("seed", range(6))
def test_best_fit_equals_brute_force(seed):
    r = np.random.default_rng(seed)
    pieces = [(int(r.integers(0, 60)), None if r.random() < 0.1 else f"s{int(r.integers(0, 4))}", None if r.random() < 0.3 else int(r.integers(0, 12))) for _ in range(150)]
    assert packing.best_fit(pieces, 64, 2) == slow_best_fit(pieces, 64, 2)


def test_packing(spark):
    texts = TEXTS + ["the same text"] * 30 + ["word " * 9000]
    path = P.path("piece_bpe_32k.model")
    df = table(spark, texts).selectExpr("doc_id", "text", "case when doc_id % 3 = 0 then 'hot' when doc_id % 3 = 1 then null else 's' || (doc_id % 7) end source", "1 bin_id")
    got = packing.pack_documents(df, path, capacity=256).collect()
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    tokens, start = Counter(), {}
    for x in got:
        tokens[x.doc_id] += x.n_tokens
        start.setdefault(x.doc_id, []).append((x.start, x.n_tokens))
    assert tokens == Counter({i: len(library.encode(t or "")) for i, t in enumerate(texts)}) and set(tokens) == set(range(len(texts)))
    for parts in start.values():
        at = 0
        for a, n in sorted(parts):
            assert a == at
            at += n
    bins = {}
    for x in got:
        bins.setdefault(x.bin_id, []).append(x)
    for b in bins.values():
        assert sum(x.n_tokens for x in b) == b[0].bin_tokens <= 256
        folded = [(texts[x.doc_id] or "").lower() for x in b]
        assert len(set(folded)) == len(folded)
        assert all(n <= 2 for s, n in Counter(x.source for x in b).items() if s is not None)
    assert packing.pack_documents(df.limit(0), path).count() == 0


def test_equal_rows_spread_over_shards(spark):
    lengths = spark.range(3000).selectExpr("7L doc_id", "10L n_tokens", "'s' source", "5L cluster")
    got = packing.pack(lengths, capacity=64, shard_rows=300).collect()
    assert len(got) == 3000 and len({r.bin_id for r in got}) == 3000
    sizes = Counter(r.bin_id.split("-")[0] for r in got)
    assert len(sizes) == 10 and max(sizes.values()) < 400


def test_bins_depend_on_the_rows_alone(spark, monkeypatch):
    r = random.Random(3)
    rows = [(r.choice([None, r.randint(1, 400)]), r.randint(0, 90), r.choice(["a", "b", None]), r.choice([None, r.randint(0, 50)])) for _ in range(900)] + [(7, 5, "a", None)] * 40 + [(None, None, None, None)] * 23
    lengths = spark.createDataFrame(rows, "doc_id long, n_tokens long, source string, cluster long")
    text_ids = lengths.selectExpr("concat('d', doc_id) name", "n_tokens", "source", "cluster", "1 as piece", "2 as nth")
    results = []
    for n, run in ((2, 4096), (7, 4096), (5, 3)):
        monkeypatch.setattr(packing, "RUN", run)
        results.append(Counter(packing.pack(lengths.repartition(n), capacity=64, shard_rows=200).collect()))
        named = packing.pack(text_ids.repartition(n), capacity=64, shard_rows=200, id_col="name")
        assert named.columns[1] == "name" and Counter(x.name for x in named.where("piece = 0").collect()) == Counter(f"d{i}" if i is not None else None for i, *_ in rows)
    assert results[0] == results[1] == results[2]
    assert Counter(x.doc_id for x in results[0].elements() if x.piece == 0) == Counter(i for i, *_ in rows)


def hash_by_hand(rows):
    """The difference hash of a gray image, each of its 8 x 9 cells a sum of pixels by the share that lies in it."""
    from fractions import Fraction

    h, w = len(rows), len(rows[0])

    def cut(n, parts):
        edges = [Fraction(k * n, parts) for k in range(parts + 1)]
        return [[(i, min(Fraction(i + 1), b) - max(Fraction(i), a)) for i in range(int(a), -(-b.numerator // b.denominator)) if min(Fraction(i + 1), b) > max(Fraction(i), a)] for a, b in zip(edges, edges[1:])]

    ys, xs = cut(h, 8), cut(w, 9)
    area = Fraction(h * w, 72)
    cells = [[round(float(sum(fy * fx * int(rows[i][j]) for i, fy in y for j, fx in x) / area), 6) for x in xs] for y in ys]
    return int("".join("1" if b > a else "0" for line in cells for a, b in zip(line, line[1:])), 2)


def test_features_by_hand(spark):
    texts = [None, "", "short", "Σ ΑΣ İ ß é é " * 40, "ab" * 700, *[t for t in noise(12, size=1500)]]
    got = {x.doc_id: x.feature for x in media.text_media_table(table(spark, texts)).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        payload = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        rows = [payload[a : a + 24] for a in range(0, len(payload), 24)]
        mean = [[sum(payload[k * 576 + y * 24 + x] for k in range(len(payload) // 576)) for x in range(24)] for y in range(24)]
        assert got[i] == f"{hash_by_hand(rows):016x}{hash_by_hand(mean):016x}"
