import random

import numpy as np
import xxhash
from helpers import ODD, noise, table
from lumenpass.llm import simhash
from lumenpass.llm.common import components


def plain(text):
    words = [w for w in (text or "").encode().lower().split()]
    if not words:
        return 0
    if len(words) < 4:
        grams = [b" ".join(words)]
    else:
        grams = [b" ".join(words[i : i + 4]) for i in range(len(words) - 3)]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def by_hand(ids, fps, radius=4):
    n = len(fps)
    root = list(range(n))
    near = [0] * n

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(n):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= radius:
                near[i] += 1
                near[j] += 1
                root[find(i)] = find(j)
    low = {}
    for i in range(n):
        low.setdefault(find(i), []).append(ids[i])
    return {ids[i]: (near[i], min(low[find(i)])) for i in range(n)}


def test_whole_table(spark):
    r = random.Random(3)
    base = [" ".join(r.choice("abcdefghijklmnop") + r.choice("xyz") for _ in range(r.randint(1, 300))) for _ in range(60)]
    texts = ODD + noise(50) + base
    for b in base[:20]:
        w = b.split()
        w[len(w) // 2] = "changed"
        texts += [" ".join(w), b.upper()]
    fps = [plain(t) for t in texts]
    want = by_hand(list(range(len(texts))), fps)
    got = simhash.simhash_table(table(spark, texts)).collect()
    assert {x.doc_id: (x.n_near, x.component_id) for x in got} == want
    assert {x.doc_id: x.fingerprint for x in got} == {i: f"{f:016x}" for i, f in enumerate(fps)}
    assert simhash.simhash_table(table(spark, []).limit(0)).count() == 0
    kept = simhash.keep_one_of_each(table(spark, texts)).collect()
    assert sorted(x.doc_id for x in kept) == sorted({c for _, c in want.values()})


def test_repeated_and_missing_ids_keep_one_of_each(spark):
    r = random.Random(8)
    a, b, c, d, x, y = (" ".join(r.choice("abcdefghijklmnop") + r.choice("xyz") for _ in range(200)) for _ in range(6))

    def near(text):
        w = text.split()
        for k in range(len(w)):
            other = " ".join([*w[:k], "changed", *w[k + 1 :]])
            if 0 < bin(plain(other) ^ plain(text)).count("1") <= 4:
                return other

    rows = [(5, a), (5, near(a)), (5, b), (3, b.upper()), (7, c), (7, c), (None, d), (9, d), (None, x), (None, near(x)), (None, x), (None, y)]
    assert None not in [t for _, t in rows]
    docs = spark.createDataFrame([(i, t, k, None) for k, (i, t) in enumerate(rows)], "doc_id long, text string, n_tokens int, component_id string").repartition(3)
    kept = simhash.keep_one_of_each(docs)
    assert kept.columns == docs.columns
    first = lambda t: min(t, near(t), key=lambda v: np.uint64(plain(v)).view(np.int64))
    want = [(5, first(a)), (3, b.upper()), (7, c), (9, d), (None, first(x)), (None, y)]
    assert sorted(((k.doc_id, k.text) for k in kept.collect()), key=repr) == sorted(want, key=repr)


def test_forest_finds_every_pair(spark):
    r = np.random.default_rng(5)
    base = r.integers(0, 2**63, 40).astype(np.uint64)
    fps = []
    for b in base:
        for _ in range(40):
            x = int(b)
            for k in r.integers(0, 64, r.integers(0, 7)):
                x ^= 1 << int(k)
            fps.append(x)
    fps = sorted(set(fps))
    want = by_hand(list(range(len(fps))), fps)
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    marked = spark.createDataFrame(list(enumerate(signed)), "doc_id long, fp long")
    for parts, rows in ((3, 50), (1, 50), (5, 10), (3, 10**6)):
        got = {x.fp: (x.n_near, x.component_id) for x in simhash.near_duplicates(marked, parts=parts, shard_rows=rows, least_sample=300).collect()}
        assert got == {f: want[i] for i, f in enumerate(signed)}


def clustered(n=3, size=300, seed=6):
    r = np.random.default_rng(seed)
    one = np.uint64(1)
    fp = np.concatenate([r.integers(0, 2**63, 1).astype(np.uint64) ^ (one << r.integers(20, 40, size).astype(np.uint64)) for _ in range(n)] + [r.integers(0, 2**63, 500).astype(np.uint64)])
    return np.unique(np.concatenate([fp, *[fp ^ (one << np.uint64(k)) for k in range(20, 30)]]))


def test_walks_lose_nothing():
    fp = clustered()
    near = np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 4
    every = np.ones(len(fp), bool)
    for parts in (1, 2, 3, 5):
        masks = simhash.stretches(parts)
        assert sum(masks) == 2**64 - 1
        got = np.zeros_like(near, int)
        for k in range(parts):
            for i, j, _ in simhash.pairs_within(fp, np.flatnonzero(every), np.flatnonzero(every), k, masks, 4, leaf=7, tile=500):
                np.add.at(got, (i, j), 1)
        assert np.array_equal(got, near & ~np.eye(len(fp), dtype=bool))


def test_shards_overlap_just_enough():
    fp = clustered(2, 100)
    for parts in (1, 3):
        for mask in simhash.stretches(parts):
            tree = simhash.build_tree(np.random.default_rng(1).permutation(fp)[:200], mask, 20)
            row, leaf, home = simhash.route(fp, mask, tree, 4 // parts)
            assert np.array_equal(np.sort(row[home]), np.arange(len(fp))) and len(set(zip(row, leaf))) == len(row) and len(set(leaf)) > 3
            own = np.empty(len(fp), int)
            own[row[home]] = leaf[home]
            seen = np.zeros((len(fp), leaf.max() + 1), bool)
            seen[row, leaf] = True
            i, j = np.nonzero(np.bitwise_count((fp[:, None] ^ fp[None, :]) & np.uint64(mask)) <= 4 // parts)
            assert seen[i, own[j]].all() and not seen.all()


def test_components_both_ways(spark):
    r = random.Random(2)
    pairs = [(i, i + 1) for i in range(0, 60)] + [(100 + r.randint(0, 80), 100 + r.randint(0, 80)) for _ in range(60)] + [(500, 500 + k) for k in range(40)] + [(900, 900)]
    edges = spark.createDataFrame(pairs + [(None, 3)], "a long, b long")
    one = sorted(map(tuple, components(edges).collect()))
    many = sorted(map(tuple, components(edges, one_task_edges=0).collect()))
    assert one == many and dict(one)[60] == 0 and dict(one)[900] == 900


def test_release(spark):
    import os

    from lumenpass.sources import work as common

    df = common.written(spark.range(3), "t")
    path = common._PATHS[-1].removeprefix("file://")
    assert df.count() == 3 and os.path.isdir(path)
    common.release(spark)
    assert not os.path.exists(path) and not common._PATHS
