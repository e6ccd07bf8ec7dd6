import math

import numpy as np
import pytest
from lumenpass.llm import embeddings


def by_hand(rows, cosine=0.93):
    good = [i for i, (_, v, lab) in enumerate(rows) if lab is not None and v and None not in v and all(map(math.isfinite, v)) and any(v)]
    n, root = [0] * len(rows), list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in good:
        for j in good:
            if j < i and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]):
                a, b = np.array(rows[i][1], np.float64), np.array(rows[j][1], np.float64)
                if a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= cosine:
                    n[i] += 1
                    n[j] += 1
                    root[find(i)] = find(j)
    low = {}
    for i, r in enumerate(rows):
        low.setdefault(find(i), []).append(r[0])
    return {r[0]: (n[i], min(low[find(i)]), r[0] == min(low[find(i)])) for i, r in enumerate(rows)}


def data():
    r = np.random.default_rng(4)
    base = r.normal(size=(60, 16)).astype(np.float32)
    rows = []
    for b in base:
        for _ in range(r.integers(1, 9)):
            rows.append([(b + 0.28 * r.normal(size=16)).astype(np.float32).tolist(), int(r.integers(0, 3))])
    hot = r.normal(size=16)
    rows += [[(hot + 0.05 * r.normal(size=16)).astype(np.float32).tolist(), 1] for _ in range(150)]
    rows += [[hot.astype(np.float32).tolist(), 1]] * 20
    rows += [[None, 1], [[], 1], [[0.0] * 16, 1], [[1.0, None] + [0.0] * 14, 1], [[float("nan")] + [1.0] * 15, 1], [[float("inf")] + [1.0] * 15, 1], [hot.astype(np.float32).tolist(), None], [[1.0, 2.0], 1], [[2.0, 4.0], 1]]
    return [(i, v, lab) for i, (v, lab) in enumerate(rows)]


@pytest.mark.parametrize("block", [40, 4096])
def test_against_brute_force(spark, block):
    rows = data()
    df = spark.createDataFrame([(*r, 5, "x") for r in rows], "vec_id long, embedding array<float>, label int, copies int, root string").repartition(3)
    got = embeddings.near_duplicates(df, cell_rows=20, block_rows=block).collect()
    assert {x.vec_id: (x.n_links, x.component_id, x.kept) for x in got} == by_hand(rows)


def test_links_across_cells_of_unequal_parts(spark):
    r = np.random.default_rng(2)
    a, b, *others = np.eye(24)
    x = [a + 0.03 * r.normal(size=24) for _ in range(100)] + [b + 0.03 * r.normal(size=24) for _ in range(400)]
    for _ in range(40):  # a hub on b's side of the plane that links with two on a's side, which don't link
        u, v = np.linalg.qr(r.normal(size=(22, 2)))[0].T @ others
        hub = 0.28 * (a + b) + 0.9 * u
        x += [hub + 0.07 * (b - a), hub + 0.07 * (a - b) + 0.28 * v, hub + 0.07 * (a - b) - 0.28 * v]
    rows = [(i, x[k].tolist(), 1) for i, k in enumerate(r.permutation(len(x)).tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3)
    # two cells: a's has one part, b's two
    got = embeddings.near_duplicates(df, cell_rows=300, block_rows=300).collect()
    assert {x.vec_id: (x.n_links, x.component_id, x.kept) for x in got} == by_hand(rows)


def test_small_tables(spark):
    kind = "vec_id long, embedding array<float>, label int"
    assert embeddings.near_duplicates(spark.createDataFrame([], kind)).count() == 0
    one = embeddings.near_duplicates(spark.createDataFrame([(None, [1.0, 2.0], 1), (4, [1.0, 2.0], 1), (4, [1.0, 2.0], 1)], kind)).collect()
    assert sorted((x.vec_id or -1, x.n_links, x.component_id, x.kept) for x in one) == [(-1, 2, 4, False), (4, 2, 4, True), (4, 2, 4, True)]


def test_extreme_doubles(spark):
    rows = [(1, [1e200, 1e200], 1), (2, [1e-200, 1.1e-200], 1), (3, [-1.0, 1.0], 1), (4, [0.0, -0.0], 1)]
    got = embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert {x.vec_id: (x.n_links, x.component_id) for x in got} == {1: (1, 1), 2: (1, 1), 3: (0, 3), 4: (0, 4)}


def test_cells_lose_no_partner():
    r = np.random.default_rng(9)
    x = r.normal(size=(800, 8))
    x = x + 3 * np.repeat(r.normal(size=(20, 8)), 40, axis=0)
    x /= np.linalg.norm(x, axis=1)[:, None]
    c = embeddings.spherical_kmeans(x[:300], 25)
    row, cell, home = embeddings.cells(x, c, 0.93)
    there = set(zip(row.tolist(), cell.tolist()))
    own = dict(zip(row[home].tolist(), cell[home].tolist()))
    a, b = np.nonzero(x @ x.T >= 0.93)
    assert all((i, own[j]) in there for i, j in zip(a.tolist(), b.tolist()))


def test_many_cells_in_two_levels():
    r = np.random.default_rng(4)
    x = embeddings.unit(np.repeat(r.normal(size=(800, 8)), 6, axis=0) + 0.05 * r.normal(size=(4800, 8)))
    c = embeddings.fit_cells(x, 600)
    assert 500 < len(c) < 700 and np.allclose(np.linalg.norm(c, axis=1), 1)
    whole, blocks = embeddings.cells(x, c, 0.93), embeddings.cells(x, c, 0.93, block=5000)
    assert all(np.array_equal(a, b) for a, b in zip(whole, blocks))
    row, cell, home = whole
    own = np.empty(len(x), int)
    own[row[home]] = cell[home]
    seen = np.zeros((len(x), len(c)), bool)
    seen[row, cell] = True
    i, j = np.nonzero(x @ x.T >= 0.93)
    assert seen[i, own[j]].all() and seen.mean() < 0.9
    assert len(embeddings.cells(x[:0], c, 0.93)[0]) == 0
