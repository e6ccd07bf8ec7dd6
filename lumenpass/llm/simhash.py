"""SimHash near-dedup by vantage-point trees.

Fingerprints are compared once each, copies only counted. Two that differ in at most ``radius`` bits differ in at most
``radius // parts`` bits of at least one of ``parts`` stretches of the 64 bits, and each stretch has a vantage-point
tree over the Hamming distance of its bits (one stretch: the plain tree over all 64 bits). A node parts what it holds
by the distance to its vantage point; the leaves of the tree's top, grown from a sample, are the shards. A fingerprint
is at home in one shard and visits every shard whose boundary lies within the search radius: the triangle bound prunes
all other branches. In a shard the tree grows on over the homes, and the visitors walk down it under the same bound to
leaves that are compared in full; a run that the stretch can't part is parted by the distance of all bits. Every
ordered pair within the radius is met exactly once: in the home of the second, in the first stretch that finds it.

Two stretches or more are cheaper than one: distances of random fingerprints crowd around half of the bits, and the
shell that both branches must search holds 68 % of them for 4 of 64 bits, but 34 % for 1 of 21.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from lumenpass.llm.common import components, fresh, per_text, roots_of, small_batches, written

SEED = 42


def hashes(text: str, words: int = 4) -> list[int]:
    """XXH64 of the shingles of a text."""
    from xxhash import xxh64_intdigest

    parts = text.encode("utf-8").lower().split()
    if not parts:
        return []
    whole = b" ".join(parts)
    if len(parts) <= words:
        return [xxh64_intdigest(whole, SEED)]
    ends = list(accumulate(map(len, parts), lambda a, b: a + b + 1))
    starts = [0, *[e + 1 for e in ends]]
    return [xxh64_intdigest(whole[a:z], SEED) for a, z in zip(starts, ends[words - 1 :])]


def majority(groups: list[list[int]]) -> np.ndarray:
    """For each list of 64-bit hashes the bits set in over half of them; 0 for an empty list."""
    out = np.zeros(len(groups), np.uint64)
    n = np.array([len(g) for g in groups], np.int64)
    full = np.flatnonzero(n)
    if not len(full):
        return out
    h = np.array([x for g in groups for x in g], np.uint64)
    size = n[full]
    # Eight bit lanes of a byte each: a run of at most 255 hashes can't overflow a lane.
    runs = -(-size // 255)
    first = np.repeat(np.cumsum(size) - size, runs)
    nth = np.arange(runs.sum()) - np.repeat(np.cumsum(runs) - runs, runs)
    start, begin = first + 255 * nth, np.cumsum(runs) - runs
    ones = np.uint64(0x0101010101010101)
    for k in range(8):
        lanes = np.add.reduceat(h >> np.uint64(k) & ones, start)
        counts = np.add.reduceat(lanes.astype("<u8").view(np.uint8).reshape(-1, 8).astype(np.int64), begin, axis=0)
        for lane in range(8):
            out[full] |= (2 * counts[:, lane] > size).astype(np.uint64) << np.uint64(8 * lane + k)
    return out


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4) -> DataFrame:
    """(id, fp long): one pass over the whole texts, no shuffle; null and blank texts have fingerprint 0."""
    return per_text(df, id_col, text_col, "fp long", lambda: lambda texts: (majority([hashes(t, words) for t in texts]).view(np.int64),))


def with_fingerprints(df: DataFrame, name: str = "__fp", text_col: str = "text", words: int = 4) -> DataFrame:
    """The whole rows and their fingerprint as column ``name``."""
    small_batches(df.sparkSession)
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = majority([hashes(t or "", words) for t in b.column(at).to_pylist()]).view(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(fp)], names=[*b.schema.names, name])

    return df.mapInArrow(run, StructType([*df.schema.fields, StructField(name, LongType())]))


def stretches(parts: int) -> list[int]:
    """Masks of stretches that cover 64 bits."""
    cuts = [64 * k // parts for k in range(parts + 1)]
    return [(1 << z) - (1 << a) for a, z in zip(cuts, cuts[1:])]


def parted(d: np.ndarray) -> int | None:
    """The bound next to the median that leaves some of the distances on either side; None if all are equal."""
    low, high = int(d.min()), int(d.max())
    return None if low == high else min(max(int(np.median(d)), low), high - 1)


def build_tree(sample: np.ndarray, mask: int, leaf: int) -> np.ndarray:
    """Nodes (vantage, bound, inner, outer), one a column, over a sample; a negative child -1 - k is leaf k."""
    nodes: list[list[int]] = []
    leaves = 0
    todo = [(sample & np.uint64(mask), -1, 0)]
    while todo:
        values, parent, side = todo.pop()
        bound = parted(d := np.bitwise_count(values ^ values[0])) if len(values) > leaf else None
        if bound is None:
            leaves += 1
            child = -leaves
        else:
            child = len(nodes)
            nodes.append([int(values[0].astype(np.int64)), bound, 0, 0])
            todo += [(values[d <= bound], child, 2), (values[d > bound], child, 3)]
        if parent >= 0:
            nodes[parent][side] = child
    return np.array(nodes, np.int64).reshape(-1, 4).T.copy()


def route(values: np.ndarray, mask: int, tree: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, leaf, is home): each value's own leaf, and the leaves whose boundary is within ``radius`` of it."""
    row, at, home = np.arange(len(values)), np.zeros(len(values), np.int64), np.ones(len(values), bool)
    if not tree.shape[1]:
        return row, at, home
    vantage, bound, inner, outer = tree[0].view(np.uint64), tree[1], tree[2], tree[3]
    x = values & np.uint64(mask)
    done = []
    while len(row):
        d, b = np.bitwise_count(x[row] ^ vantage[at]).astype(np.int64), bound[at]
        near, far = d - radius <= b, d + radius > b
        own = d <= b
        row, at, home = np.concatenate([row[near], row[far]]), np.concatenate([inner[at[near]], outer[at[far]]]), np.concatenate([(home & own)[near], (home & ~own)[far]])
        end = at < 0
        done.append((row[end], -1 - at[end], home[end]))
        row, at, home = row[~end], at[~end], home[~end]
    return tuple(np.concatenate(c) for c in zip(*done))


def pairs_within(fp: np.ndarray, query: np.ndarray, home: np.ndarray, k: int, masks: list[int], radius: int, leaf: int = 64, tile: int = 1 << 21) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(queries, homes, pairs compared) of linked pairs of rows, each ordered pair once, that stretch ``k`` finds first."""
    inside = radius // len(masks)
    mask, earlier = np.uint64(masks[k]), [np.uint64(m) for m in masks[:k]]
    todo = [(query, home)]
    while todo:
        q, h = todo.pop()
        if not len(q) or not len(h):
            continue
        if len(h) > leaf:
            cut = None
            for bits, r in ((mask, inside), (np.uint64(2**64 - 1), radius)):
                d = np.bitwise_count((fp[h] ^ fp[h[0]]) & bits).astype(np.int64)
                if (cut := parted(d)) is not None:
                    e = np.bitwise_count((fp[q] ^ fp[h[0]]) & bits).astype(np.int64)
                    todo += [(q[e - r <= cut], h[d <= cut]), (q[e + r > cut], h[d > cut])]
                    break
            if cut is not None:
                continue
        step = max(1, tile // len(h))
        for a in range(0, len(q), step):
            left = q[a : a + step]
            x = fp[left][:, None] ^ fp[h][None, :]
            i, j = np.nonzero(np.bitwise_count(x) <= radius)
            bits = x[i, j]
            keep = (bits != 0) & (np.bitwise_count(bits & mask) <= inside)
            for m in earlier:
                keep &= np.bitwise_count(bits & m) > inside
            yield left[i[keep]], h[j[keep]], x.size


def links(fp: np.ndarray, weight: np.ndarray, query: np.ndarray, home: np.ndarray, k: int, masks: list[int], radius: int, leaf: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """(weight of the homes that each row links with as a query, smallest row that each is connected with in this task)."""
    total, root = np.zeros(len(fp), np.int64), np.arange(len(fp))
    edges, held = [], 0

    def merge() -> None:
        nonlocal edges, held
        if edges:
            node, low = roots_of(np.concatenate([e[0] for e in edges]), np.concatenate([e[1] for e in edges]))
            edges, held = [(node, low)], len(node)

    for i, j, _ in pairs_within(fp, np.flatnonzero(query), np.flatnonzero(home), k, masks, radius, leaf):
        if len(i):
            np.add.at(total, i, weight[j])
            edges.append((i, j))
            held += len(i)
            if held > max(1 << 20, 4 * len(fp)):
                merge()
    merge()
    if edges:
        root[edges[0][0]] = edges[0][1]
    return total, root


def near_duplicates(marked: DataFrame, radius: int = 4, parts: int = 3, shard_rows: int = 131072, least_sample: int = 16384, id_col: str = "doc_id", name: str = "n_near") -> DataFrame:
    """(fp, copies, n_near, component_id, root) for each distinct fingerprint of ``marked`` (id, fp).

    ``n_near`` counts the other documents within ``radius`` bits of one with this fingerprint (its copies included);
    ``component_id`` is the smallest id reachable by links, null where no row has one; ``root`` is the smallest
    fingerprint reachable. Only counts and spanning forests leave a task, never all pairs. The tops of the trees are
    grown from a sample of 16 fingerprints for each shard of ``shard_rows`` (at least ``least_sample``): it is an
    8,192th of the fingerprints, and only decides the cost. A shard that holds more rows is cut into salted parts, of
    which each meets each in a task of its own.
    """
    spark = marked.sparkSession
    masks, inside = stretches(parts), radius // parts
    distinct = written(marked.groupBy("fp").agg(F.count("*").alias("copies"), F.min(id_col).alias("low")), "fingerprints")
    n = distinct.count()
    rows = max(least_sample, 16 * n // shard_rows)
    if n > 2 * rows:  # by the hash, so that a job that runs again grows the same trees
        chosen = distinct.where(F.pmod(F.xxhash64("fp", F.lit(9)), F.lit(n // rows)) == 0)
    else:
        chosen = distinct
    sample = np.sort(chosen.select("fp").toArrow().column(0).to_numpy()).view(np.uint64)
    sample = np.random.default_rng(3).permutation(sample)
    leaf = max(4, len(sample) * shard_rows // (2 * max(1, n)))
    trees = [build_tree(sample, m, leaf) for m in masks]

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp, copies = b.column(0).to_numpy(), b.column(1).to_numpy()
            for k, mask in enumerate(masks):
                row, at, home = route(fp.view(np.uint64), mask, trees[k], inside)
                yield pa.RecordBatch.from_arrays([pa.array(at * parts + k), pa.array(fp[row]), pa.array(copies[row]), pa.array(home)], names=["shard", "fp", "copies", "home"])

    placed = written(distinct.select("fp", "copies").mapInArrow(spread, "shard long, fp long, copies long, home boolean"), "placed")
    large = placed.groupBy("shard").agg(F.ceil(F.count("*") / (4 * shard_rows)).cast("int").alias("cuts")).where("cuts > 1")
    salted = placed.join(large, "shard", "left").withColumn("cuts", F.coalesce("cuts", F.lit(1))).withColumn("salt", F.pmod(F.xxhash64("fp", F.lit(7)), F.col("cuts")).cast("int"))
    # task (q, h) compares the rows of part q with the homes of part h
    every = F.sequence(F.lit(0), F.col("cuts") - 1)
    asks = F.transform(every, lambda h: F.struct(F.col("salt").alias("q"), h.alias("h"), F.lit(True).alias("query"), (F.col("home") & (h == F.col("salt"))).alias("at_home")))
    answers = F.transform(F.filter(every, lambda q: F.col("home") & (q != F.col("salt"))), lambda q: F.struct(q.alias("q"), F.col("salt").alias("h"), F.lit(False).alias("query"), F.lit(True).alias("at_home")))
    tasks = salted.select("shard", "fp", "copies", F.explode(F.concat(asks, answers)).alias("t")).select("shard", "t.q", "t.h", "t.query", "t.at_home", "fp", "copies")

    def compare(key: tuple, table: pa.Table) -> pa.Table:
        fp, query, home = (table[c].to_numpy() for c in ("fp", "query", "at_home"))
        total, root = links(fp.view(np.uint64), table["copies"].to_numpy(), query, home, key[0].as_py() % parts, masks, radius)
        # both ends of every link leave with the task's root, so that the tasks' trees together span all links
        linked = np.isin(root, root[root != np.arange(len(root))])
        return pa.table({"fp": fp[linked], "near": total[linked], "root": fp[root[linked]]})

    found = written(tasks.groupBy("shard", "q", "h").applyInArrow(compare, "fp long, near long, root long"), "links")
    near = found.groupBy("fp").agg(F.sum("near").alias("near"))
    roots = components(found.select(F.col("fp").alias("a"), F.col("root").alias("b"))).select(F.col("node").alias("fp"), "root")
    joined = distinct.join(near, "fp", "left").join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    lowest = joined.groupBy("root").agg(F.min("low").alias("component_id"))
    return joined.join(lowest, "root").select("fp", "copies", (F.col("copies") - 1 + F.coalesce("near", F.lit(0))).alias(name), "component_id", "root")


def simhash_table(df: DataFrame, radius: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint, n_near, component_id): a row for each row of ``df``.

    Null and blank texts have fingerprint 0 and link with each other like any others. Repeated rows count as further
    documents; a row without an id counts as a document but its id is nobody's component. Very long texts are read
    whole; other columns are not read, whatever their names. An empty table gives none.
    """
    marked = written(fingerprints(df, id_col, text_col), "simhash")
    stats = near_duplicates(marked, radius, id_col=id_col)
    return marked.join(stats, "fp").select(id_col, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "n_near", "component_id")


def keep_one_of_each(df: DataFrame, radius: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``df`` for each component of linked documents, with all its columns.

    It is the row with the smallest id; rows without an id come after all others; of rows that repeat that id the one
    with the smallest fingerprint, then by the hash of its text. So of rows that repeat id and text one is kept, and
    rows that share an id, or have none, but not a component are all kept. Null and blank texts are one component. An
    empty table gives none; other columns may have any name.
    """
    fp, row, text_hash = (fresh(df, c) for c in ("__fp", "__row", "__hash"))
    # the whole rows are written with their fingerprints, so that texts are read and hashed once
    whole = written(with_fingerprints(df, fp, text_col).withColumn(text_hash, F.xxhash64(F.col(text_col))).withColumn(row, F.monotonically_increasing_id()), "fingerprinted")
    marked = whole.select(F.col(id_col).alias("id"), F.col(fp).alias("fp"), F.col(text_hash).alias("hash"), F.col(row).alias("row"))
    stats = near_duplicates(marked, radius, id_col="id").select("fp", "root")
    first = F.struct(F.col("id").isNull(), "id", "fp", "hash", "row")
    kept = marked.join(stats, "fp").groupBy("root").agg(F.min(first).alias("first")).select(F.col("first.row").alias(row))
    # both sides grow with the corpus: one shuffle of the texts, at any size
    return whole.join(kept.hint("merge"), row, "left_semi").select(*df.columns)
