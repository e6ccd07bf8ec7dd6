"""Toxicity by weak supervision: many lexicon and pattern voters, a generative label model, a linear classifier.

Lexicons are induced from a bounded sample of labelled rows: words and beginnings of words whose odds of standing in a
toxic text are raised beyond chance, parted into voters by kind and strength, beside small seed lists and patterns of
punctuation. From there on no known label is used. The label model is a tree over the voters for each class: every
voter depends on the hidden class (its accuracy) and on one other voter (their correlation); expectation maximisation
estimates both, starting from what the voters' tiers are believed at, and the tree is the one of greatest mutual
information given the class. A logistic regression over voters and lexicon entries is trained on its posteriors alone.
"""

from __future__ import annotations

import pickle
import re
from collections import Counter
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenpass.llm.bpe import Memory
from lumenpass.llm.common import per_text, small_batches, written
from lumenpass.llm.quality import keep_good

WORD = re.compile(r"[^\W\d_]+")
KINDS = ("w", "4", "5", "6")
#: Bounds, in standard deviations, of the evidence that a key stands in toxic texts more often than by chance.
TIERS = (5.0, 6.5, 10.0, 16.0)
SEEDS = {
    "en": "idiot idiots moron morons stupid dumb loser losers pathetic worthless scum trash garbage disgusting clown filthy vermin hate kill ugly fool",
    "de": "idiot idioten dumm dummkopf blöd abschaum versager müll ekelhaft erbärmlich wertlos hässlich arschloch",
    "fr": "idiot idiote imbécile stupide crétin ordure déchet pathétique dégoûtant minable nul abruti con",
    "es": "idiota estúpido estúpida imbécil basura escoria patético asqueroso inútil payaso tonto perdedor",
}
SEED_OF = {w: k for k, words in enumerate(SEEDS.values()) for w in words.split()}
N_LEXICON = len(KINDS) * len(TIERS)
N_SEED = len(SEEDS)
#: Votes: each lexicon voter at one hit in 200 words, and at two or more that are one in 100; each seed list, four patterns.
N_VOTES = 2 * N_LEXICON + N_SEED + 4


def keys_of(word: str) -> list[str]:
    return ["w" + word, *[k + word[: int(k)] for k in KINDS[1:] if len(word) > int(k)]]


def words_of(text: str) -> set[str]:
    return set(WORD.findall(text.lower()))


def hits_of(lexicon: dict[str, tuple[int, int]], unit: str) -> tuple:
    """(voter, entry) of each hit among the words of a stretch without white space; entry -1 for a seed."""
    out = []
    for w in WORD.findall(unit):
        out += [hit for k in keys_of(w) if (hit := lexicon.get(k))]
        if w in SEED_OF:
            out.append((N_LEXICON + SEED_OF[w], -1))
    return tuple(out)


#: A worker remembers the hits of words for one lexicon, through all the tasks that bring it.
_REMEMBERED: dict[int, Memory] = {}


class Voters:
    """The lexicon {key: (voter, index)} and the votes it and the patterns cast."""

    def __init__(self, lexicon: dict[str, tuple[int, int]]):
        self.lexicon = lexicon
        key = xxhash.xxh64_intdigest(repr(sorted(lexicon.items())))
        if key not in _REMEMBERED:
            _REMEMBERED.clear()
            _REMEMBERED[key] = Memory(partial(hits_of, lexicon), 400_000)
        self.memory = _REMEMBERED[key]

    def __getstate__(self):
        return self.lexicon

    def __setstate__(self, lexicon):
        self.__init__(lexicon)

    def read(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(votes, dense features, rows, entries and counts of lexicon hits)."""
        counts = np.zeros((len(texts), N_LEXICON + N_SEED))
        n_words = np.zeros(len(texts))
        pattern = np.zeros((len(texts), 4))
        row, entry, count = [], [], []
        get = self.memory.__getitem__
        for i, text in enumerate(texts):
            units = text.lower().split()
            n_words[i] = len(units)
            found = Counter(hit for hits in filter(None, map(get, units)) for hit in hits)
            for (voter, k), n in found.items():
                counts[i, voter] += n
                if k >= 0:
                    row.append(i)
                    entry.append(k)
                    count.append(n)
            size = max(1, len(text))
            pattern[i] = text.count("!") / size, text.count("?") / size, text.count("*") / size, "!!!" in text
        hits, long = counts[:, :N_LEXICON], np.maximum(1, n_words)[:, None]
        votes = np.concatenate([200 * hits >= long, (hits >= 2) & (100 * hits >= long), counts[:, N_LEXICON:] >= 1, pattern > [0.02, 0.02, 0.02, 0.5]], axis=1).astype(np.float64)
        share = np.minimum(1.0, 100 * counts / np.maximum(20, n_words)[:, None])
        dense = np.concatenate([votes, np.log1p(counts), share, np.log1p(n_words)[:, None] / 8], axis=1)
        return votes, dense, np.array(row, np.int64), np.array(entry, np.int64), np.array(count, np.float64)


#: What votes are believed at before anything is estimated: log odds by tier of one hit and of dense ones, of seeds, patterns.
BELIEVED = np.concatenate([np.tile(np.log([1.5, 2, 4, 8]) / 2, len(KINDS)), np.tile(np.log([2, 4, 8, 8]) / 2, len(KINDS)), np.ones(N_SEED), np.zeros(4)])
BELIEVED_PRIOR = -3.0
EM_ROUNDS = 1


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def best_tree(gain: np.ndarray) -> np.ndarray:
    """The parent of each node in the tree of greatest total gain, from node 0 (whose parent is -1)."""
    m = len(gain)
    parent, best, inside = np.full(m, -1), np.full(m, -np.inf), np.zeros(m, bool)
    near, at = np.full(m, -1), 0
    for _ in range(m - 1):
        inside[at] = True
        better = (gain[at] > best) & ~inside
        best[better], near[better] = gain[at][better], at
        at = int(np.where(inside, -np.inf, best).argmax())
        parent[at] = near[at]
    return parent


class LabelModel:
    """P(toxic | votes) from P(vote | class, vote of one other voter), estimated without labels."""

    def fit(self, votes: np.ndarray, start: np.ndarray, rounds: int = 60, grown: int = 8) -> np.ndarray:
        """Expectation maximisation from first guesses; the tree stays after ``grown`` rounds. Returns posteriors."""
        n, m = votes.shape
        q = np.clip(start.astype(np.float64), 0.01, 0.99)
        each = np.arange(m)
        for t in range(rounds):
            w = np.stack([1 - q, q])
            total = w.sum(axis=1)
            self.prior = np.log((total + 1) / (n + 2))
            one = w @ votes
            both = np.stack([(votes * c[:, None]).T @ votes for c in w])
            if t < grown:
                self.parent = best_tree(sum(self.information(both[c], one[c], total[c]) for c in (0, 1)))
            up, root = np.maximum(self.parent, 0), self.parent < 0
            rate = (one + 0.5) / (total[:, None] + 1)
            # as if four more rows had been seen that don't depend on the other voter
            yes = (both[:, each, up] + 4 * rate) / (one[:, up] + 4)
            no = (one - both[:, each, up] + 4 * rate) / (total[:, None] - one[:, up] + 4)
            yes[:, root] = no[:, root] = rate[:, root]
            self.rate, self.given_yes, self.given_no = (np.clip(x, 1e-4, 1 - 1e-4) for x in (rate, yes, no))
            before, q = q, self.posterior(votes)
            if np.abs(q - before).max(initial=0.0) < 1e-4:
                break
        return q

    @staticmethod
    def information(both: np.ndarray, one: np.ndarray, total: float) -> np.ndarray:
        """Mutual information of each two voters within a class, times its weight."""
        a, b = one[:, None], one[None, :]
        out = np.zeros_like(both)
        for joint, x, y in ((both, a, b), (a - both, a, total - b), (b - both, total - a, b), (total - a - b + both, total - a, total - b)):
            joint = np.maximum(joint, 1e-9)
            out += joint * np.log(joint * total / np.maximum(x * y, 1e-9))
        return out

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        seen = votes[:, np.maximum(self.parent, 0)] > 0
        chance = np.where(seen, self.given_yes[:, None], self.given_no[:, None])
        each = np.where(votes > 0, np.log(chance), np.log1p(-chance)).sum(axis=2) + self.prior[:, None]
        return sigmoid(each[1] - each[0])


class Toxicity:
    """The fitted whole: voters, label model, weights of dense features and lexicon entries."""

    def __init__(self, lexicon: dict[str, tuple[int, int]], constant: float = -4.0):
        self.voters = Voters(lexicon)
        self.labels = LabelModel()
        self.dense = np.zeros(0)
        self.sparse = np.zeros(len(lexicon))
        self.bias, self.constant = 0.0, constant

    def margin(self, dense: np.ndarray, row: np.ndarray, entry: np.ndarray, count: np.ndarray) -> np.ndarray:
        return self.bias + dense @ self.dense + np.bincount(row, self.sparse[entry] * count, len(dense))

    def score(self, texts: list[str]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        if not len(self.dense):
            return np.full(len(texts), sigmoid(np.array(self.constant)))
        return sigmoid(self.margin(*self.voters.read(texts)[1:]))

    def fit(self, votes: np.ndarray, dense: np.ndarray, row: np.ndarray, entry: np.ndarray, count: np.ndarray, rounds: int = 300) -> np.ndarray:
        """Trains on the label model's posteriors, which it returns; no known label comes in."""
        # one round: later ones may leave toxicity for whatever else parts the votes best, such as a language
        target = self.labels.fit(votes, sigmoid(votes @ BELIEVED + BELIEVED_PRIOR), rounds=EM_ROUNDS)
        # the rarer class weighs more, by what the posteriors say of its size
        weight = 1 + target * (np.sqrt((1 - target).sum() / max(1.0, target.sum())) - 1)
        d, k = dense.shape[1], len(self.sparse)
        decay = np.concatenate([[0], np.full(d, 1e-4), np.full(k, 1e-3)])
        x = np.zeros(1 + d + k)
        m, v = np.zeros_like(x), np.zeros_like(x)
        for t in range(1, rounds + 1):
            self.bias, self.dense, self.sparse = x[0], x[1 : 1 + d], x[1 + d :]
            g = self.gradient(target, weight, dense, row, entry, count) - decay * x
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            x = x + 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        self.bias, self.dense, self.sparse = x[0], x[1 : 1 + d], x[1 + d :]
        return target

    def gradient(self, target: np.ndarray, weight: np.ndarray, dense: np.ndarray, row: np.ndarray, entry: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Of the weighted mean log likelihood of the targets, by bias, dense and sparse weights."""
        miss = (target - sigmoid(self.margin(dense, row, entry, count))) * weight
        return np.concatenate([[miss.sum()], miss @ dense, np.bincount(entry, miss[row] * count, len(self.sparse))]) / weight.sum()


def evidence(a: int, b: int, n_toxic: int, n_clean: int) -> float:
    """Root of the log-likelihood ratio of a key in ``a`` toxic and ``b`` clean texts; 0 if it isn't raised in toxic ones."""
    n = n_toxic + n_clean
    if a * n <= (a + b) * n_toxic:
        return 0.0
    ratio = a * np.log(a * n / ((a + b) * n_toxic)) + (b * np.log(b * n / ((a + b) * n_clean)) if b else 0.0)
    return float(np.sqrt(max(0.0, 2 * ratio)))


def induce(counts: list[tuple[str, int, int]], n_toxic: int, n_clean: int) -> dict[str, tuple[int, int]]:
    """{key: (voter, index)} of keys whose log odds exceed chance by the first tier's deviations."""
    out = {}
    for key, a, b in sorted(counts):
        if (z := evidence(a, b, n_toxic, n_clean)) >= TIERS[0]:
            tier = sum(z >= t for t in TIERS) - 1
            out[key] = (KINDS.index(key[0]) * len(TIERS) + tier, len(out))
    return out


FEATURES = "key long, votes binary, dense binary, entry binary, count binary"


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = 12000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", fold: int = 5, out: int | None = 0) -> Toxicity:
    """Fit on at most ``sample_rows`` labelled rows (a documented bound; chosen by the hash of the id).

    Rows with crc32(id as text) mod ``fold`` equal to ``out`` are never used; null ids, labels or texts neither. Keys
    are counted with a shuffle of partial counts, and those whose evidence reaches the first tier make the lexicon;
    known labels do no more than that. Votes and hits are read where the texts are, so that what the one fitting task
    holds is bounded by rows, not by their length. Without both labels every text scores the one there is.
    """
    spark = docs.sparkSession
    small_batches(spark)
    usable = labels.select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("__y")).where("__id is not null and __y in (0, 1)")
    if out is not None:
        usable = usable.where(F.crc32(F.col("__id").cast("string")) % fold != out)
    chosen = usable.dropDuplicates(["__id"]).orderBy(F.xxhash64("__id"), "__id").limit(sample_rows)
    held = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).where("__text is not null")
    sample = written(held.join(F.broadcast(chosen), "__id").select("__y", "__text"), "toxic-sample")  # at most sample_rows ids are broadcast
    sizes = {r[0]: r[1] for r in sample.groupBy("__y").count().collect()}
    if len(sizes) < 2:
        return Toxicity({}, constant=4.0 if 1 in sizes else -4.0)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen = (Counter(), Counter())
            for y, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                seen[y].update({k for w in words_of(text) for k in keys_of(w)})
            keys = list(seen[0].keys() | seen[1].keys())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([seen[1][k] for k in keys], pa.int64()), pa.array([seen[0][k] for k in keys], pa.int64())], names=["key", "toxic", "clean"])

    counted = sample.mapInArrow(count, "key string, toxic long, clean long").groupBy("key").agg(F.sum("toxic").alias("a"), F.sum("clean").alias("b"))
    a, b, n = F.col("a"), F.col("b"), F.lit(float(sizes[0] + sizes[1]))
    ratio = a * F.log(a * n / ((a + b) * sizes[1])) + F.when(b > 0, b * F.log(b * n / ((a + b) * sizes[0]))).otherwise(0.0)
    # a little below the first tier, whose exact line ``induce`` draws
    raised = counted.where(a * n > (a + b) * sizes[1]).where(2 * ratio >= 0.99 * TIERS[0] ** 2)
    lexicon = induce([(r[0], r[1], r[2]) for r in raised.select("key", "a", "b").collect()], sizes[1], sizes[0])

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voters = Voters(lexicon)
        for b in batches:
            texts = b.column(0).to_pylist()
            votes, dense, row, entry, times = voters.read(texts)
            cut = np.searchsorted(row, np.arange(1, len(texts)))
            parts = [[x.tobytes() for x in votes.astype("i1")], [x.tobytes() for x in dense.astype("<f8")], [x.tobytes() for x in np.split(entry.astype("<i4"), cut)], [x.tobytes() for x in np.split(times.astype("<f8"), cut)]]
            keys = [xxhash.xxh64_intdigest(t, 1) >> 1 for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), *[pa.array(p, pa.binary()) for p in parts]], names=["key", "votes", "dense", "entry", "count"])

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted(r for b in batches for r in zip(*[c.to_pylist() for c in b.columns]))  # the same fit in whatever order they come
        votes = np.frombuffer(b"".join(r[1] for r in rows), "i1").reshape(len(rows), -1).astype(np.float64)
        dense = np.frombuffer(b"".join(r[2] for r in rows), "<f8").reshape(len(rows), -1)
        entry, times = np.frombuffer(b"".join(r[3] for r in rows), "<i4").astype(np.int64), np.frombuffer(b"".join(r[4] for r in rows), "<f8")
        row = np.repeat(np.arange(len(rows)), [len(r[3]) // 4 for r in rows])
        model = Toxicity(lexicon)
        model.fit(votes, dense, row, entry, times)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])

    return pickle.loads(sample.select("__text").mapInArrow(extract, FEATURES).repartition(1).mapInArrow(fit, "model binary").first()[0])


def score_table(docs: DataFrame, model: Toxicity, id_col: str = "doc_id", text_col: str = "text", fold: int = 5, out: int = 0) -> DataFrame:
    """(id, held_out, score, predicted) of every whole text, in one pass without a shuffle.

    A null text counts as empty. Repeated rows each give a row; other columns are not read; a null id is not held out.
    ``predicted`` is 1 where the score is at least 0.5.
    """

    def make():
        def work(texts: list[str]):
            p = model.score(texts)
            return p, (p >= 0.5).astype(np.int32)

        return work

    scored = per_text(docs, id_col, text_col, "score double, predicted int", make)
    held = F.coalesce(F.crc32(F.col(id_col).cast("string")) % fold == out, F.lit(False))
    return scored.select(id_col, held.alias("held_out"), "score", "predicted")


def keep_clean(docs: DataFrame, model: Toxicity, text_col: str = "text") -> DataFrame:
    """The rows that score below 0.5, with all their columns, whatever their names.

    A null or empty text has a score like any other; repeated rows share their fate; an empty table stays empty.
    """
    return keep_good(docs, model, text_col, wanted=False)
