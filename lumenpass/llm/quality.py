"""Document quality from a linear-chain conditional random field over lines.

Every line gets binned features of its own and of its neighbours (kinds of characters, words that end in signs,
repeated words, length). The field labels lines good or bad; forward-backward marginals, weighted by the lines'
lengths, give the share of bad text, and a calibration on documents turns that into a score. Fitting uses a bounded
sample of labelled rows, whose documents lend their label to their lines at first; lines of bad documents that the
first field finds good are then given back before it is fitted again.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenpass.llm.common import per_text, small_batches

UPPER, LETTER, DIGIT, SIGN, STOP, BLANK, OTHER = range(7)


def _classes() -> np.ndarray:
    table = np.full(256, LETTER, np.uint8)
    for b in range(128):
        c = chr(b)
        table[b] = UPPER if c.isupper() else LETTER if c.isalpha() else DIGIT if c.isdigit() else BLANK if c in " \t\r\x0b\x0c\n" else STOP if c in ".,;:?'\"()-" else SIGN if 32 < b < 127 else OTHER
    return table


CLASS = _classes()
RATIOS = np.array([0.0, 0.02, 0.05, 0.1, 0.2, 0.35, 0.5, 0.7, 0.9])
LENGTHS = np.array([0, 1, 2, 3, 5, 8, 16, 32, 64, 128, 256, 512, 2048])
#: Bins of each own feature; the first NEAR of them are also taken from the line before and after.
BINS = [10, 10, 10, 10, 10, 10, 14, 10, 10, 2, 60]
NEAR = 4
BASE = np.concatenate([[0], np.cumsum(BINS + 2 * [b + 1 for b in BINS[:NEAR]])])
WIDTH = int(BASE[-1]) + 1


def line_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lines x features: indices of the ones that are set, bytes of each line, lines of each text)."""
    n_lines = np.array([t.count("\n") + 1 for t in texts], np.int64)
    whole = "\n".join(texts)
    raw = np.frombuffer((whole + "\n").encode("utf-8"), np.uint8)
    ends = np.flatnonzero(raw == 10)
    starts = np.concatenate([[0], ends[:-1] + 1])
    size = ends - starts
    kind = CLASS[raw]
    # capital letters beyond ASCII: the second byte of Latin-1 capitals
    second = np.zeros(len(raw), bool)
    second[1:] = (raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] <= 0x9E)
    kind[second] = UPPER
    follow = (raw & 0xC0) == 0x80

    def per_line(mask: np.ndarray) -> np.ndarray:
        return np.add.reduceat(mask, starts, dtype=np.int64)

    upper = per_line(kind == UPPER)
    letters = per_line((kind == LETTER) & ~follow) + per_line((kind == UPPER) & ~second)
    digits, signs, stops = per_line(kind == DIGIT), per_line(kind == SIGN), per_line(kind == STOP)
    blank = kind == BLANK
    word_end = np.zeros(len(raw), bool)
    word_end[:-1] = ~blank[:-1] & blank[1:]
    words = per_line(word_end)
    sign_end = per_line(word_end & (kind == SIGN))
    alone = word_end & (kind == SIGN)
    alone[1:] &= blank[:-1]
    alone = per_line(alone)
    chars = np.maximum(1, per_line(~follow) - 1)
    distinct, again = np.zeros(len(ends), np.int64), np.zeros(len(ends), np.int64)
    counts = np.zeros(len(ends), np.int64)
    for i, line in enumerate(whole.split("\n")):
        w = line.split()
        counts[i], distinct[i], again[i] = len(w), len(set(w)), sum(map(eq, w, w[1:]))
    some = np.maximum(1, words)
    count = np.maximum(1, counts)
    ended = np.where(size > 0, kind[np.maximum(0, ends - 1)], BLANK)

    def ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.searchsorted(RATIOS, a / np.maximum(1, b), "left")

    def length(a: np.ndarray) -> np.ndarray:
        return np.searchsorted(LENGTHS, a, "left")

    fresh = np.searchsorted(RATIOS, distinct / count, "left")
    own = np.stack(
        [
            ratio(upper, letters),
            ratio(sign_end, some),
            ratio(again, count),
            np.where(counts >= 4, fresh, 0),
            ratio(signs, chars),
            ratio(alone, some),
            length(counts),
            ratio(digits, chars),
            ratio(stops, chars),
            (ended == SIGN) * 1,
            np.minimum(5, length(counts) // 2) * 10 + fresh,
        ],
        axis=1,
    )
    own = np.minimum(own, np.array(BINS) - 1)
    last = np.cumsum(n_lines) - 1
    first = last - n_lines + 1
    before, after = np.roll(own[:, :NEAR], 1, axis=0) + 1, np.roll(own[:, :NEAR], -1, axis=0) + 1
    before[first], after[last] = 0, 0
    return np.concatenate([own, before, after], axis=1) + BASE[:-1], size, n_lines


class Field:
    """Weights of two labels (0 good, 1 bad), transitions, and the calibration of documents."""

    def __init__(self):
        self.weight = np.zeros(WIDTH)
        self.step = np.zeros((2, 2))
        self.line = (0.0, 0.0)

    def marginals(self, features: np.ndarray, n_lines: np.ndarray, importance: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(P(bad) of each line, P(label pair) summed as 2 x 2, by importance); forward-backward over all texts at once."""
        score = self.weight[features].sum(axis=1)
        emit = np.stack([-score / 2, score / 2], axis=1)
        emit = np.exp(emit - emit.max(axis=1, keepdims=True))
        order = np.argsort(-n_lines, kind="stable")
        size = n_lines[order]
        first = (np.cumsum(n_lines) - n_lines)[order]
        step = np.exp(self.step - self.step.max())
        live = np.searchsorted(-size, -np.arange(1, size[0] + 1), "right")  # texts with a line at each place
        ahead, back = np.empty_like(emit), np.ones_like(emit)
        at = first
        a = emit[at]
        ahead[at] = a / a.sum(axis=1, keepdims=True)
        for k in range(1, size[0]):
            at = first[: live[k]] + k
            a = ahead[at - 1] @ step * emit[at]
            ahead[at] = a / a.sum(axis=1, keepdims=True)
        for k in range(size[0] - 2, -1, -1):
            at = first[: live[k + 1]] + k
            b = (emit[at + 1] * back[at + 1]) @ step.T
            back[at] = b / b.sum(axis=1, keepdims=True)
        p = ahead * back
        p /= p.sum(axis=1, keepdims=True)
        inner = np.ones(len(emit), bool)
        inner[first] = False
        at = np.flatnonzero(inner)
        pair = ahead[at - 1][:, :, None] * step * (emit[at] * back[at])[:, None, :]
        pair /= pair.sum(axis=(1, 2), keepdims=True)
        return p[:, 1], pair.sum(axis=0) if importance is None else np.einsum("i,ijk->jk", importance[at], pair)

    def fit(self, features: np.ndarray, n_lines: np.ndarray, bad: np.ndarray, importance: np.ndarray, rounds: int, rate: float = 0.3, ridge: float = 3e-5) -> None:
        """Gradient ascent (Adam) on the likelihood of the line labels."""
        inner = np.ones(len(bad), bool)
        inner[np.cumsum(n_lines) - n_lines] = False
        at = np.flatnonzero(inner)
        y = bad.astype(np.int64)
        seen = np.zeros((2, 2))
        np.add.at(seen, (y[at - 1], y[at]), importance[at])
        x = np.concatenate([self.weight, self.step.ravel()])
        m, v = np.zeros_like(x), np.zeros_like(x)
        total = importance.sum()
        pull = np.concatenate([np.full(WIDTH, ridge), np.full(4, 100 * ridge)])  # a line's own looks outweigh its neighbours' labels
        for t in range(1, rounds + 1):
            p, pairs = self.marginals(features, n_lines, importance)
            miss = (y - p) * importance
            g = np.bincount(features.ravel(), np.repeat(miss, features.shape[1]), WIDTH) / total
            g = np.concatenate([g, ((seen - pairs) / total).ravel()]) - pull * x
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            x = x + rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
            self.weight, self.step = x[:WIDTH], x[WIDTH:].reshape(2, 2)

    def shares(self, features: np.ndarray, size: np.ndarray, n_lines: np.ndarray) -> np.ndarray:
        """Length-weighted share of bad text in each document."""
        p = self.marginals(features, n_lines)[0]
        first = np.cumsum(n_lines) - n_lines
        w = size + 1.0
        return np.add.reduceat(p * w, first) / np.add.reduceat(w, first)

    def score(self, texts: list[str]) -> np.ndarray:
        """P(good) of each text."""
        if not texts:
            return np.zeros(0)
        return 1 / (1 + np.exp(-(self.line[0] + self.line[1] * self.shares(*line_features(texts)))))


def calibrate(share: np.ndarray, good: np.ndarray, rounds: int = 400) -> tuple[float, float]:
    """Logistic regression of the document label on the share of bad text (Newton's method, slightly ridged)."""
    x = np.stack([np.ones_like(share), share], axis=1)
    w = np.zeros(2)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + 1e-2 * np.eye(2), x.T @ (good - p) - 1e-2 * w)
        w += np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1])


def fit_field(rows: list[tuple[np.ndarray, np.ndarray, int]]) -> Field:
    """A field from (features, line sizes, quality) of documents. Without both labels it scores all by the one there is."""
    field = Field()
    labels = {q for _, _, q in rows}
    if len(labels) < 2:
        field.line = ((4.0 if labels == {1} else -4.0 if labels else 0.0), 0.0)
        return field
    rows = sorted(rows, key=lambda r: (r[2], len(r[1]), r[1].sum(), r[0].tobytes()))
    features = np.concatenate([r[0] for r in rows]).astype(np.int64)
    size = np.concatenate([r[1] for r in rows])
    n_lines = np.array([len(r[1]) for r in rows])
    good = np.array([r[2] for r in rows])
    document = np.repeat(np.arange(len(rows)), n_lines)
    bad = good[document] == 0
    # Lines weigh alike: what good documents are made of outweighs its share in bad ones, and so is found good there.
    importance = np.ones(len(bad))
    field.fit(features, n_lines, bad, importance, 150)
    for _ in range(2):
        p = field.marginals(features, n_lines)[0]
        # the worst line of a bad document stays bad, good-looking ones become good
        worst = np.zeros(len(rows))
        np.maximum.at(worst, document, p)
        bad = (good[document] == 0) & ((p > 0.5) | (p >= worst[document]))
        # what is now called bad is rare and sure: both kinds of lines weigh the same
        importance = np.where(bad, (~bad).sum() / max(1, bad.sum()), 1.0)
        field.fit(features, n_lines, bad, importance, 80)
    field.line = calibrate(field.shares(features, size, n_lines), good)
    return field


FEATURES = "quality int, n int, features binary, size binary"


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = 6000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", fold: int = 3, out: int | None = 1) -> Field:
    """Fit on at most ``sample_rows`` labelled rows (a documented bound; chosen by the hash of the id).

    Rows with crc32(id as text) mod ``fold`` equal to ``out`` are never used; null ids, labels or texts neither.
    Features are computed where the texts are; only they come to the one task that fits, and the fitted field, a few
    kilobytes, to the driver.
    """
    spark = docs.sparkSession
    small_batches(spark)
    usable = labels.select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("__y")).where("__id is not null and __y in (0, 1)")
    if out is not None:
        usable = usable.where(F.crc32(F.col("__id").cast("string")) % fold != out)
    chosen = usable.dropDuplicates(["__id"]).orderBy(F.xxhash64("__id"), "__id").limit(sample_rows)
    held = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).where("__text is not null")
    rows = held.join(F.broadcast(chosen), "__id").select("__y", "__text")  # at most sample_rows ids are broadcast

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            features, size, n = line_features(b.column(1).to_pylist())
            cut = np.cumsum(n)[:-1]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int32()), pa.array([f.astype("<u2").tobytes() for f in np.split(features, cut)], pa.binary()), pa.array([s.astype("<u4").tobytes() for s in np.split(size, cut)], pa.binary())],
                names=["quality", "n", "features", "size"],
            )

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for b in batches:
            for y, n, f, s in zip(*[c.to_pylist() for c in b.columns]):
                rows.append((np.frombuffer(f, "<u2").reshape(n, -1), np.frombuffer(s, "<u4").astype(np.int64), y))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit_field(rows))], pa.binary())], names=["model"])

    got = rows.mapInArrow(extract, FEATURES).repartition(1).mapInArrow(fit, "model binary").collect()
    return pickle.loads(got[0][0]) if got else fit_field([])



def score_table(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text", fold: int = 3, out: int = 1) -> DataFrame:
    """(id, held_out, score, predicted) of every whole text, in one pass without a shuffle.

    A null text counts as empty (one empty line). Repeated rows each give a row; other columns are not read; a null id
    is not held out. ``predicted`` is 1 where the score is at least 0.5.
    """

    def make():
        def work(texts: list[str]):
            p = field.score(texts)
            return p, (p >= 0.5).astype(np.int32)

        return work

    scored = per_text(docs, id_col, text_col, "score double, predicted int", make)
    held = F.coalesce(F.crc32(F.col(id_col).cast("string")) % fold == out, F.lit(False))
    return scored.select(id_col, held.alias("held_out"), "score", "predicted")


def keep_good(docs: DataFrame, scorer, text_col: str = "text", wanted: bool = True, at: float = 0.5) -> DataFrame:
    """The rows whose score (``scorer.score(texts)``) is at least ``at`` (or below, if not ``wanted``), all columns kept.

    A null text is scored as empty; repeated rows share their fate; an empty table stays empty; other columns may have
    any names and hold anything.
    """
    small_batches(docs.sparkSession)
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                p = scorer.score([t or "" for t in b.column(place).to_pylist()])
                yield b.filter(pa.array((p >= at) == wanted))

    return docs.mapInArrow(run, docs.schema)
