"""Token counts by rank-synchronous array merging.

The distinct pre-tokens of a batch are held as one ragged numpy array of symbols. In every round each sequence's
lowest-rank pair (the leftmost of equals) is merged, for all sequences at once; those without a pair left drop out
and the symbols that survive are counted.
"""

from __future__ import annotations

import heapq
import re
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame

from lumenpass.llm.bpe import LONGEST
from lumenpass.llm.common import per_text

NONE = np.int32(1 << 30)
#: Longer pre-tokens are merged by a heap, one by one, so that the number of rounds is bounded.
SHORT = 512
MEMORY = 600_000


class PieceCounter:
    """Counts of a piece vocabulary with byte fallback (sentencepiece BPE model file)."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        usable = [i for i in range(sp.vocab_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
        pieces = {sp.id_to_piece(i): sp.get_score(i) for i in usable}
        names = sorted(set(pieces) | {c for p in pieces for c in p})
        self.ids = {p: k for k, p in enumerate(names)}
        # what a surviving symbol counts: 1 for a piece, its bytes for a character that is none
        self.other = len(names)  # + number of bytes of a character outside the vocabulary
        self.weight = np.array([1 if p in pieces else len(p.encode("utf-8")) for p in names] + [0, 1, 2, 3, 4], np.int64)
        order = {s: r for r, s in enumerate(sorted(set(pieces.values()), reverse=True))}
        table = sorted({(self.ids[p[:k]] << 20 | self.ids[p[k:]], order[s], self.ids[p]) for p, s in pieces.items() for k in range(1, len(p)) if p[:k] in self.ids and p[k:] in self.ids})
        self._hash(table)
        # Pieces begin with their blanks, if any, so no pair spans a blank after another character; line ends and
        # other characters in no longer piece stand alone.
        joined = {c for p in pieces if len(p) > 1 for c in p}
        if any("▁" in p.lstrip("▁") for p in pieces) or "\n" in joined:
            raise ValueError("this vocabulary joins characters across blanks or lines")
        self.memory: dict[str, int] = {}

    UNITS = re.compile(r" *[^ \n]+| +|\n+")

    def _symbols(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        text = "".join(units).replace(" ", "▁")
        get, other = self.ids.get, self.other
        known = {c: i if (i := get(c)) is not None else other + len(c.encode("utf-8")) for c in set(text)}
        return np.fromiter(map(known.__getitem__, text), np.int32, len(text)), np.fromiter(map(len, units), np.int64, len(units))

    def _hash(self, table: list[tuple[int, int, int]]) -> None:
        """Open addressing at a quarter's load, probed for whole arrays at a time."""
        self.bits = max(4, (4 * len(table)).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.ranks, self.made = np.full(1 << self.bits, NONE, np.int32), np.zeros(1 << self.bits, np.int32)
        key, rank, made = (np.array([t[k] for t in table], np.int64) for k in range(3))
        at, todo = self._place(key), np.arange(len(table))
        while len(todo):
            free = todo[self.keys[at[todo]] < 0]
            _, one = np.unique(at[free], return_index=True)
            put = free[one]
            self.keys[at[put]], self.ranks[at[put]], self.made[at[put]] = key[put], rank[put], made[put]
            todo = np.setdiff1d(todo, put)
            at[todo] = (at[todo] + 1) & ((1 << self.bits) - 1)

    def _place(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The slot of each pair; an empty slot, whose rank is NONE, if it never merges."""
        key = a.astype(np.int64) << 20 | b
        at = self._place(key)
        found = self.keys[at]
        off = np.flatnonzero((found != key) & (found >= 0))
        while len(off):
            at[off] = (at[off] + 1) & ((1 << self.bits) - 1)
            found = self.keys[at[off]]
            off = off[(found != key[off]) & (found >= 0)]
        return at

    def merged(self, units: list[str]) -> np.ndarray:
        """Counts of the units, which are not empty."""
        out = np.zeros(len(units), np.int64)
        long = [k for k, u in enumerate(units) if len(u) > SHORT]
        for k in long:
            out[k] = self._heap(units[k])
        which = np.array([k for k, u in enumerate(units) if len(u) <= SHORT], np.int64)
        if not len(which):
            return out
        sym, size = self._symbols([units[k] for k in which])
        last = np.zeros(len(sym), bool)
        last[np.cumsum(size) - 1] = True
        rank = np.where(last, NONE, self.ranks[self._pair(sym, np.append(sym[1:], 0))])
        while True:
            start = np.cumsum(size) - size
            low = np.minimum.reduceat(rank, start)
            done = low == NONE
            if done.any():
                out[which[done]] = np.add.reduceat(self.weight[sym], start)[done]
                which, keep, size, low = which[~done], np.repeat(~done, size), size[~done], low[~done]
                if not len(which):
                    return out
                sym, rank, last = sym[keep], rank[keep], last[keep]
            at = np.flatnonzero(rank == np.repeat(low, size))
            owner = np.searchsorted(np.cumsum(size), at, "right")
            at = at[np.append(True, owner[1:] != owner[:-1])]  # the leftmost of each sequence
            sym[at] = self.made[self._pair(sym[at], sym[at + 1])]
            last[at] = last[at + 1]
            stay = np.ones(len(sym), bool)
            stay[at + 1] = False
            sym, rank, last, size = sym[stay], rank[stay], last[stay], size - 1
            at = at - np.arange(len(at))  # one symbol went from every sequence
            rank[at] = np.where(last[at], NONE, self.ranks[self._pair(sym[at], sym[np.minimum(at + 1, len(sym) - 1)])])
            before = at[at > 0] - 1
            before = before[~last[before]]
            rank[before] = self.ranks[self._pair(sym[before], sym[before + 1])]

    def _heap(self, unit: str) -> int:
        sym = self._symbols([unit])[0]
        n = len(sym)
        slot = self._pair(sym[:-1], sym[1:])
        rank, made = self.ranks[slot], self.made[slot]
        ids, after, before = sym.tolist(), [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(int(rank[i]), int(i), ids[i], ids[i + 1], int(made[i])) for i in np.flatnonzero(rank < NONE)]
        heapq.heapify(heap)

        def push(i: int, j: int) -> None:
            at = int(self._pair(np.array([ids[i]]), np.array([ids[j]]))[0])
            if self.ranks[at] < NONE:
                heapq.heappush(heap, (int(self.ranks[at]), i, ids[i], ids[j], int(self.made[at])))

        while heap:
            _, i, a, b, c = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j] = c, -1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                push(i, k)
            if before[i] >= 0:
                push(before[i], i)
        return int(self.weight[[x for x in ids if x >= 0]].sum())

    def count(self, texts: list[str]) -> list[int]:
        """Tokens of each text, without begin or end."""
        units = [self.UNITS.findall(" " + t.replace("▁", " ")) if t else [] for t in texts]
        new = set().union(*units).difference(self.memory)
        if new:
            if len(self.memory) + len(new) > MEMORY:
                self.memory.clear()
                new = set().union(*units)
            fresh = list(new)
            self.memory.update(zip(fresh, self.merged(fresh).tolist()))
        get = self.memory.__getitem__
        counts = [sum(map(get, u)) for u in units]
        for u in new:
            if len(u) > LONGEST:  # not remembered, so that the memory is bounded in bytes too
                del self.memory[u]
        return counts


@lru_cache(maxsize=4)
def piece_counter(path: str) -> PieceCounter:
    return PieceCounter(path)


def count_table(df: DataFrame, path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every whole text.

    Null and empty texts count 0 bytes and 0 tokens. Repeated rows each give a row; other columns are not read.
    One pass, no shuffle.
    """

    def make():
        counter = piece_counter(path)

        def work(texts: list[str]):
            n = counter.count(texts)
            return [len(t.encode("utf-8")) for t in texts], n, [x > limit for x in n]

        return work

    return per_text(df, id_col, text_col, "n_bytes long, n_tokens long, over_limit boolean", make)
