"""BPE encoding and decoding with a contiguous rank array per short word.

A word is held as a list of symbols and the ranks of its adjacent pairs. The smallest rank is found by scanning,
the boundary there is deleted and the two neighbouring ranks are looked up anew. Words beyond ``SHORT`` symbols
take a heap of ranks over a linked list instead, with the same result (lowest rank, then leftmost).
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from functools import lru_cache

import numpy as np
import regex
from pyspark.sql import DataFrame

from lumenpass.llm.common import per_text

NONE = 1 << 30
SHORT = 400
#: Entries of a worker's memory of words; it is emptied when full.
MEMORY = 400_000


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table, extra = [""] * 256, 0
    for b in range(256):
        if b in set(shown):
            table[b] = chr(b)
        else:
            table[b] = chr(256 + extra)
            extra += 1
    return table


class Merges:
    """Pair ranks and what a pair becomes."""

    def __init__(self, pairs: list[tuple[int, int, int]]):
        """pairs: (left id, right id, merged id) by rank."""
        self.rank: dict[int, int] = {}
        self.made: list[int] = []
        for k, (a, b, c) in enumerate(pairs):
            self.rank.setdefault(a << 20 | b, k)
            self.made.append(c)

    def apply(self, ids: list[int]) -> list[int]:
        if len(ids) > SHORT:
            return self._long(ids)
        get, made = self.rank.get, self.made
        ranks = [get(a << 20 | b, NONE) for a, b in zip(ids, ids[1:])]
        while ranks:
            low = min(ranks)
            if low == NONE:
                break
            i = ranks.index(low)
            ids[i] = made[low]
            del ids[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = get(ids[i] << 20 | ids[i + 1], NONE)
            if i:
                ranks[i - 1] = get(ids[i - 1] << 20 | ids[i], NONE)
        return ids

    def _long(self, ids: list[int]) -> list[int]:
        get, made, n = self.rank.get, self.made, len(ids)
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := get(ids[i] << 20 | ids[i + 1], NONE)) < NONE]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j] = made[r], -1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if (r := get(ids[i] << 20 | ids[k], NONE)) < NONE:
                    heapq.heappush(heap, (r, i, ids[i], ids[k]))
            if (h := before[i]) >= 0 and (r := get(ids[h] << 20 | ids[i], NONE)) < NONE:
                heapq.heappush(heap, (r, h, ids[h], ids[i]))
        return [x for x in ids if x >= 0]


#: Longer keys aren't remembered, so that a memory's size is bounded in bytes too.
LONGEST = 128


class Memory(dict):
    """What ``make`` gives for a key (a text), kept while there is room and if it isn't long."""

    def __init__(self, make, room: int = MEMORY):
        super().__init__()
        self.make, self.room = make, room

    def __missing__(self, key):
        if len(key) > LONGEST:
            return self.make(key)
        if len(self) >= self.room:
            self.clear()
        value = self[key] = self.make(key)
        return value


class WordBpe:
    """Encoder and decoder for a lower-casing vocabulary file with ends of words (``</w>``)."""

    WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
    SPACES = regex.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        vocab = spec["model"]["vocab"]
        end = spec["model"]["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = [""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for token, i in [*vocab.items(), *self.special.items()]:
            self.tokens[i] = token
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.merges = Merges([(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs])
        chars = byte_alphabet()
        self.inner = [vocab[c] for c in chars]
        self.last = [vocab[c + end] for c in chars]
        self.split = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.words = Memory(self._word)
        self.units = Memory(self._unit)

    def _word(self, word: str) -> bytes:
        raw = word.encode("utf-8")
        ids = [self.inner[b] for b in raw[:-1]]
        ids.append(self.last[raw[-1]])
        return np.array(self.merges.apply(ids), "<u4").tobytes()

    def _unit(self, unit: str) -> bytes:
        """A stretch without white space: no token reaches across its ends."""
        return b"".join([self.words[w] for w in self.WORDS.findall(unit)])

    def _plain(self, text: str) -> bytes:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        text = text.lower()
        # str.split() also cuts at four controls that aren't white space here
        units = self.SPACES.split(text) if any(c in text for c in "\x1c\x1d\x1e\x1f") else text.split()
        return b"".join(map(self.units.__getitem__, units))

    def encode(self, text: str) -> bytes:
        """The ids, as little-endian unsigned 32-bit integers."""
        if not any(s in text for s in self.special):
            return self._plain(text)
        return b"".join(np.uint32(self.special[x]).astype("<u4").tobytes() if x in self.special else self._plain(x) for x in self.split.split(text) if x)

    def decode(self, ids: bytes) -> str:
        """Tokens joined by spaces, special ones included: the file names no decoder."""
        return " ".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=4)
def word_bpe(path: str) -> WordBpe:
    return WordBpe(path)


def encode_table(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>): every whole text encoded; a null text counts as empty and gives no ids."""

    def make():
        bpe = word_bpe(path)
        return lambda texts: ([np.frombuffer(bpe.encode(t), "<u4").astype("i4") for t in texts],)

    return per_text(df, id_col, text_col, "ids array<int>", make)


def decode_table(df: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text): ids back to text; null ids give an empty text, an id outside the vocabulary raises an error."""
    import pyarrow as pa

    kind = df.schema[id_col].dataType.simpleString()

    def run(batches):
        bpe = word_bpe(path)
        for b in batches:
            texts = [bpe.decode(np.array(x or [], "<u4").tobytes()) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=[id_col, "text"])

    return df.select(id_col, ids_col).mapInArrow(run, f"{id_col} {kind}, text string")


def digest_table(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of every whole text.

    Each text is encoded, and the ids are decoded again, in one pass without a shuffle. Null and empty texts have
    no tokens and the digests of nothing; repeated rows each give a row; other columns of ``df`` are not read.
    """

    def make():
        bpe = word_bpe(path)

        def work(texts: list[str]):
            n, a, b = [], [], []
            for t in texts:
                ids = bpe.encode(t)
                n.append(len(ids) // 4)
                a.append(hashlib.sha256(ids).hexdigest())
                b.append(hashlib.sha256(bpe.decode(ids).encode("utf-8")).hexdigest())
            return n, a, b

        return work

    return per_text(df, id_col, text_col, "n_tokens long, ids_sha256 string, decoded_sha256 string", make)
