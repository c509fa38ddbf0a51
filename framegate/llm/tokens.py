"""Token counts of texts by byte-pair merges, with whole batches of words merged at once.

The words of a batch lie one behind the other in ragged numpy arrays. In every round each word applies its own
lowest-ranked pair at all its places, all words at the same time; words without a pair left leave with the number of
symbols they have. Words that are too long for rounds over their whole length keep their places by rank instead, so a
round touches only the places it merges.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from tokenizers import Tokenizer

from framegate.llm.common import extend, ship, text_or_empty

LIMIT = 2048
#: Words whose counts a task remembers at most, and the longest such word; symbols from which a word is merged alone.
MEMORY_WORDS, MEMORY_BYTES, LONG = 400_000, 64, 512
#: Symbols of the words that are merged in one go.
ROUND_SYMBOLS = 1 << 19
#: The pieces of a lower-case ASCII word; other words go through the vocabulary's own rules.
ASCII_PIECES = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\t-\r a-z0-9]+")
_ASCII_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NONE = np.int64(1 << 40)


class Merges:
    """Symbols of bytes, and the rank and result of every pair, for a vocabulary of byte-pair merges with word ends."""

    def __init__(self, tokenizer_json: str):
        spec = json.loads(tokenizer_json)
        model, split = spec["model"], (spec["pre_tokenizer"] or {}).get("pretokenizers", [{}])[0]
        kinds = [p["type"] for p in (spec["pre_tokenizer"] or {}).get("pretokenizers", [])]
        lowers = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
        plain = kinds == ["Split", "ByteLevel"] and lowers == ["NFC", "Replace", "Lowercase"]
        if model["type"] != "BPE" or model["dropout"] or not plain or split["pattern"].get("Regex") != _ASCII_SPLIT:
            raise ValueError("a lower-casing vocabulary of byte-pair merges is needed")
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
        self.char_of = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(sorted(set(range(256)) - set(shown)))}
        self.byte_of = {c: b for b, c in self.char_of.items()}
        vocab, end = model["vocab"], model["end_of_word_suffix"] or ""
        self.inner = np.array([vocab[self.char_of[b]] for b in range(256)], np.int64)
        self.last = np.array([vocab[self.char_of[b] + end] for b in range(256)], np.int64)
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.width = max(vocab.values()) + 1
        keys = np.array([vocab[a] * self.width + vocab[b] for a, b in pairs] or [-1], np.int64)
        self.result = np.array([vocab[a + b] for a, b in pairs] or [0], np.int64)
        self.left, self.right = keys // self.width, keys % self.width
        made = {int(r): i for i, r in enumerate(self.result)}
        if any(made.get(int(s), -1) >= i for side in (self.left, self.right) for i, s in enumerate(side)):
            raise ValueError("every merge has to come after those that make its parts")
        self.rank = np.argsort(keys, kind="stable")
        self.key = keys[self.rank]

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of every pair; NONE for pairs that don't merge."""
        key = left * self.width + right
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where(self.key[at] == key, self.rank[at], NONE)

    def symbols(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The symbols of all words behind each other, and the lengths of the words."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        raw = np.frombuffer(b"".join(words), np.uint8)
        found = self.inner[raw]
        ends = np.cumsum(sizes) - 1
        found[ends] = self.last[raw[ends]]
        return found, sizes

    def count(self, words: list[bytes]) -> np.ndarray:
        """Symbols that are left of every (not empty) word."""
        out = np.zeros(len(words), np.int64)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        for i in np.flatnonzero(sizes > LONG).tolist():
            out[i] = self._count_long(words[i])
        short = np.flatnonzero(sizes <= LONG)
        cuts = np.searchsorted(np.cumsum(sizes[short]), np.arange(ROUND_SYMBOLS, sizes[short].sum() + ROUND_SYMBOLS, ROUND_SYMBOLS), "right")
        for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(short)]):
            if lo < hi:
                out[short[lo:hi]] = self._count_rounds([words[i] for i in short[lo:hi].tolist()])
        return out

    def _count_rounds(self, words: list[bytes]) -> np.ndarray:
        symbol, sizes = self.symbols(words)
        out, word = sizes.copy(), np.arange(len(words))
        start = np.cumsum(sizes) - sizes
        rank = np.full(len(symbol), NONE)
        rank[:-1] = self.ranks(symbol[:-1], symbol[1:])
        rank[start[1:] - 1] = NONE
        while len(word):
            lowest = np.minimum.reduceat(rank, start)
            alive = lowest < NONE
            out[word[~alive]] = sizes[~alive]
            of = np.repeat(np.arange(len(word)), sizes)
            kept = alive[of]
            hit = kept & (rank == lowest[of])
            at = every_other(np.flatnonzero(hit))
            symbol[at] = self.result[rank[at]]
            kept[at + 1] = False
            # Pairs are ranked anew where one of the two changed.
            changed = np.zeros(len(symbol), bool)
            changed[at] = True
            symbol, changed, of = symbol[kept], changed[kept], of[kept]
            sizes = np.bincount(of, minlength=len(word))[alive]
            word = word[alive]
            rank[at] = NONE
            rank = np.where(rank[kept] < NONE, rank[kept], NONE)
            if not len(word):
                break
            start = np.cumsum(sizes) - sizes
            inside = np.ones(len(symbol), bool)
            inside[start + sizes - 1] = False
            near = changed.copy()
            near[:-1] |= changed[1:]
            where = np.flatnonzero(near & inside)
            rank[where] = self.ranks(symbol[where], symbol[where + 1])
            rank[~inside] = NONE
        return out

    def _count_long(self, word: bytes) -> int:
        symbol, _ = self.symbols([word])
        n = len(symbol)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        there, left = np.ones(n, bool), n
        places: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def offer(at: np.ndarray) -> None:
            """Remember the pairs that start at ``at`` by their ranks."""
            at = at[after[at] < n]
            rank = self.ranks(symbol[at], symbol[after[at]])
            at, rank = at[rank < NONE], rank[rank < NONE]
            order = np.argsort(rank, kind="stable")
            at, rank = at[order], rank[order]
            edges = np.r_[0, np.flatnonzero(rank[1:] != rank[:-1]) + 1, len(rank)]
            for lo, hi in zip(edges.tolist(), edges[1:].tolist()):
                if lo < hi:
                    r = int(rank[lo])
                    if r not in places:
                        places[r] = []
                        heapq.heappush(heap, r)
                    places[r].append(at[lo:hi])

        offer(np.arange(n - 1))
        while heap:
            r = heapq.heappop(heap)
            at = np.unique(np.concatenate(places.pop(r)))
            at = at[there[at] & (after[at] < n)]
            at = at[(symbol[at] == self.left[r]) & (symbol[after[at]] == self.right[r])]
            at = every_other(at, after)
            gone = after[at]
            symbol[at], there[gone], after[at] = self.result[r], False, after[gone]
            inner = at[after[at] < n]
            before[after[inner]] = inner
            left -= len(at)
            offer(np.unique(np.concatenate([at, before[at][before[at] >= 0]])))
        return left


def every_other(at: np.ndarray, after: np.ndarray | None = None) -> np.ndarray:
    """Of ascending places whose pairs overlap (aaa), the first, third and so on of each run."""
    if len(at) < 2:
        return at
    joined = at[1:] == (at[:-1] + 1 if after is None else after[at[:-1]])
    if not joined.any():
        return at
    heads = np.flatnonzero(np.r_[True, ~joined])
    place = np.arange(len(at)) - np.repeat(heads, np.diff(np.r_[heads, len(at)]))
    return at[place % 2 == 0]


class Counter:
    """Counts of tokens per text, as the tokenizers library gives them for the vocabulary's defaults."""

    def __init__(self, tokenizer_json: str):
        self.merges = Merges(tokenizer_json)
        self.rules = Tokenizer.from_str(tokenizer_json)
        special = [t["content"] for t in json.loads(tokenizer_json)["added_tokens"]]
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.known: dict[bytes, int] = {}

    def pieces(self, chunk: bytes) -> tuple[list[bytes], int]:
        """The words of a run of text without ASCII white space, and the special tokens in it."""
        whole, extra = [chunk], 0
        if self.special is not None and b"<|" in chunk:
            parts = self.special.split(chunk.decode())
            whole, extra = [p.encode() for p in parts[::2] if p], len(parts) // 2
        words: list[bytes] = []
        for part in whole:
            if part.isascii():
                words += ASCII_PIECES.findall(part.lower())
            else:
                normal = self.rules.normalizer.normalize_str(part.decode())
                for piece, _ in self.rules.pre_tokenizer.pre_tokenize_str(normal):
                    words.append(bytes(map(self.merges.byte_of.__getitem__, piece)))
        return words, extra

    def count(self, texts: Iterable[bytes]) -> list[int]:
        chunks = [t.split() for t in texts]
        new = list(set().union(*chunks) - self.known.keys())
        split = [self.pieces(c) for c in new]
        words = {w: i for i, w in enumerate({w for found, _ in split for w in found})}
        sizes = self.merges.count(list(words)).tolist() if words else []
        fresh = {c: extra + sum(sizes[words[w]] for w in found) for c, (found, extra) in zip(new, split)}
        room = MEMORY_WORDS - len(self.known)
        self.known.update(fresh)
        out = [sum(map(self.known.__getitem__, c)) for c in chunks]
        for i, chunk in enumerate(new):
            if i >= room or len(chunk) > MEMORY_BYTES:
                del self.known[chunk]
        return out


def token_counts(docs: DataFrame, tokenizer_json: str, limit: int = LIMIT) -> DataFrame:
    """``doc_id``, ``n_bytes``, ``n_tokens`` and ``over_limit`` (more than ``limit`` tokens) of every row of ``docs``.

    The counts are those of the tokenizers library without added special tokens, truncation or padding; special strings
    in a text count as one token, as by its default. A null text is empty: no bytes, no tokens. Repeated rows and null ids
    keep their rows; other columns, whatever their names, are left out; an empty table gives no rows. Texts of any length
    are counted whole; nothing moves between tasks.
    """
    shared = ship(docs.sparkSession, tokenizer_json)
    held: list[Counter] = []

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        if not held:
            held.append(Counter(shared()))
        texts = [t.encode() for t in batch.column("__text").to_pylist()]
        n = pa.array(held[0].count(texts), pa.int64())
        over = pa.array([c > limit for c in n.to_pylist()], pa.bool_())
        return [pa.array(list(map(len, texts)), pa.int64()), n, over]

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("__text"))
    return extend(rows, ["doc_id"], run, "n_bytes long, n_tokens long, over_limit boolean")
