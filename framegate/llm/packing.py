"""Best-fit packing of tokenized documents into sequences of fixed capacity.

Method: Martello-Toth dominance reduction, then best fit. Piece lengths are whole numbers up to the capacity, so the
instance is its histogram of lengths: at most ``capacity`` counts, however many documents there are. Only those counts
reach the driver; the plan it makes is a list of patterns with multiplicities. Pieces find their place through their
rank within their length, which is a prefix sum over (task, length) counts, so no length gathers in one task.
"""

from __future__ import annotations

import bisect
import json
import re
import sys
import types
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F
from tokenizers import Tokenizer

from framegate.llm.common import bounded_batches, stage, text_or_empty

#: Words whose ids a task remembers at most, and the longest such word.
MEMORY_WORDS, MEMORY_CHARS = 400_000, 64
#: Pattern of byte-level pre-tokenizers (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words of these alphabets, without spaces at their ends: both libraries agree on their letters, digits and spaces.
PLAIN = re.compile(r"[!-~\u00c0-\u024f](?:[!-~\u00c0-\u024f\n]*[!-~\u00c0-\u024f])?")
PIECES = (
    "doc_id long, piece int, start long, length long, ids array<int>, ids_crc32 long, part int, nth long"
)


def same_ranks(tokenizer_json: str) -> tiktoken.Encoding | None:
    """The same byte-level vocabulary for tiktoken, which is faster on single words; None if it is of another kind.

    A vocabulary qualifies if its merges are numbered in the order they apply, after the 256 bytes; the pattern is the
    one every byte-level pre-tokenizer has unless it names another.
    """
    spec = json.loads(tokenizer_json)
    pre, model = spec["pre_tokenizer"] or {}, spec["model"]
    plain = pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space")
    if not plain or model["type"] != "BPE" or spec["normalizer"]:
        return None
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(shown)))}
    added = {t["content"] for t in spec["added_tokens"]}
    ids = {bytes(byte_of[c] for c in token): i for token, i in model["vocab"].items() if token not in added}
    joined = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in model["merges"]]
    if any(model["vocab"][token] != 256 + i for i, token in enumerate(joined)):
        return None
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ids, special_tokens={})


class _Odd(Exception):
    """A part between two spaces that can't be tokenized by itself."""


class _Words(dict):
    """Part of a text between spaces -> its ids as bytes. The vocabulary's pattern always splits before a single space
    that stands between two other characters, so such parts have the same ids alone as in the text."""

    def __init__(self, tokenizer: Tokenizer, ranks: tiktoken.Encoding | None, prefix: str):
        super().__init__()
        self.tokenizer, self.ranks, self.prefix = tokenizer, ranks, prefix

    def ids(self, part: str) -> bytes:
        return np.array(self.tokenizer.encode(self.prefix + part, add_special_tokens=False).ids, "<u4").tobytes()

    def __missing__(self, part: str) -> bytes:
        if self.ranks and PLAIN.fullmatch(part):
            found = array("I", self.ranks.encode_ordinary(self.prefix + part)).tobytes()
        elif not part or part[0].isspace() or part[-1].isspace():
            raise _Odd
        else:
            found = self.ids(part)
        # Frequent words come early, so a full memory keeps what it has.
        if len(self) < MEMORY_WORDS and len(part) <= MEMORY_CHARS:
            self[part] = found
        return found


class Encoder:
    """``encode(text)``: the ids of the whole text as little-endian unsigned 32-bit bytes."""

    def __init__(self, tokenizer_json: str):
        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        ranks = same_ranks(tokenizer_json)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.first, self.rest = _Words(self.tokenizer, ranks, ""), _Words(self.tokenizer, ranks, " ")

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if any(t in text for t in self.added):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        parts = text.split(" ")
        try:
            return self.first[parts[0]] + b"".join(map(self.rest.__getitem__, parts[1:]))
        except _Odd:
            pass
        spans, run = [], [parts[0]]
        for before, part in zip(parts, parts[1:]):
            if before and part and not before[-1].isspace() and not part[0].isspace():
                spans.append(" ".join(run))
                run = [part]
            else:
                run.append(part)
        spans.append(" ".join(run))
        return self.first.ids(spans[0]) + b"".join(map(self.rest.ids, spans[1:]))


def worker_encoder(tokenizer_json: str) -> Encoder:
    """The encoder of this Python worker: it and its remembered words outlive a task."""
    kept = sys.modules.setdefault("framegate_worker", types.ModuleType("framegate_worker"))
    if getattr(kept, "vocabulary", None) != tokenizer_json:
        kept.encoder, kept.vocabulary = Encoder(tokenizer_json), tokenizer_json
    return kept.encoder


def tokenize(docs: DataFrame, tokenizer_json: str, capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """Pieces of at most ``capacity`` ids of every document (its ids, then ``end_id``).

    Only longer documents are cut, into full pieces; the first may be shorter. ``part`` and ``nth`` number the pieces
    of one length within the task that made them, which the written table keeps whatever is retried later.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(tokenizer_json)
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, seen = worker_encoder(shared.value), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            rows: list[tuple] = []
            data: list[bytes] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = encoder.encode(text) + end
                total = len(ids) // 4
                head = total % capacity or min(total, capacity)
                lo, piece = 0, 0
                while lo < total:
                    hi = lo + head if piece == 0 else lo + capacity
                    cut = ids[4 * lo : 4 * hi]
                    rows.append((doc_id, piece, lo, hi - lo, zlib.crc32(cut), part, int(seen[hi - lo])))
                    data.append(cut)
                    seen[hi - lo] += 1
                    lo, piece = hi, piece + 1
            if not rows:
                continue
            doc, piece, start, length, crc, where, nth = map(list, zip(*rows))
            ends = np.concatenate([[0], np.cumsum(length)]).astype(np.int32)
            values = pa.array(np.frombuffer(b"".join(data), "<u4").astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                    pa.array(length, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), values),
                    pa.array(crc, pa.int64()), pa.array(where, pa.int32()), pa.array(nth, pa.int64()),
                ],
                ["doc_id", "piece", "start", "length", "ids", "ids_crc32", "part", "nth"],
            )

    return docs.select(F.col("doc_id").cast("long"), text_or_empty()).mapInArrow(run, PIECES)


class _Sizes:
    """Sizes that still have items, in ascending order, with their counts."""

    def __init__(self, counts: dict[int, int]):
        self.count = {s: n for s, n in counts.items() if n > 0}
        self.order = sorted(self.count)

    def take(self, size: int, n: int) -> None:
        self.count[size] -= n
        if not self.count[size]:
            del self.count[size]
            self.order.remove(size)

    def largest(self, room: int, *used: int) -> int:
        """The largest size up to ``room`` of which an item is left besides ``used``; 0 if there is none."""
        at = bisect.bisect_right(self.order, room) - 1
        while at >= 0 and self.count[self.order[at]] <= used.count(self.order[at]):
            at -= 1
        return self.order[at] if at >= 0 else 0

    def smallest_sum(self, n: int, *used: int) -> float:
        """The sum of the ``n`` smallest items besides ``used``; infinite if there are fewer."""
        total = 0
        for size in self.order:
            have = min(n, self.count[size] - used.count(size))
            total, n = total + have * size, n - have
            if n <= 0:
                return total
        return float("inf")


def reduce_dominated(sizes: _Sizes, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Martello-Toth reduction: take out bins whose set dominates every other set with the same item.

    For an item ``a`` with room ``r`` beside it, tried from large to small:
    {a} if nothing fits; {a, b} if b fills r exactly, or b is the largest that fits and no two items fit; {a, b, c}
    if b is the largest that fits, no three items fit, and c is at least as large as the second item of any pair.
    In each case every feasible set with ``a`` can be mapped item by item into the set that is fixed.
    """
    fixed: list[tuple[tuple[int, ...], int]] = []
    for a in sorted(sizes.order, reverse=True):
        while sizes.count.get(a):
            room = capacity - a
            b = sizes.largest(room, a)
            if not b:
                bin_ = (a,)
            elif b == room or sizes.smallest_sum(2, a) > room:
                bin_ = (a, b)
            else:
                c = sizes.largest(room - b, a, b)
                if not c or sizes.smallest_sum(3, a) <= room or c < sizes.largest(room // 2, a):
                    break
                bin_ = (a, b, c)
            n = min(sizes.count[s] // bin_.count(s) for s in bin_)
            for s in set(bin_):
                sizes.take(s, n * bin_.count(s))
            fixed.append((bin_, n))
    return fixed


def best_fit(sizes: _Sizes, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit, largest first, over counts: every item goes to the open bin with the least room that holds it."""
    groups: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    rooms: list[int] = []

    def put(bin_: tuple[int, ...], room: int, n: int) -> None:
        if n:
            if room not in groups:
                bisect.insort(rooms, room)
                groups[room] = []
            groups[room].append((bin_, n))

    for s in sorted(sizes.order, reverse=True):
        n = sizes.count[s]
        while n:
            at = bisect.bisect_left(rooms, s)
            if at < len(rooms):
                room = rooms[at]
                bin_, have = groups[room].pop()
                if not groups[room]:
                    del groups[room], rooms[at]
            else:
                bin_, have, room = (), n, capacity
            each = room // s
            full, rest = min(have, n // each), n % each
            put(bin_ + (s,) * each, room - each * s, full)
            n -= full * each
            if full < have and n and n < each:
                put(bin_ + (s,) * rest, room - rest * s, 1)
                full, n = full + 1, 0
            if bin_:
                put(bin_, room, have - full)
    return [x for found in groups.values() for x in found]


def plan(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """(sizes of one sequence, number of such sequences) that hold ``counts`` items of each size."""
    sizes = _Sizes(counts)
    return reduce_dominated(sizes, capacity) + best_fit(sizes, capacity)


def _segments(patterns: list[tuple[tuple[int, ...], int]]) -> np.ndarray:
    """Rows (size, first rank, sequence, offset, items of the size side by side) by size and rank."""
    rows, rank, sequence = [], {}, 0
    for bin_, n in patterns:
        offset, at = 0, 0
        while at < len(bin_):
            s, run = bin_[at], 1
            while at + run < len(bin_) and bin_[at + run] == s:
                run += 1
            lo = rank.get(s, 0)
            rows.append((s, lo, sequence, offset, run))
            rank[s] = lo + n * run
            offset, at = offset + s * run, at + run
        sequence += n
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pack(docs: DataFrame, tokenizer_json: str, capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """Place all of ``docs(doc_id, text)`` into as few sequences of at most ``capacity`` ids as the method finds.

    Returns one row per piece: doc_id, piece, start, length, ids, ids_crc32, sequence_id, offset. A null text is empty
    and gives the end id alone; repeated rows and null ids are packed each for itself; other columns are left out; an
    empty table gives no rows. Only the counts per length (``capacity`` rows at most) pass through the driver, and the
    plan that is broadcast has a row per run of equal sizes in a pattern, so it grows with the capacity alone.
    """
    pieces = stage(tokenize(docs, tokenizer_json, capacity, end_id), "pieces")
    by_task = stage(pieces.groupBy("part", "length").agg(F.count("*").alias("n")), "lengths")
    counts = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    table = _segments(plan(counts, capacity))
    keys = (table[:, 0] << 45) | table[:, 1]
    shared = docs.sparkSession.sparkContext.broadcast((keys, table))

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        keys, table = shared.value
        size, number = length.to_numpy(np.int64), rank.to_numpy(np.int64)
        row = table[np.searchsorted(keys, (size << 45) | number, "right") - 1]
        copy, nth = np.divmod(number - row[:, 1], row[:, 4])
        return pd.DataFrame({"sequence_id": row[:, 2] + copy, "offset": row[:, 3] + nth * size})

    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = by_task.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    placed = pieces.join(bases, ["part", "length"]).withColumn("at", place("length", F.col("base") + F.col("nth")))
    return placed.select("doc_id", "piece", "start", "length", "ids", "ids_crc32", "at.sequence_id", "at.offset")
