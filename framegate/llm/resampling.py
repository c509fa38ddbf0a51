"""Importance resampling towards a target distribution: documents whose features are likelier in the target are drawn
with a larger probability, without replacement.

Features (words and pairs of words) are hashed to buckets, and two counts per bucket give its gain. A document's weight is
the mean gain of its features, summed from arrays; its score adds Gumbel noise that hangs on its doc_id, so the largest
scores are a weighted draw. The draw's cutoff is found exactly by weighted medians of medians: in every round each chunk of
the keys that are left gives its median, the median of these weighted by the sizes of the chunks is the pivot, and at
least a quarter of the keys falls away. Only the winners are sorted.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from framegate.llm.common import bounded_batches, extend, order_id, ship, stage, text_or_empty
from framegate.llm.licenses import FOLD
from framegate.operators.order import global_rank

BUCKETS, MIN_WORDS, PERCENT, SEED, SCALE = 10_000, 20, 25, 7, 1000
#: Bytes of text whose words are held in arrays at a time, keys of a chunk, and keys that are sorted without a pivot.
SLICE, CHUNK, FEW = 4 << 20, 1 << 20, 1 << 12
#: Longest word for which the checksums of pairs are combined by tables.
TABLE_BYTES = 48
#: Fixed value: the reversed polynomial of crc32.
POLYNOMIAL = np.uint32(0xEDB88320)


def _byte_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, table >> np.uint32(1) ^ POLYNOMIAL, table >> np.uint32(1))
    return table


def shift_tables(most: int = TABLE_BYTES) -> np.ndarray:
    """For n = 0 ... most bytes, and each of the four bytes of a checksum, what n zero bytes make of it."""
    step = _byte_table()
    now = (np.arange(256, dtype=np.uint32)[None, :] << (np.arange(4, dtype=np.uint32) * np.uint32(8))[:, None]).astype(np.uint32)
    out = [now]
    for _ in range(most):
        now = now >> np.uint32(8) ^ step[now & np.uint32(0xFF)]
        out.append(now)
    return np.stack(out)


_SHIFT = shift_tables()


def joined_crc(first: np.ndarray, second: np.ndarray, sizes: np.ndarray, words: list[bytes], at: np.ndarray) -> np.ndarray:
    """crc32 of x + y from crc32(x), crc32(y) and the size of y; ``words[at]`` are the y, for the very long ones."""
    n = np.minimum(sizes, TABLE_BYTES)
    out = second.copy()
    for k in range(4):
        out ^= _SHIFT[n, k, first >> np.uint32(8 * k) & np.uint32(0xFF)]
    for i in np.flatnonzero(sizes > TABLE_BYTES).tolist():
        out[i] = zlib.crc32(words[at[i]], int(first[i]))
    return out


def _runs(lines: list[bytes], size: int) -> Iterator[list[tuple[int, bytes, bool]]]:
    """(text number, part, whether it goes on with the part before) in runs of about ``size`` bytes; lines are cut at
    spaces only."""
    held: list[tuple[int, bytes, bool]] = []
    room = size
    for i, line in enumerate(lines):
        at = 0
        while at == 0 or at < len(line):
            end = line.find(b" ", at + room) + 1 or len(line)
            held.append((i, line[at:end], at > 0))
            room -= end - at
            if room <= 0:
                yield held
                held, room = [], size
            at = end or 1
    if held:
        yield held


def feature_buckets(texts: list[str], buckets: int = BUCKETS, size: int = SLICE) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(text numbers and buckets of features, words per text) in parts of bounded size: every word and every two
    neighbouring words joined by a space, repeats too."""
    lines = [t.encode().translate(FOLD) for t in texts]
    last: list[bytes] = []
    for run in _runs(lines, size):
        index: dict[bytes, int] = {}
        codes, counts, repeated = [], [], []
        for _, part, goes_on in run:
            # A part that goes on starts with the last word before it, which only counts in the pair across the cut.
            head = last if goes_on else []
            words = head + part.split()
            repeated += [sum(counts)] * len(head)
            counts.append(len(words))
            codes += [index.setdefault(w, len(index)) for w in words]
            last = words[-1:]
        if not codes:
            continue
        words, code = list(index), np.array(codes)
        of = np.repeat([i for i, _, _ in run], counts)
        new = np.ones(len(code), bool)
        new[repeated] = False
        crc = np.array([zlib.crc32(w) for w in words], np.uint32)
        spaced = np.array([zlib.crc32(b" ", c) for c in crc.tolist()], np.uint32)
        length = np.fromiter(map(len, words), np.int64, len(words))
        pair = np.flatnonzero((of[1:] == of[:-1]) & new[1:])
        second = code[pair + 1]
        two = joined_crc(spaced[code[pair]], crc[second], length[second], words, second)
        found = np.concatenate([crc[code[new]], two]).astype(np.int64) % buckets
        yield np.concatenate([of[new], of[pair]]), found, np.bincount(of[new], minlength=len(texts))


def count_buckets(texts: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Features per bucket over all of ``texts(text)``; every task sums its own, the driver gets one number a bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, found, _ in feature_buckets(batch.column(0).to_pylist(), buckets):
                total += np.bincount(found, minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at])], ["bucket", "n"])

    bounded_batches(texts.sparkSession)
    parts = texts.select(text_or_empty()).mapInArrow(run, "bucket long, n long")
    out = np.zeros(buckets, np.int64)
    for row in parts.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[row["bucket"]] = row["n"]
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln(share in the target / share in the raw corpus)) per bucket, smoothed by one."""
    s, t, size = int(raw.sum()), int(target.sum()), len(raw)
    return np.array(
        [math.floor(SCALE * math.log((b + 1) * (s + size) / ((a + 1) * (t + size)))) for a, b in zip(raw.tolist(), target.tolist())], np.int64
    )


def noise(doc_id: int | None, seed: int = SEED) -> int:
    """Gumbel noise in thousandths, from a hash of the seed and the id (a missing id: no digits)."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-SCALE * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gain: np.ndarray, seed: int = SEED) -> DataFrame:
    """``doc_id, id, n_words, n_features, weight, score`` of every row of ``docs``."""
    shared = ship(docs.sparkSession, gain)

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        gain, n = shared(), batch.num_rows
        words, total = np.zeros(n, np.int64), np.zeros(n, np.int64)
        for of, found, count in feature_buckets(batch.column("__text").to_pylist(), len(gain)):
            words += count
            np.add.at(total, of, gain[found])
        features = np.maximum(2 * words - 1, 0)
        weight = total // np.maximum(features, 1)
        score = weight + np.fromiter((noise(i, seed) for i in batch.column("doc_id").to_pylist()), np.int64, n)
        return [pa.array(c, pa.int64()) for c in (words, features, weight, score)]

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), order_id().alias("id"), text_or_empty().alias("__text"))
    return extend(rows, ["doc_id", "id"], run, "n_words long, n_features long, weight long, score long")


class Key(NamedTuple):
    """A place in the order of the draw: larger scores first, then smaller ids, then rows."""

    score: int
    id: int
    row: int

    def before(self) -> Column:
        """Rows that come before this key."""
        s, i, r = F.col("score"), F.col("id"), F.col("row")
        return (s > self.score) | ((s == self.score) & ((i < self.id) | ((i == self.id) & (r < self.row))))

    def after(self) -> Column:
        s, i, r = F.col("score"), F.col("id"), F.col("row")
        return (s < self.score) | ((s == self.score) & ((i > self.id) | ((i == self.id) & (r > self.row))))


def _medians(keys: DataFrame, pivot: Key | None, chunk: int) -> list[tuple[int, int, Key]]:
    """Per chunk of at most ``chunk`` keys: (side, keys there, their median) for those before (0) and after (1) the pivot."""

    def summary(score: np.ndarray, ident: np.ndarray, row: np.ndarray) -> Iterator[tuple]:
        if pivot is None:
            sides = [np.arange(len(score))]
        else:
            s, i, r = pivot
            ahead = (score > s) | ((score == s) & ((ident < i) | ((ident == i) & (row < r))))
            sides = [np.flatnonzero(ahead), np.flatnonzero(~ahead & ~((score == s) & (ident == i) & (row == r)))]
        for side, at in enumerate(sides):
            if len(at):
                order = at[np.lexsort((row[at], ident[at], -score[at]))]
                mid = order[len(order) // 2]
                yield side, len(at), score[mid], ident[mid], row[mid]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = [[], [], []]
        rows = 0

        def done() -> pa.RecordBatch:
            found = list(zip(*summary(*(np.concatenate(h) for h in held)))) or [[]] * 5
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in found], ["side", "n", "score", "id", "row"])

        for batch in batches:
            if not batch.num_rows:
                continue
            for h, c in zip(held, batch.columns):
                h.append(c.to_numpy())
            rows += batch.num_rows
            if rows >= chunk:
                yield done()
                held, rows = [[], [], []], 0
        if rows:
            yield done()

    bounded_batches(keys.sparkSession)
    found = keys.select("score", "id", "row").mapInArrow(run, "side long, n long, score long, id long, row long").collect()
    return [(f["side"], f["n"], Key(f["score"], f["id"], f["row"])) for f in found]


def cutoff(keys: DataFrame, k: int, chunk: int = CHUNK, few: int = FEW) -> Key:
    """The k-th key (from 1) of ``keys(score, id, row)`` in the order of the draw, exactly; ``keys`` has at least k.

    A row per chunk of ``chunk`` keys comes to the driver in each round, and at most ``few`` keys at the end.
    """
    low, high, pivot = None, None, None
    left = keys
    while True:
        found = _medians(left, pivot, chunk)
        if pivot is not None:
            ahead = sum(n for side, n, _ in found if side == 0)
            if ahead == k - 1:
                return pivot
            side = 0 if ahead >= k else 1
            low, high, k = (low, pivot, k) if side == 0 else (pivot, high, k - ahead - 1)
            found = [f for f in found if f[0] == side]
        left = keys
        for bound in (low and low.after(), high and high.before()):
            left = left if bound is None else left.where(bound)
        size = sum(n for _, n, _ in found)
        if size <= few:
            rest = left.select("score", "id", "row").collect()
            return sorted((Key(*r) for r in rest), key=lambda q: (-q.score, q.id, q.row))[k - 1]
        found.sort(key=lambda f: (-f[2].score, f[2].id, f[2].row))
        sums = np.cumsum([n for _, n, _ in found])
        pivot = found[int(np.searchsorted(sums, (size + 1) // 2))][2]


def resample(
    docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, seed: int = SEED, chunk: int = CHUNK, few: int = FEW
) -> DataFrame:
    """``doc_id, n_features, weight, score, rank`` of every row of ``docs``; ``target`` has a column ``text``.

    Of the documents with ``min_words`` words or more, ``percent`` in a hundred (rounded down) with the largest scores are
    drawn and ranked from 1; the others have a null rank. Ties go to the smaller doc_id, then to either of the rows. A
    null text has no words, weight 0, and is never drawn; a null doc_id comes last among ties and hashes as no digits;
    repeated rows count and may be drawn each. An empty target gives every word the gain of an unseen one; empty
    ``docs`` give no rows. Other columns, whatever their names, play no part.
    """
    gain = gains(count_buckets(docs), count_buckets(target))
    rows = stage(scored(docs, gain, seed).withColumn("row", F.monotonically_increasing_id()), "scored")
    keys = rows.where(F.col("n_words") >= min_words)
    k = percent * keys.count() // 100
    columns = ["doc_id", "n_features", "weight", "score"]
    none = F.lit(None).cast("long").alias("rank")
    if not k:
        return rows.select(*columns, none)
    last = cutoff(keys, k, chunk, few)
    drawn = (F.col("n_words") >= min_words) & ~last.after()
    winners = global_rank(rows.where(drawn), [F.desc("score"), "id", "row"], "rank")
    return winners.select(*columns, "rank").unionByName(rows.where(~drawn).select(*columns, none))
