"""SimHash near-duplicates: fingerprints of word shingles, and their components within a few differing bits.

Method: pivot distance tables. Every fingerprint's Hamming distances to many reference fingerprints are computed once;
two fingerprints that differ in at most ``radius`` bits differ by at most that in every coordinate, so a pair with a
larger coordinate difference is discarded and only survivors are compared.

The table also says which pairs meet at all. Besides whole-width references there is, for each of ``BLOCKS`` blocks of
bits, a sub-table: distances to references that differ from the zero reference in one bit of the block. ``radius``
differing bits touch at most ``radius`` blocks, so a linked pair has equal sub-tables (coordinate difference 0) in at
least ``BLOCKS - radius`` blocks. Rows meet under each choice of that many sub-tables; a crowded meeting place is dealt
into chunk pairs. A task returns a spanning forest of what it verified, never all pairs.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from framegate.llm.common import components, extend, map_groups, numbered, order_id, stage, text_or_empty

WORDS, RADIUS, BLOCKS, PIVOTS, SEED = 3, 3, 5, 24, 42
#: Fingerprints of one meeting place that are compared in one go.
CHUNK = 4096
#: Shingles hashed at a time, for texts of any length.
STEP = 1 << 16


def fingerprint(text: str, words: int = WORDS) -> int:
    """A bit is 1 if it is set in over half the shingles' hashes; no words give zero."""
    tokens = text.encode().lower().split()
    n = len(tokens) - words + 1
    if not tokens:
        return 0
    if n < 1:
        return xxhash.xxh64_intdigest(b" ".join(tokens), SEED)
    ones = np.zeros(64, np.int64)
    for lo in range(0, n, STEP):
        part = tokens[lo : lo + STEP + words - 1]
        line = b" ".join(part)
        ends = np.cumsum(np.fromiter(map(len, part), np.int64, len(part)) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        m = len(part) - words + 1
        spans = zip(starts[:m].tolist(), ends[words - 1 :].tolist())
        hashes = np.fromiter((xxhash.xxh64_intdigest(line[a:b], SEED) for a, b in spans), np.uint64, m)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(sum(1 << i for i in range(64) if 2 * ones[i] > n))


def fingerprints(docs: DataFrame, words: int = WORDS, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``carry`` columns and ``print`` (the fingerprint's bits as a signed long) of every row; null is empty."""

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        found = [fingerprint(t, words) for t in batch.column("__text").to_pylist()]
        return [pa.array(np.array(found, np.uint64).view(np.int64))]

    return extend(docs.select(*carry, text_or_empty().alias("__text")), list(carry), run, "print long")


def references(pivots: int = PIVOTS, seed: int = SEED) -> np.ndarray:
    """Whole-width reference fingerprints, drawn once and the same for every input."""
    return np.random.default_rng(seed).integers(0, 1 << 64, pivots, np.uint64, endpoint=False)


def distance_table(prints: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.bitwise_count(prints[:, None] ^ pivots[None, :]).astype(np.int8)


def close_pairs(left: np.ndarray, right: np.ndarray, pivots: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all pairs within ``radius`` bits: windows on the first coordinate, then coordinate after
    coordinate on what is left, then the bits themselves."""
    a, b = distance_table(left, pivots), distance_table(right, pivots)
    order = np.argsort(b[:, 0], kind="stable")
    first = b[order, 0]
    lo = np.searchsorted(first, a[:, 0] - radius, "left")
    n = np.searchsorted(first, a[:, 0] + radius, "right") - lo
    found_i, found_j = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    block = max(1, (1 << 20) // max(1, len(right)))
    for at in range(0, len(left), block):
        m = n[at : at + block]
        i = np.repeat(np.arange(at, at + len(m)), m)
        j = order[np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m) + np.repeat(lo[at : at + block], m)]
        for k in range(1, len(pivots)):
            if len(i) < 64:
                break
            near = np.abs(a[i, k] - b[j, k]) <= radius
            i, j = i[near], j[near]
        near = np.bitwise_count(left[i] ^ right[j]) <= radius
        found_i.append(i[near])
        found_j.append(j[near])
    return np.concatenate(found_i), np.concatenate(found_j)


def _forest(i: list[int], j: list[int], n: int) -> Iterator[tuple[int, int]]:
    parent = list(range(n))

    def top(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in zip(i, j):
        x, y = top(a), top(b)
        if x != y:
            parent[max(x, y)] = min(x, y)
            yield a, b


def _meeting_keys(value: Column, radius: int, blocks: int) -> Column:
    """One key per choice of ``blocks - radius`` blocks: the block choice and its sub-tables.

    The distances to the zero reference and to the reference with bit i alone differ by +1 or -1 as bit i is 0 or 1, so
    a block's sub-table is written as the block's bits.
    """
    edges = [round(i * 64 / blocks) for i in range(blocks + 1)]
    masks = [sum(1 << b for b in range(lo, hi)) for lo, hi in zip(edges, edges[1:])]
    keys = []
    for k, chosen in enumerate(itertools.combinations(masks, blocks - radius)):
        mask = sum(chosen)
        signed = mask - (1 << 64) if mask >> 63 else mask
        keys.append(F.struct(F.lit(k).alias("choice"), value.bitwiseAND(F.lit(signed)).alias("bits")))
    return F.explode(F.array(*keys))


def links(prints: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, chunk: int = CHUNK) -> DataFrame:
    """A table ``(a, b)`` of verified links whose components are those of all links between distinct ``print`` values."""
    rows = prints.select("print", _meeting_keys(F.col("print"), radius, blocks).alias("key"))
    rows = rows.select("print", "key.choice", "key.bits")
    sizes = rows.groupBy("choice", "bits").agg(F.count("*").alias("n")).where("n > 1")
    chunks = F.ceil(F.col("n") / chunk).cast("int")
    met = rows.join(sizes.select("choice", "bits", chunks.alias("c")), ["choice", "bits"])
    own = F.pmod(F.xxhash64("print", F.lit(SEED)), F.col("c")).cast("int")
    others = F.sequence(F.lit(0), F.col("c") - 1)
    both = F.transform(others, lambda i: F.struct(F.least(i, "own").alias("x"), F.greatest(i, "own").alias("y")))
    dealt = met.withColumn("own", own).withColumn("p", F.explode(both))
    dealt = dealt.select("choice", "bits", "p.x", "p.y", "own", "print")
    pivots = references()

    def compare(group: dict[str, np.ndarray]) -> list[tuple]:
        values, own, x, y = group["print"].view(np.uint64), group["own"], group["x"][0], group["y"][0]
        left, right = np.flatnonzero(own == x), np.flatnonzero(own == y)
        i, j = close_pairs(values[left], values[right], pivots, radius)
        i, j = left[i], right[j]
        if x == y:
            i, j = i[i < j], j[i < j]
        signed = group["print"]
        return [(int(signed[a]), int(signed[b])) for a, b in _forest(i.tolist(), j.tolist(), len(values))]

    return map_groups(dealt, ["choice", "bits", "x", "y"], compare, "a long, b long")


def near_duplicates(
    docs: DataFrame, words: int = WORDS, radius: int = RADIUS, carry: tuple[str, ...] = ()
) -> DataFrame:
    """``doc_id``, the ``carry`` columns, ``print``, ``root`` and ``component_id`` for every row of ``docs``.

    Equal fingerprints are one node; nodes link at ``radius`` or fewer differing bits; ``component_id`` is the smallest
    doc_id reachable, ``root`` one fingerprint of the component. Null, empty and word-free texts have fingerprint zero and
    link like any other. Repeated rows and ids each keep their row; a null doc_id keeps its row and never is the smallest
    while another is there. Other columns are left out; an empty table gives no rows.
    """
    rows = stage(fingerprints(docs, words, ("doc_id", *carry)), "prints")
    nodes = stage(rows.groupBy("print").agg(F.min("doc_id").alias("first")), "nodes")
    roots = components(links(nodes.select("print"), radius), "simhash")
    rooted = nodes.join(roots.withColumnRenamed("node", "print"), "print", "left")
    rooted = stage(rooted.select("print", "first", F.coalesce("root", "print").alias("root")), "roots")
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.join(least, "root").select("print", "root", "component_id")
    return rows.join(named, "print").select("doc_id", *carry, "print", "root", "component_id")


def keep_one(docs: DataFrame, words: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """The rows of ``docs`` that stay: of each component, the row with the smallest doc_id (one of them if repeated)."""
    rows = numbered(docs)
    found = near_duplicates(rows, words, radius, ("__row",))
    kept = found.groupBy("root").agg(F.min(F.struct(order_id(), "__row")).getField("__row").alias("__row"))
    return rows.join(kept.select("__row"), "__row", "left_semi").select(*docs.columns)


def hex_print(value: str = "print") -> Column:
    return F.lower(F.lpad(F.hex(F.col(value)), 16, "0"))
