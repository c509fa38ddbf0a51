"""Near-duplicates by the sets of word shingles: documents whose Jaccard similarity is at least ``SIMILAR`` link.

Documents meet where their SimHash components (operator 5, over these shingles) are the same, and where they share a band
of minima (``BANDS`` bands of ``WIDTH``: at a similarity of 0.8 a pair is missed with a probability of 0.0002, above it
with less). Groups with the same members are looked at once. In every group all members first meet the one that meets
most others, so that the copies of a text become one component by a linear number of comparisons. What then still lies in
different components is compared inside the group: blocks of members are multiplied as incidence matrices, which gives
all their common shingles at once. Every link is decided on the whole sets, and a task returns a spanning forest of its
links, so no table of pairs leaves it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from framegate.llm import simhash
from framegate.llm.common import components, extend, map_groups, numbered, order_id, stage, text_or_empty, unstage
from framegate.llm.fingerprints import shingle_hashes

WORDS, SIMILAR, BANDS, WIDTH, SEED = 5, 0.8, 16, 4, 42
#: Members, and bytes of their texts, of one side of a comparison; shingles that are multiplied, or hashed, at a time.
CHUNK, CHUNK_BYTES, COLUMNS, STEP = 2048, 32 << 20, 2048, 1 << 14
_MIX = np.random.default_rng(SEED).integers(0, 1 << 63, (2, BANDS * WIDTH, 1)).astype(np.uint64) * np.uint64(2) + np.uint64(1)
GROUP = ["g", "h", "x", "y"]


def minima(hashes: np.ndarray) -> np.ndarray:
    """The upper halves of the smallest values of ``BANDS * WIDTH`` orders; no shingles give the largest ones."""
    least = np.full(BANDS * WIDTH, (1 << 64) - 1, np.uint64)
    for lo in range(0, len(hashes), STEP):
        least = np.minimum(least, ((hashes[lo : lo + STEP] ^ _MIX[0]) * _MIX[1]).min(1))
    return (least >> np.uint64(32)).astype(np.uint32)


def common_shingles(left: list[np.ndarray], right: list[np.ndarray], columns: int = COLUMNS) -> np.ndarray:
    """How many hashes each set on the left shares with each on the right (sets of distinct hashes)."""
    sides = [np.concatenate([np.empty(0, np.uint64), *s]) for s in (left, right)]
    shared = np.intersect1d(np.unique(sides[0]), np.unique(sides[1]), assume_unique=True)
    places = []
    for sets, values in zip((left, right), sides):
        of = np.repeat(np.arange(len(sets)), list(map(len, sets)))
        at = np.searchsorted(shared, values)
        known = at < len(shared)
        known[known] = shared[at[known]] == values[known]
        of, at = of[known], at[known]
        order = np.argsort(at, kind="stable")
        places.append((of[order], at[order]))
    out = np.zeros((len(left), len(right)), np.int64)
    for lo in range(0, len(shared), columns):
        blocks = []
        for sets, (of, at) in zip((left, right), places):
            a, b = np.searchsorted(at, (lo, lo + columns))
            block = np.zeros((len(sets), min(columns, len(shared) - lo)), np.float32)
            block[of[a:b], at[a:b] - lo] = 1
            blocks.append(block)
        out += (blocks[0] @ blocks[1].T).astype(np.int64)
    return out


def forest(linked: np.ndarray, left: np.ndarray, right: np.ndarray, root: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect what ``linked`` (left by right) connects, one per pair of components that they join."""
    label, out = root.copy(), []
    for i, row in zip(left.tolist(), linked):
        met = right[row & (label[right] != label[i])]
        names, first = np.unique(label[met], return_index=True)
        out += [(i, j) for j in met[first].tolist()]
        if len(names):
            label[np.isin(label, names)] = label[i]
    return out


def described(rows: DataFrame, words: int = WORDS) -> DataFrame:
    """``__row``, ``doc_id``, 128 bits that stand for the shingle set (``x``, ``y``), its minima, the SimHash fingerprint
    and the text's bytes."""

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        texts = batch.column("__text").to_pylist()
        sets = [np.unique(shingle_hashes(t, words)) for t in texts]
        names = np.frombuffer(b"".join(xxhash.xxh3_128_digest(s.tobytes()) for s in sets), np.int64).reshape(-1, 2)
        prints = np.array([simhash.fingerprint(t, words) for t in texts], np.uint64).view(np.int64)
        least = pa.array([minima(s).tobytes() for s in sets], pa.binary())
        return [pa.array(names[:, 0].copy()), pa.array(names[:, 1].copy()), least, pa.array(prints), pa.array([len(t) for t in texts], pa.int64())]

    narrow = rows.select("__row", "doc_id", text_or_empty().alias("__text"))
    return extend(narrow, ["__row", "doc_id"], run, "x long, y long, minima binary, print long, size long")


def _meeting_places(nodes: DataFrame) -> DataFrame:
    """``node, size, band, bits``: a row per band of minima, and one for the SimHash component."""
    wide = 4 * WIDTH
    keys = F.array(*(F.struct(F.lit(k).alias("band"), F.xxhash64(F.substring("minima", 1 + k * wide, wide)).alias("bits")) for k in range(BANDS)))
    bands = nodes.select("node", "size", F.explode(keys).alias("key")).select("node", "size", "key.band", "key.bits")
    found = components(simhash.links(nodes.select("print").distinct()), "prints")
    roots = nodes.join(found.withColumnRenamed("node", "print"), "print", "left")
    return bands.unionByName(roots.select("node", "size", F.lit(BANDS).alias("band"), F.coalesce("root", "print").alias("bits")))


def _parts(n: str, size: str, chunk: int) -> Column:
    """Chunks into which ``n`` members of ``size`` bytes are dealt."""
    return F.ceil(F.greatest(F.col(n) / chunk, F.col(size) / CHUNK_BYTES)).cast("int")


def _chunk_of(node: str, parts: str) -> Column:
    return F.pmod(F.xxhash64(node, F.lit(SEED)), F.col(parts)).cast("int")


def linked(dealt: DataFrame, texts: DataFrame, words: int, similar: float) -> DataFrame:
    """``a, b``: a spanning forest of the links between the sides ``x`` and ``y`` of every group of ``dealt``
    (g, h, x, y, own, node, root) whose components differ."""

    def compare(group: dict[str, np.ndarray]) -> list[tuple]:
        own, root, node = group["own"], group["root"], group["node"]
        left, right = np.flatnonzero(own == group["x"][0]), np.flatnonzero(own == group["y"][0])
        if not len(left) or not len(right):
            return []
        sets = [np.unique(shingle_hashes(t, words)) for t in group["text"]]
        sizes = np.array(list(map(len, sets)))
        both = common_shingles([sets[i] for i in left], [sets[i] for i in right])
        either = sizes[left][:, None] + sizes[right][None, :] - both
        alike = both / np.maximum(either, 1) >= similar
        return [(int(node[i]), int(node[j])) for i, j in forest(alike, left, right, root)]

    rows = dealt.join(texts.select(F.col("__row").alias("node"), "text"), "node")
    return map_groups(rows, GROUP, compare, "a long, b long")


def _stars(met: DataFrame, chunk: int) -> DataFrame:
    """Groups of one member that meets most others and all that it meets; dealt, so that none is large."""
    place = ["band", "bits"]
    reach = met.groupBy("node").agg(F.sum("n").alias("reach"))
    centres = met.join(reach, "node").groupBy(*place).agg(F.max(F.struct("reach", -F.col("node"))).getField("col2").alias("centre"))
    pairs = met.join(centres.select(*place, (-F.col("centre")).alias("g")), place).where("node <> g").select("g", "node", "size").distinct()
    parts = pairs.groupBy("g").agg(F.count("*").alias("n"), F.sum("size").alias("bytes")).select("g", _parts("n", "bytes", chunk).alias("c"))
    rays = pairs.join(parts, "g").select("g", _chunk_of("node", "c").alias("h"), F.lit(1).alias("own"), "node")
    middles = parts.select("g", F.explode(F.sequence(F.lit(0), F.col("c") - 1)).alias("h"), F.lit(0).alias("own"), F.col("g").alias("node"))
    both = rays.unionByName(middles)
    return both.select("g", F.col("h").cast("long").alias("h"), F.lit(0).alias("x"), F.lit(1).alias("y"), "own", "node", F.col("node").alias("root"))


def _left_over(met: DataFrame, roots: DataFrame, chunk: int) -> DataFrame:
    """Members of the places that still hold different components, as pairs of chunks."""
    place = ["band", "bits"]
    rooted = met.where("n > 2").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    sizes = rooted.groupBy(*place).agg(F.count("*").alias("m"), F.sum("size").alias("bytes"), F.min("root").alias("lo"), F.max("root").alias("hi"))
    sizes = sizes.where("lo <> hi").select(*place, _parts("m", "bytes", chunk).alias("c"))
    rows = rooted.join(sizes, place).withColumn("own", _chunk_of("node", "c"))
    others = F.transform(F.sequence(F.lit(0), F.col("c") - 1), lambda i: F.struct(F.least(i, "own").alias("x"), F.greatest(i, "own").alias("y")))
    dealt = rows.withColumn("p", F.explode(others))
    return dealt.select(F.col("band").cast("long").alias("g"), F.col("bits").alias("h"), "p.x", "p.y", "own", "node", "root")


def keep_one(docs: DataFrame, words: int = WORDS, similar: float = SIMILAR, chunk: int = CHUNK) -> DataFrame:
    """The rows of ``docs`` that stay: of each component, the row with the smallest doc_id (one of them if repeated).

    Documents link if the Jaccard similarity of their sets of ``words``-word shingles is at least ``similar``; a shorter
    text is one shingle, and equal sets, empty ones too, are one node. A null text is empty, a null doc_id is larger than
    any other; columns of any name are kept. An empty table gives no rows.
    """
    rows = numbered(docs)
    texts = rows.select("__row", text_or_empty().alias("text"))
    first = F.min(F.struct(order_id(), "__row"))
    found = described(rows, words).groupBy("x", "y").agg(
        F.min("__row").alias("node"), F.max("minima").alias("minima"), F.min("print").alias("print"), F.max("size").alias("size"), first.alias("first")
    )
    nodes = stage(found, "shingled")
    banded = stage(_meeting_places(nodes), "banded")
    place = ["band", "bits"]
    name = [F.count("*").alias("n"), F.bit_xor(F.xxhash64("node")).alias("members"), F.min("node").alias("lo"), F.max("node").alias("hi")]
    groups = banded.groupBy(*place).agg(*name).where("n > 1")
    groups = groups.groupBy("n", "members", "lo", "hi").agg(F.min(F.struct(*place)).alias("place"))
    met = stage(banded.join(groups.select("place.*", "n"), place), "met")
    links = stage(linked(_stars(met, chunk), texts, words, similar), "links")
    roots = stage(components(links, "alike"), "roots")
    more = stage(linked(_left_over(met, roots, chunk), texts, words, similar), "links")
    roots = components(links.unionByName(more), "alike")
    rooted = nodes.join(roots, "node", "left").select(F.coalesce("root", "node").alias("root"), "first")
    kept = stage(rooted.groupBy("root").agg(F.min("first").getField("__row").alias("__row")).select("__row"), "kept")
    unstage(nodes, banded, met, links, more)
    return rows.join(kept, "__row", "left_semi").select(*docs.columns)
