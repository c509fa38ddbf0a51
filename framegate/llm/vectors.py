"""Near-duplicate embeddings by a pivot-permutation index.

A vector is described by its nearest reference points in order. Two near vectors have mostly the same nearest points, so
candidates are retrieved through inverted lists: here a list per pair of reference points, which holds a vector under
every pair of its ``NEAREST`` points, that is, all vectors that share at least two. A candidate pair is verified by its
cosine in double precision, and counted in the list of its two smallest shared points only.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from framegate.llm.common import components, extend, map_groups, numbered, stage

COSINE = 0.93
#: Reference points are at most so many vectors out of a sample of SAMPLED times as many, taken by the hash of vec_id, and
#: then seeded random directions; every vector is indexed under its NEAREST ones. Reference points lie APART (their cosines
#: are smaller): near copies of one vector would else supply many of them, whose order within the group is noise.
PIVOTS, NEAREST, SEED, SAMPLED, APART = 256, 7, 11, 16, 0.8
#: Vectors of a list that are compared in one go.
CHUNK = 1024


def usable(embedding: str = "embedding") -> "F.Column":
    """Not null, no null or non-finite component, not zero."""
    values = F.col(embedding)
    finite = F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return values.isNotNull() & F.coalesce(finite & F.exists(values, lambda x: x != 0), F.lit(False))


def unit(vectors: np.ndarray) -> np.ndarray:
    found = vectors / np.abs(vectors).max(1, keepdims=True)
    return found / np.sqrt((found * found).sum(1, keepdims=True))


def spread_out(vectors: np.ndarray, pivots: int = PIVOTS) -> np.ndarray:
    """The first ``pivots`` unit vectors, in order, that lie apart from those taken before."""
    taken = np.empty((0, vectors.shape[1]))
    for v in vectors:
        if len(taken) == pivots:
            break
        if not len(taken) or (taken @ v).max() < APART:
            taken = np.vstack([taken, v])
    return taken


def reference_points(sample: list[list[float]], pivots: int = PIVOTS) -> dict[int, np.ndarray]:
    by_length: dict[int, list[list[float]]] = {}
    for v in sample:
        by_length.setdefault(len(v), []).append(v)
    return {n: spread_out(np.vstack([unit(np.array(vs, float)), directions(n, pivots)]), pivots) for n, vs in by_length.items()}


def directions(n: int, pivots: int = PIVOTS) -> np.ndarray:
    return unit(np.random.default_rng(SEED).normal(size=(pivots, n)))


def nearest_points(vectors: np.ndarray, points: np.ndarray, nearest: int = NEAREST) -> np.ndarray:
    """The ``nearest`` reference points of every vector, nearest first, ties to the smaller number. Where so many do not
    lie apart, negative numbers that all vectors share stand for the rest."""
    near = unit(vectors) @ points.T
    found = np.argsort(-near, axis=1, kind="stable")[:, :nearest]
    rest = np.arange(-1, found.shape[1] - nearest - 1, -1)
    return np.hstack([found, np.tile(rest, (len(found), 1))])


def describe(nodes: DataFrame, sample: list[list[float]], pivots: int = PIVOTS, nearest: int = NEAREST) -> DataFrame:
    """``nodes`` with ``points``: their nearest reference points in order."""
    by_length = reference_points(sample, pivots)
    shared = nodes.sparkSession.sparkContext.broadcast(by_length)

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        vectors = batch.column("embedding").to_pylist()
        lengths = np.array([len(v) for v in vectors])
        out = np.zeros((len(vectors), nearest), np.int32)
        for n in np.unique(lengths):
            points = shared.value.get(int(n))
            if points is None:
                points = spread_out(directions(int(n), pivots), pivots)
            own = np.flatnonzero(lengths == n)
            out[own] = nearest_points(np.array([vectors[i] for i in own], float), points, nearest)
        return [pa.array(list(out), pa.list_(pa.int32()))]

    return extend(nodes, nodes.columns, run, "points array<int>")


def forest(near: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect what the symmetric matrix ``near`` connects; every row is looked at once."""
    out, fresh = [], near.any(1)
    while fresh.any():
        front = [int(np.argmax(fresh))]
        fresh[front[0]] = False
        while front:
            a = front.pop()
            new = np.flatnonzero(near[a] & fresh)
            fresh[new] = False
            out += [(a, int(b)) for b in new]
            front += new.tolist()
    return out


def linked(described: DataFrame, cosine: float = COSINE, nearest: int = NEAREST, chunk: int = CHUNK) -> DataFrame:
    """``a, b, n``: from every list, n > 0 other vectors that ``a`` links with (b = a), and links (n = 0) that connect
    what the list links."""
    pairs = list(itertools.combinations(range(nearest), 2))
    points = F.sort_array("points")
    keys = F.array(*(F.struct(points[i].alias("p"), points[j].alias("q")) for i, j in pairs))
    kept = described.select("__row", "label", F.size("embedding").alias("width"), "w", "embedding", points.alias("points"), F.explode(keys).alias("key"))
    rows = kept.select("__row", "label", "width", "w", "embedding", "points", "key.p", "key.q")
    place = ["label", "width", "p", "q"]
    sizes = rows.groupBy(*place).agg(F.count("*").alias("n")).where("n > 1")
    met = rows.join(sizes.select(*place, F.ceil(F.col("n") / chunk).cast("int").alias("c")), place)
    met = met.withColumn("own", F.pmod(F.xxhash64("__row", F.lit(SEED)), F.col("c")).cast("int"))
    others = F.transform(F.sequence(F.lit(0), F.col("c") - 1), lambda i: F.struct(F.least(i, "own").alias("x"), F.greatest(i, "own").alias("y")))
    dealt = met.withColumn("pair", F.explode(others)).select(*place, "pair.x", "pair.y", "own", "__row", "w", "embedding", "points")

    def compare(group: dict[str, np.ndarray]) -> list[tuple]:
        vectors = unit(np.stack(group["embedding"]).astype(float))
        own, x, y = group["own"], group["x"][0], group["y"][0]
        left, right = np.flatnonzero(own == x), np.flatnonzero(own == y)
        points, p, q = np.stack(group["points"]), group["p"][0], group["q"][0]
        # A pair belongs here unless it shares a smaller point than q beside p.
        others = np.unique(points[(points < q) & (points != p)])
        held = (points[:, :, None] == others).any(1).astype(np.float32)
        mine = (held[left] @ held[right].T < 0.5) & (vectors[left] @ vectors[right].T >= cosine)
        if x == y:
            mine &= ~np.eye(len(left), dtype=bool)
        if not mine.any():
            return []
        rows, weight = group["__row"], group["w"]
        n = np.zeros(len(rows), np.int64)
        n[left] += mine @ weight[right]
        if x != y:
            n[right] += weight[left] @ mine
        near = np.zeros((len(rows), len(rows)), bool)
        near[np.ix_(left, right)] = mine
        out = [(int(rows[k]), int(rows[k]), int(n[k])) for k in np.flatnonzero(n)]
        return out + [(int(rows[a]), int(rows[b]), 0) for a, b in forest(near | near.T)]

    return map_groups(dealt, [*place, "x", "y"], compare, "a long, b long, n long")


def near_vectors(vectors: DataFrame, cosine: float = COSINE, pivots: int = PIVOTS, nearest: int = NEAREST) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of ``vectors(vec_id, embedding, label)``.

    Vectors link if their labels are equal and not null, their lengths are equal and their cosine is at least ``cosine``.
    Vectors that are null, zero or hold null or non-finite components link with nothing and are their own component.
    Equal vectors of one label are one node with a weight; each counts the others. ``component_id`` is the smallest vec_id
    reachable, ``kept`` says that it is the row's own. Repeated rows are vectors of their own; a null vec_id keeps its row
    and is the smallest of none. Other columns are left out; an empty table gives no rows.
    """
    rows = vectors.select(F.col("vec_id").cast("long"), "embedding", "label")
    fit = usable() & F.col("label").isNotNull()
    grouped = rows.where(fit).groupBy("label", "embedding").agg(F.count("*").alias("w"), F.min("vec_id").alias("first"))
    nodes = numbered(grouped, "vectors")
    chosen = nodes.orderBy(F.xxhash64("first"), "__row").limit(SAMPLED * pivots).select("embedding")
    described = stage(describe(nodes, [r["embedding"] for r in chosen.collect()], pivots, nearest), "described")
    found = stage(linked(described, cosine, nearest), "linked")
    counts = found.groupBy(F.col("a").alias("__row")).agg(F.sum("n").alias("n")).where("n > 0")
    roots = components(found.where("a <> b").select("a", "b"), "vectors").withColumnRenamed("node", "__row")
    named = nodes.join(counts, "__row", "left").join(roots, "__row", "left")
    named = named.select("label", "embedding", "w", "first", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("root", "__row").alias("root"))
    named = stage(named, "rooted")
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    named = named.join(least, "root").select("label", "embedding", (F.col("n") + F.col("w") - 1).alias("n"), "component_id")
    joined = rows.where(fit).join(named, ["label", "embedding"]).select("vec_id", "n", "component_id")
    rest = rows.where(~fit).select("vec_id", F.lit(0).cast("long").alias("n"), F.col("vec_id").alias("component_id"))
    every = joined.unionByName(rest)
    kept = F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False))
    return every.select("vec_id", F.col("n").alias("n_links"), "component_id", kept.alias("kept"))
