"""Spatial joins on a grid: rows meet on (frame, cell), so a crowded frame spreads over its cells."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from framegate.functions.geometry import clip, square_crop_box, whole
from framegate.operators.ranking import keep_first, top_per_key
from framegate.runtime import broadcast_if_small, stage, unsized

CELL = 32
# Side of a block of suppression, in largest radii of its frame.
BLOCK = 64
# Circles of a frame that a task settles at once; a frame with more is cut to blocks.
FRAME_ROWS = 4096
# Odd factors that make one number of a frame and a cell; equal numbers of different cells only cost a closer look.
_ROW, _FRAME = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
CIRCLE = ["frame_id", "cx", "cy", "radius"]


def cell(value: Column, size: int) -> Column:
    return F.floor(value / F.lit(size)).cast("bigint")


def in_cells(df: DataFrame, x: str, y: str, size: int = CELL) -> DataFrame:
    return df.withColumns({"_gx": cell(F.col(x), size), "_gy": cell(F.col(y), size)})


def over_cells(df: DataFrame, x0: Column, y0: Column, x1: Column, y1: Column, size: int = CELL) -> DataFrame:
    """One row per grid cell that the closed box touches."""
    by_x = df.withColumn("_gx", F.explode(F.sequence(cell(x0, size), cell(x1, size))))
    return unsized(by_x.withColumn("_gy", F.explode(F.sequence(cell(y0, size), cell(y1, size)))))


def around(df: DataFrame, reach: Column, size: int = CELL) -> DataFrame:
    cx, cy = F.col("cx"), F.col("cy")
    return over_cells(df, cx - reach, cy - reach, cx + reach, cy + reach, size)


def squared_distance(ax, ay, bx, by) -> Column:
    return (ax - bx) * (ax - bx) + (ay - by) * (ay - by)


def distinct_circles(circles: DataFrame) -> DataFrame:
    """One row per frame and geometry with its multiplicity, so copies never meet each other."""
    return circles.groupBy(*CIRCLE).agg(F.count("*").alias("copies"))


def _grid_level(reach: Column) -> Column:
    """The power of two, as its exponent, of a grid whose cells are at least four times as wide as ``reach``."""
    return F.ceil(F.log2(F.greatest(reach * 4, F.lit(CELL)).cast("double"))).cast("bigint")


def circle_neighbours(circles: DataFrame) -> DataFrame:
    """Per distinct circle: circles in conflict (closer than the larger radius) and neighbours in the ring
    0.5 to 2.5 radii with 0.4 to 1.6 times the radius. Circles of the same geometry do not count.

    A circle asks in a grid of its own size, so it is copied to four cells at most, and to few of them; the others stand in
    the grids that askers of their size use. A pair is met once and counts for both sides in one aggregate.
    """
    own = distinct_circles(circles)
    reach = F.ceil(F.col("radius") * 2.5)
    # At most one level per power of two of the radii.
    found = circles.filter("radius IS NOT NULL").select(_grid_level(reach).alias("level")).distinct().collect()
    levels = F.array(*[F.lit(r["level"]) for r in found]).cast("array<bigint>")
    width = F.pow(F.lit(2.0), F.col("_level"))

    def placed(df: DataFrame, x: str, y: str) -> DataFrame:
        return df.withColumns({"_gx": F.floor(F.col(x) / width).cast("bigint"), "_gy": F.floor(F.col(y) / width).cast("bigint")})

    def cells(at: str) -> Column:
        low, high = (F.floor((F.col(at) + side) / width).cast("bigint") for side in (-reach, reach))
        return F.explode(F.sequence(low, high))

    asking = own.withColumn("_level", _grid_level(reach))
    seen = unsized(asking.withColumn("_gx", cells("cx")).withColumn("_gy", cells("cy")))
    other = own.select(
        "frame_id", F.col("cx").alias("ox"), F.col("cy").alias("oy"), F.col("radius").alias("orad"),
        F.col("copies").alias("ocopies"), F.explode(levels).alias("_level"),
    )
    # No asker of a grid has a radius over a tenth of its cells, and none looks for more than 1.6 times its own.
    other = placed(other.filter(F.col("orad") * 6 <= width), "ox", "oy")
    met = seen.join(other, ["frame_id", "_level", "_gx", "_gy"])
    d2 = squared_distance(F.col("cx"), F.col("cy"), F.col("ox"), F.col("oy"))
    differs = ~((F.col("ox") == F.col("cx")) & (F.col("oy") == F.col("cy")) & (F.col("orad") == F.col("radius")))
    r = F.col("radius").cast("double")
    in_ring = (d2 > 0.25 * r * r) & (d2 < 6.25 * r * r) & F.col("orad").between(0.4 * r, 1.6 * r)
    # The larger circle of a conflict meets the smaller one, which doesn't reach as far; the conflict counts for both.
    close = (F.col("orad") <= F.col("radius")) & (d2 < F.greatest(r, F.lit(1.0)) * F.greatest(r, F.lit(1.0)))
    zero = F.lit(0).cast("bigint")
    mine = F.struct(
        "cx", "cy", "radius", F.when(close, F.col("ocopies")).otherwise(zero).alias("n_conflicts"),
        F.when(in_ring, F.col("ocopies")).otherwise(zero).alias("n_neighbours"),
    )
    theirs = F.struct(
        F.col("ox").alias("cx"), F.col("oy").alias("cy"), F.col("orad").alias("radius"), F.col("copies").alias("n_conflicts"),
        zero.alias("n_neighbours"),
    )
    sides = F.array_compact(F.array(mine, F.when(close & (F.col("orad") < F.col("radius")), theirs)))
    counts = met.filter(differs & (in_ring | close)).select("frame_id", F.inline(sides)).withColumn("copies", zero)
    every = own.select(*CIRCLE, "copies", zero.alias("n_conflicts"), zero.alias("n_neighbours")).unionByName(counts)
    return every.groupBy(*CIRCLE).agg(*[F.sum(c).alias(c) for c in ("copies", "n_conflicts", "n_neighbours")])


def boosted_score(score: Column, white: Column, neighbours: Column) -> Column:
    one = F.lit(1.0)
    return clip(0.6 * score + 0.2 * F.least(one, white * 8.0) + 0.2 * F.least(one, neighbours / 4.0), 0.0, 1.0)


def _settle_blocks(rows: DataFrame, order: list[str]) -> DataFrame:
    """What one look at every block decides: its own rows that are kept, and those that wait for another block.

    ``rows`` are a block's undecided rows (``own``) and the rows of other blocks that reach into it, kept or undecided.
    Going through them in order, a row that a kept one covers is dropped, a row that conflicts with an undecided better one
    waits, any other is kept. A task holds the kept and waiting rows of one block.
    """
    block = ["frame_id", "_bx", "_by"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, kept, waiting = None, {}, {}
        for batch in batches:
            found, flags = [], []
            columns = [batch.column(c).to_pylist() for c in (*block, "cx", "cy", "radius", "_wide", "own", "kept")]
            for i, (frame, bx, by, x, y, r, wide, own, is_kept) in enumerate(zip(*columns)):
                if (frame, bx, by) != current:
                    current, kept, waiting = (frame, bx, by), {}, {}
                gx, gy = int(x // wide), int(y // wide)
                near = [(gx + dx, gy + dy) for dx in (-1, 0, 1) for dy in (-1, 0, 1)]

                def meets(grid):
                    return any((a - x) ** 2 + (b - y) ** 2 < max(c, r, 1) ** 2 for g in near for a, b, c in grid.get(g, ()))

                if own and meets(kept):
                    continue
                is_kept = is_kept or (own and not meets(waiting))
                (kept if is_kept else waiting).setdefault((gx, gy), []).append((x, y, r))
                if own:
                    found.append(i)
                    flags.append(is_kept)
            names = [n for n in batch.schema.names if n != "kept"]
            out = batch.select(names).take(pa.array(found, pa.int64()))
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(flags, pa.bool_())], [*names, "kept"])

    columns = [c for c in rows.columns if c != "kept"]
    placed = rows.select(*columns, "kept").repartition(*block).sortWithinPartitions(*block, *order)
    return placed.mapInArrow(run, placed.schema)


def _uncovered(starts: np.ndarray, x: np.ndarray, y: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Which circles greedy suppression keeps; ``starts`` are the first rows of the frames, whose rows are in order.

    A circle alone in its cell, as wide as its frame's largest radius, and the eight around it conflicts with nothing. Only
    the others are gone through one by one.
    """
    frame = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(x))))
    wide = np.maximum(np.maximum.reduceat(r, starts), 1.0)[frame]
    gx, gy = (np.floor(v / wide).astype(np.int64) for v in (x, y))
    key = gx.astype(np.uint64) + gy.astype(np.uint64) * _ROW + frame.astype(np.uint64) * _FRAME
    cells, at, counts = np.unique(key, return_inverse=True, return_counts=True)
    met = counts > 1
    for step in (np.uint64(1), _ROW, _ROW + np.uint64(1), _ROW - np.uint64(1)):
        there = np.searchsorted(cells, cells + step) % len(cells)
        near = cells[there] == cells + step
        met[near] = met[there[near]] = True
    kept = ~met[at]
    rest, grid = np.flatnonzero(~kept), {}
    columns = [v[rest].tolist() for v in (frame, gx, gy, x, y, r)]
    for i, f, cx, cy, a, b, c in zip(rest.tolist(), *columns):
        near = [(f, cx + dx, cy + dy) for dx in (-1, 0, 1) for dy in (-1, 0, 1)]
        if not any((a - u) ** 2 + (b - v) ** 2 < max(c, w, 1) ** 2 for cell_ in near for u, v, w in grid.get(cell_, ())):
            kept[i] = True
            grid.setdefault((f, cx, cy), []).append((a, b, c))
    return kept


def _settle_frames(rows: DataFrame) -> DataFrame:
    """The rows that stay of whole frames; ``rows`` hold a frame's circles one after the other, best first, all with a place.

    A task holds the frames of one Arrow batch and the frame that goes on in the next one.
    """

    def settled(batch: pa.RecordBatch, starts: np.ndarray) -> pa.RecordBatch:
        numbers = (pc.cast(batch.column(c), pa.float64(), safe=False).to_numpy(zero_copy_only=False) for c in ("cx", "cy", "radius"))
        return batch.filter(pa.array(_uncovered(starts, *numbers)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            batch = batch if held is None else pa.concat_batches([held, batch])
            if not batch.num_rows:
                continue
            frames = batch.column("frame_id")
            changes = pc.not_equal(frames.slice(1), frames.slice(0, len(frames) - 1)).to_numpy(zero_copy_only=False)
            starts = np.append(0, np.flatnonzero(changes) + 1)
            last = int(starts[-1])
            held = batch.slice(last)
            if last:
                yield settled(batch.slice(0, last), starts[:-1])
        if held is not None and held.num_rows:
            yield settled(held, np.zeros(1, np.int64))

    return rows.mapInArrow(run, rows.schema)


def suppress_overlaps(circles: DataFrame, order: Sequence[str | Column], block: int = BLOCK) -> DataFrame:
    """Greedy non-maximum suppression per frame: best first, drop what lies within the larger radius.

    A frame of up to ``FRAME_ROWS`` circles is settled where its rows meet, in one shuffle; a more crowded one is cut to
    blocks of ``block`` times its largest radius (``_suppress_crowded``). The order is total within a frame, so the result
    is the sequential one. Circles without a place or radius conflict with nothing; copies of them are reduced to the first.
    ``circles`` are read more than once.
    """
    crowded = circles.groupBy("frame_id").agg(F.count("*").alias("_n")).filter(F.col("_n") > FRAME_ROWS).select("frame_id")
    crowded = stage(crowded, "crowded")
    has_place = (F.col(c).isNotNull() for c in ("frame_id", "cx", "cy", "radius"))
    whole_ = reduce(lambda a, b: a & b, has_place)
    placed, unplaced = circles.filter(whole_), keep_first(circles.filter(~whole_), CIRCLE, order)
    if crowded.isEmpty():
        parts = [placed]
    else:
        frames = broadcast_if_small(crowded)
        parts = [placed.join(frames, "frame_id", "left_anti"), _suppress_crowded(placed.join(frames, "frame_id", "left_semi"), order, block)]
    small = parts[0].repartition("frame_id").sortWithinPartitions("frame_id", *order, "cx", "cy", "radius")
    return reduce(DataFrame.unionByName, [_settle_frames(small), *parts[1:], unplaced]).select(*circles.columns)


def _suppress_crowded(circles: DataFrame, order: Sequence[str | Column], block: int) -> DataFrame:
    """Greedy suppression of circles that have a place, for frames with more of them than a task should hold.

    Exact copies of a geometry are reduced to their first row up front (the later ones can never survive). A frame is cut
    to blocks of ``block`` times its largest radius. In every round each block settles all rows whose better neighbours
    are known; only rows that are undecided or newly kept travel on, to the blocks they reach into, and settled blocks
    are not looked at again. The rounds of a frame are as many as the blocks that its longest chain of conflicts crosses.
    """
    columns = circles.columns
    names = [f"_o{i}" for i in range(len(order))]
    unique = keep_first(circles, CIRCLE, order)
    ranked = unique.withColumns({n: c if isinstance(c, Column) else F.col(c) for n, c in zip(names, order)})
    ranked = stage(ranked.withColumn("_id", F.monotonically_increasing_id()), "circles")
    numbers = [F.col(c).cast("double").alias(c) for c in ("cx", "cy", "radius")]
    narrow = ranked.select("frame_id", *numbers, *names, "_id")
    wide = narrow.groupBy("frame_id").agg(F.greatest(F.max("radius"), F.lit(1.0)).alias("_wide"))
    side = F.col("_wide") * block
    rows = narrow.join(wide, "frame_id").withColumns(
        {"_bx": F.floor(F.col("cx") / side), "_by": F.floor(F.col("cy") / side), "own": F.lit(True), "kept": F.lit(False)}
    )
    order_ = [*names, "_id"]
    kept, waiting = [], rows
    # Foreign rows reach into a block if a circle of the largest radius around them does.
    spans = [
        F.sequence(F.floor((F.col(c) - F.col("_wide")) / side), F.floor((F.col(c) + F.col("_wide")) / side)) for c in ("cx", "cy")
    ]
    moving = rows
    while True:
        seen = moving.withColumn("_tx", F.explode(spans[0])).withColumn("_ty", F.explode(spans[1]))
        seen = seen.filter((F.col("_tx") != F.col("_bx")) | (F.col("_ty") != F.col("_by")))
        seen = seen.withColumns({"_bx": F.col("_tx"), "_by": F.col("_ty"), "own": F.lit(False)}).drop("_tx", "_ty")
        if kept:
            # Nothing is left to decide in a block where no row waits.
            seen = seen.join(broadcast_if_small(waiting.select("frame_id", "_bx", "_by").distinct()), ["frame_id", "_bx", "_by"], "left_semi")
            seen = seen.select(*waiting.columns)
        settled = stage(_settle_blocks(waiting.unionByName(seen), order_), "settled")
        kept.append(settled.filter("kept").select("_id"))
        waiting, moving = settled.filter("NOT kept"), settled
        if waiting.isEmpty():
            break
    chosen = reduce(DataFrame.unionByName, kept)
    return ranked.join(chosen, "_id", "left_semi").select(*columns)


def ring_candidates(circles: DataFrame, rings: DataFrame, position: Sequence[str | Column], k: int = 3) -> DataFrame:
    """The ``k`` circles per ring with most axis support among those whose centre lies between 0.7 and 2.8 ring radii
    from the ring's: as candidates ``reticle_global_<rank>`` with a score that mixes their own and the support.

    ``circles`` has a ``support`` for the ring of its frame (``capsule_support``); a frame may have several rings.
    """
    ring = ["ring_x", "ring_y", "ring_radius"]
    keys = [c for c in ("ring_x", "ring_y") if c in circles.columns]
    joined = circles.join(rings.select("frame_id", *ring), ["frame_id", *keys])
    d2 = squared_distance(F.col("cx"), F.col("cy"), F.col("ring_x"), F.col("ring_y"))
    rr = F.col("ring_radius").cast("double")
    near = joined.filter((d2 > 0.49 * rr * rr) & (d2 < 7.84 * rr * rr))
    top = top_per_key(near, ["frame_id", *ring], [F.desc("support"), *position], k, rank="ring_rank")
    rank = F.col("ring_rank") - 1
    return top.withColumns(
        {
            "ring_rank": rank, "score": clip(0.7 * F.col("score") + 0.6 * F.col("support"), 0.0, 1.0),
            "candidate_source": F.concat(F.lit("reticle_global_"), rank.cast("string")),
        }
    )


def roi_fraction(pixels: DataFrame, rois: DataFrame) -> DataFrame:
    """Share of a frame's pixels inside its half-open region (one region per frame)."""
    inside = F.col("x").between(F.col("x0"), F.col("x1") - 1) & F.col("y").between(F.col("y0"), F.col("y1") - 1)
    joined = pixels.join(rois.select("frame_id", "x0", "y0", "x1", "y1"), "frame_id")
    return joined.groupBy("frame_id").agg(
        F.count("*").alias("pixels"), F.count_if(inside).alias("inside"),
    ).withColumn("fraction", F.col("inside") / F.col("pixels"))


def inside_roi(x: Column, y: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Closed containment of a centre."""
    return x.between(x0, x1) & y.between(y0, y1)


def smallest_containing(points: DataFrame, boxes: DataFrame, position: Sequence[str], size: int = CELL) -> DataFrame:
    """For each point the smallest box (area, then best score) that contains it.

    Boxes are cut to frames that have a point before they are copied to cells.
    """
    asked = boxes.join(points.select("frame_id").distinct(), "frame_id", "left_semi")
    spread = over_cells(asked, F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"), size)
    met = in_cells(points, "px", "py", size).join(spread, ["frame_id", "_gx", "_gy"]).drop("_gx", "_gy")
    hit = met.filter(inside_roi(F.col("px"), F.col("py"), *[F.col(c) for c in ("x0", "y0", "x1", "y1")]))
    score = F.coalesce("score", F.lit(-1.0))
    return top_per_key(hit, ["frame_id", "px", "py"], ["area", score.desc(), *position])


def pixels_in_boxes(pixels: DataFrame, boxes: DataFrame, box_id: Sequence[str], size: int = CELL) -> DataFrame:
    """Number of pixels inside each half-open box; boxes without any are kept with zero."""
    spread = over_cells(
        boxes.select(*box_id, "x0", "y0", "x1", "y1").filter((F.col("x1") > F.col("x0")) & (F.col("y1") > F.col("y0"))),
        F.col("x0"), F.col("y0"), F.col("x1") - 1, F.col("y1") - 1, size,
    )
    met = spread.join(in_cells(pixels.select("frame_id", "x", "y"), "x", "y", size), ["frame_id", "_gx", "_gy"])
    inside = F.col("x").between(F.col("x0"), F.col("x1") - 1) & F.col("y").between(F.col("y0"), F.col("y1") - 1)
    counts = met.filter(inside).groupBy(*box_id).agg(F.count("*").alias("mask_pixels"))
    return boxes.join(counts, list(box_id), "left").fillna(0, ["mask_pixels"])


def crop_kind(mask_pixels: Column, min_positive: int = 12) -> Column:
    """Positive, negative, or null for a crop with too few mask pixels to use."""
    return F.when(mask_pixels >= min_positive, "candidate_positive").when(mask_pixels == 0, "candidate_negative")


def tolerance_counts(pixels: DataFrame, k: int = 2, keys: Sequence[str] = ("frame_id",)) -> DataFrame:
    """True and false positives of the predicted skeleton and misses of the true one, within ``k`` pixels
    (Chebyshev). ``side`` is ``pred`` or ``gt``.

    A cell is as wide as the reach of a pixel, so a pixel is seen from at most four cells: the other side is copied
    to those, and every asking pixel meets one cell in a semi join.
    """
    k = max(1, k)
    side = 2 * k + 1
    keys = list(keys)
    pred = in_cells(pixels.filter("side = 'pred'").select(*keys, "x", "y"), "x", "y", side)
    gt = in_cells(pixels.filter("side = 'gt'").select(*keys, "x", "y"), "x", "y", side)

    def near(asking: DataFrame, other: DataFrame, name: str) -> DataFrame:
        ox, oy = F.col("ox"), F.col("oy")
        seen = over_cells(other.select(*keys, F.col("x").alias("ox"), F.col("y").alias("oy")), ox - k, oy - k, ox + k, oy + k, side)
        a, b = asking.alias("a"), seen.alias("b")
        met = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in (*keys, "_gx", "_gy")]
        close = (F.abs(F.col("a.x") - F.col("b.ox")) <= k) & (F.abs(F.col("a.y") - F.col("b.oy")) <= k)
        hits = a.join(b, [*met, close], "left_semi")
        return unsized(hits.groupBy(*keys).agg(F.count("*").alias(name)))

    totals = pixels.groupBy(*keys).agg(
        F.count_if(F.col("side") == "pred").alias("n_pred"), F.count_if(F.col("side") == "gt").alias("n_gt")
    )
    joined = totals.join(near(pred, gt, "tp"), keys, "left").join(near(gt, pred, "found"), keys, "left").fillna(0, ["tp", "found"])
    return joined.select(*keys, "tp", (F.col("n_pred") - F.col("tp")).alias("fp"), (F.col("n_gt") - F.col("found")).alias("fn"))


def near_radius(r: Column) -> Column:
    return r + F.greatest(F.lit(6.0), r * 0.45)


def mask_circle_distance(pixels: DataFrame, circles: DataFrame, size: int = CELL) -> DataFrame:
    """Smallest distance from each circle centre to the frame's mask.

    Mask cells stand for their pixels first: a cell whose nearest corner is farther than the farthest
    corner of another cell cannot hold the nearest pixel, so only a few cells meet their pixels.
    """
    px = in_cells(pixels.select("frame_id", "x", "y"), "x", "y", size)
    cells = px.groupBy("frame_id", "_gx", "_gy").agg(
        F.min("x").alias("bx0"), F.max("x").alias("bx1"), F.min("y").alias("by0"), F.max("y").alias("by1")
    )
    met = circles.select(*CIRCLE).join(cells, "frame_id")
    cx, cy = F.col("cx"), F.col("cy")
    zero = F.lit(0)
    dx = F.greatest(F.col("bx0") - cx, zero, cx - F.col("bx1"))
    dy = F.greatest(F.col("by0") - cy, zero, cy - F.col("by1"))
    fx = F.greatest(F.abs(cx - F.col("bx0")), F.abs(cx - F.col("bx1")))
    fy = F.greatest(F.abs(cy - F.col("by0")), F.abs(cy - F.col("by1")))
    bounds = met.select(*CIRCLE, "_gx", "_gy", (dx * dx + dy * dy).alias("_low"), (fx * fx + fy * fy).alias("_high"))
    limit = bounds.groupBy(*CIRCLE).agg(F.min("_high").alias("_limit"))
    useful = bounds.join(limit, CIRCLE).filter(F.col("_low") <= F.col("_limit")).select(*CIRCLE, "_gx", "_gy")
    pairs = useful.join(px, ["frame_id", "_gx", "_gy"])
    d2 = squared_distance(F.col("x"), F.col("y"), cx, cy)
    return pairs.groupBy(*CIRCLE).agg(F.sqrt(F.min(d2)).alias("min_distance"))


# Names under which rules and audits find the context of a frame's mask.
CONTEXT_FEATURES = (
    "pred_pixels", "mask_white_fraction", "table_roi_area_fraction", "mask_fraction_in_table_roi", "candidate_count",
    "min_candidate_center_distance", "min_candidate_boundary_distance", "min_abs_candidate_boundary_distance",
    "min_candidate_boundary_distance_norm", "mask_fraction_inside_any_candidate", "mask_fraction_near_any_candidate",
    "mask_fraction_on_candidate_boundary_band",
)


def context_features(
    pixels: DataFrame, circles: DataFrame, position: Sequence[str], no_candidate: float | None = None, winners: DataFrame | None = None
) -> DataFrame:
    """Where a frame's mask lies relative to its candidate circles, under the names of ``CONTEXT_FEATURES``.

    ``winners`` (frame_id, cx, cy, radius, candidate_source) adds the winner's own circle of each frame, which counts as a
    candidate and comes last among ties. A radius is at least 1. ``no_candidate`` is the distance reported for a frame
    without circles: infinity for the reject rules, null for the audit.
    """
    own = [c for c in position if c not in CIRCLE]
    every = circles.select(*CIRCLE, "candidate_source", *own, F.lit(0).alias("_own"))
    if winners is not None:
        every = every.unionByName(winners.select(*CIRCLE, "candidate_source", F.lit(1).alias("_own")), allowMissingColumns=True)
    every = every.withColumn("radius", F.greatest(F.col("radius"), F.lit(1)))
    order = ["_own", *position]
    named = keep_first(every, CIRCLE, order)
    distances = mask_circle_distance(pixels, named).join(named, CIRCLE)
    signed = F.col("min_distance") - F.col("radius")
    nearest = F.struct(F.abs(signed), *order)
    per_frame = distances.groupBy("frame_id").agg(
        F.min("min_distance").alias("center"),
        F.min(F.abs(signed)).alias("boundary"),
        F.min_by("candidate_source", nearest).alias("nearest_candidate_source"),
        F.min_by(signed, nearest).alias("min_candidate_boundary_distance"),
        F.min_by(signed / F.col("radius"), nearest).alias("min_candidate_boundary_distance_norm"),
    )
    r = F.col("radius").cast("double")
    pad = F.greatest(F.lit(4.0), r * 0.25)
    reach = F.ceil(F.greatest(near_radius(r), r + pad))
    met = around(named.select(*CIRCLE), reach).join(
        in_cells(pixels.select("frame_id", "x", "y"), "x", "y"), ["frame_id", "_gx", "_gy"]
    )
    d2 = squared_distance(F.col("x"), F.col("y"), F.col("cx"), F.col("cy")).cast("double")
    inner = F.greatest(F.lit(1.0), r - pad)
    flags = {
        "mask_fraction_near_any_candidate": d2 <= near_radius(r) * near_radius(r),
        "mask_fraction_inside_any_candidate": d2 <= r * r,
        "mask_fraction_on_candidate_boundary_band": (d2 >= inner * inner) & (d2 <= (r + pad) * (r + pad)),
    }
    per_pixel = met.filter(d2 <= reach * reach).groupBy("frame_id", "x", "y").agg(
        *[F.max(c.cast("int")).alias(n) for n, c in flags.items()]
    )
    shares = per_pixel.groupBy("frame_id").agg(*[F.sum(n).alias(n) for n in flags])
    counts = every.groupBy("frame_id").agg(F.count("*").alias("candidate_count"))
    base = pixels.groupBy("frame_id").agg(F.count("*").alias("pred_pixels"))
    joined = base.join(counts, "frame_id", "left").join(per_frame, "frame_id", "left").join(shares, "frame_id", "left")
    missing = F.lit(no_candidate).cast("double")
    return joined.select(
        "frame_id", "pred_pixels", F.coalesce("candidate_count", F.lit(0)).alias("candidate_count"),
        F.coalesce("center", missing).alias("min_candidate_center_distance"),
        F.coalesce("boundary", missing).alias("min_abs_candidate_boundary_distance"),
        "min_candidate_boundary_distance", "min_candidate_boundary_distance_norm", "nearest_candidate_source",
        *[(F.coalesce(n, F.lit(0)) / F.col("pred_pixels")).alias(n) for n in flags],
    )


def circle_pixel_stats(pixels: DataFrame, circles: DataFrame) -> DataFrame:
    """Brightness and foreground statistics of each circle from ``(frame_id,x,y,gray,saturation,foreground)``.

    Values are 0..255, so the exact medians keep at most 256 counts per circle.
    """
    r = F.col("radius").cast("double")
    met = around(distinct_circles(circles), F.ceil(r * 2.2)).join(in_cells(pixels, "x", "y"), ["frame_id", "_gx", "_gy"])
    d2 = squared_distance(F.col("x"), F.col("y"), F.col("cx"), F.col("cy")).cast("double")
    near = met.filter(d2 <= (r * 2.2) * (r * 2.2)).withColumn("_d2", d2)
    d2 = F.col("_d2")
    core_r = F.greatest(F.lit(3), whole(r * 0.45))
    disc, core = d2 <= r * r, d2 <= core_r * core_r
    halo = d2 > (r * 0.85) * (r * 0.85)
    ring_out, ring_in = r + 2, F.greatest(r - 2, F.lit(1.0))
    annulus = (d2 <= ring_out * ring_out) & (d2 >= ring_in * ring_in)
    bright = F.col("gray") > 150

    def share(hit, where):
        return F.coalesce(F.try_divide(F.count_if(hit & where), F.count_if(where)), F.lit(0.0))

    stats = near.groupBy(*CIRCLE).agg(
        share(F.col("foreground"), disc).alias("fill"),
        share(F.col("foreground"), core).alias("core_fill"),
        share(bright, halo).alias("attached_white"),
        share(bright, annulus).alias("ring_white"),
        F.coalesce(F.avg(F.when(core, F.col("gray"))) / 255.0, F.lit(1.0)).alias("core_value"),
        F.coalesce(F.stddev_pop(F.when(disc, F.col("gray"))) / 64.0, F.lit(0.0)).alias("contrast"),
        F.coalesce(F.percentile(F.when(core, F.col("saturation")), F.lit(0.5)), F.lit(0.0)).alias("core_saturation"),
    )
    sat, value = F.col("core_saturation"), F.col("core_value") * 255.0
    penalty = F.when((sat < 120) & (value > 150), 0.18).otherwise(0.0)
    score = (
        0.55 * F.col("core_fill") + 0.2 * F.col("fill") + 0.15 * clip(F.col("contrast"), 0.0, 1.0)
        + 0.10 * clip(sat / 255.0, 0.0, 1.0) - penalty
    )
    dark = (F.col("core_fill") < 0.25) | ((sat < 80) & (value < 145))
    return stats.withColumns(
        {
            "ball_score": F.when(dark, F.lit(0.0)).otherwise(clip(score, 0.0, 1.0)),
            "ring_score": F.col("ring_white") + 0.3 * (1.0 - F.col("core_value")),
        }
    )


def capsule_support(pixels: DataFrame, pairs: DataFrame) -> DataFrame:
    """White share of the band between a ring centre and a circle, plus 0.7 of the share in its core.

    ``pairs`` holds one ring and one circle per row; the band is cut into cells by its bounding box.
    """
    rx, ry, bx, by = (F.col(c).cast("double") for c in ("ring_x", "ring_y", "cx", "cy"))
    r = F.col("radius").cast("double")
    norm = F.hypot(bx - rx, by - ry)
    half = F.greatest(F.lit(2.5), r * 0.28)
    pad = F.ceil(r * 1.2 + half + 2)
    spread = over_cells(
        pairs, F.least(rx, bx) - pad, F.least(ry, by) - pad, F.greatest(rx, bx) + pad, F.greatest(ry, by) + pad
    )
    met = spread.join(in_cells(pixels.select("frame_id", "x", "y", "gray"), "x", "y"), ["frame_id", "_gx", "_gy"])
    ux, uy = F.try_divide(bx - rx, norm), F.try_divide(by - ry, norm)
    px, py = F.col("x") - rx, F.col("y") - ry
    along, across = px * ux + py * uy, F.abs(px * uy - py * ux)
    band = (across <= half) & (along >= 0) & (along <= norm + r * 1.2)
    core_r2 = F.greatest(F.lit(2), whole(r * 0.7))
    core = squared_distance(F.col("x"), F.col("y"), bx, by) <= core_r2 * core_r2
    white = F.col("gray") > 150

    def share(where):
        return F.coalesce(F.try_divide(F.count_if(white & where), F.count_if(where)), F.lit(0.0))

    keys = ["frame_id", "ring_x", "ring_y", "cx", "cy", "radius"]
    support = met.filter(norm >= 1.0).groupBy(*keys).agg((share(band) + 0.7 * share(core)).alias("support"))
    return pairs.join(support, keys, "left").fillna(0.0, ["support"])


def fallback_grid(frames: DataFrame, count: int = 6) -> DataFrame:
    """Even grid of low-score circles over a frame's region, for frames without any proposal."""
    per_row = max(2, count // 2)
    radius = F.greatest(F.lit(12), F.floor(F.least("height", "width") / 12))
    spots = [(row, column) for row in range(2) for column in range(per_row)][:count]
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")

    def spot(i, row, column):
        return F.struct(
            F.floor(F.col("x0") + w * F.lit(0.15 + 0.7 * column / (per_row - 1))).alias("cx"),
            F.floor(F.col("y0") + h * F.lit(0.2 + 0.6 * row)).alias("cy"),
            radius.alias("radius"), F.lit(0.05).alias("score"), F.lit(i).alias("pos"),
        )

    rows = frames.select("frame_id", F.inline(F.array(*[spot(i, *s) for i, s in enumerate(spots)])))
    return rows.withColumn("candidate_source", F.lit("grid"))


def assemble_candidates(
    frames: DataFrame, main: DataFrame, conditional: DataFrame, order: Sequence[str | Column],
    max_candidates: int = 10, block: int = BLOCK, rings: DataFrame | None = None, late: Sequence[DataFrame] = (), grid: int = 6,
) -> DataFrame:
    """Ranked crops per frame: proposals and ring candidates, extra proposals only where these are few, late sources
    always, a grid of ``grid`` circles where there are none of them, and one crop of the scene where nothing is left.

    Every input has ``frame_id, cx, cy, radius, score, candidate_source, pos``. Overlaps are suppressed, the
    best score wins, and a surviving geometry carries the source label that was inserted last.
    """
    few = max(4, max_candidates // 2)
    columns = ["frame_id", "cx", "cy", "radius", "score", "candidate_source", "pos"]
    first = main.select(*columns, F.lit(0).alias("_step"))
    if rings is not None:
        first = first.unionByName(rings.select(*columns, F.lit(1).alias("_step")))
    first = stage(first, "first")
    counts = first.groupBy("frame_id").agg(F.count("*").alias("_n"))
    short = frames.select("frame_id").join(counts, "frame_id", "left").filter(F.coalesce("_n", F.lit(0)) < few)
    extra = conditional.join(short.select("frame_id"), "frame_id", "left_semi")
    proposals = first.unionByName(extra.select(*columns, F.lit(2).alias("_step")))
    for i, rows in enumerate(late):
        proposals = proposals.unionByName(rows.select(*columns, F.lit(3 + i).alias("_step")))
    if grid:
        # A frame without first proposals takes all conditional ones, so keys alone tell which frames are bare.
        bare = frames
        for rows in (first, conditional, *late):
            bare = bare.join(unsized(rows.select("frame_id")), "frame_id", "left_anti")
        proposals = proposals.unionByName(fallback_grid(bare, grid).select(*columns, F.lit(3 + len(late)).alias("_step")))
    # A geometry's first row and its label in one window: the copies move once, and only one row of them goes on.
    copies = W.partitionBy(*CIRCLE).orderBy(*order)
    label = F.max_by("candidate_source", F.struct("_step", "pos"))
    label = label.over(copies.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    labelled = proposals.withColumns({"candidate_source": label, "_copy": F.row_number().over(copies)}).filter("_copy = 1")
    kept = suppress_overlaps(stage(labelled.drop("_copy"), "proposals"), order, block)
    best = top_per_key(kept, ["frame_id"], order, max_candidates, rank="_rn")
    best = best.filter("cx IS NOT NULL AND cy IS NOT NULL AND radius IS NOT NULL")
    rows = frames.join(unsized(best), "frame_id", "left")
    width, height = F.col("width"), F.col("height")

    def crop(name, source, cx, cy, radius, score, **how):
        box = square_crop_box(cx, cy, radius, width, height, **how)
        sides = [box[c].cast("bigint").alias(c) for c in ("x0", "y0", "x1", "y1")]
        fields = {"candidate_id": name, "candidate_source": source, "cx": cx, "cy": cy, "radius": radius, "score": score}
        return F.struct(*[c.alias(n) for n, c in fields.items()], *sides)

    name = F.format_string("crop_%02d", F.col("_rn") - 1)
    own = crop(name, F.col("candidate_source"), F.col("cx"), F.col("cy"), F.greatest(F.col("radius"), F.lit(8)), F.col("score"))
    scene = crop(
        F.lit("crop_00"), F.lit("scene_fallback"), F.floor(width / 2), F.floor(height / 2),
        F.greatest(F.lit(12), F.floor(F.least(width, height) / 10)), F.lit(0.0), scale=1.8, padding=0,
    )
    return rows.select("frame_id", F.when(F.col("_rn").isNotNull(), own).otherwise(scene).alias("_crop")).select("frame_id", "_crop.*")
