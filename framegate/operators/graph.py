"""Graphs over pixel relations and match edges."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from framegate.operators.order import quantiles_together
from framegate.operators.pixels import mask_geometry
from framegate.operators.ranking import top_per_key
from framegate.runtime import bucketed, buckets, cut, stage, unstage

ROW_BITS = 31
STEPS = [(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if (dy, dx) != (0, 0)]


def contract(links: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Connected components of ``links(keys, a, b)``: one row ``(keys, node, root)`` per node that has a link.

    Every round, each node moves to the neighbour (or itself) whose hash of (round, node) is smallest, and the links
    are contracted. The hash order changes each round, so a constant share of the nodes goes away in expectation, also on
    paths and stars; components that are one node leave by themselves, and the links of the round before are deleted. All
    steps are aggregates and joins on narrow rows; nothing is gathered per component. ``root`` is one node of the
    component, the same for all its nodes.
    """
    keys = list(keys)
    moves: list[DataFrame] = []
    links = stage(links.select(*keys, "a", "b").where("a <> b").distinct(), "links")
    while not links.isEmpty():
        turn = F.lit(len(moves))
        both = links.union(links.select(*keys, "b", "a"))
        reach = both.union(both.select(*keys, "a", F.col("a").alias("b")).distinct())
        key = F.struct(F.xxhash64(turn, "b"), "b")
        move = reach.groupBy(*keys, F.col("a").alias("node")).agg(F.min(key).getField("b").alias("to"))
        move = stage(move, "moves")
        left = move.select(*keys, F.col("node").alias("a"), F.col("to").alias("x"))
        right = move.select(*keys, F.col("node").alias("b"), F.col("to").alias("y"))
        moved = links.join(left, [*keys, "a"]).join(right, [*keys, "b"]).where("x <> y")
        moves.append(move)
        before = links
        links = stage(moved.select(*keys, F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "links")
        unstage(before)
    if not moves:
        return links.select(*keys, F.col("a").alias("node"), F.col("b").alias("root"))
    found = moves[-1].select(*keys, "node", F.col("to").alias("root"))
    for move in reversed(moves[:-1]):
        nxt = found.select(*keys, F.col("node").alias("to"), "root")
        found = move.join(nxt, [*keys, "to"], "left").select(*keys, "node", F.coalesce("root", "to").alias("root"))
    return found


def connected_components(vertices: DataFrame, edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``(keys, id, label)`` with the smallest id of each component as its label; ``edges`` has ``(keys, a, b)``."""
    keys = list(keys)
    found = stage(contract(edges, keys), "roots")
    labels = found.groupBy(*keys, "root").agg(F.min("node").alias("label"))
    named = found.join(labels, [*keys, "root"]).select(*keys, F.col("node").alias("id"), "label")
    every = vertices.select(*keys, "id").distinct()
    return every.join(named, [*keys, "id"], "left").withColumn("label", F.coalesce("label", "id"))


def pixel_components(pixels: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Adds ``label`` to a pixel relation: 8-connected components, named by their first run in reading order.

    Pixels are merged into horizontal runs first (a row is at most as long as the image is wide), so the graph
    has one vertex per run. Coordinates are not negative.
    """
    keys = list(keys)
    in_row = W.partitionBy(*keys, "y").orderBy("x")
    starts = F.when(F.coalesce(F.col("x") - F.lag("x").over(in_row), F.lit(2)) > 1, F.col("x"))
    runs_of = pixels.select(*keys, "x", "y").distinct().withColumn("_s", starts)
    runs_of = runs_of.withColumn("x0", F.max("_s").over(in_row.rowsBetween(W.unboundedPreceding, 0))).drop("_s")
    run_id = F.shiftleft(F.col("y").cast("bigint"), ROW_BITS) + F.col("x0")
    runs_of = cut(runs_of.withColumn("id", run_id))
    runs = runs_of.groupBy(*keys, "y", "x0", "id").agg(F.max("x").alias("x1"))
    below = runs.select(*keys, (F.col("y") - 1).alias("y"), F.col("x0").alias("bx0"), F.col("x1").alias("bx1"), F.col("id").alias("b"))
    touching = (F.col("bx0") <= F.col("x1") + 1) & (F.col("bx1") >= F.col("x0") - 1)
    edges = runs.withColumnRenamed("id", "a").join(below, [*keys, "y"]).filter(touching).select(*keys, "a", "b")
    labels = connected_components(runs, edges, keys)
    return runs_of.join(labels, [*keys, "id"]).select(*keys, "x", "y", "label")


def components_together(pixels: DataFrame, keys: Sequence[str]) -> DataFrame:
    """As ``pixel_components``, for masks that one image bounds: a frame is labelled in one task, whole frames at a time, and
    rows that lie in buckets by the keys don't move. Unknown spots and keys have no label and no row, as there."""
    keys = list(keys)
    known = pixels.select(*keys, "x", "y").dropna().distinct()
    placed = known.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy("y", "x")))
    kinds = dict(pixels.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in [*keys, "x", "y"]) + ", label bigint"

    def first_runs(frame: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """For pixels of whole frames, numbered and sorted by frame, row and column, without repeats: the row of the first
        pixel of the first run, in reading order, of each one's component."""
        starts = np.r_[True, (np.diff(frame) != 0) | (np.diff(y) != 0) | (np.diff(x) != 1)]
        first = np.flatnonzero(starts)
        last = np.r_[first[1:], len(x)] - 1
        # Frame and row as one dense number, so that a spot is one sortable number whatever the size of the images.
        new_row = np.r_[True, (np.diff(frame) != 0) | (np.diff(y) != 0)]
        row = np.cumsum(new_row) - 1
        below = np.r_[(np.diff(frame[new_row]) == 0) & (np.diff(y[new_row]) == 1), False][row[first]]
        x = x - x.min()
        wide = int(x.max()) + 3
        left, right = row[first] * wide + x[first] + 1, row[first] * wide + x[last] + 1
        low = np.searchsorted(right, left + wide - 1)
        many = np.where(below, np.searchsorted(left, right + wide + 1, "right") - low, 0)
        a = np.repeat(np.arange(len(first)), many)
        b = np.repeat(low - np.cumsum(many) + many, many) + np.arange(many.sum())
        root = np.arange(len(first))
        while True:
            up, down = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
            apart = up != down
            if not apart.any():
                return first[root][np.cumsum(starts) - 1]
            a, b = a[apart], b[apart]
            np.minimum.at(root, down[apart], up[apart])
            while (root[root] != root).any():
                root = root[root]

    def labelled(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(parts)
        frame, x, y = (table[c].to_numpy().astype(np.int64) for c in ("_n", "x", "y"))
        at = first_runs(np.cumsum(frame == 1), x, y)
        label = pa.array((y[at] << ROW_BITS) + x[at], pa.int64())
        yield from table.drop_columns(["_n"]).append_column("label", label).to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            begins = np.flatnonzero(batch.column("_n").to_numpy() == 1)
            if len(begins):
                held.append(batch.slice(0, begins[-1]))
                if sum(b.num_rows for b in held):
                    yield from labelled(held)
                held = [batch.slice(begins[-1])]
            else:
                held.append(batch)
        if sum(b.num_rows for b in held):
            yield from labelled(held)

    return placed.mapInArrow(run, schema)


def label_position(label: Column) -> tuple[Column, Column]:
    """``(y, x)`` of the first pixel a component label stands for."""
    return F.shiftright(label, ROW_BITS), label.bitwiseAND((1 << ROW_BITS) - 1)


def pixel_degrees(pixels: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Number of 8-neighbours of every pixel: each pixel announces itself to its neighbours, no join needed."""
    offsets = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in [(0, 0), *STEPS]])
    told = pixels.select(*keys, "x", "y").distinct().withColumn("_o", F.explode(offsets)).select(
        *keys, (F.col("x") + F.col("_o.dx")).alias("x"), (F.col("y") + F.col("_o.dy")).alias("y"),
        ((F.col("_o.dx") == 0) & (F.col("_o.dy") == 0)).alias("_own"),
    )
    counted = told.groupBy(*keys, "x", "y").agg(F.bool_or("_own").alias("_own"), F.count_if(~F.col("_own")).alias("degree"))
    return counted.filter("_own").drop("_own")


def degree_class(degree: Column) -> Column:
    return F.when(degree == 1, "endpoint").when(degree >= 3, "branch").when(degree == 2, "path").otherwise("isolated")


def branch_counts(pixels: DataFrame, keys: Sequence[str]) -> DataFrame:
    return pixel_degrees(pixels, keys).groupBy(*keys).agg(
        F.count("*").alias("pixels"), F.count_if(F.col("degree") == 1).alias("endpoints"),
        F.count_if(F.col("degree") >= 3).alias("branches"),
    )


def seeds_near(pixels: DataFrame, points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Start pixel per frame: the branch pixel nearest to a point, else the nearest pixel."""
    near = pixel_degrees(pixels, keys).join(points, list(keys))
    d2 = (F.col("x") - F.col("px")) * (F.col("x") - F.col("px")) + (F.col("y") - F.col("py")) * (F.col("y") - F.col("py"))
    return top_per_key(near, keys, [(F.col("degree") < 3).cast("int"), d2, "y", "x"]).select(*keys, "x", "y")


def shortest_paths(pixels: DataFrame, seeds: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Hops from the seed and the path back to it for every reachable pixel.

    A skeleton is a thin set inside one image, and its breadth-first search needs as many steps as the path is
    long, so each frame is walked by one small helper. Frames are spread by Spark and arrive sorted in Arrow batches;
    only the pixels of one frame are kept between batches. ``path`` is the row of step numbers from the seed; the first
    found path wins, neighbours are tried by row, then column.
    """
    keys = list(keys)
    seen = pixels.select(*keys, "x", "y", F.lit(False).alias("_seed"))
    seen = seen.unionByName(seeds.select(*keys, "x", "y", F.lit(True).alias("_seed")), allowMissingColumns=True)
    # A seed that is not a pixel is no start.
    marked = seen.dropna().repartition(*keys).groupBy(*keys, "x", "y").agg(
        F.bool_or("_seed").alias("_seed"), F.bool_and("_seed").alias("_only")
    ).filter("NOT _only")
    types = dict(pixels.dtypes)
    schema = ", ".join(f"{k} {types[k]}" for k in keys) + ", x bigint, y bigint, hops int, path string"

    def walk(todo: set, starts: list) -> Iterator[tuple]:
        front = [(y, x, "") for y, x in starts]
        todo.difference_update(starts)
        hops = 0
        while front:
            ahead = []
            for y, x, path in front:
                yield x, y, hops, path
                for number, (dy, dx) in enumerate(STEPS):
                    spot = (y + dy, x + dx)
                    if spot in todo:
                        todo.remove(spot)
                        ahead.append((*spot, path + str(number)))
            front, hops = ahead, hops + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frame, todo, starts, found, kinds = None, set(), [], [], []

        def built() -> pa.RecordBatch:
            columns = zip(*found) if found else [[] for _ in range(len(keys) + 4)]
            all_kinds = [*kinds, pa.int64(), pa.int64(), pa.int32(), pa.string()]
            arrays = [pa.array(c, t) for c, t in zip(columns, all_kinds)]
            return pa.RecordBatch.from_arrays(arrays, [*keys, "x", "y", "hops", "path"])

        for batch in batches:
            kinds = [batch.column(k).type for k in keys]
            frames = list(zip(*[batch.column(k).to_pylist() for k in keys]))
            for at, x, y, seed in zip(frames, *[batch.column(c).to_pylist() for c in ("x", "y", "_seed")]):
                if at != frame:
                    found += [(*frame, *row) for row in walk(todo, starts)] if starts else []
                    frame, todo, starts = at, set(), []
                todo.add((y, x))
                if seed:
                    starts.append((y, x))
            yield built()
            found = []
        if starts:
            found = [(*frame, *row) for row in walk(todo, starts)]
            yield built()

    placed = marked.select(*keys, "x", "y", "_seed").sortWithinPartitions(*keys, "y", "x")
    return placed.mapInArrow(run, schema)


def path_points(path: Column, x: Column, y: Column) -> Column:
    """Array of ``struct<x,y>`` on a path, from its end back to the seed."""
    dxs = F.array(*[F.lit(dx).cast("bigint") for _, dx in STEPS])
    dys = F.array(*[F.lit(dy).cast("bigint") for dy, _ in STEPS])
    digits = F.reverse(F.filter(F.split(path, ""), lambda c: c != ""))
    start = F.array(F.struct(x.cast("bigint").alias("x"), y.cast("bigint").alias("y")))

    def step(points, digit):
        last, at = F.element_at(points, -1), digit.cast("int") + 1
        return F.array_append(
            points,
            F.struct((last["x"] - F.element_at(dxs, at)).alias("x"), (last["y"] - F.element_at(dys, at)).alias("y")),
        )

    return F.aggregate(digits, start, step)


def best_endpoints(pixels: DataFrame, balls: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The endpoint whose path from the seed overlaps the ball most, then comes closest, then is longest."""
    keys = list(keys)
    centre = balls.select(*keys, F.col("cx").alias("px"), F.col("cy").alias("py"), F.greatest(F.lit(4), F.col("radius")).alias("radius"))
    seeds = seeds_near(pixels, centre.drop("radius"), keys)
    ends = pixel_degrees(pixels, keys).filter("degree = 1").select(*keys, "x", "y")
    walked = shortest_paths(pixels, seeds, keys).join(ends, [*keys, "x", "y"]).join(centre, keys)
    points = walked.withColumn("_p", path_points(F.col("path"), F.col("x"), F.col("y")))
    gaps = F.transform("_p", lambda p: F.hypot(p["x"] - F.col("px"), p["y"] - F.col("py")))
    scored = points.withColumn("_d", gaps).withColumns(
        {
            "overlap": F.size(F.filter("_d", lambda d: d <= F.col("radius") * 0.9)), "min_distance": F.array_min("_d"),
            "length": F.size("_d"),
        }
    )
    return top_per_key(scored, keys, [F.desc("overlap"), "min_distance", F.desc("length"), "y", "x"]).select(
        *keys, "x", "y", "hops", "path", "overlap", "min_distance", "length"
    )


def grow_from_seeds(allowed: DataFrame, seeds: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Allowed pixels that are 8-connected to a seed inside the allowed set."""
    labelled = pixel_components(allowed, keys)
    hit = labelled.join(seeds.select(*keys, "x", "y").distinct(), [*keys, "x", "y"], "left_semi")
    return labelled.join(hit.select(*keys, "label").distinct(), [*keys, "label"], "left_semi").select(*keys, "x", "y")


def component_filter(
    pixels: DataFrame, keys: Sequence[str], min_area: int, balls: DataFrame | None = None, keep_best: bool = True,
    labelled: DataFrame | None = None,
) -> DataFrame:
    """Components of at least ``min_area``; optionally only the best one by area plus 10000 per pixel on the ball.

    The ball is a disc grown by two pixels. The first component in reading order wins a tie. ``labelled`` are the pixels
    with their ``label``, if they are at hand with the rows of a frame together.
    """
    keys, together = list(keys), labelled is not None
    if not together:
        labelled = pixel_components(pixels, keys)
    touch = F.lit(0)
    rows = labelled
    if balls is not None:
        rows = labelled.join(balls.select(*keys, "cx", "cy", "radius"), keys, "left")
        gx = F.greatest(F.abs(F.col("x") - F.col("cx")) - 2, F.lit(0))
        gy = F.greatest(F.abs(F.col("y") - F.col("cy")) - 2, F.lit(0))
        touch = F.coalesce((gx * gx + gy * gy <= F.col("radius") * F.col("radius")).cast("bigint"), F.lit(0))
    sizes = rows.groupBy(*keys, "label").agg(F.count("*").alias("area"), F.sum(touch).alias("touch"))
    kept = sizes.filter(F.col("area") >= min_area).withColumn("score", F.col("area") + 10_000 * F.col("touch"))
    if keep_best:
        kept = top_per_key(kept, keys, [F.desc("score"), "label"])
    if keep_best and together:
        # One component a frame: the frame alone is the key, so pixels in buckets by it stay there.
        kept = kept.withColumnRenamed("label", "_kept").hint("shuffle_hash")
        best = labelled.join(kept, keys).filter(F.coalesce(F.col("label") == F.col("_kept"), F.lit(False)))
        return best.select(*keys, "x", "y", "label", "area", "score")
    return labelled.join(kept, [*keys, "label"]).select(*keys, "x", "y", "label", "area", "score")


def prune_spurs(pixels: DataFrame, keys: Sequence[str], rounds: int = 3) -> DataFrame:
    """Trim one-pixel nubs off the principal axis, at most ``rounds`` times; a frame stops when a round would
    remove nothing or too much, and keeps its largest component after each round.

    One image bounds a skeleton, so pixels move to the bucket of their frame once and every step of every round works
    inside the buckets; what a round has written is deleted when the next pixels are, and a frame that stops is not copied.
    """
    keys = list(keys)
    spread = pixels.select(*keys, "x", "y").repartition(buckets(pixels.sparkSession), *keys)
    current = bucketed(spread.distinct(), *keys)
    done: list[DataFrame] = []
    for _ in range(rounds):
        axis = mask_geometry(current, keys).filter("area >= 3").select(*keys, "area", "cx", "cy", "axis_x", "axis_y")
        off = F.abs((F.col("y") - F.col("cy")) * F.col("axis_x") - (F.col("x") - F.col("cx")) * F.col("axis_y"))
        met = pixel_degrees(current, keys).join(axis.hint("shuffle_hash"), keys)
        placed = bucketed(met.select(*keys, "x", "y", "degree", "area", off.alias("_off")), *keys)
        band = bucketed(quantiles_together(placed, keys, "_off", {"_q": 0.82}), *keys)
        q, far = F.col("_q"), F.col("_off")
        spur = ((F.col("degree") <= 1) & (far > F.greatest(F.lit(0.75), q + 0.10))) | (
            (F.col("degree") <= 2) & (far > q + F.greatest(F.lit(0.45), 0.22 * F.greatest(F.lit(1.0), q)))
        )
        judged = placed.join(band.hint("shuffle_hash"), keys).select(*keys, "x", "y", "area", spur.alias("_spur"))
        removed = judged.groupBy(*keys).agg(F.count_if("_spur").alias("_r"), F.max("area").alias("_a"))
        limit = F.greatest(F.lit(3), F.bround(F.col("_a") * 0.08).cast("bigint"))
        trimmed = removed.filter((F.col("_r") > 0) & (F.col("_r") <= limit) & (F.col("_r") < F.col("_a"))).select(*keys)
        go_on = bucketed(trimmed, *keys)
        done.append(current.join(go_on.hint("shuffle_hash"), keys, "left_anti"))
        rest = judged.filter(~F.col("_spur")).join(go_on.hint("shuffle_hash"), keys, "left_semi").select(*keys, "x", "y")
        labelled = bucketed(components_together(rest, keys), *keys)
        unstage(placed, band)
        current = bucketed(component_filter(labelled, keys, 1, labelled=labelled).select(*keys, "x", "y"), *keys)
        unstage(labelled)
        if current.isEmpty():
            break
    else:
        done.append(current)
    result = done[0]
    for part in done[1:]:
        result = result.unionByName(part)
    return result


def suppress_masks(masks: DataFrame, ranks: DataFrame, min_iou: float, max_masks: int) -> DataFrame:
    """Greedy mask suppression: in rank order keep a mask unless it overlaps a kept one by ``min_iou``, at most
    ``max_masks`` per frame. ``masks`` has ``(frame_id, mask_id, x, y)``, ``ranks`` has ``(frame_id, mask_id, rank)``.

    Masks travel as tiles of 8x8 pixels, a word of bits each; a pixel counts once. The best mask left in a frame is always
    kept, so a round keeps it and meets its tiles with those of the others: a tile has one kept mask at most, so that join
    gives no more rows than there are tiles, however many masks lie over one. There are at most ``max_masks`` rounds.
    """
    spot = F.pmod(F.col("y"), F.lit(8)) * 8 + F.pmod(F.col("x"), F.lit(8))
    # A pixel is one bit of the word of its 8x8 tile, set in every map task before anything moves.
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), spot.cast("int"))
    tile = {"_tx": F.floor(F.col("x") / 8), "_ty": F.floor(F.col("y") / 8), "_bit": bit}
    words = masks.select("frame_id", "mask_id", "x", "y").withColumns(tile).groupBy("frame_id", "mask_id", "_tx", "_ty").agg(
        F.bit_or("_bit").alias("_bits"), F.count_if(F.col("_bit").isNull()).alias("_nowhere")
    )
    tiles = stage(words, "masks")
    area = F.coalesce(F.bit_count("_bits"), F.lit(0)) + F.col("_nowhere")
    sizes = tiles.groupBy("frame_id", "mask_id").agg(F.sum(area).alias("area"))
    left = stage(sizes.join(ranks, ["frame_id", "mask_id"]).select("frame_id", "mask_id", "rank", "area"), "left")
    kept: DataFrame | None = None
    for _ in range(max_masks):
        if left.isEmpty():
            break
        best = stage(top_per_key(left, ["frame_id"], ["rank"]), "best")
        kept = best if kept is None else kept.unionByName(best)
        spots = tiles.join(best, ["frame_id", "mask_id"]).select("frame_id", "_tx", "_ty", F.col("_bits").alias("_kept"), F.col("area").alias("_area"))
        others = tiles.join(left, ["frame_id", "mask_id"]).join(spots, ["frame_id", "_tx", "_ty"])
        both = F.bit_count(F.col("_bits").bitwiseAND(F.col("_kept")))
        shared = others.groupBy("frame_id", "mask_id", "area", "_area").agg(F.sum(both).alias("_i")).filter("_i > 0")
        gone = shared.filter(F.col("_i") / (F.col("area") + F.col("_area") - F.col("_i")) >= min_iou)
        out = gone.select("frame_id", "mask_id").union(best.select("frame_id", "mask_id"))
        before = left
        left = stage(left.join(out, ["frame_id", "mask_id"], "left_anti"), "left")
        unstage(before)
    unstage(tiles)
    return left.limit(0) if kept is None else kept
