"""Mask metrics over sparse pixel relations ``(frame_id, side, x, y)``.

A frame's distinct pixels are bounded by its image size, and every aggregate below combines map-side,
so a frame that holds many rows costs one partial row per map task.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from framegate.functions.geometry import box_shape, clip
from framegate.operators.order import exact_quantiles


def mask_shape(pixels: DataFrame, keys: Sequence[str], width: int, height: int) -> DataFrame:
    """Area, inclusive box, aspect, fill and border share of every mask."""
    edge = F.col("x").isin(0, width - 1) | F.col("y").isin(0, height - 1)
    stats = pixels.groupBy(*keys).agg(
        F.count("*").alias("area"), F.min("x").alias("min_x"), F.min("y").alias("min_y"),
        F.max("x").alias("max_x"), F.max("y").alias("max_y"), F.count_if(edge).alias("border_pixels"),
    )
    shape = box_shape(*[F.col(c) for c in ("area", "min_x", "min_y", "max_x", "max_y", "border_pixels")])
    return stats.withColumns(shape)


def path_lengths(points: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Length of every ordered point path; rows stream through a sorted window, nothing is collected."""
    along = W.partitionBy(*keys).orderBy(*order)
    step = F.hypot(F.col("x") - F.lag("x").over(along), F.col("y") - F.lag("y").over(along))
    return points.withColumn("_d", step).groupBy(*keys).agg(F.coalesce(F.sum("_d"), F.lit(0.0)).alias("length"))


def overlap_counts(pixels: DataFrame, frames: DataFrame | None = None) -> DataFrame:
    """Pixels of both sides per frame: ``gt_pixels, pred_pixels, inter_pixels``.

    Both sides meet in one aggregation per pixel, so no join is needed. ``frames`` adds the frames
    whose masks are both empty.
    """
    per_pixel = pixels.groupBy("frame_id", "x", "y").agg(
        F.max((F.col("side") == "gt").cast("int")).alias("g"),
        F.max((F.col("side") == "pred").cast("int")).alias("p"),
    )
    counts = per_pixel.groupBy("frame_id").agg(
        F.sum("g").alias("gt_pixels"), F.sum("p").alias("pred_pixels"),
        F.sum(F.col("g") * F.col("p")).alias("inter_pixels"),
    )
    if frames is None:
        return counts
    return frames.select("frame_id").distinct().join(counts, "frame_id", "left").fillna(0)


def iou(gt: Column, pred: Column, inter: Column, empty: float) -> Column:
    """``empty`` is the value for two empty masks: 1.0 at the gate, 0.0 in diagnosis."""
    union = gt + pred - inter
    return F.when(union == 0, F.lit(empty)).otherwise(inter / union)


def dice(gt: Column, pred: Column, inter: Column, smooth: float = 1.0) -> Column:
    return (2 * inter + F.lit(smooth)) / (gt + pred + F.lit(smooth))


def unit(value: Column) -> Column:
    return clip(value, 0.0, 1.0)


def principal_axis(var_x: Column, var_y: Column, cov: Column) -> dict[str, Column]:
    """Closed-form eigenvalues and direction of a 2x2 covariance."""
    mid = (var_x + var_y) / 2.0
    spread = F.sqrt((var_x - var_y) * (var_x - var_y) / 4.0 + cov * cov)
    angle = 0.5 * F.atan2(2.0 * cov, var_x - var_y)
    return {
        "major_var": F.greatest(mid + spread, F.lit(0.0)), "minor_var": F.greatest(mid - spread, F.lit(0.0)),
        "axis_x": F.cos(angle), "axis_y": F.sin(angle), "axis_angle": angle,
    }


def mask_geometry(pixels: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Area, box, centroid, principal axis (sample covariance) and major length of every mask, in one aggregation."""
    stats = pixels.groupBy(*keys).agg(
        F.count("*").alias("area"), F.min("x").alias("min_x"), F.min("y").alias("min_y"), F.max("x").alias("max_x"),
        F.max("y").alias("max_y"), F.avg("x").alias("cx"), F.avg("y").alias("cy"),
        *[F.coalesce(v, F.lit(0.0)).alias(n) for n, v in (
            ("var_x", F.var_samp("x")), ("var_y", F.var_samp("y")), ("cov", F.covar_samp("x", "y")))],
    )
    bw, bh = F.col("max_x") - F.col("min_x") + 1, F.col("max_y") - F.col("min_y") + 1
    axis = principal_axis(F.col("var_x"), F.col("var_y"), F.col("cov"))
    whole = stats.withColumns({"bbox_w": bw, "bbox_h": bh, **axis})
    single = F.greatest("bbox_w", "bbox_h").cast("double")
    floor = F.lit(1e-8)
    return whole.withColumns(
        {
            "major_len": F.when(F.col("area") <= 1, single).otherwise(F.sqrt("major_var") * 4.0),
            "elongation": (F.greatest("major_var", floor) + floor) / (F.greatest("minor_var", floor) + floor),
        }
    )


def fit_lines(pixels: DataFrame, keys: Sequence[str], min_points: int = 50) -> DataFrame:
    """Total least squares line ``(vx, vy, x0, y0)`` per mask; masks with fewer points are left out."""
    stats = pixels.groupBy(*keys).agg(
        F.count("*").alias("points"), F.avg("x").alias("x0"), F.avg("y").alias("y0"),
        F.var_pop("x").alias("_vx"), F.var_pop("y").alias("_vy"), F.covar_pop("x", "y").alias("_c"),
    )
    angle = 0.5 * F.atan2(2.0 * F.col("_c"), F.col("_vx") - F.col("_vy"))
    fitted = stats.filter(F.col("points") >= min_points).withColumns({"vx": F.cos(angle), "vy": F.sin(angle)})
    return fitted.drop("_vx", "_vy", "_c")


def segment_agreement(
    pixels: DataFrame, segments: DataFrame, keys: Sequence[str], corridor: float, margin: float, min_pixels: int = 8
) -> DataFrame:
    """Angle, span, corridor share and overshoot of every mask against its segment ``(ax,ay,bx,by)``.

    Null values when the mask has fewer than ``min_pixels`` pixels or the segment has no length.
    """
    joined = pixels.join(segments, list(keys))
    dx, dy = (F.col("bx") - F.col("ax")).cast("double"), (F.col("by") - F.col("ay")).cast("double")
    length = F.hypot(dx, dy)
    ux, uy = F.try_divide(dx, length), F.try_divide(dy, length)
    rx, ry = F.col("x") - F.col("ax"), F.col("y") - F.col("ay")
    along, across = rx * ux + ry * uy, F.abs(ry * ux - rx * uy)
    placed = joined.select(*keys, "x", "y", length.alias("length"), along.alias("t"), across.alias("n"), F.atan2(dy, dx).alias("theta"))
    margin = max(0.0, margin)
    inside = (F.col("n") <= max(1.0, corridor)) & F.col("t").between(F.lit(-margin), F.col("length") + margin)
    stats = placed.groupBy(*keys).agg(
        F.count("*").alias("pixels"), F.max("length").alias("length"), F.max("theta").alias("theta"),
        F.min("t").alias("t0"), F.max("t").alias("t1"), F.avg(inside.cast("double")).alias("corridor"),
        F.var_pop("x").alias("vx"), F.var_pop("y").alias("vy"), F.covar_pop("x", "y").alias("c"),
    )
    usable = (F.col("pixels") >= min_pixels) & (F.col("length") >= 1e-3)
    axis = 0.5 * F.atan2(2.0 * F.col("c"), F.col("vx") - F.col("vy"))
    turn = F.pmod(axis - F.col("theta") + F.lit(math.pi / 2), F.lit(math.pi)) - F.lit(math.pi / 2)
    over = F.greatest(F.lit(0.0), -F.col("t0")) + F.greatest(F.lit(0.0), F.col("t1") - F.col("length"))
    reach = F.greatest(F.lit(1e-3), F.col("length"))
    return stats.select(
        *keys, "pixels", F.when(usable, F.degrees(F.abs(turn))).alias("angle_deg"),
        F.when(usable, (F.col("t1") - F.col("t0")) / reach).alias("span_ratio"),
        F.when(usable, F.col("corridor")).alias("corridor_ratio"), F.when(usable, over / reach).alias("overshoot_ratio"),
    )


def _half_width(radius: Column, offset: Column) -> Column:
    """Half width of a disc's row at a distance from its centre row, null outside the disc."""
    return F.when(offset <= radius, F.floor(F.sqrt((radius * radius - offset * offset).cast("double"))))


def _rows_total(radius: Column, reach: int, half_width) -> Column:
    rows = F.transform(F.sequence(-(radius + reach), radius + reach), lambda y: half_width(F.abs(y)))
    sizes = F.transform(rows, lambda w: F.when(w >= 0, w * 2 + 1).otherwise(F.lit(0)).cast("bigint"))
    return F.aggregate(sizes, F.lit(0).cast("bigint"), lambda total, n: total + n)


def disc_pixels(radius: Column) -> Column:
    """Number of grid points in a closed disc of a whole radius."""
    return _rows_total(radius, 0, lambda y: _half_width(radius, y))


def boundary_pixels(radius: Column) -> Column:
    """Number of grid points in the disc's boundary band (see ``on_boundary``)."""
    zero = F.lit(0)

    def grown(y):
        return F.greatest(_half_width(radius, F.greatest(y - 2, zero)), _half_width(radius, F.greatest(y - 1, zero)) + 2)

    def shrunk(y):
        a, b = _half_width(radius, y + 2), _half_width(radius, y + 1) - 2
        return F.when(a.isNotNull() & b.isNotNull(), F.least(a, b))

    return _rows_total(radius, 2, grown) - _rows_total(radius, 0, shrunk)


def on_boundary(dx: Column, dy: Column, radius: Column) -> Column:
    """Is an offset in the band between the disc grown and shrunk by the 5x5 ellipse kernel?

    The kernel covers two pixels up and down, and a box of two by one; both moves have a closed form.
    """
    zero, r2 = F.lit(0), radius * radius
    left, up1, up2 = F.greatest(dx - 2, zero), F.greatest(dy - 1, zero), F.greatest(dy - 2, zero)
    grown = (dx * dx + up2 * up2 <= r2) | (left * left + up1 * up1 <= r2)
    kept = (dx * dx + (dy + 2) * (dy + 2) <= r2) & ((dx + 2) * (dx + 2) + (dy + 1) * (dy + 1) <= r2)
    return grown & ~kept


def candidate_mask_features(
    pixels: DataFrame, skeleton: DataFrame, balls: DataFrame, width: int, height: int, min_length: int = 18
) -> DataFrame:
    """Shape and attachment features of every candidate mask.

    ``skeleton`` has one row per frame with ``skeleton_length, branch_count, component_count``; ``balls`` has
    the centre and radius. The ball is a disc, so touch, fill and reach are distances and need no ball pixels.
    """
    axis = mask_geometry(pixels, ["frame_id"]).select("frame_id", "major_var", "minor_var")
    r = F.col("radius")
    dx, dy = F.abs(F.col("x") - F.col("bx")), F.abs(F.col("y") - F.col("by"))
    d2 = dx * dx + dy * dy
    gx, gy = F.greatest(dx - 2, F.lit(0)), F.greatest(dy - 2, F.lit(0))
    core = F.greatest(F.lit(2), F.bround(r * 0.35).cast("bigint"))
    met = pixels.join(balls.select("frame_id", F.col("cx").alias("bx"), F.col("cy").alias("by"), "radius"), "frame_id")
    touch = met.groupBy("frame_id").agg(
        F.count("*").alias("area"), F.max("radius").alias("radius"),
        F.count_if(d2 <= r * r).alias("in_ball"), F.count_if(on_boundary(dx, dy, r)).alias("in_boundary"),
        F.count_if(d2 <= core * core).alias("in_core"), F.max((gx * gx + gy * gy <= r * r).cast("double")).alias("connected"),
        F.sqrt(F.max(d2)).alias("reach"),
    )
    joined = touch.join(axis, "frame_id").join(skeleton, "frame_id", "left").fillna(
        0, ["skeleton_length", "branch_count", "component_count"]
    )
    area, length = F.col("area").cast("double"), F.col("skeleton_length").cast("double")
    one = F.lit(1.0)
    avg_width = area / F.greatest(length, one)
    ratio = length / F.greatest(F.col("average_width"), F.lit(1e-6))
    tiny = F.lit(1e-6)
    axis_ratio = F.greatest("major_var", tiny) / F.greatest("minor_var", tiny)
    axis_ratio = F.when(area < 3, F.lit(0.0)).otherwise(axis_ratio)
    extra = F.col("branch_count") * 6.0 + F.greatest(F.col("component_count") - 1.0, F.lit(0.0)) * 10.0
    ring = boundary_pixels(r)
    core_r = F.greatest(F.lit(2).cast("bigint"), F.bround(r * 0.35).cast("bigint"))
    sized = joined.withColumn("average_width", avg_width).withColumn("length_to_width_ratio", ratio)
    return sized.select(
        "frame_id", "area", "skeleton_length", "average_width", "length_to_width_ratio",
        unit((6.0 - F.col("average_width")) / 6.0).alias("thinness"),
        unit(F.greatest(F.col("length_to_width_ratio") / 25.0, axis_ratio / 20.0)).alias("line_likeness"),
        unit(length / F.greatest(length + extra, one)).alias("continuity"),
        (F.col("in_boundary") / F.greatest(F.lit(1), ring)).alias("ball_boundary_touch"),
        (F.col("in_core") / F.greatest(F.lit(1), disc_pixels(core_r))).alias("ball_core_overlap"),
        (F.col("in_ball") / F.greatest(area, one)).alias("ball_fill_fraction"),
        F.col("connected").alias("connected_to_ball"),
        unit((F.col("reach") - F.col("radius")) / float(max(width, height, 1))).alias("outward_extension"),
        unit(1.0 - length / float(max(min_length, 1))).alias("shortness_penalty"),
        unit(F.col("average_width") / 10.0).alias("blob_penalty"),
    )


def merge_tiles(tile_pixels: DataFrame) -> DataFrame:
    """Overlap average of tile predictions ``(frame_id, variant, tile_x, tile_y, x, y, p)``, then the mean over variants."""
    placed = tile_pixels.select(
        "frame_id", "variant", (F.col("tile_x") + F.col("x")).alias("x"), (F.col("tile_y") + F.col("y")).alias("y"), "p"
    )
    merged = placed.groupBy("frame_id", "variant", "x", "y").agg(F.avg("p").alias("p"))
    return merged.groupBy("frame_id", "x", "y").agg(F.avg("p").alias("p"))


def loss_table(pixels: DataFrame) -> DataFrame:
    """Cross entropy (clipped at 1e-5), soft Dice loss and their sum per frame from ``(frame_id, p, g)``."""
    p, g = clip(F.col("p"), 1e-5, 1.0 - 1e-5), F.col("g").cast("double")
    bce = -(g * F.ln(p) + (1.0 - g) * F.ln(1.0 - p))
    per = pixels.groupBy("frame_id").agg(
        F.avg(bce).alias("bce"), F.sum(F.col("p") * g).alias("_i"), F.sum(F.col("p") + g).alias("_d")
    )
    dice_loss = 1.0 - (2.0 * F.col("_i") + 1e-6) / (F.col("_d") + 1e-6)
    return per.select("frame_id", "bce", dice_loss.alias("dice_loss"), (F.col("bce") + dice_loss).alias("loss"))


def threshold_counts(pixels: DataFrame, frames: DataFrame, thresholds: Sequence[float]) -> DataFrame:
    """Pixel confusion and false-positive frames for every threshold.

    ``pixels`` has ``(frame_id, x, y, p, g)``, ``frames`` has ``(frame_id, is_negative)``. Each pixel is counted once
    by the number of thresholds it reaches; the sums per threshold come from those few counts.
    """
    ordered = sorted(thresholds)
    reached = F.size(F.filter(F.array(*[F.lit(float(t)) for t in ordered]), lambda t: t <= F.col("p")))
    steps = pixels.select("frame_id", "g", F.coalesce(reached, F.lit(0)).alias("step"))
    pixel_sums = steps.groupBy("step").agg(F.count_if("g").alias("n_gt"), F.count_if(~F.col("g")).alias("n_bg"))
    top = steps.groupBy("frame_id").agg(F.max("step").alias("step"))
    negatives = frames.filter("is_negative").join(top, "frame_id", "left")
    frame_sums = negatives.groupBy(F.coalesce("step", F.lit(0)).alias("step")).agg(F.count("*").alias("n_frames"))
    numbered = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(t)).alias("threshold")) for i, t in enumerate(ordered, 1)])
    both = pixel_sums.join(frame_sums, "step", "full_outer").fillna(0).withColumn("e", F.explode(numbered))
    on = F.col("step") >= F.col("e.i")

    def total(column, where):
        return F.sum(F.when(where, F.col(column)).otherwise(F.lit(0)))

    return both.groupBy(F.col("e.threshold").alias("threshold")).agg(
        total("n_gt", on).alias("tp"), total("n_bg", on).alias("fp"), total("n_gt", ~on).alias("fn"),
        F.sum("n_frames").alias("neg_frames"), total("n_frames", on).alias("neg_fp_frames"),
    )


def tolerance_threshold_counts(pixels: DataFrame, tolerance: int, thresholds: Sequence[float]) -> DataFrame:
    """``threshold, tp, fp, fn`` of lines that may be ``tolerance`` pixels apart, for pixels ``(frame_id, x, y, p, g)``.

    A predicted pixel hits if a true one is near, whatever the threshold; a true pixel is found at a threshold if the
    largest probability near it reaches it. Both are maxima over a square, taken along x and then along y, so pixels meet
    neither thresholds nor pairs; the sums per threshold come from a handful of counts.
    """
    ordered = sorted(thresholds)
    reached = F.size(F.filter(F.array(*[F.lit(float(t)) for t in ordered]), lambda t: t <= F.col("p")))
    rows = pixels.select(
        "frame_id", "x", "y", F.coalesce(reached, F.lit(0)).alias("step"), F.coalesce("g", F.lit(False)).alias("g")
    ).withColumns({"own_step": F.col("step"), "own_g": F.col("g")})
    for axis in ("x", "y"):
        spread = rows.withColumn("d", F.explode(F.sequence(F.lit(-tolerance), F.lit(tolerance))))
        here = F.col("d") == 0
        spread = spread.withColumns(
            {axis: F.col(axis) + F.col("d"), "own_step": F.when(here, F.col("own_step")), "own_g": F.when(here, F.col("own_g"))}
        )
        rows = spread.groupBy("frame_id", "x", "y").agg(*[F.max(c).alias(c) for c in ("step", "g", "own_step", "own_g")])
    counts = rows.filter("own_step IS NOT NULL").groupBy("own_step", "own_g", "step", "g").agg(F.count("*").alias("n"))
    numbered = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(t)).alias("threshold")) for i, t in enumerate(ordered, 1)])
    on = F.col("own_step") >= F.col("e.i")

    def total(where):
        return F.sum(F.when(where, F.col("n")).otherwise(F.lit(0)))

    return counts.withColumn("e", F.explode(numbered)).groupBy(F.col("e.threshold").alias("threshold")).agg(
        total(on & F.col("g")).alias("tp"), total(on & ~F.col("g")).alias("fp"),
        total(F.col("own_g") & (F.col("step") < F.col("e.i"))).alias("fn"),
    )


def frame_difference(pixels: DataFrame, key: str) -> DataFrame:
    """Mean absolute gray difference to the previous frame, over the pixels both frames have, in 0..1."""
    now = pixels.select(key, "frame_index", "x", "y", F.col("gray").alias("_a"))
    before = pixels.select(key, (F.col("frame_index") + 1).alias("frame_index"), "x", "y", F.col("gray").alias("_b"))
    met = now.join(before, [key, "frame_index", "x", "y"])
    return met.groupBy(key, "frame_index").agg((F.avg(F.abs(F.col("_a") - F.col("_b"))) / 255.0).alias("diff_score"))


def adaptive_selection(pixels: DataFrame, min_area: int) -> DataFrame:
    """White pixels per frame under thresholds taken from the frame's own quantiles.

    ``pixels`` has ``(frame_id, x, y, v, s, c)`` with values 0..255, so the exact quantiles keep at most 256
    counts each. Adds ``selected`` (strict, or the looser fallback when too few pass) and ``relaxed``.
    """
    def q(column, *ps):
        return F.percentile(column, F.array(*[F.lit(p) for p in ps]))

    stats = pixels.groupBy("frame_id").agg(
        F.count("*").alias("_n"), q("v", 0.58, 0.70).alias("_v"), q("s", 0.45, 0.62).alias("_s"), q("c", 0.65, 0.80).alias("_c")
    )
    v, s, c = F.col("v"), F.col("s"), F.col("c")
    bounds = {
        "_v0": F.greatest(F.lit(145.0), F.col("_v")[0]), "_s0": clip(F.col("_s")[0], 10.0, 125.0),
        "_c0": clip(F.col("_c")[0], 10.0, 70.0), "_v1": F.greatest(F.lit(138.0), F.col("_v")[1]),
        "_s1": F.least(F.lit(145.0), F.col("_s")[1] + 18.0), "_c1": F.least(F.lit(90.0), F.col("_c")[1] + 18.0),
    }
    marked = pixels.join(stats.withColumns(bounds).drop("_v", "_s", "_c"), "frame_id").withColumns(
        {
            "_strict": (v >= F.col("_v0")) & (s <= F.col("_s0")) & (c <= F.col("_c0")),
            "_loose": (v >= F.col("_v1")) & (s <= F.col("_s1")) & (c <= F.col("_c1")),
            "relaxed": (v >= F.greatest(F.lit(90.0), F.col("_v0") - 40.0))
            & (s <= F.least(F.lit(255.0), F.col("_s0") + 50.0)) & (c <= F.least(F.lit(140.0), F.col("_c0") + 38.0)),
        }
    )
    few = marked.groupBy("frame_id").agg(F.count_if("_strict").alias("_k"), F.max("_n").alias("_n"))
    least = F.greatest(F.lit(min_area), F.bround(F.col("_n") * 0.003).cast("bigint"))
    choice = few.select("frame_id", (F.col("_k") < least).alias("used_fallback"))
    picked = marked.join(choice, "frame_id")
    selected = F.when(F.col("used_fallback"), F.col("_loose")).otherwise(F.col("_strict"))
    return picked.select("frame_id", "x", "y", selected.alias("selected"), "relaxed", "used_fallback")


def dominant_colour_mask(pixels: DataFrame, sizes: DataFrame) -> DataFrame:
    """Pixels near a frame's dominant colour: median colour of the central 44 % box, cut at the 80th percentile
    of its own distances. ``pixels`` has ``(frame_id, x, y, a, b, c)``; adds ``distance, is_table, is_foreground``."""
    w, h = F.col("width"), F.col("height")

    def inside(value, extent):
        return value.between(F.bround(extent * 0.28), F.bround(extent * 0.72) - 1)

    placed = pixels.join(sizes, "frame_id").withColumn("_in", inside(F.col("x"), w) & inside(F.col("y"), h))
    middle = placed.filter("_in")
    medians = middle.groupBy("frame_id").agg(*[F.percentile(c, F.lit(0.5)).alias(f"_m{c}") for c in ("a", "b", "c")])
    square = sum(((F.col(c) - F.col(f"_m{c}")) * (F.col(c) - F.col(f"_m{c}")) for c in ("a", "b", "c")), F.lit(0.0))
    measured = placed.join(medians, "frame_id").withColumn("distance", F.sqrt(square))
    cut80 = exact_quantiles(measured.filter("_in"), ["frame_id"], "distance", {"_p80": 0.8})
    limit = F.greatest(F.lit(14.0), F.col("_p80") * 1.35 + 6.0)
    return measured.join(cut80, "frame_id").select(
        "frame_id", "x", "y", "distance", (F.col("distance") <= limit).alias("is_table"),
        (F.col("distance") > 18.0).alias("is_foreground"),
    )


def shell_ratio(mask: DataFrame, gray: DataFrame, dark_threshold: int, ring: int = 1, keys: Sequence[str] = ("frame_id",)) -> DataFrame:
    """Share of dark pixels in the ring around every mask; pixels outside ``gray`` do not count."""
    where = [*keys, "x", "y"]
    steps = F.array(*[F.lit(i) for i in range(-ring, ring + 1)])
    wide = mask.select(*where).withColumn("_dx", F.explode(steps)).withColumn("_dy", F.explode(steps))
    reach = wide.select(
        *keys, (F.col("x") + F.col("_dx")).alias("x"), (F.col("y") + F.col("_dy")).alias("y"),
        ((F.col("_dx") == 0) & (F.col("_dy") == 0)).alias("_own"),
    )
    ringed = reach.groupBy(*where).agg(F.bool_or("_own").alias("_own")).filter(~F.col("_own"))
    shares = ringed.join(gray, where).groupBy(*keys).agg(
        F.avg((F.col("gray") <= dark_threshold).cast("double")).alias("shell_ratio")
    )
    return mask.select(*keys).distinct().join(shares, list(keys), "left").fillna(0.0, ["shell_ratio"])
