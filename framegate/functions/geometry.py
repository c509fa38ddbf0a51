"""Box, point, line and tile arithmetic as Column expressions.

Half-open boxes end one past the last pixel, inclusive boxes end on it; every function says which it takes.
A box is a dict of four Columns ``x0, y0, x1, y1``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

Box = dict[str, Column]


def box(x0: Column, y0: Column, x1: Column, y1: Column) -> Box:
    return {"x0": x0, "y0": y0, "x1": x1, "y1": y1}


def box_struct(b: Box) -> Column:
    return F.struct(*[b[k].alias(k) for k in ("x0", "y0", "x1", "y1")])


def clip(value: Column, low, high) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def whole(value: Column) -> Column:
    """Round half to even, as a whole number."""
    return F.bround(value).cast("bigint")


def clamp_box(b: Box, width: Column, height: Column) -> Box:
    """Half-open box cut at the frame; may come out empty."""
    zero = F.lit(0)
    return box(
        F.greatest(zero, b["x0"]), F.greatest(zero, b["y0"]), F.least(width, b["x1"]), F.least(height, b["y1"])
    )


def clamp_box_nonempty(b: Box, width: Column, height: Column) -> Box:
    """Half-open box cut at the frame, at least one pixel wide and high."""
    x0 = F.greatest(F.lit(0), F.least(b["x0"], width - 1))
    y0 = F.greatest(F.lit(0), F.least(b["y0"], height - 1))
    return box(
        x0, y0, F.greatest(x0 + 1, F.least(b["x1"], width)), F.greatest(y0 + 1, F.least(b["y1"], height))
    )


def expand_box(b: Box, margin: int, width: Column, height: Column) -> Box:
    grown = box(*[whole(b[k] + (-margin if k in ("x0", "y0") else margin)) for k in ("x0", "y0", "x1", "y1")])
    return clamp_box(grown, width, height)


def expand_roi(b: Box, margin: int, width: Column, height: Column) -> Box:
    """As ``expand_box``, but a margin of zero or less leaves the region untouched."""
    return b if margin <= 0 else expand_box(b, margin, width, height)


def square_crop_box(
    cx: Column, cy: Column, radius: Column, width: Column, height: Column, scale: float = 4.25, padding: int = 24
) -> Box:
    half = whole(radius * F.lit(scale) + F.lit(padding))
    return clamp_box(box(cx - half, cy - half, cx + half, cy + half), width, height)


def square_box_from_xyxy(b: Box, padding_frac: float, width: Column, height: Column) -> Box:
    """Square around a box; adds one to each extent, as the training index does."""
    longest = F.greatest(b["x1"] - b["x0"] + 1, b["y1"] - b["y0"] + 1)
    half = whole(longest * F.lit(1.0 + padding_frac)) / F.lit(2.0)
    cx, cy = (b["x0"] + b["x1"]) / F.lit(2.0), (b["y0"] + b["y1"]) / F.lit(2.0)
    return clamp_box(
        box(whole(cx - half), whole(cy - half), whole(cx + half), whole(cy + half)), width, height
    )


def _shift_inside(low: Column, side: Column, limit: Column) -> tuple[Column, Column]:
    """Move ``[low, low+side)`` into ``[0, limit)``; a longer side is cut at both ends."""
    start = F.greatest(low, F.lit(0))
    start = F.when(start + side > limit, limit - side).otherwise(start)
    return F.greatest(F.lit(0), start), F.least(limit, start + side)


def square_box_from_center_side(cx: Column, cy: Column, side: Column, width: Column, height: Column) -> Box:
    side = F.greatest(F.lit(1), side.cast("bigint"))
    x0, x1 = _shift_inside(whole(cx - side / F.lit(2.0)), side, width)
    y0, y1 = _shift_inside(whole(cy - side / F.lit(2.0)), side, height)
    return box(x0, y0, x1, y1)


def expanded_square_box(b: Box, width: Column, height: Column, min_size: int, padding: float) -> Box:
    """Square view around a half-open box, at least ``min_size``, grown by a factor, moved inside the frame."""
    extent = F.greatest(F.lit(1), b["x1"] - b["x0"], b["y1"] - b["y0"], F.lit(min_size))
    size = F.ceil(extent * F.lit(float(padding)))
    cx, cy = (b["x0"] + b["x1"]) * F.lit(0.5), (b["y0"] + b["y1"]) * F.lit(0.5)
    x0, x1 = _shift_inside(whole(cx - size / F.lit(2.0)), size, width)
    y0, y1 = _shift_inside(whole(cy - size / F.lit(2.0)), size, height)
    return box(x0, y0, F.greatest(x0 + 1, x1), F.greatest(y0 + 1, y1))


def centred_full_square(width: Column, height: Column) -> Box:
    side = F.least(width, height)
    x0 = F.greatest(F.lit(0), F.floor((width - side) / 2))
    y0 = F.greatest(F.lit(0), F.floor((height - side) / 2))
    return box(x0, y0, x0 + side, y0 + side)


def remap_points(points: Column, x0: Column, y0: Column, crop_w, crop_h, resize_w, resize_h) -> Column:
    """Crop coordinates back to frame coordinates, for an array of ``struct<x,y>``."""
    sx = crop_w / F.greatest(resize_w, F.lit(1))
    sy = crop_h / F.greatest(resize_h, F.lit(1))
    return F.transform(
        points, lambda p: F.struct(whole(x0 + p.x * sx).alias("x"), whole(y0 + p.y * sy).alias("y"))
    )


def box_area(b: Box) -> Column:
    zero = F.lit(0.0)
    return F.greatest(zero, b["x1"] - b["x0"]) * F.greatest(zero, b["y1"] - b["y0"])


def box_iou(a: Box, b: Box) -> Column:
    """Null when the union is empty or a coordinate is missing."""
    zero = F.lit(0.0)
    inter = F.greatest(zero, F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"])) * F.greatest(
        zero, F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"])
    )
    union = box_area(a) + box_area(b) - inter
    known = a["x0"].isNotNull() & b["x0"].isNotNull()
    return F.when(known & (union > 0), inter / union)


def point_distance(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return F.hypot(ax - bx, ay - by)


def point_segment_distance(px, py, x0, y0, x1, y1) -> Column:
    dx, dy = (x1 - x0).cast("double"), (y1 - y0).cast("double")
    along = ((px - x0) * dx + (py - y0) * dy) / F.greatest(dx * dx + dy * dy, F.lit(1e-6))
    t = F.when((dx == 0) & (dy == 0), F.lit(0.0)).otherwise(clip(along, 0.0, 1.0))
    return F.hypot(px - (x0 + t * dx), py - (y0 + t * dy))


def reticle_distance(cx, cy, ring_x, ring_y, ring_radius) -> Column:
    """Distance to the ring centre in ring radii; null when the ring is unknown."""
    return F.when(
        ring_radius.isNotNull() & (ring_radius != 0) & ring_x.isNotNull(),
        point_distance(cx, cy, ring_x, ring_y) / F.greatest(ring_radius.cast("double"), F.lit(1.0)),
    )


def line_to_borders(vx, vy, x0, y0, width, height) -> Column:
    """Farthest pair among the up to four meetings of a line with the frame border, or null.

    The result is ``struct<d2, x1, y1, x2, y2>``; a tie keeps the pair found first in the order
    left, right, top, bottom.
    """
    eps = 1e-6
    right, bottom = width - F.lit(1.0), height - F.lit(1.0)

    def meet(usable, x, y, inside):
        return F.when(usable & inside, F.struct(whole(x).alias("x"), whole(y).alias("y")))

    def vertical(x):
        y = y0 + vy * F.try_divide(x - x0, vx)
        return meet(F.abs(vx) > eps, x, clip(y, F.lit(0.0), bottom), y.between(-2.0, height + 1.0))

    def horizontal(y):
        x = x0 + vx * F.try_divide(y - y0, vy)
        return meet(F.abs(vy) > eps, clip(x, F.lit(0.0), right), y, x.between(-2.0, width + 1.0))

    found = [vertical(F.lit(0.0)), vertical(right), horizontal(F.lit(0.0)), horizontal(bottom)]
    pair_type = "struct<d2:bigint,prefer:int,x1:bigint,y1:bigint,x2:bigint,y2:bigint>"

    def farthest(points):
        pairs = []
        for i in range(4):
            for j in range(i + 1, 4):
                a, b = points[i], points[j]
                d2 = (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)
                pair = F.struct(d2, F.lit(-len(pairs)), a.x, a.y, b.x, b.y).cast(pair_type)
                pairs.append(F.when(d2 > 0, pair))
        return F.array_max(F.array_compact(F.array(*pairs)))

    # A one-element transform binds the four points once instead of repeating them in every pair.
    return F.element_at(F.transform(F.array(F.array(*found)), farthest), 1)


def project_to_border(x0, y0, vx, vy, width, height) -> Column:
    """First meeting of a ray with the border as ``struct<t,x,y>``; the clamped start point if none."""
    eps = 1e-6
    right, bottom = width - F.lit(1.0), height - F.lit(1.0)
    hits = []
    for order, xb in enumerate((F.lit(0.0), right)):
        t = F.try_divide(xb - x0, vx)
        y = y0 + t * vy
        hits.append((F.abs(vx) > eps) & (t >= 0) & y.between(F.lit(0.0), bottom))
        hits[-1] = F.when(hits[-1], F.struct(t.alias("t"), F.lit(order).alias("order"), xb.alias("x"), y.alias("y")))
    for order, yb in enumerate((F.lit(0.0), bottom)):
        t = F.try_divide(yb - y0, vy)
        x = x0 + t * vx
        hit = (F.abs(vy) > eps) & (t >= 0) & x.between(F.lit(0.0), right)
        hits.append(F.when(hit, F.struct(t.alias("t"), F.lit(order + 2).alias("order"), x.alias("x"), yb.alias("y"))))
    first = F.array_min(F.array_compact(F.array(*hits)))
    x = clip(whole(F.coalesce(first.x, x0.cast("double"))), F.lit(0), right.cast("bigint"))
    y = clip(whole(F.coalesce(first.y, y0.cast("double"))), F.lit(0), bottom.cast("bigint"))
    return F.struct(x.alias("x"), y.alias("y"))


def angle_degrees(x1, y1, x2, y2) -> Column:
    return F.degrees(F.atan2((y2 - y1).cast("double"), (x2 - x1).cast("double")))


def orientation_diff(angle: Column, reference: Column) -> Column:
    """Signed difference folded to ``[-180, 180)``."""
    return F.pmod(angle - reference + F.lit(180.0), F.lit(360.0)) - F.lit(180.0)


def folded_angle(x1, y1, x2, y2) -> Column:
    """Unsigned segment angle, at most 90 degrees."""
    angle = F.abs(angle_degrees(x1, y1, x2, y2))
    return F.when(angle <= 90, angle).otherwise(F.lit(180.0) - angle)


def polyline_length(points: Column) -> Column:
    """Length of an ordered array of ``struct<x,y>``."""
    steps = F.zip_with(
        F.slice(points, 2, F.greatest(F.size(points) - 1, F.lit(0))),
        F.slice(points, 1, F.greatest(F.size(points) - 1, F.lit(0))),
        lambda b, a: F.hypot(b.x - a.x, b.y - a.y),
    )
    return F.aggregate(steps, F.lit(0.0), lambda total, d: total + d)


def _starts(extent: Column, tile: Column, stride: Column) -> Column:
    last = F.greatest(F.lit(0), extent - tile)
    return F.array_union(F.sequence(F.lit(0).cast("bigint"), last, stride), F.array(last))


def tile_windows(width: Column, height: Column, size: int, overlap: int) -> Column:
    """Array of ``struct<x,y,w,h>``: pixel overlap, at least 64 wide, last tile flush with the edge."""
    tile = max(64, size)
    stride = tile - max(0, min(overlap, tile - 8))
    return _tiles(width, height, F.lit(tile).cast("bigint"), F.lit(stride).cast("bigint"))


def tile_windows_fraction(width: Column, height: Column, size: int, overlap: float) -> Column:
    """As ``tile_windows`` with the overlap as a fraction; a size of zero gives the whole frame."""
    if size <= 0:
        zero = F.lit(0).cast("bigint")
        return F.array(F.struct(zero.alias("x"), zero.alias("y"), width.alias("w"), height.alias("h")))
    stride = max(32, min(round(size * (1.0 - overlap)), size))
    return _tiles(width, height, F.lit(size).cast("bigint"), F.lit(stride).cast("bigint"))


def _tiles(width, height, tile, stride) -> Column:
    def row(y):
        return F.transform(
            _starts(width, tile, stride),
            lambda x: F.struct(
                x.alias("x"), y.alias("y"), F.least(tile, width - x).alias("w"), F.least(tile, height - y).alias("h")
            ),
        )

    return F.flatten(F.transform(_starts(height, tile, stride), row))


def box_shape(area, min_x, min_y, max_x, max_y, border_pixels) -> dict[str, Column]:
    """Aspect, fill and border share of a mask from its aggregates (inclusive box)."""
    bw, bh = max_x - min_x + 1, max_y - min_y + 1
    aspect = F.greatest(bw / F.greatest(bh, F.lit(1.0)), bh / F.greatest(bw, F.lit(1.0)))
    filled = F.coalesce(area, F.lit(0)) > 0
    return {
        "aspect": F.when(filled, aspect),
        "fill_ratio": F.when(filled, area / F.greatest(F.lit(1), bw * bh)).otherwise(F.lit(1.0)),
        "border_touch_ratio": F.when(filled, border_pixels / area).otherwise(F.lit(1.0)),
    }


def sum_of(columns: Sequence[Column]) -> Column:
    total = columns[0]
    for column in columns[1:]:
        total = total + column
    return total
