"""Queries for box, line and tile arithmetic."""

from pyspark.sql import functions as F

from framegate.functions import geometry as G
from framegate.plans.registry import query

KEYS = ["frame_id", "pos", "l_partkey", "l_suppkey"]


def _frame():
    return F.lit(640), F.lit(360)


def _boxes():
    r = F.col("radius")
    return G.box(F.col("cx") - 3 * r, F.col("cy") - 2 * r, F.col("cx") + 3 * r, F.col("cy") + 2 * r)


def _named(prefix, b):
    return [b[k].cast("bigint").alias(f"{prefix}_{k}") for k in ("x0", "y0", "x1", "y1")]


@query(
    "G1_clamp_expand_box",
    """WITH b AS (SELECT frame_id, pos, l_partkey, l_suppkey, cx - 3 * radius AS x0, cy - 2 * radius AS y0,
  cx + 3 * radius AS x1, cy + 2 * radius AS y1 FROM fx_candidates),
c AS (SELECT *, greatest(0, least(x0, 639)) AS nx0, greatest(0, least(y0, 359)) AS ny0 FROM b)
SELECT frame_id, pos, l_partkey, l_suppkey, greatest(0, x0) AS c_x0, greatest(0, y0) AS c_y0, least(640, x1) AS c_x1,
  least(360, y1) AS c_y1, nx0 AS n_x0, ny0 AS n_y0, greatest(nx0 + 1, least(x1, 640)) AS n_x1,
  greatest(ny0 + 1, least(y1, 360)) AS n_y1, greatest(0, x0 - 9) AS e_x0, greatest(0, y0 - 9) AS e_y0,
  least(640, x1 + 9) AS e_x1, least(360, y1 + 9) AS e_y1, x0 AS r_x0, y0 AS r_y0, x1 AS r_x1, y1 AS r_y1 FROM c""",
)
def _(t):
    b, (W, H) = _boxes(), _frame()
    return t.fx_candidates.select(
        *KEYS, *_named("c", G.clamp_box(b, W, H)), *_named("n", G.clamp_box_nonempty(b, W, H)),
        *_named("e", G.expand_box(b, 9, W, H)), *_named("r", G.expand_roi(b, 0, W, H)),
    )


@query(
    "G2_square_crop_box",
    """WITH b AS (SELECT *, CAST(round_even(CAST(radius * 4.25 AS DOUBLE) + 24, 0) AS BIGINT) AS half FROM fx_candidates)
SELECT frame_id, pos, l_partkey, l_suppkey, greatest(0, cx - half) AS s_x0, greatest(0, cy - half) AS s_y0,
  least(640, cx + half) AS s_x1, least(360, cy + half) AS s_y1 FROM b""",
)
def _(t):
    return t.fx_candidates.select(
        *KEYS, *_named("s", G.square_crop_box(F.col("cx"), F.col("cy"), F.col("radius"), *_frame()))
    )


@query(
    "G3_square_boxes",
    """WITH b AS (SELECT frame_id, pos, l_partkey, l_suppkey, cx, cy, radius, cx - 3 * radius AS x0, cy - 2 * radius AS y0,
  cx + 3 * radius AS x1, cy + 2 * radius AS y1 FROM fx_candidates),
s AS (SELECT *, CAST(round_even(CAST(greatest(x1 - x0 + 1, y1 - y0 + 1) AS DOUBLE) * CAST(1.35 AS DOUBLE), 0) AS BIGINT) / CAST(2 AS DOUBLE) AS half,
  (x0 + x1) / CAST(2 AS DOUBLE) AS mx, (y0 + y1) / CAST(2 AS DOUBLE) AS my, CAST(radius * 11 AS BIGINT) AS side,
  CAST(ceil(greatest(x1 - x0, y1 - y0, 96) * CAST(1.5 AS DOUBLE)) AS BIGINT) AS size FROM b),
l AS (SELECT *, CAST(round_even(cx - side / CAST(2 AS DOUBLE), 0) AS BIGINT) AS lx, CAST(round_even(cy - side / CAST(2 AS DOUBLE), 0) AS BIGINT) AS ly,
  CAST(round_even(mx - size / CAST(2 AS DOUBLE), 0) AS BIGINT) AS vx, CAST(round_even(my - size / CAST(2 AS DOUBLE), 0) AS BIGINT) AS vy FROM s)
SELECT frame_id, pos, l_partkey, l_suppkey,
  greatest(0, CAST(round_even(mx - half, 0) AS BIGINT)) AS q_x0, greatest(0, CAST(round_even(my - half, 0) AS BIGINT)) AS q_y0,
  least(640, CAST(round_even(mx + half, 0) AS BIGINT)) AS q_x1, least(360, CAST(round_even(my + half, 0) AS BIGINT)) AS q_y1,
  least(greatest(0, lx), 640 - side) AS c_x0, least(greatest(0, ly), 360 - side) AS c_y0,
  least(greatest(0, lx), 640 - side) + side AS c_x1, least(greatest(0, ly), 360 - side) + side AS c_y1,
  least(greatest(0, vx), 640 - size) AS v_x0, least(greatest(0, vy), 360 - size) AS v_y0,
  least(greatest(0, vx), 640 - size) + size AS v_x1, least(greatest(0, vy), 360 - size) + size AS v_y1,
  CAST(140 AS BIGINT) AS f_x0, CAST(0 AS BIGINT) AS f_y0, CAST(500 AS BIGINT) AS f_x1, CAST(360 AS BIGINT) AS f_y1 FROM l""",
)
def _(t):
    b, (W, H) = _boxes(), _frame()
    return t.fx_candidates.select(
        *KEYS,
        *_named("q", G.square_box_from_xyxy(b, 0.35, W, H)),
        *_named("c", G.square_box_from_center_side(F.col("cx"), F.col("cy"), F.col("radius") * 11, W, H)),
        *_named("v", G.expanded_square_box(b, W, H, 96, 1.5)),
        *_named("f", G.centred_full_square(W, H)),
    )


@query(
    "G4_remap_points",
    """SELECT frame_id, pos, l_partkey, l_suppkey, CAST(round_even(cx + (x * CAST(radius * 4 AS DOUBLE) / 96), 0) AS BIGINT) AS px,
  CAST(round_even(cy + (y * CAST(radius * 2 AS DOUBLE) / 64), 0) AS BIGINT) AS py
FROM fx_candidates, (SELECT UNNEST([{'x': 0, 'y': 0}, {'x': 48, 'y': 32}, {'x': 95, 'y': 63}], recursive := true))""",
)
def _(t):
    points = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((0, 0), (48, 32), (95, 63))])
    remapped = G.remap_points(
        points, F.col("cx"), F.col("cy"), F.col("radius") * 4, F.col("radius") * 2, F.lit(96), F.lit(64)
    )
    return t.fx_candidates.select(*KEYS, F.inline(remapped)).withColumnsRenamed({"x": "px", "y": "py"})


@query(
    "G5_box_iou",
    """WITH b AS (SELECT *, greatest(0, least(cx + radius, 330) - greatest(cx - radius, 250)) *
  greatest(0, least(cy + radius, 210) - greatest(cy - radius, 120)) AS inter, 4 * radius * radius AS area FROM fx_candidates)
SELECT frame_id, pos, l_partkey, l_suppkey, round(inter / CAST(area + 7200 - inter AS DOUBLE), 9) AS iou,
  CAST(NULL AS DOUBLE) AS empty_iou, round(sqrt((cx - 290) * (cx - 290) + (cy - 165) * (cy - 165)), 6) AS distance,
  abs(pred_pixels - 25) AS pixel_delta FROM b""",
)
def _(t):
    r = F.col("radius")
    a = G.box(F.col("cx") - r, F.col("cy") - r, F.col("cx") + r, F.col("cy") + r)
    fixed = G.box(F.lit(250), F.lit(120), F.lit(330), F.lit(210))
    empty = G.box(F.lit(5), F.lit(5), F.lit(5), F.lit(5))
    return t.fx_candidates.select(
        *KEYS, F.round(G.box_iou(a, fixed), 9).alias("iou"), G.box_iou(empty, empty).alias("empty_iou"),
        F.round(G.point_distance(F.col("cx"), F.col("cy"), F.lit(290), F.lit(165)), 6).alias("distance"),
        F.abs(F.col("pred_pixels") - 25).alias("pixel_delta"),
    )


@query(
    "G6_point_segment_distance",
    """WITH s AS (SELECT *, CAST(radius * 3 AS DOUBLE) AS dx, CAST(pos - 3 AS DOUBLE) AS dy FROM fx_candidates),
p AS (SELECT *, greatest(0, least(1, ((320 - cx) * dx + (180 - cy) * dy) / (dx * dx + dy * dy))) AS t FROM s)
SELECT frame_id, pos, l_partkey, l_suppkey, round(sqrt(pow(320 - (cx + t * dx), 2) + pow(180 - (cy + t * dy), 2)), 6) AS distance,
  round(sqrt(CAST((320 - cx) * (320 - cx) + (180 - cy) * (180 - cy) AS DOUBLE)), 6) AS point_distance FROM p""",
)
def _(t):
    cx, cy = F.col("cx"), F.col("cy")
    px, py = F.lit(320), F.lit(180)
    return t.fx_candidates.select(
        *KEYS,
        F.round(
            G.point_segment_distance(px, py, cx, cy, cx + F.col("radius") * 3, cy + F.col("pos") - 3), 6
        ).alias("distance"),
        F.round(G.point_segment_distance(px, py, cx, cy, cx, cy), 6).alias("point_distance"),
    )


@query(
    "G7_reticle_distance",
    """SELECT frame_id, pos, l_partkey, l_suppkey, CASE WHEN pos = 2 THEN NULL ELSE
  round(sqrt(CAST((cx - 320) * (cx - 320) + (cy - 180) * (cy - 180) AS DOUBLE)) / (radius * 2), 6) END AS distance FROM fx_candidates""",
)
def _(t):
    ring = F.when(F.col("pos") == 2, 0).otherwise(F.col("radius") * 2)
    return t.fx_candidates.select(
        *KEYS, F.round(G.reticle_distance(F.col("cx"), F.col("cy"), F.lit(320), F.lit(180), ring), 6).alias("distance")
    )


@query(
    "G8_line_to_borders",
    """WITH l AS (SELECT frame_id, pos, l_partkey, l_suppkey, CAST(pos - 4 AS DOUBLE) AS vx, CAST(radius % 5 - 2 AS DOUBLE) AS vy,
  CAST(cx AS DOUBLE) AS x0, CAST(cy % 360 AS DOUBLE) AS y0 FROM fx_candidates),
h AS (
  SELECT frame_id, pos, l_partkey, l_suppkey, i, CAST(xb AS BIGINT) AS x,
    CAST(round_even(greatest(0, least(359, y0 + vy * ((xb - x0) / vx))), 0) AS BIGINT) AS y
  FROM l, (VALUES (0, CAST(0 AS DOUBLE)), (1, CAST(639 AS DOUBLE))) AS v(i, xb)
  WHERE vx <> 0 AND y0 + vy * ((xb - x0) / vx) BETWEEN -2 AND 361
  UNION ALL
  SELECT frame_id, pos, l_partkey, l_suppkey, i, CAST(round_even(greatest(0, least(639, x0 + vx * ((yb - y0) / vy))), 0) AS BIGINT),
    CAST(yb AS BIGINT) FROM l, (VALUES (2, CAST(0 AS DOUBLE)), (3, CAST(359 AS DOUBLE))) AS v(i, yb)
  WHERE vy <> 0 AND x0 + vx * ((yb - y0) / vy) BETWEEN -2 AND 641),
p AS (SELECT a.frame_id, a.pos, a.l_partkey, a.l_suppkey, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2,
  (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) AS d2, a.i AS ai, b.i AS bi
  FROM h a JOIN h b USING (frame_id, pos, l_partkey, l_suppkey) WHERE a.i < b.i)
SELECT frame_id, pos, l_partkey, l_suppkey, x1, y1, x2, y2, d2 FROM p WHERE d2 > 0
QUALIFY row_number() OVER (PARTITION BY frame_id, pos, l_partkey, l_suppkey ORDER BY d2 DESC, ai, bi) = 1""",
)
def _(t):
    pair = G.line_to_borders(
        (F.col("pos") - 4).cast("double"), (F.col("radius") % 5 - 2).cast("double"),
        F.col("cx").cast("double"), (F.col("cy") % 360).cast("double"), *_frame(),
    )
    rows = t.fx_candidates.dropDuplicates(KEYS).select(*KEYS, pair.alias("pair")).filter("pair IS NOT NULL")
    return rows.select(*KEYS, *[F.col(f"pair.{c}").alias(c) for c in ("x1", "y1", "x2", "y2", "d2")])


@query(
    "G9_longest_oriented_segment",
    """WITH s AS (SELECT *, CAST(radius * 6 - pred_pixels AS DOUBLE) AS dx, CAST(pred_pixels - 20 AS DOUBLE) AS dy FROM fx_candidates),
a AS (SELECT *, sqrt(dx * dx + dy * dy) AS length, degrees(atan2(dy, dx)) AS angle FROM s),
d AS (SELECT *, angle - 15 + 180 AS raw FROM a),
f AS (SELECT *, raw - 360 * floor(raw / 360) - 180 AS diff FROM d)
SELECT frame_id, round(length, 6) AS length, round(diff, 6) AS diff,
  round(CASE WHEN abs(angle) <= 90 THEN abs(angle) ELSE 180 - abs(angle) END, 6) AS folded, cx, cy FROM f
WHERE length >= 30 AND length <= 300 AND abs(diff) < 20
QUALIFY row_number() OVER (PARTITION BY frame_id ORDER BY length DESC, pos, l_partkey, l_suppkey, score) = 1""",
)
def _(t):
    x1, y1 = F.col("cx"), F.col("cy")
    x2, y2 = x1 + F.col("radius") * 6 - F.col("pred_pixels"), y1 + F.col("pred_pixels") - 20
    rows = t.fx_candidates.select(
        "frame_id", "cx", "cy", "pos", "l_partkey", "l_suppkey", "score",
        G.point_distance(x1, y1, x2, y2).alias("length"),
        G.orientation_diff(G.angle_degrees(x1, y1, x2, y2), F.lit(15.0)).alias("diff"),
        G.folded_angle(x1, y1, x2, y2).alias("folded"),
    ).filter(F.col("length").between(30, 300) & (F.abs("diff") < 20))
    from framegate.operators.ranking import top_per_key

    best = top_per_key(rows, ["frame_id"], [F.desc("length"), "pos", "l_partkey", "l_suppkey", "score"])
    return best.select("frame_id", *[F.round(c, 6).alias(c) for c in ("length", "diff", "folded")], "cx", "cy")


@query(
    "G10_polyline_length",
    """SELECT frame_id, side, round(sum(sqrt(dx * dx + dy * dy)), 6) AS length, CAST(11 AS DOUBLE) AS fixed FROM (
  SELECT frame_id, side, coalesce(x - lag(x) OVER w, 0) AS dx, coalesce(y - lag(y) OVER w, 0) AS dy FROM fx_pixels
  WINDOW w AS (PARTITION BY frame_id, side ORDER BY x, y)) GROUP BY frame_id, side""",
)
def _(t):
    from framegate.operators.pixels import path_lengths

    rows = path_lengths(t.fx_pixels, ["frame_id", "side"], ["x", "y"])
    short = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((0, 0), (3, 4), (3, 10))])
    return rows.select("frame_id", "side", F.round("length", 6).alias("length"), G.polyline_length(short).alias("fixed"))


@query(
    "G11_tile_windows",
    """WITH f AS (SELECT p_partkey AS frame_id, 200 + p_size * 17 AS w, 150 + p_size * 11 AS h FROM part),
xs AS (SELECT DISTINCT frame_id, w, h, x FROM (SELECT frame_id, w, h, UNNEST(list_append(range(0, greatest(0, w - 256) + 1, 192), greatest(0, w - 256))) AS x FROM f)),
ys AS (SELECT DISTINCT frame_id, y FROM (SELECT frame_id, UNNEST(list_append(range(0, greatest(0, h - 256) + 1, 192), greatest(0, h - 256))) AS y FROM f))
SELECT frame_id, x, y, least(256, w - x) AS tile_w, least(256, h - y) AS tile_h FROM xs JOIN ys USING (frame_id)""",
)
def _(t):
    w, h = (200 + F.col("p_size") * 17).cast("bigint"), (150 + F.col("p_size") * 11).cast("bigint")
    tiles = t.part.select(F.col("p_partkey").alias("frame_id"), F.inline(G.tile_windows_fraction(w, h, 256, 0.25)))
    return tiles.select("frame_id", "x", "y", F.col("w").alias("tile_w"), F.col("h").alias("tile_h"))


@query(
    "G14_box_shape",
    """WITH a AS (SELECT frame_id, count(*) AS area, max(x) - min(x) + 1 AS bw, max(y) - min(y) + 1 AS bh,
  count(*) FILTER (WHERE x IN (0, 119) OR y IN (0, 79)) AS touched FROM fx_pixels WHERE side = 'gt' GROUP BY frame_id)
SELECT frame_id, round(greatest(bw / CAST(bh AS DOUBLE), bh / CAST(bw AS DOUBLE)), 6) AS aspect,
  round(area / CAST(bw * bh AS DOUBLE), 6) AS fill_ratio, round(touched / CAST(area AS DOUBLE), 6) AS border_touch_ratio FROM a""",
)
def _(t):
    from framegate.operators.pixels import mask_shape

    return mask_shape(t.fx_pixels.filter("side = 'gt'"), ["frame_id"], 120, 80).select(
        "frame_id", *[F.round(c, 6).alias(c) for c in ("aspect", "fill_ratio", "border_touch_ratio")]
    )
