"""Queries for grid joins, suppression, candidate assembly and pixel neighbourhoods."""

from pyspark.sql import functions as F

from framegate.operators import spatial as S
from framegate.plans.common import frame_winners
from framegate.plans.registry import query

# Fifty frames in a row folded into one, so that frames are crowded; more data make more of them.
CROWD_SQL = """(SELECT frame_id // 50 AS frame_id, cx, cy, radius, score, candidate_source, selector_pool,
  frame_id * 10 + pos AS pos, l_partkey, l_suppkey, row_number() OVER (PARTITION BY frame_id // 50 ORDER BY score DESC, frame_id * 10 + pos, l_partkey, l_suppkey) AS rn FROM fx_candidates)"""


def best_first():
    return [-F.col("score"), "pos", "l_partkey", "l_suppkey"]


def crowd(t):
    return t.fx_candidates.select(
        F.floor(F.col("frame_id") / 50).alias("frame_id"), "cx", "cy", "radius", "score", "candidate_source", "selector_pool",
        (F.col("frame_id") * 10 + F.col("pos")).alias("pos"), "l_partkey", "l_suppkey",
    )


@query(
    "J9_circle_neighbours",
    f"""WITH c AS (SELECT frame_id, cx, cy, radius, count(*) AS copies FROM {CROWD_SQL} GROUP BY ALL),
p AS (SELECT a.frame_id, a.cx, a.cy, a.radius, b.copies, (a.cx - b.cx) * (a.cx - b.cx) + (a.cy - b.cy) * (a.cy - b.cy) AS d2, b.radius AS orad,
  NOT (a.cx = b.cx AND a.cy = b.cy AND a.radius = b.radius) AS differs FROM c a JOIN c b ON a.frame_id = b.frame_id)
SELECT frame_id, cx, cy, radius, CAST(coalesce(sum(copies) FILTER (WHERE differs AND d2 < greatest(radius, orad) * greatest(radius, orad)), 0) AS BIGINT) AS n_conflicts,
  CAST(coalesce(sum(copies) FILTER (WHERE differs AND d2 > 0.25 * radius * radius AND d2 < 6.25 * radius * radius AND orad BETWEEN 0.4 * radius AND 1.6 * radius), 0) AS BIGINT) AS n_neighbours
FROM p GROUP BY frame_id, cx, cy, radius""",
)
def _(t):
    return S.circle_neighbours(crowd(t)).select("frame_id", "cx", "cy", "radius", "n_conflicts", "n_neighbours")


def _rois(t):
    return t.part.select(
        F.col("p_partkey").alias("frame_id"), (F.col("p_partkey") % 20 + 10).alias("x0"), (F.col("p_partkey") % 10).alias("y0"),
        (F.col("p_partkey") % 20 + 40).alias("x1"), (F.col("p_partkey") % 10 + 25).alias("y1"),
    )


@query(
    "J10_roi_fraction",
    """SELECT frame_id, count(*) AS pixels, count(*) FILTER (WHERE ins) AS inside, round(count(*) FILTER (WHERE ins) / CAST(count(*) AS DOUBLE), 9) AS fraction
FROM (SELECT frame_id, x >= frame_id % 20 + 10 AND x < frame_id % 20 + 40 AND y >= frame_id % 10 AND y < frame_id % 10 + 25 AS ins FROM fx_pixels WHERE side = 'pred')
GROUP BY frame_id""",
)
def _(t):
    rows = S.roi_fraction(t.fx_pixels.filter("side = 'pred'"), _rois(t))
    return rows.withColumn("fraction", F.round("fraction", 9))


# Circles placed on the lines of the pixel view: same frames, coordinates folded into its range.
_CIRCLES_SQL = """(SELECT frame_id, candidate_source, score, pos, l_partkey, l_suppkey, cx % 120 AS cx, cy % 60 AS cy, radius % 9 + 3 AS radius
  FROM fx_candidates WHERE frame_id IN (SELECT p_partkey FROM part))"""
AT = ["pos", "l_partkey", "l_suppkey"]


def circles(t):
    frames = t.part.select(F.col("p_partkey").alias("frame_id"))
    return t.fx_candidates.join(frames, "frame_id", "left_semi").select(
        "frame_id", "candidate_source", "score", *AT, (F.col("cx") % 120).alias("cx"), (F.col("cy") % 60).alias("cy"),
        (F.col("radius") % 9 + 3).alias("radius"),
    )


def winner_circles(t, rows=None):
    """The circle of each frame's best candidate, one pixel wider than the candidate's own; ``rows`` are the circles, if they
    are at hand."""
    best = frame_winners(circles(t) if rows is None else rows)
    return best.select("frame_id", "candidate_source", "cx", "cy", (F.col("radius") + 1).alias("radius"))


def context_sql(pixels, winners=False, missing="NULL"):
    """CTEs up to ``ctx``: the circle features of every frame of ``pixels``."""
    own = f"""UNION ALL (SELECT frame_id, candidate_source, score, 1, NULL, NULL, NULL, cx, cy, radius + 1 FROM {_CIRCLES_SQL}
  QUALIFY row_number() OVER (PARTITION BY frame_id ORDER BY score DESC, pos, l_partkey, l_suppkey) = 1)"""
    near = "(abs(mind - radius), own, pos, l_partkey, l_suppkey)"
    return f"""c AS (SELECT frame_id, candidate_source, score, 0 AS own, pos, l_partkey, l_suppkey, cx, cy, radius FROM {_CIRCLES_SQL} {own if winners else ""}), px AS {pixels},
d AS (SELECT c.*, px.x, px.y, sqrt(CAST((x - cx) * (x - cx) + (y - cy) * (y - cy) AS DOUBLE)) AS dist FROM c JOIN px ON c.frame_id = px.frame_id),
m AS (SELECT frame_id, candidate_source, own, pos, l_partkey, l_suppkey, radius, min(dist) AS mind FROM d GROUP BY ALL),
f AS (SELECT frame_id, count(*) AS n, min(mind) AS mc, min(abs(mind - radius)) AS mb, arg_min(candidate_source, {near}) AS src, arg_min(mind - radius, {near}) AS bd,
  arg_min((mind - radius) / radius, {near}) AS bn FROM m GROUP BY frame_id),
pp AS (SELECT frame_id, x, y, max(CASE WHEN dist <= radius + greatest(6, radius * 0.45) THEN 1 ELSE 0 END) AS nr, max(CASE WHEN dist <= radius THEN 1 ELSE 0 END) AS ins,
  max(CASE WHEN dist >= greatest(1, radius - greatest(4, radius * 0.25)) AND dist <= radius + greatest(4, radius * 0.25) THEN 1 ELSE 0 END) AS band FROM d GROUP BY frame_id, x, y),
s AS (SELECT frame_id, sum(nr) AS nr, sum(ins) AS ins, sum(band) AS band FROM pp GROUP BY frame_id),
b AS (SELECT frame_id, count(*) AS pred_pixels FROM px GROUP BY frame_id),
ctx AS (SELECT b.frame_id, pred_pixels, coalesce(f.n, 0) AS candidate_count, round(coalesce(f.mc, {missing}), 6) AS min_candidate_center_distance,
  round(coalesce(f.mb, {missing}), 6) AS min_abs_candidate_boundary_distance, round(f.bd, 6) AS min_candidate_boundary_distance,
  round(f.bn, 6) AS min_candidate_boundary_distance_norm, f.src AS nearest_candidate_source,
  round(coalesce(nr, 0) / CAST(pred_pixels AS DOUBLE), 6) AS mask_fraction_near_any_candidate, round(coalesce(ins, 0) / CAST(pred_pixels AS DOUBLE), 6) AS mask_fraction_inside_any_candidate,
  round(coalesce(band, 0) / CAST(pred_pixels AS DOUBLE), 6) AS mask_fraction_on_candidate_boundary_band
  FROM b LEFT JOIN f ON b.frame_id = f.frame_id LEFT JOIN s ON b.frame_id = s.frame_id)"""


@query(
    "J12_context_distances",
    "WITH " + context_sql("(SELECT frame_id, x, y FROM fx_pixels WHERE side = 'pred')") + " SELECT * FROM ctx",
)
def _(t):
    rows = S.context_features(t.fx_pixels.filter("side = 'pred'"), circles(t), AT)
    floats = [c for c, kind in rows.dtypes if kind == "double"]
    return rows.withColumns({c: F.round(c, 6) for c in floats})


@query(
    "J13_tolerance_join",
    """WITH p AS (SELECT frame_id, x, y FROM fx_pixels WHERE side = 'pred'), g AS (SELECT frame_id, x, y FROM fx_pixels WHERE side = 'gt'),
a AS (SELECT p.*, EXISTS (SELECT 1 FROM g WHERE g.frame_id = p.frame_id AND abs(g.x - p.x) <= 2 AND abs(g.y - p.y) <= 2) AS hit FROM p),
b AS (SELECT g.*, EXISTS (SELECT 1 FROM p WHERE g.frame_id = p.frame_id AND abs(g.x - p.x) <= 2 AND abs(g.y - p.y) <= 2) AS hit FROM g)
SELECT frame_id, count(*) FILTER (WHERE s = 'p' AND hit) AS tp, count(*) FILTER (WHERE s = 'p' AND NOT hit) AS fp, count(*) FILTER (WHERE s = 'g' AND NOT hit) AS fn
FROM (SELECT frame_id, hit, 'p' AS s FROM a UNION ALL SELECT frame_id, hit, 'g' FROM b) GROUP BY frame_id""",
)
def _(t):
    return S.tolerance_counts(t.fx_pixels, 2)


@query(
    "J16_pixels_in_boxes",
    f"""WITH c AS (SELECT *, cx - radius AS x0, cy - radius AS y0, cx + radius AS x1, cy + radius AS y1 FROM {_CIRCLES_SQL}),
n AS (SELECT c.frame_id, c.pos, c.l_partkey, c.l_suppkey, count(px.x) AS mask_pixels FROM c LEFT JOIN fx_pixels px ON px.side = 'gt' AND px.frame_id = c.frame_id
  AND px.x >= x0 AND px.x < x1 AND px.y >= y0 AND px.y < y1 GROUP BY ALL)
SELECT *, CASE WHEN mask_pixels >= 12 THEN 'candidate_positive' WHEN mask_pixels = 0 THEN 'candidate_negative' END AS kind FROM n""",
)
def _(t):
    r = F.col("radius")
    boxes = circles(t).select(
        "frame_id", *AT, (F.col("cx") - r).alias("x0"), (F.col("cy") - r).alias("y0"),
        (F.col("cx") + r).alias("x1"), (F.col("cy") + r).alias("y1"),
    )
    counted = S.pixels_in_boxes(t.fx_pixels.filter("side = 'gt'"), boxes, ["frame_id", *AT])
    return counted.select("frame_id", *AT, "mask_pixels", S.crop_kind(F.col("mask_pixels")).alias("kind"))


_GRAY_SQL = """(SELECT DISTINCT frame_id, x, y, (x * 7 + y * 13 + frame_id) % 256 AS gray, (x * 11 + y * 3) % 256 AS saturation, (x * 5 + y * 17) % 256 > 90 AS foreground FROM fx_pixels)"""


def valued_pixels(t):
    where = ["frame_id", "x", "y"]
    x, y = F.col("x"), F.col("y")
    return t.fx_pixels.select(*where).distinct().select(
        *where, ((x * 7 + y * 13 + F.col("frame_id")) % 256).alias("gray"), ((x * 11 + y * 3) % 256).alias("saturation"),
        ((x * 5 + y * 17) % 256 > 90).alias("foreground"), ((x * 5 + y * 17) % 256).alias("third"),
    )


@query(
    "J20_circle_pixel_stats",
    f"""WITH c AS (SELECT DISTINCT frame_id, cx, cy, radius FROM {_CIRCLES_SQL}),
d AS (SELECT c.*, gray, saturation, foreground, (x - cx) * (x - cx) + (y - cy) * (y - cy) AS d2, gray > 150 AS bright,
  greatest(3, CAST(round_even(radius * CAST(0.45 AS DOUBLE), 0) AS BIGINT)) AS cr FROM c JOIN {_GRAY_SQL} px ON c.frame_id = px.frame_id
  WHERE (x - cx) * (x - cx) + (y - cy) * (y - cy) <= (radius * 2.2) * (radius * 2.2)),
s AS (SELECT frame_id, cx, cy, radius,
  coalesce(avg(CASE WHEN foreground THEN 1 ELSE 0 END) FILTER (WHERE d2 <= radius * radius), 0) AS fill,
  coalesce(avg(CASE WHEN foreground THEN 1 ELSE 0 END) FILTER (WHERE d2 <= cr * cr), 0) AS core_fill,
  coalesce(avg(CASE WHEN bright THEN 1 ELSE 0 END) FILTER (WHERE d2 > (radius * 0.85) * (radius * 0.85)), 0) AS attached_white,
  coalesce(avg(CASE WHEN bright THEN 1 ELSE 0 END) FILTER (WHERE d2 <= (radius + 2) * (radius + 2) AND d2 >= greatest(radius - 2, 1) * greatest(radius - 2, 1)), 0) AS ring_white,
  coalesce(avg(gray) FILTER (WHERE d2 <= cr * cr) / 255, 1) AS core_value,
  coalesce(stddev_pop(gray) FILTER (WHERE d2 <= radius * radius) / 64, 0) AS contrast,
  coalesce(quantile_cont(saturation, 0.5) FILTER (WHERE d2 <= cr * cr), 0) AS sat FROM d GROUP BY frame_id, cx, cy, radius)
SELECT frame_id, cx, cy, radius, round(fill, 6) AS fill, round(attached_white, 6) AS attached_white, round(ring_white + 0.3 * (1 - core_value), 6) AS ring_score,
  round(CASE WHEN core_fill < 0.25 OR (sat < 80 AND core_value * 255 < 145) THEN 0 ELSE greatest(0, least(1, 0.55 * core_fill + 0.2 * fill + 0.15 * least(1, contrast) + 0.1 * sat / 255
   - CASE WHEN sat < 120 AND core_value * 255 > 150 THEN 0.18 ELSE 0 END)) END, 6) AS ball_score FROM s""",
)
def _(t):
    stats = S.circle_pixel_stats(valued_pixels(t), circles(t))
    return stats.select(
        "frame_id", "cx", "cy", "radius", *[F.round(c, 6).alias(c) for c in ("fill", "attached_white", "ring_score", "ball_score")]
    )


_SUPPORT_SQL = f"""WITH c AS (SELECT DISTINCT frame_id, cx, cy, radius, frame_id % 60 + 20 AS ring_x, CAST(10 AS BIGINT) AS ring_y FROM {_CIRCLES_SQL}),
u AS (SELECT *, sqrt(CAST((cx - ring_x) * (cx - ring_x) + (cy - ring_y) * (cy - ring_y) AS DOUBLE)) AS norm FROM c),
d AS (SELECT u.*, gray > 150 AS white, (x - ring_x) * (cx - ring_x) / norm + (y - ring_y) * (cy - ring_y) / norm AS al,
  abs((x - ring_x) * (cy - ring_y) / norm - (y - ring_y) * (cx - ring_x) / norm) AS ac, (x - cx) * (x - cx) + (y - cy) * (y - cy) AS d2,
  greatest(2, CAST(round_even(radius * CAST(0.7 AS DOUBLE), 0) AS BIGINT)) AS cr FROM u JOIN {_GRAY_SQL} px ON u.frame_id = px.frame_id WHERE norm >= 1),
s AS (SELECT frame_id, ring_x, cx, cy, radius,
  coalesce(avg(CASE WHEN white THEN 1 ELSE 0 END) FILTER (WHERE round(ac, 9) <= greatest(2.5, radius * 0.28) AND round(al, 9) >= 0 AND al <= norm + radius * 1.2), 0)
  + 0.7 * coalesce(avg(CASE WHEN white THEN 1 ELSE 0 END) FILTER (WHERE d2 <= cr * cr), 0) AS support FROM d GROUP BY ALL),
sup AS (SELECT c.frame_id, c.ring_x, c.cx, c.cy, c.radius, round(coalesce(support, 0), 6) AS support FROM c LEFT JOIN s ON s.frame_id = c.frame_id AND s.cx = c.cx AND s.cy = c.cy AND s.radius = c.radius)"""


def supported(t):
    """Distinct circles with their ring's centre and the support between both."""
    pairs = circles(t).select("frame_id", "cx", "cy", "radius").distinct().select(
        "*", (F.col("frame_id") % 60 + 20).alias("ring_x"), F.lit(10).cast("bigint").alias("ring_y")
    )
    return S.capsule_support(valued_pixels(t), pairs).withColumn("support", F.round("support", 6))


@query("J20_capsule_support", _SUPPORT_SQL + " SELECT * FROM sup")
def _(t):
    return supported(t).select("frame_id", "ring_x", "cx", "cy", "radius", "support")


@query(
    "J11_ring_members",
    _SUPPORT_SQL + f""", r AS (SELECT o.*, support FROM {_CIRCLES_SQL} o JOIN sup ON sup.frame_id = o.frame_id AND sup.cx = o.cx AND sup.cy = o.cy AND sup.radius = o.radius
  WHERE (o.cx - ring_x) * (o.cx - ring_x) + (o.cy - 10) * (o.cy - 10) > 0.49 * CAST((8 + o.frame_id % 12) * (8 + o.frame_id % 12) AS DOUBLE)
  AND (o.cx - ring_x) * (o.cx - ring_x) + (o.cy - 10) * (o.cy - 10) < 7.84 * CAST((8 + o.frame_id % 12) * (8 + o.frame_id % 12) AS DOUBLE)),
k AS (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY support DESC, pos, l_partkey, l_suppkey) - 1 AS ring_rank FROM r)
SELECT frame_id, ring_rank, 'reticle_global_' || ring_rank AS candidate_source, cx, cy, radius, round(support, 6) AS support,
  round(greatest(0, least(1, 0.7 * score + 0.6 * support)), 6) AS score FROM k WHERE ring_rank < 3""",
)
def _(t):
    own = circles(t).join(supported(t), ["frame_id", "cx", "cy", "radius"])
    rings = t.part.select(
        F.col("p_partkey").alias("frame_id"), (F.col("p_partkey") % 60 + 20).alias("ring_x"), F.lit(10).cast("bigint").alias("ring_y"),
        (F.col("p_partkey") % 12 + 8).alias("ring_radius"),
    )
    top = S.ring_candidates(own, rings, AT)
    return top.select(
        "frame_id", F.col("ring_rank").cast("bigint").alias("ring_rank"), "candidate_source", "cx", "cy", "radius",
        F.round("support", 6).alias("support"), F.round("score", 6).alias("score"),
    )


_NMS_SQL = f"""WITH RECURSIVE c AS {CROWD_SQL},
r(frame_id, rn, kept) AS (
  SELECT frame_id, CAST(1 AS BIGINT), [{{'x': cx, 'y': cy, 'r': radius, 'n': rn}}] FROM c WHERE rn = 1
  UNION ALL
  SELECT c.frame_id, c.rn, CASE WHEN len(list_filter(r.kept, lambda k: (k.x - c.cx) * (k.x - c.cx) + (k.y - c.cy) * (k.y - c.cy) < greatest(k.r, c.radius, 1) * greatest(k.r, c.radius, 1))) > 0
    THEN r.kept ELSE list_append(r.kept, {{'x': c.cx, 'y': c.cy, 'r': c.radius, 'n': c.rn}}) END
  FROM r JOIN c ON c.frame_id = r.frame_id AND c.rn = r.rn + 1),
last AS (SELECT frame_id, unnest(kept) AS k FROM (SELECT frame_id, kept FROM r QUALIFY row_number() OVER (PARTITION BY frame_id ORDER BY rn DESC) = 1))
SELECT frame_id, k.x AS cx, k.y AS cy, k.r AS radius FROM last"""


@query("W9_suppress_overlaps", _NMS_SQL)
def _(t):
    return S.suppress_overlaps(crowd(t).drop("candidate_source", "selector_pool"), best_first()).select("frame_id", "cx", "cy", "radius")


@query("W9_suppress_crowded", _NMS_SQL)
def _(t):
    rows = crowd(t).drop("candidate_source", "selector_pool")
    return S.suppress_overlaps(rows, best_first(), block=2).select("frame_id", "cx", "cy", "radius")


def _assembly_sql(grid):
    scene = """UNION ALL SELECT frame_id, 'crop_00', 'scene_fallback', 320, 180, 0.0, 320 - CAST(round_even(36 * 1.8, 0) AS BIGINT), 180 + CAST(round_even(36 * 1.8, 0) AS BIGINT)
  FROM f WHERE frame_id NOT IN (SELECT frame_id FROM a)"""
    return f"""WITH RECURSIVE f AS (SELECT o_orderkey AS frame_id FROM orders),
m0 AS (SELECT * FROM fx_candidates WHERE selector_pool = 'primary' AND frame_id % 5 <> 0),
q AS (SELECT *, (cx - (100 + frame_id % 300)) * (cx - (100 + frame_id % 300)) + (cy - 200) * (cy - 200) AS d2, CAST(20 + frame_id % 40 AS DOUBLE) AS rr FROM m0),
t AS (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY candidate_iou DESC, pos, l_partkey, l_suppkey) - 1 AS k FROM q WHERE d2 > 0.49 * rr * rr AND d2 < 7.84 * rr * rr),
m AS (SELECT frame_id, cx, cy, radius, score, candidate_source, pos, 0 AS step FROM m0
  UNION ALL SELECT frame_id, cx, cy, radius, greatest(0, least(1, 0.7 * score + 0.6 * candidate_iou)), 'reticle_global_' || k, pos, 1 FROM t WHERE k < 3),
x AS (SELECT frame_id, cx, cy, radius, score, candidate_source, pos, 2 AS step FROM fx_candidates WHERE selector_pool NOT IN ('primary', 'fallback') AND frame_id % 3 <> 0 AND frame_id IN (SELECT frame_id FROM f)
  AND frame_id NOT IN (SELECT frame_id FROM m GROUP BY frame_id HAVING count(*) >= 5)),
y AS (SELECT frame_id, cx, cy, radius, score, candidate_source, pos, 3 AS step FROM fx_candidates WHERE selector_pool = 'fallback' AND frame_id % 2 = 0),
g AS (SELECT frame_id, CAST(floor(640 * (0.15 + 0.35 * (i % 3))) AS BIGINT) AS cx, CAST(floor(360 * (0.2 + 0.6 * (i // 3))) AS BIGINT) AS cy, CAST(30 AS BIGINT) AS radius,
  CAST(0.05 AS DOUBLE) AS score, 'grid' AS candidate_source, i AS pos, 4 AS step FROM f, range({grid}) t(i)
  WHERE frame_id NOT IN (SELECT frame_id FROM m) AND frame_id NOT IN (SELECT frame_id FROM x) AND frame_id NOT IN (SELECT frame_id FROM y)),
a AS (SELECT frame_id, cx, cy, CAST(radius AS BIGINT) AS radius, score, candidate_source, CAST(pos AS BIGINT) AS pos, step
  FROM (SELECT * FROM m UNION ALL SELECT * FROM x UNION ALL SELECT * FROM y UNION ALL SELECT * FROM g) WHERE frame_id IN (SELECT frame_id FROM f)),
l AS (SELECT frame_id, cx, cy, radius, arg_max(candidate_source, (step, pos)) AS src FROM a GROUP BY ALL),
c AS (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY score DESC, step, pos, cx, cy, radius) AS rn FROM a),
r(frame_id, rn, kept) AS (
  SELECT frame_id, CAST(1 AS BIGINT), [{{'x': cx, 'y': cy, 'r': radius, 's': score}}] FROM c WHERE rn = 1
  UNION ALL
  SELECT c.frame_id, c.rn, CASE WHEN len(list_filter(r.kept, lambda k: (k.x - c.cx) * (k.x - c.cx) + (k.y - c.cy) * (k.y - c.cy) < greatest(k.r, c.radius, 1) * greatest(k.r, c.radius, 1))) > 0
    THEN r.kept ELSE list_append(r.kept, {{'x': c.cx, 'y': c.cy, 'r': c.radius, 's': c.score}}) END
  FROM r JOIN c ON c.frame_id = r.frame_id AND c.rn = r.rn + 1),
last AS (SELECT frame_id, unnest(kept) AS k, unnest(range(len(kept))) AS i FROM (SELECT frame_id, kept FROM r QUALIFY row_number() OVER (PARTITION BY frame_id ORDER BY rn DESC) = 1)),
o AS (SELECT last.frame_id, i, k.x AS cx, k.y AS cy, k.r AS r0, k.s AS score, greatest(k.r, 8) AS radius, src FROM last JOIN l ON l.frame_id = last.frame_id AND l.cx = k.x AND l.cy = k.y AND l.radius = k.r WHERE i < 10)
SELECT frame_id, printf('crop_%02d', i) AS candidate_id, src AS candidate_source, cx, cy, round(score, 9) AS score,
  greatest(0, cx - CAST(round_even(CAST(radius * 4.25 + 24 AS DOUBLE), 0) AS BIGINT)) AS x0, least(360, cy + CAST(round_even(CAST(radius * 4.25 + 24 AS DOUBLE), 0) AS BIGINT)) AS y1 FROM o
{scene}"""


def _assembly(t, grid):
    frames = t.orders.select(
        F.col("o_orderkey").alias("frame_id"), F.lit(0).alias("x0"), F.lit(0).alias("y0"), F.lit(640).alias("x1"),
        F.lit(360).alias("y1"), F.lit(640).alias("width"), F.lit(360).alias("height"),
    )
    rings = frames.select(
        "frame_id", (F.col("frame_id") % 300 + 100).alias("ring_x"), F.lit(200).alias("ring_y"), (F.col("frame_id") % 40 + 20).alias("ring_radius")
    )
    main = t.fx_candidates.filter("selector_pool = 'primary' AND frame_id % 5 <> 0")
    reticle = S.ring_candidates(main.withColumn("support", F.col("candidate_iou")), rings, AT)
    extra = t.fx_candidates.filter("selector_pool NOT IN ('primary', 'fallback') AND frame_id % 3 <> 0")
    late = t.fx_candidates.filter("selector_pool = 'fallback' AND frame_id % 2 = 0")
    rows = S.assemble_candidates(frames, main, extra, [-F.col("score"), "_step", "pos", "cx", "cy", "radius"], rings=reticle, late=[late], grid=grid)
    return rows.select("frame_id", "candidate_id", "candidate_source", "cx", "cy", F.round("score", 9).alias("score"), "x0", "y1")


@query("W11_assemble_candidates", _assembly_sql(6))
def _(t):
    return _assembly(t, 6)


@query("W11_scene_fallback", _assembly_sql(0))
def _(t):
    return _assembly(t, 0)


@query(
    "W12_boosted_score",
    f"""WITH c AS (SELECT frame_id, cx, cy, radius, count(*) AS copies, max(score) AS s FROM {CROWD_SQL} GROUP BY ALL),
n AS (SELECT a.frame_id, a.cx, a.cy, a.radius, any_value(a.s) AS s, coalesce(sum(b.copies), 0) AS n FROM c a LEFT JOIN c b ON a.frame_id = b.frame_id
  AND (a.cx - b.cx) * (a.cx - b.cx) + (a.cy - b.cy) * (a.cy - b.cy) > 0.25 * a.radius * a.radius
  AND (a.cx - b.cx) * (a.cx - b.cx) + (a.cy - b.cy) * (a.cy - b.cy) < 6.25 * a.radius * a.radius AND b.radius BETWEEN 0.4 * a.radius AND 1.6 * a.radius GROUP BY ALL)
SELECT frame_id, cx, cy, radius, round(greatest(0, least(1, 0.6 * s + 0.2 * least(1, (cx % 50) / CAST(100 AS DOUBLE) * 8) + 0.2 * least(1, n / CAST(4 AS DOUBLE)))), 6) AS boosted FROM n""",
)
def _(t):
    keys = ["frame_id", "cx", "cy", "radius"]
    scores = crowd(t).groupBy(*keys).agg(F.max("score").alias("score"))
    joined = S.circle_neighbours(crowd(t)).join(scores, keys)
    boosted = S.boosted_score(F.col("score"), F.col("cx") % 50 / 100.0, F.col("n_neighbours"))
    return joined.select(*keys, F.round(boosted, 6).alias("boosted"))


@query(
    "W24_smallest_containing",
    f"""WITH c AS {CROWD_SQL}, b AS (SELECT *, cx - radius * 4 AS x0, cy - radius * 4 AS y0, cx + radius * 4 AS x1, cy + radius * 4 AS y1, 64 * radius * radius AS area FROM c),
p AS (SELECT DISTINCT o_orderkey % 300 AS frame_id, o_orderkey * 7 % 640 AS px, o_orderkey * 3 % 400 AS py FROM orders)
SELECT p.frame_id, px, py, b.cx, b.cy, b.area FROM p JOIN b ON p.frame_id = b.frame_id AND px BETWEEN x0 AND x1 AND py BETWEEN y0 AND y1
QUALIFY row_number() OVER (PARTITION BY p.frame_id, px, py ORDER BY area, b.score DESC, b.pos, b.l_partkey, b.l_suppkey) = 1""",
)
def _(t):
    r = F.col("radius")
    boxes = crowd(t).withColumns(
        {
            "x0": F.col("cx") - r * 4, "y0": F.col("cy") - r * 4, "x1": F.col("cx") + r * 4, "y1": F.col("cy") + r * 4,
            "area": r * r * 64,
        }
    )
    o = F.col("o_orderkey")
    points = t.orders.select((o % 300).alias("frame_id"), (o * 7 % 640).alias("px"), (o * 3 % 400).alias("py")).distinct()
    hit = S.smallest_containing(points, boxes, ["pos", "l_partkey", "l_suppkey"])
    return hit.select("frame_id", "px", "py", "cx", "cy", F.col("area"))
