"""Queries for feature vectors, scores and scorers."""

from pyspark.sql import functions as F

from framegate.functions.keys import dataset_class
from framegate.operators import features as X
from framegate.operators import thresholds as T
from framegate.plans.common import WINNER_SQL, frame_winners
from framegate.plans.q_spatial import AT, circles, context_sql, valued_pixels, winner_circles
from framegate.plans.registry import query
from framegate.runtime import bucketed, unsized

KEYS = ["frame_id", "pos", "l_partkey", "l_suppkey"]


def rounded(df, places=6):
    return df.withColumns({c: F.round(c, places) for c, kind in df.dtypes if kind == "double"})


def _features():
    return F.create_map(
        F.lit("area"), F.col("pred_pixels").cast("double"), F.lit("continuity"), F.col("candidate_iou").cast("double"),
        F.lit("connected_to_ball"), (F.col("pos") % 2).cast("double"), F.lit("outward_extension"), F.col("cx") / 640.0,
    )


def _vector():
    ring = F.when(F.col("pos") == 2, -1.0).when(F.col("pos") != 4, F.col("cy") / 20.0)
    return X.ranker_vector(
        F.col("candidate_source"), F.col("candidate_score"), F.col("score"), F.col("candidate_iou"), F.col("pred_pixels"), ring, _features()
    )


@query(
    "E1_ranker_vector",
    """WITH v AS (SELECT *, CASE WHEN pos NOT IN (2, 4) THEN least(cy / CAST(20 AS DOUBLE), 12) ELSE 0 END AS ring, CASE WHEN pos NOT IN (2, 4) THEN 1 ELSE 0 END AS has FROM fx_candidates)
SELECT frame_id, pos, l_partkey, l_suppkey, 27 AS size, round(ln(1 + greatest(score, 0)), 6) AS log_raw, round(ln(1 + pred_pixels), 6) AS log_pixels, round(ring, 6) AS ring,
  round(ln(1 + greatest(score, 0)) + candidate_score + candidate_iou + ln(1 + pred_pixels) + ring + has + pred_pixels + candidate_iou + pos % 2 + cx / CAST(640 AS DOUBLE) + CASE WHEN candidate_source = 'line_endpoint' THEN 0 ELSE 1 END, 5) AS total FROM v""",
)
def _(t):
    rows = t.fx_candidates.select(*KEYS, _vector().alias("v"))
    total = F.aggregate("v", F.lit(0.0), lambda a, x: a + x)
    return rows.select(
        *KEYS, F.size("v").alias("size"), F.round(F.col("v")[0], 6).alias("log_raw"), F.round(F.col("v")[3], 6).alias("log_pixels"),
        F.round(F.col("v")[4], 6).alias("ring"), F.round(total, 5).alias("total"),
    )


def _pair_item(prefix_filter, t, name):
    rows = frame_winners(t.fx_candidates.filter(prefix_filter))
    item = F.struct(
        "score", F.col("score").alias("raw_score"), "candidate_score", F.col("candidate_iou").alias("confidence"), "pred_pixels",
        F.lit(1.5).alias("reticle_distance"), "candidate_source", "candidate_iou", _features().alias("features"),
    )
    return rows.select("frame_id", item.alias(name))


_PAIR_SQL = """WITH a AS (SELECT * FROM fx_candidates WHERE selector_pool = 'primary' QUALIFY row_number() OVER (PARTITION BY frame_id ORDER BY score DESC, pos, l_partkey, l_suppkey) = 1),
b AS (SELECT * FROM fx_candidates WHERE selector_pool = 'fallback' QUALIFY row_number() OVER (PARTITION BY frame_id ORDER BY score DESC, pos, l_partkey, l_suppkey) = 1)"""


@query(
    "E2_pair_vector",
    _PAIR_SQL + """ SELECT a.frame_id, 84 AS size, round(a.score - b.score, 6) AS d_score, CAST(a.pred_pixels - b.pred_pixels AS DOUBLE) AS d_pixels, round(a.candidate_iou - b.candidate_iou, 6) AS d_continuity,
  round(2 * a.score - b.score + 0, 6) AS tail FROM a JOIN b ON a.frame_id = b.frame_id""",
)
def _(t):
    pairs = _pair_item("selector_pool = 'primary'", t, "a").join(_pair_item("selector_pool = 'fallback'", t, "b"), "frame_id")
    v = pairs.select("frame_id", X.pair_vector("a", "b").alias("v"))
    at = lambda i: F.col("v")[i]
    return v.select(
        "frame_id", F.size("v").alias("size"), F.round(at(54), 6).alias("d_score"), at(58).alias("d_pixels"),
        F.round(at(54 + 6 + 8), 6).alias("d_continuity"), F.round(at(81) + at(83), 6).alias("tail"),
    )


def _values():
    """Sparse number map: names that depend on the row."""
    return F.map_filter(
        F.create_map(
            F.lit("score"), F.col("score"), F.lit("features.reach"), F.when(F.col("pos") != 3, F.col("cx") / 640.0),
            F.lit("pixels"), F.col("pred_pixels").cast("double"),
        ),
        lambda k, v: v.isNotNull(),
    )


def _flag_list():
    return F.array_compact(F.array(F.when(F.col("selector_pool") == "fallback", F.lit("fallback")), F.when(F.col("selector_pool") == "rescue", F.lit("rescue"))))


@query(
    "E3_dense_vectors",
    """SELECT frame_id, pos, l_partkey, l_suppkey, concat_ws(',', CASE WHEN pos <> 3 THEN '1' ELSE '0' END, CASE WHEN candidate_source = 'white_blob' THEN '1' ELSE '0' END, CASE WHEN candidate_source LIKE 'reticle!_global%' ESCAPE '!' THEN '1' ELSE '0' END,
  CASE WHEN selector_pool = 'fallback' THEN '1' ELSE '0' END, CASE WHEN selector_pool = 'rescue' THEN '1' ELSE '0' END) AS marks, 17 AS size, round(CASE WHEN pos <> 3 THEN cx / CAST(640 AS DOUBLE) ELSE 0 END, 7) AS reach, CAST(pred_pixels AS DOUBLE) AS pixels FROM fx_candidates""",
)
def _(t):
    rows = t.fx_candidates.select(*KEYS, F.col("candidate_source").alias("source"), _values().alias("values"), _flag_list().alias("flags"))
    v = X.dense_vectors(rows, X.feature_spec(rows))
    at = lambda i: F.col("vector")[i]
    marks = F.concat_ws(",", *[at(i).cast("int").cast("string") for i in (1, 10, 12, 15, 16)])
    return v.select(*KEYS, marks.alias("marks"), F.size("vector").alias("size"), F.round(at(0), 7).alias("reach"), at(2).alias("pixels"))


@query(
    "E4_pair_vectors",
    f"""WITH w AS {WINNER_SQL}, p AS (SELECT c.*, w.score AS ws, w.pos AS wpos, w.cx AS wcx, w.pred_pixels AS wpx, w.selector_pool AS wpool FROM fx_candidates c JOIN w ON w.frame_id = c.frame_id)
SELECT frame_id, pos, l_partkey, l_suppkey, 43 AS size, round(CASE WHEN pos <> 3 AND wpos <> 3 THEN cx / CAST(640 AS DOUBLE) - wcx / CAST(640 AS DOUBLE) ELSE 0 END, 7) AS d_reach, CAST(pred_pixels - wpx AS DOUBLE) AS d_pixels, round(score - ws, 6) AS d_score,
  CAST(CASE WHEN wpos <> 3 THEN 1 ELSE 0 END + CASE WHEN pos <> 3 THEN 1 ELSE 0 END AS DOUBLE) AS known, CAST(CASE WHEN wpool = 'rescue' THEN 1 ELSE 0 END AS DOUBLE) AS current_rescue, CAST(CASE WHEN selector_pool = 'rescue' THEN 1 ELSE 0 END AS DOUBLE) AS candidate_rescue FROM p""",
)
def _(t):
    item = F.struct(_values().alias("values"), F.col("candidate_source").alias("source"), F.col("selector_pool").alias("pool"), _flag_list().alias("flags"))
    current = frame_winners(t.fx_candidates).select("frame_id", item.alias("current"))
    pairs = t.fx_candidates.select(*KEYS, item.alias("candidate")).join(current, "frame_id")
    v = X.pair_vectors(pairs, X.pair_spec(pairs))
    at = lambda i: F.col("vector")[i]
    size = F.size("vector")
    return v.select(
        *KEYS, size.alias("size"), F.round(at(4), 7).alias("d_reach"), at(9).alias("d_pixels"), F.round(at(14), 6).alias("d_score"),
        (at(1) + at(3)).alias("known"), F.element_at("vector", size - 2).alias("current_rescue"), F.element_at("vector", size).alias("candidate_rescue"),
    )


@query(
    "E5_scores",
    """WITH px AS (SELECT frame_id, side AS candidate_id, (x * 7 + y * 13 + frame_id) % 256 / CAST(255 AS DOUBLE) AS p, (x + y) % 3 = 0 AS in_ball FROM fx_pixels),
s AS (SELECT frame_id, candidate_id, avg(p) FILTER (WHERE p >= 0.35) AS mp, count(*) FILTER (WHERE p >= 0.35) AS n, count(*) FILTER (WHERE p >= 0.35 AND in_ball) AS b FROM px GROUP BY ALL),
r AS (SELECT frame_id, candidate_id, n, coalesce(mp + 0.8 * (b / CAST(frame_id % 40 + 1 AS DOUBLE)) + 0.002 * n, 0) AS raw FROM s)
SELECT frame_id, candidate_id, n AS pred_pixels, round(raw, 6) AS raw_score, round(ln(1 + raw) + 0.7 * (frame_id % 10 / CAST(10 AS DOUBLE)) + 0.2 * 0.5 + 1.2 * 0.25 + 0.5 * 0.3, 6) AS rank_score FROM r""",
)
def _(t):
    p = (F.col("x") * 7 + F.col("y") * 13 + F.col("frame_id")) % 256 / 255.0
    pixels = t.fx_pixels.select("frame_id", F.col("side").alias("candidate_id"), p.alias("p"), ((F.col("x") + F.col("y")) % 3 == 0).alias("in_ball"))
    balls = t.fx_pixels.select("frame_id", F.col("side").alias("candidate_id")).distinct().withColumn("ball_pixels", F.col("frame_id") % 40 + 1)
    features = F.create_map(F.lit("continuity"), F.lit(0.5), F.lit("connected_to_ball"), F.lit(0.25))
    rows = X.raw_scores(pixels, balls)
    rank = X.rank_score(F.col("raw_score"), F.col("frame_id") % 10 / 10.0, features, F.lit(0.3))
    return rounded(rows.withColumn("rank_score", rank))


@query(
    "E6_mlp_score",
    """WITH x AS (SELECT vec_id, list_transform(range(1, 65), lambda i: CAST(embedding[i] AS DOUBLE) * 2 * (i % 5 - 2) / 4) AS p, list_transform(range(1, 65), lambda i: CAST(embedding[i] AS DOUBLE) * 2 * (i % 3) / 4) AS q FROM embeddings),
h AS (SELECT vec_id, greatest(0, list_sum(p) + CAST(0.1 AS DOUBLE)) AS h1, greatest(0, list_sum(q) - CAST(0.05 AS DOUBLE)) AS h2 FROM x)
SELECT vec_id, round(1 / (1 + exp(-(CAST(1.5 AS DOUBLE) * h1 - CAST(0.7 AS DOUBLE) * h2 + CAST(0.2 AS DOUBLE)))), 6) AS score FROM h""",
)
def _(t):
    values = F.transform("embedding", lambda v: v.cast("double"))
    hidden = [[(i % 5 - 2) / 4 for i in range(1, 65)], [i % 3 / 4 for i in range(1, 65)]]
    layers = [(hidden, [0.1, -0.05]), ([[1.5, -0.7]], [0.2])]
    score = X.mlp_score(values, layers, mean=[0.0] * 64, std=[0.5] * 64)
    return t.embeddings.select("vec_id", F.round(score, 6).alias("score"))


@query("E7_train_classifier")
def _(t):
    rows = t.fx_probs.withColumn("length", F.log1p("pred_pixels")).withColumn("wiki", (F.col("winner_source") == "wiki").cast("double"))
    model = X.train_classifier(rows, ["length", "wiki", "p"], "target")
    scored = X.classify(model, rows, "target")
    best = T.veto_threshold(scored, "probability", F.col("target") >= 0.5)
    return best.select(F.round("threshold", 6).alias("threshold"), "hit", "miss", "hit_total", "miss_total")


@query(
    "E8_choose_fallback",
    _PAIR_SQL + """ SELECT count(*) AS frames, count(*) FILTER (WHERE b.score - a.score + 0.1 >= 0) AS fallbacks, round(avg(CASE WHEN b.score - a.score + 0.1 >= 0 THEN b.candidate_iou ELSE a.candidate_iou END), 6) AS achieved_iou
FROM a JOIN b ON a.frame_id = b.frame_id""",
)
def _(t):
    pairs = _pair_item("selector_pool = 'primary'", t, "a").join(_pair_item("selector_pool = 'fallback'", t, "b"), "frame_id")
    pairs = pairs.withColumns({"primary_iou": F.col("a.candidate_iou"), "fallback_iou": F.col("b.candidate_iou")})
    chosen = X.choose_fallback(pairs, F.col("b.score") - F.col("a.score") + 0.1)
    return chosen.agg(
        F.count("*").alias("frames"), F.count_if("use_fallback").alias("fallbacks"), F.round(F.avg("achieved_iou"), 6).alias("achieved_iou")
    )


@query(
    "E9_ranking_quality",
    f"SELECT count(*) AS frames, round(avg(candidate_iou), 6) AS mean_iou, round(avg(CASE WHEN score < 0.3 THEN 1.0 ELSE 0.0 END), 6) AS reject_rate FROM {WINNER_SQL}",
)
def _(t):
    return rounded(X.ranking_quality(t.fx_candidates, "frame_id", "score", "candidate_iou", AT, 0.3))


@query(
    "E10_sample_weights",
    """WITH c AS (SELECT *, CASE lower(trim(dataset_split)) WHEN 'main' THEN 'main' WHEN 'quarantine' THEN 'quarantine' ELSE 'legacy' END AS k FROM fx_annotations)
SELECT id, round(CASE WHEN k = 'main' AND save_mode = 'normal' THEN 1 WHEN k = 'quarantine' THEN 0.8 WHEN k = 'legacy' THEN 0.85 ELSE 0.9 END
  * CASE WHEN major_len > 0 AND major_len < 12 THEN 1.6 WHEN major_len > 0 AND major_len < 20 THEN 1.3 ELSE 1 END * CASE WHEN refined THEN 1.2 ELSE 1 END * CASE WHEN id % 9 = 0 THEN 1.5 ELSE 1 END, 6)::DOUBLE AS weight FROM c""",
)
def _(t):
    base = X.base_weight(dataset_class(F.col("dataset_split")), F.col("save_mode"))
    weight = X.sample_weight(base, F.col("major_len"), F.col("refined"), F.col("id") % 9 == 0)
    return t.fx_annotations.select("id", F.round(weight, 6).alias("weight"))


@query(
    "E11_distractor_scores",
    """WITH c AS (SELECT p_partkey % 300 AS image, p_partkey AS cid, CAST(p_size * 6 AS DOUBLE) AS area, p_size + 3 AS w, p_size % 13 + 5 AS h, p_retailprice / 1500 AS circ FROM part),
s AS (SELECT *, 0.45 * least(area / 900, 1) + 0.2 * least(0.5 * (w + h) / 48, 1) + 0.2 * (1 - least(abs(area / greatest(1, w * h) - 0.62) / 0.62, 1)) + 0.15 * greatest(0, least(1, circ)) AS score FROM c WHERE area >= 12),
i AS (SELECT DISTINCT p_partkey % 300 AS image FROM part), r AS (SELECT *, row_number() OVER (PARTITION BY image ORDER BY score DESC, cid) AS rn FROM s),
a AS (SELECT image, sum(score) AS total, count(*) AS n, string_agg(cid::VARCHAR, ',' ORDER BY rn) FILTER (WHERE rn <= 5) AS top FROM r GROUP BY image)
SELECT i.image, round(coalesce(total, 0) + least(i.image * 10 / CAST(100000 AS DOUBLE) / 0.02, 1) * 0.25, 6) AS score, coalesce(n, 0) AS component_count, top AS top_components,
  round(CASE WHEN i.image = 0 THEN 0 ELSE i.image + 3 * 1.8 + 2 * 1.2 + i.image / CAST(100000 AS DOUBLE) * 200 + 4 * 25 END, 6) AS linear FROM i LEFT JOIN a USING (image)""",
)
def _(t):
    k, size = F.col("p_partkey"), F.col("p_size")
    components = t.part.select(
        (k % 300).alias("image"), k.alias("component_id"), (size * 6).cast("double").alias("area"), (size + 3).alias("w"),
        (size % 13 + 5).alias("h"), (F.col("p_retailprice") / 1500).alias("circularity"),
    )
    images = components.select("image").distinct().withColumns({"white_area": F.col("image") * 10, "pixels": F.lit(100_000.0)})
    rows = X.distractor_scores(components, images)
    linear = X.distractor_linear(F.col("image"), F.lit(3), F.lit(2), F.lit(100_000.0), F.lit(4))
    return rows.select(
        "image", F.round("score", 6).alias("score"), "component_count", F.array_join("top_components", ",").alias("top_components"),
        F.round(linear, 6).alias("linear"),
    )


@query(
    "E12_component_choice",
    """WITH c AS (SELECT p_partkey % 300 AS frame_id, p_partkey AS cid, p_size AS area, p_partkey % 17 / CAST(2 AS DOUBLE) AS el, p_partkey % 11 / CAST(10 AS DOUBLE) AS wh, p_partkey % 7 / CAST(6 AS DOUBLE) AS sh, p_partkey % 5 / CAST(4 AS DOUBLE) AS mp FROM part),
s AS (SELECT *, 1.8 * wh + 1.2 * sh + 0.08 * least(el, 12) + 0.9 * mp AS sc, 1.55 * wh + 1.1 * sh + 0.75 * least(10, el) / 10 - 0.45 * mp AS rs FROM c WHERE area >= 6 AND el >= 1.5 AND wh >= 0.3 AND sh >= 0.2)
SELECT frame_id, cid AS component_id, round(sc, 6) AS score, round(rs, 6) AS refined_score FROM s QUALIFY row_number() OVER (PARTITION BY frame_id ORDER BY round(sc, 9) DESC, cid) = 1""",
)
def _(t):
    k = F.col("p_partkey")
    rows = t.part.select(
        (k % 300).alias("frame_id"), k.alias("component_id"), F.col("p_size").alias("area"), (k % 17 / 2.0).alias("el"), (k % 11 / 10.0).alias("wh"),
        (k % 7 / 6.0).alias("sh"), (k % 5 / 4.0).alias("mp"),
    )
    args = [F.col(c) for c in ("area", "el", "wh", "sh", "mp")]
    scored = rows.withColumns(
        {"score": X.component_score(*args, 6, 1.5, 0.3, 0.2), "refined_score": X.refined_component_score(F.col("wh"), F.col("sh"), F.col("el"), F.col("mp"))}
    ).filter("score IS NOT NULL")
    best = X.top_per_key(scored, ["frame_id"], [F.round("score", 9).desc(), "component_id"])
    return rounded(best.select("frame_id", "component_id", "score", "refined_score"))


@query(
    "E13_choose_line",
    """WITH s AS (SELECT frame_id, pos, l_partkey, l_suppkey, cx AS x1, cy AS y1, cx + radius * 6 - pred_pixels AS x2, cy + pred_pixels - 20 AS y2, candidate_score AS s1, candidate_iou AS s2, CASE WHEN frame_id % 3 <> 0 THEN frame_id % 640 END AS qx, CASE WHEN frame_id % 3 <> 0 THEN frame_id % 400 END AS qy FROM fx_candidates),
e AS (SELECT *, x1 - 4 AS ex1, y1 AS ey1, x2 + 4 AS ex2, y2 AS ey2, sqrt(CAST((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1) AS DOUBLE)) AS len, abs(degrees(atan2(CAST(y2 - y1 AS DOUBLE), CAST(x2 - x1 AS DOUBLE)))) AS an FROM s),
g AS (SELECT *, CAST(ex2 - ex1 AS DOUBLE) AS dx, CAST(ey2 - ey1 AS DOUBLE) AS dy FROM e),
h AS (SELECT *, CASE WHEN dx = 0 AND dy = 0 THEN 0 ELSE greatest(0, least(1, ((qx - ex1) * dx + (qy - ey1) * dy) / greatest(dx * dx + dy * dy, 1e-6))) END AS t FROM g),
k AS (SELECT *, sqrt(dx * dx + dy * dy) AS ext, coalesce(sqrt(pow(qx - (ex1 + t * dx), 2) + pow(qy - (ey1 + t * dy), 2)), 0) AS gap, greatest(s1, s2) AS col FROM h),
f AS (SELECT *, 0.2 * ext + 0.2 * len + 50 * col - 0.3 * gap AS score FROM k WHERE len BETWEEN 15 AND 200 AND CASE WHEN an <= 90 THEN an ELSE 180 - an END BETWEEN 2 AND 80 AND NOT (qx IS NOT NULL AND gap < 4 AND ext < 60) AND col >= 0.25)
SELECT frame_id, x1, y1, x2, y2, round(score, 6) AS score FROM f QUALIFY row_number() OVER (PARTITION BY frame_id ORDER BY score DESC, pos, l_partkey, l_suppkey) = 1""",
)
def _(t):
    x1, y1, r, n = (F.col(c) for c in ("cx", "cy", "radius", "pred_pixels"))
    x2, y2 = x1 + r * 6 - n, y1 + n - 20
    seen = F.col("frame_id") % 3 != 0
    rows = t.fx_candidates.select(
        "frame_id", *AT, x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"), (x1 - 4).alias("ex1"), y1.alias("ey1"),
        (x2 + 4).alias("ex2"), y2.alias("ey2"), F.col("candidate_score").alias("sat1"), F.col("candidate_iou").alias("sat2"),
        F.when(seen, F.col("frame_id") % 640).alias("cue_x"), F.when(seen, F.col("frame_id") % 400).alias("cue_y"),
    )
    best = X.choose_line(rows, AT, (15, 200), (2, 80))
    return best.select("frame_id", "x1", "y1", "x2", "y2", F.round("score", 6).alias("score"))


# Frames without circles are infinitely far from them; the winner's own circle counts.
CONTEXT_SQL = context_sql("(SELECT DISTINCT frame_id, x, y FROM fx_pixels)", True, "CAST('inf' AS DOUBLE)") + """,
white AS (SELECT frame_id, round(avg(CASE WHEN (x * 11 + y * 3) % 256 < 80 AND (x * 7 + y * 13 + frame_id) % 256 > 150 THEN 1.0 ELSE 0.0 END), 6) AS mask_white_fraction,
  round(avg(CASE WHEN x >= 10 AND x < 60 AND y >= 5 AND y < 40 THEN 1.0 ELSE 0.0 END), 6) AS mask_fraction_in_table_roi, round(50 * 35 / CAST(7200 AS DOUBLE), 6) AS table_roi_area_fraction FROM px GROUP BY frame_id),
context AS (SELECT * FROM ctx JOIN white USING (frame_id))"""


def context(t, frames=None):
    """The context table of every frame, or of those in ``frames`` (frame_id) alone."""

    rois = t.part.select(F.col("p_partkey").alias("frame_id"), F.lit(10).alias("x0"), F.lit(5).alias("y0"), F.lit(60).alias("x1"), F.lit(40).alias("y1"))
    if frames is None:
        return rounded(X.context_table(valued_pixels(t), circles(t), rois, AT, 120 * 60, winners=winner_circles(t)))
    # Only frames with pixels have a context. Each input is read at several places, so it is cut to them and written once,
    # in buckets by frame.
    drawn = unsized(bucketed(frames.join(rois.select("frame_id"), "frame_id", "left_semi")))
    pixels, rings = (unsized(bucketed(df.join(drawn, "frame_id", "left_semi"))) for df in (valued_pixels(t), circles(t)))
    regions = rois.join(drawn, "frame_id", "left_semi")
    return rounded(X.context_table(pixels, rings, regions, AT, 120 * 60, winners=winner_circles(t, rings)))


@query("E14_context_table", "WITH " + CONTEXT_SQL + " SELECT * FROM context")
def _(t):
    return context(t)


@query(
    "E15_soft_target",
    """SELECT frame_id, x, y, side, round(least(1, greatest(1 / (1 + exp(-greatest(-20, least(20, (x - y) / CAST(1.5 AS DOUBLE))))), CASE WHEN side = 'gt' THEN 0.85 ELSE 0 END)), 6)::DOUBLE AS target FROM fx_pixels""",
)
def _(t):
    target = X.soft_target(F.col("x") - F.col("y"), F.col("side") == "gt", 1.5)
    return t.fx_pixels.select("frame_id", "x", "y", "side", F.round(target, 6).alias("target"))
