"""Queries for summaries, sweeps, profiles and pixel metrics."""

from pyspark.sql import functions as F

from framegate.operators import metrics as M
from framegate.operators import pixels as P
from framegate.operators import thresholds as T
from framegate.plans.q_spatial import valued_pixels
from framegate.plans.registry import query
from framegate.runtime import stage


def rounded(df, places=6):
    return df.withColumns({c: F.round(c, places) for c, kind in df.dtypes if kind == "double"})


_LABEL_SQL = """CASE WHEN gt_pixels <= 0 THEN CASE WHEN pred_pixels <= 0 THEN 'true_negative' ELSE 'negative_false_positive' END
  WHEN iou >= 0.5 THEN 'success' WHEN pred_pixels <= 0 THEN 'positive_no_prediction' WHEN iou <= 0 THEN 'positive_zero_iou_wrong_prediction'
  ELSE 'positive_partial_miss' END"""


def gate_sql(rows, keys, group):
    return f"""SELECT {keys}, count(*) AS "count", count(*) FILTER (WHERE gt_pixels > 0) AS positive_count, count(*) FILTER (WHERE gt_pixels <= 0) AS negative_count,
  round(coalesce(avg(iou), 0), 6) AS mean_iou, round(coalesce(avg(dice), 0), 6) AS mean_dice,
  round(coalesce(avg(iou) FILTER (WHERE gt_pixels > 0), 0), 6) AS positive_mean_iou, round(coalesce(avg(dice) FILTER (WHERE gt_pixels > 0), 0), 6) AS positive_mean_dice,
  count(*) FILTER (WHERE gt_pixels > 0 AND iou <= 0) AS positive_zero_iou, count(*) FILTER (WHERE gt_pixels <= 0 AND pred_pixels <= 0) AS true_negative,
  count(*) FILTER (WHERE gt_pixels <= 0 AND pred_pixels > 0) AS negative_false_positive,
  round(coalesce(count(*) FILTER (WHERE gt_pixels <= 0 AND pred_pixels > 0) / CAST(nullif(count(*) FILTER (WHERE gt_pixels <= 0), 0) AS DOUBLE), 0), 6) AS negative_false_positive_rate
FROM {rows} GROUP BY {group}"""


GATE_SQL = gate_sql("fx_scored", "CASE WHEN grouping(split) = 1 THEN 'overall' ELSE split END AS scope", "ROLLUP (split)")


@query("A1_gate_summary", GATE_SQL)
def _(t):
    return rounded(M.gate_summary(t.fx_scored))


def labelled(t):
    label = M.failure_label(F.col("gt_pixels"), F.col("pred_pixels"), F.col("iou"))
    return t.fx_scored.withColumn("failure_type", label)


@query(
    "A2_count_maps",
    f"""WITH r AS (SELECT *, {_LABEL_SQL} AS f FROM fx_scored)
SELECT split, kind, "key", count(*) AS n FROM (SELECT split, 'failure' AS kind, f AS "key" FROM r UNION ALL SELECT split, 'source', winner_source FROM r
  UNION ALL SELECT split, 'fp_source', winner_source FROM r WHERE f = 'negative_false_positive'
  UNION ALL SELECT split, 'flag', 'fallback' FROM r WHERE via_fallback UNION ALL SELECT split, 'flag', 'rescue' FROM r WHERE via_rescue) GROUP BY split, kind, "key" """,
)
def _(t):
    flags = F.array_compact(
        F.array(F.when(F.col("via_fallback"), F.lit("fallback")), F.when(F.col("via_rescue"), F.lit("rescue")))
    )
    return M.count_entries(labelled(t), flags)


@query(
    "A3_flag_summary",
    """SELECT split, count(*) AS "count", round(avg(iou), 6) AS mean_iou, round(avg(dice), 6) AS mean_dice, count(*) FILTER (WHERE iou = 0) AS zero_iou,
  count(*) FILTER (WHERE via_fallback) AS via_fallback_count, count(*) FILTER (WHERE via_rescue) AS via_rescue_count FROM fx_scored GROUP BY split""",
)
def _(t):
    return rounded(M.flag_summary(t.fx_scored, ["via_fallback", "via_rescue"]))


@query(
    "A4_failure_labels",
    f"""WITH r AS (SELECT *, {_LABEL_SQL} AS gate, CASE WHEN gt_pixels <= 0 THEN CASE WHEN pred_pixels <= 0 THEN 'true_negative' ELSE 'negative_false_positive' END
  WHEN iou >= 0.5 THEN 'success' WHEN gt_pixels // 4 < 12 THEN 'candidate_generation_miss' WHEN id % 10 / CAST(10 AS DOUBLE) >= 0.5 THEN 'selector_or_reranker_miss' ELSE 'segmentation_miss' END AS diagnosis FROM fx_scored)
SELECT gate, diagnosis, count(*) AS n FROM r GROUP BY gate, diagnosis""",
)
def _(t):
    diagnosis = M.diagnostic_label(
        F.col("gt_pixels"), F.col("pred_pixels"), F.col("iou"), F.floor(F.col("gt_pixels") / 4), F.col("id") % 10 / 10.0
    )
    return labelled(t).groupBy(F.col("failure_type").alias("gate"), diagnosis.alias("diagnosis")).agg(F.count("*").alias("n"))


@query(
    "A5_mask_iou_dice",
    """WITH p AS (SELECT frame_id, x, y, max(CASE WHEN side = 'gt' THEN 1 ELSE 0 END) AS g, max(CASE WHEN side = 'pred' THEN 1 ELSE 0 END) AS p FROM fx_pixels GROUP BY ALL),
c AS (SELECT f.p_partkey AS frame_id, CAST(coalesce(sum(g), 0) AS BIGINT) AS gt_pixels, CAST(coalesce(sum(p), 0) AS BIGINT) AS pred_pixels, CAST(coalesce(sum(g * p), 0) AS BIGINT) AS i FROM part f LEFT JOIN p ON p.frame_id = f.p_partkey GROUP BY ALL)
SELECT frame_id, gt_pixels, pred_pixels, round(CASE WHEN gt_pixels + pred_pixels = i THEN 1 ELSE i / CAST(gt_pixels + pred_pixels - i AS DOUBLE) END, 6) AS gate_iou,
  round(CASE WHEN gt_pixels + pred_pixels = i THEN 0 ELSE i / CAST(gt_pixels + pred_pixels - i AS DOUBLE) END, 6) AS diagnostic_iou, round((2 * i + 1) / CAST(gt_pixels + pred_pixels + 1 AS DOUBLE), 6) AS dice FROM c""",
)
def _(t):
    frames = t.part.select(F.col("p_partkey").alias("frame_id"))
    counts = P.overlap_counts(t.fx_pixels, frames)
    args = [F.col(c) for c in ("gt_pixels", "pred_pixels", "inter_pixels")]
    return rounded(
        counts.select(
            "frame_id", "gt_pixels", "pred_pixels", P.iou(*args, 1.0).alias("gate_iou"),
            P.iou(*args, 0.0).alias("diagnostic_iou"), P.dice(*args).alias("dice"),
        )
    )


@query(
    "J14_mask_overlap",
    """SELECT g.frame_id, count(*) AS inter_pixels FROM (SELECT DISTINCT frame_id, x, y FROM fx_pixels WHERE side = 'gt') g
JOIN (SELECT DISTINCT frame_id, x, y FROM fx_pixels WHERE side = 'pred') p ON g.frame_id = p.frame_id AND g.x = p.x AND g.y = p.y GROUP BY g.frame_id""",
)
def _(t):
    return P.overlap_counts(t.fx_pixels).filter("inter_pixels > 0").select("frame_id", "inter_pixels")


SWEEP = [0.1, 0.25, 0.4, 0.55, 0.7]


def probability_pixels(t):
    """Predicted pixels with a probability, ground-truth pixels with probability zero when not predicted."""
    p = (F.col("x") * 7 + F.col("y") * 13 + F.col("frame_id")) % 256 / 255.0
    marked = t.fx_pixels.groupBy("frame_id", "x", "y").agg(
        F.bool_or(F.col("side") == "gt").alias("g"), F.bool_or(F.col("side") == "pred").alias("pred")
    )
    negative = F.col("frame_id") % 4 == 0
    return marked.select(
        "frame_id", "x", "y", F.when(F.col("pred"), p).otherwise(0.0).alias("p"), (F.col("g") & ~negative).alias("g")
    )


_PROB_SQL = """(SELECT frame_id, x, y, CASE WHEN bool_or(side = 'pred') THEN (x * 7 + y * 13 + frame_id) % 256 / CAST(255 AS DOUBLE) ELSE 0 END AS p,
  bool_or(side = 'gt') AND frame_id % 4 <> 0 AS g FROM fx_pixels GROUP BY frame_id, x, y)"""
_SWEEP_SQL = f"""px AS {_PROB_SQL}, th AS (SELECT CAST(unnest([0.1, 0.25, 0.4, 0.55, 0.7]) AS DOUBLE) AS threshold),
pc AS (SELECT threshold, count(*) FILTER (WHERE g AND p >= threshold) AS tp, count(*) FILTER (WHERE NOT g AND p >= threshold) AS fp, count(*) FILTER (WHERE g AND p < threshold) AS fn FROM px, th GROUP BY threshold),
nf AS (SELECT threshold, count(*) AS neg_frames, count(*) FILTER (WHERE mx >= threshold) AS neg_fp_frames FROM (SELECT frame_id, max(p) AS mx FROM px WHERE frame_id % 4 = 0 GROUP BY frame_id), th GROUP BY threshold),
sk AS (SELECT threshold, frame_id, x, y FROM px, th WHERE p >= threshold AND frame_id % 4 <> 0),
gs AS (SELECT frame_id, x, y FROM px WHERE g),
cl AS (SELECT th.threshold,
  (SELECT count(*) FROM sk s WHERE s.threshold = th.threshold AND EXISTS (SELECT 1 FROM gs WHERE gs.frame_id = s.frame_id AND abs(gs.x - s.x) <= 2 AND abs(gs.y - s.y) <= 2)) AS cl_tp,
  (SELECT count(*) FROM sk s WHERE s.threshold = th.threshold) AS n_sk,
  (SELECT count(*) FROM gs WHERE NOT EXISTS (SELECT 1 FROM sk s WHERE s.threshold = th.threshold AND s.frame_id = gs.frame_id AND abs(gs.x - s.x) <= 2 AND abs(gs.y - s.y) <= 2)) AS cl_fn FROM th),
m AS (SELECT pc.threshold, tp, fp, fn, neg_frames, neg_fp_frames, coalesce(tp / CAST(nullif(tp + fp, 0) AS DOUBLE), 0) AS pixel_precision, coalesce(tp / CAST(nullif(tp + fn, 0) AS DOUBLE), 0) AS pixel_recall,
  coalesce(cl_tp / CAST(nullif(n_sk, 0) AS DOUBLE), 0) AS cp, coalesce(cl_tp / CAST(nullif(cl_tp + cl_fn, 0) AS DOUBLE), 0) AS cr, neg_fp_frames / CAST(neg_frames AS DOUBLE) AS fp_per_frame FROM pc JOIN nf USING (threshold) JOIN cl USING (threshold)),
s AS (SELECT *, coalesce(2 * pixel_precision * pixel_recall / nullif(pixel_precision + pixel_recall, 0), 0) AS pixel_f1, coalesce(2 * cp * cr / nullif(cp + cr, 0), 0) AS centerline_f1 FROM m)"""


def sweep(t):
    px = probability_pixels(t)
    negative = F.col("frame_id") % 4 == 0
    frames = t.part.select(F.col("p_partkey").alias("frame_id")).withColumn("is_negative", negative)
    counts = P.threshold_counts(px, frames, SWEEP)
    # Here each pixel line is its own skeleton, at every threshold.
    lines = P.tolerance_threshold_counts(px.filter(~negative), 2, SWEEP)
    lines = lines.withColumnsRenamed({c: f"cl_{c}" for c in ("tp", "fp", "fn")})
    joined = counts.join(lines, "threshold", "left").fillna(0)
    p, r, f1 = M.precision_recall_f1(F.col("tp"), F.col("fp"), F.col("fn"))
    _, _, cf1 = M.precision_recall_f1(F.col("cl_tp"), F.col("cl_fp"), F.col("cl_fn"))
    return joined.select(
        "threshold", "tp", "fp", "fn", "neg_frames", "neg_fp_frames", p.alias("pixel_precision"), r.alias("pixel_recall"),
        f1.alias("pixel_f1"), cf1.alias("centerline_f1"),
        F.coalesce(F.try_divide("neg_fp_frames", "neg_frames"), F.lit(0.0)).alias("fp_per_frame"),
    )


@query(
    "A6_threshold_sweep",
    f"""WITH {_SWEEP_SQL} SELECT threshold, tp, fp, fn, neg_frames, neg_fp_frames, round(pixel_precision, 6) AS pixel_precision, round(pixel_recall, 6) AS pixel_recall,
  round(pixel_f1, 6) AS pixel_f1, round(centerline_f1, 6) AS centerline_f1, round(fp_per_frame, 6) AS fp_per_frame FROM s""",
)
def _(t):
    return rounded(sweep(t))


@query(
    "A7_best_threshold",
    f"""WITH {_SWEEP_SQL}, c AS (SELECT 'default' AS mode, threshold, 0.2 * pixel_precision + 0.25 * pixel_recall + 0.2 * pixel_f1 + 0.35 * centerline_f1 - 0.2 * fp_per_frame AS composite, centerline_f1, pixel_precision FROM s
  UNION ALL SELECT 'precision', threshold, 0.5 * pixel_precision + 0.3 * pixel_f1 + 0.2 * centerline_f1 - 0.2 * fp_per_frame, centerline_f1, pixel_precision FROM s
  UNION ALL SELECT 'centerline', threshold, 0.1 * pixel_precision + 0.2 * pixel_recall + 0.1 * pixel_f1 + 0.6 * centerline_f1 - 0.2 * fp_per_frame, centerline_f1, pixel_precision FROM s)
SELECT mode, threshold, round(composite, 6) AS composite_score FROM c QUALIFY row_number() OVER (PARTITION BY mode ORDER BY round(composite, 9) DESC, round(centerline_f1, 9) DESC, round(pixel_precision, 9) DESC, threshold) = 1""",
)
def _(t):
    swept = stage(sweep(t), "sweep")  # a row per threshold, read once per mode
    best = [M.best_threshold(swept, mode).select(F.lit(mode).alias("mode"), "threshold", "composite_score") for mode in M.COMPOSITE_WEIGHTS]
    return rounded(best[0].unionAll(best[1]).unionAll(best[2]))


_CUM_SQL = """h AS (SELECT threshold, sum(h) AS h, sum(m) AS m FROM (SELECT p AS threshold, count(*) FILTER (WHERE target = 1) AS h, count(*) FILTER (WHERE target <> 1) AS m FROM fx_probs GROUP BY p
  UNION ALL SELECT CAST(unnest([{constants}]) AS DOUBLE), 0, 0 {extra}) GROUP BY threshold),
c AS (SELECT threshold, CAST(sum(h) OVER (ORDER BY threshold DESC) AS BIGINT) AS hit, CAST(sum(m) OVER (ORDER BY threshold DESC) AS BIGINT) AS miss, CAST(sum(h) OVER () AS BIGINT) AS ht, CAST(sum(m) OVER () AS BIGINT) AS mt FROM h),
r AS (SELECT *, hit / CAST(greatest(1, ht) AS DOUBLE) AS nr, miss / CAST(greatest(1, mt) AS DOUBLE) AS pr, (hit + mt - miss) / CAST(ht + mt AS DOUBLE) AS acc FROM c)"""


def _cum(constants, extra=""):
    return _CUM_SQL.replace("{constants}", constants).replace("{extra}", extra)


@query(
    "A8_veto_threshold",
    f"""WITH {_cum('0.05, 0.1, 0.2, 0.3, 0.5, 0.7, 0.9')} SELECT threshold, hit, miss, round(nr - 2 * pr + 0.05 * acc, 9) AS selection_key FROM r
ORDER BY nr - 2 * pr + 0.05 * acc DESC, threshold LIMIT 1""",
)
def _(t):
    best = T.veto_threshold(t.fx_probs, "p", F.col("target") == 1)
    return best.select("threshold", "hit", "miss", F.round("selection_key", 9).alias("selection_key"))


@query(
    "A9_image_veto_threshold",
    f"""WITH {_cum('0.05, 0.1, 0.2, 0.3, 0.5, 0.7, 0.9, 0.95, 0.99', 'UNION ALL SELECT max(p) + CAST(1e-6 AS DOUBLE), 0, 0 FROM fx_probs')}
SELECT threshold, hit, miss, round(nr + CASE WHEN miss = 0 THEN 1 ELSE 0 END - 4 * pr + 0.02 * acc, 9) AS selection_key FROM r
ORDER BY round(nr + CASE WHEN miss = 0 THEN 1 ELSE 0 END - 4 * pr + 0.02 * acc, 12) DESC, threshold LIMIT 1""",
)
def _(t):
    best = T.image_veto_threshold(t.fx_probs, "p", F.col("target") == 1)
    return best.select("threshold", "hit", "miss", F.round("selection_key", 9).alias("selection_key"))


@query(
    "A10_arbiter_threshold",
    f"""WITH {_cum('0.5').replace("UNION ALL SELECT CAST(unnest([0.5]) AS DOUBLE), 0, 0", "")},
k AS (SELECT *, nr - 4 * pr + 0.25 * (hit / CAST(greatest(1, hit + miss) AS DOUBLE)) AS key, hit / CAST(greatest(1, hit + miss) AS DOUBLE) AS prec FROM r)
SELECT threshold, hit, miss, round(key, 9) AS selection_key, round(2 * prec * nr / greatest(prec + nr, 1e-6), 9) AS f1 FROM k ORDER BY key DESC, threshold DESC LIMIT 1""",
)
def _(t):
    best = T.arbiter_threshold(t.fx_probs, "p", F.col("target") == 1)
    return best.select("threshold", "hit", "miss", *[F.round(c, 9).alias(c) for c in ("selection_key", "f1")])


@query(
    "A11_zero_miss_thresholds",
    f"""WITH {_cum('0.33')} SELECT threshold, hit, round(nr, 9) AS neg_veto_rate FROM r WHERE miss = 0 ORDER BY hit DESC, threshold LIMIT 20""",
)
def _(t):
    rows = T.zero_miss_thresholds(t.fx_probs, "p", F.col("target") == 1, [0.33])
    return rows.select("threshold", "hit", F.round("neg_veto_rate", 9).alias("neg_veto_rate"))


@query(
    "A12_veto_confusion",
    """SELECT CASE grouping_id(winner_source, split) WHEN 1 THEN 'source' WHEN 2 THEN 'split' ELSE 'overall' END AS axis, coalesce(winner_source, split, 'all') AS "key", count(*) AS "count",
  count(*) FILTER (WHERE target = 1) AS target_veto_total, count(*) FILTER (WHERE target <> 1) AS keep_total, count(*) FILTER (WHERE p >= 0.4 AND target = 1) AS true_negative_veto,
  count(*) FILTER (WHERE p >= 0.4 AND target <> 1) AS false_positive_veto FROM fx_probs GROUP BY GROUPING SETS ((winner_source), (split), ())""",
)
def _(t):
    return T.veto_confusion(t.fx_probs, "p", F.col("target") == 1, 0.4)


def scored_with_probability(t):
    return t.fx_scored.withColumn("p", F.col("id") % 1000 / 1000.0)


_VETO_SQL = """(SELECT id, split, winner_source, th, gt_pixels, v, CASE WHEN v THEN 0 ELSE pred_pixels END AS pred_pixels,
  CASE WHEN v THEN CASE WHEN gt_pixels <= 0 THEN 1 ELSE 0 END ELSE iou END AS iou, CASE WHEN v THEN CASE WHEN gt_pixels <= 0 THEN 1 ELSE 1 / (gt_pixels + CAST(1 AS DOUBLE)) END ELSE dice END AS dice
  FROM (SELECT *, pred_pixels > 0 AND id % 1000 / CAST(1000 AS DOUBLE) >= th AS v FROM fx_scored, (SELECT CAST(unnest({ths}) AS DOUBLE) AS th)))"""
_SWEEP_VETO = _VETO_SQL.replace("{ths}", "[0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4, 0.45, 0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95]")


@query(
    "A13_veto_sweep",
    gate_sql(
        _SWEEP_VETO,
        """th AS threshold, CASE WHEN grouping(split) = 1 THEN 'overall' ELSE split END AS scope, count(*) FILTER (WHERE v) AS veto_count,
  count(*) FILTER (WHERE v AND gt_pixels > 0) AS vetoed_positive_count""",
        "GROUPING SETS ((th, split), (th))",
    ),
)
def _(t):
    return rounded(T.veto_sweep(scored_with_probability(t), "p"))


@query(
    "A13_apply_veto",
    f"""SELECT id, v AS vetoed, pred_pixels, round(iou, 6) AS iou, round(dice, 6) AS dice, {_LABEL_SQL} AS failure_type FROM {_VETO_SQL.replace("{ths}", "[0.4]")}""",
)
def _(t):
    rows = T.apply_veto(scored_with_probability(t), "p", 0.4)
    return rounded(rows.select("id", "vetoed", "pred_pixels", "iou", "dice", "failure_type"))


@query(
    "A14_feature_moments",
    """WITH v AS (SELECT vec_id, unnest(embedding) AS value, unnest(range(len(embedding))) AS pos FROM embeddings)
SELECT pos, round(avg(CAST(value AS DOUBLE)), 6) AS mean, round(CASE WHEN stddev_pop(CAST(value AS DOUBLE)) < 1e-6 THEN 1 ELSE stddev_pop(CAST(value AS DOUBLE)) END, 6) AS std FROM v GROUP BY pos""",
)
def _(t):
    return rounded(M.feature_moments(t.embeddings, "embedding")).withColumn("pos", F.col("pos").cast("bigint"))


@query(
    "A14_normalise",
    """WITH v AS (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS value, unnest(range(len(embedding))) AS pos FROM embeddings),
m AS (SELECT pos, avg(value) AS mean, CASE WHEN stddev_pop(value) < 1e-6 THEN 1 ELSE stddev_pop(value) END AS std FROM v GROUP BY pos)
SELECT vec_id, round(sum((value - mean) / std), 5) AS total FROM v JOIN m USING (pos) GROUP BY vec_id""",
)
def _(t):
    scaled = M.normalise(t.embeddings, "embedding", M.feature_moments(t.embeddings, "embedding"))
    total = F.aggregate("embedding", F.lit(0.0), lambda a, v: a + v)
    return scaled.select("vec_id", F.round(total, 5).alias("total"))


@query(
    "A15_class_weight",
    "SELECT round(greatest(1, count(*) FILTER (WHERE target < 0.5) / CAST(greatest(1, count(*) FILTER (WHERE target >= 0.5)) AS DOUBLE)), 9) AS weight FROM fx_probs",
)
def _(t):
    return t.fx_probs.agg(F.round(M.class_weight(F.col("target")), 9).alias("weight"))


@query(
    "A16_dataset_profile",
    """WITH c AS (SELECT 'source' AS kind, source AS "key" FROM fx_annotations UNION ALL
  SELECT 'size', CASE WHEN major_len < 12 THEN '<12' WHEN major_len < 20 THEN '<20' WHEN major_len < 55 THEN '<55' ELSE '>=55' END FROM fx_annotations
  UNION ALL SELECT 'refined', CASE WHEN refined THEN 'refined' ELSE 'not_refined' END FROM fx_annotations)
SELECT kind, "key", CAST(count(*) AS DOUBLE) AS n FROM c GROUP BY kind, "key"
UNION ALL SELECT 'quantile', 'p10', round(quantile_cont(major_len, 0.1), 6) FROM fx_annotations UNION ALL SELECT 'quantile', 'p50', round(quantile_cont(major_len, 0.5), 6) FROM fx_annotations
UNION ALL SELECT 'quantile', 'p90', round(quantile_cont(major_len, 0.9), 6) FROM fx_annotations""",
)
def _(t):
    counts = M.dataset_profile(t.fx_annotations, (12, 20, 55)).withColumn("n", F.col("n").cast("double"))
    wide = M.length_quantiles(t.fx_annotations, "major_len")
    long = wide.select(F.expr("stack(3, 'p10', p10, 'p50', p50, 'p90', p90) AS (key, n)")).select(
        F.lit("quantile").alias("kind"), "key", F.round("n", 6).alias("n")
    )
    return counts.unionByName(long)


_GEO_SQL = """(SELECT frame_id, side, count(*) AS area, min(x) AS min_x, min(y) AS min_y, max(x) AS max_x, max(y) AS max_y, avg(x) AS cx, avg(y) AS cy,
  coalesce(var_samp(x), 0) AS vx, coalesce(var_samp(y), 0) AS vy, coalesce(covar_samp(x, y), 0) AS cv FROM fx_pixels GROUP BY frame_id, side)"""


@query(
    "A17_mask_geometry",
    f"""SELECT frame_id, side, area, max_x - min_x + 1 AS bbox_w, max_y - min_y + 1 AS bbox_h, round(cx, 6) AS cx, round(cy, 6) AS cy,
  round(CASE WHEN area <= 1 THEN greatest(max_x - min_x + 1, max_y - min_y + 1) ELSE 4 * sqrt((vx + vy) / 2 + sqrt((vx - vy) * (vx - vy) / 4 + cv * cv)) END, 5) AS major_len FROM {_GEO_SQL}""",
)
def _(t):
    geometry = P.mask_geometry(t.fx_pixels, ["frame_id", "side"])
    return geometry.select(
        "frame_id", "side", "area", "bbox_w", "bbox_h", F.round("cx", 6).alias("cx"), F.round("cy", 6).alias("cy"),
        F.round("major_len", 5).alias("major_len"),
    )


@query(
    "A18_fit_lines",
    """SELECT frame_id, count(*) AS points, round(avg(x), 6) AS x0, round(avg(y), 6) AS y0, round(0.5 * atan2(2 * covar_pop(x, y), var_pop(x) - var_pop(y)), 6) AS angle
FROM fx_pixels WHERE side = 'gt' GROUP BY frame_id HAVING count(*) >= 20""",
)
def _(t):
    lines = P.fit_lines(t.fx_pixels.filter("side = 'gt'"), ["frame_id"], 20)
    return rounded(lines.select("frame_id", "points", "x0", "y0", F.atan2("vy", "vx").alias("angle")))


@query(
    "A19_segment_agreement",
    """WITH s AS (SELECT p_partkey AS frame_id, p_partkey % 50 AS ax, p_partkey % 30 AS ay, p_partkey % 50 + p_size * (p_partkey % 3) AS bx, p_partkey % 30 + p_size * (p_partkey % 2) AS by_ FROM part),
d AS (SELECT px.frame_id, x, y, sqrt(CAST((bx - ax) * (bx - ax) + (by_ - ay) * (by_ - ay) AS DOUBLE)) AS len, atan2(CAST(by_ - ay AS DOUBLE), CAST(bx - ax AS DOUBLE)) AS theta, x - ax AS rx, y - ay AS ry, bx - ax AS dx, by_ - ay AS dy
  FROM fx_pixels px JOIN s ON s.frame_id = px.frame_id WHERE side = 'gt'),
t AS (SELECT *, (rx * dx + ry * dy) / nullif(len, 0) AS t, abs(ry * dx - rx * dy) / nullif(len, 0) AS n FROM d),
a AS (SELECT frame_id, count(*) AS pixels, max(len) AS len, max(theta) AS theta, min(t) AS t0, max(t) AS t1, avg(CASE WHEN round(n, 9) <= 2 AND round(t, 9) >= -3 AND round(t, 9) <= round(len + 3, 9) THEN 1.0 ELSE 0.0 END) AS corr,
  0.5 * atan2(2 * covar_pop(x, y), var_pop(x) - var_pop(y)) AS ax FROM t GROUP BY frame_id),
b AS (SELECT *, pixels >= 8 AND len >= 1e-3 AS ok, ax - theta + pi() / 2 AS raw FROM a)
SELECT frame_id, pixels, CASE WHEN ok THEN round(degrees(abs(raw - pi() * floor(raw / pi()) - pi() / 2)), 4) END AS angle_deg, CASE WHEN ok THEN round((t1 - t0) / len, 6) END AS span_ratio,
  CASE WHEN ok THEN round(corr, 6) END AS corridor_ratio, CASE WHEN ok THEN round((greatest(0, -t0) + greatest(0, t1 - len)) / len, 6) END AS overshoot_ratio FROM b""",
)
def _(t):
    k, size = F.col("p_partkey"), F.col("p_size")
    segments = t.part.select(
        k.alias("frame_id"), (k % 50).alias("ax"), (k % 30).alias("ay"), (k % 50 + size * (k % 3)).alias("bx"),
        (k % 30 + size * (k % 2)).alias("by"),
    )
    rows = P.segment_agreement(t.fx_pixels.filter("side = 'gt'"), segments, ["frame_id"], 2.0, 3.0)
    return rounded(rows.withColumn("angle_deg", F.round("angle_deg", 4)))


@query(
    "A20_candidate_mask_features",
    f"""WITH b AS (SELECT p_partkey AS frame_id, p_partkey % 50 + 5 AS bx, p_partkey % 30 + 2 AS by_, CAST(4 + p_size % 7 AS BIGINT) AS r, CAST(p_size AS DOUBLE) AS sl, p_size % 3 AS br, 1 + p_size % 2 AS co FROM part),
k AS (SELECT unnest([{{'kx': 0, 'ky': -2}}, {{'kx': 0, 'ky': 2}}], recursive := true) UNION ALL SELECT kx, ky FROM range(-2, 3) a(kx), range(-1, 2) b(ky)),
rs AS (SELECT DISTINCT r FROM b),
grid AS (SELECT r, x, y FROM rs, range(-14, 15) a(x), range(-14, 15) b(y)),
disc AS (SELECT * FROM grid WHERE x * x + y * y <= r * r),
dil AS (SELECT DISTINCT d.r, d.x + k.kx AS x, d.y + k.ky AS y FROM disc d, k),
ero AS (SELECT d.r, d.x, d.y FROM disc d, k WHERE (d.x + k.kx) * (d.x + k.kx) + (d.y + k.ky) * (d.y + k.ky) <= d.r * d.r GROUP BY ALL HAVING count(*) = (SELECT count(*) FROM k)),
band AS (SELECT * FROM dil EXCEPT SELECT * FROM ero),
bn AS (SELECT r, count(*) AS nb FROM band GROUP BY r), cn AS (SELECT r, count(*) AS nc FROM disc WHERE x * x + y * y <= pow(greatest(2, CAST(round_even(r * CAST(0.35 AS DOUBLE), 0) AS BIGINT)), 2) GROUP BY r),
five AS (SELECT DISTINCT d.r, d.x + a.dx AS x, d.y + c.dy AS y FROM disc d, range(-2, 3) a(dx), range(-2, 3) c(dy)),
px AS (SELECT b.*, x - bx AS dx, y - by_ AS dy FROM fx_pixels p JOIN b ON p.frame_id = b.frame_id WHERE side = 'pred'),
f AS (SELECT px.frame_id, any_value(px.r) AS r, any_value(sl) AS sl, any_value(br) AS br, any_value(co) AS co, count(*) AS area, count(*) FILTER (WHERE px.dx * px.dx + px.dy * px.dy <= px.r * px.r) AS inb, count(band.x) AS inbd,
  count(*) FILTER (WHERE px.dx * px.dx + px.dy * px.dy <= pow(greatest(2, CAST(round_even(px.r * CAST(0.35 AS DOUBLE), 0) AS BIGINT)), 2)) AS inc, max(CASE WHEN five.x IS NULL THEN 0 ELSE 1 END) AS conn, sqrt(max(CAST(px.dx * px.dx + px.dy * px.dy AS DOUBLE))) AS reach
  FROM px LEFT JOIN band ON band.r = px.r AND band.x = px.dx AND band.y = px.dy LEFT JOIN five ON five.r = px.r AND five.x = px.dx AND five.y = px.dy GROUP BY px.frame_id),
g AS (SELECT frame_id, greatest(1e-6, (vx + vy) / 2 + sqrt((vx - vy) * (vx - vy) / 4 + cv * cv)) AS mj, greatest(1e-6, (vx + vy) / 2 - sqrt((vx - vy) * (vx - vy) / 4 + cv * cv)) AS mn FROM {_GEO_SQL} WHERE side = 'pred'),
w AS (SELECT f.*, mj, mn, area / greatest(sl, 1) AS aw, sl / greatest(area / greatest(sl, 1), 1e-6) AS lw FROM f JOIN g USING (frame_id))
SELECT w.frame_id, round(aw, 6) AS average_width, round(least(1, greatest(0, (6 - aw) / 6)), 6) AS thinness, round(least(1, greatest(lw / 25, CASE WHEN area < 3 THEN 0 ELSE mj / mn / 20 END)), 4) AS line_likeness,
  round(sl / greatest(sl + br * 6 + greatest(co - 1, 0) * 10, 1), 6) AS continuity, round(inbd / CAST(nb AS DOUBLE), 6) AS ball_boundary_touch, round(inc / CAST(nc AS DOUBLE), 6) AS ball_core_overlap,
  round(inb / CAST(area AS DOUBLE), 6) AS ball_fill_fraction, CAST(conn AS DOUBLE) AS connected_to_ball, round(least(1, greatest(0, (reach - w.r) / 120)), 6) AS outward_extension,
  round(greatest(0, 1 - sl / 18), 6) AS shortness_penalty FROM w JOIN bn ON bn.r = w.r JOIN cn ON cn.r = w.r""",
)
def _(t):
    k, size = F.col("p_partkey"), F.col("p_size")
    balls = t.part.select(
        k.alias("frame_id"), (k % 50 + 5).alias("cx"), (k % 30 + 2).alias("cy"), (size % 7 + 4).cast("bigint").alias("radius")
    )
    skeleton = t.part.select(
        k.alias("frame_id"), size.alias("skeleton_length"), (size % 3).alias("branch_count"), (size % 2 + 1).alias("component_count")
    )
    rows = P.candidate_mask_features(t.fx_pixels.filter("side = 'pred'"), skeleton, balls, 120, 80)
    return rounded(
        rows.select(
            "frame_id", "average_width", "thinness", F.round("line_likeness", 4).alias("line_likeness"), "continuity",
            "ball_boundary_touch", "ball_core_overlap", "ball_fill_fraction", "connected_to_ball", "outward_extension", "shortness_penalty",
        )
    )


@query(
    "A22_merge_tiles",
    """WITH t AS (SELECT frame_id, side AS variant, (x // 16) * 16 AS tx, x, y, (x * 7 + y * 13) % 100 / CAST(100 AS DOUBLE) AS p FROM fx_pixels
  UNION ALL SELECT frame_id, side, (x // 16) * 16, x, y, (x * 3 + y) % 100 / CAST(100 AS DOUBLE) FROM fx_pixels WHERE x % 16 < 4),
m AS (SELECT frame_id, variant, x, y, avg(p) AS p FROM t GROUP BY ALL)
SELECT frame_id, x, y, round(avg(p), 6) AS p FROM m GROUP BY frame_id, x, y""",
)
def _(t):
    x, y = F.col("x"), F.col("y")
    tile = F.floor(x / 16) * 16

    def tiles(rows, tile_x, p):
        return rows.select(
            "frame_id", F.col("side").alias("variant"), tile_x.alias("tile_x"), F.lit(0).alias("tile_y"),
            (x - tile_x).alias("x"), "y", p.alias("p"),
        )

    first = tiles(t.fx_pixels, tile, (x * 7 + y * 13) % 100 / 100.0)
    second = tiles(t.fx_pixels.filter("x % 16 < 4"), tile - 12, (x * 3 + y) % 100 / 100.0)
    return rounded(P.merge_tiles(first.unionByName(second)))


@query(
    "A23_loss_table",
    f"""WITH px AS (SELECT frame_id, p, CASE WHEN g THEN 1.0 ELSE 0.0 END AS g, least(greatest(p, CAST(1e-5 AS DOUBLE)), 1 - CAST(1e-5 AS DOUBLE)) AS c FROM {_PROB_SQL}),
l AS (SELECT frame_id, avg(-(g * ln(c) + (1 - g) * ln(1 - c))) AS bce, 1 - (2 * sum(p * g) + CAST(1e-6 AS DOUBLE)) / (sum(p + g) + CAST(1e-6 AS DOUBLE)) AS dice_loss FROM px GROUP BY frame_id)
SELECT frame_id, round(bce, 6) AS bce, round(dice_loss, 6) AS dice_loss, round(bce + dice_loss, 6) AS loss FROM l""",
)
def _(t):
    return rounded(P.loss_table(probability_pixels(t)))


@query(
    "A24_run_statistics",
    """SELECT event_type AS run, CAST(sum(1) AS BIGINT) AS images, CAST(sum(user_id % 9) AS BIGINT) AS tiles, round(count(*) / greatest(1e-6, sum(value / 100)), 6) AS images_per_sec,
  round(sum(user_id % 9) / greatest(1e-6, sum(value / 100)), 6) AS tiles_per_sec, round(avg(user_id % 7), 6) AS avg_tile_batch, max(user_id % 7) AS max_tile_batch,
  round(avg(value), 6) AS avg_queue_wait_ms, round(avg(value * 2), 6) AS avg_forward_ms FROM events GROUP BY event_type""",
)
def _(t):
    log = t.events.select(
        F.col("event_type").alias("run"), F.lit(1).alias("images"), (F.col("user_id") % 9).alias("tiles"), (F.col("user_id") % 7).alias("batch"),
        F.col("value").alias("wait_ms"), (F.col("value") * 2).alias("forward_ms"), (F.col("value") / 100).alias("elapsed_s"),
    )
    return rounded(M.run_statistics(log, "run"))


@query(
    "A26_dataset_fingerprint",
    """WITH r AS (SELECT source AS root, count(*) AS n, sum(n_chars) AS b, max(doc_id) AS m FROM documents GROUP BY source)
SELECT sha256(string_agg(root || '|' || n || '|' || b || '|' || m, chr(10) ORDER BY root || '|' || n || '|' || b || '|' || m) || chr(10) || 'size=448') AS fingerprint, count(*) AS roots FROM r""",
)
def _(t):
    files = t.documents.select(F.col("source").alias("root"), F.col("n_chars").alias("size"), F.col("doc_id").alias("mtime"))
    return M.dataset_fingerprint(files, "size=448")


@query(
    "A27_numeric_difference",
    """WITH v AS (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS e FROM embeddings), i AS (SELECT vec_id, max(abs(e - e * 0.5)) AS mx, avg(abs(e - e * 0.5)) AS mn FROM v GROUP BY vec_id)
SELECT count(*) AS items, round(max(mx), 6) AS max_abs_diff, round(avg(mn), 6) AS mean_abs_diff FROM i""",
)
def _(t):
    left = t.embeddings.select("vec_id", "embedding")
    right = left.withColumn("embedding", F.transform("embedding", lambda v: v.cast("double") * 0.5))
    return rounded(M.numeric_difference(left, right, "vec_id", "embedding"))


@query(
    "A28_missing_inputs",
    """SELECT missing, count(*) AS n FROM (SELECT CASE WHEN id % 7 = 0 THEN 'image' WHEN id % 5 = 0 THEN 'report' WHEN mask_area = 0 THEN 'mask' END AS missing FROM fx_annotations) WHERE missing IS NOT NULL GROUP BY missing""",
)
def _(t):
    present = {"image": F.col("id") % 7 != 0, "report": F.col("id") % 5 != 0, "mask": F.col("mask_area") > 0}
    return M.missing_inputs(t.fx_annotations, present)


@query("A29_validity_accuracy", "SELECT split, round(avg(CASE WHEN (p >= 0.5) = (target >= 0.5) THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM fx_probs GROUP BY split")
def _(t):
    return t.fx_probs.groupBy("split").agg(F.round(M.validity_accuracy(F.col("target"), F.col("p")), 6).alias("accuracy"))


@query(
    "A30_promotion_gate",
    f"""WITH b AS (SELECT * FROM ({GATE_SQL})), c AS (SELECT * FROM ({gate_sql("(SELECT id, split, gt_pixels, CASE WHEN id % 9 = 0 THEN 0 ELSE pred_pixels END AS pred_pixels, CASE WHEN id % 9 = 0 THEN CASE WHEN gt_pixels = 0 THEN 1 ELSE 0 END ELSE iou END AS iou, CASE WHEN id % 9 = 0 THEN 1 / CAST(gt_pixels + 1 AS DOUBLE) ELSE dice END AS dice FROM fx_scored)", "CASE WHEN grouping(split) = 1 THEN 'overall' ELSE split END AS scope", "ROLLUP (split)")})),
j AS (SELECT b.scope, c.mean_dice >= b.mean_dice AS dice_ok, c.positive_zero_iou <= b.positive_zero_iou AS zero_iou_ok, CASE WHEN b.scope = 'overall' THEN c.negative_false_positive <= 5000 WHEN b.scope = '2-HIGH' THEN c.negative_false_positive <= 3 ELSE true END AS fp_ok FROM b JOIN c USING (scope))
SELECT scope, dice_ok, zero_iou_ok, fp_ok, dice_ok AND zero_iou_ok AND fp_ok AS promote FROM j
UNION ALL SELECT 'overall_decision', bool_and(dice_ok), bool_and(zero_iou_ok), bool_and(fp_ok), bool_and(dice_ok AND zero_iou_ok AND fp_ok) FROM j""",
)
def _(t):
    hit, gt = F.col("id") % 9 == 0, F.col("gt_pixels")
    changed = t.fx_scored.withColumns(
        {
            "pred_pixels": F.when(hit, 0).otherwise(F.col("pred_pixels")),
            "iou": F.when(hit, F.when(gt == 0, 1.0).otherwise(0.0)).otherwise(F.col("iou")),
            "dice": F.when(hit, 1.0 / (gt + 1.0)).otherwise(F.col("dice")),
        }
    )
    return M.promotion_gate(M.gate_summary(t.fx_scored), M.gate_summary(changed), {"overall": 5000, "2-HIGH": 3})


@query(
    "A31_frame_difference",
    """WITH g AS (SELECT DISTINCT frame_id, x, y, (x * 7 + y * 13 + frame_id * frame_id) % 256 AS gray FROM fx_pixels)
SELECT a.frame_id AS frame_index, round(avg(abs(a.gray - b.gray)) / 255, 6) AS diff_score FROM g a JOIN g b ON b.frame_id = a.frame_id - 1 AND a.x = b.x AND a.y = b.y GROUP BY a.frame_id""",
)
def _(t):
    gray = (F.col("x") * 7 + F.col("y") * 13 + F.col("frame_id") * F.col("frame_id")) % 256
    pixels = t.fx_pixels.select("frame_id", "x", "y").distinct().select(
        F.lit(0).alias("video"), F.col("frame_id").alias("frame_index"), "x", "y", gray.alias("gray")
    )
    return rounded(P.frame_difference(pixels, "video").drop("video"))


_VSC_SQL = """(SELECT DISTINCT frame_id, x, y, (x * 7 + y * 13 + frame_id) % 256 AS v, (x * 11 + y * 3) % 256 AS s, (x * 5 + y * 17) % 256 AS c FROM fx_pixels)"""


@query(
    "A33_adaptive_selection",
    f"""WITH px AS {_VSC_SQL}, q AS (SELECT frame_id, count(*) AS n, quantile_cont(v, 0.58) AS v0, quantile_cont(v, 0.7) AS v1, quantile_cont(s, 0.45) AS s0, quantile_cont(s, 0.62) AS s1, quantile_cont(c, 0.65) AS c0, quantile_cont(c, 0.8) AS c1 FROM px GROUP BY frame_id),
b AS (SELECT frame_id, n, greatest(145, v0) AS v0, greatest(138, v1) AS v1, least(125, greatest(10, s0)) AS s0, least(145, s1 + 18) AS s1, least(70, greatest(10, c0)) AS c0, least(90, c1 + 18) AS c1 FROM q),
m AS (SELECT px.frame_id, n, v >= v0 AND s <= s0 AND c <= c0 AS st, v >= v1 AND s <= s1 AND c <= c1 AS lo, v >= greatest(90, v0 - 40) AND s <= least(255, s0 + 50) AND c <= least(140, c0 + 38) AS rel FROM px JOIN b USING (frame_id)),
k AS (SELECT frame_id, count(*) FILTER (WHERE st) < greatest(2, CAST(round_even(max(n) * CAST(0.003 AS DOUBLE), 0) AS BIGINT)) AS used_fallback, count(*) FILTER (WHERE st) AS ns, count(*) FILTER (WHERE lo) AS nl, count(*) FILTER (WHERE rel) AS n_relaxed FROM m GROUP BY frame_id)
SELECT frame_id, used_fallback, CASE WHEN used_fallback THEN nl ELSE ns END AS n_selected, n_relaxed FROM k""",
)
def _(t):
    pixels = valued_pixels(t).select("frame_id", "x", "y", F.col("gray").alias("v"), F.col("saturation").alias("s"), F.col("third").alias("c"))
    return P.adaptive_selection(pixels, 2).groupBy("frame_id", "used_fallback").agg(
        F.count_if("selected").alias("n_selected"), F.count_if("relaxed").alias("n_relaxed")
    )


@query(
    "A34_dominant_colour",
    f"""WITH px AS (SELECT *, x BETWEEN round_even(100 * CAST(0.28 AS DOUBLE), 0) AND round_even(100 * CAST(0.72 AS DOUBLE), 0) - 1 AND y BETWEEN round_even(60 * CAST(0.28 AS DOUBLE), 0) AND round_even(60 * CAST(0.72 AS DOUBLE), 0) - 1 AS ins FROM {_VSC_SQL}),
m AS (SELECT frame_id, median(v) AS mv, median(s) AS ms, median(c) AS mc FROM px WHERE ins GROUP BY frame_id),
d AS (SELECT px.frame_id, ins, sqrt((v - mv) * (v - mv) + (s - ms) * (s - ms) + (c - mc) * (c - mc)) AS dist FROM px JOIN m USING (frame_id)),
l AS (SELECT frame_id, greatest(14, quantile_cont(dist, 0.8) * 1.35 + 6) AS lim FROM d WHERE ins GROUP BY frame_id)
SELECT d.frame_id, count(*) FILTER (WHERE dist <= lim) AS n_table, count(*) FILTER (WHERE dist > 18) AS n_foreground FROM d JOIN l USING (frame_id) GROUP BY d.frame_id""",
)
def _(t):
    pixels = valued_pixels(t).select("frame_id", "x", "y", F.col("gray").alias("a"), F.col("saturation").alias("b"), F.col("third").alias("c"))
    sizes = t.part.select(F.col("p_partkey").alias("frame_id"), F.lit(100).alias("width"), F.lit(60).alias("height"))
    return P.dominant_colour_mask(pixels, sizes).groupBy("frame_id").agg(
        F.count_if("is_table").alias("n_table"), F.count_if("is_foreground").alias("n_foreground")
    )


@query(
    "A35_shell_ratio",
    """WITH m AS (SELECT frame_id, x, y FROM fx_pixels WHERE side = 'gt'), s AS (SELECT DISTINCT m.frame_id, m.x + a.dx AS x, m.y + b.dy AS y FROM m, range(-1, 2) a(dx), range(-1, 2) b(dy)),
r AS (SELECT s.* FROM s WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.frame_id = s.frame_id AND m.x = s.x AND m.y = s.y)),
g AS (SELECT DISTINCT frame_id, x, y, (x * 7 + y * 13 + frame_id) % 256 AS gray FROM fx_pixels),
q AS (SELECT r.frame_id, avg(CASE WHEN gray <= 100 THEN 1.0 ELSE 0.0 END) AS sr FROM r JOIN g ON g.frame_id = r.frame_id AND g.x = r.x AND g.y = r.y GROUP BY r.frame_id)
SELECT f.frame_id, round(coalesce(sr, 0), 6) AS shell_ratio FROM (SELECT DISTINCT frame_id FROM m) f LEFT JOIN q ON q.frame_id = f.frame_id""",
)
def _(t):
    mask = t.fx_pixels.filter("side = 'gt'").select("frame_id", "x", "y")
    return rounded(P.shell_ratio(mask, valued_pixels(t).select("frame_id", "x", "y", "gray"), 100))
