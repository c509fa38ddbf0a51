"""Queries for filters, gates and rule predicates."""

from pyspark.sql import functions as F

from framegate.functions import rules as R
from framegate.operators import filters as X
from framegate.operators.pixels import mask_shape
from framegate.plans.common import ITEM_FIELDS, item
from framegate.plans.registry import query

KEYS = ["frame_id", "pos", "l_partkey", "l_suppkey"]


@query(
    "F1_validate_annotations",
    """SELECT reason, count(*) AS n FROM (SELECT CASE
  WHEN lower(trim(dataset_split)) NOT IN ('main', 'quarantine') THEN 'split'
  WHEN id % 17 = 0 THEN 'missing' WHEN mask_area <= 0 THEN 'badmask' ELSE 'kept' END AS reason FROM fx_annotations)
GROUP BY reason""",
)
def _(t):
    checked = X.validate_annotations(
        t.fx_annotations, ["main", "quarantine"], "id", F.col("mask_area"), F.col("id") % 17 != 0
    )
    return X.reject_counts(checked)


@query("F2_exclude_ids", "SELECT id, source FROM fx_annotations WHERE id NOT IN (SELECT doc_id FROM labels)")
def _(t):
    return X.exclude_ids(t.fx_annotations, t.labels.withColumnRenamed("doc_id", "id"), "id").select("id", "source")


@query(
    "F3_harvest_records",
    "SELECT id, created_at FROM fx_annotations WHERE id % 5 = 0 OR created_at LIKE '2026-04%'",
)
def _(t):
    path = F.when(F.col("id") % 5 == 0, F.concat(F.lit("d/video_infer_harvest/"), F.col("source")))
    return X.harvest_records(t.fx_annotations.withColumn("path", path), "path", "created_at").select("id", "created_at")


@query(
    "F4_keep_kinds",
    """SELECT CAST(id AS VARCHAR) AS id, CASE id % 4 WHEN 0 THEN 'view_positive' ELSE 'candidate_positive' END AS kind
FROM fx_annotations WHERE id % 4 IN (0, 1) AND id % 3 <> 0""",
)
def _(t):
    kinds = F.element_at(
        F.array(*[F.lit(k) for k in ("view_positive", "candidate_positive", "context_positive", "image_negative")]),
        (F.col("id") % 4 + 1).cast("int"),
    )
    key = F.when(F.col("id") % 3 == 0, F.concat(F.lit("neg::"), F.col("id"))).otherwise(F.col("id").cast("string"))
    rows = t.fx_annotations.select(kinds.alias("kind"), key.alias("id"))
    return X.keep_kinds(rows, X.POSITIVE_KINDS).select("id", "kind")


@query(
    "F5_focus_rows",
    """SELECT id, split FROM fx_eval WHERE winner_source IN ('table_hough', 'white_blob') AND (pred_pixels > 0 OR gt_pixels <= 0)""",
)
def _(t):
    return X.focus_rows(t.fx_eval, ["table_hough", "white_blob"], True).select("id", "split")


@query(
    "F6_residuals",
    """SELECT id, round(iou, 9) AS iou FROM fx_scored WHERE iou <= 0.35
UNION ALL SELECT -1 - id, round(iou, 9) FROM (SELECT id, iou FROM fx_scored WHERE iou <= 0.2 ORDER BY id LIMIT 40)""",
)
def _(t):
    rows = X.residuals(t.fx_scored, 0.35, ["id"])
    first = X.residuals(t.fx_scored, 0.2, ["id"], 40).withColumn("id", -1 - F.col("id"))
    return rows.unionByName(first).select("id", F.round("iou", 9).alias("iou"))


@query(
    "F7_detection_predicate",
    """SELECT frame_id, pos, l_partkey, l_suppkey, score >= 0.1 AND pred_pixels >= 12 AS detected FROM fx_candidates""",
)
def _(t):
    return t.fx_candidates.select(*KEYS, X.is_detected(F.col("score"), F.col("pred_pixels"), 0.1, 12).alias("detected"))


@query(
    "F8_shape_gate",
    """WITH a AS (SELECT frame_id, side, count(*) AS area, max(x) - min(x) + 1 AS bw, max(y) - min(y) + 1 AS bh,
  count(*) FILTER (WHERE x IN (0, 99) OR y IN (0, 99)) AS touched FROM fx_pixels GROUP BY frame_id, side)
SELECT frame_id, side, area FROM a WHERE area >= 8 AND greatest(bw / CAST(bh AS DOUBLE), bh / CAST(bw AS DOUBLE)) >= 1.6
  AND area / CAST(bw * bh AS DOUBLE) <= 0.6 AND touched / CAST(area AS DOUBLE) <= 0.03
  AND (frame_id % 5 = 0 OR frame_id % 100 / CAST(100 AS DOUBLE) >= 0.25)""",
)
def _(t):
    masks = mask_shape(t.fx_pixels, ["frame_id", "side"], 100, 100)
    score = F.when(F.col("frame_id") % 5 != 0, F.col("frame_id") % 100 / 100.0)
    gated = X.shape_gate(masks.withColumn("score", score), 8, 1.6, 0.6, 0.03, 0.25)
    return gated.select("frame_id", "side", "area")


def _quality_checks():
    """Ordered checks of a candidate row; the limits tighten for short (tiny) rows."""
    tiny = F.col("pos") <= 2
    return [
        (F.col("pred_pixels") > 1, "empty_mask"),
        (F.col("candidate_iou") <= X.stricter(tiny, 0.9, 0.7, True), "high_fill"),
        (F.col("candidate_score") >= X.stricter(tiny, 0.1, 0.2, False), "low_white"),
        (F.col("score").between(-0.9, 0.8), "angle_mismatch"),
        (F.col("cx") <= X.stricter(tiny, 600.0, 500.0, True), "overshoot"),
    ]


_QUALITY_SQL = """(SELECT *, CASE WHEN NOT pred_pixels > 1 THEN 'empty_mask'
  WHEN NOT candidate_iou <= CASE WHEN pos <= 2 THEN CAST(0.7 AS DOUBLE) ELSE CAST(0.9 AS DOUBLE) END THEN 'high_fill'
  WHEN NOT candidate_score >= CASE WHEN pos <= 2 THEN CAST(0.2 AS DOUBLE) ELSE CAST(0.1 AS DOUBLE) END THEN 'low_white'
  WHEN NOT score BETWEEN CAST(-0.9 AS DOUBLE) AND CAST(0.8 AS DOUBLE) THEN 'angle_mismatch'
  WHEN NOT cx <= CASE WHEN pos <= 2 THEN 500 ELSE 600 END THEN 'overshoot' END AS reason FROM fx_candidates)"""


@query(
    "F9_quality_gate",
    f"""SELECT frame_id, pos, l_partkey, l_suppkey, reason IS NULL AS accepted, coalesce(reason, 'ok') AS reason FROM {_QUALITY_SQL}""",
)
def _(t):
    reason = X.first_reason(_quality_checks())
    return t.fx_candidates.select(
        *KEYS, reason.isNull().alias("accepted"), F.coalesce(reason, F.lit("ok")).alias("reason")
    )


@query(
    "F10_gate_with_dominant_reason",
    f"""WITH c AS {_QUALITY_SQL},
best AS (SELECT * FROM c WHERE reason IS NULL QUALIFY row_number() OVER (PARTITION BY frame_id ORDER BY score DESC, pos, l_partkey, l_suppkey) = 1),
dom AS (SELECT frame_id, reason FROM (SELECT frame_id, reason, count(*) AS n, min(pos * 100000000000 + l_partkey * 100000 + l_suppkey) AS seen
  FROM c WHERE reason IS NOT NULL GROUP BY frame_id, reason)
  QUALIFY row_number() OVER (PARTITION BY frame_id ORDER BY n DESC, seen) = 1)
SELECT f.frame_id, b.candidate_id, b.frame_id IS NOT NULL AS accepted,
  CASE WHEN b.frame_id IS NOT NULL THEN 'ok' ELSE dom.reason END AS outcome
FROM (SELECT DISTINCT frame_id FROM c) f LEFT JOIN best b ON f.frame_id = b.frame_id LEFT JOIN dom ON f.frame_id = dom.frame_id""",
)
def _(t):
    checked = t.fx_candidates.withColumn("reason", X.first_reason(_quality_checks()))
    at = ["pos", "l_partkey", "l_suppkey"]
    return X.best_or_dominant_reason(checked, "frame_id", "reason", [F.desc("score"), *at], at).select(
        "frame_id", "candidate_id", "accepted", "outcome"
    )


@query(
    "F11_threshold_rule",
    """SELECT frame_id, pos, l_partkey, l_suppkey, score >= -0.5 AND score <= 0.75 AND candidate_iou >= 0.2 AND pred_pixels <= 45
  AND pos <> 3 AND cx / CAST(640 AS DOUBLE) >= 0.1 AS matches, false AS missing_matches FROM fx_candidates""",
)
def _(t):
    it = R.Item("item", ITEM_FIELDS)
    rule = {
        "min_score": -0.5, "max_score": 0.75, "min_ball_fill_fraction": 0.2, "max_pred_pixels": 45, "min_reach": 0.1,
        "min_thinness": None,
    }
    return t.fx_candidates.select(*KEYS, item().alias("item")).select(
        *KEYS, R.thresholds(it, rule).alias("matches"), R.thresholds(it, {"max_unknown": 9.0}).alias("missing_matches")
    )


@query(
    "F12_rule_predicates",
    """SELECT frame_id, pos, l_partkey, l_suppkey, candidate_source = 'white_blob' OR candidate_source LIKE 'reticle!_global!_%' ESCAPE '!' AS source_ok,
  selector_pool = 'rescue' AS flag_ok, selector_pool IN ('primary', 'fallback') AS pool_ok FROM fx_candidates""",
)
def _(t):
    it = R.Item("item", ITEM_FIELDS)
    return t.fx_candidates.select(*KEYS, item().alias("item")).select(
        *KEYS,
        R.source_matches(it["candidate_source"], "white_blob", "reticle_global").alias("source_ok"),
        R.flags_present(it, ["selected_via_rescue"]).alias("flag_ok"),
        R.pool_matches(it, ["primary", "fallback"]).alias("pool_ok"),
    )


@query(
    "F13_veto_targets",
    """SELECT target, winner_source, count(*) AS n FROM (SELECT CASE WHEN gt_pixels <= 0 AND pred_pixels > 0 THEN '1'
  WHEN gt_pixels > 0 AND pred_pixels > 0 AND iou >= 0.1 THEN '0' ELSE 'empty_or_unusable' END AS target, winner_source FROM fx_scored)
GROUP BY target, winner_source""",
)
def _(t):
    target = X.veto_target(F.col("gt_pixels"), F.col("pred_pixels"), F.col("iou"), 0.1)
    label = F.coalesce(target.cast("string"), F.lit("empty_or_unusable"))
    return t.fx_scored.groupBy(label.alias("target"), "winner_source").agg(F.count("*").alias("n"))
