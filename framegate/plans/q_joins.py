"""Queries for lookups, semi and anti joins, tiered matches and rule joins."""

from pyspark.sql import functions as F

from framegate.functions import keys as K
from framegate.operators import joins as J
from framegate.plans.common import CANDIDATE_ORDER, ITEM_FIELDS, WINNER_SQL, frame_winners, item
from framegate.plans.registry import query

KEYS = ["frame_id", "pos", "l_partkey", "l_suppkey"]


@query(
    "J1_lookup",
    """SELECT c.frame_id, c.pos, c.l_partkey, c.l_suppkey, e.split FROM fx_candidates c JOIN fx_eval e ON c.frame_id = e.id
WHERE e.id % 3 <> 0 AND c.candidate_source = 'white_blob'
UNION ALL SELECT DISTINCT frame_id, -1, CAST(-1 AS BIGINT), CAST(-1 AS BIGINT), 'missing' FROM fx_candidates
WHERE candidate_source = 'white_blob' AND frame_id % 3 = 0""",
)
def _(t):
    base = t.fx_eval.filter("id % 3 <> 0").select(F.col("id").alias("frame_id"), "split")
    rows = t.fx_candidates.filter("candidate_source = 'white_blob'").select(*KEYS)
    lost = J.missing(rows, base, ["frame_id"]).selectExpr(
        "frame_id", "-1 AS pos", "-1L AS l_partkey", "-1L AS l_suppkey", "'missing' AS split"
    )
    return J.lookup(rows, base, ["frame_id"]).unionByName(lost)


@query(
    "J2_latest_per_key",
    """WITH l AS (SELECT * FROM fx_annotations QUALIFY row_number() OVER (PARTITION BY source_key ORDER BY created_at DESC, id) = 1),
w AS (SELECT source_key, min(id) AS review_index FROM fx_annotations WHERE id % 2 = 0 GROUP BY source_key
  UNION ALL SELECT 'lost/' || doc_id, doc_id FROM labels)
SELECT w.source_key, w.review_index, l.id, coalesce(l.mask_area > 0, false) AS found FROM w LEFT JOIN l USING (source_key)""",
)
def _(t):
    latest = J.latest_per_key(t.fx_annotations, ["source_key"], "created_at", ["id"])
    wanted = t.fx_annotations.filter("id % 2 = 0").groupBy("source_key").agg(F.min("id").alias("review_index"))
    lost = t.labels.select(F.concat(F.lit("lost/"), F.col("doc_id")).alias("source_key"), F.col("doc_id").alias("review_index"))
    looked = J.ordered_lookup(wanted.unionByName(lost), latest, "source_key", F.col("mask_area") > 0)
    return looked.select("source_key", "review_index", "id", "found")


@query(
    "J3_in_either",
    """SELECT id FROM fx_annotations WHERE id IN (SELECT doc_id FROM labels WHERE quality = 1)
  OR lower(replace(source_key, '/', chr(92))) IN (SELECT lower(replace(source || '/' || lang || '/' || CAST(doc_id % 40 AS VARCHAR), '/', chr(92)))
    FROM documents WHERE doc_id % 40 < 4)""",
)
def _(t):
    rows = t.fx_annotations.select("id", K.canonical_path_key(F.col("source_key")).alias("path_key"))
    ids = t.labels.filter("quality = 1").select(F.col("doc_id").alias("id"))
    paths = rows.filter(F.element_at(F.split("path_key", r"\\"), -1).cast("int") < 4)
    return J.in_either(rows, ids, "id", paths, "path_key").select("id")


@query(
    "J4_eligible_sample",
    """WITH x AS (SELECT DISTINCT lower(u) AS u FROM (SELECT upper(url) AS u FROM pages WHERE page_id % 3 = 0
  UNION ALL SELECT url FROM pages WHERE page_id % 5 = 0))
SELECT page_id, url FROM pages WHERE lower(url) NOT IN (SELECT u FROM x) ORDER BY sha1('7|' || page_id), page_id LIMIT 50""",
)
def _(t):
    used = [t.pages.filter("page_id % 3 = 0").select(F.upper("url")), t.pages.filter("page_id % 5 = 0").select("url")]
    return J.eligible_sample(t.pages, F.col("url"), used, "page_id", 50, 7).select("page_id", "url")


@query("J5_aligned_join", "SELECT id, round(iou, 9) AS iou, round(dice, 9) AS dice FROM fx_scored")
def _(t):
    joined = J.aligned_join(t.fx_scored.select("id", "iou"), t.fx_scored.select("id", "dice"), "id")
    return joined.select("id", F.round("iou", 9).alias("iou"), F.round("dice", 9).alias("dice"))


def _match_inputs(t):
    """Targets: each frame's best row, changed in id, pool or place by frame number; candidates: the others' view."""
    best = frame_winners(t.fx_candidates).select(
        "frame_id", item().alias("i"),
    )
    moved = F.when(F.col("frame_id") % 5 == 4, 3).otherwise(0)
    i = lambda f: F.col(f"i.{f}")
    target = F.struct(
        F.when(F.col("frame_id") % 5 == 1, "other").otherwise(i("candidate_id")).alias("candidate_id"),
        i("candidate_source").alias("candidate_source"),
        F.when(F.col("frame_id") % 5 == 2, "unseen").otherwise(i("selector_pool")).alias("selector_pool"),
        i("pred_pixels").alias("pred_pixels"),
        *[(i(c) + moved).alias(c) for c in ("cx", "cy", "x0", "y0", "x1", "y1")],
    )
    targets = best.select("frame_id", F.when(F.col("frame_id") % 11 != 0, target).alias("target"))
    pool = t.fx_candidates.select("frame_id", item().alias("candidate"), *CANDIDATE_ORDER)
    return targets, pool.filter("frame_id % 7 <> 3")


_MATCH_SQL = f"""w AS (SELECT *, CASE WHEN frame_id % 5 = 4 THEN 3 ELSE 0 END AS mv FROM {WINNER_SQL}),
t AS (SELECT frame_id, frame_id % 11 <> 0 AS has, CASE WHEN frame_id % 5 = 1 THEN 'other' ELSE candidate_id END AS candidate_id,
  candidate_source, CASE WHEN frame_id % 5 = 2 THEN 'unseen' ELSE selector_pool END AS pool, pred_pixels, cx + mv AS cx, cy + mv AS cy,
  cx - radius * 3 + mv AS x0, cy - radius * 3 + mv AS y0, cx + radius * 3 + mv AS x1, cy + radius * 3 + mv AS y1 FROM w),
p AS (SELECT t.frame_id, c.candidate_id AS cid, c.candidate_iou, c.pos, c.l_partkey, c.l_suppkey, c.score,
  t.candidate_source = c.candidate_source AS src, t.pool = c.selector_pool AS pl, t.candidate_id = c.candidate_id AS cidm,
  t.cx = c.cx AND t.cy = c.cy AND t.x0 = c.cx - c.radius * 3 AND t.x1 = c.cx + c.radius * 3 AND t.y0 = c.cy - c.radius * 3 AND t.y1 = c.cy + c.radius * 3 AS geo,
  greatest(0, 32 - sqrt(CAST((t.cx - c.cx) * (t.cx - c.cx) + (t.cy - c.cy) * (t.cy - c.cy) AS DOUBLE))) / 32 + greatest(0, 64 - abs(t.pred_pixels - c.pred_pixels)) / CAST(64 AS DOUBLE) AS part,
  greatest(0, least(t.x1, c.cx + c.radius * 3) - greatest(t.x0, c.cx - c.radius * 3)) * greatest(0, least(t.y1, c.cy + c.radius * 3) - greatest(t.y0, c.cy - c.radius * 3)) AS inter,
  (t.x1 - t.x0) * (t.y1 - t.y0) + 36 * c.radius * c.radius AS areas
  FROM t JOIN fx_candidates c ON t.frame_id = c.frame_id WHERE t.has AND c.frame_id % 7 <> 3),
k AS (SELECT *, CASE WHEN cidm AND src AND pl AND geo THEN 1 WHEN src AND pl AND geo THEN 2 WHEN src AND geo THEN 3
  WHEN src AND pl AND part + inter / CAST(areas - inter AS DOUBLE) >= 1.25 THEN 4 WHEN cidm AND src AND pl THEN 5 END AS tier,
  part + inter / CAST(areas - inter AS DOUBLE) AS sim FROM p),
m AS (SELECT * FROM k WHERE tier IS NOT NULL QUALIFY row_number() OVER (PARTITION BY frame_id
  ORDER BY tier, CASE WHEN tier = 4 THEN sim ELSE 0 END DESC, pos, l_partkey, l_suppkey, score) = 1),
r AS (SELECT t.frame_id, m.cid AS matched_id, m.candidate_iou AS matched_iou, CASE WHEN NOT t.has THEN 'no_wide_best_candidate' ELSE coalesce(CASE m.tier
  WHEN 1 THEN 'exact_key_and_geometry' WHEN 2 THEN 'same_source_pool_geometry' WHEN 3 THEN 'same_source_geometry_different_pool'
  WHEN 4 THEN 'similar_source_pool_geometry' WHEN 5 THEN 'same_key_geometry_mismatch' END, 'not_found') END AS match_type FROM t LEFT JOIN m USING (frame_id))"""


@query("J6_tiered_match", f"WITH {_MATCH_SQL} SELECT frame_id, matched_id, match_type FROM r")
def _(t):
    targets, pool = _match_inputs(t)
    matched = J.tiered_match(targets, pool, "frame_id", CANDIDATE_ORDER)
    return matched.select("frame_id", F.col("candidate.candidate_id").alias("matched_id"), "match_type")


@query(
    "J7_availability",
    f"""WITH {_MATCH_SQL},
d AS (SELECT frame_id, max(candidate_iou) AS best FROM fx_candidates WHERE frame_id % 7 <> 3 GROUP BY frame_id)
SELECT availability, match_type, count(*) AS n FROM (SELECT r.match_type, CASE WHEN d.frame_id IS NULL THEN 'missing_deployed_diagnostic'
  WHEN r.matched_id IS NOT NULL AND r.matched_iou >= 0.5 THEN CASE r.match_type WHEN 'exact_key_and_geometry' THEN 'available_exact_high_iou'
    WHEN 'same_source_geometry_different_pool' THEN 'available_equivalent_different_pool_high_iou' ELSE 'available_similar_high_iou' END
  WHEN r.matched_id IS NOT NULL THEN 'candidate_present_but_low_iou_or_zero'
  WHEN d.best >= 0.5 THEN CASE WHEN r.frame_id % 2 = 0 THEN 'alternate_high_iou_available' ELSE 'alternate_high_iou_not_selector' END
  WHEN w.candidate_iou >= 0.5 THEN 'diagnostic_primary32_only_or_unavailable' ELSE 'not_relevant_low_iou' END AS availability
  FROM r LEFT JOIN d ON r.frame_id = d.frame_id JOIN w ON r.frame_id = w.frame_id) GROUP BY availability, match_type""",
)
def _(t):
    targets, pool = _match_inputs(t)
    wide = frame_winners(t.fx_candidates).select("frame_id", F.col("candidate_iou").alias("wide_best"))
    run = pool.groupBy("frame_id").agg(F.max("candidate.candidate_iou").alias("run_best"))
    joined = (
        J.tiered_match(targets, pool, "frame_id", CANDIDATE_ORDER).join(run, "frame_id", "left").join(wide, "frame_id")
    )
    label = J.availability_label(
        F.col("run_best").isNotNull(), F.col("candidate").isNotNull(), F.col("match_type"),
        F.col("candidate.candidate_iou"), F.col("run_best"),
        F.when(F.col("frame_id") % 2 == 0, "selector_or_reranker_miss").otherwise("no_candidate"), F.col("wide_best"), 0.5,
    )
    return joined.groupBy(label.alias("availability"), "match_type").agg(F.count("*").alias("n"))


SELECTOR_RULES = [
    {
        "name": "reticle_low", "current_source_group": "reticle_global", "candidate_source": "white_blob",
        "max_current_score": 0.4, "min_candidate_ball_fill_fraction": 0.3, "selection_key": "ball_fill_fraction",
    },
    {
        "name": "any_to_hough", "candidate_source": "table_hough", "candidate_pools": ["primary", "rescue"],
        "min_candidate_reach": 0.2, "max_current_pred_pixels": 40, "selection_key": "pred_pixels",
        "selection_direction": "min",
    },
    {
        "name": "fallback_flag", "current_required_flags": ["fallback"], "candidate_source_group": "reticle_global",
        "min_candidate_score": -0.3, "selection_key": "score",
    },
]

SELECTOR_SQL = f"""WITH w AS {WINNER_SQL},
p AS (SELECT w.frame_id, w.candidate_source AS cs, w.score AS csc, w.pred_pixels AS cpp, w.selector_pool AS cpool, c.*
  FROM w JOIN fx_candidates c ON w.frame_id = c.frame_id WHERE NOT (w.candidate_id = c.candidate_id AND w.selector_pool = c.selector_pool)),
h AS (SELECT *, 1 AS rule_no, candidate_iou AS pref FROM p WHERE (cs = 'reticle_global' OR starts_with(cs, 'reticle_global_')) AND candidate_source = 'white_blob'
    AND csc <= 0.4 AND candidate_iou >= 0.3
  UNION ALL SELECT *, 2, CAST(-pred_pixels AS DOUBLE) FROM p WHERE candidate_source = 'table_hough' AND selector_pool IN ('primary', 'rescue')
    AND pos <> 3 AND cx / CAST(640 AS DOUBLE) >= 0.2 AND cpp <= 40
  UNION ALL SELECT *, 3, score FROM p WHERE cpool = 'fallback' AND (candidate_source = 'reticle_global' OR starts_with(candidate_source, 'reticle_global_')) AND score >= -0.3)
SELECT frame_id, rule_no, candidate_id, round(score, 9) AS score FROM h
QUALIFY row_number() OVER (PARTITION BY frame_id ORDER BY rule_no, pref DESC, pos, l_partkey, l_suppkey, score) = 1"""


@query("J8_rule_join", SELECTOR_SQL)
def _(t):
    current = frame_winners(t.fx_candidates).select("frame_id", item().alias("current"))
    pool = t.fx_candidates.select("frame_id", item().alias("candidate"), *CANDIDATE_ORDER)
    chosen = J.select_by_rules(
        current, pool, SELECTOR_RULES, "frame_id", CANDIDATE_ORDER, ITEM_FIELDS, ITEM_FIELDS
    )
    return chosen.select(
        "frame_id", "rule_no", F.col("candidate.candidate_id").alias("candidate_id"),
        F.round("candidate.score", 9).alias("score"),
    )


@query(
    "J15_triplet_completeness",
    """SELECT id, concat_ws(', ', CASE WHEN id % 7 = 0 THEN 'mask' END, CASE WHEN id % 5 = 0 THEN 'preview' END) AS missing FROM fx_annotations""",
)
def _(t):
    images = t.fx_annotations.select("id")
    return J.triplet_completeness(images, images.filter("id % 7 <> 0"), images.filter("id % 5 <> 0"), "id")


@query(
    "J17_existing_lookup",
    """SELECT id, id IN (SELECT doc_id FROM labels) AS known_id,
  lower(source_key) IN (SELECT lower(source || '/' || lang || '/' || CAST(doc_id % 40 AS VARCHAR)) FROM documents WHERE doc_id % 9 = 0) AS known_source FROM fx_annotations""",
)
def _(t):
    rows = t.fx_annotations.select("id", F.col("id").cast("string").alias("key"), "source_key")
    known = J.already_labelled(rows, "key", [t.labels.select(F.col("doc_id").cast("string"))])
    known = known.withColumnRenamed("is_labelled", "known_id")
    old = t.fx_annotations.filter("id % 9 = 0").select("source_key")
    return J.already_labelled(known, "source_key", [old]).select("id", "known_id", F.col("is_labelled").alias("known_source"))


@query(
    "J18_restrict_to_manifest",
    "SELECT id, split FROM fx_eval WHERE id IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 49)",
)
def _(t):
    manifest = t.lineitem.filter("l_quantity > 49").select(F.col("l_orderkey").alias("id"))
    return J.restrict_to_manifest(t.fx_eval, manifest, "id").select("id", "split")


@query(
    "J19_current_category",
    """SELECT category, count(*) AS n FROM (SELECT CASE WHEN id % 4 = 0 THEN 'save' WHEN id % 6 = 0 THEN 'reject' WHEN id % 7 = 0 THEN 'no_table'
  ELSE 'UNSORTED' END AS category FROM fx_annotations) GROUP BY category""",
)
def _(t):
    ids = t.fx_annotations.select("id")
    placed = ids.filter("id % 4 = 0").withColumn("category", F.lit("save"))
    for every, name in ((6, "reject"), (7, "no_table")):
        placed = placed.unionByName(ids.filter(f"id % {every} = 0").withColumn("category", F.lit(name)))
    return J.current_category(ids, placed, "id", ["save", "reject", "no_table"]).groupBy("category").agg(F.count("*").alias("n"))


@query(
    "J21_already_labelled",
    """SELECT page_id, lower(url) IN (SELECT lower(url) FROM pages WHERE page_id % 4 = 0 OR page_id % 6 = 1) AS is_labelled FROM pages""",
)
def _(t):
    sets = [t.pages.filter("page_id % 4 = 0").select(F.upper("url")), t.pages.filter("page_id % 6 = 1").select("url")]
    return J.already_labelled(t.pages, "url", sets).select("page_id", "is_labelled")
