"""Queries for boards, manifests, merges and run comparisons."""

from pyspark.sql import functions as F

from framegate.functions import keys as K
from framegate.operators import boards as B
from framegate.operators import features as X
from framegate.operators import ranking as W
from framegate.operators import splits as S
from framegate.plans.common import CANDIDATE_ORDER, WINNER_SQL, frame_winners
from framegate.plans.q_spatial import AT, circles
from framegate.plans.registry import query

_FRACTION = "CAST(('0x' || substr(sha1({k}), 1, 12)) AS BIGINT) / CAST({span} AS DOUBLE)"
MAX_SPAN, OPEN_SPAN = "281474976710655", "281474976710656"


def fraction(key, span=MAX_SPAN):
    return _FRACTION.replace("{k}", key).replace("{span}", span)


@query(
    "U1_tagged_union",
    """SELECT CAST(id AS VARCHAR) AS id, coalesce(nullif(dataset_split, ''), 'main') AS dataset_split, save_mode, source, NULL::VARCHAR AS url FROM fx_annotations WHERE id % 2 = 0
UNION ALL SELECT 'page' || page_id, 'quarantine', 'force', NULL, url FROM pages""",
)
def _(t):
    main = t.fx_annotations.filter("id % 2 = 0").select(F.col("id").cast("string").alias("id"), "dataset_split", "save_mode", "source")
    extra = t.pages.select(F.concat(F.lit("page"), F.col("page_id")).alias("id"), "url")
    return B.tagged_union(
        [(main, {"dataset_split": "main", "save_mode": "normal"}), (extra, {"dataset_split": "quarantine", "save_mode": "force"})], "id"
    ).select("id", "dataset_split", "save_mode", "source", "url")


@query("U2_distinct_ids", "SELECT doc_id AS id FROM labels UNION SELECT item_id FROM benchmark UNION SELECT id FROM fx_annotations")
def _(t):
    parts = [t.labels.select(F.col("doc_id").alias("id")), t.benchmark.select(F.col("item_id").alias("id")), t.fx_annotations]
    return B.distinct_ids(parts, "id")


@query(
    "U3_append_residuals",
    """WITH r AS (SELECT id, iou, winner_source, id * 7 % 640 AS cx, id * 5 % 360 AS cy, 8 + id % 20 AS radius FROM fx_scored WHERE iou <= 0.3 AND id IN (SELECT l_orderkey FROM lineitem)),
h AS (SELECT *, CAST(round_even(radius * 4.25 + 24, 0) AS BIGINT) AS half FROM r)
SELECT 'view_positive' AS kind, id, CAST(NULL AS BIGINT) AS x0, CAST(NULL AS BIGINT) AS y1, CAST(NULL AS VARCHAR) AS winner_source FROM fx_eval WHERE gt_pixels > 90
UNION ALL SELECT 'residual_policy_negative', id, greatest(0, cx - half), least(360, cy + half), winner_source FROM h""",
)
def _(t):
    base = t.fx_eval.filter("gt_pixels > 90").select(F.lit("view_positive").alias("kind"), "id")
    i = F.col("id")
    evaluated = t.fx_scored.select(
        "id", "iou", "winner_source", (i * 7 % 640).alias("cx"), (i * 5 % 360).alias("cy"), (i % 20 + 8).alias("radius"), F.lit(0.5).alias("score")
    )
    lookup = t.lineitem.select(F.col("l_orderkey").alias("id")).distinct().select(
        "id", F.lit("i.png").alias("image_path"), F.lit("m.png").alias("mask_path"), F.lit(640).alias("width"), F.lit(360).alias("height")
    )
    return B.append_residuals(base, evaluated, lookup, 0.3).select("kind", "id", "x0", "y1", "winner_source")


@query(
    "U4_import_absent",
    """WITH s AS (SELECT doc_id AS pos, CASE WHEN doc_id % 50 = 0 THEN '' ELSE CAST(doc_id % 700 AS VARCHAR) END AS sid, n_chars > 200 AS ok FROM documents),
k AS (SELECT *, sid IN (SELECT CAST(doc_id AS VARCHAR) FROM labels) OR sid IN (SELECT CAST(item_id AS VARCHAR) FROM benchmark) AS known FROM s),
f AS (SELECT sid, min(pos) AS first FROM k WHERE sid <> '' AND NOT known AND ok GROUP BY sid)
SELECT decision, count(*) AS n FROM (SELECT CASE WHEN k.sid = '' THEN 'invalid' WHEN known OR pos > first THEN 'exists' WHEN pos = first THEN 'imported' ELSE 'invalid' END AS decision FROM k LEFT JOIN f ON f.sid = k.sid) GROUP BY decision
UNION ALL SELECT 'total', (SELECT count(*) FROM f) + (SELECT count(*) FROM labels) + (SELECT count(*) FROM benchmark)""",
)
def _(t):
    key = F.when(F.col("doc_id") % 50 == 0, "").otherwise((F.col("doc_id") % 700).cast("string"))
    source = t.documents.select(F.col("doc_id").alias("pos"), key.alias("id"), "n_chars")
    target = t.labels.select(F.lit("").alias("id"), F.col("doc_id").cast("string").alias("source_sample_id")).unionByName(
        t.benchmark.select(F.concat(F.lit("imp_"), F.col("item_id")).alias("id"), F.lit("").alias("source_sample_id"))
    )
    decided = B.import_decisions(source, target, "imp_", F.col("n_chars") > 200, ["pos"])
    total = B.import_absent(decided, target).agg(F.lit("total").alias("decision"), F.count("*").alias("n"))
    return decided.groupBy("decision").agg(F.count("*").alias("n")).unionByName(total)


@query(
    "U5_run_difference",
    """SELECT id, CASE WHEN id % 10 = 0 THEN 'added' WHEN id % 10 = 1 THEN 'removed' ELSE 'changed' END AS change FROM fx_eval WHERE id % 10 IN (0, 1) OR (id % 10 = 2 AND pred_pixels > 50)""",
)
def _(t):
    before = t.fx_eval.filter("id % 10 <> 0").select("id", "gt_pixels", "pred_pixels")
    shift = F.when((F.col("id") % 10 == 2) & (F.col("pred_pixels") > 50), 1).otherwise(0)
    after = t.fx_eval.filter("id % 10 <> 1").select("id", "gt_pixels", (F.col("pred_pixels") + shift).alias("pred_pixels"))
    return B.run_difference(before, after, "id", ["gt_pixels", "pred_pixels"])


@query(
    "U6_work_list",
    """SELECT 'video_' || video_id || '__clip_f' || lpad(CAST(frame_index AS VARCHAR), 8, '0') AS stem FROM fx_frames WHERE frame_index % 3 <> 0""",
)
def _(t):
    jobs = t.fx_frames.select("frame_index", K.output_stem(F.col("path"), "C:/frames").alias("stem"))
    return B.work_list(jobs, jobs.filter("frame_index % 3 = 0"), "stem").select("stem")


_BOARD_SQL = f"""WITH h AS (SELECT 'a' || frame_index AS id, 'C:/video_infer_harvest/video_' || video_id || '/clip:bucket' || lpad(CAST(frame_index // 25 AS VARCHAR), 8, '0') AS g FROM fx_frames WHERE split = 'view' AND 'a' || frame_index NOT IN (SELECT 'a' || frame_index FROM fx_frames WHERE frame_index % 40 IN (0, 1))),
n AS (SELECT 'r' || frame_index AS id, 'C:/video_infer_harvest/video_' || video_id || '/clip:bucket' || lpad(CAST(frame_index // 25 AS VARCHAR), 8, '0') AS g FROM fx_frames WHERE split = 'click'),
f AS (SELECT 'page' || page_id AS id, '/neg/page' || page_id AS g FROM pages)
SELECT 'old_val' AS split, 'a' || frame_index AS id, 'positive' AS kind, CAST(NULL AS VARCHAR) AS group_key FROM fx_frames WHERE frame_index % 40 = 0
UNION ALL SELECT 'old_hard_val', 'a' || frame_index, 'positive', NULL FROM fx_frames WHERE frame_index % 40 = 1
UNION ALL SELECT 'harvest_holdout', id, 'positive', g FROM h WHERE {fraction('g')} < 0.2 UNION ALL SELECT 'rejected_negatives', id, 'image_negative', g FROM n WHERE {fraction('g')} < 0.2
UNION ALL SELECT 'flat_negatives', id, 'flat_negative', g FROM f WHERE {fraction('g')} < 0.2"""


@query("U7_gold_board", _BOARD_SQL)
def gold_board_query(t):
    frames = t.fx_frames.withColumn("source_image_path", F.replace("path", F.lit("C:/frames"), F.lit("C:/video_infer_harvest")))
    name = F.col("frame_index").cast("string")

    def rows(df, letter):
        return df.select(
            F.concat(F.lit(letter), name).alias("id"), "frame_index", F.concat(F.lit("img/"), name).alias("image_path"),
            F.concat(F.lit("mask/"), name).alias("mask_path"), "source_image_path", F.lit("2026-01-01T00:00:00Z").alias("created_at"),
        )

    old = rows(frames, "a").filter("frame_index % 40 IN (0, 1)")
    old = old.select(F.when(F.col("frame_index") % 40 == 0, "val").otherwise("hard_val").alias("split"), "id", "image_path", "mask_path", F.col("frame_index").alias("pos"))
    # Every old row occurs twice; the first one counts.
    old = old.unionByName(old.withColumn("pos", F.col("pos") + 1_000_000_000))
    flat = t.pages.select(F.concat(F.lit("/neg/page"), F.col("page_id"), F.lit(".png")).alias("image_path"))
    board = B.gold_board(old, rows(frames.filter("split = 'view'"), "a"), rows(frames.filter("split = 'click'"), "r"), flat, 0.2)
    return board.select("split", "id", "kind", "group_key")


@query("U7_exclude_ids", f"SELECT DISTINCT id FROM ({_BOARD_SQL})")
def _(t):
    return B.exclude_ids(gold_board_query(t))


@query(
    "U7_board_policy",
    f"SELECT 3 AS version, CAST(0.2 AS DOUBLE) AS holdout_fraction, 25 AS frame_bucket_size, count(*) AS rows FROM ({_BOARD_SQL})",
)
def _(t):
    rows = gold_board_query(t).agg(F.count("*").alias("rows"))
    return B.board_policy(t.spark, 0.2).crossJoin(F.broadcast(rows))  # one row each


def _index(t):
    kinds = F.element_at(
        F.array(*[F.lit(k) for k in ("view_positive", "bbox_positive", "candidate_positive", "rejected_negative", "external_negative")]),
        (F.col("pos") % 5 + 1).cast("int"),
    )
    return t.fx_candidates.select(
        F.when(F.col("frame_id") % 10 == 0, "hard_val").when(F.col("frame_id") % 10 < 3, "val").otherwise("train").alias("split"),
        F.concat(F.lit("f"), F.col("frame_id"), F.lit("_"), F.col("candidate_id")).alias("id"), kinds.alias("kind"),
        F.concat(F.lit("img/"), F.col("frame_id")).alias("image_path"), F.concat(F.lit("mask/"), F.col("frame_id")).alias("mask_path"),
        (F.col("pred_pixels") < 3).alias("zero_mask"), "frame_id", *CANDIDATE_ORDER,
    )


@query(
    "U8_veto_train_board",
    """WITH i AS (SELECT frame_id, pos, l_partkey, l_suppkey, score, CASE WHEN pos % 5 < 3 THEN 'positives' WHEN pos % 5 = 3 THEN 'rejected_negatives' ELSE 'flat_negatives' END AS board FROM fx_candidates WHERE frame_id % 10 >= 3),
f AS (SELECT * FROM i QUALIFY row_number() OVER (PARTITION BY board, frame_id ORDER BY frame_id, pos, l_partkey, l_suppkey, score) = 1)
SELECT 'train_' || board AS split, 'f' || frame_id AS id, 'img/' || frame_id AS image_path FROM f QUALIFY row_number() OVER (PARTITION BY board ORDER BY frame_id, pos, l_partkey, l_suppkey, score) <= 500""",
)
def _(t):
    board = B.veto_train_board(_index(t), "train", ["frame_id", *CANDIDATE_ORDER], 500)
    return board.select("split", "id", "image_path")


@query(
    "U9_veto_dataset",
    """WITH b AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 = 0 THEN 'supplemental_positives' ELSE 'rejected_negatives' END AS split FROM orders),
r AS (SELECT b.*, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 10 ELSE greatest(o_custkey % 50, o_orderkey % 60) END AS px, o_orderkey % 11 <> 0 AS has FROM b JOIN orders ON o_orderkey = b.id)
SELECT id, split, has AS has_report, CASE WHEN has THEN px END AS pred_pixels, CASE WHEN has THEN CASE WHEN split LIKE '%positive%' THEN 'positive_unscored' WHEN px > 0 THEN 'negative_false_positive' ELSE 'true_negative' END END AS failure_type,
  CASE WHEN has THEN CAST(split NOT LIKE '%positive%' AND px > 0 AS INTEGER) END AS target FROM r""",
)
def _(t):
    from framegate.plans.q_keys import order_docs

    split = F.when(F.col("id") % 5 == 0, "supplemental_positives").otherwise("rejected_negatives")
    board = t.orders.select(F.col("o_orderkey").alias("id")).select("id", split.alias("split"), F.lit("item").alias("kind"), F.lit(None).cast("string").alias("mask_path"))
    docs = order_docs(t).filter("id % 11 <> 0").select("id", F.from_json("doc", "map<string,string>").alias("m"))
    reports = docs.select(
        "id", split.alias("split"), F.transform_values("m", lambda k, v: v.try_cast("double")).alias("values"),
        F.when(F.col("id") % 3 == 0, F.col("id") % 10).alias("own_pixels"),
    )
    return B.veto_dataset_from_reports(board, reports).select("id", "split", "has_report", "pred_pixels", "failure_type", "target")


@query("U9_veto_targets", "SELECT id, CAST(gt_pixels <= 0 AND pred_pixels > 0 AS INTEGER) AS target FROM fx_eval")
def _(t):
    return B.veto_dataset(t.fx_eval).select("id", "target")


@query(
    "U10_arbiter_pairs",
    f"""WITH w AS {WINNER_SQL}, c AS (SELECT c.*, w.candidate_id AS wid, w.selector_pool AS wpool, w.candidate_iou AS wiou, row_number() OVER (PARTITION BY c.frame_id ORDER BY c.candidate_iou DESC, c.score DESC, c.pos, c.l_partkey, c.l_suppkey) AS rn FROM fx_candidates c JOIN w ON w.frame_id = c.frame_id),
l AS (SELECT * FROM c WHERE rn <= 8),
d AS (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY frame_id, candidate_id, candidate_source, selector_pool, pred_pixels, round(score, 6) ORDER BY rn) = 1)
SELECT frame_id AS id, candidate_id, round(candidate_iou, 6) AS candidate_iou, CASE WHEN candidate_iou >= 0.5 AND candidate_iou >= wiou + 0.25 THEN 1 ELSE 0 END AS target FROM d
WHERE NOT (candidate_id = wid AND selector_pool = wpool) AND ((candidate_iou >= 0.5 AND candidate_iou >= wiou + 0.25) OR candidate_iou <= 0.05)""",
)
def _(t):
    item = F.struct("candidate_id", "candidate_source", "selector_pool", "pred_pixels", "score", "candidate_iou")
    winners = frame_winners(t.fx_candidates).select("frame_id", item.alias("winner"))
    top = W.top_per_key(t.fx_candidates, ["frame_id"], [F.desc("candidate_iou"), F.desc("score"), *AT], 8, rank="rn")
    lists = top.groupBy("frame_id").agg(F.array_sort(F.collect_list(F.struct("rn", item.alias("c")))).alias("l"))  # at most eight
    diagnostics = lists.join(winners, "frame_id").select(
        F.col("frame_id").alias("id"), F.col("winner.candidate_iou").alias("final_iou"), "winner",
        F.concat(F.col("l.c"), F.slice("l.c", 1, 2)).alias("candidates"),
    )
    pairs = B.arbiter_pairs(diagnostics)
    return pairs.select("id", F.col("candidate.candidate_id").alias("candidate_id"), F.round("candidate.candidate_iou", 6).alias("candidate_iou"), "target")


@query(
    "U11_reranker_frames",
    f"""SELECT DISTINCT CASE WHEN frame_id % 10 = 0 THEN 'hard' WHEN frame_id % 10 < 3 THEN 'val' ELSE 'train' END AS part, 'f' || frame_id || '_' || candidate_id AS frame_id FROM fx_candidates WHERE pos % 5 < 3 AND pred_pixels >= 3
UNION ALL SELECT * FROM (SELECT 'negative_val', url FROM (SELECT DISTINCT url FROM pages) WHERE {fraction('url', OPEN_SPAN)} < 0.3)
UNION ALL SELECT * FROM (SELECT 'negative_train', url FROM (SELECT DISTINCT url FROM pages) WHERE {fraction('url', OPEN_SPAN)} >= 0.3 ORDER BY url LIMIT 60)""",
)
def _(t):
    kind = F.when(F.col("page_id") % 2 == 0, "image_negative").otherwise("flat_negative")
    board = t.pages.select(F.col("url").alias("id"), kind.alias("kind"), F.col("page_id").alias("frame_id"), *[F.lit(0).alias(c) for c in CANDIDATE_ORDER])
    return B.reranker_frames(_index(t), board, ["frame_id", *CANDIDATE_ORDER], 0.3, 60, None)


def _subset_inputs(t):
    positives = t.fx_annotations.select(F.concat(F.lit("img/"), F.col("id")).alias("image_path"), "major_len", "id")
    negatives = t.pages.select(F.col("url").alias("image_path"), (F.col("page_id") * 37 % 101).alias("score"))
    return positives, negatives.groupBy("image_path").agg(F.max("score").alias("score"))


_SUBSET_SQL = """p AS (SELECT id, 'img/' || id AS image_path, major_len FROM fx_annotations), n AS (SELECT url AS image_path, max(page_id * 37 % 101) AS score FROM pages GROUP BY url)"""


@query(
    "U12_subset_catalogue",
    f"""WITH {_SUBSET_SQL} SELECT 'tiny' AS subset, image_path FROM p WHERE major_len < 12 UNION ALL SELECT 'tiny', image_path FROM n UNION ALL SELECT 'short', image_path FROM p WHERE major_len < 20 UNION ALL SELECT 'short', image_path FROM n
UNION ALL SELECT * FROM (SELECT 'distractors', image_path FROM n ORDER BY score DESC, image_path LIMIT 48)""",
)
def _(t):
    positives, negatives = _subset_inputs(t)
    return B.subset_catalogue(positives, negatives, 12, 20, 48)


@query(
    "U13_replay_catalogue",
    f"""WITH {_SUBSET_SQL}, tr AS (SELECT * FROM p QUALIFY row_number() OVER (ORDER BY sha1('42|' || id), id) > greatest(1, CAST(round_even((SELECT count(*) FROM p) * CAST(0.15 AS DOUBLE), 0) AS BIGINT)))
SELECT 'tiny' AS subset, image_path FROM tr WHERE major_len < 12 UNION ALL SELECT 'short', image_path FROM tr WHERE major_len < 20 UNION ALL SELECT * FROM (SELECT 'distractors', image_path FROM n ORDER BY score DESC, image_path LIMIT 30)""",
)
def _(t):
    positives, negatives = _subset_inputs(t)
    train = S.random_split(positives, "id", 0.15, 42).filter("split = 'train'")
    return B.subset_catalogue(train, negatives, 12, 20, 30, with_negatives=False)


_BOX = {"q": "CAST(round_even(greatest(mx1 - mx0 + 1, my1 - my0 + 1) * CAST(1.25 AS DOUBLE), 0) AS BIGINT) / CAST(2 AS DOUBLE)"}


@query(
    "U14_crop_index",
    f"""WITH c AS (SELECT frame_id, candidate_source, pos, l_partkey, l_suppkey, cx % 120 AS cx, cy % 60 AS cy, radius % 9 + 3 AS radius FROM fx_candidates WHERE frame_id IN (SELECT p_partkey FROM part)),
px AS (SELECT frame_id, x, y FROM fx_pixels WHERE side = 'gt'), m AS (SELECT frame_id, count(*) AS n, min(x) AS mx0, min(y) AS my0, max(x) + 1 AS mx1, max(y) + 1 AS my1 FROM px GROUP BY frame_id),
g AS (SELECT *, {_BOX["q"]} AS half, (mx0 + mx1) / CAST(2 AS DOUBLE) AS ox, (my0 + my1) / CAST(2 AS DOUBLE) AS oy, greatest(mx1 - mx0, my1 - my0) AS longest FROM m),
b AS (SELECT frame_id, n, greatest(0, CAST(round_even(ox - half, 0) AS BIGINT)) AS x0, greatest(0, CAST(round_even(oy - half, 0) AS BIGINT)) AS y0, least(160, CAST(round_even(ox + half, 0) AS BIGINT)) AS x1, least(120, CAST(round_even(oy + half, 0) AS BIGINT)) AS y1 FROM g),
s AS (SELECT g.frame_id, CAST(side AS BIGINT) AS side, CAST(round_even(ox - side / CAST(2 AS DOUBLE), 0) AS BIGINT) AS lx, CAST(round_even(oy - side / CAST(2 AS DOUBLE), 0) AS BIGINT) AS ly FROM g, (VALUES (32), (48), (96)) v(side) WHERE longest < side),
t AS (SELECT frame_id, side, least(greatest(0, lx), 160 - side) AS x0, least(greatest(0, ly), 120 - side) AS y0 FROM s),
u AS (SELECT t.*, x0 + side AS x1, y0 + side AS y1 FROM t WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.frame_id = t.frame_id AND b.x0 = t.x0 AND b.y0 = t.y0 AND b.x1 = t.x0 + side AND b.y1 = t.y0 + side)),
uc AS (SELECT u.frame_id, side, u.x0, u.y0, u.x1, u.y1, count(px.x) AS n FROM u LEFT JOIN px ON px.frame_id = u.frame_id AND px.x >= u.x0 AND px.x < u.x1 AND px.y >= u.y0 AND px.y < u.y1 GROUP BY ALL),
k AS (SELECT frame_id, pos || ':' || l_partkey || ':' || l_suppkey AS key, greatest(0, cx - h) AS x0, greatest(0, cy - h) AS y0, least(160, cx + h) AS x1, least(120, cy + h) AS y1 FROM (SELECT *, CAST(round_even(radius * 4.25 + 24, 0) AS BIGINT) AS h FROM c) WHERE frame_id IN (SELECT frame_id FROM m)),
kc AS (SELECT k.frame_id, key, k.x0, k.y0, k.x1, k.y1, count(px.x) AS n FROM k LEFT JOIN px ON px.frame_id = k.frame_id AND px.x >= k.x0 AND px.x < k.x1 AND px.y >= k.y0 AND px.y < k.y1 GROUP BY ALL)
SELECT frame_id, 'view_positive' AS kind, CAST(NULL AS BIGINT) AS context_side, x0, y0, x1, y1, n AS mask_pixels FROM b UNION ALL SELECT frame_id, 'bbox_positive', NULL, x0, y0, x1, y1, n FROM b
UNION ALL SELECT frame_id, 'context_positive', side, x0, y0, x1, y1, n FROM uc WHERE n >= 12 UNION ALL SELECT frame_id, 'candidate_positive', NULL, x0, y0, x1, y1, n FROM kc WHERE n >= 12
UNION ALL SELECT frame_id, 'candidate_negative', NULL, x0, y0, x1, y1, n FROM (SELECT * FROM kc WHERE n = 0 QUALIFY row_number() OVER (PARTITION BY frame_id ORDER BY sha1('42|' || key), key) <= 2)""",
)
def _(t):
    records = t.part.select(F.col("p_partkey").alias("frame_id"), F.lit("train").alias("split"), *[F.lit(None).cast("bigint").alias(c) for c in ("vx0", "vy0", "vx1", "vy1")])
    candidates = circles(t).select("frame_id", F.concat_ws(":", *AT).alias("candidate_key"), "cx", "cy", "radius")
    rows = B.crop_index(records, t.fx_pixels.filter("side = 'gt'").select("frame_id", "x", "y"), candidates, [48, 32, 96, 32], 0.25, 12, 2, 42, 160, 120)
    return rows.select("frame_id", "kind", "context_side", "x0", "y0", "x1", "y1", "mask_pixels")


@query(
    "U14_image_negatives",
    """WITH i AS (SELECT o_orderkey AS frame_id FROM orders), c AS (SELECT c.*, row_number() OVER (PARTITION BY frame_id ORDER BY score DESC, pos, l_partkey, l_suppkey) - 1 AS n FROM fx_candidates c WHERE frame_id IN (SELECT frame_id FROM i) AND selector_pool = 'primary')
SELECT frame_id || '_' || n AS id, candidate_source, CAST(radius AS BIGINT) AS radius, greatest(0, cx - CAST(round_even(radius * 4.25 + 24, 0) AS BIGINT)) AS x0 FROM c WHERE n < 2
UNION ALL SELECT frame_id || '_0', 'full_image', 29, 140 FROM i WHERE frame_id NOT IN (SELECT frame_id FROM c)""",
)
def _(t):
    images = t.orders.select(F.col("o_orderkey").alias("frame_id"))
    primary = t.fx_candidates.filter("selector_pool = 'primary'")
    rows = B.image_negatives(images, primary, 2, "rejected_negative", 640, 360, [F.desc("score"), *AT])
    return rows.select("id", "candidate_source", "radius", "x0")


@query(
    "U15_benchmark_manifest",
    "SELECT 'run' AS kind, url AS image_path FROM pages WHERE page_id % 2 = 0 UNION ALL SELECT * FROM (SELECT 'sample', url FROM pages ORDER BY sha1('5|' || url), url LIMIT 25)",
)
def _(t):
    images = t.pages.select(F.col("url").alias("image_path"))
    earlier = t.pages.select(F.when(F.col("page_id") % 2 == 0, F.col("url")).otherwise(" ").alias("image_path"))
    run = B.benchmark_manifest(earlier, images, 25, 5).withColumn("kind", F.lit("run"))
    return run.unionByName(B.benchmark_manifest(None, images, 25, 5).withColumn("kind", F.lit("sample")))


@query(
    "U16_training_rows",
    """WITH p AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS slot, count(*) OVER () AS n, source, save_mode, CASE lower(trim(dataset_split)) WHEN 'main' THEN 'main' WHEN 'quarantine' THEN 'quarantine' ELSE 'legacy' END AS k FROM fx_annotations),
w AS (SELECT *, CAST(CASE WHEN k = 'main' AND save_mode = 'normal' THEN 1 WHEN k = 'quarantine' THEN 0.8 WHEN k = 'legacy' THEN 0.85 ELSE 0.9 END AS DOUBLE) AS wt FROM p), g AS (SELECT page_id, row_number() OVER (ORDER BY page_id) - 1 AS slot, count(*) OVER () AS n FROM pages),
c AS (SELECT CAST(round_even((SELECT max(n) FROM p) * CAST(0.5 AS DOUBLE), 0) AS BIGINT) AS total), s AS (SELECT total, CAST(ceil(total * CAST(0.5 AS DOUBLE)) AS BIGINT) AS intra FROM c)
SELECT CAST(id AS VARCHAR) AS sample_id, 'positive' AS kind, k AS dataset_split, wt AS sample_weight FROM w
UNION ALL SELECT printf('INTRA_%06d', i), 'intra_negative', k, round(greatest(0.75, wt * CAST(0.95 AS DOUBLE)), 9) FROM s, range(s.intra) r(i) JOIN w ON w.slot = i % w.n
UNION ALL SELECT 'NEG_' || g.page_id, 'external_negative', 'negative_external', 1 FROM s, range(s.total - s.intra) r(i) JOIN g ON g.slot = i % g.n""",
)
def _(t):
    label = K.dataset_class(F.col("dataset_split"))
    positives = t.fx_annotations.select(
        F.col("id").cast("string").alias("sample_id"), "id", F.concat(F.lit("img/"), F.col("id")).alias("image_path"),
        F.concat(F.lit("mask/"), F.col("id")).alias("mask_path"), label.alias("dataset_split"), "save_mode", "source",
        X.base_weight(label, F.col("save_mode")).alias("sample_weight"),
    )
    external = t.pages.select("page_id", F.concat(F.lit("NEG_"), F.col("page_id")).alias("sample_id"), F.col("url").alias("image_path"), F.lit("external").alias("source"))
    negatives = S.round_robin_negatives(positives, external, ["id"], ["page_id"], 0.5)
    rows = B.training_rows(positives, negatives, validation=False)
    return rows.select("sample_id", "kind", "dataset_split", F.round("sample_weight", 9).alias("sample_weight"))


@query(
    "U17_policy_difference",
    """WITH a AS (SELECT o_orderkey AS k, o_custkey AS v FROM orders)
SELECT 'r' || k || '.min' AS name, CAST(v AS VARCHAR) AS "left", CAST(v + 1 AS VARCHAR) AS "right" FROM a WHERE k % 200 = 0 UNION ALL SELECT 'r' || k || '.only', NULL, 'true' FROM a WHERE k % 150 = 0""",
)
def _(t):
    """One document per rule; the two policies differ in some values, some keys and all checkpoint paths."""
    k, v = F.col("o_orderkey"), F.col("o_custkey")

    def doc(minimum, only, folder):
        body = F.struct(minimum.alias("min"), only.alias("only"), F.concat(F.lit(folder), k.cast("string"), F.lit(".PT")).alias("checkpoint"))
        name = F.concat(F.lit("r"), k.cast("string"))
        return t.orders.select(F.to_json(F.create_map(name, body)).alias("doc"))

    left = doc(v, F.lit(None).cast("boolean"), "/old/")
    right = doc(F.when(k % 200 == 0, v + 1).otherwise(v), F.when(k % 150 == 0, True), "/new/")
    return B.policy_difference(left, right, "doc")
