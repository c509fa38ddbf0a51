"""Queries for ranking, sampling, sequences and splits."""

from pyspark.sql import functions as F

from framegate.functions.keys import frame_group_key, size_bucket_index
from framegate.operators import metrics as M
from framegate.operators import ranking as W
from framegate.operators import sequences as Q
from framegate.operators import splits as X
from framegate.plans.common import WINNER_SQL, frame_winners
from framegate.plans.registry import query

AT = ["pos", "l_partkey", "l_suppkey"]


@query(
    "W1_frame_winner",
    f"""WITH r AS (SELECT frame_id, candidate_id FROM fx_candidates QUALIFY row_number() OVER (PARTITION BY frame_id ORDER BY candidate_score DESC, pos, l_partkey, l_suppkey, score) = 1)
SELECT w.frame_id, w.candidate_id AS heuristic_id, r.candidate_id AS reranked_id, round(w.score, 9) AS score FROM {WINNER_SQL} w JOIN r USING (frame_id)""",
)
def _(t):
    heuristic = frame_winners(t.fx_candidates).select("frame_id", F.col("candidate_id").alias("heuristic_id"), F.round("score", 9).alias("score"))
    reranked = W.top_per_key(t.fx_candidates, ["frame_id"], [F.desc("candidate_score"), *AT, "score"])
    return heuristic.join(reranked.select("frame_id", F.col("candidate_id").alias("reranked_id")), "frame_id")


@query(
    "W2_top_candidates",
    """WITH a AS (SELECT frame_id, candidate_id, row_number() OVER (PARTITION BY frame_id ORDER BY candidate_iou DESC, score DESC, pos, l_partkey, l_suppkey) AS i,
  row_number() OVER (PARTITION BY frame_id ORDER BY score DESC, pos, l_partkey, l_suppkey) AS s FROM fx_candidates)
SELECT frame_id, string_agg(candidate_id, ',' ORDER BY i) FILTER (WHERE i <= 8) AS by_iou, string_agg(candidate_id, ',' ORDER BY s) FILTER (WHERE s <= 8) AS by_score FROM a GROUP BY frame_id""",
)
def _(t):
    def top(order, name):
        rows = W.top_per_key(t.fx_candidates, ["frame_id"], order, 8, rank="rn")
        items = F.array_sort(F.collect_list(F.struct("rn", "candidate_id")))  # at most eight
        return rows.groupBy("frame_id").agg(F.array_join(items["candidate_id"], ",").alias(name))

    by_iou = top([F.desc("candidate_iou"), F.desc("score"), *AT], "by_iou")
    return by_iou.join(top([F.desc("score"), *AT], "by_score"), "frame_id")


@query("W3_worst_rows", "SELECT id, split, round(iou, 9) AS iou, pred_pixels FROM fx_scored ORDER BY fx_scored.iou, pred_pixels DESC, id LIMIT 25")
def _(t):
    rows = W.worst(t.fx_scored, ["iou", F.desc("pred_pixels"), "id"], 25)
    return rows.select("id", "split", F.round("iou", 9).alias("iou"), "pred_pixels")


@query(
    "W4_top_clamped",
    "SELECT * FROM (SELECT 'top' AS kind, id, mask_area FROM fx_annotations ORDER BY mask_area DESC, id LIMIT 48) UNION ALL SELECT * FROM (SELECT 'one', id, mask_area FROM fx_annotations ORDER BY mask_area DESC, id LIMIT 1)",
)
def _(t):
    order = [F.desc("mask_area"), "id"]
    top = W.top_clamped(t.fx_annotations, order, 48).select(F.lit("top").alias("kind"), "id", "mask_area")
    return top.unionByName(W.top_clamped(t.fx_annotations, order, 0).select(F.lit("one").alias("kind"), "id", "mask_area"))


@query("W5_limit_per_split", "SELECT id, split FROM fx_eval QUALIFY row_number() OVER (PARTITION BY split ORDER BY id) <= 40")
def _(t):
    return W.top_per_key(t.fx_eval.select("id", "split"), ["split"], ["id"], 40)


@query(
    "W6_every_nth",
    """SELECT 'all' AS kind, video_id, frame_index FROM fx_frames WHERE frame_index >= 30 AND (frame_index - 30) % 7 = 0
UNION ALL SELECT 'capped', video_id, frame_index FROM fx_frames WHERE frame_index % 6 = 0 QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY frame_index) <= 5""",
)
def _(t):
    frames = t.fx_frames.select("video_id", "frame_index")
    every = W.every_nth(frames, ["video_id"], "frame_index", 7, start=30)
    step = W.stride_for_rate(29.97, 5.0)
    capped = W.every_nth(frames, ["video_id"], "frame_index", step, max_rows=5)
    return every.select(F.lit("all").alias("kind"), "*").unionByName(capped.select(F.lit("capped").alias("kind"), "*"))


_THIN_SQL = """WITH RECURSIVE f AS (SELECT video_id, frame_index, diff_score, row_number() OVER (PARTITION BY video_id ORDER BY frame_index) AS rn FROM fx_frames),
r(video_id, rn, frame_index, diff_score, li, lv, decision, score) AS (
  SELECT video_id, rn, frame_index, diff_score, frame_index, diff_score, 'kept', CAST(NULL AS DOUBLE) FROM f WHERE rn = 1
  UNION ALL SELECT f.video_id, f.rn, f.frame_index, f.diff_score,
    CASE WHEN f.frame_index - r.li < {gap} OR abs(f.diff_score - r.lv) < {thr} THEN r.li ELSE f.frame_index END,
    CASE WHEN f.frame_index - r.li < {gap} OR abs(f.diff_score - r.lv) < {thr} THEN r.lv ELSE f.diff_score END,
    CASE WHEN f.frame_index - r.li < {gap} THEN 'gap' WHEN abs(f.diff_score - r.lv) < {thr} THEN 'dedup' ELSE 'kept' END,
    CASE WHEN f.frame_index - r.li < {gap} THEN NULL ELSE abs(f.diff_score - r.lv) END
  FROM r JOIN f ON f.video_id = r.video_id AND f.rn = r.rn + 1)
"""


def thin_sql(gap, thr):
    return _THIN_SQL.replace("{gap}", str(gap)).replace("{thr}", f"CAST({thr} AS DOUBLE)")


@query("W7_thin_sequence", thin_sql(150, 20.0) + "SELECT video_id, frame_index, decision, round(score, 6) AS score FROM r")
def _(t):
    rows = Q.thin_sequence(t.fx_frames, "video_id", "frame_index", "diff_score", 150, 20.0)
    return rows.select("video_id", "frame_index", "decision", F.round("score", 6).alias("score"))


@query("W7_thin_chunked", thin_sql(150, 20.0) + "SELECT video_id, frame_index, decision, round(score, 6) AS score FROM r")
def _(t):
    rows = Q.thin_sequence(t.fx_frames, "video_id", "frame_index", "diff_score", 150, 20.0, chunk=2_000)
    return rows.select("video_id", "frame_index", "decision", F.round("score", 6).alias("score"))


@query("W7_gap_only", thin_sql(400, -1.0) + "SELECT video_id, frame_index FROM r WHERE decision = 'kept'")
def _(t):
    rows = Q.thin_sequence(t.fx_frames, "video_id", "frame_index", "diff_score", 400, -1.0)
    return rows.filter("decision = 'kept'").select("video_id", "frame_index")


@query(
    "A25_sampling_statistics",
    thin_sql(150, 20.0) + """SELECT video_id, count(*) AS frames_read, count(*) AS frames_sampled, count(*) FILTER (WHERE decision = 'kept') AS frames_saved, count(*) FILTER (WHERE decision = 'gap') AS frames_skipped_min_gap,
  count(*) FILTER (WHERE decision = 'dedup') AS frames_skipped_dedup, round(coalesce(avg(score) FILTER (WHERE decision = 'kept'), 0), 6) AS avg_kept_diff_score, round(coalesce(avg(score) FILTER (WHERE decision = 'dedup'), 0), 6) AS avg_skipped_diff_score FROM r GROUP BY video_id""",
)
def _(t):
    rows = Q.thin_sequence(t.fx_frames, "video_id", "frame_index", "diff_score", 150, 20.0)
    stats = M.sampling_statistics(rows, "video_id")
    return stats.withColumns({c: F.round(c, 6) for c in ("avg_kept_diff_score", "avg_skipped_diff_score")})


@query(
    "W8_keep_first",
    """SELECT 'source' AS kind, frame_id, pos, l_partkey FROM fx_candidates QUALIFY row_number() OVER (PARTITION BY frame_id, candidate_source ORDER BY pos, l_partkey, l_suppkey, score) = 1
UNION ALL SELECT 'five', frame_id, pos, l_partkey FROM fx_candidates QUALIFY row_number() OVER (PARTITION BY candidate_id, candidate_source, selector_pool, pred_pixels, round(score, 1) ORDER BY frame_id, pos, l_partkey, l_suppkey, score) = 1""",
)
def _(t):
    rows = t.fx_candidates
    first = W.keep_first(rows, ["frame_id", "candidate_source"], [*AT, "score"])
    five = rows.withColumn("rounded", F.round("score", 1))
    five = W.keep_first(five, ["candidate_id", "candidate_source", "selector_pool", "pred_pixels", "rounded"], ["frame_id", *AT, "score"])
    columns = ["frame_id", "pos", "l_partkey"]
    return first.select(F.lit("source").alias("kind"), *columns).unionByName(five.select(F.lit("five").alias("kind"), *columns))


_FRACTION = "CAST(('0x' || substr(sha1({k}), 1, 12)) AS BIGINT) / CAST(281474976710655 AS DOUBLE)"


@query(
    "W13_group_holdout",
    f"""WITH g AS (SELECT video_id, frame_index, 'C:/frames/video_' || video_id || '/clip:bucket' || lpad(CAST(frame_index // 25 AS VARCHAR), 8, '0') AS group_key FROM fx_frames)
SELECT 'share' AS kind, video_id, frame_index FROM g WHERE {_FRACTION.replace("{k}", "group_key")} < 0.2
UNION ALL SELECT 'first', video_id, frame_index FROM g WHERE group_key = (SELECT min(group_key) FROM g)""",
)
def _(t):
    items = t.fx_frames.select("video_id", "frame_index", frame_group_key(F.col("path")).alias("group_key"))

    def pick(fraction, kind):
        return X.group_holdout(items, "group_key", fraction).select(F.lit(kind).alias("kind"), "video_id", "frame_index")

    return pick(0.2, "share").unionByName(pick(0.0, "first"))


@query(
    "W14_random_split",
    """SELECT id, CASE WHEN row_number() OVER (ORDER BY sha1('42|' || id), id) <= greatest(1, CAST(round_even((SELECT count(*) FROM fx_annotations) * CAST(0.15 AS DOUBLE), 0) AS BIGINT)) THEN 'val' ELSE 'train' END AS split FROM fx_annotations""",
)
def _(t):
    return X.random_split(t.fx_annotations.select("id"), "id", 0.15, 42)


@query(
    "W15_stratified_split",
    """WITH s AS (SELECT id, source, CASE WHEN major_len < 12 THEN 0 WHEN major_len < 20 THEN 1 WHEN major_len < 40 THEN 2 ELSE 3 END AS b FROM fx_annotations),
r AS (SELECT *, row_number() OVER (PARTITION BY b, source ORDER BY sha1('42|' || id), id) AS rn, count(*) OVER (PARTITION BY b, source) AS n FROM s)
SELECT id, CASE WHEN n > 1 AND rn <= least(greatest(1, CAST(round_even(n * CAST(0.15 AS DOUBLE), 0) AS BIGINT)), n - 1) THEN 'val' ELSE 'train' END AS split FROM r""",
)
def _(t):
    strata = {"size": size_bucket_index(F.col("major_len"), (12, 20, 40)), "source": F.col("source")}
    return X.stratified_split(t.fx_annotations, "id", strata, 0.15, 42).select("id", "split")


@query(
    "W16_class_split",
    """WITH r AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY sha1('7|' || id), id) AS rn, count(*) OVER (PARTITION BY target) AS n FROM fx_probs)
SELECT id, target, CASE WHEN n > 1 AND rn <= greatest(1, CAST(round_even(n * CAST(0.2 AS DOUBLE), 0) AS BIGINT)) THEN 'val' ELSE 'train' END AS split FROM r""",
)
def _(t):
    rows = t.fx_probs.select("id", "target")
    return X.stratified_split(rows, "id", {"target": F.col("target")}, 0.2, 7, keep_train=False)


@query(
    "W17_temporal_split",
    """SELECT id, CASE WHEN row_number() OVER (ORDER BY created_at, source, id) <= greatest(1, least((SELECT count(*) FROM fx_annotations) - 1, CAST(round_even((SELECT count(*) FROM fx_annotations) * CAST(0.85 AS DOUBLE), 0) AS BIGINT))) THEN 'train' ELSE 'val' END AS split FROM fx_annotations""",
)
def _(t):
    return X.temporal_split(t.fx_annotations.select("id", "created_at", "source"), ["created_at", "source", "id"], 0.15).select("id", "split")


@query(
    "W18_cap_per_frame",
    """WITH k AS (SELECT *, frame_id || ':' || pos || ':' || l_partkey || ':' || l_suppkey AS k FROM fx_candidates WHERE candidate_iou < 0.5)
SELECT frame_id, pos, l_partkey, l_suppkey FROM k QUALIFY row_number() OVER (PARTITION BY frame_id ORDER BY sha1('3|' || k), k) <= 2""",
)
def _(t):
    rows = t.fx_candidates.filter("candidate_iou < 0.5").withColumn("k", F.concat_ws(":", "frame_id", *AT))
    return W.cap_per_key(rows, ["frame_id"], "k", 2, 3).select("frame_id", *AT)


@query(
    "W19_round_robin",
    """WITH p AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS slot, count(*) OVER () AS n FROM fx_annotations WHERE mask_area > 0),
g AS (SELECT page_id, row_number() OVER (ORDER BY page_id) - 1 AS slot, count(*) OVER () AS n FROM pages),
c AS (SELECT CAST(round_even((SELECT max(n) FROM p) * CAST(1.5 AS DOUBLE), 0) AS BIGINT) AS total), s AS (SELECT total, CAST(ceil(total * CAST(0.5 AS DOUBLE)) AS BIGINT) AS intra FROM c)
SELECT 'intra_negative' AS kind, i AS position, p.id AS source_id FROM s, range(s.intra) r(i) JOIN p ON p.slot = i % p.n
UNION ALL SELECT 'external_negative', i, g.page_id FROM s, range(s.total - s.intra) r(i) JOIN g ON g.slot = i % g.n""",
)
def _(t):
    positives = t.fx_annotations.filter("mask_area > 0").select("id", F.col("id").alias("source_id"))
    negatives = t.pages.select("page_id", F.col("page_id").alias("source_id"))
    rows = X.round_robin_negatives(positives, negatives, ["id"], ["page_id"], 1.5)
    return rows.select("kind", "position", "source_id")


@query(
    "W20_early_stopping",
    """WITH RECURSIVE h AS (SELECT run, epoch, val_dice, row_number() OVER (PARTITION BY run ORDER BY epoch, val_dice) AS rn FROM fx_history),
r(run, rn, best, be, stale, stop) AS (SELECT run, CAST(0 AS BIGINT), CAST('-infinity' AS DOUBLE), CAST(NULL AS BIGINT), 0, CAST(NULL AS BIGINT) FROM (SELECT DISTINCT run FROM h)
  UNION ALL SELECT h.run, h.rn, CASE WHEN h.val_dice > r.best + 0.0005 THEN h.val_dice ELSE r.best END, CASE WHEN h.val_dice > r.best + 0.0005 THEN h.epoch ELSE r.be END,
    CASE WHEN h.val_dice > r.best + 0.0005 THEN 0 ELSE r.stale + 1 END, CASE WHEN h.val_dice > r.best + 0.0005 THEN NULL WHEN r.stale + 1 >= 6 THEN h.epoch END
  FROM r JOIN h ON h.run = r.run AND h.rn = r.rn + 1 WHERE r.stop IS NULL)
SELECT run, be AS best_epoch, best AS best_value, stop AS stop_epoch FROM r QUALIFY row_number() OVER (PARTITION BY run ORDER BY rn DESC) = 1""",
)
def _(t):
    return W.early_stopping(t.fx_history, "run", "epoch", "val_dice", 0.0005, 6)


@query(
    "W21_best_epoch",
    """SELECT run, epoch, round(val_dice + 0.5 * (n % 10) / 100, 9) AS selection_key FROM fx_history QUALIFY row_number() OVER (PARTITION BY run ORDER BY val_dice + CAST(0.5 AS DOUBLE) * (n % 10) / 100 DESC, epoch) = 1""",
)
def _(t):
    best = W.best_epoch(t.fx_history, "run", "epoch", F.col("val_dice") + F.lit(0.5) * (F.col("n") % 10) / 100)
    return best.select("run", "epoch", F.round("selection_key", 9).alias("selection_key"))


_EMA_SQL = """WITH RECURSIVE f AS (SELECT video_id, frame_index, diff_score, row_number() OVER (PARTITION BY video_id ORDER BY frame_index) AS rn FROM fx_frames),
r(video_id, rn, frame_index, a) AS (SELECT video_id, rn, frame_index, diff_score FROM f WHERE rn = 1
  UNION ALL SELECT f.video_id, f.rn, f.frame_index, r.a * CAST(0.9 AS DOUBLE) + f.diff_score * CAST(0.1 AS DOUBLE) FROM r JOIN f ON f.video_id = r.video_id AND f.rn = r.rn + 1)
SELECT video_id, frame_index, round(a + CAST(0.00000037 AS DOUBLE), 5) AS average FROM r"""


@query("W22_moving_average", _EMA_SQL)
def _(t):
    rows = Q.moving_average(t.fx_frames, "video_id", "frame_index", "diff_score", chunk=1_500)
    # The first averages have few decimals; a small shift keeps both sides off rounding ties.
    return rows.select("video_id", "frame_index", F.round(F.col("average") + 0.00000037, 5).alias("average"))


@query(
    "W23_multi_key_ranking",
    """SELECT frame_id, candidate_id, l_partkey, rn FROM (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY candidate_iou DESC, CASE WHEN pos = 3 THEN -1 ELSE score END DESC, candidate_score DESC, radius, pred_pixels, pos, l_partkey, l_suppkey, score) AS rn FROM fx_candidates) WHERE rn <= 12""",
)
def _(t):
    known = F.when(F.col("pos") != 3, F.col("score"))
    order = [F.desc("candidate_iou"), F.coalesce(known, F.lit(-1.0)).desc(), F.desc("candidate_score"), "radius", "pred_pixels", *AT, "score"]
    rows = W.top_per_key(t.fx_candidates, ["frame_id"], order, 12, rank="rn")
    return rows.select("frame_id", "candidate_id", "l_partkey", F.col("rn").cast("bigint").alias("rn"))


@query("W25_hash_sample", "SELECT page_id FROM pages ORDER BY sha1('11|' || page_id), page_id LIMIT 32")
def _(t):
    return W.hash_sample(t.pages.select("page_id"), "page_id", 32, 11)


@query(
    "W26_resolve_split",
    """SELECT id, CASE WHEN id % 5 = 0 THEN 'val' ELSE 'train' END AS split, 'loaded_existing' AS reason FROM fx_annotations WHERE id % 5 < 3
UNION ALL SELECT id, CASE WHEN row_number() OVER (ORDER BY sha1('42|' || id), id) <= greatest(1, CAST(round_even((SELECT count(*) FROM fx_annotations) * CAST(0.15 AS DOUBLE), 0) AS BIGINT)) THEN 'val' ELSE 'train' END, 'fallback_random_missing_existing' FROM fx_annotations""",
)
def _(t):
    rows = t.fx_annotations.select("id")
    side = F.when(F.col("id") % 5 == 0, "val").otherwise("train")
    stored = rows.filter("id % 5 < 3").withColumn("split", side)
    both = stored.unionByName(rows.filter("id % 5 = 1").withColumn("split", F.lit("val")))
    loaded, why = X.resolve_split(rows, "id", both, 0.15, 42)
    drawn, fallback = X.resolve_split(rows, "id", stored.filter("split = 'train'"), 0.15, 42)
    return loaded.withColumn("reason", F.lit(why)).unionByName(drawn.withColumn("reason", F.lit(fallback)))


@query(
    "W27_weighted_choice",
    """WITH d AS (SELECT id, major_len, CAST(('0x' || substr(sha1('crop|' || id), 1, 12)) AS BIGINT) / CAST(281474976710656 AS DOUBLE) AS u FROM fx_annotations)
SELECT id, CASE WHEN major_len > 0 AND major_len < 12 THEN CASE WHEN u <= 0.6 THEN 'tight' WHEN u <= CAST(0.6 AS DOUBLE) + CAST(0.3 AS DOUBLE) THEN 'context' ELSE 'context' END
  ELSE CASE WHEN u <= 0.3 THEN 'tight' WHEN u <= CAST(0.3 AS DOUBLE) + CAST(0.45 AS DOUBLE) THEN 'context' WHEN u <= 1 THEN 'fullframe' ELSE 'context' END END AS crop_mode FROM d""",
)
def _(t):
    key = F.concat(F.lit("crop|"), F.col("id").cast("string"))
    tiny = (F.col("major_len") > 0) & (F.col("major_len") < 12)
    mixes = [(tiny, {"tight": 0.6, "context": 0.3}), (F.lit(True), {"tight": 0.3, "context": 0.45, "fullframe": 0.25})]
    mode = X.weighted_choice(key, mixes, ("tight", "context", "fullframe"), "context")
    return t.fx_annotations.select("id", mode.alias("crop_mode"))


@query(
    "W28_resume_from",
    """WITH r AS (SELECT page_id, url, row_number() OVER (ORDER BY url, page_id) - 1 AS position FROM pages)
SELECT 'path' AS kind, page_id, position FROM r WHERE position >= (SELECT min(position) FROM r WHERE lower(url) = (SELECT lower(url) FROM pages WHERE page_id = 17))
UNION ALL SELECT 'index', page_id, position FROM r WHERE position >= least(200, (SELECT max(position) FROM r)) UNION ALL SELECT 'clamped', page_id, position FROM r WHERE position = (SELECT max(position) FROM r)""",
)
def _(t):
    pages = t.pages.select("page_id", "url")
    last = pages.filter("page_id = 17").first()["url"]  # the resume state is one row
    order = ["url", "page_id"]

    def work(kind, **at):
        return W.resume_from(pages, order, "url", **at).select(F.lit(kind).alias("kind"), "page_id", "position")

    rows = work("path", last_path=last.upper()).unionByName(work("index", last_path="gone", last_index=200))
    return rows.unionByName(work("clamped", start=10_000_000))
