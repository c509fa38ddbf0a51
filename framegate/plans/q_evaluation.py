"""Queries for the evaluation of a board from the candidate pool to the gate."""

from pyspark.sql import functions as F

from framegate.operators import cascade as C
from framegate.operators import evaluation as V
from framegate.plans.q_cascade import cascade, cascade_sql
from framegate.plans.q_metrics import gate_sql, rounded
from framegate.plans.registry import query

# A candidate's mask lies along the true line of its frame, shifted by the candidate's own numbers.
_ROWS_SQL = f"""win AS MATERIALIZED ({cascade_sql("post_final_rules")}),
mask AS (SELECT DISTINCT frame_id, frame_id % 50 + l_partkey % 5 + i AS x, frame_id % 30 + CAST(floor(i * (frame_id % 7) / CAST(7 AS DOUBLE)) AS BIGINT) + l_suppkey % 2 AS y
  FROM (SELECT p.*, unnest(range(pred_pixels)) AS i FROM fx_pool p JOIN win w ON w.frame_id = p.frame_id AND w.candidate_id = p.candidate_id WHERE w.final_pixels > 0)),
gt AS (SELECT DISTINCT frame_id, x, y FROM fx_pixels WHERE side = 'gt'),
n AS (SELECT o_orderkey AS id, o_orderpriority AS split, (SELECT count(*) FROM gt WHERE gt.frame_id = o_orderkey) AS gt_pixels,
  (SELECT count(*) FROM mask WHERE mask.frame_id = o_orderkey) AS pred_pixels,
  (SELECT count(*) FROM mask JOIN gt ON gt.frame_id = mask.frame_id AND gt.x = mask.x AND gt.y = mask.y WHERE mask.frame_id = o_orderkey) AS i FROM orders),
ev AS (SELECT id, split, gt_pixels, pred_pixels, CASE WHEN gt_pixels + pred_pixels = i THEN 1 ELSE i / CAST(gt_pixels + pred_pixels - i AS DOUBLE) END AS iou,
  (2 * i + 1) / CAST(gt_pixels + pred_pixels + 1 AS DOUBLE) AS dice, win.candidate_id AS winner_id, win.candidate_source AS winner_source, win.score AS winner_score, win.flags AS winner_flags
  FROM n LEFT JOIN win ON win.frame_id = n.id)"""


def evaluated(t):
    board = t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("split"), F.col("o_orderkey").alias("frame_id"))
    frame = F.col("frame_id")

    def masks(shown):
        own = t.fx_pool.join(shown, ["frame_id", "candidate_id"], "left_semi")
        along = own.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("pred_pixels").cast("int") - 1)))
        rise = F.floor(F.col("i") * (frame % 7) / F.lit(7.0)).cast("bigint")
        return along.select(
            "frame_id", "candidate_id", (frame % 50 + F.col("l_partkey") % 5 + F.col("i")).alias("x"),
            (frame % 30 + rise + F.col("l_suppkey") % 2).alias("y"),
        )

    truth = t.fx_pixels.filter("side = 'gt'").select("frame_id", "x", "y")
    return V.evaluate_board(board, C.report(cascade(t)), masks, truth)


@query(
    "A1_board_evaluation",
    f"""WITH {_ROWS_SQL}
SELECT id, split, gt_pixels, pred_pixels, round(iou, 6) AS iou, round(dice, 6) AS dice, winner_id, winner_source, winner_score, winner_flags,
  CASE WHEN gt_pixels <= 0 THEN CASE WHEN pred_pixels <= 0 THEN 'true_negative' ELSE 'negative_false_positive' END
  WHEN iou >= 0.5 THEN 'success' WHEN pred_pixels <= 0 THEN 'positive_no_prediction' WHEN iou <= 0 THEN 'positive_zero_iou_wrong_prediction' ELSE 'positive_partial_miss' END AS failure_type
FROM ev""",
)
def _(t):
    rows = rounded(evaluated(t).withColumn("winner_score", F.round("winner_score", 9)).drop("frame_id"), 9)
    flags = F.array_join(F.array_sort("winner_flags"), ",")
    return rows.withColumns({"iou": F.round("iou", 6), "dice": F.round("dice", 6), "winner_flags": flags})


@query("A1_board_gate", f"WITH {_ROWS_SQL}\n" + gate_sql("ev", "CASE WHEN grouping(split) = 1 THEN 'overall' ELSE split END AS scope", "ROLLUP (split)"))
def _(t):
    return rounded(V.evaluation_report(evaluated(t)).drop(*V.COUNT_MAPS.values()))
