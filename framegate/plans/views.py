"""Views over the given tables in the shapes the operators expect.

The text runs in Spark (``{table}`` fields) and, with the braces removed, in the oracle.
"""

_VIEWS = {
    "fx_eval": """
SELECT id, split, gt_pixels, pred_pixels, inter_pixels, winner_source, via_fallback, via_rescue, eval_date FROM (
  SELECT b.*, CASE WHEN gt_pixels = 0 OR pred_pixels = 0 THEN CAST(0 AS BIGINT)
         ELSE CAST(FLOOR(LEAST(gt_pixels, pred_pixels) * (id % 11) / CAST(10 AS DOUBLE)) AS BIGINT) END AS inter_pixels
  FROM (SELECT o_orderkey AS id, o_orderpriority AS split, o_orderdate AS eval_date,
         CASE WHEN o_orderstatus = 'F' THEN CAST(0 AS BIGINT) ELSE 20 + o_custkey % 80 END AS gt_pixels,
         CASE WHEN o_custkey % 5 = 0 THEN CAST(0 AS BIGINT) ELSE 10 + o_orderkey % 90 END AS pred_pixels,
         CASE o_orderkey % 5 WHEN 0 THEN 'table_hough' WHEN 1 THEN 'reticle_global_0' WHEN 2 THEN 'reticle_global_1'
              WHEN 3 THEN 'white_blob' ELSE 'line_endpoint' END AS winner_source,
         o_custkey % 7 = 0 AS via_fallback, o_custkey % 11 = 0 AS via_rescue
        FROM {orders}) b) c""",
    "fx_scored": """
SELECT id, split, gt_pixels, pred_pixels, winner_source, via_fallback, via_rescue, eval_date,
  CASE WHEN gt_pixels + pred_pixels - inter_pixels = 0 THEN CAST(1 AS DOUBLE)
       ELSE CAST(inter_pixels AS DOUBLE) / CAST(gt_pixels + pred_pixels - inter_pixels AS DOUBLE) END AS iou,
  (2 * inter_pixels + 1) / CAST(gt_pixels + pred_pixels + 1 AS DOUBLE) AS dice
FROM {fx_eval}""",
    "fx_candidates": """
SELECT l_orderkey AS frame_id, 'crop_' || LPAD(CAST(l_linenumber AS STRING), 2, '0') AS candidate_id,
  CASE l_partkey % 5 WHEN 0 THEN 'table_hough' WHEN 1 THEN 'reticle_global_0' WHEN 2 THEN 'reticle_global_1'
       WHEN 3 THEN 'white_blob' ELSE 'line_endpoint' END AS candidate_source,
  CASE l_returnflag WHEN 'A' THEN 'primary' WHEN 'N' THEN 'fallback' ELSE 'rescue' END AS selector_pool,
  l_extendedprice / CAST(52500 AS DOUBLE) - CAST(1 AS DOUBLE) AS score, l_tax * 10 AS candidate_score, l_discount * 10 AS candidate_iou,
  CAST(l_quantity AS BIGINT) AS pred_pixels, l_partkey % 640 AS cx, l_suppkey * 4 AS cy, 7 + l_linenumber AS radius,
  l_linenumber AS pos, l_partkey, l_suppkey
FROM {lineitem}""",
    "fx_pool": """
SELECT l_orderkey AS frame_id, 'crop_' || LPAD(CAST(l_linenumber AS STRING), 2, '0') AS candidate_id,
  CASE l_partkey % 5 WHEN 0 THEN 'table_hough' WHEN 1 THEN 'reticle_global_0' WHEN 2 THEN 'reticle_global_1'
       WHEN 3 THEN 'white_blob' ELSE 'line_endpoint' END AS candidate_source,
  CASE l_returnflag WHEN 'A' THEN 'primary'
       WHEN 'N' THEN CASE l_suppkey % 3 WHEN 0 THEN 'fallback' WHEN 1 THEN 'fallback_rescue' ELSE 'secondary_rescue' END
       ELSE CASE l_suppkey % 5 WHEN 0 THEN 'rescue' WHEN 1 THEN 'reticle_fill_rescue' WHEN 2 THEN 'micro_line_rescue'
            WHEN 3 THEN 'colored_blob_rescue' ELSE 'wide' END END AS selector_pool,
  l_extendedprice / CAST(52500 AS DOUBLE) - CAST(1 AS DOUBLE) AS score, l_tax * 10 AS candidate_score, l_discount * 10 AS candidate_iou,
  CAST(l_quantity AS BIGINT) AS pred_pixels, CASE WHEN l_linenumber <> 3 THEN l_partkey % 640 / CAST(640 AS DOUBLE) END AS reach,
  l_orderkey AS row_key, l_linenumber AS pos, l_partkey, l_suppkey
FROM {lineitem}""",
    "fx_frames": """
SELECT user_id AS video_id, event_id AS frame_index, ts, value AS diff_score, event_type AS split,
  'C:/frames/video_' || CAST(user_id AS STRING) || '/clip_f' || LPAD(CAST(event_id AS STRING), 8, '0') || '.png' AS path
FROM {events}""",
    "fx_probs": """
SELECT d.doc_id AS id, d.source AS winner_source, d.lang AS split, l.quality AS target,
  (d.n_chars % 1000) / CAST(1000 AS DOUBLE) AS p, d.n_chars AS pred_pixels
FROM {documents} d JOIN {labels} l ON d.doc_id = l.doc_id""",
    "fx_annotations": """
SELECT doc_id AS id, source || '/' || lang || '/' || CAST(doc_id % 40 AS STRING) AS source_key, source AS source,
  CASE doc_id % 4 WHEN 0 THEN 'main' WHEN 1 THEN 'Quarantine ' WHEN 2 THEN '' ELSE 'main' END AS dataset_split,
  CASE WHEN doc_id % 3 = 0 THEN 'normal' ELSE 'force' END AS save_mode, doc_id % 6 = 0 AS refined,
  n_chars % 60 AS major_len, CASE WHEN doc_id % 13 = 0 THEN 0 ELSE n_chars END AS mask_area,
  '2026-' || LPAD(CAST(1 + doc_id % 12 AS STRING), 2, '0') || '-' || LPAD(CAST(1 + n_chars % 28 AS STRING), 2, '0') || 'T00:00:00Z' AS created_at
FROM {documents}""",
    "fx_history": """
SELECT event_type AS run, CAST(EXTRACT(DAY FROM ts) AS INT) AS epoch, ROUND(AVG(value) / CAST(500 AS DOUBLE), 9) AS val_dice, COUNT(*) AS n
FROM {events} GROUP BY event_type, CAST(EXTRACT(DAY FROM ts) AS INT)""",
}

_PIXELS = """
SELECT p_partkey AS frame_id, side, (p_partkey % 50) + i + CASE WHEN side = 'pred' THEN p_size % 3 ELSE 0 END AS x,
  (p_partkey % 30) + CAST(FLOOR(i * (p_partkey % 7) / CAST(7 AS DOUBLE)) AS BIGINT) AS y
FROM (SELECT p_partkey, p_size, s.side, {generator} AS i
      FROM {part} CROSS JOIN (SELECT 'gt' AS side UNION ALL SELECT 'pred' AS side) s)"""

SPARK_VIEWS = dict(_VIEWS)
SPARK_VIEWS["fx_pixels"] = _PIXELS.replace(
    "{generator}", "EXPLODE(SEQUENCE(CAST(0 AS BIGINT), CAST(p_size - 1 AS BIGINT)))"
)

DUCK_VIEWS = {name: text.replace("{", "").replace("}", "") for name, text in _VIEWS.items()}
DUCK_VIEWS["fx_pixels"] = (
    _PIXELS.replace("{generator}", "UNNEST(RANGE(p_size))").replace("{", "").replace("}", "")
)
