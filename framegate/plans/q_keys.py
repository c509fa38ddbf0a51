"""Queries for the key, path, string and JSON functions."""

from pyspark.sql import functions as F

from framegate.functions import keys as K
from framegate.operators.documents import flatten_numeric
from framegate.plans.registry import query


@query(
    "P1_normalize_path",
    r"""SELECT frame_index, '/mnt/c/' || substr(path, 4) AS posix_path, path AS round_trip,
  '/mnt/c/' || substr(path, 4) AS from_backslash FROM fx_frames""",
)
def _(t):
    posix = K.normalize_path(F.col("path"))
    back = K.normalize_path(F.translate("path", "/", "\\"))
    return t.fx_frames.select(
        "frame_index", posix.alias("posix_path"), K.normalize_path(posix, "windows").alias("round_trip"),
        back.alias("from_backslash"),
    )


@query("P2_canonical_path_key", r"SELECT page_id, replace(lower(url), '/', chr(92)) AS path_key FROM pages")
def _(t):
    return t.pages.select("page_id", K.canonical_path_key(F.col("url")).alias("path_key"))


@query(
    "P3_output_stem",
    """SELECT frame_index, 'video_' || video_id || '__clip_f' || lpad(CAST(frame_index AS VARCHAR), 8, '0') AS stem,
  'clip_f' || lpad(CAST(frame_index AS VARCHAR), 8, '0') AS outside_stem FROM fx_frames""",
)
def _(t):
    return t.fx_frames.select(
        "frame_index",
        K.output_stem(F.col("path"), "C:/frames").alias("stem"),
        K.output_stem(F.col("path"), "D:/other").alias("outside_stem"),
    )


@query(
    "P4_sanitize_stem",
    """SELECT page_id, coalesce(nullif(trim(regexp_replace(url, '[^0-9A-Za-z_-]+', '_', 'g'), '_'), ''), 'clip') AS stem
FROM pages""",
)
def _(t):
    return t.pages.select("page_id", K.sanitize_stem(F.col("url")).alias("stem"))


@query(
    "P5_frame_group_key",
    """SELECT frame_index, 'C:/frames/video_' || video_id || '/clip:bucket' ||
  lpad(CAST(frame_index // 25 AS VARCHAR), 8, '0') AS group_key,
  'C:/frames/video_' || video_id || '/still' AS plain_key, './clip:bucket' || lpad(CAST(frame_index // 25 AS VARCHAR), 8, '0') AS bare_key,
  'still' AS bare_plain_key, 'C:/frames/video_' || video_id || '/clip:bucket' || lpad(CAST(frame_index // 25 AS VARCHAR), 8, '0') AS back_key FROM fx_frames""",
)
def _(t):
    path = F.col("path")
    forms = {
        "group_key": path, "plain_key": F.concat(K.parent_dir(path), F.lit("/still.png")), "bare_key": K.file_name(path),
        "bare_plain_key": F.lit("still.png"), "back_key": F.translate(path, "/", "\\"),
    }
    return t.fx_frames.select("frame_index", *(K.frame_group_key(p).alias(name) for name, p in forms.items()))


@query(
    "P6_source_group",
    """WITH s AS (SELECT frame_id, pos, l_partkey, l_suppkey, CASE WHEN l_suppkey % 4 = 0 THEN 'external_main_x'
  WHEN l_suppkey % 4 = 1 THEN 'external_tiny' ELSE candidate_source END AS src FROM fx_candidates)
SELECT frame_id, pos, l_partkey, l_suppkey,
  CASE WHEN src LIKE 'reticle_global%' THEN 'reticle_global' ELSE src END AS band_group,
  CASE WHEN src LIKE 'reticle_global%' THEN 'reticle_global' WHEN src LIKE 'external_main%' THEN 'external_main'
       WHEN src LIKE 'external_tiny%' THEN 'external_tiny' ELSE src END AS model_group,
  src = 'reticle_global' OR starts_with(src, 'reticle_global_') OR src = 'white_blob' AS rule_match FROM s""",
)
def _(t):
    src = (
        F.when(F.col("l_suppkey") % 4 == 0, "external_main_x")
        .when(F.col("l_suppkey") % 4 == 1, "external_tiny")
        .otherwise(F.col("candidate_source"))
    )
    return t.fx_candidates.select(
        "frame_id", "pos", "l_partkey", "l_suppkey",
        K.candidate_source_group(src).alias("band_group"),
        K.model_source_group(src).alias("model_group"),
        K.source_matches(src, exact="white_blob", group="reticle_global").alias("rule_match"),
    )


@query(
    "P7_size_bucket",
    """SELECT id, CASE WHEN major_len < 12 THEN '<12' WHEN major_len < 20 THEN '<20' WHEN major_len < 40 THEN '<40'
  ELSE '>=40' END AS label, CASE WHEN major_len < 12 THEN 0 WHEN major_len < 20 THEN 1 WHEN major_len < 40 THEN 2
  ELSE 3 END AS bucket, 'all' AS unbounded FROM fx_annotations""",
)
def _(t):
    length = F.col("major_len")
    return t.fx_annotations.select(
        "id",
        K.size_bucket_label(length, (40, 12, 20)).alias("label"),
        K.size_bucket_index(length, (40, 12, 20)).alias("bucket"),
        K.size_bucket_label(length, ()).alias("unbounded"),
    )


@query(
    "P8_stable_fraction",
    """WITH h AS (SELECT page_id, CAST(('0x' || substr(sha1(url), 1, 12)) AS BIGINT) AS v FROM pages)
SELECT page_id, v / CAST(281474976710655 AS DOUBLE) AS fraction, v / CAST(281474976710656 AS DOUBLE) AS half_open FROM h""",
)
def _(t):
    url = F.col("url")
    return t.pages.select(
        "page_id", K.stable_fraction(url).alias("fraction"),
        K.stable_fraction(url, K.HASH_BITS_SPAN).alias("half_open"),
    )


@query(
    "P9_base_sample_id",
    "SELECT frame_id, pos, l_partkey, l_suppkey, 'frame' || frame_id AS base_id FROM fx_candidates",
)
def _(t):
    sample = F.concat(F.lit("frame"), F.col("frame_id").cast("string"), F.lit("_"), F.col("candidate_id"))
    return t.fx_candidates.select("frame_id", "pos", "l_partkey", "l_suppkey", K.base_sample_id(sample).alias("base_id"))


@query(
    "P10_tiny_line_flag",
    """SELECT id, mask_area > 0 AND (mask_area / CAST(640 * 360 AS DOUBLE) <= 0.002
  OR greatest(major_len * 2, major_len // 3, 1) <= 90) AS tiny FROM fx_annotations""",
)
def _(t):
    return t.fx_annotations.select(
        "id",
        K.tiny_line_flag(
            F.col("mask_area"), F.lit(640), F.lit(360), F.col("major_len") * 2, F.floor(F.col("major_len") / 3)
        ).alias("tiny"),
    )


_DOC = """to_json(named_struct('score', o_totalprice, 'kind', o_orderstatus, 'ok', o_orderkey % 2 = 0,
  'features', named_struct('area', o_custkey, 'deep', named_struct('touch', o_custkey % 7 + 0.5D)),
  'box', array(o_orderkey, o_custkey), 'long', array(1, 2, 3, 4, 5, 6, 7), 'mask', named_struct('z', 1),
  'selected_via_fallback', o_custkey % 7 = 0, 'selected_via_rescue', o_custkey % 11 = 0,
  'none', CAST(NULL AS INT), 'fallback_pred_area', o_custkey % 50, 'rescue_pred_pixels', o_orderkey % 60,
  'pre_rescue_pred_area', 9999)) AS doc"""


def order_docs(t):
    """One nested JSON document per order."""
    return t.sql("SELECT o_orderkey AS id, " + _DOC + " FROM {orders}")


@query(
    "P11_flatten_numeric",
    """SELECT o_orderkey AS id, u.name, CAST(u.value AS DOUBLE) AS value FROM orders, (SELECT UNNEST([
  {'name': 'score', 'value': o_totalprice}, {'name': 'features.area', 'value': CAST(o_custkey AS DOUBLE)},
  {'name': 'features.deep.touch', 'value': o_custkey % 7 + 0.5}, {'name': 'box.0', 'value': CAST(o_orderkey AS DOUBLE)},
  {'name': 'box.1', 'value': CAST(o_custkey AS DOUBLE)},
  {'name': 'fallback_pred_area', 'value': CAST(o_custkey % 50 AS DOUBLE)},
  {'name': 'rescue_pred_pixels', 'value': CAST(o_orderkey % 60 AS DOUBLE)},
  {'name': 'pre_rescue_pred_area', 'value': CAST(9999 AS DOUBLE)}]) AS u)
UNION ALL SELECT -1 - event_id, 'k', CAST(json_extract(props, '$.k') AS DOUBLE) FROM events""",
)
def _(t):
    docs = order_docs(t).unionByName(t.events.select((-1 - F.col("event_id")).alias("id"), F.col("props").alias("doc")))
    return flatten_numeric(docs, "id", "doc")


@query(
    "P12_slim_document",
    """SELECT o_orderkey AS id, false AS has_null, '9999' AS pre_area, CAST(o_custkey AS VARCHAR) AS area,
  '7' AS long_size FROM orders""",
)
def _(t):
    slim = order_docs(t).select("id", K.slim_document(F.col("doc")).alias("doc"))
    return slim.select(
        "id",
        F.col("doc").contains('"none"').alias("has_null"),
        F.get_json_object("doc", "$.pre_rescue_pred_area").alias("pre_area"),
        F.get_json_object("doc", "$.features.area").alias("area"),
        F.json_array_length(F.get_json_object("doc", "$.long")).cast("string").alias("long_size"),
    )


@query(
    "P14_winner_flags",
    """SELECT o_orderkey AS id, concat_ws(',', CASE WHEN o_custkey % 7 = 0 THEN 'fallback' END,
  CASE WHEN o_custkey % 11 = 0 THEN 'rescue' END) AS flags FROM orders""",
)
def _(t):
    values = order_docs(t).select("id", F.from_json("doc", "map<string,string>").alias("m"))
    flags = F.transform_values("m", lambda k, v: v == "true")
    return values.select("id", F.array_join(F.array_sort(F.map_keys(K.winner_flags(flags))), ",").alias("flags"))


@query(
    "P15_winner_pred_pixels",
    """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 10
  ELSE greatest(o_custkey % 50, o_orderkey % 60) END AS pred_pixels FROM orders""",
)
def _(t):
    docs = order_docs(t).select("id", F.from_json("doc", "map<string,string>").alias("m"))
    values = F.transform_values("m", lambda k, v: v.try_cast("double"))
    own = F.when(F.col("id") % 3 == 0, F.col("id") % 10)
    return docs.select("id", K.winner_pred_pixels(own, values).alias("pred_pixels"))


@query(
    "P16_is_positive_item",
    """SELECT id, split, mask_area > 0 OR source LIKE 'w%' OR save_mode = 'force' AS is_positive
FROM (SELECT *, CASE WHEN save_mode = 'force' THEN 'supp_positive' ELSE 'val' END AS split FROM fx_annotations)""",
)
def _(t):
    rows = t.fx_annotations.withColumn("split", F.when(F.col("save_mode") == "force", "supp_positive").otherwise("val"))
    kind = F.when(F.col("source").startswith("w"), "Positive_view").otherwise("image_negative")
    mask = F.when(F.col("mask_area") > 0, "m.png")
    return rows.select("id", "split", K.is_positive_item(F.col("split"), kind, mask).alias("is_positive"))


@query(
    "P18_row_metric",
    """SELECT id, coalesce(CASE WHEN id % 3 = 0 THEN NULL WHEN id % 3 = 1 THEN iou END, CASE WHEN id % 3 = 0 THEN dice END, 0) AS metric
FROM fx_scored""",
)
def _(t):
    text = F.when(F.col("id") % 3 == 1, F.col("iou").cast("string")).when(F.col("id") % 3 == 2, "n/a")
    return t.fx_scored.select("id", K.row_metric(text, F.col("dice").cast("string")).alias("metric"))


@query(
    "P19_dataset_class",
    """SELECT id, CASE lower(trim(dataset_split)) WHEN 'main' THEN 'main' WHEN 'quarantine' THEN 'quarantine'
  ELSE 'legacy' END AS dataset_class FROM fx_annotations""",
)
def _(t):
    return t.fx_annotations.select("id", K.dataset_class(F.col("dataset_split")).alias("dataset_class"))


@query(
    "P20_triplet_paths",
    """SELECT id, CASE WHEN id % 5 = 0 THEN NULL ELSE '/d/' || dir || '/masks/' || id || '.png' END AS mask_path,
  CASE WHEN id % 5 = 0 THEN NULL ELSE '/d/' || dir || '/previews/' || id || '.png' END AS preview_path,
  CASE WHEN id % 2 = 0 THEN 'quarantine' ELSE 'main' END AS "group"
FROM (SELECT id, CASE WHEN id % 2 = 0 THEN 'Quarantine' ELSE source END AS dir FROM fx_annotations)""",
)
def _(t):
    folder = F.when(F.col("id") % 5 == 0, "/raw/").otherwise("/images/")
    image = F.concat(
        F.lit("/d/"), F.when(F.col("id") % 2 == 0, "Quarantine").otherwise(F.col("source")), folder,
        F.col("id").cast("string"), F.lit(".png"),
    )
    return t.fx_annotations.select("id", *[c.alias(n) for n, c in K.triplet_paths(image).items()])


@query(
    "P21_frame_name",
    """SELECT video_id, frame_index, 'v' || video_id || '_' || printf('%06d', frame_index) || '.png' AS name,
  'crop_' || lpad(CAST(frame_index % 100 AS VARCHAR), 2, '0') AS crop_id FROM fx_frames""",
)
def _(t):
    base = F.concat(F.lit("v"), F.col("video_id").cast("string"))
    return t.fx_frames.select(
        "video_id", "frame_index", K.frame_name(base, F.col("frame_index")).alias("name"),
        K.crop_id(F.col("frame_index") % 100).alias("crop_id"),
    )
