"""Row filters and gates; gates report the first reason they fail on."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from framegate.functions.keys import dataset_class
from framegate.operators.ranking import top_per_key
from framegate.runtime import broadcast_if_small

# Row kinds of the label index and the harvest markers.
POSITIVE_KINDS = ("view_positive", "bbox_positive", "candidate_positive")
NEGATIVE_KINDS = ("image_negative", "flat_negative")
HARVEST_MARKERS = ("video_frames_model_harvest", "video_infer_harvest")
HARVEST_SINCE = ("2026-04",)


def first_reason(checks: Sequence[tuple[Column, str]]) -> Column:
    """Reason of the first failing check, null when all pass. A null check counts as failing."""
    reason = F.lit(None).cast("string")
    for passed, name in reversed(checks):
        reason = F.when(F.coalesce(passed, F.lit(False)), reason).otherwise(F.lit(name))
    return reason


def validate_annotations(df: DataFrame, include: Sequence[str], id_col: str, mask_area: Column, exists: Column) -> DataFrame:
    """Adds ``dataset_class`` and ``reject_reason``: class filter, then missing files, then an empty mask."""
    labelled = df.withColumn("dataset_class", dataset_class(F.col("dataset_split")))
    named = F.trim(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) != ""
    reason = first_reason(
        [
            (F.col("dataset_class").isin(*include), "split"),
            (named & exists, "missing"),
            (mask_area > 0, "badmask"),
        ]
    )
    return labelled.withColumn("reject_reason", reason)


def reject_counts(df: DataFrame, reason: str = "reject_reason") -> DataFrame:
    """One pass over the rows: how many were kept and how many fell to each reason."""
    return df.groupBy(F.coalesce(reason, F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


def exclude_ids(df: DataFrame, excluded: DataFrame, key: str) -> DataFrame:
    return df.join(broadcast_if_small(excluded.select(key).distinct()), key, "left_anti")


def harvest_records(
    df: DataFrame, source_path: str, created_at: str, markers: Sequence[str] = HARVEST_MARKERS, dates: Sequence[str] = HARVEST_SINCE
) -> DataFrame:
    """Rows whose source path holds one of the ``markers`` or whose creation time starts with one of the ``dates``."""
    source, created = F.coalesce(source_path, F.lit("")), F.coalesce(created_at, F.lit(""))
    hit = F.lit(False)
    for date in dates:
        hit = hit | created.startswith(date)
    for marker in markers:
        hit = hit | source.contains(marker)
    return df.filter(hit)


def keep_kinds(df: DataFrame, kinds: Sequence[str], kind: str = "kind", id_col: str = "id") -> DataFrame:
    return df.filter(F.col(kind).isin(*kinds) & ~F.col(id_col).startswith("neg::"))


def focus_rows(df: DataFrame, sources: Sequence[str], include_true_negatives: bool) -> DataFrame:
    wanted = F.col("pred_pixels") > 0
    if include_true_negatives:
        wanted = wanted | (F.col("gt_pixels") <= 0)
    return df.filter(F.col("winner_source").isin(*sources) & wanted)


def residuals(df: DataFrame, max_iou: float, order: Sequence[str], limit: int | None = None) -> DataFrame:
    """Rows at or below an IoU, outside the ``neg::`` ids; ``limit`` keeps the first of an order."""
    kept = df.filter(~F.col("id").cast("string").startswith("neg::") & (F.col("iou") <= max_iou))
    return kept if limit is None else kept.orderBy(*order).limit(limit)


def is_detected(score: Column, mask_pixels: Column, min_score: float, min_pixels: int) -> Column:
    return (score >= min_score) & (mask_pixels >= min_pixels)


def shape_gate(
    df: DataFrame, min_area: int, min_aspect: float, max_fill: float, max_border: float, min_score: float | None = None
) -> DataFrame:
    """Masks that are large, long, thin and inside the frame; a missing score passes the score check."""
    ok = (
        (F.col("area") >= min_area)
        & (F.col("aspect") >= min_aspect)
        & (F.col("fill_ratio") <= max_fill)
        & (F.col("border_touch_ratio") <= max_border)
    )
    if min_score is not None:
        ok = ok & (F.col("score").isNull() | (F.col("score") >= min_score))
    return df.filter(ok)


def stricter(tiny: Column, base: float, tiny_limit: float, upper: bool) -> Column:
    """A limit that tightens for tiny items: the smaller upper bound or the larger lower bound."""
    tight = min(base, tiny_limit) if upper else max(base, tiny_limit)
    return F.when(tiny, F.lit(float(tight))).otherwise(F.lit(float(base)))


def best_or_dominant_reason(
    df: DataFrame, key: str, reason: str, rank: Sequence[Column | str], position: Sequence[Column | str]
) -> DataFrame:
    """Per key the best passing row, or the most frequent reject reason (first seen wins a tie)."""
    best = top_per_key(df.filter(F.col(reason).isNull()), [key], rank).withColumn("_hit", F.lit(True))
    counted = df.filter(F.col(reason).isNotNull()).groupBy(key, reason).agg(
        F.count("*").alias("_n"), F.min(F.struct(*position)).alias("_at")
    )
    dominant = top_per_key(counted, [key], [F.desc("_n"), "_at"]).select(key, F.col(reason).alias("_dominant"))
    frames = df.select(key).distinct().join(best.drop(reason), key, "left").join(dominant, key, "left")
    accepted = F.coalesce("_hit", F.lit(False))
    return frames.withColumns(
        {"accepted": accepted, "outcome": F.when(accepted, F.lit("ok")).otherwise(F.col("_dominant"))}
    ).drop("_dominant", "_hit")


def veto_target(gt_pixels: Column, pred_pixels: Column, iou: Column, min_keep_iou: float = 0.0) -> Column:
    """1 veto, 0 keep, null unusable."""
    return F.when((gt_pixels <= 0) & (pred_pixels > 0), 1).when(
        (gt_pixels > 0) & (pred_pixels > 0) & (iou >= min_keep_iou), 0
    )
