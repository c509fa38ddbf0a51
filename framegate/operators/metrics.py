"""Evaluation summaries: failure labels, gate metrics, sweeps, profiles and promotion checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from framegate.functions.keys import size_bucket_label
from framegate.operators.order import exact_quantiles

# Failure labels and promotion limits of the gate.
SUCCESS_IOU = 0.5
RECALL_PIXELS = 12


def failure_label(gt: Column, pred: Column, iou: Column, success_iou: float = SUCCESS_IOU) -> Column:
    """Label of one evaluated frame at the gate."""
    positive = (
        F.when(iou >= success_iou, "success")
        .when(pred <= 0, "positive_no_prediction")
        .when(iou <= 0, "positive_zero_iou_wrong_prediction")
        .otherwise("positive_partial_miss")
    )
    negative = F.when(pred <= 0, "true_negative").otherwise("negative_false_positive")
    return F.when(gt <= 0, negative).otherwise(positive)


def diagnostic_label(
    gt: Column, pred: Column, final_iou: Column, best_gt_pixels: Column, best_iou: Column,
    recall_pixels: int = RECALL_PIXELS, success_iou: float = SUCCESS_IOU,
) -> Column:
    """Where a frame was lost: generation, selection or segmentation."""
    return (
        F.when((gt <= 0) & (pred <= 0), "true_negative")
        .when(gt <= 0, "negative_false_positive")
        .when(final_iou >= success_iou, "success")
        .when(best_gt_pixels < recall_pixels, "candidate_generation_miss")
        .when(best_iou >= success_iou, "selector_or_reranker_miss")
        .otherwise("segmentation_miss")
    )


def _mean(total: Column, n: Column) -> Column:
    """Mean with 0.0 for an empty group."""
    return F.coalesce(F.try_divide(total, n), F.lit(0.0))


def gate_measures(gt: Column, pred: Column, iou: Column, dice: Column) -> dict[str, Column]:
    """Per-row terms whose sums give every gate metric; sums of sums stay exact, so they can be regrouped."""
    positive = (gt > 0).cast("bigint")
    return {
        "n": F.lit(1).cast("bigint"),
        "n_pos": positive,
        "s_iou": iou,
        "s_dice": dice,
        "s_pos_iou": F.when(gt > 0, iou).otherwise(F.lit(0.0)),
        "s_pos_dice": F.when(gt > 0, dice).otherwise(F.lit(0.0)),
        "n_zero": ((gt > 0) & (iou <= 0)).cast("bigint"),
        "n_tn": ((gt <= 0) & (pred <= 0)).cast("bigint"),
        "n_fp": ((gt <= 0) & (pred > 0)).cast("bigint"),
    }


def gate_metrics() -> list[Column]:
    """Gate metrics from summed measures."""
    n, pos = F.col("n"), F.col("n_pos")
    return [
        n.alias("count"),
        pos.alias("positive_count"),
        (n - pos).alias("negative_count"),
        _mean(F.col("s_iou"), n).alias("mean_iou"),
        _mean(F.col("s_dice"), n).alias("mean_dice"),
        _mean(F.col("s_pos_iou"), pos).alias("positive_mean_iou"),
        _mean(F.col("s_pos_dice"), pos).alias("positive_mean_dice"),
        F.col("n_zero").alias("positive_zero_iou"),
        F.col("n_tn").alias("true_negative"),
        F.col("n_fp").alias("negative_false_positive"),
        _mean(F.col("n_fp"), n - pos).alias("negative_false_positive_rate"),
    ]


def _row_measures() -> dict[str, Column]:
    return gate_measures(F.col("gt_pixels"), F.col("pred_pixels"), F.col("iou"), F.col("dice"))


def gate_summary(rows: DataFrame, split: str = "split") -> DataFrame:
    """Gate metrics per split and overall in one aggregation; ``scope`` names the split or ``overall``."""
    measured = rows.select(split, *[c.alias(n) for n, c in _row_measures().items()])
    names = list(_row_measures())
    summed = measured.rollup(split).agg(F.grouping(split).alias("_all"), *[F.sum(n).alias(n) for n in names])
    scope = F.when(F.col("_all") == 1, "overall").otherwise(F.col(split))
    return summed.select(scope.alias("scope"), *gate_metrics())


def count_entries(rows: DataFrame, flags: Column) -> DataFrame:
    """Counts per split for every failure label, winner source, false-positive source and set flag.

    ``flags`` is an array of flag names. One pass: each row gives a short array of (kind, key) pairs.
    """
    false_positive = F.col("failure_type") == "negative_false_positive"

    def entry(kind, key):
        return F.struct(F.lit(kind).alias("kind"), key.alias("key"))

    fixed = F.array(
        entry("failure", F.col("failure_type")), entry("source", F.col("winner_source")),
        F.when(false_positive, entry("fp_source", F.col("winner_source"))),
    )
    flagged = F.transform(flags, lambda f: entry("flag", f))
    return (
        rows.select("split", F.explode(F.concat(F.array_compact(fixed), flagged)).alias("e"))
        .groupBy("split", F.col("e.kind").alias("kind"), F.col("e.key").alias("key"))
        .agg(F.count("*").alias("n"))
    )


def count_maps(entries: DataFrame) -> DataFrame:
    """The entries of ``count_entries`` as one sorted map per split and kind."""
    pairs = F.array_sort(F.collect_list(F.struct("key", "n")))
    return entries.groupBy("split", "kind").agg(F.map_from_entries(pairs).alias("counts"))


def flag_summary(rows: DataFrame, flag_columns: Sequence[str]) -> DataFrame:
    """Per split: count, means, zero IoU and one conditional count per flag."""
    return rows.groupBy("split").agg(
        F.count("*").alias("count"), F.avg("iou").alias("mean_iou"), F.avg("dice").alias("mean_dice"),
        F.count_if(F.col("iou") == 0).alias("zero_iou"),
        *[F.count_if(F.col(f)).alias(f"{f}_count") for f in flag_columns],
    )


def precision_recall_f1(tp: Column, fp: Column, fn: Column) -> tuple[Column, Column, Column]:
    zero = F.lit(0.0)
    p = F.coalesce(F.try_divide(tp, tp + fp), zero)
    r = F.coalesce(F.try_divide(tp, tp + fn), zero)
    return p, r, F.coalesce(F.try_divide(2.0 * p * r, p + r), zero)


# Weights of pixel precision, recall, F1, centreline F1 and false positives per frame.
COMPOSITE_WEIGHTS = {
    "default": (0.20, 0.25, 0.20, 0.35, 0.20),
    "precision": (0.50, 0.0, 0.30, 0.20, 0.20),
    "centerline": (0.10, 0.20, 0.10, 0.60, 0.20),
}


def composite_score(mode: str = "default") -> Column:
    p, r, f1, cf1, fp = COMPOSITE_WEIGHTS.get(mode, COMPOSITE_WEIGHTS["default"])
    return (
        F.lit(p) * F.col("pixel_precision") + F.lit(r) * F.col("pixel_recall") + F.lit(f1) * F.col("pixel_f1")
        + F.lit(cf1) * F.col("centerline_f1") - F.lit(fp) * F.col("fp_per_frame")
    )


def best_threshold(by_threshold: DataFrame, mode: str = "default") -> DataFrame:
    """The best row of a sweep: composite, then centreline F1, then precision (ties within 1e-9), then the lowest threshold."""
    scored = by_threshold.withColumn("composite_score", composite_score(mode))
    ranks = [F.round(c, 9).desc() for c in ("composite_score", "centerline_f1", "pixel_precision")]
    return scored.orderBy(*ranks, "threshold").limit(1)


def class_weight(target: Column) -> Column:
    """Positive class weight ``max(1, negatives / max(1, positives))`` as an aggregate."""
    return F.greatest(F.lit(1.0), F.count_if(target < 0.5) / F.greatest(F.lit(1), F.count_if(target >= 0.5)))


def feature_moments(rows: DataFrame, vector: str) -> DataFrame:
    """Mean and population deviation per vector position; deviations under 1e-6 become one."""
    values = rows.select(F.posexplode(vector).alias("pos", "value"))
    std = F.stddev_pop(F.col("value").cast("double"))
    return values.groupBy("pos").agg(
        F.avg(F.col("value").cast("double")).alias("mean"), F.when(std < 1e-6, F.lit(1.0)).otherwise(std).alias("std")
    )


def normalise(rows: DataFrame, vector: str, moments: DataFrame) -> DataFrame:
    """Standardise a vector column; the moments are one row per position, bounded by the vector length."""
    ordered = moments.agg(F.array_sort(F.collect_list(F.struct("pos", "mean", "std"))).alias("_m"))
    scaled = F.zip_with(vector, "_m", lambda v, m: (v.cast("double") - m["mean"]) / m["std"])
    return rows.crossJoin(F.broadcast(ordered)).withColumn(vector, scaled).drop("_m")  # one row


def dataset_profile(rows: DataFrame, bounds: Sequence[float]) -> DataFrame:
    """Counts by source, size bucket (empty buckets kept) and refinement, as ``(kind, key, n)``."""
    length = F.col("major_len")
    entries = F.array(
        F.struct(F.lit("source").alias("kind"), F.col("source").alias("key")),
        F.struct(F.lit("size").alias("kind"), size_bucket_label(length, bounds).alias("key")),
        F.struct(F.lit("refined").alias("kind"), F.when(F.col("refined"), "refined").otherwise("not_refined").alias("key")),
    )
    counted = rows.select(F.inline(entries)).groupBy("kind", "key").agg(F.count("*").alias("n"))
    ordered = sorted(bounds)
    labels = [f"<{b:g}" for b in ordered] + ([f">={ordered[-1]:g}"] if ordered else ["all"])
    known = [("size", label) for label in labels] + [("refined", "refined"), ("refined", "not_refined")]
    zeros = rows.sparkSession.createDataFrame(known, "kind string, key string").withColumn("n", F.lit(0).cast("bigint"))
    return counted.unionByName(zeros).groupBy("kind", "key").agg(F.sum("n").alias("n"))


def length_quantiles(rows: DataFrame, value: str) -> DataFrame:
    return exact_quantiles(rows, [], value, {"p10": 0.1, "p50": 0.5, "p90": 0.9})


def run_statistics(log: DataFrame, run: str) -> DataFrame:
    """Rates and means per run from a task log ``(images, tiles, batch, wait_ms, forward_ms, elapsed_s)``."""
    elapsed = F.greatest(F.lit(1e-6), F.sum("elapsed_s"))
    batches = F.greatest(F.lit(1), F.count("*"))
    return log.groupBy(run).agg(
        F.sum("images").alias("images"), F.sum("tiles").alias("tiles"),
        (F.sum("images") / elapsed).alias("images_per_sec"), (F.sum("tiles") / elapsed).alias("tiles_per_sec"),
        (F.sum("batch") / batches).alias("avg_tile_batch"), F.max("batch").alias("max_tile_batch"),
        (F.sum("wait_ms") / batches).alias("avg_queue_wait_ms"), (F.sum("forward_ms") / batches).alias("avg_forward_ms"),
    )


def sampling_statistics(frames: DataFrame, key: str) -> DataFrame:
    """Read, sampled, saved and skipped frames per video, with the mean difference of kept and skipped ones.

    ``decision`` is ``kept``, ``gap``, ``dedup`` or null for frames that were not sampled.
    """
    decision, score = F.col("decision"), F.col("score")
    return frames.groupBy(key).agg(
        F.count("*").alias("frames_read"), F.count(decision).alias("frames_sampled"),
        F.count_if(decision == "kept").alias("frames_saved"),
        F.count_if(decision == "gap").alias("frames_skipped_min_gap"),
        F.count_if(decision == "dedup").alias("frames_skipped_dedup"),
        F.coalesce(F.avg(F.when(decision == "kept", score)), F.lit(0.0)).alias("avg_kept_diff_score"),
        F.coalesce(F.avg(F.when(decision == "dedup", score)), F.lit(0.0)).alias("avg_skipped_diff_score"),
    )


def dataset_fingerprint(files: DataFrame, parameters: str) -> DataFrame:
    """One hash over the per-root count, bytes and newest change plus the build parameters.

    The roots are configuration, so the sorted list has one entry per root.
    """
    roots = files.groupBy("root").agg(
        F.count("*").alias("count"), F.sum("size").alias("bytes"), F.max("mtime").alias("newest")
    )
    line = F.concat_ws("|", "root", "count", "bytes", "newest")
    text = F.concat_ws("\n", F.array_sort(F.collect_list(line)), F.lit(parameters))
    return roots.agg(F.sha2(text, 256).alias("fingerprint"), F.count("*").alias("roots"))


def numeric_difference(left: DataFrame, right: DataFrame, key: str, vector: str) -> DataFrame:
    """Largest and mean absolute difference of two vector tables (the mean is taken over per-item means)."""
    pairs = left.select(key, F.col(vector).alias("_a")).join(right.select(key, F.col(vector).alias("_b")), key)
    gaps = F.zip_with("_a", "_b", lambda a, b: F.abs(a.cast("double") - b.cast("double")))
    per_item = pairs.select(
        F.array_max(gaps).alias("_max"),
        F.try_divide(F.aggregate(gaps, F.lit(0.0), lambda t, g: t + g), F.size(gaps)).alias("_mean"),
    )
    return per_item.agg(
        F.count("*").alias("items"), F.coalesce(F.max("_max"), F.lit(0.0)).alias("max_abs_diff"),
        F.coalesce(F.avg("_mean"), F.lit(0.0)).alias("mean_abs_diff"),
    )


def missing_inputs(rows: DataFrame, present: dict[str, Column]) -> DataFrame:
    """How many rows lack each input; a row counts for the first one it lacks."""
    kind = F.lit(None).cast("string")
    for name, has in reversed(list(present.items())):
        kind = F.when(F.coalesce(has, F.lit(False)), kind).otherwise(F.lit(name))
    return rows.select(kind.alias("missing")).filter(F.col("missing").isNotNull()).groupBy("missing").agg(F.count("*").alias("n"))


def validity_accuracy(target: Column, probability: Column) -> Column:
    correct = (probability >= 0.5) == (target >= 0.5)
    return F.coalesce(F.avg(correct.cast("double")), F.lit(0.0))


def promotion_gate(
    baseline: DataFrame, candidate: DataFrame, fp_limits: dict[str, int], tolerance: float = 1e-9
) -> DataFrame:
    """Per scope: may the candidate run replace the baseline? Mean Dice must not fall, zero-IoU frames must not
    rise, and false positives must stay within the scope's limit. The last row, ``overall_decision``, needs all."""
    base = baseline.select("scope", F.col("mean_dice").alias("_dice"), F.col("positive_zero_iou").alias("_zero"))
    joined = base.join(candidate, "scope", "full_outer")
    limit = F.lit(None).cast("bigint")
    for scope, n in fp_limits.items():
        limit = F.when(F.col("scope") == scope, F.lit(n)).otherwise(limit)
    checks = {
        "dice_ok": F.col("mean_dice") >= F.col("_dice") - tolerance,
        "zero_iou_ok": F.col("positive_zero_iou") <= F.col("_zero"),
        "fp_ok": limit.isNull() | (F.col("negative_false_positive") <= limit),
    }
    judged = joined.select("scope", *[F.coalesce(c, F.lit(False)).alias(n) for n, c in checks.items()])
    judged = judged.withColumn("promote", F.col("dice_ok") & F.col("zero_iou_ok") & F.col("fp_ok"))
    overall = judged.agg(
        F.lit("overall_decision").alias("scope"), *[F.bool_and(c).alias(c) for c in (*checks, "promote")]
    )
    return judged.unionByName(overall)
