"""Evaluation of a board: the winner of every item's frame against its true mask, then the report a promotion gate reads."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, functions as F

from framegate.operators.metrics import SUCCESS_IOU, count_entries, failure_label, gate_summary
from framegate.operators.pixels import dice, iou, overlap_counts
from framegate.operators.ranking import worst
from framegate.runtime import stage

# The count maps of a report, by the kind of their entries.
COUNT_MAPS = {
    "failure": "failure_counts",
    "source": "winner_source_counts",
    "fp_source": "negative_false_positive_source_counts",
    "flag": "winner_flag_counts",
}
NO_SOURCE = "None"


def _chosen_splits(board: DataFrame, splits: Sequence[str] | None) -> DataFrame:
    if splits is None:
        return board
    chosen = board.filter(F.col("split").isin(*splits))
    known = {r["split"] for r in chosen.select("split").distinct().collect()}  # at most the names asked for
    missing = [s for s in splits if s not in known]
    if missing:
        raise ValueError(f"the board has no split {missing}")
    return chosen


def evaluate_board(
    board: DataFrame, winners: DataFrame, masks: DataFrame | Callable[[DataFrame], DataFrame], truth: DataFrame,
    splits: Sequence[str] | None = None, success_iou: float = SUCCESS_IOU,
) -> DataFrame:
    """One row per board item: pixel counts, IoU, dice, failure label and the winner of its frame.

    ``board`` has ``(id, split, frame_id)``, ``winners`` the rows of ``cascade.report``, ``masks`` the pixels of all
    candidates ``(frame_id, candidate_id, x, y)``, or gives those of the candidates ``(frame_id, candidate_id)`` it is called
    with, so that no others need be drawn, ``truth`` the true pixels ``(frame_id, x, y)``. A winner whose mask was
    rejected (no final pixels), or that has no mask rows, predicts nothing; so does a frame without a winner. Items of one
    frame share its counts; repeated pixels count once; a split the board doesn't have is an error.

    The board's winners are written once, since masks and rows both need them and they end a long plan. Pixels are cut to the
    frames of the board and to winning masks before they meet, and both sides meet in one aggregation.
    """
    items = _chosen_splits(board, splits)
    frames = items.select("frame_id").distinct()
    narrow = winners.select("frame_id", "candidate_id", "candidate_source", "score", "flags", "final_pixels")
    best = stage(narrow.join(frames, "frame_id", "left_semi"), "winners")
    shown = best.filter(F.col("final_pixels") > 0).select("frame_id", "candidate_id")
    spot = [F.col("frame_id"), F.col("x").cast("bigint").alias("x"), F.col("y").cast("bigint").alias("y")]
    drawn = masks(shown) if callable(masks) else masks.join(shown, ["frame_id", "candidate_id"], "left_semi")
    predicted = drawn.select(*spot, F.lit("pred").alias("side"))
    true = truth.join(frames, "frame_id", "left_semi").select(*spot, F.lit("gt").alias("side"))
    counts = overlap_counts(true.unionByName(predicted))
    chosen = best.select(
        "frame_id", F.col("candidate_id").alias("winner_id"), F.col("candidate_source").alias("winner_source"),
        F.col("score").alias("winner_score"), F.col("flags").alias("winner_flags"),
    )
    pixels = ["gt_pixels", "pred_pixels", "inter_pixels"]
    rows = items.join(counts, "frame_id", "left").fillna(0, pixels).join(chosen, "frame_id", "left")
    gt, pred, inter = (F.col(c) for c in pixels)
    measured = rows.withColumns({"iou": iou(gt, pred, inter, 1.0), "dice": dice(gt, pred, inter)})
    return measured.withColumn("failure_type", failure_label(gt, pred, F.col("iou"), success_iou)).drop("inter_pixels")


def evaluation_report(rows: DataFrame) -> DataFrame:
    """Gate metrics and count maps of evaluated rows, one row per split and one for ``overall``.

    The columns it needs are written once, for metrics and maps; counts are taken per split and summed again for all.
    """
    needed = ["split", "gt_pixels", "pred_pixels", "iou", "dice", "failure_type", "winner_source", "winner_flags"]
    rows = stage(rows.select(*needed), "evaluated")
    flags = F.coalesce(F.array_compact("winner_flags"), F.array().cast("array<string>"))
    named = rows.withColumns({"winner_source": F.coalesce("winner_source", F.lit(NO_SOURCE)), "_flags": F.array_distinct(flags)})
    entries = count_entries(named, F.col("_flags"))
    scopes = F.explode(F.array(F.col("split"), F.lit("overall")))
    summed = entries.withColumn("scope", scopes).groupBy("scope", "kind", "key").agg(F.sum("n").alias("n"))

    def counts(kind: str):
        pairs = F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("key", "n"))))
        return F.map_from_entries(pairs).alias(COUNT_MAPS[kind])

    maps = summed.groupBy("scope").agg(*[counts(kind) for kind in COUNT_MAPS])
    return gate_summary(rows).join(maps, "scope", "left")


def worst_items(rows: DataFrame, n: int = 25) -> DataFrame:
    """The items of the lowest IoU, of these the ones that predict most (a bounded report)."""
    return worst(rows, ["iou", F.desc("pred_pixels"), "split", "id"], n)
