"""Threshold searches as prefix sums over the distinct probabilities.

Rows are first counted per distinct probability (map-side combined); the search then runs over that
histogram, so its cost does not grow with rows times thresholds.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from framegate.operators.metrics import failure_label, gate_measures, gate_metrics
from framegate.operators.order import running_sums

# Candidate thresholds that are always tried.
VETO_CANDIDATES = (0.05, 0.1, 0.2, 0.3, 0.5, 0.7, 0.9)
IMAGE_VETO_CANDIDATES = (0.05, 0.1, 0.2, 0.3, 0.5, 0.7, 0.9, 0.95, 0.99)
SWEEP = tuple(round(0.05 * i, 2) for i in range(1, 20))


def cumulative_counts(
    rows: DataFrame, probability: str, target: Column, constants: Sequence[float] = (), above_max: bool = False
) -> DataFrame:
    """``threshold, hit, miss, hit_total, miss_total``: rows of each class at or above every threshold.

    ``target`` is true for the class the threshold should catch. ``above_max`` adds one threshold that
    catches nothing.
    """
    tagged = rows.select(F.col(probability).cast("double").alias("threshold"), target.alias("_t"))
    histogram = tagged.groupBy("threshold").agg(F.count_if("_t").alias("_h"), F.count_if(~F.col("_t")).alias("_m"))
    spark = rows.sparkSession
    zero = F.lit(0).cast("bigint")
    top = histogram.agg((F.max("threshold") + 1e-6).alias("threshold")) if above_max else None
    if constants:
        extra = spark.createDataFrame([(float(c),) for c in constants], "threshold double")
        histogram = histogram.unionByName(extra.select("threshold", zero.alias("_h"), zero.alias("_m")))
    if top is not None:
        histogram = histogram.unionByName(top.select("threshold", zero.alias("_h"), zero.alias("_m")))
    merged = histogram.groupBy("threshold").agg(F.sum("_h").alias("_h"), F.sum("_m").alias("_m"))
    summed = running_sums(merged, [], [F.desc("threshold")], {"hit": "_h", "miss": "_m"})
    totals = merged.agg(F.sum("_h").alias("hit_total"), F.sum("_m").alias("miss_total"))
    return summed.drop("_h", "_m").crossJoin(F.broadcast(totals))  # one row


def _rates(counts: DataFrame) -> DataFrame:
    one = F.lit(1)
    return counts.withColumns(
        {
            "neg_veto_rate": F.col("hit") / F.greatest(one, F.col("hit_total")),
            "pos_veto_rate": F.col("miss") / F.greatest(one, F.col("miss_total")),
            "accuracy": (F.col("hit") + F.col("miss_total") - F.col("miss")) / (F.col("hit_total") + F.col("miss_total")),
        }
    )


def veto_threshold(rows: DataFrame, probability: str, target: Column) -> DataFrame:
    """Best veto threshold: catch negatives, pay twice for positives; the lowest threshold wins a tie."""
    rates = _rates(cumulative_counts(rows, probability, target, VETO_CANDIDATES))
    key = F.col("neg_veto_rate") - 2.0 * F.col("pos_veto_rate") + 0.05 * F.col("accuracy")
    return rates.withColumn("selection_key", key).orderBy(F.desc("selection_key"), "threshold").limit(1)


def image_veto_threshold(rows: DataFrame, probability: str, target: Column) -> DataFrame:
    """As ``veto_threshold`` with a bonus for thresholds that cost no positive."""
    rates = _rates(cumulative_counts(rows, probability, target, IMAGE_VETO_CANDIDATES, above_max=True))
    bonus = F.when(F.col("miss") == 0, 1.0).otherwise(0.0)
    key = F.col("neg_veto_rate") + bonus - 4.0 * F.col("pos_veto_rate") + 0.02 * F.col("accuracy")
    return rates.withColumn("selection_key", key).orderBy(F.desc("selection_key"), "threshold").limit(1)


def arbiter_threshold(rows: DataFrame, probability: str, target: Column) -> DataFrame:
    """Best replacement threshold over the observed probabilities; the highest threshold wins a tie."""
    counts = cumulative_counts(rows, probability, target)
    tpr = F.col("hit") / F.greatest(F.lit(1.0), F.col("hit_total"))
    fpr = F.col("miss") / F.greatest(F.lit(1.0), F.col("miss_total"))
    precision = F.col("hit") / F.greatest(F.lit(1.0), F.col("hit") + F.col("miss"))
    rated = counts.withColumns({"true_positive_rate": tpr, "false_positive_rate": fpr, "precision": precision})
    tpr, fpr, precision = (F.col(c) for c in ("true_positive_rate", "false_positive_rate", "precision"))
    rated = rated.withColumns(
        {
            "f1": 2.0 * precision * tpr / F.greatest(precision + tpr, F.lit(1e-6)),
            "selection_key": tpr - 4.0 * fpr + 0.25 * precision,
        }
    )
    return rated.orderBy(F.desc("selection_key"), F.desc("threshold")).limit(1)


def zero_miss_thresholds(
    rows: DataFrame, probability: str, target: Column, extra: Sequence[float] = (), k: int = 20
) -> DataFrame:
    """The ``k`` thresholds that cost no positive and catch the most negatives (a bounded report)."""
    counts = cumulative_counts(rows, probability, target, extra).filter("miss = 0")
    rate = F.col("hit") / F.greatest(F.lit(1), F.col("hit_total"))
    return counts.withColumn("neg_veto_rate", rate).orderBy(F.desc("hit"), "threshold").limit(k)


def veto_confusion(rows: DataFrame, probability: str, target: Column, threshold: float) -> DataFrame:
    """Counts at one threshold by source, by split and overall (``axis`` names which)."""
    pred = F.col(probability) >= threshold
    flagged = rows.select("winner_source", "split", target.alias("_t"), pred.alias("_p"))
    sets = flagged.groupingSets([["winner_source"], ["split"], []], "winner_source", "split").agg(
        F.grouping_id().alias("_g"), F.count("*").alias("count"), F.count_if("_t").alias("target_veto_total"),
        F.count_if(~F.col("_t")).alias("keep_total"), F.count_if(F.col("_p") & F.col("_t")).alias("true_negative_veto"),
        F.count_if(F.col("_p") & ~F.col("_t")).alias("false_positive_veto"),
    )
    axis = F.when(F.col("_g") == 1, "source").when(F.col("_g") == 2, "split").otherwise("overall")
    return sets.select(
        axis.alias("axis"), F.coalesce("winner_source", "split", F.lit("all")).alias("key"), "count",
        "target_veto_total", "keep_total", "true_negative_veto", "false_positive_veto",
    )


def vetoed_rows(rows: DataFrame, probability: str, threshold: float) -> DataFrame:
    """The rows a threshold vetoes, most probable first."""
    return rows.filter(F.col(probability) >= threshold).orderBy(F.desc(probability), "split", "id")


def veto_sweep(rows: DataFrame, probability: str, thresholds: Sequence[float] = SWEEP) -> DataFrame:
    """Gate summary per threshold and split if every row at or above the threshold lost its mask.

    A row is vetoed for all thresholds up to its probability, so one aggregation per (split, number of
    thresholds reached) holds everything; the sweep regroups those few sums. No row meets any threshold.
    """
    ordered = sorted(thresholds)
    reached = F.size(F.filter(F.array(*[F.lit(float(t)) for t in ordered]), lambda t: t <= F.col(probability)))
    step = F.when(F.col("pred_pixels") > 0, F.coalesce(reached, F.lit(0))).otherwise(F.lit(0))
    gt, zero = F.col("gt_pixels"), F.lit(0)
    empty_iou = F.when(gt <= 0, 1.0).otherwise(0.0)
    empty_dice = F.when(gt <= 0, F.lit(1.0)).otherwise(1.0 / (gt + 1.0))
    now = gate_measures(gt, F.col("pred_pixels"), F.col("iou"), F.col("dice"))
    then = gate_measures(gt, zero, empty_iou, empty_dice)
    measured = rows.select(
        "split", step.alias("_step"), *[c.alias(n) for n, c in now.items()], *[c.alias(f"v_{n}") for n, c in then.items()]
    )
    sums = measured.groupBy("split", "_step").agg(*[F.sum(c).alias(c) for c in measured.columns[2:]])
    numbered = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(t)).alias("threshold")) for i, t in enumerate(ordered, 1)])
    swept = sums.withColumn("_e", F.explode(numbered))
    vetoed = F.col("_step") >= F.col("_e.i")
    picked = swept.select(
        "split", F.col("_e.threshold").alias("threshold"),
        *[F.when(vetoed, F.col(f"v_{n}")).otherwise(F.col(n)).alias(n) for n in now],
        F.when(vetoed, F.col("n")).otherwise(F.lit(0)).alias("veto_count"),
        F.when(vetoed, F.col("n_pos")).otherwise(F.lit(0)).alias("vetoed_positive_count"),
    )
    sets = picked.groupingSets([["threshold", "split"], ["threshold"]], "threshold", "split").agg(
        F.grouping("split").alias("_all"), *[F.sum(n).alias(n) for n in (*now, "veto_count", "vetoed_positive_count")]
    )
    scope = F.when(F.col("_all") == 1, "overall").otherwise(F.col("split"))
    return sets.select("threshold", scope.alias("scope"), *gate_metrics(), "veto_count", "vetoed_positive_count")


def apply_veto(rows: DataFrame, probability: str, threshold: float) -> DataFrame:
    """Rows after a veto at one threshold, with the values they had before."""
    hit = (F.col("pred_pixels") > 0) & (F.coalesce(probability, F.lit(0.0)) >= threshold)
    gt = F.col("gt_pixels")
    changed = {
        "iou": F.when(gt <= 0, 1.0).otherwise(0.0),
        "dice": F.when(gt <= 0, F.lit(1.0)).otherwise(1.0 / (gt + 1.0)),
        "pred_pixels": F.lit(0),
    }
    kept = rows.withColumns({f"pre_veto_{c}": F.when(hit, F.col(c)) for c in changed} | {"vetoed": hit})
    after = kept.withColumns({c: F.when(F.col("vetoed"), v).otherwise(F.col(c)) for c, v in changed.items()})
    return after.withColumn("failure_type", failure_label(gt, F.col("pred_pixels"), F.col("iou")))
