"""Feature vectors, scores, sample weights and learned scorers over candidate and component tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from framegate.functions.geometry import clip, folded_angle, point_segment_distance
from framegate.functions.keys import model_source_group
from framegate.operators.ranking import top_per_key
from framegate.operators.spatial import CONTEXT_FEATURES, context_features, roi_fraction

# Feature order of the candidate ranker and its one-hot sources.
MASK_FEATURES = (
    "area", "skeleton_length", "average_width", "length_to_width_ratio", "thinness", "line_likeness", "branch_count",
    "component_count", "continuity", "ball_boundary_touch", "ball_core_overlap", "ball_fill_fraction",
    "connected_to_ball", "outward_extension", "shortness_penalty", "blob_penalty",
)
RANKER_SOURCES = ("table_hough", "reticle_global_0", "reticle_global_1", "reticle_global_2", "white_blob")
MAX_RETICLE_DISTANCE = 12.0
# Suffix of the columns with the empty map of a name list.
WANTED = "_wanted"


def _log1p0(value: Column) -> Column:
    return F.log1p(F.greatest(value.cast("double"), F.lit(0.0)))


def _feature(features: Column, name: str) -> Column:
    return F.coalesce(features.getItem(name), F.lit(0.0))


def one_hot(value: Column, names: Sequence[str]) -> list[Column]:
    return [F.when(value == n, 1.0).otherwise(0.0) for n in names]


def ranker_vector(
    source: Column, candidate_score: Column, raw_score: Column, confidence: Column, pred_pixels: Column,
    reticle_distance: Column, features: Column,
) -> Column:
    """22 numbers and 5 one-hot sources; a missing or negative ring distance gives zero and a cleared flag."""
    known = reticle_distance.isNotNull() & (reticle_distance >= 0)
    numbers = [
        _log1p0(raw_score), candidate_score.cast("double"), confidence.cast("double"), _log1p0(pred_pixels),
        F.when(known, F.least(reticle_distance.cast("double"), F.lit(MAX_RETICLE_DISTANCE))).otherwise(0.0),
        F.when(known, 1.0).otherwise(0.0), *[_feature(features, n) for n in MASK_FEATURES],
    ]
    return F.array(*numbers, *one_hot(F.coalesce(source, F.lit("")), RANKER_SOURCES))


def item_vector(item: str) -> Column:
    """Raw numbers of one chosen item, for the pair vector."""
    names = ("score", "raw_score", "candidate_score", "confidence", "pred_pixels", "reticle_distance")
    numbers = [F.coalesce(F.col(f"{item}.{n}").cast("double"), F.lit(0.0)) for n in names]
    numbers += [_feature(F.col(f"{item}.features"), n) for n in MASK_FEATURES]
    return F.array(*numbers, *one_hot(F.col(f"{item}.candidate_source"), RANKER_SOURCES))


def pair_vector(primary: str, fallback: str) -> Column:
    """Both items, their difference, and the two scores with their difference."""
    a, b = item_vector(primary), item_vector(fallback)
    sa, sb = F.col(f"{primary}.score"), F.col(f"{fallback}.score")
    return F.concat(a, b, F.zip_with(a, b, lambda x, y: x - y), F.array(sa, sb, sa - sb))


def _names(rows: DataFrame, arrays: dict[str, Column]) -> DataFrame:
    """One row of sorted distinct names per kind; the names are the schema of the documents, so they are few."""
    def tagged(kind, names):
        return F.transform(names, lambda n: F.struct(F.lit(kind).alias("kind"), n.alias("name")))

    entries = [tagged(kind, names) for kind, names in arrays.items()]
    # Many rows have the same names, so lists of them are compared before any is taken apart.
    lists = rows.select(F.array_distinct(F.concat(*entries)).alias("l")).distinct()
    seen = lists.select(F.explode("l").alias("e")).select("e.kind", "e.name").distinct()
    return seen.agg(
        *[F.array_sort(F.collect_set(F.when(F.col("kind") == kind, F.col("name")))).alias(f"{kind}_names") for kind in arrays]
    )


def feature_spec(rows: DataFrame, values: str = "values", source: str = "source", flags: str = "flags") -> DataFrame:
    """Names found in the data, as one row: numbers, sources, source groups and flags."""
    s = F.coalesce(source, F.lit(""))
    return _names(
        rows, {"numeric": F.map_keys(values), "source": F.array(s), "source_group": F.array(model_source_group(s)), "flag": F.col(flags)}
    )


def _hot(names: str, value: Column) -> Column:
    return F.transform(names, lambda n: F.when(n == value, 1.0).otherwise(0.0))


def _by_name(names: str, values: Column) -> Column:
    """The values of a map in the order of ``names``, null where it has none; other keys are left out. The empty map of the
    names is made once, by ``_with_spec``.

    ``map_zip_with`` looks both sides up by hash, so this is linear in the names and the keys of the row.
    """
    known = F.coalesce(values.cast("map<string,double>"), F.create_map().cast("map<string,double>"))
    return F.slice(F.map_values(F.map_zip_with(F.col(f"{names}{WANTED}"), known, lambda k, w, v: v)), 1, F.size(names))


def _flag_hot(names: str, flags: Column) -> Column:
    there = F.array_distinct(F.array_compact(flags))
    marks = F.map_from_arrays(there, F.transform(there, lambda f: F.lit(1.0)))
    return F.transform(_by_name(names, marks), lambda m: F.coalesce(m, F.lit(0.0)))


def _with_spec(rows: DataFrame, spec: DataFrame, parts: Callable[[], list[Column]]) -> DataFrame:
    """Adds ``vector`` from the name lists of ``spec``, whose one row goes to every task; no name enters the plan. It
    holds one name per number of a vector, so it is of the size of one row of the result."""
    empty = {f"{c}{WANTED}": F.map_from_arrays(c, F.transform(c, lambda n: F.lit(None).cast("double"))) for c in spec.columns}
    ready = spec.withColumns(empty)
    return rows.crossJoin(F.broadcast(ready)).withColumn("vector", F.concat(*parts())).drop(*ready.columns)


def dense_vectors(rows: DataFrame, spec: DataFrame, values: str = "values", source: str = "source", flags: str = "flags") -> DataFrame:
    """Adds ``vector``: a value and a has-value flag per number, then one-hot source, group and flags."""
    s = F.coalesce(source, F.lit(""))

    def number(value: Column) -> Column:
        return F.array(F.coalesce(value, F.lit(0.0)), value.isNotNull().cast("double"))

    return _with_spec(
        rows, spec,
        lambda: [
            F.flatten(F.transform(_by_name("numeric_names", F.col(values)), number)), _hot("source_names", s),
            _hot("source_group_names", model_source_group(s)), _flag_hot("flag_names", F.col(flags)),
        ],
    )


def pair_spec(pairs: DataFrame) -> DataFrame:
    """Names over both sides of ``current`` and ``candidate`` structs with values, source, pool and flags."""
    def both(fn):
        return F.concat(fn("current"), fn("candidate"))

    def src(i):
        return F.coalesce(F.col(f"{i}.source"), F.lit(""))

    return _names(
        pairs,
        {
            "numeric": both(lambda i: F.map_keys(F.col(f"{i}.values"))), "source": both(lambda i: F.array(src(i))),
            "source_group": both(lambda i: F.array(model_source_group(src(i)))),
            "pool": both(lambda i: F.array(F.coalesce(F.nullif(F.col(f"{i}.pool"), F.lit("")), F.lit("none")))),
            "current_flag": F.col("current.flags"), "candidate_flag": F.col("candidate.flags"),
        },
    )


def pair_vectors(pairs: DataFrame, spec: DataFrame) -> DataFrame:
    """Adds ``vector``: per number the current value and flag, the candidate value and flag and the difference
    (zero unless both are known), then one-hot sources, groups and pools of both sides and the flags."""
    zero = F.lit(0.0)

    def number(a: Column, b: Column) -> Column:
        return F.array(
            F.coalesce(a, zero), a.isNotNull().cast("double"), F.coalesce(b, zero), b.isNotNull().cast("double"), F.coalesce(b - a, zero)
        )

    sides = ("current", "candidate")
    sources = {i: F.coalesce(F.col(f"{i}.source"), F.lit("")) for i in sides}
    pools = {i: F.coalesce(F.nullif(F.col(f"{i}.pool"), F.lit("")), F.lit("none")) for i in sides}
    return _with_spec(
        pairs, spec,
        lambda: [
            F.flatten(F.zip_with(*(_by_name("numeric_names", F.col(f"{i}.values")) for i in sides), number)),
            *(_hot("source_names", sources[i]) for i in sides),
            *(_hot("source_group_names", model_source_group(sources[i])) for i in sides), *(_hot("pool_names", pools[i]) for i in sides),
            *(_flag_hot(f"{i}_flag_names", F.col(f"{i}.flags")) for i in sides),
        ],
    )


def raw_scores(pixels: DataFrame, ball_sizes: DataFrame, threshold: float = 0.35) -> DataFrame:
    """``mean p + 0.8 overlap + 0.002 area`` per candidate from ``(frame_id, candidate_id, p, in_ball)``.

    ``ball_sizes`` has the ball's pixel count; a mask that is empty at the threshold scores zero.
    """
    on = pixels.filter(F.col("p") >= threshold).groupBy("frame_id", "candidate_id").agg(
        F.avg("p").alias("_p"), F.count("*").alias("pred_pixels"), F.count_if("in_ball").alias("_b")
    )
    joined = ball_sizes.join(on, ["frame_id", "candidate_id"], "left")
    overlap = F.col("_b") / F.greatest(F.lit(1), F.col("ball_pixels"))
    raw = F.coalesce(F.col("_p") + 0.8 * overlap + 0.002 * F.col("pred_pixels"), F.lit(0.0))
    return joined.select("frame_id", "candidate_id", F.coalesce("pred_pixels", F.lit(0)).alias("pred_pixels"), raw.alias("raw_score"))


def rank_score(raw: Column, candidate_score: Column, features: Column, validity: Column | None = None) -> Column:
    connection = _feature(features, "ball_boundary_touch") + _feature(features, "connected_to_ball") + _feature(features, "ball_core_overlap")
    score = (
        _log1p0(raw) + 0.7 * candidate_score + 0.2 * _feature(features, "continuity") + 1.2 * connection
        + 0.1 * _feature(features, "outward_extension")
    )
    return score if validity is None else score + F.coalesce(0.5 * validity, F.lit(0.0))


def mlp_score(
    vector: Column, layers: Sequence[tuple[Sequence[Sequence[float]], Sequence[float]]], mean: Sequence[float] | None = None,
    std: Sequence[float] | None = None, sigmoid: bool = True,
) -> Column:
    """Score a feature vector with dense layers (weights by output row), ReLU between them.

    Arrow batches go through one matrix product per layer; the weights are a small fixed model.
    """
    weights = [(np.asarray(w, dtype="float64"), np.asarray(b, dtype="float64")) for w, b in layers]
    shift = None if mean is None else np.asarray(mean, dtype="float64")
    scale = None if std is None else np.where(np.asarray(std, dtype="float64") < 1e-6, 1.0, np.asarray(std, dtype="float64"))

    @F.pandas_udf(T.DoubleType())
    def score(vectors: pd.Series) -> pd.Series:
        if not len(vectors):
            return pd.Series([], dtype="float64")
        x = np.stack(vectors.to_numpy()).astype("float64")
        if shift is not None:
            x = (x - shift) / scale
        for i, (w, b) in enumerate(weights):
            x = x @ w.T + b
            if i + 1 < len(weights):
                x = np.maximum(x, 0.0)
        out = x[:, 0]
        return pd.Series(1.0 / (1.0 + np.exp(-out)) if sigmoid else out)

    return score(vector)


def train_classifier(rows: DataFrame, features: Sequence[str], label: str, seed: int = 42):
    """Logistic classifier with the class balance weight on the positive rows; returns the fitted Spark model."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    from framegate.operators.metrics import class_weight

    weights = rows.agg(class_weight(F.col(label)).alias("_w"))  # one row
    weighted = rows.crossJoin(F.broadcast(weights)).withColumn("weight", F.when(F.col(label) >= 0.5, F.col("_w")).otherwise(1.0))
    stages = [
        VectorAssembler(inputCols=list(features), outputCol="raw"),
        StandardScaler(inputCol="raw", outputCol="scaled", withMean=True),
        LogisticRegression(featuresCol="scaled", labelCol=label, weightCol="weight", maxIter=25),
    ]
    return Pipeline(stages=stages).fit(weighted.withColumn(label, F.col(label).cast("double")))


def classify(model, rows: DataFrame, label: str) -> DataFrame:
    """Adds ``probability`` of the positive class."""
    from pyspark.ml.functions import vector_to_array

    scored = model.transform(rows.withColumn("weight", F.lit(1.0)).withColumn(label, F.col(label).cast("double")))
    return scored.withColumn("probability", vector_to_array("probability")[1]).drop("raw", "scaled", "rawPrediction", "prediction", "weight")


def choose_fallback(pairs: DataFrame, logit: Column) -> DataFrame:
    """Adds ``use_fallback`` and ``achieved_iou``: what the chooser's decision gets."""
    use = logit >= 0.0
    return pairs.withColumns({"use_fallback": use, "achieved_iou": F.when(use, F.col("fallback_iou")).otherwise(F.col("primary_iou"))})


def ranking_quality(candidates: DataFrame, frame: str, score: str, iou: str, position: Sequence[str], threshold: float = 0.0) -> DataFrame:
    """Mean IoU of each frame's best scored candidate and the share of frames whose best score is below a threshold."""
    best = top_per_key(candidates.select(frame, score, iou, *[p for p in position if p not in (score, iou)]), [frame], [F.desc(score), *position])
    return best.agg(
        F.count("*").alias("frames"), F.coalesce(F.avg(iou), F.lit(0.0)).alias("mean_iou"),
        F.coalesce(F.avg((F.col(score) < threshold).cast("double")), F.lit(0.0)).alias("reject_rate"),
    )


def base_weight(dataset_class: Column, save_mode: Column) -> Column:
    mode = F.lower(F.trim(F.coalesce(save_mode, F.lit(""))))
    return (
        F.when((dataset_class == "main") & (mode == "normal"), 1.0)
        .when(dataset_class == "quarantine", 0.8)
        .when(dataset_class == "legacy", 0.85)
        .otherwise(0.9)
    )


def sample_weight(
    base: Column, length: Column, refined: Column, replayed: Column, tiny: tuple[float, float] = (12.0, 1.6),
    small: tuple[float, float] = (20.0, 1.3), refined_mult: float = 1.2, replay_mult: float = 1.5,
) -> Column:
    """Base weight times the size, refinement and replay factors; tiny wins over small."""
    def below(limit):
        return (F.lit(limit) > 0) & (length > 0) & (length < limit)

    size = F.when(below(tiny[0]), tiny[1]).when(below(small[0]), small[1]).otherwise(1.0)
    return base * size * F.when(refined, refined_mult).otherwise(1.0) * F.when(replayed, replay_mult).otherwise(1.0)


def component_distraction(area: Column, width: Column, height: Column, circularity: Column) -> Column:
    one = F.lit(1.0)
    fill = area / F.greatest(F.lit(1), width * height)
    compact = 1.0 - F.least(F.abs(fill - 0.62) / 0.62, one)
    return (
        0.45 * F.least(area / 900.0, one) + 0.20 * F.least(0.5 * (width + height) / 48.0, one) + 0.20 * compact
        + 0.15 * clip(circularity, 0.0, 1.0)
    )


def distractor_scores(components: DataFrame, images: DataFrame, top: int = 5) -> DataFrame:
    """Distractor score per negative image: its component scores plus a coverage bonus, with the best five components.

    ``components`` has ``(image, component_id, area, w, h, circularity)``, ``images`` has ``(image, white_area, pixels)``.
    """
    score = component_distraction(*[F.col(c) for c in ("area", "w", "h", "circularity")])
    scored = components.filter(F.col("area") >= 12).withColumn("score", score)
    sums = scored.groupBy("image").agg(F.sum("score").alias("_s"), F.count("*").alias("component_count"))
    best = top_per_key(scored, ["image"], [F.desc("score"), "component_id"], top, rank="_rn").groupBy("image").agg(
        F.array_sort(F.collect_list(F.struct("_rn", "component_id", "score"))).alias("_top")
    )
    bonus = F.least(F.col("white_area") / F.col("pixels") / 0.02, F.lit(1.0)) * 0.25
    joined = images.join(sums, "image", "left").join(best, "image", "left")
    return joined.select(
        "image", (F.coalesce("_s", F.lit(0.0)) + bonus).alias("score"), F.coalesce("component_count", F.lit(0)).alias("component_count"),
        F.col("_top.component_id").alias("top_components"),
    )


def distractor_linear(white: Column, dark_ring: Column, edges: Column, pixels: Column, elongation: Column) -> Column:
    """Linear form over pixel counts; zero without white pixels."""
    score = white + dark_ring * 1.8 + edges * 1.2 + white / F.greatest(pixels, F.lit(1.0)) * 200.0 + elongation * 25.0
    return F.when(white <= 0, 0.0).otherwise(score)


def component_score(
    area: Column, elongation: Column, white: Column, shell: Column, mean_p: Column, min_area: int, min_elongation: float,
    min_white: float, min_shell: float,
) -> Column:
    """Score of a mask component, null when a hard gate fails."""
    elongation = F.coalesce(elongation, F.lit(1.0))
    ok = (area >= min_area) & (elongation >= min_elongation) & (white >= min_white) & (shell >= min_shell)
    return F.when(ok, 1.8 * white + 1.2 * shell + 0.08 * F.least(elongation, F.lit(12.0)) + 0.9 * mean_p)


def refined_component_score(white: Column, shell: Column, elongation: Column, fill: Column) -> Column:
    return 1.55 * white + 1.10 * shell + 0.75 * F.least(F.lit(10.0), elongation) / 10.0 - 0.45 * fill


def choose_line(
    segments: DataFrame, position: Sequence[str], length_band: tuple[float, float], angle_band: tuple[float, float],
    min_colour: float = 0.25,
) -> DataFrame:
    """Best line per frame from segments ``(x1..y2, ex1..ey2, sat1, sat2, cue_x, cue_y)``: bands on the raw segment,
    colour bonus, distance penalty, and no short stub at the cue ball. A frame without a cue ball has no penalty."""
    raw = F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))
    angle = folded_angle(*[F.col(c) for c in ("x1", "y1", "x2", "y2")])
    extended = F.hypot(F.col("ex2") - F.col("ex1"), F.col("ey2") - F.col("ey1"))
    gap = point_segment_distance(*[F.col(c) for c in ("cue_x", "cue_y", "ex1", "ey1", "ex2", "ey2")])
    rows = segments.withColumns(
        {"_len": raw, "_ang": angle, "_ext": extended, "_gap": F.coalesce(gap, F.lit(0.0)), "_col": F.greatest("sat1", "sat2")}
    )
    stub = F.col("cue_x").isNotNull() & (F.col("_gap") < 4.0) & (F.col("_ext") < 60)
    kept = rows.filter(
        F.col("_len").between(*length_band) & F.col("_ang").between(*angle_band) & ~stub & (F.col("_col") >= min_colour)
    )
    score = 0.2 * F.col("_ext") + 0.2 * F.col("_len") + 50.0 * F.col("_col") - 0.3 * F.col("_gap")
    best = top_per_key(kept.withColumn("score", score), ["frame_id"], [F.desc("score"), *position])
    return best.drop("_len", "_ang", "_ext", "_gap", "_col")


def context_table(
    pixels: DataFrame, circles: DataFrame, rois: DataFrame, position: Sequence[str], image_pixels: int,
    no_candidate: float | None = float("inf"), winners: DataFrame | None = None,
) -> DataFrame:
    """``CONTEXT_FEATURES`` per frame: circles, region share and white share. ``pixels`` has ``saturation`` and ``gray``."""
    white = (F.col("saturation") < 80) & (F.col("gray") > 150)
    shares = pixels.groupBy("frame_id").agg(F.avg(white.cast("double")).alias("mask_white_fraction"))
    inside = roi_fraction(pixels, rois).select("frame_id", F.col("fraction").alias("mask_fraction_in_table_roi"))
    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")) / F.lit(float(max(image_pixels, 1)))
    regions = rois.select("frame_id", area.alias("table_roi_area_fraction"))
    base = context_features(pixels, circles, position, no_candidate, winners)
    return base.join(shares, "frame_id").join(inside, "frame_id", "left").join(regions, "frame_id", "left")


def context_map(table: DataFrame) -> DataFrame:
    """``(frame_id, context)`` for the reject rules: the features of ``context_table`` that a frame has, by name."""
    pairs = [x for n in CONTEXT_FEATURES if n in table.columns for x in (F.lit(n), F.col(n).cast("double"))]
    return table.select("frame_id", F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull()).alias("context"))


def soft_target(signed_distance: Column, hard: Column, scale: float) -> Column:
    """Sigmoid of the signed distance in ``scale`` pixels, at least 0.85 on the mask; a scale under 0.25 counts as 0.25."""
    logits = clip(signed_distance / F.lit(max(0.25, scale)), -20.0, 20.0)
    soft = 1.0 / (1.0 + F.exp(-logits))
    return clip(F.greatest(soft, hard.cast("double") * 0.85), 0.0, 1.0)
