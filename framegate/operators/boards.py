"""Boards, training manifests, data set merges and run comparisons."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from framegate.functions import geometry as G
from framegate.functions import keys as K
from framegate.operators import filters as X
from framegate.operators.documents import flatten_leaves
from framegate.operators.ranking import cap_per_key, hash_sample, keep_first, top_per_key
from framegate.operators.spatial import crop_kind, pixels_in_boxes
from framegate.operators.splits import group_holdout

# Kinds of the label index and of the veto board.
VETO_BOARD_KINDS = {"rejected_negative": "rejected_negatives", "external_negative": "flat_negatives"}
MASKED_PATH = "CHECKPOINT_PATH"


def tagged_union(parts: Sequence[tuple[DataFrame, dict[str, str]]], id_col: str) -> DataFrame:
    """Union of data sets with different columns; empty tag columns get the part's default; an empty id is an error."""
    merged: DataFrame | None = None
    for rows, defaults in parts:
        for name, value in defaults.items():
            known = F.nullif(F.col(name), F.lit("")) if name in rows.columns else F.lit(None).cast("string")
            rows = rows.withColumn(name, F.coalesce(known, F.lit(value)))
        merged = rows if merged is None else merged.unionByName(rows, allowMissingColumns=True)
    text = F.trim(F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    problem = F.raise_error("some merged rows have no id").cast("boolean")
    return merged.filter(F.when(text != "", F.lit(True)).otherwise(problem))


def distinct_ids(parts: Sequence[DataFrame], id_col: str) -> DataFrame:
    ids = parts[0].select(id_col)
    for other in parts[1:]:
        ids = ids.union(other.select(id_col))
    return ids.distinct()


def append_residuals(base: DataFrame, evaluated: DataFrame, lookup: DataFrame, max_iou: float) -> DataFrame:
    """The base index plus one crop row per evaluated frame at or below an IoU; frames missing in the lookup are left out.

    ``evaluated`` has ``(id, iou, cx, cy, radius, score, winner_source)``, ``lookup`` has the paths and frame size.
    """
    rows = X.residuals(evaluated, max_iou, ["id"]).join(lookup, "id")
    b = G.square_crop_box(F.col("cx"), F.col("cy"), F.col("radius"), F.col("width"), F.col("height"))
    crops = rows.select(
        F.lit("residual_policy_negative").alias("kind"), "id", "image_path", "mask_path",
        *[b[c].cast("bigint").alias(c) for c in ("x0", "y0", "x1", "y1")], F.lit(0).cast("bigint").alias("mask_pixels"),
        F.col("score").alias("winner_score"), "winner_source", F.col("iou").alias("winner_iou"),
    )
    return base.unionByName(crops, allowMissingColumns=True)


def import_decisions(source: DataFrame, target: DataFrame, prefix: str, valid: Column, position: Sequence[str]) -> DataFrame:
    """What happens to every source row: ``imported``, ``exists`` or ``invalid``.

    A row exists if its source id or its new id is taken, also by an earlier row of the same batch. An invalid row
    takes no id, so a later valid copy is imported.
    """
    sid = F.trim(F.coalesce(F.col("id").cast("string"), F.lit("")))
    rows = source.withColumns({"source_id": sid, "new_id": F.concat(F.lit(prefix), sid), "_valid": F.coalesce(valid, F.lit(False)) & (sid != "")})
    taken_source = target.select(F.trim("source_sample_id").alias("source_id")).filter("source_id <> ''").distinct().withColumn("_s", F.lit(1))
    taken_id = target.select(F.trim("id").alias("new_id")).filter("new_id <> ''").distinct().withColumn("_i", F.lit(1))
    known = rows.join(taken_source, "source_id", "left").join(taken_id, "new_id", "left")
    known = known.withColumn("_known", F.col("_s").isNotNull() | F.col("_i").isNotNull())
    # Per id only the first valid row can be imported; where it sits decides about its copies.
    first = known.filter(F.col("_valid") & ~F.col("_known")).groupBy("source_id").agg(F.min(F.struct(*position)).alias("_first"))
    joined = known.join(first, "source_id", "left")
    at = F.struct(*position)
    decision = (
        F.when(F.col("source_id") == "", "invalid")
        .when(F.col("_known") | (at > F.col("_first")), "exists")
        .when(at == F.col("_first"), "imported")
        .otherwise("invalid")
    )
    return joined.withColumn("decision", decision).drop("_s", "_i", "_known", "_valid", "_first")


def import_absent(decided: DataFrame, target: DataFrame) -> DataFrame:
    """The target with the imported rows appended."""
    new = decided.filter("decision = 'imported'").select(F.col("new_id").alias("id"), F.col("source_id").alias("source_sample_id"))
    return target.unionByName(new, allowMissingColumns=True)


def run_difference(before: DataFrame, after: DataFrame, key: str, compared: Sequence[str]) -> DataFrame:
    """Ids added, removed or changed between two runs."""
    a = before.select(key, F.struct(*compared).alias("_a"), F.lit(1).alias("_l"))
    b = after.select(key, F.struct(*compared).alias("_b"), F.lit(1).alias("_r"))
    change = (
        F.when(F.col("_l").isNull(), "added").when(F.col("_r").isNull(), "removed").when(~F.col("_a").eqNullSafe(F.col("_b")), "changed")
    )
    return a.join(b, key, "full_outer").select(key, change.alias("change")).filter("change IS NOT NULL")


def work_list(jobs: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Jobs whose output does not exist yet."""
    return jobs.join(done.select(key).distinct(), key, "left_anti")


def gold_board(
    old_index: DataFrame, annotations: DataFrame, rejected: DataFrame, flat: DataFrame, fraction: float, bucket_size: int = 25
) -> DataFrame:
    """Leakage-safe board: the old validation splits, and whole-group holdouts of harvested and negative frames.

    ``old_index`` has ``(split, id, image_path, mask_path, pos)``; the annotation tables have ``id, image_path, mask_path,
    source_image_path, created_at``; ``flat`` has ``image_path``. Held out rows never share a group with rows left for training.
    """
    columns = ["split", "id", "kind", "image_path", "mask_path", "source", "group_key"]
    none = F.lit(None).cast("string")

    def old(split, name):
        first = keep_first(old_index.filter(F.col("split") == split), ["id"], ["pos"])
        return first.select(
            F.lit(name).alias("split"), "id", F.lit("positive").alias("kind"), "image_path", "mask_path", F.lit(split).alias("source"), none.alias("group_key")
        )

    def items(rows, kind, source, mask):
        origin = F.coalesce(F.nullif("source_image_path", F.lit("")), F.nullif("image_path", F.lit("")), F.col("id"))
        return rows.select(
            F.lit(source).alias("split"), "id", F.lit(kind).alias("kind"), "image_path", mask.alias("mask_path"), F.lit(source).alias("source"),
            K.frame_group_key(origin, bucket_size).alias("group_key"),
        )

    val, hard = old("val", "old_val"), old("hard_val", "old_hard_val")
    harvested = X.harvest_records(annotations, "source_image_path", "created_at")
    fresh = harvested.join(val.select("id").union(hard.select("id")).distinct(), "id", "left_anti")
    stem = K.strip_suffix(K.file_name(F.col("image_path")))
    singles = flat.withColumns({"id": stem, "source_image_path": F.col("image_path")})
    parts = [
        val, hard,
        group_holdout(items(fresh, "positive", "harvest_holdout", F.col("mask_path")), "group_key", fraction),
        group_holdout(items(rejected, "image_negative", "rejected_negatives", none).withColumn("source", F.lit("rejected_negative")), "group_key", fraction),
        group_holdout(items(singles, "flat_negative", "flat_negatives", none).withColumn("source", F.lit("flat_negative")), "group_key", fraction),
    ]
    board = parts[0].select(*columns)
    for part in parts[1:]:
        board = board.unionByName(part.select(*columns))
    return board


def exclude_ids(board: DataFrame) -> DataFrame:
    """The ids on the board, each once: rows that must not be trained on."""
    return board.select("id").distinct()


def board_policy(spark: SparkSession, fraction: float, bucket_size: int = 25) -> DataFrame:
    """The one row of settings that goes with a board."""
    return spark.createDataFrame([(3, float(fraction), int(bucket_size))], "version int, holdout_fraction double, frame_bucket_size int")


def veto_train_board(index: DataFrame, split: str, position: Sequence[str], limit: int | None = None) -> DataFrame:
    """Board of one index split: positives, rejected and external negatives, first row per image."""
    kind = F.col("kind")
    target = F.when(kind.endswith("_positive") & (F.coalesce("mask_path", F.lit("")) != ""), "positives")
    for name, board in VETO_BOARD_KINDS.items():
        target = target.when(kind == name, board)
    rows = index.filter((F.col("split") == split) & (F.coalesce("image_path", F.lit("")) != "")).withColumn("board", target)
    first = keep_first(rows.filter("board IS NOT NULL"), ["board", "image_path"], position)
    kept = first if limit is None else top_per_key(first, ["board"], position, limit)
    return kept.select(F.concat(F.lit(f"{split}_"), "board").alias("split"), K.base_sample_id(F.col("id")).alias("id"), "image_path", "mask_path")


def veto_dataset(rows: DataFrame) -> DataFrame:
    """Evaluated rows with the veto target: 1 where a negative frame has a prediction."""
    target = ((F.col("gt_pixels") <= 0) & (F.col("pred_pixels") > 0)).cast("int")
    return rows.withColumn("target", target)


def veto_dataset_from_reports(board: DataFrame, reports: DataFrame, values: str = "values", own: str = "own_pixels") -> DataFrame:
    """Board items joined to their report by ``(split, id)``; items without one are marked missing.

    ``reports`` is already reduced to the first root that has each report; it carries the number map and own pixel count.
    """
    joined = board.join(reports, ["split", "id"], "left")
    positive = K.is_positive_item(F.col("split"), F.col("kind"), F.col("mask_path"))
    pixels = K.winner_pred_pixels(F.col(own), F.coalesce(values, F.create_map().cast("map<string,double>")))
    marked = joined.withColumns({"has_report": F.col(values).isNotNull(), "_pos": positive, "pred_pixels": pixels})
    label = (
        F.when(F.col("_pos"), "positive_unscored").when(F.col("pred_pixels") > 0, "negative_false_positive").otherwise("true_negative")
    )
    target = (~F.col("_pos") & (F.col("pred_pixels") > 0)).cast("int")
    return marked.select(
        "split", "id", "has_report", F.when(F.col("has_report"), F.col("pred_pixels")).alias("pred_pixels"),
        F.when(F.col("has_report"), label).alias("failure_type"), F.when(F.col("has_report"), target).alias("target"),
    )


def arbiter_pairs(
    diagnostics: DataFrame, positive_iou: float = 0.5, negative_iou: float = 0.05, min_improvement: float = 0.25
) -> DataFrame:
    """Training pairs of the current winner with every other listed candidate.

    ``diagnostics`` has ``id, final_iou, winner`` and an array ``candidates`` of at most a few report entries per row;
    copies are dropped by id, source, pool, pixels and rounded score, first one first.
    """
    listed = diagnostics.select("id", "final_iou", "winner", F.posexplode("candidates").alias("_p", "candidate"))
    c = F.col("candidate")
    keyed = listed.withColumns(
        {"_k1": c["candidate_id"], "_k2": c["candidate_source"], "_k3": c["selector_pool"], "_k4": c["pred_pixels"], "_k5": F.round(c["score"], 6)}
    )
    unique = keep_first(keyed, ["id", "_k1", "_k2", "_k3", "_k4", "_k5"], ["_p"])
    w, iou = F.col("winner"), F.coalesce(c["candidate_iou"], F.lit(0.0))
    same = c["candidate_id"].eqNullSafe(w["candidate_id"]) & c["selector_pool"].eqNullSafe(w["selector_pool"])
    gained = (iou >= positive_iou) & (iou >= F.coalesce("final_iou", F.lit(0.0)) + min_improvement)
    target = F.when(gained, 1).when(iou <= negative_iou, 0)
    return unique.filter(~same).withColumn("target", target).filter("target IS NOT NULL").select("id", "winner", "candidate", "target")


def reranker_frames(
    index: DataFrame, board: DataFrame, position: Sequence[str], val_fraction: float, train_limit: int | None, val_limit: int | None
) -> DataFrame:
    """Frames to score for ranker training: unique positives per split, negatives split by the hash of their id."""
    usable = index.filter((F.coalesce("mask_path", F.lit("")) != "") & ~F.coalesce("zero_mask", F.lit(False)))
    unique = keep_first(X.keep_kinds(usable, X.POSITIVE_KINDS), ["split", "id"], position)
    positives = unique.select(F.when(F.col("split") == "hard_val", "hard").otherwise(F.col("split")).alias("part"), F.col("id").alias("frame_id"))
    negatives = keep_first(board.filter(F.col("kind").isin(*X.NEGATIVE_KINDS)), ["id"], position)
    share = K.stable_fraction(F.col("id"), K.HASH_BITS_SPAN)
    part = F.when(share < val_fraction, "negative_val").otherwise("negative_train")
    split = negatives.select(part.alias("part"), F.col("id").alias("frame_id"))

    def limited(name, limit):
        rows = split.filter(F.col("part") == name)
        return rows if limit is None else rows.orderBy("frame_id").limit(limit)

    return positives.unionByName(limited("negative_train", train_limit)).unionByName(limited("negative_val", val_limit))


def subset_catalogue(
    positives: DataFrame, negatives: DataFrame, tiny: float, short: float, top_k: int, with_negatives: bool = True
) -> DataFrame:
    """Membership of the fixed subsets: tiny lines, short lines, and the negatives that distract most.

    ``with_negatives`` adds every negative to the line subsets (the benchmark form); the replay form leaves them out.
    """
    image = F.col("image_path")

    def member(rows, name):
        return rows.select(F.lit(name).alias("subset"), image.alias("image_path"))

    result = None
    for name, limit in (("tiny", tiny), ("short", short)):
        part = member(positives.filter(F.col("major_len") < limit), name)
        if with_negatives:
            part = part.unionByName(member(negatives, name))
        result = part if result is None else result.unionByName(part)
    top = negatives.orderBy(F.desc("score"), "image_path").limit(max(1, top_k))
    return result.unionByName(member(top, "distractors"))


def benchmark_manifest(rows: DataFrame | None, images: DataFrame, n: int, seed: int) -> DataFrame:
    """The images of an earlier run if there is one, else a reproducible sample."""
    if rows is not None:
        return rows.filter(F.trim("image_path") != "").select("image_path")
    return hash_sample(images.select("image_path"), "image_path", n, seed)


def training_rows(positives: DataFrame, negatives: DataFrame, validation: bool) -> DataFrame:
    """Row table of one side with the defaults of each kind.

    ``negatives`` carries ``kind`` and, for patches cut from positives, the positive's columns and weight.
    """
    columns = ["sample_id", "kind", "image_path", "mask_path", "dataset_split", "save_mode", "sample_weight", "source"]
    none = F.lit(None).cast("string")
    pos = positives.withColumn("kind", F.lit("positive")).select(*columns)
    ext = negatives.filter("kind = 'external_negative'").select(
        "sample_id", "kind", "image_path", none.alias("mask_path"), F.lit("negative_external").alias("dataset_split"),
        F.lit("none").alias("save_mode"), F.lit(1.0).alias("sample_weight"), "source",
    )
    rows = pos.unionByName(ext)
    if validation:
        return rows
    patch = negatives.filter("kind = 'intra_negative'").select(
        F.format_string("INTRA_%06d", "position").alias("sample_id"), "kind", "image_path", none.alias("mask_path"), "dataset_split",
        "save_mode", F.greatest(F.lit(0.75), F.col("sample_weight") * 0.95).alias("sample_weight"), F.lit("intra_negative_patch").alias("source"),
    )
    return rows.unionByName(patch)


def crop_index(
    records: DataFrame, pixels: DataFrame, candidates: DataFrame, context_sides: Sequence[int], padding: float, min_pixels: int,
    negatives_per_record: int, seed: int, width: int, height: int,
) -> DataFrame:
    """Crop rows per record: view, box, context and candidate crops, with the mask pixels each holds.

    ``records`` has ``frame_id, split`` and an optional view box ``vx0..vy1``; ``pixels`` are the mask pixels;
    ``candidates`` has ``frame_id, candidate_key, cx, cy, radius``. Context crops repeat no earlier box of the record.
    """
    w, h = F.lit(width), F.lit(height)
    mask = pixels.groupBy("frame_id").agg(
        F.count("*").alias("all_pixels"), F.min("x").alias("mx0"), F.min("y").alias("my0"), (F.max("x") + 1).alias("mx1"), (F.max("y") + 1).alias("my1")
    )
    base = records.join(mask, "frame_id")
    mask_box = G.box(*[F.col(c) for c in ("mx0", "my0", "mx1", "my1")])
    view = G.box(*[F.coalesce(v, m) for v, m in zip(("vx0", "vy0", "vx1", "vy1"), ("mx0", "my0", "mx1", "my1"))])
    longest = F.greatest(F.col("mx1") - F.col("mx0"), F.col("my1") - F.col("my0"))
    cx, cy = (F.col("mx0") + F.col("mx1")) / F.lit(2.0), (F.col("my0") + F.col("my1")) / F.lit(2.0)

    def entry(kind, b, side=None, when=None):
        fields = F.struct(
            F.lit(kind).alias("kind"), F.lit(side).cast("bigint").alias("context_side"), *[b[c].cast("bigint").alias(c) for c in ("x0", "y0", "x1", "y1")]
        )
        return fields if when is None else F.when(when, fields)

    fixed = [entry("view_positive", G.square_box_from_xyxy(view, padding, w, h)), entry("bbox_positive", G.square_box_from_xyxy(mask_box, padding, w, h))]
    context = [
        entry("context_positive", G.square_box_from_center_side(cx, cy, F.lit(side), w, h), side, longest < side) for side in sorted(set(context_sides))
    ]
    boxes = base.select("frame_id", "split", "all_pixels", F.posexplode(F.array(*fixed, *context)).alias("_p", "e")).filter("e IS NOT NULL")
    boxes = boxes.select("frame_id", "split", "all_pixels", "_p", "e.*")
    plain = boxes.filter("kind <> 'context_positive'")
    # The first box of a geometry wins; the two fixed crops stay even when they are equal.
    first = keep_first(boxes, ["frame_id", "x0", "y0", "x1", "y1"], ["_p"]).filter("kind = 'context_positive'")
    counted = pixels_in_boxes(pixels, first, ["frame_id", "context_side"]).filter(F.col("mask_pixels") >= min_pixels)
    columns = ["frame_id", "split", "kind", "x0", "y0", "x1", "y1", "context_side", "candidate_key", "mask_pixels"]
    none = F.lit(None).cast("string").alias("candidate_key")
    rows = plain.withColumn("mask_pixels", F.col("all_pixels")).unionByName(counted).withColumn("candidate_key", none).select(*columns)

    crop = G.square_crop_box(F.col("cx"), F.col("cy"), F.col("radius"), w, h)
    crops = candidates.join(base.select("frame_id", "split"), "frame_id").select(
        "frame_id", "split", "candidate_key", *[crop[c].cast("bigint").alias(c) for c in ("x0", "y0", "x1", "y1")]
    )
    judged = pixels_in_boxes(pixels, crops, ["frame_id", "candidate_key"]).withColumn("kind", crop_kind(F.col("mask_pixels"), min_pixels))
    judged = judged.withColumn("context_side", F.lit(None).cast("bigint"))
    positive = judged.filter("kind = 'candidate_positive'").select(*columns)
    negative = cap_per_key(judged.filter("kind = 'candidate_negative'"), ["frame_id"], "candidate_key", negatives_per_record, seed)
    return rows.unionByName(positive).unionByName(negative.select(*columns))


def image_negatives(images: DataFrame, candidates: DataFrame, per_image: int, kind: str, width: int, height: int, position: Sequence[str]) -> DataFrame:
    """Zero-mask crops of negative images: their first candidates, or the centred full square when they have none."""
    square = G.centred_full_square(F.lit(width), F.lit(height))
    side = square["x1"] - square["x0"]
    top = top_per_key(candidates.join(images, "frame_id", "left_semi"), ["frame_id"], position, max(1, per_image), rank="_rn")
    crop = G.square_crop_box(F.col("cx"), F.col("cy"), F.col("radius"), F.lit(width), F.lit(height))
    named = [crop[c].cast("bigint").alias(c) for c in ("x0", "y0", "x1", "y1")]
    found = top.select("frame_id", (F.col("_rn") - 1).alias("n"), F.col("radius").cast("bigint").alias("radius"), "candidate_source", *named)
    bare = images.join(top.select("frame_id").distinct(), "frame_id", "left_anti").select(
        "frame_id", F.lit(0).alias("n"), G.whole(side * 0.08).alias("radius"), F.lit("full_image").alias("candidate_source"),
        *[square[c].cast("bigint").alias(c) for c in ("x0", "y0", "x1", "y1")],
    )
    rows = found.unionByName(bare)
    return rows.select(F.lit(kind).alias("kind"), F.concat_ws("_", "frame_id", "n").alias("id"), "candidate_source", "radius", "x0", "y0", "x1", "y1")


def policy_difference(left: DataFrame, right: DataFrame, doc: str) -> DataFrame:
    """Keys whose value differs between two nested policy documents, checkpoint paths aside. Empty means equal."""
    def leaves(df, name):
        flat = flatten_leaves(df.select(F.lit(0).alias("_id"), F.col(doc)), "_id", doc)
        path = F.lower("value").endswith(".pt") | F.lower("value").endswith(".pth")
        return flat.select("name", F.when(path, MASKED_PATH).otherwise(F.col("value")).alias(name), F.lit(1).alias(f"_{name}"))

    joined = leaves(left, "left").join(leaves(right, "right"), "name", "full_outer")
    return joined.filter(~F.col("left").eqNullSafe(F.col("right")) | F.col("_left").isNull() | F.col("_right").isNull()).select("name", "left", "right")
