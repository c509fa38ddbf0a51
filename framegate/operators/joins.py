"""Lookups, semi and anti joins, tiered matching and rule selection between relations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from framegate.functions import rules as R
from framegate.functions.geometry import Box, box, box_iou, point_distance
from framegate.operators.ranking import hash_sample, keep_first, top_per_key
from framegate.runtime import stage, broadcast_if_small


def lookup(rows: DataFrame, base: DataFrame, keys: Sequence[str]) -> DataFrame:
    return rows.join(base, list(keys), "inner")


def missing(rows: DataFrame, base: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The keys that the base does not hold, each once."""
    return rows.select(*keys).distinct().join(base.select(*keys), list(keys), "left_anti")


def latest_per_key(rows: DataFrame, keys: Sequence[str], created_at: str, position: Sequence[str]) -> DataFrame:
    """Newest row per key by its ISO text; the first row wins a tie, a missing time is oldest."""
    return keep_first(rows, keys, [F.coalesce(created_at, F.lit("")).desc(), *position])


def ordered_lookup(wanted: DataFrame, latest: DataFrame, key: str, complete: Column) -> DataFrame:
    """Left lookup of a wanted list; rows without a complete match are marked missing."""
    marked = latest.withColumn("_complete", complete)
    joined = wanted.join(marked, key, "left")
    return joined.withColumn("found", F.coalesce("_complete", F.lit(False))).drop("_complete")


def in_either(rows: DataFrame, by_id: DataFrame, id_col: str, by_key: DataFrame, key_col: str) -> DataFrame:
    """Rows whose id is in one set or whose key is in another; two equi joins, never a nested loop."""
    ids = by_id.select(id_col).distinct().withColumn("_id_hit", F.lit(True))
    paths = by_key.select(key_col).distinct().withColumn("_key_hit", F.lit(True))
    joined = rows.join(broadcast_if_small(ids), id_col, "left").join(broadcast_if_small(paths), key_col, "left")
    return joined.filter(F.col("_id_hit") | F.col("_key_hit")).drop("_id_hit", "_key_hit")


def eligible_sample(
    rows: DataFrame, key: Column, exclusions: Sequence[DataFrame], id_col: str, n: int, seed: int
) -> DataFrame:
    """Rows outside the union of the exclusion sets (one column each, case folded), then a sample of n."""
    excluded = exclusions[0].toDF("_key")
    for other in exclusions[1:]:
        excluded = excluded.unionByName(other.toDF("_key"))
    folded = excluded.select(F.lower("_key").alias("_key")).distinct()
    kept = rows.withColumn("_key", F.lower(key)).join(folded, "_key", "left_anti").drop("_key")
    return hash_sample(kept, id_col, n, seed)


def aligned_join(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """1:1 join of two data sets that must hold the same keys; a missing partner is an error."""
    a, b = left.withColumn("_l", F.lit(1)), right.withColumn("_r", F.lit(1))
    joined = a.join(b, key, "full_outer")
    mismatch = F.raise_error("the two data sets hold different frames").cast("boolean")
    aligned = F.col("_l").isNotNull() & F.col("_r").isNotNull()
    return joined.filter(F.when(aligned, F.lit(True)).otherwise(mismatch)).drop("_l", "_r")


def _item_box(item: str) -> Box:
    return box(*[F.col(f"{item}.{c}") for c in ("x0", "y0", "x1", "y1")])


def similarity(a: str, b: str) -> Column:
    """Centre closeness within 32, box IoU and pixel closeness within 64, each at most one."""
    distance = point_distance(F.col(f"{a}.cx"), F.col(f"{a}.cy"), F.col(f"{b}.cx"), F.col(f"{b}.cy"))
    delta = F.abs(F.col(f"{a}.pred_pixels") - F.col(f"{b}.pred_pixels"))
    near = F.greatest(F.lit(0.0), 32.0 - distance) / 32.0
    size = F.greatest(F.lit(0.0), 64.0 - delta) / 64.0
    zero = F.lit(0.0)
    return F.coalesce(near, zero) + F.coalesce(box_iou(_item_box(a), _item_box(b)), zero) + F.coalesce(size, zero)


# Match labels in order of preference.
MATCH_TIERS = (
    "exact_key_and_geometry",
    "same_source_pool_geometry",
    "same_source_geometry_different_pool",
    "similar_source_pool_geometry",
    "same_key_geometry_mismatch",
)
MIN_SIMILARITY = 1.25


def tiered_match(targets: DataFrame, candidates: DataFrame, key: str, position: Sequence[str]) -> DataFrame:
    """Best candidate of the same key for each ``target`` struct, by the first tier that has one.

    Both sides carry a struct (``target``, ``candidate``) with id, source, pool, centre, box and pixels.
    """

    def same(*fields):
        return R.all_of([F.col(f"target.{f}").eqNullSafe(F.col(f"candidate.{f}")) for f in fields])

    def pool_of(item):
        return F.coalesce(F.nullif(F.col(f"{item}.selector_pool"), F.lit("")), F.lit("primary"))

    geometry = same("cx", "cy", "x0", "y0", "x1", "y1")
    source, pool = same("candidate_source"), pool_of("target") == pool_of("candidate")
    same_key = same("candidate_id") & source & pool
    close = similarity("candidate", "target")
    tier = R.first_matching(
        [same_key & geometry, source & pool & geometry, source & geometry, source & pool & (close >= MIN_SIMILARITY), same_key]
    )
    pairs = targets.select(key, "target").join(candidates.select(key, "candidate", *position), key)
    ranked = pairs.withColumn("_tier", tier).filter(F.col("_tier").isNotNull())
    by_close = F.when(F.col("_tier") == 4, close).otherwise(F.lit(0.0))
    best = top_per_key(ranked, [key], ["_tier", by_close.desc(), *position])
    label = F.element_at(F.array(*[F.lit(m) for m in MATCH_TIERS]), F.col("_tier"))
    matched = best.select(key, "candidate", label.alias("match_type"))
    unmatched = F.when(F.col("target").isNull(), "no_wide_best_candidate").otherwise("not_found")
    return targets.join(matched, key, "left").withColumn("match_type", F.coalesce("match_type", unmatched))


def availability_label(
    has_run: Column, matched: Column, match_type: Column, matched_iou: Column, run_best_iou: Column,
    run_failure: Column, wide_best_iou: Column, success_iou: float,
) -> Column:
    """What a run offered for a frame that a wider run could solve."""
    good = F.coalesce(matched_iou, F.lit(0.0)) >= success_iou
    alternate = F.coalesce(run_best_iou, F.lit(0.0)) >= success_iou
    return (
        F.when(~has_run, "missing_deployed_diagnostic")
        .when(matched & good & (match_type == MATCH_TIERS[0]), "available_exact_high_iou")
        .when(matched & good & (match_type == MATCH_TIERS[2]), "available_equivalent_different_pool_high_iou")
        .when(matched & good, "available_similar_high_iou")
        .when(matched, "candidate_present_but_low_iou_or_zero")
        .when(alternate & (run_failure == "selector_or_reranker_miss"), "alternate_high_iou_available")
        .when(alternate, "alternate_high_iou_not_selector")
        .when(F.coalesce(wide_best_iou, F.lit(0.0)) >= success_iou, "diagnostic_primary32_only_or_unavailable")
        .otherwise("not_relevant_low_iou")
    )


def select_by_rules(
    current: DataFrame, pool: DataFrame, rules: Sequence[R.Rule], key: str, position: Sequence[str],
    current_fields: frozenset[str], candidate_fields: frozenset[str], allowed: Sequence[Column] | None = None,
    narrow: bool = False,
) -> DataFrame:
    """Per key the candidate chosen by the first rule that any candidate satisfies.

    Each pair gets the number of its first satisfied rule; the smallest number in a key is the first
    rule with an eligible candidate, so one top-1 per key answers the whole rule list. Each side is cut
    to the rows some rule can use before the join. ``allowed`` adds one condition per rule that may look
    at every column of ``current`` (which pools a rule may search). ``narrow`` gives only key, position, ``candidate`` and
    ``rule_no``.
    """
    cur, cand = R.Item("current", current_fields), R.Item("candidate", candidate_fields)
    left = current.filter(R.any_of([R.current_side(cur, r) for r in rules]))
    right = pool.select(key, "candidate", *position).filter(R.any_of([R.candidate_side(cand, r) for r in rules]))
    extra = allowed or [F.lit(True)] * len(rules)
    both = [
        R.current_side(cur, r) & R.candidate_side(cand, r) & R.different_item(cur, cand) & ok for r, ok in zip(rules, extra)
    ]
    pairs = left.join(right, key).withColumn("rule_no", R.first_matching(both)).filter(F.col("rule_no").isNotNull())
    preference = R.by_number(F.col("rule_no"), [R.selection_order(cand, r) for r in rules])
    if narrow:
        pairs = pairs.select(key, *position, "candidate", "rule_no", preference.alias("_preference"))
        return top_per_key(pairs, [key], ["rule_no", F.desc("_preference"), *position]).drop("_preference")
    return top_per_key(pairs, [key], ["rule_no", preference.desc(), *position])


def triplet_completeness(images: DataFrame, masks: DataFrame, previews: DataFrame, name: str) -> DataFrame:
    """Each image with the sibling files it lacks; an empty reason means complete."""
    m = masks.select(name).distinct().withColumn("_m", F.lit(1))
    p = previews.select(name).distinct().withColumn("_p", F.lit(1))
    joined = images.join(m, name, "left").join(p, name, "left")
    lacking = F.array_compact(
        F.array(F.when(F.col("_m").isNull(), F.lit("mask")), F.when(F.col("_p").isNull(), F.lit("preview")))
    )
    return joined.withColumn("missing", F.array_join(lacking, ", ")).drop("_m", "_p")


def current_category(items: DataFrame, placed: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """First category, in a fixed order, that already holds an item; else ``UNSORTED``."""
    rank = F.array_position(F.array(*[F.lit(c) for c in order]), F.col("category"))
    first = placed.filter(F.col("category").isin(*order)).groupBy(key).agg(F.min(rank).alias("_rank"))
    name = F.try_element_at(F.array(*[F.lit(c) for c in order]), F.col("_rank").cast("int"))
    joined = items.join(first, key, "left")
    return joined.withColumn("category", F.coalesce(name, F.lit("UNSORTED"))).drop("_rank")


def already_labelled(rows: DataFrame, path: str, labelled: Sequence[DataFrame]) -> DataFrame:
    """Adds ``is_labelled``: the case-folded path occurs in any of the label sets (one column each)."""
    seen = labelled[0].toDF("_path")
    for other in labelled[1:]:
        seen = seen.unionByName(other.toDF("_path"))
    seen = seen.select(F.lower("_path").alias("_path")).distinct().withColumn("_hit", F.lit(True))
    joined = rows.withColumn("_path", F.lower(path)).join(seen, "_path", "left")
    return joined.withColumn("is_labelled", F.col("_hit").isNotNull()).drop("_path", "_hit")


def restrict_to_manifest(rows: DataFrame, manifest: DataFrame, key: str) -> DataFrame:
    """Rows whose key is in the manifest; no match at all is an error."""
    kept = stage(rows.join(manifest.select(key).distinct(), key, "left_semi"), "restricted")
    if kept.isEmpty():
        raise ValueError("the manifest matches no row")
    return kept
