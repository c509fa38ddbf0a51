"""Shapes shared by several queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

CANDIDATE_ORDER = ["pos", "l_partkey", "l_suppkey", "score"]
ITEM_FIELDS = frozenset(
    ("candidate_id", "candidate_source", "selector_pool", "score", "candidate_score", "pred_pixels", "cx", "cy", "radius")
)


def features() -> Column:
    """Feature map of a candidate row; ``reach`` is missing on every third line."""
    return F.map_filter(
        F.create_map(
            F.lit("ball_fill_fraction"), F.col("candidate_iou").cast("double"),
            F.lit("thinness"), (F.col("radius") / 20.0).cast("double"),
            F.lit("reach"), F.when(F.col("pos") != 3, F.col("cx") / 640.0),
        ),
        lambda k, v: v.isNotNull(),
    )


def flags() -> Column:
    pool = F.col("selector_pool")
    return F.array_compact(F.array(*[F.when(pool == p, F.lit(p)) for p in ("fallback", "rescue")]))


def item(*extra: str) -> Column:
    """A candidate row as one struct, with its feature and flag maps."""
    r = F.col("radius")
    return F.struct(
        "candidate_id", "candidate_source", "selector_pool", "score", "candidate_score", "pred_pixels", "cx", "cy",
        "radius", "candidate_iou",
        (F.col("cx") - r * 3).alias("x0"), (F.col("cy") - r * 3).alias("y0"),
        (F.col("cx") + r * 3).alias("x1"), (F.col("cy") + r * 3).alias("y1"),
        features().alias("features"), flags().alias("flags"), *extra,
    )


def frame_winners(candidates: DataFrame) -> DataFrame:
    """One winner per frame: the best score, first row on a tie."""
    from framegate.operators.ranking import top_per_key

    return top_per_key(candidates, ["frame_id"], [F.desc("score"), "pos", "l_partkey", "l_suppkey"])


WINNER_SQL = """(SELECT * FROM fx_candidates
  QUALIFY row_number() OVER (PARTITION BY frame_id ORDER BY score DESC, pos, l_partkey, l_suppkey) = 1)"""
