"""Train and validation splits: by group hash, by hash order, by stratum, by time, or from stored ids.

Shuffles are replaced by the order of ``sha1(seed|id)``; the count rules are exact.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from framegate.functions.keys import HASH_BITS_SPAN, stable_fraction
from framegate.operators.order import hash_rank, narrow_rank, null_safe_join


BLOCK_TURNS = 10_000


def _with_totals(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    totals = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    return null_safe_join(df, totals, keys) if keys else df.crossJoin(F.broadcast(totals))  # one row


def _rounded_share(n: Column, ratio: float) -> Column:
    return F.bround(n * F.lit(float(ratio))).cast("bigint")


def group_holdout(items: DataFrame, group_key: str, fraction: float) -> DataFrame:
    """Whole groups whose key hashes below the fraction; the first group if that selects none."""
    share = stable_fraction(F.col(group_key))
    marked = items.withColumn("_in", share < fraction)
    facts = marked.agg(F.bool_or("_in").alias("_any"), F.min(group_key).alias("_first"))  # one row
    chosen = F.when(F.col("_any"), F.col("_in")).otherwise(F.col(group_key) == F.col("_first"))
    return marked.crossJoin(F.broadcast(facts)).filter(chosen).drop("_in", "_any", "_first")


def random_split(rows: DataFrame, id_col: str, val_ratio: float, seed: int) -> DataFrame:
    """Adds ``split``: ``max(1, round(n * ratio))`` rows to ``val`` when there are at least two."""
    ranked = _with_totals(hash_rank(rows, [], id_col, seed, "_rank"), [])
    n_val = F.when(F.col("_n") >= 2, F.greatest(F.lit(1), _rounded_share(F.col("_n"), val_ratio))).otherwise(F.lit(0))
    return ranked.withColumn("split", F.when(F.col("_rank") <= n_val, "val").otherwise("train")).drop("_rank", "_n")


def stratified_split(
    rows: DataFrame, id_col: str, strata: dict[str, Column], val_ratio: float, seed: int, keep_train: bool = True
) -> DataFrame:
    """Adds ``split`` per stratum: a single row goes to train, otherwise at least one to ``val``.

    ``keep_train`` also leaves at least one row for train, which the class split does not ask for.
    """
    keys = [f"_s_{name}" for name in strata]
    keyed = rows.withColumns({f"_s_{name}": column for name, column in strata.items()})
    ranked = _with_totals(hash_rank(keyed, keys, id_col, seed, "_rank"), keys)
    n = F.col("_n")
    wanted = F.greatest(F.lit(1 if val_ratio > 0 else 0), _rounded_share(n, val_ratio))
    if keep_train:
        wanted = F.least(wanted, n - 1)
    n_val = F.when(n <= 1, F.lit(0)).otherwise(wanted)
    return ranked.withColumn("split", F.when(F.col("_rank") <= n_val, "val").otherwise("train")).drop("_rank", "_n", *keys)


def temporal_split(rows: DataFrame, order: Sequence[str], val_ratio: float) -> DataFrame:
    """Adds ``split``: the last share of a time order to ``val``, both sides non-empty."""
    ranked = _with_totals(narrow_rank(rows, order, "_rank"), [])
    n = F.col("_n")
    cut_at = F.greatest(F.lit(1), F.least(n - 1, _rounded_share(n, 1.0 - val_ratio)))
    return ranked.withColumn("split", F.when(F.col("_rank") <= cut_at, "train").otherwise("val")).drop("_rank", "_n")


def resolve_split(
    rows: DataFrame, id_col: str, stored: DataFrame, val_ratio: float, seed: int, mode: str = "existing",
    strata: dict[str, Column] | None = None,
) -> tuple[DataFrame, str]:
    """The split to use and why. Stored ids ``(id, split)`` win if both sides have some; rows in neither side
    are dropped and train wins over val. An empty side is an error."""
    if mode == "stratified":
        result, reason = stratified_split(rows, id_col, strata or {}, val_ratio, seed), "generated_stratified"
    elif mode == "random":
        result, reason = random_split(rows, id_col, val_ratio, seed), "generated_random"
    else:
        sides = stored.filter(F.col("split").isin("train", "val")).groupBy("split").count().count()  # at most two rows
        if sides == 2:
            once = stored.groupBy(id_col).agg(F.min("split").alias("split"))  # "train" sorts before "val"
            result, reason = rows.join(once, id_col), "loaded_existing"
        else:
            result, reason = random_split(rows, id_col, val_ratio, seed), "fallback_random_missing_existing"
    present = {r["split"] for r in result.groupBy("split").count().limit(3).collect()}  # at most two rows
    for side, name in (("train", "training"), ("val", "validation")):
        if side not in present:
            raise ValueError(f"no {name} rows matched the split ids")
    return result, reason


def weighted_choice(
    key: Column, mixes: Sequence[tuple[Column, dict[str, float]]], names: Sequence[str], default: str
) -> Column:
    """Reproducible draw per row: the hash of ``key`` against cumulative weights in a fixed order.

    ``mixes`` pairs a condition with its weights; the first true condition decides.
    """
    draw = stable_fraction(key, HASH_BITS_SPAN)
    result = F.lit(default)
    for condition, weights in reversed(mixes):
        total, bounds = 0.0, []
        for name in names:
            total += weights.get(name, 0.0)
            bounds.append((name, total))
        picked = F.lit(default)
        for name, bound in reversed(bounds):
            picked = F.when(draw <= F.lit(bound), name).otherwise(picked)
        result = F.when(condition, picked).otherwise(result)
    return result


def round_robin_negatives(
    positives: DataFrame, negatives: DataFrame, pos_order: Sequence[str], neg_order: Sequence[str], ratio: float
) -> DataFrame:
    """Negative rows for a positive set: ``ratio`` per positive, half cut from positives, half external.

    Row ``i`` reuses source row ``i`` modulo the source size, so sources repeat evenly. Returns
    ``(sample_id, kind, source_rank)`` joined to the source's columns.
    """
    pos = narrow_rank(positives, pos_order, "_rank").withColumn("_slot", F.col("_rank") - 1).drop("_rank")
    neg = narrow_rank(negatives, neg_order, "_rank").withColumn("_slot", F.col("_rank") - 1).drop("_rank")
    n_pos = positives.agg(F.count("*").alias("n_pos"))
    n_neg = negatives.agg(F.count("*").alias("n_neg"))
    counts = n_pos.crossJoin(n_neg)  # one row
    total = F.bround(F.col("n_pos") * F.lit(max(0.0, ratio))).cast("bigint")
    intra = F.when(F.col("n_neg") > 0, F.ceil(total * 0.5)).otherwise(total)
    sized = counts.select("n_pos", "n_neg", intra.alias("n_intra"), (total - intra).alias("n_ext"))

    def repeat(source: DataFrame, size: str, wanted: str) -> DataFrame:
        """Each source row makes as many copies as it has turns, so nothing is generated apart from the source.

        Turns are cut into blocks that are spread first, so a short source does not turn into a few long tasks.
        """
        facts = source.crossJoin(F.broadcast(sized)).filter(F.col("_slot") < F.col(wanted))  # one row
        turns = F.floor((F.col(wanted) - 1 - F.col("_slot")) / F.greatest(F.lit(1), F.col(size)))
        blocks = facts.withColumn("_turns", turns).withColumn("_block", F.explode(F.sequence(F.lit(0), F.floor(turns / BLOCK_TURNS))))
        first = F.col("_block") * BLOCK_TURNS
        within = F.sequence(first, F.least(F.col("_turns"), first + BLOCK_TURNS - 1))
        spread = blocks.repartition("_slot", "_block").withColumn("_turn", F.explode(within))
        rows = spread.withColumn("position", F.col("_slot") + F.col("_turn") * F.col(size))
        return rows.drop("n_pos", "n_neg", "n_intra", "n_ext", "_slot", "_turns", "_turn", "_block")

    inner = repeat(pos, "n_pos", "n_intra").withColumn("kind", F.lit("intra_negative"))
    outer = repeat(neg, "n_neg", "n_ext").withColumn("kind", F.lit("external_negative"))
    return inner.unionByName(outer, allowMissingColumns=True)
