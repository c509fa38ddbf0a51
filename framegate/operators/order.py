"""Ranks, prefix sums and quantiles that never put a whole group into one task.

Rows are range partitioned on the full order, so a hot key is spread over many partitions; only one
total per (partition, key) travels further. The placed rows are checkpointed because the partition
bounds come from a sample and must be the same for the totals and for the rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from framegate.runtime import cut

PART, INDEX = "_part", "_index"


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi join on ``keys`` that also matches null keys; the keys of the left side are kept."""
    renamed = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    on = [left[k].eqNullSafe(renamed[f"_r_{k}"]) for k in keys]
    return left.join(renamed, on, how).drop(*[f"_r_{k}" for k in keys])


def _columns(names: Sequence[str | Column]) -> list[Column]:
    return [F.col(n) if isinstance(n, str) else n for n in names]


def _place(df: DataFrame, order: Sequence[Column]) -> DataFrame:
    # Without a fixed number adaptive execution merges small neighbouring ranges, which keeps their order.
    placed = (
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_place", F.monotonically_increasing_id())
    )
    return cut(
        placed.withColumn(PART, F.shiftright("_place", 33))
        .withColumn(INDEX, F.col("_place").bitwiseAND((1 << 33) - 1))
        .drop("_place")
    )


def global_rank(df: DataFrame, order: Sequence[str | Column], name: str = "rank") -> DataFrame:
    """1-based position of every row in a total order. One range shuffle, one row of totals per partition."""
    placed = _place(df, _columns(order))
    counts = placed.groupBy(PART).agg(F.count("*").alias("_n"))
    before = W.orderBy(PART).rowsBetween(W.unboundedPreceding, -1)  # one row per partition
    offsets = counts.select(PART, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    ranked = placed.join(F.broadcast(offsets), PART)
    return ranked.withColumn(name, F.col("_before") + F.col(INDEX) + 1).drop(PART, INDEX, "_before")


def narrow_rank(df: DataFrame, order: Sequence[str], name: str = "rank") -> DataFrame:
    """As ``global_rank`` for rows with wide columns: only the distinct order keys are range partitioned and written, and
    the rows, shuffled once, pick up their place by a join on their key. Rows with equal keys are numbered by a hash of
    their content, so a task that runs again gives every row the same place; nulls come first, as in a sort."""
    key, before = "_order", "_before"
    counts = df.groupBy(*order).agg(F.count("*").alias("_n"))
    places = running_sums(counts, [], list(order), {before: "_n"}).select(
        F.struct(*order).alias(key), (F.col(before) - F.col("_n")).alias(before)
    )
    content = [F.col(f"`{c}`") for c, kind in df.dtypes if "map<" not in kind and "variant" not in kind]
    ties = W.partitionBy(key).orderBy(F.xxhash64(*content), *order)
    placed = df.withColumn(key, F.struct(*order)).join(places, key)
    return placed.withColumn(name, F.col(before) + F.row_number().over(ties)).drop(key, before)


def grouped_rank(
    df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], name: str = "rank"
) -> DataFrame:
    """1-based position within each key, safe for a key that holds most of the rows."""
    ranked = global_rank(df, [*_columns(keys), *_columns(order)], "_global")
    first = ranked.groupBy(*keys).agg(F.min("_global").alias("_first"))
    joined = null_safe_join(ranked, first, keys) if keys else ranked.crossJoin(F.broadcast(first))
    return joined.withColumn(name, F.col("_global") - F.col("_first") + 1).drop("_global", "_first")


def running_sums(
    df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], sums: dict[str, str]
) -> DataFrame:
    """Inclusive prefix sums per key: ``sums`` maps the new column to the summed one."""
    placed = _place(df, [*_columns(keys), *_columns(order)])
    totals = placed.groupBy(*keys, PART).agg(*[F.sum(src).alias(f"_t_{out}") for out, src in sums.items()])
    before = W.partitionBy(*keys).orderBy(PART).rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(
        *keys, PART, *[F.coalesce(F.sum(f"_t_{o}").over(before), F.lit(0)).alias(f"_b_{o}") for o in sums]
    )
    inside = W.partitionBy(*keys, PART).orderBy(INDEX).rowsBetween(W.unboundedPreceding, 0)
    local = placed.withColumns({o: F.sum(src).over(inside) for o, src in sums.items()})
    joined = null_safe_join(local, offsets, [*keys, PART])
    return joined.withColumns({o: F.col(o) + F.col(f"_b_{o}") for o in sums}).drop(
        PART, INDEX, *[f"_b_{o}" for o in sums]
    )


def hash_rank(
    df: DataFrame, keys: Sequence[str], id_col: str, seed: int, name: str = "rank", buckets_hex: int = 3
) -> DataFrame:
    """Position within each key in the order of ``sha1(seed|id)``; ``id_col`` is unique.

    The leading hex digits are uniform, so they split a hot key into 4096 even buckets; only the
    bucket counts are summed across a key. Deterministic, so no checkpoint is needed.
    """
    digest = F.sha1(F.concat(F.lit(f"{seed}|"), F.col(id_col).cast("string")).cast("binary"))
    hashed = df.withColumn("_h", digest).withColumn("_bucket", F.substring("_h", 1, buckets_hex))
    inside = W.partitionBy(*keys, "_bucket").orderBy("_h", id_col)
    before = W.partitionBy(*keys).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        hashed.groupBy(*keys, "_bucket")
        .agg(F.count("*").alias("_n"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .drop("_n")
    )
    ranked = hashed.withColumn("_local", F.row_number().over(inside))
    return (
        null_safe_join(ranked, offsets, [*keys, "_bucket"])
        .withColumn(name, F.col("_before") + F.col("_local"))
        .drop("_h", "_bucket", "_before", "_local")
    )


def exact_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probabilities: dict[str, float]
) -> DataFrame:
    """Linearly interpolated quantiles per key, exact, from prefix sums over the distinct values."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    running = running_sums(counts, keys, [value], {"_cum": "_n"})
    totals = counts.groupBy(*keys).agg(F.sum("_n").alias("_total"))
    joined = null_safe_join(running, totals, keys) if keys else running.crossJoin(F.broadcast(totals))
    return _interpolated(joined, keys, value, probabilities)


def quantiles_together(
    df: DataFrame, keys: Sequence[str], value: str, probabilities: dict[str, float]
) -> DataFrame:
    """As ``exact_quantiles``, for groups of a bounded size: the values of a key are ranked in one task. Rows that lie in
    buckets by the keys don't move."""
    known = df.filter(F.col(value).isNotNull()).select(*keys, value)
    ranks = F.row_number().over(W.partitionBy(*keys).orderBy(value)).alias("_cum")
    totals = F.count("*").over(W.partitionBy(*keys)).alias("_total")
    return _interpolated(known.select(*keys, value, ranks, totals), keys, value, probabilities)


def _interpolated(
    ranked: DataFrame, keys: Sequence[str], value: str, probabilities: dict[str, float]
) -> DataFrame:
    """Quantiles per key from rows that know how many come up to them (``_cum``) and how many there are (``_total``)."""
    picks = []
    for name, p in probabilities.items():
        at = F.lit(p) * (F.col("_total") - 1)
        picks.append(F.min(F.when(F.col("_cum") > F.floor(at), F.col(value))).cast("double").alias(f"_lo_{name}"))
        picks.append(F.min(F.when(F.col("_cum") > F.ceil(at), F.col(value))).cast("double").alias(f"_hi_{name}"))
    picked = ranked.groupBy(*keys).agg(F.first("_total").alias("_total"), *picks)

    def between(name, p):
        at = F.lit(p) * (F.col("_total") - 1)
        low, high = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        return (low + (high - low) * (at - F.floor(at))).alias(name)

    return picked.select(*keys, *[between(n, p) for n, p in probabilities.items()])
