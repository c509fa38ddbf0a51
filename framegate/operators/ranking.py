"""Top-k, first-wins de-duplication and samples, always under an explicit total order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from framegate.operators.order import narrow_rank


def top_per_key(
    df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], k: int = 1, rank: str | None = None
) -> DataFrame:
    """The first ``k`` rows of each key. Spark cuts every map task to ``k`` rows per key before the shuffle."""
    ranked = df.withColumn("_rn", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter(F.col("_rn") <= k)
    return ranked.withColumnRenamed("_rn", rank) if rank else ranked.drop("_rn")


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """De-duplicate by key, keeping the row that comes first."""
    return top_per_key(df, keys, order, 1)


def worst(df: DataFrame, order: Sequence[str | Column], n: int) -> DataFrame:
    """The first ``n`` rows of a global order (a bounded top-n report)."""
    return df.orderBy(*order).limit(n)


def top_clamped(df: DataFrame, order: Sequence[str | Column], k: int) -> DataFrame:
    """Top ``max(1, min(k, n))``: never empty unless the input is."""
    return df.orderBy(*order).limit(max(1, k))


def every_nth(
    df: DataFrame, keys: Sequence[str], position: str, stride: int, start: int = 0, max_rows: int | None = None
) -> DataFrame:
    """Stride sampling of a sequence from ``start``; ``max_rows`` caps the sample per key."""
    picked = df.filter((F.col(position) >= start) & ((F.col(position) - start) % max(1, stride) == 0))
    return picked if max_rows is None else top_per_key(picked, keys, [position], max_rows)


def stride_for_rate(source_fps: float, target_fps: float) -> int:
    return max(1, round(source_fps / target_fps)) if source_fps > 0 and target_fps > 0 else 1


def hash_sample(df: DataFrame, id_col: str, n: int, seed: int) -> DataFrame:
    """Reproducible sample of ``max(1, min(n, N))`` rows by hash order."""
    digest = F.sha1(F.concat(F.lit(f"{seed}|"), F.col(id_col).cast("string")).cast("binary"))
    return df.withColumn("_h", digest).orderBy("_h", id_col).limit(max(1, n)).drop("_h")


def cap_per_key(df: DataFrame, keys: Sequence[str], id_col: str, n: int, seed: int) -> DataFrame:
    """At most ``n`` rows per key, chosen by hash order."""
    digest = F.sha1(F.concat(F.lit(f"{seed}|"), F.col(id_col).cast("string")).cast("binary"))
    return top_per_key(df.withColumn("_h", digest), keys, ["_h", id_col], n).drop("_h")


def best_epoch(history: DataFrame, run: str, epoch: str, key: Column) -> DataFrame:
    """Epoch with the largest selection key per run; the earliest epoch wins a tie."""
    return top_per_key(history.withColumn("selection_key", key), [run], [F.desc("selection_key"), epoch])


def early_stopping(
    history: DataFrame, run: str, epoch: str, metric: str, min_delta: float, patience: int
) -> DataFrame:
    """Best epoch, its value and the stop epoch (null if patience never ran out) per run.

    The best value only moves when a value beats the last accepted one by more than ``min_delta``,
    so this is a fold over the run's epochs; a run has one row per epoch, which bounds the array.
    """
    series = history.groupBy(run).agg(F.array_sort(F.collect_list(F.struct(epoch, metric))).alias("_s"))
    start = F.struct(
        F.lit(float("-inf")).alias("best"), F.lit(None).cast("bigint").alias("best_epoch"),
        F.lit(0).alias("stale"), F.lit(None).cast("bigint").alias("stop"),
    )

    def step(acc, row):
        better = row[metric] > acc["best"] + F.lit(min_delta)
        stale = F.when(better, F.lit(0)).otherwise(acc["stale"] + 1)
        moved = F.struct(
            F.when(better, row[metric]).otherwise(acc["best"]).alias("best"),
            F.when(better, row[epoch].cast("bigint")).otherwise(acc["best_epoch"]).alias("best_epoch"),
            stale.alias("stale"),
            F.when(stale >= patience, row[epoch].cast("bigint")).alias("stop"),
        )
        return F.when(acc["stop"].isNotNull(), acc).otherwise(moved)

    folded = series.select(run, F.aggregate("_s", start, step).alias("f"))
    return folded.select(
        run, F.col("f.best_epoch").alias("best_epoch"), F.col("f.best").alias("best_value"),
        F.col("f.stop").alias("stop_epoch"),
    )


def resume_from(
    df: DataFrame, order: Sequence[str], path_col: str, last_path: str | None = None,
    last_index: int | None = None, start: int | None = None,
) -> DataFrame:
    """Work list from the resume point on: explicit start, else the last path, else the clamped last index."""
    ranked = narrow_rank(df, order, "_rank").withColumn("position", F.col("_rank") - 1)
    facts = ranked.agg(
        F.max("position").alias("_last"),
        F.min(F.when(F.lower(path_col) == (last_path or "").lower(), F.col("position"))).alias("_at_path"),
    )
    index = F.greatest(F.lit(0), F.least(F.col("_last"), F.lit(start if start is not None else (last_index or 0))))
    begin = index if start is not None else F.coalesce(F.col("_at_path"), index)
    return (
        ranked.crossJoin(F.broadcast(facts))  # one row
        .filter(F.col("position") >= begin)
        .drop("_rank", "_last", "_at_path")
    )
