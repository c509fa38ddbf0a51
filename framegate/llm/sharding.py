"""Sharding by a two-pass external shuffle, with built-in functions only.

Pass one scatters records uniformly into buckets sized for memory, by a seeded hash; pass two runs Spark's
Fisher-Yates ``shuffle`` on the records of each bucket. The shard comes first and follows the ``key`` law: rendezvous
hashing of (doc_id, shard), so one more shard takes rows only into itself and moves none between the others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from framegate.llm.common import stage, text_or_empty, unstage

SHARDS, SEED, BUCKET_BYTES = 16, 20240601, 8 << 20
#: Equal parts of a shard's hash range whose bytes are summed to place and to check its buckets, as a power of two.
CELL_BITS = 20
#: Buckets that a task of the second pass takes one after the other, about, and the most tasks.
BUCKETS_PER_TASK, MAX_TASKS = 4, 20_000


def shard_of(doc_id: Column, shards: int, seed: int = SEED) -> Column:
    """The shard whose hash with the id is largest."""
    draws = [F.struct(F.xxhash64(F.lit(seed), F.lit(i), doc_id).alias("draw"), F.lit(i).alias("shard")) for i in range(shards)]
    return F.greatest(*draws).getField("shard") if shards > 1 else F.lit(0)


def shard_documents(
    docs: DataFrame, shards: int = SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES
) -> DataFrame:
    """All rows of ``docs`` (doc_id, text and whatever else), each with ``size``, ``shard``, ``slot``, ``grown_shard``.

    ``slot`` numbers the rows of a shard from 0 without gaps, in shuffled order. ``size`` is the bytes of the text (a
    null text has none) plus 1. Rows with one doc_id share a shard, null ids too. The bucket hangs on the hash of doc_id
    and text, so neither files nor partitions play a part; only repeats of one row that crowd a bucket are dealt on by
    their place. The columns of the input travel as one struct, so their names may be any; those called like new ones
    (in whatever case) are replaced. A bucket's rows are sorted before the seeded shuffle, so a retried task gives the
    same order. An empty table gives no rows.
    """
    new = ["size", "shard", "slot", "grown_shard"]
    kept = [c for c in docs.columns if c.lower() not in new]
    draw = F.shiftrightunsigned(F.xxhash64(F.lit(seed + 1), "doc_id", text_or_empty()), 1)
    sized = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in kept)).alias("row"),
        (F.octet_length(text_or_empty()).cast("long") + 1).alias("size"),
        shard_of(F.col("doc_id"), shards, seed).alias("shard"),
        shard_of(F.col("doc_id"), shards + 1, seed).alias("grown_shard"),
        draw.alias("draw"),
        F.monotonically_increasing_id().alias("place"),
    ).withColumn("cell", F.shiftright("draw", 63 - CELL_BITS))
    cells = stage(sized.groupBy("shard", "cell").agg(F.sum("size").alias("bytes")), "cells")
    totals = cells.groupBy("shard").agg(F.sum("bytes").alias("bytes")).collect()  # a row per shard
    buckets = {r["shard"]: min(1 << CELL_BITS, max(1, -(-r["bytes"] // bucket_bytes))) for r in totals}
    count = F.create_map(*(F.lit(x) for pair in (buckets or {0: 1}).items() for x in pair))
    bucket = F.shiftright(F.col("cell") * F.element_at(count, F.col("shard")), CELL_BITS).alias("bucket")
    filled = cells.select("shard", bucket, "bytes").groupBy("shard", "bucket").agg(F.sum("bytes").alias("bytes"))
    crowded = filled.where(F.col("bytes") > 4 * bucket_bytes)
    crowded = stage(crowded.select("shard", "bucket", F.ceil(F.col("bytes") / bucket_bytes).alias("parts")), "crowded")
    dealt = sized.select("*", bucket).join(crowded, ["shard", "bucket"], "left")
    dealt = dealt.withColumn("part", F.pmod("place", F.coalesce("parts", F.lit(1))))
    place = ["shard", "bucket", "part"]
    tasks = max(1, min(MAX_TASKS, sum(buckets.values()) // BUCKETS_PER_TASK))
    one = F.struct("draw", F.struct("row", "size", "grown_shard").alias("row"))
    shuffled = (
        dealt.repartition(tasks, *place)
        .groupBy(*place)
        .agg(F.sort_array(F.collect_list(one)).alias("rows"))
        .sortWithinPartitions(*place)  # a task's shuffles draw from one seeded stream
        .select(*place, F.posexplode(F.shuffle("rows", F.lit(seed))).alias("pos", "one"))
    )
    table = stage(shuffled.select(*place, "pos", "one.row.*"), "shards")
    before = Window.partitionBy("shard").orderBy("bucket", "part").rowsBetween(Window.unboundedPreceding, -1)
    counts = table.groupBy(*place).agg(F.count("*").alias("n"))
    bases = counts.select(*place, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    slot = (F.col("base") + F.col("pos")).alias("slot")
    placed = table.join(stage(bases, "bases"), place)
    unstage(cells, crowded)
    return placed.select(*(F.col("row").getField(c).alias(c) for c in kept), "size", "shard", slot, "grown_shard")


def write_shards(sharded: DataFrame, path: str) -> None:
    """Write one folder per shard, rows in slot order within each file."""
    sharded.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
