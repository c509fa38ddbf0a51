"""Mixing sources to target weights by temperature.

A source with ``n`` tokens gets weight n**t / sum(n**t). Entropy falls and the most repeated source is repeated less as
``t`` goes from 0 (all sources alike) to 1 (as they come), so ``t`` is found by bisection. The weights are then realised
as blocks: a source's documents are put in a seeded random order for each epoch, epoch after epoch, up to its budget;
block k takes from every source its share of the block's tokens, and is shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from framegate.llm.common import stage, text_or_empty

#: Bisections of the exponent, so many of them per Spark job over the table of sources.
STEPS, STEPS_A_JOB, SEED = 40, 5, 20240601
#: Tokens of a block, and of a bucket in which running sums are taken, about.
BLOCK_TOKENS, BUCKET_TOKENS = 1 << 20, 1 << 20
MAX_REPEATS = 2.0


def tokens(text: Column) -> Column:
    """Words of a text and one for its end, as tokens."""
    return (F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")) + 1).cast("long")


def _curves(sizes: DataFrame, exponents: list[float]) -> list[tuple[float, float]]:
    """(entropy of the weights, repeats of the most repeated source) for each exponent, in one pass over the sources.

    Repeats count the epochs of a source when the least repeated one is read once.
    """
    n = F.col("n").cast("double")
    sums = []
    for i, t in enumerate(exponents):
        sums += [F.sum(F.pow(n, F.lit(t))).alias(f"z{i}"), F.sum(F.pow(n, F.lit(t)) * F.log(n)).alias(f"l{i}")]
    row = sizes.agg(F.min(n).alias("lo"), F.max(n).alias("hi"), *sums).first()
    return [
        (math.log(row[f"z{i}"]) - t * row[f"l{i}"] / row[f"z{i}"], (row["hi"] / row["lo"]) ** (1 - t))
        for i, t in enumerate(exponents)
    ]


def bisect_exponent(sizes: DataFrame, met: Callable[[float, float], bool]) -> float:
    """The exponent in [0, 1] at which ``met(entropy, repeats)`` changes, by bisection: the smallest for which it holds
    if it holds at 1 and not at 0; 0 or 1 if it holds or fails at both. Each job looks at all midpoints of several steps."""
    at = _curves(sizes, [0.0, 1.0])
    if met(*at[0]):
        return 0.0
    if not met(*at[1]):
        return 1.0
    lo, hi = 0.0, 1.0
    for _ in range(0, STEPS, STEPS_A_JOB):
        parts = 1 << STEPS_A_JOB
        inner = [lo + (hi - lo) * k / parts for k in range(1, parts)]
        holds = [met(*c) for c in _curves(sizes, inner)]
        a, b = 0, parts
        while b - a > 1:
            mid = (a + b) // 2
            a, b = (a, mid) if holds[mid - 1] else (mid, b)
        lo, hi = lo + (hi - lo) * a / parts, lo + (hi - lo) * b / parts
    return hi


def source_weights(sizes: DataFrame, entropy: float | None = None, max_repeats: float | None = MAX_REPEATS) -> tuple[DataFrame, float]:
    """``source, n, weight, repeats`` and the exponent: the flattest mixture with at most ``max_repeats`` epochs of any
    source while the least repeated is read once, and, if given, at most ``entropy`` nats."""

    def met(h: float, repeats: float) -> bool:
        return (entropy is None or h <= entropy) and (max_repeats is None or repeats <= max_repeats)

    if sizes.isEmpty():
        empty = F.lit(0.0)
        return sizes.select("source", "n", empty.alias("weight"), empty.alias("repeats")), 1.0
    t = bisect_exponent(sizes, met)
    row = sizes.agg(F.sum(F.pow("n", F.lit(t))).alias("z"), F.max("n").alias("hi")).first()
    weight, repeats = F.pow("n", F.lit(t)) / row["z"], F.pow(row["hi"] / F.col("n"), F.lit(1 - t))
    return sizes.select("source", "n", weight.alias("weight"), repeats.alias("repeats")), t


def _running(rows: DataFrame, keys: list[str], stretch: str, order: list[Column | str], amount: str) -> DataFrame:
    """``rows`` with ``before``: the sum of ``amount`` over the rows of the same keys that come earlier. ``stretch``
    numbers bounded stretches of the order, so only their totals meet per key."""
    inner = Window.partitionBy(*keys, stretch).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.partitionBy(*keys).orderBy(stretch).rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(*keys, stretch).agg(F.sum(amount).alias("total"))
    bases = totals.select(*keys, stretch, F.coalesce(F.sum("total").over(outer), F.lit(0)).alias("base"))
    joined = rows.join(bases, [*keys, stretch])
    return joined.withColumn("before", F.col("base") + F.coalesce(F.sum(amount).over(inner), F.lit(0))).drop("base")


def mix(
    docs: DataFrame, entropy: float | None = None, max_repeats: float | None = MAX_REPEATS, seed: int = SEED,
    block_tokens: int = BLOCK_TOKENS, columns: tuple[str, ...] = ("doc_id", "source"),
) -> DataFrame:
    """``columns`` of the drawn documents, with __tokens, __epoch, __block, __slot: one row per draw.

    The least repeated source is read once, so every document is drawn at least once; a source's last, partial epoch
    takes the documents that start before its budget ends. ``__block`` numbers the blocks, ``__slot`` the documents of a
    block from 0 in shuffled order. Draws hang on the seed, the ids and the texts, not on the files. A null source is the
    source named ''; a null text is empty and counts one token; repeated rows and ids are documents of their own; other
    columns are left out; an empty table gives no rows.
    """
    base = stage(
        docs.select(
            *columns, F.coalesce(F.col("source").cast("string"), F.lit("")).alias("__source"),
            tokens(text_or_empty()).alias("__tokens"), F.col("doc_id").alias("__doc"),
            F.xxhash64(text_or_empty()).alias("__th"), F.monotonically_increasing_id().alias("__row"),
        ),
        "sized",
    )
    renamed = {"__source": "source", "__tokens": "tokens", "__doc": "doc", "__th": "th"}
    narrow = base.select("__row", *(F.col(c).alias(n) for c, n in renamed.items()))
    sizes = stage(narrow.groupBy("source").agg(F.sum("tokens").alias("n")), "sources")
    weights, _ = source_weights(sizes, entropy, max_repeats)
    weights = weights.select("source", "n", "weight", "repeats", F.ceil(F.col("n") / BUCKET_TOKENS).alias("buckets"))
    epochs = F.sequence(F.lit(0), F.greatest(F.ceil("repeats") - 1, F.lit(0)).cast("int"))
    rows = narrow.join(weights, "source").withColumn("epoch", F.explode(epochs))
    rows = rows.withColumn("draw", F.shiftrightunsigned(F.xxhash64(F.lit(seed), "source", "epoch", "doc", "th"), 11))
    rows = rows.withColumn("bucket", F.floor(F.col("draw") / float(1 << 53) * F.col("buckets")))
    # A bucket is crowded only by repeats of one row, which have one hash: those are dealt on by row.
    place = ["source", "epoch", "bucket"]
    crowd = rows.groupBy(*place).agg(F.ceil(F.sum("tokens") / (4 * BUCKET_TOKENS)).alias("parts"))
    rows = rows.join(stage(crowd, "buckets"), place)
    part = F.pmod(F.col("__row"), F.col("parts"))
    rows = rows.withColumn("stretch", F.struct("bucket", part.alias("part")))
    placed = _running(rows, ["source", "epoch"], "stretch", ["draw", "__row"], "tokens")
    position = F.col("epoch") * F.col("n") + F.col("before")
    placed = placed.withColumn("position", position).where(F.col("position") < F.col("repeats") * F.col("n"))
    block = F.floor(F.col("position") / (F.col("weight") * block_tokens)).cast("long")
    placed = placed.select("__row", "epoch", block.alias("block"), F.xxhash64(F.lit(seed + 1), "draw").alias("turn"))
    slot = F.row_number().over(Window.partitionBy("block").orderBy("turn", "__row", "epoch")) - 1
    drawn = placed.select("__row", F.col("epoch").alias("__epoch"), F.col("block").alias("__block"), slot.alias("__slot"))
    return base.join(drawn, "__row").select(*columns, "__tokens", "__epoch", "__block", "__slot")
