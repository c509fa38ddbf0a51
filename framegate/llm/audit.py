"""Audit of how filters interact: what every order of five filters removes, step by step, per part of the corpus.

A document is a mask of the filters it fails. Under an order, it is removed at the first step whose filter is in its
mask. Orders are ranked lexicographically (Lehmer codes), and the orders that share their first steps are an interval of
ranks, so the orders in which a mask is removed at a step by a filter are a few intervals. Counts of masks are added at
the starts of these intervals and taken away at their ends; a prefix sum over the 120 ranks gives every order's figures.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations
from math import factorial

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from framegate.llm.common import LAST_ID, extend, order_id, stage, text_or_empty

FILTERS = "ABCDE"
#: Fixed values of the filters A to D.
MIN_WORDS, DISTINCT_PERCENT, UPPER_PERCENT, SYMBOLS = 50, 65, 5, b"#$%&*|"
UPPER = bytes(range(65, 91))
COUNTS = ("removed", "good_lost", "toxic_lost")


def mask_of(text: str) -> int:
    """The filters A (1), B (2), C (4) and D (8) that a text fails."""
    raw = text.encode()
    words = raw.split()
    return (
        (len(words) < MIN_WORDS)
        | (100 * len(set(words)) < DISTINCT_PERCENT * len(words)) << 1
        | (100 * (len(raw) - len(raw.translate(None, UPPER))) > UPPER_PERCENT * len(text)) << 2
        | (len(raw.translate(None, SYMBOLS)) < len(raw)) << 3
    )


def lehmer_rank(order: tuple[int, ...]) -> int:
    """The place of a permutation of 0, 1, 2, ... among all of them, in lexicographic order."""
    return sum(sum(b < a for b in order[i + 1 :]) * factorial(len(order) - 1 - i) for i, a in enumerate(order))


def intervals(n: int = len(FILTERS)) -> Iterator[tuple[int, int, int, int, int]]:
    """(mask, step from 1, filter, first rank, rank after the last): the orders of ``n`` filters in which a document
    that fails ``mask`` is removed at that step by that filter, as intervals of ranks that don't overlap."""
    for mask in range(1, 1 << n):
        passed = [f for f in range(n) if not mask >> f & 1]
        for step in range(1, len(passed) + 2):
            width = factorial(n - step)
            for prefix in permutations(passed, step - 1):
                for f in range(n):
                    if mask >> f & 1:
                        rest = sorted(set(range(n)) - {*prefix, f})
                        lo = lehmer_rank((*prefix, f, *rest))
                        yield mask, step, f, lo, lo + width


def orders(n: int = len(FILTERS)) -> list[tuple[int, ...]]:
    """All permutations of 0, 1, 2, ... by rank."""
    return list(permutations(range(n)))


def described(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``id`` (a missing one last), ``part``, the mask of A to D, and 128 bits that stand for the text."""

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        texts = batch.column("__text").to_pylist()
        prints = [xxhash.xxh3_128_intdigest(t.encode()) for t in texts]
        halves = [[(p >> s & (1 << 64) - 1) - (1 << 63) for p in prints] for s in (64, 0)]
        return [pa.array([mask_of(t) for t in texts], pa.int32()), *(pa.array(h, pa.int64()) for h in halves)]

    rows = docs.select(
        order_id().alias("id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), text_or_empty().alias("__text")
    )
    return extend(rows, ["id", "part"], run, "mask int, hi long, lo long")


def counted_masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``part, mask, n, good, toxic``: documents of every part and mask of A to E, and how many of them are labelled
    quality 1 and toxic 1. A row per part and mask, so at most 32 times the number of parts.

    Copies of a text are counted per (part, label) before they meet, so a large group of copies is a few rows when its
    smallest id is looked for.
    """
    marks = labels.select(F.col("doc_id").cast("long").alias("id"), F.col("quality") == 1, F.col("toxic") == 1).toDF("id", "good", "toxic")
    marks = marks.where("id IS NOT NULL").groupBy("id").agg(F.max("good").alias("good"), F.max("toxic").alias("toxic"))
    copies = described(docs).groupBy("id", "part", "mask", "hi", "lo").agg(F.count("*").alias("n"))
    # A missing id has no label: it is given none before the join, so that such rows don't meet in one task.
    marked = copies.withColumn("key", F.when(F.col("id") != LAST_ID, F.col("id")).otherwise(-F.xxhash64("hi", "lo")))
    marked = marked.join(marks.withColumnRenamed("id", "key"), "key", "left")
    known = F.col("id") != LAST_ID
    flags = [(known & F.coalesce(F.col(c), F.lit(False))).alias(c) for c in ("good", "toxic")]
    marked = marked.select("id", "part", "mask", "hi", "lo", "n", *flags)
    group = ["hi", "lo", "part", "mask", "good", "toxic"]
    grouped = stage(marked.groupBy(*group).agg(F.sum("n").alias("n"), F.min(F.struct("id", "n")).alias("first")), "copies")
    smallest = grouped.groupBy("hi", "lo").agg(F.min("first.id").alias("least"))
    firsts = grouped.join(smallest, ["hi", "lo"]).withColumn(
        "passed", F.when(F.col("first.id") == F.col("least"), F.col("first.n")).otherwise(0)
    )
    e = 1 << FILTERS.index("E")
    split = F.explode(F.array(F.struct(F.col("mask"), F.col("passed").alias("n")), F.struct((F.col("mask") + e).alias("mask"), (F.col("n") - F.col("passed")).alias("n"))))
    rows = firsts.select("part", "good", "toxic", split.alias("s")).select("part", "good", "toxic", "s.mask", "s.n")
    amount = {"n": F.col("n"), "good": F.when(F.col("good"), F.col("n")).otherwise(0), "toxic": F.when(F.col("toxic"), F.col("n")).otherwise(0)}
    return rows.where("n > 0").groupBy("part", "mask").agg(*(F.sum(v).alias(k) for k, v in amount.items()))


def audit_filters(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order of the five filters and step, zeros included.

    ``part`` is the source (null: the empty string), ``filter_order`` the letters, ``step`` from 1. Of the part's
    documents: ``kept`` after the step, ``removed`` by it, ``redundant`` (failing its filter, removed earlier),
    ``unique_fails`` (failing its filter only), ``good_lost`` and ``toxic_lost`` (removed here with quality 1, toxic 1 in
    ``labels``), and ``shapley`` (removed by its filter, summed over all orders). A null text is empty. A null doc_id is
    larger than any other and has no label; repeated rows count each, and those with one doc_id aren't copies of one another. A
    document with several labels is good or toxic if one of them says so. Other columns play no part; an empty table
    gives no rows.
    """
    spark = docs.sparkSession
    masks = stage(counted_masks(docs, labels), "masks")
    ends = [(m, s, f, lo, hi) for m, s, f, lo, hi in intervals()]
    table = F.broadcast(spark.createDataFrame(ends, "mask int, step int, filter int, lo int, hi int"))  # a few hundred rows
    signs = F.explode(F.array(F.struct(F.col("lo").alias("rank"), F.lit(1).alias("sign")), F.struct(F.col("hi").alias("rank"), F.lit(-1).alias("sign"))))
    given = {"removed": "n", "good_lost": "good", "toxic_lost": "toxic"}
    changes = masks.join(table, "mask").select("part", "step", "filter", *given.values(), signs.alias("e"))
    changes = changes.groupBy("part", "step", "e.rank").agg(*(F.sum(F.col(v) * F.col("e.sign")).alias(k) for k, v in given.items()))
    letters = [(r, i + 1, f, "".join(FILTERS[k] for k in p)) for r, p in enumerate(orders()) for i, f in enumerate(p)]
    every = F.broadcast(spark.createDataFrame(letters, "rank int, step int, filter int, filter_order string"))  # 600 rows
    bit = F.call_function("shiftleft", F.lit(1), F.col("filter"))
    fails = F.when(F.col("mask").bitwiseAND(bit) != 0, F.col("n")).otherwise(0)
    alone = F.when(F.col("mask") == bit, F.col("n")).otherwise(0)
    each = masks.withColumn("filter", F.explode(F.array(*map(F.lit, range(len(FILTERS))))))
    of_filter = each.groupBy("part", "filter").agg(F.sum("n").alias("total"), F.sum(fails).alias("fails"), F.sum(alone).alias("unique_fails"))
    steps = of_filter.join(every, "filter").join(changes, ["part", "step", "rank"], "left")
    over_ranks = Window.partitionBy("part", "step").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)  # 120 rows
    over_steps = Window.partitionBy("part", "rank").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)  # 5 rows
    summed = steps.withColumns({k: F.sum(F.coalesce(k, F.lit(0))).over(over_ranks) for k in COUNTS})
    return summed.select(
        "part",
        "filter_order",
        "step",
        (F.col("total") - F.sum("removed").over(over_steps)).alias("kept"),
        "removed",
        (F.col("fails") - F.col("removed")).alias("redundant"),
        "unique_fails",
        "good_lost",
        "toxic_lost",
        F.sum("removed").over(Window.partitionBy("part", "filter")).alias("shapley"),  # 120 rows
    )
