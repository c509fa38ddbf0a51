"""Helpers the operators share: tables written between stages, bounded Arrow batches, components of a link table."""

from __future__ import annotations

import pickle
import re
from collections.abc import Callable, Iterator
from typing import TypeVar

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from framegate.runtime import scratch_path

#: Rows and bytes of one Arrow batch that goes to Python; a single longer row travels alone.
BATCH_ROWS, BATCH_BYTES = 2000, 4 << 20
LAST_ID = (1 << 63) - 1
T = TypeVar("T")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the folder all executors share and read it back: a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.staged_at = path
    return table


def unstage(*tables: DataFrame) -> None:
    """Delete written tables whose readers have been written themselves."""
    for table in tables:
        jvm = table.sparkSession._jvm
        folder = jvm.org.apache.hadoop.fs.Path(table.staged_at)
        folder.getFileSystem(table.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def ship(spark: SparkSession, thing: T) -> Callable[[], T]:
    """Broadcast a bounded object by value; the function it returns gives it inside a task, loaded once."""
    data = spark.sparkContext.broadcast(cloudpickle.dumps(thing))
    held: list[T] = []

    def get() -> T:
        if not held:
            held.append(pickle.loads(data.value))
        return held[0]

    return get


def bounded_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """Apply ``fn`` to every Arrow batch of ``df``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and (out := fn(batch)) is not None:
                yield out

    bounded_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


def extend(
    rows: DataFrame, carry: list[str], fn: Callable[[pa.RecordBatch], list[pa.Array]], added: str
) -> DataFrame:
    """The ``carry`` columns of ``rows`` and the ``added`` ones (a schema) that ``fn`` makes from each batch."""
    kinds = dict(rows.dtypes)
    names = [*carry, *(c.strip().split(" ")[0] for c in re.split(r",(?![^<]*>)", added))]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in carry), *fn(batch)], names)

    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in carry), added])
    return map_batches(rows, run, schema)


def map_groups(
    rows: DataFrame, keys: list[str], fn: Callable[[dict[str, np.ndarray]], list[tuple]], schema: str
) -> DataFrame:
    """Call ``fn`` with the columns of every group of two or more rows; it returns rows of numbers for ``schema``.

    Groups stream through a task one after the other, so there may be very many small ones; a task holds one group at a
    time, which the caller keeps bounded.
    """
    names = [c.strip().split(" ")[0] for c in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}

        def done(columns: dict[str, np.ndarray], edges: np.ndarray) -> pa.RecordBatch:
            out: list[tuple] = []
            for lo, hi in zip(edges.tolist(), edges[1:].tolist()):
                if hi - lo > 1:
                    out += fn({n: c[lo:hi] for n, c in columns.items()})
            found = list(zip(*out)) or [[] for _ in names]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in found], names)

        for batch in batches:
            if not batch.num_rows:
                continue
            new = {n: batch.column(n).to_numpy(zero_copy_only=False) for n in batch.schema.names}
            held = {n: np.concatenate([held[n], c]) for n, c in new.items()} if held else new
            changed = np.zeros(len(held[keys[0]]) - 1, bool)
            for k in keys:
                changed |= held[k][1:] != held[k][:-1]
            edges = np.r_[0, np.flatnonzero(changed) + 1]
            yield done(held, edges)
            held = {n: c[edges[-1] :] for n, c in held.items()}
        if held:
            yield done(held, np.array([0, len(held[keys[0]])]))

    bounded_batches(rows.sparkSession)
    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def numbered(docs: DataFrame, name: str = "numbered") -> DataFrame:
    """``docs`` written with a number per row, ``__row``, so that rows can be told apart whatever they hold."""
    return stage(docs.withColumn("__row", F.monotonically_increasing_id()), name)


def order_id(doc_id: str | Column = "doc_id") -> Column:
    """The id that orders documents; a missing one comes last."""
    return F.coalesce(F.col(doc_id) if isinstance(doc_id, str) else doc_id, F.lit(LAST_ID)).cast("long")


def text_or_empty(text: str = "text") -> Column:
    return F.coalesce(F.col(text), F.lit(""))


def bits(signed: int) -> int:
    """The unsigned value of a signed 64-bit integer."""
    return signed & 0xFFFFFFFFFFFFFFFF


def components(links: DataFrame, name: str = "cc") -> DataFrame:
    """Connected components of ``links(a, b)``: one row ``(node, root)`` per node that has a link.

    Every round, each node moves to the neighbour (or itself) whose hash of (round, node) is smallest, and the links
    are contracted. The hash order changes each round, so a constant share of the nodes goes away in expectation,
    also on paths and stars. All steps are aggregates and joins on narrow rows; nothing is gathered per component.
    ``root`` is one node of the component, the same for all its nodes.
    """
    moves: list[DataFrame] = []
    links = stage(links.where("a <> b").distinct(), name)
    while not links.isEmpty():
        turn = F.lit(len(moves))
        both = links.union(links.select("b", "a"))
        reach = both.union(both.select("a", F.col("a").alias("b")).distinct())
        key = F.struct(F.xxhash64(turn, "b"), "b")
        move = stage(reach.groupBy(F.col("a").alias("node")).agg(F.min(key).getField("b").alias("to")), name)
        left = move.select(F.col("node").alias("a"), F.col("to").alias("x"))
        right = move.select(F.col("node").alias("b"), F.col("to").alias("y"))
        moved = links.join(left, "a").join(right, "b").where("x <> y")
        moves.append(move)
        before = links
        links = stage(
            moved.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), name
        )
        unstage(before)
    if not moves:
        return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    found = moves[-1].select("node", F.col("to").alias("root"))
    for move in reversed(moves[:-1]):
        nxt = found.select(F.col("node").alias("to"), "root")
        found = move.join(nxt, "to", "left").select("node", F.coalesce("root", "to").alias("root"))
    return found
