"""Streaming forms: thinning, bucket counts, running averages, harvest, de-duplication, summaries, rules, late frames.

Sources are file streams; every job runs to the end of the available files and then stops, and can be started
again from its checkpoint.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState

from framegate.operators.metrics import gate_measures, gate_metrics
from framegate.operators.ranking import keep_first
from framegate.operators.sequences import thin_decisions
from framegate.runtime import scratch_path, stage, unstage
from framegate.streaming.tables import BucketTable, DoneKeys


def file_stream(spark: SparkSession, path: str, files_per_trigger: int = 1_000) -> DataFrame:
    """Parquet files as a stream, with the schema of the files already there."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def drain(stream: DataFrame, mode: str = "append", name: str = "stream") -> DataFrame:
    """Run an append stream over the available files into a table in the shared folder and return that table."""
    spark = stream.sparkSession
    base = scratch_path(spark, name)
    query = (
        stream.writeStream.outputMode(mode).format("parquet").option("checkpointLocation", f"{base}/checkpoint")
        .trigger(availableNow=True).start(f"{base}/table")
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/table")


def drain_batches(stream: DataFrame, handle: Callable[[DataFrame, int], None], mode: str = "append", name: str = "batches") -> str:
    """Run a stream through ``handle`` batch by batch; returns the run's folder."""
    base = scratch_path(stream.sparkSession, name)
    query = (
        stream.writeStream.outputMode(mode).foreachBatch(handle).option("checkpointLocation", f"{base}/checkpoint")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return base


def thin_stream(frames: DataFrame, min_gap: int, threshold: float) -> DataFrame:
    """Streaming thinning of ``(video_id, frame_index, diff_score)``; files must arrive in frame order.

    The value is fixed width, so the state of a video is two numbers however long the video is; a batch holds as many
    rows of one video as its files do.
    """
    rows = frames.select("video_id", "frame_index", "diff_score")
    types = dict(rows.dtypes)
    gap = max(0, min_gap)

    def advance(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        part = pd.concat(list(batches)).sort_values("frame_index")
        index, value = state.get if state.exists else (float("nan"), float("nan"))
        decisions, scores, index, value = thin_decisions(
            part["frame_index"].to_numpy("float64"), part["diff_score"].to_numpy("float64"), index, value, gap, threshold
        )
        state.update((float(index), float(value)))
        yield pd.DataFrame({"video_id": key[0], "frame_index": part["frame_index"].to_numpy(), "decision": decisions, "score": scores})

    schema = f"video_id {types['video_id']}, frame_index {types['frame_index']}, decision string, score double"
    return rows.groupBy("video_id").applyInPandasWithState(
        advance, schema, "last_index double, last_value double", "append", "NoTimeout"
    )


def average_stream(frames: DataFrame, keep: float = 0.9) -> DataFrame:
    """Running average per video over ``(video_id, frame_index, diff_score)``; the state is one number."""
    rows = frames.select("video_id", "frame_index", "diff_score")
    types = dict(rows.dtypes)

    def advance(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        part = pd.concat(list(batches)).sort_values("frame_index")
        start = [state.get[0]] if state.exists else []
        series = pd.concat([pd.Series(start, dtype="float64"), part["diff_score"]])
        average = series.ewm(alpha=1.0 - keep, adjust=False).mean().to_numpy()[len(start):]
        state.update((float(average[-1]),))
        yield pd.DataFrame({"video_id": key[0], "frame_index": part["frame_index"].to_numpy(), "average": average})

    schema = f"video_id {types['video_id']}, frame_index {types['frame_index']}, average double"
    return rows.groupBy("video_id").applyInPandasWithState(advance, schema, "average double", "append", "NoTimeout")


def bucket_counts(frames: DataFrame, bucket_size: int = 25) -> DataFrame:
    """Frames and mean difference per video and bucket of frame numbers (batch or stream)."""
    bucket = F.floor(F.col("frame_index") / max(1, bucket_size))
    return frames.groupBy("video_id", bucket.alias("bucket")).agg(F.count("*").alias("frames"), F.sum("diff_score").alias("total"))


def window_counts(frames: DataFrame, width: str, delay: str) -> DataFrame:
    """Frames per split and event-time window; a window is written once, when the watermark has passed it."""
    timed = frames.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    counted = timed.groupBy(F.window("ts", width), "split").agg(F.count("*").alias("frames"))
    return counted.select(F.col("window.start").alias("start"), "split", "frames")


def upsert_latest(spark: SparkSession, stream: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Run an update-mode aggregation and return the last value of every key.

    Each batch puts its changed rows in place of the old ones, in the buckets it touches; see ``tables.BucketTable``.
    """
    table = BucketTable(spark, f"{scratch_path(spark, name)}/table", keys)

    def write(batch: DataFrame, number: int) -> None:
        changed = stage(batch, "changed")
        table.merge(changed, number)
        unstage(changed)

    drain_batches(stream, write, "update", name)
    rows = table.rows(table.committed()[1])
    return spark.createDataFrame([], stream.schema) if rows is None else rows.select(*stream.columns)


def summary_measures(rows: DataFrame, split: str = "split") -> DataFrame:
    """Gate sums per split, for an incremental summary; ``summary_from`` turns them into metrics."""
    terms = gate_measures(F.col("gt_pixels"), F.col("pred_pixels"), F.col("iou"), F.col("dice"))
    return rows.groupBy(split).agg(*[F.sum(c).alias(n) for n, c in terms.items()])


def summary_from(measures: DataFrame, split: str = "split") -> DataFrame:
    """Gate metrics per split and overall from the sums of ``summary_measures``."""
    names = [c for c in measures.columns if c != split]
    rolled = measures.rollup(split).agg(F.grouping(split).alias("_all"), *[F.sum(n).alias(n) for n in names])
    scope = F.when(F.col("_all") == 1, "overall").otherwise(F.col(split))
    return rolled.select(scope.alias("scope"), *gate_metrics())


def unique_stream(frames: DataFrame, keys: list[str], delay: str) -> DataFrame:
    """First row per key within the watermark delay."""
    return frames.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay).dropDuplicatesWithinWatermark(keys)


def _run_of(batch: DataFrame) -> str:
    """The stream's run id, which its checkpoint keeps."""
    return batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")


def harvest(
    stream: DataFrame, decide: Callable[[DataFrame], DataFrame], table: str, key: str,
    order: list[str] | None = None, checkpoint: str | None = None,
) -> None:
    """Score and route new frames into ``table``, once each, whatever is retried or restarted.

    Of the rows with one key in a batch the first by ``order`` counts (all other columns by default). Every batch of a
    run has its own folder, which only a retry of that batch replaces; the run id lives in the checkpoint, so a lost
    checkpoint or a second job starts folders of its own. Frames that any other run or an earlier batch has written are
    skipped, so no id comes twice and nothing that was written goes away. What was written is known from an index of keys
    (``table``-index) of which a batch reads the buckets of its own keys, not from the table.
    """
    order = order or [c for c in stream.columns if c != key]

    def write(batch: DataFrame, number: int) -> None:
        run, rows = _run_of(batch), stage(keep_first(batch, [key], order), "batch")
        index = DoneKeys(batch.sparkSession, f"{table}-index", [table], run, [key])
        fresh = stage(index.fresh(rows, number)[0], "fresh")
        decide(fresh).write.mode("overwrite").parquet(f"{table}/run={run}/batch={number}")
        index.commit(fresh, number)
        unstage(rows, fresh)

    base = checkpoint or f"{table}-checkpoint"
    stream.writeStream.foreachBatch(write).option("checkpointLocation", base).trigger(availableNow=True).start().awaitTermination()


def apply_rules(frames: DataFrame, conditions: dict[str, Column]) -> DataFrame:
    """First matching rule of every streamed frame. The rules are compiled, so the stream needs no join."""
    name = F.lit("none")
    for rule, condition in reversed(list(conditions.items())):
        name = F.when(F.coalesce(condition, F.lit(False)), rule).otherwise(name)
    return frames.withColumn("rule", name)


def split_late(
    stream: DataFrame, delay: str, table: str, late_table: str, keys: list[str], checkpoint: str | None = None
) -> None:
    """Write frames in time to ``table`` and frames older than the newest seen time minus ``delay`` to ``late_table``.

    The newest time seen before is a note of the index of keys, so the fate of a frame does not change when a batch is
    repeated. Folders go by run and batch like those of ``harvest``; frames whose ``keys`` another run or an earlier batch
    has written to either table are skipped.
    """

    def write(batch: DataFrame, number: int) -> None:
        run = _run_of(batch)
        rows = stage(batch.withColumn("ts", F.col("ts").cast("timestamp")), "batch")
        index = DoneKeys(batch.sparkSession, f"{table}-index", [table, late_table], run, keys)
        fresh, newest = index.fresh(rows, number)
        timed = stage(fresh, "fresh")
        limit = F.lit(newest).cast("timestamp") - F.expr(f"INTERVAL {delay}")
        late = F.coalesce(F.col("ts") < limit, F.lit(False))
        for part, target in ((timed.filter(~late), table), (timed.filter(late), late_table)):
            part.write.mode("overwrite").parquet(f"{target}/run={run}/batch={number}")
        here = timed.agg(F.date_format(F.max("ts"), "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("n")).first()["n"]
        index.commit(timed, number, max((n for n in (newest, here) if n is not None), default=None))
        unstage(rows, timed)

    base = checkpoint or f"{table}-checkpoint"
    stream.writeStream.foreachBatch(write).option("checkpointLocation", base).trigger(availableNow=True).start().awaitTermination()


def fresh_table(spark: SparkSession, name: str) -> str:
    return f"{scratch_path(spark, name)}/{uuid.uuid4().hex[:8]}"
