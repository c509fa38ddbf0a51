"""Queries that run a stream over the given tables to its end and return what it wrote."""

from pyspark.sql import functions as F

from framegate.functions import rules as R
from framegate.plans.q_metrics import GATE_SQL
from framegate.plans.q_ranking import _EMA_SQL, thin_sql
from framegate.plans.q_sources import _ROUTED_SQL, routed_frames
from framegate.plans.registry import query
from framegate.runtime import scratch_path
from framegate.streaming import frames as S


def frame_files(t, parts=4):
    """The frames as a few files in frame order, so that a stream sees several batches."""
    path = scratch_path(t.spark, "frames")
    size = t.fx_frames.agg(F.max("frame_index").alias("m")).first()["m"] // parts + 1
    for part in range(parts):
        rows = t.fx_frames.filter(F.floor(F.col("frame_index") / size) == part)
        rows.write.mode("append").parquet(path)
    return path


@query("ST1_thin_stream", thin_sql(150, 20.0) + "SELECT video_id, frame_index, decision, round(score, 6) AS score FROM r")
def _(t):
    stream = S.file_stream(t.spark, frame_files(t), 8)
    rows = S.drain(S.thin_stream(stream, 150, 20.0), name="thin")
    return rows.select("video_id", "frame_index", "decision", F.round(F.nanvl("score", F.lit(None).cast("double")), 6).alias("score"))


@query(
    "ST2_bucket_counts",
    "SELECT video_id, frame_index // 25 AS bucket, count(*) AS frames, round(sum(diff_score), 6) AS total FROM fx_frames GROUP BY video_id, frame_index // 25",
)
def _(t):
    stream = S.file_stream(t.spark, frame_files(t), 8)
    rows = S.upsert_latest(t.spark, S.bucket_counts(stream), ["video_id", "bucket"], "buckets")
    return rows.withColumn("total", F.round("total", 6))


@query(
    "ST2_window_counts",
    """WITH w AS (SELECT time_bucket(INTERVAL '6 hours', ts) AS start, split, count(*) AS frames FROM fx_frames GROUP BY ALL), m AS (SELECT max(ts) AS newest FROM fx_frames)
SELECT start, split, frames FROM w, m WHERE start + INTERVAL '6 hours' <= newest - INTERVAL '1 hour'""",
)
def _(t):
    stream = S.file_stream(t.spark, frame_files(t), 8)
    rows = S.drain(S.window_counts(stream, "6 hours", "1 hour"), name="windows")
    return rows.withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("ST3_average_stream", _EMA_SQL)
def _(t):
    rows = S.drain(S.average_stream(S.file_stream(t.spark, frame_files(t), 8)), name="average")
    return rows.select("video_id", "frame_index", F.round(F.col("average") + 0.00000037, 5).alias("average"))


@query("ST4_harvest", _ROUTED_SQL)
def _(t):
    path, table = frame_files(t), S.fresh_table(t.spark, "harvest")
    twice = t.spark.read.parquet(path).filter("frame_index % 4 = 0")
    twice.write.mode("append").parquet(path)  # files with frames that were seen before
    stream = S.file_stream(t.spark, path, 6)
    S.harvest(stream, lambda df: routed_frames(df).select("frame_index", "decision", "output_path", "mask_output_path"), table, "frame_index")
    return t.spark.read.option("basePath", table).parquet(table).drop("run", "batch")


@query("ST5_unique_stream", "SELECT DISTINCT video_id, frame_index FROM fx_frames")
def _(t):
    path = frame_files(t, 2)
    t.spark.read.parquet(path).filter("frame_index % 3 = 0").write.mode("append").parquet(path)
    stream = S.file_stream(t.spark, path, 1_000)
    return S.drain(S.unique_stream(stream, ["video_id", "frame_index"], "2 hours"), name="unique").select("video_id", "frame_index")


@query("ST6_incremental_summary", GATE_SQL)
def _(t):
    path = scratch_path(t.spark, "eval")
    t.fx_scored.write.parquet(path)
    sums = S.upsert_latest(t.spark, S.summary_measures(S.file_stream(t.spark, path, 3)), ["split"], "summary")
    rows = S.summary_from(sums)
    return rows.withColumns({c: F.round(c, 6) for c, kind in rows.dtypes if kind == "double"})


@query(
    "ST7_stream_rules",
    """SELECT video_id, frame_index, CASE WHEN diff_score >= 90 AND split IN ('view', 'click') THEN 'jump' WHEN diff_score <= 10 THEN 'still' WHEN frame_index >= 100 AND diff_score <= 50 THEN 'late_calm' ELSE 'none' END AS rule FROM fx_frames""",
)
def _(t):
    score, index = F.col("diff_score"), F.col("frame_index")
    rules = {
        "jump": R.all_of([R.within(score, 90.0, None), F.col("split").isin("view", "click")]),
        "still": R.within(score, None, 10.0),
        "late_calm": R.all_of([R.within(index, 100, None), R.within(score, None, 50.0)]),
    }
    stream = S.apply_rules(S.file_stream(t.spark, frame_files(t), 8), rules)
    return S.drain(stream.select("video_id", "frame_index", "rule"), name="rules")


@query(
    "ST8_late_frames",
    """WITH h AS (SELECT *, frame_index > (SELECT max(frame_index) FROM fx_frames) // 2 AS newer FROM fx_frames), l AS (SELECT (SELECT max(ts) FROM h WHERE newer) - INTERVAL '2 hours' AS lim)
SELECT CASE WHEN NOT newer AND ts < lim THEN 'late' ELSE 'in_time' END AS kind, count(*) AS n FROM h, l GROUP BY ALL""",
)
def _(t):
    """The newer half comes first, so most of the older half is late when the stream goes on from its checkpoint."""
    path = scratch_path(t.spark, "late")
    newest = t.fx_frames.agg(F.max("frame_index").alias("m")).first()["m"]
    table, late = S.fresh_table(t.spark, "intime"), S.fresh_table(t.spark, "late")
    for newer in (True, False):
        half = t.fx_frames.filter((F.col("frame_index") > newest // 2) == F.lit(newer))
        half.write.mode("append").parquet(path)
        S.split_late(S.file_stream(t.spark, path), "2 HOURS", table, late, ["video_id", "frame_index"])
    counts = [
        t.spark.read.option("basePath", p).parquet(p).agg(F.lit(kind).alias("kind"), F.count("*").alias("n"))
        for kind, p in (("in_time", table), ("late", late))
    ]
    return counts[0].unionByName(counts[1])
