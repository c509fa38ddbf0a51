"""Steps that must not grow with one file, one broadcast or one frame."""

import pytest
from pyspark.sql import functions as F

from framegate.operators import features, graph, sequences, spatial
from framegate.plans import registry
from framegate.runtime import cut


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def parts(spark, tmp_path):
    rows = spark.range(40).select(F.col("id").alias("p_partkey"), F.lit(50).alias("p_size"))
    rows.coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    return registry.Tables(spark, str(tmp_path))


def test_pixels_of_a_small_file_are_spread(parts, monkeypatch):
    monkeypatch.setattr(registry, "TASK_PIXELS", 500)
    pixels = parts.fx_pixels
    counts = pixels.groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in counts) == 40 * 50 * 2
    assert pixels.rdd.getNumPartitions() == 8 and max(r["count"] for r in counts) < 2000
    assert "Exchange hashpartitioning(frame_id" not in plan(pixels.groupBy("frame_id", "x", "y").count())


def test_exploded_rows_are_not_broadcast(parts):
    pixels = parts.fx_pixels
    assert "BroadcastHashJoin" not in plan(spatial.tolerance_counts(pixels, 2))
    kept = cut(pixels)
    met = kept.join(kept.select("frame_id", "x", "y", F.lit(1).alias("again")), ["frame_id", "x", "y"])
    assert "BroadcastHashJoin" not in plan(met) and met.count() > 0


def test_frames_far_apart_share_a_chunk(spark):
    frames = spark.range(300).select((F.col("id") % 3).alias("v"), (F.col("id") * 10_000).alias("i"), (F.col("id") % 7).alias("x"))
    chunks = sequences._chunked(frames, "v", "i", "x", 50).groupBy("v", "_chunk").count().collect()
    assert sorted((r["v"], r["_chunk"], r["count"]) for r in chunks) == [(v, c, 50) for v in range(3) for c in range(2)]


def test_average_starts_again_after_a_missing_value(spark):
    values = [None if i in (20, 39, 40) else float(i * 31 % 17) for i in range(90)]
    df = spark.createDataFrame([("v", i * 1000, x) for i, x in enumerate(values)], "v string, i long, x double")
    got = sequences.moving_average(df, "v", "i", "x", 0.9, 10).orderBy("i").collect()
    state = None
    for r, x in zip(got, values):
        state = x if state is None or x is None else state * 0.9 + x * 0.1
        assert r["average"] is None if state is None else abs(r["average"] - state) < 1e-9


def test_paths_walk_frames_without_a_data_frame_each(spark):
    line = spark.createDataFrame([("a", 0, 0), ("a", 1, 1), ("a", 2, 1), ("b", 5, 5), ("b", 9, 9), ("c", 1, 1), (None, 0, 0)], "frame string, x long, y long")
    seeds = spark.createDataFrame([("a", 0, 0), ("b", 5, 5), ("c", 7, 7)], "frame string, x long, y long")
    walked = graph.shortest_paths(line, seeds, ["frame"])
    assert "FlatMapGroupsInPandas" not in plan(walked)
    rows = sorted(tuple(r) for r in walked.collect())
    assert rows == [("a", 0, 0, 0, ""), ("a", 1, 1, 1, "7"), ("a", 2, 1, 2, "74"), ("b", 5, 5, 0, "")]


def test_mask_pixels_count_once(spark):
    square = [(x, y) for x in range(-3, 7) for y in range(-3, 7)]
    moved = [(x + 5, y) for x, y in square]  # half of it lies on the square: an overlap of a third
    rows = [(1, 1, *p) for p in square + square[:40]] + [(1, 2, *p) for p in moved + moved[60:]] + [(1, 3, 50, 50)]
    masks = spark.createDataFrame(rows, "frame_id long, mask_id long, x long, y long")
    ranks = spark.createDataFrame([(1, 1, 1), (1, 2, 2), (1, 3, 3)], "frame_id long, mask_id long, rank long")

    def kept(min_iou):
        return sorted(r["mask_id"] for r in graph.suppress_masks(masks, ranks, min_iou, 5).collect())

    assert kept(0.33) == [1, 3] and kept(0.34) == [1, 2, 3]


def test_boxes_of_frames_without_points_are_not_copied(spark):
    points = spark.createDataFrame([(1, 5, 5)], "frame_id long, px long, py long")
    boxes = spark.range(1, 50).select(
        F.col("id").alias("frame_id"), *[F.lit(v).alias(n) for n, v in (("x0", 0), ("y0", 0), ("x1", 99), ("y1", 99), ("area", 9801))],
        F.lit(0.5).alias("score"), F.col("id").alias("pos"),
    )
    hit = spatial.smallest_containing(points, boxes, ["pos"])
    assert "LeftSemi" in plan(hit)
    assert [(r["frame_id"], r["pos"]) for r in hit.collect()] == [(1, 1)]


def test_frames_without_a_video_are_cut_by_frame_number(spark):
    rows = [(None, i * 4, float(i)) for i in range(10)]
    df = spark.createDataFrame(rows, "v long, i long, x double")
    averages = {r["i"]: r["average"] for r in sequences.moving_average(df, "v", "i", "x", 0.9, 20).collect()}
    assert (averages[0], averages[20]) == (0.0, 5.0) and len(averages) == 10
    thinned = {r["i"]: r["decision"] for r in sequences.thin_sequence(df, "v", "i", "x", 100, 0.0, 20).collect()}
    assert [i for i, d in sorted(thinned.items()) if d == "kept"] == [0, 20]


def test_circle_neighbours_meet_once_in_grids_of_their_size(spark):
    rows = [(f, (i * 37) % 211, (i * 53) % 307, 1 + (i * i) % (3, 40, 900)[f % 3], 0) for f in range(3) for i in range(60)]
    df = spark.createDataFrame([*rows, *rows[:20], (0, None, 1, 1, 0)], "frame_id long, cx long, cy long, radius long, x int")
    got = spatial.circle_neighbours(df)
    assert plan(got).count("SortMergeJoin") == 1
    copies = {}
    for f, x, y, r, _ in [*rows, *rows[:20]]:
        copies[f, x, y, r] = copies.get((f, x, y, r), 0) + 1
    for g in got.filter("cx IS NOT NULL").collect():
        me = (g["frame_id"], g["cx"], g["cy"], g["radius"])
        conflicts = neighbours = 0
        for (f, x, y, r), n in copies.items():
            d2 = (x - me[1]) ** 2 + (y - me[2]) ** 2
            if f == me[0] and (f, x, y, r) != me:
                conflicts += n * (d2 < max(r, me[3]) ** 2)
                neighbours += n * (0.25 * me[3] ** 2 < d2 < 6.25 * me[3] ** 2 and 0.4 * me[3] <= r <= 1.6 * me[3])
        assert (g["copies"], g["n_conflicts"], g["n_neighbours"]) == (copies[me], conflicts, neighbours), me
    assert got.count() == len(copies) + 1


def test_name_lists_are_compared_before_they_are_taken_apart(spark):
    df = spark.createDataFrame([({"a": 1.0}, "s", ["f"]), ({"b": 2.0, "a": None}, None, [])] * 3, "values map<string,double>, source string, flags array<string>")
    spec = features.feature_spec(df)
    text = plan(spec)
    assert "HashAggregate" in text[text.index("Generate"):]
    vectors = [r["vector"] for r in features.dense_vectors(df, spec).collect()]
    assert vectors[:2] == [[1, 1, 0, 0, 0, 1, 0, 1, 1], [0, 0, 2, 1, 1, 0, 1, 0, 0]]


def brute_frames(rows):
    """Kept (frame, x, y, r) of rows (frame, x, y, r, score), scores all different."""
    kept = {}
    for f, x, y, r, _ in sorted(rows, key=lambda c: -c[4]):
        if all((x - a) ** 2 + (y - b) ** 2 >= max(r, c, 1) ** 2 for a, b, c in kept.setdefault(f, [])):
            kept[f].append((x, y, r))
    return sorted((f, *c) for f, found in kept.items() for c in found)


def circle_rows(frames, each):
    return [(f, i * 37 % 211 - 90, i * (53 + f) % 307, i * i % 17, ((i * 7919 + f) % 10_007) / 10_007) for f in range(frames) for i in range(each)]


CIRCLES = "frame_id long, cx long, cy long, radius long, score double"


def test_frames_that_a_task_holds_are_not_cut_to_blocks(spark, monkeypatch):
    """One shuffle of the rows, whatever the side of a block; frames go on over the borders of Arrow batches."""
    rows = circle_rows(9, 120)
    odd = [(1, None, 5, 5, 9.0), (1, None, 5, 5, 8.0), (2, 3, 3, None, 9.0), (None, 1, 1, 1, 9.0)]
    df = spark.createDataFrame([*rows, *rows[:30], *odd], CIRCLES)
    monkeypatch.setattr(spatial, "_settle_blocks", None)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "70")
    try:
        kept = spatial.suppress_overlaps(df, [-F.col("score")], 2)
        assert plan(kept).count("Exchange hashpartitioning(frame_id") == 2  # rows with a place, and those without
        found = [tuple(r) for r in kept.collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(r[:4] for r in found if None not in r) == brute_frames(rows)
    assert sorted((r for r in found if None in r), key=str) == sorted((odd[0], odd[2], odd[3]), key=str)


@pytest.mark.parametrize("block", [64, 2])
def test_crowded_frames_are_cut_and_settled_blocks_get_no_copies(spark, monkeypatch, block):
    rows = circle_rows(3, 40) + [(7, *r[1:]) for r in circle_rows(1, 200)] + [(8, 100 * i, 0, 9, 1 - i / 1000) for i in range(300)]
    foreign, settle = [], spatial._settle_blocks
    monkeypatch.setattr(spatial, "FRAME_ROWS", 50)
    monkeypatch.setattr(spatial, "_settle_blocks", lambda *a: (foreign.append(a[0].filter("NOT own AND frame_id = 8").count()), settle(*a))[1])
    kept = spatial.suppress_overlaps(spark.createDataFrame(rows, CIRCLES), [-F.col("score")], block)
    assert sorted(tuple(r)[:4] for r in kept.collect()) == brute_frames(rows)
    assert foreign[0] > 0 and not any(foreign[1:])


def test_assembly_meets_its_frames_in_one_join(spark):
    """Proposals are put together, labelled and reduced before; the last plan has no join for labels, keys or the scene."""
    schema = "frame_id long, cx long, cy long, radius long, score double, candidate_source string, pos int"
    sizes = [(f, 0, 0, 640, 360, 640, 360) for f in (1, 2, 3, 4, 5, 6, 6, None)]
    frames = spark.createDataFrame(sizes, "frame_id long, x0 long, y0 long, x1 long, y1 long, width long, height long")
    main = [(1, 50 * i, 100, 9, 0.9 - i / 10, "main", i) for i in range(5)] + [(2, 50 * i, 100, 9, 0.9 - i / 10, "main", i) for i in range(3)]
    main += [(2, None, 1, 9, 2.0, "main", 9), (6, None, 1, 9, 2.0, "main", 0)]  # a place among the best, but no crop
    blobs = [(f, 300, 300, 9, 0.95, "blob", 0) for f in (1, 2, 3, 99)]
    late = [(2, 0, 100, 9, 0.1, "late", 0), (4, 7, 7, 9, 0.1, "late", 0)]  # the first one is a copy of a main proposal
    main, blobs, late = (spark.createDataFrame(r, schema) for r in (main, blobs, late))
    found = spatial.assemble_candidates(frames, main, blobs, [-F.col("score"), "_step", "pos", "cx", "cy", "radius"], late=[late])
    text = plan(found)
    assert text.count("SortMergeJoin") == 1 and "BroadcastHashJoin" not in text and "BroadcastNestedLoopJoin" not in text
    got = {}
    for r in found.collect():
        got.setdefault(r["frame_id"], []).append((r["candidate_id"], r["candidate_source"], r["cx"], r["score"]))
    assert sorted(got[1]) == [(f"crop_0{i}", "main", 50 * i, 0.9 - i / 10) for i in range(5)]
    assert sorted(got[2]) == [
        ("crop_01", "blob", 300, 0.95), ("crop_02", "late", 0, 0.9), ("crop_03", "main", 50, 0.8), ("crop_04", "main", 100, 0.7),
    ]
    assert got[3] == [("crop_00", "blob", 300, 0.95)] and got[4] == [("crop_00", "late", 7, 0.1)]
    assert [r[:2] for r in sorted(got[5])] == [(f"crop_0{i}", "grid") for i in range(6)]
    assert got[6] == [("crop_00", "scene_fallback", 320, 0.0)] * 2 and got[None] == got[6][:1] and 99 not in got
