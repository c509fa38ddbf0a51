"""Operators without SQL, and hidden rounds of others, against plain single-process versions."""

import numpy as np
from pyspark.sql import functions as F

from framegate.operators import evaluation, features, graph, order, ranking, splits


def plain_largest(pixels):
    left, best = set(pixels), None
    for start in sorted(pixels, key=lambda p: (p[1], p[0])):
        if start not in left:
            continue
        left.discard(start)
        part, todo = {start}, [start]
        while todo:
            x, y = todo.pop()
            for near in [(x + dx, y + dy) for dx in (-1, 0, 1) for dy in (-1, 0, 1)]:
                if near in left:
                    left.discard(near)
                    part.add(near)
                    todo.append(near)
        if best is None or len(part) > len(best):
            best = part
    return best


def plain_prune(pixels, rounds=3):
    pixels = set(pixels)
    for _ in range(rounds):
        if len(pixels) < 3:
            return pixels
        spots = np.array(sorted(pixels), dtype=float)
        centred = spots - spots.mean(axis=0)
        axis = np.linalg.eigh(centred.T @ centred)[1][:, 1]
        off = np.abs(centred[:, 1] * axis[0] - centred[:, 0] * axis[1])
        q = np.quantile(off, 0.82)
        spurs = set()
        for (x, y), far in zip(spots.astype(int).tolist(), off):
            degree = sum((x + dx, y + dy) in pixels for dx in (-1, 0, 1) for dy in (-1, 0, 1)) - 1
            if (degree <= 1 and far > max(0.75, q + 0.10)) or (degree <= 2 and far > q + max(0.45, 0.22 * max(1.0, q))):
                spurs.add((x, y))
        limit = max(3, round(len(pixels) * 0.08))
        if not spurs or len(spurs) > limit or len(spurs) >= len(pixels):
            return pixels
        pixels = plain_largest(pixels - spurs)
    return pixels


def test_spurs_equal_the_plain_version(spark):
    rng = np.random.default_rng(5)
    frames = {}
    for f in range(12):
        slope = rng.uniform(-0.6, 0.6)
        line = {(x, int(round(40 + slope * x))) for x in range(60)}
        for _ in range(int(rng.integers(0, 4))):
            x, side = int(rng.integers(3, 57)), int(rng.choice([-1, 1]))
            line |= {(x, int(round(40 + slope * x)) + side * k) for k in range(1, int(rng.integers(2, 6)))}
        frames[f] = line
    frames[12] = {(0, 0), (1, 1)}
    df = spark.createDataFrame([(f, x, y) for f, line in frames.items() for x, y in line], "frame_id long, x long, y long")
    got = {}
    for r in graph.prune_spurs(df.repartition(5), ["frame_id"]).collect():
        got.setdefault(r["frame_id"], set()).add((r["x"], r["y"]))
    assert got == {f: plain_prune(line) for f, line in frames.items()}
    assert any(len(got[f]) < len(line) for f, line in frames.items())


def test_spurs_are_trimmed_inside_buckets(spark):
    line = spark.range(40).selectExpr("id % 4 AS frame_id", "id DIV 4 AS x", "CAST(0 AS BIGINT) AS y")
    nub = spark.range(4).selectExpr("id AS frame_id", "CAST(4 AS BIGINT) AS x", "CAST(1 AS BIGINT) AS y")
    result = graph.prune_spurs(line.unionByName(nub), ["frame_id"])
    text = result._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in text and "ExistingRDD" not in text
    assert result.distinct().count() == result.count() > 0


def test_components_of_whole_frames_equal_those_of_links(spark):
    rng = np.random.default_rng(7)
    spots = [(f"f{f}", int(x), int(y)) for f in range(12) for x, y in rng.integers(0, 14, (5 + 9 * f, 2))]
    spots += [("far", 2_000_000_000, 5), ("far", 2_000_000_000, 6), ("far", 0, 7), ("neg", -1, 3), ("neg", 0, 4), (None, 1, 1), ("f1", None, 2), ("f1", 2, None)]
    pixels = spark.createDataFrame(spots + spots[:50], "frame_id string, x long, y long").repartition(7)
    got = sorted(map(tuple, graph.components_together(pixels, ["frame_id"]).collect()))
    assert got == sorted(map(tuple, graph.pixel_components(pixels.dropna(), ["frame_id"]).collect()))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        assert got == sorted(map(tuple, graph.components_together(pixels, ["frame_id"]).collect()))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_quantiles_in_one_task_equal_spread_ones(spark):
    rows = [(k, v) for k in (1, 2, None) for v in (0.5, 0.25, 0.25, None, 7.0, 1e-3)] + [(3, None), (4, 2.0)]
    df = spark.createDataFrame(rows, "k long, v double")
    wanted = {"low": 0.1, "mid": 0.5, "high": 0.82}
    key = lambda r: (r[0] is None, r[0] or 0)
    spread = sorted(map(tuple, order.exact_quantiles(df, ["k"], "v", wanted).collect()), key=key)
    assert spread == sorted(map(tuple, order.quantiles_together(df, ["k"], "v", wanted).collect()), key=key)


def test_classifier_equals_newton_steps(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 3)) * [1.0, 4.0, 0.2] + [0.0, 2.0, -1.0]
    y = (x @ [1.2, -0.3, 2.0] + rng.normal(size=600) > -1.0).astype(float)
    df = spark.createDataFrame([(i, *map(float, v), float(t)) for i, (v, t) in enumerate(zip(x, y))], "id long, a double, b double, c double, y double")
    model = features.train_classifier(df, ["a", "b", "c"], "y")
    got = np.array([r["probability"] for r in features.classify(model, df, "y").orderBy("id").collect()])
    weight = np.where(y > 0, max(1.0, min(25.0, (y == 0).sum() / max(1, y.sum()))), 1.0)
    design, beta = np.c_[x, np.ones(len(x))], np.zeros(4)
    for _ in range(30):
        p = 1 / (1 + np.exp(-design @ beta))
        beta += np.linalg.solve((design * (weight * p * (1 - p))[:, None]).T @ design, design.T @ (weight * (y - p)))
    assert np.abs(got - 1 / (1 + np.exp(-design @ beta))).max() < 1e-3


def test_narrow_rank_with_repeats_nulls_and_maps(spark):
    rows = [(k, v, {"m": i}) for i, (k, v) in enumerate([(None, 2), (1, None), (1, 1), (1, 1), (None, None), (0, 9)] + [(5, 5)] * 50)]
    df = spark.createDataFrame(rows, "k long, v long, m map<string,int>").repartition(7)
    got = sorted(((r["rank"], r["k"], r["v"]) for r in order.narrow_rank(df, ["k", "v"]).collect()))
    assert [r for r, _, _ in got] == list(range(1, 57))
    assert [(k, v) for _, k, v in got] == [(None, None), (None, 2), (0, 9), (1, None), (1, 1), (1, 1)] + [(5, 5)] * 50
    assert order.narrow_rank(df.limit(0), ["k", "v"]).count() == 0
    split = splits.temporal_split(df, ["k", "v"], 0.25).groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in split} == {"train": 42, "val": 14}


def test_resume_moves_only_narrow_rows_before_its_join(spark):
    wide = spark.range(200).select("id", F.concat(F.lit("P"), "id").alias("path"), F.repeat(F.lit("x"), 100).alias("payload"))
    got = ranking.resume_from(wide, ["id"], "path", last_path="p150")
    assert sorted(r["position"] for r in got.collect()) == list(range(150, 200))
    assert "payload" not in "".join(p for p in got._jdf.queryExecution().analyzed().toString().split("\n") if "LogicalRDD" in p)


def test_vectors_leave_unknown_names_out(spark):
    spec = spark.createDataFrame([(["a", "b"], ["s"], ["other"], ["f", "g"])], "numeric_names array<string>, source_names array<string>, source_group_names array<string>, flag_names array<string>")
    rows = spark.createDataFrame(
        [(1, {"b": 2.0, "zz": 9.0, "a": None}, "s", ["g", None, "g", "new"]), (2, None, None, None), (3, {}, "t", [])],
        "id int, values map<string,double>, source string, flags array<string>",
    )
    got = {r["id"]: r["vector"] for r in features.dense_vectors(rows, spec).collect()}
    assert got[1][:5] == [0.0, 0.0, 2.0, 1.0, 1.0] and got[1][-2:] == [0.0, 1.0]
    assert got[2][:5] == [0.0] * 5 and got[2][-2:] == [0.0, 0.0] and len({len(v) for v in got.values()}) == 1
    assert got[3][:5] == [0.0] * 5


def test_board_is_evaluated_from_winners_to_report(spark):
    from framegate.operators import evaluation

    board = spark.createDataFrame(
        [("a", "val", 1), ("b", "val", 2), ("b2", "neg", 2), ("c", "neg", 3), ("d", "neg", 4), ("e", "val", 5), ("f", "val", 6)],
        "id string, split string, frame_id long",
    )
    winners = spark.createDataFrame(
        [(1, "c1", "hough", 0.9, 4, ["fallback", "fallback"]), (2, "c1", "blob", 0.5, 0, []), (3, "c2", "hough", 0.4, 2, None), (6, "c1", None, 0.1, 3, ["rescue"]), (9, "c1", "x", 1.0, 9, [])],
        "frame_id long, candidate_id string, candidate_source string, score double, final_pixels long, flags array<string>",
    )
    masks = spark.createDataFrame(
        [(1, "c1", x, 0) for x in range(4)] + [(1, "c1", 0, 0), (1, "c9", 50, 50)] + [(2, "c1", x, 0) for x in range(9)]
        + [(3, "c2", 0, 0), (3, "c2", 1, 0)] + [(6, "c1", 90, y) for y in range(3)] + [(9, "c1", 0, 0)],
        "frame_id long, candidate_id string, x int, y int",
    )
    truth = spark.createDataFrame(
        [(1, x, 0) for x in range(1, 5)] + [(2, 0, 0)] * 2 + [(5, 1, 1), (6, 0, 0), (9, 0, 0)], "frame_id long, x long, y long"
    )
    rows = evaluation.evaluate_board(board, winners, masks, truth).cache()
    got = {r["id"]: (r["gt_pixels"], r["pred_pixels"], round(r["iou"], 6), r["failure_type"], r["winner_source"]) for r in rows.collect()}
    assert got == {
        "a": (4, 4, 0.6, "success", "hough"), "b": (1, 0, 0.0, "positive_no_prediction", "blob"), "b2": (1, 0, 0.0, "positive_no_prediction", "blob"),
        "c": (0, 2, 0.0, "negative_false_positive", "hough"), "d": (0, 0, 1.0, "true_negative", None),
        "e": (1, 0, 0.0, "positive_no_prediction", None), "f": (1, 3, 0.0, "positive_zero_iou_wrong_prediction", None),
    }
    report = {r["scope"]: r for r in evaluation.evaluation_report(rows).collect()}
    assert set(report) == {"val", "neg", "overall"} and report["overall"]["count"] == 7
    assert report["overall"]["winner_source_counts"] == {"None": 3, "blob": 2, "hough": 2}
    assert report["val"]["winner_flag_counts"] == {"fallback": 1, "rescue": 1} and report["neg"]["winner_flag_counts"] == {}
    assert report["neg"]["negative_false_positive_source_counts"] == {"hough": 1}
    assert report["overall"]["failure_counts"]["positive_no_prediction"] == 3
    assert [r["id"] for r in evaluation.worst_items(rows, 3).collect()] == ["f", "c", "b2"]
    assert evaluation.evaluate_board(board, winners, masks, truth, ["neg"]).count() == 3
    assert evaluation.evaluate_board(board.limit(0), winners, masks, truth).count() == 0
    try:
        evaluation.evaluate_board(board, winners, masks, truth, ["neg", "nowhere"])
        raise AssertionError("an unknown split is an error")
    except ValueError as error:
        assert "nowhere" in str(error)


def test_masks_are_drawn_for_shown_winners_only(spark):
    board = spark.createDataFrame([("a", "val", 1), ("b", "val", 2), ("c", "neg", 3)], "id string, split string, frame_id long")
    winners = spark.createDataFrame(
        [(1, "c1", "hough", 0.9, 4, []), (2, "c1", "blob", 0.5, 0, []), (3, "c2", "hough", 0.4, 2, []), (9, "c1", "x", 1.0, 9, [])],
        "frame_id long, candidate_id string, candidate_source string, score double, final_pixels long, flags array<string>",
    )
    sizes = spark.createDataFrame([(f, c, n) for f in (1, 2, 3, 9) for c, n in (("c1", 4), ("c2", 3))], "frame_id long, candidate_id string, n int")
    truth = spark.createDataFrame([(1, x, 0) for x in range(1, 5)] + [(2, 0, 0)], "frame_id long, x long, y long")
    asked = []

    def drawn(rows):
        return rows.select("frame_id", "candidate_id", F.explode(F.expr("sequence(0, n - 1)")).alias("x"), F.lit(0).alias("y"))

    def masks(shown):
        asked.extend(tuple(r) for r in shown.collect())
        return drawn(sizes.join(shown, ["frame_id", "candidate_id"], "left_semi"))

    rows, whole = (sorted(map(tuple, evaluation.evaluate_board(board, winners, m, truth).collect())) for m in (masks, drawn(sizes)))
    assert sorted(asked) == [(1, "c1"), (3, "c2")]
    assert rows == whole and [r[3:5] for r in rows] == [(4, 4), (1, 0), (0, 3)]
