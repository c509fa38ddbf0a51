"""Small cases with known results: labels, bounds, ties, splits, rules and errors."""

import hashlib

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from framegate.functions import keys as K
from framegate.functions import rules as R
from framegate.operators import boards, cascade, documents, filters, graph, joins, metrics, order, pixels, ranking, sequences, spatial, splits
from framegate.operators import thresholds as T
from framegate.sources import readers
from framegate.streaming import frames, tables


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_gate_summary_of_four_rows(spark):
    data = [
        ("a", 10, 8, 0.6, 0.7), ("b", 10, 4, 0.0, 0.1), ("c", 0, 0, 1.0, 1.0), ("d", 0, 9, 0.0, 0.1),
    ]
    df = spark.createDataFrame(data, "id string, gt_pixels long, pred_pixels long, iou double, dice double").withColumn("split", F.lit("val"))
    got = {r["scope"]: r for r in metrics.gate_summary(df).collect()}["overall"]
    assert (got["count"], got["positive_count"], got["positive_zero_iou"], got["true_negative"]) == (4, 2, 1, 1)
    assert (got["negative_false_positive"], got["negative_false_positive_rate"]) == (1, 0.5)


def test_gate_summary_without_rows_has_zero_means(spark):
    empty = spark.createDataFrame([], "split string, gt_pixels long, pred_pixels long, iou double, dice double")
    assert [r["scope"] for r in metrics.gate_summary(empty).collect()] in ([], ["overall"])


def test_empty_masks(spark):
    z = F.lit(0)
    assert one(spark, pixels.iou(z, z, z, 1.0)) == 1.0
    assert one(spark, pixels.iou(z, z, z, 0.0)) == 0.0
    assert one(spark, pixels.dice(z, z, z)) == 1.0


@pytest.mark.parametrize(
    "gt, pred, iou, label",
    [
        (0, 0, 1.0, "true_negative"), (0, 3, 0.0, "negative_false_positive"), (5, 5, 0.5, "success"),
        (5, 0, 0.0, "positive_no_prediction"), (5, 3, 0.0, "positive_zero_iou_wrong_prediction"), (5, 3, 0.2, "positive_partial_miss"),
    ],
)
def test_failure_labels(spark, gt, pred, iou, label):
    assert one(spark, metrics.failure_label(F.lit(gt), F.lit(pred), F.lit(iou))) == label


def test_frame_groups_share_a_bucket(spark):
    def key(n):
        return one(spark, K.frame_group_key(F.lit(f"/v/clip_f{n:08d}.png")))

    assert key(933) == key(934) == "/v/clip:bucket00000037"
    assert key(2000) != key(933)
    assert one(spark, K.frame_group_key(F.lit("/v/still.png"))) == "/v/still"


def test_score_bands_are_half_open_and_rules_are_closed(spark):
    v = F.lit(0.5)
    assert one(spark, R.in_band(v, 0.5, 0.6)) and not one(spark, R.in_band(v, 0.4, 0.5))
    assert one(spark, R.within(v, 0.4, 0.5)) and not one(spark, R.within(F.lit(None).cast("double"), None, 9.0))


def test_first_row_wins_ties_under_any_partitioning(spark):
    df = spark.createDataFrame([("f", i, 1.0) for i in range(50)], "frame string, pos int, score double")
    for parts in (1, 3, 16):
        best = ranking.top_per_key(df.repartition(parts).orderBy(F.rand(parts)), ["frame"], [F.desc("score"), "pos"])
        assert best.first()["pos"] == 0


def test_veto_threshold_prefers_the_lowest_of_equals(spark):
    df = spark.createDataFrame([(0.9, 1), (0.8, 1), (0.2, 0), (0.1, 0)], "p double, t int")
    best = T.veto_threshold(df, "p", F.col("t") == 1).first()
    assert best["threshold"] == 0.3 and best["hit"] == 2 and best["miss"] == 0
    assert T.arbiter_threshold(df, "p", F.col("t") == 1).first()["threshold"] == 0.8


def test_global_rank_and_sums_with_one_hot_key(spark):
    df = spark.range(5000).select(F.when(F.col("id") % 3 > 0, 0).otherwise(F.col("id")).alias("k"), (F.col("id") * 7919 % 5000).alias("v"))
    ranked = order.global_rank(df.repartition(7), ["v", "k"]).agg(F.min("rank"), F.max("rank"), F.countDistinct("rank")).first()
    assert tuple(ranked) == (1, 5000, 5000)
    grouped = order.grouped_rank(df, ["k"], ["v"]).groupBy("k").agg(F.max("rank").alias("m"), F.count("*").alias("n"))
    assert grouped.filter("m <> n").count() == 0
    sums = order.running_sums(df, ["k"], ["v"], {"s": "v"}).groupBy("k").agg(F.max("s").alias("s"), F.sum("v").alias("t"))
    assert sums.filter("s <> t").count() == 0


def test_exact_quantiles_match_interpolation(spark):
    df = spark.createDataFrame([(float(v),) for v in (1, 2, 4, 8)], "v double")
    got = order.exact_quantiles(df, [], "v", {"p10": 0.1, "p50": 0.5}).first()
    assert (round(got["p10"], 9), got["p50"]) == (1.3, 3.0)


def test_group_holdout_keeps_groups_whole_and_falls_back(spark):
    df = spark.createDataFrame([(f"g{i % 7}", i) for i in range(70)], "g string, i int")
    held = splits.group_holdout(df, "g", 0.4)
    whole = held.groupBy("g").count().filter("count <> 10").count()
    assert whole == 0
    assert {r["g"] for r in splits.group_holdout(df, "g", 0.0).collect()} == {"g0"}


def test_random_split_counts(spark):
    for n, val in ((1, 0), (2, 1), (10, 2), (100, 15)):
        got = splits.random_split(spark.range(n), "id", 0.15, 1).filter("split = 'val'").count()
        assert got == val


def brute_nms(items):
    kept = []
    for x, y, r, s in sorted(items, key=lambda c: -c[3]):
        if all((x - a) ** 2 + (y - b) ** 2 >= max(r, q, 1) ** 2 for a, b, q, _ in kept):
            kept.append((x, y, r, s))
    return sorted((x, y, r) for x, y, r, _ in kept)


@pytest.mark.parametrize("block", [64, 3, 1])
def test_suppression_equals_the_sequential_result(spark, block):
    items = [(i * 37 % 101, i * 53 % 67, 3 + i % 6, ((i * 7919) % 997) / 997) for i in range(300)]
    df = spark.createDataFrame([("f", *c) for c in items], "frame_id string, cx int, cy int, radius int, score double")
    kept = spatial.suppress_overlaps(df, [-F.col("score"), "cx", "cy"], block)
    assert rows(kept, "cx", "cy", "radius") == brute_nms(items)


def test_a_chain_of_conflicts_takes_a_round_per_block(spark, monkeypatch):
    """5,000 circles, each covered by the one before; circles without a radius stay."""
    chain = [("f", 9 * i, 0, 10, 1.0 - i / 10_000) for i in range(5000)] + [("f", None, 0, 10, 2.0), ("g", 1, 1, None, 0.5)]
    df = spark.createDataFrame(chain, "frame_id string, cx int, cy int, radius int, score double")
    rounds, settle = [], spatial._settle_blocks
    monkeypatch.setattr(spatial, "_settle_blocks", lambda *a: (rounds.append(1), settle(*a))[1])
    kept = spatial.suppress_overlaps(df, [-F.col("score")], 800).collect()
    assert sorted(r["cx"] for r in kept if r["cx"] is not None and r["radius"]) == [9 * i for i in range(0, 5000, 2)]
    assert len(kept) == 2502 and len(rounds) <= 2 + 45_000 // 8000


def test_components_of_long_paths_stars_and_cycles(spark):
    """Contraction: exact labels, and a number of rounds that is logarithmic."""
    path = [("p", i, i + 1) for i in range(3000)]
    star = [("s", 5000, i) for i in range(500)]
    ring = [("r", i, (i + 1) % 77) for i in range(77)] + [("r", 100, 100)]
    edges = spark.createDataFrame(path + star + ring, "g string, a long, b long")
    vertices = edges.select("g", F.col("a").alias("id")).union(edges.select("g", "b")).union(spark.createDataFrame([("q", 7)], "g string, id long"))
    found = {(r["g"], r["id"]): r["label"] for r in graph.connected_components(vertices, edges, ["g"]).collect()}
    assert {found["p", i] for i in range(3001)} == {0} and {found["s", i] for i in (*range(500), 5000)} == {0}
    assert {found["r", i] for i in range(77)} == {0} and found["r", 100] == 100 and found["q", 7] == 7 and len(found) == 3001 + 501 + 78 + 1


def test_a_thousand_masks_over_one_pixel(spark):
    """Greedy suppression against a plain loop, with all masks crowded over the same pixels."""
    import random

    rng = random.Random(4)
    masks = {m: {(0, 0)} | {(rng.randrange(12), rng.randrange(12)) for _ in range(rng.randint(1, 30))} for m in range(1000)}
    ranks = {m: rng.random() for m in masks}
    kept = []
    for m in sorted(masks, key=ranks.get):
        if len(kept) < 6 and all(len(masks[m] & masks[k]) / len(masks[m] | masks[k]) < 0.1 for k in kept):
            kept.append(m)
    px = spark.createDataFrame([(1, m, x, y) for m, spots in masks.items() for x, y in spots], "frame_id int, mask_id int, x int, y int")
    rank = spark.createDataFrame([(1, m, r) for m, r in ranks.items()], "frame_id int, mask_id int, rank double")
    found = graph.suppress_masks(px, rank, 0.1, 6)
    assert [r["mask_id"] for r in found.orderBy("rank").collect()] == kept
    assert graph.suppress_masks(px.limit(0), rank, 0.1, 6).count() == 0

def brute_components(points):
    left, label = set(points), {}
    while left:
        first = min(left, key=lambda p: (p[1], p[0]))
        todo, part = [first], {first}
        while todo:
            x, y = todo.pop()
            for q in [(x + a, y + b) for a in (-1, 0, 1) for b in (-1, 0, 1)]:
                if q in left and q not in part:
                    part.add(q)
                    todo.append(q)
        left -= part
        label |= {p: part for p in part}
    return label


def test_components_and_spurs(spark):
    line = [(x, 20) for x in range(40)] + [(18, 21), (18, 22)] + [(x, 30) for x in range(5)]
    df = spark.createDataFrame([("f", x, y) for x, y in line], "frame_id string, x long, y long")
    labelled = graph.pixel_components(df, ["frame_id"]).collect()
    expected = brute_components(line)
    for a in labelled:
        same = {(b["x"], b["y"]) for b in labelled if b["label"] == a["label"]}
        assert same == expected[(a["x"], a["y"])]
    pruned = rows(graph.prune_spurs(df.filter("y < 30"), ["frame_id"]), "x", "y")
    assert (18, 22) not in pruned and (0, 20) in pruned and (39, 20) in pruned


def test_path_runs_along_the_line(spark):
    line = spark.createDataFrame([("f", x, 5) for x in range(12)], "frame_id string, x long, y long")
    ball = spark.createDataFrame([("f", 0, 5, 4)], "frame_id string, cx long, cy long, radius int")
    best = graph.best_endpoints(line, ball, ["frame_id"]).first()
    assert (best["x"], best["length"]) == (11, 12)


def brute_thin(values, gap, threshold):
    out, last = [], None
    for i, v in values:
        if last is None:
            kept = True
        else:
            kept = i - last[0] >= gap and abs(v - last[1]) >= threshold
        if kept:
            last = (i, v)
            out.append(i)
    return out


@pytest.mark.parametrize("chunk", [10_000, 97])
def test_thinning_of_one_long_video(spark, chunk):
    values = [(i, float((i * 7919) % 101)) for i in range(1500)]
    df = spark.createDataFrame([("v", i, x) for i, x in values], "video string, i long, x double")
    got = sequences.thin_sequence(df.repartition(5), "video", "i", "x", 4, 30.0, chunk).filter("decision = 'kept'")
    assert [r["i"] for r in got.orderBy("i").collect()] == brute_thin(values, 4, 30.0)


def test_moving_average_over_chunks(spark):
    values = [float((i * 31) % 17) for i in range(500)]
    df = spark.createDataFrame([("v", i, x) for i, x in enumerate(values)], "video string, i long, x double")
    got = sequences.moving_average(df, "video", "i", "x", 0.9, 64).orderBy("i").collect()
    state = values[0]
    for r, x in zip(got, values):
        state = x if r["i"] == 0 else state * 0.9 + x * 0.1
        assert abs(r["average"] - state) < 1e-9


def test_patience_counts_from_the_last_accepted_best(spark):
    values = [0.5, 0.5004, 0.5008, 0.4, 0.45, 0.6]  # stops before the last value
    df = spark.createDataFrame([("r", i, v) for i, v in enumerate(values)], "run string, epoch int, m double")
    got = ranking.early_stopping(df, "run", "epoch", "m", 0.0005, 2).first()
    assert (got["best_epoch"], got["best_value"], got["stop_epoch"]) == (2, 0.5008, 4)


def test_import_takes_first_valid_copy(spark):
    source = spark.createDataFrame([(0, "a", False), (1, "a", True), (2, "a", True), (3, "b", True), (4, "", True)], "pos int, id string, ok boolean")
    target = spark.createDataFrame([("", "b")], "id string, source_sample_id string")
    got = boards.import_decisions(source, target, "x_", F.col("ok"), ["pos"])
    assert rows(got, "pos", "decision") == [(0, "invalid"), (1, "imported"), (2, "exists"), (3, "exists"), (4, "invalid")]


def test_tolerance_counts_at_the_edge(spark):
    data = [("f", "pred", 0, 0), ("f", "pred", 9, 0), ("f", "gt", 2, 2), ("f", "gt", 12, 0), ("g", "gt", 1, 1)]
    df = spark.createDataFrame(data, "frame_id string, side string, x long, y long")
    assert rows(spatial.tolerance_counts(df, 2), "frame_id", "tp", "fp", "fn") == [("f", 1, 1, 1), ("g", 0, 0, 1)]


def test_jsonl_modes(spark, tmp_path):
    path = tmp_path / "a.jsonl"
    path.write_text('﻿{"id": "a"}\n\n{"id": \n{"id": "b"}\n', encoding="utf-8")
    assert rows(readers.read_jsonl(spark, str(path), "id string", "lenient"), "id") == [("a",), ("b",)]
    with pytest.raises(PySparkException, match="bad JSON line"):
        readers.read_jsonl(spark, str(path), "id string").collect()
    assert readers.read_jsonl(spark, str(tmp_path / "none"), "id string").count() == 0


def test_errors_are_raised(spark):
    a, b = spark.range(3), spark.range(4).withColumn("x", F.lit(1))
    with pytest.raises(PySparkException, match="different frames"):
        joins.aligned_join(a, b, "id").collect()
    with pytest.raises(ValueError, match="matches no row"):
        joins.restrict_to_manifest(a, spark.range(10, 12), "id")
    with pytest.raises(PySparkException, match="no id"):
        boards.tagged_union([(spark.createDataFrame([("",)], "id string"), {"t": "x"})], "id").collect()
    docs = spark.createDataFrame([('{"splits": {"old_val": []}}',)], "doc string")
    with pytest.raises(PySparkException, match="unknown split"):
        readers.explode_board(docs, "doc", ["nope"]).collect()
    with pytest.raises(ValueError, match="unsupported context rule key"):
        cascade.reject_context(a, [{"source": "x", "odd": 1}])
    with pytest.raises(ValueError, match="no validation rows"):
        splits.resolve_split(a, "id", spark.createDataFrame([(0, "train"), (99, "val")], "id long, split string"), 0.1, 1)


def test_gate_reasons_in_order(spark):
    checks = [(F.col("v") > 1, "small"), (F.col("v") < 5, "large")]
    df = spark.createDataFrame([(0,), (3,), (9,), (None,)], "v int").withColumn("r", filters.first_reason(checks))
    assert [r["r"] for r in df.collect()] == ["small", None, "large", "small"]


def test_policy_documents_differ_only_by_path(spark):
    left = spark.createDataFrame([('{"a": {"checkpoint": "/x/y.pt", "min": 1}, "l": [1, 2]}',)], "doc string")
    right = spark.createDataFrame([('{"a": {"checkpoint": "z.PTH", "min": 1}, "l": [1, 3]}',)], "doc string")
    assert rows(boards.policy_difference(left, right, "doc"), "name", "left", "right") == [("l.1", "2", "3")]


def test_documents_are_walked_level_by_level_without_python(spark):
    doc = (
        '{"a": 1, "b": {"c": 2.5, "mask": {"x": 9}, "d": {"e": -3}}, "l": [1, "t", 3, [4], {"z": 5}], "long": [1,2,3,4,5,6,7], '
        '"t": "x", "n": null, "ok": true, "o": {}, "k": [], "big": 12345678901234567890, "deep": {"l": [[1]]}}'
    )
    docs = spark.createDataFrame([(1, doc), (2, None), (3, "7"), (4, "[1, 2]"), (5, "{}")], "id int, doc string")
    numbers = documents.flatten_numeric(docs, "id", "doc")
    assert "Python" not in numbers._jdf.queryExecution().toString()
    assert rows(numbers, "id", "name", "value") == sorted(
        [(1, "a", 1.0), (1, "b.c", 2.5), (1, "b.d.e", -3.0), (1, "l.0", 1.0), (1, "l.2", 3.0), (1, "big", 12345678901234567890.0), (3, "", 7.0), (4, "0", 1.0), (4, "1", 2.0)]
    )
    assert rows(documents.long_lists(docs, "id", "doc"), "id", "name", "entries") == [(1, "long", 7)]
    assert rows(documents.flatten_numeric(docs.filter("id = 1"), "id", "doc", 7).filter("name LIKE 'long%'"), "name") == [(f"long.{i}",) for i in range(7)]
    leaves = dict(rows(documents.flatten_leaves(docs.filter("id = 1"), "id", "doc"), "name", "value"))
    assert leaves["o"] == "{}" and leaves["k"] == "[]" and leaves["n"] == "null" and leaves["ok"] == "true" and leaves["t"] == "x"
    assert leaves["deep.l.0.0"] == "1" and leaves["l.4.z"] == "5" and leaves["b.mask.x"] == "9" and leaves["b.c"] == "2.5"
    assert documents.flatten_numeric(docs.limit(0), "id", "doc").count() == 0


def test_texts_are_never_cut(spark):
    long = "x" * (1 << 20) + "/" + "y" * 5000
    assert len(one(spark, K.normalize_path(F.lit("C:/" + long)))) == len("/mnt/c/" + long)
    assert len(one(spark, K.output_stem(F.lit("/r/" + long), "/r"))) == len(long) + 1


def test_digest_tree_of_blocks(spark):
    blocks = [("s", n, 10 + n, hashlib.sha256(bytes([n])).hexdigest()) for n in (2, 10, 1)]
    files = spark.createDataFrame(blocks, "source string, block long, bytes long, sha256 string").repartition(3)
    row = readers.tree_checksums(files, ["source"], "block").first()
    ordered = "".join(b[3] for b in sorted(blocks, key=lambda b: b[1]))
    assert (row["bytes"], row["blocks"], row["sha256"]) == (43, 3, hashlib.sha256(ordered.encode()).hexdigest())


def test_selector_rule_skips_the_current_item(spark):
    data = [("f", "c0", "primary", 0.9, 0), ("f", "c1", "primary", 0.5, 1), ("f", "c2", "primary", 0.5, 2)]
    flat = spark.createDataFrame(data, "frame_id string, candidate_id string, selector_pool string, score double, pos int").withColumns(
        {"candidate_source": F.lit("white_blob"), "candidate_score": F.lit(0.0), "pred_pixels": F.lit(5), "features": F.create_map().cast("map<string,double>")}
    )
    pool = cascade.write_pool(cascade.as_items(flat, ["pos"]), ["pos"])
    state = cascade.initial_state(pool)
    got = cascade.selector(state, [{"candidate_source": "white_blob"}], pool)
    out = cascade.report(got).first()
    assert out["candidate_id"] == "c1" and out["flags"] == ["candidate_selector_rescue"] and out["lineage"][0]["candidate_id"] == "c0"


def test_frame_groups_of_bare_and_backslash_names(spark):
    keys = {
        "clip_f00000030.png": "./clip:bucket00000001", "still.png": "still", "v/still.png": "v/still",
        "C:\\v\\clip_f00000030.png": "C:/v/clip:bucket00000001", "C:\\v\\still.png": "C:/v/still", "/clip_f00000030.png": "/clip:bucket00000001",
    }
    for path, key in keys.items():
        assert one(spark, K.frame_group_key(F.lit(path))) == key


def test_no_group_on_both_sides_of_a_holdout(spark):
    """Neighbouring frames stay together whatever form their paths have."""
    paths = [f"{folder}clip{v}_f{n:08d}.png" for folder in ("", "a/b/", "C:\\w\\") for v in range(6) for n in range(0, 100, 5)]
    items = spark.createDataFrame([(p,) for p in paths], "path string").withColumn("g", K.frame_group_key(F.col("path")))
    held = {r["path"] for r in splits.group_holdout(items, "g", 0.3).collect()}
    buckets = {}
    for p in paths:
        stem, number = p.removesuffix(".png").rsplit("_f", 1)
        buckets.setdefault((stem, int(number) // 25), set()).add(p in held)
    assert 0 < len(held) < len(paths) and all(len(sides) == 1 for sides in buckets.values())


def item_rows(spark, data):
    names = "frame_id long, candidate_id string, candidate_source string, selector_pool string, score double, candidate_score double, pred_pixels long, pos int, heuristic_score double, confidence double"
    flat = spark.createDataFrame(data, names).withColumn("features", F.create_map(F.lit("ball_fill_fraction"), F.lit(0.5), F.lit("confidence"), F.lit(0.9)))
    return cascade.write_pool(cascade.as_items(flat, ["pos"]), ["pos"])


@pytest.mark.parametrize(
    "rule, winner",
    [
        ({"min_candidate_heuristic_score": 2.5}, "b"), ({"min_candidate_heuristic_score": 9.5}, "a"),
        ({"max_candidate_heuristic_score": 9.0, "max_current_heuristic_score": 1.0}, "b"), ({"min_current_heuristic_score": 1.5}, "a"),
        ({"min_candidate_confidence": 0.8}, "a"), ({"max_candidate_confidence": 0.3}, "b"), ({"min_candidate_ball_fill_fraction": 0.4}, "b"),
        ({"min_candidate_raw_score": 0.0}, "a"),
    ],
)
def test_rules_see_every_number_of_an_item(spark, rule, winner):
    """An item's own number goes before a feature of the same name; a missing one never matches."""
    pool = item_rows(spark, [(1, "a", "table_hough", "primary", 0.9, 0.0, 5, 0, 1.0, 0.1), (1, "b", "white_blob", "primary", 0.2, 0.0, 5, 1, 9.0, 0.2)])
    state = cascade.selector(cascade.initial_state(pool), [{"candidate_source": "white_blob", **rule}], pool)
    assert cascade.report(state).first()["candidate_id"] == winner


def test_pooled_rules_and_choosers_leave_their_flags(spark):
    data = [(1, "a", "table_hough", "primary", 0.9, 0.0, 5, 0, None, None), (1, "b", "white_blob", "fallback", 0.8, 0.0, 5, 1, None, None)]
    pool = item_rows(spark, data)
    state = cascade.initial_state(pool).withColumn("open_pools", F.array(F.lit("primary"), F.lit("fallback")))
    rule = {"candidate_source": "white_blob", "candidate_pool": "fallback"}
    flags = cascade.report(cascade.selector(state, [rule], pool)).first()["flags"]
    assert set(flags) == {"candidate_selector_rescue", "pooled_candidate_selector_rescue"}
    for chosen, expected in ((True, {"fallback", "meta_selector"}), (False, set())):
        after = cascade.fallback(cascade.initial_state(pool).withColumn("use", F.lit(chosen)), {"chooser": "use"})
        assert set(cascade.report(after).first()["flags"]) == expected


def test_the_pool_is_shuffled_once_and_items_are_never_aggregated(spark):
    """After the pool is written no plan moves its items, and ties go to the first position."""
    data = [(f, f"c{i}", "white_blob", p, 0.5, 0.0, 5, i, None, None) for f in range(40) for i, p in enumerate(["primary", "primary", "fallback"])]
    pool = item_rows(spark, data)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        state = cascade.initial_state(pool)
        after = cascade.selector(state, [{"candidate_source": "white_blob", "candidate_pool": "primary"}], pool)
        for plan in (state, after):
            text = plan._jdf.queryExecution().executedPlan().toString()
            assert "Exchange" not in text and "Aggregate" not in text
        assert {r["candidate_id"] for r in cascade.report(state).collect()} == {"c0"}
        assert {r["candidate_id"] for r in cascade.report(after).collect()} == {"c1"}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def harvested(spark, table):
    rows_ = spark.read.option("basePath", table).parquet(table)
    return sorted((r["id"], r["v"]) for r in rows_.collect())


def test_harvest_survives_a_lost_checkpoint_and_a_second_job(spark, tmp_path):
    source, table = str(tmp_path / "in"), str(tmp_path / "out")

    def add(ids, v):
        spark.createDataFrame([(i, v) for i in ids], "id long, v long").coalesce(1).write.mode("append").parquet(source)

    def run(checkpoint):
        frames.harvest(frames.file_stream(spark, source), lambda df: df, table, "id", checkpoint=str(tmp_path / checkpoint))

    add(range(10), 1)
    run("one")
    first = harvested(spark, table)
    assert [i for i, _ in first] == list(range(10))
    add([3, 3, 10, 11], 2)
    run("one")
    assert harvested(spark, table) == first + [(10, 2), (11, 2)]
    before = harvested(spark, table)
    run("lost")  # reads every file again
    assert harvested(spark, table) == before
    add(range(5, 15), 3)
    run("other job")
    assert harvested(spark, table) == before + [(12, 3), (13, 3), (14, 3)]
    run("one")
    assert harvested(spark, table) == before + [(12, 3), (13, 3), (14, 3)]


def test_reads_and_files_of_a_batch_stay_flat_over_fifty_batches(spark, tmp_path):
    """A batch rewrites its buckets only; a repeated one, also after its commit, gives the same rows."""
    table = tables.BucketTable(spark, str(tmp_path / "t"), ["id"], buckets=4)

    def rows_of(n):
        return spark.createDataFrame([(n % 7, n), (100 + n % 3, n)], "id long, v long").coalesce(1)

    files, expected = [], {}
    for n in range(50):
        table.merge(rows_of(n), n)
        expected |= {n % 7: n, 100 + n % 3: n}
        if n % 10 == 9:
            table.merge(rows_of(n), n)
            files.append(sum(1 for _ in tmp_path.rglob("*.parquet")))
            assert dict(rows(table.rows(table.committed()[1]), "id", "v")) == expected
    assert len(table.commits()) == 2 and max(files) <= 2 * 4 + 2
    assert table.committed(49)[0] == 48 and dict(rows(table.rows(table.committed(49)[1]), "id", "v"))[48 % 7] == 48


def test_keys_written_after_the_last_commit_are_known(spark, tmp_path):
    """A run that wrote a batch, but not its index, and lost its checkpoint."""
    table, index = str(tmp_path / "out"), str(tmp_path / "out-index")
    keys = spark.createDataFrame([(i,) for i in range(6)], "id long")
    first = tables.DoneKeys(spark, index, [table], "a", ["id"])
    keys.filter("id < 2").write.parquet(f"{table}/run=a/batch=0")
    first.commit(keys.filter("id < 2"), 0, "x")
    keys.filter("id = 2").write.parquet(f"{table}/run=a/batch=1")
    fresh, note = tables.DoneKeys(spark, index, [table], "b", ["id"]).fresh(keys, 0)
    assert rows(fresh, "id") == [(3,), (4,), (5,)] and note == "x"
    assert rows(first.fresh(keys, 1)[0], "id") == [(2,), (3,), (4,), (5,)]


def test_harvest_repeats_a_batch_with_the_same_rows(spark, tmp_path):
    """A batch that failed after it wrote is replaced, not added; the first row of a key by the order stays."""
    source, table = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([(i % 5, i) for i in range(20)], "id long, v long").repartition(4).write.parquet(source)
    failed = []

    def decide(batch):
        if not failed:
            failed.append(True)
            raise ValueError("once")
        return batch

    for attempt in range(2):
        try:
            frames.harvest(frames.file_stream(spark, source), decide, table, "id", order=["v"], checkpoint=str(tmp_path / "c"))
        except Exception:  # noqa: BLE001  (the stream wraps it)
            assert attempt == 0
    assert harvested(spark, table) == [(i, i) for i in range(5)]


def test_late_split_keeps_what_other_runs_wrote(spark, tmp_path):
    source, table, late = (str(tmp_path / n) for n in ("in", "ok", "late"))

    def add(rows_):
        df = spark.createDataFrame(rows_, "id long, at string").select("id", F.to_timestamp("at").alias("ts"))
        df.coalesce(1).write.mode("append").parquet(source)

    def run(checkpoint):
        frames.split_late(frames.file_stream(spark, source), "1 HOUR", table, late, ["id"], checkpoint=str(tmp_path / checkpoint))
        return [sorted(r["id"] for r in spark.read.option("basePath", p).parquet(p).collect()) for p in (table, late)]

    add([(1, "2026-01-01 12:00:00"), (2, "2026-01-01 08:00:00")])
    assert run("one") == [[1, 2], []]
    add([(3, "2026-01-01 09:00:00"), (4, "2026-01-01 11:30:00")])
    assert run("one") == [[1, 2, 4], [3]]
    assert run("lost") == [[1, 2, 4], [3]]


def test_ring_members_lie_between_two_radii_and_rank_by_support(spark):
    """Per ring, the circles with most support, whatever their own score; the new score mixes both."""
    data = [(1, 100 + d, 50, s, u) for d, s, u in ((6, 0.9, 1.0), (7, 0.8, 1.0), (8, 0.1, 0.2), (20, 0.5, 0.9), (27, 0.7, 0.1), (28, 0.95, 1.0))]
    circles = spark.createDataFrame(data, "frame_id long, cx int, cy int, score double, support double")
    rings = spark.createDataFrame([(1, 100, 50, 10), (1, 120, 50, 4)], "frame_id long, ring_x int, ring_y int, ring_radius int")
    got = spatial.ring_candidates(circles, rings, ["cx"])
    found = {(r["ring_x"], r["ring_rank"]): (r["cx"], r["candidate_source"], round(r["score"], 9)) for r in got.collect()}
    assert found == {
        (100, 0): (120, "reticle_global_0", 0.89), (100, 1): (108, "reticle_global_1", 0.19), (100, 2): (127, "reticle_global_2", 0.55),
        (120, 0): (128, "reticle_global_0", 1.0), (120, 1): (127, "reticle_global_1", 0.55),
    }


def test_assembly_adds_late_sources_always_and_a_scene_where_nothing_is_left(spark):
    schema = "frame_id long, cx int, cy int, radius int, score double, candidate_source string, pos int"
    frames_ = spark.createDataFrame([(f, 0, 0, 320, 240, 320, 240) for f in (1, 2, 3)], "frame_id long, x0 int, y0 int, x1 int, y1 int, width int, height int")
    main = spark.createDataFrame([(1, 20 * i, 100, 9, 0.5, "table_hough", i) for i in range(6)], schema)
    blobs = spark.createDataFrame([(f, 300, 20, 9, 0.9, "white_blob", 0) for f in (1, 2)], schema)
    late = [spark.createDataFrame([(1, 200, 200, 9, 0.1, name, 0)], schema) for name in ("colored_blob", "line_endpoint")]
    found = spatial.assemble_candidates(frames_, main, blobs, [-F.col("score"), "_step", "pos"], late=late, grid=0).collect()
    assert sorted({(r["frame_id"], r["candidate_source"]) for r in found}) == [
        (1, "line_endpoint"), (1, "table_hough"), (2, "white_blob"), (3, "scene_fallback"),
    ]
    scene = next(r for r in found if r["frame_id"] == 3)
    assert [scene[c] for c in ("candidate_id", "cx", "cy", "radius", "score", "x0", "y0", "x1", "y1")] == ["crop_00", 160, 120, 24, 0.0, 117, 77, 203, 163]


def test_context_under_the_names_of_the_rules(spark):
    """A mask 15 pixels from the nearest centre; the winner's own circle counts; unknown features are an error."""
    px = spark.createDataFrame([(1, x, 0) for x in range(4)], "frame_id long, x int, y int")
    circles = spark.createDataFrame([(1, 18, 0, 5, "table_hough", 0), (1, 40, 0, 30, "white_blob", 1)], "frame_id long, cx int, cy int, radius int, candidate_source string, pos int")
    own = spark.createDataFrame([(1, 100, 0, 0, "external")], "frame_id long, cx int, cy int, radius int, candidate_source string")
    row = spatial.context_features(px, circles, ["pos"], float("inf"), own).first()
    assert row["candidate_count"] == 3 and row["min_candidate_center_distance"] == 15.0 and row["min_abs_candidate_boundary_distance"] == 7.0
    assert row["nearest_candidate_source"] == "white_blob" and row["min_candidate_boundary_distance_norm"] == 7 / 30
    assert row["mask_fraction_near_any_candidate"] == 1.0 and row["mask_fraction_inside_any_candidate"] == 0.0
    state = spark.range(1)
    with pytest.raises(ValueError, match="unsupported context rule key"):
        cascade.reject_context(state, [{"source": "x", "min_no_such_feature": 1}])