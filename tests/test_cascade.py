"""The cascade moves and sorts no whole item or state where a frame's narrow columns decide."""

import pytest
from pyspark.sql import functions as F

from framegate.operators import cascade

NAMES = "frame_id long, candidate_id string, candidate_source string, selector_pool string, score double, candidate_score double, pred_pixels long, pos int"


def written_pool(spark, data):
    flat = spark.createDataFrame(data, NAMES).withColumn("features", F.create_map(F.lit("ball_fill_fraction"), F.lit(0.5)))
    return cascade.write_pool(cascade.as_items(flat, ["pos"]), ["pos"])


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_best_items_of_all_pools_in_one_look(spark):
    data = [
        (1, "a", "x", "primary", 0.5, 0.0, 3, 0), (1, "b", "x", "primary", 0.5, 0.0, 3, 1), (1, "c", "x", "rescue", None, 0.0, 3, 2),
        (2, "d", "x", "primary", None, 0.0, 3, 0), (2, "e", "x", "primary", 0.1, 0.0, 3, 1), (3, "f", "x", "fallback", 0.9, 0.0, 3, 0),
    ]
    state = cascade.initial_state(written_pool(spark, data))
    rows = {r["frame_id"]: r for r in state.collect()}
    assert sorted(rows) == [1, 2]
    assert rows[1]["primary"]["candidate_id"] == "a" and rows[1]["rescue"]["candidate_id"] == "c" and rows[1]["fallback"] is None
    assert rows[2]["current"]["candidate_id"] == "e"
    assert state._jdf.queryExecution().optimizedPlan().collectLeaves().size() == 1 and "Join" not in plan(state)


def test_selector_sorts_neither_pool_nor_state(spark):
    pool = written_pool(spark, [(1, "a", "x", "primary", 0.5, 0.0, 3, 0), (1, "b", "y", "primary", 0.4, 0.0, 3, 1)])
    after = cascade.selector(cascade.initial_state(pool), [{"candidate_source": "y"}], pool)
    assert "SortMergeJoin" not in plan(after) and "ShuffledHashJoin" in plan(after)
    assert cascade.report(after).first()["candidate_id"] == "b"


def test_external_stages_note_every_winner_they_replace(spark):
    pool = written_pool(spark, [(1, "a", "x", "primary", 0.5, 0.0, 3, 0), (2, "b", "x", "primary", 0.5, 0.0, 3, 0)])
    names = "frame_id long, band string, pred_area long, prob_mean double"
    externals = spark.createDataFrame([(1, "main", 7, 0.3), (1, "mid", 9, 0.35), (2, "mid", 1, 0.9)], names)
    cfg = {"main": {"max_score": 0.6}, "mid": {"max_score": 0.4, "current_max_ball_fill_fraction": 0.1}}
    after = cascade.external(cascade.initial_state(pool, externals), cfg)
    rows = {r["frame_id"]: r for r in after.collect()}
    current = rows[1]["current"]
    assert (current["candidate_id"], current["score"], current["mask_pixels"], current["flags"]) == ("external_main_mid_rescue", 0.35, 9, ["external_mid_rescue"])
    assert current["extra"] == {"pre_external_mid_rescue_score": 0.3} and current["features"] == {}
    assert [tuple(s) for s in rows[1]["lineage"]] == [("external_rescue", "a", "x", 0.5), ("external_mid_rescue", "external_main_rescue", "external_main_rescue", 0.3)]
    assert rows[2]["current"]["candidate_id"] == "b" and rows[2]["lineage"] == []
    assert cascade.external(cascade.initial_state(pool, externals), {}).count() == 2


def test_context_is_asked_for_frames_a_rule_can_reject_only(spark):
    pool = written_pool(spark, [(1, "a", "x", "primary", 0.5, 0.0, 3, 0), (2, "b", "y", "primary", 0.5, 0.0, 3, 0)])
    asked = []

    def context(frames):
        asked.extend(r["frame_id"] for r in frames.collect())
        return frames.select("frame_id", F.create_map(F.lit("candidate_count"), F.lit(2.0)).alias("context"))

    policy = {"reject_context": [{"source": "x", "min_candidate_count": 1}]}
    after = cascade.run(cascade.initial_state(pool), pool, policy, last="reject_context", context=context)
    assert {r["frame_id"]: r["final_pixels"] for r in cascade.report(after).collect()} == {1: 0, 2: 3}
    assert asked == [1]


def test_flat_rows_move_before_items_are_made(spark):
    data = [(f, f"c{i}", "x", "primary", 0.1 * i, 0.0, i, (i * 7) % 5) for f in range(9) for i in range(5)]
    flat = spark.createDataFrame(data, NAMES).withColumn("features", F.create_map(F.lit("reach"), F.col("score")))
    placed = cascade.as_items(cascade.place(flat.drop("features"), "frame_id", ["pos"]).withColumn("features", F.create_map(F.lit("reach"), F.col("score"))), ["pos"])
    below = plan(placed)
    assert "candidate" not in below[below.index("Exchange"):].split("\n")[0] and "named_struct" not in below[below.index("Exchange"):]
    pools = [cascade.write_pool(cascade.as_items(flat, ["pos"]), ["pos"]), cascade.write_pool(placed, ["pos"], placed=True)]
    first, second = ([(r["frame_id"], r["candidate"]) for r in p.orderBy("frame_id", "item_no").collect()] for p in pools)
    assert first == second and [c["candidate_id"] for f, c in second if f == 3] == ["c0", "c3", "c1", "c4", "c2"]


def test_external_numbers_are_summed_in_columns_and_come_once(spark):
    pool = written_pool(spark, [(1, "a", "x", "primary", 0.5, 0.0, 3, 0)])
    names = "frame_id long, band string, pred_area long, prob_mean double"
    state = cascade.initial_state(pool, spark.createDataFrame([(1, "main", 7, 0.3), (2, "mid", 1, 0.9)], names))
    assert "collect_list" not in plan(state) and "ObjectHashAggregate" not in plan(state)
    twice = spark.createDataFrame([(1, "main", 7, 0.3), (1, "main", 7, 0.3)], names)
    with pytest.raises(Exception, match="twice"):
        cascade.external(cascade.initial_state(pool, twice), {"main": {"max_score": 0.6}}).collect()


def test_refine_moves_nothing_that_lies_in_buckets(spark):
    data = [(1, "a", "x", "primary", 0.5, 0.0, 3, 0), (1, "b", "x", "primary", 0.4, 0.0, 5, 1), (2, "a", "x", "primary", 0.5, 0.0, 4, 0)]
    pool = written_pool(spark, data)
    state = cascade.bucketed(cascade.initial_state(pool))
    item = F.col("candidate")
    rows = pool.select("frame_id", item["candidate_id"].alias("candidate_id"), item["selector_pool"].alias("selector_pool"), item["pred_pixels"].alias("n"))
    asked = []

    def masks(winners):
        asked.append(winners)
        own = cascade.of_winners(rows, winners).groupBy("frame_id", "candidate_id", "selector_pool").agg((F.max("n") - 3).alias("refined_pixels"))
        return own.withColumn("refined_features", F.create_map(F.lit("reach"), F.lit(0.25)))

    after = cascade.refine(state, masks)
    assert "Exchange" not in plan(after)
    sizes = {r["frame_id"]: (r["current"]["candidate_id"], r["current"]["mask_pixels"], r["current"]["flags"]) for r in after.collect()}
    assert sizes == {1: ("a", 3, []), 2: ("a", 1, ["final_refine"])}
    assert sorted(tuple(r) for r in asked[0].collect()) == [(1, "a", "primary"), (2, "a", "primary")]
    whole = rows.select("frame_id", "candidate_id", "selector_pool", (F.col("n") - 3).alias("refined_pixels"), F.create_map(F.lit("reach"), F.lit(0.25)).alias("refined_features"))
    assert {r["frame_id"]: r["current"] for r in cascade.refine(state, whole).collect()} == {r["frame_id"]: r["current"] for r in after.collect()}


def test_context_comes_to_the_buckets_of_the_state(spark):
    pool = written_pool(spark, [(1, "a", "x", "primary", 0.5, 0.0, 3, 0), (2, "b", "y", "primary", 0.5, 0.0, 3, 0)])
    state = cascade.bucketed(cascade.initial_state(pool))

    def context(frames):
        return frames.repartition(50, "frame_id").select("frame_id", F.create_map(F.lit("candidate_count"), F.lit(2.0)).alias("context"))

    after = cascade.run(state, pool, {"reject_context": [{"source": "x", "min_candidate_count": 1}]}, last="reject_context", context=context)
    assert plan(after).count(", 50)") == 1
    assert {r["frame_id"]: r["final_pixels"] for r in cascade.report(after).collect()} == {1: 0, 2: 3}
