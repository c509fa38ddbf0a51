"""The policy cascade: current winner to next winner, stage by stage, with lineage.

The pool is written once, bucketed by frame (``write_pool``), with a number per item that keeps the order of positions; it
moves as the flat rows its items are made of (``place``).
The state has one row per frame: the ``current`` item, the best item of every pool while stages still switch to those,
the pool that is active, the pools that are open, and what happened so far. Most stages only look at that row, so they are
column expressions in one pass; only the selectors and arbiters meet the pool, by frame. State and pool have the same
buckets, so no such join shuffles the pool again; the side with one row per frame is hashed, so none sorts the pool or the
state either, and only items that a rule lets through are ranked. A policy is a mapping from stage name to its settings,
in the manifest's key format.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from framegate.functions import rules as R
from framegate.functions.keys import candidate_source_group
from framegate.operators.joins import select_by_rules
from framegate.operators.ranking import top_per_key
from framegate.operators.spatial import CONTEXT_FEATURES
from framegate.runtime import bucketed, buckets

ITEM_TYPE = (
    "struct<candidate_id:string,candidate_source:string,selector_pool:string,score:double,candidate_score:double,"
    "pred_pixels:bigint,mask_pixels:bigint,features:map<string,double>,flags:array<string>,extra:map<string,double>>"
)
LINEAGE_TYPE = "array<struct<stage:string,candidate_id:string,candidate_source:string,score:double>>"
FIELDS = frozenset(
    ("candidate_id", "candidate_source", "selector_pool", "score", "candidate_score", "pred_pixels", "mask_pixels", "extra")
)
# The number that stands for an item; it grows with the positions within a frame.
ITEM = ["item_no"]
# Pools whose best item a stage can switch to.
WINNER_POOLS = ("primary", "fallback", "rescue", "secondary_rescue", "fallback_rescue", "reticle_fill_rescue")
# External stages in the order they run, with the id their winner gets.
EXTERNAL_BANDS = {
    "main": "external_main_rescue",
    "mid": "external_main_mid_rescue",
    "lowmid": "external_main_lowmid_rescue",
    "reticle": "external_main_reticle_rescue",
    "tiny_reticle": "external_tiny_reticle_rescue",
    "reticle_large": "external_main_reticle_large_rescue",
    "table_broad": "external_main_table_broad_rescue",
    "blob_low": "external_main_blob_low_rescue",
    "table": "external_main_table_rescue",
    "blob": "external_main_blob_rescue",
    "tiny_blob": "external_tiny_blob_rescue",
}
# What an external stage knows of its winner.
EXTERNAL_NUMBERS = ("pred_area", "prob_mean")
# Further numbers an item may carry; rules find them by name.
ITEM_NUMBERS = (
    "heuristic_score", "raw_score", "confidence", "reranker_score", "validity_score", "reticle_distance", "candidate_radius",
    "meta_selector_logit",
)
CURRENT = R.Item("current", FIELDS)


def as_items(pool: DataFrame, position: Sequence[str]) -> DataFrame:
    """``(frame_id, candidate, position…)`` from flat candidate rows with a ``features`` map.

    Rules look a number up among the item's own values first, then among the ``ITEM_NUMBERS`` columns the rows have and
    what earlier stages noted, then among the features.
    """
    numbers = [x for c in ITEM_NUMBERS if c in pool.columns for x in (F.lit(c), F.col(c).cast("double"))]
    extra = F.map_filter(F.create_map(*numbers).cast("map<string,double>"), lambda _, v: v.isNotNull())
    item = F.struct(
        "candidate_id", "candidate_source", "selector_pool", F.col("score").cast("double"),
        F.col("candidate_score").cast("double"), F.col("pred_pixels").cast("bigint"), F.col("pred_pixels").cast("bigint"),
        "features", F.array().cast("array<string>"), extra,
    ).cast(ITEM_TYPE)
    return pool.select("frame_id", item.alias("candidate"), *position)


def _one_per_frame(df: DataFrame) -> DataFrame:
    """Rows that hold a frame once, as the hashed side of a join by frame: the other side's rows, which may be wide or many
    of one frame, pass by unsorted. What a task hashes is bounded by the frames of a bucket."""
    return df.hint("shuffle_hash")


def place(rows: DataFrame, frame: str, position: Sequence[str]) -> DataFrame:
    """Rows in the task of their frame and in the order of their positions there. Flat rows that items are made of are
    placed before the items are put together, which are several times as wide."""
    return rows.repartition(buckets(rows.sparkSession), frame).sortWithinPartitions(frame, *position)


def write_pool(items: DataFrame, position: Sequence[str], placed: bool = False) -> DataFrame:
    """The items as a table with as many buckets as there are shuffle partitions, and ``item_no`` in place of the
    positions. This is the only time the whole pool moves between tasks; ``placed`` items were made of rows that ``place``
    has moved and put in order already."""
    ordered = items if placed else place(items, "frame_id", position)
    numbered = ordered.select("frame_id", F.monotonically_increasing_id().alias(ITEM[0]), "candidate")
    return bucketed(numbered)


def _settled(state: DataFrame) -> DataFrame:
    return bucketed(state)


def best_items(pool: DataFrame, names: Sequence[str]) -> DataFrame:
    """The first of the best items of every named pool, a column per pool and a row per frame; the pool is read and put
    in the order of its frames once, inside its buckets."""
    of_pool, frame = F.col("candidate.selector_pool"), W.partitionBy("frame_id")
    best = F.struct(F.col("candidate.score").alias("score"), (-F.col(ITEM[0])).alias("first"))
    own = pool.filter(of_pool.isin(*names) & F.col("frame_id").isNotNull())
    chosen = [F.max_by("candidate", F.when(of_pool == n, best)).over(frame).alias(n) for n in names]
    rows = own.select("frame_id", *ITEM, F.min(ITEM[0]).over(frame).alias("_first"), *chosen)
    return rows.filter(F.col(ITEM[0]) == F.col("_first")).drop("_first", *ITEM)


def initial_state(pool: DataFrame, externals: DataFrame | None = None) -> DataFrame:
    """One row per frame that has a primary candidate, from the table ``write_pool`` made.

    ``externals`` has ``(frame_id, band, pred_area, prob_mean)``: at most one row per frame and external stage.
    """
    best = best_items(pool, WINNER_POOLS).filter(F.col(WINNER_POOLS[0]).isNotNull())
    state = best.select(
        "*", F.col("primary").alias("current"), F.lit("primary").alias("active_pool"),
        F.array(F.lit("primary")).alias("open_pools"), F.array().cast(LINEAGE_TYPE).alias("lineage"),
    )
    return state if externals is None else with_externals(state, externals)


def with_externals(state: DataFrame, externals: DataFrame) -> DataFrame:
    """The state with the numbers of every external stage, ``external``, that only the stage of that name looks at.

    They are narrow columns of a hashed sum, not a collected map per frame; a frame that has a stage twice is an error.
    """
    columns = []
    for band in EXTERNAL_BANDS:
        own = F.col("band") == band
        columns += [F.max(F.when(own, F.col(c))).alias(f"{band}_{c}") for c in EXTERNAL_NUMBERS]
        columns.append(F.count_if(own).alias(f"{band}_rows"))
    stats = externals.filter(F.col("frame_id").isNotNull()).groupBy("frame_id").agg(*columns)
    twice = F.greatest(*[F.col(f"{band}_rows") for band in EXTERNAL_BANDS]) > 1
    once = stats.filter(~F.when(twice, F.raise_error(F.lit("a frame has an external stage twice")).cast("boolean")).otherwise(F.lit(False)))
    bands = [F.struct(*[F.col(f"{band}_{c}").alias(c) for c in EXTERNAL_NUMBERS]).alias(band) for band in EXTERNAL_BANDS]
    return state.join(_one_per_frame(once.select("frame_id", F.struct(*bands).alias("external"))), "frame_id", "left")


def _group(item: str = "current") -> Column:
    return candidate_source_group(F.col(f"{item}.candidate_source"))


def _fill(item: str = "current") -> Column:
    return F.coalesce(F.col(f"{item}.features").getItem("ball_fill_fraction"), F.lit(0.0))


def _noted(extra: Column, key: str, value: Column) -> Column:
    return F.map_concat(F.map_filter(extra, lambda k, _: k != key), F.create_map(F.lit(key), value))


def _mark(item: Column, flags: Sequence[str], notes: dict[str, Column]) -> Column:
    marked = item.withField("flags", F.array_union(item["flags"], F.array(*[F.lit(f) for f in flags])))
    extra = item["extra"]
    for key, value in notes.items():
        extra = _noted(extra, key, value)
    return marked.withField("extra", extra)


def _step(stage: str) -> Column:
    return F.struct(
        F.lit(stage).alias("stage"), CURRENT["candidate_id"].alias("candidate_id"),
        CURRENT["candidate_source"].alias("candidate_source"), CURRENT["score"].alias("score"),
    )


def _open(state: DataFrame, pool: str, condition: Column) -> DataFrame:
    opened = F.array_union("open_pools", F.array(F.lit(pool)))
    return state.withColumn("open_pools", F.when(F.coalesce(condition, F.lit(False)), opened).otherwise(F.col("open_pools")))


def _switch(state: DataFrame, condition: Column, item: Column, stage: str, keep: str | None = None, pool: str | None = None) -> DataFrame:
    """Make ``item`` the current winner where the condition holds, and note what it replaced.

    ``keep`` names the pool column that holds the same item, so that its marks stay with it.
    """
    marked = _mark(item, [stage], {f"pre_{stage}_score": CURRENT["score"]})
    # The condition is repeated rather than kept in a column: a projection less copies the row once less.
    go = F.coalesce(condition & item.isNotNull(), F.lit(False))
    changes = {
        "current": F.when(go, marked).otherwise(F.col("current")),
        "lineage": F.when(go, F.array_append("lineage", _step(stage))).otherwise(F.col("lineage")),
    }
    if keep is not None:
        changes[keep] = F.when(go, marked).otherwise(F.col(keep))
    if pool is not None:
        changes["active_pool"] = F.when(go, F.lit(pool)).otherwise(F.col("active_pool"))
    return state.withColumns(changes)


def fallback(state: DataFrame, cfg: dict) -> DataFrame:
    """Take the fallback winner below a score, or where a chooser column ``use_fallback`` says so."""
    has = F.col("fallback").isNotNull()
    if cfg.get("chooser"):
        chosen = F.coalesce(F.col(cfg["chooser"]), F.lit(False))
        # The chooser leaves its own mark on the item it chose.
        marked = F.when(has, _mark(F.col("fallback"), ["meta_selector"], {}))
        state = _open(state, "fallback", has).withColumn("fallback", F.when(chosen, marked).otherwise(F.col("fallback")))
        return _switch(state, chosen, F.col("fallback"), "fallback", "fallback", "fallback")
    low = CURRENT["score"] < cfg["score_threshold"]
    # A frame above the threshold never ran the fallback model, so its fallback winner is unknown later on.
    state = _open(state, "fallback", has & low)
    state = state.withColumn("fallback", F.when(low, F.col("fallback")))
    return _switch(state, low, F.col("fallback"), "fallback", "fallback", "fallback")


def rescue(state: DataFrame, cfg: dict) -> DataFrame:
    low = CURRENT["score"] < cfg["score_threshold"]
    state = _open(state, "rescue", low & F.col("rescue").isNotNull())
    return _switch(state, low, F.col("rescue"), "rescue", None, "rescue")


def final_fallback(state: DataFrame, cfg: dict) -> DataFrame:
    low = CURRENT["score"] < cfg["score_threshold"]
    return _switch(state, low, F.col("fallback"), "final_fallback", "fallback", "fallback")


def exemption_tag(state: DataFrame, cfg: dict) -> DataFrame:
    """Mark winners that the secondary rescue must leave alone."""
    hit = R.exempted(CURRENT, cfg.get("exemptions", []))
    marked = _mark(F.col("current"), ["secondary_rescue_current_exemption"], {})
    return state.withColumn("current", F.when(hit, marked).otherwise(F.col("current")))


def secondary_rescue(state: DataFrame, cfg: dict) -> DataFrame:
    run = R.in_band(CURRENT["score"], cfg["min_score"], cfg["max_score"])
    if cfg.get("source") is not None:
        run = run & (CURRENT["candidate_source"] == cfg["source"])
    run = F.coalesce(run & ~CURRENT.has_flag("secondary_rescue_current_exemption"), F.lit(False))
    state = _open(state, "secondary_rescue", run & F.col("secondary_rescue").isNotNull())
    enough = F.lit(True) if cfg.get("min_ball_fill_fraction") is None else _fill("secondary_rescue") >= cfg["min_ball_fill_fraction"]
    return _switch(state, run & enough, F.col("secondary_rescue"), "secondary_rescue", None, "secondary_rescue")


def _recovery(state: DataFrame, cfg: dict, stage: str) -> DataFrame:
    checks = [R.in_band(CURRENT["score"], cfg.get("min_score"), cfg.get("max_score"))]
    if cfg.get("source") is not None:
        checks.append(CURRENT["candidate_source"] == cfg["source"])
    if cfg.get("current_group") is not None:
        checks.append(_group() == cfg["current_group"])
    if cfg.get("candidate_source") is not None:
        checks.append(F.col("primary.candidate_source") == cfg["candidate_source"])
    if cfg.get("candidate_group") is not None:
        checks.append(_group("primary") == cfg["candidate_group"])
    if cfg.get("min_primary_score") is not None:
        checks.append(F.col("primary.score") >= cfg["min_primary_score"])
    if cfg.get("min_ball_fill_fraction") is not None:
        checks.append(_fill("primary") >= cfg["min_ball_fill_fraction"])
    return _switch(state, R.all_of(checks), F.col("primary"), stage, "primary", "primary")


def primary_recovery(state: DataFrame, cfg: dict) -> DataFrame:
    return _recovery(state, cfg, "primary_recovery")


def reticle_recovery(state: DataFrame, cfg: dict) -> DataFrame:
    fixed = {"current_group": "reticle_global", "candidate_group": "reticle_global"}
    return _recovery(state, {**cfg, **fixed}, "reticle_recovery")


def fallback_rescue(state: DataFrame, cfg: dict) -> DataFrame:
    run = CURRENT.has_flag("fallback") & R.in_band(CURRENT["score"], cfg["min_score"], cfg["max_score"])
    if cfg.get("source_group") is not None:
        run = run & (_group() == cfg["source_group"])
    state = _open(state, "fallback_rescue", run & F.col("fallback_rescue").isNotNull())
    better = F.col("fallback_rescue.score") > CURRENT["score"]
    return _switch(state, run & better, F.col("fallback_rescue"), "fallback_rescue", None, "fallback_rescue")


def reticle_fill_rescue(state: DataFrame, cfg: dict) -> DataFrame:
    run = CURRENT.has_flag("reticle_recovery") & (_group() == "reticle_global")
    run = run & R.in_band(CURRENT["score"], cfg["min_score"], cfg["max_score"])
    if cfg.get("current_max_ball_fill_fraction") is not None:
        run = run & (_fill() < cfg["current_max_ball_fill_fraction"])
    state = _open(state, "reticle_fill_rescue", run & F.col("reticle_fill_rescue").isNotNull())
    fits = _group("reticle_fill_rescue") == "reticle_global"
    if cfg.get("target_min_ball_fill_fraction") is not None:
        fits = fits & (_fill("reticle_fill_rescue") >= cfg["target_min_ball_fill_fraction"])
    return _switch(state, run & fits, F.col("reticle_fill_rescue"), "reticle_fill_rescue", None, "reticle_fill_rescue")


def _configs(cfg: object) -> list[dict]:
    return [cfg] if isinstance(cfg, dict) else list(cfg or [])


def open_pools(state: DataFrame, cfg: object, default_pool: str = "") -> DataFrame:
    """Open the pool of every setting whose gate the current winner passes."""
    for number, one in enumerate(_configs(cfg)):
        pool = str(one.get("pool", one.get("name", default_pool or f"pool_{number}")))
        state = _open(state, pool, R.current_side(CURRENT, one))
    return state


def micro_line_pool(state: DataFrame, cfg: object) -> DataFrame:
    return open_pools(state, [{**c, "pool": "micro_line_rescue"} for c in _configs(cfg)])


def colored_blob_pools(state: DataFrame, cfg: object) -> DataFrame:
    return open_pools(state, [{**c, "pool": "colored_blob_rescue"} for c in _configs(cfg)])


def _take(
    state: DataFrame, picks: DataFrame, stage: str, notes: dict[str, Column], pooled: Column | None = None
) -> DataFrame:
    """Switch to the picked ``candidate`` of each frame; ``notes`` are values taken from the pick, ``pooled`` says that
    a rule with pools of its own picked it."""
    joined = state.join(_one_per_frame(picks), "frame_id", "left")
    marked = F.col("candidate")
    if pooled is not None:
        flagged = F.array_union(marked["flags"], F.array(F.lit(f"pooled_{stage}")))
        marked = marked.withField("flags", F.when(pooled, flagged).otherwise(marked["flags"]))
    for key, value in notes.items():
        marked = marked.withField("extra", _noted(marked["extra"], key, value))
    return _switch(joined, F.col("candidate").isNotNull(), marked, stage).drop(*[c for c in picks.columns if c != "frame_id"])


def selector(state: DataFrame, rules: Sequence[R.Rule], pool: DataFrame, stage: str = "candidate_selector_rescue") -> DataFrame:
    """Rules without a pool search the active pool first; rules with a pool then search the open pools."""
    active = [r for r in rules if "candidate_pool" not in r and "candidate_pools" not in r]
    pooled = [r for r in rules if r not in active]
    if not rules:
        return state
    candidate_pool = F.col("candidate.selector_pool")
    allowed = [candidate_pool == F.col("active_pool")] * len(active) + [F.array_contains("open_pools", candidate_pool)] * len(pooled)
    state = _settled(state)
    current = _one_per_frame(state.select("frame_id", "current", "active_pool", "open_pools"))
    picks = select_by_rules(current, pool, [*active, *pooled], "frame_id", ITEM, FIELDS, FIELDS, allowed, narrow=True)
    rule = F.col("rule_no").cast("double")
    return _take(state, picks.drop(*ITEM), stage, {f"{stage}_rule": rule}, rule > len(active))


def arbiter(
    state: DataFrame, cfg: object, pool: DataFrame, probability: Callable[[R.Item, R.Item], Column], stage: str = "rescue_arbiter"
) -> DataFrame:
    """Learned replacement: the first setting whose most probable eligible candidate reaches its threshold."""
    configs = _configs(cfg)
    if not configs:
        return state
    state = _settled(state)
    candidate = R.Item("candidate", FIELDS)
    left = state.select("frame_id", "current", "open_pools").filter(R.any_of([R.current_side(CURRENT, c) for c in configs]))
    right = pool.filter(R.any_of([R.candidate_side(candidate, c, source_required=False) for c in configs]))
    sides = [
        R.current_side(CURRENT, c) & R.candidate_side(candidate, c, source_required=False) & R.different_item(CURRENT, candidate)
        for c in configs
    ]
    fits = [F.when(both, F.lit(i)) for i, both in enumerate(sides)]
    # Pairs that fit no setting leave before anything is made of them.
    met = _one_per_frame(left).join(right, "frame_id").filter(F.array_contains("open_pools", F.col("candidate.selector_pool")) & R.any_of(sides))
    scored = met.select(
        "frame_id", *ITEM, "candidate", probability(CURRENT, candidate).alias("p"),
        F.explode(F.array_compact(F.array(*fits))).alias("config_no"),
    )
    best = top_per_key(scored, ["frame_id", "config_no"], [F.desc("p"), *ITEM])
    reached = best.filter(F.col("p") >= R.by_number(F.col("config_no") + 1, [F.lit(float(c["threshold"])) for c in configs]))
    first = top_per_key(reached, ["frame_id"], ["config_no"]).select("frame_id", "candidate", "p")
    return _take(state, first, stage, {f"{stage}_probability": F.col("p")})


def external(state: DataFrame, cfg: dict[str, dict]) -> DataFrame:
    """The external stages in their fixed order; each sees the result of the one before.

    What they look at (score, source group, fill and name of the winner) is carried along in narrow columns; the winner, its
    marks and the lineage are put together once, after the last stage.
    """
    bands = [band for band in EXTERNAL_BANDS if band in cfg]
    stages = ["external_rescue" if band == "main" else f"external_{band}_rescue" for band in bands]
    none = F.lit(None)
    state = state.withColumns(
        {
            "_score": CURRENT["score"], "_group": _group(), "_fill": _fill(), "_id": CURRENT["candidate_id"],
            "_source": CURRENT["candidate_source"], "_stage": none.cast("string"), "_area": none.cast("bigint"), "_before": none.cast("double"),
        }
    )
    steps = []
    for number, (band, stage) in enumerate(zip(bands, stages)):
        c, stats, item_id = cfg[band], F.col("external")[band], F.lit(EXTERNAL_BANDS[band])
        run = R.in_band(F.col("_score"), c.get("min_score"), c.get("max_score"))
        if c.get("source_group") is not None:
            run = run & (F.col("_group") == c["source_group"])
        if c.get("current_max_ball_fill_fraction") is not None:
            run = run & (F.col("_fill") <= c["current_max_ball_fill_fraction"])
        run = run & (stats["pred_area"] >= c.get("min_pred_area", 0)) & (stats["prob_mean"] >= c.get("min_prob_mean", 0.0))
        state = state.withColumn("_go", F.coalesce(run, F.lit(False)))
        step = F.struct(F.lit(stage).alias("stage"), F.col("_id").alias("candidate_id"), F.col("_source").alias("candidate_source"), F.col("_score").alias("score"))
        after = {
            "_score": stats["prob_mean"].cast("double"), "_group": candidate_source_group(item_id), "_fill": F.lit(0.0), "_id": item_id,
            "_source": item_id, "_stage": F.lit(stage), "_area": stats["pred_area"].cast("bigint"), "_before": F.col("_score"),
        }
        changes = {name: F.when(F.col("_go"), value).otherwise(F.col(name)) for name, value in after.items()}
        steps.append(f"_step{number}")
        state = state.withColumns({**changes, steps[-1]: F.when(F.col("_go"), step)})
    item = F.struct(
        F.col("_id"), F.col("_source"), none.cast("string"), F.col("_score"), none.cast("double"), none.cast("bigint"), F.col("_area"),
        F.create_map().cast("map<string,double>"), F.array(F.col("_stage")),
        F.create_map(F.concat(F.lit("pre_"), F.col("_stage"), F.lit("_score")), F.col("_before")),
    ).cast(ITEM_TYPE)
    hit = F.col("_stage").isNotNull()
    passed = F.concat(F.col("lineage"), F.array_compact(F.array(*[F.col(c) for c in steps])) if steps else F.array().cast(LINEAGE_TYPE))
    done = state.withColumns(
        {"current": F.when(hit, item).otherwise(F.col("current")), "lineage": F.when(hit, passed).otherwise(F.col("lineage"))}
    )
    return done.drop("_score", "_group", "_fill", "_id", "_source", "_stage", "_area", "_before", "_go", *steps)


def of_winners(rows: DataFrame, winners: DataFrame) -> DataFrame:
    """Rows with ``(frame_id, candidate_id, selector_pool)`` of the winner of their frame. Only the frame is a key, so sides
    that lie in buckets by frame stay there; id and pool are looked at where it matches."""
    same = (F.col("candidate_id") == F.col("winner_id")) & (F.col("selector_pool") == F.col("winner_pool"))
    return rows.join(_one_per_frame(winners), "frame_id").filter(F.coalesce(same, F.lit(False))).drop("winner_id", "winner_pool")


def refine(state: DataFrame, refined: DataFrame | Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Replace the winner's mask by its refined one where that has pixels; external winners stay as they are.

    ``refined`` has ``(frame_id, candidate_id, selector_pool, refined_pixels, refined_features)``, or gives these rows for
    winners ``(frame_id, winner_id, winner_pool)``, so that no others need be made. The state is read twice.
    """
    named = state.select("frame_id", CURRENT["candidate_id"].alias("winner_id"), CURRENT["selector_pool"].alias("winner_pool"))
    if callable(refined):
        refined = refined(named)
    own = of_winners(refined, named).select("frame_id", "refined_pixels", "refined_features")
    joined = state.join(_one_per_frame(own), "frame_id", "left")
    good = F.coalesce(F.col("refined_pixels") > 0, F.lit(False))
    item = _mark(F.col("current"), ["final_refine"], {})
    item = item.withField("mask_pixels", F.col("refined_pixels").cast("bigint")).withField("features", F.col("refined_features"))
    return joined.withColumn("current", F.when(good, item).otherwise(F.col("current"))).drop("refined_pixels", "refined_features")


def begin_rejects(state: DataFrame) -> DataFrame:
    """``mask_size`` is the winner's mask before the rejects, ``final_pixels`` what is left of it."""
    size = F.coalesce(CURRENT["mask_pixels"], F.lit(0))
    return state.withColumns({"mask_size": size, "final_pixels": size})


def _reject(state: DataFrame, condition: Column, stage: str) -> DataFrame:
    """Empty the mask and keep the winner, with its size before the reject."""
    go = F.coalesce(condition, F.lit(False))
    marked = _mark(F.col("current"), [stage], {f"pre_{stage}_pred_pixels": F.col("final_pixels").cast("double")})
    return state.withColumns(
        {
            "lineage": F.when(go, F.array_append("lineage", _step(stage))).otherwise(F.col("lineage")),
            "current": F.when(go, marked).otherwise(F.col("current")),
            "final_pixels": F.when(go, F.lit(0).cast("bigint")).otherwise(F.col("final_pixels")),
        }
    )


def reject_final_fallback(state: DataFrame, cfg: dict) -> DataFrame:
    bad = []
    if cfg.get("min_pred_pixels") is not None:
        bad.append(F.col("mask_size") >= cfg["min_pred_pixels"])
    if cfg.get("max_score") is not None:
        bad.append(CURRENT["score"] < cfg["max_score"])
    wanted = (_group() == "table_hough") & CURRENT.has_flag("final_fallback")
    return _reject(state, wanted & R.any_of(bad), "table_hough_final_fallback_reject")


def _with_size(state: DataFrame, size: str) -> R.Item:
    """The current item with its pixel count replaced by the size of the mask."""
    return _Sized("current", FIELDS, size)


class _Sized(R.Item):
    def __init__(self, name: str, fields: frozenset[str], size: str):
        super().__init__(name, fields)
        object.__setattr__(self, "size", size)

    def number(self, key: str) -> Column:
        return F.col(self.size).cast("double") if key == "pred_pixels" else super().number(key)


def _source_exempted(item: R.Item, table: dict[str, list[R.Rule]]) -> Column:
    """Exemptions of the exact source and of its folded group both count."""
    source, group = item["candidate_source"], _group()
    return R.any_of(
        [((source == name) | (group == name)) & R.any_of([R.thresholds(item, r) for r in rules]) for name, rules in table.items()]
    )


def reject_source_area(state: DataFrame, cfg: dict) -> DataFrame:
    limit = R.by_source(CURRENT, cfg["min_pred_pixels"])
    exempt = _source_exempted(_with_size(state, "mask_size"), cfg.get("exemptions", {}))
    return _reject(state, (F.col("mask_size") >= limit) & ~exempt, "winner_source_area_reject")


def reject_source_area_score(state: DataFrame, cfg: dict[str, dict]) -> DataFrame:
    size = R.by_source(CURRENT, {s: r.get("min_pred_pixels") for s, r in cfg.items()})
    score = R.by_source(CURRENT, {s: r.get("max_score") for s, r in cfg.items()})
    source, group = CURRENT["candidate_source"], _group()
    exempt = R.any_of(
        [
            ((source == name) | ((group == name) & ~source.isin(*cfg))) & R.any_of([R.thresholds(CURRENT, e) for e in r.get("exemptions", [])])
            for name, r in cfg.items()
        ]
    )
    bad = (F.col("mask_size") >= size) & (CURRENT["score"] < score)
    return _reject(state, bad & ~exempt, "winner_source_area_score_reject")


def reject_pre_final_fallback(state: DataFrame, cfg: dict) -> DataFrame:
    before = CURRENT["extra"].getItem("pre_final_fallback_score")
    return _reject(state, (F.col("final_pixels") > 0) & (before <= cfg["max_score"]), "pre_final_fallback_score_reject")


def reject_context(state: DataFrame, rules: Sequence[R.Rule]) -> DataFrame:
    """First context rule that matches; ``context`` is a map of the frame's context features (``context_map``). A rule on
    a feature that doesn't exist is an error; one that a frame lacks never matches."""
    hits = []
    for rule in rules:
        checks = [R.source_matches(CURRENT["candidate_source"], rule.get("source"), rule.get("source_group"))]
        for key, limit in rule.items():
            if key in ("name", "source", "source_group") or limit is None:
                continue
            if not key.startswith(("min_", "max_")) or key[4:] not in CONTEXT_FEATURES:
                raise ValueError(f"unsupported context rule key: {key}")
            value = F.col("context").getItem(key[4:])
            checks.append(value >= float(limit) if key.startswith("min_") else value <= float(limit))
        hits.append(R.all_of(checks))
    return _reject(state, (F.col("final_pixels") > 0) & R.any_of(hits), "final_context_reject")


def _with_context(state: DataFrame, context: Callable[[DataFrame], DataFrame], named: DataFrame | None, rules: Sequence[R.Rule]) -> DataFrame:
    """The state with the context of the frames some rule can reject, by the source of their winner. ``named`` is an
    earlier state with the same winners, if one was written."""
    wanted = [R.source_matches(CURRENT["candidate_source"], r.get("source"), r.get("source_group")) for r in rules]
    frames = (state if named is None else named).filter(R.any_of(wanted)).select("frame_id")
    # In as many parts as the state has buckets: the narrow side moves, never the state.
    found = context(frames).repartition(buckets(state.sparkSession), "frame_id")
    return state.join(_one_per_frame(found), "frame_id", "left")


def reject_veto(state: DataFrame, cfg: object) -> DataFrame:
    """Any veto setting whose probability column reaches its threshold, with its source list, sizes and exemptions."""
    hits = []
    item = _with_size(state, "final_pixels")
    for c in _configs(cfg):
        checks = [F.col(c["probability"]) >= c["threshold"]]
        if c.get("sources") is not None:
            checks.append(CURRENT["candidate_source"].isin(*c["sources"]))
        size = R.by_source(CURRENT, c.get("source_min_pred_pixels", {}))
        size = F.coalesce(size.cast("double"), F.lit(c.get("min_pred_pixels")).cast("double"), F.lit(0.0))
        checks.append(F.col("final_pixels") >= size)
        checks.append(~_source_exempted(item, c.get("source_exemptions", {})))
        hits.append(R.all_of(checks))
    return _reject(state, (F.col("final_pixels") > 0) & R.any_of(hits), "image_final_veto")


def post_final(state: DataFrame, rules: Sequence[R.Rule], pool: DataFrame) -> DataFrame:
    """Last selector: for empty masks, and for rules that allow it also for others; the candidate brings its mask."""
    noted = F.col("current").withField("extra", _noted(CURRENT["extra"], "final_pred_pixels", F.col("final_pixels").cast("double")))
    # A rule that does not allow a remaining mask asks for none.
    bounded = [r if r.get("allow_nonzero_final_mask") else {**r, "max_current_final_pred_pixels": 0} for r in rules]
    stage = "post_final_candidate_selector_rescue"
    after = selector(state.withColumn("current", noted), bounded, pool, stage)
    replaced = R.Item("current", FIELDS).has_flag(stage)
    return after.withColumn("final_pixels", F.when(replaced, CURRENT["mask_pixels"]).otherwise(F.col("final_pixels")))


STAGES = (
    "fallback", "rescue", "final_fallback", "exemption_tag", "secondary_rescue", "primary_recovery", "reticle_recovery",
    "fallback_rescue", "reticle_fill_rescue", "micro_line_pool", "colored_blob_pools", "selector_pools", "selector_rules",
    "arbiter", "external", "post_external_pools", "post_external_rules", "post_external_arbiter", "refine",
    "reject_final_fallback", "reject_source_area", "reject_source_area_score", "reject_pre_final_fallback",
    "reject_context", "reject_veto", "post_final_rules",
)


# Columns that no stage after the named one looks at; the state goes on without them.
LAST_USE = {"reticle_fill_rescue": WINNER_POOLS, "external": ("external",), "reject_context": ("context",)}


def run(
    state: DataFrame, pool: DataFrame, policy: dict,
    probability: Callable[[R.Item, R.Item], Column] | None = None,
    refined: DataFrame | Callable[[DataFrame], DataFrame] | None = None, last: str | None = None,
    context: Callable[[DataFrame], DataFrame] | None = None, externals: DataFrame | None = None,
) -> DataFrame:
    """Apply the stages a policy sets, in order, up to and including ``last``; ``pool`` is the table ``write_pool`` made,
    ``context`` gives a row ``(frame_id, context)`` for each of the frames it is called with (``features.context_map``),
    ``externals`` are those of ``initial_state``, if it didn't get them: the state carries them for their stage only."""
    written = None
    jobs: dict[str, Callable[[DataFrame, object], DataFrame]] = {
        "fallback": fallback,
        "rescue": rescue,
        "final_fallback": final_fallback,
        "exemption_tag": exemption_tag,
        "secondary_rescue": secondary_rescue,
        "primary_recovery": primary_recovery,
        "reticle_recovery": reticle_recovery,
        "fallback_rescue": fallback_rescue,
        "reticle_fill_rescue": reticle_fill_rescue,
        "micro_line_pool": micro_line_pool,
        "colored_blob_pools": colored_blob_pools,
        "selector_pools": open_pools,
        "selector_rules": lambda s, c: selector(s, c, pool),
        "arbiter": lambda s, c: arbiter(s, c, pool, probability),
        "external": lambda s, c: external(s if externals is None else with_externals(s, externals), c),
        "post_external_pools": open_pools,
        "post_external_rules": lambda s, c: selector(s, c, pool, "post_external_candidate_selector_rescue"),
        "post_external_arbiter": lambda s, c: arbiter(s, c, pool, probability, "post_external_rescue_arbiter"),
        "refine": lambda s, c: s if refined is None else refine(s, refined),
        "reject_final_fallback": reject_final_fallback,
        "reject_source_area": reject_source_area,
        "reject_source_area_score": reject_source_area_score,
        "reject_pre_final_fallback": reject_pre_final_fallback,
        "reject_context": lambda s, c: reject_context(s if context is None else _with_context(s, context, written, c), c),
        "reject_veto": reject_veto,
        "post_final_rules": lambda s, c: post_final(s, c, pool),
    }
    for name in STAGES:
        if name == "reject_final_fallback":
            state = begin_rejects(state)
        if name in policy:
            if name == "refine" and refined is not None:
                state = written = _settled(state)
            state = jobs[name](state, policy[name])
        if name == last:
            break
        state = state.drop(*LAST_USE.get(name, ()))
    return state


def report(state: DataFrame) -> DataFrame:
    """Flat winner row per frame: id, source, score, remaining pixels, flags and lineage."""
    pixels = F.col("final_pixels") if "final_pixels" in state.columns else CURRENT["mask_pixels"]
    return state.select(
        "frame_id", *[CURRENT[c].alias(c) for c in ("candidate_id", "candidate_source", "selector_pool", "score")],
        pixels.alias("final_pixels"), CURRENT["flags"].alias("flags"), "lineage",
    )
