"""Queries for the policy cascade: the state after every stage, and the final report."""

from pyspark.sql import functions as F

from framegate.operators import cascade as C
from framegate.operators.features import context_map
from framegate.plans.q_features import CONTEXT_SQL, context
from framegate.plans.registry import query
from framegate.plans.views import SPARK_VIEWS

AT = ["row_key", "pos", "l_partkey", "l_suppkey"]
# The columns of a line that items are made of.
LINE_COLUMNS = [
    "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_extendedprice", "l_tax", "l_discount", "l_quantity",
]

POLICY = {
    "fallback": {"score_threshold": 0.55},
    "rescue": {"score_threshold": 0.35},
    "final_fallback": {"score_threshold": 0.3},
    "exemption_tag": {
        "exemptions": [
            {"source_group": "reticle_global", "min_ball_fill_fraction": 0.8, "max_score": 0.9},
            {"source": "white_blob", "required_flags": ["fallback"], "min_pred_pixels": 10},
        ]
    },
    "secondary_rescue": {"min_score": 0.4, "max_score": 0.7, "source": "table_hough", "min_ball_fill_fraction": 0.3},
    "primary_recovery": {
        "source": "white_blob", "min_score": 0.2, "max_score": 0.8, "candidate_group": "reticle_global",
        "min_primary_score": 0.1, "min_ball_fill_fraction": 0.1,
    },
    "reticle_recovery": {"min_score": 0.1, "max_score": 0.85, "min_primary_score": 0.2},
    "fallback_rescue": {"min_score": 0.0, "max_score": 0.8, "source_group": "reticle_global"},
    "reticle_fill_rescue": {
        "min_score": 0.1, "max_score": 0.9, "current_max_ball_fill_fraction": 0.7, "target_min_ball_fill_fraction": 0.2,
    },
    "micro_line_pool": {"max_current_score": 0.75},
    "colored_blob_pools": [
        {"current_source": "table_hough", "max_current_score": 0.9},
        {"current_source_group": "reticle_global", "current_required_flags": ["fallback"]},
    ],
    "selector_pools": [{"pool": "wide", "current_source": "line_endpoint", "min_current_pred_pixels": 5}],
    "selector_rules": [
        {
            "name": "pooled_blob", "candidate_source": "white_blob", "candidate_pools": ["micro_line_rescue", "colored_blob_rescue"],
            "current_source": "table_hough", "min_candidate_reach": 0.3, "selection_key": "ball_fill_fraction",
        },
        {
            "name": "same_pool", "current_source_group": "reticle_global", "candidate_source": "line_endpoint",
            "max_current_pred_pixels": 25, "min_candidate_score": 0.0, "selection_key": "pred_pixels", "selection_direction": "min",
        },
    ],
    "arbiter": [
        {"candidate_source_group": "reticle_global", "candidate_pools": ["micro_line_rescue"], "threshold": 0.62, "max_current_score": 0.9},
        {"candidate_pools": ["primary", "wide"], "min_candidate_score": -0.5, "threshold": 0.7, "current_source": "line_endpoint"},
    ],
    "external": {
        band: {
            "min_score": -1.0 + 0.15 * i, "max_score": 0.3 + 0.06 * i, "min_pred_area": 20, "min_prob_mean": 0.3,
            **({"source_group": "reticle_global"} if "reticle" in band else {}),
            **({"source_group": "table_hough", "current_max_ball_fill_fraction": 0.6} if "table" in band else {}),
        }
        for i, band in enumerate(C.EXTERNAL_BANDS)
    },
    "post_external_pools": [{"name": "wide", "current_source": "external_main_rescue"}],
    "post_external_rules": [
        {"candidate_source": "table_hough", "candidate_pool": "primary", "current_source_group": "external_main", "min_candidate_score": 0.5}
    ],
    "post_external_arbiter": {"candidate_pools": ["wide"], "threshold": 0.75, "max_current_score": 0.6},
    "refine": {},
    "reject_final_fallback": {"min_pred_pixels": 30, "max_score": 0.0},
    "reject_source_area": {
        "min_pred_pixels": {"reticle_global": 30, "reticle_global_1": 4, "white_blob": 5},
        "exemptions": {"reticle_global": [{"min_score": 0.8}], "white_blob": [{"max_pred_pixels": 5, "min_reach": 0.2}]},
    },
    "reject_source_area_score": {
        "line_endpoint": {"min_pred_pixels": 3, "max_score": 0.6, "exemptions": [{"min_ball_fill_fraction": 0.4}]},
        "reticle_global": {"min_pred_pixels": 2, "max_score": 0.5},
    },
    "reject_pre_final_fallback": {"max_score": 0.0},
    "reject_context": [
        {"name": "far", "source": "table_hough", "max_mask_white_fraction": 0.3, "min_min_candidate_center_distance": 2.0, "min_candidate_count": 2},
        {"name": "busy", "source_group": "external_main", "min_candidate_count": 3, "max_mask_fraction_near_any_candidate": 0.9},
    ],
    "reject_veto": [
        {"probability": "veto_p", "threshold": 0.8, "source_min_pred_pixels": {"reticle_global": 3}, "min_pred_pixels": 2},
        {
            "probability": "veto_q", "threshold": 0.6, "sources": ["table_hough", "line_endpoint"],
            "source_exemptions": {"table_hough": [{"min_score": 0.7, "max_pred_pixels": 4}]},
        },
    ],
    "post_final_rules": [
        {"candidate_source": "line_endpoint", "candidate_pool": "primary", "min_candidate_score": 0.3, "max_current_score": 0.8},
        {
            "candidate_source_group": "reticle_global", "candidate_pools": ["primary"], "allow_nonzero_final_mask": True,
            "max_current_final_pred_pixels": 2, "current_source": "external_main_rescue",
        },
    ],
}


def probability(current, candidate):
    """Fixed small scorer standing in for a trained arbiter."""
    x = (candidate["score"] - current["score"]) * 2.0 + candidate.number("ball_fill_fraction")
    x = x - 0.5 * F.coalesce(candidate.number("reach"), F.lit(0.0))
    return 1.0 / (1.0 + F.exp(-x))


def pool_items(t):
    """The items, made of lines that have moved to their frame and are in order already."""
    lines = t.lineitem.select(*LINE_COLUMNS)
    rows = t.spark.sql(SPARK_VIEWS["fx_pool"], lineitem=C.place(lines, "l_orderkey", ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]))
    fill, reach = ((F.lit(k), F.col(c)) for k, c in (("ball_fill_fraction", "candidate_iou"), ("reach", "reach")))
    alone = F.when(fill[1].isNotNull(), F.create_map(*fill)).when(reach[1].isNotNull(), F.create_map(*reach))
    both = F.when(fill[1].isNotNull() & reach[1].isNotNull(), F.create_map(*fill, *reach))
    features = both.otherwise(alone.otherwise(F.create_map().cast("map<string,double>")))
    return C.as_items(rows.withColumn("features", features), AT)


def externals(t):
    key = F.col("o_orderkey")
    bands = [
        F.struct(
            F.lit(b).alias("band"), (F.col("o_custkey") * (i + 3) % 100).alias("pred_area"),
            (F.col("o_custkey") * (i + 7) % 97 / 97.0).alias("prob_mean"),
        )
        for i, b in enumerate(C.EXTERNAL_BANDS)
    ]
    return t.orders.select(key.alias("frame_id"), F.inline(F.array(*bands)))


def refined_masks(pool, winners):
    """From the written pool, for the winners alone: all rows of a frame lie in one bucket of it, so none moves again."""
    item = F.col("candidate")
    flat = pool.select(
        "frame_id", item["candidate_id"].alias("candidate_id"), item["selector_pool"].alias("selector_pool"),
        item["pred_pixels"].alias("pred_pixels"), item["features"]["ball_fill_fraction"].alias("candidate_iou"),
    )
    rows = C.of_winners(flat, winners).groupBy("frame_id", "candidate_id", "selector_pool").agg(
        (F.max("pred_pixels") % 7).alias("refined_pixels"), F.max("candidate_iou").alias("bf")
    )
    return rows.select(
        "frame_id", "candidate_id", "selector_pool", "refined_pixels",
        F.create_map(F.lit("ball_fill_fraction"), F.col("bf") * 0.5).alias("refined_features"),
    )


def cascade(t, last=None):
    pool = C.write_pool(pool_items(t), AT, placed=True)
    frame = F.col("frame_id")
    state = C.initial_state(pool).withColumns(
        {
            "veto_p": frame * 37 % 100 / 100.0, "veto_q": frame * 53 % 100 / 100.0,
        }
    )
    return C.run(
        state, pool, POLICY, probability, lambda winners: refined_masks(pool, winners), last, lambda frames: context_map(context(t, frames)), externals(t)
    )


# ---- the same stages as layered SQL -------------------------------------------------------------------------

FIELDS = ("id", "src", "pool", "sc", "px", "mk", "bf", "rc", "fl", "pff")


def _item(base, **changes):
    values = {f: f"{base}.{f}" for f in FIELDS} | changes
    return "{" + ", ".join(f"'{f}': {v}" for f, v in values.items()) + "}"


def _grp(src):
    return f"CASE WHEN {src} LIKE 'reticle!_global%' ESCAPE '!' THEN 'reticle_global' ELSE {src} END"


def _flagged(base, flag):
    return f"list_distinct(list_append({base}.fl, '{flag}'))"


def _has(flag):
    return f"list_contains(cur.fl, '{flag}')"


def _starts(src, group):
    return f"({src} = '{group}' OR starts_with({src}, '{group}_'))"


class _Layers:
    def __init__(self):
        self.ctes, self.at = [], "s0"

    def add(self, condition, **replace):
        name = f"s{len(self.ctes) + 1}"
        new = ", ".join(f"CASE WHEN go THEN {v} ELSE {k} END AS {k}" for k, v in replace.items())
        self.ctes.append(f"{name} AS MATERIALIZED (SELECT * EXCLUDE (go) REPLACE ({new}) FROM (SELECT *, coalesce({condition}, false) AS go FROM {self.at}))")
        self.at = name

    def open(self, condition, pool):
        self.add(condition, pools=f"list_distinct(list_append(pools, '{pool}'))")

    def switch(self, condition, base, flag, keep=None, pool=None, **changes):
        item = _item(base, fl=_flagged(base, flag), **changes)
        self.add(f"{base} IS NOT NULL AND ({condition})", cur=item, **({keep: item} if keep else {}), **({"active": f"'{pool}'"} if pool else {}))

    def pick(self, pairs, flag, keep_pixels=False):
        """``pairs`` selects (frame_id, item, order columns) from the current layer joined to the pool."""
        self.ctes.append(f"m{len(self.ctes) + 1} AS MATERIALIZED (SELECT * FROM {self.at})")
        self.at = f"m{len(self.ctes)}"
        name = f"s{len(self.ctes) + 1}"
        item = _item("pick", fl=f"list_concat(pick.fl, ['{flag}'])")
        final = f", CASE WHEN pick IS NOT NULL THEN pick.px ELSE fin END AS fin" if keep_pixels else ""
        self.ctes.append(
            f"""{name} AS (SELECT * EXCLUDE (pick) REPLACE (CASE WHEN pick IS NOT NULL THEN {item} ELSE cur END AS cur{final}) FROM {self.at} LEFT JOIN ({pairs.replace("@", self.at)}) k USING (frame_id))"""
        )
        self.at = name


_P_ITEM = "{'id': p.cid, 'src': p.src, 'pool': p.pool, 'sc': p.sc, 'px': p.px, 'mk': p.px, 'bf': p.bf, 'rc': p.rc, 'fl': CAST([] AS VARCHAR[]), 'pff': CAST(NULL AS DOUBLE)}"
_OTHER = "NOT (p.cid = s.cur.id AND p.pool IS NOT DISTINCT FROM s.cur.pool)"
_PROB = "1 / (1 + exp(-((p.sc - s.cur.sc) * 2 + p.bf - 0.5 * coalesce(p.rc, 0))))"


def _selector_pairs(rules, pooled=None):
    """``pooled`` gives the flag of rules that name their pools; the others search the active pool."""

    def item(where):
        named = pooled and "list_contains(s.pools, p.pool)" in where
        return _P_ITEM.replace("CAST([] AS VARCHAR[])", f"['{pooled}']") if named else _P_ITEM

    parts = [
        f"SELECT s.frame_id, {item(where)} AS item, {i} AS rule_no, {pref} AS pref, p.rk, p.pos, p.lp, p.ls FROM @ s JOIN p ON s.frame_id = p.frame_id WHERE {_OTHER} AND {where}"
        for i, (where, pref) in enumerate(rules)
    ]
    return (
        f"SELECT frame_id, item AS pick FROM ({' UNION ALL '.join(parts)}) QUALIFY row_number() OVER (PARTITION BY frame_id ORDER BY rule_no, pref DESC, rk, pos, lp, ls) = 1"
    )


def _arbiter_pairs(configs):
    parts = [
        f"SELECT s.frame_id, {_P_ITEM} AS item, {i} AS cfg, {_PROB} AS pr, {t} AS th, p.rk, p.pos, p.lp, p.ls FROM @ s JOIN p ON s.frame_id = p.frame_id WHERE {_OTHER} AND list_contains(s.pools, p.pool) AND {where}"
        for i, (where, t) in enumerate(configs)
    ]
    best = f"SELECT * FROM ({' UNION ALL '.join(parts)}) QUALIFY row_number() OVER (PARTITION BY frame_id, cfg ORDER BY pr DESC, rk, pos, lp, ls) = 1"
    return f"SELECT frame_id, item AS pick FROM ({best}) WHERE pr >= th QUALIFY row_number() OVER (PARTITION BY frame_id ORDER BY cfg) = 1"


def cascade_sql(last):
    q = _Layers()
    group = _grp("cur.src")

    def fallback():
        low = "cur.sc < 0.55"
        q.open(f"{low} AND w_fallback IS NOT NULL", "fallback")
        q.add(f"NOT ({low})", w_fallback="NULL")
        q.switch(low, "w_fallback", "fallback", "w_fallback", "fallback")

    def rescue():
        q.open("cur.sc < 0.35 AND w_rescue IS NOT NULL", "rescue")
        q.switch("cur.sc < 0.35", "w_rescue", "rescue", None, "rescue")

    def final_fallback():
        q.switch("cur.sc < 0.3", "w_fallback", "final_fallback", "w_fallback", "fallback", pff="cur.sc")

    def exemption_tag():
        hit = f"({_starts('cur.src', 'reticle_global')} AND cur.bf >= 0.8 AND cur.sc <= 0.9) OR (cur.src = 'white_blob' AND {_has('fallback')} AND cur.px >= 10)"
        q.add(hit, cur=_item("cur", fl=_flagged("cur", "secondary_rescue_current_exemption")))

    def secondary_rescue():
        run = f"cur.sc >= 0.4 AND cur.sc < 0.7 AND cur.src = 'table_hough' AND NOT {_has('secondary_rescue_current_exemption')}"
        q.open(f"{run} AND w_secondary_rescue IS NOT NULL", "secondary_rescue")
        q.switch(f"{run} AND w_secondary_rescue.bf >= 0.3", "w_secondary_rescue", "secondary_rescue", None, "secondary_rescue")

    def primary_recovery():
        run = f"cur.src = 'white_blob' AND cur.sc >= 0.2 AND cur.sc < 0.8 AND {_grp('w_primary.src')} = 'reticle_global' AND w_primary.sc >= 0.1 AND w_primary.bf >= 0.1"
        q.switch(run, "w_primary", "primary_recovery", "w_primary", "primary")

    def reticle_recovery():
        run = f"{group} = 'reticle_global' AND cur.sc >= 0.1 AND cur.sc < 0.85 AND {_grp('w_primary.src')} = 'reticle_global' AND w_primary.sc >= 0.2"
        q.switch(run, "w_primary", "reticle_recovery", "w_primary", "primary")

    def fallback_rescue():
        run = f"{_has('fallback')} AND cur.sc >= 0 AND cur.sc < 0.8 AND {group} = 'reticle_global'"
        q.open(f"{run} AND w_fallback_rescue IS NOT NULL", "fallback_rescue")
        q.switch(f"{run} AND w_fallback_rescue.sc > cur.sc", "w_fallback_rescue", "fallback_rescue", None, "fallback_rescue")

    def reticle_fill_rescue():
        run = f"{_has('reticle_recovery')} AND {group} = 'reticle_global' AND cur.sc >= 0.1 AND cur.sc < 0.9 AND cur.bf < 0.7"
        q.open(f"{run} AND w_reticle_fill_rescue IS NOT NULL", "reticle_fill_rescue")
        q.switch(
            f"{run} AND {_grp('w_reticle_fill_rescue.src')} = 'reticle_global' AND w_reticle_fill_rescue.bf >= 0.2",
            "w_reticle_fill_rescue", "reticle_fill_rescue", None, "reticle_fill_rescue",
        )

    def micro_line_pool():
        q.open("cur.sc <= 0.75", "micro_line_rescue")

    def colored_blob_pools():
        q.open("cur.src = 'table_hough' AND cur.sc <= 0.9", "colored_blob_rescue")
        q.open(f"{_starts('cur.src', 'reticle_global')} AND {_has('fallback')}", "colored_blob_rescue")

    def selector_pools():
        q.open("cur.src = 'line_endpoint' AND cur.px >= 5", "wide")

    def selector_rules():
        rules = [
            (f"p.pool = s.active AND {_starts('s.cur.src', 'reticle_global')} AND p.src = 'line_endpoint' AND s.cur.px <= 25 AND p.sc >= 0", "CAST(-p.px AS DOUBLE)"),
            ("list_contains(s.pools, p.pool) AND p.pool IN ('micro_line_rescue', 'colored_blob_rescue') AND p.src = 'white_blob' AND s.cur.src = 'table_hough' AND p.rc >= 0.3", "p.bf"),
        ]
        q.pick(_selector_pairs(rules, "pooled_candidate_selector_rescue"), "candidate_selector_rescue")

    def arbiter():
        configs = [
            (f"{_starts('p.src', 'reticle_global')} AND p.pool = 'micro_line_rescue' AND s.cur.sc <= 0.9", 0.62),
            ("p.pool IN ('primary', 'wide') AND p.sc >= -0.5 AND s.cur.src = 'line_endpoint'", 0.7),
        ]
        q.pick(_arbiter_pairs(configs), "rescue_arbiter")

    def external():
        for i, (band, name) in enumerate(C.EXTERNAL_BANDS.items()):
            low, high = -1.0 + 0.15 * i, 0.3 + 0.06 * i
            a, pr = f"(ck * {i + 3} % 100)", f"(ck * {i + 7} % 97 / CAST(97 AS DOUBLE))"
            run = f"cur.sc >= CAST({low!r} AS DOUBLE) AND cur.sc < CAST({high!r} AS DOUBLE) AND {a} >= 20 AND {pr} >= 0.3"
            if "reticle" in band:
                run += f" AND {group} = 'reticle_global'"
            if "table" in band:
                run += f" AND {group} = 'table_hough' AND coalesce(cur.bf, 0) <= 0.6"
            flag = "external_rescue" if band == "main" else f"external_{band}_rescue"
            item = _item(
                "cur", id=f"'{name}'", src=f"'{name}'", pool="CAST(NULL AS VARCHAR)", sc=pr, px="CAST(NULL AS BIGINT)", mk=a,
                bf="CAST(NULL AS DOUBLE)", rc="CAST(NULL AS DOUBLE)", fl=f"['{flag}']", pff="CAST(NULL AS DOUBLE)",
            )
            q.add(run, cur=item)

    def post_external_pools():
        q.open("cur.src = 'external_main_rescue'", "wide")

    def post_external_rules():
        rules = [(f"list_contains(s.pools, p.pool) AND p.pool = 'primary' AND p.src = 'table_hough' AND {_starts('s.cur.src', 'external_main')} AND p.sc >= 0.5", "p.sc")]
        q.pick(_selector_pairs(rules, "pooled_post_external_candidate_selector_rescue"), "post_external_candidate_selector_rescue")

    def post_external_arbiter():
        q.pick(_arbiter_pairs([("p.pool = 'wide' AND s.cur.sc <= 0.6", 0.75)]), "post_external_rescue_arbiter")

    def refine():
        name = f"s{len(q.ctes) + 1}"
        item = _item("cur", mk="rp", bf="rbf * 0.5", rc="CAST(NULL AS DOUBLE)", fl=_flagged("cur", "final_refine"))
        q.ctes.append(
            f"""{name} AS (SELECT * EXCLUDE (rf, rid, rpool, rp, rbf) REPLACE (CASE WHEN rp > 0 THEN {item} ELSE cur END AS cur) FROM {q.at} LEFT JOIN
  (SELECT frame_id AS rf, cid AS rid, pool AS rpool, max(px) % 7 AS rp, max(bf) AS rbf FROM p GROUP BY ALL) r ON rf = frame_id AND rid = cur.id AND rpool = cur.pool)"""
        )
        q.at = name

    def begin():
        name = f"s{len(q.ctes) + 1}"
        q.ctes.append(f"{name} AS (SELECT *, coalesce(cur.mk, 0) AS size, coalesce(cur.mk, 0) AS fin FROM {q.at})")
        q.at = name

    def reject(condition, flag):
        q.add(condition, cur=_item("cur", fl=_flagged("cur", flag)), fin="0")

    def reject_final_fallback():
        reject(f"{group} = 'table_hough' AND {_has('final_fallback')} AND (size >= 30 OR cur.sc < 0)", "table_hough_final_fallback_reject")

    def reject_source_area():
        limit = f"CASE WHEN cur.src = 'reticle_global_1' THEN 4 WHEN cur.src = 'white_blob' THEN 5 WHEN {group} = 'reticle_global' THEN 30 END"
        exempt = f"coalesce({group} = 'reticle_global' AND cur.sc >= 0.8, false) OR coalesce(cur.src = 'white_blob' AND size <= 5 AND cur.rc >= 0.2, false)"
        reject(f"size >= {limit} AND NOT ({exempt})", "winner_source_area_reject")

    def reject_source_area_score():
        bad = f"(cur.src = 'line_endpoint' AND size >= 3 AND cur.sc < 0.6 AND NOT coalesce(cur.bf >= 0.4, false)) OR ({group} = 'reticle_global' AND size >= 2 AND cur.sc < 0.5)"
        reject(bad, "winner_source_area_score_reject")

    def reject_pre_final_fallback():
        reject("fin > 0 AND cur.pff <= 0", "pre_final_fallback_score_reject")

    def reject_context():
        name = f"s{len(q.ctes) + 1}"
        q.ctes.append(
            f"{name} AS (SELECT s.*, x.mask_white_fraction AS xw, x.candidate_count AS xn, x.min_candidate_center_distance AS xd, x.mask_fraction_near_any_candidate AS xf FROM {q.at} s LEFT JOIN context x ON x.frame_id = s.frame_id)"
        )
        q.at = name
        bad = f"(cur.src = 'table_hough' AND xw <= 0.3 AND xd >= 2 AND xn >= 2) OR ({_starts('cur.src', 'external_main')} AND xn >= 3 AND xf <= 0.9)"
        reject(f"fin > 0 AND ({bad})", "final_context_reject")

    def reject_veto():
        one = f"frame_id * 37 % 100 / CAST(100 AS DOUBLE) >= 0.8 AND fin >= CASE WHEN {group} = 'reticle_global' THEN 3 ELSE 2 END"
        two = "frame_id * 53 % 100 / CAST(100 AS DOUBLE) >= 0.6 AND cur.src IN ('table_hough', 'line_endpoint') AND NOT (cur.src = 'table_hough' AND cur.sc >= 0.7 AND fin <= 4)"
        reject(f"fin > 0 AND (({one}) OR ({two}))", "image_final_veto")

    def post_final_rules():
        rules = [
            ("p.src = 'line_endpoint' AND p.pool = 'primary' AND list_contains(s.pools, p.pool) AND p.sc >= 0.3 AND s.cur.sc <= 0.8 AND s.fin <= 0", "p.sc"),
            (f"{_starts('p.src', 'reticle_global')} AND p.pool = 'primary' AND list_contains(s.pools, p.pool) AND s.fin <= 2 AND s.cur.src = 'external_main_rescue'", "p.sc"),
        ]
        q.pick(_selector_pairs(rules, "pooled_post_final_candidate_selector_rescue"), "post_final_candidate_selector_rescue", keep_pixels=True)

    steps = locals()
    for stage in C.STAGES:
        if stage == "reject_final_fallback":
            begin()
        steps[stage]()
        if stage == last:
            break
    winners = ", ".join(
        f"arg_min({_P_ITEM}, (-sc, rk, pos, lp, ls)) FILTER (WHERE pool = '{w}') AS w_{w}" for w in C.WINNER_POOLS
    )
    base = f"""WITH p AS MATERIALIZED (SELECT frame_id, candidate_id AS cid, candidate_source AS src, selector_pool AS pool, score AS sc, pred_pixels AS px, candidate_iou AS bf, reach AS rc, row_key AS rk, pos, l_partkey AS lp, l_suppkey AS ls FROM fx_pool),
w AS (SELECT frame_id, {winners} FROM p GROUP BY frame_id),
s0 AS (SELECT w.*, w_primary AS cur, 'primary' AS active, ['primary'] AS pools, o_custkey AS ck FROM w LEFT JOIN orders ON o_orderkey = frame_id WHERE w_primary IS NOT NULL)"""
    pixels = "CAST(fin AS BIGINT)" if C.STAGES.index(last) >= C.STAGES.index("reject_final_fallback") else "CAST(cur.mk AS BIGINT)"
    if C.STAGES.index(last) >= C.STAGES.index("reject_context"):
        base = base.replace("WITH p AS", f"WITH {CONTEXT_SQL},\np AS", 1).replace("w AS (SELECT frame_id,", "best AS (SELECT frame_id,", 1).replace("FROM w LEFT", "FROM best LEFT", 1).replace("SELECT w.*", "SELECT best.*", 1)
    return (
        ",\n".join([base, *q.ctes])
        + f"\nSELECT frame_id, cur.id AS candidate_id, cur.src AS candidate_source, round(cur.sc, 9) AS score, {pixels} AS final_pixels, array_to_string(list_sort(cur.fl), ',') AS flags, array_to_string(list_sort(pools), ',') AS open_pools FROM {q.at}"
    )


IDS = {
    "E16_fallback": "fallback", "E17_rescue": "rescue", "E18_final_fallback": "final_fallback", "E19_exemption_tag": "exemption_tag",
    "E20_secondary_rescue": "secondary_rescue", "E21_primary_recovery": "primary_recovery", "E22_reticle_recovery": "reticle_recovery",
    "E23_fallback_rescue": "fallback_rescue", "E24_reticle_fill_rescue": "reticle_fill_rescue", "E25_micro_line_pool": "micro_line_pool",
    "E26_colored_blob_pools": "colored_blob_pools", "E27_selector_pools": "selector_pools", "E28_selector_rules": "selector_rules",
    "E29_arbiter": "arbiter", "E30_external_bands": "external", "E31_post_external": "post_external_arbiter", "E32_refine": "refine",
    "E33_reject_final_fallback": "reject_final_fallback", "E34_reject_source_area": "reject_source_area",
    "E35_reject_area_score": "reject_pre_final_fallback", "E36_reject_context_veto": "reject_veto", "E37_post_final": "post_final_rules",
}


def _register(name, stage):
    @query(name, cascade_sql(stage))
    def _(t):
        state = cascade(t, stage)
        pixels = F.col("final_pixels") if "final_pixels" in state.columns else F.col("current.mask_pixels")
        return state.select(
            "frame_id", F.col("current.candidate_id").alias("candidate_id"),
            F.col("current.candidate_source").alias("candidate_source"), F.round("current.score", 9).alias("score"),
            pixels.alias("final_pixels"), F.array_join(F.array_sort("current.flags"), ",").alias("flags"),
            F.array_join(F.array_sort("open_pools"), ",").alias("open_pools"),
        )


for _name, _stage in IDS.items():
    _register(_name, _stage)


@query(
    "policy_winner_summary",
    f"""SELECT candidate_source, count(*) AS frames, round(avg(score), 6) AS mean_score, count(*) FILTER (WHERE final_pixels > 0) AS with_mask FROM ({cascade_sql("post_final_rules")}) GROUP BY candidate_source""",
)
def _(t):
    rows = C.report(cascade(t))
    return rows.groupBy("candidate_source").agg(
        F.count("*").alias("frames"), F.round(F.avg("score"), 6).alias("mean_score"),
        F.count_if(F.col("final_pixels") > 0).alias("with_mask"),
    )
