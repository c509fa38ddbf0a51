"""Queries for pixel graphs, component filters and mask suppression."""

from pyspark.sql import functions as F

from framegate.operators import graph as G
from framegate.plans.q_spatial import circles
from framegate.plans.registry import query

KEYS = ["frame_id", "side"]

# A smaller label travels until none moves it; only pixels without a smaller neighbour start one.
_LABELS = """px AS (SELECT DISTINCT frame_id, side, x, y, y * 2147483648 + x AS k FROM {source}),
seed AS (SELECT p.* FROM px p WHERE NOT EXISTS (SELECT 1 FROM px q WHERE q.frame_id = p.frame_id AND q.side = p.side AND abs(q.x - p.x) <= 1 AND abs(q.y - p.y) <= 1 AND q.k < p.k)),
reach(frame_id, side, x, y, label) AS (SELECT frame_id, side, x, y, k FROM seed
  UNION SELECT p.frame_id, p.side, p.x, p.y, r.label FROM reach r JOIN px p ON p.frame_id = r.frame_id AND p.side = r.side AND abs(p.x - r.x) <= 1 AND abs(p.y - r.y) <= 1),
lab AS (SELECT frame_id, side, x, y, min(label) AS label FROM reach GROUP BY frame_id, side, x, y)"""
def broken(pixels):
    """All pixels, with a gap after every fourth column, so that the lines fall into several components."""
    return pixels.withColumn("x", F.col("x") + F.floor(F.col("x") / 4))


def labels_sql(source="(SELECT frame_id, side, x + x // 4 AS x, y FROM fx_pixels)"):
    return "WITH RECURSIVE " + _LABELS.replace("{source}", source)


@query("C1_connected_components", labels_sql() + " SELECT frame_id, side, x, y, label FROM lab")
def _(t):
    return G.pixel_components(broken(t.fx_pixels), KEYS)


@query(
    "C1_match_components",
    """WITH RECURSIVE e AS (SELECT o_custkey AS a, 1000000 + o_orderkey AS b FROM orders UNION SELECT o_custkey, o_custkey - o_custkey % 5 FROM orders),
both_ AS (SELECT a, b FROM e UNION SELECT b, a FROM e), v AS (SELECT DISTINCT a AS id FROM both_),
r(id, label) AS (SELECT id, id FROM v UNION SELECT both_.b, r.label FROM r JOIN both_ ON both_.a = r.id)
SELECT id, min(label) AS label FROM r GROUP BY id""",
)
def _(t):
    customer = F.col("o_custkey")
    others = F.array(F.col("o_orderkey") + 1_000_000, customer - customer % 5)
    edges = t.orders.select(F.lit(0).alias("graph"), customer.alias("a"), F.explode(others).alias("b"))
    vertices = edges.select("graph", F.col("a").alias("id")).unionAll(edges.select("graph", F.col("b").alias("id")))
    return G.connected_components(vertices, edges, ["graph"]).select("id", "label")


@query(
    "C2_degree_classes",
    """WITH px AS (SELECT DISTINCT frame_id, side, x, y FROM fx_pixels), d AS (SELECT p.frame_id, p.side, p.x, p.y, count(q.x) AS degree FROM px p LEFT JOIN px q ON q.frame_id = p.frame_id AND q.side = p.side
  AND abs(q.x - p.x) <= 1 AND abs(q.y - p.y) <= 1 AND NOT (q.x = p.x AND q.y = p.y) GROUP BY ALL)
SELECT frame_id, side, x, y, degree, CASE WHEN degree = 1 THEN 'endpoint' WHEN degree >= 3 THEN 'branch' WHEN degree = 2 THEN 'path' ELSE 'isolated' END AS class FROM d""",
)
def _(t):
    degrees = G.pixel_degrees(t.fx_pixels, KEYS)
    return degrees.withColumn("class", G.degree_class(F.col("degree")))


@query(
    "C2_branch_counts",
    """WITH px AS (SELECT DISTINCT frame_id, x, y FROM fx_pixels), d AS (SELECT p.frame_id, p.x, p.y, count(q.x) AS degree FROM px p LEFT JOIN px q ON q.frame_id = p.frame_id
  AND abs(q.x - p.x) <= 1 AND abs(q.y - p.y) <= 1 AND NOT (q.x = p.x AND q.y = p.y) GROUP BY ALL)
SELECT frame_id, count(*) AS pixels, count(*) FILTER (WHERE degree = 1) AS endpoints, count(*) FILTER (WHERE degree >= 3) AS branches FROM d GROUP BY frame_id""",
)
def _(t):
    return G.branch_counts(t.fx_pixels, ["frame_id"])


_SEEDS_SQL = """WITH RECURSIVE px AS (SELECT DISTINCT frame_id, x, y FROM fx_pixels WHERE side = 'gt'),
deg AS (SELECT p.frame_id, p.x, p.y, count(q.x) AS degree FROM px p LEFT JOIN px q ON q.frame_id = p.frame_id AND abs(q.x - p.x) <= 1 AND abs(q.y - p.y) <= 1 AND NOT (q.x = p.x AND q.y = p.y) GROUP BY ALL),
ball AS (SELECT p_partkey AS frame_id, p_partkey % 50 + p_size // 3 AS bx, p_partkey % 30 + 2 AS by_, greatest(4, p_size % 9) AS r FROM part),
seed AS (SELECT d.frame_id, d.x, d.y FROM deg d JOIN ball b USING (frame_id) QUALIFY row_number() OVER (PARTITION BY d.frame_id ORDER BY CASE WHEN degree < 3 THEN 1 ELSE 0 END, (d.x - bx) * (d.x - bx) + (d.y - by_) * (d.y - by_), d.y, d.x) = 1),
st AS (SELECT dx, dy, row_number() OVER (ORDER BY dy, dx) - 1 AS n FROM range(-1, 2) a(dx), range(-1, 2) b(dy) WHERE NOT (dx = 0 AND dy = 0)),
bfs(frame_id, x, y, hops, path) AS (SELECT frame_id, x, y, 0, '' FROM seed
  UNION ALL (SELECT p.frame_id, p.x, p.y, b.hops + 1, min(b.path || st.n) FROM bfs b JOIN st ON true JOIN px p ON p.frame_id = b.frame_id AND p.x = b.x + st.dx AND p.y = b.y + st.dy
    WHERE b.hops < 60 GROUP BY p.frame_id, p.x, p.y, b.hops)),
best AS (SELECT frame_id, x, y, hops, path FROM bfs QUALIFY row_number() OVER (PARTITION BY frame_id, x, y ORDER BY hops, path) = 1)"""


def balls(t):
    k, size = F.col("p_partkey"), F.col("p_size")
    return t.part.select(
        k.alias("frame_id"), (k % 50 + F.floor(size / 3)).alias("cx"), (k % 30 + 2).alias("cy"), (size % 9).alias("radius")
    )


@query("C3_shortest_paths", _SEEDS_SQL + " SELECT frame_id, x, y, hops, path FROM best")
def _(t):
    line = t.fx_pixels.filter("side = 'gt'").select("frame_id", "x", "y")
    points = balls(t).select("frame_id", F.col("cx").alias("px"), F.col("cy").alias("py"))
    return G.shortest_paths(line, G.seeds_near(line, points, ["frame_id"]), ["frame_id"])


@query(
    "C3_best_endpoint",
    _SEEDS_SQL + """, e AS (SELECT b.* FROM best b JOIN deg d ON d.frame_id = b.frame_id AND d.x = b.x AND d.y = b.y WHERE d.degree = 1),
pt AS (SELECT e.frame_id, e.x, e.y, e.hops, sqrt(CAST((o.x - bx) * (o.x - bx) + (o.y - by_) * (o.y - by_) AS DOUBLE)) AS dist, r FROM e JOIN best o ON o.frame_id = e.frame_id AND starts_with(e.path, o.path) JOIN ball ON ball.frame_id = e.frame_id),
sc AS (SELECT frame_id, x, y, hops, count(*) FILTER (WHERE dist <= r * CAST(0.9 AS DOUBLE)) AS overlap, min(dist) AS md, count(*) AS len FROM pt GROUP BY ALL)
SELECT frame_id, x, y, hops, overlap, round(md, 6) AS min_distance, len AS length FROM sc QUALIFY row_number() OVER (PARTITION BY frame_id ORDER BY overlap DESC, md, len DESC, y, x) = 1""",
)
def _(t):
    line = t.fx_pixels.filter("side = 'gt'").select("frame_id", "x", "y")
    best = G.best_endpoints(line, balls(t), ["frame_id"])
    return best.select("frame_id", "x", "y", "hops", "overlap", F.round("min_distance", 6).alias("min_distance"), "length")


@query(
    "C4_grow_from_seeds",
    labels_sql() + """ SELECT frame_id, side, x, y FROM lab WHERE (frame_id, side, label) IN (SELECT frame_id, side, label FROM lab WHERE (x * 3 + y) % 17 = 0)""",
)
def _(t):
    allowed = broken(t.fx_pixels)
    return G.grow_from_seeds(allowed, allowed.filter("(x * 3 + y) % 17 = 0"), KEYS)


@query(
    "A21_component_filter",
    labels_sql() + """, a AS (SELECT lab.frame_id, lab.side, label, count(*) AS area, count(*) FILTER (WHERE pow(greatest(abs(x - (lab.frame_id % 50 + p_size // 3)) - 2, 0), 2) + pow(greatest(abs(y - (lab.frame_id % 30 + 2)) - 2, 0), 2) <= pow(p_size % 9, 2)) AS touch
  FROM lab JOIN part ON p_partkey = lab.frame_id GROUP BY ALL),
b AS (SELECT *, area + 10000 * touch AS score FROM a WHERE area >= 3 QUALIFY row_number() OVER (PARTITION BY frame_id, side ORDER BY area + 10000 * touch DESC, label) = 1)
SELECT frame_id, side, label, area, score FROM b""",
)
def _(t):
    sides = t.spark.createDataFrame([("gt",), ("pred",)], "side string")
    discs = balls(t).crossJoin(F.broadcast(sides))  # two rows
    kept = G.component_filter(broken(t.fx_pixels), KEYS, 3, discs)
    return kept.select(*KEYS, "label", "area", "score").distinct()


@query("A32_prune_spurs")
def _(t):
    nub = t.part.filter("p_size > 12").select(
        F.col("p_partkey").alias("frame_id"), (F.col("p_partkey") % 50 + 6).alias("x"), (F.col("p_partkey") % 30 + 9).alias("y")
    )
    line = t.fx_pixels.filter("side = 'gt'").select("frame_id", "x", "y")
    return G.prune_spurs(line.unionByName(nub), ["frame_id"])


_DISCS_SQL = """d AS (SELECT DISTINCT frame_id, candidate_source, pos, l_partkey, l_suppkey, cx % 120 AS cx, cy % 60 AS cy, radius % 9 + 3 AS radius FROM fx_candidates WHERE frame_id IN (SELECT p_partkey FROM part)),
m AS (SELECT frame_id, cx, cy, radius, row_number() OVER (PARTITION BY frame_id ORDER BY pos, l_partkey, l_suppkey) AS rank FROM d),
px AS (SELECT frame_id, rank, cx + a.dx AS x, cy + b.dy AS y FROM m, range(-12, 13) a(dx), range(-12, 13) b(dy) WHERE a.dx * a.dx + b.dy * b.dy <= radius * radius)"""


@query(
    "W10_suppress_masks",
    f"""WITH RECURSIVE {_DISCS_SQL}, sz AS (SELECT frame_id, rank, count(*) AS area FROM px GROUP BY ALL),
i AS (SELECT a.frame_id, a.rank AS r1, b.rank AS r2, count(*) AS n FROM px a JOIN px b ON a.frame_id = b.frame_id AND a.x = b.x AND a.y = b.y AND a.rank < b.rank GROUP BY ALL),
c AS (SELECT i.frame_id, r1, r2 FROM i JOIN sz s1 ON s1.frame_id = i.frame_id AND s1.rank = r1 JOIN sz s2 ON s2.frame_id = i.frame_id AND s2.rank = r2 WHERE n / CAST(s1.area + s2.area - n AS DOUBLE) >= 0.05),
w(frame_id, rank, kept) AS (SELECT frame_id, CAST(1 AS BIGINT), [CAST(1 AS BIGINT)] FROM m WHERE rank = 1
  UNION ALL SELECT m.frame_id, m.rank, CASE WHEN EXISTS (SELECT 1 FROM c WHERE c.frame_id = m.frame_id AND c.r2 = m.rank AND list_contains(w.kept, c.r1)) THEN w.kept ELSE list_append(w.kept, m.rank) END FROM w JOIN m ON m.frame_id = w.frame_id AND m.rank = w.rank + 1),
l AS (SELECT frame_id, kept FROM w QUALIFY row_number() OVER (PARTITION BY frame_id ORDER BY rank DESC) = 1)
SELECT frame_id, unnest(kept[1:3]) AS rank FROM l""",
)
def _(t):
    discs = circles(t).distinct()
    from pyspark.sql import Window

    order = Window.partitionBy("frame_id").orderBy("pos", "l_partkey", "l_suppkey")
    ranked = discs.withColumn("rank", F.row_number().over(order).cast("bigint")).withColumn("mask_id", F.col("rank"))
    r = F.col("radius")
    steps = F.sequence(-r, r)
    masks = ranked.withColumn("dx", F.explode(steps)).withColumn("dy", F.explode(steps)).filter("dx * dx + dy * dy <= radius * radius")
    pixels = masks.select("frame_id", "mask_id", (F.col("cx") + F.col("dx")).alias("x"), (F.col("cy") + F.col("dy")).alias("y"))
    kept = G.suppress_masks(pixels, ranked.select("frame_id", "mask_id", "rank"), 0.05, 3)
    return kept.select("frame_id", "rank")
