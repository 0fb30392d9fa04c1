"""Queries of the parts that take rounds: clusters and trees of low stretch, multigrid, deflation, many candidates at once."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from pinweave.operators import euler, graphs, multigrid, overlay, spectral, trees
from pinweave.plans.extra import HEAP, query
from pinweave.plans.registry import CTES, GRAPH, _heap

MEAN = 2.0


@query(
    "WITH RECURSIVE " + f"""{CTES},\n{GRAPH}, b AS MATERIALIZED (SELECT u, v FROM g UNION SELECT v, u FROM g), r(c, v, hops) USING KEY (c, v) AS (SELECT u, u, 0 FROM (SELECT DISTINCT u FROM b)
  UNION SELECT r.c, b.v, min(r.hops + 1) FROM r JOIN b ON b.u = r.v LEFT JOIN recurring.r AS o ON o.c = r.c AND o.v = b.v WHERE o.hops IS NULL OR r.hops + 1 < o.hops GROUP BY r.c, b.v),
s AS (SELECT u AS c, round(-2.0::DOUBLE * ln((CAST('0x' || substr(md5('1|' || u), 1, 8) AS BIGINT) + 1)::DOUBLE / 4294967297.0::DOUBLE), 6) AS shift FROM (SELECT DISTINCT u FROM b))
SELECT v AS node, arg_min(c, (round(hops - shift, 6), c)) AS centre, min(round(hops - shift, 6)) AS d FROM r JOIN s USING (c) GROUP BY v"""
)
def low_diameter_clusters(h, scratch):
    """Clusters around shifted centres in the graph's hops; SQL takes every vertex's distance from every other."""
    graph = graphs.hypergraph_to_graph(h, order="pin")
    return trees.low_diameter(graph.select(F.col("u").alias("a"), F.col("v").alias("b"), F.lit(1.0).alias("length")), scratch, seed=1, mean=MEAN).select("node", "centre", "d")


@query(
    "WITH RECURSIVE {ctes}" + HEAP + f""",\n{GRAPH}, x AS (SELECT g.u, g.v, any_value(g.w) AS w, sum(a.v % 7 + 1) AS way FROM g JOIN an a ON (a.d = g.u OR a.d = g.v) AND a.v > 0
  WHERE (a.d = g.u AND NOT EXISTS (SELECT 1 FROM an o WHERE o.d = g.v AND o.v = a.v)) OR (a.d = g.v AND NOT EXISTS (SELECT 1 FROM an o WHERE o.d = g.u AND o.v = a.v)) GROUP BY g.u, g.v)
SELECT u, v, CAST(way AS DOUBLE) AS distance, round(way * w, 6) AS stretch FROM x"""
)
def tree_stretch(h, scratch):
    """How far a tree stretches the graph's links; SQL adds up the links above one end only."""
    tree = _heap(h, scratch)
    lengths = tree.where("parent IS NOT NULL").select("v", (F.col("v") % 7 + 1).cast("double").alias("length"))
    got = trees.stretches(scratch.keep(graphs.hypergraph_to_graph(h, order="pin"), "graph"), tree, lengths, scratch)
    return got.select("u", "v", F.round("distance", 6).alias("distance"), F.round("stretch", 6).alias("stretch"))


def _tree_facts(graph, links, scratch):
    """One row: vertices and links of a connected graph, links of its tree, vertices that the tree reaches, and the mean stretch."""
    n, m = (graph.select("u").union(graph.select("v")).distinct().count(), graph.count())
    root = int(graph.agg(F.min("u")).first()[0])
    tree = euler.rooted(links, root, scratch)
    above = links.select(F.col("u").alias("a"), F.col("v").alias("b"), (1 / F.col("w")).alias("length"))
    up = tree.where("parent IS NOT NULL").select("v", F.least("v", "parent").alias("a"), F.greatest("v", "parent").alias("b"))
    lengths = up.join(above.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "length"), ["a", "b"]).select("v", "length")
    mean = trees.stretches(graph, tree, lengths, scratch).agg(F.avg("stretch")).first()[0]
    return n, m, links.count(), tree.count(), mean


@query("SELECT n AS vertices, m AS links, n - 1 AS tree_links, n AS reached, true AS within FROM (SELECT count(*) AS m FROM g), (SELECT count(*) AS n FROM (SELECT u FROM g UNION SELECT v FROM g))".join(["WITH {ctes},\n" + GRAPH + " ", ""]))
def low_stretch_tree(h, scratch):
    """A low-stretch tree of the graph spans it, and stretches a link by 2 (ln n)^2 or less on average (4 at least)."""
    graph = scratch.keep(graphs.hypergraph_to_graph(h, order="pin"), "graph")
    links = scratch.keep(trees.low_stretch_forest(graph, scratch), "tree")
    n, m, t, reached, mean = _tree_facts(graph, links, scratch)
    row = (n, m, t, reached, bool(mean <= max(4.0, 2 * math.log(n) ** 2)))
    return h.vertices.sparkSession.createDataFrame([row], "vertices long, links long, tree_links long, reached long, within boolean")


# multigrid


def _level_sql(i: int) -> str:
    """Groups and coarser graph of level i from its links g{i}(u, v, w)."""
    return f"""b{i} AS MATERIALIZED (SELECT u, v, round(w, 6) AS w FROM g{i} UNION ALL SELECT v, u, round(w, 6) FROM g{i}),
h{i} AS (SELECT u AS a, arg_min(v, (-w, v)) AS b FROM b{i} GROUP BY u), t{i} AS MATERIALIZED (SELECT x.a, x.b FROM h{i} x JOIN h{i} y ON y.a = x.b WHERE NOT (y.b = x.a AND x.a < x.b)),
n{i} AS (SELECT a AS d, a AS v FROM h{i} UNION ALL SELECT n{i}.d, t{i}.b FROM n{i} JOIN t{i} ON t{i}.a = n{i}.v), m{i} AS MATERIALIZED (SELECT d, v FROM n{i}),
o{i} AS (SELECT m{i}.v, sum(w) AS vol FROM m{i} JOIN b{i} ON b{i}.u = m{i}.d GROUP BY 1),
k{i} AS (SELECT p.v, sum(w) AS ins FROM g{i} JOIN m{i} p ON p.d = g{i}.u JOIN m{i} q ON q.d = g{i}.v AND q.v = p.v GROUP BY 1),
z{i} AS (SELECT m{i}.d, o{i}.vol AS whole FROM m{i} JOIN o{i} USING (v) WHERE v NOT IN (SELECT a FROM t{i})),
f{i} AS MATERIALIZED (SELECT t{i}.a, t{i}.b, vol, vol - 2 * coalesce(ins, 0) AS bd, (vol - 2 * coalesce(ins, 0)) / least(vol, whole - vol) AS phi FROM t{i} JOIN o{i} ON o{i}.v = t{i}.a JOIN z{i} ON z{i}.d = t{i}.a LEFT JOIN k{i} ON k{i}.v = t{i}.a),
y{i} AS (SELECT a AS d, a AS v, 0 AS up FROM h{i} UNION ALL SELECT y{i}.d, f{i}.b, up + 1 FROM y{i} JOIN f{i} ON f{i}.a = y{i}.v AND phi >= 0.125),
e{i} AS (SELECT d, arg_max(v, up) AS top FROM y{i} GROUP BY d), r{i} AS MATERIALIZED (SELECT d AS v, min(d) OVER (PARTITION BY top) AS g FROM e{i}),
g{i + 1} AS MATERIALIZED (SELECT least(p.g, q.g) AS u, greatest(p.g, q.g) AS v, round(sum(w), 6) AS w FROM g{i} JOIN r{i} p ON p.v = g{i}.u JOIN r{i} q ON q.v = g{i}.v WHERE p.g <> q.g GROUP BY 1, 2)"""


LEVELS = "WITH RECURSIVE " + f"""{CTES},\n{GRAPH}, g0 AS MATERIALIZED (SELECT u, v, round(w, 6) AS w FROM g WHERE w >= 3),\n{_level_sql(0)},\n{_level_sql(1)}\n"""
WHOLE_LEVELS = LEVELS.replace(" FROM g WHERE w >= 3)", " FROM g)")


def _as_sql(c: str, digits: int):
    """A sum of weights of six decimals, rounded as SQL rounds doubles: scaled, then to the nearest whole number, so that halves fall alike."""
    scaled = F.round(c, 6) * F.lit(10.0**digits)
    return F.signum(scaled) * F.floor(F.abs(scaled) + 0.5) / F.lit(10.0**digits)


def _heavy_graph(h, scratch):
    """The links of weight 3 and more, which leave a graph of uneven density."""
    return scratch.keep(graphs.hypergraph_to_graph(h, order="pin").withColumn("w", F.round("w", 6)).where("w >= 3"), "graph")


@query(LEVELS + "SELECT 0 AS level, a AS u, b AS v, round(vol, 4) AS volume, round(bd, 4) AS boundary FROM f0 UNION ALL SELECT 1, a, b, round(vol, 4), round(bd, 4) FROM f1")
def forest_conductance(h, scratch):
    """Volumes and boundaries below every link of the heaviest-link forests of two levels."""
    levels = multigrid.hierarchy(_heavy_graph(h, scratch), scratch, bottom=1, most=2, digits=6)
    rows = [multigrid.conductances(x.graph, scratch.keep(multigrid.heaviest_links(x.graph), "forest"), scratch).select(F.lit(i).alias("level"), F.col("v").alias("u"), F.col("parent").alias("v"), _as_sql("volume", 4).alias("volume"), _as_sql("boundary", 4).alias("boundary")) for i, x in enumerate(levels) if x.links]
    return rows[0].union(rows[1]) if len(rows) > 1 else rows[0]


@query(WHOLE_LEVELS + "SELECT 0 AS level, u, v, round(w, 5) AS w FROM g0 UNION ALL SELECT 1, u, v, round(w, 5) FROM g1 UNION ALL SELECT 2, u, v, round(w, 5) FROM g2")
def multigrid_hierarchy(h, scratch):
    """Every link of three levels: the whole graph, the graph of its groups, and the graph of theirs, however few vertices a level saves."""
    levels = multigrid.hierarchy(graphs.hypergraph_to_graph(h, order="pin"), scratch, bottom=1, most=3, digits=6, stall=1.0)
    rows = [x.graph.select(F.lit(i).alias("level"), "u", "v", _as_sql("w", 5).alias("w")) for i, x in enumerate(levels)]
    out = rows[0]
    for r in rows[1:]:
        out = out.union(r)
    return out


@query(
    LEVELS.rstrip() + """,
d0 AS (SELECT u AS v, sum(w) + 1e-6 AS d FROM b0 GROUP BY u), x0 AS (SELECT d0.v, (v * 37) % 101 / 101.0::DOUBLE AS r, d FROM d0), c0 AS (SELECT v, r - avg(r) OVER () AS r, d FROM x0),
s0 AS MATERIALIZED (SELECT v, r, d, r / (2 * d) AS x FROM c0), l0 AS (SELECT s0.v, any_value(s0.r) - (any_value(s0.d) * any_value(s0.x) - sum(b0.w * o.x)) AS q FROM s0 JOIN b0 ON b0.u = s0.v JOIN s0 o ON o.v = b0.v GROUP BY s0.v),
q1 AS (SELECT g AS v, sum(q) AS q FROM l0 JOIN r0 USING (v) GROUP BY g), d1 AS (SELECT u AS v, sum(w) + 1e-6 AS d FROM (SELECT u, w FROM g1 UNION ALL SELECT v, w FROM g1) GROUP BY u), u1 AS (SELECT v, q / (2 * d) AS x FROM q1 JOIN d1 USING (v)),
s1 AS MATERIALIZED (SELECT s0.v, s0.r, s0.d, s0.x + coalesce(u1.x, 0) AS x FROM s0 JOIN r0 ON r0.v = s0.v LEFT JOIN u1 ON u1.v = r0.g),
s2 AS (SELECT s1.v, any_value(s1.x) + (any_value(s1.r) - (any_value(s1.d) * any_value(s1.x) - sum(b0.w * o.x))) / (2 * any_value(s1.d)) AS x FROM s1 JOIN b0 ON b0.u = s1.v JOIN s1 o ON o.v = b0.v GROUP BY s1.v)
SELECT v, round(x - avg(x) OVER () + 0.0, 8) + 0.0 AS x FROM s2"""
)
def multigrid_cycle(h, scratch):
    """One cycle of two levels with a Jacobi step on the lower one; SQL does the same sums."""
    levels = multigrid.hierarchy(_heavy_graph(h, scratch), scratch, bottom=1, most=2, digits=6)
    r = levels[0].diagonal.select("v", ((F.col("v") * 37) % 101 / F.lit(101.0)).alias("x"))
    old, multigrid.VISITS = multigrid.VISITS, 1
    try:
        return multigrid.TableCycle(levels, scratch, dense=False)(r).select("v", (F.round("x", 8) + 0.0).alias("x"))
    finally:
        multigrid.VISITS = old


# eigenvectors in batches


@query(
    """, ct AS (SELECT e, v % 8 AS c FROM pins GROUP BY 1, 2), cs AS (SELECT e, array_to_string(list_sort(list(c)), ',') AS s, count(*) AS n FROM ct GROUP BY e HAVING count(*) > 1),
ce AS (SELECT s, n, sum(hwt) / (floor(n / 2) * ceil(n / 2) / (n - 1)) AS k FROM cs JOIN edges USING (e) GROUP BY s, n), cp AS (SELECT s, n, k, CAST(unnest(string_split(s, ',')) AS BIGINT) AS c FROM ce),
w AS (SELECT v % 8 AS c, sum(vwt)::DOUBLE AS w FROM verts GROUP BY 1),
a AS (SELECT p.c AS i, q.c AS j, sum(CASE WHEN p.c = q.c THEN p.k * (1 - 1.0::DOUBLE / p.n) ELSE -p.k / p.n END) AS x FROM cp p JOIN cp q ON p.s = q.s GROUP BY 1, 2),
m AS MATERIALIZED (SELECT i, j, x / sqrt(p.w * q.w) AS x FROM a JOIN w p ON p.c = i JOIN w q ON q.c = j), m2 AS MATERIALIZED (SELECT p.i, q.j, sum(p.x * q.x) AS x FROM m p JOIN m q ON q.i = p.j GROUP BY 1, 2)
SELECT 1 AS power, round(sum(x), 4) AS total, 0.0::DOUBLE AS off FROM m WHERE i = j UNION ALL SELECT 2, round(sum(x), 4), 0.0 FROM m2 WHERE i = j UNION ALL SELECT 3, round(sum(p.x * q.x), 4), 0.0 FROM m2 p JOIN m q ON q.i = p.j AND q.j = p.i"""
)
def solve_batches(h, scratch):
    """All eigenvalues of eight supplier groups in batches of three, each held against those before: sums of their powers, which SQL has as traces, and how far the vectors are from B-orthonormal."""
    coarse = overlay.contract(h, h.vertices.select("v", F.pmod("v", F.lit(8)).alias("c")))
    coarse = type(h)(*[scratch.keep(t, "coarse") for t in (coarse.vertices, coarse.hyperedges, coarse.pins)])
    x = scratch.keep(spectral.solve_batches(coarse, scratch.keep(graphs.hypergraph_to_graph(coarse), "graph"), 7, 3, 40, scratch, tol=1e-9), "x")
    lam, held, _ = spectral.quality(coarse, x, 7)
    off = abs(round(float(abs(held - np.eye(7)).max()), 5))
    return h.vertices.sparkSession.createDataFrame([(p, round(float((lam**p).sum()), 4), off) for p in (1, 2, 3)], "power int, total double, off double")
