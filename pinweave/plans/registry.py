"""Queries of the hypergraph engine by name, each with the SQL that must give the same rows.

Two hypergraphs are read from the tables: orders and their suppliers (weighted by
order priority, some suppliers fixed by nation) and orders and their parts.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pinweave.functions.stats import numeric_stats
from pinweave.model import Hypergraph, PartitionConfig, from_table, modulo_partition
from pinweave.operators import cuts, euler, graphs, incidence, islands, metrics, multigrid, overlay, projection, spectral, trees
from pinweave.operators.ordered import dense_ids
from pinweave.plans import engine
from pinweave.runtime import Scratch

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

CTES = """pins AS (SELECT DISTINCT l_orderkey AS e, l_suppkey AS v FROM lineitem),
edges AS (SELECT o_orderkey AS e, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS hwt FROM orders WHERE o_orderkey IN (SELECT e FROM pins)),
verts AS (SELECT s_suppkey AS v, coalesce(n, 1) AS vwt, CASE s_nationkey WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE -1 END AS fixed
  FROM supplier LEFT JOIN (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_suppkey = s_suppkey),
pp AS (SELECT DISTINCT l_orderkey AS e, l_partkey AS v FROM lineitem),
sz AS (SELECT e, count(*) AS size FROM pins GROUP BY e)"""


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def suppliers_of_orders(spark, sf_dir) -> Hypergraph:
    lines = table(spark, sf_dir, "lineitem")
    hwt = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("e"), F.substring("o_orderpriority", 1, 1).cast("long").alias("hwt"))
    count = lines.groupBy(F.col("l_suppkey").alias("v")).agg(F.count("*").alias("n"))
    fixed = F.when(F.col("s_nationkey") == 0, 0).when(F.col("s_nationkey") == 1, 1).otherwise(-1)
    verts = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("v"), fixed.alias("fixed")).join(count, "v", "left")
    return from_table(lines, "l_orderkey", "l_suppkey", hwt, verts.select("v", F.coalesce("n", F.lit(1)).alias("vwt"), "fixed"))


def parts_of_orders(spark, sf_dir) -> Hypergraph:
    return from_table(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_partkey")


def query(sql: str | None = None, plain: bool = False):
    """Register a function of (hypergraph, scratch), or with ``plain`` of (spark, folder, scratch), under its name."""

    def add(f):
        def run(spark, sf_dir):
            scratch = Scratch(spark, f.__name__)
            return f(spark, sf_dir, scratch) if plain else f(suppliers_of_orders(spark, sf_dir), scratch)

        QUERIES[f.__name__] = run
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql if sql.lstrip().upper().startswith("WITH RECURSIVE") or "{plain}" in sql else f"WITH {CTES}\n{sql}"
            ORACLE_SQL[f.__name__] = ORACLE_SQL[f.__name__].replace("{ctes}", CTES).replace("{plain}", "")
        return f

    return add


@query("SELECT v, count(*) AS degree, CAST(sum(hwt) AS BIGINT) AS wdeg FROM pins JOIN edges USING (e) GROUP BY v")
def hg_degree_stats(h, scratch):
    return metrics.weighted_degrees(h)


@query("SELECT size, count(*) AS edges FROM sz GROUP BY size")
def hg_edge_sizes(h, scratch):
    return incidence.edge_sizes(h).groupBy("size").agg(F.count("*").alias("edges"))


@query("SELECT max(size) AS max_size FROM sz")
def hg_max_edge_size(h, scratch):
    return incidence.max_edge_size(h)


@query("SELECT e, row_number() OVER (ORDER BY e) - 1 AS new_id, size FROM sz WHERE size > 1")
def hg_drop_singletons(h, scratch):
    kept = incidence.drop_single_pin_edges(h)
    return incidence.edge_sizes(kept).join(incidence.renumber_edges(kept, scratch), "e").select("e", "new_id", "size")


@query("SELECT CAST(coalesce(sum(hwt), 0) AS BIGINT) AS cutsize, count(*) AS edges FROM edges WHERE e IN (SELECT e FROM pins GROUP BY e HAVING min(v % 4) <> max(v % 4))")
def cutsize_mod4(h, scratch):
    return metrics.cut_size(h, modulo_partition(h.vertices, 4))


REGIONS = "SELECT s_suppkey AS v, n_regionkey AS part FROM supplier JOIN nation ON s_nationkey = n_nationkey"


@query(f"SELECT CAST(coalesce(sum(hwt), 0) AS BIGINT) AS cutsize, count(*) AS edges FROM edges WHERE e IN (SELECT e FROM pins JOIN ({REGIONS}) USING (v) GROUP BY e HAVING min(part) <> max(part))", plain=True)
def cutsize_region(spark, sf_dir, scratch):
    part = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return metrics.cut_size(suppliers_of_orders(spark, sf_dir), part.select(F.col("s_suppkey").alias("v"), F.col("n_regionkey").alias("part")))


@query("SELECT CAST(v % 4 AS INTEGER) AS part, CAST(sum(vwt) AS BIGINT) AS weight FROM verts GROUP BY 1")
def part_balance(h, scratch):
    return metrics.part_weights(h, modulo_partition(h.vertices, 4), 4)


LIMITS = "SELECT CAST(greatest(floor(sum(vwt)::DOUBLE * (100.0::DOUBLE / 4 - 2) / 100.0), 0) AS BIGINT) AS min_cap, CAST(ceil(sum(vwt)::DOUBLE * (100.0::DOUBLE / 4 + 2) / 100.0) AS BIGINT) AS max_cap FROM verts"


@query(LIMITS)
def balance_limits(h, scratch):
    return metrics.balance_limits(h, 4, 2)


@query(f"SELECT CAST(sum(greatest(min_cap - w, 0) ** 2 + greatest(w - max_cap, 0) ** 2) AS BIGINT) AS penalty FROM (SELECT v % 4 AS p, sum(vwt) AS w FROM verts GROUP BY 1), ({LIMITS})")
def balance_penalty(h, scratch):
    return metrics.balance_penalty(h, modulo_partition(h.vertices, 4), 4, 2)


@query("SELECT e FROM pins GROUP BY e HAVING min(v % 4) <> max(v % 4)")
def cut_edges(h, scratch):
    return metrics.cut_edges(h, modulo_partition(h.vertices, 4))


@query("SELECT CAST(sum(vwt) AS BIGINT) AS total FROM verts")
def total_vertex_weight(h, scratch):
    return metrics.total_vertex_weight(h)


@query("SELECT CAST(sum(hwt) AS BIGINT) AS weight FROM edges WHERE e IN (SELECT e FROM pins GROUP BY e HAVING min(v % 4) <> max(v % 4))")
def cut_edge_weight(h, scratch):
    return metrics.edge_weight_sum(h, metrics.cut_edges(h, modulo_partition(h.vertices, 4)))


def _cut(k):
    return f"SELECT e FROM pins GROUP BY e HAVING min(v % {k}) <> max(v % {k})"


def _two_cuts(h):
    return [metrics.cut_edges(h, modulo_partition(h.vertices, k)) for k in (2, 3)]


@query(f"{_cut(2)} UNION {_cut(3)}")
def cut_union(h, scratch):
    return incidence.union_distinct(*_two_cuts(h))


@query(f"{_cut(2)} INTERSECT {_cut(3)}")
def cut_intersect(h, scratch):
    return incidence.ordered_intersection(*_two_cuts(h), "e")


@query(f"{_cut(2)} EXCEPT {_cut(3)}")
def cut_except(h, scratch):
    return incidence.ordered_difference(*_two_cuts(h), "e")


@query("SELECT l_suppkey AS v, min(l_orderkey) AS first_e FROM lineitem GROUP BY 1", plain=True)
def ordered_distinct(spark, sf_dir, scratch):
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("v"), F.col("l_orderkey").alias("first_e"))
    return incidence.ordered_distinct(lines, "v", "first_e")


@query("SELECT DISTINCT e FROM pins JOIN verts USING (v) WHERE fixed >= 0")
def incident_edges_fixed(h, scratch):
    return incidence.incident_edges(h, h.vertices.where("fixed >= 0"))


@query(f"SELECT DISTINCT v FROM pins WHERE e IN (SELECT e FROM sz WHERE size = (SELECT max(size) FROM sz))")
def incident_vertices_largest(h, scratch):
    sizes = incidence.edge_sizes(h)
    return incidence.incident_vertices(h, sizes.join(F.broadcast(sizes.agg(F.max("size").alias("size"))), "size"))


@query("SELECT e, v FROM pins WHERE v NOT IN (SELECT v FROM verts WHERE fixed >= 0)")
def mobile_pins(h, scratch):
    return incidence.mobile_pins(h, incidence.sides_from_fixed(h)).select("e", "v")


@query("""SELECT e, CASE WHEN bool_or(fixed = 0) AND bool_or(fixed = 1) THEN '01' WHEN bool_or(fixed = 0) THEN '0' WHEN bool_or(fixed = 1) THEN '1' ELSE 'free' END AS forced
FROM pins JOIN verts USING (v) GROUP BY e""")
def forced_edges(h, scratch):
    return incidence.forced_edges(h, incidence.sides_from_fixed(h))


@query("SELECT v, fixed, CAST(v % 2 AS INTEGER) AS part FROM verts WHERE fixed >= 0 AND v % 2 <> fixed")
def fixed_violations(h, scratch):
    return metrics.fixed_violations(h, modulo_partition(h.vertices, 2))


LABELLINGS = """lb AS (SELECT 'modulo' AS kind, v, CAST(v % 3 AS INTEGER) AS part FROM verts UNION ALL SELECT 'gaps', v, CAST(v % 3 AS INTEGER) FROM verts WHERE v % 10 <> 3
UNION ALL SELECT 'outside', v, CAST(CASE WHEN v % 7 = 0 THEN 5 ELSE v % 3 END AS INTEGER) FROM verts UNION ALL SELECT 'held', v, CAST(CASE WHEN fixed >= 0 THEN fixed ELSE v % 2 END AS INTEGER) FROM verts),
kd AS (SELECT DISTINCT kind FROM lb)"""


@query("{plain}WITH " + CTES + ",\n" + LABELLINGS + """ SELECT kind, bool_and(part IS NOT NULL) AS complete, count(DISTINCT part) FILTER (WHERE part BETWEEN 0 AND 2) = 3 AS all_parts, NOT bool_or(fixed >= 0 AND coalesce(part, -1) <> fixed) AS fixed_ok,
bool_and(coalesce(part BETWEEN 0 AND 2, false)) AS labels_ok FROM kd CROSS JOIN verts LEFT JOIN lb USING (kind, v) GROUP BY kind""")
def partition_checks(h, scratch):
    """The four predicates on a plain labelling, one with gaps, one with labels outside, and one that holds fixed vertices but leaves a part out."""
    v, third = F.col("v"), (F.col("v") % 3).cast("int")
    held = F.when(F.col("fixed") >= 0, F.col("fixed")).otherwise(v % 2).cast("int")
    kinds = {"modulo": h.vertices.select("v", third.alias("part")), "gaps": h.vertices.where("v % 10 <> 3").select("v", third.alias("part")), "outside": h.vertices.select("v", F.when(v % 7 == 0, 5).otherwise(third).alias("part")), "held": h.vertices.select("v", held.alias("part"))}
    return reduce(DataFrame.union, [metrics.checks(h, part, 3).select(F.lit(kind).alias("kind"), "complete", "all_parts", "fixed_ok", "labels_ok") for kind, part in kinds.items()])


@query("SELECT v, CAST(CASE WHEN v % 4 = 2 THEN 0 ELSE 1 END AS TINYINT) AS side FROM verts")
def one_vs_rest(h, scratch):
    return incidence.one_vs_rest(modulo_partition(h.vertices, 4), 2)


@query("""SELECT v, CAST(dense_rank() OVER (ORDER BY f) - 1 AS INTEGER) AS part FROM (SELECT v, min(v) OVER (PARTITION BY (v * 7 + 3) % 5) AS f FROM verts)""")
def compact_labels(h, scratch):
    return metrics.compact_labels(h.vertices.select("v", ((F.col("v") * 7 + 3) % 5).cast("int").alias("part")))


REACH = """lk AS MATERIALIZED (SELECT DISTINCT a.v AS a, b.v AS b FROM {p} a JOIN {p} b ON a.e = b.e AND a.v <> b.v AND a.e NOT IN ({cut})),
r AS (SELECT DISTINCT v AS x, v AS c FROM {vs} UNION SELECT lk.b, r.c FROM r JOIN lk ON lk.a = r.x),
comp AS (SELECT v, dense_rank() OVER (ORDER BY root) - 1 AS comp FROM (SELECT x AS v, min(c) AS root FROM r GROUP BY x))"""


def _reach(p: str, vs: str, cut: str) -> str:
    return "WITH RECURSIVE {ctes},\n" + REACH.replace("{p}", p).replace("{vs}", vs).replace("{cut}", cut) + "\n"


@query(_reach("pins", "verts", "SELECT -1") + "SELECT v, comp FROM comp")
def components(h, scratch):
    return islands.numbered(islands.components(h, scratch), scratch)


CUT24 = "SELECT e FROM pp GROUP BY e HAVING min(v % 2) <> max(v % 2) OR min(v % 4) <> max(v % 4)"


@query(_reach("pp", "pp", CUT24) + "SELECT v, comp AS c FROM comp", plain=True)
def overlay_clusters(spark, sf_dir, scratch):
    h = parts_of_orders(spark, sf_dir)
    return overlay.clusters(h, [modulo_partition(h.vertices, 2), modulo_partition(h.vertices, 4)], scratch)


@query(_reach("pp", "pp", CUT24) + "SELECT v, row_number() OVER (ORDER BY v) - 1 AS new_id FROM comp WHERE comp = (SELECT comp FROM comp GROUP BY comp ORDER BY count(*) DESC, comp LIMIT 1)", plain=True)
def main_component(spark, sf_dir, scratch):
    h = parts_of_orders(spark, sf_dir)
    cut = incidence.union_distinct(*[metrics.cut_edges(h, modulo_partition(h.vertices, k)) for k in (2, 4)])
    h = h.with_(pins=h.pins.join(cut, "e", "left_anti"))
    main = islands.main_component(h, islands.numbered(islands.components(h, scratch), scratch))
    return dense_ids(main.vertices, "v", scratch)


CONTRACT = "cs AS (SELECT e, array_to_string(list_sort(list_distinct(list(v // 3))), ',') AS pinset, count(DISTINCT v // 3) AS n FROM pins GROUP BY e)"


@query("{plain}WITH " + CTES + ",\n" + CONTRACT + " SELECT pinset, CAST(sum(hwt) AS BIGINT) AS hwt FROM cs JOIN edges USING (e) WHERE n > 1 GROUP BY pinset")
def contract(h, scratch):
    return overlay.contracted_sets(h, h.vertices.select("v", F.floor(F.col("v") / 3).cast("long").alias("c")))


@query("SELECT v // 3 AS c, CAST(sum(vwt) AS BIGINT) AS vwt, coalesce(arg_max(fixed, v) FILTER (WHERE fixed >= 0), -1) AS fixed FROM verts GROUP BY 1")
def contract_vertices(h, scratch):
    return overlay.contract(h, h.vertices.select("v", F.floor(F.col("v") / 3).cast("long").alias("c"))).vertices.withColumnRenamed("v", "c")


@query("SELECT v, CAST((v // 3) % 2 AS INTEGER) AS part FROM verts")
def uncontract(h, scratch):
    cl = h.vertices.select("v", F.floor(F.col("v") / 3).cast("long").alias("c"))
    return overlay.uncontract(cl, cl.select(F.col("c").alias("v")).distinct().select("v", (F.col("v") % 2).cast("int").alias("part")))


@query("SELECT v // 3 AS v, CAST(min_by(v % 4, v) AS INTEGER) AS part FROM verts GROUP BY 1")
def contract_partition(h, scratch):
    cl = h.vertices.select("v", F.floor(F.col("v") / 3).cast("long").alias("c"))
    return overlay.onto_clusters(cl, modulo_partition(h.vertices, 4))


SMALL = """sm AS (SELECT a.v AS u, b.v AS v, hwt * CASE size WHEN 2 THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END AS w
  FROM pins a JOIN pins b ON a.e = b.e AND a.v < b.v JOIN sz ON sz.e = a.e JOIN edges ON edges.e = a.e WHERE size IN (2, 3))"""
CYCLE = """ld AS (SELECT e, v AS a, lead(v) OVER (PARTITION BY e ORDER BY v) AS b, first(v) OVER (PARTITION BY e ORDER BY v) AS f FROM pins),
cy AS (SELECT least(a, coalesce(b, f)) AS u, greatest(a, coalesce(b, f)) AS v, hwt / (2 * (floor(size / 2) * ceil(size / 2) / (size - 1))) AS w
  FROM ld JOIN sz USING (e) JOIN edges USING (e) WHERE size >= 4)"""
GRAPH = f"{SMALL},\n{CYCLE},\ng AS (SELECT u, v, sum(w) AS w FROM (SELECT * FROM sm UNION ALL SELECT * FROM cy) GROUP BY u, v)"


@query("{plain}WITH " + f"{CTES},\n{SMALL} SELECT u, v, round(sum(w), 6) AS w FROM sm GROUP BY u, v")
def graph_small_edges(h, scratch):
    return graphs.undirected(graphs.small_edge_links(h)).withColumn("w", F.round("w", 6))


@query("{plain}WITH " + f"{CTES},\n{GRAPH} SELECT u, v, round(w, 6) AS w FROM g")
def graph_cycle_pinorder(h, scratch):
    return graphs.hypergraph_to_graph(h, order="pin").withColumn("w", F.round("w", 6))


@query("{plain}WITH " + f"{CTES},\n{GRAPH} SELECT u, round(count(*) + 1e-6, 6) AS diag, round(-sum(w), 6) AS offsum FROM (SELECT u, w FROM g UNION ALL SELECT v, w FROM g) GROUP BY u")
def graph_laplacian_rowsum(h, scratch):
    return graphs.laplacian_rows(graphs.hypergraph_to_graph(h, order="pin")).select("u", F.round("diag", 6).alias("diag"), F.round("offsum", 6).alias("offsum"))


@query("{plain}WITH " + f"{CTES},\n{GRAPH}, b AS (SELECT u, v, w FROM g UNION ALL SELECT v, u, w FROM g) SELECT u AS row, round(1e-6 + count(*) + sum(CASE WHEN (u + v) % 29 = 0 THEN w ELSE -w END), 4) AS total, bool_or((u + v) % 29 = 0 AND w > 0) AS dominated FROM b GROUP BY u")
def laplacian_row_sums(h, scratch):
    """Of the Laplacian with some entries' signs turned."""
    off = (F.col("row") != F.col("col")) & ((F.col("row") + F.col("col")) % 29 == 0)
    matrix = graphs.laplacian(graphs.hypergraph_to_graph(h, order="pin")).withColumn("val", F.when(off, -F.col("val")).otherwise(F.col("val")))
    return graphs.row_sums(matrix).withColumn("total", F.round("total", 4))


@query("{plain}WITH " + f"{CTES},\n{GRAPH}, b AS (SELECT u, v, w FROM g UNION ALL SELECT v, u, w FROM g) SELECT v AS col, arg_min(u, (-round(w, 6), u)) AS row, round(min(-w), 6) AS val FROM b GROUP BY v")
def column_minima(h, scratch):
    off = graphs.laplacian(graphs.hypergraph_to_graph(h, order="pin")).where("row <> col").withColumn("val", F.round("val", 6))
    return graphs.column_minima(off)


@query("{plain}WITH " + f"{CTES},\n{GRAPH}, d AS (SELECT u, count(*) AS degree FROM (SELECT u FROM g UNION ALL SELECT v FROM g) GROUP BY u) SELECT u, degree, CAST(sum(degree) OVER (ORDER BY u) AS BIGINT) AS upto FROM d")
def degree_prefix_sums(h, scratch):
    return graphs.degrees_upto(graphs.hypergraph_to_graph(h, order="pin"), scratch)


XY = "(v * 37) % 101 / 101.0::DOUBLE"
XZ = "(v * 53) % 97 / 97.0::DOUBLE"


def _xy(h):
    v = F.col("v")
    return h.vertices.select("v", ((v * 37) % 101 / F.lit(101.0)).alias("x0"), ((v * 53) % 97 / F.lit(97.0)).alias("x1"))


def _embedded(h):
    return _xy(h).select("v", F.array("x0", "x1").alias("x"))


@query("{plain}WITH " + f"{CTES},\n{GRAPH}, x AS (SELECT v, {XY} AS x0, {XZ} AS x1 FROM verts) SELECT g.u, g.v, round(abs(a.x0 - b.x0) + abs(a.x1 - b.x1), 6) AS w FROM g JOIN x a ON a.v = g.u JOIN x b ON b.v = g.v")
def reweight_l1(h, scratch):
    return graphs.reweight(graphs.hypergraph_to_graph(h, order="pin"), _embedded(h)).withColumn("w", F.round("w", 6))


@query("{plain}WITH " + f"{CTES},\n{GRAPH}, x AS (SELECT v, {XY} AS x0, {XZ} AS x1 FROM verts) SELECT g.u, g.v, round((CASE WHEN a.x0 = b.x0 THEN 1e9 ELSE 1 / ((a.x0 - b.x0) * (a.x0 - b.x0)) END + CASE WHEN a.x1 = b.x1 THEN 1e9 ELSE 1 / ((a.x1 - b.x1) * (a.x1 - b.x1)) END) / 1e3, 4) AS w FROM g JOIN x a ON a.v = g.u JOIN x b ON b.v = g.v")
def reweight_lst(h, scratch):
    return graphs.reweight(graphs.hypergraph_to_graph(h, order="pin"), _embedded(h), lst=True).withColumn("w", F.round(F.col("w") / 1e3, 4))


@query("{plain}WITH " + f"""{CTES}, x AS (SELECT v, {XY} AS x0, {XZ} AS x1 FROM verts),
m AS (SELECT e, avg(x0) AS m0, avg(x1) AS m1, any_value(hwt) / (floor(count(*) / 2) * ceil(count(*) / 2) / (count(*) - 1)) AS c FROM pins JOIN x USING (v) JOIN edges USING (e) GROUP BY e HAVING count(*) > 1)
SELECT x.v, round(coalesce(sum(c * (x0 - m0)), 0) + 0.0, 5) AS y0, round(coalesce(sum(c * (x1 - m1)), 0) + 0.0, 5) AS y1 FROM x LEFT JOIN pins ON pins.v = x.v LEFT JOIN m USING (e) GROUP BY x.v""")
def hyper_laplacian_apply(h, scratch):
    y = spectral.hypergraph_apply(h, _xy(h))
    return y.select("v", (F.round("x0", 5) + 0.0).alias("y0"), (F.round("x1", 5) + 0.0).alias("y1"))


@query(f"SELECT v, round(vwt * x0 - vwt / W * S + 0.0, 5) AS y0 FROM (SELECT v, vwt::DOUBLE AS vwt, {XY} AS x0 FROM verts), (SELECT sum(vwt)::DOUBLE AS W, sum(vwt * ({XY})) AS S FROM verts)")
def clique_apply(h, scratch):
    return spectral.clique_apply(h, _xy(h).select("v", "x0")).select("v", F.round("x0", 5).alias("y0"))


@query(f"""SELECT a.v, round(CASE a.s WHEN 0 THEN n1 * x0 - s1 WHEN 1 THEN n0 * x0 - s0 ELSE 0 END, 5) AS y0 FROM (SELECT v, v % 5 AS s, {XY} AS x0 FROM verts) a,
(SELECT count(*) FILTER (v % 5 = 0) AS n0, count(*) FILTER (v % 5 = 1) AS n1, sum({XY}) FILTER (v % 5 = 0) AS s0, sum({XY}) FILTER (v % 5 = 1) AS s1 FROM verts)""")
def biclique_apply(h, scratch):
    sides = incidence.sides_of(modulo_partition(h.vertices, 5))
    return spectral.biclique_apply(sides, _xy(h).select("v", "x0")).select("v", F.round("x0", 5).alias("y0"))


@query(f"SELECT round(avg({XY}), 9) AS x0, round(avg({XZ}), 9) AS x1 FROM verts")
def column_means(h, scratch):
    return spectral.column_means(_xy(h)).select(F.round("x0", 9).alias("x0"), F.round("x1", 9).alias("x1"))


@query(f"SELECT round(sqrt(sum(({XY}) ** 2)), 6) AS x0, round(sqrt(sum(({XZ}) ** 2)), 6) AS x1 FROM verts")
def column_norms(h, scratch):
    return spectral.norms(_xy(h)).select(F.round("x0", 6).alias("x0"), F.round("x1", 6).alias("x1"))


@query(f"SELECT v, row_number() OVER (ORDER BY {XY}, v) - 1 AS rank FROM verts")
def spectral_order_rank(h, scratch):
    return graphs.spectral_order(_embedded(h), scratch).select("v", "rank")


@query(f"SELECT u, v, round(CASE WHEN d = 0 THEN 1e-6 ELSE d END, 6) AS w FROM (SELECT v AS u, lead(v) OVER o AS v, abs(lead({XY}) OVER o - {XY}) AS d FROM verts WINDOW o AS (ORDER BY {XY}, v)) WHERE v IS NOT NULL")
def path_tree(h, scratch):
    return graphs.path_tree(_embedded(h), scratch).withColumn("w", F.round("w", 6))


PATH = f"""o AS (SELECT v, vwt, row_number() OVER (ORDER BY {XY}, v) - 1 AS rank FROM verts),
q AS (SELECT e, min(rank) AS a, max(rank) AS z, any_value(hwt) AS hwt FROM pins JOIN o USING (v) JOIN edges USING (e) GROUP BY e),
pr AS (SELECT o.v, o.rank, CAST(coalesce((SELECT sum(vwt) FROM o p WHERE p.rank < o.rank), 0) AS BIGINT) AS below, CAST(coalesce((SELECT sum(hwt) FROM q WHERE q.a < o.rank AND o.rank <= q.z), 0) AS BIGINT) AS cut FROM o)"""


@query("{plain}WITH " + f"{CTES},\n{PATH} SELECT v, rank, below, cut FROM pr")
def path_cut_profile(h, scratch):
    order = graphs.spectral_order(_embedded(h), scratch)
    return cuts.path_profile(h, order, scratch)


@query("{plain}WITH " + f"{CTES},\n{PATH}, t AS (SELECT sum(vwt) AS total FROM verts) SELECT rank, cut FROM pr, t WHERE rank > 0 AND below <= ceil(total * 0.52) AND total - below <= ceil(total * 0.52) ORDER BY cut, rank LIMIT 1")
def path_best_cut(h, scratch):
    profile = cuts.path_profile(h, graphs.spectral_order(_embedded(h), scratch), scratch)
    total = h.vertices.agg(F.sum("vwt")).first()[0]
    return cuts.best_path_cut(profile, total, metrics.limits_of(total, 2, 2)[1])


def _heap(h, scratch):
    """The tree in which v hangs below (v - 1) // 2."""
    return euler.rooted(h.vertices.where("v > 0").select("v", F.floor((F.col("v") - 1) / 2).cast("long").alias("u")), 0, scratch)


@query("""WITH RECURSIVE {ctes}, an AS (SELECT v AS d, v AS v FROM verts UNION ALL SELECT d, (v - 1) // 2 FROM an WHERE v > 0),
c AS (SELECT an.v, p.e, count(*) AS n FROM pins p JOIN an ON an.d = p.v GROUP BY 1, 2)
SELECT b.v, CAST(coalesce(k.cut, 0) AS BIGINT) AS cut, CAST(b.weight AS BIGINT) AS weight FROM (SELECT an.v, sum(vwt) AS weight FROM an JOIN verts ON verts.v = an.d GROUP BY 1) b
LEFT JOIN (SELECT c.v, sum(hwt) AS cut FROM c JOIN sz USING (e) JOIN edges USING (e) WHERE n < size GROUP BY 1) k ON k.v = b.v""")
def tree_cut_profile(h, scratch):
    return cuts.tree_profile(h, _heap(h, scratch), scratch)


@query("""SELECT v, part, CAST(sum(hwt * (CASE WHEN size > 1 AND coalesce(nq, 0) + 1 < size THEN 1 ELSE 0 END - CASE WHEN np < size THEN 1 ELSE 0 END)) AS BIGINT) AS delta
FROM (SELECT pins.v, CAST(range AS INTEGER) AS part, hwt, size, (SELECT count(*) FROM pins x WHERE x.e = pins.e AND x.v % 3 = pins.v % 3) AS np, (SELECT count(*) FROM pins x WHERE x.e = pins.e AND x.v % 3 = range) AS nq
  FROM pins JOIN edges USING (e) JOIN sz USING (e), range(3) WHERE range <> pins.v % 3) GROUP BY v, part""")
def move_gains(h, scratch):
    return metrics.move_gains(h, modulo_partition(h.vertices, 3), 3)


KS = " UNION ALL ".join(f"SELECT {k} AS cand, sum(hwt) AS cutsize FROM edges WHERE e IN ({_cut(k)})" for k in range(2, 9))


def _modulo_candidates(h):
    cand = h.vertices.select(F.explode(F.sequence(F.lit(2), F.lit(8))).alias("cand"), "v").select("cand", "v", F.pmod("v", F.col("cand")).cast("int").alias("part"))
    return metrics.cut_sizes(h, cand, list(range(2, 9))).withColumn("cand", F.col("cand").cast("int"))


@query(f"SELECT min(cand) AS cand, CAST(cutsize AS BIGINT) AS cutsize FROM ({KS}) GROUP BY cutsize ORDER BY cutsize LIMIT 3")
def topk_candidates(h, scratch):
    return metrics.top_candidates(_modulo_candidates(h), 3).select("cand", "cutsize")


CANDS = f"""cd AS (SELECT range AS cand, v, CAST(CASE WHEN range % 2 = 0 AND fixed >= 0 THEN fixed ELSE (v * range + v // (range + 1)) % 3 END AS INTEGER) AS part FROM verts, range(1, 9)),
ok AS (SELECT cand FROM cd JOIN verts USING (v) GROUP BY cand HAVING NOT bool_or(fixed >= 0 AND fixed <> part)),
pw AS (SELECT cand, p.range AS part, coalesce(sum(vwt), 0) AS w FROM ok CROSS JOIN range(3) p LEFT JOIN cd ON cd.cand = ok.cand AND cd.part = p.range LEFT JOIN verts ON verts.v = cd.v GROUP BY ok.cand, p.range),
li AS (SELECT greatest(floor(sum(vwt)::DOUBLE * (100.0::DOUBLE / 3 - 2) / 100.0), 0) AS low, ceil(sum(vwt)::DOUBLE * (100.0::DOUBLE / 3 + 2) / 100.0) AS high FROM verts),
cu AS (SELECT cand, sum(hwt) AS cutsize FROM (SELECT cand, e FROM cd JOIN pins USING (v) GROUP BY cand, e HAVING min(part) <> max(part)) JOIN edges USING (e) GROUP BY cand),
cm AS (SELECT cand, CAST(sum(greatest(low - w, 0) ** 2 + greatest(w - high, 0) ** 2) AS BIGINT) AS penalty, CAST(any_value(cutsize) AS BIGINT) AS cutsize FROM pw JOIN cu USING (cand), li GROUP BY cand)""".replace("SELECT cand, p.range", "SELECT ok.cand AS cand, p.range")


def _candidate_table(h):
    c, v = F.col("cand"), F.col("v")
    label = F.when((c % 2 == 0) & (F.col("fixed") >= 0), F.col("fixed")).otherwise((v * c + F.floor(v / (c + 1))) % 3)
    return h.vertices.select("v", "fixed", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(8).cast("long"))).alias("cand")).select("cand", "v", label.cast("int").alias("part"))


@query("{plain}WITH " + CTES + ",\n" + CANDS + " SELECT cand, penalty, cutsize FROM cm")
def candidate_metrics(h, scratch):
    return metrics.evaluate_candidates(h, _candidate_table(h), 3, 2)


@query("{plain}WITH " + CTES + ",\n" + CANDS + " SELECT cand, penalty, cutsize FROM cm ORDER BY penalty, cutsize, cand LIMIT 1")
def candidate_argmin(h, scratch):
    return metrics.argmin_candidate(metrics.evaluate_candidates(h, _candidate_table(h), 3, 2))


@query("{plain}SELECT label, i, count(*) AS n, round(avg(c), 6) AS mean FROM (SELECT label, unnest(range(64)) AS i, unnest(embedding)::DOUBLE AS c FROM embeddings) GROUP BY label, i", plain=True)
def lda_class_means(spark, sf_dir, scratch):
    rows = table(spark, sf_dir, "embeddings").select("label", F.transform("embedding", lambda v: v.cast("double")).alias("x"))
    return projection.class_moments(rows).select("label", F.col("i").cast("long").alias("i"), "n", F.round("mean", 6).alias("mean"))


@query("""{plain}SELECT round(sum((c - m) ** 2), 4) AS sw, round(sum((m - g) ** 2), 4) AS sb FROM (SELECT *, avg(c) OVER (PARTITION BY label, i) AS m, avg(c) OVER (PARTITION BY i) AS g
FROM (SELECT label, unnest(range(64)) AS i, unnest(embedding)::DOUBLE AS c FROM embeddings))""", plain=True)
def lda_scatter_trace(spark, sf_dir, scratch):
    rows = table(spark, sf_dir, "embeddings").select("label", F.transform("embedding", lambda v: v.cast("double")).alias("x"))
    return projection.scatter_traces(rows).select(F.round("sw", 4).alias("sw"), F.round("sb", 4).alias("sb"))


def _vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("x"))


SUMS = "{plain}SELECT vec_id, round(sum(c * {a}), 6) AS y0, round(sum(c * {b}), 6) AS y1 FROM (SELECT vec_id, unnest(range(64)) AS i, unnest(embedding)::DOUBLE AS c FROM embeddings) GROUP BY vec_id"


def _pairs(df, y):
    return df.select("vec_id", F.round(y[0], 6).alias("y0"), F.round(y[1], 6).alias("y1"))


@query(SUMS.replace("{a}", "(1 - i % 2)").replace("{b}", "(i % 2)"), plain=True)
def proj_alternating(spark, sf_dir, scratch):
    return _pairs(_vectors(spark, sf_dir), projection.alternating(F.col("x")))


@query("{plain}SELECT vec_id, round(embedding[1]::DOUBLE, 6) AS y0, round(embedding[2]::DOUBLE, 6) AS y1 FROM embeddings", plain=True)
def proj_leading(spark, sf_dir, scratch):
    return _pairs(_vectors(spark, sf_dir), projection.leading(F.col("x"), 2))


_SIGNS = projection.signs(64, 2, 7)


@query(SUMS.replace("{a}", f"{_SIGNS[:, 0].tolist()}[i + 1]").replace("{b}", f"{_SIGNS[:, 1].tolist()}[i + 1]"), plain=True)
def proj_signed(spark, sf_dir, scratch):
    return _pairs(_vectors(spark, sf_dir), projection.combine(F.col("x"), _SIGNS))


@query("""{plain}SELECT l_suppkey AS v, count(*) AS n, min(l_quantity) AS least, max(l_quantity) AS greatest, max(l_quantity) - min(l_quantity) AS spread,
round(avg(l_quantity), 6) AS mean, round(var_pop(l_quantity), 6) AS variance, round(stddev_pop(l_quantity), 6) AS deviation FROM lineitem GROUP BY 1""", plain=True)
def bench_numeric_stats(spark, sf_dir, scratch):
    rows = numeric_stats(table(spark, sf_dir, "lineitem").withColumnRenamed("l_suppkey", "v"), ["v"], "l_quantity")
    return rows.select("v", "n", "least", "greatest", "spread", *[F.round(c, 6).alias(c) for c in ("mean", "variance", "deviation")])


def _facts_sql(k: int, imb: int = 2) -> str:
    return f"""hp AS (SELECT v, CASE WHEN fixed >= 0 THEN fixed ELSE v % {k} END AS part FROM verts)
SELECT count(*) AS vertices, CAST(sum(vwt) AS BIGINT) AS weight, CAST(greatest(floor(sum(vwt)::DOUBLE * (100.0::DOUBLE / {k} - {imb}) / 100.0), 0) AS BIGINT) AS min_cap, CAST(ceil(sum(vwt)::DOUBLE * (100.0::DOUBLE / {k} + {imb}) / 100.0) AS BIGINT) AS max_cap,
CAST((SELECT sum(hwt) FROM edges WHERE e IN (SELECT e FROM pins JOIN hp USING (v) GROUP BY e HAVING min(part) <> max(part))) AS BIGINT) AS plain_cut, true AS complete, true AS all_parts, true AS fixed_ok, true AS balanced, true AS improved FROM verts"""


def _facts(h, part, k, scratch, imb=2):
    """One row: the hypergraph's size, limits and modulo cut, and what must hold of a partition.

    It is balanced (where there are 20 vertices a part or more, so that it can be) and
    not worse than the modulo partition by penalty, then cut.
    """
    part = scratch.keep(part, "partition")
    plain = h.vertices.select("v", F.when(F.col("fixed") >= 0, F.col("fixed")).otherwise(F.pmod("v", F.lit(k))).cast("int").alias("part"))
    cut = lambda p, name: metrics.cut_size(h, p).select(F.col("cutsize").alias(name))
    rows = h.vertices.agg(F.count("*").alias("vertices"), F.sum("vwt").alias("weight")).crossJoin(F.broadcast(metrics.balance_limits(h, k, imb))).crossJoin(F.broadcast(cut(plain, "plain_cut"))).crossJoin(F.broadcast(cut(part, "cut")))
    rows = rows.crossJoin(F.broadcast(metrics.checks(h, part, k))).crossJoin(F.broadcast(metrics.balance_penalty(h, part, k, imb))).crossJoin(F.broadcast(metrics.balance_penalty(h, plain, k, imb).withColumnRenamed("penalty", "plain_penalty")))
    return rows.select("vertices", "weight", "min_cap", "max_cap", "plain_cut", "complete", "all_parts", "fixed_ok", ((F.col("penalty") == 0) | (F.col("vertices") < 20 * k)).alias("balanced"), (F.col("labels_ok") & (F.struct("penalty", "cut") <= F.struct("plain_penalty", "plain_cut"))).alias("improved"))


def flagship(spark, sf_dir):
    """A balanced two-way partition of orders' suppliers: (v, part)."""
    return engine.partition(suppliers_of_orders(spark, sf_dir), PartitionConfig(num_parts=2), Scratch(spark, "flagship"))


@query("{plain}WITH " + CTES + ",\n" + _facts_sql(2))
def spectral_bisect(h, scratch):
    return _facts(h, engine.partition(h, PartitionConfig(num_parts=2), scratch), 2, scratch)


@query("{plain}WITH " + CTES + ",\n" + _facts_sql(4))
def kway_partition(h, scratch):
    return _facts(h, engine.partition(h, PartitionConfig(num_parts=4), scratch), 4, scratch)


@query("{plain}WITH " + CTES + ",\n" + _facts_sql(2))
def distributed_bisect(h, scratch):
    """The plan for inputs beyond one task, which keeps every step in tables; only what is left of 40 vertices or fewer goes to the kernel, and what is left of a forest's or a tour's rounds within the bounds of a gathering scratch to a task."""
    return _facts(h, engine.partition(h, PartitionConfig(num_parts=2, local_vertices=40), scratch), 2, scratch)


@query("{plain}SELECT CAST(range AS INTEGER) AS i, CAST(range AS INTEGER) + 1 AS rank, 1.0::DOUBLE AS norm, 0.0::DOUBLE AS inner_product, 0.0::DOUBLE AS mean, true AS settled FROM range(2)")
def spectral_embedding(h, scratch):
    """Facts of the embedding after all iterations: values ascend, columns are orthonormal in B and have mean 0, residuals are small."""
    x = scratch.keep(spectral.solve(h, scratch.keep(graphs.hypergraph_to_graph(h), "graph"), 2, PartitionConfig.solver_iters, scratch), "embedding")
    lam, held, rest = spectral.quality(h, x, 2)
    mean = x.agg(*[F.avg(F.col("x")[i]) for i in range(2)]).first()
    rank = np.argsort(np.argsort(lam)) + 1
    rows = [(i, int(rank[i]), round(float(held[i, i]), 6), abs(round(float(held[0, 1]), 6)), abs(round(mean[i], 9)), bool(rest[i] < 0.05)) for i in range(2)]
    return h.vertices.sparkSession.createDataFrame(rows, "i int, rank int, norm double, inner_product double, mean double, settled boolean")


@query(_reach("pins", "verts", f"{_cut(2)} UNION {_cut(3)}").rstrip() + """,
main AS (SELECT comp FROM comp GROUP BY comp ORDER BY count(*) DESC, comp LIMIT 1),
isl AS (SELECT comp, row_number() OVER (ORDER BY comp) AS i, CAST(sum(CASE WHEN fixed < 0 THEN vwt ELSE 0 END) AS BIGINT) AS free, CAST(sum(CASE WHEN fixed = 0 THEN vwt ELSE 0 END) AS BIGINT) AS f0, CAST(sum(CASE WHEN fixed = 1 THEN vwt ELSE 0 END) AS BIGINT) AS f1
  FROM comp JOIN verts USING (v) WHERE comp <> (SELECT comp FROM main) GROUP BY comp),
st AS (SELECT CAST(0 AS BIGINT) AS i, CAST(coalesce(sum(vwt) FILTER (WHERE v % 2 = 0), 0) AS BIGINT) AS l0, CAST(coalesce(sum(vwt) FILTER (WHERE v % 2 = 1), 0) AS BIGINT) AS l1, CAST(-1 AS BIGINT) AS comp, 0 AS part FROM comp JOIN verts USING (v) WHERE comp = (SELECT comp FROM main)
  UNION ALL SELECT i, l0 + f0 + CASE WHEN pick = 0 THEN free ELSE 0 END, l1 + f1 + CASE WHEN pick = 1 THEN free ELSE 0 END, comp, pick FROM
    (SELECT isl.*, l0, l1, CASE WHEN f0 + f1 > 0 THEN CASE WHEN f1 > f0 THEN 1 ELSE 0 END ELSE CASE WHEN l1 < l0 THEN 1 ELSE 0 END END AS pick FROM st JOIN isl ON isl.i = st.i + 1))
SELECT v, CAST(CASE WHEN comp.comp = (SELECT comp FROM main) THEN v % 2 WHEN fixed >= 0 THEN fixed ELSE st.part END AS INTEGER) AS part FROM comp JOIN verts USING (v) LEFT JOIN st ON st.comp = comp.comp""")
def lift_islands(h, scratch):
    """Labels of the main component of what two cuts leave, carried to all vertices."""
    cut = incidence.union_distinct(*_two_cuts(h))
    left = h.with_(pins=h.pins.join(cut, "e", "left_anti"))
    comps = scratch.keep(islands.numbered(islands.components(left, scratch), scratch), "components")
    main = islands.main_component(left, comps)
    return islands.lift(left, comps, modulo_partition(main.vertices, 2), 2)


TINY = """cs AS (SELECT e, bit_or(CAST(1 AS BIGINT) << CAST(v % 8 AS INTEGER)) AS mask FROM pins GROUP BY e),
ce AS (SELECT mask, sum(hwt) AS hwt FROM cs JOIN edges USING (e) WHERE bit_count(mask) > 1 GROUP BY mask),
vw AS (SELECT v % 8 AS c, sum(vwt) AS w FROM verts GROUP BY 1),
fx AS (SELECT v % 8 AS c, arg_max(fixed, v) FILTER (WHERE fixed >= 0) AS f FROM verts GROUP BY 1),
a AS (SELECT range AS b FROM range(256)),
ok AS (SELECT b FROM a, vw GROUP BY b HAVING greatest(sum(CASE WHEN (b >> CAST(c AS INTEGER)) & 1 = 1 THEN w ELSE 0 END), sum(CASE WHEN (b >> CAST(c AS INTEGER)) & 1 = 0 THEN w ELSE 0 END)) <= ceil(sum(w) * 0.6)
  AND least(sum(CASE WHEN (b >> CAST(c AS INTEGER)) & 1 = 1 THEN w ELSE 0 END), sum(CASE WHEN (b >> CAST(c AS INTEGER)) & 1 = 0 THEN w ELSE 0 END)) >= floor(sum(w) * 0.4)),
good AS (SELECT b FROM ok WHERE NOT EXISTS (SELECT 1 FROM fx WHERE f IS NOT NULL AND (b >> CAST(c AS INTEGER)) & 1 <> f))"""


@query("{plain}WITH " + f"{CTES},\n{TINY} SELECT CAST(min(cut) AS BIGINT) AS cut FROM (SELECT b, sum(CASE WHEN (mask & b) <> 0 AND (mask & b) <> mask THEN hwt ELSE 0 END) AS cut FROM good, ce GROUP BY b)")
def exact_tiny(h, scratch):
    """The least balanced cut of eight supplier groups, by branch and bound in one task."""
    coarse = overlay.contract(h, h.vertices.select("v", F.pmod("v", F.lit(8)).alias("c")))
    got = engine.fetch(coarse)
    least, most = metrics.limits_of(int(got.local.vwt.sum()), 2, 10)
    part = engine.kernel.exact(got.local, 2, least, most)
    cut = None if part is None else engine.kernel.cut_of(got.local, part)
    return h.vertices.sparkSession.createDataFrame([(cut,)], "cut long")


@query("""WITH RECURSIVE {ctes}, an AS (SELECT v AS d, v AS v FROM verts UNION ALL SELECT d, (v - 1) // 2 FROM an WHERE v > 0),
fe AS (SELECT e, bool_or(fixed = 0) AS t0, bool_or(fixed = 1) AS t1 FROM pins JOIN verts USING (v) GROUP BY e HAVING bool_or(fixed = 0) <> bool_or(fixed = 1)),
mp AS (SELECT pins.e, pins.v, t0 FROM pins JOIN verts USING (v) JOIN fe USING (e) WHERE fixed < 0), ms AS (SELECT e, count(*) AS size FROM mp GROUP BY e),
c AS (SELECT an.v, mp.e, t0, count(*) AS n FROM mp JOIN an ON an.d = mp.v GROUP BY 1, 2, 3),
k AS (SELECT c.v, sum(hwt) FILTER (WHERE t0) AS cut0, sum(hwt) FILTER (WHERE NOT t0) AS cut1, sum(hwt) FILTER (WHERE t0 AND n = size) AS fb0, sum(hwt) FILTER (WHERE NOT t0 AND n = size) AS fb1 FROM c JOIN ms USING (e) JOIN edges USING (e) GROUP BY 1)
SELECT verts.v, CAST(coalesce(cut0, 0) AS BIGINT) AS cut0, CAST(coalesce(cut1, 0) AS BIGINT) AS cut1, CAST(coalesce(fb0, 0) AS BIGINT) AS fb0, CAST(coalesce(fb1, 0) AS BIGINT) AS fb1 FROM verts LEFT JOIN k ON k.v = verts.v""")
def forced_tree_profile(h, scratch):
    return cuts.forced_profile(h, _heap(h, scratch), incidence.sides_from_fixed(h), scratch)


@query("{plain}WITH " + f"{CTES},\n{SMALL},\n{CYCLE} SELECT u AS i, v AS j, round(max(w), 6) AS w FROM (SELECT * FROM sm UNION ALL SELECT * FROM cy) GROUP BY u, v")
def heaviest_of_pair(h, scratch):
    """Of all links between two vertices, before they are added up, the heaviest."""
    links = graphs.small_edge_links(h).union(graphs.cycle_links(h, order="pin"))
    pairs = links.select(F.least("u", "v").alias("i"), F.greatest("u", "v").alias("j"), "w")
    return graphs.heaviest_of_pair(pairs).withColumn("w", F.round("w", 6))


@query("{plain}WITH RECURSIVE " + f"""{CTES},\n{GRAPH}, x AS (SELECT v, {XY} AS x0, {XZ} AS x1 FROM verts),
gw AS MATERIALIZED (SELECT g.u, g.v, abs(a.x0 - b.x0) + abs(a.x1 - b.x1) AS w FROM g JOIN x a ON a.v = g.u JOIN x b ON b.v = g.v),
t AS (SELECT [min(u)] AS seen, CAST(NULL AS BIGINT) AS u, CAST(NULL AS BIGINT) AS v, CAST(NULL AS DOUBLE) AS w FROM gw
  UNION ALL SELECT * FROM (SELECT list_append(seen, CASE WHEN list_contains(seen, gw.u) THEN gw.v ELSE gw.u END), gw.u, gw.v, gw.w FROM t, gw WHERE list_contains(seen, gw.u) <> list_contains(seen, gw.v) ORDER BY gw.w, gw.u, gw.v LIMIT 1))
SELECT u, v, round(w, 6) AS w FROM t WHERE u IS NOT NULL""")
def spanning_forest(h, scratch):
    """The least spanning tree of the graph weighed by distance in two coordinates."""
    got = trees.minimum_spanning_forest(graphs.reweight(graphs.hypergraph_to_graph(h, order="pin"), _embedded(h)), scratch)
    return got.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), F.round("w", 6).alias("w"))


@query("{plain}WITH RECURSIVE " + f"""{CTES},\n{GRAPH}, bo AS MATERIALIZED (SELECT u, v, round(w, 6) AS w FROM g UNION ALL SELECT v, u, round(w, 6) FROM g),
hv AS (SELECT u AS a, arg_min(v, (-w, v)) AS b FROM bo GROUP BY u), lk AS MATERIALIZED (SELECT a, b FROM hv UNION SELECT b, a FROM hv),
r AS (SELECT a AS x, a AS c FROM hv UNION SELECT lk.b, r.c FROM r JOIN lk ON lk.a = r.x), gr AS (SELECT x AS v, min(c) AS g FROM r GROUP BY x)
SELECT least(p.g, q.g) AS u, greatest(p.g, q.g) AS v, round(sum(w), 6) AS w FROM bo JOIN gr p ON p.v = bo.u JOIN gr q ON q.v = bo.v WHERE bo.u < bo.v AND p.g <> q.g GROUP BY 1, 2""")
def multigrid_level(h, scratch):
    """The graph of groups one level up."""
    graph = scratch.keep(graphs.hypergraph_to_graph(h, order="pin").withColumn("w", F.round("w", 6)), "graph")
    return multigrid.coarsen(graph, multigrid.groups(graph, scratch)).withColumn("w", F.round("w", 6))
