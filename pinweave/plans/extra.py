"""More queries with their SQL: files read back, trees at any depth, choices, layouts and dense checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pinweave.functions.stats import tool_summary as summarise
from pinweave.model import from_table, modulo_partition
from pinweave.operators import cuts, euler, graphs, incidence, islands, metrics, projection, refine, spectral, trees
from pinweave.plans import registry
from pinweave.plans.registry import CTES, GRAPH, XY, XZ, _embedded, _heap, _reach, suppliers_of_orders, table
from pinweave.runtime import Scratch
from pinweave.sources import files

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str, plain: bool = False):
    """As in the registry; SQL that begins with a comma or SELECT follows the common tables."""

    def add(f):
        def run(spark, sf_dir):
            scratch = Scratch(spark, f.__name__)
            return f(spark, sf_dir, scratch) if plain else f(suppliers_of_orders(spark, sf_dir), scratch)

        QUERIES[f.__name__] = run
        text = sql.replace("{ctes}", CTES)
        ORACLE_SQL[f.__name__] = text if text.lstrip().upper().startswith("WITH") else f"WITH RECURSIVE {CTES}{text}" if text.startswith(",") else f"WITH {CTES}\n{text}"
        return f

    return add


# layouts, labels, choices


@query("SELECT v, CAST(v % 4 AS INTEGER) AS part FROM verts")
def vertices_by_part(h, scratch):
    return incidence.vertices_by_part(modulo_partition(h.vertices, 4))


@query("SELECT CAST(max(v % 4) + 1 AS INTEGER) AS parts FROM verts")
def count_parts(h, scratch):
    return metrics.count_parts(modulo_partition(h.vertices, 4))


@query("SELECT CAST(arg_min(v % 4, (w, v % 4)) AS INTEGER) AS part FROM (SELECT v % 4 AS v, sum(vwt) AS w FROM verts GROUP BY 1)")
def lightest_part(h, scratch):
    return metrics.lightest_part(metrics.part_weights(h, modulo_partition(h.vertices, 4), 4))


@query("SELECT v, e FROM pins")
def inverted_index(h, scratch):
    return incidence.by_vertex(h).select("v", "e")


@query("WITH t AS (SELECT vec_id, embedding FROM embeddings) SELECT vec_id, round(embedding[4]::DOUBLE, 6) AS y0, round(embedding[1]::DOUBLE, 6) AS y1, 2 AS width FROM t", plain=True)
def select_columns(spark, sf_dir, scratch):
    """Two columns; one that does not exist is dropped."""
    x = projection.select_columns(F.col("x"), [3, 0, 70], 64)
    rows = registry._vectors(spark, sf_dir).select("vec_id", x.alias("x"))
    return rows.select("vec_id", F.round(F.col("x")[0], 6).alias("y0"), F.round(F.col("x")[1], 6).alias("y1"), F.size("x").alias("width"))


TOKENS = {"LDA": "lda", "random_signed": "random", "Dimensionality Reduction": "random", "projection": "alternating", "ODD-EVEN": "alternating", " alternating columns ": "alternating", "Prefix": "leading", "leading_columns": "leading"}


@query("WITH t(token, name) AS (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in TOKENS.items()) + ") SELECT token, name FROM t", plain=True)
def strategy_names(spark, sf_dir, scratch):
    return spark.createDataFrame([(t, projection.strategy(t)) for t in TOKENS], "token string, name string")


@query("SELECT v, round(x0, 6) AS y0, round(x1, 6) AS y1, round(x0 + 1, 6) AS y2, 3 AS width FROM (SELECT v, " + XY + " AS x0, " + XZ + " AS x1 FROM verts)")
def concat_embeddings(h, scratch):
    """Two blocks side by side; a block of too few rows is left out."""
    one = _embedded(h)
    two = one.select("v", F.array(F.col("x")[0] + 1).alias("x"))
    out = incidence.concat_embeddings([one, one.where("v % 2 = 0"), two], h.vertices.count())
    return out.select("v", *[F.round(F.col("x")[i], 6).alias(f"y{i}") for i in range(3)], F.size("x").alias("width"))


RUNS = "SELECT event_type AS tool, CASE WHEN user_id % 5 = 0 THEN 'failed' ELSE 'ok' END AS status, CAST(event_id % 23 AS BIGINT) AS cutsize FROM events"


@query(f"WITH r AS ({RUNS}) SELECT tool, count(*) AS runs, count(*) FILTER (status = 'ok') AS ok, count(*) FILTER (status <> 'ok') AS failed, count(DISTINCT cutsize) FILTER (status = 'ok') AS distinct_cuts, min(cutsize) FILTER (status = 'ok') AS best, max(cutsize) FILTER (status = 'ok') AS worst FROM r GROUP BY tool", plain=True)
def tool_summary(spark, sf_dir, scratch):
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("tool"), F.when(F.col("user_id") % 5 == 0, "failed").otherwise("ok").alias("status"), (F.col("event_id") % 23).cast("long").alias("cutsize"))
    return summarise(rows)


@query("WITH x AS (SELECT v, part, CASE WHEN part = 0 THEN 1 ELSE 0 END AS z FROM (SELECT vec_id AS v, label AS part FROM embeddings)) SELECT vec_id, 'leading' AS how, round(embedding[1]::DOUBLE, 5) AS y0, round(embedding[2]::DOUBLE, 5) AS y1 FROM embeddings UNION ALL SELECT vec_id, 'alternating', round(sum(c * (1 - i % 2)), 5), round(sum(c * (i % 2)), 5) FROM (SELECT vec_id, unnest(range(64)) AS i, unnest(embedding)::DOUBLE AS c FROM embeddings) GROUP BY vec_id", plain=True)
def reduce_embedding(spark, sf_dir, scratch):
    """The dispatch by strategy name; discriminants of one class fall back to alternating columns."""
    x = registry._vectors(spark, sf_dir).withColumnRenamed("vec_id", "v")
    labels = x.select("v", F.lit(0).alias("part"))
    kinds = {"leading": projection.reduce_embedding(x, labels, 64, 2, "Prefix"), "alternating": projection.reduce_embedding(x, labels, 64, 2, "odd_even")}
    return reduce(DataFrame.union, [df.select(F.col("v").alias("vec_id"), F.lit(how).alias("how"), F.round(F.col("x")[0], 5).alias("y0"), F.round(F.col("x")[1], 5).alias("y1")) for how, df in kinds.items()])


@query(f"WITH {CTES},\n{GRAPH} SELECT row_number() OVER (ORDER BY j, i) - 1 AS pos, i, j, round(w, 6) AS w FROM (SELECT u AS i, v AS j, w FROM g UNION ALL SELECT v, u, w FROM g)")
def column_order(h, scratch):
    return graphs.column_order(graphs.hypergraph_to_graph(h, order="pin"), scratch).withColumn("w", F.round("w", 6))


# trees


HEAP = """,
an AS (SELECT v AS d, v AS v, 0 AS up FROM verts UNION ALL SELECT d, (v - 1) // 2, up + 1 FROM an WHERE v > 0)"""


@query(HEAP + " SELECT d AS v, CASE WHEN d > 0 THEN (d - 1) // 2 ELSE -1 END AS parent, CAST(max(up) AS BIGINT) AS depth, (SELECT count(*) FROM an b WHERE b.v = an.d) AS below FROM an GROUP BY d")
def rooted_tree(h, scratch):
    """Parents, depths and subtree sizes of a tree given by its links alone."""
    return _heap(h, scratch).select("v", F.coalesce("parent", F.lit(-1)).alias("parent"), "depth", (F.col("tout") - F.col("tin")).alias("below"))


@query(HEAP + " SELECT v, d FROM (SELECT an.v, an.d FROM an WHERE an.v IN (1, 2, 5))")
def tree_ancestors(h, scratch):
    """Which vertices lie on or below three given ones."""
    some = h.vertices.sparkSession.createDataFrame([(1,), (2,), (5,)], "a long")
    return euler.ancestors(_heap(h, scratch), some).select(F.col("a").alias("v"), F.col("v").alias("d"))


@query(HEAP + """, pr AS (SELECT a.v AS s, b.v AS t FROM verts a JOIN verts b ON b.v = (a.v * 7 + 3) % (SELECT count(*) FROM verts)),
de AS (SELECT d, max(up) AS depth FROM an GROUP BY d)
SELECT s, t, arg_max(x.v, de.depth) AS top FROM pr JOIN an x ON x.d = pr.s JOIN an y ON y.d = pr.t AND y.v = x.v JOIN de ON de.d = x.v GROUP BY s, t""")
def lowest_common_ancestors(h, scratch):
    tree, n = _heap(h, scratch), h.vertices.count()
    pairs = h.vertices.select(F.col("v").alias("s"), ((F.col("v") * 7 + 3) % n).alias("t"))
    at = lambda c: tree.select(F.col("v").alias(c), F.col("tin").alias(f"_{c}"))
    pairs = pairs.join(at("s"), "s").join(at("t"), "t").select("s", "t", F.least("_s", "_t").alias("lo"), F.greatest("_s", "_t").alias("hi"))
    return euler.lca(pairs, tree, scratch).join(tree.select(F.col("tin").alias("top"), F.col("v").alias("name")), "top").select("s", "t", F.col("name").alias("top"))


CHAIN = """WITH {ctes}, ln AS (SELECT e, min(v) AS a, max(v) AS z, any_value(hwt) AS hwt FROM pins JOIN edges USING (e) GROUP BY e HAVING count(*) > 1)
SELECT verts.v, CAST(coalesce((SELECT sum(hwt) FROM ln WHERE a < verts.v AND z >= verts.v), 0) AS BIGINT) AS cut, CAST((SELECT sum(vwt) FROM verts b WHERE b.v >= verts.v) AS BIGINT) AS weight FROM verts"""


@query(CHAIN)
def deep_tree_profile(h, scratch):
    """Cut costs on a chain through all vertices, as deep as there are vertices."""
    tree = euler.rooted(h.vertices.where("v > 0").select("v", (F.col("v") - 1).alias("u")), 0, scratch)
    return cuts.tree_profile(h, tree, scratch)


FORCED = """,
fk AS (SELECT e, coalesce(bool_or(fixed = 0), false) AS t0, coalesce(bool_or(fixed = 1), false) AS t1 FROM pins JOIN verts USING (v) GROUP BY e),
mp AS (SELECT pins.e, pins.v, t0, t1 FROM pins JOIN verts USING (v) JOIN fk USING (e) WHERE fixed NOT IN (0, 1)), ms AS (SELECT e, count(*) AS size FROM mp GROUP BY e),
cn AS (SELECT an.v, mp.e, t0, t1, count(*) AS n FROM mp JOIN an ON an.d = mp.v GROUP BY 1, 2, 3, 4),
kk AS (SELECT cn.v, coalesce(sum(hwt) FILTER (NOT t0 AND NOT t1 AND n < size), 0) AS cut, coalesce(sum(hwt) FILTER (t0 AND NOT t1), 0) AS cut0, coalesce(sum(hwt) FILTER (t1 AND NOT t0), 0) AS cut1,
  coalesce(sum(hwt) FILTER (t0 AND NOT t1 AND n = size), 0) AS fb0, coalesce(sum(hwt) FILTER (t1 AND NOT t0 AND n = size), 0) AS fb1 FROM cn JOIN ms USING (e) JOIN edges USING (e) GROUP BY 1),
ft AS (SELECT coalesce(sum(hwt) FILTER (t0 AND NOT t1), 0) AS f0, coalesce(sum(hwt) FILTER (t1 AND NOT t0), 0) AS f1, coalesce(sum(hwt) FILTER (t0 AND t1), 0) AS f01 FROM fk JOIN edges USING (e)),
wt AS (SELECT an.v, sum(vwt) AS weight FROM an JOIN verts ON verts.v = an.d GROUP BY 1),
cp AS (SELECT wt.v, CASE WHEN wt.v > 0 THEN (wt.v - 1) // 2 END AS parent, CAST(weight AS BIGINT) AS weight, CAST(coalesce(cut, 0) + f0 - coalesce(fb0, 0) + coalesce(cut1, 0) + f01 AS BIGINT) AS exc0,
  CAST(coalesce(cut, 0) + f1 - coalesce(fb1, 0) + coalesce(cut0, 0) + f01 AS BIGINT) AS exc1 FROM wt LEFT JOIN kk ON kk.v = wt.v, ft)"""


def _sides(h):
    return incidence.sides_from_fixed(h)


@query(HEAP + FORCED + " SELECT v, coalesce(parent, -1) AS parent, weight, exc0, exc1, least(exc0, exc1) AS cost FROM cp")
def cut_profile(h, scratch):
    """The combined table of a tree's cut costs with fixed sides."""
    return cuts.cut_profile(h, _heap(h, scratch), _sides(h), scratch).na.fill(-1, ["parent"])


@query(HEAP + FORCED + " SELECT least(v, parent) AS u, greatest(v, parent) AS v, least(exc0, exc1) AS w FROM cp WHERE parent IS NOT NULL")
def cost_tree(h, scratch):
    """The tree with the cheaper side's cost on each link."""
    rows = cuts.cut_profile(h, _heap(h, scratch), _sides(h), scratch).where("parent IS NOT NULL")
    return rows.select(F.least("v", "parent").alias("u"), F.greatest("v", "parent").alias("v"), F.col("cost").alias("w"))


@query(HEAP + FORCED + ", tt AS (SELECT sum(vwt) AS total FROM verts) SELECT v, least(exc0, exc1) AS cost FROM cp, tt WHERE parent IS NOT NULL AND weight <= ceil(total * 0.8) AND total - weight <= ceil(total * 0.8) ORDER BY cost, v LIMIT 1")
def best_tree_edge(h, scratch):
    total = int(h.vertices.agg(F.sum("vwt")).first()[0])
    return cuts.best_tree_edge(cuts.cut_profile(h, _heap(h, scratch), _sides(h), scratch), total, metrics.limits_of(total, 2, 30)[1])


@query(HEAP + FORCED + """, tt AS (SELECT sum(vwt) AS total FROM verts), be AS (SELECT v FROM cp, tt WHERE parent IS NOT NULL AND weight > 0 AND weight < total AND weight <= ceil(total * 0.8) AND total - weight <= ceil(total * 0.8) ORDER BY least(exc0, exc1), v LIMIT 1)
SELECT verts.v, CAST(CASE WHEN verts.v IN (SELECT d FROM an WHERE an.v = (SELECT v FROM be)) THEN 1 ELSE 0 END AS INTEGER) AS part FROM verts""")
def tree_sweep(h, scratch):
    """Two parts by the best cut of a tree with fixed sides."""
    total = int(h.vertices.agg(F.sum("vwt")).first()[0])
    return cuts.tree_sweep(h, _heap(h, scratch), _sides(h), 2, *metrics.limits_of(total, 2, 30), scratch)


@query(HEAP + """, gone AS (SELECT v FROM verts WHERE v > 0 AND v % 7 = 0), tp AS (SELECT d, max(an.v) FILTER (WHERE an.v IN (SELECT v FROM gone)) AS top FROM an GROUP BY d)
SELECT d AS v, coalesce(top, 0) AS root FROM tp""")
def pieces_without(h, scratch):
    """What a tree falls into without the links above every seventh vertex."""
    links = h.vertices.where("v > 0").select("v", F.floor((F.col("v") - 1) / 2).cast("long").alias("u"))
    return trees.pieces_without(links, h.vertices, links.where("v % 7 = 0"), scratch)


# components on slices, moves


SLICE = """sp AS (SELECT DISTINCT l_orderkey AS e, l_partkey AS v FROM lineitem WHERE l_orderkey % 40 = 0)"""


@query(("WITH RECURSIVE " + SLICE + ",\n" + _reach("sp", "sp", "SELECT -1").split("\n", 1)[1]).rstrip() + " SELECT v, comp FROM comp", plain=True)
def slice_components(spark, sf_dir, scratch):
    """Components of a slice of the orders, which leaves many."""
    h = from_table(table(spark, sf_dir, "lineitem").where("l_orderkey % 40 = 0"), "l_orderkey", "l_partkey")
    return islands.numbered(islands.components(h, scratch), scratch)


@query(("WITH RECURSIVE " + SLICE + ",\n" + _reach("sp", "sp", "SELECT -1").split("\n", 1)[1]).rstrip() + " SELECT comp, count(*) AS n FROM comp GROUP BY comp", plain=True)
def slice_sizes(spark, sf_dir, scratch):
    h = from_table(table(spark, sf_dir, "lineitem").where("l_orderkey % 40 = 0"), "l_orderkey", "l_partkey")
    return islands.sizes(islands.numbered(islands.components(h, scratch), scratch))


@query("""SELECT count(*) AS vertices, CAST(sum(hwt) AS BIGINT) AS plain_cut, true AS lower, true AS fixed_ok FROM (SELECT sum(hwt) AS hwt FROM edges WHERE e IN
(SELECT e FROM pins JOIN (SELECT v, CASE WHEN fixed >= 0 THEN fixed ELSE v % 2 END AS part FROM verts) USING (v) GROUP BY e HAVING min(part) <> max(part))), verts""")
def batched_refinement(h, scratch):
    """What must hold after moves in batches: less by penalty, then cut (a dozen vertices may have nothing to gain), fixed vertices in place."""
    plain = scratch.keep(refine.impose_fixed(h, modulo_partition(h.vertices, 2)), "plain")
    total = int(h.vertices.agg(F.sum("vwt")).first()[0])
    part = refine.refine(h, plain, 2, *metrics.limits_of(total, 2, 2), scratch)
    cut = lambda p: (int(metrics.balance_penalty(h, p, 2, 2).first()["penalty"]), int(metrics.cut_size(h, p).first()["cutsize"]))
    before, after, n = cut(plain), cut(part), h.vertices.count()
    row = (n, before[1] * n, after < before or (n < 40 and after == before), metrics.fixed_violations(h, part).count() == 0)
    return h.vertices.sparkSession.createDataFrame([row], "vertices long, plain_cut long, lower boolean, fixed_ok boolean")


@query("SELECT v, CASE WHEN fixed >= 0 THEN fixed WHEN v % 2 = 0 THEN CAST(v % 3 AS INTEGER) ELSE -1 END AS part, v % 2 = 1 AND fixed < 0 AS dealt FROM verts")
def greedy_assign(h, scratch):
    """Unset vertices get some part within the limits, the others keep theirs; the new labels themselves are not compared."""
    given = h.vertices.where("v % 2 = 0").select("v", (F.col("v") % 3).cast("int").alias("part"))
    out = refine.greedy_assign(h, given, 3, scratch)
    dealt = (F.col("v") % 2 == 1) & (F.col("fixed") < 0)
    return out.join(h.vertices, "v").where(F.col("part").between(0, 2)).select("v", F.when(~dealt, F.col("part")).otherwise(-1).alias("part"), dealt.alias("dealt"))


# dense checks


@query("""SELECT p.v, q.v AS col, round(sum(CASE WHEN p.v = q.v THEN c * (1 - 1.0::DOUBLE / size) ELSE -c / size END), 6) AS val FROM pins p JOIN pins q USING (e) JOIN
(SELECT e, size, hwt / (floor(size / 2) * ceil(size / 2) / (size - 1)) AS c FROM sz JOIN edges USING (e) WHERE size > 1) USING (e) WHERE q.v < 6 GROUP BY p.v, q.v HAVING abs(val) > 1e-9""")
def dense_hypergraph_operator(h, scratch):
    """Six columns of the operator's matrix, which SQL adds up over cliques."""
    return spectral.dense_columns(h, list(range(6))).withColumn("val", F.round("val", 6)).where("abs(val) > 1e-9")


@query("""SELECT a.v, b.v AS col, CAST(CASE WHEN a.v = b.v THEN (SELECT count(*) FROM verts c WHERE c.v % 5 = 1 - a.v % 5) ELSE -1 END AS DOUBLE) AS val FROM verts a JOIN verts b ON (a.v = b.v OR a.v % 5 = 1 - b.v % 5) AND a.v % 5 < 2 AND b.v % 5 < 2 WHERE b.v < 12""")
def dense_biclique_operator(h, scratch):
    """Some columns of the biclique between two sides, which SQL makes from the cross product."""
    sides = incidence.sides_of(modulo_partition(h.vertices, 5))
    some = [v for v in range(12) if v % 5 < 2]
    return spectral.dense_columns(h, some, sides).withColumn("val", F.round("val", 6))


# files


def _written(h, scratch, name):
    return f"{scratch.base}/{name}"


@query("SELECT 'pin' AS kind, dense_rank() OVER (ORDER BY e) - 1 AS id, v AS value FROM pins UNION ALL SELECT 'edge', row_number() OVER (ORDER BY e) - 1, CAST(hwt AS BIGINT) FROM edges UNION ALL SELECT 'vertex', v, CAST(vwt AS BIGINT) FROM verts UNION ALL SELECT 'fixed', v, CAST(fixed AS BIGINT) FROM verts")
def hypergraph_file(h, scratch):
    """A hypergraph and its fixed vertices written and read again."""
    path, fixed = _written(h, scratch, "h.hgr"), _written(h, scratch, "h.fix")
    files.write_hypergraph(h, path)
    files.write_partition(h.vertices.select("v", F.col("fixed").alias("part")), fixed)
    got = files.read_hypergraph(h.vertices.sparkSession, path, fixed)
    row = lambda df, kind, i, x: df.select(F.lit(kind).alias("kind"), F.col(i).alias("id"), F.col(x).cast("long").alias("value"))
    return row(got.pins, "pin", "e", "v").union(row(got.hyperedges, "edge", "e", "hwt")).union(row(got.vertices, "vertex", "v", "vwt")).union(row(got.vertices, "fixed", "v", "fixed"))


@query("SELECT 'pin' AS kind, dense_rank() OVER (ORDER BY e) - 1 AS id, v AS value FROM pins UNION ALL SELECT 'vertex', v, CAST(vwt AS BIGINT) FROM verts")
def large_hypergraph_file(h, scratch):
    """The same by byte offsets, in parallel."""
    path = _written(h, scratch, "h.hgr")
    files.write_hypergraph(h, path)
    got = files.read_large_hypergraph(h.vertices.sparkSession, path, scratch)
    return got.pins.select(F.lit("pin").alias("kind"), F.col("e").alias("id"), F.col("v").alias("value")).union(got.vertices.select(F.lit("vertex"), "v", F.col("vwt").cast("long")))


@query("SELECT v, CAST(v % 3 AS INTEGER) AS part, true AS valid, false AS wrong_size FROM verts")
def partition_file(h, scratch):
    """A partition written, read, and accepted only with its number of rows."""
    path, spark, n = _written(h, scratch, "p.part"), h.vertices.sparkSession, h.vertices.count()
    files.write_partition(modulo_partition(h.vertices, 3), path)
    good, bad = files.read_partition_if_valid(spark, path, n), files.read_partition_if_valid(spark, path, n + 1)
    return good.select("v", "part", F.lit(good is not None).alias("valid"), F.lit(bad is not None).alias("wrong_size"))


METIS = f"""WITH {{ctes}},\n{GRAPH}, b AS (SELECT u, v, w FROM g UNION ALL SELECT v, u, w FROM g)
SELECT CAST(0 AS BIGINT) AS line_no, (SELECT count(*) FROM verts) || ' ' || (SELECT count(*) FROM g) || ' 001' AS line
UNION ALL SELECT v + 1, coalesce((SELECT string_agg((b.v + 1) || ' ' || CAST(floor(round(w, 6)) AS BIGINT), ' ' ORDER BY b.v) FROM b WHERE b.u = verts.v), '') FROM verts"""


@query(METIS)
def graph_file(h, scratch):
    """A graph in the format of graph partitioners, as its lines."""
    path = _written(h, scratch, "g.graph")
    graph = graphs.hypergraph_to_graph(h, order="pin").withColumn("w", F.round("w", 6))
    files.write_metis_graph(graph, h.vertices, path)
    return files.read_lines(h.vertices.sparkSession, path, scratch)


@query("WITH t AS (SELECT CAST(n_nationkey AS VARCHAR) AS seed, n_name AS name, n_name || '.hgr' AS hypergraph, CAST(2 + n_regionkey AS VARCHAR) AS num_parts FROM nation) SELECT name, hypergraph, num_parts, seed FROM t", plain=True)
def case_table(spark, sf_dir, scratch):
    """Cases written as a tab-separated table and read again."""
    path = f"{scratch.base}/cases.tsv"
    rows = table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.concat("n_name", F.lit(".hgr")).alias("hypergraph"), (2 + F.col("n_regionkey")).cast("string").alias("num_parts"), F.col("n_nationkey").cast("string").alias("seed"))
    files.write_results(rows.orderBy("name"), path, "tsv")
    return files.read_cases(spark, path)


@query("WITH t AS (SELECT CAST(0 AS BIGINT) AS line_no, '| r_regionkey | r_name |' AS line UNION ALL SELECT 1, '| --- | --- |' UNION ALL SELECT r_regionkey + 2, '| ' || r_regionkey || ' | ' || r_name || ' |' FROM region) SELECT line_no, line FROM t", plain=True)
def report_file(spark, sf_dir, scratch):
    """A result table as Markdown, as its lines."""
    path = f"{scratch.base}/report.md"
    files.write_results(table(spark, sf_dir, "region").select("r_regionkey", "r_name").orderBy("r_regionkey"), path, "md")
    return files.read_lines(spark, path, scratch)
