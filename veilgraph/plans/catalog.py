"""The registered graph queries and, where DuckDB can say the same, their SQL.

Graphs come from whole tables: `dense` joins parts that share an order, `sparse` parts that share two or more;
`filled` and `opened` join parts that share an order of status F or O and stand for a graph before and after.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilgraph.operators import anonymise, attack, communities, compare, evaluate, hierarchy, learn, nearest, neighbourhoods, segments, structure, sweeps, utility, walks
from veilgraph.operators.components import connected_components
from veilgraph.plans.staging import discard, spread, staged
from veilgraph.sources import formats, graphs

K = 5
KS = (2, 5, 8, 10, 15, 100)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _graph(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    lines = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    if kind in ("filled", "opened"):
        orders = _table(spark, sf_dir, "orders").where(F.col("o_orderstatus") == ("F" if kind == "filled" else "O")).select("o_orderkey")
        lines = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"), "left_semi")
    return staged(graphs.co_purchase(lines, 2 if kind == "sparse" else 1), kind)


def _pairs(where: str = "") -> str:
    return f"SELECT DISTINCT a.l_orderkey o, a.l_partkey u, b.l_partkey v FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_partkey < b.l_partkey {where}"


_EDGES = {
    "dense": f"SELECT DISTINCT u, v FROM ({_pairs()})",
    "sparse": f"SELECT u, v FROM ({_pairs()}) GROUP BY u, v HAVING count(*) >= 2",
    "filled": "SELECT DISTINCT u, v FROM (" + _pairs("JOIN orders ON o_orderkey = a.l_orderkey AND o_orderstatus = 'F'") + ")",
    "opened": "SELECT DISTINCT u, v FROM (" + _pairs("JOIN orders ON o_orderkey = a.l_orderkey AND o_orderstatus = 'O'") + ")",
}


def _with(kind: str, rest: str) -> str:
    return f"WITH RECURSIVE e AS MATERIALIZED ({_EDGES[kind]}), s AS (SELECT u AS n, v AS m FROM e UNION ALL SELECT v, u FROM e), d AS (SELECT n, count(*) AS deg FROM s GROUP BY n){rest}"


def _two(rest: str) -> str:
    both = ", ".join(f"{x} AS MATERIALIZED ({_EDGES[k]}), d{x} AS (SELECT n, count(*) AS deg FROM (SELECT u AS n FROM {x} UNION ALL SELECT v FROM {x}) GROUP BY n)" for x, k in (("a", "filled"), ("b", "opened")))
    return f"WITH {both}{rest}"


def query(sql: str | None = None):
    """Registers a function under its name, with the SQL that gives the same rows."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(_EDGES["dense"])
def graph_edges(spark, sf):
    return _graph(spark, sf, "dense")


@query(_with("dense", " SELECT n, deg FROM d"))
def graph_degrees(spark, sf):
    return structure.degrees(_graph(spark, sf, "dense"))


@query(_with("dense", " SELECT n AS nodes, m AS edges, round(2.0 * m / (n * (n - 1.0)), 9) AS density, round(2.0 * m / n, 9) AS mean_degree, x AS max_degree FROM (SELECT count(*)::DOUBLE AS n, (sum(deg) / 2)::DOUBLE AS m, max(deg) AS x FROM d)").replace("n AS nodes, m AS edges", "n::BIGINT AS nodes, m::BIGINT AS edges"))
def graph_stats(spark, sf):
    g = structure.graph_stats(_graph(spark, sf, "dense"))
    return g.select("nodes", "edges", F.round("density", 9).alias("density"), F.round("mean_degree", 9).alias("mean_degree"), "max_degree")


@query(_with("dense", " SELECT deg, count(*) AS nodes FROM d GROUP BY deg"))
def degree_histogram(spark, sf):
    return structure.degrees(_graph(spark, sf, "dense")).groupBy("deg").agg(F.count(F.lit(1)).alias("nodes"))


@query(_with("dense", f" SELECT k, c >= k AS anonymous, c AS smallest_class FROM (SELECT min(c) AS c FROM (SELECT count(*) AS c FROM d GROUP BY deg)), (SELECT unnest([{', '.join(map(str, KS))}]) AS k)"))
def k_degree_anonymity(spark, sf):
    return compare.k_degree(_graph(spark, sf, "dense"), KS)


_TRIANGLES = ", nb AS MATERIALIZED (SELECT u, list(v) AS l FROM e GROUP BY u), t AS MATERIALIZED (SELECT e.u AS x, e.v AS y, unnest(list_intersect(p.l, q.l)) AS z FROM e JOIN nb p ON p.u = e.u JOIN nb q ON q.u = e.v)"


@query(_with("sparse", _TRIANGLES + " SELECT x, y, z FROM t"))
def triangle_list(spark, sf):
    t = structure.triangles(_graph(spark, sf, "sparse")).select(F.array_sort(F.array("x", "y", "z")).alias("t"))
    return t.select(F.col("t")[0].alias("x"), F.col("t")[1].alias("y"), F.col("t")[2].alias("z"))


_CLUSTERING = _TRIANGLES + ", c AS (SELECT d.n, deg, coalesce(k, 0) AS triangles, CASE WHEN deg > 1 THEN 2.0 * coalesce(k, 0) / (deg * (deg - 1)) ELSE 0.0 END AS clustering FROM d LEFT JOIN (SELECT n, count(*) AS k FROM (SELECT x AS n FROM t UNION ALL SELECT y FROM t UNION ALL SELECT z FROM t) GROUP BY n) k ON k.n = d.n)"


@query(_with("dense", _CLUSTERING + " SELECT n, deg, triangles, round(clustering, 9) AS clustering FROM c"))
def local_clustering(spark, sf):
    return structure.clustering(_graph(spark, sf, "dense")).withColumn("clustering", F.round("clustering", 9))


@query(_with("sparse", _CLUSTERING + " SELECT count(*) AS nodes, (sum(triangles) / 3)::BIGINT AS triangles, round(avg(clustering), 9) AS average_clustering FROM c"))
def average_clustering(spark, sf):
    c = structure.clustering(_graph(spark, sf, "sparse"))
    return c.agg(F.count(F.lit(1)).alias("nodes"), (F.sum("triangles") / 3).cast("long").alias("triangles"), F.round(F.avg("clustering"), 9).alias("average_clustering"))


@query(_with("dense", " SELECT s.n, round(avg(d.deg), 9) AS avg_neighbour_degree FROM s JOIN d ON d.n = s.m GROUP BY s.n"))
def neighbour_degrees(spark, sf):
    return structure.neighbour_degree(_graph(spark, sf, "dense")).withColumn("avg_neighbour_degree", F.round("avg_neighbour_degree", 9))


_AA = "count(*) AS common, round(sum(CASE WHEN d.deg > 1 THEN 1 / ln(d.deg) ELSE 0 END), 9) AS adamic_adar"


@query(_with("sparse", f" SELECT a.m AS u, b.m AS v, {_AA} FROM s a JOIN s b ON a.n = b.n AND a.m < b.m JOIN d ON d.n = a.n GROUP BY a.m, b.m"))
def common_neighbours(spark, sf):
    return structure.common_neighbours(_graph(spark, sf, "sparse")).withColumn("adamic_adar", F.round("adamic_adar", 9))


@query(_with("dense", f" SELECT e.u, e.v, {_AA} FROM e JOIN s a ON a.n = e.u JOIN s b ON b.n = e.v AND a.m = b.m JOIN d ON d.n = a.m GROUP BY e.u, e.v"))
def edge_adamic_adar(spark, sf):
    return structure.edge_common_neighbours(_graph(spark, sf, "dense"), last=True).withColumn("adamic_adar", F.round("adamic_adar", 9))


@query(_with("sparse", ", r(n, c) AS (SELECT n, n FROM d UNION SELECT s.m, r.c FROM r JOIN s ON s.n = r.n WHERE r.c < s.m) SELECT n AS node, min(c) AS component FROM r GROUP BY n"))
def components(spark, sf):
    return connected_components(_graph(spark, sf, "sparse"))


@query(_with("sparse", ", h1 AS (SELECT n AS src, m AS dst FROM s), h2 AS (SELECT DISTINCT a.src, s.m AS dst FROM h1 a JOIN s ON s.n = a.dst), h3 AS (SELECT DISTINCT a.src, s.m AS dst FROM h2 a JOIN s ON s.n = a.dst), x AS (SELECT src, dst, min(k) AS dist FROM (SELECT *, 1 AS k FROM h1 UNION ALL SELECT *, 2 FROM h2 UNION ALL SELECT *, 3 FROM h3) WHERE src <> dst GROUP BY src, dst) SELECT src AS n, dist::BIGINT AS dist, count(*) AS nodes FROM x GROUP BY src, dist"))
def within_three_steps(spark, sf):
    g = _graph(spark, sf, "sparse")
    return structure.distances(g, graphs.nodes_of(g), 3).where("dist > 0").groupBy(F.col("src").alias("n"), "dist").agg(F.count(F.lit(1)).alias("nodes"))


@query(_with("sparse", ", h(n, c, t) AS (SELECT n, deg, 0 FROM d UNION ALL SELECT n, max(least(c, r)), max(t) + 1 FROM (SELECT s.n, h.c, h.t, row_number() OVER (PARTITION BY s.n ORDER BY h.c DESC) AS r FROM s JOIN h ON h.n = s.m WHERE h.t < 100) GROUP BY n) SELECT n, c AS core FROM h WHERE t = 100"))
def core_numbers(spark, sf):
    return structure.core_numbers(_graph(spark, sf, "sparse"))


_EGO = (
    _TRIANGLES + ", i AS MATERIALIZED (SELECT ego, p, q FROM (SELECT x AS ego, y AS p, z AS q FROM t UNION ALL SELECT y, x, z FROM t UNION ALL SELECT z, x, y FROM t) UNION ALL SELECT ego, q, p FROM (SELECT x AS ego, y AS p, z AS q FROM t UNION ALL SELECT y, x, z FROM t UNION ALL SELECT z, x, y FROM t)), "
    "er(ego, n, c) AS (SELECT n, m, m FROM s UNION SELECT er.ego, i.q, er.c FROM er JOIN i ON i.ego = er.ego AND i.p = er.n WHERE er.c < i.q), el AS (SELECT ego, n, min(c) AS c FROM er GROUP BY ego, n), "
    "ed AS (SELECT ego, p AS n, count(*) AS k FROM i GROUP BY ego, p), ec AS MATERIALIZED (SELECT el.ego, el.c, count(*) AS size, (sum(coalesce(k, 0)) / 2)::BIGINT AS edges, list(coalesce(k, 0) ORDER BY coalesce(k, 0) DESC)[1:6] AS degrees FROM el LEFT JOIN ed ON ed.ego = el.ego AND ed.n = el.n GROUP BY el.ego, el.c), "
    "en AS MATERIALIZED (SELECT ego, string_agg(size || ':' || edges || ':' || array_to_string(degrees, ','), '|' ORDER BY size DESC, edges DESC, degrees DESC) AS code FROM ec GROUP BY ego)"
)


@query(_with("sparse", _EGO + " SELECT ego, code FROM en"))
def ego_component_codes(spark, sf):
    return structure.ncc(_graph(spark, sf, "sparse"))


@query(_with("sparse", _EGO + f" SELECT k, c >= k AS anonymous, c AS smallest_class FROM (SELECT min(c) AS c FROM (SELECT count(*) AS c FROM en GROUP BY code)), (SELECT unnest([{', '.join(map(str, KS))}]) AS k)"))
def k_neighbourhood_anonymity(spark, sf):
    return compare.k_neighbourhood(structure.ncc(_graph(spark, sf, "sparse")), KS)


@query(_with("sparse", _EGO + _CLUSTERING.removeprefix(_TRIANGLES) + ", nd AS (SELECT s.n, avg(d.deg) AS a FROM s JOIN d ON d.n = s.m GROUP BY s.n), z AS (SELECT ego, list(size ORDER BY size DESC) AS l FROM ec GROUP BY ego) SELECT c.n, deg, triangles, round(clustering, 9) AS clustering, round(a, 9) AS avg_neighbour_degree, triangles AS ego_edges, l[1] AS largest, coalesce(l[2], 0) AS second FROM c JOIN nd ON nd.n = c.n JOIN z ON z.ego = c.n"))
def structural_signatures(spark, sf):
    s = structure.signatures(_graph(spark, sf, "sparse"))
    return s.withColumns({c: F.round(c, 9) for c in ("clustering", "avg_neighbour_degree")})


@query(_two(" SELECT count(*) FILTER (a = 1 AND b = 1) AS preserved, count(*) FILTER (a = 0) AS added, count(*) FILTER (b = 0) AS removed, count(*) FILTER (a + b = 1) AS changes FROM (SELECT u, v, max(x) AS a, max(y) AS b FROM (SELECT *, 1 AS x, 0 AS y FROM a UNION ALL SELECT *, 0, 1 FROM b) GROUP BY u, v)"))
def edge_changes(spark, sf):
    return compare.edge_changes(_graph(spark, sf, "filled"), _graph(spark, sf, "opened"))


@query(_two(" SELECT round(avg(abs(da.deg - coalesce(db.deg, 0))), 9) AS mae, round(sqrt(avg((da.deg - coalesce(db.deg, 0)) ** 2)), 9) AS rmse FROM da LEFT JOIN db USING (n)"))
def degree_loss(spark, sf):
    loss = compare.degree_loss(_graph(spark, sf, "filled"), _graph(spark, sf, "opened"))
    return loss.select(F.round("mae", 9).alias("mae"), F.round("rmse", 9).alias("rmse"))


@query(_two(", x AS (SELECT (SELECT count(*) FROM da) AS na, (SELECT count(*) FROM a) AS ma, (SELECT count(*) FROM db) AS nb, (SELECT count(*) FROM b) AS mb), y AS (SELECT *, 2.0 * ma / (na * (na - 1.0)) AS p, 2.0 * mb / (nb * (nb - 1.0)) AS q FROM x) SELECT na AS original_nodes, ma AS original_edges, round(p::DOUBLE, 9) AS original_density, nb AS published_nodes, mb AS published_edges, round(q::DOUBLE, 9) AS published_density, nb - na AS nodes_variation, mb - ma AS edges_variation, round((q - p)::DOUBLE, 9) AS density_variation FROM y").replace("2.0 *", "2.0::DOUBLE *"))
def structural_delta(spark, sf):
    d = compare.structural_delta(_graph(spark, sf, "filled"), _graph(spark, sf, "opened"))
    return d.select(*[F.round(c, 9).alias(c) if "density" in c else F.col(c) for c in d.columns])


@query(_two(", h AS (SELECT deg, coalesce(x, 0) AS x, coalesce(y, 0) AS y FROM (SELECT deg, count(*) AS x FROM da GROUP BY deg) FULL JOIN (SELECT deg, count(*) AS y FROM db GROUP BY deg) USING (deg)) SELECT round(sum(g), 9) AS distance FROM (SELECT abs(sum(x) OVER w / (SELECT sum(x) FROM h)::DOUBLE - sum(y) OVER w / (SELECT sum(y) FROM h)::DOUBLE) AS g FROM h WINDOW w AS (ORDER BY deg))"))
def degree_wasserstein(spark, sf):
    return compare.wasserstein(_graph(spark, sf, "filled"), _graph(spark, sf, "opened")).select(F.round("distance", 9).alias("distance"))


_SHORT = ", sc AS MATERIALIZED (SELECT ego AS n, list([size, edges] ORDER BY size DESC, edges DESC)[1:4] AS short FROM ec GROUP BY ego)"
_GROUPS = _EGO + _SHORT + f", k AS (SELECT d.n, deg, row_number() OVER (ORDER BY deg DESC, short, d.n) AS r, count(*) OVER () AS total FROM d JOIN sc ON sc.n = d.n), g AS MATERIALIZED (SELECT n, deg, g, row_number() OVER (PARTITION BY g ORDER BY n) - 1 AS pos FROM (SELECT *, least((r - 1) // {K}, greatest(total // {K} - 1, 0)) AS g FROM k))"


@query(_with("sparse", _GROUPS + " SELECT n, deg, pos, g FROM g"))
def fixed_groups(spark, sf):
    return anonymise.fixed_groups(_graph(spark, sf, "sparse"), K)


@query(_with("sparse", _GROUPS + ", c AS (SELECT g, count(*) AS size, round_even(avg(deg), 0)::BIGINT AS mean, round_even(median(deg), 0)::BIGINT AS median FROM g GROUP BY g) SELECT g, size, mean, median, a AS cost_mean, b AS cost_median, CASE WHEN a < b THEN mean ELSE median END AS target FROM (SELECT c.g, size, mean, median, sum(abs(deg - mean))::BIGINT AS a, sum(abs(deg - median))::BIGINT AS b FROM g JOIN c USING (g) GROUP BY ALL)"))
def group_costs(spark, sf):
    return anonymise.group_costs(anonymise.fixed_groups(_graph(spark, sf, "sparse"), K))


_RING = ", z AS (SELECT g, count(*) AS size FROM g GROUP BY g), ring AS (SELECT DISTINCT least(a.n, b.n) AS u, greatest(a.n, b.n) AS v FROM g a JOIN z USING (g) JOIN (SELECT unnest([1, 2]) AS step) ON step = 1 OR size >= 6 JOIN g b ON b.g = a.g AND b.pos = (a.pos + step) % size WHERE a.n <> b.n)"
_OUTSIDE = ", o AS MATERIALIZED (SELECT s.n, s.m, a.g, b.deg AS m_deg FROM s JOIN g a ON a.n = s.n JOIN g b ON b.n = s.m WHERE a.g <> b.g), w AS (SELECT g.g, round_even(median(coalesce(c, 0)), 0)::BIGINT AS wanted FROM g LEFT JOIN (SELECT n, count(*) AS c FROM o GROUP BY n) x ON x.n = g.n GROUP BY g.g), p AS (SELECT g, m FROM (SELECT g, m, row_number() OVER (PARTITION BY g ORDER BY count(*) DESC, m_deg, m) AS r FROM o GROUP BY g, m, m_deg) JOIN w USING (g) WHERE r <= wanted), ext AS (SELECT DISTINCT least(g.n, m) AS u, greatest(g.n, m) AS v FROM p JOIN g USING (g))"


@query(_with("sparse", _GROUPS + _RING + " SELECT u, v FROM ring EXCEPT SELECT u, v FROM e"))
def ring_template(spark, sf):
    g = _graph(spark, sf, "sparse")
    return anonymise.ring_template(g, anonymise.fixed_groups(g, K))


@query(_with("sparse", _GROUPS + _OUTSIDE + " SELECT u, v FROM ext EXCEPT SELECT u, v FROM e"))
def external_template(spark, sf):
    g = _graph(spark, sf, "sparse")
    return anonymise.external_template(g, anonymise.fixed_groups(g, K))


@query(_with("sparse", _GROUPS + _RING + _OUTSIDE + " SELECT u, v FROM e UNION SELECT u, v FROM ring UNION SELECT u, v FROM ext"))
def published_graph(spark, sf):
    return anonymise.publish(_graph(spark, sf, "sparse"), K)


@query(_with("dense", " SELECT u, v, 1 + ('0x' || substr(md5(concat_ws('|', '42', u::VARCHAR, v::VARCHAR)), 1, 8))::BIGINT % 99 AS w FROM e"))
def edge_weights(spark, sf):
    return anonymise.edge_weights(_graph(spark, sf, "dense"))


@query(_with("dense", ", c AS (SELECT e.u, e.v, count(*) AS k FROM e JOIN s a ON a.n = e.u JOIN s b ON b.n = e.v AND a.m = b.m GROUP BY e.u, e.v) SELECT e.u, e.v, round((x.deg + y.deg - 2 * coalesce(k, 0)) / (2.0::DOUBLE * (SELECT max(deg) FROM d)), 9) AS nc, coalesce(k, 0) AS common FROM e JOIN d x ON x.n = e.u JOIN d y ON y.n = e.v LEFT JOIN c ON c.u = e.u AND c.v = e.v"))
def edge_significance(spark, sf):
    return _significance(_graph(spark, sf, "dense"))


def _significance(edges: DataFrame) -> DataFrame:
    return anonymise.edge_significance(edges, last=True).withColumn("nc", F.round("nc", 9))


@query(_with("sparse", ", x AS (SELECT e.u, e.v, a.deg + b.deg - 3 AS x FROM e JOIN d a ON a.n = e.u JOIN d b ON b.n = e.v), near AS (SELECT n, m AS c FROM s UNION SELECT n, n FROM d), b AS (SELECT DISTINCT e.u, e.v, f.u AS p, f.v AS q, f.x FROM e JOIN near ON near.n IN (e.u, e.v) JOIN x f ON near.c IN (f.u, f.v) WHERE NOT (f.u = e.u AND f.v = e.v)) SELECT x.u, x.v, (x.x * coalesce((SELECT sum(b.x) FROM b WHERE b.u = x.u AND b.v = x.v), 0))::BIGINT AS lci FROM x"))
def line_influence(spark, sf):
    return anonymise.influence(_graph(spark, sf, "sparse"))


def _voted(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(n, guess): the label that most neighbours have, ties to the first."""
    ways = graphs.both_ways(edges).join(labels.select(F.col("n").alias("m"), F.col("y").alias("b")), "m")
    votes = spread(ways, 2 * edges.count(), "n").groupBy("n", "b").agg(F.count(F.lit(1)).alias("k"))
    return votes.groupBy("n").agg(F.min(F.struct((-F.col("k")).alias("k"), "b"))["b"].alias("guess"))


@query(_with("dense", ", c AS (SELECT s.n, p.p_brand AS b, count(*) AS k FROM s JOIN part p ON p.p_partkey = s.m GROUP BY s.n, p.p_brand), g AS (SELECT n, first(b ORDER BY k DESC, b) AS guess FROM c GROUP BY n), x AS (SELECT p_brand AS y, guess FROM part JOIN g ON n = p_partkey), t AS (SELECT k, sum(t) AS t, sum(s) AS s, sum(h) AS h FROM (SELECT y AS k, 1 AS t, 0 AS s, (y = guess)::INT AS h FROM x UNION ALL SELECT guess, 0, 1, 0 FROM x) GROUP BY k) SELECT sum(t)::BIGINT AS rows, round(sum(h) / sum(t), 9) AS accuracy, round(avg(2.0::DOUBLE * h / (t + s)), 9) AS macro_f1, round(2.0::DOUBLE * sum(h) / (sum(t) + sum(s)), 9) AS micro_f1 FROM t"))
def neighbour_vote(spark, sf):
    parts = _table(spark, sf, "part").select(F.col("p_partkey").alias("n"), F.col("p_brand").alias("y"))
    guess = _voted(_graph(spark, sf, "dense"), parts)
    c = evaluate.classification(parts.join(guess, "n"))
    return c.select("rows", *[F.round(x, 9).alias(x) for x in ("accuracy", "macro_f1", "micro_f1")])


@query("SELECT p_partkey, p_brand, CASE WHEN r <= a THEN 'train' WHEN r <= a + floor(n * 0.2) THEN 'val' ELSE 'test' END AS part FROM (SELECT *, greatest(1, floor(n * 0.6)) AS a FROM (SELECT p_partkey, p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY md5(concat_ws('|', '42', p_partkey::VARCHAR)), p_partkey) AS r, count(*) OVER (PARTITION BY p_brand) AS n FROM part))")
def stratified_split(spark, sf):
    return evaluate.stratified_split(_table(spark, sf, "part"), "p_partkey", "p_brand")


def _results(spark, sf):
    """Order lines as runs: a return flag is a method, a line number a k, a line status a data set."""
    return _table(spark, sf, "lineitem").select(F.col("l_linestatus").alias("dataset"), F.col("l_linenumber").cast("long").alias("k"), F.col("l_returnflag").alias("method"), F.col("l_discount").cast("double").alias("loss"), F.col("l_quantity").cast("double").alias("score"), F.col("l_extendedprice").cast("double").alias("cost"))


_RUNS = "(SELECT l_linestatus AS dataset, l_linenumber::BIGINT AS k, l_returnflag AS method, l_discount::DOUBLE AS loss, l_quantity::DOUBLE AS score, l_extendedprice::DOUBLE AS cost FROM lineitem)"


@query(f"SELECT dataset, k, method, round(avg(loss), 6) AS loss_mean, round(coalesce(stddev_samp(loss), 0), 6) AS loss_std, round(avg(score), 6) AS score_mean, round(coalesce(stddev_samp(score), 0), 6) AS score_std FROM {_RUNS} GROUP BY ALL")
def results_summary(spark, sf):
    s = evaluate.summary(_results(spark, sf), ["dataset", "k", "method"], ["loss", "score"])
    return s.select("dataset", "k", "method", *[F.round(c, 6).alias(c) for c in s.columns[3:]])


_MEANS = f"(SELECT k, method, round(avg(score), 6) AS s FROM {_RUNS} GROUP BY k, method)"


def _means(spark, sf):
    return _results(spark, sf).groupBy("k", "method").agg(F.round(F.avg("score"), 6).alias("s"))


@query(f"SELECT k, method, s, row_number() OVER (PARTITION BY k ORDER BY s DESC, method) AS rank FROM {_MEANS}")
def method_ranking(spark, sf):
    return evaluate.rank_within(_means(spark, sf), "k", "s", "method").withColumn("rank", F.col("rank").cast("long"))


@query(f"SELECT k, first(method ORDER BY s DESC, method) AS best, last(method ORDER BY s DESC, method) AS worst, max(s) AS best_score FROM {_MEANS} GROUP BY k")
def best_and_worst(spark, sf):
    return evaluate.best_worst(_means(spark, sf), "k", "s", "method")


@query(f"SELECT method, round(arg_max(s, k) - arg_min(s, k), 6) AS change FROM {_MEANS} GROUP BY method")
def first_to_last(spark, sf):
    return evaluate.trend(_means(spark, sf), "method", "k", "s").select("method", F.round("change", 6).alias("change"))


@query(f"SELECT dataset, method, round(avg(loss / nullif(score, 0) + 0), 9) AS ratio, round(avg((loss + score) / 2), 6) AS utility FROM {_RUNS} GROUP BY ALL")
def utility_scores(spark, sf):
    r = _results(spark, sf).withColumn("ratio", evaluate.safe_ratio(F.col("loss"), F.col("score"))).withColumn("u", evaluate.mean_of(F.col("loss"), F.col("score"), F.lit(float("nan"))))
    return r.groupBy("dataset", "method").agg(F.round(F.avg("ratio"), 9).alias("ratio"), F.round(F.avg("u"), 6).alias("utility"))


_TREE = "SELECT 'n' || n_nationkey AS child, 'r' || n_regionkey AS parent FROM nation UNION ALL SELECT 'r' || r_regionkey, '*' FROM region UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier"


def _tree(spark, sf):
    key = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    nation, region, supplier = (_table(spark, sf, t) for t in ("nation", "region", "supplier"))
    return (
        nation.select(key("n", "n_nationkey").alias("child"), key("r", "n_regionkey").alias("parent"))
        .unionByName(region.select(key("r", "r_regionkey").alias("child"), F.lit("*").alias("parent")))
        .unionByName(supplier.select(key("s", "s_suppkey").alias("child"), key("n", "s_nationkey").alias("parent")))
    )


@query(f"WITH RECURSIVE t AS ({_TREE}), a(node, ancestor, up) AS (SELECT x, x, 0 FROM (SELECT child AS x FROM t UNION SELECT parent FROM t) UNION ALL SELECT a.node, t.parent, up + 1 FROM a JOIN t ON t.child = a.ancestor), l AS (SELECT child FROM t WHERE child NOT IN (SELECT parent FROM t)), c AS (SELECT ancestor AS node, count(*) AS leaves FROM a JOIN l ON l.child = a.node GROUP BY ancestor) SELECT node, leaves, round(leaves / (SELECT count(*) FROM l)::DOUBLE, 9) AS ncp FROM c")
def hierarchy_costs(spark, sf):
    return hierarchy.leaf_costs(_tree(spark, sf)).withColumn("ncp", F.round("ncp", 9))


@query(f"WITH RECURSIVE t AS ({_TREE}), a(node, ancestor, up) AS (SELECT x, x, 0 FROM (SELECT child AS x FROM t UNION SELECT parent FROM t) UNION ALL SELECT a.node, t.parent, up + 1 FROM a JOIN t ON t.child = a.ancestor), p AS (SELECT DISTINCT 's' || l_suppkey AS u, 'n' || c_nationkey AS v FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey) SELECT u, v, first(x.ancestor ORDER BY x.up) AS lca FROM p JOIN a x ON x.node = u JOIN a y ON y.node = v AND y.ancestor = x.ancestor GROUP BY u, v")
def common_ancestors(spark, sf):
    lines, orders, customer = (_table(spark, sf, t) for t in ("lineitem", "orders", "customer"))
    pairs = lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"]).join(customer, customer["c_custkey"] == orders["o_custkey"])
    return hierarchy.common_ancestor(_tree(spark, sf), pairs.select(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("u"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("v")).distinct())


def _grown(i: int) -> str:
    """One round of the mapping m<i>: pairs of free nodes that stand out for both of their ends join it."""

    def best(side: str, other: str) -> str:
        return f"SELECT x, y FROM (SELECT *, row_number() OVER w AS r, coalesce(lead(s) OVER w, 0) AS nx, stddev_pop(s) OVER (PARTITION BY {side}) AS dev FROM t{i} WINDOW w AS (PARTITION BY {side} ORDER BY s DESC, {other})) WHERE r = 1 AND round(s - nx, 9) >= round(0.5::DOUBLE * dev, 9) AND s > nx"

    return (
        f", v{i} AS (SELECT a.m AS x, b.m AS y, count(*) AS c FROM m{i} JOIN s a ON a.n = src JOIN ps b ON b.n = dst GROUP BY ALL), "
        f"t{i} AS MATERIALIZED (SELECT x, y, c / sqrt(d.deg * pd.deg::DOUBLE) AS s FROM v{i} JOIN d ON d.n = x JOIN pd ON pd.n = y WHERE x NOT IN (SELECT src FROM m{i}) AND y NOT IN (SELECT dst FROM m{i})), "
        f"m{i + 1} AS MATERIALIZED (SELECT src, dst FROM m{i} UNION ALL (({best('x', 'y')}) INTERSECT ({best('y', 'x')})))"
    )


#: Rounds of the SQL; at its scale the mapping ends before.
_ROUNDS = 24
_SEEDS = f", pub AS MATERIALIZED ({SQL['published_graph']}), ps AS MATERIALIZED (SELECT u AS n, v AS m FROM pub UNION ALL SELECT v, u FROM pub), pd AS MATERIALIZED (SELECT n, count(*) AS deg FROM ps GROUP BY n), m0 AS MATERIALIZED (SELECT n AS src, n AS dst FROM (SELECT n, row_number() OVER (ORDER BY deg DESC, n) AS r FROM d) WHERE r <= greatest(5, least(50, round_even(0.01 * (SELECT count(*) FROM d), 0))))"


@query(_with("sparse", _SEEDS + "".join(map(_grown, range(_ROUNDS))) + f" SELECT count(*) AS mapped, coalesce(sum((src = dst)::INT), 0)::BIGINT AS correct, 100.0::DOUBLE * sum((src = dst)::INT) / count(*) AS percent FROM m{_ROUNDS}"))
def reidentification(spark, sf):
    g = _graph(spark, sf, "sparse")
    return attack.success(attack.propagate(g, anonymise.publish(g, K), attack.seeds(g)))


@query(_with("sparse", _GROUPS + ", q AS (SELECT g.g, n, row_number() OVER (PARTITION BY g.g ORDER BY deg DESC, n) AS r, count(*) OVER (PARTITION BY g.g) AS size FROM g), x AS (SELECT g, n AS m FROM q WHERE r <= least(3, size - 1)) SELECT DISTINCT least(n, m) AS u, greatest(n, m) AS v FROM g JOIN x USING (g) WHERE n <> m EXCEPT SELECT u, v FROM e"))
def anchor_template(spark, sf):
    g = _graph(spark, sf, "sparse")
    return anonymise.anchor_template(g, anonymise.fixed_groups(g, K))


@query(_with("sparse", _GROUPS + " SELECT a.n AS u, b.n AS v FROM g a JOIN g b ON a.g = b.g AND a.n < b.n EXCEPT SELECT u, v FROM e"))
def clique_template(spark, sf):
    g = _graph(spark, sf, "sparse")
    return anonymise.clique_template(g, anonymise.fixed_groups(g, K))


@query(_with("sparse", _GROUPS + " SELECT g, count(*) AS size, min(deg) AS low, max(deg) AS high, round_even(median(deg), 0)::BIGINT AS median_degree FROM g GROUP BY g"))
def group_profile(spark, sf):
    return anonymise.group_profile(anonymise.fixed_groups(_graph(spark, sf, "sparse"), K))


_COMPONENTS = ", r(n, c) AS (SELECT n, n FROM d UNION SELECT s.m, r.c FROM r JOIN s ON s.n = r.n WHERE r.c < s.m), cc AS MATERIALIZED (SELECT n AS node, min(c) AS component FROM r GROUP BY n)"


@query(_with("sparse", _COMPONENTS + " SELECT component, count(*) AS size FROM cc GROUP BY component"))
def component_sizes(spark, sf):
    return connected_components(_graph(spark, sf, "sparse")).groupBy("component").agg(F.count(F.lit(1)).alias("size"))


@query(_with("sparse", _COMPONENTS + ", b(n, dist) AS (SELECT DISTINCT component, 0 FROM cc UNION SELECT s.m, b.dist + 1 FROM b JOIN s ON s.n = b.n WHERE b.dist < 24), l AS MATERIALIZED (SELECT n, min(dist) AS dist FROM b GROUP BY n) SELECT x.n, min(s.m) AS parent FROM l x JOIN s ON s.n = x.n JOIN l y ON y.n = s.m AND y.dist = x.dist - 1 GROUP BY x.n"))
def spanning_forest(spark, sf):
    g = _graph(spark, sf, "sparse")
    return segments.grown_forest(g, staged(connected_components(g), "components"))


#: Distances from every node, each pair once.
_FAR = ", far(src, n, dist) USING KEY (src, n) AS (SELECT n, n, 0 FROM d UNION SELECT x.src, s.m, x.dist + 1 FROM far x JOIN s ON s.n = x.n LEFT JOIN recurring.far y ON y.src = x.src AND y.n = s.m WHERE y.n IS NULL)"
_LENGTHS = " SELECT (c / 2)::BIGINT AS pairs, round(t / c, 9) AS reachable_mean, round(t / (nodes * (nodes - 1)), 9) AS all_pairs_mean, longest FROM (SELECT count(*)::DOUBLE AS c, sum(dist)::DOUBLE AS t, max(dist)::BIGINT AS longest FROM far WHERE dist > 0), (SELECT count(*)::DOUBLE AS nodes FROM d)"


@query(_with("sparse", _FAR + _LENGTHS))
def path_lengths(spark, sf):
    g = _graph(spark, sf, "sparse")
    nodes = staged(graphs.nodes_of(g), "nodes")
    p = structure.path_lengths(structure.distances(g, nodes), nodes.count())
    return p.select("pairs", F.round("reachable_mean", 9).alias("reachable_mean"), F.round("all_pairs_mean", 9).alias("all_pairs_mean"), "longest")


_CODES = (
    ", cr AS MATERIALIZED (SELECT ego AS n, size, edges, degrees, row_number() OVER (PARTITION BY ego ORDER BY size DESC, edges DESC, degrees DESC) AS r FROM ec), "
    "cv AS MATERIALIZED (SELECT n, r, 0 AS i, size AS x FROM cr UNION ALL SELECT n, r, 1, edges FROM cr UNION ALL SELECT n, r, unnest(range(2, 2 + len(degrees))), unnest(degrees) FROM cr), cw AS MATERIALIZED (SELECT n, sum(x) AS w FROM cv GROUP BY n)"
)


def _apart(pairs: str) -> str:
    """The code distances of a table of pairs, from numbers that meet at the same component and place."""
    both = f"SELECT u, v, r, i, x FROM {pairs} JOIN cv ON cv.n = u UNION ALL SELECT u, v, r, i, -x FROM {pairs} JOIN cv ON cv.n = v"
    return f"SELECT u, v, sum(x)::DOUBLE / max(greatest(a.w, b.w, 1))::DOUBLE AS distance FROM (SELECT u, v, r, i, abs(sum(x)) AS x FROM ({both}) GROUP BY u, v, r, i) JOIN cw a ON a.n = u JOIN cw b ON b.n = v GROUP BY u, v"


@query(_with("sparse", _EGO + _CODES + f" SELECT u, v, round(distance, 9) AS distance FROM ({_apart('e')})"))
def ego_code_distances(spark, sf):
    g = _graph(spark, sf, "sparse")
    return structure.ncc_distance(staged(structure.ncc_codes(g), "codes"), g).withColumn("distance", F.round("distance", 9))


def _segments_sql(power: int) -> str:
    """Segments one after another: r holds each step of each segment's end."""
    x = lambda s, e: f"list_slice(l, {s} + 1, {e})"
    cost = lambda x: f"least(list_sum([abs(v - round_even(list_avg({x}), 0)) ** {power} for v in {x}]), list_sum([abs(v - round_even(list_aggregate({x}, 'median'), 0)) ** {power} for v in {x}]))"
    more = f"total - e >= {K} + 1 AND {cost(x('s', 'e + 1'))} + {cost(x('e + 1', f'e + 1 + {K}'))} < {cost(x('s', 'e'))} + {cost(x('e', f'e + {K}'))}"
    first = f"CASE WHEN total - {{0}} >= {2 * K} THEN {{0}} + {K} ELSE total END"
    mean, median = "round_even(list_avg(x), 0)::BIGINT", "round_even(list_aggregate(x, 'median'), 0)::BIGINT"
    sums = lambda m: f"list_sum([abs(v - {m}) ** {power} for v in x])"
    return _with("dense", f""", o AS MATERIALIZED (SELECT n, deg, row_number() OVER (ORDER BY deg DESC, n) AS rank FROM d), a AS MATERIALIZED (SELECT list(deg ORDER BY rank) AS l, count(*) AS total FROM o),
    r(s, e, l, total) AS (SELECT 0::BIGINT, {first.format("0::BIGINT")}, l, total FROM a UNION ALL
      SELECT CASE WHEN m THEN s ELSE e END, CASE WHEN m THEN e + 1 ELSE {first.format("e")} END, l, total FROM (SELECT *, {more} AS m FROM r WHERE e < total)),
    g AS MATERIALIZED (SELECT s, e, row_number() OVER (ORDER BY s) - 1 AS segment, list_slice((SELECT l FROM a), s + 1, e) AS x FROM (SELECT s, max(e) AS e FROM r GROUP BY s)),
    t AS (SELECT s, e, segment, CASE WHEN {sums(mean)} < {sums(median)} THEN {mean} ELSE {median} END AS target FROM g)
    SELECT n, deg, rank, segment, target FROM o JOIN t ON rank > s AND rank <= e""")


@query(_segments_sql(1))
def degree_segments_mae(spark, sf):
    return segments.degree_segments(_graph(spark, sf, "dense"), K)


@query(_segments_sql(2))
def degree_segments_squared(spark, sf):
    return segments.degree_segments(_graph(spark, sf, "dense"), K, squared=True)


def _rewired(i: int) -> str:
    """One round that moves the edges of now<i> towards the targets t."""
    return (
        f", p{i} AS MATERIALIZED (SELECT t.n, coalesce(c, 0) - target AS gap FROM t LEFT JOIN (SELECT n, count(*) AS c FROM (SELECT u AS n FROM now{i} UNION ALL SELECT v FROM now{i}) GROUP BY n) USING (n)), "
        f"c{i} AS (SELECT u, v, md5(concat_ws('|', '{i}', u::VARCHAR, v::VARCHAR)) AS h, a.gap AS du, b.gap AS dv FROM now{i} JOIN p{i} a ON a.n = u AND a.gap > 0 JOIN p{i} b ON b.n = v AND b.gap > 0), "
        f"x{i} AS (SELECT u, v FROM (SELECT u, v, most, row_number() OVER (PARTITION BY n ORDER BY h) AS r FROM (SELECT u, v, h, u AS n, du AS most FROM c{i} UNION ALL SELECT u, v, h, v, dv FROM c{i})) GROUP BY u, v HAVING bool_and(r <= most)), "
        f"w{i} AS MATERIALIZED (SELECT n, md5(concat_ws('|', 'w{i}', n::VARCHAR, j::VARCHAR)) AS h FROM (SELECT n, unnest(range(1, 1 - gap)) AS j FROM p{i} WHERE gap < 0)), "
        f"y{i} AS (SELECT n, row_number() OVER z AS r, lead(n) OVER z AS m FROM w{i} WINDOW z AS (PARTITION BY ('0x' || substr(h, 1, 8))::BIGINT % (SELECT greatest(1, count(*) // 4096) FROM w{i}) ORDER BY h)), "
        f"now{i + 1} AS MATERIALIZED ((SELECT u, v FROM now{i} EXCEPT SELECT u, v FROM x{i}) UNION ALL (SELECT least(n, m), greatest(n, m) FROM y{i} WHERE r % 2 = 1 AND n <> m EXCEPT SELECT u, v FROM now{i}))"
    )


@query(_with("dense", f", t AS MATERIALIZED (SELECT n, target FROM ({SQL['degree_segments_mae']})), now0 AS (SELECT u, v FROM e)" + "".join(map(_rewired, range(3))) + " SELECT u, v FROM now3"))
def rewired_graph(spark, sf):
    g = _graph(spark, sf, "dense")
    return segments.rewire(g, staged(segments.degree_segments(g, K).select("n", "deg", "target"), "targets"))


@query(_with("sparse", _GROUPS + _RING + _OUTSIDE + ", pub AS MATERIALIZED (SELECT u, v FROM e UNION SELECT u, v FROM ring UNION SELECT u, v FROM ext), pd AS (SELECT n, count(*) AS deg FROM (SELECT u AS n FROM pub UNION ALL SELECT v FROM pub) GROUP BY n) SELECT (SELECT count(*) FROM e) AS preserved, (SELECT count(*) FROM pub) - (SELECT count(*) FROM e) AS added, 0::BIGINT AS removed, (SELECT min(c) FROM (SELECT count(*) AS c FROM pd GROUP BY deg)) AS smallest_class, (SELECT round(avg(pd.deg - d.deg), 9) FROM d JOIN pd USING (n)) AS mae"))
def published_diagnosis(spark, sf):
    g = _graph(spark, sf, "sparse")
    p = staged(anonymise.publish(g, K), "published")
    changes = compare.edge_changes(g, p).select("preserved", "added", "removed")
    least = compare.k_degree(p, (K,)).select("smallest_class")
    return changes.crossJoin(least).crossJoin(compare.degree_loss(g, p).select(F.round("mae", 9).alias("mae")))  # a row each


@query("WITH m AS (SELECT o_orderpriority AS method, o_orderstatus AS k, round(avg(o_totalprice), 4) AS s FROM orders WHERE o_orderpriority <> '5-LOW' OR o_orderstatus <> 'F' GROUP BY ALL) SELECT a.method, b.k, s, s IS NOT NULL AS present FROM (SELECT DISTINCT method FROM m) a CROSS JOIN (SELECT DISTINCT k FROM m) b LEFT JOIN m ON m.method = a.method AND m.k = b.k")
def filled_grid(spark, sf):
    orders = _table(spark, sf, "orders").where("o_orderpriority <> '5-LOW' OR o_orderstatus <> 'F'")
    means = orders.groupBy(F.col("o_orderpriority").alias("method"), F.col("o_orderstatus").alias("k")).agg(F.round(F.avg("o_totalprice"), 4).alias("s"))
    return evaluate.fill_grid(staged(means, "means"), "method", "k", "s")


@query()
def neighbour_classes(spark, sf):
    g = _graph(spark, sf, "dense")
    labels = _table(spark, sf, "part").select(F.col("p_partkey").alias("n"), (F.col("p_size") > 25).cast("long").alias("y"))
    return evaluate.classification(learn.predict(g, labels))


@query(_two(", h AS (SELECT deg, coalesce(x, 0) AS x, coalesce(y, 0) AS y FROM (SELECT deg, count(*) AS x FROM da GROUP BY deg) FULL JOIN (SELECT deg, count(*) AS y FROM db GROUP BY deg) USING (deg)), w AS (SELECT sum(g) AS w FROM (SELECT abs(sum(x) OVER w / (SELECT sum(x) FROM h)::DOUBLE - sum(y) OVER w / (SELECT sum(y) FROM h)::DOUBLE) AS g FROM h WINDOW w AS (ORDER BY deg))) SELECT round(w + 0.5::DOUBLE * (SELECT sum(abs(da.deg - coalesce(db.deg, 0))) FROM da LEFT JOIN db USING (n)), 6) AS cost FROM w"))
def wr_cost(spark, sf):
    return compare.wr_cost(_graph(spark, sf, "filled"), _graph(spark, sf, "opened")).select(F.round("cost", 6).alias("cost"))


@query(_two(" SELECT u, v FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT u, v FROM (SELECT * FROM b EXCEPT SELECT * FROM a)"))
def toggled_graph(spark, sf):
    return structure.toggled(_graph(spark, sf, "filled"), _graph(spark, sf, "opened"))


@query(_with("dense", ", w AS (SELECT u, v, 1 + ('0x' || substr(md5(concat_ws('|', '42', u::VARCHAR, v::VARCHAR)), 1, 8))::BIGINT % 99 AS w FROM e) SELECT (SELECT min(w) FROM w) AS least_weight, round(avg(deg), 9) AS mean_degree FROM d"))
def network_stats(spark, sf):
    return structure.network_stats(anonymise.edge_weights(_graph(spark, sf, "dense"))).withColumn("mean_degree", F.round("mean_degree", 9))


_SMALL = "(SELECT p_partkey FROM part WHERE p_size <= 25)"


@query(_with("dense", f" SELECT u, v FROM e WHERE u IN {_SMALL} AND v IN {_SMALL}"))
def induced_graph(spark, sf):
    return structure.induced(_graph(spark, sf, "dense"), _table(spark, sf, "part").where("p_size <= 25").select(F.col("p_partkey").alias("n")))


@query(_with("dense", " SELECT n FROM (SELECT n, row_number() OVER (ORDER BY deg DESC, n) AS r FROM d) WHERE r <= 50"))
def display_nodes(spark, sf):
    return structure.display_nodes(_graph(spark, sf, "dense"), 50)


@query(_with("dense", " SELECT least(u::VARCHAR, v::VARCHAR) AS u, greatest(u::VARCHAR, v::VARCHAR) AS v FROM e"))
def string_edges(spark, sf):
    return graphs.string_edges(_graph(spark, sf, "dense"))


@query(_with("dense", ", c AS (SELECT s.n, p.p_brand AS b, count(*) AS k FROM s JOIN part p ON p.p_partkey = s.m GROUP BY s.n, p.p_brand), g AS (SELECT n, first(b ORDER BY k DESC, b) AS guess FROM c GROUP BY n) SELECT round(avg(r), 9) AS macro_recall FROM (SELECT avg((p_brand = guess)::INT) AS r FROM part JOIN g ON n = p_partkey GROUP BY p_brand)"))
def vote_recall(spark, sf):
    parts = _table(spark, sf, "part").select(F.col("p_partkey").alias("n"), F.col("p_brand").alias("y"))
    guess = _voted(_graph(spark, sf, "dense"), parts)
    return evaluate.macro_recall(parts.join(guess, "n")).select(F.round("macro_recall", 9).alias("macro_recall"))


@query(_with("sparse", _GROUPS + ", c AS (SELECT g, round_even(avg(deg), 0)::BIGINT AS target FROM g GROUP BY g) SELECT g, target FROM (SELECT g, target, row_number() OVER (ORDER BY abs(target - (SELECT avg(deg) FROM d)), g) AS r FROM c) WHERE r = 1"))
def target_group(spark, sf):
    groups = anonymise.fixed_groups(_graph(spark, sf, "sparse"), K)
    mean = groups.agg(F.avg("deg")).first()[0] or 0.0
    return evaluate.closest(anonymise.group_costs(groups).select("g", F.col("mean").alias("target")), "target", F.lit(mean), "g")


@query(_with("sparse", _GROUPS + ", pr AS MATERIALIZED (SELECT a.g, a.n AS u, b.n AS v FROM g a JOIN g b ON a.g = b.g AND a.n < b.n), cn AS MATERIALIZED (SELECT pr.g, pr.u, pr.v, coalesce(c, 0) AS c FROM pr LEFT JOIN (SELECT pr.u, pr.v, count(*) AS c FROM pr JOIN s a ON a.n = pr.u JOIN s b ON b.n = pr.v AND a.m = b.m GROUP BY pr.u, pr.v) USING (u, v)), mm AS (SELECT n, avg(c) AS m FROM (SELECT u AS n, c FROM cn UNION ALL SELECT v, c FROM cn) GROUP BY n) SELECT g.g, g.n, round(CASE WHEN m IS NULL THEN 0 ELSE 1 - least(m / (SELECT max(deg) FROM d), 1) END, 9) AS distance FROM g LEFT JOIN mm ON mm.n = g.n"))
def neighbour_scores(spark, sf):
    g = _graph(spark, sf, "sparse")
    return anonymise.neighbour_scores(g, anonymise.fixed_groups(g, K)).withColumn("distance", F.round("distance", 9))


@query(_with("sparse", _GROUPS + _COMPONENTS + ", cm AS MATERIALIZED (SELECT node AS n, component AS c FROM cc), gc AS MATERIALIZED (SELECT g.g, g.n, c FROM g JOIN cm ON cm.n = g.n), oc AS (SELECT a.g, a.n, a.c, b.c AS other, count(*) AS k FROM gc a JOIN gc b ON a.g = b.g AND a.n <> b.n GROUP BY ALL), mj AS (SELECT g, n, c, first(other ORDER BY k DESC, other) AS major, sum(k) AS others, sum(k) FILTER (other <> c) AS apart FROM oc GROUP BY g, n, c) SELECT gc.g, gc.n, round(CASE WHEN major IS NULL OR gc.c = major THEN 0 ELSE apart / others::DOUBLE END, 9) AS distance FROM gc LEFT JOIN mj ON mj.n = gc.n"))
def community_scores(spark, sf):
    g = _graph(spark, sf, "sparse")
    parts = connected_components(g).select(F.col("node").alias("n"), F.col("component").alias("c"))
    return anonymise.community_scores(anonymise.fixed_groups(g, K), parts).withColumn("distance", F.round("distance", 9))


_APART = _CODES + f", gp AS MATERIALIZED (SELECT a.g, a.n AS u, b.n AS v, abs(a.deg - b.deg) AS gap FROM g a JOIN g b ON a.g = b.g AND a.n <> b.n), ap AS MATERIALIZED ({_apart('gp')})"


@query(_with("sparse", _GROUPS + _APART + ", md AS (SELECT g.g, first(g.n ORDER BY coalesce(m, 0), deg DESC, g.n) AS medoid, round_even(median(deg), 0)::BIGINT AS mid FROM g LEFT JOIN (SELECT u, round(avg(distance), 9) AS m FROM ap GROUP BY u) x ON x.u = g.n GROUP BY g.g) SELECT g.g, g.n, round(0.5::DOUBLE * abs(deg - mid) / greatest((SELECT max(deg) FROM g), 1) + 0.5::DOUBLE * coalesce(distance, 0), 9) AS score FROM g JOIN md ON md.g = g.g LEFT JOIN ap ON ap.u = g.n AND ap.v = medoid"))
def profile_scores(spark, sf):
    g = _graph(spark, sf, "sparse")
    return anonymise.profile_scores(anonymise.fixed_groups(g, K), staged(structure.ncc_codes(g), "codes")).withColumn("score", F.round("score", 9))


_COSTS = _GROUPS + _APART + (
    ", dm AS (SELECT u AS n, avg(gap) AS gap, avg(distance) AS code FROM gp JOIN ap USING (u, v) GROUP BY u)"
    f", nsc AS MATERIALIZED ({SQL['neighbour_scores']}), csc AS MATERIALIZED ({SQL['community_scores']})"
    ", x AS (SELECT g.g, g.n, coalesce(gap, 0) / greatest((SELECT max(deg) FROM g), 1)::DOUBLE AS degree, coalesce(code, 0) AS code, nsc.distance AS neighbours, csc.distance AS community FROM g LEFT JOIN dm ON dm.n = g.n JOIN nsc ON nsc.n = g.n JOIN csc ON csc.n = g.n)"
    " SELECT g, n, round(degree, 6) AS degree, round(code, 6) AS code, round(neighbours, 6) AS neighbours, round(community, 6) AS community, round(1.0::DOUBLE * degree + 0.2::DOUBLE * code + 0.2::DOUBLE * neighbours + 0.1::DOUBLE * community, 6) AS cost FROM x"
)


@query(_with("sparse", _COSTS))
def cluster_costs(spark, sf):
    g = _graph(spark, sf, "sparse")
    parts = connected_components(g).select(F.col("node").alias("n"), F.col("component").alias("c"))
    costs = anonymise.cluster_costs(g, anonymise.fixed_groups(g, K), staged(structure.ncc_codes(g), "codes"), parts)
    return costs.withColumns({c: F.round(c, 6) for c in ("degree", "code", "neighbours", "community", "cost")})


_EDGES["published"] = _with("sparse", _GROUPS + _RING + _OUTSIDE + " SELECT u, v FROM e UNION SELECT u, v FROM ring UNION SELECT u, v FROM ext")
_COUNTS = " SELECT (SELECT count(*) FROM d) AS nodes, (SELECT count(*) FROM e) AS edges, (SELECT avg(clustering) FROM c) AS clustering"


def _both(what: str, sql: dict[str, str]) -> str:
    return f"WITH o AS ({sql['sparse']}), p AS ({sql['published']}), a AS MATERIALIZED ({_EDGES['sparse']}), b AS MATERIALIZED ({_EDGES['published']}), dd AS (SELECT n, count(*) FILTER (k = 0) AS x, count(*) FILTER (k = 1) AS y FROM (SELECT u AS n, 0 AS k FROM a UNION ALL SELECT v, 0 FROM a UNION ALL SELECT u, 1 FROM b UNION ALL SELECT v, 1 FROM b) GROUP BY n) {what}"


_CHECKED = ("nodes", "edges", "components", "clustering")
_CHECKS = {kind: _with(kind, _CLUSTERING + _COMPONENTS + _COUNTS + ", (SELECT count(DISTINCT component) FROM cc) AS components") for kind in ("sparse", "published")}
_SIDES = ", ".join(f"round({x}.{c}, 9) AS {c}_{side}" if c == "clustering" else f"{x}.{c} AS {c}_{side}" for x, side in (("o", "original"), ("p", "anonymized")) for c in _CHECKED)


@query(_both(f"SELECT {_SIDES}, (SELECT count(*) FROM a JOIN b USING (u, v)) AS preserved, (SELECT count(*) FROM b ANTI JOIN a USING (u, v)) AS added, (SELECT count(*) FROM a ANTI JOIN b USING (u, v)) AS removed, round((SELECT count(*) FROM a JOIN b USING (u, v)) / o.edges::DOUBLE, 9) AS intersection FROM o, p", _CHECKS))
def published_checks(spark, sf):
    g = _graph(spark, sf, "sparse")
    checks = compare.diagnosis(g, staged(anonymise.publish(g, K), "published"))
    return checks.withColumns({c: F.round(c, 9) for c in ("clustering_original", "clustering_anonymized", "intersection")})


_DELTA = {kind: f"SELECT *, 2.0::DOUBLE * edges / (nodes * (nodes - 1.0::DOUBLE)) AS density FROM ({_with(kind, _CLUSTERING + _FAR + _COUNTS + ', (SELECT sum(dist)::DOUBLE / count(*) FROM far WHERE dist > 0) AS apl')})" for kind in ("sparse", "published")}
_MEASURED = ("nodes", "edges", "density", "clustering", "apl")
_DELTAS = ", ".join([f"round({x}.{c}, 9) AS {prefix}_{c}" if c in _MEASURED[2:] else f"{x}.{c} AS {prefix}_{c}" for x, prefix in (("o", "original"), ("p", "anonymized")) for c in _MEASURED] + [f"round(p.{c} - o.{c}, 9) AS {c.removesuffix('s')}_variation" for c in _MEASURED])


@query(_both(f"SELECT {_DELTAS}, round((SELECT avg(abs(x - y)) FROM dd WHERE x > 0), 9) AS mae FROM o, p", _DELTA))
def published_delta(spark, sf):
    g = _graph(spark, sf, "sparse")
    delta = compare.full_delta(g, staged(anonymise.publish(g, K), "published"))
    return delta.withColumns({c: F.round(c, 9) for c, t in delta.dtypes if t == "double"})


@query(_with("sparse", _COMPONENTS + _FAR + ", top AS (SELECT component FROM cc GROUP BY component ORDER BY count(*) DESC, component LIMIT 1)" + _LENGTHS.replace("FROM far WHERE dist > 0", "FROM far WHERE dist > 0 AND src IN (SELECT node FROM cc JOIN top USING (component))").replace("AS nodes FROM d", "AS nodes FROM cc JOIN top USING (component)")))
def largest_component_paths(spark, sf):
    g = _graph(spark, sf, "sparse")
    p = structure.longest_component_paths(g, staged(connected_components(g), "components"))
    return p.withColumns({c: F.round(c, 9) for c in ("reachable_mean", "all_pairs_mean")})


_FOREST = _COMPONENTS + ", b(n, dist) AS (SELECT DISTINCT component, 0 FROM cc UNION SELECT s.m, b.dist + 1 FROM b JOIN s ON s.n = b.n WHERE b.dist < 24), l AS MATERIALIZED (SELECT n, min(dist) AS dist FROM b GROUP BY n), f AS MATERIALIZED (SELECT least(n, parent) AS u, greatest(n, parent) AS v FROM (SELECT x.n, min(s.m) AS parent FROM l x JOIN s ON s.n = x.n JOIN l y ON y.n = s.m AND y.dist = x.dist - 1 GROUP BY x.n))"


#: The edges that the split of e tests, the forest f left out.
_TESTED = "SELECT u, v FROM (SELECT u, v, row_number() OVER (ORDER BY md5(concat_ws('|', '42', u::VARCHAR, v::VARCHAR)), u, v) AS r FROM (SELECT u, v FROM e EXCEPT SELECT u, v FROM f)) WHERE r <= round_even(0.1 * (SELECT count(*) FROM e), 0)"


@query(_with("sparse", _FOREST + " " + _TESTED))
def protected_split(spark, sf):
    return segments.protected_split(_graph(spark, sf, "sparse"))[1]


_DRAW = "('0x' || substr(md5(concat_ws('|', '42', '{}', id::VARCHAR)), 1, 12))::BIGINT % (SELECT count(*) FROM d) + 1"


@query(_with("sparse", f", pl AS MATERIALIZED (SELECT n, row_number() OVER (ORDER BY n) AS place FROM d), dr AS (SELECT id, {_DRAW.format('a')} AS p, {_DRAW.format('b')} AS q FROM (SELECT unnest(range(4 * (SELECT count(*) FROM e) + 64)) AS id)), pr AS (SELECT least(x.n, y.n) AS u, greatest(x.n, y.n) AS v, min(id) AS id FROM dr JOIN pl x ON x.place = p JOIN pl y ON y.place = q WHERE p <> q GROUP BY ALL) SELECT u, v FROM (SELECT u, v, row_number() OVER (ORDER BY id) AS r FROM pr ANTI JOIN e USING (u, v)) WHERE r <= (SELECT count(*) FROM e)"))
def sampled_non_edges(spark, sf):
    g = _graph(spark, sf, "sparse")
    return segments.sampled_non_edges(g, g.count())


@query(f"SELECT row_number() OVER (ORDER BY nc, u, v) AS rank, u, v, nc AS score FROM ({SQL['edge_significance']})")
def edge_order(spark, sf):
    g = _graph(spark, sf, "dense")
    size = g.count()
    return anonymise.by_significance(staged(_significance(g), "scored"), "nc", size)


@query(f"SELECT row_number() OVER (ORDER BY lci, u, v) AS rank, u, v, lci AS score FROM ({SQL['line_influence']})")
def influence_order(spark, sf):
    return anonymise.by_significance(line_influence(spark, sf), "lci")


@query(f"SELECT 'method_' || lower(method) AS method, count(*) AS runs, round(avg(score), 6) AS score, round(avg(CASE WHEN loss > 0 THEN cost END), 6) AS cost, round(avg(abs(loss - 0.05::DOUBLE)), 6) AS abs_variation FROM {_RUNS} WHERE dataset = 'F' GROUP BY ALL")
def results_synthesis(spark, sf):
    runs = _results(spark, sf).select(F.concat(F.lit(" Method - "), "method").alias("method"), F.when(F.col("dataset") == "F", " OK").otherwise("failed").alias("status"), "score", F.when(F.col("loss") > 0, F.col("cost")).otherwise(float("nan")).alias("cost"), (F.col("loss") - 0.05).alias("variation"))
    s = evaluate.synthesis(runs, "method", "status", ["score", "cost"], ["variation"])
    return s.select("method", "runs", *[F.round(c, 6).alias(c) for c in s.columns[2:]])


def _pairs(test: str) -> str:
    """te, the edges that a split of e tests; ng, as many drawn pairs that are no edges; pr, both with their class y."""
    return (
        f", te AS MATERIALIZED ({test}), pl AS MATERIALIZED (SELECT n, row_number() OVER (ORDER BY n) AS place FROM d), dr AS (SELECT id, {_DRAW.format('a')} AS p, {_DRAW.format('b')} AS q FROM (SELECT unnest(range(4 * (SELECT count(*) FROM te) + 64)) AS id)), "
        "dp AS (SELECT least(x.n, y.n) AS u, greatest(x.n, y.n) AS v, min(id) AS id FROM dr JOIN pl x ON x.place = p JOIN pl y ON y.place = q WHERE p <> q GROUP BY ALL), ng AS (SELECT u, v FROM (SELECT u, v, row_number() OVER (ORDER BY id) AS r FROM dp ANTI JOIN e USING (u, v)) WHERE r <= (SELECT count(*) FROM te)), "
        "pr AS MATERIALIZED (SELECT u, v, 1 AS y FROM te UNION ALL SELECT u, v, 0 FROM ng)"
    )


def _link_scores(spark, sf):
    g = _graph(spark, sf, "dense")
    train, test = segments.protected_split(g)
    pairs = test.withColumn("y", F.lit(1)).unionByName(segments.sampled_non_edges(g, test.count()).withColumn("y", F.lit(0)))
    train, pairs = staged(train, "train"), staged(pairs, "pairs")
    discard(g)
    scores = structure.common_neighbours(train, pairs, last=True)
    return staged(pairs.join(scores, ["u", "v"], "left").select("u", "v", "y", F.round(F.coalesce("adamic_adar", F.lit(0.0)), 9).alias("score")), "scored")


_LINKS = (
    _FOREST + _pairs(_TESTED) + ", ts AS MATERIALIZED (SELECT s.n, s.m FROM s ANTI JOIN te ON te.u = least(s.n, s.m) AND te.v = greatest(s.n, s.m)), td AS (SELECT n, count(*) AS deg FROM ts GROUP BY n), "
    "aa AS (SELECT pr.u, pr.v, sum(CASE WHEN td.deg > 1 THEN 1 / ln(td.deg) ELSE 0 END) AS s FROM pr JOIN ts a ON a.n = pr.u JOIN ts b ON b.n = pr.v AND a.m = b.m JOIN td ON td.n = a.m GROUP BY pr.u, pr.v), "
    "sc AS MATERIALIZED (SELECT u, v, y, round(coalesce(s, 0), 9) AS score FROM pr LEFT JOIN aa USING (u, v))"
)


@query(_with("dense", _LINKS + " SELECT u, v, y, score FROM sc"))
def link_scores(spark, sf):
    return _link_scores(spark, sf)


@query(_with("dense", _LINKS + ", bs AS (SELECT score, sum(y) AS p, sum(1 - y) AS q FROM sc GROUP BY score), rk AS (SELECT *, sum(p) OVER w AS tp, sum(q) OVER w AS fp, sum(p) OVER () AS np, sum(q) OVER () AS nq FROM bs WINDOW w AS (ORDER BY score DESC)) SELECT max(np)::BIGINT AS positives, max(nq)::BIGINT AS negatives, round(sum(q * (tp - p / 2)) / (max(np) * max(nq)), 9) AS auc, round(sum(p * tp / (tp + fp)) / max(np), 9) AS average_precision FROM rk"))
def link_ranking(spark, sf):
    r = evaluate.ranking_scores(_link_scores(spark, sf))
    return r.select("positives", "negatives", F.round("auc", 9).alias("auc"), F.round("average_precision", 9).alias("average_precision"))


@query(_with("dense", _LINKS + ", o AS (SELECT y, row_number() OVER (ORDER BY score DESC, y DESC, u, v) AS r FROM sc) SELECT k, round(avg(y), 9) AS precision FROM (SELECT unnest([50, 100, 500]) AS k) JOIN o ON r <= k GROUP BY k"))
def link_precision(spark, sf):
    p = evaluate.precision_at(_link_scores(spark, sf), (50, 100, 500), ["u", "v"])
    return p.select("k", F.round("precision", 9).alias("precision"))


@query(f"WITH r AS {_RUNS}, a AS (SELECT k, upper(method) AS method, round(avg(score), 6) AS s FROM r WHERE dataset = 'F' GROUP BY ALL), b AS (SELECT k, upper(method) AS method, round(avg(score), 6) AS s, round(avg(loss), 6) AS extra FROM r WHERE dataset = 'O' GROUP BY ALL) SELECT k, method, coalesce(b.s, a.s) AS s, extra FROM a FULL JOIN b USING (k, method)")
def overlaid_results(spark, sf):
    r = _results(spark, sf).withColumn("method", F.upper("method"))
    first, second = (r.where(F.col("dataset") == d).groupBy("k", "method") for d in "FO")
    s = F.round(F.avg("score"), 6).alias("s")
    return evaluate.overlaid([first.agg(s), second.agg(s, F.round(F.avg("loss"), 6).alias("extra"))], ["k", "method"])


@query(_with("sparse", ", b(src, n, dist) AS (SELECT n, n, 0 FROM d WHERE ('0x' || substr(md5(concat_ws('|', '42', n::VARCHAR)), 1, 8))::BIGINT / 4294967296.0::DOUBLE < 0.0625 UNION SELECT b.src, s.m, b.dist + 1 FROM b JOIN s ON s.n = b.n WHERE b.dist < 24), x AS (SELECT src, n, min(dist) AS dist FROM b GROUP BY src, n), y AS (SELECT src, count(*) AS c, sum(dist)::DOUBLE AS t FROM x WHERE dist > 0 GROUP BY src) SELECT count(*) AS sources, sum(c)::BIGINT AS pairs, round(sum(t) / sum(c), 9) AS mean, round(stddev_samp(t / c) / sqrt(count(*)), 9) AS error FROM y"))
def sampled_paths(spark, sf):
    return structure.sampled_paths(_graph(spark, sf, "sparse")).withColumns({c: F.round(c, 9) for c in ("mean", "error")})


_EDGES["train"] = f"SELECT u, v FROM ({_EDGES['sparse']}) EXCEPT SELECT u, v FROM ({SQL['protected_split']})"
_EDGES["published_train"] = _with("train", _GROUPS + _RING + _OUTSIDE + " SELECT u, v FROM e UNION SELECT u, v FROM ring UNION SELECT u, v FROM ext")


def _utility(methods: dict[str, str]) -> str:
    """The comparison of graphs of training edges; `original` is one of them."""
    every = " UNION ALL ".join(f"SELECT '{name}' AS method, u, v FROM ({sql})" for name, sql in methods.items())
    return (
        _pairs(SQL["protected_split"]) + f", gr AS MATERIALIZED ({every}), "
        "gs AS MATERIALIZED (SELECT method, u AS n, v AS m FROM gr UNION ALL SELECT method, v, u FROM gr), gd AS (SELECT method, n, count(*) AS deg FROM gs GROUP BY method, n), "
        "aa AS (SELECT a.method, pr.u, pr.v, sum(CASE WHEN deg > 1 THEN 1 / ln(deg) ELSE 0 END) AS s FROM pr JOIN gs a ON a.n = pr.u JOIN gs b ON b.method = a.method AND b.n = pr.v AND b.m = a.m JOIN gd ON gd.method = a.method AND gd.n = a.m GROUP BY ALL), "
        "sc AS MATERIALIZED (SELECT method, u, v, y, round(coalesce(s, 0), 9) AS score FROM pr CROSS JOIN (SELECT DISTINCT method FROM gr) LEFT JOIN aa USING (method, u, v)), "
        "bs AS (SELECT method, score, sum(y) AS p, sum(1 - y) AS q FROM sc GROUP BY method, score), rk AS (SELECT *, sum(p) OVER w AS tp, sum(q) OVER w AS fp, sum(p) OVER z AS np, sum(q) OVER z AS nq FROM bs WINDOW w AS (PARTITION BY method ORDER BY score DESC), z AS (PARTITION BY method)), "
        "ms AS (SELECT method, sum(q * (tp - p / 2)) / (max(np) * max(nq)) AS auc, sum(p * tp / (tp + fp)) / max(np) AS ap FROM rk GROUP BY method), "
        "pk AS (SELECT method, avg(y) AS p100 FROM (SELECT method, y, row_number() OVER (PARTITION BY method ORDER BY score DESC, y DESC, u, v) AS r FROM sc) WHERE r <= 100 GROUP BY method), "
        "al AS MATERIALIZED (SELECT * FROM ms JOIN pk USING (method)), o AS (SELECT auc AS auc0, ap AS ap0, p100 AS p0 FROM al WHERE method = 'original') "
        "SELECT method, (SELECT count(*) FROM gr WHERE method = 'original') AS num_edges_train, (SELECT count(*) FROM te) AS num_test_pos_edges, round(auc, 6) AS auc, round(ap, 6) AS average_precision, round(p100, 6) AS precision_at_100, round(auc0 - auc, 6) AS auc_loss, "
        "round(ap0 - ap, 6) AS ap_loss, round(auc / auc0, 6) AS auc_utility_ratio, round(ap / ap0, 6) AS ap_utility_ratio, round(p100 / p0, 6) AS precision_at_100_utility_ratio FROM al, o"
    )


_METHODS = {"original": _EDGES["train"], "published": _EDGES["published_train"]}


@query(_with("sparse", _utility(_METHODS)))
def utility_ratios(spark, sf):
    rows = utility.compare_utility(_graph(spark, sf, "sparse"), {"published": lambda train: anonymise.publish(train, K)}, seeds=(42,), tell=False)
    names = ("auc", "average_precision", "precision_at_100", "auc_loss", "ap_loss", "auc_utility_ratio", "ap_utility_ratio", "precision_at_100_utility_ratio")
    return rows.select("method", *[F.col(c).cast("long").alias(c) for c in ("num_edges_train", "num_test_pos_edges")], *[F.round(c, 6).alias(c) for c in names])


def _brands(spark, sf):
    return _table(spark, sf, "part").select(F.col("p_partkey").alias("n"), F.col("p_brand").alias("label"))


def _types(spark, sf):
    return _table(spark, sf, "part").select(F.col("p_partkey").alias("n"), F.col("p_type").alias("label"))


@query()
def neighbourhood_codes(spark, sf):
    return neighbourhoods.neighbourhood_codes(_graph(spark, sf, "sparse"), _types(spark, sf))


@query()
def isomorphism_classes(spark, sf):
    return neighbourhoods.isomorphism_classes(_graph(spark, sf, "sparse"), _types(spark, sf))


@query()
def pair_costs(spark, sf):
    brands = _brands(spark, sf).select(F.col("label").alias("child")).distinct()
    tree = brands.withColumn("parent", F.concat(F.lit("family "), F.substring("child", -1, 1)))  # brands by last digit
    tree = tree.unionByName(tree.select(F.col("parent").alias("child"), F.lit("*").alias("parent")).distinct())
    g = _graph(spark, sf, "sparse")
    return neighbourhoods.pair_costs(g, g, _brands(spark, sf), tree).withColumn("cost", F.round("cost", 9))


_MODULARITY = " SELECT count(*) AS communities, round(sum(x / t - (k / t) * (k / t)), 9) AS modularity FROM (SELECT c, sum(x)::DOUBLE AS x, count(*)::DOUBLE AS k, sum(count(*)) OVER () AS t FROM (SELECT a.c, (a.c = b.c)::INT AS x FROM e JOIN cm a ON a.n = e.u JOIN cm b ON b.n = e.v UNION ALL SELECT b.c, (a.c = b.c)::INT FROM e JOIN cm a ON a.n = e.u JOIN cm b ON b.n = e.v) GROUP BY c)"


@query(_with("dense", ", cm AS MATERIALIZED (SELECT p_partkey AS n, p_brand AS c FROM part)" + _MODULARITY))
def label_modularity(spark, sf):
    return communities.modularity(_graph(spark, sf, "dense"), _brands(spark, sf).withColumnRenamed("label", "c")).withColumn("modularity", F.round("modularity", 9))


@query()
def community_costs(spark, sf):
    g = _graph(spark, sf, "sparse")
    parts = staged(communities.louvain(g), "communities")
    costs = anonymise.cluster_costs(g, anonymise.fixed_groups(g, K), staged(structure.ncc_codes(g), "codes"), parts).join(parts, "n")
    return costs.withColumns({c: F.round(c, 6) for c in ("degree", "code", "neighbours", "community", "cost")})


@query(_with("sparse", ", ix AS MATERIALIZED (SELECT n, m, row_number() OVER (PARTITION BY n ORDER BY m) - 1 AS i, count(*) OVER (PARTITION BY n) AS deg FROM s), w(n, walk, step, here, path) AS (SELECT n, walk, 1, n, n::VARCHAR FROM d, (SELECT unnest([0, 1]) AS walk) UNION ALL SELECT w.n, walk, step + 1, ix.m, path || ',' || ix.m FROM w JOIN d ON d.n = w.here JOIN ix ON ix.n = w.here AND ix.i = ('0x' || substr(md5(concat_ws('|', '42', 'to', w.n || '/' || walk, step::VARCHAR, '0')), 1, 12))::BIGINT % d.deg WHERE step < 6) SELECT n, walk, path FROM w WHERE step = 6"))
def random_walks(spark, sf):
    return walks.random_walks(_graph(spark, sf, "sparse"), 6, 2).withColumn("path", F.array_join(F.col("path").cast("array<string>"), ","))


@query()
def walk_classes(spark, sf):
    part = _table(spark, sf, "part").select(F.col("p_partkey").alias("n"), F.col("p_type").alias("y"))
    vectors = walks.walk_vectors(walks.random_walks(_graph(spark, sf, "sparse"), 8, 4, 0.5, 2.0), 16)
    return evaluate.classification(walks.walk_classes(vectors, part, evaluate.stratified_split(part, "n", "y").select("n", "part")))


_UP = f"WITH RECURSIVE t AS ({_TREE}), a(node, ancestor, up) AS (SELECT x, x, 0 FROM (SELECT child AS x FROM t UNION SELECT parent FROM t) UNION ALL SELECT a.node, t.parent, up + 1 FROM a JOIN t ON t.child = a.ancestor)"


@query(
    f"SELECT g, size, label, leaves, round(leaves / total, 9) AS ncp, round(size * (leaves / total), 9) AS cost FROM (SELECT g, max(size) AS size, first(ancestor ORDER BY up) AS label FROM (SELECT x.g, max(x.size) AS size, ancestor, min(up) AS up, count(*) AS above FROM "
    f"(SELECT g.g, label, count(*) OVER (PARTITION BY g.g) AS size FROM ({_with('sparse', _GROUPS + ' SELECT n, g FROM g')}) g JOIN (SELECT l_partkey, 's' || min(l_suppkey) AS label FROM lineitem GROUP BY l_partkey) ON l_partkey = g.n) x "
    f"JOIN ({_UP} SELECT * FROM a) a ON a.node = x.label GROUP BY x.g, ancestor) WHERE above = size GROUP BY g) m JOIN (SELECT node, leaves, (SELECT leaves FROM c WHERE node = '*')::DOUBLE AS total FROM c) ON node = label".replace(
        "FROM c", f"FROM ({_UP}, l AS (SELECT child FROM t WHERE child NOT IN (SELECT parent FROM t)) SELECT ancestor AS node, count(*) AS leaves FROM a JOIN l ON l.child = a.node GROUP BY ancestor) c"
    )
)
def group_labels(spark, sf):
    groups = anonymise.fixed_groups(_graph(spark, sf, "sparse"), K)
    labels = _table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("n")).agg(F.concat(F.lit("s"), F.min("l_suppkey").cast("string")).alias("label"))
    return hierarchy.common_labels(_tree(spark, sf), groups.join(labels, "n").select("g", "label")).withColumns({c: F.round(c, 9) for c in ("ncp", "cost")})


_ANCHORED = ", q AS (SELECT g.g, n, row_number() OVER (PARTITION BY g.g ORDER BY deg DESC, n) AS r, count(*) OVER (PARTITION BY g.g) AS size FROM g), x AS (SELECT g, n AS m FROM q WHERE r <= least(3, size - 1)) SELECT u, v FROM e UNION SELECT least(n, m), greatest(n, m) FROM g JOIN x USING (g) WHERE n <> m"
_SWEEP_KS, _SWEEP_SEEDS = (2, 5, 10), (42, 123)


def _sweep_sql(seed: int, k: int, original: bool) -> str:
    sql = _with("sparse", _utility(_METHODS | {"anchored": _with("train", _GROUPS + _ANCHORED)})).replace("'42'", f"'{seed}'").replace(f"// {K}", f"// {k}")
    return f"SELECT method, CASE WHEN method <> 'original' THEN {k} ELSE 0 END::BIGINT AS k, {seed}::BIGINT AS seed, * EXCLUDE (method) FROM ({sql})" + ("" if original else " WHERE method <> 'original'")


_UTILITY_COLUMNS = ("auc", "average_precision", "precision_at_100", "auc_loss", "ap_loss", "auc_utility_ratio", "ap_utility_ratio", "precision_at_100_utility_ratio")


@query(" UNION ALL ".join(_sweep_sql(s, k, k == _SWEEP_KS[0]) for s in _SWEEP_SEEDS for k in _SWEEP_KS))
def link_sweep(spark, sf):
    added = {"published": lambda e, g: anonymise.ring_template(e, g).unionByName(anonymise.external_template(e, g)), "anchored": anonymise.anchor_template}
    rows = sweeps.link_sweep(_graph(spark, sf, "sparse"), added, _SWEEP_KS, _SWEEP_SEEDS)
    return rows.select("method", F.coalesce("k", F.lit(0)).cast("long").alias("k"), F.col("seed").cast("long").alias("seed"), "num_edges_train", "num_test_pos_edges", *[F.round(c, 6).alias(c) for c in _UTILITY_COLUMNS])


_GAP = " + ".join(f"(a.{c} - b.{c}) * (a.{c} - b.{c})" for c in ("deg", "triangles", "clustering", "avg_neighbour_degree", "ego_edges", "largest", "second"))


@query(f"WITH g AS MATERIALIZED ({SQL['structural_signatures']}) SELECT seed, rank, n, distance FROM (SELECT a.n AS seed, b.n AS n, round(sqrt(({_GAP})::DOUBLE), 9) AS distance, row_number() OVER (PARTITION BY a.n ORDER BY round(sqrt(({_GAP})::DOUBLE), 9), b.deg DESC, b.n) AS rank FROM g a JOIN g b ON a.n <> b.n) WHERE rank < {K}")
def nearest_signatures(spark, sf):
    s = structural_signatures(spark, sf)
    features = [c for c in s.columns if c != "n"]
    return nearest.nearest(staged(s.withColumn("t", -F.col("deg")), "signatures"), s.select(F.col("n").alias("seed")), features, K - 1, ties="t")


_PLACES = ", pl AS (SELECT n, row_number() OVER (ORDER BY n) - 1 AS place FROM d)"


@query(_with("sparse", _PLACES + " SELECT a.place AS u, b.place AS v FROM e JOIN pl a ON a.n = e.u JOIN pl b ON b.n = e.v"))
def relabelled_graph(spark, sf):
    g = _graph(spark, sf, "sparse")
    return formats.relabelled(g, graphs.nodes_of(g))[0]


@query(_with("dense", " SELECT u, v FROM e WHERE v < (SELECT count(*) FROM region) * 100"))
def sanitised_graph(spark, sf):
    g = graphs.string_edges(_graph(spark, sf, "dense"))
    return formats.sanitised(g, 100 * _table(spark, sf, "region").count())


@query("SELECT p_partkey AS n, p_type AS label, dense_rank() OVER (ORDER BY p_type) - 1 AS y FROM part")
def class_numbers(spark, sf):
    return formats.class_numbers(_types(spark, sf))


@query("SELECT p_partkey, p_brand, CASE WHEN r <= a THEN 'train' WHEN r <= a + b THEN 'val' ELSE 'test' END AS part FROM (SELECT *, CASE WHEN n <= 3 THEN 1 ELSE round_even(n * 0.6, 0) END AS a, CASE WHEN n <= 2 THEN 0 ELSE greatest(1, round_even(n * 0.2, 0)) END AS b FROM (SELECT p_partkey, p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY md5(concat_ws('|', '42', p_partkey::VARCHAR)), p_partkey) AS r, count(*) OVER (PARTITION BY p_brand) AS n FROM part))")
def class_split(spark, sf):
    return evaluate.class_split(_table(spark, sf, "part"), "p_partkey", "p_brand")
