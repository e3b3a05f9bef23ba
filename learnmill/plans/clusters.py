"""Queries on neighbourhoods, clusters, medoids, CLIQUE."""

from __future__ import annotations

from pyspark.sql import functions as F

from learnmill.operators import clique as C
from learnmill.operators import medoids as M
from learnmill.operators import neighbors as N

from learnmill.sources.tables import SQL_USERS, SQL_VEC, table, user_points, vectors

from .registry import query, rounded

RADIUS, MIN_POINTS = 0.25, 5
_NEAR = f"WITH RECURSIVE {SQL_USERS}, near AS (SELECT a.id AS i, b.id AS j, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) AS d2 FROM p a, p b WHERE (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 0.25::DOUBLE * 0.25::DOUBLE)"
_DBSCAN = _NEAR + """, core AS (SELECT i AS id FROM near GROUP BY i HAVING count(*) >= 5),
e AS (SELECT i, j FROM near WHERE i IN (SELECT id FROM core) AND j IN (SELECT id FROM core)),
reach(i, j) AS (SELECT i, j FROM e UNION SELECT r.i, e.j FROM reach r JOIN e ON r.j = e.i),
lab AS (SELECT i AS id, min(j) AS label FROM reach GROUP BY i),
num AS (SELECT id, dense_rank() OVER (ORDER BY label) - 1 AS cluster FROM lab),
bord AS (SELECT n.i AS id, min(c.cluster) AS cluster FROM near n JOIN num c ON n.j = c.id GROUP BY n.i),
dbscan AS (SELECT p.id, num.id IS NOT NULL AS core, coalesce(num.cluster, bord.cluster, -1)::BIGINT AS cluster FROM p LEFT JOIN num USING (id) LEFT JOIN bord ON p.id = bord.id)"""


@query(_NEAR + " SELECT i AS id, count(*) AS degree FROM near GROUP BY i")
def eps_degree_user(spark, sf_dir):
    return N.eps_degree(user_points(spark, sf_dir), RADIUS)


@query(_DBSCAN + " SELECT id, core, cluster FROM dbscan")
def dbscan_user(spark, sf_dir):
    return N.dbscan(user_points(spark, sf_dir), MIN_POINTS, RADIUS)


_SHIFTED = "s AS (SELECT id, round(x + 0.05, 9) AS x, round(y - 0.05, 9) AS y FROM p)"


@query(_DBSCAN + f", {_SHIFTED} SELECT s.id, coalesce(min(dbscan.cluster) FILTER (dbscan.core), -1)::BIGINT AS cluster FROM s LEFT JOIN p ON (s.x - p.x) * (s.x - p.x) + (s.y - p.y) * (s.y - p.y) <= 0.0625 LEFT JOIN dbscan ON dbscan.id = p.id GROUP BY s.id")
def dbscan_predict_user(spark, sf_dir):
    p = user_points(spark, sf_dir)
    new = p.select("id", F.round(F.col("x") + 0.05, 9).alias("x"), F.round(F.col("y") - 0.05, 9).alias("y"))
    return N.predict_dbscan(new, p, N.dbscan(p, MIN_POINTS, RADIUS), RADIUS)


@query(_NEAR + ", r AS (SELECT i, d2, row_number() OVER (PARTITION BY i ORDER BY d2, j) AS k FROM near) SELECT p.id, coalesce(round(sqrt(d2), 6), -1.0::DOUBLE) AS core_distance FROM p LEFT JOIN r ON p.id = r.i AND r.k = 5")
def core_distance_user(spark, sf_dir):
    d = N.core_distance(user_points(spark, sf_dir), MIN_POINTS, RADIUS)
    return d.select("id", F.coalesce(rounded(F.col("core_distance")), F.lit(-1.0)).alias("core_distance"))


@query()
def optics_order_user(spark, sf_dir):
    return N.optics(user_points(spark, sf_dir), MIN_POINTS, 1.0)


@query()
def optics_cut_user(spark, sf_dir):
    return N.optics_cut(N.optics(user_points(spark, sf_dir), MIN_POINTS, 1.0), RADIUS)


@query()
def optics_xi_user(spark, sf_dir):
    return N.steep_areas(N.optics(user_points(spark, sf_dir), MIN_POINTS, 1.0), 0.05, MIN_POINTS)


_LOF = f"""WITH {SQL_USERS}, n0 AS (SELECT a.id AS i, b.id AS j, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) AS d2 FROM p a, p b),
k AS (SELECT *, dense_rank() OVER (PARTITION BY i ORDER BY d2) AS r FROM n0), n AS (SELECT i, j, sqrt(d2) AS d FROM k WHERE r <= 5 AND i <> j), kd AS (SELECT i, max(d) AS kd FROM n GROUP BY i),
lrd AS (SELECT n.i, count(*) / sum(greatest(kd.kd, n.d)) AS lrd FROM n JOIN kd ON n.j = kd.i GROUP BY n.i)"""


@query(_LOF + " SELECT n.i AS id, round(avg(b.lrd) / any_value(a.lrd), 6) AS factor FROM n JOIN lrd b ON n.j = b.i JOIN lrd a ON n.i = a.i GROUP BY n.i")
def lof_user(spark, sf_dir):
    return N.outlier_factor(user_points(spark, sf_dir), 5, 2.0).withColumn("factor", rounded(F.col("factor")))


@query(f"WITH {SQL_USERS} SELECT a.id, count(*) AS n_near FROM p a, p b WHERE (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 1.0 GROUP BY a.id HAVING count(*) <= (SELECT floor(count(*) * 0.02 + 1e-9) FROM p)")
def db_outlier_user(spark, sf_dir):
    return N.distance_outliers(user_points(spark, sf_dir), 0.98, 1.0)


_ASSIGN = f"WITH {SQL_USERS}, m AS (SELECT id AS m, x AS mx, y AS my FROM p ORDER BY id LIMIT 3), a AS (SELECT id, min(struct_pack(d := sqrt((x - mx) * (x - mx) + (y - my) * (y - my)), m := m)) AS b FROM p, m GROUP BY id)"


def _medoids(p):
    return p.orderBy("id").limit(3)


@query(_ASSIGN + " SELECT id, b.m AS medoid, round(b.d, 6) + 0.0::DOUBLE AS d FROM a")
def medoid_assign(spark, sf_dir):
    p = user_points(spark, sf_dir)
    return M.assign(p, _medoids(p)).withColumn("d", rounded(F.col("d")))


@query(_ASSIGN + " SELECT round(avg(b.d), 6) + 0.0::DOUBLE AS cost FROM a")
def avg_dissimilarity(spark, sf_dir):
    p = user_points(spark, sf_dir)
    return M.average_dissimilarity(M.assign(p, _medoids(p))).select(rounded(F.col("cost")).alias("cost"))


@query(f"WITH {SQL_USERS}, o AS (SELECT *, row_number() OVER (ORDER BY id) AS r FROM p), m AS (SELECT x AS mx, y AS my FROM o WHERE r IN (2, 3, 10)), a AS (SELECT id, min(sqrt((x - mx) * (x - mx) + (y - my) * (y - my))) AS d FROM p, m GROUP BY id) SELECT round(avg(d), 6) + 0.0::DOUBLE AS cost FROM a")
def medoid_swap_cost(spark, sf_dir):
    p = user_points(spark, sf_dir)
    first = [r["id"] for r in p.orderBy("id").limit(10).collect()]
    return M.swap_cost(p, _medoids(p), first[0], first[9]).select(rounded(F.col("cost")).alias("cost"))


@query()
def clarans_user(spark, sf_dir):
    p = user_points(spark, sf_dir)
    ids = M.clarans(p, 3, 1, 5, seed=1)
    return M.assign(p, p.where(F.col("id").isin(ids)))


@query(f"WITH {SQL_USERS}, l AS (SELECT *, (id % 3) AS c FROM p), t AS (SELECT a.c, a.id, round(sum(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))), 9) AS t FROM l a JOIN l b USING (c) GROUP BY 1, 2) SELECT c, id FROM (SELECT *, row_number() OVER (PARTITION BY c ORDER BY t, id) AS k FROM t) WHERE k = 1")
def medoid_of_group(spark, sf_dir):
    return M.medoid_of(user_points(spark, sf_dir).withColumn("c", F.col("id") % 3), "c")


_LINKS = f"WITH {SQL_VEC}, d AS (SELECT a.label AS a, b.label AS b, min(list_distance(a.v, b.v)) AS single, max(list_distance(a.v, b.v)) AS complete, avg(list_distance(a.v, b.v)) AS average FROM v a JOIN v b ON a.label < b.label GROUP BY 1, 2), w AS (SELECT a.label, max(list_distance(a.v, b.v)) AS s FROM v a JOIN v b ON a.label = b.label AND a.id < b.id GROUP BY 1)"


@query(_LINKS + " SELECT a, b, round(single, 6) AS single, round(complete, 6) AS complete, round(average, 6) AS average FROM d")
def link_distances_emb(spark, sf_dir):
    d = M.link_distances(vectors(spark, sf_dir))
    return d.select("a", "b", *(rounded(F.col(c)).alias(c) for c in ("single", "complete", "average")))


@query(_LINKS + " SELECT round((SELECT min(single) FROM d) / (SELECT max(s) FROM w), 6) AS dunn")
def dunn_emb(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return M.dunn_index(M.link_distances(v), M.diameters(v)).select(rounded(F.col("dunn")).alias("dunn"))


@query(_LINKS + ", b AS (SELECT a, b, single FROM d UNION ALL SELECT b, a, single FROM d), r AS (SELECT b.a, max((x.s + y.s) / b.single) AS r FROM b JOIN w x ON b.a = x.label JOIN w y ON b.b = y.label GROUP BY b.a) SELECT round(avg(r), 6) AS davies_bouldin FROM r")
def davies_bouldin_emb(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return M.davies_bouldin_index(M.link_distances(v), M.diameters(v)).select(rounded(F.col("davies_bouldin")).alias("davies_bouldin"))


_MEDOIDS = f"WITH {SQL_VEC}, m AS (SELECT label, v FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY id) AS k FROM v) WHERE k = 1), w AS (SELECT v.label, avg(list_distance(v.v, m.v)) AS s FROM v JOIN m USING (label) GROUP BY 1), d AS (SELECT a.label AS a, b.label AS b, list_distance(a.v, b.v) AS d FROM m a JOIN m b ON a.label < b.label)"


def _first_vectors(v):
    return v.groupBy("label").agg(F.min_by("v", "id").alias("v"))


@query(_MEDOIDS + " SELECT a, b, round(d, 6) AS medoid FROM d")
def medoid_links_emb(spark, sf_dir):
    return M.medoid_links(_first_vectors(vectors(spark, sf_dir))).select("a", "b", rounded(F.col("medoid")).alias("medoid"))


@query(_MEDOIDS + " SELECT label, round(s, 6) AS s FROM w")
def medoid_dispersions_emb(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return M.medoid_dispersions(v, _first_vectors(v)).select("label", rounded(F.col("s")).alias("s"))


@query(_MEDOIDS + ", b AS (SELECT a, b, d FROM d UNION ALL SELECT b, a, d FROM d), r AS (SELECT b.a, max((x.s + y.s) / b.d) AS r FROM b JOIN w x ON b.a = x.label JOIN w y ON b.b = y.label GROUP BY b.a) SELECT round(avg(r), 6) AS davies_bouldin FROM r")
def davies_bouldin_medoid_emb(spark, sf_dir):
    v = vectors(spark, sf_dir)
    m = _first_vectors(v)
    return M.davies_bouldin_index(M.medoid_links(m), M.medoid_dispersions(v, m), "medoid").select(rounded(F.col("davies_bouldin")).alias("davies_bouldin"))


AXES = ["q", "d", "t"]
_CELLS = "WITH RECURSIVE g AS (SELECT least(floor((l_quantity - 1) / 7), 6)::BIGINT AS b0, least(floor(l_discount * 100 / 2 + 1e-9), 4)::BIGINT AS b1, least(floor(l_tax * 100 / 2 + 1e-9), 3)::BIGINT AS b2 FROM lineitem), n AS (SELECT count(*) AS n FROM g)"


def _members(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(
        F.least(F.floor((F.col("l_quantity") - 1) / 7), F.lit(6)).alias("q"),
        F.least(F.floor(F.col("l_discount") * 100 / 2 + 1e-9), F.lit(4)).alias("d"), F.least(F.floor(F.col("l_tax") * 100 / 2 + 1e-9), F.lit(3)).alias("t"),
    )
    few = C.collapsed(li, AXES)
    return C.memberships(few, "row", AXES, "w"), few.agg(F.sum("w")).first()[0]


def _named(units):
    return units.select(F.concat_ws(",", F.col("subspace").cast("array<string>")).alias("subspace"), F.concat_ws(",", F.col("bins").cast("array<string>")).alias("bins"), "n")


_ONE = " UNION ALL ".join(f"SELECT '{i}' AS subspace, b{i}::VARCHAR AS bins, count(*) AS n FROM g GROUP BY 2 HAVING count(*) >= 0.01 * (SELECT n FROM n)" for i in range(3))
_TWO = " UNION ALL ".join(f"SELECT '{i},{j}' AS subspace, b{i} || ',' || b{j} AS bins, count(*) AS n FROM g GROUP BY 2 HAVING count(*) >= 0.01 * (SELECT n FROM n)" for i, j in ((0, 1), (0, 2), (1, 2)))
_THREE = "SELECT '0,1,2' AS subspace, b0 || ',' || b1 || ',' || b2 AS bins, count(*) AS n FROM g GROUP BY 2 HAVING count(*) >= 0.01 * (SELECT n FROM n)"


def _units(spark, sf_dir, level):
    m, n = _members(spark, sf_dir)
    return C.units_up_to(m, -(-n // 100), level)[level - 1]


@query(f"{_CELLS} {_ONE}")
def clique_units_1(spark, sf_dir):
    return _named(_units(spark, sf_dir, 1))


@query(f"{_CELLS} {_TWO}")
def clique_units_2(spark, sf_dir):
    return _named(_units(spark, sf_dir, 2))


@query(f"{_CELLS} {_THREE}")
def clique_units_3(spark, sf_dir):
    return _named(_units(spark, sf_dir, 3))


_TWO_UNITS = f"{_CELLS}, u AS (SELECT subspace, bins, n, split_part(bins, ',', 1)::BIGINT AS x, split_part(bins, ',', 2)::BIGINT AS y FROM ({_TWO}))"


@query(f"{_TWO_UNITS} SELECT a.subspace, a.bins AS a, b.bins AS b FROM u a JOIN u b ON a.subspace = b.subspace AND ((b.x = a.x + 1 AND b.y = a.y) OR (b.x = a.x AND b.y = a.y + 1))")
def clique_faces(spark, sf_dir):
    f = C.faces(_units(spark, sf_dir, 2))
    return f.select(*(F.concat_ws(",", F.col(c).cast("array<string>")).alias(c) for c in ("subspace", "a", "b")))


@query(f"""{_TWO_UNITS}, e AS (SELECT a.subspace, a.bins AS a, b.bins AS b FROM u a JOIN u b ON a.subspace = b.subspace AND abs(a.x - b.x) + abs(a.y - b.y) <= 1),
r(subspace, a, b) AS (SELECT subspace, a, b FROM e UNION SELECT r.subspace, r.a, e.b FROM r JOIN e ON r.subspace = e.subspace AND r.b = e.a),
l AS (SELECT subspace, a AS bins, min(lpad(split_part(b, ',', 1), 9, '0') || ',' || lpad(split_part(b, ',', 2), 9, '0')) AS c FROM r GROUP BY 1, 2)
SELECT subspace, bins, n, subspace || '|' || c AS cluster FROM u JOIN l USING (subspace, bins)""")
def clique_clusters(spark, sf_dir):
    units = C.unit_clusters(_units(spark, sf_dir, 2), 1)
    return units.select(F.concat_ws(",", F.col("subspace").cast("array<string>")).alias("subspace"), F.concat_ws(",", F.col("bins").cast("array<string>")).alias("bins"), "n", "cluster")


@query(f"{_CELLS}, u AS ({_TWO}), p AS (SELECT subspace, n / sum(n) OVER (PARTITION BY subspace) AS p FROM u) SELECT subspace, round(sum(-p * ln(p)), 6) + 0.0::DOUBLE AS entropy FROM p GROUP BY 1")
def clique_entropy(spark, sf_dir):
    e = C.subspace_entropy(_units(spark, sf_dir, 2))
    return e.select(F.concat_ws(",", F.col("subspace").cast("array<string>")).alias("subspace"), rounded(F.col("entropy")).alias("entropy"))


@query("""WITH c AS (SELECT p_brand, count(*) AS coverage FROM part GROUP BY 1), r AS (SELECT row_number() OVER (ORDER BY coverage DESC, p_brand) AS rank, coverage FROM c), k AS (SELECT rank AS cut FROM r WHERE rank >= 2),
x AS (SELECT cut, rank <= cut AS kept, coverage, ceil(avg(coverage) OVER (PARTITION BY cut, rank <= cut)) AS m FROM r, k),
y AS (SELECT cut, kept, sum(CASE WHEN abs(coverage - m) > 1e-8 THEN log2(abs(coverage - m)) END) AS bits, max((abs(coverage - m) <= 1e-8)::INT) AS flat, any_value(m) AS m FROM x GROUP BY 1, 2)
SELECT cut AS rank, coalesce(round(CASE WHEN max(flat) = 0 THEN sum(bits + log2(m)) END, 5), -1.0::DOUBLE) AS code_length FROM y GROUP BY cut HAVING count(*) = 2""")
def clique_mdl(spark, sf_dir):
    c = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("subspace")).agg(F.count("*").alias("coverage"))
    return C.mdl_cut(c).select("rank", F.coalesce(rounded(F.col("code_length"), 5), F.lit(-1.0)).alias("code_length"))


@query()
def clique_regions(spark, sf_dir):
    return C.maximal_regions(C.unit_clusters(_units(spark, sf_dir, 2), 1))


_OF_ROWS = f"""{_TWO_UNITS}, v AS (SELECT * FROM u WHERE subspace = '0,1'), e AS (SELECT a.bins AS a, b.bins AS b FROM v a JOIN v b ON abs(a.x - b.x) + abs(a.y - b.y) <= 1),
r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
l AS (SELECT a AS bins, '0,1|' || min(lpad(split_part(b, ',', 1), 9, '0') || ',' || lpad(split_part(b, ',', 2), 9, '0')) AS cluster FROM r GROUP BY 1)
SELECT cluster, count(*)::BIGINT AS n FROM g LEFT JOIN l ON l.bins = b0 || ',' || b1 GROUP BY 1"""


@query(_OF_ROWS)
def clique_predict(spark, sf_dir):
    m, n = _members(spark, sf_dir)
    units = C.units_up_to(m, -(-n // 100), 2)[1]
    one = units.where(F.col("subspace") == F.array(F.lit(0).cast("long"), F.lit(1).cast("long")))
    found = C.predict(m, C.maximal_regions(C.unit_clusters(one, 1)))
    weights = m.groupBy(F.col("id").alias("i")).agg(F.max("w").alias("w"))
    return found.join(weights, F.col("id") == F.col("i")).groupBy("cluster").agg(F.sum("w").alias("n"))


_WHOLE = """WITH RECURSIVE m AS (SELECT min(p_size)::DOUBLE AS a, max(p_size)::DOUBLE AS b, min(p_retailprice) AS c, max(p_retailprice) AS d, count(*) // 25 AS least FROM part),
g AS (SELECT p_partkey AS id, least(floor((p_size - a) / ((b - a) / 5)), 4)::BIGINT AS x, least(floor((p_retailprice - c) / ((d - c) / 5)), 4)::BIGINT AS y FROM part, m),
u AS (SELECT x, y, count(*) AS n FROM g GROUP BY 1, 2 HAVING count(*) >= (SELECT least FROM m)), e AS (SELECT a.x AS ax, a.y AS ay, b.x AS tx, b.y AS ty FROM u a JOIN u b ON abs(a.x - b.x) + abs(a.y - b.y) <= 1),
r(ax, ay, tx, ty) AS (SELECT * FROM e UNION SELECT r.ax, r.ay, e.tx, e.ty FROM r JOIN e ON r.tx = e.ax AND r.ty = e.ay), l AS (SELECT ax AS x, ay AS y, min(tx * 10 + ty) AS c FROM r GROUP BY 1, 2),
k AS (SELECT c, row_number() OVER (ORDER BY c) - 1 AS cluster FROM (SELECT c FROM l JOIN u USING (x, y) GROUP BY c HAVING sum(n) >= (SELECT least FROM m)))
SELECT id, coalesce(cluster, -1)::BIGINT AS cluster FROM g LEFT JOIN l USING (x, y) LEFT JOIN k USING (c)"""


@query(_WHOLE)
def clique_part(spark, sf_dir):
    """The whole search: units, the deepest subspace's clusters, their regions, and the cluster of each row."""
    part = table(spark, sf_dir, "part")
    return C.fit_rows(part, "p_partkey", ["p_size", "p_retailprice"], part.count() // 25, 2, 5)[0]


def _user_arrays(spark, sf_dir):
    """(id, v): users by x, y and their sum, for metrics in three dimensions."""
    return user_points(spark, sf_dir).select("id", F.array("x", "y", F.round(F.col("x") + F.col("y"), 9)).alias("v"))


_V3 = f"WITH RECURSIVE {SQL_USERS}, p3 AS (SELECT id, x, y, round(x + y, 9) AS z FROM p), m AS (SELECT a.id AS i, b.id AS j, abs(a.x - b.x) + abs(a.y - b.y) + abs(a.z - b.z) AS d FROM p3 a, p3 b), near AS (SELECT i, j FROM m WHERE d <= 0.75)"
_DBSCAN3 = _V3 + _DBSCAN[len(_NEAR) :]


@query(_DBSCAN3 + " SELECT id, core, cluster FROM dbscan")
def dbscan_manhattan_user(spark, sf_dir):
    return N.dbscan(_user_arrays(spark, sf_dir), MIN_POINTS, 0.75, "manhattan")


_LOF3 = _V3 + """, k AS (SELECT *, dense_rank() OVER (PARTITION BY i ORDER BY d) AS r FROM m), n AS (SELECT i, j, d FROM k WHERE r <= 5 AND i <> j), kd AS (SELECT i, max(d) AS kd FROM n GROUP BY i),
lrd AS (SELECT n.i, count(*) / sum(greatest(kd.kd, n.d)) AS lrd FROM n JOIN kd ON n.j = kd.i GROUP BY n.i)"""


@query(_LOF3 + " SELECT n.i AS id, round(avg(b.lrd) / any_value(a.lrd), 6) AS factor FROM n JOIN lrd b ON n.j = b.i JOIN lrd a ON n.i = a.i GROUP BY n.i")
def lof_manhattan_user(spark, sf_dir):
    return N.outlier_factor(_user_arrays(spark, sf_dir), 5, 1.0, "manhattan").withColumn("factor", rounded(F.col("factor")))


@query(f"WITH {SQL_USERS}, p3 AS (SELECT id, x, y, round(x + y, 9) AS z FROM p) SELECT a.id, count(*) AS n_near FROM p3 a, p3 b WHERE greatest(abs(a.x - b.x), abs(a.y - b.y), abs(a.z - b.z)) <= 1.0 GROUP BY a.id HAVING count(*) <= (SELECT floor(count(*) * 0.02 + 1e-9) FROM p)")
def db_outlier_chebyshev_user(spark, sf_dir):
    return N.distance_outliers(_user_arrays(spark, sf_dir), 0.98, 1.0, "chebyshev")


@query(f"WITH {SQL_VEC} SELECT a.id, count(*) AS degree FROM v a, v b WHERE list_distance(a.v, b.v) <= 1.15::DOUBLE GROUP BY 1")
def eps_degree_emb(spark, sf_dir):
    return N.eps_degree(vectors(spark, sf_dir).select("id", "v"), 1.15)
