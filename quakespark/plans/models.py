"""Queries on inversion, series, down-sampling and clusters, each beside its DuckDB SQL."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..operators import downsample, graph, inversion, series
from .queries import SQL, query, r, table

GREENS = "g AS (SELECT o_orderkey AS row, 1e0 AS a, o_custkey % 50 / 10e0 AS b, o_totalprice / 100000 + o_custkey % 50 / 9e0 AS d, 1 / (1e0 + o_orderkey % 3) AS w FROM orders), n AS (SELECT sum(w * a * a) + 2 AS aa, sum(w * a * b) AS ab, sum(w * b * b) + 3 AS bb, sum(w * a * d) + 2 * 5 AS ad, sum(w * b * d) AS bd FROM g)"


def _greens(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("row"), (F.col("o_custkey") % 50 / 10).alias("b"), (F.col("o_totalprice") / 100000 + F.col("o_custkey") % 50 / 9).alias("d"), (1 / (1.0 + F.col("o_orderkey") % 3)).alias("weight"))
    greens = rows.select("row", F.explode(F.array(F.struct(F.lit(0).alias("col"), F.lit(1.0).alias("value")), F.struct(F.lit(1).alias("col"), F.col("b").alias("value")))).alias("x")).select("row", "x.*")
    return greens, rows.select("row", "d", "weight")


def _parameters(spark, m, **more):
    return spark.createDataFrame([(k, round(float(v), 6), *(round(float(x[k]), 9) for x in more.values())) for k, v in enumerate(m)], ", ".join(["col int", "m double", *(f"{c} double" for c in more)]))


@query(f"WITH {GREENS}, s AS (SELECT *, aa * bb - ab * ab AS det FROM n) SELECT 0 AS col, round((ad * bb - bd * ab) / det, 6) AS m, round(bb / det, 9) AS variance FROM s UNION ALL SELECT 1, round((bd * aa - ad * ab) / det, 6), round(aa / det, 9) FROM s")
def inversion_weighted_prior(spark, d):
    import numpy as np

    m, covariance = inversion.solve(*_greens(spark, d), 2, prior=np.array([5.0, 0.0]), prior_weight=np.diag([2.0, 3.0]))
    return _parameters(spark, m, variance=np.diag(covariance))


@query(f"""WITH {GREENS}, s AS (SELECT *, aa * bb - ab * ab AS det FROM n), c AS (
  SELECT (ad * bb - bd * ab) / det AS x, (bd * aa - ad * ab) / det AS y FROM s UNION ALL SELECT e, greatest(-1, least(1.1e0, (bd - ab * e) / bb)) FROM s, (VALUES (0.2e0), (3e0)) v(e) UNION ALL SELECT greatest(0.2e0, least(3, (ad - ab * e) / aa)), e FROM s, (VALUES (-1e0), (1.1e0)) v(e)),
b AS (SELECT x, y FROM c, n WHERE x BETWEEN 0.2e0 AND 3 AND y BETWEEN -1 AND 1.1e0 ORDER BY aa * x * x / 2 + ab * x * y + bb * y * y / 2 - ad * x - bd * y LIMIT 1)
SELECT 0 AS col, round(x, 6) AS m FROM b UNION ALL SELECT 1, round(y, 6) FROM b""")
def inversion_bounded(spark, d):
    import numpy as np

    m, _ = inversion.solve(*_greens(spark, d), 2, prior=np.array([5.0, 0.0]), prior_weight=np.diag([2.0, 3.0]), low=[0.2, -1.0], high=[3.0, 1.1])
    return _parameters(spark, m)


#: Rows (p, q, limit) of constraints p x + q y <= limit on the two parameters.
LIMITS = [(1.0, 1.0, 1.2), (-1.0, 2.0, 0.5), (0.0, -1.0, 0.3), (-1.0, 0.0, -0.4)]


@query(f"""WITH {GREENS}, s AS (SELECT *, aa * bb - ab * ab AS det, (ad * bb - bd * ab) / (aa * bb - ab * ab) AS x0, (bd * aa - ad * ab) / (aa * bb - ab * ab) AS y0 FROM n),
l(p, q, t) AS (VALUES {', '.join(f'({p}e0, {q}e0, {t}e0)' for p, q, t in LIMITS)}),
c AS (SELECT x0 AS x, y0 AS y FROM s
  UNION ALL SELECT x0 - f * (bb * p - ab * q) / det, y0 - f * (aa * q - ab * p) / det FROM (SELECT *, (p * x0 + q * y0 - t) / ((p * (bb * p - ab * q) + q * (aa * q - ab * p)) / det) AS f FROM s, l)
  UNION ALL SELECT (a.t * b.q - b.t * a.q) / (a.p * b.q - b.p * a.q), (a.p * b.t - b.p * a.t) / (a.p * b.q - b.p * a.q) FROM l a, l b WHERE a.p * b.q - b.p * a.q > 0),
b AS (SELECT x, y FROM c, n WHERE NOT EXISTS (SELECT 1 FROM l WHERE p * x + q * y > t + 1e-9) ORDER BY aa * x * x / 2 + ab * x * y + bb * y * y / 2 - ad * x - bd * y LIMIT 1)
SELECT 0 AS col, round(x, 6) + 0e0 AS m FROM b UNION ALL SELECT 1, round(y, 6) + 0e0 FROM b""")
def inversion_inequality(spark, d):
    """Parameters under inequalities; the SQL tries all corners, edges and the inside."""
    import numpy as np

    rows = np.array(LIMITS)
    m, _ = inversion.solve(*_greens(spark, d), 2, prior=np.array([5.0, 0.0]), prior_weight=np.diag([2.0, 3.0]), a=rows[:, :2], b=rows[:, 2])
    return _parameters(spark, m).withColumn("m", F.col("m") + 0.0)


@query("""WITH g AS (SELECT CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS part, o_custkey % 50 / 10e0 AS b, o_totalprice / 100000 + o_custkey % 50 / 9e0 AS d, 1 / (1e0 + o_orderkey % 3) AS w FROM orders),
s AS (SELECT part, count(*) AS n, sum(w) AS s, sum(w * b) AS sb, sum(w * b * b) AS sbb, sum(w * d) AS sd, sum(w * b * d) AS sbd, sum(w * d * d) AS sdd FROM g GROUP BY part),
m AS (SELECT *, (sd * sbb - sbd * sb) / (s * sbb - sb * sb) AS m0, (sbd * s - sd * sb) / (s * sbb - sb * sb) AS m1 FROM s)
SELECT part, round(m0, 6) AS m0, round(m1, 6) AS m1, round((sdd - m0 * sd - m1 * sbd) / (n - 2), 6) AS variance FROM m""")
def inversion_vce(spark, d):
    """Six parameters and three variances: a line for each data set, so that Helmert's equations have a closed form."""
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("key"), F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2).alias("part"), (F.col("o_custkey") % 50 / 10).alias("b"), (F.col("o_totalprice") / 100000 + F.col("o_custkey") % 50 / 9).alias("d"), (1 / (1.0 + F.col("o_orderkey") % 3)).alias("weight"))
    rows = rows.withColumn("row", F.col("key"))
    each = F.array(F.struct((2 * F.col("part")).alias("col"), F.lit(1.0).alias("value")), F.struct((2 * F.col("part") + 1).alias("col"), F.col("b").alias("value")))
    m, variance = inversion.variance_components(rows.select("row", F.explode(each).alias("x")).select("row", "x.*"), rows.select("row", "part", "d", "weight"), 6, rigorous=True)
    return spark.createDataFrame([(k, *(round(float(v), 6) for v in (m[2 * k], m[2 * k + 1], variance[k]))) for k in variance], "part int, m0 double, m1 double, variance double")


@query(f"""WITH {GREENS.replace(' + 2 AS aa', ' + 0.5e0 AS aa').replace(' + 3 AS bb', ' + 0.5e0 AS bb').replace(' + 2 * 5 AS ad', ' AS ad')}, s AS (SELECT *, aa * bb - ab * ab AS det FROM n) SELECT 0 AS col, round((ad * bb - bd * ab) / det, 6) AS m FROM s UNION ALL SELECT 1, round((bd * aa - ad * ab) / det, 6) FROM s""")
def inversion_row_passes(spark, d):
    """Damped least squares by passes over the rows, without products of parameters."""
    return _parameters(spark, inversion.iterated(*_greens(spark, d), 2, damping=0.5))


@query("SELECT s_suppkey, CAST(CAST(x AS DATE) AS VARCHAR) AS date, 0e0 AS e, 0e0 AS n FROM supplier, generate_series(DATE '2024-01-01', DATE '2024-03-01', INTERVAL 12 DAY) t(x)")
def series_initialized(spark, d):
    rows = series.initialized(table(spark, d, "supplier").select("s_suppkey"), "2024-01-01", "2024-03-01", 12, ["e", "n"])
    return rows.withColumn("date", F.col("date").cast("string"))


@query("SELECT event_id FROM events WHERE CAST(ts AS DATE) NOT IN (DATE '2024-01-05', DATE '2024-01-07')")
def series_without_dates(spark, d):
    rows = table(spark, d, "events").withColumn("day", F.to_date("ts"))
    return series.without_dates(rows, "day", [dt.date(2024, 1, 5), dt.date(2024, 1, 7)]).select("event_id")


@query("SELECT o_orderkey, o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000) AS kept FROM orders")
def pixels_kept_and_deleted(spark, d):
    ids = table(spark, d, "customer").where("c_acctbal > 5000").select(F.col("c_custkey").alias("o_custkey"))
    rows = table(spark, d, "orders")
    return series.chosen(rows, ids, "o_custkey").select("o_orderkey", F.lit(True).alias("kept")).unionByName(series.chosen(rows, ids, "o_custkey", keep=False).select("o_orderkey", F.lit(False).alias("kept")))


@query("SELECT user_id, round(coalesce(sum(value) FILTER (WHERE ts <= TIMESTAMP '2024-01-15'), 0), 4) AS value FROM events GROUP BY 1")
def slip_history_at(spark, d):
    return series.slip_at(table(spark, d, "events"), "user_id", "ts", "value", F.lit(dt.datetime(2024, 1, 15))).select("user_id", r("value"))


@query("""WITH e AS (SELECT user_id AS patch, date_trunc('day', ts) AS t, value FROM events), s AS (SELECT n_nationkey AS row, t, sum(value / (1 + patch + n_nationkey)) AS step FROM e, nation WHERE n_nationkey < 5 GROUP BY 1, 2)
SELECT row, strftime(t, '%Y-%m-%d') AS t, round(sum(step) OVER (PARTITION BY row ORDER BY t), 4) AS predicted FROM s""")
def slip_history_predicted(spark, d):
    patches = table(spark, d, "events").select(F.col("user_id").alias("col")).distinct()
    greens = table(spark, d, "nation").where("n_nationkey < 5").select(F.col("n_nationkey").alias("row")).crossJoin(patches)
    greens = greens.withColumn("value", 1 / (1.0 + F.col("col") + F.col("row")))
    rows = table(spark, d, "events").select(F.col("user_id").alias("patch"), F.date_trunc("day", "ts").alias("t"), "value").withColumnRenamed("value", "slip")
    return series.predicted(rows, greens, "patch", "t", "slip").select("row", F.date_format("t", "yyyy-MM-dd").alias("t"), r("predicted"))


@query("""WITH p AS (SELECT l_quantity AS x, l_extendedprice / 1000 AS y, l_discount AS v, CAST(greatest(0, least(4, 4 - ceil(log2(greatest(abs(l_quantity - 25) / 3, 1))))) AS INTEGER) AS level FROM lineitem)
SELECT level, CAST(floor(x / (64 / pow(2, level))) AS BIGINT) AS ix, CAST(floor(y / (64 / pow(2, level))) AS BIGINT) AS iy, round(avg(v), 6) AS value, round(stddev_pop(v), 6) AS error, count(*) AS n FROM p GROUP BY ALL""")
def downsample_by_distance(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_quantity").cast("double").alias("x"), (F.col("l_extendedprice") / 1000).alias("y"), F.col("l_discount").alias("v"))
    got = downsample.by_distance(rows, "x", "y", "v", F.abs(F.col("x") - 25), (0.0, 0.0), 64.0, 3.0, 4)
    return got.select("level", "ix", "iy", r("value", 6), r("error", 6), "n")


@query("WITH h AS (SELECT p_partkey AS k, p_partkey - row_number() OVER (ORDER BY p_partkey) AS run FROM part WHERE p_size > 15) SELECT k, min(k) OVER (PARTITION BY run) AS asperity FROM h")
def slip_asperities(spark, d):
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("k"), "p_size")
    beside = rows.select(F.col("k").alias("face"), F.explode(F.array(F.col("k") - 1, F.col("k") + 1)).alias("neighbor"))
    return series.asperities(beside, rows, "k", F.col("p_size") > 15)


@query("""WITH RECURSIVE p AS (SELECT c_custkey AS k, c_nationkey * 1e0 AS x, c_acctbal / 100 AS y FROM customer), n AS (SELECT a.k AS a, b.k AS b FROM p a JOIN p b ON sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) <= 1.5),
core AS (SELECT a AS k FROM n GROUP BY 1 HAVING count(*) >= 4), e AS (SELECT a, b FROM n WHERE a IN (SELECT k FROM core) AND b IN (SELECT k FROM core)),
reach(k, c) AS (SELECT k, k FROM core UNION SELECT e.b, reach.c FROM reach JOIN e ON e.a = reach.k AND e.b > reach.c), l AS (SELECT k, min(c) AS c FROM reach GROUP BY 1),
m(k, c) AS (SELECT k, c FROM l UNION SELECT e.b, m.c FROM m JOIN e ON e.a = m.k), f AS (SELECT k, min(c) AS c FROM m GROUP BY 1),
edge AS (SELECT n.a AS k, min(f.c) AS c FROM n JOIN f ON f.k = n.b GROUP BY 1)
SELECT p.k AS c_custkey, coalesce(f.c, edge.c) AS cluster, f.c IS NOT NULL AS core FROM p LEFT JOIN f USING (k) LEFT JOIN edge USING (k)""")
def cluster_density(spark, d):
    cus = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").cast("double").alias("x"), (F.col("c_acctbal") / 100).alias("y"))
    return graph.dbscan(cus, "c_custkey", "x", "y", 1.5, 4)


def _lloyd(rounds: int) -> str:
    near = "(SELECT k, x, y, (SELECT i FROM {c} ORDER BY pow(p.x - cx, 2) + pow(p.y - cy, 2), i LIMIT 1) AS i FROM p)"
    text = "WITH p AS (SELECT c_custkey AS k, c_nationkey * 1e0 AS x, c_acctbal / 400 AS y FROM customer), c0(i, cx, cy) AS (VALUES (0, 0e0, 0e0), (1, 10e0, 10e0), (2, 25e0, 20e0))"
    for n in range(rounds):
        text += f", c{n + 1} AS (SELECT i, avg(x) AS cx, avg(y) AS cy FROM {near.format(c=f'c{n}')} GROUP BY i)"
    return text + f" SELECT k, CAST(i AS INTEGER) AS cluster FROM {near.format(c=f'c{rounds}')}"


@query(_lloyd(3))
def cluster_centers(spark, d):
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").cast("double").alias("x"), (F.col("c_acctbal") / 400).alias("y"))
    return series.centered(rows, ["x", "y"], [(0, 0), (10, 10), (25, 20)], 3)[0].select("k", "cluster")


def _near_lists(k: int) -> str:
    """Each vector's nearest centre (the first of equals) in round k, and the next round's centres, component by component."""
    return f"""n{k} AS (SELECT vec_id, e, (SELECT c FROM c{k} ORDER BY list_sum(list_transform(range(1, 65), lambda i: pow(v.e[i] - c{k}.m[i], 2))), c LIMIT 1) AS c FROM v),
u{k} AS (SELECT c, i, avg(e[i]) AS a FROM (SELECT c, e, unnest(range(1, 65)) AS i FROM n{k}) GROUP BY c, i), c{k + 1} AS (SELECT c, coalesce(l, m) AS m FROM c{k} LEFT JOIN (SELECT c, list(a ORDER BY i) AS l FROM u{k} GROUP BY c) USING (c))"""


@query(f"""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), c0 AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS c, e AS m FROM v ORDER BY vec_id LIMIT 4), {_near_lists(0)}, {_near_lists(1)}
SELECT vec_id, CAST(c AS INTEGER) AS prediction FROM n1""")
def cluster_kmeans(spark, d):
    """All vectors by four centres in 64 dimensions, which start at the first four vectors and move once."""
    rows = table(spark, d, "embeddings").select("vec_id", *(F.col("embedding")[k].cast("double").alias(f"e{k}") for k in range(64)))
    names = [f"e{k}" for k in range(64)]
    start = [[r[c] for c in names] for r in rows.orderBy("vec_id").limit(4).collect()]
    return series.centered(rows, names, start, 1)[0].select("vec_id", F.col("cluster").alias("prediction"))


# The same clusters under their older name.
SQL["cluster_dbscan"] = SQL["cluster_density"]
