"""Queries over whole driver tables, each beside the DuckDB SQL that must give the same rows.

Roles: ``events`` is a catalog (value / 100 is a magnitude) and a set of series by user; ``lineitem`` a pixel set
(quantity, price); ``part`` the patches of faults (size is depth, price is slip); ``supplier`` and ``customer``
are networks; ``nation`` holds places. Doubles are rounded on both sides, as sums come in another order.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geo, seismo
from ..operators import aggregates, downsample, fits, graph, joins, ordered, predicates, profiles, sets
from ..streaming.catalog import windowed_moment
from . import forward

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}
SQL: dict[str, str] = {}
START, END = dt.datetime(2024, 1, 5), dt.datetime(2024, 1, 20)
POLYGON = [(2.0, 10000.0), (45.0, 20000.0), (40.0, 90000.0), (20.0, 40000.0), (5.0, 80000.0)]
TRACE = [(0.0, 0.0), (10.0, 5.0), (25.0, 5.0), (50.0, 12.0)]


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        REGISTRY[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", "ts", "user_id", "event_type", "value", (F.col("value") / 100).alias("m"))


def pixels(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(F.col("l_quantity").alias("x"), F.col("l_extendedprice").alias("y"), (F.col("l_discount") * 100).alias("v"), F.col("l_returnflag").alias("flag"), F.col("l_suppkey").alias("k"))


def r(column: str, digits: int = 4):
    """Rounded, with no negative zero."""
    return (F.round(column, digits) + 0.0).alias(column)


# Filters


@query("SELECT event_id, user_id, value FROM events WHERE user_id > 20 AND user_id < 80 AND value > 100 AND value < 300")
def catalog_selectbox(spark, d):
    return predicates.box(events(spark, d), "user_id", "value", (20, 80, 100.0, 300.0)).select("event_id", "user_id", "value")


@query("SELECT event_id, value FROM events WHERE ts > TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-20'")
def catalog_selecttime_open(spark, d):
    return predicates.between(events(spark, d), "ts", START, END).select("event_id", "value")


@query("SELECT event_id, value FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts <= TIMESTAMP '2024-01-20'")
def series_trim(spark, d):
    return predicates.between(events(spark, d), "ts", START, END, closed=True).select("event_id", "value")


@query("SELECT event_id, value FROM events WHERE value / 100 > 1 AND value / 100 < 3")
def catalog_selectmagnitude(spark, d):
    return predicates.between(events(spark, d), "m", 1.0, 3.0).select("event_id", "value")


@query("""
WITH p AS (SELECT l_orderkey, l_linenumber, l_quantity AS x, l_extendedprice AS y FROM lineitem),
v(k, x1, y1, x2, y2) AS (VALUES (0, 2.0, 10000.0, 45.0, 20000.0), (1, 45.0, 20000.0, 40.0, 90000.0), (2, 40.0, 90000.0, 20.0, 40000.0), (3, 20.0, 40000.0, 5.0, 80000.0), (4, 5.0, 80000.0, 2.0, 10000.0))
SELECT l_orderkey, l_linenumber, x, y FROM p
WHERE (SELECT sum(CASE WHEN (y1 > y) <> (y2 > y) AND x < (x2 - x1) * (y - y1) / (y2 - y1) + x1 THEN 1 ELSE 0 END) FROM v) % 2 = 1
""")
def polygon_filter(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("x"), F.col("l_extendedprice").alias("y"))
    return rows.where(predicates.in_polygon(F.col("x"), F.col("y"), POLYGON))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')")
def network_keep_names(spark, d):
    return predicates.keep_names(table(spark, d, "orders"), "o_orderpriority", ["1-URGENT", "2-HIGH"]).select("o_orderkey", "o_totalprice")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH')")
def network_reject_names(spark, d):
    return predicates.keep_names(table(spark, d, "orders"), "o_orderpriority", ["1-URGENT", "2-HIGH"], keep=False).select("o_orderkey", "o_totalprice")


@query("SELECT event_id FROM events WHERE value <> 0 AND NOT isnan(value) AND abs(value) <= 400")
def pixels_clean(spark, d):
    rows = predicates.drop_non_finite(predicates.drop_zeros(events(spark, d), "value"), "value")
    return predicates.limit_amplitude(rows, 400.0, "value").select("event_id")


@query("""
SELECT rule, n_input, n_removed, n_input - n_removed AS n_kept FROM (
  SELECT 'finite' AS rule, count(*) AS n_input, CAST(0 AS BIGINT) AS n_removed FROM events
  UNION ALL SELECT 'range', count(*), count(*) FILTER (WHERE NOT value BETWEEN 10 AND 300) FROM events
  UNION ALL SELECT 'kind', count(*), count(*) FILTER (WHERE event_type = 'error') FROM events WHERE value BETWEEN 10 AND 300)
""")
def rule_filter_report(spark, d):
    rules = {"finite": geo.is_finite(F.col("value")), "range": F.col("value").between(10, 300), "kind": F.col("event_type") != "error"}
    return predicates.rules(events(spark, d), rules)[1].select("rule", F.col("n_input").cast("long").alias("n_input"), F.col("n_removed").cast("long").alias("n_removed"), F.col("n_kept").cast("long").alias("n_kept"))


@query("SELECT event_id FROM events JOIN (SELECT user_id, avg(value) m, stddev_pop(value) s, count(*) n FROM events GROUP BY 1) USING (user_id) WHERE n <= 2 OR s = 0 OR abs(value - m) <= 1.5 * s")
def outliers_zscore(spark, d):
    return predicates.outliers(events(spark, d), "value", "zscore", 1.5, ["user_id"]).select("event_id")


@query("SELECT event_id FROM events JOIN (SELECT user_id, quantile_cont(value, 0.25) a, quantile_cont(value, 0.75) b, count(*) n FROM events GROUP BY 1) USING (user_id) WHERE n <= 4 OR value BETWEEN a - 0.5 * (b - a) AND b + 0.5 * (b - a)")
def outliers_iqr(spark, d):
    return predicates.outliers(events(spark, d), "value", "iqr", 0.5, ["user_id"]).select("event_id")


@query("SELECT p_partkey, p_size FROM part WHERE p_size BETWEEN 10 AND 20")
def patches_in_depth(spark, d):
    return predicates.depth_window(table(spark, d, "part"), "p_size", 10, 20).select("p_partkey", "p_size")


# Statistics


@query("SELECT CAST(floor(value / 100 / 0.1) AS BIGINT) AS bin, round((floor(value / 100 / 0.1) + 0.5) * 0.1, 4) AS center, count(*) AS n, CAST(sum(count(*)) OVER (ORDER BY floor(value / 100 / 0.1) DESC) AS BIGINT) AS n_above FROM events GROUP BY floor(value / 100 / 0.1)")
def catalog_gr_histogram(spark, d):
    return aggregates.magnitude_histogram(events(spark, d), "m", 0.1).select("bin", r("center"), "n", "n_above")


@query("SELECT event_type, round(0.4342944819032518 / (avg(value / 100) - (min(value / 100) - 0.05)), 6) AS b, count(*) AS n FROM events GROUP BY 1")
def catalog_bvalue_mle(spark, d):
    return aggregates.b_value_likelihood(events(spark, d), "m", 0.1, ["event_type"]).select("event_type", r("b", 6), "n")


BVALUE = """
WITH h AS (SELECT event_type, floor(value / 100 / 0.1) AS bin, count(*) AS n FROM events GROUP BY ALL),
c AS (SELECT event_type, bin * 0.1 AS m, log10(sum(n) OVER (PARTITION BY event_type ORDER BY bin DESC)) AS y FROM h)
SELECT event_type, round(-regr_slope(y, m), 6) AS b, round(regr_intercept(y, m), 6) AS a FROM c GROUP BY 1
"""


@query(BVALUE)
def catalog_bvalue_lsq(spark, d):
    return aggregates.b_value_least_squares(events(spark, d), "m", 0.1, by=["event_type"]).select("event_type", r("b", 6), r("a", 6))


@query("SELECT CAST(floor(l_quantity / 5) AS BIGINT) AS ix, CAST(floor(l_extendedprice / 10000) AS BIGINT) AS iy, count(*) AS n FROM lineitem GROUP BY ALL")
def catalog_map_histogram(spark, d):
    return aggregates.histogram_2d(pixels(spark, d), "x", "y", (5.0, 10000.0))


@query("SELECT user_id, count(value) AS n, round(avg(value), 4) AS mean, round(median(value), 4) AS median, min(value) AS min, max(value) AS max, round(stddev_pop(value), 4) AS std, round(quantile_cont(value, 0.25), 4) AS q25, round(quantile_cont(value, 0.75), 4) AS q75 FROM events GROUP BY 1")
def profile_statistics(spark, d):
    return aggregates.summary(events(spark, d), "value", ["user_id"]).select("user_id", "n", r("mean"), r("median"), "min", "max", r("std"), r("q25"), r("q75"))


def _observed(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_returnflag").alias("dataset"), F.col("l_extendedprice").alias("o"), (F.col("l_quantity") * 1500).alias("p"))


@query("""
WITH e AS (SELECT l_returnflag AS name, l_extendedprice AS o, l_extendedprice - l_quantity * 1500 AS r FROM lineitem),
m AS (SELECT 'dataset' AS scope, name, sqrt(avg(r * r)) AS rms, (1 - sum(r * r) / sum(o * o)) * 100 AS vr, sum(r * r) AS ss_res, sum(o * o) AS ss_obs, count(*) AS n FROM e GROUP BY name),
u AS (SELECT * FROM m UNION ALL SELECT 'dataset_average', 'all', avg(rms), avg(vr), sum(ss_res), sum(ss_obs), sum(n) FROM m
UNION ALL SELECT 'stacked', 'all', sqrt(avg(r * r)), (1 - sum(r * r) / sum(o * o)) * 100, sum(r * r), sum(o * o), count(*) FROM e)
SELECT scope, name, round(rms, 3) AS rms, round(vr, 6) AS vr, round(ss_res / 1e6, 3) AS ss_res, round(ss_obs / 1e6, 3) AS ss_obs, CAST(n AS BIGINT) AS n FROM u
""")
def fit_report(spark, d):
    rows = aggregates.fit_report(_observed(spark, d), "o", "p", "dataset").withColumns({"ss_res": F.col("ss_res") / 1e6, "ss_obs": F.col("ss_obs") / 1e6})
    return rows.select("scope", "name", r("rms", 3), r("vr", 6), r("ss_res", 3), r("ss_obs", 3), "n")


@query("SELECT l_returnflag AS flag, CAST(floor(l_quantity / 4) AS BIGINT) AS bin, round(avg(l_extendedprice), 3) AS value, round(avg(l_quantity), 4) AS position, round(stddev_pop(l_extendedprice), 3) AS std, count(*) AS n FROM lineitem GROUP BY ALL")
def profile_bins_mean(spark, d):
    return aggregates.binned(pixels(spark, d), "x", "y", 4.0, by=["flag"]).select("flag", "bin", r("value", 3), r("position"), r("std", 3), "n")


@query("SELECT l_returnflag AS flag, CAST(floor(l_quantity / 4) AS BIGINT) AS bin, round(median(l_extendedprice), 3) AS value, count(*) AS n FROM lineitem GROUP BY ALL")
def profile_bins_median(spark, d):
    return aggregates.binned(pixels(spark, d), "x", "y", 4.0, by=["flag"], how="median").select("flag", "bin", r("value", 3), "n")


@query("""
WITH b(bin, low, high) AS (VALUES (0, 0.0, 10.0), (1, 10.0, 25.0), (2, 25.0, 50.0), (3, 50.0, 80.0)),
g AS (SELECT CASE WHEN p_size >= 50 THEN 3 WHEN p_size >= 25 THEN 2 WHEN p_size >= 10 THEN 1 ELSE 0 END AS bin, avg(p_retailprice) AS mean, max(p_retailprice) AS mx, median(p_retailprice) AS md, stddev_pop(p_retailprice) AS std, count(*) AS n FROM part WHERE p_size BETWEEN 0 AND 80 GROUP BY 1)
SELECT bin, CAST(low AS DOUBLE) AS low, CAST(high AS DOUBLE) AS high, round(coalesce(mean, 0), 4) AS mean, round(coalesce(mx, 0), 4) AS max, round(coalesce(md, 0), 4) AS median, round(coalesce(std, 0), 4) AS std, coalesce(n, 0) AS n FROM b LEFT JOIN g USING (bin)
""")
def depth_statistics(spark, d):
    return aggregates.depth_statistics(table(spark, d, "part"), "p_size", "p_retailprice", [0.0, 10.0, 25.0, 50.0, 80.0]).select("bin", "low", "high", r("mean"), r("max"), r("median"), r("std"), "n")


@query("""
WITH v AS (SELECT DISTINCT round(p_size * p_size / 10.0, 4) AS d FROM part),
g AS (SELECT d, CASE WHEN d - lag(d) OVER (ORDER BY d) <= 3.5 THEN 0 ELSE 1 END AS new FROM v),
l AS (SELECT d, sum(new) OVER (ORDER BY d) AS layer FROM g)
SELECT CAST(layer AS BIGINT) AS layer, round(median(d), 4) AS depth, count(*) AS n FROM l GROUP BY layer
""")
def depth_layers(spark, d):
    rows = table(spark, d, "part").select((F.col("p_size") * F.col("p_size") / 10.0).alias("depth"))
    return aggregates.depth_layers(rows, "depth", 3.5).select(F.col("layer").cast("long").alias("layer"), r("depth"), "n")


@query("SELECT p_brand, round(sum(p_size * 1e6 * p_retailprice / 1000 * 3e10) / 1e18, 6) AS moment, round(2.0 / 3.0 * (log10(sum(p_size * 1e6 * p_retailprice / 1000 * 3e10)) - 9.1), 6) AS magnitude, round(avg(p_retailprice / 1000), 6) AS mean_slip, max(p_retailprice / 1000) AS max_slip, count(*) AS n FROM part GROUP BY 1")
def fault_moments(spark, d):
    rows = table(spark, d, "part").withColumn("slip", F.col("p_retailprice") / 1000)
    return aggregates.moments(rows, "p_size", "slip", 3e10, ["p_brand"]).withColumn("moment", F.col("moment") / 1e18).select("p_brand", r("moment", 6), r("magnitude", 6), r("mean_slip", 6), "max_slip", "n")


@query("SELECT p_brand, p_type, count(*) AS n, round(avg(p_size), 4) AS depth, round(stddev_pop(p_retailprice), 4) AS slip_std, round(sum(p_size * p_retailprice), 2) AS potency FROM part GROUP BY ROLLUP (p_brand, p_type)")
def fault_summary_rollup(spark, d):
    rows = table(spark, d, "part").rollup("p_brand", "p_type").agg(F.count("*").alias("n"), F.avg("p_size").alias("depth"), F.stddev_pop("p_retailprice").alias("slip_std"), F.sum(F.col("p_size") * F.col("p_retailprice")).alias("potency"))
    return rows.select("p_brand", "p_type", "n", r("depth"), r("slip_std"), r("potency", 2))


@query("SELECT p_brand, round(sum(p_size * p_retailprice) / sum(p_retailprice), 6) AS p_size, round(sum(p_partkey * p_retailprice) / sum(p_retailprice), 4) AS p_partkey FROM part GROUP BY 1")
def moment_centroid(spark, d):
    return aggregates.centroid(table(spark, d, "part"), "p_retailprice", "p_size", "p_partkey", by=["p_brand"]).select("p_brand", r("p_size", 6), r("p_partkey"))


@query("""
WITH u AS (SELECT p_brand, p_size, p_retailprice FROM part JOIN (SELECT p_brand, max(p_retailprice) AS top FROM part GROUP BY 1) USING (p_brand) WHERE p_retailprice >= 0.6 * top)
SELECT p_brand, CAST(sum(p_size) AS BIGINT) AS area_km2, round(2.44 * sum(p_size * 1e6 * p_retailprice * 3e10) / pow(sum(p_size) * 1e6, 1.5) / 1e6, 6) AS stress_drop FROM u GROUP BY 1
""")
def stress_drop(spark, d):
    rows = aggregates.stress_drop(table(spark, d, "part"), "p_size", "p_retailprice", 3e10, ["p_brand"], 0.6).withColumn("stress_drop", F.col("stress_drop") / 1e6)
    return rows.select("p_brand", F.col("area_km2").cast("long").alias("area_km2"), r("stress_drop", 6))


@query("SELECT p_partkey, coalesce(n, 0) AS n, round(coalesce(n, 0) / p_size, 6) AS rate FROM part LEFT JOIN (SELECT l_partkey AS p_partkey, count(*) AS n FROM lineitem WHERE l_quantity > 40 GROUP BY 1) USING (p_partkey)")
def events_per_patch_rate(spark, d):
    hits = table(spark, d, "lineitem").where("l_quantity > 40").select(F.col("l_partkey").alias("p_partkey"))
    return aggregates.counts_by_patch(hits, table(spark, d, "part"), "p_partkey", "p_size").select("p_partkey", "n", r("rate", 6))


@query("""
WITH o AS (SELECT l_suppkey AS k, l_extendedprice AS v, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice) AS i, count(*) OVER (PARTITION BY l_suppkey) AS n FROM lineitem)
SELECT k, round(avg(v), 4) AS trimmed_mean, any_value(n) AS n FROM o WHERE i > floor(n * 0.1) AND i <= n - floor(n * 0.1) GROUP BY k
""")
def cell_trimmed_mean(spark, d):
    return aggregates.trimmed_mean(pixels(spark, d), "y", 0.1, ["k"]).select("k", r("trimmed_mean"), "n")


@query("""
WITH m AS (SELECT l_suppkey AS k, median(l_extendedprice) AS m FROM lineitem GROUP BY 1)
SELECT k, round(stddev_pop(l_extendedprice), 4) AS std, round(1.4826 * median(abs(l_extendedprice - m)), 4) AS mad, round(stddev_pop(l_extendedprice) / sqrt(count(*)), 4) AS sem FROM lineitem JOIN m ON k = l_suppkey GROUP BY k
""")
def cell_spread(spark, d):
    return aggregates.spread(pixels(spark, d), "y", ["k"]).select("k", r("std"), r("mad"), r("sem"))


@query("SELECT p_partkey, round(p_retailprice / (SELECT quantile_cont(abs(p_retailprice), 0.95) FROM part), 6) AS p_retailprice FROM part")
def normalize_slip(spark, d):
    return aggregates.normalize(table(spark, d, "part"), "p_retailprice", "p95").select("p_partkey", r("p_retailprice", 6))


@query("SELECT count(value) AS n, min(value) AS min, max(value) AS max, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.01), 6) AS low, round(quantile_cont(value, 0.99), 6) AS high, round(avg(CASE WHEN value BETWEEN 5 AND 300 THEN 0.0 ELSE 1.0 END), 6) AS clipped FROM events")
def value_diagnostics(spark, d):
    return aggregates.value_diagnostics(events(spark, d), "value", 5.0, 300.0).select("n", "min", "max", r("mean", 6), r("low", 6), r("high", 6), r("clipped", 6))


# Ordered rows


@query("SELECT event_id, round(sum(value) OVER w, 4) AS running_sum, count(*) OVER w AS running_count FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)")
def catalog_moment_evolution(spark, d):
    return ordered.running(events(spark, d), ["user_id"], ["ts", "event_id"], "value").select("event_id", r("running_sum"), "running_count")


@query("SELECT event_id, round(sum(value) OVER (ORDER BY event_id ROWS UNBOUNDED PRECEDING), 4) AS running_sum FROM events")
def catalog_running_total(spark, d):
    return ordered.running_total(events(spark, d), "event_id", "value", 2000.0).select("event_id", r("running_sum"))


@query("""
WITH s AS (SELECT user_id, ts, value, sum(value) OVER (PARTITION BY user_id ORDER BY ts, value ROWS UNBOUNDED PRECEDING) AS after FROM events)
SELECT user_id, value, part, round(CASE part WHEN 0 THEN after - value ELSE after END, 4) + 0.0 AS total FROM s, (VALUES (0), (1)) p(part)
""")
def catalog_stairs(spark, d):
    return ordered.stairs(events(spark, d), ["user_id"], "ts", "value").select("user_id", "value", "part", r("total"))


@query("""
WITH w AS (SELECT event_id, coalesce(lead(event_id) OVER w, event_id) - coalesce(lag(event_id) OVER w, event_id) AS dx, coalesce(lead(value) OVER w, value) - coalesce(lag(value) OVER w, value) AS dy FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
SELECT event_id, round(CASE WHEN dx <> 0 THEN dy / dx END, 6) + 0.0 AS derivative FROM w
""")
def series_central_difference(spark, d):
    return ordered.central_difference(events(spark, d), ["user_id"], ["event_id"], "event_id", "value").select("event_id", r("derivative", 6))


@query("SELECT event_id FROM (SELECT event_id, value - 50 AS a, lead(value - 50) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events) WHERE a * b < 0")
def series_zero_crossings(spark, d):
    return ordered.zero_crossings(events(spark, d).withColumn("a", F.col("value") - 50), ["user_id"], ["ts", "event_id"], "a").select("event_id")


@query("SELECT event_id, round(value - coalesce(m, 0), 10) + 0.0 AS value FROM events LEFT JOIN (SELECT user_id, avg(value) AS m FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts <= TIMESTAMP '2024-01-20' GROUP BY 1) USING (user_id)")
def series_remove_mean(spark, d):
    return ordered.remove_mean(events(spark, d), ["user_id"], "ts", "value", START, END).select("event_id", r("value", 10))


GAPS = """
WITH s AS (SELECT event_id, user_id, CASE WHEN value BETWEEN 10 AND 200 THEN value END AS v, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
g AS (SELECT *, last_value(CASE WHEN v IS NOT NULL THEN i END IGNORE NULLS) OVER a AS bi, last_value(v IGNORE NULLS) OVER a AS bv, first_value(CASE WHEN v IS NOT NULL THEN i END IGNORE NULLS) OVER z AS ai, first_value(v IGNORE NULLS) OVER z AS av FROM s
  WINDOW a AS (PARTITION BY user_id ORDER BY i ROWS UNBOUNDED PRECEDING), z AS (PARTITION BY user_id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT event_id, round(CASE WHEN ai = bi THEN v ELSE bv + (av - bv) * (i - bi) / (ai - bi) END, 6) AS value FROM g
"""


@query(GAPS)
def series_smooth_glitches(spark, d):
    return ordered.smooth_glitches(events(spark, d), ["user_id"], ["ts", "event_id"], "value", 10.0, 200.0).select("event_id", r("value", 6))


@query("""
WITH e AS (SELECT l_returnflag AS flag, l_quantity AS x, l_extendedprice AS y FROM lineitem),
w AS (SELECT flag, unnest(range(CAST(floor((x - 6) / 2) AS BIGINT) + 1, CAST(floor(x / 2) AS BIGINT) + 1)) AS "window", y FROM e)
SELECT flag, "window", round("window" * 2.0 + 3.0, 4) AS center, round(avg(y), 3) AS mean, round(median(y), 3) AS median, min(y) AS min, max(y) AS max, count(*) AS n FROM w GROUP BY flag, "window" HAVING count(*) >= 5
""")
def swath_sliding_window(spark, d):
    return ordered.sliding(pixels(spark, d), ["flag"], "x", "y", 6.0, 2.0, 5).select("flag", "window", r("center"), r("mean", 3), r("median", 3), "min", "max", "n")


@query("""
WITH g AS (SELECT event_id, user_id, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= 7200000000 THEN 0 ELSE 1 END AS new, ts FROM events)
SELECT event_id, CAST(sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run FROM g
""")
def series_gap_groups(spark, d):
    return ordered.gap_groups(events(spark, d), ["user_id"], ["ts", "event_id"], F.unix_micros(F.col("ts").cast("timestamp")), 7_200_000_000, "run").select("event_id", "run")


@query("""
WITH v AS (SELECT n_regionkey AS trace, n_nationkey AS seq, CAST(n_nationkey AS DOUBLE) AS x, sqrt(n_nationkey) AS y FROM nation),
s AS (SELECT *, coalesce(sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2)), 0) AS d FROM v WINDOW w AS (PARTITION BY trace ORDER BY seq))
SELECT trace, seq, round(sum(d) OVER (PARTITION BY trace ORDER BY seq), 6) AS along FROM s
""")
def trace_arc_length(spark, d):
    v = table(spark, d, "nation").select(F.col("n_regionkey").alias("trace"), F.col("n_nationkey").alias("seq"), F.col("n_nationkey").cast("double").alias("x"), F.sqrt("n_nationkey").alias("y"))
    return ordered.arc_length(v, ["trace"], "seq", "x", "y").select("trace", "seq", r("along", 6))


def _grid(spark, d):
    return table(spark, d, "lineitem").groupBy(F.col("l_quantity").cast("long").alias("ix"), F.round(F.col("l_discount") * 100).cast("long").alias("iy")).agg(F.avg("l_extendedprice").alias("v"))


GRID = "WITH g AS (SELECT CAST(l_quantity AS BIGINT) AS ix, CAST(round(l_discount * 100) AS BIGINT) AS iy, avg(l_extendedprice) AS v FROM lineitem GROUP BY ALL)"


@query(GRID + " SELECT a.ix, a.iy, round(median(b.v), 4) AS smoothed FROM g a JOIN g b ON abs(a.ix - b.ix) <= 1 AND abs(a.iy - b.iy) <= 1 GROUP BY ALL")
def grid_median_filter(spark, d):
    return ordered.median_filter(_grid(spark, d), "ix", "iy", "v", 1).select("ix", "iy", r("smoothed"))


@query(GRID + " SELECT a.ix, a.iy, round(sum(b.v * exp(-((a.ix - b.ix) ** 2 + (a.iy - b.iy) ** 2) / 2.0)) / sum(exp(-((a.ix - b.ix) ** 2 + (a.iy - b.iy) ** 2) / 2.0)), 4) AS smoothed FROM g a JOIN g b ON abs(a.ix - b.ix) <= 2 AND abs(a.iy - b.iy) <= 2 GROUP BY ALL")
def grid_gaussian_smooth(spark, d):
    return ordered.gaussian_smooth(_grid(spark, d), "ix", "iy", "v", 1.0, 2).select("ix", "iy", r("smoothed"))


@query("SELECT event_id, value FROM events ORDER BY ts, event_id")
def catalog_sort_time(spark, d):
    return events(spark, d).orderBy("ts", "event_id").select("event_id", "value")


@query("SELECT user_id, event_id, rank FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rank FROM events) WHERE rank <= 3")
def catalog_largest(spark, d):
    ranked = events(spark, d).withColumn("rank", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("value"), "event_id")))
    return ranked.where("rank <= 3").select("user_id", "event_id", F.col("rank").cast("long").alias("rank"))


# Joins


def _points(spark, d):
    sup = table(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").cast("double").alias("sx"), (F.col("s_acctbal") / 100).alias("sy"))
    cus = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").cast("double").alias("cx"), (F.col("c_acctbal") / 100).alias("cy"))
    return sup, cus


PLACES = "WITH s AS (SELECT s_suppkey, CAST(s_nationkey AS DOUBLE) AS sx, s_acctbal / 100 AS sy FROM supplier), c AS (SELECT c_custkey, CAST(c_nationkey AS DOUBLE) AS cx, c_acctbal / 100 AS cy FROM customer)"


@query(PLACES + " SELECT s_suppkey, round(avg(cy), 6) AS cy_mean, round(stddev_pop(cy), 6) AS cy_std, count(*) AS n FROM s JOIN c ON sqrt((sx - cx) ** 2 + (sy - cy) ** 2) <= 3 GROUP BY 1")
def range_join_average(spark, d):
    sup, cus = _points(spark, d)
    return joins.around_points(sup, cus, ("sx", "sy"), ("cx", "cy"), 3.0, ["s_suppkey"], ["cy"]).select("s_suppkey", r("cy_mean", 6), r("cy_std", 6), "n")


@query(PLACES + ", p AS (SELECT c_custkey, s_suppkey, sqrt((cx - sx) ** 2 + (cy - sy) ** 2) AS distance, row_number() OVER (PARTITION BY c_custkey ORDER BY sqrt((cx - sx) ** 2 + (cy - sy) ** 2), s_suppkey) AS i FROM c, s) SELECT c_custkey, s_suppkey, round(distance, 6) AS distance FROM p WHERE i = 1")
def nearest_patch(spark, d):
    sup, cus = _points(spark, d)
    return joins.nearest(cus, sup, "c_custkey", "s_suppkey", ("cx", "cy"), ("sx", "sy"), 4.0).select("c_custkey", "s_suppkey", r("distance", 6))


@query("""
WITH c AS (SELECT c_custkey, CAST(c_nationkey AS DOUBLE) AS x, c_acctbal / 1000 AS y FROM customer),
v(k, x1, y1, x2, y2, start) AS (VALUES (0, 0.0, 0.0, 10.0, 5.0, 0.0), (1, 10.0, 5.0, 25.0, 5.0, sqrt(125.0)), (2, 25.0, 5.0, 50.0, 12.0, sqrt(125.0) + 15)),
t AS (SELECT c_custkey, x, y, v.*, greatest(0, least(1, ((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / ((x2 - x1) ** 2 + (y2 - y1) ** 2))) AS t FROM c, v),
q AS (SELECT c_custkey, k, sqrt((x - x1 - t * (x2 - x1)) ** 2 + (y - y1 - t * (y2 - y1)) ** 2) AS dist, start + t * sqrt((x2 - x1) ** 2 + (y2 - y1) ** 2) AS along FROM t)
SELECT c_custkey, round(min(dist), 6) AS trace_distance, round(arg_min(along, dist), 5) AS along FROM q GROUP BY 1
""")
def project_to_trace(spark, d):
    cus = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").cast("double").alias("x"), (F.col("c_acctbal") / 1000).alias("y"))
    return joins.to_trace(cus, "x", "y", TRACE).select("c_custkey", r("trace_distance", 6), r("along", 5))


def _daily(spark, d):
    return table(spark, d, "orders").groupBy("o_orderpriority", F.to_date("o_orderdate").alias("day")).agg(F.sum("o_totalprice").alias("v"))


DAILY = "WITH s AS (SELECT o_orderpriority, CAST(o_orderdate AS DATE) AS day, sum(o_totalprice) AS v FROM orders GROUP BY ALL)"


@query(DAILY + " SELECT o_orderpriority, round(max(v) FILTER (WHERE day = DATE '1999-01-04') - max(v) FILTER (WHERE day = DATE '1996-03-05'), 3) AS \"offset\" FROM s GROUP BY 1")
def series_offset_between_dates(spark, d):
    return joins.offset_between(_daily(spark, d), "o_orderpriority", "day", "v", dt.date(1996, 3, 5), dt.date(1999, 1, 4)).select("o_orderpriority", r("offset", 3))


@query(DAILY + ", ref AS (SELECT day, avg(v) AS r FROM s GROUP BY 1), m AS (SELECT o_orderpriority, avg(v - r) AS shift FROM s JOIN ref USING (day) GROUP BY 1) SELECT o_orderpriority, CAST(day AS VARCHAR) AS day, round(v - shift, 3) AS v FROM s JOIN m USING (o_orderpriority)")
def series_reference_to(spark, d):
    daily = _daily(spark, d)
    out = joins.reference_series(daily, daily.groupBy("day").agg(F.avg("v").alias("v")), "day", "v", "o_orderpriority")
    return out.select("o_orderpriority", F.col("day").cast("string").alias("day"), r("v", 3))


@query(DAILY + " SELECT a.o_orderpriority, CAST(a.day AS VARCHAR) AS day, round(avg(b.v), 5) AS v_near FROM s a LEFT JOIN s b ON a.o_orderpriority = b.o_orderpriority AND b.day BETWEEN a.day - 2 AND a.day + 2 GROUP BY 1, 2")
def series_interval_mean(spark, d):
    daily = _daily(spark, d)
    return joins.interval_mean(daily.select("o_orderpriority", "day"), daily, "o_orderpriority", "day", "v", 2).select("o_orderpriority", F.col("day").cast("string").alias("day"), r("v_near", 5))


@query("""
WITH a AS (SELECT event_id, user_id, event_id AS t FROM events WHERE event_type = 'click'),
b AS (SELECT user_id, event_id AS t, value FROM events WHERE event_type <> 'click')
SELECT x.event_id, p.value AS value_before, n.value AS value_after, round(p.value + (n.value - p.value) * (x.t - p.t) / (n.t - p.t), 9) AS value_between
FROM a x ASOF LEFT JOIN b p ON x.user_id = p.user_id AND x.t >= p.t ASOF LEFT JOIN b n ON x.user_id = n.user_id AND x.t <= n.t
""")
def series_as_of(spark, d):
    rows = events(spark, d).withColumn("t", F.col("event_id"))
    left = rows.where("event_type = 'click'").select("event_id", "user_id", "t")
    right = rows.where("event_type <> 'click'").select("user_id", "t", "value")
    return joins.as_of(left, right, "user_id", "t", "value").select("event_id", "value_before", "value_after", r("value_between", 9))


@query("""
WITH c AS (SELECT n_nationkey AS cell, n_nationkey * 4.0 AS x0, n_nationkey * 4.0 + 6 AS x1, n_regionkey * 15000.0 AS y0, n_regionkey * 15000.0 + 20000 AS y1 FROM nation)
SELECT cell, count(*) AS n, round(avg(l_extendedprice), 4) AS value FROM lineitem JOIN c ON l_quantity >= x0 AND l_quantity < x1 AND l_extendedprice >= y0 AND l_extendedprice < y1 GROUP BY 1
""")
def points_in_cells(spark, d):
    cells = table(spark, d, "nation").select(F.col("n_nationkey").alias("cell"), (F.col("n_nationkey") * 4.0).alias("x0"), (F.col("n_nationkey") * 4.0 + 6).alias("x1"), (F.col("n_regionkey") * 15.0).alias("y0"), (F.col("n_regionkey") * 15.0 + 20).alias("y1"))
    points = pixels(spark, d).withColumn("z", F.col("y") / 1000)
    return joins.in_cells(points, cells, "x", "z", 10.0).groupBy("cell").agg(F.count("*").alias("n"), F.avg("y").alias("value")).select("cell", "n", r("value"))


# Sets


@query("SELECT event_id, 0 AS part FROM events WHERE value < 100 UNION ALL SELECT event_id, 1 FROM events WHERE value > 50")
def catalog_merge(spark, d):
    e = events(spark, d).select("event_id", "value")
    return sets.merge(e.where("value < 100"), e.where("value > 50"), tag="part").select("event_id", "part")


NETS = "WITH a AS (SELECT user_id, sum(value) AS v FROM events WHERE value < 200 AND user_id < 100 GROUP BY 1), b AS (SELECT user_id, sum(value) AS v FROM events WHERE value >= 50 AND user_id > 40 GROUP BY 1)"


def _networks(spark, d):
    e = events(spark, d)
    return tuple(e.where(w).groupBy("user_id").agg(F.sum("value").alias("v")) for w in ("value < 200 and user_id < 100", "value >= 50 and user_id > 40"))


@query(NETS + " SELECT user_id, round(v, 4) AS v FROM a UNION ALL SELECT user_id, round(v, 4) FROM b WHERE user_id NOT IN (SELECT user_id FROM a)")
def network_import(spark, d):
    return sets.import_stations(*_networks(spark, d), "user_id").select("user_id", r("v"))


@query(NETS + " SELECT user_id, round(a.v - b.v, 4) + 0.0 AS v FROM a JOIN b USING (user_id)")
def network_subtract(spark, d):
    return sets.subtract_stations(*_networks(spark, d), "user_id", "v").select("user_id", r("v"))


@query("SELECT DISTINCT CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day FROM orders UNION SELECT CAST(CAST(l_shipdate AS DATE) AS VARCHAR) FROM lineitem")
def set_ops_dates(spark, d):
    a = table(spark, d, "orders").select(F.to_date("o_orderdate").cast("string").alias("day"))
    b = table(spark, d, "lineitem").select(F.to_date("l_shipdate").cast("string").alias("day"))
    return sets.all_dates(a, b, column="day")


# Fits


@query("SELECT user_id, round(regr_slope(value, event_id), 8) AS slope, round(regr_intercept(value, event_id), 5) AS intercept, round(regr_r2(value, event_id), 8) AS r2, regr_count(value, event_id)::BIGINT AS n FROM events GROUP BY 1")
def series_fit_linear(spark, d):
    return fits.linear_by_group(events(spark, d), ["user_id"], "event_id", "value").select("user_id", r("slope", 8), r("intercept", 5), r("r2", 8), "n")


@query("SELECT l_returnflag AS flag, round(sum(l_quantity), 2) AS g0_1, round(sum(l_quantity * l_quantity), 2) AS g1_1, round(sum(l_discount * 100 * l_quantity), 2) AS g1_2, round(sum(l_extendedprice) / 1e3, 3) AS d0, round(sum(l_quantity * l_extendedprice) / 1e3, 3) AS d1, count(*) AS n FROM lineitem GROUP BY 1")
def normal_equations_ramp(spark, d):
    p = pixels(spark, d)
    rows = fits.normal_equations(p, fits.ramp(F.col("x"), F.col("v")), "y", by=["flag"]).withColumns({"d0": F.col("d0") / 1e3, "d1": F.col("d1") / 1e3})
    return rows.select("flag", r("g0_1", 2), r("g1_1", 2), r("g1_2", 2), r("d0", 3), r("d1", 3), "n")


@query("""
WITH p AS (SELECT l_suppkey AS k, l_quantity AS x, l_extendedprice AS y FROM lineitem), f AS (SELECT regr_slope(y, x) AS a, regr_intercept(y, x) AS b FROM p)
SELECT k, round(sum(y - a * x - b) / 1e3, 3) + 0.0 AS residual, count(*) AS n FROM p, f GROUP BY k
""")
def ramp_removed(spark, d):
    p = pixels(spark, d)
    design = [F.lit(1.0), F.col("x")]
    fitted = p.withColumn("y", F.col("y") - fits.evaluate(design, fits.solve(p, design, "y")))
    return fitted.groupBy("k").agg((F.sum("y") / 1e3).alias("residual"), F.count("*").alias("n")).select("k", r("residual", 3), "n")


@query()
def ramp_robust(spark, d):
    p = pixels(spark, d)
    design = fits.ramp(F.col("x"), F.col("v"))
    off = F.col("y") - fits.evaluate(design, fits.huber(p, design, "y"))
    return p.groupBy("flag").agg(F.median(off).alias("residual"), F.count("*").alias("n"))


@query("SELECT event_id, (event_id - 100.0) AS linear, CASE WHEN event_id >= 5000 THEN 1.0 ELSE 0.0 END AS step, round(CASE WHEN event_id >= 5000 THEN ln(1 + (event_id - 5000) / 100.0) ELSE 0 END, 6) AS log, round(cos(2 * pi() * event_id / 365.0), 6) + 0.0 AS cos FROM events")
def time_function_matrix(spark, d):
    t = F.col("event_id").cast("double")
    made = {"linear": seismo.time_function("linear", t, 100.0), "step": seismo.time_function("step", t, 5000.0), "log": seismo.time_function("log", t, 5000.0, 100.0), "cos": seismo.time_function("cos", t, 0.0, 365.0)}
    return events(spark, d).select("event_id", *(v.alias(k) for k, v in made.items())).select("event_id", "linear", "step", r("log", 6), r("cos", 6))


# Profiles


@query("""
WITH c AS (SELECT c_custkey, c_nationkey - 12.0 AS e, c_acctbal / 1000 - 5.0 AS n FROM customer),
p AS (SELECT c_custkey, e * sin(radians(60)) + n * cos(radians(60)) AS along, e * cos(radians(60)) - n * sin(radians(60)) AS across FROM c)
SELECT c_custkey, round(along, 6) + 0.0 AS along, round(across, 6) + 0.0 AS across FROM p WHERE abs(along) <= 8 AND abs(across) <= 3
""")
def profile_swath(spark, d):
    cus = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").cast("double").alias("x"), (F.col("c_acctbal") / 1000).alias("y"))
    return profiles.swath(cus, "x", "y", (12.0, 5.0), 60.0, 16.0, 6.0).select("c_custkey", r("along", 6), r("across", 6))


@query("""
WITH p AS (SELECT l_suppkey AS k, l_quantity AS x, l_extendedprice AS y FROM lineitem),
f AS (SELECT k, regr_slope(y, x) AS a, regr_intercept(y, x) AS b FROM p WHERE x BETWEEN 10 AND 30 GROUP BY k)
SELECT k, round(sum(y - a * x - b), 2) + 0.0 AS y, count(*) AS n FROM p LEFT JOIN f USING (k) GROUP BY k
""")
def profile_reference_linear(spark, d):
    out = profiles.reference_profile(pixels(spark, d), "x", "y", 10.0, 30.0, "linear", ["k"])
    return out.groupBy("k").agg(F.sum("y").alias("y"), F.count("*").alias("n")).select("k", r("y", 2), "n")


@query("""
WITH p AS (SELECT l_suppkey AS k, l_quantity - 25 AS x, l_extendedprice AS y FROM lineitem)
SELECT k, CASE WHEN count(*) FILTER (WHERE x >= 2) > 10 AND count(*) FILTER (WHERE x <= -2) > 10 THEN round(regr_intercept(y, x) FILTER (WHERE x >= 2) - regr_intercept(y, x) FILTER (WHERE x <= -2), 3) END AS "offset", count(*) AS n FROM p GROUP BY k
""")
def profile_side_offset(spark, d):
    p = pixels(spark, d).withColumn("x", F.col("x") - 25)
    return profiles.side_offset(p, "x", "y", 4.0, ["k"]).select("k", r("offset", 3), "n")


# Down-sampling, covariance, meshes and clusters


QUADTREE = "WITH RECURSIVE p AS (SELECT l_quantity AS x, l_extendedprice / 2000 AS y, l_extendedprice AS v FROM lineitem), s AS (SELECT level, CAST(floor(x / (64 / 2 ** level)) AS BIGINT) AS ix, CAST(floor(y / (64 / 2 ** level)) AS BIGINT) AS iy, stddev_pop(v) > 3000 AND level < 4 AS split, avg(v) AS value, count(*) AS n FROM p, range(0, 5) l(level) GROUP BY ALL), t AS (SELECT * FROM s WHERE level = 0 UNION ALL SELECT s.* FROM s JOIN t ON t.split AND s.level = t.level + 1 AND s.ix // 2 = t.ix AND s.iy // 2 = t.iy) SELECT CAST(level AS INTEGER) AS level, ix, iy, round(value, 4) AS value, n FROM t WHERE NOT split"


@query(QUADTREE.replace("GROUP BY ALL", "GROUP BY 1, 2, 3"))
def quadtree_downsample(spark, d):
    p = pixels(spark, d).withColumns({"z": F.col("y") / 2000})
    return downsample.quadtree(p, "x", "z", "y", (0.0, 0.0), 64.0, 3000.0, 4).select("level", "ix", "iy", r("value"), "n")


@query("""
WITH c AS (SELECT c_custkey AS k, CAST(c_nationkey AS DOUBLE) AS x, c_acctbal / 100 AS y, c_acctbal / 1000 AS v FROM customer),
p AS (SELECT sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS d, a.v AS v, b.v AS w FROM c a JOIN c b ON a.k > b.k)
SELECT CAST(floor(d) AS BIGINT) AS bin, round(avg((v - w) ** 2) / 2, 6) AS semivariance, round(avg(abs(v * w)) / 2, 6) AS covariance, count(*) AS n FROM p WHERE d < 6 GROUP BY 1
""")
def variogram(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").cast("double").alias("x"), (F.col("c_acctbal") / 100).alias("y"), (F.col("c_acctbal") / 1000).alias("v"))
    return downsample.variogram(c, "k", "x", "y", "v", 1.0, 6.0).select("bin", r("semivariance", 6), r("covariance", 6), "n")


def _faces(spark, d):
    k = F.col("p_partkey")
    return table(spark, d, "part").select(k.alias("face"), F.floor(k / 2).alias("a"), (F.floor(k / 2) + 1).alias("b"), F.when(k % 2 == 0, F.floor(k / 2) + 100000).otherwise(F.floor(k / 2) + 100001).alias("c"))


MESH = "WITH f AS (SELECT p_partkey AS face, p_partkey // 2 AS a, p_partkey // 2 + 1 AS b, CASE WHEN p_partkey % 2 = 0 THEN p_partkey // 2 + 100000 ELSE p_partkey // 2 + 100001 END AS c FROM part), e AS (SELECT face, least(a, b) AS a, greatest(a, b) AS b FROM f UNION ALL SELECT face, least(b, c), greatest(b, c) FROM f UNION ALL SELECT face, least(c, a), greatest(c, a) FROM f)"


@query(MESH + ", n AS (SELECT DISTINCT x.face AS face, y.face AS neighbor FROM e x JOIN e y USING (a, b) WHERE x.face <> y.face) SELECT face AS row, face AS col, CAST(count(*) AS DOUBLE) AS value FROM n GROUP BY face UNION ALL SELECT face, neighbor, -1.0 FROM n")
def mesh_laplacian(spark, d):
    return graph.laplacian(graph.adjacency(_faces(spark, d), "face", ("a", "b", "c")))


@query(MESH + " SELECT a, b, min(face) AS face FROM e GROUP BY a, b HAVING count(*) = 1")
def mesh_boundary_edges(spark, d):
    return graph.boundary_edges(_faces(spark, d), "face", ("a", "b", "c"))


@query()
def cluster_dbscan(spark, d):
    cus = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").cast("double").alias("x"), (F.col("c_acctbal") / 100).alias("y"))
    return graph.dbscan(cus, "c_custkey", "x", "y", 1.5, 4)


# Functions of columns


@query("SELECT n_nationkey, round(2 * 6371 * atan2(sqrt(h), sqrt(1 - h)), 6) AS km FROM (SELECT n_nationkey, pow(sin(radians(n_regionkey * 10 - 20) / 2), 2) + cos(radians(20)) * cos(radians(n_regionkey * 10)) * pow(sin(radians(n_nationkey * 5 - 100) / 2), 2) AS h FROM nation)")
def haversine(spark, d):
    lon, lat = F.col("n_nationkey") * 5.0, F.col("n_regionkey") * 10.0
    return table(spark, d, "nation").select("n_nationkey", geo.haversine(F.lit(100.0), F.lit(20.0), lon, lat).alias("km")).select("n_nationkey", r("km", 6))


@query("SELECT event_id, round(value * (-sin(radians(35)) * cos(radians(190))) + value / 2 * (sin(radians(35)) * sin(radians(190))) + value / 4 * cos(radians(35)), 6) + 0.0 AS los FROM events")
def los_projection(spark, d):
    v = F.col("value")
    los = geo.project(v, v / 2, v / 4, *geo.los_from_heading(F.lit(35.0), F.lit(190.0)))
    return events(spark, d).select("event_id", los.alias("los")).select("event_id", r("los", 6))


@query("SELECT event_id, round(log10(pow(10, 1.5 * value / 100 + 9.1)), 6) AS moment, round(2.0 / 3.0 * log10(pow(10, 1.5 * value / 100 + 9.1) * 1e7) - 10.7, 6) + 0.0 AS dyne, round(pow(10, -2.44 + 0.59 * value / 100), 6) AS length FROM events")
def moment_and_scaling(spark, d):
    m = seismo.moment(F.col("m"))
    rows = events(spark, d).select("event_id", F.log10(m).alias("moment"), seismo.magnitude_dyne(m).alias("dyne"), seismo.scaling("rupture_length", F.col("m")).alias("length"))
    return rows.select("event_id", r("moment", 6), r("dyne", 6), r("length", 6))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_catalog_flatten(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("SELECT c_custkey, round(0.75 / pi() * 5 * x / r, 8) + 0.0 AS e, round(0.75 / pi() * 5 * y / r, 8) + 0.0 AS n, round(0.75 / pi() * 5 * 4 / r, 8) AS u FROM (SELECT c_custkey, c_nationkey - 12.0 AS x, c_acctbal / 1000 AS y, pow((c_nationkey - 12.0) ** 2 + (c_acctbal / 1000) ** 2 + 16, 1.5) AS r FROM customer)")
def forward_mogi(spark, d):
    e, n, u = forward.mogi(F.col("c_nationkey"), F.col("c_acctbal") / 1000, 12.0, 0.0, 4.0, 5.0)
    return table(spark, d, "customer").select("c_custkey", e.alias("e"), n.alias("n"), u.alias("u")).select("c_custkey", r("e", 8), r("n", 8), r("u", 8))


def _greens(spark, d):
    """Green's functions of eight parameters: the first eight components of each vector."""
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("row"), F.posexplode(F.slice("embedding", 1, 8)).alias("col", "value")).withColumn("value", F.col("value").cast("double"))


@query("WITH g AS (SELECT vec_id AS row, unnest(range(0, 8)) AS col, unnest(embedding[1:8])::DOUBLE AS value FROM embeddings) SELECT row, round(sum(value * (col + 1)), 6) + 0.0 AS predicted FROM g GROUP BY row")
def forward_predict(spark, d):
    model = spark.range(8).select(F.col("id").cast("int").alias("col"), (F.col("id") + 1).cast("double").alias("m"))
    return forward.predict(_greens(spark, d), model).select("row", r("predicted", 6))


@query("WITH g AS (SELECT vec_id AS row, unnest(range(0, 8)) AS col, unnest(embedding[1:8])::DOUBLE AS value FROM embeddings) SELECT CAST(a.col AS INTEGER) AS i, CAST(b.col AS INTEGER) AS j, round(sum(a.value * b.value), 6) + 0.0 AS value FROM g a JOIN g b USING (row) GROUP BY 1, 2")
def inversion_gram(spark, d):
    data = table(spark, d, "embeddings").select(F.col("vec_id").alias("row"), F.col("label").cast("double").alias("d"), F.lit(1.0).alias("weight"))
    return forward.gram(_greens(spark, d), data)[0].select("i", "j", r("value", 6))


@query()
def inversion_nonnegative(spark, d):
    data = table(spark, d, "embeddings").select(F.col("vec_id").alias("row"), F.col("label").cast("double").alias("d"), F.lit(1.0).alias("weight"))
    m = forward.least_squares(_greens(spark, d), data, 8, 0.01, nonnegative=True)
    return spark.createDataFrame([(k, float(v)) for k, v in enumerate(m)], "col int, m double")


@query("SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS start, count(*) AS n, round(sum(pow(10, 1.5 * value / 100 + 9.1)) / 1e12, 3) AS moment, max(value / 100) AS largest FROM events GROUP BY 1")
def catalog_daily_moment(spark, d):
    rows = windowed_moment(events(spark, d).withColumn("ts", F.col("ts").cast("timestamp")), "ts", "m").withColumn("moment", F.col("moment") / 1e12)
    return rows.select(F.to_date("start").cast("string").alias("start"), "n", r("moment", 3), "largest")
