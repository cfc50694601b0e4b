"""What made queries fail or go wrong on larger tables, on small ones."""

import duckdb
import pytest
from pyspark.sql import functions as F

from quakespark.operators import chains, fits, graph
from quakespark.sources import formats


def planned_bits(df):
    """How many bits the estimated size of a table has."""
    return df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().bit_length()


def test_loops_plan_by_size(spark):
    n = 300
    faces = spark.range(n).select(F.col("id").alias("face"), F.lit(-1).cast("long").alias("a"), F.col("id").alias("b"), ((F.col("id") + 1) % n).alias("c"))
    loops = chains.boundary_loops(faces, "face", ("a", "b", "c"))
    assert planned_bits(loops) < 1000
    assert loops.agg(F.count("*"), F.countDistinct("line"), F.max("pos")).first()[:] == (n, 1, n - 1)
    joined = graph.components(spark.range(n).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")))
    assert planned_bits(joined) < 1000
    assert [r[:] for r in joined.groupBy("component").count().collect()] == [(0, n + 1)]


def test_places_are_worked_out_once(spark):
    from quakespark.operators.shared import at_places

    rows = spark.range(1000).select("id", F.when(F.col("id") % 5 > 0, F.col("id") % 5 / 10).alias("x"))
    met = spark.sparkContext.accumulator(0)

    def work(places):
        places.foreach(lambda _: met.add(1))
        return places.select("id", (F.coalesce("x", F.lit(9.0)) * 2).alias("y"))

    got = at_places(rows, "id", ["x"], work)
    assert met.value == 5
    assert got.count() == 1000 and got.where(F.col("y") != F.when(F.col("id") % 5 > 0, F.col("id") % 5 / 5).otherwise(18.0)).isEmpty()


@pytest.fixture(scope="module")
def larger(tmp_path_factory):
    """The smallest tables' keys, moved up."""
    folder = tmp_path_factory.mktemp("larger")
    con = duckdb.connect()
    at = "/root/testdata/sf0.001"
    con.sql(f"COPY (SELECT * REPLACE (p_partkey + 999900 * i AS p_partkey) FROM '{at}/part.parquet', range(3) t(i)) TO '{folder}/part.parquet'")
    con.sql(f"COPY (SELECT * REPLACE (s_suppkey + 101 * i AS s_suppkey) FROM '{at}/supplier.parquet', range(40) t(i)) TO '{folder}/supplier.parquet'")
    con.sql(f"COPY (SELECT * REPLACE (user_id + 400 * i AS user_id) FROM '{at}/events.parquet', range(3) t(i)) TO '{folder}/events.parquet'")
    con.sql(f"COPY (SELECT * REPLACE (c_custkey + 151 * i AS c_custkey) FROM '{at}/customer.parquet', range(4) t(i)) TO '{folder}/customer.parquet'")
    con.sql(f"COPY (SELECT * FROM '{at}/nation.parquet') TO '{folder}/nation.parquet'")
    return str(folder)


NAMES = ["patches_model_covariance", "slip_smoothed", "file_surface", "slip_gradient", "slip_history_predicted", "range_join_average", "nearest_patch", "variogram", "variogram_crowded", "cluster_density", "data_covariance"]


@pytest.mark.parametrize("name", NAMES)
def test_moved_keys_match_sql(spark, larger, name):
    import __spark_entry__

    con = duckdb.connect()
    for t in ("part", "supplier", "events", "customer", "nation"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{larger}/{t}.parquet'")
    want = con.sql(__spark_entry__.oracle_sql()[name])
    got = __spark_entry__.queries()[name](spark, larger).select(*want.columns)
    rows = lambda values: sorted(tuple(round(v, 5) + 0.0 if isinstance(v, float) else v for v in r) for r in values)
    mine, theirs = rows(got.collect()), rows(want.fetchall())
    assert len(mine) == len(theirs)
    for m, t in zip(mine, theirs, strict=True):
        assert m == pytest.approx(t, abs=3e-5, nan_ok=True), name


def test_layers_of_many_points(spark):
    import time

    from quakespark.operators import meshes

    layers = spark.createDataFrame([("a", 1.0, 10.0), ("a", 3.0, 30.0)], "g string, z double, v double")
    points = spark.range(60_000).select("id", F.lit("a").alias("g"), (F.col("id") / 10_000).alias("z"))
    began = time.perf_counter()
    got = meshes.between_layers(points, layers, "g", "z", "v").where(F.abs(F.col("v") - F.greatest(F.lit(10.0), F.least(F.lit(30.0), F.col("z") * 10))) < 1e-9)
    assert got.count() == 60_000
    assert time.perf_counter() - began < 20


def test_neighbors_rank_equal_distances_by_key(spark):
    import numpy as np

    from quakespark.operators import meshes

    k = np.arange(240)
    x, y, z = k * 37 % 11 / 10.0, k * 53 % 7 / 10.0, k * 29 % 5 / 10.0
    rows = spark.createDataFrame([(int(a), float(b), float(c), float(d)) for a, b, c, d in zip(k, x, y, z, strict=True)], "k long, x double, y double, z double")
    got = {}
    for r in meshes.neighbors(rows, "k", ("x", "y", "z"), 6, 0.5).where("place <= 6").collect():
        got.setdefault(r.a, {})[r.place] = r.b
    d = np.sqrt((x[:, None] - x) ** 2 + (y[:, None] - y) ** 2 + (z[:, None] - z) ** 2)
    for a in k:
        want = [b for b in np.lexsort((k, d[a])) if b != a][:6]
        assert [got[a][i] for i in range(1, 7)] == want


def test_sums_within_beside_all_pairs(spark):
    import numpy as np

    from quakespark.operators import meshes

    rng = np.random.default_rng(5)
    x, y, z, v = rng.uniform(-3, 3, (4, 400))
    rows = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(zip(x, y, z, v, strict=True))] + [(400, None, 0.0, 0.0, 1.0)], "k long, x double, y double, z double, v double")
    d = np.sqrt((x[:, None] - x) ** 2 + (y[:, None] - y) ** 2 + (z[:, None] - z) ** 2)
    near = d <= 1.5
    want = np.stack([(near * v).sum(1), (near * d * v).sum(1), np.zeros(400), np.where(near, d, 0).max(1)], 1)
    for block in (50_000, 7):
        got = {r.k: r[1:] for r in meshes.sums_within(rows, "k", ("x", "y", "z"), "v", 1.5, [np.ones_like, np.asarray], block).collect()}
        assert sorted(got) == list(range(400))
        assert np.array([got[k] for k in range(400)]) == pytest.approx(want, abs=1e-9)


def test_stations_files_take_no_task_each(spark, tmp_path):
    import __spark_entry__

    spark.range(900).selectExpr("id AS event_id", "timestamp_seconds(id) AS ts", "id % 300 AS user_id", "id / 4 AS value").write.parquet(f"{tmp_path}/events.parquet")
    context = spark.sparkContext
    context.setJobGroup("stations", "stations")
    got = __spark_entry__.queries()["file_series_by_station"](spark, str(tmp_path)).collect()
    context.setLocalProperty("spark.jobGroup.id", None)
    assert {r.station: (r.n, r.total) for r in got} == {k: (3, (3 * k + 900) / 4) for k in range(300)}
    stages = {s for j in context.statusTracker().getJobIdsForGroup("stations") for s in context.statusTracker().getJobInfo(j).stageIds}
    assert sum(i.numTasks for s in stages if (i := context.statusTracker().getStageInfo(s))) < 300


def test_stations_of_odd_names_by_both_readers(spark, tmp_path):
    names = ["a/b", "x=y", "50%", "é 1", "[q]", '"', "", None, formats.NO_STATION, "plain"]
    rows = [(s, k, text) for s in names for k, text in enumerate(["one", None, "é", "two\rthree"])]
    path = f"{tmp_path}/by station"
    formats.write_series_by_station(spark.createDataFrame(rows, "`st/n` string, k int, v string"), path, "st/n", ["k", "v"])
    want = sorted(((s if s not in ("", formats.NO_STATION) else None, line) for s in names for line in ("0 one", "1", "2 é", "3 two", "three")), key=repr)
    assert sorted(((r.station, r.value) for r in formats.series_by_station(spark, path, "st/n").collect()), key=repr) == want
    assert sorted(((r["st/n"], r.value) for r in spark.read.text(path).collect()), key=repr) == want
    with pytest.raises(FileExistsError):
        formats.write_series_by_station(spark.createDataFrame(rows, "`st/n` string, k int, v string"), path, "st/n", ["k", "v"])
    spark._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.store.link./there", f"file://{tmp_path}")
    formats.write_series_by_station(spark.range(40).selectExpr("id % 4 AS s", "id"), "viewfs://store/there/spark", "s", ["id"])
    assert {r[:] for r in formats.series_by_station(spark, "viewfs://store/there/spark", "s").collect()} == {(str(k % 4), str(k)) for k in range(40)}
    formats.write_series_by_station(spark.createDataFrame([], "s string, v string"), f"{path}-none", "s", ["v"])
    assert formats.series_by_station(spark, f"{path}-none", "s").count() == 0


def test_a_long_station_is_read_in_pieces(spark, tmp_path):
    formats.write_series_by_station(spark.range(120_001).select(F.lit("one").alias("s"), "id"), f"{tmp_path}/long", "s", ["id"])
    got = formats.series_by_station(spark, f"{tmp_path}/long", "s").selectExpr("count(*)", "count(DISTINCT value)", "sum(cast(value AS long))").first()
    assert got[:] == (120_001, 120_001, 120_000 * 120_001 // 2)


def test_rounds_of_decays_plan_by_size(spark):
    rows = spark.range(60).selectExpr("id % 2 AS g", "double(id - 10) AS t", "2 + 3 * log1p(greatest(id - 10, 0) / (5 + id % 2)) + 0.05 * sin(id) AS v")
    assert planned_bits(fits.decay(rows, ["g"], "t", "v", "log", rounds=8)) < 1000


@pytest.mark.parametrize("keys", ["p_partkey + 400 * (p_partkey // 12)", "p_partkey"])
def test_first_boundary_of_many(spark, tmp_path, keys):
    import __spark_entry__

    con = duckdb.connect()
    con.sql(f"CREATE TABLE part AS SELECT {keys} AS p_partkey FROM range(60) t(p_partkey)")
    con.sql(f"COPY part TO '{tmp_path}/part.parquet'")
    want = con.sql(__spark_entry__.oracle_sql()["mesh_boundary_loop"])
    got = __spark_entry__.queries()["mesh_boundary_loop"](spark, str(tmp_path)).select(*want.columns)
    assert sorted(r[:] for r in got.collect()) == sorted(want.fetchall())


def test_variogram_of_a_dense_line(spark):
    import time

    from quakespark.operators import downsample

    n = 40_000
    rows = spark.range(n).selectExpr("id AS k", "0.0D AS x", "id / 16384 AS y", "id % 2 AS v")
    began = time.perf_counter()
    got = {r.bin: r[1:] for r in downsample.variogram(rows, "k", "x", "y", "v", 0.5, 2.0).collect()}
    assert time.perf_counter() - began < 60
    for b in range(4):
        apart = range(max(1, b * 8192), (b + 1) * 8192)
        pairs = sum(n - k for k in apart)
        assert got[b][2] == pairs
        assert got[b][0] == pytest.approx(sum(n - k for k in apart if k % 2) / pairs / 2, rel=1e-9)
        assert got[b][1] == pytest.approx(sum((n - k) // 2 for k in apart if k % 2 == 0) / pairs / 2, rel=1e-9)


@pytest.mark.parametrize("seed", range(3))
def test_variogram_beside_all_pairs(spark, monkeypatch, seed):
    import numpy as np

    from quakespark.operators import downsample

    for name, value in (("TILE", 23), ("LEAST", 23), ("LEAF", 4), ("AT_ONCE", 64)):
        monkeypatch.setattr(downsample, name, value)
    rng = np.random.default_rng(seed)
    n = 300
    x, y = rng.integers(-6, 6, (2, n)) / 2.0 if seed else rng.uniform(-4, 4, (2, n))
    x[0] = 1e300 if seed == 2 else x[0]
    v = [None if k % 11 == 0 else float(f) for k, f in enumerate(rng.normal(5, 2, n))]
    rows = spark.createDataFrame([(k, float(a), float(b), c) for k, (a, b, c) in enumerate(zip(x, y, v, strict=True))] + [(n, None, 0.0, 1.0), (None, 0.0, 0.0, 1.0)], "k long, x double, y double, v double")
    got = {r.bin: r[1:] for r in downsample.variogram(rows, "k", "x", "y", "v", 0.7, 3.5).collect()}
    i, j = np.triu_indices(n, 1)
    with np.errstate(over="ignore"):
        d = np.sqrt((x[i] - x[j]) ** 2 + (y[i] - y[j]) ** 2)
    w = np.array([np.nan if a is None else a for a in v])
    near = d < 3.5
    bins = np.floor(d[near] / 0.7)
    assert sorted(got) == sorted(set(bins))
    for b in got:
        own = bins == b
        assert got[b][2] == own.sum()
        assert got[b][0] == pytest.approx(np.nanmean((w[i] - w[j])[near][own] ** 2) / 2, rel=1e-9)
        assert got[b][1] == pytest.approx(np.nanmean(np.abs(w[i] * w[j])[near][own]) / 2, rel=1e-9)


@pytest.mark.parametrize("seed", range(4))
def test_clusters_beside_all_pairs(spark, monkeypatch, seed):
    import numpy as np

    rng = np.random.default_rng(seed)
    n = 400
    x, y = rng.integers(-9, 9, (2, n)) / 2.0 if seed == 1 else rng.uniform(-6, 6, (2, n))
    if seed == 2:
        x[:6], y[:6] = 1e300, [0, 0.5, 1.0, 90, 91, 1e300]
        x[6:9] = float("inf")
    if seed == 3:
        x = np.repeat([0.0, 1.0 + 2**-30], n // 2)
    rows = spark.createDataFrame([(int(k), float(a), float(b)) for k, a, b in zip(rng.permutation(n), x, y, strict=True)] + [(n + k, None, 0.0) for k in range(4)], "k long, x double, y double")
    key = [r.k for r in rows.collect()][:n]
    with np.errstate(all="ignore"):
        near = np.sqrt((x[:, None] - x) ** 2 + (y[:, None] - y) ** 2) <= 1.0
    for least in (3, 8):
        core = near.sum(1) >= least
        label = np.where(core, key, n * n)
        while True:
            low = np.where(core, np.where(near & core, label, n * n).min(1), n * n)
            if (low == label).all():
                break
            label = low
        found = np.where(near & core, label, n * n).min(1)
        want = {k: (None if f == n * n else int(f), bool(c)) for k, f, c in zip(key, found, core, strict=True)}
        got = {r.k: (r.cluster, r.core) for r in graph.dbscan(rows, "k", "x", "y", 1.0, least, salt=1 + seed % 2).collect()}
        assert got == want | {n + k: (None, False) for k in range(4)}


def test_cells_are_linked_by_halves(spark):
    n = 3000
    rows = spark.range(2 * n).selectExpr("id AS k", "IF(id < {0}, 0.0, 1.0 + 1e-9 * (id % 7 - 1)) AS x".format(n), "(id % {0}) / 4000 + IF(id < {0}, 0, 0.0000001D) AS y".format(n))
    got = graph.dbscan(rows, "k", "x", "y", 1.0, 4).groupBy("cluster", "core").count().collect()
    assert [r[:] for r in got] == [(0, True, 2 * n)]
