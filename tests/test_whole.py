import numpy as np
from pyspark.sql import functions as F

from landloom.ml import pca
from landloom.operators import focal, gapfill, masks, pipelines, stats
from landloom.plans import local, steps
from landloom.plans.tables import table

D = "/root/testdata/sf0.001"


def test_mutual_information_counts_all_rows(spark):
    v = np.random.default_rng(0).integers(0, 2, 12_000)
    df = spark.createDataFrame([(float(i), int(y)) for i, y in enumerate(v)], "a double, y int")
    seen = stats.mutual_information(df, ["a"], "y")
    plan = seen._jdf.queryExecution().optimizedPlan().toString()
    assert "Limit" not in plan and seen.first().importance >= 0


def test_stream_composites_equals_the_batch(spark):
    e = table(spark, D, "events").withColumn("ts", F.col("ts").cast("timestamp")).dropDuplicates(["event_id"])
    v = F.when(F.col("value") != 0, F.col("value").cast("double"))
    w = F.window("ts", "60 days", "30 days")
    want = {(r[0], r[1], r[2], r[3]) for r in e.groupBy("event_type", w.alias("w")).agg(F.count(v).alias("n")).select("event_type", F.to_date("w.start"), F.to_date("w.end"), "n").collect()}
    got = [(r.event_type, r.opens, r.closes, r.n_valid) for r in steps.stream_composites(spark, D).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_reproject_utm_returns_all_rows(spark):
    p = table(spark, D, "points_df")
    got = local.reproject_utm(spark, D).collect()
    valid = p.where("geom.x between 100000 and 900000 and geom.y between 0 and 10000000").count()
    assert len(got) == p.count() and sum(r.lon is not None and r.error_m is not None for r in got) == valid


def test_inpainting_carries_gradients_and_distances_are_euclidean():
    y, x = np.mgrid[:20, :24].astype(float)
    ramp = 3 * y + 2 * x
    hole = np.zeros(ramp.shape, bool)
    hole[6:13, 8:15] = True
    got = masks.inpaint_array(np.where(hole, 0, ramp), hole)
    assert np.abs(got - ramp)[hole].max() < 1.5 and (got[~hole] == ramp[~hole]).all()
    t = np.full((1, 1), np.inf)
    assert masks._arrival(np.pad(t, 1, constant_values=0.0), np.pad(np.zeros((1, 1), bool), 1, constant_values=True), 1, 1) == np.sqrt(0.5)


def test_fill_array_takes_the_nearest_of_each_quadrant():
    a = np.full((7, 7), np.nan)
    a[0, 0], a[3, 5], a[6, 3], a[3, 6] = 10.0, 20.0, 40.0, 99.0
    got = focal.fill_array(a, 5)
    d = np.array([np.sqrt(18), 2.0, 3.0])
    assert np.isclose(got[3, 3], (np.array([10, 20, 40]) / d).sum() / (1 / d).sum())
    assert np.isnan(focal.fill_array(np.full((2, 2), np.nan), 3)).all() and np.isnan(focal.fill_array(a, 1)[1, 3])


def test_correlations_with_gaps_and_constants(spark):
    rows = [(1.0, 2.0, 5.0, None), (2.0, 4.0, 5.0, None), (3.0, 7.0, 5.0, 1.0), (None, 1.0, 5.0, None)]
    got = {(r.a, r.b): r["corr"] for r in stats.correlations(spark.createDataFrame(rows, "a double, b double, k double, one double"), ["a", "b", "k", "one"]).collect()}
    assert np.isclose(got["a", "b"], np.corrcoef([1, 2, 3], [2, 4, 7])[0, 1]) and got["a", "b"] == got["b", "a"]
    assert all(got[p] is None for p in (("a", "k"), ("k", "k"), ("one", "one"), ("one", "a"))) and np.isclose(got["b", "b"], 1)


def test_components_of_many_columns_and_round_trip(spark, tmp_path):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 144)) @ rng.normal(size=(144, 144)) + 1e4
    cols = [f"c{i}" for i in range(144)]
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)] + [(300, None, *map(float, x[0, 1:]))], ["id", *cols])
    p = pca.fit(df, cols)
    want = np.linalg.eigvalsh(np.cov(x.T))[::-1]
    assert np.allclose(p.variance, np.maximum(want, 0), rtol=1e-6, atol=1e-3)
    p.save(spark, str(tmp_path / "pca"))
    q = pca.Pca.load(spark, str(tmp_path / "pca"))
    out = {r.id: (r.PC1, r.PC2) for r in q.transform(df, 2, ["id"]).collect()}
    assert np.allclose([out[i] for i in range(300)], (x - x.mean(0)) @ p.components[:2].T) and out[300] == (None, None)


def test_latest_delivery_to_the_microsecond_and_over_decades(spark):
    import datetime as dt

    for years in (0, 40):
        base = dt.datetime(2021, 1, 1)
        rows = [(1, base, 100), (1, base + dt.timedelta(microseconds=1), 50), (2, None, 7), (2, base - dt.timedelta(days=365 * years), 3), (3, base, 5), (3, base, 9)]
        df = spark.createDataFrame(rows, "id int, at timestamp_ntz, v int")
        d = gapfill.Dating(df, "at")
        assert d.wide == (years > 0)
        got = {r.id: r.v for r in df.groupBy("id").agg(d.value(F.max(d.key(F.col("at"), F.col("v")))).alias("v")).collect()}
        assert got == {1: 50, 2: 3, 3: 9}


def test_first_experiment_and_legacy_names(spark):
    assert stats.next_experiment(spark.createDataFrame([], "n string"), "n").first()[0] == 0
    assert stats.next_experiment(spark.createDataFrame([("experiment_7",), ("experiment_x",)], "n string"), "n").first()[0] == 8
    assert pipelines.legacy_columns(1, 1) == ["band_1_month_1", "GLCMcontrast", "GLCMdissimilarity", "GLCMhomogeneity", "GLCMenergy", "GLCMcorrelation", "GLCMASM"]
