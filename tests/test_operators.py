"""NumPy golden tests, properties and the decisions on known oddities."""

import datetime as dt
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from landloom.functions import indices, scalars
from landloom.ml import pca, svm
from landloom.operators import focal, masks, pipelines, stats, temporal, texture, vector


def raster(spark, a, name="v"):
    return spark.createDataFrame([(int(y), int(x), float(a[y, x])) for y, x in np.ndindex(a.shape)], f"y int, x int, {name} double")


def back(df, col, shape):
    out = np.full(shape, np.nan)
    for r in df.select("y", "x", F.col(col).cast("double").alias("v")).collect():
        out[r.y, r.x] = np.nan if r.v is None else r.v
    return out


A = np.random.default_rng(0).integers(0, 900, (12, 15)).astype(float)


def test_gradient_equals_numpy(spark):
    gy, gx = np.gradient(A)
    r = raster(spark, A)
    assert np.allclose(back(focal.slope(r, [], "v"), "slope", A.shape), np.degrees(np.arctan(np.hypot(gx, gy))))
    assert np.allclose(back(focal.aspect(r, [], "v"), "aspect", A.shape), (450 - np.degrees(np.arctan2(gy, -gx))) % 360)
    assert np.allclose(back(focal.slope(raster(spark, A + 77), [], "v"), "slope", A.shape), np.degrees(np.arctan(np.hypot(gx, gy))))


def test_sobel_and_single_axis(spark):
    p = np.pad(A, 1, mode="edge")
    k = np.array([[-1, 0, 1], [-2, 0, 2], [-1, 0, 1]])
    sx = sum(k[i, j] * p[i : i + 12, j : j + 15] for i in range(3) for j in range(3))
    sy = sum(k.T[i, j] * p[i : i + 12, j : j + 15] for i in range(3) for j in range(3))
    r = raster(spark, A)
    assert np.allclose(back(focal.sobel(r, [], "v"), "sobel", A.shape), np.hypot(sx, sy))
    assert np.allclose(back(focal.sobel(r, [], "v", single_axis=True), "sobel", A.shape), 4 * abs(sy))


def test_morphology(spark):
    m = (A > 600).astype(float)
    r = raster(spark, m)
    lo, hi = np.pad(m, 1, constant_values=9), np.pad(m, 1, constant_values=-9)
    box = [(i, j) for i in range(3) for j in range(3)]
    assert np.array_equal(back(focal.erode(r, [], "v", "o"), "o", m.shape), np.min([lo[i : i + 12, j : j + 15] for i, j in box], 0))
    assert np.array_equal(back(focal.dilate(r, [], "v", "o"), "o", m.shape), np.max([hi[i : i + 12, j : j + 15] for i, j in box], 0))
    cross = [(0, 1), (1, 0), (1, 1), (1, 2), (2, 1)]
    assert np.array_equal(back(focal.dilate(r, [], "v", "o", cross=True), "o", m.shape), np.max([hi[i : i + 12, j : j + 15] for i, j in cross], 0))
    twice = focal.dilate(focal.dilate(r, [], "v", "a"), [], "a", "o")
    assert np.array_equal(back(focal.dilate(r, [], "v", "o", radius=2), "o", m.shape), back(twice, "o", m.shape))
    opened, closed = back(focal.opening(r, [], "v", "o"), "o", m.shape), back(focal.closing(r, [], "v", "o"), "o", m.shape)
    assert (opened <= m).all() and (closed >= m).all()


def test_glcm_against_matrix(spark):
    g = (254 * (A - A.min()) / (A.max() - A.min()) + 1).astype(int)
    got = {(r.wy, r.wx): r for r in texture.glcm(raster(spark, A), [], "v", 7, 1, 12, 15).collect()}
    assert set(got) == {(0, 0), (0, 1)}
    for (wy, wx), r in got.items():
        w = g[wy * 7 : wy * 7 + 7, wx * 7 : wx * 7 + 7]
        m = np.zeros((256, 256))
        np.add.at(m, (w[:, :-1].ravel(), w[:, 1:].ravel()), 1)
        m = (m + m.T) / (m + m.T).sum()
        i, j = np.mgrid[:256, :256]
        mu, var = (m * i).sum(), (m * (i - (m * i).sum()) ** 2).sum()
        want = [(m * (i - j) ** 2).sum(), (m * abs(i - j)).sum(), (m / (1 + (i - j) ** 2)).sum(), (m**2).sum(), np.sqrt((m**2).sum()), (m * (i - mu) * (j - mu)).sum() / var]
        assert np.allclose([r[p] for p in texture.PROPERTIES], want)


def test_constant_layer_has_correlation_one(spark):
    r = texture.glcm(raster(spark, np.full((7, 7), 5.0)), [], "v").first()
    assert (r.contrast, r.energy, r.correlation) == (0.0, 1.0, 1.0)


def test_spline_reproduces_cubics_and_clamps():
    x = np.arange(8.0)
    m = texture.spline_matrix(8, 33)
    at = np.minimum(np.linspace(0, 8, 33), 7)
    assert np.allclose(m @ (x**3 - 2 * x), at**3 - 2 * at)
    assert texture.spline_matrix(1, 4).shape == (4, 1)


def test_gap_fill_golden(spark):
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate((0, 5, 0, 7, 0))], "p int, t int, v int")
    assert [r.filled for r in temporal.gap_fill(df, ["p"], "t", "v").orderBy("t").collect()] == [5, 5, 6, 7, 7]
    two = spark.createDataFrame([(1, i, v) for i, v in enumerate((4, 0, 0, 8))], "p int, t int, v int")
    assert [r.filled for r in temporal.gap_fill(two, ["p"], "t", "v").orderBy("t").collect()] == [4, 2, 4, 8]  # raw neighbours


def test_midpoint_percentile_and_empty_group(spark):
    df = spark.createDataFrame([(1, v) for v in (5, 1, 9, 7, 3, 2)] + [(2, None)], "k int, v int")
    got = {r.k: r.b for r in df.groupBy("k").agg(temporal.midpoint_percentile(F.col("v"), 0.25).alias("b")).collect()}
    assert got == {1: 2.5, 2: 0.0}


@settings(max_examples=15, deadline=None)
@given(st.lists(st.integers(1, 500), min_size=1, max_size=12))
def test_gap_fill_leaves_full_series_alone(spark, values):
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate(values)], "p int, t int, v int")
    assert [r.filled for r in temporal.gap_fill(df, ["p"], "t", "v").orderBy("t").collect()] == values


def test_masks_with_one_value(spark):
    df = spark.createDataFrame([(1, True), (1, True), (2, False)], "s int, m boolean")
    assert {r.s: r.share for r in masks.mask_share(df, ["s"], "m").collect()} == {1: 1.0, 2: 0.0}


def test_kmeans_separates_groups():
    v = np.array([1, 2, 3, 100, 101, 500], float)
    assert np.allclose(masks.kmeans_1d(v, np.ones(6)), [2, 100.5, 500])
    assert len(masks.kmeans_1d(np.array([7.0]), np.array([3.0]))) == 1


def test_cloud_refinement_takes_the_bright_cluster(spark):
    rows = [(1, 0, x, 100.0 + x % 3, 100.0, False) for x in range(20)] + [(1, 1, x, 3000.0, 100.0, x < 3) for x in range(6)] + [(1, 2, x, 900.0, 100.0, False) for x in range(6)]
    df = spark.createDataFrame(rows, "s int, y int, x int, blue double, back double, cloud boolean")
    out = masks.refine_cloud(df, ["s"], "blue", "back", "cloud", 0.01).where("cloud_refined").select("y").distinct().collect()
    assert [r.y for r in out] == [1]
    assert masks.refine_cloud(df, ["s"], "blue", "back", "cloud", 0.9).where("cloud_refined <> cloud").count() == 0


def test_histogram_matching_moves_mean_and_spread(spark):
    rng = np.random.default_rng(1)
    rows = [(i, float(v), i < 200) for i, v in enumerate(np.concatenate([rng.normal(200, 10, 200), rng.normal(900, 40, 400)]))]
    out = masks.match_histogram(spark.createDataFrame(rows, "i int, b double, zone boolean"), [], ["b"], rounded=False)
    s = {r.zone: (r.m, r.s) for r in out.groupBy("zone").agg(F.avg("b").alias("m"), F.stddev_samp("b").alias("s")).collect()}
    assert np.allclose(s[True], s[False])
    flat = spark.createDataFrame([(1, 5.0, True), (2, 9.0, False), (3, 8.0, False)], "i int, b double, zone boolean")
    assert [r.b for r in masks.match_histogram(flat, [], ["b"]).orderBy("i").collect()] == [5, 9, 8]


def test_inpainting_keeps_known_pixels_and_flat_images(spark):
    a = np.full((9, 9), 4.0)
    hole = np.zeros((9, 9), bool)
    hole[3:6, 3:6] = True
    broken = a.copy()
    broken[hole] = 0
    assert np.allclose(masks.inpaint_array(broken, hole), 4.0)
    df = raster(spark, broken).withColumn("hole", (F.col("y").between(3, 5)) & (F.col("x").between(3, 5)))
    assert np.allclose(back(masks.inpaint(df, [], "v", "hole", "o", block=4), "o", (9, 9)), 4.0)


@settings(max_examples=20, deadline=None)
@given(st.integers(1, 9), st.integers(1, 30))
def test_systematic_sample_size(spark, n, total):
    df = spark.createDataFrame([(i // 7, i % 7, 1) for i in range(total)], "y int, x int, c int")
    got = [(r.y, r.x) for r in vector.systematic_sample(df, "c", n).orderBy("y", "x").collect()]
    rows = [(i // 7, i % 7) for i in range(total)]
    k = min(n, total)
    assert got == rows[:: max(1, total // k)][:k]


def test_half_even_rounding_and_quantising(spark):
    r = spark.range(1).select(scalars.point_to_pixel(F.lit(5.0), F.lit(-25.0), 0.0, 0.0, 10.0, 10.0)[0].alias("a"), scalars.point_to_pixel(F.lit(25.0), F.lit(-25.0), 0.0, 0.0, 10.0, 10.0)[1].alias("b"), scalars.quantise(F.lit(0.999)).alias("c")).first()
    assert tuple(r) == (0, 2, 254)


def test_offset_and_index_antisymmetry(spark):
    r = spark.createDataFrame([(500, 1500, 3000)], "a int, b2 int, b4 int").select(scalars.dn_offset(F.col("a"), -1000).alias("o"), indices.INDICES["ndwi"]({2: F.col("b2"), 4: F.col("b4")}).alias("w"), indices.INDICES["gndvi"]({2: F.col("b2"), 4: F.col("b4")}).alias("g")).first()
    assert r.o == 0 and r.w == -r.g


def test_sliding_windows_are_exclusive(spark):
    df = spark.createDataFrame([(dt.date(2020, 1, 15),), (dt.date(2020, 1, 16),), (dt.date(2020, 1, 1),)], "t date")
    got = sorted((r.t.day, r.window_month.isoformat()) for r in temporal.assign_sliding(df, "t").collect())
    assert got == [(1, "2019-12-01"), (1, "2020-01-01"), (15, "2020-01-01"), (16, "2020-01-01"), (16, "2020-02-01")]
    assert temporal.sliding_windows(2020)[0] == ("2019-12-15", "2020-02-15")


def test_experiment_log_cases(spark):
    log = spark.createDataFrame([(0, "1.5")], "index int, SVM_a string")
    one = stats.append_log(log, spark.createDataFrame([("x,\"y\"", [1, 2])], "note string, ids array<int>"))
    assert {c: one.where("index = 1").first()[c] for c in one.columns} == {"index": 1, "SVM_a": "None", "note": 'x,"y"', "ids": "1,2"}
    assert one.where("index = 0").first().note == "None"
    two = stats.append_log(one, spark.createDataFrame([(None, 2.5)], "note string, SVM_a double"))
    assert two.where("index = 2").first().note == "None" and two.where("index = 2").first().SVM_a == "2.5"
    assert stats.flatten_keys({"a.b": {"macro avg": {"f1": 1}}, "c": 2}) == {"ab_macro-avg_f1": 1, "c": 2}


def test_correlation_of_a_constant_is_null(spark):
    df = spark.createDataFrame([(1.0, 2.0, 5.0), (2.0, 1.0, 5.0), (4.0, 0.5, 5.0)], "a double, b double, k double")
    got = {(r.a, r.b): r.corr for r in stats.correlations(df, ["a", "b", "k"]).collect()}
    assert got["a", "k"] is None and np.isclose(got["a", "b"], np.corrcoef([1, 2, 4], [2, 1, 0.5])[0, 1]) and np.isclose(got["b", "b"], 1)


def test_multicollinearity_order():
    corr = {("a", "b"): 0.9, ("a", "c"): 0.1, ("b", "c"): -0.95}
    assert stats.multicollinear(["a", "b", "c"], corr, {"a": 1.0, "b": 2.0, "c": 2.0}, 0.8) == ["a", "c"]
    assert stats.multicollinear(["a", "b", "c"], corr, {"a": 1.0, "b": 2.0, "c": 2.0}, 0.8, keep=["a"]) == ["c"]


def test_mutual_information_orders_features(spark):
    rng = np.random.default_rng(0)
    rows = [(float(c + rng.normal(0, 0.1)), float(rng.normal()), int(c)) for c in rng.integers(0, 3, 600)]
    mi = {r.feature: r.importance for r in stats.mutual_information(spark.createDataFrame(rows, "good double, bad double, y int"), ["good", "bad"], "y").collect()}
    assert mi["good"] > 0.9 and mi["bad"] < 0.1


def test_isotonic_golden():
    assert np.allclose(svm.isotonic(np.array([0.1, 0.2, 0.3, 0.4, 0.5]), np.array([0, 0, 1, 0, 1.0]))[1], [0, 0, 0.5, 0.5, 1])


def test_smo_meets_optimality_conditions():
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(-1, 1, (60, 2)), rng.normal(1, 1, (60, 2))])
    y = np.repeat([-1.0, 1.0], 60)
    k, c = svm.rbf(x, x, 0.5), np.full(120, 2.0)
    alpha, bias = svm.smo(k, y, c, 1e-4)
    f = k @ (alpha * y) + bias
    assert abs((alpha * y).sum()) < 1e-8
    assert (y * f)[alpha < 1e-9].min() > 1 - 2e-3 and (y * f)[alpha > c - 1e-9].max() < 1 + 2e-3
    free = (alpha > 1e-6) & (alpha < c - 1e-6)
    assert np.allclose((y * f)[free], 1, atol=2e-3)


def test_ensemble_modes_and_model_table(spark, tmp_path):
    rng = np.random.default_rng(3)
    centre = np.array([[0, 0], [4, 0], [0, 4.0]])
    y = rng.integers(0, 3, 240)
    x = centre[y] + rng.normal(0, 0.6, (240, 2))
    e = svm.fit_ensemble(x[:120], y[:120], x[120:], y[120:], 10.0, 0.5)
    for mode in svm.MODES:
        p = e.proba(x, mode)
        assert np.allclose(p.sum(1), 1) and (p >= 0).all() and (p <= 1).all()
        assert (e.predict(x, mode).astype(int) == y).mean() > 0.93
    again = svm.Ensemble.from_rows(e.to_rows())
    assert np.allclose(again.proba(x, "multiclass"), e.proba(x, "multiclass"))
    with pytest.raises(ValueError):
        e.proba(x, "nonsense")
    svm.save(spark, e, str(tmp_path / "model"))
    assert np.allclose(svm.load(spark, str(tmp_path / "model")).proba(x, "binary"), e.proba(x, "binary"))


def test_normalise_edge_cases():
    assert np.allclose(svm.normalise(np.array([[0.0, 0, 0], [1, 1, 2]])), [[1 / 3] * 3, [0.25, 0.25, 0.5]])
    assert np.allclose(svm.normalise(np.array([[0.9, 0.3]])), [[0.7, 0.3]])


def test_pca_centres_and_orders(spark):
    rng = np.random.default_rng(4)
    m = rng.normal(size=(200, 3)) @ np.diag([5, 1, 0.1]) + 100
    p = pca.fit(spark.createDataFrame([tuple(map(float, r)) for r in m], "a double, b double, c double"), ["a", "b", "c"])
    assert np.allclose(p.variance, np.sort(np.linalg.eigvalsh(np.cov(m.T)))[::-1])
    out = np.array([tuple(r) for r in p.transform(spark.createDataFrame([tuple(map(float, r)) for r in m], "a double, b double, c double"), 2).collect()])
    assert np.allclose(out.mean(0), 0, atol=1e-9)
    assert pca.choose(p, "cev", 0.9) == 1
    with pytest.raises(ValueError):
        pca.choose(p, "guess")


def test_points_in_literal_ring(spark):
    ring = [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (5.0, 2.0), (0.0, 10.0), (0.0, 0.0)]
    df = spark.createDataFrame([(1, (1.0, 1.0)), (2, (5.0, 5.0)), (3, (11.0, 1.0)), (4, None)], "i int, geom struct<x double, y double>")
    assert [r.i for r in vector.points_in_tile(df, ring).collect()] == [1]
    with pytest.raises(ValueError):
        vector.tile_ring(spark.createDataFrame([], "tile string, ring array<struct<x double, y double>>"), "x")


def test_emptied_class_yields_no_rows(spark):
    lc = spark.createDataFrame([(0, 0, 1), (0, 1, 2), (1, 0, 3), (1, 1, 4)], "y int, x int, class_id int")
    legend = spark.createDataFrame([(1, "one")], "lc_code int, description string")
    known = spark.createDataFrame([(0, 0)], "y int, x int")
    out = pipelines.sampled_points(lc, known, 5, legend, eroded=True).collect()
    assert out == []


def test_dataset_kinds(spark):
    a = spark.createDataFrame([(1, 1), (2, 1), (3, 2), (4, 9)], "row_id long, class_id int")
    b = spark.createDataFrame([(11, 1), (12, 2), (13, 8)], "row_id long, class_id int")
    assert pipelines.build_dataset(a, b, "std", F.col("row_id")) is a
    full = {(r.row_id, r.split) for r in pipelines.build_dataset(a, b, "fullLC", F.col("row_id")).collect()}
    assert full == {(1, "test"), (2, "test"), (3, "test"), (11, "train"), (12, "train")}
    more = pipelines.build_dataset(a, b, "enhanced", F.col("row_id"), target=4).groupBy("class_id").count().collect()
    assert {r.class_id: r["count"] for r in more} == {1: 4, 2: 4}
    with pytest.raises(ValueError):
        pipelines.build_dataset(a, b, "other", F.col("row_id"))


def test_feature_groups_metric_table_and_distances(spark):
    cols = ["x", "y", "band_1_month_1", "GLCM_energy", "slope"]
    assert stats.select_features(cols, use_glcm=False) == ["band_1_month_1", "slope"]
    assert stats.select_features(cols, False, False, False, fixed=["slope"]) == ["slope"]
    df = spark.createDataFrame([(1.0, 2.0, 3.0, 4.0, 9.0)], "SVM_a_precision double, SVM_a_recall double, `SVM_a_f1-score` double, SVM_a_support double, SVM_b_recall double")
    r = stats.metric_table(df, df.columns).collect()
    assert [(x["class"], x["f1-score"]) for x in r] == [("a", 3.0)]
    d = spark.createDataFrame([(0.0, 0.0), (3.0, 4.0), (0.1, 0.0)], "dx double, dy double")
    assert {x.bin: x.n for x in stats.distance_histogram(d, F.col("dx"), F.col("dy"), 10).collect()} == {0: 2, 9: 1}


def test_report_with_a_class_never_predicted(spark):
    conf = spark.createDataFrame([("a", "a", 3), ("b", "a", 1)], "truth string, pred string, n long")
    r = {x.label: x for x in stats.class_report(conf).collect()}
    assert (r["b"].precision, r["b"].recall, r["b"].f1) == (0.0, 0.0, 0.0) and r["accuracy"].f1 == 0.75 and abs(r["macro avg"].recall - 0.5) < 1e-12


def test_mask_refinement_pipeline_runs_on_one_date(spark):
    rows = [("T", dt.datetime(2020, 5, 1), y, x, 500 + 10 * x, 900, 800, y == 0, False) for y in range(4) for x in range(5)]
    df = spark.createDataFrame(rows, "tile string, time timestamp, y int, x int, blue int, nir int, swir int, cloud boolean, shadow boolean")
    out = pipelines.masks_refinement(df)
    assert out.count() == 20 and out.where("cloud and not cloud_refined").count() == 0


def test_fill_nodata_weights_by_distance_and_limits(spark):
    rows = [(0, 0, 1.0), (0, 1, None), (0, 2, None), (0, 3, 4.0), (5, 9, None)]
    df = spark.createDataFrame(rows, "y int, x int, v double")
    got = {(r.y, r.x): r.o for r in focal.fill_nodata(df, [], "v", "o", most=2).collect()}
    assert np.isclose(got[0, 1], (1 / 1 * 1 + 4 / 2) / (1 + 1 / 2)) and got[5, 9] is None and got[0, 3] == 4.0
    assert {(r.y, r.x): r.o for r in focal.fill_nodata(df, [], "v", "o", most=1).collect()}[0, 1] == 1.0


def test_image_selection_cases(spark):
    def pick(rows):
        df = spark.createDataFrame(rows, "name string, ts timestamp, cloud double, orbit string, nodata double")
        return {(r.month.isoformat()[:7], r.name): r.kept for r in temporal.select_images(df, [], "name", "ts", "cloud", "orbit", "nodata").collect()}

    few = [(f"i{k}", dt.datetime(2020, 5, 1 + k), float(k), "R1", 0.0) for k in range(8)]
    assert {n for (m, n) in pick(few) if m == "2020-05"} == {f"i{k}" for k in range(8)}
    many = [(f"i{k:02d}", dt.datetime(2020, 5, 1 + k), float(k), "R1", 0.0) for k in range(12)] + [("z1", dt.datetime(2020, 5, 20), 99.0, "R2", 3.0), ("z2", dt.datetime(2020, 5, 21), 98.0, "R2", 1.0)]
    got = {n: kept for (m, n), kept in pick(many).items() if m == "2020-05"}
    assert {n for n, k in got.items() if k} == {f"i{k:02d}" for k in range(8)} and {n for n, k in got.items() if not k} == {"z2"}
    short = [("a", dt.datetime(2020, 5, 2), 50.0, "R1", 0.0)] + [(f"n{k}", dt.datetime(2020, 6, 1 + k), float(k), "R1", 0.0) for k in range(6)] + [(f"p{k}", dt.datetime(2020, 4, 1 + k), float(k), "R1", 0.0) for k in range(6)]
    got = {n for (m, n) in pick(short) if m == "2020-05"}
    assert got == {"a", "n0", "n1", "n2", "n3", "p0", "p1", "p2"}  # topped up in turn: next month first


@settings(max_examples=25, deadline=None)
@given(st.lists(st.floats(-1e6, 1e6), min_size=2, max_size=30))
def test_minmax_stays_in_range(spark, values):
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    out = [r.v for r in stats.Scaler({"v": "minmax"}).fit_transform(df).collect()]
    assert all(-1e-9 <= x <= 1 + 1e-9 for x in out)


def test_a_block_costs_its_pixels_not_their_square(spark):
    side = 96
    df = spark.range(side * side).select((F.col("id") / side).cast("int").alias("y"), (F.col("id") % side).cast("int").alias("x"), (F.col("id") * 7 % 1000).cast("int").alias("v"))
    blocks = vector.to_blocks(df.where("(y + x) % 5 > 0"), [], "v")
    pixels = vector.from_blocks(blocks, [], "v")
    plan = pixels._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("AS data#") == 1 and "size(transform" not in plan  # data is made once for each block, not again in a filter
    began = time.monotonic()
    got = {(r.y, r.x): r.v for r in pixels.collect()}
    assert time.monotonic() - began < 30
    assert got == {(y, x): (y * side + x) * 7 % 1000 for y in range(side) for x in range(side) if (y + x) % 5}


def test_blocks_of_gaps_nulls_and_repeats(spark):
    rows = [("a", -3, -1, 1), ("a", 0, 2, 2), ("a", 1, 0, None), ("a", 2, 1, 3), ("b", 7, 7, 4), ("b", None, 1, 5), ("b", 1, None, 6)]
    df = spark.createDataFrame(rows, "k string, y int, x int, v int")
    blocks = {(r.k, r.by, r.bx): (r.y0, r.x0, r.h, r.w, r.data) for r in vector.to_blocks(df, ["k"], "v", 4).collect()}
    assert blocks == {("a", -1, -1): (-3, -1, 1, 1, [1.0]), ("a", 0, 0): (0, 0, 3, 3, [None, None, 2.0, None, None, None, None, 3.0, None]), ("b", 1, 1): (7, 7, 1, 1, [4.0])}
    assert {tuple(r) for r in vector.from_blocks(vector.to_blocks(df, ["k"], "v", 4), ["k"], "v").collect()} == {("a", -3, -1, 1.0), ("a", 0, 2, 2.0), ("a", 2, 1, 3.0), ("b", 7, 7, 4.0)}
    with pytest.raises(Exception, match="twice"):
        vector.to_blocks(df.unionAll(df.limit(1)), ["k"], "v", 4).collect()
