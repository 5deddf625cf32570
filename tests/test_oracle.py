"""Every query with SQL against DuckDB on the smallest tables; every other query against what its result must be like."""

import numpy as np
import pytest
from compare import DATA, differences
from pyspark.sql import functions as F

from landloom.plans import problems, registry

WITH_SQL = sorted({**registry.SQL, **problems.SQL})
WITHOUT = sorted({**registry.QUERIES, **problems.QUERIES}.keys() - set(WITH_SQL))


@pytest.mark.parametrize("name", WITH_SQL)
def test_matches_sql(spark, name):
    assert differences(spark, name, "sf0.001") == []


VECTORS, PIXELS = 500, 1000  # rows of embeddings and events on the smallest tables


def _probabilities(d):
    p = d[[c for c in d if c[0] == "p" and c[1:].isdigit()]].to_numpy()
    assert len(d) == VECTORS and d["pix"].is_unique and p.shape[1] == 10 and p.min() >= 0
    assert (p.sum(1) <= 255).all() and (p.sum(1) > 245).all()  # each is cut to a whole number
    assert set(d["label"]) <= {str(k) for k in range(10)}


def _values(rows, *columns, lo=-np.inf, hi=np.inf):
    def check(d):
        v = d[list(columns)].to_numpy(float)
        assert len(d) == rows and np.isfinite(v).all() and v.min() >= lo and v.max() <= hi and v.std() > 0

    return check


def _masks(rows, *columns):
    def check(d):
        assert len(d) == rows if rows else len(d) > 0
        assert all(d[c].notna().all() and set(d[c]) <= {True, False} for c in columns)

    return check


def _components(d):
    assert len(d) == VECTORS and np.allclose(d.drop(columns="pix").mean(), 0, atol=1e-6) and (np.diff(d.drop(columns="pix").var()) <= 1e-6).all()


def _variance(d):
    d = d.sort_values("component")
    assert np.isclose(d["ratio"].sum(), 1) and (np.diff(d["variance"]) <= 0).all() and np.allclose(d["cumulative"], d["ratio"].cumsum())


def _report(d):
    assert set(d["label"]) >= {"accuracy", "macro avg", "weighted avg"} and d.set_index("label").loc["accuracy", "f1"] > 0.15 and d.set_index("label").loc["accuracy", "support"] == VECTORS


def _search(d):
    assert d["id"].is_unique and d["error"].isna().all() and d[["mc_f1", "svms_f1"]].notna().all().all() and sorted(d["no"]) == sorted(set(d["no"]))


def _grid(d):
    assert sorted(d["label"]) == list(range(-1, 10)) and d["score"].between(0, 1).all()


def _restored(d):
    assert len(d) == 3 * PIXELS and d[["blue", "nir"]].to_numpy().min() >= 0 and d[["blue", "nir"]].to_numpy().max() <= 65535


def _selected(d):
    out = d.set_index("feature")
    assert not out.loc["band_1_month_2", "used"] or not out.loc["band_1_month_1", "used"]  # two that say the same
    assert out.loc["flat", "reason"] == "constant" and out["used"].sum() >= 8


def _blocks(d):
    assert set(d["band"]) == set(range(1, 12)) and all(len(x) == h * w for x, h, w in zip(d["data"], d["h"], d["w"])) and d[d["band"] == 1]["h"].mul(d["w"]).sum() == VECTORS


def _utm(d):
    ok = d["lon"].notna()
    assert ok.any() and (d.loc[ok, "error_m"] < 1e-3).all() and d.loc[ok, "lat"].between(-90, 90).all()


CHECKS = {
    "pca": _components, "pca_variance": _variance, "predict_report": _report, "svm_grid": _grid, "pipeline_search": _search, "cloud_restoration": _restored, "selection_multicollinearity": _selected, "map_production": _blocks, "reproject_utm": _utm,
    "mutual_information": lambda d: _values(12, "importance", lo=0)(d), "multicollinearity": lambda d: (_values(12, "score")(d), _masks(12, "dropped")(d)), "rfecv": lambda d: (_masks(12, "kept")(d), d["kept"].any() or pytest.fail("nothing kept")),
    "glcm_upsampled": lambda d: d.drop(columns=["y", "x"]).notna().all().all() or pytest.fail("nulls"), "texture_stack": _values(PIXELS, "contrast", "dissimilarity", "homogeneity", "asm", "energy", "correlation"),
    "shadow_adjust": _values(PIXELS, "adjusted", lo=0, hi=65535), "masks_refinement": _masks(None, "cloud_refined", "shadow_refined"),
    **{f"predict_{m}": _probabilities for m in ("binary", "binary_softmax", "multiclass", "multiclass_calibrated")},
}


@pytest.mark.parametrize("name", WITHOUT)
def test_without_sql(spark, name):
    df = {**registry.QUERIES, **problems.QUERIES}[name](spark, str(DATA / "sf0.001"))
    assert len(set(df.columns)) == len(df.columns)
    d = df.toPandas()
    assert len(d) > 0
    if name in CHECKS:
        CHECKS[name](d)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_search_goes_on_where_it_was(spark, tmp_path):
    from landloom.ml import search
    from landloom.operators import stats

    rng = np.random.default_rng(0)
    rows = [(int(i), str(int(i % 2)), ("train", "train", "calibration", "test")[i // 2 % 4], float(rng.normal(3 * (i % 2))), float(rng.normal()), 1.0) for i in rng.permutation(160)]
    df = spark.createDataFrame(rows, "pix int, cls string, split string, band_1_month_1 double, slope double, flat double")
    grid = stats.parameter_grid(spark, {"features_selection_strategy": [None], "use_band_features": [True, False], "use_other_features": [False], "apply_pca": [False]})
    log = str(tmp_path / "log")
    args = (spark, df, "cls", "split", ["pix", "cls", "split"], grid, log, (1.0,), (0.5,))
    assert search.search(*args, most=1).count() == 1
    done = {r["no"]: r for r in search.search(*args).collect()}
    assert done[0]["error"] is None and done[0]["mc_f1"] > 0.8 and done[0]["features"] == '["band_1_month_1"]'
    assert "no feature" in done[1]["error"]  # a combination without features is logged and stops nothing
    assert search.remaining(grid, search.read_log(spark, log)).count() == 0 and search.search(*args).count() == 2


def test_selection_of_unknown_or_absent(spark):
    from landloom.ml import selection

    df = spark.createDataFrame([(1.0, 2.0, "a"), (2.0, 2.0, "b")], "band_1 double, other double, y string")
    assert selection.select(df, "y", ["y"], fixed=["other"]).constant == ["other"]
    for wrong in ({"strategy": "guess"}, {"fixed": ["nowhere"]}):
        with pytest.raises(ValueError):
            selection.select(df, "y", ["y"], **wrong)


def test_map_ends_in_a_file(spark, tmp_path):
    from landloom.plans import models
    from landloom.sources import geotiff

    blocks = models.map_production(spark, str(DATA / "sf0.001"))
    to = str(tmp_path / "map.tif")
    geotiff.create_empty(to, 11, VECTORS // 25, 25, "uint8", nodata=255)
    geotiff.write_windows(blocks, to, nodata=255.0)
    out = np.zeros((11, VECTORS // 25, 25))
    for band, y0, x0, block, _ in geotiff.read_blocks((tmp_path / "map.tif").read_bytes()):
        out[band - 1, y0 : y0 + block.shape[0], x0 : x0 + block.shape[1]] = block
    void = (np.arange(VECTORS) % 7 == 0).reshape(-1, 25)
    assert (out[0][void] == 255).all() and set(np.unique(out[0][~void])) <= set(range(10)) and (out[1:, void] == 0).all()


def test_pairs_of_images_and_masks(spark):
    from landloom.operators import pipelines

    a, b = spark.createDataFrame([("s", 1)], "scene string, v int"), spark.createDataFrame([("s", 1), ("t", 2)], "scene string, m int")
    assert pipelines.paired(a, b.where("scene = 's'")).count() == 1
    for wrong in (b, b.where("scene = 't'"), b.where("scene = 's'").unionAll(b)):
        with pytest.raises(ValueError):
            pipelines.paired(a, wrong)
    assert a.agg(F.count("*")).first()[0] == 1
