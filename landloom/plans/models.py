"""Catalogue: models. Fits are deterministic; there is no SQL twin but for parts checked elsewhere, so tests hold them against definitions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from landloom.ml import pca as pc
from landloom.ml import svm
from landloom.operators import stats
from landloom.plans import base

QUERIES: dict = {}
SQL: dict = {}
COLS = [f"b{i}" for i in range(1, 13)]


def query(f):
    QUERIES[f.__name__] = f
    return f


def with_sql(text: str):
    def add(f):
        SQL[f.__name__] = text
        return query(f)

    return add


def _scaled(spark, d):
    b = base.bands12(spark, d)
    return stats.Scaler({c: "standard" for c in COLS}).fit_transform(b)


def _parts(spark, d):
    """Half for training, half for calibration, by row parity within a class; features as an array."""
    b = _scaled(spark, d).withColumn("features", F.array(*COLS))
    x, y = svm.bounded(b, "features", "cls")
    half = svm.folds(y, 2) == 0
    return b, x, y, half


@query
def pca(spark, d):
    b = base.bands12(spark, d)
    p = pc.fit(b, COLS)
    return p.transform(b, pc.choose(p, "average", 0.95), ["pix"])


@query
def pca_variance(spark, d):
    p = pc.fit(base.bands12(spark, d), COLS)
    total = np.cumsum(p.ratio)
    return spark.createDataFrame([(i + 1, float(p.variance[i]), float(p.ratio[i]), float(total[i])) for i in range(len(COLS))], "component int, variance double, ratio double, cumulative double")


@query
def mutual_information(spark, d):
    return stats.mutual_information(base.bands12(spark, d), COLS, "cls")


@query
def multicollinearity(spark, d):
    b = base.bands12(spark, d)
    corr = stats.correlations(b, COLS)
    m = stats.combined_metric(stats.mean_correlation(corr), stats.mutual_information(b, COLS, "cls"))
    score = {r["feature"]: r["combined_metric"] for r in m.collect()}
    dropped = stats.multicollinear(COLS, {(r["a"], r["b"]): r["corr"] for r in corr.collect()}, score, 0.3)
    return spark.createDataFrame([(c, float(score[c]), c in dropped) for c in COLS], "feature string, score double, dropped boolean")


@query
def rfecv(spark, d):
    b, x, y, _ = _parts(spark, d)
    kept = svm.rfecv(x, y, COLS, spark=spark)
    return spark.createDataFrame([(c, c in kept) for c in COLS], "feature string, kept boolean")


@query
def svm_grid(spark, d):
    _, x, y, half = _parts(spark, d)
    best = svm.grid_search(spark, x[half], y[half], (1.0, 100.0), (0.02, 0.1), (False, True))
    return spark.createDataFrame([(int(r.label), float(r.c), float(r.gamma), bool(r.balanced), float(r.score)) for r in best.itertuples()], "label int, c double, gamma double, balanced boolean, score double")


def _ensemble(spark, d):
    b, x, y, half = _parts(spark, d)
    return b, svm.fit_ensemble(x[half], y[half], x[~half], y[~half], 10.0, 0.1, spark=spark)


def _mode(mode: str):
    def f(spark, d):
        b, e = _ensemble(spark, d)
        return svm.predict(b, e, "features", ["pix"], mode)

    f.__name__ = f"predict_{mode}"
    return query(f)


for _m in svm.MODES:
    _mode(_m)


@query
def predict_report(spark, d):
    """Class report of the calibrated one-vs-rest mode on all rows."""
    b, e = _ensemble(spark, d)
    p = svm.predict(b, e, "features", ["pix", "cls"], "binary")
    return stats.class_report(stats.confusion(p.withColumn("truth", F.col("cls").cast("string")), "truth", "label"))


def _training(spark, d):
    """Embeddings as a training table: eight band columns, two textures, one other, one constant; a split by row number."""
    e = base.bands12(spark, d)
    names = [*[f"band_{i}_month_1" for i in range(1, 9)], "GLCMcontrast", "GLCMASM", "slope"]
    kept = e.select("pix", F.col("cls").cast("string").alias("ground_truth_label"), F.when(F.col("pix") % 4 < 2, "train").when(F.col("pix") % 4 == 2, "calibration").otherwise("test").alias("split"), *[F.col(f"b{i + 1}").alias(n) for i, n in enumerate(names)], F.lit(3.0).alias("flat"))
    return kept, ["pix", "ground_truth_label", "split"]


@with_sql("SELECT * FROM (VALUES " + ", ".join([*[f"('band_{i}_month_1', true, NULL, NULL)" for i in range(1, 9)], "('slope', true, NULL, NULL)", "('GLCMASM', true, NULL, NULL)", "('GLCMcontrast', false, 1, 'group')", "('flat', false, 1, 'constant')"]) + ") AS t(feature, used, level, reason)")
def selection_groups(spark, d):
    """Selection by groups with a fixed feature of a group that is off, and a constant feature."""
    from landloom.ml import selection

    df, ids = _training(spark, d)
    return selection.select(df, "ground_truth_label", ids, use_glcm=False, fixed=["GLCMASM"]).report(spark).drop("score")


@query
def selection_multicollinearity(spark, d):
    from landloom.ml import selection

    df, ids = _training(spark, d)
    twin = df.withColumn("band_1_month_2", F.col("band_1_month_1") * 2 + 1)
    return selection.select(twin, "ground_truth_label", ids, strategy="multicollinearity_analysis").report(spark)


_GRID = {"dataset_path": ["dataset.csv"], "features_selection_strategy": [None], "fss_use_bands": [True], "use_band_features": [True], "use_glcm_features": [True, False], "use_other_features": [False], "apply_pca": [True, False], "pca_use_bands": [True], "pca_components_selection_strategy": ["cev"]}


@with_sql("SELECT lower(concat_ws('_', 'dataset.csv', 'none', 'true', 'true', g, 'false', a, 'true', 'cev')) AS id FROM (VALUES ('true'), ('false')) AS x(g), (VALUES ('true'), ('false')) AS y(a) WHERE NOT (g = 'true' AND a = 'false')")
def search_remaining(spark, d):
    """Combinations of a small grid that a log with one of them doesn't hold."""
    from landloom.ml import search

    grid = stats.prune_grid(stats.parameter_grid(spark, _GRID))
    done = search.identified(grid).where("use_glcm_features and not apply_pca").select("id")
    return search.remaining(grid, done).select("id")


@query
def pipeline_search(spark, d):
    """The whole search over a small grid, broken off after the first combination and taken up again."""
    import uuid

    from landloom.ml import search
    from landloom.session import checkpoint_dir

    df, ids = _training(spark, d)
    grid = stats.prune_grid(stats.parameter_grid(spark, _GRID))
    log = f"{checkpoint_dir(spark).rstrip('/')}/search-{uuid.uuid4().hex}"
    search.search(spark, df, "ground_truth_label", "split", ids, grid, log, (10.0,), (0.1,), most=1)
    return search.search(spark, df, "ground_truth_label", "split", ids, grid, log, (10.0,), (0.1,))


def _map(spark, d, chunks=None):
    from landloom.ml import mapping, search

    df, ids = _training(spark, d)
    prepared = search.prepare(df, "ground_truth_label", "split", ids, {"apply_pca": True, "pca_components_selection_strategy": "cev"})
    ensemble, _, _ = search.score(prepared, 10.0, 0.1)
    pixels = df.drop("ground_truth_label", "split").withColumns({"y": F.floor(F.col("pix") / 25).cast("int"), "x": (F.col("pix") % 25).cast("int")})
    void = F.col("pix") % 7 == 0
    pixels = pixels.withColumns({c: F.when(~void, F.col(c)) for c in df.columns if c not in ids})
    return mapping.classify(pixels, prepared, ensemble, size=10, width=25, chunks=chunks)


@with_sql("SELECT CAST(y AS INT) AS y, CAST(x AS INT) AS x, CAST(c AS INT) AS chunk, pix % 7 <> 0 AS valid FROM (SELECT vec_id AS pix, vec_id // 25 AS y, vec_id % 25 AS x, (vec_id // 250) * 3 + (vec_id % 25) // 10 AS c FROM embeddings) WHERE c < 4")
def map_chunks(spark, d):
    """Which pixels the first four squares of a map hold, and which of them have data."""
    return _map(spark, d, 4).select("y", "x", "chunk", "valid")


@query
def map_production(spark, d):
    """Scaling, components, classification and blocks of class codes and probabilities."""
    from landloom.ml import mapping

    return mapping.map_blocks(_map(spark, d), {str(k): k for k in range(10)}, 10)
