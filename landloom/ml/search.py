"""Search over whole pipelines: every valid combination of the grid is prepared, fitted and scored; finished ones are in a log, so a search that was broken off goes on where it was."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from landloom.ml import pca as pc
from landloom.ml import selection, svm
from landloom.operators import stats

LOG = "id string, no bigint, mc_f1 double, svms_f1 double, features string, components int, error string"


def identified(grid: DataFrame, ordinal: str = "ordinal") -> DataFrame:
    """The grid with `id`: its values in column order, in lower case, joined by '_'; nulls read 'none'."""
    names = [c for c in grid.columns if c != ordinal]
    return grid.withColumn("id", F.lower(F.concat_ws("_", *[F.coalesce(F.col(c).cast("string"), F.lit("none")) for c in names])))


def remaining(grid: DataFrame, log: DataFrame) -> DataFrame:
    """Combinations that the log doesn't hold."""
    return identified(grid).join(log.select("id").distinct(), "id", "left_anti")


@dataclass
class Prepared:
    """Training, calibration and test parts of one combination, with all that a map needs to be made the same way."""

    parts: dict[str, tuple[np.ndarray, np.ndarray]]
    scaler: stats.Scaler
    used: list[str]
    pca: pc.Pca | None
    components: int

    def features(self, df: DataFrame, keep: Sequence[str]) -> DataFrame:
        """(keep, features): any table with the raw columns, scaled and projected like the training part."""
        return _features(self.scaler.transform(df), self.used, self.pca, self.components, keep)


def _features(scaled: DataFrame, used: Sequence[str], p: pc.Pca | None, n: int, keep: Sequence[str]) -> DataFrame:
    if p is None:
        return scaled.select(*keep, F.array(*[F.col(f"`{c}`").cast("double") for c in used]).alias("features"))
    rest = [c for c in used if c not in p.columns]
    named = scaled.select(*keep, *used)
    out = p.transform(named, n, [*keep, *rest])
    return out.select(*keep, F.array(*[F.col(f"`{c}`").cast("double") for c in rest], *[F.col(f"PC{k + 1}") for k in range(n)]).alias("features"))


def prepare(df: DataFrame, label: str, split: str, ids: Sequence[str], config: Mapping) -> Prepared:
    """df: features, label, and split with train, calibration and test. Scaling, selection and components are fitted on the training part only."""
    columns = [c for c in df.columns if c not in ids]
    train = df.where(F.col(split) == "train")
    scaled, scaler = stats.preprocess(train, [("band", config.get("bands_scaling") or "standard"), ("GLCM", config.get("glcm_scaling") or "minmax")], config.get("other_scaling") or "standard", columns)
    chosen = selection.select(
        scaled, label, ids, config.get("use_band_features", True), config.get("use_glcm_features", True), config.get("use_other_features", True), config.get("fixed_features", ()),
        True, config.get("features_selection_strategy"), config.get("correlation_threshold", 0.9), config.get("fss_use_bands", True),
    )
    if not chosen.used:
        raise ValueError("no feature is left")
    p, n = None, 0
    if config.get("apply_pca"):
        cols = [c for c in chosen.used if config.get("pca_use_bands", True) or not c.startswith("band")]
        if cols:
            p = pc.fit(scaled, cols)
            n = pc.choose(p, config.get("pca_components_selection_strategy") or "average")
    parts = {}
    for name in ("train", "calibration", "test"):
        rows = _features(scaler.transform(df.where(F.col(split) == name)), chosen.used, p, n, [label])
        parts[name] = svm.bounded(rows.where(F.col("features").isNotNull()), "features", label)
    return Prepared(parts, scaler, chosen.used, p, n)


def score(prepared: Prepared, c: float, gamma: float) -> tuple[svm.Ensemble, float, float]:
    """The ensemble, the mean macro F1 of the multiclass machine and its calibrated twin, and that of the one-vs-rest machines, on the test part."""
    (x, y), (xc, yc), (xt, yt) = (prepared.parts[k] for k in ("train", "calibration", "test"))
    e = svm.fit_ensemble(x, y, xc, yc, c, gamma)
    multi = np.mean([svm.f1_macro(yt, e.predict(xt, m).astype(yt.dtype)) for m in ("multiclass", "multiclass_calibrated")])
    binary = np.mean([svm.f1_macro(yt == k, m.model.decide(xt) > 0) for k, m in e.binary.items()])
    return e, float(multi), float(binary)


def search(spark: SparkSession, df: DataFrame, label: str, split: str, ids: Sequence[str], grid: DataFrame, log_path: str, cs: Sequence[float], gammas: Sequence[float], most: int | None = None) -> DataFrame:
    """Runs what the log at log_path lacks, in the grid's order (at most `most` combinations in this call), and gives the log. A combination that fails is logged with its error and doesn't stop the search.

    Each result is appended as soon as it is there. The inner search over c and gamma runs in tasks of its own (`svm.grid_search`).
    """
    log = read_log(spark, log_path)
    todo = remaining(grid, log).orderBy("ordinal").collect()  # a row per combination
    for r in todo[:most]:
        config = {k: v for k, v in r.asDict().items() if k not in ("ordinal", "id")}
        no = r["ordinal"]
        try:
            prepared = prepare(df, label, split, ids, config)
            x, y = prepared.parts["train"]
            best = svm.grid_search(spark, x, y, cs, gammas, classes=[])
            top = best.iloc[0]
            _, multi, binary = score(prepared, float(top["c"]), float(top["gamma"]))
            row = (r["id"], no, multi, binary, json.dumps(prepared.used), prepared.components, None)
        except (ValueError, ZeroDivisionError, np.linalg.LinAlgError) as err:
            row = (r["id"], no, None, None, None, None, str(err)[:500])
        spark.createDataFrame([row], LOG).coalesce(1).write.mode("append").json(log_path)
    return read_log(spark, log_path)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """The log, the last entry of each combination; empty where there is none yet."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], LOG)
    return spark.read.schema(LOG).json(path).dropDuplicates(["id"])
