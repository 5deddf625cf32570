"""Which features of a training table are used: by group, constant ones out, then one of two analyses; with a report of what went at which level."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from landloom.ml import svm
from landloom.operators import stats

STRATEGIES = (None, "multicollinearity_analysis", "rfecv")


@dataclass
class Selection:
    used: list[str]
    constant: list[str] = field(default_factory=list)
    removed_by_group: list[str] = field(default_factory=list)
    removed_by_analysis: list[str] = field(default_factory=list)
    scores: dict[str, float] = field(default_factory=dict)

    def report(self, spark: SparkSession) -> DataFrame:
        """(feature, used, level, reason, score): level 1 is groups and constants, level 2 the analysis, null for features that stay."""
        why = {**{c: (1, "group") for c in self.removed_by_group}, **{c: (1, "constant") for c in self.constant}, **{c: (2, "analysis") for c in self.removed_by_analysis}}
        rows = [(c, c not in why, *why.get(c, (None, None)), self.scores.get(c)) for c in [*self.used, *why]]
        return spark.createDataFrame(rows, "feature string, used boolean, level int, reason string, score double")


def select(
    df: DataFrame, label: str, ids: Sequence[str], use_bands: bool = True, use_glcm: bool = True, use_other: bool = True, fixed: Sequence[str] = (), drop_constant: bool = True,
    strategy: str | None = None, threshold: float = 0.9, analyse_bands: bool = True,
) -> Selection:
    """Fixed features are used whatever their group and stay through the analysis, unless they are constant; one that the table lacks is an error. analyse_bands: whether the analysis may remove band features."""
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy}")
    if lacking := [c for c in fixed if c not in df.columns]:
        raise ValueError(f"fixed features that the table lacks: {lacking}")
    every = [c for c in df.columns if c not in ids]
    chosen = stats.select_features(df.columns, use_bands, use_glcm, use_other, fixed, ids)
    out = Selection([], removed_by_group=[c for c in every if c not in chosen])
    if drop_constant:
        out.constant = stats.constant_features(df, chosen)
    left = [c for c in chosen if c not in out.constant]
    open_ = [c for c in left if analyse_bands or not c.startswith("band")]
    if strategy == "multicollinearity_analysis" and open_:
        corr = stats.correlations(df, open_)
        metric = stats.combined_metric(stats.mean_correlation(corr), stats.mutual_information(df, open_, label)).collect()  # a row per feature
        out.scores = {r["feature"]: r["combined_metric"] for r in metric}
        out.removed_by_analysis = stats.multicollinear(open_, {(r["a"], r["b"]): r["corr"] for r in corr.collect()}, out.scores, threshold, fixed)
    elif strategy == "rfecv" and len(open_) > 1:
        from pyspark.sql import functions as F

        x, y = svm.bounded(df.withColumn("_features", F.array(*[F.col(f"`{c}`").cast("double") for c in open_])), "_features", label)
        kept = svm.rfecv(x, y, open_, spark=df.sparkSession)
        out.removed_by_analysis = [c for c in open_ if c not in kept and c not in fixed]
    out.used = [c for c in left if c not in out.removed_by_analysis]
    return out
