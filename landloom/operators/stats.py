"""Scaling, correlation, selection, reports, calibration curves, experiment logs and parameter grids.

Everything but mutual information is one or two aggregates; what reaches the driver is a table of features or classes.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def clean(c: str) -> Column:
    """NaN is missing."""
    v = F.col(c).cast("double")
    return F.when(~F.isnan(v), v)


def quantiles(v: Column, q: Sequence[float], accuracy: int | None = None) -> Column:
    """Exact, interpolated quantiles: the aggregate keeps one count per different value, which 16-bit numbers bound. Columns of continuous values beyond a task's memory need
    `accuracy`: then the sketch of percentile_approx, whose error is 1 / accuracy of the rows."""
    qs = F.array(*[F.lit(float(x)) for x in q])
    return F.percentile(v, qs) if accuracy is None else F.percentile_approx(v, qs, accuracy)


def scaler_stats(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = (), q: tuple[float, float] = (0.001, 0.999), accuracy: int | None = None) -> DataFrame:
    """(keys, feature, mean, std, min, max, q_min, q_max) of all columns in one pass; std is the population's."""
    aggs = []
    for i, c in enumerate(columns):
        v = clean(c)
        aggs += [F.avg(v).alias(f"mean{i}"), F.stddev_pop(v).alias(f"std{i}"), F.min(v).alias(f"min{i}"), F.max(v).alias(f"max{i}"), quantiles(v, q, accuracy).alias(f"q{i}")]
    wide = df.groupBy(*keys).agg(*aggs)
    rows = [F.struct(F.lit(c).alias("feature"), *[F.col(f"{s}{i}").alias(s) for s in ("mean", "std", "min", "max")], F.col(f"q{i}")[0].alias("q_min"), F.col(f"q{i}")[1].alias("q_max")) for i, c in enumerate(columns)]
    return wide.select(*keys, F.explode(F.array(*rows)).alias("r")).select(*keys, "r.*")


def scale(v: Column, method: str, s: Mapping[str, Column | float]) -> Column:
    """standard, minmax or minmax_q by the numbers of a stats row; a constant feature has range or spread 1."""
    lit = {k: x if isinstance(x, Column) else F.lit(x) for k, x in s.items()}
    if method == "standard":
        return (v - lit["mean"]) / F.when(lit["std"] == 0, 1.0).otherwise(lit["std"])
    lo, hi = (lit["min"], lit["max"]) if method == "minmax" else (lit["q_min"], lit["q_max"])
    out = (v - lo) / F.when(hi == lo, 1.0).otherwise(hi - lo)
    if method == "minmax":
        return out
    if method == "minmax_q":
        return F.least(F.lit(1.0), F.greatest(F.lit(0.0), out))
    raise ValueError(method)


class Scaler:
    """fit_transform / transform with serialisable metadata (feature, method, params)."""

    def __init__(self, methods: Mapping[str, str]):
        self.methods = dict(methods)
        self.params: dict[str, dict[str, float]] = {}

    def fit(self, df: DataFrame) -> Scaler:
        for r in scaler_stats(df, list(self.methods)).collect():
            self.params[r["feature"]] = {k: r[k] for k in ("mean", "std", "min", "max", "q_min", "q_max")}
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: scale(clean(c), m, self.params[c]) for c, m in self.methods.items()})

    def fit_transform(self, df: DataFrame) -> DataFrame:
        return self.fit(df).transform(df)

    def metadata(self) -> list[dict]:
        return [{"feature": c, "method": m, "params": self.params[c]} for c, m in self.methods.items()]

    @classmethod
    def from_metadata(cls, rows: Sequence[Mapping]) -> Scaler:
        s = cls({r["feature"]: r["method"] for r in rows})
        s.params = {r["feature"]: dict(r["params"]) for r in rows}
        return s


def preprocess(df: DataFrame, by_prefix: Sequence[tuple[str, str]], default: str | None, columns: Sequence[str]) -> tuple[DataFrame, Scaler]:
    """One aggregate pass and one projection: each column takes the method of the first prefix it begins with."""
    methods = {}
    for c in columns:
        m = next((m for p, m in by_prefix if c.startswith(p)), default)
        if m:
            methods[c] = m
    s = Scaler(methods)
    return s.fit_transform(df), s


def clip_quantiles(df: DataFrame, keys: Sequence[str], value: str, lo: float = 0.001, hi: float = 0.999, accuracy: int | None = None) -> DataFrame:
    """Values outside a group's quantiles are moved onto them."""
    q = df.groupBy(*keys).agg(quantiles(F.col(value).cast("double"), (lo, hi), accuracy).alias("_q"))
    d = df.join(q, list(keys)) if keys else df.withColumn("_k", F.lit(0)).join(q.withColumn("_k", F.lit(0)), "_k").drop("_k")
    v = F.col(value).cast("double")  # null stays null: least and greatest would skip it
    return d.withColumn(value, F.when(v.isNotNull(), F.least(F.greatest(v, F.col("_q")[0]), F.col("_q")[1]))).drop("_q")


def select_features(columns: Sequence[str], use_bands: bool = True, use_glcm: bool = True, use_other: bool = True, fixed: Sequence[str] = (), ids: Sequence[str] = ("x", "y", "ground_truth_index", "ground_truth_label", "split")) -> list[str]:
    """Feature columns by group of their prefix (band, GLCM, other); fixed ones always; order as in the table."""
    group = lambda c: use_bands if c.startswith("band") else use_glcm if c.startswith("GLCM") else use_other
    return [c for c in columns if c not in ids and (c in fixed or group(c))]


def distance_histogram(df: DataFrame, dx: Column, dy: Column, bins: int = 100) -> DataFrame:
    """(bin, n) of Euclidean distances over equal bins from the least to the greatest."""
    d = df.select(F.sqrt(dx * dx + dy * dy).alias("d"))
    b = d.agg(F.min("d").alias("lo"), F.max("d").alias("hi")).withColumn("_k", F.lit(0))
    j = d.withColumn("_k", F.lit(0)).join(b, "_k")
    at = F.coalesce(F.floor(F.try_divide(F.col("d") - F.col("lo"), F.col("hi") - F.col("lo")) * bins), F.lit(0))
    return j.select(F.least(F.lit(bins - 1), at).cast("int").alias("bin")).groupBy("bin").agg(F.count("*").alias("n"))


def metric_table(df: DataFrame, columns: Sequence[str], pattern: str = r"^(.*)_([^_]+)_(precision|recall|f1-score|support)$") -> DataFrame:
    """(prefix, class, precision, recall, f1-score, support) from columns named PREFIX_class_metric; only classes with all four."""
    named = [F.struct(F.lit(c).alias("name"), F.col(f"`{c}`").cast("double").alias("v")) for c in columns]
    long = df.select(F.explode(F.array(*named)).alias("r")).select("r.*").withColumns({"prefix": F.regexp_extract("name", pattern, 1), "class": F.regexp_extract("name", pattern, 2), "metric": F.regexp_extract("name", pattern, 3)})
    wide = long.where("metric <> ''").groupBy("prefix", "class").pivot("metric", ["precision", "recall", "f1-score", "support"]).agg(F.max("v"))
    return wide.where("precision is not null and recall is not null and `f1-score` is not null and support is not null")


def constant_features(df: DataFrame, columns: Sequence[str]) -> list[str]:
    if not columns:
        return []
    row = df.agg(*[(F.min(c) == F.max(c)).alias(c) for c in columns]).first()
    return [c for c in columns if row[c]]


def profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(feature, min, max, mean, std, var), rounded to three places; std and var of the sample."""
    rows = []
    for c in columns:
        v = clean(c)
        rows += [F.min(v).alias(f"{c}|min"), F.max(v).alias(f"{c}|max"), F.avg(v).alias(f"{c}|mean"), F.stddev_samp(v).alias(f"{c}|std"), F.var_samp(v).alias(f"{c}|var")]
    wide = df.agg(*rows)
    out = F.array(*[F.struct(F.lit(c).alias("feature"), *[F.round(F.col(f"`{c}|{s}`"), 3).alias(s) for s in ("min", "max", "mean", "std", "var")]) for c in columns])
    return wide.select(F.explode(out).alias("r")).select("r.*")


PAIR_SUMS = "i int, j int, n bigint, sx double, sy double, sxx double, syy double, sxy double"


def pair_sums(df: DataFrame, columns: Sequence[str], centre: Sequence[float]) -> DataFrame:
    """For every two columns i <= j, over the rows that have both: their number, sums, and sums of squares and products, of the values less `centre`.

    One pass: each task adds up matrix products of its Arrow batches, and one row per pair leaves it, so many columns cost neither a wide plan nor a wide shuffle.
    """
    shift = np.array(centre, float)
    d = len(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((6, d, d))
        for b in batches:
            if b.num_rows:
                x = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in b.columns]) - shift
                there = (~np.isnan(x)).astype(float)
                x = np.nan_to_num(x)
                sx, sxx = x.T @ there, (x * x).T @ there
                total += np.stack([there.T @ there, sx, sx.T, sxx, sxx.T, x.T @ x])
        i, j = np.triu_indices(d)
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total[0][i, j].astype(np.int64)), *[pa.array(t[i, j]) for t in total[1:]]], ["i", "j", "n", "sx", "sy", "sxx", "syy", "sxy"])

    parts = df.select(*[clean(c).alias(f"c{k}") for k, c in enumerate(columns)]).mapInArrow(run, PAIR_SUMS)
    return parts.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "sx", "sy", "sxx", "syy", "sxy")])


def column_means(df: DataFrame, columns: Sequence[str]) -> list[float]:
    row = df.agg(*[F.avg(clean(c)).alias(f"m{k}") for k, c in enumerate(columns)]).first()
    return [0.0 if m is None else float(m) for m in row]


def correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(a, b, corr) for all pairs, each over the rows that have both values; null where fewer than two rows do or a column is constant over them. Values are centred first, so large offsets do no harm."""
    means = column_means(df, columns)
    n = F.col("n").cast("double")
    spread = lambda s, ss: F.col(ss) - F.col(s) * F.try_divide(F.col(s), n)
    names = F.array(*[F.lit(c) for c in columns])
    shift = F.array(*[F.lit(m) for m in means])
    # Rounding leaves a constant column a spread of some units in the last place of its squares.
    least = lambda s, ss, at: (F.col(ss) + n * F.element_at(shift, F.col(at) + 1) * F.element_at(shift, F.col(at) + 1)) * F.lit(1e-14)
    vx, vy = spread("sx", "sxx"), spread("sy", "syy")
    both = (F.col("n") >= 2) & (vx > least("sx", "sxx", "i")) & (vy > least("sy", "syy", "j"))
    ratio = (F.col("sxy") - F.col("sx") * F.try_divide(F.col("sy"), n)) / (F.sqrt(vx) * F.sqrt(vy))
    corr = F.when(both, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), ratio)))
    half = pair_sums(df, columns, means).select(F.element_at(names, F.col("i") + 1).alias("a"), F.element_at(names, F.col("j") + 1).alias("b"), corr.alias("corr"))
    half = half.withColumn("_way", F.explode(F.when(F.col("a") == F.col("b"), F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1)))))
    return half.select(F.when(F.col("_way") == 0, F.col("a")).otherwise(F.col("b")).alias("a"), F.when(F.col("_way") == 0, F.col("b")).otherwise(F.col("a")).alias("b"), "corr")


def mean_correlation(corr: DataFrame) -> DataFrame:
    """Signed mean per feature, diagonal included."""
    return corr.groupBy(F.col("a").alias("feature")).agg(F.avg("corr").alias("mean_correlation"))


def combined_metric(mean_corr: DataFrame, importance: DataFrame) -> DataFrame:
    return mean_corr.join(importance, "feature").withColumn("combined_metric", F.col("importance") / (1 + F.abs("mean_correlation"))).orderBy(F.desc("combined_metric"), "feature")


def multicollinear(columns: Sequence[str], corr: Mapping[tuple[str, str], float], score: Mapping[str, float], threshold: float, keep: Sequence[str] = ()) -> list[str]:
    """Features to drop: columns in order, each against the earlier ones it correlates with beyond the threshold; the lower score goes (the later one on a tie, which ends its row). Features in `keep` stay."""
    drop: list[str] = []
    for k, a in enumerate(columns):
        for b in columns[:k]:
            c = corr.get((b, a))
            if c is None or not abs(c) > threshold:
                continue
            if score[a] > score[b]:
                if b not in drop and b not in keep:
                    drop.append(b)
            else:
                if a not in drop and a not in keep:
                    drop.append(a)
                break
    return drop


def mutual_information(df: DataFrame, columns: Sequence[str], label: str, k: int = 3) -> DataFrame:
    """(feature, importance): nearest-neighbour estimate of Ross (2014) between each column and a label, over all rows; one task holds a column."""
    base = df.select(*[clean(c).alias(c) for c in columns], F.col(label).alias("_y")).where(F.col("_y").isNotNull())
    long = base.select("_y", F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("v")) for c in columns])).alias("r")).select("_y", "r.*").where("v is not null")

    def digamma(n: np.ndarray) -> np.ndarray:
        n = n.astype(float)
        out = np.zeros_like(n)
        small = n < 6
        while small.any():
            out = np.where(small, out - 1 / n, out)
            n = np.where(small, n + 1, n)
            small = n < 6
        return out + np.log(n) - 1 / (2 * n) - 1 / (12 * n**2) + 1 / (120 * n**4) - 1 / (252 * n**6)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["v", "_y"])  # the same noise for the same rows, however they come
        v = pdf["v"].to_numpy(float)
        y = pd.factorize(pdf["_y"])[0]
        v = v / (v.std() or 1.0) + np.random.default_rng(42).normal(size=len(v)) * 1e-10
        counts = np.bincount(y)
        ok = counts[y] > 1
        v, y = v[ok], y[ok]
        s = np.sort(v)
        near, within, per = np.zeros(len(v)), np.zeros(len(v)), np.zeros(len(v))
        for c in np.unique(y):
            at = np.flatnonzero(y == c)
            kk = min(k, len(at) - 1)
            own = np.sort(v[at])
            pos = np.searchsorted(own, v[at])
            lo = np.maximum(pos - kk, 0)
            span = np.stack([np.abs(own[np.minimum(lo + j, len(own) - 1)] - v[at]) for j in range(2 * kk + 1)], 1)
            real = np.stack([lo + j < len(own) for j in range(2 * kk + 1)], 1)
            radius = np.sort(np.where(real, span, np.inf), 1)[:, kk]
            radius = np.maximum(radius - 4 * np.spacing(np.abs(v[at]) + radius), 0)  # the k-th neighbour itself stays out, whatever the sums round to
            within[at] = np.searchsorted(s, v[at] + radius, side="right") - np.searchsorted(s, v[at] - radius, side="left")
            near[at], per[at] = kk, len(at)
        n = len(v)
        mi = digamma(np.array([n]))[0] + digamma(near).mean() - digamma(per).mean() - digamma(np.maximum(within, 1)).mean() if n else 0.0
        return pd.DataFrame({"feature": [pdf["feature"].iloc[0]], "importance": [max(0.0, float(mi))]})

    return long.groupBy("feature").applyInPandas(run, "feature string, importance double")


def confusion(df: DataFrame, truth: str, pred: str, keys: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*keys, F.col(truth).alias("truth"), F.col(pred).alias("pred")).agg(F.count("*").alias("n"))


def class_report(conf: DataFrame) -> DataFrame:
    """(label, precision, recall, f1, support) per class, and the rows accuracy, macro avg and weighted avg; a zero denominator gives 0. conf: (truth, pred, n)."""
    zero = F.lit(0.0)
    t = conf.groupBy(F.col("truth").alias("k")).agg(F.sum("n").alias("support"))
    p = conf.groupBy(F.col("pred").alias("k")).agg(F.sum("n").alias("predicted"))
    h = conf.where(F.col("truth") == F.col("pred")).groupBy(F.col("truth").alias("k")).agg(F.sum("n").alias("hits"))
    j = t.join(p, "k", "full").join(h, "k", "left").na.fill(0, ["support", "predicted", "hits"])
    pr, rc = F.coalesce(F.try_divide("hits", "predicted"), zero), F.coalesce(F.try_divide("hits", "support"), zero)
    per = j.select("k", "support", "hits", pr.alias("precision"), rc.alias("recall"))
    per = per.withColumn("f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), zero))
    a = per.agg(F.sum("support").alias("support"), F.sum("hits").alias("hits"), *[F.avg(c).alias(f"m_{c}") for c in ("precision", "recall", "f1")], *[(F.sum(F.col(c) * F.col("support")) / F.sum("support")).alias(f"w_{c}") for c in ("precision", "recall", "f1")])
    acc = F.try_divide("hits", "support")
    extra = F.array(
        F.struct(F.lit("accuracy").alias("label"), acc.alias("precision"), acc.alias("recall"), acc.alias("f1"), F.col("support").alias("support")),
        *[F.struct(F.lit(n).alias("label"), *[F.col(f"{c}_{x}").alias(x) for x in ("precision", "recall", "f1")], F.col("support").alias("support")) for n, c in (("macro avg", "m"), ("weighted avg", "w"))],
    )
    return per.select(F.col("k").cast("string").alias("label"), "precision", "recall", "f1", "support").unionByName(a.select(F.explode(extra).alias("r")).select("r.*"))


def calibration_curve(df: DataFrame, truth: Column, proba: str, bins: int = 10, accuracy: int | None = None) -> DataFrame:
    """(bin, mean_predicted, fraction_positive, n) over quantile bins; empty bins don't come out."""
    edges = df.agg(quantiles(F.col(proba), [i / bins for i in range(bins + 1)], accuracy).alias("_e"))
    d = df.withColumn("_k", F.lit(0)).join(edges.withColumn("_k", F.lit(0)), "_k")
    inner = F.slice(F.col("_e"), 2, bins - 1)
    number = F.size(F.filter(inner, lambda e: e < F.col(proba)))
    return d.withColumn("bin", number).groupBy("bin").agg(F.avg(proba).alias("mean_predicted"), F.avg(truth.cast("double")).alias("fraction_positive"), F.count("*").alias("n"))


def histogram(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"))


def having_size(df: DataFrame, keys: Sequence[str], least: int) -> DataFrame:
    """Rows of groups with at least so many members: a semi-join with the counted groups, so no group is gathered in a task."""
    big = df.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") >= least)
    return df.join(big, list(keys), "left_semi")


def top_k_mean(df: DataFrame, param: str, metric: str, k: int) -> DataFrame:
    """Mean of the k best rows of each parameter value; null is a value."""
    w = Window.partitionBy(param).orderBy(F.desc(metric))
    return df.where(F.col(metric).isNotNull()).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).groupBy(param).agg(F.avg(metric).alias("top_mean"), F.count("*").alias("n"))


def cumulative_variance(df: DataFrame, order: str, ratio: str) -> DataFrame:
    """Running sum over components (some hundred rows)."""
    return df.withColumn("cumulative", F.sum(ratio).over(Window.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))


def append_log(log: DataFrame, rows: DataFrame, index: str = "index", missing: str = "None") -> DataFrame:
    """Appends experiment rows: the header grows, cells without a value read 'None', the index goes on from the largest. Values are kept as text, lists joined by commas."""
    text = lambda d: d.select(*[(F.array_join(F.col(f"`{c}`").cast("array<string>"), ",") if t.startswith("array") else F.col(f"`{c}`").cast("string")).alias(c) if c != index else F.col(f"`{c}`").cast("int").alias(c) for c, t in d.dtypes])
    last = log.agg(F.coalesce(F.max(F.col(index).cast("int")), F.lit(-1)).alias("_last"))
    new = text(rows.drop(index))
    numbered = new.withColumn("_r", F.row_number().over(Window.orderBy(*new.columns) if new.columns else Window.orderBy(F.lit(1)))).withColumn("_k", F.lit(0)).join(last.withColumn("_k", F.lit(0)), "_k")
    numbered = numbered.withColumn(index, (F.col("_last") + F.col("_r")).cast("int")).drop("_r", "_k", "_last")
    both = text(log).unionByName(numbered, allowMissingColumns=True)
    return both.na.fill(missing, [c for c in both.columns if c != index])


def next_experiment(names: DataFrame, name: str) -> DataFrame:
    """The number after the largest of experiment_N; 0 where there is none."""
    return names.agg((F.coalesce(F.max(F.regexp_extract(name, r"^experiment_(\d+)$", 1).try_cast("int")), F.lit(-1)) + 1).alias("next_number"))


def flatten_keys(d: Mapping, parent: str = "") -> dict:
    """Nested dictionaries to one level: keys joined by '_', dots removed, blanks to '-'."""
    out: dict = {}
    for k, v in d.items():
        key = (f"{parent}_" if parent else "") + str(k).replace(".", "").replace(" ", "-")
        out.update(flatten_keys(v, key) if isinstance(v, Mapping) else {key: v})
    return out


def parameter_grid(spark, values: Mapping[str, Sequence], ordinal: str = "ordinal") -> DataFrame:
    """The cartesian product of small lists in the order of nested loops (last varies fastest)."""
    out, weights, weight = spark.range(1, numPartitions=1).select(F.lit(0).cast("bigint").alias(ordinal)), {}, 1
    for name in reversed(list(values)):
        weights[name] = weight
        weight *= len(values[name])
    for name, vals in values.items():
        kind = "boolean" if all(isinstance(v, bool) or v is None for v in vals) else "string"
        cells = [F.struct(F.lit(v).cast(kind).alias("v"), F.lit(i * weights[name]).cast("bigint").alias("o")) for i, v in enumerate(vals)]
        out = out.withColumn("_c", F.explode(F.array(*cells))).select(*[c for c in out.columns if c != ordinal], F.col("_c.v").alias(name), (F.col(ordinal) + F.col("_c.o")).alias(ordinal))
    return out


def prune_grid(grid: DataFrame, ordinal: str = "ordinal") -> DataFrame:
    """Valid, distinct combinations: no selection or PCA over nothing, no layers a plain dataset lacks; combinations that differ in unused parameters only are one, the first stays."""
    only_bands = F.col("use_band_features") & ~F.col("use_glcm_features") & ~F.col("use_other_features")
    plain = F.lower(F.regexp_extract("dataset_path", r"([^/]*)$", 1)) == "dataset.csv"
    bad = (F.col("features_selection_strategy").isNotNull() & only_bands & ~F.col("fss_use_bands")) | (F.col("apply_pca") & only_bands & ~F.col("pca_use_bands"))
    bad = bad | (plain & (F.col("use_other_features") | (F.col("apply_pca") & ~F.col("pca_use_bands") & ~F.col("use_glcm_features"))))
    kept = grid.where(~bad)
    unused = {
        "pca_use_bands": F.when(F.col("apply_pca"), F.col("pca_use_bands")), "pca_components_selection_strategy": F.when(F.col("apply_pca"), F.col("pca_components_selection_strategy")),
        "fss_use_bands": F.when(F.col("features_selection_strategy").isNotNull(), F.col("fss_use_bands")),
    }
    names = [c for c in grid.columns if c != ordinal]
    w = Window.partitionBy(*[unused.get(c, F.col(c)) for c in names]).orderBy(ordinal)
    return kept.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
