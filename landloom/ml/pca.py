"""Principal components from one distributed pass of centred products; the feature-by-feature matrix is solved on the driver."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from landloom.operators.stats import column_means, pair_sums


@dataclass
class Pca:
    columns: list[str]
    mean: np.ndarray
    components: np.ndarray
    variance: np.ndarray
    ratio: np.ndarray

    def transform(self, df: DataFrame, n: int, passthrough: Sequence[str] = ()) -> DataFrame:
        """Columns PC1..PCn, a matrix product per Arrow batch, and the columns passed through; null where a row lacks a value."""
        weights, mean, kept = self.components[:n].T, self.mean, len(passthrough)
        kinds = dict(df.dtypes)
        names = [*passthrough, *[f"PC{k + 1}" for k in range(n)]]
        shape = ", ".join([*[f"`{c}` {kinds[c]}" for c in passthrough], *[f"PC{k + 1} double" for k in range(n)]])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in b.columns[kept:]]) - mean
                y = x @ weights
                yield pa.RecordBatch.from_arrays([*b.columns[:kept], *[pa.array(y[:, k], from_pandas=True) for k in range(n)]], names)

        return df.select(*passthrough, *[F.col(f"`{c}`").cast("double") for c in self.columns]).mapInArrow(run, shape)

    def save(self, spark: SparkSession, path: str) -> None:
        """One JSON document at path; an existing one is replaced."""
        text = json.dumps({"columns": self.columns, **{k: getattr(self, k).tolist() for k in ("mean", "components", "variance", "ratio")}})
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> Pca:
        d = json.loads("".join(r["value"] for r in spark.read.text(path).collect()))
        return Pca(d["columns"], *[np.array(d[k], float) for k in ("mean", "components", "variance", "ratio")])


def fit(df: DataFrame, columns: Sequence[str]) -> Pca:
    """Components of the covariance over rows that have all values. Signs: the largest loading of each component is positive."""
    cols = list(columns)
    whole = df.select(*[F.col(f"`{c}`").cast("double").alias(f"c{k}") for k, c in enumerate(cols)]).na.drop()
    names = whole.columns
    first = np.array(column_means(whole, names))
    cov = np.zeros((len(cols), len(cols)))
    mean = first.copy()
    for r in pair_sums(whole, names, first).collect():  # a row per pair of features
        n = max(r["n"], 1)
        cov[r["i"], r["j"]] = cov[r["j"], r["i"]] = (r["sxy"] - r["sx"] * r["sy"] / n) / max(r["n"] - 1, 1)
        if r["i"] == r["j"]:
            mean[r["i"]] = first[r["i"]] + r["sx"] / n
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(values)[::-1]
    values, vectors = np.maximum(values[order], 0), vectors[:, order].T
    sign = np.sign(vectors[np.arange(len(cols)), np.abs(vectors).argmax(1)])
    return Pca(cols, mean, vectors * np.where(sign == 0, 1, sign)[:, None], values, values / max(values.sum(), 1e-300))


def knee(y: np.ndarray, sensitivity: float = 1.0) -> int | None:
    """Kneedle (Satopaa et al. 2011) for a convex, decreasing curve over 1..n."""
    n = len(y)
    if n < 3 or y.max() == y.min():
        return None
    x = np.linspace(0, 1, n)
    d = (1 - (y - y.min()) / (y.max() - y.min())) - x
    best = None
    peaks = [i for i in range(1, n - 1) if d[i] >= d[i - 1] and d[i] >= d[i + 1]]
    for p in peaks:
        limit = d[p] - sensitivity * np.abs(np.diff(x).mean())
        for j in range(p + 1, n):
            if j in peaks:
                break
            if d[j] < limit:
                best = p + 1
                break
        if best:
            break
    return best


def choose(p: Pca, strategy: str = "average", threshold: float = 0.95) -> int:
    cev = int(np.argmax(np.cumsum(p.ratio) >= threshold)) + 1
    elbow = knee(p.ratio) or 1
    options = {"cev": cev, "ec": elbow, "average": round((cev + elbow) / 2)}
    if strategy not in options:
        raise ValueError(f"unknown strategy {strategy}")
    return options[strategy]
