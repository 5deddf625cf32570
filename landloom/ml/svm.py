"""Support vector machines with RBF or linear kernel, as NumPy kernels run by Spark over (class x parameters x fold).

Training sets are a few thousand labelled rows (the bound is a parameter), so one task holds one problem; parallelism is over classes, grid
cells and folds, and prediction is a mapInPandas over any number of rows with the model in the closure.
"""

from __future__ import annotations

import itertools
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_ROWS = 20_000


def rbf(a: np.ndarray, b: np.ndarray, gamma: float) -> np.ndarray:
    d = a @ b.T  # one matrix, changed in place
    d *= -2.0
    d += (a * a).sum(1)[:, None]
    d += (b * b).sum(1)[None, :]
    np.maximum(d, 0.0, out=d)
    d *= -gamma
    return np.exp(d, out=d)


@dataclass
class Binary:
    """Dual solution: f(x) = sum of coef * K(sv, x) + bias."""

    gamma: float
    sv: np.ndarray
    coef: np.ndarray
    bias: float
    kernel: str = "rbf"

    def decide(self, x: np.ndarray) -> np.ndarray:
        if not len(self.sv):
            return np.full(len(x), self.bias)
        k = rbf(x, self.sv, self.gamma) if self.kernel == "rbf" else x @ self.sv.T
        return k @ self.coef + self.bias


def smo(k: np.ndarray, y: np.ndarray, c: np.ndarray, tol: float = 1e-3, most: int = 200_000) -> tuple[np.ndarray, float]:
    """Sequential minimal optimisation with second-order choice of the pair (Platt 1998; Fan, Chen and Lin 2005)."""
    n = len(y)
    alpha, grad = np.zeros(n), -np.ones(n)
    diag = np.diag(k)
    for _ in range(most):
        up = ((y > 0) & (alpha < c)) | ((y < 0) & (alpha > 0))
        low = ((y > 0) & (alpha > 0)) | ((y < 0) & (alpha < c))
        v = -y * grad
        if not up.any() or not low.any():
            break
        i = int(np.argmax(np.where(up, v, -np.inf)))
        gap = v[i] - v
        if gap[low].max() < tol:
            break
        curve = np.maximum(diag[i] + diag - 2 * k[i], 1e-12)
        j = int(np.argmax(np.where(low & (gap > 0), gap * gap / curve, -np.inf)))
        step = gap[j] / curve[j]
        room_i = c[i] - alpha[i] if y[i] > 0 else alpha[i]
        room_j = alpha[j] if y[j] > 0 else c[j] - alpha[j]
        step = min(step, room_i, room_j)
        alpha[i] += y[i] * step
        alpha[j] -= y[j] * step
        grad += y * step * (k[i] - k[j])
    v = -y * grad
    free = (alpha > 1e-9) & (alpha < c - 1e-9)
    if free.any():
        bias = float(v[free].mean())
    else:
        up = ((y > 0) & (alpha < c)) | ((y < 0) & (alpha > 0))
        low = ((y > 0) & (alpha > 0)) | ((y < 0) & (alpha < c))
        bias = float(((v[up].max() if up.any() else 0.0) + (v[low].min() if low.any() else 0.0)) / 2)
    return alpha, bias


def fit_binary(x: np.ndarray, positive: np.ndarray, c: float, gamma: float, balanced: bool = False, kernel: str = "rbf") -> Binary:
    y = np.where(positive, 1.0, -1.0)
    if positive.all() or not positive.any():
        return Binary(gamma, x[:0], np.zeros(0), 1.0 if positive.all() else -1.0, kernel)
    weight = np.full(len(y), float(c))
    if balanced:
        weight = np.where(positive, c * len(y) / (2 * positive.sum()), c * len(y) / (2 * (~positive).sum()))
    k = rbf(x, x, gamma) if kernel == "rbf" else x @ x.T
    alpha, bias = smo(k, y, weight)
    keep = alpha > 1e-9
    return Binary(gamma, x[keep], (alpha * y)[keep], bias, kernel)


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators; returns knots and values. Equal x are pooled first."""
    ux, inverse, n = np.unique(x, return_inverse=True, return_counts=True)
    mean = np.bincount(inverse, y) / n
    blocks: list[list[float]] = []
    for v, w in zip(mean, n, strict=True):
        blocks.append([float(v), float(w), 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            b = blocks.pop()
            a = blocks[-1]
            a[0], a[1], a[2] = (a[0] * a[1] + b[0] * b[1]) / (a[1] + b[1]), a[1] + b[1], a[2] + b[2]
    return ux, np.repeat([b[0] for b in blocks], [int(b[2]) for b in blocks])


@dataclass
class Calibrated:
    model: Binary
    x: np.ndarray
    y: np.ndarray

    def proba(self, v: np.ndarray) -> np.ndarray:
        return np.interp(self.model.decide(v), self.x, self.y)


def normalise(p: np.ndarray) -> np.ndarray:
    """Class probabilities of each row made to sum to 1. With two classes the second one's is kept and the first takes the rest; otherwise rows are divided by their sum, and a row without
    any probability becomes uniform. Rounding never leaves a value above 1."""
    n, k = p.shape
    if k == 2:
        return np.column_stack([1.0 - p[:, 1], np.where(np.abs(p[:, 1] - 1.0) <= 1e-5, np.minimum(p[:, 1], 1.0), p[:, 1])])
    total = p.sum(axis=1)
    shares = np.full((n, k), 1.0 / k)
    some = total != 0
    shares[some] = p[some] / total[some, None]
    return np.where(np.abs(shares - 1.0) <= 1e-5, np.minimum(shares, 1.0), shares)


def softmax(p: np.ndarray) -> np.ndarray:
    e = np.exp(p - p.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


MODES = ("multiclass", "multiclass_calibrated", "binary", "binary_softmax")


@dataclass
class Ensemble:
    """One-vs-rest machines with isotonic calibration, and a one-vs-one multiclass machine with its calibrated twin."""

    classes: list
    binary: dict = field(default_factory=dict)
    pairs: dict = field(default_factory=dict)
    twin: dict = field(default_factory=dict)

    def votes(self, x: np.ndarray) -> np.ndarray:
        """One-vs-one decision as votes plus a squashed sum of confidences, one column per class."""
        k = len(self.classes)
        votes, conf = np.zeros((len(x), k)), np.zeros((len(x), k))
        for (i, j), m in self.pairs.items():
            d = m.decide(x)
            votes[:, i] += d > 0
            votes[:, j] += d <= 0
            conf[:, i] += d
            conf[:, j] -= d
        return votes + conf / (3 * (np.abs(conf) + 1))

    def proba(self, x: np.ndarray, mode: str) -> np.ndarray:
        if mode == "multiclass":
            return softmax(self.votes(x))
        if mode == "multiclass_calibrated":
            v = self.votes(x)
            return normalise(np.stack([np.interp(v[:, i], *self.twin[c]) for i, c in enumerate(self.classes)], 1))
        p = np.stack([self.binary[c].proba(x) for c in self.classes], 1)
        if mode == "binary":
            return normalise(p)
        if mode == "binary_softmax":
            return softmax(p)
        raise ValueError(mode)

    def predict(self, x: np.ndarray, mode: str) -> np.ndarray:
        return np.asarray(self.classes, object)[(self.votes(x) if mode == "multiclass" else self.proba(x, mode)).argmax(1)]

    def to_rows(self) -> list[dict]:
        """Plain rows (kind, a, b, gamma, kernel, bias, coef, sv, knots, values) for a JSON or Parquet model table."""
        blank = {"a": None, "b": None, "gamma": None, "kernel": None, "bias": None, "coef": [], "sv": [], "knots": [], "values": []}
        rows = [{**blank, "kind": "classes", "a": [str(c) for c in self.classes]}]

        def machine(m: Binary) -> dict:
            return {"gamma": m.gamma, "kernel": m.kernel, "bias": m.bias, "coef": m.coef.tolist(), "sv": m.sv.tolist()}

        rows += [{**blank, "kind": "binary", "a": [str(c)], **machine(m.model), "knots": m.x.tolist(), "values": m.y.tolist()} for c, m in self.binary.items()]
        rows += [{**blank, "kind": "pair", "a": [str(self.classes[i])], "b": str(self.classes[j]), **machine(m)} for (i, j), m in self.pairs.items()]
        rows += [{**blank, "kind": "twin", "a": [str(c)], "knots": np.asarray(t[0]).tolist(), "values": np.asarray(t[1]).tolist()} for c, t in self.twin.items()]
        return rows

    @classmethod
    def from_rows(cls, rows: Sequence[dict]) -> Ensemble:
        out = cls(next(r["a"] for r in rows if r["kind"] == "classes"))
        width = max((len(s) for r in rows for s in r["sv"]), default=0)
        machine = lambda r: Binary(r["gamma"], np.array(r["sv"], float).reshape(len(r["sv"]), width), np.array(r["coef"], float), r["bias"], r["kernel"])
        for r in rows:
            if r["kind"] == "binary":
                out.binary[r["a"][0]] = Calibrated(machine(r), np.array(r["knots"]), np.array(r["values"]))
            elif r["kind"] == "pair":
                out.pairs[out.classes.index(r["a"][0]), out.classes.index(r["b"])] = machine(r)
            elif r["kind"] == "twin":
                out.twin[r["a"][0]] = (np.array(r["knots"]), np.array(r["values"]))
        return out


def f1_macro(truth: np.ndarray, pred: np.ndarray) -> float:
    scores = []
    for c in np.unique(np.concatenate([truth, pred])):
        hit, got, want = ((truth == c) & (pred == c)).sum(), (pred == c).sum(), (truth == c).sum()
        scores.append(2 * hit / (got + want) if got + want else 0.0)
    return float(np.mean(scores))


def folds(y: np.ndarray, k: int = 3) -> np.ndarray:
    """Stratified folds in row order."""
    out = np.zeros(len(y), int)
    for c in np.unique(y):
        at = np.flatnonzero(y == c)
        out[at] = np.arange(len(at)) % k
    return out


def bounded(df: DataFrame, features: str, label: str, most: int = MOST_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """At most `most` labelled rows for fitting, chosen by hash."""
    pdf = df.where(F.col(label).isNotNull() & F.col(features).isNotNull()).select(features, label).orderBy(F.xxhash64(features, label), features).limit(most).toPandas()
    return np.array(pdf[features].tolist(), float).reshape(len(pdf), -1), pdf[label].to_numpy()


def grid_search(spark, x: np.ndarray, y: np.ndarray, cs: Sequence[float], gammas: Sequence[float], balanced: Sequence[bool] = (False,), k: int = 3, classes: Sequence | None = None, last_best: bool = False) -> pd.DataFrame:
    """Best (c, gamma, balanced) by mean macro F1 over stratified folds, for each class one-vs-rest, and for label None the multiclass problem. One task per (label, parameters)."""
    labels = [None, *list(classes if classes is not None else np.unique(y))]
    cells = [(-1 if c is None else i - 1, float(a), float(g), bool(b)) for (i, c), a, g, b in itertools.product(list(enumerate(labels)), cs, gammas, balanced)]
    fold = folds(y, k)
    names = np.unique(y)
    shared = spark.sparkContext.broadcast((x, y))  # bounded by MOST_ROWS

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = shared.value
        out = []
        for r in pdf.itertuples():
            scores = []
            for f in range(k):
                tr, te = fold != f, fold == f
                if r.label < 0:
                    m = fit_pairs(x[tr], y[tr], list(names), r.c, r.gamma, r.balanced)
                    e = Ensemble(list(names), pairs=m)
                    scores.append(f1_macro(y[te], e.predict(x[te], "multiclass").astype(y.dtype)))
                else:
                    target = labels[r.label + 1]
                    m = fit_binary(x[tr], y[tr] == target, r.c, r.gamma, r.balanced)
                    scores.append(f1_macro(y[te] == target, m.decide(x[te]) > 0))
            out.append(float(np.mean(scores)))
        return pdf.assign(score=out)

    frame = spark.createDataFrame(cells, "label int, c double, gamma double, balanced boolean").withColumn("no", F.monotonically_increasing_id())
    scored = frame.repartition("no").groupBy("no").applyInPandas(run, "label int, c double, gamma double, balanced boolean, no bigint, score double").toPandas()
    scored = scored.sort_values(["label", "score", "no"], ascending=[True, False, not last_best])
    return scored.groupby("label", as_index=False).first()


def fit_pairs(x: np.ndarray, y: np.ndarray, classes: list, c: float, gamma: float, balanced: bool = False) -> dict:
    out = {}
    for i, j in itertools.combinations(range(len(classes)), 2):
        at = (y == classes[i]) | (y == classes[j])
        if at.any():
            out[i, j] = fit_binary(x[at], y[at] == classes[i], c, gamma, balanced)
    return out


MACHINE = "kind string, i int, j int, bias double, coef array<double>, sv array<array<double>>"


def fit_ensemble(x: np.ndarray, y: np.ndarray, x_cal: np.ndarray, y_cal: np.ndarray, c: float, gamma: float, balanced: bool = False, spark=None) -> Ensemble:
    """Machines on the training part, calibrators on the other. With a session every machine (a class against the rest, or a pair of classes) is fitted in a task of its own."""
    e = Ensemble(list(np.unique(y)))
    jobs = [("binary", i, -1) for i in range(len(e.classes))] + [("pair", i, j) for i, j in itertools.combinations(range(len(e.classes)), 2)]

    def fit_one(kind: str, i: int, j: int, x: np.ndarray, y: np.ndarray) -> Binary:
        if kind == "binary":
            return fit_binary(x, y == e.classes[i], c, gamma, balanced)
        at = (y == e.classes[i]) | (y == e.classes[j])
        return fit_binary(x[at], y[at] == e.classes[i], c, gamma, balanced)

    if spark is None:
        found = {job: fit_one(*job, x, y) for job in jobs}
    else:
        shared = spark.sparkContext.broadcast((x, y))  # bounded by MOST_ROWS

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            rows = []
            for r in pdf.itertuples():
                m = fit_one(r.kind, r.i, r.j, *shared.value)
                rows.append((r.kind, r.i, r.j, m.bias, m.coef.tolist(), m.sv.tolist()))
            return pd.DataFrame(rows, columns=["kind", "i", "j", "bias", "coef", "sv"])

        rows = spark.createDataFrame([(n, *job) for n, job in enumerate(jobs)], "n int, kind string, i int, j int").repartition(len(jobs), "n").groupBy("n").applyInPandas(run, MACHINE).collect()  # support vectors: at most MOST_ROWS a machine
        found = {(r["kind"], r["i"], r["j"]): Binary(gamma, np.array(r["sv"], float).reshape(len(r["sv"]), x.shape[1]), np.array(r["coef"], float), r["bias"]) for r in rows}
        shared.unpersist()
    for i, k in enumerate(e.classes):
        m = found["binary", i, -1]
        e.binary[k] = Calibrated(m, *isotonic(m.decide(x_cal), (y_cal == k).astype(float)))
    e.pairs = {(i, j): m for (kind, i, j), m in found.items() if kind == "pair"}
    v = e.votes(x_cal)
    e.twin = {k: isotonic(v[:, i], (y_cal == k).astype(float)) for i, k in enumerate(e.classes)}
    return e


def predict(df: DataFrame, ensemble: Ensemble, features: str, keys: Sequence[str], mode: str = "binary", most_cells: int = 16_000_000) -> DataFrame:
    """(keys, label, p0.. of the classes in order, as quantised 0..255). Map only: rows stay where they are, and each is scored once. most_cells bounds the kernel matrix of a step: 128 MB by default."""
    kinds = dict(df.dtypes)
    shape = ", ".join([f"`{k}` {kinds[k]}" for k in keys] + ["label string"] + [f"p{i} int" for i in range(len(ensemble.classes))])

    machines = [*[m.model for m in ensemble.binary.values()], *ensemble.pairs.values()]
    chunk = max(1, most_cells // max([1, *[len(m.sv) for m in machines]]))
    names = np.asarray(ensemble.classes, object)

    def run(frames):
        for pdf in frames:
            if not len(pdf):
                continue
            x = np.array(pdf[features].tolist(), float).reshape(len(pdf), -1)
            p = np.concatenate([ensemble.proba(x[i : i + chunk], mode) for i in range(0, len(x), chunk)])
            label = names[p.argmax(1)]  # softmax keeps the order of votes
            q = (p * 255).astype(np.int32)
            yield pd.DataFrame({**{k: pdf[k] for k in keys}, "label": label.astype(str), **{f"p{i}": q[:, i] for i in range(q.shape[1])}})

    return df.select(*keys, features).mapInPandas(run, shape)


def rfecv(x: np.ndarray, y: np.ndarray, names: Sequence[str], c: float = 1.0, k: int = 3, spark=None) -> list[str]:
    """Recursive elimination by the weights of linear machines, one feature a step; the number of features with the best mean macro F1 over folds wins (fewest on a tie)."""
    fold = folds(y, k)
    classes = np.unique(y)

    def order_and_scores(f: int) -> tuple[list[int], list[float]]:
        tr, te = (fold != f, fold == f) if f >= 0 else (np.ones(len(y), bool), np.zeros(len(y), bool))
        left, scores, gone = list(range(x.shape[1])), [], []
        while left:
            ms = [fit_binary(x[tr][:, left], y[tr] == q, c, 1.0, kernel="linear") for q in classes]
            if f >= 0:
                d = np.stack([m.decide(x[te][:, left]) for m in ms], 1)
                scores.append(f1_macro(y[te], classes[d.argmax(1)]))
            w = sum((((m.coef @ m.sv) ** 2) if len(m.sv) else np.zeros(len(left)) for m in ms), np.zeros(len(left)))
            gone.append(left.pop(int(np.argmin(w))))
        return gone, scores[::-1]

    if spark is not None:
        rows = spark.createDataFrame([(f,) for f in range(-1, k)], "f int").groupBy("f").applyInPandas(lambda p: pd.DataFrame({"f": p["f"], "r": [order_and_scores(int(p["f"].iloc[0]))]}).assign(gone=lambda d: d["r"].map(lambda r: r[0]), scores=lambda d: d["r"].map(lambda r: r[1])).drop(columns="r"), "f int, gone array<int>, scores array<double>").collect()
        found = {r["f"]: (list(r["gone"]), list(r["scores"])) for r in rows}
    else:
        found = {f: order_and_scores(f) for f in range(-1, k)}
    mean = np.mean([found[f][1] for f in range(k)], axis=0)
    best = int(np.argmax(mean)) + 1
    keep = set(found[-1][0][-best:])
    return [n for i, n in enumerate(names) if i in keep]


MODEL = "kind string, a array<string>, b string, gamma double, kernel string, bias double, coef array<double>, sv array<array<double>>, knots array<double>, values array<double>"


def save(spark, ensemble: Ensemble, path: str) -> None:
    """The model as a JSON table; an existing one is replaced."""
    spark.createDataFrame([tuple(r[c.split()[0]] for c in MODEL.split(", ")) for r in ensemble.to_rows()], MODEL).coalesce(1).write.mode("overwrite").json(path)


def load(spark, path: str) -> Ensemble:
    return Ensemble.from_rows([r.asDict() for r in spark.read.schema(MODEL).json(path).collect()])  # a model: bounded by MOST_ROWS support vectors
