"""A sample whose category shares match given targets.

1. Moments: rows per category and margin (any second column, such as the source), aggregated over all rows: a map-side combine, one row per cell.
2. Calibration: with n_cm rows in cell (c, m) and d the design rate, inclusion probabilities p_cm = d exp(lambda_c + mu_m) come from the dual of exponential tilting, solved by damped Newton iterations
   over lambda and mu jointly. The totals by category are hard constraints: every category's is its `needed` rows or, if it has fewer, all it has. The margins' shares of the rows drawn from are
   soft ones (a ridge on mu), so the sample keeps the mix of sources as far as the categories let it. Cells whose probability would pass 1 are fixed at 1, and the rest is solved again.
3. Report: per target the rows needed (the greater of floor and share of the sample), available, expected under the calibrated probabilities, and the gap that is left.
4. Draw: the pivotal method, as a tournament: undecided rows meet in pairs, each meeting decides at least one of the two, so a block takes a logarithmic number of array steps. Rows are
   hashed to blocks of bounded size within their category; a block leaves one row at most with a probability between 0 and 1; these leftovers meet in a second
   round per category. No task holds more than a block, counts per category are exact, and a hot category is only more blocks.

Every target that is available is met, so where floors or rounding up ask for more than the sample's size, the sample has those rows more; where categories are short, it has
fewer. The report's sums say how many.

Defined results: rows without id or category are not usable; an id counts once (least category, then least margin if deliveries disagree); a null margin is a value; targets with null
class_id match no row; null share, floor or rate read as 0; repeated targets count once (the largest values); categories that a set doesn't name are not drawn; empty
tables give empty results; equal seeds give equal samples whatever the partitioning.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landloom.session import cut

REPORT = "target_set string, class_id int, needed bigint, available bigint, expected double, gap bigint, status string"
RATES = "target_set string, category int, margin string, probability double"
MOST_CELLS = 1_000_000  # rows of targets and of (category, margin) cells that the driver may hold: tables of classes, not of records
RIDGE = 0.01


def usable(records: DataFrame, record_id: str, category: str, margin: str | None = None) -> DataFrame:
    """(id, category, margin), one row per id."""
    cell = F.struct(F.col(category).cast("int").alias("category"), (F.col(margin) if margin else F.lit(None)).cast("string").alias("margin"))
    rows = records.where(F.col(record_id).isNotNull() & F.col(category).isNotNull())
    return rows.groupBy(F.col(record_id).alias("id")).agg(F.min(cell).alias("cell")).select("id", "cell.category", "cell.margin")


def newton(moments: np.ndarray, totals: np.ndarray, margins: np.ndarray, rate: float, ridge: float = RIDGE, steps: int = 200, within: float = 1e-11) -> np.ndarray:
    """p = rate * exp(lambda_c + mu_m) per cell with moments (categories, margins), so that each category's sum of p * moments is its total, which is positive and needs moments.

    Maximises totals.lambda + margins.mu - sum(moments * p) - ridge / 2 * sum(totals) * |mu|^2; a step is halved until the dual doesn't fall.
    """
    k, m = moments.shape
    weight = ridge * totals.sum()
    lam, mu = np.log(totals / (moments.sum(1) * rate)), np.zeros(m)
    cells = lambda a, b: moments * (rate * np.exp(a[:, None] + b[None, :]))
    value = lambda a, b, now: totals @ a + margins @ b - now.sum() - weight / 2 * (b @ b)
    now = cells(lam, mu)
    best = value(lam, mu, now)
    for _ in range(steps):
        by_c = now.sum(1)
        gradient = np.concatenate([totals - by_c, margins - now.sum(0) - weight * mu])
        if (np.abs(gradient) <= within * np.maximum(1.0, totals.sum())).all():
            break
        # Eliminate lambda, whose block is diagonal: what is left has one row per margin.
        cross = now / by_c[:, None]
        schur = np.diag(now.sum(0) + weight) - now.T @ cross
        step_mu = np.linalg.solve(schur, gradient[k:] - cross.T @ gradient[:k])
        step_lam = gradient[:k] / by_c - cross @ step_mu
        scale = 1.0
        while scale > 1e-9:
            a, b = lam + scale * step_lam, mu + scale * step_mu
            with np.errstate(over="ignore"):
                then = cells(a, b)
            after = value(a, b, then)
            if after >= best - 1e-12 * abs(best):
                break
            scale /= 2
        lam, mu, now, best = a, b, then, after
    # The categories' totals are hard: a last exact scaling takes the rounding that is left.
    p = rate * np.exp(lam[:, None] + mu[None, :])
    return p * (totals / (moments * p).sum(1))[:, None]


def calibrated(moments: np.ndarray, totals: np.ndarray, rate: float) -> np.ndarray:
    """Probabilities in 0..1 per cell with sum(p * moments) = total in each category; total <= rows of the category."""
    p = np.zeros(moments.shape)
    have = moments.sum(1)
    p[totals >= have] = 1.0
    fixed = np.broadcast_to((totals >= have)[:, None], moments.shape) | (moments == 0)
    while True:
        open_c = np.flatnonzero((~fixed).any(1) & (totals > 0) & (totals < have))
        if not len(open_c):
            return p
        free = np.where(fixed[open_c], 0.0, moments[open_c])
        left = totals[open_c] - (np.where(fixed[open_c], p[open_c], 0.0) * moments[open_c]).sum(1)
        share = free.sum(0) / free.sum()
        keep = share > 0
        found = newton(free[:, keep], left, left.sum() * share[keep], rate)
        full = np.zeros(free.shape)
        full[:, keep] = found
        over = (full > 1.0) & (free > 0)
        p[open_c] = np.where(fixed[open_c], p[open_c], np.where(free > 0, full, 0.0))
        if not over.any():
            return np.minimum(p, 1.0)
        p[open_c] = np.where(over, 1.0, p[open_c])
        fixed = fixed.copy()
        fixed[open_c] |= over


def solve(counts: dict[tuple[int, str | None], int], wants: list[tuple[int | None, int, int]], permille: int) -> tuple[list[tuple], list[tuple]]:
    """For one set: (class, needed, available, expected, gap, status) of each wanted class, and (class, margin, probability). wants: (class, share permille, floor)."""
    size = sum(counts.values()) * permille // 1000
    need = [max(floor, -(-size * share // 1000)) for _, share, floor in wants]
    names = sorted({m for _, m in counts}, key=lambda m: (m is not None, m))
    moments = np.array([[counts.get((c, m), 0) if c is not None else 0 for m in names] for c, _, _ in wants], float).reshape(len(wants), len(names))
    have = moments.sum(1)
    p = calibrated(moments, np.minimum(need, have), permille / 1000 if permille > 0 else 1.0)
    expected = (p * moments).sum(1)
    report = []
    for i, (c, share, floor) in enumerate(wants):
        gap = need[i] - round(expected[i])
        status = "short" if gap > 0 else "floor" if floor > -(-size * share // 1000) else "met"
        report.append((c, need[i], int(have[i]), float(expected[i]), gap, status))
    rates = [(c, m, float(p[i, j])) for i, (c, _, _) in enumerate(wants) for j, m in enumerate(names) if p[i, j] > 0]
    return report, rates


def plan(rows: DataFrame, targets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The report, one row per target, and the rates (target_set, category, margin, probability). rows: (id, category, margin)."""
    spark = rows.sparkSession
    counted = rows.groupBy("category", "margin").count().limit(MOST_CELLS + 1).collect()
    asked = targets.groupBy("target_set", F.col("class_id").cast("int").alias("class_id")).agg(*[F.max(F.coalesce(c, F.lit(0))).cast("bigint").alias(c) for c in ("share_permille", "min_rows", "sample_permille")]).limit(MOST_CELLS + 1).collect()
    if max(len(counted), len(asked)) > MOST_CELLS:
        raise ValueError(f"more than {MOST_CELLS} cells or targets")
    counts = {(r["category"], r["margin"]): r["count"] for r in counted}
    sets: dict = {}
    for r in sorted(asked, key=lambda r: (str(r["target_set"]), r["class_id"] is None, r["class_id"] or 0)):
        sets.setdefault(r["target_set"], []).append(r)
    report, rates = [], []
    for name, rs in sets.items():
        told, found = solve(counts, [(r["class_id"], r["share_permille"], r["min_rows"]) for r in rs], max(r["sample_permille"] for r in rs))
        report += [(name, *x) for x in told]
        rates += [(name, *x) for x in found]
    return spark.createDataFrame(report, REPORT), spark.createDataFrame(rates, RATES)


def _random(seed: int, *parts) -> np.random.Generator:
    words = [seed % 2**32]
    for x in parts:
        words += [len(x), *x.encode()] if isinstance(x, str) else [2**31, x % 2**32] if x is not None else [2**31 + 1]
    return np.random.default_rng(words)


def pivotal(p: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, int, float]:
    """The pivotal method: which units are drawn, the unit left open (-1: none) and its probability. Neighbours meet first, so the sample is spread over the order of the units."""
    near = 1e-7
    drawn = p >= 1.0 - near
    units = np.flatnonzero((p > near) & ~drawn)
    q = p[units].astype(float)
    while len(units) > 1:
        n = len(units) // 2
        a, b = q[0 : 2 * n : 2], q[1 : 2 * n : 2]
        i, j = units[0 : 2 * n : 2], units[1 : 2 * n : 2]
        s, u = a + b, rng.random(n)
        low = s <= 1.0
        # Below 1 one of the two goes and the other has the sum; above it one is drawn and the other keeps the rest.
        second = np.where(low, u * s >= a, u * (2.0 - s) < 1.0 - b)
        stays, leaves = np.where(second, j, i), np.where(second, i, j)
        drawn[leaves[~low]] = True
        rest = np.where(low, s, s - 1.0)
        full = rest >= 1.0 - near
        drawn[stays[full]] = True
        keep = ~full & (rest > near)
        units, q = np.concatenate([stays[keep], units[2 * n :]]), np.concatenate([rest[keep], q[2 * n :]])
    return (drawn, int(units[0]), float(q[0])) if len(units) else (drawn, -1, 0.0)


DRAWN = "target_set string, id bigint, category int, p double"


def draw(rows: DataFrame, rates: DataFrame, seed: int = 7, block_rows: int = 20_000) -> DataFrame:
    """(target_set, id, category): the sample of every set. rows: (id, category, margin); rates: of `plan`."""
    spark = rows.sparkSession
    chances: dict[int, dict[str | None, dict[str | None, float]]] = {}
    for r in rates.collect():  # bounded by plan()
        chances.setdefault(r["category"], {}).setdefault(r["target_set"], {})[r["margin"]] = r["probability"]
    counts = {r["category"]: r["count"] for r in rows.groupBy("category").count().where(F.col("category").isin(list(chances))).collect()}
    sizes = spark.createDataFrame([(c, max(1, math.ceil(counts.get(c, 0) / block_rows))) for c in chances], "category int, blocks int")
    blocked = rows.join(sizes, "category").select("id", "category", "margin", F.pmod(F.xxhash64("id", F.lit(seed)), F.col("blocks")).cast("int").alias("block"), F.xxhash64("id", F.lit(seed + 1)).alias("order"))

    def first(table: pa.Table) -> pa.Table:
        c, block = table["category"][0].as_py(), table["block"][0].as_py()
        table = table.sort_by([("order", "ascending"), ("id", "ascending")])
        ids = np.asarray(table["id"])
        code = table["margin"].combine_chunks().dictionary_encode(null_encoding="encode")
        margins, at = code.dictionary.to_pylist(), np.asarray(code.indices)
        names, who, left = [], [], []
        for name, by in sorted(chances.get(c, {}).items(), key=lambda x: str(x[0])):
            p = np.array([by.get(m, 0.0) for m in margins])[at]
            drawn, holder, a = pivotal(p, _random(seed, name, c, block))
            got = ids[drawn]
            names += [name] * (len(got) + (holder >= 0))
            who += [got, ids[[holder]] if holder >= 0 else ids[:0]]
            left += [np.ones(len(got)), np.full(int(holder >= 0), a)]
        return pa.table({"target_set": pa.array(names, pa.string()), "id": pa.array(np.concatenate(who) if who else [], pa.int64()), "category": pa.array(np.full(len(names), c, np.int32)), "p": pa.array(np.concatenate(left) if left else [], pa.float64())})

    def second(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        rng = _random(seed, pdf["target_set"].iloc[0], int(pdf["category"].iloc[0]), -1)
        drawn, holder, a = pivotal(pdf["p"].to_numpy(), rng)
        if holder >= 0 and rng.random() < a:
            drawn[holder] = True
        return pdf[drawn].assign(p=1.0)

    rounds = cut(blocked.groupBy("category", "block").applyInArrow(first, DRAWN))
    rest = rounds.where("p < 1").groupBy("target_set", "category").applyInPandas(second, DRAWN)
    return rounds.where("p >= 1").unionByName(rest).select("target_set", "id", "category")
