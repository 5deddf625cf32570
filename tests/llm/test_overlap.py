import random

import numpy as np
from pyspark.sql import functions as F

from landloom.llm import overlap


def records(spark, rows):
    return spark.createDataFrame(rows, "row_id long, px double, py double, side string, loaded_at timestamp_ntz, id string, x string, grid string")


def row(i, x, y, side, at=None):
    return (i, x, y, side, at, "clash", "clash", "clash")


def brute(rows, d):
    t = [r for r in rows if r[3] == "train" and None not in r[:3]]
    e = [r for r in rows if r[3] == "eval" and None not in r[:3]]
    return {(a[0], b[0]) for a in t for b in e if (a[1] - b[1]) ** 2 + (a[2] - b[2]) ** 2 <= d * d}


def test_against_brute_force(spark):
    rng = random.Random(1)
    rows = [row(i, rng.randint(-40, 40) * 5.0, rng.randint(-40, 40) * 5.0, rng.choice(["train", "eval", "eval", None])) for i in range(900)]
    rows += [row(5000 + i, rng.uniform(-200, 200), rng.uniform(-200, 200), rng.choice(["train", "eval"])) for i in range(400)]
    rows += [row(7000, None, 1.0, "train"), row(7001, 1.0, None, "eval"), row(None, 0.0, 0.0, "train"), row(7002, float("nan"), 0.0, "eval")]
    got = [(r.train_id, r.eval_id) for r in overlap.cross_split_pairs(records(spark, rows), 15.0).collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute([r for r in rows if r[1] == r[1]], 15.0)


def test_distance_is_inclusive_and_deliveries_count_once(spark):
    rows = [row(1, 0.0, 0.0, "train"), row(1, 0.0, 0.0, "train"), row(2, 15.0, 0.0, "eval"), row(3, 9.0, 12.0, "eval"), row(4, 15.001, 0.0, "eval"), row(5, 0.0, 0.0, "other")]
    assert {tuple(r) for r in overlap.cross_split_pairs(records(spark, rows), 15.0).collect()} == {(1, 2), (1, 3)}


def test_empty_and_one_sided(spark):
    assert overlap.cross_split_pairs(records(spark, []), 15.0).count() == 0
    assert overlap.cross_split_pairs(records(spark, [row(1, 0.0, 0.0, "train"), row(2, 0.0, 0.0, "train")]), 15.0).count() == 0
    assert overlap.coverage(records(spark, []), 15.0).count() == 0


def test_hot_place(spark):
    df = spark.range(3000).select(F.col("id").alias("row_id"), F.when(F.col("id") < 1000, 0.0).otherwise(F.col("id") * 100.0).alias("px"), F.lit(0.0).alias("py"), F.when(F.col("id") < 3, "eval").otherwise("train").alias("side"), F.lit(None).cast("timestamp").alias("loaded_at"))
    assert overlap.cross_split_pairs(df, 15.0).count() == 3 * 997


def test_crowded_cells_in_several_runs(spark):
    rng = random.Random(3)
    rows = [row(i, rng.uniform(-20, 20), rng.uniform(-20, 20), rng.choice(["train", "eval"])) for i in range(500)]
    got = [(r.train_id, r.eval_id) for r in overlap.cross_split_pairs(records(spark, rows), 15.0, crowd=15).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows, 15.0)


def test_common_prefixes():
    row, col, length = np.array([1, 1, 1, 1, 2]), np.array([5, 5, 5, 6, 6]), np.array([1, 2, 2, 1, 1])
    assert overlap.common_prefixes(row, col, length).tolist() == [0, 1, 2, 0, 0]


def test_coverage_and_report_against_brute_force(spark):
    rng = random.Random(4)
    rows = [row(i, rng.randint(-30, 30) * 4.0, rng.randint(-30, 30) * 4.0, rng.choice(["train", "eval"])) for i in range(400)]
    pairs = brute(rows, 15.0)
    place = {r[0]: r[1:3] for r in rows}
    h, e = overlap.reach(15.0), overlap.edge(15.0)
    cells = lambda i: {(a, b) for a in range(int((place[i][0] - h) // e), int((place[i][0] + h) // e) + 1) for b in range(int((place[i][1] - h) // e), int((place[i][1] + h) // e) + 1)}
    want = {}
    for t, v in pairs:
        for i, j in ((t, v), (v, t)):
            want.setdefault(i, set()).update(cells(i) & cells(j))
    got = {r.id: (r.n_cells_shared, r.coverage) for r in overlap.coverage(records(spark, rows), 15.0).collect()}
    assert got == {i: (len(c), len(c) / len(cells(i))) for i, c in want.items()}
    report = overlap.split_report(records(spark, rows), 15.0, ["grid"]).collect()
    assert [tuple(r) for r in report] == [("clash", len({v for _, v in pairs}), len(pairs))]


def test_large_coordinates_and_small_distances(spark):
    rows = [row(1, 3e9, -4e9, "train"), row(2, 3e9 + 0.0625, -4e9, "eval"), row(3, 3e9 + 0.5, -4e9, "eval")]
    assert {tuple(r) for r in overlap.cross_split_pairs(records(spark, rows), 0.125).collect()} == {(1, 2)}
