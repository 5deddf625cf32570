import numpy as np
import pytest

from landloom.llm import calibrate as c


def test_newton_meets_totals():
    n, t = np.array([[1e6, 5e5], [10.0, 0.0], [500.0, 1.0], [0.0, 7.0]]), np.array([3.0, 9.99, 499.0, 0.01])
    p = c.newton(n, t, t.sum() * n.sum(0) / n.sum(), 0.3)
    assert np.allclose((n * p).sum(1), t, rtol=1e-9)


def test_calibration_is_joint_and_within_one():
    n = np.array([[900.0, 100.0], [100.0, 900.0], [5.0, 5.0], [0.0, 0.0]])
    p = c.calibrated(n, np.array([500.0, 100.0, 10.0, 0.0]), 0.3)
    assert np.allclose((n * p).sum(1), [500, 100, 10, 0]) and p.max() <= 1 and (p[2] == 1).all()
    # By category alone the first margin would have 460 of 600 rows; jointly it has less, as it holds half of the rows drawn from.
    assert p[0, 1] > p[0, 0] and p[1, 1] > p[1, 0] and (n[:2, 0] * p[:2, 0]).sum() < 440
    rng = np.random.default_rng(1)
    for _ in range(300):
        n = np.floor(rng.pareto(0.6, (rng.integers(1, 8), rng.integers(1, 6))))
        t = np.floor(n.sum(1) * rng.random(len(n)))
        p = c.calibrated(n, t, 0.4)
        assert np.allclose((n * p).sum(1), t, rtol=1e-7, atol=1e-7) and p.min() >= 0 and p.max() <= 1


def test_pivotal_keeps_sums_and_probabilities():
    rng = np.random.default_rng(0)
    p = np.array([0.2, 0.7, 1.0, 0.0, 0.35, 0.5, 0.25])
    hits = np.zeros(7)
    for _ in range(6000):
        drawn, left, a = c.pivotal(p, rng)
        if left >= 0 and rng.random() < a:
            drawn[left] = True
        assert drawn.sum() == 3
        hits += drawn
    assert np.allclose(hits / 6000, p, atol=0.03)
    p = rng.random(100_000)
    drawn, _, a = c.pivotal(p, rng)
    assert abs(drawn.sum() + a - p.sum()) < 1e-3


def rows(spark, counts, extra=()):
    data, i = [], 0
    for k, n in counts.items():
        data += [(i + j, k) for j in range(n)]
        i += n
    return c.usable(spark.createDataFrame([*data, *extra], "row_id long, category int"), "row_id", "category")


TARGETS = "target_set string, class_id int, share_permille int, min_rows int, sample_permille int, extra string"


def test_shares_floors_and_gaps(spark):
    r = rows(spark, {1: 6000, 2: 3000, 3: 900, 4: 100}, [(0, 1), (None, 1), (77777, None)])
    t = spark.createDataFrame([("a", 1, 400, 5, 500, ""), ("a", 2, 500, 5, 500, ""), ("a", 3, 99, 5, 500, ""), ("a", 4, 1, 50, 500, ""), ("b", 1, 100, 0, 1000, ""), ("b", 3, 900, 0, 1000, ""), ("b", 9, 0, 3, 1000, ""), ("c", None, 10, 1, 100, ""), ("a", 1, 400, 5, 500, "again")], TARGETS)
    report, plan = c.plan(r, t)
    by = {(x.target_set, x.class_id): x for x in report.collect()}
    assert by["a", 4].status == "floor" and abs(by["a", 4].expected - 50) < 1e-6
    assert by["b", 3].gap == 9000 - 900 and by["b", 3].status == "short" and by["b", 9].gap == 3 and by["c", None].gap == 10
    assert all(abs(by["a", k].expected - by["a", k].needed) < 1e-6 and by["a", k].gap == 0 for k in (1, 2, 3, 4))
    sample = c.draw(r, plan, block_rows=700)
    n = {(x.target_set, x.category): x["count"] for x in sample.groupBy("target_set", "category").count().collect()}
    for (s, k), x in by.items():
        assert n.get((s, k), 0) == min(x.needed, x.available)
    assert sample.count() == sample.select("target_set", "id").distinct().count()
    again = c.draw(r.repartition(3), plan, block_rows=700)
    assert again.exceptAll(sample).count() == 0 and sample.exceptAll(again).count() == 0


def test_sample_is_even_over_rows(spark):
    r = rows(spark, {1: 4000})
    _, plan = c.plan(r, spark.createDataFrame([("s", 1, 1000, 0, 250, "")], TARGETS))
    ids = np.array([x.id for x in c.draw(r, plan, block_rows=512).collect()])
    assert len(ids) == 1000 and abs(np.histogram(ids, 4, (0, 4000))[0] - 250).max() < 60


@pytest.mark.parametrize("counts", [{}, {5: 1}])
def test_empty_tables(spark, counts):
    r = rows(spark, counts)
    report, plan = c.plan(r, spark.createDataFrame([], TARGETS))
    assert report.count() == 0 and c.draw(r, plan).count() == 0
    some = c.plan(r, spark.createDataFrame([("s", 1, None, None, None, "")], TARGETS))[0].collect()
    assert len(some) == 1 and some[0].gap == 0 and some[0].expected == 0
    scarce = c.plan(r, spark.createDataFrame([("s", 1, 0, 900, 500, ""), ("s", 2, 0, 900, 500, "")], TARGETS))[0].collect()
    assert [x.gap for x in scarce] == [900, 900]


def test_margins_of_the_sample(spark):
    data = [(i, 1, "a" if i % 10 else "b") for i in range(2000)] + [(5000 + i, 2, "b" if i % 10 else None) for i in range(2000)]
    r = c.usable(spark.createDataFrame(data, "row_id long, category int, source string"), "row_id", "category", "source")
    report, rates = c.plan(r, spark.createDataFrame([("s", 1, 800, 0, 250, ""), ("s", 2, 200, 0, 250, "")], TARGETS))
    got = {(x.category, x.margin): x["count"] for x in c.draw(r, rates).join(r.select("id", "margin"), "id").groupBy("category", "margin").count().collect()}
    assert sum(n for (k, _), n in got.items() if k == 1) == 800 and sum(n for (k, _), n in got.items() if k == 2) == 200
    assert got[1, "b"] > 90  # a tenth of class 1, drawn more often, as b holds half of all rows
