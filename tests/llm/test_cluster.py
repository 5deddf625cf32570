import numpy as np
from pyspark.sql import functions as F

from landloom.llm import cluster as c


def series(spark, v, ids=None):
    ids = range(len(v)) if ids is None else ids
    return spark.createDataFrame([(int(i), bytearray(x.astype("<i2").tobytes())) for i, x in zip(ids, v)], "pixel_id long, cells binary")


def planted(rng, sizes, noise=60, missing=0.08, cells=72):
    v, label = [], []
    for g, n in enumerate(sizes):
        base = rng.integers(1000, 6000, cells)
        for _ in range(n):
            x = np.clip(base + rng.integers(-noise, noise + 1, cells), 1, 20000)
            x[rng.random(cells) < missing] = 0
            v.append(x)
            label.append(g)
    return np.array(v), np.array(label)


def truth(v):
    n = len(v)
    out = {}
    for i in range(n):
        j = np.flatnonzero(c.alike(np.repeat(v[i : i + 1], n, 0), v))
        out[i] = int(j.min()) if len(j) else i
    return {(lo, i) for i, lo in out.items() if lo != i}


def found(spark, v, **kw):
    members, _ = c.groups(series(spark, v), **kw)
    return {(r.least, r.pixel_id) for r in members.where("pixel_id <> least").collect()}


def test_recall_and_precision_against_brute_force(spark):
    rng = np.random.default_rng(7)
    v, _ = planted(rng, [400, 60, 20, *[3] * 30, *[2] * 60, *[1] * 300])
    v = v[rng.permutation(len(v))]
    want, got = truth(v), found(spark, v)
    assert len(want & got) / len(want) >= 0.98 and len(got - want) <= 0.02 * len(want)


def test_hot_group_of_copies(spark):
    rng = np.random.default_rng(8)
    v, _ = planted(rng, [1] * 400)
    v[:200] = v[0]
    got = found(spark, v)
    assert {(0, i) for i in range(1, 200)} <= got


def test_few_shared_cells_empty_and_alone(spark):
    rng = np.random.default_rng(9)
    v, _ = planted(rng, [2], missing=0)
    v[0, 29:] = 0
    assert found(spark, v) == set()
    assert not c.alike(v[:1], v[1:])[0]
    v[0, 29] = v[1, 29]
    assert c.alike(v[:1], v[1:])[0]
    assert found(spark, v[:1]) == set()
    members, cells = c.groups(series(spark, v[:0]))
    assert members.count() == 0 and c.typical(members, cells).count() == 0


def test_loose_component_splits_around_medoids(spark):
    base = np.full(72, 3000)
    v = np.array([base + 150 * k for k in range(5)])  # a chain: neighbours are alike, ends are not
    members, _ = c.groups(series(spark, v), threshold=200)
    for r in members.collect():
        assert bool(c.alike(v[r.pixel_id][None], v[r.medoid][None], 200, 30)[0])


def test_components(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, k) for k in range(101, 160)] + [(7, 7), (200, 201), (201, 200)]
    got = {r.node: r.label for r in c.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(51)) and all(got[k] == 100 for k in range(100, 160)) and got[201] == got[200] == 200
    assert c.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_typical_members(spark):
    base = np.full(72, 3000)
    v = np.array([base, base + 10, base + 20, base + 30, base + 40])
    members, cells = c.groups(series(spark, v))
    r = c.typical(members, cells, 2).orderBy("rank").collect()
    assert [x["size"] for x in r] == [5, 5] and r[0].distance == 0 and r[1].distance == 10


def test_jaccard():
    a = np.array([[600, 0, 1700, 100]])
    b = np.array([[700, 100, 1400, 0]])
    assert c.token_jaccard(a, b)[0] == 1 / 5
