import numpy as np
import pytest

from landloom.llm import cluster as c
from tests.llm.test_cluster import found, series


def pairs_at(rng, mad, missing, n, cells=72):
    """n pairs of records, each around a profile of its own, at about the mean absolute difference mad."""
    base = rng.integers(1000, 6000, (n, cells))
    d = rng.uniform(0, 2 * mad, (n, cells)) * rng.choice([-1, 1], (n, cells))
    a, b = base, base + d * (mad * 0.995 / np.abs(d).mean(1))[:, None]
    v = np.stack([a, b], 1).reshape(2 * n, cells).astype(np.int16)
    v[rng.random(v.shape) < missing] = 0
    return v


def all_alike(spark, v, **kw):
    members, _ = c.groups(series(spark, v), **kw)
    by: dict = {}
    for r in members.collect():
        by.setdefault(r.medoid, []).append(r.pixel_id)
    for ids in by.values():
        assert all(ok.all() for _, ok in c._alike_all(v[ids], v[ids], 200, 30))
    return sorted(sorted(x) for x in by.values())


@pytest.mark.parametrize("sizes", [[1, 2, 3], [40, 5, 2], [200]])
def test_every_pair_of_a_bucket_is_compared(sizes):
    import pyarrow as pa

    rng = np.random.default_rng(2)
    v = np.concatenate([np.clip(rng.integers(1000, 6000, 72) + rng.integers(-150, 151, (n, 72)), 1, 20000) for n in sizes]).astype(np.int16)
    bucket = np.repeat(np.arange(len(sizes)), sizes)
    sketch = c.sketches(v, 200)
    near = {(i, j) for i in range(len(v)) for j in range(i + 1, len(v)) if bucket[i] == bucket[j] and c.near_by_sketch(sketch[i], sketch[j], c._limits(72, 30))}
    table = pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(np.zeros(len(v), np.int8)), pa.array(np.arange(len(v))), c._binary(sketch.reshape(len(v), -1))], ["bucket", "part", "pixel_id", "sketch"])
    cut = len(v) // 2
    got = {tuple(x.values()) for b in c._compared(72, 30)(iter([table.slice(0, cut), table.slice(cut)])) for x in b.to_pylist()}
    assert got == near


@pytest.mark.parametrize("block", [c.BLOCK, 40, 7])
def test_hot_buckets_in_blocks_lose_no_pair(spark, block):
    rng = np.random.default_rng(6)
    v = np.clip(rng.integers(1000, 6000, 72) + rng.integers(-330, 331, (150, 72)), 1, 20000).astype(np.int16)
    near = c.near_by_sketch(c.sketches(v, 200)[:, None], c.sketches(v, 200)[None], c._limits(72, 30))
    rows, bands = c.plan_bands(len(v))
    h = c.band_hashes(v, 800, rows, bands)
    want = {(i, j) for i in range(len(v)) for j in range(i + 1, len(v)) if near[i, j] and (h[i] == h[j]).any()}
    got = {(r.a, r.b) for r in c.candidate_pairs(series(spark, v), 200, 30, block).collect()}
    assert got == want and len(want) > 1000


@pytest.mark.parametrize("mad", [150, 199])
@pytest.mark.parametrize("missing", [0, 0.1, 0.17, 0.25])
def test_recall_near_the_threshold(mad, missing):
    v = pairs_at(np.random.default_rng(3), mad, missing, 1500)
    a, b = v[::2], v[1::2]
    ok = c.alike(a, b)
    rows, bands = c.plan_bands(50_000)
    hit = (c.band_hashes(a, 800, rows, bands) == c.band_hashes(b, 800, rows, bands)).any(1) & c.near_by_sketch(c.sketches(a, 200), c.sketches(b, 200), c._limits(72, 30))
    assert hit[ok].mean() >= (0.985 if missing <= 0.1 else 0.9)


def test_recall_is_kept_at_larger_sizes():
    v = pairs_at(np.random.default_rng(3), 199, 0.1, 1500)
    ok = c.alike(v[::2], v[1::2])
    for n in (1_000_000, 100_000_000):
        rows, bands = c.plan_bands(n)
        hit = (c.band_hashes(v[::2], 800, rows, bands) == c.band_hashes(v[1::2], 800, rows, bands)).any(1)
        assert hit[ok].mean() >= 0.985


def test_pairs_far_apart_in_one_class(spark):
    rng = np.random.default_rng(4)
    v = pairs_at(rng, 190, 0.05, 150)
    want = {(2 * i, 2 * i + 1) for i in np.flatnonzero(c.alike(v[::2], v[1::2]))}
    got = found(spark, v)
    assert len(want & got) >= 0.97 * len(want) and got <= want


@pytest.mark.parametrize("hot", [c.HOT, 20])
def test_members_are_all_alike(spark, hot):
    base = np.full(72, 3000)
    v = np.array([base + 10 * k for k in range(60)])  # a chain of copies: members of a representative can be twice the threshold apart
    got = all_alike(spark, v, hot=hot)
    assert sum(map(len, got)) == 60 and len(got) <= 4


def test_hot_core_with_rows_beside_it(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(1500, 6000, 72)
    v = base + rng.integers(-40, 41, (200, 72))
    v[190:195] += 130
    v[195:] += 260
    got = all_alike(spark, v, hot=50)
    assert got == all_alike(spark, v) and max(map(len, got)) >= 190


def test_loose_hot_component_splits_around_medoids(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (4, 5), (5, 6), (3, 7), (9, 9)], "a long, b long")
    got = {r.rep: r.medoid for r in c.around_medoids(links.where("a <> b")).collect()}
    assert got == {1: 2, 2: 3, 3: 3, 4: 3, 5: 4, 6: 5, 7: 3}
    rng = np.random.default_rng(8)
    v = np.concatenate([3000 + 130 * k + rng.integers(-20, 21, (6, 72)) for k in range(12)]).astype(np.int16)  # a long chain of small groups
    got = all_alike(spark, v, hot=15)
    assert sum(map(len, got)) == len(v) and max(map(len, got)) >= 6
