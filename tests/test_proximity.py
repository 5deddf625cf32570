import math
import random

import pytest
from pyspark.sql import functions as F

from landloom.operators.proximity import containing_regions, near_counts, within_distance


def near(a, b, r, dist):
    return {(i, j) for i, x, y in a for j, u, v in b if None not in (x, y, u, v) and dist(x, y, u, v) <= r}


def pairs(df):
    return {(r.left_id, r.right_id) for r in df.collect()}


def test_plane_against_brute_force(spark):
    rng = random.Random(3)
    a = [(i, rng.uniform(-500, 500), rng.uniform(-500, 500)) for i in range(300)] + [(900, 0.0, 0.0), (901, None, 1.0), (902, float("nan"), 1.0)]
    b = [(i, rng.uniform(-500, 500), rng.uniform(-500, 500)) for i in range(300)] + [(903, 60.0, 0.0), (904, 60.0001, 0.0), (905, 1.0, None)]
    A, B = spark.createDataFrame(a, "i long, x double, y double"), spark.createDataFrame(b, "i long, x double, y double")
    got = pairs(within_distance(A, B, 60.0, "i", "i"))
    want = near([r for r in a if r[0] != 902], b, 60.0, lambda x, y, u, v: math.hypot(x - u, y - v))
    assert got == want
    assert (900, 903) in got and (900, 904) not in got


def haversine(x, y, u, v):
    h = math.sin(math.radians(v - y) / 2) ** 2 + math.cos(math.radians(y)) * math.cos(math.radians(v)) * math.sin(math.radians(u - x) / 2) ** 2
    return 2 * 6371008.8 * math.asin(min(1, math.sqrt(h)))


@pytest.mark.parametrize("lat", [0.0, 47.0, 84.9, -89.98])
def test_great_circle_against_brute_force(spark, lat):
    rng = random.Random(5)
    around = lambda: (rng.uniform(179.0, 181.0) if abs(lat) < 80 else rng.uniform(0, 360), max(-90.0, min(90.0, lat + rng.uniform(-0.5, 0.5))))
    wrap = lambda x: (x + 180) % 360 - 180
    a = [(i, wrap(p[0]), p[1]) for i, p in ((i, around()) for i in range(250))]
    b = [(i, wrap(p[0]), p[1]) for i, p in ((i, around()) for i in range(250))]
    A, B = spark.createDataFrame(a, "i long, x double, y double"), spark.createDataFrame(b, "i long, x double, y double")
    got = pairs(within_distance(A, B, 20_000.0, "i", "i", metric="haversine"))
    want = near(a, b, 20_000.0, haversine)
    assert want and got == want


def test_tags_repeats_clashing_columns_and_nulls(spark):
    a = spark.createDataFrame([(1, 0.0, 0.0, 7, "u"), (1, 0.0, 0.0, 7, "u"), (None, 1.0, 0.0, 7, "u"), (3, 2.0, 0.0, None, "u")], "id long, x double, y double, tag int, gx string")
    b = spark.createDataFrame([(1, 0.0, 1.0, 7, 1), (2, 0.0, 1.0, 8, 1), (2, 0.0, 1.0, 8, 1), (4, 0.0, 0.0, None, 1)], "id long, x double, y double, tag int, distance int")
    got = sorted(((r.left_id, r.right_id) for r in within_distance(a, b, 5.0, "id", "id", left_tag="tag", right_tag="tag").collect()), key=str)
    assert got == [(1, 2), (None, 2)]


def test_counts_equal_counted_pairs(spark):
    rng = random.Random(9)
    place = lambda: (rng.randint(0, 30) * 4.0, rng.randint(0, 30) * 4.0, rng.choice([1, 2, None]))
    a = [(rng.choice([i, i // 2, None]), *place()) for i in range(300)]
    b = [(i // 2, *place()) for i in range(300)]
    A, B = (spark.createDataFrame(v, "i long, x double, y double, tag int") for v in (a, b))
    want = within_distance(A, B, 10.0, "i", "i", left_tag="tag", right_tag="tag").groupBy("left_id").agg(F.countDistinct("right_id"), F.min("distance"))
    got = near_counts(A, B, 10.0, "i", "i", left_tag="tag", right_tag="tag")
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in want.collect()} and got.count() > 50


def test_empty(spark):
    a = spark.createDataFrame([], "id long, x double, y double")
    r = spark.createDataFrame([], "id long, ring array<struct<x double, y double>>")
    one = spark.createDataFrame([(1, 0.0, 0.0)], "id long, x double, y double")
    assert within_distance(a, one, 5.0, "id", "id").count() == 0 and within_distance(one, a, 5.0, "id", "id").count() == 0
    assert containing_regions(one, r, "id", "id").count() == 0


def inside(x, y, ring):
    odd = False
    for (x1, y1), (x0, y0) in zip(ring, [ring[-1], *ring[:-1]]):
        if (y1 > y) != (y0 > y) and x < (x0 - x1) * (y - y1) / (y0 - y1) + x1:
            odd = not odd
    return odd


def test_regions_of_all_sizes_against_brute_force(spark):
    rng = random.Random(9)
    rings = []
    for k in range(60):
        cx, cy, size, n = rng.uniform(-2000, 2000), rng.uniform(-2000, 2000), 10 ** rng.uniform(0.5, 3.8), rng.randint(3, 12)
        ring = [(cx + size * rng.uniform(0.2, 1) * math.cos(2 * math.pi * i / n), cy + size * rng.uniform(0.2, 1) * math.sin(2 * math.pi * i / n)) for i in range(n)]
        if k % 2:
            ring.reverse()
        if k % 3 == 0:
            ring.append(ring[0])
        if k % 5 == 0:
            ring.insert(2, ring[1])
        rings.append((k, ring))
    pts = [(i, rng.uniform(-3000, 3000), rng.uniform(-3000, 3000)) for i in range(500)]
    extra = [(100, None), (101, [(0.0, 0.0), (1.0, 1.0)]), (102, [(0.0, 0.0), None, (1.0, 1.0), (5.0, 5.0)]), (103, [])]
    P = spark.createDataFrame(pts + [(9000, None, 1.0)], "i long, x double, y double")
    R = spark.createDataFrame(rings + rings[:5] + extra, "i long, ring array<struct<x double, y double>>")
    got = {(r.left_id, r.right_id) for r in containing_regions(P, R, "i", "i").collect()}
    assert got == {(i, k) for i, x, y in pts for k, ring in rings if inside(x, y, ring)}


def test_hot_place(spark):
    """A third of all rows at one place: every row comes out, the site is probed once."""
    a = spark.range(3000).select(F.col("id"), F.when(F.col("id") < 1000, 5.0).otherwise(F.col("id") * 1000.0).alias("x"), F.lit(0.0).alias("y"))
    b = spark.createDataFrame([(1, 0.0, 0.0)], "id long, x double, y double")
    assert within_distance(a, b, 10.0, "id", "id").count() == 1000
