import datetime as dt

import pytest
from pyspark.sql import functions as F

from landloom.operators.gapfill import fill_grid, fill_series

SCHEMA = "pixel_id long, tile string, time date, band int, y int, x int, band_data int, file_name string, processed_at timestamp, month_no string, grp int, v0 int"


def cell(pixel, month, value, band=1, tile="12ABC", name=None, at=1, time=True):
    t = dt.date(2021, month, 1) if time else None
    return (pixel, tile, t, band, 0, 0, value, name, dt.datetime(2022, 1, at), "clash", 3, 4)


def grid(spark, rows, **kw):
    out = fill_grid(spark.createDataFrame(rows, SCHEMA), bands=(1, 2), **kw).collect()
    return {(r.pixel_id, r.band, r.month_no): r for r in out}


def test_interpolates_carries_and_takes_the_group(spark):
    g = grid(spark, [cell(1, 3, 100), cell(1, 6, 400), cell(2, 1, 50), cell(2, 2, 70, band=2), cell(3, 2, 90, band=2, tile=" t12abc ")], max_carry=2)
    assert len(g) == 3 * 24
    assert (g[1, 1, 4].value, g[1, 1, 4].method, g[1, 1, 4].distance) == (200.0, "interpolated", 1)
    assert (g[1, 1, 1].value, g[1, 1, 1].method, g[1, 1, 1].distance) == (100.0, "carried", 2)
    assert g[1, 1, 3].method == "observed" and not g[1, 1, 3].filled and g[1, 1, 3].distance == 0
    assert (g[1, 2, 2].value, g[1, 2, 2].method, g[1, 2, 2].distance) == (80.0, "group", None)
    assert (g[1, 1, 9].value, g[1, 1, 9].method) == ((50 + 100 + 400) / 3, "group")


def test_unusable_and_late_values(spark):
    rows = [cell(1, 1, 0), cell(1, 2, -9999), cell(1, 3, 65535), cell(1, 4, None), cell(1, 5, 10, at=1), cell(1, 5, 20, at=3), cell(1, 5, 0, at=9), cell(1, 6, 7, name="m_T12ABC2021_06.tif", time=False), cell(1, 7, 8, name="nonsense", time=False), cell(None, 1, 5)]
    g = grid(spark, rows)
    assert len(g) == 24
    assert [m for m in range(1, 13) if not g[1, 1, m].filled] == [5, 6]
    assert g[1, 1, 5].value == 20 and g[1, 1, 6].value == 7


def test_pixel_without_any_value_or_tile(spark):
    g = grid(spark, [cell(1, 1, 0, tile=None), cell(2, 1, 40)])
    assert g[1, 1, 1].value == 40 and g[1, 1, 1].method == "group"
    assert g[1, 2, 1].value is None and g[1, 2, 1].method == "none" and g[1, 2, 1].filled
    assert all(r.method == "none" for r in grid(spark, [cell(1, 1, 0)]).values())


def test_empty(spark):
    assert fill_grid(spark.createDataFrame([], SCHEMA)).count() == 0


def test_wide_gap_is_not_interpolated(spark):
    g = grid(spark, [cell(1, 1, 100), cell(1, 12, 200)], max_gap=6, max_carry=3)
    assert g[1, 1, 3].method == "carried" and g[1, 1, 3].value == 100 and g[1, 1, 6].method == "group"


@pytest.mark.parametrize("block", [None, 2.0, 100.0])
def test_series_in_blocks(spark, block):
    rows = [("a", 1.0, 10.0, "x"), ("a", 2.0, None, None), ("a", 7.0, float("nan"), None), ("a", 9.0, 26.0, "y"), ("a", 11.0, None, None), (None, 1.0, None, "z"), (None, 3.0, 4.0, None), ("b", None, None, None), ("c", 1.0, None, None)]
    df = spark.createDataFrame(rows, "e string, t double, v double, c string").withColumn("extra", F.lit(1))
    out = {(r.e, r.t): r for r in fill_series(df, ["e"], "t", ["v"], ["c"], max_gap=7.0, block=block).collect()}
    assert (out["a", 2.0].v, out["a", 2.0].v_method, out["a", 2.0].v_distance) == (12.0, "interpolated", 1.0)
    assert out["a", 7.0].v == 22.0 and out["a", 7.0].c == "y"
    assert (out["a", 11.0].v, out["a", 11.0].v_method, out["a", 11.0].c_method) == (26.0, "carried", "carried")
    assert out[None, 1.0].v == 4.0 and out[None, 3.0].c == "z"
    assert out["b", None].v_method == "none" and out["c", 1.0].c_method == "none"
    assert out["a", 1.0].v_method == "observed" and out["a", 1.0].extra == 1


def test_series_gap_limit_empty_and_clashes(spark):
    df = spark.createDataFrame([("a", 1.0, 1.0), ("a", 5.0, None)], "e string, t double, v double")
    assert fill_series(df, ["e"], "t", ["v"], max_gap=2).where("t = 5").first().v_method == "none"
    assert fill_series(df.limit(0), ["e"], "t", ["v"], block=3).count() == 0
    with pytest.raises(ValueError):
        fill_series(df.withColumn("v_method", F.lit(1)), ["e"], "t", ["v"])
