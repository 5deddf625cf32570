import datetime as dt

from pyspark.sql import functions as F

from landloom.operators import records as r


def test_category_by_code_then_internal_code_then_name(spark):
    legend = spark.createDataFrame([(1, 110, "Dense woodland"), (2, 120, "Open, woodland"), (110, 5, "Odd"), (None, None, None), (2, 120, "Open woodland")], "internal_code int, lc_code int, description string")
    rows = [(1, 110, "x"), (2, 1, "x"), (3, 7, " dense--WOODLAND 9"), (4, None, "open woodland"), (5, None, None), (6, 9, ""), (7, 5, "Dense woodland")]
    df = spark.createDataFrame(rows, "i int, class_id int, class string").withColumn("internal_code", F.lit("clash")).withColumn("lc_code", F.lit("clash"))
    got = {x.i: x.category for x in r.with_category(df, legend).collect()}
    assert got == {1: 110, 2: 110, 3: 110, 4: 120, 5: None, 6: None, 7: 5}


def test_place(spark):
    tiles = spark.createDataFrame([("12ABC", 100.0, 900.0), ("12ABC", 100.0, 900.0), (None, 0.0, 0.0)], "tile string, ul_x double, ul_y double")
    rows = [(1, " t12abc ", 2, 3, None, 10), (2, "12ABC", 2, 3, "yx", 10), (3, "T12ABX", 1, 1, "xy", 10), (4, None, 1, 1, "xy", 10), (5, "12ABC", None, 1, "xy", 10), (6, "12ABC", 1, 1, "xy", None)]
    df = spark.createDataFrame(rows, "i int, tile string, x int, y int, axis_order string, pixel_m int")
    got = {x.i: (x.px, x.py) for x in r.with_place(df, tiles).collect()}
    assert got == {1: (125.0, 865.0), 2: (135.0, 875.0), 3: (None, None), 4: (None, None), 5: (None, None), 6: (None, None)}


def test_splits_and_months(spark):
    df = spark.createDataFrame([(" TRAIN_v2 ",), ("Hold-out",), ("eval",), ("unused",), ("",), (None,), ("t",)], "s string")
    assert [x[0] for x in df.select(r.split_kind(F.col("s"))).collect()] == ["train", "eval", "eval", None, None, None, None]
    m = spark.createDataFrame([(dt.date(2021, 3, 1), None), (None, "m_T12ABC2021_04.tif"), (None, "m_T12ABC2021_12.tif"), (None, "m.tif"), (None, None)], "t date, f string")
    assert [x[0] for x in m.select(r.month_of(F.col("t"), F.col("f"))).collect()] == [3, 4, 12, None, None]
