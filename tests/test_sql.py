from compare import DATA
from pyspark.sql import functions as F

from landloom import sql
from landloom.functions.indices import INDICES
from landloom.operators import vector


def test_sql_functions_equal_the_expressions(spark):
    sql.register(spark)
    sql.register_views(spark, str(DATA / "sf0.001"))
    got = spark.sql("SELECT pixel_id, month_no, ndvi(b4, b1) AS ndvi, evi2(b4, b1) AS evi2, savi(b4, b1) AS savi, gli(b1, b2, b3) AS gli, bsi(b1, b3, b4, b9) AS bsi, csi(b4, b9) AS csi, ndsi(b2, b9) AS ndsi FROM wide")
    w = spark.table("wide")
    need = {"ndvi": (1, 4), "evi2": (1, 4), "savi": (1, 4), "gli": (1, 2, 3), "bsi": (1, 3, 4, 9), "csi": (4, 9), "ndsi": (2, 9)}
    want = w.select("pixel_id", "month_no", *[INDICES[n]({k: F.col(f"b{k}") for k in ks}).alias(n) for n, ks in need.items()])
    a, b = ({(r.pixel_id, r.month_no): r for r in d.collect()} for d in (got, want))
    assert a.keys() == b.keys()
    for k in a:
        for n in need:
            assert (a[k][n] is None) == (b[k][n] is None) and (a[k][n] is None or abs(a[k][n] - b[k][n]) < 1e-12)
    assert spark.sql("SELECT tile_code(' t12gdv ') AS t, season_id('X', timestamp'2020-05-01') AS s").first() == ("12GDV", "X2020_2")


def test_rank_of_a_hot_class_uses_buckets(spark):
    df = spark.range(4000).select("id", F.when(F.col("id") < 2000, 1).when(F.col("id") < 3990, 2).alias("c"))
    d = vector.ranked(df, ["c"], F.floor(F.col("id") / 100), ["id"])
    rows = d.collect()
    assert len(rows) == 4000
    for c, first, n in ((1, 0, 2000), (2, 2000, 1990), (None, 3990, 10)):
        own = sorted((r.id, r._rank, r._size) for r in rows if r.c == c)
        assert own == [(first + k, k, n) for k in range(n)]
