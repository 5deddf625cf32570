"""Relations that the catalogue's queries read, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from landloom.operators.gapfill import Dating, monthly
from landloom.operators.records import month_of, with_category, with_place
from landloom.plans.sql_common import CATEGORY, MONTH
from landloom.plans.tables import table

BANDS = (1, 2, 3, 4, 9, 10)


def cells(spark: SparkSession, d: str) -> DataFrame:
    """(pixel_id, band, month_no, v): the latest usable value of each cell."""
    c = table(spark, d, "composites").where(F.col("pixel_id").isNotNull() & F.col("band_data").between(1, 20000))
    dating = Dating(c, "processed_at")
    g = c.groupBy("pixel_id", "band", month_of(F.col("time"), F.col("file_name")).alias("month_no")).agg(dating.value(F.max(dating.key(F.col("processed_at"), F.col("band_data")))).alias("v"))
    return g.where(F.col("month_no").isNotNull())


CELLS = f"""cells AS (SELECT pixel_id, band, month_no, max({{'at': coalesce(processed_at, TIMESTAMP '1900-01-01'), 'v': band_data}}).v AS v
  FROM (SELECT *, {MONTH} AS month_no FROM composites) WHERE pixel_id IS NOT NULL AND band_data BETWEEN 1 AND 20000 AND month_no IS NOT NULL GROUP BY ALL)"""


def wide(spark: SparkSession, d: str) -> DataFrame:
    """One row per pixel and month with a column per band."""
    m = monthly(table(spark, d, "composites"), BANDS, grouped=False).where(F.col("month_no").isNotNull())
    m = m.select("pixel_id", "month_no", *[F.col(f"v{i}").alias(f"b{b}") for i, b in enumerate(BANDS)])
    return m.where(F.coalesce(*[f"b{b}" for b in BANDS]).isNotNull())


WIDE = f"""{CELLS}, wide AS (SELECT pixel_id, month_no, {", ".join(f"max(CASE WHEN band = {b} THEN v END) AS b{b}" for b in BANDS)} FROM cells GROUP BY ALL)"""


def raster(spark: SparkSession, d: str) -> DataFrame:
    """A dense raster of 100 columns: (y, x, dn, cls, t)."""
    e = table(spark, d, "events")
    return e.select(
        F.floor(F.col("event_id") / 100).cast("int").alias("y"), (F.col("event_id") % 100).cast("int").alias("x"), F.floor(F.col("value") * 20).cast("int").alias("dn"), F.col("event_type").alias("cls"), F.col("ts").alias("t")
    )


RASTER = "raster AS (SELECT CAST(event_id // 100 AS INT) AS y, CAST(event_id % 100 AS INT) AS x, CAST(floor(value * 20) AS INT) AS dn, event_type AS cls, ts AS t FROM events)"


def series(spark: SparkSession, d: str) -> DataFrame:
    """Daily images of pixels: (pix, t, dn, cloud)."""
    li = table(spark, d, "lineitem")
    return li.groupBy(F.col("l_suppkey").alias("pix"), F.col("l_shipdate").alias("t")).agg(F.max("l_extendedprice").alias("dn"), F.bool_or(F.col("l_returnflag") == "R").alias("cloud"))


SERIES = "series AS (SELECT l_suppkey AS pix, l_shipdate AS t, max(l_extendedprice) AS dn, bool_or(l_returnflag = 'R') AS cloud FROM lineitem GROUP BY ALL)"


def bands12(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    return e.select(F.col("vec_id").alias("pix"), *[(F.lit(5000.0) * (F.lit(1.0) + F.col("embedding")[i].cast("double"))).alias(f"b{i + 1}") for i in range(12)], F.col("label").alias("cls"))


BANDS12 = "bands12 AS (SELECT vec_id AS pix, " + ", ".join(f"5000.0::DOUBLE * (1.0::DOUBLE + embedding[{i + 1}]::DOUBLE) AS b{i + 1}" for i in range(12)) + ", label AS cls FROM embeddings)"


def scenes(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return o.select(
        F.col("o_orderkey").alias("name"), F.col("o_orderdate").alias("ts"), F.col("o_totalprice").alias("cloud"), F.col("o_orderpriority").alias("orbit"), (F.col("o_custkey") % 100).alias("nodata")
    )


SCENES = "scenes AS (SELECT o_orderkey AS name, o_orderdate AS ts, o_totalprice AS cloud, o_orderpriority AS orbit, o_custkey % 100 AS nodata FROM orders)"


def labelled(spark: SparkSession, d: str) -> DataFrame:
    """Dataset rows, once per row_id, with category and place."""
    r = with_place(with_category(table(spark, d, "dataset"), table(spark, d, "legend")), table(spark, d, "tile_geometry"))
    return r.where(F.col("row_id").isNotNull()).groupBy("row_id").agg(*[F.min(c).alias(c) for c in ("category", "px", "py", "source", "split")])


LABELLED = f"""labelled AS (SELECT row_id, min(category) AS category, min(source) AS source, min(split) AS split FROM (SELECT r.*, {CATEGORY.format(r="r")} AS category FROM dataset r) WHERE row_id IS NOT NULL GROUP BY row_id)"""
