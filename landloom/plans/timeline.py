"""Catalogue: operators along time."""

from __future__ import annotations

from pyspark.sql import functions as F

from landloom.functions import scalars as sc
from landloom.operators import temporal as tp
from landloom.plans import base
from landloom.plans.tables import table

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_DENSE = f"""{base.CELLS}, dense AS (SELECT g.pixel_id, g.band, CAST(m AS INT) AS month_no, coalesce(c.v, 0) AS v FROM (SELECT DISTINCT pixel_id, band FROM cells) g CROSS JOIN range(1, 13) AS r(m) LEFT JOIN cells c ON c.pixel_id = g.pixel_id AND c.band = g.band AND c.month_no = m)"""


def _dense(spark, d):
    """Every month of each observed (pixel, band), 0 where nothing usable is."""
    c = base.cells(spark, d)
    by = c.groupBy("pixel_id", "band").agg(F.map_from_entries(F.collect_list(F.struct("month_no", "v"))).alias("m"))
    return by.select("pixel_id", "band", F.explode(F.sequence(F.lit(1), F.lit(12))).alias("month_no"), "m").select("pixel_id", "band", "month_no", F.coalesce(F.try_element_at("m", F.col("month_no")), F.lit(0)).alias("v"))


@query(f"""WITH {_DENSE} SELECT pixel_id, band, month_no, CASE WHEN v = 0 THEN coalesce(CASE WHEN p IS NULL THEN n WHEN n IS NULL THEN p ELSE (p + n) / 2.0::DOUBLE END, 0)::DOUBLE ELSE v::DOUBLE END AS filled
  FROM (SELECT *, lag(v) OVER w AS p, lead(v) OVER w AS n FROM dense WINDOW w AS (PARTITION BY pixel_id, band ORDER BY month_no))""")
def gap_fill(spark, d):
    return tp.gap_fill(_dense(spark, d), ["pixel_id", "band"], "month_no", "v").select("pixel_id", "band", "month_no", "filled")


@query(f"""WITH {_DENSE}, two AS (SELECT pixel_id, month_no, max(CASE WHEN band = 1 THEN v ELSE 0 END) AS b1, max(CASE WHEN band = 4 THEN v ELSE 0 END) AS b4 FROM dense GROUP BY ALL)
  SELECT pixel_id, month_no, b1 = 0 AND b4 = 0 AS restored, CAST(CASE WHEN b1 = 0 AND b4 = 0 THEN coalesce(floor(CASE WHEN p1 IS NULL THEN n1 WHEN n1 IS NULL THEN p1 ELSE (p1 + n1) / 2.0 END), 0) ELSE b1 END AS INT) AS b1,
    CAST(CASE WHEN b1 = 0 AND b4 = 0 THEN coalesce(floor(CASE WHEN p4 IS NULL THEN n4 WHEN n4 IS NULL THEN p4 ELSE (p4 + n4) / 2.0 END), 0) ELSE b4 END AS INT) AS b4
  FROM (SELECT *, lag(b1) OVER w AS p1, lead(b1) OVER w AS n1, lag(b4) OVER w AS p4, lead(b4) OVER w AS n4 FROM two WINDOW w AS (PARTITION BY pixel_id ORDER BY month_no))""")
def gap_fill_allband(spark, d):
    two = _dense(spark, d).groupBy("pixel_id", "month_no").agg(*[F.max(F.when(F.col("band") == b, F.col("v")).otherwise(0)).alias(f"b{b}") for b in (1, 4)])
    return tp.gap_fill_all_bands(two, ["pixel_id"], "month_no", ["b1", "b4"])


_CLEAR = "CASE WHEN NOT (cloud OR dn = 0) THEN dn END"


@query(f"""WITH {base.SERIES}, g AS (SELECT pix, year(t) AS yr, quarter(t) AS q, list_sort(list({_CLEAR}) FILTER ({_CLEAR} IS NOT NULL)) AS a, count({_CLEAR}) AS n, count(*) AS n_all FROM series GROUP BY ALL)
  SELECT CAST(pix AS VARCHAR) || CAST(yr AS VARCHAR) || '_' || CAST(q AS VARCHAR) AS season_id, pix, CASE WHEN n = 0 THEN 0.0 ELSE (a[CAST(floor((n - 1) * 0.25) AS INT) + 1] + a[CAST(ceil((n - 1) * 0.25) AS INT) + 1]) / 2.0 END AS background, n AS n_clear, 1.0::DOUBLE - n / n_all AS masked_share FROM g""")
def seasonal_background(spark, d):
    s = base.series(spark, d)
    clear = tp.apply_masks(F.col("dn"), F.col("cloud"))
    s = s.withColumns({"season_id": sc.season_id(F.col("pix").cast("string"), F.col("t")), "clear": clear})
    return tp.seasonal_background(s, ["season_id", "pix"], F.col("clear"))


@query(f"WITH {base.SERIES} SELECT pix, CAST(date_trunc('month', t) AS DATE) AS month, CAST(trunc(median({_CLEAR})) AS INT) AS composite FROM series GROUP BY ALL")
def median_composite(spark, d):
    s = base.series(spark, d).withColumn("month", F.trunc(F.to_date("t"), "MM"))
    return tp.median_composite(s, ["pix", "month"], tp.apply_masks(F.col("dn"), F.col("cloud")))


@query(f"WITH {base.SERIES} SELECT pix, CAST(date_trunc('week', t) AS DATE) AS week, CAST(trunc(coalesce(median({_CLEAR}), min(dn))) AS INT) AS composite FROM series GROUP BY ALL")
def median_min_fallback(spark, d):
    s = base.series(spark, d).withColumn("week", F.to_date(F.date_trunc("week", F.col("t"))))
    return tp.median_composite(s, ["pix", "week"], tp.apply_masks(F.col("dn"), F.col("cloud")), F.col("dn"))


@query(f"WITH {base.CELLS} SELECT pixel_id, band, CAST(count(*) AS BIGINT) AS n_valid, CASE WHEN count(*) >= 3 THEN 1 ELSE 0 END AS enough FROM cells GROUP BY ALL")
def valid_count(spark, d):
    return tp.valid_count(base.cells(spark, d), ["pixel_id", "band"], F.col("v") > 0)


@query(f"WITH {base.SERIES} SELECT pix, CAST(year(t) AS INT) AS yr, CAST(month(t) AS INT) AS mon, CAST(count(*) FILTER (NOT cloud) AS BIGINT) AS n_clear FROM series GROUP BY ROLLUP (pix, yr, mon)")
def valid_rollup(spark, d):
    s = base.series(spark, d).withColumns({"yr": F.year("t"), "mon": F.month("t")})
    return s.rollup("pix", "yr", "mon").agg(F.count_if(~F.col("cloud")).alias("n_clear"))


@query(f"""WITH {base.SERIES}, w AS (SELECT CAST(m AS DATE) AS month, CAST(m AS DATE) - INTERVAL 1 MONTH + INTERVAL 14 DAY AS a, CAST(m AS DATE) + INTERVAL 1 MONTH + INTERVAL 14 DAY AS b FROM generate_series(DATE '1994-12-01', DATE '2003-01-01', INTERVAL 1 MONTH) AS g(m))
  SELECT pix, month AS window_month, count(*) AS n, max(dn) AS top FROM series JOIN w ON CAST(t AS DATE) > w.a AND CAST(t AS DATE) < w.b GROUP BY ALL""")
def sliding_two_month(spark, d):
    # Each window opens after the 15th of the month before and ends before the 15th of the month after: a date lies in its own month's window and in one neighbour's.
    s = tp.assign_sliding(base.series(spark, d), "t")
    return s.groupBy("pix", "window_month").agg(F.count("*").alias("n"), F.max("dn").alias("top"))


@query("SELECT event_type, event_type || year(ts)::VARCHAR || '_' || quarter(ts)::VARCHAR AS season_id, count(*) AS n FROM events GROUP BY ALL")
def season_bucket(spark, d):
    return table(spark, d, "events").groupBy("event_type", sc.season_id(F.col("event_type"), F.col("ts")).alias("season_id")).agg(F.count("*").alias("n"))


@query("""SELECT CASE WHEN month(l_shipdate) IN (12, 1, 2) THEN 'DJF' WHEN month(l_shipdate) <= 5 THEN 'MAM' WHEN month(l_shipdate) <= 8 THEN 'JJA' ELSE 'SON' END || ' ' || year(l_shipdate)::VARCHAR AS season, CAST(floor((month(l_shipdate) % 12 + 3) / 3) AS INT) AS season_no, count(*) AS n FROM lineitem GROUP BY ALL""")
def season_met(spark, d):
    li = table(spark, d, "lineitem")
    return li.groupBy(sc.met_season(F.col("l_shipdate")).alias("season"), sc.season_number(F.col("l_shipdate")).alias("season_no")).agg(F.count("*").alias("n"))


@query(f"WITH {base.SCENES} SELECT orbit, CAST(date_trunc('month', ts) AS DATE) AS month, name, cloud FROM (SELECT *, row_number() OVER (PARTITION BY orbit, date_trunc('month', ts) ORDER BY ts, name) AS r FROM scenes) WHERE r = 1")
def first_per_month(spark, d):
    f = tp.first_per_month(base.scenes(spark, d), ["orbit"], "ts", ["name"])
    return f.select("orbit", F.trunc(F.to_date("ts"), "MM").alias("month"), "name", "cloud")


@query(f"""WITH {base.SCENES}, m AS (SELECT *, CAST(date_trunc('month', ts) AS DATE) AS own FROM scenes),
  c AS (SELECT m.*, CAST(own - to_months(CAST(k AS INT)) AS DATE) AS month, CAST(k AS INT) AS side FROM m, range(-1, 2) AS r(k)),
  d AS (SELECT *, count(*) OVER (PARTITION BY month) AS n_all, count(*) FILTER (side = 0) OVER (PARTITION BY month) AS n_own, row_number() OVER (PARTITION BY month, side ORDER BY name) AS k FROM c),
  e AS (SELECT *, row_number() OVER (PARTITION BY month ORDER BY CASE side WHEN 0 THEN 0 WHEN 1 THEN 2 * k - 1 ELSE 2 * k END, name) AS line FROM d WHERE n_own > 0),
  f AS (SELECT *, n_all <= 8 OR side = 0 OR line <= 8 AS pool FROM e),
  g AS (SELECT *, pool AND (n_all <= 8 OR row_number() OVER (PARTITION BY month ORDER BY CASE WHEN pool THEN 0 ELSE 1 END, cloud, name) <= 8) AS kept FROM f),
  h AS (SELECT *, max(CAST(kept AS INT)) OVER (PARTITION BY month, orbit) AS has, row_number() OVER (PARTITION BY month, orbit ORDER BY nodata, name) AS best FROM g)
  SELECT month, name, side, kept FROM h WHERE kept OR (has = 0 AND best = 1)""")
def image_selection(spark, d):
    return tp.select_images(base.scenes(spark, d), [], "name", "ts", "cloud", "orbit", "nodata")


@query(f"""WITH {base.SERIES}, q AS (SELECT pix, CASE WHEN month(t) BETWEEN 4 AND 9 THEN 's1' ELSE 's0' END AS s, year(t) AS yr, median(CASE WHEN NOT cloud AND dn > 60000 THEN dn END) AS v FROM series GROUP BY ALL)
  SELECT pix, CAST(yr AS INT) AS yr, coalesce(max(CASE WHEN s = 's0' THEN v END), max(CASE WHEN s = 's1' THEN v END)) AS s0, coalesce(max(CASE WHEN s = 's1' THEN v END), max(CASE WHEN s = 's0' THEN v END)) AS s1 FROM q GROUP BY ALL""")
def season_fallback(spark, d):
    s = base.series(spark, d).withColumns({"s": F.when(F.month("t").between(4, 9), "s1").otherwise("s0"), "yr": F.year("t")})
    q = s.groupBy("pix", "yr").agg(*[F.median(F.when((F.col("s") == k) & ~F.col("cloud") & (F.col("dn") > 60000), F.col("dn"))).alias(k) for k in ("s0", "s1")])
    return q.select("pix", "yr", F.coalesce("s0", "s1").alias("s0"), F.coalesce("s1", "s0").alias("s1"))


@query("SELECT l_suppkey, count(*) FILTER (l_shipdate >= TIMESTAMP '1996-01-01' AND l_shipdate <= TIMESTAMP '1996-12-31') AS n_inclusive, count(*) FILTER (l_shipdate > TIMESTAMP '1996-01-01' AND l_shipdate < TIMESTAMP '1996-12-31') AS n_exclusive FROM lineitem GROUP BY ALL")
def date_ranges(spark, d):
    t, a, b = F.col("l_shipdate"), F.lit("1996-01-01").cast("timestamp"), F.lit("1996-12-31").cast("timestamp")
    return table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count_if(t.between(a, b)).alias("n_inclusive"), F.count_if((t > a) & (t < b)).alias("n_exclusive"))


@query("SELECT o_orderstatus AS run, avg(m) AS mean_of_means, max(x) AS max_of_max, avg(l) AS mean_of_last FROM (SELECT o_orderstatus, o_custkey % 50 AS k, avg(o_totalprice) AS m, max(o_totalprice) AS x, arg_max(o_totalprice, o_orderkey) AS l FROM orders GROUP BY ALL) GROUP BY ALL")
def run_statistics(spark, d):
    o = table(spark, d, "orders").groupBy("o_orderstatus", (F.col("o_custkey") % 50).alias("k")).agg(F.avg("o_totalprice").alias("m"), F.max("o_totalprice").alias("x"), F.max_by("o_totalprice", "o_orderkey").alias("l"))
    return o.groupBy(F.col("o_orderstatus").alias("run")).agg(F.avg("m").alias("mean_of_means"), F.max("x").alias("max_of_max"), F.avg("l").alias("mean_of_last"))
