"""Catalogue: whole steps over the composites and the dataset, and a stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from landloom.operators import pipelines, vector
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


def _points(spark, d):
    r = base.labelled(spark, d).where("category is not null and px is not null")
    return r.select("row_id", F.col("category").alias("class_id"), F.lit(None).cast("string").alias("split"), (F.col("px").cast("bigint") % 5).cast("int").alias("k"), "source")


_U = f"""{base.LABELLED}, pl AS (SELECT l.row_id, l.category AS class_id, l.source FROM labelled l WHERE category IS NOT NULL AND row_id IN (SELECT r.row_id FROM dataset r JOIN tile_geometry g ON g.tile = CASE WHEN length(upper(trim(r.tile))) = 6 AND starts_with(upper(trim(r.tile)), 'T') THEN substr(upper(trim(r.tile)), 2) ELSE upper(trim(r.tile)) END WHERE r.x IS NOT NULL AND r.y IS NOT NULL AND r.pixel_m IS NOT NULL)),
  pts AS (SELECT row_id, class_id FROM pl WHERE source = 'field_survey'), smp AS (SELECT row_id, class_id FROM pl WHERE source = 'lcmap_points'),
  both_ AS (SELECT class_id FROM pts INTERSECT SELECT class_id FROM smp)"""


def _two(spark, d):
    p = _points(spark, d)
    return (p.where(F.col("source") == s).select("row_id", "class_id", "split") for s in ("field_survey", "lcmap_points"))


@query(f"WITH {_U} SELECT row_id, class_id, 'test' AS split FROM pts SEMI JOIN both_ USING (class_id) UNION ALL SELECT row_id, class_id, 'train' FROM smp SEMI JOIN both_ USING (class_id)")
def dataset_full(spark, d):
    a, b = _two(spark, d)
    return pipelines.build_dataset(a, b, "fullLC", F.col("row_id"))


_R = "(row_id * 2654435761) % 1000003"


@query(f"""WITH {_U}, a AS (SELECT row_id, class_id FROM pts SEMI JOIN both_ USING (class_id)), b AS (SELECT row_id, class_id FROM smp SEMI JOIN both_ USING (class_id)), h AS (SELECT class_id, count(*) AS have FROM a GROUP BY class_id), z AS (SELECT class_id, count(*) AS n FROM b GROUP BY class_id),
  r AS (SELECT b.*, row_number() OVER (PARTITION BY class_id ORDER BY {_R}, row_id) - 1 AS r, (SELECT max(have) FROM h) - have AS need, n FROM b JOIN h USING (class_id) JOIN z USING (class_id)),
  e AS (SELECT row_id, class_id, unnest(range(0, CAST(ceil((need - r) / n::DOUBLE) AS BIGINT))) AS k FROM r WHERE r < need) SELECT row_id, class_id FROM a UNION ALL SELECT row_id, class_id FROM e""")
def dataset_enhanced(spark, d):
    a, b = _two(spark, d)
    return pipelines.build_dataset(a, b, "enhanced", vector.pseudo_random(F.col("row_id"))).select("row_id", "class_id")


@query(f"""WITH {base.RASTER}, c AS (SELECT y, x, dn // 2000 AS class_id FROM raster), k AS (SELECT *, lag(class_id) OVER (PARTITION BY x ORDER BY y) AS up, lag(class_id) OVER (PARTITION BY y ORDER BY x) AS lf FROM c),
  e AS (SELECT y, x, class_id FROM k WHERE coalesce(up = class_id, true) AND coalesce(lf = class_id, true)), r AS (SELECT *, row_number() OVER (PARTITION BY class_id ORDER BY y, x) - 1 AS rn, count(*) OVER (PARTITION BY class_id) AS n FROM e)
  SELECT y, x, CAST(class_id AS INT) AS class_id, 'train' AS split FROM r WHERE rn % greatest(1, n // least(40, n)) = 0 AND rn // greatest(1, n // least(40, n)) < least(40, n)""")
def sampled_points(spark, d):
    lc = base.raster(spark, d).select("y", "x", F.floor(F.col("dn") / 2000).cast("int").alias("class_id"))
    none = lc.where("false").select("y", "x")
    return pipelines.sampled_points(lc, none, 40, table(spark, d, "legend"), eroded=True).select("y", "x", "class_id", "split")


@query(f"""WITH {base.RASTER}, c AS (SELECT y // 10 AS tile, y, x, dn // 2000 AS class_id FROM raster), r AS (SELECT *, row_number() OVER (PARTITION BY tile, class_id ORDER BY y, x) - 1 AS rn, count(*) OVER (PARTITION BY tile, class_id) AS n FROM c WHERE (x * 7 + y) % 50 <> 0)
  SELECT CAST(tile AS INT) AS tile, y, x, CAST(class_id AS INT) AS class_id FROM r WHERE rn % greatest(1, n // least(7, n)) = 0 AND rn // greatest(1, n // least(7, n)) < least(7, n)""")
def sampled_points_by_tile(spark, d):
    """Samples of several tiles in one table, without known pixels: each tile's classes are sampled for themselves."""
    lc = base.raster(spark, d).select(F.floor(F.col("y") / 10).cast("int").alias("tile"), "y", "x", F.floor(F.col("dn") / 2000).cast("int").alias("class_id"))
    known = lc.where("(x * 7 + y) % 50 = 0").select("tile", "y", "x")
    return pipelines.sampled_points(lc, known, 7, table(spark, d, "legend"), tile="tile").select("tile", "y", "x", "class_id")


@query(f"""WITH l AS (SELECT internal_code, min(lc_code) AS code, min(description) AS name FROM legend GROUP BY ALL)
  SELECT vec_id AS pix, code AS ground_truth_index, name AS ground_truth_label, 'test' AS split, {', '.join(f'embedding[{m * 4 + b + 1}]::DOUBLE AS band_{b + 1}_month_{m + 1}' for m in range(3) for b in range(4))},
  {', '.join(f'embedding[{13 + i}]::DOUBLE AS {n}' for i, n in enumerate(('GLCMcontrast', 'GLCMdissimilarity', 'GLCMhomogeneity', 'GLCMenergy', 'GLCMcorrelation', 'GLCMASM')))} FROM embeddings LEFT JOIN l ON l.internal_code = label""")
def convert_legacy(spark, d):
    """The embeddings read as an old training matrix of four bands, three months and the six texture columns."""
    old = table(spark, d, "embeddings").select(F.col("vec_id").alias("pix"), F.transform("embedding", lambda v: v.cast("double")).alias("features"), "label")
    return pipelines.convert_legacy(old, table(spark, d, "legend"), 4, 3)


def _scenes(spark, d):
    """Images of a strip of pixels, one per ship date of each supplier."""
    s = base.series(spark, d)
    return s.select(F.lit("T").alias("tile"), F.trunc(F.to_date("t"), "MM").cast("timestamp").alias("time"), F.floor(F.col("pix") / 10).cast("int").alias("y"), (F.col("pix") % 10).cast("int").alias("x"), (F.col("dn") / 10).cast("int").alias("blue"), "cloud").groupBy("tile", "time", "y", "x").agg(
        F.max("blue").alias("blue"), F.bool_or("cloud").alias("cloud")
    ).withColumns({"nir": F.col("blue") + 300, "swir": F.col("blue") + F.col("x") * 20, "shadow": F.col("blue") < 3000})


@query()
def masks_refinement(spark, d):
    return pipelines.masks_refinement(_scenes(spark, d)).select("tile", "time", "y", "x", "cloud_refined", "shadow_refined")


@query(f"""WITH {base.SERIES}, sc AS (SELECT CAST(date_trunc('month', t) AS DATE) AS m, CAST(pix // 10 AS INT) AS y, CAST(pix % 10 AS INT) AS x, max(CAST(trunc(dn / 10) AS INT)) AS blue, bool_or(cloud) AS cloud FROM series GROUP BY ALL),
  w AS (SELECT m AS window_month, y, x, blue, cloud FROM sc UNION ALL SELECT CAST(m - INTERVAL 1 MONTH AS DATE), y, x, blue, cloud FROM sc)
  SELECT 'T' AS tile, window_month, y, x, CAST(trunc(coalesce(median(CASE WHEN NOT cloud AND blue >= 3000 THEN blue END), min(blue))) AS INT) AS blue FROM w GROUP BY ALL""")
def monthly_composites(spark, d):
    return pipelines.monthly_composites(_scenes(spark, d), ["blue"], fallback=True)


_MARKED = f"""{base.RASTER}, m AS (SELECT CAST(y // 20 AS INT) AS scene, y, x, dn, dn % 12 AS scl, (dn * 37) % 65536 AS qa FROM raster)"""


def _marked(spark, d):
    return base.raster(spark, d).select(F.floor(F.col("y") / 20).cast("int").alias("scene"), "y", "x", "dn", (F.col("dn") % 12).alias("scl"), ((F.col("dn") * 37) % 65536).alias("qa"))


@query(f"""WITH {_MARKED}, b AS (SELECT *, CAST(scl IN (8, 9, 10) AS INT) AS c, CAST(scl = 3 AS INT) AS s FROM m)
  SELECT a.scene, a.y, a.x, max(b.c) = 1 AS cloud, max(b.s) = 1 AS shadow FROM b a JOIN b ON b.scene = a.scene AND b.y BETWEEN a.y - 1 AND a.y + 1 AND b.x BETWEEN a.x - 1 AND a.x + 1 GROUP BY ALL""")
def mask_extract(spark, d):
    """Cloud and shadow masks of five scenes from their classification band, grown by a pixel."""
    return pipelines.extract_masks(_marked(spark, d), "scl", "scl", 1)


@query(f"""WITH {_MARKED}, q AS (SELECT *, qa & 1 = 1 AS fill, (qa >> 1) & 1 = 1 OR (qa >> 3) & 1 = 1 OR ((qa >> 14) & 1 = 1 AND (qa >> 15) & 1 = 1) AS cl, (qa >> 4) & 1 = 1 OR ((qa >> 10) & 1 = 1 AND (qa >> 11) & 1 = 1) AS sh, (qa >> 5) & 1 = 1 AS sn FROM m)
  SELECT scene, y, x, NOT fill AND cl AS cloud, NOT fill AND NOT cl AND sh AS shadow, NOT fill AND NOT cl AND NOT sh AND sn AS snow FROM q""")
def mask_extract_landsat(spark, d):
    return pipelines.extract_masks(_marked(spark, d), "qa", "qa")


@query(f"""WITH {_MARKED}, t AS (SELECT scene, scl IN (8, 9, 10) AS pc, scl = 3 AS ps, dn % 4 IN (1, 2) AS tc, dn % 4 = 3 AS ts FROM m WHERE dn % 5 <> 0), l AS (SELECT scene, 'cloud' AS kind, pc AS p, tc AS t FROM t UNION ALL SELECT scene, 'shadow', ps, ts FROM t),
  g AS (SELECT scene, kind, count_if(p AND t)::DOUBLE AS tp, count_if(p)::DOUBLE AS np, count_if(t)::DOUBLE AS nt, count_if(p = t)::DOUBLE AS ok, count(*) AS n FROM l GROUP BY ALL)
  SELECT scene, kind, CASE WHEN np > 0 THEN tp / np ELSE 0 END AS precision, CASE WHEN nt > 0 THEN tp / nt ELSE 0 END AS recall, CASE WHEN np + nt > 0 THEN 2 * tp / (np + nt) ELSE 0 END AS f1, ok / n AS accuracy, n FROM g""")
def mask_scores(spark, d):
    """Masks of five scenes against labelled patches that lack a fifth of the pixels."""
    m = _marked(spark, d)
    truth = m.where("dn % 5 <> 0").select("scene", "y", "x", (F.col("dn") % 4).alias("cls"))
    return pipelines.mask_scores(pipelines.extract_masks(m, "scl", "scl"), truth, ["scene"])


_SERIES = f"""{base.SERIES}, sc AS (SELECT CAST(date_trunc('month', t) AS DATE) AS m, CAST(pix // 10 AS INT) AS y, CAST(pix % 10 AS INT) AS x, max(CAST(trunc(dn / 10) AS INT)) AS blue, bool_or(cloud) AS cloud FROM series GROUP BY ALL),
  g AS (SELECT *, greatest(max(bad) OVER a, max(bad) OVER b) AS grown FROM (SELECT *, CAST(cloud OR blue < 3000 AS INT) AS bad FROM sc)
    WINDOW a AS (PARTITION BY m, y ORDER BY x RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING), b AS (PARTITION BY m, x ORDER BY y RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING))"""


@query(f"""WITH {_SERIES} SELECT 'T' AS tile, year(m)::VARCHAR || '_' || quarter(m)::VARCHAR AS "window", y, x, CAST(trunc(median(CASE WHEN grown = 0 AND blue <> 0 AND blue <= 9000 THEN blue END)) AS INT) AS blue, count(CASE WHEN grown = 0 AND blue <> 0 THEN 1 END) AS n_valid FROM g GROUP BY ALL""")
def composites_by_season(spark, d):
    """Seasonal medians as for Landsat: the masks' union dilated, stripes' gaps left out."""
    s = _scenes(spark, d).withColumn("scene", F.col("time"))
    return pipelines.composites(s, ["blue"], "season", grow=1, most=9000)


@query(f"""WITH {_SERIES} SELECT 'T' AS tile, w AS "window", y, x, CAST(trunc(coalesce(median(CASE WHEN bad = 0 AND blue <> 0 THEN blue END), min(nullif(blue, 0)))) AS INT) AS blue, count(CASE WHEN bad = 0 AND blue <> 0 THEN 1 END) AS n_valid
  FROM (SELECT *, m AS w FROM g UNION ALL SELECT *, CAST(m - INTERVAL 1 MONTH AS DATE) FROM g) GROUP BY ALL""")
def composites_by_month(spark, d):
    """Sliding two-month medians with the least raw value where no image is clear."""
    s = _scenes(spark, d).withColumn("scene", F.col("time"))
    return pipelines.composites(s, ["blue"], "month", fallback=True)


@query(f"""WITH {_MARKED} SELECT scene, min(y) AS top, count(*) AS n FROM m GROUP BY scene""")
def paired_masks(spark, d):
    """Scenes joined with one mask each by scene."""
    m = _marked(spark, d)
    masks_of = m.groupBy("scene").agg(F.min("y").alias("top"))
    return pipelines.paired(m, masks_of).groupBy("scene").agg(F.first("top").alias("top"), F.count("*").alias("n"))


@query()
def cloud_restoration(spark, d):
    r = base.raster(spark, d)
    cube = r.select(F.lit("T").alias("tile"), F.explode(F.sequence(F.lit(1), F.lit(3))).alias("month"), "y", "x", "dn").select("tile", "month", "y", "x", F.when((F.col("dn") + F.col("month")) % 4 == 0, 0).otherwise(F.col("dn")).alias("blue"), (F.col("dn") + 100).alias("nir"))
    dem = r.select(F.lit("T").alias("tile"), "y", "x", (F.col("dn") / 400).alias("elevation"))
    return pipelines.cloud_restoration(cube, dem, ["blue", "nir"], "blue", "nir", "nir")


def _stack() -> str:
    from landloom.plans.local import _INDEX_SQL

    cells = f"g AS (SELECT *, CAST(pix // 25 AS INT) AS y, CAST(pix % 25 AS INT) AS x FROM bands12), i AS (SELECT pix, cls, y, x, {', '.join(f'{v} AS {k}' for k, v in _INDEX_SQL.items())} FROM g)"
    # Borders repeat: a line's end pixel stands in for the one beyond it.
    rows = "h AS (SELECT *, coalesce(lag(ndvi) OVER a, ndvi) AS l, coalesce(lead(ndvi) OVER a, ndvi) AS r FROM i WINDOW a AS (PARTITION BY y ORDER BY x)), e AS (SELECT *, r - l AS dx, l + 2 * ndvi + r AS sm FROM h)"
    cols = "s AS (SELECT *, coalesce(lag(dx) OVER b, dx) + 2 * dx + coalesce(lead(dx) OVER b, dx) AS sx, coalesce(lead(sm) OVER b, sm) - coalesce(lag(sm) OVER b, sm) AS sy FROM e WINDOW b AS (PARTITION BY x ORDER BY y))"
    return f"WITH {base.BANDS12}, {cells}, {rows}, {cols} SELECT pix, cls, y, x, {', '.join(f'round({k}, 6) AS {k}' for k in _INDEX_SQL)}, round(sqrt(sx * sx + sy * sy), 6) AS sobel FROM s"


@query(_stack())
def feature_stack(spark, d):
    """Indices of a synthetic grid of embeddings: twelve bands, thirteen indices and the Sobel magnitude."""
    b = base.bands12(spark, d).withColumns({"y": F.floor(F.col("pix") / 25).cast("int"), "x": (F.col("pix") % 25).cast("int")})
    out = pipelines.generate_features(b, [], {k: f"b{k}" for k in range(1, 13)}).drop(*[f"b{k}" for k in range(1, 13)])
    return out.select(*[F.round(c, 6).alias(c) if c not in ("pix", "cls", "y", "x") else c for c in out.columns])


@query()
def texture_stack(spark, d):
    r = base.raster(spark, d)
    return pipelines.texture_features(r, [], "dn", r.agg(F.max("y") + 1).first()[0], 100)


@query("""WITH e AS (SELECT DISTINCT ON (event_id) event_type, ts, value FROM events), k AS (SELECT *, CAST(floor(epoch(ts) / 86400.0 / 30) AS BIGINT) AS n FROM e), w AS (SELECT event_type, unnest([n - 1, n]) AS n, value FROM k)
  SELECT event_type, CAST(DATE '1970-01-01' + CAST(30 * n AS INT) AS DATE) AS opens, CAST(DATE '1970-01-01' + CAST(30 * n + 60 AS INT) AS DATE) AS closes, round(avg(CASE WHEN value <> 0 THEN value END), 6) AS mean_value, count(CASE WHEN value <> 0 THEN 1 END) AS n_valid FROM w GROUP BY ALL""")
def stream_composites(spark, d):
    """The events as a file stream of images: duplicates within the watermark go, 60-day windows every 30 days. Runs to the end of the input and reads the sink back;
    windows that the watermark has not closed by then come from the same aggregate over the table."""
    import uuid

    from landloom.session import checkpoint_dir
    from landloom.streaming.composites import deduplicated, windowed_mean

    place = f"{checkpoint_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    schema = table(spark, d, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d).withColumn("ts", F.col("ts").cast("timestamp"))
    means = windowed_mean(deduplicated(stream, ["event_id"], "ts"), ["event_type"], "ts", "value")
    flat = means.select("event_type", F.col("window.start").alias("opens"), F.col("window.end").alias("closes"), "mean_value", "n_valid")
    q = flat.writeStream.format("parquet").option("path", f"{place}/out").option("checkpointLocation", f"{place}/state").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    closed = spark.read.schema(flat.schema).parquet(f"{place}/out")
    rows = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")).dropDuplicates(["event_id"])
    whole = windowed_mean(rows, ["event_type"], "ts", "value").select("event_type", F.col("window.start").alias("opens"), F.col("window.end").alias("closes"), "mean_value", "n_valid")
    done = closed.select(F.col("event_type").alias("t"), F.col("opens").alias("o"))
    both = closed.unionByName(whole.join(done, F.col("event_type").eqNullSafe(F.col("t")) & (F.col("opens") == F.col("o")), "left_anti"))
    return both.select("event_type", F.to_date("opens").alias("opens"), F.to_date("closes").alias("closes"), F.round("mean_value", 6).alias("mean_value"), "n_valid")
