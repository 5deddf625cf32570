"""Catalogue: joins, sampling, dataset building, statistics, reports, parameter grids."""

from __future__ import annotations

from pyspark.sql import functions as F

from landloom.operators import stats, vector
from landloom.operators.records import with_category
from landloom.plans import base
from landloom.plans.sql_common import CATEGORY
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


@query(f"WITH {base.LABELLED}, p AS (SELECT point_id, min({CATEGORY.format(r='r')}) AS category FROM points_df r GROUP BY point_id), c AS (SELECT category FROM labelled WHERE category IS NOT NULL INTERSECT SELECT category FROM p WHERE category IS NOT NULL) SELECT 'row' AS kind, row_id AS id, category FROM labelled SEMI JOIN c USING (category) UNION ALL SELECT 'point', point_id, category FROM p SEMI JOIN c USING (category)")
def common_classes(spark, d):
    a = base.labelled(spark, d).select(F.col("row_id").alias("id"), "category")
    p = with_category(table(spark, d, "points_df"), table(spark, d, "legend")).groupBy(F.col("point_id").alias("id")).agg(F.min("category").alias("category"))
    x, y = vector.common_classes(a, p, "category")
    return x.select(F.lit("row").alias("kind"), "id", "category").unionByName(y.select(F.lit("point").alias("kind"), "id", "category"))


@query(f"WITH {base.RASTER} SELECT y, x, cls FROM raster WHERE NOT EXISTS (SELECT 1 FROM dataset q WHERE q.x = raster.x AND q.y = raster.y)")
def exclude_points(spark, d):
    known = table(spark, d, "dataset").select("y", "x").distinct()
    return base.raster(spark, d).join(known, ["y", "x"], "left_anti").select("y", "x", "cls")


@query("SELECT 'dataset' AS origin, row_id AS id, class, NULL AS campaign FROM dataset UNION ALL SELECT 'points', point_id, class, campaign FROM points_df")
def union_points(spark, d):
    a = table(spark, d, "dataset").select(F.lit("dataset").alias("origin"), F.col("row_id").alias("id"), "class")
    b = table(spark, d, "points_df").select(F.lit("points").alias("origin"), F.col("point_id").alias("id"), "class", "campaign")
    return a.unionByName(b, allowMissingColumns=True)


@query("SELECT r.row_id, r.class_id, coalesce(l.description, 'unknown') AS description, coalesce(l.internal_code, 0) AS code FROM dataset r LEFT JOIN legend l ON l.lc_code = r.class_id")
def legend_join(spark, d):
    leg = table(spark, d, "legend").select(F.col("lc_code").alias("class_id"), "description", "internal_code")
    j = table(spark, d, "dataset").join(leg, "class_id", "left")
    return j.select("row_id", "class_id", F.coalesce("description", F.lit("unknown")).alias("description"), F.coalesce("internal_code", F.lit(0)).alias("code"))


@query("WITH l AS (SELECT description, lc_code, row_number() OVER (ORDER BY internal_code) - 1 AS n FROM legend) SELECT p.point_id, p.level_1, l.lc_code, l.description FROM points_df p LEFT JOIN l ON l.n = p.level_1")
def positional_legend(spark, d):
    return vector.positional_legend(table(spark, d, "points_df"), table(spark, d, "legend"), "internal_code", "level_1", ["lc_code", "description"]).select("point_id", "level_1", "lc_code", "description")


_PIX = "pix AS (SELECT pixel_id, min(y) AS y, min(x) AS x FROM composites WHERE pixel_id IS NOT NULL GROUP BY pixel_id)"


@query(f"WITH {base.CELLS}, {_PIX}, q AS (SELECT DISTINCT x, y FROM dataset WHERE x IS NOT NULL AND y IS NOT NULL) SELECT pixel_id, band, month_no, v FROM cells JOIN pix USING (pixel_id) JOIN q USING (x, y)")
def point_lookup(spark, d):
    pix = table(spark, d, "composites").where("pixel_id is not null").groupBy("pixel_id").agg(F.min("y").alias("y"), F.min("x").alias("x"))
    pts = table(spark, d, "dataset").select("x", "y").where("x is not null and y is not null").distinct()
    return base.cells(spark, d).join(vector.point_lookup(pts, pix, ["x", "y"]), "pixel_id").select("pixel_id", "band", "month_no", "v")


_COLS = ", ".join(f"max(CASE WHEN band = {b} AND month_no = {m} THEN v END) AS band_{b}_month_{m}" for b in base.BANDS for m in range(1, 13))


@query(f"WITH {base.CELLS} SELECT pixel_id, {_COLS} FROM cells GROUP BY pixel_id")
def feature_matrix(spark, d):
    c = base.cells(spark, d)
    return vector.feature_matrix(c.select("pixel_id").distinct(), c, ["pixel_id"], "band", "month_no", "v", base.BANDS, range(1, 13))


@query(f"""WITH {base.RASTER}, r AS (SELECT *, row_number() OVER (PARTITION BY cls ORDER BY y, x) - 1 AS rn, count(*) OVER (PARTITION BY cls) AS n FROM raster), s AS (SELECT *, least(300, n) AS take, greatest(1, n // least(300, n)) AS every FROM r)
  SELECT y, x, cls FROM s WHERE rn % every = 0 AND rn // every < take""")
def systematic_sample(spark, d):
    return vector.systematic_sample(base.raster(spark, d), "cls", 300).select("y", "x", "cls")


_SHUFFLED = "(row_id * 2654435761) % 1000003"


@query(f"""WITH {base.LABELLED}, u AS (SELECT row_id, category FROM labelled WHERE category IS NOT NULL), k AS (SELECT *, (row_number() OVER (PARTITION BY category ORDER BY {_SHUFFLED}, row_id) - 0.5) / count(*) OVER (PARTITION BY category) AS q FROM u)
  SELECT row_id, category, CASE WHEN q <= 0.8::DOUBLE THEN 'train' WHEN q <= 0.8::DOUBLE + 0.1::DOUBLE THEN 'test' ELSE 'cal' END AS split FROM k""")
def stratified_split(spark, d):
    u = base.labelled(spark, d).where("category is not null").select("row_id", "category")
    return vector.stratified_split(u, "category", vector.pseudo_random(F.col("row_id")), [("train", 0.8), ("test", 0.1), ("cal", 0.1)], ["row_id"])


@query(f"""WITH {base.LABELLED}, u AS (SELECT row_id, category, source FROM labelled WHERE category IS NOT NULL), small AS (SELECT row_id, category FROM u WHERE source = 'drone_pass'), pool AS (SELECT row_id, category FROM u WHERE source = 'field_survey'),
  h AS (SELECT category, count(*) AS have FROM small GROUP BY category HAVING count(*) < 100), z AS (SELECT category, count(*) AS n FROM pool GROUP BY category),
  r AS (SELECT p.*, row_number() OVER (PARTITION BY category ORDER BY {_SHUFFLED}, row_id) - 1 AS r, 100 - have AS need, n FROM pool p JOIN h USING (category) JOIN z USING (category)),
  e AS (SELECT row_id, category FROM r, range(0, 101) AS t(k) WHERE r + k * n < need) SELECT row_id, category FROM small UNION ALL SELECT row_id, category FROM e""")
def enhance(spark, d):
    u = base.labelled(spark, d).where("category is not null")
    small, pool = (u.where(F.col("source") == s).select("row_id", "category") for s in ("drone_pass", "field_survey"))
    return vector.enhance(small, pool, "category", 100, vector.pseudo_random(F.col("row_id")))


@query(f"WITH {base.LABELLED} SELECT category, count(*) AS n FROM labelled GROUP BY category")
def class_hist(spark, d):
    return stats.histogram(base.labelled(spark, d), ["category"])


@query(f"WITH {base.LABELLED}, h AS (SELECT category, count(*) AS n FROM labelled WHERE category IS NOT NULL GROUP BY category) SELECT max(n) AS largest, CAST(floor(avg(n)) AS BIGINT) AS mean_size FROM h")
def class_target(spark, d):
    h = stats.histogram(base.labelled(spark, d).where("category is not null"), ["category"])
    return h.agg(F.max("n").alias("largest"), F.floor(F.avg("n")).alias("mean_size"))


@query("SELECT source, tile, count(*) AS n FROM dataset WHERE tile IN (SELECT tile FROM dataset GROUP BY tile HAVING count(*) >= 50) GROUP BY ALL")
def having_group(spark, d):
    return stats.histogram(stats.having_size(table(spark, d, "dataset"), ["tile"], 50), ["source", "tile"])


@query("SELECT o_orderpriority AS param, avg(o_totalprice) AS top_mean, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC) AS r FROM orders) WHERE r <= 10 GROUP BY ALL")
def param_topk(spark, d):
    return stats.top_k_mean(table(spark, d, "orders"), "o_orderpriority", "o_totalprice", 10).withColumnRenamed("o_orderpriority", "param")


@query("SELECT o_orderpriority, max(o_totalprice) AS best, arg_max(o_orderkey, o_totalprice) AS best_key FROM orders GROUP BY ALL")
def best_per_group(spark, d):
    return table(spark, d, "orders").groupBy("o_orderpriority").agg(F.max("o_totalprice").alias("best"), F.max_by("o_orderkey", "o_totalprice").alias("best_key"))


_F8 = [f"b{i}" for i in range(1, 9)]


def _unpivot(cols, expr):
    return " UNION ALL ".join(f"SELECT '{c}' AS feature, {expr.format(c=c)} FROM bands12" for c in cols)


@query(f"WITH {base.BANDS12} " + _unpivot(_F8, "round(avg({c}), 6) AS mean, round(stddev_pop({c}), 6) AS std, round(min({c}), 6) AS min, round(max({c}), 6) AS max, round(quantile_cont({c}, 0.001), 6) AS q_min, round(quantile_cont({c}, 0.999), 6) AS q_max"))
def scaler_stats(spark, d):
    s = stats.scaler_stats(base.bands12(spark, d), _F8)
    return s.select("feature", *[F.round(c, 6).alias(c) for c in ("mean", "std", "min", "max", "q_min", "q_max")])


@query(f"""WITH {base.BANDS12}, s AS (SELECT avg(b1) AS m, stddev_pop(b1) AS sd, min(b2) AS lo, max(b2) AS hi, quantile_cont(b3, 0.001) AS q0, quantile_cont(b3, 0.999) AS q1 FROM bands12)
  SELECT pix, round((b1 - m) / sd, 6) AS b1, round((b2 - lo) / (hi - lo), 6) AS b2, round(least(1.0, greatest(0.0, (b3 - q0) / (q1 - q0))), 6) AS b3 FROM bands12, s""")
def scale_features(spark, d):
    s = stats.Scaler({"b1": "standard", "b2": "minmax", "b3": "minmax_q"})
    out = stats.Scaler.from_metadata(s.fit(base.bands12(spark, d)).metadata()).transform(base.bands12(spark, d))
    return out.select("pix", *[F.round(c, 6).alias(c) for c in ("b1", "b2", "b3")])


@query(f"WITH {base.BANDS12}, s AS (SELECT cls, avg(b1) AS m, stddev_pop(b1) AS sd FROM bands12 GROUP BY cls) SELECT pix, round((b1 - m) / CASE WHEN sd = 0 THEN 1 ELSE sd END, 6) AS b1 FROM bands12 JOIN s USING (cls)")
def scale_by_group(spark, d):
    b = base.bands12(spark, d)
    s = stats.scaler_stats(b, ["b1"], ["cls"])
    return b.join(s, "cls").select("pix", F.round(stats.scale(F.col("b1"), "standard", {"mean": F.col("mean"), "std": F.col("std")}), 6).alias("b1"))


@query(f"WITH {base.RASTER} SELECT y, x, round(sin(radians(dn % 360)), 9) AS s, round(cos(radians(dn % 360)), 9) AS c FROM raster")
def sincos(spark, d):
    from landloom.functions.scalars import degree_to_cos, degree_to_sin

    a = F.col("dn") % 360
    return base.raster(spark, d).select("y", "x", F.round(degree_to_sin(a), 9).alias("s"), F.round(degree_to_cos(a), 9).alias("c"))


@query("SELECT 'pixel_m' AS feature, min(pixel_m) = max(pixel_m) AS is_constant FROM dataset UNION ALL SELECT 'row_id', min(row_id) = max(row_id) FROM dataset UNION ALL SELECT 'one', true")
def const_features(spark, d):
    cols = ["pixel_m", "row_id", "one"]
    c = stats.constant_features(table(spark, d, "dataset").withColumn("one", F.lit(1)), cols)
    return spark.createDataFrame([(x, x in c) for x in cols], "feature string, is_constant boolean")


@query(f"WITH {base.BANDS12} " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS corr FROM bands12" for a in _F8 for b in _F8))
def corr_matrix(spark, d):
    return stats.correlations(base.bands12(spark, d), _F8).select("a", "b", F.round("corr", 6).alias("corr"))


_GAPS = ", ".join(f"CASE WHEN pix % {i + 2} > 0 THEN {c} END AS {c}" for i, c in enumerate(_F8))


@query(f"WITH {base.BANDS12}, gaps AS (SELECT {_GAPS}, 5::DOUBLE AS k FROM bands12) " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS corr FROM gaps" for a in _F8 for b in _F8) + " UNION ALL " + " UNION ALL ".join(f"SELECT '{a}', 'k', NULL UNION ALL SELECT 'k', '{a}', NULL" for a in _F8) + " UNION ALL SELECT 'k', 'k', NULL")
def corr_matrix_gaps(spark, d):
    """Correlations of columns with missing values, each pair over the rows that have both, and of a constant column."""
    b = base.bands12(spark, d).select(*[F.when(F.col("pix") % (i + 2) > 0, F.col(c)).alias(c) for i, c in enumerate(_F8)], F.lit(5.0).alias("k"))
    return stats.correlations(b, [*_F8, "k"]).select("a", "b", F.round("corr", 6).alias("corr"))


@query(f"WITH {base.BANDS12}, k AS ({' UNION ALL '.join(f'SELECT {chr(39)}{a}{chr(39)} AS feature, corr({a}, {b}) AS c FROM bands12' for a in _F8 for b in _F8)}), m AS (SELECT feature, avg(c) AS mean_correlation FROM k GROUP BY feature), i AS ({_unpivot(_F8, 'stddev_pop({c}) AS importance')}) SELECT feature, round(mean_correlation, 6) AS mean_correlation, round(importance / (1 + abs(mean_correlation)), 5) AS combined_metric FROM m JOIN i USING (feature)")
def mean_corr_metric(spark, d):
    b = base.bands12(spark, d)
    imp = stats.scaler_stats(b, _F8).select("feature", F.col("std").alias("importance"))
    m = stats.combined_metric(stats.mean_correlation(stats.correlations(b, _F8)), imp)
    return m.select("feature", F.round("mean_correlation", 6).alias("mean_correlation"), F.round("combined_metric", 5).alias("combined_metric"))


@query(f"WITH {base.BANDS12} " + _unpivot(_F8, "round(min({c}), 3) AS min, round(max({c}), 3) AS max, round(avg({c}), 3) AS mean, round(stddev_samp({c}), 3) AS std, round(var_samp({c}), 3) AS var"))
def column_profile(spark, d):
    return stats.profile(base.bands12(spark, d), _F8)


_PRED = f"""{base.LABELLED}, pr AS (SELECT category AS truth, CASE WHEN category IN (110, 120) AND row_id % 7 < 2 THEN 230 - category ELSE category END AS pred FROM labelled WHERE category IS NOT NULL), cf AS (SELECT truth, pred, count(*) AS n FROM pr GROUP BY ALL)"""


def _pred(spark, d):
    r = base.labelled(spark, d).where("category is not null")
    return r.select("row_id", F.col("category").alias("truth"), F.when(F.col("category").isin(110, 120) & (F.col("row_id") % 7 < 2), 230 - F.col("category")).otherwise(F.col("category")).alias("pred"))


@query(f"WITH {_PRED} SELECT * FROM cf")
def confusion(spark, d):
    return stats.confusion(_pred(spark, d), "truth", "pred")


@query(f"""WITH {_PRED}, s AS (SELECT truth AS k, sum(n) AS support, sum(n) FILTER (truth = pred) AS hits FROM cf GROUP BY truth), p AS (SELECT pred AS k, sum(n) AS got FROM cf GROUP BY pred),
  r AS (SELECT CAST(k AS VARCHAR) AS label, hits::DOUBLE / got AS precision, hits::DOUBLE / support AS recall, 2 * (hits::DOUBLE / got) * (hits::DOUBLE / support) / ((hits::DOUBLE / got) + (hits::DOUBLE / support)) AS f1, CAST(support AS BIGINT) AS support, hits FROM s JOIN p USING (k))
  SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM r
  UNION ALL SELECT 'accuracy', round(sum(hits)::DOUBLE / sum(support), 6), round(sum(hits)::DOUBLE / sum(support), 6), round(sum(hits)::DOUBLE / sum(support), 6), CAST(sum(support) AS BIGINT) FROM r
  UNION ALL SELECT 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6), CAST(sum(support) AS BIGINT) FROM r
  UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), 6), round(sum(recall * support) / sum(support), 6), round(sum(f1 * support) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM r""")
def class_report(spark, d):
    r = stats.class_report(stats.confusion(_pred(spark, d), "truth", "pred"))
    return r.select("label", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")], "support")


@query(f"""WITH {base.RASTER}, p AS (SELECT y, x, dn / 10000.0::DOUBLE AS p, dn % 10 < dn / 1000 AS t FROM raster), e AS (SELECT quantile_cont(p, [{", ".join(str(i / 10) for i in range(1, 10))}]) AS e FROM p),
  b AS (SELECT p, t, len(list_filter(e, lambda z: z < p)) AS bin FROM p, e) SELECT CAST(bin AS INT) AS bin, round(avg(p), 6) AS mean_predicted, round(avg(CAST(t AS INT)), 6) AS fraction_positive, count(*) AS n FROM b GROUP BY bin""")
def calibration_curve(spark, d):
    p = base.raster(spark, d).select((F.col("dn") / F.lit(10000.0)).alias("p"), (F.col("dn") % 10 < F.col("dn") / 1000).alias("t"))
    c = stats.calibration_curve(p, F.col("t"), "p")
    return c.select("bin", F.round("mean_predicted", 6).alias("mean_predicted"), F.round("fraction_positive", 6).alias("fraction_positive"), "n")


@query("SELECT n_nationkey, n_name, round(sum((n_nationkey + 1) / 325.0::DOUBLE) OVER (ORDER BY n_nationkey), 9) AS cumulative FROM nation")
def cumulative_variance(spark, d):
    n = table(spark, d, "nation").withColumn("ratio", (F.col("n_nationkey") + 1) / F.lit(325.0))
    return stats.cumulative_variance(n, "n_nationkey", "ratio").select("n_nationkey", "n_name", F.round("cumulative", 9).alias("cumulative"))


@query("""SELECT CAST(r_regionkey AS INT) AS "index", r_name AS metric, 'None' AS extra FROM region UNION ALL SELECT CAST((SELECT max(r_regionkey) FROM region) + row_number() OVER (ORDER BY n_nationkey::VARCHAR) AS INT), 'None', n_nationkey::VARCHAR FROM nation""")
def schema_evolution_log(spark, d):
    log = table(spark, d, "region").select(F.col("r_regionkey").cast("int").alias("index"), F.col("r_name").alias("metric"))
    return stats.append_log(log, table(spark, d, "nation").select(F.col("n_nationkey").alias("extra")))


@query("SELECT max(CAST(regexp_extract(n, '^experiment_(\\d+)$', 1) AS INT)) + 1 AS next_number FROM (SELECT 'experiment_' || c_custkey::VARCHAR AS n FROM customer)")
def next_experiment(spark, d):
    return stats.next_experiment(table(spark, d, "customer").select(F.concat(F.lit("experiment_"), F.col("c_custkey").cast("string")).alias("n")), "n")


@query("WITH m AS (SELECT o_orderkey, 'SVM_' || o_orderstatus || '_macro-avg_f1-score' AS metric, o_totalprice / 1e6 AS v FROM orders UNION ALL SELECT o_orderkey, 'SVM_' || o_orderstatus || '_recall', 0.5 FROM orders) SELECT regexp_extract(metric, '^SVM_(.*)_([^_]*_?[^_]*f1-score)$', 1) AS class, round(avg(v), 9) AS mean_f1 FROM m WHERE metric LIKE 'SVM_%macro-avg_f1-score' GROUP BY ALL")
def metric_columns(spark, d):
    """Averages over metric columns by name, after unpivoting them."""
    o = table(spark, d, "orders").select("o_orderkey", *[F.when(F.col("o_orderstatus") == s, F.col("o_totalprice") / 1e6).alias(f"SVM_{s}_macro-avg_f1-score") for s in "FOP"], *[F.when(F.col("o_orderstatus") == s, F.lit(0.5)).alias(f"SVM_{s}_recall") for s in "FOP"])
    names = [c for c in o.columns if c.startswith("SVM_") and c.endswith("macro-avg_f1-score")]
    long = o.select("o_orderkey", *[F.col(f"`{c}`") for c in names]).unpivot("o_orderkey", [F.col(f"`{c}`") for c in names], "metric", "v").where("v is not null")
    return long.groupBy(F.regexp_extract("metric", r"^SVM_(.*)_([^_]*_?[^_]*f1-score)$", 1).alias("class")).agg(F.round(F.avg("v"), 9).alias("mean_f1"))


@query("SELECT count(*) AS n, avg(dx) AS mean_dx, min(dx) AS min_dx, max(dx) AS max_dx, max(sqrt(dx * dx + dy * dy)) AS worst FROM (SELECT geom.x - (300000 + (round_even((geom.x - 300000) / 10.0::DOUBLE, 0)) * 10) AS dx, geom.y - (9000000 - (round_even((geom.y - 9000000) / -10.0::DOUBLE, 0)) * 10) AS dy FROM points_df WHERE geom.x IS NOT NULL)")
def coord_error(spark, d):
    p = table(spark, d, "points_df").where("geom.x is not null")
    dx = F.col("geom.x") - (F.lit(300000) + F.rint((F.col("geom.x") - 300000) / F.lit(10.0)) * 10)
    dy = F.col("geom.y") - (F.lit(9000000) - F.rint((F.col("geom.y") - 9000000) / F.lit(-10.0)) * 10)
    e = p.select(dx.alias("dx"), dy.alias("dy"))
    return e.agg(F.count("*").alias("n"), F.avg("dx").alias("mean_dx"), F.min("dx").alias("min_dx"), F.max("dx").alias("max_dx"), F.max(F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy"))).alias("worst"))


# The shipped search space: lists in their order.
GRID = {
    "dataset_path": ["a/std.csv", "a/dataset.csv", "b/std.csv", "b/max_enhanced.csv", "b/max_enhanced_eroded.csv", "b/400_fullLC.csv"],
    "band_features_preprocessing": ["minmax", "standard", "minmax_q"], "other_features_preprocessing": ["minmax", "standard", "minmax_q"],
    "use_band_features": [True], "use_glcm_features": [True, False], "use_other_features": [True, False], "pca_components_selection_strategy": ["average"],
    "features_selection_strategy": [None, "rfecv", "multicollinearity_analysis"], "fss_use_bands": [True, False], "apply_pca": [True, False], "pca_use_bands": [True, False],
}


def _grid_sql() -> str:
    parts, weight = [], 1
    for k, v in reversed(list(GRID.items())):
        rows = ", ".join(f"({'NULL::VARCHAR' if x is None else str(x).lower() if isinstance(x, bool) else repr(x)}, {i * weight})" for i, x in enumerate(v))
        parts.append(f"(VALUES {rows}) AS t_{k}({k}, o_{k})")
        weight *= len(v)
    return f"grid AS (SELECT {', '.join(GRID)}, CAST({' + '.join(f'o_{k}' for k in GRID)} AS BIGINT) AS ordinal FROM {', '.join(parts)})"


@query(f"WITH {_grid_sql()} SELECT * FROM grid")
def grid_product(spark, d):
    return stats.parameter_grid(spark, GRID)


_ONLY = "use_band_features AND NOT use_glcm_features AND NOT use_other_features"


@query(f"""WITH {_grid_sql()}, ok AS (SELECT * FROM grid WHERE NOT (features_selection_strategy IS NOT NULL AND {_ONLY} AND NOT fss_use_bands) AND NOT (apply_pca AND {_ONLY} AND NOT pca_use_bands)
    AND NOT (lower(regexp_extract(dataset_path, '([^/]*)$', 1)) = 'dataset.csv' AND (use_other_features OR (apply_pca AND NOT pca_use_bands AND NOT use_glcm_features)))),
  r AS (SELECT *, row_number() OVER (PARTITION BY dataset_path, band_features_preprocessing, other_features_preprocessing, use_band_features, use_glcm_features, use_other_features, CASE WHEN apply_pca THEN pca_components_selection_strategy END, features_selection_strategy,
    CASE WHEN features_selection_strategy IS NOT NULL THEN fss_use_bands END, apply_pca, CASE WHEN apply_pca THEN pca_use_bands END ORDER BY ordinal) AS r FROM ok) SELECT * EXCLUDE (r) FROM r WHERE r = 1""")
def grid_prune(spark, d):
    return stats.prune_grid(stats.parameter_grid(spark, GRID))


@query(f"WITH {_grid_sql()} SELECT ordinal, dataset_path FROM grid WHERE ordinal NOT IN (SELECT c_custkey FROM customer)")
def resume_antijoin(spark, d):
    done = table(spark, d, "customer").select(F.col("c_custkey").alias("ordinal"))
    return stats.parameter_grid(spark, GRID).join(done, "ordinal", "left_anti").select("ordinal", "dataset_path")


@query("SELECT s_suppkey AS k FROM supplier EXCEPT SELECT l_suppkey FROM lineitem WHERE l_quantity > 49")
def except_features(spark, d):
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("k")).subtract(table(spark, d, "lineitem").where("l_quantity > 49").select(F.col("l_suppkey").alias("k")))


@query("SELECT DISTINCT band FROM composites")
def distinct_bands(spark, d):
    return table(spark, d, "composites").select("band").distinct()


@query("SELECT o_orderkey, to_json({'class': o_orderstatus, 'source': o_orderpriority}) AS sidecar FROM orders")
def sidecar_json(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.to_json(F.struct(F.col("o_orderstatus").alias("class"), F.col("o_orderpriority").alias("source"))).alias("sidecar"))


@query("""WITH e AS (SELECT sqrt(dx * dx + dy * dy) AS d FROM (SELECT geom.x - (300000 + (round_even((geom.x - 300000) / 10.0::DOUBLE, 0)) * 10) AS dx, geom.y - (9000000 - (round_even((geom.y - 9000000) / -10.0::DOUBLE, 0)) * 10) AS dy FROM points_df WHERE geom.x IS NOT NULL)),
  b AS (SELECT min(d) AS lo, max(d) AS hi FROM e) SELECT CAST(least(19, floor((d - lo) / (hi - lo) * 20)) AS INT) AS bin, count(*) AS n FROM e, b WHERE d IS NOT NULL GROUP BY ALL""")
def distance_histogram(spark, d):
    """Distances between points and the centres of their pixels, in twenty bins."""
    p = table(spark, d, "points_df").where("geom.x is not null and geom.y is not null")
    dx = F.col("geom.x") - (F.lit(300000) + F.rint((F.col("geom.x") - 300000) / F.lit(10.0)) * 10)
    dy = F.col("geom.y") - (F.lit(9000000) - F.rint((F.col("geom.y") - 9000000) / F.lit(-10.0)) * 10)
    return stats.distance_histogram(p, dx, dy, 20)


@query("""SELECT 'SVM_EVAL' AS prefix, o_orderstatus AS class, round(avg(o_totalprice) / 1e6, 9) AS precision, round(min(o_totalprice) / 1e6, 9) AS recall, round(max(o_totalprice) / 1e6, 9) AS "f1-score", count(*)::DOUBLE AS support FROM orders WHERE o_orderstatus IN ('F', 'O', 'P') GROUP BY ALL""")
def metric_table(spark, d):
    """A log's row of metric columns, class by class; one class lacks a metric and doesn't come out."""
    o = table(spark, d, "orders")
    pick = lambda s: F.when(F.col("o_orderstatus") == s, F.col("o_totalprice"))
    aggs = []
    for s in "FOP":
        aggs += [(F.avg(pick(s)) / 1e6).alias(f"SVM_EVAL_{s}_precision"), (F.min(pick(s)) / 1e6).alias(f"SVM_EVAL_{s}_recall"), (F.max(pick(s)) / 1e6).alias(f"SVM_EVAL_{s}_f1-score"), F.count(pick(s)).cast("double").alias(f"SVM_EVAL_{s}_support")]
    row = o.agg(*aggs, F.lit(0.5).alias("SVM_EVAL_lost_precision"))
    out = stats.metric_table(row, row.columns)
    return out.select("prefix", "class", *[F.round(f"`{c}`", 9).alias(c) for c in ("precision", "recall", "f1-score")], "support")
