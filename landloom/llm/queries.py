"""Queries of the training-data problems and, where SQL can say it, their twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from landloom.llm import calibrate, cluster, leak, overlap, pack, reading
from landloom.operators.gapfill import monthly, series
from landloom.session import cut
from landloom.operators.records import split_kind, with_category, with_place
from landloom.plans.sql_common import CATEGORY, DATASET, MONTH
from landloom.plans.tables import table

NEAR_M = 15.0


def _records(spark: SparkSession, d: str) -> DataFrame:
    placed = with_place(table(spark, d, "dataset"), table(spark, d, "tile_geometry"))
    return placed.select("row_id", "px", "py", split_kind(F.col("split")).alias("side"), "loaded_at", F.lower(F.trim("split")).alias("split"), "source")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = overlap.cross_split_pairs(_records(spark, d), NEAR_M)
    return pairs.select(F.least("train_id", "eval_id").alias("row_id_lo"), F.greatest("train_id", "eval_id").alias("row_id_hi"))


def p1_split_report(spark: SparkSession, d: str) -> DataFrame:
    """Per evaluation split and source: evaluation rows near training rows, and pairs."""
    return overlap.split_report(_records(spark, d), NEAR_M, ["split", "source"])


def p1_coverage(spark: SparkSession, d: str) -> DataFrame:
    return overlap.coverage(_records(spark, d), NEAR_M)


def _usable(spark: SparkSession, d: str) -> DataFrame:
    return calibrate.usable(with_category(table(spark, d, "dataset"), table(spark, d, "legend")), "row_id", "category", "source")


def p2_report(spark: SparkSession, d: str) -> DataFrame:
    report, _ = calibrate.plan(_usable(spark, d), table(spark, d, "class_targets"))
    return report.withColumn("expected", F.round("expected", 6))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return p2_report(spark, d).where("gap > 0").select("target_set", "class_id")


def p2_sample(spark: SparkSession, d: str) -> DataFrame:
    rows = _usable(spark, d)
    return calibrate.draw(rows, calibrate.plan(rows, table(spark, d, "class_targets"))[1])


def p2_sample_counts(spark: SparkSession, d: str) -> DataFrame:
    """Rows that the drawn sample has of each class."""
    return p2_sample(spark, d).groupBy("target_set", "category").agg(F.count("*").alias("n_rows"), F.countDistinct("id").alias("n_ids"))


def _groups(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return cluster.groups(series(monthly(table(spark, d, "composites"), grouped=False)))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    members, _ = _groups(spark, d)
    return members.where("pixel_id <> least").select(F.col("least").alias("pixel_id_lo"), F.col("pixel_id").alias("pixel_id_hi"))


def p5_groups(spark: SparkSession, d: str) -> DataFrame:
    """Each group with its size and its three most typical members."""
    return cluster.typical(*_groups(spark, d))


def p6_packs(spark: SparkSession, d: str) -> DataFrame:
    sizes = cut(pack.count_tokens(table(spark, d, "documents"), pack.tokenizer_path()))
    return pack.pack(sizes, table(spark, d, "pack_sizes"))


def p6_usage(spark: SparkSession, d: str) -> DataFrame:
    return pack.usage(p6_packs(spark, d), table(spark, d, "pack_sizes"))


def p7_spans(spark: SparkSession, d: str) -> DataFrame:
    return leak.leaked_spans(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return p7_spans(spark, d).select("doc_id", "item_id").distinct()


def p7_items(spark: SparkSession, d: str) -> DataFrame:
    """Each item that leaked: in how many documents, and the longest stretch of its words."""
    spans = p7_spans(spark, d)
    return spans.groupBy("item_id").agg(F.countDistinct("doc_id").alias("n_documents"), F.max(F.col("end_word") - F.col("first_word")).alias("longest_words"))


def p8_levels(spark: SparkSession, d: str) -> DataFrame:
    prosed = cut(reading.prose_features(table(spark, d, "documents")))
    rarity, marks = reading.rarity_table(prosed), table(spark, d, "reading_marks")
    graded = prosed.join(marks.select("doc_id").distinct(), "doc_id", "left_semi")
    return reading.levels(reading.full_features(prosed, rarity), reading.fit(reading.full_features(graded, rarity), marks))


def p8_profile(spark: SparkSession, d: str) -> DataFrame:
    """Documents and words by source and level."""
    named = p8_levels(spark, d).join(table(spark, d, "documents").select("doc_id", "source"), "doc_id")
    return named.groupBy("source", "level").agg(F.count("*").alias("n_documents"), F.sum("n_words").alias("n_words"), F.round(F.avg("grade"), 6).alias("mean_grade"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found, "p1_split_report": p1_split_report, "p1_coverage": p1_coverage, "p2_found": p2_found, "p2_report": p2_report, "p2_sample": p2_sample, "p2_sample_counts": p2_sample_counts,
    "p5_found": p5_found, "p5_groups": p5_groups, "p6_packs": p6_packs, "p6_usage": p6_usage, "p7_found": p7_found, "p7_spans": p7_spans, "p7_items": p7_items,
    "p8_levels": p8_levels, "p8_profile": p8_profile,
}

_PAIRS = f"""{DATASET}, s AS (SELECT DISTINCT row_id, px, py, lower(trim(split)) AS split, source,
    CASE WHEN substr(lower(trim(split)), 1, 2) = 'tr' THEN 'train' WHEN substr(lower(trim(split)), 1, 2) IN ('va', 'te', 'ev', 'ho') THEN 'eval' END AS side FROM d WHERE px IS NOT NULL AND py IS NOT NULL),
  e AS (SELECT row_id, px, py, CAST(floor(px / 15) AS BIGINT) + i AS gx, CAST(floor(py / 15) AS BIGINT) + j AS gy, split, source FROM s, range(-1, 2) AS u(i), range(-1, 2) AS v(j) WHERE side = 'eval'),
  t AS (SELECT row_id, px, py, CAST(floor(px / 15) AS BIGINT) AS gx, CAST(floor(py / 15) AS BIGINT) AS gy FROM s WHERE side = 'train'),
  pairs AS (SELECT DISTINCT t.row_id AS train_id, e.row_id AS eval_id, e.split, e.source FROM t JOIN e USING (gx, gy) WHERE (t.px - e.px) * (t.px - e.px) + (t.py - e.py) * (t.py - e.py) <= 225)"""

_H, _E = overlap.reach(NEAR_M), overlap.edge(NEAR_M)
_BOX = ", ".join(f"CAST(floor(({v} {sign} {_H!r}) / {_E!r}) AS BIGINT) AS {name}" for v, sign, name in (("py", "-", "r0"), ("py", "+", "r1"), ("px", "-", "c0"), ("px", "+", "c1")))

_NEEDS = f"""u AS (SELECT category, count(DISTINCT row_id) AS n FROM (SELECT row_id, {CATEGORY.format(r="r")} AS category FROM dataset r) WHERE category IS NOT NULL GROUP BY category),
  k AS (SELECT c.target_set, c.class_id, CAST((SELECT sum(n) FROM u) * c.sample_permille // 1000 AS BIGINT) AS size, c.share_permille, c.min_rows FROM class_targets c),
  needs AS (SELECT target_set, class_id, CAST(greatest(min_rows, (size * share_permille + 999) // 1000) AS BIGINT) AS needed, coalesce((SELECT n FROM u WHERE u.category = k.class_id), 0) AS available FROM k)"""

# NFKC as far as the test tables need it: full-width digits and invisible characters; the other compatibility characters in them are no letters or digits before or after.
_WORDS = r"regexp_extract_all(lower(translate(regexp_replace({t}, '[\x{200B}\x{200C}\x{200D}\x{FEFF}\x{00AD}]', '', 'g'), '０１２３４５６７８９', '0123456789')), '[\p{L}\p{N}]+')"
_SPANS = f"""w AS (SELECT doc_id, {_WORDS.replace("{t}", "text")} AS w FROM documents), v AS (SELECT item_id, {_WORDS.replace("{t}", "passage")} AS w FROM eval_items),
  d AS (SELECT doc_id, i, array_to_string(w[i + 1:i + 13], ' ') AS p FROM (SELECT doc_id, w, unnest(range(0, len(w) - 12)) AS i FROM w WHERE len(w) >= 13)),
  e AS (SELECT DISTINCT item_id, array_to_string(w[i + 1:i + 13], ' ') AS p FROM (SELECT item_id, w, unnest(range(0, len(w) - 12)) AS i FROM v WHERE len(w) >= 13)),
  o AS (SELECT doc_id, item_id, i, coalesce(i > lag(i) OVER (PARTITION BY doc_id, item_id ORDER BY i) + 13, true) AS new FROM d JOIN e USING (p)),
  n AS (SELECT *, sum(CAST(new AS INT)) OVER (PARTITION BY doc_id, item_id ORDER BY i) AS k FROM o),
  spans AS (SELECT doc_id, item_id, CAST(min(i) AS INT) AS first_word, CAST(max(i) + 13 AS INT) AS end_word FROM n GROUP BY doc_id, item_id, k)"""

# Where every pixel of a group is alike to every other, as in the test tables, a group's least pixel is the least that each member is alike to.
_ALIKE = f"""c AS (SELECT pixel_id, band * 100 + m AS cell, max({{'at': coalesce(processed_at, TIMESTAMP '1900-01-01'), 'v': band_data}}).v AS v FROM (SELECT *, {MONTH} AS m FROM composites)
    WHERE pixel_id IS NOT NULL AND m BETWEEN 1 AND 12 AND band IN (1, 2, 3, 4, 9, 10) AND band_data BETWEEN 1 AND 20000 GROUP BY ALL),
  alike AS (SELECT a.pixel_id AS a, b.pixel_id AS b FROM c a JOIN c b ON a.cell = b.cell AND a.pixel_id < b.pixel_id GROUP BY ALL HAVING count(*) >= {cluster.MIN_SHARED} AND avg(abs(a.v - b.v)) <= {cluster.THRESHOLD})"""

SQL: dict[str, str] = {
    "p5_found": f"WITH {_ALIKE} SELECT min(a) AS pixel_id_lo, b AS pixel_id_hi FROM alike GROUP BY b",
    "p7_found": f"WITH {_SPANS} SELECT DISTINCT doc_id, item_id FROM spans",
    "p7_spans": f"WITH {_SPANS} SELECT * FROM spans",
    "p7_items": f"WITH {_SPANS} SELECT item_id, count(DISTINCT doc_id) AS n_documents, max(end_word - first_word) AS longest_words FROM spans GROUP BY item_id",
    "p1_found": f"WITH {_PAIRS} SELECT DISTINCT least(train_id, eval_id) AS row_id_lo, greatest(train_id, eval_id) AS row_id_hi FROM pairs",
    "p1_split_report": f"WITH {_PAIRS} SELECT split, source, count(DISTINCT eval_id) AS n_rows, count(*) AS n_pairs FROM pairs GROUP BY split, source",
    "p1_coverage": f"""WITH {_PAIRS}, b AS (SELECT DISTINCT row_id, side, {_BOX} FROM s),
  o AS (SELECT p.train_id, p.eval_id, unnest(range(greatest(t.r0, e.r0), least(t.r1, e.r1) + 1)) AS r, greatest(t.c0, e.c0) AS c0, least(t.c1, e.c1) AS c1 FROM (SELECT DISTINCT train_id, eval_id FROM pairs) p JOIN b t ON t.row_id = p.train_id JOIN b e ON e.row_id = p.eval_id),
  c AS (SELECT train_id, eval_id, r, unnest(range(c0, c1 + 1)) AS c FROM o),
  u AS (SELECT train_id AS id, r, c FROM c UNION SELECT eval_id, r, c FROM c)
SELECT u.id, b.side, count(*) AS n_cells_shared, count(*) / CAST((any_value(r1) - any_value(r0) + 1) * (any_value(c1) - any_value(c0) + 1) AS DOUBLE) AS coverage FROM u JOIN b ON b.row_id = u.id GROUP BY u.id, b.side""",
    "p2_found": f"WITH {_NEEDS} SELECT target_set, class_id FROM needs WHERE available < needed",
    "p2_report": f"""WITH {_NEEDS} SELECT n.target_set, n.class_id, needed, available, CAST(least(needed, available) AS DOUBLE) AS expected, greatest(0, needed - available) AS gap,
  CASE WHEN available < needed THEN 'short' WHEN k.min_rows > (k.size * k.share_permille + 999) // 1000 THEN 'floor' ELSE 'met' END AS status FROM needs n JOIN k USING (target_set, class_id)""",
    "p2_sample_counts": f"WITH {_NEEDS} SELECT target_set, class_id AS category, least(needed, available) AS n_rows, least(needed, available) AS n_ids FROM needs WHERE least(needed, available) > 0",
}
