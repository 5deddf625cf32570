"""Copies of the smallest tables with extra columns of clashing names, with null rows, or without rows."""

from __future__ import annotations

from pathlib import Path

from compare import DATA
from pyspark.sql import functions as F

NAMES = ("dataset", "points_df", "study_areas", "composites", "documents", "eval_items", "reading_marks", "class_targets", "pack_sizes", "legend", "tile_geometry")
CLASHES = (
    "id category px py side grid path gx gy lid rid ax ay at bx by bt left_id right_id distance edge edges rid xs ys x0 x1 y0 y1 grp cells month_no v0 w0 k lost value filled method rep hashes bucket medoid size least "
    "n_tokens capacity pack_no piece_no rank offset n_words english features buckets grade level n_train n_eval s train_id eval_id block blocks order p count needed available target probability gap status a b u v m node label degree "
    "first_word end_word __code __tile __name _rank _size _bucket _c _off internal lc r"
).split()


def build(spark, to: Path, kind: str) -> str:
    for name in NAMES:
        df = spark.read.parquet(str(DATA / "sf0.001" / f"{name}.parquet"))
        have = {c.lower() for c in df.columns}
        if kind == "clashing":
            df = df.select("*", *[F.lit("clash").alias(c) for c in dict.fromkeys(CLASHES) if c.lower() not in have])
        elif kind == "nulls":
            df = df.unionByName(df.limit(3).select(*[F.lit(None).cast(t).alias(c) for c, t in df.dtypes]))
        elif kind == "empty":
            df = df.limit(0)
        elif kind == "repeated":
            df = df.unionByName(df)
        df.coalesce(1).write.parquet(str(to / f"{name}.parquet"))
    return str(to)


def rows(df) -> list:
    cols = sorted(df.columns)
    return sorted((tuple(round(x, 6) if isinstance(x, float) else x for x in (r[c] for c in cols)) for r in df.collect()), key=repr)
