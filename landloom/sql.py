"""The scalar functions as SQL functions of the session: inlined by the optimizer, so they cost what the expressions cost.

    register(spark)
    spark.sql("SELECT pixel_id, ndvi(b4, b1) FROM wide")
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from landloom.functions.indices import EVI2_GAIN, SAVI_L, SCALE, TINY

_ND = f"(CAST({{0}} AS DOUBLE) / {SCALE}D - CAST({{1}} AS DOUBLE) / {SCALE}D) / (CAST({{0}} AS DOUBLE) / {SCALE}D + CAST({{1}} AS DOUBLE) / {SCALE}D + CAST('{TINY}' AS DOUBLE))"
# name -> (arguments by band label, body)
_PAIRS = {"ndvi": ("b4", "b1"), "gndvi": ("b4", "b2"), "ndvi705": ("b4", "b5"), "ndyi": ("b2", "b3"), "ndmi": ("b4", "b9"), "ndwi": ("b2", "b4"), "ndbi": ("b9", "b4"), "ndsi": ("b2", "b9")}


def functions() -> dict[str, tuple[str, str, str]]:
    """name -> (arguments, type, body)."""
    out = {n: (", ".join(f"{a} DOUBLE" for a in args), "DOUBLE", _ND.format(*args)) for n, args in _PAIRS.items()}
    s = {k: f"(b{k} / {SCALE}D)" for k in (1, 2, 3, 4, 9)}
    tiny = f"CAST('{TINY}' AS DOUBLE)"
    out["evi2"] = ("b4 DOUBLE, b1 DOUBLE", "DOUBLE", f"{EVI2_GAIN}D * ({s[4]} - {s[1]}) / ({s[4]} + {s[1]} + 1D + {tiny})")
    out["savi"] = ("b4 DOUBLE, b1 DOUBLE", "DOUBLE", f"({s[4]} - {s[1]}) / ({s[4]} + {s[1]} + {SAVI_L}D + {tiny}) * {1 + SAVI_L}D")
    out["gli"] = ("b1 DOUBLE, b2 DOUBLE, b3 DOUBLE", "DOUBLE", f"(2D * {s[2]} - {s[1]} - {s[3]}) / (2D * {s[2]} + {s[1]} + {s[3]} + {tiny})")
    out["bsi"] = ("b1 DOUBLE, b3 DOUBLE, b4 DOUBLE, b9 DOUBLE", "DOUBLE", f"(({s[9]} + {s[1]}) - ({s[4]} + {s[3]})) / (({s[9]} + {s[1]}) + ({s[4]} + {s[3]}) + {tiny})")
    out["csi"] = ("b4 DOUBLE, b9 DOUBLE", "DOUBLE", "(b4 + b9) / 2D")
    out["season_id"] = ("tile STRING, ts TIMESTAMP", "STRING", "concat(tile, CAST(year(ts) AS STRING), '_', CAST(quarter(ts) AS STRING))")
    out["tile_code"] = ("tile STRING", "STRING", "CASE WHEN length(upper(trim(tile))) = 6 AND startswith(upper(trim(tile)), 'T') THEN substring(upper(trim(tile)), 2, 5) ELSE upper(trim(tile)) END")
    out["display_scale"] = ("dn DOUBLE", "DOUBLE", f"least(1D, greatest(0D, dn / {SCALE}D))")
    return out


def register(spark: SparkSession) -> None:
    for name, (args, kind, body) in functions().items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {kind} RETURN {body}")


def register_views(spark: SparkSession, sf_dir: str) -> None:
    """Temporary views of the tables of a directory, and of the derived relations cells and wide."""
    from pathlib import Path

    from landloom.plans import base
    from landloom.plans.tables import table

    for p in Path(sf_dir).glob("*.parquet"):
        table(spark, sf_dir, p.stem).createOrReplaceTempView(p.stem)
    base.cells(spark, sf_dir).createOrReplaceTempView("cells")
    base.wide(spark, sf_dir).createOrReplaceTempView("wide")
