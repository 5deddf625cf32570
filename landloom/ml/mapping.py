"""Land-cover maps: pixels scaled, projected, classified and written, block by block."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landloom.ml import svm
from landloom.ml.search import Prepared
from landloom.operators.stats import confusion
from landloom.operators.vector import to_blocks


def with_chunk(pixels: DataFrame, size: int, width: int) -> DataFrame:
    """Adds chunk: the number, row by row, of the size x size square that a pixel is in; width: pixels of a row."""
    across = -(-width // size)
    return pixels.withColumn("chunk", (F.floor(F.col("y") / size) * across + F.floor(F.col("x") / size)).cast("int"))


def classify(pixels: DataFrame, prepared: Prepared, ensemble: svm.Ensemble, mode: str = "binary", size: int = 1098, width: int = 10980, chunks: int | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, y, x, chunk, label, p0.., valid): one pass over the pixels, map only. chunks: only the first so many squares, to try a configuration out.

    A pixel whose raw features all are null or 0 isn't valid: its label is null and its probabilities are 0.
    """
    d = with_chunk(pixels, size, width)
    if chunks is not None:
        d = d.where(F.col("chunk") < chunks)
    raw = F.lit(False)
    for c in prepared.scaler.methods:
        raw = raw | F.coalesce(F.col(f"`{c}`") != 0, F.lit(False))
    keep = [*keys, "y", "x", "chunk", "valid"]
    filled = d.withColumn("valid", raw).withColumns({c: F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0)) for c in prepared.scaler.methods})
    out = svm.predict(prepared.features(filled, keep), ensemble, "features", keep, mode)
    probabilities = [c for c in out.columns if c[0] == "p" and c[1:].isdigit()]
    return out.withColumns({"label": F.when(F.col("valid"), F.col("label")), **{c: F.when(F.col("valid"), F.col(c)).otherwise(0) for c in probabilities}})


def map_blocks(classified: DataFrame, codes: dict[str, int], size: int = 549) -> DataFrame:
    """(band, y0, x0, h, w, data): band 1 the class codes, then a band of probabilities per class, for `geotiff.write_windows` or the raster sink. codes: label to the code of the map."""
    probabilities = [c for c in classified.columns if c[0] == "p" and c[1:].isdigit()]
    code = F.lit(None).cast("int")
    for k, v in codes.items():
        code = F.when(F.col("label") == k, v).otherwise(code)
    layers = [F.struct(F.lit(1).alias("band"), code.cast("double").alias("v")), *[F.struct(F.lit(i + 2).alias("band"), F.col(c).cast("double").alias("v")) for i, c in enumerate(probabilities)]]
    long = classified.select("y", "x", F.explode(F.array(*layers)).alias("l")).select("y", "x", "l.*")
    return to_blocks(long, ["band"], "v", size).drop("by", "bx")


def label_counts(classified: DataFrame) -> DataFrame:
    """(label, n): pixels of each class; those that aren't valid under null."""
    return classified.groupBy("label").agg(F.count("*").alias("n"))


def evaluation(classified: DataFrame, truth: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(truth, pred, n) of the pixels of (keys, y, x, truth) that the map has."""
    return confusion(classified.join(truth, [*keys, "y", "x"]), "truth", "label")
