"""Composites over a stream of scene pixels: late images, sliding two-month windows, deliveries that come twice."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def deduplicated(stream: DataFrame, keys: Sequence[str], time: str, late: str = "10 days") -> DataFrame:
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(list(keys))


def windowed_mean(stream: DataFrame, keys: Sequence[str], time: str, value: str, late: str | None = None, width: str = "60 days", every: str = "30 days") -> DataFrame:
    """(keys, window, mean_value, n_valid): valid values (not null, not 0) per sliding window; state is a sum and a count per key and open window.

    late sets the watermark; leave it out where the stream has one. Windows come out once the watermark has passed them.
    """
    v = F.when(F.col(value) != 0, F.col(value).cast("double"))
    marked = stream.withWatermark(time, late) if late else stream
    return marked.groupBy(*keys, F.window(time, width, every)).agg(F.avg(v).alias("mean_value"), F.count(v).alias("n_valid"))
