"""Filling missing values from neighbours in time and from similar records, with a mark on every filled value.

`fill_grid` works on monthly band cubes: every pixel gets its full grid of bands x months. `fill_series` is the general form
for any table with an entity, an order and numeric or categorical columns.

Plan of `fill_grid`: one map-side aggregate to a row per (pixel, month) with the latest usable value of each band (codegen'd
hash aggregate of fixed-width buffers), one shuffle by pixel of these narrow rows, then Arrow batches: NumPy fills all series of a batch at
once. The group profile (mean by tile, band and month) comes from the same shuffled rows and is joined once per pixel.

Defined results: rows without pixel_id belong to no pixel; rows without a month or with a band or value that isn't usable only make their pixel
known; of several usable deliveries the latest counts (equal times: the larger value); a pixel without a usable value in a band takes the
mean of its tile for that band and month, else of that band, pixels without tile that of all pixels; where there is none, the value stays
null with method 'none'. Empty input gives an empty grid.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from landloom.operators.records import month_of, tile_code

BANDS = (1, 2, 3, 4, 9, 10)
METHODS = ("observed", "interpolated", "carried", "group", "none")
MONTHS = 12
LOWEST, HIGHEST = 1, 20000


class Dating:
    """Time and value in one number, whose maximum is the latest value: later wins, at equal times the larger value does, a null time comes before all others. So the result never depends on
    the order of rows, and one fixed-width buffer holds it: a hash aggregate, no sort. Microseconds since the earliest delivery and 15 bits of value fit 63 bits as long as the deliveries span less than
    8.9 years; beyond that the number is a decimal, which is exact as well, only slower."""

    def __init__(self, rows: DataFrame, at: str):
        micros = F.unix_micros(F.col(at).cast("timestamp"))
        lo, hi = rows.agg(F.min(micros), F.max(micros)).first()  # one column is read
        self.base = lo or 0
        self.wide = (hi or 0) - self.base >= 2**48 - 2

    def key(self, at: Column, value: Column) -> Column:
        since = F.coalesce(F.unix_micros(at.cast("timestamp")) - F.lit(self.base) + 1, F.lit(0).cast("bigint"))
        if self.wide:
            return (since.cast("decimal(20,0)") * F.lit(32768).cast("decimal(6,0)") + value.cast("decimal(6,0)")).cast("decimal(27,0)")
        return F.shiftleft(since, 15).bitwiseOR(value.cast("bigint"))

    def value(self, key: Column) -> Column:
        return (key % F.lit(32768).cast("decimal(6,0)")).cast("int") if self.wide else key.bitwiseAND(F.lit(0x7FFF)).cast("int")


def monthly(cells: DataFrame, bands: Sequence[int] = BANDS, grouped: bool = True) -> DataFrame:
    """One row per (pixel_id, month_no): v0..vN the latest usable value of each band, and, if grouped, grp a hash of the tile (null if unknown)."""
    usable = F.col("band_data").between(LOWEST, HIGHEST)
    dating = Dating(cells, "processed_at")
    rows = cells.where(F.col("pixel_id").isNotNull()).select(
        "pixel_id", month_of(F.col("time"), F.col("file_name")).cast("int").alias("month_no"), "band",
        F.when(usable, dating.key(F.col("processed_at"), F.col("band_data"))).alias("k"), F.xxhash64(tile_code(F.col("tile"))).alias("grp"), F.col("tile").isNull().alias("lost"),
    )
    latest = [dating.value(F.max(F.when(F.col("band") == b, F.col("k")))).alias(f"v{i}") for i, b in enumerate(bands)]
    if grouped:
        latest.append(F.max(F.when(~F.col("lost"), F.col("grp"))).alias("grp"))
    return rows.groupBy("pixel_id", "month_no").agg(*latest)


PER_WORD = 4  # values of 15 bits in a 64-bit word


def _pixels(n_bands: int):
    words = -(-n_bands // PER_WORD)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = np.column_stack([np.asarray(c.fill_null(0), dtype=np.int64) for c in batch.columns])
            if carry is not None:
                table = np.concatenate([carry, table])
            last = np.searchsorted(table[:, 0], table[-1, 0])
            carry = table[last:]
            if last:
                yield dense(table[:last])
        if carry is not None and len(carry):
            yield dense(carry)

    def dense(t: np.ndarray) -> pa.RecordBatch:
        ids, where = np.unique(t[:, 0], return_inverse=True)
        cube = np.zeros((len(ids), n_bands, MONTHS), np.int16)
        ok = (t[:, 1] >= 1) & (t[:, 1] <= MONTHS)
        for b in range(n_bands):
            cube[where[ok], b, t[ok, 1] - 1] = (t[ok, 2 + b // PER_WORD] >> (15 * (b % PER_WORD))) & 0x7FFF
        out = [pa.array(ids)]
        if t.shape[1] > 2 + words:
            group = np.full(len(ids), np.iinfo(np.int64).min)
            np.maximum.at(group, where, np.where(t[:, -1] == 0, np.iinfo(np.int64).min, t[:, -1]))
            out.append(pa.array(group, mask=group == np.iinfo(np.int64).min))
        size = n_bands * MONTHS * 2
        out.append(pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(np.arange(0, (len(ids) + 1) * size, size, dtype=np.int32)), pa.py_buffer(cube.tobytes())]))
        return pa.RecordBatch.from_arrays(out, ["pixel_id", "grp", "cells"] if len(out) == 3 else ["pixel_id", "cells"])

    return run


def series(months: DataFrame, n_bands: int = len(BANDS)) -> DataFrame:
    """One row per pixel: its group (if months have one) and its cells as little-endian int16, band by band, month by month; 0 where no usable value is."""
    grouped = ["grp"] if "grp" in months.columns else []
    word = lambda k: reduce(lambda a, b: a.bitwiseOR(b), [F.shiftleft(F.coalesce(F.col(f"v{i}").cast("bigint"), F.lit(0).cast("bigint")), 15 * (i % PER_WORD)) for i in range(k * PER_WORD, min(n_bands, (k + 1) * PER_WORD))])
    rows = months.select("pixel_id", "month_no", *[word(k).alias(f"w{k}") for k in range(-(-n_bands // PER_WORD))], *grouped)
    shape = "pixel_id bigint, grp bigint, cells binary" if grouped else "pixel_id bigint, cells binary"
    return rows.repartition("pixel_id").sortWithinPartitions("pixel_id").mapInArrow(_pixels(n_bands), shape)


def _filler(bands: Sequence[int], max_gap: int, max_carry: int):
    n = len(bands)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = np.arange(MONTHS)
        for batch in batches:
            k = batch.num_rows
            if not k:
                continue
            cube = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<i2").reshape(k, n, MONTHS).astype(np.float64)
            flat = batch.column(2)
            profile = np.full((k, n * MONTHS), np.nan)
            lengths = np.asarray(flat.value_lengths().fill_null(0))
            if (there := lengths == n * MONTHS).any():
                profile[there] = np.asarray(flat.flatten().fill_null(np.nan)).reshape(-1, n * MONTHS)
            profile = profile.reshape(k, n, MONTHS)
            seen = cube > 0
            before = np.maximum.accumulate(np.where(seen, t, -1), axis=2)
            after = np.minimum.accumulate(np.where(seen, t, 99)[:, :, ::-1], axis=2)[:, :, ::-1]
            left, right = before >= 0, after < 99
            to_left, to_right = np.where(left, t - before, 99), np.where(right, after - t, 99)
            v_left = np.take_along_axis(cube, np.maximum(before, 0), 2)
            v_right = np.take_along_axis(cube, np.minimum(after, MONTHS - 1), 2)
            near = np.minimum(to_left, to_right)
            between = left & right & ~seen & (after - before - 1 <= max_gap)
            carried = ~seen & ~between & (near <= max_carry)
            rest = ~seen & ~between & ~carried
            value = np.where(seen, cube, np.where(between, v_left + (v_right - v_left) * to_left / np.maximum(after - before, 1), np.where(carried, np.where(to_left <= to_right, v_left, v_right), profile)))
            none = np.isnan(value)
            method = np.where(seen, 0, np.where(between, 1, np.where(carried, 2, np.where(none, 4, 3)))).astype(np.int8).ravel()
            distance = np.where(seen, 0, near).astype(np.int32).ravel()
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.repeat(np.asarray(batch.column(0)), n * MONTHS)), pa.array(np.tile(np.repeat(np.asarray(bands, np.int32), MONTHS), k)), pa.array(np.tile(t.astype(np.int32) + 1, k * n)),
                    pa.array(value.ravel(), mask=none.ravel()), pa.array(method), pa.array(distance, mask=rest.ravel()),
                ],
                ["pixel_id", "band", "month_no", "value", "m", "distance"],
            )

    return run


def fill_grid(cells: DataFrame, bands: Sequence[int] = BANDS, max_gap: int = 6, max_carry: int = 3) -> DataFrame:
    """(pixel_id, band, month_no, value, filled, method, distance): the full grid of every pixel.

    Between two observed months at most max_gap missing ones apart: linear interpolation; else the nearest observed month up to max_carry
    months away; else the group's mean. distance is the months to the nearest observed value of the series.
    """
    n = len(bands)
    months = monthly(cells, bands)
    pixels = series(months, n)
    everyone = F.array(F.col("grp"), F.lit(0).cast("bigint"))  # 0 stands for all pixels
    by_month = months.groupBy("grp", "month_no").agg(*[F.sum(f"v{i}").alias(f"s{i}") for i in range(n)], *[F.count(f"v{i}").alias(f"c{i}") for i in range(n)])
    by_month = by_month.withColumn("grp", F.explode(everyone)).where(F.col("grp").isNotNull()).groupBy("grp", "month_no").agg(*[F.sum(f"s{i}").cast("double").alias(f"s{i}") for i in range(n)], *[F.sum(f"c{i}").cast("double").alias(f"c{i}") for i in range(n)])
    ratio = lambda s, c: F.try_divide(s, c)
    cell = [F.max(F.when(F.col("month_no") == m, ratio(F.col(f"s{i}"), F.col(f"c{i}")))) for i in range(n) for m in range(1, MONTHS + 1)]
    year = [ratio(F.sum(f"s{i}"), F.sum(f"c{i}")) for i in range(n)]
    profile = by_month.groupBy(F.col("grp").alias("_grp")).agg(F.array(*[F.coalesce(cell[i * MONTHS + m], year[i]) for i in range(n) for m in range(MONTHS)]).alias("profile"))
    joined = pixels.join(profile, F.coalesce("grp", F.lit(0).cast("bigint")) == F.col("_grp"), "left").select("pixel_id", "cells", "profile")
    out = joined.mapInArrow(_filler(tuple(bands), max_gap, max_carry), "pixel_id bigint, band int, month_no int, value double, m tinyint, distance int")
    names = F.array(*[F.lit(m) for m in METHODS])
    return out.select("pixel_id", "band", "month_no", "value", (F.col("m") > 0).alias("filled"), F.element_at(names, F.col("m").cast("int") + 1).alias("method"), "distance")


def fill_series(df: DataFrame, entity: Sequence[str], order: str, numeric: Sequence[str] = (), categorical: Sequence[str] = (), max_gap: float | None = None, block: float | None = None) -> DataFrame:
    """df with, for each filled column c, c filled and c_method, c_distance beside it.

    order is a number. Numerics are interpolated between the observed neighbours, or take the only neighbour; categories take the nearest
    (the earlier on a tie). Neighbours further than max_gap away don't count; such values stay null with method 'none'. NaN is missing.
    block: with it, an entity's rows are handled in blocks of that width of order, and only block borders are
    compared within the whole entity, so that an entity with a large part of all rows is spread over many tasks. Rows with null entity are an
    entity of their own; rows with null order take no part and stay as they are (method 'none' where null). Ties of order: each row sees the others' values.
    Helper columns start with `_f_`; the input must not have such columns or any c_method, c_distance.
    """
    taken = [c for c in df.columns if c.startswith("_f_")] + [f"{c}_{s}" for c in (*numeric, *categorical) for s in ("method", "distance") if f"{c}_{s}" in df.columns]
    if taken:
        raise ValueError(f"columns in the way: {taken}")
    keys = [F.col(f"`{e}`") for e in entity]
    at = F.col(f"`{order}`").cast("double")
    df = df.withColumn("_f_block", F.floor(at / F.lit(float(block))) if block else F.lit(0).cast("bigint"))
    columns = [*numeric, *categorical]
    clean = {c: (F.when(F.isnan(F.col(f"`{c}`").cast("double")), None).otherwise(F.col(f"`{c}`")) if c in numeric else F.col(f"`{c}`")) for c in columns}
    seen = {c: F.when(clean[c].isNotNull() & at.isNotNull(), F.struct(at.alias("at"), clean[c].alias("v"))) for c in columns}
    inner = Window.partitionBy(*keys, "_f_block").orderBy(at)
    back, ahead = inner.rowsBetween(Window.unboundedPreceding, 0), inner.rowsBetween(0, Window.unboundedFollowing)
    out = df
    for i, c in enumerate(columns):
        out = out.withColumn(f"_f_s{i}", seen[c])
    for i in range(len(columns)):
        out = out.withColumn(f"_f_p{i}", F.last(f"_f_s{i}", True).over(back)).withColumn(f"_f_n{i}", F.first(f"_f_s{i}", True).over(ahead))
    if block:
        borders = df.where(at.isNotNull()).groupBy(*[k.alias(f"_f_k{j}") for j, k in enumerate(keys)], F.col("_f_block").alias("_f_b")).agg(
            *[F.max_by(seen[c], F.when(seen[c].isNotNull(), at)).alias(f"_f_l{i}") for i, c in enumerate(columns)], *[F.min_by(seen[c], F.when(seen[c].isNotNull(), at)).alias(f"_f_r{i}") for i, c in enumerate(columns)]
        )
        outer = Window.partitionBy(*[f"_f_k{j}" for j in range(len(keys))]).orderBy("_f_b")
        borders = borders.select(
            *[f"_f_k{j}" for j in range(len(keys))], "_f_b",
            *[F.last(f"_f_l{i}", True).over(outer.rowsBetween(Window.unboundedPreceding, -1)).alias(f"_f_bp{i}") for i in range(len(columns))],
            *[F.first(f"_f_r{i}", True).over(outer.rowsBetween(1, Window.unboundedFollowing)).alias(f"_f_bn{i}") for i in range(len(columns))],
        )
        same = F.col("_f_block").eqNullSafe(F.col("_f_b"))
        for j, k in enumerate(keys):
            same = same & k.eqNullSafe(F.col(f"_f_k{j}"))
        out = out.join(borders, same, "left")
        for i in range(len(columns)):
            out = out.withColumn(f"_f_p{i}", F.coalesce(f"_f_p{i}", f"_f_bp{i}")).withColumn(f"_f_n{i}", F.coalesce(f"_f_n{i}", f"_f_bn{i}"))
    for i, c in enumerate(columns):
        far = F.lit(float("inf") if max_gap is None else float(max_gap))
        p, n = F.col(f"_f_p{i}"), F.col(f"_f_n{i}")
        dp, dn = at - p["at"], n["at"] - at
        has_p, has_n = p.isNotNull() & (dp <= far), n.isNotNull() & (dn <= far)
        if c in numeric:
            a, b = p["v"].cast("double"), n["v"].cast("double")
            filled = F.when(has_p & has_n, F.when(dp + dn > 0, a + (b - a) * F.try_divide(dp, dp + dn)).otherwise((a + b) / 2)).when(has_p, a).when(has_n, b)
            method = F.when(has_p & has_n, F.lit("interpolated")).when(has_p | has_n, F.lit("carried")).otherwise(F.lit("none"))
        else:
            filled = F.when(has_p & (~has_n | (dp <= dn)), p["v"]).when(has_n, n["v"])
            method = F.when(has_p | has_n, F.lit("carried")).otherwise(F.lit("none"))
        near = F.when(has_p & has_n, F.least(dp, dn)).when(has_p, dp).when(has_n, dn)
        was = clean[c].isNotNull()
        out = out.withColumn(f"{c}_method", F.when(was, F.lit("observed")).otherwise(method)).withColumn(f"{c}_distance", F.when(was, F.lit(0.0)).otherwise(near))
        out = out.withColumn(c, F.when(was, clean[c].cast("double") if c in numeric else clean[c]).otherwise(filled))
    return out.drop(*[x for x in out.columns if x.startswith("_f_")])
