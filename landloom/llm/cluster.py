"""Grouping records into similarity clusters: MinHash banding, exact verification, connected components, medoids.

A record is a series of cells (pixel: band x month); its set holds one token per observed cell, the cell with its value's bin. A MinHash value is taken cell-wise: each hash function
orders the cells and shifts the bins, and gives the first observed cell with its bin, so two records agree in it with the Jaccard similarity of their observed cells times the share of
equal bins. Records that share all values of a band are candidates; the exact rule verifies them: at least min_shared common cells whose mean absolute difference is at most
`threshold` (`token_jaccard` gives the Jaccard similarity of the token sets, which the rule stands in for).

1. Within a partition (`_local`): alike records fold into the one with most observed cells, their representative, so of a group that holds a third of all rows every partition passes on
   a few representatives only. These are brought together by a coarse band and folded once more; each such fold is a verified link.
2. Representatives left go to the buckets of all bands (`plan_bands`), with a bit sketch of their cells. In a bucket every pair is compared by sketch (a quantised sum of differences over
   common cells, with a margin that loses about one alike pair in two thousand at the threshold itself), and pairs that pass are verified against both series by the exact rule. A hot bucket is cut into
   blocks, and each pair of blocks is a bucket of its own, so no task holds more than two blocks and no pair is left out.
3. Connected components of verified links by alternating large-star and small-star steps; no component is ever collected.
4. All members of a component, not only representatives, are cut into sets all alike to each other (`partition`): most by a bound on their distance from the mean series, the rest
   by the exact rule, from the record with most alike ones on (`cliques`). Records that so leave their representative are searched again, unfolded, with all that have no group.

Defined results: records with fewer than min_shared observed cells belong to no group; equal records form a group; groups of one are not reported; a cell's value is its latest usable
one; null ids are left out; an empty table gives an empty result. Every two members of a group are alike by the exact rule. Which of several possible sets is taken is greedy (the largest
set of a loose component isn't searched exhaustively). Banding finds a pair of alike records with a probability that depends on their Jaccard similarity; the tests measure it against brute force.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from landloom.session import cut, release

THRESHOLD, MIN_SHARED = 200, 30
WIDTH = 4  # width of a value's bin, in thresholds
FOLD_ROWS, FOLD_BANDS = 6, 32
PLANES, PLANE_WIDTH, MARGIN = 2, 5, 3.3  # bits of the sketch per cell, their period in thresholds, standard deviations allowed
CHUNK = 65_536
HOT = 262_144
BLOCK = 32_768


def alike(a: np.ndarray, b: np.ndarray, threshold: int = THRESHOLD, min_shared: int = MIN_SHARED) -> np.ndarray:
    """The exact rule, row by row; 0 is an unobserved cell."""
    both = (a > 0) & (b > 0)
    shared = both.sum(1)
    apart = (np.abs(a.astype(np.int32) - b) * both).sum(1)
    return (shared >= min_shared) & (apart <= threshold * shared)


def token_jaccard(a: np.ndarray, b: np.ndarray, width: int = WIDTH * THRESHOLD) -> np.ndarray:
    same = ((a > 0) & (b > 0) & (a // width == b // width)).sum(1)
    return same / np.maximum((a > 0).sum(1) + (b > 0).sum(1) - same, 1)


def plan_bands(records: int, agree: float = 0.61, lost: float = 0.001) -> tuple[int, int]:
    """Rows of a band and number of bands for so many records.

    A row more for every fivefold number keeps buckets from growing with the input; the bands then are as many as lose a share `lost` of the pairs that agree in a MinHash value with
    probability `agree`: 0.61 is that of two records at the threshold, evenly apart, that lack a tenth of their cells each. For those the recall is the same at every size; pairs that agree
    less (both at the threshold and with many missing cells that they don't share) are found the less often the more rows a band has.
    """
    rows = 3 + max(0, math.ceil(math.log(max(records, 1) / 65_536) / math.log(5)))
    return rows, math.ceil(math.log(1 / lost) / -math.log1p(-(agree**rows)))


def _first_seen(vt: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each column the first row, in that order, that isn't 0, and its value."""
    cell, value = np.full(vt.shape[1], order[0], np.int64), vt[order[0]].copy()
    missing = np.flatnonzero(value == 0)
    for c in order[1:]:
        if not len(missing):
            break
        x = vt[c, missing]
        value[missing], cell[missing] = x, c
        missing = missing[x == 0]
    return cell, value


def band_hashes(v: np.ndarray, width: int, rows: int, bands: int, seed: int = 20240229) -> np.ndarray:
    """(records, bands) 64-bit hashes of the bands' MinHash values; each band's don't depend on the number of bands."""
    n, cells = v.shape
    vt = np.ascontiguousarray(v.T.astype(np.int64))
    out = np.empty((n, bands), np.uint64)
    for j in range(bands):
        rng = np.random.default_rng([seed, rows, j])
        h = np.full(n, 0x9E3779B97F4A7C15 * (j + 1) % 2**64, np.uint64)
        for _ in range(rows):
            cell, value = _first_seen(vt, rng.permutation(cells))
            h = (h ^ (cell * 65_536 + (value + rng.integers(width)) // width).astype(np.uint64)) * np.uint64(0xFF51AFD7ED558CCD)
            h ^= h >> np.uint64(32)
        out[:, j] = h
    return out


def sketches(v: np.ndarray, threshold: int) -> np.ndarray:
    """(records, words, 1 + PLANES) 64-bit words: which cells are observed, and per plane the parity of each cell's bin, the planes' bins being shifted against each other.

    So the bits of common cells that differ count the bin borders between two values: their sum is the sum of differences in units of period / PLANES, for differences within the period.
    """
    n, cells = v.shape
    words = -(-cells // 64)
    period = PLANE_WIDTH * threshold
    shift = np.random.default_rng(5).integers(0, 2 * period, cells)
    bits = np.zeros((n, 1 + PLANES, words * 64), bool)
    bits[:, 0, :cells] = v > 0
    for k in range(PLANES):
        bits[:, 1 + k, :cells] = ((v + shift + k * period // PLANES) // period % 2 == 1) & (v > 0)
    return np.packbits(bits, axis=2, bitorder="little").view("<u8").reshape(n, 1 + PLANES, words).transpose(0, 2, 1).copy()


def _limits(cells: int, min_shared: int) -> np.ndarray:
    """By the number of common cells, the most differing bits of a candidate."""
    shared = np.arange(cells + 1)
    most = shared * (PLANES / PLANE_WIDTH) + MARGIN * 0.5 * np.sqrt(shared)
    return np.where(shared >= min_shared, np.floor(most), -1).astype(np.int16)


def fold(v: np.ndarray, hashes: np.ndarray, threshold: int, min_shared: int) -> np.ndarray:
    """For each record the row of its representative among the given ones (itself if it has none); earlier rows stand for later ones."""
    rep = np.arange(len(v))
    live = np.arange(len(v))
    for j in range(hashes.shape[1]):
        order = live[np.argsort(hashes[live, j], kind="stable")]
        h = hashes[order, j]
        new = np.concatenate([[True], h[1:] != h[:-1]])
        lead = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
        a, b = order[~new], lead[~new]
        ok = alike(v[a], v[b], threshold, min_shared)
        rep[a[ok]] = b[ok]
        gone = np.zeros(len(v), bool)
        gone[a[ok]] = True
        live = live[~gone[live]]
    while (rep[rep] != rep).any():
        rep = rep[rep]
    far = ~alike(v, v[rep], threshold, min_shared) & (rep != np.arange(len(v)))
    rep[far] = np.flatnonzero(far)
    return rep


FOLDED = "pixel_id bigint, rep bigint, cells binary"


def _binary(rows: np.ndarray) -> pa.Array:
    size = rows.shape[1] * rows.itemsize
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer((np.arange(len(rows) + 1) * size).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(rows).tobytes())])


def _local(threshold: int, min_shared: int):
    """Over (pixel_id, cells): those with enough observed cells, each with its representative among the records that come with it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[np.ndarray] = []
        cells: list[np.ndarray] = []
        held = 0

        def flush() -> pa.RecordBatch:
            i, v = np.concatenate(ids), np.concatenate(cells)
            order = np.lexsort((i, -(v > 0).sum(1)))  # the fullest series stand for the others: they share most cells with the rest of their group
            i, v = i[order], v[order]
            rep = fold(v, band_hashes(v, WIDTH * threshold, FOLD_ROWS, FOLD_BANDS), threshold, min_shared)
            return pa.RecordBatch.from_arrays([pa.array(i), pa.array(i[rep]), _binary(v)], ["pixel_id", "rep", "cells"])

        for b in batches:
            if not b.num_rows:
                continue
            v = _cells(b.column(1))
            enough = (v > 0).sum(1) >= min_shared
            ids.append(np.asarray(b.column(0))[enough])
            cells.append(v[enough])
            held += int(enough.sum())
            if held >= CHUNK:
                yield flush()
                ids, cells, held = [], [], 0
        if held:
            yield flush()

    return run


def _coarse(threshold: int):
    """Adds the bucket of one band to (pixel_id, cells): it brings alike records together for another fold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                key = band_hashes(_cells(b.column(1)), 2 * WIDTH * threshold, 4, 1, 77)[:, 0].astype(np.int64)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(key)], ["pixel_id", "cells", "coarse"])

    return run


def _sizes(rows: int, bands: int, threshold: int):
    """How many of a batch stand in each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                key, n = np.unique(band_hashes(_cells(b.column(1)), WIDTH * threshold, rows, bands), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(key[n > 1].astype(np.int64)), pa.array(n[n > 1])], ["bucket", "n"])

    return run


BUCKETED = "bucket bigint, part tinyint, pixel_id bigint, sketch binary"


def _buckets(rows: int, bands: int, threshold: int, blocks: dict[int, int]):
    """Each record to the bucket of every band. Of a bucket that is cut into blocks, a record goes to all pairs of blocks its own is in: part 1 and 2 are compared with each other, part 0 with itself."""
    hot = np.array(sorted(blocks), np.int64)
    names = ["bucket", "part", "pixel_id", "sketch"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            v, ids = _cells(b.column(1)), np.asarray(b.column(0))
            key = band_hashes(v, WIDTH * threshold, rows, bands).astype(np.int64)
            sketch = sketches(v, threshold)
            sketch = sketch.reshape(len(v), -1)
            own = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20)
            for j in range(bands):
                k = key[:, j]
                at = np.searchsorted(hot, k) if len(hot) else np.zeros(len(k), np.int64)
                cold = hot[np.minimum(at, len(hot) - 1)] != k if len(hot) else np.ones(len(k), bool)
                yield pa.RecordBatch.from_arrays([pa.array(k[cold]), pa.array(np.zeros(cold.sum(), np.int8)), pa.array(ids[cold]), _binary(sketch[cold])], names)
                for bucket in np.unique(k[~cold]):
                    n = blocks[int(bucket)]
                    in_it = np.flatnonzero(k == bucket)
                    block = (own[in_it] % np.uint64(n)).astype(np.int64)
                    for other in range(n):
                        pair = np.minimum(block, other) * n + np.maximum(block, other)
                        mixed = (np.uint64(bucket) if bucket >= 0 else np.uint64(int(bucket) + 2**64)) ^ ((pair.astype(np.uint64) + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F))
                        part = np.where(block == other, 0, np.where(block < other, 1, 2)).astype(np.int8)
                        yield pa.RecordBatch.from_arrays([pa.array(mixed.astype(np.int64)), pa.array(part), pa.array(ids[in_it]), _binary(sketch[in_it])], names)

    return run


def near_by_sketch(a: np.ndarray, b: np.ndarray, limits: np.ndarray) -> np.ndarray:
    """Whether sketches (..., words, 1 + PLANES) may be those of alike records; the leading dimensions broadcast."""
    shared = apart = None
    for w in range(a.shape[-2]):
        both = a[..., w, 0] & b[..., w, 0]
        n = np.bitwise_count(both).astype(np.int16)
        d = np.zeros(n.shape, np.int16)
        for k in range(1, a.shape[-1]):
            d += np.bitwise_count((a[..., w, k] ^ b[..., w, k]) & both)
        shared, apart = (n, d) if shared is None else (shared + n, apart + d)
    return apart <= limits[shared]


def _compared(cells: int, min_shared: int):
    """Over (bucket, part, pixel_id, sketch) sorted by the first two: the pairs of every bucket that pass by sketch."""
    limits = _limits(cells, min_shared)
    words = -(-cells // 64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _whole(batches):
            bucket, part, ids = (np.asarray(t.column(k).combine_chunks()) for k in range(3))
            sketch = np.frombuffer(b"".join(t.column(3).to_pylist()), "<u8").reshape(len(ids), words, 1 + PLANES)
            starts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
            ends = np.append(starts[1:], len(ids))
            left, right = [], []
            small = (ends - starts > 1) & (ends - starts <= 32) & (part[ends - 1] == 0)
            for n in np.unique(ends[small] - starts[small]):  # all buckets of one size at once
                at = starts[small & (ends - starts == n)]
                i, j = np.triu_indices(n, 1)
                for k in range(0, len(at), max(1, 65_536 // len(i))):
                    part_at = at[k : k + max(1, 65_536 // len(i)), None]
                    a, b = (part_at + i).ravel(), (part_at + j).ravel()
                    ok = near_by_sketch(sketch[a], sketch[b], limits)
                    left.append(a[ok])
                    right.append(b[ok])
            for s, e in zip(starts, ends, strict=True):
                if e - s < 2 or (e - s <= 32 and part[e - 1] == 0):
                    continue
                cross = part[e - 1] > 0
                second = s + int(np.searchsorted(part[s:e], 2)) if cross else s
                step = max(1, 65_536 // max(1, e - second))
                for i in range(s, second if cross else e, step):
                    last = min(i + step, second) if cross else min(i + step, e)
                    first = second if cross else i
                    a, b = np.nonzero(near_by_sketch(sketch[i:last, None], sketch[None, first:e], limits))
                    a, b = a + i, b + first
                    keep = a < b
                    left.append(a[keep])
                    right.append(b[keep])
            if left and sum(map(len, left)):
                a, b = ids[np.concatenate(left)], ids[np.concatenate(right)]
                pairs = np.unique(np.column_stack([np.minimum(a, b), np.maximum(a, b)]), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    return run


def _verify(threshold: int, min_shared: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                v, w = (np.frombuffer(b"".join(b.column(k).to_pylist()), "<i2").reshape(b.num_rows, -1) for k in (2, 3))
                ok = pa.array(alike(v, w, threshold, min_shared))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), ok], ["a", "b", "ok"])

    return run


def verified(pairs: DataFrame, series: DataFrame, threshold: int, min_shared: int) -> DataFrame:
    """(a, b, ok): pairs checked by the exact rule."""
    with_a = pairs.join(series.withColumnsRenamed({"pixel_id": "a", "cells": "va"}), "a")
    with_b = with_a.join(series.withColumnsRenamed({"pixel_id": "b", "cells": "vb"}), "b").select("a", "b", "va", "vb")
    return with_b.mapInArrow(_verify(threshold, min_shared), "a bigint, b bigint, ok boolean")


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, label): connected components of undirected edges (a, b), label the least node. Large-star and small-star steps until nothing changes."""
    now = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    state = None
    for _ in range(most_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.unionByName(least.where("m < u").select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        lowest = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        before, now = now, cut(small.unionByName(lowest.select("u", F.col("m").alias("v"))).distinct())
        release(before)
        new = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if new == state:
            break
        state = new
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("label")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())


def _alike_all(v: np.ndarray, w: np.ndarray, threshold: int, min_shared: int, most: int = 8_000_000) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, block of the matrix of the exact rule) for all rows of v against all rows of w."""
    step = max(1, most // max(1, w.size))
    seen = w > 0
    for i in range(0, len(v), step):
        x = v[i : i + step, None].astype(np.int32)
        both = (x > 0) & seen
        shared = both.sum(2)
        yield i, (shared >= min_shared) & ((np.abs(x - w) * both).sum(2) <= threshold * shared)


def cliques(v: np.ndarray, threshold: int = THRESHOLD, min_shared: int = MIN_SHARED) -> np.ndarray:
    """For each record the number of its group; every two records of a group are alike, and no record left over when a group closes is alike to all of it.

    The record alike to most others of those left opens a group, and the others join in the order of that number where they are alike to all members so far; ties go to the earlier row.
    """
    degree = np.zeros(len(v), np.int64)
    for i, ok in _alike_all(v, v, threshold, min_shared):
        degree[i : i + len(ok)] = ok.sum(1)
    out = np.full(len(v), -1)
    live = np.arange(len(v))
    for g in range(len(v)):
        if not len(live):
            break
        members = []
        queue = live[np.argsort(-degree[live], kind="stable")]
        while len(queue):
            x, queue = queue[0], queue[1:]
            members.append(x)
            queue = queue[alike(np.repeat(v[x : x + 1], len(queue), 0), v[queue], threshold, min_shared)]
        out[members] = g
        live = live[out[live] < 0]
        for i, ok in _alike_all(v[live], v[members], threshold, min_shared):
            degree[live[i : i + len(ok)]] -= ok.sum(1)
    return out


def reach(v: np.ndarray, centre: np.ndarray, min_shared: int) -> np.ndarray:
    """The mean of each record's min_shared largest deviations from the centre: no set of that many of its cells, or more, deviates by more on average.

    So two records whose reaches add up to the threshold at most are alike if they share enough cells, which their numbers of observed cells can tell.
    """
    out = np.empty(len(v))
    k = max(1, min(min_shared, v.shape[1]))
    for i in range(0, len(v), 50_000):
        x = v[i : i + 50_000]
        off = np.where(x > 0, np.abs(x - centre[i : i + 50_000] if centre.ndim > 1 else x - centre), 0)
        out[i : i + 50_000] = np.partition(off, off.shape[1] - k, 1)[:, -k:].mean(1)
    return out


def _core(v: np.ndarray, far: np.ndarray, threshold: int, min_shared: int) -> np.ndarray:
    """Records that are alike to each other by their reach alone."""
    return (far <= threshold / 2) & (2 * (v > 0).sum(1) >= v.shape[1] + min_shared)


def _sums(v: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.add.reduceat(v.astype(np.int64), starts), np.add.reduceat((v > 0).astype(np.int64), starts)


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches sorted by their first column, cut anew so that no key stands in two of them."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        keys = np.asarray(b.column(0))
        at = int(np.searchsorted(keys, keys[-1])) if keys[0] <= keys[-1] else b.num_rows
        if held and keys[0] != held[-1].column(0)[-1].as_py():
            yield pa.Table.from_batches(held)
            held = []
        if at:
            yield pa.Table.from_batches([*held, b.slice(0, at)])
            held = []
        held.append(b.slice(at))
    if held:
        yield pa.Table.from_batches(held)


def _cells(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<i2").reshape(len(column), -1)


PARTED = "pixel_id bigint, own boolean, medoid bigint, first boolean"


def _part(threshold: int, min_shared: int):
    """Over (label, pixel_id, own, cells) sorted by label and pixel_id: each component cut into sets of records all alike to each other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _whole(batches):
            label, ids, own_buckets = (np.asarray(t.column(k).combine_chunks()) for k in range(3))
            v = _cells(t.column(3))
            starts = np.flatnonzero(np.concatenate([[True], label[1:] != label[:-1]]))
            ends = np.append(starts[1:], len(label))
            total, n = _sums(v, starts)
            centre = np.rint(total / np.maximum(n, 1)).astype(np.int32)
            far = reach(v, np.repeat(centre, ends - starts, 0), min_shared)
            core = _core(v, far, threshold, min_shared)
            inside = np.add.reduceat(core.astype(np.int64), starts)
            medoid = np.empty_like(ids)
            first = np.ones(len(ids), bool)
            for s, e, k in zip(starts, ends, inside, strict=True):
                own, d, c = v[s:e], far[s:e], core[s:e]
                if e - s == 1:
                    medoid[s] = ids[s]
                    continue
                if k == e - s:
                    medoid[s:e] = ids[s + np.argmin(d)]
                    continue
                if 2 * k > e - s:
                    group = np.zeros(e - s, np.int64)
                    rest = np.flatnonzero(~c)
                    fits = np.ones(len(rest), bool)
                    for i, ok in _alike_all(own[rest], own[c], threshold, min_shared):
                        fits[i : i + len(ok)] = ok.all(1)
                    group[rest] = _beside(own[rest], fits, threshold, min_shared)
                else:
                    group = cliques(own, threshold, min_shared)
                largest = np.argmax(np.bincount(group))
                for g in np.unique(group):
                    at = np.flatnonzero(group == g)
                    total, n = _sums(own[at], np.array([0]))
                    both = own[at] > 0
                    off = (np.abs(own[at] - total / np.maximum(n, 1)) * both).sum(1) / both.sum(1)
                    medoid[s + at] = ids[s + at[np.argmin(off)]]
                    first[s + at] = g == largest
            yield from pa.table([ids, own_buckets, medoid, first], names=["pixel_id", "own", "medoid", "first"]).to_batches()

    return run


def _beside(v: np.ndarray, fits: np.ndarray, threshold: int, min_shared: int) -> np.ndarray:
    """Groups of the records beside a core: 0 for those that join it, as they are alike to all of it and to each other."""
    out = np.zeros(len(v), np.int64)
    may = np.flatnonzero(fits)
    joined = may[cliques(v[may], threshold, min_shared) == 0] if len(may) else may
    others = np.setdiff1d(np.arange(len(v)), joined)
    out[others] = 1 + cliques(v[others], threshold, min_shared)
    return out


def candidate_pairs(reps: DataFrame, threshold: int, min_shared: int, block: int = BLOCK) -> DataFrame:
    """(a, b): pairs of records of (pixel_id, cells) that share a bucket and pass by sketch."""
    found = reps.agg(F.count("*"), F.max(F.length("cells"))).first()
    rows, bands = plan_bands(found[0])
    sizes = reps.select("pixel_id", "cells").mapInArrow(_sizes(rows, bands, threshold), "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).where(F.col("n") > block)
    blocks = {r["bucket"]: -(-r["n"] // block) for r in sizes.collect()}  # at most records x bands / block
    rows_of = reps.select("pixel_id", "cells").mapInArrow(_buckets(rows, bands, threshold, blocks), BUCKETED)
    return rows_of.repartition("bucket").sortWithinPartitions("bucket", "part").mapInArrow(_compared((found[1] or 2) // 2, min_shared), "a bigint, b bigint").distinct()


def linked_components(folded: DataFrame, threshold: int, min_shared: int, folds: bool) -> tuple[DataFrame, DataFrame]:
    """(rep, label, own) of all representatives that have a link, and the links (a, b). own: it stood in buckets of its own."""
    reps = folded.where("pixel_id = rep").select("pixel_id", "cells")
    twice = reps.select("pixel_id", F.col("pixel_id").alias("rep"), "cells")
    if folds:
        together = reps.mapInArrow(_coarse(threshold), "pixel_id bigint, cells binary, coarse bigint").repartition("coarse").sortWithinPartitions("coarse").select("pixel_id", "cells")
        twice = cut(together.mapInArrow(_local(threshold, min_shared), FOLDED))
    own = twice.where("pixel_id = rep").select("pixel_id", "cells")
    found = verified(candidate_pairs(own, threshold, min_shared), own, threshold, min_shared).where("ok").select("a", "b")
    links = cut(found.unionByName(twice.where("pixel_id <> rep").select(F.col("pixel_id").alias("a"), F.col("rep").alias("b"))))
    second = twice.where("pixel_id <> rep").select(F.col("pixel_id").alias("rep"), F.lit(False).alias("own"))
    labels = components(links).withColumnRenamed("node", "rep").join(second, "rep", "left")
    return cut(labels.select("rep", "label", F.coalesce("own", F.lit(True)).alias("own"))), links


def around_medoids(links: DataFrame) -> DataFrame:
    """(rep, medoid): each record's neighbour, or itself, with the most links (the least id of several): the sets so formed are no larger than a record's links."""
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    degree = both.groupBy("a").agg(F.count("*").alias("n"))
    rank = F.struct("n", (-F.col("id")).alias("minus"))
    near = both.join(degree.withColumnRenamed("a", "b"), "b").select("a", F.col("b").alias("id"), "n").unionByName(degree.select("a", F.col("a").alias("id"), "n"))
    return near.groupBy(F.col("a").alias("rep")).agg((-F.max(rank)["minus"]).alias("medoid"))


def _hot_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if b.num_rows:
            label = np.asarray(b.column(0))
            order = np.argsort(label, kind="stable")
            starts = np.flatnonzero(np.concatenate([[True], np.diff(label[order]) != 0]))
            total, n = _sums(_cells(b.column(3))[order], starts)
            yield pa.RecordBatch.from_arrays([pa.array(label[order][starts]), pa.array(total.tolist(), pa.list_(pa.int64())), pa.array(n.tolist(), pa.list_(pa.int64()))], ["label", "total", "n"])


def _hot_reach(centres: dict[int, np.ndarray], threshold: int, min_shared: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                v = _cells(b.column(3))
                far = reach(v, np.stack([centres[x] for x in b.column(0).to_pylist()]), min_shared)
                more = [pa.array(far), pa.array((v > 0).sum(1).astype(np.int32)), pa.array(_core(v, far, threshold, min_shared))]
                yield pa.RecordBatch.from_arrays([*b.columns, *more], ["label", "pixel_id", "own", "cells", "far", "seen", "core"])

    return run


def _hot_beside(threshold: int, min_shared: int):
    """Over the rows beside the cores of hot components, sorted by label and pixel_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _whole(batches):
            label, ids, own_buckets, core = (np.asarray(t.column(k).combine_chunks()) for k in (0, 1, 2, 5))
            v, fits = _cells(t.column(3)), np.asarray(t.column(4).combine_chunks())
            medoid, first = np.empty_like(ids), np.zeros(len(ids), bool)
            for x in np.unique(label):
                own = np.flatnonzero(label == x)
                group = _beside(v[own], fits[own], threshold, min_shared)
                for g in np.unique(group):
                    at = own[group == g]
                    medoid[at] = core[at[0]] if g == 0 else ids[at[0]]
                    first[at] = g == 0
            yield from pa.table([ids, own_buckets, medoid, first], names=["pixel_id", "own", "medoid", "first"]).to_batches()

    return run


def partition(members: DataFrame, links: DataFrame, threshold: int, min_shared: int, hot: int = HOT) -> DataFrame:
    """(pixel_id, own, medoid, first) for (label, pixel_id, own, cells, rep): components cut into sets all alike; first marks the largest set of each, or its core.

    A component of at most `hot` records is one task's. The core of a hotter one is found by reach from its mean series where the
    records stand; only the records beside it are compared with the core, and only with those that their reach leaves open. A hotter one that has no core of more than half its records is loose: it is first
    split around its records with most links (`around_medoids`), and each part is one task's.
    """
    sizes = members.groupBy("label").count().where(F.col("count") > hot)
    counts = {r["label"]: r["count"] for r in sizes.collect()}  # at most rows / hot
    part = lambda df: df.select("label", "pixel_id", "own", "cells").repartition("label").sortWithinPartitions("label", "pixel_id").mapInArrow(_part(threshold, min_shared), PARTED)
    if not counts:
        return part(members)
    hottest = members.where(F.col("label").isin(list(counts))).select("label", "pixel_id", "own", "cells")
    centres: dict[int, list] = {}
    for r in hottest.mapInArrow(_hot_sums, "label bigint, total array<bigint>, n array<bigint>").select("label", F.posexplode(F.arrays_zip("total", "n"))).groupBy("label", "pos").agg(F.sum("col.total").alias("t"), F.sum("col.n").alias("n")).collect():
        centres.setdefault(r["label"], []).append((r["pos"], round(r["t"] / max(1, r["n"]))))
    centre = {k: np.array([x for _, x in sorted(c)], np.int32) for k, c in centres.items()}
    found = cut(hottest.mapInArrow(_hot_reach(centre, threshold, min_shared), "label bigint, pixel_id bigint, own boolean, cells binary, far double, seen int, core boolean"))
    cores = {r["label"]: r["core"] for r in found.where("core").groupBy("label").agg(F.count("*").alias("k"), F.min(F.struct("far", "pixel_id"))["pixel_id"].alias("core")).collect() if 2 * r["k"] > counts[r["label"]]}
    plain = part(members.where(~F.col("label").isin(list(counts))))
    if loose := [k for k in counts if k not in cores]:
        apart = members.where(F.col("label").isin(loose)).join(around_medoids(links), "rep", "left").withColumn("label", F.coalesce("medoid", "rep"))
        # The largest set of a part need not be its component's, so records without buckets of their own are searched again unless they are in it.
        plain = plain.unionByName(part(apart))
    if not cores:
        return plain
    medoid = F.coalesce(*[F.when(F.col("label") == k, F.lit(m)) for k, m in cores.items()])
    found = found.where(F.col("label").isin(list(cores)))
    inner, beside = found.where("core"), found.where("not core")
    width = len(next(iter(centre.values())))
    x, y = beside.select("label", F.col("pixel_id").alias("a"), F.col("cells").alias("va"), F.col("far").alias("fa"), F.col("seen").alias("sa")), inner.select("label", F.col("pixel_id").alias("b"), F.col("cells").alias("vb"), F.col("far").alias("fb"), F.col("seen").alias("sb"))
    unsure = x.join(y, "label").where(f"fa + fb > {threshold} or sa + sb < {width + min_shared}").select("a", "b", "va", "vb")
    wrong = unsure.mapInArrow(_verify(threshold, min_shared), "a bigint, b bigint, ok boolean").where("not ok").select(F.col("a").alias("pixel_id"), F.lit(False).alias("fits")).distinct()
    rest = beside.join(wrong, "pixel_id", "left").select("label", "pixel_id", "own", "cells", F.coalesce("fits", F.lit(True)).alias("fits"), medoid.alias("core"))
    rest = rest.repartition("label").sortWithinPartitions("label", "pixel_id").mapInArrow(_hot_beside(threshold, min_shared), PARTED)
    return plain.unionByName(inner.select("pixel_id", "own", medoid.alias("medoid"), F.lit(True).alias("first"))).unionByName(rest)


def _settled(folded: DataFrame, threshold: int, min_shared: int, hot: int, folds: bool) -> DataFrame:
    labels, links = linked_components(folded, threshold, min_shared, folds)
    named = folded.join(labels, "rep", "left").select(F.coalesce("label", "rep").alias("label"), "pixel_id", ((F.col("pixel_id") == F.col("rep")) & F.coalesce("own", F.lit(True))).alias("own"), "cells", "rep")
    return cut(partition(named, links, threshold, min_shared, hot))


def groups(series: DataFrame, threshold: int = THRESHOLD, min_shared: int = MIN_SHARED, hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """(pixel_id, medoid, size, least) of all records that have a group, and the table (pixel_id, cells). series: (pixel_id, cells int16)."""
    folded = cut(series.select("pixel_id", "cells").mapInArrow(_local(threshold, min_shared), FOLDED))
    settled = _settled(folded, threshold, min_shared, hot, True)
    if not settled.where("not first and not own").isEmpty():
        # Records that left their representative's group had no buckets of their own: all without a group, and those beside their component's first one, are searched again, each for itself.
        alone = settled.groupBy("medoid").agg((F.count("*") == 1).alias("alone"))
        marked = cut(settled.join(alone, "medoid").withColumn("again", ~F.col("first") | F.col("alone")))
        pool = folded.join(marked.where("again").select("pixel_id"), "pixel_id", "left_semi").select("pixel_id", F.col("pixel_id").alias("rep"), "cells")
        settled = marked.where("not again").select("pixel_id", "medoid").unionByName(_settled(pool, threshold, min_shared, hot, False).select("pixel_id", "medoid"))
    sizes = settled.groupBy("medoid").agg(F.count("*").alias("size"), F.min("pixel_id").alias("least")).where("size > 1")
    return settled.join(sizes, "medoid").select("pixel_id", "medoid", "size", "least"), folded.select("pixel_id", "cells")


def typical(members: DataFrame, cells: DataFrame, top: int = 3, salts: int = 32) -> DataFrame:
    """(group_id, size, rank, pixel_id, distance): of each group the members nearest to its medoid, by mean absolute difference of common cells."""

    def apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                v, w = (np.frombuffer(b"".join(b.column(k).to_pylist()), "<i2").reshape(b.num_rows, -1) for k in (3, 4))
                both = (v > 0) & (w > 0)
                d = (np.abs(v.astype(np.int32) - w) * both).sum(1) / np.maximum(both.sum(1), 1)
                yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(d)], ["pixel_id", "group_id", "size", "distance"])

    own = members.join(cells.withColumnRenamed("cells", "v"), "pixel_id")
    med = cells.withColumnsRenamed({"pixel_id": "medoid", "cells": "w"})
    near = own.join(med, "medoid").select("pixel_id", F.col("least").alias("group_id"), "size", "v", "w").mapInArrow(apart, "pixel_id bigint, group_id bigint, size bigint, distance double")
    order = [F.col("distance"), F.col("pixel_id")]
    part = near.withColumn("salt", F.pmod(F.xxhash64("pixel_id"), F.lit(salts)))
    part = part.withColumn("r", F.row_number().over(Window.partitionBy("group_id", "salt").orderBy(*order))).where(F.col("r") <= top)
    return part.withColumn("rank", F.row_number().over(Window.partitionBy("group_id").orderBy(*order))).where(F.col("rank") <= top).select("group_id", "size", "rank", "pixel_id", "distance")
