"""Same or near-same records across splits, by a suffix array over partitioned texts.

A record's text is the ground it covers: the square around its place with the distance as edge, written row by row in cells whose edge is the distance. So two places at most that far apart
share a cell, as the point midway between them lies in both squares. A row of a text is a run of neighbouring cells, hence a suffix is a cell and the cells after it in its row.

All suffixes of all texts are put in partitions by their first cell, so that suffixes with a common prefix stand in one partition, and are sorted there: a suffix array. Along it, the
longest common prefix of neighbours is computed; where it isn't empty, the texts share a span. Runs of such suffixes that hold both sides are taken apart into pairs of a training and an evaluation
site, each verified by exact distance. The common prefix of a verified pair is a shared span; spans are merged into the coverage of a record: the share of its cells
that verified records of the other side cover, too. A pair is told in the first cell that its texts share, so no pair comes twice.

Records at one place are one site from the start, with the number of either side, so copies cost nothing until the last join, an inner sort-merge join that adaptive execution can split.
Pairs of sites are enough to count pairs of records (`split_report`). Where many sites crowd into one cell, its training sites are spread over several runs, each with all its evaluation sites.

Defined results: records without id, place or side take part in nothing; of repeated deliveries of an id the last (by `at`) counts; the
distance is inclusive; coordinates must be below 1e15 in size; empty inputs give empty results; only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landloom.session import cut

PAD = 1e-6  # keeps rounding on the safe side: squares are so much wider, and cells ten times that
CROWD = 20_000


def reach(distance: float) -> float:
    """Half the edge of the square that a record covers."""
    return distance / 2 * (1 + PAD)


def edge(distance: float) -> float:
    """The edge of a cell: more than that of the square, so a text has one or two cells in each of one or two rows."""
    return distance * (1 + 10 * PAD)


def _first(v, distance: float):
    at = (v - reach(distance)) / edge(distance)
    return F.floor(at) if isinstance(v, Column) else np.floor(at).astype(np.int64)


def _last(v: Column, distance: float) -> Column:
    return F.floor((v + reach(distance)) / edge(distance))


def suffixes(sites: DataFrame, distance: float) -> DataFrame:
    """(row, col, length, x, y, n_train, n_eval): every suffix of every site's text, by its first cell and its number of cells."""
    x, y = F.col("x"), F.col("y")
    ends = sites.withColumns({"row": F.explode(F.sequence(_first(y, distance), _last(y, distance))), "end": _last(x, distance)})
    return ends.withColumn("col", F.explode(F.sequence(_first(x, distance), F.col("end")))).select("row", "col", (F.col("end") - F.col("col") + 1).cast("int").alias("length"), "x", "y", "n_train", "n_eval")


def common_prefixes(row: np.ndarray, col: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Longest common prefix of each suffix with the one before it, in cells: cells follow each other, so two suffixes that begin alike go on alike until one ends."""
    same = (row[1:] == row[:-1]) & (col[1:] == col[:-1])
    return np.concatenate([[0], np.where(same, np.minimum(length[1:], length[:-1]), 0)])


SPAN = "tx double, ty double, ex double, ey double, row bigint, col bigint, length int, first boolean"


def _spans(distance: float, most: int = 1_000_000):
    """Over (row, col, salt, length, x, y, n_train, n_eval) sorted by the first four: the spans that verified pairs of sites share."""

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
        held: list[list[np.ndarray]] = []
        for b in batches:
            cols = [np.asarray(c) for c in b.columns]
            if not len(cols[0]):
                continue
            last = int(np.argmax((cols[0] == cols[0][-1]) & (cols[1] == cols[1][-1])))
            if held and (held[-1][0][-1] != cols[0][0] or held[-1][1][-1] != cols[1][0]):
                yield [np.concatenate(c) for c in zip(*held, strict=True)]
                held = []
            if last:
                held.append([c[:last] for c in cols])
                yield [np.concatenate(c) for c in zip(*held, strict=True)]
                held = []
            held.append([c[last:] for c in cols])
        if held:
            yield [np.concatenate(c) for c in zip(*held, strict=True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, col, salt, length, x, y, nt, ne in runs(batches):
            of = np.cumsum((common_prefixes(row, col, length) == 0) | np.concatenate([[True], salt[1:] != salt[:-1]])) - 1
            t, e = np.flatnonzero(nt > 0), np.flatnonzero(ne > 0)
            n = np.bincount(of[e], minlength=of[-1] + 1)  # evaluation sites of each run
            begin = np.cumsum(n) - n
            k = n[of[t]]
            ends = np.cumsum(k)
            at = 0
            while at < len(t):
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")))
                here = k[at:to]
                i = np.repeat(t[at:to], here)
                j = e[np.repeat(begin[of[t[at:to]]], here) + np.arange(len(i)) - np.repeat(np.cumsum(here) - here, here)] if len(i) else i
                at = to
                near = (x[i] - x[j]) ** 2 + (y[i] - y[j]) ** 2 <= distance * distance
                i, j = i[near], j[near]
                own = col[i] == np.maximum(_first(x[i], distance), _first(x[j], distance))  # the span begins here, not in the cell before
                i, j = i[own], j[own]
                if len(i):
                    first = row[i] == np.maximum(_first(y[i], distance), _first(y[j], distance))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(x[i]), pa.array(y[i]), pa.array(x[j]), pa.array(y[j]), pa.array(row[i]), pa.array(col[i]), pa.array(np.minimum(length[i], length[j])), pa.array(first)],
                        ["tx", "ty", "ex", "ey", "row", "col", "length", "first"],
                    )

    return run


def sites(records: DataFrame) -> DataFrame:
    return records.groupBy("x", "y").agg(F.sum((F.col("side") == "train").cast("int")).alias("n_train"), F.sum((F.col("side") == "eval").cast("int")).alias("n_eval"))


def latest(records: DataFrame, record_id: str, x: str, y: str, side: str, at: str) -> DataFrame:
    """(id, x, y, side) of the last delivery of each id, without those that lack any of them."""
    order = F.coalesce(F.col(at), F.lit("1900-01-01").cast("timestamp"))
    rows = records.where(F.col(record_id).isNotNull()).groupBy(F.col(record_id).alias("id")).agg(
        F.max_by(F.col(x).cast("double"), order).alias("x"), F.max_by(F.col(y).cast("double"), order).alias("y"), F.max_by(F.when(F.col(side) == "train", 1).when(F.col(side) == "eval", 2), order).alias("s")
    )
    return rows.where((F.abs("x") < 1e15) & (F.abs("y") < 1e15) & F.col("s").isNotNull()).select("id", "x", "y", F.when(F.col("s") == 1, "train").otherwise("eval").alias("side"))


def _crowded(places: DataFrame, distance: float, crowd: int) -> DataFrame:
    """(row, col, salts) of cells in which more than `crowd` suffixes begin, found in two steps: squares of 64 x 64 cells with that many sites, then the cells in those only."""
    square = lambda v: F.floor(F.col(v) / F.lit(64 * edge(distance)))
    named = places.withColumns({"sx": square("x"), "sy": square("y")})
    full = named.groupBy("sx", "sy").count().where(F.col("count") > crowd // 4).select("sx", "sy")
    cells = suffixes(named.join(full, ["sx", "sy"], "left_semi").drop("sx", "sy"), distance).groupBy("row", "col").count()
    return cells.where(F.col("count") > crowd).select("row", "col", F.ceil(F.col("count") / crowd).cast("int").alias("salts"))


def shared_spans(rows: DataFrame, distance: float, crowd: int = CROWD) -> DataFrame:
    """(tx, ty, ex, ey, row, col, length, first): what a training and an evaluation site at most distance apart have in common; first once for each pair."""
    if not distance > 0:
        raise ValueError("distance must be positive")
    places = cut(sites(rows))
    crowded = cut(_crowded(places, distance, crowd))
    salted = suffixes(places, distance)
    if crowded.isEmpty():
        ordered = salted.select("row", "col", F.lit(0).alias("salt"), "length", "x", "y", "n_train", "n_eval").repartition("row", "col").sortWithinPartitions("row", "col", "length")
        return ordered.mapInArrow(_spans(distance), SPAN)
    salted = salted.join(crowded, ["row", "col"], "left").withColumn("salts", F.coalesce("salts", F.lit(1)))
    own = F.pmod(F.xxhash64("x", "y"), F.col("salts")).cast("int")
    salted = salted.withColumn("own", own).withColumn("salt", F.explode(F.when(F.col("n_eval") > 0, F.sequence(F.lit(0), F.col("salts") - 1)).otherwise(F.array("own"))))
    salted = salted.withColumn("n_train", F.when(F.col("salt") == F.col("own"), F.col("n_train")).otherwise(0))
    ordered = salted.select("row", "col", "salt", "length", "x", "y", "n_train", "n_eval").repartition("row", "col", "salt").sortWithinPartitions("row", "col", "salt", "length")
    return ordered.mapInArrow(_spans(distance), SPAN)


def site_pairs(rows: DataFrame, distance: float, crowd: int = CROWD) -> DataFrame:
    """(tx, ty, ex, ey): pairs of a training and an evaluation site at most distance apart."""
    return shared_spans(rows, distance, crowd).where("first").select("tx", "ty", "ex", "ey")


def cross_split_pairs(records: DataFrame, distance: float, record_id: str = "row_id", x: str = "px", y: str = "py", side: str = "side", at: str = "loaded_at", crowd: int = CROWD) -> DataFrame:
    """(train_id, eval_id): all pairs of records of different sides whose places are at most distance apart."""
    rows = latest(records, record_id, x, y, side, at)
    pairs = site_pairs(rows, distance, crowd)
    train = rows.where("side = 'train'").select(F.col("id").alias("train_id"), F.col("x").alias("tx"), F.col("y").alias("ty"))
    other = rows.where("side = 'eval'").select(F.col("id").alias("eval_id"), F.col("x").alias("ex"), F.col("y").alias("ey"))
    return pairs.join(train, ["tx", "ty"]).join(other, ["ex", "ey"]).select("train_id", "eval_id")


def split_report(records: DataFrame, distance: float, by: list[str], record_id: str = "row_id", x: str = "px", y: str = "py", side: str = "side", at: str = "loaded_at") -> DataFrame:
    """(by..., n_rows, n_pairs): evaluation records near training records, and their pairs, from the numbers of records at sites; pairs of records are never made. Of several values of a `by` column of an id the least counts."""
    rows = latest(records, record_id, x, y, side, at)
    near = site_pairs(rows, distance).join(sites(rows).select(F.col("x").alias("tx"), F.col("y").alias("ty"), "n_train"), ["tx", "ty"]).groupBy("ex", "ey").agg(F.sum("n_train").alias("n_near"))
    names = records.where((F.col(side) == "eval") & F.col(record_id).isNotNull()).groupBy(F.col(record_id).alias("id")).agg(*[F.min(c).alias(c) for c in by])
    other = rows.where("side = 'eval'").join(names, "id").groupBy(F.col("x").alias("ex"), F.col("y").alias("ey"), *by).agg(F.count("*").alias("n"))
    return other.join(near, ["ex", "ey"]).groupBy(*by).agg(F.sum("n").cast("bigint").alias("n_rows"), F.sum(F.col("n") * F.col("n_near")).cast("bigint").alias("n_pairs"))


def coverage(records: DataFrame, distance: float, record_id: str = "row_id", x: str = "px", y: str = "py", side: str = "side", at: str = "loaded_at") -> DataFrame:
    """(id, side, n_cells_shared, coverage): per record the number and the share of its cells in the merged spans that it shares with records of the other side at most distance away."""
    rows = latest(records, record_id, x, y, side, at)
    spans = shared_spans(rows, distance).withColumn("col", F.explode(F.sequence(F.col("col"), F.col("col") + F.col("length") - 1)))
    ends = F.array(F.struct(F.lit("train").alias("side"), F.col("tx").alias("x"), F.col("ty").alias("y")), F.struct(F.lit("eval").alias("side"), F.col("ex").alias("x"), F.col("ey").alias("y")))
    cells = spans.select("row", "col", F.explode(ends).alias("of")).select("of.side", "of.x", "of.y", "row", "col").distinct()
    shared = cells.groupBy("side", "x", "y").agg(F.count("*").alias("n_cells_shared"))
    size = lambda c: _last(F.col(c), distance) - _first(F.col(c), distance) + 1
    return rows.join(shared, ["side", "x", "y"]).select("id", "side", "n_cells_shared", (F.col("n_cells_shared") / (size("x") * size("y"))).alias("coverage"))
