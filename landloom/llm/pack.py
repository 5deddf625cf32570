"""Filling containers of fixed capacity with documents measured in tokens, by bin completion on the histogram of sizes.

Packs only depend on sizes, and there are at most `capacity` sizes, so the search (`completion.py`: branch and bound over undominated fillings around the largest item, pruned by waste,
best fit as the first incumbent) runs on the histogram: a table bounded by the capacity, not by the data. One task searches for each capacity. The plan it writes says which ranks of a size
go to which packs. Documents get their rank within their size distributedly (offsets per size and hash bucket, so a size that a third of all documents share is ranked in many tasks), and
each hash bucket is joined with the stretch of the plan that its ranks meet; the plan is a table throughout and is never collected.

A text longer than the capacity is cut into pieces of exactly the capacity, each a pack of its own, and one rest, which is packed like any other.

Defined results: null and empty texts have no tokens, take no room and stand in pack 0; texts may be of any length; repeated documents are
items of their own; a null doc_id is an ordinary value; a pack_sizes row with a null or non-positive capacity is left out, repeated ones count once, a null name is a name; empty tables give empty results.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from landloom.llm.completion import STEPS, complete_bins, least_packs
from landloom.session import cut

DEFAULT_RANKS = "byte_bpe_50k.tiktoken"
BUCKET_ITEMS = 50_000


def tokenizer_path(name: str = DEFAULT_RANKS) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encoder(path: str):
    """The tokenizer, built once in a worker process: functions come to workers by value, so the cache stands outside this module."""
    import sys
    import types

    cache = sys.modules.setdefault("_token_encoders", types.ModuleType("_token_encoders")).__dict__
    if path not in cache:
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        cache[path] = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return cache[path]


BLANK = "[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
LONG_BLANK = 1_000


def token_count(e, text: str, long_blank: int = LONG_BLANK) -> int:
    """Tokens of a whole text. The library's splitter overflows its stack on very long runs of blanks, so those are cut out and encoded as the single pieces that the splitting rule
    makes of them: a run before other text is one piece without its last blank, which goes with what follows; a run that ends the text is one piece."""
    if len(text) < long_blank:
        return len(e.encode_ordinary(text))
    n = at = 0
    for run in re.finditer(BLANK + f"{{{long_blank},}}", text):
        a, b = run.span()
        b -= b < len(text)
        n += len(e.encode_ordinary(text[at:a])) + len(e._encode_single_piece(text[a:b]))
        at = b
    return n + len(e.encode_ordinary(text[at:]))


def count_tokens(documents: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_tokens) of whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for b in batches:
            n = [token_count(e, t.as_py()) if t.is_valid else 0 for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], ["doc_id", "n_tokens"])

    return documents.select(documents[doc_id].cast("bigint").alias("doc_id"), documents[text].cast("string").alias("text")).mapInArrow(run, "doc_id bigint, n_tokens bigint")


def pieces(sizes: DataFrame, capacities: DataFrame) -> DataFrame:
    """(pack_name, capacity, doc_id, piece_no, size): whole texts, or full pieces and a rest where a text is longer than the capacity."""
    caps = capacities.where(F.col("capacity_tokens") > 0).select("pack_name", F.col("capacity_tokens").cast("bigint").alias("capacity")).distinct()
    spark = sizes.sparkSession
    bounds = caps.orderBy("pack_name", "capacity").collect()  # a row per capacity
    if not bounds:
        return spark.createDataFrame([], "pack_name string, capacity bigint, doc_id bigint, piece_no int, size bigint")
    each = F.array(*[F.struct(F.lit(r["pack_name"]).cast("string").alias("pack_name"), F.lit(r["capacity"]).cast("bigint").alias("capacity")) for r in bounds])
    rows = sizes.select("doc_id", "n_tokens", F.explode(each).alias("c")).select("c.pack_name", "c.capacity", "doc_id", "n_tokens")
    last = F.greatest(F.lit(0), F.ceil(F.col("n_tokens") / F.col("capacity")) - 1).cast("int")
    rows = rows.withColumn("piece_no", F.explode(F.sequence(F.lit(0), last)))
    return rows.select("pack_name", "capacity", "doc_id", "piece_no", F.least("capacity", F.col("n_tokens") - F.col("piece_no") * F.col("capacity")).alias("size"))


PLAN = "pack_name string, capacity bigint, size bigint, first_rank bigint, each bigint, times bigint, first_pack bigint, proven boolean"


def _plan(steps: int):
    def run(table: pa.Table) -> pa.Table:
        name, capacity = table["pack_name"][0].as_py(), table["capacity"][0].as_py()
        histogram = dict(zip(table["size"].to_pylist(), table["n"].to_pylist(), strict=True))
        full = histogram.pop(capacity, 0)
        found, proven = complete_bins(histogram, capacity, steps)
        used: dict[int, int] = {}
        rows = []
        pack = 0
        for pattern, times in [*([({capacity: 1}, full)] if full else []), *found]:
            for s, k in pattern.items():
                rows.append((name, capacity, s, used.get(s, 0), k, times, pack, proven))
                used[s] = used.get(s, 0) + k * times
            pack += times
        cols = list(zip(*rows, strict=True)) or [[]] * 8
        kinds = [pa.string(), *[pa.int64()] * 6, pa.bool_()]
        return pa.table([pa.array(c, kind) for c, kind in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in PLAN.split(", ")])

    return run


ITEM = ["pack_name", "doc_id", "piece_no", "size"]


def _assign(key: tuple, items: pa.Table, plan: pa.Table) -> pa.Table:
    """The packs of one hash bucket's items. plan: the bucket's stretches of the plan, with the rank that the bucket's first item of each size has."""
    if not items.num_rows:
        return pa.table({"pack_name": pa.array([], pa.string()), "pack_no": pa.array([], pa.int64()), "doc_id": pa.array([], pa.int64()), "piece_no": pa.array([], pa.int32()), "n_tokens": pa.array([], pa.int64())})
    items = items.sort_by([("size", "ascending"), ("doc_id", "ascending"), ("piece_no", "ascending")])
    plan = plan.sort_by([("size", "ascending"), ("first_rank", "ascending")])
    size = np.asarray(items["size"])
    pack = np.zeros(len(size), np.int64)
    ps = np.asarray(plan["size"])
    first, each, packs, offset = (np.asarray(plan[c]) for c in ("first_rank", "each", "first_pack", "offset"))
    starts = np.flatnonzero(np.concatenate([[True], size[1:] != size[:-1]]))
    for s, e in zip(starts, [*starts[1:], len(size)], strict=True):
        if size[s] > 0:
            lo, hi = np.searchsorted(ps, size[s]), np.searchsorted(ps, size[s], side="right")
            rank = offset[lo] + np.arange(e - s)
            i = lo + np.searchsorted(first[lo:hi], rank, side="right") - 1
            pack[s:e] = packs[i] + (rank - first[i]) // each[i]
    return pa.table([items["pack_name"], pa.array(pack), items["doc_id"], items["piece_no"], items["size"]], names=["pack_name", "pack_no", "doc_id", "piece_no", "n_tokens"])


def plan_packs(items: DataFrame, steps: int = STEPS) -> DataFrame:
    """The plan for (pack_name, capacity, size) of all items: a filling that is used `times` times from first_pack on takes `each` items of a size, from first_rank on."""
    histogram = items.where("size > 0").groupBy("pack_name", "capacity", "size").agg(F.count("*").alias("n"))
    return histogram.groupBy("pack_name", "capacity").applyInArrow(_plan(steps), PLAN)


def pack(sizes: DataFrame, capacities: DataFrame, steps: int = STEPS, bucket_items: int = BUCKET_ITEMS) -> DataFrame:
    """(pack_name, pack_no, doc_id, piece_no, n_tokens) for sizes (doc_id, n_tokens)."""
    items = pieces(sizes, capacities)
    plan = cut(plan_packs(items, steps))
    buckets = max(1, -(-items.groupBy("pack_name").count().agg(F.max("count")).first()[0] // bucket_items)) if items.take(1) else 1
    bucketed = items.select(*ITEM, F.pmod(F.xxhash64("doc_id", "piece_no"), F.lit(buckets)).cast("int").alias("bucket"))
    counts = bucketed.where("size > 0").groupBy("pack_name", "size", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("pack_name", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    ranges = counts.select(F.col("pack_name").alias("of_pack"), F.col("size").alias("of_size"), F.col("bucket").alias("of_bucket"), "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    meets = (F.col("first_rank") < F.col("offset") + F.col("n")) & (F.col("first_rank") + F.col("each") * F.col("times") > F.col("offset"))
    same = F.col("pack_name").eqNullSafe(F.col("of_pack")) & (F.col("size") == F.col("of_size"))
    stretches = plan.join(ranges, same).where(meets).select("of_pack", "of_bucket", "size", "first_rank", "each", "first_pack", "offset")
    return bucketed.groupBy("pack_name", "bucket").cogroup(stretches.groupBy("of_pack", "of_bucket")).applyInArrow(_assign, "pack_name string, pack_no bigint, doc_id bigint, piece_no int, n_tokens bigint")


def usage(packed: DataFrame, capacities: DataFrame) -> DataFrame:
    """Per pack size: packs, tokens, empty room as a share, and the least number of packs that could do (the greater of tokens over capacity and Martello and Toth's L2)."""
    caps = capacities.where(F.col("capacity_tokens") > 0).select("pack_name", F.col("capacity_tokens").cast("bigint").alias("capacity")).distinct()

    def bound(table: pa.Table) -> pa.Table:
        name, capacity = table["pack_name"][0].as_py(), table["capacity"][0].as_py()
        histogram = dict(zip(table["n_tokens"].to_pylist(), table["n"].to_pylist(), strict=True))
        return pa.table({"pack_name": pa.array([name], pa.string()), "least_packs": pa.array([least_packs(histogram, capacity)], pa.int64())})

    sums = packed.groupBy("pack_name").agg((F.max("pack_no") + 1).alias("n_packs"), F.sum("n_tokens").alias("n_tokens"))
    histogram = packed.where("n_tokens > 0").groupBy("pack_name", "n_tokens").agg(F.count("*").alias("n")).join(caps, "pack_name")
    least = histogram.groupBy("pack_name").applyInArrow(bound, "pack_name string, least_packs bigint")
    room = F.col("n_packs") * F.col("capacity")
    return sums.join(caps, "pack_name").join(least, "pack_name", "left").select("pack_name", "capacity", "n_packs", "n_tokens", F.coalesce("least_packs", F.lit(0)).alias("least_packs"), (F.lit(1.0) - F.col("n_tokens") / room).alias("empty_share"))
