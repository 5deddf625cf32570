import itertools
import random

import pytest
from pyspark.sql import functions as F

from landloom.llm import pack as p
from landloom.llm.completion import complete_bins, dominated, fillings, least_packs

CAPS = "pack_name string, capacity_tokens int, rank string"


def check(packed, sizes, caps):
    rows = packed.collect()
    for name, cap in caps.items():
        own = [r for r in rows if r.pack_name == name]
        room = {}
        for r in own:
            room[r.pack_no] = room.get(r.pack_no, 0) + r.n_tokens
        assert max(room.values()) <= cap
        assert sorted(room) == list(range(len(room)))
        whole = {}
        for r in own:
            whole.setdefault(r.doc_id, []).append((r.piece_no, r.n_tokens))
        for d, n in sizes.items():
            pieces = sorted(whole[d])
            assert sum(x for _, x in pieces) == n and [k for k, _ in pieces] == list(range(len(pieces)))
            assert len(pieces) == max(1, -(-n // cap)) and all(x == cap for _, x in pieces[:-1])
    return rows


def test_every_token_once_within_capacity(spark):
    rng = random.Random(2)
    sizes = {i: rng.choice([0, 1, rng.randint(1, 300), rng.randint(1, 3000), 100]) for i in range(800)}
    df = spark.createDataFrame(list(sizes.items()), "doc_id long, n_tokens long")
    caps = {"a": 100, "b": 777, "c": 4096, None: 64}
    frame = spark.createDataFrame([(k, v, "x") for k, v in caps.items()] + [("a", 100, "y"), ("none", None, ""), ("zero", 0, "")], CAPS)
    check(p.pack(df, frame), sizes, caps)
    for r in p.usage(p.pack(df, frame), frame).collect():
        assert r.n_packs <= r.least_packs * 1.02 + 1


def optimal(sizes, cap):
    best = len(sizes)

    def go(rest, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if not rest:
            best = len(bins)
            return
        s, seen = rest[0], set()
        for i, b in enumerate(bins):
            if b + s <= cap and b not in seen:
                seen.add(b)
                go(rest[1:], [*bins[:i], b + s, *bins[i + 1 :]])
        go(rest[1:], [*bins, s])

    go(sorted(sizes, reverse=True), [])
    return best


def test_least_packs_on_small_cases():
    rng = random.Random(1)
    for k in range(400):
        cap = rng.choice([23, 50, 64, 100])
        sizes = [rng.randint(1 if k % 3 else cap // 8, cap if k % 4 == 0 else cap * 2 // 3) for _ in range(rng.randint(1, 11))]
        hist = {s: sizes.count(s) for s in sizes}
        got, proven = complete_bins(hist, cap)
        assert sum(t for _, t in got) == optimal(sizes, cap) >= least_packs(hist, cap) and proven
        left = dict(hist)
        for pattern, t in got:
            assert sum(s * k for s, k in pattern.items()) <= cap
            for s, k in pattern.items():
                left[s] -= k * t
        assert not any(left.values())
    assert sum(t for _, t in complete_bins({4: 1, 5: 1, 6: 1, 7: 1, 8: 1, 12: 2, 13: 1}, 23)[0]) == 3


def test_skewed_sizes_and_large_capacities():
    assert sum(t for _, t in complete_bins({119: 600, 114: 600, 20: 600, 68: 600, 94: 1200}, 256)[0]) == 1200
    assert complete_bins({s: 1 for s in range(1, 1500)}, 1_100_000)[1]
    hist = {s: 1 for s in range(1, 30_000, 7)}
    got, proven = complete_bins(hist, 4_000_000)
    assert proven and sum(t for _, t in got) == least_packs(hist, 4_000_000)


def test_fillings_are_all_maximal_ones_and_dominance_by_brute_force():
    rng = random.Random(5)
    for _ in range(200):
        items = [rng.randint(3, 40) for _ in range(8)]
        counts = {s: items.count(s) for s in items}
        room = rng.randint(10, 120)
        every = {tuple(sorted(c)) for k in range(9) for c in itertools.combinations(items, k) if sum(c) <= room}
        fits = {c for c in every if not any(sum(c) + s <= room and counts[s] > c.count(s) for s in counts)}
        got, whole, _ = fillings(sorted(counts), counts, room, 10**6, room)
        assert whole and {tuple(sorted(s for s, k in f.items() for _ in range(k))) for _, f in got} == fits
        assert max(t for t, _ in got) == max(map(sum, every))
        assert any(not dominated(t, f, sorted(counts), counts, room) for t, f in got)


def test_tiny_sizes_do_not_recurse_deeply():
    got, _ = complete_bins({1: 50_000, 2: 40_000, 8192: 3}, 8192)
    assert sum(t for _, t in got) == 3 + -(-130_000 // 8192)


def test_hot_size(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 1500, 40).otherwise(F.col("id") % 97).cast("long").alias("n_tokens"))
    sizes = {r.doc_id: r.n_tokens for r in df.collect()}
    frame = spark.createDataFrame([("k", 128, "")], CAPS)
    check(p.pack(df, frame), sizes, {"k": 128})
    check(p.pack(df, frame, bucket_items=100), sizes, {"k": 128})


def test_empty_tables_null_texts_and_tokens(spark):
    none = spark.createDataFrame([], "doc_id long, n_tokens long")
    caps = spark.createDataFrame([("k", 128, "")], CAPS)
    assert p.pack(none, caps).count() == 0
    assert p.pack(spark.createDataFrame([(1, 5)], "doc_id long, n_tokens long"), caps.limit(0)).count() == 0
    docs = spark.createDataFrame([(1, None, 9), (2, "", 9), (None, "one two", 9), (4, "word " * 20000, 9), (5, "<|endoftext|>", 9), (6, "\n" * 300000 + "x", 9)], "doc_id long, text string, n_tokens int")
    got = {r.doc_id: r.n_tokens for r in p.count_tokens(docs, p.tokenizer_path()).collect()}
    assert got[1] == 0 and got[2] == 0 and got[None] == 2 and got[4] > 20000 and got[5] > 1 and got[6] > 1
    assert p.pack(p.count_tokens(docs, p.tokenizer_path()), caps).where("doc_id = 1").first().pack_no == 0


def test_long_blanks_equal_the_library():
    e = p.encoder(p.tokenizer_path())
    rng = random.Random(1)
    for _ in range(500):
        t = "".join(rng.choice(["a", " ", "\n", "\t", " " * 5, "\n" * 4, "x1", "!?", "　", "\r\n" * 3]) for _ in range(rng.randint(1, 30)))
        assert p.token_count(e, t, 3) == len(e.encode_ordinary(t))
