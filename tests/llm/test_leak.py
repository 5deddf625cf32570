import random

import numpy as np

from landloom.llm import leak


def test_words():
    assert leak.words("Ａb​c—d_e 1½\nÉtÉ ﬁn") == ["abc", "d", "e", "11", "2", "été", "fin"]
    assert leak.words(None) == [] and leak.words("") == [] and leak.words(" \n-_") == []


def test_suffix_array_and_index_against_brute_force():
    rng = np.random.default_rng(0)
    for _ in range(20):
        t = rng.integers(0, 4, rng.integers(1, 200))
        want = sorted(range(len(t)), key=lambda i: t[i:].tolist())
        assert leak.suffix_array(t).tolist() == want
    t = np.tile(rng.integers(0, 3, 7), 60)  # long ties
    assert leak.suffix_array(t).tolist() == sorted(range(len(t)), key=lambda i: t[i:].tolist())
    for _ in range(10):
        parts = [rng.integers(1, 5, rng.integers(3, 60)) for _ in range(rng.integers(1, 12))]
        symbols = np.concatenate([np.append(p, 0) for p in parts])
        starts = np.concatenate([[0], np.cumsum([len(p) + 1 for p in parts])[:-1]])
        index = leak.FMIndex(symbols, starts, 5)
        q = rng.integers(1, 5, (30, 3))
        lo, hi = index.search(q)
        for k in range(30):
            want = [i for i in range(len(symbols) - 2) if (symbols[i : i + 3] == q[k]).all()]
            assert sorted(index.locate(np.arange(lo[k], hi[k])).tolist()) == want


def brute(docs, items, n):
    out = set()
    for d, text, *_ in docs:
        w = leak.words(text)
        have = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
        for i, passage, *_ in items:
            v = leak.words(passage)
            if any(tuple(v[k : k + n]) in have for k in range(len(v) - n + 1)):
                out.add((d, i))
    return out


def run(spark, docs, items, n=4, **kw):
    D = spark.createDataFrame(docs, "doc_id long, text string, item_id int")
    I = spark.createDataFrame(items, "item_id long, passage string, doc_id int")
    return leak.leaked_spans(D, I, n, **kw)


def test_against_brute_force_with_small_shards_and_blocks(spark):
    rng = random.Random(4)
    text = lambda n: " ".join(rng.choice("abcdefgh") + rng.choice(["", "!", "\n"]) for _ in range(n))
    items = [(i, text(rng.randint(2, 12)), 0) for i in range(40)] + [(90, None, 0), (91, "a b", 0), (92, "", 0)]
    docs = [(i, text(rng.randint(0, 120)), 0) for i in range(150)] + [(900, None, 0), (901, "", 0), (None, items[5][1], 0)]
    docs += [(1000 + k, "zz " + items[7][1] + " zz", 0) for k in range(80)]
    for kw in ({}, {"shard_words": 50}, {"shard_words": 50, "block_phrases": 20}):
        got = {(r.doc_id, r.item_id) for r in run(spark, docs, items, **kw).collect()}
        assert got == brute(docs, items, 4)


def test_spans_merge_and_tell_where(spark):
    r = run(spark, [(1, "x x a b c d e f x a b c d", 0)], [(5, "A, b c\n d e f", 0)]).orderBy("first_word").collect()
    assert [(x.first_word, x.end_word) for x in r] == [(2, 8), (9, 13)]


def test_empty_tables_and_long_texts(spark):
    assert run(spark, [], [(1, "a b c d e", 0)]).count() == 0
    assert run(spark, [(1, "a b c d e", 0)], []).count() == 0
    long = "q w " * 200_000 + "a b c d " + "w q " * 200_000
    assert [tuple(r) for r in run(spark, [(1, long, 0)], [(1, "a b c d", 0)]).collect()] == [(1, 1, 400000, 400004)]
    for kw in ({"shard_words": 1000}, {"shard_words": 1000, "block_phrases": 1}):  # a document in many parts, spans merged across them
        docs, items = [(1, "x " * 990 + "a b c d " * 700 + "y", 0), (2, "a b c d", 0)], [(1, "a b c d", 0), (2, "b c d a b c d a b c", 0)]
        got = {tuple(r) for r in run(spark, docs, items, **kw).collect()}
        assert got == {(1, 1, 990, 3790), (1, 2, 990, 3790), (2, 1, 0, 4), (2, 2, 0, 4)}
    same = "a b c d " * 20_000  # occurrences that touch merge into one span
    assert run(spark, [(1, same, 0)], [(1, "a b c d", 0)]).count() == 1
    assert run(spark, [(1, same, 0)], [(1, "a b c d a b c d a b c d", 0)]).count() == 1
