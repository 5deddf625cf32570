"""Evaluation texts leaking into training text, by an FM-index per training shard.

Words are symbols. A shard is a bounded number of words: whole documents, and long documents in parts that overlap by a phrase less one word, so that every phrase lies whole in one part.
Per shard all words are indexed: suffix array by prefix doubling (only what is still tied is sorted again), Burrows-Wheeler transform,
wavelet matrix over it. All phrases (every window of min_words words of every passage) are searched backward at once through wavelet ranks, and
occurrences are located by walking back to sampled suffix positions. Neighbouring windows merge into spans to remove, across parts as well.

Test material of up to block_phrases phrases is one block: shards are indexed and searched in one pass over the texts. Larger material comes in blocks, one at a time: the shards' transforms are then written
once to the shared folder, every block is searched against them, and its spans are written before the next block is read. So the texts are read once, the driver holds one block, and nothing
is shuffled; the result has one row per document, item and span.

Defined results: null, empty and blank texts and passages and passages shorter than min_words reveal nothing; repeated documents and items are
reported each; null ids are ordinary values; an empty table gives an empty result; texts may be of any length.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from landloom.session import cut, release

WORD = re.compile(r"[^\W_]+")
DROPPED = dict.fromkeys((0x200B, 0x200C, 0x200D, 0xFEFF, 0x00AD))
SAMPLE = 16
SHARD_WORDS = 1 << 19
BLOCK_PHRASES = 1 << 18
SPANS = "doc_id bigint, item_id bigint, first_word int, end_word int"


def words(text: str | None) -> list[str]:
    """Runs of letters and digits after NFKC, removal of invisible characters, and lower-casing."""
    if not text:
        return []
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text).translate(DROPPED)
    return WORD.findall(text.lower())


def suffix_array(t: np.ndarray) -> np.ndarray:
    """Prefix doubling; t holds non-negative numbers. Each round sorts only the suffixes that are still tied (after Larsson and Sadakane)."""
    n = len(t)
    sa = np.argsort(t, kind="stable")
    if n < 2:
        return sa
    s = t[sa]
    new = np.concatenate([[True], s[1:] != s[:-1]])
    rank = np.empty(n + 1, np.int64)  # rank: the first place of the suffix's group; a suffix beyond the end is least
    rank[n] = -1
    head = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank[sa] = head
    k = 1
    tied = np.flatnonzero(~(new & np.append(new[1:], True)))
    while len(tied):
        at = sa[tied]
        group, after = rank[at], rank[np.minimum(at + k, n)]
        order = np.lexsort((after, group))
        at, group, after = at[order], group[order], after[order]
        sa[tied] = at  # groups are whole runs of places, so the order of places is that of groups
        new = np.concatenate([[True], (group[1:] != group[:-1]) | (after[1:] != after[:-1])])
        rank[at] = tied[np.maximum.accumulate(np.where(new, np.arange(len(tied)), 0))]
        tied = tied[~(new & np.append(new[1:], True))]
        k *= 2
    return sa


class WaveletMatrix:
    def __init__(self, seq: np.ndarray, sigma: int):
        self.levels = max(1, int(sigma - 1).bit_length())
        self.ones: list[np.ndarray] = []
        self.zeros: list[int] = []
        s = seq
        for level in range(self.levels - 1, -1, -1):
            bit = ((s >> level) & 1).astype(bool)
            self.ones.append(np.concatenate([[0], np.cumsum(bit)]).astype(np.int32))
            self.zeros.append(int(len(s) - self.ones[-1][-1]))
            s = np.concatenate([s[~bit], s[bit]])

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of c before position i, for arrays of both."""
        lo, hi = np.zeros_like(i), i
        for k, (ones, zeros) in enumerate(zip(self.ones, self.zeros, strict=True)):
            bit = ((c >> (self.levels - 1 - k)) & 1).astype(bool)
            a, b = ones[lo], ones[hi]
            lo, hi = np.where(bit, zeros + a, lo - a), np.where(bit, zeros + b, hi - b)
        return hi - lo


class FMIndex:
    """Over stretches of symbols 1..sigma-1, each ended by a break (0) of its own that sorts before all symbols.

    Built from the symbols, or from what `parts` gave: the transform, the sampled rows and their positions.
    """

    def __init__(self, symbols: np.ndarray, starts: np.ndarray, sigma: int):
        """starts: first position of each stretch."""
        breaks = symbols == 0
        distinct = np.where(breaks, np.cumsum(breaks) - 1, symbols + int(breaks.sum()))
        sa = suffix_array(distinct)
        marked = np.zeros(len(symbols), bool)
        marked[::SAMPLE] = True
        marked[starts] = True  # a walk never crosses a break
        self._hold(symbols[sa - 1].astype(np.int32), marked[sa], sa[marked[sa]], sigma)

    def _hold(self, bwt: np.ndarray, sampled: np.ndarray, samples: np.ndarray, sigma: int) -> None:
        self.bwt, self.sampled, self.samples, self.sigma = bwt, sampled, samples, sigma
        self.tree = WaveletMatrix(bwt, sigma)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(bwt, minlength=sigma))])[:sigma]
        self.sample_no = np.cumsum(sampled) - 1

    def parts(self) -> tuple[bytes, bytes, bytes]:
        return self.bwt.astype("<i4").tobytes(), np.packbits(self.sampled).tobytes(), self.samples.astype("<i4").tobytes()

    @classmethod
    def of(cls, bwt: bytes, sampled: bytes, samples: bytes, sigma: int) -> FMIndex:
        self = cls.__new__(cls)
        transform = np.frombuffer(bwt, "<i4")
        self._hold(transform, np.unpackbits(np.frombuffer(sampled, np.uint8), count=len(transform)).astype(bool), np.frombuffer(samples, "<i4").astype(np.int64), sigma)
        return self

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each row of symbols its range of suffixes."""
        lo, hi = np.zeros(len(phrases), np.int64), np.full(len(phrases), len(self.bwt), np.int64)
        live = np.arange(len(phrases))
        for k in range(phrases.shape[1] - 1, -1, -1):
            c = phrases[live, k]
            a = self.before[c] + self.tree.rank(c, lo[live])
            b = self.before[c] + self.tree.rank(c, hi[live])
            lo[live], hi[live] = a, b
            live = live[b > a]
            if not len(live):
                break
        hi = np.maximum(hi, lo)
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        out = np.zeros(len(rows), np.int64)
        live, row, step = np.arange(len(rows)), rows.copy(), 0
        while len(live):
            done = self.sampled[row]
            out[live[done]] = self.samples[self.sample_no[row[done]]] + step
            live, row = live[~done], row[~done]
            c = self.bwt[row]
            row = self.before[c] + self.tree.rank(c, row)
            step += 1
        return out


class Phrases:
    """A block of test phrases: its words, the distinct windows and the items of each."""

    def __init__(self, items: Iterable[tuple[int | None, list[str]]], width: int):
        self.width = width
        number: dict[str, int] = {}
        windows: dict[tuple[int, ...], list[int]] = {}
        self.items: list[int | None] = []
        for item, ws in items:
            no = len(self.items)
            self.items.append(item)
            ids = [number.setdefault(w, len(number)) for w in ws]
            for i in range(len(ids) - width + 1):
                windows.setdefault(tuple(ids[i : i + width]), []).append(no)
        self.words = list(number)
        self.windows = np.array(list(windows), np.int32).reshape(len(windows), width)
        owners = [sorted(set(x)) for x in windows.values()]
        self.first = np.concatenate([[0], np.cumsum([len(x) for x in owners])]).astype(np.int64)
        self.owners = np.array([y for x in owners for y in x], np.int64)


def expand(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ranges: (number of the range, value) of each value in it."""
    n = hi - lo
    which = np.repeat(np.arange(len(n)), n)
    return which, np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + lo[which]


class Shard:
    """Parts of documents with their words as numbers 1.. in the order of first sight."""

    def __init__(self):
        self.number: dict[str, int] = {}
        self.parts: list[np.ndarray] = []
        self.ids: list[int | None] = []
        self.offsets: list[int] = []
        self.goes_on = False  # the last document has a further part in the next shard
        self.held = 0

    def add(self, doc_id: int | None, ws: list[str], offset: int) -> None:
        number = self.number
        self.parts.append(np.fromiter((number.setdefault(w, len(number) + 1) for w in ws), np.int64, len(ws)))
        self.ids.append(doc_id)
        self.offsets.append(offset)
        self.held += len(ws) + 1

    def index(self) -> tuple[FMIndex, np.ndarray]:
        symbols = np.concatenate([np.append(s, 0) for s in self.parts])
        starts = np.concatenate([[0], np.cumsum([len(s) + 1 for s in self.parts])[:-1]]).astype(np.int64)
        return FMIndex(symbols, starts, len(self.number) + 1), starts


def shards(batches: Iterator[pa.RecordBatch], width: int, size: int) -> Iterator[Shard]:
    """(doc_id, text) in shards of about `size` words."""
    shard = Shard()
    for b in batches:
        for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            ws = words(text.as_py())
            at = 0
            while len(ws) - at >= width:
                part = ws[at : at + max(size, width)]
                shard.add(doc_id, part, at)
                at += len(part) - width + 1
                shard.goes_on = len(ws) - at >= width
                if shard.held >= size:
                    yield shard
                    shard = Shard()
    if shard.parts:
        yield shard


def merged(doc: np.ndarray, item: np.ndarray, first: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
    """Spans of a document and item that touch or overlap made one."""
    order = np.lexsort((first, item, doc))
    doc, item, first, end = doc[order], item[order], first[order], end[order]
    if not len(doc):
        return [doc, item, first, end]
    same = (doc[1:] == doc[:-1]) & (item[1:] == item[:-1])
    group = np.concatenate([[0], np.cumsum(~same)])
    far = int(end.max()) + 1
    reach = np.maximum.accumulate(end + group * far) - group * far
    heads = np.flatnonzero(np.concatenate([[True], ~same | (first[1:] > reach[:-1])]))
    return [doc[heads], item[heads], first[heads], reach[np.append(heads[1:], len(doc)) - 1]]


def search_shard(index: FMIndex, starts: np.ndarray, offsets: np.ndarray, number: dict[str, int], phrases: Phrases) -> list[np.ndarray]:
    """(part number, item number, first word, end word) of merged occurrences in a shard."""
    known = np.array([number.get(w, 0) for w in phrases.words], np.int64)
    here = known[phrases.windows] if len(phrases.windows) else np.zeros((0, phrases.width), np.int64)
    possible = np.flatnonzero((here > 0).all(1))  # a phrase with a word that the shard lacks isn't in it
    lo, hi = index.search(here[possible])
    which, rows = expand(lo, hi)
    at = index.locate(rows)
    part = np.searchsorted(starts, at, side="right") - 1
    first = at - starts[part] + offsets[part]
    window = possible[which]
    which, owner = expand(phrases.first[window], phrases.first[window + 1])
    return merged(part[which], phrases.owners[owner], first[which], first[which] + phrases.width)


def _report(found: Iterator[tuple[list[int | None], bool, list[np.ndarray]]], phrases: Phrases) -> Iterator[pa.RecordBatch]:
    """Rows of spans; those of a document that goes on in the next shard wait for it. found: ids of a shard's parts, whether the last goes on, its spans."""
    waiting: list[np.ndarray] = []
    for ids, goes_on, (part, item, first, end) in found:
        part = part.copy()
        if waiting:  # the first part goes on with the document that waits
            item, first, end = (np.concatenate([w, x]) for w, x in zip(waiting[1:], (item, first, end), strict=True))
            part = np.concatenate([np.zeros(len(waiting[0]), np.int64), part])
            part, item, first, end = merged(part, item, first, end)
            waiting = []
        ready = np.ones(len(part), bool)
        if goes_on:
            ready = part < len(ids) - 1
            waiting = [x[~ready] for x in (part, item, first, end)]
        yield _rows(ids, phrases, part[ready], item[ready], first[ready], end[ready])
        last = ids[-1]
    if waiting and len(waiting[0]):
        yield _rows([last], phrases, np.zeros(len(waiting[0]), np.int64), *waiting[1:])


def _rows(ids: list, phrases: Phrases, part: np.ndarray, item: np.ndarray, first: np.ndarray, end: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([ids[x] for x in part], pa.int64()), pa.array([phrases.items[x] for x in item], pa.int64()), pa.array(first.astype(np.int32)), pa.array(end.astype(np.int32))], ["doc_id", "item_id", "first_word", "end_word"])


def _searcher(phrases: Phrases, shard_words: int):
    def found(batches: Iterator[pa.RecordBatch]):
        for s in shards(batches, phrases.width, shard_words):
            index, starts = s.index()
            yield s.ids, s.goes_on, search_shard(index, starts, np.array(s.offsets), s.number, phrases)

    return lambda batches: _report(found(batches), phrases)


INDEX = "task int, no int, goes_on boolean, ids array<bigint>, offsets array<int>, starts array<int>, words array<string>, bwt binary, sampled binary, samples binary"


def _indexer(width: int, shard_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        for no, s in enumerate(shards(batches, width, shard_words)):
            index, starts = s.index()
            values = [task, no, s.goes_on, s.ids, s.offsets, starts.tolist(), list(s.number), *index.parts()]
            kinds = [pa.int32(), pa.int32(), pa.bool_(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.string()), pa.binary(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], [x.split()[0] for x in INDEX.split(", ")])

    return run


def _index_searcher(phrases: Phrases):
    """Over shards in order of task and number: parts of a document stand in neighbouring shards of one task."""

    def found(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            for r in b.to_pylist():
                index = FMIndex.of(r["bwt"], r["sampled"], r["samples"], len(r["words"]) + 1)
                yield r["ids"], r["goes_on"], search_shard(index, np.array(r["starts"], np.int64), np.array(r["offsets"], np.int64), {w: i + 1 for i, w in enumerate(r["words"])}, phrases)

    return lambda batches: _report(found(batches), phrases)


def blocks(items: DataFrame, item_id: str, passage: str, width: int, most: int) -> Iterator[Phrases]:
    """The test material in blocks of at most about `most` phrases; only one block is built at a time."""
    held: list[tuple[int | None, list[str]]] = []
    size = 0
    for item, text in items.select(item_id, passage).toLocalIterator():
        ws = words(text)
        if len(ws) < width:
            continue
        held.append((item, ws))
        size += len(ws) - width + 1
        if size >= most:
            yield Phrases(held, width)
            held, size = [], 0
    if held:
        yield Phrases(held, width)


def leaked_spans(documents: DataFrame, items: DataFrame, min_words: int = 13, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", passage: str = "passage", shard_words: int = SHARD_WORDS, block_phrases: int = BLOCK_PHRASES) -> DataFrame:
    """(doc_id, item_id, first_word, end_word): where a document holds min_words or more consecutive words of an item's passage."""
    texts = documents.select(documents[doc_id].cast("bigint").alias("doc_id"), documents[text].alias("text"))
    todo = blocks(items, item_id, passage, min_words, block_phrases)
    phrases, more = next(todo, None), next(todo, None)
    if phrases is None:
        return documents.sparkSession.createDataFrame([], SPANS)
    if more is None:
        return texts.mapInArrow(_searcher(phrases, shard_words), SPANS)
    index = cut(texts.mapInArrow(_indexer(min_words, shard_words), INDEX))
    ordered = index.repartition("task").sortWithinPartitions("task", "no")
    found = None
    while phrases is not None:
        part = cut(ordered.mapInArrow(_index_searcher(phrases), SPANS))
        found = part if found is None else found.unionByName(part)
        phrases, more = more, next(todo, None)
    release(index)
    return found
