"""Reading level of each document's prose, by regularised ordinal regression calibrated to graded texts.

Three steps, the texts being read once:

1. `prose_features`: per document the prose (message without header, trailer, quoted code and diff, plus sentences in diffs) and its features: length, sentence
   length, word length, lexical diversity, connectives, clause-depth proxy; with it the hash buckets of its words. Written to the shared folder.
2. `rarity_table`: word counts over the prose of all documents, in a table of fixed size (2^20 hash buckets, counted per partition, then summed), so what is sent to
   the tasks doesn't grow with the corpus. Word rarity is the mean and the upper part of log(all words / count of the bucket).
3. `fit` on marks: proportional odds with ridge penalty and an offset per rater, fitted on at most `most_marks` marks (a documented bound: chosen by hash,
   20,000 by default); `levels` scores all documents with the expected grade and the likeliest level.

Defined results: null, blank and prose-less texts (fewer than min_words words) come out with null grade and level; marks that are null or
outside 1..5 or repeated are left out, null raters are one rater; without usable marks of at least two grades all grades are null; ties between levels go to the
easier one; texts of any length count in full; languages other than English get an estimate too, marked english = false, as no such text is graded.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 20
GRADES = 5
MIN_WORDS = 5
# Function words of English that open or join clauses.
CONNECTIVES = frozenset(
    "because although though unless whereas while since therefore thus hence however consequently moreover furthermore nevertheless nonetheless otherwise instead thereby whereby albeit hitherto "
    "accordingly meanwhile subsequently despite notwithstanding provided whenever wherever until once after before so but then also".split()
)
SUBORDINATORS = frozenset("that which who whom whose where when if whether why how as than being having should were lest".split())
ENGLISH = frozenset("the of and to in is was it for on that this with not we be are you by an at from or as our your will can did does its has had should".split())

_START_OF_DIFF = re.compile(r"^(?:diff --git |Index: |--- a/|--- /dev/null|@@ -|Binary files |GIT binary patch)", re.M)
_HEADER = re.compile(r"^(?:From [0-9a-f]{40} |commit [0-9a-f]{7,40}$|tree [0-9a-f]{7,40}$|parent [0-9a-f]{7,40}$|Merge: |Author: |AuthorDate: |Commit: |CommitDate: |Date: |From: |To: |Cc: )", re.I)
_TRAILER = re.compile(r"^(?:[A-Z][a-z]+(?:-[A-Za-z]+)*-by: |Closes |Fixes #|Refs |See #|Change-Id: |Merge (?:pull request|branch|commit|remote|tag) |\[skip ci\]|-- $|---$)", re.I)
_SUBJECT = re.compile(r"^Subject:\s*(?:\[[^\]]*\]\s*)*", re.I)
_DIFF_PROSE = re.compile(r"^[+ ]\s*(?:[-*] )?([A-Z][^{}<>=;_()\[\]|\\]{30,}[.!?])\s*$", re.M)
_WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
_SENTENCE = re.compile(r"[.!?]+(?=\s|$)|\n\s*\n")
FEATURES = ("log_words", "sentence_words", "word_letters", "long_share", "very_long_share", "diversity", "local_diversity", "connectives", "clauses", "most_clauses")
RARITY = ("rarity_mean", "rarity_upper", "rarity_top")
SHAPE = "doc_id bigint, n_words int, english boolean, features array<double>, buckets binary"


def prose(text: str | None) -> str:
    if not text:
        return ""
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    cut = _START_OF_DIFF.search(text)
    message, diff = (text[: cut.start()], text[cut.start() :]) if cut else (text, "")
    lines = []
    for line in message.split("\n"):
        bare = line.strip()
        if _HEADER.match(line) or _TRAILER.match(bare):
            continue
        if line.startswith("Subject:"):
            line = _SUBJECT.sub("", line) + "\n"
            bare = line
        lines.append(bare)
    parts = ["\n".join(lines)]
    if diff:
        parts += _DIFF_PROSE.findall(diff)
    return "\n\n".join(parts)


def features(text: str) -> tuple[int, bool, list[float], list[str]]:
    lower = text.lower()
    counts, ws = [], []
    most = marks = joins = 0
    for sentence in _SENTENCE.split(lower):
        own = _WORD.findall(sentence)
        if len(own) < 3:
            ws += own
            continue
        c = sum(w in CONNECTIVES for w in own)
        m = c + sum(w in SUBORDINATORS for w in own) + sentence.count(",") + sentence.count(";") + sentence.count(":")
        counts.append(len(own))
        joins += c
        marks += m
        most = max(most, m)
        ws += own
    n = len(ws)
    if not n:
        return 0, False, [0.0] * len(FEATURES), ws
    letters = [len(w) for w in ws]
    s = max(1, len(counts))
    parts = [ws[i : i + 25] for i in range(0, n, 25)]
    local = sum(len(set(p)) for p in parts) / n
    english = sum(w in ENGLISH for w in ws) / n >= 0.12
    return n, english, [float(np.log1p(n)), float(np.log1p(sum(counts) / s)), sum(letters) / n, sum(x >= 8 for x in letters) / n, sum(x >= 12 for x in letters) / n, len(set(ws)) / float(np.sqrt(2 * n)), local, joins / s, marks / s, float(np.log1p(most))], ws


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[str, int] = {}
    for b in batches:
        ns, en, fs, bs = [], [], [], []
        for t in b.column(1):
            n, e, f, ws = features(prose(t.as_py()))
            for w in ws:
                if w not in known:
                    if len(known) > 500_000:
                        known.clear()
                    known[w] = crc32(w.encode("utf-8", "replace")) % BUCKETS
            ns.append(n)
            en.append(e)
            fs.append(f)
            bs.append(np.fromiter((crc32(w.encode("utf-8", "replace")) % BUCKETS if (k := known.get(w)) is None else k for w in ws), "<i4", n).tobytes())
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ns, pa.int32()), pa.array(en, pa.bool_()), pa.array(fs, pa.list_(pa.float64())), pa.array(bs, pa.binary())], ["doc_id", "n_words", "english", "features", "buckets"])


def prose_features(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    return documents.select(documents[doc_id].cast("bigint").alias("doc_id"), documents[text].cast("string").alias("text")).mapInArrow(_extract, SHAPE)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(BUCKETS, np.int64)
    for b in batches:
        for x in b.column(0):
            np.add.at(total, np.frombuffer(x.as_py(), "<i4"), 1)
    at = np.flatnonzero(total)
    for i in range(0, len(at), 65536):
        yield pa.RecordBatch.from_arrays([pa.array(at[i : i + 65536].astype(np.int32)), pa.array(total[at[i : i + 65536]])], ["bucket", "n"])


def rarity_table(prosed: DataFrame) -> np.ndarray:
    """log(all words / words in the bucket) for each of the fixed number of buckets."""
    counts = prosed.select("buckets").mapInArrow(_count, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    table = np.zeros(BUCKETS)
    table[np.asarray(counts["bucket"])] = np.asarray(counts["n"])
    return np.log((table.sum() + 1.0) / (table + 1.0)).astype(np.float32)


def _with_rarity(table: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for f, x in zip(b.column(3).to_pylist(), b.column(4), strict=True):
                r = np.sort(table[np.frombuffer(x.as_py(), "<i4")])
                k = len(r)
                rows.append(f + ([float(r.mean()), float(r[k // 2 :].mean()), float(r[k - k // 10 - 1 :].mean())] if k else [0.0] * 3))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(rows, pa.list_(pa.float64()))], ["doc_id", "n_words", "english", "features"])

    return run


def full_features(prosed: DataFrame, table: np.ndarray) -> DataFrame:
    return prosed.mapInArrow(_with_rarity(table), "doc_id bigint, n_words int, english boolean, features array<double>")


def _sigmoid(v: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(v, -40, 40)))


class Ordinal:
    """Proportional odds: P(grade <= k) = sigmoid(cut_k - w.x - offset of the rater)."""

    def __init__(self, ridge: float = 3.0, rater_ridge: float = 10.0):
        self.ridge, self.rater_ridge = ridge, rater_ridge

    def fit(self, x: np.ndarray, y: np.ndarray, raters: np.ndarray) -> Ordinal:
        self.mean, self.std = x.mean(0), np.maximum(x.std(0), 1e-9)
        names, who = np.unique(raters, return_inverse=True)
        z = np.hstack([(x - self.mean) / self.std, np.eye(len(names))[who]])
        d, k = z.shape[1], GRADES - 1
        share = np.clip(np.cumsum(np.bincount(y, minlength=GRADES + 1)[1:GRADES]) / len(y), 0.01, 0.99)
        cuts = np.maximum.accumulate(np.log(share / (1 - share)) + np.arange(k) * 1e-3)
        theta = np.concatenate([np.zeros(d), cuts])
        penalty = np.concatenate([np.full(x.shape[1], self.ridge), np.full(len(names), self.rater_ridge), np.full(k, 1e-6)])
        upper = np.zeros((len(y), k))
        lower = np.zeros((len(y), k))
        upper[np.flatnonzero(y <= k), y[y <= k] - 1] = 1
        lower[np.flatnonzero(y >= 2), y[y >= 2] - 2] = 1

        def parts(t: np.ndarray) -> tuple[float, np.ndarray]:
            eta = z @ t[:d]
            a = np.where(y <= k, _sigmoid(upper @ t[d:] - eta), 1.0)
            b = np.where(y >= 2, _sigmoid(lower @ t[d:] - eta), 0.0)
            p = np.maximum(a - b, 1e-12)
            ga, gb = np.where(y <= k, a * (1 - a), 0) / p, np.where(y >= 2, b * (1 - b), 0) / p
            rows = np.hstack([-(ga - gb)[:, None] * z, ga[:, None] * upper - gb[:, None] * lower])
            return float(np.log(p).sum() - 0.5 * (penalty * t * t).sum()), rows

        value, rows = parts(theta)
        for _ in range(200):
            gradient = rows.sum(0) - penalty * theta
            step = np.linalg.solve(rows.T @ rows + np.diag(penalty), gradient)
            scale = 1.0
            while scale > 1e-6:
                new = theta + scale * step
                if (np.diff(new[d:]) > 0).all():
                    v, r = parts(new)
                    if v > value:
                        break
                scale /= 2
            else:
                break
            gain, theta, value, rows = v - value, new, v, r
            if gain < 1e-7 * abs(value):
                break
        self.weights, self.cuts = theta[: x.shape[1]], theta[d:]
        return self

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        eta = (x - self.mean) / self.std @ self.weights
        below = np.hstack([_sigmoid(self.cuts[None, :] - eta[:, None]), np.ones((len(x), 1))])
        return np.diff(np.hstack([np.zeros((len(x), 1)), below]), axis=1)


def clean_marks(marks: DataFrame) -> DataFrame:
    return marks.where(F.col("doc_id").isNotNull() & F.col("grade_mark").between(1, GRADES)).select("doc_id", F.coalesce("rater", F.lit("")).alias("rater"), F.col("grade_mark").cast("int").alias("grade"), "marked_at").distinct()


def fit(full: DataFrame, marks: DataFrame, most_marks: int = 20_000, min_words: int = MIN_WORDS) -> Ordinal | None:
    rows = clean_marks(marks).join(full.where(F.col("n_words") >= min_words), "doc_id")
    sample = rows.orderBy(F.xxhash64("doc_id", "rater", "grade"), "doc_id", "rater", "grade").limit(most_marks).select("features", "grade", "rater").toPandas()
    if sample["grade"].nunique() < 2:
        return None
    return Ordinal().fit(np.array(sample["features"].tolist()), sample["grade"].to_numpy(np.int64), sample["rater"].to_numpy(str))


LEVELS = "doc_id bigint, n_words int, english boolean, grade double, level int"


def levels(full: DataFrame, model: Ordinal | None, min_words: int = MIN_WORDS) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            enough = np.asarray(b.column(1)) >= min_words
            k = b.num_rows
            grade, level = np.zeros(k), np.zeros(k, np.int32)
            if model is not None and enough.any():
                p = model.probabilities(np.asarray(b.column(3).flatten()).reshape(k, -1)[enough])
                grade[enough], level[enough] = p @ np.arange(1, GRADES + 1), p.argmax(1) + 1
            off = ~enough if model is not None else np.ones(k, bool)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(grade, mask=off), pa.array(level, mask=off)], ["doc_id", "n_words", "english", "grade", "level"])

    return full.mapInArrow(run, LEVELS)
