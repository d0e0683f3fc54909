"""Quality classifier: ordinal cumulative-link regression on graded ratings.

One weight vector over hashed text features is shared by all grades: the shares of trigrams of character shapes and of
words, hashed to 2**BITS slots, and marks of repetition (how varied the words and runs of three words are, how often a word repeats
the one before it, the share of the most frequent word, and the share of lines said before), each a level in slots of its own. Ordered
thresholds t_1 < ... < t_{K-1} cut the latent score: P(grade >= k) = sigmoid(s(x) - t_k). Expected grade and tail probability follow, and the tail
probability at ``cut`` selects documents.

Ratings: ``grade`` of the labels. The tables give a quality and a toxicity mark, which the
query turns into three grades: 0 poor, 1 fair (well written but toxic), 2 good.

Defined results: a null or empty text has no features and gets the intercept's probabilities; it
is kept only if they reach the threshold; rows with a null doc_id are scored like any other;
repeated rows give repeated results; whole texts are read; an empty table gives an empty result;
without two grades in the labels everything is kept; extra columns are ignored or kept; repeated labelled rows are learned from once.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import pairwise
from tempfile import TemporaryFile

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .kernel import Words, mix, span_hash, words
from .work import labelled, scratch

BITS = 16
MARKS, LEVELS = 5, 16
SIZE = (1 << BITS) + MARKS * LEVELS
#: Spread (of a share over the sample) below which a feature isn't magnified further, so that rare features can't drown the marks.
FLOOR = 0.05
#: Features of the sample in the driver's memory at once (the rest waits in a file that each step reads), and bytes of its text that come to the driver at once.
ROOM, SLICE = 1 << 21, 4 << 20

# Shape of a byte: letters and digits by kind, white space by kind, every sign as itself.
_SHAPE = np.arange(256, dtype=np.uint32)
_SHAPE[65:91] = 65
_SHAPE[97:123] = 97
_SHAPE[48:58] = 48
_SHAPE[128:] = 97


@dataclass
class Ordinal:
    weight: np.ndarray
    cuts: np.ndarray
    grades: np.ndarray

    def score(self, w: Words) -> np.ndarray:
        f, first = hashed(w)
        total = np.zeros(len(f) + 1)
        np.cumsum(self.weight[f], out=total[1:])
        n = np.diff(first)
        share = (total[first[1:]] - total[first[:-1]]) / np.maximum(n, 1)
        return np.where(n > 0, share + self.weight[marks(w)].sum(1), 0.0)

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1.. of each row."""
        return 1 / (1 + np.exp(-np.clip(score[:, None] - self.cuts[None, :], -40, 40)))


def hashed(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of the chunk's documents, one after another, and their offsets.

    Trigrams that run over the end of a document are cut off with it.
    """
    raw = _SHAPE[w.raw]
    n = len(raw)
    tri = np.zeros(0, np.int64)
    at = np.zeros(0, np.int64)
    if n >= 3:
        code = raw[:-2] | (raw[1:-1] << np.uint32(8)) | (raw[2:] << np.uint32(16))
        tri = ((code * np.uint32(2654435761)) >> np.uint32(32 - BITS)).astype(np.int64)
        good = np.ones(n - 2, bool)
        for k in (1, 2):
            cross = w.at[1:-1] - k
            good[cross[(cross >= 0) & (cross < n - 2)]] = False
        at = np.flatnonzero(good)
        tri = tri[at]
    top = np.uint64(64 - BITS)
    word = ((w.hash ^ np.uint64(0x5BD1E995)) >> top).astype(np.int64)
    a = np.searchsorted(at, w.at, "left")
    first = a + w.first
    out = np.empty(len(tri) + len(word), np.int64)
    doc = np.searchsorted(w.at, at, "right") - 1
    out[np.arange(len(tri)) + w.first[doc]] = tri
    out[np.arange(len(word)) + a[w.doc + 1]] = word
    return out, first


def _variety(doc: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of each document, and how often the most frequent one occurs."""
    order = np.lexsort((h, doc))
    d, h = doc[order], h[order]
    at = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (h[1:] != h[:-1])])) if len(h) else np.zeros(0, np.int64)
    most = np.zeros(n, np.int64)
    np.maximum.at(most, d[at], np.diff(np.append(at, len(h))))
    return np.bincount(d[at], minlength=n), most


def marks(w: Words) -> np.ndarray:
    """(documents, MARKS) slots: the level of each mark of repetition."""
    n = np.diff(w.first)
    many = np.log1p(n)
    x = np.zeros((w.n, MARKS))
    distinct, most = _variety(w.doc, w.hash, w.n)
    x[:, 0] = np.log1p(distinct) / np.maximum(many, 1e-9)  # logarithms: about the same for texts of any length
    if len(w.hash) > 2:
        run = mix(w.hash[:-2] * np.uint64(3) + mix(w.hash[1:-1] * np.uint64(5) + w.hash[2:]))
        inside = w.doc[:-2] == w.doc[2:]
        runs, _ = _variety(w.doc[:-2][inside], run[inside], w.n)
        x[:, 1] = np.log1p(runs) / np.maximum(np.log1p(np.maximum(n - 2, 0)), 1e-9)
    same = np.zeros(len(w.hash), bool)
    same[1:] = (w.hash[1:] == w.hash[:-1]) & (w.doc[1:] == w.doc[:-1])
    x[:, 2] = np.sqrt(np.bincount(w.doc[same], minlength=w.n) / np.maximum(n, 1))
    x[:, 3] = np.sqrt(most / np.maximum(n, 1))
    begin = np.unique(np.concatenate([w.at[:-1], np.flatnonzero(w.raw == 10) + 1]))
    begin = begin[begin < len(w.raw)]
    end = np.append(begin[1:], len(w.raw))
    full = end - begin > 1
    own = np.searchsorted(w.at, begin[full], "right") - 1
    lines = np.bincount(own, minlength=w.n)
    seen, _ = _variety(own, span_hash(w.low, begin[full], end[full]), w.n)
    x[:, 4] = np.sqrt((lines - seen) / np.maximum(lines, 1))
    level = np.minimum((np.clip(x, 0, 1) * LEVELS).astype(np.int64), LEVELS - 1)
    return (1 << BITS) + np.arange(MARKS) * LEVELS + level


def _sparse(batches, label: str):
    """(id, grade, sorted feature numbers, shares) of each labelled document."""
    for b in batches:
        fs, vs = [], []
        for w in words(b.column("text")):
            f, first = hashed(w)
            own = marks(w)
            for d in range(w.n):
                u, c = np.unique(f[first[d] : first[d + 1]], return_counts=True)
                m = own[d] if len(u) else own[d, :0]
                fs.append(np.concatenate([u, m]).astype("<u4").tobytes())
                vs.append(np.concatenate([c / max(1, c.sum()), np.ones(len(m))]).astype(np.float32).tobytes())
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column(label), pa.array(fs, pa.binary()), pa.array(vs, pa.binary())], names=["doc_id", label, "f", "v"])


def gradient(w: np.ndarray, theta: np.ndarray, f: np.ndarray, v: np.ndarray, row: np.ndarray, y: np.ndarray, balance: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Mean negative log-likelihood of grades ``y``, and its gradients by the weights and by ``theta``.

    Rows are sparse: feature ``f`` has the value ``v`` in ``row``. ``theta``: first threshold, then logarithms of the gaps.
    """
    n, k = len(y), len(theta) + 1
    cuts = theta[0] + np.concatenate([[0.0], np.cumsum(np.exp(theta[1:]))])
    s = np.bincount(row, v * w[f], n)
    p = 1 / (1 + np.exp(-np.clip(s[:, None] - cuts, -40, 40)))
    full = np.concatenate([np.ones((n, 1)), p, np.zeros((n, 1))], 1)
    r = np.arange(n)
    mass = np.maximum(full[r, y] - full[r, y + 1], 1e-9)
    slope = np.concatenate([np.zeros((n, 1)), p * (1 - p), np.zeros((n, 1))], 1)
    hi, lo = slope[r, y] / mass, slope[r, y + 1] / mass  # d log-likelihood / d (s - t_y), -(s - t_{y+1})
    gs = -(hi - lo) * balance / n
    gcut = np.array([((hi * balance)[y == j].sum() - (lo * balance)[y == j - 1].sum()) / n for j in range(1, k)])
    back = np.concatenate([[gcut.sum()], [gcut[j:].sum() * np.exp(theta[j]) for j in range(1, k - 1)]])
    return float(-(balance * np.log(mass)).mean()), np.bincount(f, v * gs[row], len(w)), back


def _gather(own: DataFrame, files: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Grades and numbers of features of the sample, by id and text; features and shares go to the two files, slice after slice."""
    octets = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(own.sparkSession.sparkContext.defaultParallelism, -(-octets // SLICE))
    rows = own.withColumn("_h", F.xxhash64("text")).repartitionByRange(parts, "doc_id", "_h").sortWithinPartitions("doc_id", "_h")
    grades, sizes = [], []
    for r in rows.mapInArrow(lambda it: _sparse(it, "_grade"), "doc_id long, _grade int, f binary, v binary").toLocalIterator(prefetchPartitions=True):
        grades.append(r["_grade"])
        sizes.append(len(r["f"]) // 4)
        for file, part in zip(files, (r["f"], r["v"])):
            file.write(part)
    for file in files:
        file.flush()
    return np.array(grades, np.int64), np.array(sizes, np.int64)


def fit_ordinal(docs: DataFrame, labels: DataFrame, grade: Column, sample: int = 4_000, steps: int = 250, rate: float = 0.5, penalty: float = 1e-4) -> Ordinal:
    """Fits on at most ``sample`` labelled documents, gathered as sparse rows; however long their texts are, ``ROOM`` features are in memory at once."""
    rated = labels.withColumn("_grade", grade.cast("int")).where("_grade IS NOT NULL").select("doc_id", "_grade")
    with scratch(docs.sparkSession), TemporaryFile() as ffile, TemporaryFile() as vfile:
        given, sizes = _gather(labelled(docs.sparkSession, docs, rated, sample), (ffile, vfile))
        first = np.concatenate([[0], np.cumsum(sizes)])
        fs, vs = (np.memmap(x, kind, "r") if first[-1] else np.zeros(0, kind) for x, kind in ((ffile, "<u4"), (vfile, "<f4")))
    grades, y = np.unique(given, return_inverse=True)
    size = SIZE
    k = len(grades)
    if k < 2:
        return Ordinal(np.zeros(size), np.zeros(0), grades)
    n = len(y)
    begin = [0]
    while begin[-1] < n:
        begin.append(max(begin[-1] + 1, int(np.searchsorted(first, first[begin[-1]] + ROOM, "right")) - 1))

    def chunks():
        for a, b in pairwise(begin):
            own = slice(first[a], first[b])
            yield fs[own].astype(np.int64), vs[own].astype(np.float64), np.repeat(np.arange(b - a), sizes[a:b]), slice(a, b)

    # Each feature in units of its spread, so that rare and frequent ones learn alike.
    spread = np.sqrt(sum(np.bincount(f, v * v, size) for f, v, _, _ in chunks()) / n) + FLOOR
    scaled = lambda: ((f, v / spread[f], row, own) for f, v, row, own in chunks())
    held = list(scaled()) if len(begin) == 2 else None
    share = np.bincount(y, minlength=k) / n
    tail = np.clip(1 - np.cumsum(share)[:-1], 1e-3, 1 - 1e-3)
    # theta: first threshold, then logarithms of the gaps, which keep the thresholds ordered
    t0 = -np.log(tail / (1 - tail))
    theta = np.concatenate([t0[:1], np.log(np.maximum(np.diff(t0), 1e-2))])
    w = np.zeros(size)
    gw, gt = np.full(size, 1e-8), np.full(len(theta), 1e-8)
    balance = (1 / np.maximum(share * k, 0.05))[y]
    balance /= balance.mean()
    for _ in range(steps):
        g, back = np.zeros(size), np.zeros(len(theta))
        for f, v, row, own in held or scaled():
            _, dw, dt = gradient(w, theta, f, v, row, y[own], balance[own])
            part = len(y[own]) / n
            g += dw * part
            back += dt * part
        g += penalty * w
        gw += g * g
        gt += back * back
        w -= rate * 0.1 * g / np.sqrt(gw)
        theta = theta - rate * 0.1 * back / np.sqrt(gt)
    cuts = theta[0] + np.concatenate([[0.0], np.cumsum(np.exp(theta[1:]))])
    return Ordinal(w / spread, cuts, grades)


def _judge(batch: pa.RecordBatch, model: Ordinal) -> np.ndarray:
    parts = [model.score(w) for w in words(batch.column("text"))]
    return np.concatenate(parts or [np.zeros(0)])


def quality(docs: DataFrame, model: Ordinal, cut: int = 1, threshold: float = 0.5) -> DataFrame:
    """doc_id, expected_grade, tail_probability (of a grade of at least ``cut``), keep."""
    at = int(np.searchsorted(model.grades, cut)) - 1

    def run(batches):
        for b in batches:
            tails = model.tails(_judge(b, model))
            expected = model.grades[0] + tails @ np.diff(model.grades) if len(model.grades) else np.zeros(len(tails))
            tail = tails[:, at] if 0 <= at < tails.shape[1] else np.ones(len(tails))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.round(np.broadcast_to(expected, len(tails)).astype(float), 6)), pa.array(np.round(tail, 6)), pa.array(tail >= threshold)], names=["doc_id", "expected_grade", "tail_probability", "keep"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, expected_grade double, tail_probability double, keep boolean")


def keep_good(docs: DataFrame, model: Ordinal, cut: int = 1, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns, whose tail probability reaches the threshold."""
    at = int(np.searchsorted(model.grades, cut)) - 1

    def run(batches):
        for b in batches:
            tails = model.tails(_judge(b, model))
            yield b.filter(pa.array(tails[:, at] >= threshold)) if 0 <= at < tails.shape[1] else b

    return docs.mapInArrow(run, docs.schema)


#: Ratings of the tables: 0 poor, 1 fair, 2 good.
GRADE = "CASE WHEN quality = 0 THEN 0 WHEN quality = 1 AND toxic = 1 THEN 1 WHEN quality = 1 THEN 2 END"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return quality(docs, fit_ordinal(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), F.expr(GRADE)))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the labelled rows of ``documents`` and drops the poor rows of ``docs``."""
    source = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return keep_good(docs, fit_ordinal(source, spark.read.parquet(f"{sf_dir}/labels.parquet"), F.expr(GRADE)))
