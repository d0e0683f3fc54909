"""Benchmark decontamination: edit distance by CGK embedding and bit-sampling LSH.

A document leaks an item if some run of its words is within edit distance d = floor(tolerance * n) of
the item's n words (case and punctuation don't count). Per document and item:

1. Windows. An item within d edits keeps all but 2d of its n - 1 word pairs, so at least one of any
   2d + 1: the rarest 2d + 1 of each item are probed in one look-up over the document's words, and each hit
   places an item-sized window. Windows that lack n - d of the item's words are dropped. Both steps
   lose nothing.
2. CGK. Window and item walk their words with shared random bits (stay or go on, 2n steps), which maps
   edit distance to Hamming distance. Each of R repetitions samples K steps of the walk as a key;
   a window goes on if one key equals the item's. R depends on the item's length and share of distinct words alone: it is the least with which
   simulated items of that kind with d edits are found at the target recall. Kinds that would need more than ``most`` keys, and items
   longer than ``LONG`` words, are verified without keys, which loses nothing.
3. Exact verification: semi-global edit distance of the item against the window and 2d words around it.

Items travel to the workers in slices of at most ``slice_rows`` items and about ``slice_words`` words, each broadcast by itself and one more pass, so neither
what is broadcast nor what the driver holds grows with the benchmark. The slices don't change the result.

Items of fewer than ``least`` words are searched with d = 0, as exact runs of words; one word is probed by itself.

Defined results: null or empty texts and items match nothing, nor do items without words; rows with a null doc_id are searched like any other, items with a null item_id too; equal items all
match; a tie between windows gives one row with the least distance; repeated rows give repeated
results; whole texts are searched; empty tables give an empty result (``drop_leaks``: every row stays).
"""

from __future__ import annotations

from functools import cache, reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .kernel import member, mix, words

_PAIR = np.uint64(0xD6E8FEB86659FD93)
_PAD = np.uint64(0)
LONG = 256
MOST = 64
#: Cells of a table of windows or spans at most.
CELLS = 1 << 22


def pairs(h: np.ndarray) -> np.ndarray:
    return mix(h[:-1] * _PAIR + h[1:])


def _alone(h: np.ndarray) -> np.ndarray:
    return mix(h ^ _PAIR)


def _keys(text: np.ndarray, length: np.ndarray, reps: int, samples: int, at: np.ndarray) -> np.ndarray:
    """(rows, reps) LSH keys of rows of words padded to one width; ``at``: (reps, samples) sampled shares of the walk."""
    m, width = text.shape
    padded = np.concatenate([text, np.full((m, 1), _PAD)], 1)
    index = np.zeros((m, reps), np.int64)
    key = np.zeros((m, reps), np.uint64)
    rows = np.arange(m)[:, None]
    # The k-th sample stands at step floor(share * 2n): the walk passes about half a word each step.
    want = np.floor(at[None, :, :] * (2 * length[:, None, None])).astype(np.int64)
    top = int(2 * length.max()) if m else 0
    salt = mix(np.arange(reps, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(17))
    for j in range(top):
        sym = padded[rows, np.minimum(index, width)]
        take = (want == j).sum(2)
        k = np.nonzero(take)
        if len(k[0]):
            key[k] = mix(key[k] + sym[k] * np.uint64(3) + np.uint64(j + 1))
        step = mix(sym ^ (salt + np.uint64(j * 0xA0761D6478BD642F & 0xFFFFFFFFFFFFFFFF))[None, :]) >> np.uint64(63)
        index += np.where(index < length[:, None], step.astype(np.int64), 0)
    return key


def distances(item: np.ndarray, n: np.ndarray, span: np.ndarray, width: np.ndarray) -> np.ndarray:
    """Least word edit distance of each item (row, first n words) to any run of its span (first ``width`` words)."""
    m, w = span.shape
    if not m:
        return np.zeros(0, np.int64)
    col = np.arange(w + 1)
    valid = col[None, :] <= width[:, None]
    row = np.zeros((m, w + 1), np.int32)
    best = np.zeros(m, np.int64)
    for i in range(item.shape[1]):
        new = row + 1
        new[:, 1:] = np.minimum(new[:, 1:], row[:, :-1] + (span != item[:, i : i + 1]))
        new = np.minimum.accumulate(new - col, axis=1) + col
        row = new.astype(np.int32)
        end = n == i + 1
        if end.any():
            best[end] = np.where(valid[end], row[end], 1 << 20).min(1)
    return best


def _where(samples: int, most: int) -> np.ndarray:
    return np.random.default_rng(7).random((most, samples))


def _padded(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    n = np.array([len(r) for r in rows], np.int64)
    out = np.full((len(rows), int(n.max(initial=0))), _PAD)
    out[np.arange(out.shape[1]) < n[:, None]] = np.concatenate(rows or [np.zeros(0, np.uint64)])
    return out, n


@cache
def repetitions(n: int, quarter: int, d: int, target: float, samples: int = 2, most: int = MOST, draws: int = 300) -> int:
    """The fewest keys that find ``target`` of simulated items of ``n`` words, ``quarter`` / 4 of them distinct, after d edits; 0 if ``most`` don't."""
    rng = np.random.default_rng([n, quarter, d])
    own = max(1, -(-n * quarter // 4))
    plain, copies = [], []
    for _ in range(draws):
        t = rng.integers(1, 1 << 62, own).astype(np.uint64)
        t = rng.permutation(np.concatenate([t, rng.choice(t, n - own)])) if own < n else t
        plain.append(t)
        e = t.tolist()
        for _ in range(d):
            p, kind = int(rng.integers(len(e))), rng.integers(3)
            if kind == 0:
                e[p] = int(rng.integers(1, 1 << 62))
            elif kind == 1:
                e.insert(p, int(rng.integers(1, 1 << 62)))
            elif len(e) > 1:
                e.pop(p)
        copies.append(np.array(e[:n], np.uint64))
    size, where = np.full(draws, n), _where(samples, most)
    same = _keys(_padded([*copies, np.zeros(n, np.uint64)])[0][:-1], size, most, samples, where) == _keys(np.stack(plain), size, most, samples, where)
    good = np.flatnonzero(np.logical_or.accumulate(same, axis=1).mean(0) >= target)
    return int(good[0]) + 1 if len(good) else 0


class Items:
    """What the search needs of a slice of the benchmark."""

    def __init__(self, rows: list[tuple[int | None, str | None]], tolerance: float, least: int, target: float, samples: int = 2, most: int = MOST):
        hs = {}
        for w in words(pa.array([t for _, t in rows], pa.string())):
            for d in range(w.n):
                hs[w.lo + d] = w.hash[w.first[d] : w.first[d + 1]]
        chosen = [k for k in range(len(rows)) if len(hs.get(k, ()))]
        self.ids = [rows[k][0] for k in chosen]
        self.text = [hs[k] for k in chosen]
        self.n = np.array([len(t) for t in self.text], np.int64)
        self.d = np.where(self.n < least, 0, np.floor(self.n * tolerance)).astype(np.int64)
        self.single = bool((self.n == 1).any())
        grams = [pairs(t) if len(t) > 1 else _alone(t) for t in self.text]
        u, c = np.unique(np.concatenate(grams or [np.zeros(0, np.uint64)]), return_counts=True)
        ph, pi, pp = [], [], []
        for k, g in enumerate(grams):
            often = c[np.searchsorted(u, g)]
            pos = np.lexsort((np.arange(len(g)), often))[: 2 * self.d[k] + 1]
            ph.append(g[pos])
            pi.append(np.full(len(pos), k))
            pp.append(pos)
        ph = np.concatenate(ph or [np.zeros(0, np.uint64)])
        order = np.argsort(ph, kind="stable")
        self.probe, start = np.unique(ph[order], return_index=True)
        self.at = np.append(start, len(ph))
        self.item = np.concatenate(pi or [np.zeros(0, np.int64)])[order]
        self.pos = np.concatenate(pp or [np.zeros(0, np.int64)])[order]
        self.vocab = np.unique(np.concatenate([mix(t ^ self._salt(np.int64(k))) for k, t in enumerate(self.text)] or [np.zeros(0, np.uint64)]))
        self.samples, self.where = samples, _where(samples, most)
        self.reps = np.array([0 if n > LONG else 1 if not d else repetitions(int(n), 4 * len(np.unique(t)) // int(n), int(d), target, samples, most) for n, d, t in zip(self.n, self.d, self.text)], np.int64)
        self.key = np.zeros((len(self.n), int(self.reps.max(initial=0))), np.uint64)
        for k in self._blocks(np.flatnonzero(self.reps > 0), self.n):
            self.key[k] = self._keys_of([self.text[i] for i in k], self.n[k], self.key.shape[1])

    @staticmethod
    def _salt(k) -> np.ndarray:
        return mix((np.atleast_1d(k) + 1).astype(np.uint64))

    def _keys_of(self, rows: list[np.ndarray], n: np.ndarray, reps: int) -> np.ndarray:
        text, _ = _padded([*rows, np.zeros(int(n.max()), np.uint64)])
        return _keys(text[:-1], n, reps, self.samples, self.where[:reps])

    @staticmethod
    def _blocks(rows: np.ndarray, width: np.ndarray):
        """``rows`` by falling width, in blocks whose padded tables have at most ``CELLS`` cells."""
        rows = rows[np.argsort(-width[rows], kind="stable")]
        a = 0
        while a < len(rows):
            z = a + max(1, min(4096, CELLS // max(1, int(width[rows[a]]))))
            yield rows[a:z]
            a = z

    def search(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, item, distance) of every leak."""
        docs, its, lo, n_all, spans = [], [], [], [], []
        if not len(self.n):
            z = np.zeros(0, np.int64)
            return z, z, z
        for w in words(text):
            if not len(w.hash):
                continue
            k = member(pairs(w.hash), self.probe)
            j = np.flatnonzero(k >= 0)
            j = j[w.doc[j] == w.doc[j + 1]]
            k = k[j]
            if self.single:
                one = member(_alone(w.hash), self.probe)
                j, k = np.concatenate([j, np.flatnonzero(one >= 0)]), np.concatenate([k, one[one >= 0]])
            if not len(j):
                continue
            a, b = self.at[k], self.at[k + 1]
            times = b - a
            post = np.repeat(a - np.concatenate([[0], np.cumsum(times)[:-1]]), times) + np.arange(times.sum())
            j = np.repeat(j, times)
            item, start = self.item[post], j - self.pos[post]
            doc = w.doc[j]
            order = np.lexsort((start, item, doc))
            doc, item, start = doc[order], item[order], start[order]
            new = np.ones(len(doc), bool)
            new[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (start[1:] != start[:-1])
            doc, item, start = doc[new], item[new], start[new]
            n, d = self.n[item], self.d[item]
            begin, stop = np.maximum(start - 2 * d, w.first[doc]), np.minimum(start + n + 2 * d, w.first[doc + 1])
            for block in self._blocks(np.arange(len(item)), stop - begin):
                size = (stop - begin)[block]
                # How many of the span's words the item has: n - d at least, or it can't match.
                total = np.cumsum(size)
                idx = np.repeat(begin[block] - np.concatenate([[0], total[:-1]]), size) + np.arange(total[-1])
                has = member(mix(w.hash[idx] ^ np.repeat(self._salt(item[block]), size)), self.vocab) >= 0
                seen = np.concatenate([[0], np.cumsum(has)])[np.concatenate([[0], total])]
                for q in block[np.flatnonzero(np.diff(seen) >= (n - d)[block])].tolist():
                    docs.append(w.lo + doc[q])
                    its.append(item[q])
                    spans.append((w.hash[begin[q] : stop[q]], start[q] - begin[q]))
        if not docs:
            z = np.zeros(0, np.int64)
            return z, z, z
        row, item = np.array(docs), np.array(its)
        width = np.array([len(s) for s, _ in spans])
        out = [self._verify(row[k], item[k], [spans[i] for i in k]) for k in self._blocks(np.arange(len(row)), width)]
        row, item, dist = (np.concatenate(x) for x in zip(*out))
        order = np.lexsort((dist, item, row))
        row, item, dist = row[order], item[order], dist[order]
        first = np.ones(len(row), bool)
        first[1:] = (row[1:] != row[:-1]) | (item[1:] != item[:-1])
        return row[first], item[first], dist[first]

    def _verify(self, row, item, spans):
        reps = self.reps[item]
        near = reps == 0
        part = np.flatnonzero(~near)
        if len(part):
            n = self.n[item[part]]
            windows = [spans[q][0][max(spans[q][1], 0) : max(spans[q][1], 0) + self.n[item[q]]] for q in part]
            most = int(reps[part].max())
            same = self._keys_of(windows, n, most) == self.key[item[part], :most]
            near[part] = (same & (np.arange(most) < reps[part, None])).any(1)
        k = np.flatnonzero(near)
        if not len(k):
            return row[k], item[k], np.zeros(0, np.int64)
        text, n = _padded([self.text[i] for i in item[k]])
        span, size = _padded([spans[q][0] for q in k])
        dist = distances(text, n, span, size)
        good = dist <= self.d[item[k]]
        return row[k[good]], item[k[good]], dist[good]


def slices(benchmark: DataFrame, tolerance: float, least: int, target: float, slice_rows: int, slice_words: int) -> list[Broadcast]:
    """``Items`` of each slice, broadcast one after another; the driver holds one at a time."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text IS NOT NULL")
    n, size = rows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()
    parts = max(1, -(-n // slice_rows), -(-size // (6 * slice_words)))
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(parts))
    out = []
    for k in range(parts):
        items = Items([(r[0], r[1]) for r in rows.where(part == k).orderBy("item_id", "text").collect()], tolerance, least, target)
        out.append(benchmark.sparkSession.sparkContext.broadcast(items))
    return out


def leaks(docs: DataFrame, benchmark: DataFrame, tolerance: float = 0.15, least: int = 8, target: float = 0.97, slice_rows: int = 100_000, slice_words: int = 4_000_000) -> DataFrame:
    """(doc_id, item_id, distance, item_words) of every document and item it leaks."""

    def search(held: Broadcast):
        def run(batches):
            items = held.value
            for b in batches:
                row, item, dist = items.search(b.column("text"))
                yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(row)), pa.array([items.ids[i] for i in item], pa.int64()), pa.array(dist.astype(np.int32)), pa.array(items.n[item].astype(np.int32))], names=["doc_id", "item_id", "distance", "item_words"])

        return run

    texts = docs.select(F.col("doc_id").cast("long"), "text")
    parts = [texts.mapInArrow(search(items), "doc_id long, item_id long, distance int, item_words int") for items in slices(benchmark, tolerance, least, target, slice_rows, slice_words)]
    return reduce(DataFrame.unionByName, parts)


def drop_leaks(docs: DataFrame, benchmark: DataFrame, tolerance: float = 0.15, least: int = 8, target: float = 0.97, slice_rows: int = 100_000, slice_words: int = 4_000_000) -> DataFrame:
    """The rows of ``docs``, all columns, that leak no item."""

    def clean(held: Broadcast):
        def run(batches):
            items = held.value
            for b in batches:
                keep = np.ones(b.num_rows, bool)
                keep[items.search(b.column("text"))[0]] = False
                yield b.filter(pa.array(keep))

        return run

    for items in slices(benchmark, tolerance, least, target, slice_rows, slice_words):
        docs = docs.mapInArrow(clean(items), docs.schema)
    return docs


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
