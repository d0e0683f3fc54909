"""Language-model scoring with a log-frequency Bloom filter.

Every n-gram of every document (up to ``order`` words, with marks for the start of a text) is counted; its count
is quantised to a level q = 1 + floor(log2 c), and the filter holds (n-gram, 1) ... (n-gram, q). Looking up a
count is a run of membership probes, level after level until the first miss; a level stands for the mean
count of the n-grams that have it, as counted over the corpus. Probabilities are discounted and interpolated:

    P_k(w | v) = weight * max(0, c(vw) - discount) / c(v) + (1 - weight) * P_{k-1}(w | shorter v),   P_1(w) = (1 - floor) * c(w) / N + floor / V.

A text's own n-grams are counted too, so an n-gram that stands nowhere else (count 1) keeps a quarter of its weight, one that is repeated
elsewhere more: the discount tells them apart.

Counting sends one compact block for each batch and bucket of hashes (5 bytes and a count per n-gram),
and the task that merges a bucket builds its part of the filter in the same step, sized by its own entries
(``BITS`` bits each). The number of buckets follows the size of the corpus. A filter of up to ``most_bytes`` is broadcast whole, and each
distinct n-gram of a batch is probed once. Beyond that, the look-ups go to the filter: the distinct n-grams of each batch are sent to the buckets'
parts, and their levels, a byte each, come back; nothing grows on the driver or in a worker, and the scores are the same. The texts wait in compressed
batches, which are read and shuffled as they are.

Defined results: a null, empty or wordless text has 0 tokens and null log-probability and perplexity; rows with a
null doc_id are scored; repeated rows count in the statistics as often as they stand and get equal scores; whole
texts are counted and scored; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .kernel import Words, mix, sums, words
from .work import fresh_path, written

BITS, PROBES = 8, 4
LEVELS = 48
#: Chunks of text (half a megabyte each) whose distinct n-grams are gathered at once.
CHUNKS = 8
_PAIR = np.uint64(0xC2B2AE3D27D4EB4F)
_BOS = np.uint64(0x1234567890ABCDEF)
_CUT = np.uint64(16)


def grams(w: Words, order: int = 2) -> list[np.ndarray]:
    """48-bit hashes of the runs of 1, 2, ... ``order`` words that end in each word."""
    out, run, start = [w.hash], w.hash, _BOS
    first = np.ones(len(w.hash), bool)
    first[1:] = w.doc[1:] != w.doc[:-1]
    for _ in range(order - 1):
        before = np.roll(run, 1)
        before[first] = start
        start = mix(np.array([start]) * _PAIR)[0]
        run = mix(before * _PAIR + w.hash)
        out.append(run)
    return [h >> _CUT for h in out]


def _gathered(text: pa.Array) -> Iterator[list[Words]]:
    part: list[Words] = []
    for w in words(text):
        part.append(w)
        if len(part) == CHUNKS:
            yield part
            part = []
    if part:
        yield part


def bucket_bits(octets: int) -> int:
    """A bucket for about each megabyte of text; 256 at least, a million at most."""
    return min(20, max(8, (octets >> 20).bit_length()))


def _blocks(h: np.ndarray, bits: int) -> Iterator[tuple[int, int, int, bytes]]:
    """(bucket, from, to, packed hashes) of sorted hashes: 4 low bytes each, then the high ones."""
    rest = h & np.uint64((1 << (48 - bits)) - 1)
    low, high = (rest & np.uint64(0xFFFFFFFF)).astype("<u4"), (rest >> np.uint64(32)).astype(np.uint8)
    which = (h >> np.uint64(48 - bits)).astype(np.int64)
    new = np.flatnonzero(np.diff(which, prepend=-1))
    for a, z in zip(new.tolist(), np.append(new[1:], len(h)).tolist()):
        yield int(which[a]), a, z, low[a:z].tobytes() + high[a:z].tobytes()


def _unpack(block: bytes, n: int) -> np.ndarray:
    return np.frombuffer(block, "<u4", n).astype(np.uint64) | (np.frombuffer(block, np.uint8, n, 4 * n).astype(np.uint64) << np.uint64(32))


def _count(batches, order: int, bits: int):
    """(n, bucket, block) of each batch: sorted hashes and their counts."""
    for b in batches:
        for part in _gathered(b.column("text")):
            own = [grams(w, order) for w in part]
            ns, buckets, blocks = [], [], []
            for n in range(order):
                h, c = np.unique(np.concatenate([g[n] for g in own]), return_counts=True)
                c = c.astype("<u4")
                for bucket, a, z, block in _blocks(h, bits):
                    ns.append(n)
                    buckets.append(bucket)
                    blocks.append(block + c[a:z].tobytes())
            # One entry more, beyond all orders: how many texts have a word.
            ns.append(order)
            buckets.append(0)
            blocks.append(bytes(5) + np.uint32(sum((np.diff(w.first) > 0).sum() for w in part)).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ns, pa.int32()), pa.array(buckets, pa.int32()), pa.array(blocks, pa.binary())], names=["n", "bucket", "block"])


def level(c: np.ndarray) -> np.ndarray:
    return np.floor(np.log2(c)).astype(np.int64) + 1


def positions(rest: np.ndarray, q: np.ndarray | int, i: int, size: np.ndarray | int) -> np.ndarray:
    """Bit of probe i for (n-gram, level q) in a part of ``size`` bits."""
    with np.errstate(over="ignore"):
        g = mix(rest * np.uint64(0x9E3779B97F4A7C15) + np.asarray(q).astype(np.uint64))
        x = (g + np.uint64(i) * ((g >> np.uint64(32)) | np.uint64(1))) & np.uint64(0xFFFFFFFF)
        return (x * np.asarray(size).astype(np.uint64)) >> np.uint64(32)


def _build(batches):
    """A bucket's part of the filter, with the numbers of n-grams and occurrences at each level."""
    for b in batches:
        parts, sizes, ns, cs = [], [], [], []
        for blocks in b.column("blocks"):
            got = [x.as_py() for x in blocks]
            n = [len(x) // 9 for x in got]
            h, c = np.concatenate([_unpack(x, k) for x, k in zip(got, n)]), np.concatenate([np.frombuffer(x, "<u4", k, 5 * k).astype(np.int64) for x, k in zip(got, n)])
            order = np.argsort(h, kind="stable")
            h, c = h[order], c[order]
            new = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            h, c = h[new], np.add.reduceat(c, new)
            q = level(np.maximum(c, 1))
            total = int(q.sum())
            size = -(-total * BITS // 8) * 8
            bits = np.zeros(size, np.uint8)
            for k in range(1, int(q.max()) + 1):
                own = h[q >= k]
                for i in range(PROBES):
                    bits[positions(own, k, i, size).astype(np.int64)] = 1
            parts.append(np.packbits(bits, bitorder="little").tobytes())
            sizes.append(size)
            ns.append(np.bincount(q, minlength=LEVELS)[:LEVELS])
            cs.append(np.bincount(q, c, LEVELS)[:LEVELS].astype(np.int64))
        yield pa.RecordBatch.from_arrays(
            [b.column("n"), b.column("bucket"), pa.array(parts, pa.binary()), pa.array(sizes, pa.int64()), pa.array(ns, pa.list_(pa.int64())), pa.array(cs, pa.list_(pa.int64()))],
            names=["n", "bucket", "bits", "size", "types", "uses"],
        )


class Filter:
    """Parts of the filter, for look-ups; buckets it doesn't hold answer 0. ``parts``: columns n, bucket, bits and size."""

    def __init__(self, parts: pa.Table, bucket_bits: int):
        self.bucket_bits = bucket_bits
        n, bucket, size = (parts.column(c).to_numpy() for c in ("n", "bucket", "size"))
        slots = (int(n.max(initial=0)) + 1) << bucket_bits
        self.size, self.start = np.zeros(slots, np.int64), np.zeros(slots, np.int64)
        slot = (n.astype(np.int64) << bucket_bits) + bucket
        self.size[slot], self.start[slot] = size, np.cumsum(size) - size
        self.bits = np.zeros(int(size.sum()) >> 3, np.uint8)
        at = 0
        for chunk in parts.column("bits").chunks:  # straight from the columns' buffers
            off = np.frombuffer(chunk.buffers()[1], np.int32)[chunk.offset : chunk.offset + len(chunk) + 1]
            self.bits[at : at + off[-1] - off[0]] = np.frombuffer(chunk.buffers()[2] or b"", np.uint8)[off[0] : off[-1]]
            at += off[-1] - off[0]

    def levels(self, h: np.ndarray, n: int) -> np.ndarray:
        """Level of each run of n + 1 words: the probes go on until a level isn't in the filter."""
        out = np.zeros(len(h), np.uint8)
        rest_bits = 48 - self.bucket_bits
        k = np.minimum((h >> np.uint64(rest_bits)).astype(np.int64) + (n << self.bucket_bits), len(self.size) - 1)
        live = np.flatnonzero(self.size[k] > 0)
        rest, size, start = (h & np.uint64((1 << rest_bits) - 1))[live], self.size[k[live]], self.start[k[live]]
        q = 1
        while len(live) and q < LEVELS:
            for i in range(PROBES):
                p = positions(rest, q, i, size).astype(np.int64) + start
                hit = (self.bits[p >> 3] >> (p & 7).astype(np.uint8)) & 1 == 1
                if not hit.all():
                    live, rest, size, start = live[hit], rest[hit], size[hit], start[hit]
            out[live] = q
            q += 1
        return out


class Model:
    """Level statistics and the smoothing; ``mean``: (order, level) -> mean count; ``starts``: texts that have a word."""

    def __init__(self, types: np.ndarray, uses: np.ndarray, starts: int, weight: float, discount: float, floor: float):
        with np.errstate(invalid="ignore", divide="ignore"):
            self.mean = np.where(types > 0, uses / np.maximum(types, 1), 2.0 ** np.maximum(np.arange(LEVELS) - 1, 0))
        self.mean[:, 0] = 0
        self.tokens, self.vocabulary, self.starts = max(1, int(uses[0].sum())), max(1, int(types[0].sum())), max(1, starts)
        self.weight, self.discount, self.floor = weight, discount, floor

    def log2(self, levels: list[np.ndarray], first: np.ndarray) -> np.ndarray:
        """Of each word, from the levels of the runs that end in it; ``first``: word offsets of the texts."""
        counts = [m[q] for m, q in zip(self.mean, levels)]
        p = (1 - self.floor) * counts[0] / self.tokens + self.floor / self.vocabulary
        begins = first[:-1][np.diff(first) > 0]
        for shorter, c in zip(counts, counts[1:]):
            context = np.roll(shorter, 1)
            context[begins] = self.starts
            p = self.weight * np.minimum(1.0, np.maximum(0.0, c - self.discount) / np.maximum(context, 1.0)) + (1 - self.weight) * p
        return np.log2(p)


def build_filter(docs: DataFrame, order: int, bits: int) -> DataFrame:
    """The filter's parts (n, bucket, bits, size, types, uses): all n-grams of ``docs``, counted."""
    blocks = docs.select("text").mapInArrow(lambda it: _count(it, order, bits), "n int, bucket int, block binary")
    merged = blocks.groupBy("n", "bucket").agg(F.collect_list("block").alias("blocks"))
    return written(merged.mapInArrow(_build, "n int, bucket int, bits binary, size long, types array<long>, uses array<long>"), "lm-filter")


def _distinct(part: list[Words], order: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each n the sorted distinct hashes of ``part`` and, for each word, which of them is its run."""
    own = [grams(w, order) for w in part]
    return [np.unique(np.concatenate([g[n] for g in own]), return_inverse=True) for n in range(order)]


def _finish(part: list[Words], levels: list[np.ndarray], model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Words and log-probability of each text of ``part``, from the levels of its words' runs."""
    first = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(w.first) for w in part]))])
    return np.diff(first), sums(model.log2(levels, first), first)


_SCHEMA = "doc_id long, tokens long, log2_prob double, perplexity double"


def _rows(ids: pa.Array, done: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    tokens, logs = (np.concatenate([d[k] for d in done] or [np.zeros(0)]) for k in (0, 1))
    none = tokens == 0
    return pa.RecordBatch.from_arrays([ids, pa.array(tokens.astype(np.int64)), pa.array(np.round(logs, 4), mask=none), pa.array(np.round(2.0 ** np.minimum(-logs / np.maximum(tokens, 1), 1000), 4), mask=none)], names=["doc_id", "tokens", "log2_prob", "perplexity"])


def _batched(batches):
    """(batch, held): runs of documents of about ``CHUNKS`` chunks, ids and texts, compressed, under a number of their own."""
    for b in batches:
        ids, texts = b.column("doc_id"), b.column("text")
        at = 0
        for part in _gathered(texts):
            n = sum(w.n for w in part)
            held = pa.RecordBatch.from_arrays([ids.slice(at, n), texts.slice(at, n)], names=["doc_id", "text"])
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, held.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_batch(held)
            yield pa.RecordBatch.from_arrays([pa.array([uuid.uuid4().int >> 65]), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["batch", "held"])
            at += n


def _asked(batches, order: int, bits: int):
    """(n, bucket, batch, block): the distinct runs of each batch."""
    for b in batches:
        for batch, held in zip(b.column("batch").to_pylist(), b.column("held")):
            out: list[list] = [[], [], []]
            for n, (h, _) in enumerate(_distinct(list(words(pa.ipc.open_stream(held.as_buffer()).read_all().column("text"))), order)):
                for bucket, _, _, block in _blocks(h, bits):
                    for col, x in zip(out, (n, bucket, block)):
                        col.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), pa.array(out[1], pa.int32()), pa.array(np.full(len(out[0]), batch), pa.int64()), pa.array(out[2], pa.binary())], names=["n", "bucket", "batch", "block"])


def _answered(batches, bits: int):
    """(batch, n, bucket, levels) of each bucket's questions."""
    for b in batches:
        out: list[list] = [[], [], [], []]
        for k in range(b.num_rows):
            n, bucket, asked = (b.column(c)[k] for c in ("n", "bucket", "asked"))
            held = Filter(pa.table(b.slice(k, 1).select(["n", "bucket", "bits", "size"])), bits)
            # All batches' questions at once: a batch has few n-grams in a bucket.
            blocks = asked.values.field("block").to_pylist()
            sizes = [len(x) // 5 for x in blocks]
            h = np.concatenate([_unpack(x, m) for x, m in zip(blocks, sizes)]) | np.uint64(bucket.as_py() << (48 - bits))
            levels = held.levels(h, n.as_py()).tobytes()
            at = 0
            for batch, m in zip(asked.values.field("batch").to_pylist(), sizes):
                for col, x in zip(out, (batch, n.as_py(), bucket.as_py(), levels[at : at + m])):
                    col.append(x)
                at += m
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.int32(), pa.binary()))], names=["batch", "n", "bucket", "levels"])


def score(docs: DataFrame, corpus: DataFrame | None = None, most_bytes: int = 256 << 20, order: int = 2, weight: float = 0.8, discount: float = 0.75, floor: float = 0.05) -> DataFrame:
    """(doc_id, tokens, log2_prob, perplexity) of every row, under the n-gram counts of ``corpus`` (``docs`` themselves)."""
    spark = docs.sparkSession
    corpus = docs if corpus is None else corpus
    octets = corpus.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0]
    bits = bucket_bits(octets)
    parts = build_filter(corpus, order, bits)
    stat = parts.groupBy("n").agg(F.sum(F.length("bits")).alias("bytes"), *[F.sum(F.col("types")[i]).alias(f"t{i}") for i in range(LEVELS)], *[F.sum(F.col("uses")[i]).alias(f"u{i}") for i in range(LEVELS)]).collect()
    types, uses, total, starts = np.zeros((order, LEVELS), np.int64), np.zeros((order, LEVELS), np.int64), 0, 0
    for r in stat:
        if r["n"] == order:
            starts = sum(r[f"u{i}"] for i in range(LEVELS))
            continue
        types[r["n"]] = [r[f"t{i}"] for i in range(LEVELS)]
        uses[r["n"]] = [r[f"u{i}"] for i in range(LEVELS)]
        total += r["bytes"]
    model = Model(types, uses, starts, weight, discount, floor)
    texts = docs.select(F.col("doc_id").cast("long"), "text")
    plain = parts.where(F.col("n") < order).select("n", "bucket", "bits", "size")
    if total <= most_bytes:
        held = spark.sparkContext.broadcast(Filter(plain.toArrow(), bits))

        def run(batches):
            for b in batches:
                done = []
                for part in _gathered(b.column("text")):
                    done.append(_finish(part, [held.value.levels(h, n)[at] for n, (h, at) in enumerate(_distinct(part, order))], model))
                yield _rows(b.column("doc_id"), done)

        return texts.mapInArrow(run, _SCHEMA)

    kept = written(texts.mapInArrow(_batched, "batch long, held binary"), "lm-batches")
    asked = kept.mapInArrow(lambda it: _asked(it, order, bits), "n int, bucket int, batch long, block binary")
    asked = asked.groupBy("n", "bucket").agg(F.collect_list(F.struct("batch", "block")).alias("asked")).join(plain, ["n", "bucket"])
    answers = asked.mapInArrow(lambda it: _answered(it, bits), "batch long, n int, bucket int, levels binary")

    def close(batch: pa.Table, answers: pa.Table) -> pa.Table:
        """A batch's rows: its answers come as rows of one bucket each, so no row of the JVM grows with the number of buckets."""
        texts = pa.ipc.open_stream(batch.column("held")[0].as_buffer()).read_all()
        part = list(words(texts.column("text")))
        answers = answers.sort_by([("n", "ascending"), ("bucket", "ascending")])
        ns = answers.column("n").to_numpy()
        levels = []
        for n, (h, at) in enumerate(_distinct(part, order)):
            mine = b"".join(answers.column("levels").slice(np.searchsorted(ns, n), (ns == n).sum()).to_pylist())
            levels.append(np.frombuffer(mine, np.uint8)[at] if len(h) else np.zeros(0, np.uint8))
        return pa.Table.from_batches([_rows(texts.column("doc_id").combine_chunks(), [_finish(part, levels, model)])])

    return kept.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(close, _SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"))
