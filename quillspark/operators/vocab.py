"""Vocabulary: counts, pruning, ids, and segments as arrays of ids."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import BuildConfig, NormalizationConfig
from ..functions.text import noise, plain, segments as cut_segments, slices, text_tokens
from ..session import dense_ids

#: Vocabulary that travels to the workers at most, in entries and in bytes of tokens; a larger one is joined by a shuffle.
VOCAB_ROWS, VOCAB_BYTES = 2_000_000, 64 << 20
#: Tokens that are looked up at once: Arrow hashes the whole vocabulary for each call.
PIECE = 1 << 21


def _counted(offsets: np.ndarray, values: pa.Array) -> pa.RecordBatch:
    """(token, n, s): occurrences of each token of a piece, and its segments that hold it."""
    coded = values.dictionary_encode()
    code = coded.indices.to_numpy().astype(np.int64)
    many = len(coded.dictionary)
    seg = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    once = np.unique(seg * max(1, many) + code) % max(1, many)
    return pa.RecordBatch.from_arrays([coded.dictionary.cast(pa.string()), pa.array(np.bincount(code, minlength=many)), pa.array(np.bincount(once, minlength=many))], names=["token", "n", "s"])


def _summed(parts: DataFrame) -> DataFrame:
    return parts.groupBy("token").agg(F.sum("n").alias("unigram_count"), F.sum("s").alias("segment_freq"))


def token_counts(segments: DataFrame) -> DataFrame:
    """(token, unigram_count, segment_freq): occurrences, and segments that hold the token, in one shuffle of what each piece has."""

    def run(batches):
        for b in batches:
            tok = b.column("tok")
            off = tok.offsets.to_numpy()
            yield _counted(off - off[0], tok.values.slice(off[0], off[-1] - off[0]))

    return _summed(segments.select("tok").mapInArrow(run, "token string, n long, s long"))


def text_counts(docs: DataFrame, cfg: NormalizationConfig) -> DataFrame:
    """``token_counts`` of the segments of ``docs`` (doc_ord, text), which are counted where they are cut."""
    if not plain(cfg):
        return token_counts(cut_segments(docs, cfg))

    def run(batches):
        cut = text_tokens(cfg, True)
        for b in batches:
            for x in slices(b):
                t = cut(x.column("text"))
                yield _counted(t.offsets, t.values)

    return _summed(docs.where("text IS NOT NULL AND text <> ''").select("text").mapInArrow(run, "token string, n long, s long"))


def corpus_totals(segments: DataFrame, column: str = "tok") -> tuple[int, int]:
    """(segments, token positions)."""
    r = segments.agg(F.count("*").alias("s"), F.coalesce(F.sum(F.size(column).cast("long")), F.lit(0)).alias("t")).first()
    return r["s"], r["t"]


def keep_token(cfg: BuildConfig, n_segments: int, n_tokens: int) -> Column | None:
    """The pruning rule over ``token_counts``; None where nothing is pruned."""
    gate = cfg.vocab_prune_min_total_tokens
    if gate is None or n_tokens < gate:
        return None
    least, rescue, line_gate = cfg.vocab_prune_min_unigram_count, cfg.vocab_prune_rescue_unigram, cfg.vocab_prune_line_count_to_apply_df
    by_segment = cfg.vocab_prune_min_segment_freq > 1 and (line_gate == 0 or n_segments >= line_gate)
    if least <= 1 and not by_segment:
        return None
    rule = F.col("unigram_count") >= least
    if by_segment:
        wide = F.col("segment_freq") >= cfg.vocab_prune_min_segment_freq
        rule &= (wide | (F.col("unigram_count") >= rescue)) if rescue > 0 else wide
    return rule


def vocabulary(counts: DataFrame) -> DataFrame:
    """(token_id, token, unigram_count, segment_freq, noise): ids by falling count, then token."""
    ids = dense_ids(counts, [F.col("unigram_count").desc(), F.col("token").asc()], "token_id")
    return ids.select(F.col("token_id").cast("int").alias("token_id"), "token", "unigram_count", "segment_freq", noise(F.col("token")).alias("noise"))


def encode_segments(segments: DataFrame, vocab: DataFrame, n_vocab: int, limit: int = VOCAB_ROWS) -> DataFrame:
    """(doc_ord, seg_no, ids): tokens as ids; tokens without one go, and so do segments left empty."""
    if n_vocab <= limit and (vocab.agg(F.sum(F.octet_length("token").cast("long"))).first()[0] or 0) <= VOCAB_BYTES:
        known = pa.array(vocab.select("token", "token_id").orderBy("token_id").toArrow().column("token").to_pylist(), pa.string())

        def pieces(batches):
            held, n = [], 0
            for b in batches:
                held.append(b)
                n += int(b.column("tok").offsets[-1].as_py() - b.column("tok").offsets[0].as_py())
                if n >= PIECE:
                    yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                    held, n = [], 0
            if held:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()

        def run(batches):
            for b in pieces(batches):
                tok = b.column("tok")
                off = tok.offsets.to_numpy()
                flat = pc.index_in(tok.values.slice(off[0], off[-1] - off[0]).cast(pa.string()), value_set=known)
                kept = flat.is_valid().to_numpy(zero_copy_only=False)
                at = np.concatenate([[0], np.cumsum(kept)])[off - off[0]]
                ids = pa.ListArray.from_arrays(pa.array(at, pa.int32()), flat.drop_null())
                out = pa.RecordBatch.from_arrays([b.column("doc_ord"), b.column("seg_no"), ids], names=["doc_ord", "seg_no", "ids"])
                yield out.filter(pa.array(np.diff(at) > 0))

        return segments.select("doc_ord", "seg_no", "tok").mapInArrow(run, "doc_ord long, seg_no int, ids array<int>")
    flat = segments.select("doc_ord", "seg_no", F.posexplode("tok").alias("pos", "token")).join(vocab.select("token", "token_id"), "token")
    return flat.groupBy("doc_ord", "seg_no").agg(F.array_sort(F.collect_list(F.struct("pos", "token_id"))).alias("x")).select("doc_ord", "seg_no", F.col("x.token_id").alias("ids"))


def vocab_flags(vocab: DataFrame, phrases: DataFrame) -> DataFrame:
    """(token_id, flags, octets, byte_offset): 2 for a count of one at most, 1 for the head of a phrase; place in the string heap."""
    from pyspark.sql import Window

    heads = phrases.select(F.col("token_ids")[0].alias("token_id")).distinct().withColumn("head", F.lit(1))
    sized = vocab.join(heads, "token_id", "left").withColumn("octets", F.octet_length("token"))
    # Running sums over blocks of ids: one small window over the blocks' totals, one within each block.
    block = (F.col("token_id") / 65536).cast("int")
    sized = sized.withColumn("block", block)
    totals = sized.groupBy("block").agg(F.sum("octets").alias("total"))
    before = totals.select("block", F.coalesce(F.sum("total").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    within = F.coalesce(F.sum("octets").over(Window.partitionBy("block").orderBy("token_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    flags = F.when(F.col("unigram_count") <= 1, 2).otherwise(0) + F.coalesce("head", F.lit(0))
    return sized.withColumn("within", within).join(F.broadcast(before), "block").select("token_id", flags.cast("int").alias("flags"), "octets", (F.col("before") + F.col("within")).alias("byte_offset"))
