"""Best-fit packing by minimum bin slack.

Documents are spread over groups of about ``group_rows`` by a hash, so that every group is packed on its own,
in one task, from lengths alone (no text is shuffled). In a group, each bin takes the longest
document left and then the fullest feasible combination of the others: a bitset holds every reachable
sum of the available lengths (one shift-or for each length), the highest reachable sum is taken apart again
and its documents are removed. Only a group's last bins stay unfilled, so the slack of all bins
doesn't depend on the number of groups.

A document longer than a bin is cut into pieces: full bins of its own, and a rest that is packed.

Defined results: rows with a null doc_id, a null text or no words have nothing to pack and are left out;
repeated rows are packed as often as they stand; ties between documents of one length go to the smallest doc_id
and piece; an empty table gives no bins; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CAPACITY = 2048
SCHEMA = "bin long, used int, doc_ids array<long>, starts array<long>, lengths array<int>"


def fill(lengths: dict[int, int], capacity: int) -> dict[int, int]:
    """The fullest combination of the given lengths (with their multiplicities) within ``capacity``: length -> copies.

    Longer documents are tried first, and the search ends once the capacity itself is reachable.
    """
    mask = (1 << (capacity + 1)) - 1
    bits = 1
    steps: list[tuple[int, int, int]] = []
    for size in sorted((s for s in lengths if s <= capacity), reverse=True):
        left, copies = min(lengths[size], capacity // size), 1
        while left > 0:
            c = min(copies, left)
            new = (bits | bits << (size * c)) & mask
            if new != bits:
                steps.append((bits, size, c))
                bits = new
            left -= c
            copies *= 2
        if bits >> capacity & 1:
            break
    best = bits.bit_length() - 1
    out: dict[int, int] = {}
    for before, size, c in reversed(steps):
        if not before >> best & 1:
            out[size] = out.get(size, 0) + c
            best -= size * c
    return out


def pack(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins as lists of positions in ``sizes`` (all between 1 and ``capacity``)."""
    stock: dict[int, list[int]] = {}
    for i in range(len(sizes) - 1, -1, -1):
        stock.setdefault(sizes[i], []).append(i)
    count = {s: len(v) for s, v in stock.items()}
    bins = []
    order = sorted(count, reverse=True)
    top = 0
    while top < len(order):
        longest = order[top]
        if not count.get(longest):
            top += 1
            continue

        def take(size: int, copies: int, into: list[int]) -> None:
            into.extend(stock[size].pop() for _ in range(copies))
            count[size] -= copies
            if not count[size]:
                del count[size]

        own: list[int] = []
        take(longest, 1, own)
        for size, copies in fill(count, capacity - longest).items():
            take(size, copies, own)
        bins.append(own)
    return bins


def _groups(batches, capacity: int):
    for b in batches:
        out: list[list] = [[], [], [], [], []]
        for g, items in zip(b.column("g").to_pylist(), b.column("items")):
            v = items.values
            ids, n = v.field("id").to_numpy(), v.field("n").to_numpy()
            bin_id = g << 32
            piece_id, piece_at, piece_n = [], [], []
            for i, size in zip(ids.tolist(), n.tolist()):
                for k in range(size // capacity):
                    for col, x in zip(out, (bin_id, capacity, [i], [k * capacity], [capacity])):
                        col.append(x)
                    bin_id += 1
                if size % capacity:
                    piece_id.append(i)
                    piece_at.append(size - size % capacity)
                    piece_n.append(size % capacity)
            for own in pack(piece_n, capacity):
                for col, x in zip(out, (bin_id, sum(piece_n[k] for k in own), [piece_id[k] for k in own], [piece_at[k] for k in own], [piece_n[k] for k in own])):
                    col.append(x)
                bin_id += 1
        types = [pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32())]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names=["bin", "used", "doc_ids", "starts", "lengths"])


def best_fit(docs: DataFrame, capacity: int = CAPACITY, length: Column | None = None, group_rows: int = 4096) -> DataFrame:
    """Bins (bin, used, doc_ids, starts, lengths) of at most ``capacity`` words.

    ``length``: another measure of a document's length, a column of whole numbers over ``docs``.
    """
    n = F.regexp_count("text", F.lit(r"\S+")) if length is None else length
    sized = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("long").alias("id"), n.cast("long").alias("n")).where("n > 0")
    groups = max(1, -(-docs.count() // group_rows))
    return (
        sized.groupBy(F.pmod(F.xxhash64("id"), F.lit(groups)).alias("g"))
        .agg(F.sort_array(F.collect_list(F.struct("id", "n"))).alias("items"))
        .mapInArrow(lambda it: _groups(it, capacity), SCHEMA)
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return best_fit(docs)
