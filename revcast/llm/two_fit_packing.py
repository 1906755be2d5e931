"""Best-two-fit packing of token sequences.

A bin is filled greedily, always with the longest piece that still fits.  If a
gap is left, the bin's smallest piece is taken out and the gap, larger by it,
is filled with the two unpacked pieces that fill it more tightly; this repeats
while it helps.

Pieces of one length are interchangeable, so bins are planned on the counts of
the lengths (at most ``capacity`` numbers, whatever the size of the table), and
equal bins are planned once with their number.  The pieces then find their
places by their rank among those of their length.  Ranks come from counts by
(length, hash bucket) and a ranking inside each bucket, so that no length, even
one that a third of all pieces share, is ranked in one task.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from revcast.llm.byte_bpe import tokenizer_of
from revcast.llm.common import written

CAPACITY = 2048
#: About this many pieces in a ranking bucket.
BUCKET_ROWS = 100_000


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` tokens: full ones, but for the first."""
    first = n % capacity or capacity
    if n <= capacity:
        return [(0, n)]
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def best_two(lengths: list[int], free: dict[int, int], room: int, above: int) -> tuple[int, int] | None:
    """The two free lengths with the largest sum in (``above``, ``room``]."""
    best, found = above, None
    low, high = 0, bisect_right(lengths, room) - 1
    while low <= high:
        small, large = lengths[low], lengths[high]
        total = small + large
        if total > room or (low == high and free[small] < 2):
            high -= 1
            continue
        if total > best:
            best, found = total, (large, small)
            if best == room:
                break
        low += 1
    return found


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> pd.DataFrame:
    """Where the pieces of each length go.

    ``counts`` has the number of pieces by length.  A row says that the pieces
    of ``length`` ranked from ``first`` (``total`` of them) fill bins from
    ``bin`` on, ``each`` to a bin, side by side from ``offset``.  A plan has a
    few rows for each length at most: each bin planned uses up a length, or
    leaves fewer of it than such a bin holds.
    """
    left = {k: v for k, v in counts.items() if v > 0}
    lengths = sorted(left)
    used = dict.fromkeys(left, 0)
    rows, n_bins = [], 0
    while lengths:
        free = dict(left)
        held: list[int] = []
        gap = capacity

        def take(x: int, free=free, held=held) -> None:
            free[x] -= 1
            held.append(x)

        while gap:
            k = bisect_right(lengths, gap) - 1
            while k >= 0 and not free[lengths[k]]:
                k -= 1
            if k < 0:
                break
            take(lengths[k])
            gap -= held[-1]
        while gap and len(held) > 1:
            smallest = min(held)
            open_lengths = [x for x in lengths if free[x]]
            two = best_two(open_lengths, free, gap + smallest, smallest)
            if two is None:
                break
            held.remove(smallest)
            free[smallest] += 1
            for x in two:
                take(x)
            gap += smallest - sum(two)
        times = min(left[x] // held.count(x) for x in set(held))
        offset = 0
        for x in sorted(set(held), reverse=True):
            each = held.count(x)
            rows.append((x, used[x], times * each, n_bins, each, offset))
            used[x] += times * each
            left[x] -= times * each
            offset += each * x
        n_bins += times
        lengths = [x for x in lengths if left[x]]
    return pd.DataFrame(rows, columns=["length", "first", "total", "bin", "each", "offset"], dtype="int64")


class Places:
    """Looks up bin and offset by (length, rank)."""

    def __init__(self, rows: pd.DataFrame):
        rows = rows.sort_values(["length", "first"])
        self.at = {x: g.drop(columns="length").to_numpy() for x, g in rows.groupby("length")}

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        bins, offsets = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        for x in np.unique(length):
            own = length == x
            table = self.at[int(x)]
            k = np.searchsorted(table[:, 0], rank[own], side="right") - 1
            first, _, start, each, offset = table[k].T
            inside = rank[own] - first
            bins[own] = start + inside // each
            offsets[own] = offset + inside % each * int(x)
        return bins, offsets


def pieces(docs: DataFrame, tokenizer_file: str, end_id: int = 0, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` (and ``ids``, as bytes) of each piece of each row."""
    fields = [("doc_id", T.LongType()), ("piece", T.IntegerType()), ("start", T.LongType()), ("length", T.LongType()), ("ids_crc32", T.LongType())]
    fields += [("ids", T.BinaryType())] * with_ids
    names = [f[0] for f in fields]
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokenizer = tokenizer_of(tokenizer_file)
        for b in batches:
            rows = []
            for doc_id, text in zip(b.doc_id.astype("Int64"), b.text, strict=True):
                ids = memoryview(tokenizer.encode(text) + end)
                for k, (start, length) in enumerate(cut(len(ids) // 4, capacity)):
                    own = ids[4 * start : 4 * (start + length)]
                    rows.append((doc_id, k, start, length, zlib.crc32(own), *([bytes(own)] * with_ids)))
            yield pd.DataFrame(rows, columns=names).astype({"doc_id": "Int64"})

    schema = T.StructType([T.StructField(*f) for f in fields])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(run, schema)


def pack(cut_pieces: DataFrame, capacity: int = CAPACITY, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``cut_pieces`` with ``sequence_id`` and ``offset``.

    Every row goes to one sequence; rows may repeat and ids may be null.  An
    empty table gives no rows.
    """
    rows = written(cut_pieces.withColumn("row", F.monotonically_increasing_id()), "pieces")
    counts = {r["length"]: r["count"] for r in rows.groupBy("length").count().collect()}
    places = Places(plan(counts, capacity))
    buckets = max(1, sum(counts.values()) // bucket_rows)
    dealt = rows.withColumn("bucket", F.pmod(F.xxhash64("row"), F.lit(buckets)))
    by_length = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = (
        dealt.groupBy("length", "bucket")
        .agg(F.count(F.lit(1)).alias("n"))
        .select("length", "bucket", F.coalesce(F.sum("n").over(by_length), F.lit(0)).alias("before"))
    )
    inside = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("row"))
    ranked = dealt.withColumn("rank", inside - 1).join(before, ["length", "bucket"])
    keep = cut_pieces.columns

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            bins, offsets = places.find(b.length.to_numpy(), (b["rank"] + b["before"]).to_numpy())
            yield b[keep].assign(doc_id=b.doc_id.astype("Int64"), sequence_id=bins, offset=offsets)

    schema = T.StructType([*cut_pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return ranked.select(*keep, "rank", "before").mapInPandas(place, schema)


def pack_documents(docs: DataFrame, tokenizer_file: str, end_id: int = 0, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Cut, then pack all rows of ``docs`` (``doc_id``, ``text``); null texts count as
    empty and hold the end id alone.  Other columns are not read."""
    return pack(pieces(docs, tokenizer_file, end_id, capacity, with_ids), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """``sequence_id, n_tokens, ids`` (bytes) from pieces packed with their ids.

    A group holds at most one sequence, so it never exceeds the capacity.
    """
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return (
        packed.groupBy("sequence_id")
        .agg(F.sum("length").alias("n_tokens"), parts.alias("parts"))
        .select("sequence_id", "n_tokens", F.aggregate("parts", F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"))
    )
