"""Best-fit packing into bins of several permitted lengths.

Pieces of one length are alike, so the packing is worked out on the counts
of each length: at most as many numbers as the longest permitted length,
whatever the number of documents. Best fit decreasing puts each piece into
the open bin that it fills best, and opens the bin of the least cost per
token if it fits none; bins of the same contents are kept as one group with
a count. Several ways to choose the bin to open are tried and the cheapest
result is kept; at last each bin shrinks to the shortest length that holds
its contents. Pieces then find their place by their rank within their length.

Defined cases: a document longer than the longest bin is cut into pieces, all
of them packed; a null text and one without words has no tokens and gets one
row without a bin. Repeated and null ids are rows like any other.
"""

from __future__ import annotations

import bisect
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.llm.common import read, running_offset, words_of
from fieldloom.plans.storage import saved

LENGTHS = (512, 1024, 2048, 4096, 8192)


def cost(length: int) -> float:
    """Of one sequence: a fixed part, a linear one and attention."""
    return 32.0 + length + length * length / 8192.0


class _Bins:
    """Groups of bins with equal contents: ``[count, length, {size: number}]`` by the room left."""

    def __init__(self) -> None:
        self.by_room: dict[int, list[list]] = defaultdict(list)
        self.rooms: list[int] = []

    def add(self, room: int, count: int, length: int, held: dict[int, int]) -> None:
        if not self.by_room[room]:
            bisect.insort(self.rooms, room)
        self.by_room[room].append([count, length, held])

    def tightest(self, size: int):
        i = bisect.bisect_left(self.rooms, size)
        if i == len(self.rooms):
            return None
        room = self.rooms[i]
        group = self.by_room[room].pop()
        if not self.by_room[room]:
            self.rooms.pop(i)
        return room, group


def pack_counts(counts: dict[int, int], lengths: tuple[int, ...] = LENGTHS, cost: Callable[[int], float] = cost) -> list[tuple[int, int, dict[int, int]]]:
    """Groups ``(bins, length, {size: pieces in each})`` for ``counts`` of pieces by size."""
    lengths = tuple(sorted(lengths))
    best, least = [], float("inf")
    for trust in (1.0, 0.5, 0.0):  # how much of a new bin's room later pieces are expected to fill
        bins = _Bins()
        rest = sum(s * n for s, n in counts.items())
        for size in sorted(counts, reverse=True):
            n = counts[size]
            while n and (found := bins.tightest(size)):
                room, (count, length, held) = found
                each = room // size
                whole = min(count, n // each)
                if whole:
                    bins.add(room - each * size, whole, length, {**held, size: each})
                    n -= whole * each
                    count -= whole
                if count and 0 < n < each:
                    bins.add(room - n * size, 1, length, {**held, size: n})
                    n = 0
                    count -= 1
                if count:
                    bins.add(room, count, length, held)
            if n:
                rest_small = max(0, rest - counts[size] * size)
                fits = [x for x in lengths if x >= size]
                length = min(fits, key=lambda x: (cost(x) / min(x, max(size, (x // size) * size) + trust * min(x % size, rest_small)), x))
                each = length // size
                if n // each:
                    bins.add(length - each * size, n // each, length, {size: each})
                if n % each:
                    bins.add(length - n % each * size, 1, length, {size: n % each})
            rest -= counts[size] * size
        groups = []
        for room in sorted(bins.by_room):
            for count, length, held in bins.by_room[room]:
                used = length - room
                groups.append((count, next(x for x in lengths if x >= used), held))
        total = sum(c * cost(x) for c, x, _ in groups)
        if total < least:
            best, least = groups, total
    return best


def _ranges(groups: list[tuple[int, int, dict[int, int]]]) -> np.ndarray:
    """Rows ``size, first rank, pieces in each bin, first bin, offset in the bin, length``, by size and rank."""
    next_rank: dict[int, int] = defaultdict(int)
    rows, first = [], 0
    for count, length, held in groups:
        at = 0
        for size, each in held.items():
            rows.append((size, next_rank[size], each, first, at, length))
            next_rank[size] += each * count
            at += each * size
        first += count
    table = np.array(rows, dtype=np.int64).reshape(-1, 6)
    return table[np.lexsort((table[:, 1], table[:, 0]))]


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lengths: tuple[int, ...] = LENGTHS, cost: Callable[[int], float] = cost) -> DataFrame:
    """Pack all documents, measured in words.

    Returns ``doc_id, piece, start, size`` (tokens of the document), ``bin_id,
    bin_offset, bin_length``. What is sent to the driver and back is bounded
    by the longest length, not by the number of documents.
    """
    spark = docs.sparkSession
    longest = max(lengths)
    sizes = docs.select(F.col(id_col).alias("doc_id"), words_of(text_col).alias("words"))
    n = F.greatest(F.lit(1), F.ceil(F.col("words") / longest))
    pieces = sizes.select("doc_id", "words", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("piece"))
    pieces = saved(pieces.select("doc_id", "piece", (F.col("piece") * longest).alias("start"), F.least(F.lit(longest), F.col("words") - F.col("piece") * longest).cast("int").alias("size")), "pieces")
    counts = {r["size"]: r["n"] for r in pieces.groupBy("size").agg(F.count("*").alias("n")).where("size > 0").collect()}
    table = spark.sparkContext.broadcast(_ranges(pack_counts(counts, lengths, cost)))
    ranked = running_offset(pieces.withColumn("one", F.lit(1)), ["size"], "one", ["doc_id", "piece"], sum(counts.values()), "rank")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = table.value
        keys = t[:, 0] * (1 << 44) + t[:, 1]
        for b in batches:
            size, rank = b["size"].to_numpy().astype(np.int64), b["rank"].to_numpy()
            none = size == 0
            if len(t):
                i = np.maximum(np.searchsorted(keys, size * (1 << 44) + rank, side="right") - 1, 0)
                r, k = t[i], rank - t[i, 1]
                found = [r[:, 3] + k // r[:, 2], r[:, 4] + k % r[:, 2] * r[:, 0], r[:, 5]]
            else:
                found = [np.zeros(len(size), np.int64)] * 3
            yield pa.RecordBatch.from_arrays([*b.columns[:4], *(pa.array(v, pa.int64(), mask=none) for v in found)], names=["doc_id", "piece", "start", "size", "bin_id", "bin_offset", "bin_length"])

    id_type = pieces.schema["doc_id"].dataType.simpleString()
    cols = ranked.select("doc_id", "piece", "start", "size", "rank")
    return cols.mapInArrow(place, f"doc_id {id_type}, piece long, start long, size int, bin_id long, bin_offset long, bin_length long")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into bins of the permitted lengths."""
    return pack(read(spark, sf_dir, "documents"))
