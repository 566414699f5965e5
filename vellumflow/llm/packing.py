"""Operator 6, packing by best-fit decreasing.

Documents are cut into full windows of ``CAPACITY`` tokens and a rest. Best-fit decreasing puts each piece, longest first,
into the open window with the least remaining capacity that suffices; a segment tree indexed by remaining capacity finds it.
As pieces of one length are alike, the algorithm runs once for the whole corpus on the histogram of lengths and places
runs of pieces into runs of windows: its work and result are bounded by the capacity, not by the documents. Spark then gives
each piece its rank within its length, which says where in the plan it stands. The windows are those that packing piece by piece
would make.

Ranks need no sort of a whole length: a common length, as that of the full windows, is parted by ``PART`` pieces, whose order within their part and whose part's
place give the rank. So no task ranks more than some ``PART`` pieces, however many documents, or copies of one, there are. Among pieces of one length the order is that
of the table's rows; among windows of one remaining capacity the first opened is taken. Tokens are runs of other than white space, or what ``length`` says.

Null and empty texts have no tokens and no row. Repeated rows are packed each. Rows without a doc_id are packed with a null; a doc_id has to be an integer.
Other columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import written

CAPACITY = 2048
#: Pieces of one length that are ranked together, about.
PART = 50_000


class Capacities:
    """A segment tree over remaining capacities 0..n: which have open windows, and the least of at least x."""

    def __init__(self, n: int) -> None:
        self.size = 1 << max(1, n.bit_length())
        self.any = np.zeros(2 * self.size, bool)

    def set(self, r: int, on: bool) -> None:
        i = r + self.size
        self.any[i] = on
        while i > 1:
            i >>= 1
            now = self.any[2 * i] or self.any[2 * i + 1]
            if self.any[i] == now:
                break
            self.any[i] = now

    def least(self, x: int) -> int:
        """The least r >= x with open windows, or -1."""
        i = x + self.size
        if self.any[i]:
            return x
        while i > 1:
            if i % 2 == 0 and self.any[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if self.any[2 * i] else 2 * i + 1
                return i - self.size
            i >>= 1
        return -1


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Placements (length, first rank, end rank, first window, pieces per window, offset in the window), by length and rank.

    The piece of rank t is in window first + (t - first rank) // per, at offset + (t - first rank) % per * length.
    """
    tree = Capacities(capacity)
    open_: dict[int, list[tuple[int, int]]] = {}
    out: list[tuple[int, int, int, int, int, int]] = []
    windows = 0

    def put(r: int, first: int, n: int) -> None:
        if r and n:
            heapq.heappush(open_.setdefault(r, []), (first, n))
            tree.set(r, True)

    for length in sorted(counts, reverse=True):
        rank, end = 0, counts[length]
        while rank < end:
            r = tree.least(length)
            if r < 0:
                r, per = capacity, capacity // length
                first, n = windows, -(-(end - rank) // per)
                windows += n
            else:
                first, n = heapq.heappop(open_[r])
                if not open_[r]:
                    tree.set(r, False)
                per = r // length
            placed = min(end - rank, n * per)
            full, rest = divmod(placed, per)
            out.append((length, rank, rank + placed, first, per, capacity - r))
            put(r - per * length, first, full)
            if rest:
                put(r - rest * length, first + full, 1)
            put(r, first + full + bool(rest), n - full - bool(rest))
            rank += placed
    return np.array(out, np.int64).reshape(-1, 6)


def token_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^ \t\r\n]+")), F.lit(0)).cast("long")


def _place(placements: np.ndarray, parts: np.ndarray):
    """``parts``: (length, part of the length, rank of its first piece), sorted."""
    order = np.lexsort((placements[:, 1], placements[:, 0]))
    p = placements[order]
    cut = {int(x): (int(np.searchsorted(p[:, 0], x)), int(np.searchsorted(p[:, 0], x, "right"))) for x in np.unique(p[:, 0])}
    wide = int(parts[:, 1].max(initial=0)) + 1
    keys, starts = parts[:, 0] * wide + parts[:, 1], parts[:, 2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, salt, rank = (b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "salt", "rank"))
            if not len(length):
                continue
            t = rank + starts[np.searchsorted(keys, length * wide + salt)]
            at = np.empty(len(length), np.int64)
            for x in np.unique(length).tolist():
                own, (lo, hi) = length == x, cut[x]
                at[own] = lo + np.searchsorted(p[lo:hi, 1], t[own], "right") - 1
            row = p[at]
            nth = t - row[:, 1]
            cols = [pa.array(row[:, 3] + nth // row[:, 4]), *(b.column(b.schema.get_field_index(c)) for c in ("doc_id", "part", "start", "length")), pa.array(row[:, 5] + nth % row[:, 4] * length)]
            yield pa.RecordBatch.from_arrays(cols, ["window_id", "doc_id", "part", "start", "length", "offset"])

    return run


def pieces(docs: DataFrame, length: Column | None = None, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, part, start, length of the pieces; start counts tokens of the document."""
    n = token_count(F.col("text")) if length is None else F.coalesce(length.cast("long"), F.lit(0))
    told = docs.select(F.col("doc_id").cast("long").alias("doc_id"), n.alias("_n")).where("_n > 0")
    part = F.posexplode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1, F.lit(capacity).cast("long"))).alias("part", "start")
    return told.select("doc_id", "_n", part).select("doc_id", F.col("part").cast("long").alias("part"), "start", F.least(F.lit(capacity).cast("long"), F.col("_n") - F.col("start")).alias("length"))


def packed(docs: DataFrame, length: Column | None = None, capacity: int = CAPACITY, part: int = PART) -> DataFrame:
    """window_id, doc_id, part, start, length, offset of all pieces."""
    spark = docs.sparkSession
    cut = written(pieces(docs, length, capacity).withColumn("row", F.monotonically_increasing_id()), "pieces")
    sizes = {r.length: r.n for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # a row for each length, of which there are ``capacity``
    table = spark.createDataFrame([(x, max(1, -(-n // part))) for x, n in sizes.items()], "length long, k long")
    salt = F.pmod(F.xxhash64("row"), F.col("k"))  # the row's number is in the table, so a task that runs again sees the same
    cut = cut.join(F.broadcast(table), "length").withColumn("salt", salt)
    first: list[tuple[int, int, int]] = []
    for r in sorted(cut.groupBy("length", "salt").agg(F.count("*").alias("n")).collect()):  # a row for each length, and for each ``part`` pieces
        before = first[-1] if first and first[-1][0] == r.length else None
        first.append((r.length, r.salt, before[2] + n_before if before else 0))
        n_before = r.n
    rank = F.row_number().over(Window.partitionBy("length", "salt").orderBy("row")) - 1
    ranked = cut.withColumn("rank", rank.cast("long")).drop("row", "k")
    place = _place(plan(sizes, capacity), np.array(first, np.int64).reshape(-1, 3))
    return ranked.mapInArrow(place, "window_id long, doc_id long, part long, start long, length long, offset long")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(spark.read.parquet(f"{sf_dir}/documents.parquet"))
