"""Connected components, greedy matching and path search."""

from __future__ import annotations

import heapq
from array import array
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellumflow.shared import checkpointed

_PATH = T.ArrayType(T.StructType().add("op", T.StringType()).add("i", T.IntegerType()).add("j", T.IntegerType()).add("cost", T.DoubleType()))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component (the least node that it is connected to) of all nodes of the edges.

    Each round hangs nodes under the least neighbour of their neighbourhood, alternately among greater and smaller ones, so rounds grow with
    the logarithm of the size and no node's neighbourhood is collected.
    """
    pairs = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    nodes = edges.select(F.col(a).alias("node")).union(edges.select(F.col(b).alias("node"))).distinct()
    now, before = checkpointed(pairs.where("u <> v").distinct()), None
    while True:
        both = now.union(now.select("v", "u"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        now = both.join(low, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = now.groupBy("u").agg(F.min("v").alias("m"))
        hung = now.join(low, "u")
        now = checkpointed(hung.select(F.col("v").alias("u"), F.col("m").alias("v")).union(hung.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        state = tuple(now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.shiftright(F.xxhash64("v", "u"), 20))).first())
        if state == before:
            break
        before = state
    return nodes.join(now.select(F.col("u").alias("node"), F.col("v").alias("component")), "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def greedy_match(costs: DataFrame, keys: list[str], most: float, schema: str | None = None) -> DataFrame:
    """One-to-one pairs (i, j, cost) within each key: the least cost below ``most`` again and again; ties go to the least i, then j."""

    def match(pdf: pd.DataFrame) -> pd.DataFrame:
        used_i, used_j, rows = set(), set(), []
        for r in pdf[pdf.cost < most].sort_values(["cost", "i", "j"]).itertuples():
            if r.i not in used_i and r.j not in used_j:
                used_i.add(r.i)
                used_j.add(r.j)
                rows.append(r.Index)
        return pdf.loc[rows]

    return costs.groupBy(*keys).applyInPandas(match, schema or costs.schema)


Move = tuple[str, int, int, float]


def best_path(n: int, m: int, moves: Callable[[int, int], list[Move]], keep: Callable[[int, int, float], bool] | None = None, every: bool = False, most: int = -1) -> list[tuple[str, int, int, float]] | None:
    """The cheapest path from (0, 0) to (n, m) by best-first search: (operation, i, j, cost so far) without the origin, or None.

    ``moves(i, j)`` gives (operation, next i, next j, cost). Of open cells the one of least cost goes first, then the one of the larger i,
    then j. ``keep`` filters cells before they are entered; a cell that it refuses leaves a known path to it as it is. ``every`` expands all cells
    rather than stopping at the end; a negative ``most`` sets no limit of expanded cells.
    """
    best = {(0, 0): (0.0, "", (0, 0))}
    queue, done, count = [(0.0, 0, 0)], set(), 0
    while queue:
        cost, i, j = heapq.heappop(queue)
        i, j = -i, -j
        if (i, j) in done:
            continue
        done.add((i, j))
        if (i, j) == (n, m) and not every:
            break
        if 0 <= most <= count:
            break
        count += 1
        for op, x, y, c in moves(i, j):
            if x > n or y > m or (x, y) in done or (keep and not keep(x, y, cost + c)):
                continue
            if (x, y) not in best or cost + c < best[x, y][0]:
                best[x, y] = (cost + c, op, (i, j))
                heapq.heappush(queue, (cost + c, -x, -y))
    if (n, m) not in best:
        return None
    path, at = [], (n, m)
    while at != (0, 0):
        cost, op, before = best[at]
        path.append((op, *at, cost))
        at = before
    return path[::-1]


def edit_moves(a: list, b: list, substitute: float = 1.0, insert: float = 1.0, delete: float = 1.0) -> Callable[[int, int], list[Move]]:
    def moves(i: int, j: int) -> list[Move]:
        out = []
        if i < len(a) and j < len(b):
            same = a[i] == b[j]
            out.append(("COR" if same else "SUB", i + 1, j + 1, 0.0 if same else substitute))
        if i < len(a):
            out.append(("DEL", i + 1, j, delete))
        if j < len(b):
            out.append(("INS", i, j + 1, insert))
        return out

    return moves


def transposed(moves: Callable[[int, int], list[Move]]) -> Callable[[int, int], list[Move]]:
    swap = {"INS": "DEL", "DEL": "INS"}
    return lambda i, j: [(swap.get(op, op), y, x, c) for op, x, y, c in moves(j, i)]


def edit_path(a: list, b: list) -> list[tuple[str, int, int, float]]:
    """``best_path`` of ``edit_moves`` at unit costs, ties included, by rows instead of a queue.

    At one cost the search takes the cells that it reached from the cost below, the later first, each followed by the matches that lead on
    from it; so a cell that only a match reaches has the turn of the cell where its run of matches began.
    """
    n, m = len(a), len(b)
    w = m + 1
    ops = [bytearray(w)]
    ops[0][1:] = b"\3" * m
    cost, turn = list(range(w)), list(range(w))
    for i, x in enumerate(a, 1):
        op = bytearray(w)
        op[0] = 2
        left, at = i, i * w
        here, own = [left], [at]
        for j, y in enumerate(b, 1):
            diag, up = cost[j - 1], cost[j]
            side = diag if x == y else diag + 1
            c = min(side, up + 1, left + 1)
            best, how = -1, 0
            if left + 1 == c:
                best, how = own[j - 1], 3
            if up + 1 == c and turn[j] > best:
                best, how = turn[j], 2
            if x != y and side == c and turn[j - 1] > best:
                best, how = turn[j - 1], 1
            op[j] = how
            here.append(c)
            own.append(at + j if how else turn[j - 1])
            left = c
        ops.append(op)
        cost, turn = here, own
    path, i, j, c = [], n, m, cost[m]
    while i or j:
        how = ops[i][j]
        path.append((("COR", "SUB", "DEL", "INS")[how], i, j, float(c)))
        c -= how > 0
        i, j = i - (how != 3), j - (how != 2)
    return path[::-1]


@F.arrow_udf(_PATH)
def alignment(a: pa.Array, b: pa.Array) -> pa.Array:
    """The cheapest edit path of two arrays. Of a batch only one path is held as Python objects at a time."""
    code, ends, null = {"COR": 0, "SUB": 1, "DEL": 2, "INS": 3}, array("i", [0]), []
    ops, at_i, at_j, costs = array("b"), array("i"), array("i"), array("d")
    for k in range(len(a)):
        x, y = a[k].as_py(), b[k].as_py()
        null.append(x is None or y is None)
        for op, i, j, c in [] if null[-1] else edit_path(x, y):
            ops.append(code[op])
            at_i.append(i)
            at_j.append(j)
            costs.append(c)
        ends.append(len(ops))
    flat = lambda v, kind, dtype: pa.array(np.frombuffer(v, dtype), kind)
    steps = [pa.array(list(code)).take(flat(ops, pa.int8(), np.int8)), flat(at_i, pa.int32(), np.intc), flat(at_j, pa.int32(), np.intc), flat(costs, pa.float64(), np.float64)]
    return pa.ListArray.from_arrays(flat(ends, pa.int32(), np.intc), pa.StructArray.from_arrays(steps, ["op", "i", "j", "cost"]), mask=pa.array(null, pa.bool_()) if null else None)


def align_lines(read: list[str], words: list[str], skip_word: float = 1.0, skip_line: float = 1.0, most: int = 10_000_000) -> list[tuple[int, int, int]]:
    """Monotone alignment of text without line breaks to read lines: (line, first word, end word) of each matched line.

    A line takes a run of words at the cost of their edit distance over the line's length, words and lines can be skipped. Our own definition of a
    step that the reference leaves to another library. More than ``most`` expanded cells are an error.
    """
    from functools import cache

    def distance(s: str, t: str) -> int:
        row = list(range(len(t) + 1))
        for i, x in enumerate(s, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(t, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    @cache
    def moves(i: int, j: int) -> list[Move]:
        out: list[Move] = []
        if j < len(words):
            out.append(("SKIP_WORD", i, j + 1, skip_word))
        if i < len(read):
            out.append(("SKIP_LINE", i + 1, j, skip_line))
            text = ""
            for k in range(j, len(words)):
                text = f"{text} {words[k]}".strip()
                if len(text) > 2 * len(read[i]) + 10:
                    break
                out.append(("LINE", i + 1, k + 1, distance(read[i], text) / max(1, len(read[i]))))
        return out

    path = best_path(len(read), len(words), moves, most=most)
    if path is None:
        raise ValueError(f"no alignment within {most} steps")
    out, j = [], 0
    for op, x, y, _ in path:
        if op == "LINE":
            out.append((x - 1, j, y))
        j = y
    return out
