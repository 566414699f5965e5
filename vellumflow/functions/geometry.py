"""Polygons and baselines: arrays of (x int, y int). Column expressions, and Arrow-batched functions where the step depends on the last."""

from __future__ import annotations

import math
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

POINTS = "array<struct<x:int,y:int>>"
#: Points that a step over Arrow batches takes at once; a row of more is taken alone.
AT_ONCE = 1 << 18


def parse_points(text: Column) -> Column:
    """``x,y x,y`` as points; null for null, no points for an empty text."""
    pair = lambda p: F.struct(F.split(p, ",")[0].cast("int").alias("x"), F.split(p, ",")[1].cast("int").alias("y"))
    return F.transform(F.filter(F.split(F.trim(text), r"\s+"), lambda p: p != ""), pair)


def print_points(points: Column) -> Column:
    return F.array_join(F.transform(points, lambda p: F.concat(p.x.cast("string"), F.lit(","), p.y.cast("string"))), " ")


def is_polygon(points: Column) -> Column:
    return F.coalesce(F.size(points) >= 3, F.lit(False))


def is_baseline(points: Column) -> Column:
    return F.coalesce(F.size(points) >= 2, F.lit(False))


def first_valid(*polygons: Column) -> Column:
    """The first with more than three points."""
    return F.coalesce(*[F.when(F.size(p) > 3, p) for p in polygons])


def no_repeats(points: Column) -> Column:
    """Without points that equal the one before."""
    return F.filter(points, lambda p, i: (i == 0) | ~(p.eqNullSafe(F.try_element_at(points, F.greatest(i, F.lit(1))))))


def reverse(points: Column) -> Column:
    return F.reverse(points)


def scaled_down(points: Column, factor: float) -> Column:
    return F.transform(points, lambda p: F.struct((p.x / factor).cast("int").alias("x"), (p.y / factor).cast("int").alias("y")))


def rotated(points: Column, angle: float) -> Column:
    c, s = math.cos(angle), math.sin(angle)
    return F.transform(points, lambda p: F.struct((p.x * c - p.y * s).cast("int").alias("x"), (p.x * s + p.y * c).cast("int").alias("y")))


def bounds(points: Column, grow_x: int = 0, grow_y: int = 0) -> Column:
    xs, ys = F.transform(points, lambda p: p.x), F.transform(points, lambda p: p.y)
    return F.struct((F.array_min(xs) - grow_x).alias("x0"), (F.array_min(ys) - grow_y).alias("y0"), (F.array_max(xs) + grow_x).alias("x1"), (F.array_max(ys) + grow_y).alias("y1"))


def average_y(points: Column) -> Column:
    """Ends weigh one, inner points two."""
    n = F.size(points)
    total = F.aggregate(F.transform(points, lambda p, i: p.y * F.when((i == 0) | (i == n - 1), 1.0).otherwise(2.0)), F.lit(0.0), lambda a, v: a + v)
    return F.when(n > 1, total / (2 * n - 2)).when(n == 1, points[0].y.cast("double"))


def raster(points: Column) -> Column:
    """Every unit step of the longer axis between neighbouring points."""
    n = F.size(points)

    def side(i: Column) -> Column:
        a, b = points[i], points[i + 1]
        steps = F.greatest(F.abs(b.x - a.x), F.abs(b.y - a.y))
        at = lambda k: F.struct(F.floor(a.x + (b.x - a.x) * k / steps + 0.5).cast("int").alias("x"), F.floor(a.y + (b.y - a.y) * k / steps + 0.5).cast("int").alias("y"))
        return F.when(steps > 0, F.transform(F.sequence(F.lit(0), steps - 1), at)).otherwise(F.array().cast(POINTS))

    inner = F.when(n > 1, F.flatten(F.transform(F.sequence(F.lit(0), F.greatest(n - 2, F.lit(0))), side))).otherwise(F.array().cast(POINTS))
    return F.when(n > 0, F.concat(inner, F.array(F.element_at(points, -1))))


def thinned(points: Column, distance: int) -> Column:
    """At most five points stay as they are; others become max(2, n / distance + 1) evenly spaced ones, the last kept."""
    n = F.size(points)
    k = F.greatest(F.lit(2), F.floor((n - 1) / distance).cast("int") + 1)
    return F.when(n <= 5, points).otherwise(F.transform(F.sequence(F.lit(0), k - 1), lambda i: F.element_at(points, (F.floor(i * (n - 1) / (k - 1)) + 1).cast("int"))))


def part(points: Column, start: Column, end: Column) -> Column:
    """The rasterised points from share ``start`` to share ``end``."""
    n = F.size(points)
    a, b = F.floor(start * n).cast("int"), F.greatest(F.floor(start * n).cast("int"), F.ceil(end * n).cast("int") - 1)
    return F.slice(points, a + 1, b - a + 1)


def offsets(x: Column, y: Column, angle: float) -> Column:
    """(along, off): distances along and across a direction, y pointing down."""
    c, s = math.cos(angle), math.sin(angle)
    return F.struct((x * c - y * s).alias("along"), (x * s + y * c).alias("off"))


def snapped(angle: Column, within: float = math.pi / 4) -> Column:
    """To 0 or a right angle."""
    return F.when(F.abs(angle) <= within, 0.0).otherwise(math.pi / 2)


def line_orientation(region: Column, baseline: Column, near: float = 0.02) -> Column:
    """The region's orientation, snapped to quarter turns, else the baseline's; nearly none is 0."""
    snap = region
    for quarter in (math.pi, math.pi / 2, 3 * math.pi / 2):
        snap = F.when(F.abs(region - quarter) < near, quarter).otherwise(snap)
    out = F.coalesce(snap, baseline)
    return F.when(F.abs(out) < near, 0.0).otherwise(out)


def orientation(points: DataFrame, keys: list[str]) -> DataFrame:
    """keys, angle in [0, 2 pi): the regression line of (i, x, y) rows, y flipped, in reading direction from the first to the last point."""
    y = -F.col("y")
    told = points.groupBy(*keys).agg(F.regr_slope(y, F.col("x")).alias("_s"), (F.max("x") - F.min("x")).alias("_w"), F.min_by("x", "i").alias("_x0"), F.max_by("x", "i").alias("_x1"), F.min_by(y, "i").alias("_y0"), F.max_by(y, "i").alias("_y1"))
    flat = F.when(F.col("_w") < 2, F.when(F.col("_y1") >= F.col("_y0"), math.pi / 2).otherwise(-math.pi / 2)).otherwise(F.atan("_s") + F.when(F.col("_x1") < F.col("_x0"), math.pi).otherwise(0.0))
    return told.select(*keys, F.pmod(flat, F.lit(2 * math.pi)).alias("angle"))


def envelope(points: DataFrame, keys: list[str]) -> DataFrame:
    """For each x of rasterised (x, y) rows the least and the greatest y."""
    return points.groupBy(*keys, "x").agg(F.min("y").alias("top"), F.max("y").alias("bottom"))


def filled_tolerances(rows: DataFrame, keys: list[str], value: str, share: float) -> DataFrame:
    """Zero is missing and becomes the mean of the others; nothing is above the mean; all times ``share``."""
    from pyspark.sql import Window

    mean = F.avg(F.when(F.col(value) > 0, F.col(value))).over(Window.partitionBy(*keys))
    own = F.when(F.col(value) > 0, F.col(value)).otherwise(mean)
    return rows.withColumn("tolerance", F.least(own, mean) * share)


def grid_join(points: DataFrame, boxes: DataFrame, keys: list[str], cell: int = 256) -> DataFrame:
    """Points (x, y) with the boxes (x0, y0, x1, y1) that hold them: an equi-join on grid cells, then the exact range."""
    cut = lambda c: F.floor(F.col(c) / cell).cast("int")
    spread = boxes.withColumn("_cx", F.explode(F.sequence(cut("x0"), cut("x1")))).withColumn("_cy", F.explode(F.sequence(cut("y0"), cut("y1"))))
    own = points.withColumn("_cx", cut("x")).withColumn("_cy", cut("y"))
    return own.join(spread, [*keys, "_cx", "_cy"]).where("x between x0 and x1 and y between y0 and y1").drop("_cx", "_cy")


def _flat(points: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """x, y of all rows' points one after another, where each row begins and the last ends, which rows are null."""
    off, null = np.asarray(points.offsets).astype(np.int64), ~np.asarray(points.is_valid())
    own = points.values.slice(off[0], off[-1] - off[0])
    x, y = own.field("x"), own.field("y")
    if own.null_count or x.null_count or y.null_count:
        raise ValueError("a point without coordinates")
    return x.to_numpy().astype(np.int64), y.to_numpy().astype(np.int64), off - off[0], null


def _listed(x, y, off: np.ndarray, null: np.ndarray) -> pa.Array:
    own = pa.StructArray.from_arrays([pa.array(x, pa.int32()), pa.array(y, pa.int32())], ["x", "y"])
    return pa.ListArray.from_arrays(pa.array(off, pa.int32()), own, mask=pa.array(null) if len(null) else None)


def _by_row(fn: Callable[[list[tuple[int, int]]], list[tuple[int, int]]]):
    """``fn`` of each row's points; of a batch only one row is taken apart at a time."""

    @F.arrow_udf(POINTS)
    def run(points: pa.Array) -> pa.Array:
        x, y, off, null = _flat(points)
        xs, ys, ends = array("i"), array("i"), [0]
        for a, b in zip(off[:-1], off[1:], strict=True):
            for p, q in fn(list(zip(x[a:b].tolist(), y[a:b].tolist(), strict=True))):
                xs.append(p)
                ys.append(q)
            ends.append(len(xs))
        return _listed(np.frombuffer(xs, np.intc), np.frombuffer(ys, np.intc), np.array(ends), null)

    return run


def _pieces(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of rows of at most ``AT_ONCE`` points together, or of one row."""
    ends, a = np.cumsum(sizes), 0
    while a < len(sizes):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + AT_ONCE, "right")))
        yield a, b
        a = b


def _steps(x: np.ndarray, off: np.ndarray) -> np.ndarray:
    """From each point to the next of its row; of a row's last point 0."""
    d = np.append(np.diff(x), 0)[: len(x)]
    d[off[1:][np.diff(off) > 0] - 1] = 0
    return d


def _raster_sizes(x: np.ndarray, y: np.ndarray, off: np.ndarray) -> np.ndarray:
    """How many points each point becomes in ``raster``."""
    n = np.maximum(abs(_steps(x, off)), abs(_steps(y, off)))
    n[off[1:][np.diff(off) > 0] - 1] = 1
    return n


def _rastered(x: np.ndarray, y: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``raster`` of flat rows."""
    n = _raster_sizes(x, y, off)
    ends = np.append(0, np.cumsum(n))
    own = np.repeat(np.arange(len(x)), n)
    k = np.arange(ends[-1]) - ends[own]
    at = lambda v: np.floor(v[own] + _steps(v, off)[own] * k / n[own] + 0.5).astype(np.int64)
    return at(x), at(y), ends[off]


def _bends(x: np.ndarray, y: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Which points of flat rows ``reduce_collinear`` keeps: the ends, and those from which a step leaves the direction of the last step that was one. A row that begins with a repeated point has no direction."""
    dx, dy = _steps(x, off), _steps(y, off)
    if len(x) and max(abs(dx).max(), abs(dy).max()) >= 1 << 31:
        dx, dy = dx.astype(object), dy.astype(object)
    full = np.diff(off) > 0
    first, keep = off[:-1][full], np.zeros(len(x), bool)
    moves = ((dx != 0) | (dy != 0)).astype(bool)
    row = np.repeat(np.arange(len(off) - 1), np.diff(off))
    inner = moves & moves[off[row]]
    inner[first] = False
    j = np.flatnonzero(inner)
    before = np.maximum.accumulate(np.where(moves, np.arange(len(x)), 0))[j - 1]
    keep[j] = dx[j] * dy[before] != dy[j] * dx[before]
    keep[first] = keep[off[1:][full] - 1] = True
    return keep


def _reduced(points: pa.Array, rastered: bool) -> Iterator[tuple[int, int, pa.Array]]:
    """Of runs of rows the first, the end and the reduced points; with ``rastered``, of their raster, which is null without points."""
    x, y, off, null = _flat(points)
    sizes = np.diff(np.append(0, np.cumsum(_raster_sizes(x, y, off)))[off]) if rastered else np.diff(off)
    for a, b in _pieces(sizes):
        u, v, ends, none = x[off[a] : off[b]], y[off[a] : off[b]], off[a : b + 1] - off[a], null[a:b]
        if rastered:
            none = none | (np.diff(ends) == 0)
            u, v, ends = _rastered(u, v, ends)
        keep = _bends(u, v, ends)
        yield a, b, _listed(u[keep], v[keep], np.append(0, np.cumsum(keep))[ends], none)


def reduce_collinear(points: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Each run of points on one line through its first becomes its first and its last point; a turn back on the line is no new direction."""
    if len(points) < 3:
        return list(points)
    (ax, ay), last = points[0], points[1]
    out, dx, dy = [points[0]], last[0] - ax, last[1] - ay
    for x, y in points[2:]:
        if (x - ax) * dy != dx * (y - ay):
            out.append(last)
            (ax, ay), dx, dy = last, x - last[0], y - last[1]
        last = (x, y)
    return [*out, last]


def monotone(points: list[tuple[int, int]], angle: float = 0.0) -> list[tuple[int, int]]:
    """Without points that the last kept one reaches only by a turn of a right angle or more from the direction; repeated points go too."""
    c, s = math.cos(angle), math.sin(angle)
    out = list(points[:1])
    for x, y in points[1:]:
        if (x - out[-1][0]) * c - (y - out[-1][1]) * s > 1e-9:
            out.append((x, y))
    return out


def hull(points: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The convex hull, counter-clockwise from the least point; fewer than three points are copied."""
    own = sorted(set(points))
    if len(own) < 3:
        return list(points) if len(points) < 3 else own
    halves = []
    for side in (own, own[::-1]):
        chain: list[tuple[int, int]] = []
        for p in side:
            while len(chain) > 1 and (chain[-1][0] - chain[-2][0]) * (p[1] - chain[-2][1]) - (chain[-1][1] - chain[-2][1]) * (p[0] - chain[-2][0]) <= 0:
                chain.pop()
            chain.append(p)
        halves.append(chain[:-1])
    return halves[0] + halves[1]


def inside(polygon: list[tuple[int, int]], x: float, y: float) -> bool:
    out = False
    for (ax, ay), (bx, by) in zip(polygon, polygon[1:] + polygon[:1], strict=True):
        if (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax:
            out = not out
    return out


def seam(energy: list[list[float]], low: list[int], high: list[int], toward: list[int] | None = None, pull: float = 0.0, outside: float = 50_000.0) -> tuple[float, list[int]]:
    """The cheapest path from left to right, a row up or down at each column. Rows not strictly between ``low`` and ``high`` cost a penalty alone, the others
    their energy and ``pull`` for each row that they are away from ``toward``. Ties: straight on, then up; at the end the upper row."""
    rows, cols = len(energy), len(energy[0]) if energy else 0
    if not cols:
        return 0.0, []

    def own(x: int, y: int) -> float:
        return energy[y][x] + (pull * abs(toward[x] - y) if toward else 0.0) if low[x] < y < high[x] else outside

    cost, back = [own(0, y) for y in range(rows)], []
    for x in range(1, cols):
        steps = [min((cost[z], k, z) for k, z in enumerate((y, y - 1, y + 1)) if 0 <= z < rows) for y in range(rows)]
        cost = [own(x, y) + c for y, (c, _, _) in enumerate(steps)]
        back.append([z for *_, z in steps])
    y = min(range(rows), key=lambda r: (cost[r], r))
    total, path = cost[y], [y]
    for step in reversed(back):
        y = step[y]
        path.append(y)
    return total, path[::-1]


def collinear_reduced(points: Column) -> Column:
    @F.arrow_udf(POINTS)
    def run(s: pa.Array) -> pa.Array:
        return pa.concat_arrays([_listed([], [], np.array([0]), np.array([], bool)), *[p for *_, p in _reduced(s, False)]])

    return run(points)


def collinear_rows(df: DataFrame, name: str, rastered: bool = False) -> DataFrame:
    """``df`` with the points of one column reduced: for columns of nested lambdas, whose values Spark does not hand to a UDF column. With ``rastered`` the points of their
    raster, which is made here for some rows at a time, as it is many times as large as the points."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            at = part.schema.get_field_index(name)
            for a, b, points in _reduced(part.column(at), rastered):
                columns = part.slice(a, b - a).columns
                columns[at] = points
                yield pa.RecordBatch.from_arrays(columns, names=part.schema.names)

    return df.mapInArrow(run, df.schema)


def monotone_points(points: Column, angle: float = 0.0) -> Column:
    return _by_row(lambda ps: monotone(ps, angle))(points)


def seams(rows: DataFrame, pull: float = 0.0) -> DataFrame:
    """key, cost, path of each row's ``seam`` (key, energy: array of rows, low, high, toward: arrays or null)."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            found = [seam([list(r) for r in e], list(lo), list(hi), None if t is None else list(t), pull) for e, lo, hi, t in zip(part.energy, part.low, part.high, part.toward, strict=True)]
            yield pd.DataFrame({"key": part.key, "cost": [c for c, _ in found], "path": [p for _, p in found]})

    return rows.select("key", "energy", "low", "high", "toward").mapInPandas(run, "key long, cost double, path array<int>")


def convex_hull(points: Column) -> Column:
    return _by_row(hull)(points)


@F.pandas_udf(T.BooleanType())
def contains(polygon: pd.Series, x: pd.Series, y: pd.Series) -> pd.Series:
    return pd.Series([inside([(p["x"], p["y"]) for p in ps], a, b) for ps, a, b in zip(polygon, x, y, strict=True)])
