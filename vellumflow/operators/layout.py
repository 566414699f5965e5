"""Lines on a page: distances, neighbours, orders and sums of pixels."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellumflow.functions import geometry as G
from vellumflow.functions import numeric as N


def boxes_meet(a: Column, b: Column, grow_x: float = 0.0, grow_y: float = 0.0) -> Column:
    """Whether two boxes (x0, y0, x1, y1) share a point when each is grown; rotate the points before, where the lines are not level."""
    return (a.x0 - grow_x <= b.x1 + grow_x) & (b.x0 - grow_x <= a.x1 + grow_x) & (a.y0 - grow_y <= b.y1 + grow_y) & (b.y0 - grow_y <= a.y1 + grow_y)


def point_distances(a: Column, b: Column) -> Column:
    """For each point of ``a`` the Manhattan distance to the nearest of ``b``."""
    return F.transform(a, lambda p: F.array_min(F.transform(b, lambda q: F.abs(p.x - q.x) + F.abs(p.y - q.y))))


def line_pairs(lines: DataFrame, reach: int) -> DataFrame:
    """Pairs of different lines (page, line, points) of one page whose boxes are at most ``reach`` apart: page, line, other, points, other_points."""
    own = lines.select("page", "line", "points", G.bounds(F.col("points")).alias("box"))
    other = own.select("page", F.col("line").alias("other"), F.col("points").alias("other_points"), F.col("box").alias("other_box"))
    met = own.join(other, "page").where((F.col("line") != F.col("other")) & boxes_meet(F.col("box"), F.col("other_box"), reach / 2, reach / 2))
    return met.drop("box", "other_box")


def nearest_lines(lines: DataFrame, reach: int = 1 << 20) -> DataFrame:
    """page, line, other, distance: the nearest other line within reach, by the least distance of points (ties: the least line)."""
    d = F.array_min(point_distances(F.col("points"), F.col("other_points")))
    near = line_pairs(lines, reach).select("page", "line", F.struct(d.alias("distance"), "other").alias("near"))
    return near.groupBy("page", "line").agg(F.min("near").alias("near")).select("page", "line", "near.other", "near.distance")


def line_tolerances(lines: DataFrame, reach: int, least: float = 20.0) -> DataFrame:
    """page, line, tolerance: the trimmed mean, over the line's points, of the distance to the nearest point of any other line within reach."""
    each = line_pairs(lines, reach).select("page", "line", F.posexplode(point_distances(F.col("points"), F.col("other_points"))).alias("pos", "d"))
    each = each.groupBy("page", "line", "pos").agg(F.min("d").alias("d"))
    return each.groupBy("page", "line").agg(N.trimmed_mean(F.collect_list(F.col("d").cast("double")), least).alias("tolerance"))  # as many as the line has points


def reading_rank(rows: DataFrame, keys: list[str], angle: str, x: str, y: str, ident: str) -> DataFrame:
    """Adds rank (from 1): down the page for level lines, else along the axis that the quarter turn makes the reading direction."""
    quarter = F.pmod(F.round(F.col(angle) / (math.pi / 2)), F.lit(4))
    along = F.when(quarter == 0, F.col(y)).when(quarter == 1, -F.col(x)).when(quarter == 2, -F.col(y)).otherwise(F.col(x))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(along, ident)))


def clusters_left_to_right(rows: DataFrame, keys: list[str], cluster: str, x: str, order: str) -> DataFrame:
    """Adds rank (from 1): clusters by their least x, and within a cluster the rows' own order."""
    told = rows.withColumn("_x", F.min(x).over(Window.partitionBy(*keys, cluster)))
    return told.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy("_x", cluster, order))).drop("_x")


def shrunk(pixels: DataFrame, keys: list[str], grid: int, step: int = 3) -> DataFrame:
    """keys, cell, y, ink: darkness of every ``step``-th pixel (x, y, v from 0 to 255) by cells of ``grid`` columns."""
    told = pixels.where(F.col("x") % step == 0).withColumn("cell", F.floor(F.col("x") / grid).cast("int"))
    return told.groupBy(*keys, "cell", "y").agg(F.sum(255 - F.col("v")).alias("ink"))


def side_means(pixels: DataFrame, keys: list[str], band: int = 25) -> DataFrame:
    """keys, first, last: the mean of the pixels in the band at either end of the rows' x."""
    w = Window.partitionBy(*keys)
    told = pixels.withColumn("_low", F.min("x").over(w)).withColumn("_high", F.max("x").over(w))
    near = lambda c: F.avg(F.when(c, F.col("v")))
    return told.groupBy(*keys).agg(near(F.col("x") < F.col("_low") + band).alias("first"), near(F.col("x") > F.col("_high") - band).alias("last"))


def resized(values: Column, grid: int, size: int) -> Column:
    """``size`` values by straight lines between those at 0, grid, 2 grid ..; beyond the last the last line goes on."""
    n = F.size(values)
    at = lambda i: F.least(F.floor(i / grid).cast("int"), n - 2)
    line = lambda i: F.get(values, at(i)) + (F.get(values, at(i) + 1) - F.get(values, at(i))) * (i / grid - at(i))
    return F.when(n > 1, F.transform(F.sequence(F.lit(0), F.lit(size - 1)), line)).when(n == 1, F.array_repeat(F.get(values, 0), size))


def elementwise(matrix: Column, fn) -> Column:
    """A function of a column on each element of an array of arrays."""
    return F.transform(matrix, lambda row: F.transform(row, fn))


def around(spans: DataFrame, keys: list[str]) -> DataFrame:
    """For each span of kind KW the first PRE span that holds its start after its own, and the first POST span that holds its end before its own.

    spans: keys, kind, start, end; the result: keys, start, end, pre (its start or null), post (its start or null).
    """
    own = lambda kind, name: spans.where(F.col("kind") == kind).select(*keys, F.col("start").alias(f"{name}_start"), F.col("end").alias(f"{name}_end"))
    kw = spans.where("kind = 'KW'").select(*keys, "start", "end")
    pre = kw.join(own("PRE", "p"), keys).where("p_start < start and start <= p_end").groupBy(*keys, "start", "end").agg(F.min("p_start").alias("pre"))
    post = kw.join(own("POST", "p"), keys).where("p_start <= end and end < p_end").groupBy(*keys, "start", "end").agg(F.min("p_start").alias("post"))
    return kw.join(pre, [*keys, "start", "end"], "left").join(post, [*keys, "start", "end"], "left")
