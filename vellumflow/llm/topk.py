"""Operator 1, exact top-k search by inner product: norm-bucketed retrieval.

The queries are the rows whose vec_id is divisible by ``every``, the probes all rows. Probes are cut into tiles by falling length, queries
into blocks; a block and a tile meet in one task. First each query meets the tile of the longest probes, and the k-th product found there is
the floor for all other tiles. A query goes only to those tiles whose longest probe could still reach its floor, so short probes are never sent a
query that they can't serve.

Within a tile the probes are bucketed; a bucket's lengths differ by ``SHRINK`` at most. For each query and bucket, the k-th best product so
far over the lengths of the query and the bucket's longest probe is a local cosine threshold. Above one, the bucket and all that follow are
passed over. Otherwise the bucket chooses how to prune: by length (the probes of at least the least length that can reach the product), or
by coordinate (the probes whose normalised value at the query's largest coordinates lies in the range that the threshold allows), whichever leaves
less work. The products of what is left are verified in double precision. The k best of a query's tiles are merged.

Products are rounded to nine places; equal ones are ordered by vec_id. Null vectors, null ids, vectors with a null, NaN or infinity, and empty
ones are neither queries nor probes. Vectors of different sizes don't meet. Rows that repeat a vec_id and its vector count once; of those that
repeat it with another vector the best product of each pair of ids counts, and no id is its own neighbour. A vec_id has to be an integer. Queries of
fewer than k others have fewer rows. Other columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import written

K = 10
#: Queries are the rows whose vec_id this divides.
EVERY = 20
#: Probes in a tile and queries in a block: a task holds one of each.
TILE, BLOCK = 16_384, 16_384
#: Up to so many rows of tiles are broadcast; beyond, Spark chooses how to join them.
SMALL = 100_000
BUCKET, SHRINK = 1024, 0.9
#: Coordinates that coordinate pruning looks at.
FOCUS = 3
#: Coordinate pruning pays if it leaves at most this share of what length pruning leaves (it gathers, length pruning slices).
PAYS = 0.05
_SLACK = 1e-7


class Bucket:
    """Probes of like length, longest first, with a sorted list for each coordinate of the normalised probes."""

    def __init__(self, rows: np.ndarray, norms: np.ndarray) -> None:
        self.rows, self.norms = rows, norms
        unit = rows / np.maximum(norms, 1e-300)[:, None]
        self.order = np.argsort(unit, axis=0, kind="stable")
        self.lists = np.take_along_axis(unit, self.order, axis=0)
        self.unit = unit


def buckets(rows: np.ndarray, norms: np.ndarray) -> list[tuple[int, Bucket]]:
    """Buckets of rows sorted by falling length, each with its first row's number."""
    cut, first = [0], 0
    while first < len(rows):
        end = int(np.searchsorted(-norms, -norms[first] * SHRINK, "right")) if norms[first] > 0 else len(rows)
        first = min(max(end, first + 1), first + BUCKET)
        cut.append(first)
    return [(a, Bucket(rows[a:b], norms[a:b])) for a, b in pairwise(cut)]


def _candidates(b: Bucket, q: np.ndarray, qnorm: np.ndarray, theta: np.ndarray, most: float) -> list[np.ndarray] | None:
    """For each query the probes that coordinate pruning leaves, or None where they are more than ``most`` on average."""
    t = theta / np.maximum(qnorm * b.norms[0], 1e-300)
    t = np.clip(t - _SLACK, -1, 1)
    unit = q / np.maximum(qnorm, 1e-300)[:, None]
    focus = np.argsort(-np.abs(unit), axis=1)[:, :FOCUS]
    spans = []
    for f in range(min(FOCUS, q.shape[1])):
        c = focus[:, f]
        v = unit[np.arange(len(q)), c]
        wide = np.sqrt(np.maximum(0, 1 - v**2) * np.maximum(0, 1 - t**2))
        free = t <= 0  # a threshold that is no restriction
        low, high = np.where(free, -2.0, v * t - wide), np.where(free, 2.0, v * t + wide)
        high = np.where((v >= t) & ~free, 2.0, high)  # the query's own direction is within the cap
        low = np.where((-v >= t) & ~free, -2.0, low)
        spans.append((c, low - _SLACK, high + _SLACK))
    a = np.empty((len(spans), len(q)), np.int64)
    z = np.empty_like(a)
    for f, (c, low, high) in enumerate(spans):
        for k in np.unique(c):
            own = c == k
            a[f, own] = np.searchsorted(b.lists[:, k], low[own], "left")
            z[f, own] = np.searchsorted(b.lists[:, k], high[own], "right")
    best = (z - a).argmin(0)
    size = (z - a)[best, np.arange(len(q))]
    if size.sum() > most * len(q):
        return None
    out = []
    for i in range(len(q)):
        c = spans[best[i]][0][i]
        own = b.order[a[best[i], i] : z[best[i], i], c]
        for cc, low, high in spans:
            v = b.unit[own, cc[i]]
            own = own[(v >= low[i]) & (v <= high[i])]
        out.append(own)
    return out


def _exact(q: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Products in a fixed order of addition, so that equal rows have equal products."""
    return np.round((rows * q).sum(axis=1), 9)


def search(
    qid: np.ndarray,
    q: np.ndarray,
    pid: np.ndarray,
    p: np.ndarray,
    k: int = K,
    batch: int = 256,
    known: tuple[np.ndarray, np.ndarray] | None = None,
    tally: dict[str, int] | None = None,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query number, probe's id, product) of all probes of other id that may be among the k best of each query.

    ``known`` has for each query the ids and products (-inf where there is none) of k probes found elsewhere; only what reaches the k-th best of
    them and of this tile is given. An id raises a query's threshold once, however many probes have it. ``tally`` counts pairs and products.
    """
    norms = np.sqrt((p * p).sum(1))
    order = np.lexsort((pid, -norms))
    pid, p, norms = pid[order], p[order], norms[order]
    first_of = np.zeros(len(pid), bool)
    first_of[np.unique(pid, return_index=True)[1]] = True
    parts = buckets(p, norms)
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for lo in range(0, len(q), batch):
        qb, ids = q[lo : lo + batch], qid[lo : lo + batch]
        qnorm = np.sqrt((qb * qb).sum(1))
        top = np.full((len(qb), k), -np.inf) if known is None else known[1][lo : lo + batch].copy()  # lower bounds of the k best, per query
        told = None if known is None else np.where(np.isfinite(top), known[0][lo : lo + batch], ids[:, None])
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for first, b in parts:
            theta = top.min(1)
            with np.errstate(invalid="ignore"):
                live = np.flatnonzero(qnorm * b.norms[0] >= theta - _SLACK * (1 + np.abs(theta)))
            if not len(live):
                if (theta >= 0).all():
                    break
                continue
            with np.errstate(divide="ignore", invalid="ignore"):
                least = np.where(theta[live] > 0, theta[live] / np.maximum(qnorm[live], 1e-300), -1)
            reach = int(np.searchsorted(-b.norms, -(least.min() - _SLACK * (1 + abs(least.min()))), "right"))
            few = _candidates(b, qb[live], qnorm[live], theta[live], PAYS * reach) if (theta[live] > 0).all() and np.isfinite(theta[live]).all() else None
            if few is not None:
                rows = np.concatenate(few)
                who = np.repeat(live, [len(x) for x in few])
                product = np.einsum("ij,ij->i", qb[who], b.rows[rows]) if len(rows) else np.zeros(0)
                made = len(rows)
            else:
                full = qb[live] @ b.rows[:reach].T
                who, rows = np.nonzero(full >= (theta[live] - _SLACK * (1 + np.where(np.isfinite(theta[live]), np.abs(theta[live]), 0)))[:, None])
                product, who = full[who, rows], live[who]
                made = full.size
            if tally is not None:
                for name, n in (("pairs", len(qb) * len(b.rows)), ("products", made), ("by_coordinate", made * (few is not None)), ("buckets", 1), ("buckets_by_coordinate", int(few is not None))):
                    tally[name] = tally.get(name, 0) + n
            own = pid[first + rows] != ids[who]
            who, rows, product = who[own], rows[own], product[own]
            found.append((who, first + rows))
            lift = first_of[first + rows]
            if told is not None and len(who):
                lift &= ~(told[who] == pid[first + rows][:, None]).any(1)
            who, product = who[lift], product[lift]
            if len(who):
                rank = np.lexsort((-product, who))
                who, product = who[rank], product[rank]
                place = np.arange(len(who)) - np.searchsorted(who, who, "left")
                head = place < k
                new = np.full_like(top, -np.inf)
                new[who[head], place[head]] = product[head]
                both = np.concatenate([top, new], 1)
                top = -np.partition(-both, k - 1, axis=1)[:, :k]
        if found:
            who, rows = (np.concatenate(x) for x in zip(*found, strict=True))
            theta = top.min(1)
            order = np.argsort(who, kind="stable")
            who, rows = who[order], rows[order]
            for i, a, z in zip(range(len(qb)), np.searchsorted(who, np.arange(len(qb))), np.searchsorted(who, np.arange(len(qb)), "right"), strict=True):
                own = rows[a:z]
                product = _exact(qb[i], p[own])
                good = product >= theta[i] - _SLACK * (1 + (abs(theta[i]) if np.isfinite(theta[i]) else 0))
                out.append((np.full(int(good.sum()), lo + i), pid[own[good]], product[good]))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _best(who: np.ndarray, ids: np.ndarray, product: np.ndarray, k: int) -> np.ndarray:
    """Row numbers of each query's first k by (product down, id), an id once."""
    order = np.lexsort((ids, -product, who))
    w, i = who[order], ids[order]
    new = np.ones(len(w), bool)
    seen = np.lexsort((np.arange(len(w)), i, w))  # an id that comes again is dropped
    new[seen[1:]] = (w[seen[1:]] != w[seen[:-1]]) | (i[seen[1:]] != i[seen[:-1]])
    order, w = order[new], w[new]
    return order[np.arange(len(w)) - np.searchsorted(w, w, "left") < k]


def _matrix(table: pa.Table, name: str) -> np.ndarray:
    values = table.column(name).combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(table.num_rows, -1)


def _seed(k: int):
    """Queries of a block with the tile of their longest probes: each query's row with the ids and products of its k best there."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        n = left.num_rows
        ids, scores, cut = np.zeros(0, np.int64), np.zeros(0), np.zeros(n + 1, np.int32)
        if n and right.num_rows:
            qid = left.column("vec_id").to_numpy()
            who, near, product = search(qid, _matrix(left, "v"), right.column("probe_id").to_numpy(), _matrix(right, "probe"), k)
            own = _best(who, near, product, k)
            ids, scores = near[own], product[own]
            cut = np.searchsorted(who[own], np.arange(n + 1)).astype(np.int32)
        lists = [pa.ListArray.from_arrays(pa.array(cut), pa.array(x)) for x in (ids, scores)]
        names = ["d", "block", "first", "vec_id", "n", "v"]
        return pa.table([left.column(c).combine_chunks() for c in names] + lists, names=[*names, "ids", "scores"])

    return run


def _join(k: int):
    """Queries of a block with their floors, and a tile that can reach them: (query_id, vec_id, score)."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
        n = left.num_rows
        if not n or not right.num_rows:
            return schema.empty_table()
        qid = left.column("vec_id").to_numpy()
        ids, scores = np.zeros((n, k), np.int64), np.full((n, k), -np.inf)
        lists = left.column("ids").combine_chunks()
        size = np.diff(lists.offsets.to_numpy())
        at = np.repeat(np.arange(n), size), np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        ids[at], scores[at] = lists.flatten().to_numpy(), left.column("scores").combine_chunks().flatten().to_numpy()
        who, near, product = search(qid, _matrix(left, "v"), right.column("probe_id").to_numpy(), _matrix(right, "probe"), k, known=(ids, scores))
        own = _best(who, near, product, k)
        return pa.table([qid[who[own]], near[own], product[own]], schema=schema)

    return run


def top_k(vectors: DataFrame, k: int = K, tile: int = TILE, every: int = EVERY, block: int = BLOCK) -> DataFrame:
    """query_id, rank (from 1), vec_id, score for the queries, the rows whose vec_id is divisible by ``every`` (1: all rows)."""
    good = "vec_id is not null and v is not null and size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('Infinity'))"
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("v")).where(good).distinct()
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    v = v.select("vec_id", "v", F.size("v").alias("d"), norm.alias("n"))
    spark = vectors.sparkSession
    rows = vectors.count()
    # no tile beyond what a task holds, and as many as cores where there are enough rows
    tiles = max(-(-rows // tile), min(spark.sparkContext.defaultParallelism, -(-rows // 1024)), 1)
    v = written(v.repartitionByRange(tiles, "d", F.desc("n"), "vec_id", F.xxhash64("v")).withColumn("tile", F.spark_partition_id()), "vectors")
    query = F.pmod("vec_id", F.lit(every)) == 0
    # one row for each tile and size of vector: n / tile rows and one for each size
    told = sorted(v.groupBy("d", "tile").agg(F.max("n"), F.sum(F.when(query, 1).otherwise(0))).collect())
    blocks = max(1, -(-sum(r[3] for r in told) // block))
    first = {r[0]: r[1] for r in reversed(told)}
    reach = spark.createDataFrame([(r[0], r[1], r[2], r[1] == first[r[0]]) for r in told], "d int, tile int, most double, first boolean")
    reach = F.broadcast(reach) if len(told) <= SMALL else reach
    own = v.where(query).withColumn("block", F.pmod(F.xxhash64("vec_id", "v"), F.lit(blocks)).cast("int"))
    own = own.drop("tile").join(reach.where("first").select("d", F.col("tile").alias("first")), "d")
    every_block = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    probes = v.select(F.col("d").alias("d2"), F.col("tile").alias("tile2"), F.col("vec_id").alias("probe_id"), F.col("v").alias("probe"))
    ahead = probes.join(reach.where("first").select(F.col("d").alias("d2"), F.col("tile").alias("tile2")), ["d2", "tile2"], "left_semi").withColumn("block2", every_block)
    kind = v.schema["v"].dataType.simpleString()
    seeds = own.groupBy("d", "first", "block").cogroup(ahead.groupBy("d2", "tile2", "block2")).applyInArrow(_seed(k), f"d int, block int, first int, vec_id long, n double, v {kind}, ids array<bigint>, scores array<double>")
    seeds = written(seeds, "seeds")
    floor = F.when(F.size("scores") >= k, F.array_min("scores")).otherwise(F.lit(float("-inf")))
    met = seeds.join(reach.where("not first").select("d", "tile", "most"), "d").where(F.col("n") * F.col("most") >= floor - _SLACK * (1 + F.abs(floor)))
    rest = probes.withColumn("block2", every_block)
    met = met.groupBy("d", "tile", "block").cogroup(rest.groupBy("d2", "tile2", "block2")).applyInArrow(_join(k), "query_id long, vec_id long, score double")
    early = seeds.select(F.col("vec_id").alias("query_id"), F.inline(F.arrays_zip(F.col("ids").alias("vec_id"), F.col("scores").alias("score"))))
    best = early.unionByName(met).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("long").alias("rank"), "vec_id", "score")


def op1_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return out.withColumn("score", F.round("score", 6))


OP1_SQL = f"""WITH p AS (SELECT a.vec_id AS query_id, b.vec_id, list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS score FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % {EVERY} = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, vec_id) AS rank FROM p)
SELECT query_id, rank, vec_id, round(round(score, 9), 6) AS score FROM r WHERE rank <= {K}"""
