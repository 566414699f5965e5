import numpy as np
import pytest
from pyspark.sql import functions as F

from vellumflow.llm import topk as K

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(ids, x, k):
    out = set()
    for i, q in zip(ids, x, strict=True):
        s = np.round((x * q).sum(1), 9)
        order = [j for j in np.lexsort((ids, -s)) if ids[j] != i]
        out |= {(int(i), r + 1, int(ids[j]), float(s[j])) for r, j in enumerate(order[:k])}
    return out


def vectors(n, d, kind, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d))
    if kind == "skewed":
        x *= rng.lognormal(0, 1.5, (n, 1))
    elif kind == "sparse":
        x *= rng.random((n, d)) < 0.1
    elif kind == "clustered":
        x = rng.normal(size=(8, d))[rng.integers(0, 8, n)] + 0.05 * x
    elif kind == "ties":
        x = rng.integers(-1, 2, (n, d)).astype(float)
    elif kind == "negative":
        x = np.abs(x)
        x[0] = -x[0]
    return x.astype(np.float32).astype(float)


@pytest.mark.parametrize("kind", ["plain", "skewed", "sparse", "clustered", "ties", "negative"])
def test_search_is_exact(kind):
    x = vectors(700, 12, kind)
    ids = np.arange(700)
    who, near, score = K.search(ids, x, ids, x, 10)
    own = K._best(who, near, score, 10)
    got = {(int(w), r, int(j), float(s)) for w, r, j, s in zip(who[own], np.arange(len(own)) - np.searchsorted(who[own], who[own], "left") + 1, near[own], score[own], strict=True)}
    assert got == brute(ids, x, 10)


def test_coordinate_pruning_keeps_all_answers():
    rng = np.random.default_rng(1)
    base = rng.normal(size=(2000, 6))
    x = base / np.linalg.norm(base, axis=1)[:, None]
    bucket = K.Bucket(x, np.ones(len(x)))
    theta = np.full(50, 0.95)
    found = K._candidates(bucket, x[:50], np.ones(50), theta, len(x))
    assert found is not None and sum(map(len, found)) < 0.2 * 50 * len(x)
    for i, own in enumerate(found):
        assert set(np.flatnonzero(x @ x[i] >= 0.95)) <= set(own.tolist())


@pytest.mark.parametrize(("tile", "block", "every", "kind"), [(64, 16_384, 1, "skewed"), (16_384, 16_384, 20, "skewed"), (50, 7, 3, "skewed"), (40, 10, 2, "ties"), (40, 10, 2, "clustered"), (40, 50, 1, "negative")])
def test_table(spark, tile, block, every, kind):
    x = vectors(300, 5, kind, 2)
    df = spark.createDataFrame([(i, [float(v) for v in row], 0) for i, row in enumerate(x)], SCHEMA)
    got = {tuple(r) for r in K.top_k(df, 7, tile, every, block).collect()}
    assert got == {r for r in brute(np.arange(300), x, 7) if r[0] % every == 0}


def test_repeated_ids_do_not_raise_thresholds(spark):
    """An id with many good vectors is one neighbour; the others must not be pruned for it."""
    rng = np.random.default_rng(5)
    rows = [(0, [1.0, 0.0, 0.0], 0)] + [(1, [5.0 - k / 50, 0.1 * k, 0.0], 0) for k in range(80)] + [(i, [float(v) for v in rng.normal(size=3)], 0) for i in range(2, 120)]
    best = {}
    for i, v, _ in rows[1:]:
        best[i] = max(best.get(i, -9), round(v[0], 9))
    want = sorted(((-s, i) for i, s in best.items()))[:5]
    for tile in (20, 16_384):
        got = sorted((r.rank, r.vec_id, r.score) for r in K.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), 5, tile).collect() if r.query_id == 0)
        assert got == [(k + 1, i, -s) for k, (s, i) in enumerate(want)]


def test_short_tiles_are_passed_over():
    """With lengths that differ, most pairs are settled without a product; the answers stay exact."""
    x = vectors(4000, 16, "skewed", 4)
    ids, tally = np.arange(len(x)), {}
    own = ids[ids % 20 == 0]
    head = np.argsort(-np.sqrt((x * x).sum(1)), kind="stable")[:1000]
    who, near, score = K.search(own, x[own], ids[head], x[head], 10)
    seed = K._best(who, near, score, 10)
    tail = np.setdiff1d(ids, head)
    who2, near2, score2 = K.search(own, x[own], ids[tail], x[tail], 10, known=(near[seed].reshape(-1, 10), score[seed].reshape(-1, 10)), tally=tally)
    assert tally.get("products", 0) < 0.2 * len(own) * len(tail)
    who, near, score = (np.concatenate(z) for z in ((who[seed], who2), (near[seed], near2), (score[seed], score2)))
    best = K._best(who, near, score, 10)
    got = {(int(own[w]), int(j), float(s)) for w, j, s in zip(who[best], near[best], score[best], strict=True)}
    assert got == {(q, j, s) for q, _, j, s in brute(ids, x, 10) if q % 20 == 0}


def test_odd_rows_and_empty(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 0), (1, [1.0, 0.0], 0), (2, [1.0, 0.0], None), (3, [0.0, 1.0], 1), (4, None, 1), (None, [1.0, 1.0], 1), (5, [nan, 1.0], 1), (6, [inf, 1.0], 1), (7, [None, 1.0], 1), (8, [], 1), (9, [1.0], 1), (3, [1.0, 1.0], 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    for name in ("v", "d", "g", "mine", "query_id", "rank", "score"):
        df = df.withColumn(name, F.lit("x"))
    got = sorted(tuple(r) for r in K.top_k(df, 2, every=1).collect())
    assert got == [(1, 1, 2, 1.0), (1, 2, 3, 1.0), (2, 1, 1, 1.0), (2, 2, 3, 1.0), (3, 1, 1, 1.0), (3, 2, 2, 1.0)]
    assert K.top_k(spark.createDataFrame([], SCHEMA)).count() == 0
