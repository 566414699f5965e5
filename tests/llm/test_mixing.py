import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from vellumflow.llm import mixing as M

from .data import DOCS, none, odd_docs, words


def corpus(spark, n=3000):
    rng = random.Random(2)
    rows = []
    for i in range(n):
        text = words(rng, rng.randint(5, 60)) + rng.choice(["", "", " Licensed work", " the server, a token", " copyright; Tokens of http"])
        rows.append((i, text, rng.choices(["en", "de", None], [6, 3, 1])[0], rng.choices(["big", "mid", "small"], [8, 3, 1])[0], len(text)))
    return spark.createDataFrame(rows, DOCS)


def test_equals_sql(spark):
    docs = corpus(spark)
    got = sorted(map(tuple, M.mixture(docs).collect()), key=str)
    documents = docs.toPandas()  # noqa: F841
    want = sorted(duckdb.sql(M.OP10_SQL).fetchall(), key=str)
    assert [g[:5] for g in got] == [tuple(w[:5]) for w in want] and np.allclose([g[5] for g in got], [w[5] for w in want])


def test_marginals_reach_their_targets(spark):
    docs = corpus(spark)
    p = {(r.source, r.lang, r.topic): r.p for r in M.probabilities(docs).collect()}
    assert max(p.values()) == pytest.approx(1)
    cells = {}
    for r in M._described(docs, None).collect():
        key = (r.source, r.lang, r.topic)
        cells[key] = cells.get(key, 0) + r.n_tokens
    total = sum(p[k] * t for k, t in cells.items())
    for d, dim in enumerate(M.DIMENSIONS):
        have, goal = {}, {}
        for k, t in cells.items():
            have[k[d]] = have.get(k[d], 0) + p[k] * t / total
            goal[k[d]] = goal.get(k[d], 0) + t
        scale = sum(g ** M.TEMPERATURES[dim] for g in goal.values())
        assert all(have[v] == pytest.approx(goal[v] ** M.TEMPERATURES[dim] / scale, abs=1e-4) for v in goal)


def test_topics(spark):
    texts = ["The licensee's PASSWORD and token", "Licensed under copyright", "nothing", None, "", "unlicensed apatient", "Ünpatient clinics, hospital", "price\tprices"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, text string")
    assert [r[0] for r in docs.orderBy("i").select(M.topic(F.col("text"))).collect()] == ["computing", "legal", "general", "general", "general", "general", "health", "commerce"]


def test_given_targets_and_topics(spark):
    docs = corpus(spark).withColumn("kind", F.when(F.col("doc_id") % 3 == 0, "x").otherwise("y"))
    targets = {"source": {"big": 1, "small": 1}, "topic": {"x": 3, "y": 1}}
    p = {(r.source, r.lang, r.topic): r.p for r in M.probabilities(docs, targets, "kind").collect()}
    own = {}
    for r in M._described(docs, "kind").collect():
        own[r.source, r.lang, r.topic] = own.get((r.source, r.lang, r.topic), 0) + r.n_tokens
    total = sum(p[k] * t for k, t in own.items())
    share = lambda d, v: sum(p[k] * t for k, t in own.items() if k[d] == v) / total
    assert share(0, "big") == pytest.approx(0.5) and share(0, "mid") == 0 and share(2, "x") == pytest.approx(0.75)
    kept = M.mixed(docs, targets, F.col("kind"))
    assert kept.columns == docs.columns and {r.source for r in kept.collect()} == {"big", "small"}
    with pytest.raises(ValueError, match="no tokens"):
        M.probabilities(docs, {"source": {"nowhere": 1}})


def test_targets_that_contradict_are_an_error():
    cells = [("a", "en", "x", 5), ("b", "de", "x", 5)]
    with pytest.raises(ValueError, match="cannot be reached"):
        M.rake(cells, {"source": {"a": 3, "b": 1}, "lang": {"en": 1, "de": 3}})
    assert M.rake(cells, {"source": {"a": 3, "b": 1}, "lang": {"en": 3, "de": 1}}).tolist() == [1.0, pytest.approx(1 / 3)]


def test_a_heavy_cell_is_noticed_and_cells_are_bounded(spark):
    docs = spark.createDataFrame([(i, "w " * 50, "en", "a", 1) for i in range(200)] + [(999, "w", "en", "b", 1)], DOCS)
    with pytest.warns(UserWarning, match="weighs most"):
        M.probabilities(docs, {"source": {"a": 1, "b": 1}})
    with pytest.raises(ValueError, match="combinations"):
        M.probabilities(docs, cells=1)


def test_rows_are_not_shuffled(spark):
    docs = corpus(spark, 300)
    plan = M.mixed(docs)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_odd_rows_and_empty(spark):
    docs = odd_docs(spark)
    got = M.mixed(docs)
    assert got.columns == docs.columns
    assert not {2, 3, 4} & {r.doc_id for r in got.collect()}
    M.mixture(docs).collect()
    assert M.mixed(none(spark)).count() == 0 and M.mixture(none(spark)).count() == 0
