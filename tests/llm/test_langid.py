import random

import pytest

from vellumflow.llm import langid as L

from .data import DOCS, none, odd_docs

SYLLABLES = {"aa": "the and ing ion ent her for tha nth int", "bb": "der die und sch ein ich nde gen ung che", "cc": "que les ent ion des our eau aux ais eur"}


def made(n, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang = rng.choice(list(SYLLABLES))
        text = " ".join("".join(rng.choice(SYLLABLES[lang].split()) for _ in range(rng.randint(1, 3))) for _ in range(rng.choice([8, 40, 300])))
        rows.append((i, text, lang, "s", len(text)))
    return rows


def test_held_out(spark):
    net = L.fit(spark.createDataFrame(made(300, 1), DOCS))
    rows = made(200, 2)
    got = {r.doc_id: r.language for r in L.identified(spark.createDataFrame(rows, DOCS), net).collect()}
    assert sum(got[r[0]] == r[2] for r in rows) >= 0.97 * len(rows)


def test_windows():
    import numpy as np

    raw = bytes(range(1, 12))
    x, doc, size = L.windows(np.frombuffer(raw, np.uint8), np.array([0, 3, 3, 11]), 4)
    assert x.tolist() == [[1, 2, 3, 0], [4, 5, 6, 7], [8, 9, 10, 11]] and doc.tolist() == [0, 2, 2] and size.tolist() == [3, 4, 4]


def test_pooling_agrees_with_a_loop():
    import numpy as np

    rng = np.random.default_rng(0)
    net = L.train(np.zeros((0, L.WINDOW), np.uint8), np.zeros(0, int), ["a", "b"])
    x = rng.integers(0, 256, (5, 20), dtype=np.uint8)
    fast, slow = net.pooled(x)[0], net.pooled(x, where=True)[0]
    want = np.concatenate([np.max([sum(t[k][x[:, p + k]] for k in range(w)) for p in range(20 - w + 1)], axis=0) for w, t in zip(L.WIDTHS, net.tables, strict=True)], 1) + net.bias
    assert np.allclose(fast, want, atol=1e-5) and np.allclose(slow, want, atol=1e-5)


def test_odd_rows_and_empty(spark):
    docs = odd_docs(spark)
    rows = L.identified(docs, L.fit(docs)).collect()
    assert len(rows) == docs.count()
    assert {r.language for r in rows if r.doc_id in (2, 3)} == {"und"}
    assert L.identified(none(spark), L.fit(none(spark))).count() == 0
    unlabelled = docs.selectExpr("doc_id", "text", "string(null) as lang", "source", "n_chars")
    assert {r.language for r in L.identified(unlabelled, L.fit(unlabelled)).collect()} == {"und"}


def test_too_many_languages_are_an_error(spark):
    docs = spark.createDataFrame([(i, "word", f"l{i}", "s", 4) for i in range(6)], DOCS)
    assert len(L.fit(docs, 2, 6).languages) == 6
    with pytest.raises(ValueError, match="bound is 5"):
        L.fit(docs, 2, 5)


def test_a_document_without_end_does_not_fill_the_sample(spark):
    docs = spark.createDataFrame(made(50, 3), DOCS)
    many = docs.union(docs.where("doc_id = 3").crossJoin(spark.range(300)).select(docs.columns))
    a, b = L.fit(docs), L.fit(many)
    assert (a.dense == b.dense).all()
