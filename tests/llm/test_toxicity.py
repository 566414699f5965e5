import random

from pyspark.sql import functions as F

from vellumflow.llm import toxicity as T

from .data import DOCS, none, odd_docs
from .data import words as any_words

LABELS = "doc_id long, quality int, toxic int"


def words(rng, n):
    """Invented words, none of which is by chance an insult."""
    known = set(" ".join(T.INSULTS).split())
    return " ".join(w if w not in known else "kappa" for w in any_words(rng, n).split())


def made(spark, n=1200, seed=9):
    """Two languages; English insults in one, made-up stems, known only from labels, in the other."""
    rng = random.Random(seed)
    docs, labels, truth = [], [], {}
    for i in range(n):
        lang, toxic = rng.choice(["en", "xx"]), rng.random() < 0.2
        w = words(rng, rng.randint(40, 150)).split()
        if toxic:
            for _ in range(rng.randint(2, 6)):
                w[rng.randrange(len(w))] = rng.choice(["idiot", "scum", "moron", "clown"]) if lang == "en" else rng.choice(["vrolka", "grumbe"]) + rng.choice(["ti", "mo", "sa", "ne"])
        docs.append((i, " ".join(w), lang, "s", 0))
        truth[i] = toxic
        if rng.random() < 0.5:
            labels.append((i, 1, int(toxic)))
    return spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS), truth


def test_held_out(spark):
    docs, labels, truth = made(spark)
    known = {r.doc_id for r in labels.collect()}
    got = {r.doc_id: r.toxic for r in T.toxicity(docs, labels).collect() if r.doc_id not in known}
    hit = sum(got[i] for i in got if truth[i]) / sum(truth[i] for i in got)
    false = sum(got[i] for i in got if not truth[i]) / sum(not truth[i] for i in got)
    assert hit >= 0.95 and false <= 0.01


def test_filter_keeps_columns_and_clean_rows(spark):
    docs, labels, truth = made(spark, 600)
    kept = T.without_toxic(docs.withColumn("p_toxic", F.lit("x")), labels)
    assert kept.columns == [*docs.columns, "p_toxic"]
    ids = {r.doc_id for r in kept.collect()}
    assert sum(not truth[i] for i in ids) >= 0.99 * sum(not t for t in truth.values())


def test_odd_rows_and_labels(spark):
    docs = odd_docs(spark)
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 1), (None, 1, 1), (7, None, None), (99, 0, 1)], LABELS)
    rows = T.toxicity(docs, labels).collect()
    assert len(rows) == docs.count() and not any(r.toxic for r in rows if r.doc_id in (2, 3, 4, None))
    assert T.without_toxic(docs, labels).columns == docs.columns


def test_no_labels_and_empty(spark):
    labels = spark.createDataFrame([], LABELS)
    rng = random.Random(1)
    rows = [(i, words(rng, 60) + (" you idiot moron scum trash " if i % 5 == 0 else ""), "en", "s", 1) for i in range(100)]
    rows += [(100, None, "en", "s", 1), (101, "", "en", "s", 1), (102, " ... ", "en", "s", 1)]
    got = {r.doc_id: (r.toxic, r.p_toxic) for r in T.toxicity(spark.createDataFrame(rows, DOCS), labels).collect()}
    assert len(got) == 103 and all(got[i] == (False, 0.0) for i in (100, 101, 102))
    assert all(got[i][0] == (i % 5 == 0) for i in range(100))
    assert T.toxicity(none(spark), labels).count() == 0


def test_rare_and_absent_toxicity_without_labels(spark):
    """One document in 400 is found; where there is none, none is made up."""
    labels = spark.createDataFrame([], LABELS)
    rng = random.Random(4)
    rows = [(i, words(rng, 60) + (" you idiot moron scum trash" if i % 400 == 7 else ""), "en", "s", 1) for i in range(2000)]
    toxic = {r.doc_id for r in T.toxicity(spark.createDataFrame(rows, DOCS), labels).collect() if r.toxic}
    assert toxic == set(range(7, 2000, 400))
    clean = [(i, words(rng, 60) + rng.choice(["", " so *** loud !!! and *** again !!!"]), "en", "s", 1) for i in range(500)]
    assert not any(r.toxic for r in T.toxicity(spark.createDataFrame(clean, DOCS), labels).collect())


def test_a_wrong_label_does_not_decide(spark):
    """Labels only anchor the voters: clean texts labelled toxic stay clean, and the other way round."""
    docs, labels, truth = made(spark)
    rows = labels.collect()
    wrong = {r.doc_id for r in rows[:20]}
    labels = spark.createDataFrame([(r.doc_id, 1, r.toxic ^ (r.doc_id in wrong)) for r in rows], LABELS)
    got = {r.doc_id: r.toxic for r in T.toxicity(docs, labels).collect()}
    assert sum(got[i] == truth[i] for i in wrong) >= 18


def test_one_document_without_end_does_not_fill_the_sample(spark):
    docs, labels, _ = made(spark, 60)
    many = docs.union(docs.where("doc_id = 3").crossJoin(spark.range(500)).select(docs.columns))
    sample = T.labelled(many, spark.createDataFrame([(3, 1, 0), (4, 1, 1)], LABELS)).collect()
    assert len(sample) == 2
    assert T.toxicity(many, labels).count() == 560


def test_label_model_finds_accuracies_of_correlated_voters():
    import numpy as np

    rng = np.random.default_rng(0)
    y = rng.random(20_000) < 0.2
    v = np.zeros((len(y), T._NVOTERS), np.int8)
    v[:, 0] = np.where(rng.random(len(y)) < np.where(y, 0.8, 0.005), 1, 0)
    v[:, 1] = v[:, 0]  # an exact copy must not count twice
    v[:, 2] = np.where(rng.random(len(y)) < np.where(y, 0.7, 0.005), 1, 0)
    v[:, 3] = np.where(rng.random(len(y)) < 0.3, 1, 0)  # a voter that knows nothing
    codes, at, n = np.unique(T._code(v), return_inverse=True, return_counts=True)
    known = np.stack([np.bincount(at[:1000], ~y[:1000], len(codes)), np.bincount(at[:1000], y[:1000], len(codes))], 1)
    model = T.fit_label_model(codes, n, known)
    assert abs(model.prior - 0.2) < 0.03
    q = model.posterior(T._code(v))
    only_noise = (v[:, 3] == 1) & (v[:, :3].sum(1) == 0)
    assert q[only_noise].max() < 0.3 and q[(v[:, 0] == 1) & (v[:, 2] == 1)].min() > 0.9
