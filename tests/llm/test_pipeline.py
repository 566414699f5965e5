import random
from pathlib import Path

import corpus_pipeline as C
from vellumflow.llm import mixing as M
from vellumflow.llm import packing as P

from .data import DOCS, none, odd_docs
from .test_neardup import brute
from .test_packing import brute as pack
from .test_toxicity import words


def tables(spark, folder, seed=8):
    rng = random.Random(seed)
    docs, labels, toxic, secret = [], [], set(), set()
    for _ in range(400):
        w = words(rng, rng.randint(30, 120)).split()
        i = len(docs)
        if rng.random() < 0.2:
            toxic.add(i)
            for k in rng.sample(range(len(w)), 4):
                w[k] = rng.choice(["idiot", "scum", "moron", "clown", "trash"])
        elif rng.random() < 0.1:
            secret.add(i)
            w.insert(5, "password=" + "a1b2c3d4")
        docs.append((i, " ".join(w), rng.choice(["en", "de"]), rng.choice("abc"), 1))
        if rng.random() < 0.15 and i not in toxic:
            docs.append((i + 1, " ".join([*w[:-1], "changed"]), *docs[-1][2:]))
    for i, *_ in docs:
        labels.append((i, 1, int(i in toxic)))
    spark.createDataFrame(docs, DOCS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return docs, toxic, secret


def test_stages_against_brute_force(spark, tmp_path):
    docs, toxic, secret = tables(spark, str(tmp_path))
    now, at = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in C.STAGES:
        out = stage(spark, now, str(tmp_path))
        if name != "packing":
            assert out.columns == now.columns
        now = C.written(out, "test")
        at[name] = now.collect()
    kept = {r.doc_id: r.text for r in at["toxicity"]}
    assert not set(kept) & toxic and len(kept) >= 0.99 * (len(docs) - len(toxic))
    group, _ = brute(sorted(kept.items()), 0.5)
    assert {r.doc_id for r in at["near_duplicates"]} == set(group.values())
    clean = {r.doc_id: r.text for r in at["secrets"]}
    assert set(clean) == set(group.values()) and all(("[password]" in t) == (i in secret or i - 1 in secret and docs[i][1].endswith("changed")) for i, t in clean.items()) and not any("a1b2c3d4" in t for t in clean.values())
    sample = {r.doc_id: len(r.text.split()) for r in at["mixing"]}
    assert set(sample) < set(clean) and len(sample) > 0.2 * len(clean)
    assert sorted((r.length, r.window_id, r.offset) for r in at["packing"]) == sorted(pack(list(sample.values()), P.CAPACITY))
    assert sorted(map(tuple, C.run(spark, str(tmp_path)).collect())) == sorted(map(tuple, at["packing"]))


def test_registered():
    import __spark_entry__ as e

    assert e.queries()["pipeline"] is C.run and "pipeline" not in e.oracle_sql() and len(C.STAGES) == 5
    assert M.TEMPERATURES.keys() == set(M.DIMENSIONS)


def test_odd_rows_and_empty(spark, tmp_path):
    """Labels, nulls in every column, repeated rows, long texts and columns with clashing names, from end to end."""
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (None, 1, 1), (7, None, None), (99, 0, 1), (20, 0, 1), (21, 0, 1)], "doc_id long, quality int, toxic int")
    bad = "you idiot moron scum trash " * 10
    odd = odd_docs(spark)
    rows = spark.createDataFrame([(20, bad, "en", "a", 1), (21, bad + "x", "en", "a", 1)], DOCS)
    odd = odd.unionByName(rows, allowMissingColumns=True)
    odd.write.parquet(f"{tmp_path}/odd/documents.parquet")
    labels.write.parquet(f"{tmp_path}/odd/labels.parquet")
    now = spark.read.parquet(f"{tmp_path}/odd/documents.parquet")
    ids = lambda df: sorted((r.doc_id for r in df.select("doc_id").collect()), key=str)
    want = [1, 1, 1, 2, 3, 4, 5, 6, 7, 8, 9, None, None]
    for name, stage in C.STAGES[:3]:
        now = C.written(stage(spark, now, f"{tmp_path}/odd"), "test")
        if name == "near_duplicates":
            want = [1, 2, 4, 5, 6, 7, 8, 9, None, None]  # 3 is empty as 2 is
        assert ids(now) == want and now.columns == odd.columns
    assert set(ids(C.run(spark, f"{tmp_path}/odd"))) <= {1, 5, 6, 7, 8, 9, None}
    none(spark).write.parquet(f"{tmp_path}/none/documents.parquet")
    labels.limit(0).write.parquet(f"{tmp_path}/none/labels.parquet")
    assert C.run(spark, f"{tmp_path}/none").count() == 0


def test_without_labels_only_insults_go(spark, tmp_path):
    docs, toxic, _ = tables(spark, str(tmp_path))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.mode("overwrite").parquet(f"{tmp_path}/labels.parquet")
    kept = {r.doc_id for r in C.toxicity(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path)).collect()}
    assert kept == {d[0] for d in docs} - toxic


def test_run_leaves_only_its_result(spark, tmp_path):
    from vellumflow.llm.shared import scratch

    tables(spark, str(tmp_path))
    with scratch(spark) as own:
        out = C.run(spark, str(tmp_path))
    left = [p for p in own if Path(p.removeprefix("file://")).exists()]
    assert len(own) > 8 and len(left) == 1 and "stage-packing" in left[0] and out.count()
