import itertools
import random

import numpy as np
from pyspark.sql import functions as F

from vellumflow.operators import confmats, layout, runs, search
from vellumflow.plans import jobs
from vellumflow.streaming import trainlog


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_resized(spark):
    v = spark.createDataFrame([([0.0, 4.0, 0.0],), ([5.0],)], "v array<double>")
    assert [r[0] for r in v.select(layout.resized(F.col("v"), 2, 7)).collect()] == [[0, 2, 4, 2, 0, -2, -4], [5.0] * 7]


def test_spans_around_a_keyword(spark):
    spans = spark.createDataFrame([(1, "KW", 5, 8), (1, "PRE", 3, 5), (1, "PRE", 4, 6), (1, "POST", 8, 10), (2, "KW", 0, 3), (2, "PRE", 0, 2)], "k int, kind string, start int, end int")
    assert rows(layout.around(spans, ["k"])) == [(1, 5, 8, 3, 8), (2, 0, 3, None, None)]


def brute_occurrence(mat, channels):
    """The cheapest of all labelings of all spans that read as the keyword."""
    best = float("inf")
    for a in range(len(mat)):
        for b in range(a + 1, len(mat) + 1):
            for path in itertools.product(range(len(mat[0])), repeat=b - a):
                once = [c for i, c in enumerate(path) if c and (i == 0 or path[i - 1] != c)]
                if once == channels and path[0] == channels[0] and path[-1] == channels[-1]:
                    best = min(best, sum(mat[a + i][c] for i, c in enumerate(path)))
    return best


def test_occurrence_against_all_paths():
    rng = random.Random(1)
    for _ in range(30):
        mat = np.array([[rng.random() for _ in range(3)] for _ in range(5)])
        for channels in ([1], [1, 2], [1, 1], [2, 1, 2]):
            assert abs(confmats.occurrence(mat, channels)[0] - brute_occurrence(mat, channels)) < 1e-9


def test_cascade_and_containers(spark, tmp_path):
    sure = lambda *cs: [[0.01 if k == c else 5.0 for k in range(4)] for c in cs]
    mats = spark.createDataFrame([("p", "l1", "1,1 2,1", sure(0, 1, 1, 0, 2, 3)), ("p", "l2", "3,3 4,3", sure(2, 1, 0, 0))], "page_id string, line_id string, baseline string, mat array<array<double>>")
    confmats.write_container(mats, f"{tmp_path}/c")
    mats = confmats.read_container(spark, f"{tmp_path}/c")
    chars = F.array(*map(F.lit, "-abc"))
    assert rows(mats.select("line_id", confmats.best_path(F.col("mat"), chars))) == [("l1", "abc"), ("l2", "ba")]
    found = confmats.keyword_cascade(mats, {"ab": [1, 2], "c": [3]}, 0.2)
    assert rows(found.select("line_id", "query", "reason", "start", "end")) == [("l1", "ab", "found", 0, 5), ("l1", "c", "found", 5, 6), ("l2", "ab", "occurance", None, None), ("l2", "c", "leastcost", None, None)]
    assert ("ab", "all", 2) in rows(confmats.reason_counts(found))
    lines = spark.createDataFrame([("p", "r", "l1", "1,1 2,1")], "page_id string, region_id string, line_id string, baseline string")
    assert confmats.by_baseline(lines, mats).count() == 1
    old = mats.select("page_id", F.concat(F.lit("r_"), "line_id").alias("name"), "mat")
    assert [r.line_id for r in confmats.migrated(old, lines).collect()] == ["l1"]


def test_batches_cover_an_epoch(spark):
    df = spark.range(103)
    got = runs.batches(df, "id", 5, 10).collect()
    assert len(got) == 100 and len({r.id for r in got}) == 100 and sorted({r.batch for r in got}) == list(range(10))
    assert rows(runs.batches(df, "id", 5, 10)) == rows(runs.batches(df.repartition(3), "id", 5, 10))


def test_table_of_queries_equals_the_list(spark):
    docs = spark.createDataFrame([(1, "a b.c\nLicense, Version 2\n(x) a+b"), (2, "ab a\n\nLicense,Version"), (3, None)], "doc_id long, text string")
    asked = ["a", "b", "License, Version", "a+b", "zz", "x"]
    lines = search.line_table(docs)
    table = spark.createDataFrame([(q,) for q in [*asked, "a", None]], "query string")
    assert rows(search.table_hits(lines, table)) == rows(search.keyword_hits(lines, asked))


def test_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("\n".join(f"{k} Val: CER = {v}" for k, v in enumerate((0.5, 0.4, 0.45, 0.41, 0.39))))
    stream = spark.readStream.text(f"{tmp_path}/in").select(F.lit(1).cast("long").alias("key"), F.substring_index("value", " ", 1).cast("long").alias("seq"), F.col("value").alias("line"))
    seen, copies = [], []
    told = trainlog.progress(trainlog.parsed(stream).select("key", "seq", "value"), 2)
    job = told.writeStream.foreachBatch(trainlog.fan_out(lambda b, i: seen.extend(b.collect()), lambda b, i: copies.append(b.count()))).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    job.awaitTermination(120)
    assert [(r.value, r.is_best, r.stop) for r in sorted(seen, key=lambda r: r.seq)] == [(0.5, True, False), (0.4, True, False), (0.45, False, False), (0.41, False, True), (0.39, True, False)] and copies == [5]
    lines = spark.createDataFrame([(1, k, str(k)) for k in range(50)], "key long, seq long, line string")
    assert [r[1] for r in rows(trainlog.last_lines(lines, 3))] == [47, 48, 49]


def test_jobs(spark, tmp_path):
    docs = spark.createDataFrame([(1, "one two two\nthree"), (2, "two four")], "doc_id long, text string")
    words = jobs.create_dictionary(docs, f"{tmp_path}/d")
    assert rows(words)[-1] == ("two", 3) and jobs.calc_oov(words, words.where("term <> 'two'")) == 0.5
    assert jobs.run_kws(docs, spark.createDataFrame([("two",)], "query string"), f"{tmp_path}/k").count() == 2
    asked, truth = jobs.create_queries_and_truth(docs, f"{tmp_path}/q", min_occ=2)
    assert rows(asked) == [("two", 3)] and truth.count() == 2
    pairs = spark.createDataFrame([(1, 1, "abcd", "abcd"), (1, 2, "abcd", "xxcd")], "doc int, line int, ref string, hyp string")
    whole, bad = jobs.evaluate_htr(pairs, ("doc", "line"))
    assert rows(whole) == [(1, 2, 8, 0.25)] and [r.line for r in bad.collect()] == [2]
