"""Steps that had grown too fast in memory, disk or time: right results on odd rows, and bounds on what they hold or move."""

import math
import random
import re
import time
import tracemalloc
from collections import Counter

import pyarrow as pa
from pyspark.sql import functions as F

from vellumflow.functions import geometry as G
from vellumflow.functions import numeric as N
from vellumflow.operators import graph, lexicon, search, stats

LISTS = pa.list_(pa.struct([("x", pa.int32()), ("y", pa.int32())]))


def listed(rows):
    return pa.array([None if r is None else [{"x": x, "y": y} for x, y in r] for r in rows], LISTS)


def told(points):
    return None if points is None else [(p["x"], p["y"]) for p in points]


def raster(p):
    out = []
    for (a, b), (c, d) in zip(p, p[1:]):
        s = max(abs(c - a), abs(d - b))
        out += [(math.floor(a + (c - a) * k / s + 0.5), math.floor(b + (d - b) * k / s + 0.5)) for k in range(s)]
    return [*out, p[-1]] if p else None


def held(fn):
    """MB that a call holds at most."""
    tracemalloc.start()
    fn()
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return most / 1e6


def test_reduced_rows_are_those_of_one_row_at_a_time(monkeypatch):
    rng = random.Random(21)
    for turn in range(60):
        m = rng.choice([2, 3, 50])
        rows = [None if rng.random() < 0.1 else [(rng.randrange(-m, m), rng.randrange(-m, m)) for _ in range(rng.randrange(9))] for _ in range(rng.randrange(12))]
        monkeypatch.setattr(G, "AT_ONCE", rng.choice([1, 5, 1 << 18]))
        for rastered in (False, True):
            got = [told(p) for _, _, part in G._reduced(listed(rows), rastered) for p in part.to_pylist()]
            lines = [raster(r) if r is not None and rastered else r for r in rows]
            assert got == [None if r is None else G.reduce_collinear(r) for r in lines]
    far = [(-(2**31), -(2**31)), (2**31 - 1, -(2**31)), (2**31 - 1, 2**31 - 1), (0, 0)]
    assert [told(p) for _, _, part in G._reduced(listed([far]), False) for p in part.to_pylist()] == [far]


def test_a_batch_of_rasters_is_not_held_at_once():
    rng = random.Random(22)
    row = lambda: [(20 * k, rng.randrange(-200, 200)) for k in range(64)]
    small, large = listed([row() for _ in range(60)]), listed([row() for _ in range(600)])
    few, many = (held(lambda s=s: sum(1 for _ in G._reduced(s, True))) for s in (small, large))
    assert many < 1.5 * few + 10 and many < 100


def test_corners_of_a_batch_are_found_row_by_row(spark):
    rng = random.Random(23)
    rows = [[(20 * k, rng.randrange(-200, 200)) for k in range(64)] for _ in range(2000)]
    run, batch = G._by_row(G.hull).func, listed([*rows, None, [], [(1, 1)]])
    assert [told(p) for p in run(batch).to_pylist()] == [*map(G.hull, rows), None, [], [(1, 1)]]
    assert held(lambda: run(batch)) < 10


def test_paths_of_a_batch_are_not_held_as_objects():
    rng = random.Random(25)
    words = lambda n: [rng.choice(["één", "of", "the", "漢字"]) for _ in range(n)]
    rows = [(words(40), words(40)) for _ in range(1000)] + [(None, ["a"]), (["a"], None), ([], [])]
    a, b = (pa.array([r[k] for r in rows], pa.list_(pa.string())) for k in (0, 1))
    got = [None if p is None else [(s["op"], s["i"], s["j"], s["cost"]) for s in p] for p in graph.alignment.func(a, b).to_pylist()]
    assert got == [None if x is None or y is None else graph.edit_path(x, y) for x, y in rows]
    assert held(lambda: graph.alignment.func(a, b)) < 8 and len(graph.alignment.func(a[:0], b[:0])) == 0


def test_softmax_of_a_long_array_is_one_pass(spark):
    xs = [random.Random(24).uniform(-4, 4) for _ in range(3000)]
    began = time.monotonic()
    got = spark.createDataFrame([(xs,), ([],), (None,)], "x array<double>").coalesce(1).select(N.softmax(F.col("x")).alias("p"), N.log_sum_exp(F.col("x")).alias("l")).collect()
    assert time.monotonic() - began < 20  # a sum found again for each element takes minutes
    total = sum(math.exp(x) for x in xs)
    assert all(math.isclose(p, math.exp(x) / total, rel_tol=1e-9) for p, x in zip(got[0].p, xs, strict=True)) and math.isclose(got[0].l, math.log(total), rel_tol=1e-9)
    assert (got[1].p, got[2].p, got[2].l) == ([], None, None)


TEXTS = ["one\n\ntwo @x\n", "é漢😀\0\r\n@@", "", None, "\n", "ab" * 3000]


def texts(spark):
    return spark.createDataFrame([(t,) for t in TEXTS], "text string")


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_characters_are_counted_without_a_row_each(spark):
    got = stats.char_stat(texts(spark))
    assert {tuple(r) for r in got.collect()} == {(c, ord(c), n) for c, n in Counter("".join(t or "" for t in TEXTS)).items()}
    assert "Generate" not in plan(got)


def test_grams_are_counted_without_a_row_each(spark):
    for n in (1, 3, 4):
        got = stats.char_ngrams(texts(spark), n)
        assert {tuple(r) for r in got.collect()} == set(Counter(f"@{x}@"[i : i + n] for t in TEXTS for x in (t or "").split("\n") if x for i in range(len(x) + 3 - n)).items())
        assert "Generate" not in plan(got)


def test_grams_of_any_text():
    rng = random.Random(26)
    for turn in range(300):
        n = rng.choice([1, 2, 3, 4, 7])
        text = "".join(rng.choice("ab@\n\n é😀\0\r") for _ in range(rng.randrange(60)))
        grams, cnt = stats._line_grams(text, n)
        assert dict(zip(grams, cnt.tolist(), strict=True)) == Counter(f"@{x}@"[i : i + n] for x in text.split("\n") if x for i in range(len(x) + 3 - n))


def test_table_hits_of_common_and_rare_tokens(spark, monkeypatch):
    monkeypatch.setattr(search, "FREQUENT", 3)
    monkeypatch.setattr(search, "HASHES", 2)
    told = [(1, "the cat, the dog"), (1, "the cat, the dog"), (None, "a.b cat"), (2, "the the the"), (2, "dog a,b"), (3, "License, Version"), (3, "xLicense, Version"), (4, ""), (5, "rare été"), (6, "cat, the dog")]
    asked = ["the", "the", "cat", "rare", "été", "a.b", "License, Version", "cat, the", "none", ", ", None]
    lines = spark.createDataFrame([(d, k % 2, x) for k, (d, x) in enumerate(told)], "doc_id long, line_no int, line string")
    border = "[ ,.]"
    want = Counter((q, d, k % 2) for q in {q for q in asked if q and q != ", "} for k, (d, x) in enumerate(told) if re.search(f"(?:^|{border}){re.escape(q)}(?:$|{border})", x))
    got = search.table_hits(lines, spark.createDataFrame([(q,) for q in asked], "query string"))
    assert Counter(tuple(r) for r in got.collect()) == want
    alone = search.table_hits(lines, spark.createDataFrame([("cat",)], "query string"))
    assert Counter(tuple(r) for r in alone.collect()) == Counter({k: n for k, n in want.items() if k[0] == "cat"})


def test_terms_are_checked_once_counted(spark):
    docs = spark.createDataFrame([("abc été abc x",), (None,), ("Ünder abc",)], "text string")
    good, bad = lexicon.checked_dictionary(stats.dictionary(docs), list("abcdefghijklmnopqrstuvwxyz"))
    assert {tuple(r) for r in good.collect()} == {("abc", 3), ("x", 1)} and {tuple(r) for r in bad.collect()} == {("été", "charmap"), ("Ünder", "charmap")}
    told = plan(bad)
    assert "fixed(" in told and "fixed(" not in told[told.index("Aggregate") :]
