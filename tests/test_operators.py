import itertools
import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vellumflow.functions import geometry as G
from vellumflow.functions import numeric as N
from vellumflow.operators import evaluate as E
from vellumflow.operators import graph, lexicon, pages, runs, search, stats


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_statistics(spark):
    d = docs(spark, "ab a", "b", None, "")
    assert rows(stats.char_stat(d)) == [(" ", 32, 1), ("a", 97, 2), ("b", 98, 2)]
    words = stats.dictionary(d)
    assert rows(words) == [("a", 1), ("ab", 1), ("b", 1)] and [r.term for r in stats.top_terms(words, 2).collect()] == ["a", "ab"]
    assert stats.top_terms(words, -1).count() == 3
    lines = [r.value for r in stats.char_stat_lines(stats.char_stat(d)).collect()]
    assert lines == ["a | \\u0061 | 2", "b | \\u0062 | 2", "  | \\u0020 | 1"]


def test_unigrams_sum_to_one(spark):
    p = {r.term: 10**r.log10_p for r in stats.unigram_logprob(stats.dictionary(docs(spark, "a b b c c c"))).collect()}
    assert sum(p.values()) == pytest.approx(1, abs=1e-5) and p["<unk>"] == pytest.approx(math.exp(-5), rel=1e-5)


def test_length_prior(spark):
    words = stats.dictionary(docs(spark, "a a bbb"))
    norm = {r.len: math.exp(-r.cost) for r in stats.length_costs(words, "neglog").collect()}
    assert sum(norm.values()) == pytest.approx(1) and set(norm) == {0, 1, 2, 3} and norm[0] == norm[2] == pytest.approx(1 / 5)
    raw = {0: 0, 1: 2 / 3, 2: 0, 3: 1 / 3}
    assert {r.len: r.cost for r in stats.length_costs(words).collect()} == {k: pytest.approx(norm[k] + raw[k]) for k in raw}
    assert stats.lm_scores(words, words, words).count() == 2


def test_unknown_words(spark):
    r = stats.unknown_mass(stats.dictionary(docs(spark, "a a b c")), stats.dictionary(docs(spark, "a"))).first()
    assert (r.oov_mass, r.n_terms) == (0.5, 2)


def test_quantile_and_majority(spark):
    h = spark.createDataFrame([("x", i, m) for i, m in enumerate([1, 2, 3, 4])] + [("y", i, 0) for i in range(3)], "k string, idx long, mass long")
    assert rows(stats.quantile_index(h, ("k",), 0.5)) == [("x", 2, 10), ("y", 1, 0)]
    v = spark.createDataFrame([("x", b) for b in (3, 1, 2, 0)] + [("y", 2), ("y", 2), ("y", 0)], "k string, b int")
    assert rows(stats.majority(v, ("k",), "b")) == [("x", 0, 1), ("y", 2, 2)]


def test_regression(spark):
    v = spark.createDataFrame([("a", float(x), 2.0 * x + 1) for x in range(5)] + [("b", 1.0, 5.0), ("b", 2.0, 9.0)], "k string, x double, y double")
    assert rows(stats.regression(v, ("k",), "x", "y")) == [("a", 2.0, 1.0), ("b", math.inf, 1.5)]


def test_search(spark):
    lines = search.line_table(docs(spark, "the cat\nconcat", "cat, cat\nno", None))
    assert rows(search.keyword_hits(lines, ["cat", "cat", "zzz"])) == [("cat", 0, 0), ("cat", 1, 0)]
    assert rows(search.keyword_hits(lines, ["cat"], mode="part")) == [("cat", 0, 0), ("cat", 0, 1), ("cat", 1, 0)]
    assert rows(search.reject_counts(lines, ["cat"])) == [("cat", 4, 1, 0, 1, 2)]
    hits = search.keyword_hits(lines, ["cat"])
    assert search.best_hits(hits, 1, [F.col("doc_id")]).count() == 1 and search.best_hits(hits, -1, [F.col("doc_id")]).count() == 2
    assert search.nested(hits).first().json == '[{"doc_id":0,"line_no":0},{"doc_id":1,"line_no":0}]'


def test_fuzzy(spark):
    words = spark.createDataFrame([("kat", 1), ("cat", 2), ("dog", 3), ("cart", 1)], "term string, cnt long")
    got = {r.term: r.conf for r in search.fuzzy_hits(words, ["cat"], 0.5).collect()}
    assert got == {"cat": 1.0, "kat": pytest.approx(math.exp(-1 / 3)), "cart": pytest.approx(math.exp(-1 / 3))}


def test_keyword_bounds(spark):
    d = docs(spark, "a bb bb ccc ccc ccc")
    assert rows(search.keywords(d)) == [("a", 1), ("bb", 2), ("ccc", 3)]
    assert rows(search.keywords(d, max_len=2)) == [("a", 1), ("bb", 2)] and rows(search.keywords(d, max_occ=0)) == [] and rows(search.keywords(d, min_occ=3)) == [("ccc", 3)]


def test_runs(spark):
    v = spark.createDataFrame([(1, i, x) for i, x in enumerate("aabba")] + [(2, 0, None), (2, 1, None), (2, 2, "a")], "k long, i long, v string")
    assert rows(runs.runs(v, ["k"], "i", "v")) == sorted([(1, 0, "a", 0, 1, 2), (1, 1, "b", 2, 3, 2), (1, 2, "a", 4, 4, 1), (2, 0, None, 0, 1, 2), (2, 1, "a", 2, 2, 1)], key=str)
    assert rows(runs.runs(v.where("k = 1"), ["k"], "i", "v", F.col("v") == "b")) == [(1, 0, "a", 0, 1, 2), (1, 2, "a", 4, 4, 1)]
    assert rows(runs.parts(v.where("k = 1"), ["k"], "i", "v", ["b"])) == [(1, 0, 0, 1), (1, 2, 4, 4)]
    n = spark.createDataFrame([(1, i, x) for i, x in enumerate([3, 1, 3, 2, 5, 4])], "k long, i long, n int")
    assert rows(runs.merged_disorder(n, ["k"], "i", "n")) == [(1, 0, "3_1_3_2", 4), (1, 1, "5_4", 2)]


def test_training_series(spark):
    v = spark.createDataFrame([(1, i, x) for i, x in enumerate([0.9, 0.5, 0.6, 0.5, 0.7, 0.4, 0.5])], "k long, i long, v double")
    best = [(r.is_best, r.best) for r in runs.best_so_far(v, ["k"], ["i"], "v").orderBy("i").collect()]
    assert best == [(True, 0.9), (True, 0.5), (False, 0.5), (False, 0.5), (False, 0.5), (True, 0.4), (False, 0.4)]
    assert rows(runs.early_stop(v, ["k"], ["i"], "v", 3)) == [(1, 5)] and rows(runs.early_stop(v, ["k"], ["i"], "v", 3, below=0.45)) == []
    s = [r.smooth for r in runs.smooth(v.withColumn("m", F.lit(1.0)), ["k"], ["i"], "v", "m").orderBy("i").collect()]
    assert s[0] == pytest.approx((2 * 0.9 + 0.5) / 3) and s[1] == pytest.approx((0.9 + 1.0 + 0.6) / 4)
    z = [r.smooth for r in runs.smooth(v.withColumn("m", F.lit(0.0)), ["k"], ["i"], "v", "m").orderBy("i").collect()]
    assert z[0] == pytest.approx(0.7) and z[1] == pytest.approx(2 / 3)


def test_folds_and_batches(spark):
    v = spark.createDataFrame([(c,) for c in "dacb"], "name string")
    f = runs.folds(v, "name", 3)
    assert rows(f) == [("a", 0), ("b", 1), ("c", 2), ("d", 0)]
    assert rows(runs.all_but_fold(f, "fold", 3).groupBy("left_out").count()) == [(0, 2), (1, 3), (2, 3)]
    assert runs.all_but_fold(runs.folds(v, "name", 1), "fold", 1).count() == 4
    b = runs.batches(v, "name", 7, 3)
    assert b.count() == 3 and {r.batch for r in b.collect()} == {0} and rows(b) == rows(runs.batches(v, "name", 7, 3))


def test_pages(spark):
    v = spark.createDataFrame([(1, "GT", 0.9), (2, "gt", None), (3, None, 0.1), (4, "NEW", 0.2)], "i int, status string, conf double")
    assert [r.i for r in pages.with_status(v, "GT;DONE").collect()] == [1, 2] and pages.with_status(v, "DONE").count() == 0
    assert [r.i for r in pages.confident(v, 0.5).collect()] == [1, 2] and pages.of_ids(v, None, "i").count() == 4 and pages.of_ids(v, [1], "i").count() == 1
    good, bad = pages.checked_lines(spark.createDataFrame([("ok",), ("a\tb",), ("𝒳",)], "line string"))
    assert rows(good) == [("ok",)] and rows(bad) == [("a\tb", "category"), ("𝒳", "surrogate")]
    seg = spark.createDataFrame([(1, i, x) for i, x in enumerate(["before", "[p. 3] one", "two", "[Transkript: x]", "after", "[p. 4]four"])], "k long, i long, line string")
    assert rows(pages.page_segments(seg, ["k"], "i")) == [(1, 3, "one\ntwo"), (1, 4, "four")]
    m = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    assert rows(pages.replaced(m, spark.createDataFrame([(2, "c")], "k long, v string"), ["k"], "v")) == [(1, "a"), (2, "c")]
    with pytest.raises(Exception, match="no such key"):
        pages.replaced(m, spark.createDataFrame([(9, "c"), (1, "z")], "k long, v string"), ["k"], "v").union(pages.replaced(spark.createDataFrame([(9, "q")], "k long, v string"), spark.createDataFrame([(8, "c")], "k long, v string").unionAll(m), ["k"], "v")).collect()
    kept, gone = pages.removed(m, m.where("k = 1"), ["k"])
    assert rows(kept) == [(2, "b")] and rows(gone) == [(1, "a")]
    assert rows(pages.cached(m.select("k"), m.where("k = 1"), ["k"], "v", F.lit("new"))) == [(1, "a"), (2, "new")]


def test_evaluation(spark):
    p = spark.createDataFrame([(1, "abcd", "abxd"), (1, "ab", "ab"), (2, "x y", "x z q")], "k long, ref string, hyp string")
    assert rows(E.error_rate(p, ("k",))) == [(1, 1, 6, pytest.approx(1 / 6)), (2, 3, 3, 1.0)] and E.error_rate(p.where("ref = hyp")).first().cer == 0
    assert rows(E.word_error_rate(p, ("k",)))[1] == (2, 2, 2, 1.0)
    r = spark.createDataFrame([("q", i, s, rel) for i, s, rel in [(1, 0.9, True), (2, 0.8, False), (3, 0.7, True)]], "k string, i long, s double, rel boolean")
    assert E.average_precision(r, ["k"], "s", "i", "rel").first().ap == pytest.approx((1 + 2 / 3) / 2)
    assert sorted(x.rank for x in E.ranking(r, ["k"], "s", "i", "rel").collect()) == [1, 2, 3]
    a, b = spark.createDataFrame([(1,), (2,)], "k long"), spark.createDataFrame([(2, "x"), (1, "y")], "k long, v string")
    assert E.unique_join(a, b, "k").count() == 2
    with pytest.raises(Exception, match="not one to one"):
        E.unique_join(a, b.union(b), "k").collect()
    with pytest.raises(Exception, match="not one to one"):
        E.unique_join(a, b.where("k = 1"), "k").collect()
    assert rows(E.match_types(a, b.where("k = 2").select("k").union(spark.createDataFrame([(3,)], "k long")), ["k"])) == [(1, "FP"), (2, "TP"), (3, "FN")]


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(30, 31), (40, 40)], "a long, b long")
    assert rows(graph.components(edges)) == sorted([*[(i, 0) for i in range(21)], (30, 30), (31, 30), (40, 40)], key=str)


def test_greedy_match(spark):
    c = spark.createDataFrame([(1, 0, 0, 0.5), (1, 0, 1, 0.1), (1, 1, 1, 0.2), (1, 1, 0, 0.9), (1, 2, 2, 0.1)], "k long, i long, j long, cost double")
    assert rows(graph.greedy_match(c, ["k"], 0.6)) == [(1, 0, 1, 0.1), (1, 2, 2, 0.1)]
    tie = spark.createDataFrame([(1, 1, 1, 0.5), (1, 0, 1, 0.5), (1, 1, 0, 0.5)], "k long, i long, j long, cost double")
    assert rows(graph.greedy_match(tie, ["k"], 1.0)) == [(1, 0, 1, 0.5), (1, 1, 0, 0.5)]


@settings(max_examples=100, deadline=None)
@given(st.text("abc", max_size=8), st.text("abc", max_size=8))
def test_best_path_is_the_edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    moves = graph.edit_moves(list(a), list(b))
    path = graph.best_path(len(a), len(b), moves)
    assert (path[-1][3] if path else 0) == row[-1]
    every = graph.best_path(len(a), len(b), moves, every=True)
    assert (every[-1][3] if every else 0) == row[-1]
    turned = graph.best_path(len(b), len(a), graph.transposed(moves))
    assert (turned[-1][3] if turned else 0) == row[-1]


def test_path_limits(spark):
    moves = graph.edit_moves(list("abcd"), list("abxd"))
    assert graph.best_path(4, 4, moves, most=1) is None and graph.best_path(4, 4, moves, keep=lambda i, j, c: i == j)[-1][3] == 1
    assert graph.best_path(4, 4, moves, keep=lambda i, j, c: c < 1) is None and [s[0] for s in graph.best_path(4, 4, moves)].count("COR") == 3
    got = spark.createDataFrame([(["a", "b"], ["a", "c"])], "a array<string>, b array<string>").select(graph.alignment("a", "b").alias("p")).first().p
    assert [(s.op, s.i, s.j) for s in got] == [("COR", 1, 1), ("SUB", 2, 2)]
    assert graph.align_lines(["hello world", "foo bar"], "hello world junk foo bar".split(), 0.3) == [(0, 0, 2), (1, 3, 5)]


def test_lexicon(spark):
    words = spark.createDataFrame([("abc", 1), ("é", 2), ("aß", 3), ("a1", 4), ("a b", 5), ("11", 6)], "term string, cnt long")
    good, bad = lexicon.checked_dictionary(words, [*"abce1 ", "́"])
    assert rows(bad) == [("11", "category"), ("a b", "tokenizer"), ("a1", "tokenizer"), ("aß", "charmap")]
    assert {r.term for r in good.collect()} == {"abc", "e\u0301"}
    chars = spark.createDataFrame([(c,) for c in "a1,\t$ "], "ch string")
    assert {r.category: r.characters for r in lexicon.char_classes(chars).collect()} == {"L": ["a"], "N": ["1"], "P": [","], "C": ["\t"], "S": ["$"], "Z": [" "]}


def points(spark, *ps):
    return spark.createDataFrame([([{"x": x, "y": y} for x, y in ps],)], f"p {G.POINTS}")


def got(df, column):
    v = df.select(column.alias("v")).first().v
    return [(q.x, q.y) for q in v] if isinstance(v, list) else v


def test_geometry(spark):
    p = F.col("p")
    d = points(spark, (0, 0), (4, 2), (4, 2), (6, 2))
    assert got(d, G.print_points(p)) == "0,0 4,2 4,2 6,2" and got(d, G.parse_points(G.print_points(p))) == [(0, 0), (4, 2), (4, 2), (6, 2)]
    assert got(d, G.no_repeats(p)) == [(0, 0), (4, 2), (6, 2)] and got(d, G.reverse(p))[0] == (6, 2)
    assert got(d, G.raster(p)) == [(0, 0), (1, 1), (2, 1), (3, 2), (4, 2), (5, 2), (6, 2)] and got(points(spark, (1, 1)), G.raster(p)) == [(1, 1)]
    assert got(d, G.average_y(p)) == pytest.approx((0 + 2 * 2 + 2 * 2 + 2) / 6) and tuple(got(d, G.bounds(p, 5, 20))) == (-5, -20, 11, 22)
    assert got(d, G.scaled_down(p, 2)) == [(0, 0), (2, 1), (2, 1), (3, 1)] and got(d, G.rotated(p, 0.0)) == [(0, 0), (4, 2), (4, 2), (6, 2)]
    line = points(spark, *[(x, 0) for x in range(21)])
    assert got(line, G.thinned(p, 5)) == [(0, 0), (5, 0), (10, 0), (15, 0), (20, 0)] and got(line, G.part(p, F.lit(0.25), F.lit(0.5))) == [(x, 0) for x in range(5, 11)]
    assert got(points(spark, (0, 0), (1, 1), (2, 2), (2, 5)), G.collinear_reduced(p)) == [(0, 0), (2, 2), (2, 5)]
    made = G.collinear_rows(points(spark, (0, 0), (3, 3), (3, 6)).select(G.raster(p).alias("v")), "v")
    assert [(q.x, q.y) for q in made.first().v] == [(0, 0), (3, 3), (3, 6)]
    assert set(got(points(spark, (0, 0), (4, 0), (4, 4), (0, 4), (2, 2), (4, 2)), G.convex_hull(p))) == {(0, 0), (4, 0), (4, 4), (0, 4)}
    assert got(d, G.first_valid(F.lit(None).cast(G.POINTS), p)) == [(0, 0), (4, 2), (4, 2), (6, 2)] and got(d, G.is_polygon(p)) is True


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(-9, 9), st.integers(-9, 9)), min_size=3, max_size=20))
def test_hull_holds_all_points(ps):
    h = G.hull(ps)
    if len(h) > 2:
        for (ax, ay), (bx, by) in itertools.pairwise([*h, h[0]]):
            assert all((bx - ax) * (y - ay) - (by - ay) * (x - ax) >= 0 for x, y in ps)


def test_seam_against_brute_force():
    rng = random.Random(3)
    for _ in range(20):
        e = [[rng.randint(0, 9) for _ in range(5)] for _ in range(4)]
        paths = [p for p in itertools.product(range(4), repeat=5) if all(abs(a - b) < 2 for a, b in itertools.pairwise(p))]
        assert G.seam(e, [-1] * 5, [4] * 5)[0] == min(sum(e[y][x] for x, y in enumerate(p)) for p in paths)
        low, high, to = ([rng.randint(-1, 1) for _ in range(5)], [rng.randint(2, 4) for _ in range(5)], [rng.randint(0, 3) for _ in range(5)])
        cost = lambda x, y: e[y][x] + 0.5 * abs(to[x] - y) if low[x] < y < high[x] else 50_000  # noqa: E731, B023
        assert G.seam(e, low, high, to, 0.5)[0] == min(sum(cost(x, y) for x, y in enumerate(p)) for p in paths)
    assert G.monotone([(0, 0), (5, 0), (3, 0), (6, 0)]) == [(0, 0), (5, 0), (6, 0)] and G.inside([(0, 0), (4, 0), (4, 4), (0, 4)], 1, 1) and not G.inside([(0, 0), (4, 0), (4, 4)], 1, 3)


def test_spatial(spark):
    pts = spark.createDataFrame([(1, 10, 10), (1, 300, 10)], "k long, x int, y int")
    boxes = spark.createDataFrame([(1, "a", 0, 0, 600, 20), (1, "b", 290, 5, 310, 15)], "k long, id string, x0 int, y0 int, x1 int, y1 int")
    assert sorted((r.x, r.id) for r in G.grid_join(pts, boxes, ["k"]).collect()) == [(10, "a"), (300, "a"), (300, "b")]
    tol = spark.createDataFrame([(1, 0.0), (1, 4.0), (1, 8.0)], "k long, v double")
    assert sorted(r.tolerance for r in G.filled_tolerances(tol, ["k"], "v", 0.5).collect()) == [2.0, 3.0, 3.0]
    line = spark.createDataFrame([(1, i, i * 10, 100 - i * 10) for i in range(4)] + [(2, i, 30 - i * 10, 5) for i in range(4)], "k long, i int, x int, y int")
    assert {r.k: r.angle for r in G.orientation(line, ["k"]).collect()} == {1: pytest.approx(math.pi / 4), 2: pytest.approx(math.pi)}


def test_numbers(spark):
    d = spark.createDataFrame([([1.0, 2.0, 3.0, 10.0],)], "v array<double>")
    v = F.col("v")
    assert sum(d.select(N.softmax(v).alias("x")).first().x) == pytest.approx(1) and d.select(N.log_sum_exp(v).alias("x")).first().x == pytest.approx(math.log(sum(map(math.exp, (1, 2, 3, 10)))))
    assert d.select(N.trimmed_mean(v).alias("x")).first().x == 2.5 and d.select(N.trimmed_mean(v, 20.0).alias("x")).first().x == 20
    assert d.select(N.deep(v, 2).alias("x")).first().x == [[1, 2], [3, 10]] and d.select(N.deep(v, 3).alias("x")).first().x is None
    q = d.select(F.transform(v, lambda x: N.dequantise(N.quantise(x, 0.0, 10.0, 8), 0.0, 10.0, 8)).alias("x")).first().x
    assert all(abs(a - b) <= 10 / 255 for a, b in zip(q, (1, 2, 3, 10), strict=True))
    r = d.select(N.relative_cost(F.lit(3.0), F.lit(1.0), F.lit(None).cast("double"), F.lit(3), F.lit(0), F.lit(5)).alias("x"), N.confidence(F.lit(0.0)).alias("c"), N.cost(F.lit(1.0)).alias("k")).first()
    assert (r.x, r.c, r.k) == (1.0, 1.0, 0.0)
