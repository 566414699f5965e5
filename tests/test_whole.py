"""Registered queries against brute force on small tables with what a shortcut would leave out."""

import math
import random

from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from vellumflow.functions import geometry as G
from vellumflow.operators import graph
from vellumflow.plans.catalog import QUERIES

TURNS = "conv_id long, turn int, role string, text string"


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def conversations(spark, path):
    """Turns by (conv_id, turn), written as the table: short, long, accented, and of other scripts."""
    rng = random.Random(11)
    rows = []
    for conv in range(3):
        for turn in range(6):
            words = [rng.choice(["één", "the", "naïve", "token", "Ünder", "of", "漢字"]) for _ in range(rng.choice([4, 30, 140]))]
            rows.append((conv, turn, ("user", "assistant")[turn % 2], " ".join(words)))
    spark.createDataFrame(rows, TURNS).write.parquet(f"{path}/conversations.parquet")
    return {r[:2]: r[3] for r in rows}


def test_error_rates_and_alignment_of_all_turns(spark, tmp_path):
    turns = conversations(spark, tmp_path)
    pairs = [(c, t, x, turns[c, t + 1]) for (c, t), x in turns.items() if (c, t + 1) in turns]
    assert max(len(x) for *_, x, _ in pairs) > 400
    cer, wer = ({r.conv_id: r for r in QUERIES[q](spark, str(tmp_path)).collect()} for q in ("cer_pairs", "wer_pairs"))
    for conv in range(3):
        own = [(x, y) for c, _, x, y in pairs if c == conv]
        assert (cer[conv].errors, cer[conv].length) == (sum(edits(x, y) for x, y in own), sum(len(x) for x, _ in own))
        assert (wer[conv].errors, wer[conv].length) == (sum(edits(x.split(), y.split()) for x, y in own), sum(len(x.split()) for x, _ in own))
    told = {(r.conv_id, r.turn): (r.errors, r.n_ref, r.n_hyp) for r in QUERIES["dp_align"](spark, str(tmp_path)).collect()}
    assert told == {(c, t): (edits(x.split(), y.split()), len(x.split()), len(y.split())) for c, t, x, y in pairs}
    both = spark.createDataFrame([(c, t, x.split(), y.split()) for c, t, x, y in pairs], "c long, t int, x array<string>, y array<string>")
    for r in both.select("x", "y", graph.alignment(F.col("x"), F.col("y")).alias("path")).collect():
        assert r.path[-1].cost == edits(r.x, r.y) and (r.path[-1].i, r.path[-1].j) == (len(r.x), len(r.y))


@settings(max_examples=300, deadline=None)
@given(st.text("abc", max_size=14), st.text("abc", max_size=14))
def test_edit_path_is_the_searched_path(a, b):
    assert graph.edit_path(list(a), list(b)) == graph.best_path(len(a), len(b), graph.edit_moves(list(a), list(b)))


def test_greedy_match_of_all_turns(spark, tmp_path):
    turns = conversations(spark, tmp_path)
    want = set()
    for conv in range(3):
        costs = sorted((edits(turns[conv, i], turns[conv, j]) / max(len(turns[conv, i]), len(turns[conv, j])), i, j) for i in (0, 2, 4) for j in (1, 3, 5))
        free = set(range(6))
        for cost, i, j in costs:
            if cost < 0.9 and {i, j} <= free:
                free -= {i, j}
                want.add((conv, i, j, cost))
    assert any(len(turns[c, i]) > 200 for c, i, *_ in want)
    assert {tuple(r) for r in QUERIES["greedy_match"](spark, str(tmp_path)).collect()} == want


def test_fuzzy_search_of_the_whole_dictionary(spark, tmp_path):
    text = "The the THE thé License licénse licence Version versión vérsïon Password pässword idiót Idiot banana 漢字 tie"
    spark.createDataFrame([(1, text, "en", "s", len(text))], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    conf = {(q, t): math.exp(-edits(t, q) / len(q)) for q in ("password", "license", "version", "the", "idiot") for t in text.split()}
    want = {(q, t, 1, round(c, 6)) for (q, t), c in conf.items() if c >= 0.5}
    assert {("the", "The"), ("license", "licénse"), ("version", "vérsïon"), ("password", "Password")} <= {r[:2] for r in want}
    assert {tuple(r) for r in QUERIES["kw_fuzzy"](spark, str(tmp_path)).collect()} == want


def test_components_over_short_lines(spark, tmp_path):
    long = "a line of rather more than forty characters, shared"
    texts = ["one\nshort", "short\n\ntwo", f"three\n{long}", f"{long}\n\nfour\nétroit", "five\nétroit", "six\n"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {tuple(r) for r in QUERIES["components"](spark, str(tmp_path)).collect()} == {(0, 0), (1, 0), (2, 2), (3, 2), (4, 2)}


def test_polygons_of_all_coordinates(spark, tmp_path):
    rng = random.Random(12)
    vectors = {i: [rng.uniform(-1, 1) for _ in range(64)] for i in range(5)}
    spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    points = {i: [(20 * k, math.floor(x * 200)) for k, x in enumerate(v)] for i, v in vectors.items()}
    told = lambda q: {r.vec_id: r for r in QUERIES[q](spark, str(tmp_path)).collect()}
    text, stats, sizes, hull, reduced = (told(q) for q in ("polygon_text", "baseline_stats", "raster_sizes", "convex_hull", "collinear_reduced"))
    for i, p in points.items():
        ys = [y for _, y in p]
        assert text[i].points == " ".join(f"{x},{y}" for x, y in p)
        assert (stats[i].y0, stats[i].y1) == (min(ys) - 20, max(ys) + 20)
        assert math.isclose(stats[i].avg_y, (2 * sum(ys) - ys[0] - ys[-1]) / 126, abs_tol=1e-6)
        assert sizes[i].n == 1 + sum(max(20, abs(b - a)) for a, b in zip(ys[:-1], ys[1:], strict=True))
        corners = G.hull(p)
        assert (hull[i].n, hull[i].area2) == (len(corners), abs(sum(a * d - b * c for (a, b), (c, d) in zip(corners, corners[1:] + corners[:1], strict=True))))
        assert max(x for x, _ in corners) == 20 * 63 and 2 <= reduced[i].n < sizes[i].n
