import itertools
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from vellumflow.llm import extraction as X

from .data import DOCS

PAGES = "page_id long, url string, html string"


def model():
    return X.train(list(X.made_pages())[:150])


def test_held_out_pages():
    m, good, n = model(), 0, 0
    for source, lines in list(X.made_pages())[150:]:
        got = X.extract(source, m)[0].split("\n")
        want = [" ".join(x.split()) for x in lines]
        good += len(set(got) & set(want))
        n += max(len(set(got)), len(set(want)))
    assert good / n > 0.95


def test_parser():
    page = X.parse('<!DOCTYPE html><html><head><title>T &amp; t</title><script>var a="</p><b>";</script></head><body><!-- <p>no</p> --><p class="a b">one<br>two<p>three <b>bold</b><ul><li>x<li>y</ul><img src=x>tail</body>')
    assert [t for t in page.tag if t in ("p", "li", "b", "img")] == ["p", "p", "b", "li", "li", "img"]
    assert page.piece == ["T & t", "one", "two", "three", "bold", "x", "y", "tail"]
    assert page.attrs[page.tag.index("p")] == "a b"
    parents = {x: page.tag[page.parent[page.piece_node[page.piece.index(x)]]] for x in ("one", "bold", "x", "y")}
    assert parents == {"one": "body", "bold": "p", "x": "ul", "y": "ul"}


def test_broken_html_does_not_fail():
    for source in ("", "<", "<p", "</div></div>", "<!-- open", "<script>x", "a < b > c", "<p><table></p><td>", "\0<b\n>", "<div " + "x" * 10_000, "<p>" * 5000 + "deep", "text only"):
        page = X.parse(source)
        assert X.node_features(page, np.zeros(X.TOKENS)).shape == (len(page.tag), X.WIDTH)
        assert len(page.tag) == len(page.parent) == len(page.attrs)


def test_decoding_never_contradicts():
    rng = np.random.default_rng(0)
    for source, _ in list(X.made_pages())[:20]:
        page = X.parse(source)
        p = rng.random(len(page.tag))
        kept = X.decode(page, p)
        assert kept.dtype == bool and len(kept) == len(page.tag)
    page = X.parse("<div><p>a</p><p>b</p></div>")
    assert X.decode(page, np.array([0.5, 0.9, 0.45, 0.9]))[1:].tolist() == [True, True, True]  # one doubtful child does not break its parent
    assert X.decode(page, np.array([0.5, 0.01, 0.01, 0.99]))[1:].tolist() == [False, False, True]


def exhaustive(page, p):
    """The greatest log-likelihood over all ways to keep, drop or divide each subtree, by trying them."""
    has = np.zeros(len(page.tag))
    has[page.piece_node] = 1
    w = 0.3 + 0.7 * has
    p = np.clip(p, 1e-4, 1 - 1e-4)
    yes, no = w * np.log(p), w * np.log(1 - p)
    kids = [[j for j in range(len(p)) if page.parent[j] == i] for i in range(len(p))]

    def whole(i, value):
        return value[i] + sum(whole(j, value) for j in kids[i])

    def ways(i):
        out = [whole(i, yes), whole(i, no)]
        if kids[i]:
            out += [max(yes[i], no[i]) * has[i] - X.MIXED_COST + sum(c) for c in itertools.product(*(ways(j) for j in kids[i]))]
        return out

    return max(ways(0)), yes, no, has, kids


def worth(page, kept, yes, no, has, kids):
    """The log-likelihood of a decision: a subtree of one mind counts whole, where that is better."""

    def of(i):
        under = [of(j) for j in kids[i]]
        same = [kept[i] == s and all(u[1] == s for u in under) for s in (True, False)]
        options = [(sum_of(i, v), s) for s, v, ok in ((True, yes, same[0]), (False, no, same[1])) if ok]
        if kids[i] and (not has[i] or kept[i] == (yes[i] > no[i])):
            options.append((max(yes[i], no[i]) * has[i] - X.MIXED_COST + sum(u[0] for u in under), None))
        best = max(options, key=lambda o: o[0])
        return best[0], (True if same[0] else False if same[1] else None)

    def sum_of(i, v):
        return v[i] + sum(sum_of(j, v) for j in kids[i])

    return of(0)[0]


def test_decoding_is_the_best_of_all_choices():
    rng = np.random.default_rng(3)
    for source in ("<div><p>a</p><p>b</p></div>", "<div>x<p>a<b>c</b></p><p>b</p></div>", "<ul><li>a<li>b<li>c</ul><p>d</p>", "<div><div><p>a</p></div><div>b<i>c</i></div></div>"):
        page = X.parse(source)
        for _ in range(40):
            p = rng.random(len(page.tag))
            best, *rest = exhaustive(page, p)
            assert worth(page, X.decode(page, p), *rest) == pytest.approx(best)


def test_hostile_markup_is_parsed_in_linear_time():
    n = 40_000
    pages = ["<a " * n, "<div>" * n + "</b>" * n, "<form>" * n, "<p>" + "<ul>" + "<form>" * n, "<span>" * n + "<li>" * n, "<script " * n, "</title " * n, "<!-- " * n, "<b>x</b>" * n, "<title>" * n, "<i>" * n + "</i>" * n, "<table>" + "<tr><td>x" * n, "&lt" * n]
    for source in pages:
        began = time.perf_counter()
        page = X.parse(source)
        X.text_of(page, np.ones(len(page.tag), bool))
        assert time.perf_counter() - began < 3, source[:20]
    began = time.perf_counter()
    assert X.parse("<a " * 70_000).tag == ["#root"] and time.perf_counter() - began < 1


def test_implied_ends():
    page = X.parse("<table><tr><td>a<td>b<tr><td>c</table><ul><li>x<ul><li>y</ul><li>z</ul><dl><dt>t<dd>d<dt>u</dl><p>one<p>two<div>three")
    up = {text: page.tag[page.parent[node]] for node, text in zip(page.piece_node, page.piece, strict=True)}
    assert up == {"a": "tr", "b": "tr", "c": "tr", "x": "ul", "y": "ul", "z": "ul", "t": "dl", "d": "dl", "u": "dl", "one": "#root", "two": "#root", "three": "#root"}
    rows = [i for i, t in enumerate(page.tag) if t == "tr"]
    assert [page.tag[page.parent[i]] for i in rows] == ["table", "table"]


def test_attribute_tokens_are_learnt():
    """Words that no list knows tell main text from the rest."""
    rng = np.random.default_rng(1)
    made = []
    for _ in range(80):
        text = [f"{k} {rng.integers(0, 999)} word word" for k in range(3)]
        parts = [f'<div class="zork-{rng.integers(9)}">{text[0]}</div>', f'<div id="frob">{text[1]}</div>', f'<div class="zork">{text[2]}</div>']
        rng.shuffle(parts)
        made.append(("<body>" + "".join(parts), [text[0], text[2]]))
    m = X.train(made[:60])
    assert all(set(X.extract(s, m)[0].split("\n")) == set(lines) for s, lines in made[60:])
    zork, frob = (m.odds[X.token_numbers(t)[0]] for t in ("zork", "frob"))
    assert zork > 0.5 > -0.5 > frob


def test_table(spark):
    made = list(X.made_pages())[:60]
    docs = spark.createDataFrame([(i, "\n".join(lines), "en", "s", 1) for i, (_, lines) in enumerate(made)], DOCS)
    pages = spark.createDataFrame([(i, f"http://x.example/en/{i}.html?a=1", source) for i, (source, _) in enumerate(made)], PAGES)
    got = {r.page_id: r.main_text for r in X.extracted(pages, X.fit(pages, docs)).collect()}
    assert sum(got[i].split("\n") == [" ".join(x.split()) for x in lines] for i, (_, lines) in enumerate(made)) >= 50


def test_odd_rows_and_empty(spark):
    rows = [(1, None, None), (2, "", ""), (None, "http://x/1", "<p>some words</p>"), (3, "u", "<p>" + "word " * 50_000), (3, "u", "<p>again</p>"), (3, "u", "<p>again</p>")]
    pages = spark.createDataFrame(rows, PAGES).withColumn("doc_id", F.lit("x")).withColumn("text", F.lit("x"))
    docs = spark.createDataFrame([(1, None, "en", "s", 1), (None, "x", None, None, None)], DOCS)
    out = X.extracted(pages, X.fit(pages, docs)).collect()
    assert len(out) == 6 and {(r.main_text, r.n_nodes) for r in out if r.page_id in (1, 2)} == {("", 0)}
    empty = spark.createDataFrame([], PAGES)
    assert X.extracted(empty, X.fit(empty, spark.createDataFrame([], DOCS))).count() == 0
