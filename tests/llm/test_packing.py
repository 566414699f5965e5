import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from vellumflow.llm import packing as P

from .data import DOCS, none, odd_docs


def brute(lengths, capacity):
    """Best-fit decreasing one piece at a time: (window, offset) of each, by falling length."""
    room, out = [], []
    for n in sorted(lengths, reverse=True):
        fit = [(r, i) for i, r in enumerate(room) if r >= n]
        if fit:
            i = min(fit)[1]
        else:
            i = len(room)
            room.append(capacity)
        out.append((n, i, capacity - room[i]))
        room[i] -= n
    return out


def expand(counts, placements):
    out = []
    for n in sorted(counts, reverse=True):
        own = [p for p in placements.tolist() if p[0] == n]
        for t in range(counts[n]):
            _, lo, _, first, per, base = next(p for p in own if p[1] <= t < p[2])
            out.append((n, first + (t - lo) // per, base + (t - lo) % per * n))
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 24), max_size=120))
def test_plan_equals_piece_by_piece(lengths):
    counts = {}
    for n in lengths:
        counts[n] = counts.get(n, 0) + 1
    assert expand(counts, P.plan(counts, 24)) == brute(lengths, 24)


def test_capacities():
    tree = P.Capacities(37)
    have = set()
    rng = random.Random(1)
    for _ in range(2000):
        r = rng.randint(1, 37)
        on = rng.random() < 0.5
        tree.set(r, on)
        (have.add if on else have.discard)(r)
        x = rng.randint(1, 37)
        assert tree.least(x) == min((h for h in have if h >= x), default=-1)


@pytest.mark.parametrize("part", [7, P.PART])
def test_documents(spark, part):
    rng = random.Random(4)
    n = {i: rng.choice([1, 2, 3, 7, 20, 49, 50, 51, 100, 1234]) for i in range(500)}
    docs = spark.createDataFrame([(i, "w " * k, "en", "s", k) for i, k in n.items()], DOCS)
    rows = P.packed(docs, capacity=50, part=part).collect()
    assert sum(r.length for r in rows) == sum(n.values())
    by_doc, by_window = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append((r.start, r.length))
        by_window.setdefault(r.window_id, []).append((r.offset, r.length))
    for i, own in by_doc.items():  # the parts of a document follow each other without gap, all but the last full
        at = 0
        for start, length in sorted(own):
            assert start == at and (length == 50 or at + length == n[i])
            at += length
        assert at == n[i]
    for own in by_window.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 50
    pieces = [length for own in by_doc.values() for _, length in own]
    want = brute(pieces, 50)
    assert sorted((r.length, r.window_id, r.offset) for r in rows) == sorted(want)


def test_odd_rows_and_empty(spark):
    docs = odd_docs(spark)
    rows = P.packed(docs).collect()
    assert {r.doc_id for r in rows} == {1, None, 5, 6, 7, 8, 9}
    assert sum(r.doc_id == 1 for r in rows) == 3 and sum(r.length for r in rows if r.doc_id == 6) == 60_000
    assert P.packed(none(spark)).count() == 0


@pytest.mark.parametrize("counts", [{}, {1: 5}, {24: 3}])
def test_small_plans(counts):
    assert expand(counts, P.plan(counts, 24)) == brute([n for n, c in counts.items() for _ in range(c)], 24)


def test_copies_of_one_document_are_ranked_in_parts(spark):
    docs = spark.createDataFrame([(1, "w " * 130, "en", "s", 1)] * 400 + [(None, "w " * 50, "en", "s", 1)] * 200, DOCS)
    rows = P.packed(docs, capacity=50, part=10).collect()
    full = [r.window_id for r in rows if r.length == 50]
    assert len(rows) == 400 * 3 + 200 and len(set(full)) == len(full) == 1000
    assert sorted((r.length, r.window_id, r.offset) for r in rows) == sorted(brute([50] * 1000 + [30] * 400, 50))
