import itertools
import random
import re

import pytest

from vellumflow.llm import neardup as N

from .data import DOCS, none, odd_docs, words


def shingles(text):
    w = re.findall(r"[a-z0-9_\x80-\U0010ffff]+", (text or "").lower())
    return {tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))} if w else set()


def brute(rows, threshold):
    par = {i: i for i, _ in rows}

    def find(x):
        while par[x] != x:
            x = par[x]
        return x

    sets = {i: shingles(t) for i, t in rows}
    pairs = set()
    for a, b in itertools.combinations(par, 2):
        u = len(sets[a] | sets[b])
        if u and len(sets[a] & sets[b]) / u >= threshold:
            pairs.add((a, b))
            x, y = find(a), find(b)
            par[max(x, y)] = min(x, y)
    return {i: find(i) for i in par}, pairs


def corpus(n=150, seed=3):
    rng = random.Random(seed)
    passage = words(rng, 60)
    rows = []
    for i in range(n):
        base = words(rng, rng.randint(60, 300)).split()
        if i % 4 == 0:
            base = [*base, *passage.split()]  # a passage that many share makes no copies
        rows.append((len(rows), " ".join(base)))
        for _ in range(rng.choice([0, 0, 1, 3, 40 if i == 7 else 0])):
            copy = [rng.choice(["kappa", "omega", w]) if rng.random() < 0.03 else w for w in base]
            rows.append((len(rows), " ".join(copy)))
    return rows


@pytest.mark.parametrize("limits", [{}, {"node_limit": 4}, {"node_limit": 2, "task_limit": 6}])
def test_groups_equal_brute_force(spark, limits):
    rows = corpus()
    want, pairs = brute(rows, N.THRESHOLD)
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], DOCS)
    got = {r.doc_id: r.group_id for r in N.near_duplicates(df, **limits).collect()}
    assert set(got) == set(want)
    assert sum(got[a] == got[b] for a, b in pairs) >= 0.9 * len(pairs)
    together = {(a, b) for a, b in itertools.combinations(sorted(got), 2) if got[a] == got[b]}
    true = {(a, b) for a, b in itertools.combinations(want, 2) if want[a] == want[b]}
    assert len(together & true) >= 0.95 * len(together)


def test_limits_do_not_change_the_groups(spark):
    """Whether a node is worked on in a task or by Spark, its groups are the same: among them a large one of like documents, and many with one passage."""
    rng = random.Random(6)
    base, passage = words(rng, 200).split(), words(rng, 80).split()
    rows = [" ".join(rng.choice(["kappa", "omega", w]) if rng.random() < 0.02 else w for w in base) for _ in range(120)]
    rows += [" ".join([*passage, *words(rng, rng.randint(20, 120)).split()]) for _ in range(120)]
    rows += [" ".join(rng.choice(["kappa", w]) if rng.random() < 0.1 else w for w in rows[k].split()) for k in range(100, 180)]
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(rows)], DOCS)
    told = [sorted((r.doc_id, r.group_id) for r in N.near_duplicates(df, node_limit=8, task_limit=k).collect()) for k in (200_000, 40, 9)]
    assert told[0] == told[1] == told[2]
    want, pairs = brute(list(enumerate(rows)), N.THRESHOLD)
    got = dict(told[0])
    assert sum(got[a] == got[b] for a, b in pairs) >= 0.9 * len(pairs)


def test_links_span_the_groups(spark):
    rows = corpus(60, 4)
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], DOCS)
    edges, _ = N.links(df)
    edges = [tuple(r) for r in edges.collect()]
    told = {r.doc_id: r for r in N.near_duplicates(df).collect()}
    assert all(told[a].group_id == told[b].group_id for a, b in edges) and len(edges) == len(set(edges))
    n = {i: sum(i in e for e in edges) for i in told}
    assert all((n[i] > 0) == (r.n_links > 0) for i, r in told.items())
    sizes = {}
    for r in told.values():
        sizes.setdefault(r.group_id, []).append(r.n_links > 0)
    assert all(all(v) if len(v) > 1 else not v[0] for v in sizes.values())


def test_trees_for_a_recall():
    assert N.trees(0.5, 0.995) == 6 and N.trees(0.5, 0.9) < 6 < N.trees(0.3, 0.995) and N.trees(1.0, 0.9) == 1
    for bad in (0, 1):
        with pytest.raises(ValueError):
            N.trees(0.5, bad)


def test_of_one_doc_id_the_least_text_stays(spark):
    rng = random.Random(7)
    texts = [words(rng, 50) for _ in range(4)]
    rows = [(1, texts[0], "en", "a", 1), (1, texts[1], "en", "b", 2), (1, min(texts[:2]), "en", "zz", 2), (2, texts[1], "de", "c", 3), (3, texts[2], "de", "c", 3), (4, texts[3], "de", "c", 4), (4, None, "de", "c", 4)]
    for order in (rows, rows[::-1], rows[3:] + rows[:3]):
        docs = spark.createDataFrame(order, DOCS).repartition(3)
        got = sorted(tuple(r) for r in N.deduplicated(docs).collect())
        first = min(r for r in rows[:3] if r[1] == min(texts[:2]))
        assert got == sorted([first, rows[4], rows[6]])  # 2 is a copy of one of the texts of 1


def test_one_text_without_end(spark):
    rng = random.Random(8)
    many = [(5, words(rng, 30), "en", "s", 1)] * 500 + [(6 + i, "the very same text in all of these documents", "en", "s", 1) for i in range(500)]
    got = N.near_duplicates(spark.createDataFrame(many, DOCS)).collect()
    assert len(got) == 501 and {r.group_id for r in got} == {5, 6} and next(r.n_links for r in got if r.doc_id == 6) == 499
    assert N.deduplicated(spark.createDataFrame(many, DOCS)).count() == 2


def test_odd_rows(spark):
    docs = odd_docs(spark)
    got = {r.doc_id: r.group_id for r in N.near_duplicates(docs).collect()}
    assert set(got) == {1, 2, 3, 4, 5, 6, 7, 8, 9}
    assert got[2] == got[3] == 2 and got[4] == 4  # null and empty texts are alike, blank ones only with the same
    kept = N.deduplicated(docs)
    assert kept.columns == docs.columns
    ids = sorted((r.doc_id is None, r.doc_id) for r in kept.collect())
    assert [i for null, i in ids if not null] == [1, 2, 4, 5, 6, 7, 8, 9] and sum(null for null, _ in ids) == 2


def test_empty(spark):
    assert N.near_duplicates(none(spark)).count() == 0
    assert N.deduplicated(none(spark)).count() == 0


def test_components_of_long_chains(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (100, 100)], "a long, b long")
    got = {r.doc_id: r.group_id for r in N.connected(edges).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, 101: 100}
