import itertools
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vellumflow.llm import fingerprint as P
from vellumflow.llm.kernel import buffers

from .data import DOCS, none, odd_docs, words


def brute_counts(text: bytes):
    out = [0] * P.BUCKETS
    perm = P._PERM.tolist()
    for i in range(len(text) - 4):
        for salt, b, c in P._TRIPLETS:
            h = perm[salt]
            for x in (text[i], text[i + b], text[i + c]):
                h = perm[h ^ x]
            out[h % P.BUCKETS] += 1
    return out


def digest(*texts):
    buf, offs = buffers(pa.array(list(texts)))
    return P.encode(P.counts(buf, offs), np.diff(offs))


def test_counts():
    texts = ["abc", "", "hello world, hello é", words(random.Random(1), 50)]
    buf, offs = buffers(pa.array(texts))
    assert P.counts(buf, offs).tolist() == [brute_counts(t.encode()) for t in texts]


def test_difference():
    rng = random.Random(2)
    base = words(rng, 300)
    near, far = base.replace(base.split()[5], "zzz", 1), words(rng, 300)
    a, b, c = digest(base, near, far)
    assert P.difference(a, a) == 0 and P.difference(a, b) == P.difference(b, a) < P.difference(a, c)
    assert P.bounded(a.tobytes(), c.tobytes()) is None and P.bounded(a.tobytes(), None) is None and P.bounded(a.tobytes(), a.tobytes()) == 0


def test_bit_planes_give_the_difference():
    rng = np.random.default_rng(0)
    d = rng.integers(0, 256, (500, P.SIZE), dtype=np.uint8)
    a, b = rng.integers(0, 500, (2, 4000))
    assert (P._Rows(d).score(a, b) == P.difference(d[a], d[b])).all()


def classes(nodes, pairs):
    """Of each node the least that pairs connect it with."""
    up = {i: i for i in nodes}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {i: find(i) for i in up}


@pytest.mark.parametrize("block", [2, 4096])
def test_search_equals_brute_force(spark, block):
    rng = random.Random(3)
    rows = []
    for _ in range(40):
        base = words(rng, rng.randint(150, 400)).split()
        for _ in range(rng.randint(1, 5)):
            own = list(base)
            if rng.random() < 0.8:
                own[rng.randrange(len(own))] = "kappa"
            rows.append((len(rows), " ".join(own), "en", "s", 1))
    got = {r.doc_id: r for r in P.fingerprints(spark.createDataFrame(rows, DOCS), block=block).collect()}
    d = digest(*[r[1] for r in rows])
    first = {}
    for i, x in enumerate(d):
        first.setdefault(x.tobytes(), i)
    near, pairs = {}, []
    for (x, i), (y, j) in itertools.permutations(first.items(), 2):
        if (s := P.bounded(x, y)) is not None:
            near.setdefault(i, []).append((s, j))
            pairs.append((i, j))
    assert len(near) > 10
    least = classes(first.values(), pairs)
    for i, x in enumerate(d):
        r, copy = got[i], first[x.tobytes()]
        assert (r.digest, r.copy_of, r.class_id) == (x.tobytes().hex(), copy, least[copy])
        assert (r.n_links, (r.near_score, r.near_id)) == (len(near.get(copy, [])), min(near.get(copy, [(None, None)])))


def test_odd_rows_and_empty(spark):
    rows = P.fingerprints(odd_docs(spark)).collect()
    assert len(rows) == 13
    got = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert got[2].digest is None and got[5].digest is None and got[1].copy_of == 1 and got[9].digest
    assert all(r.copy_of is r.class_id is r.n_links is None for r in rows if r.doc_id is None)
    assert got[2].n_links is None and (got[1].class_id, got[1].n_links) == (1, 0)
    assert P.fingerprints(none(spark)).count() == 0


def edited(rng, text, share):
    own = text.split()
    for i in rng.sample(range(len(own)), max(1, round(share * len(own)))):
        own[i] = words(rng, 1)
    return " ".join(own)


def test_copies_with_changed_words_are_near(spark):
    rng = random.Random(7)
    rows, kind = [], {}
    for low, high in ((80, 150), (150, 400), (400, 1500)):
        for share in (0.01, 0.02, 0.05):
            for _ in range(25):
                base = words(rng, rng.randint(low, high))
                kind[len(rows)] = low, share
                rows += [(len(rows), base, "en", "s", 1), (len(rows) + 1, edited(rng, base, share), "en", "s", 1)]
    got = {r.doc_id: r for r in P.fingerprints(spark.createDataFrame(rows, DOCS)).collect()}
    hits = {}
    for i, k in kind.items():
        hits.setdefault(k, []).append(got[i].near_id == i + 1 or got[i + 1].copy_of == i)
    share = {k: sum(v) / len(v) for k, v in hits.items()}
    assert all(v >= 0.9 for (_, s), v in share.items() if s < 0.05) and sum(v for (_, s), v in share.items() if s == 0.05) / 3 >= 0.8, share


def test_recall_of_the_search(spark):
    """At least nine tenths of the links are found, each counted once however many samples its digests share."""
    rng = random.Random(8)
    rows = []
    for _ in range(30):
        base = words(rng, rng.choice([60, 120, 250, 700]))
        rows += [(len(rows) + k, edited(rng, base, rng.choice([0.01, 0.03, 0.06])), "en", "s", 1) for k in range(6)]
    d = digest(*[r[1] for r in rows])
    want = dict.fromkeys(range(len(rows)), 0)
    for i, j in itertools.combinations(range(len(rows)), 2):
        if P.bounded(d[i].tobytes(), d[j].tobytes()) is not None:
            want[i] += 1
            want[j] += 1
    frame = spark.createDataFrame([(i, bytearray(x.tobytes())) for i, x in enumerate(d)], "doc_id long, digest binary")
    for block in (3, P.BLOCK):
        counts, edges = P.links(frame, block=block)
        got = {r.doc_id: r.n_links for r in counts.collect()}
        assert sum(want.values()) > 400 and all(n <= want[i] for i, n in got.items()) and sum(got.values()) >= 0.9 * sum(want.values())
        assert edges.count() <= 2 * len(rows)


def test_links_and_classes_of_groups(spark):
    rng = random.Random(9)
    rows = []
    for group in range(6):
        base = words(rng, 300)
        rows += [(10 * group + k, edited(rng, base, 0.01), "en", "s", 1) for k in range(9)]
        rows.append((10 * group + 9, rows[-1][1], "en", "s", 1))
    ids = {r[0]: x for r, x in zip(rows, digest(*[r[1] for r in rows]), strict=True)}
    for block in (2, P.BLOCK):
        out = P.fingerprints(spark.createDataFrame(rows, DOCS), block=block).collect()
        first = sorted({r.copy_of for r in out})
        near = {i: sorted((s, j) for j in first if j != i and (s := P.bounded(ids[i].tobytes(), ids[j].tobytes())) is not None) for i in first}
        least = classes(first, [(i, j) for i in near for _, j in near[i]])
        assert sum(map(len, near.values())) > 6 * 9 * 7
        for r in out:
            assert (r.class_id, r.n_links, (r.near_score, r.near_id)) == (least[r.copy_of], len(near[r.copy_of]), near[r.copy_of][0])


def test_a_large_group_gives_no_pairs(spark):
    rng = random.Random(10)
    base = words(rng, 400)
    rows = [(i, edited(rng, base, 0.005), "en", "s", 1) for i in range(300)]
    d = digest(*[r[1] for r in rows])
    frame = spark.createDataFrame([(i, bytearray(x)) for i, x in enumerate({x.tobytes() for x in d})], "doc_id long, digest binary")
    n = frame.count()
    counts, edges = P.links(frame)
    assert counts.agg(F.avg("n_links")).first()[0] > 0.9 * (n - 1) and edges.count() < 8 * n < 0.1 * n * (n - 1)


def check_all(spark, texts, block):
    """Each row as brute force over all pairs of digests has it; ``texts`` are (doc_id, text)."""
    d = [x.tobytes() for x in digest(*[t for _, t in texts])]
    first = {}
    for (i, _), x in zip(texts, d, strict=True):
        first[x] = min(i, first.get(x, i))
    near, pairs = {x: [] for x in first}, []
    for x, y in itertools.combinations(first, 2):
        if (s := P.bounded(x, y)) is not None:
            near[x].append((s, first[y]))
            near[y].append((s, first[x]))
            pairs.append((x, y))
    root, least = classes(first, pairs), {}
    for x, i in first.items():
        least[root[x]] = min(i, least.get(root[x], i))
    apart = {t: x for (_, t), x in zip(texts, d, strict=True)}
    linked = {t: sum(P.bounded(x, y) is not None for other, y in apart.items() if other != t) for t, x in apart.items()}
    want = [(i, x.hex(), first[x], least[root[x]], len(near[x]), *min(near[x], default=(None, None)), linked[t]) for (i, t), x in zip(texts, d, strict=True)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in texts], DOCS)
    got = P.fingerprints(docs, block=block).select("doc_id", "digest", "copy_of", "class_id", "n_links", "near_score", "near_id", "n_texts").collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    return pairs


@pytest.mark.parametrize("block", [7, P.BLOCK])
def test_no_link_is_left_out(spark, block):
    """Links near the limit, and links of texts of lengths more than one code apart."""
    rng = random.Random(11)
    texts = []
    for size in (20, 60, 120, 250, 700, 1500):
        for _ in range(5):
            base = words(rng, size)
            texts += [base, f"{base} {base}", " ".join([base] * 3), *(edited(rng, base, share) for share in (0.02, 0.04, 0.06, 0.08, 0.1))]
    pairs = check_all(spark, list(enumerate(texts)), block)
    assert len(pairs) > 300 and sum(abs(x[0] - y[0]) > 1 for x, y in pairs) > 20
    assert sum(P.difference(*(np.frombuffer(z, np.uint8) for z in p)) >= 0.8 * P.limit(*(np.frombuffer(z, np.uint8) for z in p)) for p in pairs) > 50


def test_texts_that_share_a_doc_id(spark):
    """Their links count, each for its own text, and do not connect what is near to another text of that doc_id."""
    rng = random.Random(12)
    a, b, c = (words(rng, 300) for _ in range(3))
    texts = [(1, a), (1, edited(rng, a, 0.005)), (1, b), (0, edited(rng, b, 0.005)), (5, edited(rng, a, 0.005)), (6, c), (6, edited(rng, c, 0.005)), (7, c)]
    assert len(check_all(spark, texts, P.BLOCK)) >= 5


def test_different_texts_of_one_digest_are_linked(spark):
    """They count as links of each other, copies do not, and whatever is near to one of them is linked with each."""
    rng = random.Random(13)
    base = words(rng, 400).split()
    texts = [" ".join([*base[:i], "kappa", *base[i + 1 :]]) for i in range(0, 400, 4)]
    texts += texts[::9]
    assert 1 < len({x.tobytes() for x in digest(*texts)}) < len(set(texts)) < len(texts)
    check_all(spark, list(enumerate(texts)), P.BLOCK)
