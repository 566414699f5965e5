"""Operator 2, toxicity by weak supervision.

1. Voters. Lexicons: ``INSULTS`` (English of three kinds, German, and French with Spanish), and one for each kind of word feature (the whole
   word, or its first 4 to 8 bytes), mined from labelled rows by greedy cover. Patterns: density of lexicon words, address
   before a lexicon word, masked or shouted text, and a voter for clean text. Each votes toxic, clean or not at all.
2. A generative label model: a latent class and a dependency tree over the voters, which carries their accuracies
   and pairwise correlations, estimated by EM from the vote patterns of all documents. Those labelled rows that
   no lexicon was mined from anchor the two classes: in each M-step they have the same weight as all documents.
3. A linear classifier on the density of word features, trained on the label model's posteriors of documents, labelled or not: no row's own
   label is used there. Its bias is set so that its scores add up to the posteriors of the whole table.

Labelled rows used: at most ``TOXIC_ROWS`` labelled toxic and ``CLEAN_ROWS`` labelled clean, those of least hash of doc_id. Half of them serve to
mine lexicons; the other half, on which the lexicons are not biased, anchors the label model. The classifier learns from at most ``TRAIN_TOXIC`` and
``TRAIN_CLEAN`` documents of posterior above and below a half, those of least hash. Votes and the label model's statistics cover all documents.

Without labels the lexicons of ``INSULTS`` and the patterns vote, and the label model is fitted to their agreement alone. Null, empty and blank texts, and all others without
a word, have probability 0. Repeated rows each get their score, and count once for training. Labels with a null, and labels of unknown documents,
are not used; a document with several labels is toxic if one says so, and one with several texts is known by the least of them. A doc_id has to be an integer.
An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .kernel import U64, buffers, chunks, hash_words, mix, words
from .shared import fitted, written

TOXIC_ROWS, CLEAN_ROWS = 4000, 6000
TRAIN_TOXIC, TRAIN_CLEAN = 4000, 6000
#: Up to so many vote patterns are broadcast with their posteriors; beyond, Spark chooses how to join them.
PATTERNS = 100_000
FEATURES = 2048
THRESHOLD = 0.5
PREFIXES = (4, 5, 6, 7, 8)
INSULTS = (
    "idiot idiots idiotic moron morons moronic stupid dumb dumbass imbecile cretin dimwit halfwit nitwit fool foolish brainless airhead dunce simpleton dolt numbskull",
    "scum trash worthless pathetic disgusting clown clowns filth filthy vermin loser losers garbage parasite maggot degenerate lowlife pig swine coward weasel leech",
    "bastard bastards bitch bitches asshole assholes jerk jerks shit shithead bullshit fuck fucking fucker prick dick dickhead cunt whore slut douchebag crap wanker",
    "dummkopf trottel depp deppen arschloch schwachkopf vollidiot abschaum drecksack mistkerl hurensohn wichser versager schlampe scheisse scheiße penner spast blödmann",
    "imbécile crétin abruti connard connasse salaud salope ordure merde enculé débile minable idiota imbécil estúpido estúpida cabrón pendejo gilipollas basura mierda puta escoria",
)
ADDRESS = "you are a an is such u ur du bist ein eine ihr seid tu es un une vous eres una sois"
_ABSTAIN, _TOXIC, _CLEAN = 0, 1, 2
_NVOTERS = len(INSULTS) + 1 + len(PREFIXES) + 4


def _hashes(text: str) -> np.ndarray:
    raw = [w.encode() for w in text.split()]
    lens = np.array([len(w) for w in raw])
    return hash_words(np.frombuffer(b"".join(raw), np.uint8), np.cumsum(lens) - lens, lens)[0]


@dataclass
class KeySet:
    """Membership of 64-bit hashes, with a bitmap before the exact search."""

    keys: np.ndarray
    bits: np.ndarray = field(init=False, repr=False)

    def __post_init__(self) -> None:
        self.keys = np.unique(np.asarray(self.keys, np.uint64))
        self.bits = np.zeros(1 << 18, bool)
        self.bits[(self.keys >> U64(46)).astype(np.int64)] = True

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in ``h`` that are members, and their indices among the keys."""
        at = np.flatnonzero(self.bits[(h >> U64(46)).astype(np.int64)])
        if not len(at) or not len(self.keys):
            return at[:0], at[:0]
        k = np.minimum(np.searchsorted(self.keys, h[at]), len(self.keys) - 1)
        ok = self.keys[k] == h[at]
        return at[ok], k[ok]


@cache
def _seeds() -> list[KeySet]:
    return [KeySet(_hashes(x)) for x in INSULTS]


def features(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Each word's document, words per document, and for the whole word and each prefix: word indices and hashes."""
    s, lens, at = words(buf, offs)
    h, pre = hash_words(buf, s, lens, PREFIXES)
    count = np.diff(at)
    doc = np.repeat(np.arange(len(count)), count)
    return doc, count, [(np.arange(len(s)), h)] + [pre[p] for p in PREFIXES]


def votes(buf: np.ndarray, offs: np.ndarray, lexicons: list[KeySet]) -> np.ndarray:
    """The votes of all voters (documents x voters)."""
    n = len(offs) - 1
    doc, count, kinds = features(buf, offs)
    seeds = _seeds()
    out = np.zeros((n, _NVOTERS), np.int8)
    hit = np.zeros(len(doc), bool)
    for v, (lexicon, (at, h)) in enumerate([*((x, kinds[0]) for x in seeds), *zip(lexicons, kinds, strict=True)]):
        found = at[lexicon.find(h)[0]]
        hit[found] = True
        out[np.unique(doc[found]), v] = _TOXIC
    v = len(seeds) + len(kinds)
    hits = np.bincount(doc[hit], minlength=n)
    share = hits / np.maximum(count, 1)
    out[:, v] = np.where(share >= 0.006, _TOXIC, np.where(share < 0.001, _CLEAN, _ABSTAIN))
    at, _ = KeySet(_hashes(ADDRESS)).find(kinds[0][1])
    next_word = at[(at + 1 < len(doc))] + 1
    met = next_word[hit[next_word] & (doc[next_word] == doc[next_word - 1])]
    out[np.unique(doc[met]), v + 1] = _TOXIC
    loud = ((buf[1:] == 33) & (buf[:-1] == 33)) | ((buf[1:] == 42) & (buf[:-1] == 42))
    shouts = np.bincount(np.searchsorted(offs, np.flatnonzero(loud), "right") - 1, minlength=n)
    out[:, v + 2] = np.where(shouts * 50 > np.maximum(count, 50), _TOXIC, _ABSTAIN)
    out[:, v + 3] = np.where(hits == 0, _CLEAN, _ABSTAIN)
    return out


def _code(votes_: np.ndarray) -> np.ndarray:
    return votes_.astype(np.int64) @ (3 ** np.arange(votes_.shape[1], dtype=np.int64))


def _decode(codes: np.ndarray) -> np.ndarray:
    return codes[:, None] // 3 ** np.arange(_NVOTERS, dtype=np.int64) % 3


@dataclass
class Sample:
    """Documents of a bounded sample: for each kind of feature (document, hash, count), and labels or posteriors."""

    label: np.ndarray
    kinds: list[tuple[np.ndarray, np.ndarray, np.ndarray]]
    text: pa.Array


def _sample(col: pa.Array, label: np.ndarray) -> Sample:
    raw, offs = buffers(col)
    small = np.uint16 if len(col) <= 65_536 else np.uint32
    parts: list[list[tuple[np.ndarray, ...]]] = [[(np.zeros(0, np.uint16), np.zeros(0, np.uint64), np.zeros(0, np.uint16))] for _ in range(1 + len(PREFIXES))]
    for i, j in chunks(offs):
        doc, _, kinds = features(raw[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
        for own, (at, h) in zip(parts, kinds, strict=True):
            order = np.lexsort((h, doc[at]))
            d, k = doc[at][order] + i, h[order]
            new = np.ones(len(d), bool)
            new[1:] = (d[1:] != d[:-1]) | (k[1:] != k[:-1])
            first = np.flatnonzero(new)
            own.append((d[first].astype(small), k[first], np.minimum(np.diff(np.append(first, len(d))), 65_535).astype(np.uint16)))
    joined = []
    while parts:  # one kind after the other, so that its parts can go
        joined.append(tuple(np.concatenate(x) for x in zip(*parts.pop(0), strict=True)))
    return Sample(label, joined, col)


def mine(sample: Sample, kind: int) -> np.ndarray:
    """Features of one kind that cover the toxic documents greedily, each far commoner in toxic than in clean ones."""
    doc, key, _ = sample.kinds[kind]
    key, inv = np.unique(key, return_inverse=True)
    toxic = sample.label == 1
    n1, n0 = max(1, int(toxic.sum())), max(1, int((~toxic).sum()))
    df1 = np.bincount(inv[toxic[doc]], minlength=len(key))
    df0 = np.bincount(inv[~toxic[doc]], minlength=len(key))
    good = (df1 >= 3) & (df1 / n1 >= 15 * (df0 + 0.5) / n0) & (df1 / n1 >= 100 * df0 / n0)
    row = good[inv] & toxic[doc]
    feat, doc = inv[row], doc[row]
    least, picked = max(3, int(np.ceil(0.004 * n1))), []
    while len(feat) and len(picked) < 400:
        gain = np.bincount(feat, minlength=len(key))
        best = int(np.argmax(gain * (1 + df1 / (1e3 * n1))))
        if gain[best] < least:
            break
        picked.append(best)
        gone = np.zeros(len(sample.label), bool)
        gone[doc[feat == best]] = True
        left = ~gone[doc]
        feat, doc = feat[left], doc[left]
    return key[picked]


@dataclass
class LabelModel:
    """p(y), and p(vote | y, vote of the parent voter), with the tree of parents."""

    prior: float
    parent: np.ndarray
    table: np.ndarray  # voter, y, parent's vote, vote

    def posterior(self, codes: np.ndarray) -> np.ndarray:
        v = _decode(codes)
        logit = np.full(len(v), np.log(self.prior) - np.log1p(-self.prior))
        for j, p in enumerate(self.parent):
            up = v[:, p] if p >= 0 else np.zeros(len(v), np.int64)
            logit += np.log(self.table[j, 1, up, v[:, j]]) - np.log(self.table[j, 0, up, v[:, j]])
        return 1 / (1 + np.exp(-np.clip(logit, -50, 50)))


def fit_label_model(codes: np.ndarray, n: np.ndarray, known: np.ndarray, rounds: int = 60) -> LabelModel:
    """EM on vote patterns, how many documents have each, and how many labelled clean and toxic (patterns x 2)."""
    anchor = known.T / np.maximum(known.sum(0)[:, None], 1)
    anchored = len(known) > 0 and known.sum(0).min() > 0
    v, n = _decode(codes), n.astype(float)
    one = np.eye(3)[v]  # pattern, voter, vote
    lexical = (v[:, : _NVOTERS - 2] == _TOXIC).sum(1)
    q = np.where(lexical >= 2, 0.9, np.where(lexical == 1, 0.4, 0.02))
    model = None
    for r in range(rounds):
        w = np.stack([n * (1 - q), n * q])  # y, pattern
        toxic = w[1].sum()
        if anchored:
            w = w + anchor * w.sum(1, keepdims=True)
        joint = np.einsum("yp,pia,pjb->yijab", w, one, one, optimize=True)
        if r % 10 == 0:
            parent = _tree(joint)
        table = np.zeros((_NVOTERS, 2, 3, 3))
        for j, p in enumerate(parent):
            c = joint[:, p, j] if p >= 0 else np.repeat(np.einsum("yp,pa->ya", w, one[:, j])[:, None], 3, 1)
            back = np.einsum("yp,pa->ya", w, one[:, j]) + 1.0
            back /= back.sum(1, keepdims=True)
            c = c + 2.0 * back[:, None]
            if not anchored and j < _NVOTERS - 4:  # unlabelled: a lexicon seldom hits clean text and often toxic text, whatever others say
                c[0] += 0.2 * n.sum() * np.array([0.989, 0.01, 0.001])
                c[1] += 0.2 * max(1.0, toxic) * np.array([0.69, 0.01, 0.3])
            table[j] = c / c.sum(2, keepdims=True)
        model = LabelModel(float(np.clip(toxic / max(1.0, n.sum()), 1e-4, 0.5)), parent, table)
        now = model.posterior(codes)
        if np.abs(now - q).max(initial=0) < 1e-6:
            break
        q = now
    return model


def _tree(joint: np.ndarray) -> np.ndarray:
    """The spanning tree of most mutual information given the class."""
    m = joint.shape[1]
    p = joint + 1e-9
    p /= p.sum((0, 3, 4), keepdims=True)
    py, pa_, pb = p.sum((3, 4), keepdims=True), p.sum(4, keepdims=True), p.sum(3, keepdims=True)
    info = (p * np.log(p * py / (pa_ * pb))).sum((0, 3, 4))
    parent, reach = np.full(m, -1), info[0].copy()
    src, todo = np.zeros(m, int), set(range(1, m))
    while todo:
        j = max(todo, key=lambda x: (reach[x], -x))
        todo.remove(j)
        parent[j] = src[j]
        better = info[j] > reach
        reach, src = np.where(better, info[j], reach), np.where(better, j, src)
    return parent


def density(times: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The value of a feature that occurs so often in so many words."""
    return np.log1p(times * 300.0 / (count + 200.0))


def hits(doc: np.ndarray, count: np.ndarray, kinds: list[tuple[np.ndarray, np.ndarray]], lexicons: list[KeySet]) -> np.ndarray:
    """For each document of so many words how it meets the lexicons: 0 not at all, 1 in less than a thousandth of its words, else 2 to 4 for once, twice, more often."""
    hit = np.zeros(len(doc), bool)
    for lexicon, (at, h) in zip(lexicons, kinds, strict=True):
        hit[at[lexicon.find(h)[0]]] = True
    n = np.bincount(doc[hit], minlength=len(count))
    return np.where(n == 0, 0, np.where(n < 0.001 * count, 1, np.minimum(n, 3) + 1))


_HITS = 5


@dataclass
class Classifier:
    """Weights of the densities of word features, by kind; the score is a logit."""

    sets: list[KeySet]
    weights: list[np.ndarray]
    bias: float
    lexicons: list[KeySet]
    by_hits: np.ndarray

    def score(self, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
        doc, count, kinds = features(buf, offs)
        z = self.bias + self.by_hits[hits(doc, count, kinds, self.lexicons)]
        for (at, h), own, w in zip(kinds, self.sets, self.weights, strict=True):
            pos, k = own.find(h)
            pair, times = np.unique(doc[at[pos]].astype(np.int64) * (len(w) + 1) + k, return_counts=True)
            d = pair // (len(w) + 1)
            z += np.bincount(d, density(times, count[d]) * w[pair % (len(w) + 1)], len(count))
        return np.where(count > 0, 1 / (1 + np.exp(-np.clip(z, -50, 50))), 0.0)


def matched_bias(z: np.ndarray, weight: np.ndarray, total: float) -> float:
    """What to add to the logits ``z`` so that their weighted probabilities add up to ``total``."""
    low, high = -40.0, 40.0
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if (weight / (1 + np.exp(-np.clip(z + mid, -50, 50)))).sum() < total else (low, mid)
    return (low + high) / 2


def fit_classifier(sample: Sample, q: np.ndarray, weight: np.ndarray, lexicons: list[KeySet], rounds: int = 300) -> Classifier:
    """Logistic regression with posterior labels ``q``; ``weight`` is how many documents of the table a row stands for, and sets the bias alone."""
    lexicons = [KeySet(np.concatenate([lexicons[0].keys, *(x.keys for x in _seeds())])), *lexicons[1:]]
    n, n1 = len(q), q.sum()
    known: list[tuple[np.ndarray, np.ndarray]] = []  # by kind, the hashes of its best features and how much each tells
    for doc, key, _ in sample.kinds:
        key, inv = np.unique(key, return_inverse=True)
        df = np.bincount(inv, minlength=len(key)).astype(float)
        a = np.bincount(inv, q[doc], len(key))  # toxic documents with the feature
        with np.errstate(divide="ignore", invalid="ignore"):
            e = df * n1 / max(n, 1)
            g = np.where(a > 0, a * np.log(a / e), 0) + np.where(df - a > 1e-12, (df - a) * np.log((df - a) / (df - e)), 0)
        g[df < 3] = 0
        best = np.argsort(-g, kind="stable")[:FEATURES]
        best = best[g[best] > 5]
        known.append((key[best], g[best]))
    told = np.concatenate([g for _, g in known])
    top = np.zeros(len(told), bool)
    top[np.argsort(-told, kind="stable")[:FEATURES]] = True
    picked = [np.sort(k[t]) for (k, _), t in zip(known, np.split(top, np.cumsum([len(k) for k, _ in known])[:-1]), strict=True)]
    first = np.cumsum([0, *(len(k) for k in picked)])
    x = np.zeros((n, first[-1] + _HITS), np.float32)
    raw, offs = buffers(sample.text)
    for i, j in chunks(offs):
        doc, count, by_kind = features(raw[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
        x[np.arange(i, j), first[-1] + hits(doc, count, by_kind, lexicons)] = 1
    length = np.bincount(sample.kinds[0][0], sample.kinds[0][2], n)
    for k, (doc, key, count) in enumerate(sample.kinds):
        at, column = KeySet(picked[k]).find(key)
        x[doc[at], first[k] + column] = density(count[at], length[doc[at]])
    w, b = np.zeros(x.shape[1], np.float32), 0.0
    m, s, mb, sb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for t in range(1, rounds + 1):
        d = (1 / (1 + np.exp(-np.clip(x @ w + b, -30, 30))) - q).astype(np.float32) / max(n, 1)
        gw, gb = x.T @ d + np.float32(3e-4) * w, float(d.sum())
        m, s, mb, sb = 0.9 * m + 0.1 * gw, 0.99 * s + 0.01 * gw * gw, 0.9 * mb + 0.1 * gb, 0.99 * sb + 0.01 * gb * gb
        c1, c2 = 1 - 0.9**t, 1 - 0.99**t
        w = (w - 0.05 * (m / c1) / (np.sqrt(s / c2) + 1e-8)).astype(np.float32)
        b -= 0.05 * (mb / c1) / (np.sqrt(sb / c2) + 1e-8)
    b += matched_bias(x @ w + b, weight, float((weight * q).sum())) if n else -40.0
    weights = [w[first[k] : first[k + 1]].astype(float) for k in range(len(picked))]
    return Classifier([KeySet(k) for k in picked], weights, float(b), lexicons, w[first[-1] :].astype(float))


def _gather(batches: Iterator[pa.RecordBatch], key: str, value: str) -> Sample:
    rows = [b for b in batches if b.num_rows]
    if not rows:
        return _sample(pa.array([], pa.string()), np.zeros(0))
    table = pa.Table.from_batches(rows).sort_by([(key, "ascending"), ("text", "ascending")])
    return _sample(table.column("text"), table.column(value).to_numpy())


def _mine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sample = _gather(batches, "doc_id", "toxic")
    keys = [mine(sample, kind) for kind in range(1 + len(PREFIXES))]
    yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(keys)], pa.binary())], ["model"])


def _train(keys: list[np.ndarray], totals: tuple[int, int]):
    """totals: documents of posterior below and from a half."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sample = _gather(batches, "h", "q")
        q, toxic = sample.label, sample.label >= 0.5
        weight = np.where(toxic, totals[1] / max(1, toxic.sum()), totals[0] / max(1, (~toxic).sum()))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit_classifier(sample, q, weight, [KeySet(k) for k in keys]))], pa.binary())], ["model"])

    return run


def _vote(keys: list[np.ndarray]):
    """Rows (key, text) to (key, vote code)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicons = [KeySet(k) for k in keys]
        for b in batches:
            raw, offs = buffers(b.column(1))
            for i, j in chunks(offs):
                code = _code(votes(raw[offs[i] : offs[j]], offs[i : j + 1] - offs[i], lexicons))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(code)], ["h", "code"])

    return run


def labelled(docs: DataFrame, labels: DataFrame, toxic_rows: int = TOXIC_ROWS, clean_rows: int = CLEAN_ROWS) -> DataFrame:
    """The bounded sample of labelled documents: doc_id, text in lower case, toxic, fold."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("long").alias("toxic")).where("doc_id is not null and toxic is not null")
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    picked = known.where("toxic = 1").orderBy(*order).limit(toxic_rows).union(known.where("toxic = 0").orderBy(*order).limit(clean_rows))
    # at most toxic_rows + clean_rows rows of 16 bytes, whatever the tables hold; the least text of a doc_id, so that one which repeats without end is one row
    met = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lower("text").alias("text")).join(F.broadcast(picked), "doc_id")
    return met.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(2)))


def fit(docs: DataFrame, labels: DataFrame) -> Classifier:
    spark = docs.sparkSession
    sample = written(labelled(docs, labels), "toxicity-labelled")
    keys = fitted(sample.where("fold = 0").select("doc_id", "text", "toxic"), _mine)
    told = docs.select(F.xxhash64(F.col("doc_id").cast("string"), "text").alias("h"), F.lower("text").alias("text"))
    seen = written(told.mapInArrow(_vote(keys), "h long, code long"), "toxicity-votes")
    # one row for each vote pattern that occurs: some hundreds, and never more than 3 ^ voters
    total = {r.code: r.n for r in seen.groupBy("code").agg(F.count("*").alias("n")).collect()}
    known = sample.where("fold = 1").select("toxic", "text").mapInArrow(_vote(keys), "h long, code long").groupBy("h", "code").agg(F.count("*").alias("n")).collect()
    known = {(r.code, r.h): r.n for r in known}
    codes = sorted({*total, *(c for c, _ in known)})
    n = np.array([total.get(c, 0) for c in codes])
    model = fit_label_model(np.array(codes, np.int64), n, np.array([[known.get((c, y), 0) for y in (0, 1)] for c in codes], float).reshape(-1, 2))
    q = model.posterior(np.array(codes, np.int64))
    table = spark.createDataFrame([(c, float(x)) for c, x in zip(codes, q, strict=True)], "code long, q double")
    each = seen.join(F.broadcast(table) if len(codes) <= PATTERNS else table, "code").select("h", "q").distinct()
    order = [F.xxhash64("h"), F.col("h")]
    picked = each.where("q >= 0.5").orderBy(*order).limit(TRAIN_TOXIC).union(each.where("q < 0.5").orderBy(*order).limit(TRAIN_CLEAN))
    # at most TRAIN_TOXIC + TRAIN_CLEAN rows of 16 bytes
    texts = told.join(F.broadcast(picked), "h").groupBy("h", "q").agg(F.first("text").alias("text"))
    return fitted(written(texts, "toxicity-train").select("h", "text", "q"), _train(keys, (int(n[q < 0.5].sum()), int(n[q >= 0.5].sum()))))


def scorer(classifier: Classifier):
    """A column function: the probability that a text in lower case is toxic."""

    @F.arrow_udf("double")
    def score(text: pa.Array) -> pa.Array:
        raw, offs = buffers(text)
        parts = [classifier.score(raw[offs[i] : offs[j]], offs[i : j + 1] - offs[i]) for i, j in chunks(offs)]
        return pa.array(np.concatenate(parts) if parts else np.zeros(0))

    return score


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each row of ``docs``: doc_id, p_toxic, toxic."""
    p = scorer(fit(docs, labels))(F.lower("text"))
    out = docs.select("doc_id", p.alias("p_toxic"))
    return out.withColumn("toxic", F.col("p_toxic") > THRESHOLD)


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that aren't toxic, with all their columns."""
    p = scorer(fit(docs, labels))(F.lower("text"))
    return docs.where(p <= THRESHOLD)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
