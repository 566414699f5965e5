"""Operator 4, main text of HTML pages: gradient-boosted trees over DOM nodes, decoded over the tree.

A tolerant parser makes the DOM, in time linear in the page; each node has features of its subtree (text, tags, density, links), its depth,
siblings and ancestors, and its attribute tokens: those of class, id and role, hashed to ``TOKENS`` numbers, whose log odds of main text are learnt from the training
pages (for the pages of one half from the other half, so that the trees do not trust a token seen once). Boosted trees, trained here, give the probability that a node's subtree is mostly main text. Decoding
picks for each node, from the leaves up, to keep all of its subtree, to drop all of it, or to leave the choice to its children,
with the greatest total log-likelihood; so no node is kept under a dropped one or dropped under a kept one.

Training: ``TRAIN_PAGES`` pages at most, of least hash of page_id, whose source document is known (the number in the URL's path is a
doc_id); a node's text is main if it is a line of that document (the last such nodes, where it comes again). To these come pages made from templates, which alone serve where no
source is known. The parser and the features read whole pages.

Null and empty html gives an empty text of no nodes. Repeated rows each have their result. A page_id that is null is kept; ids have to be integers. Of the rows
with one page_id, or one doc_id, the least html or text serves for training. Other columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import html as entities
import pickle
import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import checkpointed, fitted, written

TRAIN_PAGES = 600
MADE_PAGES = 200
ROUNDS, DEPTH, BINS, RATE = 40, 4, 32, 0.3
MIXED_COST = 0.5
#: Numbers of attribute tokens, and how many nodes of even odds each is taken to have been seen in.
TOKENS, EVEN = 1024, 4.0

_TAG = re.compile(r"<(?:(!--)|(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)>|[!?][^>]*>)")
_ATTR = re.compile(r"""(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript iframe template".split())
_BLOCK = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main nav ol p pre section table tbody td tfoot th thead tr ul title".split())
#: What an opening tag closes, by kind: the innermost open element of the kind, unless one of the kind's bounds is open within it.
_KINDS = {"p": 0, "li": 1, "dt": 2, "dd": 2, "tr": 3, "td": 4, "th": 4, "option": 5}
_BOUNDS = ("ul ol table div article section body html td th dl nav main aside", *["ul ol dl table select"] * 2, "table", "ul ol dl table select tr", "select")
_ENDS = {tag: tuple(k for k, names in enumerate(_BOUNDS) if tag in names.split()) for tag in {t for names in _BOUNDS for t in names.split()}}
_GROUPS = ("p", "h1 h2 h3 h4 h5 h6", "li dd dt", "td th", "a", "b i em strong span u small code", "div section ul ol table", "article main", "nav footer aside header form", "head script style title meta noscript")
_GROUP = {t: k for k, names in enumerate(_GROUPS) for t in names.split()}
_TOKEN = re.compile(r"[a-z0-9]+")


@dataclass
class Page:
    """Nodes in document order (parents before children) and pieces of text in document order."""

    tag: list[str]
    parent: list[int]
    attrs: list[str]
    piece_node: list[int]
    piece: list[str]
    line: list[int]  # of each piece: pieces of one line join


def parse(text: str) -> Page:
    """The tree of a page. Beyond the last ``>`` there is only text, so no search runs to the end in vain; what an end tag or an implied end
    closes is known from counts and from marks on the open elements, without a walk up the tree."""
    page = Page(["#root"], [-1], [""], [], [], [])
    pos, line, n = 0, 0, len(text)
    last = text.rfind(">") + 1
    tag, parent, attrs = page.tag, page.parent, page.attrs
    stack, near = [0], [(0,) * len(_BOUNDS)]  # open elements, and for each, by kind, the depth of the element that would be closed (0: none)
    open_: Counter[str] = Counter()

    def say(end: int) -> None:
        raw = text[pos:end]
        if raw and not raw.isspace():
            page.piece_node.append(stack[-1])
            page.piece.append(" ".join(entities.unescape(raw).split()))
            page.line.append(line)

    def close(depth: int) -> None:
        for i in stack[depth:]:
            open_[tag[i]] -= 1
        del stack[depth:], near[depth:]

    while (m := _TAG.search(text, pos, last)) is not None:
        say(m.start())
        pos = m.end()
        if m[1]:
            end = text.find("-->", pos)
            pos = n if end < 0 else end + 3
            continue
        if m[3] is None:
            continue
        name = m[3].lower()
        if name in _BLOCK or name == "br":
            line += 1
        if m[2]:
            if open_[name] > 0:
                k = len(stack) - 1
                while tag[stack[k]] != name:
                    k -= 1
                close(k)
            continue
        if name in _BLOCK and name != "hr" and near[-1][0]:
            close(near[-1][0])
        if (kind := _KINDS.get(name)) and near[-1][kind]:
            close(near[-1][kind])
        if name == "br":
            continue
        tag.append(name)
        parent.append(stack[-1])
        attrs.append(" ".join(x for g in _ATTR.findall(m[4]) for x in g if x).lower() if "=" in m[4] else "")
        if name in _VOID or m[4].endswith("/"):
            continue
        if name in _RAW:
            end = _end_of(name).search(text, pos, last)
            if name == "title" and end:
                stack.append(len(tag) - 1)
                say(end.start())
                stack.pop()
            pos = end.end() if end else n
            line += 1
            continue
        if name in _ENDS or kind is not None:
            marks = list(near[-1])
            for k in _ENDS.get(name, ()):
                marks[k] = 0
            if kind is not None:
                marks[kind] = len(stack)
            near.append(tuple(marks))
        else:
            near.append(near[-1])
        stack.append(len(tag) - 1)
        open_[name] += 1
    end = text.find("<!--", pos)
    say(n if end < 0 else end)
    return page


@cache
def _end_of(name: str) -> re.Pattern[str]:
    return re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I)


def token_numbers(attrs: str) -> list[int]:
    """The numbers of the different tokens of an element's class, id and role."""
    return sorted({zlib.crc32(t.encode()) % TOKENS for t in _TOKEN.findall(attrs)})


def token_odds(pages: Iterable[tuple[Page, np.ndarray, np.ndarray]]) -> np.ndarray:
    """The log odds, against all nodes', that a node with a token is main text, of (page, labels, weights)."""
    seen, main = np.zeros(TOKENS + 1), np.zeros(TOKENS + 1)
    for page, y, w in pages:
        for i, a in enumerate(page.attrs):
            if w[i] > 0:
                for t in (*(token_numbers(a) if a else ()), TOKENS):
                    seen[t] += 1
                    main[t] += y[i]
    rate = np.clip(main[-1] / max(1.0, seen[-1]), 1e-3, 1 - 1e-3)
    p = (main[:-1] + EVEN * rate) / (seen[:-1] + EVEN)
    p = np.clip(p, 1e-3, 1 - 1e-3)
    return np.log(p / (1 - p)) - np.log(rate / (1 - rate))


def node_features(page: Page, odds: np.ndarray) -> np.ndarray:
    """Features of all nodes (n x ``WIDTH``); ``odds`` are those of the attribute tokens."""
    n = len(page.tag)
    parent = np.array(page.parent)
    own, punct, wordn = np.zeros(n), np.zeros(n), np.zeros(n)
    for node, text in zip(page.piece_node, page.piece, strict=True):
        own[node] += len(text)
        punct[node] += text.count(",") + text.count(".") + text.count(";")
        wordn[node] += text.count(" ") + 1
    group = np.array([_GROUP.get(t, -1) for t in page.tag])
    learnt = odds.tolist()
    numbers = [token_numbers(a) if a else () for a in page.attrs]
    best = np.array([max((learnt[t] for t in x), default=0.0) for x in numbers])
    worst = np.array([min((learnt[t] for t in x), default=0.0) for x in numbers])
    depth, over_best, over_worst = np.zeros(n), np.zeros(n), np.zeros(n)
    in_main, in_side = np.zeros(n), np.zeros(n)
    rank, kids, same = np.zeros(n), np.zeros(n), {}
    in_a = group == 4
    for i in range(1, n):
        p = page.parent[i]
        depth[i] = depth[p] + 1
        over_best[i], over_worst[i] = max(over_best[p], best[p]), min(over_worst[p], worst[p])
        in_main[i] = max(in_main[p], group[p] == 7)
        in_side[i] = max(in_side[p], group[p] in (8, 9))
        in_a[i] = in_a[i] or in_a[p]
        rank[i] = kids[p]
        kids[p] += 1
        same[p, page.tag[i]] = same.get((p, page.tag[i]), 0) + 1
    chars, tags, links, points, word_sum = own.copy(), np.ones(n), own * in_a, punct.copy(), wordn.copy()
    for i in range(n - 1, 0, -1):
        p = page.parent[i]
        chars[p] += chars[i]
        tags[p] += tags[i]
        links[p] += links[i]
        points[p] += points[i]
        word_sum[p] += word_sum[i]
    up = np.maximum(parent, 0)
    of = np.maximum(chars, 1)
    peers = np.array([same.get((page.parent[i], page.tag[i]), 1) for i in range(n)], float)
    cols = [
        depth, np.log1p(own), np.log1p(chars), np.log1p(chars / tags), links / of, kids, rank, kids[up], peers / np.maximum(kids[up], 1), points / of * 100, word_sum / of * 10, np.log1p(word_sum),
        chars / max(chars[0], 1), links[up] / of[up], chars / of[up], np.log1p(tags), best, worst, over_best, over_worst, in_main, in_side, in_a.astype(float), own / of, *[(group == k).astype(float) for k in range(len(_GROUPS))],
    ]
    return np.stack(cols, 1).astype(np.float32)


WIDTH = 24 + len(_GROUPS)


@dataclass
class Boosted:
    """Trees of depth ``DEPTH`` as heaps: feature, threshold (go right if above), leaf values; and the odds of attribute tokens."""

    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray
    base: float
    odds: np.ndarray = field(default_factory=lambda: np.zeros(TOKENS))

    def probability(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for f, t, v in zip(self.feature, self.threshold, self.leaf, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                at = 2 * at + 1 + (x[rows, f[at]] > t[at])
            z += v[at - (2**DEPTH - 1)]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def boost(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Boosted:
    """Logistic gradient boosting on binned features."""
    inner = 2**DEPTH - 1
    if not len(x):
        return Boosted(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)), 0.0)
    edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1])) for k in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, k], "left") for k, e in enumerate(edges)], 1)
    rate = float(np.clip((weight * y).sum() / weight.sum(), 1e-3, 1 - 1e-3))
    base = float(np.log(rate / (1 - rate)))
    z, out = np.full(len(x), base), []
    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-z))
        g, h = weight * (y - p), weight * p * (1 - p)
        feature, threshold, at = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(len(x), np.int64)
        for level in range(DEPTH):
            first, width = 2**level - 1, 2**level
            slot = at - first
            best = np.full(width, 1e-6)
            cut = np.zeros(width, np.int64)
            for k in range(x.shape[1]):
                key = slot * BINS + binned[:, k]
                gs, hs = (np.bincount(key, v, width * BINS).reshape(width, BINS).cumsum(1) for v in (g, h))
                gt, ht = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + 1) + (gt - gs) ** 2 / (ht - hs + 1) - gt**2 / (ht + 1)
                gain[:, len(edges[k]) :] = -1
                b = gain.argmax(1)
                up = gain[np.arange(width), b] > best
                best[up] = gain[np.arange(width), b][up]
                feature[first : first + width][up], cut[up] = k, b[up]
                threshold[first : first + width][up] = [edges[k][i] for i in b[up]]
            at = 2 * at + 1 + (x[np.arange(len(x)), feature[at]] > threshold[at])
        leaf_at = at - inner
        gs, hs = np.bincount(leaf_at, g, inner + 1), np.bincount(leaf_at, h, inner + 1)
        leaf = RATE * gs / (hs + 1)
        z += leaf[leaf_at]
        out.append((feature, threshold, leaf))
    return Boosted(*(np.stack(v) for v in zip(*out, strict=True)), base)


def decode(page: Page, p: np.ndarray) -> np.ndarray:
    """Which nodes' own text is kept."""
    n = len(page.tag)
    has = np.zeros(n)
    has[page.piece_node] = 1
    w = 0.3 + 0.7 * has
    p = np.clip(p, 1e-4, 1 - 1e-4)
    yes, no = w * np.log(p), w * np.log(1 - p)
    keep, drop, each = yes.tolist(), no.tolist(), (np.maximum(yes, no) * has - MIXED_COST).tolist()
    inner = [False] * n
    for i in range(n - 1, 0, -1):
        up = page.parent[i]
        inner[up] = True
        keep[up] += keep[i]
        drop[up] += drop[i]
        each[up] += max(keep[i], drop[i], each[i]) if inner[i] else max(keep[i], drop[i])
    state = np.zeros(n, np.int8)  # 1 keep, 2 drop, 3 each child its own
    kept = np.zeros(n, bool)
    for i in range(n):
        up = page.parent[i]
        if i and state[up] in (1, 2):
            state[i] = state[up]
        else:
            best = max(keep[i], drop[i], each[i] if inner[i] else -np.inf)
            state[i] = 3 if inner[i] and best == each[i] else 1 if best == keep[i] else 2
        kept[i] = state[i] == 1 or (state[i] == 3 and p[i] > 0.5)
    return kept


def text_of(page: Page, kept: np.ndarray) -> str:
    lines: list[list[str]] = []
    last = None
    for node, text, line in zip(page.piece_node, page.piece, page.line, strict=True):
        if kept[node]:
            if line == last:
                lines[-1].append(text)
            else:
                lines.append([text])
            last = line
    return "\n".join(map(" ".join, lines))


def node_labels(page: Page, known: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Whether most of each subtree's text is a known line, and the nodes' weights (0 without text).

    A line is found as often as it is known, from the page's end on: titles come before the text they repeat.
    """
    n, left = len(page.tag), Counter(known)
    chars, main = np.zeros(n), np.zeros(n)
    for node, text in zip(reversed(page.piece_node), reversed(page.piece), strict=True):
        chars[node] += len(text)
        if left[text] > 0:
            left[text] -= 1
            main[node] += len(text)
    for i in range(n - 1, 0, -1):
        chars[page.parent[i]] += chars[i]
        main[page.parent[i]] += main[i]
    return main * 2 >= np.maximum(chars, 1), (chars > 0).astype(float)


def made_pages(n: int = MADE_PAGES) -> Iterator[tuple[str, list[str]]]:
    """Pages from templates and their main lines."""
    rng = np.random.default_rng(11)
    syllables = "ba de ki lo mu na pe ri so tu ve wa xi yo zu an en in or ul".split()

    def say(k: int) -> str:
        words = ["".join(rng.choice(syllables, rng.integers(1, 4))) for _ in range(k)]
        return " ".join(w + ("." if rng.random() < 0.1 else "") for w in words).capitalize() + "."

    for _ in range(n):
        lines = [say(int(rng.integers(8, 90))) for _ in range(rng.integers(2, 9))]
        links = "".join(f'<li><a href="/{k}">{say(int(rng.integers(1, 4)))}</a></li>' for k in range(rng.integers(3, 9)))
        side = f'<{(t := rng.choice(["aside", "div"]))} class="{rng.choice(["sidebar", "ad", "promo", "related-links"])}">{say(int(rng.integers(2, 14)))}</{t}>'
        body = "".join(f"<p>{x}</p>" if rng.random() < 0.9 else f"<p><b>{x}<br>" for x in lines)
        box = rng.choice(["<article>|</article>", '<div class="content">|</div>', '<main><div id="post">|</div></main>', "<div><div>|</div></div>"]).split("|")
        head = f"<h1>{say(6)}</h1>"
        menu = rng.choice(["<nav><ul>|</ul></nav>", '<div class="menu"><ul>|</ul></div>', "<header><ul>|</ul></header>"]).split("|")
        notes = "".join(f'<div class="comment"><p>{say(int(rng.integers(3, 20)))}</p></div>' for _ in range(rng.integers(0, 3)))
        foot = rng.choice(["<footer>|</footer>", '<div class="footer">|</div>']).split("|")
        yield f"<html><head><title>{say(6)}</title></head><body>{menu[0]}{links}{menu[1]}{side}{box[0]}{head}{body}{box[1]}{notes}{foot[0]}&copy; {say(5)}{foot[1]}</body></html>", lines


def train(pages: Iterable[tuple[str, list[str]]]) -> Boosted:
    """A model of (html, main lines)."""
    told = [(page := parse(source), *node_labels(page, known)) for source, known in pages]
    halves = [token_odds(told[k::2]) for k in (0, 1)]
    x = np.concatenate([np.zeros((0, WIDTH), np.float32), *(node_features(page, halves[1 - k % 2]) for k, (page, _, _) in enumerate(told))])
    y, w = (np.concatenate([np.zeros(0), *(t[j] for t in told)]).astype(float) for j in (1, 2))
    own = w > 0
    model = boost(x[own], y[own], w[own])
    model.odds = token_odds(told)
    return model


def _fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = sorted((r["page_id"], r["html"], r["text"]) for b in batches for r in b.to_pylist())
    pages = [*made_pages(), *((source, [x for x in (" ".join(y.split()) for y in text.split("\n")) if x]) for _, source, text in rows)]
    yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(train(pages))], pa.binary())], ["model"])


def fit(pages: DataFrame, documents: DataFrame, rows: int = TRAIN_PAGES) -> Boosted:
    """Trains on a bounded sample of pages with their source documents, in one task."""
    known = pages.select(F.col("page_id").cast("long").alias("page_id"), F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-z]+://[^/]+/(?:[^?#]*/)?(\d+)(?:[.?#/]|$)", 1).try_cast("long").alias("doc_id"))
    picked = known.where("page_id is not null and doc_id is not null").groupBy("page_id").agg(F.min("doc_id").alias("doc_id")).orderBy(F.xxhash64("page_id"), "page_id").limit(rows)
    picked = F.broadcast(checkpointed(picked))  # at most ``rows`` rows of two numbers
    source = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(picked, "doc_id").where("text is not null").groupBy("page_id").agg(F.min("text").alias("text"))
    sample = pages.select(F.col("page_id").cast("long").alias("page_id"), "html").where("html is not null").join(picked.select("page_id"), "page_id").groupBy("page_id").agg(F.min("html").alias("html"))
    sample = written(sample, "extraction-pages").join(written(source, "extraction-sources"), "page_id").select("page_id", "html", "text")
    return fitted(sample, _fit)


def extract(source: str, model: Boosted) -> tuple[str, int, int]:
    """Main text, nodes, nodes with kept text of one page."""
    return _extract([source], model)[0]


def _extract(sources: list[str | None], model: Boosted) -> list[tuple[str, int, int]]:
    pages = [parse(s) if s else None for s in sources]
    xs = [node_features(p, model.odds) for p in pages if p]
    prob = model.probability(np.concatenate(xs)) if xs else np.zeros(0)
    out, at = [], 0
    for page in pages:
        if page is None:
            out.append(("", 0, 0))
            continue
        kept = decode(page, prob[at : at + len(page.tag)])
        at += len(page.tag)
        out.append((text_of(page, kept), len(page.tag) - 1, int(kept[np.unique(page.piece_node).astype(int)].sum())))
    return out


def _apply(model: Boosted):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 200):
                part = b.slice(lo, 200)
                text, nodes, kept = zip(*_extract(part.column(1).to_pylist(), model), strict=True)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(text, pa.string()), pa.array(nodes, pa.int64()), pa.array(kept, pa.int64())], ["page_id", "main_text", "n_nodes", "n_kept"])

    return run


def extracted(pages: DataFrame, model: Boosted) -> DataFrame:
    """One row for each row of ``pages``: page_id, main_text, n_nodes, n_kept."""
    return pages.select(F.col("page_id").cast("long").alias("page_id"), "html").mapInArrow(_apply(model), "page_id long, main_text string, n_nodes long, n_kept long")


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return extracted(pages, fit(pages, spark.read.parquet(f"{sf_dir}/documents.parquet")))
