"""Operator 9, MinHash near-dedup: chosen-path set similarity join.

Each document is the set of its word 3-grams (lower case; a shorter document is one shingle of all
its words) and has 128 minwise tokens. Equal token sets are one document from there on. Independent trees branch documents by selected tokens: a
node picks ``BRANCH`` of the 128 coordinates by its own hash, and documents that agree with each other in
the token at such a coordinate go to the same child. The first two levels are taken at once, since
unrelated documents seldom agree in two tokens; a node of up to ``NODE_LIMIT`` documents is compared
exhaustively, a larger one branches on. A node of which each coordinate that it picks would keep ``ALIKE`` together (so its documents are alike), or that is ``MAX_DEPTH`` deep, is
compared exhaustively whatever its size, so that no candidate is dropped.

Where a node is worked on, in one task or by Spark in blocks, depends on its size (``TASK_LIMIT``); what it branches into and what is compared do not, so the
groups are the same at any limit.

Recall: a pair of Jaccard similarity J meets in one tree's first two levels with probability
f = 1 - (1 - J(1 - (1-J)^2))^2, so t trees miss it with (1-f)^t; ``trees`` takes the least number that finds a pair at the threshold with
probability ``RECALL`` (before error of the estimate: similarity is the share of equal tokens (128, kept in one byte each, corrected for chance)).
Pairs that are more alike, as copies are, meet far more surely; pairs at the threshold whose nodes branch on meet less often.

Comparison yields a spanning forest of the similar pairs of a node, not all pairs: a member of a growing
component is compared with all documents that are not yet in one. The components are those of all pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .kernel import U64, buffers, chunks, hash_words, mix, words
from .shared import checkpointed, unused, written

SHINGLE = 3
TOKENS = 128
THRESHOLD = 0.5
RECALL, BRANCH = 0.995, 2
NODE_LIMIT = 512
ALIKE = 0.75
#: Nodes up to this many documents are worked on within one task (128 bytes a document), larger ones by Spark.
TASK_LIMIT = 200_000
MAX_DEPTH = 10
#: Up to so many removed doc_ids (8 bytes each) are broadcast to the documents; beyond, Spark sorts both sides.
SMALL = 2_000_000

_RNG = np.random.default_rng(20240917)
_A = _RNG.integers(0, 2**31, TOKENS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_B = _RNG.integers(0, 2**32, TOKENS, dtype=np.uint32)


def trees(threshold: float = THRESHOLD, recall: float = RECALL) -> int:
    """How many trees find a pair at the threshold with probability ``recall`` in their first two levels."""
    if not 0 < recall < 1 or not 0 < threshold <= 1:
        raise ValueError("recall and threshold must be between 0 and 1")
    miss = (1 - threshold * (1 - (1 - threshold) ** BRANCH)) ** BRANCH
    return max(1, math.ceil(math.log(1 - recall) / math.log(miss))) if miss > 1e-12 else 1


def signatures(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """For lower-case texts: minwise tokens (n x 128 uint32), a 128-bit digest of them, and whether the text has words."""
    n = len(offs) - 1
    sig = np.zeros((n, TOKENS), np.uint32)
    s, lens, at = words(buf, offs)
    h, _ = hash_words(buf, s, lens)
    count = np.diff(at)
    grams = np.maximum(count - SHINGLE + 1, (count > 0).astype(np.int64))
    first = np.zeros(n + 1, np.int64)
    np.cumsum(grams, out=first[1:])
    if total := int(first[-1]):
        pos = np.arange(total) - np.repeat(first[:-1], grams) + np.repeat(at[:-1], grams)
        g = h[pos]
        for k in range(1, SHINGLE):
            ok = pos + k < np.repeat(at[1:], grams)
            g = mix(g + np.where(ok, h[np.minimum(pos + k, len(h) - 1)], U64(k)) * U64(2 * k + 1))
        x = (g >> U64(32)).astype(np.uint32)
        full = np.flatnonzero(grams)
        cut, y = first[:-1][full], np.empty_like(x)
        for k in range(TOKENS):
            np.multiply(x, _A[k], out=y)
            np.add(y, _B[k], out=y)
            sig[full, k] = np.minimum.reduceat(y, cut)
    ids = [xxhash.xxh128_digest(row.tobytes()) for row in sig]
    for i in np.flatnonzero(grams == 0):  # no words: equal only to the same text
        ids[i] = xxhash.xxh128_digest(b"\0" + buf[offs[i] : offs[i + 1]].tobytes())
    return sig, ids, grams > 0


def pick(node: np.ndarray, j: int) -> np.ndarray:
    """The j-th coordinate that a node selects; those of one node differ."""
    first = mix(node) % U64(TOKENS)
    return (first + U64(j) * (U64(1) + mix(node + U64(77)) % U64(TOKENS // BRANCH - 1))) % U64(TOKENS)


def child(node: np.ndarray, coord: np.ndarray, token: np.ndarray) -> np.ndarray:
    return mix(mix(node + coord) ^ (token.astype(np.uint64) + U64(0x9E3779B97F4A7C15)))


def paths(sig: np.ndarray, n_trees: int) -> np.ndarray:
    """The nodes of each document after two levels (n x trees * BRANCH * BRANCH)."""
    n, rows, out = len(sig), np.arange(len(sig)), []
    for root in mix(np.arange(n_trees, dtype=np.uint64) + U64(0x5DEECE66D)):
        root = np.full(n, root)
        for i in range(BRANCH):
            c1 = pick(root, i)
            node = child(root, c1, sig[rows, c1.astype(np.int64)])
            for j in range(BRANCH):
                c2 = pick(node, j)
                c2 = np.where(c2 == c1, (c2 + U64(1)) % U64(TOKENS), c2)
                out.append(child(node, c2, sig[rows, c2.astype(np.int64)]))
    return np.stack(out, 1) if out else np.zeros((n, 0), np.uint64)


def _sign(n_trees: int):
    names = ["doc_id", "digest", "sig", "nodes"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 2000):
                part = b.slice(lo, 2000)
                buf, offs = buffers(part.column(1))
                for i, j in chunks(offs):
                    sig, ids, has = signatures(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                    nodes = paths(sig, n_trees).view(np.int64)
                    per = np.where(has, nodes.shape[1], 0)
                    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(per)]).astype(np.int32)), pa.array(nodes[has].ravel()))
                    low = np.ascontiguousarray(sig.astype(np.uint8))
                    sigs = pa.Array.from_buffers(pa.binary(), len(low), [None, pa.py_buffer((np.arange(len(low) + 1) * TOKENS).astype(np.int32)), pa.py_buffer(low)])
                    yield pa.RecordBatch.from_arrays([part.column(0).slice(i, j - i), pa.array(ids, pa.binary()), sigs, lists], names)

    return run


def need(threshold: float) -> int:
    """Equal bytes of 128 that stand for a similarity of at least ``threshold``."""
    return int(np.ceil(TOKENS * (threshold + (1 - threshold) / 256) - 1e-9))


def forest(sig: np.ndarray, least: int) -> np.ndarray:
    """Edges (row, row) of similar pairs that span the components of all similar pairs, by exhaustive comparison."""
    rest, edges = np.arange(len(sig)), []
    while len(rest):
        queue, rest = [int(rest[0])], rest[1:]
        left = sig[rest]
        while queue and len(rest):
            q = queue.pop()
            hit = np.count_nonzero(left == sig[q], axis=1) >= least
            if hit.any():
                edges.append(np.stack([np.full(int(hit.sum()), q), rest[hit]], 1))
                queue.extend(rest[hit].tolist())
                rest, left = rest[~hit], left[~hit]
    return np.concatenate(edges) if edges else np.zeros((0, 2), np.int64)


def branched(sig: np.ndarray, node: int, least: int, depth: int, limit: int, out: list[np.ndarray], at: np.ndarray) -> None:
    """Appends edges (row, row) that span the similar pairs that meet in this node's subtree."""
    if len(at) > limit and depth < MAX_DEPTH:
        me, kids, alike = np.array([node], np.uint64), [], True
        for j in range(BRANCH):
            c = int(pick(me, j)[0])
            value = sig[at, c]
            order = np.argsort(value, kind="stable")
            parts = [p for p in np.split(order, np.flatnonzero(np.diff(value[order])) + 1) if len(p) > 1]
            alike &= any(len(p) >= ALIKE * len(at) for p in parts)
            kids += [(int(child(me, np.array([c], np.uint64), value[p[:1]])[0]), p) for p in parts]
        if not alike:
            for kid, part in kids:
                branched(sig, kid, least, depth + 1, limit, out, at[part])
            return
    out.append(at[forest(sig[at], least)])


def _compare(threshold: float, limit: int, whole: bool = False):
    """Rows (node, depth, id, sig) sorted by node to edges; ``whole``: nodes don't branch."""
    least = need(threshold)

    def node_edges(node: np.ndarray, depth: np.ndarray, ids: np.ndarray, sig: np.ndarray) -> list[np.ndarray]:
        cut = np.flatnonzero(np.diff(node)) + 1
        start, stop = np.concatenate([[0], cut]), np.concatenate([cut, [len(node)]])
        two = stop - start == 2
        a = start[two]
        same = np.count_nonzero(sig[a] == sig[a + 1], axis=1) >= least
        edges = [np.stack([ids[a[same]], ids[a[same] + 1]], 1)]
        for lo, hi in zip(start[~two].tolist(), stop[~two].tolist(), strict=True):
            if hi - lo > 1:
                found: list[np.ndarray] = []
                branched(sig, int(np.uint64(node[lo])), least, MAX_DEPTH if whole else int(depth[lo]), limit, found, np.arange(lo, hi))
                edges += [ids[e] for e in found]
        return edges

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple[np.ndarray, ...]] = []
        held = 0

        def flush(final: bool):
            nonlocal kept, held
            cols = [np.concatenate(x) for x in zip(*kept, strict=True)]
            node = cols[0]
            end = len(node) if final else int(np.searchsorted(node, node[-1], "left"))
            kept = [] if final else [tuple(c[end:] for c in cols)]
            held = len(node) - end
            if end:
                e = np.concatenate(node_edges(*(c[:end] for c in cols)))
                e = np.unique(np.sort(e, axis=1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(e[:, 0]), pa.array(e[:, 1])], ["a", "b"])

        for b in batches:
            if not b.num_rows:
                continue
            raw, _ = buffers(b.column(3))
            kept.append((*(b.column(k).to_numpy(zero_copy_only=False) for k in range(3)), raw.reshape(-1, TOKENS)))
            held += b.num_rows
            if held >= 20_000 and kept[0][0][0] != kept[-1][0][-1]:
                yield from flush(False)
        if kept:
            yield from flush(True)

    return run


def _branch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spark's side of branching: rows (node, depth, id, sig) to (node, depth, j, kid, id) for each coordinate that the node picks."""
    for b in batches:
        raw, _ = buffers(b.column(3))
        sig, node = raw.reshape(-1, TOKENS), b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        for j in range(BRANCH):
            c = pick(node, j)
            kid = child(node, c, sig[np.arange(len(sig)), c.astype(np.int64)])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.full(len(sig), j, np.int32)), pa.array(kid.view(np.int64)), b.column(2)], ["node", "depth", "j", "kid", "id"])


def _like_leads(threshold: float):
    """Rows (node, id, sig, lead, lead_sig) to (node, id, lead, like)."""
    least = need(threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own, lead = (buffers(b.column(k))[0].reshape(-1, TOKENS) for k in (2, 4))
            like = np.count_nonzero(own == lead, axis=1) >= least
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(3), pa.array(like)], ["node", "id", "lead", "like"])

    return run


def _sized(rows: DataFrame, merge: bool = False) -> DataFrame:
    """(node, depth, n, id) of nodes of two or more documents, with their size n; ``merge``: of nodes with the same members one stays."""
    h = F.xxhash64("id")
    sizes = rows.groupBy("node").agg(F.count("*").alias("n"), F.bit_xor(h).alias("x"), F.sum(F.shiftright(h, 16)).alias("s")).where("n > 1")
    if merge:
        sizes = sizes.groupBy("n", "x", "s").agg(F.min("node").alias("node"))
    return rows.join(sizes.select("node", "n"), "node").select("node", "depth", "n", "id")


def _exhaustive(rows: DataFrame, sig: DataFrame, threshold: float, block: int) -> DataFrame:
    """Edges that span the similar pairs of nodes too large for a task: (node, n, id) rows.

    Every member is compared with one lead. Members like it are linked to it; what is left is compared with all, in blocks: two members that are both like the lead are connected
    by it, so they need not meet.
    """
    lead = rows.groupBy("node").agg(F.min_by("id", F.xxhash64("id", "node")).alias("lead"))
    leads = lead.join(sig.select(F.col("id").alias("lead"), F.col("sig").alias("lead_sig")), "lead")
    met = rows.join(sig, "id").join(leads, "node").select("node", "id", "sig", "lead", "lead_sig")
    told = written(met.mapInArrow(_like_leads(threshold), "node long, id long, lead long, like boolean"), "leads")
    edges = told.where("like and id <> lead").select(F.least("id", "lead").alias("a"), F.greatest("id", "lead").alias("b"))
    half = max(1, block // 2)
    sizes = told.groupBy("node").agg(*[F.ceil(F.sum(F.when(c, 1).otherwise(0)) / half).cast("long").alias(k) for k, c in (("ka", F.col("like")), ("kb", ~F.col("like")))])
    own = told.join(sizes, "node").where("kb > 0")
    part = F.when(F.col("like"), F.pmod(F.xxhash64("id", F.lit(3)), F.col("ka"))).otherwise(F.col("ka") + F.pmod(F.xxhash64("id", F.lit(3)), F.col("kb")))
    from_ = F.when(F.col("like"), F.col("ka")).otherwise(F.lit(0).cast("long"))
    own = own.withColumn("part", part).withColumn("other", F.explode(F.sequence(from_, F.col("ka") + F.col("kb") - 1)))
    own = own.select(F.xxhash64("node", F.least("part", "other"), F.greatest("part", "other")).alias("node"), F.lit(MAX_DEPTH).alias("depth"), "id")
    return edges.union(_edges(own, sig, threshold, 0, whole=True))


def connected(edges: DataFrame) -> DataFrame:
    """Alternating large-star and small-star: (doc_id, group_id), group_id the least of the component; without single documents."""
    e = checkpointed(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        both = e.union(e.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        e = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = e.groupBy("a").agg(F.min("b").alias("m"))
        star = e.join(least, "a")
        e = star.select(F.col("b").alias("a"), F.col("m").alias("b")).union(star.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        e = checkpointed(e)
        now = tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.shiftright(F.xxhash64("b", "a"), 20))).first())
        if now == before:
            return e.select(F.col("a").alias("doc_id"), F.col("b").alias("group_id"))
        before = now


def _signed(docs: DataFrame, n_trees: int) -> DataFrame:
    told = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lower("text").alias("text")).where("doc_id is not null")
    return written(told.mapInArrow(_sign(n_trees), "doc_id long, digest binary, sig binary, nodes array<long>"), "signatures")


def links(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, node_limit: int = NODE_LIMIT, task_limit: int = TASK_LIMIT) -> tuple[DataFrame, DataFrame]:
    """(a, b) edges of doc_ids that span all groups, each once, and the signatures of the rows.

    Documents of equal tokens are linked to the least of them, which stands for them in the trees.
    """
    signed = _signed(docs, trees(threshold, recall))
    same = signed.groupBy("digest").agg(F.min("doc_id").alias("id"), F.first("sig").alias("sig"), F.first("nodes").alias("nodes"))
    same = written(same, "distinct-signatures")
    # a document may have several texts, so the trees know texts by a hash of their tokens; under six billion different texts two with one hash are less likely than not
    key = F.xxhash64("digest").alias("id")
    sig = same.select(key, "sig")
    names = same.select(key, F.col("id").alias("doc_id"))
    rows = checkpointed(_sized(same.select(F.explode("nodes").alias("node"), F.lit(2).alias("depth"), key), merge=True))
    found = []
    while True:
        found.append(_edges(rows.where(F.col("n") <= task_limit), sig, threshold, node_limit))
        rows = rows.where(F.col("n") > task_limit)
        if rows.isEmpty():
            break
        kids = rows.join(sig, "id").select("node", "depth", "id", "sig").mapInArrow(_branch, "node long, depth int, j int, kid long, id long")
        kids = written(kids, "children")
        most = kids.groupBy("node", "depth", "j", "kid").agg(F.count("*").alias("c")).groupBy("node", "depth", "j").agg(F.max("c").alias("c")).groupBy("node", "depth").agg(F.min("c").alias("c"))
        alike = rows.select("node", "n").distinct().join(most, "node").where((F.col("c") >= ALIKE * F.col("n")) | (F.col("depth") >= MAX_DEPTH) | (F.col("n") <= node_limit)).select("node")
        found.append(_exhaustive(rows.join(alike, "node", "left_semi").select("node", "id"), sig, threshold, task_limit))
        rows = checkpointed(_sized(kids.join(alike, "node", "left_anti").select(F.col("kid").alias("node"), (F.col("depth") + 1).alias("depth"), "id")))
    edges = reduce(DataFrame.union, found)
    for side in "ab":
        edges = edges.join(names.select(F.col("id").alias(side), F.col("doc_id").alias(f"{side}_doc")), side)
    edges = edges.select(F.least("a_doc", "b_doc").alias("a"), F.greatest("a_doc", "b_doc").alias("b"))
    copies = signed.select("digest", F.col("doc_id").alias("b")).join(same.select("digest", F.col("id").alias("a")), "digest").select("a", "b")
    return checkpointed(edges.union(copies).where("a <> b").distinct()), signed


def _edges(rows: DataFrame, sig: DataFrame, threshold: float, node_limit: int, whole: bool = False) -> DataFrame:
    met = rows.select("node", "depth", "id").join(sig, "id").select("node", "depth", "id", "sig")
    return met.repartition("node").sortWithinPartitions("node", "id").mapInArrow(_compare(threshold, node_limit, whole), "a long, b long").distinct()


def groups(docs: DataFrame, threshold: float = THRESHOLD, **how) -> DataFrame:
    """(doc_id, group_id) of the documents that have near duplicates but the least of each group; group_id is the least doc_id of the group.

    Null texts are as empty ones; texts without words are copies only of the same text. Rows without a
    doc_id are in no group; a doc_id has to be an integer. Rows that repeat a doc_id count as one document, that belongs to the groups of all
    its texts. Other columns are not read. An empty table gives an empty result.
    """
    return connected(links(docs, threshold, **how)[0])


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, **how) -> DataFrame:
    """One row for each doc_id: doc_id, group_id (the least doc_id of its group, its own if it has no duplicate), kept, n_links.

    n_links counts the document's links in the forest that spans the groups: at least one for each that has a duplicate, and one for each copy of a text to the least of its
    doc_ids. Rows without a doc_id give none; see ``groups`` for the other cases.
    """
    edges, signed = links(docs, threshold, **how)
    ids = signed.select("doc_id").distinct()
    n = edges.select(F.explode(F.array("a", "b")).alias("doc_id")).groupBy("doc_id").agg(F.count("*").alias("n_links"))
    out = ids.join(connected(edges), "doc_id", "left").join(n, "doc_id", "left").select("doc_id", F.coalesce("group_id", "doc_id").alias("group_id"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))
    return out.withColumn("kept", F.col("doc_id") == F.col("group_id"))


def deduplicated(docs: DataFrame, threshold: float = THRESHOLD, **how) -> DataFrame:
    """The rows of ``docs`` whose doc_id represents its group, one row for each doc_id; all columns stay.

    Rows without a doc_id stay as they are. Of rows that repeat a doc_id the one of least text stays, and of those the one that sorts first as JSON.
    """
    edges, signed = links(docs, threshold, **how)
    gone = connected(edges).select(F.col("doc_id").alias(own := unused(docs, "_gone")))
    n = gone.count()
    left = docs.join(F.broadcast(gone) if n <= SMALL else gone, F.col("doc_id").cast("long") == F.col(own), "left_anti")
    again = checkpointed(signed.groupBy("doc_id").count().where(F.col("count") > 1).select(F.col("doc_id").alias(twice := unused(docs, "_again"))))
    if not (n := again.count()):
        return left
    again = F.broadcast(again) if n <= SMALL else again
    same = F.col("doc_id").cast("long") == F.col(twice)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    # rows of one doc_id are reduced where they are read, so one that repeats without end is a row a task
    first = left.join(again, same, "left_semi").groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.min_by(row, F.struct("text", F.to_json(row))).alias("row"))
    return left.join(again, same, "left_anti").unionByName(first.select(F.inline(F.array("row"))))


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
