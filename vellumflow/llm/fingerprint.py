"""Operator 3, document fingerprints: quartile bucket digests and a bounded difference score.

Every window of five bytes of the UTF-8 text gives six triplets; each is hashed to one of 128 buckets and counted. The digest
has, for each bucket, which quartile of the counts it is in (two bits), and a header of a length code and two
ratios of the quartiles. The difference of two digests adds up: by bucket 1, 2 or 6 for one, two or three quartiles apart; for the
length code and the ratios their distance, 12 for each step beyond the first.

Two digests are near at a difference of at most the limit for the greater of their length codes (``LIMITS``): the scores of copies with
5% of their words changed fall with the length, those of unrelated texts of one language too. The search is exact: it compares each two digests, but for
those whose headers alone are too far apart. Most of them end at ``FIRST`` bits, of those that say whether a bucket's quartile is at least 1, 2 or 3: the difference is at least
the number of such bits that differ. The digests in the order of their headers are cut into ``BLOCKS`` blocks (more where one would exceed ``BLOCK``, fewer for small tables), and those blocks meet that
have headers close enough, each two in one task, which gives counts and a spanning forest, never its pairs.

Each row of the result has its digest, the least doc_id with this digest (copies are not compared with each other), and the digest's class (connected by
near pairs), its number of links (other digests that are near), the nearest of them, and how many different texts the row's text is linked with, those of its own digest too.
Every link counts, also where texts share a doc_id.

Texts of under ``LEAST`` bytes, null and empty ones have no digest (null). Repeated rows each have theirs. Rows without
a doc_id are fingerprinted but not compared; a doc_id has to be an integer. Other columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .kernel import buffers, chunks
from .neardup import connected
from .shared import written

BUCKETS = 128
LEAST = 50
#: Length code up to which, and largest difference of near copies.
LIMITS = ((25, 38), (28, 34), (31, 28), (34, 21), (255, 16))
BODY = BUCKETS // 4
SIZE = BODY + 3
#: Blocks that the digests are cut into, least and most digests of a block.
BLOCKS, FEW, BLOCK = 32, 1024, 500_000
#: Bits compared first (two words), digests compared with others at once, pairs at once, rows made into bits at once.
FIRST, COLUMNS, PAIRS, PART = 128, 8192, 1 << 17, 1 << 15

_RNG = np.random.default_rng(1957)
_PERM = _RNG.permutation(256).astype(np.uint8)
_TRIPLETS = ((2, 1, 2), (3, 1, 3), (5, 2, 3), (7, 2, 4), (11, 1, 4), (13, 3, 4))
_PAIR = [_PERM[_PERM[_PERM[salt] ^ np.arange(256, dtype=np.uint8)][:, None] ^ np.arange(256, dtype=np.uint8)[None, :]].ravel() for salt, _, _ in _TRIPLETS]
_LAST = _PERM & np.uint8(BUCKETS - 1)
_CODES = (np.arange(256)[:, None] >> np.array([6, 4, 2, 0])) & 3
_STEP = np.array([0, 1, 2, 6])
_LIMIT = np.repeat([x[1] for x in LIMITS], np.diff([-1, *(x[0] for x in LIMITS)]))
#: The difference of two bytes of four codes.
_DIFF = _STEP[np.abs(_CODES[:, None] - _CODES[None])].sum(2).astype(np.uint8).ravel()


def counts(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """The bucket counts of each document (n x 128)."""
    n, m = len(offs) - 1, len(buf) - 4
    if m <= 0:
        return np.zeros((n, BUCKETS), np.int64)
    lens = np.diff(offs)
    base = np.repeat(np.arange(n, dtype=np.int64) * BUCKETS, lens)[:m]
    ends = np.repeat(offs[1:], lens)[:m]
    base[np.arange(4, m + 4) >= ends] = n * BUCKETS
    first = buf[:m].astype(np.uint16) << 8
    out = np.zeros((n + 1) * BUCKETS, np.int64)
    for pair, (_, b, c) in zip(_PAIR, _TRIPLETS, strict=True):
        at = pair[first | buf[b : b + m]]
        out += np.bincount(base + _LAST[at ^ buf[c : c + m]], minlength=len(out))
    return out.reshape(n + 1, BUCKETS)[:n]


def encode(count: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The digests (n x 35 bytes): length code, the ratios of the first and the second to the third quartile, body."""
    ranked = np.sort(count, axis=1)
    q1, q2, q3 = (ranked[:, BUCKETS * k // 4 - 1] for k in (1, 2, 3))
    code = ((count > q1[:, None]).astype(np.uint8) + (count > q2[:, None]) + (count > q3[:, None])).reshape(len(count), BODY, 4)
    out = np.zeros((len(count), SIZE), np.uint8)
    out[:, 0] = np.floor(np.log(np.maximum(lens, 1)) / np.log(1.3))
    out[:, 1], out[:, 2] = (np.where(q3 > 0, q * 15 // np.maximum(q3, 1), 0) for q in (q1, q2))
    out[:, 3:] = (code[..., 0] << 6) | (code[..., 1] << 4) | (code[..., 2] << 2) | code[..., 3]
    return out


def difference(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The difference scores of digests, row by row (broadcasting)."""
    a, b = a.astype(np.int64), b.astype(np.int64)
    return _DIFF[a[..., 3:] * 256 + b[..., 3:]].sum(-1, dtype=np.int64) + _apart(a[..., :3], b[..., :3])


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """What headers (of a signed type) add to the difference."""
    head = np.abs(a - b)
    return np.where(head <= 1, head, (head - 1) * 12).sum(-1)


def limit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The largest difference at which digests are near, row by row."""
    return _LIMIT[np.maximum(a[..., 0], b[..., 0])]


def bounded(a: bytes | None, b: bytes | None, bound: int | None = None) -> int | None:
    """The difference score of two digests, None beyond the bound (their ``limit``, where none is given) or where one is missing."""
    if a is None or b is None:
        return None
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    d = int(difference(x, y))
    return d if d <= (limit(x, y) if bound is None else bound) else None


def _binary(rows: np.ndarray, valid: np.ndarray) -> pa.Array:
    data = pa.py_buffer(np.ascontiguousarray(rows))
    whole = pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer((np.arange(len(rows) + 1) * SIZE).astype(np.int32)), data])
    return whole if valid.all() else whole.take(pa.array(np.arange(len(rows)), mask=~valid))


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        buf, offs = buffers(b.column(1))
        for i, j in chunks(offs):
            own = offs[i : j + 1] - offs[i]
            lens = np.diff(own)
            yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), _binary(encode(counts(buf[offs[i] : offs[j]], own), lens), lens >= LEAST), b.column(2).slice(i, j - i)], ["doc_id", "digest", "text_id"])


def digests(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs``: doc_id, digest (35 bytes or null), text_id (tells texts of one digest apart)."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_id")).mapInArrow(_digest, "doc_id long, digest binary, text_id long")


def _planes(codes: np.ndarray) -> np.ndarray:
    """Bits (n x 64 k) as k words."""
    return np.packbits(np.ascontiguousarray(codes, bool), axis=1).view(np.uint64)


class _Rows:
    """Digests as bits: of each bucket whether its quartile is at least 1, 2 and 3. ``first`` has three words of the bits that tell most."""

    def __init__(self, rows: np.ndarray) -> None:
        n = len(rows)
        even = np.abs(self._bits(rows[:: n // PART + 1]).mean(0) - 0.5) if n else np.zeros(3 * BUCKETS)
        picked = np.argsort(even)[: FIRST + 64]
        self.bits, self.first = np.empty((6, n), np.uint64), np.empty((3, n), np.uint64)
        for i in range(0, n, PART):
            bits = self._bits(rows[i : i + PART])
            self.bits[:, i : i + PART], self.first[:, i : i + PART] = _planes(bits).T, _planes(bits[:, picked]).T
        self.head = rows[:, :3].astype(np.int16)

    @staticmethod
    def _bits(rows: np.ndarray) -> np.ndarray:
        codes = _CODES[rows[:, 3:]].reshape(-1, BUCKETS)
        return np.concatenate([codes >= k for k in (1, 2, 3)], 1)

    def score(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """``difference`` of rows ``a`` and ``b``."""
        out = _apart(self.head[a], self.head[b]).astype(np.int64)
        for k in (0, 1):
            least, middle, most = (x[a] ^ x[b] for x in self.bits[k::2])
            for x, weight in ((least, 1), (middle, 1), (most, 1), (least & most, 3)):
                out += np.bitwise_count(x).astype(np.int64) * weight
        return out


class _Forest:
    """Classes of rows that grow by links; ``edges`` are those links that joined two classes."""

    def __init__(self, n: int) -> None:
        self.label, self.edges = np.arange(n), []

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            x, y = self.label[a], self.label[b]
            new = x != y
            if not new.any():
                return
            a, b, x, y = a[new], b[new], x[new], y[new]
            high, first = np.unique(np.maximum(x, y), return_index=True)  # each class hangs below one of lower number, so there is no circle
            self.edges.append(np.stack([a[first], b[first]], 1))
            self.label[high] = np.minimum(x, y)[first]
            while not np.array_equal(up := self.label[self.label], self.label):
                self.label = up


def _spanning(edges: np.ndarray) -> np.ndarray:
    """Those of the edges (n x 2) that are enough for their classes."""
    ids, at = np.unique(edges, return_inverse=True)
    forest = _Forest(len(ids))
    forest.add(*at.reshape(-1, 2).T)
    return ids[np.concatenate(forest.edges)]


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of equal values."""
    cut = np.flatnonzero(np.diff(values)) + 1
    return np.concatenate([[0], cut]), np.concatenate([cut, [len(values)]])


def _close(rows: _Rows, blocks: np.ndarray, one: bool, bound: int | None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """All near pairs of rows, both of the only block (``one``) or one of each of two blocks, with their scores; rows in the order of block and header."""
    n, head = len(blocks), rows.head.astype(np.int64)
    starts, ends = _runs(blocks << 24 | head[:, 0] << 16 | head[:, 1] << 8 | head[:, 2])
    split = int(np.searchsorted(blocks, blocks[0], "right"))
    if one:
        split = n
    elif split == n:  # no row fell into the other block
        return
    bits, some = np.empty(PAIRS, np.uint64), np.empty((2, PAIRS), np.uint8)
    for lo, hi in zip(starts.tolist(), ends.tolist(), strict=True):
        if lo >= split:
            break
        cell = np.flatnonzero(starts >= (lo if one else split))
        most = _LIMIT[np.maximum(head[lo, 0], head[starts[cell], 0])] if bound is None else np.full(len(cell), bound)
        room = np.repeat(most - _apart(head[lo], head[starts[cell]]), ends[cell] - starts[cell])
        others = np.flatnonzero(room >= 0)
        room, others = np.minimum(room[others], 255).astype(np.uint8), others + (lo if one else split)
        for left in range(0, len(others), COLUMNS):
            own, rest = others[left : left + COLUMNS], room[left : left + COLUMNS]
            words, side = rows.first[:2, own], max(1, PAIRS // len(own))
            for at in range(lo, hi, side):
                mine = slice(at, min(at + side, hi))
                shape = mine.stop - at, len(own)
                size = shape[0] * shape[1]
                x, (total, more) = bits[:size].reshape(shape), some[:, :size].reshape(2, *shape)
                for k, out in enumerate((total, more)):
                    np.bitwise_count(np.bitwise_xor(rows.first[k, mine, None], words[k], out=x), out=out)
                np.add(total, more, out=total)
                found = np.flatnonzero(total <= rest)
                a, b = np.divmod(found, len(own))
                apart, rest_of, a, b = total.ravel()[found], rest[b], a + at, own[b]
                keep = (apart + np.bitwise_count(rows.first[2, a] ^ rows.first[2, b]) <= rest_of) & (a < b)
                a, b = a[keep], b[keep]
                if len(a):
                    d = rows.score(a, b)
                    hit = d <= (_LIMIT[np.maximum(head[a, 0], head[b, 0])] if bound is None else bound)
                    yield a[hit], b[hit], d[hit]


def _within(bound: int | None):
    """Rows (node, block, doc_id, name, texts, digest) in the order of node, one or two blocks each, to counts (doc_id, name of the nearest, score, n > 0, their texts) of each
    digest's links in these nodes, and edges (doc_id, doc_id, 0, 0, 0) that span the classes of a task."""

    def batch(*cols: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["doc_id", "other", "score", "n", "texts"])

    def of(edges: list[np.ndarray], node: int, blocks: np.ndarray, ids: np.ndarray, names: np.ndarray, texts: np.ndarray, digests_: np.ndarray) -> pa.RecordBatch | None:
        order = np.lexsort((digests_[:, 2], digests_[:, 1], digests_[:, 0], blocks))
        blocks, ids, names, texts = (x[order] for x in (blocks, ids, names, texts))
        n = len(ids)
        rows, forest = _Rows(digests_[order]), _Forest(n)
        named = np.argsort(names, kind="stable")
        rank = np.empty(n, np.int64)
        rank[named] = np.arange(n)
        count, linked, best = np.zeros(n, np.int64), np.zeros(n, np.int64), np.full(n, np.iinfo(np.int64).max)
        held: list[tuple[np.ndarray, ...]] = []

        def settle() -> None:
            a, b, d = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            for x, y in ((a, b), (b, a)):
                count[:] += np.bincount(x, minlength=n)
                linked[:] += np.bincount(x, texts[y], n).astype(np.int64)
                np.minimum.at(best, x, d << 40 | rank[y])
            forest.add(a, b)

        size = 0
        for pairs in _close(rows, blocks, node >> 32 == node & (1 << 32) - 1, bound):
            held.append(pairs)
            size += len(pairs[0])
            if size > max(n, PAIRS):
                settle()
                size = 0
        if held:
            settle()
        who = np.flatnonzero(count)
        if not len(who):
            return None
        edges.append(ids[np.concatenate(forest.edges)])
        return batch(ids[who], names[named[best[who] & (1 << 40) - 1]], best[who] >> 40, count[who], linked[who])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple[np.ndarray, ...]] = []
        edges: list[np.ndarray] = []

        def flush() -> Iterator[pa.RecordBatch]:
            cols = [np.concatenate(x) for x in zip(*kept, strict=True)]
            kept.clear()
            if (out := of(edges, last, *cols)) is not None:
                edges[:] = [_spanning(np.concatenate(edges))]
                yield out

        last = 0
        for b in batches:
            if b.num_rows:
                raw, _ = buffers(b.column(5))
                node, *cols = (b.column(k).to_numpy(zero_copy_only=False) for k in range(5))
                cols.append(raw.reshape(-1, SIZE))
                for i, j in zip(*(x.tolist() for x in _runs(node)), strict=True):
                    if kept and node[i] != last:
                        yield from flush()
                    last = int(node[i])
                    kept.append(tuple(x[i:j] for x in cols))
        if kept:
            yield from flush()
        if edges:
            a, b = edges[0].T
            yield batch(a, b, *np.zeros((3, len(a)), np.int64))

    return run


def _meetings(cells: list[tuple[int, int]], bound: int | None, block: int) -> tuple[int, list[tuple[int, int]], list[tuple[int, int]]]:
    """For headers and how many digests have each, in order: the size of a block, of each header where in the row of all digests it starts, and (block, block) of all that meet."""
    code, n = np.array(cells, np.int64).reshape(-1, 2).T
    start = np.cumsum(n) - n
    size = min(block, max(FEW, -(-int(n.sum()) // BLOCKS)))
    first, last = start // size, (start + n - 1) // size
    head = np.stack([code >> 16, code >> 8 & 255, code & 255], 1)
    met = set()
    for i in range(int(last[-1]) + 1 if len(last) else 0):
        own = head[(first <= i) & (i <= last)]
        most = _LIMIT[np.maximum(own[:, None, 0], head[None, :, 0])] if bound is None else bound
        near = np.flatnonzero((_apart(own[:, None], head[None]) <= most).any(0) & (last >= i))
        met |= {(i, j) for lo, hi in set(zip(first[near].tolist(), last[near].tolist(), strict=True)) for j in range(max(lo, i), hi + 1)}
    return size, list(zip(code.tolist(), start.tolist(), n.tolist(), strict=True)), sorted(met | {(j, i) for i, j in met})


def links(distinct: DataFrame, bound: int | None = None, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """For distinct digests (doc_id, digest): (doc_id, n_links, n_texts, near_id, near_score) of those that have links, and edges (a, b) that span the classes.

    Each digest has a doc_id of its own; a column ``name``, if there is one, gives near_id instead, and of several nearest the least. n_texts adds up what a column ``texts`` says of
    the linked digests, each one without it.
    """
    spark = distinct.sparkSession
    name = F.col("name" if "name" in distinct.columns else "doc_id").alias("name")
    texts = F.col("texts") if "texts" in distinct.columns else F.lit(1).cast("long").alias("texts")
    rows = distinct.select("doc_id", name, texts, "digest", F.conv(F.hex(F.substring("digest", 1, 3)), 16, 10).cast("int").alias("cell"))
    # a header has few values, about ten thousand at most, so what is collected and broadcast is bounded
    size, cells, met = _meetings(sorted(map(tuple, rows.groupBy("cell").count().collect())), bound, block)
    rows = rows.join(F.broadcast(spark.createDataFrame(cells, "cell int, start long, n long")), "cell")
    rows = rows.withColumn("block", F.expr(f"(start + pmod(xxhash64(doc_id, 3), n)) div {size}"))
    rows = rows.join(F.broadcast(spark.createDataFrame(met, "block long, other long")), "block")
    node = F.shiftleft(F.least("block", "other"), 32) + F.greatest("block", "other")
    rows = rows.select(node.alias("node"), "block", "doc_id", "name", "texts", "digest").repartition("node").sortWithinPartitions("node")
    found = written(rows.mapInArrow(_within(bound), "doc_id long, other long, score long, n long, texts long"), "links")
    sums = F.sum("n").alias("n_links"), F.sum("texts").alias("n_texts"), F.min(F.struct("score", "other")).alias("near")
    counts = found.where("n > 0").groupBy("doc_id").agg(*sums).select("doc_id", "n_links", "n_texts", F.col("near.other").alias("near_id"), F.col("near.score").alias("near_score"))
    return counts, found.where("n = 0").select(F.col("doc_id").alias("a"), F.col("other").alias("b"))


def fingerprints(docs: DataFrame, bound: int | None = None, block: int = BLOCK) -> DataFrame:
    """One row for each row of ``docs``: doc_id, digest (hex), copy_of, class_id, n_links, near_id, near_score, n_texts.

    copy_of is the least doc_id with the same digest, class_id the least copy_of of the digests that near pairs connect it with. n_links is how many other digests are
    near; near_id and near_score are the copy_of of the nearest (of several the least) and the difference to it, null where there is none.
    n_texts is how many other texts, each once however many rows have it, are near or have the same digest. All are null without a digest or a doc_id.
    """
    own = written(digests(docs), "digests")
    same = own.where("doc_id is not null and digest is not null").groupBy("digest", "text_id").agg(F.min("doc_id").alias("copy_of"))
    same = same.groupBy("digest").agg(F.min("copy_of").alias("copy_of"), F.count("*").alias("texts"))
    same = written(same.withColumn("id", F.monotonically_increasing_id()), "distinct-digests")  # as a doc_id may have several texts, digests go by numbers of their own
    counts, edges = links(same.select(F.col("id").alias("doc_id"), F.col("copy_of").alias("name"), "texts", "digest"), bound, block)
    groups = connected(edges).withColumnRenamed("doc_id", "id")
    groups = groups.union(groups.select("group_id", "group_id").distinct())
    least = groups.join(same.select("id", "copy_of"), "id").groupBy("group_id").agg(F.min("copy_of").alias("class_id"))
    same = same.join(counts.withColumnRenamed("doc_id", "id"), "id", "left").join(groups.join(least, "group_id"), "id", "left")
    n_links, n_texts = (F.coalesce(c, F.lit(0).cast("long")) for c in ("n_links", "n_texts"))
    same = same.select("digest", "copy_of", F.coalesce("class_id", "copy_of").alias("class_id"), n_links.alias("n_links"), "near_id", "near_score", (n_texts + F.col("texts") - 1).alias("n_texts"))
    known = [F.when(F.col("doc_id").isNotNull(), F.col(c)).alias(c) for c in ("copy_of", "class_id", "n_links", "near_id", "near_score", "n_texts")]
    return own.join(same, "digest", "left").select("doc_id", F.lower(F.hex("digest")).alias("digest"), *known)


def op3_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))
