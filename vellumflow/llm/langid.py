"""Operator 7, language ID by a byte convolutional network.

A text is cut into windows of ``WINDOW`` bytes, the last one padded with zeros. Filters over 2, 3 and 4 bytes (on one-hot bytes,
so that a filter is a table of weights by byte and position), max pooling over the window and a dense layer with
softmax give each window's log probabilities; a text's are their sum, weighted by the windows' bytes. All windows
of all texts are read. The network is trained in numpy, by Adam with back-propagation through the maxima, on the windows of at most
``ROWS`` labelled documents for each language, those of least hash of doc_id, and on at most ``TRAIN_WINDOWS`` of these. More than ``languages`` labels, ``LANGUAGES``
unless told otherwise, are an error: the sample would have no bound.

Rows with a null label or text don't train; of rows with one doc_id and label the least text does. A doc_id has to be an integer. Null and empty texts, and all texts where nothing is labelled, have language "und" and
confidence 0. Ties go to the language that sorts first. Repeated rows each have their result. Other columns are not
read. An empty table gives an empty result.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .kernel import buffers, chunks
from .shared import checkpointed, fitted, written

WINDOW = 512
WIDTHS = (2, 3, 4)
FILTERS = 8
ROWS, LANGUAGES = 400, 200
TRAIN_WINDOWS = 8_000
EPOCHS, BATCH = 4, 64


def windows(buf: np.ndarray, offs: np.ndarray, size: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The windows (m x size), each one's document and its bytes; empty documents have none."""
    lens = np.diff(offs)
    per = -(-lens // size)
    doc = np.repeat(np.arange(len(lens)), per)
    first = np.cumsum(per) - per
    out = np.zeros(int(per.sum()) * size, np.uint8)
    shift = np.repeat(first * size - offs[:-1], lens)
    out[np.arange(len(buf)) + shift] = buf
    rank = np.arange(len(doc)) - first[doc]
    return out.reshape(-1, size), doc, np.minimum(size, lens[doc] - rank * size)


@dataclass
class Network:
    """tables[i]: the weights of filters of WIDTHS[i] (position, byte, filter); dense: pooled values to languages."""

    languages: list[str]
    tables: list[np.ndarray]
    bias: np.ndarray
    dense: np.ndarray
    out: np.ndarray

    def pairs(self) -> list[list[np.ndarray]]:
        """For each width the tables of two neighbouring bytes at once; made once in a process."""
        if not hasattr(self, "_pairs"):
            self._pairs = [[(t[k][:, None] + t[k + 1][None]).reshape(65536, FILTERS) for k in range(0, w - 1, 2)] for w, t in zip(WIDTHS, self.tables, strict=True)]
        return self._pairs

    def pooled(self, x: np.ndarray, where: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Max-pooled values of windows (m x all filters), and with ``where`` the positions of the maxima."""
        t = np.ascontiguousarray(x.T)
        size, m = t.shape
        best = np.full((len(WIDTHS), m, FILTERS), -np.inf, np.float32)
        at = np.zeros((len(WIDTHS), m, FILTERS), np.int32)
        if where:
            for i, (width, table) in enumerate(zip(WIDTHS, self.tables, strict=True)):
                for p in range(size - width + 1):
                    v = table[0][t[p]]
                    for k in range(1, width):
                        v = v + table[k][t[p + k]]
                    up = v > best[i]
                    best[i][up], at[i][up] = v[up], p
        else:
            two = self.pairs()
            pair = (t[:-1].astype(np.int32) << 8) | t[1:]
            for p in range(size - 1):
                for i, width in enumerate(WIDTHS):
                    if p + width > size:
                        continue
                    v = two[i][0].take(pair[p], axis=0)
                    if width == 3:
                        v += self.tables[i][2].take(t[p + 2], axis=0)
                    elif width == 4:
                        v += two[i][1].take(pair[p + 2], axis=0)
                    np.maximum(best[i], v, out=best[i])
        flat = best.transpose(1, 0, 2).reshape(m, -1) + self.bias
        return flat, at.transpose(1, 0, 2).reshape(m, -1)

    def log_probabilities(self, x: np.ndarray) -> np.ndarray:
        z = np.maximum(self.pooled(x)[0], 0) @ self.dense + self.out
        z = z - z.max(1, keepdims=True)
        return z - np.log(np.exp(z).sum(1, keepdims=True))

    def classify(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each document the number of its language (-1: none) and the confidence."""
        n, k = len(offs) - 1, len(self.languages)
        x, doc, size = windows(buf, offs)
        if not len(doc) or not k:
            return np.full(n, -1), np.zeros(n)
        total = np.zeros((n, k))
        for lo in range(0, len(doc), 2048):
            lp = self.log_probabilities(x[lo : lo + 2048]) * size[lo : lo + 2048, None]
            np.add.at(total, doc[lo : lo + 2048], lp)
        mean = total / np.maximum(np.diff(offs), 1)[:, None]
        p = np.exp(mean - mean.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        some = np.diff(offs) > 0
        return np.where(some, p.argmax(1), -1), np.where(some, p.max(1), 0.0)


def train(x: np.ndarray, y: np.ndarray, languages: list[str], seed: int = 7) -> Network:
    """Fits a network to windows ``x`` with language numbers ``y``; short windows are cut from some of them."""
    rng = np.random.default_rng(seed)
    total = FILTERS * len(WIDTHS)
    net = Network(languages, [rng.normal(0, 0.3, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS], np.zeros(total, np.float32), rng.normal(0, 0.3, (total, len(languages))).astype(np.float32), np.zeros(len(languages), np.float32))
    if not len(x) or not languages:
        return net
    params = [*net.tables, net.bias, net.dense, net.out]
    m, v, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(EPOCHS):
        for own in np.array_split(rng.permutation(len(x)), max(1, len(x) // BATCH)):
            xb = x[own].copy()
            cut = rng.integers(16, WINDOW, len(own))  # half of the windows are shortened, as short texts are
            cut[rng.random(len(own)) < 0.5] = WINDOW
            xb[np.arange(WINDOW)[None] >= cut[:, None]] = 0
            keep = max(int(np.flatnonzero(xb.any(0)).max(initial=0)) + 2, 8)
            xb = xb[:, : min(WINDOW, keep)]
            h, at = net.pooled(xb, where=True)
            a = np.maximum(h, 0)
            z = a @ net.dense + net.out
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(own)), y[own]] -= 1
            p /= len(own)
            d = (p @ net.dense.T) * (h > 0)
            grads = []
            for i, width in enumerate(WIDTHS):
                g, mine, pos = np.zeros_like(net.tables[i]), d[:, i * FILTERS : (i + 1) * FILTERS], at[:, i * FILTERS : (i + 1) * FILTERS]
                for k in range(width):
                    np.add.at(g[k], (xb[np.arange(len(own))[:, None], pos + k], np.arange(FILTERS)[None]), mine)
                grads.append(g)
            grads += [d.sum(0), a.T @ p, p.sum(0)]
            t += 1
            for q, (param, g) in enumerate(zip(params, grads, strict=True)):
                m[q] = 0.9 * m[q] + 0.1 * g
                v[q] = 0.999 * v[q] + 0.001 * g * g
                param -= (0.01 * (m[q] / (1 - 0.9**t)) / (np.sqrt(v[q] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
    return net


def _fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = [b for b in batches if b.num_rows]
    if rows:
        table = pa.Table.from_batches(rows).sort_by([("doc_id", "ascending"), ("text", "ascending")])
        label = table.column("lang").to_pylist()
        languages = sorted(set(label))
        buf, offs = buffers(table.column("text"))
        x, doc, _ = windows(buf, offs)
        y = np.array([languages.index(v) for v in label])[doc] if len(doc) else np.zeros(0, int)
        own = np.sort(np.random.default_rng(3).permutation(len(x))[:TRAIN_WINDOWS])
        net = train(x[own], y[own], languages)
    else:
        net = train(np.zeros((0, WINDOW), np.uint8), np.zeros(0, int), [])
    yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(net)], pa.binary())], ["model"])


def fit(docs: DataFrame, rows: int = ROWS, languages: int = LANGUAGES) -> Network:
    """Trains on a bounded sample of the labelled documents, in one task."""
    known = docs.select(F.col("doc_id").cast("long").alias("_id"), F.col("lang").cast("string").alias("_lang")).where("_id is not null and _lang is not null")
    order = Window.partitionBy("_lang").orderBy(F.xxhash64("_id"), "_id")
    picked = known.distinct().withColumn("k", F.row_number().over(order)).where(F.col("k") <= rows).select("_id", "_lang").orderBy("_lang", "_id")
    picked = checkpointed(picked.limit(rows * languages + 1))
    if (n := picked.select("_lang").distinct().count()) > languages:
        raise ValueError(f"{n} or more languages, but the bound is {languages}")
    # at most rows x languages rows of two short values
    both = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), "text").where("text is not null")
    met = both.join(F.broadcast(picked), (F.col("doc_id") == F.col("_id")) & (F.col("lang") == F.col("_lang"))).groupBy("doc_id", "lang").agg(F.min("text").alias("text"))
    return fitted(written(met, "langid-sample"), _fit)


def _apply(net: Network):
    names = np.array([*net.languages, "und"], object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            buf, offs = buffers(b.column(1))
            for i, j in chunks(offs, 1 << 20):
                which, p = net.classify(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(names[which], pa.string()), pa.array(p)], ["doc_id", "language", "confidence"])

    return run


def identified(docs: DataFrame, net: Network) -> DataFrame:
    """One row for each row of ``docs``: doc_id, language, confidence."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_apply(net), "doc_id long, language string, confidence double")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return identified(docs, fit(docs))
