"""Character and word statistics, dictionaries and priors of a corpus (column ``text``)."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellumflow.functions import text as T

#: Bytes of text that a step over Arrow batches takes at once.
AT_ONCE = 1 << 20
#: The mass kept for unknown words, as a natural logarithm.
UNKNOWN = -5.0
ALPHA, BETA, GAMMA, LAMBDA, OOV_COST = 0.25, 1.0, 0.5, 0.5, 22.0


def _pieces(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.Array]:
    """The texts of the first column, about ``AT_ONCE`` bytes at a time; a longer one is taken alone."""
    for part in parts:
        texts = part.column(0).drop_null()
        ends, a = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)), 0
        while a < len(texts):
            b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + AT_ONCE, "right")))
            yield texts[a:b]
            a = b


def char_stat(docs: DataFrame) -> DataFrame:
    """ch, codepoint, cnt. Each part of the texts is counted as bytes, of which those beyond ASCII are decoded."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(0x110000, np.int64)
        for piece in _pieces(parts):
            raw = np.frombuffer("".join(piece.to_pylist()).encode(), np.uint8)
            n[:128] += np.bincount(raw, minlength=256)[:128]
            beyond = raw[raw >= 128].tobytes().decode().encode("utf-32-le")
            if beyond:
                ch, cnt = np.unique(np.frombuffer(beyond, "<u4"), return_counts=True)
                n[ch] += cnt
        found = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(map(chr, found.tolist()), pa.string()), pa.array(n[found])], names=["ch", "cnt"])

    ch = docs.select(F.col("text").cast("string")).mapInArrow(run, "ch string, cnt long")
    return ch.groupBy("ch").agg(F.sum("cnt").alias("cnt")).select("ch", F.ascii("ch").alias("codepoint"), "cnt")


def char_stat_lines(stat: DataFrame) -> DataFrame:
    """``c | \\uXXXX | n``, most frequent first."""
    code = F.lpad(F.hex("codepoint"), 4, "0")
    return stat.orderBy(F.desc("cnt"), "ch").select(F.concat(F.col("ch"), F.lit(" | \\u"), code, F.lit(" | "), F.col("cnt").cast("string")).alias("value"))


def dictionary(docs: DataFrame, tokens: Column | None = None, keys: tuple[str, ...] = ()) -> DataFrame:
    """term, cnt: how often each word occurs (by ``keys``)."""
    own = T.words(F.col("text")) if tokens is None else tokens
    return docs.select(*keys, F.explode(own).alias("term")).groupBy(*keys, "term").agg(F.count("*").alias("cnt"))


def merged_dictionaries(parts: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """The sum of partial dictionaries."""
    return parts.groupBy(*keys, "term").agg(F.sum("cnt").alias("cnt"))


def top_terms(words: DataFrame, n: int) -> DataFrame:
    """The n most frequent terms; of equal ones those that sort first. A negative n keeps all."""
    return words if n < 0 else words.orderBy(F.desc("cnt"), "term").limit(n)


def with_share(words: DataFrame) -> DataFrame:
    """Each term's share p of all occurrences; the total is one row, whatever the dictionary's size."""
    total = words.agg(F.sum("cnt").alias("_total"))
    return words.crossJoin(F.broadcast(total)).withColumn("p", F.col("cnt") / F.col("_total")).drop("_total")


def unigram_logprob(words: DataFrame) -> DataFrame:
    """term, log10_p: discounted for unknown words, with ``<unk>``."""
    known = with_share(words).select("term", F.round(F.log10("p") + math.log10(1 - math.exp(UNKNOWN)), 6).alias("log10_p"))
    unknown = words.sparkSession.createDataFrame([("<unk>", round(UNKNOWN / math.log(10), 6))], known.schema)
    return known.union(unknown)


def char_costs(words: DataFrame) -> DataFrame:
    """ch, cost: minus the log of each character's share of the words' mass; ``<default>`` has the greatest cost."""
    mass = with_share(words).select(F.explode(T.chars(F.col("term"))).alias("ch"), "p").groupBy("ch").agg(F.sum("p").alias("m"))
    total = mass.agg(F.sum("m").alias("_t"))
    cost = mass.crossJoin(F.broadcast(total)).select("ch", (-F.ln(F.col("m") / F.col("_t"))).alias("cost"))
    return cost.union(cost.agg(F.max("cost").alias("cost")).select(F.lit("<default>").alias("ch"), "cost"))


def length_costs(words: DataFrame, mode: str = "reference") -> DataFrame:
    """len, cost for lengths from 0 to the longest word.

    The share of each length, empty lengths taking the least share there is, is normalised. ``reference`` adds the raw mass to
    that a second time, as the original formula does; ``neglog`` takes minus its logarithm.
    """
    if mode not in ("reference", "neglog"):
        raise ValueError(f"no such mode: {mode}")
    mass = with_share(words).groupBy(F.length("term").alias("len")).agg(F.sum("p").alias("raw"))
    most = mass.agg(F.max("len").alias("most"), F.min("raw").alias("least"))
    every = most.select(F.explode(F.sequence(F.lit(0), F.col("most"))).alias("len"), "least")
    filled = every.join(mass, "len", "left").select("len", F.coalesce("raw", F.lit(0.0)).alias("raw"), F.coalesce("raw", "least").alias("v"))
    total = filled.agg(F.sum("v").alias("_t"))
    norm = filled.crossJoin(F.broadcast(total)).withColumn("norm", F.col("v") / F.col("_t"))
    return norm.select("len", (F.col("norm") + F.col("raw") if mode == "reference" else -F.ln("norm")).alias("cost"))


def prior(words: DataFrame, source: DataFrame) -> DataFrame:
    """term, prior: the cost of each word of ``words`` under the character and length costs of the dictionary ``source``."""
    chars = char_costs(source)
    default = chars.where("ch = '<default>'").select(F.col("cost").alias("_default"))
    lens = length_costs(source, "neglog").select("len", F.col("cost").alias("_len_cost"))
    none = lens.where("len = 0").select(F.col("_len_cost").alias("_zero"))
    split = words.select("term", F.length("term").alias("len"), F.explode(T.chars(F.col("term"))).alias("ch"))
    by_char = split.join(chars.where("ch <> '<default>'"), "ch", "left").crossJoin(F.broadcast(default))
    summed = by_char.groupBy("term", "len").agg(F.sum(ALPHA * F.coalesce("cost", "_default") + BETA).alias("_chars"))
    both = summed.join(lens, "len", "left").crossJoin(F.broadcast(none))
    return both.select("term", (GAMMA * F.coalesce("_len_cost", "_zero") + F.col("_chars")).alias("prior"))


def lm_scores(words: DataFrame, test: DataFrame, source: DataFrame) -> DataFrame:
    """term, score of the words: posterior from ``words``, test prior from the dictionary ``test`` (unknown: a fixed cost), training prior from ``source``."""
    post = with_share(words).select("term", (-F.ln("p")).alias("post"))
    known = with_share(test).select("term", (-F.ln("p")).alias("known"))
    both = post.join(known, "term", "left").join(prior(words.select("term"), source), "term")
    return both.select("term", (LAMBDA * F.col("post") + (1 - LAMBDA) * (F.coalesce("known", F.lit(OOV_COST)) - F.col("prior"))).alias("score"))


def unknown_terms(words: DataFrame, known: DataFrame) -> DataFrame:
    """The words that another dictionary lacks, with their share."""
    return with_share(words).join(known.select("term"), "term", "left_anti")


def unknown_mass(words: DataFrame, known: DataFrame) -> DataFrame:
    return unknown_terms(words, known).agg(F.coalesce(F.sum("p"), F.lit(0.0)).alias("oov_mass"), F.count("*").alias("n_terms"))


def _line_grams(text: str, n: int) -> tuple[list[str], np.ndarray]:
    """The different grams of n characters of a text's filled lines, each between ``@``, and how often they occur."""
    ch = np.frombuffer(text.encode("utf-32-le"), "<u4")
    if not len(ch):
        return [], np.zeros(0, np.int64)
    end = ch == 10
    line = np.append(0, np.repeat(np.cumsum(end), np.where(end, 2, 1)))
    ch = np.concatenate([[64], np.repeat(np.where(end, 64, ch), np.where(end, 2, 1)), [64]]).astype("<u4")
    ends = np.flatnonzero(end) + np.arange(np.count_nonzero(end)) + 1
    line[ends] -= 1  # of the two signs for a line feed the first ends a line
    line = np.append(line, line[-1])
    first = np.flatnonzero((line[: len(line) - n + 1] == line[n - 1 :]) & (np.bincount(line) > 2)[line[: len(line) - n + 1]]) if len(ch) >= n else np.zeros(0, np.int64)
    if not len(first):
        return [], np.zeros(0, np.int64)
    place = np.zeros(int(ch.max()) + 1, np.int64)
    place[ch] = 1
    size = int(place.sum())
    place[place > 0] = np.arange(size)
    place, code, most = place[ch], np.zeros(len(first), np.int64), 1
    for k in range(n):
        if most * size >= 1 << 62:
            code = np.unique(code, return_inverse=True)[1]
            most = int(code.max()) + 1
        code, most = code * size + place[first + k], most * size
    if most <= 1 << 22:
        cnt, at = np.bincount(code, minlength=most), np.zeros(most, np.int64)
        at[code] = first
        at, cnt = at[cnt > 0], cnt[cnt > 0]
    else:
        _, at, cnt = np.unique(code, return_index=True, return_counts=True)
        at = first[at]
    grams = ch[at[:, None] + np.arange(n)].astype("<u4").tobytes().decode("utf-32-le")
    return [grams[k : k + n] for k in range(0, len(grams), n)], cnt


def char_ngrams(docs: DataFrame, n: int) -> DataFrame:
    """gram, cnt of n characters of each line, ``@`` before and after it. Each part of the texts is counted as an array of characters."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in _pieces(parts):
            grams, cnt = _line_grams("\n".join(piece.to_pylist()), n)
            yield pa.RecordBatch.from_arrays([pa.array(grams, pa.string()), pa.array(cnt, pa.int64())], names=["gram", "cnt"])

    grams = docs.select(F.col("text").cast("string")).mapInArrow(run, "gram string, cnt long")
    return grams.groupBy("gram").agg(F.sum("cnt").alias("cnt"))


def quantile_index(histogram: DataFrame, keys: tuple[str, ...], q: float) -> DataFrame:
    """For each key the first ``idx`` of a histogram (idx, mass) whose running sum reaches the quantile; of one without mass the middle idx."""
    own = Window.partitionBy(*keys)
    run = own.orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    told = histogram.withColumn("_cum", F.sum("mass").over(run)).withColumn("_sum", F.sum("mass").over(own))
    goal = F.floor(F.col("_sum") * q + 0.5)
    return told.groupBy(*keys).agg(F.when(F.max("_sum") > 0, F.min(F.when(F.col("_cum") >= goal, F.col("idx")))).otherwise(F.floor((F.min("idx") + F.max("idx")) / 2)).cast("long").alias("idx"), F.max("_sum").alias("mass"))


def majority(rows: DataFrame, keys: tuple[str, ...], value: str) -> DataFrame:
    """For each key the commonest value and how often; of equal ones the least."""
    n = rows.groupBy(*keys, value).agg(F.count("*").alias("cnt"))
    first = F.min(F.struct((-F.col("cnt")).alias("c"), F.col(value).alias("v"))).alias("b")
    return n.groupBy(*keys).agg(first).select(*keys, F.col("b.v").alias(value), (-F.col("b.c")).alias("cnt"))


def regression(rows: DataFrame, keys: tuple[str, ...], x: str, y: str) -> DataFrame:
    """slope, intercept; a range of x below two gives an infinite slope and the mean of x."""
    flat = F.max(x) - F.min(x) < 2
    slope, inner = F.regr_slope(y, x), F.regr_intercept(y, x)
    return rows.groupBy(*keys).agg(F.when(flat, F.lit(float("inf"))).otherwise(slope).alias("slope"), F.when(flat, F.avg(x)).otherwise(inner).alias("intercept"))
