"""Operator 10, mixing sources to target weights by iterative proportional fitting.

Token weights of the cells (source, language, topic) are raked, each marginal in turn, to its targets: those given in ``targets``, else the present
share of each value to the power of that marginal's temperature, normalised. A document is then sampled if its uniform number, made from the MD5 of
doc_id and seed, is below its cell's weight divided by the largest weight; so the sample's expected tokens have the target marginals.

Raking ends when all marginals are within ``TOLERANCE`` of their targets. Given targets that it does not reach in ``ROUNDS`` rounds (no weights of the cells there are reach them), and
targets for values that have no tokens, are an error; where nothing is given and the tempered shares contradict each other, the last round's weights serve, and a warning says so. Values
for which given targets have no weight are never sampled. If the sample keeps less than ``NOTICE`` of the tokens, because a rare cell has a
large weight, a warning says which.

Tokens are runs of other than white space. The topic is a column or an expression that the caller names, else the one of ``TOPICS`` with most of its stems
at the beginning of words, the first of equal ones, and ``general`` where there is none. Only the table of cells, a row for each combination of source, language and topic,
comes to the driver; more than ``CELLS`` are an error, as they are too many for marginals to mean anything.

Nulls of source, lang and topic are a value of their own. Null and empty texts have no tokens and are never sampled. Repeated rows share their fate; rows
without a doc_id share one number. Other columns stay in ``mixed``. An empty table gives an empty result.
"""

from __future__ import annotations

import warnings
from collections.abc import Mapping

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import unused, written

DIMENSIONS = ("source", "lang", "topic")
TEMPERATURES = {"source": 0.7, "lang": 0.85, "topic": 0.85}
TOPICS = {
    "legal": "licens copyright warrant liab trademark patent attorney plaintiff defendant statut jurisdict",
    "computing": "password token server http config software browser database algorithm compil kernel",
    "commerce": "price discount shipping checkout purchas invoice refund wholesale retail",
    "health": "patient clinic symptom diagnos vaccin therap hospital disease surger",
    "news": "minister parliament election reporter spokes government senator",
}
ROUNDS, TOLERANCE = 200, 1e-10
#: Rounds of the SQL form, which has no loop; the raking of the test tables ends before.
SQL_ROUNDS = 25
NOTICE = 0.02
SEED = "mix-1"
CELLS = 200_000
_SPAN = float(16**13)

Targets = Mapping[str, Mapping[object, float]]


def tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^ \t\r\n]+")), F.lit(0)).cast("long")


def _stems() -> str:
    """A regex for the stems at the beginning of words, by their first letters."""
    by: dict[str, list[str]] = {}
    for stem in sorted({s for v in TOPICS.values() for s in v.split()}):
        by.setdefault(stem[0], []).append(stem[1:])
    return r"(?:^|[^\p{L}\p{M}])((?:" + "|".join(f"{c}(?:{'|'.join(rest)})" for c, rest in by.items()) + "))"


def topic(text: Column) -> Column:
    """The topic of a text by ``TOPICS``."""
    number = F.create_map(*[F.lit(x) for i, v in enumerate(TOPICS.values()) for s in v.split() for x in (s, i)])
    names = F.array(*map(F.lit, TOPICS))
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(_stems()), F.lit(1))
    return F.aggregate(
        found,
        F.array(*[F.lit(0)] * len(TOPICS)),
        lambda n, stem: F.transform(n, lambda v, i: v + F.when(number[stem] == i, 1).otherwise(0)),
        lambda n: F.when(F.array_max(n) == 0, "general").otherwise(F.element_at(names, F.array_position(n, F.array_max(n)).cast("int"))),
    )


def rake(cells: list[tuple], targets: Targets | None = None, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> np.ndarray:
    """The weights, the largest 1, of cells (source, lang, topic, tokens > 0)."""
    t = np.array([c[3] for c in cells], float)
    w = np.ones(len(t))
    total = t.sum()
    groups = []
    for d, dim in enumerate(DIMENSIONS):
        names = {v: i for i, v in enumerate(dict.fromkeys(c[d] for c in cells))}
        at = np.array([names[c[d]] for c in cells], int)
        if targets and dim in targets:
            given = {v: float(x) for v, x in targets[dim].items() if x}
            if min(given.values(), default=-1) < 0 or (cells and not given.keys() <= names.keys()):
                raise ValueError(f"targets of {dim} for which there are no tokens, or below zero: {sorted(map(str, given.keys() - names.keys()))}")
            goal = np.array([given.get(v, 0.0) for v in names])
        else:
            goal = np.bincount(at, t, len(names)) ** TEMPERATURES[dim]
        groups.append((dim, at, goal / goal.sum() * total if len(goal) else goal))
    if not len(t):
        return w
    for _ in range(rounds):
        for _, at, goal in groups:
            have = np.bincount(at, w * t, len(goal))
            w *= np.divide(goal, have, out=np.zeros_like(goal), where=have > 0)[at]
        off = {dim: float(np.abs(np.bincount(at, w * t, len(goal)) - goal).max() / total) for dim, at, goal in groups}
        if max(off.values()) <= tolerance:
            return w / w.max()
    why = f"the targets cannot be reached together: after {rounds} rounds marginals are off by shares of {off}"
    if targets:
        raise ValueError(why)
    warnings.warn(why, stacklevel=4)
    return w / w.max()


def _described(docs: DataFrame, topic_of: Column | str | None) -> DataFrame:
    own = topic(F.col("text")) if topic_of is None else F.col(topic_of) if isinstance(topic_of, str) else topic_of
    return docs.select("doc_id", F.col("source").alias("source"), F.col("lang").alias("lang"), own.alias("topic"), tokens(F.col("text")).alias("n_tokens"))


def _cells(described: DataFrame, targets: Targets | None, cells: int) -> DataFrame:
    """(source, lang, topic, p) of the cells that have tokens, at most ``cells`` of them."""
    spark = described.sparkSession
    some = described.groupBy(*DIMENSIONS).agg(F.sum("n_tokens").alias("t")).where("t > 0").limit(cells + 1).collect()
    if len(some) > cells:
        raise ValueError(f"more than {cells} combinations of source, language and topic")
    some = sorted((tuple(r) for r in some), key=str)
    p = rake(some, targets)
    t = np.array([c[3] for c in some], float)
    if len(t) and (kept := (p * t).sum() / t.sum()) < NOTICE:
        warnings.warn(f"the sample keeps {kept:.2%} of the tokens: the cell {some[int(p.argmax())][:3]} weighs most", stacklevel=3)
    kinds = [described.schema[n].dataType.simpleString() for n in DIMENSIONS]
    schema = ", ".join(f"{n} {k}" for n, k in zip(DIMENSIONS, kinds, strict=True)) + ", p double"
    return spark.createDataFrame([(*c[:3], float(x)) for c, x in zip(some, p, strict=True)], schema)


def probabilities(docs: DataFrame, targets: Targets | None = None, topic_of: Column | str | None = None, cells: int = CELLS) -> DataFrame:
    """(source, lang, topic, p) of the cells that have tokens."""
    return _cells(_described(docs, topic_of), targets, cells)


def uniform(doc_id: Column, seed: str = SEED) -> Column:
    text = F.concat(F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(":" + seed))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(_SPAN)


def mixed(docs: DataFrame, targets: Targets | None = None, topic_of: Column | str | None = None, cells: int = CELLS) -> DataFrame:
    """The sampled rows of ``docs`` with all their columns. The rows stay where they are: the cells, at most ``cells``, are broadcast."""
    s, l, t, p, kind = (unused(docs, n) for n in ("_s", "_l", "_t", "_p", "_topic"))
    table = F.broadcast(probabilities(docs, targets, topic_of, cells).toDF(s, l, t, p))
    own = topic(F.col("text")) if topic_of is None else F.col(topic_of) if isinstance(topic_of, str) else topic_of
    own = docs.where(F.col("text").rlike(r"[^ \t\r\n]")).withColumn(kind, own)
    on = own["source"].eqNullSafe(table[s]) & own["lang"].eqNullSafe(table[l]) & own[kind].eqNullSafe(table[t])
    near = own.join(table, on).where(uniform(F.col("doc_id")) < F.col(p))
    return near.select(*[F.col(f"`{c}`") for c in docs.columns])


def mixture(docs: DataFrame, targets: Targets | None = None, topic_of: Column | str | None = None, cells: int = CELLS) -> DataFrame:
    """The sample: doc_id, source, lang, topic, n_tokens, p (to six places). Texts are read once."""
    own = written(_described(docs, topic_of), "described")
    p = _cells(own, targets, cells)
    p = F.broadcast(p.select(F.col("source").alias("_s"), F.col("lang").alias("_l"), F.col("topic").alias("_t"), F.col("p").alias("_p")))
    on = own["source"].eqNullSafe(p["_s"]) & own["lang"].eqNullSafe(p["_l"]) & own["topic"].eqNullSafe(p["_t"])
    out = own.join(p, on).where((uniform(F.col("doc_id")) < F.col("_p")) & (F.col("n_tokens") > 0))
    return out.select("doc_id", "source", "lang", "topic", "n_tokens", F.round("_p", 6).alias("p"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _sql() -> str:
    counts = ", ".join(f"len(list_filter(stems, lambda x: x IN ({', '.join(repr(s) for s in v.split())}))) AS n{i}" for i, v in enumerate(TOPICS.values()))
    most = "greatest(" + ", ".join(f"n{i}" for i in range(len(TOPICS))) + ")"
    case = "".join(f" WHEN n{i} = {most} THEN '{name}'" for i, name in enumerate(TOPICS))
    parts = [
        f"""WITH found AS (SELECT doc_id, source, lang, regexp_extract_all(lower(coalesce(text, '')), '{_stems()}', 1) AS stems,
  coalesce(len(regexp_extract_all(text, '[^ \t\r\n]+')), 0)::BIGINT AS n_tokens FROM documents),
counted AS (SELECT doc_id, source, lang, n_tokens, {counts} FROM found),
described AS (SELECT doc_id, source, lang, CASE WHEN {most} = 0 THEN 'general'{case} END AS topic, n_tokens FROM counted)""",
        "w0 AS MATERIALIZED (SELECT source, lang, topic, sum(n_tokens)::DOUBLE AS t, 1.0::DOUBLE AS w FROM described GROUP BY ALL HAVING sum(n_tokens) > 0)",
    ]
    for d in DIMENSIONS:
        parts.append(f"goal_{d} AS MATERIALIZED (SELECT v, g / sum(g) OVER () * (SELECT sum(t) FROM w0) AS goal FROM (SELECT {d} AS v, pow(sum(t), {TEMPERATURES[d]}) AS g FROM w0 GROUP BY 1))")
    k = 0
    for _ in range(SQL_ROUNDS):
        for d in DIMENSIONS:
            parts.append(
                f"w{k + 1} AS MATERIALIZED (SELECT a.source, a.lang, a.topic, a.t, a.w * g.goal / h.have AS w FROM w{k} a JOIN goal_{d} g ON a.{d} IS NOT DISTINCT FROM g.v "
                f"JOIN (SELECT {d} AS v, sum(w * t) AS have FROM w{k} GROUP BY 1) h ON a.{d} IS NOT DISTINCT FROM h.v)"
            )
            k += 1
    parts.append(f"p AS MATERIALIZED (SELECT source, lang, topic, w / (SELECT max(w) FROM w{k}) AS p FROM w{k})")
    return ",\n".join(parts) + (
        "\nSELECT d.doc_id, d.source, d.lang, d.topic, d.n_tokens, round(p.p, 6) AS p FROM described d JOIN p ON d.source IS NOT DISTINCT FROM p.source AND d.lang IS NOT DISTINCT FROM p.lang AND d.topic = p.topic "
        f"WHERE d.n_tokens > 0 AND ('0x' || substr(md5(coalesce(d.doc_id::VARCHAR, 'null') || ':{SEED}'), 1, 13))::BIGINT::DOUBLE / {_SPAN:.1f} < p.p"
    )


OP10_SQL = _sql()
