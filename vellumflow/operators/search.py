"""Keyword search in lines: (doc_id, line_no, line) against a list of queries.

The queries are a list on the driver, as a user gives them; the lines are a table of any size. On plain text the confidence of a hit is
1, in fuzzy mode exp(-edit distance / length): there is no recogniser here to give another.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellumflow.functions import text as T
from vellumflow.shared import checkpointed

MIN_CONFIDENCE = 0.05
#: Tokens, and hashes of rows, that a search broadcasts at most.
FREQUENT, HASHES = 1 << 16, 1 << 18


def line_table(docs: DataFrame) -> DataFrame:
    """doc_id, line_no (from 0), line; null texts have none."""
    return docs.select("doc_id", F.posexplode(T.lines(F.col("text"))).alias("line_no", "line"))


def keyword_hits(lines: DataFrame, queries: list[str], mode: str = "word", prefix: bool = False, suffix: bool = False, fold: bool = False) -> DataFrame:
    """query, doc_id, line_no of the lines that each query hits; a repeated query counts once.

    The whole query list is one array expression over each line, so a line is read once and no join is made. A substring test comes before
    the regex where the query is no regex itself.
    """
    tests = []
    for q in dict.fromkeys(queries):
        hit = F.col("line").rlike(T.keyword_pattern(q, mode, prefix, suffix, fold))
        if mode != "expert":
            cheap = F.contains(F.upper("line"), F.upper(F.lit(q))) if fold else F.contains(F.col("line"), F.lit(q))
            hit = cheap & hit
        tests.append(F.when(hit, F.lit(q)))
    found = F.filter(F.array(*tests), lambda x: x.isNotNull())
    return lines.select(F.explode(found).alias("query"), "doc_id", "line_no")


def _maybe(rows: DataFrame, of: DataFrame, *keys: str) -> DataFrame:
    """``rows`` without most of those whose keys no row of ``of`` has: by hashes, at most ``HASHES`` of which are broadcast."""
    bucket = F.pmod(F.xxhash64(*keys), F.lit(HASHES)).alias("_h")
    return rows.withColumn("_h", bucket).join(F.broadcast(of.select(bucket).distinct()), "_h", "left_semi").drop("_h")


def table_hits(lines: DataFrame, queries: DataFrame) -> DataFrame:
    """query, doc_id, line_no of the lines that each whole-word query of a table (column ``query``) hits; a repeated query counts once, null finds nothing.

    Lines are cut at separators, and a query is matched with the tokens that equal its longest part; so the work doesn't grow with the number of queries. A query that is
    one token needs no more than to be known as asked: of the ``FREQUENT`` commonest tokens, the bulk of any text, that is broadcast, and the others are joined to the queries. Of a query of
    several parts the lines with its token are found first, without their text, and it is then verified in them. A query of separators alone finds nothing.
    """
    cut = lambda c: F.split(c, f"[{T.BORDER}]")
    longest = F.array_max(F.transform(F.filter(cut(F.col("query")), lambda t: t != ""), lambda t: F.struct(F.length(t).alias("n"), t.alias("t")))).t
    # kept, as else the filters on the longest part would be inferred for every token of the lines, and for every row that the queries are counted from
    asked = checkpointed(queries.where("query is not null").select("query").distinct().withColumn("_token", longest)).where("_token is not null")
    alone, parts = asked.where("query = _token").select("_token"), asked.where("query <> _token")
    told = lines.select("doc_id", "line_no", F.explode(F.array_distinct(cut(F.col("line")))).alias("_token")).where("_token <> ''")
    common = told.groupBy("_token").agg(F.count("*").alias("_n")).orderBy(F.desc("_n"), "_token").limit(FREQUENT).select("_token")
    known = common.join(alone.withColumn("_is", F.lit(True)), "_token", "left").select("_token", F.coalesce("_is", F.lit(False)).alias("_asked"))
    seen = told.join(F.broadcast(known), "_token", "left")
    whole = seen.where("_asked").select(F.col("_token").alias("query"), "doc_id", "line_no")
    rare = seen.where("_asked is null").select("_token", "doc_id", "line_no").join(alone, "_token").select(F.col("_token").alias("query"), "doc_id", "line_no")
    if parts.isEmpty():
        return whole.unionAll(rare)
    maybe = checkpointed(_maybe(told, parts, "_token").join(parts, "_token").select("query", F.col("doc_id").alias("_doc"), F.col("line_no").alias("_line")).distinct())
    quoted = F.regexp_replace("query", r"([\\.^$|?*+()\[\]{}])", r"\\$1")
    pattern = F.concat(F.lit(f"(?:^|[{T.BORDER}])"), quoted, F.lit(f"(?:$|[{T.BORDER}])"))
    same = F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("line_no") == F.col("_line"))
    sure = _maybe(lines, maybe.select(F.col("_doc").alias("doc_id"), F.col("_line").alias("line_no")), "doc_id", "line_no").join(maybe, same).where(F.contains("line", F.col("query"))).where(F.rlike(F.col("line"), pattern))
    return whole.unionAll(rare).unionAll(sure.select("query", "doc_id", "line_no"))


def reject_counts(lines: DataFrame, queries: list[str]) -> DataFrame:
    """query and how many lines each step of the cascade ended: too short, without the text, without borders, found."""
    parts = []
    for q in dict.fromkeys(queries):
        short = F.length("line") < len(q)
        absent = ~short & ~F.contains(F.col("line"), F.lit(q))
        found = F.col("line").rlike(T.keyword_pattern(q))
        open_ = ~short & ~absent & ~found
        parts.append(F.struct(F.lit(q).alias("query"), *[F.when(c, 1).otherwise(0).alias(n) for n, c in (("too_short", short), ("no_text", absent), ("no_border", open_), ("found", found))]))
    each = lines.select(F.inline(F.array(*parts)))
    return each.groupBy("query").agg(F.count("*").alias("all"), *[F.sum(c).alias(c) for c in ("too_short", "no_text", "no_border", "found")])


def fuzzy_confidence(term: Column, query: str) -> Column:
    return F.exp(-F.levenshtein(term, F.lit(query)) / F.lit(float(len(query))))


def fuzzy_hits(words: DataFrame, queries: list[str], least: float = MIN_CONFIDENCE) -> DataFrame:
    """query, term, cnt, conf of the dictionary's terms of at least ``least`` confidence, in one pass over the dictionary. A length filter, exact by itself, comes first."""
    import math

    tests = []
    for q in dict.fromkeys(queries):
        reach = int(math.floor(-math.log(least) * len(q) + 1e-9))
        near = F.abs(F.length("term") - len(q)) <= reach
        tests.append(F.when(near, F.struct(F.lit(q).alias("query"), fuzzy_confidence(F.col("term"), q).alias("conf"))))
    found = F.filter(F.array(*tests), lambda x: x.isNotNull() & (x.conf >= least))
    return words.select("term", "cnt", F.inline(found)).select("query", "term", "cnt", "conf")


def best_hits(hits: DataFrame, n: int, order: list[Column]) -> DataFrame:
    """The first n hits of each query with their rank; a negative n keeps all."""
    ranked = hits.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*order)))
    return ranked if n < 0 else ranked.where(F.col("rank") <= n)


def keywords(docs: DataFrame, min_len: int = 0, max_len: int = 0, min_occ: int = 0, max_occ: int = -1, alpha: bool = True, upper: bool = False) -> DataFrame:
    """term, cnt in the given bounds; ``max_len`` <= 0 and ``max_occ`` < 0 are no bounds."""
    words = docs.select(F.explode(T.keyword_tokens(F.col("text"), alpha, upper)).alias("term"))
    n = F.length("term")
    words = words.where((n >= min_len) & (n <= max_len if max_len > 0 else F.lit(True)))
    out = words.groupBy("term").agg(F.count("*").alias("cnt")).where(F.col("cnt") >= min_occ)
    return out if max_occ < 0 else out.where(F.col("cnt") <= max_occ)


def pages_of_results(hits: DataFrame, order: list[Column], size: int = 10) -> DataFrame:
    """Each query's hits cut into pages of ``size``, from 0."""
    rank = F.row_number().over(Window.partitionBy("query").orderBy(*order))
    return hits.withColumn("page", F.floor((rank - 1) / size))


def nested(hits: DataFrame) -> DataFrame:
    """query, n, json: each query's hits as one JSON array in order of doc_id and line_no."""
    each = F.struct("doc_id", "line_no")
    return hits.groupBy("query").agg(F.count("*").alias("n"), F.to_json(F.array_sort(F.collect_list(each))).alias("json"))
