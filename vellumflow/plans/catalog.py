"""The registered queries over the driver's tables, each with the DuckDB SQL that it must agree with where SQL has a form of it."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumflow.functions import geometry as G
from vellumflow.functions import numeric as N
from vellumflow.functions import options as O
from vellumflow.functions import text as T
from vellumflow.operators import evaluate as E
from vellumflow.operators import graph, lexicon, pages, runs, search, stats

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


KEYWORDS = ["the", "that", "password", "Licensed", "License, Version", "der", "la", "tion"]
PATTERNS = [r"token = \"[0-9a-f]+", r"[A-Z]{4}[0-9]", r"(?:^|[^\p{L}\p{M}\p{N}_])de[rs](?:$|[^\p{L}\p{M}\p{N}_])", r"Apache (?:License|license)", r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}"]
_WORDS = "SELECT {0}unnest(regexp_extract_all({1}, '\\p{{L}}[\\p{{L}}\\p{{M}}]*')) AS term FROM {2}"
_DICT = "SELECT term, count(*) AS cnt FROM (" + _WORDS.format("", "text", "documents") + ") GROUP BY 1"
_LINES = "(SELECT doc_id, (generate_subscripts(x, 1) - 1)::INT AS line_no, unnest(x) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents))"


def _ascii(table_: str, column: str = "text") -> str:
    """A table ``ascii(f, t)`` that names, for ``translate``, each character beyond ASCII and a control character instead: DuckDB counts edits in bytes."""
    odd = f"SELECT ch, row_number() OVER (ORDER BY ch) AS k FROM (SELECT DISTINCT unnest(string_split({column}, '')) AS ch FROM {table_}) WHERE unicode(ch) > 127"
    return f"ascii AS MATERIALIZED (SELECT coalesce(string_agg(ch, '' ORDER BY k), '') AS f, coalesce(string_agg(chr((CASE WHEN k < 9 THEN k ELSE k + 5 END)::INT), '' ORDER BY k), '') AS t FROM ({odd}))"


def _list(values: list[str]) -> str:
    return "(VALUES " + ", ".join("('" + v.replace("'", "''") + "')" for v in values) + ") q(query)"


# --- statistics and dictionaries ---------------------------------------------------------------------------------


@query("SELECT ch, unicode(ch)::INT AS codepoint, count(*) AS cnt FROM (SELECT unnest(string_split(text, '')) AS ch FROM documents) WHERE ch <> '' GROUP BY 1, 2")
def char_stat(spark, sf):
    return stats.char_stat(table(spark, sf, "documents"))


@query("SELECT ch || ' | \\u' || lpad(upper(to_hex(unicode(ch))), 4, '0') || ' | ' || count(*) AS value FROM (SELECT unnest(string_split(text, '')) AS ch FROM documents) WHERE ch <> '' GROUP BY ch")
def char_stat_lines(spark, sf):
    return stats.char_stat_lines(stats.char_stat(table(spark, sf, "documents")))


@query(_DICT)
def word_dict(spark, sf):
    return stats.dictionary(table(spark, sf, "documents"))


@query("SELECT term, count(*) AS cnt FROM (SELECT unnest(regexp_extract_all(text, '\\p{L}[\\p{L}\\p{M}]*|[^\\s\\p{L}]')) AS term FROM documents) GROUP BY 1")
def word_dict_simple(spark, sf):
    return stats.dictionary(table(spark, sf, "documents"), T.words_and_signs(F.col("text")))


@query("SELECT lang, term, count(*) AS cnt FROM (" + _WORDS.format("lang, ", "text", "documents") + ") GROUP BY 1, 2")
def dict_by_lang_merge(spark, sf):
    parts = stats.dictionary(table(spark, sf, "documents"), keys=("lang", "source"))
    return stats.merged_dictionaries(parts, ("lang",))


@query(_DICT + " ORDER BY cnt DESC, term LIMIT 100")
def dict_topk(spark, sf):
    return stats.top_terms(stats.dictionary(table(spark, sf, "documents")), 100)


@query(f"WITH d AS ({_DICT}) SELECT term, round(log10(cnt / (SELECT sum(cnt) FROM d)) + {math.log10(1 - math.exp(-5))!r}, 6) AS log10_p FROM d UNION ALL SELECT '<unk>', {round(-5 / math.log(10), 6)!r}")
def unigram_logprob(spark, sf):
    return stats.unigram_logprob(stats.dictionary(table(spark, sf, "documents")))


_SHARE = f"WITH d AS ({_DICT}), s AS (SELECT term, cnt / (SELECT sum(cnt) FROM d) AS p FROM d)"
_CHAR_COST = ", cm AS (SELECT ch, sum(p) AS m FROM (SELECT unnest(string_split(term, '')) AS ch, p FROM s) GROUP BY 1), cc AS (SELECT ch, -ln(m / (SELECT sum(m) FROM cm)) AS cost FROM cm)"
_LEN = (
    ", lm AS (SELECT length(term) AS len, sum(p) AS raw FROM s GROUP BY 1), lf AS (SELECT g.len, coalesce(raw, 0.0) AS raw, coalesce(raw, (SELECT min(raw) FROM lm)) AS v "
    "FROM (SELECT unnest(generate_series(0, (SELECT max(len) FROM lm))) AS len) g LEFT JOIN lm USING (len)), ln_ AS (SELECT len, raw, v / (SELECT sum(v) FROM lf) AS norm FROM lf)"
)


@query(_SHARE + _CHAR_COST + " SELECT ch, round(cost, 6) AS cost FROM cc UNION ALL SELECT '<default>', round(max(cost), 6) FROM cc")
def char_prior(spark, sf):
    return stats.char_costs(stats.dictionary(table(spark, sf, "documents"))).withColumn("cost", F.round("cost", 6))


@query(_SHARE + _LEN + " SELECT len::INT AS len, round(norm + raw, 6) AS reference, round(-ln(norm), 6) AS neglog FROM ln_")
def word_length_prior(spark, sf):
    words = stats.dictionary(table(spark, sf, "documents"))
    a = stats.length_costs(words, "reference").select("len", F.round("cost", 6).alias("reference"))
    return a.join(stats.length_costs(words, "neglog").select("len", F.round("cost", 6).alias("neglog")), "len")


@query(
    _SHARE
    + _CHAR_COST
    + _LEN
    + ", b AS (SELECT term, count(*) AS cnt FROM ("
    + _WORDS.format("", "text", "benchmark")
    + ") GROUP BY 1), bp AS (SELECT term, -ln(cnt / (SELECT sum(cnt) FROM b)) AS post FROM b), pr AS (SELECT term, sum(0.25 * coalesce(cost, (SELECT max(cost) FROM cc)) + 1.0) AS c "
    "FROM (SELECT term, unnest(string_split(term, '')) AS ch FROM bp) LEFT JOIN cc USING (ch) GROUP BY 1) "
    "SELECT bp.term, round(0.5 * post + 0.5 * (coalesce(-ln(s.p), 22.0) - (pr.c + 0.5 * coalesce(-ln(l.norm), (SELECT -ln(norm) FROM ln_ WHERE len = 0)))), 6) AS score "
    "FROM bp JOIN pr USING (term) LEFT JOIN s USING (term) LEFT JOIN ln_ l ON l.len = length(bp.term)"
)
def lm_score(spark, sf):
    own, known = stats.dictionary(table(spark, sf, "benchmark")), stats.dictionary(table(spark, sf, "documents"))
    return stats.lm_scores(own, known, known).withColumn("score", F.round("score", 6))


_OOV = "WITH b AS (SELECT term, count(*) AS cnt FROM (" + _WORDS.format("", "text", "benchmark") + ") GROUP BY 1), e AS (" + _WORDS.format("", "text", "documents").replace("FROM documents", "FROM documents WHERE lang = ''de''".replace("''", "'")) + "), o AS (SELECT term, cnt / (SELECT sum(cnt) FROM b) AS p FROM b WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.term = b.term))"


@query(_OOV + " SELECT round(coalesce(sum(p), 0), 9) AS oov_mass, count(*) AS n_terms FROM o")
def oov_mass(spark, sf):
    known = stats.dictionary(table(spark, sf, "documents").where("lang = 'de'"))
    return stats.unknown_mass(stats.dictionary(table(spark, sf, "benchmark")), known).withColumn("oov_mass", F.round("oov_mass", 9))


@query(_OOV + " SELECT term, round(p, 9) AS p FROM o")
def oov_terms(spark, sf):
    known = stats.dictionary(table(spark, sf, "documents").where("lang = 'de'"))
    return stats.unknown_terms(stats.dictionary(table(spark, sf, "benchmark")), known).select("term", F.round("p", 9).alias("p"))


@query("SELECT gram, count(*) AS cnt FROM (SELECT substr(x, i::BIGINT, 3) AS gram FROM (SELECT x, unnest(generate_series(1, length(x) - 2)) AS i FROM (SELECT '@' || line || '@' AS x FROM " + _LINES + " WHERE line <> ''))) GROUP BY 1")
def char_ngrams(spark, sf):
    return stats.char_ngrams(table(spark, sf, "documents"), 3)


@query("SELECT CASE WHEN regexp_matches(ch, '^\\p{L}') THEN 'L' WHEN regexp_matches(ch, '^\\p{M}') THEN 'M' WHEN regexp_matches(ch, '^\\p{N}') THEN 'N' WHEN regexp_matches(ch, '^\\p{P}') THEN 'P' WHEN regexp_matches(ch, '^\\p{S}') THEN 'S' WHEN regexp_matches(ch, '^\\p{Z}') THEN 'Z' ELSE 'C' END AS category, count(*) AS n FROM (SELECT DISTINCT unnest(string_split(text, '')) AS ch FROM documents) WHERE ch <> '' GROUP BY 1")
def char_classes(spark, sf):
    return lexicon.char_classes(stats.char_stat(table(spark, sf, "documents"))).select("category", F.size("characters").cast("long").alias("n"))


@query(
    f"WITH d AS ({_DICT}) SELECT term, 'charmap' AS kind FROM d WHERE regexp_matches(term, '[^a-zA-Z]')"
)
def dict_errors(spark, sf):
    """Terms that a map of ASCII letters alone can't write: accents have no ASCII form of their own, and base letters lose them only as NFD marks."""
    known = [chr(c) for c in (*range(65, 91), *range(97, 123))]
    return lexicon.checked_dictionary(stats.dictionary(table(spark, sf, "documents")), known)[1]


# --- keyword search ----------------------------------------------------------------------------------------------

_WORD_HIT = "regexp_matches(line, '(?:^|[\\p{Z}\\p{P}\\p{S}])' || regexp_escape(query) || '(?:$|[\\p{Z}\\p{P}\\p{S}])')"


def _hits(where: str, values: list[str] = KEYWORDS) -> str:
    """One branch a query, as DuckDB compiles only a constant regex once."""
    quoted = [v.replace("'", "''") for v in values]
    return " UNION ALL ".join(f"SELECT '{v}' AS query, doc_id, line_no FROM {_LINES} WHERE " + where.replace("query", f"'{v}'") for v in quoted)


def _search(spark, sf, queries=KEYWORDS, **how):
    return search.keyword_hits(search.line_table(table(spark, sf, "documents")), queries, **how)


@query(_hits(_WORD_HIT))
def kw_word(spark, sf):
    return _search(spark, sf)


@query(_hits("contains(line, query)"))
def kw_part(spark, sf):
    return _search(spark, sf, mode="part")


@query(_hits("starts_with(line, query)"))
def kw_prefix(spark, sf):
    return _search(spark, sf, mode="part", prefix=True)


@query(_hits("suffix(line, query)"))
def kw_suffix(spark, sf):
    return _search(spark, sf, mode="part", suffix=True)


@query(_hits(_WORD_HIT.replace("line, '(?:^", "upper(line), '(?:^").replace("regexp_escape(query)", "regexp_escape(upper(query))")))
def kw_upper(spark, sf):
    return _search(spark, sf, fold=True)


@query(_hits("regexp_matches(line, query)", PATTERNS))
def kw_expert(spark, sf):
    return _search(spark, sf, PATTERNS, mode="expert")


@query(f"SELECT query, doc_id, line_no, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY doc_id, line_no)::INT AS rank FROM ({_hits(_WORD_HIT)})) WHERE rank <= 10")
def kw_topn(spark, sf):
    return search.best_hits(_search(spark, sf), 10, [F.col("doc_id"), F.col("line_no")])


@query(f"SELECT query, ((row_number() OVER (PARTITION BY query ORDER BY doc_id, line_no) - 1) // 10)::BIGINT AS page, doc_id, line_no FROM ({_hits(_WORD_HIT)})")
def kw_pages(spark, sf):
    return search.pages_of_results(_search(spark, sf), [F.col("doc_id"), F.col("line_no")])


@query(
    f"WITH q AS (SELECT term AS query FROM ({_DICT}) WHERE length(term) >= 3 AND cnt >= 2 UNION ALL SELECT 'License, Version'), t AS (SELECT DISTINCT doc_id, line_no, unnest(regexp_split_to_array(line, '[\\p{{Z}}\\p{{P}}\\p{{S}}]')) AS query FROM {_LINES}) "
    "SELECT query, doc_id, line_no FROM t JOIN q USING (query) UNION ALL " + _hits(_WORD_HIT, ["License, Version"])
)
def kw_table(spark, sf):
    """A table of queries, thousands of them, as an equi-join on the lines' tokens."""
    docs = table(spark, sf, "documents")
    asked = stats.dictionary(docs).where("length(term) >= 3 and cnt >= 2").select(F.col("term").alias("query"))
    return search.table_hits(search.line_table(docs), asked.union(spark.createDataFrame([("License, Version",)], "query string")))


_SHORT, _ABSENT = "length(line) < length(query)", "NOT contains(line, query)"


_REJECTS = "SELECT query AS query, count(*) AS \"all\", count(*) FILTER ({0})::BIGINT AS too_short, count(*) FILTER (NOT ({0}) AND {1})::BIGINT AS no_text, count(*) FILTER (contains(line, query) AND NOT {2})::BIGINT AS no_border, count(*) FILTER ({2})::BIGINT AS found FROM "


@query(" UNION ALL ".join(_REJECTS.replace("{0}", _SHORT).replace("{1}", _ABSENT).replace("{2}", _WORD_HIT).replace("query", f"'{k}'").replace(f"AS '{k}'", "AS query") + _LINES for k in KEYWORDS))
def kw_reject_stats(spark, sf):
    return search.reject_counts(search.line_table(table(spark, sf, "documents")), KEYWORDS)


_ASCII = ["password", "license", "version", "the", "idiot"]


@query(
    f"WITH {_ascii('documents')}, q AS (SELECT query, term, cnt, exp(-levenshtein(translate(term, f, t), query) / length(query)::DOUBLE) AS conf FROM ({_DICT}), ascii, {_list(_ASCII)} "
    "WHERE abs(length(term) - length(query)) <= length(query)) SELECT query, term, cnt, round(conf, 6) AS conf FROM q WHERE conf >= 0.5"
)
def kw_fuzzy(spark, sf):
    words = stats.dictionary(table(spark, sf, "documents"))
    return search.fuzzy_hits(words, _ASCII, 0.5).withColumn("conf", F.round("conf", 6))


@query(f"SELECT term, cnt FROM ({_DICT}) WHERE length(term) >= 4 AND cnt BETWEEN 5 AND 50")
def query_select(spark, sf):
    return search.keywords(table(spark, sf, "documents"), min_len=4, max_len=0, min_occ=5, max_occ=50)


@query(f"WITH k AS (SELECT term FROM ({_DICT}) WHERE length(term) >= 8 AND cnt >= 3), t AS (SELECT doc_id, unnest(regexp_extract_all(text, '\\p{{L}}[\\p{{L}}\\p{{M}}]*')) AS term FROM documents) SELECT term, doc_id, count(*) AS cnt FROM t WHERE term IN (SELECT term FROM k) GROUP BY 1, 2")
def query_truth(spark, sf):
    docs = table(spark, sf, "documents")
    chosen = search.keywords(docs, min_len=8, min_occ=3).select("term")
    return stats.dictionary(docs, keys=("doc_id",)).join(chosen, "term", "left_semi").select("term", "doc_id", "cnt")


@query(f"SELECT query, count(*) AS n, count(DISTINCT doc_id)::BIGINT AS n_docs FROM ({_hits(_WORD_HIT)}) GROUP BY 1")
def json_result(spark, sf):
    out = search.nested(_search(spark, sf))
    hits = F.from_json("json", "array<struct<doc_id:bigint,line_no:int>>")
    return out.select("query", F.size(hits).cast("long").alias("n"), F.size(F.array_distinct(F.transform(hits, lambda h: h.doc_id))).cast("long").alias("n_docs"))


# --- lines and pages ---------------------------------------------------------------------------------------------


@query(f"SELECT doc_id, line_no, line FROM {_LINES}")
def line_flatten(spark, sf):
    return search.line_table(table(spark, sf, "documents"))


@query(f"SELECT doc_id, line_no, line FROM {_LINES} WHERE regexp_matches(line, '^[\\p{{L}}\\p{{N}}\\p{{P}}\\p{{Z}}\\p{{S}}\\p{{M}}]*$') AND NOT regexp_matches(line, '[\\x{{10000}}-\\x{{10FFFF}}]')")
def valid_lines(spark, sf):
    return pages.checked_lines(search.line_table(table(spark, sf, "documents")))[0]


@query(f"SELECT doc_id, line_no, line, CASE WHEN regexp_matches(line, '[\\x{{10000}}-\\x{{10FFFF}}]') THEN 'surrogate' ELSE 'category' END AS kind FROM {_LINES} WHERE NOT regexp_matches(line, '^[\\p{{L}}\\p{{N}}\\p{{P}}\\p{{Z}}\\p{{S}}\\p{{M}}]*$') OR regexp_matches(line, '[\\x{{10000}}-\\x{{10FFFF}}]')")
def invalid_lines(spark, sf):
    return pages.checked_lines(search.line_table(table(spark, sf, "documents")))[1]


@query("SELECT d.doc_id, CASE quality WHEN 1 THEN 'gt' WHEN 0 THEN 'new' END AS status, (1 - toxic)::DOUBLE AS conf FROM documents d LEFT JOIN labels l USING (doc_id) WHERE coalesce(quality IN (0, 1), false) AND (toxic IS NULL OR 1 - toxic >= 0.5)")
def status_filter(spark, sf):
    status = F.when(F.col("quality") == 1, "gt").when(F.col("quality") == 0, "new")
    told = table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels"), "doc_id", "left")
    told = told.select("doc_id", status.alias("status"), (1 - F.col("toxic")).cast("double").alias("conf"))
    return pages.confident(pages.with_status(told, "GT;New"), 0.5)


@query("SELECT d.doc_id, (1 - toxic)::DOUBLE AS conf FROM documents d LEFT JOIN labels l USING (doc_id) WHERE toxic IS NULL OR 1 - toxic >= 0.5")
def confidence_filter(spark, sf):
    told = table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels"), "doc_id", "left")
    return pages.confident(told.select("doc_id", (1 - F.col("toxic")).cast("double").alias("conf")), 0.5)


@query("SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS region_text FROM conversations WHERE text IS NOT NULL GROUP BY 1")
def region_rollup(spark, sf):
    return pages.region_text(table(spark, sf, "conversations"), ["conv_id"], "turn")


@query("SELECT term, count(*) AS cnt FROM (SELECT unnest(regexp_extract_all(regexp_replace(text, '(\\p{L})-\\n[ \\t\\n]*', '\\1', 'g'), '\\p{L}[\\p{L}\\p{M}]*')) AS term FROM documents) GROUP BY 1")
def hyphen_words(spark, sf):
    return stats.dictionary(table(spark, sf, "documents"), T.words(T.join_hyphens(F.col("text"))))


@query("SELECT doc_id, line FROM (SELECT doc_id, trim(regexp_replace(line, '\\s+', ' ', 'g')) AS line FROM " + _LINES + ") WHERE line <> ''")
def whitespace_fold(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.explode(T.filled_lines(F.col("text"))).alias("line"))


@query("SELECT doc_id, md5(regexp_replace(text || chr(8206) || 'x' || chr(8238), '[\\x{061C}\\x{200E}\\x{200F}\\x{202A}-\\x{202E}\\x{2066}-\\x{2069}]', '', 'g')) AS stripped FROM documents")
def bidi_strip(spark, sf):
    marked = F.concat("text", F.lit("‎x‮"))
    return table(spark, sf, "documents").select("doc_id", F.md5(T.strip_marks(marked).cast("binary")).alias("stripped"))


@query("SELECT page_id, conv FROM (SELECT conv_id AS conv, 'r' || dense_rank() OVER (PARTITION BY conv_id ORDER BY role) || 'l' || row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS page_id FROM conversations)")
def line_ids(spark, sf):
    own = table(spark, sf, "conversations").select(F.col("conv_id").alias("page_id"), F.col("role").alias("region"), F.col("turn").alias("pos"))
    return pages.numbered(own).select(F.col("line_id").alias("page_id"), F.col("page_id").alias("conv"))


@query(f"SELECT line, count(*) AS cnt, count(DISTINCT doc_id) AS n_docs FROM {_LINES} WHERE line <> '' GROUP BY 1 HAVING count(*) > 1")
def dup_lines(spark, sf):
    lines = search.line_table(table(spark, sf, "documents")).where("line <> ''")
    each = lines.groupBy("line", "doc_id").agg(F.count("*").alias("c"))
    return each.groupBy("line").agg(F.sum("c").alias("cnt"), F.count("*").alias("n_docs")).where("cnt > 1")


# --- runs and training logs --------------------------------------------------------------------------------------

_BREAKS = "SELECT *, sum(new) OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS run_id FROM (SELECT *, CASE WHEN lag(role) OVER w = role THEN 0 ELSE 1 END AS new FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))"


@query(f"SELECT conv_id, run_id::BIGINT AS run_id, role, min(turn) AS first, max(turn) AS last, count(*) AS n FROM ({_BREAKS}) GROUP BY ALL")
def role_runs(spark, sf):
    return runs.runs(table(spark, sf, "conversations"), ["conv_id"], "turn", "role")


_EVENT_BREAKS = "SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS run_id FROM (SELECT *, CASE WHEN lag(event_type) OVER w = event_type THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))"


@query(f"SELECT user_id, run_id::BIGINT AS run_id, event_type, min(event_id) AS first, max(event_id) AS last, count(*) AS n FROM ({_EVENT_BREAKS}) WHERE NOT event_type = 'click' GROUP BY ALL")
def run_groups(spark, sf):
    return runs.runs(table(spark, sf, "events"), ["user_id"], "event_id", "event_type", F.col("event_type") == "click")


@query(
    "SELECT conv_id, part::BIGINT AS part, min(turn) AS first, max(turn) AS last FROM (SELECT *, sum(new) OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS part FROM (SELECT *, role = 'system' AS o, CASE WHEN lag(role = 'system') OVER (PARTITION BY conv_id ORDER BY turn) = (role = 'system') THEN 0 ELSE 1 END AS new FROM conversations)) WHERE NOT o GROUP BY ALL"
)
def label_parts(spark, sf):
    return runs.parts(table(spark, sf, "conversations"), ["conv_id"], "turn", "role", ["system"])


@query(
    "WITH e AS (SELECT user_id, event_id, (extract(hour FROM ts))::INT AS h FROM events), b AS (SELECT *, CASE WHEN max(h) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= h THEN 0 ELSE 1 END AS new FROM e), "
    "r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS run_id FROM b), l AS (SELECT *, lag(h) OVER (PARTITION BY user_id, run_id ORDER BY event_id) AS p FROM r) "
    "SELECT user_id, run_id::BIGINT AS run_id, string_agg(h::VARCHAR, '_' ORDER BY event_id) FILTER (p IS NULL OR p <> h) AS label, count(*) AS n FROM l GROUP BY 1, 2"
)
def merge_disorder(spark, sf):
    told = table(spark, sf, "events").select("user_id", "event_id", F.hour("ts").alias("h"))
    return runs.merged_disorder(told, ["user_id"], "event_id", "h")


_BEST = "SELECT user_id, event_id, value, coalesce(value < b, true) AS is_best, least(value, b) AS best FROM (SELECT *, min(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM events)"


@query(_BEST)
def best_so_far(spark, sf):
    return runs.best_so_far(table(spark, sf, "events"), ["user_id"], ["ts", "event_id"], "value").select("user_id", "event_id", "value", "is_best", "best")


@query(
    "WITH b AS (SELECT user_id, ts, event_id, value, row_number() OVER w AS epoch, min(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p, min(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS best FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), "
    "s AS (SELECT *, epoch - max(CASE WHEN coalesce(value < p, true) THEN epoch END) OVER (PARTITION BY user_id ORDER BY epoch ROWS UNBOUNDED PRECEDING) AS since FROM b) "
    "SELECT user_id, min(epoch)::INT AS stop_epoch FROM s WHERE best < 10 AND since >= 5 GROUP BY 1"
)
def early_stop(spark, sf):
    return runs.early_stop(table(spark, sf, "events"), ["user_id"], ["ts", "event_id"], "value", 5, below=10)


@query(
    "SELECT user_id, event_id, round(CASE WHEN coalesce(am, 0) + 2 * m + coalesce(bm, 0) > 0 THEN (coalesce(a * am, 0) + 2 * value * m + coalesce(b * bm, 0)) / (coalesce(am, 0) + 2 * m + coalesce(bm, 0)) ELSE (coalesce(a, 0) + value + coalesce(b, 0)) / (1 + (a IS NOT NULL)::INT + (b IS NOT NULL)::INT) END, 6) AS smooth "
    "FROM (SELECT *, lag(value) OVER w AS a, lead(value) OVER w AS b, lag(m) OVER w AS am, lead(m) OVER w AS bm FROM (SELECT *, (event_id % 3)::DOUBLE AS m FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))"
)
def smooth_121(spark, sf):
    told = table(spark, sf, "events").withColumn("m", (F.col("event_id") % 3).cast("double"))
    return runs.smooth(told, ["user_id"], ["ts", "event_id"], "value", "m").select("user_id", "event_id", F.round("smooth", 6).alias("smooth"))


@query("SELECT user_id, max(CASE WHEN value >= 0.25 * m THEN event_id END) AS last FROM (SELECT *, max(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS m FROM events) GROUP BY 1")
def last_above_max(spark, sf):
    return runs.last_above(table(spark, sf, "events"), ["user_id"], "event_id", "value")


_FOLDS = "SELECT source, ((row_number() OVER (ORDER BY source) - 1) % 4)::INT AS fold FROM (SELECT DISTINCT source FROM documents)"


@query(_FOLDS)
def fold_assign(spark, sf):
    return runs.folds(table(spark, sf, "documents"), "source", 4)


@query(f"SELECT j::INT AS left_out, count(*) AS n_docs, sum(n_chars)::BIGINT AS n_chars FROM documents JOIN ({_FOLDS}) USING (source), (SELECT unnest(range(4)) AS j) WHERE j <> fold GROUP BY 1")
def fold_except(spark, sf):
    docs = table(spark, sf, "documents")
    totals = docs.groupBy("source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("c")).join(runs.folds(docs, "source", 4), "source")
    return runs.all_but_fold(totals, "fold", 4).groupBy("left_out").agg(F.sum("n").alias("n_docs"), F.sum("c").alias("n_chars"))


@query("SELECT event_type, max(struct_pack(ts := ts, event_id := -event_id)).ts AS ts, -max(struct_pack(ts := ts, event_id := -event_id)).event_id AS event_id FROM events GROUP BY 1")
def newest_kept(spark, sf):
    return runs.newest(table(spark, sf, "events"), ["event_type"], "ts", "event_id").select("event_type", "ts", "event_id")


# --- aggregates ---------------------------------------------------------------------------------------------------


@query(
    "WITH h AS (SELECT lang, (n_chars // 100)::BIGINT AS idx, count(*)::BIGINT AS mass FROM documents GROUP BY 1, 2), c AS (SELECT *, sum(mass) OVER (PARTITION BY lang ORDER BY idx) AS cum, sum(mass) OVER (PARTITION BY lang) AS total FROM h) "
    "SELECT lang, min(idx) FILTER (cum >= floor(total * 0.5 + 0.5)) AS idx, max(total)::BIGINT AS mass FROM c GROUP BY 1"
)
def hist_quantile(spark, sf):
    told = table(spark, sf, "documents").groupBy("lang", F.floor(F.col("n_chars") / 100).alias("idx")).agg(F.count("*").alias("mass"))
    return stats.quantile_index(told, ("lang",), 0.5)


@query("SELECT event_type, bin, cnt FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY cnt DESC, bin) AS r FROM (SELECT event_type, (extract(hour FROM ts) // 6)::INT AS bin, count(*) AS cnt FROM events GROUP BY 1, 2)) WHERE r = 1")
def majority_bin(spark, sf):
    told = table(spark, sf, "events").select("event_type", F.floor(F.hour("ts") / 6).cast("int").alias("bin"))
    return stats.majority(told, ("event_type",), "bin")


@query(
    "WITH v AS (SELECT user_id, list_sort(list(value)) AS x FROM events GROUP BY 1), s AS (SELECT user_id, list_slice(x, len(x) // 4 + 1, len(x) // 4 + greatest(1, 3 * len(x) // 4 - len(x) // 4)) AS y FROM v) SELECT user_id, round(greatest(list_sum(y) / len(y), 20.0), 6) AS mean FROM s"
)
def trimmed_mean(spark, sf):
    told = table(spark, sf, "events").groupBy("user_id").agg(F.collect_list("value").alias("x"))
    return told.select("user_id", F.round(N.trimmed_mean(F.col("x"), 20.0), 6).alias("mean"))


@query("SELECT lang, CASE WHEN max(x) - min(x) < 2 THEN 'inf'::DOUBLE ELSE round(regr_slope(y, x), 6) END AS slope, round(CASE WHEN max(x) - min(x) < 2 THEN avg(x) ELSE regr_intercept(y, x) END, 4) AS intercept FROM (SELECT lang, len(regexp_extract_all(text, '\\p{L}[\\p{L}\\p{M}]*'))::DOUBLE AS x, n_chars::DOUBLE AS y FROM documents) GROUP BY 1")
def lin_reg(spark, sf):
    told = table(spark, sf, "documents").select("lang", F.size(T.words(F.col("text"))).cast("double").alias("x"), F.col("n_chars").cast("double").alias("y"))
    return stats.regression(told, ("lang",), "x", "y").select("lang", F.round("slope", 6).alias("slope"), F.round("intercept", 4).alias("intercept"))


@query("SELECT count(*) AS n, round(sqrt(avg(pow(x - y, 2))), 6) AS rmse FROM (SELECT unnest(a.embedding)::DOUBLE AS x, unnest(b.embedding)::DOUBLE AS y FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)")
def matrix_rmse(spark, sf):
    v = table(spark, sf, "embeddings")
    b = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    told = v.join(b, "vec_id").select(F.explode(F.arrays_zip(F.col("embedding").alias("x"), F.col("other").alias("y"))).alias("p")).select(F.col("p.x").cast("double").alias("x"), F.col("p.y").cast("double").alias("y"))
    return told.agg(F.count("*").alias("n"), F.round(N.rmse(F.col("x"), F.col("y")), 6).alias("rmse"))


@query("SELECT vec_id, round(exp(x) / sum(exp(x)) OVER (PARTITION BY vec_id), 6) AS p, pos::INT AS pos FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings)")
def softmax_rows(spark, sf):
    v = table(spark, sf, "embeddings").select("vec_id", N.softmax(F.col("embedding").cast("array<double>")).alias("p"))
    return v.select("vec_id", F.posexplode("p").alias("pos", "p")).select("vec_id", F.round("p", 6).alias("p"), "pos")


@query("SELECT vec_id, greatest(-128, least(127, floor(127.5 * (x + 1) - 128)))::INT AS q, pos::INT AS pos FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings)")
def quantised(spark, sf):
    v = table(spark, sf, "embeddings").select("vec_id", F.posexplode(F.col("embedding").cast("array<double>")).alias("pos", "x"))
    return v.select("vec_id", N.quantise(F.col("x"), -1.0, 1.0, 8).alias("q"), "pos")


# --- evaluation ---------------------------------------------------------------------------------------------------

_PAIRS = "(SELECT a.conv_id, a.turn, a.text AS ref, b.text AS hyp FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 WHERE a.text IS NOT NULL AND b.text IS NOT NULL)"


def _pairs(spark, sf):
    """All neighbouring turns at full length."""
    c = table(spark, sf, "conversations").where("text is not null")
    b = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("hyp"))
    return c.select("conv_id", "turn", F.col("text").alias("ref")).join(b, ["conv_id", "turn"])


@query(
    f"WITH {_ascii('conversations')}, e AS (SELECT conv_id, levenshtein(translate(ref, f, t), translate(hyp, f, t)) AS e, length(ref) AS n FROM {_PAIRS}, ascii) "
    "SELECT conv_id, sum(e)::BIGINT AS errors, sum(n)::BIGINT AS length, round(sum(e) / nullif(sum(n), 0), 6) AS cer FROM e GROUP BY 1"
)
def cer_pairs(spark, sf):
    return E.error_rate(_pairs(spark, sf), ("conv_id",)).withColumn("cer", F.round("cer", 6))


#: Edit distances of all pairs by words: row i of the table of costs from row i - 1, for all pairs at once.
_WORD_EDITS = (
    "WITH RECURSIVE w AS MATERIALIZED (SELECT conv_id, turn, list_filter(regexp_split_to_array(ref, ' +'), lambda x: x <> '') AS a, list_filter(regexp_split_to_array(hyp, ' +'), lambda x: x <> '') AS b FROM " + _PAIRS + "), "
    "r AS (SELECT conv_id, turn, 0::BIGINT AS i, range(len(b) + 1)::BIGINT[] AS row FROM w UNION ALL "
    "SELECT r.conv_id, r.turn, r.i + 1, list_reduce(list_transform(range(1, len(b) + 1), lambda j: [least(r.row[j + 1] + 1, r.row[j] + (a[r.i + 1] <> b[j])::BIGINT)]), lambda acc, x: list_append(acc, least(x[1], acc[len(acc)] + 1)), [r.i + 1]) "
    "FROM r JOIN w USING (conv_id, turn) WHERE r.i < len(a)), "
    "d AS MATERIALIZED (SELECT conv_id, turn, len(a)::BIGINT AS n_ref, len(b)::BIGINT AS n_hyp, r.row[len(b) + 1] AS errors FROM r JOIN w USING (conv_id, turn) WHERE r.i = len(a)) "
)


@query(_WORD_EDITS + "SELECT conv_id, sum(errors)::BIGINT AS errors, sum(n_ref)::BIGINT AS length, round(sum(errors) / nullif(sum(n_ref), 0), 6) AS wer FROM d GROUP BY 1")
def wer_pairs(spark, sf):
    return E.word_error_rate(_pairs(spark, sf), ("conv_id",)).withColumn("wer", F.round("wer", 6))


_RANKED = "SELECT lang, doc_id, row_number() OVER w AS rank, sum(rel) OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id ROWS UNBOUNDED PRECEDING) AS tp, sum(rel) OVER (PARTITION BY lang) AS every, rel FROM (SELECT lang, doc_id, n_chars, (quality = 1)::INT AS rel FROM documents JOIN labels USING (doc_id)) WINDOW w AS (PARTITION BY lang ORDER BY n_chars DESC, doc_id)"


def _ranked(spark, sf):
    return table(spark, sf, "documents").select("lang", "doc_id", "n_chars").join(table(spark, sf, "labels"), "doc_id").withColumn("rel", F.col("quality") == 1)


@query(f"SELECT lang, doc_id, rank::INT AS rank, tp::BIGINT AS tp, round(tp / rank, 6) AS precision, round(CASE WHEN every > 0 THEN tp / every END, 6) AS recall FROM ({_RANKED})")
def pr_curve(spark, sf):
    out = E.ranking(_ranked(spark, sf), ["lang"], "n_chars", "doc_id", "rel")
    return out.select("lang", "doc_id", "rank", "tp", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


@query(f"SELECT lang, sum(rel)::BIGINT AS n_relevant, round(coalesce(avg(tp / rank) FILTER (rel = 1), 0), 6) AS ap FROM ({_RANKED}) GROUP BY 1")
def avg_precision(spark, sf):
    return E.average_precision(_ranked(spark, sf), ["lang"], "n_chars", "doc_id", "rel").withColumn("ap", F.round("ap", 6))


@query("SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN a.doc_id IS NULL THEN 'FN' WHEN b.doc_id IS NULL THEN 'FP' ELSE 'TP' END AS kind FROM (SELECT DISTINCT doc_id FROM documents WHERE contains(text, 'idiot')) a FULL JOIN (SELECT DISTINCT doc_id FROM labels WHERE toxic = 1) b ON a.doc_id = b.doc_id")
def match_types(spark, sf):
    found = table(spark, sf, "documents").where(F.contains(F.col("text"), F.lit("idiot")))
    return E.match_types(found, table(spark, sf, "labels").where("toxic = 1"), ["doc_id"])


@query("SELECT doc_id, quality, n_chars FROM documents JOIN labels USING (doc_id)")
def file_join_strict(spark, sf):
    labels = table(spark, sf, "labels").select("doc_id", "quality")
    docs = table(spark, sf, "documents").select("doc_id", "n_chars").join(labels.select("doc_id"), "doc_id", "left_semi")
    return E.unique_join(labels, docs, "doc_id")


# --- options, geometry, graphs -------------------------------------------------------------------------------------


@query("SELECT event_id, 'user' AS key_user, user_id::VARCHAR AS v_user, (props->>'$.k') AS v_k, 2::INT AS n FROM events")
def tree_options(spark, sf):
    base = F.create_map(F.lit("net/user"), F.col("user_id").cast("string"), F.lit("net/k"), F.lit("old"), F.lit("other"), F.lit("x"))
    own = F.create_map(F.lit("net/k"), F.get_json_object("props", "$.k"))
    tree = O.subtree_map(O.merge_maps(own, base), "net")
    return table(spark, sf, "events").select("event_id", tree.alias("m")).select("event_id", F.lit("user").alias("key_user"), F.col("m")["user"].alias("v_user"), F.col("m")["k"].alias("v_k"), F.size("m").alias("n"))


_POINTS = "(SELECT vec_id, list_transform(range(len(embedding)), lambda i: struct_pack(x := (i * 20)::INT, y := floor(embedding[i + 1]::DOUBLE * 200)::INT)) AS p FROM embeddings)"


def _points(spark, sf):
    """A point for each coordinate of the embedding."""
    at = lambda e, i: F.struct((i * 20).alias("x"), F.floor(e.cast("double") * 200).cast("int").alias("y"))
    return table(spark, sf, "embeddings").select("vec_id", F.transform("embedding", at).alias("p"))


@query(f"SELECT vec_id, list_aggregate(list_transform(p, lambda q: q.x || ',' || q.y), 'string_agg', ' ') AS points FROM {_POINTS}")
def polygon_text(spark, sf):
    return _points(spark, sf).select("vec_id", G.print_points(G.parse_points(G.print_points(F.col("p")))).alias("points"))


@query(f"SELECT vec_id, round((list_sum(list_transform(p, lambda q: q.y)) * 2 - p[1].y - p[len(p)].y) / (2.0 * len(p) - 2), 6) AS avg_y, list_min(list_transform(p, lambda q: q.y)) - 20 AS y0, list_max(list_transform(p, lambda q: q.y)) + 20 AS y1 FROM {_POINTS}")
def baseline_stats(spark, sf):
    b = G.bounds(F.col("p"), 5, 20)
    return _points(spark, sf).select("vec_id", F.round(G.average_y(F.col("p")), 6).alias("avg_y"), b.y0.alias("y0"), b.y1.alias("y1"))


#: Every rasterised point, in order: k unit steps of the longer axis from a corner to the next, and the last corner.
_RASTER = (
    "(SELECT vec_id, row_number() OVER (PARTITION BY vec_id ORDER BY i, k) AS pos, x, y FROM (SELECT vec_id, i, k, floor(a.x + (b.x - a.x) * k::DOUBLE / s + 0.5)::INT AS x, floor(a.y + (b.y - a.y) * k::DOUBLE / s + 0.5)::INT AS y FROM "
    "(SELECT *, unnest(range(s)) AS k FROM (SELECT *, greatest(abs(b.x - a.x), abs(b.y - a.y)) AS s FROM (SELECT vec_id, i, p[i] AS a, p[i + 1] AS b FROM (SELECT vec_id, p, unnest(range(1, len(p))) AS i FROM " + _POINTS + ")))) "
    "UNION ALL SELECT vec_id, len(p), 0, p[len(p)].x, p[len(p)].y FROM " + _POINTS + "))"
)


@query(f"SELECT vec_id, count(*)::INT AS n, sum(x)::BIGINT AS sum_x, sum(y)::BIGINT AS sum_y, sum(pos * y)::BIGINT AS in_order FROM {_RASTER} GROUP BY 1")
def raster_sizes(spark, sf):
    """Of the rasterised points their number and sums; the last weighs each with its place."""
    r = _points(spark, sf).select("vec_id", F.posexplode(G.raster(F.col("p"))).alias("pos", "q"))
    return r.groupBy("vec_id").agg(F.count("*").cast("int").alias("n"), F.sum("q.x").alias("sum_x"), F.sum("q.y").alias("sum_y"), F.sum((F.col("pos") + 1).cast("long") * F.col("q.y")).alias("in_order"))


@query(
    "WITH RECURSIVE l AS (SELECT DISTINCT md5(line) AS h, doc_id FROM " + _LINES + " WHERE line <> ''), m AS (SELECT h, min(doc_id) AS low FROM l GROUP BY 1 HAVING count(*) > 1), e AS (SELECT DISTINCT l.doc_id AS a, m.low AS b FROM l JOIN m USING (h) WHERE l.doc_id <> m.low), "
    "s AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r(node, other) AS (SELECT a, b FROM s UNION SELECT r.node, s.b FROM r JOIN s ON r.other = s.a) SELECT node, least(node, min(other)) AS component FROM r GROUP BY 1"
)
def components(spark, sf):
    """Over all shared lines that are not empty."""
    lines = search.line_table(table(spark, sf, "documents")).where(F.length("line") > 0).select(F.xxhash64("line").alias("h"), F.md5(F.col("line").cast("binary")).alias("m"), "doc_id").distinct()
    low = lines.groupBy("h", "m").agg(F.min("doc_id").alias("b"), F.count("*").alias("n")).where("n > 1")
    edges = lines.join(low, ["h", "m"]).where("doc_id <> b").select(F.col("doc_id").alias("a"), "b").distinct()
    return graph.components(edges)


@query()
def greedy_match(spark, sf):
    """All turns at full length; pairs whose lengths alone put the cost at the limit are left out before the distance."""
    c = table(spark, sf, "conversations")
    a = c.where("role = 'user'").select("conv_id", F.col("turn").alias("i"), F.col("text").alias("x"))
    b = c.where("role = 'assistant'").select("conv_id", F.col("turn").alias("j"), F.col("text").alias("y"))
    longer = F.greatest(F.length("x"), F.length("y"), F.lit(1))
    cost = F.levenshtein("x", "y") / longer
    near = a.join(b, "conv_id").where(F.abs(F.length("x") - F.length("y")) / longer < 0.9)
    return graph.greedy_match(near.select("conv_id", "i", "j", cost.alias("cost")), ["conv_id"], 0.9)


@query(_WORD_EDITS + "SELECT conv_id, turn, errors, n_ref, n_hyp FROM d")
def dp_align(spark, sf):
    """Of each pair's cheapest path its cost, and the words of either side that its steps pass."""
    told = _pairs(spark, sf).select("conv_id", "turn", T.wer_tokens(F.col("ref")).alias("a"), T.wer_tokens(F.col("hyp")).alias("b"))
    steps = lambda *ops: F.size(F.filter("path", lambda s: s.op.isin(*ops))).cast("long")
    path = told.select("conv_id", "turn", graph.alignment(F.col("a"), F.col("b")).alias("path"))
    cost = F.coalesce(F.try_element_at("path", F.lit(-1)).cost, F.lit(0.0)).cast("long")
    return path.select("conv_id", "turn", cost.alias("errors"), steps("COR", "SUB", "DEL").alias("n_ref"), steps("COR", "SUB", "INS").alias("n_hyp"))


_CORNERS = (
    "(SELECT vec_id, {0} AS side, c.x AS x, c.y AS y FROM (SELECT vec_id, p, p[k] AS c, k FROM (SELECT vec_id, p, unnest(range(1, len(p) + 1)) AS k FROM " + _POINTS + ")) WHERE len(list_filter(range(1, k), lambda i: "
    "len(list_filter(range(k + 1, len(p) + 1), lambda j: {1} * ((p[j].x - p[i].x)::BIGINT * (c.y - p[i].y) - (p[j].y - p[i].y)::BIGINT * (c.x - p[i].x)) <= 0)) > 0)) = 0)"
)


@query(
    "WITH h AS (" + _CORNERS.format("1", "1") + " UNION ALL " + _CORNERS.format("-1", "-1") + "), s AS (SELECT *, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM h WINDOW w AS (PARTITION BY vec_id, side ORDER BY x)) "
    "SELECT vec_id, (count(*) - 2)::INT AS n, sum(side * (coalesce(x2, x) - x)::BIGINT * (y + coalesce(y2, y)))::BIGINT AS area2 FROM s GROUP BY 1"
)
def convex_hull(spark, sf):
    """Corners of the hull and twice its area."""
    h = _points(spark, sf).select("vec_id", G.convex_hull(F.col("p")).alias("h"))
    after = lambda i: F.element_at("h", (F.pmod(i + 1, F.size("h")) + 1).cast("int"))
    turns = F.transform("h", lambda q, i: q.x.cast("long") * after(i).y - q.y.cast("long") * after(i).x)
    return h.select("vec_id", F.size("h").alias("n"), F.abs(F.aggregate(turns, F.lit(0).cast("long"), lambda a, v: a + v)).alias("area2"))


@query(
    f"WITH RECURSIVE r AS MATERIALIZED (SELECT vec_id, list(x ORDER BY pos) AS xs, list(y ORDER BY pos) AS ys FROM {_RASTER} GROUP BY 1), "
    "w(vec_id, i, sx, sy, dx, dy, n) AS (SELECT vec_id, 3::BIGINT, xs[1], ys[1], xs[1] - xs[2], ys[1] - ys[2], 1 FROM r UNION ALL SELECT vec_id, i + 1, CASE WHEN same THEN sx ELSE xs[i - 1] END, CASE WHEN same THEN sy ELSE ys[i - 1] END, "
    "CASE WHEN same THEN dx ELSE xs[i - 1] - xs[i] END, CASE WHEN same THEN dy ELSE ys[i - 1] - ys[i] END, n + (NOT same)::INT FROM (SELECT w.*, xs, ys, (sx - xs[i])::BIGINT * dy = dx::BIGINT * (sy - ys[i]) AS same FROM w JOIN r USING (vec_id) WHERE i <= len(xs))) "
    "SELECT vec_id, max(n)::INT + 1 AS n FROM w GROUP BY 1"
)
def collinear_reduced(spark, sf):
    """How many rasterised points are left where runs of one direction are joined."""
    out = G.collinear_rows(_points(spark, sf), "p", rastered=True)
    return out.select("vec_id", F.size("p").alias("n"))


_BACK = "SELECT vec_id, round(sqrt(avg(pow(b - x, 2))), 9) AS {0} FROM (SELECT vec_id, x, (q + {1} + 0.5) * ({2} / ({1} * 2.0 - 1)) + {3} AS b FROM (SELECT vec_id, x, greatest(-{1}, least({1} - 1, floor(({1} * 2.0 - 1) / {2} * (x - {3}) - {1}))) AS q FROM (SELECT vec_id, {4} AS x FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS e FROM embeddings)))) GROUP BY 1"


@query("SELECT * FROM (" + _BACK.format("rmse_byte", "128", "1.0", "0.0", "(e + 1) / 2") + ") JOIN (" + _BACK.format("rmse_short", "32768", "4.0", "-4.0", "-abs(e)") + ") USING (vec_id)")
def codec_rt(spark, sf):
    """What a matrix of each vector loses on its way through the byte form and the short form of feature files."""
    from vellumflow.sources import codecs

    def back(name: str, of, kind: str, **how):
        told = table(spark, sf, "embeddings").select("vec_id", N.deep(F.transform("embedding", lambda x: of(x.cast("double"))), 8).alias("matrix"))
        raw = codecs.encoded_matrices(told, kind, **how).select("vec_id", F.flatten("matrix").alias("x"), "raw")
        pairs = codecs.decoded_matrices(raw).select("vec_id", F.inline(F.arrays_zip("x", F.flatten("matrix").alias("b"))))
        return pairs.groupBy("vec_id").agg(F.round(N.rmse(F.col("b"), F.col("x")), 9).alias(name))

    return back("rmse_byte", lambda x: (x + 1) / 2, codecs.BYTE).join(back("rmse_short", lambda x: -F.abs(x), codecs.SHORT_LOG, least=-4), "vec_id")
