"""Registered queries of layout, training reports, matrices and file forms, each with its DuckDB SQL."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from vellumflow.functions import geometry as G
from vellumflow.functions import numeric as N
from vellumflow.functions import text as T
from vellumflow.operators import confmats, layout, pages, stats, training
from vellumflow.operators import evaluate as E
from vellumflow.plans.catalog import _PAIRS, _POINTS, _RASTER, _ascii, _pairs, _points, query, table
from vellumflow.sources import codecs, files

_TEXT = "list_aggregate(list_transform({0}, lambda q: q.x::INT || ',' || q.y::INT), 'string_agg', ' ')"
_COARSE = "(SELECT vec_id, list_transform(range(len(embedding)), lambda i: struct_pack(x := (i // 2 * 20)::INT, y := floor(embedding[i + 1]::DOUBLE * 4)::INT)) AS p FROM embeddings)"


@query(
    f"SELECT vec_id, {_TEXT.format('list_reverse(p)')} AS reversed, {_TEXT.format('list_transform(p, lambda q: struct_pack(x := trunc(q.x / 3.0), y := trunc(q.y / 3.0)))')} AS scaled, "
    f"{_TEXT.format('list_transform(range(10), lambda i: p[(floor(i * (len(p) - 1) / 9.0) + 1)::INT])')} AS thinned, {_TEXT.format('p[17:32]')} AS part, "
    f"{_TEXT.format(f'list_transform(p, lambda q: struct_pack(x := trunc(q.x * {math.cos(0.3)!r}::DOUBLE - q.y * {math.sin(0.3)!r}::DOUBLE), y := trunc(q.x * {math.sin(0.3)!r}::DOUBLE + q.y * {math.cos(0.3)!r}::DOUBLE)))')} AS rotated FROM {_POINTS}"
)
def point_edits(spark, sf):
    p = F.col("p")
    made = {"reversed": G.reverse(p), "scaled": G.scaled_down(p, 3.0), "thinned": G.thinned(p, 7), "part": G.part(p, F.lit(0.25), F.lit(0.5)), "rotated": G.rotated(p, 0.3)}
    return _points(spark, sf).select("vec_id", *[G.print_points(c).alias(n) for n, c in made.items()])


@query(f"SELECT vec_id, {_TEXT.format('list_filter(p, lambda q, i: i = 1 OR q <> p[i - 1])')} AS points FROM {_COARSE}")
def no_repeats(spark, sf):
    at = lambda e, i: F.struct((F.floor(i / 2) * 20).cast("int").alias("x"), F.floor(e.cast("double") * 4).cast("int").alias("y"))
    p = table(spark, sf, "embeddings").select("vec_id", F.transform("embedding", at).alias("p"))
    return p.select("vec_id", G.print_points(G.no_repeats(F.col("p"))).alias("points"))


@query(f"SELECT vec_id, round((atan(regr_slope(-q.y, q.x)) + {2 * math.pi!r}) % {2 * math.pi!r}, 6) AS angle FROM (SELECT vec_id, unnest(p) AS q FROM {_POINTS}) GROUP BY 1")
def line_angles(spark, sf):
    rows = _points(spark, sf).select("vec_id", F.posexplode("p").alias("i", "q")).select("vec_id", "i", "q.x", "q.y")
    return G.orientation(rows, ["vec_id"]).select("vec_id", F.round("angle", 6).alias("angle"))


@query(f"SELECT vec_id, x, min(y) AS top, max(y) AS bottom FROM {_RASTER} GROUP BY 1, 2")
def envelopes(spark, sf):
    rows = _points(spark, sf).select("vec_id", F.explode(G.raster(F.col("p"))).alias("q")).select("vec_id", "q.x", "q.y")
    return G.envelope(rows, ["vec_id"])


@query("SELECT event_id, round(least(CASE WHEN v > 0 THEN v ELSE m END, m) * 0.5, 6) AS tolerance FROM (SELECT event_id, v, avg(v) FILTER (v > 0) OVER (PARTITION BY event_type) AS m FROM (SELECT *, CASE WHEN event_id % 4 = 0 THEN 0 ELSE value END AS v FROM events))")
def tolerances(spark, sf):
    told = table(spark, sf, "events").withColumn("v", F.when(F.col("event_id") % 4 == 0, 0.0).otherwise(F.col("value")))
    return G.filled_tolerances(told, ["event_type"], "v", 0.5).select("event_id", F.round("tolerance", 6).alias("tolerance"))


_SNAP = "CASE WHEN abs(a - {0}) < 0.02 THEN {0} ELSE {1} END"


@query(
    "SELECT vec_id, round(CASE WHEN abs(o) < 0.02 THEN 0 ELSE o END, 6) AS angle, CASE WHEN abs(b) <= pi() / 4 THEN 0.0 ELSE pi() / 2 END AS quarter, round(x * cos(0.7) - y * sin(0.7), 6) AS along, round(x * sin(0.7) + y * cos(0.7), 6) AS off FROM (SELECT *, coalesce("
    + _SNAP.format("(3 * pi() / 2)", _SNAP.format("(pi() / 2)", _SNAP.format("pi()", "a")))
    + ", b) AS o FROM (SELECT vec_id, CASE WHEN vec_id % 3 > 0 THEN (vec_id % 4) * pi() / 2 + embedding[1]::DOUBLE / 8 END AS a, embedding[2]::DOUBLE * 8 AS b, embedding[3]::DOUBLE AS x, embedding[4]::DOUBLE AS y FROM embeddings))"
)
def snapped_lines(spark, sf):
    e = lambda i: F.get("embedding", i).cast("double")
    a = F.when(F.col("vec_id") % 3 > 0, (F.col("vec_id") % 4) * math.pi / 2 + e(0) / 8)
    at = G.offsets(e(2), e(3), 0.7)
    return table(spark, sf, "embeddings").select("vec_id", F.round(G.line_orientation(a, e(1) * 8), 6).alias("angle"), G.snapped(e(1) * 8).alias("quarter"), F.round(at.along, 6).alias("along"), F.round(at.off, 6).alias("off"))


_PAGE_LINES = f"(SELECT vec_id // 10 AS page, vec_id AS line, p[1:16] AS points FROM {_POINTS})"


def _page_lines(spark, sf):
    return _points(spark, sf).select(F.floor(F.col("vec_id") / 10).alias("page"), F.col("vec_id").alias("line"), F.slice("p", 1, 16).alias("points"))


@query(
    f"WITH l AS {_PAGE_LINES}, d AS (SELECT a.page, a.line, b.line AS other, list_min(list_transform(a.points, lambda p: list_min(list_transform(b.points, lambda q: abs(p.x - q.x) + abs(p.y - q.y))))) AS distance FROM l a JOIN l b ON a.page = b.page AND a.line <> b.line) "
    "SELECT page, line, other, distance FROM (SELECT *, row_number() OVER (PARTITION BY page, line ORDER BY distance, other) AS r FROM d) WHERE r = 1"
)
def nearest_lines(spark, sf):
    return layout.nearest_lines(_page_lines(spark, sf))


@query(
    f"WITH l AS {_PAGE_LINES}, d AS (SELECT a.page, a.line, list_transform(a.points, lambda p: list_min(list_transform(b.points, lambda q: abs(p.x - q.x) + abs(p.y - q.y)))) AS d FROM l a JOIN l b ON a.page = b.page AND a.line <> b.line), "
    "e AS (SELECT page, line, pos, min(v) AS v FROM (SELECT page, line, unnest(d) AS v, generate_subscripts(d, 1) AS pos FROM d) GROUP BY ALL), s AS (SELECT page, line, list_sort(list(v::DOUBLE)) AS x FROM e GROUP BY ALL) "
    "SELECT page, line, round(greatest(list_avg(x[5:12]), 20.0), 6) AS tolerance FROM s"
)
def line_tolerances(spark, sf):
    return layout.line_tolerances(_page_lines(spark, sf), 1 << 20).withColumn("tolerance", F.round("tolerance", 6))


_SPOTS = "(SELECT vec_id, label, vec_id // 10 AS page, (vec_id // 10) % 4 AS turn, floor(embedding[1]::DOUBLE * 200)::INT AS x, floor(embedding[2]::DOUBLE * 200)::INT AS y, floor(embedding[3]::DOUBLE * 200)::INT AS x2, floor(embedding[4]::DOUBLE * 200)::INT AS y2 FROM embeddings)"


def _spots(spark, sf):
    at = lambda i: F.floor(F.get("embedding", i).cast("double") * 200).cast("int")
    page = F.floor(F.col("vec_id") / 10)
    return table(spark, sf, "embeddings").select("vec_id", "label", page.alias("page"), (page % 4).alias("turn"), at(0).alias("x"), at(1).alias("y"), at(2).alias("x2"), at(3).alias("y2"))


@query(f"SELECT vec_id, row_number() OVER (PARTITION BY page ORDER BY CASE turn WHEN 0 THEN y WHEN 1 THEN -x WHEN 2 THEN -y ELSE x END, vec_id)::INT AS rank FROM {_SPOTS}")
def reading_ranks(spark, sf):
    told = _spots(spark, sf).withColumn("angle", F.col("turn") * math.pi / 2)
    return layout.reading_rank(told, ["page"], "angle", "x", "y", "vec_id").select("vec_id", "rank")


@query(f"SELECT vec_id, row_number() OVER (PARTITION BY page ORDER BY low, label, vec_id)::INT AS rank FROM (SELECT *, min(x) OVER (PARTITION BY page, label) AS low FROM {_SPOTS})")
def left_to_right(spark, sf):
    return layout.clusters_left_to_right(_spots(spark, sf), ["page"], "label", "x", "vec_id").select("vec_id", "rank")


@query(
    f"WITH b AS (SELECT page, vec_id, least(x, x2) AS x0, greatest(x, x2) AS x1, least(y, y2) AS y0, greatest(y, y2) AS y1 FROM {_SPOTS}) SELECT a.page, a.vec_id AS line, b.vec_id AS other FROM b a JOIN b ON a.page = b.page AND a.vec_id <> b.vec_id "
    "WHERE a.x0 - 3 <= b.x1 + 3 AND b.x0 - 3 <= a.x1 + 3 AND a.y0 - 3 <= b.y1 + 3 AND b.y0 - 3 <= a.y1 + 3"
)
def meeting_boxes(spark, sf):
    point = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    lines = _spots(spark, sf).select("page", F.col("vec_id").alias("line"), F.array(point("x", "y"), point("x2", "y2")).alias("points"))
    return layout.line_pairs(lines, 6).select("page", "line", "other")


_PIXELS = "(SELECT vec_id, floor((e::DOUBLE + 1) * 127)::INT AS v, x - 1 AS x FROM (SELECT vec_id, unnest(embedding) AS e, generate_subscripts(embedding, 1) AS x FROM embeddings))"


def _pixels(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", F.lit(0).alias("y"), F.posexplode("embedding").alias("x", "e")).select("vec_id", "y", "x", F.floor((F.col("e").cast("double") + 1) * 127).cast("int").alias("v"))


@query(f"SELECT vec_id, (x // 16)::INT AS cell, 0 AS y, sum(255 - v)::BIGINT AS ink FROM {_PIXELS} WHERE x % 3 = 0 GROUP BY 1, 2")
def ink_cells(spark, sf):
    return layout.shrunk(_pixels(spark, sf), ["vec_id"], 16)


@query(f"SELECT vec_id, round(avg(v) FILTER (x < 5), 6) AS first, round(avg(v) FILTER (x >= 59), 6) AS last FROM {_PIXELS} GROUP BY 1")
def side_means(spark, sf):
    return layout.side_means(_pixels(spark, sf), ["vec_id"], 5).select("vec_id", F.round("first", 6).alias("first"), F.round("last", 6).alias("last"))


@query("SELECT vec_id, round(sum(exp(e::DOUBLE)), 6) AS total, round(sum(ln(abs(e::DOUBLE) + 1)), 6) AS logs FROM (SELECT vec_id, unnest(embedding) AS e FROM embeddings) GROUP BY 1")
def exp_log(spark, sf):
    m = N.deep(F.col("embedding").cast("array<double>"), 8)
    total = lambda c: F.round(F.aggregate(F.flatten(c), F.lit(0.0), lambda a, x: a + x), 6)
    return table(spark, sf, "embeddings").select("vec_id", total(layout.elementwise(m, F.exp)).alias("total"), total(layout.elementwise(m, lambda x: F.ln(F.abs(x) + 1))).alias("logs"))


# --- training reports ---------------------------------------------------------------------------------------------


@query("SELECT event_type, extract(hour FROM ts)::INT AS epoch, round(sum(CASE WHEN value < 5 THEN 1 ELSE 0 END) / count(*), 6) AS rate FROM events GROUP BY 1, 2")
def epoch_rates(spark, sf):
    told = table(spark, sf, "events").select("event_type", F.hour("ts").alias("epoch"), F.when(F.col("value") < 5, 1).otherwise(0).alias("bad"), F.lit(1).alias("all"))
    return training.error_rates(told, ["event_type", "epoch"], "bad", "all").withColumn("rate", F.round("rate", 6))


@query("SELECT user_id, round(sum(value) / nullif(sum(event_id % 3), 0), 6) AS mean FROM events GROUP BY 1")
def run_time_means(spark, sf):
    told = table(spark, sf, "events").withColumn("n", F.col("event_id") % 3)
    return training.mean_run_time(told, ["user_id"], "value", "n").withColumn("mean", F.round("mean", 6))


@query("SELECT kind, count(*) AS n FROM (SELECT CASE WHEN a.doc_id IS NULL THEN 'FN' WHEN b.doc_id IS NULL THEN 'FP' ELSE 'TP' END AS kind FROM (SELECT DISTINCT doc_id FROM documents WHERE contains(text, 'idiot')) a FULL JOIN (SELECT DISTINCT doc_id FROM labels WHERE toxic = 1) b ON a.doc_id = b.doc_id) GROUP BY 1")
def match_counts(spark, sf):
    found = table(spark, sf, "documents").where(F.contains(F.col("text"), F.lit("idiot")))
    return training.match_counts(E.match_types(found, table(spark, sf, "labels").where("toxic = 1"), ["doc_id"]), "kind")


@query("SELECT user_id % 10 AS unit, event_id % 3 AS dy, event_id % 5 AS dx, round(avg(value), 6) AS weight FROM events GROUP BY ALL")
def merged_weights(spark, sf):
    told = table(spark, sf, "events").select((F.col("user_id") % 10).alias("unit"), (F.col("event_id") % 3).alias("dy"), (F.col("event_id") % 5).alias("dx"), F.col("value").alias("weight"))
    return training.merged_weights(told).withColumn("weight", F.round("weight", 6))


@query("SELECT event_id, strftime(ts, '%Y-%m-%d_%H:%M:%S') AS stamp, coalesce(CASE WHEN event_id % 2 = 0 THEN 'net' || event_id END, event_type || '.om:' || user_id || '.cm') AS label, md5(length(event_type) || ':' || event_type || '-1:') AS key FROM events")
def model_names(spark, sf):
    om, cm = F.concat(F.lit("/a/"), "event_type", F.lit(".om")), F.concat(F.lit("b/c/"), F.col("user_id").cast("string"), F.lit(".cm"))
    name = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("net"), F.col("event_id").cast("string")))
    key = training.model_key(F.col("event_type"), F.lit(None).cast("string"))
    return table(spark, sf, "events").select("event_id", training.stamp(F.col("ts")).alias("stamp"), training.model_label(name, om, cm).alias("label"), key.alias("key"))


@query(f"WITH {_ascii('conversations')} SELECT conv_id, turn, round(cer, 6) AS cer FROM (SELECT conv_id, turn, levenshtein(translate(ref, f, t), translate(hyp, f, t)) / length(ref)::DOUBLE AS cer FROM {_PAIRS}, ascii WHERE length(ref) > 0) WHERE cer > 0.8")
def bad_lines(spark, sf):
    """Lines whose error rate is above a bound, for a look at them."""
    told = E.error_rate(_pairs(spark, sf), ("conv_id", "turn")).where("cer > 0.8")
    return told.select("conv_id", "turn", F.round("cer", 6).alias("cer"))


# --- matrices -----------------------------------------------------------------------------------------------------

_MATS = "(SELECT vec_id, list_transform(range(8), lambda i: embedding[i * 8 + 1:i * 8 + 8]::DOUBLE[]) AS m FROM embeddings)"


def _mats(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", N.deep(F.col("embedding").cast("array<double>"), 8).alias("mat"))


@query(
    f"SELECT vec_id, coalesce(string_agg(substr('-abcdefg', c, 1), '' ORDER BY i), '') AS reading FROM (SELECT vec_id, c, i, coalesce(lag(c) OVER (PARTITION BY vec_id ORDER BY i), 0) AS before FROM (SELECT vec_id, i, list_position(m[i], list_min(m[i])) AS c FROM (SELECT vec_id, m, unnest(range(1, 9)) AS i FROM {_MATS}))) "
    "WHERE c > 1 AND c <> before GROUP BY 1 UNION ALL SELECT vec_id, '' FROM (SELECT vec_id, bool_and(list_position(x, list_min(x)) = 1) AS none FROM (SELECT vec_id, unnest(m) AS x FROM " + _MATS + ") GROUP BY 1) WHERE none"
)
def best_paths(spark, sf):
    chars = F.array(*map(F.lit, "-abcdefg"))
    return _mats(spark, sf).select("vec_id", confmats.best_path(F.col("mat"), chars).alias("reading"))


@query(f"SELECT vec_id, round(list_min(list_transform(m, lambda r: r[2])) + list_min(list_transform(m, lambda r: r[4])) + list_min(list_transform(m, lambda r: r[3])), 6) AS bound FROM {_MATS}")
def least_costs(spark, sf):
    return _mats(spark, sf).select("vec_id", F.round(confmats.least_cost(F.col("mat"), [1, 3, 2]), 6).alias("bound"))


@query("SELECT vec_id, CASE WHEN vec_id % 5 = 0 THEN label + 100 ELSE label END AS label FROM embeddings WHERE vec_id % 7 <> 0")
def changed_matrices(spark, sf):
    """New values for some keys, and others taken away."""
    v = table(spark, sf, "embeddings").select("vec_id", "label")
    new = v.where("vec_id % 5 = 0").withColumn("label", F.col("label") + 100)
    return pages.removed(pages.replaced(v, new, ["vec_id"], "label"), v.where("vec_id % 7 = 0"), ["vec_id"])[0].select("vec_id", "label")


# --- lines and files ----------------------------------------------------------------------------------------------


@query("SELECT conv_id, turn, CASE WHEN turn % 3 > 0 THEN text || '!' END AS text, CASE WHEN turn % 3 > 0 AND text IS NOT NULL THEN 'x' END AS custom FROM conversations")
def assigned_texts(spark, sf):
    told = table(spark, sf, "conversations").withColumn("custom", F.lit("x"))
    out = pages.with_text(told, F.when(F.col("turn") % 3 > 0, F.concat("text", F.lit("!"))))
    return out.select("conv_id", "turn", "text", "custom")


@query("SELECT conv_id, turn, replace(text, chr(10), '') AS text FROM conversations WHERE text IS NOT NULL")
def transcripts(spark, sf):
    return pages.transcribed(table(spark, sf, "conversations")).select("conv_id", "turn", "text")


@query("SELECT conv_id, turn, 'readingOrder {index:' || turn || ';}' AS kept FROM conversations")
def kept_tags(spark, sf):
    custom = F.concat(F.lit("structure {type:p;} readingOrder {index:"), F.col("turn").cast("string"), F.lit(";} textStyle {bold:true; x:y;}"))
    return table(spark, sf, "conversations").select("conv_id", "turn", T.keep_tags(custom, "readingOrder").alias("kept"))


@query("SELECT event_id, lpad(user_id::VARCHAR, greatest(4, length(user_id::VARCHAR))::INT, '0') AS number, event_type AS other, len(list_filter(regexp_split_to_array(replace(event_type, '_', ' ') || ' a  b', ' +'), lambda x: x <> ''))::INT AS n FROM events")
def padded_names(spark, sf):
    tokens = T.wer_tokens(F.concat(F.replace(F.col("event_type"), F.lit("_"), F.lit(" ")), F.lit(" a  b")))
    return table(spark, sf, "events").select("event_id", T.padded(F.col("user_id").cast("string")).alias("number"), T.padded(F.col("event_type")).alias("other"), F.size(tokens).alias("n"))


@query("SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def allowed_pages(spark, sf):
    return files.allowed(table(spark, sf, "documents").select("doc_id", "lang"), table(spark, sf, "labels").where("quality = 1"), "doc_id")


@query(
    "SELECT CASE WHEN ch IN ('=', '\\') THEN '\\' || ch WHEN regexp_matches(ch, '[\\p{M}\\p{C}]') THEN '\\u' || lpad(upper(to_hex(unicode(ch))), 4, '0') ELSE ch END || '=' || row_number() OVER (ORDER BY unicode(ch)) AS value FROM (SELECT DISTINCT unnest(string_split(text, '')) AS ch FROM documents) WHERE ch <> ''"
)
def char_map_file(spark, sf):
    return codecs.char_map_lines(codecs.make_char_map(stats.char_stat(table(spark, sf, "documents")), merge=False))


@query("SELECT DISTINCT unnest(string_split(text, '')) AS value FROM documents WHERE text <> ''")
def char_dictionary(spark, sf):
    return codecs.char_dictionary(table(spark, sf, "documents"))
