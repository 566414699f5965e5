"""Quality of texts and of rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellumflow.functions import text as T


def unique_join(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """An inner join that must be one to one: a repeated key, or one that the other side lacks, makes the query fail."""
    a = left.groupBy(key).agg(F.count("*").alias("_a"))
    b = right.groupBy(key).agg(F.count("*").alias("_b"))
    good = (F.coalesce("_a", F.lit(0)) == 1) & (F.coalesce("_b", F.lit(0)) == 1)
    keys = a.join(b, key, "full").select(key, F.when(good, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("not one to one: "), F.col(key).cast("string")))).alias("_ok"))
    return left.join(right, key).join(keys.where("_ok"), key, "left_semi")


def error_rate(pairs: DataFrame, keys: tuple[str, ...] = (), reference: str = "ref", hypothesis: str = "hyp") -> DataFrame:
    """errors, length, cer: edit distance over the references' length, summed before the division."""
    own = pairs.withColumn("_e", F.levenshtein(reference, hypothesis)).withColumn("_n", F.length(reference))
    out = own.groupBy(*keys).agg(F.sum("_e").alias("errors"), F.sum("_n").alias("length"))
    return out.withColumn("cer", F.when(F.col("length") > 0, F.col("errors") / F.col("length")))


def word_errors(reference: Column, hypothesis: Column) -> Column:
    """The edit distance of two arrays of words: each different word of both becomes a character of its own."""
    known = F.array_distinct(F.concat(reference, hypothesis))
    # beyond the 16-bit characters, so that there is room for a million words and none is a surrogate
    as_text = lambda words: F.array_join(F.transform(words, lambda w: F.decode(F.unhex(F.lpad(F.hex(F.array_position(known, w) + 0xFFFF), 8, "0")), "UTF-32")), "")
    return F.levenshtein(as_text(reference), as_text(hypothesis))


def word_error_rate(pairs: DataFrame, keys: tuple[str, ...] = (), reference: str = "ref", hypothesis: str = "hyp") -> DataFrame:
    own = pairs.withColumn("_r", T.wer_tokens(F.col(reference))).withColumn("_h", T.wer_tokens(F.col(hypothesis)))
    out = own.withColumn("_e", word_errors(F.col("_r"), F.col("_h"))).groupBy(*keys).agg(F.sum("_e").alias("errors"), F.sum(F.size("_r")).alias("length"))
    return out.withColumn("wer", F.when(F.col("length") > 0, F.col("errors") / F.col("length")))


def ranking(rows: DataFrame, keys: list[str], score: str, ident: str, relevant: str) -> DataFrame:
    """keys, ident, rank, tp, precision, recall: the curve along falling score (ties by ident)."""
    order = Window.partitionBy(*keys).orderBy(F.desc(score), ident)
    hit = F.when(F.col(relevant), 1).otherwise(0)
    told = rows.withColumn("rank", F.row_number().over(order)).withColumn("tp", F.sum(hit).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    every = F.sum(hit).over(Window.partitionBy(*keys))
    return told.withColumn("precision", F.col("tp") / F.col("rank")).withColumn("recall", F.when(every > 0, F.col("tp") / every))


def average_precision(rows: DataFrame, keys: list[str], score: str, ident: str, relevant: str) -> DataFrame:
    """keys, n_relevant, ap: the mean of the precision at each relevant row."""
    curve = ranking(rows, keys, score, ident, relevant)
    own = F.when(F.col(relevant), F.col("precision"))
    return curve.groupBy(*keys).agg(F.count(own).alias("n_relevant"), F.coalesce(F.avg(own), F.lit(0.0)).alias("ap"))


def match_types(found: DataFrame, truth: DataFrame, keys: list[str]) -> DataFrame:
    """keys, kind: TP of both, FP of ``found`` alone, FN of ``truth`` alone."""
    a, b = found.select(*keys).distinct().withColumn("_f", F.lit(True)), truth.select(*keys).distinct().withColumn("_t", F.lit(True))
    kind = F.when(F.col("_f") & F.col("_t"), "TP").when(F.col("_f"), "FP").otherwise("FN")
    return a.join(b, keys, "full").select(*keys, kind.alias("kind"))
