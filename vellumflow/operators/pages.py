"""Pages, regions and lines: flattening, filters, roll-up, changes. Rejected rows come as a second table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellumflow.functions import text as T


def flat_lines(pages: DataFrame) -> DataFrame:
    """One row for each line of pages (page_id, regions: array of (region_id, orientation, lines: array of (line_id, text, conf, custom, baseline, coords)))."""
    regions = pages.select("page_id", F.posexplode("regions").alias("region_index", "r"))
    own = regions.select("page_id", "region_index", "r.region_id", "r.orientation", F.posexplode("r.lines").alias("ro_index", "l"))
    return own.select("page_id", "region_index", "region_id", "orientation", "ro_index", "l.*")


def transcribed(lines: DataFrame) -> DataFrame:
    """Only lines with a transcript, line feeds removed."""
    return lines.where("text is not null").withColumn("text", T.transcript(F.col("text")))


def region_text(lines: DataFrame, keys: list[str], order: str = "ro_index", text: str = "text") -> DataFrame:
    """The texts of each region's lines in order, null ones left out."""
    own = F.array_sort(F.collect_list(F.when(F.col(text).isNotNull(), F.struct(order, text))))
    return lines.groupBy(*keys).agg(F.array_join(F.transform(own, lambda s: s[text]), "\n").alias("region_text"))


def with_status(rows: DataFrame, accepted: str, status: str = "status") -> DataFrame:
    """Rows whose status is one of ``A;B;..``, whatever its case; an unknown status is not accepted."""
    names = [s.strip().upper() for s in accepted.split(";") if s.strip()]
    return rows.where(F.coalesce(F.upper(status).isin(names), F.lit(False)))


def confident(rows: DataFrame, least: float, conf: str = "conf") -> DataFrame:
    """Rows of at least this confidence; a missing one passes."""
    return rows.where(F.col(conf).isNull() | (F.col(conf) >= least))


def of_ids(rows: DataFrame, ids: list[str] | None, key: str) -> DataFrame:
    return rows if ids is None else rows.where(F.col(key).isin(list(ids)))


def checked_lines(lines: DataFrame, text: str = "line") -> tuple[DataFrame, DataFrame]:
    """Valid lines, and the others with a kind of error."""
    valid = T.valid_line(F.col(text))
    kind = F.when(F.col(text).rlike(T.ASTRAL), "surrogate").otherwise("category")
    return lines.where(valid), lines.where(~valid).withColumn("kind", kind)


def with_text(lines: DataFrame, text: Column, conf: Column | None = None) -> DataFrame:
    """Assigns transcripts; a null one clears the tags as well, and without a given confidence there is none."""
    out = lines.withColumn("text", text).withColumn("conf", F.lit(None).cast("float") if conf is None else conf.cast("float"))
    return out.withColumn("custom", F.when(F.col("text").isNotNull(), F.col("custom")))


def cleared(lines: DataFrame) -> DataFrame:
    return with_text(lines, F.lit(None).cast("string"))


def replaced(matrices: DataFrame, new: DataFrame, keys: list[str], value: str) -> DataFrame:
    """New values for known keys; a new key that isn't known makes the query fail."""
    fresh = new.select(*keys, F.col(value).alias("_new"))
    known = matrices.select(*keys).withColumn("_known", F.lit(True))
    checked = fresh.join(known, keys, "left").select(*keys, F.when(F.col("_known"), F.col("_new")).otherwise(F.raise_error(F.lit("no such key"))).alias("_new"), F.lit(True).alias("_has"))
    return matrices.join(checked, keys, "left").withColumn(value, F.when(F.col("_has"), F.col("_new")).otherwise(F.col(value))).drop("_new", "_has")


def removed(rows: DataFrame, gone: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """What stays and what went."""
    return rows.join(gone.select(*keys), keys, "left_anti"), rows.join(gone.select(*keys), keys, "left_semi")


def before_layout(regions: DataFrame, delete: str | None) -> DataFrame:
    """``regions`` deletes all, ``lines`` empties them, None leaves them."""
    if delete not in (None, "regions", "lines"):
        raise ValueError(f"cannot delete {delete}")
    if delete == "regions":
        return regions.where(F.lit(False))
    return regions if delete is None else regions.withColumn("lines", F.filter("lines", lambda x: F.lit(False)))


def for_layout(regions: DataFrame, ids: list[str] | None) -> DataFrame:
    """The chosen regions that have no lines."""
    return of_ids(regions, ids, "region_id").where(F.size("lines") == 0)


def numbered(lines: DataFrame, region: str = "region", order: str = "pos") -> DataFrame:
    """Ids ``r<i>l<j>`` counted from 1 and a reading order from 0, within each page."""
    i = F.dense_rank().over(Window.partitionBy("page_id").orderBy(region))
    j = F.row_number().over(Window.partitionBy("page_id", region).orderBy(order))
    told = lines.withColumn("_i", i).withColumn("_j", j)
    return told.select("page_id", region, order, F.concat(F.lit("r"), F.col("_i")).alias("region_id"), F.concat(F.lit("r"), F.col("_i"), F.lit("l"), F.col("_j")).alias("line_id"), (F.col("_j") - 1).alias("ro_index"))


def cached(keys: DataFrame, cache: DataFrame, key: list[str], value: str, compute: Column) -> DataFrame:
    """Values from a cache table, computed where it has none."""
    return keys.join(cache.select(*key, F.col(value).alias("_kept")), key, "left").withColumn(value, F.coalesce("_kept", compute)).drop("_kept")


def page_segments(rows: DataFrame, keys: list[str], order: str, line: str = "line") -> DataFrame:
    """Cuts a transcription at ``[p. N]``, and ends a page's content at ``[Transkript:``: keys, page, content."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    page = F.regexp_extract(line, r"\[p\. *(\d+)\]", 1)
    starts, ends = page != "", F.contains(F.col(line), F.lit("[Transkript:"))
    told = rows.withColumn("_start", starts).withColumn("_seg", F.sum(F.when(starts, 1).otherwise(0)).over(w))
    told = told.withColumn("_ended", F.max(ends & ~starts).over(Window.partitionBy(*keys, "_seg").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))
    told = told.withColumn("_text", F.trim(F.regexp_replace(line, r".*\[p\. *\d+\]", ""))).where((F.col("_seg") > 0) & ~F.col("_ended"))
    parts = F.array_sort(F.collect_list(F.when(F.col("_text") != "", F.struct(order, "_text"))))
    return told.groupBy(*keys, "_seg").agg(F.max(F.when(F.col("_start"), page)).cast("int").alias("page"), F.array_join(F.transform(parts, lambda s: s["_text"]), "\n").alias("content")).drop("_seg")
