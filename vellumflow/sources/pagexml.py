"""PAGE-XML pages, by Spark's XML source with a fixed schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_COORDS = "STRUCT<_points: STRING>"
_TEXT = "STRUCT<_conf: FLOAT, Unicode: STRING>"
SCHEMA = f"""
Metadata STRUCT<Creator: STRING, Created: STRING, LastChange: STRING, TranskribusMetadata: STRUCT<_docId: BIGINT, _pageId: BIGINT, _pageNr: INT, _status: STRING>>,
Page STRUCT<_imageFilename: STRING, _imageWidth: INT, _imageHeight: INT, TextRegion: ARRAY<STRUCT<_id: STRING, _custom: STRING, _orientation: FLOAT, Coords: {_COORDS},
  TextLine: ARRAY<STRUCT<_id: STRING, _custom: STRING, Coords: {_COORDS}, Baseline: {_COORDS}, TextEquiv: {_TEXT}>>, TextEquiv: {_TEXT}>>>
"""


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """page_id, doc_id, page_nr, status, image, width, height, regions. The page_id is made of the three numbers, or of the image's stem."""
    raw = spark.read.format("xml").option("rowTag", "PcGts").option("mode", "PERMISSIVE").schema(SCHEMA).load(path)
    m, p = "Metadata.TranskribusMetadata.", "Page."
    line = lambda x: F.struct(
        x["_id"].alias("line_id"), x["TextEquiv"]["Unicode"].alias("text"), x["TextEquiv"]["_conf"].alias("conf"), x["_custom"].alias("custom"), x["Baseline"]["_points"].alias("baseline"), x["Coords"]["_points"].alias("coords")
    )
    region = lambda r: F.struct(
        r["_id"].alias("region_id"), r["_orientation"].alias("orientation"), r["Coords"]["_points"].alias("coords"), r["_custom"].alias("custom"), F.transform(F.coalesce(r["TextLine"], F.array()), line).alias("lines")
    )
    known = F.col(m + "_docId").isNotNull() & F.col(m + "_pageNr").isNotNull() & F.col(m + "_pageId").isNotNull()
    ident = F.when(known, F.format_string("%05d_%04d_%06d", m + "_docId", m + "_pageNr", m + "_pageId")).otherwise(F.regexp_replace(p + "_imageFilename", r"\.[^.]*$", ""))
    regions = F.transform(F.coalesce(F.col(p + "TextRegion"), F.array()), region)
    return raw.select(ident.alias("page_id"), F.col(m + "_docId").alias("doc_id"), F.col(m + "_pageNr").alias("page_nr"), F.col(m + "_status").alias("status"), F.col(p + "_imageFilename").alias("image"), F.col(p + "_imageWidth").alias("width"), F.col(p + "_imageHeight").alias("height"), regions.alias("regions"))


def write_pages(pages: DataFrame, path: str) -> None:
    """The inverse of ``read_pages``: one ``PcGts`` element for each page, one file for each partition."""
    line = lambda x: F.struct(
        x["line_id"].alias("_id"), x["custom"].alias("_custom"), F.struct(x["coords"].alias("_points")).alias("Coords"), F.struct(x["baseline"].alias("_points")).alias("Baseline"), F.struct(x["conf"].alias("_conf"), x["text"].alias("Unicode")).alias("TextEquiv")
    )
    region = lambda r: F.struct(r["region_id"].alias("_id"), r["custom"].alias("_custom"), r["orientation"].alias("_orientation"), F.struct(r["coords"].alias("_points")).alias("Coords"), F.transform(r["lines"], line).alias("TextLine"))
    numbers = F.split("page_id", "_")
    page_number = F.when(F.col("page_id").rlike(r"^\d+_\d+_\d+$"), F.try_element_at(numbers, F.lit(3)).try_cast("bigint"))
    meta = F.struct(F.struct(F.col("doc_id").alias("_docId"), page_number.alias("_pageId"), F.col("page_nr").alias("_pageNr"), F.col("status").alias("_status")).alias("TranskribusMetadata"))
    page = F.struct(F.col("image").alias("_imageFilename"), F.col("width").alias("_imageWidth"), F.col("height").alias("_imageHeight"), F.transform("regions", region).alias("TextRegion"))
    pages.select(meta.alias("Metadata"), page.alias("Page")).write.mode("overwrite").format("xml").option("rootTag", "pages").option("rowTag", "PcGts").save(path)


def plain_text(pages: DataFrame) -> DataFrame:
    """page_id, value: each page's lines."""
    lines = F.flatten(F.transform("regions", lambda r: F.transform(r["lines"], lambda x: x["text"])))
    return pages.select("page_id", F.array_join(F.filter(lines, lambda t: t.isNotNull()), "\n").alias("value"))


def write_plain_text(pages: DataFrame, path: str) -> None:
    """One folder ``page_id=..`` of text for each page."""
    plain_text(pages).write.mode("overwrite").partitionBy("page_id").text(path)


def with_provenance(creator: str | None, provider: str, name: str, version: str) -> str:
    """A metadata line of who made a page, before what was there."""
    own = f"prov={provider}:name={name}:v={version}"
    return own if not creator else f"{own}\n{creator}"
