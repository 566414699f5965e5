"""File listings as tables: path, name, parent, length, modified."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

METADATA = ("mets.xml", "metadata.xml", "doc.xml")


def listing(spark: SparkSession, folder: str, extensions: tuple[str, ...] = (), recursive: bool = True) -> DataFrame:
    """The files below a folder by extension, without reading their contents, sorted by path."""
    read = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    files = read.load(folder).select("path", "length", F.col("modificationTime").alias("modified"))
    files = files.withColumn("name", F.element_at(F.split("path", "/"), -1)).withColumn("parent", F.regexp_replace("path", "/[^/]*$", ""))
    if extensions:
        pattern = "(?i)\\.(" + "|".join(re.escape(e.lstrip(".")) for e in extensions) + ")$"
        files = files.where(F.col("name").rlike(pattern))
    return files.orderBy("path")


def split_paths(paths: str | list[str]) -> list[str]:
    """A list as it is; a text ``a:b:c`` cut at colons, but not at that of a scheme (``hdfs://``, ``s3a://``, ``file:/``) or of a port."""
    if not isinstance(paths, str):
        return [p for p in paths if p]
    out: list[str] = []
    for part in paths.split(":"):
        # a scheme's colon is followed by a slash and comes after a bare name; a port's comes after a host and before digits and a slash
        scheme = out and re.fullmatch(r"[A-Za-z][A-Za-z0-9+.-]+", out[-1]) and part.startswith("/") and (part.startswith("//") or out[-1] in ("file", "hdfs"))
        port = out and re.fullmatch(r"[A-Za-z][A-Za-z0-9+.-]+://[^/]*", out[-1]) and re.match(r"\d+(/|$)", part)
        if scheme or port:
            out[-1] += ":" + part
        else:
            out.append(part)
    return [p for p in out if p]


def files_or_folders(spark: SparkSession, paths: str | list[str], extensions: tuple[str, ...] = ()) -> DataFrame:
    """Each of ``paths`` (see ``split_paths``): a folder, listed, or a file of one path a line."""
    system = spark._jvm.org.apache.hadoop.fs
    out = None
    for p in split_paths(paths):
        path = system.Path(p)
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory():
            own = listing(spark, p, extensions).select("path")
        else:
            own = spark.read.text(p).select(F.trim("value").alias("path")).where("path <> ''")
        out = own if out is None else out.unionAll(own)
    return out


def one_named(files: DataFrame, name: str) -> DataFrame:
    """The first file of that name, or none."""
    return files.where(F.col("name") == name).orderBy("path").limit(1)


def leaf_folders(files: DataFrame) -> DataFrame:
    """Folders without sub-folders but ``page``."""
    own = files.select("parent").distinct().where(~F.col("parent").rlike("/page$"))
    pages = files.select(F.regexp_replace("parent", "/page$", "").alias("parent")).distinct()
    folders = own.union(pages).distinct()
    above = folders.select(F.regexp_replace("parent", "/[^/]*$", "").alias("parent")).distinct()
    return folders.join(above, "parent", "left_anti")


def without_metadata(files: DataFrame) -> DataFrame:
    return files.where(~F.col("name").isin(*METADATA))


def outside_page_folders(files: DataFrame) -> DataFrame:
    return files.where(~F.col("parent").rlike("(^|/)page$"))


def retargeted(path: Column, source: str, target: str) -> Column:
    """The path, moved from below ``source`` to below ``target``."""
    return F.concat(F.lit(target.rstrip("/")), F.substring(path, len(source.rstrip("/")) + 1, 1_000_000))


def stem(name: Column) -> Column:
    return F.regexp_replace(name, r"\.[^.]*$", "")


def partners(left: DataFrame, right: DataFrame, nested: str | None = None) -> DataFrame:
    """For each file of ``left`` the file of ``right`` with its stem: in the same folder, else in the folder above or (``nested``) below; several equally near ones make the query fail."""
    a = left.select("path", "parent", stem(F.col("name")).alias("_stem"))
    b = right.select(F.col("path").alias("partner"), F.col("parent").alias("_parent"), stem(F.col("name")).alias("_stem"))
    above = F.regexp_replace("parent", "/[^/]*$", "")
    near = F.when(F.col("_parent") == F.col("parent"), 0).when(F.col("_parent") == (F.concat("parent", F.lit("/" + nested)) if nested else above), 1)
    found = a.join(b, "_stem").withColumn("_near", near).where("_near is not null")
    best = found.withColumn("_least", F.min("_near").over(Window.partitionBy("path"))).where("_near = _least")
    n = F.count("*").over(Window.partitionBy("path"))
    best = best.withColumn("partner", F.when(n == 1, F.col("partner")).otherwise(F.raise_error(F.concat(F.lit("ambiguous: "), F.col("path")))))
    return left.select("path").join(best.select("path", "partner"), "path", "left")


def with_suffix(files: DataFrame, stems: DataFrame, suffixes: tuple[str, ...], fold: bool = True) -> DataFrame:
    """For each stem the first file (by suffix order, then path) with one of the suffixes."""
    own = files.withColumn("_stem", stem(F.col("name"))).withColumn("_ext", F.regexp_extract("name", r"\.([^.]*)$", 1))
    ext = F.lower("_ext") if fold else F.col("_ext")
    rank = F.coalesce(*[F.when(ext == (s.lower() if fold else s), F.lit(k)) for k, s in enumerate(suffixes)])
    told = own.withColumn("_rank", rank).where("_rank is not null")
    first = told.groupBy("_stem").agg(F.min(F.struct("_rank", "path")).alias("b"))
    return stems.join(first.select(F.col("_stem").alias("stem"), F.col("b.path").alias("path")), "stem", "left")


def zipped(spark: SparkSession, images: list[str], xmls: list[str]) -> DataFrame:
    """Pages of an image and an XML file each, by position."""
    if len(images) != len(xmls):
        raise ValueError(f"{len(images)} images but {len(xmls)} XML files")
    return spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(zip(images, xmls, strict=True))], "pos long, img_path string, xml_path string")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """path, line_no, line of UTF-8 files; the order of lines is data."""
    text = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")
    return text.select("path", F.posexplode(F.split(F.regexp_replace("value", r"\r?\n$", ""), r"\r?\n")).alias("line_no", "line"))


def write_lines(lines: DataFrame, path: str, append: bool = False) -> None:
    lines.write.mode("append" if append else "overwrite").text(path)


def best_or_last(models: DataFrame) -> DataFrame:
    """folder, model: the best model, else the last, else the query fails."""
    pick = F.coalesce(F.max(F.when(F.col("name").rlike("^best_"), F.col("path"))), F.max_by("path", "modified"))
    return models.groupBy("parent").agg(pick.alias("model"))


def unreferenced(models: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """Models whose name stands in no checkpoint line (``key: "name"``)."""
    named = checkpoints.select(F.regexp_extract("line", r'"([^"]*)"', 1).alias("_n")).where("_n <> ''").select(F.element_at(F.split("_n", "/"), -1).alias("_n")).distinct()
    return models.join(named, F.regexp_replace("name", r"\.[^.]*$", "") == F.col("_n"), "left_anti")


def nearest_name(left: DataFrame, right: DataFrame) -> DataFrame:
    """For each file of ``left`` the file of ``right`` in its folder that has its stem, else the only one whose name begins with the stem; several such make the query fail."""
    a = left.select("path", "parent", stem(F.col("name")).alias("_stem"))
    b = right.select(F.col("path").alias("partner"), "parent", F.col("name").alias("_name"))
    met = a.join(b, "parent").where(F.startswith("_name", F.col("_stem")))
    same = F.when(stem(F.col("_name")) == F.col("_stem"), F.col("partner"))
    one = met.groupBy("path").agg(F.min(same).alias("_same"), F.min("partner").alias("_first"), F.count("*").alias("_n"))
    pick = F.when(F.col("_same").isNotNull(), F.col("_same")).when(F.col("_n") == 1, F.col("_first")).otherwise(F.raise_error(F.concat(F.lit("ambiguous: "), F.col("path"))))
    return left.select("path").join(one.select("path", pick.alias("partner")), "path", "left")


def text_of_images(images: DataFrame, texts: DataFrame, drop: int = 5) -> DataFrame:
    """Image files with the text files of their stem less its last ``drop`` characters: path, text_path; a text may have several images."""
    cut = F.expr(f"left(_stem, greatest(0, length(_stem) - {int(drop)}))")
    a = images.withColumn("_stem", stem(F.col("name"))).select("path", cut.alias("_key"))
    b = texts.select(F.col("path").alias("text_path"), stem(F.col("name")).alias("_key"))
    return a.join(b, "_key").select("path", "text_path")


def snippets(lines: DataFrame, target: str) -> None:
    """Writes each line (name, text, info: map) as a row of text and one of its side information below ``target``, as training data for lines; images are not cut."""
    lines.select("name", "text").write.mode("overwrite").parquet(f"{target}/text")
    lines.select("name", F.array_join(F.flatten(F.transform(F.map_entries("info"), lambda e: F.array(e.key, e.value))), "\n").alias("info")).write.mode("overwrite").parquet(f"{target}/info")


def shipped(spark: SparkSession, path: str) -> str:
    """Sends a file to all executors; the name by which ``SparkFiles.get`` finds it there."""
    spark.sparkContext.addFile(path)
    return path.rsplit("/", 1)[-1]


def allowed(rows: DataFrame, names: DataFrame, key: str) -> DataFrame:
    """Rows whose key is in a list of names."""
    return rows.join(names.select(key).distinct(), key, "left_semi")


def read_xml(spark: SparkSession, path: str, tag: str) -> DataFrame:
    """path, element: each element ``tag`` of XML files, as text; a file that is not XML makes the query fail."""
    import pandas as pd

    def run(batches):
        import xml.etree.ElementTree as ET

        for b in batches:
            rows = [(p, ET.tostring(e, "unicode")) for p, c in zip(b.path, b.content, strict=True) for e in ET.fromstring(bytes(c)).iter() if e.tag.rsplit("}", 1)[-1] == tag]
            yield pd.DataFrame(rows, columns=["path", "element"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, element string")


def child(element: Column, name: str) -> Column:
    """The text of the child element of that name; null without one, and an error if there are several."""
    found = F.xpath(element, F.lit(f"/*/*[local-name()='{name}']/text()"))
    n = F.xpath_int(element, F.lit(f"count(/*/*[local-name()='{name}'])"))
    return F.when(n > 1, F.raise_error(F.lit(f"several children {name}"))).otherwise(F.get(found, 0))
