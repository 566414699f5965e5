"""Character maps, dictionaries, unigram models, side files and feature matrices."""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vellumflow.functions.unicode import base_char
from vellumflow.operators.stats import char_stat


def parse_char_map(lines: DataFrame) -> DataFrame:
    """channel, ch of ``<code>=<number>`` lines (column ``line``): the last ``=`` divides; ``\\uXXXX``, ``\\=``, ``\\\\`` are escapes.

    Channels count from 1 in the order of the file's numbers, which must have no gap; channel 0 stands for no character. A character in two lines
    makes the query fail.
    """
    told = lines.where("line <> ''").select(F.regexp_extract("line", r"^(.*)=\s*(\d+)\s*$", 1).alias("_c"), F.regexp_extract("line", r"^(.*)=\s*(\d+)\s*$", 2).cast("int").alias("_n"))
    hexa = F.regexp_extract("_c", r"^\\u([0-9a-fA-F]{4})$", 1)
    # chr() in Spark is of one byte; a UTF-16 code unit is decoded instead
    ch = F.when(hexa != "", F.decode(F.unhex(hexa), "UTF-16BE")).when(F.col("_c").isin("\\=", "\\\\"), F.substring("_c", 2, 1)).otherwise(F.col("_c"))
    told = told.select("_n", ch.alias("ch")).withColumn("channel", F.dense_rank().over(Window.orderBy("_n")))
    first = F.min("_n").over(Window.partitionBy())
    gap = F.col("_n") - first + 1 != F.col("channel")
    again = F.count("*").over(Window.partitionBy("ch")) > 1
    return told.select(F.when(gap, F.raise_error(F.lit("a channel is missing"))).when(again, F.raise_error(F.concat(F.lit("twice: "), "ch"))).otherwise(F.col("channel")).cast("int").alias("channel"), "ch")


def read_char_map(spark: SparkSession, path: str) -> DataFrame:
    """A character map; a file without any ``=`` has one channel a line, with all its characters."""
    raw = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\r?\n")).alias("no", "line")).where("line <> ''")
    if raw.where(F.col("line").rlike(r"=\s*\d+\s*$")).isEmpty():
        return raw.select((F.col("no") + 1).alias("channel"), F.explode(F.filter(F.split("line", ""), lambda c: c != "")).alias("ch"))
    return parse_char_map(raw.select("line"))


def char_map_lines(chars: DataFrame) -> DataFrame:
    """value: the lines of a character map (channel, ch), by code point within the channels, counted from 1."""
    own = F.when(F.col("ch").isin("=", "\\"), F.concat(F.lit("\\"), "ch")).when(F.col("ch").rlike(r"[\p{M}\p{C}]"), F.concat(F.lit("\\u"), F.lpad(F.hex(F.ascii("ch")), 4, "0"))).otherwise(F.col("ch"))
    return chars.orderBy("channel", F.ascii("ch")).select(F.concat(own, F.lit("="), F.col("channel").cast("string")).alias("value"))


def make_char_map(chars: DataFrame, merge: bool) -> DataFrame:
    """channel, ch of distinct characters; ``merge`` gives those of one base character one channel, the base first."""
    own = chars.select("ch").where("ch is not null").distinct().withColumn("base", base_char("ch") if merge else F.col("ch"))
    return own.select(F.dense_rank().over(Window.orderBy(F.ascii("base"), "base")).alias("channel"), "ch", (F.col("ch") == F.col("base")).alias("is_base"))


def same_char_maps(a: DataFrame, b: DataFrame) -> bool:
    """Whether two maps have the same sets of characters by channel."""
    x, y = a.select("channel", "ch"), b.select("channel", "ch")
    return x.exceptAll(y).isEmpty() and y.exceptAll(x).isEmpty()


def overwritten(chars: DataFrame, new: DataFrame) -> DataFrame:
    """Characters take the channel that ``new`` gives them."""
    return chars.join(new.select("ch", F.col("channel").alias("_c")), "ch", "left").select(F.coalesce("_c", "channel").alias("channel"), "ch")


def read_dictionary(spark: SparkSession, path: str, most: int = -1) -> DataFrame:
    """term, cnt of ``term,count`` or ``term;count`` lines, with or without a header; the most frequent ``most``."""
    raw = spark.read.text(path)
    parts = raw.select(F.regexp_extract("value", r"^(.*)[,;]\s*(\d+)\s*$", 1).alias("term"), F.regexp_extract("value", r"^(.*)[,;]\s*(\d+)\s*$", 2).try_cast("bigint").alias("cnt"))
    own = parts.where("term <> '' and cnt is not null").groupBy("term").agg(F.sum("cnt").alias("cnt"))
    return own if most < 0 else own.orderBy(F.desc("cnt"), "term").limit(most)


def write_dictionary(words: DataFrame, path: str) -> None:
    words.orderBy(F.desc("cnt"), "term").select(F.col("term").alias("value"), F.col("cnt").alias("occurence")).coalesce(1).write.mode("overwrite").option("header", True).option("sep", ";").csv(path)


def arpa_lines(model: DataFrame) -> DataFrame:
    """value: a unigram model (term, log10_p) as ARPA lines."""
    n = model.agg(F.count("*").alias("n")).select(F.explode(F.array(F.struct(F.lit(0).alias("k"), F.lit("\\data\\").alias("value")), F.struct(F.lit(1).alias("k"), F.concat(F.lit("ngram 1="), F.col("n").cast("string")).alias("value")), F.struct(F.lit(2).alias("k"), F.lit("\\1-grams:").alias("value")))).alias("x")).select("x.k", F.lit("").alias("t"), "x.value")
    rows = model.select(F.lit(3).alias("k"), F.col("term").alias("t"), F.concat(F.format_string("%.6f", "log10_p"), F.lit("\t"), "term").alias("value"))
    end = model.sparkSession.createDataFrame([(4, "", "\\end\\")], "k int, t string, value string")
    return n.unionAll(rows).unionAll(end).orderBy("k", "t").select("value")


def parse_arpa(lines: DataFrame, most: int = -1) -> DataFrame:
    """term, cost (minus the natural logarithm of the probability) of ARPA unigram lines (column ``value``); the ``most`` of least cost."""
    row = r"^(-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)\s+(\S+)"
    own = lines.select(F.regexp_extract("value", row, 2).alias("term"), (-F.regexp_extract("value", row, 1).try_cast("double") * math.log(10)).alias("cost")).where("term <> ''")
    return own if most < 0 else own.orderBy("cost", "term").limit(most)


def char_dictionary(docs: DataFrame) -> DataFrame:
    """value: the distinct characters, one a line."""
    return char_stat(docs).select(F.col("ch").alias("value")).orderBy("value")


def read_info(spark: SparkSession, path: str) -> DataFrame:
    """path, info: side files of alternating key and value lines as a map."""
    text = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.split("value", r"\r?\n").alias("_lines"))
    even = F.size("_lines") - F.size("_lines") % 2
    every = lambda k: F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), (even / 2).cast("int") - 1)), lambda i: F.get("_lines", i * 2 + k))
    return text.select("path", F.when(even > 0, F.map_from_arrays(every(0), every(1))).otherwise(F.create_map().cast("map<string,string>")).alias("info"))


#: Forms of a feature file: floats, bytes of values from 0 to 1, shorts of values (logarithms) from a least one to 0.
FLOAT, BYTE, SHORT_LOG = "float", "byte", "short_log"
_KIND = 6


def _quantised(x: np.ndarray, low: float, high: float, bits: int) -> np.ndarray:
    top = 2 ** (bits - 1)
    return np.clip(np.floor((2 * top - 1) / (high - low) * (x - low) - top), -top, top - 1)


def _back(q: np.ndarray, low: float, high: float, bits: int) -> np.ndarray:
    top = 2 ** (bits - 1)
    return (q + top + 0.5) * ((high - low) / (2 * top - 1)) + low


def encode_matrix(x: np.ndarray, kind: str = FLOAT, least: int = -10) -> bytes:
    """A header of rows (int), mode (int), bytes of a row (short) and 6 (short), then the rows, all big-endian.

    The mode is 1 for floats, -1 for bytes and ``least``, which is below -1, for shorts. Values out of the form's range are an error.
    """
    x = np.asarray(x, np.float64)
    rows, cols = x.shape
    if kind == FLOAT:
        return struct.pack(">iihh", rows, 1, cols * 4, _KIND) + x.astype(">f4").tobytes()
    if kind == BYTE:
        if x.size and (x.min() < 0 or x.max() > 1):
            raise ValueError("bytes hold values from 0 to 1")
        return struct.pack(">iihh", rows, -1, cols, _KIND) + _quantised(x, 0.0, 1.0, 8).astype(">i1").tobytes()
    if least >= -1:
        raise ValueError(f"the least value of shorts must be below -1, not {least}")
    if x.size and x.max() > 0:
        raise ValueError("shorts hold values up to 0")
    return struct.pack(">iihh", rows, least, cols * 2, _KIND) + _quantised(x, least, 0.0, 16).astype(">i2").tobytes()


def decode_matrix(raw: bytes) -> np.ndarray:
    rows, mode, width, _ = struct.unpack(">iihh", raw[:12])
    width &= 0xFFFF  # a row of more than 32767 bytes
    kind, size = (">f4", 4) if mode >= 0 else (">i1", 1) if mode == -1 else (">i2", 2)
    x = np.frombuffer(raw[12 : 12 + rows * width], kind).reshape(rows, width // size).astype(np.float64)
    return x if mode >= 0 else _back(x, 0.0, 1.0, 8) if mode == -1 else _back(x, mode, 0.0, 16)


def read_matrices(spark: SparkSession, path: str) -> DataFrame:
    """path, matrix of feature files."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"path": b.path, "matrix": [decode_matrix(bytes(c)).tolist() for c in b.content]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, matrix array<array<double>>")


def encoded_matrices(rows: DataFrame, kind: str = FLOAT, least: int = -10) -> DataFrame:
    """Adds ``raw``, the encoded form of the column ``matrix``."""

    @F.pandas_udf("binary")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda m: None if m is None else encode_matrix(np.array([list(r) for r in m]).reshape(len(m), -1), kind, least))

    return rows.withColumn("raw", run("matrix"))


def write_matrices(rows: DataFrame, kind: str = FLOAT, least: int = -10) -> DataFrame:
    """Writes the column ``matrix`` to the file that ``path`` names, each in one piece; the paths. A task that runs again writes the same."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        for part in parts:
            for path, m in zip(part.path, part.matrix, strict=True):
                system, own = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
                with system.open_output_stream(own) as out:
                    out.write(encode_matrix(np.array([list(r) for r in m]).reshape(len(m), -1), kind, least))
            yield part[["path"]]

    return rows.select("path", "matrix").mapInPandas(run, "path string")


def decoded_matrices(rows: DataFrame) -> DataFrame:
    @F.pandas_udf("array<array<double>>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda r: None if r is None else decode_matrix(bytes(r)).tolist())

    return rows.withColumn("matrix", run("raw"))
