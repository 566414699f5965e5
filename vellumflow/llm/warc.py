"""Operator 5, WARC: a normaliser of monolithic gzip files.

A monolithic ``.warc.gz`` is one gzip stream over the whole file, so no record can be read without all before it. The
normaliser inflates such a stream once, in pieces, and writes each record as a gzip member of its own to ``<name>.warc.gz`` in the target
folder, with a sidecar ``<name>.idx`` (tab-separated: record, offset, length, type, id, uri, n_bytes, sha1). The name is the file's own, with a hash of its
whole path (below ``root``, where that is given), so files of one name in several folders stay apart. Each file is one task;
nothing of a file but a piece, and ``INDEX_ROWS`` rows of its index, is in memory, however long it or a record is. Files of several members, or already normal, pass as well.

Files are written under a name of the attempt's own and renamed, first the index, then the records: so a task that is run again does no harm, and where there are
records there is their index. A file that is cut short or malformed raises an error, with its name. Null html is an empty body, a null url gives no target URI, a null page_id no record id of a page; a page_id has to be an integer.
Repeated rows each are a record. Other columns are not read. An empty table gives no files and an empty result.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import new_path, written

PIECE = 1 << 18
LEVEL = 6
DATE = "2024-01-01T00:00:00Z"
#: Bytes of html after which a written file is full.
FILE_BYTES = 64 << 20
INDEX_ROWS = 1000
INDEX = "file string, record long, offset long, length long, type string, id string, uri string, n_bytes long, sha1 string"
_LENGTH = re.compile(rb"^content-length:\s*(\d+)\s*$", re.I | re.M)


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _header(page_id: int | None, url: str | None, n: int) -> bytes:
    lines = ["WARC/1.0", "WARC-Type: resource", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}", "Content-Type: text/html"]
    if url is not None:
        lines.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    return ("\r\n".join([*lines, f"Content-Length: {n}"]) + "\r\n\r\n").encode()


def _monolith(folder: str):
    """Files are named by task and place in it; an attempt writes under a name of its own and renames what is whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _open(folder)
        system.create_dir(root, recursive=True)
        task, own, files, sink = TaskContext.get().partitionId(), uuid.uuid4().hex, 0, None

        def end() -> pa.RecordBatch:
            sink.write(squeeze.flush())
            sink.close()
            system.move(f"{root}/.{own}", f"{root}/{name}")
            return pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"])], ["path"])

        for b in batches:
            for page_id, url, html in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if sink is None:
                    name, held, files = f"crawl-{task:06d}-{files:04d}.warc.gz", 0, files + 1
                    sink, squeeze = system.open_output_stream(f"{root}/.{own}", compression=None), zlib.compressobj(1, zlib.DEFLATED, 31)
                body = (html or "").encode()
                sink.write(squeeze.compress(_header(page_id, url, len(body)) + body + b"\r\n\r\n"))
                held += len(body)
                if held >= FILE_BYTES:
                    yield end()
                    sink = None
        if sink is not None:
            yield end()

    return run


def write_monoliths(pages: DataFrame, folder: str) -> DataFrame:
    """Writes the pages as monolithic files; the paths (of those that successful tasks wrote)."""
    told = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return written(told.mapInArrow(_monolith(folder), "path string"), "warc-paths")


def inflated(source: object) -> Iterator[bytes]:
    """The bytes of a gzip file of any number of members, in pieces."""
    member, some, ended = zlib.decompressobj(31), False, True
    while raw := source.read(PIECE):
        while raw:
            if ended and not raw.strip(b"\0"):  # padding after the last member
                break
            ended, some = False, True
            piece = member.decompress(raw, PIECE)
            if piece:
                yield piece
            if member.eof:
                raw, member, ended = member.unused_data, zlib.decompressobj(31), True
            else:
                raw = member.unconsumed_tail
    if some and not ended:
        if tail := member.flush():
            yield tail
        if not member.eof:
            raise ValueError("the gzip stream is cut short")


class _Reader:
    """Reads heads and bodies from pieces."""

    def __init__(self, pieces: Iterator[bytes]) -> None:
        self.pieces, self.held = pieces, b""

    def more(self) -> bool:
        piece = next(self.pieces, None)
        if piece is None:
            return False
        self.held += piece
        return True

    def head(self) -> bytes | None:
        """The next record's header with its blank line, None at the end."""
        self.held = self.held.lstrip(b"\r\n")
        while not self.held and self.more():
            self.held = self.held.lstrip(b"\r\n")
        if not self.held:
            return None
        seen = 0
        while (end := self.held.find(b"\r\n\r\n", max(0, seen - 3))) < 0:
            seen = len(self.held)
            if not self.more():
                raise ValueError("a record's header is cut short")
        out, self.held = self.held[: end + 4], self.held[end + 4 :]
        if not out.startswith(b"WARC/"):
            raise ValueError("a record doesn't begin with its version")
        return out

    def body(self, n: int) -> Iterator[bytes]:
        while n:
            if not self.held and not self.more():
                raise ValueError("a record's body is cut short")
            out, self.held = self.held[:n], self.held[n:]
            n -= len(out)
            yield out


def _field(head: bytes, name: bytes) -> str | None:
    m = re.search(rb"^" + name + rb":[ \t]*(.*?)[ \t]*\r?$", head, re.I | re.M)
    return m[1].decode("utf-8", "replace") if m else None


def records(pieces: Iterator[bytes]) -> Iterator[tuple[bytes, int, Iterator[bytes]]]:
    """(header, body's length, body's pieces) of each record; the body is to be read before the next record."""
    reader = _Reader(pieces)
    while (head := reader.head()) is not None:
        if (m := _LENGTH.search(head.replace(b"\r\n", b"\n"))) is None:
            raise ValueError("a record has no Content-Length")
        n = int(m[1])
        yield head, n, reader.body(n)


def target_name(path: str, root: str | None = None) -> str:
    """The name of a file's normal form, without extension."""
    below = path.removeprefix(root.rstrip("/") + "/") if root else path
    stem = path.rsplit("/", 1)[-1].removesuffix(".gz").removesuffix(".warc")
    return f"{stem}-{hashlib.sha1(below.encode()).hexdigest()[:16]}"


def normalise_file(path: str, target: str, level: int = LEVEL, root: str | None = None) -> Iterator[list[tuple]]:
    """Normalises one file; its index rows (see ``INDEX``), some at a time. The file is there once all are read."""
    system, source = _open(path)
    out_system, folder = _open(target)
    out_system.create_dir(folder, recursive=True)
    name = target_name(path, root)
    temporary, rows, offset, k = f"{folder}/.{name}-{uuid.uuid4().hex}", [], 0, 0
    try:
        with (
            system.open_input_stream(source, compression=None) as raw,
            out_system.open_output_stream(temporary, compression=None) as sink,
            out_system.open_output_stream(f"{temporary}.idx", compression=None) as index,
        ):
            for head, n, body in records(inflated(raw)):
                squeeze, digest = zlib.compressobj(level, zlib.DEFLATED, 31), hashlib.sha1()
                parts, held = [squeeze.compress(head)], 0
                for piece in body:
                    digest.update(piece)
                    parts.append(squeeze.compress(piece))
                    held += len(parts[-1])
                    if held > PIECE:
                        sink.write(b"".join(parts))
                        parts, held = [], 0
                parts += [squeeze.compress(b"\r\n\r\n"), squeeze.flush()]
                sink.write(b"".join(parts))
                length = sink.tell() - offset
                row = (f"{name}.warc.gz", k, offset, length, _field(head, b"WARC-Type"), _field(head, b"WARC-Record-ID"), _field(head, b"WARC-Target-URI"), n, digest.hexdigest())
                index.write(("\t".join("" if x is None else str(x).replace("\t", "%09") for x in row[1:]) + "\n").encode())
                rows.append(row)
                offset, k = offset + length, k + 1
                if len(rows) >= INDEX_ROWS:
                    yield rows
                    rows = []
    except (ValueError, zlib.error) as x:
        raise ValueError(f"{path}: {x}") from x
    out_system.move(f"{temporary}.idx", f"{folder}/{name}.idx")
    out_system.move(temporary, f"{folder}/{name}.warc.gz")
    yield rows


def _normalise(target: str, level: int, root: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in INDEX.split(", ")]
        types = [pa.int64() if c.endswith("long") else pa.string() for c in INDEX.split(", ")]
        for b in batches:
            for path in b.column(0).to_pylist():
                for rows in normalise_file(path, target, level, root):
                    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names)

    return run


def normalised(paths: DataFrame, target: str, level: int = LEVEL, root: str | None = None) -> DataFrame:
    """Normalises the files of the column ``path``, each in a task of its own, to the folder ``target``; the index."""
    own = paths.select("path").where("path is not null").distinct()
    return written(own.repartition(max(1, own.count())).mapInArrow(_normalise(target, level, root), INDEX), "warc-index")


def read_record(target: str, file: str, offset: int, length: int) -> tuple[bytes, bytes]:
    """Header and body of one record, by its place in the index."""
    system, folder = _open(target)
    with system.open_input_file(f"{folder}/{file}") as f:
        f.seek(offset)
        raw = f.read(length)
    head, n, body = next(records(iter([zlib.decompress(raw, 31)])))
    return head, b"".join(body)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages, written as monolithic files, normalised: the index with each record's page_id."""
    crawl = new_path(spark, "warc-crawl")
    paths = write_monoliths(spark.read.parquet(f"{sf_dir}/pages.parquet"), crawl)
    index = normalised(paths, new_path(spark, "warc"), root=crawl)
    return index.select(F.regexp_extract("id", r"^<urn:page:(-?\d+)>$", 1).try_cast("long").alias("page_id"), "file", "record", "offset", "length", "uri", "n_bytes", "sha1")
