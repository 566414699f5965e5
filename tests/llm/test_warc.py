import gzip
import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from vellumflow.llm import warc as W

PAGES = "page_id long, url string, html string"


def test_round_trip(spark, tmp_path):
    rows = [(i, f"http://x/{i}", f"<p>page {i} é</p>\r\n\r\nWARC/1.0\r\n" * (i + 1)) for i in range(50)] + [(7, "http://x/7", "again"), (None, None, None), (60, "a\r\nb", ""), (61, "u", "z" * 3_000_000)]
    pages = spark.createDataFrame(rows, PAGES).withColumn("offset", F.lit("x")).withColumn("file", F.lit("x"))
    target = f"file://{tmp_path}/out"
    paths = W.write_monoliths(pages, f"file://{tmp_path}/in")
    index = W.normalised(paths, target).collect()
    assert len(index) == len(rows)
    got = []
    for r in index:
        head, body = W.read_record(target, r.file, r.offset, r.length)
        assert len(body) == r.n_bytes and hashlib.sha1(body).hexdigest() == r.sha1
        got.append((r.id, r.uri, body.decode()))
    want = [(f"<urn:page:{'' if i is None else i}>", None if u is None else u.replace("\r", "%0D").replace("\n", "%0A"), h or "") for i, u, h in rows]
    assert sorted(map(str, got)) == sorted(map(str, want))
    for file in {r.file for r in index}:
        own = sorted((r.offset, r.length) for r in index if r.file == file)
        raw = (tmp_path / "out" / file).read_bytes()
        assert [o for o, _ in own] == [sum(n for _, n in own[:k]) for k in range(len(own))] and own[-1][0] + own[-1][1] == len(raw)
        sidecar = (tmp_path / "out" / file.replace(".warc.gz", ".idx")).read_text().splitlines()
        assert [tuple(map(int, x.split("\t")[1:3])) for x in sidecar] == own


def test_members_and_damage(tmp_path):
    record = lambda body: b"WARC/1.0\r\nWARC-Type: resource\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (len(body), body)
    one = tmp_path / "a.warc.gz"
    one.write_bytes(gzip.compress(record(b"x") + record(b"")) + gzip.compress(record(b"yy")) + b"\0" * 100)
    whole = lambda *a: [r for part in W.normalise_file(*a) for r in part]
    rows = whole(str(one), str(tmp_path / "out"))
    assert [(r[1], r[7]) for r in rows] == [(0, 1), (1, 0), (2, 2)]
    again = whole(str(tmp_path / "out" / rows[0][0]), str(tmp_path / "twice"))
    assert [r[2:] for r in again] == [r[2:] for r in rows]  # what is normal stays as it is
    long = gzip.compress(record(b"x" * 10_000))
    for name, raw in (("cut", long[:-20]), ("head", gzip.compress(b"WARC/1.0\r\nContent-")), ("body", gzip.compress(record(b"xyz")[:-6])), ("kind", gzip.compress(b"HTTP/1.0\r\n\r\n")), ("size", gzip.compress(b"WARC/1.0\r\nA: b\r\n\r\n")), ("junk", b"not gzip")):
        bad = tmp_path / f"{name}.warc.gz"
        bad.write_bytes(raw)
        with pytest.raises((ValueError, zlib.error), match=name):
            whole(str(bad), str(tmp_path / "out"))


def test_empty(spark, tmp_path):
    paths = W.write_monoliths(spark.createDataFrame([], PAGES), f"file://{tmp_path}/none")
    assert paths.count() == 0 and W.normalised(paths, f"file://{tmp_path}/out").count() == 0


def test_equal_names_in_two_folders_stay_apart(spark, tmp_path):
    record = lambda body: b"WARC/1.0\r\nWARC-Type: resource\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (len(body), body)
    for folder in "ab":
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "x.warc.gz").write_bytes(gzip.compress(record(folder.encode() * 5)))
    paths = spark.createDataFrame([(f"file://{tmp_path}/{f}/x.warc.gz",) for f in "abb"] + [(None,)], "path string")
    index = W.normalised(paths, f"file://{tmp_path}/out").collect()
    bodies = sorted(W.read_record(f"file://{tmp_path}/out", r.file, r.offset, r.length)[1] for r in index)
    assert bodies == [b"aaaaa", b"bbbbb"] and len({r.file for r in index}) == 2


def test_result_repeats(spark, tmp_path):
    spark.createDataFrame([(i, f"http://x/{i}", f"<p>{i}</p>") for i in range(40)], PAGES).coalesce(2).write.parquet(f"{tmp_path}/pages.parquet")
    first, second = (sorted(map(tuple, W.op5_warc(spark, str(tmp_path)).collect())) for _ in range(2))
    assert first == second and len(first) == 40


def test_index_in_parts(tmp_path, monkeypatch):
    monkeypatch.setattr(W, "INDEX_ROWS", 2)
    body = b"".join(b"WARC/1.0\r\nContent-Length: 1\r\n\r\n%d\r\n\r\n" % k for k in range(5))
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(body))
    parts = list(W.normalise_file(str(tmp_path / "a.warc.gz"), str(tmp_path / "out")))
    assert [[r[1] for r in p] for p in parts] == [[0, 1], [2, 3], [4]]
    assert len((tmp_path / "out" / parts[0][0][0].replace(".warc.gz", ".idx")).read_text().splitlines()) == 5
