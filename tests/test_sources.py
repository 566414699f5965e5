import struct

import numpy as np
import pytest

from vellumflow.sources import codecs, files, pagexml, tei


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize(
    ("text", "want"),
    [("a:b:c", ["a", "b", "c"]), ("/a/b:/c", ["/a/b", "/c"]), ("hdfs://n:9000/x:s3a://b/y", ["hdfs://n:9000/x", "s3a://b/y"]), ("file:/a:file:///b:c", ["file:/a", "file:///b", "c"]), ("", []), (["hdfs://a:1/b", ""], ["hdfs://a:1/b"])],
)
def test_paths(text, want):
    assert files.split_paths(text) == want


def folder(tmp_path):
    for name in ("a/x.jpg", "a/page/x.xml", "a/mets.xml", "b/y.JPG", "b/c/z.jpg", "b/c/z1.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(name)
    return f"file://{tmp_path}"


def test_listings(spark, tmp_path):
    root = folder(tmp_path)
    every = files.listing(spark, root)
    name = lambda df: sorted(r.name for r in df.collect())
    assert name(files.listing(spark, root, ("jpg",))) == ["x.jpg", "y.JPG", "z.jpg"]
    assert name(files.without_metadata(every)) == ["x.jpg", "x.xml", "y.JPG", "z.jpg", "z1.txt"] and "x.xml" not in name(files.outside_page_folders(every))
    assert {r.parent.rsplit("/", 1)[-1] for r in files.leaf_folders(every).collect()} == {"a", "c"}
    assert files.one_named(every, "z.jpg").count() == 1
    (tmp_path / "list.txt").write_text("p1\n\np2\n")
    assert files.files_or_folders(spark, [root + "/list.txt", root + "/a"], ("jpg",)).count() == 3
    pair = files.partners(files.listing(spark, root, ("jpg",)), files.listing(spark, root, ("xml",)), nested="page").where("partner is not null")
    assert [r.partner.rsplit("/", 2)[1:] for r in pair.collect()] == [["page", "x.xml"]]
    near = files.nearest_name(files.listing(spark, root + "/b/c", ("jpg",)), files.listing(spark, root + "/b/c", ("txt",)))
    assert near.first().partner.endswith("z1.txt")
    assert files.allowed(every, spark.createDataFrame([("x.jpg",), ("x.jpg",)], "name string"), "name").count() == 1


def test_feature_files_of_the_three_forms(spark, tmp_path):
    head = struct.pack(">iihh", 2, -1, 3, 6)
    assert codecs.decode_matrix(head + bytes([128, 0, 127, 255, 1, 2])).shape == (2, 3)
    assert codecs.decode_matrix(head + bytes([128] * 6))[0, 0] == pytest.approx(0, abs=0.003) and codecs.decode_matrix(head + bytes([127] * 6))[0, 0] == pytest.approx(1, abs=0.003)
    short = struct.pack(">iihh", 1, -10, 4, 6) + struct.pack(">hh", -32768, 32767)
    assert np.allclose(codecs.decode_matrix(short), [[-10, 0]], atol=1e-3)
    x = np.random.default_rng(0).random((40, 50))
    for kind, bound, of in ((codecs.BYTE, 2e-3, x), (codecs.SHORT_LOG, 2e-4, -x * 9), (codecs.FLOAT, 2e-8, x)):
        raw = codecs.encode_matrix(of, kind)
        assert np.sqrt(np.mean((codecs.decode_matrix(raw) - of) ** 2)) < bound
        assert struct.unpack(">iihh", raw[:12]) == (40, {codecs.BYTE: -1, codecs.SHORT_LOG: -10, codecs.FLOAT: 1}[kind], {codecs.BYTE: 50, codecs.SHORT_LOG: 100, codecs.FLOAT: 200}[kind], 6)
    for bad, kind in ((x + 1, codecs.BYTE), (x, codecs.SHORT_LOG)):
        with pytest.raises(ValueError):
            codecs.encode_matrix(bad, kind)
    with pytest.raises(ValueError):
        codecs.encode_matrix(-x, codecs.SHORT_LOG, -1)
    df = spark.createDataFrame([(f"file://{tmp_path}/m.bin", x.tolist())], "path string, matrix array<array<double>>")
    assert codecs.write_matrices(df).count() == 1
    assert np.allclose(codecs.read_matrices(spark, f"{tmp_path}/m.bin").first().matrix, x, atol=1e-6)


def test_char_maps(spark, tmp_path):
    (tmp_path / "cm.txt").write_text("a=0\nA=0\n =1\n\\==2\n\\\\=3\n\\u0308=4\n", encoding="utf-8")
    got = codecs.read_char_map(spark, f"{tmp_path}/cm.txt")
    assert rows(got) == sorted([(1, "a"), (1, "A"), (2, " "), (3, "="), (4, "\\"), (5, "\u0308")], key=str)
    lines = [r.value for r in codecs.char_map_lines(got).collect()]
    assert lines == ["A=1", "a=1", " =2", "\\==3", "\\\\=4", "\\u0308=5"]
    assert codecs.same_char_maps(got, got) and not codecs.same_char_maps(got, got.where("channel > 1"))
    (tmp_path / "gap.txt").write_text("a=0\nb=2\n")
    with pytest.raises(Exception, match="missing"):
        codecs.read_char_map(spark, f"{tmp_path}/gap.txt").collect()


def test_dictionaries_and_side_files(spark, tmp_path):
    words = spark.createDataFrame([("b", 2), ("a", 2), ("c", 1)], "term string, cnt long")
    codecs.write_dictionary(words, f"{tmp_path}/d")
    assert rows(codecs.read_dictionary(spark, f"{tmp_path}/d")) == rows(words) and rows(codecs.read_dictionary(spark, f"{tmp_path}/d", 1)) == [("a", 2)]
    (tmp_path / "x.info").write_text("lineID\nl1\nbaseline\n1,2 3,4\n")
    assert codecs.read_info(spark, f"{tmp_path}/x.info").first().info == {"lineID": "l1", "baseline": "1,2 3,4"}
    costs = {r.term: r.cost for r in codecs.parse_arpa(spark.createDataFrame([("\\data\\",), ("-1.0\tthe",), ("-2.5 of",)], "value string")).collect()}
    assert costs == {"the": pytest.approx(2.302585), "of": pytest.approx(5.756463)}


def test_page_xml_round_trip(spark, tmp_path):
    line = ("l1", "text & more", 0.5, "readingOrder {index:0;}", "1,2 3,4", "0,0 5,0 5,5")
    df = spark.createDataFrame([("00001_0002_000003", 1, 2, "GT", "i.jpg", 10, 20, [("r1", 0.0, "0,0 9,9 9,0", None, [line, ("l2", None, None, None, None, "0,0 1,1 1,0")])])],
        "page_id string, doc_id long, page_nr int, status string, image string, width int, height int, regions array<struct<region_id:string,orientation:float,coords:string,custom:string,lines:array<struct<line_id:string,text:string,conf:float,custom:string,baseline:string,coords:string>>>>")
    pagexml.write_pages(df, f"{tmp_path}/p")
    back = pagexml.read_pages(spark, f"{tmp_path}/p").first()
    assert (back.page_id, back.status, back.width) == ("00001_0002_000003", "GT", 10)
    got = back.regions[0].lines[0]
    assert (got.line_id, got.text, got.conf, got.baseline) == ("l1", "text & more", 0.5, "1,2 3,4") and back.regions[0].lines[1].text is None
    assert pagexml.plain_text(df).first().value == "text & more"


def test_tei():
    source = "<TEI><text><body><p>One<lb/>two <choice><sic>teh</sic><corr>the</corr></choice></p><pb n='7'/><p>x<note>aside</note>y<gap/>z</p><lb/>last</body></text></TEI>"
    assert tei.parse(source) == [("???", ["One", "two teh"]), ("0007", ["aside", "last"])]
    with pytest.raises(tei.TeiError):
        tei.parse("<TEI><text><hi rend='odd'>x</hi></text></TEI>")


def test_xml(spark, tmp_path):
    (tmp_path / "a.xml").write_text("<r><e><n>1</n><m>2</m></e><e><n>3</n></e></r>")
    got = files.read_xml(spark, f"{tmp_path}/a.xml", "e").select(files.child("element", "n").alias("n"), files.child("element", "m").alias("m"))
    assert rows(got) == [("1", "2"), ("3", None)]
