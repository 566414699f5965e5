import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from vellumflow.functions import options as O
from vellumflow.functions import text as T
from vellumflow.functions import unicode as U


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first().y


def test_tokens_rejoin(spark):
    text = "Ab cé, 12x! £5  y"
    tokens = one(spark, T.categorised, text)
    assert "".join(t.token for t in tokens) == text
    assert [t.category for t in tokens] == ["L", "Z", "L", "P", "Z", "N", "L", "P", "Z", "S", "N", "Z", "L"]
    assert "".join(one(spark, T.chars, text)) == text and one(spark, T.chars, "") == [] and one(spark, T.chars, None) is None
    assert one(spark, T.words, "à côté l'été") == ["à", "côté", "l", "été"]
    assert one(spark, lambda c: T.keyword_tokens(c, alpha=False, upper=True), "ab 12 c") == ["AB", "12", "C"]


@pytest.mark.parametrize(
    ("text", "joined"),
    [("a big-\nger one", "a bigger one"), ("big-\n\nger", "bigger"), ("x-\ny", "xy"), ("end -\nnext", "end -\nnext"), ("a-\nb-\nc", "abc"), ("kept-whole", "kept-whole"), ("last-\n", "last")],
)
def test_hyphens(spark, text, joined):
    assert one(spark, T.join_hyphens, text) == joined


def test_lines(spark):
    assert one(spark, T.filled_lines, " a \t b\n\n \nc") == ["a b", "c"]
    assert one(spark, T.transcript, "a\nb") == "ab" and one(spark, T.transcript, None) is None
    assert one(spark, T.valid_line, "ok, 1 é £") is True and one(spark, T.valid_line, "a\tb") is False and one(spark, T.valid_line, "𝒳") is False
    assert one(spark, T.wer_tokens, "  a  b ") == ["a", "b"]
    assert [one(spark, T.padded, v) for v in ("7", "12345", "7a", "")] == ["0007", "12345", "7a", ""]


def test_only_direction_marks_vanish(spark):
    every = [chr(c) for c in range(0x2020, 0x2070)] + ["؜"]
    rows = spark.createDataFrame([(f"ab{c}cd",) for c in every], "x string").select("x", T.strip_marks(F.col("x")).alias("y")).collect()
    gone = {r.x[2] for r in rows if r.y == "abcd"}
    assert gone == {chr(c) for c in (0x61C, *range(0x202A, 0x202F), *range(0x2066, 0x206A))} and all(r.y in (r.x, "abcd") for r in rows)


@pytest.mark.parametrize("direction", [U.SOFT_LTR, U.SOFT_RTL, U.LTR, U.RTL])
@pytest.mark.parametrize("text", ["plain", "אבג", "abc אבג def", "אבג abc דהו", "(אבג) x", "א1ב", ""])
def test_visual_order_round_trip(text, direction):
    if text == "(אבג) x" and direction in (U.SOFT_LTR, U.SOFT_RTL):
        pytest.skip("two logical texts have this visual order: only a given direction tells them apart")
    assert U.to_logical(U.to_visual(text, direction), direction) == text


def test_visual_order(spark):
    assert U.to_visual("אבג") == "גבא" and U.to_visual("ab אב cd") == "ab בא cd"
    assert one(spark, U.logical2visual, "ab") == "ab" and one(spark, U.logical2visual, "אב") == "בא" and one(spark, U.visual2logical, None) is None
    assert one(spark, lambda c: U.normalised(c, "NFD"), "é") == unicodedata.normalize("NFD", "é")
    with pytest.raises(ValueError, match="no such form"):
        U.normalised(F.col("x"), "NFX")


def test_tags(spark):
    custom = "readingOrder {index:0;} person {offset:3; length:5;} sic {}"
    tags = one(spark, T.parse_tags, custom)
    assert [(t.tag, t.attrs) for t in tags] == [("readingOrder", {"index": "0"}), ("person", {"offset": "3", "length": "5"}), ("sic", {})]
    assert one(spark, lambda c: T.keep_tags(c, "readingOrder"), custom) == "readingOrder {index:0;}"


def test_log_fields(spark):
    got = one(spark, T.log_fields, "Run;3;Train;CER=0.5;Val;CER=0.6;WER=0.9;2020-01-01_00:00:00;")
    assert got["Train.CER"] == "0.5" and got["Val.CER"] == "0.6" and got["Val.WER"] == "0.9"


@pytest.mark.parametrize(
    ("keyword", "line", "how", "hit"),
    [
        ("cat", "a cat!", {}, True), ("cat", "cats", {}, False), ("cat", "-cat", {}, True), ("cat", "cat", {}, True), ("cat", "1cat", {}, False), ("cat", "concatenate", {"mode": "part"}, True),
        ("cat", "cats", {"mode": "part", "prefix": True}, True), ("cat", "a cats", {"mode": "part", "prefix": True}, False), ("cat", "tomcat", {"mode": "part", "suffix": True}, True), ("cat", "cats", {"mode": "part", "suffix": True}, False),
        ("c.t", "cat", {}, False), ("c.t", "c.t", {}, True), ("c[au]t", "cut", {"mode": "expert"}, True), (r"\d", "x1", {"mode": "expert", "fold": True}, True), ("CAT", "cat", {"fold": True}, True), ("cat", "tomcat x", {"suffix": True}, False), ("cat", "a cat", {"suffix": True}, True),
    ],
)
def test_keyword_patterns(spark, keyword, line, how, hit):
    pattern = T.keyword_pattern(keyword, **how)
    assert spark.createDataFrame([(line,)], "x string").select(F.col("x").rlike(pattern).alias("y")).first().y is hit


def test_grammar():
    body = T.class_text(set("-]a^\\["))
    assert body.endswith("-") and all(re.fullmatch(f"[{body}]", c) for c in "-]a^\\[") and not re.fullmatch(f"[{body}]", "b")
    g = T.grammar(set("ab"), set("12"), set("("), set(").,"), set(" "), 3)
    assert re.fullmatch(g, "(ab). 12, a") and not re.fullmatch(g, "a b a b") and not re.fullmatch(g, "ab12")


def test_options(spark):
    a, b = {"net/k": "1"}, {"net/k": "2", "x": "3"}
    assert O.merged(a, b) == {"net/k": "1", "x": "3"} and O.subtree(b, "net") == {"k": "2"} and O.as_subtree({"k": "2"}, "net") == {"net/k": "2"}
    assert O.with_(a, "y", 5)["y"] == "5" and O.with_(b, "x", None) == {"net/k": "2"} and a == {"net/k": "1"}
    assert O.is_true({"a": "TRUE"}, "a") and not O.is_true({}, "a") and O.is_false({"a": "false"}, "a") and O.get(a, "z", "d") == "d"
    with pytest.raises(KeyError):
        O.parse_arguments(["--no", "1"], {"yes"})
    with pytest.raises(ValueError, match="not one of"):
        O.get({"a": "x"}, "a", allowed=("y",))
    row = spark.createDataFrame([(a, b)], "a map<string,string>, b map<string,string>").select(O.merge_maps(F.col("a"), F.col("b")).alias("m"), O.subtree_map(F.col("b"), "net").alias("s"), O.upsert_map(F.col("b"), "x", F.lit(None).cast("string")).alias("d")).first()
    assert (row.m, row.s, row.d) == ({"net/k": "1", "x": "3"}, {"k": "2"}, {"net/k": "2"})
