import re

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from vellumflow.llm import secrets as S

from .data import DOCS, none, odd_docs

FOUND = ["AKIA" + "ABCD1234" * 2, 'password = "hunter2hunter2"', "ghp_" + "a1B2" * 9, "token: " + "0123456789abcdef" * 2, "f" * 40, "-----BEGIN RSA PRIVATE KEY-----", "https://user:passw0rd@host/x"]


def brute(rows):
    return sorted((i, n, m.group()) for i, t in rows if t for n, r in S.RULES for m in re.finditer(r, t, re.ASCII) if m.group())


def test_equals_full_scan(spark):
    rows = [(i, f"Some text {x} and more é {FOUND[(i * 3) % len(FOUND)]} end", "en", "s", 1) for i, x in enumerate(FOUND * 3)]
    rows += [(50, "nothing to see, only words", "en", "s", 1), (51, "AKIA" + "A" * 15, "en", "s", 1)]
    got = sorted((r.doc_id, r.rule, r.secret) for r in S.secrets(spark.createDataFrame(rows, DOCS)).collect())
    assert got == brute([r[:2] for r in rows]) and len(got) > 20


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="AKIaksxoxpwd=: tken_0123456789abcdefghp-é", max_size=200), st.sampled_from(FOUND), st.integers(0, 200))
def test_every_match_is_a_candidate(text, secret, at):
    import numpy as np

    own = text[:at] + secret + text[at:]
    raw = own.encode()
    scanner = S.Scanner(S.RULES)
    buf, offs = np.frombuffer(raw + raw, np.uint8), np.array([0, len(raw), 2 * len(raw)])
    got = sorted((d, *m) for d, _, found in scanner.scan(buf, offs) for m in found)
    want = sorted((d, k, *m.span()) for d in (0, 1) for k, (_, r) in enumerate(S.RULES) for m in re.finditer(r, own, re.ASCII) if m.group())
    assert got == want


ACCENTS = ["password: ééé", "password: éééééé", "password: " + "é" * 129, "pwd=" + "x" * 127 + "é", "Paſſword: abcdefgh", "passWORD='über-geheim'", "https://ü:ééé@x", "to\u212aen = " + "a" * 20, "secret=" + "b" * 20 + "é", "é" + "f" * 40 + "é", "password\x0b: abcdefgh", "ToKen:\n" + "Ab3_" * 5]


def test_equals_sql_on_characters_of_many_bytes(spark):
    rows = [(i, f"ü {x} end", "en", "s", 1) for i, x in enumerate(ACCENTS)]
    docs = spark.createDataFrame(rows, DOCS)
    got = sorted((r.doc_id, r.rule, r.secret) for r in S.secrets(docs).collect())
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [r[:2] for r in rows])
    assert got == sorted(con.execute(S.OP8_SQL).fetchall()) == brute([r[:2] for r in rows])
    assert {i for i, *_ in got} == {1, 2, 3, 5, 6, 8, 9, 11}
    clean = {r.doc_id: r.text for r in S.redacted(docs).collect()}
    assert clean[2] == clean[3] == "ü [password] end" and not any("\ufffd" in t for t in clean.values())


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["abc", "x", "[ab]", "[^a]", "(?:ab|cd)", "(?:abcd|x[yz]+)", "a?", "(?:bc)*", "b{2}", "c{1,3}", r"\b", r"\d", ".", "é", "(?i:Q)", "[a-c-]", "[]x]", r"\.", "(x|)", "a+?", "(?P<n>ab)"]), min_size=1, max_size=6), st.text("abcdxyzq1.é-]", max_size=12))
def test_derived_queries_hold_for_every_match(parts, text):
    """Whatever a regex matches has the trigrams that its query asks for."""
    regex = "".join(parts).replace("(?P<n>ab)(?P<n>ab)", "ab")
    try:
        found = [m.group() for m in re.finditer(regex, text, re.ASCII)]
    except re.error:
        return

    def holds(q, raw):
        return q.op == "all" or (q.gram in raw if q.op == "tri" else (all if q.op == "and" else any)(holds(p, raw) for p in q.parts))

    assert all(holds(S.derive(regex), m.lower().encode()) for m in found)


@pytest.mark.parametrize(("regex", "query"), [("abc", S.Query("tri", b"abc")), ("[0-9a-f]{40}", S.ALL), ("x?", S.ALL), ("(?i)ABC", S.Query("tri", b"abc")), ("a.c", S.ALL)])
def test_queries(regex, query):
    assert S.derive(regex) == query


def test_branches_and_repeats():
    q = S.derive(r"(?:foo|barx)\s*=[a-z]{2,}")
    assert {b"foo", b"bar", b"arx"} == S._needed(q) and q.op == "or"
    assert S._needed(S.derive(r"ab(?:cd)?ef")) == {b"abc", b"bcd", b"cde", b"def", b"abe", b"bef"}


def test_redaction(spark):
    text = f"é {FOUND[0]} mid token={'f' * 40} end"
    docs = spark.createDataFrame([(1, text, "en", "s", len(text)), (2, "clean", "en", "s", 77), (3, None, "en", "s", None)], DOCS)
    got = {r.doc_id: (r.text, r.n_chars) for r in S.redacted(docs).collect()}
    assert got[1][0] == "é [aws_access_key] mid [secret_assignment] end" and got[1][1] == len(got[1][0])
    assert got[2] == ("clean", 77) and got[3] == (None, None)


def test_odd_rows_and_empty(spark):
    docs = odd_docs(spark)
    assert S.secrets(docs).count() == 0
    out = S.redacted(docs)
    assert out.columns == docs.columns and sorted(map(str, out.collect())) == sorted(map(str, docs.collect()))
    assert S.secrets(none(spark)).count() == 0 and S.redacted(none(spark)).count() == 0


LINE = "MIIEow" + "Ab3/+Zq9" * 7
KEY = f"-----BEGIN RSA PRIVATE KEY-----\nProc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,0A1B\n\n{LINE}\n{LINE}\nAb3=\n-----END RSA PRIVATE KEY-----"
WHOLE = {
    "key": (KEY, "[private_key]"),
    "one line": (KEY.replace("\n", " "), "[private_key]"),
    "escaped": (KEY.replace("\n", "\\n"), "[private_key]"),
    "no end": (KEY.rpartition("\n")[0], "[private_key]"),
    "no end, one line": (f"-----BEGIN PRIVATE KEY----- {LINE} {LINE}", "[private_key]"),
    "password": ("password=" + "x#" * 100, "[password]"),
    "assignment": ("token: " + "Ab3_" * 100, "[secret_assignment]"),
    "url": ("https://" + "u" * 80 + ":" + "p" * 90 + "@", "[url_credentials]"),
}


@pytest.mark.parametrize("kind", WHOLE)
def test_whole_secrets_go(spark, kind):
    secret, name = WHOLE[kind]
    text = f"é before\n{secret}\nand more words after.\n{secret}\n\nThe end of it"
    docs = spark.createDataFrame([(1, text, "en", "s", len(text))], DOCS)
    assert [r.text for r in S.redacted(docs).collect()] == [f"é before\n{name}\nand more words after.\n{name}\n\nThe end of it"]
    assert [r.secret for r in S.secrets(docs).collect() if r.rule == name.strip("[]")] == [secret, secret]
