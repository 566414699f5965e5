"""Operator 8, secret scans through a trigram inverted index.

From each rule's regex a Boolean query of trigrams is derived that every match satisfies (on text folded to ASCII
lower case). Documents are indexed in segments, one for each few megabytes, held only while they are scanned: for the trigrams
of the rules, the sorted ordinals of the documents that have them. A query intersects and unites postings; its candidates
are verified with the regex. A rule without mandatory trigrams scans every document. Segments need no shuffle, and whole
texts are indexed and verified.

Rules see characters, not bytes; ``\\b``, ``\\d``, ``\\s``, ``\\w`` and ``(?i)`` know ASCII alone. So ``{6,}`` counts an accented letter once, and no match ends within one.

Null and empty texts have no secrets. Repeated rows are each reported. Rows without a doc_id are reported with a null; a doc_id has to be an integer.
Other columns are not read by the scan, and stay as they are in ``redacted``. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .kernel import buffers, chunks
from .shared import unused

#: White space, as a class and within one: what RE2 and Python agree on.
_S = r"[ \t\r\n\f]"


def _any_case(word: str) -> str:
    """A regex for a word in any ASCII case, without a flag (RE2's folds more than ASCII)."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


def _one_of(*words: str) -> str:
    return "(?:" + "|".join(_any_case(w) for w in words) + ")"


#: A key after its first line: all through its END line if no other line of hyphens comes before, else its header lines and the run of base64.
_KEY = r"PRIVATE KEY(?: BLOCK)?-----"
_BASE64 = r"(?:[ \t\r]*\n[ \t]*[A-Za-z0-9+/=]+[ \t\r]*$|(?:[ \t]|\\[nr])+[A-Za-z0-9+/=]{40,})*"
_BODY = (
    r"(?:[^-]*(?:-{1,4}[^-]+)*-----END (?:RSA |EC |DSA |OPENSSH |PGP )?" + _KEY
    + r"|(?:[ \t\r]*\n(?:Proc-Type|DEK-Info|Version|Comment|Hash|Charset): [^\r\n]*)*(?:[ \t\r]*\n[ \t\r]*$)?" + _BASE64 + ")"
)
_IS = _S + r"{0,3}[:=]" + _S + r"""{0,3}["']?"""

#: name, regex (the common ground of Python's regexes and RE2)
RULES: tuple[tuple[str, str], ...] = (
    ("aws_access_key", r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b"),
    ("github_token", r"\bgh[pousr]_[A-Za-z0-9]{36,}\b"),
    ("slack_token", r"\bxox[abprs]-[A-Za-z0-9-]{10,}"),
    ("google_api_key", r"\bAIza[0-9A-Za-z_-]{35}"),
    ("stripe_key", r"\b[sr]k_(?:live|test)_[0-9A-Za-z]{16,}"),
    ("json_web_token", r"\beyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    ("private_key", r"(?m)-----BEGIN (?:RSA |EC |DSA |OPENSSH |PGP )?" + _KEY + _BODY),
    ("url_credentials", r"\b[A-Za-z][A-Za-z0-9+.-]+://[^ \t\r\n\f:/@]+:[^ \t\r\n\f:/@]{3,}@"),
    ("password", r"\b" + _one_of("password", "passwd", "passphrase", "pwd") + _IS + r"""[^ \t\r\n\f"']{6,}["']?"""),
    ("secret_assignment", r"\b(?:" + _one_of("token", "secret") + "|" + _one_of("api", "access", "auth") + "[_-]?" + _any_case("key") + ")" + _IS + r"""[A-Za-z0-9_./+=-]{16,}["']?"""),
    ("hex_digest_key", r"\b[0-9a-f]{40}\b"),
)

#: Sets of alternative strings grow up to here before they become a query.
_MOST = 24


@dataclass(frozen=True)
class Query:
    """op is all, tri, and, or."""

    op: str
    gram: bytes = b""
    parts: tuple[Query, ...] = ()


ALL = Query("all")


def _and(parts: list[Query]) -> Query:
    flat = dict.fromkeys(x for p in parts for x in (p.parts if p.op == "and" else (p,)) if x.op != "all")
    return ALL if not flat else next(iter(flat)) if len(flat) == 1 else Query("and", parts=tuple(flat))


def _or(parts: list[Query]) -> Query:
    flat = dict.fromkeys(x for p in parts for x in (p.parts if p.op == "or" else (p,)))
    return ALL if not flat or ALL in flat else next(iter(flat)) if len(flat) == 1 else Query("or", parts=tuple(flat))


def _grams(s: bytes) -> Query:
    return _and([Query("tri", s[i : i + 3]) for i in range(len(s) - 2)])


class _Run:
    """Reads a regex from left to right: the strings that the text just read may end with, and the query so far."""

    def __init__(self) -> None:
        self.tails: set[bytes] = {b""}
        self.found: list[Query] = []

    def settle(self) -> None:
        self.found.append(_or([_grams(t) for t in self.tails]))

    def add(self, options: set[bytes]) -> None:
        grown = {t + o for t in self.tails for o in options}
        if len(grown) > _MOST:
            self.settle()
            self.tails = {t[-2:] for t in self.tails}
            grown = {t + o for t in self.tails for o in options}
            if len(grown) > _MOST:
                self.tails = {b""}
                grown = options if len(options) <= _MOST else {b""}
        self.tails = grown

    def gap(self, inner: Query = ALL) -> None:
        self.settle()
        self.found.append(inner)
        self.tails = {b""}

    def query(self) -> Query:
        self.settle()
        return _and(self.found)


#: What a regex is read as: ("set", folded one-character strings or None for too many), ("cat", parts), ("alt", sides), ("rep", part, low, high or None).
_Node = tuple
_EMPTY: _Node = ("cat", ())
_WIDE: _Node = ("set", None)
_ESCAPES = {"n": "\n", "r": "\r", "t": "\t", "f": "\f", "v": "\v", "a": "\a", "0": "\0"}
_CLASSES = {"d": "0123456789"}


class _Parser:
    """Reads the common ground of Python's regexes and RE2. What it does not know it reads as any text, which asks for no trigram."""

    def __init__(self, regex: str) -> None:
        self.s, self.i = regex, 0

    def read(self) -> _Node:
        node = self.sides()
        return node if self.i == len(self.s) else ("rep", _WIDE, 0, None)

    def peek(self, n: int = 1) -> str:
        return self.s[self.i : self.i + n]

    def sides(self) -> _Node:
        sides = [self.cat()]
        while self.peek() == "|":
            self.i += 1
            sides.append(self.cat())
        return sides[0] if len(sides) == 1 else ("alt", tuple(sides))

    def cat(self) -> _Node:
        parts = []
        while self.i < len(self.s) and self.peek() not in "|)":
            parts.append(self.repeat(self.item()))
        return parts[0] if len(parts) == 1 else ("cat", tuple(parts))

    def repeat(self, node: _Node) -> _Node:
        while self.i < len(self.s):
            if (c := self.peek()) in "*+?":
                self.i += 1
                low, high = {"*": (0, None), "+": (1, None), "?": (0, 1)}[c]
            elif m := re.compile(r"\{(\d*)(,?)(\d*)\}").match(self.s, self.i):
                if not m[1] and not m[3]:
                    break
                self.i = m.end()
                low = int(m[1] or 0)
                high = (int(m[3]) if m[3] else None) if m[2] else low
            else:
                break
            node = ("rep", node, low, high)
            if self.peek() in ("?", "+"):  # lazy or possessive
                self.i += 1
        return node

    def item(self) -> _Node:
        c = self.peek()
        self.i += 1
        if c == "(":
            return self.group()
        if c == "[":
            return self.in_class()
        if c == "\\":
            return self.escape()
        if c in "^$":
            return _EMPTY
        if c == ".":
            return _WIDE
        return _text(c)

    def group(self) -> _Node:
        if self.peek() == "?":
            if m := re.compile(r"\?[a-zA-Z]+\)").match(self.s, self.i):  # flags: folding is done anyway, a free-spacing one is not known
                self.i = m.end()
                return ("rep", _WIDE, 0, None) if "x" in m[0] else _EMPTY
            if not (m := re.compile(r"\?(?:[a-wyzA-Z-]*:|P?<[A-Za-z_]\w*>)").match(self.s, self.i)):
                self.sides()  # a look-around or another extension
                self.i += 1
                return ("rep", _WIDE, 0, None)
            self.i = m.end()
        node = self.sides()
        self.i += 1
        return node

    def escape(self) -> _Node:
        c = self.peek()
        self.i += 1
        if c in "bBAzZ":
            return _EMPTY
        if c in _CLASSES:
            return ("set", frozenset(_CLASSES[c]))
        if c in "DsSwWpP" or c.isdigit() and c != "0" or c in "xuUNQCk":
            if c in "pP" and self.peek() == "{":
                self.i = self.s.index("}", self.i) + 1
            return _WIDE if c in "DsSwWpP" else ("rep", _WIDE, 0, None)
        return _text(_ESCAPES.get(c, c))

    def in_class(self) -> _Node:
        wide, out, first = self.peek() == "^", set(), True
        self.i += wide
        while self.i < len(self.s) and (first or self.peek() != "]"):
            first = False
            if self.peek(2) == "[:":
                self.i, wide = self.s.index(":]", self.i) + 2, True
                continue
            a = self.class_char()
            if self.peek() == "-" and self.peek(2) not in ("-]", "-"):
                self.i += 1
                b = self.class_char()
                if a is None or b is None or not 0 <= ord(b) - ord(a) < 64:
                    wide = True
                else:
                    out |= {chr(x) for x in range(ord(a), ord(b) + 1)}
            elif a is None:
                wide = True
            else:
                out.add(a)
        self.i += 1
        return _WIDE if wide or any(ord(x) > 127 for x in out) else ("set", frozenset(x.lower() for x in out))

    def class_char(self) -> str | None:
        c = self.peek()
        self.i += 1
        if c != "\\":
            return c
        c = self.peek()
        self.i += 1
        if c in "dDsSwWpPxuUN" or c.isdigit() and c != "0":
            if c in "pP" and self.peek() == "{":
                self.i = self.s.index("}", self.i) + 1
            return None
        return "\b" if c == "b" else _ESCAPES.get(c, c)


def _text(c: str) -> _Node:
    return ("set", frozenset((c.lower(),))) if ord(c) < 128 else ("lit", c.encode())


def _options(node: _Node) -> set[bytes] | None:
    """The folded strings that one item may be, if they are few."""
    if node[0] == "lit":
        return {node[1]}
    return {c.encode() for c in node[1]} if node[0] == "set" and node[1] is not None else None


def _read(node: _Node, run: _Run) -> None:
    if (few := _options(node)) is not None:
        run.add(few)
    elif node[0] == "cat":
        for part in node[1]:
            _read(part, run)
    elif node[0] == "alt":
        sides = []
        for side in node[1]:
            r = _Run()
            _read(side, r)
            sides.append((r.tails if _exact(side) else None, r.query()))
        exact = [t for t, _ in sides]
        if None not in exact and len(joined := set().union(*exact)) <= _MOST:
            run.add(joined)
        else:
            run.gap(_or([q for _, q in sides]))
    elif node[0] == "rep":
        _, inner, low, high = node
        if (low, high) == (0, 1) and _exact(inner):
            r = _Run()
            _read(inner, r)
            run.add(r.tails | {b""})
            return
        for _ in range(min(low, 8)):
            _read(inner, run)
        if low > 8 or high != low:
            run.gap()
    else:
        run.gap()


def _exact(node: _Node) -> bool:
    """Whether reading this keeps all its text in the tails."""
    if node[0] == "cat":
        if not all(_exact(p) for p in node[1]):
            return False
    elif node[0] == "alt":
        return False
    elif node[0] == "rep":
        if node[2:] != (0, 1) or not _exact(node[1]):
            return False
    elif (few := _options(node)) is None or len(few) > _MOST:
        return False
    r = _Run()
    _read(node, r)
    return not r.found


def derive(regex: str) -> Query:
    """The trigram query of a regex, on text in ASCII lower case."""
    run = _Run()
    _read(_Parser(regex).read(), run)
    return run.query()


def _needed(q: Query) -> set[bytes]:
    return {q.gram} if q.op == "tri" else set().union(*(_needed(p) for p in q.parts)) if q.parts else set()


_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


class Scanner:
    """The rules, compiled; made once in each task."""

    def __init__(self, rules: tuple[tuple[str, str], ...]) -> None:
        self.names = [n for n, _ in rules]
        self.regexes = [re.compile(r, re.ASCII) for _, r in rules]
        self.queries = [derive(r) for _, r in rules]
        grams = sorted(set().union(*(_needed(q) for q in self.queries)) if rules else set())
        self.codes = np.array([int.from_bytes(g, "big") for g in grams], np.int32)
        self.number = {g: i for i, g in enumerate(grams)}
        self.wanted = np.zeros(1 << 24, bool)
        self.wanted[self.codes] = True

    def index(self, buf: np.ndarray, offs: np.ndarray) -> list[np.ndarray]:
        """For each trigram of the rules, the documents that have it, in order."""
        n = len(offs) - 1
        if len(buf) < 3 or not len(self.codes):
            return [np.zeros(0, np.int64)] * len(self.codes)
        low = _FOLD[buf].astype(np.int32)
        code = (low[:-2] << 16) | (low[1:-1] << 8) | low[2:]
        at = np.flatnonzero(self.wanted[code])
        doc = np.searchsorted(offs, at, "right") - 1
        own = at + 2 < offs[doc + 1]  # else the trigram reaches into the next document
        key = np.unique(np.searchsorted(self.codes, code[at[own]]).astype(np.int64) * n + doc[own])
        cut = np.searchsorted(key, np.arange(len(self.codes) + 1) * n)
        return [key[a:b] - i * n for i, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True))]

    def candidates(self, q: Query, postings: list[np.ndarray], n: int) -> np.ndarray:
        if q.op == "tri":
            return postings[self.number[q.gram]]
        if q.op == "all":
            return np.arange(n)
        if q.op == "or":
            return np.unique(np.concatenate([self.candidates(p, postings, n) for p in q.parts]))
        out = None
        for part in sorted((self.candidates(p, postings, n) for p in q.parts), key=len):
            out = part if out is None else out[np.isin(out, part, assume_unique=True)]
            if not len(out):
                break
        return out

    def scan(self, buf: np.ndarray, offs: np.ndarray) -> Iterator[tuple[int, str, list[tuple[int, int, int]]]]:
        """(document, its text, all matches in it as rule, start, end), by document; matches count characters."""
        n, postings, raw = len(offs) - 1, self.index(buf, offs), buf.tobytes()
        own = [self.candidates(q, postings, n) for q in self.queries]
        doc, rule = np.concatenate([np.zeros(0, np.int64), *own]).astype(np.int64), np.repeat(np.arange(len(own)), [len(x) for x in own])
        order = np.lexsort((rule, doc))
        doc, rule = doc[order], rule[order]
        cut = np.flatnonzero(np.diff(doc, prepend=-1, append=-1)).tolist() if len(doc) else []
        for a, z in pairwise(cut):
            d = int(doc[a])
            text = raw[offs[d] : offs[d + 1]].decode("utf-8", "replace")
            found = [(k, *m.span()) for k in rule[a:z].tolist() for m in self.regexes[k].finditer(text) if m.end() > m.start()]
            if found:
                yield d, text, found


def _report(rules: tuple[tuple[str, str], ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(rules)
        for b in batches:
            buf, offs = buffers(b.column(1))
            for i, j in chunks(offs):
                found = [(i + d, scanner.names[k], text[s:e]) for d, text, own in scanner.scan(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i]) for k, s, e in own]
                ids = b.column(0).take(pa.array([d for d, *_ in found], pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, pa.array([n for _, n, _ in found], pa.string()), pa.array([x for *_, x in found], pa.string())], ["doc_id", "rule", "secret"])

    return run


def secrets(docs: DataFrame, rules: tuple[tuple[str, str], ...] = RULES) -> DataFrame:
    """One row for each match of each rule: doc_id, rule, secret. Matches of different rules may overlap."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_report(tuple(rules)), "doc_id long, rule string, secret string")


def redactor(rules: tuple[tuple[str, str], ...] = RULES):
    """A column function: the text with each secret (overlapping ones together) replaced by its rule's name in brackets."""
    rules = tuple(rules)
    made: list[Scanner] = []

    @F.arrow_udf("string")
    def redact(text: pa.Array) -> pa.Array:
        if not made:
            made.append(Scanner(rules))
        scanner, n = made[0], len(text)
        buf, offs = buffers(text)
        at, new = [], []
        for i, j in chunks(offs):
            for d, own, found in scanner.scan(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i]):
                out, pos = [], 0
                for s, e, k in sorted((s, -e, k) for k, s, e in found):
                    if s >= pos:
                        out += [own[pos:s], "[", scanner.names[k], "]"]
                    pos = max(pos, -e)
                at.append(i + d)
                new.append("".join([*out, own[pos:]]))
        if not at:
            return text
        mask = np.zeros(n, bool)
        mask[at] = True
        return pc.replace_with_mask(text, pa.array(mask), pa.array(new, text.type))

    return redact


def redacted(docs: DataFrame, rules: tuple[tuple[str, str], ...] = RULES) -> DataFrame:
    """All rows and columns of ``docs``; secrets in text are replaced and n_chars, where there is such a column, follows."""
    names, clean = docs.columns, unused(docs, "_clean")
    made = docs.withColumn(clean, redactor(rules)("text"))
    new = {"text": F.col(clean)}
    if "n_chars" in names:
        changed = ~F.col("text").eqNullSafe(F.col(clean))
        new["n_chars"] = F.when(changed, F.length(clean)).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return made.select(*[new[c].alias(c) if c in new else F.col(f"`{c}`") for c in names])


def op8_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _sql() -> str:
    quoted = [(n, r.replace("'", "''")) for n, r in RULES]
    return " UNION ALL ".join(f"SELECT doc_id, '{n}' AS rule, unnest(regexp_extract_all(text, '{r}')) AS secret FROM documents" for n, r in quoted)


OP8_SQL = _sql()
