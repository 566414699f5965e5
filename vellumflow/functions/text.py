"""Column functions on text: tokens, folding, marks, codecs, patterns. All stay in the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A word: a letter, then letters and combining marks.
WORD = r"\p{L}[\p{L}\p{M}]*"
#: A word, or any other single character that is not white space.
WORD_OR_SIGN = r"\p{L}[\p{L}\p{M}]*|[^\s\p{L}]"
#: What may stand beside a whole keyword.
BORDER = r"\p{Z}\p{P}\p{S}"
#: Characters of known categories only; no astral ones.
VALID = r"^[\p{L}\p{N}\p{P}\p{Z}\p{S}\p{M}]*$"
ASTRAL = r"[\x{10000}-\x{10FFFF}]"
_MARKS = "؜‎‏‪‫‬‭‮⁦⁧⁨⁩"


def chars(text: Column) -> Column:
    """The characters (code points) of a text; null for null, none for an empty one."""
    return F.filter(F.split(text, ""), lambda c: c != "")


def words(text: Column) -> Column:
    """The words of a text in order."""
    return F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1))


def words_and_signs(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({WORD_OR_SIGN})"), F.lit(1))


def categorised(text: Column) -> Column:
    """Tokens, each a run of one category, with it: L (with marks), N, P, S, Z."""
    runs = F.regexp_extract_all(text, F.lit(r"(\p{L}[\p{L}\p{M}]*|\p{N}+|\p{P}+|\p{S}+|\p{Z}+)"), F.lit(1))
    kind = lambda t: F.when(t.rlike(r"^\p{L}"), "L").when(t.rlike(r"^\p{N}"), "N").when(t.rlike(r"^\p{P}"), "P").when(t.rlike(r"^\p{S}"), "S").otherwise("Z")
    return F.transform(runs, lambda t: F.struct(t.alias("token"), kind(t).alias("category")))


def keyword_tokens(text: Column, alpha: bool = True, upper: bool = False) -> Column:
    """Tokens of letters, or of letters and of numbers."""
    out = words(text) if alpha else F.regexp_extract_all(text, F.lit(rf"({WORD}|\p{{N}}+)"), F.lit(1))
    return F.transform(out, F.upper) if upper else out


def lines(text: Column) -> Column:
    return F.split(text, "\n")


def fold_space(text: Column) -> Column:
    """White space folded to single spaces and trimmed."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def filled_lines(text: Column) -> Column:
    """The lines with white space folded, empty ones left out."""
    return F.filter(F.transform(lines(text), fold_space), lambda x: x != "")


def strip_marks(text: Column) -> Column:
    """Without the direction marks of Unicode."""
    return F.translate(text, _MARKS, "")


def transcript(text: Column) -> Column:
    """A line's transcript: without line feeds; null for null."""
    return F.replace(text, F.lit("\n"), F.lit(""))


def join_hyphens(text: Column) -> Column:
    """Line-end hyphens go, with the line ends up to the next token: the word's parts are one word."""
    return F.regexp_replace(text, r"(\p{L})-\n[ \t\n]*", "$1")


def valid_line(text: Column) -> Column:
    """Whether all characters have a known category and none is astral."""
    return text.rlike(VALID) & ~text.rlike(ASTRAL)


def wer_tokens(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, "[ ]+"), F.trim), lambda t: t != "")


def padded(name: Column, width: int = 4) -> Column:
    """A numeric name with zeros before it, any other unchanged."""
    number = name.try_cast("int")
    return F.when(number.isNotNull() & name.rlike(r"^[+-]?\d+$"), F.format_string(f"%0{width}d", number)).otherwise(name)


def page_key(doc_id: Column, page_nr: Column, page_id: Column, image: Column) -> Column:
    """A page's identity: its three numbers, or the stem of its image file."""
    numbers = F.format_string("%05d_%04d_%06d", doc_id, page_nr, page_id)
    known = doc_id.isNotNull() & page_nr.isNotNull() & page_id.isNotNull()
    return F.when(known, numbers).otherwise(F.regexp_extract(image, r"([^/]*?)(?:\.[^./]*)?$", 1))


def parse_tags(custom: Column) -> Column:
    """``name {k:v; k:v;} name {...}`` as an array of (tag, attrs)."""
    parts = F.regexp_extract_all(custom, F.lit(r"([\w-]+\s*\{[^}]*\})"), F.lit(1))
    attrs = lambda p: F.filter(F.transform(F.split(F.regexp_extract(p, r"\{([^}]*)\}", 1), ";"), lambda x: F.trim(x)), lambda x: F.contains(x, F.lit(":")))
    return F.transform(
        parts,
        lambda p: F.struct(
            F.regexp_extract(p, r"^([\w-]+)", 1).alias("tag"),
            F.map_from_entries(F.transform(attrs(p), lambda a: F.struct(F.trim(F.substring_index(a, ":", 1)), F.trim(F.regexp_replace(a, r"^[^:]*:", ""))))).alias("attrs"),
        ),
    )


def keep_tags(custom: Column, *names: str) -> Column:
    """Only the named tags, as text again."""
    parts = F.regexp_extract_all(custom, F.lit(r"([\w-]+\s*\{[^}]*\})"), F.lit(1))
    return F.array_join(F.filter(parts, lambda p: F.regexp_extract(p, r"^([\w-]+)", 1).isin(*names)), " ")


def log_fields(record: Column) -> Column:
    """A training log's ``Run;..;Train;k=v;..;Val;k=v;..;stamp;`` as a map of ``phase.k`` to v."""
    fields = F.filter(F.split(record, ";"), lambda x: x != "")
    step = F.aggregate(
        fields,
        F.struct(F.lit("").alias("phase"), F.array().cast("array<struct<key:string,value:string>>").alias("out")),
        lambda acc, x: F.when(
            F.contains(x, F.lit("=")),
            F.struct(acc.phase.alias("phase"), F.concat(acc.out, F.array(F.struct(F.concat(acc.phase, F.lit("."), F.substring_index(x, "=", 1)).alias("key"), F.substr(x, F.instr(x, "=") + 1).alias("value")))).alias("out")),
        ).otherwise(F.struct(F.when(x.isin("Run", "Train", "Val"), x).otherwise(acc.phase).alias("phase"), acc.out.alias("out"))),
        lambda acc: acc.out,
    )
    return F.map_from_entries(step)


def class_text(characters: set[str]) -> str:
    """The body of a regex class of these characters: brackets and backslashes escaped, a hyphen last."""
    own = sorted(characters - {"-"})
    return "".join("\\" + c if c in "[]\\^" else c for c in own) + ("-" if "-" in characters else "")


def keyword_pattern(keyword: str, mode: str = "word", prefix: bool = False, suffix: bool = False, fold: bool = False) -> str:
    """A regex for a keyword in a line.

    Modes: ``word`` (between line ends or separators), ``part`` (anywhere), ``expert`` (the keyword is a regex). ``prefix``: the hit
    starts the line; ``suffix``: it ends it. Folding is a flag, so a pattern is never itself upper-cased.
    """
    if mode not in ("word", "part", "expert"):
        raise ValueError(f"no such mode: {mode}")
    body = f"(?:{keyword})" if mode == "expert" else re.sub(r"([\\.^$|?*+()\[\]{}])", r"\\\1", keyword)
    head = "^" if prefix else f"(?:^|[{BORDER}])" if mode == "word" else ""
    tail = "$" if suffix else f"(?:$|[{BORDER}])" if mode == "word" else ""
    return ("(?iu)" if fold else "") + head + body + tail


def grammar(word_chars: set[str], number_chars: set[str], before: set[str], after: set[str], separators: set[str], most: int = 16) -> str:
    """A regex of lines of up to ``most`` units, each of a word or a number with up to three signs before and after."""
    of = lambda cs: f"[{class_text(cs)}]" if cs else "(?!)"
    unit = f"(?:{of(before)}{{0,3}}(?:{of(word_chars)}+|{of(number_chars)}+){of(after)}{{0,3}})"
    return f"^{unit}(?:{of(separators)}{unit}){{0,{most - 1}}}$"
