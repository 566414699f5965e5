"""Unicode functions that Spark lacks: normal forms, base characters, bidirectional order. Arrow-batched."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SOFT_LTR, SOFT_RTL, LTR, RTL = "soft_ltr", "soft_rtl", "ltr", "rtl"
_MARKS = frozenset("؜‎‏‪‫‬‭‮⁦⁧⁨⁩")


def normalised(text: Column, form: str) -> Column:
    """NFC, NFD, NFKC or NFKD; None leaves the text."""
    if form is None:
        return text
    if form not in ("NFC", "NFD", "NFKC", "NFKD"):
        raise ValueError(f"no such form: {form}")

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: x if x is None else unicodedata.normalize(form, x))

    # ASCII text is in every normal form
    return F.when(text.rlike(r"^\p{ASCII}*$"), text).otherwise(run(text))


@F.pandas_udf(T.StringType())
def base_char(s: pd.Series) -> pd.Series:
    """The first character of the NFKD form."""
    return s.map(lambda c: c if not c else unicodedata.normalize("NFKD", c)[0])


def levels(text: str, direction: str = SOFT_LTR) -> list[int]:
    """The embedding level of each character: a line of one paragraph without explicit embeddings."""
    kind = [unicodedata.bidirectional(c) for c in text]
    strong = next((k for k in kind if k in ("L", "R", "AL")), None)
    base = {LTR: 0, RTL: 1}.get(direction, (1 if strong in ("R", "AL") else 0) if strong else int(direction == SOFT_RTL))
    out = "R" if base else "L"
    last = out
    for i, k in enumerate(kind):  # weak types
        if k == "NSM":
            kind[i] = kind[i - 1] if i else out
        elif k == "EN" and last == "AL":
            kind[i] = "AN"
        if kind[i] in ("L", "R", "AL"):
            last = kind[i]
    kind = ["R" if k == "AL" else k for k in kind]
    for i in range(1, len(kind) - 1):
        if kind[i] in ("ES", "CS") and kind[i - 1] == kind[i + 1] == "EN":
            kind[i] = "EN"
        elif kind[i] == "CS" and kind[i - 1] == kind[i + 1] == "AN":
            kind[i] = "AN"
    i = 0
    while i < len(kind):  # terminators beside numbers
        if kind[i] == "ET":
            j = i
            while j < len(kind) and kind[j] == "ET":
                j += 1
            if (i and kind[i - 1] == "EN") or (j < len(kind) and kind[j] == "EN"):
                kind[i:j] = ["EN"] * (j - i)
            i = j
        else:
            i += 1
    last = out
    for i, k in enumerate(kind):
        if k in ("L", "R"):
            last = k
        elif k == "EN" and last == "L":
            kind[i] = "L"
    i = 0
    side = lambda k: "R" if k in ("R", "EN", "AN") else "L"
    while i < len(kind):  # neutrals take the direction of both neighbours, else the paragraph's
        if kind[i] not in ("L", "R", "EN", "AN"):
            j = i
            while j < len(kind) and kind[j] not in ("L", "R", "EN", "AN"):
                j += 1
            a, b = side(kind[i - 1]) if i else out, side(kind[j]) if j < len(kind) else out
            kind[i:j] = [a if a == b else out] * (j - i)
            i = j
        else:
            i += 1
    return [base + ({"L": 1, "R": 0, "EN": 1, "AN": 1} if base else {"L": 0, "R": 1, "EN": 2, "AN": 2})[k] for k in kind]


def _reversed(text: str, level: list[int]) -> str:
    order = list(range(len(text)))
    for top in range(max(level, default=0), 0, -1):
        i = 0
        while i < len(order):
            if level[order[i]] >= top:
                j = i
                while j < len(order) and level[order[j]] >= top:
                    j += 1
                order[i:j] = order[i:j][::-1]
                i = j
            else:
                i += 1
    return "".join(text[k] for k in order)


def to_visual(text: str, direction: str = SOFT_LTR) -> str:
    """Logical to visual order: runs reversed from the highest level down; direction marks go."""
    own = "".join(c for c in text if c not in _MARKS)
    return _reversed(own, levels(own, direction))


def to_logical(text: str, direction: str = SOFT_LTR) -> str:
    """Visual to logical order; text without right-to-left characters stays."""
    own = "".join(c for c in text if c not in _MARKS)
    if not any(unicodedata.bidirectional(c) in ("R", "AL", "AN") for c in own) and direction in (SOFT_LTR, LTR):
        return own
    return _reversed(own, levels(own, direction))


def logical2visual(text: Column, direction: str = SOFT_LTR) -> Column:
    return _ordered(text, to_visual, direction)


def visual2logical(text: Column, direction: str = SOFT_LTR) -> Column:
    return _ordered(text, to_logical, direction)


def _ordered(text: Column, how, direction: str) -> Column:
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: x if x is None else how(x, direction))

    plain = text.rlike(r"^[\x{0}-\x{58F}]*$") if direction in (SOFT_LTR, LTR) else F.lit(False)
    return F.when(plain, text).otherwise(run(text))
