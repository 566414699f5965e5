"""Character classes and dictionary checks for a language model."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumflow.functions import text as T


def category(ch: Column) -> Column:
    """L, M, N, P, S, Z or C of a character."""
    out = F.lit("C")
    for c in "LMNPSZ":
        out = F.when(ch.rlike(rf"^\p{{{c}}}"), c).otherwise(out)
    return out


def char_classes(chars: DataFrame) -> DataFrame:
    """category, characters: the sorted characters of each category; C stands for errors."""
    return chars.where("ch is not null").select(category(F.col("ch")).alias("category"), "ch").groupBy("category").agg(F.array_sort(F.collect_set("ch")).alias("characters"))


def checked_dictionary(words: DataFrame, known: list[str]) -> tuple[DataFrame, DataFrame]:
    """(term, cnt) fit for a language model, and errors (term, kind).

    Characters that the character map lacks are replaced by their NFKC, NFD or NFKD form where that is known and of the same category; a
    term that still has others is an error ``charmap``. A term must be one token (else ``tokenizer``) of letters (else ``category``).
    """
    have = frozenset(known)

    def fix(term: str) -> str | None:
        out = []
        for c in term:
            if c not in have:
                for form in ("NFKC", "NFD", "NFKD"):
                    new = unicodedata.normalize(form, c)
                    if all(x in have for x in new) and unicodedata.category(new[0])[0] == unicodedata.category(c)[0]:
                        c = new
                        break
                else:
                    return None
            out.append(c)
        return "".join(out)

    @F.pandas_udf("string")
    def fixed(s: pd.Series) -> pd.Series:
        return s.map(lambda t: t if t is None else fix(t))

    # else filters on its result would be moved below the count of the words, to each of their occurrences
    fixed = fixed.asNondeterministic()
    plain = F.forall(T.chars(F.col("term")), lambda c: c.isin(list(have)))
    told = words.withColumn("_new", F.when(plain, F.col("term")).otherwise(fixed("term")))
    tokens = T.categorised(F.col("_new"))
    kind = F.when(F.col("_new").isNull(), "charmap").when(F.size(tokens) != 1, "tokenizer").when(tokens[0].category != "L", "category")
    told = told.withColumn("kind", kind)
    return told.where("kind is null").select(F.col("_new").alias("term"), "cnt"), told.where("kind is not null").select("term", "kind")
