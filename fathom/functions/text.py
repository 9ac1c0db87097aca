"""Tokens of texts as Spark columns: the plain tokenizer, the English analyzer, and language detection."""

from __future__ import annotations

import string
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# English stop words.
STOP_WORDS = (
    "a an and are as at be by for from has he in is it its of on that the to was were will with this but they have had what when "
    "where who which why how all each every both few more most other some such no nor not only own same so than too very can just "
    "should now or if then else do does did doing would could might must shall may here there am been being"
).split()


def tokens(text: Column) -> Column:
    """Words of letters and digits, A-Z in lower case. A null text has none."""
    lowered = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.filter(F.split(lowered, r"[^\p{IsAlphabetic}\p{N}]+"), lambda t: t != "")


def english_stem(t: Column) -> Column:
    """The suffix rules for words of over four bytes; the first that matches is used."""

    def cut(n: int) -> Column:
        return F.substring(t, F.lit(1), F.length(t) - n)

    without_ing = F.when(cut(3).endswith("e"), cut(4)).otherwise(cut(3))
    return (
        F.when(F.octet_length(t) <= 4, t)
        .when(t.endswith("ing"), without_ing)
        .when(t.endswith("ed"), cut(2))
        .when(t.endswith("ly"), cut(2))
        .when(t.endswith("ies"), F.concat(cut(3), F.lit("y")))
        .when(t.endswith("es"), cut(2))
        .when(t.endswith("s") & ~t.endswith("ss"), cut(1))
        .when(t.endswith("ness"), cut(4))
        .when(t.endswith("ment"), cut(4))
        .when(t.endswith("tion"), F.concat(cut(3), F.lit("t")))
        .otherwise(t)
    )


def english(text: Column, stop_words: Iterable[str] = STOP_WORDS, stemming: bool = True, shortest: int = 2, longest: int = 50) -> Column:
    """English analysis: words of 2 to 50 bytes in lower case, without stop words, stemmed."""
    stop = sorted({w.lower() for w in stop_words})
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{IsAlphabetic}\p{N}]+"), lambda t: F.octet_length(t).between(max(1, shortest), longest) & ~(t.isin(stop) if stop else F.lit(False)))
    return F.filter(F.transform(words, english_stem), lambda t: t != "") if stemming else words


def detect_language(text: Column) -> Column:
    """`arabic` or `english` where over half of a text's letters are Arabic or ASCII ones; else `universal`."""
    text = F.coalesce(text, F.lit(""))

    def many(other: str) -> Column:
        return F.length(F.regexp_replace(text, other, ""))

    letters = many(r"[^\p{IsAlphabetic}]")
    arabic = many(r"[^؀-ۿݐ-ݿࢠ-ࣿﭐ-﷿ﹰ-﻿]")
    return F.when(arabic * 2 > letters, "arabic").when(many("[^a-zA-Z]") * 2 > letters, "english").otherwise("universal")
