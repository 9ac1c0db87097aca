"""Arabic analysis as Spark columns: normalised letters, words, light stems and roots.

Words are handled as arrays: each step is one `transform` over all words of a text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Arabic stop words.
STOP_WORDS = (
    "من في على إلى عن مع بين حتى منذ و أو ثم لكن بل أم إما لو لولا هو هي هم هن أنا نحن أنت أنتم أنتن هذا هذه ذلك تلك هؤلاء أولئك "
    "الذي التي الذين اللواتي اللاتي ما ماذا أين متى كيف لماذا كم أي كان يكون كانت كانوا ليس ليست قد لقد سوف لن لم لا إن أن إذا إذ "
    "ال ب ل ك ف كل بعض غير عند ذات هناك هنا فقط أيضا جدا معظم كثير قليل بعد قبل خلال أثناء ضد نحو حول فوق تحت أمام خلف بجانب"
).split()
# Roots that a stricter extraction may be held to.
KNOWN_ROOTS = "كتب قرأ علم فهم درس عمل أكل شرب ذهب جلس نظر سمع فتح غلق خرج دخل بيت كلب قلم طلب حمل حمد".split()
# Letters that stand for one another, and marks that are dropped.
_SAME = {"آ": "ا", "أ": "ا", "إ": "ا", "ٱ": "ا", "ى": "ي", "ة": "ه", "ؤ": "و", "ئ": "ي"}
_MARKS = "".join(map(chr, range(0x064B, 0x0656))) + "ٰٟـ"

#: Characters of the Arabic blocks, for use in a pattern's brackets.
LETTERS = "؀-ۿݐ-ݿࢠ-ࣿﭐ-﷿ﹰ-﻿"
# Letters that belong to a word's pattern and not to its root.
_WEAK = "اويءأإآى"


def normalise(text: Column) -> Column:
    """Alef, yeh, teh marbuta and hamza forms as their plain letters, without vowel marks and stretching. Null stays null."""
    return F.translate(text, "".join(_SAME) + _MARKS, "".join(_SAME.values()))


def plain(word: str) -> str:
    """normalise for one word."""
    return word.translate(str.maketrans({**_SAME, **dict.fromkeys(_MARKS, "")}))


def words(text: Column, shortest: int = 2, longest: int = 50) -> Column:
    """Runs of Arabic characters, A-Z, a-z and digits of the normalised text. A null text has none."""
    found = F.regexp_extract_all(normalise(F.coalesce(text, F.lit(""))), F.lit(f"[{LETTERS}a-zA-Z0-9]+"), F.lit(0))
    return F.filter(found, lambda w: F.length(w).between(shortest, longest))


def _without(w: Column, front: int = 0, end: int = 0) -> Column:
    return F.substring(w, F.lit(front + 1), F.length(w) - (front + end))


def _first(rules: Iterable[tuple[Column, Column]], other: Column) -> Column:
    """The value of the first rule that holds."""
    out: Column | None = None
    for condition, value in rules:
        out = F.when(condition, value) if out is None else out.when(condition, value)
    return other if out is None else out.otherwise(other)


def _begins(w: Column, prefix: str, least: int) -> tuple[Column, Column]:
    return w.startswith(prefix) & (F.length(w) >= least), _without(w, front=len(prefix))


def _ends(w: Column, suffix: str, least: int) -> tuple[Column, Column]:
    return w.endswith(suffix) & (F.length(w) >= least), _without(w, end=len(suffix))


def stems(found: Column) -> Column:
    """Light stems of an array of words: an article or conjunction and an ending cut off; a word of which less than two letters were left stays."""
    front = F.transform(found, lambda w: _first((_begins(w, p, n) for p, n in (("ال", 3), ("وال", 4), ("و", 3), ("بال", 4), ("كال", 4), ("لل", 4), ("لال", 4))), w))
    back = F.transform(front, lambda w: _first((_ends(w, s, n) for s, n in (("ات", 4), ("ون", 4), ("ين", 4), ("ان", 4), ("ه", 3), ("ي", 3), ("ها", 4))), w))
    return F.zip_with(back, found, lambda s, w: F.when(F.length(s) < 2, w).otherwise(s))


def _long(step: Callable[[Column], Column]) -> Callable[[Column], Column]:
    """step for words of three letters and more; shorter ones have no root."""
    return lambda w: F.when(F.length(w) < 3, "").otherwise(step(w))


def roots(found: Column, known: Iterable[str] | None = None) -> Column:
    """Roots of an array of words, "" where there is none. Of roots outside `known`, if given, only three letters are taken."""
    front = [("است", 6), ("ال", 4), *((c, 4) for c in "تينأم"), *((c, 6) for c in "وبكفلس")]
    back = [*((s, 4) for s in ("ات", "ون", "ين", "ان")), *((c, 4) for c in "ةيها")]
    cut = F.transform(found, _long(lambda w: _first((_begins(w, p, n) for p, n in front), w)))
    cut = F.transform(cut, _long(lambda w: _first((_ends(w, s, n) for s, n in back), w)))
    letters = F.transform(cut, _long(lambda w: F.substring(F.regexp_replace(w, f"[^ء-ي]|[{_WEAK}]", ""), 1, 4)))
    return letters if known is None else F.transform(letters, lambda r: F.when(r.isin(list(known)), r).otherwise(F.substring(r, 1, 3)))


def arabic(text: Column, stop_words: Iterable[str] = STOP_WORDS, stemming: bool = True, shortest: int = 2, longest: int = 50, as_listed: bool = False) -> Column:
    """Arabic analysis: normalised words without stop words, each as its root, or its light stem where it has none.

    Stop words are normalised like the text; with `as_listed` they are not, so that those
    with a letter that normalising changes never match.
    """
    stop = sorted(set(stop_words) if as_listed else {plain(w) for w in stop_words})
    found = words(text, shortest, longest)
    if stop:
        found = F.filter(found, lambda w: ~w.isin(stop))
    if not stemming:
        return found
    terms = F.zip_with(roots(found), stems(found), lambda r, s: F.when(r != "", r).otherwise(s))
    return F.filter(terms, lambda t: F.length(t) >= shortest)
