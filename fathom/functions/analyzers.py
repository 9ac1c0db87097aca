"""Analyzers by language, for `analyzer=` of the text searches: English, Arabic, mixed texts, and plain words.

Stop words are plain sets: `frozenset(text.STOP_WORDS) | {...}` adds, `-` removes.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import arabic as ar
from . import text as en

# Names of the languages.
NAMES = {"ar": "arabic", "arabic": "arabic", "en": "english", "english": "english", "auto": "auto"}
CODES = {"arabic": "ar", "english": "en", "auto": "auto", "universal": "universal"}


def language(name: str) -> str:
    """The language that a name or code in any case stands for; `universal` for unknown ones."""
    return NAMES.get(name.lower(), "universal")


@dataclass(frozen=True)
class Analyzer:
    """Terms of a text, by language: english, arabic, auto (by the text's letters), or universal (plain words).

    stop_words None means the language's own; lengths are bytes in English, characters in Arabic.
    """

    language: str = "english"
    stemming: bool = True
    stop_words: frozenset[str] | None = None
    shortest: int = 1
    longest: int = 100

    def __call__(self, text: Column) -> Column:
        if self.language == "universal":
            return en.tokens(text)
        if self.language == "auto":
            return mixed(text, self)
        return self._of(self.language, text)

    def _of(self, name: str, text: Column) -> Column:
        module, analyze = (en, en.english) if name == "english" else (ar, ar.arabic)
        stop = module.STOP_WORDS if self.stop_words is None else self.stop_words
        return analyze(text, stop_words=stop, stemming=self.stemming, shortest=self.shortest, longest=self.longest)


def preset(name: str) -> Analyzer:
    """The usual analyzer of a language: terms of 2 to 50."""
    return Analyzer(language(name), shortest=2, longest=50)


def blocks(text: Column) -> Column:
    """Stretches of one script: from an Arabic character to the next of A-Z, a-z, or the other way round. What stands before the first is left out."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"[{ar.LETTERS}][^a-zA-Z]*|[a-zA-Z][^{ar.LETTERS}]*"), F.lit(0))


def mixed(text: Column, analyzer: Analyzer | None = None) -> Column:
    """A text of mostly Arabic or mostly A-Z letters by that language's analysis, others stretch by stretch, each by its script's."""
    own = analyzer or preset("auto")
    by_script = F.transform(blocks(text), lambda b: F.when(b.rlike("^[a-zA-Z]"), own._of("english", b)).otherwise(own._of("arabic", b)))
    kind = en.detect_language(text)
    return F.when(kind == "arabic", own._of("arabic", text)).when(kind == "english", own._of("english", text)).otherwise(F.flatten(by_script))
