"""Ranking by BM25, and its fusion with vector scores."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.filters import compile_filter
from ..functions.text import tokens
from . import knn


def term_counts(docs: DataFrame, text: str = "text", id_column: str = "doc_id", analyzer: Callable[[Column], Column] = tokens) -> DataFrame:
    """(term, df, cf): documents that hold a term, and its occurrences. Counted in a document before the shuffle."""
    words = docs.select(F.col(id_column).alias("row"), F.explode(analyzer(F.col(text))).alias("term"))
    return words.groupBy("row", "term").agg(F.count("*").alias("tf")).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


_LETTERS = r"a-zA-Z0-9\p{IsAlphabetic}\p{N}"
_WORD = f"[{_LETTERS}]"


def _as_term(term: str) -> str:
    """A pattern for a term as a whole word of the plain tokenizer: A-Z match in either case. A term that it can't give matches nothing."""
    own = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in term)
    return f"(?i)\\Q{term}\\E(?!{_WORD})(?<!{_WORD}\\Q{term}\\E)" if own == term and term else "(?!)"


def _length(text: Column) -> Column:
    """How many words the plain tokenizer finds: each, with what is beside it, is made one character."""
    return F.when(text.rlike(_WORD), F.length(F.regexp_replace(text, f"(?:^[^{_LETTERS}]++)?{_WORD}++[^{_LETTERS}]*+", "x"))).otherwise(0)


def _counts(docs: DataFrame, terms: list[str], text: Column, analyzer: Callable[[Column], Column], length: bool) -> list[Column]:
    """tf0, tf1, ... of the terms, with `length` dl before them. The plain tokenizer's words are counted where they stand, without making them."""
    if analyzer is tokens:
        text = F.coalesce(text, F.lit(""))
        return [*([_length(text).alias("dl")] if length else []), *(F.regexp_count(text, F.lit(_as_term(t))).alias(f"tf{i}") for i, t in enumerate(terms))]
    words = analyzer(text)

    def count(term: str) -> Column:
        return F.size(F.filter(words, lambda w: w == F.lit(term)))

    return [*([F.size(words).alias("dl")] if length else []), *(count(t).alias(f"tf{i}") for i, t in enumerate(terms))]


def bm25(docs: DataFrame, query: Sequence[str], k1: float = 1.2, b: float = 0.75, where: dict | None = None, text: str | Sequence[str] = "text", id_column: str = "doc_id", analyzer: Callable[[Column], Column] = tokens) -> DataFrame:
    """(id, score) of all documents that hold a query term; a term given twice counts twice.

    `text` may name several columns, whose texts are joined by spaces, nulls left out.
    Statistics come from all documents whatever the filter, in one pass; they are one row of
    sums, so ranking shuffles nothing. Only documents that hold a term are measured again.
    """
    terms = Counter(query)
    whole = F.col(text) if isinstance(text, str) else F.concat_ws(" ", *text)
    if not terms:
        return docs.where(F.lit(False)).select(F.col(id_column).alias("id"), F.lit(0.0).alias("score"))
    names = list(terms)
    hit = reduce(lambda x, y: x | y, [F.col(f"tf{i}") > 0 for i in range(len(names))])
    stats = docs.select(*_counts(docs, names, whole, analyzer, True)).agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"), *(F.sum((F.col(f"tf{i}") > 0).cast("long")).alias(f"df{i}") for i in range(len(terms)))).first()
    average = stats["avgdl"] or 1.0
    rows = docs.where(compile_filter(where, docs)) if where else docs
    if analyzer is tokens:
        any_term = "|".join(_as_term(t) for t in names)
        rows = rows.where(F.coalesce(whole, F.lit("")).rlike(any_term))
    rows = rows.select(F.col(id_column).alias("id"), *_counts(docs, names, whole, analyzer, True)).where(hit)
    total = F.lit(0.0)
    for i, times in enumerate(terms.values()):
        df = F.lit(stats[f"df{i}"] or 0)
        idf = F.log((F.lit(stats["n"]) - df + 0.5) / (df + 0.5) + 1.0)
        f = F.col(f"tf{i}").cast("double")
        total = total + F.when(f > 0, idf * f * (k1 + 1) / (f + k1 * (1 - b + b * F.col("dl") / F.lit(average))) * times).otherwise(0.0)
    return rows.select("id", F.round(total, 6).alias("score"))


def bm25_search(docs: DataFrame, query: Sequence[str], k: int, **options) -> DataFrame:
    if k <= 0:
        raise ValueError("k must be positive")
    return knn.top(bm25(docs, query, **options), k)


def _normalised(side: DataFrame, name: str) -> DataFrame:
    """A side's few results, scores scaled to 0 to 1; all 1 where they agree."""
    every = Window.partitionBy(F.lit(0))  # 2k rows
    low, high = F.min("score").over(every), F.max("score").over(every)
    scaled = F.when(F.abs(high - low) < 1.1920929e-07, 1.0).otherwise((F.col("score") - low) / (high - low))
    return side.select("id", F.col("score").alias(name), scaled.alias(f"{name}_scaled"))


def hybrid(table: DataFrame, query: Sequence[str], vector: Sequence[float], k: int, text_weight: float = 0.5, vector_weight: float = 0.5, where: dict | None = None, fusion: str = "weighted", metric: str = "cosine", **text_options) -> DataFrame:
    """(id, bm25_score, vector_score, score): each side's best 2k, scaled and summed by weight; a missing side adds 0.

    text_options go to bm25 (analyzer, text, k1, b). fusion="rrf" sums 1 / (60 + rank) instead.
    """
    text_side = bm25_search(table, query, 2 * k, where=where, **text_options)
    vector_side = knn.search(table, vector, 2 * k, metric, where, id_column="doc_id")
    if fusion == "rrf":
        rank = F.row_number().over(Window.orderBy(F.desc("score"), "id"))  # 2k rows
        left = text_side.select("id", F.col("score").alias("bm25_score"), (1.0 / (60 + rank)).alias("bm25_score_scaled"))
        right = vector_side.select("id", F.col("score").alias("vector_score"), (1.0 / (60 + rank)).alias("vector_score_scaled"))
        text_weight = vector_weight = 1.0
    else:
        left, right = _normalised(text_side, "bm25_score"), _normalised(vector_side, "vector_score")
    zero = F.lit(0.0)
    total = text_weight * F.coalesce("bm25_score_scaled", zero) + vector_weight * F.coalesce("vector_score_scaled", zero)
    both = left.join(right, "id", "full_outer").select("id", "bm25_score", "vector_score", F.round(total, 6).alias("score"))
    return knn.top(both, k)


def explain_hybrid(table: DataFrame, key: int, *args, **options) -> DataFrame:
    """The row of one document in a hybrid result; none where it isn't in it."""
    return hybrid(table, *args, **options).where(F.col("id") == key)
