"""Language ID by cross-parsing entropy.

For each language a suffix automaton holds all substrings of a sample of its texts. A
text is cut into phrases, each the longest match in the automaton from where the last
one ended; a character that follows no match begins the next phrase. Few phrases mean
that the text is made of the language's own stretches. Each automaton has its own
alphabet, of all letters in its sample, and is packed: a state's transitions lie from
its base on, in slots that name their state, so that thousands of stretches of text
walk it in lockstep.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_batches, chunks, cut, doc_remainder, documents

#: Texts of a language that make its automaton, whole.
FIT_ROWS = 64
#: Bytes of automata that a pass over the texts holds; further languages have further passes.
PASS_BYTES = 128 << 20
#: Characters that are parsed as one stretch: a text's phrases are summed over its stretches.
STRETCH = 128
#: How steeply the score follows the difference of two languages' phrases.
SHARPNESS = 12.0


def suffix_automaton(symbols: np.ndarray) -> list[dict[int, int]]:
    """The automaton of all substrings: each state's next states; state 0 is the start."""
    following: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in symbols.tolist():
        new = len(following)
        following.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in following[p]:
            following[p][c] = new
            p = link[p]
        if p >= 0:
            q = following[p][c]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                clone = len(following)
                following.append(dict(following[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and following[p].get(c) == q:
                    following[p][c] = clone
                    p = link[p]
                link[q] = link[new] = clone
        last = new
    return following


def packed(following: list[dict[int, int]], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """base, owner, target: state x goes on by symbol c to target[base[x] + c] if owner[base[x] + c] is x. Symbols are below size, and `size` itself is none."""
    total = sum(map(len, following))
    taken = bytearray(total + size * 2 + 2)
    base = np.zeros(len(following), np.int32)
    many = sorted((i for i, row in enumerate(following) if len(row) > 1), key=lambda i: -len(following[i]))
    front = size  # slots before it are hardly free
    for i in many:
        row = sorted(following[i])
        first, at, tries = row[0], front, 0
        while True:
            at = taken.find(0, at)
            if at < 0 or at + size >= len(taken):
                taken.extend(bytes(len(taken) // 4 + 2 * size))
                at = front
                continue
            if not any(taken[at - first + c] for c in row):
                break
            at, tries = at + 1, tries + 1
            if tries % 16 == 0:
                front = max(front, at - 64)
        base[i] = at - first
        for c in row:
            taken[at - first + c] = 1
    single = np.array([i for i, row in enumerate(following) if len(row) == 1], np.int64)
    free = np.flatnonzero(np.frombuffer(bytes(taken), np.uint8) == 0)
    free = free[free >= size]
    if len(free) < len(single):
        free = np.concatenate([free, np.arange(len(taken), len(taken) + len(single) - len(free))])
    base[single] = free[: len(single)] - np.array([next(iter(following[i])) for i in single.tolist()], np.int64)
    state = np.repeat(np.arange(len(following)), [len(row) for row in following])
    slot = base[state] + np.array([c for row in following for c in row], np.int64)
    owner = np.full(max(int(slot.max(initial=0)), int(base.max())) + size + 2, -1, np.int32)
    target = np.zeros(len(owner), np.int32)
    owner[slot], target[slot] = state, [x for row in following for x in row.values()]
    return base, owner, target


_letters: list[np.ndarray] = []


def is_letter() -> np.ndarray:
    """For every code point whether it is a letter."""
    if not _letters:
        _letters.append(np.fromiter((unicodedata.category(chr(i))[0] == "L" for i in range(0x110000)), bool, 0x110000))
    return _letters[0]


def code_points(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    lowered = [(t or "").lower() for t in texts]
    at = np.concatenate([[0], np.cumsum([len(t) for t in lowered])]).astype(np.int64)
    return np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32), at


def alphabet(points: np.ndarray) -> np.ndarray:
    """The letters among code points, in order; letter i has the symbol i + 1, all that isn't a letter has 0."""
    own = np.unique(points)
    return own[is_letter()[own]]


def as_symbols(points: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Symbols of code points; len(own) + 1 is a letter that the sample lacks, which no state goes on by."""
    out = np.where(is_letter()[points], len(own) + 1, 0)
    if len(own):
        place = np.minimum(np.searchsorted(own, points), len(own) - 1)
        out = np.where(own[place] == points, place + 1, out)
    return out.astype(np.int32)


def phrases(symbols: np.ndarray, at: np.ndarray, table: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """How many phrases each text [at[i], at[i + 1]) needs in one language, in stretches of STRETCH symbols."""
    sizes = np.diff(at)
    pieces = -(-sizes // STRETCH)
    owner = np.repeat(np.arange(len(sizes)), pieces)
    begin = at[owner] + (np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * STRETCH
    width = np.minimum(STRETCH, at[owner + 1] - begin)
    order = np.argsort(-width, kind="stable")
    begin, width = begin[order], width[order]
    base, owns, target = table
    state, count = np.zeros(len(begin), np.int64), np.zeros(len(begin), np.int64)
    for step in range(int(width[0]) if len(width) else 0):
        n = int(np.searchsorted(-width, -step, side="left"))  # stretches that go on
        symbol = symbols[begin[:n] + step].astype(np.int64)
        slot = base[state[:n]] + symbol
        following = target[slot]
        ended = np.flatnonzero(owns[slot] != state[:n])
        if len(ended):
            count[ended] += state[ended] > 0
            slot = base[0] + symbol[ended]
            following[ended] = target[slot]
            lost = ended[owns[slot] != 0]  # a symbol that the language lacks is a phrase of its own
            count[lost] += 1
            following[lost] = 0
        state[:n] = following
    count += state > 0
    return np.bincount(owner[order], weights=count, minlength=len(sizes))


def _automaton(sample: pd.DataFrame) -> pd.DataFrame:
    """One language's row of a model."""
    points, _ = code_points([" ".join(sample.sort_values(["r"]).text)])
    own = alphabet(points)
    table = packed(suffix_automaton(as_symbols(points, own)), len(own) + 1)
    return pd.DataFrame([(sample.lang.iloc[0], sum(x.nbytes for x in table), *(x.tobytes() for x in (own.astype(np.uint32), *table)))], columns=["lang", "size", "letters", "base", "owner", "target"])


def fit(docs: DataFrame) -> DataFrame:
    """(lang, size, letters, base, owner, target): each language's automaton, of its FIT_ROWS texts with the lowest hashes of their ids.

    docs(doc_id, text, lang). Every lang value is learned, each in a task of its own.
    """
    arrow_batches(docs.sparkSession)
    rows = docs.where("lang is not null and text is not null and doc_id is not null").select("doc_id", F.col("lang").cast("string").alias("lang"), "text")
    by = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    few = rows.withColumn("r", F.row_number().over(by)).where(f"r <= {FIT_ROWS}")
    return cut(few.groupBy("lang").applyInPandas(_automaton, "lang string, size long, letters binary, base binary, owner binary, target binary"), "automata")


def with_language(docs: DataFrame, model: DataFrame, prefix: str = "") -> DataFrame:
    """docs with lang_pred and score (0 to 1: how clearly the language beats the next one).

    Null texts, and texts without a letter, are `und` with score 0, as is everything if no
    language was learned. With a single language its score is 1. Equal phrase counts go to the
    first language by name. Columns of docs that clash with the new ones are replaced.
    """
    spark = docs.sparkSession
    arrow_batches(spark)
    passes: list[list[str]] = [[]]
    held = 0
    for r in model.select("lang", "size").orderBy("lang").collect():  # one number a language
        if passes[-1] and held + r["size"] > PASS_BYTES:
            passes.append([])
            held = 0
        passes[-1].append(r["lang"])
        held += r["size"]
    new = {prefix + "lang_pred": "string", prefix + "score": "double"}
    out = docs.drop(*[c for c in docs.columns if c.lower() in new])
    so_far = {"_fathom_best": "string", "_fathom_first": "double", "_fathom_second": "double"}
    for i, names in enumerate(passes):
        if i:
            out = cut(out, "languages")
        out = _pass(out, model, names, so_far if i else {}, new if i == len(passes) - 1 else so_far)
    return out


def _pass(docs: DataFrame, model: DataFrame, langs: list[str], before: dict, after: dict) -> DataFrame:
    """docs parsed in some languages: the columns `before` (best language, its phrases, the next one's) become `after`, which is those or the result."""
    rows = model.where(F.col("lang").isin(langs)).orderBy("lang").collect() if langs else []  # PASS_BYTES, or one language
    shared = docs.sparkSession.sparkContext.broadcast([(r["lang"], bytes(r["letters"]), *(bytes(r[c]) for c in ("base", "owner", "target"))) for r in rows])
    kept = [(c, t) for c, t in docs.dtypes if c not in before]
    final = "_fathom_best" not in after

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [(lang, np.frombuffer(own, np.uint32), tuple(np.frombuffer(x, np.int32) for x in table)) for lang, own, *table in shared.value]
        letters = is_letter()
        for batch in chunks(batches):
            points, at = code_points(pc.fill_null(batch.column("text").cast(pa.large_string()), "").to_pylist())
            total = np.concatenate([[0], np.cumsum(letters[points])])
            has_letter = total[at[1:]] > total[at[:-1]]
            if before:
                best, first, second = (batch.column(c).to_numpy(zero_copy_only=False).copy() for c in before)
            else:
                best, first, second = np.full(batch.num_rows, None, object), np.full(batch.num_rows, np.inf), np.full(batch.num_rows, np.inf)
            distinct = np.flatnonzero(np.bincount(points)) if len(points) else np.zeros(0, np.int64)
            place = np.zeros(int(distinct[-1]) + 1 if len(distinct) else 1, np.int32)
            place[distinct] = np.arange(len(distinct))
            at_distinct = place[points]
            for lang, own, table in tables:
                count = phrases(as_symbols(distinct, own)[at_distinct], at, table)
                wins = count < first
                second = np.where(wins, first, np.minimum(second, count))
                best[wins], first = lang, np.minimum(first, count)
            if final:
                second = np.where(np.isinf(second), first * 2, second)
                known = has_letter & np.isfinite(first)
                first, second = np.where(known, first, 0), np.where(known, second, 0)
                score = np.where(known, 1 - np.exp(-SHARPNESS * (second - first) / np.maximum(1, second)) / 2, 0.0)
                arrays = [pa.array(np.where(known, best, "und").astype(object), pa.string()), pa.array(score)]
            else:
                arrays = [pa.array(best, pa.string()), pa.array(first), pa.array(second)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c, _ in kept), *arrays], [*(c for c, _ in kept), *after])

    return docs.mapInArrow(run, ", ".join([*(f"`{c}` {t}" for c, t in kept), *(f"{c} {t}" for c, t in after.items())]))


def op3_language_id(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    model = fit(docs.where(doc_remainder(4) != 2))
    named = with_language(docs.select("doc_id", "text"), model)
    return named.select("doc_id", F.coalesce(doc_remainder(4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")
