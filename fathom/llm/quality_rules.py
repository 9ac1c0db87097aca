"""Quality rules: how far a text's histograms lie from those of its language.

References are counted over all documents: for each language the shares of character
classes, and the shares of its most common words. A text's own histograms are held
against each language's by Jensen-Shannon distance (base 2, so 0 to 1), and its
nearest language judges it. Guards spare short texts, whose histograms are noise.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Words, arrow_batches, chunks, cut, documents, mix, range_hash, text_bytes

#: Common words of a language's histogram, and counted words that a task holds before it passes them on.
COMMON, HELD = 64, 1 << 20
#: Languages that a text is held against at a time; every language has a reference.
LANGUAGES = 64
#: A text is rejected beyond these distances from its nearest language.
MOST_CLASSES, MOST_WORDS = 0.28, 0.50
#: Words that a text needs before its classes, and its common words, are judged.
LEAST_CLASSES, LEAST_WORDS = 40, 60

CLASSES = 8
_CLASS = np.full(256, 7, np.int64)  # control characters and other signs
_CLASS[0x61:0x7B] = 0
_CLASS[0x41:0x5B] = 1
_CLASS[0x30:0x3A] = 2
_CLASS[[0x20, *range(0x09, 0x0E)]] = 3
_CLASS[[ord(c) for c in ".,;:?'\"()-"]] = 4
_CLASS[[ord(c) for c in "#*$%&|<>!=+~^_\\/@[]{}`"]] = 5
_CLASS[0x80:] = 6
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_STARTS_CHARACTER = (np.arange(256) & 0xC0) != 0x80


def _sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of values over [at[i], at[i + 1])."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[at[1:]] - total[at[:-1]]


def class_counts(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Characters of each class in each text."""
    text = np.repeat(np.arange(len(at) - 1), np.diff(at))
    first = _STARTS_CHARACTER[data]
    return np.bincount(text[first] * CLASSES + _CLASS[data[first]], minlength=(len(at) - 1) * CLASSES).reshape(-1, CLASSES)


def _survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts of a task: every word of every language, however rare. What is held is passed on beyond HELD words."""
    classes: dict[str, np.ndarray] = {}
    found: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
    texts: dict[str, int] = {}
    words_of: dict[str, int] = {}
    held = 0

    def rows(lang: str, kind: str, keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        first = pa.array(np.zeros(len(keys), np.int64))
        return pa.RecordBatch.from_arrays([pa.array([lang], pa.string()).take(first), pa.array([kind], pa.string()).take(first), pa.array(keys.astype(np.int64)), pa.array(counts.astype(np.int64))], ["lang", "kind", "key", "count"])

    def passed_on() -> Iterator[pa.RecordBatch]:
        for lang in list(found):
            own, counts = (np.concatenate(x) for x in zip(*found.pop(lang)))
            own, back = np.unique(own, return_inverse=True)
            counts = np.bincount(back, weights=counts, minlength=len(own))
            for s in range(0, len(own), 100_000):
                yield rows(lang, "word", own[s : s + 100_000].view(np.int64), counts[s : s + 100_000])

    for batch in chunks(batches):
        data, at = text_bytes(batch.column("text"))
        words, counts = Words(data, at, lower=True), class_counts(data, at)
        langs = np.array(["" if x is None else x for x in batch.column("lang").to_pylist()])
        names, of = np.unique(langs, return_inverse=True)
        per_word = np.repeat(of, np.diff(words.first))
        order = np.argsort(per_word, kind="stable")
        cuts = np.searchsorted(per_word[order], np.arange(len(names) + 1))
        for i, lang in enumerate(names.tolist()):
            classes[lang] = classes.get(lang, 0) + counts[of == i].sum(0)
            texts[lang] = texts.get(lang, 0) + int((of == i).sum())
            own, n = np.unique(words.hash[order[cuts[i] : cuts[i + 1]]], return_counts=True)
            words_of[lang] = words_of.get(lang, 0) + int(n.sum())
            found.setdefault(lang, []).append((own, n))
            held += len(own)
        if held > HELD:
            yield from passed_on()
            held = 0
    yield from passed_on()
    for lang in classes:
        yield rows(lang, "class", np.arange(CLASSES), classes[lang])
        yield rows(lang, "all", np.arange(2), np.array([texts[lang], words_of[lang]]))


def references(docs: DataFrame) -> dict:
    """The languages' histograms, over all documents: class shares, and hashes and shares of their common words."""
    arrow_batches(docs.sparkSession)
    found = docs.select("text", F.col("lang").cast("string").alias("lang")).mapInArrow(_survey, "lang string, kind string, key long, count long")
    counted = cut(found.groupBy("lang", "kind", "key").agg(F.sum("count").alias("count")), "histograms")
    most = [r["lang"] for r in counted.where("kind = 'all' and key = 0").orderBy(F.desc("count"), "lang").collect()]
    by = Window.partitionBy("lang").orderBy(F.desc("count"), "key")
    top = counted.where("kind = 'word'").withColumn("r", F.row_number().over(by)).where(f"r <= {COMMON}").drop("r")
    rows = counted.where("kind <> 'word'").unionByName(top).collect()  # COMMON + 10 rows a language
    of: dict[str, list] = {}
    for r in rows:
        of.setdefault(r["lang"], []).append(r)
    out = {"words": [], "shares": [], "classes": []}
    for lang in most:
        own = of[lang]
        total = sum(r["count"] for r in own if r["kind"] == "all" and r["key"] == 1)
        words = sorted((r["key"], r["count"]) for r in own if r["kind"] == "word")
        classes = np.zeros(CLASSES)
        for r in own:
            if r["kind"] == "class":
                classes[r["key"]] = r["count"]
        if total and classes.sum():
            shares = np.array([c for _, c in words]) / total
            out["words"].append(np.array([w for w, _ in words], np.int64).view(np.uint64))
            out["shares"].append(np.append(shares, max(0.0, 1 - shares.sum())))
            out["classes"].append(classes / classes.sum())
    return out


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance (base 2) of each row of p from q."""
    m = (p + q) / 2

    def part(x):
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(x > 0, x * np.log2(x / m), 0.0).sum(-1)

    return np.sqrt(np.clip((part(p) + part(np.broadcast_to(q, p.shape))) / 2, 0, 1))


def distances(words: Words, lowered: Words, data: np.ndarray, at: np.ndarray, known: dict) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distances (classes, common words) from the language that is nearest by their sum; 0 without references or words."""
    n = len(at) - 1
    counts = np.diff(lowered.first)
    own_classes = class_counts(data, at)
    shares = own_classes / np.maximum(1, own_classes.sum(1, keepdims=True))
    best = np.full(n, np.inf)
    by_class, by_word = np.zeros(n), np.zeros(n)
    text = np.repeat(np.arange(n), counts)
    for s in range(0, len(known["words"]), LANGUAGES):
        # one ordered list of these languages' common words: each word of the texts is looked up once in it
        part = {k: v[s : s + LANGUAGES] for k, v in known.items()}
        every = np.unique(np.concatenate(part["words"]))
        if not len(every):
            continue
        place = np.minimum(np.searchsorted(every, lowered.hash), len(every) - 1)
        hit = every[place] == lowered.hash
        table = np.bincount(text[hit] * len(every) + place[hit], minlength=n * len(every)).reshape(n, len(every))
        for common, share, classes in zip(part["words"], part["shares"], part["classes"]):
            own = table[:, np.searchsorted(every, common)]
            own = np.column_stack([own, counts - own.sum(1)]) / np.maximum(1, counts)[:, None]
            c, w = js_distance(shares, classes), js_distance(own, share)
            nearer = (c + w < best) & (counts > 0)
            best[nearer], by_class[nearer], by_word[nearer] = (c + w)[nearer], c[nearer], w[nearer]
    return by_class, by_word


def _repeated_words(words: Words, width: int = 8) -> np.ndarray:
    """Words of each text in windows of `width` words that the text holds twice or more."""
    hashes, where = words.shingles(width)
    n = len(words.first) - 1
    text = np.repeat(np.arange(n), np.diff(where))
    key = mix(hashes + mix(text.astype(np.uint64)))
    order = np.argsort(key, kind="stable")
    ordered = key[order]
    same = np.zeros(len(key) + 1, bool)
    same[1:-1] = ordered[1:] == ordered[:-1]
    twice = order[same[1:] | same[:-1]]
    begin = twice - where[text[twice]] + words.first[text[twice]]
    covered = np.bincount(begin, minlength=len(words.hash) + 1) - np.bincount(begin + width, minlength=len(words.hash) + 1)[: len(words.hash) + 1]
    return _sums(np.cumsum(covered)[: len(words.hash)] > 0, words.first)


def _repeated_lines(words: Words) -> np.ndarray:
    """Lines of each text that hold a word and equal an earlier line."""
    data, at = words.data, words.at
    breaks = np.flatnonzero(data == 0x0A)
    n = len(at) - 1
    # a text's lines start at its first byte and after each break in it
    start = np.concatenate([at[:-1], breaks + 1])
    owner = np.concatenate([np.arange(n), np.searchsorted(at, breaks, side="right") - 1])
    order = np.lexsort((start, owner))
    start, owner = start[order], owner[order]
    stop = np.append(start[1:] - 1, at[-1])
    last = np.append(owner[1:] != owner[:-1], True)
    stop[last] = at[owner[last] + 1]
    inside = np.concatenate([[0], np.cumsum(words.inside)])
    full = inside[stop] > inside[start]
    start, stop, owner = start[full], stop[full], owner[full]
    key = mix(range_hash(words.running, start, stop) + mix(owner.astype(np.uint64)))
    _, first = np.unique(key, return_index=True)
    return np.bincount(owner, minlength=n) - np.bincount(owner[first], minlength=n)


FIELDS = {"n_words": "long", "word_chars": "long", "n_symbols": "long", "n_dup_lines": "long", "n_repeat_words": "long", "base_failed": "boolean", "kept": "boolean", "class_distance": "double", "word_distance": "double"}


def measure(column: pa.Array, known: dict) -> dict[str, np.ndarray]:
    data, at = text_bytes(column)
    words, lowered = Words(data, at), Words(data, at, lower=True)
    n_words = np.diff(words.first)
    repeated = _repeated_words(words)
    by_class, by_word = distances(words, lowered, data, at, known)
    failed = (n_words < 20) | (100 * repeated > 30 * n_words)
    odd = ((n_words >= LEAST_CLASSES) & (by_class > MOST_CLASSES)) | ((n_words >= LEAST_WORDS) & (by_word > MOST_WORDS))
    return {
        "n_words": n_words, "word_chars": _sums(words.inside & _STARTS_CHARACTER[data], at), "n_symbols": _sums(_SYMBOL[data], at), "n_dup_lines": _repeated_lines(words),
        "n_repeat_words": repeated, "base_failed": failed, "kept": ~failed & ~odd, "class_distance": by_class, "word_distance": by_word,
    }


def with_quality_rules(docs: DataFrame, known: dict | None = None, prefix: str = "") -> DataFrame:
    """docs with the fields of FIELDS (each name after `prefix`; a clashing column of docs is replaced).

    Words are `[^\\x20\\x09-\\x0D]+`; null texts have none. n_words, word_chars (code points in
    words), n_symbols (`#*$%&|<>`), n_dup_lines (lines with a word that equal an earlier one),
    n_repeat_words (words in 8-word windows that the text holds twice or more), base_failed
    (under 20 words, or over 30 % repeated), class_distance and word_distance (from the nearest
    language's histograms), kept: not base_failed and within MOST_CLASSES and MOST_WORDS, each
    judged from LEAST_CLASSES and LEAST_WORDS words on. References come from docs unless given;
    rows with a null lang form a reference of their own. Without any reference nothing is odd.
    """
    arrow_batches(docs.sparkSession)
    known = references(docs) if known is None else known
    shared = docs.sparkSession.sparkContext.broadcast(known)  # COMMON + 8 numbers a language
    names = [prefix + f for f in FIELDS]
    held = docs.drop(*[c for c in docs.columns if c.lower() in [n.lower() for n in names]])
    schema = ", ".join([*(f"`{c}` {t}" for c, t in held.dtypes), *(f"{n} {t}" for n, t in zip(names, FIELDS.values()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            out = measure(batch.column("text"), shared.value)
            arrays = [pa.array(out[f], {"long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}[t]) for f, t in FIELDS.items()]
            yield pa.RecordBatch.from_arrays([*batch.columns, *arrays], [*batch.schema.names, *names])

    return held.mapInArrow(run, schema)


def op8_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return with_quality_rules(docs.select("doc_id", "text"), references(docs)).drop("text")
