"""Nothing is cut off: rare words, many languages, long texts."""

import numpy as np
import pytest

from fathom.llm import language_id, quality_rules, suffix_dedup
from fathom.llm.common import Words


def hash_of(word):
    data = np.frombuffer(word.encode(), np.uint8)
    return int(Words(data, np.array([0, len(data)])).hash[0])


def test_quality_references_count_every_word(spark):
    """Words that are common only over all tasks together: 64 of them, each below 3,000 own words of each task."""
    shared = " ".join(f"shared{i} shared{i}" for i in range(64))
    rows = [(t, " ".join(f"own{t}n{i} " * 3 for i in range(3000)) + shared, "en") for t in range(4)]
    docs = spark.createDataFrame(spark.sparkContext.parallelize(rows, 4), "doc_id long, text string, lang string")
    known = quality_rules.references(docs)
    assert set(known["words"][0].tolist()) == {hash_of(f"shared{i}") for i in range(64)}
    assert known["shares"][0][:64] == pytest.approx(8 / (4 * 3000 * 3 + 8 * 64))


def test_quality_references_of_all_languages(spark):
    rows = [(i, " ".join(f"l{i}w{j}" for j in range(80)), f"lang{i:03}") for i in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    known = quality_rules.references(docs)
    assert len(known["words"]) == 150
    got = quality_rules.with_quality_rules(docs.select("doc_id", "text"), known).collect()
    assert len(got) == 150 and max(r.word_distance for r in got) < 1e-6  # each is nearest to its own


def test_positions_beyond_16_mib():
    """A text of more than 16 MiB, in segments: its tail chooses what the tail alone does."""
    data = np.random.default_rng(3).integers(0, 256, (1 << 24) + 5000).astype(np.uint8)
    tail = 1 << 24
    place, _, bucket, _ = suffix_dedup.positions(data, np.array([0, len(data)]))
    alone, _, own, _ = suffix_dedup.positions(data[tail:], np.array([0, len(data) - tail]))
    inner = place >= tail + 100
    assert inner.sum() > 200 and (place[inner] - tail).tolist() == alone[alone >= 100].tolist() and bucket[inner].tolist() == own[alone >= 100].tolist()


def test_positions_of_segments(monkeypatch):
    data = np.frombuffer((b"abc" * 40 + bytes(range(97, 123)) * 9) * 20, np.uint8)
    at = np.array([0, 700, 730, len(data)])
    want = suffix_dedup.positions(data, at)
    monkeypatch.setattr(suffix_dedup, "SEGMENT", 64)
    for a, b in zip(want, suffix_dedup.positions(data, at)):
        assert a.tolist() == b.tolist()


def spoken(seed, letters, n=400):
    rng = np.random.default_rng(seed)
    words = ["".join(rng.choice(list(letters), 5)) for _ in range(40)]
    return lambda i: " ".join(np.random.default_rng([seed, i]).choice(words, n))


@pytest.mark.parametrize("size", [None, 1 << 16])
def test_every_language_is_learned(spark, monkeypatch, size):
    """40 languages of three scripts, the rarer ones too, in one pass and in many."""
    scripts = ["abcdefghijklmnopqrstuvwxyz", "абвгдежзийклмнопрстуфхцчшщ", "".join(map(chr, range(0x4E00, 0x4E80)))]
    says = {f"l{k:02}": spoken(k, scripts[k % 3]) for k in range(40)}
    rows = [(1000 * k + i, say(i), lang) for k, (lang, say) in enumerate(says.items()) for i in range(3 if k < 38 else 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    if size:
        monkeypatch.setattr(language_id, "PASS_BYTES", size)
    asked = spark.createDataFrame([(k, say(9), lang) for k, (lang, say) in enumerate(says.items())], "doc_id long, text string, lang string")
    got = language_id.with_language(asked, language_id.fit(docs)).collect()
    assert len(got) == 40 and all(r.lang_pred == r.lang for r in got)


def test_whole_texts_are_learned(spark):
    """What stands after the first 4,000 characters of a text is learned too."""
    a, b = spoken(1, "abcdefgh", 60), spoken(2, "abcdefgh", 60)
    same = "hgfedcba " * 700
    docs = spark.createDataFrame([(1, same + a(0), "a"), (2, same + b(0), "b")], "doc_id long, text string, lang string")
    asked = spark.createDataFrame([(1, a(0), "a"), (2, b(0), "b")], "doc_id long, text string, lang string")
    assert all(r.lang_pred == r.lang for r in language_id.with_language(asked, language_id.fit(docs)).collect())
