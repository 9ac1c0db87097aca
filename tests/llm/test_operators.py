"""The text operators against plain versions, on the smallest tables and on a table of edge cases."""

import hashlib
import re
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from fathom.llm import queries as llm

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def edges(spark, tmp_path_factory):
    """Null, empty and long texts, copies, near copies, shared passages, a clashing extra column."""
    long = " ".join(f"w{i % 700}x{i % 13}" for i in range(9000))
    passage = " ".join(f"shared{i}" for i in range(60))
    base = [f"word{i}" for i in range(120)]
    texts = [None, "", "  \n", "a", long, long, passage, f"before {passage} after", passage + " again " + passage, " ".join(base), " ".join(base[:-1] + ["other"]), "x " * 500, "été 日本語 ok"] + ["same text in each of these rows"] * 5
    rows = [(i, t, "en", None if i % 3 else "s", 0, f"e{i}") for i, t in enumerate(texts)]
    folder = str(tmp_path_factory.mktemp("edges"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, i % 2, int(i % 3 == 0)) for i, *_ in rows], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


def texts_of(spark, folder):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()}


@pytest.fixture(params=["tables", "edges"])
def folder(request, edges):
    return SF if request.param == "tables" else edges


def test_packing(spark, folder):
    rows = llm.queries()["op1_best_fit_packing"](spark, folder).collect()
    from fathom.llm.packing import word_tokenizer
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(word_tokenizer())
    want = {}
    for doc, text in texts_of(spark, folder).items():
        ids = [*t.encode(text, add_special_tokens=False).ids, 1]
        for piece, s in enumerate(range(0, len(ids), 4096)):
            part = ids[s : s + 4096]
            want[doc, piece] = (s, len(part), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in part)))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == want
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for slots in by_sequence.values():
        at = 0
        for offset, length in sorted(slots):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(by_sequence) <= 1.02 * -(-sum(r.length for r in rows) // 4096) + 1


@pytest.mark.parametrize("name", ["op2_toxicity", "op9_quality_classifier"])
def test_classifiers(spark, folder, name):
    rows = llm.queries()[name](spark, folder).collect()
    assert {r.doc_id for r in rows} == set(texts_of(spark, folder))
    bar = 0.5 if name == "op2_toxicity" else 0.3
    for r in rows:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= bar)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)


def test_language(spark, folder):
    rows = llm.queries()["op3_language_id"](spark, folder).collect()
    texts = texts_of(spark, folder)
    assert {r.doc_id for r in rows} == set(texts)
    for r in rows:
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in texts[r.doc_id]))
    if folder == SF:
        langs = dict(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect())
        held = [r for r in rows if r.held_out and r.lang_pred != "und"]
        assert sum(r.lang_pred == langs[r.doc_id] for r in held) >= 0.95 * len(held)


def test_sharding(spark, folder):
    rows = llm.queries()["op4_sharding"](spark, folder).collect()
    texts = texts_of(spark, folder)
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    sizes = [0] * 8
    for r in rows:
        data = texts[r.doc_id].encode()
        assert (r["size"], r.text_crc32) == (len(data) + 1, zlib.crc32(data))
        sizes[r.shard] += 1
    assert max(sizes) - min(sizes) <= 1
    assert sorted((r.shard, r.slot) for r in rows) == [(s, i) for s in range(8) for i in range(sizes[s])]


def test_sentencepiece(spark, folder):
    rows = llm.queries()["op5_sentencepiece"](spark, folder).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts_of(spark, folder))
    assert all(r.round_trip for r in rows)


def test_topk(spark):
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{SF}/embeddings.parquet'")
    got = llm.queries()["op6_exact_topk"](spark, SF).select("query_id", "rank", "vec_id", "score").collect()
    want = con.execute(f"select query_id, rank, vec_id, score from ({llm.oracle_sql()['op6_exact_topk']})").fetchall()
    assert sorted(map(tuple, got)) == sorted(want)


def test_jaccard_join(spark, folder):
    sets = {}
    for doc, text in texts_of(spark, folder).items():
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text))
        sets[doc] = {tuple(w[i : i + 3]) for i in range(len(w) - 2)} or ({tuple(w)} if w else set())
    least = {d: d for d in sets}

    def root(d):
        while least[d] != d:
            d = least[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                least[y] = x
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in llm.queries()["op7_ngram_jaccard_join"](spark, folder).collect()}
    assert got == {d: (len(sets[d]), root(d)) for d in ids}


def test_quality_rules(spark, folder):
    texts = texts_of(spark, folder)
    rows = llm.queries()["op8_quality_rules"](spark, folder).collect()
    assert {r.doc_id for r in rows} == set(texts)
    for r in rows:
        text = texts[r.doc_id]
        words = WORD.findall(text)
        windows = {}
        for i in range(len(words) - 7):
            windows.setdefault(tuple(words[i : i + 8]), []).append(i)
        repeated = {j for at in windows.values() if len(at) > 1 for i in at for j in range(i, i + 8)}
        lines = [x for x in text.split("\n") if WORD.search(x)]
        want = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeated))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, r.doc_id
        assert r.base_failed == (len(words) < 20 or 100 * len(repeated) > 30 * len(words))
        assert not (r.base_failed and r.kept)


def test_suffix_dedup(spark, folder):
    seen, want = set(), {}
    for doc, text in sorted(texts_of(spark, folder).items()):
        data = text.encode()
        own = [data[i : i + 50] for i in range(len(data) - 49)]
        cover = bytearray(len(data))
        for i, s in enumerate(own):
            if s in seen:
                cover[i : i + 50] = b"\x01" * 50
        seen.update(own)
        kept = bytes(b for b, c in zip(data, cover) if not c)
        want[doc] = (len(data), sum(cover), len(re.findall(b"\x01+", bytes(cover))), hashlib.sha256(kept).hexdigest())
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in llm.queries()["op10_suffix_array_dedup"](spark, folder).collect()}
    assert got == want


@pytest.mark.parametrize("name", sorted(llm.queries()))
def test_empty_table(spark, tmp_path, name):
    for t in ("documents", "labels", "embeddings"):
        spark.read.parquet(f"{SF}/{t}.parquet").where(F.lit(False)).write.parquet(f"{tmp_path}/{t}.parquet")
    assert llm.queries()[name](spark, str(tmp_path)).count() == 0


def test_pipeline(spark, folder):
    import corpus_pipeline

    rows = corpus_pipeline.run(spark, folder).collect()
    assert {r.doc_id for r in rows} <= set(texts_of(spark, folder))
    assert len({(r.doc_id, r.piece) for r in rows}) == len(rows)
