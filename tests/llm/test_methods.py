"""The methods' cores against plain versions, and the hard cases of skew, repeats, nulls and clashing names."""

import hashlib
import math
import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fathom.llm import exact_topk, jaccard_join, language_id, packing, quality_classifier, quality_rules, sentencepiece_codec, sharding, suffix_dedup, toxicity
from fathom.llm import queries as llm

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def frame(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema)


# --- models ------------------------------------------------------------------


@pytest.mark.parametrize("name, label", [("op2_toxicity", "toxic"), ("op9_quality_classifier", "quality")])
def test_held_out_labels_change_nothing(spark, tmp_path, name, label):
    spark.read.parquet(f"{SF}/documents.parquet").write.parquet(f"{tmp_path}/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    labels.withColumn(label, F.when(held, 1 - F.col(label)).otherwise(F.col(label))).write.parquet(f"{tmp_path}/labels.parquet")
    scores = [sorted((r.doc_id, r.score) for r in llm.queries()[name](spark, d).collect()) for d in (SF, str(tmp_path))]
    assert scores[0] == scores[1]


def plain_segments(s, at=0):
    best = max(((sum(s[i:j]), -i, j) for i in range(len(s)) for j in range(i + 1, len(s) + 1)), default=(0, 0, 0))
    if best[0] <= 0:
        return []
    value, i, j = best[0], -best[1], best[2]
    return plain_segments(s[:i], at) + [(at + i, at + j, value)] + plain_segments(s[j:], at + j)


def test_segments():
    rng = np.random.default_rng(5)
    for n in [0, 1, *range(2, 40)]:
        s = rng.normal(-0.1, 1, n)
        got = toxicity.segments(s)
        want = plain_segments(s.tolist())
        assert [x[:2] for x in got] == [x[:2] for x in want]
        assert np.allclose([x[2] for x in got], [x[2] for x in want])


def test_compressed_sizes():
    texts = ["good words here " * 30, "", "x" * 9000, "été " * 500]
    good, bad = quality_classifier.build_dictionary([b"good words here " * 50]), quality_classifier.build_dictionary([b"zzz qqq " * 90])
    coder = quality_classifier.Coder(good, bad)
    for text, (n, g, b) in zip(texts, coder.sizes(pa.array(texts)).tolist()):
        raw = text.encode()
        blocks = [raw[i : i + quality_classifier.BLOCK] for i in range(0, len(raw), quality_classifier.BLOCK)]
        assert (n, g, b) == (len(raw), *(sum(len(c.compress(x)) for x in blocks) for c in coder.by))


def test_phrases():
    rng = np.random.default_rng(2)
    sample = rng.integers(0, 4, 300).astype(np.int32)
    table = language_id.packed(language_id.suffix_automaton(sample), 4)
    known = "".join(map(str, sample))
    for n in (0, 1, 5, 127, 128, 129, 400):
        text = rng.integers(0, 5, n).astype(np.int32)  # 4 is no symbol of the sample
        want = 0
        for s in range(0, n, language_id.STRETCH):
            part, i = "".join(map(str, text[s : s + language_id.STRETCH])), 0
            while i < len(part):
                j = i + 1
                while j <= len(part) and part[i:j] in known:
                    j += 1
                i = max(i + 1, j - 1)
                want += 1
        assert language_id.phrases(text, np.array([0, n]), table).tolist() == [want]


def test_divergence_judges_by_the_nearest_language(spark):
    rows = [(i, " ".join(f"w{j % 70}" for j in range(200)), "a") for i in range(5)] + [(9, " ".join(f"odd{j}" for j in range(200)), "a")]
    got = {r.doc_id: r for r in quality_rules.with_quality_rules(frame(spark, rows, "doc_id long, text string, lang string")).collect()}
    known = quality_rules.references(frame(spark, rows, "doc_id long, text string, lang string"))
    p = np.zeros(65)
    p[64] = 1  # none of the common words
    q = known["shares"][0]
    m = (p + q) / 2
    part = lambda x: sum(a * math.log2(a / b) for a, b in zip(x, m) if a > 0)
    assert got[9].word_distance == pytest.approx(math.sqrt((part(p) + part(q)) / 2))
    assert got[9].kept == (got[9].word_distance <= quality_rules.MOST_WORDS and got[9].class_distance <= quality_rules.MOST_CLASSES)
    assert all(got[i].kept is False for i in range(5))  # repeated words: base_failed


# --- pieces and packing ------------------------------------------------------


def test_viterbi_is_best():
    model = sentencepiece_codec.load_model(sentencepiece_codec.piece_model())
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.piece_model())
    pieces = {sp.id_to_piece(int(i)): (float(s), int(i)) for i, s in zip(model["ids"], model["scores"])}
    longest = max(map(len, pieces))
    for text in ["▁hello", "▁international", "▁日本語ok", "▁Übergrößen", "▁a\U0001f600b", "▁▁▁x", "▁12.50€"]:
        best = [(0.0, [])] + [(-math.inf, [])] * len(text)
        for i in range(len(text)):
            for j in range(i + 1, min(len(text), i + longest) + 1):
                if text[i:j] in pieces:
                    s, own = pieces[text[i:j]][0], [pieces[text[i:j]][1]]
                elif j == i + 1:
                    s, own = model["unknown"], [int(model["bytes"][b]) for b in text[i:j].encode()]
                else:
                    continue
                if best[i][0] + s > best[j][0]:
                    best[j] = (best[i][0] + s, best[i][1] + own)
        assert sentencepiece_codec.viterbi([text.encode()], model)[0].tolist() == best[-1][1], text


def count(plan):
    return sum(n for _, n in plan)


def held(plan, capacity):
    out = {}
    for own, n in plan:
        assert n > 0 and sum(x * a for x, a in own.items()) <= capacity
        for x, a in own.items():
            out[x] = out.get(x, 0) + a * n
    return out


def exact(lengths, capacity):
    """The fewest sequences, by all ways to fill one with the longest piece left."""
    lengths = tuple(sorted(lengths, reverse=True))

    @lru_cache(None)
    def fewest(left):
        if not left:
            return 0
        best = len(left)

        def fill(room, rest, at, out):
            nonlocal best
            best = min(best, 1 + fewest(tuple(out + list(rest[at:]))))
            for i in range(at, len(rest)):
                if rest[i] <= room and (i == at or rest[i] != rest[i - 1]):
                    fill(room - rest[i], rest, i + 1, out + list(rest[at:i]))

        fill(capacity - left[0], left[1:], 0, [])
        return best

    return fewest(lengths)


def test_plan_of_small_instances():
    rng = np.random.default_rng(1)
    for _ in range(25):
        lengths = rng.integers(15, 70, 9).tolist()
        histogram = {x: lengths.count(x) for x in lengths}
        plan = packing.plan(histogram, 100)
        assert held(plan, 100) == histogram
        assert exact(lengths, 100) <= count(plan) <= exact(lengths, 100) + 1


@pytest.mark.parametrize("lengths", [[700, 1365, 1366, 1370, 2047, 2049], [2100], list(range(900, 2201, 40))])
def test_plan_is_bounded_and_no_worse_than_best_fit(lengths):
    for each in (500, 50_000):
        histogram = {x: each + x % 7 for x in lengths}
        plan = packing.plan(histogram)
        assert held(plan, 4096) == histogram
        every = np.zeros(4097, np.int64)
        every[list(histogram)] = list(histogram.values())
        assert count(plan) <= count(packing._best_fit(every, 4096))
        assert len(plan) <= 200 * len(lengths)


def test_words_of_a_batch():
    encoder = packing.Encoder(packing.word_tokenizer())
    texts = ["it's we'll I'VE they'd 'tis 'sound rock'n'roll ''s", "a1b22 x-y ...'re", "", "  \n", "日本 ok", "İx"] + [f"word{i}s" for i in range(50)]
    for _ in range(2):  # the second time from the table
        for text, ids in zip(texts, encoder(texts)):
            assert ids.tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids, text


# --- dedup -------------------------------------------------------------------


def plain_dedup(rows):
    seen, out = {}, []
    for doc, text in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        data = (text or "").encode()
        for i in range(len(data) - 49):
            seen.setdefault(data[i : i + 50], doc)
    for doc, text in rows:
        data = (text or "").encode()
        cover = bytearray(len(data))
        for i in range(len(data) - 49):
            if doc is not None and seen[data[i : i + 50]] < doc:
                cover[i : i + 50] = b"\x01" * 50
        kept = bytes(b for b, c in zip(data, cover) if not c)
        out.append((doc, len(data), sum(cover), len(re.findall(b"\x01+", bytes(cover))), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def messy(n=120):
    """One passage in a third of the rows, each time in other words and cut elsewhere; repeats, null ids, null texts."""
    rng = np.random.default_rng(7)
    words = [f"w{i}" for i in range(300)]
    passage = " ".join(rng.choice(words, 60))
    rows = []
    for i in range(n):
        own = " ".join(rng.choice(words, 40))
        a, b = sorted(rng.integers(0, len(passage), 2).tolist())
        rows.append((i, own + passage[a:b] + own[:30] if i % 3 == 0 else own))
    return rows + [(5, rows[5][1]), (6, "another text under the id of six " + passage), (None, passage), (n, None), (n + 1, ""), (None, None), (n + 2, "é" * 200), (n + 3, "aé" + "é" * 199)]


@pytest.mark.parametrize("most, common", [(50_000, 8), (1, 8), (50_000, 1), (2, 1)])
def test_dedup_with_buckets_dealt_out(spark, monkeypatch, most, common):
    monkeypatch.setattr(suffix_dedup, "MOST", most)
    monkeypatch.setattr(suffix_dedup, "COMMON", common)
    rows = messy()
    got = [tuple(r) for r in suffix_dedup.repeated_passages(frame(spark, rows).repartition(3)).collect()]
    assert sorted(got, key=repr) == plain_dedup(rows)


def test_without_repeats_keeps_columns(spark):
    rows = [(d, t, "x", i) for i, (d, t) in enumerate(messy())]
    got = suffix_dedup.without_repeats(frame(spark, rows, "doc_id long, text string, start string, key int")).collect()
    assert sorted(r.key for r in got) == list(range(len(rows))) and {r.start for r in got} == {"x"}
    texts = {r.key: r.text for r in got}
    for (doc, n, removed, *_), (i, (_, text)) in zip([next(p for p in plain_dedup(messy()) if p[0] == d and p[1] == len((t or "").encode())) for d, t in messy()], enumerate(messy())):
        if text is None:
            assert texts[i] is None
        elif not removed:
            assert texts[i] == text
        elif text.isascii():
            assert len(texts[i]) == n - removed


# --- near duplicates ---------------------------------------------------------


def shingles(text, k):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set())


def plain_classes(rows, k, permille):
    sets = [(d, shingles(t, k)) for d, t in rows if d is not None]
    least = {d: d for d, _ in sets}

    def root(d):
        while least[d] != d:
            d = least[d]
        return d

    for i, (a, x) in enumerate(sets):
        for b, y in sets[i + 1 :]:
            if x and y and 1000 * len(x & y) >= permille * len(x | y):
                p, q = sorted((root(a), root(b)))
                least[q] = p
    return sorted((d, len(s), root(d)) for d, s in sets)


def family(n=150):
    """Near copies of one text, few of them near the smallest; some linked only by way of others, some with none."""
    rng = np.random.default_rng(11)
    base = [f"b{i}" for i in range(120)]
    rows = [(0, " ".join(base[:60] + [f"z{i}" for i in range(60)]))]
    for i in range(1, n):
        own = list(base)
        for j in range(int(rng.integers(0, 9))):
            own[int(rng.integers(0, 120))] = f"e{rng.integers(0, 40) if i % 2 else (i, j)}"
        rows.append((i, " ".join(own)))
    return rows + [(n, None), (n + 1, ""), (n + 2, "One two"), (n + 3, "one TWO"), (3, rows[3][1]), (n + 4, "one two three")]



def test_refined_identifiers_tell_byte_ranges_apart():
    """Ranges have equal identifiers where their bytes are equal, of every length that is refined, and no others."""
    rng = np.random.default_rng(5)
    data = np.tile(rng.integers(97, 99, 400, dtype=np.uint8), 3)
    data[450] ^= 1
    grams = suffix_dedup._grams(data)
    raw = data.tobytes()
    for n in (40, 41, 50, 65, 79, 80):
        low = np.arange(len(data) - n + 1)
        own = suffix_dedup._reach(grams, low, low + n)
        named: dict[bytes, set[int]] = {}
        for x, i in zip(low.tolist(), own.tolist()):
            named.setdefault(raw[x : x + n], set()).add(i)
        assert all(len(v) == 1 for v in named.values())
        assert len(set(own.tolist())) == len(named)


@pytest.mark.parametrize("k, threshold", [(3, 0.9), (5, 0.8)])
def test_near_copies_that_are_not_copies_of_the_smallest(spark, k, threshold):
    rows = family()
    got = sorted(tuple(r) for r in jaccard_join.near_duplicates(frame(spark, rows + [(None, "no id")]), k, threshold).where("doc_id is not null").collect())
    assert got == plain_classes(rows, k, round(threshold * 1000))


def test_members_without_a_partner(monkeypatch):
    """Members stay where one of another component fits, whatever batches the lists come in; long lists stay whole."""
    monkeypatch.setattr(jaccard_join, "SEARCHED", 40)
    rng = np.random.default_rng(8)
    rows = []
    for g in range(300):
        m = int(rng.integers(1, 9)) if g % 10 else int(rng.integers(20, 60))
        for n in sorted(rng.integers(1, 60, m).tolist()):
            rows.append((g, len(rows), n, int(rng.integers(0, n // 5 + 1)), 0, int(rng.integers(0, m + 2)), m))
    names = ["g", "doc", "n", "place", "band", "component", "m"]
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
    schema = pa.schema([pa.field(c, t, nullable=c != "m") for c, t in zip(names, types)])  # a count has no nulls
    whole = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], schema=schema)

    def fit(a, b):
        need = -(-900 * (a[2] + b[2]) // 1900)
        return a[5] != b[5] and a[2] - a[3] >= need and b[2] - b[3] >= need

    want = []
    for g in range(300):
        members = [r for r in rows if r[0] == g]
        stay = [a for a in members if any(fit(a, b) for b in members)] if members[0][6] <= 40 else members
        want += [(*r[:6], len(stay) if members[0][6] <= 40 else r[6]) for r in stay]
    assert 0 < len(want) < len(rows)
    for size in (1, 7, 100, len(rows)):
        got = list(jaccard_join._without_lone(900)(whole.slice(i, size) for i in range(0, len(rows), size)))
        assert all(b.schema == schema for b in got)  # whole and searched lists meet in one task
        assert sorted(tuple(r.values()) for b in got for r in b.to_pylist()) == sorted(want)


def test_lists_without_room_make_no_pivots(spark, monkeypatch):
    """Sixty phrases, each in five texts too different in size to link: no round takes their lists up."""
    sizes = (60, 90, 135, 200, 300)
    bodies = [" ".join(f"s{n}w{i}" for i in range(n)) for n in sizes]
    rows = [(5 * g + i, f"{body} p{g} q{g} r{g}") for g in range(60) for i, body in enumerate(bodies)]
    taken, cells = [], jaccard_join._cells

    def counted(lists, pivots, permille):
        mixed = lists.groupBy("g").agg(F.count_distinct(F.col("doc") % 5).alias("sizes")).where("sizes > 1")
        taken.append((pivots, mixed.count()))
        return cells(lists, pivots, permille)

    monkeypatch.setattr(jaccard_join, "_cells", counted)
    got = sorted(tuple(r) for r in jaccard_join.near_duplicates(frame(spark, rows), 3, 0.9).collect())
    assert got == plain_classes(rows, 3, 900)
    assert taken and not any(n for _, n in taken), taken


# --- search and shards -------------------------------------------------------


def test_topk_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (0, [2.0, 1.0]), (1, [3.0, 3.0]), (2, [3.0, 3.0]), (3, [1.0]), (4, [7.0]), (5, []), (6, None), (None, [9.0, 9.0]), (7, [nan, 1.0]), (8, [inf, 1.0]), (9, [None, 1.0])]
    t = frame(spark, [(*r, "x") for r in rows], "vec_id long, vector array<double>, score string")
    got = sorted(tuple(r) for r in exact_topk.exact_topk(t, t, 2).collect())
    sound = [(i, v) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    want = []
    for i, q in sound:
        best = sorted((-int(sum(a * b for a, b in zip(q, v))), j) for j, v in sound if j != i and len(v) == len(q))[:2]
        want += [(i, r + 1, j, -s) for r, (s, j) in enumerate(best)]
    assert got == sorted(want)


def test_shards_of_repeated_rows_and_clashing_names(spark):
    rows = [(None, "s", 1)] * 40 + [(7, "s", 2)] * 41 + [(i, "s", 3) for i in range(20)]
    got = sharding.shuffle_into_shards(frame(spark, rows, "doc_id long, shard string, slot int").repartition(3), 8).collect()
    assert len(got) == 101 and got[0].asDict().keys() == {"doc_id", "shard", "slot"}
    sizes = [sum(r.shard == s for r in got) for s in range(8)]
    assert max(sizes) - min(sizes) <= 1 and sorted((r.shard, r.slot) for r in got) == [(s, i) for s in range(8) for i in range(sizes[s])]
    assert max(sum(r.doc_id == 7 and r.shard == s for r in got) for s in range(8)) < 41  # copies spread


def test_shuffle_is_uniform(spark):
    """Each row is as likely in each shard: chi-square over seeds, 7 degrees of freedom for each of 40 rows."""
    rows = frame(spark, [(i,) for i in range(40)], "doc_id long").repartition(2)
    seen = np.zeros((40, 8))
    for seed in range(12):
        for r in sharding.shuffle_into_shards(rows, 8, seed).collect():
            seen[r.doc_id, r.shard] += 1
    chi = ((seen - 1.5) ** 2 / 1.5).sum()
    assert 180 < chi < 400  # 280 on average


@pytest.mark.parametrize("name", ["toxicity", "quality", "language", "rules"])
def test_clashing_columns_are_replaced(spark, name):
    rows = frame(spark, [(1, "some text", "a", "b", "c", "d"), (None, None, "a", "b", "c", "d")], "doc_id long, text string, score string, lang_pred string, kept string, n_words string")
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    got = {
        "toxicity": lambda: toxicity.with_toxicity(rows, toxicity.fit(docs, labels)),
        "quality": lambda: quality_classifier.with_quality(rows, quality_classifier.fit(docs, labels)),
        "language": lambda: language_id.with_language(rows, language_id.fit(docs)),
        "rules": lambda: quality_rules.with_quality_rules(rows, quality_rules.references(docs)),
    }[name]()
    assert len(got.columns) == len({c.lower() for c in got.columns}) and got.count() == 2
    assert dict(got.dtypes).get("score", "double") in ("double", "string")


# --- pipeline ----------------------------------------------------------------


def test_pipeline_stages_against_plain_versions(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    fresh = lambda kept: frame(spark, [tuple(r) for r in docs.where(F.col("doc_id").isin(kept)).collect()], docs.schema)
    toxic = {r.doc_id for r in llm.queries()["op2_toxicity"](spark, SF).collect() if r.score >= 0.5}
    kept = {r.doc_id for r in p.drop_toxic(spark, docs, SF).collect()}
    assert kept == {d for d, _ in rows} - toxic
    judged = {r.doc_id for r in quality_rules.with_quality_rules(fresh(list(kept))).where("kept").collect()}
    good = {r.doc_id for r in p.drop_low_quality(spark, fresh(list(kept)), SF).collect()}
    assert good == judged and good
    left = [(d, t) for d, t in rows if d in good]
    first = {d for d, _, c in plain_classes(left, 5, 800) if d == c}
    assert {r.doc_id for r in p.drop_near_duplicates(spark, fresh(list(good)), SF).collect()} == first
    left = [(d, t) for d, t in left if d in first]
    sizes = {d: n - removed for d, n, removed, *_ in plain_dedup(left)}
    cut = {r.doc_id: r.text for r in p.drop_repeated_passages(spark, fresh(list(first)), SF).collect()}
    assert all(len(t.encode()) >= sizes[d] and len(t.encode()) - sizes[d] < 8 * (1 + t.count("\n") + len(t) // 50) for d, t in cut.items())
    assert {d for d, n in sizes.items() if n > 20} - set(cut) == set()
    pieces = p.pack_sequences(spark, frame(spark, sorted(cut.items())), SF).collect()
    assert {r.doc_id for r in pieces} == set(cut) and zlib.crc32(b"") == 0
    assert sum(r.length for r in pieces) <= 4096 * len({r.sequence_id for r in pieces})
