"""Parts of the library on small inputs: analyzers, paths into JSON, change logs, collections, quotas, files and streams."""

import pytest
from pyspark.sql import functions as F

from fathom.functions import arabic, text
from fathom.functions.analyzers import Analyzer, blocks, language, mixed, preset
from fathom.functions.filters import compile_filter
from fathom.operators import governance, knn, text_search
from fathom.sources import changelog
from fathom.sources.collections import Catalog, CatalogError
from fathom.streaming import replay


def value(spark, column):
    return spark.range(1).select(column).first()[0]


# --- analyzers ---------------------------------------------------------------


@pytest.mark.parametrize("word, want", [("كِتَابٌ", "كتاب"), ("أحمد", "احمد"), ("إسلام", "اسلام"), ("آمين", "امين"), ("العـــربية", "العربيه"), ("", ""), (None, None)])
def test_arabic_letters(spark, word, want):
    assert value(spark, arabic.normalise(F.lit(word).cast("string"))) == want
    assert word is None or arabic.plain(word) == want


def test_arabic_stems_and_roots(spark):
    stems = arabic.stems(F.array(*map(F.lit, ["الكتاب", "المدرسة", "والكتاب", "ون", "ولد"])))
    assert value(spark, stems) == ["كتاب", "مدرسة", "كتاب", "ون", "لد"]
    words = F.array(*map(F.lit, ["كاتب", "يكتب", "من", "استخدام", "abc", "مكتبات"]))
    assert value(spark, arabic.roots(words)) == ["كتب", "كتب", "", "خدم", "", "كتب"]
    assert value(spark, arabic.roots(F.array(F.lit("مدحرجون")), known=arabic.KNOWN_ROOTS)) == ["دحر"]


def test_arabic_analysis(spark):
    assert value(spark, arabic.arabic(F.lit("الكتاب في المدرسة إلى 7"))) == ["كتب", "مدرس"]  # only the first prefix that fits is cut
    assert "الي" not in value(spark, arabic.arabic(F.lit("إلى")))
    assert value(spark, arabic.arabic(F.lit("إلى"), stemming=False, as_listed=True)) == ["الي"]
    assert value(spark, arabic.arabic(F.lit(None).cast("string"))) == []


def test_mixed_texts(spark):
    both = "42 running الكتاب 7 12x كتب (played)"
    assert value(spark, blocks(F.lit(both))) == ["running ", "الكتاب 7 12", "x ", "كتب (", "played)"]
    kind = F.lit("Привет мир школа книга running الكتاب")
    assert value(spark, text.detect_language(kind)) == "universal"
    assert value(spark, mixed(kind)) == ["runn", "كتب"]
    assert value(spark, mixed(F.lit("The quick running fox"))) == ["quick", "runn", "fox"]
    assert value(spark, mixed(F.lit("مرحبا بالعالم"))) == value(spark, arabic.arabic(F.lit("مرحبا بالعالم")))
    assert value(spark, mixed(F.lit(None).cast("string"))) == []


def test_presets_and_stop_words(spark):
    assert [language(x) for x in ("AR", "English", "auto", "fr")] == ["arabic", "english", "auto", "universal"]
    line = F.lit("The running of a B Cats")
    assert value(spark, preset("en")(line)) == ["runn", "cats"]
    assert value(spark, Analyzer()(line)) == ["runn", "b", "cats"]
    assert value(spark, Analyzer(stop_words=(frozenset(text.STOP_WORDS) | {"Cats"}) - {"the"}, stemming=False)(line)) == ["the", "running", "b"]
    assert value(spark, Analyzer("universal")(line)) == ["the", "running", "of", "a", "b", "cats"]


def test_analyzer_in_search(spark):
    docs = spark.createDataFrame([(1, "He was running"), (2, "A play"), (3, None)], "doc_id long, text string")
    assert [r.id for r in text_search.bm25_search(docs, ["runn"], 5, analyzer=preset("en")).collect()] == [1]


def test_stop_word_file(spark, tmp_path):
    (tmp_path / "stop.txt").write_text("# a comment\n the \n\nof\nthe\n")
    assert sorted(r.word for r in changelog.stop_words(spark, str(tmp_path / "stop.txt")).collect()) == ["of", "the"]


# --- JSON --------------------------------------------------------------------


def test_deep_paths_and_dates(spark):
    rows = [(1, '{"a": {"b": {"c": 42}}}'), (2, '{"a": [{"b": {"c": 1}}, {"b": [{"c": 42}]}]}'), (3, '{"a": 42}'), (4, None)]
    table = spark.createDataFrame(rows, "id long, j string").withColumn("p", F.parse_json("j"))
    hits = lambda f: sorted(r.id for r in table.where(compile_filter(f, table)).collect())
    assert hits({"op": "eq", "field": "p.a.b.c", "value": 42}) == [1, 2]
    assert hits({"op": "exists", "field": "p.a.b"}) == [1, 2]
    assert hits({"op": "ne", "field": "p.a.b.c", "value": 42}) == [3, 4]
    assert hits({"op": "lt", "field": "p.a.b.c", "value": 10}) == [2]


def test_nested_payloads(spark):
    rows = [(1, '{"a": {"b": [1, {"c": 2.50}, [true, null]]}, "d": "x", "e": {}}'), (2, None), (3, "{broken"), (4, "7")]
    table = spark.createDataFrame(rows, "id long, j string").select("id", F.explode(changelog.flatten_nested(F.col("j"))).alias("e")).select("id", "e.*")
    assert [tuple(r) for r in table.orderBy("id").collect()] == [(1, "a.b", "1"), (1, "a.b.c", "2.50"), (1, "a.b", "true"), (1, "a.b", None), (1, "d", "x"), (4, "", "7")]


# --- changes, collections, quotas --------------------------------------------


def test_insert_and_upsert(spark):
    table = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    rows = spark.createDataFrame([(2, "c"), (3, "d"), (3, "d")], "id long, v string")
    assert sorted(map(tuple, changelog.insert(table, rows).collect())) == [(1, "a"), (2, "b"), (3, "d")]
    changes = spark.createDataFrame([(2, "x", 1), (2, "y", 2), (3, "z", 3)], "id long, v string, seq long")
    assert sorted(map(tuple, changelog.upsert(table, changes, seq="seq").collect())) == [(1, "a"), (2, "y"), (3, "z")]


def test_valid_rows(spark):
    table = spark.createDataFrame([(1, [1.0, 2.0], "t"), (None, [1.0, 2.0], "t"), (2, [1.0], "t"), (3, None, "t"), (4, [1.0, 2.0], None)], "id long, vector array<double>, body string")
    good, bad = changelog.valid(table, 2, ["body"])
    assert [r.id for r in good.collect()] == [1] and bad.count() == 4


def test_catalog(spark):
    catalog = Catalog(spark, "t9_")
    schema = spark.createDataFrame([], "id long, v string").schema
    catalog.create("one", "books", schema)
    catalog.create("two", "books", schema)
    try:
        with pytest.raises(CatalogError):
            catalog.create("one", "books", schema)
        with pytest.raises(CatalogError):
            catalog.create("one", "twice", spark.createDataFrame([], "id long").select("id", F.col("id").alias("ID")).schema)
        rows = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "id long, v string")
        catalog.insert("one", "books", rows)
        catalog.insert("one", "books", rows)
        assert sorted(map(tuple, catalog.table("one", "books").collect())) == [(1, "a"), (2, "b")]
        assert catalog.table("two", "books").count() == 0
        assert (catalog.tenants(), catalog.names("one"), catalog.names("nobody")) == (["one", "two"], ["books"], [])
        for tenant, name in (("one", "none"), ("nobody", "books")):
            with pytest.raises(CatalogError):
                catalog.table(tenant, name)
    finally:
        for tenant in ("one", "two"):
            catalog.drop(tenant, "books")
            spark.sql(f"drop database t9_{tenant}")


def test_quotas(spark):
    used = spark.createDataFrame([("a", 10, 3), ("b", 5, 1), ("c", 99, 9)], "tenant string, bytes long, collections long")
    quotas = spark.createDataFrame([("a", 9, 3), ("b", None, 0)], "tenant string, max_bytes long, max_collections long")
    assert sorted(map(tuple, governance.over_quota(used, quotas).collect())) == [("a", "bytes", 10, 9), ("b", "collections", 1, 0)]


# --- files and streams -------------------------------------------------------


def test_snapshot(spark, tmp_path):
    table = spark.range(5)
    changelog.snapshot(table, str(tmp_path / "s"))
    changelog.append(spark.range(5, 7), str(tmp_path / "s"))
    assert sorted(r.id for r in changelog.restore(spark, str(tmp_path / "s")).collect()) == list(range(7))


def test_streams(spark, tmp_path):
    rows = [(1, 1, "insert", "2024-01-01 00:00:00"), (1, 2, "delete", "2024-01-01 00:00:00"), (2, 3, "insert", "2024-01-01 00:00:01")]
    log = spark.createDataFrame(rows, "id long, seq long, op string, ts string").withColumn("ts", F.to_timestamp("ts"))
    changelog.append(log, str(tmp_path / "log"))
    stream = replay.changes(spark, str(tmp_path / "log") + "/*.parquet", log)
    last = replay.run_once(replay.last_changes(stream, "id", "seq"), "last_of_each", "complete", str(tmp_path / "c1"))
    assert sorted((r.id, r.op) for r in last.collect()) == [(1, "delete"), (2, "insert")]
    counted = replay.run_once(replay.counts_by_window(stream, "ts", "id"), "by_window", "complete", str(tmp_path / "c2"))
    assert sorted((r.id, r.n) for r in counted.collect()) == [(1, 2), (2, 1)]


def test_filters_of_a_batch(spark):
    rows = [(i, [float(i), 1.0], i % 2) for i in range(6)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label long")
    asked = table.where("vec_id < 2").withColumn("filter", F.col("vec_id"))
    got = knn.batch_search_where(table, asked, 2, [{"op": "eq", "field": "label", "value": 1}, None], "l2")
    assert sorted((r.query_id, r.rank, r.id) for r in got.collect()) == [(0, 1, 1), (0, 2, 3), (1, 1, 1), (1, 2, 0)]
