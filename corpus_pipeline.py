"""A training corpus from raw documents: toxicity, quality rules, near duplicates, repeated passages, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.llm import jaccard_join, packing, quality_rules, suffix_dedup, toxicity
from fathom.llm.common import cut, documents

#: No stage can be said in SQL: the first needs a fitted model. The stages as they are used here have no brute-force test yet.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a toxicity of 0.5 or more go; the model is fitted to the labels of this stage's own documents.

    Null and empty texts score low and stay; rows that repeat stay, each judged alike.
    """
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = toxicity.with_toxicity(docs, model, prefix="toxicity_")
    return scored.where("toxicity_score < 0.5").select(*docs.columns)


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that break a quality rule go: null, empty and short texts among them. Rows with a null lang are judged like others."""
    measured = quality_rules.with_quality_rules(docs, prefix="quality_")
    return measured.where("quality_kept").select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates (five-word shingles, Jaccard >= 0.8) the smallest doc_id stays, once; rows without a doc_id all stay.

    Where rows share an id, one of them stays.
    """
    classes = jaccard_join.near_duplicates(docs, k=5, threshold=0.8)
    first = classes.where("doc_id = component_id").select("doc_id").distinct()
    kept = docs.join(first, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return kept.unionByName(docs.where("doc_id is null")).select(*docs.columns)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 bytes or more that an earlier document has are cut out; documents of which nothing but white space is left go.

    Null and blank texts go too. Rows without a doc_id lose no passage.
    """
    return suffix_dedup.without_repeats(docs).where(F.col("text").rlike(r"[^\x20\x09-\x0D]")).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of the documents in sequences of at most 4096 tokens: all documents, whole. A null text is one piece, of the end id alone."""
    return packing.pack(packing.token_pieces(docs, packing.word_tokenizer()))


STAGES = [
    ("toxicity", drop_toxic),
    ("quality_rules", drop_low_quality),
    ("near_duplicates", drop_near_duplicates),
    ("repeated_passages", drop_repeated_passages),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's result is written and read again before the next."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
