"""Quality classifier by compression: texts compress better beside their like.

Two zstandard dictionaries are built from good and from bad labelled texts. A text is
compressed with both, in blocks short enough for the dictionary to matter throughout;
the difference of the sizes, normalised by their sum, is the evidence, and a logistic
regression over it and the text's compressed share turns it into a probability.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches, chunks, doc_remainder, documents, labelled, logistic, probability, text_bytes

#: Labelled texts that fit the model, of both labels evenly; bytes of a dictionary and of the texts that it is built from.
FIT_ROWS, DICTIONARY, SAMPLE = 12_000, 112 << 10, 6 << 20
#: Bytes that are compressed at a time, and the level.
BLOCK, LEVEL = 4096, 1


def build_dictionary(texts: list[bytes]) -> bytes:
    """A zstandard dictionary of the texts' blocks; with too few of them, the texts themselves (raw content)."""
    blocks = [t[i : i + BLOCK] for t in texts for i in range(0, len(t), BLOCK)]
    blocks = [b for b in blocks if len(b) >= 16]
    try:
        return zstandard.train_dictionary(DICTIONARY, blocks, k=256, d=8).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"\n".join(texts)[:DICTIONARY] or b"-"


class Coder:
    def __init__(self, good: bytes, bad: bytes):
        self.by = [zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_checksum=False, write_dict_id=False) for d in (good, bad)]

    def sizes(self, column: pa.Array) -> np.ndarray:
        """For each text: its bytes, and its compressed sizes by the good and by the bad dictionary."""
        data, at = text_bytes(column)
        raw = memoryview(data.tobytes())
        good, bad = (c.compress for c in self.by)
        out = np.zeros((len(at) - 1, 3))
        for i, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist())):
            g = h = 0
            for s in range(a, b, BLOCK):
                block = raw[s : min(s + BLOCK, b)]
                g += len(good(block))
                h += len(bad(block))
            out[i] = b - a, g, h
        return out


def features(sizes: np.ndarray) -> np.ndarray:
    n, good, bad = sizes.T
    difference = (bad - good) / np.maximum(1, bad + good)
    share = np.minimum(2.0, np.minimum(good, bad) / np.maximum(1, n))
    length = np.log1p(n)
    return np.column_stack([10 * difference, 10 * difference * np.minimum(1, length / 8), share, share**2, length / 10, 10 * difference * share])


def fit(docs: DataFrame, labels: DataFrame) -> dict:
    """The two dictionaries and the calibration, from FIT_ROWS labelled rows at most.

    Half of the rows (by a hash of the id) build the dictionaries, from SAMPLE bytes of each
    label at most; the other half, which the dictionaries have not seen, calibrates.
    """
    spark = docs.sparkSession
    arrow_batches(spark)
    rows, share = labelled(docs, labels, "quality", FIT_ROWS)
    rows = rows.withColumn("half", F.pmod(F.xxhash64(F.lit("half"), "doc_id"), F.lit(2))).persist()
    model: dict = {"weights": np.array([2.0] + [0.0] * 6)}
    for label, name in ((1, "good"), (0, "bad")):
        mine = rows.where(f"label = {label} and half = 0 and text is not null")
        most = mine.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        some = mine.where(F.pmod(F.xxhash64(F.lit("dictionary"), "doc_id"), F.lit(1_000_000)) < 1_000_000 * min(1.0, SAMPLE / max(1, most)))
        model[name] = build_dictionary([r["text"].encode() for r in some.select("text").orderBy(F.xxhash64("doc_id"), "text").toLocalIterator()])
    shared = spark.sparkContext.broadcast(dict(model))  # two dictionaries of DICTIONARY bytes

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(shared.value["good"], shared.value["bad"])
        for batch in chunks(batches):
            s = coder.sizes(batch.column("text"))
            yield pa.RecordBatch.from_arrays([*(pa.array(c) for c in s.T), batch.column("label")], ["n", "good", "bad", "label"])

    seen = rows.where("half = 1").mapInArrow(measure, "n double, good double, bad double, label int").toPandas()  # FIT_ROWS rows of numbers
    if seen.label.nunique() == 2:
        x, y = features(seen[["n", "good", "bad"]].to_numpy()), seen.label.to_numpy(np.float64)
        model["weights"] = logistic(x, y, np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean())))
    rows.unpersist()
    return model


def with_quality(docs: DataFrame, model: dict, prefix: str = "") -> DataFrame:
    """docs with score (0 to 1, higher: likelier good) and size_difference, the normalised difference of the compressed sizes.

    Null and empty texts have no difference and score by the calibration's constant.
    Columns of docs that clash with the new ones are replaced. An empty table gives no rows.
    """
    arrow_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    new = {prefix + "score": "double", prefix + "size_difference": "double"}
    held = docs.drop(*[c for c in docs.columns if c.lower() in new])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(shared.value["good"], shared.value["bad"])
        for batch in chunks(batches):
            x = features(coder.sizes(batch.column("text")))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(probability(x, shared.value["weights"])), pa.array(x[:, 0] / 10)], [*batch.schema.names, *new])

    return held.mapInArrow(run, ", ".join([*(f"`{c}` {t}" for c, t in held.dtypes), *(f"{c} {t}" for c, t in new.items())]))


def op9_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = with_quality(docs, model).withColumn("held_out", F.coalesce(doc_remainder(5) == 0, F.lit(False)))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "size_difference")
