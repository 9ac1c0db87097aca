"""Shared helpers of the text operators: reading tables, cutting lineage, Arrow batches and vectorised hashing.

All hashing works on the UTF-8 bytes of a whole batch of documents at once with
NumPy, so that a pass over the corpus costs a few nanoseconds a byte.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that one NumPy pass takes at once; bounds a Python worker's memory.
CHUNK_BYTES = 1 << 19
#: Rows and bytes in an Arrow batch that goes to a Python worker, where the session has not chosen others.
BATCH_ROWS, BATCH_BYTES = 2000, 8 << 20

_MASK = (1 << 64) - 1
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def arrow_batches(spark: SparkSession) -> None:
    """Keeps batches small where the session has Spark's own settings: texts can be long.

    The settings stay, since a query runs after the function that builds it has returned.
    """
    for key, usual, own in (("maxRecordsPerBatch", "10000", BATCH_ROWS), ("maxBytesPerBatch", "67108864b", f"{BATCH_BYTES}b")):
        key = "spark.sql.execution.arrow." + key
        if spark.conf.get(key, usual) == usual:
            spark.conf.set(key, str(own))


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster shares: spark.checkpoint.dir, else one below the session's warehouse."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir") + "/fathom-cut"
    return folder.rstrip("/")


def cut(df: DataFrame, name: str) -> DataFrame:
    """Writes df into the shared folder and reads it again: later steps neither repeat nor depend on its lineage.

    What was shuffled on the way is removed as soon as the table is written.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/fathom-{name}-{uuid.uuid4().hex}"
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(key, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def forget(*tables: DataFrame) -> None:
    """Deletes tables that `cut` has written; nothing may read them any more."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table._cut_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def dealt_anew(df: DataFrame, *keys: str) -> DataFrame:
    """df, the result of an aggregate by keys (long), such that a join on them deals out both sides.

    Spark otherwise joins in the aggregate's own partitions, which AQE cannot split: a hot key
    of the other side would stay in one task.
    """
    return df.select(*[F.bitwise_not(F.bitwise_not(c)).alias(c) if c in keys else F.col(c) for c in df.columns])


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def doc_remainder(mod: int):
    """crc32(doc_id as text) mod `mod`; null ids have no remainder."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % mod


# --- batches -----------------------------------------------------------------


def chunks(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches whose texts hold about `limit` bytes at most, or one longer text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start, done = 0, 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(sizes, done + limit, side="right")))
            yield batch.slice(start, stop - start)
            start, done = stop, int(sizes[stop - 1])
        pa.default_memory_pool().release_unused()


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column one after another, and where each text begins; null texts are empty."""
    column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "").cast(pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


# --- hashing -----------------------------------------------------------------


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _power(kind: str, n: int) -> np.ndarray:
    if len(_powers[kind]) < n:
        steps = np.full(1 << (n - 1).bit_length(), _BASE if kind == "up" else _BASE_INVERSE, np.uint64)
        steps[0] = 1
        powers = np.multiply.accumulate(steps)
        if n > 2 * CHUNK_BYTES:  # a single long text: not kept for the worker's life
            return powers[:n]
        _powers[kind] = powers
    return _powers[kind][:n]


def running_sums(values: np.ndarray) -> np.ndarray:
    """Prefix sums of a polynomial hash modulo 2^64 of a sequence of numbers, one longer than it."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * _power("up", max(1, len(values)))[: len(values)], out=out[1:])
    return out


def running_hash(data: np.ndarray) -> np.ndarray:
    """running_sums of bytes."""
    return running_sums(_BYTE[data])


def range_hash(running: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """A hash of the bytes in [start, stop), wherever they stand."""
    return mix((running[stop] - running[start]) * _power("down", len(running))[start] + (stop - start).astype(np.uint64) * np.uint64(0xA0761D6478BD642F))


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes that end a run of letters: ASCII but for A-Z and a-z.
NOT_LETTERS = np.arange(256) < 128
NOT_LETTERS[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


class Words:
    """The words `[^\\x20\\x09-\\x0D]+` of a batch of texts: start, stop (bytes), hash, and first (each text's first word)."""

    def __init__(self, data: np.ndarray, at: np.ndarray, lower: bool = False, ends: np.ndarray = _SPACE):
        if lower:
            data = _LOWER[data]
        self.data, self.at = data, at
        inside = ~ends[data]
        begins, closes = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1]
        closes[:-1] &= ~inside[1:]
        full = at[1:] > at[:-1]
        a, b = at[:-1][full], at[1:][full] - 1
        begins[a], closes[b] = inside[a], inside[b]
        self.inside = inside
        self.start = np.flatnonzero(begins)
        self.stop = np.flatnonzero(closes) + 1
        self.running = running_hash(data)
        self.hash = range_hash(self.running, self.start, self.stop)
        self.first = np.searchsorted(self.start, at)

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """A hash for each run of k words within a text, and each text's first place in them (a text of fewer words has none)."""
        counts = np.diff(self.first)
        runs = np.maximum(counts - k + 1, 0)
        where = np.concatenate([[0], np.cumsum(runs)])
        if len(self.hash) < k:
            return np.zeros(0, np.uint64), where
        last = len(self.hash) - k + 1
        whole = chain([self.hash[j : j + last] for j in range(k)])
        text = np.repeat(np.arange(len(counts)), runs)
        return whole[np.arange(len(text)) - where[text] + self.first[text]], where


def chain(parts: list[np.ndarray]) -> np.ndarray:
    """A hash of a sequence of hashes, of its order and its length too."""
    out = np.full(len(parts[0]), len(parts), np.uint64)
    for part in parts:
        out = mix(out * np.uint64(0xE7037ED1A0B428DB) + part)
    return out


def shingle_sets(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    """Each text's distinct k-word shingles as sorted hashes: words lower-cased in A-Z; with fewer words the whole sequence counts as one."""
    words = Words(*text_bytes(column), lower=True)
    hashes, where = words.shingles(k)
    counts = np.diff(words.first)
    for i, n in enumerate(counts.tolist()):
        if n >= k:
            yield np.unique(hashes[where[i] : where[i + 1]])
        elif n:
            a = words.first[i]
            yield chain([words.hash[a + j : a + j + 1] for j in range(n)])
        else:
            yield np.zeros(0, np.uint64)


# --- small models ------------------------------------------------------------


def labelled(docs: DataFrame, labels: DataFrame, label: str, most: int, mod: int = 5) -> tuple[DataFrame, float]:
    """(doc_id, text, label) of `most` labelled rows or so, and the share of label 1 among all rows that may be learned from.

    Only rows with crc32(doc_id as text) mod `mod` other than 0 count, for both. The rows taken
    are those whose id hashes lowest, of both labels evenly; where a label has no more than
    `most` / 2 rows, all of them are. An id that is labelled twice has the greater label.
    Null ids and labels other than 0 and 1 are left out.
    """
    rows = labels.where(f"{label} in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max(label).cast("int").alias("label")).where(doc_remainder(mod) != 0)
    counts = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    part = F.create_map(*[x for k in (0, 1) for x in (F.lit(k), F.lit(min(1.0, most / 2 / max(1, counts.get(k, 0)))))])
    few = rows.where(F.pmod(F.xxhash64(F.lit("fit"), "doc_id"), F.lit(1_000_000)) < part[F.col("label")] * 1_000_000)
    return docs.select("doc_id", "text").join(F.broadcast(few), "doc_id"), counts.get(1, 0) / max(1, sum(counts.values()))  # `most` ids


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, ridge: float = 1e-2) -> np.ndarray:
    """Coefficients (constant first) of a ridge logistic regression, by Newton's method."""
    x = np.column_stack([np.ones(len(x)), x])
    w, weight = np.zeros(x.shape[1]), np.ones(len(x)) if weight is None else weight
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (weight * (y - p)) - ridge * w
        step = np.linalg.solve((x * (weight * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ x + ridge * np.eye(len(w)), gradient)
        w = w + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return w


def probability(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(w[0] + x @ w[1:], -30, 30)))
