"""Sharding: a uniform shuffle of a table into shards of exact sizes, with DataFrame operations only.

The rows lie in blocks by a hash of their id. How many rows of each block go to each
shard is drawn exactly as a uniform permutation of all rows would deal them: the
matrix of block by shard counts has the shard sizes and the block sizes as margins
and multivariate hypergeometric rows. Each block orders its rows at random and deals
them out by its row of the matrix (permute, exchange); each shard orders what it got
at random again.
"""

from __future__ import annotations

import math
import random

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, documents, partitions

#: Rows that a task orders: blocks, and the parts of a shard, are so many that they hold no more on average.
ORDERED = 1_000_000


def hypergeometric(rng: random.Random, good: int, bad: int, drawn: int) -> int:
    """How many of `drawn` rows taken without replacement from good + bad are good: inversion outward from the mode."""
    low, high = max(0, drawn - bad), min(drawn, good)
    if low == high:
        return low
    mode = min(high, max(low, (drawn + 1) * (good + 1) // (good + bad + 2)))

    def log_choose(n: int, k: int) -> float:
        return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)

    p = math.exp(log_choose(good, mode) + log_choose(bad, drawn - mode) - log_choose(good + bad, drawn))
    u = rng.random() - p
    below = above = p
    i = j = mode
    while u >= 0 and (i > low or j < high):
        if j < high:
            above *= (good - j) * (drawn - j) / ((j + 1) * (bad - drawn + j + 1))
            j += 1
            u -= above
            if u < 0:
                return j
        if i > low:
            below *= i * (bad - drawn + i) / ((good - i + 1) * (drawn - i + 1))
            i -= 1
            u -= below
            if u < 0:
                return i
    return mode


def communication_matrix(blocks: list[int], shards: int, seed: int) -> list[list[int]]:
    """Row counts from each block to each shard; the shards' sums differ by one at most."""
    rng = random.Random(seed)
    total = sum(blocks)
    left = [total // shards + (s < total % shards) for s in range(shards)]
    out = []
    for size in blocks:
        rest, pool, row = size, sum(left), []
        for s in range(shards):
            n = hypergeometric(rng, left[s], pool - left[s], rest)
            pool -= left[s]
            rest -= n
            row.append(n)
        left = [a - b for a, b in zip(left, row)]
        out.append(row)
    return out


def shuffle_into_shards(rows: DataFrame, shards: int = 8, seed: int = 1) -> DataFrame:
    """rows with shard (0 to shards - 1) and slot (gapless from 0 in each shard), a uniform shuffle by `seed`.

    Keeps all columns; `shard` and `slot` are replaced, and names that begin with an underscore
    are this function's own. Shard sizes differ by one at most. Each row is shuffled by itself:
    null and repeated ids, equal texts and rows that agree in all columns go wherever the
    permutation takes them, so that copies of a text spread over the shards and no group of
    them meets in one task. With fewer rows than shards some shards stay empty; an empty table
    gives no rows. The same files, read in the same partitions, and the same seed give the same
    result.
    """
    spark = rows.sparkSession
    names = [c for c in rows.columns if c.lower() not in ("shard", "slot")]
    keyed = cut(rows.select(*names, F.xxhash64(F.lit(seed), F.monotonically_increasing_id(), *names).alias("_key")), "rows")
    total = keyed.count()
    blocks = max(shards, 4 * partitions(spark), -(-total // ORDERED))
    keyed = keyed.withColumn("_block", F.pmod(F.xxhash64(F.lit(seed + 1), "_key"), F.lit(blocks)).cast("int"))
    counts = dict(keyed.groupBy("_block").count().collect())  # a number for each block: `blocks` at most
    matrix = communication_matrix([counts.get(b, 0) for b in range(blocks)], shards, seed)
    ends = []
    for row in matrix:
        at, end = 0, []
        for n in row:
            at += n
            end.append(at)
        ends.append(end)
    dealt = spark.createDataFrame(list(enumerate(ends)), "_block int, _ends array<bigint>")  # blocks x shards numbers

    first = Window.partitionBy("_block").orderBy("_key", *names)
    sent = keyed.withColumn("_rank", F.row_number().over(first) - 1).join(F.broadcast(dealt), "_block")
    sent = sent.withColumn("shard", F.expr("size(filter(_ends, x -> x <= _rank))")).drop("_block", "_rank", "_ends")
    bits = 6 + (total // (shards * 64 * ORDERED)).bit_length()  # 64 parts of a shard, or more
    again = F.xxhash64(F.lit(seed + 2), "_key", "shard")
    sent = cut(sent.withColumn("_key", again).withColumn("_part", F.shiftright(F.col("_key"), 64 - bits).cast("int")), "sent")
    sizes = sent.groupBy("shard", "_part").count()
    before = Window.partitionBy("shard").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("shard", "_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))  # a row for each part of a shard
    second = Window.partitionBy("shard", "_part").orderBy("_key", *names)
    placed = sent.withColumn("_rank", F.row_number().over(second) - 1).join(F.broadcast(offsets), ["shard", "_part"])
    return placed.select(*names, "shard", (F.col("_before") + F.col("_rank")).alias("slot"))


def op4_sharding(spark, sf_dir: str) -> DataFrame:
    """All documents into shards 0 to 7 by the law `rows`."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = documents(spark, sf_dir).select(F.col("doc_id").cast("long").alias("doc_id"), (F.length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    return shuffle_into_shards(rows).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
