"""A change log as a stream: kept up to date as the last change of each key, and counted by time window."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def changes(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """New files of a log as they arrive. path may be one file."""
    folder, _, name = path.rpartition("/")
    return spark.readStream.schema(like.schema).option("pathGlobFilter", name).parquet(folder)


def last_changes(stream: DataFrame, key: str, seq: str) -> DataFrame:
    """The last change of each key so far; state holds one row a key."""
    rest = [c for c in stream.columns if c != key]
    return stream.groupBy(key).agg(F.max_by(F.struct(*rest), seq).alias("last")).select(key, "last.*")


def counts_by_window(stream: DataFrame, ts: str, key: str, width: str = "1 second", late: str = "10 seconds") -> DataFrame:
    return stream.withWatermark(ts, late).groupBy(F.window(ts, width), key).agg(F.count("*").alias("n"))


def run_once(result: DataFrame, name: str, mode: str, checkpoint: str) -> DataFrame:
    """Runs a stream over what has arrived, into a table of that name."""
    query = result.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return result.sparkSession.table(name)
