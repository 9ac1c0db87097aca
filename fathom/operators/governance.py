"""Usage and quotas of tenants, storage tiers by age, and placement of shards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Days after which an object moves on.
HOT_DAYS, WARM_DAYS, COLD_DAYS = 1, 30, 365


def usage(rows: DataFrame, tenant: str, size: Column) -> DataFrame:
    return rows.groupBy(F.col(tenant).alias("tenant")).agg(F.count("*").alias("n_documents"), F.sum(size).cast("long").alias("n_bytes"))


def violations(used: DataFrame, max_bytes: int) -> DataFrame:
    return used.where(F.col("n_bytes") > max_bytes).select("tenant", "n_bytes", (F.col("n_bytes") - max_bytes).alias("over"))


def over_quota(used: DataFrame, quotas: DataFrame) -> DataFrame:
    """(tenant, quota, used, most) of every limit that a tenant exceeds: quotas is tenant and columns max_X, used has X for each; null limits and tenants without a row are free."""
    limits = [c for c in quotas.columns if c.startswith("max_")]
    one = F.explode(F.array(*(F.struct(F.lit(c[4:]).alias("quota"), F.col(c[4:]).cast("long").alias("used"), F.col(c).cast("long").alias("most")) for c in limits))).alias("limit")
    return used.join(quotas, "tenant").select("tenant", one).select("tenant", "limit.*").where(F.col("used") > F.col("most"))


def requests_by_second(log: DataFrame, ts: str, tenant: str, most: int) -> DataFrame:
    """Requests of each tenant in each second, and how many of them are over the limit."""
    counted = log.groupBy(F.col(tenant).alias("tenant"), F.date_trunc("second", ts).alias("second")).agg(F.count("*").alias("n"))
    return counted.withColumn("rejected", F.greatest(F.lit(0), F.col("n") - most))


def next_tier(tier: Column, age_days: Column) -> Column:
    """Where an object lies after one run of the policy: one step at most."""
    return (
        F.when((tier == "hot") & (age_days > HOT_DAYS), "warm").when((tier == "warm") & (age_days > WARM_DAYS), "cold")
        .when((tier == "cold") & (age_days > COLD_DAYS), "deleted").otherwise(tier)
    )


def placements(shards: DataFrame, nodes: int, replication: int) -> DataFrame:
    """(shard, node, role): the primary on node shard mod nodes, replicas on those after it."""
    copies = F.explode(F.sequence(F.lit(0), F.lit(min(replication, nodes) - 1))).alias("copy")
    return shards.select("shard", copies).select("shard", F.pmod(F.col("shard") + F.col("copy"), F.lit(nodes)).cast("long").alias("node"), F.when(F.col("copy") == 0, "primary").otherwise("replica").alias("role"))


def routes(placed: DataFrame, prefer: str = "followers") -> DataFrame:
    """(shard, node) that a read goes to: the primary, or the first replica where there is one."""
    first = F.min_by("node", "copy") if prefer == "primary" else F.coalesce(F.min_by("node", F.when(F.col("copy") > 0, F.col("copy"))), F.min_by("node", "copy"))
    return placed.groupBy("shard").agg(first.alias("node"))
