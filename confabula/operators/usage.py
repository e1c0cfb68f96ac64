"""Token-usage ledgers and billing rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def turn_usage(messages: DataFrame, keys: list[str]) -> DataFrame:
    """usage_tokens for each turn: null counts are 0; turns that used nothing are left out."""
    return messages.groupBy(*keys).agg(F.sum(F.coalesce("token_count", F.lit(0))).alias("usage_tokens")).where("usage_tokens > 0")


def billed(usage: DataFrame) -> DataFrame:
    """billable_tokens: usage times the model's ratio for the system's models, nothing for a user's own."""
    return usage.withColumn("billable_tokens", F.when(F.col("scope") == "SYSTEM", F.col("usage_tokens") * F.col("billing_ratio")).otherwise(0).cast("long"))


def ledger(usage: DataFrame, keys: str | list[str] = "provider_id") -> DataFrame:
    """Counters of each provider (and owner, if that is a key); negative amounts count as 0 and rows where both are 0 do nothing."""
    keys = [keys] if isinstance(keys, str) else keys
    positive = usage.select(*keys, F.greatest("usage_tokens", F.lit(0)).alias("u"), F.greatest("billable_tokens", F.lit(0)).alias("b")).where("u > 0 OR b > 0")
    return positive.groupBy(*keys).agg(F.sum("u").alias("usage_tokens"), F.sum("b").alias("billable_usage_tokens"))


def add_to_ledger(counters: DataFrame, delta: DataFrame, key: str = "provider_id", owner: str = "owner_user_id") -> tuple[DataFrame, DataFrame]:
    """The counters with the amounts added, and the amounts that name no provider of that owner (null: the system), with an error."""
    there = counters.select(F.col(key).alias("_key"), F.col(owner).alias("_owner"))
    new = delta.select(F.col(key).alias("_key"), F.col(owner).alias("_owner"), F.col("usage_tokens").alias("_u"), F.col("billable_usage_tokens").alias("_b"))
    same = (F.col(key) == F.col("_key")) & F.col(owner).eqNullSafe(F.col("_owner"))
    own = counters.join(new, same, "left")
    added = own.select(key, owner, (F.col("usage_tokens") + F.coalesce("_u", F.lit(0))).alias("usage_tokens"), (F.col("billable_usage_tokens") + F.coalesce("_b", F.lit(0))).alias("billable_usage_tokens"))
    refused = delta.join(there, same, "left_anti").select(key, owner, "usage_tokens", "billable_usage_tokens", F.lit("PROVIDER_NOT_FOUND").alias("error"))
    return added, refused


def billing_events(usage: DataFrame, time: Column) -> DataFrame:
    """One row for each system-scope turn with usage, in the wire schema; the group is never known."""
    return usage.where("scope = 'SYSTEM' AND usage_tokens > 0").select(
        F.col("user_id").cast("string").alias("userId"),
        F.lit(None).cast("string").alias("groupId"),
        F.col("usage_tokens").cast("long").alias("usageTokens"),
        F.col("billing_ratio").cast("long").alias("billingRatio"),
        F.col("trace_id").cast("string").alias("traceId"),
        F.col("model_name").alias("modelName"),
        F.col("model_type").cast("long").alias("modelType"),
        F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss").alias("requestTime"),
    )
