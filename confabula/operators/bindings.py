"""Which providers serve a model: requests of owners to bind and unbind, checked, applied in order, and answered.

mappings: (model_id, provider_id, owner_user_id, provider_model_name, priority, is_preferred, is_active, created_at, updated_at).
The owner is null for the system's own. A batch has the effect of its requests one after the other by request_id; each gets an
outcome. All work is by key: no request, and no model's mappings, are gathered in one place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .registry import bind_outcome

PAIR = ["model_id", "provider_id", "owner_user_id"]
MODEL = ["model_id", "owner_user_id"]


def _same(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """left joined with right, whose keys begin with an underscore; a null owner is one owner."""
    renamed = right.select(*[F.col(k).alias(f"_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    condition = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    joined = left.join(renamed, condition, how)
    return joined if how in ("left_semi", "left_anti", "full_outer") else joined.drop(*[f"_{k}" for k in keys])


def bind_owned(mappings: DataFrame, requests: DataFrame, models: DataFrame, providers: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(mappings after, outcome of each request). requests: (request_id, model_id, provider_id, user_id, provider_model_name,
    is_preferred, is_active); request_id is unique.

    Model and provider must be the user's, and the provider of the type that serves chats; else nothing changes. A new pair
    has priority 0. An inactive mapping is never preferred. A pair that becomes preferred takes that from all others of its
    model and owner, inactive ones too; a pair that was preferred before the batch, bound again by the model's first request,
    leaves them alone. Taking preference away by binding again promotes no other.
    """
    outcomes = bind_outcome(requests, models, providers, keep=["request_id", "provider_model_name", "is_preferred", "is_active"])
    wishes = outcomes.where("outcome = 'OK'").select(
        "request_id", "model_id", "provider_id", F.col("user_id").alias("owner_user_id"), F.col("provider_model_name").alias("_name"),
        (F.coalesce("is_preferred", F.lit(True)) & F.coalesce("is_active", F.lit(True))).alias("_preferred"), F.coalesce("is_active", F.lit(True)).alias("_active"),
    )
    before = mappings.where("is_preferred").select(*PAIR, F.lit(True).alias("_had"))
    first = wishes.groupBy(*MODEL).agg(F.min("request_id").alias("_first_at"))
    known = _same(_same(wishes, before, PAIR, "left"), first, MODEL, "left")
    clears = F.col("_preferred") & ~((F.col("request_id") == F.col("_first_at")) & F.coalesce("_had", F.lit(False)))
    cleared = known.where(clears).groupBy(*MODEL).agg(F.max("request_id").alias("_cleared_at"))
    last = known.groupBy(*PAIR).agg(F.max("request_id").alias("_at"), *[F.max_by(c, "request_id").alias(c) for c in ("_name", "_preferred", "_active")])
    both = _same(mappings, last, PAIR, "full_outer")
    asked, new = F.col("_at").isNotNull(), F.col("model_id").isNull()
    keys = [F.when(new, F.col(f"_{k}")).otherwise(F.col(k)).alias(k) for k in PAIR]
    rows = both.select(
        *keys,
        F.when(asked, F.col("_name")).otherwise(F.col("provider_model_name")).alias("provider_model_name"),
        F.when(new, F.lit(0)).otherwise(F.col("priority")).cast("long").alias("priority"),
        F.when(asked, F.col("_preferred")).otherwise(F.col("is_preferred")).alias("is_preferred"),
        F.when(asked, F.col("_active")).otherwise(F.col("is_active")).alias("is_active"),
        F.when(new, now).otherwise(F.col("created_at")).alias("created_at"),
        F.when(asked, now).otherwise(F.col("updated_at")).alias("updated_at"),
        "_at",
    )
    later = _same(rows, cleared, MODEL, "left")
    loses = F.col("is_preferred") & F.coalesce(F.col("_cleared_at").isNotNull() & (F.col("_at").isNull() | (F.col("_cleared_at") > F.col("_at"))), F.lit(False))
    out = later.select(
        *PAIR, "provider_model_name", "priority", (F.col("is_preferred") & ~loses).alias("is_preferred"), "is_active", "created_at", F.when(loses, now).otherwise(F.col("updated_at")).alias("updated_at")
    )
    return out, outcomes.select("request_id", "model_id", "provider_id", "user_id", "outcome")


def unbind_owned(mappings: DataFrame, requests: DataFrame, models: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(mappings after, outcome of each request). requests: (request_id, model_id, provider_id, user_id).

    MODEL_NOT_FOUND unless the model is the user's, MAPPING_NOT_FOUND for a pair that isn't there (any more). Where a preferred
    mapping went, the first active one left of that model and owner, by priority and age, is preferred.
    """
    owned = models.select(F.col("id").alias("model_id"), F.col("owner_user_id"), F.lit(True).alias("_model"))
    named = requests.select("request_id", "model_id", "provider_id", F.col("user_id").alias("owner_user_id"))
    pairs = mappings.select(*PAIR, F.lit(True).alias("_pair"))
    known = _same(_same(named, owned, MODEL, "left"), pairs, PAIR, "left")
    first = named.groupBy(*PAIR).agg(F.min("request_id").alias("_first_at"))
    outcome = F.when(F.col("_model").isNull(), "MODEL_NOT_FOUND").when(F.col("_pair").isNull() | (F.col("request_id") > F.col("_first_at")), "MAPPING_NOT_FOUND").otherwise("OK")
    outcomes = _same(known, first, PAIR, "left").withColumn("outcome", outcome)
    gone = outcomes.where("outcome = 'OK'").select(*PAIR)
    lost = _same(mappings.where("is_preferred"), gone, PAIR, "left_semi").select(*MODEL).distinct()
    left = _same(mappings, gone, PAIR, "left_anti")
    heirs = _same(left.where("is_active"), lost, MODEL, "left_semi").groupBy(*MODEL).agg(F.min(F.struct("priority", "created_at", "provider_id"))["provider_id"].alias("provider_id")).withColumn("_heir", F.lit(True))
    rows = _same(left, heirs, PAIR, "left")
    rises = F.coalesce("_heir", F.lit(False))
    out = rows.withColumn("is_preferred", F.col("is_preferred") | rises).withColumn("updated_at", F.when(rises, now).otherwise(F.col("updated_at"))).drop("_heir")
    return out.select(*mappings.columns), outcomes.select("request_id", "model_id", "provider_id", F.col("owner_user_id").alias("user_id"), "outcome")
