"""Models, providers and the mappings between them: listings, resolution, and constraint-checked changes.

Parquet tables take no UPDATE or MERGE, so a change is a function from tables to tables; changes that break a rule come
back as rows with an error instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import masked


def choice() -> list[Column]:
    return [F.desc("is_preferred"), F.asc("priority"), F.asc("created_at"), F.asc("provider_id")]


def in_scope(user: Column) -> Column:
    """Rows of the user, or the system's own for a null user; nulls compare as equal."""
    return (F.col("scope") == F.when(user.isNull(), "SYSTEM").otherwise("USER")) & F.col("owner_user_id").eqNullSafe(user)


def models_with_mappings(models: DataFrame, mappings: DataFrame) -> DataFrame:
    """Each model with its mappings as an array in listing order; empty, not null, without any."""
    rank = F.row_number().over(Window.partitionBy("model_id").orderBy(F.desc("is_active"), *choice()))
    one = F.struct(F.col("rank"), "provider_id", "is_active", "is_preferred", "priority")
    nested = mappings.withColumn("rank", rank).groupBy("model_id").agg(F.array_sort(F.collect_list(one)).alias("mappings"))
    joined = models.join(nested, models["id"] == nested["model_id"], "left").drop("model_id")
    return joined.withColumn("mappings", F.coalesce("mappings", F.expr("cast(array() as array<struct<rank: int, provider_id: bigint, is_active: boolean, is_preferred: boolean, priority: bigint>>)")))


def models_of_provider(models: DataFrame, mappings: DataFrame) -> DataFrame:
    """Each mapping with its model, in listing order of the provider; mappings without a model are left out."""
    order = F.row_number().over(Window.partitionBy("provider_id").orderBy(F.desc("is_active"), F.desc("is_preferred"), F.asc("priority"), F.asc("created_at"), F.asc("model_id")))
    named = models.select(F.col("id").alias("model_id"), "display_name", "vendor", F.col("is_active").alias("model_active"))
    return mappings.withColumn("place", order.cast("long")).join(named, "model_id")


def available_models(system: DataFrame, user: DataFrame, mappings: DataFrame, providers: DataFrame) -> DataFrame:
    """Active models of both sections with their mappings, and the provider's name for the user's own (null for the system's)."""
    one = mappings.select("model_id", "provider_id", F.col("is_preferred"))
    both = system.withColumn("section", F.lit("system")).unionByName(user.withColumn("section", F.lit("user"))).where("is_active")
    joined = both.select("section", F.col("id").alias("model_id"), "display_name").join(one, "model_id", "left")
    return joined.join(providers.select(F.col("id").alias("provider_id"), F.col("name").alias("p")), "provider_id", "left").select("section", "model_id", "display_name", "provider_id", F.when(F.col("section") == "user", F.col("p")).alias("provider_name"))


def resolve(models: DataFrame, mappings: DataFrame, providers: DataFrame) -> DataFrame:
    """The mapping and provider that serve each model, or why none does. An inactive provider is an error, not a reason to look on.

    The best mapping is chosen before providers are joined; filtering providers first would change the choice.
    """
    rank = F.row_number().over(Window.partitionBy("model_id").orderBy(*choice()))
    best = mappings.where("is_active").withColumn("rank", rank).where("rank = 1").select("model_id", "provider_id")
    named = providers.select(F.col("id").alias("provider_id"), "name", F.col("is_active").alias("provider_active"))
    own = models.select(F.col("id").alias("model_id"), "is_active").join(best, "model_id", "left").join(named, "provider_id", "left")
    error = (
        F.when(~F.col("is_active"), "MODEL_NOT_FOUND")
        .when(F.col("provider_id").isNull(), "MAPPING_NOT_FOUND")
        .when(F.col("provider_active").isNull(), "PROVIDER_NOT_FOUND")
        .when(~F.col("provider_active"), "PROVIDER_INACTIVE")
    )
    return own.select("model_id", F.when(error.isNull(), F.col("provider_id")).alias("provider_id"), F.when(error.isNull(), F.col("name")).alias("provider_name"), F.coalesce(error, F.lit("OK")).alias("status"))


def sparse_update(rows: DataFrame, changes: DataFrame, key: str, columns: list[str], now: Column, stamp: str = "updated_at") -> DataFrame:
    """changes: key, present (names of the columns set), and new values. A column that is present may be set to null."""
    new = changes.select(key, F.col("present"), *[F.col(c).alias(f"_{c}") for c in columns])
    joined = rows.join(new, key, "left")
    out = [F.when(F.array_contains("present", c), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.when(F.col("present").isNotNull(), now).otherwise(F.col(c)).alias(c) if c == stamp else F.col(c) for c in rows.columns]
    return joined.select(*out)


def insert_unique(rows: DataFrame, new: DataFrame, unique: list[str], order: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows with the new ones that break no uniqueness, the new ones that do). Among equal new ones the first by order is let in."""
    same = [F.col(f"n.{c}").eqNullSafe(F.col(f"o.{c}")) for c in unique]
    rank = F.row_number().over(Window.partitionBy(*unique).orderBy(*order))
    first = new.withColumn("_rank", rank)
    fresh = first.where("_rank = 1").drop("_rank").alias("n").join(rows.alias("o"), same, "left_anti")
    taken = first.where("_rank = 1").drop("_rank").alias("n").join(rows.alias("o"), same, "left_semi")
    return rows.unionByName(fresh, allowMissingColumns=True), taken.unionByName(first.where("_rank > 1").drop("_rank")).withColumn("error", F.lit("DUPLICATE"))


def bind(mappings: DataFrame, request: DataFrame, now: Column) -> DataFrame:
    """Upsert (model_id, provider_id, is_preferred, is_active) requests, at most one a pair.

    An inactive mapping is never preferred. A preferred one clears its model's other preferred mappings, inactive ones too.
    An existing row keeps priority and created_at; taking preference away by binding again promotes no other row.
    """
    wish = request.select("model_id", "provider_id", (F.col("is_preferred") & F.col("is_active")).alias("_preferred"), F.col("is_active").alias("_active"))
    joined = mappings.join(wish, ["model_id", "provider_id"], "full_outer")
    asked = F.col("_active").isNotNull()
    clears = F.max(F.coalesce(F.col("_preferred"), F.lit(False))).over(Window.partitionBy("model_id"))
    return joined.withColumn("_clears", clears).select(
        "model_id",
        "provider_id",
        F.coalesce("priority", F.lit(0)).cast("long").alias("priority"),
        F.when(asked, F.col("_preferred")).when(F.col("_clears"), F.lit(False)).otherwise(F.col("is_preferred")).alias("is_preferred"),
        F.when(asked, F.col("_active")).otherwise(F.col("is_active")).alias("is_active"),
        F.coalesce("created_at", now).alias("created_at"),
    )


def unbind(mappings: DataFrame, request: DataFrame) -> DataFrame:
    """Remove (model_id, provider_id) pairs; if the removed row was preferred, the first active one by (priority, created_at) takes over."""
    lost = mappings.join(request, ["model_id", "provider_id"], "left_semi").groupBy("model_id").agg(F.max("is_preferred").alias("_lost"))
    left = mappings.join(request, ["model_id", "provider_id"], "left_anti").join(lost, "model_id", "left")
    rank = F.row_number().over(Window.partitionBy("model_id", "is_active").orderBy("priority", "created_at", "provider_id"))
    promoted = F.coalesce("_lost", F.lit(False)) & F.col("is_active") & (F.col("_rank") == 1)
    return left.withColumn("_rank", rank).withColumn("is_preferred", F.col("is_preferred") | promoted).drop("_lost", "_rank")


def delete_providers(providers: DataFrame, request: DataFrame, mappings: DataFrame) -> DataFrame:
    """The outcome of each deletion: DELETED, PROVIDER_IN_USE while a mapping names it, or PROVIDER_NOT_FOUND."""
    used = mappings.select("provider_id").distinct().withColumn("_used", F.lit(True))
    there = providers.select(F.col("id").alias("provider_id")).withColumn("_there", F.lit(True))
    joined = request.join(there, "provider_id", "left").join(used, "provider_id", "left")
    return joined.select("provider_id", F.when(F.col("_there").isNull(), "PROVIDER_NOT_FOUND").when(F.col("_used"), "PROVIDER_IN_USE").otherwise("DELETED").alias("outcome"))


def delete_models(models: DataFrame, mappings: DataFrame, request: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(models left, mappings left): a model's mappings go with it. A request with a user_id counts only for that owner's models."""
    gone = request.select("model_id")
    if "user_id" in request.columns:
        owned = models.select(F.col("id").alias("model_id"), F.col("owner_user_id").alias("user_id"))
        gone = request.join(owned, request["model_id"].eqNullSafe(owned["model_id"]) & request["user_id"].eqNullSafe(owned["user_id"]), "left_semi").select("model_id")
    return models.join(gone.withColumnRenamed("model_id", "id"), "id", "left_anti"), mappings.join(gone, "model_id", "left_anti")


def preference_violations(mappings: DataFrame) -> DataFrame:
    """Models with more than one mapping that is both preferred and active."""
    return mappings.where("is_preferred AND is_active").groupBy("model_id").agg(F.count("*").alias("n_preferred")).where("n_preferred > 1")


def listed(rows: DataFrame, owner: str = "owner_user_id") -> DataFrame:
    """rank: each owner's rows, active first, then by last change."""
    order = Window.partitionBy(owner).orderBy(F.desc("is_active"), F.desc_nulls_last("updated_at"), F.asc("id"))
    return rows.withColumn("rank", F.row_number().over(order).cast("long"))


def fingerprint(key: Column) -> Column:
    """A digest that tells keys apart without storing them; null for no key."""
    return F.sha2(key.cast("binary"), 256)


def create_owned(rows: DataFrame, new: DataFrame, name: str, now: Column) -> tuple[DataFrame, DataFrame]:
    """Insert rows of a user (null: the system's): scope follows from the owner, rows are active, a name is taken once an owner.

    A column api_key gives api_key_fingerprint as well.
    """
    made = new.withColumn("scope", F.when(F.col("owner_user_id").isNull(), "SYSTEM").otherwise("USER")).withColumn("is_active", F.lit(True)).withColumn("created_at", now).withColumn("updated_at", now)
    if "api_key" in new.columns:
        made = made.withColumn("api_key_fingerprint", fingerprint(F.col("api_key")))
    return insert_unique(rows, made, ["scope", "owner_user_id", name], ["id"])


def update_providers(rows: DataFrame, changes: DataFrame, now: Column) -> DataFrame:
    """sparse_update of a provider's columns; a new key brings its fingerprint."""
    changes = changes.withColumn("present", F.when(F.array_contains("present", "api_key"), F.array_append("present", F.lit("api_key_fingerprint"))).otherwise(F.col("present")))
    return sparse_update(rows, changes.withColumn("api_key_fingerprint", fingerprint(F.col("api_key"))), "id", ["name", "api_base_url", "api_key", "type", "is_active", "api_key_fingerprint"], now)


def bind_outcome(requests: DataFrame, models: DataFrame, providers: DataFrame, kind: str = "OPENAI_COMPATIBLE_LLM", keep: list[str] = ()) -> DataFrame:
    """Whether each (model_id, provider_id, user_id) may be bound: both must be the user's, and the provider of that type. keep: further columns of the requests."""
    mine = models.select(F.col("id").alias("model_id"), F.col("owner_user_id").alias("_m"), F.lit(True).alias("_model"))
    theirs = providers.select(F.col("id").alias("provider_id"), F.col("owner_user_id").alias("_p"), F.col("type").alias("_type"), F.lit(True).alias("_provider"))
    joined = requests.join(mine, "model_id", "left").join(theirs, "provider_id", "left")
    owns = lambda c: F.col(c).eqNullSafe(F.col("user_id"))
    outcome = (
        F.when(F.col("_model").isNull() | ~owns("_m"), "MODEL_NOT_FOUND")
        .when(F.col("_provider").isNull() | ~owns("_p"), "PROVIDER_NOT_FOUND")
        .when(~F.col("_type").eqNullSafe(F.lit(kind)), "TYPE_UNSUPPORTED")
        .otherwise("OK")
    )
    return joined.select(*keep, "model_id", "provider_id", "user_id", outcome.alias("outcome"))


def provider_response(providers: DataFrame) -> DataFrame:
    """What clients see of a provider: no key, a mask instead."""
    return providers.select(F.col("id").cast("string").alias("id"), "name", masked(F.col("api_key")).alias("api_key_masked"), "is_active")


def mapping_response(mappings: DataFrame, providers: DataFrame) -> DataFrame:
    """What clients see of a mapping, with its provider's name where that is known."""
    named = providers.select(F.col("id").alias("provider_id"), F.col("name").alias("provider_name"))
    return mappings.join(named, "provider_id", "left").select(F.col("model_id").cast("string").alias("model_id"), F.col("provider_id").cast("string").alias("provider_id"), "provider_name", "is_preferred", "is_active", "priority")


def model_response(models: DataFrame) -> DataFrame:
    """What clients see of a model: limits that aren't set are null."""
    limit = lambda c: F.nullif(F.col(c), F.lit(0)).alias(c)
    return models.select(F.col("id").cast("string").alias("id"), "display_name", "vendor", "type", "billing_ratio", limit("context_window_tokens"), limit("max_output_tokens"), "is_active")
