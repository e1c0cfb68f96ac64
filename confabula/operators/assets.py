"""Skill bundles and their assets: upsert, lookup, checked loading, and the local cache of objects.

Skills have an asset manifest (path, object_key, kind, size_bytes); objects are (object_key, content) tables. Requests that
can't be served come back as rows with an outcome, all in one pass of equi-joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import cache_key, safe_path, safe_segment, truncate, utf8_or_null
from ..settings import DEFAULTS
from .skills import rendered_skill


def object_key(skill: Column, version: Column, path: Column) -> Column:
    return F.concat_ws("/", F.lit("skills"), skill, version, path)


def upsert_skills(current: DataFrame, bundles: DataFrame, now: Column) -> DataFrame:
    """current: the bundles' columns, created_at and updated_at. A skill that comes again is replaced and keeps created_at."""
    columns = [c for c in current.columns if c not in ("skill_id", "created_at", "updated_at")]
    new = bundles.select("skill_id", *[F.col(c).alias(f"_{c}") for c in columns], F.lit(True).alias("_new"))
    joined = current.join(new, "skill_id", "full_outer")
    return joined.select(
        "skill_id",
        *[F.when(F.col("_new"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in columns],
        F.coalesce("created_at", now).alias("created_at"),
        F.when(F.col("_new"), now).otherwise(F.col("updated_at")).alias("updated_at"),
    ).select(current.columns)


def fetched(requests: DataFrame, local: DataFrame, remote: DataFrame) -> DataFrame:
    """requests: object_key and more. content from the local table, else the remote one; place tells which, or MISSING."""
    near = local.select("object_key", F.col("content").alias("_near"))
    far = remote.select("object_key", F.col("content").alias("_far"))
    joined = requests.join(near, "object_key", "left").join(far, "object_key", "left")
    place = F.when(F.col("_near").isNotNull(), "LOCAL").when(F.col("_far").isNotNull(), "REMOTE").otherwise("MISSING")
    return joined.withColumn("content", F.coalesce("_near", "_far")).withColumn("place", place).drop("_near", "_far")


def addressed(requests: DataFrame, objects: DataFrame) -> DataFrame:
    """requests: (skill_id, version, path) and more. The content under the key they make; null where a part isn't safe or nothing is there."""
    safe = safe_segment(F.col("skill_id")) & safe_segment(F.col("version")) & safe_path(F.col("path"))
    keyed = requests.withColumn("object_key", F.when(safe, object_key(F.col("skill_id"), F.col("version"), F.col("path"))))
    return keyed.join(objects.select("object_key", "content"), "object_key", "left").withColumn("cache_key", cache_key(F.col("object_key")))


def live_entries(cache: DataFrame, now: Column, ttl: str) -> DataFrame:
    """Cache entries that were read within the time to live."""
    return cache.where(F.col("last_access") >= now - F.expr(ttl))


def _apart(key: Column, request: str) -> Column:
    """The key; without one, a key that no other request has (and nothing that is looked for: it begins with a blank), so that these rows are dealt out too."""
    return F.coalesce(key, F.concat(F.lit(" "), F.col(request).cast("string")))


def load_skills(requests: DataFrame, skills: DataFrame) -> DataFrame:
    """requests: (request_id, skill_id, allowed: array). The rendered skill, whether it is enabled or not, or why there is none.

    Catalogue and requests are merged by skill, whatever the catalogue's size seems to be; a request that may not load one meets none.
    """
    asked = requests.withColumn("skill_id", F.trim(F.coalesce("skill_id", F.lit(""))))
    known = skills.select(F.col("skill_id").alias("_key"), "display_name", "skill_md", "assets_manifest", F.lit(True).alias("_known"))
    allowed = F.coalesce(F.array_contains("allowed", F.col("skill_id")), F.lit(False))
    refused = F.when(F.col("skill_id") == "", "MISSING_SKILL_ID").when(~allowed, "DENIED")
    asked = asked.select("request_id", "skill_id", refused.alias("_refused")).withColumn("_key", _apart(F.when(F.col("_refused").isNull(), F.col("skill_id")), "request_id"))
    joined = asked.join(known.hint("merge"), "_key", "left")
    outcome = F.when(F.col("_refused").isNotNull(), F.col("_refused")).when(F.col("_known").isNull(), "SKILL_NOT_FOUND").otherwise("OK")
    text = rendered_skill(F.col("display_name"), F.col("skill_md"), F.col("assets_manifest"))
    return joined.select("request_id", "skill_id", outcome.alias("outcome"), F.when(outcome == "OK", text).alias("output"))


def load_assets(requests: DataFrame, skills: DataFrame, objects: DataFrame, characters: int = DEFAULTS.result_characters) -> DataFrame:
    """requests: (request_id, skill_id, path). The asset's text, cut at the character limit, or why there is none.

    Only paths that the manifest declares are looked for, under the object key declared; what isn't UTF-8 isn't text.
    """
    asked = requests.select("request_id", F.trim(F.coalesce("skill_id", F.lit(""))).alias("skill_id"), F.trim(F.coalesce("path", F.lit(""))).alias("path"))
    asked = asked.withColumn("_key", _apart(F.when((F.col("skill_id") != "") & (F.col("path") != ""), F.col("skill_id")), "request_id"))
    known = skills.select(F.col("skill_id").alias("_key"), F.lit(True).alias("_known"))
    declared = skills.select(F.col("skill_id").alias("_key"), F.explode("assets_manifest").alias("_a")).select("_key", F.col("_a.path").alias("path"), F.col("_a.object_key").alias("object_key"), F.lit(True).alias("_declared"))
    stored = objects.select(F.col("object_key").alias("_stored"), "content")
    joined = asked.join(known.hint("merge"), "_key", "left").join(declared.hint("merge"), ["_key", "path"], "left")
    joined = joined.withColumn("_stored", _apart(F.col("object_key"), "request_id")).join(stored.hint("merge"), "_stored", "left")
    text = utf8_or_null(F.col("content"))
    outcome = (
        F.when((F.col("skill_id") == "") | (F.col("path") == ""), "MISSING_INPUT")
        .when(F.col("_known").isNull(), "SKILL_NOT_FOUND")
        .when(F.col("_declared").isNull(), "NOT_DECLARED")
        .when(F.coalesce("object_key", F.lit("")) == "", "NO_OBJECT_KEY")
        .when(F.col("content").isNull(), "READ_FAILED")
        .when(text.isNull(), "NOT_TEXT")
        .otherwise("OK")
    )
    shown = F.concat(F.lit("# "), F.col("skill_id"), F.lit(" "), F.col("path"), F.lit("\n"), truncate(text, characters), F.lit("\n# end"))
    return joined.select("request_id", "skill_id", "path", outcome.alias("outcome"), F.when(outcome == "OK", shown).alias("output"))
