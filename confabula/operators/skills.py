"""Skill matching by trigger words, and which tools a request may see."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.automaton import most_hit
from ..settings import DEFAULTS
from .tools import overlay

META = ["skill_id", "display_name", "enabled"]


def skill_meta(skills: DataFrame) -> DataFrame:
    return skills.where("enabled").select(META)


def match(queries: DataFrame, skills: DataFrame, key: str, text: str, k: int = DEFAULTS.skills_a_turn) -> DataFrame:
    """The k skills with most trigger hits for each query; a trigger listed twice counts twice, an empty one never.

    The catalogue's triggers become an automaton (several beyond its size, each with whole skills), which finds those in a text in one
    pass over it; where a key has one text, its hits are summed there and only the best k leave the task.
    """
    listed = skills.where("enabled").select("skill_id", F.explode("triggers").alias("trigger")).where("trigger <> ''")
    weights = listed.groupBy(F.col("skill_id").alias("owner"), F.lower("trigger").alias("pattern")).agg(F.count("*").alias("times"))
    hits = most_hit(queries.select(key, F.lower(text).alias("_low")), weights, key, "_low", max(1, k)).withColumnRenamed("owner", "skill_id")
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("hits"), F.asc("skill_id")))
    return hits.withColumn("rank", rank.cast("long")).where(F.col("rank") <= max(1, k)).select(key, "skill_id", "hits", "rank")


def exposure(matches: DataFrame, key: str) -> DataFrame:
    """Requests with a matching skill: the tools this exposes, and the skills they may load."""
    tools = F.array(F.lit("load_skill"), F.lit("load_skill_asset"))
    return matches.groupBy(key).agg(F.array_sort(F.collect_set("skill_id")).alias("allowed_skills")).withColumn("expose", tools)


def visible_tools(tools: DataFrame, scopes: DataFrame, extra: DataFrame | None = None) -> DataFrame:
    """tools: (tool, default_visible); scopes: (scope_id, expose, allow, deny), arrays of names, allow may be null.

    A tool that is hidden by default is visible if it is exposed, whatever allow and deny say; a tool that is visible by default
    must be allowed (if there is a list) and not denied, exposed or not. extra: tools found at run time; they replace those of
    the same name before anything is filtered. A registry's names are two arrays in one row, so scopes aren't joined with tools.
    """
    known = overlay(tools, extra, "tool") if extra is not None else tools
    sides = known.agg(F.collect_set(F.when(F.col("default_visible"), F.col("tool"))).alias("shown"), F.collect_set(F.when(~F.col("default_visible"), F.col("tool"))).alias("hidden"))
    none = F.expr("cast(array() as array<string>)")
    rows = scopes.withColumns({"_shown": sides.select("shown").scalar(), "_hidden": sides.select("hidden").scalar()})
    allowed = F.when(F.col("allow").isNull(), F.col("_shown")).otherwise(F.array_intersect("_shown", "allow"))
    seen = F.concat(F.array_except(allowed, F.coalesce("deny", none)), F.array_intersect("_hidden", F.coalesce("expose", none)))
    return rows.select("scope_id", F.explode(seen).alias("tool"))


def rendered_skill(name: Column, body: Column, manifest: Column) -> Column:
    """Header, body without trailing blanks, and a line for each asset, if there are any."""
    lines = F.transform(manifest, lambda a: F.concat(F.lit("- "), a["path"], F.lit(" ("), a["kind"], F.lit(", "), a["size_bytes"].cast("string"), F.lit(" bytes)")))
    return F.concat_ws("\n", F.concat(F.lit("# "), name), F.regexp_replace(body, r"\s+$", ""), F.when(F.size(manifest) > 0, F.array_join(lines, "\n")))
