"""Skill bundles on disk: <root>/<skill_id>/<version>/SKILL.md and asset files, read by Spark's binary source or by the data
source of bundle_source.py, which gives the same rows and can be a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.frontmatter import as_json
from ..functions.text import asset_kind

_PATH = r"([^/]+)/([^/]+)/(.+)$"
_FRONT = r"(?s)^---[ \t]*\r?\n((?:.*?\n)??)[ \t]*---[ \t]*\r?(?:\n(.*))?$"
#: What a document's head says of its assets.
_DECLARED = "struct<path: string, kind: string, description: string>"
#: JSON of values that count as false.
_FALSE = ("false", "null", "0", "0.0", '""', "[]", "{}")


def files(spark: SparkSession, root: str) -> DataFrame:
    """skill_id, version, path, content of every file below root, by Spark's binary source."""
    read = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = F.lit(root.rstrip("/").split("/")[-1])
    below = F.regexp_replace("path", F.concat(F.lit("^.*/"), base, F.lit("/")), F.lit(""))
    return read.select(below.alias("below"), "content").select(
        F.regexp_extract("below", _PATH, 1).alias("skill_id"), F.regexp_extract("below", _PATH, 2).alias("version"), F.regexp_extract("below", _PATH, 3).alias("path"), "content"
    ).where("skill_id <> ''")


def front_matter(text: Column) -> Column:
    """The block between the first two --- lines; empty without a closed block."""
    return F.regexp_extract(text, _FRONT, 1)


def body(text: Column) -> Column:
    return F.when(text.rlike(_FRONT), F.regexp_extract(text, _FRONT, 2)).otherwise(text)


def field(meta: Column, key: str, kind: str = "string") -> Column:
    """A field of the head (a variant) as that type; null if it is absent or can't be of that type."""
    return F.try_variant_get(meta, f"$.{key}", kind)


def bundles(spark: SparkSession, root: str) -> DataFrame:
    return bundles_of(files(spark, root))


def bundles_of(found: DataFrame) -> DataFrame:
    """found: (skill_id, version, path, content). One row for each skill: its last version's document fields and its asset
    manifest in order of path. The directory's version counts; without frontmatter the fields have their defaults.

    Documents and files are each dealt out by skill once, then merged: a few bytes make many files, which Spark would broadcast by its
    estimate. A document is sorted by its skill and version only, and the assets of other versions aren't collected.
    """
    is_doc, skill = F.col("path") == "SKILL.md", Window.partitionBy("skill_id")
    docs = found.where(is_doc).select("skill_id", "version", F.col("content").cast("string").alias("skill_md"))
    docs = docs.withColumn("_n", F.row_number().over(skill.orderBy(F.desc("version")))).where("_n = 1")
    files = found.select("skill_id", "version", "path", F.octet_length("content").cast("long").alias("size_bytes"))
    files = files.withColumn("_last", F.max(F.when(is_doc, F.col("version"))).over(skill)).where((F.col("version") == F.col("_last")) & ~is_doc)
    asset = F.struct("path", F.concat_ws("/", F.lit("skills"), "skill_id", "version", "path").alias("object_key"), asset_kind(F.col("path")).alias("kind"), "size_bytes")
    assets = files.groupBy("skill_id").agg(F.array_sort(F.collect_list(asset)).alias("assets_manifest"))
    empty = F.expr("cast(array() as array<struct<path: string, object_key: string, kind: string, size_bytes: bigint>>)")
    docs = docs.join(assets.hint("merge"), "skill_id", "left").withColumn("assets_manifest", F.coalesce("assets_manifest", empty))
    docs = docs.withColumn("meta", F.parse_json(as_json(front_matter(F.col("skill_md")))))
    meta, text_of = F.col("meta"), lambda key: F.nullif(field(F.col("meta"), key), F.lit(""))
    return docs.select(
        "skill_id",
        "version",
        F.coalesce(text_of("display_name"), text_of("name"), F.col("skill_id")).alias("display_name"),
        F.coalesce(text_of("description"), F.lit("")).alias("description"),
        F.coalesce(~F.to_json(field(meta, "enabled", "variant")).isin(*_FALSE), F.lit(True)).alias("enabled"),
        F.coalesce(field(meta, "triggers", "array<string>"), F.expr("cast(array() as array<string>)")).alias("triggers"),
        F.coalesce(field(meta, "assets", f"array<{_DECLARED}>"), F.expr(f"cast(array() as array<{_DECLARED}>)")).alias("declared_assets"),
        "skill_md",
        "assets_manifest",
    )
