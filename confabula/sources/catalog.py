"""Chat-domain tables, and how the star-schema test tables stand in for them.

Each function gives a lazy, column-pruned DataFrame. Only the adapters know the physical names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """session_id, pos, role, content, token_count; pos orders a session and is unique in it."""
    return messages_of(table(spark, sf_dir, "conversations"))


def messages_of(conversations: DataFrame) -> DataFrame:
    return conversations.select(
        F.col("conv_id").alias("session_id"), F.col("turn").alias("pos"), "role", F.col("text").alias("content"), F.expr("cast(length(text) div 4 as bigint)").alias("token_count")
    )


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    pinned = F.col("o_orderpriority") == "1-URGENT"
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.col("o_custkey").alias("user_id"),
        F.concat(F.lit("Chat "), F.col("o_orderkey").cast("string")).alias("title"),
        pinned.alias("is_pinned"),
        F.when(pinned, F.col("o_orderdate")).alias("pinned_at"),
        F.col("o_orderdate").alias("updated_at"),
        F.lit(None).cast("string").alias("current_summary"),
    )


def models(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size")
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"),
        F.col("p_name").alias("display_name"),
        F.col("p_brand").alias("vendor"),
        (size % 4).cast("int").alias("type"),
        (1 + size % 3).cast("int").alias("billing_ratio"),
        ((size % 7) * 1000).cast("int").alias("context_window_tokens"),
        ((size % 5) * 512).cast("int").alias("max_output_tokens"),
        (F.col("p_type") != "ECONOMY").alias("is_active"),
    )


def providers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.concat(F.lit("key-"), F.col("s_suppkey").cast("string")).alias("api_key"), (F.col("s_acctbal") >= 0).alias("is_active")
    )


def mappings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each (model_id, provider_id): the earliest line of the pair.

    The line's order (day, order, number, flags) is one decimal number of 36 digits, as its minimum can be aggregated by
    hashing, which that of a struct can't.
    """
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_shipdate", "l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus")
    digits = lambda x, n: F.lpad(x.cast("string"), n, "0")
    order = F.concat(digits(F.unix_date(F.col("l_shipdate").cast("date")), 6), digits(F.col("l_orderkey"), 18), digits(F.col("l_linenumber"), 6), digits(F.ascii("l_returnflag"), 3), digits(F.ascii("l_linestatus"), 3))
    first = lines.groupBy("l_partkey", "l_suppkey").agg(F.min(order.cast("decimal(36,0)")).alias("x")).withColumn("x", digits(F.col("x"), 36))
    part = lambda at, n: F.substring("x", at, n).cast("int")
    return first.select(
        F.col("l_partkey").alias("model_id"),
        F.col("l_suppkey").alias("provider_id"),
        part(25, 6).cast("long").alias("priority"),
        (part(31, 3) == ord("A")).alias("is_preferred"),
        (part(34, 3) == ord("O")).alias("is_active"),
        F.date_from_unix_date(part(1, 6)).cast("timestamp_ntz").alias("created_at"),
    )


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


def memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("user_id"), "embedding")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A synthetic delta stream: every assistant message comes as words, preceded by its first word as reasoning."""
    said = table(spark, sf_dir, "conversations").where("role = 'assistant'")
    words = said.select((F.col("conv_id") * 1000 + F.col("turn")).alias("message_id"), F.posexplode(F.split("text", " ")).alias("i", "word"))
    return words.select(
        "message_id",
        (F.col("i") % 2 + 1).cast("int").alias("step"),
        F.col("i").cast("long").alias("seq"),
        F.when(F.col("i") < 2, F.col("word")).alias("reasoning"),
        F.when(F.col("i") >= 2, F.col("word")).alias("content"),
    )


CALLS = "array<struct<id: string, name: string, arguments: string>>"


def rich_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages with reasoning, tool calls and tool rows: every second assistant row first calls two tools, of which the first
    answers twice and the second never, and then gives its text."""
    said = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session_id"), "turn", "role", "text")
    calls = F.expr(f"if(role = 'assistant' AND turn % 2 = 0, array(named_struct('id', concat('c', turn, 'a'), 'name', 'search', 'arguments', '{{\"k\": 1}}'), named_struct('id', concat('c', turn, 'b'), 'name', 'load', 'arguments', 'oops')), cast(null as {CALLS}))")
    more = F.expr("if(role = 'assistant' AND turn % 2 = 0, array(0, 1, 2, 3), array(0))")
    rows = said.withColumn("calls", calls).withColumn("k", F.explode(more))
    called = F.col("calls").isNotNull()
    tool = called & F.col("k").isin(1, 2)
    return rows.select(
        "session_id",
        (F.col("turn") * 10 + F.col("k")).alias("pos"),
        F.when(tool, "tool").otherwise(F.col("role")).alias("role"),
        F.when(called & (F.col("k") == 0), F.lit(None)).when(called & (F.col("k") == 1), "old").when(tool, F.left("text", F.lit(5))).otherwise(F.col("text")).alias("content"),
        F.expr("if(role = 'assistant' AND turn % 4 = 0 AND k = 0, concat('r', turn), cast(null as string))").alias("reasoning_content"),
        F.when(F.col("k") == 0, F.col("calls")).alias("tool_calls"),
        F.when(tool, F.concat(F.lit("c"), F.col("turn").cast("string"), F.lit("a"))).alias("tool_call_id"),
        F.when(tool, "search").alias("name"),
        F.when(tool & (F.col("k") == 1), "").when(tool & (F.col("turn") % 4 == 0), "gone").alias("persisted_output_placeholder"),
        F.expr("timestampadd(MINUTE, cast(turn as int), timestamp_ntz'2024-01-01 00:00:00')").alias("created_at"),
    )


def bundle_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of skill bundles, as bundles.files() reads them: every part is a skill of one or two versions with up to two assets;
    some documents have no frontmatter, or one that isn't closed."""
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"))
    parts = parts.repartition("k")  # few bytes of parts make many of files, which shall not all be made where the parts are read
    versions = parts.withColumn("v", F.explode(F.expr("if(k % 2 = 0, array('1.0', '1.1'), array('1.0'))")))
    document = F.expr(
        "if(k % 7 = 0, concat('Body of ', name), concat('---\\nskill_id: s', k, '\\ndisplay_name: \"', name, '\"\\ndescription: ', brand, '\\nversion: 0.0\\nenabled: ', if(k % 5 = 0, 'False', 'true'), '\\ntriggers:\\n  - ', name, '\\n  - t', k, '\\n', if(k % 11 = 0, '', '---\\n'), 'Text ', v, '\\n'))"
    )
    files = F.array(F.struct(F.lit("SKILL.md").alias("path"), document.alias("body")), F.struct(F.lit("references/b.md").alias("path"), F.col("name").alias("body")), F.struct(F.lit("scripts/a.py").alias("path"), F.lit("x").alias("body")))
    some = versions.select(F.concat(F.lit("s"), F.col("k").cast("string")).alias("skill_id"), F.col("v").alias("version"), "k", F.explode(files).alias("f"))
    kept = some.where("f.path = 'SKILL.md' OR k % 3 = 0 OR (k % 3 = 1 AND f.path LIKE 'ref%')")
    return kept.select("skill_id", "version", "f.path", F.col("f.body").cast("binary").alias("content"))


#: A small skill catalogue in the shape of the domain: id, name, enabled, triggers.
SKILLS = (
    ("the-helper", "The helper", True, ("the", "of the", "und")),
    ("line-doctor", "Line doctor", True, ("line", "que", "")),
    ("german-guide", "German guide", True, ("der", "ung", "der")),
    ("retired", "Retired", False, ("the", "a")),
)


def skills(spark: SparkSession) -> DataFrame:
    """skill_id, display_name, enabled, triggers: as many rows as SKILLS has."""
    rows = ", ".join(f"('{i}', '{n}', {str(e).lower()}, array({', '.join(repr(t) for t in ts)}))" for i, n, e, ts in SKILLS)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(skill_id, display_name, enabled, triggers)")


def newest_first(key: str, *order: str) -> Window:
    return Window.partitionBy(key).orderBy(*[F.desc(c) for c in order])
