"""Tool calls: argument parsing and checks, dispatch results, retries, instance choice, access rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import parsed_object

#: JSON type name -> what a value's own schema must look like; a type that isn't named here passes.
TYPES = {"string": "STRING", "integer": "BIGINT", "number": "BIGINT|DOUBLE|DECIMAL.*", "boolean": "BOOLEAN", "object": "OBJECT.*", "array": "ARRAY.*"}


def parse_calls(fragments: DataFrame) -> DataFrame:
    """fragments: (message_id, seq, index, id, name, arguments). One row a call: names and arguments joined, the last id kept.

    Arguments that aren't a JSON object become an empty map.
    """
    ordered = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", F.coalesce(c, F.lit("")).alias("x")))), lambda s: s["x"]), "")
    last_id = F.max_by(F.when(F.col("id") != "", F.col("id")), F.when(F.coalesce("id", F.lit("")) != "", F.col("seq")))
    calls = fragments.groupBy("message_id", "index").agg(last_id.alias("id"), ordered("name").alias("name"), ordered("arguments").alias("raw"))
    return calls.withColumn("arguments", parsed_object(F.col("raw")))


def check_arguments(calls: DataFrame, json: str, required: list[str], types: dict[str, str], closed: bool) -> DataFrame:
    """error: the first rule that the JSON object breaks, or null. A boolean is no integer; unknown type names pass."""
    value = F.try_parse_json(json)
    names = F.json_object_keys(json)
    kind = lambda k: F.schema_of_variant(F.try_variant_get(value, f"$.{k}", "variant"))
    error = F.when(value.isNull() | ~F.schema_of_variant(value).startswith("OBJECT"), "NOT_AN_OBJECT")
    for k in required:
        error = error.when(~F.coalesce(F.array_contains(names, k), F.lit(False)), f"MISSING:{k}")
    if closed:
        error = error.when(F.size(F.array_except(names, F.array(*map(F.lit, types)))) > 0, "UNKNOWN_ARGUMENT")
    for k, t in types.items():
        if t in TYPES:
            error = error.when(F.array_contains(names, k) & ~kind(k).rlike(f"^({TYPES[t]})$"), f"TYPE:{k}")
    return calls.withColumn("error", error)


def run_results(calls: DataFrame, tools: DataFrame, outputs: DataFrame) -> DataFrame:
    """Each call with its outcome, in the order of the calls (index): unknown tools, missing context, errors and calls that took
    longer than their tool may become results with an error.

    calls: (message_id, index, id, name, context); tools: (name, required_context, persist, timeout_seconds); outputs: (id,
    output, error, seconds). A tool whose output isn't kept has a placeholder, its own one or a fixed text.
    """
    joined = calls.join(tools.withColumn("_known", F.lit(True)), "name", "left").join(outputs, "id", "left")
    missing = ~F.coalesce(F.forall("required_context", lambda k: F.array_contains("context", k)), F.lit(False))
    error = (
        F.when(F.col("_known").isNull(), F.concat(F.lit("Tool unavailable: "), "name"))
        .when(missing, "Missing context")
        .when(F.col("seconds") > F.col("timeout_seconds"), "Timeout")
        .when(F.col("error").isNotNull(), F.col("error"))
    )
    own = F.col("placeholder") if "placeholder" in outputs.columns else F.lit(None).cast("string")
    placeholder = F.when(~F.coalesce("persist", F.lit(True)), F.coalesce(own, F.lit("[output not kept]")))
    return joined.select("message_id", "index", "id", "name", F.when(error.isNull(), F.col("output")).alias("output"), error.alias("error"), placeholder.alias("placeholder"))


def elapsed(log: DataFrame) -> DataFrame:
    """log: (id, ts). When each call began and ended, and the seconds between."""
    own = log.groupBy("id").agg(F.min("ts").alias("started"), F.max("ts").alias("finished"))
    return own.withColumn("seconds", (F.col("finished").cast("timestamp").cast("double") - F.col("started").cast("timestamp").cast("double")))


def overlay(base: DataFrame, extra: DataFrame, key: str) -> DataFrame:
    """Rows of both by key; those of extra win."""
    return base.join(extra.select(key), key, "left_anti").unionByName(extra)


def _met(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """A join by the columns on, of which nulls meet nulls."""
    other = right.withColumnsRenamed({c: f"_other_{c}" for c in on})
    both = [F.col(c).eqNullSafe(F.col(f"_other_{c}")) for c in on]
    return left.join(other, both, how).drop(*[f"_other_{c}" for c in on])


def usable(instances: DataFrame) -> DataFrame:
    """instances: (service, instance, developer, healthy, enabled); missing flags mean usable. Distinct (service, tag, instance)."""
    return instances.where("instance IS NOT NULL AND coalesce(healthy, true) AND coalesce(enabled, true)").select("service", F.col("developer").alias("tag"), "instance").distinct()


def pools(known: DataFrame, requests: DataFrame) -> DataFrame:
    """known: from usable(). requests: (request_id, service, developer).

    (request_id, service, tag, n): a tagged request gets its developer's instances if there are any, else those without a tag
    (tag is null); n is their number. Neither instances nor arrays of them are joined with requests, only their numbers.
    """
    sizes = known.groupBy("service", "tag").agg(F.count("*").alias("n"))
    own = sizes.where("tag IS NOT NULL").select("service", F.col("tag").alias("developer"), F.col("n").alias("_own"))
    base = sizes.where("tag IS NULL").select("service", F.col("n").alias("_base"))
    joined = requests.join(own, ["service", "developer"], "left").join(base, "service", "left")
    return joined.select("request_id", "service", F.when(F.col("_own").isNotNull(), F.col("developer")).alias("tag"), F.coalesce("_own", "_base").alias("n")).where("n IS NOT NULL")


def gray_pool(instances: DataFrame, requests: DataFrame, side: int = 4096) -> DataFrame:
    """pools() with a row for each instance: (request_id, service, instance).

    The result is as large as requests times instances. Both sides of a service and tag are cut into blocks of about side rows, so
    a pair of blocks is about side * side rows; pairs are dealt out to as many tasks as there are, whatever the service.
    """
    key = ["service", "_tag"]
    boxed = lambda rows: rows.withColumn("_tag", F.struct("tag"))  # noqa: E731  nulls meet nulls in it, and it keeps the partitioning below
    known = usable(instances)
    pool = boxed(pools(known, requests))
    shares = lambda n: F.ceil(n / F.lit(side)).cast("int")
    sizes = pool.groupBy(key).agg(shares(F.max("n")).alias("_rows"), shares(F.count("*")).alias("_columns"))
    tasks = sizes.agg(F.sum(F.col("_rows").cast("long") * F.col("_columns"))).first()[0] or 1
    block = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = boxed(known).join(sizes, key).select(*key, block("instance", "_rows").alias("_row"), every("_columns").alias("_column"), "instance")
    blocks = left.groupBy(*key, "_row", "_column").agg(F.collect_list("instance").alias("_block"))
    right = pool.join(sizes, key).select("request_id", *key, block("request_id", "_columns").alias("_column"), every("_rows").alias("_row"))
    # as many tasks as pairs of blocks: the shuffle carries little, so its size says nothing of the work
    right = right.repartition(min(tasks, 1 << 15), *key, "_row", "_column")
    return right.join(blocks.hint("merge"), [*key, "_row", "_column"]).select("request_id", "service", F.explode("_block").alias("instance"))


def _placed(known: DataFrame) -> DataFrame:
    """place: an instance's number in order, from 0, in its service and tag."""
    return known.withColumn("place", F.row_number().over(Window.partitionBy("service", "tag").orderBy("instance")).cast("long") - 1)


def without_tried(pool: DataFrame, known: DataFrame, tried: DataFrame) -> DataFrame:
    """pool: from pools(). tried: (request_id, instance), the instances that a request shall not get again.

    The pool with their places (_tried, in order) and n less by these; requests that have tried all are left out.
    """
    own = pool.select("request_id", "service", "tag").distinct().join(tried.distinct(), "request_id")
    seen = _met(own, _placed(known), ["service", "tag", "instance"]).groupBy("request_id", "service", "tag").agg(F.array_sort(F.collect_list("place")).alias("_places"))
    places = F.coalesce("_places", F.expr("cast(array() as array<bigint>)"))
    return _met(pool, seen, ["request_id", "service", "tag"], "left").select("request_id", "service", "tag", (F.col("n") - F.size(places)).alias("n"), places.alias("_tried")).where("n > 0")


def round_robin(pool: DataFrame, known: DataFrame, turn: Column) -> DataFrame:
    """One instance a request: its place in order is the turn modulo their number, places tried not counted.

    pool: from pools() or without_tried(). The place is worked out from numbers, and the instance joined by its place.
    """
    place = F.pmod(turn.cast("long"), F.col("n"))
    if "_tried" in pool.columns:
        place = F.aggregate("_tried", place, lambda at, gone: at + F.when(gone <= at, F.lit(1).cast("long")).otherwise(F.lit(0).cast("long")))
    asked = pool.select("request_id", "service", "tag", place.alias("place"))
    return _met(asked, _placed(known), ["service", "tag", "place"]).select("request_id", "service", "instance")


def weighted_pick(pool: DataFrame, seed: int) -> DataFrame:
    """One instance a request, with probability in proportion to weight (0 if negative; all alike if all are 0).

    Chance is 32 bits of a digest of request, instance and seed, so a task that runs again picks the same. The instance with the
    least -ln(chance) / weight wins, which gives each its share.
    """
    weight = F.greatest("weight", F.lit(0.0))
    total = F.sum(weight).over(Window.partitionBy("request_id"))
    own = F.when(total > 0, weight).otherwise(1.0)
    named = F.concat_ws("|", F.col("request_id").cast("string"), F.col("instance").cast("string"), F.lit(str(seed)))
    chance = (F.conv(F.left(F.md5(named.cast("binary")), F.lit(8)), 16, 10).cast("double") + 1) / F.lit(float((1 << 32) + 1))
    return pool.withColumn("_k", F.when(own > 0, -F.log(chance) / own)).where("_k IS NOT NULL").groupBy("request_id").agg(F.min_by("instance", F.struct("_k", "instance")).alias("instance"))


def attempt_outcome(status: Column, code: Column) -> Column:
    """SUCCESS, RETRY on the next instance (network errors, 5xx), or STOP (4xx and business errors)."""
    return F.when(status.isNull() | (status >= 500), "RETRY").when(status >= 400, "STOP").when(code == 200, "SUCCESS").otherwise("STOP")


def group_role(roles: Column, group: Column) -> Column:
    """A caller's role in a group from a map of JSON text; NOT_MEMBER by default and for text that can't be read."""
    return F.coalesce(F.try_element_at(F.from_json(roles, "map<string,string>"), group), F.lit("NOT_MEMBER"))


def access(user: Column, identity: Column, allowed: list[str]) -> Column:
    return F.when(user.isNull(), "NOT_LOGIN").when(~F.coalesce(identity.isin(allowed), F.lit(False)), "NO_PERMISSION").otherwise("OK")


def group_access(roles: Column, group: Column, required: list[str] | None = None) -> Column:
    """Whether a caller is a member of the group, with one of the roles required, if any are."""
    role = group_role(roles, group)
    return F.when(role == "NOT_MEMBER", "NO_PERMISSION").when(F.lit(required is None) | role.isin(required or []), "OK").otherwise("NO_PERMISSION")
