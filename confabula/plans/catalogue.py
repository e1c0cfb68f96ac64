"""Queries over skills, assets, tools, owned models and providers, memories and scalar functions, with their DuckDB forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import errors
from ..functions import text as T
from ..functions.registry import Definition, Registry, ToolError
from ..operators import assets as A
from ..operators import bindings as N
from ..operators import dispatch as D
from ..operators import memory as V
from ..operators import registry as R
from ..operators import search as H
from ..operators import skills as K
from ..operators import tools as X
from ..operators import usage as U
from ..sources import bundles as B
from ..sources import catalog as C
from .chat import NOW, now
from .content import SKILLS, matched
from .models import MAP, MODEL, PROV, USE, usage


def skills(spark, d):
    return B.bundles_of(C.bundle_files(spark, d))


#: f: whether the frontmatter counts; v: the last version.
BUNDLE = """SELECT 's' || k AS skill_id, k, name, brand, CASE WHEN k % 2 = 0 THEN '1.1' ELSE '1.0' END AS v, k % 7 <> 0 AND k % 11 <> 0 AS f,
  CASE k % 3 WHEN 0 THEN ['references/b.md', 'scripts/a.py'] WHEN 1 THEN ['references/b.md'] ELSE [] END AS paths FROM (SELECT p_partkey AS k, p_name AS name, p_brand AS brand FROM part)"""


def bundle_fields(spark, d):
    return skills(spark, d).select(
        "skill_id", "version", "display_name", "description", "enabled", F.array_join("triggers", ",").alias("triggers"), F.length(B.body(F.col("skill_md"))).cast("long").alias("n_body"),
        F.array_join(F.transform("assets_manifest", lambda a: F.concat_ws("|", a["path"], a["object_key"], a["kind"], a["size_bytes"].cast("string"))), ",").alias("assets"),
    )


ASSETS = "coalesce(array_to_string(list_transform(paths, lambda p: p || '|skills/' || skill_id || '/' || v || '/' || p || '|' || CASE WHEN p LIKE 'ref%' THEN 'reference|' || strlen(name) ELSE 'script|1' END), ','), '')"


def upserted(spark, d):
    new = skills(spark, d).where("skill_id LIKE '%1' OR skill_id LIKE '%2'").select("skill_id", "version", "display_name", "enabled")
    old = C.table(spark, d, "part").where("p_partkey % 5 < 2").select(F.concat(F.lit("s"), F.col("p_partkey").cast("string")).alias("skill_id"), F.lit("0.9").alias("version"), F.lit("Old").alias("display_name"), F.lit(False).alias("enabled"))
    at = F.lit("2023-01-01 00:00:00").cast("timestamp_ntz")
    return A.upsert_skills(old.withColumn("created_at", at).withColumn("updated_at", at), new, now())


def asked_skills(spark, d):
    k = F.col("c_custkey")
    named = lambda x: F.concat(F.lit("s"), x.cast("string"))
    asked = F.when(k % 6 == 0, "  ").otherwise(F.concat(F.lit(" "), named(k * 2)))
    return C.table(spark, d, "customer").select(k.alias("request_id"), asked.alias("skill_id"), F.when(k % 4 == 0, F.array(named(k))).otherwise(F.array(named(k * 2))).alias("allowed"))


def loaded(spark, d):
    return A.load_skills(asked_skills(spark, d), skills(spark, d)).select("request_id", "outcome", F.length("output").cast("long").alias("n_output"), F.md5(F.col("output").cast("binary")).alias("digest"))


LOADED = f"""WITH b AS (SELECT *, CASE WHEN f THEN name ELSE skill_id END AS shown, CASE WHEN k % 7 = 0 THEN 'Body of ' || name
    ELSE '---' || chr(10) || 'skill_id: s' || k || chr(10) || 'display_name: "' || name || '"' || chr(10) || 'description: ' || brand || chr(10) || 'version: 0.0' || chr(10) || 'enabled: ' || CASE WHEN k % 5 = 0 THEN 'False' ELSE 'true' END || chr(10)
      || 'triggers:' || chr(10) || '  - ' || name || chr(10) || '  - t' || k || chr(10) || CASE WHEN k % 11 = 0 THEN '' ELSE '---' || chr(10) END || 'Text ' || v END AS body,
    list_transform(paths, lambda p: chr(10) || '- ' || p || ' (' || CASE WHEN p LIKE 'ref%' THEN 'reference, ' || strlen(name) ELSE 'script, 1' END || ' bytes)') AS lines FROM ({BUNDLE})),
  r AS (SELECT c_custkey AS request_id, c_custkey * 2 AS k FROM customer),
  o AS (SELECT request_id, b.k, CASE WHEN request_id % 6 <> 0 AND request_id % 4 <> 0 THEN '# ' || shown || chr(10) || body || coalesce(array_to_string(lines, ''), '') END AS output FROM r LEFT JOIN b ON b.k = r.k)
  SELECT request_id, CASE WHEN request_id % 6 = 0 THEN 'MISSING_SKILL_ID' WHEN request_id % 4 = 0 THEN 'DENIED' WHEN k IS NULL THEN 'SKILL_NOT_FOUND' ELSE 'OK' END AS outcome, length(output) AS n_output, md5(output) AS digest FROM o"""


def objects(spark, d):
    files = C.bundle_files(spark, d).where("path <> 'SKILL.md'")
    made = files.select(A.object_key(F.col("skill_id"), F.col("version"), F.col("path")).alias("object_key"), F.when(F.col("path").startswith("scripts"), F.unhex(F.lit("ff41"))).otherwise(F.col("content")).alias("content"), F.substring("skill_id", 2, 20).cast("long").alias("k"))
    return made.where("k % 9 <> 0").drop("k")


def asset_requests(spark, d):
    k = F.col("c_custkey")
    path = F.when(k % 8 == 0, "").when(k % 8 == 1, "other.md").when(k % 8 < 5, " references/b.md").otherwise("scripts/a.py")
    return C.table(spark, d, "customer").select(k.alias("request_id"), F.concat(F.lit("s"), (k * 2).cast("string")).alias("skill_id"), path.alias("path"))


def assets(spark, d):
    return A.load_assets(asset_requests(spark, d), skills(spark, d), objects(spark, d), 10).select("request_id", "outcome", "output")


ASSET = f"""WITH r AS (SELECT c_custkey AS request_id, c_custkey * 2 AS k, CASE WHEN c_custkey % 8 = 0 THEN '' WHEN c_custkey % 8 = 1 THEN 'other.md' WHEN c_custkey % 8 < 5 THEN 'references/b.md' ELSE 'scripts/a.py' END AS path FROM customer),
  o AS (SELECT r.*, b.name, CASE WHEN path = '' THEN 'MISSING_INPUT' WHEN b.k IS NULL THEN 'SKILL_NOT_FOUND' WHEN NOT list_contains(paths, path) THEN 'NOT_DECLARED' WHEN r.k % 9 = 0 THEN 'READ_FAILED' WHEN path LIKE 's%' THEN 'NOT_TEXT' ELSE 'OK' END AS outcome FROM r LEFT JOIN ({BUNDLE}) b ON b.k = r.k)
  SELECT request_id, outcome, CASE WHEN outcome = 'OK' THEN '# s' || k || ' ' || path || chr(10) || CASE WHEN length(name) > 10 THEN left(name, 10) || chr(10) || '...[truncated]' ELSE name END || chr(10) || '# end' END AS output FROM o"""


def objects_found(spark, d):
    p = C.table(spark, d, "pages").select(F.concat(F.lit("k"), F.col("page_id").cast("string")).alias("object_key"), "page_id", F.col("url").alias("content"))
    return A.fetched(p.select("object_key", "page_id"), p.where("page_id % 2 = 0"), p.where("page_id % 3 = 0").withColumn("content", F.concat(F.lit("far "), "content"))).select("page_id", "content", "place")


def addressed(spark, d):
    k = F.col("p_partkey")
    asked = C.table(spark, d, "part").select(k.alias("k"), F.concat(F.lit("s"), k.cast("string")).alias("skill_id"), F.when(k % 13 == 0, "..").otherwise("1.0").alias("version"), F.when(k % 6 == 0, "../x").otherwise("references/b.md").alias("path"))
    return A.addressed(asked, objects(spark, d)).select("k", F.col("content").cast("string").alias("content"), "cache_key")


def cached(spark, d):
    e = C.events(spark, d).select("event_id", F.col("ts").alias("last_access"))
    return A.live_entries(e, F.lit("2024-01-15 00:00:00").cast("timestamp_ntz"), "INTERVAL 6 HOURS").select("event_id")


def results(spark, d):
    e = C.events(spark, d)
    i = F.col("event_id")
    calls = e.select((i - i % 4).alias("message_id"), (i % 4).cast("int").alias("index"), i.cast("string").alias("id"), F.when(i % 7 == 0, "gone").otherwise(F.col("event_type")).alias("name"), F.when(i % 5 == 0, F.array(F.lit("user"))).otherwise(F.array(F.lit("user"), F.lit("session"))).alias("context"))
    tools = spark.sql("SELECT * FROM VALUES ('click', array('user'), true, 50), ('view', array('session'), true, 90), ('purchase', array('session', 'user'), false, 90) AS t(name, required_context, persist, timeout_seconds)")
    outputs = e.select(i.cast("string").alias("id"), F.col("props").alias("output"), F.when(i % 11 == 0, "boom").alias("error"), (i % 100).cast("int").alias("seconds"), F.when(i % 2 == 0, "kept short").alias("placeholder"))
    return X.run_results(calls, tools, outputs)


RESULTS = """WITH c AS (SELECT *, CASE WHEN event_id % 7 = 0 THEN 'gone' ELSE event_type END AS name FROM events),
  o AS (SELECT *, name IN ('click', 'view', 'purchase') AS known, CASE WHEN name NOT IN ('click', 'view', 'purchase') THEN 'Tool unavailable: ' || name WHEN name <> 'click' AND event_id % 5 = 0 THEN 'Missing context'
    WHEN event_id % 100 > CASE name WHEN 'click' THEN 50 ELSE 90 END THEN 'Timeout' WHEN event_id % 11 = 0 THEN 'boom' END AS error FROM c)
  SELECT event_id - event_id % 4 AS message_id, (event_id % 4)::INTEGER AS index, event_id::VARCHAR AS id, name, CASE WHEN error IS NULL THEN props END AS output, error,
    CASE WHEN name = 'purchase' THEN CASE WHEN event_id % 2 = 0 THEN 'kept short' ELSE '[output not kept]' END END AS placeholder FROM o"""


def half(context, k, strict=False):
    if k % 5 == 0:
        raise ToolError("NOT_DIVISIBLE", str(k), True)
    return {"half": k // 2, "user": context["user"]}


def dispatched(spark, d):
    """Each event calls the tool of its type; some have damaged arguments, some no session, and one tool isn't there."""
    integer = {"type": "object", "properties": {"k": {"type": "integer"}}, "required": ["k"], "additionalProperties": False}
    own = Registry()
    own.register(Definition("click", half, "string", integer, required_context=("user",)))
    own.register(Definition("view", lambda context, k: str(k), "string", integer, required_context=("user", "session"), persist=False))
    own.register(Definition("purchase", lambda context, **_: "done", "string", timeout_seconds=None))
    i = F.col("event_id")
    context = F.when(i % 3 == 0, F.create_map(F.lit("user"), F.lit("u"))).otherwise(F.create_map(F.lit("user"), F.lit("u"), F.lit("session"), F.lit("s")))
    calls = C.events(spark, d).select((i - i % 4).alias("message_id"), (i % 4).cast("int").alias("index"), i.cast("string").alias("id"), F.col("event_type").alias("name"), F.expr("CASE event_id % 7 WHEN 0 THEN '[1]' WHEN 1 THEN '{\"k\": true}' ELSE props END").alias("arguments"), context.alias("context"))
    return D.dispatch(calls, own).select("message_id", "index", "id", "name", "output", "error", "detail", "retryable", "placeholder")


DISPATCHED = """WITH e AS (SELECT *, json_extract(props, '$.k')::BIGINT AS k FROM events),
  o AS (SELECT *, CASE WHEN event_type NOT IN ('click', 'view', 'purchase') THEN 'Tool unavailable' WHEN event_id % 7 = 0 OR (event_type <> 'purchase' AND event_id % 7 = 1) OR (event_type = 'view' AND event_id % 3 = 0) THEN 'Tool preflight failed'
    WHEN event_type = 'click' AND k % 5 = 0 THEN 'NOT_DIVISIBLE' END AS error FROM e)
  SELECT event_id - event_id % 4 AS message_id, (event_id % 4)::INTEGER AS index, event_id::VARCHAR AS id, event_type AS name,
    CASE WHEN error IS NULL THEN CASE event_type WHEN 'click' THEN '{"half": ' || (k // 2) || ', "user": "u"}' WHEN 'view' THEN k::VARCHAR ELSE 'done' END END AS output, error,
    CASE error WHEN 'Tool unavailable' THEN event_type WHEN 'NOT_DIVISIBLE' THEN k::VARCHAR WHEN 'Tool preflight failed' THEN CASE WHEN event_id % 7 = 0 THEN 'NOT_AN_OBJECT' WHEN event_type <> 'purchase' AND event_id % 7 = 1 THEN 'TYPE:k' ELSE 'CONTEXT:session' END END AS detail,
    CASE WHEN error IS NOT NULL THEN error = 'NOT_DIVISIBLE' END AS retryable, CASE WHEN event_type = 'view' THEN '[output not kept]' END AS placeholder FROM o"""


def owned_models(spark, d):
    m = C.models(spark, d)
    return m.withColumn("owner_user_id", F.expr("if(id % 5 = 0, null, cast(id % 7 as string))")).withColumn("scope", F.expr("if(id % 5 = 0, 'SYSTEM', 'USER')")).withColumn("updated_at", F.expr("timestampadd(MINUTE, cast(id % 50 as int), timestamp_ntz'2024-01-01 00:00:00')"))


def owned_providers(spark, d):
    p = C.providers(spark, d)
    return p.select(
        "id", "name", F.concat(F.lit("http://p"), F.col("id").cast("string")).alias("api_base_url"), "api_key", R.fingerprint(F.col("api_key")).alias("api_key_fingerprint"), F.expr("if(id % 3 = 0, 'OTHER', 'OPENAI_COMPATIBLE_LLM')").alias("type"), "is_active",
        F.expr("if(id % 5 = 0, 'SYSTEM', 'USER')").alias("scope"), F.expr("if(id % 5 = 0, null, cast(id % 7 as string))").alias("owner_user_id"), F.lit("2024-01-01 00:00:00").cast("timestamp_ntz").alias("updated_at"),
    )


OWNER = "CASE WHEN {0} % 5 = 0 THEN NULL ELSE ({0} % 7)::VARCHAR END"


def inserted(spark, d):
    old = owned_providers(spark, d)
    new = C.providers(spark, d).select((F.col("id") + 10**6).alias("id"), F.expr("if(id % 4 = 0, name, concat('New ', id div 2))").alias("name"), F.concat(F.lit("k"), F.col("id").cast("string")).alias("api_key"), F.expr("if(id % 5 = 0, null, cast(id % 7 as string))").alias("owner_user_id"))
    out, refused = R.create_owned(old, new, "name", now())
    fresh = out.where("id > 1000000").select("id", "name", "scope", "is_active", F.left("api_key_fingerprint", F.lit(8)).alias("mark"), F.lit(None).cast("string").alias("error"))
    return fresh.union(refused.select("id", "name", "scope", "is_active", F.left("api_key_fingerprint", F.lit(8)), "error"))


INSERTED = f"""WITH n AS (SELECT s_suppkey AS k, CASE WHEN s_suppkey % 4 = 0 THEN s_name ELSE 'New ' || (s_suppkey // 2) END AS name, {OWNER.format('s_suppkey')} AS owner FROM supplier),
  r AS (SELECT *, row_number() OVER (PARTITION BY coalesce(owner, '-'), name ORDER BY k) AS rn FROM n)
  SELECT k + 1000000 AS id, name, CASE WHEN owner IS NULL THEN 'SYSTEM' ELSE 'USER' END AS scope, true AS is_active, left(sha256('k' || k), 8) AS mark, CASE WHEN k % 4 = 0 OR rn > 1 THEN 'DUPLICATE' END AS error FROM r"""


def updated(spark, d):
    p = owned_providers(spark, d)
    given = p.where("id % 2 = 0").select("id", F.expr("if(id % 4 = 0, array('api_key', 'name'), array('api_base_url', 'is_active'))").alias("present"), F.lit("Renamed").alias("name"), F.lit(None).cast("string").alias("api_base_url"), F.expr("if(id % 8 = 0, null, 'secret')").alias("api_key"), F.lit("X").alias("type"), F.lit(False).alias("is_active"))
    return R.update_providers(p, given, now()).select("id", "name", "api_base_url", "api_key", F.left("api_key_fingerprint", F.lit(8)).alias("mark"), "type", "is_active", "updated_at")


UPDATED = f"""SELECT id, CASE WHEN id % 4 = 0 THEN 'Renamed' ELSE name END AS name, CASE WHEN id % 4 = 2 THEN NULL ELSE 'http://p' || id END AS api_base_url, CASE id % 8 WHEN 0 THEN NULL WHEN 4 THEN 'secret' ELSE api_key END AS api_key,
  left(sha256(CASE id % 8 WHEN 0 THEN NULL WHEN 4 THEN 'secret' ELSE api_key END), 8) AS mark, CASE WHEN id % 3 = 0 THEN 'OTHER' ELSE 'OPENAI_COMPATIBLE_LLM' END AS type, is_active AND id % 4 <> 2 AS is_active,
  CASE WHEN id % 2 = 0 THEN TIMESTAMP '{NOW}' ELSE TIMESTAMP '2024-01-01 00:00:00' END AS updated_at FROM ({PROV})"""


def bind_checks(spark, d):
    asked = C.models(spark, d).select(F.col("id").alias("model_id"), (F.col("id") % 120 + 1).alias("provider_id"), F.expr("if(id % 5 = 0, null, cast(id % 14 as string))").alias("user_id"))
    return R.bind_outcome(asked, owned_models(spark, d), owned_providers(spark, d))


BIND = f"""WITH q AS (SELECT id AS model_id, id % 120 + 1 AS provider_id, CASE WHEN id % 5 = 0 THEN NULL ELSE (id % 14)::VARCHAR END AS user_id FROM ({MODEL}))
  SELECT model_id, provider_id, user_id, CASE WHEN user_id IS DISTINCT FROM {OWNER.format('model_id')} THEN 'MODEL_NOT_FOUND' WHEN p.id IS NULL OR user_id IS DISTINCT FROM {OWNER.format('provider_id')} THEN 'PROVIDER_NOT_FOUND' WHEN p.id % 3 = 0 THEN 'TYPE_UNSUPPORTED' ELSE 'OK' END AS outcome
  FROM q LEFT JOIN ({PROV}) p ON p.id = q.provider_id"""


def owned_mappings(spark, d):
    m = C.mappings(spark, d)
    owner = F.expr("if(model_id % 5 = 0, null, cast(model_id % 7 as string))")
    return m.withColumns({"owner_user_id": owner, "provider_model_name": F.concat(F.lit("pm"), F.col("provider_id").cast("string")), "updated_at": F.col("created_at")})


def bind_requests(spark, d):
    """Every model is bound again to half of its providers, and to one more that its owner has; some requests come from others."""
    again = C.mappings(spark, d).where("(model_id + provider_id) % 2 = 0").select("model_id", "provider_id", (F.col("model_id") * 10**7 + F.col("provider_id") * 2 + 1).alias("request_id"))
    more = C.models(spark, d).select(F.col("id").alias("model_id"), (F.col("id") % 35 + 35).alias("provider_id"), (F.col("id") * 10**7 + F.col("id") * 17 % 1000 * 2).alias("request_id"))
    return again.union(more).select(
        "request_id", "model_id", "provider_id", F.expr("if(model_id % 13 = 0, 'x', if(model_id % 5 = 0, null, cast(model_id % 7 as string)))").alias("user_id"), F.concat(F.lit("new"), F.col("request_id").cast("string")).alias("provider_model_name"),
        F.expr("if(provider_id % 11 = 0, null, (model_id + provider_id) % 3 <> 0)").alias("is_preferred"), (F.col("provider_id") % 4 != 0).alias("is_active"),
    )


def bound(spark, d):
    return N.bind_owned(owned_mappings(spark, d), bind_requests(spark, d), owned_models(spark, d), owned_providers(spark, d), now())


OWNED_MAP = f"SELECT *, {OWNER.format('model_id')} AS owner_user_id, 'pm' || provider_id AS provider_model_name, created_at AS updated_at FROM ({MAP})"
BIND_REQUESTS = f"""SELECT *, CASE WHEN model_id % 13 = 0 THEN 'x' ELSE {OWNER.format('model_id')} END AS user_id, (provider_id % 11 = 0 OR (model_id + provider_id) % 3 <> 0) AND provider_id % 4 <> 0 AS pref, provider_id % 4 <> 0 AS act FROM (
  SELECT model_id, provider_id, model_id * 10000000 + provider_id * 2 + 1 AS request_id FROM ({MAP}) WHERE (model_id + provider_id) % 2 = 0 UNION ALL SELECT id, id % 35 + 35, id * 10000000 + id * 17 % 1000 * 2 FROM ({MODEL}))"""
BIND_ANSWERS = f"""SELECT r.*, CASE WHEN m.id IS NULL OR user_id IS DISTINCT FROM {OWNER.format('model_id')} THEN 'MODEL_NOT_FOUND' WHEN p.id IS NULL OR user_id IS DISTINCT FROM {OWNER.format('provider_id')} THEN 'PROVIDER_NOT_FOUND' WHEN provider_id % 3 = 0 THEN 'TYPE_UNSUPPORTED' ELSE 'OK' END AS outcome
  FROM ({BIND_REQUESTS}) r LEFT JOIN ({MODEL}) m ON m.id = model_id LEFT JOIN ({PROV}) p ON p.id = provider_id"""
BOUND = f"""WITH m AS ({OWNED_MAP}), w AS (SELECT * FROM ({BIND_ANSWERS}) WHERE outcome = 'OK'),
  k AS (SELECT w.*, coalesce(m.is_preferred, false) AS had, min(request_id) OVER (PARTITION BY w.model_id) = request_id AS first FROM w LEFT JOIN m ON m.model_id = w.model_id AND m.provider_id = w.provider_id),
  c AS (SELECT model_id, max(request_id) AS cleared_at FROM k WHERE pref AND NOT (first AND had) GROUP BY 1),
  l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY model_id, provider_id ORDER BY request_id DESC) AS rn FROM k) WHERE rn = 1),
  j AS (SELECT coalesce(m.model_id, l.model_id) AS model_id, coalesce(m.provider_id, l.provider_id) AS provider_id, coalesce('new' || l.request_id, provider_model_name) AS provider_model_name, coalesce(priority, 0) AS priority, coalesce(l.pref, m.is_preferred) AS pref,
    coalesce(l.act, m.is_active) AS is_active, coalesce(m.created_at, TIMESTAMP '{NOW}') AS created_at, CASE WHEN l.request_id IS NOT NULL THEN TIMESTAMP '{NOW}' ELSE m.updated_at END AS updated_at, coalesce(l.request_id, -1) AS asked_at FROM m FULL JOIN l ON l.model_id = m.model_id AND l.provider_id = m.provider_id)
  SELECT j.model_id, j.provider_id, {OWNER.format('j.model_id')} AS owner_user_id, provider_model_name, priority, pref AND coalesce(cleared_at, -1) <= asked_at AS is_preferred, is_active, created_at, CASE WHEN pref AND coalesce(cleared_at, -1) > asked_at THEN TIMESTAMP '{NOW}' ELSE updated_at END AS updated_at
  FROM j LEFT JOIN c ON c.model_id = j.model_id"""


def unbind_requests(spark, d):
    """Two of three providers of each model, some asked for twice, some by others; and pairs that don't exist."""
    own = F.expr("if(model_id % 5 = 0, null, cast(model_id % 7 as string))")
    named = C.mappings(spark, d).where("provider_id % 3 > 0").withColumn("copy", F.explode(F.expr("if(provider_id % 4 = 0, array(0, 1), array(0))"))).select("model_id", "provider_id", "copy")
    absent = C.models(spark, d).select(F.col("id").alias("model_id"), F.lit(10**6).cast("long").alias("provider_id"), F.lit(0).alias("copy"))
    return named.union(absent).select((F.col("model_id") * 10**7 + F.col("provider_id") * 2 + F.col("copy")).alias("request_id"), "model_id", "provider_id", F.when(F.col("model_id") % 13 == 0, "x").otherwise(own).alias("user_id"))


def unbound_owned(spark, d):
    return N.unbind_owned(owned_mappings(spark, d), unbind_requests(spark, d), owned_models(spark, d), now())


UNBIND_ANSWERS = f"""SELECT x.model_id * 10000000 + x.provider_id * 2 + copy AS request_id, x.model_id, x.provider_id, CASE WHEN x.model_id % 13 = 0 THEN 'x' ELSE {OWNER.format('x.model_id')} END AS user_id, CASE WHEN m.id IS NULL OR x.model_id % 13 = 0 THEN 'MODEL_NOT_FOUND' WHEN copy = 1 OR absent THEN 'MAPPING_NOT_FOUND' ELSE 'OK' END AS outcome
  FROM (SELECT model_id, provider_id, unnest(CASE WHEN provider_id % 4 = 0 THEN [0, 1] ELSE [0] END) AS copy, false AS absent FROM ({MAP}) WHERE provider_id % 3 > 0 UNION ALL SELECT id, 1000000, 0, true FROM ({MODEL})) x LEFT JOIN ({MODEL}) m ON m.id = x.model_id"""
UNBOUND = f"""WITH m AS ({OWNED_MAP}), gone AS (SELECT DISTINCT model_id, provider_id FROM ({UNBIND_ANSWERS}) WHERE outcome = 'OK'),
  lost AS (SELECT DISTINCT m.model_id FROM m SEMI JOIN gone ON gone.model_id = m.model_id AND gone.provider_id = m.provider_id WHERE is_preferred),
  l AS (SELECT m.*, m.model_id IN (SELECT model_id FROM lost) AND is_active AND row_number() OVER (PARTITION BY m.model_id, is_active ORDER BY priority, created_at, m.provider_id) = 1 AS rises FROM m ANTI JOIN gone ON gone.model_id = m.model_id AND gone.provider_id = m.provider_id)
  SELECT model_id, provider_id, owner_user_id, provider_model_name, priority, is_preferred OR rises AS is_preferred, is_active, created_at, CASE WHEN rises THEN TIMESTAMP '{NOW}' ELSE updated_at END AS updated_at FROM l"""


def owned_deletes(spark, d):
    asked = C.models(spark, d).where("id % 4 = 0").select(F.col("id").alias("model_id"), F.expr("if(id % 5 = 0, null, cast(id % 14 as string))").alias("user_id"))
    models, mappings = R.delete_models(owned_models(spark, d), C.mappings(spark, d), asked)
    return models.select(F.col("id").alias("model_id")).join(mappings.groupBy("model_id").agg(F.count("*").alias("n_mappings")), "model_id", "left")


def wide_update(spark, d):
    m = owned_models(spark, d).withColumns({"support_vision": F.col("id") % 2 == 0, "support_tools": F.lit(True), "support_thinking": F.col("id") % 2 == 1, "support_streaming": F.lit(True)})
    columns = ["display_name", "vendor", "type", "billing_ratio", "support_vision", "support_tools", "context_window_tokens", "max_output_tokens", "is_active", "support_thinking", "support_streaming"]
    given = m.where("id % 3 = 0").select("id", F.transform(F.filter(F.array([F.struct(F.lit(i).alias("i"), F.lit(c).alias("c")) for i, c in enumerate(columns)]), lambda x: (x["i"] + F.col("id")) % 2 == 0), lambda x: x["c"]).alias("present"), F.lit("N").alias("display_name"), F.lit(None).cast("string").alias("vendor"), F.lit(9).alias("type"), F.lit(8).alias("billing_ratio"), F.lit(False).alias("support_vision"), F.lit(False).alias("support_tools"), F.lit(7).alias("context_window_tokens"), F.lit(6).alias("max_output_tokens"), F.lit(None).cast("boolean").alias("is_active"), F.lit(True).alias("support_thinking"), F.lit(False).alias("support_streaming"))
    return R.sparse_update(m, given, "id", columns, now()).select("id", *columns)


def set_to(i: int, name: str, new: str, old: str) -> str:
    return f"CASE WHEN id % 3 = 0 AND ({i} + id) % 2 = 0 THEN {new} ELSE {old} END AS {name}"


def memories(spark, d):
    return C.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("user_id"), F.expr("if(vec_id % 3 = 0, null, concat('m', vec_id))").alias("memory"), F.expr("""if(vec_id % 2 = 0, null, '{"a":1}')""").alias("metadata"))


def reranked(spark, d):
    m = C.memories(spark, d)
    return V.recall(m.where("id % 20 = 0").select(F.col("id").alias("query_id"), "user_id", F.col("embedding").alias("vector")), m, 5, None, "dot").select("query_id", "id", "rank")


def owned_counters(spark, d):
    """Every third provider is a user's."""
    return C.providers(spark, d).select(F.col("id").alias("provider_id"), F.expr("if(id % 3 = 0, cast(id % 7 as string), null)").alias("owner_user_id"), (F.col("id") * 10).alias("usage_tokens"), F.col("id").alias("billable_usage_tokens"))


def owned_usage(spark, d, events=None):
    """Usage of providers of which some aren't there; every fifth amount names the wrong owner."""
    return usage(spark, d, events).withColumn("owner_user_id", F.expr("if(trace_id % 5 = 0, 'other', if(provider_id % 3 = 0, cast(provider_id % 7 as string), null))"))


def added(spark, d):
    return U.add_to_ledger(owned_counters(spark, d), U.ledger(owned_usage(spark, d), ["provider_id", "owner_user_id"]))


ADDED = f"""WITH b AS (SELECT id AS provider_id, CASE WHEN id % 3 = 0 THEN (id % 7)::VARCHAR END AS owner_user_id, id FROM ({PROV})),
  d AS (SELECT provider_id, CASE WHEN trace_id % 5 = 0 THEN 'other' WHEN provider_id % 3 = 0 THEN (provider_id % 7)::VARCHAR END AS owner_user_id, sum(greatest(usage_tokens, 0))::BIGINT AS u, sum(greatest(billable_tokens, 0))::BIGINT AS b
    FROM ({USE}) WHERE usage_tokens > 0 OR billable_tokens > 0 GROUP BY 1, 2)"""


def scalars(spark, d):
    e = C.events(spark, d)
    raw = F.expr("CASE event_id % 5 WHEN 0 THEN 'a/b' WHEN 1 THEN event_type WHEN 2 THEN '12' WHEN 3 THEN '' END")
    code = F.expr("CASE event_id % 4 WHEN 0 THEN 40001 WHEN 1 THEN 40026 WHEN 2 THEN 403 ELSE 7 END")
    return e.select(
        "event_id", T.qualified_model(raw).alias("model"), H.limit_or_default(raw).cast("long").alias("size"), T.iso_time(F.col("ts")).alias("at"), T.stable_id("txt_", F.col("event_id"), F.col("event_type")).alias("own_id"),
        T.utf8_or_null(F.when(F.col("event_id") % 3 == 0, F.unhex(F.lit("fffe"))).otherwise(F.col("event_type").cast("binary"))).alias("text"), errors.name_of(code).alias("error"), errors.code_of(F.when(F.col("event_id") % 2 == 0, "MODEL_NOT_FOUND").otherwise("no such name")).cast("long").alias("code"),
    )


SCALARS = """SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'a/b' WHEN 1 THEN 'openai/' || event_type WHEN 2 THEN 'openai/12' WHEN 3 THEN 'openai/' END AS model, CASE WHEN event_id % 5 = 2 THEN 12 ELSE 10 END::BIGINT AS size,
  strftime(ts, '%Y-%m-%dT%H:%M:%S') AS at, 'txt_' || md5(event_id || chr(0) || event_type) AS own_id, CASE WHEN event_id % 3 <> 0 THEN event_type END AS text,
  CASE event_id % 4 WHEN 0 THEN 'SESSION_NOT_FOUND' WHEN 1 THEN 'MODEL_PROVIDER_TYPE_UNSUPPORTED' WHEN 2 THEN 'IDENTITY_UNAUTHORIZED' END AS error, CASE WHEN event_id % 2 = 0 THEN 40021 END::BIGINT AS code FROM events"""


def picks(spark, d):
    e = C.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("request_id"), F.col("l_suppkey").alias("instance"), F.expr("case when l_orderkey % 10 = 0 then 0.0 when l_linenumber % 2 = 0 then -1.0 else l_quantity end").alias("weight")).groupBy("request_id", "instance").agg(F.max("weight").alias("weight"))
    return X.weighted_pick(e, 7)


PICKS = """WITH e AS (SELECT l_orderkey AS request_id, l_suppkey AS instance, max(greatest(CASE WHEN l_orderkey % 10 = 0 THEN 0.0 WHEN l_linenumber % 2 = 0 THEN -1.0 ELSE l_quantity END, 0))::DOUBLE AS weight FROM lineitem GROUP BY 1, 2),
  o AS (SELECT *, CASE WHEN sum(weight) OVER (PARTITION BY request_id) > 0 THEN weight ELSE 1.0 END AS own, (('0x' || left(md5(request_id || '|' || instance || '|7'), 8))::BIGINT + 1) / 4294967297.0::DOUBLE AS chance FROM e)
  SELECT request_id, arg_min(instance, -ln(chance) / own) AS instance FROM o WHERE own > 0 GROUP BY 1"""


def outcomes(spark, d):
    i = F.col("event_id")
    status, code = F.expr("CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 503 WHEN 2 THEN 404 ELSE 200 END"), F.expr("if(event_id % 5 = 3, 200, 40001)")
    roles = F.expr("""CASE event_id % 3 WHEN 0 THEN '{"7":"OWNER","8":"MEMBER"}' WHEN 1 THEN 'oops' END""")
    return C.events(spark, d).select(
        "event_id", X.attempt_outcome(status, code).alias("attempt"), X.access(F.when(i % 4 > 0, F.col("user_id")), F.col("event_type"), ["click", "view"]).alias("access"), X.group_role(roles, (F.lit(7) + i % 3 + i % 2).cast("string")).alias("role"),
        X.group_access(roles, F.lit("7")).alias("member"), X.group_access(roles, F.lit("8"), ["OWNER"]).alias("owner"),
    )


OUTCOMES = """SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'RETRY' WHEN 1 THEN 'RETRY' WHEN 3 THEN 'SUCCESS' ELSE 'STOP' END AS attempt,
  CASE WHEN event_id % 4 = 0 THEN 'NOT_LOGIN' WHEN event_type IN ('click', 'view') THEN 'OK' ELSE 'NO_PERMISSION' END AS access,
  CASE WHEN event_id % 3 = 0 THEN CASE event_id % 2 WHEN 0 THEN 'OWNER' ELSE 'MEMBER' END ELSE 'NOT_MEMBER' END AS role, CASE WHEN event_id % 3 = 0 THEN 'OK' ELSE 'NO_PERMISSION' END AS member, 'NO_PERMISSION' AS owner FROM events"""

Q: dict = {
    "frontmatter_bundle": (
        bundle_fields,
        f"""SELECT skill_id, v AS version, CASE WHEN f THEN name ELSE skill_id END AS display_name, CASE WHEN f THEN brand ELSE '' END AS description, NOT (f AND k % 5 = 0) AS enabled, CASE WHEN f THEN name || ',t' || k ELSE '' END AS triggers,
          CASE WHEN k % 7 = 0 THEN length('Body of ' || name) WHEN f THEN 9 ELSE length('---' || chr(10) || 'skill_id: s' || k || chr(10) || 'display_name: "' || name || '"' || chr(10) || 'description: ' || brand || chr(10) || 'version: 0.0' || chr(10) || 'enabled: ' || CASE WHEN k % 5 = 0 THEN 'False' ELSE 'true' END || chr(10) || 'triggers:' || chr(10) || '  - ' || name || chr(10) || '  - t' || k || chr(10) || 'Text 1.0' || chr(10)) END::BIGINT AS n_body, {ASSETS} AS assets FROM ({BUNDLE})""",
    ),
    "skill_meta": (lambda s, d: K.skill_meta(skills(s, d)), f"SELECT skill_id, CASE WHEN f THEN name ELSE skill_id END AS display_name, true AS enabled FROM ({BUNDLE}) WHERE NOT (f AND k % 5 = 0)"),
    "skill_upsert": (
        upserted,
        f"""WITH n AS (SELECT * FROM ({BUNDLE}) WHERE k % 10 IN (1, 2)), o AS (SELECT 's' || p_partkey AS skill_id FROM part WHERE p_partkey % 5 < 2)
          SELECT coalesce(n.skill_id, o.skill_id) AS skill_id, coalesce(n.v, '0.9') AS version, CASE WHEN n.k IS NULL THEN 'Old' WHEN f THEN name ELSE n.skill_id END AS display_name, n.k IS NOT NULL AND NOT (f AND n.k % 5 = 0) AS enabled,
            CASE WHEN o.skill_id IS NULL THEN TIMESTAMP '{NOW}' ELSE TIMESTAMP '2023-01-01 00:00:00' END AS created_at, CASE WHEN n.k IS NULL THEN TIMESTAMP '2023-01-01 00:00:00' ELSE TIMESTAMP '{NOW}' END AS updated_at FROM n FULL JOIN o ON n.skill_id = o.skill_id""",
    ),
    "load_skill": (loaded, LOADED),
    "load_asset": (assets, ASSET),
    "object_fetch": (objects_found, "SELECT page_id, CASE WHEN page_id % 2 = 0 THEN url WHEN page_id % 3 = 0 THEN 'far ' || url END AS content, CASE WHEN page_id % 2 = 0 THEN 'LOCAL' WHEN page_id % 3 = 0 THEN 'REMOTE' ELSE 'MISSING' END AS place FROM pages"),
    "addressed_read": (
        addressed,
        f"""SELECT k, CASE WHEN k % 13 <> 0 AND k % 6 <> 0 AND k % 9 <> 0 AND len(paths) > 0 THEN name END AS content, CASE WHEN k % 13 <> 0 AND k % 6 <> 0 THEN sha1('skills/s' || k || '/1.0/references/b.md') END AS cache_key FROM ({BUNDLE})""",
    ),
    "bind_owned": (lambda s, d: bound(s, d)[0], BOUND),
    "bind_owned_outcomes": (lambda s, d: bound(s, d)[1], f"SELECT request_id, model_id, provider_id, user_id, outcome FROM ({BIND_ANSWERS})"),
    "unbind_owned": (lambda s, d: unbound_owned(s, d)[0], UNBOUND),
    "unbind_owned_outcomes": (lambda s, d: unbound_owned(s, d)[1], UNBIND_ANSWERS),
    "provider_response": (
        lambda s, d: R.provider_response(C.providers(s, d)),
        f"SELECT id::VARCHAR AS id, name, CASE WHEN length(api_key) <= 8 THEN repeat('*', length(api_key)) ELSE left(api_key, 4) || '***' || right(api_key, 4) END AS api_key_masked, is_active FROM ({PROV})",
    ),
    "mapping_response": (
        lambda s, d: R.mapping_response(C.mappings(s, d), C.providers(s, d).where("id % 2 = 0")),
        f"SELECT model_id::VARCHAR AS model_id, provider_id::VARCHAR AS provider_id, p.name AS provider_name, is_preferred, m.is_active, priority FROM ({MAP}) m LEFT JOIN (SELECT * FROM ({PROV}) WHERE id % 2 = 0) p ON p.id = m.provider_id",
    ),
    "model_response": (
        lambda s, d: R.model_response(C.models(s, d)),
        f"SELECT id::VARCHAR AS id, display_name, vendor, type, billing_ratio, nullif(ctx, 0) AS context_window_tokens, nullif(outp, 0) AS max_output_tokens, is_active FROM ({MODEL})",
    ),
    "cache_gc": (cached, "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-14 18:00:00'"),
    "skill_exposure": (
        lambda s, d: K.exposure(matched(s, d), "doc_id").select("doc_id", F.array_join("allowed_skills", ",").alias("allowed_skills"), F.array_join("expose", ",").alias("expose")),
        f"""WITH s(skill_id, triggers) AS (VALUES {SKILLS})
          SELECT doc_id, string_agg(skill_id, ',' ORDER BY skill_id) AS allowed_skills, 'load_skill,load_skill_asset' AS expose FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY hits DESC, skill_id) AS rank FROM (
            SELECT doc_id, skill_id, len(list_filter(triggers, lambda t: t <> '' AND contains(lower(text), lower(t))))::BIGINT AS hits FROM documents, s) WHERE hits > 0) WHERE rank <= 2 GROUP BY 1""",
    ),
    "tool_results": (results, RESULTS),
    "tool_dispatch": (dispatched, DISPATCHED),
    "tool_elapsed": (lambda s, d: X.elapsed(C.events(s, d).select(F.col("user_id").alias("id"), "ts")), "SELECT user_id AS id, min(ts) AS started, max(ts) AS finished, epoch(max(ts) - min(ts))::DOUBLE AS seconds FROM events GROUP BY 1"),
    "tool_overlay": (
        lambda s, d: X.overlay(C.table(s, d, "nation").select(F.col("n_name").alias("tool"), F.lit("base").alias("origin")), C.table(s, d, "nation").where("n_nationkey % 2 = 0").select(F.col("n_name").alias("tool"), F.lit("own").alias("origin")), "tool"),
        "SELECT n_name AS tool, CASE WHEN n_nationkey % 2 = 0 THEN 'own' ELSE 'base' END AS origin FROM nation",
    ),
    "scope_check": (
        lambda s, d: owned_models(s, d).select("id", R.in_scope(F.lit("3")).alias("mine"), R.in_scope(F.lit(None).cast("string")).alias("system")),
        f"SELECT id, id % 5 <> 0 AND id % 7 = 3 AS mine, id % 5 = 0 AS system FROM ({MODEL})",
    ),
    "model_list": (
        lambda s, d: R.listed(owned_models(s, d)).select("id", "rank"),
        f"SELECT id, row_number() OVER (PARTITION BY {OWNER.format('id')} ORDER BY is_active DESC, id % 50 DESC, id) AS rank FROM ({MODEL})",
    ),
    "provider_list": (
        lambda s, d: R.listed(owned_providers(s, d)).select("id", "rank", T.masked(F.col("api_key")).alias("api_key")),
        f"SELECT id, row_number() OVER (PARTITION BY {OWNER.format('id')} ORDER BY is_active DESC, id) AS rank, CASE WHEN length(api_key) <= 8 THEN repeat('*', length(api_key)) ELSE left(api_key, 4) || '***' || right(api_key, 4) END AS api_key FROM ({PROV})",
    ),
    "provider_insert": (inserted, INSERTED),
    "provider_update": (updated, UPDATED),
    "bind_check": (bind_checks, BIND),
    "model_delete_owned": (
        owned_deletes,
        f"""WITH l AS (SELECT id FROM ({MODEL}) WHERE NOT (id % 4 = 0 AND (id % 5 = 0 OR id % 14 = id % 7)))
          SELECT l.id AS model_id, n.n AS n_mappings FROM l LEFT JOIN (SELECT l_partkey AS k, count(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY 1) n ON n.k = l.id""",
    ),
    "sparse_update_wide": (
        wide_update,
        f"""SELECT id, {set_to(0, 'display_name', "'N'", 'display_name')}, {set_to(1, 'vendor', 'NULL', 'vendor')}, {set_to(2, 'type', '9', 'type')}, {set_to(3, 'billing_ratio', '8', 'billing_ratio')}, {set_to(4, 'support_vision', 'false', 'id % 2 = 0')},
          {set_to(5, 'support_tools', 'false', 'true')}, {set_to(6, 'context_window_tokens', '7', 'ctx')}, {set_to(7, 'max_output_tokens', '6', 'outp')}, {set_to(8, 'is_active', 'NULL', 'is_active')}, {set_to(9, 'support_thinking', 'true', 'id % 2 = 1')}, {set_to(10, 'support_streaming', 'false', 'true')} FROM ({MODEL})""",
    ),
    "memory_list": (
        lambda s, d: V.listing(memories(s, d)),
        """SELECT vec_id AS id, label AS user_id, CASE WHEN vec_id % 3 = 0 THEN '' ELSE 'm' || vec_id END AS memory, CASE WHEN vec_id % 2 = 0 THEN '{}' ELSE '{"a":1}' END AS metadata FROM embeddings""",
    ),
    "memory_ingest": (
        lambda s, d: V.remember(memories(s, d), C.messages(s, d).select((F.col("session_id") * 1000 + F.col("pos") + 10**6).alias("id"), F.col("session_id").alias("user_id"), F.to_json(F.struct("role", "content")).alias("memory"))).groupBy("user_id").agg(F.count("*").alias("n_memories"), F.count("metadata").alias("n_metadata")),
        "SELECT user_id, count(*) AS n_memories, count(m) AS n_metadata FROM (SELECT label::BIGINT AS user_id, CASE WHEN vec_id % 2 = 1 THEN 1 END AS m FROM embeddings UNION ALL SELECT conv_id, NULL FROM conversations) GROUP BY 1",
    ),
    "memory_rerank": (
        reranked,
        """SELECT query_id, id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (
          SELECT q.vec_id AS query_id, m.vec_id AS id, round(list_dot_product(q.embedding::DOUBLE[], m.embedding::DOUBLE[]), 6) AS score FROM embeddings q JOIN embeddings m ON m.label = q.label WHERE q.vec_id % 20 = 0)) WHERE rank <= 5""",
    ),
    "ledger_counters": (
        lambda s, d: added(s, d)[0],
        f"""{ADDED} SELECT b.provider_id, b.owner_user_id, id * 10 + coalesce(u, 0) AS usage_tokens, id + coalesce(d.b, 0) AS billable_usage_tokens
          FROM b LEFT JOIN d ON d.provider_id = b.provider_id AND d.owner_user_id IS NOT DISTINCT FROM b.owner_user_id""",
    ),
    "ledger_refused": (
        lambda s, d: added(s, d)[1],
        f"""{ADDED} SELECT provider_id, owner_user_id, u AS usage_tokens, b AS billable_usage_tokens, 'PROVIDER_NOT_FOUND' AS error
          FROM d WHERE NOT EXISTS (SELECT 1 FROM b WHERE d.provider_id = b.provider_id AND d.owner_user_id IS NOT DISTINCT FROM b.owner_user_id)""",
    ),
    "scalar_functions": (scalars, SCALARS),
    "weighted_pick": (picks, PICKS),
    "attempts_and_access": (outcomes, OUTCOMES),
}
