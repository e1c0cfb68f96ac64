"""Queries over models, providers, mappings and usage, with their DuckDB forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import registry as R
from ..operators import tools as X
from ..operators import usage as U
from ..sources import catalog as C
from .chat import NOW, now

MODEL = """SELECT p_partkey AS id, p_name AS display_name, p_brand AS vendor, p_size % 4 AS type, 1 + p_size % 3 AS billing_ratio, (p_size % 7) * 1000 AS ctx, (p_size % 5) * 512 AS outp, p_type <> 'ECONOMY' AS is_active FROM part"""
PROV = "SELECT s_suppkey AS id, s_name AS name, 'key-' || s_suppkey AS api_key, s_acctbal >= 0 AS is_active FROM supplier"
MAP = """SELECT l_partkey AS model_id, l_suppkey AS provider_id, l_linenumber::BIGINT AS priority, l_returnflag = 'A' AS is_preferred, l_linestatus = 'O' AS is_active, l_shipdate AS created_at
  FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_returnflag, l_linestatus) AS rn FROM lineitem) WHERE rn = 1"""
RESOLVE = f"""WITH m AS ({MODEL}), p AS ({PROV}),
  best AS (SELECT model_id, provider_id FROM (SELECT *, row_number() OVER (PARTITION BY model_id ORDER BY is_preferred DESC, priority, created_at, provider_id) AS rn FROM ({MAP}) WHERE is_active) WHERE rn = 1),
  r AS (SELECT m.id AS model_id, best.provider_id, p.name, CASE WHEN NOT m.is_active THEN 'MODEL_NOT_FOUND' WHEN best.provider_id IS NULL THEN 'MAPPING_NOT_FOUND' WHEN p.id IS NULL THEN 'PROVIDER_NOT_FOUND' WHEN NOT p.is_active THEN 'PROVIDER_INACTIVE' ELSE 'OK' END AS status
    FROM m LEFT JOIN best ON best.model_id = m.id LEFT JOIN p ON p.id = best.provider_id)"""
ORDER = "is_active DESC, is_preferred DESC, priority, created_at, provider_id"


def nested(spark, d):
    out = R.models_with_mappings(C.models(spark, d), C.mappings(spark, d))
    return out.select(F.col("id").alias("model_id"), F.size("mappings").cast("long").alias("n_mappings"), F.array_join(F.transform("mappings", lambda m: m["provider_id"].cast("string")), ",").alias("provider_ids"))


def resolved(spark, d):
    return R.resolve(C.models(spark, d), C.mappings(spark, d), C.providers(spark, d))


def wishes(spark, d):
    """Bind every model to a provider it may not have yet; some wishes are inactive, some not preferred."""
    return C.models(spark, d).where("id % 3 = 0").select(F.col("id").alias("model_id"), (F.col("id") % 10 + 1).alias("provider_id"), (F.col("id") % 2 == 0).alias("is_preferred"), (F.col("id") % 4 != 0).alias("is_active"))


def unbound(spark, d):
    return C.mappings(spark, d).where("is_preferred AND model_id % 2 = 0").select("model_id", "provider_id")


def sparse(spark, d):
    change = C.models(spark, d).where("id % 4 = 0").select("id", F.expr("if(id % 8 = 0, array('vendor', 'display_name'), array('vendor'))").alias("present"), F.expr("if(id % 8 = 0, null, 'Other')").alias("vendor"), F.lit("Renamed").alias("display_name"))
    rows = C.models(spark, d).select("id", "display_name", "vendor", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz").alias("updated_at"))
    return R.sparse_update(rows, change, "id", ["display_name", "vendor"], now())


def duplicates(spark, d):
    old = C.models(spark, d).where("id % 2 = 0").select("id", "display_name")
    return R.insert_unique(old, C.models(spark, d).where("id % 2 = 1").select("id", "display_name"), ["display_name"], ["id"])[1]


def usage(spark, d, events=None):
    """Each event is a turn's usage, of the model its user and event number give."""
    e = C.events(spark, d) if events is None else events
    m = C.models(spark, d).select(F.col("id").alias("mid"), "display_name", "type", "billing_ratio")
    n = F.col("event_id") % C.models(spark, d).agg(F.count("*")).scalar() + 1
    joined = e.withColumn("mid", n).join(m, "mid")
    return U.billed(
        joined.select(
            (F.col("mid") % 7).alias("provider_id"), "user_id", F.col("event_id").alias("trace_id"), F.col("display_name").alias("model_name"), F.col("type").alias("model_type"), F.col("billing_ratio").cast("long").alias("billing_ratio"), F.floor("value").cast("long").alias("usage_tokens"), F.expr("if(event_type = 'click', 'USER', 'SYSTEM')").alias("scope"), "ts"
        )
    )


USE = f"""SELECT (m.id % 7) AS provider_id, e.user_id, e.event_id AS trace_id, m.display_name AS model_name, m.type::BIGINT AS model_type, m.billing_ratio::BIGINT AS billing_ratio, floor(e.value)::BIGINT AS usage_tokens,
  CASE WHEN event_type = 'click' THEN 'USER' ELSE 'SYSTEM' END AS scope, CASE WHEN event_type = 'click' THEN 0 ELSE floor(e.value)::BIGINT * m.billing_ratio END AS billable_tokens, ts FROM events e JOIN ({MODEL}) m ON m.id = e.event_id % (SELECT count(*) FROM part) + 1"""


def in_use(spark, d):
    asked = C.providers(spark, d).select((F.col("id") * 2).alias("provider_id"))
    return R.delete_providers(C.providers(spark, d), asked, C.mappings(spark, d))


def cascade(spark, d):
    left_models, left_mappings = R.delete_models(C.models(spark, d), C.mappings(spark, d), C.models(spark, d).where("id % 5 = 0").select(F.col("id").alias("model_id")))
    return left_mappings.groupBy("model_id").agg(F.count("*").alias("n_mappings")).join(left_models.select(F.col("id").alias("model_id")), "model_id", "full_outer")


def instances(spark, d):
    """Suppliers as service instances: the nation is the service, every seventh belongs to a developer."""
    s = C.table(spark, d, "supplier")
    return s.select(F.col("s_nationkey").alias("service"), F.col("s_suppkey").alias("instance"), F.expr("if(s_suppkey % 7 = 0, 'dev', null)").alias("developer"), (F.col("s_acctbal") >= 0).alias("healthy"), F.lit(None).cast("boolean").alias("enabled"))


def pool_requests(spark, d):
    return C.table(spark, d, "customer").select(F.col("c_custkey").alias("request_id"), F.col("c_nationkey").alias("service"), F.expr("if(c_custkey % 2 = 0, 'dev', null)").alias("developer"))


def picked(spark, d):
    """Every request has tried one instance."""
    known, asked = X.usable(instances(spark, d)), pool_requests(spark, d)
    tried = asked.select("request_id", (F.col("request_id") % 100 + 1).alias("instance"))
    return X.round_robin(X.without_tried(X.pools(known, asked), known, tried), known, F.col("request_id"))


POOL = """WITH i AS (SELECT s_nationkey AS service, s_suppkey AS instance, CASE WHEN s_suppkey % 7 = 0 THEN 'dev' END AS tag FROM supplier WHERE s_acctbal >= 0),
  r AS (SELECT c_custkey AS request_id, c_nationkey AS service, CASE WHEN c_custkey % 2 = 0 THEN 'dev' END AS developer FROM customer),
  j AS (SELECT r.request_id, r.service, i.instance, i.tag FROM r JOIN i ON i.service = r.service AND (i.tag IS NULL OR i.tag = r.developer)),
  pool AS (SELECT request_id, service, instance FROM (SELECT *, bool_or(tag IS NOT NULL) OVER (PARTITION BY request_id) AS own FROM j) WHERE (tag IS NOT NULL) = own)"""

Q: dict = {
    "context_budget": (
        lambda s, d: C.models(s, d).select("id", T.prompt_budget(F.col("context_window_tokens"), F.col("max_output_tokens")).alias("budget")),
        f"SELECT id, greatest(coalesce(nullif(ctx, 0), 128000) - coalesce(nullif(outp, 0), 4096), 1024)::BIGINT AS budget FROM ({MODEL})",
    ),
    "model_mappings_nested": (
        nested,
        f"""SELECT m.id AS model_id, count(x.provider_id) AS n_mappings, coalesce(string_agg(x.provider_id::VARCHAR, ',' ORDER BY x.rn), '') AS provider_ids
          FROM ({MODEL}) m LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY model_id ORDER BY {ORDER}) AS rn FROM ({MAP})) x ON x.model_id = m.id GROUP BY 1""",
    ),
    "models_by_provider": (
        lambda s, d: R.models_of_provider(C.models(s, d), C.mappings(s, d)).select("provider_id", "model_id", "place", "display_name", "model_active"),
        f"""SELECT x.provider_id, x.model_id, x.place, m.display_name, m.is_active AS model_active
          FROM (SELECT *, row_number() OVER (PARTITION BY provider_id ORDER BY is_active DESC, is_preferred DESC, priority, created_at, model_id) AS place FROM ({MAP})) x JOIN ({MODEL}) m ON m.id = x.model_id""",
    ),
    "available_models_union": (
        lambda s, d: R.available_models(C.models(s, d).where("id % 2 = 0"), C.models(s, d).where("id % 2 = 1"), C.mappings(s, d), C.providers(s, d)),
        f"""SELECT CASE WHEN m.id % 2 = 0 THEN 'system' ELSE 'user' END AS section, m.id AS model_id, m.display_name, x.provider_id, CASE WHEN m.id % 2 = 1 THEN p.name END AS provider_name
          FROM ({MODEL}) m LEFT JOIN ({MAP}) x ON x.model_id = m.id LEFT JOIN ({PROV}) p ON p.id = x.provider_id WHERE m.is_active""",
    ),
    "resolve_model": (lambda s, d: resolved(s, d).where("status = 'OK'").drop("status"), f"{RESOLVE} SELECT model_id, provider_id, name AS provider_name FROM r WHERE status = 'OK'"),
    "resolve_model_errors": (lambda s, d: resolved(s, d).groupBy("status").agg(F.count("*").alias("n_models")), f"{RESOLVE} SELECT status, count(*) AS n_models FROM r GROUP BY 1"),
    "preference_violations": (lambda s, d: R.preference_violations(C.mappings(s, d)), f"SELECT model_id, count(*) AS n_preferred FROM ({MAP}) WHERE is_preferred AND is_active GROUP BY 1 HAVING count(*) > 1"),
    "provider_list_masked": (
        lambda s, d: C.providers(s, d).select("id", "name", T.masked(F.col("api_key")).alias("api_key"), "is_active"),
        f"SELECT id, name, CASE WHEN length(api_key) <= 8 THEN repeat('*', length(api_key)) ELSE left(api_key, 4) || '***' || right(api_key, 4) END AS api_key, is_active FROM ({PROV})",
    ),
    "bind_mapping": (
        lambda s, d: R.bind(C.mappings(s, d), wishes(s, d), now()),
        f"""WITH m AS ({MAP}), w AS (SELECT id AS model_id, id % 10 + 1 AS provider_id, id % 2 = 0 AND id % 4 <> 0 AS pref, id % 4 <> 0 AS act FROM ({MODEL}) WHERE id % 3 = 0),
          j AS (SELECT coalesce(m.model_id, w.model_id) AS model_id, coalesce(m.provider_id, w.provider_id) AS provider_id, coalesce(m.priority, 0) AS priority, m.is_preferred AS old, m.is_active AS olda, w.pref, w.act, coalesce(m.created_at, TIMESTAMP '{NOW}') AS created_at
            FROM m FULL JOIN w ON m.model_id = w.model_id AND m.provider_id = w.provider_id)
          SELECT model_id, provider_id, priority, CASE WHEN act IS NOT NULL THEN pref WHEN bool_or(coalesce(pref, false)) OVER (PARTITION BY model_id) THEN false ELSE old END AS is_preferred, coalesce(act, olda) AS is_active, created_at FROM j""",
    ),
    "unbind_promote": (
        lambda s, d: R.unbind(C.mappings(s, d), unbound(s, d)).select("model_id", "provider_id", "is_preferred", "is_active"),
        f"""WITH m AS ({MAP}), gone AS (SELECT model_id, provider_id FROM m WHERE is_preferred AND model_id % 2 = 0),
          l AS (SELECT m.*, m.model_id IN (SELECT model_id FROM gone) AS lost, row_number() OVER (PARTITION BY m.model_id, is_active ORDER BY priority, created_at, m.provider_id) AS rn FROM m ANTI JOIN gone g ON g.model_id = m.model_id AND g.provider_id = m.provider_id)
          SELECT model_id, provider_id, is_preferred OR (lost AND is_active AND rn = 1) AS is_preferred, is_active FROM l""",
    ),
    "provider_delete_restrict": (
        in_use,
        f"""SELECT id * 2 AS provider_id, CASE WHEN id * 2 NOT IN (SELECT id FROM ({PROV})) THEN 'PROVIDER_NOT_FOUND' WHEN id * 2 IN (SELECT provider_id FROM ({MAP})) THEN 'PROVIDER_IN_USE' ELSE 'DELETED' END AS outcome FROM ({PROV})""",
    ),
    "model_delete_cascade": (cascade, f"SELECT m.id AS model_id, x.n AS n_mappings FROM ({MODEL}) m LEFT JOIN (SELECT model_id, count(*) AS n FROM ({MAP}) GROUP BY 1) x ON x.model_id = m.id WHERE m.id % 5 <> 0"),
    "sparse_update_model": (
        sparse,
        f"""SELECT id, CASE WHEN id % 8 = 0 THEN 'Renamed' ELSE display_name END AS display_name, CASE WHEN id % 8 = 0 THEN NULL WHEN id % 4 = 0 THEN 'Other' ELSE vendor END AS vendor,
          CASE WHEN id % 4 = 0 THEN TIMESTAMP '{NOW}' ELSE TIMESTAMP '2024-01-01 00:00:00' END AS updated_at FROM ({MODEL})""",
    ),
    "unique_conflicts": (
        duplicates,
        f"""SELECT id, display_name, 'DUPLICATE' AS error FROM (SELECT *, row_number() OVER (PARTITION BY display_name ORDER BY id) AS rn FROM ({MODEL}) WHERE id % 2 = 1)
          WHERE rn > 1 OR display_name IN (SELECT display_name FROM ({MODEL}) WHERE id % 2 = 0)""",
    ),
    "usage_ledger": (
        lambda s, d: U.ledger(usage(s, d).select("provider_id", "usage_tokens", F.col("billable_tokens"))),
        f"SELECT provider_id, sum(greatest(usage_tokens, 0))::BIGINT AS usage_tokens, sum(greatest(billable_tokens, 0))::BIGINT AS billable_usage_tokens FROM ({USE}) WHERE usage_tokens > 0 OR billable_tokens > 0 GROUP BY 1",
    ),
    "billing_events": (
        lambda s, d: U.billing_events(usage(s, d), F.col("ts")),
        f"""SELECT user_id::VARCHAR AS "userId", NULL::VARCHAR AS "groupId", usage_tokens AS "usageTokens", billing_ratio AS "billingRatio", trace_id::VARCHAR AS "traceId", model_name AS "modelName", model_type AS "modelType", strftime(ts, '%Y-%m-%dT%H:%M:%S') AS "requestTime"
          FROM ({USE}) WHERE scope = 'SYSTEM' AND usage_tokens > 0""",
    ),
    "gray_pool": (lambda s, d: X.gray_pool(instances(s, d), pool_requests(s, d)), f"{POOL} SELECT request_id, service, instance FROM pool"),
    "round_robin_pick": (
        picked,
        f"""{POOL}, p AS (SELECT * FROM pool WHERE instance <> request_id % 100 + 1)
          SELECT request_id, service, instance FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY instance) - 1 AS i, count(*) OVER (PARTITION BY request_id) AS n FROM p) WHERE i = request_id % n""",
    ),
}
