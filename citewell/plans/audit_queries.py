"""Audit ledger, retention, tenant deletion, key status."""

from __future__ import annotations

from pyspark.sql import functions as F

from citewell.operators import audit, ingest
from citewell.plans import inputs as i
from citewell.plans.catalog import query
from citewell.plans.crawl_queries import GATE, gated
from citewell.plans.usage_queries import DUE, swept
from citewell.sources.tables import cut

def now():
    return i.later(i.start(), days=F.lit(380))



def ledger(spark, sf):
    """The request log as audit rows; the length of request ids varies from 12 to 71."""
    r = i.requests(spark, sf)
    return r.select(
        "tenant_id", F.lit("api").alias("actor"), F.concat(F.lit("call_"), F.col("k") % 4).alias("action"), F.col("endpoint").alias("resource"),
        F.rpad("request_id", (F.col("k") * 3 % 60 + 12).cast("int"), "x").alias("request_id"), "ts",
        F.to_json(F.struct("response_status")).alias("detail"), "event_id",
    )


LEDGER = i.REQUESTS + """,
ledger AS (SELECT tenant_id, 'call_' || k % 4 AS action, endpoint AS resource, rpad(request_id, k * 3 % 60 + 12, 'x') AS request_id, ts, event_id, k FROM requests)"""


@query("U1_accepted", i.cte(LEDGER, select="SELECT event_id, request_id FROM ledger WHERE length(request_id) BETWEEN 16 AND 64"))
def accepted(spark, sf):
    return audit.validate_audit(ledger(spark, sf))[0].select("event_id", "request_id")


@query("U1_rejected", i.cte(LEDGER, select="SELECT event_id, request_id FROM ledger WHERE length(request_id) NOT BETWEEN 16 AND 64"))
def rejected(spark, sf):
    return audit.validate_audit(ledger(spark, sf))[1].select("event_id", "request_id")


@query("U2_expired", i.cte(LEDGER, select="SELECT event_id FROM ledger WHERE ts < TIMESTAMP '2024-01-01' + INTERVAL 380 DAY - INTERVAL 365 DAY"))
def expired(spark, sf):
    return audit.retention_split(ledger(spark, sf), now())[1].select("event_id")


@query("U2_kept", i.cte(LEDGER, select="SELECT event_id FROM ledger WHERE NOT ts < TIMESTAMP '2024-01-01' + INTERVAL 380 DAY - INTERVAL 370 DAY"))
def kept(spark, sf):
    return audit.retention_split(ledger(spark, sf), now(), 370)[0].select("event_id")


def _deletion(spark, sf):
    """Tenants whose number ends in 3 or 8 leave; of all tenants, those with many errors are on hold."""
    r = i.requests(spark, sf)
    tenants = r.groupBy("tenant_id").agg(F.count_if(F.col("response_status") >= 500).alias("errors")).select(
        "tenant_id", i.later(i.start(), days=(F.col("errors") * 40).cast("int")).alias("legal_hold_until")
    )
    leaving = tenants.where(F.col("tenant_id").rlike("[38]$")).select("tenant_id")
    tables = {
        "metering": r.where("response_status = 200").select("tenant_id", "request_id"),
        "sessions": i.sessions(spark, sf).select("tenant_id", "session_id"),
    }
    return audit.delete_tenants(tables, ledger(spark, sf), tenants, leaving, now())


DELETION = LEDGER + ",\n" + i.SESSIONS + """,
holds AS (SELECT tenant_id, TIMESTAMP '2024-01-01' + to_days(CAST(count(*) FILTER (response_status >= 500) * 40 AS INT)) > TIMESTAMP '2024-01-01' + INTERVAL 380 DAY AS held
          FROM requests GROUP BY tenant_id),
leaving AS (SELECT * FROM holds WHERE regexp_matches(tenant_id, '[38]$'))"""


@query("U3_remaining_audit", i.cte(DELETION, select="SELECT event_id, tenant_id FROM ledger WHERE tenant_id NOT IN (SELECT tenant_id FROM leaving WHERE NOT held)"))
def remaining_audit(spark, sf):
    return _deletion(spark, sf)[0]["audit"].select("event_id", "tenant_id")


@query(
    "U3_remaining_metering",
    i.cte(DELETION, select="SELECT tenant_id, request_id FROM requests WHERE response_status = 200 AND tenant_id NOT IN (SELECT tenant_id FROM leaving)"),
)
def remaining_metering(spark, sf):
    return _deletion(spark, sf)[0]["metering"]


@query("U3_preserved", i.cte(DELETION, select="SELECT event_id, 'retention_required' AS reason FROM ledger WHERE tenant_id IN (SELECT tenant_id FROM leaving WHERE held)"))
def preserved(spark, sf):
    return _deletion(spark, sf)[1].select("event_id", "reason")


@query(
    "G10_deletion_summary",
    i.cte(
        DELETION,
        select="""SELECT tenant_id, table_name, CAST(deleted AS BIGINT) AS deleted, CAST(preserved AS BIGINT) AS preserved FROM (
          SELECT tenant_id, 'metering' AS table_name, count(*) AS deleted, 0 AS preserved FROM requests JOIN leaving USING (tenant_id) WHERE response_status = 200 GROUP BY tenant_id
          UNION ALL SELECT tenant_id, 'sessions', count(*), 0 FROM sessions JOIN leaving USING (tenant_id) GROUP BY tenant_id
          UNION ALL SELECT tenant_id, 'audit', count(*) FILTER (NOT held), count(*) FILTER (held) FROM ledger JOIN leaving USING (tenant_id) GROUP BY tenant_id)""",
    ),
)
def deletion_summary(spark, sf):
    return _deletion(spark, sf)[2]


def keys(spark, sf):
    """A key per customer; the balance decides its prefix, when it ended and when it was revoked."""
    c = i.table(spark, sf, "customer")
    cents = F.floor(F.abs(F.col("c_acctbal")) * 100)
    return c.select(
        F.concat(F.lit("k"), "c_custkey").alias("key_id"), F.concat(F.lit("key"), F.lpad(F.col("c_custkey").cast("string"), 7, "0")).alias("key_prefix"),
        F.concat(F.lit("t"), "c_nationkey").alias("tenant_id"),
        F.when(cents % 3 == 0, i.later(i.start(), days=(cents % 40).cast("int"))).alias("expires_at"),
        F.when(cents % 5 < 2, i.later(i.start(), days=(cents % 31).cast("int"))).alias("revoked_at"),
        F.when(cents % 7 != 0, (cents % 86_400 + 1).cast("int")).alias("rotation_grace_seconds"),
    )


def presented(spark, sf):
    """What events presented: good headers, none, another scheme, a short prefix, or a key under a foreign prefix."""
    e = i.events(spark, sf)
    owner = F.col("event_id") % 2000
    token = F.concat(F.lit("key"), F.lpad(owner.cast("string"), 7, "0"), F.lit("_secret"))
    header = (
        F.when(F.col("k") < 5, F.lit(None)).when(F.col("k") < 10, F.concat(F.lit("Basic "), token)).when(F.col("k") < 15, "Bearer key_secret")
        .when(F.col("k") < 20, F.concat(F.lit("Bearer x"), token)).otherwise(F.concat(F.lit("bearer  "), token))
    )
    return e.select(
        F.concat(F.lit("req-"), "event_id").alias("request_id"), header.alias("authorization"), F.concat(F.lit("k"), owner).alias("key_id"), "ts", "event_id"
    )


KEYS = i.EVENTS + """,
keys AS (
  SELECT 'k' || c_custkey AS key_id, 't' || c_nationkey AS tenant_id,
         CASE WHEN cents % 3 = 0 THEN TIMESTAMP '2024-01-01' + to_days(CAST(cents % 40 AS INT)) END AS expires_at,
         CASE WHEN cents % 5 < 2 THEN TIMESTAMP '2024-01-01' + to_days(CAST(cents % 31 AS INT)) END AS revoked_at,
         CASE WHEN cents % 7 <> 0 THEN cents % 86400 + 1 ELSE 3600 END AS grace
  FROM (SELECT *, CAST(floor(abs(c_acctbal) * 100) AS BIGINT) AS cents FROM customer)),
checked AS (
  SELECT event_id, CASE WHEN k < 10 THEN 'missing_token' WHEN k < 20 OR key_id IS NULL THEN 'invalid_token' WHEN ts > expires_at THEN 'expired_token'
           WHEN ts > revoked_at + to_seconds(grace) THEN 'revoked_token' ELSE 'ok' END AS status,
         CASE WHEN k >= 20 THEN coalesce(tenant_id, '-') ELSE '-' END AS tenant_id
  FROM ev LEFT JOIN keys ON key_id = 'k' || event_id % 2000)"""


@query("U4_key_status", i.cte(KEYS, select="SELECT 'req-' || event_id AS request_id, status, tenant_id FROM checked"))
def key_status(spark, sf):
    found = audit.key_status(presented(spark, sf), keys(spark, sf))
    return found.select("request_id", "status", F.coalesce("tenant_id", F.lit("-")).alias("tenant_id"))


@query(
    "U5_audit_actions",
    "WITH RECURSIVE " + i.ATTEMPTS + KEYS[len(i.EVENTS):] + ",\n" + i.SESSIONS + ",\n" + ",\n".join(GATE) + """,
    ordered AS (SELECT *, row_number() OVER w AS rn, us - lag(us) OVER w AS gap FROM attempts WINDOW w AS (PARTITION BY key ORDER BY us, attempt_id)),
    spaced AS (SELECT *, coalesce(gap >= 60000000 AND lag(gap) OVER (PARTITION BY key ORDER BY rn) >= 60000000, FALSE) AS spaced FROM ordered),
    walk AS (
      SELECT key, rn, CASE WHEN ok THEN 0 ELSE 1 END AS n, FALSE AS routed FROM spaced WHERE rn = 1
      UNION ALL
      SELECT s.key, s.rn, CASE WHEN s.ok OR (w.n + 1 >= 3 AND s.spaced) THEN 0 ELSE w.n + 1 END, NOT s.ok AND w.n + 1 >= 3 AND s.spaced
      FROM walk w JOIN spaced s ON s.key = w.key AND s.rn = w.rn + 1)
    SELECT action, actor, resource, count(*) AS n FROM (
      SELECT 'auth_failure' AS action, 'anonymous' AS actor, '/v1/search' AS resource FROM checked WHERE status <> 'ok'
      UNION ALL SELECT 'index_failure', 'indexer', key FROM walk WHERE routed
      UNION ALL SELECT 'session_expired', 'session_sweep', CAST(session_id AS VARCHAR) FROM sessions WHERE """ + DUE + """
      UNION ALL SELECT decision, 'crawler', url FROM gated WHERE decision <> 'allowed') GROUP BY ALL""",
)
def audit_actions(spark, sf):
    auth = audit.key_status(presented(spark, sf), keys(spark, sf)).withColumn("resource", F.lit("/v1/search"))
    expired_sessions = swept(spark, sf)[2].withColumn("resource", F.col("resource").cast("string"))
    from citewell.operators.crawl import gate_audit

    rows = audit.audit_actions(auth, ingest.retry_decisions(cut(i.attempts(spark, sf))), expired_sessions, gate_audit(gated(spark, sf), "CiteBot"))
    return rows.groupBy("action", "actor", "resource").agg(F.count("*").alias("n"))


@query(
    "U6_append_only_check",
    i.cte(LEDGER, select="SELECT event_id, action FROM ledger WHERE action = 'call_1' AND k < 40"),
)
def append_only_check(spark, sf):
    """A later ledger in which some rows were changed: those are the rows lost."""
    before = ledger(spark, sf).select("event_id", "action", "request_id")
    k = i.events(spark, sf).select("event_id", "k")
    after = before.join(k, "event_id").withColumn(
        "action", F.when((F.col("action") == "call_1") & (F.col("k") < 40), "edited").otherwise(F.col("action"))
    ).select(*before.columns)
    return audit.lost_rows(before, after).select("event_id", "action")
