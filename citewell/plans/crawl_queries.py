"""Opt-outs, robots.txt, the fetch gate and politeness."""

from __future__ import annotations

from pyspark.sql import functions as F

from citewell.functions import urls
from citewell.operators import crawl
from citewell.plans import inputs as i
from citewell.plans.catalog import query
from citewell.sources.tables import cut

AGENT = "CiteBot"
def now():
    return i.later(i.start(), days=F.lit(1), secs=F.lit(120))

_BODIES = [
    "User-agent: *\nDisallow: /en/\nCrawl-delay: 5\n",
    "# rules\nUser-agent: citebot\nUser-agent: other # both\nDisallow: /*.html$\n\nUser-agent: *\nDisallow: /fr/\nDisallow: /es\ncrawl-delay: 0.25",
    "User-agent: *\nDisallow:\nUser-Agent: CITEBOT\nDisallow: /es/\nAllow: /es/1\nCrawl-delay: x\nno colon here\nUser-agent: *\nDisallow: /en/*3",
    "Disallow: /de/\r\nCrawl-delay: 7\r\nUser-agent: citebot\r\nAllow: /\r\n",
    "User-agent: citebot\nDisallow: /\n",
]


def _sql_text(body: str) -> str:
    return "'" + body.replace("\r", "").replace("\n", "' || chr(10) || '") + "'"


def hosts(spark, sf):
    """A robots.txt per crawled host and pass: which one, and with what status, depends on the host's name."""
    p = i.pages(spark, sf).select(urls.host(F.col("url")).alias("host"), "page_id")
    h = p.groupBy("host").agg(F.min("page_id").alias("first"))
    n = F.length("host")
    body = F.element_at(F.array(*[F.lit(b) for b in _BODIES]), (n % 5 + 1).cast("int"))
    status = F.when(n % 7 == 0, 503).when(n % 7 == 1, 404).when(n % 7 != 2, 200)
    return h.select("host", i.later(i.start(), secs=F.col("first")).alias("fetched_at"), status.alias("status"), body.alias("body"))


HOST = "lower(regexp_extract(url, '//([^/?#:]+)', 1))"
HOSTS = f"""hosts AS (
  SELECT host, TIMESTAMP '2024-01-01' + to_seconds(first) AS fetched_at,
         CASE length(host) % 7 WHEN 0 THEN 503 WHEN 1 THEN 404 WHEN 2 THEN NULL ELSE 200 END AS status,
         CASE length(host) % 5 {' '.join(f'WHEN {k} THEN {_sql_text(b)}' for k, b in enumerate(_BODIES))} END AS body
  FROM (SELECT {HOST} AS host, min(page_id) AS first FROM pages GROUP BY 1))"""
# A user-agent line opens a group when the line before it that matters is a rule.
RULES = """lines AS (
  SELECT host, n, lower(trim(split_part(l, ':', 1))) AS name, trim(substr(l, instr(l, ':') + 1)) AS value FROM (
    SELECT host, trim(split_part(u.l, '#', 1)) AS l, u.n FROM hosts, unnest(string_split(body, chr(10))) WITH ORDINALITY AS u(l, n))
  WHERE contains(l, ':')),
significant AS (
  SELECT *, name <> 'user-agent' AS is_rule FROM lines
  WHERE name = 'user-agent' OR name = 'allow' OR (name = 'disallow' AND value <> '')),
openings AS (
  SELECT *, CASE WHEN NOT is_rule AND coalesce(lag(is_rule) OVER (PARTITION BY host ORDER BY n), FALSE) THEN 1 ELSE 0 END AS opens FROM significant),
grouped AS (SELECT *, sum(opens) OVER (PARTITION BY host ORDER BY n) AS g FROM openings),
-- Rules before any agent line belong to everybody, also after an agent joins the group.
agents AS (
  SELECT host, g, lower(value) AS agent FROM grouped WHERE NOT is_rule
  UNION ALL
  SELECT host, g, '*' FROM (SELECT host, g, arg_min(is_rule, n) AS leads FROM grouped GROUP BY ALL) WHERE leads),
rules AS (
  SELECT d.host, a.agent, d.value AS pattern FROM grouped d JOIN agents a ON a.host = d.host AND a.g = d.g WHERE d.name = 'disallow'),
delays AS (
  SELECT host, arg_max(CAST(value AS DOUBLE), n) AS delay FROM lines
  WHERE name = 'crawl-delay' AND regexp_full_match(value, '[0-9.]+') GROUP BY host)"""


def opt_outs(spark, sf):
    """Domains of hosts that look like spam, registered when their pages were crawled."""
    p = i.pages(spark, sf).where(F.col("url").rlike("spam|pills"))
    domain = F.concat(F.lit(" "), F.upper(urls.registrable_domain(urls.host(F.col("url")))))
    return p.select(domain.alias("domain"), F.col("fetched_at").alias("registered_at"))


OPT_OUTS = f"""opted AS (
  SELECT regexp_extract({HOST}, '([^.]+\\.[^.]+)$', 1) AS domain, min(fetched_at) AS since FROM pg WHERE regexp_matches(url, 'spam|pills') GROUP BY 1)"""


@query(
    "C1_opt_out",
    i.cte(
        i.PAGES, OPT_OUTS,
        select=f"""SELECT page_id, coalesce(TIMESTAMP '2024-01-02 00:02:00' >= since + INTERVAL 24 HOUR, FALSE) AS opted_out
        FROM pg LEFT JOIN opted ON domain = regexp_extract({HOST}, '([^.]+\\.[^.]+)$', 1)""",
    ),
)
def opt_out(spark, sf):
    return crawl.opt_out_active(i.pages(spark, sf), opt_outs(spark, sf), now()).select("page_id", "opted_out")


@query("C2_robots_rules", i.cte(HOSTS, RULES, select="SELECT host, agent, pattern, count(*) AS n FROM rules GROUP BY ALL"))
def robots_rules(spark, sf):
    parsed = crawl.parse_robots(hosts(spark, sf))
    return parsed.groupBy("host", "agent", "pattern").agg(F.count("*").alias("n"))


@query("C2_crawl_delays", i.cte(HOSTS, RULES, select="SELECT host, coalesce(delay, -1) AS delay FROM hosts LEFT JOIN delays USING (host)"))
def crawl_delays(spark, sf):
    return hosts(spark, sf).select("host", F.coalesce(crawl.robots_rules(F.col("body"))["crawl_delay"], F.lit(-1.0)).alias("delay"))


PATH = "CASE WHEN regexp_extract(url, '//[^/?#]*([^?#;]*)', 1) = '' THEN '/' ELSE regexp_extract(url, '//[^/?#]*([^?#;]*)', 1) END"
# These patterns have one star and paths match them in one way only, so a regular expression says the same.
HITS = "regexp_matches(path, '^' || replace(replace(regexp_escape(regexp_replace(pattern, '\\$$', '')), '\\*', '.*'), '\\$', '') || CASE WHEN pattern LIKE '%$' THEN '$' ELSE '' END)"
MATCHED = f"""paths AS (SELECT page_id, {HOST} AS host, {PATH} AS path FROM pages),
applicable AS (
  SELECT host, pattern FROM rules r WHERE agent = 'citebot'
  UNION ALL
  SELECT host, pattern FROM rules r WHERE agent = '*' AND NOT EXISTS (SELECT 1 FROM rules o WHERE o.host = r.host AND o.agent = 'citebot')),
verdicts AS (
  SELECT page_id, p.host, path, NOT EXISTS (SELECT 1 FROM applicable a WHERE a.host = p.host AND {HITS}) AS allowed FROM paths p)"""


@query("C3_robots_match", i.cte(HOSTS, RULES, MATCHED, select="SELECT page_id, allowed FROM verdicts"))
def robots_match(spark, sf):
    rules = crawl.parse_robots(hosts(spark, sf))
    return crawl.match_robots(i.pages(spark, sf), rules, AGENT).select("page_id", "allowed")


@query(
    "C4_path_match",
    i.cte(
        """paths AS (SELECT page_id, """ + PATH + """ AS path FROM pages), patterns AS (SELECT unnest(['/en', '/*.html$', '/*/4', '*5', '/fr/$', '/*/*9*1']) AS pattern)""",
        select="""SELECT page_id, pattern, CASE pattern WHEN '/en' THEN path LIKE '/en%' WHEN '/*.html$' THEN path LIKE '/%.html'
          WHEN '/*/4' THEN path LIKE '/%/4%' WHEN '*5' THEN path LIKE '%5%' WHEN '/fr/$' THEN path = '/fr/' ELSE path LIKE '/%/%9%1%' END AS matches
        FROM paths, patterns""",
    ),
)
def path_match(spark, sf):
    patterns = ["/en", "/*.html$", "/*/4", "*5", "/fr/$", "/*/*9*1"]
    p = i.table(spark, sf, "pages").select("page_id", urls.path(F.col("url")).alias("path"), F.explode(F.array(*map(F.lit, patterns))).alias("pattern"))
    return p.select("page_id", "pattern", crawl.path_matches(F.col("path"), F.col("pattern")).alias("matches"))


def robots_log(spark, sf):
    """Every host's robots.txt again 30 hours later, with another status."""
    first = hosts(spark, sf)
    again = first.withColumn("fetched_at", i.later(F.col("fetched_at"), hours=F.lit(30))).withColumn(
        "status", F.when(F.length("host") % 3 == 0, 500).otherwise(200)
    )
    return first.unionByName(again)


ASOF = """robots_log AS (
  SELECT host, fetched_at, status FROM hosts UNION ALL
  SELECT host, fetched_at + INTERVAL 30 HOUR, CASE WHEN length(host) % 3 = 0 THEN 500 ELSE 200 END FROM hosts),
asks AS (SELECT page_id, pass, """ + HOST + """ AS host, fetched_at + pass * INTERVAL 20 HOUR AS at FROM pg, (SELECT unnest([0, 1, 2]) AS pass))"""


def requests_in_time(spark, sf):
    p = i.pages(spark, sf).withColumn("pass", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    return p.select("page_id", "url", "pass", i.later(F.col("fetched_at"), hours=F.col("pass") * 20).alias("requested_at"))


@query(
    "C5_robots_as_of",
    i.cte(
        i.PAGES, HOSTS, ASOF,
        select=f"""SELECT page_id, pass, CASE WHEN l.fetched_at > a.at - INTERVAL 24 HOUR THEN {i.TS_TEXT('l.fetched_at')} ELSE 'none' END AS robots_at,
        CASE WHEN l.fetched_at > a.at - INTERVAL 24 HOUR THEN CASE WHEN coalesce(status, 999) < 500 THEN 'available' ELSE 'unavailable' END ELSE 'unknown' END AS state
        FROM asks a ASOF LEFT JOIN robots_log l ON l.host = a.host AND a.at >= l.fetched_at""",
    ),
)
def robots_as_of(spark, sf):
    known = crawl.robots_as_of(requests_in_time(spark, sf), robots_log(spark, sf))
    state = F.when(F.col("available"), "available").when(~F.col("available"), "unavailable").otherwise("unknown")
    return known.select("page_id", "pass", F.coalesce(i.ts_text(F.col("robots_fetched_at")), F.lit("none")).alias("robots_at"), state.alias("state"))


GATED = """gated AS (
  SELECT v.page_id, p.url, h.host, CASE
      WHEN coalesce(TIMESTAMP '2024-01-02 00:02:00' >= o.since + INTERVAL 24 HOUR, FALSE) THEN 'domain_opted_out'
      WHEN coalesce(h.status, 999) >= 500 THEN 'robots_unavailable'
      WHEN h.status < 400 AND NOT v.allowed THEN 'disallowed_by_robots' ELSE 'allowed' END AS decision,
    greatest(1.0, CASE WHEN h.status < 400 THEN coalesce(d.delay, 1.0) ELSE 1.0 END) AS effective_delay
  FROM verdicts v JOIN pages p USING (page_id) JOIN hosts h ON h.host = v.host LEFT JOIN delays d ON d.host = v.host
  LEFT JOIN opted o ON o.domain = regexp_extract(v.host, '([^.]+\\.[^.]+)$', 1))"""
GATE = [i.PAGES, HOSTS, RULES, MATCHED, OPT_OUTS, GATED]


def gated(spark, sf):
    return crawl.fetch_gate(i.pages(spark, sf), opt_outs(spark, sf), hosts(spark, sf), AGENT, now())


@query("C6_fetch_gate", i.cte(*GATE, select="SELECT page_id, decision FROM gated"))
def fetch_gate(spark, sf):
    return gated(spark, sf).select("page_id", "decision")


@query("C6_gate_audit", i.cte(*GATE, select="SELECT decision AS action, url AS resource, 'crawler' AS actor FROM gated WHERE decision <> 'allowed'"))
def gate_audit(spark, sf):
    return crawl.gate_audit(gated(spark, sf), AGENT).select("action", "resource", "actor")


@query("C7_effective_delay", i.cte(*GATE, select="SELECT page_id, CAST(effective_delay AS DOUBLE) AS effective_delay, CAST(greatest(1, least(8, length(host) - 18)) AS INT) AS in_flight FROM gated"))
def effective_delay(spark, sf):
    return gated(spark, sf).select("page_id", "effective_delay", crawl.effective_concurrency(F.length("host") - 18).alias("in_flight"))


def fetch_log(spark, sf):
    """Events as fetches: users are hosts, values seconds of work, times 2000 times as fast."""
    e = i.events(spark, sf)
    base = F.unix_micros(i.start())
    begun = base + F.floor((F.unix_micros("ts") - base) / 2000)
    done = begun + F.floor(F.col("value") * 1_000_000)
    return e.select(
        F.concat(F.lit("h"), F.col("user_id") % 20).alias("host"), F.col("event_id").alias("fetch_id"),
        F.timestamp_micros(begun).alias("started_at"), F.timestamp_micros(done).alias("ended_at"),
    )


@query(
    "C8_politeness",
    """WITH log AS (SELECT 'h' || user_id % 20 AS host, event_id AS fetch_id,
        1704067200000000 + (epoch_us(ts) - 1704067200000000) // 2000 AS s,
        1704067200000000 + (epoch_us(ts) - 1704067200000000) // 2000 + CAST(floor(value * 1000000) AS BIGINT) AS e FROM events),
    edges AS (SELECT host, fetch_id, s AS moment, 1 AS step, NULL::BIGINT AS done FROM log UNION ALL SELECT host, fetch_id, e, -1, e FROM log),
    line AS (SELECT *, sum(step) OVER w AS in_flight, max(done) OVER w AS last_end FROM edges
             WINDOW w AS (PARTITION BY host ORDER BY moment, step, fetch_id))
    SELECT host, fetch_id, CAST(in_flight AS BIGINT) AS in_flight, coalesce(round((moment - last_end) / 1e6, 6), -1) AS gap_seconds FROM line WHERE step = 1""",
)
def politeness(spark, sf):
    found = crawl.politeness(cut(fetch_log(spark, sf)), 60)
    return found.select("host", "fetch_id", "in_flight", F.coalesce(F.round("gap_seconds", 6), F.lit(-1.0)).alias("gap_seconds"))


@query(
    "join_interval",
    i.cte(
        i.PAGES, HOSTS, ASOF,
        select="SELECT page_id, pass, count(l.host) AS fetches FROM asks a LEFT JOIN robots_log l ON l.host = a.host AND l.fetched_at BETWEEN a.at - INTERVAL 24 HOUR AND a.at GROUP BY ALL",
    ),
)
def join_interval(spark, sf):
    """Robots fetches of a request's host in the day before: equal host, time in a range."""
    asks = requests_in_time(spark, sf).withColumn("host", urls.host(F.col("url")))
    log = robots_log(spark, sf).select(F.col("host").alias("h"), "fetched_at")
    near = F.col("fetched_at").between(F.col("requested_at") - F.make_dt_interval(hours=F.lit(24)), F.col("requested_at"))
    joined = asks.join(log, (F.col("host") == F.col("h")) & near, "left")
    return joined.groupBy("page_id", "pass").agg(F.count("h").alias("fetches"))
