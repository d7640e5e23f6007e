"""Filtering of URLs by the reputation of their hosts, with empirical-Bayes shrinkage and rules that override it.

Labelled pages count as trials of their host, bad ones as hits. The share of bad pages of a host is shrunk towards that
of its registered domain, this one towards its public suffix, and this one towards all pages: each level has a
beta-binomial prior whose mean is the parent's posterior mean and whose strength is fitted to all units of the level by
moments. A host is blocked when the lower bound of its posterior lies above the share of bad pages that is tolerated.

Rows without a URL, or with one that has no ``://``, have an empty host and path and count as one host. NULL page ids
stay in the result and are never labelled. Repeated pages are judged and counted one by one; of several outcomes of a
page the worst counts. Without any outcome nothing is blocked but by rules. Empty tables give empty results; further
columns of the inputs are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citewell.llm.common import cut, joined_evenly

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Labels before a country's two letters that belong to the public suffix.
SECOND_LEVEL = ("ac", "co", "com", "edu", "gov", "net", "org")
#: Share of bad pages that is tolerated, and how many standard deviations the bound lies below the posterior mean.
TOLERATED = 0.3
DEVIATIONS = 1.645
#: Bounds of the correlation of two pages of one unit, and its value where no unit has two labelled pages.
LEAST, MOST, UNKNOWN = 0.001, 0.5, 0.1


def host_of(url: Column) -> Column:
    """What stands between the first ``://`` and the next ``/``, ``?``, ``#`` or the end, A-Z in lower case; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def machine_of(host: Column) -> Column:
    """The host without user, port and final dot."""
    return F.regexp_replace(F.regexp_replace(host, "^.*@", ""), r"\.?(:[0-9]*)?$", "")


def suffix_of(host: Column) -> Column:
    """The last label, with the one before where that belongs to a country's suffix; empty for addresses in figures."""
    machine = machine_of(host)
    national = F.regexp_extract(machine, rf"[^.]\.((?:{'|'.join(SECOND_LEVEL)})\.[a-z]{{2}})$", 1)
    return F.when(machine.rlike(r"^[0-9.]*$|[\[\]]"), F.lit("")).when(national != "", national).otherwise(F.substring_index(machine, ".", -1))


def domain_of(host: Column) -> Column:
    """The suffix and the label before it, or the machine itself where there is none."""
    machine, suffix = machine_of(host), suffix_of(host)
    depth = F.size(F.split(suffix, r"\."))
    return F.when(suffix == "", machine).when(depth == 2, F.substring_index(machine, ".", -3)).otherwise(F.substring_index(machine, ".", -2))


def split_urls(pages: DataFrame) -> DataFrame:
    """page_id, host and path."""
    return pages.select(F.col("page_id").cast("bigint").alias("page_id"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))


def host_counts(pages: DataFrame, outcomes: DataFrame) -> DataFrame:
    """host, domain, suffix, labelled pages ``n`` and bad ones ``k`` of every host of ``pages`` (page_id, host).

    Pages are counted by (page_id, host) before they meet their outcomes, so that no hot host travels.
    """
    worst = outcomes.where("page_id IS NOT NULL AND bad IS NOT NULL").groupBy(F.col("page_id").cast("bigint").alias("page_id")).agg(F.max(F.col("bad").cast("int")).alias("bad"))
    seen = pages.groupBy("page_id", "host").agg(F.count("*").alias("rows")).join(worst, "page_id", "left")
    counts = seen.groupBy("host").agg(F.sum(F.when(F.col("bad").isNotNull(), F.col("rows")).otherwise(0)).alias("n"), F.sum(F.col("rows") * F.coalesce("bad", F.lit(0))).alias("k"))
    return counts.withColumns({"domain": domain_of(F.col("host")), "suffix": suffix_of(F.col("host"))})


def shrunk(units: DataFrame) -> DataFrame:
    """``units`` (with n, k and prior mean ``prior``) with posterior mean and variance, ``mean`` and ``variance``.

    The squared distance of k from n * prior is n * prior * (1 - prior) * (1 + (n - 1) * rho) on average; rho solves this
    for the sums over all units, and (1 - rho) / rho is the number of pages that the prior weighs.
    """
    n, k, prior = F.col("n"), F.col("k"), F.col("prior")
    over = (k - n * prior) * (k - n * prior) / (prior * (1 - prior)) - n
    rho = correlation(*units.agg(F.sum(over), F.sum(n * (n - 1))).first())
    weight = (1 - rho) / rho
    a, b = prior * weight + k, (1 - prior) * weight + (n - k)
    mean = a / (a + b)
    return units.withColumns({"mean": mean, "variance": mean * (1 - mean) / (a + b + 1)})


def correlation(over: float | None, pairs: int | None) -> float:
    return min(max(round(over / pairs, 6), LEAST), MOST) if pairs else UNKNOWN


def reputation(counts: DataFrame) -> DataFrame:
    """host, domain, suffix, n, k, mean and variance of the bad share of every host of ``host_counts``."""
    counts = cut(counts, "host-counts")
    n, k = counts.agg(F.sum("n"), F.sum("k")).first()
    sums = (F.sum("n").alias("n"), F.sum("k").alias("k"))
    suffixes = shrunk(counts.groupBy("suffix").agg(*sums).withColumn("prior", F.lit(((k or 0) + 0.5) / ((n or 0) + 1))))
    domains = counts.groupBy("suffix", "domain").agg(*sums)
    domains = cut(shrunk(joined_evenly(domains, suffixes.select("suffix", F.col("mean").alias("prior")), ["suffix"])), "domain-shares")
    hosts = joined_evenly(counts, domains.select("suffix", "domain", F.col("mean").alias("prior")), ["suffix", "domain"])
    return shrunk(hosts).drop("prior")


def rules_of_hosts(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """host and the rules (longest first) of itself and of all hosts that it is a subdomain of.

    The host and each part after a dot meet the rules' hosts by equality. All rules of one host stand in one row.
    """
    whole = F.concat("host", "path")
    by_host = rules.where("host IS NOT NULL AND path IS NOT NULL AND verdict IS NOT NULL").groupBy(F.col("host").alias("rule_host")).agg(F.collect_set(F.struct((-F.length(whole)).alias("order"), (-F.length("host")).alias("depth"), whole.alias("rule"), F.col("path"), F.col("verdict"))).alias("rules"))
    labels = F.split("host", r"\.")
    parts = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    met = hosts.select("host", F.explode(F.array_distinct(parts)).alias("rule_host")).join(by_host, "rule_host")
    return met.groupBy("host").agg(F.array_sort(F.flatten(F.collect_list("rules"))).alias("rules"))


def judged(pages: DataFrame, outcomes: DataFrame, rules: DataFrame, tolerated: float = TOLERATED, deviations: float = DEVIATIONS) -> DataFrame:
    """page_id, host, path, rule, verdict (allow or block), and the bound of the host's bad share, of every page.

    ``outcomes`` has page_id and bad (boolean or 0/1), ``rules`` host, path and verdict. A rule fits its host and all
    subdomains if the path of the URL starts with its path; the longest fitting rule decides, without one the host's
    reputation. Pages of one host are dealt over many tasks.
    """
    urls = split_urls(pages)
    shares = reputation(host_counts(urls, outcomes))
    bound = F.col("mean") - deviations * F.sqrt("variance")
    hosts = shares.select("host", bound.alias("bad_bound")).join(rules_of_hosts(shares.select("host"), rules), "host", "left")
    fitting = F.get(F.filter("rules", lambda r: F.startswith(F.col("path"), r["path"])), F.lit(0))
    found = joined_evenly(urls, cut(hosts, "hosts"), ["host"]).withColumn("_rule", fitting)
    verdict = F.coalesce(F.col("_rule.verdict"), F.when(F.col("bad_bound") > tolerated, F.lit("block")).otherwise(F.lit("allow")))
    return found.select("page_id", "host", "path", F.col("_rule.rule").alias("rule"), verdict.alias("verdict"), "bad_bound")


def sql(rules: list[tuple[str, str, str]]) -> str:
    """DuckDB SQL for page_id, host, path, rule and verdict, where ``labels`` of the same id are the pages' outcomes."""

    def level(source: str, prior: str) -> str:
        return f"""
            SELECT *, (prior * weight + k) / (weight + n) AS mean FROM (
                SELECT *, (1 - rho) / rho AS weight FROM (
                    SELECT *, CASE WHEN sum(n * (n - 1)) OVER () > 0 THEN least(greatest(round(
                        sum((k - n * prior) * (k - n * prior) / (prior * (1 - prior)) - n) OVER () / sum(n * (n - 1)) OVER (), 6), {LEAST}), {MOST})
                        ELSE {UNKNOWN} END AS rho FROM (SELECT t.*, {prior} AS prior FROM {source})))"""

    values = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in rules)
    return rf"""
        WITH urls AS (
            SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), '{UPPER}', '{LOWER}') AS host,
                coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages
        ), worst AS (
            SELECT doc_id AS page_id, max(CAST(quality = 0 OR toxic = 1 AS INTEGER)) AS bad FROM labels GROUP BY doc_id
        ), counts AS (
            SELECT host, count(bad) AS n, CAST(coalesce(sum(bad), 0) AS BIGINT) AS k FROM urls LEFT JOIN worst USING (page_id) GROUP BY host
        ), machines AS (
            SELECT *, regexp_replace(regexp_replace(host, '^.*@', ''), '\.?(:[0-9]*)?$', '', 'g') AS machine FROM counts
        ), parts AS (
            SELECT *, CASE WHEN regexp_matches(machine, '^[0-9.]*$|[\[\]]') THEN ''
                WHEN regexp_matches(machine, '[^.]\.({'|'.join(SECOND_LEVEL)})\.[a-z]{{2}}$') THEN array_to_string(list_slice(string_split(machine, '.'), -2, -1), '.')
                ELSE string_split(machine, '.')[-1] END AS suffix FROM machines
        ), hosts AS (
            SELECT *, CASE WHEN suffix = '' THEN machine
                ELSE array_to_string(list_slice(string_split(machine, '.'), -1 - len(string_split(suffix, '.')), -1), '.') END AS domain FROM parts
        ), suffixes AS ({level("(SELECT suffix, sum(n) AS n, sum(k) AS k FROM hosts GROUP BY suffix) AS t", "(SELECT (sum(k) + 0.5) / (sum(n) + 1) FROM hosts)")}
        ), domains AS ({level("(SELECT suffix, domain, sum(n) AS n, sum(k) AS k FROM hosts GROUP BY suffix, domain) AS t JOIN suffixes AS s ON t.suffix = s.suffix", "s.mean")}
        ), shares AS ({level("(SELECT host, suffix, domain, n, k FROM hosts) AS t JOIN domains AS d ON t.suffix = d.suffix AND t.domain = d.domain", "d.mean")}
        ), rules(rule_host, rule_path, rule_verdict) AS (VALUES {values}), fitting AS (
            SELECT host, path, max_by(rule_host || rule_path, length(rule_host || rule_path)) AS rule, max_by(rule_verdict, length(rule_host || rule_path)) AS rule_verdict
            FROM (SELECT DISTINCT host, path FROM urls) JOIN rules
                ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY host, path
        )
        SELECT page_id, u.host, u.path, rule, coalesce(rule_verdict,
            CASE WHEN mean - {DEVIATIONS} * sqrt(mean * (1 - mean) / (weight + n + 1)) > {TOLERATED} THEN 'block' ELSE 'allow' END) AS verdict
        FROM urls AS u JOIN shares USING (host) LEFT JOIN fitting AS f ON u.host = f.host AND u.path = f.path
    """
