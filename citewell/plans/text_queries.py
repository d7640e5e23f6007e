"""Personal data: detection and redaction."""

from __future__ import annotations

from pyspark.sql import functions as F

from citewell.functions import pii
from citewell.plans import inputs as i
from citewell.plans.catalog import query

# The match patterns in RE2 syntax.
EMAIL = "[a-zA-Z0-9.!#$%&''*+/=?^_`{|}~-]+@[a-zA-Z0-9](?:[a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?(?:\\.[a-zA-Z0-9](?:[a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?)+"
PHONE = "\\+(?:\\d[\\s\\-]?){1,15}\\d"
SSN = "\\b\\d{3}-\\d{2}-\\d{4}\\b|\\b\\d{9}\\b"
EU = [
    "\\b[12]\\s?\\d{2}\\s?\\d{2}\\s?\\d{2}\\s?\\d{3}\\s?\\d{3}\\s?\\d{2}\\b", "\\b\\d{8}[A-Z]\\b", "\\b[A-Z][0-9A-Z]{8}\\b",
    "\\b[A-Z]{6}\\d{2}[A-Z]\\d{2}[A-Z]\\d{3}[A-Z]\\b",
]
CARD = "\\b(?:\\d[\\s\\-]?){12,18}\\d\\b"

# Texts of three tables, so that every detector sees some matches.
TEXTS = """texts AS (
  SELECT 'd' || doc_id AS id, text FROM documents
  UNION ALL SELECT 'e' || event_id, 'Call +' || (10000000 + event_id * 7919) || ' or ' || lpad(CAST(user_id * 37 AS VARCHAR), 3, '0') || '-'
    || lpad(CAST(event_id % 100 AS VARCHAR), 2, '0') || '-' || lpad(CAST(event_id AS VARCHAR), 4, '0') || ', id ' ||
    lpad(CAST(event_id AS VARCHAR), 8, '0') || upper(substr(event_type, 1, 1)) || ' and ' || upper(substr(event_type, 1, 1)) ||
    lpad(CAST(event_id AS VARCHAR), 8, '0') || '; pay 4' || lpad(CAST(event_id * 997 AS VARCHAR), 15, '0') FROM events)"""


def texts(spark, sf):
    d = i.table(spark, sf, "documents").select(F.concat(F.lit("d"), "doc_id").alias("id"), "text")
    e = i.table(spark, sf, "events")
    pad = lambda c, n: F.lpad(c.cast("string"), n, "0")
    event_id, initial = F.col("event_id"), F.upper(F.substring("event_type", 1, 1))
    line = F.concat(
        F.lit("Call +"), (10000000 + event_id * 7919).cast("string"), F.lit(" or "), pad(F.col("user_id") * 37, 3), F.lit("-"),
        pad(event_id % 100, 2), F.lit("-"), pad(event_id, 4), F.lit(", id "), pad(event_id, 8), initial, F.lit(" and "), initial,
        pad(event_id, 8), F.lit("; pay 4"), pad(event_id * 997, 15),
    )
    return d.unionByName(e.select(F.concat(F.lit("e"), "event_id").alias("id"), line.alias("text")))


LUHN = """(list_sum(list_transform(range(length(b)), lambda j: CASE WHEN j % 2 = 0 THEN CAST(substr(reverse(b), j + 1, 1) AS INT)
  ELSE CAST(substr(reverse(b), j + 1, 1) AS INT) * 2 - CASE WHEN CAST(substr(reverse(b), j + 1, 1) AS INT) > 4 THEN 9 ELSE 0 END END)) % 10 = 0)"""
CHECKS = {
    "email": "TRUE",
    "phone": "length(ltrim(b, '+')) >= 7",
    "us_ssn": "length(b) = 9 AND substr(b, 1, 3) NOT IN ('000', '666') AND b NOT LIKE '9%' AND substr(b, 4, 2) <> '00' AND substr(b, 6) <> '0000'",
    "eu_national_id": "TRUE",
    "credit_card": f"length(b) BETWEEN 13 AND 19 AND regexp_full_match(b, '[0-9]+') AND {LUHN}",
}


def _matches(rank: int, kind: str, pattern: str) -> str:
    """Offsets from the lengths of the pieces around the matches."""
    return f"""SELECT id, text, {rank} AS rank, '{kind}' AS type, p[2 * n] AS value, replace(replace(p[2 * n], ' ', ''), '-', '') AS b,
      CAST(list_sum(list_transform(p[1:2 * n - 1], lambda x: length(x))) AS BIGINT) AS s
    FROM (SELECT id, text, p, unnest(range(1, CAST((len(p) + 1) // 2 AS BIGINT))) AS n FROM
          (SELECT id, text, string_split(regexp_replace(text, '({pattern})', chr(1) || '\\1' || chr(1), 'g'), chr(1)) AS p FROM texts)
          WHERE len(p) > 1)"""


KINDS = [("email", EMAIL), ("phone", PHONE), ("us_ssn", SSN), *[("eu_national_id", p) for p in EU], ("credit_card", CARD)]
FOUND = TEXTS + ",\nmatched AS (" + "\nUNION ALL ".join(_matches(r, k, p) for r, (k, p) in enumerate(KINDS)) + """),
accepted AS (
  SELECT id, text, rank, type, value, s, s + length(value) AS e FROM matched WHERE CASE type """ + " ".join(
    f"WHEN '{k}' THEN {c}" for k, c in CHECKS.items()
) + """ END
  -- RE2 takes only ASCII for word characters at an edge; letters of other alphabets count as well.
  AND (type IN ('email', 'phone') OR NOT (regexp_matches(substr(text, s, 1), '[\\p{L}\\p{N}_]') AND s > 0
       OR regexp_matches(substr(text, s + length(value) + 1, 1), '[\\p{L}\\p{N}_]')))),
found AS (SELECT * FROM accepted QUALIFY row_number() OVER (PARTITION BY id, s, e ORDER BY rank) = 1)"""


def _detector(name: str, kind: str):
    @query(name, i.cte(FOUND, select=f"SELECT id, s AS start, CAST(e AS BIGINT) AS \"end\", value FROM accepted WHERE type = '{kind}'"))
    def run(spark, sf):
        found = texts(spark, sf).select("id", F.explode(pii.detect_one(F.col("text"), kind)).alias("m"))
        return found.select("id", F.col("m.start").cast("bigint").alias("start"), F.col("m.end").cast("bigint").alias("end"), "m.value")


_detector("D1_email", "email")
_detector("D2_phone", "phone")
_detector("D3_us_ssn", "us_ssn")
_detector("D4_eu_national_id", "eu_national_id")
_detector("D5_credit_card", "credit_card")


@query("D6_detect_pii", i.cte(FOUND, select='SELECT id, type, s AS start, CAST(e AS BIGINT) AS "end", value FROM found'))
def detect(spark, sf):
    found = texts(spark, sf).select("id", F.explode(pii.detect_pii(F.col("text"))).alias("m"))
    return found.select(
        "id", "m.type", F.col("m.start").cast("bigint").alias("start"), F.col("m.end").cast("bigint").alias("end"), "m.value"
    )


PLACED = """CASE type WHEN 'email' THEN '[REDACTED_EMAIL]' WHEN 'phone' THEN '[REDACTED_PHONE]' WHEN 'us_ssn' THEN '[REDACTED_SSN]'
  WHEN 'eu_national_id' THEN '[REDACTED_EU_ID]' ELSE '[REDACTED_CARD]' END"""
# Replacing from the last match to the first keeps what stands before each match; the spans are replaced one after another.
REDACTED = f"""packed AS (
  SELECT id, any_value(text) AS text, list({{'s': s, 'e': CAST(e AS BIGINT), 'p': {PLACED}}} ORDER BY s DESC, e DESC) AS spans FROM found GROUP BY id),
redacted AS (
  SELECT id, text, len(spans) AS n, list_reduce(list_prepend({{'t': text, 's': 0::BIGINT, 'e': 0::BIGINT, 'p': ''}},
    list_transform(spans, lambda x: {{'t': '', 's': x.s, 'e': x.e, 'p': x.p}})),
    lambda a, x: {{'t': substr(a.t, 1, x.s) || x.p || substr(a.t, x.e + 1), 's': 0::BIGINT, 'e': 0::BIGINT, 'p': ''}}).t AS done FROM packed)"""


@query(
    "D7_redact",
    i.cte(FOUND, REDACTED, select="SELECT t.id, coalesce(r.done, t.text) AS redacted FROM texts t LEFT JOIN redacted r ON r.id = t.id"),
)
def redact(spark, sf):
    return texts(spark, sf).select("id", pii.redact(F.col("text")).alias("redacted"))


@query(
    "D8_redact_info",
    i.cte(FOUND, REDACTED, select="""SELECT t.id, length(coalesce(r.done, t.text)) AS chars, coalesce(r.n, 0) AS redactions, r.id IS NOT NULL AS had_pii
    FROM texts t LEFT JOIN redacted r ON r.id = t.id"""),
)
def redact_info(spark, sf):
    told = texts(spark, sf).select("id", pii.redact_info(F.col("text")).alias("i"))
    return told.select("id", F.length("i.redacted_text").alias("chars"), F.size("i.redactions").alias("redactions"), "i.had_pii")


@query(
    "D9_log_redaction",
    i.cte(
        TEXTS,
        select="""SELECT id, '[REDACTED]' AS password, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text,
          '[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\\.[a-zA-Z]{2,}', '[REDACTED_EMAIL]', 'g'), '\\+?1?\\d{10,15}', '[REDACTED_PHONE]', 'g'),
          '\\b\\d{3}-?\\d{2}-?\\d{4}\\b', '[REDACTED_SSN]', 'g'),
          '\\b\\d{4}[\\s-]?\\d{4}[\\s-]?\\d{4}[\\s-]?\\d{4}\\b', '[REDACTED_CREDIT_CARD]', 'g') AS message FROM texts""",
    ),
)
def log_redaction(spark, sf):
    fields = F.create_map(F.lit("Password"), F.col("id"), F.lit("message"), F.col("text"))
    logged = texts(spark, sf).select("id", pii.redact_log(fields).alias("f"))
    return logged.select("id", F.col("f.Password").alias("password"), F.col("f.message").alias("message"))
