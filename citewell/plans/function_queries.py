"""Scalar functions by group, and the places where users plug in their own."""

from __future__ import annotations

from pyspark.sql import functions as F

from citewell.functions import text
from citewell.functions import vectors as vec
from citewell.operators import answers, ingest
from citewell.plans import inputs as i
from citewell.plans.catalog import query


@query(
    "fn_string",
    """SELECT p_partkey, lower(p_name) AS lowered, trim('  ' || p_brand || ' ') AS trimmed, instr(p_type, 'A') - 1 AS found,
      substr(p_name, 3, 5) AS slice, p_brand || '/' || p_type AS joined, starts_with(p_type, 'S') AS starts, contains(p_name, 'a') AS has_a,
      split_part(p_type, ' ', 1) AS first_word, reverse(p_brand) AS backwards FROM part""",
)
def fn_string(spark, sf):
    return i.table(spark, sf, "part").select(
        "p_partkey", F.lower("p_name").alias("lowered"), text.strip(F.concat(F.lit("  "), "p_brand", F.lit(" "))).alias("trimmed"),
        (F.instr("p_type", "A") - 1).alias("found"), F.substring("p_name", 3, 5).alias("slice"), F.concat_ws("/", "p_brand", "p_type").alias("joined"),
        F.col("p_type").startswith("S").alias("starts"), F.col("p_name").contains("a").alias("has_a"),
        F.substring_index("p_type", " ", 1).alias("first_word"), F.reverse("p_brand").alias("backwards"),
    )


@query(
    "fn_regex",
    """SELECT doc_id, length(regexp_replace(text, '[aeiou]+', '-', 'g')) AS replaced, len(regexp_extract_all(text, '[A-Z][a-z]+')) AS capitalised,
      coalesce(nullif(regexp_extract(text, '([a-z]+)@', 1), ''), '-') AS mailbox, regexp_matches(text, '\\d{4}') AS has_year FROM documents""",
)
def fn_regex(spark, sf):
    return i.table(spark, sf, "documents").select(
        "doc_id", F.length(F.regexp_replace("text", "[aeiou]+", "-")).alias("replaced"),
        F.regexp_count("text", F.lit("[A-Z][a-z]+")).alias("capitalised"),
        F.coalesce(F.nullif(F.regexp_extract("text", "([a-z]+)@", 1), F.lit("")), F.lit("-")).alias("mailbox"),
        F.col("text").rlike(r"\d{4}").alias("has_year"),
    )


@query("fn_hash", "SELECT doc_id, sha256(text) AS sha, md5(text) AS md5, octet_length(encode(text)) AS bytes FROM documents")
def fn_hash(spark, sf):
    bytes_ = F.encode("text", "UTF-8")
    return i.table(spark, sf, "documents").select(
        "doc_id", F.sha2("text", 256).alias("sha"), F.md5("text").alias("md5"), F.length(bytes_).cast("bigint").alias("bytes")
    )


@query("fn_decode", "SELECT page_id, sha256(html) AS same, length(html) + 1 AS longer FROM pages")
def fn_decode(spark, sf):
    """Bytes to text, with one byte that no UTF-8 text holds."""
    raw = F.encode("html", "UTF-8")
    broken = F.concat(raw, F.unhex(F.lit("ff")))
    return i.table(spark, sf, "pages").select(
        "page_id", F.sha2(text.decode_utf8(raw), 256).alias("same"), F.length(text.decode_utf8(broken)).alias("longer")
    )


@query(
    "fn_date",
    """SELECT o_orderkey, strftime(o_orderdate + INTERVAL 7 DAY, '%Y-%m-%d') AS week_later, strftime(o_orderdate + INTERVAL 90 SECOND, '%H:%M:%S') AS clock,
      date_diff('day', TIMESTAMP '1992-01-01', o_orderdate) AS age, o_orderdate >= TIMESTAMP '1995-06-01' AS late, epoch_us(o_orderdate) AS micros FROM orders""",
)
def fn_date(spark, sf):
    d = F.col("o_orderdate")
    return i.table(spark, sf, "orders").select(
        "o_orderkey", F.date_format(i.later(d, days=F.lit(7)), "yyyy-MM-dd").alias("week_later"),
        F.date_format(i.later(d, secs=F.lit(90)), "HH:mm:ss").alias("clock"), F.datediff(d, F.lit("1992-01-01").cast("timestamp")).cast("bigint").alias("age"),
        (d >= F.lit("1995-06-01").cast("timestamp")).alias("late"), F.unix_micros(d).alias("micros"),
    )


@query(
    "fn_math",
    """SELECT l_orderkey, l_linenumber, round(ln(l_quantity + 0.5), 6) AS log, round(sqrt(l_extendedprice), 6) AS root, CAST(floor(l_extendedprice / 7) AS BIGINT) AS down,
      CAST(ceil(l_extendedprice / 7) AS BIGINT) AS up, round(greatest(0.0, least(1.0, l_discount * 15)), 6) AS clamped, l_orderkey // 7 AS whole FROM lineitem""",
)
def fn_math(spark, sf):
    return i.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", F.round(F.ln(F.col("l_quantity") + 0.5), 6).alias("log"), F.round(F.sqrt("l_extendedprice"), 6).alias("root"),
        F.floor(F.col("l_extendedprice") / 7).alias("down"), F.ceil(F.col("l_extendedprice") / 7).alias("up"),
        F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("l_discount") * 15)), 6).alias("clamped"), F.floor(F.col("l_orderkey") / 7).alias("whole"),
    )


@query(
    "fn_array",
    """SELECT vec_id, round(list_inner_product(d, d), 6) AS squared, len(d) AS dims, round(list_max(d), 6) AS top, round(list_sort(d)[1], 6) AS lowest,
      len(list_filter(d, lambda x: x > 0)) AS positive, round(list_sum(d[1:8]), 6) AS head
    FROM (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS d FROM embeddings)""",
)
def fn_array(spark, sf):
    d = F.transform("embedding", lambda x: x.cast("double"))
    rows = i.table(spark, sf, "embeddings").select("vec_id", d.alias("d"))
    return rows.select(
        "vec_id", F.round(vec.dot(F.col("d"), F.col("d")), 6).alias("squared"), F.size("d").alias("dims"), F.round(F.array_max("d"), 6).alias("top"),
        F.round(F.array_sort("d")[0], 6).alias("lowest"), F.size(F.filter("d", lambda x: x > 0)).alias("positive"),
        F.round(F.aggregate(F.slice("d", 1, 8), F.lit(0.0), lambda a, x: a + x), 6).alias("head"),
    )


@query(
    "fn_map_json",
    """SELECT event_id, CAST(json_extract(props, '$.k') AS INT) AS k, len(json_keys(props)) AS keys,
      '{"id":' || event_id || ',"type":"' || event_type || '"}' AS packed FROM events""",
)
def fn_map_json(spark, sf):
    parsed = F.from_json("props", "map<string,int>")
    return i.table(spark, sf, "events").select(
        "event_id", parsed["k"].alias("k"), F.size(F.map_keys(parsed)).alias("keys"),
        F.to_json(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("type"))).alias("packed"),
    )


@query("fn_own_scorer", "SELECT doc_id, round(least(1.0, n_chars / 10000.0), 6) AS credibility, 0.25 AS ai, TRUE AS visible FROM documents")
def own_scorer(spark, sf):
    """Scoring with functions of the user's own."""
    scored = ingest.score_documents(
        i.docs(spark, sf), i.start(), credibility=lambda c: F.least(F.lit(1.0), F.length(c) / 10000.0), ai_likelihood=lambda c: F.lit(0.25)
    )
    return scored.select(
        "doc_id", F.round("provenance.credibility_score", 6).alias("credibility"), F.col("provenance.ai_generated_likelihood").alias("ai"), "visible"
    )


@query("fn_own_summary", "SELECT doc_id AS request_id, '> ' || substr(text, 1, 30) AS summary FROM documents")
def own_summary(spark, sf):
    """Contents with a summary function of the user's own."""
    asked = i.table(spark, sf, "documents").select(F.col("doc_id").alias("request_id"), F.array(F.concat(F.lit("d"), "doc_id")).alias("document_ids"))
    first = i.doc_versions(spark, sf).where("version = 1")
    found = answers.contents(asked, first, summarise=lambda c: F.concat(F.lit("> "), F.substring(c, 1, 30)))
    return found.select("request_id", "summary")
