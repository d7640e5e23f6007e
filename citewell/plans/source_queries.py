"""Sources and sinks: written in one form, read back in another."""

from __future__ import annotations

from pyspark.sql import functions as F

from citewell.operators import audit, ingest, lexical, usage
from citewell.plans import inputs as i
from citewell.plans.catalog import query
from citewell.sources import messages, tables
from citewell.streaming import jobs


@query("S1_raw_page_scan", "SELECT page_id, url, length(html) AS chars FROM pages")
def raw_page_scan(spark, sf):
    return i.table(spark, sf, "pages").select("page_id", "url", F.length("html").alias("chars"))


def _stored_versions(spark, sf):
    path = tables.shared_dir(spark, "documents")
    i.doc_versions(spark, sf).write.parquet(path)
    return path


@query(
    "S2_visible_documents",
    i.cte(i.DOC_VERSIONS, select="SELECT document_id, version, source_url, length(cleaned_text) AS chars FROM doc_versions WHERE visible"),
)
def visible_documents(spark, sf):
    found = tables.visible_documents(spark, _stored_versions(spark, sf))
    return found.select("document_id", "version", "source_url", F.length("cleaned_text").alias("chars"))


@query(
    "S3_ingest_parse",
    f"SELECT url AS source_url, sha256(html) AS content, '' AS tenant_id, coalesce(nullif(url = '', TRUE), FALSE) AS broken FROM pages",
)
def ingest_parse(spark, sf):
    path = tables.shared_dir(spark, "topic")
    messages.publish_files(messages.ingest_messages(i.table(spark, sf, "pages"), i.start()), path)
    parsed = messages.from_json_value(spark.read.text(path))
    return parsed.select(
        "source_url", F.sha2("raw_content", 256).alias("content"), "tenant_id", F.col("parse_error").isNotNull().alias("broken")
    )


@query(
    "S5_publish",
    """SELECT url AS key, substr(sha256(url || '|ingest-' || substr(sha256(url), 1, 24) || '|' || sha256(html)), 1, 32) AS message_id,
       'ingest-' || substr(sha256(url), 1, 24) AS request_id, '2024-01-01 00:00:00' AS published_at FROM pages""",
)
def publish(spark, sf):
    values = messages.to_json_value(messages.ingest_messages(i.table(spark, sf, "pages"), i.start()))
    parsed = F.from_json("value", "message_id string, request_id string, published_at timestamp")
    return values.select("key", parsed.alias("m")).select(
        "key", "m.message_id", "m.request_id", i.ts_text(F.col("m.published_at")).alias("published_at")
    )


@query(
    "S6_dead_letters",
    """SELECT item_id, CASE WHEN length(text) % 3 = 0 THEN 'missing raw_content'
         WHEN length(text) % 3 = 1 THEN 'missing raw_content, source_url, request_id' END AS error
       FROM benchmark WHERE length(text) % 3 < 2""",
)
def dead_letters(spark, sf):
    """Every third text becomes a good message, the others lack their content or are no JSON at all."""
    n = F.length("text")
    message = F.to_json(
        F.struct(F.when(n % 3 == 2, F.col("text")).alias("raw_content"), F.col("item_id").cast("string").alias("source_url"),
                 F.concat(F.lit("request-"), F.col("item_id")).alias("request_id"))
    )
    values = i.table(spark, sf, "benchmark").select(
        "item_id", F.when(n % 3 == 1, F.concat(F.lit("{broken "), F.col("item_id"))).otherwise(message).alias("value")
    )
    parsed = messages.from_json_value(values)
    bad = messages.dead_letters(parsed.where(F.col("parse_error").isNotNull()), i.start())
    return bad.select(F.regexp_extract("raw", r"(?:source_url\":\"|broken )([0-9]+)", 1).cast("bigint").alias("item_id"), "error")


@query(
    "S7_version_snapshot",
    i.cte(i.NUMBERED, select="SELECT document_id, source_url, version, content_hash FROM page_versions"),
)
def version_snapshot(spark, sf):
    """Three crawls, each merged into the parts of the version table that hold its URLs; the last one runs twice."""
    store = jobs.versions_table(spark, tables.shared_dir(spark, "store"), 16)
    seen = tables.cut(i.observations(spark, sf))
    for number in (0, 1, 2, 2):
        store.update(number, seen.where(F.col("pass") == number), lambda stored, new: ingest.merge_versions(stored, new)[0])
    return store.read().select("document_id", "source_url", "version", "content_hash")


@query(
    "S8_object_keys",
    i.cte(
        i.DOCS,
        select="""SELECT document_id, coalesce(tenant_id, '_global') || '/' || document_id || '/1/cleaned.txt' AS key,
        coalesce(tenant_id, '-') AS tenant_id, 1 AS version FROM docs""",
    ),
)
def object_keys(spark, sf):
    keyed = i.docs(spark, sf).select(
        "document_id", tables.object_key(F.col("tenant_id"), F.col("document_id"), F.col("version")).alias("key")
    )
    parsed = keyed.withColumn("p", tables.parse_object_key(F.col("key")))
    return parsed.select("p.document_id", "key", F.coalesce("p.tenant_id", F.lit("-")).alias("tenant_id"), "p.version")


@query(
    "S8_cleaned_text_store",
    i.cte(
        i.DOCS,
        select="SELECT coalesce(tenant_id, '-') AS tenant_id, document_id, sha256(cleaned_text) AS content FROM docs WHERE tenant_id IS DISTINCT FROM 'src7'",
    ),
)
def cleaned_text_store(spark, sf):
    """Written per tenant, then one tenant's partition is dropped."""
    path = tables.shared_dir(spark, "cleaned")
    tables.write_cleaned_texts(i.docs(spark, sf), path)
    tables.drop_tenant(spark, path, "src7")
    left = tables.read_cleaned_texts(spark, path)
    return left.select(
        F.coalesce("tenant_id", F.lit("-")).alias("tenant_id"), "document_id", F.sha2("cleaned_text", 256).alias("content")
    )


@query(
    "S9_vector_index",
    """SELECT 'v' || vec_id AS document_id, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 6) AS total
    FROM embeddings WHERE label <> 1""",
)
def vector_index(spark, sf):
    """Vectors written, and those with one label removed again."""
    path = tables.shared_dir(spark, "vectors")
    source = i.table(spark, sf, "embeddings").select(
        F.concat(F.lit("v"), "vec_id").alias("document_id"), F.lit(1).alias("version"), "embedding", "label"
    )
    source.write.parquet(path)
    stored = spark.read.parquet(path)
    left = ingest.remove_entries(stored, stored.where("label = 1"))
    total = F.aggregate("embedding", F.lit(0.0), lambda acc, x: acc + x.cast("double"))
    return left.select("document_id", F.round(total, 6).alias("total"))


@query(
    "S10_lexical_index",
    i.cte(
        i.DOCS,
        select=f"""SELECT document_id, t.term, count(*) AS tf FROM docs, unnest(regexp_extract_all(lower(cleaned_text), '[a-z0-9]+')) AS t(term)
        WHERE t.term NOT IN ({i.STOP_LIST}) AND language <> 'fr' GROUP BY ALL""",
    ),
)
def lexical_index(spark, sf):
    """Postings written by term, and those of French documents removed."""
    path = tables.shared_dir(spark, "postings")
    d = i.docs(spark, sf)
    tables.write_postings(lexical.postings(lexical.lexical_entries(d)), path)
    left = ingest.remove_entries(spark.read.parquet(path), d.where("language = 'fr'"))
    return left.select("document_id", "term", "tf")


@query(
    "S11_search_documents",
    i.cte(
        i.DOC_VERSIONS,
        select="""SELECT document_id, version, source_url AS url, substr(trim(split_part(cleaned_text, chr(10), 1)), 1, 100) AS title,
        round(credibility, 6) AS credibility_score, round(ai, 6) AS ai_generated_likelihood, visible FROM doc_versions""",
    ),
)
def search_documents(spark, sf):
    rows = ingest.search_documents(i.doc_versions(spark, sf))
    return rows.select(
        "document_id", "version", "url", "title", F.round("credibility_score", 6).alias("credibility_score"),
        F.round("ai_generated_likelihood", 6).alias("ai_generated_likelihood"), "visible",
    )


@query(
    "S12_audit_sink",
    i.cte(i.REQUESTS, select="SELECT tenant_id, endpoint AS resource, request_id, 'request' AS action FROM requests"),
)
def audit_sink(spark, sf):
    """Two appends: failed requests, then the others."""
    path = tables.shared_dir(spark, "audit")
    r = i.requests(spark, sf)
    rows = r.select(
        "tenant_id", F.lit("api").alias("actor"), F.lit("request").alias("action"), F.col("endpoint").alias("resource"),
        "request_id", "ts", F.to_json(F.struct("response_status")).alias("detail"), "response_status",
    )
    for part in (rows.where("response_status >= 500"), rows.where("response_status < 500")):
        good, _ = audit.validate_audit(part.drop("response_status"))
        tables.append(good, path)
    return spark.read.parquet(path).select("tenant_id", "resource", "request_id", "action")


@query(
    "S13_metering_sink",
    i.cte(
        i.RETRIED,
        select="""SELECT 'meter:' || request_id AS dedup_key, count(*) AS copies, 1 AS stored FROM retried
        WHERE response_status BETWEEN 200 AND 299 GROUP BY request_id""",
    ),
)
def metering_sink(spark, sf):
    """The log delivered twice over; each key is stored once."""
    path = tables.shared_dir(spark, "metering")
    keys = jobs.metering_keys(spark, path)
    r = i.retried_requests(spark, sf)
    for number, part in enumerate((r.where("k < 50"), r)):
        tables.append(usage.append_metering(keys, number, part), path)
    stored = spark.read.parquet(path).groupBy("dedup_key").agg(F.count("*").cast("int").alias("stored"))
    copies = usage.billable(r).groupBy(usage.dedup_key(F.col("request_id")).alias("dedup_key")).agg(F.count("*").alias("copies"))
    return stored.join(copies, "dedup_key")
