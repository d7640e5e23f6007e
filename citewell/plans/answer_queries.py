"""Contents, highlights, summaries, citations and answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from citewell.functions import highlights as hl
from citewell.functions import text
from citewell.operators import answers
from citewell.plans import inputs as i
from citewell.plans.catalog import query
from citewell.sources.tables import cut

WORDS = "the que und"


def wanted(spark, sf):
    """Requests for the documents of a label, every id asked twice in falling order, and unknown ones."""
    labels = i.table(spark, sf, "labels")
    asked = labels.select(
        F.col("doc_id").alias("request_id"),
        F.array(
            F.concat(F.lit("d"), "doc_id"), F.concat(F.lit("none"), "quality"), F.concat(F.lit("d"), F.col("doc_id") + 1), F.concat(F.lit("d"), "doc_id")
        ).alias("document_ids"),
    )
    return asked


WANTED = """asked AS (
  SELECT doc_id AS request_id, p AS position, CASE p WHEN 0 THEN 'd' || doc_id WHEN 1 THEN 'none' || quality WHEN 2 THEN 'd' || (doc_id + 1) ELSE 'd' || doc_id END AS document_id
  FROM labels, (SELECT unnest([0, 1, 2, 3]) AS p))"""


@query(
    "A1_contents",
    i.cte(
        i.DOC_VERSIONS, WANTED,
        select="""SELECT request_id, position, a.document_id, coalesce(l.version, 0) AS version, coalesce(l.source_url, '') AS url,
        coalesce(length(l.cleaned_text), -1) AS chars, CASE WHEN l.document_id IS NULL THEN 'document_not_found' ELSE 'ok' END AS error_code
        FROM asked a LEFT JOIN latest l ON l.document_id = a.document_id""",
    ),
)
def contents(spark, sf):
    found = answers.contents(wanted(spark, sf), i.doc_versions(spark, sf), F.lit(WORDS))
    return found.select(
        "request_id", "position", "document_id", F.coalesce("version", F.lit(0)).alias("version"), F.coalesce("url", F.lit("")).alias("url"),
        F.coalesce(F.length("cleaned_text"), F.lit(-1)).alias("chars"), F.coalesce("error_code", F.lit("ok")).alias("error_code"),
    )


@query(
    "L3_request_order",
    i.cte(WANTED, select="SELECT request_id, string_agg(document_id, ',' ORDER BY position) AS ids FROM asked GROUP BY request_id"),
)
def request_order(spark, sf):
    found = answers.contents(wanted(spark, sf), i.doc_versions(spark, sf), summarise=None)
    packed = found.groupBy("request_id").agg(F.array_sort(F.collect_list(F.struct("position", "document_id"))).alias("e"))
    return packed.select("request_id", F.array_join(F.transform("e", lambda e: e["document_id"]), ",").alias("ids"))


# Every place a word starts, with its end; runs of touching matches; widened to blanks; the first five.
HIGHLIGHTS = """terms AS (SELECT unnest(['the', 'que', 'und']) AS t),
hits AS (
  SELECT doc_id, text, CAST(list_sum(list_transform(p[1:n], lambda x: length(x))) AS BIGINT) + (n - 1) * length(t) AS s, length(t) AS w FROM (
    SELECT doc_id, text, t, p, unnest(range(1, len(p))) AS n FROM (
      SELECT doc_id, text, t, string_split(lower(text), t) AS p FROM documents, terms) WHERE len(p) > 1)),
ended AS (SELECT doc_id, text, s, max(s + w) AS e FROM hits GROUP BY ALL),
started AS (
  SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY doc_id ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM ended),
runs AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY s) AS run FROM started),
merged AS (SELECT doc_id, text, run, min(s) AS s, max(e) AS e FROM runs GROUP BY ALL HAVING run <= 5),
flat AS (SELECT *, replace(replace(text, chr(10), ' '), chr(9), ' ') AS f, length(text) AS n FROM merged),
placed AS (
  SELECT doc_id, run, n, CASE WHEN s - 50 <= 0 THEN 0 ELSE
      CASE WHEN instr(reverse(substr(f, 1, s - 49)), ' ') = 0 THEN 0
           WHEN s - 49 - instr(reverse(substr(f, 1, s - 49)), ' ') = 0 THEN 0
           ELSE s - 49 - instr(reverse(substr(f, 1, s - 49)), ' ') + 1 END END AS start,
    CASE WHEN e + 50 >= n THEN n WHEN instr(substr(f, e + 51), ' ') = 0 THEN n ELSE e + 50 + instr(substr(f, e + 51), ' ') - 1 END AS "end"
  FROM flat),
spans AS (
  SELECT doc_id, CAST(run AS INT) AS place, CAST(start AS BIGINT) AS start, CAST("end" AS BIGINT) AS "end" FROM placed
  UNION ALL
  SELECT doc_id, 1, 0, least(length(text), 200) FROM documents WHERE length(text) > 0 AND doc_id NOT IN (SELECT doc_id FROM hits))"""


def spans(spark, sf):
    d = i.table(spark, sf, "documents")
    return d.withColumn("spans", hl.highlights(F.col("text"), F.lit(WORDS)))


@query("A2_highlights", i.cte(HIGHLIGHTS, select='SELECT doc_id, place, start, "end" FROM spans'))
def highlights(spark, sf):
    # The outer form: the inner one filters on the array's size first and would compute the spans twice.
    placed = spans(spark, sf).select("doc_id", F.posexplode_outer("spans").alias("place", "s")).where("s IS NOT NULL")
    return placed.select(
        "doc_id", (F.col("place") + 1).alias("place"), F.col("s.start").cast("bigint").alias("start"), F.col("s.end").cast("bigint").alias("end")
    )


@query(
    "A3_highlight_fallback",
    """SELECT doc_id, least(length(text), 200) AS "end" FROM documents
    WHERE length(text) > 0 AND NOT (lower(text) LIKE '%zyx%' OR lower(text) LIKE '%the re%')""",
)
def highlight_fallback(spark, sf):
    """Words that hardly occur: the beginning of the text stands in."""
    d = i.table(spark, sf, "documents").withColumn("spans", hl.highlights(F.col("text"), F.lit("zyx")))
    plain = d.where((F.length("text") > 0) & ~F.lower("text").contains("zyx") & ~F.lower("text").contains("the re"))
    # An empty text has no span, and rows may be filtered after the place is read.
    return plain.select("doc_id", F.get("spans", 0)["end"].alias("end"))


@query("A4_valid_spans", "SELECT doc_id, TRUE AS valid, length(text) < 400 AS short FROM documents")
def valid_spans(spark, sf):
    """Spans are valid for their text, and for a text cut shorter than the last span they are not."""
    checked = spans(spark, sf).select("doc_id", hl.valid_spans(F.col("spans"), F.col("text")).alias("valid"), (F.length("text") < 400).alias("short"))
    return checked


# A terminator ends a sentence unless it is the sentence's first character.
SENTENCES = r"""list_filter(list_transform(regexp_extract_all(text, '(?s)(?:.[^.!?]*[.!?]|.+)'), lambda s: trim(s, ' ' || chr(10) || chr(9))), lambda s: s <> '')"""


@query("A5_sentences", f"SELECT doc_id, place - 1 AS place, s AS sentence FROM documents, unnest({SENTENCES}) WITH ORDINALITY AS u(s, place)")
def sentences(spark, sf):
    return i.table(spark, sf, "documents").select("doc_id", F.posexplode(text.sentences(F.col("text"))).alias("place", "sentence"))


@query(
    "A6_summary",
    f"""WITH parts AS (
      SELECT doc_id, s, place, sum(length(s) + 1) OVER (PARTITION BY doc_id ORDER BY place) AS used
      FROM documents, unnest({SENTENCES}) WITH ORDINALITY AS u(s, place))
    SELECT doc_id, coalesce(string_agg(s, ' ' ORDER BY place) FILTER (used <= 256), substr(arg_min(s, place), 1, 256)) AS summary
    FROM parts GROUP BY doc_id""",
)
def summary(spark, sf):
    """Sixty-four tokens. A later sentence never fits once one did not, as the used length only grows."""
    d = i.table(spark, sf, "documents").select("doc_id", text.summary(F.col("text"), 64).alias("summary"))
    return d.where(F.col("summary").isNotNull())


TOKENS = r"""(SELECT greatest(1, list_sum(list_transform(list_filter(regexp_split_to_array({0}, '\s+'), lambda w: w <> ''),
    lambda w: CASE WHEN length(w) <= 6 THEN 1 ELSE length(w) // 4 END))))"""


@query("A7_token_count", f"SELECT doc_id, CAST({TOKENS.format('text')} AS BIGINT) AS tokens FROM documents WHERE length(text) > 0")
def token_count(spark, sf):
    counted = i.table(spark, sf, "documents").select("doc_id", text.token_count(F.col("text")).cast("bigint").alias("tokens"))
    return counted.where("tokens > 0")


@query("A8_valid_summary", f"SELECT doc_id, {TOKENS.format('text')} BETWEEN 1 AND 512 AS valid FROM documents WHERE length(text) > 0")
def valid_summary(spark, sf):
    return i.table(spark, sf, "documents").where(F.length("text") > 0).select("doc_id", text.valid_summary(F.col("text")).alias("valid"))


def claimed(spark, sf):
    """Citations claimed by the log: sessions cite turns that may not exist, at offsets that may not fit."""
    e = i.events(spark, sf)
    return e.select(
        "event_id", (F.col("user_id") % 100).alias("answer_id"), F.concat(F.lit("turn-"), F.col("k") % 6).alias("document_id"),
        F.lit(1).alias("version"), (F.col("k") - 5).alias("answer_start"), (F.col("k") * 4).alias("answer_end"),
        (F.col("k") * 3 - 10).alias("source_start"), (F.col("k") * 3 + F.col("event_id") % 40 - 5).cast("int").alias("source_end"),
    )


@query(
    "A9_validate_citations",
    i.cte(
        i.EVENTS, i.RETRIEVAL, i.TOKENS,
        """claimed AS (
  SELECT event_id, user_id % 100 AS answer_id, 'turn-' || (k % 6) AS document_id, 1 AS version, k - 5 AS a, k * 4 AS b, k * 3 - 10 AS c,
         k * 3 + event_id % 40 - 5 AS d FROM ev)""",
        "answer_length AS (SELECT answer_id, sum(length(token)) AS n FROM tokens GROUP BY answer_id)",
        select="""SELECT event_id, CASE WHEN r.document_id IS NULL THEN 'not_in_retrieval_set'
          WHEN NOT (a >= 0 AND b > a AND b <= coalesce(n, 0)) THEN 'answer_offsets'
          WHEN NOT (c >= 0 AND d > c AND d <= length(r.cleaned_text)) THEN 'source_offsets' ELSE 'ok' END AS error_code
        FROM claimed c LEFT JOIN retrieval r ON r.answer_id = c.answer_id AND r.document_id = c.document_id
        LEFT JOIN answer_length l ON l.answer_id = c.answer_id""",
    ),
)
def validate_citations(spark, sf):
    lengths = answers.answer_texts(i.answer_tokens(spark, sf))
    checked = answers.validate_citations(claimed(spark, sf), i.retrieval(spark, sf), lengths)
    return checked.select("event_id", F.coalesce("error_code", F.lit("ok")).alias("error_code"))


DETECTED = """ends AS (
  SELECT answer_id, idx, CAST(sum(length(token)) OVER (PARTITION BY answer_id ORDER BY idx) AS BIGINT) AS e FROM tokens),
whole AS (SELECT answer_id, string_agg(token, '' ORDER BY idx) AS answer FROM tokens GROUP BY answer_id),
tails AS (
  SELECT answer_id, idx, e - least(e, 30) AS s, e, substr(answer, e - least(e, 30) + 1, least(e, 30)) AS tail
  FROM ends JOIN whole USING (answer_id) WHERE e >= 10),
detected AS (
  SELECT answer_id, idx, document_id, version, s AS answer_start, e AS answer_end, instr(cleaned_text, tail) - 1 AS source_start,
         instr(cleaned_text, tail) - 1 + e - s AS source_end
  FROM tails JOIN retrieval USING (answer_id) WHERE instr(cleaned_text, tail) > 0)"""


def detected(spark, sf):
    return answers.detect_citations(cut(i.answer_tokens(spark, sf)), i.retrieval(spark, sf))


@query("A10_detect_citations", i.cte(i.RETRIEVAL, i.TOKENS, DETECTED, select="SELECT * FROM detected"))
def detect_citations(spark, sf):
    return detected(spark, sf)


@query(
    "A11_assemble_answers",
    i.cte(
        i.RETRIEVAL, i.TOKENS, DETECTED,
        select="""SELECT w.conv_id AS answer_id, CASE WHEN code = 'ok' THEN sha256(coalesce(answer, '')) ELSE '' END AS answer,
          CASE WHEN code = 'ok' THEN coalesce(n, 0) ELSE -1 END AS citation_count, code AS error_code
        FROM (SELECT conv_id, CASE WHEN count(*) < 3 THEN 'no_sources_available' WHEN max(turn) % 4 = 1 THEN 'stream_timeout'
                WHEN max(turn) % 4 = 2 THEN 'internal_error' ELSE 'ok' END AS code FROM conversations GROUP BY conv_id) w
        LEFT JOIN whole ON whole.answer_id = w.conv_id
        LEFT JOIN (SELECT answer_id, count(*) AS n FROM detected GROUP BY answer_id) d ON d.answer_id = w.conv_id""",
    ),
)
def assemble_answers(spark, sf):
    """Conversations of two turns had no sources; some streams broke off."""
    c = i.table(spark, sf, "conversations").groupBy("conv_id").agg(F.count("*").alias("turns"), F.max("turn").alias("last"))
    endings = c.select(
        F.col("conv_id").alias("answer_id"),
        F.when(F.col("last") % 4 == 1, "stream_timeout").when(F.col("last") % 4 == 2, "socket closed").alias("failure"), "turns",
    )
    sourced = i.retrieval(spark, sf).join(endings.where("turns >= 3").select("answer_id"), "answer_id", "left_semi")
    done = answers.assemble_answers(i.answer_tokens(spark, sf), detected(spark, sf), sourced, endings)
    ok = F.col("error_code").isNull()
    return done.select(
        "answer_id", F.when(ok, F.sha2("answer", 256)).otherwise("").alias("answer"),
        F.coalesce("citation_count", F.lit(-1)).alias("citation_count"), F.coalesce("error_code", F.lit("ok")).alias("error_code"),
    )


@query(
    "A12_context",
    i.cte(
        i.RETRIEVAL,
        select="""SELECT query_id, sha256(string_agg('[' || rank || '] ' || title || ' (' || url || ')' || chr(10) || '    ' || substr(cleaned_text, 1, 200) || '...',
        chr(10) ORDER BY rank)) AS context FROM retrieval GROUP BY query_id""",
    ),
)
def context(spark, sf):
    built = answers.build_context(i.retrieval(spark, sf))
    return built.select("query_id", F.sha2("context", 256).alias("context"))
