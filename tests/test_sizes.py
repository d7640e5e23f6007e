"""Tables of the size and shape that larger copies have: shared URLs, many queries, large texts."""

import datetime as dt
import functools

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_point
from citewell.functions.vectors import hash_embedding
from citewell.llm import common
from citewell.operators import ingest, lexical, search
from citewell.sources import tables

T0 = dt.datetime(2024, 1, 1)


def test_contents_of_one_instant_share_a_number_however_they_arrived(spark):
    rows = [("a", "u", 1, "x", T0), ("a", "u", 2, "y", T0), ("a", "u", 3, "x", T0), ("a", "u", 4, "z", T0 + dt.timedelta(hours=1)), ("b", "v", 1, "x", T0)]
    stored = spark.createDataFrame(rows, "document_id string, source_url string, version bigint, content_hash string, created_at timestamp")
    got = {tuple(r) for r in ingest.contents_by_instant(stored).collect()}
    assert got == {("a", "u", 1, "x"), ("a", "u", 1, "y"), ("a", "u", 2, "z"), ("b", "v", 1, "x")}


def test_find_similar_tells_the_versions_of_a_url_apart(spark):
    """Two pages of one URL, one page whose URL is another's canonical form: a request that names a version means that page."""
    pages = [(1, "https://a.org/x", "one"), (2, "https://a.org/x", "two"), (3, "https://a.org/y", "one"), (4, "https://a.org/z", "two"), (5, "https://a.org/x?utm_source=f", "two")]
    d = spark.createDataFrame(pages, "version int, source_url string, cleaned_text string").select(
        ingest.document_id(F.col("source_url")).alias("document_id"), "version", "source_url", "cleaned_text",
        F.lit(None).cast("struct<credibility_score:double,ai_generated_likelihood:double,scored_at:timestamp>").alias("provenance"), F.lit(True).alias("visible"),
    )
    vectors = d.select("document_id", "version", hash_embedding(F.col("cleaned_text"), 16).alias("embedding"))
    asked = d.select(F.col("version").cast("bigint").alias("query_id"), F.col("source_url").alias("url"), "version")
    found, unknown = search.find_similar(asked, d, vectors, 2, F.lit(T0), dim=16)
    same = {(r.query_id, r.version) for r in found.where("score > 0.999").collect()}
    assert same == {(1, 3), (3, 1), (2, 4), (2, 5), (4, 2), (4, 5), (5, 2), (5, 4)}
    assert unknown.count() == 0
    # Without a version, the latest page of a URL is meant.
    found, unknown = search.find_similar(asked.select("query_id", "url").where("query_id = 1").union(spark.createDataFrame([(9, "https://b.org/")])), d, vectors, 2, F.lit(T0), dim=16)
    assert {(r.query_id, r.version) for r in found.where("score > 0.999").collect()} == {(1, 4), (1, 5)}
    assert [r.query_id for r in unknown.collect()] == [9]


def test_find_similar_settles_its_sources_once(spark, monkeypatch):
    """More queries than are collected: what they ask for is not computed again in the plan of the search."""
    monkeypatch.setattr(search.neighbours, "knn", functools.partial(search.neighbours.knn, broadcast_queries=1))
    d = spark.createDataFrame([(k, f"https://a.org/{k}", f"text {k % 3}") for k in range(9)] + [(9, "https://a.org/9", " ")], "version int, source_url string, cleaned_text string").select(
        ingest.document_id(F.col("source_url")).alias("document_id"), "version", "source_url", "cleaned_text",
        F.lit(None).cast("struct<credibility_score:double,ai_generated_likelihood:double,scored_at:timestamp>").alias("provenance"), F.lit(True).alias("visible"),
    )
    vectors = tables.cut(d.where("version < 9").select("document_id", "version", hash_embedding(F.col("cleaned_text"), 16).alias("embedding")))
    found, _ = search.find_similar(d.select(F.col("version").cast("bigint").alias("query_id"), F.col("source_url").alias("url")), d, vectors, 2, F.lit(T0), dim=16)
    assert {(r.query_id, r.version) for r in found.collect()} == {(a, b) for a in range(9) for b in range(9) if a != b and (a - b) % 3 == 0}
    assert "embed(" not in found._jdf.queryExecution().executedPlan().toString()


def test_unknown_urls_read_no_text(spark):
    d = spark.createDataFrame([("https://a.org/x",)], "source_url string")
    asked = spark.createDataFrame([(1, "https://a.org/x"), (2, "https://b.org/x"), (3, "HTTPS://A.org/x#top")], "query_id bigint, url string")
    assert {r.query_id for r in search.unknown_urls(asked, d).collect()} == {2}


def test_no_more_candidates_are_kept_than_a_query_asks_for(spark, monkeypatch):
    """Lists are as long as the longest that is asked for, not as the longest that may be."""
    kept = []
    for module, name, place in ((search.neighbours, "knn", 2), (search.lexical, "bm25", 3)):
        of = getattr(module, name)
        monkeypatch.setattr(module, name, lambda *args, of=of, place=place: kept.append(args[place]) or of(*args))
    d = spark.createDataFrame([(f"d{k}", 1, f"cat {k % 4} dog") for k in range(30)], "document_id string, version int, cleaned_text string")
    entries = lexical.lexical_entries(d)
    asked = spark.createDataFrame([(1, "cat 3", "hybrid", 2), (2, "dog 1", "keyword", 3), (3, "cat 2 dog", "neural", 1)], "query_id bigint, query_text string, mode string, num_results int")
    found = search.candidates(asked, d, d.select("document_id", "version", hash_embedding(F.col("cleaned_text"), 16).alias("embedding")), entries, lexical.corpus_stats(entries), dim=16)
    assert {r.query_id: r["count"] for r in found.groupBy("query_id").count().collect()} == {1: 4, 2: 6, 3: 2}
    assert kept == [6, 6]
    none = search.candidates(asked.limit(0), d, d.select("document_id", "version", hash_embedding(F.col("cleaned_text"), 16).alias("embedding")), entries, lexical.corpus_stats(entries), dim=16)
    assert none.count() == 0


@pytest.mark.parametrize("bounds", [{}, {"BROADCAST_TERMS": 2, "CELL_TERMS": 4, "CELL_TOKENS": 40, "HELD_SCORES": 12}])
def test_entries_scored_where_they_lie_equal_postings(spark, monkeypatch, bounds):
    """Copies tie across every cut; one text has no term, one query none that occurs. Neither way shuffles a posting or a part of a score."""
    for name, value in bounds.items():
        monkeypatch.setattr(lexical, name, value)
    texts = ["cat dog cat", "dog bird", "the", "cat dog cat", "bird bird cat fish", "dog bird", "fish", "cat dog cat"] * 4
    d = spark.createDataFrame([(f"d{k * 7 % 32:02d}", 1 + k % 2, t) for k, t in enumerate(texts)], "document_id string, version int, cleaned_text string")
    q = spark.createDataFrame([(1, "cat the dog"), (2, "dog dog bird"), (3, "whale"), (4, "fish cat"), (5, " ")], "query_id bigint, query_text string")
    entries = lexical.lexical_entries(d).repartition(3)
    stats, posts = lexical.corpus_stats(entries), lexical.postings(entries)
    rows = lambda df, c: sorted((r.query_id, r.document_id, r.version, round(r[c], 8)) for r in df.collect())
    scores = lexical.bm25_scores(q, entries, stats)
    assert rows(scores, "raw_score") == rows(lexical.bm25_scores(q, posts, stats), "raw_score")
    for n in (1, 3, 50):
        got, want = (sorted(tuple(r) for r in lexical.bm25(q, x, stats, n).collect()) for x in (entries, posts))
        assert got == want
    plan = scores._jdf.queryExecution().executedPlan().toString()
    assert bounds or "Exchange" not in plan.replace("Exchange RoundRobin", "")


def test_batches_for_python_are_bounded_by_bytes(spark, tmp_path):
    """Forty texts of 1 MB reach Python a few at a time; a smaller bound of the session stays."""
    spark.createDataFrame([(k, "x" * 2**20) for k in range(40)], "k int, text string").coalesce(1).write.parquet(f"{tmp_path}/texts.parquet")
    was = spark.conf.get(tables.BATCH_BYTES)
    try:
        df = tables.table(spark, str(tmp_path), "texts")
        sizes = df.mapInArrow(lambda batches: (pa.record_batch([pa.array([b.nbytes])], names=["n"]) for b in batches), "n bigint")
        found = [r.n for r in sizes.collect()]
        assert max(found) <= tables.PYTHON_BATCH_BYTES + 2 * 2**20 and sum(found) >= 40 * 2**20
        spark.conf.set(tables.BATCH_BYTES, "1m")
        tables.bounded_batches(spark)
        assert spark.conf.get(tables.BATCH_BYTES) in ("1m", "1048576b")
    finally:
        spark.conf.set(tables.BATCH_BYTES, was)


def test_postings_are_counted_where_a_text_lies(spark):
    """Frequencies of every (document, term), without a shuffle; texts without terms give none."""
    texts = ["cat dog cat", "", "the", None, "dog " * 3000 + "bird"]
    d = spark.createDataFrame([(f"d{k}", 1, t) for k, t in enumerate(texts)], "document_id string, version int, cleaned_text string")
    found = lexical.postings(lexical.lexical_entries(d))
    assert {tuple(r) for r in found.collect()} == {("d0", 1, 3, "cat", 2), ("d0", 1, 3, "dog", 1), ("d4", 1, 3001, "dog", 3000), ("d4", 1, 3001, "bird", 1)}
    assert found.schema["tf"].dataType.typeName() == "long" and "Exchange" not in found._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("terms", [lexical.BROADCAST_TERMS, 2])
def test_blocks_are_rows_that_are_scored_where_they_lie(spark, monkeypatch, terms):
    """Copies tie across blocks and at the cut; a block is one row, and no posting is shuffled to score it."""
    monkeypatch.setattr(lexical, "BROADCAST_TERMS", terms)
    texts = ["cat dog cat", "dog bird", "the", "cat dog cat", "bird bird cat fish", "dog bird", "fish", "cat dog cat"] * 8
    d = spark.createDataFrame([(f"d{k * 7 % 64:02d}", 1, t) for k, t in enumerate(texts)], "document_id string, version int, cleaned_text string")
    q = spark.createDataFrame([(1, "cat the dog"), (2, "dog dog bird"), (3, "whale"), (4, "fish cat"), (5, " ")], "query_id bigint, query_text string")
    entries = tables.cut(lexical.lexical_entries(d))
    stats, path = lexical.corpus_stats(entries), tables.shared_dir(spark, "blocks-rows")
    tops = lexical.block_postings(entries, stats, path, 8)
    found, _ = lexical.block_max_bm25(q, tops, stats, path, 5)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, lexical.bm25(q, entries, stats, 5).select(*found.columns).collect()))
    stored = spark.read.parquet(path)
    assert 1 < stored.count() == stored.select("block").distinct().count() <= 8
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join") == 0


@pytest.mark.parametrize("terms", [lexical.BROADCAST_TERMS, 3])
def test_fields_of_a_document_are_scored_together(spark, monkeypatch, terms):
    """The better field of each document, absent titles included, as the fields' own scores tell; no pair is shuffled."""
    monkeypatch.setattr(lexical, "BROADCAST_TERMS", terms)
    bodies = ["cat dog cat", "dog bird", "the", "cat dog cat", "bird bird cat fish", "dog bird", "fish", "cat dog cat"] * 4
    d = spark.createDataFrame(
        [(f"d{k * 7 % 32:02d}", 1 + k % 2, [None, "", "dog", "cat fish"][k % 4], t) for k, t in enumerate(bodies)], "document_id string, version int, title string, body string"
    )
    q = spark.createDataFrame([(1, "cat the dog"), (2, "dog dog bird"), (3, "whale"), (4, "fish cat")], "query_id bigint, query_text string")
    best: dict = {}
    for field, boost in (("title", 2.0), ("body", 1.0)):
        filled = d.select("document_id", "version", F.coalesce(field, F.lit("")).alias("t"))
        e = lexical.lexical_entries(filled, "t")
        for r in lexical.bm25_scores(q, lexical.postings(e), lexical.corpus_stats(e)).collect():
            key = (r.query_id, r.document_id, r.version)
            best[key] = max(best.get(key, 0), round(r.raw_score, 9) * boost)
    want = [(k, *key, round(s, 8)) for n in (1, 2, 4) for k, (key, s) in enumerate(sorted(((k[0:3], s) for k, s in best.items() if k[0] == n), key=lambda x: (-round(x[1], 8), x[0]))[:5], 1)]
    found = search.fielded_bm25(q, d, 5, {"title": 2.0, "body": 1.0})
    assert sorted((r["rank"], r.query_id, r.document_id, r.version, round(r.score, 8)) for r in found.collect()) == sorted(want)
    assert "Aggregate" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_latest_versions_are_found_without_sorting_texts(spark):
    """A number given twice keeps one row, a missing one is the last; texts meet keys in a hash join."""
    rows = [("a", 1, "x"), ("a", 2, "y"), ("b", 1, "x"), ("c", 3, "p"), ("c", 3, "q"), ("c", 1, "r"), (None, 1, "n"), ("d", None, "s"), ("d", 1, "t"), ("e", None, "u")]
    d = spark.createDataFrame(rows, "document_id string, version int, cleaned_text string").repartition(3)
    found = ingest.latest_of_stored(d)
    got = sorted((tuple(r) for r in found.collect()), key=str)
    assert [r[:2] for r in got] == sorted(((r.document_id, r.version) for r in ingest.latest_versions(d).collect()), key=str)
    assert {r[2] for r in got} - {"p", "q"} == {"y", "x", "n", "t", "u"} and len(got) == 6
    assert found._jdf.queryExecution().executedPlan().toString().count("ShuffledHashJoin") >= 2


def test_operators_for_training_data_bound_what_python_gets(spark, tmp_path):
    """Also where a stage of the pipeline is given its documents."""
    spark.createDataFrame([(k, "x" * 2**20) for k in range(20)], "doc_id bigint, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    size = lambda piece: pa.record_batch([pa.array([piece.num_rows])], names=["n"])
    largest = lambda batches: (pa.record_batch([pa.array([b.nbytes])], names=["n"]) for b in batches)
    was = spark.conf.get(tables.BATCH_BYTES)
    try:
        for bounded in (common.texts_of, lambda d: common.mapped(d, size, "n bigint") and d, lambda d: common.read(spark, str(tmp_path), "documents")):
            spark.conf.set(tables.BATCH_BYTES, "64m")
            found = [r.n for r in bounded(spark.read.parquet(f"{tmp_path}/documents.parquet")).mapInArrow(largest, "n bigint").collect()]
            assert max(found) <= tables.PYTHON_BATCH_BYTES + 2 * 2**20 and sum(found) >= 20 * 2**20
    finally:
        spark.conf.set(tables.BATCH_BYTES, was)


@pytest.mark.parametrize("name", ["A3_highlight_fallback", "P8_first_highlight"])
def test_texts_without_a_highlight(spark, tmp_path, name):
    """Empty and NULL texts have no span at all."""
    docs = pq.read_table("/root/testdata/sf0.001/documents.parquet")
    odd = [{"doc_id": 900_000 + k, "text": t, "lang": "en", "source": "src1", "n_chars": len(t or "")} for k, t in enumerate(["", None, " ", "a ZyX", "THE"])]
    pq.write_table(pa.concat_tables([docs, pa.Table.from_pylist(odd, docs.schema)]), tmp_path / "documents.parquet")
    got = entry_point.queries()[name](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet'")
    expected = con.execute(f"SELECT {', '.join(f'{chr(34)}{c}{chr(34)}' for c in got.columns)} FROM ({entry_point.oracle_sql()[name]})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(expected)
