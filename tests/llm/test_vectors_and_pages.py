"""Searches and page extraction against brute force, the pipeline, and the SQL of the queries."""

import math
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_point
import corpus_pipeline
from citewell.llm import collision_search, exact_topk, queries, wrappers
from tests.llm.test_texts import ODD as TEXTS
from tests.llm.test_texts import rows_of

FOLDER = "/root/testdata/sf0.001"
NAN, INF = float("nan"), float("inf")
ODD = [(0, [1.0, 0.5]), (10, [1.0, 0.5]), (20, [-1.0, 2.0]), (30, None), (40, []), (50, [NAN, 1.0]), (60, [INF, 0.0]), (70, [0.0, 0.0]), (80, [None, 1.0]), (None, [1.0, 1.0]), (90, [3.0]), (100, [1.0, 0.5]), (100, [1.0, 0.5])]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, "vec_id bigint, embedding array<float>").withColumns({c: F.lit(1) for c in ("block", "dim", "salt", "score", "rank", "low")})


def brute(rows, asks, k, value):
    out = []
    for q, e in dict(sorted(rows, key=lambda r: r[0], reverse=True)).items():
        if asks(q):
            best = sorted((-value(e, f), v) for v, f in rows if v != q and len(f) == len(e))[:k]
            out += [(q, i, v, -s) for i, (s, v) in enumerate(best, 1)]
    return sorted(out, key=repr)


COLUMNS = ("query_id", "rank", "vec_id", "score")


def test_exact_topk_on_odd_rows(spark, odd):
    usable = [(v, e) for v, e in ODD if v is not None and e and all(x is not None and math.isfinite(x) for x in e)]
    whole = [(v, [math.floor(256 * x) for x in e]) for v, e in usable]
    expected = brute(whole, lambda q: q % 50 == 0, 3, lambda a, b: sum(x * y for x, y in zip(a, b, strict=True)))
    assert rows_of(exact_topk.search(odd, F.col("vec_id") % 50 == 0, 3), *COLUMNS) == expected
    assert exact_topk.search(odd.limit(0), F.col("vec_id") % 50 == 0, 3).count() == 0


def test_exact_topk_with_ties_and_wide_scores(spark):
    rng = np.random.default_rng(8)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, 4) * (1000.0 if i % 7 == 0 else 1.0)]) for i in range(400)] + [(1000 + i, [2.0, 2.0, 2.0, 2.0]) for i in range(300)]
    whole = [(v, [256 * x for x in e]) for v, e in rows]
    expected = brute(whole, lambda q: q % 50 == 0, 5, lambda a, b: int(sum(x * y for x, y in zip(a, b, strict=True))))
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").repartition(3)
    assert rows_of(exact_topk.search(df, F.col("vec_id") % 50 == 0, 5), *COLUMNS) == expected


def test_scores_beyond_exact_doubles():
    big = np.array([[2.0**30, 1.0]])
    assert exact_topk.scores(big, big).tolist() == [[2**60 + 1]]


@pytest.mark.parametrize("folder", ["sf0.01", "sf0.1"])
def test_collision_search_recall(spark, folder):
    table = spark.read.parquet(f"/root/testdata/{folder}/embeddings.parquet")
    rows = table.orderBy("vec_id").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], np.float64)
    found = {}
    for r in collision_search.search(table, F.col("vec_id") % 20 == 0, 20).collect():
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    hits = total = 0
    for i in np.flatnonzero(ids % 20 == 0):
        s = x @ x[i]
        s[i] = -INF
        best = np.lexsort((ids, -s))[:20]
        got = sorted(found[ids[i]])
        assert [g[0] for g in got] == list(range(1, 21)) and [g[2] for g in got] == sorted((g[2] for g in got), reverse=True)
        assert all(g[2] == pytest.approx(s[np.searchsorted(ids, g[1])], abs=1e-12) for g in got)
        hits += len({g[1] for g in got} & set(ids[best].tolist()))
        total += 20
    assert hits / total >= 0.9


@pytest.mark.parametrize("scale", [1e-200, 1e-310, 1e150, 1.0])
def test_collision_search_ends_for_vectors_of_any_length(spark, scale):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) * scale for x in rng.normal(size=4)]) for i in range(60)]
    found = collision_search.search(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), F.col("vec_id") % 20 == 0, 5)
    assert found.count() == 15


def test_collision_search_on_odd_rows(spark, odd):
    found = collision_search.search(odd, F.col("vec_id") % 20 == 0, 20)
    # 0 and 20 ask; 100 stands twice among the candidates and asks once.
    assert rows_of(found.groupBy("query_id").count(), "query_id", "count") == [(0, 4), (100, 3), (20, 4)]
    assert collision_search.search(odd.limit(0), F.col("vec_id") % 20 == 0, 20).count() == 0


@pytest.mark.parametrize("module", [collision_search, exact_topk])
def test_queries_are_not_collected_to_meet_the_vectors(spark, module):
    """Copies of the query blocks for all parts of the vectors are many times what the queries are estimated at."""
    df = spark.range(200).select(F.col("id").alias("vec_id"), F.array(F.sin("id"), F.cos("id")).alias("embedding"))
    found = module.search(df, F.col("vec_id") % 20 == 0, 5)
    assert found.count() == 50
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()


def test_windows_end_where_they_end_step_by_step():
    rng = np.random.default_rng(4)
    shard = collision_search.Shard(np.arange(500), rng.normal(size=(500, 8)))
    centres = collision_search._projected(rng.normal(size=(40, 8))) * np.sqrt(shard.longest)
    expected = []
    for c in centres:
        half = shard.halves[0]
        while (hits := ((np.abs(shard.values - c[:, None]) < half)[np.arange(48)[:, None], shard.places].sum(axis=0) >= 32)).sum() < 100:
            half *= collision_search.GROWTH
        expected.append(hits)
    for first in (0, 5, 60):
        shard.step = first
        assert (np.vstack([shard.candidates(some, 100) for some in (centres[:32], centres[32:])]) == expected).all()


# --- pages

PAGE = (
    "<html><head><title>T</title><style>p{}</style></head><body class='page'><header><h1>Site</h1></header><nav><a>Home</a></nav><div>Read our latest news</div>"
    "<main><article><header><h1>Head {0}</h1><p>by someone</p></header><p>First &amp; best {0}<br>line <i>i</i>n<p>Second&nbsp; {0}<ul><li>one {0}<li>two {0}</ul>"
    "<p>Sign up for more</p><div class='comments'><p>nice</p></div></article></main><aside>x</aside><form><p>y</p></form><script>var a = '<p>no</p>';</script><footer>f</footer></body></html>"
)


def test_pages(spark):
    rows = [(i, f"http://Example.org/{i}", PAGE.replace("{0}", f"number {i}")) for i in range(12)]
    rows += [(100, None, PAGE.replace("{0}", "alone")), (101, "http://other.org/", None), (102, "not a url", ""), (103, "http://other.org/", "<p>open <b>end"), (None, "http://other.org/x", "<div>a<div>b</div>c</div>"), (103, "http://other.org/", "<p>open <b>end")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumns({c: F.lit("x") for c in ("host", "reference", "template", "n", "text")})
    found = {}
    for r in wrappers.main_texts(pages).collect():
        found.setdefault(r.page_id, []).append(r.text)
    assert found[3] == ["Head number 3\nFirst & best number 3 line in\nSecond number 3\none number 3\ntwo number 3"]  # without "Sign up for more"
    assert found[100] == ["Head alone\nFirst & best alone line in\nSecond alone\none alone\ntwo alone\nSign up for more"]
    assert (found[101], found[102], found[103], found[None]) == ([""], [""], ["open end"] * 2, ["a\nb\nc"])
    assert wrappers.main_texts(pages.limit(0)).count() == 0


def hosted(spark, makers, n=12, host="cms.org", start=0):
    rows = [(start + i, f"http://{host}/{i}", make(i)) for make in makers for i in range(n)]
    return spark.createDataFrame([(k, u, h) for k, (_, u, h) in enumerate(rows)], "page_id bigint, url string, html string")


def divs(i, constant=35, varying=12, kind="x"):
    """A page of nothing but div elements without telling names, most of it the same on all pages of its host."""
    menu = [f"<div>Entry {kind} {j} of the menu</div>" for j in range(constant // 2)]
    foot = [f"<div>Notice {kind} {j} below</div>" for j in range(constant - constant // 2)]
    return f"<html><body><div>{''.join(menu)}</div><div>{''.join(f'<div>{kind} paragraph {j} of page {i} says {i * 31 + j}</div>' for j in range(varying))}</div><div>{''.join(foot)}</div></body></html>"


def paragraphs(i, varying=12, kind="x"):
    return "\n".join(f"{kind} paragraph {j} of page {i} says {i * 31 + j}" for j in range(varying))


def texts_of_pages(spark, pages):
    return [r.text for r in wrappers.main_texts(pages).orderBy("page_id").collect()]


def test_a_template_larger_than_its_articles_is_induced(spark, monkeypatch):
    pages = hosted(spark, [divs])
    assert texts_of_pages(spark, pages) == [paragraphs(i) for i in range(12)]
    # The result comes through the template: without it, menus and notices stay.
    real = wrappers.templates
    monkeypatch.setattr(wrappers, "templates", lambda *tables: real(*tables).limit(0))
    without = texts_of_pages(spark, pages)
    assert all("Entry x 3 of the menu" in text and "Notice x 2 below" in text for text in without)


def test_layouts_of_a_host_have_templates_of_their_own(spark):
    """Two page types on one host, told apart by their classes, and copies that would make content look constant."""
    other = lambda i: divs(i, 20, 8, "y").replace("<body>", "<body><div class='b'>Site B</div>").replace("<div>Entry y 0", "<div class='first'>Entry y 0")
    pages = hosted(spark, [divs, other])
    assert texts_of_pages(spark, pages) == [paragraphs(i) for i in range(12)] + [paragraphs(i, 8, "y") for i in range(12)]
    copies = hosted(spark, [lambda i: divs(i if i < 6 else 3)], 40)
    assert texts_of_pages(spark, copies) == [paragraphs(i if i < 6 else 3) for i in range(40)]


def test_near_copies_keep_their_articles(spark):
    body = "".join(f"<p>Sentence {j} is the same in all copies</p>" for j in range(10))
    make = lambda i: f"<html><body><div>Our site</div><article><h1>Title</h1>{body}<p>version {i}</p></article><div>All rights</div></body></html>"
    found = texts_of_pages(spark, hosted(spark, [make], 10))
    assert all(text.splitlines() == ["Title", *(f"Sentence {j} is the same in all copies" for j in range(10)), f"version {i}"] for i, text in enumerate(found))


@pytest.mark.parametrize("page", [
    "<body><div class='content has-sidebar'><p>Text one</p><p>Text two</p></div><div class='sidebar'>side</div></body>",
    "<body><article class='post category-social tag-legal'><p>Text one</p><p>Text two</p></article><div class='site-footer'>foot</div></body>",
    "<body><form action='x'><p>Text one</p><p>Text two</p><input value='v'><button>Send</button><select><option>o</select></form></body>",
    "<body><section id='related-work'><p>Text one</p><p>Text two</p></section><nav>n</nav><div class='main-nav'>menu</div></body>",
    "<body><main><p>Text one</p></main><main><p>Text two</p></main></body>",
])
def test_names_that_only_tell_about_content_drop_nothing(page):
    assert wrappers.extract(page) == "Text one\nText two"


def test_content_beside_a_teaser_article_stays():
    page = "<body><h1>Head</h1><div><p>A long text that is the main thing on this page.</p><p>More of it.</p></div><article>teaser</article></body>"
    assert wrappers.extract(page) == "Head\nA long text that is the main thing on this page.\nMore of it.\nteaser"
    assert wrappers.extract("<body><h1>Head</h1><div>by me</div><article><p>A long text</p></article></body>") == "Head\nA long text"
    assert wrappers.extract("<body><article><p>short</p><div class='comments'><p>a very long comment of a reader, longer than all</p></div></article></body>") == "short"


def test_tree_matching_is_the_largest():
    a, b = (wrappers.parse(x) for x in ("<div><p>1<p>2<ul><li>3</ul><p>4</div>", "<div><h2>0</h2><p>1<ul><li>3<li>5</ul><p>4<p>6</div>"))
    pairs = wrappers.aligned(a, b)
    assert len(pairs) == wrappers.matching(a, b, {}) == 6
    assert [x.own_text() for x, _ in pairs if x.tag == "li"] == ["3"]


def test_articles_of_the_table(spark):
    found = {r.page_id: r for r in entry_point.queries()["op2_wrapper_induction"](spark, FOLDER).collect()}
    for r in spark.read.parquet(f"{FOLDER}/pages.parquet").collect():
        inner = r.html.split("<article>")[1].split("</article>")[0]
        plain = wrappers.html.unescape(__import__("re").sub(r"<[^>]*>", " ", inner)).split()
        assert found[r.page_id].text.split() == plain and found[r.page_id].n_chars == len(found[r.page_id].text)


# --- queries and pipeline


def rounded(frame):
    frame = frame[sorted(frame.columns)]
    return sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in frame.itertuples(index=False, name=None)), key=repr)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "labels", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    assert rounded(entry_point.queries()[name](spark, FOLDER).toPandas()) == rounded(con.execute(entry_point.oracle_sql()[name]).df())


@pytest.mark.parametrize("stage", range(5))
def test_pipeline_stages_on_odd_rows(spark, stage):
    """NULLs, empty and long texts, repeated rows, clashing columns and no rows at all."""
    docs = spark.createDataFrame(TEXTS, "doc_id bigint, text string, lang string, source string").withColumns({name: F.lit("x") for name in ("key", "hash", "label", "score", "kept", "component_id", "ids", "start", "topic")})
    docs = docs.withColumn("n_chars", F.length("text").cast("bigint"))
    run = corpus_pipeline.STAGES[stage][1]
    after, none = run(spark, docs, FOLDER), run(spark, docs.limit(0), FOLDER)
    assert none.count() == 0 and (none.columns == docs.columns) == (stage < 4)
    rows = after.collect()
    before = Counter((d, t) for d, t, *_ in TEXTS)
    if stage == 4:
        assert Counter(r.doc_id for r in rows) == Counter(d for d, *_ in TEXTS)
    elif stage == 1:
        assert Counter((r.doc_id, r.text) for r in rows) == before - Counter({(4, TEXTS[4][1]): 1})
    elif stage == 2:
        assert Counter((r.doc_id, r.text) for r in rows) == before and after.schema == docs.schema
    else:
        assert not Counter((r.doc_id, r.text) for r in rows) - before


def test_pipeline_stages(spark, tmp_path):
    from citewell.llm import byte_bpe, mixture, near_duplicates, quality, secrets
    from citewell.sources.tables import cut

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    scores = {r.doc_id: r.predicted for r in queries.op1_quality_crf(spark, FOLDER).collect()}
    for name, stage in corpus_pipeline.STAGES:
        after = cut(stage(spark, docs, FOLDER))
        before_ids, ids = {r.doc_id for r in docs.select("doc_id").collect()}, {r.doc_id for r in after.select("doc_id").collect()}
        assert ids <= before_ids and after.count() == len(ids)
        if name == "quality_classifier":
            assert ids == {d for d in before_ids if scores[d]}
        if name == "near_dedup":
            assert ids == {r.doc_id for r in near_duplicates.near_duplicates(docs).where("kept").collect()}
        if name == "secret_scan":
            assert ids == before_ids and secrets.secret_spans(after).where("spans <> ''").count() == 0
        if name == "source_mixture":
            assert ids == {r.doc_id for r in mixture.mixture(docs, corpus_pipeline.BUDGET).where("kept").collect()}
        if name == "encode":
            back = byte_bpe.decode_texts(after, queries.public_tokenizers.path(queries.RANKS), queries.public_tokenizers.PATTERN)
            assert rows_of(back, "doc_id", F.decode("decoded", "UTF-8")) == rows_of(docs, "doc_id", "text")
        else:
            assert after.columns == docs.columns
        docs = after
    assert quality.SAMPLE_DOCUMENTS > 0
