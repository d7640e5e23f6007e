"""URL reputation, phrase mining and lexical search against brute force and the SQL of their queries."""

import math
import re
from collections import Counter
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from citewell.llm import collocations, max_sketches, reputation
from citewell.sources import tables
from tests.llm.test_texts import rows_of

FOLDER = "/root/testdata/sf0.001"


# --- op11 ---------------------------------------------------------------------------------------------

RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"), (None, "/", "block")]
URLS = [
    "https://Blog.Example.ORG/es/7?x=1", "http://example.org/en/19#top", "http://example.org/en/29", "x://notexample.org/es/1", "http://a.com/de/", "http://a.com/de",
    "a.com/de/1", None, "", "://", "http://org/", "http://org", "http://u@Ä.com:80/fr/1", "http://a.com?q=://b.org/", "http://1.2.3.4/fr/", "http://a.co.uk/p\nq/", "s://t://u/v",
]


def plain(url, rules):
    if url is None or "://" not in url:
        host = path = ""
    else:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest).group()
        path = re.match(r"[^?#]*", rest[len(host) :]).group()
        host = re.sub("[A-Z]", lambda m: m.group().lower(), host)
    fits = [(len(h + p), h + p, v) for h, p, v in rules if h and (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[1:] if fits else (None, None)))


def pages_of(spark, rows):
    return spark.createDataFrame([(i, u, 1, 2) for i, u in rows], "page_id bigint, url string, host int, bad int")


def outcomes_of(spark, rows):
    return spark.createDataFrame([(i, b, "x") for i, b in rows], "page_id bigint, bad boolean, host string")


def test_rules_hosts_and_odd_urls(spark):
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    rows = [*enumerate(URLS), (None, URLS[0]), (3, URLS[3]), (3, URLS[4])]
    got = reputation.judged(pages_of(spark, rows), outcomes_of(spark, []), rules)
    wanted = [(i, h, p, r, v or "allow") for i, (h, p, r, v) in ((i, plain(u, RULES)) for i, u in rows)]
    assert rows_of(got, "page_id", "host", "path", "rule", "verdict") == sorted(wanted, key=repr)
    assert reputation.judged(pages_of(spark, []), outcomes_of(spark, [(1, True)]), rules.limit(0)).count() == 0


def test_bad_hosts_are_blocked_and_few_pages_are_shrunk(spark):
    """A host is bad, one has only two pages, one is good; so is a domain whose hosts have a page or two each."""
    rows, bad = [], []
    for host, n, hits in [("a.bad.net", 40, 36), ("b.good.com", 300, 3), ("two.good.com", 2, 2), ("c.mixed.com", 60, 20)] + [(f"h{i}.farm.org", 2, 2) for i in range(40)] + [("new.farm.org", 0, 0)]:
        for j in range(max(n, 1)):
            rows.append((len(rows), f"https://{host}/{j}"))
            if n:
                bad.append((len(rows) - 1, j < hits))
    bad += [(bad[0][0], False), (None, True), (10**6, True), (5, None)]
    got = {r.host: r for r in reputation.judged(pages_of(spark, rows), outcomes_of(spark, bad), spark.createDataFrame([], "host string, path string, verdict string")).collect()}
    blocked = {h for h, r in got.items() if r.verdict == "block"}
    assert blocked == {"a.bad.net", "new.farm.org", *(f"h{i}.farm.org" for i in range(40))}
    shares = {r.host: r for r in reputation.reputation(reputation.host_counts(reputation.split_urls(pages_of(spark, rows)), outcomes_of(spark, bad))).collect()}
    assert (shares["a.bad.net"].n, shares["a.bad.net"].k) == (40, 36)
    assert shares["two.good.com"].mean < 0.7 < shares["h1.farm.org"].mean and shares["new.farm.org"].variance > shares["h1.farm.org"].variance


def test_shares_by_hand(spark):
    """The chain of priors, worked out once more without Spark."""
    counts = [("a.x.com", 10, 9), ("b.x.com", 30, 3), ("a.y.com", 5, 0), ("z.org", 8, 4), ("w.co.uk", 0, 0)]
    rows = [(f"{h}-{j}", h, j < k) for h, n, k in counts for j in range(n)]
    pages = [(i, f"http://{h}/") for i, (_, h, _) in enumerate(rows)] + [(len(rows), "http://w.co.uk/")]
    shares = reputation.reputation(reputation.host_counts(reputation.split_urls(pages_of(spark, pages)), outcomes_of(spark, [(i, b) for i, (_, _, b) in enumerate(rows)])))
    got = {r.host: (r.mean, r.variance) for r in shares.collect()}

    def level(units):
        over = sum((k - n * p) ** 2 / (p * (1 - p)) - n for n, k, p in units.values())
        rho = min(max(round(over / sum(n * (n - 1) for n, _, _ in units.values()), 6), reputation.LEAST), reputation.MOST)
        weight = (1 - rho) / rho
        return {u: ((p * weight + k) / (weight + n), weight + n) for u, (n, k, p) in units.items()}

    root = (sum(k for _, _, k in counts) + 0.5) / (sum(n for _, n, _ in counts) + 1)
    suffix = level({"com": (45, 12, root), "org": (8, 4, root), "co.uk": (0, 0, root)})
    domain = level({"x.com": (40, 12, suffix["com"][0]), "y.com": (5, 0, suffix["com"][0]), "z.org": (8, 4, suffix["org"][0]), "w.co.uk": (0, 0, suffix["co.uk"][0])})
    parent = {"a.x.com": "x.com", "b.x.com": "x.com", "a.y.com": "y.com", "z.org": "z.org", "w.co.uk": "w.co.uk"}
    host = level({h: (n, k, domain[parent[h]][0]) for h, n, k in counts})
    assert got == {h: (pytest.approx(m), pytest.approx(m * (1 - m) / (w + 1))) for h, (m, w) in host.items()}


# --- op12 ---------------------------------------------------------------------------------------------


def phrases_by_hand(rows, least, best):
    out = []
    rows = [("und" if lang is None else lang, text) for lang, text in rows]
    for lang in {r[0] for r in rows}:
        f, n = Counter(), 0
        for _, text in (r for r in rows if r[0] == lang):
            lower = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
            for piece in re.split("[.,;:!?\x0a-\x0d]", lower):
                words = re.findall("[^\x20\x09]+", piece)
                n += len(words)
                f.update(tuple(words[i : i + m]) for m in range(1, 5) for i in range(len(words) - m + 1))
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        rated = []
        for p, a in candidates.items():
            score, k = min((2000000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
            spans = [(q, b) for q, b in candidates.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))]
            if not any(100 * b >= 80 * a for _, b in spans):
                rated.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, i, p.decode(), -a, left, right, n, -s) for i, (s, a, p, left, right) in enumerate(sorted(rated)[:best], 1)]
    return sorted(out, key=repr)


PHRASE_COLUMNS = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def texts_table(spark, rows):
    return spark.createDataFrame([(lang, text, 1, "w", 0) for lang, text in rows], "lang string, text string, w1 int, word string, number int")


def test_phrases_of_odd_rows(spark):
    rows = [("en", "New York City is New York City."), ("en", "new york\tcity; big Big BIG big big"), ("en", None), ("en", ""), (None, "a b a b a b"), ("und", "A B"), ("", "a b c d a b c d"),
            ("en", "of the of the of the. the of"), ("de", "Ä ö Ä ö\x0bÄ ö\x1cÄ\xa0ö \x00 x\x00 \x00 x\x00"), ("en", " . ,, \n"), ("en", "a" * 50_000)] * 2
    rows += [("en", "the quick brown fox jumps over " * 300)]
    for least, best in ((1, 2000), (3, 2), (4, 50)):
        got = collocations.collocations(texts_table(spark, rows).repartition(3), least, best)
        assert rows_of(got, *PHRASE_COLUMNS) == phrases_by_hand(rows, least, best)
    assert collocations.collocations(texts_table(spark, [])).count() == 0


def test_phrases_of_random_texts_in_small_chunks(spark, monkeypatch):
    """Chunks of a few bytes and one shared bit for all words change nothing."""
    rng = np.random.default_rng(3)
    rows = [("en" if i % 3 else "fr", "".join(rng.choice(list("ab") + [" a", " ", ".", "B "], 60))) for i in range(300)]
    wanted = phrases_by_hand(rows, 5, 2000)
    assert rows_of(collocations.collocations(texts_table(spark, rows), 5), *PHRASE_COLUMNS) == wanted and len(wanted) > 50
    whole = "".join(t + "." for _, t in rows).encode()
    monkeypatch.setattr(collocations, "CHUNK_BYTES", 7)
    chunked = [w for some in collocations.words_of(whole) for w in some]
    monkeypatch.setattr(collocations, "CHUNK_BYTES", 10**6)
    assert chunked == [w for some in collocations.words_of(whole) for w in some]


def test_words_that_share_a_number_are_counted_again(spark, monkeypatch):
    """The first seed maps every word to one of two numbers."""
    rows = [("en", "a b c a b c d")] * 3
    plain_counts = collocations.word_counts

    def clashing(docs, seed):
        found = plain_counts(docs, seed)
        return found.withColumn("number", found["number"] % 2) if seed == 0 else found

    monkeypatch.setattr(collocations, "word_counts", clashing)
    counts, seed = collocations.numbered(texts_table(spark, rows))
    assert seed == 1 and counts.where("word = 'a'").first().c == 6


# --- op13 ---------------------------------------------------------------------------------------------

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms_by_hand(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def search_by_hand(docs, items, k):
    held = [(d, Counter(terms_by_hand(t))) for d, t in docs]
    n, total = sum(bool(c) for _, c in held), sum(c.total() for _, c in held)
    df = Counter(t for _, c in held for t in c)
    asked = {}
    for item, text in items:
        if item is not None:
            asked.setdefault(item, set()).update(terms_by_hand(text))
    out = []
    for item, terms in asked.items():
        scores = []
        for d, c in held:
            m = 50 + (50 * c.total() * n) // total if total else 0
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in terms if t in c)
            if score > 0 and d is not None:
                scores.append((-score, d))
        out += [(item, i, d, -s) for i, (s, d) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=repr)


SEARCH_COLUMNS = ("item_id", "rank", "doc_id", "score")


def search_tables(spark, docs, items):
    df = spark.createDataFrame([(d, t, 1, "x", 0) for d, t in docs], "doc_id bigint, text string, score int, term string, item_id int")
    return df, spark.createDataFrame([(i, t, 5) for i, t in items], "item_id bigint, text string, doc_id int")


ODD_DOCS = [(1, "Cat dog, CAT."), (2, "dog bird"), (3, None), (4, ""), (5, "--- ,"), (6, "Ñandú ñandú straße"), (None, "cat cat bird"), (7, "cat dog cat"), (7, "cat dog cat"), (9, "bird " * 5000 + "cat"), (8, "dog's 3.5")]
ODD_ITEMS = [(1, "cat DOG"), (2, "the Ñandú"), (3, None), (4, ""), (5, "bird cat cat"), (None, "cat"), (6, "s 5"), (7, "cat"), (7, "straße"), (8, "unknown")]


def test_search_on_odd_rows(spark):
    docs, items = search_tables(spark, ODD_DOCS, ODD_ITEMS)
    for k in (1, 2, 50):
        assert rows_of(max_sketches.search(docs.repartition(3), items, k), *SEARCH_COLUMNS) == search_by_hand(ODD_DOCS, ODD_ITEMS, k)
    assert max_sketches.search(docs.limit(0), items).count() == 0 == max_sketches.search(docs, items.limit(0)).count()


def test_search_in_many_batches_with_copies(spark, monkeypatch):
    """Batches of a few bytes; hundreds of copies tie, so that the smallest ids win."""
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(60)]
    docs = [(1000 - i, " ".join(rng.choice(words, rng.integers(1, 40)))) for i in range(300)] + [(2000 - i, "w1 w2 w3 w4") for i in range(400)]
    items = [(i, " ".join(rng.choice(words, 5))) for i in range(12)] + [(99, "w1 w2 w3 w4")]
    monkeypatch.setattr(max_sketches, "QUERY_BYTES", 150)
    got = max_sketches.search(*search_tables(spark, docs, items), 20)
    assert rows_of(got, *SEARCH_COLUMNS) == search_by_hand(docs, items, 20)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.dictionaries(st.sampled_from([f"t{i}" for i in range(40)]), st.integers(1, 10**9), min_size=1, max_size=12), min_size=1, max_size=6), st.data())
def test_bounds_are_never_below_the_scores(documents, data):
    """Sketches of every width, narrow ones included, bound the exact scores."""
    asked = data.draw(st.lists(st.lists(st.tuples(st.sampled_from([f"t{i}" for i in range(60)]), st.integers(0, 20_000)), min_size=1, max_size=6, unique_by=lambda x: x[0]), min_size=1, max_size=4))
    batch = max_sketches.Batch([(i, [(t.encode(), w) for t, w in terms]) for i, terms in enumerate(asked)])
    counts = [{t.encode(): n for t, n in d.items()} for d in documents]
    numbers = max_sketches.Numbers()
    ends = np.concatenate([[0], np.cumsum([len(c) for c in counts])])
    codes = np.array([numbers[t] for c in counts for t in c], np.uint64)
    times = np.array([n for c in counts for n in c.values()])
    lengths = np.arange(50, 50 + len(counts))
    for width in (1, 8, 4096):
        bounds = batch.bounds(max_sketches.sketch(codes, times, ends, width), lengths)
        for i, c in enumerate(counts):
            for q, (_, terms) in enumerate(batch.queries):
                assert bounds[i, q] >= max_sketches.Best(terms, 1).exact(c, int(lengths[i]))


def test_levels_cover_all_counts_from_above():
    assert max_sketches.LEVELS[0] == 0 and len(max_sketches.LEVELS) == 255 and all(a < b for a, b in pairwise(max_sketches.LEVELS.tolist()))
    assert max_sketches.LEVELS[128] == 128 and max_sketches.LEVELS[-1] == 2**32


def test_few_documents_are_scored_exactly(spark, monkeypatch):
    """On whole documents the bounds leave out most pairs of documents and queries."""
    table = [(r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").limit(20).collect()]
    scored = []
    exact = max_sketches.Best.exact
    monkeypatch.setattr(max_sketches.Best, "exact", lambda self, counts, length: scored.append(1) or exact(self, counts, length))
    docs = [(d, Counter(t.encode() for t in terms_by_hand(x))) for d, x in table if terms_by_hand(x)]
    best = max_sketches.Batch([(i, [(t.encode(), 1000) for t in sorted(set(terms_by_hand(x)))]) for i, x in items])
    keep = [max_sketches.Best(terms, 5) for _, terms in best.queries]
    numbers = max_sketches.Numbers()
    for d, c in docs:
        row = max_sketches.sketch(np.array([numbers[t] for t in c], np.uint64), np.array(list(c.values())), np.array([0, len(c)]), 1 << (8 * len(c) - 1).bit_length())
        for q, b in enumerate(best.bounds(row, np.array([100]))[0]):
            keep[q].rescore(np.array([b]), np.array([d]), [c], np.array([100]))
    assert len(scored) < len(docs) * len(items) / 2


def test_rows_of_codes_are_short_and_lose_no_window():
    """A row ends with a 0, soon after ``ROW_CODES`` words; read in any batches, the same windows come out."""
    rng = np.random.default_rng(5)
    codes = rng.integers(1, 50, 40_000).astype(np.uint64)
    codes[rng.random(len(codes)) < 0.05] = 0
    codes[9_000:13_000] = 7  # a piece longer than a row
    codes = np.concatenate([codes, np.zeros(1, np.uint64)])
    rows = collocations.rows_of(codes)
    assert b"".join(rows.to_pylist()) == codes.tobytes()
    assert all(r.endswith(bytes(8)) for r in rows.to_pylist())
    sizes = sorted(len(r) // 8 for r in rows.to_pylist())
    assert len(rows) > 30 and sizes[-2] < 2 * collocations.ROW_CODES and 4_000 < sizes[-1] < 4_000 + 2 * collocations.ROW_CODES

    def windows(parts):
        found = Counter()
        for part in collocations.each(parts):
            assert not part[-collocations.ORDER :].any()
            for i in np.flatnonzero(part).tolist():
                window = part[i : i + collocations.ORDER].tolist()
                found[tuple(window[: window.index(0)] if 0 in window else window)] += 1
        return found

    batch = pa.record_batch([rows], names=["codes"])
    whole = windows([pa.record_batch([pa.array([codes.tobytes()], pa.binary())], names=["codes"])])
    assert windows([batch]) == whole
    assert windows([batch.slice(0, 7), batch.slice(7, 0), batch.slice(7)]) == whole
    assert collocations.rows_of(np.zeros(1, np.uint64)).to_pylist() == [bytes(8)]


def test_codes_reach_python_in_bounded_batches(spark):
    """Neither one row nor one batch holds megabytes of a long text."""
    docs = spark.createDataFrame([("en", "alpha beta gamma delta. " * 100_000), ("en", "alpha beta, " * 200_000)], "lang string, text string").repartition(1)
    held = spark.conf.get(tables.BATCH_BYTES)
    try:
        spark.conf.set(tables.BATCH_BYTES, "64m")
        counts, seed = collocations.numbered(docs)
        texts = collocations.coded(docs, seed, collocations.bitmap(counts.select("number")))

        def sizes(batches):
            for b in batches:
                yield pa.record_batch([pa.array([b.nbytes]), pa.array([max((len(x.as_buffer()) for x in b.column(0)), default=0)])], names=["batch", "row"])

        most = texts.mapInArrow(sizes, "batch bigint, row bigint").groupBy().max().first()
        assert most[0] <= 2 * tables.PYTHON_BATCH_BYTES
        assert most[1] <= 16 * collocations.ROW_CODES
        pairs = collocations.frequent(texts, 30)
        counted = collocations.phrase_counts(collocations.windows(texts, pairs, collocations.frequent(texts, 30, pairs)), 30)
        got = sorted(tuple(r) for r in counted.selectExpr("size(words)", "f").collect())
        assert got == [(1, 100_000), (1, 100_000), (1, 300_000), (1, 300_000), (2, 100_000), (2, 100_000), (2, 300_000), (3, 100_000), (3, 100_000), (4, 100_000)]
    finally:
        spark.conf.set(tables.BATCH_BYTES, held)
