import hashlib
import html
import random
import time

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from citewell.functions import highlights as hl
from citewell.functions import pii, provenance, text, urls, vectors

QUICK = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
TEXTS = st.lists(st.text(alphabet="ab .!?\n é&<>;x1", max_size=60), min_size=1, max_size=30)


def one(spark, values, *columns, schema="s string"):
    rows = spark.createDataFrame([(k, *(v if isinstance(v, tuple) else (v,))) for k, v in enumerate(values)], f"k int, {schema}")
    return [tuple(r)[1:] for r in rows.select("k", *columns).orderBy("k").collect()]


@pytest.mark.parametrize(
    "raw, cleaned",
    [
        ("<html><body>Machine  learning</body></html>", "Machine learning"),
        ("<SCRIPT>var a='</p>';</Script >x<style a=b>p{}</style>y", "var a=' '; xy"),
        ("<script>a</script>b<STYLE>c</STYLE>d", "bd"),
        ("a&amp;amp; &lt;b&gt; &eacute;&#8364;", "a&amp; <b> é€"),
        ("    a b\x1cc ", "a b c"),
        ("", ""),
    ],
)
def test_clean_html(spark, raw, cleaned):
    assert one(spark, [raw], text.clean_html(F.col("s"))) == [(cleaned,)]


def test_hash_and_decode(spark):
    assert one(spark, ["é"], text.content_hash(F.col("s"))) == [(hashlib.sha256("é".encode()).hexdigest(),)]
    rows = spark.createDataFrame([(bytearray(b"ab\xffc"),)], "b binary")
    assert rows.select(text.decode_utf8(F.col("b"))).first()[0] == "ab�c"


@QUICK
@given(TEXTS)
def test_words_sentences_and_unescape_agree_with_python(spark, values):
    got = one(spark, values, text.words(F.col("s")), text.sentences(F.col("s")), text.unescape(F.col("s")))
    for value, (words, sentences, plain) in zip(values, got):
        assert words == value.split()
        assert plain == html.unescape(value)
        assert "".join("".join(s.split()) for s in sentences) == "".join(value.split())
        assert all(s == s.strip() and s for s in sentences)
        assert all(s[-1] in ".!?" for s in sentences[:-1])
        assert all(not any(c in ".!?" for c in s[1:-1]) for s in sentences if len(s) > 2 and s[0] not in ".!?")


def test_summary_and_tokens(spark):
    got = one(spark, ["One two. Three four five. Six", "Longest sentence without an end", " \n", "a"], text.summary(F.col("s"), 5))
    assert got == [("One two.",), ("Longest sentence wit",), (None,), ("a",)]
    counts = one(spark, ["short words", "extraordinarily", "", "  "], text.token_count(F.col("s")))
    assert counts == [(2,), (3,), (0,), (1,)]
    assert one(spark, ["", "fine", "abcdefgh " * 300], text.valid_summary(F.col("s"))) == [(False,), (True,), (False,)]


def test_urls(spark):
    cases = {
        "HTTP://Example.COM:80/A/b/#x": "http://example.com/A/b",
        "https://u:p@h.org:443": "https://h.org/",
        "https://h.org:8443/?q=1": "https://h.org:8443/?q=1",
        "http://h.org/a//?": "http://h.org/a",
        "http://h.org/a/;v=1": "http://h.org/a;v=1",
    }
    assert [r[0] for r in one(spark, list(cases), urls.canonical_url(F.col("s")))] == list(cases.values())
    twice = urls.canonical_url(urls.canonical_url(F.col("s")))
    assert [r[0] for r in one(spark, list(cases), twice)] == list(cases.values())
    assert one(spark, ["https://a.B.example.org/x"], urls.registrable_domain(urls.host(F.col("s")))) == [("example.org",)]


def test_hash_embedding(spark):
    (vec,), (again,) = one(spark, ["héllo", "héllo"], vectors.hash_embedding(F.col("s"), 16))
    raw = [int(hashlib.md5(f"héllo:{i}".encode()).hexdigest()[:8], 16) / 0xFFFFFFFF * 2 - 1 for i in range(16)]
    size = sum(x * x for x in raw) ** 0.5
    assert vec == again and vec == pytest.approx([x / size for x in raw], abs=1e-12)


def test_provenance(spark):
    varied = "In 2019 we saw 3 of 47 cases. Yes. " + "A much longer sentence follows here with plenty of different words about 12 subjects. " + "End 9."
    uniform = "One two three four. Furthermore two three four. Moreover it is fine. In conclusion all good."
    paragraphs = "aa bb cc. dd ee.\n\naa bb cd. dd ef.\n\naa bb cc. dd eg."
    got = one(spark, [varied, uniform, paragraphs, "short", ""], provenance.credibility(F.col("s")), provenance.ai_likelihood(F.col("s")))
    assert [round(c, 4) for c, _ in got] == [0.7, 0.55, 0.5, 0.55, 0.5]
    assert [round(a, 4) for _, a in got] == [0.4, 0.65, 0.6, 0.3, 0.3]


PII = [
    ("mail bob.x+y@mail.example.co.uk now", [("email", "bob.x+y@mail.example.co.uk")]),
    ("+1 555-123-4567 and +12", [("phone", "+1 555-123-4567")]),
    ("123-45-6789 000-12-3456 666-12-3456 912-34-5678 123-00-4567 123-45-0000", [("us_ssn", "123-45-6789")]),
    ("12345678Z L1234ABCD RSSMRA85M01H501Z", [("eu_national_id", "12345678Z"), ("eu_national_id", "L1234ABCD"), ("eu_national_id", "RSSMRA85M01H501Z")]),
    ("1 85 05 78 006 084 36", [("eu_national_id", "1 85 05 78 006 084 36")]),
    ("4111-1111-1111-1111 4111 1111 1111 1112", [("credit_card", "4111-1111-1111-1111")]),
    ("é123456789é", []),
    ("a@b.c_d@e.fo", [("email", "a@b.c"), ("email", "_d@e.fo")]),
    ("nothing", []),
]


def test_detects_and_redacts(spark):
    got = one(spark, [t for t, _ in PII], pii.detect_pii(F.col("s")), pii.redact(F.col("s")), pii.redact_info(F.col("s")))
    for (source, expected), (spans, redacted, info) in zip(PII, got):
        assert [(s["type"], s["value"]) for s in spans] == expected
        assert all(source[s["start"] : s["end"]] == s["value"] for s in spans)
        assert all(value not in redacted for _, value in expected)
        assert info["redacted_text"] == redacted and info["had_pii"] == bool(expected)
    assert got[0][1] == "mail [REDACTED_EMAIL] now"


def test_overlapping_matches_keep_original_offsets(spark):
    # A nine-digit run inside a phone number: both are replaced at their own offsets, the later one first.
    source = "+123456789"
    spans, redacted = one(spark, [source], pii.detect_pii(F.col("s")), pii.redact(F.col("s")))[0]
    assert [(s["type"], s["start"], s["end"]) for s in spans] == [("phone", 0, 10), ("us_ssn", 1, 10)]
    expected = source
    for span, mark in zip(reversed(spans), ["[REDACTED_SSN]", "[REDACTED_PHONE]"]):
        expected = expected[: span["start"]] + mark + expected[span["end"] :]
    assert redacted == expected


def test_luhn_other_digits(spark):
    card = "4111111111111111"
    arabic = card.translate({ord(str(d)): chr(0x0660 + d) for d in range(10)})
    assert one(spark, [card, arabic, card[:-1] + "2", "", "12a"], pii.luhn(F.col("s"))) == [(True,), (True,), (False,), (False,), (False,)]


def brute_spans(source, query):
    """Mark every matched character, then read off the marked runs and widen them."""
    terms = [t.lower() for t in query.split() if len(t) >= 2]
    if not source or not terms:
        return []
    ends = {}
    for term in terms:
        for at in range(len(source)):
            if source.lower().startswith(term, at):
                ends[at] = max(ends.get(at, 0), at + len(term))
    if not ends:
        return [(0, min(200, len(source)))]
    runs = []
    for at in sorted(ends):
        if runs and at <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], ends[at])
        else:
            runs.append([at, ends[at]])
    widened = []
    for a, b in runs[:5]:
        blanks = [i for i in range(1, max(0, a - 50) + 1) if source[i] in " \n\t"]
        after = [i for i in range(min(len(source), b + 50), len(source)) if source[i] in " \n\t"]
        widened.append((blanks[-1] + 1 if blanks else 0, after[0] if after else len(source)))
    return widened


@QUICK
@given(st.lists(st.tuples(st.text(alphabet="abn \n.", max_size=260), st.text(alphabet="abn ", max_size=9)), min_size=1, max_size=25))
def test_highlights_agree_with_brute_force(spark, values):
    cols = [hl.highlights(F.col("s"), F.col("q"))]
    got = one(spark, values, *cols, schema="s string, q string")
    for (source, query), (spans,) in zip(values, got):
        assert [tuple(s) for s in spans] == brute_spans(source, query)


def test_highlight_terms_are_literal(spark):
    got = one(spark, [("a.b axb a.b", "a.b"), (r"x\Ey x", r"\E")], hl.highlights(F.col("s"), F.col("q"), reach=0), schema="s string, q string")
    assert [tuple(s) for s in got[0][0]] == [(0, 3), (8, 11)]
    assert len(got[1][0]) == 1


def test_scans_of_many_matches_are_linear():
    """A hundred thousand matches in one text; and a long run of what could begin an address."""
    started = time.perf_counter()
    assert len(pii.find("123-45-6789, " * 100_000)) == 100_000
    assert pii.replaced("ab" * 100_000, [(2 * n, 2 * n + 1, "phone") for n in range(100_000)]) == "[REDACTED_PHONE]b" * 100_000
    assert pii.find("a" * 300_000 + "@") == []
    assert hl.extract("a" * 1_000_000, "aa", 5, 50) == [(0, 1_000_000)]
    assert len(hl.extract("the cat " * 200_000, "the cat", 5, 50)) == 5
    assert time.perf_counter() - started < 30


def test_replacing_overlapping_spans_equals_replacing_one_by_one():
    rng = random.Random(3)
    for _ in range(300):
        text = "".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 40)))
        spans = sorted((a := rng.randint(0, len(text)), min(len(text), a + rng.randint(0, 25)), rng.choice(["phone", "email", "x"])) for _ in range(rng.randint(0, 6)))
        expected = text
        for start, end, kind in reversed(spans):
            expected = expected[:start] + pii.placeholder(kind) + expected[end:]
        assert pii.replaced(text, spans) == expected
