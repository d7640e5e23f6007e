"""Operators on documents against brute force, and on odd rows."""

import collections
import hashlib
import itertools
import re
import time
import zlib
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as entry_point
from citewell.llm import byte_bpe, mixture, near_duplicates, quality, queries, repeats, secrets, token_files
from citewell.llm.common import utf8
from citewell.llm.shingles import shingle_sets

FOLDER = "/root/testdata/sf0.001"
RANKS = public_tokenizers.path(queries.RANKS)
ODD = [
    (1, "one two three four five six seven", "en", "a"), (2, None, None, None), (3, "", "en", "a"), (None, "a text without an id", "en", "b"),
    (4, "One TWO three four five six seven", "en", "a"), (5, "  \t\n ", "fr", "a"), (6, "word " * 4000, "en", "a"), (6, "word " * 4000, "en", "a"),
    (7, "x", "en", None), (8, "übermäßig ÉCOLE naïve 日本語 𝔘   \x1c", "de", "b"),
]


@pytest.fixture(scope="module")
def odd(spark):
    """Rows with NULLs, empty and long texts, repeated rows and columns whose names are used inside the operators."""
    rows = spark.createDataFrame(ODD, "doc_id bigint, text string, lang string, source string")
    return rows.withColumns({name: F.lit("x") for name in ("key", "hash", "n", "label", "score", "kept", "component_id", "ids", "start")}).withColumn("n_chars", F.length("text").cast("bigint"))


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


def texts(df):
    return [(r.doc_id, r.text or "") for r in df.collect()]


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


# --- byte-level BPE


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(RANKS), special_tokens={})


def test_bpe_equals_the_library(spark, documents, odd, library):
    for df in (documents, odd):
        expected = []
        for doc_id, text in texts(df):
            ids = library.encode_ordinary(text)
            expected.append((doc_id, len(ids), hashlib.sha256(np.asarray(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
        assert rows_of(byte_bpe.digests(df, RANKS, public_tokenizers.PATTERN), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(expected, key=repr)
    encoded = byte_bpe.encode_texts(odd, RANKS, public_tokenizers.PATTERN)
    back = byte_bpe.decode_texts(encoded, RANKS, public_tokenizers.PATTERN)
    assert rows_of(back, "doc_id", F.decode("decoded", "UTF-8")) == sorted(texts(odd), key=repr)
    assert byte_bpe.digests(odd.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0


def test_bpe_of_long_and_random_pretokens(library):
    bpe = byte_bpe.ByteBPE(byte_bpe.read_ranks(RANKS), public_tokenizers.PATTERN)
    rng = np.random.default_rng(5)
    odd_ones = ["a" * 5000, "ab" * 2000, "aab" * 999, "thethethe" * 300, "é" * 700] + ["".join(rng.choice(list("abcdehinorst é"), rng.integers(1, 80))) for _ in range(500)]
    for one, ids in zip(odd_ones, bpe.encode_batch(odd_ones), strict=True):
        assert ids.tolist() == library.encode_ordinary(one)
        assert bpe.decode(ids).decode() == one


def test_bpe_of_one_very_long_pretoken(library):
    """Ranks after which a smaller one can arise: one pass each, however long the pre-token is."""
    bpe = byte_bpe.ByteBPE(byte_bpe.read_ranks(RANKS), public_tokenizers.PATTERN)
    started = time.perf_counter()
    for unit in ("st", "il", "sta", "inst", "ers"):
        text = unit * (400_000 // len(unit))
        assert bpe.encode(text) == library.encode_ordinary(text)
        bpe._forget()
    assert time.perf_counter() - started < 60


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["st", "il", "ers", "a", "in", "the", "ation", "er", "s", "t", "e"]), st.integers(1, 30)), min_size=1, max_size=8))
def test_bpe_of_repeated_parts(library, parts):
    text = "".join(unit * n for unit, n in parts)
    assert _bpe().encode_batch([text, text[::-1]])[0].tolist() == library.encode_ordinary(text)


@lru_cache(maxsize=1)
def _bpe():
    return byte_bpe.ByteBPE(byte_bpe.read_ranks(RANKS), public_tokenizers.PATTERN)


# --- token files


def test_token_files_are_read_back_by_many_tasks(spark, documents):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    files = token_files.write_token_files(documents, public_tokenizers.path(queries.WORD_TOKENIZER), queries.END_ID, length=64)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    found = token_files.read_documents(files)
    tasks = found.select(F.spark_partition_id().alias("task")).distinct().count()
    assert files.count() > 1 and tasks > 1 and found.rdd.getNumPartitions() == files.count()


def test_token_files_equal_the_library(spark, documents, odd):
    tokenizer = Tokenizer.from_file(public_tokenizers.path(queries.WORD_TOKENIZER))
    for df in (documents, odd.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])):
        files = token_files.write_token_files(df.repartition(3), public_tokenizers.path(queries.WORD_TOKENIZER), queries.END_ID, length=64)
        start, expected = 0, []
        for doc_id, text in sorted(texts(df)):
            ids = [*tokenizer.encode(text, add_special_tokens=False).ids, queries.END_ID]
            expected.append((doc_id, start, len(ids), zlib.crc32(np.asarray(ids, "<u4").tobytes())))
            start += len(ids)
        assert rows_of(token_files.read_documents(files), "doc_id", "start", "n_tokens", "ids_crc32") == sorted(expected, key=repr)
        assert files.agg(F.sum("n_ids")).first()[0] == start


def test_strings_of_special_tokens_are_as_in_the_library(spark):
    tokenizer = Tokenizer.from_file(public_tokenizers.path(queries.WORD_TOKENIZER))
    one, two = "<|startoftext|>", "<|endoftext|>"
    found = [f"{one}a text{two}", f"in{one}side a wo{two}rd, {two}{two} {one}", f"{one[:-1]} {two[1:]} <|START", f"é\t{one}\r\n{two}É x{one}", two, f"{one} {one.upper()} <| endoftext |>"]
    files = token_files.write_token_files(spark.createDataFrame(list(enumerate(found)), "doc_id bigint, text string").repartition(2), public_tokenizers.path(queries.WORD_TOKENIZER), queries.END_ID, length=8)
    start, expected = 0, []
    for doc_id, text in enumerate(found):
        ids = [*tokenizer.encode(text, add_special_tokens=False).ids, queries.END_ID]
        expected.append((doc_id, start, len(ids), zlib.crc32(np.asarray(ids, "<u4").tobytes())))
        start += len(ids)
    assert rows_of(token_files.read_documents(files), "doc_id", "start", "n_tokens", "ids_crc32") == sorted(expected, key=repr)


def test_token_files_of_odd_rows_and_random_access(spark, odd):
    files = token_files.write_token_files(odd, public_tokenizers.path(queries.WORD_TOKENIZER), queries.END_ID, length=64)
    assert rows_of(token_files.read_documents(files), "doc_id") == sorted(((r[0],) for r in ODD), key=repr)
    one = files.orderBy("start").first()
    opened = token_files.SequenceFile(token_files._as_uri(one.uri))
    ids, mask = opened.sequence(0)
    assert len(ids) == len(mask) == 64 and not ids.flags.owndata and mask.sum() == min(64, one.n_ids)
    empty = token_files.write_token_files(odd.limit(0), public_tokenizers.path(queries.WORD_TOKENIZER), queries.END_ID)
    assert token_files.read_documents(empty).count() == 0


# --- secrets


def test_known_secrets_of_the_table_equal_a_plain_scan(spark):
    """All documents of two tables, scanned once more character class by character class."""
    assign = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    for folder in (FOLDER, FOLDER.replace("0.001", "0.01")):
        table = spark.read.parquet(f"{folder}/documents.parquet")
        expected = []
        for doc_id, text in texts(table):
            spans = [("assign", m.start(), m.end()) for m in assign.finditer(text) if len(m.group(1)) >= 8]
            spans += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m.group()) >= 16]
            spans += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m.group()) >= 32]
            spans.sort(key=lambda s: (s[1], ["assign", "access", "hex"].index(s[0])))
            counts = collections.Counter(s[0] for s in spans)
            digest = hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()
            expected.append((doc_id, counts["assign"], counts["access"], counts["hex"], digest))
        found = secrets.secret_spans(table)
        assert rows_of(found, "doc_id", "n_assign", "n_access", "n_hex", "base_sha256") == sorted(expected, key=repr)
        assert sum(e[1] + e[2] + e[3] for e in expected) > 0


def test_secrets_of_known_kinds(spark, odd):
    planted = 'password = "abcdefgh1" token:short AKIAABCDEFGHIJKL12 x' + "0123456789abcdef" * 2 + " api_key='k-9' éé Secret=Zz99Zz99Zz"
    rows = spark.createDataFrame([(1, planted)], "doc_id bigint, text string").unionByName(odd.select("doc_id", "text"))
    found = {r.doc_id: r for r in secrets.secret_spans(rows).collect() if r.n_assign}
    assert list(found) == [1]
    r = found[1]
    spans = [(k, int(a), int(b)) for k, a, b in (s.split(":") for s in r.spans.split(","))]
    assert [(k, planted[a:b]) for k, a, b in spans] == [
        ("assign", 'password = "abcdefgh1'), ("access", "AKIAABCDEFGHIJKL12"), ("hex", "0123456789abcdef" * 2), ("assign", "Secret=Zz99Zz99Zz"),
    ]
    assert (r.n_assign, r.n_access, r.n_hex) == (2, 1, 1)
    assert r.base_sha256 == hashlib.sha256(r.spans.encode()).hexdigest()
    assert secrets.secret_spans(odd).where("spans <> ''").count() == 0 and secrets.secret_spans(odd.limit(0)).count() == 0
    cleaned = secrets.redact(rows.withColumn("n_chars", F.lit(0)))
    text, n = cleaned.where("doc_id = 1 AND n_chars > 50").select("text", "n_chars").first()
    assert "abcdefgh1" not in text and text.count("[SECRET]") == 4 and n == len(text)
    assert secrets.redact(odd).where("doc_id = 2 AND text IS NULL").count() == 1


def test_random_strings_are_told_from_text():
    rng = np.random.default_rng(3)
    prose = "in the middle of an otherwise ordinary sentence about unremarkable circumstances and internationalization efforts "
    for alphabet in ("base62", "base64", "lower and digits", "base32"):
        caught = 0
        for _ in range(50):
            token = "".join(rng.choice(list(secrets.ALPHABETS[alphabet]), 40))
            caught += any(s.kind == 3 for s in secrets.all_spans(f"{prose}{token} {prose}")[1])
        assert caught >= 47
    assert secrets.random_spans(prose + "uncharacteristicallyantidisestablishmentarianism " + "a" * 60 + " " + "ab" * 40, []) == []


def test_random_strings_without_other_text(spark, documents):
    rng = np.random.default_rng(12)
    tokens = ["".join(rng.choice(list(secrets.ALPHABETS["base62"]), 40)) for _ in range(90)]
    rows = [(i, t) for i, t in enumerate(tokens[:30])] + [(100 + i, f"key: {t}") for i, t in enumerate(tokens[30:60])] + [(200, "\n".join(tokens[60:]))]
    words = [(300, "uncharacteristicallyantidisestablishmentarianism"), (301, "internationalization-and-localization-of-software"), (302, "src/main/python/module/test/resources/example"), (303, "Donaudampfschifffahrtsgesellschaft")]
    alone = spark.createDataFrame(rows + words, "doc_id bigint, text string")
    for table in (alone, alone.unionByName(documents.selectExpr("1000 + doc_id AS doc_id", "text"))):
        found = {r.doc_id: r.spans for r in secrets.secret_spans(table).where("doc_id < 1000").collect()}
        assert sum("random" in found[d] for d, _ in rows[:60]) >= 57 and found[200].count("random") >= 28
        assert not any(found[d] for d, _ in words)
    cleaned = {r.doc_id: r.text for r in secrets.redact(alone).collect()}
    assert sum(cleaned[i] == "[SECRET]" for i in range(30)) >= 28 and cleaned[300] == words[0][1]


# --- near-duplicates


def brute_sets(pairs):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for doc_id, text in pairs:
        w = re.findall("[^\x20\x09-\x0d]+", text.translate(lower))
        sets[doc_id] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    return sets


def brute_components(sets):
    least = {d: d for d in sets}
    changed = True
    links = [(a, b) for a, b in itertools.combinations(sorted(sets), 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in links:
            m = min(least[a], least[b])
            changed |= least[a] != m or least[b] != m
            least[a] = least[b] = m
    return least


def near_copies(spark):
    """A large group of near copies of one text, each with some words changed, and exact copies of another."""
    rng = np.random.default_rng(11)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(300):
        words = list(base)
        for at in rng.choice(120, rng.integers(0, 6), replace=False):
            words[at] = f"x{rng.integers(1000)}"
        rows.append((1000 + i, " ".join(words)))
    return spark.createDataFrame(rows + [(5000 + i, "the same few words here again") for i in range(200)], "doc_id bigint, text string")


@pytest.mark.parametrize("which", ["documents", "copies"])
def test_near_duplicates_equal_brute_force(spark, documents, which):
    df = documents if which == "documents" else near_copies(spark)
    sets = brute_sets(texts(df))
    least = brute_components(sets)
    expected = sorted(((d, len(s), least[d], least[d] == d) for d, s in sets.items()), key=repr)
    assert rows_of(near_duplicates.near_duplicates(df), "doc_id", "n_shingles", "component_id", "kept") == expected


def test_near_duplicates_of_odd_rows(spark, odd):
    found = rows_of(near_duplicates.near_duplicates(odd), "doc_id", "n_shingles", "component_id", "kept")
    assert found == sorted([(1, 3, 1, True), (2, 0, 2, True), (3, 0, 3, True), (None, 1, None, True), (4, 3, 1, False), (5, 0, 5, True), (6, 1, 6, True), (6, 1, 6, True), (7, 1, 7, True), (8, len(brute_sets(texts(odd))[8]), 8, True)], key=repr)
    kept = near_duplicates.distinct_documents(odd)
    assert kept.columns == odd.columns and rows_of(kept, "doc_id") == sorted(((r[0],) for r in ODD if r[0] != 4), key=repr)
    assert near_duplicates.near_duplicates(odd.limit(0)).count() == 0


def test_sketches_fill_every_coordinate_and_estimate():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**63, 900, dtype=np.uint64)
    pair = [np.unique(a[:800]), np.unique(a[100:])]
    rows = near_duplicates.sketches(np.concatenate([*pair, a[:1]]), np.array([0, 800, 1600, 1601]))
    assert (rows[2] > 0).all()
    assert abs((rows[0] == rows[1]).mean() - 700 / 900) < 0.12


def test_shingle_sets_count_like_brute_force(documents):
    pairs = texts(documents)
    _, offsets = shingle_sets(*utf8(pa.array([t for _, t in pairs])))
    sets = brute_sets(pairs)
    assert np.diff(offsets).tolist() == [len(sets[d]) for d, _ in pairs]


# --- repeated byte strings


def brute_repeats(pairs):
    seen, out = set(), []
    for doc_id, text in pairs:
        data, gone = text.encode(), set()
        for i in range(len(data) - 99):
            window = data[i : i + 100]
            if window in seen:
                gone.update(range(i, i + 100))
            seen.add(window)
        kept = bytes(b for i, b in enumerate(data) if i not in gone)
        out.append((doc_id, len(data), len(gone), sum(i - 1 not in gone for i in gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


REPEAT_COLUMNS = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def test_repeats_equal_brute_force(spark, documents):
    rng = np.random.default_rng(2)
    passage = ["".join(rng.choice(list("abcdé "), n)) for n in (60, 99, 100, 101, 180, 400)]
    rows = [(i, "".join(rng.choice(list("xyzw"), rng.integers(0, 150))) + passage[rng.integers(6)] + "".join(rng.choice(list("pq "), rng.integers(0, 90))) + passage[rng.integers(6)]) for i in range(60)]
    rows += [(100 + p, ("".join(rng.choice(list("abc"), p)) * 400)[:700]) for p in (1, 2, 7, 40, 53, 54, 90, 99, 100, 150)]
    for df in (documents, spark.createDataFrame(rows, "doc_id bigint, text string")):
        assert rows_of(repeats.digests(df), *REPEAT_COLUMNS) == brute_repeats(sorted(texts(df)))


def test_repeats_of_odd_rows(spark, odd):
    long = "abcdefghij klmnop " * 7
    rows = odd.select("doc_id", "text").unionByName(spark.createDataFrame([(6, long), (9, long), (None, long)], "doc_id bigint, text string"))
    found = rows_of(repeats.digests(rows), *REPEAT_COLUMNS)
    assert len(found) == 13 and sum(r[1] for r in found) == sum(len((t or "").encode()) for _, t in texts(rows))
    assert [r[2] for r in found if r[0] == 9] == [len(long)]  # all of it stands at the NULL id
    kept = repeats.without_repeats(rows).where("doc_id = 7").first().kept
    assert bytes(kept) == b"x"
    assert repeats.digests(rows.limit(0)).count() == 0


def test_repeats_of_a_passage_in_thousands_of_texts(spark, monkeypatch):
    rng = np.random.default_rng(21)
    passage = "".join(rng.choice(list("abcdefgh "), 170))
    rows = [(i, "".join(rng.choice(list("ijklmnop "), rng.integers(60, 90))) + passage + "".join(rng.choice(list("qrstuvwé"), 70))) for i in range(12_000)]
    rows += [(20_000, "z" * 3_000), (20_001, "y" + "z" * 2_000 + passage[30:150])]
    largest, merged = [], repeats._merged

    def watched(strings):
        largest.append(strings.groupBy("key").agg(F.sum(F.length("bytes")).alias("n")).agg(F.max("n")).first()[0] or 0)
        return merged(strings)

    monkeypatch.setattr(repeats, "_merged", watched)
    assert rows_of(repeats.digests(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(7)), *REPEAT_COLUMNS) == brute_repeats(rows)
    assert max(largest) <= repeats.BATCH_BYTES  # all strings of one key are in one task
    # A text of one key only, longer than is merged at a time.
    long = [(1, "ab" * 700_000), (2, "b" + "ab" * 100), (3, "ba" * 60 + "c")]
    found = rows_of(repeats.digests(spark.createDataFrame(long, "doc_id bigint, text string")), *REPEAT_COLUMNS)
    assert [r[:4] for r in found] == [(1, 1_400_000, 1_399_998, 1), (2, 201, 201, 1), (3, 121, 120, 1)]


def test_only_runs_that_are_followed_are_written(spark, documents, monkeypatch):
    docs = documents.selectExpr("doc_id AS doc", "coalesce(text, '') AS text")
    rows = rows_of(repeats.runs_of(docs), "key", "doc", "at", "inner")
    times = collections.Counter(r[0] for r in rows)
    wanted = sorted(r for r in rows if times[r[0]] > 1 or r[3])
    assert 0 < len(wanted) < len(rows)
    assert sorted(rows_of(repeats.runs_to_follow(docs), "key", "doc", "at", "inner")) == wanted
    written, write = [], repeats.cut

    def watched(df, label="cut"):
        table = write(df, label)
        written.append(table.count())
        return table

    monkeypatch.setattr(repeats, "cut", watched)
    repeats.repeated_windows(docs).count()
    assert max(written) <= len(wanted)


def test_runs_of_one_key_meet_once_a_piece(spark):
    passage = "".join(np.random.default_rng(5).choice(list("abcdefgh "), 300))
    docs = spark.createDataFrame([(i, passage) for i in range(3_000)], "doc bigint, text string").repartition(3)
    runs = repeats.runs_of(docs)
    most = runs.groupBy("key", "turn").count().agg(F.max("count")).first()[0]
    assert most <= 6 and repeats.runs_to_follow(docs).count() == runs.count() > 3_000


# --- quality


def test_quality_on_held_out_labels(spark):
    folder = "/root/testdata/sf0.01"
    scored = entry_point.queries()["op1_quality_crf"](spark, folder)
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    both = scored.where("held_out").join(labels, "doc_id").selectExpr("quality", "predicted", "score").collect()
    assert len(both) > 100 and sum(r.quality == r.predicted for r in both) / len(both) >= 0.97
    assert all(0 <= r.score <= 1 for r in both)
    out = {r.doc_id for r in scored.where("held_out").collect()}
    assert all((zlib.crc32(str(r.doc_id).encode()) % 3 == 1) == (r.doc_id in out) for r in scored.collect())


def test_quality_of_odd_rows(spark, odd):
    labels = spark.createDataFrame([(1, 1), (4, None), (None, 0), (6, 0), (6, 1), (7, 5)], "doc_id bigint, quality int")
    model = quality.learn(odd, labels)
    for m in (model, None):
        found = quality.scored(odd, m)
        assert rows_of(found, "doc_id") == sorted(((r[0],) for r in ODD), key=repr) and found.where("score IS NULL OR score < 0 OR score > 1").count() == 0
    assert quality.learn(odd, labels.limit(0)) is None
    assert quality.accepted(odd, None).columns == odd.columns and quality.accepted(odd, None).count() == len(ODD)
    assert quality.scored(odd.limit(0), model).count() == 0


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(4)
    emission, transitions, counts = rng.normal(size=(7, 2)), rng.normal(size=(2, 2)), np.array([3, 1, 3])
    got, _ = quality.marginals(emission, transitions, counts)
    at = 0
    for n in counts:
        weight = collections.defaultdict(float)
        for states in itertools.product((0, 1), repeat=int(n)):
            score = sum(emission[at + i, s] for i, s in enumerate(states)) + sum(transitions[a, b] for a, b in itertools.pairwise(states))
            for i, s in enumerate(states):
                weight[i, s] += np.exp(score)
        for i in range(n):
            assert got[at + i, 1] == pytest.approx(weight[i, 1] / (weight[i, 0] + weight[i, 1]))
        at += n


# --- mixture


def test_mixture_meets_targets_and_budget(spark):
    rng = np.random.default_rng(6)
    rows = [(i, "w " * int(rng.integers(1, 60) ** 2), f"s{i % 5 * (i % 3)}", ("en", "de")[i % 7 == 0], f"t{i % 4}") for i in range(1500)]
    documents = mixture.measured(spark.createDataFrame(rows, "doc_id bigint, text string, source string, lang string, topic string"))
    names = [f"_{d}" for d in mixture.DIMENSIONS]
    cells = documents.groupBy(*names).agg(F.sum("_tokens").alias("tokens"))
    wanted = {n: mixture.targets(cells, n) for n in names}
    raked = mixture.raked(cells, wanted)
    for n in names:
        have = {r[0]: r[1] for r in raked.groupBy(n).agg(F.sum("weight")).collect()}
        for r in wanted[n].collect():
            assert have[r.value] == pytest.approx(r.target, rel=1e-3)
    cells = mixture.probabilities(raked)
    expected, total = cells.agg(F.sum(F.col("tokens") * F.col("probability")), F.sum("tokens")).first()
    assert expected == pytest.approx(mixture.BUDGET * total, rel=1e-3)


def test_mixture_of_odd_rows(spark, odd):
    found = mixture.mixture(odd)
    assert rows_of(found, "doc_id") == sorted(((r[0],) for r in ODD), key=repr)
    assert found.where("probability IS NULL OR probability < 0 OR probability > 1").count() == 0
    some = mixture.sampled(odd.withColumn("topic", F.lit("t")))
    assert some.columns == [*odd.columns, "topic"]
    assert mixture.mixture(odd.limit(0)).count() == 0
    assert mixture.sampled(odd, budget=1.0).count() == len(ODD)
