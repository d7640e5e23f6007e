"""The registered queries against their SQL on the smallest data."""

import math

import duckdb
import pytest

import __spark_entry__ as entry_point

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
CHECKED = [
    "I1_clean_html", "I4_assign_versions", "I12_retry_decisions", "V3_score_and_gate", "S8_cleaned_text_store", "F4_range", "F15_tenant_isolation",
    "D6_detect_pii", "flagship_page_search", "R1_vector_neighbours", "R6_search", "P11_chained_steps", "A2_highlights", "A10_detect_citations",
    "C3_robots_match", "C5_robots_as_of", "M3_token_bucket", "G7_latency_percentiles", "W8_sustained_condition", "N5_session_context",
    "J3_budget_stops", "U4_key_status", "ST9_order_guard",
]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    return value


def rows(frame):
    frame = frame[sorted(frame.columns)]
    listed = [tuple(plain(v) for v in r) for r in frame.itertuples(index=False, name=None)]
    return list(frame.columns), sorted(listed, key=repr)


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_sql(spark, duck, name):
    got = entry_point.queries()[name](spark, FOLDER).toPandas()
    assert rows(got) == rows(duck.execute(entry_point.oracle_sql()[name]).df())


def test_every_sql_belongs_to_a_query():
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())


def test_entry(spark):
    assert entry_point.entry(spark).count() > 0
