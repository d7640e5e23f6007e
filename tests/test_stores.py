import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citewell.sources import stores, tables

ROWS = T.StructType([T.StructField("url", T.StringType()), T.StructField("n", T.LongType())])


def rows(spark, pairs):
    return spark.createDataFrame(pairs, ROWS)


def last_wins(stored, new):
    return stored.join(new.select("url"), "url", "left_anti").unionByName(new)


def values(df):
    return {r.url: r.n for r in df.collect()}


@pytest.fixture
def table(spark):
    return stores.KeyedTable(spark, tables.shared_dir(spark, "keyed-test"), "url", ROWS, parts=16, keep=2)


def test_a_batch_rewrites_only_the_parts_of_its_keys(spark, table):
    table.update(0, rows(spark, [(f"u{k}", k) for k in range(200)]), last_wins)
    before = table.live()
    assert len(before) == 16
    touched = table.update(1, rows(spark, [("u3", 1000), ("u7", 1001), ("new", 1)]), last_wins)
    after = table.live()
    assert len(touched) <= 3 and {p for p in after if after[p] != before[p]} == set(touched)
    assert values(table.read()) == {f"u{k}": k for k in range(200)} | {"u3": 1000, "u7": 1001, "new": 1}
    some = values(table.read(parts=touched))
    assert {"u3", "u7", "new"} <= set(some) and len(some) < 120


def test_batches_that_run_again_give_the_same_table(spark, table):
    table.update(0, rows(spark, [("a", 1), ("b", 1)]), last_wins)
    for _ in range(2):
        table.update(1, rows(spark, [("a", 2), ("c", 2)]), lambda stored, new: stored.unionByName(new))
    assert sorted((r.url, r.n) for r in table.read().collect()) == [("a", 1), ("a", 2), ("b", 1), ("c", 2)]
    assert values(table.read(before=1)) == {"a": 1, "b": 1}


def test_old_files_expire_and_readers_of_kept_states_go_on(spark, table):
    for number in range(6):
        table.update(number, rows(spark, [("a", number), (f"k{number}", number)]), last_wins)
    data = tables.folders(spark, f"{table.root}/data")
    live = {f for n in (5, 6) for f in table.live(n).values()}
    kept = {f"{table.root}/data/{d}/{p}" for d in data for p in tables.folders(spark, f"{table.root}/data/{d}") if p.startswith("part=")}
    assert kept == live and values(table.read(before=5))["a"] == 4 and values(table.read())["a"] == 5


def test_a_failed_batch_is_not_seen(spark, table):
    table.update(0, rows(spark, [("a", 1)]), last_wins)
    with pytest.raises(ValueError):
        table.update(1, rows(spark, [("a", 2)]), lambda stored, new: rows(spark, [(f"x{k}", k) for k in range(50)]))
    assert values(table.read()) == {"a": 1}
    table.update(1, rows(spark, [("b", 2)]), last_wins)
    assert values(table.read()) == {"a": 1, "b": 2}


def test_parts_may_become_empty_and_batches_too(spark, table):
    table.update(0, rows(spark, [("a", 1), (None, 5)]), last_wins)
    table.update(1, rows(spark, [("a", 2)]), lambda stored, new: stored.where("url <> 'a'").limit(0))
    table.update(2, rows(spark, []), last_wins)
    assert values(table.read()) == {None: 5} and table.read(parts=[]).count() == 0


def test_early_states_may_be_read_from_an_empty_table(spark, table):
    assert table.read().schema == ROWS and table.read().count() == 0


def keys(spark, names):
    return spark.createDataFrame([(n,) for n in names], "key string")


@pytest.fixture
def held(spark):
    return stores.KeySet(spark, tables.shared_dir(spark, "keys-test"), parts=8, fanout=3)


def added(held, spark, number, names):
    found, read = held.known(number, keys(spark, names))
    found = {r.key for r in found.collect()}
    held.add(number, keys(spark, set(names) - found))
    return found, read


def test_known_keys_are_found_however_old_and_few_files_are_read(spark, held):
    for number in range(7):
        found, read = added(held, spark, number, [f"{number}-{k}" for k in range(300)])
        assert not found
        # One key in a hundred is let through wrongly by each of at most four filters.
        assert len(read) <= 8 * len(held.runs(number)) and sum(1 for _ in read) < 60
    assert len(held.runs()) <= 2 * 3
    found, read = added(held, spark, 7, ["0-5", "6-1", "fresh"])
    assert found == {"0-5", "6-1"}
    assert 2 <= len(read) <= 6
    assert added(held, spark, 8, ["fresh", "0-5"])[0] == {"fresh", "0-5"}


def test_keys_without_a_hit_read_nothing(spark, held):
    added(held, spark, 0, [f"k{k}" for k in range(20)])
    read = [added(held, spark, 1 + n, [f"x{n}"])[1] for n in range(5)]
    assert sum(bool(r) for r in read) <= 2


def test_a_batch_of_keys_may_run_again(spark, held):
    added(held, spark, 0, ["a", "b"])
    for _ in range(3):
        assert added(held, spark, 1, ["b", "c"])[0] == {"b"}
    assert added(held, spark, 2, ["c", "d"])[0] == {"c"}
    assert held.known(None, keys(spark, ["a", "b", "c", "d", "e"]))[0].count() == 4
    stored = [r.key for n in held.runs().values() for r in spark.read.schema("key string").parquet(f"{n}/keys").collect()]
    assert sorted(stored) == ["a", "b", "c", "d"]


def test_empty_batches_of_keys(spark, held):
    assert added(held, spark, 0, []) == (set(), [])
    assert added(held, spark, 1, ["a"])[0] == set()
    assert added(held, spark, 2, [])[0] == set()
    assert added(held, spark, 3, ["a"])[0] == {"a"}
