from pyspark.sql import Window
from pyspark.sql import functions as F

from citewell.operators.ordered import fitting_width, id_segment, running, segment_of, top_n


def test_running_equals_plain_windows_on_a_hot_key(spark):
    """One key holds most rows and segments are far smaller than keys, some with a single row."""
    rows = spark.range(3000).select(
        F.when(F.col("id") % 10 < 8, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 7)).alias("key"),
        F.col("id").alias("at"),
        (F.xxhash64("id") % 100).alias("v"),
    ).where("at % 13 <> 0")
    got = running(
        rows, ["key"], ["at"], id_segment(F.col("at"), 4), previous={"one": ("v", 1), "three": ("v", 3)},
        total={"sum": "v"}, peak_before={"peak": "v"},
    )
    w = Window.partitionBy("key").orderBy("at")
    plain = rows.select(
        "key", "at", "v", F.lag("v", 1).over(w).alias("one"), F.lag("v", 3).over(w).alias("three"),
        F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("sum"),
        F.max("v").over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("peak"),
    )
    assert got.exceptAll(plain).count() == 0 and plain.exceptAll(got).count() == 0


def test_running_keeps_null_keys_and_values(spark):
    rows = spark.createDataFrame([(None, 1, 5), (None, 9, None), (None, 20, 7), ("a", 2, None)], "key string, at int, v int")
    got = running(rows, ["key"], ["at"], id_segment(F.col("at"), 2), previous={"p": ("v", 1)}, total={"t": "v"})
    assert {(r.key, r["at"], r.p, r.t) for r in got.collect()} == {(None, 1, None, 5), (None, 9, 5, 5), (None, 20, None, 12), ("a", 2, None, 0)}


def test_fitting_width(spark):
    assert fitting_width(spark.range(1000), "id", 100) == 100


def test_top_n_limits_before_the_shuffle(spark):
    plan = top_n(spark.range(100).withColumn("k", F.col("id") % 3), ["k"], [F.desc("id")], 2)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_segments_hold_with_an_outlier_and_a_burst(spark):
    """A single row of 1970 or a burst in one hour leaves no segment far above the size asked for."""
    day = 1_700_000_000
    spread = [(day + 60 * k,) for k in range(2000)] + [(day + 7200 + k,) for k in range(2000)] + [(0,), (None,)]
    df = spark.createDataFrame(spread, "s bigint").select(F.timestamp_seconds("s").alias("ts"))
    counted = df.withColumn("segment", segment_of(df, "ts", rows=500)).groupBy("segment").count().collect()
    assert max(r["count"] for r in counted) <= 1000 and len(counted) >= 8
    ordered = df.withColumn("segment", segment_of(df, "ts", rows=500)).where("ts IS NOT NULL").orderBy("ts").collect()
    assert [r.segment for r in ordered] == sorted(r.segment for r in ordered)
    assert {r.segment for r in df.withColumn("segment", segment_of(df, "ts")).collect()} == {0, None}


def test_running_sums_and_maxima_shuffle_their_rows_once(spark):
    """Null keys, null values and a hot key, as plain windows have them; a row meets what comes before it without a join."""
    rows = spark.range(2000).select(
        F.when(F.col("id") % 10 < 7, "hot").when(F.col("id") % 10 == 9, F.lit(None)).otherwise(F.concat(F.lit("k"), F.col("id") % 7)).alias("key"),
        F.col("id").alias("at"),
        F.when(F.col("id") % 5 > 0, F.xxhash64("id") % 100).alias("v"),
    ).where("at % 13 <> 0")
    got = running(rows, ["key"], ["at"], id_segment(F.col("at"), 4), total={"sum": "v"}, peak_before={"peak": "v"}, stored=True)
    before = Window.partitionBy("key").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    upto = before.rowsBetween(Window.unboundedPreceding, 0)
    plain = rows.select("key", "at", "v", F.coalesce(F.sum("v").over(upto), F.lit(0)).alias("sum"), F.max("v").over(before).alias("peak"))
    assert got.columns == plain.columns and got.exceptAll(plain).count() == 0 and plain.exceptAll(got).count() == 0
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
