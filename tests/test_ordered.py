"""ordered_rows / ordered_prefix equal the plain window functions, whatever the skew."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from scholarmetrics.operators.ordered import ordered_prefix, ordered_rows, rank_rows


@pytest.fixture(scope="module")
def data(spark):
    rnd = random.Random(7)
    rows = []
    for i in range(6000):
        g = rnd.choice([None, "hot", "hot", "hot", "hot", "b", "c"])  # one group holds most rows
        v = rnd.choice([None, 3, 3, 3, 3, *range(12)])  # and one value most of it
        rows.append((i, g, v, rnd.randint(1, 40), rnd.random()))
    return spark.createDataFrame(rows, "id int, g string, v int, e int, w double").repartition(5)


def plain(df, by, order, cum=None):
    win = Window.partitionBy(*by).orderBy(*order)
    out = df.withColumns({"rk": F.rank().over(win), "size": F.count(F.lit(1)).over(Window.partitionBy(*by))})
    return out.withColumn("cw", F.sum(cum).over(win.rangeBetween(Window.unboundedPreceding, 0))) if cum else out


def rows_of(df, *cols):
    return sorted((tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in df.select(*cols).collect()), key=str)


@pytest.mark.parametrize("spread", [[], ["id"]])
@pytest.mark.parametrize("order", [[("v", False)], [("v", True)], [("v", False), ("e", True)]])
@pytest.mark.parametrize("by", [[], ["g"], ["g", "e"]])
def test_rows_equal_windows(data, by, order, spread):
    got = ordered_rows(data, by, order, ["w", "e"], spread=spread)
    cols = [F.col(c).asc_nulls_first() if a else F.col(c).desc_nulls_last() for c, a in order]
    want = plain(data, by, cols, "w")
    assert got.columns == [*data.columns, "_rank", "_size", "_cum_w", "_cum_e"]
    assert rows_of(got, "id", "_rank", "_size", "_cum_w") == rows_of(want, "id", "rk", "size", "cw")


def test_prefix_is_a_histogram_with_ranks(data):
    pre = ordered_prefix(data, ["g"], [("v", False)], ["w"])
    want = plain(data, ["g"], [F.col("v").desc_nulls_last()], "w").groupBy("g", "v").agg(
        F.count(F.lit(1)).alias("n"), F.min("rk").alias("rk"), F.max("cw").alias("cw"))
    assert rows_of(pre, "g", "v", "_n", "_rank", "_cum_w") == rows_of(want, "g", "v", "n", "rk", "cw")


def test_a_hundred_thousand_ties(spark):
    df = spark.range(120_000).select(F.col("id"), F.lit("g").alias("g"), F.when(F.col("id") < 100_000, 0).otherwise(F.col("id") % 7).alias("v"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # as if the rows were many
    try:
        got = ordered_rows(df, ["g"], [("v", False)], spread=["id"])
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = {r.v: r.rk for r in plain(df, ["g"], [F.col("v").desc()]).select("v", "rk").distinct().collect()}
    assert {(r.v, r._rank) for r in got.select("v", "_rank").distinct().collect()} == set(want.items())
    # the ties do not meet in one partition
    parts = spark.read.parquet(*{f.rsplit("/", 1)[0] for f in got.inputFiles()}).groupBy("_pid").count().collect()
    assert max(p["count"] for p in parts) < 60_000 and got.count() == 120_000


def test_empty_and_single_rows(data):
    assert ordered_rows(data.limit(0), ["g"], [("v", True)], ["w"]).count() == 0
    one = rank_rows(data.limit(1), [], [("v", True)], "r").first()
    assert one.r == 1


def assert_distributed(df):
    """Only per-partition totals may meet in one partition, and no window runs over (group) alone on rows."""
    df.collect()
    lines = df._jdf.queryExecution().executedPlan().toString().splitlines()
    for i, line in enumerate(lines):
        if "SinglePartition" in line:
            above = " ".join(lines[max(0, i - 6) : i])
            assert "_off" in above or "_size" in above or "_start" in above or "_n" in above, above
        if "Window [" in line and "AS _lr" in line:
            assert "_pid" in line.split("]", 1)[1], line


def test_no_single_task_window_on_rows(data):
    assert_distributed(ordered_rows(data, [], [("v", False)], ["w"], spread=["id"]))
    assert_distributed(ordered_rows(data, ["g"], [("v", False)], spread=["id"]))
