from pyspark.sql import functions as F

from scholarmetrics.functions import percent_label, ratio, shares_author, within_percentile_upper


def test_percent_label_exact_half_up(spark):
    df = spark.createDataFrame([(1, 32), (1, 3), (0, 5), (5, 0), (None, 4), (2, 3)], "n long, d long")
    got = [r[0] for r in df.select(percent_label("n", "d", " %")).collect()]
    assert got == ["3.13 %", "33.33 %", "0.00 %", None, None, "66.67 %"]


def test_ratio_zero_is_null(spark):
    df = spark.createDataFrame([(3, 0), (3, 2)], "a long, b long")
    assert [r[0] for r in df.select(ratio("a", "b")).collect()] == [None, 1.5]


def test_shares_author_ignores_null_ids(spark):
    df = spark.createDataFrame(
        [([1, None], [None, 2]), ([1, 2], [2]), (None, [1]), ([None], [None])], "a array<long>, b array<long>"
    )
    assert [r[0] for r in df.select(shares_author("a", "b")).collect()] == [False, True, False, False]


def test_within_percentile_upper(spark):
    # 4 non-null values ranked 1..4 desc: top 25 % is rank 1 only
    df = spark.createDataFrame([(1,), (2,), (3,), (4,)], "r long")
    got = [r[0] for r in df.select(within_percentile_upper("r", F.lit(4), 0.75)).collect()]
    assert got == [True, True, False, False]
