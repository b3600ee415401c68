from pyspark.sql import functions as F

from scholarmetrics.llm import urls as U

ENTRIES = [
    ("bad.com", 100, "add", "spam"), ("bad.com", 200, "remove", "spam"), ("bad.com", 300, "add", "ads"), ("bad.com", 300, "add", "ads"),
    ("ok.org/x/y", 50, "add", "path"), ("sub.bad.com", 150, "add", "sub"), ("tie.net", 10, "add", "t"), ("tie.net", 10, "remove", "t"),
    (None, 10, "add", "n"), ("nodate.com", None, "add", "n"),
]


def test_keys(spark):
    df = spark.createDataFrame([("http://u:p@A.B.co.uk:80/x//y/?q#z",), ("ftp://h",), ("nope",), (None,), ("http://h./",)], "url string")
    assert [r.k for r in df.select(U.candidate_keys(F.col("url")).alias("k")).collect()] == [
        ["a.b.co.uk", "b.co.uk", "co.uk", "a.b.co.uk/x", "a.b.co.uk/x/y"], ["h"], [], [], ["h"]]


def test_as_of_verdicts(spark):
    entries = spark.createDataFrame(ENTRIES, "key string, listed_at long, action string, category string")
    rows = [(1, "http://bad.com/", 99), (2, "http://bad.com/", 100), (3, "http://www.bad.com/", 199), (4, "http://bad.com/", 200),
            (5, "http://bad.com/", 5000), (6, "http://sub.bad.com/", 250), (7, "http://sub.bad.com/", 160), (8, "http://ok.org/x/y/z?q", 60),
            (9, "http://ok.org/x/", 60), (10, "http://tie.net/", 10), (11, None, 10), (12, "http://bad.com/", None), (13, "http://nodate.com", 500),
            (2, "http://bad.com/", 100)]
    pages = spark.createDataFrame(rows, "page_id long, url string, at long").withColumns({"key": F.lit(1), "category": F.lit("c"), "blocked": F.lit(2)})
    out = U.evaluate(pages, F.col("at"), entries).collect()
    assert len(out) == len(rows)
    got = {r["_row"]["page_id"]: (r["blocked"], r["matched_key"], r["category"]) for r in out}
    no = (False, None, None)
    assert got == {1: no, 2: (True, "bad.com", "spam"), 3: (True, "bad.com", "spam"), 4: no, 5: (True, "bad.com", "ads"),
                   6: (True, "sub.bad.com", "sub"), 7: (True, "sub.bad.com", "sub"), 8: (True, "ok.org/x/y", "path"), 9: no, 10: no, 11: no, 12: no, 13: no}
    kept = U.url_filter(pages, F.col("at"), entries)
    assert kept.columns == pages.columns and {r.page_id for r in kept.collect()} == {1, 4, 9, 10, 11, 12, 13}
    assert U.url_filter(pages, F.col("at"), entries.limit(0)).count() == len(rows)
    assert U.url_filter(pages.limit(0), F.col("at"), entries).count() == 0
