"""The derived corpus: what is shuffled for it, and the order of slots that only price and names tell apart."""

from datetime import datetime

from pyspark.sql import functions as F

from scholarmetrics.functions.membership import may_hold
from scholarmetrics.sources.fixtures import build_inputs


def _tables(spark, path, parts):
    day = datetime(1998, 1, 1)
    rows = {
        "region": (["r_regionkey", "r_name"], "int, string", [(0, "R0")]),
        "nation": (["n_nationkey", "n_name", "n_regionkey"], "int, string, int", [(1, "N1", 0), (2, "N2", 0)]),
        # no nation 9: its supplier has no labels
        "supplier": (["s_suppkey", "s_name", "s_nationkey", "s_acctbal"], "long, string, int, double", [(1, "S1", 1, 0.0), (2, "S2", 2, 0.0), (3, "S3", 9, 0.0)]),
        "part": (["p_partkey", "p_name", "p_brand"], "long, string, string", parts),
        "orders": (["o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority"], "long, long, timestamp_ntz, string", [(1, 1, day, "1-URGENT"), (2, 1, day, "5-LOW")]),
        "lineitem": (["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", "l_shipdate"], "long, long, long, int, double, timestamp_ntz",
                     [(1, 10, 2, 1, 5.0, day), (1, 10, 2, 1, 4.0, day), (1, 11, 1, 2, 1.0, day), (1, 12, 3, 3, 1.0, day)]),
    }
    for name, (cols, types, data) in rows.items():
        schema = ", ".join(f"{c} {t.strip()}" for c, t in zip(cols, types.split(","), strict=True))
        spark.createDataFrame(data, schema).write.parquet(f"{path}/{name}.parquet")
    return str(path)


PARTS = [(10, "a", "B1"), (11, "b", "B2"), (12, "c", "B3")]


def test_slots_are_not_shuffled_for_suppliers_or_with_prices(spark, tmp_path):
    d = _tables(spark, tmp_path / "t", PARTS)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "50000")  # above the suppliers, below suppliers x nations
    try:
        plan = build_inputs(spark, d, materialize=False).corpus._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert "hashpartitioning(l_suppkey" not in plan
    assert "l_extendedprice" not in plan


def test_labels_and_order_of_slots(spark, tmp_path):
    paper = {r.eid: r for r in build_inputs(spark, _tables(spark, tmp_path / "t", PARTS), materialize=False).corpus.collect()}
    assert [(a.auid, a.authorseq, a.indexed_name) for a in paper[1].au] == [("10", 1, "a"), ("10", 2, "a"), ("11", 3, "b"), ("12", 4, "c")]
    assert [x.affiliation_seq for x in paper[1].au_af] == [2, 2, 1, 3]
    assert [(f.afid, f.affiliation_tag_country) for f in paper[1].af] == [(1, "N1"), (2, "N2"), (3, None)]
    assert paper[1].source.srcid == 2 and paper[2].au is None


def test_repeated_part_keeps_the_order_by_price(spark, tmp_path):
    d = _tables(spark, tmp_path / "t", [*PARTS, (10, "z", "B9")])
    [r] = build_inputs(spark, d, materialize=False).corpus.filter("eid = 1").collect()
    # price 4 with both names, then price 5 with both
    assert [a.indexed_name for a in r.au] == ["a", "z", "a", "z", "b", "c"]


def test_bitmap_words(spark):
    ids = spark.range(0, 1 << 17, 7).select(F.xxhash64("id").alias("h"))
    asked = spark.range(0, 1 << 17).withColumn("h", F.xxhash64("id"))
    place = F.col("h").bitwiseAND(F.lit((1 << 16) - 1))
    held = {r.p for r in ids.select(place.alias("p")).distinct().collect()}
    got = may_hold(asked, "h", ids, 16, "hit").select("id", place.alias("p"), "hit").collect()
    assert len(got) == 1 << 17 and all(r.hit == (r.p in held) for r in got)
    assert "_words" in may_hold(asked, "h", ids, 16, "hit")._jdf.queryExecution().analyzed().toString()  # words, not copies of a block
