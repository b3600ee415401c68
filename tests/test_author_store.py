"""Metrics from mergeable parts, and the author store: joins by author move nothing."""

import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from conftest import SF_SMALL
from scholarmetrics.operators import authorship as A
from scholarmetrics.operators import metrics as M
from scholarmetrics.operators import ranking as R
from scholarmetrics.operators import subjects as SJ
from scholarmetrics.plans.pipeline import Run
from scholarmetrics.sources import io as IO
from scholarmetrics.sources.fixtures import CAREER, build_inputs

AUTH = "auid long, eid long, n_authors int, cites_ns long, cites_ws long, repeats boolean"


@pytest.fixture
def no_broadcast(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def brute(rows):
    """h and hm by their definition: SQL rank and RANGE sums over (citations desc, eid)."""
    out = {}
    by = defaultdict(list)
    for auid, eid, n, ns, ws, _ in rows:
        by[auid].append((eid, 1 / n, ns, ws))
    for auid, own in by.items():
        got = []
        for k in (2, 3):
            order = sorted(own, key=lambda r: (-r[k], r[0]))
            h, hm = 0, 0.0
            for r in order:
                rank = 1 + sum((-x[k], x[0]) < (-r[k], r[0]) for x in order)
                cum = sum(x[1] for x in order if (-x[k], x[0]) <= (-r[k], r[0]))
                if rank <= r[k]:
                    h = max(h, rank)
                if round(cum, M.SUM_DIGITS) <= r[k]:
                    hm = max(hm, cum)
            got += [h, pytest.approx(hm)]
        out[auid] = tuple(got)
    return out


def slots(seed, authors, repeated):
    r = random.Random(seed)
    rows = []
    for a in range(authors):
        for _ in range(r.choice([1, 3, 10, 40])):
            ws = min(int(r.expovariate(0.25)), 12)
            row = (a, r.randrange(10**6), r.choice([1, 1, 2, 3, 7, 50]), r.randint(0, ws), ws)
            twice = repeated and r.random() < 0.3
            rows += [(*row, twice)] * (2 if twice else 1)
    return rows


def indexes(spark, rows, drop=False):
    df = spark.createDataFrame(rows, AUTH).repartition(5)
    got = M.h_and_hm(df.drop("repeats") if drop else df, CAREER).collect()
    return {r.auid: (r.h_ns, r.hm_ns, r.h_ws, r.hm_ws) for r in got}


@pytest.mark.parametrize("repeated", [False, True])
@pytest.mark.parametrize("seed", [1, 2])
def test_indexes_equal_their_definition(spark, seed, repeated):
    rows = slots(seed, 60, repeated)
    assert indexes(spark, rows) == brute(rows)


def test_without_the_mark_every_paper_may_repeat(spark):
    rows = slots(3, 30, True)
    assert indexes(spark, rows, drop=True) == brute(rows)


def test_hot_author_with_one_level(spark, monkeypatch):
    """A third of all slots, equally cited, with small weights: the level is dealt to SALTS partitions."""
    r = random.Random(4)
    hot = [(999, e, r.choice([3, 20, 100]), 5, 5, False) for e in range(1500)]
    rows = hot + [(e % 1000, 10**6 + e, 2, 1, 2, False) for e in range(3000) if e % 1000 != 999]
    want = brute(rows)
    assert indexes(spark, rows) == want
    settled = M._settled(spark.createDataFrame(rows, AUTH))
    text = plan(M._by_paper(spark.createDataFrame(rows, AUTH), settled))
    assert "rangepartitioning" not in text and "SinglePartition" not in text


def test_histogram_merges_and_uncited_papers_are_one_cell(spark):
    rows = [(1, e, 2, 0, 0, False) for e in range(500)] + [(1, 900 + e, 4, 2, 3, e == 1) for e in range(2)]
    cells = {(c.cites_ns, c.cites_ws): (c.n, c.w, c.repeats) for c in M.citation_histogram(spark.createDataFrame(rows, AUTH)).collect()}
    assert cells == {(0, 0): (500, 250.0, False), (2, 3): (2, 0.5, True)}
    assert indexes(spark, rows) == brute(rows)


def test_citing_papers_of_a_hot_author(spark):
    r = random.Random(6)
    auth = [(a, e) for e in range(300) for a in ({7, r.randrange(40)} if e % 3 else {r.randrange(40)})]
    edges = list({(c, e): (c, e, r.randrange(2)) for c, e in ((r.choice([-5, 0, 63, 64, 10**12]) + r.randrange(200), r.randrange(300)) for _ in range(4000))}.values())
    want = defaultdict(lambda: (set(), set()))
    for a, e in auth:
        for c, cited, own in edges:
            if cited == e:
                want[a][0].add(c)
                if not own:
                    want[a][1].add(c)
    got = M.citing_papers(spark.createDataFrame(auth, "auid long, eid long"), spark.createDataFrame(edges, "citing long, cited long, is_self int"))
    assert {r.auid: (r.ncp_ws, r.ncp_ns) for r in got.collect()} == {a: (len(x), len(y)) for a, (x, y) in want.items()}


def test_author_metrics_and_profile_join_without_a_shuffle(spark, no_broadcast):
    r = E._run(spark, SF_SMALL)
    metrics = M.author_metrics(r.eligible, r.edges, r.subjects, CAREER)
    assert "SortMergeJoin" in plan(metrics) and "Exchange" not in plan(metrics)
    profile = R.author_profile(r.metrics.withColumns({"c_ns": F.lit(0.0), "c_ws": F.lit(0.0)}), r.names, r.affiliation, CAREER)
    assert "SortMergeJoin" in plan(profile) and "Exchange" not in plan(profile)


def test_author_slots_are_shuffled_once(spark, no_broadcast):
    r = E._run(spark, SF_SMALL)
    by_author = (M.author_volume(r.eligible, CAREER), M.author_positions(r.eligible), M.citation_histogram(r.eligible))
    assert all("Exchange" not in plan(df) for df in by_author)
    assert "hashpartitioning(auid" not in plan(SJ.author_subjects(r.eligible, CAREER))
    # pairs are dealt by author, without a map-side table of them
    assert not re.search(r"hashpartitioning\(auid#\d+L?, citing", plan(M.citing_papers(r.eligible, r.edges)))


def test_references_are_dealt_by_paper_once(spark, no_broadcast):
    assert not re.search(r"hashpartitioning\(citing#\d+L?, cited", plan(build_inputs(spark, SF_SMALL, materialize=False).corpus))


def test_earlier_papers_are_found_by_block(spark, no_broadcast, monkeypatch):
    """The orders at fixed key offsets, as a plain join finds them, with blocks that the offsets cross."""
    from scholarmetrics.sources import fixtures as FX

    monkeypatch.setattr(FX, "REFERENCE_BLOCK", 50, raising=False)
    corpus = build_inputs(spark, SF_SMALL, materialize=False).corpus
    assert not re.search(r"hashpartitioning\(k#", plan(corpus))  # no row per offset is shuffled
    date = {r.o_orderkey: r.o_orderdate for r in spark.read.parquet(f"{SF_SMALL}/orders.parquet").collect()}
    want = {(e, e - d) for e in date for d in FX.REFERENCE_OFFSETS if e - d in date and date[e - d] < date[e]}
    got = {(r.eid, c) for r in corpus.select("eid", F.explode("references").alias("c")).collect() for c in [r.c]}
    assert want <= got
    same_author = got - want - {(e, e + FX.OUTSIDE_ID_BASE) for e in date}
    authors = {r.eid: {x for x in r.ids or [] if x.isdigit()} for r in corpus.select("eid", F.col("au.auid").alias("ids")).collect()}
    assert all(authors[a] & authors[b] for a, b in same_author)


def test_eligible_slots_are_those_of_eligible_authors(spark):
    rows = [(a, 10 * a + e, "ar" if e < a else "ed", 2000) for a in range(9) for e in range(8)] + [(5, None, "ar", 2000)] * 3
    auth = spark.createDataFrame(rows + rows[:3], "auid long, eid long, publication_type string, year int")
    want = auth.join(A.eligible_authors(auth, CAREER).select("auid"), "auid", "left_semi")
    got = A.eligible_slots(auth, CAREER)
    assert got.columns == auth.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, want.select(*auth.columns).collect())) and got.count() < auth.count()


def test_slots_bring_no_paper_columns_to_the_authors(spark):
    r = E._run(spark, SF_SMALL)
    assert not {"publication_type", "srcid", "domain"} & set(r.eligible.columns)
    assert {"publication_type", "srcid"} <= set(r.authorship.columns)


def test_bucketed_stage_is_found_by_a_new_session(spark, tmp_path):
    build = lambda: spark.range(100).select((F.col("id") % 10).alias("auid"), F.struct("id", F.lit("a").alias("t")).alias("s"))
    first = IO.stage(spark, build, "t", "k", base=str(tmp_path), by="auid")
    table = next(t.name for t in spark.catalog.listTables() if t.name.startswith("sm_stage_t_"))
    spark.sql(f"DROP TABLE {table}")  # an external table: the files stay, as after the end of a session
    again = IO.stage(spark, lambda: pytest.fail("built again"), "t", "k", base=str(tmp_path), by="auid")
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, build().collect()))
    assert again.schema == first.schema or [f.dataType for f in again.schema] == [f.dataType for f in first.schema]
    assert "Exchange" not in plan(again.groupBy("auid").count())
    spark.sql(f"DROP TABLE {table}")


def test_stage_files_and_schema(spark, tmp_path):
    build = lambda: spark.range(1000).select("id", F.lit(1).cast("short").alias("s"))
    df = IO.stage(spark, build, "t", "k", base=str(tmp_path), files=3)
    assert len(df.inputFiles()) == 3 and df.schema["s"].dataType.simpleString() == "smallint"
    none = IO.stage(spark, lambda: build().filter("id < 0"), "none", "k", base=str(tmp_path))
    assert none.count() == 0 and none.columns == ["id", "s"]  # no file tells the schema of an empty stage
    with pytest.raises(ValueError, match="buckets"):
        IO.stage(spark, build, "t", "k", base=str(tmp_path), by="id", files=3)


def test_an_edit_of_the_training_data_operators_keeps_the_stages(monkeypatch):
    import pathlib

    read = []
    real = pathlib.Path.read_bytes
    monkeypatch.setattr(pathlib.Path, "read_bytes", lambda self: read.append(self) or real(self))
    IO.code_version()
    assert read and not any("llm" in p.parts for p in read)


def test_store_survives_another_bucket_count(spark):
    i = build_inputs(spark, SF_SMALL)
    a = Run(spark, i, CAREER).names
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "5")
    try:
        b = Run(spark, i, CAREER).names
        assert a.inputFiles() != b.inputFiles() and a.count() == b.count()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
