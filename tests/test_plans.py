"""Plans of the ranked results with the default configuration, and safe stage reuse."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from conftest import SF_SMALL
from scholarmetrics import Config
from scholarmetrics.operators import cutoffs as CO
from scholarmetrics.operators import metrics as M
from scholarmetrics.operators import ranking as R
from scholarmetrics.operators import reports as RP
from scholarmetrics.plans.pipeline import Run
from scholarmetrics.sources import io as IO
from scholarmetrics.sources.fixtures import CAREER, EDITION2017, build_inputs
from test_ordered import assert_distributed


@pytest.fixture(scope="module")
def run(spark):
    return E._run(spark, SF_SMALL)


@pytest.mark.parametrize("build", [
    lambda r: R.global_rank(r.profile, CAREER),
    lambda r: R.subfield_rank(r.profile, CAREER),
    lambda r: R.ranked_result(r.profile, CAREER),
    lambda r: CO.cutoff_table(r.result, CAREER),
    lambda r: CO.cutoffs_lower(E._run(r.spark, SF_SMALL, EDITION2017).result, EDITION2017),
    lambda r: RP.null_rank(r.result, "cprat_ws", CAREER),
    lambda r: RP.cprat_percentile(r.result, E.DRILL_SUBFIELD, CAREER),
    lambda r: M.h_and_hm(r.eligible, CAREER),
], ids=["global", "subfield", "result", "cutoffs", "cutoffs_lower", "null_rank", "percentile", "h_hm"])
def test_ranks_are_distributed(run, build):
    assert_distributed(build(run))


def test_no_rank_without_subfield(run):
    p = run.profile.withColumn("sm_subfield_1", F.when(F.col("author_id") % 2 == 0, F.col("sm_subfield_1")))
    rows = R.subfield_rank(p, CAREER).collect()
    assert all((r.sm_subfield_1 is None) == (r.rank_sm_subfield_1_ws is None) == (r.count_sm_subfield_1 is None) for r in rows)


def test_staging_needs_the_inputs_identity(spark):
    i = build_inputs(spark, SF_SMALL)
    anonymous = type(i)(**i.tables())
    with pytest.raises(ValueError, match="identity"):
        Run(spark, anonymous, CAREER)
    Run(spark, anonymous, CAREER, stage=False)


def test_changed_inputs_give_a_new_result(spark):
    i = build_inputs(spark, SF_SMALL)
    half = type(i)(**{**i.tables(), "corpus": i.corpus.filter(F.col("eid") % 2 == 0)}, key=f"{i.key}|half")
    a, b = Run(spark, i, CAREER).edges.count(), Run(spark, half, CAREER).edges.count()
    assert 0 < b < a and b == Run(spark, half, CAREER, stage=False).edges.count()


def test_stage_keys_hold_what_the_stage_depends_on(spark):
    i = build_inputs(spark, SF_SMALL)
    a, b = Run(spark, i, CAREER), Run(spark, i, CAREER.with_(top_n=7))
    assert a.metrics.inputFiles() == b.metrics.inputFiles()
    assert a.result.inputFiles() != b.result.inputFiles()
    assert a.metrics.inputFiles() != Run(spark, i, CAREER.with_(max_year=1999)).metrics.inputFiles()


def test_catalog_stage_follows_its_key(spark):
    db = IO.scratch_database(spark)
    try:
        build = lambda n: IO.stage_table(spark, lambda: spark.range(n), db, "t", f"key-{n}")
        assert build(3).count() == 3 and build(7).count() == 7
        again = IO.stage_table(spark, lambda: spark.range(99), db, "t", "key-7")
        assert again.count() == 7  # same key: not rebuilt
    finally:
        spark.sql(f"DROP DATABASE {db} CASCADE")


def test_scratch_tables_and_databases_are_dropped(spark, monkeypatch):
    for name in ("_SCRATCH", "_TABLES", "_DATABASES"):
        monkeypatch.setattr(IO, name, [])
    db = IO.scratch_database(spark)
    spark.range(3).write.saveAsTable(f"{db}.t")
    own = IO.write_buckets(spark.range(5), "own", "id")
    assert own.count() == 5 and spark.catalog.databaseExists(db)
    table = IO._TABLES[0]
    IO.release_scratch(spark)
    assert not spark.catalog.databaseExists(db) and not spark.catalog.tableExists(table)


def test_no_shared_folder_is_an_error_on_a_cluster(monkeypatch):
    class Context:
        master = "yarn"

        @staticmethod
        def getCheckpointDir():
            return None

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(key, default=None):
                return default

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        IO.shared_dir(Session())


def test_scratch_is_released(spark, monkeypatch):
    monkeypatch.setattr(IO, "_SCRATCH", [])
    df = IO.write_once(spark.range(5), "x")
    path = df.inputFiles()[0].rsplit("/", 1)[0]
    assert IO.path_exists(spark, path) and IO.release_scratch(spark) == 1 and not IO.path_exists(spark, path)


def test_config_has_no_size_switch():
    assert not {"skew_safe", "max_group_rows", "extra"} & set(Config.__dataclass_fields__)


@pytest.mark.parametrize("cfg", [CAREER, EDITION2017], ids=["2019", "2017"])
def test_authorship_scans_the_corpus_once(spark, cfg):
    i = build_inputs(spark, SF_SMALL)
    r = Run(spark, i, cfg)
    cites = IO.write_once(r.cites, "cites")  # the citation counts are an input of the fact
    from scholarmetrics.operators import authorship as A

    fact = A.authorship(r.pubs, cites, r.disc, cfg, r._with_subjects)
    scans = lambda df: [x for x in df._jdf.queryExecution().executedPlan().toString().splitlines() if "FileScan" in x]
    assert sum("au:array" in x or "source:struct" in x for x in scans(fact)) == 1
    # eligibility reads the staged fact, never the corpus
    assert not any("au:array" in x for x in scans(A.eligible_slots(r.authorship, cfg)))
