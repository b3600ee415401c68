"""Published maxima goldens, corpus reader, report CSV and maxima CSV round trips."""

import math

from pyspark.sql import functions as F

from conftest import SF_SMALL
from scholarmetrics.operators.score import COMPOSITE_METRICS, PUBLISHED_MAXIMA, published_maxima, read_maxima
from scholarmetrics.sources import io as IO
from scholarmetrics.sources.fixtures import build_inputs


def test_published_maxima_are_logs_of_whole_counts():
    # ln(x + 1) of counts: exp(v) - 1 is whole for every metric except hm (co-author adjusted)
    for table, vals in PUBLISHED_MAXIMA.items():
        assert len(vals) == 12
        for i, v in enumerate(vals):
            metric = COMPOSITE_METRICS[i % 6]
            x = math.exp(v) - 1
            if metric != "hm":
                assert abs(x - round(x)) < 1e-6, (table, i, x)
        # the with-self maximum is never below the one without
        for k in range(6):
            assert vals[k] >= vals[k + 6] - 1e-12


def test_maxima_csv_round_trip(spark):
    path = IO.scratch_path(spark, "maxima.csv")
    IO.write_report(published_maxima(spark, "single_year_2019"), path)
    back = read_maxima(spark, path).first()
    assert tuple(back) == PUBLISHED_MAXIMA["single_year_2019"]


def test_read_corpus_layout(spark):
    corpus = build_inputs(spark, SF_SMALL).corpus
    base = IO.scratch_path(spark, "core")
    corpus.write.parquet(IO.corpus_path(base, "v001", "full", "ani", "20200506"))
    back = IO.read_corpus(spark, base, "v001", "full", "20200506")
    assert back.schema == IO.CORPUS_SCHEMA
    assert back.count() == corpus.count()
    assert back.filter(F.col("year") >= 2000).count() == corpus.filter(F.col("year") >= 2000).count()


def test_stage_is_reused(spark):
    calls = []

    def build():
        calls.append(1)
        return spark.range(5)

    import uuid

    k = uuid.uuid4().hex  # the shared folder outlives this process
    a = IO.stage(spark, build, "reuse_test", f"{k}-1")
    b = IO.stage(spark, build, "reuse_test", f"{k}-1")
    assert len(calls) == 1 and a.count() == b.count() == 5
    IO.stage(spark, build, "reuse_test", f"{k}-2")
    assert len(calls) == 2


def test_year_columns_are_checked(spark):
    import pytest

    with pytest.raises(ValueError, match="year column"):
        IO.read_corpus(spark, "x", "v", year_col="sort_year")
    with pytest.raises(ValueError, match="layout"):
        IO.read_corpus(spark, "x", "v", layout="1999")


def test_outputs_read_back(spark):
    import __spark_entry__ as E
    from scholarmetrics.plans import outputs as OUT

    run = E._run(spark, SF_SMALL)
    out = OUT.write_outputs(run, IO.scratch_path(spark, "out"))
    assert OUT.read_result(spark, out).count() == run.result.count()
    assert OUT.read_run_maxima(spark, out).first() == run.maxima.first()
    field = OUT.read_cutoffs(spark, out.field_cutoffs, run)
    assert {r.level for r in field.collect()} == {"field", "total"}
    assert OUT.read_top_list(spark, out, run).count() == run.top.count()
