"""The files a run leaves: result, maxima, cut-offs per field and subfield, top list."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..operators.score import maxima_columns, read_maxima
from ..sources.io import read_report, write_report
from .pipeline import Run
from .publish import publish


@dataclass(frozen=True)
class Outputs:
    """Paths of a run's outputs under one folder."""

    result: str  # parquet: every profiled author with metrics, ranks and flags
    maxima: str  # CSV: the 12 log maxima, to be used as published maxima by another run
    field_cutoffs: str  # CSV, with the TOTAL row
    subfield_cutoffs: str  # CSV, with the TOTAL row
    top_list: str  # CSV: the published table of the top list


def output_paths(base: str, run: Run) -> Outputs:
    c = run.cfg
    stem = f"{base.rstrip('/')}/{c.name}_{c.min_year}_{c.min_cite_year}_{c.max_year}"
    return Outputs(f"{stem}_result.parquet", f"{stem}_maxima.csv", f"{stem}_cutoffs_field.csv", f"{stem}_cutoffs_subfield.csv",
                   f"{stem}_top_list.csv")


def write_outputs(run: Run, base: str) -> Outputs:
    """Write all outputs of ``run`` under ``base``. The result is written as it is partitioned;
    the reports (a row per subject, one row, the top list) are one CSV file each."""
    out = output_paths(base, run)
    run.result.write.mode("overwrite").parquet(out.result)
    write_report(run.maxima.select(*maxima_columns()), out.maxima)
    for path, level in ((out.field_cutoffs, "field"), (out.subfield_cutoffs, "subfield")):
        write_report(run.cutoffs.filter(run.cutoffs["level"].isin(level, "total")), path)
    write_report(publish(run.top, run.cfg), out.top_list)
    return out


def read_result(spark: SparkSession, out: Outputs) -> DataFrame:
    return spark.read.parquet(out.result)


def read_run_maxima(spark: SparkSession, out: Outputs) -> DataFrame:
    return read_maxima(spark, out.maxima)


def read_cutoffs(spark: SparkSession, path: str, run: Run) -> DataFrame:
    return read_report(spark, path, run.cutoffs.schema)


def read_top_list(spark: SparkSession, out: Outputs, run: Run) -> DataFrame:
    return read_report(spark, out.top_list, publish(run.top, run.cfg).schema)
