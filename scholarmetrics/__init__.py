"""Citation metrics for authors of a publication corpus, as Spark DataFrame functions.

Layout:
  config          run parameters (``Config``)
  sources/        corpus and side-table readers, sinks, staging, test fixtures
  functions/      column expressions shared by the operators
  operators/      the domain operators: citations, authorship, subjects,
                  metrics, score, labels, ranking, cut-offs, reports
  plans/          end-to-end runs (career / single year) and the published table
  streaming/      nothing: the workload is batch only
"""

from .config import CAREER_2019, EDITION_2017, SINGLE_YEAR_2019, Config

__all__ = ["Config", "CAREER_2019", "SINGLE_YEAR_2019", "EDITION_2017"]
