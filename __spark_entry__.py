"""

``entry(spark)`` runs the flagship query (the career top list) on sf0.001.
``queries()`` maps every implemented operator to a callable (spark, sf_dir)
that builds the corpus from the driver's tables and applies the library
function over the whole tables. ``oracle_sql()`` holds, for each key, the
DuckDB statement computing the same result from the same tables.
"""

from __future__ import annotations

import os
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import oracles as O  # noqa: E402
from scholarmetrics.operators import authorship as A  # noqa: E402
from scholarmetrics.operators import citations as C  # noqa: E402
from scholarmetrics.operators import cutoffs as CO  # noqa: E402
from scholarmetrics.operators import labels as L  # noqa: E402
from scholarmetrics.operators import metrics as M  # noqa: E402
from scholarmetrics.operators import ranking as R  # noqa: E402
from scholarmetrics.operators import refresh as RF  # noqa: E402
from scholarmetrics.operators import reports as RP  # noqa: E402
from scholarmetrics.operators import score as S  # noqa: E402
from scholarmetrics.operators import subjects as SJ  # noqa: E402
from scholarmetrics.plans import outputs as OUT  # noqa: E402
from scholarmetrics.plans import publish as P  # noqa: E402
from scholarmetrics.plans.pipeline import Run  # noqa: E402
from scholarmetrics.sources import io as IO  # noqa: E402
from scholarmetrics.sources.fixtures import CAREER, EDITION2017, SINGLE_YEAR, SPARSE, build_inputs  # noqa: E402

SMOKE_DIR = "/root/testdata/sf0.001"
DIGITS = 6


def _round(df: DataFrame) -> DataFrame:
    """Doubles rounded for comparison (ln and summation order differ in the last bits)."""
    return df.withColumns(
        {f.name: F.round(f.name, DIGITS) for f in df.schema.fields if isinstance(f.dataType, T.DoubleType)}
    )


def _run(spark: SparkSession, sf_dir: str, cfg=CAREER, **kw) -> Run:
    return Run(spark, build_inputs(spark, sf_dir), cfg, **kw)


# ---------------------------------------------------------------------------
# queries
# ---------------------------------------------------------------------------

METRIC_COLS = [
    "auid", "np", "npc_ns", "npc_ws", "nc_ns", "nc_ws", "np_d", "nc_d",
    "nps", "ncs_ns", "ncs_ws", "npsf", "ncsf_ns", "ncsf_ws", "npsfl", "ncsfl_ns", "ncsfl_ws",
    "h_ns", "hm_ns", "h_ws", "hm_ws", "ncp_ws", "ncp_ns",
    "sm_subfield_1", "sm_subfield_1_frac", "sm_subfield_2", "sm_subfield_2_frac", "sm_field", "sm_field_frac",
    "n_classified",
]
LOG_COLS = [f"l{k}_{v}" for v in ("ns", "ws") for k in S.COMPOSITE_METRICS]


def q_citing_edges(spark, d):
    r = _run(spark, d)
    return r.edges


def q_self_citation(spark, d):
    return C.self_citations(_run(spark, d).edges)


def q_paper_citations(spark, d):
    return _run(spark, d).cites


SNAPSHOT_YEAR = 2000  # the earlier snapshot holds the papers up to this year


def _refreshed(spark, d):
    i = build_inputs(spark, d)
    earlier = RF.full_state(i.corpus.filter(F.col("year") <= SNAPSHOT_YEAR), CAREER)
    return earlier, RF.refresh(earlier, i.corpus, CAREER)


def q_refreshed_edges(spark, d):
    """The edges of the whole corpus, refreshed from those of an earlier snapshot."""
    return C.with_discontinued(_refreshed(spark, d)[1].state.edges, build_inputs(spark, d).discontinued)


def q_refreshed_citations(spark, d):
    disc = build_inputs(spark, d).discontinued
    earlier, r = _refreshed(spark, d)
    return RF.refreshed_citations(C.paper_citations(C.with_discontinued(earlier.edges, disc)), r, disc)


def q_discontinued_flags(spark, d):
    r = _run(spark, d)
    return C.discontinued_flags(r.pubs, r.edges, r.disc)


def q_authorship(spark, d):
    r = _run(spark, d)
    return r.authorship.select(
        "eid", "auid", "authorseq", "n_authors", "year", "publication_type", "srcid", "is_disc_source",
        "cites_ws", "cites_ns", "cites_disc",
    )


def q_eligible_authors(spark, d):
    return A.eligible_authors(_run(spark, d).authorship, CAREER)


def q_h_index(spark, d):
    return M.h_index(_run(spark, d).eligible, CAREER)


def q_hm_index(spark, d):
    return _round(M.hm_index(_run(spark, d).eligible, CAREER))


def q_author_volume(spark, d):
    return M.author_volume(_run(spark, d).eligible, CAREER)


def q_author_positions(spark, d):
    return M.author_positions(_run(spark, d).eligible)


def q_citing_papers(spark, d):
    r = _run(spark, d)
    return M.citing_papers(r.eligible, r.edges)


def _metrics(spark, d, cfg):
    return _round(_run(spark, d, cfg).metrics.select(*METRIC_COLS))


def q_author_metrics(spark, d):
    return _metrics(spark, d, CAREER)


def q_author_metrics_sparse(spark, d):
    return _metrics(spark, d, SPARSE)


def q_paper_subject(spark, d):
    r = _run(spark, d)
    return r.paper_subjects


def q_journal_subject(spark, d):
    r = _run(spark, d, EDITION2017)
    return SJ.journal_subject(r.pubs, r.inputs.journal_map, r.inputs.subject_tree, EDITION2017)


def q_subject_dictionary(spark, d):
    return SJ.subject_dictionary(build_inputs(spark, d).smc)


def q_subject_volume(spark, d):
    return SJ.subject_volume(_run(spark, d).eligible, "subfield")


def q_author_subjects(spark, d):
    return _round(_run(spark, d).subjects)


def q_author_subjects_sparse(spark, d):
    return _round(_run(spark, d, SPARSE).subjects)


def q_log_metrics(spark, d):
    return _round(_run(spark, d).logs.select("auid", *LOG_COLS))


def q_log_maxima(spark, d):
    return _round(_run(spark, d).maxima)


def q_composite(spark, d):
    return _round(_run(spark, d).scored.select("auid", "c_ns", "c_ws"))


def q_composite_fixed_max(spark, d):
    """Composite against the published maxima, read back from a maxima CSV in the
    published layout (12 columns, with-self block first)."""
    path = IO.scratch_path(spark, "maxima.csv")
    IO.write_report(S.published_maxima(spark, "career_2019"), path)
    r = _run(spark, d, maxima_override=S.read_maxima(spark, path))
    return _round(r.scored.select("auid", "c_ns", "c_ws"))


def q_author_name(spark, d):
    return L.author_names(build_inputs(spark, d).corpus).select("auid", "authfull", "last_eid_name")


def q_author_years(spark, d):
    return L.author_names(build_inputs(spark, d).corpus).select("auid", "firstyr", "lastyr")


def q_author_affiliation(spark, d):
    i = build_inputs(spark, d)
    return L.author_affiliation(i.corpus, i.ipr)


def q_author_affiliation_latest(spark, d):
    i = build_inputs(spark, d)
    return L.author_affiliation_latest(i.corpus, i.inst_map, i.inst)


def q_institution_dedupe(spark, d):
    i = build_inputs(spark, d)
    return L.institution_dedupe(i.inst_map, i.inst)


def q_dup_check(spark, d):
    return A.dup_check(_run(spark, d).authorship, ["eid", "auid"])


def _result(spark, d, cfg=CAREER, **kw):
    return _run(spark, d, cfg, **kw).result


def q_author_profile(spark, d):
    p = _run(spark, d).profile
    return _round(p.select("author_id", "authfull", "inst_name", "cntry", "firstyr", "lastyr", "np", "c_ns", "c_ws"))


def q_global_rank(spark, d):
    r = R.global_rank(_run(spark, d).profile, CAREER)
    return _round(r.select("author_id", "c_ns", "c_ws", "rank_ns", "rank_ws"))


def _ratios(spark, d, cfg):
    r = R.citation_ratios(_run(spark, d, cfg).profile)
    return _round(r.select("author_id", "self_p", "cprat_ns", "cprat_ws"))


def q_citation_ratios(spark, d):
    return _ratios(spark, d, CAREER)


def q_citation_ratios_sparse(spark, d):
    return _ratios(spark, d, SPARSE)


def q_subfield_rank(spark, d):
    return R.subfield_rank(_run(spark, d).profile, CAREER).select(
        "author_id", "sm_subfield_1", "rank_sm_subfield_1_ws", "rank_sm_subfield_1_ns", "count_sm_subfield_1"
    )


def q_top_list(spark, d):
    return R.top_list(_result(spark, d), CAREER).select(
        "author_id", "rank_ns", "rank_ws", "rank_sm_subfield_1_ws", "rank_sm_subfield_1_ns", "count_sm_subfield_1"
    )


def q_top_n_either(spark, d):
    return R.top_n_either(_result(spark, d, EDITION2017), EDITION2017).select(
        "author_id", "rank_ns", "rank_ws", "inst_name", "cntry",
        "sm_subfield_1", "sm_subfield_1_name", "sm_field", "sm_field_name",
    )


def q_place_on_scale(spark, d):
    """Authors absent from the published top list, placed on its scale."""
    r = _run(spark, d)
    published = r.top.select("author_id", "c_ns", "c_ws")
    return _round(R.place_on_scale(r.profile.join(published.select("author_id"), "author_id", "left_anti"), published))


def q_subject_cutoffs(spark, d):
    return _round(CO.subject_cutoffs(_run(spark, d).cutoffs, CAREER))


def q_toplist_cutoffs(spark, d):
    return _round(CO.toplist_cutoffs(_run(spark, d).cutoffs, CAREER))


def q_toplist_above(spark, d):
    return CO.toplist_above(_run(spark, d).cutoffs, CAREER)


def q_cutoffs_lower(spark, d):
    return _round(_run(spark, d, EDITION2017).cutoffs)


def q_subfield_report_2017(spark, d):
    r = _run(spark, d, EDITION2017)
    return _round(RP.subfield_report_2017(r.cutoffs, r.inputs.subject_tree))


def q_field_report(spark, d):
    r = _run(spark, d)
    return _round(RP.field_report(r.cutoffs, SJ.subject_dictionary(r.inputs.smc), CAREER))


def q_subfield_report(spark, d):
    r = _run(spark, d)
    return _round(RP.subfield_report(r.cutoffs, SJ.subject_dictionary(r.inputs.smc), CAREER))


def q_dropout_stats(spark, d):
    r = _run(spark, d)
    return _round(RP.dropout_stats(r.result, r.cutoffs, CAREER))


DRILL_SUBFIELD = "NATION_9"


def q_cprat_percentile(spark, d):
    return _round(RP.cprat_percentile(_result(spark, d), DRILL_SUBFIELD, CAREER))


def q_null_rank(spark, d):
    return _round(RP.null_rank(_result(spark, d, SPARSE), "cprat_ws", SPARSE))


def q_corpus_summary(spark, d):
    return RP.corpus_summary(_result(spark, d))


def q_publish_table(spark, d):
    return _round(P.publish(_result(spark, d), CAREER))


def q_publish_table_2017(spark, d):
    return _round(P.publish(_result(spark, d, EDITION2017), EDITION2017))


def q_career_top(spark, d):
    return _round(P.publish(_run(spark, d, CAREER).top, CAREER))


def q_single_year_top(spark, d):
    return _round(P.publish(_run(spark, d, SINGLE_YEAR).top, SINGLE_YEAR))


def q_corpus_layout(spark, d):
    """The corpus through its reader: written in the published folder layout and scanned back."""
    base = IO.scratch_path(spark, "core")
    build_inputs(spark, d).corpus.write.parquet(IO.corpus_path(base, "v1", "full", "ani", "20200506"))
    return _papers(IO.read_corpus(spark, base, "v1", "full", "20200506"))


def q_corpus_by_year(spark, d):
    """The corpus partitioned by year, and a run's edges from it: year bounds select folders."""
    base = IO.scratch_path(spark, "core")
    IO.write_corpus(build_inputs(spark, d).corpus, base, "v2", "full", "20200506")
    return C.paper_citations(C.citing_edges(IO.read_corpus(spark, base, "v2", "full", "20200506"), build_inputs(spark, d).discontinued, CAREER))


def q_corpus_layout_2017(spark, d):
    """The same papers in the 2017 layout, by their publication year (one after the sorting year)."""
    base = IO.scratch_path(spark, "core")
    old = build_inputs(spark, d).corpus.withColumnsRenamed(
        {"year": "sort_year", "publication_type": "citation_type", "references": "citations"})
    old.withColumn("pub_year", F.col("sort_year") + 1).write.parquet(IO.corpus_path(base, "v1", "full", "ani", "20170101"))
    return _papers(IO.read_corpus(spark, base, "v1", "full", "20170101", layout="2017", year_col="pub_year"))


def _papers(corpus):
    return corpus.select("eid", "year", "publication_type", F.col("source.srcid").alias("srcid"),
                         F.coalesce(F.size(F.array_distinct("references")), F.lit(0)).alias("n_references"),
                         F.coalesce(F.size("au"), F.lit(0)).alias("n_authors"))


def _outputs(spark, d):
    r = _run(spark, d)
    return r, OUT.write_outputs(r, IO.scratch_path(spark, "outputs"))


def q_top_list_csv(spark, d):
    r, out = _outputs(spark, d)
    return _round(OUT.read_top_list(spark, out, r))


def q_maxima_csv(spark, d):
    return _round(OUT.read_run_maxima(spark, _outputs(spark, d)[1]))


def q_csv_roundtrip(spark, d):
    cut = q_subject_cutoffs(spark, d)
    path = IO.scratch_path(spark, "subject_cutoffs.csv")
    IO.write_report(cut, path)
    return IO.read_report(spark, path, cut.schema)


def q_table_roundtrip(spark, d):
    db = IO.scratch_database(spark)
    IO.drop_stage_tables(spark, db, ["temp_eligible"])
    r = _run(spark, d)
    IO.stage_table(spark, lambda: A.eligible_authors(r.authorship, CAREER), db, "temp_eligible", f"{CAREER.fingerprint()}|{r.inputs_key}")
    return IO.read_table(spark, db, "temp_eligible")


def q_stage_reuse(spark, d):
    r = _run(spark, d, CAREER, stage=True)
    first = r.metrics  # written (or found) under the config key
    again = _run(spark, d, CAREER, stage=True).metrics  # found: read back, not rebuilt
    assert first.inputFiles() == again.inputFiles()
    return _round(again.select(*METRIC_COLS))


def q_latest_table(spark, d):
    db = IO.scratch_database(spark)
    im = build_inputs(spark, d).inst_map
    im.withColumn("institution_id", F.col("institution_id") + 1000).write.saveAsTable(f"{db}.institution_affiliation_20200101")
    im.write.saveAsTable(f"{db}.institution_affiliation_20200506")
    return IO.read_table(spark, db, IO.latest_table(spark, db, "institution_affiliation_"))


def _queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k[2:]: v for k, v in globals().items() if k.startswith("q_") and callable(v)}


def _pipeline_queries() -> tuple[dict[str, Callable[[SparkSession, str], DataFrame]], dict[str, str]]:
    """The training-data operators and the pipeline, if their subpackage is there."""
    try:
        from scholarmetrics.llm.queries import ORACLE_SQL, QUERIES
    except ModuleNotFoundError as e:
        if not (e.name or "").startswith("scholarmetrics.llm"):
            raise
        return {}, {}
    found, sql = dict(QUERIES), dict(ORACLE_SQL)
    try:
        import corpus_pipeline
    except ModuleNotFoundError as e:
        if e.name != "corpus_pipeline":
            raise
        return found, sql
    found["pipeline"] = corpus_pipeline.run
    if corpus_pipeline.ORACLE_SQL:
        sql["pipeline"] = corpus_pipeline.ORACLE_SQL
    return found, sql


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return _queries() | _pipeline_queries()[0]


def oracle_sql() -> dict[str, str]:
    return O.all_oracles() | _pipeline_queries()[1]


def entry(spark: SparkSession) -> DataFrame:
    """Flagship: the career top list on sf0.001."""
    return queries()["career_top"](spark, SMOKE_DIR)
