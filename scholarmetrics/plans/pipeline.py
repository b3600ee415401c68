"""End-to-end run: corpus + side tables + Config -> every stage as a DataFrame.

The same code serves the career and the single-year tables (they differ only
in ``min_cite_year``) and the 2017 edition (``edition="2017"``). Stages are
lazy; with ``stage=True`` (the default) the heavy ones (edges, eligible
authorship, author metrics, profile, ranked result) are written as parquet to
the shared folder and read back, which cuts the lineage between them and lets
every report reuse them. A stage is keyed by the identity of the inputs and by
exactly the parameters that it depends on. The tables with one row per author (names,
affiliation, metrics, profile) and the author slots are bucketed and sorted by author id: the
author store, whose tables join and aggregate by author without a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from ..operators import authorship as A
from ..operators import citations as C
from ..operators import cutoffs as CO
from ..operators import labels as L
from ..operators import metrics as M
from ..operators import ranking as R
from ..operators import score as S
from ..operators import subjects as SJ
from ..sources.inputs import Inputs
from ..sources.io import stage as _stage

# the parameters that the staged results depend on
FACT = ("min_cite_year", "max_year", "core_types", "auid_floor", "edition")
AUTHORSHIP = (*FACT, "min_core_papers")
METRICS = (*AUTHORSHIP, "min_year", "min_classified")
# columns of the authorship fact that no aggregate by author reads: they are not shuffled to the authors
PAPER_ONLY = ("publication_type", "srcid", "domain")


@dataclass
class Run:
    spark: SparkSession
    inputs: Inputs
    cfg: Config
    maxima_override: DataFrame | None = None
    stage: bool = True
    # identity of the inputs' data; ``inputs.key`` unless given. Staging needs one.
    inputs_key: str = ""
    # identity of the maxima used for the composite; part of the key of every
    # stage downstream of it (a fresh one when overriding without a name)
    maxima_key: str = ""

    def __post_init__(self):
        self.inputs_key = self.inputs_key or self.inputs.key
        if self.stage and not self.inputs_key:
            raise ValueError("staging needs the identity of the inputs: Inputs.key or inputs_key")
        if not self.maxima_key:
            import uuid

            self.maxima_key = "own" if self.maxima_override is None else f"override-{uuid.uuid4().hex}"

    def _maybe_stage(self, name: str, build, params: tuple[str, ...] | None, extra: str = "", by: str | None = None) -> DataFrame:
        """Stage under the inputs' identity, the named parameters (None: all) and ``extra``; ``by`` buckets it."""
        if not self.stage:
            return build()
        own = self.cfg.fingerprint() if params is None else self.cfg.fingerprint(*params) if params else ""
        return _stage(self.spark, build, name, f"{own}|{extra}|{self.inputs_key}", by=by)

    @property
    def pubs(self) -> DataFrame:
        return self.inputs.corpus

    @cached_property
    def disc(self) -> DataFrame:
        if self.cfg.edition == "2017":  # the 2017 edition has no discontinued list: an empty one
            return self.inputs.discontinued.filter(F.lit(False))
        return self.inputs.discontinued

    # ---- citations ------------------------------------------------------------
    @cached_property
    def edges(self) -> DataFrame:
        # the costly part (reference explode, join, shared-author test) depends on
        # min_cite_year only: staged under that key, shared by runs that cite from
        # the same year; the discontinued flag is a broadcast join on top
        if not self.stage:
            return C.citing_edges(self.pubs, self.disc, self.cfg)
        # the resolved references are the stage: the edges are read from it, not written again
        by = ("min_cite_year",)
        found = self._maybe_stage("references", lambda: C.resolved_references(self.pubs, self.cfg), by)
        long = self._maybe_stage("edges_of_long_lists", lambda: C.flagged_by_rows(found, self.pubs), by)
        base = C.settled(found).unionByName(long)
        return C.with_discontinued(base, self.disc)

    @cached_property
    def cites(self) -> DataFrame:
        return C.paper_citations(self.edges)

    # ---- subjects of papers -------------------------------------------------------
    @cached_property
    def paper_subjects(self) -> DataFrame:
        if self.cfg.edition == "2017":
            return SJ.journal_subject(self.pubs, self.inputs.journal_map, self.inputs.subject_tree, self.cfg).select(
                "eid", "publication_type", "subfield_code", "field_code"
            )
        return SJ.paper_subject(self.pubs, self.inputs.smc, self.cfg)

    @property
    def subject_keys(self) -> tuple[str, str]:
        return ("subfield_code", "field_code") if self.cfg.edition == "2017" else ("subfield", "field")

    # ---- authorship -----------------------------------------------------------------
    def _with_subjects(self, papers: DataFrame) -> DataFrame:
        if self.cfg.edition == "2017":
            found = SJ.with_journal_subject(papers, self.inputs.journal_map, self.inputs.subject_tree, self.cfg)
            return found.drop("subfield", "field")
        return SJ.with_paper_subject(papers, self.inputs.smc, self.cfg)

    def _authorship(self) -> DataFrame:
        return A.authorship(self.pubs, self.cites, self.disc, self.cfg, self._with_subjects)

    @cached_property
    def authorship(self) -> DataFrame:
        """The authorship fact of all authors, staged by author."""
        return self._maybe_stage("authorship_fact", self._authorship, FACT, by="auid")

    @cached_property
    def eligible(self) -> DataFrame:
        """The slots of eligible authors, staged by author: they are shuffled once, on the way from the
        papers, and all aggregates by author read them where they are."""
        build = lambda: A.eligible_slots(self._authorship(), self.cfg).drop(*PAPER_ONLY)
        return self._maybe_stage("authorship", build, AUTHORSHIP, by="auid")

    @cached_property
    def subjects(self) -> DataFrame:
        sf, fd = self.subject_keys
        s = SJ.author_subjects(self.eligible, self.cfg, sf, fd)
        if self.cfg.edition == "2017":
            tree = self.inputs.subject_tree
            sfn = tree.select(F.col("subfield_code").alias("_c"), F.col("subfield").alias("_n"))
            fdn = tree.select("field_code", "field").distinct().select(F.col("field_code").alias("_fc"), F.col("field").alias("_fn"))
            s = (
                s.join(sfn, F.col("sm_subfield_1") == F.col("_c"), "left").withColumnRenamed("_n", "sm_subfield_1_name").drop("_c")
                .join(sfn, F.col("sm_subfield_2") == F.col("_c"), "left").withColumnRenamed("_n", "sm_subfield_2_name").drop("_c")
                .join(fdn, F.col("sm_field") == F.col("_fc"), "left").withColumnRenamed("_fn", "sm_field_name").drop("_fc")
            )
        return s

    # ---- metrics and score ------------------------------------------------------------
    @cached_property
    def metrics(self) -> DataFrame:
        return self._maybe_stage("author_metrics", lambda: M.author_metrics(self.eligible, self.edges, self.subjects, self.cfg), METRICS, by="auid")

    @cached_property
    def logs(self) -> DataFrame:
        return S.log_metrics(self.metrics)

    @cached_property
    def maxima(self) -> DataFrame:
        return self.maxima_override if self.maxima_override is not None else S.log_maxima(self.logs)

    @cached_property
    def scored(self) -> DataFrame:
        return S.composite(self.logs, self.maxima)

    # ---- labels -------------------------------------------------------------------------
    @cached_property
    def names(self) -> DataFrame:
        # whole corpus, no year parameter: one stage for every configuration
        return self._maybe_stage("author_names", lambda: L.author_names(self.pubs), (), by="auid")

    @cached_property
    def affiliation(self) -> DataFrame:
        # whole corpus, depends only on the edition's rule
        if self.cfg.edition == "2017":
            return self._maybe_stage(
                "author_affiliation_2017",
                lambda: L.author_affiliation_latest(self.pubs, self.inputs.inst_map, self.inputs.inst),
                (), by="auid",
            )
        return self._maybe_stage(
            "author_affiliation", lambda: L.author_affiliation(self.pubs, self.inputs.ipr), (), by="auid"
        )

    # ---- profile, ranks, top list -------------------------------------------------------
    @cached_property
    def profile(self) -> DataFrame:
        return self._maybe_stage(
            "author_profile", lambda: R.author_profile(self.scored, self.names, self.affiliation, self.cfg),
            (*METRICS, "min_papers"), self.maxima_key, by="author_id",
        )

    @cached_property
    def result(self) -> DataFrame:
        return self._maybe_stage("result", lambda: R.ranked_result(self.profile, self.cfg),
                                 (*METRICS, "min_papers", "top_n", "top_frac"), self.maxima_key)

    @cached_property
    def cutoffs(self) -> DataFrame:
        """Cut-off table per field / subfield / TOTAL (2019 upper-bound or 2017
        lower-bound form), staged once and read by every report."""
        if self.cfg.edition == "2017":
            return self._maybe_stage("cutoffs_lower", lambda: CO.cutoffs_lower(self.result, self.cfg), None, self.maxima_key)
        return self._maybe_stage("cutoffs", lambda: CO.cutoff_table(self.result, self.cfg), None, self.maxima_key)

    @cached_property
    def top(self) -> DataFrame:
        if self.cfg.edition == "2017":
            return R.top_n_either(self.result, self.cfg)
        return R.top_list(self.result, self.cfg)


def run(spark: SparkSession, inputs: Inputs, cfg: Config, **kw) -> Run:
    return Run(spark, inputs, cfg, **kw)
