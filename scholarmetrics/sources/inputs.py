"""The input tables of a run."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Inputs:
    corpus: DataFrame  # nested papers
    smc: DataFrame  # eid, subfield, field, domain (2019 per-paper subjects)
    ipr: DataFrame  # afid, preferred_name
    discontinued: DataFrame  # srcid
    journal_map: DataFrame  # srcid, subfield_code (2017)
    subject_tree: DataFrame  # subfield_code, subfield, field_code, field, domain
    inst_map: DataFrame  # institution_id, afid (2017)
    inst: DataFrame  # institution_id, name, country_code (2017)
    # identity of the data: part of every stage key (see sources.io.input_fingerprint)
    key: str = ""

    def tables(self) -> dict[str, DataFrame]:
        return {k: v for k, v in self.__dict__.items() if k != "key"}
