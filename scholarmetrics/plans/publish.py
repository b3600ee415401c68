"""The published author table: year-labelled columns, sorted by rank (ns).

Column order and labels follow the published tables (``cpsf`` is the label of
the single+first paper count there and is kept for compatibility).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..functions import percent_label


def publish_names(cfg: Config) -> list[tuple[str, str]]:
    """(label, source) in published order; a source is a column name, or
    ``strip:<col>`` (quotes removed) or ``self_pct`` (self-citation share label)."""
    y1, y2, y3 = cfg.y1, cfg.y2, cfg.y3

    def block(v: str, sfx: str):
        return [
            (f"rank{sfx}", f"rank_{v}"),
            (f"nc{y2}{y3}{sfx}", f"nc_{v}"),
            (f"h{y3}{sfx}", f"h_{v}"),
            (f"hm{y3}{sfx}", f"hm_{v}"),
            (f"nps{sfx}", "nps"),
            (f"ncs{sfx}", f"ncs_{v}"),
            (f"cpsf{sfx}", "npsf"),
            (f"ncsf{sfx}", f"ncsf_{v}"),
            (f"npsfl{sfx}", "npsfl"),
            (f"ncsfl{sfx}", f"ncsfl_{v}"),
            (f"c{sfx}", f"c_{v}"),
            (f"npciting{sfx}", f"ncp_{v}"),
            (f"cprat{sfx}", f"cprat_{v}"),
        ] + ([] if cfg.edition == "2017" else [(f"np{y1}{y3} cited{y2}{y3}{sfx}", f"npc_{v}")])

    head = [
        ("author_id", "author_id"),
        ("authfull", "strip:authfull"),
        ("inst_name", "strip:inst_name"),
        ("cntry", "cntry"),
        (f"np{y1}{y3}", "np"),
        ("firstyr", "firstyr"),
        ("lastyr", "lastyr"),
    ]
    self_pct = [("self%", "self_pct")]
    if cfg.edition == "2017":
        tail = []
        for code, name, share, subject in (("sm-1", "name1", "frac1", "sm_subfield_1"), ("sm-2", "name2", "frac2", "sm_subfield_2"),
                                           ("sm22", "name22", "frac22", "sm_field")):
            tail += [(code, subject), (name, f"{subject}_name"), (share, f"{subject}_frac")]
        return head + block("ns", " (ns)") + self_pct + block("ws", "") + tail
    tail = [
        (f"np{y1}{y3}_d", "np_d"),
        (f"nc{y2}{y3}_d", "nc_d"),
        ("sm-subfield-1", "sm_subfield_1"),
        ("sm-subfield-1-frac", "sm_subfield_1_frac"),
        ("sm-subfield-2", "sm_subfield_2"),
        ("sm-subfield-2-frac", "sm_subfield_2_frac"),
        ("sm-field", "sm_field"),
        ("sm-field-frac", "sm_field_frac"),
        ("rank sm-subfield-1", "rank_sm_subfield_1_ws"),
        ("rank sm-subfield-1 (ns)", "rank_sm_subfield_1_ns"),
        ("sm-subfield-1 count", "count_sm_subfield_1"),
    ]
    return head + block("ns", " (ns)") + self_pct + block("ws", "") + tail


def publish(result: DataFrame, cfg: Config) -> DataFrame:
    """Labelled table sorted by rank without self-citations (a range-partitioned
    total sort, not a single task)."""
    def expr(src: str):
        if src.startswith("strip:"):
            return F.regexp_replace(src[6:], '"', "")
        if src == "self_pct":
            return percent_label(F.col("nc_ws") - F.col("nc_ns"), "nc_ws", " %")
        return F.col(src)

    cols = [expr(src).alias(label) for label, src in publish_names(cfg)]
    return result.select(*cols).orderBy(F.col("rank (ns)").asc(), F.col("author_id").asc())
