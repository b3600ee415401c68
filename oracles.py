"""DuckDB oracle SQL for every registered query.

Each statement starts from the driver's base tables, derives the corpus as
flat views (the same rules as ``scholarmetrics.sources.fixtures``) and then
states the metric the way the original notebooks define it: plain windows,
``rank()``, RANGE frames, conditional aggregates. The Spark side computes the
same results with the scalable plans of the library, so a match checks both
the semantics and the rewrites.

Conventions that keep both engines equal: ``x / nullif(y, 0)`` for division,
``cast(.. as bigint)`` for integer sums, explicit NULLS FIRST/LAST, doubles
rounded to 6 places in outputs, and the composite rounded to 10 places before
ranking.
"""

from __future__ import annotations

from scholarmetrics.sources.fixtures import (
    BAD_AFFIL_SEQ,
    BAD_AFFIL_SEQ_MOD,
    CAREER,
    EDITION2017,
    NO_AFFIL_ID_MOD,
    NO_AFFIL_ID_REST,
    NULL_AUTHOR_MOD,
    OUTSIDE_ID_BASE,
    REFERENCE_OFFSETS,
    SINGLE_YEAR,
    SPARSE,
)

_OFFSETS = ", ".join(str(d) for d in REFERENCE_OFFSETS)

FIXTURE_CTES = f"""
fx_slots AS (
  SELECT l_orderkey AS eid,
         CASE WHEN l_orderkey % {NULL_AUTHOR_MOD} = 0 THEN NULL ELSE l_partkey END AS auid,
         l_partkey AS partkey,
         l_suppkey AS afid,
         CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS INTEGER) AS authorseq,
         CAST(count(*) OVER (PARTITION BY l_orderkey) AS INTEGER) AS n_authors,
         CASE WHEN l_orderkey % {BAD_AFFIL_SEQ_MOD} = 0 THEN {BAD_AFFIL_SEQ}
              ELSE CAST(dense_rank() OVER (PARTITION BY l_orderkey ORDER BY l_suppkey) AS INTEGER) END AS affiliation_seq
  FROM lineitem),
fx_papers AS (
  SELECT o_orderkey AS eid, CAST(year(o_orderdate) AS INTEGER) AS year, o_orderdate AS datesort,
         CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'ar' WHEN '2' THEN 'cp' WHEN '3' THEN 're' WHEN '4' THEN 'ed' ELSE 'le' END AS publication_type,
         s.afid AS srcid
  FROM orders LEFT JOIN (SELECT eid, afid FROM fx_slots WHERE authorseq = 1) s ON s.eid = o_orderkey),
fx_refs AS (
  SELECT a.o_orderkey AS citing, b.o_orderkey AS cited
  FROM (SELECT o_orderkey, o_orderdate, unnest([{_OFFSETS}]) AS d FROM orders) a
  JOIN orders b ON b.o_orderkey = a.o_orderkey - a.d AND b.o_orderdate < a.o_orderdate
  UNION
  SELECT s.eid, f.cited
  FROM fx_slots s JOIN (SELECT auid, min(eid) AS cited FROM fx_slots WHERE auid IS NOT NULL GROUP BY auid) f ON f.auid = s.auid
  WHERE s.auid % 3 = 0 AND f.cited <> s.eid
  UNION
  SELECT o_orderkey, o_orderkey + {OUTSIDE_ID_BASE} FROM orders WHERE o_orderkey % 5 = 0),
fx_disc AS (SELECT s_suppkey AS srcid FROM supplier WHERE s_suppkey % 17 = 3),
fx_tree AS (
  SELECT n_nationkey AS subfield_code, n_name AS subfield, n_regionkey AS field_code, r_name AS field,
         CASE WHEN n_regionkey < 2 THEN 'DOMAIN_A' ELSE 'DOMAIN_B' END AS domain
  FROM nation JOIN region ON n_regionkey = r_regionkey),
fx_jmap AS (SELECT s_suppkey AS srcid, s_nationkey AS subfield_code FROM supplier WHERE s_suppkey % 10 <> 9),
fx_smc AS (
  SELECT p.eid, t.subfield, t.field, t.domain
  FROM fx_papers p JOIN supplier ON s_suppkey = p.srcid
  JOIN fx_tree t ON t.subfield_code = (s_nationkey + CASE WHEN p.eid % 7 = 0 THEN 1 ELSE 0 END) % 25
  WHERE p.srcid % 10 <> 9 AND p.eid % 29 <> 0),
fx_names AS (
  SELECT s.eid, s.auid, s.authorseq,
         CASE WHEN p_partkey % 50 = 0 THEN NULL ELSE p_name END AS surname_pn,
         CASE WHEN (s.eid + p_partkey) % 3 = 0 THEN NULL ELSE p_brand END AS given_name_pn,
         substr(p_name, 1, 1) AS initials_pn,
         CASE WHEN p_partkey % 100 = 0 THEN NULL ELSE p_name || ' ' || substr(p_name, 1, 1) END AS indexed_name_pn,
         p_name AS indexed_name
  FROM fx_slots s LEFT JOIN part ON p_partkey = s.partkey),
fx_affil AS (
  SELECT DISTINCT s.eid, s.affiliation_seq,
         CASE WHEN s.afid % {NO_AFFIL_ID_MOD} = {NO_AFFIL_ID_REST} THEN NULL ELSE s.afid END AS afid,
         CASE WHEN s.afid % 13 = 5 THEN NULL WHEN s.afid % 11 = 7 THEN ''
              ELSE s_name || ', Dept ' || CAST(s.eid % 3 AS VARCHAR) END AS org,
         n_name AS country
  FROM fx_slots s JOIN supplier ON s_suppkey = s.afid JOIN nation ON n_nationkey = s_nationkey
  WHERE s.affiliation_seq < {BAD_AFFIL_SEQ}),
fx_ipr AS (SELECT s_suppkey AS afid, 'Institute ' || CAST(s_suppkey AS VARCHAR) AS preferred_name FROM supplier WHERE s_suppkey % 2 = 0),
fx_inst_map AS (
  SELECT s_nationkey AS institution_id, s_suppkey AS afid FROM supplier
  UNION ALL SELECT s_nationkey + 100, s_suppkey FROM supplier WHERE s_suppkey % 4 = 0),
fx_inst AS (
  SELECT n_nationkey AS institution_id, 'Inst ' || n_name AS name, 'C' || CAST(n_nationkey AS VARCHAR) AS country_code
  FROM nation WHERE n_nationkey % 6 <> 0)"""


def with_fixtures(*ctes: str, select: str) -> str:
    body = ",\n".join([FIXTURE_CTES.strip()] + [c.strip() for c in ctes])
    return f"WITH {body}\n{select.strip()}"


# ---------------------------------------------------------------------------
# Metric CTE chain, parameterised by the run configuration
# ---------------------------------------------------------------------------


def _in(types) -> str:
    return "(" + ", ".join(f"'{t}'" for t in types) + ")"


def metric_ctes(cfg) -> list[str]:
    core = _in(cfg.core_types)
    floor = "" if cfg.auid_floor is None else f" AND s.auid > {cfg.auid_floor}"
    disc = "SELECT srcid FROM fx_disc WHERE false" if cfg.edition == "2017" else "SELECT DISTINCT srcid FROM fx_disc"
    span = f"year BETWEEN {cfg.min_year} AND {cfg.max_year}"
    if cfg.edition == "2017":
        psub = f"""o_psub AS (
  SELECT p.eid, t.subfield_code, t.field_code
  FROM fx_papers p LEFT JOIN fx_jmap j ON j.srcid = p.srcid
  LEFT JOIN fx_tree t ON t.subfield_code = CASE WHEN p.publication_type IN {core} THEN j.subfield_code END)"""
        sf, fd, subj_cols = "subfield_code", "field_code", "ps.subfield_code, ps.field_code"
    else:
        psub = f"""o_psub AS (
  SELECT p.eid, CASE WHEN p.publication_type IN {core} THEN m.subfield END AS subfield, m.field, m.domain
  FROM fx_papers p LEFT JOIN fx_smc m ON m.eid = p.eid)"""
        sf, fd, subj_cols = "subfield", "field", "ps.subfield, ps.field, ps.domain"
    mc = cfg.min_classified

    def ranked(key, name):
        return f"""{name} AS (
  SELECT v.auid, v.{key} AS k, v.n_author,
         dense_rank() OVER (PARTITION BY v.auid ORDER BY (v.{key} IS NULL), v.n_author DESC, o.n_overall, v.{key}) AS r
  FROM (SELECT auid, {key}, count(*) AS n_author FROM o_eauth GROUP BY auid, {key}) v
  JOIN (SELECT {key}, count(*) AS n_overall FROM o_eauth GROUP BY {key}) o ON o.{key} IS NOT DISTINCT FROM v.{key})"""

    def frac(alias):
        return f"CASE WHEN c.n_classified >= {mc} AND {alias}.k IS NOT NULL THEN CAST({alias}.n_author AS DOUBLE) / c.n_classified END"

    logs = ", ".join(
        f"ln(CAST({src}_{v} AS DOUBLE) + 1) AS l{src}_{v}"
        for v in ("ns", "ws") for src in ("nc", "h", "hm", "ncs", "ncsf", "ncsfl")
    )
    maxes = ", ".join(
        f"max(l{src}_{v}) AS max_l{src}_{v}" for v in ("ws", "ns") for src in ("nc", "h", "hm", "ncs", "ncsf", "ncsfl")
    )
    comp = {
        v: " + ".join(f"l.l{src}_{v} / NULLIF(x.max_l{src}_{v}, 0)" for src in ("nc", "h", "hm", "ncs", "ncsf", "ncsfl"))
        for v in ("ns", "ws")
    }
    pos = []
    for tag, cond in (("s", "n_authors = 1"), ("sf", "n_authors = 1 OR authorseq = 1"),
                      ("sfl", "n_authors = 1 OR authorseq = 1 OR authorseq = n_authors")):
        pos.append(f"CAST(sum(CASE WHEN {cond} THEN 1 ELSE 0 END) AS BIGINT) AS np{tag}")
        for v in ("ns", "ws"):
            pos.append(f"CAST(sum(CASE WHEN {cond} THEN cites_{v} ELSE 0 END) AS BIGINT) AS nc{tag}_{v}")
    subj_extra = ""
    if cfg.edition == "2017":
        subj_extra = """,
o_subj AS (
  SELECT s.*, t1.subfield AS sm_subfield_1_name, t2.subfield AS sm_subfield_2_name, tf.field AS sm_field_name
  FROM o_subj0 s
  LEFT JOIN fx_tree t1 ON t1.subfield_code = s.sm_subfield_1
  LEFT JOIN fx_tree t2 ON t2.subfield_code = s.sm_subfield_2
  LEFT JOIN (SELECT DISTINCT field_code, field FROM fx_tree) tf ON tf.field_code = s.sm_field)"""
    subj_name = "o_subj0" if cfg.edition == "2017" else "o_subj"
    return [
        f"p_flags AS (SELECT p.*, CASE WHEN d.srcid IS NOT NULL THEN 1 ELSE 0 END AS is_disc_source FROM fx_papers p LEFT JOIN ({disc}) d ON d.srcid = p.srcid)",
        f"""o_edges AS (
  SELECT r.citing, r.cited,
         CASE WHEN EXISTS (SELECT 1 FROM fx_slots a JOIN fx_slots b ON a.auid = b.auid
                           WHERE a.eid = r.citing AND b.eid = r.cited) THEN 1 ELSE 0 END AS is_self,
         pc.is_disc_source AS is_disc
  FROM fx_refs r JOIN p_flags pc ON pc.eid = r.citing AND pc.year >= {cfg.min_cite_year}
  JOIN fx_papers pd ON pd.eid = r.cited)""",
        """o_cites AS (
  SELECT cited AS eid, count(*) AS n_cit, CAST(sum(is_self) AS BIGINT) AS n_self,
         CAST(count(*) - sum(is_self) AS BIGINT) AS n_cit_ns, CAST(sum(is_disc) AS BIGINT) AS n_cit_disc
  FROM o_edges GROUP BY cited)""",
        psub,
        f"""o_auth AS (
  SELECT s.eid, s.auid, s.authorseq, s.n_authors, p.year, p.publication_type, p.srcid, p.is_disc_source,
         COALESCE(c.n_cit, 0) AS cites_ws, COALESCE(c.n_cit_ns, 0) AS cites_ns, COALESCE(c.n_cit_disc, 0) AS cites_disc,
         {subj_cols}
  FROM fx_slots s JOIN p_flags p ON p.eid = s.eid AND p.year <= {cfg.max_year}
  LEFT JOIN o_cites c ON c.eid = s.eid
  LEFT JOIN o_psub ps ON ps.eid = s.eid
  WHERE s.auid IS NOT NULL{floor})""",
        f"""o_elig AS (
  SELECT auid, count(*) AS n_slots, count(CASE WHEN publication_type IN {core} THEN eid END) AS n_core
  FROM o_auth GROUP BY auid HAVING count(CASE WHEN publication_type IN {core} THEN eid END) >= {cfg.min_core_papers})""",
        "o_eauth AS (SELECT * FROM o_auth WHERE auid IN (SELECT auid FROM o_elig))",
        """o_rk AS (
  SELECT auid, eid, cites_ns, cites_ws,
         rank() OVER (PARTITION BY auid ORDER BY cites_ns DESC, eid) AS r_ns,
         sum(CAST(1 AS DOUBLE) / n_authors) OVER (PARTITION BY auid ORDER BY cites_ns DESC, eid) AS e_ns,
         rank() OVER (PARTITION BY auid ORDER BY cites_ws DESC, eid) AS r_ws,
         sum(CAST(1 AS DOUBLE) / n_authors) OVER (PARTITION BY auid ORDER BY cites_ws DESC, eid) AS e_ws
  FROM o_eauth)""",
        """o_h AS (
  SELECT auid,
         CAST(max(CASE WHEN r_ns <= cites_ns THEN r_ns ELSE 0 END) AS BIGINT) AS h_ns,
         CAST(max(CASE WHEN r_ws <= cites_ws THEN r_ws ELSE 0 END) AS BIGINT) AS h_ws,
         max(CASE WHEN round(e_ns, 9) <= cites_ns THEN e_ns ELSE 0 END) AS hm_ns,
         max(CASE WHEN round(e_ws, 9) <= cites_ws THEN e_ws ELSE 0 END) AS hm_ws
  FROM o_rk GROUP BY auid)""",
        f"""o_vol AS (
  SELECT auid,
         CAST(sum(CASE WHEN {span} THEN 1 ELSE 0 END) AS BIGINT) AS np,
         CAST(sum(CASE WHEN {span} AND cites_ns > 0 THEN 1 ELSE 0 END) AS BIGINT) AS npc_ns,
         CAST(sum(CASE WHEN {span} AND cites_ws > 0 THEN 1 ELSE 0 END) AS BIGINT) AS npc_ws,
         CAST(sum(cites_ns) AS BIGINT) AS nc_ns, CAST(sum(cites_ws) AS BIGINT) AS nc_ws,
         CAST(sum(CASE WHEN {span} THEN is_disc_source ELSE 0 END) AS BIGINT) AS np_d,
         CAST(sum(cites_disc) AS BIGINT) AS nc_d
  FROM o_eauth GROUP BY auid)""",
        f"o_pos AS (SELECT auid, {', '.join(pos)} FROM o_eauth GROUP BY auid)",
        """o_cp AS (
  SELECT auid, count(*) AS ncp_ws, CAST(sum(ns) AS BIGINT) AS ncp_ns
  FROM (SELECT a.auid, e.citing, max(1 - e.is_self) AS ns
        FROM o_eauth a JOIN o_edges e ON e.cited = a.eid GROUP BY a.auid, e.citing) GROUP BY auid)""",
        ranked(sf, "o_sfr"),
        ranked(fd, "o_fdr"),
        f"""{subj_name} AS (
  SELECT c.auid,
         CASE WHEN c.n_classified >= {mc} THEN s1.k END AS sm_subfield_1, {frac('s1')} AS sm_subfield_1_frac,
         CASE WHEN c.n_classified >= {mc} THEN s2.k END AS sm_subfield_2, {frac('s2')} AS sm_subfield_2_frac,
         CASE WHEN c.n_classified >= {mc} THEN f1.k END AS sm_field, {frac('f1')} AS sm_field_frac,
         c.n_classified
  FROM (SELECT auid, count({fd}) AS n_classified FROM o_eauth GROUP BY auid) c
  LEFT JOIN o_sfr s1 ON s1.auid = c.auid AND s1.r = 1
  LEFT JOIN o_sfr s2 ON s2.auid = c.auid AND s2.r = 2
  LEFT JOIN o_fdr f1 ON f1.auid = c.auid AND f1.r = 1){subj_extra}""",
        """o_metrics AS (
  SELECT v.*, p.* EXCLUDE (auid), h.* EXCLUDE (auid),
         COALESCE(cp.ncp_ws, 0) AS ncp_ws, COALESCE(cp.ncp_ns, 0) AS ncp_ns, s.* EXCLUDE (auid)
  FROM o_vol v JOIN o_pos p ON p.auid = v.auid LEFT JOIN o_h h ON h.auid = v.auid
  LEFT JOIN o_cp cp ON cp.auid = v.auid LEFT JOIN o_subj s ON s.auid = v.auid)""",
        f"o_logs AS (SELECT *, {logs} FROM o_metrics)",
        f"o_max AS (SELECT {maxes} FROM o_logs)",
        f"""o_scored AS (
  SELECT l.*, round({comp['ns']}, 10) AS c_ns, round({comp['ws']}, 10) AS c_ws
  FROM o_logs l CROSS JOIN o_max x)""",
    ]


def label_ctes(cfg) -> list[str]:
    """Names, years and affiliations over the whole corpus."""
    out = [
        """o_names AS (
  SELECT auid, authfull, last_eid_name, firstyr, lastyr FROM (
    SELECT n.auid,
           COALESCE(n.surname_pn || ', ' || COALESCE(n.given_name_pn, n.initials_pn), n.indexed_name_pn, n.indexed_name) AS authfull,
           n.eid AS last_eid_name,
           min(p.year) OVER (PARTITION BY n.auid) AS firstyr, max(p.year) OVER (PARTITION BY n.auid) AS lastyr,
           rank() OVER (PARTITION BY n.auid ORDER BY (CASE WHEN n.given_name_pn IS NULL THEN 0 ELSE 1 END) DESC,
                        p.datesort DESC, n.eid DESC, n.authorseq DESC) AS rr
    FROM fx_names n JOIN fx_papers p ON p.eid = n.eid WHERE n.auid IS NOT NULL) WHERE rr = 1)""",
    ]
    if cfg.edition == "2017":
        out += [
            """o_inst1 AS (
  SELECT m.afid, m.institution_id, i.name AS sv_name, i.country_code AS sv_country_code
  FROM (SELECT afid, institution_id, rank() OVER (PARTITION BY afid ORDER BY institution_id) AS r FROM fx_inst_map) m
  LEFT JOIN fx_inst i ON i.institution_id = m.institution_id WHERE m.r = 1)""",
            """o_aff AS (
  SELECT DISTINCT x.auid, x.eid AS last_eid_aff, i.institution_id AS inst_id,
         COALESCE(i.sv_name, COALESCE(x.org, '')) AS inst_name, COALESCE(i.sv_country_code, x.country) AS cntry, x.afid AS affil_id
  FROM (SELECT s.auid, s.eid, a.afid, a.org, a.country,
               rank() OVER (PARTITION BY s.auid ORDER BY p.datesort DESC, s.eid DESC, a.afid ASC NULLS FIRST, s.affiliation_seq ASC, s.authorseq ASC) AS rr
        FROM fx_slots s JOIN fx_papers p ON p.eid = s.eid
        JOIN fx_affil a ON a.eid = s.eid AND a.affiliation_seq = s.affiliation_seq
        WHERE s.auid IS NOT NULL) x
  LEFT JOIN o_inst1 i ON i.afid = x.afid WHERE x.rr = 1)""",
        ]
    else:
        out += [
            """o_affrows AS (
  SELECT s.auid, p.year, p.datesort, s.eid, s.authorseq, a.afid, a.org, a.country
  FROM fx_slots s JOIN fx_papers p ON p.eid = s.eid
  JOIN fx_affil a ON a.eid = s.eid AND a.affiliation_seq = s.affiliation_seq
  WHERE s.auid IS NOT NULL AND a.org IS NOT NULL AND a.org <> '')""",
            """o_afflast AS (
  SELECT * FROM o_affrows r WHERE r.year = (SELECT max(year) FROM o_affrows q WHERE q.auid = r.auid))""",
            """o_affcnt AS (
  SELECT auid, afid, count(*) AS n, max(datesort) AS max_datesort,
         max(CASE WHEN lr = 1 THEN org END) AS affil_name, max(CASE WHEN lr = 1 THEN country END) AS cntry
  FROM (SELECT *, row_number() OVER (PARTITION BY auid, afid ORDER BY datesort DESC, eid DESC, authorseq DESC) AS lr
        FROM o_afflast) GROUP BY auid, afid)""",
            """o_aff AS (
  SELECT c.auid, c.afid AS affil_id, c.affil_name, c.cntry, c.max_datesort, i.preferred_name,
         COALESCE(i.preferred_name, c.affil_name) AS inst_name
  FROM (SELECT *, rank() OVER (PARTITION BY auid ORDER BY n DESC, max_datesort DESC, afid ASC NULLS FIRST) AS ar FROM o_affcnt) c
  LEFT JOIN fx_ipr i ON i.afid = c.afid WHERE c.ar = 1)""",
        ]
    return out


# ---------------------------------------------------------------------------
# Per-key statements
# ---------------------------------------------------------------------------

METRIC_COLS = (
    "auid, np, npc_ns, npc_ws, nc_ns, nc_ws, np_d, nc_d, nps, ncs_ns, ncs_ws, npsf, ncsf_ns, ncsf_ws, "
    "npsfl, ncsfl_ns, ncsfl_ws, h_ns, hm_ns, h_ws, hm_ws, ncp_ws, ncp_ns, sm_subfield_1, sm_subfield_1_frac, "
    "sm_subfield_2, sm_subfield_2_frac, sm_field, sm_field_frac, n_classified"
)
LOG_NAMES = [f"l{k}_{v}" for v in ("ns", "ws") for k in ("nc", "h", "hm", "ncs", "ncsf", "ncsfl")]
MAX_NAMES = [f"max_l{k}_{v}" for v in ("ws", "ns") for k in ("nc", "h", "hm", "ncs", "ncsf", "ncsfl")]


# Published maxima of ln(x+1), career to 2019; with self-citations first, then without, in
# the order nc, h, hm, ncs, ncsf, ncsfl.
PUBLISHED_CAREER_MAXIMA = (
    12.72619888417912, 5.645446897643238, 4.752253158267069, 11.933686327637512, 12.172588248212824, 12.284856099137546,
    12.665956492066586, 5.594711379601839, 4.708950125153382, 11.933686327637512, 12.163478247897753, 12.27893734514078,
)


def r6(cols) -> str:
    return ", ".join(f"round({c}, 6) AS {c.split('.')[-1]}" for c in cols)


def q(cfg, select: str, labels: bool = False, extra: tuple = ()) -> str:
    ctes = metric_ctes(cfg) + (label_ctes(cfg) if labels else []) + list(extra)
    return with_fixtures(*ctes, select=select)


def metrics_sql(cfg) -> str:
    cols = METRIC_COLS.replace("hm_ns,", "round(hm_ns, 6) AS hm_ns,").replace("hm_ws,", "round(hm_ws, 6) AS hm_ws,")
    for c in ("sm_subfield_1_frac", "sm_subfield_2_frac", "sm_field_frac"):
        cols = cols.replace(f"{c},", f"round({c}, 6) AS {c},")
    return q(cfg, f"SELECT {cols} FROM o_metrics")


def subjects_sql(cfg) -> str:
    return q(cfg, """SELECT auid, sm_subfield_1, round(sm_subfield_1_frac, 6) AS sm_subfield_1_frac,
                     sm_subfield_2, round(sm_subfield_2_frac, 6) AS sm_subfield_2_frac,
                     sm_field, round(sm_field_frac, 6) AS sm_field_frac, n_classified FROM o_subj""")


def base_oracles() -> dict[str, str]:
    c = CAREER
    d = {
        "citing_edges": q(c, "SELECT citing, cited, is_self, is_disc FROM o_edges"),
        "self_citation": q(c, "SELECT citing, cited FROM o_edges WHERE is_self = 1"),
        "paper_citations": q(c, "SELECT * FROM o_cites"),
        "discontinued_flags": q(c, """SELECT p.eid, p.is_disc_source,
               CAST(COALESCE(x.n, 0) AS BIGINT) AS n_cit_disc FROM p_flags p
               LEFT JOIN (SELECT cited, count(*) AS n FROM o_edges WHERE is_disc = 1 GROUP BY cited) x ON x.cited = p.eid"""),
        "authorship": q(c, """SELECT eid, auid, authorseq, n_authors, year, publication_type, srcid, is_disc_source,
               cites_ws, cites_ns, cites_disc FROM o_auth"""),
        "eligible_authors": q(c, "SELECT * FROM o_elig"),
        "h_index": q(c, "SELECT auid, h_ns, h_ws FROM o_h"),
        "hm_index": q(c, "SELECT auid, round(hm_ns, 6) AS hm_ns, round(hm_ws, 6) AS hm_ws FROM o_h"),
        "author_volume": q(c, "SELECT * FROM o_vol"),
        "author_positions": q(c, "SELECT * FROM o_pos"),
        "citing_papers": q(c, "SELECT * FROM o_cp"),
        "author_metrics": metrics_sql(c),
        "author_metrics_sparse": metrics_sql(SPARSE),
        "paper_subject": q(c, "SELECT p.eid, p.publication_type, s.subfield, s.field, s.domain FROM fx_papers p JOIN o_psub s ON s.eid = p.eid"),
        "journal_subject": with_fixtures(select=f"""
            SELECT p.eid, p.publication_type, t.subfield_code, t.subfield, t.field_code, t.field
            FROM fx_papers p LEFT JOIN fx_jmap j ON j.srcid = p.srcid
            LEFT JOIN fx_tree t ON t.subfield_code = CASE WHEN p.publication_type IN {_in(EDITION2017.core_types)} THEN j.subfield_code END"""),
        "subject_dictionary": with_fixtures(select="SELECT subfield, min(field) AS field, min(domain) AS domain FROM fx_smc GROUP BY subfield"),
        "subject_volume": q(c, """SELECT v.auid, v.subfield, v.n_author, o.n_overall
               FROM (SELECT auid, subfield, count(*) AS n_author FROM o_eauth GROUP BY auid, subfield) v
               JOIN (SELECT subfield, count(*) AS n_overall FROM o_eauth GROUP BY subfield) o ON o.subfield IS NOT DISTINCT FROM v.subfield"""),
        "author_subjects": subjects_sql(c),
        "author_subjects_sparse": subjects_sql(SPARSE),
        "log_metrics": q(c, f"SELECT auid, {r6(LOG_NAMES)} FROM o_logs"),
        "log_maxima": q(c, f"SELECT {r6(MAX_NAMES)} FROM o_max"),
        "composite": q(c, "SELECT auid, round(c_ns, 6) AS c_ns, round(c_ws, 6) AS c_ws FROM o_scored"),
        "author_name": q(c, "SELECT auid, authfull, last_eid_name FROM o_names", labels=True),
        "author_years": q(c, "SELECT auid, firstyr, lastyr FROM o_names", labels=True),
        "author_affiliation": q(c, "SELECT * FROM o_aff", labels=True),
        "author_affiliation_latest": q(EDITION2017, "SELECT * FROM o_aff", labels=True),
        "institution_dedupe": q(EDITION2017, "SELECT * FROM o_inst1", labels=True),
        "dup_check": q(c, "SELECT eid, auid, count(*) AS n FROM o_auth GROUP BY eid, auid HAVING count(*) > 1"),
    }
    fixed = ", ".join(f"CAST({v!r} AS DOUBLE) AS {n}" for v, n in zip(PUBLISHED_CAREER_MAXIMA, MAX_NAMES, strict=True))
    d["composite_fixed_max"] = with_fixtures(
        *[f"o_max AS (SELECT {fixed})" if x.startswith("o_max AS") else x for x in metric_ctes(c)],
        select="SELECT auid, round(c_ns, 6) AS c_ns, round(c_ws, 6) AS c_ws FROM o_scored",
    )
    return d


def all_oracles() -> dict[str, str]:
    d = base_oracles()
    d.update(result_oracles())
    return d


# ---------------------------------------------------------------------------
# Result table (profile + ranks + ratios + subfield ranks + top-list flag)
# ---------------------------------------------------------------------------


def _f(x) -> str:
    return f"CAST({x!r} AS DOUBLE)"


def result_ctes(cfg) -> list[str]:
    return [
        f"""o_prof AS (
  SELECT s.auid AS author_id, s.* EXCLUDE (auid), n.* EXCLUDE (auid), a.* EXCLUDE (auid)
  FROM o_scored s LEFT JOIN o_names n ON n.auid = s.auid LEFT JOIN o_aff a ON a.auid = s.auid
  WHERE s.np >= {cfg.min_papers})""",
        """o_res0 AS (
  SELECT *, rank() OVER (ORDER BY c_ns DESC NULLS LAST) AS rank_ns, rank() OVER (ORDER BY c_ws DESC NULLS LAST) AS rank_ws,
         CAST(nc_ws - nc_ns AS DOUBLE) / NULLIF(nc_ws, 0) AS self_p,
         CAST(nc_ns AS DOUBLE) / NULLIF(ncp_ns, 0) AS cprat_ns, CAST(nc_ws AS DOUBLE) / NULLIF(ncp_ws, 0) AS cprat_ws
  FROM o_prof)""",
        """o_res1 AS (
  SELECT *,
    CASE WHEN sm_subfield_1 IS NOT NULL THEN rank() OVER (PARTITION BY sm_subfield_1 ORDER BY c_ws DESC NULLS LAST) END AS rank_sm_subfield_1_ws,
    CASE WHEN sm_subfield_1 IS NOT NULL THEN rank() OVER (PARTITION BY sm_subfield_1 ORDER BY c_ns DESC NULLS LAST) END AS rank_sm_subfield_1_ns,
    CASE WHEN sm_subfield_1 IS NOT NULL THEN count(*) OVER (PARTITION BY sm_subfield_1) END AS count_sm_subfield_1
  FROM o_res0)""",
        f"""o_res AS (
  SELECT *, COALESCE((rank_ws <= {cfg.top_n} OR rank_ns <= {cfg.top_n})
         OR (CAST(rank_sm_subfield_1_ws AS DOUBLE) / count_sm_subfield_1 <= {_f(cfg.top_frac)})
         OR (CAST(rank_sm_subfield_1_ns AS DOUBLE) / count_sm_subfield_1 <= {_f(cfg.top_frac)}), false) AS top_listed
  FROM o_res1)""",
    ]


def _pct(p) -> str:
    return f"{int(round(p * 100)):02d}"


def _pass_upper(n, r, p) -> str:
    return f"CAST({n} - ({r} - 1) AS DOUBLE) / NULLIF({n}, 0) >= {_f(p)}"


def cutoff_ctes(cfg) -> list[str]:
    lv = """o_lv AS (
  SELECT 'field' AS level, sm_field AS subject, * FROM o_res
  UNION ALL SELECT 'subfield', sm_subfield_1, * FROM o_res
  UNION ALL SELECT 'total', 'TOTAL', * FROM o_res)"""
    allm = ("nc_ws", "c_ws", "self_p", "cprat_ws", "cprat_ns")
    topm = ("self_p", "cprat_ws", "cprat_ns")
    win = ", ".join(
        f"count({m}) OVER (PARTITION BY level, subject) AS n_{m}, "
        f"rank() OVER (PARTITION BY level, subject ORDER BY {m} DESC NULLS LAST) AS r_{m}"
        for m in allm
    )
    twin = ", ".join(
        f"count({m}) OVER (PARTITION BY level, subject) AS tn_{m}, "
        f"rank() OVER (PARTITION BY level, subject ORDER BY {m} DESC NULLS LAST) AS tr_{m}"
        for m in topm
    )
    names = {"nc_ws": "cites", "c_ws": "c", "self_p": "selfp", "cprat_ws": "cprat", "cprat_ns": "cprat_ns"}
    aggs = [
        "count(*) AS auth",
        f"count(CASE WHEN w.rank_ns <= {cfg.top_n} THEN 1 END) AS auth_top_ns",
        f"count(CASE WHEN w.rank_ws <= {cfg.top_n} THEN 1 END) AS auth_top",
        "NULLIF(count(CASE WHEN w.top_listed THEN 1 END), 0) AS auth_in_top_list",
    ]
    for m in allm:
        ps = cfg.percentiles if m in ("nc_ws", "c_ws") else cfg.ratio_percentiles
        for p in ps:
            e = f"min(CASE WHEN {_pass_upper('w.n_' + m, 'w.r_' + m, p)} THEN w.{m} END)"
            if m == "nc_ws":
                e = f"CAST({e} AS BIGINT)"
            aggs.append(f"{e} AS {names[m]}_{_pct(p)}")
    for m in topm:
        for p in cfg.ratio_percentiles:
            ok = _pass_upper("t.tn_" + m, "t.tr_" + m, p)
            aggs.append(f"min(CASE WHEN {ok} THEN w.{m} END) AS top_list_{names[m]}_{_pct(p)}")
            aggs.append(f"count(CASE WHEN t.tn_{m} IS NOT NULL AND {ok} THEN w.author_id END) AS auth_in_top_list_{names[m]}_{_pct(p)}")
    return [
        lv,
        f"o_cw AS (SELECT level, subject, author_id, top_listed, rank_ns, rank_ws, {', '.join(allm)}, {win} FROM o_lv)",
        f"o_tw AS (SELECT level, subject, author_id, {twin} FROM o_lv WHERE top_listed)",
        f"""o_cut AS (
  SELECT w.level, w.subject, {', '.join(aggs)}
  FROM o_cw w LEFT JOIN o_tw t ON t.level = w.level AND t.subject IS NOT DISTINCT FROM w.subject AND t.author_id = w.author_id
  GROUP BY w.level, w.subject)""",
        "o_dict AS (SELECT subfield, min(field) AS field, min(domain) AS domain FROM fx_smc GROUP BY subfield)",
    ]


# The cut-off columns of the 2020 edition, written out.
CUT_COLS = {
    "all": """auth auth_top_ns auth_top auth_in_top_list cites_25 cites_50 cites_75 cites_90 cites_95 cites_99
              c_25 c_50 c_75 c_90 c_95 c_99 selfp_95 selfp_99 cprat_95 cprat_99 cprat_ns_95 cprat_ns_99""".split(),
    "top": """top_list_selfp_95 top_list_selfp_99 top_list_cprat_95 top_list_cprat_99
              top_list_cprat_ns_95 top_list_cprat_ns_99""".split(),
    "above": """auth_in_top_list_selfp_95 auth_in_top_list_selfp_99 auth_in_top_list_cprat_95 auth_in_top_list_cprat_99
                auth_in_top_list_cprat_ns_95 auth_in_top_list_cprat_ns_99""".split(),
}


def cut_cols(cfg, kind: str) -> list[str]:
    return CUT_COLS[kind]


def lower_ctes(cfg) -> list[str]:
    aggs = [
        "max(subject_name) AS subject_name", "count(*) AS auth",
        f"count(CASE WHEN rank_ns <= {cfg.top_n} THEN 1 END) AS auth_top_ns",
        f"count(CASE WHEN rank_ws <= {cfg.top_n} THEN 1 END) AS auth_top",
    ]
    for m, n in (("nc_ws", "cites"), ("c_ws", "c")):
        for p in cfg.percentiles:
            e = f"min(CASE WHEN CAST(r_{m} AS DOUBLE) / rc >= {_f(p)} THEN {m} END)"
            if m == "nc_ws":
                e = f"CAST({e} AS BIGINT)"
            aggs.append(f"{e} AS {n}_{_pct(p)}")
    return [
        """o_lv17 AS (
  SELECT 'field' AS level, CAST(sm_field AS VARCHAR) AS subject, sm_field_name AS subject_name, * FROM o_res
  UNION ALL SELECT 'subfield', CAST(sm_subfield_1 AS VARCHAR), sm_subfield_1_name, * FROM o_res
  UNION ALL SELECT 'total', '', 'TOTAL', * FROM o_res)""",
        """o_lw AS (
  SELECT level, subject, subject_name, rank_ns, rank_ws, nc_ws, c_ws, count(*) OVER (PARTITION BY level, subject) AS rc,
         rank() OVER (PARTITION BY level, subject ORDER BY nc_ws ASC NULLS FIRST) AS r_nc_ws,
         rank() OVER (PARTITION BY level, subject ORDER BY c_ws ASC NULLS FIRST) AS r_c_ws
  FROM o_lv17)""",
        f"o_lcut AS (SELECT level, subject, {', '.join(aggs)} FROM o_lw GROUP BY level, subject)",
    ]


def pct_sql(n: str, d: str, suffix: str = "%") -> str:
    bp = f"((20000 * CAST({n} AS BIGINT) + {d}) // (2 * {d}))"
    return (f"CASE WHEN {d} IS NULL OR {d} = 0 OR {n} IS NULL THEN NULL "
            f"ELSE printf('%d.%02d{suffix.replace('%', '%%')}', {bp} // 100, {bp} % 100) END")


# The published report columns, label by label, for the report runs (top 100 of the fixtures).
PUBLISHED_REPORT = {
    "#Auth": "c.auth",
    "#Auth top 100 (ns)": "c.auth_top_ns", "% in 100 (ns)": pct_sql("c.auth_top_ns", "c.auth"),
    "#Auth top 100": "c.auth_top", "% in 100": pct_sql("c.auth_top", "c.auth"),
    "#Auth in top-list": "c.auth_in_top_list", "% in top-list": pct_sql("c.auth_in_top_list", "c.auth"),
    "Cites@25": "c.cites_25", "Cites@50": "c.cites_50", "Cites@75": "c.cites_75",
    "Cites@90": "c.cites_90", "Cites@95": "c.cites_95", "Cites@99": "c.cites_99",
    "c@25": "round(c.c_25, 3)", "c@50": "round(c.c_50, 3)", "c@75": "round(c.c_75, 3)",
    "c@90": "round(c.c_90, 3)", "c@95": "round(c.c_95, 3)", "c@99": "round(c.c_99, 3)",
    "top-list self%@95": "printf('%.2f %%', round(100 * c.top_list_selfp_95, 2))",
    "top-list self%@99": "printf('%.2f %%', round(100 * c.top_list_selfp_99, 2))",
    "top-list cprat@95": "round(c.top_list_cprat_95, 6)", "top-list cprat@99": "round(c.top_list_cprat_99, 6)",
    "top-list cprat@95 (ns)": "round(c.top_list_cprat_ns_95, 6)", "top-list cprat@99 (ns)": "round(c.top_list_cprat_ns_99, 6)",
}


def report_select() -> str:
    return ", ".join(f'{e} AS "{label}"' for label, e in PUBLISHED_REPORT.items())


# The 2020-edition layout, label by label ({y1}, {y2}, {y3}: the run's years).
PUBLISHED_2020 = {
    "author_id": "author_id", "authfull": "replace(authfull, '\"', '')", "inst_name": "replace(inst_name, '\"', '')", "cntry": "cntry",
    "np{y1}{y3}": "np", "firstyr": "firstyr", "lastyr": "lastyr",
    "rank (ns)": "rank_ns", "nc{y2}{y3} (ns)": "nc_ns", "h{y3} (ns)": "h_ns", "hm{y3} (ns)": "round(hm_ns, 6)", "nps (ns)": "nps",
    "ncs (ns)": "ncs_ns", "cpsf (ns)": "npsf", "ncsf (ns)": "ncsf_ns", "npsfl (ns)": "npsfl", "ncsfl (ns)": "ncsfl_ns",
    "c (ns)": "round(c_ns, 6)", "npciting (ns)": "ncp_ns", "cprat (ns)": "round(cprat_ns, 6)", "np{y1}{y3} cited{y2}{y3} (ns)": "npc_ns",
    "self%": pct_sql("nc_ws - nc_ns", "nc_ws", " %"),
    "rank": "rank_ws", "nc{y2}{y3}": "nc_ws", "h{y3}": "h_ws", "hm{y3}": "round(hm_ws, 6)", "nps": "nps",
    "ncs": "ncs_ws", "cpsf": "npsf", "ncsf": "ncsf_ws", "npsfl": "npsfl", "ncsfl": "ncsfl_ws",
    "c": "round(c_ws, 6)", "npciting": "ncp_ws", "cprat": "round(cprat_ws, 6)", "np{y1}{y3} cited{y2}{y3}": "npc_ws",
    "np{y1}{y3}_d": "np_d", "nc{y2}{y3}_d": "nc_d",
    "sm-subfield-1": "sm_subfield_1", "sm-subfield-1-frac": "round(sm_subfield_1_frac, 6)",
    "sm-subfield-2": "sm_subfield_2", "sm-subfield-2-frac": "round(sm_subfield_2_frac, 6)",
    "sm-field": "sm_field", "sm-field-frac": "round(sm_field_frac, 6)",
    "rank sm-subfield-1": "rank_sm_subfield_1_ws", "rank sm-subfield-1 (ns)": "rank_sm_subfield_1_ns",
    "sm-subfield-1 count": "count_sm_subfield_1",
}


def publish_sql(cfg, where: str = "") -> str:
    years = {"y1": cfg.y1, "y2": cfg.y2, "y3": cfg.y3}
    return "SELECT " + ", ".join(f'{e} AS "{label.format(**years)}"' for label, e in PUBLISHED_2020.items()) + f" FROM o_res {where}"


# The 2017-edition layout, label by label ({n}: the run's years).
PUBLISHED_2017 = {
    "author_id": "author_id", "authfull": "replace(authfull, '\"', '')", "inst_name": "replace(inst_name, '\"', '')", "cntry": "cntry",
    "np{y1}{y3}": "np", "firstyr": "firstyr", "lastyr": "lastyr",
    "rank (ns)": "rank_ns", "nc{y2}{y3} (ns)": "nc_ns", "h{y3} (ns)": "h_ns", "hm{y3} (ns)": "round(hm_ns, 6)", "nps (ns)": "nps",
    "ncs (ns)": "ncs_ns", "cpsf (ns)": "npsf", "ncsf (ns)": "ncsf_ns", "npsfl (ns)": "npsfl", "ncsfl (ns)": "ncsfl_ns",
    "c (ns)": "round(c_ns, 6)", "npciting (ns)": "ncp_ns", "cprat (ns)": "round(cprat_ns, 6)", "self%": pct_sql("nc_ws - nc_ns", "nc_ws", " %"),
    "rank": "rank_ws", "nc{y2}{y3}": "nc_ws", "h{y3}": "h_ws", "hm{y3}": "round(hm_ws, 6)", "nps": "nps",
    "ncs": "ncs_ws", "cpsf": "npsf", "ncsf": "ncsf_ws", "npsfl": "npsfl", "ncsfl": "ncsfl_ws",
    "c": "round(c_ws, 6)", "npciting": "ncp_ws", "cprat": "round(cprat_ws, 6)",
    "sm-1": "sm_subfield_1", "name1": "sm_subfield_1_name", "frac1": "round(sm_subfield_1_frac, 6)",
    "sm-2": "sm_subfield_2", "name2": "sm_subfield_2_name", "frac2": "round(sm_subfield_2_frac, 6)",
    "sm22": "sm_field", "name22": "sm_field_name", "frac22": "round(sm_field_frac, 6)",
}


def publish_2017_sql(cfg) -> str:
    years = {"y1": cfg.y1, "y2": cfg.y2, "y3": cfg.y3}
    return "SELECT " + ", ".join(f'{e} AS "{label.format(**years)}"' for label, e in PUBLISHED_2017.items()) + " FROM o_res"


def result_oracles() -> dict[str, str]:
    c, y, s17, sp = CAREER, SINGLE_YEAR, EDITION2017, SPARSE

    def qr(cfg, select, extra=()):
        return q(cfg, select, labels=True, extra=tuple(result_ctes(cfg)) + tuple(extra))

    allc = ", ".join(
        f"round({x}, 6) AS {x}" if x.startswith("c_") or x.startswith("selfp") or x.startswith("cprat") else x
        for x in cut_cols(c, "all")
    )
    d = {
        "author_profile": qr(c, "SELECT author_id, authfull, inst_name, cntry, firstyr, lastyr, np, round(c_ns, 6) AS c_ns, round(c_ws, 6) AS c_ws FROM o_res"),
        "global_rank": qr(c, "SELECT author_id, round(c_ns, 6) AS c_ns, round(c_ws, 6) AS c_ws, rank_ns, rank_ws FROM o_res"),
        "citation_ratios": qr(c, "SELECT author_id, round(self_p, 6) AS self_p, round(cprat_ns, 6) AS cprat_ns, round(cprat_ws, 6) AS cprat_ws FROM o_res"),
        "citation_ratios_sparse": qr(sp, "SELECT author_id, round(self_p, 6) AS self_p, round(cprat_ns, 6) AS cprat_ns, round(cprat_ws, 6) AS cprat_ws FROM o_res"),
        "subfield_rank": qr(c, "SELECT author_id, sm_subfield_1, rank_sm_subfield_1_ws, rank_sm_subfield_1_ns, count_sm_subfield_1 FROM o_res"),
        "top_list": qr(c, "SELECT author_id, rank_ns, rank_ws, rank_sm_subfield_1_ws, rank_sm_subfield_1_ns, count_sm_subfield_1 FROM o_res WHERE top_listed"),
        "top_n_either": qr(s17, f"""SELECT author_id, rank_ns, rank_ws, inst_name, cntry, sm_subfield_1, sm_subfield_1_name, sm_field, sm_field_name
                                    FROM o_res WHERE rank_ws <= {s17.top_n} OR rank_ns <= {s17.top_n}"""),
        "subject_cutoffs": qr(c, f"SELECT level, subject, {allc} FROM o_cut", cutoff_ctes(c)),
        "toplist_cutoffs": qr(c, f"SELECT level, subject, {r6(cut_cols(c, 'top'))} FROM o_cut", cutoff_ctes(c)),
        "toplist_above": qr(c, f"SELECT level, subject, {', '.join(cut_cols(c, 'above'))} FROM o_cut", cutoff_ctes(c)),
        "cutoffs_lower": qr(s17, "SELECT * REPLACE (" + ", ".join(f"round(c_{_pct(p)}, 6) AS c_{_pct(p)}" for p in s17.percentiles) + ") FROM o_lcut", lower_ctes(s17)),
        "subfield_report_2017": qr(s17, "SELECT t.field_code AS sm22, l.subject AS sm176, l.subject_name AS sm176_name, l.* EXCLUDE (level, subject, subject_name) REPLACE ("
                                   + ", ".join(f"round(l.c_{_pct(p)}, 6) AS c_{_pct(p)}" for p in s17.percentiles)
                                   + ") FROM o_lcut l JOIN fx_tree t ON CAST(t.subfield_code AS VARCHAR) = l.subject WHERE l.level = 'subfield'", lower_ctes(s17)),
        "field_report": qr(c, f"""SELECT d.domain AS "Domain", COALESCE(c.subject, 'Unassigned') AS "Field", {report_select()}
                                 FROM o_cut c LEFT JOIN (SELECT DISTINCT domain, field FROM o_dict) d ON d.field = c.subject
                                 WHERE c.level IN ('field', 'total')""", cutoff_ctes(c)),
        "subfield_report": qr(c, f"""SELECT d.domain AS "Domain", d.field AS "Field", COALESCE(c.subject, 'Unassigned') AS "Subfield", {report_select()}
                                    FROM o_cut c LEFT JOIN o_dict d ON d.subfield = c.subject
                                    WHERE c.level IN ('subfield', 'total')""", cutoff_ctes(c)),
        "dropout_stats": qr(c, f"""SELECT *, round(CAST(n_leaving AS DOUBLE) / NULLIF(n_leading, 0), 6) AS x1_leaving_share,
                                    round(CAST(n_falling AS DOUBLE) / NULLIF(n_leading, 0), 6) AS x2_falling_share
            FROM (SELECT count(*) AS n_authors, count(CASE WHEN top_listed THEN 1 END) AS n_listed,
                   count(CASE WHEN top_listed THEN sm_subfield_1 END) AS n_listed_classified,
                   count(CASE WHEN top_listed AND sm_subfield_1 IS NOT NULL THEN cprat_ws END) AS n_listed_with_ratio,
                   count(CASE WHEN f_ws <= {_f(c.top_frac)} THEN 1 END) AS n_leading,
                   count(CASE WHEN f_ws <= {_f(c.top_frac)} AND f_ns > {_f(c.top_frac)} THEN 1 END) AS n_leaving,
                   count(CASE WHEN f_ws <= {_f(c.top_frac)} AND f_ns > {_f(0.1)} THEN 1 END) AS n_falling,
                   count(CASE WHEN top_listed AND cprat_ws >= p99 THEN 1 END) AS x3_concentrated
                  FROM (SELECT r.*, CAST(rank_sm_subfield_1_ws AS DOUBLE) / count_sm_subfield_1 AS f_ws,
                               CAST(rank_sm_subfield_1_ns AS DOUBLE) / count_sm_subfield_1 AS f_ns, x.top_list_cprat_99 AS p99
                        FROM o_res r LEFT JOIN (SELECT subject, top_list_cprat_99 FROM o_cut WHERE level = 'subfield') x
                        ON x.subject = r.sm_subfield_1)) """, cutoff_ctes(c)),
        "cprat_percentile": qr(c, """SELECT author_id, round(cprat_ws, 6) AS cprat_ws,
                   round(CASE WHEN cprat_ws IS NOT NULL THEN CAST(r AS DOUBLE) / n END, 6) AS cprat_perc, nc_ws, ncp_ws, top_listed
            FROM (SELECT *, rank() OVER (ORDER BY cprat_ws ASC NULLS FIRST) AS r, count(*) OVER () AS n
                  FROM o_res WHERE sm_subfield_1 = 'NATION_9') WHERE cprat_ws < 4"""),
        "null_rank": qr(sp, """SELECT author_id, round(cprat_ws, 6) AS cprat_ws,
                   CASE WHEN cprat_ws IS NOT NULL THEN rank() OVER (ORDER BY cprat_ws ASC NULLS FIRST) END AS rank_asc,
                   CASE WHEN cprat_ws IS NOT NULL THEN rank() OVER (ORDER BY cprat_ws DESC NULLS LAST) END AS rank_desc FROM o_res"""),
        "place_on_scale": qr(c, """SELECT p.author_id, round(p.c_ns, 6) AS c_ns, round(p.c_ws, 6) AS c_ws,
                   a_ns + 1 AS rank_ns, round(100.0 * (n_ns - a_ns) / n_ns, 6) AS percentile_ns, n_ns AS n_published_ns,
                   a_ws + 1 AS rank_ws, round(100.0 * (n_ws - a_ws) / n_ws, 6) AS percentile_ws, n_ws AS n_published_ws
            FROM (SELECT n.author_id, n.c_ns, n.c_ws,
                         (SELECT count(*) FROM o_res t WHERE t.top_listed AND t.c_ns > n.c_ns) AS a_ns,
                         (SELECT count(*) FROM o_res t WHERE t.top_listed AND t.c_ws > n.c_ws) AS a_ws,
                         (SELECT count(c_ns) FROM o_res WHERE top_listed) AS n_ns, (SELECT count(c_ws) FROM o_res WHERE top_listed) AS n_ws
                  FROM o_res n WHERE NOT n.top_listed) p"""),
        "corpus_summary": qr(c, "SELECT count(*) AS n_authors, count(sm_field) AS n_with_field FROM o_res"),
        "publish_table": qr(c, publish_sql(c)),
        "publish_table_2017": qr(s17, publish_2017_sql(s17)),
        "career_top": qr(c, publish_sql(c, "WHERE top_listed")),
        "single_year_top": qr(y, publish_sql(y, "WHERE top_listed")),
    }
    d["csv_roundtrip"] = d["subject_cutoffs"]
    d["top_list_csv"] = d["career_top"]
    d["maxima_csv"] = base_oracles()["log_maxima"]
    papers = """SELECT p.eid, CAST(p.year + {shift} AS INTEGER) AS year, p.publication_type, p.srcid,
        CAST(coalesce(r.n, 0) AS INTEGER) AS n_references, CAST(coalesce(s.n, 0) AS INTEGER) AS n_authors
      FROM fx_papers p LEFT JOIN (SELECT citing, count(*) AS n FROM fx_refs GROUP BY citing) r ON r.citing = p.eid
      LEFT JOIN (SELECT eid, count(*) AS n FROM fx_slots GROUP BY eid) s ON s.eid = p.eid"""
    d["corpus_layout"] = with_fixtures(select=papers.format(shift=0))
    d["corpus_layout_2017"] = with_fixtures(select=papers.format(shift=1))
    d["refreshed_edges"] = base_oracles()["citing_edges"]
    d["refreshed_citations"] = base_oracles()["paper_citations"]
    d["corpus_by_year"] = base_oracles()["paper_citations"]
    d["table_roundtrip"] = base_oracles()["eligible_authors"]
    d["stage_reuse"] = base_oracles()["author_metrics"]
    d["latest_table"] = with_fixtures(select="SELECT * FROM fx_inst_map")
    return d
