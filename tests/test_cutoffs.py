"""The value histogram and the cut-offs read from it, against plain Python."""

import random

import pytest

from scholarmetrics import Config
from scholarmetrics.operators import cutoffs as CO

CFG = Config(top_n=5, percentiles=(0.25, 0.5, 0.95), ratio_percentiles=(0.9,))
COLS = "sm_field string, sm_subfield_1 string, top_listed boolean, rank_ns int, rank_ws int, nc_ws long, c_ws double, self_p double, cprat_ws double, cprat_ns double"


@pytest.fixture(scope="module")
def rows():
    r = random.Random(1)
    num = lambda: r.choice([None, 0.0, 0.5, 1.0, round(r.random(), 2)])
    return [(r.choice(["F1", "F2", None]), r.choice(["S1", "S2", "S3", None]), r.random() < 0.3, r.randrange(1, 12), r.randrange(1, 12),
             r.choice([0, 3, 3, 7, r.randrange(50)]), num(), num(), num(), num()) for _ in range(300)]


def groups(rows):
    out = {}
    for r in rows:
        for key in (("field", r[0]), ("subfield", r[1]), ("total", "TOTAL")):
            out.setdefault(key, []).append(r)
    return out


def upper(values, p):
    known = sorted((v for v in values if v is not None), reverse=True)
    n = len(known)
    return min((v for v in known if (n - sum(x > v for x in known)) / n >= p), default=None)


def test_cutoff_table_equals_its_definition(spark, rows):
    res = spark.createDataFrame(rows, COLS).repartition(3)
    got = {(r.level, r.subject): r.asDict() for r in CO.cutoff_table(res, CFG).collect()}
    at = {n: 5 + i for i, n in enumerate(("cites", "c", "selfp", "cprat", "cprat_ns"))}
    want = groups(rows)
    assert got.keys() == want.keys()  # the unknown subject is a group of its own, apart from the total
    for key, own in want.items():
        g = got[key]
        top = [r for r in own if r[2]]
        assert (g["auth"], g["auth_top_ns"], g["auth_top"]) == (len(own), sum(r[3] <= 5 for r in own), sum(r[4] <= 5 for r in own))
        assert g["auth_in_top_list"] == (len(top) or None)
        for name, ps in (("cites", CFG.percentiles), ("c", CFG.percentiles), ("selfp", (0.9,)), ("cprat", (0.9,)), ("cprat_ns", (0.9,))):
            for p in ps:
                assert g[f"{name}_{round(p * 100):02d}"] == upper([r[at[name]] for r in own], p), (key, name, p)
        for name in ("selfp", "cprat", "cprat_ns"):
            cut = upper([r[at[name]] for r in top], 0.9)
            assert g[f"top_list_{name}_90"] == cut
            assert g[f"auth_in_top_list_{name}_90"] == sum(cut is not None and r[at[name]] is not None and r[at[name]] >= cut for r in top)


def test_lower_cutoffs_equal_their_definition(spark, rows):
    res = spark.createDataFrame(rows, COLS).selectExpr("*", "concat('name ', sm_field) AS sm_field_name", "concat('name ', sm_subfield_1) AS sm_subfield_1_name")
    got = {(r.level, r.subject): r.asDict() for r in CO.cutoffs_lower(res, CFG).collect()}
    for (level, subject), own in groups(rows).items():
        g = got[level, "" if level == "total" else subject]
        assert g["auth"] == len(own) and g["subject_name"] == ("TOTAL" if level == "total" else subject and f"name {subject}")
        for name, k in (("cites", 5), ("c", 6)):
            order = sorted((r[k] for r in own), key=lambda v: (v is not None, v or 0))
            rank = lambda v: 1 + sum(x is None or x < v for x in order)
            for p in CFG.percentiles:
                assert g[f"{name}_{round(p * 100):02d}"] == min((v for v in order if v is not None and rank(v) / len(own) >= p), default=None)


def test_result_is_scanned_once(spark, rows, monkeypatch):
    plans = []
    real = CO.write_once
    monkeypatch.setattr(CO, "write_once", lambda df, name: plans.append(df._jdf.queryExecution().executedPlan().toString()) or real(df, name))
    path_rows = real(spark.createDataFrame(rows, COLS), "cutoff_input")
    final = CO.cutoff_table(path_rows, CFG)._jdf.queryExecution().executedPlan().toString()
    assert len(plans) == 1 and plans[0].count("FileScan") == 1 and "cutoff_input" not in final and "Expand" in plans[0]
    cells = sum(r["n"] for r in CO.value_histogram(path_rows, ("nc_ws",), CFG).filter("level = 'total'").collect())
    assert cells == len(rows)
