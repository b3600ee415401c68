import hashlib
import re

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from llm.fixtures import clashing, empty, hard
from scholarmetrics.llm import pii as P

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def base(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if {"email": lambda: True, "ip": lambda: all(int(x) <= 255 for x in m[0].split(".")),
                "card": lambda: 16 <= len(d) <= 19 and luhn(d), "phone": lambda: 8 <= len(d) <= 15}[kind]():
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return ",".join(out)


HARD = [None, "", "a@b.c_d@e.f x@y", "1.2.3.4.5.6.7.8", "256.1.1.1 1.256.1.1 01.002.0003.255", "+1 (555) 123-4567 +12",
        "4111 1111 1111 1111 4111-1111-1111-1112 4111111111111111111", "9" * 3000, "a" * 30000 + "@", "\u0001a@b.cc\u0001 é@x.yy",
        "x" * 5000 + "@b.c " * 50, "1 2 3 4 5 6 7 8 9 " * 400, "+1 2 3 4 5 6 7 8 9 ((((", "é" * 50 + "4111 1111 1111 1111",
        "1.1.1.1" * 50, "🙂 a.b+c@d-e.fg.hi, 10.0.0.1", "@@a@b..c a@b.c.", "4" * 16 + "@x.yz"]


def test_base_spans_equal_plain_patterns(spark):
    df = spark.createDataFrame(list(enumerate(HARD)), "doc_id long, text string")
    for r in P.find_pii(df).collect():
        assert ",".join(f"{s['kind']}:{s['start']}:{s['end']}" for s in r["base"]) == base(HARD[r["_row"]["doc_id"]])


def test_query_equals_plain_patterns(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()}
    rows = P.query(spark, SF_SMALL).collect()
    assert len(rows) == len(texts)
    for r in rows:
        b = base(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(b.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [len(re.findall(rf"\b{k}:", b)) for k in PATTERNS]
        assert set(b.split(",")) - {""} <= set(r.spans.split(","))


@pytest.mark.parametrize(("text", "spans"), [
    ("IBAN GB82 WEST 1234 5698 7654 32.", ["iban:5:32"]),
    ("GB82 WEST 1234 5698 7654 33", []),
    ("DE89370400440532013000", ["iban:0:22"]),
    ("ssn 123-45-6789", ["ssn:4:15"]),
    ("number 123-45-6789", []),
    ("ssn 000-45-6789", []),
    ("visa 378282246310005", ["card:5:20"]),
    ("code 378282246310005", []),
    ("+1 (269) 555-3296 4111111111111111 x", ["card:18:34", "phone:0:17"]),
    ("4111111111111111 4111111111111112", ["card:0:16"]),
])
def test_added_spans(spark, text, spans):
    r = P.find_pii(spark.createDataFrame([(text,)], "text string")).first()
    assert [f"{s['kind']}:{s['start']}:{s['end']}" for s in r["spans"]] == spans


def test_iban_ends_at_its_country_length(spark):
    cases = [
        ("IBAN BE68 5390 0754 7034 BIC GKCCBEBB", ["iban:5:24"]),
        ("BE68 5390 0754 7034 BIC GKCCBEBB", ["iban:0:19"]),
        ("ES9121000418450200051332 BIC", ["iban:0:24"]),
        ("ES91 2100 0418 4502 0005 1332 500 EUR", ["iban:0:29"]),
        ("AT61 1904 3002 3457 3201 PAID 2024", ["iban:0:24"]),
        ("HU42 1177 3016 1111 1018 0000 0000 BY", ["iban:0:34"]),
        ("BE68 5390 0754 7034 GB82 WEST 1234 5698 7654 32 DE89370400440532013000", ["iban:0:19", "iban:20:47", "iban:48:70"]),
        ("AB12 3456 7890 BE68 5390 0754 7034", ["iban:15:34"]),
        ("BE68 5390 0754 7035 BIC", []),
    ]
    df = spark.createDataFrame([(t,) for t, _ in cases], "text string").coalesce(1)
    found = {r["_row"]["text"]: [f"{s['kind']}:{s['start']}:{s['end']}" for s in r["spans"] if s["kind"] == "iban"] for r in P.find_pii(df).collect()}
    assert found == dict(cases)
    assert [r.text.count("[IBAN]") for r in P.redact(df).collect()] == [len(s) for _, s in cases]


def test_context_raises_the_score(spark):
    r = P.find_pii(spark.createDataFrame([("card 4111111111111111",), ("4111111111111111",)], "text string")).collect()
    assert [x["spans"][0]["score"] for x in r] == [1.0, 0.8]


def test_redaction_keeps_rows_and_columns(spark):
    d = clashing(hard(spark).unionByName(spark.createDataFrame([(50, "mail a@b.cc now", "en", "s", 15)], hard(spark).schema)),
                 ["spans", "base", "_text", "_s"])
    out = P.redact(d)
    assert out.columns == d.columns and out.count() == d.count()
    r = out.filter("doc_id = 50").first()
    assert (r.text, r.n_chars, r.spans) == ("mail [EMAIL] now", 16, "extra")
    before = {(x.doc_id, x.text, x.n_chars) for x in d.collect() if x.doc_id != 50}
    assert {(x.doc_id, x.text, x.n_chars) for x in out.collect() if x.doc_id != 50} == before
    assert P.redact(empty(spark)).count() == 0


def test_overlapping_spans_are_replaced_together(spark):
    found = F.expr("array(named_struct('kind','email','start',2,'end',6,'score',1d), named_struct('kind','ip','start',4,'end',9,'score',1d), "
                   "named_struct('kind','ip','start',9,'end',10,'score',1d))")
    assert spark.createDataFrame([("0123456789é",)], "t string").select(P.redacted(F.col("t"), found)).first()[0] == "01[EMAIL][IP]é"
