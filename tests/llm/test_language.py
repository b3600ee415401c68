import numpy as np
from pyspark.sql import functions as F

from conftest import SF_SMALL
from llm.fixtures import clashing, empty, hard
from scholarmetrics.llm import language as L

SAMPLES = {
    "en": "the quick brown fox jumps over the lazy dog and then the other dogs run through the field",
    "de": "der schnelle braune fuchs springt über den faulen hund und danach laufen die anderen hunde durch das feld",
    "es": "el rápido zorro marrón salta sobre el perro perezoso y después los otros perros corren por el campo",
}


def learning(spark):
    rows = [(k, " ".join(v.split()[i:] + v.split()[:i])) for k, v in SAMPLES.items() for i in range(12)]
    return spark.createDataFrame(rows + [(None, "xyz"), ("en", None)], "lang string, text string")


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "lang")
    r = L.query(spark, SF_SMALL).join(docs, "doc_id").collect()
    assert len(r) == docs.count()
    held = [x for x in r if x.held_out]
    assert held and sum(x.lang == x.lang_pred for x in held) >= 0.97 * len(held)
    assert all(0 <= x.score <= 1 for x in r)


def test_mixture_and_language_set(spark):
    model = L.learn(learning(spark))
    mixed = spark.createDataFrame([(1, SAMPLES["en"]), (2, SAMPLES["en"] + " " + SAMPLES["de"] + " " + SAMPLES["de"])], "i int, text string")
    a, b = sorted(L.identify(mixed, model).collect(), key=lambda r: r["_row"]["i"])
    assert [x["lang"] for x in a["languages"]] == ["en"]
    assert [x["lang"] for x in b["languages"]] == ["de", "en"] and b["lang_pred"] == "de"
    assert 0.5 < b["languages"][0]["share"] < 0.85


def test_em_shares_equal_a_plain_loop():
    r = np.random.default_rng(0)
    p, c = r.random((50, 3)).astype(np.float32), r.integers(1, 5, 50).astype(np.float32)
    pi, _ = L._em(p, c, np.array([0, 20]), np.array([20, 30]), np.full((2, 3), 1 / 3, np.float32), 5)
    for k, (a, b) in enumerate([(0, 20), (20, 50)]):
        want = np.full(3, 1 / 3)
        for _ in range(5):
            q = p[a:b] * want
            want = (q / q.sum(1, keepdims=True) * c[a:b, None]).sum(0) / c[a:b].sum()
        assert np.allclose(pi[k], want, atol=1e-4)


def made_model(k):
    p = np.random.default_rng(1).dirichlet(np.full(L.BUCKETS, 0.05), k)
    return p, {"names": [f"l{i}" for i in range(k)], "log_p": np.log(p.T + 1e-9).astype(np.float32), "prior": np.full(k, 1 / k)}


def test_sets_of_more_than_three_languages():
    p, model = made_model(8)
    rng = np.random.default_rng(2)
    docs = []
    for m in (1, 2, 4, 6, 8):
        docs.append(L._distinct(np.concatenate([rng.choice(L.BUCKETS, 500, p=p[i]) for i in range(m)]).astype(np.uint16)))
    shares, _ = L.infer(docs, model)
    for m, s in zip((1, 2, 4, 6, 8), shares, strict=True):
        assert np.flatnonzero(s).tolist() == list(range(m))
        assert np.allclose(s[:m], 1 / m, atol=0.03)


def test_fits_run_until_the_likelihood_settles():
    rng = np.random.default_rng(3)
    r, c = (0.9 + 0.1 * rng.random((400, 3))).astype(np.float32), rng.integers(1, 50, 400).astype(np.float32)
    size, start = np.array([100, 300]), np.full((2, 3), 1 / 3, np.float32)
    _, ll = L._fit(r, c, size, start, 3)
    _, further = L._em(r, c, np.array([0, 100]), size, L._fit(r, c, size, start, 3)[0], 3)
    assert (further - ll < L.SETTLED).all() and (ll >= L._em(r, c, np.array([0, 100]), size, start, 3)[1]).all()


def test_hard_rows(spark):
    model = L.learn(learning(spark))
    d = clashing(hard(spark), ["lang_pred", "score", "_text"])
    rows = L.identify(d, model, keep=["doc_id"]).collect()
    assert len(rows) == d.count()
    by = {r["_row"]["doc_id"]: r for r in rows}
    assert all(by[i]["lang_pred"] == "und" and by[i]["score"] == 0 for i in (1, 2, 3))
    assert by[4]["lang_pred"] in SAMPLES and by[13]["lang_pred"] in SAMPLES
    assert L.identify(empty(spark), model).count() == 0
    none = L.learn(learning(spark).filter(F.lit(False)))
    assert {r["lang_pred"] for r in L.identify(d, none).collect()} == {"und"}
