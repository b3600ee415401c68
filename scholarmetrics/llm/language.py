"""Language identification by mixture inference (operator 4).

Learning counts hashed character trigrams of the lower-cased UTF-8 text per language, over
all learning rows: each task adds up its own rows, the sums are merged in Spark, and the
model (languages x ``BUCKETS`` log probabilities, so bounded by the number of languages) is
broadcast.

For a document, expectation-maximisation estimates the share of every language from the
trigram likelihoods. Sets of the 1, 2, ... languages with the largest shares, as far as these
reach ``LEAST_SHARE``, are refitted and compared by penalised likelihood (``PENALTY`` x log of
the number of trigrams for each further language); the prediction is the largest share of the
chosen set. Every fit runs until its likelihood settles. Documents are inferred together in blocks, vectorised over their distinct trigrams.

Defined results: null text, or text without a letter, is ``und`` with score 0; a language
seen in no learning row is never predicted; without any learning row everything is ``und``;
equal shares go to the language that comes first by name. Null languages are not learnt.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import releasing, table

BUCKET_BITS = 16
BUCKETS = 1 << BUCKET_BITS
SMOOTHING = 0.5
EM_ROUNDS = 6  # rounds between two looks at the likelihood
REFIT_ROUNDS = 3  # the same for a set, which starts near its shares
SETTLED = 0.01  # a fit ends when these rounds gain less log likelihood
LEAST_SHARE = 0.02  # a language below this share is no candidate for a larger set
PENALTY = 3.0
EVIDENCE = 30  # trigrams counted as independent evidence in the score
BLOCK = 400_000  # distinct trigrams inferred at a time
MAX_LANGUAGES = 1000  # bound of the broadcast model: MAX_LANGUAGES * BUCKETS * 4 bytes

# letters (and all bytes of characters beyond ASCII) stay, everything else is a space
_CLEAN = np.full(256, 32, np.uint8)
_CLEAN[97:123] = np.arange(97, 123)
_CLEAN[128:] = np.arange(128, 256)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def trigrams(text: str) -> np.ndarray:
    """Hashed trigrams (uint16) around every letter byte of a text."""
    raw = np.frombuffer(b" " + text.lower().encode("utf-8", "replace") + b" ", np.uint8)
    b = _CLEAN[raw].astype(np.uint32)
    code = ((b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]) * np.uint32(2654435761)
    return (code >> np.uint32(32 - BUCKET_BITS)).astype(np.uint16)[b[1:-1] != 32]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[str, np.ndarray] = {}
    rows: dict[str, int] = {}
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            text = text.as_py()
            rows[lang] = rows.get(lang, 0) + 1
            if lang not in sums:
                sums[lang] = np.zeros(BUCKETS, np.int64)
            if text:
                sums[lang] += np.bincount(trigrams(text), minlength=BUCKETS)
    for lang in sums:
        at = np.flatnonzero(sums[lang])
        # bucket -1 carries the number of rows
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * (len(at) + 1), pa.string()), pa.array(np.append(at, -1).astype(np.int32)),
             pa.array(np.append(sums[lang][at], rows[lang]))], names=["lang", "bucket", "n"])


def learn(labelled: DataFrame) -> dict:
    """The model of (lang, text) rows with a language: names, log probabilities, priors."""
    sums = (
        labelled.filter(F.col("lang").isNotNull())
        .select(F.col("lang").cast("string").alias("lang"), F.col("text"))
        .mapInArrow(releasing(_count), "lang string, bucket int, n long")
        .groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    )
    # one row per (language, bucket): bounded by MAX_LANGUAGES * BUCKETS
    per = sums.groupBy("lang").agg(F.collect_list(F.struct("bucket", "n")).alias("counts"))
    names, table_, rows = [], [], []
    for r in per.sort("lang").toLocalIterator():
        if len(names) == MAX_LANGUAGES:
            raise ValueError(f"more than {MAX_LANGUAGES} languages: the model would be too large to broadcast")
        c = np.zeros(BUCKETS, np.float64)
        n_rows = 0
        for x in r["counts"]:
            if x["bucket"] < 0:
                n_rows = x["n"]
            else:
                c[x["bucket"]] = x["n"]
        names.append(r["lang"])
        rows.append(n_rows)
        table_.append(np.log((c + SMOOTHING) / (c.sum() + SMOOTHING * BUCKETS)).astype(np.float32))
    prior = np.array(rows, np.float64) / max(sum(rows), 1)
    return {"names": names, "log_p": np.ascontiguousarray(np.array(table_, np.float32).reshape(len(names), BUCKETS).T), "prior": prior}


def _em(r: np.ndarray, c: np.ndarray, starts: np.ndarray, size: np.ndarray, pi: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Shares after ``rounds`` rounds, and the their log likelihood (up to the rows' scaling)."""
    total = np.add.reduceat(c, starts)[:, None]
    for _ in range(rounds):
        q = r * np.repeat(pi, size, axis=0)
        s = q.sum(1)
        q *= (c / s)[:, None]
        pi = np.add.reduceat(q, starts, axis=0) / total
    s = (r * np.repeat(pi, size, axis=0)).sum(1)
    return pi, np.add.reduceat(c * np.log(s), starts, dtype=np.float64)


def _fit(r: np.ndarray, c: np.ndarray, size: np.ndarray, pi: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Shares and log likelihood as of ``_em`` when ``rounds`` more rounds gain less than ``SETTLED``."""
    pi, ll = pi.copy(), np.full(len(size), -np.inf)
    rest = np.arange(len(size))
    while len(rest):
        pi[rest], now = _em(r, c, np.cumsum(size) - size, size, pi[rest], rounds)
        gains = now - ll[rest] >= SETTLED
        ll[rest] = now
        if not gains.all():
            inside = np.repeat(gains, size)
            r, c, size, rest = r[inside], c[inside], size[gains], rest[gains]
    return pi, ll


def infer(docs: list[tuple[np.ndarray, np.ndarray]], model: dict) -> tuple[np.ndarray, np.ndarray]:
    """Per document (distinct trigrams, counts): shares of its chosen set, and its confidence."""
    log_p, prior = model["log_p"], model["prior"]
    k, n = log_p.shape[1], len(docs)
    shares, sure = np.zeros((n, k)), np.zeros(n)
    bare = np.array([len(u) == 0 for u, _ in docs])
    shares[bare, np.argmax(prior)], sure[bare] = 1.0, prior.max()
    rows = np.flatnonzero(~bare)
    if not len(rows):
        return shares, sure
    u = np.concatenate([docs[i][0] for i in rows])
    c = np.concatenate([docs[i][1] for i in rows]).astype(np.float32)
    size = np.array([len(docs[i][0]) for i in rows])
    starts = np.cumsum(size) - size
    lp = log_p[u]
    single = np.add.reduceat(lp * c[:, None], starts, axis=0, dtype=np.float64)
    number = np.add.reduceat(c, starts).astype(np.float64)
    top = lp.max(1)
    r = np.exp(lp - top[:, None])  # scaled per trigram: shares are unchanged
    scale = np.add.reduceat(c * top, starts, dtype=np.float64)
    pi, _ = _fit(r, c, size, np.full((len(rows), k), 1.0 / k, np.float32), EM_ROUNDS)
    mean = single / number[:, None]
    e = np.exp((mean - mean.max(1, keepdims=True)) * np.minimum(number, EVIDENCE)[:, None])
    best = np.argmax(single, axis=1)
    chosen = np.zeros((len(rows), k))
    chosen[np.arange(len(rows)), best] = 1.0
    value = single[np.arange(len(rows)), best]
    rank = np.argsort(-pi, axis=1, kind="stable")
    for m in range(2, k + 1):
        cand = np.flatnonzero(np.take_along_axis(pi, rank[:, m - 1 : m], 1)[:, 0] >= LEAST_SHARE)
        if not len(cand):
            break
        keep = np.zeros((len(rows), k), np.float32)
        np.put_along_axis(keep, rank[:, :m], 1.0, axis=1)
        start = (pi * keep)[cand]
        start /= start.sum(1, keepdims=True)
        inside = np.repeat(np.isin(np.arange(len(rows)), cand), size)
        sz = size[cand]
        got, ll = _fit(r[inside], c[inside], sz, start.astype(np.float32), REFIT_ROUNDS)
        ll = ll + scale[cand] - PENALTY * (m - 1) * np.log(number[cand])
        up = ll > value[cand]
        chosen[cand[up]], value[cand[up]] = got[up], ll[up]
    shares[rows] = chosen
    lead = np.argmax(chosen, axis=1)
    sure[rows] = chosen[np.arange(len(rows)), lead] * (e / e.sum(1, keepdims=True))[np.arange(len(rows)), lead]
    return shares, sure


_FOUND = pa.struct([("lang", pa.string()), ("share", pa.float64())])


def _distinct(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    s = np.sort(codes, kind="stable")  # a radix sort for 16 bits
    first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if len(s) else np.empty(0, np.int64)
    return s[first], np.diff(np.append(first, len(s)))


def _identify(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        names = m["names"]
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                docs, lettered, size, end = [], [], 0, at
                while end < batch.num_rows and (end == at or size < BLOCK):
                    text = batch.column(1)[end].as_py()
                    lettered.append(bool(names) and has_letter(text))
                    docs.append(_distinct(trigrams(text)) if lettered[-1] else (np.empty(0, np.uint16), np.empty(0, np.int64)))
                    size += len(docs[-1][0])
                    end += 1
                shares, sure = infer(docs, m) if names else (np.zeros((len(docs), 0)), np.zeros(len(docs)))
                pred, score, sets = [], [], []
                for i, ok in enumerate(lettered):
                    lead = int(np.argmax(shares[i])) if ok else -1
                    pred.append(names[lead] if ok else "und")
                    score.append(float(min(max(sure[i], 0.0), 1.0)) if ok else 0.0)
                    sets.append([{"lang": names[j], "share": float(shares[i, j])} for j in np.argsort(-shares[i], kind="stable")
                                 if shares[i, j] > 0] if ok else [])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, end - at), pa.array(pred, pa.string()), pa.array(score, pa.float64()),
                     pa.array(sets, pa.list_(_FOUND))], names=["_row", "lang_pred", "score", "languages"])
                at = end

    return run


def identify(docs: DataFrame, model: dict, keep: list[str] | None = None) -> DataFrame:
    """(_row: struct of the ``keep`` columns, all by default; lang_pred; score: share of the predicted
    language times the confidence in it; languages: the chosen set with shares)."""
    keep = docs.columns if keep is None else keep
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("_row"), F.col("text").alias("_text"))
    ddl = f"_row {rows.schema['_row'].dataType.simpleString()}, lang_pred string, score double, languages array<struct<lang:string,share:double>>"
    return rows.mapInArrow(releasing(_identify(docs.sparkSession.sparkContext.broadcast(model))), ddl)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = learn(docs.filter(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("lang", "text"))
    found = identify(docs.select("doc_id", "text"), model, keep=["doc_id"])
    return found.select(F.col("_row.doc_id").alias("doc_id"), held_out(F.col("_row.doc_id")).alias("held_out"),
                        "lang_pred", "score", "languages")
