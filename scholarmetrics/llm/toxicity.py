"""Toxicity scores (operator 5): Levenshtein automata intersected with a lexicon trie.

The lexicon is a trie of terms (whole words, or stems that any ending may follow). The
Levenshtein automata of all terms, with an edit bound by term length, run over the trie as
one non-deterministic automaton; its states are determinised lazily and shared by all
words, so a word costs one table step per character and most words leave the automaton
after a few. A hit is exact or misspelled; a misspelling keeps the term's first and last
letter (or a digit in its place), as other words differ there ("closer", "tras" are not
"loser", "trash"), and may have an ending. The states are built anew beyond ``STATES``.

Each hit is scored in a window of ``CONTEXT`` words: a misspelled term counts ``MISSPELLED``
of an exact one, quotation (inside quotes, or after a reporting word) for a quarter, address
(a second-person word) for more. The strongest hit and the summed evidence go through a
logistic model, so that one clear hit is enough in a text that toxic texts with many hits
were learnt from.

Learning uses at most ``MAX_LEARN`` labelled documents (those of least hash of doc_id), one
row each, for the lexicon and the model; nothing else is bounded. A candidate stands in toxic
documents significantly more often than chance (binomial tail, corrected for the number of
candidates) and with precision ``LEAST_PRECISION``. Its support is the number of distinct
neighbour pairs around its first place in each toxic document, so copies of one document
do not make its words terms. Candidates are taken by support, the most specific first, and
must be significant in the toxic documents that no term taken before explains, so words that
merely stand beside the terms are not learnt. A term keeps its misspellings unless
they stand in more than ``CLEAN_SHARE`` of the clean documents ("closer" for "loser"). A small
seed lexicon applies where labels do not speak against it.

Defined results: null or empty text has no hits, hence the score of no evidence; very long
texts are scored whole; repeated rows are scored each; labels that repeat a doc_id count once
(toxic if any says so), and of rows that repeat a doc_id the least text is learnt; null
labels are not learnt; an empty table
gives an empty result; other columns pass through inside ``_row`` and never clash.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, releasing, table

MAX_LEARN = 10_000
CONTEXT = 6
STEM_LENGTHS = range(6, 9)  # shorter stems are whole words of innocent texts too
LEAST_LENGTH = 4
LEAST_PRECISION = 0.97
SIGNIFICANCE = 0.01
CLEAN_SHARE = 0.0005
MEMO = 400_000  # words remembered by a task; the memo starts anew when full
STATES = 200_000  # states of the automaton that a task holds
UNUSED, OTHER = "\0", "\1"  # letters of no term, and characters that are no letters

# Seed terms, reporting words, words of address.
SEED = ["asshole", "bastard", "bitch", "clown", "disgusting", "idiot", "imbecile", "loser", "moron", "pathetic", "scum",
        "stupid", "trash", "worthless"]
REPORTING = frozenset("said says wrote quoted quote quotes called term word phrase sagte schrieb zitat dijo dice escribió cita dit écrit citation".split())
ADDRESS = frozenset("you your yours yourself ur du dein deine dich ihr tu te ti tus usted vous toi ton ta".split())
MISSPELLED = 0.8
PRIOR = np.array([-4.0, 8.0, 1.0])  # bias, strongest hit, summed evidence
PRIOR_PRECISION = np.array([0.05, 0.05, 1.0])

_TOKEN = re.compile(r"\w+|[\"“”„«»]")
_QUOTES = frozenset("\"“”„«»")


def edits_allowed(term: str, stem: bool) -> int:
    n = len(term)
    return (0 if n < 6 else 1) if stem else (0 if n < 5 else 1 if n < 9 else 2)


class LexiconAutomaton:
    """Lazily determinised intersection of the terms' Levenshtein automata with their trie."""

    def __init__(self, terms: list[tuple[str, bool]], exact: frozenset[tuple[str, bool]] = frozenset()):
        """``exact``: the terms without misspellings."""
        self.child: list[dict[str, int]] = [{}]
        self.word_end: list[int] = [-1]  # edits allowed where a whole word ends, else -1
        self.stem_end: list[int] = [-1]
        self.budget: list[int] = [0]  # most edits of any term below a node
        self.term_at: dict[tuple[int, bool], tuple[str, bool]] = {}
        self.last: list[dict[str, int]] = [{}]  # final letters, which must be met
        for term, stem in terms:
            k, node, path = 0 if (term, stem) in exact else edits_allowed(term, stem), 0, [0]
            for i, c in enumerate(term):
                edge = self.child if i + 1 < len(term) else self.last
                # whole words and stems of one spelling end in two nodes
                key = c if i + 1 < len(term) else (c, stem)
                nxt = edge[node].get(key)
                if nxt is None:
                    nxt = edge[node][key] = len(self.child)
                    for table in (self.child, self.last):
                        table.append({})
                    self.word_end.append(-1)
                    self.stem_end.append(-1)
                    self.budget.append(0)
                node = nxt
                path.append(node)
            end = self.stem_end if stem else self.word_end
            end[node] = max(end[node], k)
            self.term_at[node, stem] = (term, stem)
            for p in path:
                self.budget[p] = max(self.budget[p], k)
        self.letters = frozenset(c for t, _ in terms for c in t)
        self.memo: dict[str, int] = {}
        self._reset()

    def _reset(self) -> None:
        self.states: dict[frozenset, int] = {}
        self.items: list[frozenset] = []
        self.step: list[dict[str, int]] = []
        self.final: list[int] = []  # edits of the best whole-word match, -1 if none
        self.stem: list[int] = []  # edits of the best stem match so far, -1 if none
        self.dead = self._state({})
        self.start = self._state({0: 0})

    def _closed(self, items: dict[int, int]) -> dict[int, int]:
        """Adds what skipping term characters reaches."""
        todo = list(items)
        while todo:
            node = todo.pop()
            e = items[node] + 1
            for nxt in self.child[node].values():
                if e <= self.budget[nxt] and e < items.get(nxt, 99):
                    items[nxt] = e
                    todo.append(nxt)
        return items

    def _state(self, items: dict[int, int]) -> int:
        key = frozenset(items.items())
        if key not in self.states:
            self.states[key] = len(self.items)
            self.items.append(key)
            self.step.append({})
            whole = [e for n, e in items.items() if 0 <= e <= self.word_end[n]]
            stem = [e for n, e in items.items() if 0 <= e <= self.stem_end[n]]
            self.final.append(min(whole, default=-1))
            self.stem.append(min(stem, default=-1))
        return self.states[key]

    def _move(self, state: int, c: str) -> int:
        out: dict[int, int] = {}

        def reach(node: int, e: int) -> None:
            if e <= self.budget[node] and e < out.get(node, 99):
                out[node] = e

        for node, e in self.items[state]:
            if node:
                reach(node, e + 1)  # a character too many, not before the first
            for letter, nxt in self.child[node].items():
                if letter == c or node or c == OTHER:
                    reach(nxt, e if letter == c else e + 1)
            for (letter, _), nxt in self.last[node].items():
                if letter == c or c == OTHER:
                    reach(nxt, e if letter == c else e + 1)
        return self._state(self._closed(out))

    def _symbol(self, c: str) -> str:
        return c if c in self.letters else UNUSED if c.isalpha() else OTHER

    def match(self, word: str) -> int:
        """Least edits of a term that the word spells (0: exact), -1 if none."""
        known = self.memo.get(word)
        if known is not None:
            return known
        if len(self.items) > STATES:
            self._reset()
        state, best = self.start, 99
        for c in word:
            c = self._symbol(c)
            nxt = self.step[state].get(c)
            if nxt is None:
                nxt = self.step[state][c] = self._move(state, c)
            state = nxt
            if state == self.dead:
                break
            s = self.stem[state]
            if 0 <= s < best:
                best = s
        f = self.final[state]
        if 0 <= f < best:
            best = f
        if len(self.memo) >= MEMO:
            self.memo.clear()
        self.memo[word] = best = -1 if best == 99 else best
        return best


    def terms_of(self, word: str) -> set[tuple[str, bool]]:
        """Every term that the word spells or misspells (for learning; ``match`` is the fast way)."""
        state, found = self.start, set()
        for k in range(len(word) + 1):
            for node, e in self.items[state]:
                if 0 <= e <= self.stem_end[node]:
                    found.add(self.term_at[node, True])
                if k == len(word) and 0 <= e <= self.word_end[node]:
                    found.add(self.term_at[node, False])
            if k < len(word):
                state = self._move(state, self._symbol(word[k]))
        return found


def evidence(text: str | None, automaton: LexiconAutomaton) -> tuple[float, float, bool, list[tuple[str, int, bool]]]:
    """The strongest hit's context score, the sum of all, whether all hits are misspelled, and the
    hits (word, edits, quoted)."""
    if not text:
        return 0.0, 0.0, False, []
    tokens = _TOKEN.findall(text.lower())
    match = automaton.match
    found = [(i, e) for i, e in enumerate(map(match, tokens)) if e >= 0]
    if not found:
        return 0.0, 0.0, False, []
    strength, amount, hits = 0.0, 0.0, []
    for i, e in found:
        before, after = tokens[max(0, i - CONTEXT) : i], tokens[i + 1 : i + 1 + CONTEXT]
        open_, close = any(t in _QUOTES for t in before), any(t in _QUOTES for t in after)
        quoted = (open_ and close) or any(t in REPORTING for t in before)
        addressed = any(t in ADDRESS for t in before) or any(t in ADDRESS for t in after)
        score = (MISSPELLED if e else 1.0) * (0.25 if quoted else 1.25 if addressed else 1.0)
        strength, amount = max(strength, score), amount + score
        hits.append((tokens[i], e, quoted))
    return min(strength, 1.0), amount, all(e for _, e in found), hits


def _features(strength: np.ndarray, amount: np.ndarray) -> np.ndarray:
    return np.stack([np.ones_like(strength), strength, 1.0 - np.exp(-amount)], axis=-1)


# -- learning ------------------------------------------------------------------


def _terms_of(tokens: list[str]) -> Iterator[tuple[str, int]]:
    """(term or stem*, position) of every word."""
    for i, w in enumerate(tokens):
        if len(w) >= LEAST_LENGTH:
            yield w, i
            for n in STEM_LENGTHS:
                if len(w) > n:
                    yield w[:n] + "*", i


def _toxic_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for text in batch.column(0).to_pylist():
            tokens = [t for t in _TOKEN.findall((text or "").lower()) if t not in _QUOTES]
            first: dict[str, int] = {}  # one place per document
            for term, i in _terms_of(tokens):
                first.setdefault(term, i)
            if first:
                near = [f"{tokens[i - 1] if i else ''} {tokens[i + 1] if i + 1 < len(tokens) else ''}" for i in first.values()]
                yield pa.RecordBatch.from_arrays([pa.array(list(first)), pa.array(near)], names=["term", "near"])


def _clean_terms(candidates):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, count = candidates.value, Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                tokens = [t for t in _TOKEN.findall((text or "").lower()) if t not in _QUOTES]
                count.update({t for t, _ in _terms_of(tokens)} & wanted)
        if count:
            yield pa.RecordBatch.from_arrays([pa.array(list(count)), pa.array(list(count.values()), pa.int64())], names=["term", "n"])

    return run


def _tail(t: int, n: int, p: float) -> float:
    """P(X >= t) of a binomial(n, p)."""
    logs = [math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p)
            for k in range(t, n + 1)]
    top = max(logs)
    return math.exp(top) * sum(math.exp(v - top) for v in logs)


def learn_lexicon(sample: DataFrame) -> list[tuple[str, bool]]:
    """Terms (term, is stem) from a bounded sample (text, toxic)."""
    broadcast = sample.sparkSession.sparkContext.broadcast
    sizes = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    n_toxic, n_clean = sizes.get(1, 0), sizes.get(0, 0)
    if not n_toxic or not n_clean:
        return [(t, False) for t in SEED]
    rows = sample.filter("toxic = 1").select("text").mapInArrow(_toxic_terms, "term string, near string")
    support = rows.groupBy("term").agg(F.count_distinct("near").alias("t")).filter("t >= 3")
    toxic = {r["term"]: r["t"] for r in support.toLocalIterator()}  # bounded by the sample
    counted = sample.filter("toxic = 0").select("text").mapInArrow(_clean_terms(broadcast(frozenset([*toxic, *SEED]))), "term string, n long")
    clean = {r["term"]: r["n"] for r in counted.groupBy("term").agg(F.sum("n").alias("n")).toLocalIterator()}
    p = n_toxic / (n_toxic + n_clean)
    precise = lambda t, c: t / (t + c) >= LEAST_PRECISION
    significant = lambda t, c: _tail(t, t + c, p) * len(toxic) < SIGNIFICANCE
    chosen, stems = [], set()
    # stems from short to long, then words: a term that an accepted stem covers adds nothing
    for term in sorted(toxic, key=lambda x: (x[-1] != "*", len(x), x)):
        body, t, c = term.rstrip("*"), toxic[term], clean.get(term, 0)
        if not precise(t, c) or any(body[:n] in stems for n in STEM_LENGTHS if n <= len(body)) or not significant(t, c):
            continue
        chosen.append((body, term[-1] == "*"))
        if term[-1] == "*":
            stems.add(body)
    seed = [t for t in SEED if clean.get(t, 0) < 3 or precise(toxic.get(t, 0), clean[t])]
    return sorted({*chosen, *((t, False) for t in seed)})


def _misspelt(lexicon: list[tuple[str, bool]]):
    """(term, stem, n): texts with a misspelling of the term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, count, known = LexiconAutomaton(lexicon), Counter(), {}
        for batch in batches:
            for text in batch.column(0).to_pylist():
                found = set()
                for w in set(_TOKEN.findall((text or "").lower())):
                    if automaton.match(w) > 0:
                        if w not in known:
                            known[w] = automaton.terms_of(w)
                        found |= known[w]
                count.update(found)
        keys = list(count)
        yield pa.RecordBatch.from_arrays(
            [pa.array([t for t, _ in keys], pa.string()), pa.array([s for _, s in keys], pa.bool_()), pa.array([count[k] for k in keys], pa.int64())],
            names=["term", "stem", "n"])

    return run


def learn_exact(sample: DataFrame, lexicon: list[tuple[str, bool]]) -> frozenset[tuple[str, bool]]:
    """The terms whose misspellings stand in more than CLEAN_SHARE of the clean texts: only their own
    spelling counts."""
    clean = sample.filter("toxic = 0").select("text")
    counted = clean.mapInArrow(_misspelt(lexicon), "term string, stem boolean, n long").groupBy("term", "stem").agg(F.sum("n").alias("n"))
    limit = CLEAN_SHARE * clean.count()
    return frozenset((r["term"], r["stem"]) for r in counted.toLocalIterator() if r["n"] > limit)


def _fit(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic weights by Newton steps, with a Gaussian prior."""
    w = PRIOR.copy()
    for _ in range(50):
        s = 1.0 / (1.0 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (s - y) + PRIOR_PRECISION * (w - PRIOR)
        hessian = (x * (s * (1 - s))[:, None]).T @ x + np.diag(PRIOR_PRECISION)
        step = np.linalg.solve(hessian, gradient)
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return w


def learn(labelled: DataFrame) -> dict:
    """The model of rows (doc_id, text, toxic): lexicon, terms without misspellings and weights, from at
    most MAX_LEARN rows."""
    sample = materialize(labelled.select("text", "toxic"), "toxicity_sample")
    lexicon = learn_lexicon(sample)
    model = {"lexicon": lexicon, "exact": learn_exact(sample, lexicon), "weights": PRIOR}
    rows = _scored(sample, model, ["toxic"]).select("_row.toxic", "strength", "amount").toPandas()  # at most MAX_LEARN rows of three numbers
    if not rows.empty:
        x = _features(rows["strength"].to_numpy(float), rows["amount"].to_numpy(float))
        model["weights"] = _fit(x, rows["toxic"].to_numpy(float))
    return model


def learning_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(text, toxic) of at most MAX_LEARN labelled documents: those of least hash of doc_id, so the
    choice is the same on every run. The chosen ids (16 bytes each) are broadcast."""
    each = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    few = each.orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_LEARN)
    chosen = docs.select("doc_id", "text").join(F.broadcast(few), "doc_id")
    return chosen.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")).select("text", "toxic")


# -- scoring ---------------------------------------------------------------------

_HIT = pa.struct([("word", pa.string()), ("edits", pa.int32()), ("quoted", pa.bool_())])


def _score(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        automaton, weights = LexiconAutomaton(m["lexicon"], m.get("exact", frozenset())), m["weights"]
        for batch in batches:
            found = [evidence(t.as_py(), automaton) for t in batch.column(1)]
            strength, amount, misspelled = (np.array([f[k] for f in found]) for k in range(3))
            score = 1.0 / (1.0 + np.exp(-np.clip(_features(strength, amount) @ weights, -30, 30)))
            hits = [[{"word": w, "edits": e, "quoted": q} for w, e, q in f[3]] for f in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(strength, pa.float64()), pa.array(amount, pa.float64()), pa.array(misspelled, pa.bool_()),
                 pa.array(score, pa.float64()), pa.array(hits, pa.list_(_HIT))],
                names=["_row", "strength", "amount", "misspelled", "score", "hits"])

    return run


def _scored(docs: DataFrame, model: dict, keep: list[str]) -> DataFrame:
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("_row"), F.col("text").alias("_text"))
    ddl = (f"_row {rows.schema['_row'].dataType.simpleString()}, strength double, amount double, misspelled boolean, score double, "
           "hits array<struct<word:string,edits:int,quoted:boolean>>")
    return rows.mapInArrow(releasing(_score(docs.sparkSession.sparkContext.broadcast(model))), ddl)


def score(docs: DataFrame, model: dict, keep: list[str] | None = None) -> DataFrame:
    """(_row: struct of the ``keep`` columns, all by default; strength of the strongest hit; amount of
    evidence; misspelled: no hit is exact; score; hits)."""
    return _scored(docs, model, docs.columns if keep is None else keep)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = learn(learning_rows(docs, labels.filter(~held_out(F.col("doc_id"))).select("doc_id", "toxic")))
    s = score(docs.select("doc_id", "text"), model, keep=["doc_id"])
    return s.select(F.col("_row.doc_id").alias("doc_id"), held_out(F.col("_row.doc_id")).alias("held_out"), "score",
                    (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("hits").alias("n_hits"))
