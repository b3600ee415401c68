import hashlib
import math
import random
from collections import defaultdict

import numpy as np
import pytest

from llm.fixtures import clashing
from scholarmetrics.llm import codes as C

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, cfg):
    """Plain Python: every distance in full, sums as Python integers."""
    kept = [(i, [math.floor(cfg.scale * x) for x in v], lab) for i, v, lab in rows
            if v and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    kept = [r for r in kept if len(r[1]) == len(kept[0][1])]
    width = len(kept[0][1]) // cfg.parts
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[cut(v, p) for _, v, _ in kept[: cfg.entries]] for p in range(cfg.parts)]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    best = lambda x, book: min((dist(x, e), j) for j, e in enumerate(book))
    for _ in range(cfg.rounds):
        for p in range(cfg.parts):
            mine = defaultdict(list)
            for _, v, _ in kept:
                mine[best(cut(v, p), books[p])[1]].append(cut(v, p))
            books[p] = [[sum(c) // len(mine[j]) for c in zip(*mine[j], strict=True)] if j in mine else e for j, e in enumerate(books[p])]
    out, by_label = [], defaultdict(int)
    for i, v, lab in kept:
        found = [best(cut(v, p), books[p]) for p in range(cfg.parts)]
        out.append((i, "".join(f"{j:02x}" for _, j in found), sum(d for d, _ in found), lab))
        by_label[lab] += out[-1][2]
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return [(i, c, e, by_label[lab]) for i, c, e, lab in out], sha, np.array(books)


def sample(seed, n, width, spread=1.0):
    r = random.Random(seed)
    centre = [[r.gauss(0, spread) for _ in range(width)] for _ in range(5)]
    f32 = lambda x: float(np.float32(x))
    return [(i, [f32(c + r.gauss(0, 0.2)) for c in centre[i % 5]], r.choice([None, 1, 2, 2, 2])) for i in range(n)]


def check(spark, rows, cfg):
    df = clashing(spark.createDataFrame(rows, SCHEMA).repartition(3), ["v", "code", "n", "_l"])
    coded, books = C.compress(df, cfg)
    got = C.with_label_error(coded).select("vec_id", "code", "error", "label_error").collect()
    want, sha, book = brute(rows, cfg)
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert C.books_sha256(books) == sha and (books == book).all()
    return coded, books


@pytest.mark.parametrize("width,parts", [(16, 8), (12, 4), (8, 8), (20, 4)])
def test_equals_brute_force(spark, width, parts):
    check(spark, sample(width, 150, width), C.CodeConfig(parts=parts, entries=7, rounds=3))


def test_hard_rows(spark):
    rows = sample(1, 40, 8)
    inf, nan = float("inf"), float("nan")
    rows += [(100, None, 1), (101, [], 1), (102, [None] * 8, 1), (103, [1.0] * 7 + [nan], 2), (104, [inf] + [0.0] * 7, None),
             (105, [1.0] * 4, 1), (None, [0.5] * 8, 9), (3, rows[3][1], 1), (3, [0.25] * 8, 1), (106, [0.0] * 8, None)]
    rows += [(200 + i, rows[0][1], 7) for i in range(60)]  # a common vector
    check(spark, rows, C.CodeConfig(parts=8, entries=16, rounds=6))
    check(spark, rows[:3], C.CodeConfig())  # fewer rows than entries
    check(spark, [(i, [1024.0 * x for x in v], lab) for i, v, lab in sample(2, 30, 8)], C.CodeConfig(parts=2, scale=1 << 20))


def test_empty_and_uneven(spark):
    none = spark.createDataFrame([], SCHEMA)
    coded, books = C.compress(none)
    assert coded.count() == 0 and C.with_label_error(coded).count() == 0 and books.shape[1] == 0
    with pytest.raises(ValueError, match="equal parts"):
        C.compress(spark.createDataFrame([(1, [0.0] * 9, 1)], SCHEMA))


def test_nearest_is_exact_for_any_size_and_ties():
    r = np.random.default_rng(5)
    for width, k, top in ((8, 16, 5000), (5, 3, 3), (1, 4, 2), (8, 16, 1 << 45), (3, 1, 9)):
        x, e = r.integers(-top, top, (300, width)), r.integers(-top, top, (k, width))
        e[-1] = e[0]
        chosen, d = C.nearest(x, e)
        full = ((x[:, None].astype(object) - e[None].astype(object)) ** 2).sum(2)
        assert [min(range(k), key=lambda j: (row[j], j)) for row in full] == chosen.tolist()
        assert full.min(1).tolist() == [int(v) for v in d]


def test_sequency_and_decode(spark):
    rows = C.transform(np.eye(8, dtype=np.int64))[C.sequency(8)]
    assert (np.diff(rows, axis=1) != 0).sum(1).tolist() == list(range(8))
    coded, books = C.compress(spark.createDataFrame(sample(4, 60, 16), SCHEMA))
    ints = {r.vec_id: r.v for r in C.integers(spark.createDataFrame(sample(4, 60, 16), SCHEMA)).collect()}
    for r in C.decode(coded, books).collect():
        assert sum((a - b) ** 2 for a, b in zip(ints[r.vec_id], r.v, strict=True)) == r.error
