"""Product codes against a plain k-means in Python integers."""

import hashlib
import math
import random

import numpy as np

from tidemark.llm import codes

SCHEMA = "vec_id long, embedding array<float>, label int, v int, block string"


def by_hand(rows, parts, entries, rounds):
    kept = [(i, [math.floor(4096 * float(np.float32(x))) for x in v], l) for i, v, l in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    least = min((r for r in kept if r[0] is not None), key=lambda r: (r[0], r[1]))
    kept = [r for r in kept if len(r[1]) == len(least[1])]
    w = len(least[1]) // parts
    cut = lambda v, p: v[p * w : (p + 1) * w]
    seeds = sorted((r for r in kept if r[0] is not None), key=lambda r: (r[0], r[1]))[:entries]
    books = [[cut(r[1], p) for r in seeds] for p in range(parts)]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))

    def assign():
        out = []
        for _, v, _ in kept:
            out.append([min((dist(cut(v, p), c), e) for e, c in enumerate(books[p])) for p in range(parts)])
        return out

    for _ in range(rounds):
        got = assign()
        for p in range(parts):
            for e in range(len(books[p])):
                mine = [cut(r[1], p) for r, g in zip(kept, got) if g[p][1] == e]
                if mine:
                    books[p][e] = [sum(c) // len(mine) for c in zip(*mine)]
    got = assign()
    errors = [sum(d for d, _ in g) for g in got]
    per = {}
    for (_, _, l), e in zip(kept, errors):
        per[l] = per.get(l, 0) + e
    digest = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    return [(r[0], "".join(f"{e:02x}" for _, e in g), err, per[r[2]], digest) for r, g, err in zip(kept, got, errors)]


def rows(n=150, width=8):
    rng = random.Random(4)
    out = [(i * 2, [rng.gauss(rng.choice([-1, 0, 1]), 0.2) for _ in range(width)], rng.choice([None, 1, 2])) for i in range(n)]
    out += [(i * 2 + 1, [rng.choice([-0.5, 0.5, 0.0]) for _ in range(width)], 3) for i in range(n)]
    out += [(9001, out[0][1], None), (0, out[0][1], 1), (0, out[3][1], 1), (None, out[4][1], 2), (1, None, 1), (3, [None] * width, 1), (5, [float("nan")] + [0.0] * (width - 1), 1)]
    return out + [(7, [float("inf")] * width, 2), (10**6, [0.5] * (width + 2), 1), (10**6 + 1, [], 1), (10**6 + 2, [30000.0] * width, 1)] + [out[5]] * 40


def frame(spark, data):
    return spark.createDataFrame([(i, v, l, 0, "x") for i, v, l in data], SCHEMA).repartition(3)


def test_codes(spark):
    data = rows()
    for parts, entries, rounds in ((4, 5, 4), (8, 16, 2), (2, 3, 0)):
        got = codes.summary(*codes.compress(frame(spark, data), parts, entries, rounds)).collect()
        assert sorted(map(tuple, got), key=str) == sorted(by_hand(data, parts, entries, rounds), key=str)


def test_few_and_no_rows(spark):
    few = rows()[:3]
    got = codes.summary(*codes.compress(frame(spark, few), 4, 16, 3)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(by_hand(few, 4, 16, 3), key=str)
    assert codes.summary(*codes.compress(frame(spark, few).limit(0))).count() == 0
    assert codes.summary(*codes.compress(frame(spark, [(1, None, 1), (None, [1.0] * 8, 1)]))).count() == 0


def test_balls_skip_work_and_change_nothing():
    rng = np.random.default_rng(1)
    centres = rng.integers(-4000, 4000, (16, 8))
    x = (centres[rng.integers(0, 16, 20000)] + rng.integers(-300, 300, (20000, 8))).astype(np.int64)
    book = x[:16].copy()
    entry, _ = codes._nearest(x, book)
    for _ in range(5):
        book = np.array([x[entry == e].sum(0) // max((entry == e).sum(), 1) if (entry == e).any() else book[e] for e in range(16)])
        want = codes._nearest(x, book)
        got = codes.ball_step(x, book, entry)
        assert (got[0] == want[0]).all() and (got[1] == want[1]).all()
        assert got[2] < 8 * len(x)
        entry = got[0]
