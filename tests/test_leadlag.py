import math
import time

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from tidemark.operators import leadlag as L, ranks as R

C = F.col


def test_lagged_pairs_against_pandas(spark):
    """Gaps on both sides, ties, a series that does not vary, arrays that start apart, a pair below the least length."""
    xs = {1: {q: (q * 7) % 5 for q in range(3, 20) if q % 6}, 2: {q: 1.5 for q in range(20)}, 3: {4: 1.0, 5: 2.0}, 4: {q: -((q * 11) % 7) for q in range(10, 30)}}
    ys = {10: {q: (q * 3) % 4 for q in range(0, 25) if q % 5}, 11: {q: q for q in range(8, 40)}, 4: {q: float(q % 3) for q in range(5, 30)}}
    rows = lambda d: [(k, q, float(v)) for k, m in d.items() for q, v in m.items()]
    s = L.vectors(spark.createDataFrame(rows(xs), "k int, qn int, v double"), "k", "qn", "v", "x")
    t = L.vectors(spark.createDataFrame(rows(ys), "target int, qn int, v double"), "target", "qn", "v", "y")
    got = L.lagged_pairs(s, t, (0, 1, 2), 5, C("k") != C("target")).collect()
    assert {(r.k, r.target) for r in got} == {(k, t) for k in xs for t in ys if k != t}
    for r in got:
        for lag, n, rho in r.lags:
            pairs = [(v, ys[r.target][q + lag]) for q, v in xs[r.k].items() if q + lag in ys[r.target]]
            assert n == len(pairs)
            p = pd.DataFrame(pairs, columns=["a", "b"]).rank() if pairs else None
            want = p.a.corr(p.b) if n >= 5 and p.a.nunique() > 1 and p.b.nunique() > 1 else None
            assert (rho is None) == (want is None or math.isnan(want)), (r.k, r.target, lag)
            assert want is None or abs(rho - want) < 1e-12
    gains = {(r.k, r.target) for r in L.lead_gain(spark.createDataFrame(got)).collect()}
    assert gains == {(r.k, r.target) for r in got if all(x.rho is not None for x in r.lags)} and gains
    assert L.lagged_pairs(s.limit(0), t, (0,), 1, F.lit(True)).count() == 0


def _vectors(rng, size, name):
    """Vectors with gaps, ties, a NaN and both zeros."""
    vals = [[None if rng.random() < 0.2 else float(rng.integers(-3, 4)) for _ in range(rng.integers(1, 30))] for _ in range(size)]
    vals[0], vals[1] = [float("nan"), 1.0, -0.0, 0.0, float("nan"), 2.0, None, -1.0, 3.0], [float("inf")] * 12
    at = pa.array([int(rng.integers(0, 8)) for _ in range(size)], pa.int32())
    return pa.StructArray.from_arrays([at, pa.array(vals, pa.list_(pa.float64()))], names=[f"{name}_at", name])


def test_tiles_against_pairs(monkeypatch):
    """A tile cut into the smallest parts gives what one part gives, and both what every pair gives by itself."""
    rng = np.random.default_rng(3)
    x, y, lags = _vectors(rng, 9, "x"), _vectors(rng, 7, "y"), (0, 1, 2)
    whole = L._tile(x, y, lags, 3)
    monkeypatch.setattr(L, "CELLS", 5)
    for a, b in zip(whole, L._tile(x, y, lags, 3), strict=True):
        assert np.array_equal(a, b, equal_nan=True)
    order = lambda v: math.inf if math.isnan(v) else v if math.isfinite(v) else 1e9
    for i, s in enumerate(x.to_pylist()):
        for j, t in enumerate(y.to_pylist()):
            at = {t["y_at"] + k: v for k, v in enumerate(t["y"]) if v is not None}
            for k, lag in enumerate(lags):
                met = [(order(v), order(at[p])) for p, v in enumerate(s["x"], s["x_at"] + lag) if v is not None and p in at]
                a, b = (pd.Series([m[c] for m in met], dtype=float).rank() for c in (0, 1))
                assert whole[0][i, j, k] == len(met)
                want = a.corr(b) if len(met) >= 3 and a.nunique() > 1 and b.nunique() > 1 else math.nan
                assert np.isclose(whole[1][i, j, k], want, atol=1e-12, equal_nan=True)


def test_many_pairs_in_little_time(spark):
    """300 by 300 vectors at three lags: 40 task seconds as expressions over every pair's two arrays."""
    d = spark.range(300).select("id", F.explode(F.sequence(F.lit(0), F.lit(24))).alias("qn"))
    d = d.withColumn("v", F.pmod(F.xxhash64("id", "qn"), F.lit(1000)).cast("double"))
    s = L.vectors(d, "id", "qn", "v", "x")
    t = L.vectors(d.withColumnRenamed("id", "target"), "target", "qn", "v", "y")
    L.lagged_pairs(s.limit(3), t, (0,), 20, F.lit(True)).count()  # workers are up
    began = time.perf_counter()
    got = L.lagged_pairs(s, t, (0, 1, 2), 20, C("id") != C("target"))
    r = got.agg(F.count("*"), F.count_distinct("id", "target"), F.sum(F.get("lags", F.lit(2))["n"]), F.count(F.get("lags", F.lit(2))["rho"])).first()
    assert tuple(r) == (300 * 299, 300 * 299, 300 * 299 * 23, 300 * 299)
    assert time.perf_counter() - began < 8


def test_weighted_percentiles(spark):
    rows = [("a", 1.0, 3), ("a", 2.0, 1), ("a", 5.0, 2), ("b", 7.0, 1), ("c", None, 4)]
    got = R.percentiles(spark.createDataFrame(rows, "k string, v double, n long"), ["k"], "v", {"p": 0.6, "top": 0.95}, "n")
    want = {k: np.percentile([v for a, v, n in rows if a == k for _ in range(n)], [60, 95]) for k in ("a", "b")}
    assert {r.k: (r.n, round(r.p, 9), round(r.top, 9)) for r in got.collect()} == {
        k: (sum(n for a, _, n in rows if a == k), round(p, 9), round(t, 9)) for k, (p, t) in want.items()
    }
