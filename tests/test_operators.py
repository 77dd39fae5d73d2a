import datetime as dt

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tidemark.operators import alloc, asof, episodes as E, reconcile as Q, stats as S, valuation as X, vintage as N

C = F.col
D = dt.date


def test_episode_spacing_counts_from_the_last_start(spark):
    d = spark.createDataFrame([("x", p) for p in (0, 62, 63, 125, 126)], "k string, pos int")
    got = sorted(r.pos for r in E.starts(d, ["k"], "pos", F.lit(True), 63).collect())
    assert got == [0, 63, 126]


def test_trip_exits(spark):
    rows = [("x", i, i in (2, 20), i in (1, 5, 6)) for i in range(40)]
    d = spark.createDataFrame(rows, "k string, pos int, ent boolean, up boolean")
    assert sorted(r.pos for r in E.trip_exits(d, ["k"], "pos", "ent", "up", 10).collect()) == [5, 30]


def test_ewma_equals_recursion(spark):
    x = np.random.default_rng(1).normal(size=700)
    d = spark.createDataFrame(pd.DataFrame({"k": "a", "i": range(700), "x": x}))
    got = E.ewma(d, ["k"], "i", "x", 10, "y").orderBy("i").toPandas().y
    assert np.allclose(got, pd.Series(x).ewm(span=10, adjust=False).mean(), atol=1e-13)


def test_state_flips_where_both_zones_hold(spark):
    on = [0, 1, 0, 1, 1, 0, 1, 0]
    off = [0, 0, 1, 1, 1, 1, 0, 0]
    state, want = False, []
    for a, b in zip(on, off):
        state = (not b) if state else bool(a)
        want.append(state)
    d = spark.createDataFrame([("k", i, bool(a), bool(b)) for i, (a, b) in enumerate(zip(on, off))], "k string, i int, a boolean, b boolean")
    got = [r.on for r in E.on_off_state(d, ["k"], "i", C("a"), C("b")).orderBy("i").collect()]
    assert got == want


def test_hybrid_hedge_waits_for_the_bear_end(spark):
    days = [D(2020, 1, i) for i in range(1, 11)]
    flags = {0: "x", 1: "s", 2: "r", 4: "e", 5: "x", 6: "r", 8: "x"}
    rows = [("k", d, *[flags.get(i) == f for f in "xrse"]) for i, d in enumerate(days)]
    d = spark.createDataFrame(rows, "k string, d date, x boolean, r boolean, s boolean, e boolean")
    got = sorted((r.on, r.off) for r in E.hybrid_intervals(d, ["k"], "d", C("x"), C("r"), C("s"), C("e")).collect())
    assert got == [(days[0], days[4]), (days[5], days[6]), (days[8], None)]


def test_waterfall_and_pro_rata(spark):
    d = spark.createDataFrame([("s", 1, 5.0, 9.0), ("s", 2, 5.0, 8.0), ("s", 3, 5.0, 7.0)], "k string, id int, want double, cap double").withColumn("room", F.lit(8.0))
    got = [r.filled for r in alloc.waterfall(d, ["k"], "want", "room", "cap", "id").orderBy("id").collect()]
    assert got == [5.0, 3.0, 0.0]
    assert np.allclose([r.filled for r in alloc.pro_rata(d, ["k"], "want", "room").collect()], 8 / 3)


def test_asof_directions_and_ties(spark):
    left = spark.createDataFrame([("a", D(2020, 1, 10)), ("a", D(2020, 1, 15)), ("b", D(2020, 1, 1))], "k string, t date")
    right = spark.createDataFrame([("a", D(2020, 1, 10), 1), ("a", D(2020, 1, 20), 2)], "k string, r date, v int")
    f = lambda x: {(r.k, r.t): r.v for r in x.collect()}
    assert f(asof.backward(left, right, ["k"], "t", "r", ["v"])) == {("a", D(2020, 1, 10)): 1, ("a", D(2020, 1, 15)): 1, ("b", D(2020, 1, 1)): None}
    assert f(asof.forward(left, right, ["k"], "t", "r", ["v"]))[("a", D(2020, 1, 10))] == 2
    assert f(asof.forward(left, right, ["k"], "t", "r", ["v"], inclusive=True))[("a", D(2020, 1, 10))] == 1
    assert f(asof.nearest(left, right, ["k"], "t", "r", ["v"], 5))[("a", D(2020, 1, 15))] == 1  # five days either way


def test_vintage_ties_and_restatement(spark):
    rows = [("k", 10.0, 1, 7), ("k", 10.0, 1, 5), ("k", 12.0, 3, 9)]
    v = N.vintage_agg(spark.createDataFrame(rows, "k string, value double, filed int, accn int"), ["k"]).first()
    assert (v.first, v.first_accn, v.latest, v.printings) == (10.0, 5, 12.0, 2)


def test_segment_addup_steps(spark):
    groups = {
        1: [("A", 60.0, "Alpha"), ("B", 40.0, "Beta")],
        2: [("A", 60.0, "Alpha"), ("B", 40.0, "Beta"), ("T", 100.0, "All")],
        3: [("A", 30.0, "Alpha"), ("B", 30.0, "Beta"), ("C", 40.0, "Gamma"), ("T", 60.0, "Total Products")],
        4: [("A", 60.0, "Alpha"), ("B", 40.0, "Beta"), ("R", 77.0, "Rollup"), ("U", -9.0, "Corporate")],
        5: [("A", 60.0, "Alpha"), ("B", 40.0, "Beta"), ("E", 30.0, "Europe"), ("J", 45.0, "Japan"), ("S", 21.5, "Asia")],
        6: [("A", 60.0, "Alpha"), ("B", 10.0, "Beta"), ("C", 11.0, "Gamma")],
    }
    rows = [(g, m, v, n) for g, ms in groups.items() for m, v, n in ms]
    seg = spark.createDataFrame(rows, "g int, member string, value double, name string")
    tot = spark.createDataFrame([(g, 100.0) for g in groups], "g int, total double")
    out = Q.segment_addup(seg, tot, ["g"], "member", "name", C("name").isin("Europe", "Japan", "Asia")).collect()
    gone = {g: sorted(r.member for r in out if r.g == g and r.step) for g in groups}
    assert gone == {1: [], 2: ["T"], 3: ["T"], 4: ["R", "U"], 5: ["E", "J", "S"], 6: []}
    assert {r.g: r.ok for r in out} == {1: True, 2: True, 3: True, 4: True, 5: True, 6: False}


def _addup_by_hand(rows, total):
    """The steps of one filing in a loop: rows (member, value, name, is_geo), exact values."""
    step, t = {m: None for m, *_ in rows}, max(1.0, 0.001 * abs(total or 0))

    def live(skip=()):
        kept = [v for m, v, *_ in rows if step[m] is None and m not in skip]
        known = [v for v in kept if v is not None]
        s = sum(known) if known else None
        return len(kept) or None, s, None if s is None or total is None else abs(s - total) <= t

    n, s, fit = live()
    if (n or 0) > 1 and fit is False:
        step |= {m: "equals total" for m, v, *_ in rows if v is not None and abs(v - total) <= 1}
    n, s, fit = live()
    if (n or 0) > 2 and fit is False:
        left = [(m, v, name) for m, v, name, _ in rows if step[m] is None and v is not None]
        one = [(not name.lower().startswith("total"), -abs(v), m) for m, v, name in left if abs(s - v - total) <= t]
        if one:
            step[min(one)[2]] = "subtotal"
        elif n >= 4:
            two = [(a, b) for a, v, _ in left for b, u, _ in left if a < b and abs(s - v - u - total) <= t]
            step |= {m: "subtotal" for m in (min(two) if two else ())}
    n, s, fit = live()
    geo = [m for m, _, _, g in rows if g and step[m] is None]
    if (n or 0) > 1 and fit is False and 0 < len(geo) < n and live(geo)[2]:
        step |= {m: Q.GEO_AXIS for m in geo}
    return step, live()


def test_segment_addup_against_a_loop_in_one_pass(spark):
    rng = np.random.default_rng(11)
    groups, totals = {}, {}
    for g in range(120):
        n = int(rng.integers(1, 9)) if g else 150
        rows = [(f"m{i:03}", float(rng.integers(8, 400)) / 4, rng.choice(["Unit", "Total parts", "all"]), False) for i in range(n)]
        totals[g] = sum(v for _, v, *_ in rows)
        kind = g % 6
        if kind == 0:  # a roll-up and a corporate line, anywhere in the order of names
            rows += [("m000a", totals[g] / 2 + 50, "Rollup", False), ("zz", 30.25, "Corporate", False)]
        elif kind == 1:
            rows += [("a", totals[g], "Consolidated", False)]
        elif kind == 2:
            rows += [("b", sum(v for _, v, *_ in rows[:2]), "Total Products", False), ("bb", None, "none", False)]
        elif kind == 3:
            rows += [(x, totals[g] * f, x, True) for x, f in (("Europe", 0.25), ("Japan", 0.5), ("Asia", 0.125))]
        elif kind == 4:
            rows += [("x", totals[g] * 0.375 + 2, "Unknown", False)]
        else:
            totals[g] = None if g % 4 else totals[g]
        groups[g] = rows
    flat = [(g, m, v, str(n)) for g, rows in groups.items() for m, v, n, _ in rows] + [(None, "q", 1.0, "no filing")]
    seg = spark.createDataFrame(flat, "g int, member string, value double, name string")
    tot = spark.createDataFrame([(g, t) for g, t in totals.items() if g % 12 != 5], "g int, total double")
    sc = spark.sparkContext
    sc.setJobGroup("addup", "addup")
    try:
        out = Q.segment_addup(seg, tot, ["g"], "member", "name", C("name").isin("Europe", "Japan", "Asia"))
        assert len(sc.statusTracker().getJobIdsForGroup("addup")) == 0  # nothing is written on the way
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    got = {(r.g, r.member): (r.step, r.n_kept, r.sum_kept, r.ok) for r in out.collect()}
    want = {(None, "q"): (None, None, None, None)}
    for g, rows in groups.items():
        step, kept = _addup_by_hand(rows, totals[g] if g % 12 != 5 else None)
        want |= {(g, m): (step[m], *kept) for m, *_ in rows}
    assert got == want
    assert {r[0] for r in want.values()} == {None, "equals total", "subtotal", Q.GEO_AXIS}


def test_label_swap_only_when_a_permutation(spark):
    f = spark.createDataFrame([(1, "A", 1.0), (1, "B", 2.0), (2, "A", 1.0), (2, "B", 2.0)], "g int, name string, value double")
    p = spark.createDataFrame([(1, 1.0, "B"), (1, 2.0, "A"), (2, 1.0, "B")], "g int, value double, label string")
    got = sorted((r.g, r.value, r.name) for r in Q.swap_labels(f, p, ["g"], ["g"], "name").collect())
    assert got == [(1, 1.0, "B"), (1, 2.0, "A"), (2, 1.0, "A"), (2, 2.0, "B")]


def test_two_asset_nav_equals_the_loop(spark):
    rng = np.random.default_rng(3)
    n, cost = 300, 0.0005
    ra, rb = rng.normal(0, 0.02, n), rng.normal(0, 0.01, n)
    target = np.where((np.arange(n) // 40) % 2, 0.75, 0.5)
    days = pd.bdate_range("2020-01-01", periods=n)
    d = spark.createDataFrame(pd.DataFrame({"k": "x", "d": days.date, "ra": ra, "rb": rb, "t": target}))
    got = X.two_asset_nav(d, ["k"], "d", "ra", "rb", "t", cost).orderBy("d").toPandas()
    xa, xb, navs = target[0], 1 - target[0], []
    for i in range(n):
        if i:
            xa, xb = xa * np.exp(ra[i]), xb * np.exp(rb[i])
        nav = xa + xb
        last = i + 1 < n and days[i + 1].month != days[i].month
        if i == 0 or target[i] != target[i - 1] or last:
            nav -= 2 * abs(nav * target[i] - xa) * cost
            xa, xb = nav * target[i], nav * (1 - target[i])
        navs.append(nav)
    assert np.allclose(got.nav, navs, rtol=1e-12)


def test_pooled_r2_with_three_regressors(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(200, 3))
    y = x @ [1.0, -2.0, 0.5] + rng.normal(size=200)
    d = spark.createDataFrame(pd.DataFrame(np.column_stack([y, x]), columns=["y", "a", "b", "c"]))
    a = np.column_stack([np.ones(200), x])
    res = y - a @ np.linalg.lstsq(a, y, rcond=None)[0]
    want = 1 - (res**2).sum() / ((y - y.mean()) ** 2).sum()
    assert abs(S.pooled_r2(d, "y", ["a", "b", "c"]).first().r2 - want) < 1e-9


def test_two_sided_p(spark):
    """Known quantiles, odd and even degrees of freedom, and the tail integrated by hand."""
    from math import gamma, pi, sqrt

    def by_hand(t, n, steps=200000):
        c = gamma((n + 1) / 2) / (sqrt(n * pi) * gamma(n / 2))
        x = (np.arange(steps) + 0.5) * (t / steps)
        return 1 - 2 * c * float(((1 + x * x / n) ** (-(n + 1) / 2)).sum()) * t / steps

    rows = [(0.0, 5.0), (12.706, 1.0), (4.303, 2.0), (-2.571, 5.0), (2.228, 10.0), (1.984, 100.0), (0.7, 7.0), (1.3, 24.0), (30.0, 40.0)]
    got = [r[0] for r in spark.createDataFrame([*rows, (None, 4.0), (1.0, 0.0)], "t double, n double").coalesce(1).select(S.p_value(F.col("t"), F.col("n"))).collect()]
    assert np.allclose(got[:6], [1.0, 0.05, 0.05, 0.05, 0.05, 0.05], atol=2e-4) and got[9:] == [None, None]
    assert np.allclose(got[:9], [by_hand(abs(t), int(n)) for t, n in rows], atol=1e-9)


def test_draws_inside_a_row_equal_those_of_the_shuffle(spark):
    d = spark.range(60).selectExpr("id % 2 AS k", "id AS i", "CAST(id * 7 % 11 AS DOUBLE) AS a", "CAST(id * 5 % 13 AS DOUBLE) AS b")
    one = S.permuted_products(d, ["k"], "i", "a", "b", 30, 7).collect()
    two = S.permuted_products(d, ["k"], "i", "a", "b", 30, 7, most=10).collect()
    assert len(one) == 60 and sorted(map(tuple, one)) == sorted(map(tuple, two))


def test_a_large_cohort_draws_in_its_task(spark):
    """Ids of several lengths, enough of each for hashing a column at a time; a null id hashes to the front."""
    import hashlib

    n, draws, seed = 3000, 3, 7
    rows = [(5, None if i == 17 else i * 7, float(i % 11), float(i % 13)) for i in range(n)]
    d = spark.createDataFrame(rows, "k int, i long, a double, b double")
    assert S.MOST_NAMES >= 400_000
    got = {r.draw: r.cross for r in S.permuted_products(d, ["k"], "i", "a", "b", draws, seed).collect()}
    front = lambda x: -1 if x is None else x
    base = [r[2] for r in sorted(rows, key=lambda r: front(r[1]))]
    for draw in range(draws):
        h = lambda x: "" if x is None else hashlib.md5(f"{seed}-{draw}-5-{x}".encode()).hexdigest()[:8]
        value = [r[3] for r in sorted(rows, key=lambda r: (h(r[1]), front(r[1])))]
        assert got[draw] == sum(x * y for x, y in zip(base, value))


def test_placebo_is_deterministic_and_flat_on_noise(spark):
    rng = np.random.default_rng(9)
    d = spark.createDataFrame(pd.DataFrame({"c": np.repeat(range(4), 25), "id": range(100), "s": rng.normal(size=100), "r": rng.normal(size=100)}))
    a = S.permutation_test(d, ["c"], "id", "s", "r", draws=20).first()
    b = S.permutation_test(d, ["c"], "id", "s", "r", draws=20).first()
    assert a == b and a.draws == 20 and 1 / 21 <= a.p <= 1


def test_dealt_rows_join_without_another_shuffle(spark):
    from tidemark.session import cut_dealt

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    a = cut_dealt(spark.range(1000), parts, "id")
    got = a.join(spark.range(50).groupBy("id").count().hint("merge"), "id")
    assert got.count() == 50
    assert got._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(id") == 1
    assert spark.conf.get("spark.sql.adaptive.enabled") == "true"
