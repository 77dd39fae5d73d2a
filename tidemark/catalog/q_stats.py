"""Rank correlations, spreads, residuals and placebo tests on the quarterly study table."""

from pyspark.sql import Window, functions as F

from tidemark.catalog import views as V
from tidemark.catalog.registry import query
from tidemark.operators import leadlag as L, ranks as R, stats as S, windows as W
from tidemark.session import cut_lineage

C = F.col
K = ["cohort"]
CUT = 7992


def r6(*cols):
    return [F.round(C(c), 6).alias(c) for c in cols]


def study(spark, sf):
    """The study table is used several times by each test, so its rows are written once."""
    return cut_lineage(V.study(spark, sf))


def avg_rank(value, part):
    return f"(rank() OVER (PARTITION BY {part} ORDER BY {value}) + (count(*) OVER (PARTITION BY {part}, {value}) - 1) / 2.0)"


_RK = f"""rk AS (SELECT *, CAST({avg_rank('sig', 'cohort')} AS DOUBLE) AS rs, CAST({avg_rank('ret', 'cohort')} AS DOUBLE) AS rr,
  count(*) OVER (PARTITION BY cohort) AS n FROM study),
ic AS (SELECT cohort, count(*) AS n, corr(rs, rr) AS ic FROM rk GROUP BY cohort HAVING count(*) >= 6 AND count(DISTINCT sig) >= 3)"""

_Q = """bk AS (SELECT *, CAST(greatest(ceil((p - 1) * 5.0 / (n - 1)) - 1, 0) AS INT) AS bucket FROM (SELECT *, count(*) OVER (PARTITION BY cohort) AS n,
  row_number() OVER (PARTITION BY cohort ORDER BY sig, cik) AS p FROM study)),
sp AS (SELECT cohort, count(*) AS n, avg(ret) FILTER (WHERE bucket = 0) AS q1, avg(ret) FILTER (WHERE bucket = 4) AS q5,
  avg(ret) FILTER (WHERE bucket = 4) - avg(ret) FILTER (WHERE bucket = 0) AS spread FROM bk GROUP BY cohort)"""


@query("j01_average_rank", f"WITH {_RK} SELECT cik, cohort, rs, round(rs / n, 6) AS pct FROM rk")
def j01(spark, sf):
    d = R.average_rank(study(spark, sf), K, "sig", "rs", size="n")
    return d.select("cik", "cohort", "rs", F.round(C("rs") / C("n"), 6).alias("pct"))


@query("j02_rank_ic", f"WITH {_RK} SELECT cohort, n, round(ic, 6) AS ic FROM ic")
def j02(spark, sf):
    return S.cohort_ic(study(spark, sf), K, "sig", "ret").select("cohort", "n", *r6("ic"))


@query(
    "j03_quintile_spread",
    f"WITH {_Q} SELECT cohort, n, round(q1, 9) AS q1, round(q5, 9) AS q5, round(spread, 9) AS spread FROM sp",
)
def j03(spark, sf):
    d = S.quantile_spread(study(spark, sf), K, "sig", "ret", "cik")
    return d.select("cohort", "n", *[F.round(C(c), 9).alias(c) for c in ("q1", "q5", "spread")])


@query(
    "j04_value_quintiles",
    """WITH e AS (SELECT quantile_cont(ctrl, 0.2) AS a, quantile_cont(ctrl, 0.4) AS b, quantile_cont(ctrl, 0.6) AS c, quantile_cont(ctrl, 0.8) AS d FROM study),
x AS (SELECT ctrl, ret, 1 + CAST(ctrl > a AS INT) + CAST(ctrl > b AS INT) + CAST(ctrl > c AS INT) + CAST(ctrl > d AS INT) AS bucket FROM study CROSS JOIN e)
SELECT bucket, round(avg(ctrl), 6) AS z_mean, round(avg(ret), 6) AS mean, round(median(ret), 6) AS median, round(avg(CAST(ret > 0 AS INT)), 6) AS hit, count(*) AS rows FROM x GROUP BY bucket""",
)
def j04(spark, sf):
    d = S.value_quantiles(study(spark, sf), "ctrl", "ret")
    return d.select("bucket", *r6("z_mean", "mean", "median", "hit"), "rows")


_RES = f"""rx AS (SELECT *, CAST({avg_rank('sig', 'cohort')} AS DOUBLE) / count(*) OVER (PARTITION BY cohort) AS y, CAST({avg_rank('ctrl', 'cohort')} AS DOUBLE) / count(*) OVER (PARTITION BY cohort) AS x FROM study),
ln AS (SELECT cohort, regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM rx GROUP BY cohort HAVING count(*) >= 6),
res AS (SELECT rx.*, y - (b * x + a) AS r FROM rx JOIN ln USING (cohort))"""


@query("j05_residualise", f"WITH {_RES} SELECT cik, cohort, round(r, 6) AS r FROM res")
def j05(spark, sf):
    return S.residualise(study(spark, sf), K, "sig", "ctrl", "r").select("cik", "cohort", *r6("r"))


@query(
    "j06_pooled_r2",
    """SELECT 'base' AS model, count(*) AS n, round(regr_r2(ret, sig), 6) AS r2 FROM study
UNION ALL SELECT 'with control' AS model, count(*) AS n, round((power(corr(ret, sig), 2) + power(corr(ret, ctrl), 2) - 2 * corr(ret, sig) * corr(ret, ctrl) * corr(sig, ctrl)) / (1 - power(corr(sig, ctrl), 2)), 6) AS r2 FROM study""",
)
def j06(spark, sf):
    d = study(spark, sf)
    a = S.pooled_r2(d, "ret", ["sig"]).select(F.lit("base").alias("model"), "n", *r6("r2"))
    b = S.pooled_r2(d, "ret", ["sig", "ctrl"]).select(F.lit("with control").alias("model"), "n", *r6("r2"))
    return a.unionByName(b)


@query(
    "j07_newey_west_t",
    f"""WITH {_RK}, e AS (SELECT cohort, ic, ic - avg(ic) OVER () AS e FROM ic), l AS (SELECT *, e * lag(e) OVER (ORDER BY cohort) AS e1, e * lag(e, 2) OVER (ORDER BY cohort) AS e2 FROM e),
g AS (SELECT count(*) AS n, avg(ic) AS m, sum(e * e) / count(*) + 2 * (2.0 / 3) * sum(e1) / count(*) + 2 * (1.0 / 3) * sum(e2) / count(*) AS v FROM l)
SELECT n, round(m, 6) AS mean, round(m / sqrt(v / n), 6) AS t_nw FROM g""",
)
def j07(spark, sf):
    ic = S.cohort_ic(study(spark, sf), K, "sig", "ret")
    return S.newey_west(ic, [], "cohort", "ic", 2).select("n", *r6("mean", "t_nw"))


DRAWS = 2000

_DR = f"""dr AS (SELECT CAST(unnest(generate_series(0, {DRAWS - 1})) AS INT) AS draw)"""


@query(
    "j08_within_cohort_permutation",
    f"""WITH {_RK}, {_DR},
us AS (SELECT * FROM rk WHERE cohort IN (SELECT cohort FROM study GROUP BY cohort HAVING count(*) >= 20 AND count(DISTINCT sig) >= 3)),
base AS (SELECT cohort, rs, row_number() OVER (PARTITION BY cohort ORDER BY cik) AS p FROM us),
sh AS (SELECT draw, cohort, rr, row_number() OVER (PARTITION BY cohort, draw ORDER BY substr(md5('7-' || draw || '-' || cohort || '-' || cik), 1, 8), cik) AS p FROM us CROSS JOIN dr),
d AS (SELECT sh.draw, sh.cohort, corr(base.rs, sh.rr) AS ic FROM sh JOIN base USING (cohort, p) GROUP BY 1, 2),
m AS (SELECT draw, round(avg(ic), 12) AS m FROM d GROUP BY draw),
o AS (SELECT round(avg(ic), 12) AS obs FROM (SELECT cohort, corr(rs, rr) AS ic FROM us GROUP BY cohort))
SELECT round(max(obs), 6) AS obs, count(*) AS draws, round((count(*) FILTER (WHERE m >= obs) + 1) / (count(*) + 1), 6) AS p FROM m CROSS JOIN o""",
)
def j08(spark, sf):
    d = S.permutation_test(study(spark, sf), K, "cik", "sig", "ret", draws=DRAWS)
    return d.select(*r6("obs"), "draws", *r6("p"))


@query(
    "j09_gate_event_test",
    f"""WITH {_DR}, g AS (SELECT *, CASE WHEN sig > 0.3 AND ctrl > 0 THEN 1 ELSE 0 END AS g FROM study),
per AS (SELECT cohort, avg(ret) FILTER (WHERE g = 1) - avg(ret) FILTER (WHERE g = 0) AS diff FROM g GROUP BY cohort HAVING sum(g) >= 2 AND sum(1 - g) >= 5),
u AS (SELECT g.* FROM g WHERE cohort IN (SELECT cohort FROM per)),
base AS (SELECT cohort, g AS pg, row_number() OVER (PARTITION BY cohort ORDER BY cik) AS p FROM u),
sh AS (SELECT draw, cohort, ret, row_number() OVER (PARTITION BY cohort, draw ORDER BY substr(md5('7-' || draw || '-' || cohort || '-' || cik), 1, 8), cik) AS p FROM u CROSS JOIN dr),
d AS (SELECT draw, cohort, avg(ret) FILTER (WHERE pg = 1) - avg(ret) FILTER (WHERE pg = 0) AS diff FROM sh JOIN base USING (cohort, p) GROUP BY 1, 2),
m AS (SELECT draw, round(avg(diff), 12) AS m FROM d GROUP BY draw), o AS (SELECT round(avg(diff), 12) AS obs FROM per)
SELECT round(max(obs), 6) AS obs, count(*) AS draws, round((count(*) FILTER (WHERE m >= obs) + 1) / (count(*) + 1), 6) AS p FROM m CROSS JOIN o""",
)
def j09(spark, sf):
    d = study(spark, sf).withColumn("gate", (C("sig") > 0.3) & (C("ctrl") > 0))
    return S.gate_test(d, K, "cik", "gate", "ret", draws=DRAWS).select(*r6("obs"), "draws", *r6("p"))


_IC_BY = f"""rks AS (SELECT *, CAST({avg_rank('sig', 'slice, cohort')} AS DOUBLE) AS rs, CAST({avg_rank('ret', 'slice, cohort')} AS DOUBLE) AS rr FROM sl),
ics AS (SELECT slice, cohort, corr(rs, rr) AS ic FROM rks GROUP BY 1, 2 HAVING count(*) >= 6 AND count(DISTINCT sig) >= 3)"""


@query(
    "j10_robustness_slices",
    f"""WITH md AS (SELECT median(size) AS m FROM study),
sl AS (SELECT 'first half' AS slice, study.* FROM study WHERE cohort < {CUT} UNION ALL SELECT 'second half', study.* FROM study WHERE cohort >= {CUT}
UNION ALL SELECT 'above median', study.* FROM study CROSS JOIN md WHERE size >= m UNION ALL SELECT 'below median', study.* FROM study CROSS JOIN md WHERE size < m), {_IC_BY}
SELECT slice, count(*) AS cohorts, round(avg(ic), 6) AS mean, round(avg(ic) / (stddev_samp(ic) / sqrt(count(*))), 6) AS t FROM ics GROUP BY slice""",
)
def j10(spark, sf):
    d = study(spark, sf)
    med = R.percentiles(d, [], "size", {"m": 0.5}).select("m").scalar()
    labels = F.array(
        F.when(C("cohort") < CUT, "first half").otherwise("second half"),
        F.when(C("size") >= C("m"), "above median").otherwise("below median"),
    )
    d = d.withColumn("m", med).withColumn("slice", F.explode(labels))
    ic = S.cohort_ic(d, ["slice", "cohort"], "sig", "ret")
    return S.summarise(ic, ["slice"], "ic").select("slice", "cohorts", *r6("mean", "t"))


@query(
    "j11_subsample_stability",
    f"""WITH sl AS (SELECT CASE WHEN cohort < {CUT} THEN 'a' ELSE 'b' END AS slice, study.* FROM study), {_IC_BY},
m AS (SELECT avg(ic) FILTER (WHERE slice = 'a') AS before, avg(ic) FILTER (WHERE slice = 'b') AS after FROM ics)
SELECT round(before, 6) AS before, round(after, 6) AS after, CAST(sign(before) = sign(after) AS INT) AS same_sign FROM m""",
)
def j11(spark, sf):
    ic = S.cohort_ic(study(spark, sf), K, "sig", "ret")
    m = ic.agg(
        F.avg(F.when(C("cohort") < CUT, C("ic"))).alias("before"), F.avg(F.when(C("cohort") >= CUT, C("ic"))).alias("after")
    )
    return m.select(*r6("before", "after"), (F.signum("before") == F.signum("after")).cast("int").alias("same_sign"))


@query(
    "j12_beyond_reaction",
    f"""WITH {_RES}, rk AS (SELECT cohort, r, CAST({avg_rank('r', 'cohort')} AS DOUBLE) AS a, CAST({avg_rank('ret', 'cohort')} AS DOUBLE) AS b FROM (SELECT cohort, ret, round(r, 9) AS r FROM res)),
ic AS (SELECT cohort, corr(a, b) AS ic FROM rk GROUP BY cohort HAVING count(DISTINCT r) >= 3)
SELECT count(*) AS cohorts, round(avg(ic), 6) AS mean, round(avg(ic) / (stddev_samp(ic) / sqrt(count(*))), 6) AS t FROM ic""",
)
def j12(spark, sf):
    d = cut_lineage(S.residualise(study(spark, sf), K, "sig", "ctrl", "r").withColumn("r", F.round("r", 9)))
    return S.summarise(S.cohort_ic(d, K, "r", "ret"), [], "ic").select("cohorts", *r6("mean", "t"))


@query(
    "j13_long_short_books",
    f"""WITH {_Q}, c AS (SELECT cohort, spread, exp(sum(ln(1 + spread)) OVER (ORDER BY cohort)) AS cum FROM sp), d AS (SELECT *, cum / max(cum) OVER (ORDER BY cohort) - 1 AS dd FROM c)
SELECT count(*) AS books, round(avg(spread), 6) AS mean_per_book, round(avg(spread) * 252 / 60, 6) AS annualised, round(avg(spread) / (stddev_samp(spread) / sqrt(count(*))), 6) AS t,
round(avg(CAST(spread > 0 AS INT)), 6) AS hit_rate, round(min(spread), 6) AS worst, round(max(spread), 6) AS best, round(min(dd), 6) AS max_drawdown FROM d""",
)
def j13(spark, sf):
    q = S.quantile_spread(study(spark, sf), K, "sig", "ret", "cik")
    w = Window.partitionBy(F.lit(0)).orderBy("cohort").rowsBetween(Window.unboundedPreceding, 0)  # one row per cohort
    q = q.withColumn("cum", F.product(1 + C("spread")).over(w)).withColumn("dd", C("cum") / F.max("cum").over(w) - 1)
    n = F.count(F.lit(1))
    return q.agg(
        n.alias("books"),
        F.round(F.avg("spread"), 6).alias("mean_per_book"),
        F.round(F.avg("spread") * 252 / 60, 6).alias("annualised"),
        F.round(F.avg("spread") / (F.stddev_samp("spread") / F.sqrt(n)), 6).alias("t"),
        F.round(F.avg((C("spread") > 0).cast("double")), 6).alias("hit_rate"),
        F.round(F.min("spread"), 6).alias("worst"),
        F.round(F.max("spread"), 6).alias("best"),
        F.round(F.min("dd"), 6).alias("max_drawdown"),
    )


@query(
    "j14_sample_comparison",
    f"""WITH sl AS (SELECT 'all' AS slice, study.* FROM study UNION ALL SELECT 'large', study.* FROM study WHERE size > 900000 UNION ALL SELECT 'even', study.* FROM study WHERE cik % 2 = 0), {_IC_BY}
SELECT slice, count(*) AS cohorts, round(avg(ic), 6) AS mean, round(avg(CAST(ic > 0 AS INT)), 6) AS positive_share FROM ics GROUP BY slice""",
)
def j14(spark, sf):
    d = study(spark, sf)
    labels = F.array_compact(
        F.array(F.lit("all"), F.when(C("size") > 900000, "large"), F.when(C("cik") % 2 == 0, "even"))
    )
    ic = S.cohort_ic(d.withColumn("slice", F.explode(labels)), ["slice", "cohort"], "sig", "ret")
    return S.summarise(ic, ["slice"], "ic").select("slice", "cohorts", *r6("mean", "positive_share"))


@query(
    "j15_spearman_pooled",
    f"""WITH r AS (SELECT CAST(rank() OVER (ORDER BY sig) + (count(*) OVER (PARTITION BY sig) - 1) / 2.0 AS DOUBLE) AS a, CAST(rank() OVER (ORDER BY ret) + (count(*) OVER (PARTITION BY ret) - 1) / 2.0 AS DOUBLE) AS b,
 CAST(rank() OVER (ORDER BY ctrl) + (count(*) OVER (PARTITION BY ctrl) - 1) / 2.0 AS DOUBLE) AS c FROM study),
k AS (SELECT count(*) AS n, corr(a, b) AS ab, corr(a, c) AS ac, corr(b, c) AS bc FROM r)
SELECT n, round(ab, 6) AS rho, round((ab - ac * bc) / sqrt((1 - ac * ac) * (1 - bc * bc)), 6) AS rho_partial FROM k""",
)
def j15(spark, sf):
    d = study(spark, sf)
    for c, o in (("sig", "a"), ("ret", "b"), ("ctrl", "c")):
        d = R.average_rank(d, [], c, o)
    k = d.agg(
        F.count(F.lit(1)).alias("n"), F.corr("a", "b").alias("ab"), F.corr("a", "c").alias("ac"), F.corr("b", "c").alias("bc")
    )
    part = (C("ab") - C("ac") * C("bc")) / F.sqrt((1 - C("ac") * C("ac")) * (1 - C("bc") * C("bc")))
    return k.select("n", F.round("ab", 6).alias("rho"), F.round(part, 6).alias("rho_partial"))


@query(
    "j24_p_values",
    f"""WITH {_RK}, s AS (SELECT count(ic) AS cohorts, avg(ic) AS mean, avg(ic) / (stddev_samp(ic) / sqrt(count(ic))) AS t FROM ic),
a AS (SELECT *, cohorts - 1 AS n, atan(abs(t) / sqrt(cohorts - 1)) AS a FROM s),
f AS (SELECT k, CASE WHEN k = 0 THEN 0 WHEN n % 2 = 0 THEN ln((2 * k - 1) / (2 * k)) ELSE ln(2 * k / (2 * k + 1)) END + CASE WHEN k > 0 THEN 2 * ln(cos(a)) ELSE 0 END AS l
  FROM a, (SELECT CAST(unnest(range(0, 500)) AS DOUBLE) AS k) WHERE k < CASE WHEN n % 2 = 0 THEN n / 2 ELSE (n - 1) / 2 END),
z AS (SELECT coalesce(sum(e), 0) AS z FROM (SELECT exp(sum(l) OVER (ORDER BY k)) AS e FROM f))
SELECT cohorts, round(mean, 6) AS mean, round(t, 6) AS t, round(1 - CASE WHEN n % 2 = 0 THEN sin(a) * z ELSE 2 / pi() * (a + sin(a) * cos(a) * z) END, 6) AS p_value FROM a CROSS JOIN z""",
)
def j24(spark, sf):
    ic = S.summarise(S.cohort_ic(study(spark, sf), K, "sig", "ret"), [], "ic")
    p = S.p_value(C("t"), (C("cohorts") - 1).cast("double"))
    return ic.select("cohorts", *r6("mean", "t"), F.round(p, 6).alias("p_value"))


@query(
    "b25_winsorize",
    """WITH e AS (SELECT quantile_cont(ctrl, 0.01) AS lo, quantile_cont(ctrl, 0.99) AS hi FROM study)
SELECT cik, cohort, round(least(greatest(ctrl, lo), hi), 6) AS ctrl FROM study CROSS JOIN e""",
)
def b25(spark, sf):
    return winsorize(study(spark, sf), "ctrl").select("cik", "cohort", *r6("ctrl"))


def winsorize(d, value, low=0.01, high=0.99):
    """Clips to the exact percentiles of the whole column."""
    e = R.percentiles(d, [], value, {"lo": low, "hi": high}).select(F.struct("lo", "hi"))
    return d.withColumn("_e", e.scalar()).withColumn(
        value, F.least(F.greatest(C(value), C("_e.lo")), C("_e.hi"))
    ).drop("_e")


# ---------------------------------------------------------------- leads and lags
_YOY = """yy AS (SELECT a.cik, a.qn, round(a.rev / b.rev - 1, 6) AS yoy FROM fq_rev a JOIN fq_rev b ON a.cik = b.cik AND a.qn = b.qn + 4),
nat AS (SELECT CAST(s_nationkey AS INT) AS target, qn, round(sum(rev), 4) AS rev FROM fq_rev JOIN supplier ON s_suppkey = cik GROUP BY 1, 2),
ty AS (SELECT a.target, a.qn, round(a.rev / b.rev - 1, 6) AS yoy FROM nat a JOIN nat b ON a.target = b.target AND a.qn = b.qn + 4)"""


def growth(spark, sf):
    d = V.fq_rev(spark, sf).withColumn("yoy", F.round(W.yoy(C("rev"), ["cik"], "qn"), 6))
    return d.where(C("yoy").isNotNull()).select("cik", "qn", "yoy")


def nation_growth(spark, sf):
    s = V.table(spark, sf, "supplier").select(C("s_suppkey").cast("int").alias("cik"), C("s_nationkey").cast("int").alias("target"))
    d = V.fq_rev(spark, sf).join(s, "cik").groupBy("target", "qn").agg(F.round(F.sum("rev"), 4).alias("rev"))
    d = d.withColumn("t_yoy", F.round(W.yoy(C("rev"), ["target"], "qn"), 6))
    return d.where(C("t_yoy").isNotNull()).select("target", "qn", "t_yoy")


def series_vectors(spark, sf):
    return L.vectors(growth(spark, sf), "cik", "qn", "yoy", "x").join(_own(spark, sf), "cik")


def nation_pairs(spark, sf):
    t = L.vectors(nation_growth(spark, sf), "target", "qn", "t_yoy", "y")
    return L.lagged_pairs(series_vectors(spark, sf), t, (0, 1, 2), 20, C("target") != C("own"))


_PAIRS = f"""{_YOY},
pr AS (SELECT s.cik, CAST(su.s_nationkey AS INT) AS own, t.target, l.lag, s.yoy AS x, t.yoy AS y FROM yy s JOIN supplier su ON su.s_suppkey = s.cik CROSS JOIN (SELECT CAST(unnest([0, 1, 2]) AS INT) AS lag) l
  JOIN {{ty}} t ON t.qn = s.qn + l.lag WHERE t.target <> su.s_nationkey),
prk AS (SELECT cik, target, lag, CAST({avg_rank('x', 'cik, target, lag')} AS DOUBLE) AS a, CAST({avg_rank('y', 'cik, target, lag')} AS DOUBLE) AS b FROM pr),
rho AS (SELECT cik, target, lag, count(*) AS n, corr(a, b) AS rho FROM prk GROUP BY 1, 2, 3 HAVING count(*) >= 20)"""


def _own(spark, sf):
    return V.table(spark, sf, "supplier").select(
        C("s_suppkey").cast("int").alias("cik"), C("s_nationkey").cast("int").alias("own")
    )


@query(
    "c17_series_target_cross",
    f"WITH {_PAIRS.replace('{ty}', 'ty')} SELECT cik, target, lag, n, round(rho, 6) AS rho FROM rho",
)
def c17(spark, sf):
    d = nation_pairs(spark, sf).select("cik", "target", F.inline("lags")).where(C("n") >= 20)
    return d.select("cik", "target", "lag", "n", *r6("rho"))


@query(
    "j16_lag_correlations",
    f"""WITH {_PAIRS.replace('{ty}', 'ty')}, pv AS (SELECT cik, target, max(rho) FILTER (WHERE lag = 0) AS l0, max(rho) FILTER (WHERE lag = 1) AS l1, max(rho) FILTER (WHERE lag = 2) AS l2 FROM rho GROUP BY 1, 2)
SELECT cik, target, round(l0, 6) AS rho_lag0, round(l1, 6) AS rho_lag1, round(l2, 6) AS rho_lag2, round(greatest(l1, l2) - l0, 6) AS lead_gain FROM pv WHERE l0 IS NOT NULL AND l1 IS NOT NULL AND l2 IS NOT NULL""",
)
def j16(spark, sf):
    return L.lead_gain(nation_pairs(spark, sf)).select("cik", "target", *r6("rho_lag0", "rho_lag1", "rho_lag2", "lead_gain"))


SHIFTS = (5, 7, 9, 11, 13)


_SHIFT = """sh0 AS (SELECT target, qn, yoy, row_number() OVER (PARTITION BY target ORDER BY qn) - 1 AS i, count(*) OVER (PARTITION BY target) AS n FROM ty),
sh AS (SELECT a.target, a.qn, s.shift, b.yoy FROM sh0 a CROSS JOIN (SELECT CAST(unnest([5, 7, 9, 11, 13]) AS INT) AS shift) s JOIN sh0 b ON a.target = b.target AND (b.i + s.shift) % b.n = a.i)"""


@query("e37_circular_shift", f"WITH {_YOY}, {_SHIFT} SELECT target, qn, shift, yoy AS t_yoy FROM sh")
def e37(spark, sf):
    return L.shifted(nation_growth(spark, sf), SHIFTS).select("target", "qn", "shift", "t_yoy")


@query(
    "j17_circular_placebo",
    f"""WITH {_YOY}, {_SHIFT},
pr AS (SELECT s.cik, t.target, t.shift, l.lag, s.yoy AS x, t.yoy AS y FROM yy s JOIN supplier su ON su.s_suppkey = s.cik CROSS JOIN (SELECT CAST(unnest([0, 1, 2]) AS INT) AS lag) l JOIN sh t ON t.qn = s.qn + l.lag WHERE t.target <> su.s_nationkey),
prk AS (SELECT cik, target, shift, lag, CAST({avg_rank('x', 'cik, target, shift, lag')} AS DOUBLE) AS a, CAST({avg_rank('y', 'cik, target, shift, lag')} AS DOUBLE) AS b FROM pr),
rho AS (SELECT cik, target, shift, lag, corr(a, b) AS rho FROM prk GROUP BY 1, 2, 3, 4 HAVING count(*) >= 20),
pv AS (SELECT cik, target, shift, max(rho) FILTER (WHERE lag = 0) AS l0, max(rho) FILTER (WHERE lag = 1) AS l1, max(rho) FILTER (WHERE lag = 2) AS l2 FROM rho GROUP BY 1, 2, 3),
lg AS (SELECT shift, round(greatest(l1, l2) - l0, 9) AS g FROM pv WHERE l0 IS NOT NULL AND l1 IS NOT NULL AND l2 IS NOT NULL)
SELECT shift, count(*) AS pairs, round(avg(CAST(g > 0.15 AS INT)), 6) AS beyond, round(quantile_cont(g, 0.95), 6) AS p95 FROM lg GROUP BY shift""",
)
def j17(spark, sf):
    t = L.shifted(nation_growth(spark, sf), SHIFTS).withColumn("target", F.struct("target", "shift"))
    t = L.vectors(t, "target", "qn", "t_yoy", "y")
    d = L.lagged_pairs(series_vectors(spark, sf), t, (0, 1, 2), 20, C("target.target") != C("own"))
    g = L.lead_gain(d).select(C("target.shift").alias("shift"), F.round("lead_gain", 9).alias("g"))
    g = cut_lineage(g.groupBy("shift", "g").agg(F.count(F.lit(1)).alias("k")))  # equal gains once
    beyond = F.sum(F.when(C("g") > 0.15, C("k")).otherwise(0)) / F.sum("k")
    m = g.groupBy("shift").agg(F.sum("k").alias("pairs"), beyond.alias("beyond"))
    p = R.percentiles(g, ["shift"], "g", {"p95": 0.95}, "k").drop("n")
    return m.join(p, "shift").select("shift", "pairs", *r6("beyond", "p95"))


def others_median(d, entity, period, value, least):
    """Per row the median of all the other entities' values in the period, from positions near the middle only."""
    d = R.position(d, [period], value, entity, "pos")
    n = d.groupBy(period).agg(F.count(F.lit(1)).alias("n"))
    lo = F.floor(C("n") / 2)
    mid = (
        d.join(n, period)
        .where(C("pos").between(lo, lo + 2))
        .groupBy(period)
        .agg(
            F.max("n").alias("n"),
            *[F.max(F.when(C("pos") == lo + i, C(value))).alias(f"v{i}") for i in range(3)],
        )
    )
    m = C("n") - 1  # the others
    a, b = F.floor((m + 1) / 2), F.floor((m + 2) / 2)

    def at(k):
        """Value at place k of the others: one place further once this row's own place is passed."""
        spot = F.when(k < C("pos"), k).otherwise(k + 1) - lo
        return F.when(spot == 0, C("v0")).when(spot == 1, C("v1")).otherwise(C("v2"))

    x = d.join(mid, period).where(m >= least)
    return x.withColumn("others", (at(a) + at(b)) / 2).withColumn("peers", m.cast("long")).drop("pos", "n", "v0", "v1", "v2")


@query(
    "c18_leave_one_out_join",
    f"WITH {_YOY} SELECT a.cik, a.qn, round(median(b.yoy), 6) AS others, count(*) AS peers FROM yy a JOIN yy b ON a.qn = b.qn AND a.cik <> b.cik GROUP BY 1, 2 HAVING count(*) >= 8",
)
def c18(spark, sf):
    d = others_median(cut_lineage(growth(spark, sf)), "cik", "qn", "yoy", 8)
    return d.select("cik", "qn", *r6("others"), "peers")


_PROFILE = f"""{_YOY}, oth AS (SELECT a.cik, a.qn, median(b.yoy) AS cyc FROM yy a JOIN yy b ON a.qn = b.qn AND a.cik <> b.cik GROUP BY 1, 2 HAVING count(*) >= 8),
lp AS (SELECT o.cik, l.k, o.cyc AS x, s.yoy AS y FROM oth o CROSS JOIN (SELECT CAST(unnest([-3,-2,-1,0,1,2,3]) AS INT) AS k) l JOIN yy s ON s.cik = o.cik AND s.qn = o.qn + l.k),
lr AS (SELECT cik, k, CAST({avg_rank('x', 'cik, k')} AS DOUBLE) AS a, CAST({avg_rank('y', 'cik, k')} AS DOUBLE) AS b FROM lp),
prof AS (SELECT cik, k, count(*) AS n, round(corr(a, b), 9) AS rho FROM lr GROUP BY 1, 2 HAVING count(*) >= 18)"""


def lag_profile(spark, sf):
    g = cut_lineage(growth(spark, sf))
    cyc = others_median(g, "cik", "qn", "yoy", 8).select("cik", "qn", C("others").alias("cyc"))
    d = cyc.withColumn("k", F.explode(F.sequence(F.lit(-3), F.lit(3)))).withColumn("qn", C("qn") + C("k")).join(g, ["cik", "qn"])
    k = ["cik", "k"]
    d = d.withColumn("a", S.rank_in(C("cyc"), k)).withColumn("b", S.rank_in(C("yoy"), k))
    p = d.groupBy(*k).agg(F.count(F.lit(1)).alias("n"), F.round(S.safe_corr("a", "b"), 9).alias("rho"))
    return p.where(C("n") >= 18)


@query("c19_lag_profile_join", f"WITH {_PROFILE} SELECT cik, k, n, round(rho, 6) AS rho FROM prof")
def c19(spark, sf):
    return lag_profile(spark, sf).select("cik", "k", "n", *r6("rho"))


@query(
    "j16_cycle_position",
    f"WITH {_PROFILE}, b AS (SELECT *, row_number() OVER (PARTITION BY cik ORDER BY rho DESC, k) AS j FROM prof) SELECT cik, -k AS leads_q, round(rho, 6) AS peak_rho FROM b WHERE j = 1",
)
def k18_cycle(spark, sf):
    p = lag_profile(spark, sf).groupBy("cik").agg(F.max(F.struct("rho", (-C("k")).alias("k"))).alias("m"))
    return p.select("cik", C("m.k").alias("leads_q"), F.round("m.rho", 6).alias("peak_rho"))
