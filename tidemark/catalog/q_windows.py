"""Per-series window queries on quarterly and daily series."""

from pyspark.sql import Window, functions as F

from tidemark.catalog import views as V
from tidemark.catalog.registry import query
from tidemark.functions.dates import quarter_end
from tidemark.operators import ranks as R, windows as W

C = F.col
K = ["cik"]


def r6(c, name):
    return F.round(c, 6).alias(name)


@query(
    "e01_gap_guarded_diff",
    """SELECT cik, qn, round(CASE WHEN qn - lag(qn) OVER w = 1 THEN rev - lag(rev) OVER w END, 4) AS d_rev
FROM fq_gap WINDOW w AS (PARTITION BY cik ORDER BY qn)""",
)
def e01(spark, sf):
    return V.fq_gap(spark, sf).select(
        "cik", "qn", F.round(W.gap_guarded_diff(C("rev"), K, "qn"), 4).alias("d_rev")
    )


@query(
    "e02_yoy_ratio",
    """SELECT a.cik, a.qn, round(a.rev / b.rev - 1, 6) AS yoy
FROM fq_gap a LEFT JOIN fq_gap b ON a.cik = b.cik AND a.qn = b.qn + 4""",
)
def e02(spark, sf):
    return V.fq_gap(spark, sf).select("cik", "qn", r6(W.yoy(C("rev"), K, "qn"), "yoy"))


_ACCEL = """y AS (
  SELECT a.cik, a.qn, a.rev, a.rev / b.rev - 1 AS yoy
  FROM fq_gap a LEFT JOIN fq_gap b ON a.cik = b.cik AND a.qn = b.qn + 4),
acc AS (SELECT y.*, y.yoy - p.yoy AS accel FROM y LEFT JOIN y p ON y.cik = p.cik AND y.qn = p.qn + 1)"""


def _accel(spark, sf):
    d = V.fq_gap(spark, sf).withColumn("yoy", W.yoy(C("rev"), K, "qn"))
    return d.withColumn("accel", W.gap_guarded_diff(C("yoy"), K, "qn"))


@query("e03_acceleration", f"WITH {_ACCEL} SELECT cik, qn, round(accel, 6) AS accel FROM acc")
def e03(spark, sf):
    return _accel(spark, sf).select("cik", "qn", r6(C("accel"), "accel"))


_FILLED = """span AS (SELECT cik, min(qn) AS a, max(qn) AS b FROM fq_gap GROUP BY cik),
grid AS (SELECT cik, CAST(unnest(generate_series(a, b)) AS INT) AS qn FROM span),
filled AS (SELECT g.cik, g.qn, f.rev FROM grid g LEFT JOIN fq_gap f USING (cik, qn)),
m AS (SELECT cik, qn, rev, rev / lag(rev, 4) OVER w - 1 AS yoy, rev / lag(rev, 1) OVER w - 1 AS qoq,
             rev / lag(rev, 3) OVER w - 1 AS qoq_3q
      FROM filled WINDOW w AS (PARTITION BY cik ORDER BY qn)),
m2 AS (SELECT m.*, yoy - lag(yoy) OVER (PARTITION BY cik ORDER BY qn) AS accel FROM m),
isl AS (SELECT m2.*, sum(CASE WHEN accel > 0 THEN 0 ELSE 1 END)
               OVER (PARTITION BY cik ORDER BY qn ROWS UNBOUNDED PRECEDING) AS g FROM m2),
st AS (SELECT isl.*, CAST(sum(CASE WHEN accel > 0 THEN 1 ELSE 0 END)
              OVER (PARTITION BY cik, g ORDER BY qn ROWS UNBOUNDED PRECEDING) AS INT) AS streak FROM isl)"""


def filled_metrics(df, keys, value="rev"):
    """Gap-filled quarterly index with yoy, acceleration, q/q, streak and growth travelled over the streak."""
    d = W.fill_periods(df, keys, "qn")
    w = W.series(keys, "qn")
    v = F.nullif(C(value), F.lit(0.0))
    d = (
        d.withColumn("yago", F.lag(v, 4).over(w))
        .withColumn("yoy", v / C("yago") - 1)
        .withColumn("qoq", v / F.lag(v, 1).over(w) - 1)
        .withColumn("qoq_3q", v / F.lag(v, 3).over(w) - 1)
        .withColumn("accel", C("yoy") - F.lag("yoy").over(w))
    )
    d = W.with_streak(d, C("accel") > 0, keys, "qn")
    ahead = F.lag("yoy").over(w)
    d = d.withColumn("_py", ahead).withColumn("_start", C("qn") - C("streak") + 1)
    run = Window.partitionBy(*keys, "_start").orderBy("qn").rowsBetween(Window.unboundedPreceding, 0)
    first_py = F.first(F.when(C("streak") == 1, C("_py")), ignorenulls=True).over(run)
    return d.withColumn("cum_accel", F.when(C("streak") > 0, C("yoy") - first_py)).drop("_py", "_start")


@query("e04_streak", f"WITH {_FILLED} SELECT cik, qn, streak FROM st")
def e04(spark, sf):
    return filled_metrics(V.fq_gap(spark, sf), K).select("cik", "qn", "streak")


@query(
    "e05_cum_over_streak",
    f"""WITH {_FILLED},
back AS (SELECT st.cik, st.qn, st.streak, st.yoy - b.yoy AS cum
         FROM st JOIN st b ON st.cik = b.cik AND b.qn = st.qn - st.streak WHERE st.streak > 0)
SELECT st.cik, st.qn, round(cum, 6) AS cum_accel FROM st LEFT JOIN back USING (cik, qn)""",
)
def e05(spark, sf):
    return filled_metrics(V.fq_gap(spark, sf), K).select("cik", "qn", r6(C("cum_accel"), "cum_accel"))


@query(
    "e06_three_q_compound",
    f"WITH {_FILLED} SELECT cik, qn, round(qoq, 6) AS qoq, round(qoq_3q, 6) AS qoq_3q FROM st",
)
def e06(spark, sf):
    return filled_metrics(V.fq_gap(spark, sf), K).select("cik", "qn", r6(C("qoq"), "qoq"), r6(C("qoq_3q"), "qoq_3q"))


@query(
    "e07_trailing_mean_min",
    """WITH q AS (SELECT cik, qn, CASE WHEN (cik + qn) % 5 = 0 THEN NULL ELSE rev END AS v FROM fq_rev)
SELECT cik, qn, round(CASE WHEN count(v) OVER w >= 3 THEN avg(v) OVER w END, 6) AS mean4
FROM q WINDOW w AS (PARTITION BY cik ORDER BY qn ROWS 3 PRECEDING)""",
)
def e07(spark, sf):
    d = V.fq_rev(spark, sf).withColumn("v", F.when((C("cik") + C("qn")) % 5 != 0, C("rev")))
    return d.select("cik", "qn", F.round(W.rolling_mean_min(C("v"), K, "qn", 4, 3), 6).alias("mean4"))


@query(
    "e08_ttm_normalised",
    """WITH q AS (SELECT cik, qn, CASE WHEN (cik + qn) % 5 = 0 THEN NULL ELSE rev END AS v FROM fq_rev)
SELECT cik, qn, round(CASE WHEN count(v) OVER w >= 3 THEN sum(v) OVER w * 4 / count(v) OVER w END, 6) AS ttm
FROM q WINDOW w AS (PARTITION BY cik ORDER BY qn ROWS 3 PRECEDING)""",
)
def e08(spark, sf):
    d = V.fq_rev(spark, sf).withColumn("v", F.when((C("cik") + C("qn")) % 5 != 0, C("rev")))
    return d.select("cik", "qn", F.round(W.annualised_sum(C("v"), K, "qn"), 6).alias("ttm"))


@query(
    "e09_prior_mean_trend",
    """WITH q AS (SELECT cik, qn, rev AS v FROM fq_rev WHERE (cik + qn) % 5 <> 0)
SELECT cik, qn, round(v - avg(v) OVER (PARTITION BY cik ORDER BY qn ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), 6) AS trend
FROM q""",
)
def e09(spark, sf):
    d = V.fq_rev(spark, sf).where((C("cik") + C("qn")) % 5 != 0)
    return d.select("cik", "qn", F.round(C("rev") - W.prior_mean(C("rev"), K, "qn"), 6).alias("trend"))


@query(
    "e10_running_nonnull",
    """SELECT r.cik, r.qn, count(rpo) OVER (PARTITION BY r.cik ORDER BY r.qn) AS rpo_quarters
FROM fq_gap r LEFT JOIN fq_bal b ON r.cik = b.cik AND r.qn = b.qn AND (b.cik + b.qn) % 3 <> 0""",
)
def e10(spark, sf):
    b = V.fq_bal(spark, sf).where((C("cik") + C("qn")) % 3 != 0)
    d = V.fq_gap(spark, sf).join(b, ["cik", "qn"], "left")
    return d.select("cik", "qn", F.count("rpo").over(W.series(K, "qn")).alias("rpo_quarters"))


@query(
    "e20_gap_fill_index",
    """WITH span AS (SELECT cik, min(qn) AS a, max(qn) AS b FROM fq_gap GROUP BY cik),
grid AS (SELECT cik, CAST(unnest(generate_series(a, b)) AS INT) AS qn FROM span)
SELECT g.cik, g.qn, f.rev FROM grid g LEFT JOIN fq_gap f USING (cik, qn)""",
)
def e20(spark, sf):
    return W.fill_periods(V.fq_gap(spark, sf), K, "qn").select("cik", "qn", "rev")


@query(
    "e30_dense_period_index",
    """SELECT cik, segment, qn, CAST(dense_rank() OVER (PARTITION BY cik ORDER BY qn) AS INT) AS fq,
CAST(row_number() OVER (PARTITION BY cik, segment ORDER BY qn) - 1 AS INT) AS pos FROM fq_seg WHERE (cik*31 + qn*17) % 11 <> 0""",
)
def e30(spark, sf):
    d = V.fq_seg(spark, sf).where((C("cik") * 31 + C("qn") * 17) % 11 != 0)
    return d.select(
        "cik",
        "segment",
        "qn",
        F.dense_rank().over(W.series(K, "qn")).alias("fq"),
        (F.row_number().over(W.series(["cik", "segment"], "qn")) - 1).alias("pos"),
    )


@query(
    "e31_next_row_if_consecutive",
    """WITH q AS (SELECT cik, qn, rev, last_day(make_date(CAST(qn // 4 AS INT), CAST(qn % 4 * 3 + 3 AS INT), 1)) AS pe FROM fq_gap)
SELECT cik, qn, CASE WHEN lead(pe) OVER w - pe BETWEEN 60 AND 130 THEN lead(rev) OVER w END AS next_rev
FROM q WINDOW w AS (PARTITION BY cik ORDER BY pe)""",
)
def e31(spark, sf):
    d = V.fq_gap(spark, sf).withColumn("pe", quarter_end(C("qn")))
    return d.select("cik", "qn", W.next_if_within(C("rev"), "pe", K, 60, 130).alias("next_rev"))


@query(
    "c03_year_ago_join",
    """SELECT a.cik, a.segment, a.qn, b.rev AS rev_yago, p.rev AS rev_prev_q FROM fq_seg a
LEFT JOIN fq_seg b ON a.cik = b.cik AND a.segment = b.segment AND a.qn = b.qn + 4
LEFT JOIN fq_seg p ON a.cik = p.cik AND a.segment = p.segment AND a.qn = p.qn + 1""",
)
def c03(spark, sf):
    k = ["cik", "segment"]
    return V.fq_seg(spark, sf).select(
        *k,
        "qn",
        W.period_offset(C("rev"), k, "qn", 4).alias("rev_yago"),
        W.period_offset(C("rev"), k, "qn", 1).alias("rev_prev_q"),
    )


# ---------------------------------------------------------------- daily prices
P = ["ticker"]
_PX2 = """p2 AS (SELECT a.ticker, a.d, a.px, b.px AS bench FROM px a JOIN px b ON a.d = b.d AND b.ticker = 0 WHERE a.ticker <> 0),
f0 AS (SELECT p2.*, ln(px) AS la, ln(bench) AS lb, ln(px) - ln(bench) AS rel,
       ln(px) - lag(ln(px)) OVER w AS ra, ln(bench) - lag(ln(bench)) OVER w AS rb
       FROM p2 WINDOW w AS (PARTITION BY ticker ORDER BY d))"""


def with_benchmark(spark, sf):
    """Prices of every ticker but the benchmark (ticker 0) beside the benchmark's price of the day."""
    p = V.px(spark, sf)
    bench = p.where(C("ticker") == 0).select("d", C("px").alias("bench"))
    d = p.where(C("ticker") != 0).join(bench, "d")
    w = W.series(P, "d")
    d = d.withColumns({"la": F.log("px"), "lb": F.log("bench"), "rel": F.log("px") - F.log("bench")})
    return d.withColumns({"ra": C("la") - F.lag("la").over(w), "rb": C("lb") - F.lag("lb").over(w)})


def day(name="d"):
    return C(name).cast("string").alias(name)


@query(
    "e11_rolling_high_drawdown",
    """SELECT ticker, CAST(d AS VARCHAR) AS d,
round(px / CASE WHEN count(px) OVER w = 252 THEN max(px) OVER w END - 1, 6) AS drawdown
FROM px WINDOW w AS (PARTITION BY ticker ORDER BY d ROWS 251 PRECEDING)""",
)
def e11(spark, sf):
    return V.px(spark, sf).select("ticker", day(), r6(W.rolling_high_drawdown(C("px"), P, "d"), "drawdown"))


@query(
    "e12_relative_ratio",
    f"""WITH {_PX2}
SELECT ticker, CAST(d AS VARCHAR) AS d, round(px / bench, 6) AS x,
round(px / bench / CASE WHEN count(px) OVER w = 252 THEN max(px / bench) OVER w END - 1, 6) AS behind
FROM f0 WINDOW w AS (PARTITION BY ticker ORDER BY d ROWS 251 PRECEDING)""",
)
def e12(spark, sf):
    d = with_benchmark(spark, sf).withColumn("x", C("px") / C("bench"))
    return d.select("ticker", day(), r6(C("x"), "x"), r6(W.rolling_high_drawdown(C("x"), P, "d"), "behind"))


_FEAT = f"""{_PX2},
f1 AS (SELECT f0.*,
  CASE WHEN count(ra) OVER w252 = 252 THEN covar_samp(ra, rb) OVER w252 / var_samp(rb) OVER w252 END AS beta,
  CASE WHEN count(ra) OVER w252 = 252 THEN stddev_samp(ra - rb) OVER w252 END AS rr_sd,
  rel - CASE WHEN count(rel) OVER w252 = 252 THEN max(rel) OVER w252 END AS ratio_dd,
  rel - lag(rel, 63) OVER w AS rel63,
  CASE WHEN count(rel) OVER w50 = 50 THEN rel > avg(rel) OVER w50 END AS above0
  FROM f0 WINDOW w AS (PARTITION BY ticker ORDER BY d),
  w252 AS (PARTITION BY ticker ORDER BY d ROWS 251 PRECEDING), w50 AS (PARTITION BY ticker ORDER BY d ROWS 49 PRECEDING)),
f2 AS (SELECT f1.*, ra - lag(beta) OVER w * rb AS res, coalesce(above0, false) AS above,
  max(CASE WHEN ratio_dd <= -0.3 THEN 1 ELSE 0 END) OVER (PARTITION BY ticker ORDER BY d ROWS 125 PRECEDING) = 1 AS armed
  FROM f1 WINDOW w AS (PARTITION BY ticker ORDER BY d)),
feat AS (SELECT f2.*, rel63 / (rr_sd * sqrt(63)) AS rel_z,
  CASE WHEN count(res) OVER w63 = 63 THEN sum(res) OVER w63 END /
    (CASE WHEN count(res) OVER w252 = 252 THEN stddev_samp(res) OVER w252 END * sqrt(63)) AS resid_z,
  armed AND above AND NOT coalesce(lag(above) OVER w, false) AS turn,
  row_number() OVER w - 1 AS pos
  FROM f2 WINDOW w AS (PARTITION BY ticker ORDER BY d),
  w63 AS (PARTITION BY ticker ORDER BY d ROWS 62 PRECEDING), w252 AS (PARTITION BY ticker ORDER BY d ROWS 251 PRECEDING))"""


def features(d, keys=P, date="d", beta_rows=252, look=63, arm_rows=126, arm_at=-0.3, trend_rows=50):
    """Relative-value inputs known at each close: rolling beta, drawdown of the ratio, two z-scores and the turn flag."""
    def back(n):
        return Window.partitionBy(*keys).orderBy(date).rowsBetween(-(n - 1), 0)

    w, wb, wl = W.series(keys, date), back(beta_rows), back(look)
    root = F.sqrt(F.lit(float(look)))
    trend = W.full_window(C("rel"), F.avg("rel"), back(trend_rows), trend_rows)
    beta = F.covar_samp("ra", "rb").over(wb) / F.nullif(F.var_samp("rb").over(wb), F.lit(0.0))
    d = d.withColumns(
        {
            "beta": F.when(F.count("ra").over(wb) == beta_rows, beta),
            "rr_sd": W.full_window(C("ra"), F.stddev_samp(C("ra") - C("rb")), wb, beta_rows),
            "ratio_dd": C("rel") - W.full_window(C("rel"), F.max("rel"), wb, beta_rows),
            "above": F.coalesce(C("rel") > trend, F.lit(False)),
            "pos": F.row_number().over(w) - 1,
            "_then": F.lag("rel", look).over(w),
        }
    )
    d = d.withColumns(
        {
            "rel_z": (C("rel") - C("_then")) / (C("rr_sd") * root),
            "res": C("ra") - F.lag("beta").over(w) * C("rb"),
            "armed": F.max(F.when(C("ratio_dd") <= arm_at, 1).otherwise(0)).over(back(arm_rows)) == 1,
        }
    )
    sd = W.full_window(C("res"), F.stddev_samp("res"), wb, beta_rows)
    d = d.withColumns(
        {
            "resid_z": W.full_window(C("res"), F.sum("res"), wl, look) / (sd * root),
            "turn": C("armed") & W.upward_cross(C("above"), keys, date),
        }
    ).drop("_then")
    return d


@query(
    "e13_rolling_beta",
    f"""WITH {_FEAT} SELECT ticker, CAST(d AS VARCHAR) AS d, round(lag(beta) OVER (PARTITION BY ticker ORDER BY d), 6) AS beta_lag FROM feat""",
)
def e13(spark, sf):
    d = features(with_benchmark(spark, sf))
    return d.select("ticker", day(), r6(F.lag("beta").over(W.series(P, "d")), "beta_lag"))


@query("e14_residual_z", f"WITH {_FEAT} SELECT ticker, CAST(d AS VARCHAR) AS d, round(resid_z, 6) AS resid_z FROM feat")
def e14(spark, sf):
    return features(with_benchmark(spark, sf)).select("ticker", day(), r6(C("resid_z"), "resid_z"))


@query("e15_vol_adj_rel", f"WITH {_FEAT} SELECT ticker, CAST(d AS VARCHAR) AS d, round(rel_z, 6) AS rel_z FROM feat")
def e15(spark, sf):
    return features(with_benchmark(spark, sf)).select("ticker", day(), r6(C("rel_z"), "rel_z"))


@query(
    "e16_armed_turn",
    f"WITH {_FEAT} SELECT ticker, CAST(d AS VARCHAR) AS d, CAST(turn AS INT) AS turn FROM feat",
)
def e16(spark, sf):
    return features(with_benchmark(spark, sf)).select("ticker", day(), C("turn").cast("int").alias("turn"))


@query(
    "e21_limited_ffill",
    """WITH cal AS (SELECT DISTINCT d FROM px), tk AS (SELECT DISTINCT ticker FROM px),
g AS (SELECT t.ticker, c.d, CASE WHEN (date_diff('day', DATE '1995-01-01', c.d) // 4 + t.ticker) % 3 <> 0 THEN p.px END AS px
      FROM tk t CROSS JOIN cal c LEFT JOIN px p ON p.ticker = t.ticker AND p.d = c.d)
SELECT ticker, CAST(d AS VARCHAR) AS d,
       last_value(px IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY d ROWS 5 PRECEDING) AS px_filled
FROM g""",
)
def e21(spark, sf):
    p = V.px(spark, sf)
    # the wide price table's grid: every calendar day carries the list of tickers, a bounded dimension
    tickers = p.agg(F.array_sort(F.collect_set("ticker")).alias("t"))
    grid = p.select("d").distinct().withColumn("ticker", F.explode(tickers.scalar()))
    hole = (F.floor(F.datediff("d", F.lit("1995-01-01").cast("date")) / 4) + C("ticker")) % 3 == 0
    d = grid.join(p, ["ticker", "d"], "left").withColumn("px", F.when(~hole, C("px")))
    return d.select("ticker", day(), W.limited_ffill(C("px"), P, "d", 5).alias("px_filled"))


@query(
    "e22_forward_window_return",
    f"""WITH {_FEAT}
SELECT ticker, CAST(d AS VARCHAR) AS d,
 round(lead(la, 64) OVER w - lead(la, 1) OVER w, 6) AS raw,
 round(lead(rel, 64) OVER w - lead(rel, 1) OVER w, 6) AS relative,
 round(lead(la, 64) OVER w - lead(la, 1) OVER w - beta * (lead(lb, 64) OVER w - lead(lb, 1) OVER w), 6) AS resid,
 round(CASE WHEN lead(rel, 64) OVER w IS NOT NULL
   THEN min(rel) OVER (PARTITION BY ticker ORDER BY d ROWS BETWEEN 1 FOLLOWING AND 64 FOLLOWING) - lead(rel, 1) OVER w END, 6) AS worst_relative
FROM feat WINDOW w AS (PARTITION BY ticker ORDER BY d)""",
)
def e22(spark, sf):
    d = forward(features(with_benchmark(spark, sf)), 63)
    return d.select("ticker", day(), *[r6(C(c), c) for c in ("raw", "relative", "resid", "worst_relative")])


def forward(d, h, keys=P, date="d"):
    """Log returns from the next close over ``h`` rows: own, less the benchmark, beta-adjusted, and the path's worst."""
    w = W.series(keys, date)

    def gain(c):
        return F.lead(c, h + 1).over(w) - F.lead(c, 1).over(w)

    path = Window.partitionBy(*keys).orderBy(date).rowsBetween(1, h + 1)
    return (
        d.withColumn("raw", gain("la"))
        .withColumn("relative", gain("rel"))
        .withColumn("resid", gain("la") - C("beta") * gain("lb"))
        .withColumn(
            "worst_relative",
            F.when(F.lead("rel", h + 1).over(w).isNotNull(), F.min("rel").over(path) - F.lead("rel", 1).over(w)),
        )
    )


@query(
    "e23_new_extreme_flag",
    """SELECT ticker, CAST(d AS VARCHAR) AS d,
CAST(coalesce(px >= CASE WHEN count(px) OVER w = 251 THEN max(px) OVER w END, false) AS INT) AS new_high,
CAST(coalesce(px <= CASE WHEN count(px) OVER w = 251 THEN min(px) OVER w END, false) AS INT) AS new_low
FROM px WINDOW w AS (PARTITION BY ticker ORDER BY d ROWS BETWEEN 251 PRECEDING AND 1 PRECEDING)""",
)
def e23(spark, sf):
    return V.px(spark, sf).select(
        "ticker",
        day(),
        W.new_extreme(C("px"), P, "d").cast("int").alias("new_high"),
        W.new_extreme(C("px"), P, "d", high=False).cast("int").alias("new_low"),
    )


@query(
    "e28_max_drawdown",
    """WITH x AS (SELECT ticker, px / max(px) OVER (PARTITION BY ticker ORDER BY d) - 1 AS dd FROM px)
SELECT ticker, round(min(dd), 6) AS max_drawdown FROM x GROUP BY ticker""",
)
def e28(spark, sf):
    d = V.px(spark, sf).withColumn("dd", C("px") / W.running_max(C("px"), P, "d") - 1)
    return d.groupBy("ticker").agg(r6(F.min("dd"), "max_drawdown"))


@query(
    "e29_twr_path",
    """WITH f AS (SELECT ticker, d, px, CASE WHEN (date_diff('day', DATE '1995-01-01', d)) % 30 = 0 THEN px * 0.25 ELSE 0 END AS flow FROM px),
g AS (SELECT ticker, d, coalesce((px - flow) / lag(px) OVER (PARTITION BY ticker ORDER BY d), 1.0) AS growth FROM f),
n AS (SELECT ticker, d, exp(sum(ln(growth)) OVER (PARTITION BY ticker ORDER BY d)) AS nav FROM g),
r AS (SELECT ticker, d, nav, nav / max(nav) OVER (PARTITION BY ticker ORDER BY d) - 1 AS dd FROM n)
SELECT ticker, CAST(d AS VARCHAR) AS d, round(ln(nav), 5) AS ln_nav, round(dd, 5) AS dd FROM r""",
)
def e29(spark, sf):
    flow = F.when(F.datediff("d", F.lit("1995-01-01").cast("date")) % 30 == 0, C("px") * 0.25).otherwise(0.0)
    d = V.px(spark, sf).withColumn("flow", flow)
    growth = F.coalesce((C("px") - C("flow")) / F.lag("px").over(W.series(P, "d")), F.lit(1.0))
    d = d.withColumn("growth", growth).withColumn("nav", W.running_product(C("growth"), P, "d"))
    d = d.withColumn("dd", C("nav") / W.running_max(C("nav"), P, "d") - 1)
    return d.select("ticker", day(), F.round(F.log("nav"), 5).alias("ln_nav"), F.round("dd", 5).alias("dd"))


@query(
    "e32_first_trading_day_of_month",
    """WITH x AS (SELECT ticker, d, lag(d) OVER (PARTITION BY ticker ORDER BY d) AS p FROM px)
SELECT ticker, CAST(d AS VARCHAR) AS d, CASE WHEN p IS NULL THEN 100000.0 ELSE 4000.0 END AS amount,
 CAST(p IS NULL OR year(d) <> year(p) AS INT) AS new_year, CAST(p IS NULL OR quarter(d) <> quarter(p) OR year(d) <> year(p) AS INT) AS new_quarter
FROM x WHERE p IS NULL OR month(d) <> month(p) OR year(d) <> year(p)""",
)
def e32(spark, sf):
    w = W.series(P, "d")
    d = V.px(spark, sf).withColumn("p", F.lag("d").over(w)).withColumn("first", W.first_of_month("d", P))
    return d.where("first").select(
        "ticker",
        day(),
        F.when(C("p").isNull(), 100000.0).otherwise(4000.0).alias("amount"),
        F.coalesce(F.year("d") != F.year("p"), F.lit(True)).cast("int").alias("new_year"),
        F.coalesce((F.quarter("d") != F.quarter("p")) | (F.year("d") != F.year("p")), F.lit(True))
        .cast("int")
        .alias("new_quarter"),
    )


@query(
    "e33_centred_median_filter",
    """WITH n AS (SELECT ticker, d, CASE WHEN row_number() OVER (PARTITION BY ticker ORDER BY d) % 40 = 0 THEN px * 10 ELSE px END AS px,
      row_number() OVER (PARTITION BY ticker ORDER BY d) AS rn FROM px),
m1 AS (SELECT a.ticker, a.d, a.px, (SELECT median(b.px) FROM n b WHERE b.ticker = a.ticker AND b.rn BETWEEN a.rn - 4 AND a.rn + 4) AS med FROM n a),
k1 AS (SELECT ticker, d, px, row_number() OVER (PARTITION BY ticker ORDER BY d) AS rn FROM m1 WHERE abs(ln(px / med)) <= ln(2.5)),
m2 AS (SELECT a.ticker, a.d, a.px, (SELECT median(b.px) FROM k1 b WHERE b.ticker = a.ticker AND b.rn BETWEEN a.rn - 4 AND a.rn + 4) AS med FROM k1 a)
SELECT ticker, CAST(d AS VARCHAR) AS d, px FROM m2 WHERE abs(ln(px / med)) <= ln(2.5)""",
)
def e33(spark, sf):
    rn = F.row_number().over(W.series(P, "d"))
    d = V.px(spark, sf).withColumn("px", F.when(rn % 40 == 0, C("px") * 10).otherwise(C("px")))
    for _ in range(2):
        d = d.withColumn("med", W.centred_median(C("px"), P, "d")).where(
            F.abs(F.log(C("px") / C("med"))) <= F.log(F.lit(2.5))
        )
    return d.select("ticker", day(), "px")


@query(
    "e36_recent_beta_window",
    f"""WITH {_PX2}, x AS (SELECT ticker, ra, rb, row_number() OVER (PARTITION BY ticker ORDER BY d DESC) AS rn FROM f0 WHERE ra IS NOT NULL)
SELECT ticker, round(covar_samp(ra, rb) / var_samp(rb), 6) AS beta, count(*) AS n FROM x WHERE rn <= 1260 GROUP BY ticker""",
)
def e36(spark, sf):
    d = with_benchmark(spark, sf).where(C("ra").isNotNull())
    w = Window.partitionBy("ticker").orderBy(F.desc("d"))
    d = d.withColumn("rn", F.row_number().over(w)).where(C("rn") <= 1260)
    return d.groupBy("ticker").agg(
        r6(F.covar_samp("ra", "rb") / F.var_samp("rb"), "beta"), F.count(F.lit(1)).alias("n")
    )


@query(
    "e42_overlay_state",
    f"""WITH {_FEAT},
s AS (SELECT ticker, d, pos, max(CASE WHEN resid_z <= -0.15 THEN pos END) OVER (PARTITION BY ticker ORDER BY d) AS lastpos FROM feat),
t AS (SELECT ticker, d, CASE WHEN pos - lastpos < 126 THEN CAST(0.75 AS DOUBLE) ELSE CAST(0.5 AS DOUBLE) END AS tgt FROM s)
SELECT ticker, CAST(d AS VARCHAR) AS d, coalesce(lag(tgt) OVER (PARTITION BY ticker ORDER BY d), CAST(0.5 AS DOUBLE)) AS weight FROM t""",
)
def e42(spark, sf):
    return overlay(features(with_benchmark(spark, sf)), C("resid_z") <= -0.15).select("ticker", day(), "weight")


def overlay(d, on, hold=126, base=0.5, over=0.75, keys=P, date="d"):
    """Overweight for ``hold`` rows after the latest signal row, tradable one row later."""
    since = C("pos") - W.latest_on(on, C("pos"), keys, date)
    d = d.withColumn("_t", F.when(since < hold, over).otherwise(base))
    return d.withColumn("weight", F.coalesce(F.lag("_t").over(W.series(keys, date)), F.lit(base))).drop("_t")


# ---------------------------------------------------------------- first and last rows
@query(
    "f01_latest_row_per_key",
    """SELECT cik, segment, qn, rev FROM fq_seg s WHERE qn = (SELECT max(qn) FROM fq_seg x WHERE x.cik = s.cik AND x.segment = s.segment)""",
)
def f01(spark, sf):
    return R.latest(V.fq_seg(spark, sf), ["cik", "segment"], ["qn"]).select("cik", "segment", "qn", "rev")
