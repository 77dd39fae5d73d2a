"""As-of and tolerance joins, guidance scoring, holdings and order sizing, set operations."""

from pyspark.sql import Window, functions as F

from tidemark.catalog import views as V
from tidemark.catalog.registry import query
from tidemark.functions.dates import quarter_end
from tidemark.operators import alloc as L, asof, ranks as R, windows as W
from tidemark.plans import guidance as G
from tidemark.session import cut_lineage

C = F.col
_QE = "CAST(last_day(make_date(CAST({q} // 4 AS INT), CAST({q} % 4 * 3 + 3 AS INT), 1)) AS DATE)"


def day(c, name=None):
    return C(c).cast("string").alias(name or c)


def r6(*cols):
    return [F.round(C(c), 6).alias(c) for c in cols]


def ints(*cols):
    return [C(c).cast("int").alias(c) for c in cols]


# ---------------------------------------------------------------- as-of
@query(
    "c05_backward_asof",
    f"""WITH s AS (SELECT cik, {_QE.format(q='qn')} + 60 AS avail, rev FROM fq_gap WHERE (cik + qn) % 4 <> 0)
SELECT r.accn, r.cik, CAST(r.filed AS VARCHAR) AS filed, CASE WHEN r.filed - m.avail <= 150 THEN m.rev END AS rev FROM releases r ASOF LEFT JOIN s m ON r.cik = m.cik AND r.filed >= m.avail""",
)
def c05(spark, sf):
    s = V.fq_gap(spark, sf).where((C("cik") + C("qn")) % 4 != 0)
    s = s.select("cik", F.date_add(quarter_end(C("qn")), 60).alias("avail"), "rev")
    m = asof.backward(V.releases(spark, sf), s, ["cik"], "filed", "avail", ["rev"])
    fresh = F.datediff("filed", "matched_avail") <= 150
    return m.select("accn", "cik", day("filed"), F.when(fresh, C("rev")).alias("rev"))


@query(
    "c06_forward_asof_next_day",
    """WITH cal AS (SELECT d, px, row_number() OVER (ORDER BY d) AS pos FROM px WHERE ticker = 0), e AS (SELECT r.accn, r.filed, c.d, c.pos, c.px FROM releases r ASOF LEFT JOIN cal c ON r.filed < c.d)
SELECT accn, CAST(e.d AS VARCHAR) AS entry_day, round(f.px / e.px - 1, 6) AS ret63 FROM e LEFT JOIN cal f ON f.pos = e.pos + 63""",
)
def c06(spark, sf):
    one = V.px(spark, sf).where(C("ticker") == 0)
    w = W.series(["ticker"], "d")  # one benchmark series: its calendar
    cal = one.withColumn("pos", F.row_number().over(w)).withColumn("fwd", F.lead("px", 63).over(w) / C("px") - 1)
    rel = V.releases(spark, sf).withColumn("ticker", F.lit(0))
    m = asof.forward(rel, cal, ["ticker"], "filed", "d", ["fwd"])
    return m.select("accn", day("matched_d", "entry_day"), F.round("fwd", 6).alias("ret63"))


_MATCH = f"""q AS (SELECT a.cik, a.qn, {_QE.format(q='a.qn')} AS qend, a.rev, a.rev / b.rev - 1 AS rev_yoy FROM fq_gap a LEFT JOIN fq_gap b ON a.cik = b.cik AND b.qn = a.qn - 4),
m AS (SELECT r.*, q.qn AS reported_q, q.rev AS reported_rev, q.rev_yoy AS reported_yoy FROM {{rel}} r JOIN q ON q.cik = r.cik AND r.filed - q.qend BETWEEN 10 AND 100 QUALIFY row_number() OVER (PARTITION BY r.cik, r.accn ORDER BY r.filed - q.qend) = 1)"""


def quarters(spark, sf):
    d = V.fq_gap(spark, sf)
    return d.withColumn("rev_yoy", W.yoy(C("rev"), ["cik"], "qn"))


@query(
    "c08_release_to_quarter",
    f"WITH {_MATCH.format(rel='releases')} SELECT accn, cik, reported_q, reported_rev FROM m",
)
def c08(spark, sf):
    return G.match_releases(V.releases(spark, sf), quarters(spark, sf)).select("accn", "cik", "reported_q", "reported_rev")


@query(
    "c09_release_match",
    f"""WITH q AS (SELECT cik, qn, {_QE.format(q='qn')} AS qend, rev FROM fq_rev),
rl AS (SELECT r.accn, r.cik, r.filed, CASE WHEN r.accn % 3 = 0 THEN q.rev * 1.003 WHEN r.accn % 3 = 1 THEN q.rev / 1000 ELSE r.guide_mid END AS printed FROM releases r LEFT JOIN q ON q.cik = r.cik AND q.qn = year(r.filed)*4 + quarter(r.filed) - 2 + CASE WHEN r.accn % 2 = 0 THEN 0 ELSE -1 END),
c AS (SELECT q.cik, q.qn, rl.filed, rl.accn, CASE WHEN abs(printed - rev) <= 0.006 * abs(rev) THEN 1 WHEN abs(printed * 1000 - rev) <= 0.006 * abs(rev) THEN 2 WHEN abs(printed / 1000 - rev) <= 0.006 * abs(rev) THEN 3 ELSE 4 END AS score FROM q JOIN rl ON rl.cik = q.cik AND rl.filed - q.qend BETWEEN 8 AND 80)
SELECT cik, qn, CAST(filed AS VARCHAR) AS release, CASE WHEN score < 4 THEN 'revenue match' ELSE 'date proximity' END AS how FROM c QUALIFY row_number() OVER (PARTITION BY cik, qn ORDER BY score, filed, accn) = 1""",
)
def c09(spark, sf):
    q = V.fq_rev(spark, sf)
    r = V.releases(spark, sf)
    r = r.withColumn("qn", F.year("filed") * 4 + F.quarter("filed") - 2 - C("accn") % 2)
    r = r.join(q, ["cik", "qn"], "left")
    text = F.when(C("accn") % 3 == 0, C("rev") * 1.003).when(C("accn") % 3 == 1, C("rev") / 1000).otherwise(C("guide_mid"))
    r = r.select("cik", "accn", "filed", text.alias("printed"))
    return release_events(q.withColumn("qend", quarter_end(C("qn"))), r).select("cik", "qn", day("filed", "release"), "how")


def release_events(q, releases):
    """The release that prints a quarter's revenue (as is, in thousands, in millions), else the first one 8-80 days on."""
    d = asof.within(q, releases, ["cik"], "qend", "filed", 8, 80)

    def close(x):
        return F.abs(x - C("rev")) <= 0.006 * F.abs("rev")

    p = C("printed")
    score = F.when(close(p), 1).when(close(p * 1000), 2).when(close(p / 1000), 3).otherwise(4)
    d = d.withColumn("score", score)
    g = d.groupBy("cik", "qn").agg(F.min(F.struct("score", "filed", "accn")).alias("_r"))
    how = F.when(C("_r.score") < 4, "revenue match").otherwise("date proximity")
    return g.select("cik", "qn", C("_r.filed").alias("filed"), how.alias("how"))


_GVA = f"""a AS (SELECT cik, {_QE.format(q='qn')} AS pe, rev AS actual FROM fq_gap),
g AS (SELECT accn, cik, filed, CASE WHEN accn % 3 = 0 THEN guide_mid * 5 END AS revenue_mid, CASE WHEN accn % 3 = 1 THEN guide_mid * 4 END AS revenue_low, CASE WHEN accn % 3 = 1 THEN guide_mid * 6 END AS revenue_high, CASE WHEN accn % 3 = 2 THEN CAST(accn % 20 - 10 AS DOUBLE) END AS revenue_qoq_pct FROM releases),
p AS (SELECT g.*, a.actual AS prior FROM g ASOF JOIN a ON g.cik = a.cik AND g.filed - 5 > a.pe),
n AS (SELECT p.*, CASE WHEN x.pe - p.filed <= 120 THEN x.actual END AS actual FROM p ASOF LEFT JOIN a x ON p.cik = x.cik AND p.filed < x.pe),
im AS (SELECT *, coalesce(revenue_mid, (revenue_low + revenue_high) / 2, prior * (1 + revenue_qoq_pct / 100)) AS mid FROM n)"""


def guides(spark, sf):
    r = V.releases(spark, sf)
    k = C("accn") % 3
    return r.select(
        "accn", "cik", "filed",
        F.when(k == 0, C("guide_mid") * 5).alias("revenue_mid"),
        F.when(k == 1, C("guide_mid") * 4).alias("revenue_low"),
        F.when(k == 1, C("guide_mid") * 6).alias("revenue_high"),
        F.when(k == 2, (C("accn") % 20 - 10).cast("double")).alias("revenue_qoq_pct"),
    )


def gva(spark, sf):
    a = V.fq_gap(spark, sf).select("cik", quarter_end(C("qn")).alias("pe"), C("rev").alias("actual"))
    return G.guidance_vs_actual(guides(spark, sf), a)


@query(
    "c10_guided_quarter_join",
    f"WITH {_GVA} SELECT accn, cik, prior, actual FROM im WHERE mid IS NOT NULL",
)
def c10(spark, sf):
    return gva(spark, sf).select("accn", "cik", "prior", "actual")


@query(
    "k15_guidance_vs_actual",
    f"""WITH {_GVA} SELECT accn, cik, round(mid, 6) AS implied_mid, round(actual / mid, 6) AS ratio, CASE WHEN actual IS NULL THEN 'no actual yet' WHEN abs(actual / mid - 1) <= 0.2 THEN 'ok' ELSE 'CHECK' END AS status,
round(mid / prior - 1, 6) AS guided_qoq, round(actual / prior - 1, 6) AS actual_qoq FROM im WHERE mid IS NOT NULL""",
)
def k15(spark, sf):
    return gva(spark, sf).select(
        "accn", "cik", F.round("implied_mid", 6).alias("implied_mid"), *r6("ratio"), "status", *r6("guided_qoq", "actual_qoq")
    )


_TM = f"""o AS (SELECT cik, {_QE.format(q='qn')} AS d, rev FROM fq_gap), x AS (SELECT cik, {_QE.format(q='qn')} + CAST((cik + qn) % 15 AS INT) AS xd, CASE WHEN qn % 3 = 0 THEN rev * 1.01 ELSE rev * 1.001 END AS v FROM fq_rev),
p AS (SELECT x.cik, x.xd, x.v, o.rev, abs(o.rev - x.v) AS gap FROM x LEFT JOIN o ON o.cik = x.cik AND abs(o.d - x.xd) <= 10)"""


@query(
    "c12_tolerance_match",
    f"""WITH {_TM} SELECT cik, CAST(xd AS VARCHAR) AS day, v, arg_min(rev, gap) AS ours, CASE WHEN count(rev) = 0 THEN 'missing in ours' WHEN bool_or(gap <= 0.005 * abs(v) + 1) THEN 'match' ELSE 'DIFF' END AS status FROM p GROUP BY cik, xd, v""",
)
def c12(spark, sf):
    o = V.fq_gap(spark, sf).select("cik", quarter_end(C("qn")).alias("d"), "rev")
    x = V.fq_rev(spark, sf)
    v = F.when(C("qn") % 3 == 0, C("rev") * 1.01).otherwise(C("rev") * 1.001)
    x = x.select("cik", F.date_add(quarter_end(C("qn")), ((C("cik") + C("qn")) % 15)).alias("xd"), v.alias("v"))
    return tolerance_match(x, o).select("cik", day("xd", "day"), "v", "ours", "status")


def tolerance_match(other, ours, days=10, rel=0.005, absolute=1.0):
    """Each outside value beside our closest value within ``days``, with the match status."""
    p = asof.within(other, ours, ["cik"], "xd", "d", -days, days)
    gap = F.abs(C("rev") - C("v"))
    g = p.groupBy("cik", "xd", "v").agg(
        F.min_by("rev", gap).alias("ours"), F.max(gap <= rel * F.abs("v") + absolute).alias("ok")
    )
    d = other.join(g, ["cik", "xd", "v"], "left")
    return d.withColumn("status", F.when(C("ok").isNull(), "missing in ours").when(C("ok"), "match").otherwise("DIFF"))


@query(
    "c13_gold_pairing",
    f"""WITH o AS (SELECT cik, qn, segment, {_QE.format(q='qn')} AS d, rev FROM fq_seg), x AS (SELECT cik, qn, segment, {_QE.format(q='qn')} + CAST((cik + qn) % 12 AS INT) AS xd, CASE WHEN (cik + qn) % 7 = 0 THEN rev + 900 ELSE rev + 0.25 END AS v FROM fq_seg)
SELECT x.segment, count(*) AS paired, round(avg(CASE WHEN abs(o.rev - x.v) <= greatest(0.0015, 0.0005 * abs(x.v)) THEN 1.0 ELSE 0.0 END), 6) AS match_rate FROM o JOIN x ON o.cik = x.cik AND o.qn = x.qn AND o.segment = x.segment AND abs(o.d - x.xd) <= 7 GROUP BY 1""",
)
def c13(spark, sf):
    s = V.fq_seg(spark, sf)
    o = s.select("cik", "qn", "segment", quarter_end(C("qn")).alias("d"), "rev")
    v = F.when((C("cik") + C("qn")) % 7 == 0, C("rev") + 900).otherwise(C("rev") + 0.25)
    x = s.select("cik", "qn", "segment", F.date_add(quarter_end(C("qn")), (C("cik") + C("qn")) % 12).alias("xd"), v.alias("v"))
    m = o.join(x, ["cik", "qn", "segment"]).where(F.abs(F.datediff("d", "xd")) <= 7)
    ok = F.abs(C("rev") - C("v")) <= F.greatest(F.lit(0.0015), 0.0005 * F.abs("v"))
    return m.groupBy("segment").agg(
        F.count(F.lit(1)).alias("paired"), F.round(F.avg(ok.cast("double")), 6).alias("match_rate")
    )


# ---------------------------------------------------------------- beat and raise
_REL = """(SELECT r.accn, r.cik, r.filed, CASE accn % 5 WHEN 0 THEN 'full_year' WHEN 1 THEN NULL ELSE 'quarter' END AS guide_period,
 CASE WHEN accn % 5 IN (0, 2) THEN guide_mid * CASE WHEN accn % 5 = 0 THEN 24 ELSE 6 END END AS revenue_mid, CASE WHEN accn % 5 = 1 THEN guide_mid * 5 END AS revenue_low, CASE WHEN accn % 5 = 1 THEN guide_mid * 7 END AS revenue_high,
 CASE WHEN accn % 5 = 3 THEN CAST(accn % 37 - 10 AS DOUBLE) END AS growth_mid_pct, CASE WHEN accn % 5 = 4 THEN CAST(accn % 31 - 8 AS DOUBLE) END AS growth_low_pct, CASE WHEN accn % 5 = 4 THEN CAST(accn % 31 + 2 AS DOUBLE) END AS growth_high_pct,
 CASE WHEN accn % 4 = 0 THEN guide_mid * 22 END AS fy_revenue_low, CASE WHEN accn % 4 = 0 THEN guide_mid * 26 END AS fy_revenue_high FROM releases r)"""

_BR = f"""{_MATCH.format(rel=_REL)},
m2 AS (SELECT *, reported_q + 1 AS guided_q, reported_q // 4 AS fy, CASE WHEN guide_period IS DISTINCT FROM 'full_year' THEN coalesce(revenue_mid, (revenue_low + revenue_high) / 2) END AS q_guide_mid,
  CASE WHEN guide_period IS DISTINCT FROM 'full_year' THEN coalesce(growth_mid_pct, (growth_low_pct + growth_high_pct) / 2) END AS q_growth_mid,
  coalesce((fy_revenue_low + fy_revenue_high) / 2, CASE WHEN guide_period = 'full_year' THEN coalesce(revenue_mid, (revenue_low + revenue_high) / 2) END) AS fy_guide_mid FROM m),
gs AS (SELECT * FROM m2 QUALIFY row_number() OVER (PARTITION BY cik, guided_q ORDER BY filed DESC, accn DESC) = 1),
a0 AS (SELECT m2.*, g.q_guide_mid AS gq, g.q_growth_mid AS gg, g.fy_guide_mid AS pfg, g.fy AS pfy, g.accn AS guide_accn, y.rev AS ry, y2.rev AS gy FROM m2 LEFT JOIN gs g ON g.cik = m2.cik AND g.guided_q = m2.reported_q
  LEFT JOIN fq_gap y ON y.cik = m2.cik AND y.qn = m2.reported_q - 4 LEFT JOIN fq_gap y2 ON y2.cik = m2.cik AND y2.qn = m2.guided_q - 4),
a1 AS (SELECT *, coalesce(gq, ry * (1 + gg / 100)) AS raw, ry * (1 + gg / 100) AS conv FROM a0),
a2 AS (SELECT *, raw IS NOT NULL AND NOT coalesce(raw / reported_rev BETWEEN 1/1.30 AND 1/0.80, false) AS rejected FROM a1),
a3 AS (SELECT *, CASE WHEN NOT rejected THEN raw END AS gmid, CASE WHEN rejected THEN 'rejected: implausible vs reported revenue' WHEN gq IS NOT NULL THEN 'dollar guide' WHEN conv IS NOT NULL THEN 'growth guide converted to dollars' ELSE 'none' END AS guide_kind,
  CASE WHEN fy = pfy THEN fy_guide_mid > pfg END AS raise_fy, CASE WHEN q_growth_mid IS NOT NULL THEN q_growth_mid / 100 ELSE q_guide_mid / gy - 1 END AS gyoy0 FROM a2),
a4 AS (SELECT *, CASE WHEN (q_guide_mid IS NULL OR q_guide_mid / reported_rev BETWEEN 0.6 AND 1.8) AND abs(gyoy0) <= 2 THEN gyoy0 END AS guided_yoy FROM a3),
a5 AS (SELECT *, reported_rev > gmid AS beat, reported_rev / gmid - 1 AS beat_pct, guided_yoy > reported_yoy AS raise_accel FROM a4),
br AS (SELECT *, coalesce(raise_fy, raise_accel) AS raised, CASE WHEN raise_fy IS NOT NULL THEN 'full-year guide raised vs prior full-year guide' WHEN raise_accel IS NOT NULL THEN 'next-quarter guide implies faster y/y than reported' ELSE 'no raise test available' END AS raise_basis,
  CASE WHEN beat IS NOT NULL AND coalesce(raise_fy, raise_accel) IS NOT NULL THEN beat AND coalesce(raise_fy, raise_accel) END AS beat_and_raise FROM a5)"""


def guided_releases(spark, sf):
    r = V.releases(spark, sf)
    k, g = C("accn") % 5, C("guide_mid")
    null = F.lit(None).cast("double")
    return r.select(
        "accn", "cik", "filed",
        F.when(k == 0, "full_year").when(k == 1, F.lit(None)).otherwise("quarter").alias("guide_period"),
        F.when(k == 0, g * 24).when(k == 2, g * 6).alias("revenue_mid"),
        F.when(k == 1, g * 5).alias("revenue_low"),
        F.when(k == 1, g * 7).alias("revenue_high"),
        F.when(k == 3, (C("accn") % 37 - 10).cast("double")).alias("growth_mid_pct"),
        F.when(k == 4, (C("accn") % 31 - 8).cast("double")).alias("growth_low_pct"),
        F.when(k == 4, (C("accn") % 31 + 2).cast("double")).alias("growth_high_pct"),
        null.alias("fy_revenue_mid"),
        F.when(C("accn") % 4 == 0, g * 22).alias("fy_revenue_low"),
        F.when(C("accn") % 4 == 0, g * 26).alias("fy_revenue_high"),
    )


def scored(spark, sf):
    return G.score_quarters(guided_releases(spark, sf), quarters(spark, sf))


@query(
    "k05_beat_and_raise",
    f"""WITH {_BR} SELECT accn, cik, reported_q, round(gmid, 4) AS guide_mid, guide_kind, CAST(beat AS INT) AS beat, round(beat_pct, 6) AS beat_pct, CAST(raised AS INT) AS raised, raise_basis, CAST(beat_and_raise AS INT) AS beat_and_raise FROM br""",
)
def k05(spark, sf):
    return scored(spark, sf).select(
        "accn", "cik", "reported_q", F.round("guide_mid", 4).alias("guide_mid"), "guide_kind", *ints("beat"), *r6("beat_pct"),
        *ints("raised"), "raise_basis", *ints("beat_and_raise"),
    )


@query("c25_guide_carry_join", f"WITH {_BR} SELECT accn, cik, reported_q, guide_accn, gq AS guide FROM a0")
def c25(spark, sf):
    return scored(spark, sf).select("accn", "cik", "reported_q", "guide_accn", C("guide_for_this_q").alias("guide"))


@query(
    "b22_guide_plausibility",
    f"WITH {_BR} SELECT guide_kind, count(*) AS n, count(*) FILTER (WHERE rejected) AS rejected FROM br GROUP BY 1",
)
def b22(spark, sf):
    return scored(spark, sf).groupBy("guide_kind").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("guide_rejected").alias("rejected")
    )


@query(
    "b24_leg_tristate",
    f"WITH {_BR} SELECT CAST(beat AS INT) AS beat, CAST(raised AS INT) AS raised, raise_basis, count(*) AS n FROM br GROUP BY 1, 2, 3",
)
def b24(spark, sf):
    return scored(spark, sf).groupBy(*ints("beat", "raised"), "raise_basis").agg(F.count(F.lit(1)).alias("n"))


_BF = f"""{_BR}, s AS (SELECT * FROM br WHERE beat_and_raise IS NOT NULL QUALIFY row_number() OVER (PARTITION BY cik, reported_q ORDER BY accn DESC) = 1),
s2 AS (SELECT *, sum(CASE WHEN beat_and_raise THEN 0 ELSE 1 END) OVER (PARTITION BY cik ORDER BY reported_q) AS g, coalesce(reported_q - lag(reported_q) OVER w = 1 AND beat_and_raise AND lag(beat_and_raise) OVER w, false) AS two,
   count(*) OVER (PARTITION BY cik) AS n FROM s WINDOW w AS (PARTITION BY cik ORDER BY reported_q)),
s3 AS (SELECT *, CAST(sum(CASE WHEN beat_and_raise THEN 1 ELSE 0 END) OVER (PARTITION BY cik, g ORDER BY reported_q) AS INT) AS streak FROM s2),
fl AS (SELECT * FROM s3 QUALIFY row_number() OVER (PARTITION BY cik ORDER BY reported_q DESC) = 1)"""


@query(
    "k06_br_flag",
    f"WITH {_BF} SELECT cik, reported_q AS latest_scored_q, n AS scored_quarters, streak AS br_streak, CAST(two AS INT) AS two_consecutive, CAST(beat AS INT) AS last_beat, round(beat_pct, 6) AS last_beat_pct, raise_basis AS last_raise_basis FROM fl",
)
def k06(spark, sf):
    return G.flag(scored(spark, sf)).select(
        "cik", "latest_scored_q", "scored_quarters", "br_streak", *ints("two_consecutive", "last_beat"), *r6("last_beat_pct"), "last_raise_basis"
    )


@query(
    "b23_raise_label",
    f"WITH {_BF} SELECT cik, CASE WHEN raise_basis LIKE 'full-year%' THEN 'strong (full-year guide raised)' ELSE 'weak (guides acceleration, not a raised guide)' END AS raise_strength, CAST(two OR streak >= 2 AS INT) AS flag FROM fl",
)
def b23(spark, sf):
    return G.strength(G.flag(scored(spark, sf))).select("cik", "raise_strength", *ints("flag"))


# ---------------------------------------------------------------- holdings and orders
SLEEVES = ("INDEX", "CHIPS")

_HOLD = """hr AS (SELECT CAST(o_custkey % 50 AS INT) AS account, CASE o_custkey % 5 WHEN 0 THEN 'INDEX' WHEN 1 THEN 'CHIPS' WHEN 2 THEN 'PICKS' WHEN 3 THEN 'HEDGE' ELSE CASE WHEN o_orderkey % 2 = 0 THEN 'CASH' ELSE 'CHIPS' END END AS sleeve,
 CASE WHEN o_custkey % 5 = 3 THEN 'PSQ' ELSE 'T' || (o_orderkey % 40) END AS ticker, CAST(CASE WHEN o_custkey % 5 = 4 AND o_orderkey % 2 = 0 THEN o_orderkey % 9000 - 6000 ELSE o_orderkey % 9 + 1 END AS DOUBLE) AS shares,
 CASE WHEN o_orderkey % 7 = 0 THEN o_totalprice / 100 END AS price, o_custkey % 5 = 4 AND o_orderkey % 2 = 0 AS is_cash FROM orders),
lv AS (SELECT 'T' || (p_partkey % 40) AS ticker, max(p_retailprice) AS live FROM part WHERE p_partkey % 40 <> 39 GROUP BY 1),
h AS (SELECT hr.account, hr.sleeve, hr.ticker, hr.shares, hr.is_cash, CASE WHEN is_cash THEN 1.0 ELSE coalesce(price, live) END AS price, hr.shares * CASE WHEN is_cash THEN 1.0 ELSE coalesce(price, live) END AS value FROM hr LEFT JOIN lv USING (ticker)),
ac AS (SELECT account, coalesce(sum(value) FILTER (WHERE NOT is_cash AND sleeve = 'INDEX' AND ticker <> 'PSQ'), 0) AS v_index, coalesce(sum(value) FILTER (WHERE NOT is_cash AND sleeve = 'CHIPS' AND ticker <> 'PSQ'), 0) AS v_chips,
  coalesce(sum(value) FILTER (WHERE NOT is_cash AND sleeve = 'PICKS' AND ticker <> 'PSQ'), 0) AS picks, coalesce(sum(value) FILTER (WHERE NOT is_cash AND ticker = 'PSQ'), 0) AS hedge, coalesce(sum(value) FILTER (WHERE is_cash), 0) AS cash FROM h GROUP BY 1),
ac2 AS (SELECT *, v_index + v_chips + picks + hedge AS longs, greatest(0, -cash) AS loan, v_index + v_chips + picks + hedge + cash AS equity FROM ac)"""


def holdings(spark, sf):
    o = V.table(spark, sf, "orders")
    k, odd = C("o_custkey") % 5, C("o_orderkey") % 2
    cash = (k == 4) & (odd == 0)
    sleeve = (
        F.when(k == 0, " index").when(k == 1, "Chips ").when(k == 2, "picks").when(k == 3, "hedge").when(cash, "cash").otherwise("chips")
    )
    ticker = F.when(k == 3, "psq").otherwise(F.concat(F.lit(" t"), (C("o_orderkey") % 40).cast("string")))
    shares = F.when(cash, C("o_orderkey") % 9000 - 6000).otherwise(C("o_orderkey") % 9 + 1).cast("double")
    raw = o.select(
        (C("o_custkey") % 50).cast("int").alias("account"), sleeve.alias("sleeve"), ticker.alias("ticker"), shares.alias("shares"),
        F.when(C("o_orderkey") % 7 == 0, C("o_totalprice") / 100).alias("price"),
    )
    p = V.table(spark, sf, "part").where(C("p_partkey") % 40 != 39)
    live = p.groupBy(F.concat(F.lit("T"), (C("p_partkey") % 40).cast("string")).alias("ticker")).agg(F.max("p_retailprice").alias("live"))
    return L.positions(raw, live)


def r2(*cols):
    return [F.round(C(c), 2).alias(c) for c in cols]


@query(
    "a19_holdings_scan",
    f"WITH {_HOLD} SELECT account, sleeve, ticker, count(*) AS lots, round(sum(shares), 2) AS shares, round(sum(value), 4) AS value FROM h GROUP BY 1, 2, 3",
)
def a19(spark, sf):
    h = holdings(spark, sf)
    return h.groupBy("account", "sleeve", "ticker").agg(
        F.count(F.lit(1)).alias("lots"), F.round(F.sum("shares"), 2).alias("shares"), F.round(F.sum("value"), 4).alias("value")
    )


@query(
    "d29_sleeve_rollup",
    f"""WITH {_HOLD} SELECT account, round(v_index, 2) AS v_index, round(v_chips, 2) AS v_chips, round(picks, 2) AS picks, round(hedge, 2) AS hedge, round(loan, 2) AS loan, round(equity, 2) AS equity,
CASE WHEN v_chips < v_index OR (v_chips = v_index) THEN 'CHIPS' ELSE 'INDEX' END AS under FROM ac2""",
)
def d29(spark, sf):
    a = L.sleeve_rollup(holdings(spark, sf), SLEEVES)
    return a.select("account", *r2("v_index", "v_chips", "picks", "hedge", "loan", "equity"), "under")


@query(
    "b28_guard_ratios",
    f"""WITH {_HOLD}, g AS (SELECT account, coalesce(loan / nullif(longs, 0), 0) AS lr, longs - loan - 0.3 * longs AS ex, longs FROM ac2)
SELECT account, round(lr, 6) AS loan_ratio, round(coalesce(ex / nullif(longs, 0), 1), 6) AS excess_ratio, CASE WHEN lr > 0.25 THEN 'over the loan limit' WHEN coalesce(ex / nullif(longs, 0), 1) < 0.2 THEN 'excess liquidity low' END AS warning FROM g""",
)
def b28(spark, sf):
    a = L.guard(L.sleeve_rollup(holdings(spark, sf), SLEEVES))
    return a.select("account", *r6("loan_ratio", "excess_ratio"), "warning")


@query(
    "c30_target_vs_held",
    f"""WITH {_HOLD}, tg AS (SELECT 'T' || CAST(n_nationkey AS VARCHAR) AS ticker, (n_regionkey + 1) / 100.0 AS weight FROM nation),
w AS (SELECT account, ticker, weight * 0.3 * equity AS target FROM ac2 CROSS JOIN tg), hd AS (SELECT account, ticker, sum(value) AS held FROM h WHERE sleeve = 'PICKS' GROUP BY 1, 2),
j AS (SELECT coalesce(w.account, hd.account) AS account, coalesce(w.ticker, hd.ticker) AS ticker, coalesce(target, 0) AS target, coalesce(held, 0) AS held FROM w FULL JOIN hd ON w.account = hd.account AND w.ticker = hd.ticker)
SELECT account, ticker, round(target, 8) AS target, round(held, 4) AS held, CASE WHEN target = 0 THEN 'extra' WHEN held < 1 THEN 'missing' ELSE 'held' END AS status, round(greatest(0, target - held), 8) AS to_buy FROM j""",
)
def c30(spark, sf):
    h = cut_lineage(holdings(spark, sf))
    t = V.table(spark, sf, "nation").select(
        F.concat(F.lit("T"), C("n_nationkey").cast("string")).alias("ticker"), ((C("n_regionkey") + 1) / 100.0).alias("weight")
    )
    b = L.sleeve_rollup(h, SLEEVES).select("account", C("target_picks").alias("budget"))
    d = L.target_vs_held(h.where(C("sleeve") == "PICKS").select("account", "ticker", "value"), t, b)
    return d.select("account", "ticker", F.round("target", 8).alias("target"), F.round("held", 4).alias("held"), "status", F.round("to_buy", 8).alias("to_buy"))


_WANT = """wt AS (SELECT CAST(o_custkey % 50 AS INT) AS account, CAST(o_orderkey AS INT) AS id, CAST(o_orderdate AS DATE) AS d, round(o_totalprice / 1000, 0) AS cap, o_totalprice AS want, 4000000.0 AS room FROM orders)"""


def wants(spark, sf):
    return V.table(spark, sf, "orders").select(
        (C("o_custkey") % 50).cast("int").alias("account"), C("o_orderkey").cast("int").alias("id"),
        F.round(C("o_totalprice") / 1000, 0).alias("cap"), C("o_totalprice").alias("want"), F.lit(4000000.0).alias("room"),
    )


@query(
    "f06_largest_first_fill",
    f"""WITH {_WANT} SELECT account, id, round(greatest(0, least(want, room - coalesce(sum(want) OVER (PARTITION BY account ORDER BY cap DESC, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))), 2) AS filled FROM wt""",
)
def f06(spark, sf):
    return L.waterfall(wants(spark, sf), ["account"], "want", "room", "cap", "id").select("account", "id", *r2("filled"))


@query(
    "f07_prorata_fill",
    f"WITH {_WANT} SELECT account, id, round(want * least(1.0, room / sum(want) OVER (PARTITION BY account)), 4) AS filled FROM wt",
)
def f07(spark, sf):
    d = L.pro_rata(wants(spark, sf), ["account"], "want", "room")
    return d.select("account", "id", F.round("filled", 4).alias("filled"))


@query(
    "f08_cap_and_trim",
    f"""WITH {_HOLD}, nm AS (SELECT h.account, h.ticker, sum(value) AS v, max(v_chips) AS s FROM h JOIN ac2 USING (account) WHERE sleeve = 'CHIPS' AND NOT is_cash AND value IS NOT NULL GROUP BY 1, 2),
c AS (SELECT *, least(v, 0.02 * s) AS c FROM nm), t AS (SELECT *, c * least(1.0, 0.4 * s / nullif(sum(c) OVER (PARTITION BY account), 0)) AS kept FROM c) SELECT account, ticker, round(kept, 3) AS kept, round(v - kept, 3) AS sold FROM t""",
)
def f08(spark, sf):
    h = cut_lineage(holdings(spark, sf))
    s = L.sleeve_rollup(h, SLEEVES).select("account", C("v_chips").alias("s"))
    n = h.where((C("sleeve") == "CHIPS") & ~C("is_cash") & C("value").isNotNull()).groupBy("account", "ticker").agg(F.sum("value").alias("v"))
    d = L.cap_and_trim(n.join(s, "account"), ["account"], "v", "s", cap=0.02)
    return d.select("account", "ticker", F.round("kept", 3).alias("kept"), F.round("sold", 3).alias("sold"))


@query(
    "d30_net_orders",
    """WITH o AS (SELECT CAST(o_custkey % 50 AS INT) AS account, CAST(o_orderkey % 40 AS INT) AS ticker, CASE WHEN o_orderstatus = 'F' THEN -o_totalprice ELSE o_totalprice END AS amount FROM orders),
n AS (SELECT account, ticker, round(sum(amount), 2) AS amount FROM o GROUP BY 1, 2) SELECT account, ticker, amount, CASE WHEN amount < 0 THEN 'SELL' ELSE 'BUY' END AS side FROM n WHERE abs(amount) >= 1""",
)
def d30(spark, sf):
    o = V.table(spark, sf, "orders").select(
        (C("o_custkey") % 50).cast("int").alias("account"), (C("o_orderkey") % 40).cast("int").alias("ticker"),
        F.when(C("o_orderstatus") == "F", -C("o_totalprice")).otherwise(C("o_totalprice")).alias("amount"),
    )
    return L.net_orders(o, ["account", "ticker"])


_LAG = """x AS (SELECT p.ticker, p.d, p.px / b.px AS x FROM px p JOIN px b ON b.d = p.d AND b.ticker = 0 WHERE p.ticker <> 0),
y AS (SELECT ticker, d, x / CASE WHEN count(x) OVER w = 252 THEN max(x) OVER w END - 1 AS behind FROM x WINDOW w AS (PARTITION BY ticker ORDER BY d ROWS 251 PRECEDING)),
cp AS (SELECT CAST(n_regionkey AS INT) AS ticker, CAST(count(*) AS DOUBLE) AS cap FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1)"""


def lag_inputs(spark, sf):
    p = V.px(spark, sf)
    s, n = V.table(spark, sf, "supplier"), V.table(spark, sf, "nation")
    caps = s.join(n, C("s_nationkey") == C("n_nationkey")).groupBy(C("n_regionkey").cast("int").alias("ticker")).agg(
        F.count(F.lit(1)).cast("double").alias("cap")
    )
    bench = p.where(C("ticker") == 0).select("d", C("px").alias("b"))
    return p.where(C("ticker") != 0), bench, caps


@query(
    "k08_laggard_signals",
    f"WITH {_LAG} SELECT y.ticker, CAST(d AS VARCHAR) AS d, round(behind, 6) AS behind, cap FROM y JOIN cp USING (ticker) WHERE behind <= -0.1 AND cap >= 1 AND d = (SELECT max(d) FROM y z WHERE z.ticker = y.ticker)",
)
def k08(spark, sf):
    d = L.laggards(*lag_inputs(spark, sf), drop=0.1, floor=1)
    return d.select("ticker", day("d"), *r6("behind"), "cap")


_ALERT = """cal AS (SELECT d, row_number() OVER (ORDER BY d) AS pos FROM (SELECT DISTINCT d FROM px)),
sg AS (SELECT o_orderpriority AS sleeve, CAST(o_custkey AS INT) AS ticker, max(CAST(o_orderdate AS DATE)) AS d FROM orders WHERE o_orderdate >= DATE '2000-01-01' GROUP BY 1, 2),
st AS (SELECT o_orderpriority AS sleeve, CAST(o_custkey AS INT) AS ticker, max(CAST(o_orderdate AS DATE)) AS last_d FROM orders WHERE o_orderdate < DATE '2000-01-01' GROUP BY 1, 2),
fr AS (SELECT sg.sleeve, sg.ticker, sg.d, st.last_d FROM sg JOIN cal c ON c.d = sg.d LEFT JOIN st USING (sleeve, ticker) LEFT JOIN cal l ON l.d = st.last_d WHERE st.last_d IS NULL OR c.pos - l.pos >= 300)"""


def alert_inputs(spark, sf):
    o = V.table(spark, sf, "orders").select(
        C("o_orderpriority").alias("sleeve"), C("o_custkey").cast("int").alias("ticker"), C("o_orderdate").cast("date").alias("d")
    )
    split = F.lit("2000-01-01").cast("date")
    sig = o.where(C("d") >= split).groupBy("sleeve", "ticker").agg(F.max("d").alias("d"))
    st = o.where(C("d") < split).groupBy("sleeve", "ticker").agg(F.max("d").alias("last_d"))
    days = V.px(spark, sf).select("d").distinct().withColumn("one", F.lit(1))
    cal = days.withColumn("pos", F.row_number().over(W.series(["one"], "d"))).drop("one")  # one row per trading day
    return sig, st, cal


@query("k09_fresh_alerts", f"WITH {_ALERT} SELECT sleeve, ticker, CAST(d AS VARCHAR) AS d, CAST(last_d AS VARCHAR) AS last_d FROM fr WHERE sleeve IS NOT NULL")
def k09(spark, sf):
    return L.fresh_alerts(*alert_inputs(spark, sf), spacing=300).select("sleeve", "ticker", day("d"), day("last_d"))


@query(
    "k10_alert_allocation",
    f"""WITH {_ALERT}, w AS (SELECT fr.sleeve, fr.ticker, c_acctbal AS cap, greatest(0, least(500, 1000 - greatest(c_acctbal, 0) / 10)) AS want, 20000.0 AS room FROM fr JOIN customer ON c_custkey = ticker)
SELECT sleeve, ticker, round(greatest(0, least(want, room - coalesce(sum(want) OVER (PARTITION BY sleeve ORDER BY cap DESC, ticker ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))), 2) AS filled FROM w""",
)
def k10(spark, sf):
    fr = L.fresh_alerts(*alert_inputs(spark, sf), spacing=300)
    c = V.table(spark, sf, "customer").select(C("c_custkey").cast("int").alias("ticker"), C("c_acctbal").alias("cap"))
    held = F.greatest(C("cap"), F.lit(0.0)) / 10
    w = fr.join(c, "ticker").withColumn("want", F.greatest(F.lit(0.0), F.least(F.lit(500.0), 1000 - held))).withColumn("room", F.lit(20000.0))
    d = L.waterfall(cut_lineage(w.select("sleeve", "ticker", "cap", "want", "room")), ["sleeve"], "want", "room", "cap", "ticker")
    return d.select("sleeve", "ticker", *r2("filled"))


# ---------------------------------------------------------------- first rows, top rows, sets
@query(
    "f02_keep_first_dedupe",
    "SELECT cik, CAST(filed AS VARCHAR) AS filed, accn, form FROM releases QUALIFY row_number() OVER (PARTITION BY cik, filed ORDER BY accn) = 1",
)
def f02(spark, sf):
    return R.earliest(V.releases(spark, sf), ["cik", "filed"], ["accn"]).select("cik", day("filed"), "accn", "form")


@query(
    "f03_top_n_by_cap",
    "SELECT CAST(c_nationkey AS INT) AS nation, CAST(c_custkey AS INT) AS id, c_acctbal AS cap FROM customer QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) <= 25",
)
def f03(spark, sf):
    c = V.table(spark, sf, "customer").select(C("c_nationkey").cast("int").alias("nation"), C("c_custkey").cast("int").alias("id"), C("c_acctbal").alias("cap"))
    return R.top_n(c, ["nation"], [F.desc("cap"), F.asc("id")], 25)


@query(
    "f05_priority_order",
    "SELECT id, gated FROM (SELECT CAST(c_custkey AS INT) AS id, CAST(c_acctbal > 5000 AS INT) AS gated FROM customer) ORDER BY gated DESC, id",
)
def f05(spark, sf):
    c = V.table(spark, sf, "customer").select(C("c_custkey").cast("int").alias("id"), (C("c_acctbal") > 5000).cast("int").alias("gated"))
    return c.orderBy(F.desc("gated"), "id")


@query(
    "a10_earnings_release_filter",
    "SELECT cik, accn, CAST(filed AS VARCHAR) AS filed FROM releases WHERE form IN ('F', 'O') AND filed >= DATE '1998-01-01' QUALIFY row_number() OVER (PARTITION BY cik ORDER BY filed DESC, accn DESC) <= 6",
)
def a10(spark, sf):
    r = V.releases(spark, sf).where(C("form").isin("F", "O") & (C("filed") >= F.lit("1998-01-01").cast("date")))
    return R.top_n(r, ["cik"], [F.desc("filed"), F.desc("accn")], 6).select("cik", "accn", day("filed"))


_MEM = """a AS (SELECT DISTINCT CAST(l_suppkey % 10 AS INT) AS fund, CAST(l_partkey AS INT) AS ticker FROM lineitem WHERE l_shipdate < DATE '1996-01-01'),
b AS (SELECT DISTINCT CAST(l_suppkey % 10 AS INT) AS fund, CAST(l_partkey AS INT) AS ticker FROM lineitem WHERE l_shipdate >= DATE '2001-01-01')"""


def members(spark, sf):
    li = V.table(spark, sf, "lineitem").select(
        (C("l_suppkey") % 10).cast("int").alias("fund"), C("l_partkey").cast("int").alias("ticker"), "l_shipdate"
    )
    a = li.where(C("l_shipdate") < F.lit("1996-01-01").cast("date")).select("fund", "ticker").distinct()
    b = li.where(C("l_shipdate") >= F.lit("2001-01-01").cast("date")).select("fund", "ticker").distinct()
    return a, b


@query(
    "g02_membership_diff",
    f"WITH {_MEM} SELECT 'added' AS change, fund, ticker FROM (SELECT * FROM b EXCEPT SELECT * FROM a) UNION ALL SELECT 'dropped', fund, ticker FROM (SELECT * FROM a EXCEPT SELECT * FROM b)",
)
def g02(spark, sf):
    a, b = members(spark, sf)
    k = ["fund", "ticker"]
    add = b.join(a, k, "left_anti").select(F.lit("added").alias("change"), *k)
    return add.unionByName(a.join(b, k, "left_anti").select(F.lit("dropped").alias("change"), *k))


@query(
    "g03_membership_both",
    f"WITH {_MEM} SELECT ticker, CASE WHEN bool_or(fund = 1) AND bool_or(fund = 2) THEN 'both' WHEN bool_or(fund = 1) THEN 'first only' ELSE 'second only' END AS held FROM b WHERE fund IN (1, 2) GROUP BY 1",
)
def g03(spark, sf):
    _, b = members(spark, sf)
    one, two = F.max(C("fund") == 1), F.max(C("fund") == 2)
    held = F.when(one & two, "both").when(one, "first only").otherwise("second only")
    return b.where(C("fund").isin(1, 2)).groupBy("ticker").agg(held.alias("held"))


@query(
    "g01_union_by_name",
    "SELECT cik, qn, rev, CAST(NULL AS DOUBLE) AS rpo FROM fq_gap UNION ALL SELECT cik, qn, NULL, rpo FROM fq_bal",
)
def g01(spark, sf):
    return V.fq_gap(spark, sf).unionByName(V.fq_bal(spark, sf), allowMissingColumns=True)


@query(
    "g04_distinct_union",
    "SELECT CAST(d AS VARCHAR) AS d, cik FROM (SELECT filed AS d, cik FROM releases WHERE accn % 2 = 0 UNION SELECT filed, cik FROM releases WHERE accn % 3 = 0)",
)
def g04(spark, sf):
    r = V.releases(spark, sf).select(C("filed").alias("d"), "cik", "accn")
    both = r.where(C("accn") % 2 == 0).unionByName(r.where(C("accn") % 3 == 0))
    return both.dropDuplicates(["d", "cik"]).select(day("d"), "cik")


@query(
    "g05_upsert_latest",
    "SELECT ticker, CAST(d AS VARCHAR) AS d, CASE WHEN d >= DATE '2001-06-01' THEN px * 2 ELSE px END AS px FROM px WHERE NOT (d < DATE '2001-06-01' AND ticker = 9)",
)
def g05(spark, sf):
    p = V.px(spark, sf)
    fresh = p.where(C("d") >= F.lit("2001-06-01").cast("date")).withColumn("px", C("px") * 2)
    return upsert(p, fresh, ["ticker", "d"]).select("ticker", day("d"), "px")


def upsert(old, new, keys):
    """New rows replace old rows of the same key; the rest stays."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new)


@query(
    "c28_new_vs_previous_join",
    "WITH p AS (SELECT DISTINCT cik, qn // 4 AS y FROM fq_gap WHERE rev > 1200000) SELECT a.cik, CAST(a.y AS INT) AS y, CAST(b.cik IS NULL AS INT) AS is_new FROM p a LEFT JOIN p b ON a.cik = b.cik AND b.y = a.y - 1",
)
def c28(spark, sf):
    p = V.fq_gap(spark, sf).where(C("rev") > 1200000).select("cik", F.floor(C("qn") / 4).cast("int").alias("y")).distinct()
    old = p.select("cik", (C("y") + 1).alias("y"), F.lit(0).alias("seen"))
    return p.join(old, ["cik", "y"], "left").select("cik", "y", C("seen").isNull().cast("int").alias("is_new"))


@query(
    "c27_successor_chain",
    "WITH ch AS (SELECT CAST(s_suppkey AS INT) AS cik, CAST(s_suppkey - s_suppkey % 3 AS INT) AS chain FROM supplier) SELECT chain, qn, arg_min(rev, r.cik) AS rev FROM fq_gap r JOIN ch ON ch.cik = r.cik GROUP BY 1, 2",
)
def c27(spark, sf):
    ch = V.table(spark, sf, "supplier").select(
        C("s_suppkey").cast("int").alias("cik"), (C("s_suppkey") - C("s_suppkey") % 3).cast("int").alias("chain")
    )
    d = V.fq_gap(spark, sf).join(ch, "cik")
    return R.earliest(d.select("chain", "qn", "cik", "rev"), ["chain", "qn"], ["cik"]).select("chain", "qn", "rev")


@query(
    "d32_universe_survivorship",
    "SELECT cik, count(*) AS n, max(guide_mid) AS top, CAST(max(filed) AS VARCHAR) AS last_filed FROM releases WHERE cik NOT IN (SELECT CAST(s_suppkey AS INT) FROM supplier WHERE s_acctbal > 0) GROUP BY 1 HAVING max(guide_mid) >= 100000 ORDER BY top DESC, cik LIMIT 1500",
)
def d32(spark, sf):
    listed = V.table(spark, sf, "supplier").where(C("s_acctbal") > 0).select(C("s_suppkey").cast("int").alias("cik"))
    g = V.releases(spark, sf).join(listed, "cik", "left_anti").groupBy("cik").agg(
        F.count(F.lit(1)).alias("n"), F.max("guide_mid").alias("top"), F.max("filed").cast("string").alias("last_filed")
    )
    return g.where(C("top") >= 100000).orderBy(F.desc("top"), "cik").limit(1500)


@query(
    "d33_breadth_counts",
    """WITH e AS (SELECT CAST(p.l_partkey % 20 AS INT) AS ticker, CAST(l_shipdate AS DATE) AS d, max(l_extendedprice/l_quantity) AS h, min(l_extendedprice/l_quantity) AS l FROM lineitem p GROUP BY 1, 2),
f AS (SELECT ticker, d, count(h) OVER w = 251 AS live, h >= max(h) OVER w AS nh, l <= min(l) OVER w AS nl FROM e WINDOW w AS (PARTITION BY ticker ORDER BY d ROWS BETWEEN 251 PRECEDING AND 1 PRECEDING))
SELECT CAST(d AS VARCHAR) AS d, CASE ticker % 3 WHEN 0 THEN 'common' WHEN 1 THEN 'other' ELSE 'etf' END AS kind, count(*) FILTER (WHERE live AND nh) AS nh, count(*) FILTER (WHERE live AND nl) AS nl, count(*) FILTER (WHERE live) AS n FROM f GROUP BY 1, 2""",
)
def d33(spark, sf):
    x = C("l_extendedprice") / C("l_quantity")
    e = V.table(spark, sf, "lineitem").groupBy((C("l_partkey") % 20).cast("int").alias("ticker"), C("l_shipdate").cast("date").alias("d")).agg(
        F.max(x).alias("h"), F.min(x).alias("l")
    )
    k = ["ticker"]
    e = e.select(
        "ticker", "d", W.window_ready(C("h"), k, "d").alias("live"), W.new_extreme(C("h"), k, "d").alias("nh"),
        W.new_extreme(C("l"), k, "d", high=False).alias("nl"),
    )
    kind = F.when(C("ticker") % 3 == 0, "common").when(C("ticker") % 3 == 1, "other").otherwise("etf")
    return e.groupBy(day("d"), kind.alias("kind")).agg(
        F.count_if("nh").alias("nh"), F.count_if("nl").alias("nl"), F.count_if("live").alias("n")
    )
