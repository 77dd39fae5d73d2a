"""Acceleration ranking, segment signals and part-to-total checks."""

from pyspark.sql import Window, functions as F

from tidemark.catalog import views as V
from tidemark.catalog.q_vintage import _CUM, _V2, cumulative_facts, fact_vintages
from tidemark.catalog.registry import query
from tidemark.functions.dates import quarter_end, quarter_ordinal
from tidemark.functions.text import is_geography, name_key, normalise_name
from tidemark.operators import reconcile as Q, vintage as N, windows as W
from tidemark.plans import series as A
from tidemark.session import cut_lineage

C = F.col


def r6(*cols):
    return [F.round(C(c), 6).alias(c) for c in cols]


def ints(*cols):
    return [C(c).cast("int").alias(c) for c in cols]


# ---------------------------------------------------------------- acceleration
_QE = "last_day(make_date(CAST(qn // 4 AS INT), CAST(qn % 4 * 3 + 3 AS INT), 1))"
_SER = """ser AS (SELECT cik AS ticker, 'segment' AS axis, segment AS series, qn, rev / 1000 AS value, 'segment revenue' AS kind FROM fq_seg WHERE (cik*31 + qn*17) % 11 <> 0
UNION ALL SELECT cik, 'company', 'TOTAL COMPANY', qn, rev / 1000, 'company revenue' FROM fq_rev
UNION ALL SELECT cik, 'balance', 'Backlog', qn, rpo / 100000, 'bookings / backlog' FROM fq_bal WHERE (cik + qn) % 13 <> 0),
sp AS (SELECT ticker, axis, series, kind, min(qn) AS a, max(qn) AS b FROM ser GROUP BY ALL),
gr AS (SELECT ticker, axis, series, kind, CAST(unnest(generate_series(a, b)) AS INT) AS qn FROM sp),
fi AS (SELECT gr.*, ser.value FROM gr LEFT JOIN ser USING (ticker, axis, series, kind, qn)),
m0 AS (SELECT *, lag(value, 4) OVER w AS yago, value / lag(value, 4) OVER w - 1 AS yoy, value / lag(value, 1) OVER w - 1 AS qoq, value / lag(value, 3) OVER w - 1 AS qoq_3q
       FROM fi WINDOW w AS (PARTITION BY ticker, axis, series ORDER BY qn)),
m1 AS (SELECT *, yoy - lag(yoy) OVER (PARTITION BY ticker, axis, series ORDER BY qn) AS accel, count(value) OVER (PARTITION BY ticker, axis, series) AS quarters_history FROM m0),
m2 AS (SELECT *, sum(CASE WHEN accel > 0 THEN 0 ELSE 1 END) OVER (PARTITION BY ticker, axis, series ORDER BY qn ROWS UNBOUNDED PRECEDING) AS g FROM m1),
m3 AS (SELECT *, CAST(sum(CASE WHEN accel > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY ticker, axis, series, g ORDER BY qn ROWS UNBOUNDED PRECEDING) AS INT) AS streak FROM m2),
co AS (SELECT ticker, qn, value AS co_rev, CASE WHEN count(value) OVER w >= 3 THEN sum(value) OVER w * 4 / count(value) OVER w END AS ttm_rev FROM m3 WHERE axis = 'company' WINDOW w AS (PARTITION BY ticker ORDER BY qn ROWS 3 PRECEDING)),
m4 AS (SELECT m3.*, CASE WHEN kind = 'bookings / backlog' THEN value / ttm_rev ELSE value / co_rev END AS share,
       yoy - (SELECT x.yoy FROM m3 x WHERE x.ticker = m3.ticker AND x.axis = m3.axis AND x.series = m3.series AND x.qn = m3.qn - m3.streak AND m3.streak > 0) AS cum_accel FROM m3 LEFT JOIN co USING (ticker, qn)),
lq AS (SELECT ticker, max(qn) AS latest_co_q FROM m4 WHERE axis = 'company' AND value IS NOT NULL GROUP BY 1),
la AS (SELECT m4.*, latest_co_q - qn AS stale_q, coalesce(CASE WHEN axis = 'company' THEN true WHEN kind = 'bookings / backlog' THEN share >= 0.03 ELSE share >= 0.05 AND yago >= 20 END, false) AS material
       FROM m4 LEFT JOIN lq USING (ticker) WHERE value IS NOT NULL QUALIFY row_number() OVER (PARTITION BY ticker, axis, series ORDER BY qn DESC) = 1),
ok AS (SELECT *, least(greatest(accel, -2), 5) * sqrt(greatest(least(streak, 4), 1)) AS score, quarters_history < 8 AS short_history FROM la WHERE stale_q <= 1 AND material AND accel IS NOT NULL)"""


def all_series(spark, sf):
    """Segment, company and backlog series in one long table."""
    cols = ["ticker", "axis", "series", "qn", "value", "kind"]
    s = V.fq_seg(spark, sf).where((C("cik") * 31 + C("qn") * 17) % 11 != 0)
    parts = [
        s.select(
            C("cik").alias("ticker"), F.lit("segment").alias("axis"), C("segment").alias("series"), "qn",
            (C("rev") / 1000).alias("value"), F.lit("segment revenue").alias("kind"),
        ),
        V.fq_rev(spark, sf).select(
            C("cik").alias("ticker"), F.lit("company").alias("axis"), F.lit("TOTAL COMPANY").alias("series"), "qn",
            (C("rev") / 1000).alias("value"), F.lit("company revenue").alias("kind"),
        ),
        V.fq_bal(spark, sf).where((C("cik") + C("qn")) % 13 != 0).select(
            C("cik").alias("ticker"), F.lit("balance").alias("axis"), F.lit("Backlog").alias("series"), "qn",
            (C("rpo") / 100000).alias("value"), F.lit("bookings / backlog").alias("kind"),
        ),
    ]
    out = parts[0].select(*cols)
    for p in parts[1:]:
        out = out.unionByName(p.select(*cols))
    return out


def accel_metrics(spark, sf):
    d = cut_lineage(all_series(spark, sf))
    kinds = d.groupBy(*A.KEYS).agg(F.min("kind").alias("kind"))
    return A.with_share(A.series_metrics(d.withColumn("period_end", quarter_end(C("qn")))), kinds)


_MC = ["yoy", "accel", "qoq_3q", "cum_accel", "share"]
_MS = "round(value, 8) AS value, " + ", ".join(f"round({c}, 6) AS {c}" for c in _MC)


@query(
    "k03_acceleration_rank",
    f"WITH {_SER} SELECT ticker, axis, series, qn, {_MS}, streak, round(score, 6) AS score, CAST(short_history AS INT) AS short_history FROM ok",
)
def k03(spark, sf):
    d = A.rank_series(A.latest_series(accel_metrics(spark, sf)))
    return d.select("ticker", "axis", "series", "qn", F.round("value", 8).alias("value"), *r6(*_MC), "streak", *r6("score"), *ints("short_history")).orderBy(
        F.desc("score"), "ticker", "axis", "series"
    )


@query("b17_materiality", f"WITH {_SER} SELECT ticker, axis, series, stale_q, CAST(material AS INT) AS material FROM la")
def b17(spark, sf):
    return A.latest_series(accel_metrics(spark, sf)).select("ticker", "axis", "series", "stale_q", *ints("material"))


@query(
    "b18_early_turns",
    f"WITH {_SER} SELECT ticker, axis, series, round(accel, 6) AS accel FROM ok WHERE accel > 0 AND streak >= 2 AND yoy < 0.6 AND share >= 0.08 AND axis <> 'geography'",
)
def b18(spark, sf):
    d = A.early_turns(A.rank_series(A.latest_series(accel_metrics(spark, sf))))
    return d.select("ticker", "axis", "series", *r6("accel"))


@query(
    "f04_ranked_screen",
    f"WITH {_SER} SELECT ticker, axis, series, round(score, 6) AS score FROM (SELECT *, round(score, 9) AS s9 FROM ok) ORDER BY s9 DESC, ticker, axis, series LIMIT 50",
)
def f04(spark, sf):
    d = A.rank_series(A.latest_series(accel_metrics(spark, sf))).withColumn("s9", F.round("score", 9))
    return d.orderBy(F.desc("s9"), "ticker", "axis", "series").limit(50).select("ticker", "axis", "series", *r6("score"))


@query(
    "k17_high_frequency_yoy",
    """WITH mo AS (SELECT CAST(l_suppkey AS INT) AS cik, CAST(year(l_shipdate)*12 + month(l_shipdate) - 1 AS INT) AS mn, round(sum(l_extendedprice*(1-l_discount)), 4) AS rev FROM lineitem GROUP BY 1, 2)
SELECT a.cik, a.mn, round(a.rev / b.rev - 1, 6) AS yoy FROM mo a LEFT JOIN mo b ON a.cik = b.cik AND b.mn = a.mn - 12""",
)
def k17(spark, sf):
    m = monthly(spark, sf)
    y = W.ratio(C("rev"), W.period_offset(C("rev"), ["cik"], "mn", 12)) - 1
    return m.select("cik", "mn", F.round(y, 6).alias("yoy"))


def monthly(spark, sf):
    return (
        V.table(spark, sf, "lineitem")
        .groupBy(
            C("l_suppkey").cast("int").alias("cik"),
            (F.year("l_shipdate") * 12 + F.month("l_shipdate") - 1).alias("mn"),
        )
        .agg(F.round(F.sum(C("l_extendedprice") * (1 - C("l_discount"))), 4).alias("rev"))
    )


@query(
    "d13_month_quarter_tie",
    """WITH mo AS (SELECT CAST(l_suppkey AS INT) AS cik, CAST(year(l_shipdate)*12 + month(l_shipdate) - 1 AS INT) AS mn, round(sum(l_extendedprice*(1-l_discount)), 4) AS rev FROM lineitem GROUP BY 1, 2),
q AS (SELECT cik, CAST(mn // 3 AS INT) AS qn, round(sum(rev), 4) AS msum FROM mo WHERE (cik + mn) % 17 <> 0 GROUP BY 1, 2 HAVING count(*) = 3)
SELECT cik, qn, round((msum / rev - 1) * 100, 6) AS err_pct FROM q JOIN fq_rev USING (cik, qn)""",
)
def d13(spark, sf):
    m = monthly(spark, sf).where((C("cik") + C("mn")) % 17 != 0)
    q = complete_quarters(m)
    return q.join(V.fq_rev(spark, sf), ["cik", "qn"]).select(
        "cik", "qn", F.round((C("msum") / C("rev") - 1) * 100, 6).alias("err_pct")
    )


def complete_quarters(m):
    """Quarters with all three months."""
    g = m.groupBy("cik", F.floor(C("mn") / 3).cast("int").alias("qn")).agg(
        F.round(F.sum("rev"), 4).alias("msum"), F.count(F.lit(1)).alias("n")
    )
    return g.where(C("n") == 3).drop("n")


@query(
    "k18_monthly_to_quarter_lead",
    """WITH mo AS (SELECT CAST(l_suppkey AS INT) AS cik, CAST(year(l_shipdate)*12 + month(l_shipdate) - 1 AS INT) AS mn, round(sum(l_extendedprice*(1-l_discount)), 4) AS rev FROM lineitem GROUP BY 1, 2),
q AS (SELECT cik, CAST(mn // 3 AS INT) AS qn, round(sum(rev), 4) AS rev FROM mo GROUP BY 1, 2 HAVING count(*) = 3),
y AS (SELECT a.cik, a.qn, round(a.rev / b.rev - 1, 6) AS yoy FROM q a JOIN q b ON a.cik = b.cik AND b.qn = a.qn - 4),
mk AS (SELECT qn, round(sum(rev), 4) AS rev FROM fq_rev GROUP BY 1), my AS (SELECT a.qn, round(a.rev / b.rev - 1, 6) AS yoy FROM mk a JOIN mk b ON b.qn = a.qn - 4),
p AS (SELECT y.cik, k.k, y.yoy AS x, my.yoy AS z FROM y CROSS JOIN (SELECT CAST(unnest([-1, 0, 1]) AS INT) AS k) k JOIN my ON my.qn = y.qn + k.k),
r AS (SELECT cik, k, CAST(rank() OVER (PARTITION BY cik, k ORDER BY x) + (count(*) OVER (PARTITION BY cik, k, x) - 1) / 2.0 AS DOUBLE) AS a, CAST(rank() OVER (PARTITION BY cik, k ORDER BY z) + (count(*) OVER (PARTITION BY cik, k, z) - 1) / 2.0 AS DOUBLE) AS b FROM p)
SELECT cik, k, round(corr(a, b), 6) AS rho FROM r GROUP BY 1, 2""",
)
def k18(spark, sf):
    from tidemark.operators import stats as S

    q = complete_quarters(monthly(spark, sf))
    y = q.withColumn("yoy", F.round(W.ratio(C("msum"), W.period_offset(C("msum"), ["cik"], "qn", 4)) - 1, 6))
    y = y.where(C("yoy").isNotNull()).withColumn("k", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1))))
    # the market's own series: one row per quarter
    mk = V.fq_rev(spark, sf).groupBy("qn").agg(F.round(F.sum("rev"), 4).alias("rev")).withColumn("one", F.lit(1))
    mk = mk.withColumn("z", F.round(C("rev") / W.period_offset(C("rev"), ["one"], "qn", 4) - 1, 6)).where(C("z").isNotNull())
    p = y.withColumn("qn", C("qn") + C("k")).join(mk.select("qn", "z"), "qn")
    p = p.withColumn("a", S.rank_in(C("yoy"), ["cik", "k"])).withColumn("b", S.rank_in(C("z"), ["cik", "k"]))
    return p.groupBy("cik", "k").agg(F.round(S.safe_corr("a", "b"), 6).alias("rho"))


# ---------------------------------------------------------------- segment facts
_SEGF = f"""{_CUM.replace('fq_rev', 'fq_seg').replace('SELECT cik, qn // 4', 'SELECT cik, segment, qn // 4').replace('SELECT a.cik, a.fy', 'SELECT a.cik, a.segment, a.fy').replace('b.cik = a.cik', 'b.cik = a.cik AND b.segment = a.segment').replace('SELECT cik, qn, 3', 'SELECT cik, segment, qn, 3').replace('SELECT cik, qn, dur', 'SELECT cik, segment, qn, dur')}"""
_SEGV = f"""{_SEGF},
sv AS (SELECT cik, segment, qn, dur, arg_min(value, filed) AS first, min(filed) AS first_filed, arg_max(value, filed) AS latest, max(filed) AS latest_filed FROM facts WHERE segment <> 'R' OR qn % 3 <> 0 GROUP BY 1, 2, 3, 4),
rep AS (SELECT cik, segment, qn, first, first_filed, latest, 'reported 3M' AS source FROM sv WHERE dur = 3),
der AS (SELECT y.cik, y.segment, y.qn, y.first - n.first, y.first_filed, y.latest - n.latest, 'derived Q4 = FY - 9M' FROM sv y JOIN sv n ON y.cik = n.cik AND y.segment = n.segment AND y.dur = 12 AND n.dur = 9 AND n.qn = y.qn - 1
        WHERE NOT EXISTS (SELECT 1 FROM rep r WHERE r.cik = y.cik AND r.segment = y.segment AND r.qn = y.qn)),
ss AS (SELECT * FROM rep UNION ALL SELECT * FROM der)"""


def segment_facts(spark, sf):
    """Quarter, nine-month and year printings of each filer's segments."""
    y = V.fq_seg(spark, sf).withColumn("fy", F.floor(C("qn") / 4)).withColumn("q", C("qn") % 4)
    w = Window.partitionBy("cik", "segment", "fy").orderBy("q").rowsBetween(Window.unboundedPreceding, 0)
    y = y.withColumn("cum", F.round(F.sum("rev").over(w), 4)).withColumn("dur", (C("q") + 1) * 3)

    def fact(dur, value, late, keep):
        s = F.struct(
            dur.cast("int").alias("duration_months"), value.alias("value"),
            (C("qn") * 10 + late * 40).alias("filed"), (C("qn") * 100 + 1 + late * 40).alias("accn"),
        )
        return F.when(keep, s)

    parts = F.array(
        fact(F.lit(3), C("rev"), 0, (C("q") < 3) | (C("cik") % 4 == 0)),
        fact(C("dur"), C("cum"), 0, C("dur").isin(9, 12)),
        fact(C("dur"), C("cum") + 10, 1, (C("dur") == 12) & (C("cik") % 3 == 0)),
        fact(F.lit(3), C("rev") + 5, 1, (C("q") < 3) & (C("cik") % 3 == 1)),
    )
    d = y.select("cik", "segment", "qn", F.inline(F.filter(parts, lambda x: x.isNotNull())))
    d = d.where((C("segment") != "R") | (C("qn") % 3 != 0))
    return d.select(
        C("cik").alias("ticker"), F.lit("segment").alias("axis"), C("segment").alias("name"), C("segment").alias("members"),
        F.lit("revenue").alias("metric"), quarter_end(C("qn")).alias("period_end"), "duration_months", "value", "filed", "accn",
    )


@query(
    "k04_accel_series",
    f"""WITH {_SEGV}, co AS (SELECT cik, qn, rev, qn * 10 AS filed FROM fq_rev WHERE (cik + qn) % 5 <> 0),
sm AS (SELECT cik, qn, sum(first) AS rev, max(first_filed) AS filed FROM ss WHERE NOT EXISTS (SELECT 1 FROM co WHERE co.cik = ss.cik AND co.qn = ss.qn) GROUP BY 1, 2)
SELECT cik AS ticker, 'segment' AS axis, segment AS series, qn, round(first, 4) AS rev, first_filed AS filed, source FROM ss
UNION ALL SELECT cik, 'company', 'TOTAL COMPANY', qn, round(rev, 4), filed, 'reported 3M' FROM co
UNION ALL SELECT cik, 'company', 'TOTAL COMPANY', qn, round(rev, 4), filed, 'sum of reportable segments' FROM sm""",
)
def k04(spark, sf):
    s = cut_lineage(A.ticker_series(segment_facts(spark, sf)))
    co = V.fq_rev(spark, sf).where((C("cik") + C("qn")) % 5 != 0).select(
        C("cik").alias("ticker"), quarter_end(C("qn")).alias("period_end"), C("rev").alias("value"), (C("qn") * 10).alias("filed")
    )
    t = A.company_totals(co, s)
    a = s.select("ticker", "axis", "series", "period_end", C("first").alias("rev"), C("first_filed").alias("filed"), "source")
    b = t.select(
        "ticker", F.lit("company").alias("axis"), F.lit("TOTAL COMPANY").alias("series"), "period_end",
        C("value").alias("rev"), "filed", "source",
    )
    return a.unionByName(b).select(
        "ticker", "axis", "series", quarter_ordinal(C("period_end")).alias("qn"), F.round("rev", 4).alias("rev"), "filed", "source"
    )


@query(
    "k13_segment_vintages",
    f"""WITH {_SEGF}, p AS (SELECT segment, parent FROM (SELECT segment, CASE WHEN cik % 3 = 0 THEN 'Group A' ELSE 'Group B' END AS parent, count(*) AS n, max(filed) AS last FROM facts GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY segment ORDER BY n DESC, last DESC, parent) = 1)
SELECT segment AS name, parent, count(*) AS printings, round(sum(value), 4) AS value FROM (SELECT cik, segment, qn, dur, accn, sum(value) AS value FROM facts WHERE segment <> 'R' OR qn % 3 <> 0 GROUP BY ALL) JOIN p USING (segment) GROUP BY 1, 2""",
)
def k13(spark, sf):
    f = segment_facts(spark, sf).withColumn("parent", F.when(C("ticker") % 3 == 0, "Group A").otherwise("Group B"))
    k = ["ticker", "name", "period_end", "duration_months", "accn"]
    d = N.collapse_members(f, k, "value", ["filed"], "filed")
    return d.join(N.modal(f, ["name"], "parent", "filed"), "name").groupBy("name", "parent").agg(
        F.count(F.lit(1)).alias("printings"), F.round(F.sum("value"), 4).alias("value")
    )


_SIG = """g0 AS (SELECT a.cik, a.segment, a.qn, a.rev, y.rev AS yago FROM fq_seg a LEFT JOIN fq_seg y ON a.cik = y.cik AND a.segment = y.segment AND y.qn = a.qn - 4),
g1 AS (SELECT *, rev / yago - 1 AS yoy FROM g0),
g2 AS (SELECT a.*, a.yoy - p.yoy AS acc FROM g1 a LEFT JOIN g1 p ON a.cik = p.cik AND a.segment = p.segment AND p.qn = a.qn - 1),
b AS (SELECT cik, qn, sum(yago) AS base, count(yago) = count(rev) AS al FROM g2 GROUP BY 1, 2),
g3 AS (SELECT g2.cik, g2.segment, g2.qn, rev, yago, base, al, CASE WHEN coalesce(base > 0 AND yago < 0.2 * base, false) THEN NULL ELSE yoy END AS yoy, CASE WHEN coalesce(base > 0 AND yago < 0.2 * base, false) THEN NULL ELSE acc END AS acc FROM g2 JOIN b USING (cik, qn)),
sg AS (SELECT cik AS ticker, qn, max(qn * 91 + cik % 30) AS known_at, count(*) AS n_segments, sum(rev) AS total_rev, CASE WHEN bool_and(al) AND count(yoy) = count(*) AND max(base) > 0 THEN sum(rev) / max(base) - 1 END AS total_yoy,
 arg_max(segment, (rev, segment)) AS largest_seg, max(rev) / sum(rev) AS largest_share, max(yoy) AS best_seg_yoy, min(yoy) AS worst_seg_yoy, stddev_samp(yoy) AS seg_yoy_disp, sum(yoy * rev) / sum(CASE WHEN yoy IS NOT NULL THEN rev END) AS wavg_seg_yoy,
 max(acc) AS best_seg_accel, min(acc) AS worst_seg_accel, sum(acc * rev) / sum(CASE WHEN acc IS NOT NULL THEN rev END) AS wavg_seg_accel, count(*) FILTER (WHERE acc > 0) AS n_segs_accelerating, avg(CASE WHEN acc > 0 THEN 1.0 WHEN acc <= 0 THEN 0.0 END) AS share_segs_accelerating FROM g3 GROUP BY 1, 2)"""
_SGC = "total_yoy largest_share best_seg_yoy worst_seg_yoy seg_yoy_disp wavg_seg_yoy best_seg_accel worst_seg_accel wavg_seg_accel share_segs_accelerating".split()


def signals(spark, sf):
    s = V.fq_seg(spark, sf).select(
        C("cik").alias("ticker"), C("segment").alias("name"), "qn", "rev", (C("qn") * 91 + C("cik") % 30).alias("known_at")
    )
    return A.segment_signals(s, 0.2)


@query(
    "d15_segment_signals",
    f"WITH {_SIG} SELECT ticker, qn, CAST(known_at AS INT) AS known_at, n_segments, largest_seg, n_segs_accelerating, {', '.join(f'round({c}, 6) AS {c}' for c in _SGC)} FROM sg",
)
def d15(spark, sf):
    return signals(spark, sf).select(
        "ticker", "qn", *ints("known_at"), "n_segments", "largest_seg", "n_segs_accelerating", *r6(*_SGC)
    )


@query(
    "d16_company_baseline",
    f"""WITH {_SIG}, f AS (SELECT cik AS ticker, qn, rev AS co_rev, qn * 91 + 20 AS co_known_at FROM fq_gap),
c AS (SELECT *, co_rev / lag(co_rev, 4) OVER (PARTITION BY ticker ORDER BY qn) - 1 AS co_yoy FROM f), c2 AS (SELECT *, co_yoy - lag(co_yoy) OVER (PARTITION BY ticker ORDER BY qn) AS co_accel FROM c)
SELECT sg.ticker, sg.qn, round(co_yoy, 6) AS co_yoy, round(co_accel, 6) AS co_accel, CAST(greatest(known_at, co_known_at) AS INT) AS known_at, CAST(abs(total_rev - co_rev) <= 0.005 * abs(co_rev) + 1 AS INT) AS ties FROM sg LEFT JOIN c2 USING (ticker, qn)""",
)
def d16(spark, sf):
    fin = V.fq_gap(spark, sf).select(C("cik").alias("ticker"), "qn", C("rev").alias("co_rev"), (C("qn") * 91 + 20).alias("co_known_at"))
    d = signals(spark, sf).join(A.company_baseline(fin), ["ticker", "qn"], "left")
    tie = F.abs(C("total_rev") - C("co_rev")) <= 0.005 * F.abs("co_rev") + 1
    return d.select(
        "ticker", "qn", *r6("co_yoy", "co_accel"), F.greatest("known_at", "co_known_at").cast("int").alias("known_at"), tie.cast("int").alias("ties")
    )


@query(
    "b29_mask_small",
    """WITH g AS (SELECT a.cik, a.segment, a.qn, a.rev / y.rev - 1 AS yoy, y.rev AS yago, sum(y.rev) OVER (PARTITION BY a.cik, a.qn) AS base FROM fq_seg a LEFT JOIN fq_seg y ON a.cik = y.cik AND a.segment = y.segment AND y.qn = a.qn - 4)
SELECT cik, segment, qn, round(CASE WHEN coalesce(base > 0 AND yago < 0.2 * base, false) THEN NULL ELSE yoy END, 6) AS yoy FROM g""",
)
def b29(spark, sf):
    k = ["cik", "segment"]
    d = V.fq_seg(spark, sf).withColumn("yago", W.period_offset(C("rev"), k, "qn", 4))
    base = d.groupBy("cik", "qn").agg(F.sum("yago").alias("base"))
    d = d.join(base, ["cik", "qn"])
    small = F.coalesce((C("base") > 0) & (C("yago") < 0.2 * C("base")), F.lit(False))
    return d.select("cik", "segment", "qn", F.round(F.when(~small, C("rev") / C("yago") - 1), 6).alias("yoy"))


@query(
    "b19_series_label_filter",
    """SELECT DISTINCT p_type AS label FROM (SELECT CASE WHEN p_size % 3 = 0 THEN p_type || ' Member' WHEN p_size % 5 = 0 THEN p_type || ' Domain' ELSE p_type END AS p_type FROM part) WHERE NOT regexp_matches(p_type, '(?i)\\bMember\\b|\\bDomain\\b')""",
)
def b19(spark, sf):
    p = V.table(spark, sf, "part")
    label = (
        F.when(C("p_size") % 3 == 0, F.concat("p_type", F.lit(" Member")))
        .when(C("p_size") % 5 == 0, F.concat("p_type", F.lit(" Domain")))
        .otherwise(C("p_type"))
    )
    return p.select(label.alias("label")).where(A.resolved(C("label"))).distinct()


# ---------------------------------------------------------------- add-up checks
_ADD = """base AS (SELECT cik, qn, segment AS member, rev AS value, CASE segment WHEN 'A' THEN 'Alpha' WHEN 'N' THEN 'North' ELSE 'Rho' END AS name FROM fq_seg),
tot AS (SELECT cik, qn, round(sum(value), 4) AS total, round(sum(CASE WHEN member <> 'R' THEN value ELSE 0 END), 4) AS sub FROM base GROUP BY 1, 2),
extra AS (SELECT cik, qn, 'X1' AS member, total AS value, 'Consolidated' AS name FROM tot WHERE (cik + qn) % 8 = 1
 UNION ALL SELECT cik, qn, 'X2', sub, 'Total Products' FROM tot WHERE (cik + qn) % 8 = 2
 UNION ALL SELECT cik, qn, 'X3', sub, 'Rollup' FROM tot WHERE (cik + qn) % 8 = 3 UNION ALL SELECT cik, qn, 'X4', 123456.75, 'Corporate' FROM tot WHERE (cik + qn) % 8 = 3
 UNION ALL SELECT cik, qn, 'X5', round(total * 0.3, 2), 'Europe' FROM tot WHERE (cik + qn) % 8 = 4 UNION ALL SELECT cik, qn, 'X6', round(total * 0.45, 2), 'Asia Pacific' FROM tot WHERE (cik + qn) % 8 = 4 UNION ALL SELECT cik, qn, 'X7', round(total * 0.21, 2), 'Japan' FROM tot WHERE (cik + qn) % 8 = 4
 UNION ALL SELECT cik, qn, 'X8', round(total * 0.37, 2), 'Unknown' FROM tot WHERE (cik + qn) % 8 = 5 AND cik % 2 = 0),
seg0 AS (SELECT cik, qn, member, CASE WHEN (cik + qn) % 8 = 5 AND member = 'A' THEN value * 1.5 ELSE value END AS value, name FROM base UNION ALL SELECT * FROM extra),
sg AS (SELECT s.*, total, greatest(1.0, 0.001 * abs(total)) AS tol FROM seg0 s JOIN tot USING (cik, qn)),
a0 AS (SELECT *, count(*) OVER w AS n, round(sum(value) OVER w, 6) AS s FROM sg WINDOW w AS (PARTITION BY cik, qn)),
a1 AS (SELECT *, CASE WHEN n > 1 AND abs(s - total) > tol AND abs(value - total) <= 1 THEN 'equals total' END AS st1 FROM a0),
b0 AS (SELECT cik, qn, member, value, name, total, tol, st1, count(*) FILTER (WHERE st1 IS NULL) OVER w AS n, round(sum(CASE WHEN st1 IS NULL THEN value END) OVER w, 6) AS s FROM a1 WINDOW w AS (PARTITION BY cik, qn)),
b1 AS (SELECT *, CASE WHEN st1 IS NULL AND n > 2 AND abs(s - total) > tol AND abs(s - value - total) <= tol THEN row_number() OVER (PARTITION BY cik, qn, st1 IS NULL AND n > 2 AND abs(s - total) > tol AND abs(s - value - total) <= tol ORDER BY CASE WHEN lower(name) LIKE 'total%' THEN 0 ELSE 1 END, -abs(value), member) END AS k FROM b0),
one AS (SELECT cik, qn, member FROM b1 WHERE k = 1),
prs AS (SELECT x.cik, x.qn, x.member AS i, y.member AS j FROM b1 x JOIN b1 y ON x.cik = y.cik AND x.qn = y.qn AND x.member < y.member WHERE x.st1 IS NULL AND y.st1 IS NULL AND x.n >= 4 AND abs(x.s - x.total) > x.tol AND abs(x.s - x.value - y.value - x.total) <= x.tol
  AND NOT EXISTS (SELECT 1 FROM one WHERE one.cik = x.cik AND one.qn = x.qn) QUALIFY row_number() OVER (PARTITION BY x.cik, x.qn ORDER BY x.member, y.member) = 1),
gone AS (SELECT * FROM one UNION ALL SELECT cik, qn, i FROM prs UNION ALL SELECT cik, qn, j FROM prs),
c0 AS (SELECT b1.* EXCLUDE (n, s, k), CASE WHEN st1 IS NOT NULL THEN st1 WHEN EXISTS (SELECT 1 FROM gone g WHERE g.cik = b1.cik AND g.qn = b1.qn AND g.member = b1.member) THEN 'subtotal' END AS st2 FROM b1),
c1 AS (SELECT *, count(*) FILTER (WHERE st2 IS NULL) OVER w AS n, round(sum(CASE WHEN st2 IS NULL THEN value END) OVER w, 6) AS s, count(*) FILTER (WHERE st2 IS NULL AND name NOT IN ('Europe', 'Asia Pacific', 'Japan')) OVER w AS ng,
  round(sum(CASE WHEN st2 IS NULL AND name NOT IN ('Europe', 'Asia Pacific', 'Japan') THEN value END) OVER w, 6) AS sgeo FROM c0 WINDOW w AS (PARTITION BY cik, qn)),
c2 AS (SELECT *, CASE WHEN st2 IS NOT NULL THEN st2 WHEN n > 1 AND abs(s - total) > tol AND ng > 0 AND ng < n AND abs(sgeo - total) <= tol AND name IN ('Europe', 'Asia Pacific', 'Japan') THEN 'geography (tagged on segment axis)' END AS step FROM c1),
fin AS (SELECT *, count(*) FILTER (WHERE step IS NULL) OVER w AS n_kept, round(sum(CASE WHEN step IS NULL THEN value END) OVER w, 6) AS sum_kept FROM c2 WINDOW w AS (PARTITION BY cik, qn))"""


def addup_inputs(spark, sf):
    s = V.fq_seg(spark, sf)
    name = F.when(C("segment") == "A", "Alpha").when(C("segment") == "N", "North").otherwise("Rho")
    base = s.select("cik", "qn", C("segment").alias("member"), C("rev").alias("value"), name.alias("name"))
    w = Window.partitionBy("cik", "qn")
    base = base.withColumns({
        "total": F.round(F.sum("value").over(w), 4),
        "sub": F.round(F.sum(F.when(C("member") != "R", C("value")).otherwise(0.0)).over(w), 4),
        "first": F.row_number().over(w.orderBy("member")) == 1,
    })
    base = cut_lineage(base)  # read three times
    tot = base.where("first").select("cik", "qn", "total", "sub")
    c = (C("cik") + C("qn")) % 8

    def row(when, member, value, label):
        return F.when(when, F.struct(F.lit(member).alias("member"), value.alias("value"), F.lit(label).alias("name")))

    t = C("total")
    rows = F.array_compact(
        F.array(
            row(c == 1, "X1", t, "Consolidated"),
            row(c == 2, "X2", C("sub"), "Total Products"),
            row(c == 3, "X3", C("sub"), "Rollup"),
            row(c == 3, "X4", F.lit(123456.75), "Corporate"),
            row(c == 4, "X5", F.round(t * 0.3, 2), "Europe"),
            row(c == 4, "X6", F.round(t * 0.45, 2), "Asia Pacific"),
            row(c == 4, "X7", F.round(t * 0.21, 2), "Japan"),
            row((c == 5) & (C("cik") % 2 == 0), "X8", F.round(t * 0.37, 2), "Unknown"),
        )
    )
    base = base.withColumn("value", F.when((c == 5) & (C("member") == "A"), C("value") * 1.5).otherwise(C("value")))
    base = base.drop("total", "sub", "first")
    extra = tot.select("cik", "qn", F.inline(rows))
    return base.unionByName(extra), tot.select("cik", "qn", "total")


def addup(spark, sf):
    seg, tot = addup_inputs(spark, sf)
    return Q.segment_addup(seg, tot, ["cik", "qn"], "member", "name", is_geography(C("name"), C("member")))


@query(
    "d09_segment_addup",
    f"WITH {_ADD} SELECT cik, qn, member, name, step, n_kept, round(sum_kept, 2) AS sum_kept, CAST(abs(sum_kept - total) <= tol AS INT) AS ok FROM fin",
)
def d09(spark, sf):
    return addup(spark, sf).select("cik", "qn", "member", "name", "step", "n_kept", F.round("sum_kept", 2).alias("sum_kept"), *ints("ok"))


@query(
    "c22_subtotal_pair_search",
    f"WITH {_ADD} SELECT cik, qn, string_agg(member, '+' ORDER BY member) AS dropped FROM fin WHERE step = 'subtotal' GROUP BY 1, 2",
)
def c22(spark, sf):
    d = addup(spark, sf).where(C("step") == "subtotal")
    # at most two members of a filing are dropped here
    return d.groupBy("cik", "qn").agg(F.array_join(F.array_sort(F.collect_list("member")), "+").alias("dropped"))


@query(
    "d10_derived_parent",
    """WITH parts AS (SELECT cik, qn, segment, rev FROM fq_seg), f AS (SELECT cik, qn, rev FROM fq_gap)
SELECT cik, qn, rev AS value, 'reported' AS source FROM f UNION ALL SELECT cik, qn, round(sum(rev), 4), 'derived' FROM parts p WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.cik = p.cik AND f.qn = p.qn) GROUP BY 1, 2""",
)
def d10(spark, sf):
    parts = V.fq_seg(spark, sf).select("cik", "qn", C("rev").alias("value"))
    facts = V.fq_gap(spark, sf).select("cik", "qn", C("rev").alias("value"))
    return Q.derived_parent(parts, facts, ["cik"], "qn").withColumn("value", F.round("value", 4))


@query(
    "c23_tag_swap_join",
    """WITH f AS (SELECT cik, qn, segment AS name, rev AS value FROM fq_seg),
pl AS (SELECT cik, qn, value, CASE WHEN (cik + qn) % 4 = 1 THEN CASE name WHEN 'A' THEN 'N' WHEN 'N' THEN 'R' ELSE 'A' END WHEN (cik + qn) % 4 = 2 THEN 'A' WHEN (cik + qn) % 4 = 3 THEN name END AS label FROM f),
j AS (SELECT f.*, coalesce(p.label, f.name) AS after FROM f LEFT JOIN pl p ON p.cik = f.cik AND p.qn = f.qn AND round(p.value, 3) = round(f.value, 3) AND p.label IS NOT NULL),
g AS (SELECT cik, qn, count(DISTINCT after) = count(*) AS ok FROM j GROUP BY 1, 2)
SELECT cik, qn, value, CASE WHEN ok THEN after ELSE name END AS name, CASE WHEN ok AND after <> name THEN name END AS relabeled_from FROM j JOIN g USING (cik, qn)""",
)
def c23(spark, sf):
    f = V.fq_seg(spark, sf).select("cik", "qn", C("segment").alias("name"), C("rev").alias("value"))
    c = (C("cik") + C("qn")) % 4
    turn = F.when(C("name") == "A", "N").when(C("name") == "N", "R").otherwise("A")
    label = F.when(c == 1, turn).when(c == 2, "A").when(c == 3, C("name"))
    p = f.select("cik", "qn", "value", label.alias("label")).where(C("label").isNotNull())
    return Q.swap_labels(f, p, ["cik", "qn"], ["cik", "qn"], "name").select("cik", "qn", "value", "name", "relabeled_from")


@query(
    "c24_scheme_first_filing",
    """WITH x AS (SELECT CAST(l_suppkey AS INT) AS cik, CAST(year(l_shipdate) AS INT) AS yr, l_returnflag AS name, CAST(o_orderdate AS DATE) AS filed, l_orderkey AS accn, l_extendedprice AS v FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
f AS (SELECT cik, yr, min((filed, accn)) AS f, max((filed, accn)) AS l FROM x GROUP BY 1, 2),
a AS (SELECT cik, yr, name, round(sum(v), 2) AS first FROM x JOIN f USING (cik, yr) WHERE (filed, accn) = f GROUP BY 1, 2, 3), b AS (SELECT cik, yr, name, round(sum(v), 2) AS latest FROM x JOIN f USING (cik, yr) WHERE (filed, accn) = l GROUP BY 1, 2, 3)
SELECT cik, yr, name, first, latest FROM a FULL JOIN b USING (cik, yr, name)""",
)
def c24(spark, sf):
    li, o = V.table(spark, sf, "lineitem"), V.table(spark, sf, "orders")
    x = li.join(o, C("l_orderkey") == C("o_orderkey")).select(
        C("l_suppkey").cast("int").alias("cik"), F.year("l_shipdate").alias("yr"), C("l_returnflag").alias("name"),
        C("o_orderdate").cast("date").alias("filed"), C("l_orderkey").alias("accn"), C("l_extendedprice").alias("v"),
    )
    k = ["cik", "yr", "name"]
    a = Q.first_scheme(x, ["cik", "yr"]).groupBy(*k).agg(F.round(F.sum("v"), 2).alias("first"))
    b = Q.first_scheme(x, ["cik", "yr"], last=True).groupBy(*k).agg(F.round(F.sum("v"), 2).alias("latest"))
    return a.join(b, k, "full")


@query(
    "d12_annual_tie",
    f"""WITH {_CUM}, {_V2},
an AS (SELECT cik, qn, first, first_filed FROM fv WHERE dur = 12), qs AS (SELECT cik, qn, value, filed FROM facts WHERE dur = 3),
po AS (SELECT an.cik, an.qn AS yq, an.first AS annual, q.qn, arg_max(q.value, q.filed) AS v FROM an JOIN qs q ON q.cik = an.cik AND q.qn // 4 = an.qn // 4 AND q.filed <= an.first_filed GROUP BY 1, 2, 3, 4),
s AS (SELECT cik, yq, annual, sum(v) AS s, count(*) AS n FROM po GROUP BY 1, 2, 3)
SELECT cik, CAST(yq // 4 AS INT) AS yr, round(s, 4) AS quarters, annual, CASE WHEN abs(s - annual) <= 0.002 * abs(annual) + 1 THEN 'ok' ELSE 'differs' END AS status FROM s WHERE n = 4""",
)
def d12(spark, sf):
    f = cumulative_facts(spark, sf)
    a = N.first_filed(f.where(C("duration_months") == 12), ["cik", "qn"]).select(
        "cik", F.floor(C("qn") / 4).cast("int").alias("yr"), C("value").alias("annual"), C("filed").alias("annual_filed")
    )
    q = f.where(C("duration_months") == 3).withColumn("yr", F.floor(C("qn") / 4).cast("int"))
    p = q.join(a, ["cik", "yr"]).where(C("filed") <= C("annual_filed"))
    p = p.groupBy("cik", "yr", "annual", "qn").agg(F.max_by("value", "filed").alias("v"))
    s = p.groupBy("cik", "yr", "annual").agg(F.sum("v").alias("quarters"), F.count(F.lit(1)).alias("n")).where(C("n") == 4)
    st = Q.tie_status(C("quarters"), C("annual"), 0.002, 1.0)
    return s.select("cik", "yr", F.round("quarters", 4).alias("quarters"), "annual", st.alias("status"))


@query(
    "d14_share_sum_check",
    """WITH s AS (SELECT cik, qn, segment, round(rev / sum(rev) OVER (PARTITION BY cik, qn) * 100, 0) AS pct FROM fq_seg), g AS (SELECT cik, qn, sum(pct) AS total FROM s WHERE NOT ((cik + qn) % 6 = 0 AND segment = 'N') GROUP BY 1, 2)
SELECT cik, qn, total, CASE WHEN total BETWEEN 97 AND 103 THEN 'complete' WHEN total > 100.5 THEN 'over' ELSE 'partial' END AS status FROM g""",
)
def d14(spark, sf):
    s = V.fq_seg(spark, sf)
    t = s.groupBy("cik", "qn").agg(F.sum("rev").alias("t"))
    s = s.join(t, ["cik", "qn"]).withColumn("pct", F.round(C("rev") / C("t") * 100, 0))
    s = s.where(~(((C("cik") + C("qn")) % 6 == 0) & (C("segment") == "N")))
    return Q.share_check(s, ["cik", "qn"], "pct")


@query(
    "c15_anti_existing_key",
    "SELECT cik, segment, qn, rev FROM fq_seg s WHERE NOT EXISTS (SELECT 1 FROM fq_gap g WHERE g.cik = s.cik AND g.qn = s.qn)",
)
def c15(spark, sf):
    return V.fq_seg(spark, sf).join(V.fq_gap(spark, sf).select("cik", "qn"), ["cik", "qn"], "left_anti").select("cik", "segment", "qn", "rev")


@query(
    "c21_alias_join",
    """WITH a AS (SELECT DISTINCT p_name AS label FROM part), k AS (SELECT label, regexp_replace(lower(replace(label, '&', 'and')), '[^a-z0-9]', '', 'g') AS key FROM a),
b AS (SELECT DISTINCT upper(p_name) || ' Segment' AS printed, regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g') AS key FROM part) SELECT printed, label FROM b JOIN k USING (key)""",
)
def c21(spark, sf):
    p = V.table(spark, sf, "part").select("p_name").distinct()
    a = p.select(C("p_name").alias("label"), name_key(C("p_name")).alias("key"))
    b = p.select(F.concat(F.upper("p_name"), F.lit(" Segment")).alias("printed"))
    return b.withColumn("key", name_key(C("printed"))).join(a, "key").select("printed", "label")


@query(
    "h07_normalise_name",
    """SELECT DISTINCT 'Reportable Segments: ' || p_name || ' (1)' AS raw, p_name AS name FROM part UNION ALL SELECT DISTINCT 'Unallocated', 'All Other' FROM part""",
)
def h07(spark, sf):
    p = V.table(spark, sf, "part").select("p_name").distinct()
    raw = F.explode(F.array(F.concat(F.lit("Reportable Segments: "), "p_name", F.lit(" (1)")), F.lit("Unallocated")))
    d = p.select(raw.alias("raw")).distinct()
    return d.withColumn("name", normalise_name(C("raw")))


@query("d26_status_counts", "SELECT o_orderstatus AS status, count(*) FILTER (WHERE o_orderpriority LIKE '1%') AS urgent, count(*) FILTER (WHERE o_orderpriority NOT LIKE '1%') AS other FROM orders GROUP BY 1")
def d26(spark, sf):
    o = V.table(spark, sf, "orders").select(
        C("o_orderstatus").alias("status"), F.when(C("o_orderpriority").startswith("1"), "urgent").otherwise("other").alias("k")
    )
    return o.groupBy("status").pivot("k", ["urgent", "other"]).count().na.fill(0)


@query(
    "d20_pivot",
    """SELECT cik, round(sum(CASE WHEN segment = 'A' THEN rev END), 4) AS "A", round(sum(CASE WHEN segment = 'N' THEN rev END), 4) AS "N", round(sum(CASE WHEN segment = 'R' THEN rev END), 4) AS "R" FROM fq_seg GROUP BY 1""",
)
def d20(spark, sf):
    return V.fq_seg(spark, sf).groupBy("cik").pivot("segment", ["A", "N", "R"]).agg(F.round(F.sum("rev"), 4))


@query(
    "d22_unpivot",
    "SELECT CAST(o_orderkey AS INT) AS accn, 'total' AS metric, o_totalprice AS value FROM orders UNION ALL SELECT CAST(o_orderkey AS INT), 'half', o_totalprice / 2 FROM orders",
)
def d22(spark, sf):
    o = V.table(spark, sf, "orders").select(
        C("o_orderkey").cast("int").alias("accn"), C("o_totalprice").alias("total"), (C("o_totalprice") / 2).alias("half")
    )
    return o.unpivot("accn", ["total", "half"], "metric", "value")


@query(
    "d18_coverage_rollup",
    """SELECT cik, count(*) AS quarters, min(qn) AS first_q, max(qn) AS last_q, count(DISTINCT qn // 4) AS years, round(avg(CASE WHEN rev > 1000000 THEN 1.0 ELSE 0.0 END), 6) AS over_rate FROM fq_gap GROUP BY 1""",
)
def d18(spark, sf):
    return V.fq_gap(spark, sf).groupBy("cik").agg(
        F.count(F.lit(1)).alias("quarters"), F.min("qn").alias("first_q"), F.max("qn").alias("last_q"),
        F.countDistinct(F.floor(C("qn") / 4)).alias("years"),
        F.round(F.avg((C("rev") > 1000000).cast("double")), 6).alias("over_rate"),
    )
