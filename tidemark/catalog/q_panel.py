"""Bookings panel, screens and the point-in-time panel."""

from pyspark.sql import Window, functions as F

from tidemark.catalog import views as V
from tidemark.catalog.registry import query
from tidemark.functions.dates import quarter_end
from tidemark.operators import asof, windows as W
from tidemark.plans import panel as P
from tidemark.session import cut_lineage

C = F.col
CURRENT = 8003  # 2000Q4 as an ordinal

_QE = "last_day(make_date(CAST(({q}) // 4 AS INT), CAST(({q}) % 4 * 3 + 3 AS INT), 1))"


def frames(spark, sf):
    """Frame observations: quarter revenue under three tags, year figures, backlog and two contract balances."""
    seg = V.fq_seg(spark, sf).where((C("cik") * 7 + C("qn") * 5 + F.ascii("segment")) % 9 != 0)
    name = F.concat(F.lit("Filer "), C("cik").cast("string"))

    def obs(df, metric, tag, cy, cq, start, end, val, prio):
        return df.select(
            "cik",
            name.alias("entityName"),
            start.alias("start"),
            end.alias("end"),
            val.alias("val"),
            F.lit(metric).alias("metric"),
            tag.alias("tag"),
            cy.cast("int").alias("cy"),
            cq.cast("int").alias("cq"),
            prio.cast("int").alias("prio"),
        )

    cy, cq = F.floor(C("qn") / 4), C("qn") % 4 + 1
    qs = F.date_add(quarter_end(C("qn") - 1), 1)
    prio = F.when(C("segment") == "N", 0).when(C("segment") == "A", 1).otherwise(2)
    q = seg.where(~((C("qn") % 4 == 3) & (C("cik") % 2 == 0)))
    fy = V.fq_seg(spark, sf).groupBy("cik", "segment", cy.alias("cy")).agg(F.round(F.sum("rev"), 4).alias("rev"))
    odd = F.when(C("cik") % 7 == 0, 1.5).otherwise(1.0)
    y0, y1 = F.make_date("cy", F.lit(1), F.lit(1)), F.make_date("cy", F.lit(12), F.lit(31))
    # a balance outstanding: what was booked over the last four quarters
    year = Window.partitionBy("cik").orderBy("qn").rangeBetween(-3, 0)
    scope = F.when((C("cik") % 4 == 1) & (C("qn") >= 8007), 2).otherwise(1)  # some widen what they disclose at the end
    bal = V.fq_bal(spark, sf).withColumn("rpo", F.round(F.sum("rpo").over(year), 2) * scope).where((C("cik") + C("qn")) % 13 != 0)
    none = F.lit(None).cast("date")
    parts = [
        obs(q, "rev", C("segment"), cy, cq, qs, quarter_end(C("qn")), C("rev") * 1000, prio),
        obs(fy, "rev_fy", C("segment"), C("cy"), F.lit(0), y0, y1, C("rev") * 1000 * odd, F.lit(0)),
    ]
    # the three balances of a filer and quarter come out of one pass over the lines
    three = F.inline(
        F.array(
            *[
                F.struct((C("rpo") * k).alias("val"), F.lit(m).alias("metric"), F.lit(t).alias("tag"))
                for m, t, k in (("rpo", "B", 50), ("dr_cur", "D", 5), ("dr_tot", "T", 7))
            ]
        )
    )
    b = bal.select(
        "cik",
        name.alias("entityName"),
        none.alias("start"),
        quarter_end(C("qn")).alias("end"),
        cy.cast("int").alias("cy"),
        cq.cast("int").alias("cq"),
        F.lit(0).alias("prio"),
        three,
    )
    return parts[0].unionByName(parts[1]).unionByName(b)


_PANEL = """t AS (SELECT * FROM fq_seg WHERE (cik*7 + qn*5 + ascii(segment)) % 9 <> 0 AND NOT (qn % 4 = 3 AND cik % 2 = 0)),
ps AS (SELECT cik, segment, count(*) AS n, median(rev * 1000) AS med FROM t GROUP BY 1, 2),
pick AS (SELECT cik, segment FROM (SELECT *, row_number() OVER (PARTITION BY cik ORDER BY n DESC, med DESC, segment) AS k FROM ps) WHERE k = 1),
rev0 AS (SELECT t.cik, t.qn, t.rev * 1000 AS rev, t.segment AS tag FROM t JOIN pick p ON t.cik = p.cik AND t.segment = p.segment),
fy AS (SELECT s.cik, s.qn // 4 AS cy, round(sum(s.rev), 4) * 1000 * CASE WHEN s.cik % 7 = 0 THEN CAST(1.5 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END AS val
       FROM fq_seg s JOIN pick p ON s.cik = p.cik AND s.segment = p.segment GROUP BY s.cik, s.qn // 4),
q123 AS (SELECT cik, qn // 4 AS cy, sum(rev) AS s FROM rev0 WHERE qn % 4 < 3 GROUP BY 1, 2 HAVING count(*) = 3),
d4 AS (SELECT fy.cik, CAST(fy.cy * 4 + 3 AS INT) AS qn, fy.val - q123.s AS rev, 'derived Q4 = FY - 9M' AS tag FROM fy JOIN q123 USING (cik, cy)
       WHERE fy.val - q123.s > 0 AND NOT EXISTS (SELECT 1 FROM rev0 r WHERE r.cik = fy.cik AND r.qn = fy.cy * 4 + 3)),
rev1 AS (SELECT * FROM rev0 UNION ALL SELECT * FROM d4),
bal AS (SELECT cik, qn, rpo * 50 AS rpo, rpo * 5 AS dr_cur, rpo * 7 AS dr_tot FROM (SELECT cik, qn, round(sum(rpo) OVER (PARTITION BY cik ORDER BY qn RANGE BETWEEN 3 PRECEDING AND CURRENT ROW), 2) * CASE WHEN cik % 4 = 1 AND qn >= 8007 THEN 2 ELSE 1 END AS rpo FROM fq_bal) WHERE (cik + qn) % 13 <> 0),
p0 AS (SELECT coalesce(r.cik, b.cik) AS cik, coalesce(r.qn, b.qn) AS qn, r.rev / 1e6 AS rev, r.tag, b.rpo / 1e6 AS rpo, b.dr_cur / 1e6 AS dr_cur, b.dr_tot / 1e6 AS dr_tot
       FROM rev1 r FULL JOIN bal b ON r.cik = b.cik AND r.qn = b.qn),
p1 AS (SELECT *, qn - lag(qn) OVER w AS gap, CASE WHEN qn - lag(qn) OVER w = 1 THEN rpo - lag(rpo) OVER w END AS d_rpo FROM p0 WINDOW w AS (PARTITION BY cik ORDER BY qn)),
p2 AS (SELECT *, rev + d_rpo AS bookings, (rev + d_rpo) / rev AS b2b, rpo / rev AS rpo_cover_q FROM p1),
p3 AS (SELECT a.*, y.rpo AS rpo_yago, y.rev AS rev_yago, y.b2b AS b2b_yago, a.rpo / y.rpo - 1 AS rpo_yoy, a.rev / y.rev - 1 AS rev_yoy, a.b2b - y.b2b AS b2b_chg_yoy
       FROM p2 a LEFT JOIN p2 y ON a.cik = y.cik AND a.qn = y.qn + 4),
p4 AS (SELECT *, CASE WHEN count(b2b) OVER w4 >= 3 THEN avg(b2b) OVER w4 END AS b2b_4q, CASE WHEN gap = 1 THEN rpo_yoy - lag(rpo_yoy) OVER w END AS rpo_yoy_accel,
       count(rpo) OVER w AS rpo_quarters, coalesce(rpo_cover_q > 40, false) AS flag_implausible_rpo, coalesce(abs(d_rpo / nullif(rpo - d_rpo, 0)) > 0.5, false) AS flag_rpo_step
       FROM p3 WINDOW w AS (PARTITION BY cik ORDER BY qn), w4 AS (PARTITION BY cik ORDER BY qn ROWS 3 PRECEDING)),
ann AS (SELECT cik, qn // 4 AS cy, sum(rev) AS q FROM p4 GROUP BY 1, 2 HAVING count(*) = 4 AND NOT bool_or(coalesce(tag = 'derived Q4 = FY - 9M', false))),
chk AS (SELECT ann.cik, abs(q / (val / 1e6) - 1) > 0.2 AS bad FROM ann JOIN fy USING (cik, cy)),
panel AS (SELECT p4.*, coalesce((SELECT bool_or(bad) FROM chk WHERE chk.cik = p4.cik), false) AS flag_revenue_mismatch,
       EXISTS (SELECT 1 FROM chk WHERE chk.cik = p4.cik) AS revenue_check_ran FROM p4),
lat0 AS (SELECT *, NOT (flag_implausible_rpo OR flag_revenue_mismatch) AS clean,
       avg(b2b) OVER (PARTITION BY cik ORDER BY qn ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS b2b_prev3,
       row_number() OVER (PARTITION BY cik ORDER BY qn DESC) AS k FROM panel WHERE b2b IS NOT NULL),
latest AS (SELECT *, b2b - b2b_prev3 AS b2b_trend,
       coalesce(rpo_cover_q >= 1 AND rev >= 25 AND qn >= 8003 AND clean AND rpo_quarters >= 5, false) AS gated FROM lat0 WHERE k = 1)"""

_R = ["rev", "rpo", "b2b", "rpo_cover_q", "rpo_yoy", "rev_yoy", "b2b_chg_yoy", "b2b_4q", "rpo_yoy_accel"]
_RS = ", ".join(f"round({c}, {8 if c in ('rev', 'rpo') else 6}) AS {c}" for c in _R)


def r6(*cols):
    return [F.round(C(c), 8 if c in ("rev", "rpo", "bookings") else 6).alias(c) for c in cols]


def panel(spark, sf):
    return P.bookings_panel(frames(spark, sf))


def latest(spark, sf):
    return P.latest_rows(panel(spark, sf), CURRENT)


def ints(*cols):
    return [C(c).cast("int").alias(c) for c in cols]


@query(
    "k01_bookings_panel",
    f"""WITH {_PANEL} SELECT cik, qn, tag, {_RS}, round(dr_cur, 8) AS dr_cur, round(dr_tot, 8) AS dr_tot, round(bookings, 8) AS bookings, rpo_quarters,
CAST(flag_implausible_rpo AS INT) AS flag_implausible_rpo, CAST(flag_rpo_step AS INT) AS flag_rpo_step, CAST(flag_revenue_mismatch AS INT) AS flag_revenue_mismatch FROM panel""",
)
def k01(spark, sf):
    return panel(spark, sf).select(
        "cik",
        "qn",
        "tag",
        *r6(*_R, "bookings"),
        F.round("dr_cur", 8).alias("dr_cur"),
        F.round("dr_tot", 8).alias("dr_tot"),
        "rpo_quarters",
        *ints("flag_implausible_rpo", "flag_rpo_step", "flag_revenue_mismatch"),
    )


@query("c02_panel_outer_join", f"WITH {_PANEL} SELECT cik, qn, round(rev, 8) AS rev, round(rpo, 8) AS rpo FROM p0")
def c02(spark, sf):
    return panel(spark, sf).select("cik", "qn", *r6("rev", "rpo"))


@query(
    "c16_semi_flag",
    f"WITH {_PANEL} SELECT DISTINCT cik, CAST(flag_revenue_mismatch AS INT) AS mismatch, CAST(revenue_check_ran AS INT) AS checked FROM panel",
)
def c16(spark, sf):
    return panel(spark, sf).select(
        "cik", C("flag_revenue_mismatch").cast("int").alias("mismatch"), C("revenue_check_ran").cast("int").alias("checked")
    ).distinct()


@query(
    "b08_quality_flags",
    f"""WITH {_PANEL} SELECT CAST(flag_implausible_rpo AS INT) AS implausible, CAST(flag_rpo_step AS INT) AS step, CAST(flag_revenue_mismatch AS INT) AS mismatch, count(*) AS n FROM panel GROUP BY 1, 2, 3""",
)
def b08(spark, sf):
    return panel(spark, sf).groupBy(
        C("flag_implausible_rpo").cast("int").alias("implausible"),
        C("flag_rpo_step").cast("int").alias("step"),
        C("flag_revenue_mismatch").cast("int").alias("mismatch"),
    ).agg(F.count(F.lit(1)).alias("n"))


@query(
    "b09_screen_gate",
    f"WITH {_PANEL} SELECT cik, qn, CAST(gated AS INT) AS gated, round(b2b_trend, 6) AS b2b_trend FROM latest",
)
def b09(spark, sf):
    return latest(spark, sf).select("cik", "qn", *ints("gated"), *r6("b2b_trend"))


_SCREEN_SQL = {
    "b10_screen_backlog_ahead": ("backlog_ahead", "b2b > 1.05 AND b2b_trend > 0 AND rev_yoy < 0.15 AND NOT flag_rpo_step"),
    "b11_screen_accelerating": ("accelerating", "rpo_yoy_accel > 0 AND b2b > 1.0 AND rpo_yoy > 0 AND NOT flag_rpo_step"),
    "b12_screen_borrowing": ("borrowing", "rev_yoy > 0.02 AND b2b < 0.95"),
    "b13_screen_rpo_step": ("rpo_step", "rpo / (rpo - d_rpo) > 1.5 AND d_rpo > 100"),
}


def _screen(key, screen, where):
    @query(key, f"WITH {_PANEL} SELECT cik, qn, {_RS} FROM latest WHERE gated AND {where}")
    def run(spark, sf):
        return P.screens(latest(spark, sf))[screen].select("cik", "qn", *r6(*_R))


for _k, (_s, _w) in _SCREEN_SQL.items():
    _screen(_k, _s, _w)


@query(
    "k02_bookings_screens",
    "WITH "
    + _PANEL
    + "\n"
    + " UNION ALL ".join(
        f"SELECT '{s}' AS screen, cik, qn, round(b2b, 6) AS b2b FROM latest WHERE gated AND {w}" for s, w in _SCREEN_SQL.values()
    ),
)
def k02(spark, sf):
    return P.screened(latest(spark, sf)).select("screen", "cik", "qn", *r6("b2b"))


@query(
    "b14_exclusion_reason",
    f"""WITH {_PANEL} SELECT CASE WHEN gated THEN NULL WHEN NOT coalesce(rpo_cover_q >= 1, false) THEN 'RPO cover below 1 quarter'
 WHEN NOT coalesce(rev >= 25, false) THEN 'revenue below $25m/quarter' WHEN qn < 8003 THEN 'last report is stale'
 WHEN NOT clean THEN 'failed a data-quality flag' ELSE 'under 5 quarters of RPO history' END AS reason, count(*) AS n FROM latest GROUP BY 1""",
)
def b14(spark, sf):
    return latest(spark, sf).groupBy(P.exclusion_reason(CURRENT).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "b15_shortlist",
    f"WITH {_PANEL} SELECT cik, round(b2b, 6) AS b2b FROM latest WHERE gated AND (b2b > 1.05 OR rpo_yoy_accel > 0.1)",
)
def b15(spark, sf):
    keep = C("gated") & ((C("b2b") > 1.05) | (C("rpo_yoy_accel") > 0.1))
    return latest(spark, sf).where(keep).select("cik", *r6("b2b"))


@query(
    "c20_dimension_lookup",
    f"""WITH {_PANEL} SELECT l.cik, l.qn, s_name AS name, n_name AS industry, coalesce(CASE WHEN s_acctbal > 0 THEN s_name END, 'CIK ' || CAST(l.cik AS VARCHAR)) AS ticker
FROM latest l LEFT JOIN supplier ON s_suppkey = l.cik LEFT JOIN nation ON s_nationkey = n_nationkey""",
)
def c20(spark, sf):
    d = P.latest_rows(panel(spark, sf), CURRENT, filer_names(spark, sf))
    return d.select(
        "cik",
        "qn",
        C("filer").alias("name"),
        "industry",
        F.coalesce("ticker", F.concat(F.lit("CIK "), C("cik").cast("string"))).alias("ticker"),
    )


def filer_names(spark, sf):
    s = V.table(spark, sf, "supplier").join(
        V.table(spark, sf, "nation"), C("s_nationkey") == C("n_nationkey"), "left"
    )
    return s.select(
        C("s_suppkey").cast("int").alias("cik"),
        C("s_name").alias("filer"),
        F.when(C("s_acctbal") > 0, C("s_name")).alias("ticker"),
        C("n_name").alias("industry"),
    )


@query(
    "d17_industry_rollup",
    f"""WITH {_PANEL}, x AS (SELECT l.*, n_name AS industry FROM latest l JOIN supplier ON s_suppkey = l.cik JOIN nation ON s_nationkey = n_nationkey)
SELECT industry, count(*) AS names, round(avg(CASE WHEN b2b_trend > 0 THEN 1.0 WHEN b2b_trend <= 0 THEN 0.0 END), 6) AS rising, round(median(b2b), 6) AS b2b_median,
round(median(rpo_yoy), 6) AS rpo_yoy_median, round(median(rev_yoy), 6) AS rev_yoy_median FROM x GROUP BY 1 HAVING count(*) >= 3""",
)
def d17(spark, sf):
    d = cut_lineage(P.latest_rows(panel(spark, sf), CURRENT, filer_names(spark, sf)))
    return P.industry_rollup(d).select(
        "industry", "names", *r6("rising", "b2b_median", "rpo_yoy_median", "rev_yoy_median")
    )


@query(
    "d21_trajectory_pivot",
    "WITH x AS (SELECT cik, rev, row_number() OVER (PARTITION BY cik ORDER BY qn DESC) - 1 AS k FROM fq_gap) SELECT cik, "
    + ", ".join(f"max(CASE WHEN k = {i} THEN rev END) AS t{i}" for i in range(8))
    + " FROM x GROUP BY cik",
)
def d21(spark, sf):
    return P.trajectory(V.fq_gap(spark, sf), ["cik"], "qn", "rev")


@query(
    "d23_distribution",
    f"""WITH {_PANEL} SELECT count(rpo_cover_q) AS n, round(avg(rpo_cover_q), 6) AS mean, round(min(rpo_cover_q), 6) AS low, round(quantile_cont(rpo_cover_q, 0.05), 6) AS p05,
round(quantile_cont(rpo_cover_q, 0.5), 6) AS p50, round(quantile_cont(rpo_cover_q, 0.95), 6) AS p95, round(max(rpo_cover_q), 6) AS high FROM latest""",
)
def d23(spark, sf):
    from tidemark.operators.ranks import percentiles

    d = cut_lineage(latest(spark, sf).select("rpo_cover_q"))
    x = d.agg(F.avg("rpo_cover_q").alias("mean"), F.min("rpo_cover_q").alias("low"), F.max("rpo_cover_q").alias("high"))
    q = percentiles(d, [], "rpo_cover_q", {"p05": 0.05, "p50": 0.5, "p95": 0.95})
    both = q.withColumn("s", x.select(F.struct("mean", "low", "high")).scalar())
    return both.select("n", *r6("p05", "p50", "p95"), *[F.round(C(f"s.{c}"), 6).alias(c) for c in ("mean", "low", "high")])


@query(
    "d34_panel_coverage_counts",
    f"""WITH {_PANEL} SELECT count(*) AS rows, count(DISTINCT cik) AS filers, count(rpo) AS with_rpo, count(DISTINCT CASE WHEN rpo IS NOT NULL THEN cik END) AS rpo_filers,
count(*) FILTER (WHERE rpo IS NOT NULL AND rev IS NOT NULL) AS both, count(*) FILTER (WHERE tag = 'derived Q4 = FY - 9M') AS derived, count(b2b) AS with_b2b FROM panel""",
)
def d34(spark, sf):
    return panel(spark, sf).agg(
        F.count(F.lit(1)).alias("rows"),
        F.countDistinct("cik").alias("filers"),
        F.count("rpo").alias("with_rpo"),
        F.countDistinct(F.when(C("rpo").isNotNull(), C("cik"))).alias("rpo_filers"),
        F.count_if(C("rpo").isNotNull() & C("rev").isNotNull()).alias("both"),
        F.count_if(C("tag") == P.DERIVED).alias("derived"),
        F.count("b2b").alias("with_b2b"),
    )


# ---------------------------------------------------------------- point in time
_PIT = """rv AS (SELECT cik, qn, CAST(last_day(make_date(CAST(qn // 4 AS INT), CAST(qn % 4 * 3 + 3 AS INT), 1)) AS DATE) AS rev_end, rev * 100 AS rev FROM fq_gap),
rv2 AS (SELECT cik, rev_end, rev, rev_end + CAST(25 + cik % 40 AS INT) AS rev_filed FROM rv),
rp AS (SELECT cik, CAST(last_day(make_date(CAST(qn // 4 AS INT), CAST(qn % 4 * 3 + 3 AS INT), 1)) AS DATE) - CAST((cik + qn) % 8 AS INT) AS pend, rpo * 20 AS rpo FROM fq_bal),
rp2 AS (SELECT cik, pend, rpo, pend + CAST(35 + (cik * 3 + year(pend)) % 90 AS INT) AS rpo_filed FROM rp),
c0 AS (SELECT p.cik, p.pend, p.rpo, p.rpo_filed, r.rev, r.rev_filed, row_number() OVER (PARTITION BY p.cik, p.pend ORDER BY abs(r.rev_end - p.pend), r.rev_end) AS k
       FROM rp2 p JOIN rv2 r ON p.cik = r.cik AND abs(r.rev_end - p.pend) <= 6),
c1 AS (SELECT cik, pend, rpo, rpo_filed, rev, rev_filed, CASE WHEN pend - lag(pend) OVER w BETWEEN 75 AND 105 THEN lag(rpo) OVER w END AS rpo_prev, lag(rpo_filed) OVER w AS prev_filed
       FROM c0 WHERE k = 1 WINDOW w AS (PARTITION BY cik ORDER BY pend)),
c2 AS (SELECT *, (rev + rpo - rpo_prev) / rev AS b2b, rpo / rev AS cover, rpo / rpo_prev AS step FROM c1),
c3 AS (SELECT *, b2b - CASE WHEN count(b2b) OVER w = 3 THEN avg(b2b) OVER w END AS b2b_trend FROM c2 WINDOW w AS (PARTITION BY cik ORDER BY pend ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)),
yg AS (SELECT a.cik, a.pend, y.rev AS rev_yago, y.rpo AS rpo_yago, row_number() OVER (PARTITION BY a.cik, a.pend ORDER BY abs(CAST(y.pend + INTERVAL 12 MONTH AS DATE) - a.pend), CAST(y.pend + INTERVAL 12 MONTH AS DATE)) AS k
       FROM c3 a JOIN c3 y ON a.cik = y.cik AND abs(CAST(y.pend + INTERVAL 12 MONTH AS DATE) - a.pend) <= 10),
pit AS (SELECT c3.*, rev / rev_yago - 1 AS rev_yoy, rpo / rpo_yago - 1 AS rpo_yoy, greatest(rpo_filed, rev_filed, prev_filed) AS known
        FROM c3 LEFT JOIN yg ON c3.cik = yg.cik AND c3.pend = yg.pend AND yg.k = 1)"""


def pit_inputs(spark, sf):
    rv = V.fq_gap(spark, sf).select("cik", quarter_end(C("qn")).alias("rev_end"), (C("rev") * 100).alias("rev"))
    rv = rv.withColumn("rev_filed", F.date_add("rev_end", 25 + C("cik") % 40))
    rp = V.fq_bal(spark, sf).select(
        "cik", F.date_sub(quarter_end(C("qn")), (C("cik") + C("qn")) % 8).alias("end"), (C("rpo") * 20).alias("rpo")
    )
    return rv, rp.withColumn("rpo_filed", F.date_add("end", 35 + (C("cik") * 3 + F.year("end")) % 90))


def pit(spark, sf):
    return P.point_in_time_panel(*pit_inputs(spark, sf))


def day(c, name=None):
    return C(c).cast("string").alias(name or c)


@query(
    "k07_point_in_time_b2b",
    f"""WITH {_PIT} SELECT cik, CAST(pend AS VARCHAR) AS pend, round(b2b, 6) AS b2b, round(cover, 6) AS cover, round(step, 6) AS step, round(b2b_trend, 6) AS b2b_trend,
round(rev_yoy, 6) AS rev_yoy, round(rpo_yoy, 6) AS rpo_yoy, CAST(known AS VARCHAR) AS known FROM pit""",
)
def k07(spark, sf):
    return pit(spark, sf).select(
        "cik", day("end", "pend"), *r6("b2b", "cover", "step", "b2b_trend", "rev_yoy", "rpo_yoy"), day("known")
    )


@query(
    "c04_nearest_asof",
    f"""WITH {_PIT} SELECT cik, CAST(pend AS VARCHAR) AS pend, rpo, rev FROM c0 WHERE k = 1""",
)
def c04(spark, sf):
    rv, rp = pit_inputs(spark, sf)
    d = asof.nearest(rp, rv, ["cik"], "end", "rev_end", ["rev"], 6).where(C("rev").isNotNull())
    return d.select("cik", day("end", "pend"), "rpo", "rev")


@query(
    "b16_b2b_eligible",
    f"""WITH {_PIT} SELECT cik, CAST(pend AS VARCHAR) AS pend, round(b2b, 6) AS b2b, CAST(coalesce(b2b > 1.05 AND b2b_trend > 0 AND rev_yoy < 0.15, false) AS INT) AS gate
FROM pit WHERE b2b IS NOT NULL AND known IS NOT NULL AND rev >= 25e6 AND cover BETWEEN 1 AND 40 AND step BETWEEN 1/1.5 AND 1.5 AND known - pend BETWEEN 0 AND 120""",
)
def b16(spark, sf):
    return P.eligible(pit(spark, sf)).select("cik", day("end", "pend"), *r6("b2b"), *ints("gate"))
