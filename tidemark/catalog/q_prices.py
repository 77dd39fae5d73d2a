"""Episodes, states, value paths and event tables on the daily price series."""

from pyspark.sql import Window, functions as F

from tidemark.catalog import views as V
from tidemark.catalog.q_windows import _FEAT, _PX2, P, day, features, forward, overlay, r6, with_benchmark
from tidemark.catalog.registry import query
from tidemark.operators import asof, episodes as E, ranks as R, stats as S, valuation as X, windows as W
from tidemark.session import cut_lineage

C = F.col

# greedy spacing as a recursive walk over one series' flagged rows
_STARTS = """hit AS (SELECT ticker, pos, lead(pos) OVER (PARTITION BY ticker ORDER BY pos) AS nxt FROM feat WHERE {on}),
wk AS (SELECT ticker, min(pos) AS pos FROM hit GROUP BY ticker
  UNION ALL SELECT w.ticker, (SELECT min(h.pos) FROM hit h WHERE h.ticker = w.ticker AND h.pos >= w.pos + 63) FROM wk w WHERE w.pos IS NOT NULL),
ep AS (SELECT ticker, pos FROM wk WHERE pos IS NOT NULL)"""


def starts_sql(on):
    return _STARTS.format(on=on)


@query(
    "e18_episode_starts",
    f"WITH RECURSIVE {_FEAT}, {starts_sql('resid_z <= -0.15')} SELECT ep.ticker, CAST(d AS VARCHAR) AS d FROM ep JOIN feat USING (ticker, pos)",
)
def e18(spark, sf):
    f = cut_lineage(features(with_benchmark(spark, sf)))
    s = E.starts(f, P, "pos", C("resid_z") <= -0.15)
    return f.join(s, ["ticker", "pos"]).select("ticker", day())


_TRIP = """tr AS (SELECT ticker, pos, d, coalesce(pos % 97 = 0, false) AS ent, coalesce(rel >= mx, false) AS up FROM
 (SELECT ticker, pos, d, rel, max(rel) OVER (PARTITION BY ticker ORDER BY pos ROWS BETWEEN 20 PRECEDING AND CURRENT ROW) AS mx FROM feat)),
st AS (SELECT ticker, pos, d, ent, up, max(CASE WHEN ent THEN pos END) OVER (PARTITION BY ticker ORDER BY pos) AS last FROM tr),
ex AS (SELECT ticker, last, min(pos) AS pos FROM st WHERE NOT ent AND last IS NOT NULL AND (up OR pos - last >= 30) GROUP BY ticker, last)"""


@query(
    "e19_trip_exits",
    f"WITH {_FEAT}, {_TRIP} SELECT ticker, CAST(pos AS INT) AS pos FROM ex",
)
def e19(spark, sf):
    f = features(with_benchmark(spark, sf))
    top = F.max("rel").over(Window.partitionBy("ticker").orderBy("pos").rowsBetween(-20, 0))
    d = f.withColumn("ent", C("pos") % 97 == 0).withColumn("up", C("rel") >= top)
    return E.trip_exits(d, P, "pos", "ent", "up", 30).select("ticker", C("pos").cast("int").alias("pos"))


@query(
    "e17_composite_signal",
    f"""WITH {_FEAT}, z AS (SELECT ticker, d, (rel_z + resid_z + ratio_dd + ra + rb) / 5 AS s FROM feat) SELECT ticker, CAST(d AS VARCHAR) AS d, round(s, 6) AS composite FROM z""",
)
def e17(spark, sf):
    f = features(with_benchmark(spark, sf))
    s = composite([C("rel_z"), C("resid_z"), C("ratio_dd"), C("ra"), C("rb")])
    return f.select("ticker", day(), r6(s, "composite"))


def composite(signals):
    """Plain mean of several signals; null as soon as one is missing."""
    total = signals[0]
    for s in signals[1:]:
        total = total + s
    return total / len(signals)


_EWMA = """b0 AS (SELECT ticker, d, px / lag(px) OVER (PARTITION BY ticker ORDER BY d) - 1 AS x FROM px),
b1 AS (SELECT ticker, d, x, row_number() OVER (PARTITION BY ticker ORDER BY d) AS i FROM b0 WHERE x IS NOT NULL),
ew AS (SELECT ticker, d, i, x AS y FROM b1 WHERE i = 1
  UNION ALL SELECT b.ticker, b.d, b.i, 2.0/11 * b.x + (1 - 2.0/11) * e.y FROM ew e JOIN b1 b ON b.ticker = e.ticker AND b.i = e.i + 1)"""


def smoothed(spark, sf):
    d = V.px(spark, sf).withColumn("x", C("px") / F.lag("px").over(W.series(P, "d")) - 1).where(C("x").isNotNull())
    return E.ewma(d, P, "d", "x", 10, "y")


@query("e24_ewma", f"WITH RECURSIVE {_EWMA} SELECT ticker, CAST(d AS VARCHAR) AS d, round(y, 6) AS y FROM ew")
def e24(spark, sf):
    return smoothed(spark, sf).select("ticker", day(), r6(C("y"), "y"))


_STATE = """s1 AS (SELECT b1.ticker, b1.d, b1.i, {on} AS a, {off} AS b FROM {src}),
hs AS (SELECT ticker, d, i, coalesce(a, false) AS st FROM s1 WHERE i = 1
  UNION ALL SELECT n.ticker, n.d, n.i, CASE WHEN NOT h.st THEN coalesce(n.a, false) ELSE NOT coalesce(n.b, false) END FROM hs h JOIN s1 n ON n.ticker = h.ticker AND n.i = h.i + 1)"""


@query(
    "e25_hysteresis_state",
    f"""WITH RECURSIVE {_EWMA}, {_STATE.format(on='y > 0.02', off='y < 0.03', src='(SELECT * FROM ew) b1')}
SELECT ticker, CAST(d AS VARCHAR) AS d, CAST(st AS INT) AS is_on FROM hs""",
)
def e25(spark, sf):
    # the two zones overlap on purpose: between 0.02 and 0.03 both hold and the state flips
    d = smoothed(spark, sf).withColumn("y", F.round("y", 9))
    d = E.on_off_state(d, P, "d", C("y") > 0.02, C("y") < 0.03)
    return d.select("ticker", day(), C("on").cast("int").alias("is_on"))


_FLAG = """fl AS (SELECT ticker, d, row_number() OVER (PARTITION BY ticker ORDER BY d) AS i, date_diff('day', DATE '1995-01-01', d) AS k FROM px),
b1 AS (SELECT ticker, d, i, (k + ticker) % 61 = 0 AS x, (k + ticker) % 83 = 0 AS r, (k + ticker) % 151 = 0 AS s, (k + ticker) % 89 = 0 AS e FROM fl)"""


def flags(spark, sf):
    k = F.datediff("d", F.lit("1995-01-01").cast("date")) + C("ticker")
    return V.px(spark, sf).select(
        "ticker", "d", (k % 61 == 0).alias("x"), (k % 83 == 0).alias("r"), (k % 151 == 0).alias("s"), (k % 89 == 0).alias("e")
    )


_HYB = """hy AS (SELECT ticker, d, i, x AS h, false AS bear FROM b1 WHERE i = 1
  UNION ALL SELECT n.ticker, n.d, n.i,
    CASE WHEN NOT o.h THEN n.x ELSE NOT (CASE WHEN o.bear OR n.s THEN n.e ELSE n.r END) END,
    CASE WHEN NOT o.h THEN false ELSE (o.bear OR n.s) END
  FROM hy o JOIN b1 n ON n.ticker = o.ticker AND n.i = o.i + 1)"""

_IV = """{n}c AS (SELECT ticker, d, st, st <> coalesce(lag(st) OVER (PARTITION BY ticker ORDER BY d), false) AS t FROM {src}),
{n}o AS (SELECT ticker, st, d, lead(d) OVER (PARTITION BY ticker ORDER BY d) AS off FROM {n}c WHERE t),
{n}i AS (SELECT ticker, d AS o, off FROM {n}o WHERE st)"""


def hedge_rules(spark, sf):
    f = flags(spark, sf)
    re = E.intervals(E.on_off_state(f, P, "d", C("x"), C("r")), P, "d").withColumn("rule", F.lit("reentry"))
    be = E.intervals(E.on_off_state(f, P, "d", C("x"), C("e")), P, "d").withColumn("rule", F.lit("bear_end"))
    hy = E.hybrid_intervals(f, P, "d", C("x"), C("r"), C("s"), C("e")).withColumn("rule", F.lit("hybrid"))
    return re.unionByName(be).unionByName(hy)


_HEDGE = f"""{_FLAG}, {_STATE.format(on='x', off='r', src='b1')}, {_HYB},
s2 AS (SELECT ticker, d, i, x AS a, e AS b FROM b1),
hs2 AS (SELECT ticker, d, i, a AS st FROM s2 WHERE i = 1
  UNION ALL SELECT n.ticker, n.d, n.i, CASE WHEN NOT h.st THEN n.a ELSE NOT n.b END FROM hs2 h JOIN s2 n ON n.ticker = h.ticker AND n.i = h.i + 1),
{_IV.format(n='r', src='hs')}, {_IV.format(n='e', src='hs2')}, {_IV.format(n='h', src='(SELECT ticker, d, h AS st FROM hy)')},
hv AS (SELECT 'reentry' AS rule, * FROM ri UNION ALL SELECT 'bear_end', * FROM ei UNION ALL SELECT 'hybrid', * FROM hi)"""


@query(
    "e26_hedge_intervals",
    f'WITH RECURSIVE {_HEDGE} SELECT rule, ticker, CAST(o AS VARCHAR) AS start, CAST(off AS VARCHAR) AS stop FROM hv',
)
def e26(spark, sf):
    return hedge_rules(spark, sf).select("rule", "ticker", day("on").alias("start"), day("off").alias("stop"))


@query(
    "e27_hedged_share",
    f"""WITH RECURSIVE {_HEDGE}, rl AS (SELECT DISTINCT rule FROM hv)
SELECT rl.rule, p.ticker, round(avg(CASE WHEN EXISTS (SELECT 1 FROM hv WHERE hv.rule = rl.rule AND hv.ticker = p.ticker AND p.d > hv.o AND (hv.off IS NULL OR p.d <= hv.off)) THEN 1.0 ELSE 0.0 END), 6) AS share
FROM px p CROSS JOIN rl GROUP BY 1, 2""",
)
def e27(spark, sf):
    return hedged_share(V.px(spark, sf), hedge_rules(spark, sf))


def hedged_share(px, iv):
    """Share of days inside a hedge: each stretch contributes its own days, found by the two as-of ends."""
    cal = px.select("ticker", "d", F.row_number().over(W.series(P, "d")).alias("i"))
    size = px.groupBy("ticker").agg(F.count(F.lit(1)).alias("n"))
    iv = iv.join(cal.select("ticker", C("d").alias("on"), C("i").alias("i0")), ["ticker", "on"])
    iv = iv.join(cal.select("ticker", C("d").alias("off"), C("i").alias("i1")), ["ticker", "off"], "left").join(size, "ticker")
    g = iv.groupBy("rule", "ticker").agg(
        (F.sum(F.coalesce("i1", "n") - C("i0")) / F.max("n")).alias("share")
    )
    return g.select("rule", "ticker", r6(C("share"), "share"))


# ---------------------------------------------------------------- value paths
_TGT = f"""{_FEAT},
s AS (SELECT feat.*, max(CASE WHEN resid_z <= -0.15 THEN pos END) OVER (PARTITION BY ticker ORDER BY d) AS lastpos FROM feat),
t0 AS (SELECT s.*, CASE WHEN pos - lastpos < 126 THEN CAST(0.75 AS DOUBLE) ELSE CAST(0.5 AS DOUBLE) END AS tg FROM s),
t1 AS (SELECT t0.*, coalesce(lag(tg) OVER w, CAST(0.5 AS DOUBLE)) AS target, date_trunc('month', d) <> date_trunc('month', lead(d) OVER w) AS me, row_number() OVER w AS i FROM t0 WINDOW w AS (PARTITION BY ticker ORDER BY d)),
t2 AS (SELECT t1.*, i = 1 OR target <> lag(target) OVER (PARTITION BY ticker ORDER BY d) OR coalesce(me, false) AS reb FROM t1),
sim AS (SELECT ticker, d, i, CAST(target AS DOUBLE) AS xa, CAST(1 - target AS DOUBLE) AS xb, CAST(0 AS DOUBLE) AS turn FROM t2 WHERE i = 1
  UNION ALL SELECT n.ticker, n.d, n.i,
   CASE WHEN n.reb THEN ((o.xa*exp(n.ra) + o.xb*exp(n.rb)) - 2*0.0005*abs((o.xa*exp(n.ra) + o.xb*exp(n.rb))*n.target - o.xa*exp(n.ra))) * n.target ELSE o.xa*exp(n.ra) END,
   CASE WHEN n.reb THEN ((o.xa*exp(n.ra) + o.xb*exp(n.rb)) - 2*0.0005*abs((o.xa*exp(n.ra) + o.xb*exp(n.rb))*n.target - o.xa*exp(n.ra))) * (1 - n.target) ELSE o.xb*exp(n.rb) END,
   CASE WHEN n.reb THEN 2*abs((o.xa*exp(n.ra) + o.xb*exp(n.rb))*n.target - o.xa*exp(n.ra)) / ((o.xa*exp(n.ra) + o.xb*exp(n.rb)) - 2*0.0005*abs((o.xa*exp(n.ra) + o.xb*exp(n.rb))*n.target - o.xa*exp(n.ra))) ELSE 0 END
  FROM sim o JOIN t2 n ON n.ticker = o.ticker AND n.i = o.i + 1),
nv AS (SELECT ticker, d, xa + xb AS nav, xa / (xa + xb) AS w, turn FROM sim)"""


def book(spark, sf):
    d = overlay(features(with_benchmark(spark, sf)), C("resid_z") <= -0.15).withColumnRenamed("weight", "target")
    return X.two_asset_nav(d, P, "d", "ra", "rb", "target")


@query(
    "e38_two_asset_nav",
    f"WITH RECURSIVE {_TGT} SELECT ticker, CAST(d AS VARCHAR) AS d, round(ln(nav), 6) AS ln_nav, round(w, 6) AS weight, round(turn, 6) AS turnover FROM nv",
)
def e38(spark, sf):
    return book(spark, sf).select(
        "ticker", day(), r6(F.log("nav"), "ln_nav"), r6(C("weight"), "weight"), r6(C("turnover"), "turnover")
    )


@query(
    "e41_holding_weight",
    f"WITH RECURSIVE {_TGT} SELECT ticker, round(avg(w), 6) AS avg_weight, round(sum(turn), 6) AS turnover FROM nv GROUP BY ticker",
)
def e41(spark, sf):
    return book(spark, sf).groupBy("ticker").agg(
        r6(F.avg("weight"), "avg_weight"), r6(F.sum("turnover"), "turnover")
    )


@query(
    "e43_stat_summary",
    f"""WITH RECURSIVE {_TGT}, r AS (SELECT ticker, d, nav, ln(nav) - lag(ln(nav)) OVER w AS r, nav / max(nav) OVER w - 1 AS dd FROM nv WINDOW w AS (PARTITION BY ticker ORDER BY d)),
g AS (SELECT ticker, arg_max(nav, d) / arg_min(nav, d) AS x, (max(d) - min(d)) / 365.25 AS y, stddev_samp(r) AS s, avg(r) AS m, min(dd) AS maxdd FROM r GROUP BY ticker)
SELECT ticker, round(x - 1, 6) AS total, round(power(x, 1 / y) - 1, 6) AS cagr, round(s * sqrt(252), 6) AS vol, round(m / s * sqrt(252), 6) AS sharpe, round(maxdd, 6) AS maxdd FROM g""",
)
def e43(spark, sf):
    g = X.nav_stats(book(spark, sf), P, "d")
    return g.select("ticker", *[r6(C(c), c) for c in ("total", "cagr", "vol", "sharpe", "maxdd")])


# contribution plans: ticker 0 plays bills, ticker 1 the index, tickers 2.. the stocks
_DCA = """w AS (SELECT s.ticker, s.d, s.px AS s, q.px AS q, b.px AS bil, lag(s.px) OVER (PARTITION BY s.ticker ORDER BY s.d) AS ps, lag(s.d) OVER (PARTITION BY s.ticker ORDER BY s.d) AS pd
  FROM px s JOIN px q ON q.d = s.d AND q.ticker = 1 JOIN px b ON b.d = s.d AND b.ticker = 0 WHERE s.ticker >= 2),
dx AS (SELECT w.*, s / max(s) OVER (PARTITION BY ticker ORDER BY d ROWS 59 PRECEDING) - 1 <= -0.45 AS sg FROM w),
dy AS (SELECT dx.*, coalesce(lag(sg) OVER (PARTITION BY ticker ORDER BY d), false) AS dep FROM dx),
fl AS (SELECT ticker, d, q, bil, CASE WHEN pd IS NULL THEN 100000.0 ELSE 4000.0 END AS amount FROM dy WHERE pd IS NULL OR date_trunc('month', d) <> date_trunc('month', pd)),
dep AS (SELECT 'timed' AS plan, ticker, d FROM dy WHERE dep UNION ALL SELECT 'dca', ticker, d FROM fl),
en AS (SELECT ticker, arg_max(s, d) AS s, arg_max(q, d) AS q, arg_max(bil, d) AS bil FROM dy GROUP BY ticker),
pl AS (SELECT * FROM (VALUES ('dca', 0.0), ('dca', 0.75), ('timed', 0.0), ('timed', 0.75)) v(plan, core)),
x AS (SELECT pl.plan, CAST(pl.core AS DOUBLE) AS core, f.*, (SELECT min(dp.d) FROM dep dp WHERE dp.plan = pl.plan AND dp.ticker = f.ticker AND dp.d >= f.d) AS dd FROM fl f CROSS JOIN pl),
fin AS (SELECT x.plan, x.core, x.ticker, CAST(sum(amount) AS DOUBLE) AS paid, sum(amount * core * 0.999 * en.q / x.q + CASE WHEN dd IS NULL THEN amount * (1 - core) * en.bil / x.bil
   ELSE amount * (1 - core) * y.bil / x.bil * 0.999 * en.s / y.s END) AS final FROM x JOIN en USING (ticker) LEFT JOIN dy y ON y.ticker = x.ticker AND y.d = x.dd GROUP BY 1, 2, 3)"""


def dca_inputs(spark, sf):
    p = V.px(spark, sf)
    q = p.where(C("ticker") == 1).select("d", C("px").alias("q"))
    b = p.where(C("ticker") == 0).select("d", C("px").alias("bil"))
    d = p.where(C("ticker") >= 2).withColumnRenamed("px", "s").join(q, "d").join(b, "d").withColumnRenamed("d", "day")
    w = W.series(P, "day")
    high = F.max("s").over(Window.partitionBy("ticker").orderBy("day").rowsBetween(-59, 0))
    d = d.withColumn("sg", C("s") / high - 1 <= -0.45)
    d = d.withColumn("dep", F.coalesce(F.lag("sg").over(w), F.lit(False)))
    d = d.withColumn("new", W.first_of_month("day", P)).withColumn("first", F.row_number().over(w) == 1)
    return d.withColumn("amount", F.when(C("first"), 100000.0).when(C("new"), 4000.0))


def plan_values(d):
    """Both deploy rules times both core shares for every stock."""
    cores = F.explode(F.array(F.lit(0.0), F.lit(0.75)))
    plans = F.explode(F.array(F.lit("dca"), F.lit("timed")))
    flows = d.where(C("amount").isNotNull()).select("ticker", "day", "amount", "bil", "q")
    flows = flows.withColumn("plan", plans).withColumn("core", cores)
    dep = d.select(
        "ticker",
        C("day").alias("deploy_day"),
        F.explode(
            F.array_compact(F.array(F.when(C("dep"), "timed"), F.when(C("amount").isNotNull(), "dca")))
        ).alias("plan"),
    ).withColumn("core", cores)
    prices = d.select("ticker", "day", "s", "bil").withColumn("plan", plans).withColumn("core", cores)
    ends = d.groupBy("ticker").agg(*[F.max_by(c, "day").alias(c) for c in ("s", "q", "bil")])
    ends = ends.withColumn("plan", plans).withColumn("core", cores)
    return X.contribution_value(flows, dep, prices, ends, ["ticker", "plan", "core"], C("core"))


@query(
    "e39_contribution_valuation",
    f"WITH {_DCA} SELECT plan, core, ticker, paid, round(final, 4) AS final FROM fin",
)
def e39(spark, sf):
    v = plan_values(cut_lineage(dca_inputs(spark, sf)))
    return v.select("plan", "core", "ticker", "paid", F.round("final", 4).alias("final"))


@query(
    "c07_next_deploy_join",
    f"WITH {_DCA} SELECT ticker, CAST(d AS VARCHAR) AS d, CAST(dd AS VARCHAR) AS deploy_day FROM x WHERE plan = 'timed' AND core = 0",
)
def c07(spark, sf):
    d = dca_inputs(spark, sf)
    flows = d.where(C("amount").isNotNull()).select("ticker", "day")
    dep = d.where("dep").select("ticker", C("day").alias("deploy_day"))
    m = asof.forward(flows, dep, P, "day", "deploy_day", [], inclusive=True)
    return m.select("ticker", day("day").alias("d"), day("matched_deploy_day").alias("deploy_day"))


DEPLOY_DRAWS = 1000


@query(
    "j19_random_deploy_placebo",
    f"""WITH {_DCA.replace("dy AS (", "dy AS MATERIALIZED (").replace("fin AS (", "fin AS MATERIALIZED (")}, nd AS (SELECT ticker, count(*) AS n FROM dy WHERE dep GROUP BY ticker),
dr AS (SELECT CAST(unnest(generate_series(0, {DEPLOY_DRAWS - 1})) AS INT) AS draw),
rk AS (SELECT dr.draw, y.ticker, y.d, row_number() OVER (PARTITION BY dr.draw, y.ticker ORDER BY substr(md5('7-' || dr.draw || '-' || y.ticker || '-' || CAST(y.d AS VARCHAR)), 1, 8), y.d) AS k FROM dy y CROSS JOIN dr WHERE y.ticker IN (SELECT ticker FROM nd)),
nx AS (SELECT draw, ticker, d, min(CASE WHEN k <= n THEN d END) OVER (PARTITION BY draw, ticker ORDER BY d ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS dd FROM rk JOIN nd USING (ticker)),
z AS (SELECT nx.draw, nx.dd, fl.* FROM nx JOIN fl ON fl.ticker = nx.ticker AND fl.d = nx.d),
fz AS (SELECT z.draw, z.ticker, sum(CASE WHEN dd IS NULL THEN amount * en.bil / z.bil ELSE amount * y.bil / z.bil * 0.999 * en.s / y.s END) AS moved, sum(amount * 0.999 * en.q / z.q) AS held
  FROM z JOIN en USING (ticker) LEFT JOIN dy y ON y.ticker = z.ticker AND y.d = z.dd GROUP BY 1, 2),
fc AS (SELECT fz.draw, fz.ticker, fin.core, fin.core * fz.held + (1 - fin.core) * fz.moved AS final, fin.final AS real FROM fz JOIN fin ON fin.ticker = fz.ticker AND fin.plan = 'timed')
SELECT ticker, core, count(*) AS draws, round(avg(CASE WHEN round(final, 4) < round(real, 4) THEN 1.0 ELSE 0.0 END), 6) AS beaten,
  round(quantile_cont(final, 0.05), 3) AS p5, round(median(final), 3) AS p50, round(quantile_cont(final, 0.95), 3) AS p95 FROM fc GROUP BY 1, 2""",
)
def j19(spark, sf):
    """As many random deploy days as the plan has, drawn from the name's own calendar, with and without a core holding."""
    d = cut_lineage(dca_inputs(spark, sf))
    real = plan_values(d).where(C("plan") == "timed").select("ticker", "core", C("final").alias("real"))
    end_q = d.groupBy("ticker").agg(F.max_by("q", "day").alias("end_q"))
    held = d.where(C("amount").isNotNull()).join(end_q, "ticker").groupBy("ticker").agg(F.sum(C("amount") * 0.999 * C("end_q") / C("q")).alias("held"))
    v = X.random_deploys(d, "ticker", DEPLOY_DRAWS, 7).join(held, "ticker")
    v = v.join(real, "ticker").withColumn("final", C("core") * C("held") + (1 - C("core")) * C("moved"))
    return v.groupBy("ticker", "core").agg(
        F.count(F.lit(1)).alias("draws"),
        r6(F.avg((F.round("final", 4) < F.round("real", 4)).cast("double")), "beaten"),
        *[F.round(F.percentile("final", F.lit(p)), 3).alias(name) for name, p in (("p5", 0.05), ("p50", 0.5), ("p95", 0.95))],  # one value per draw
    )


# ---------------------------------------------------------------- trades
_TRADES = """tdd AS (SELECT CAST(o_custkey % 7 AS INT) AS account, CAST(o_orderkey % 5 AS INT) AS ticker, CAST(o_orderdate AS DATE) AS day, CASE WHEN o_orderstatus = 'F' THEN 'sell' ELSE 'buy' END AS side,
  CAST(o_orderkey % 9 + 1 AS DOUBLE) AS shares FROM orders),
tr AS (SELECT t.*, p.px AS price FROM tdd t JOIN px p ON p.ticker = t.ticker AND p.d = t.day)"""


def trades(spark, sf):
    o = V.table(spark, sf, "orders").select(
        (C("o_custkey") % 7).cast("int").alias("account"),
        (C("o_orderkey") % 5).cast("int").alias("ticker"),
        C("o_orderdate").cast("date").alias("day"),
        F.when(C("o_orderstatus") == "F", "sell").otherwise("buy").alias("side"),
        (C("o_orderkey") % 9 + 1).cast("double").alias("shares"),
    )
    p = V.px(spark, sf).select("ticker", C("d").alias("day"), C("px").alias("price"))
    return o.join(p, ["ticker", "day"])


@query(
    "e40_blotter_valuation",
    f"""WITH {_TRADES}, net AS (SELECT account, ticker, day, sum(CASE WHEN side = 'buy' THEN shares ELSE -shares END) AS sh, sum(CASE WHEN side = 'buy' THEN -shares*price ELSE shares*price END) AS cash FROM tr GROUP BY 1, 2, 3),
cum AS (SELECT account, ticker, day, sum(sh) OVER w AS held, sum(cash) OVER w AS spent, coalesce(lead(day) OVER w, DATE '2001-12-31') AS nxt, lead(day) OVER w IS NULL AS op FROM net WINDOW w AS (PARTITION BY account, ticker ORDER BY day)),
v AS (SELECT c.account, p.d, sum(held * px) AS stock, sum(spent) AS cash, count(*) AS lines FROM cum c JOIN px p ON p.ticker = c.ticker AND p.d >= c.day AND (p.d < c.nxt OR (c.op AND p.d <= c.nxt)) GROUP BY 1, 2)
SELECT account, CAST(d AS VARCHAR) AS d, round(stock, 2) AS stock, round(cash, 2) AS cash, lines FROM v""",
)
def e40(spark, sf):
    t = trades(spark, sf)
    sign = F.when(C("side") == "buy", 1.0).otherwise(-1.0)
    t = t.select("account", "ticker", "day", (sign * C("shares")).alias("shares"), (-sign * C("shares") * C("price")).alias("cash"))
    p = V.px(spark, sf).select("ticker", C("d").alias("day"), "px")
    v = X.blotter_value(t, p, ["account"], F.lit("2001-12-31").cast("date"))
    return v.select("account", day("day").alias("d"), F.round("stock", 2).alias("stock"), F.round("cash", 2).alias("cash"), "lines")


_ROLL = f"""{_TRADES}, cl AS (SELECT ticker, arg_max(px, d) AS last_px FROM px GROUP BY ticker),
bn AS (SELECT d AS day, px AS b, (SELECT arg_max(px, d) FROM px WHERE ticker = 0) AS b_end FROM px WHERE ticker = 0),
po AS (SELECT account, tr.ticker, min(CASE WHEN side = 'buy' THEN tr.day END) AS first_buy, count(*) FILTER (WHERE side = 'buy') AS buys, coalesce(sum(CASE WHEN side = 'buy' THEN shares * price END), 0) AS invested,
 sum(CASE WHEN side = 'buy' THEN shares ELSE -shares END) AS shares, coalesce(sum(CASE WHEN side <> 'buy' THEN shares * price END), 0) AS sold, max(last_px) AS last_px,
 coalesce(sum(CASE WHEN side = 'buy' THEN shares * price * b_end / b END), 0) AS bench_value FROM tr LEFT JOIN cl ON cl.ticker = tr.ticker LEFT JOIN bn ON bn.day = tr.day GROUP BY 1, 2)"""


@query(
    "d27_positions_rollup",
    f"WITH {_ROLL} SELECT account, ticker, CAST(first_buy AS VARCHAR) AS first_buy, buys, round(invested, 3) AS invested, shares, round(sold, 3) AS sold, round(shares * last_px, 3) AS value, round(shares * last_px + sold - invested, 3) AS pnl, round(bench_value, 3) AS bench_value FROM po",
)
def d27(spark, sf):
    p = V.px(spark, sf)
    closing = p.groupBy("ticker").agg(F.max_by("px", "d").alias("last_px"))
    b = p.where(C("ticker") == 0)
    end = b.agg(F.max_by("px", "d").alias("e")).scalar()
    bench = b.select(C("d").alias("day"), C("px").alias("b")).withColumn("b_end", end)
    g = X.position_rollup(trades(spark, sf), closing, bench, ["account"])
    money = [F.round(c, 3).alias(c) for c in ("invested", "sold", "value", "pnl", "bench_value")]
    return g.select("account", "ticker", day("first_buy"), "buys", "shares", *money)


@query(
    "d28_period_end_snapshot",
    """WITH f AS (SELECT ticker, d, px, CASE WHEN lag(d) OVER w IS NULL THEN 100000.0 WHEN date_trunc('month', d) <> date_trunc('month', lag(d) OVER w) THEN 4000.0 ELSE 0 END AS flow FROM px WINDOW w AS (PARTITION BY ticker ORDER BY d)),
y AS (SELECT ticker, year(d) AS yr, max(d) AS d, arg_max(px, d) AS px, CAST(sum(flow) AS DOUBLE) AS f FROM f GROUP BY 1, 2)
SELECT ticker, CAST(yr AS INT) AS year, CAST(d AS VARCHAR) AS d, px, sum(f) OVER (PARTITION BY ticker ORDER BY yr) AS paid FROM y""",
)
def d28(spark, sf):
    first = F.row_number().over(W.series(P, "d")) == 1
    flow = F.when(first, 100000.0).when(W.first_of_month("d", P), 4000.0).otherwise(0.0)
    d = V.px(spark, sf).withColumn("flow", flow)
    return X.period_end_snapshot(d, P, "d", ["px"], "flow").withColumn("d", day())


# ---------------------------------------------------------------- event tables
HORIZONS = (63, 126, 252)

_EV = f"""{_FEAT}, {starts_sql('resid_z <= -0.15')},
hz AS (SELECT CAST(unnest([63, 126, 252]) AS INT) AS h),
fw AS (SELECT f.ticker, f.pos, f.d, hz.h, f.beta, a.la - b.la AS raw, a.rel - b.rel AS relative, a.la - b.la - f.beta * (a.lb - b.lb) AS resid
  FROM feat f CROSS JOIN hz JOIN feat a ON a.ticker = f.ticker AND a.pos = f.pos + hz.h + 1 JOIN feat b ON b.ticker = f.ticker AND b.pos = f.pos + 1),
ev AS (SELECT 'episode' AS signal, fw.* FROM fw JOIN ep USING (ticker, pos) UNION ALL SELECT 'all days', fw.* FROM fw WHERE pos % 5 = 0 AND beta IS NOT NULL)"""


def event_rows(spark, sf):
    f = cut_lineage(features(with_benchmark(spark, sf)))
    ep = E.starts(f, P, "pos", C("resid_z") <= -0.15).withColumn("ep", F.lit(True))
    d = f.join(ep, ["ticker", "pos"], "left")
    out = None
    for h in HORIZONS:
        x = forward(d, h).where(C("raw").isNotNull()).withColumn("h", F.lit(h))
        out = x if out is None else out.unionByName(x)
    tags = F.array_compact(
        F.array(
            F.when(C("ep"), "episode"), F.when((C("pos") % 5 == 0) & C("beta").isNotNull(), "all days")
        )
    )
    return out.withColumn("signal", F.explode(tags))


@query(
    "j20_event_table",
    f"WITH RECURSIVE {_EV} SELECT signal, ticker, CAST(d AS VARCHAR) AS d, h, round(raw, 6) AS raw, round(relative, 6) AS relative, round(resid, 6) AS resid FROM ev",
)
def j20(spark, sf):
    return event_rows(spark, sf).select(
        "signal", "ticker", day(), "h", *[r6(C(c), c) for c in ("raw", "relative", "resid")]
    )


@query(
    "d25_event_summary",
    f"""WITH RECURSIVE {_EV}, e2 AS (SELECT ev.signal, ev.h, round(ev.relative, 9) AS relative, (SELECT min(x.rel) FROM feat x WHERE x.ticker = ev.ticker AND x.pos BETWEEN ev.pos + 1 AND ev.pos + ev.h + 1) - (SELECT x.rel FROM feat x WHERE x.ticker = ev.ticker AND x.pos = ev.pos + 1) AS worst FROM ev)
SELECT signal, h, count(*) AS n, round(avg(relative), 6) AS mean, round(median(relative), 6) AS median, round(avg(CAST(relative > 0 AS INT)), 6) AS hit, round(median(worst), 6) AS median_worst FROM e2 GROUP BY 1, 2""",
)
def d25(spark, sf):
    e = cut_lineage(event_rows(spark, sf).select("signal", "h", F.round("relative", 9).alias("relative"), "worst_relative"))
    k = ["signal", "h"]
    base = e.groupBy(*k).agg(
        F.count(F.lit(1)).alias("n"),
        r6(F.avg("relative"), "mean"),
        r6(F.avg((C("relative") > 0).cast("double")), "hit"),
    )
    m = R.percentiles(e, k, ["relative", "worst_relative"], {"p": 0.5})
    m = m.select(*k, r6(C("relative_p"), "median"), r6(C("worst_relative_p"), "median_worst"))
    return base.join(m, k)


@query(
    "j18_random_date_placebo",
    f"""WITH RECURSIVE {_FEAT}, {starts_sql('resid_z <= -0.15 AND pos + 64 <= (SELECT max(pos) FROM feat z WHERE z.ticker = feat.ticker)')},
fo AS (SELECT f.ticker, f.pos, round(a.rel - b.rel, 9) AS fwd, row_number() OVER (PARTITION BY f.ticker ORDER BY f.pos) - 1 AS i, count(*) OVER (PARTITION BY f.ticker) AS n FROM feat f
  JOIN feat a ON a.ticker = f.ticker AND a.pos = f.pos + 64 JOIN feat b ON b.ticker = f.ticker AND b.pos = f.pos + 1 WHERE f.resid_z IS NOT NULL),
ac AS (SELECT ep.ticker, fo.fwd, row_number() OVER (PARTITION BY ep.ticker ORDER BY ep.pos) - 1 AS k FROM ep JOIN fo USING (ticker, pos)),
dr AS (SELECT CAST(unnest(generate_series(0, 999)) AS INT) AS draw),
pk AS (SELECT dr.draw, ac.ticker, CAST('0x' || substr(md5('7-' || dr.draw || '-' || ac.ticker || '-' || ac.k), 1, 8) AS BIGINT) AS h FROM ac CROSS JOIN dr),
sm AS (SELECT pk.draw, round(avg(fo.fwd), 12) AS m FROM pk JOIN (SELECT DISTINCT ticker, n FROM fo) c USING (ticker) JOIN fo ON fo.ticker = pk.ticker AND fo.i = pk.h % c.n GROUP BY 1)
SELECT (SELECT count(*) FROM ac) AS episodes, round((SELECT avg(fwd) FROM ac), 6) AS mean, round(avg(m), 6) AS placebo_mean, round(avg(CASE WHEN m >= (SELECT round(avg(fwd), 12) FROM ac) THEN 1.0 ELSE 0.0 END), 6) AS p_one_sided FROM sm""",
)
def j18(spark, sf):
    f = features(with_benchmark(spark, sf))
    f = cut_lineage(forward(f, 63).select("ticker", "pos", "resid_z", F.round("relative", 9).alias("fwd")))
    ok = f.where(C("fwd").isNotNull() & C("resid_z").isNotNull())
    own = W.series(P, "pos")
    pool = ok.withColumn("i", F.row_number().over(own) - 1)
    n = pool.groupBy("ticker").agg(F.count(F.lit(1)).alias("n"))
    act = E.starts(ok, P, "pos", C("resid_z") <= -0.15).join(ok, ["ticker", "pos"])
    act = act.withColumn("k", F.row_number().over(own) - 1)
    h = S.draw_hash(7, C("draw"), C("ticker"), C("k")).cast("long")
    drawn = S.with_draws(act.select("ticker", "k"), 1000).join(n, "ticker").select("draw", "ticker", (h % C("n")).alias("i"))
    sims = drawn.join(pool.select("ticker", "i", "fwd"), ["ticker", "i"]).groupBy("draw").agg(F.round(F.avg("fwd"), 12).alias("m"))
    real = act.agg(F.struct(F.count(F.lit(1)).alias("episodes"), F.avg("fwd").alias("mean")))
    return sims.withColumn("r", real.scalar()).agg(
        F.max("r.episodes").alias("episodes"),
        r6(F.max("r.mean"), "mean"),
        r6(F.avg("m"), "placebo_mean"),
        r6(F.avg((C("m") >= F.round(C("r.mean"), 12)).cast("double")), "p_one_sided"),
    )


@query(
    "j21_sensitivity_grid",
    f"""WITH {_FEAT}, th AS (SELECT CAST(unnest([-0.1, -0.15, -0.2]) AS DOUBLE) AS z), hd AS (SELECT CAST(unnest([63, 126]) AS INT) AS hold),
g AS (SELECT f.ticker, f.d, f.pos, f.rel, th.z, hd.hold, max(CASE WHEN resid_z <= z THEN pos END) OVER (PARTITION BY f.ticker, th.z, hd.hold ORDER BY f.pos) AS lp FROM feat f CROSS JOIN th CROSS JOIN hd),
t AS (SELECT *, coalesce(lag(pos - lp < hold) OVER (PARTITION BY ticker, z, hold ORDER BY pos), false) AS over1 FROM g)
SELECT ticker, z, hold, count(*) FILTER (WHERE over1) AS days_over, round(avg(rel) FILTER (WHERE over1), 6) AS rel_over FROM t GROUP BY 1, 2, 3""",
)
def j21(spark, sf):
    f = features(with_benchmark(spark, sf)).select("ticker", "d", "pos", "rel", "resid_z")
    k = ["ticker", "z", "hold"]
    g = f.withColumn("z", F.explode(F.array(F.lit(-0.1), F.lit(-0.15), F.lit(-0.2))))
    g = g.withColumn("hold", F.explode(F.array(F.lit(63), F.lit(126))))
    w = W.series(k, "pos")
    inside = C("pos") - W.latest_on(C("resid_z") <= C("z"), C("pos"), k, "pos") < C("hold")
    g = g.withColumn("in", inside).withColumn("over", F.coalesce(F.lag("in").over(w), F.lit(False)))
    return g.groupBy(*k).agg(
        F.count_if("over").alias("days_over"), r6(F.avg(F.when(C("over"), C("rel"))), "rel_over")
    )


_ROLLW = """wn AS (SELECT k, a, b FROM (SELECT CAST(k AS INT) AS k, CAST(o + k * INTERVAL 6 MONTH AS DATE) AS a, CAST(o + k * INTERVAL 6 MONTH + INTERVAL 36 MONTH AS DATE) AS b, hi
  FROM (SELECT date_trunc('month', min(d)) AS o, max(d) AS hi FROM px), unnest(generate_series(0, 2000)) t(k)) WHERE b <= hi),
rw AS (SELECT p.ticker, wn.k, count(*) AS days, arg_max(px, d) / arg_min(px, d) AS ratio FROM px p JOIN wn ON p.d >= wn.a AND p.d <= wn.b GROUP BY 1, 2)"""


def rolling(spark, sf, months=36, step=6):
    """Each day is assigned to every window it falls in: windows start every ``step`` months from the first month of
    the data, and those that end inside the data count."""
    d = V.px(spark, sf)
    ends = d.agg(F.struct(F.trunc(F.min("d"), "month").alias("lo"), F.max("d").alias("hi"))).scalar()
    d = d.withColumn("_e", ends)
    origin, last = C("_e.lo"), F.floor((F.months_between(C("d"), C("_e.lo")) + 1) / step).cast("int")
    first = F.greatest(F.lit(0), F.ceil((F.months_between(C("d"), C("_e.lo")) - months - 1) / step).cast("int"))
    inside = F.filter(
        F.sequence(first, F.greatest(first, last)),
        lambda i: (C("d") >= F.add_months(origin, i * step))
        & (C("d") <= F.add_months(origin, i * step + months))
        & (F.add_months(origin, i * step + months) <= C("_e.hi")),
    )
    return d.withColumn("k", F.explode(inside)).groupBy("ticker", "k").agg(
        F.count(F.lit(1)).alias("days"), (F.max_by("px", "d") / F.min_by("px", "d")).alias("ratio")
    )


@query("j22_rolling_windows", f"WITH {_ROLLW} SELECT ticker, k, days, round(ratio, 6) AS ratio FROM rw")
def j22(spark, sf):
    return rolling(spark, sf).select("ticker", "k", "days", r6(C("ratio"), "ratio"))


@query(
    "d31_rolling_window_summary",
    f"""WITH {_ROLLW}, v AS (SELECT a.ticker, a.k, round(a.ratio / b.ratio, 9) AS x FROM rw a JOIN rw b ON a.k = b.k AND b.ticker = 0 WHERE a.ticker <> 0)
SELECT ticker, count(*) AS windows, round(avg(CAST(x > 1 AS INT)), 6) AS beats, round(median(x), 6) AS median_ratio, round(min(x), 6) AS worst FROM v GROUP BY ticker""",
)
def d31(spark, sf):
    r = cut_lineage(rolling(spark, sf))
    b = r.where(C("ticker") == 0).select("k", C("ratio").alias("b"))
    v = r.where(C("ticker") != 0).join(b, "k").withColumn("x", F.round(C("ratio") / C("b"), 9))
    return v.groupBy("ticker").agg(
        F.count(F.lit(1)).alias("windows"),
        r6(F.avg((C("x") > 1).cast("double")), "beats"),
        r6(F.median("x"), "median_ratio"),
        r6(F.min("x"), "worst"),
    )


@query(
    "j23_z_correlation",
    f"""WITH {_FEAT} SELECT ticker, round((corr(rel_z, resid_z) + corr(rel_z, ratio_dd) + corr(resid_z, ratio_dd)) / 3, 6) AS mean_corr FROM feat WHERE rel_z IS NOT NULL AND resid_z IS NOT NULL AND ratio_dd IS NOT NULL GROUP BY ticker""",
)
def j23(spark, sf):
    f = features(with_benchmark(spark, sf)).where(
        C("rel_z").isNotNull() & C("resid_z").isNotNull() & C("ratio_dd").isNotNull()
    )
    m = (F.corr("rel_z", "resid_z") + F.corr("rel_z", "ratio_dd") + F.corr("resid_z", "ratio_dd")) / 3
    return f.groupBy("ticker").agg(r6(m, "mean_corr"))
