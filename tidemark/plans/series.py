"""Acceleration of every disclosed series: metrics, materiality, rank; segment signals per company quarter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.operators import ranks as R, vintage as N, windows as W

C = F.col
# Materiality floors and the score's clip.
MIN_SHARE, MIN_BASE, MIN_BALANCE = 0.05, 20.0, 0.03
CLIP = (-2.0, 5.0)
AXES = {
    "segment": "segment",
    "product_or_service": "product",
    "product_or_service+segment": "product in segment",
    "geography": "geography",
}
KEYS = ["ticker", "axis", "series"]


def series_metrics(d: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Per series a gap-free quarterly index with yoy, acceleration, q/q, 3-quarter compound, streak, travelled growth.

    Input keys, qn, period_end, value; the later of two period ends in one quarter wins.
    """
    d = d.where(C("value").isNotNull())
    d = R.latest(d.select(*keys, "qn", "period_end", "value"), [*keys, "qn"], ["period_end", "value"]).drop("period_end")
    d = W.fill_periods(d, keys, "qn")
    w = W.series(keys, "qn")
    v = F.nullif(C("value"), F.lit(0.0))
    back = {n: F.lag(v, n).over(w) for n in (1, 3, 4)}
    d = d.withColumns({"yago": back[4], "yoy": v / back[4] - 1, "qoq": v / back[1] - 1, "qoq_3q": v / back[3] - 1})
    d = d.withColumns({"accel": C("yoy") - F.lag("yoy").over(w), "_py": F.lag("yoy").over(w)})
    d = W.with_streak(d, C("accel") > 0, keys, "qn")
    d = d.withColumn("_from", C("qn") - C("streak") + 1)
    run = Window.partitionBy(*keys, "_from").orderBy("qn").rowsBetween(Window.unboundedPreceding, 0)
    start = F.first(F.when(C("streak") == 1, C("_py")), ignorenulls=True).over(run)
    d = d.withColumn("cum_accel", F.when(C("streak") > 0, C("yoy") - start)).drop("_py", "_from")
    return d.withColumn("quarters_history", F.count("value").over(Window.partitionBy(*keys)))


def with_share(m: DataFrame, kinds: DataFrame) -> DataFrame:
    """Adds the series' kind, company revenue, its trailing year and the series' share of them."""
    m = m.join(kinds, KEYS, "left")
    co = m.where(C("axis") == "company").select("ticker", "qn", C("value").alias("co_rev"))
    co = co.withColumn("ttm_rev", W.annualised_sum(C("co_rev"), ["ticker"], "qn"))
    m = m.join(co, ["ticker", "qn"], "left")
    part = F.when(C("kind") == "bookings / backlog", C("ttm_rev")).otherwise(C("co_rev"))
    return m.withColumn("share", W.ratio(C("value"), part))


def material() -> Column:
    balance = C("kind") == "bookings / backlog"
    return F.coalesce(
        F.when(C("axis") == "company", True)
        .when(balance, C("share") >= MIN_BALANCE)
        .otherwise((C("share") >= MIN_SHARE) & (C("yago") >= MIN_BASE)),
        F.lit(False),
    )


def latest_series(m: DataFrame) -> DataFrame:
    """Each series' last reported quarter with its distance from the company's last quarter."""
    d = m.where(C("value").isNotNull())
    last = d.where(C("axis") == "company").groupBy("ticker").agg(F.max("qn").alias("latest_co_q"))
    d = R.latest(d, KEYS, ["qn"]).join(last, "ticker", "left")
    return d.withColumn("stale_q", C("latest_co_q") - C("qn")).withColumn("material", material())


def rank_series(latest: DataFrame) -> DataFrame:
    """Current, material series with their score: clipped acceleration times the root of the streak, capped at four."""
    ok = latest.where((C("stale_q") <= 1) & C("material") & C("accel").isNotNull())
    run = F.sqrt(F.greatest(F.least(C("streak"), F.lit(4)), F.lit(1)).cast("double"))
    score = F.least(F.greatest(C("accel"), F.lit(CLIP[0])), F.lit(CLIP[1])) * run
    return ok.withColumn("score", score).withColumn("short_history", C("quarters_history") < 8)


def early_turns(ranked: DataFrame) -> DataFrame:
    keep = (
        (C("accel") > 0) & (C("streak") >= 2) & (C("yoy") < 0.6) & (C("share") >= 0.08) & (C("axis") != "geography")
    )
    return ranked.where(keep)


def ticker_series(facts: DataFrame) -> DataFrame:
    """First-reported quarterly revenue of every series on every axis, fourth quarters derived.

    facts: ticker, axis, name, members, metric, period_end, duration_months, value, filed, accn.
    """
    label = None
    for axis, name in AXES.items():
        label = F.when(C("axis") == axis, name) if label is None else label.when(C("axis") == axis, name)
    series = F.when(C("axis") == "segment", F.coalesce("name", "members")).otherwise(C("members"))
    d = facts.where((C("metric") == "revenue") & C("value").isNotNull() & C("axis").isin(*AXES))
    d = d.withColumn("series", series).withColumn("axis", label).where(resolved(C("series")))
    k = [*KEYS, "period_end", "duration_months"]
    d = N.collapse_members(d, [*k, "accn"], "value", ["filed"], "filed")
    return N.derive_last_quarter(N.vintage_agg(d, k), KEYS)


def resolved(label: Column) -> Column:
    """Labels that got past the raw tag."""
    return label.isNotNull() & ~label.rlike(r"(?i)\bMember\b|\bDomain\b")


def company_totals(reported: DataFrame, segments: DataFrame) -> DataFrame:
    """Company revenue; quarters without one get the sum of the segments (ticker, period_end, value, filed, source)."""
    s = segments.groupBy("ticker", "period_end").agg(
        F.sum("first").alias("value"), F.max("first_filed").alias("filed")
    )
    s = s.join(reported.select("ticker", "period_end"), ["ticker", "period_end"], "left_anti")
    r = reported.select("ticker", "period_end", "value", "filed", F.lit("reported 3M").alias("source"))
    return r.unionByName(s.withColumn("source", F.lit("sum of reportable segments")))


def segment_signals(seg: DataFrame, min_share: float = 0.02) -> DataFrame:
    """One row per ticker and quarter from its segments' growth: best, worst, spread, weighted mean, share speeding up.

    seg: ticker, name, qn, rev, known_at. A segment under ``min_share`` of the company's year-ago revenue has no growth.
    """
    k = ["ticker", "name"]
    d = seg.where(C("rev").isNotNull())
    d = d.withColumn("rev_yago", W.period_offset(C("rev"), k, "qn", 4))
    d = d.withColumn("seg_yoy", F.when(F.abs("rev_yago") > 1e-9, C("rev") / C("rev_yago") - 1))
    d = d.withColumn("seg_accel", C("seg_yoy") - W.period_offset(C("seg_yoy"), k, "qn", 1))
    base = d.groupBy("ticker", "qn").agg(
        F.sum("rev_yago").alias("_base"), (F.count("rev_yago") == F.count("rev")).alias("_all")
    )
    d = d.join(base, ["ticker", "qn"])
    small = F.coalesce((C("_base") > 0) & (C("rev_yago") < min_share * C("_base")), F.lit(False))
    for c in ("seg_yoy", "seg_accel"):
        d = d.withColumn(c, F.when(~small, C(c)))
    yoy, acc, rev = C("seg_yoy"), C("seg_accel"), C("rev")
    largest = F.max(F.struct(rev.alias("r"), "name", yoy.alias("y")))
    g = d.groupBy("ticker", "qn").agg(
        F.max("known_at").alias("known_at"),
        F.count(F.lit(1)).alias("n_segments"),
        F.sum(rev).alias("total_rev"),
        F.max("_all").alias("_all"),
        F.max("_base").alias("_base"),
        F.count(yoy).alias("_ny"),
        largest.alias("_l"),
        F.max(yoy).alias("best_seg_yoy"),
        F.min(yoy).alias("worst_seg_yoy"),
        F.stddev_samp(yoy).alias("seg_yoy_disp"),
        (F.sum(yoy * rev) / F.nullif(F.sum(F.when(yoy.isNotNull(), rev)), F.lit(0.0))).alias("wavg_seg_yoy"),
        F.max(acc).alias("best_seg_accel"),
        F.min(acc).alias("worst_seg_accel"),
        (F.sum(acc * rev) / F.nullif(F.sum(F.when(acc.isNotNull(), rev)), F.lit(0.0))).alias("wavg_seg_accel"),
        F.count_if(acc > 0).alias("n_segs_accelerating"),
        F.avg((acc > 0).cast("double")).alias("share_segs_accelerating"),
    )
    whole = C("_all") & (C("_ny") == C("n_segments")) & (C("_base") > 0)
    return (
        g.withColumn("total_yoy", F.when(whole, C("total_rev") / C("_base") - 1))
        .withColumn("largest_seg", C("_l.name"))
        .withColumn("largest_share", W.ratio(C("_l.r"), C("total_rev")))
        .withColumn("largest_seg_yoy", C("_l.y"))
        .drop("_all", "_base", "_ny", "_l")
    )


def company_baseline(fin: DataFrame) -> DataFrame:
    """Company growth and acceleration by position in its own quarters: ticker, qn, co_rev, co_known_at."""
    w = W.series(["ticker"], "qn")
    d = fin.withColumn("co_yoy", W.ratio(C("co_rev"), F.lag("co_rev", 4).over(w)) - 1)
    return d.withColumn("co_accel", C("co_yoy") - F.lag("co_yoy").over(w))
