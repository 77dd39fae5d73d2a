"""Beat and raise against the company's own guidance, and guidance against what was then reported."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.functions.dates import quarter_end
from tidemark.operators import asof, ranks as R, windows as W

C = F.col
# Plausible guide bands.
NEAR = (1 / 1.30, 1 / 0.80)
FORWARD = (0.6, 1.8)
MAX_YOY = 2.0


def _reported(days: DataFrame, quarters: DataFrame, figures: dict[str, Column]) -> DataFrame:
    """Rows of (cik, filed, ...) with the quarter ended 10 to 100 days before, the nearest one, and its figures."""
    q = quarters.select("cik", quarter_end(C("qn")).alias("qend"), C("qn").alias("reported_q"), *[v.alias(k) for k, v in figures.items()])
    rest = [c for c in days.columns if c not in ("cik", "filed")]
    near = asof.within(days, q, ["cik"], "filed", "qend", -100, -10)
    best = near.groupBy("cik", "filed").agg(F.max(F.struct("qend", "reported_q", *figures)).alias("_q"), *[F.max(c).alias(c) for c in rest])
    return best.select("cik", "filed", *rest, *[C(f"_q.{c}").alias(c) for c in ("reported_q", *figures)])


def match_releases(releases: DataFrame, quarters: DataFrame) -> DataFrame:
    """Each release with the quarter it reports: ended 10 to 100 days before the filing, the nearest one.

    releases (cik, accn, filed, ...), quarters (cik, qn, rev, rev_yoy).
    """
    figures = {"reported_rev": C("rev"), "reported_yoy": C("rev_yoy")}
    best = _reported(releases.select("cik", "filed").distinct(), quarters, figures)
    return releases.join(best, ["cik", "filed"]).select(*releases.columns, "reported_q", *figures)


def score_quarters(releases: DataFrame, quarters: DataFrame) -> DataFrame:
    """One row per release with the guide it is judged by, the beat, the raise and the basis of the raise.

    releases carry guide_period, revenue_{low,mid,high}, fy_revenue_{low,mid,high}, growth_{low,mid,high}_pct.
    Releases meet the quarters once, one row per filer and day; the year-ago figures are columns of the quarters, and the
    guide given a quarter earlier (that quarter's last release) comes from a window over a filer's days.
    """
    fy_tag = F.coalesce(C("guide_period") == "full_year", F.lit(False))
    mid = F.coalesce("revenue_mid", (C("revenue_low") + C("revenue_high")) / 2)
    grow = F.coalesce("growth_mid_pct", (C("growth_low_pct") + C("growth_high_pct")) / 2)
    fy = F.coalesce("fy_revenue_mid", (C("fy_revenue_low") + C("fy_revenue_high")) / 2)
    guides = {
        "q_guide_mid": F.when(~fy_tag, mid),
        "q_growth_mid": F.when(~fy_tag, grow),
        "fy_guide_mid": F.coalesce(fy, F.when(fy_tag, mid)),
    }
    r = releases.withColumns(guides)
    days = r.groupBy("cik", "filed").agg(F.max(F.struct("accn", *guides)).alias("_last"))
    ago = lambda n: W.period_offset(C("rev"), ["cik"], "qn", n)
    figures = {"reported_rev": C("rev"), "reported_yoy": C("rev_yoy"), "reported_q_yago": C("_ago4"), "guided_q_yago": C("_ago3")}
    d = _reported(days, quarters.withColumns({"_ago4": ago(4), "_ago3": ago(3)}), figures)
    before = Window.partitionBy("cik").orderBy("reported_q").rangeBetween(-1, -1)
    d = d.withColumn("_g", F.max(F.struct("filed", "_last")).over(before)["_last"])
    d = d.select(
        "cik",
        "filed",
        "reported_q",
        *figures,
        C("_g.q_guide_mid").alias("guide_for_this_q"),
        C("_g.q_growth_mid").alias("growth_guide_for_this_q"),
        C("_g.fy_guide_mid").alias("prev_fy_guide"),
        C("_g.accn").alias("guide_accn"),
        F.when(C("_g").isNotNull(), F.floor((C("reported_q") - 1) / 4)).alias("prev_fy"),
        (C("reported_q") + 1).alias("guided_q"),
        F.floor(C("reported_q") / 4).alias("fy"),
    )
    return legs(r.join(d, ["cik", "filed"]))


def legs(a: DataFrame) -> DataFrame:
    """Beat and raise as true, false or unknown, with implausible guides rejected and labelled."""
    conv = C("reported_q_yago") * (1 + C("growth_guide_for_this_q") / 100)
    a = a.withColumn("_raw", F.coalesce("guide_for_this_q", conv))
    off = C("_raw").isNotNull() & ~F.coalesce(W.ratio(C("_raw"), C("reported_rev")).between(*NEAR), F.lit(False))
    kind = (
        F.when(C("guide_rejected"), "rejected: implausible vs reported revenue")
        .when(C("guide_for_this_q").isNotNull(), "dollar guide")
        .when(conv.isNotNull(), "growth guide converted to dollars")
        .otherwise("none")
    )
    a = (
        a.withColumn("guide_rejected", off)
        .withColumn("guide_kind", kind)
        .withColumn("guide_mid", F.when(~C("guide_rejected"), C("_raw")))
        .withColumn("beat", C("reported_rev") > C("guide_mid"))
        .withColumn("beat_pct", W.ratio(C("reported_rev"), C("guide_mid")) - 1)
        .withColumn("raise_fy", F.when(C("fy") == C("prev_fy"), C("fy_guide_mid") > C("prev_fy_guide")))
    )
    yoy = F.when(C("q_growth_mid").isNotNull(), C("q_growth_mid") / 100).otherwise(
        W.ratio(C("q_guide_mid"), C("guided_q_yago")) - 1
    )
    fwd_ok = C("q_guide_mid").isNull() | F.coalesce(
        W.ratio(C("q_guide_mid"), C("reported_rev")).between(*FORWARD), F.lit(False)
    )
    a = a.withColumn("guided_yoy", F.when(fwd_ok & (F.abs(yoy) <= MAX_YOY), yoy))
    a = a.withColumn("raise_accel", C("guided_yoy") > C("reported_yoy"))
    basis = (
        F.when(C("raise_fy").isNotNull(), "full-year guide raised vs prior full-year guide")
        .when(C("raise_accel").isNotNull(), "next-quarter guide implies faster y/y than reported")
        .otherwise("no raise test available")
    )
    a = a.withColumn("raised", F.coalesce("raise_fy", "raise_accel")).withColumn("raise_basis", basis)
    both = F.when(C("beat").isNotNull() & C("raised").isNotNull(), C("beat") & C("raised"))
    return a.withColumn("beat_and_raise", both).drop("_raw")


def flag(a: DataFrame) -> DataFrame:
    """Per filer the run of beat-and-raise quarters ending at the last scored one, and whether the last two count.

    Rows are first reduced to one per quarter (the last release by accession).
    """
    cols = ["beat", "raised", "beat_pct", "raise_basis", "guide_kind", "beat_and_raise"]
    d = a.where(C("beat_and_raise").isNotNull())
    d = R.latest(d.select("cik", "reported_q", "accn", *cols), ["cik", "reported_q"], ["accn"])
    d = W.with_streak(d, C("beat_and_raise"), ["cik"], "reported_q", "br_streak")
    w = W.series(["cik"], "reported_q")
    two = (C("reported_q") - F.lag("reported_q").over(w) == 1) & C("beat_and_raise") & F.lag("beat_and_raise").over(w)
    d = d.withColumn("two_consecutive", F.coalesce(two, F.lit(False)))
    last = F.max_by(F.struct("reported_q", "br_streak", "two_consecutive", *cols), "reported_q").alias("_r")
    g = d.groupBy("cik").agg(F.count(F.lit(1)).alias("scored_quarters"), last)
    return g.select(
        "cik",
        C("_r.reported_q").alias("latest_scored_q"),
        "scored_quarters",
        C("_r.br_streak").alias("br_streak"),
        C("_r.two_consecutive").alias("two_consecutive"),
        C("_r.beat").alias("last_beat"),
        C("_r.raised").alias("last_raise"),
        C("_r.beat_pct").alias("last_beat_pct"),
        C("_r.raise_basis").alias("last_raise_basis"),
        C("_r.guide_kind").alias("last_guide_kind"),
    )


def strength(f: DataFrame) -> DataFrame:
    """Label of the raise test behind each flag, and the flag itself."""
    strong = C("last_raise_basis").startswith("full-year")
    label = F.when(strong, "strong (full-year guide raised)").otherwise("weak (guides acceleration, not a raised guide)")
    return f.withColumn("raise_strength", label).withColumn("flag", C("two_consecutive") | (C("br_streak") >= 2))


def guidance_vs_actual(guides: DataFrame, actuals: DataFrame, tol: float = 0.20) -> DataFrame:
    """Each guide beside the quarter before it and the quarter it guided: implied midpoint, ratio and status.

    guides (cik, accn, filed, revenue_low/mid/high, revenue_qoq_pct), actuals (cik, pe, actual).
    """
    a = guides.withColumn("_cut", F.date_sub("filed", 5))
    a = asof.backward(a, actuals.withColumnRenamed("actual", "prior"), ["cik"], "_cut", "pe", ["prior"], inclusive=False)
    a = a.drop("matched_pe").where(C("prior").isNotNull())
    a = asof.forward(a, actuals, ["cik"], "filed", "pe", ["actual"])
    late = F.datediff("matched_pe", "filed") > 120
    a = a.withColumn("actual", F.when(~late, C("actual"))).withColumn("guided_end", F.when(~late, C("matched_pe")))
    spread = (C("revenue_low") + C("revenue_high")) / 2
    growth = C("prior") * (1 + C("revenue_qoq_pct") / 100)
    a = a.withColumn("implied_mid", F.coalesce("revenue_mid", spread, growth)).where(C("implied_mid").isNotNull())
    a = a.withColumn("ratio", W.ratio(C("actual"), C("implied_mid")))
    status = F.when(C("ratio").isNull(), "no actual yet").when(F.abs(C("ratio") - 1) <= tol, "ok").otherwise("CHECK")
    how = F.when(C("revenue_mid").isNotNull(), "mid").when(spread.isNotNull(), "range").otherwise("q/q %")
    return (
        a.withColumn("status", status)
        .withColumn("how", how)
        .withColumn("guided_qoq", W.ratio(C("implied_mid"), C("prior")) - 1)
        .withColumn("actual_qoq", W.ratio(C("actual"), C("prior")) - 1)
        .drop("_cut", "matched_pe")
    )
