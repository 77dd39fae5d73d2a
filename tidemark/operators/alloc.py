"""Holdings, laggard alerts and order sizing over many accounts at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.operators import ranks as R, windows as W

C = F.col
# Name and sleeve caps, step, margin limits.
CAP_NAME, CAP_TOTAL, STEP, MAINT, LOAN_CAP, EXCESS_WARN = 0.10, 0.40, 0.05, 0.30, 0.25, 0.20


def waterfall(
    wants: DataFrame, keys: Sequence[str], want: str, room: str, size: str, tie: str, out: str = "filled"
) -> DataFrame:
    """Wants filled largest first until the room runs out: each gets what the earlier ones left."""
    d = wants.withColumn("_o", -C(size))
    d = R.running_before(d, keys, "_o", tie, C(want), "_b")
    return d.withColumn(out, F.greatest(F.lit(0.0), F.least(C(want), C(room) - C("_b")))).drop("_o", "_b")


def pro_rata(wants: DataFrame, keys: Sequence[str], want: str, room: str, out: str = "filled") -> DataFrame:
    """Wants scaled down together where they exceed the room."""
    total = wants.groupBy(*keys).agg(F.sum(want).alias("_t"))
    d = wants.join(total, list(keys))
    return d.withColumn(out, C(want) * F.least(F.lit(1.0), C(room) / F.nullif(C("_t"), F.lit(0.0)))).drop("_t")


def cap_and_trim(
    names: DataFrame, keys: Sequence[str], value: str, sleeve: str, cap: float = CAP_NAME, total: float = CAP_TOTAL
) -> DataFrame:
    """Each name cut to ``cap`` of its sleeve, then all names scaled so they hold at most ``total`` of it."""
    d = names.withColumn("_c", F.least(C(value), cap * C(sleeve)))
    s = d.groupBy(*keys).agg(F.sum("_c").alias("_s"))
    d = d.join(s, list(keys))
    scale = F.least(F.lit(1.0), total * C(sleeve) / F.nullif(C("_s"), F.lit(0.0)))
    return d.withColumn("kept", C("_c") * scale).withColumn("sold", C(value) - C("kept")).drop("_c", "_s")


def positions(raw: DataFrame, live: DataFrame) -> DataFrame:
    """Typed holdings: trimmed upper-case keys, cash rows marked, a given price before the live one, value."""
    d = raw.withColumn("sleeve", F.upper(F.trim("sleeve"))).withColumn("ticker", F.upper(F.trim("ticker")))
    d = d.join(live, "ticker", "left")
    cash = (C("sleeve") == "CASH") | C("ticker").isin("CASH", "USD")
    px = F.when(cash, 1.0).otherwise(F.coalesce("price", "live"))
    return d.withColumn("is_cash", cash).withColumn("price", px).withColumn("value", C("shares") * C("price")).drop("live")


def sleeve_rollup(h: DataFrame, sleeves: Sequence[str], etf_share: float = 0.7) -> DataFrame:
    """Per account: value of each sleeve and of the picks, hedge, cash, loan, equity, targets, the sleeve furthest below."""
    def total(cond: Column) -> Column:
        return F.coalesce(F.sum(F.when(cond, C("value"))), F.lit(0.0))

    stock = ~C("is_cash")
    hedge = C("ticker") == "PSQ"
    g = h.groupBy("account").agg(
        *[total(stock & (C("sleeve") == s) & ~hedge).alias(f"v_{s.lower()}") for s in sleeves],
        total(stock & (C("sleeve") == "PICKS") & ~hedge).alias("picks"),
        total(stock & hedge).alias("hedge"),
        total(C("is_cash")).alias("cash"),
    )
    longs = C("picks") + C("hedge")
    for s in sleeves:
        longs = longs + C(f"v_{s.lower()}")
    g = (
        g.withColumn("longs", longs)
        .withColumn("loan", F.greatest(F.lit(0.0), -C("cash")))
        .withColumn("free", F.greatest(F.lit(0.0), C("cash")))
        .withColumn("equity", C("longs") + C("cash"))
        .withColumn("target", etf_share / len(sleeves) * C("equity"))
        .withColumn("target_picks", (1 - etf_share) * C("equity"))
    )
    gaps = F.array(*[F.struct((C(f"v_{s.lower()}") - C("target")).alias("g"), F.lit(s).alias("s")) for s in sleeves])
    return g.withColumn("under", F.array_min(gaps)["s"])


def guard(a: DataFrame) -> DataFrame:
    """Loan against holdings and liquidity left over the maintenance requirement, with the warning that applies."""
    r = W.ratio(C("loan"), C("longs"))
    x = C("longs") - C("loan") - MAINT * C("longs")
    a = a.withColumn("loan_ratio", F.coalesce(r, F.lit(0.0))).withColumn("excess", x)
    a = a.withColumn("excess_ratio", F.coalesce(W.ratio(C("excess"), C("longs")), F.lit(1.0)))
    warn = F.when(C("loan_ratio") > LOAN_CAP, "over the loan limit").when(C("excess_ratio") < EXCESS_WARN, "excess liquidity low")
    return a.withColumn("warning", warn)


def net_orders(orders: DataFrame, keys: Sequence[str], least: float = 1.0) -> DataFrame:
    """Signed dollars netted per name, tiny ones dropped; sells come first when shown in order of amount."""
    n = orders.groupBy(*keys).agg(F.round(F.sum("amount"), 2).alias("amount"))
    return n.where(F.abs("amount") >= least).withColumn("side", F.when(C("amount") < 0, "SELL").otherwise("BUY"))


def target_vs_held(held: DataFrame, targets: DataFrame, budget: DataFrame) -> DataFrame:
    """Per account: what to buy of each target, what is missing and what is held beyond the list.

    held (account, ticker, value), targets (ticker, weight): a short list, matched by a full outer join per account.
    """
    want = budget.withColumn("_t", targets.agg(F.collect_list(F.struct("ticker", "weight"))).scalar())
    want = want.select("account", F.inline("_t"), "budget").withColumn("target", C("weight") * C("budget"))
    h = held.groupBy("account", "ticker").agg(F.sum("value").alias("held"))
    d = want.select("account", "ticker", "target").join(h, ["account", "ticker"], "full")
    d = d.withColumn("target", F.coalesce("target", F.lit(0.0))).withColumn("held", F.coalesce("held", F.lit(0.0)))
    status = F.when(C("target") == 0, "extra").when(C("held") < 1, "missing").otherwise("held")
    return d.withColumn("status", status).withColumn("to_buy", F.greatest(F.lit(0.0), C("target") - C("held")))


def laggards(prices: DataFrame, bench: DataFrame, caps: DataFrame, drop: float, floor: float, rows: int = 252) -> DataFrame:
    """Names at least ``drop`` behind their own ``rows``-day high against the benchmark on the last day, size permitting.

    prices (ticker, d, px), bench (d, b), caps (ticker, cap).
    """
    x = prices.join(bench, "d").withColumn("x", C("px") / C("b"))
    x = x.withColumn("behind", W.rolling_high_drawdown(C("x"), ["ticker"], "d", rows))
    last = R.latest(x.select("ticker", "d", "behind"), ["ticker"], ["d"])
    return last.join(caps, "ticker").where((C("behind") <= -drop) & (C("cap") >= floor))


def fresh_alerts(signals: DataFrame, state: DataFrame, calendar: DataFrame, spacing: int = 63) -> DataFrame:
    """Signals whose name has no alert yet, or whose last alert is at least ``spacing`` trading days back.

    signals (sleeve, ticker, d), state (sleeve, ticker, last_d), calendar (d, pos).
    """
    s = signals.join(state, ["sleeve", "ticker"], "left")
    s = s.join(calendar.select("d", C("pos").alias("_p")), "d")
    s = s.join(calendar.select(C("d").alias("last_d"), C("pos").alias("_l")), "last_d", "left")
    return s.where(C("last_d").isNull() | (C("_p") - C("_l") >= spacing)).drop("_p", "_l")
