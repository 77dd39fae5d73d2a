"""Value paths without simulation loops: two-asset books, contribution plans and trade tables in closed form."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.operators import asof

C = F.col


def two_asset_nav(
    df: DataFrame, keys: Sequence[str], date: str, ra: str, rb: str, target: str, cost: float = 0.0005
) -> DataFrame:
    """NAV and weight of a target-weight pair rebalanced when the target changes and at month ends.

    Between rebalances both legs grow by their cumulative returns, so a stretch is one factor and the NAV a running
    product of factors. Adds nav, weight, turnover (per row).
    """
    w = Window.partitionBy(*keys).orderBy(date)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    first = F.row_number().over(w) == 1
    month_end = F.trunc(C(date), "month") != F.trunc(F.lead(date).over(w), "month")
    d = (
        df.withColumn("_first", first)
        .withColumn("_a", F.sum(F.when(C("_first"), 0.0).otherwise(C(ra))).over(upto))
        .withColumn("_b", F.sum(F.when(C("_first"), 0.0).otherwise(C(rb))).over(upto))
        .withColumn(
            "_reb",
            C("_first") | (C(target) != F.lag(target).over(w)) | F.coalesce(month_end, F.lit(False)),
        )
    )
    held = F.when(C("_reb"), F.struct(C("_a").alias("a"), C("_b").alias("b"), C(target).alias("t")))
    d = d.withColumn("_h", F.last(held, ignorenulls=True).over(before))
    up = C("_h.t") * F.exp(C("_a") - C("_h.a"))
    d = d.withColumn("_g", F.when(C("_first"), 1.0).otherwise(up + (1 - C("_h.t")) * F.exp(C("_b") - C("_h.b"))))
    d = d.withColumn("_w", F.when(C("_first"), C(target)).otherwise(up / C("_g")))
    move = F.abs(C(target) - C("_w"))
    d = d.withColumn("_f", F.when(C("_reb"), C("_g") * (1 - 2 * cost * move)).otherwise(1.0))
    d = d.withColumn("_n", F.product("_f").over(upto))
    d = d.withColumn("nav", F.when(C("_reb"), C("_n")).otherwise(C("_n") * C("_g")))
    d = d.withColumn("turnover", F.when(C("_reb"), 2 * move / (1 - 2 * cost * move)).otherwise(0.0))
    d = d.withColumn("weight", F.when(C("_reb"), C(target)).otherwise(C("_w")))
    return d.drop("_first", "_a", "_b", "_reb", "_h", "_g", "_w", "_f", "_n")


def nav_stats(df: DataFrame, keys: Sequence[str], date: str, nav: str = "nav") -> DataFrame:
    """Total return, growth a year, volatility, Sharpe ratio and worst drawdown of a value path."""
    w = Window.partitionBy(*keys).orderBy(date)
    d = df.withColumn("_r", F.log(nav) - F.log(F.lag(nav).over(w))).withColumn(
        "_dd", C(nav) / F.max(nav).over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1
    )
    g = d.groupBy(*keys).agg(
        (F.max_by(nav, date) / F.min_by(nav, date)).alias("_x"),
        (F.datediff(F.max(date), F.min(date)) / 365.25).alias("_y"),
        F.stddev_samp("_r").alias("_s"),
        F.avg("_r").alias("_m"),
        F.min("_dd").alias("maxdd"),
    )
    root = F.sqrt(F.lit(252.0))
    return g.select(
        *keys,
        (C("_x") - 1).alias("total"),
        (F.pow("_x", 1 / C("_y")) - 1).alias("cagr"),
        (C("_s") * root).alias("vol"),
        (C("_m") / F.nullif(C("_s"), F.lit(0.0)) * root).alias("sharpe"),
        "maxdd",
    )


def contribution_value(
    flows: DataFrame,
    deploys: DataFrame,
    prices: DataFrame,
    ends: DataFrame,
    keys: Sequence[str],
    core: Column,
    fee: float = 0.001,
) -> DataFrame:
    """Final value per plan: each deposit's core buys the index on arrival, the rest waits in bills until the next
    deploy day and then buys the stock.

    flows (keys, day, amount, bil, q), deploys (keys, deploy_day), prices (keys, day, s, bil), ends (keys, s, q, bil
    at the last day).
    """
    keys = list(keys)
    buys = deploys.select(*keys, "deploy_day").distinct()
    at = prices.select(*keys, C("day").alias("deploy_day"), C("s").alias("s_d"), C("bil").alias("bil_d"))
    d = asof.forward(flows, buys.join(at, [*keys, "deploy_day"]), keys, "day", "deploy_day", ["s_d", "bil_d"], True)
    d = d.join(ends.select(*keys, C("s").alias("s_e"), C("q").alias("q_e"), C("bil").alias("bil_e")), keys)
    rest = C("amount") * (1 - core)
    grown = F.when(
        C("s_d").isNotNull(), rest * C("bil_d") / C("bil") * (1 - fee) * C("s_e") / C("s_d")
    ).otherwise(rest * C("bil_e") / C("bil"))
    index = C("amount") * core * (1 - fee) * C("q_e") / C("q")
    return d.groupBy(*keys).agg(F.sum("amount").alias("paid"), F.sum(grown + index).alias("final"))


def blotter_value(trades: DataFrame, prices: DataFrame, keys: Sequence[str], last_day: Column) -> DataFrame:
    """Daily value per account from a trade table (keys, ticker, day, shares, cash): shares held times price plus cash.

    Trades are netted per day first. A position lasts from its day to the next trade, and its days meet the prices by
    an equi-join.
    """
    keys = list(keys)
    net = trades.groupBy(*keys, "ticker", "day").agg(F.sum("shares").alias("shares"), F.sum("cash").alias("cash"))
    w = Window.partitionBy(*keys, "ticker").orderBy("day")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    p = net.withColumn("held", F.sum("shares").over(upto)).withColumn("spent", F.sum("cash").over(upto))
    p = p.withColumn("until", F.coalesce(F.date_sub(F.lead("day").over(w), 1), last_day))
    days = p.where(C("until") >= C("day")).select(
        *keys, "ticker", "held", "spent", F.explode(F.sequence("day", "until")).alias("day")
    )
    v = days.join(prices, ["ticker", "day"])
    return v.groupBy(*keys, "day").agg(
        F.sum(C("held") * C("px")).alias("stock"), F.sum("spent").alias("cash"), F.count(F.lit(1)).alias("lines")
    )


def position_rollup(trades: DataFrame, closing: DataFrame, bench: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per position: first buy, number of buys, money in, shares left, money out, value and gain at the last price, and
    what the same money in the benchmark would be worth.

    trades (keys, ticker, day, side, shares, price), closing (ticker, last_px), bench (day, b, b_end).
    """
    buy = C("side") == "buy"
    t = trades.join(bench, "day", "left").join(closing, "ticker", "left")
    money = C("shares") * C("price")
    g = t.groupBy(*keys, "ticker").agg(
        F.min(F.when(buy, C("day"))).alias("first_buy"),
        F.count_if(buy).alias("buys"),
        F.coalesce(F.sum(F.when(buy, money)), F.lit(0.0)).alias("invested"),
        F.sum(F.when(buy, C("shares")).otherwise(-C("shares"))).alias("shares"),
        F.coalesce(F.sum(F.when(~buy, money)), F.lit(0.0)).alias("sold"),
        F.max("last_px").alias("last_px"),
        F.coalesce(F.sum(F.when(buy, money * C("b_end") / C("b"))), F.lit(0.0)).alias("bench_value"),
    )
    g = g.withColumn("value", C("shares") * C("last_px"))
    return g.withColumn("pnl", C("value") + C("sold") - C("invested"))


def period_end_snapshot(df: DataFrame, keys: Sequence[str], day: str, values: Sequence[str], flow: str) -> DataFrame:
    """Last row of each year with the contributions paid in so far."""
    y = df.groupBy(*keys, F.year(day).alias("year")).agg(
        F.max_by(F.struct(day, *values), day).alias("_r"), F.sum(flow).alias("_f")
    )
    w = Window.partitionBy(*keys).orderBy("year").rowsBetween(Window.unboundedPreceding, 0)
    return y.select(
        *keys, "year", C(f"_r.{day}").alias(day), *[C(f"_r.{v}").alias(v) for v in values], F.sum("_f").over(w).alias("paid")
    )


_DRAWS_A_ROW = 50


def random_deploys(days: DataFrame, key: str, draws: int, seed: int) -> DataFrame:
    """Per name and draw the end value of its flows, deployed on as many random days of its calendar as it has of its own.

    ``days`` holds (key, day, s, bil, amount, dep), one row per trading day; names without a deploy day are left out. A
    name is one row with its calendar as an array, as long as the calendar; its draws are dealt over the tasks in blocks.
    A draw's days are those up to its n-th smallest md5 of seed, draw, name and day; a walk from the last day back then
    knows the next one. Only one number per name and draw leaves a task.
    """
    calendar = F.array_sort(F.collect_list(F.struct("day", "s", "bil", "amount")))
    d = days.groupBy(key).agg(calendar.alias("_c"), F.count_if("dep").cast("int").alias("_n"), F.max_by("s", "day").alias("_s"), F.max_by("bil", "day").alias("_b"))
    blocks = F.explode(F.sequence(F.lit(0), F.lit((draws - 1) // _DRAWS_A_ROW)))
    d = d.where(C("_n") > 0).withColumn("_k", blocks).repartition(key, "_k")
    first = C("_k") * _DRAWS_A_ROW
    d = d.withColumn("draw", F.explode(F.sequence(first, F.least(first + _DRAWS_A_ROW - 1, F.lit(draws - 1)))))

    def hashed(x: Column) -> Column:
        text = F.concat_ws("-", F.lit(str(seed)), C("draw").cast("string"), C(key).cast("string"), x["day"].cast("string"))
        return F.struct(F.substring(F.md5(text), 1, 8).alias("h"), x["day"].alias("day"))

    def step(a: Column, x: Column) -> Column:
        at_s, at_b = F.when(x["on"], x["s"]).otherwise(a["at_s"]), F.when(x["on"], x["bil"]).otherwise(a["at_b"])
        idle = x["amount"] * C("_b") / x["bil"]
        moved = x["amount"] * at_b / x["bil"] * 0.999 * C("_s") / at_s
        total = a["total"] + F.when(x["amount"].isNull(), 0.0).otherwise(F.coalesce(moved, idle))
        return F.struct(total.alias("total"), at_s.alias("at_s"), at_b.alias("at_b"))

    def walk(last: Column) -> Column:
        on = lambda k: (k["h"] < last["h"]) | ((k["h"] == last["h"]) & (k["day"] <= last["day"]))
        moves = F.zip_with("_c", "_h", lambda x, k: F.struct(x["s"].alias("s"), x["bil"].alias("bil"), x["amount"].alias("amount"), on(k).alias("on")))
        none = F.lit(None).cast("double")
        return F.aggregate(F.reverse(moves), F.struct(F.lit(0.0).alias("total"), none.alias("at_s"), none.alias("at_b")), step)["total"]

    d = d.withColumn("_h", F.transform("_c", hashed))
    last = F.array(F.element_at(F.array_sort("_h"), C("_n")))  # taken once per row
    return d.select(key, "draw", F.transform(last, walk)[0].alias("moved"))
