"""Event spacing, round trips, smoothed lines and on/off states of daily series.

Each fold runs over one series' flagged days only (a calendar bounds it), inside the JVM.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

C = F.col


def starts(df: DataFrame, keys: Sequence[str], pos: str, flag: Column, spacing: int = 63) -> DataFrame:
    """Positions of episode starts: the first flagged row, then each flagged row ``spacing`` rows after the last start."""
    hits = df.where(flag).groupBy(*keys).agg(F.array_sort(F.collect_set(pos)).alias("_p"))

    def step(acc: Column, p: Column) -> Column:
        free = (F.size(acc) == 0) | (p - F.element_at(acc, -1) >= spacing)
        return F.when(free, F.concat(acc, F.array(p))).otherwise(acc)

    empty = F.slice("_p", 1, 0)
    return hits.select(*keys, F.explode(F.aggregate("_p", empty, step)).alias(pos))


def trip_exits(
    df: DataFrame, keys: Sequence[str], pos: str, entry: str, recovered: str, max_hold: int = 252
) -> DataFrame:
    """Exit positions: the first recovered row after an entry, or ``max_hold`` rows after the latest entry."""
    w = Window.partitionBy(*keys).orderBy(pos)
    since = F.max(F.when(C(entry), C(pos))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    d = df.withColumn("_e", since).where(C("_e").isNotNull())
    d = d.where(C(entry) | C(recovered) | (C(pos) - C("_e") >= max_hold))
    # A live trip ends at the first closing row after its latest entry, the second row of that entry's stretch.
    nth = F.row_number().over(Window.partitionBy(*keys, "_e").orderBy(pos))
    return d.withColumn("_n", nth).where((C("_n") == 2) & ~C(entry)).select(*keys, pos)


def ewma(df: DataFrame, keys: Sequence[str], order: str, value: str, span: int, out: str) -> DataFrame:
    """Recursive exponential mean y = a*x + (1-a)*y, a = 2/(span+1), the first value as the start.

    Written with window sums over blocks of rows: a block is so long that anything two blocks back weighs less than a
    double can hold, so the result equals the recursion to rounding.
    """
    a = 2.0 / (span + 1)
    beta = 1 - a
    block = max(64, math.ceil(44 / -math.log(beta)))
    ln_b = F.lit(math.log(beta))
    w = Window.partitionBy(*keys).orderBy(order)
    d = df.withColumn("_i", F.row_number().over(w) - 1)
    d = d.withColumn("_b", F.floor(C("_i") / block).cast("int")).withColumn("_p", C("_i") % block)
    x = F.when(C("_i") == 0, C(value) / a).otherwise(C(value))
    inside = Window.partitionBy(*keys, "_b").orderBy("_i").rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("_part", a * F.exp(ln_b * C("_p")) * F.sum(x * F.exp(-ln_b * C("_p"))).over(inside))
    end = F.when(C("_p") == block - 1, C("_part"))
    blocks = Window.partitionBy(*keys).orderBy("_b")
    d = d.withColumn("_a1", F.coalesce(F.max(end).over(blocks.rangeBetween(-1, -1)), F.lit(0.0)))
    d = d.withColumn("_a2", F.coalesce(F.max(end).over(blocks.rangeBetween(-2, -2)), F.lit(0.0)))
    carry = F.exp(ln_b * (C("_p") + 1)) * (C("_a1") + beta**block * C("_a2"))
    return d.withColumn(out, C("_part") + carry).drop("_i", "_b", "_p", "_part", "_a1", "_a2")


def on_off_state(df: DataFrame, keys: Sequence[str], order: str, on: Column, off: Column, out: str = "on") -> DataFrame:
    """State after each row: off turns on where ``on`` holds, on turns off where ``off`` holds.

    A row where only one holds fixes the state. A row where both hold flips it, so the state is the last fixed one
    flipped by the number of such rows since.
    """
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    on, off = F.coalesce(on, F.lit(False)), F.coalesce(off, F.lit(False))
    d = df.withColumn("_fix", F.when(on & ~off, 1).when(off & ~on, 0)).withColumn("_both", (on & off).cast("int"))
    d = d.withColumn("_s", F.coalesce(F.last("_fix", ignorenulls=True).over(w), F.lit(0)))
    d = d.withColumn("_k", F.count("_fix").over(w))
    flips = F.sum("_both").over(Window.partitionBy(*keys, "_k").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return d.withColumn("_f", flips).withColumn(out, ((C("_s") + C("_f")) % 2) == 1).drop("_fix", "_both", "_s", "_k", "_f")


def intervals(df: DataFrame, keys: Sequence[str], order: str, state: str = "on") -> DataFrame:
    """(on, off) dates of each stretch of a state; an open stretch has no off date."""
    w = Window.partitionBy(*keys).orderBy(order)
    turn = C(state) != F.coalesce(F.lag(state).over(w), F.lit(False))
    d = df.withColumn("_t", turn).where("_t")
    d = d.withColumn("off", F.lead(order).over(w))
    return d.where(C(state)).select(*keys, C(order).alias("on"), "off")


def hybrid_intervals(
    df: DataFrame, keys: Sequence[str], order: str, exit_: Column, reentry: Column, bear_start: Column, bear_end: Column
) -> DataFrame:
    """Hedge stretches that end on the re-entry flag, or on the bear market's end once one began inside the stretch."""
    ev = df.where(exit_ | reentry | bear_start | bear_end).select(
        *keys,
        F.struct(
            C(order).alias("t"), exit_.alias("x"), reentry.alias("r"), bear_start.alias("s"), bear_end.alias("e")
        ).alias("_e"),
    )
    g = ev.groupBy(*keys).agg(F.array_sort(F.collect_list("_e")).alias("_a"))
    none = F.lit(None).cast("date")
    start = F.struct(
        none.alias("since"), F.lit(False).alias("bear"), F.lit(None).cast("array<struct<on:date,off:date>>").alias("done")
    )

    def step(acc: Column, e: Column) -> Column:
        hedged = acc["since"].isNotNull()
        bear = acc["bear"] | e["s"]
        end = F.when(bear, e["e"]).otherwise(e["r"])
        closed = F.struct(acc["since"].alias("on"), e["t"].alias("off"))
        done = F.concat(F.coalesce(acc["done"], F.array().cast("array<struct<on:date,off:date>>")), F.array(closed))
        opened = F.struct(e["t"].alias("since"), F.lit(False).alias("bear"), acc["done"].alias("done"))
        ended = F.struct(none.alias("since"), F.lit(False).alias("bear"), done.alias("done"))
        kept = F.struct(acc["since"].alias("since"), bear.alias("bear"), acc["done"].alias("done"))
        return F.when(~hedged & e["x"], opened).when(hedged & end, ended).when(hedged, kept).otherwise(acc)

    def finish(acc: Column) -> Column:
        done = F.coalesce(acc["done"], F.array().cast("array<struct<on:date,off:date>>"))
        tail = F.struct(acc["since"].alias("on"), none.alias("off"))
        return F.when(acc["since"].isNotNull(), F.concat(done, F.array(tail))).otherwise(done)

    return g.select(*keys, F.inline(F.aggregate("_a", start, step, finish)))
