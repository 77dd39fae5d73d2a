"""Per-series window expressions. A series has one row per period, so a window holds one series' history only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

Keys = Sequence[str]


def series(keys: Keys, order: str) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(order)


def _rows(keys: Keys, order: str, back: int, ahead: int = 0) -> WindowSpec:
    return series(keys, order).rowsBetween(-back, ahead)


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where the base is null or zero."""
    return a / F.nullif(b, F.lit(0.0))


def period_offset(value: Column, keys: Keys, qn: str, back: int) -> Column:
    """The value exactly ``back`` periods earlier (null across a gap): a range frame, no self-join."""
    w = Window.partitionBy(*keys).orderBy(qn).rangeBetween(-back, -back)
    return F.max(value).over(w)


def gap_guarded_diff(value: Column, keys: Keys, qn: str) -> Column:
    """Change from the previous row, only when that row is the previous period."""
    w = series(keys, qn)
    return F.when(F.col(qn) - F.lag(qn).over(w) == 1, value - F.lag(value).over(w))


def yoy(value: Column, keys: Keys, qn: str) -> Column:
    return ratio(value, period_offset(value, keys, qn, 4)) - 1


def fill_periods(df: DataFrame, keys: Keys, qn: str) -> DataFrame:
    """One row per period between each series' first and last; new rows carry nulls."""
    keys = list(keys)
    span = df.groupBy(*keys).agg(F.min(qn).alias("_a"), F.max(qn).alias("_b"))
    grid = span.select(*keys, F.explode(F.sequence("_a", "_b")).alias(qn))
    return grid.join(df, [*keys, qn], "left")


def streak(flag: Column, keys: Keys, order: str) -> tuple[Column, Column]:
    """(island id, test) for runs of true ending at each row: a false or null row starts a new island."""
    on = F.coalesce(flag, F.lit(False))
    island = F.sum(F.when(on, 0).otherwise(1)).over(series(keys, order).rowsBetween(Window.unboundedPreceding, 0))
    return island, on


def with_streak(df: DataFrame, flag: Column, keys: Keys, order: str, out: str = "streak") -> DataFrame:
    island, on = streak(flag, keys, order)
    d = df.withColumn("_isl", island).withColumn("_on", on.cast("int"))
    run = Window.partitionBy(*keys, "_isl").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return d.withColumn(out, F.sum("_on").over(run).cast("int")).drop("_isl", "_on")


def rolling_mean_min(value: Column, keys: Keys, order: str, rows: int, least: int) -> Column:
    w = _rows(keys, order, rows - 1)
    return F.when(F.count(value).over(w) >= least, F.avg(value).over(w))


def annualised_sum(value: Column, keys: Keys, order: str, rows: int = 4, least: int = 3) -> Column:
    """Rolling sum scaled up to a full window when a period is missing."""
    w = _rows(keys, order, rows - 1)
    n = F.count(value).over(w)
    return F.when(n >= least, F.sum(value).over(w) * rows / n)


def full_window(value: Column, agg: Column, w: WindowSpec, rows: int) -> Column:
    """``agg`` over the frame, null until the frame holds ``rows`` values."""
    return F.when(F.count(value).over(w) == rows, agg.over(w))


def rolling_high_drawdown(value: Column, keys: Keys, order: str, rows: int = 252) -> Column:
    return value / full_window(value, F.max(value), _rows(keys, order, rows - 1), rows) - 1


def limited_ffill(value: Column, keys: Keys, order: str, limit: int = 5) -> Column:
    return F.last(value, ignorenulls=True).over(_rows(keys, order, limit))


def new_extreme(value: Column, keys: Keys, order: str, rows: int = 251, high: bool = True) -> Column:
    """True where the value reaches the extreme of the previous ``rows`` rows, the current one excluded."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(-rows, -1)
    past = full_window(value, F.max(value) if high else F.min(value), w, rows)
    return F.coalesce((value >= past) if high else (value <= past), F.lit(False))


def window_ready(value: Column, keys: Keys, order: str, rows: int = 251) -> Column:
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(-rows, -1)
    return (F.count(value).over(w) == rows) & value.isNotNull()


def upward_cross(above: Column, keys: Keys, order: str) -> Column:
    return above & ~F.coalesce(F.lag(above).over(series(keys, order)), F.lit(False))


def running_max(value: Column, keys: Keys, order: str) -> Column:
    return F.max(value).over(series(keys, order).rowsBetween(Window.unboundedPreceding, 0))


def running_product(factor: Column, keys: Keys, order: str) -> Column:
    return F.product(factor).over(series(keys, order).rowsBetween(Window.unboundedPreceding, 0))


def next_if_within(value: Column, date: str, keys: Keys, low: int, high: int) -> Column:
    """Next row's value when its date follows by ``low``..``high`` days."""
    w = series(keys, date)
    return F.when(F.datediff(F.lead(date).over(w), F.col(date)).between(low, high), F.lead(value).over(w))


def first_of_month(date: str, keys: Keys) -> Column:
    """True on the first row of each month (and on the first row of the series)."""
    w = series(keys, date)
    return F.coalesce(F.trunc(F.col(date), "month") != F.trunc(F.lag(date).over(w), "month"), F.lit(True))


def centred_median(value: Column, keys: Keys, order: str, half: int = 4) -> Column:
    """Median of the 2*half+1 rows around each row; frames are a few rows long, so the array is too."""
    xs = F.array_sort(F.collect_list(value).over(_rows(keys, order, half, half)))
    n = F.size(xs)
    return (F.element_at(xs, F.floor((n + 1) / 2).cast("int")) + F.element_at(xs, F.floor((n + 2) / 2).cast("int"))) / 2


def latest_on(flag: Column, position: Column, keys: Keys, order: str) -> Column:
    """Position of the latest flagged row up to and including this one."""
    return F.last(F.when(flag, position), ignorenulls=True).over(
        series(keys, order).rowsBetween(Window.unboundedPreceding, 0)
    )


def prior_mean(value: Column, keys: Keys, order: str, rows: int = 3, least: int | None = None) -> Column:
    """Mean of the ``rows`` rows before this one."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(-rows, -1)
    m = F.avg(value).over(w)
    return m if least is None else F.when(F.count(value).over(w) >= least, m)
